"""Wrecks, obstructions and rocks of electronic charts, from landed GeoJSON by layer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import survey_date
from ..functions.numbers import s57_code, safe_positive_integer
from ..functions.text import lookup, present
from .common import as_poi, features, place

SOURCE, ATTRIBUTION = "noaaenc", "NOAA ENC"
# Layers and their labels.
LAYERS = {"wreck": "Wreck", "obstruction": "Obstruction", "rock": "Rock"}
# The service's layer numbers by scale band.
BAND_LAYERS = {
    "overview": {"wreck": 24, "obstruction": 21, "rock": 22}, "general": {"wreck": 29, "obstruction": 26, "rock": 27},
    "coastal": {"wreck": 33, "obstruction": 30, "rock": 31}, "approach": {"wreck": 39, "obstruction": 36, "rock": 37},
    "harbour": {"wreck": 36, "obstruction": 33, "rock": 34}, "berthing": {"wreck": 21, "obstruction": 19, "rock": 20},
}
# Water-level codes.
WATER_LEVELS = {
    1: "partly submerged at high water", 2: "always dry", 3: "always submerged", 4: "covers and uncovers", 5: "awash",
    6: "subject to inundation or flooding", 7: "floating",
}
PROPERTIES = "OBJECTID:string,CATWRK:string,CATOBS:string,OBJNAM:string,INFORM:string,DSNM:string,QUASOU:string,TECSOU:string,WATLEV:string,VALSOU:double,SOUACC:double,SORDAT:string"


def load(spark: SparkSession, path: str) -> DataFrame:
    return features(spark, path, PROPERTIES)


def object_id() -> Column:
    return F.coalesce(safe_positive_integer(F.col("feature_id")), safe_positive_integer(F.col("OBJECTID")))


def depth_label(quality: Column) -> Column:
    return F.when(s57_code(quality).isin(6, 7), "Least depth").otherwise("Depth")


def water_level(code: Column) -> Column:
    return lookup({k: v for k, v in WATER_LEVELS.items()}, s57_code(code))


def dangerous(category: Column) -> Column:
    """True, false, or null where a category doesn't say."""
    text = F.lower(category)
    return F.when(F.contains(text, F.lit("dangerous")), ~text.rlike("non[- ]dangerous"))


def summaries(rows: DataFrame, layer: str) -> DataFrame:
    return as_poi(
        rows, SOURCE, ATTRIBUTION, id=F.concat(F.lit(layer + "_"), object_id().cast("string")), type=F.lit("Hazard"), lat=place(1), lon=place(0),
        name=F.coalesce(present(F.col("OBJNAM")), F.lit(LAYERS[layer])), sk_icon=F.lit("hazard"), ts=survey_date(F.col("SORDAT")),
    )


def layer_number(band: Column, layer: Column) -> Column:
    """The service's number of a layer at a scale band; null for others."""
    numbers = {f"{b}/{name}": n for b, named in BAND_LAYERS.items() for name, n in named.items()}
    return lookup(numbers, F.concat_ws("/", band, layer))


def layers(spark: SparkSession, folder: str, band: str, wanted: list[str]) -> DataFrame:
    """Summaries of the wanted layers of a scale band, from files landed as folder/<band>/<layer>.geojson, in the layers' order."""
    if band not in BAND_LAYERS:
        raise ValueError(f"no scale band {band}")
    made = [summaries(load(spark, f"{folder}/{band}/{name}.geojson"), name) for name in LAYERS if name in wanted]
    if not made:
        none = spark.createDataFrame([], "feature_id string, coordinates array<double>, " + PROPERTIES.replace(":", " ").replace(",", ", "))
        return summaries(none, next(iter(LAYERS)))
    return reduce(DataFrame.unionByName, made)
