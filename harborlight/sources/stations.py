"""Tide and current stations, from landed station lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import present
from .common import as_poi

SOURCE, ATTRIBUTION = "noaacoops", "NOAA CO-OPS"
# Labels and page addresses by station type.
KINDS = {
    "tide": ("Tide station", "https://tidesandcurrents.noaa.gov/stationhome.html?id="),
    "current": ("Current station", "https://tidesandcurrents.noaa.gov/noaacurrents/Predictions?id="),
}
SCHEMA = "stations array<struct<id:string,name:string,lat:double,lng:double,state:string,timezone:string>>"


def enabled_kinds(tide: bool, current: bool) -> list[str]:
    return [kind for kind, on in (("tide", tide), ("current", current)) if on]


def of_kinds(summaries_of: DataFrame, kinds: list[str]) -> DataFrame:
    """Stations of the kinds that are switched on, by what their id begins with."""
    return summaries_of.where(F.split("id", "_")[0].isin(*kinds) if kinds else F.lit(False))


def load(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    return raw.select(F.explode("stations").alias("s")).select("s.*")


def summaries(rows: DataFrame, kind: str) -> DataFrame:
    number = present(F.col("id"))
    page = F.concat(F.lit(KINDS[kind][1]), F.replace(F.url_encode(number), F.lit("+"), F.lit("%20")))
    return as_poi(
        rows, SOURCE, ATTRIBUTION, id=F.concat(F.lit(kind + "_"), number), type=F.lit("Navigational"), lat=F.col("lat"), lon=F.col("lng"),
        name=F.coalesce(present(F.col("name")), F.concat(F.lit("Station "), number)), sk_icon=F.lit("navigation-structure"), url=page,
    )
