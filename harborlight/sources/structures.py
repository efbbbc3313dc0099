"""Locks and dams, from landed GeoJSON by layer. Lengths are in feet on the wire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import feet
from ..functions.text import present
from .common import as_poi, features, place
from .enc import object_id

SOURCE, ATTRIBUTION = "usace", "US Army Corps of Engineers"
# Kind, icon, name column and label by layer.
LAYERS = {"lock": ("Lock", "lock", "PMSNAME", "Lock"), "dam": ("Dam", "dam", "NAME", "Dam")}
PROPERTIES = (
    "OBJECTID:string,PMSNAME:string,RIVER:string,RIVERMI:double,LENGTH:double,WIDTH:double,LIFT:double,GATETYPE:string,YEAROPEN:double,STATE:string,"
    "NAME:string,RIVER_OR_STREAM:string,CITY:string,PRIMARY_PURPOSE:string,PRIMARY_DAM_TYPE:string,DAM_HEIGHT:double,DAM_LENGTH:double,"
    "YEAR_COMPLETED:double,HAZARD_POTENTIAL:string,CONDITION_ASSESSMENT:string,PRIMARY_OWNER_TYPE:string"
)


def load(spark: SparkSession, path: str) -> DataFrame:
    return features(spark, path, PROPERTIES)


def in_metres(column: str) -> Column:
    return F.when(F.col(column) > 0, feet(F.col(column)))


def summaries(rows: DataFrame, layer: str) -> DataFrame:
    kind, icon, name, label = LAYERS[layer]
    return as_poi(
        rows, SOURCE, ATTRIBUTION, id=F.concat(F.lit(layer + "_"), object_id().cast("string")), type=F.lit(kind), lat=place(1), lon=place(0),
        name=F.coalesce(present(F.col(name)), F.lit(label)), sk_icon=F.lit(icon),
    )
