"""Aids to navigation of the Light List, from landed GeoJSON pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import from_epoch_ms
from ..functions.numbers import truthy
from ..functions.text import light_phrase, present
from .common import as_poi, features

# The last page of each district; pages count from 1.
LAST_PAGES = {"D01": 10, "D02": 4, "D05": 9, "D07": 15, "D08": 10, "D09": 5, "D11": 2, "D13": 3, "D14": 1, "D17": 2}

SOURCE, ATTRIBUTION = "usclightlist", "USCG Light List"
PROPERTIES = (
    "LIGHT_LIST_NUMBER:double,NAME:string,DECIMAL_LATITUDE:double,DECIMAL_LONGITUDE:double,VOLUME_NUMBER:string,AID_TYPE:string,"
    "AID_SUBTYPE:string,LIGHT_CHAR:string,LIGHT_NOM_RANGE:double,LIGHT_NOM_RANGE_UNIT:string,LIGHT_FOCAL_PLANE:double,"
    "LIGHT_FOCAL_PLANE_UNIT:string,STRUCTURE_TYPE:string,STRUCTURE_HEIGHT:double,STRUCTURE_HEIGHT_UNIT:string,DAYMARK_SHAPE:string,"
    "DAYMARK_COLOR:string,SOUND_EMITTER_TYPE:string,RACON_MORSE_CHARACTER:string,REMARK:string,MODIFIED_DATE:bigint,INACTIVE:string"
)
# Range units.
RANGE_UNITS = {"NAUT MI": "NM", "STAT MI": "mi"}


def load(spark: SparkSession, path: str) -> DataFrame:
    return features(spark, path, PROPERTIES)


def number_text(x: Column) -> Column:
    """A number as its shortest text, without a fraction if it has none."""
    return F.when(x == F.floor(x), F.floor(x).cast("long").cast("string")).otherwise(x.cast("string"))


def measured(value: str, unit: str) -> Column:
    """A value with its unit; both are needed."""
    v, u = F.col(value), present(F.col(unit))
    return F.when(v.isNotNull() & u.isNotNull(), F.struct(v.alias("value"), u.alias("unit")))


def isolated_danger(subtype: Column, remark: Column) -> Column:
    return F.coalesce(subtype.rlike(r"(?i)isolated\s*danger"), F.lit(False)) | F.coalesce(remark.rlike(r"(?i)isolated\s+danger"), F.lit(False))


def records(rows: DataFrame) -> DataFrame:
    """Parsed records; rows without a number or a volume are dropped."""
    return rows.where(F.col("LIGHT_LIST_NUMBER").isNotNull() & F.col("VOLUME_NUMBER").try_cast("double").isNotNull()).select(
        number_text(F.col("LIGHT_LIST_NUMBER")).alias("llnr"), F.col("DECIMAL_LATITUDE").alias("lat"), F.col("DECIMAL_LONGITUDE").alias("lon"),
        F.coalesce(present(F.col("NAME")), F.concat(F.lit("Unnamed "), F.coalesce(present(F.col("AID_TYPE")), F.lit("navigation aid")))).alias("name"),
        F.col("VOLUME_NUMBER").try_cast("double").alias("volume"), truthy(F.col("INACTIVE")).alias("inactive"),
        present(F.col("AID_TYPE")).alias("aid_type"), present(F.col("AID_SUBTYPE")).alias("aid_subtype"), present(F.col("REMARK")).alias("remark"),
        light_phrase(present(F.col("LIGHT_CHAR"))).alias("light"), measured("LIGHT_NOM_RANGE", "LIGHT_NOM_RANGE_UNIT").alias("nominal_range"),
        measured("LIGHT_FOCAL_PLANE", "LIGHT_FOCAL_PLANE_UNIT").alias("focal_plane"), measured("STRUCTURE_HEIGHT", "STRUCTURE_HEIGHT_UNIT").alias("structure_height"),
        present(F.col("STRUCTURE_TYPE")).alias("structure"), present(F.col("DAYMARK_SHAPE")).alias("daymark_shape"),
        present(F.col("DAYMARK_COLOR")).alias("daymark_color"), present(F.col("SOUND_EMITTER_TYPE")).alias("sound"),
        present(F.col("RACON_MORSE_CHARACTER")).alias("racon"), from_epoch_ms(F.col("MODIFIED_DATE")).alias("modified"),
    )


def summaries(rows: DataFrame) -> DataFrame:
    made = records(rows)
    icon = F.when(F.col("inactive"), "notice-to-mariners").when(isolated_danger(F.col("aid_subtype"), F.col("remark")), "hazard")
    return as_poi(
        made, SOURCE, ATTRIBUTION, id=F.col("llnr"), type=F.lit("Navigational"), lat=F.col("lat"), lon=F.col("lon"), name=F.col("name"),
        sk_icon=icon.otherwise("navigation-structure"), ts=F.col("modified"),
    )


def pinned(page: Column) -> Column:
    """Whether a page (district, underscore, number) is one of those that are published."""
    return page.isin(*(f"{district}_{n}" for district, last in LAST_PAGES.items() for n in range(1, last + 1)))
