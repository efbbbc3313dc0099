"""Ports of the world, from a landed snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lookup, present
from .common import as_poi
from .lightlist import number_text

SOURCE, ATTRIBUTION = "wpi", "World Port Index"
# Harbour sizes and shelter.
SIZES = {"L": "Large", "M": "Medium", "S": "Small", "V": "Very small"}
SHELTER = {"E": "Excellent", "G": "Good", "F": "Fair", "P": "Poor", "N": "None"}
# Entrance restrictions and supplies by the column that flags them, in order.
RESTRICTIONS = {"erTide": "Tide", "erSwell": "Swell", "erIce": "Ice", "erOther": "Other"}
SUPPLIES = {"suProvisions": "Provisions", "suWater": "Water", "suFuel": "Fuel oil", "suDiesel": "Diesel"}
SCHEMA = (
    "ports array<struct<portNumber:double,portName:string,alternateName:string,countryName:string,xcoord:double,ycoord:double,"
    "harborSize:string,shelter:string,chDepth:string,maxVesselLength:string,firstPortOfEntry:string,"
    + ",".join(f"{c}:string" for c in (*RESTRICTIONS, *SUPPLIES)) + ">>"
)


def load(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    return raw.select(F.explode("ports").alias("p")).select("p.*")


def label(table: dict[str, str], code: Column) -> Column:
    return lookup(table, F.upper(F.trim(code)))


def flag(code: Column) -> Column:
    """Yes and no as a boolean, anything else as absent."""
    text = F.upper(F.trim(code))
    return F.when(text == "Y", True).when(text == "N", False)


def flagged(labels: dict[str, str]) -> Column:
    """The labels of the columns that say yes, in the labels' order."""
    return F.filter(F.array(*(F.when(flag(F.col(c)), F.lit(label)) for c, label in labels.items())), lambda x: x.isNotNull())


def restrictions() -> Column:
    return flagged(RESTRICTIONS)


def supplies() -> Column:
    return flagged(SUPPLIES)


def metres(x: Column) -> Column:
    """A number or a numeric text, null if it isn't one or not positive."""
    value = F.nullif(F.trim(x), F.lit("")).try_cast("double")
    return F.when(value > 0, value)


def display_name(name: Column) -> Column:
    other, country = present(F.col("alternateName")), present(F.col("countryName"))
    with_other = F.concat(name, F.coalesce(F.concat(F.lit(" ("), other, F.lit(")")), F.lit("")))
    return F.concat(with_other, F.coalesce(F.concat(F.lit(", "), country), F.lit("")))


def summaries(rows: DataFrame) -> DataFrame:
    number = number_text(F.col("portNumber"))
    return as_poi(
        rows, SOURCE, ATTRIBUTION, id=number, type=F.lit("Marina"), lat=F.col("ycoord"), lon=F.col("xcoord"),
        name=F.coalesce(present(F.col("portName")), F.concat(F.lit("Port "), number)), sk_icon=F.lit("marina"),
    )
