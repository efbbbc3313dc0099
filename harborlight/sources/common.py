"""What the sources' parsers share: the row of a point of interest, GeoJSON features, and links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.predicates import valid_latitude, valid_longitude

POI_COLUMNS = (
    "id", "type", "lat", "lon", "name", "source", "url", "attribution", "sk_icon", "rating", "review_count", "ts", "clearance_m",
)
ZOOM = 15
OPTIONAL = {"rating": "double", "review_count": "long", "ts": "timestamp", "clearance_m": "double"}


def marker_url(lat: Column, lon: Column) -> Column:
    """A map link with a marker; coordinates with five decimals, cut from exact hundred-thousandths."""

    def five(x: Column) -> Column:
        n = F.floor(F.abs(x) * 1e5 + 0.5).cast("long")
        sign = F.when((x < 0) & (n > 0), F.lit("-")).otherwise(F.lit(""))
        return F.concat(sign, F.floor(n / 100_000).cast("string"), F.lit("."), F.lpad(F.pmod(n, F.lit(100_000)).cast("string"), 5, "0"))

    a, b = five(lat), five(lon)
    return F.concat(F.lit(f"https://map.openseamap.org/?zoom={ZOOM}&lat="), a, F.lit("&lon="), b, F.lit("&mlat="), a, F.lit("&mlon="), b)


def as_poi(rows: DataFrame, source: str, attribution: str, **columns: Column) -> DataFrame:
    """Rows of a source as points of interest; those without an id or a place on Earth are dropped."""
    columns.setdefault("url", marker_url(columns["lat"], columns["lon"]))
    columns |= {"source": F.lit(source), "attribution": F.lit(attribution)}
    for name, kind in OPTIONAL.items():
        columns.setdefault(name, F.lit(None).cast(kind))
    sound = columns["id"].isNotNull() & valid_latitude(columns["lat"]) & valid_longitude(columns["lon"])
    return rows.where(sound).select(*(columns[name].alias(name) for name in POI_COLUMNS))


def count_rejected(raw: DataFrame, made: DataFrame) -> DataFrame:
    """One row: how many raw rows there are, and how many of them gave no point of interest."""
    total, kept = raw.agg(F.count("*").alias("rows")), made.agg(F.count("*").alias("kept"))
    return total.crossJoin(kept).select("rows", (F.col("rows") - F.col("kept")).alias("rejected"))  # a row each


def counted(raw: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """parse(raw), and a function that tells how many rows it had and rejected, once the result has been written or collected whole.

    Both are counted while the rows pass; parse gives at most a row for each. A result that is read twice counts its first reading.
    """
    read, made = Observation(), Observation()
    out = parse(raw.observe(read, F.count(F.lit(1)).alias("rows"))).observe(made, F.count(F.lit(1)).alias("kept"))
    return out, lambda: {"rows": read.get["rows"], "rejected": read.get["rows"] - made.get["kept"]}


def features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of GeoJSON files: feature_id (as text), coordinates, and the named properties."""
    schema = f"features array<struct<id:string,geometry:struct<coordinates:array<double>>,properties:struct<{properties}>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(F.explode("features").alias("f")).select(F.col("f.id").alias("feature_id"), "f.geometry.coordinates", "f.properties.*")


def place(kind: int) -> Column:
    """Longitude (0) or latitude (1) of a feature."""
    return F.get(F.col("coordinates"), F.lit(kind))
