"""Community reviews of places, from landed list responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detail
from ..operators.predicates import valid_latitude, valid_longitude
from .common import as_poi

SOURCE, ATTRIBUTION = "activecaptain", "ActiveCaptain community"
SCHEMA = (
    "pointsOfInterest array<struct<id:string,poiType:string,name:string,mapLocation:struct<latitude:double,longitude:double>,"
    "reviewSummary:struct<averageRating:double,numberOfReviews:bigint>,poiCount:bigint>>"
)


def load(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    return raw.select(F.explode("pointsOfInterest").alias("p")).select("p.*")


def details(rows: DataFrame) -> DataFrame:
    """Landed detail responses by `id`; those without a kind, a name or a place on Earth are dropped."""
    p = F.col("pointOfInterest")
    sound = p["poiType"].isNotNull() & (F.length(p["name"]) > 0)
    sound &= valid_latitude(p["mapLocation"]["latitude"]) & valid_longitude(p["mapLocation"]["longitude"])
    return rows.where(sound).withColumn("id", p["id"])


def summaries(rows: DataFrame) -> DataFrame:
    """Clusters and rows without kind or name are dropped; a score counts only with reviews."""
    single = (F.coalesce("poiCount", F.lit(1)) <= 1) & F.col("poiType").isNotNull() & (F.length("name") > 0)
    reviews = F.when(F.col("reviewSummary.numberOfReviews") > 0, F.col("reviewSummary.numberOfReviews"))
    return as_poi(
        rows.where(single), SOURCE, ATTRIBUTION, id=F.col("id"), type=F.col("poiType"), lat=F.col("mapLocation.latitude"),
        lon=F.col("mapLocation.longitude"), name=F.col("name"), sk_icon=detail.icon(F.col("poiType")),
        url=F.concat(F.lit("https://activecaptain.garmin.com/pois/"), "id"), review_count=reviews,
        rating=F.when(reviews.isNotNull(), F.col("reviewSummary.averageRating")),
    )
