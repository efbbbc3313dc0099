"""Versions of a vessel's route and what is told about the places on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import distance_text, eta_text, metres_text
from .predicates import valid_latitude, valid_longitude


def latest_route(versions: DataFrame) -> DataFrame:
    """The newest route of each vessel (vessel, version, route_id); one whose newest version has no route is without."""
    newest = versions.groupBy("vessel").agg(F.max_by("route_id", "version").alias("route_id"), F.max("version").alias("version"))
    return newest.where("route_id is not null")


def alarm_message(kind: Column, name: Column, along_m: Column, eta_s: Column) -> Column:
    eta = F.coalesce(F.when(eta_s >= 0, F.concat(F.lit(", ETA "), eta_text(eta_s))), F.lit(""))
    return F.concat(kind, F.lit(' "'), name, F.lit('" is on the route ahead, '), distance_text(along_m), F.lit(" away"), eta)


def clearance_clause(clearance_m: Column, air_draft_m: float, margin_m: float) -> Column:
    """What is added for a bridge that is too low."""
    return F.concat(
        F.lit(": clearance "), metres_text(clearance_m), F.lit(" m is at or below your air draft "), metres_text(F.lit(float(air_draft_m))),
        F.lit(" m (+"), metres_text(F.lit(float(margin_m))), F.lit(" m margin)"),
    )


def messages(found: DataFrame, low: DataFrame, air_draft_m: float, margin_m: float) -> DataFrame:
    """(id, message) for places of a corridor; low: the bridges (id, clearance_m) that are too low."""
    clauses = low.select("id", clearance_clause(F.col("clearance_m"), air_draft_m, margin_m).alias("clause"))
    text = alarm_message(F.col("type"), F.col("name"), F.col("along_m"), F.col("eta_s"))
    return found.join(clauses, "id", "left").select("id", F.concat(text, F.coalesce("clause", F.lit(""))).alias("message"))


def waypoints_ahead(courses: DataFrame, routes: DataFrame) -> DataFrame:
    """(vessel, route_id, seq, lat, lon): the points still ahead of each vessel on its route, in travel order.

    courses: vessel, route_id, reverse, point_index (of travel order; missing or negative: 0, past the end: the last). routes:
    route_id, coordinates (an array of [lon, lat, ...]); entries that are no place on Earth are skipped.
    """
    place = lambda c: valid_longitude(F.get(c, F.lit(0))) & valid_latitude(F.get(c, F.lit(1)))
    usable = F.transform(F.filter("coordinates", place), lambda c: F.struct(c[1].alias("lat"), c[0].alias("lon")))
    known = routes.select("route_id", usable.alias("onward")).where(F.size("onward") > 0).withColumn("back", F.reverse("onward"))  # turned once for all courses
    points = F.when(F.coalesce("reverse", F.lit(False)), F.col("back")).otherwise(F.col("onward"))
    joined = courses.join(known, "route_id").withColumn("points", points)
    first = F.least(F.greatest(F.coalesce(F.floor("point_index"), F.lit(0)), F.lit(0)), F.size("points") - 1).cast("int")
    rows = joined.select("vessel", "route_id", first.alias("first"), F.posexplode("points").alias("at", "point")).where("at >= first")
    return rows.select("vessel", "route_id", (F.col("at") - F.col("first")).alias("seq"), "point.lat", "point.lon")
