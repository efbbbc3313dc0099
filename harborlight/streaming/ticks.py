"""One tick for all alarms: a stream of fixes, the places around them read once for each micro-batch, and every contributor evaluated on them.

    q = start(fixes_stream, Ticks(folder, [Proximity(), Bridges(1.0), RouteAhead(routes)], table_reader(places)))

A micro-batch throttles its fixes (from the last tick of each vessel on), asks the contributors for the boxes that they need, joins
them into a few, has the places read once inside these, and settles each contributor's alarms over the ticks in order. What
is told does not depend on how fixes fall into batches.

State is a table of vessels and one of alarms that hold, written for each batch beside the events. A batch begins with the state
of the last whole batch before it and overwrites what it wrote before, so a batch that runs again changes nothing. If places can't
be read, the ticks are spent and alarms stay as they are; if a contributor fails, only its own do.

Fixes: vessel, ts, lat, lon and, where known, air_draft (the last one known counts) and sog. Defined cases: fixes without a vessel, a time or a
position are none; those no later than the newest of their vessel in earlier batches come too late and are dropped; an
empty batch changes nothing; a vessel without a tick keeps its alarms.
"""

from __future__ import annotations

import dataclasses
import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..boxes import Box, wrapped
from ..folders import checkpointed
from ..functions.geo import EARTH_RADIUS_M, in_bbox
from ..operators import alarms, corridor, course
from ..operators.predicates import valid_latitude, valid_longitude
from ..operators.throttle import MIN_METRES, MIN_SECONDS, throttled

log = logging.getLogger(__name__)
#: Boxes are joined within squares of so many degrees: at most 648 are asked for.
SQUARE = 10
Reader = Callable[[list[Box]], DataFrame]


@dataclasses.dataclass(frozen=True)
class Proximity:
    """Hazards: raised within the radius, cleared beyond 1.2 radii."""

    radius_m: float = alarms.RADIUS_M
    name: str = "proximity"

    def around(self, ticks: DataFrame) -> DataFrame:
        """(lat, lon, reach_m): around which positions places are needed."""
        return ticks.select("lat", "lon", F.lit(alarms.scan_radius(self.radius_m)).alias("reach_m"))

    def found(self, ticks: DataFrame, places: DataFrame) -> DataFrame:
        """(vessel, tick, id, inside, message): where an alarm may hold, whether it is raised there, and what is told."""
        return _within(ticks, places.where("type = 'Hazard'"), self.radius_m)


@dataclasses.dataclass(frozen=True)
class Bridges:
    """Bridges that are too low for the vessel's air draft; without one none holds."""

    margin_m: float
    radius_m: float = alarms.RADIUS_M
    name: str = "bridges"

    def around(self, ticks: DataFrame) -> DataFrame:
        return ticks.where("air_draft is not null").select("lat", "lon", F.lit(alarms.scan_radius(self.radius_m)).alias("reach_m"))

    def found(self, ticks: DataFrame, places: DataFrame) -> DataFrame:
        low = places.where("type = 'Bridge' and clearance_m is not null")
        return _within(ticks.where("air_draft is not null"), low, self.radius_m, F.col("clearance_m") <= F.col("air_draft") + self.margin_m)


@dataclasses.dataclass(frozen=True)
class RouteAhead:
    """Places in the corridor of a vessel's route, from the vessel on; told again when the message changes.

    routes: vessel, ts, points (array of structs lat, lon; null where the route has ended). The latest at a tick's time counts.
    """

    routes: DataFrame
    half_width_m: float = 300.0
    look_ahead_m: float = corridor.LOOK_AHEAD_M
    name: str = "route"

    def _on_route(self, ticks: DataFrame) -> DataFrame:
        return alarms.as_of(ticks.select("vessel", "ts", "tick", "lat", "lon", "sog"), self.routes, ["points"]).where("last_points is not null")

    def around(self, ticks: DataFrame) -> DataFrame:
        # What lies less than so far along the route is no further from the vessel.
        return self._on_route(ticks).select("lat", "lon", F.lit(self.look_ahead_m + self.half_width_m).alias("reach_m"))

    def found(self, ticks: DataFrame, places: DataFrame) -> DataFrame:
        going = checkpointed(self._on_route(ticks).withColumn("route_id", F.monotonically_increasing_id()))
        every = F.concat(F.array(F.struct("lat", "lon")), F.transform("last_points", lambda p: F.struct(p.lat.alias("lat"), p.lon.alias("lon"))))
        points = going.select("route_id", F.posexplode(every).alias("seq", "p")).select("route_id", "seq", "p.*")
        near = corridor.ahead(corridor.corridor(places, corridor.legs_of(points), self.half_width_m), self.look_ahead_m).drop("eta_s")
        told = near.join(going.select("route_id", "vessel", "tick", "sog"), "route_id").withColumn("eta_s", F.when(F.col("sog") > 0, F.col("along_m") / F.col("sog")))
        message = course.alarm_message(F.col("type"), F.col("name"), F.col("along_m"), F.col("eta_s"))
        return told.select("vessel", "tick", "id", F.lit(True).alias("inside"), message.alias("message"))


def _within(ticks: DataFrame, places: DataFrame, radius_m: float, holds=None) -> DataFrame:
    put = places.select("id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), "clearance_m")
    near = alarms.within(ticks.select("vessel", "tick", "lat", "lon", "air_draft"), put, radius_m * alarms.CLEAR_FACTOR)
    near = near if holds is None else near.where(holds)
    one = near.groupBy("vessel", "tick", "id").agg((F.min("distance_m") <= radius_m).alias("inside"))  # an id may have two places
    return one.withColumn("message", F.lit(None).cast("string"))


def table_reader(places: DataFrame) -> Reader:
    """Reads a table of places (seq, id, type, name, lat, lon, clearance_m); the boxes reach its scan as filters."""

    def read(boxes: list[Box]) -> DataFrame:
        inside = [in_bbox(F.col("lat"), F.col("lon"), b.south, b.north, b.west, b.east) for b in boxes]
        return places.where(reduce(lambda a, b: a | b, inside, F.lit(False)))

    return read


def joined_boxes(around: DataFrame) -> list[Box]:
    """A few boxes that hold all circles (lat, lon, reach_m), one for each square of SQUARE degrees that has centres."""
    turn = F.least(F.col("reach_m") / EARTH_RADIUS_M * 1.001, F.lit(3.2))
    up = F.degrees(turn)
    wide = F.abs(F.col("lat")) + up >= 89.9
    aside = F.when(wide, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(turn) / F.cos(F.radians("lat"))))) * 1.001)
    square = [F.floor(F.col(c) / SQUARE).alias(f"_{c}") for c in ("lat", "lon")]
    rows = around.groupBy(*square).agg(
        F.min(F.col("lat") - up).alias("south"), F.max(F.col("lat") + up).alias("north"),
        F.min(F.col("lon") - aside).alias("west"), F.max(F.col("lon") + aside).alias("east"),
    ).collect()
    full = lambda r: r.east - r.west >= 360
    return [Box(max(-90.0, r.south), min(90.0, r.north), -180.0 if full(r) else wrapped(r.west), 180.0 if full(r) else wrapped(r.east)) for r in rows]


def settled(found: DataFrame, ticks: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vessel, id, ts, event, since, message) of what is raised, told anew (refresh) or cleared, and the alarms that hold afterwards.

    found: see Proximity.found; ticks: vessel, tick (from 1), ts; active: vessel, id, since, message before the first tick.
    """
    ends = ticks.groupBy("vessel").agg(F.max("tick").alias("end"))
    before = active.join(ends, "vessel", "left_semi").select("vessel", "id", F.lit(0).cast("long").alias("tick"), F.lit(True).alias("inside"), "message", F.col("since").alias("at"))
    now = found.join(ticks.select("vessel", "tick", F.col("ts").alias("at")), ["vessel", "tick"]).select("vessel", "id", F.col("tick").cast("long"), "inside", "message", "at")
    pair = Window.partitionBy("vessel", "id").orderBy("tick")
    rows = before.unionByName(now).withColumn("fresh", F.coalesce(F.lag("tick").over(pair) + 1 != F.col("tick"), F.lit(True)))
    rows = rows.withColumn("run", F.sum(F.col("fresh").cast("long")).over(pair))
    run = Window.partitionBy("vessel", "id", "run").orderBy("tick")
    rows = rows.withColumn("since", F.first(F.when(F.col("inside"), F.col("at")), ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumns({"was": F.lag("since").over(run), "told": F.lag("message").over(run), "next": F.lead("tick").over(run)})
    rows = checkpointed(rows.where("since is not null"))
    event = F.when(F.col("was").isNull(), "raise").when(~F.col("message").eqNullSafe(F.col("told")), "refresh")
    turns = rows.where("tick > 0").select("vessel", "id", F.col("at").alias("ts"), event.alias("event"), "since", "message").where("event is not null")
    last = rows.where("next is null").join(ends, "vessel")
    over = last.where("tick < end").select("vessel", "id", (F.col("tick") + 1).alias("tick"), "since", "message")
    gone = over.join(ticks.select("vessel", "tick", "ts"), ["vessel", "tick"]).select("vessel", "id", "ts", F.lit("clear").alias("event"), "since", "message")
    held = last.where("tick = end").select("vessel", "id", "since", "message")
    return turns.union(gone), held.union(active.join(ends, "vessel", "left_anti").select("vessel", "id", "since", "message"))


class Ticks:
    """The state of all alarms in a folder that driver and executors share; `step` is the body of foreachBatch."""

    def __init__(self, folder: str, contributors: list, read_places: Reader, min_seconds: float = MIN_SECONDS, min_metres: float = MIN_METRES):
        self.folder, self.contributors, self.read_places = folder.rstrip("/"), contributors, read_places
        self.throttle = (min_seconds, min_metres)

    def events(self, spark: SparkSession) -> DataFrame:
        """What was told: batch, contributor, vessel, id, ts, event, since, message."""
        return spark.read.parquet(f"{self.folder}/events")

    def _files(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state")
        return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _whole(self, spark: SparkSession) -> list[int]:
        """The batches whose state was written to its end."""
        path, files = self._files(spark)
        if not files.exists(path):
            return []
        return sorted(int(s.getPath().getName()) for s in files.listStatus(path) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "whole")))

    def _state(self, batch: int, name: str) -> str:
        return f"{self.folder}/state/{batch}/{name}"

    def step(self, fixes: DataFrame, batch: int) -> None:
        spark = fixes.sparkSession
        vessel = dict(fixes.dtypes)["vessel"]
        earlier = [b for b in self._whole(spark) if b < batch]
        shapes = {
            "vessels": f"vessel {vessel}, newest timestamp, tick_ts timestamp, tick_lat double, tick_lon double, air_draft double",
            "alarms": f"contributor string, vessel {vessel}, id string, since timestamp, message string",
        }
        vessels, holding = (
            spark.read.schema(s).parquet(self._state(earlier[-1], n)) if earlier else spark.createDataFrame([], s) for n, s in shapes.items()
        )
        optional = [F.col(c).cast("double").alias(c) if c in fixes.columns else F.lit(None).cast("double").alias(c) for c in ("air_draft", "sog")]
        sound = fixes.where(valid_latitude(F.col("lat")) & valid_longitude(F.col("lon")) & F.col("vessel").isNotNull() & F.col("ts").isNotNull())
        rows = sound.select("vessel", "ts", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), *optional, F.lit(False).alias("seed"))
        rows = rows.join(vessels.select("vessel", "newest"), "vessel", "left").where("newest is null or ts > newest").drop("newest")
        seeds = vessels.select(
            "vessel", F.col("tick_ts").alias("ts"), F.col("tick_lat").alias("lat"), F.col("tick_lon").alias("lon"), "air_draft",
            F.lit(None).cast("double").alias("sog"), F.lit(True).alias("seed"),
        )
        known = alarms.numbered(seeds.join(rows, "vessel", "left_semi").unionByName(rows).withColumn("first", F.when(F.col("seed"), 0).otherwise(1)), ["ts", "first", "lat", "lon", "sog", "air_draft"])
        known = checkpointed(alarms.filled_forward(known, "air_draft").withColumnRenamed("tick", "fix").drop("stretch", "first"))
        ticking = throttled(known, *self.throttle, order=["fix"])
        ticks = checkpointed(alarms.numbered(ticking.where("not seed"), ["ts", "fix"]).drop("stretch"))

        newest = known.groupBy("vessel").agg(F.max("ts").alias("newest"), F.max_by("air_draft", "fix").alias("air_draft"))
        last = ticks.groupBy("vessel").agg(F.max_by(F.struct("ts", "lat", "lon"), "tick").alias("t"))
        fresh = newest.join(last, "vessel", "left").join(vessels.select("vessel", "tick_ts", "tick_lat", "tick_lon"), "vessel", "left")
        fresh = fresh.select("vessel", "newest", *(F.coalesce(f"t.{c}", f"tick_{c}").alias(f"tick_{c}") for c in ("ts", "lat", "lon")), "air_draft")
        after = fresh.unionByName(vessels.join(fresh, "vessel", "left_anti"))

        told, holds = self._evaluated(ticks, holding)
        events = told if told is not None else spark.createDataFrame([], f"contributor string, vessel {vessel}, id string, ts timestamp, event string, since timestamp, message string")
        events.write.mode("overwrite").parquet(f"{self.folder}/events/batch={batch}")
        after.write.mode("overwrite").parquet(self._state(batch, "vessels"))
        holds.write.mode("overwrite").parquet(self._state(batch, "alarms"))
        path, files = self._files(spark)
        files.create(spark._jvm.org.apache.hadoop.fs.Path(path, f"{batch}/whole"), True).close()
        for old in earlier[:-1]:  # the last one is what this batch would begin with again
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(path, str(old)), True)

    def _evaluated(self, ticks: DataFrame, holding: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        if ticks.isEmpty():
            return None, holding
        able, around = [], []
        for one in self.contributors:
            try:
                around.append(checkpointed(one.around(ticks)))
                able.append(one)
            except Exception:
                log.exception("%s: no box; its alarms stay as they are", one.name)
        try:
            boxes = joined_boxes(reduce(DataFrame.unionByName, around)) if around else []
            places = checkpointed(self.read_places(boxes)) if boxes else None
        except Exception:
            log.exception("places can't be read; alarms stay as they are")
            return None, holding
        told, holds, done = [], [], []
        for one in able:
            try:
                # Without a box nothing is near, and what holds is cleared.
                found = one.found(ticks, places) if places is not None else ticks.select("vessel", "tick", F.lit("").alias("id"), F.lit(True).alias("inside"), F.lit("").alias("message")).where(F.lit(False))
                events, held = settled(found, ticks, holding.where(F.col("contributor") == one.name).drop("contributor"))
                pair = [checkpointed(df.select(F.lit(one.name).alias("contributor"), "*")) for df in (events, held)]
            except Exception:
                log.exception("%s: alarms stay as they are", one.name)
                continue
            told.append(pair[0])
            holds.append(pair[1])
            done.append(one.name)
        kept = holding.where(~F.col("contributor").isin(done)) if done else holding
        return (reduce(DataFrame.unionByName, told) if told else None), reduce(DataFrame.unionByName, holds, kept)


def start(fixes: DataFrame, ticks: Ticks, checkpoint: str, **trigger):
    """The running query; trigger: as of DataStreamWriter.trigger (default: availableNow)."""
    return fixes.writeStream.foreachBatch(ticks.step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
