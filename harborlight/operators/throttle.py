"""The tick throttle in parallel: a vessel's first fix ticks, then each that is late and far enough from the last that did.

Each fix has a successor, the first later fix that is late and far enough; what ticks is the path of successors from the first
fix. Successors are looked for block by block (BLOCK fixes of a vessel), at once for all blocks. A fix without one in its
block goes on to later blocks: boxes around blocks, and around 2, 4, 8, ... of them, tell which it may pass over, so that a
vessel at anchor costs a few steps, not one for each block. Inside a block the path from any fix is known
at once; the fixes at which paths enter blocks are a small table, where the path from the first is found by pointer doubling. No
vessel passes through one task.

Defined cases: fixes without a vessel or a time, or whose position is null, not finite or not on Earth, are no fixes: they
neither tick nor count as last; fixes of one time go by their other columns; a table without fixes gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..folders import checkpointed
from ..functions.geo import EARTH_RADIUS_M
from .alarms import numbered
from .predicates import valid_latitude, valid_longitude

MIN_SECONDS, MIN_METRES = 60.0, 100.0
#: Fixes of a vessel that a task takes at once.
BLOCK = 4096


def metres_between(lat: np.ndarray, lon: np.ndarray, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    """Distances of positions in radians, pair by pair."""
    h = np.sin((lats - lat) / 2) ** 2 + np.cos(lat) * np.cos(lats) * np.sin((lons - lon) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0.0, 1 - h)))


def first_far(ts, lat, lon, at, fixes, metres: float) -> np.ndarray:
    """For each position (ts unused beyond `at`) the first of the fixes from place `at` on that is far enough; their number if none is."""
    lats, lons = fixes
    at = at.copy()
    open_ = np.flatnonzero(at < len(lats))
    while len(open_):
        near = metres_between(lat[open_], lon[open_], lats[at[open_]], lons[at[open_]]) < metres
        open_ = open_[near]
        at[open_] += 1
        open_ = open_[at[open_] < len(lats)]
    return at


def _columns(table: pa.Table):
    ts = np.asarray(table.column("_ts"))
    return ts, *(np.radians(np.asarray(table.column(c))) for c in ("_lat", "_lon"))


def block_paths(wait: float, metres: float):
    """An applyInArrow function over a block: for each fix its place, its successor's in the block or -1, and where its path leaves the block."""

    def run(key, table):
        table = table.sort_by("_n")
        n = np.asarray(table.column("_n"))
        ts, lat, lon = _columns(table)
        to = first_far(ts, lat, lon, np.searchsorted(ts, ts + wait), (lat, lon), metres)
        leaves = np.arange(len(n))
        for i in range(len(n) - 1, -1, -1):
            if to[i] < len(n):
                leaves[i] = leaves[to[i]]
        next_ = np.where(to < len(n), n[np.minimum(to, len(n) - 1)], -1)
        return table.append_column("_next", pa.array(next_)).append_column("_leaves", pa.array(n[leaves]))

    return run


def block_search(wait: float, metres: float):
    """An applyInArrow function over a block's fixes (no _from) and fixes of earlier blocks that ask for their successor here (_from)."""

    def run(key, table):
        asks = np.asarray(table.column("_from").is_valid())
        here = table.filter(pa.array(~asks)).sort_by("_n")
        asking = table.filter(pa.array(asks))
        n = np.asarray(here.column("_n"))
        ts, lat, lon = _columns(here)
        mine, my_lat, my_lon = _columns(asking)
        to = first_far(mine, my_lat, my_lon, np.searchsorted(ts, mine + wait), (lat, lon), metres)
        found = np.where(to < len(n), n[np.minimum(to, max(0, len(n) - 1))] if len(n) else -1, -1)
        return asking.drop_columns(["_n"]).append_column("_n", pa.array(found)).select(["vessel", "_from", "_ts", "_lat", "_lon", "_block", "_n"])

    return run


def on_path(key, table):
    """A block's fixes on the path from where it enters (_enters)."""
    table = table.sort_by("_n")
    n, next_, enters = (np.asarray(table.column(c)) for c in ("_n", "_next", "_enters"))
    keep = np.zeros(len(n), bool)
    at = int(np.searchsorted(n, enters[0]))
    while at >= 0:
        keep[at] = True
        at = int(np.searchsorted(n, next_[at])) if next_[at] >= 0 else -1
    return table.filter(pa.array(keep))


def _boxes(fixes: DataFrame) -> DataFrame:
    """(vessel, _level, _node, box and latest time) of 2^level blocks, for each level at which a vessel has more than one node."""
    sides = ("south", "north", "west", "east", "until")
    one = fixes.groupBy("vessel", "_block").agg(
        F.min("_lat").alias("south"), F.max("_lat").alias("north"), F.min("_lon").alias("west"), F.max("_lon").alias("east"), F.max("_ts").alias("until")
    )
    last = one.groupBy("vessel").agg(F.max("_block").alias("_last"))
    levels = F.filter(F.sequence(F.lit(0), F.lit(40)), lambda k: (k == 0) | (F.call_function("shiftright", F.col("_last"), k) > 0))
    each = one.join(last, "vessel").select("vessel", "_block", *sides, F.explode(levels).alias("_level"))
    node = F.call_function("shiftright", F.col("_block"), F.col("_level")).alias("_node")
    return each.groupBy("vessel", "_level", node).agg(*((F.min if s in ("south", "west") else F.max)(s).alias(s) for s in sides))


def _may_hold(wait: float, metres: float) -> Column:
    """Whether a node's fixes may be late and far enough: no fix of a box is further than by its corners' steps north and east."""
    away = lambda a, low, high: F.greatest(F.abs(F.col(a) - F.col(low)), F.abs(F.col(a) - F.col(high)))
    reach = F.radians(away("_lat", "south", "north") + away("_lon", "west", "east")) * EARTH_RADIUS_M
    return (F.col("until") >= F.col("_ts") + wait) & (reach * 1.000001 >= metres)


def _across(fixes: DataFrame, boxes: DataFrame, wait: float, metres: float) -> DataFrame:
    """(vessel, _from, _to): the successor in a later block of each fix at which a path leaves its block, where there is one."""
    open_ = fixes.where("_leaves = _n").select(
        "vessel", F.col("_n").alias("_from"), "_ts", "_lat", "_lon", (F.col("_block") + 1).alias("_at"), F.lit(0).alias("_level")
    )
    found = None
    vessel = dict(fixes.dtypes)["vessel"]
    node = F.call_function("shiftright", F.col("_at"), F.col("_level"))
    may = _may_hold(wait, metres)
    # A node that is passed over leads to the next one, of the level above where that begins there; one that may hold a successor, to its parts.
    after = F.struct(F.call_function("shiftleft", F.col("_node") + 1, F.col("_level")).alias("_at"), (F.col("_level") + F.col("_node") % 2).cast("int").alias("_level"))
    below = F.struct("_at", F.greatest(F.col("_level") - 1, F.lit(0)).alias("_level"))
    while not open_.isEmpty():
        seen = open_.withColumn("_node", node).join(boxes, ["vessel", "_level", "_node"])  # behind the last block there is none
        seen = checkpointed(seen.select(
            "vessel", "_from", "_ts", "_lat", "_lon", (may & (F.col("_level") == 0)).alias("_ready"), F.when(may, below).otherwise(after).alias("s")
        ).select("vessel", "_from", "_ts", "_lat", "_lon", "_ready", "s.*"))
        ready = seen.where("_ready").select("vessel", F.col("_at").alias("_block"), F.lit(None).cast("long").alias("_n"), "_ts", "_lat", "_lon", "_from")
        blocks = fixes.join(ready.select("vessel", "_block").distinct(), ["vessel", "_block"], "left_semi")
        both = ready.unionByName(blocks.select("vessel", "_block", "_n", "_ts", "_lat", "_lon", F.lit(None).cast("long").alias("_from")))
        searched = checkpointed(both.groupBy("vessel", "_block").applyInArrow(
            block_search(wait, metres), f"vessel {vessel}, _from long, _ts long, _lat double, _lon double, _block long, _n long"
        ))
        hits = searched.where("_n >= 0").select("vessel", "_from", F.col("_n").alias("_to"))
        found = hits if found is None else found.union(hits)
        again = searched.where("_n < 0").select("vessel", "_from", "_ts", "_lat", "_lon", (F.col("_block") + 1).alias("_at"), F.lit(0).alias("_level"))
        open_ = checkpointed(seen.where("not _ready").drop("_ready").unionByName(again))
    return found if found is not None else open_.select("vessel", "_from", F.col("_from").alias("_to"))


def _entries(fixes: DataFrame, across: DataFrame) -> DataFrame:
    """(vessel, _enters): the fixes at which the path from each vessel's first fix enters blocks."""
    first = fixes.groupBy("vessel").agg(F.min("_n").alias("_enters"))
    nodes = first.union(across.select("vessel", F.col("_to").alias("_enters"))).distinct()
    leaves = fixes.select("vessel", F.col("_n").alias("_enters"), F.col("_leaves").alias("_from"))
    jumps = checkpointed(nodes.join(leaves, ["vessel", "_enters"]).join(across, ["vessel", "_from"]).select("vessel", F.col("_enters").alias("a"), F.col("_to").alias("b")))
    path = checkpointed(first)
    while not jumps.isEmpty():  # every round doubles the path that is known and the length of a jump
        more = path.join(jumps, (path["vessel"] == jumps["vessel"]) & (path["_enters"] == jumps["a"])).select(path["vessel"], F.col("b").alias("_enters"))
        path = checkpointed(path.union(more))
        ahead = jumps.select(F.col("vessel").alias("v"), F.col("a").alias("m"), F.col("b").alias("c"))
        jumps = checkpointed(jumps.join(ahead, (F.col("vessel") == F.col("v")) & (F.col("b") == F.col("m"))).select("vessel", "a", F.col("c").alias("b")))
    return path


def throttled(fixes: DataFrame, min_seconds: float = MIN_SECONDS, min_metres: float = MIN_METRES, order: list[str] | None = None) -> DataFrame:
    """The fixes (vessel, ts, lat, lon, ...) that tick. order: what fixes of one time go by (default: all other columns)."""
    wait = int(min_seconds * 1_000_000)
    sound = fixes.where(valid_latitude(F.col("lat")) & valid_longitude(F.col("lon")) & F.col("ts").isNotNull())
    ties = [c for c in fixes.columns if c not in ("vessel", "ts")] if order is None else order
    row = F.struct(*(F.col(c) for c in fixes.columns)).alias("_fix")
    keyed = sound.select("vessel", "ts", *ties, row).toDF("vessel", "_t", *(f"_tie{k}" for k in range(len(ties))), "_fix")
    keyed = numbered(keyed, ["_t", *(f"_tie{k}" for k in range(len(ties)))])
    placed = keyed.select(
        "vessel", (F.col("tick") - 1).alias("_n"), F.expr(f"(tick - 1) div {BLOCK}").alias("_block"), F.unix_micros(F.col("_t").cast("timestamp")).alias("_ts"),
        F.col("_fix.lat").cast("double").alias("_lat"), F.col("_fix.lon").cast("double").alias("_lon"), "_fix",
    )
    schema = StructType([*placed.schema.fields, StructField("_next", LongType()), StructField("_leaves", LongType())])
    paths = checkpointed(placed.groupBy("vessel", "_block").applyInArrow(block_paths(wait, min_metres), schema))
    boxes = checkpointed(_boxes(paths))
    entries = _entries(paths, _across(paths, boxes, wait, min_metres))
    entered = paths.join(entries.withColumn("_block", F.expr(f"_enters div {BLOCK}")), ["vessel", "_block"])
    kept = entered.groupBy("vessel", "_block").applyInArrow(on_path, entered.schema)
    return kept.select("_fix.*").select(*fixes.columns)
