"""Alarms over recorded vessel fixes: hysteresis as runs of ticks, and message changes.

ticks: vessel, tick (1, 2, ... in time for each vessel), lat, lon and, for bridges, air_draft.

What is shuffled are ticks and places, never their pairs nor the runs made of them. Both lie in blocks: rows of arrays, of a vessel's ticks of one
stretch (STRETCH of them) around one cell, and of about PLACES places of one cell. A join by cell puts blocks together, and each pair of them is
worked out where it is met and emits what it finds at once. A tick is stored for the nine cells around it and a place DEALS times, however many of
the others are near. Only runs that touch a stretch's ends are shuffled, to be joined with those of the next stretch.

What is found can be far more rows than there are ticks and places. So Python gives a row for each place of a pair of blocks, with an array of what
was found for it, and an explode makes the rows from these. Places of a block are met in parts that lie together and have about one clearance, each
with the ticks that can be in reach of the part.

Defined cases: rows without a vessel are left out where ticks are numbered (as_of keeps them, without a state); a tick or a place without a
position, or with NaN, is near nothing; an id at several places is near where any of them is; rows that tie in order are
numbered in any order, so an order should end in a key; an empty table gives no rows. Columns that are added (tick, stretch,
distance_m, last_*) replace columns of these names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..folders import checkpointed
from ..functions.geo import EARTH_RADIUS_M, band_of, columns_of

RADIUS_M = 500.0
CLEAR_FACTOR = 1.2
#: Ticks of a vessel (at most 2^24), and places of a cell, that a block has, and places of one part of a block.
STRETCH, PLACES, PART = 16384, 2048, 64
#: Tasks that a cell's ticks are dealt to, pairs that are worked out at once, and cells of places that are broadcast to pass ticks far from all.
DEALS, PAIRS, BROADCAST_CELLS = 16, 1 << 18, 1 << 19
#: Bytes of a batch to Python, things found that a batch back has at least where there are as many, and ticks first looked at from a stretch's end.
BATCH_BYTES, FOUND, WINDOW = 4 << 20, 1 << 18, 64
MEETING = ["_band", "_cell", "_deal"]


def numbered(fixes: DataFrame, order: list[str]) -> DataFrame:
    """fixes with `tick`, from 1 for each vessel, and `stretch` (part of a vessel's history); fixes without a vessel are left out.

    Rows are dealt by ranges, so that a vessel's history spreads over tasks; what is counted by vessel is one row for each task.
    """
    known = fixes.where("vessel is not null")
    ordered = known.repartitionByRange("vessel", *order).sortWithinPartitions("vessel", *order)
    ordered = checkpointed(ordered.withColumn("_at", F.monotonically_increasing_id())).withColumn("stretch", F.shiftright("_at", 33))
    sizes = ordered.groupBy("vessel", "stretch").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("vessel").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("vessel", "stretch", (F.col("_first") - F.coalesce(F.sum("_n").over(before), F.lit(0)) - 1).alias("_base"))
    return ordered.join(starts, ["vessel", "stretch"]).withColumn("tick", F.col("_at") - F.col("_base")).drop("_at", "_base")


def filled_forward(ticks: DataFrame, column: str) -> DataFrame:
    """ticks (of numbered) with each null of a column replaced by the vessel's last value before it."""
    within = Window.partitionBy("vessel", "stretch").orderBy("tick")
    last = ticks.groupBy("vessel", "stretch").agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col("tick"))).alias("_last"))
    before = Window.partitionBy("vessel").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("vessel", "stretch", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    filled = ticks.withColumn(column, F.last(column, ignorenulls=True).over(within)).join(carried, ["vessel", "stretch"])
    return filled.withColumn(column, F.coalesce(column, "_carried")).drop("_carried")


def as_of(points: DataFrame, states: DataFrame, columns: list[str], order: list[str] | None = None) -> DataFrame:
    """points (vessel, ts, ...) with the columns of the vessel's latest state (vessel, ts, ...) at or before each; null where there is none.

    Of states at one time the last by `order` (default: columns) counts. A point without a vessel or a time has no state; states without are
    none.
    """
    tie = F.struct(*(F.col(c) for c in (order or columns)))
    known = states.where("ts is not null").select("vessel", "ts", F.lit(0).alias("_kind"), tie.alias("_tie"), F.struct(*(F.col(c) for c in columns)).alias("_state"))
    asked = points.select("vessel", "ts", F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_point"))
    both = numbered(known.unionByName(asked.where("vessel is not null and ts is not null"), allowMissingColumns=True), ["ts", "_kind", "_tie"])
    found = filled_forward(both, "_state").where("_kind = 1").select("_point", "_state")
    alone = asked.where("vessel is null or ts is null").select("_point", F.lit(None).cast(found.schema["_state"].dataType).alias("_state"))
    return found.union(alone).select("_point.*", *(F.col(f"_state.{c}").alias(f"last_{c}") for c in columns))


def scan_radius(alarm_radius_m: float) -> float:
    """How far around the vessel places are looked for."""
    return max(3 * alarm_radius_m, 2000.0)


def within(fixes: DataFrame, places: DataFrame, radius_m: float, columns: list[str] | None = None) -> DataFrame:
    """Pairs of fixes (these columns of them, or all) and places (id, p_lat, p_lon, ...) within radius_m, by cells of that size; the seam is no border."""
    limit_batches(fixes.sparkSession)
    size = math.degrees(radius_m / EARTH_RADIUS_M) * 1.001
    deal = F.pmod(F.xxhash64(*(F.col(c) for c in ("lat", "lon"))), F.lit(DEALS)).cast("int")
    mine = _around(fixes.where("lat is not null and lon is not null").select(F.struct(*fixes.columns).alias("fix"), "lat", "lon"), "lat", "lon", size, (0,))
    mine = _dealt(mine.select("_band", "_cell", deal.alias("_deal"), "fix"))  # so that a batch has few blocks; a stream has no sort
    fix = mine.schema["fix"].dataType
    block = T.StructType([*(mine.schema[c] for c in MEETING), T.StructField("fixes", T.ArrayType(fix))])
    near = _dealt(mine.mapInArrow(packed, block)).join(_dealt(_place_blocks(places, size, (-1, 0, 1))), MEETING).select("fixes", "places")
    columns = fixes.columns if columns is None else columns
    lists = [T.StructField(f"_{k}", T.ArrayType(fix[c].dataType)) for k, c in enumerate(columns)]
    made = T.StructType([*lists, T.StructField("_place", T.StructType(places.schema.fields)), T.StructField("_metres", T.ArrayType(T.DoubleType(), False))])
    found = near.mapInArrow(pair_finder(radius_m, columns), made)
    pairs = found.select(*(x.name for x in lists), "_place", F.posexplode("_metres").alias("_at", "distance_m"))
    return pairs.select(*(F.get(x.name, F.col("_at")).alias(c) for x, c in zip(lists, columns)), "_place.*", "distance_m")


def _dealt(blocks: DataFrame) -> DataFrame:
    """Blocks by where they meet, in as many partitions as shuffles have, four for each core at least: by their bytes, which say little of the pairs,
    they would be put in few."""
    spark = blocks.sparkSession
    return blocks.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *MEETING)


def limit_batches(spark: SparkSession) -> None:
    """Blocks are large rows: batches to Python are bounded by bytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def packed(batches):
    """A mapInArrow function: rows (_band, _cell, _deal, fix) of a batch as one block for each key."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("_band", "_cell", "_deal")]
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        starts = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))
        ends = pa.array(np.append(starts, len(order)).astype(np.int32))
        blocks = pa.ListArray.from_arrays(ends, batch.column("fix").take(pa.array(order)))
        first = pa.array(order[starts])
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(first) for c in ("_band", "_cell", "_deal")), blocks], names=["_band", "_cell", "_deal", "fixes"])


def _place_blocks(places: DataFrame, size: float, steps: tuple[int, ...]) -> DataFrame:
    """(_band, _cell, _deal, places): places (p_lat, p_lon, ...) of a cell in blocks of about PLACES, each once for each deal."""
    put = places.where("p_lat is not null and p_lon is not null").select(F.struct(*places.columns).alias("place"), "p_lat", "p_lon")
    put = _around(put, "p_lat", "p_lon", size, steps)
    sizes = put.groupBy("_band", "_cell").agg(F.ceil(F.count("*") / PLACES).alias("_parts"))
    put = put.join(sizes, ["_band", "_cell"]).withColumn("_part", F.pmod(F.xxhash64("p_lat", "p_lon", F.hash("place")), F.col("_parts")))
    blocks = put.groupBy("_band", "_cell", "_part").agg(F.collect_list("place").alias("places"))
    return blocks.select("_band", "_cell", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("_deal"), "places")


class Distances:
    """Which of some points are within a distance of which others (latitudes and longitudes in degrees; NaN is near nothing).

    Squared chords by a matrix product tell nearly all; those so near the limit that rounding could tell them wrong go by the haversine.
    """

    def __init__(self, lat: np.ndarray, lon: np.ndarray, o_lat: np.ndarray, o_lon: np.ndarray):
        self.mine, self.other = [np.radians(x) for x in (lat, lon)], [np.radians(x) for x in (o_lat, o_lon)]
        sphere = lambda a, b: np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=1)
        u, v = sphere(*self.mine), sphere(*self.other)
        sound = u[~np.isnan(u).any(axis=1)]
        centre = sound[0] if len(sound) else np.zeros(3)
        self.u, self.v = u - centre, (v - centre).T
        self.uu, self.vv = (self.u**2).sum(axis=1), (self.v**2).sum(axis=0)
        spread = [np.nanmax(x) if len(x) and not np.isnan(x).all() else 0.0 for x in (self.uu, self.vv)]
        self.rounding = 1e-14 * (1.0 + math.sqrt(max(spread))) + 1e-15 * sum(spread) / 1e-7

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        (lat, lon), (o_lat, o_lon) = (x[i] for x in self.mine), (x[j] for x in self.other)
        h = np.sin((lat - o_lat) / 2) ** 2 + np.cos(o_lat) * np.cos(lat) * np.sin((lon - o_lon) / 2) ** 2
        return 2 * EARTH_RADIUS_M * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0.0, 1 - h)))

    def chords(self, rows: np.ndarray) -> np.ndarray:
        """Squared chords of the rows and all others."""
        out = self.u[rows] @ self.v
        out *= -2.0
        out += self.uu[rows, None]
        out += self.vv
        return out

    def limits(self, metres: float) -> tuple[float, float]:
        """Squared chords up to which a pair is within so many metres for certain, and over which it is not."""
        chord = 2 * math.sin(min(metres / (2 * EARTH_RADIUS_M), math.pi / 2))
        slack = 1e-9 * chord + self.rounding
        return max(0.0, chord - slack) ** 2 - 1e-300, (chord + slack) ** 2

    def within(self, rows: np.ndarray, chords: np.ndarray, metres: float) -> np.ndarray:
        low, high = self.limits(metres)
        near = chords <= high
        i, j = np.nonzero(near & (chords > low))
        if len(i):
            near[i, j] = self.exact(rows[i], j) <= metres
        return near


class Points:
    """Positions in degrees and on the unit sphere; one with NaN is near nothing."""

    def __init__(self, table, lat: str, lon: str, order: np.ndarray | None = None):
        self.lat, self.lon = (numbers_of(table, name, order) for name in (lat, lon))
        a, b = np.radians(self.lat), np.radians(self.lon)
        self.cos = np.cos(a)
        self.sphere = np.stack([self.cos * np.cos(b), self.cos * np.sin(b), np.sin(a)])

    def metres(self, i: np.ndarray, other: Points, j: np.ndarray) -> np.ndarray:
        """Distances of points i and other points j, pair by pair, by the haversine."""
        up, aside = (a[i] - b[j] for a, b in ((self.lat, other.lat), (self.lon, other.lon)))
        for x in (up, aside):  # squares of half the angles
            x *= x
            x *= (math.pi / 360) ** 2
        if not len(up) or max(up.max(), aside.max()) < 1e-8:  # the series' next terms are under 1e-17 of the first
            for x in (up, aside):
                x -= x * x / 3
        else:
            up, aside = np.sin(np.sqrt(up)) ** 2, np.sin(np.sqrt(aside)) ** 2
        aside *= other.cos[j]
        aside *= self.cos[i]
        up += aside
        if not len(up) or up.max() < 1e-8:
            chord = np.sqrt(up)
            up /= 6
            up += 1
            up *= chord
            up *= 2 * EARTH_RADIUS_M
            return up
        return 2 * EARTH_RADIUS_M * np.arctan2(np.sqrt(up), np.sqrt(np.maximum(0.0, 1 - up)))


def numbers_of(table, name: str, order: np.ndarray | None = None) -> np.ndarray:
    found = table.field(name).to_numpy(zero_copy_only=False).astype(np.float64)
    return found if order is None else found[order]


def _chord(metres: float) -> float:
    return 2 * math.sin(min(metres / (2 * EARTH_RADIUS_M), math.pi / 2))


class Part:
    """Some places and those of other points that can be within some metres of one of them (and have an enough level)."""

    def __init__(self, places: Points, rows: np.ndarray, points: Points, metres: float, enough: np.ndarray | None = None):
        self.places, self.points = places, points
        mine = places.sphere[:, rows]
        centre = mine.mean(axis=1, keepdims=True)
        mine, other = mine - centre, points.sphere - centre
        squares, others = (mine**2).sum(axis=0), np.einsum("ij,ij->j", other, other)
        near = others <= ((_chord(metres) + math.sqrt(squares.max())) * (1 + 1e-9) + 1e-15) ** 2
        self.kept = np.flatnonzero(near if enough is None else near & enough)
        self.rows, others = rows, others[self.kept]
        self.left = np.vstack([-2 * mine, squares, np.ones(len(rows))]).T.astype(np.float32)
        self.right = np.vstack([other[:, self.kept], np.ones(len(self.kept)), others]).astype(np.float32)
        widest = math.sqrt(squares.max()) + math.sqrt(others.max(initial=0.0))
        self.off = 16 * float(np.finfo(np.float32).eps) * widest**2 + 1e-15 * widest

    def steps(self):
        """Parts of the rows, and squared chords (in single precision, wrong by `off` at most) between these and the points that are kept."""
        step = max(1, PAIRS // max(1, len(self.kept)))
        for a in range(0, len(self.rows) if len(self.kept) else 0, step):
            yield self.rows[a : a + step], self.left[a : a + step] @ self.right

    def maybe(self, squares: np.ndarray, metres: float) -> np.ndarray:
        return squares <= _chord(metres) ** 2 * (1 + 1e-6) + self.off

    def within(self, rows: np.ndarray, squares: np.ndarray, metres: float) -> np.ndarray:
        """Whether they are within so many metres: those that rounding could tell wrong go by the haversine."""
        near = self.maybe(squares, metres)
        sure = squares <= _chord(metres) ** 2 * (1 - 1e-6) - self.off
        if np.count_nonzero(near) != np.count_nonzero(sure):
            open_ = np.flatnonzero(near ^ sure)
            i, j = np.divmod(open_, near.shape[1])
            near.ravel()[open_] = self.places.metres(rows[i], self.points, self.kept[j]) <= metres
        return near


def parts_of(rows: np.ndarray, keys: list[np.ndarray], number: int) -> list[np.ndarray]:
    """rows in about so many parts of one size, whose keys are near one another."""
    if number <= 1 or not keys:
        return np.array_split(rows, max(1, number))
    pieces = max(1, round(number ** (1 / len(keys))))
    ordered = rows[np.argsort(keys[0][rows], kind="stable")]
    return [part for piece in np.array_split(ordered, pieces) for part in parts_of(piece, keys[1:], -(-number // pieces))]


def list_of(counts: np.ndarray, values) -> pa.ListArray:
    """Lists of so many values each; numbers of an array are never null."""
    ends, known = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), not isinstance(values, pa.Array)
    values = pa.array(values) if known else values
    return pa.ListArray.from_arrays(ends, values, type=pa.list_(pa.field("element", values.type, nullable=not known)))


def by_place(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (equal ones one after another) once each, and how often they are there."""
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return place[starts], np.diff(np.append(starts, len(place)))


def gathered(rows, size):
    """Lists of rows with FOUND things or more between them; the last one may have fewer."""
    some, number = [], 0
    for row in rows:
        some.append(row)
        number += size(row)
        if number >= FOUND:
            yield some
            some, number = [], 0
    if some:
        yield some


def pair_finder(radius_m: float, columns: list[str]):
    """A mapInArrow function over blocks (fixes, places): for each place the fixes within the radius, as a list of each column, and their metres."""

    def pairs(fixes, places):
        here, there = Points(fixes, "lat", "lon"), Points(places, "p_lat", "p_lon")
        sound = np.flatnonzero(~np.isnan(there.sphere).any(axis=0))
        for rows in parts_of(sound, [there.lat, there.lon], -(-len(sound) // PART)) if len(sound) else ():
            part = Part(there, rows, here, radius_m)
            for rows, squares in part.steps():
                near = part.maybe(squares, radius_m)
                counts = np.count_nonzero(near, axis=1)
                i = np.repeat(np.arange(len(rows)), counts)
                j = part.kept[np.flatnonzero(near) - i * near.shape[1]]
                i = rows[i]
                metres = there.metres(i, here, j)
                if len(metres) and metres.max() > radius_m:
                    in_range = np.flatnonzero(metres <= radius_m)
                    i, j, metres = i[in_range], j[in_range], metres[in_range]
                if len(i):
                    yield i, j, metres

    def find(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                fixes, places = (batch.column(c)[k].values for c in ("fixes", "places"))
                lists = [fixes.field(c) for c in columns]
                for some in gathered(pairs(fixes, places), lambda row: len(row[0])):
                    i, j, metres = (np.concatenate(x) for x in zip(*some))
                    place, counts = by_place(i)
                    j = pa.array(j)
                    made = [*(list_of(counts, x.take(j)) for x in lists), places.take(pa.array(place)), list_of(counts, metres)]
                    yield pa.RecordBatch.from_arrays(made, names=[*(f"_{k}" for k in range(len(columns))), "_place", "_metres"])

    return find


def _around(table: DataFrame, lat: str, lon: str, size: float, steps: tuple[int, ...]) -> DataFrame:
    """table once for each cell (_band, _cell) of its own and so many steps off."""
    offsets = F.array(*map(F.lit, steps))
    rows = table.withColumn("_band", F.explode(F.transform(offsets, lambda d: band_of(F.col(lat), size) + d)))
    rows = rows.withColumn("_n", columns_of(F.col("_band"), size))
    own = F.floor((F.col(lon) + 180.0) / 360.0 * F.col("_n")).cast("long")
    return rows.withColumn("_cell", F.explode(F.array_distinct(F.transform(offsets, lambda d: F.pmod(own + d, F.col("_n")))))).drop("_n")


class Runs:
    """Runs of a vessel's ticks in reach of a place, over blocks (vessel, start, end, ticks, places); ticks are counted from the stretch's start.

    A run: its place, first and last tick, and the first tick within the radius, or -1. With a margin, ticks whose air draft doesn't reach a place's
    clearance less the margin are none of its run.
    """

    def __init__(self, radius_m: float, reach_m: float, margin_m: float | None):
        self.radius_m, self.reach_m, self.margin_m = radius_m, reach_m, margin_m
        self.key = self.held = None

    def ticks(self, key, start: int, ticks):
        """(tick, points, level or None) in order of ticks; blocks of the same ticks come one after another, so the last ones are held."""
        if key != self.key:
            tick = (ticks.field("tick").to_numpy(zero_copy_only=False) - start).astype(np.int32)
            order = np.argsort(tick, kind="stable")
            level = None if self.margin_m is None else numbers_of(ticks, "level", order) + self.margin_m
            self.key, self.held = key, (tick[order], Points(ticks, "lat", "lon", order), level)
        return self.held

    def places(self, places, level):
        """(points, clearance or None, those that can be in a run)."""
        there = Points(places, "p_lat", "p_lon")
        low = None if level is None else numbers_of(places, "level")
        sound = ~np.isnan(there.sphere).any(axis=0)
        if level is not None:
            sound &= low <= np.nanmax(level, initial=-np.inf)
        return there, low, sound

    def of(self, held, there: Points, low, rows: np.ndarray, span: np.ndarray | None = None):
        """(place, first, last, raised) as arrays, for some of the places (rows) at a time; span: of these ticks only."""
        tick, here, level = held
        keys = [there.lat, there.lon] if low is None else [low, there.lat, there.lon]
        for rows in parts_of(rows, keys, -(-len(rows) // PART)) if len(rows) else ():
            enough = span if low is None else level >= low[rows].min()
            if low is not None and span is not None:
                enough &= span
            part = Part(there, rows, here, self.reach_m, enough)
            at = tick[part.kept]
            follows = at[1:] == at[:-1] + 1
            for rows, squares in part.steps():
                near = part.within(rows, squares, self.reach_m)
                close = part.within(rows, squares, self.radius_m)
                if low is not None:
                    near &= low[rows, None] <= level[part.kept]
                    close &= near
                goes_on = near[:, 1:] & near[:, :-1]
                goes_on &= follows
                starts, ends = near.copy(), near
                starts[:, 1:] ^= goes_on
                ends[:, :-1] ^= goes_on
                row = np.repeat(np.arange(len(rows)), np.count_nonzero(starts, axis=1))
                start, end, close = np.flatnonzero(starts), np.flatnonzero(ends), close.ravel()
                before = row * len(at)
                raised = at[start - before]
                first, last = raised.copy(), at[end - before]
                late = np.flatnonzero(~close[start])  # not within the radius at first
                raised[late] = -1
                late = late[end[late] > start[late]]
                if len(late):
                    hits = np.append(np.flatnonzero(close), near.size)
                    hit = hits[np.searchsorted(hits, start[late])]
                    ever = hit <= end[late]
                    late = late[ever]
                    raised[late] = at[hit[ever] - before[late]]
                yield rows[row], first, last, raised


def run_finder(runs: Runs, turns: bool):
    """A mapInArrow function over blocks: (vessel, start, id, found) for each place, of runs that raise and are whole; those at a stretch's ends or of
    ids at several places are none.

    found: for each run the ticks at which it is raised (times 2^32) and cleared (0: it still holds); with turns, twice each of these ticks, and 1 more
    where it is cleared.
    """
    whole = STRETCH - 1

    def turned(raised, last, end, counts):
        codes = np.empty((len(raised), 2), dtype=np.int32)
        codes[:, 0], codes[:, 1] = raised << 1, (last + 1) << 1 | 1
        if len(last) and last.max() < end:
            return 2 * counts, codes.ravel()
        told = np.stack([np.full(len(last), True), last < end], axis=1)
        return np.add.reduceat(told.sum(axis=1), np.cumsum(counts) - counts), codes[told]

    def rows(batch):
        keys = [batch.column(c).to_pylist() for c in ("vessel", "start", "end", "_band", "_cell")]
        for k, key in enumerate(zip(*keys)):
            start, end, places = key[1], key[2] - key[1], batch.column("places")[k].values
            held = runs.ticks(key, start, batch.column("ticks")[k].values)
            there, low, sound = runs.places(places, held[2])
            twice, ids = places.field("twice").to_numpy(zero_copy_only=False), places.field("id")
            for place, first, last, raised in runs.of(held, there, low, np.flatnonzero(sound & ~twice)):
                keep = (first > 0) & (last < whole) & (raised >= 0)
                if np.count_nonzero(keep) < len(keep):
                    place, last, raised = place[keep], last[keep], raised[keep]
                if len(place):
                    used, counts = by_place(place)
                    counts, codes = turned(raised, last, end, counts) if turns else (counts, raised.astype(np.int64) << 32 | np.where(last < end, last + 1, 0))
                    yield np.full(len(used), k), np.full(len(used), start), ids.take(pa.array(used)), counts, codes

    def find(batches):
        for batch in batches:
            for some in gathered(rows(batch), lambda row: len(row[4])):
                numbers, starts, ids, counts, codes = zip(*some)
                vessel = batch.column("vessel").take(pa.array(np.concatenate(numbers)))
                made = [vessel, pa.array(np.concatenate(starts)), pa.concat_arrays(ids), list_of(np.concatenate(counts), np.concatenate(codes))]
                yield pa.RecordBatch.from_arrays(made, names=["vessel", "start", "id", "found"])

    return find


def cut_finder(runs: Runs):
    """A mapInArrow function over blocks: (vessel, id, first, last, raised, end) of runs that touch an end of their stretch or are of an id at several places.

    Only places in reach at an end are looked at, over few ticks next to it at first, over more where the run has no end in them.
    """
    stretch = STRETCH

    def at_end(held, there, low, rows, tick: int, back: bool):
        """Runs that have this tick, at an end of the stretch."""
        window = WINDOW
        while len(rows):
            span = held[0] > tick - window if back else held[0] < tick + window
            longer = [rows[:0]]
            for place, first, last, raised in runs.of(held, there, low, rows, span):
                mine = np.flatnonzero(last == tick if back else first == tick)
                place, first, last, raised = (x[mine] for x in (place, first, last, raised))
                goes_on = (first <= tick - window + 1 if back else last >= tick + window - 1) & (window < stretch)
                longer.append(place[goes_on])
                yield tuple(x[~goes_on] for x in (place, first, last, raised))
            rows, window = np.concatenate(longer), window * 16

    def found(held, there, low, sound, twice):
        tick = held[0]
        yield from runs.of(held, there, low, np.flatnonzero(sound & twice))
        sound = np.flatnonzero(sound & ~twice)
        for k, edge, back in ((0, 0, False), (-1, stretch - 1, True)):
            if len(tick) and tick[k] == edge and len(sound):
                point = held[1].sphere[:, k]
                near = ((there.sphere[:, sound] - point[:, None]) ** 2).sum(axis=0) <= (_chord(runs.reach_m) * (1 + 1e-9) + 1e-15) ** 2
                if low is not None:
                    near &= low[sound] <= held[2][k]
                yield from at_end(held, there, low, sound[near], edge, back)

    def find(batches):
        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in ("vessel", "start", "end", "_band", "_cell")]
            for k, key in enumerate(zip(*keys)):
                start, end, places = key[1], key[2], batch.column("places")[k].values
                held = runs.ticks(key, start, batch.column("ticks")[k].values)
                there, low, sound = runs.places(places, held[2])
                some = list(found(held, there, low, sound, places.field("twice").to_numpy(zero_copy_only=False)))
                if number := sum(len(x[0]) for x in some):
                    place, first, last, raised = (np.concatenate(x).astype(np.int64) for x in zip(*some))
                    vessel = batch.column("vessel").take(pa.array(np.full(number, k)))
                    raised = pa.array(raised + start, mask=raised < 0)
                    columns = [vessel, places.field("id").take(pa.array(place)), pa.array(first + start), pa.array(last + start), raised, pa.array(np.full(number, end))]
                    yield pa.RecordBatch.from_arrays(columns, names=["vessel", "id", "first", "last", "raised", "end"])

    return find


def _runs(ticks: DataFrame, places: DataFrame, radius_m: float, margin_m: float | None, turns: bool) -> tuple[DataFrame, DataFrame]:
    """What run_finder finds, and (vessel, id, raised, cleared) of the runs that are cut by a stretch's end or of an id at several places.

    Blocks are met twice: for the runs that are whole, which are not stored, and for the few that go on in another stretch.
    """
    limit_batches(ticks.sparkSession)
    reach = radius_m * CLEAR_FACTOR
    size = math.degrees(reach / EARTH_RADIUS_M) * 1.001
    level = lambda name: (F.lit(None) if margin_m is None else F.col(name)).cast("double").alias("level")
    twice = (F.count("*").over(Window.partitionBy("id")) > 1).alias("twice")  # runs of an id at several places may overlap
    put = places.select(F.col("id").cast("string").alias("id"), "p_lat", "p_lon", level("clearance_m"))
    there = checkpointed(_dealt(_place_blocks(put.select("*", twice), size, (0,))))
    seen = ticks.where("lat is not null and lon is not null").select("vessel", F.col("tick").cast("long").alias("tick"), "lat", "lon", level("air_draft"))
    seen = seen.withColumn("_stretch", F.floor(F.col("tick") / STRETCH).cast("long"))
    ends = ticks.groupBy("vessel", F.floor(F.col("tick") / STRETCH).cast("long").alias("_stretch")).agg(F.max("tick").cast("long").alias("end"))
    ends = ends.withColumn("end", F.max("end").over(Window.partitionBy("vessel")))  # a row for each stretch
    seen = _around(seen.join(ends, ["vessel", "_stretch"]), "lat", "lon", size, (-1, 0, 1))
    cells = there.select("_band", "_cell").distinct()
    if cells.count() <= BROADCAST_CELLS:
        seen = seen.join(F.broadcast(cells), ["_band", "_cell"], "left_semi")
    mine = seen.groupBy("vessel", "_stretch", "end", "_band", "_cell").agg(F.collect_list(F.struct("tick", "lat", "lon", "level")).alias("ticks"))
    deal = F.pmod(F.xxhash64("vessel", "_stretch"), F.lit(DEALS)).cast("int")
    start = (F.col("_stretch") * STRETCH).alias("start")
    mine = checkpointed(_dealt(mine.select("vessel", start, "end", "_band", "_cell", deal.alias("_deal"), "ticks")))
    blocks = mine.join(there, MEETING).select("vessel", "start", "end", "_band", "_cell", "ticks", "places")
    vessel = dict(ticks.dtypes)["vessel"]
    runs = Runs(radius_m, reach, margin_m)
    made = T.StructType.fromDDL(f"vessel {vessel}, start long, id string").add("found", T.ArrayType(T.IntegerType() if turns else T.LongType(), False))
    whole = blocks.mapInArrow(run_finder(runs, turns), made)
    cut = blocks.mapInArrow(cut_finder(runs), f"vessel {vessel}, id string, first long, last long, raised long, end long")
    by_pair = Window.partitionBy("vessel", "id").orderBy("first")
    upto = F.max("last").over(by_pair.rowsBetween(Window.unboundedPreceding, -1))
    cut = cut.withColumn("fresh", F.coalesce(F.col("first") > upto + 1, F.lit(True)))
    cut = cut.withColumn("run", F.sum(F.col("fresh").cast("long")).over(by_pair))
    joined = cut.groupBy("vessel", "id", "run").agg(F.max("last").alias("last"), F.min("raised").alias("raised"), F.max("end").alias("end"))
    joined = joined.where("raised is not null")
    return whole, joined.select("vessel", "id", "raised", F.when(F.col("last") < F.col("end"), F.col("last") + 1).alias("cleared"))


def episodes(ticks: DataFrame, places: DataFrame, radius_m: float, margin_m: float | None = None) -> DataFrame:
    """(vessel, id, raised, cleared): from the tick at which a place comes within the radius to that at which it is over 1.2 radii
    or gone; null for those that still hold.

    places: id, p_lat, p_lon and, with a margin, clearance_m; ticks then have air_draft. A place in reach at ticks that follow one
    another is a run; a run raises at its first tick within the radius and clears at the tick after its end, if there is one.
    """
    whole, cut = _runs(ticks, places, radius_m, margin_m, False)
    found = whole.select("vessel", "start", "id", F.explode("found").alias("_run"))
    raised, cleared = F.shiftright("_run", 32), F.col("_run").bitwiseAND(F.lit((1 << 32) - 1))
    cleared = F.when(cleared > 0, F.col("start") + cleared)
    return found.select("vessel", "id", (F.col("start") + raised).alias("raised"), cleared.alias("cleared")).union(cut)


def transitions(ticks: DataFrame, places: DataFrame, radius_m: float, margin_m: float | None = None) -> DataFrame:
    """(vessel, id, tick, event): what is raised and what is cleared at which tick of the episodes."""
    whole, cut = _runs(ticks, places, radius_m, margin_m, True)
    found = whole.select("vessel", "start", "id", F.explode("found").alias("_turn"))
    event = F.when(F.col("_turn").bitwiseAND(F.lit(1)) == 1, "clear").otherwise("raise")
    found = found.select("vessel", "id", (F.col("start") + F.shiftright("_turn", 1)).alias("tick"), event.alias("event"))
    one = lambda column, event: F.struct(F.col(column).alias("tick"), F.lit(event).alias("event"))
    turns = cut.select("vessel", "id", F.explode(F.array(one("raised", "raise"), one("cleared", "clear"))).alias("e"))
    return found.union(turns.select("vessel", "id", "e.tick", "e.event").where("tick is not null"))


def proximity(ticks: DataFrame, poi: DataFrame, radius_m: float = RADIUS_M) -> DataFrame:
    hazards = poi.where("type = 'Hazard'").select("id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    return transitions(ticks, hazards, radius_m)


def bridges(ticks: DataFrame, poi: DataFrame, margin_m: float, radius_m: float = RADIUS_M) -> DataFrame:
    """Alarms of bridges that block the vessel (clearance at most air draft and margin); without an air draft none holds."""
    low = poi.where("type = 'Bridge' and clearance_m is not null").select(
        "id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), "clearance_m"
    )
    drafts = ticks.withColumn("lat", F.when(F.col("air_draft").isNotNull(), F.col("lat")))
    return transitions(drafts, low, radius_m, margin_m)


def message_changes(messages: DataFrame) -> DataFrame:
    """(vessel, id, tick, message) rows that are told: the first of a run of ticks, and those whose text changes."""
    by_pair = Window.partitionBy("vessel", "id").orderBy("tick")
    before, tick = F.lag("message").over(by_pair), F.lag("tick").over(by_pair)
    told = F.coalesce((tick != F.col("tick") - 1) | (before != F.col("message")), F.lit(True))
    return messages.withColumn("told", told).where("told").drop("told")


def cleared(active: DataFrame, current: DataFrame) -> DataFrame:
    """Active alarms (vessel, id) that the current tick no longer has."""
    return active.join(current, ["vessel", "id"], "left_anti")
