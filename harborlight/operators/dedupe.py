"""Merging of points of interest that several sources, or one source twice, report for one feature."""

from __future__ import annotations

import dataclasses
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..folders import checkpointed
from ..functions.geo import EARTH_RADIUS_M, grid_cells, haversine_m
from .alarms import PAIRS, Distances, limit_batches

BASE_SOURCE = "activecaptain"
DEFAULT_RADIUS_M = 45.72
#: Cells of a block on a side, and edges of it that a task settles at once.
BLOCK_CELLS, BLOCK_EDGES = 16, 1 << 17
#: Rows of a cell that a block has where rows meet base rows.
BLOCK_ROWS = 4096


@dataclasses.dataclass(frozen=True)
class Radii:
    """Match radius by source; a source without one has the default, none is under a metre."""

    by_source: dict[str, float] = dataclasses.field(default_factory=dict)
    default: float = DEFAULT_RADIUS_M

    def column(self, source: Column) -> Column:
        out = F.lit(float(self.default))
        for name, radius in self.by_source.items():
            out = F.when(source == name, F.lit(float(radius))).otherwise(out)
        return F.greatest(F.lit(1.0), out)

    @property
    def cell(self) -> float:
        return max([1.0, DEFAULT_RADIUS_M, self.default, *self.by_source.values()])


def with_cells(poi: DataFrame, radii: Radii) -> DataFrame:
    """poi with cx, cy: cells of the largest radius; the longitude scale is that of the mean latitude of all rows."""
    mean = poi.agg(F.avg("lat").alias("_mean"))
    cx, cy = grid_cells(F.col("lat"), F.col("lon"), F.col("_mean"), radii.cell)
    return poi.crossJoin(F.broadcast(mean)).withColumns({"cx": cx, "cy": cy}).drop("_mean")  # one row


def _around(poi: DataFrame) -> DataFrame:
    """Each row once for each of the nine cells around it (px, py)."""
    steps = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)]
    near = poi.withColumn("_step", F.explode(F.array(*steps)))
    return near.withColumns({"px": F.col("cx") + F.col("_step.x"), "py": F.col("cy") + F.col("_step.y")}).drop("_step")


def first_finder(batches):
    """A mapInArrow function over blocks (px, py, rows, bases): for each row the first base row in range, if there is one.

    Rows that can't reach the bases' box are passed over, and a row is done at its first hit: bases are tried by seq, a few at first, then more.
    """
    number = lambda table, name: table.field(name).to_numpy(zero_copy_only=False)
    for batch in batches:
        for k in range(batch.num_rows):
            rows, bases = batch.column("rows")[k].values, batch.column("bases")[k].values
            order = np.argsort(number(bases, "seq"), kind="stable")
            base = number(bases, "seq")[order]
            b_lat, b_lon = (number(bases, n)[order] for n in ("lat", "lon"))
            lat, lon, radius = (number(rows, n) for n in ("lat", "lon", "radius"))
            first = np.full(len(lat), len(base))
            for metres in np.unique(radius):
                left = np.flatnonzero((radius == metres) & reaches(lat, lon, b_lat, b_lon, metres))
                at, take = 0, 16
                while len(left) and at < len(base):
                    part = slice(at, at + max(1, min(take, PAIRS // len(left))))
                    apart = Distances(lat[left], lon[left], b_lat[part], b_lon[part])
                    every = np.arange(len(left))
                    near = apart.within(every, apart.chords(every), metres)
                    hit = near.any(axis=1)
                    first[left[hit]] = at + near[hit].argmax(axis=1)
                    left, at, take = left[~hit], min(part.stop, len(base)), take * 2
            found = np.flatnonzero(first < len(base))
            if len(found):
                cell = [pa.array(np.full(len(found), batch.column(c)[k].as_py(), np.int64)) for c in ("px", "py")]
                seq = pa.array(number(rows, "seq")[found])
                yield pa.RecordBatch.from_arrays([seq, *cell, pa.array(base[first[found]])], names=["seq", "px", "py", "base_seq"])


def reaches(lat: np.ndarray, lon: np.ndarray, b_lat: np.ndarray, b_lon: np.ndarray, metres: float) -> np.ndarray:
    """Whether a point may be within so many metres of one in the box around others: never false for one that is."""
    beyond = lambda x, low, high: np.radians(np.maximum(0.0, np.maximum(low - x, x - high)))
    up, aside = beyond(lat, b_lat.min(), b_lat.max()), beyond(lon, b_lon.min(), b_lon.max())
    narrow = np.sqrt(np.clip(np.cos(np.radians(lat)), 0, 1) * max(0.0, np.cos(np.radians(b_lat)).min()))
    far = np.radians(max(lon.max(), b_lon.max()) - min(lon.min(), b_lon.min())) >= np.pi
    least = np.maximum(np.sin(np.minimum(up, np.pi) / 2), 0.0 if far else narrow * np.sin(aside / 2))
    return least <= np.sin(min(metres / (2 * EARTH_RADIUS_M), np.pi / 2)) * (1 + 1e-9) + 1e-15


def _blocks(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(type, cx, cy, name): rows of a cell in blocks of about BLOCK_ROWS, as arrays of columns."""
    key = ["type", "cx", "cy"]
    sizes = rows.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("_parts"))
    dealt = rows.join(sizes, key).withColumn("_part", F.pmod(F.xxhash64("seq"), F.col("_parts")))
    return dealt.groupBy(*key, "_part").agg(F.collect_list(F.struct(*columns)).alias(name)).drop("_part")


def base_matches(cells: DataFrame, sources: list[str], radii: Radii) -> DataFrame:
    """(seq, base_seq) for rows of the sources that meet a base row: the first in cell order, then input order.

    Rows and base rows meet as blocks of their cells, so that pairs are neither shuffled nor sorted: a row gives one base row at most for each block.
    """
    limit_batches(cells.sparkSession)
    placed = cells.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    base = _blocks(placed.where(F.col("source") == BASE_SOURCE), ["seq", "lat", "lon"], "bases").withColumnsRenamed({"cx": "px", "cy": "py"})
    probes = placed.where(F.col("source").isin(*sources) & (F.col("source") != BASE_SOURCE)).withColumn("radius", radii.column(F.col("source")))
    probes = _around(_blocks(probes, ["seq", "lat", "lon", "radius"], "rows"))
    # By their bytes blocks would be put in few partitions; these are as many as shuffles have.
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda blocks: blocks.repartition(parts, "type", "px", "py")
    met = deal(probes.drop("cx", "cy")).join(deal(base), ["type", "px", "py"]).select("px", "py", "rows", "bases")
    near = met.mapInArrow(first_finder, "seq long, px long, py long, base_seq long")
    return near.groupBy("seq").agg(F.min(F.struct("px", "py", "base_seq")).alias("m")).select("seq", "m.base_seq")


def same_source_links(cells: DataFrame, sources: list[str], radii: Radii) -> DataFrame:
    """(seq, earlier, px, py, block): pairs of a source's rows in range, the earlier one with its cell, the later one with its block of cells."""
    mine = cells.where(F.col("source").isin(*sources)).select("seq", "source", "type", "lat", "lon", "cx", "cy")
    other = mine.select(
        "source", "type", F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("seq").alias("earlier"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")
    )
    near = _around(mine).join(other, ["source", "type", "px", "py"]).where("earlier < seq")
    near = near.where(haversine_m(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon")) <= radii.column(F.col("source")))
    block = F.xxhash64("source", "type", F.floor(F.col("cx") / BLOCK_CELLS), F.floor(F.col("cy") / BLOCK_CELLS))
    return near.select("seq", "earlier", "px", "py", block.alias("block"))


def settle_block(key, table):
    """An applyInArrow function over edges (seq, earlier, root): what they alone settle, in input order.

    kept: whether the later row is kept, null where that isn't known; open: whether the edge still matters.
    """
    table = table.sort_by([("seq", "ascending"), ("earlier", "ascending")])
    seq, earlier, root = (np.asarray(table.column(c)) for c in ("seq", "earlier", "root"))
    state: dict[int, bool | None] = {}
    bounds = [0, *(np.flatnonzero(seq[1:] != seq[:-1]) + 1).tolist(), len(seq)]
    kept, open_ = [], np.zeros(len(seq), bool)
    for a, b in zip(bounds, bounds[1:]):
        known = [True if root[k] else state.get(int(earlier[k])) for k in range(a, b)]
        verdict = False if True in known else None if None in known else True
        state[int(seq[a])] = verdict
        kept += [verdict] * (b - a)
        if verdict is None:
            open_[a:b] = [k is None for k in known]
    return pa.table({"seq": seq, "earlier": earlier, "kept": pa.array(kept, pa.bool_()), "open": open_})


def greedy_dropped(links: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """seq of rows that a loop in input order drops: those in range of an earlier row that was kept. links: seq, earlier and, where known, block.

    First the rows of a block (of any dealing that keeps a row's edges together) are settled as far as its own edges tell; a block of very many edges is
    dealt by row. Then, in rounds, a row is settled if all its earlier neighbours are: dropped if one of them is kept, else kept.
    A round looks at open edges only (those of rows not settled, to rows not settled before it), which get fewer from round to
    round. The rounds follow the longest chain of neighbours across blocks in input order, not the number of rows.
    """
    block = F.col("block") if "block" in links.columns else F.lit(0).cast("long")
    edges = checkpointed(links.select("seq", "earlier", block.alias("block")).distinct())
    # Rows that are nobody's later neighbour are kept from the start.
    roots = edges.select("earlier").distinct().join(edges.select(F.col("seq").alias("earlier")), "earlier", "left_anti").withColumn("root", F.lit(True))
    sizes = edges.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_EDGES).alias("parts"))
    dealt = edges.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("seq"), F.col("parts")))
    dealt = dealt.join(roots, "earlier", "left").select("block", "part", "seq", "earlier", F.coalesce("root", F.lit(False)).alias("root"))
    first = checkpointed(dealt.groupBy("block", "part").applyInArrow(settle_block, "seq long, earlier long, kept boolean, open boolean"))
    fresh = first.where("kept is not null").select(F.col("seq").alias("node"), "kept").distinct()
    settled: list[DataFrame] = [fresh.where("not kept").select(F.col("node").alias("seq"))]
    edges = first.where("open").select("seq", "earlier")
    for _ in range(most_rounds):
        if edges.isEmpty():
            return reduce(DataFrame.union, settled)
        known = edges.join(fresh.withColumnRenamed("node", "earlier"), "earlier", "left")
        marks = known.withColumn("state", F.when(F.col("kept"), 2).when(~F.col("kept"), 0).otherwise(1))
        # A row's state: 2 near a kept one, 1 waiting, 0 all its earlier neighbours are dropped.
        state = marks.groupBy("seq").agg(F.max("state").alias("worst"))
        marks = checkpointed(marks.join(state, "seq").select("seq", "earlier", "state", "worst"))
        fresh = marks.where("worst <> 1").select(F.col("seq").alias("node"), (F.col("worst") == 0).alias("kept")).distinct()
        edges = marks.where("worst = 1 and state = 1").select("seq", "earlier")
        settled.append(fresh.where("not kept").select(F.col("node").alias("seq")))
        if len(settled) > 20:
            settled = [checkpointed(reduce(DataFrame.union, settled))]
    raise RuntimeError("greedy_dropped did not settle")


def merged(poi: DataFrame, sources: list[str], radii: Radii | None = None) -> DataFrame:
    """poi after both passes, with `sources` (null where dedupe is off), joined attributions and least clearances.

    poi: seq, id, source, type, lat, lon, attribution, clearance_m and more. Order by (not base, seq) is the output order.
    """
    radii = radii or Radii()
    if not sources:
        return poi.withColumn("sources", F.lit(None).cast("array<string>"))
    cells = with_cells(poi, radii)
    matches = checkpointed(base_matches(cells, sources, radii))
    folded = (
        matches.join(poi.select("seq", "source", "attribution", "clearance_m"), "seq")
        .groupBy("base_seq", "source")
        .agg(F.min(F.struct("seq", "attribution")).alias("first"), F.min("clearance_m").alias("low"))
        .groupBy("base_seq")
        .agg(F.array_sort(F.collect_list(F.struct("first.seq", "source", "first.attribution"))).alias("found"), F.min("low").alias("low"))
    )  # one row for each source that a base row has
    is_base = F.col("source") == BASE_SOURCE
    base = poi.where(is_base).join(folded.withColumnRenamed("base_seq", "seq"), "seq", "left")
    found = F.coalesce("found", F.expr("array()").cast("array<struct<seq:bigint,source:string,attribution:string>>"))
    base = base.withColumns({
        "sources": F.array_distinct(F.concat(F.array("source"), found["source"])),
        "attribution": F.array_join(F.array_distinct(F.concat(F.array("attribution"), found["attribution"])), "; "),
        "clearance_m": F.least("clearance_m", "low"),
    }).drop("found", "low")
    left = cells.where(~is_base).join(matches, "seq", "left_anti")
    links = checkpointed(same_source_links(left, sources, radii))
    dropped = greedy_dropped(links)
    into = (
        links.join(dropped, "seq", "left_semi").join(dropped.select(F.col("seq").alias("earlier")), "earlier", "left_anti")
        .groupBy("seq").agg(F.min(F.struct("px", "py", "earlier")).alias("m"))
        .join(left.select("seq", "clearance_m"), "seq").groupBy(F.col("m.earlier").alias("seq")).agg(F.min("clearance_m").alias("low"))
    )
    rest = left.join(dropped, "seq", "left_anti").join(into, "seq", "left")
    rest = rest.withColumns({
        "sources": F.when(F.col("source").isin(*sources), F.array("source")), "clearance_m": F.least("clearance_m", "low"),
    }).drop("low", "cx", "cy")
    return base.unionByName(rest)
