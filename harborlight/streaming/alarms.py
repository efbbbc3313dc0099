"""The alarms as continuous queries: state is kept for each vessel, and places are read as a static table.

Fixes arrive as (vessel, ts, lat, lon). The throttle holds the last fix that ticked; the alarm operator holds, for each
vessel, the places that are alarming and since when. Their state stays as long as the query runs, as a vessel's next fix,
however late, is compared with its last one. The alarms of bridges and routes hold state from two inputs, and end it by timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

from ..boxes import distance
from ..operators.alarms import CLEAR_FACTOR, RADIUS_M
from ..operators.throttle import MIN_METRES, MIN_SECONDS

TICK = StructType([
    StructField("vessel", LongType()), StructField("ts", TimestampType()), StructField("lat", DoubleType()), StructField("lon", DoubleType()),
])
NOTIFICATION = StructType([
    StructField("vessel", LongType()), StructField("id", StringType()), StructField("ts", TimestampType()), StructField("event", StringType()),
    StructField("since", TimestampType()),
])


class Throttle(StatefulProcessor):
    """Passes a vessel's first fix, then each that is late and far enough from the last that passed."""

    def __init__(self, min_seconds: float = MIN_SECONDS, min_metres: float = MIN_METRES):
        self._seconds, self._metres = min_seconds, min_metres

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", StructType(TICK.fields[1:]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fixes = pd.concat(list(rows)).sort_values("ts")
        last = self._last.get() if self._last.exists() else None
        out = []
        for ts, lat, lon in zip(fixes["ts"], fixes["lat"], fixes["lon"]):
            far = last is None or (
                (ts - pd.Timestamp(last[0])).total_seconds() >= self._seconds and distance((last[1], last[2]), (lat, lon)) >= self._metres
            )
            if far:
                last = (ts.to_pydatetime(), lat, lon)
                out.append((key[0], ts, lat, lon))
        if out:
            self._last.update(last)
        yield pd.DataFrame(out, columns=[f.name for f in TICK])

    def close(self) -> None:
        pass


class Hysteresis(StatefulProcessor):
    """Raises a place that comes within the radius, clears it beyond 1.2 radii or when a tick no longer has it.

    Input rows: (vessel, ts, id, distance_m); a tick near no place is a row with a null id.
    """

    def __init__(self, radius_m: float = RADIUS_M):
        self._radius = radius_m

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._active = handle.getMapState("active", StructType([StructField("id", StringType())]), StructType([StructField("since", TimestampType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        near = pd.concat(list(rows)).sort_values("ts")
        active = {k[0]: v[0] for k, v in self._active.iterator()} if self._active.exists() else {}
        out = []
        for ts, tick in near.groupby("ts", sort=True):
            distances = {i: d for i, d in zip(tick["id"], tick["distance_m"]) if i is not None and d == d}
            held = {i for i, d in distances.items() if d <= self._radius * (CLEAR_FACTOR if i in active else 1.0)}
            for i in sorted(held - active.keys()):
                active[i] = ts.to_pydatetime()
                self._active.updateValue((i,), (active[i],))
                out.append((key[0], i, ts, "raise", ts))
            for i in sorted(active.keys() - held):
                out.append((key[0], i, ts, "clear", pd.Timestamp(active.pop(i))))
                self._active.removeKey((i,))
        yield pd.DataFrame(out, columns=[f.name for f in NOTIFICATION])

    def close(self) -> None:
        pass


def throttled_stream(fixes: DataFrame, min_seconds: float = MIN_SECONDS, min_metres: float = MIN_METRES) -> DataFrame:
    return (
        fixes.select("vessel", "ts", "lat", "lon").groupBy("vessel")
        .transformWithStateInPandas(Throttle(min_seconds, min_metres), outputStructType=TICK, outputMode="Append", timeMode="None")
    )


def near_stream(ticks: DataFrame, places: DataFrame, radius_m: float = RADIUS_M, more: tuple[str, ...] = ()) -> DataFrame:
    """(vessel, ts, id, distance_m): the places (id, p_lat, p_lon) within 1.2 radii of each tick, and a null row for each tick; more: columns of places."""
    from ..operators.alarms import within

    near = within(ticks, places, radius_m * CLEAR_FACTOR).select("vessel", "ts", "id", "distance_m", *more)
    nothing = [F.lit(None).cast(near.schema[c].dataType).alias(c) for c in ("id", "distance_m", *more)]
    return near.union(ticks.select("vessel", "ts", *nothing))


def alarm_stream(near: DataFrame, radius_m: float = RADIUS_M) -> DataFrame:
    return near.groupBy("vessel").transformWithStateInPandas(
        Hysteresis(radius_m), outputStructType=NOTIFICATION, outputMode="Append", timeMode="None"
    )


# Bridges and routes: two inputs, one state for each vessel

ROWS = StructType([
    StructField("vessel", LongType()), StructField("ts", TimestampType()), StructField("kind", StringType()), StructField("id", StringType()),
    StructField("distance_m", DoubleType()), StructField("clearance_m", DoubleType()), StructField("message", StringType()),
    StructField("value", DoubleType()), StructField("version", StringType()),
])
TOLD = StructType([
    StructField("vessel", LongType()), StructField("alarm", StringType()), StructField("id", StringType()), StructField("ts", TimestampType()),
    StructField("event", StringType()), StructField("since", TimestampType()), StructField("message", StringType()),
])


def rows_of(kind: str, df: DataFrame) -> DataFrame:
    """Rows of one input in the common shape. Kinds:

    near: (vessel, ts, id, distance_m, clearance_m) of bridges at a tick, told: (vessel, ts, id, message) of places on the route at a tick; each with
    a row of null id for every tick. draft: (vessel, ts, value), the air draft from then on; null: not known. version: (vessel, ts, version)
    of the route from then on; null: no route.
    """
    there = set(df.columns)
    cells = [F.lit(kind).alias("kind") if f.name == "kind" else (F.col(f.name) if f.name in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in ROWS]
    return df.select(*cells)


class VesselAlarms(StatefulProcessor):
    """Bridges that are too low, with hysteresis, and places on the route, told again when their message changes.

    A vessel's rows are taken in order of time, drafts and versions before the tick of their time. A null version clears the route's alarms
    at once; without a version nothing is on the route, without a draft no bridge is too low. `expire_s` after a vessel's last row
    what still holds is cleared and its state ends.
    """

    def __init__(self, radius_m: float = RADIUS_M, margin_m: float = 0.0, expire_s: float = 86_400.0):
        self._radius, self._margin, self._expire = radius_m, margin_m, int(expire_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._known = handle.getValueState("known", StructType([StructField("draft", DoubleType()), StructField("version", StringType()), StructField("until", LongType())]))
        key = StructType([StructField("alarm", StringType()), StructField("id", StringType())])
        self._active = handle.getMapState("active", key, StructType([StructField("since", TimestampType()), StructField("message", StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows))
        table["late"] = table["kind"].isin(("near", "told"))
        table = table.sort_values(["ts", "late"], kind="stable")
        draft, version, until = self._known.get() if self._known.exists() else (None, None, None)
        active = {tuple(k): tuple(v) for k, v in self._active.iterator()} if self._active.exists() else {}
        before, out = dict(active), []

        def settle(alarm: str, held: dict, ts) -> None:
            """held: the messages (None: none) of what holds now."""
            for i in sorted(k[1] for k in active.keys() if k[0] == alarm and k[1] not in held):
                since, message = active.pop((alarm, i))
                out.append((key[0], alarm, i, ts, "clear", pd.Timestamp(since), message))
            for i, message in sorted(held.items()):
                was = active.get((alarm, i))
                if was is None or was[1] != message:
                    since = ts.to_pydatetime() if was is None else was[0]
                    active[alarm, i] = (since, message)
                    out.append((key[0], alarm, i, ts, "raise" if was is None else "refresh", pd.Timestamp(since), message))

        for (ts, _), now in table.groupby(["ts", "late"], sort=True):
            at = int(ts.timestamp() * 1000)
            if until is not None and at > until:  # a timer may fire after these rows, which are not to find what has ended
                draft = version = None
                for alarm in ("bridge", "route"):
                    settle(alarm, {}, pd.Timestamp(until, unit="ms"))
            until = at + self._expire
            for row in now[~now["late"]].itertuples():
                if row.kind == "draft":
                    draft = row.value if row.value == row.value and row.value is not None and row.value > 0 else None
                else:
                    version = row.version
                    if version is None:
                        settle("route", {}, ts)
            near, told = now[now["kind"] == "near"], now[now["kind"] == "told"]
            if len(near):
                reach = near["id"].map(lambda i: self._radius * (CLEAR_FACTOR if ("bridge", i) in active else 1.0))
                low = (near["distance_m"] <= reach) & (near["clearance_m"] <= draft + self._margin) if draft is not None else pd.Series(False, near.index)
                settle("bridge", {i: None for i in near["id"][low & near["id"].notna()]}, ts)
            if len(told):
                there = told[told["id"].notna()] if version is not None else told[:0]
                settle("route", dict(zip(there["id"], there["message"])), ts)
        self._known.update((draft, version, until))
        for k in before.keys() - active.keys():
            self._active.removeKey(k)
        for k, v in active.items():
            if before.get(k) != v:
                self._active.updateValue(k, v)
        for old in list(self._handle.listTimers()):
            self._handle.deleteTimer(old)
        self._handle.registerTimer(until + 1)
        yield pd.DataFrame(out, columns=[f.name for f in TOLD])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs() - 1, unit="ms")
        held = sorted((tuple(k), tuple(v)) for k, v in self._active.iterator()) if self._active.exists() else []
        self._active.clear()
        self._known.clear()
        yield pd.DataFrame([(key[0], *k, at, "clear", pd.Timestamp(v[0]), v[1]) for k, v in held], columns=[f.name for f in TOLD])

    def close(self) -> None:
        pass


def vessel_alarm_stream(rows: DataFrame, radius_m: float = RADIUS_M, margin_m: float = 0.0, expire_s: float = 86_400.0, late: str = "10 minutes") -> DataFrame:
    """TOLD rows of a union of rows_of streams; rows later than `late` behind the newest of all are dropped."""
    return rows.withWatermark("ts", late).groupBy("vessel").transformWithStateInPandas(
        VesselAlarms(radius_m, margin_m, expire_s), outputStructType=TOLD, outputMode="Append", timeMode="EventTime"
    )
