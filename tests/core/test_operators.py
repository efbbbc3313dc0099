import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from harborlight import boxes
from harborlight.functions import dates, geo, numbers, text
from harborlight.operators import alarms, corridor, dedupe, detail, predicates, store, throttle

POI = "seq long, id string, source string, type string, lat double, lon double, name string, attribution string, clearance_m double"
METRE = 1 / 111_194.9


def points(spark, *rows):
    """rows: (source, metres north, type, clearance)."""
    made = [
        (k, f"{r[0]}-{k}", r[0], r[2] if len(r) > 2 else "Hazard", 42 + r[1] * METRE, -71.0, f"p{k}", f"by {r[0]}", r[3] if len(r) > 3 else None)
        for k, r in enumerate(rows)
    ]
    return spark.createDataFrame(made, POI)


def merged(df, sources=("osm", "enc"), radii=None):
    return {r.seq: r for r in dedupe.merged(df, list(sources), radii).collect()}


def test_merging_into_the_base(spark):
    got = merged(points(spark, ("activecaptain", 0, "Bridge", 9.0), ("osm", 20, "Bridge", 7.0), ("enc", 30, "Bridge"), ("osm", 10, "Hazard"), ("osm", 25, "Bridge", 6.0)))
    assert set(got) == {0, 3}
    assert got[0].sources == ["activecaptain", "osm", "enc"] and got[0].attribution == "by activecaptain; by osm; by enc" and got[0].clearance_m == 6.0
    assert got[3].sources == ["osm"]


def test_sources_without_dedupe_pass(spark):
    got = merged(points(spark, ("activecaptain", 0), ("osm", 5), ("wpi", 5), ("wpi", 6)), ["osm"])
    assert set(got) == {0, 2, 3} and got[2].sources is None and got[0].sources == ["activecaptain", "osm"]
    assert all(r.sources is None for r in merged(points(spark, ("activecaptain", 0), ("osm", 5)), []).values())


def test_radius_by_source(spark):
    rows = points(spark, ("activecaptain", 0), ("osm", 30), ("enc", 30))
    assert set(merged(rows, radii=dedupe.Radii({"osm": 10.0}))) == {0, 1}


def test_same_source_is_greedy_in_input_order(spark):
    got = merged(points(spark, ("osm", 0, "Bridge", 5.0), ("osm", 40, "Bridge", 4.0), ("osm", 80, "Bridge"), ("osm", 120, "Bridge", 3.0)))
    assert set(got) == {0, 2} and got[0].clearance_m == 4.0 and got[2].clearance_m == 3.0


@pytest.mark.parametrize("block, lat", [(4096, 42.0), (7, 42.0), (7, -80.0)])
def test_base_matches_of_dense_places_give_few_rows(spark, monkeypatch, block, lat):
    """The first base row of each row equals brute force, and what goes to the last grouping is a few rows for each, not their pairs."""
    monkeypatch.setattr(dedupe, "BLOCK_ROWS", block)
    rng = random.Random(block)
    spot = lambda: (lat + rng.uniform(-60, 60) * METRE, 10 + rng.uniform(-60, 60) * METRE / math.cos(math.radians(lat)))
    rows = [(k, rng.choice(["activecaptain", "activecaptain", "osm", "enc"]), "Lock", *spot()) for k in range(400)]
    radii = dedupe.Radii({"osm": 12.0})
    cells = dedupe.with_cells(spark.createDataFrame(rows, "seq long, source string, type string, lat double, lon double"), radii)
    cell = {r.seq: (r.cx, r.cy) for r in cells.collect()}
    pairs, want = 0, {}
    for seq, source, _, *at in rows:
        near = [b for b in rows if b[1] == "activecaptain" and boxes.distance(at, b[3:]) <= (12.0 if source == "osm" else dedupe.DEFAULT_RADIUS_M)] if source != "activecaptain" else []
        pairs += len(near)
        if near:
            want[seq] = min((*cell[b[0]], b[0]) for b in near)[2]
    found = dedupe.base_matches(cells, ["osm", "enc"], radii)
    assert {r.seq: r.base_seq for r in found.collect()} == want and pairs > 20 * len(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan  # pairs are settled where they are met
    if block == 4096:
        one = spark.createDataFrame([(r[0], r[3], r[4], 45.72) for r in rows], "seq long, lat double, lon double, radius double")
        met = one.agg(F.collect_list(F.struct("seq", "lat", "lon", "radius")).alias("rows"), F.collect_list(F.struct("seq", "lat", "lon")).alias("bases"))
        met = met.select(F.lit(1).cast("long").alias("px"), F.lit(2).cast("long").alias("py"), "rows", "bases")
        assert met.mapInArrow(dedupe.first_finder, "seq long, px long, py long, base_seq long").count() == len(rows)


@pytest.mark.parametrize("seed", range(3))
def test_greedy_rounds_equal_the_loop(spark, monkeypatch, seed):
    rng = random.Random(seed)
    place = [rng.uniform(0, 60) for _ in range(300)]
    links = [(a, b) for a in range(300) for b in range(a) if abs(place[a] - place[b]) < 0.5]
    kept = []
    for a in range(300):
        if not any(abs(place[a] - place[b]) < 0.5 for b in kept):
            kept.append(a)
    dropped = dedupe.greedy_dropped(spark.createDataFrame(links, "seq long, earlier long"))
    assert {r.seq for r in dropped.collect()} == set(range(300)) - set(kept)
    # Blocks that cut chains anywhere, and blocks dealt to several tasks.
    blocks = {a: rng.randrange(6) for a in range(300)}
    monkeypatch.setattr(dedupe, "BLOCK_EDGES", rng.choice([40, 1000]))
    dropped = dedupe.greedy_dropped(spark.createDataFrame([(a, b, blocks[a]) for a, b in links], "seq long, earlier long, block long"))
    assert {r.seq for r in dropped.collect()} == set(range(300)) - set(kept)
    assert dedupe.greedy_dropped(spark.createDataFrame([], "seq long, earlier long")).count() == 0


def test_corridor(spark):
    degree = 111_194.9
    rows = [("Hazard", 0.002, 0.5), ("Marina", 0.0, 0.5), ("Bridge", -0.001, 1.5), ("Lock", 0.02, 0.5), ("Hazard", 0.0, -0.1), ("Hazard", 0.0, 1.0)]
    poi = spark.createDataFrame([(k, f"x-{k}", "x", t, lat, lon, "n", "a", None) for k, (t, lat, lon) in enumerate(rows)], POI)
    legs = corridor.legs_of(corridor.route_points(spark, [(0.0, 0.0), (0.0, 1.0), (0.0, 1.0), (0.0, 2.0)]))
    got = {r.id: r for r in corridor.corridor(poi, legs, 500.0, 10.0).collect()}
    assert set(got) == {"x-0", "x-2", "x-5"}
    assert got["x-0"].cross_m == pytest.approx(-0.002 * degree, rel=1e-3) and got["x-2"].along_m == pytest.approx(1.5 * degree, rel=1e-3)
    assert got["x-2"].cross_m > 0 and got["x-0"].eta_s == pytest.approx(got["x-0"].along_m / 10) and got["x-5"].leg == 0
    for width in (0.0, float("nan"), -1.0, float("inf")):
        assert corridor.corridor(poi, legs, width).count() == 0
    assert corridor.corridor(poi, legs, 500.0, 0.0).first().eta_s is None
    assert [r.id for r in corridor.ahead(corridor.corridor(poi, legs, 500.0), degree * 0.6).collect()] == ["x-0"]


def test_beyond_a_bend_no_leg_has_it(spark):
    poi = spark.createDataFrame([(0, "x", "x", "Hazard", -0.001, 1.001, "n", "a", None)], POI)
    legs = corridor.legs_of(corridor.route_points(spark, [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]))
    assert corridor.corridor(poi, legs, 500.0).count() == 0


def machine(distances, r):
    """The alarm as a loop over ticks: distances of each (None: not there)."""
    on, out = False, []
    for k, d in enumerate(distances, 1):
        now = d is not None and d <= (r * 1.2 if on else r)
        if now != on:
            out.append((k, "raise" if now else "clear"))
        on = now
    return out


@pytest.mark.parametrize("stretch, margin", [(4096, None), (7, None), (5, 1.5)])
def test_transitions_equal_the_state_machine(spark, monkeypatch, stretch, margin):
    """Two vessels over places at the antimeridian; stretches of a few ticks and parts of a few places cut runs anywhere."""
    monkeypatch.setattr(alarms, "STRETCH", stretch)
    monkeypatch.setattr(alarms, "PLACES", 512 if stretch > 10 else 3)
    rng = random.Random(2)
    spot = lambda spread: (rng.uniform(-spread, spread), boxes.wrapped(180 + rng.uniform(-spread, spread)))
    places = [(f"h{k}", *spot(0.012), rng.choice([2.0, 4.0, 6.0])) for k in range(25)]
    walks = {}
    for vessel in (1, 2):
        here = spot(0.01)
        walks[vessel] = []
        for _ in range(90):
            here = spot(0.01) if rng.random() < 0.1 else (here[0] + rng.uniform(-0.001, 0.001), boxes.wrapped(here[1] + rng.uniform(-0.001, 0.001)))
            walks[vessel].append((*here, rng.choice([None, 1.0, 3.0, 5.0])))
    ticks = [(v, k, *at) for v, walk in walks.items() for k, at in enumerate(walk, 1)]
    frame = spark.createDataFrame(ticks, "vessel long, tick int, lat double, lon double, air_draft double")
    got = alarms.transitions(frame, spark.createDataFrame(places, "id string, p_lat double, p_lon double, clearance_m double"), 500.0, margin)
    found = {}
    for r in sorted(got.collect(), key=lambda r: r.tick):
        found.setdefault((r.vessel, r.id), []).append((r.tick, r.event))
    want = {}
    for v, walk in walks.items():
        for i, lat, lon, clearance in places:
            holds = lambda draft: margin is None or (draft is not None and clearance <= draft + margin)
            turns = machine([boxes.distance(at[:2], (lat, lon)) if holds(at[2]) else None for at in walk], 500)
            if turns:
                want[v, i] = turns
    assert found == want and sum(map(len, want.values())) > 60


def test_ticks_and_values_carried_over_parts(spark):
    """Numbers and filled values of histories that lie in several partitions, one vessel holding most rows."""
    rng = random.Random(3)
    rows = [(1 if k % 5 else k % 15, k, None if rng.random() < 0.7 else float(k)) for k in range(400)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "vessel long, event_id long, air_draft double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = alarms.filled_forward(alarms.numbered(frame, ["event_id"]), "air_draft").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.stretch for r in got}) > 1
    last, count = {}, {}
    for v, k, draft in sorted(rows, key=lambda r: r[1]):
        count[v] = count.get(v, 0) + 1
        last[v] = draft if draft is not None else last.get(v)
        assert next((r.tick, r.air_draft) for r in got if r.event_id == k) == (count[v], last[v])


@pytest.mark.parametrize("centre", [(42.0, -71.0), (0.0, 179.99), (89.97, 10.0), (-60.0, -179.995)])
def test_pairs_within_a_radius_anywhere(spark, centre):
    rng = random.Random(1)
    spot = lambda: (max(-90.0, min(90.0, centre[0] + rng.uniform(-0.03, 0.03))), boxes.wrapped(centre[1] + rng.uniform(-0.05, 0.05) / max(0.001, math.cos(math.radians(centre[0])))))
    fixes, places = [(k, *spot()) for k in range(60)], [(f"p{k}", *spot()) for k in range(60)]
    got = alarms.within(spark.createDataFrame(fixes, "vessel long, lat double, lon double"), spark.createDataFrame(places, "id string, p_lat double, p_lon double"), 900.0)
    want = {(f[0], p[0]) for f in fixes for p in places if boxes.distance(f[1:], p[1:]) <= 900}
    rows = [(r.vessel, r.id) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 20


def _dense(spark, ticks, places):
    """A vessel that is in and out of reach of every place, tick by tick."""
    track = spark.range(1, ticks + 1).select(F.lit(1).cast("long").alias("vessel"), F.col("id").alias("tick"), (42 + F.col("id") % 2 * 900 * METRE).alias("lat"), F.lit(-71.0).alias("lon"))
    put = spark.range(places).select(F.concat(F.lit("p"), "id").alias("id"), (42 + F.col("id") * METRE / 10).alias("p_lat"), F.lit(-71.0).alias("p_lon"))
    return track, put


def test_what_alarms_store_grows_with_ticks_and_places_not_with_pairs(spark, monkeypatch):
    stored = []
    real = alarms.checkpointed
    monkeypatch.setattr(alarms, "checkpointed", lambda df: stored.append(real(df)) or stored[-1])
    found = alarms.episodes(*_dense(spark, 1000, 300), 500.0)
    assert found.count() == 300 * 500
    rows = [df.select(F.sum(F.size(c)) if (c := next((c for c in df.columns if c in ("ticks", "places")), None)) else F.count("*")).first()[0] for df in stored]
    assert sum(rows) <= 9 * 1000 + 3 * alarms.DEALS * 300


def test_pairs_within_a_radius_are_found_by_many_tasks(spark):
    track, put = _dense(spark, 4000, 50)
    near = alarms.within(track.withColumn("lat", F.col("lat") + F.col("tick") * 1e-9).coalesce(1), put.coalesce(1), 500.0)
    by_task = [r["count"] for r in near.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(by_task) == 2000 * 50 and len(by_task) > 1 and max(by_task) < 0.8 * sum(by_task)


def test_throttle(spark):
    start = dt.datetime(2026, 1, 1)
    rows = [(1, start + dt.timedelta(seconds=s), 42 + m * METRE, -71.0) for s, m in ((0, 0), (61, 50), (90, 200), (100, 500), (151, 200), (160, 900))]
    got = throttle.throttled(spark.createDataFrame(rows, "vessel long, ts timestamp, lat double, lon double"))
    assert sorted((r.ts - start).seconds for r in got.collect()) == [0, 90, 160]


@pytest.mark.parametrize("block", [4, 16, 4096])
def test_throttle_over_blocks_equals_the_walk(spark, monkeypatch, block):
    """Vessels under way, at anchor for many blocks, over the antimeridian, with fixes of one time and without positions."""
    monkeypatch.setattr(throttle, "BLOCK", block)
    rng, start, rows = random.Random(block), dt.datetime(2026, 1, 1), []
    for vessel, lon in ((1, -71.0), (2, 179.999), (None, 5.0), (4, 10.0)):
        lat, second = 42.0, 0
        for k in range(260 if vessel == 1 else 60):
            anchored = vessel == 1 and 60 <= k < 220
            second += rng.choice([0, 1, 20, 45, 90])
            if not anchored:
                lat, lon = lat + rng.uniform(-0.001, 0.001), boxes.wrapped(lon + rng.uniform(-0.001, 0.001))
            at = rng.choice([(None, lon), (lat, None), (95.0, lon), (lat, 400.0)]) if k == 0 or rng.random() < 0.1 else (lat, lon)
            rows.append((vessel, start + dt.timedelta(seconds=second), *at, len(rows)))
    rows.append((5, None, 1.0, 1.0, len(rows)))
    frame = spark.createDataFrame(rows, "vessel long, ts timestamp, lat double, lon double, key long")
    got = throttle.throttled(frame, order=["key"])
    assert got.columns == frame.columns
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.ts, r.key)):
        found.setdefault(r.vessel, []).append(r.key)
    # Fixes of one time go by key.
    want = {}
    for vessel in (1, 2, 4):
        mine = [(r[1], r[4], r[2], r[3]) for r in rows if r[0] == vessel]
        order = {key: n for n, (_, key, _, _) in enumerate(sorted(mine, key=lambda m: m[:2]))}
        last, out = None, []
        for ts, key, lat, lon in sorted(mine, key=lambda m: order[m[1]]):
            if lat is None or lon is None or abs(lat) > 90 or abs(lon) > 180:
                continue
            if last is None or ((ts - last[0]).total_seconds() >= 60 and boxes.distance(last[1:], (lat, lon)) >= 100):
                last = (ts, lat, lon)
                out.append(key)
        want[vessel] = out
    assert found == want and len(want[1]) > 10


def test_throttle_of_nothing(spark):
    schema = "vessel long, ts timestamp, lat double, lon double, _n int"
    assert throttle.throttled(spark.createDataFrame([], schema)).count() == 0
    only = [(1, dt.datetime(2026, 1, 1), None, 2.0, 1), (None, dt.datetime(2026, 1, 1), 1.0, 2.0, 1)]
    assert throttle.throttled(spark.createDataFrame(only, schema)).count() == 0


def test_as_of_keeps_points_without_a_vessel_and_settles_ties(spark):
    at = lambda s: dt.datetime(2026, 1, 1, 0, 0, s)
    states = spark.createDataFrame([(1, at(5), 2.0, 1), (1, at(5), 3.0, 0), (1, None, 9.0, 9), (None, at(0), 8.0, 8), (2, at(7), 4.0, 1)], "vessel long, ts timestamp, draft double, rank int")
    points = spark.createDataFrame([(1, at(5), 1), (1, at(4), 2), (None, at(9), 3), (1, None, 4), (2, at(9), 5), (3, at(9), 6)], "vessel long, ts timestamp, tick int")
    got = alarms.as_of(points, states, ["draft"])
    assert got.columns == ["vessel", "ts", "tick", "last_draft"]
    assert {r.tick: r.last_draft for r in got.collect()} == {1: 3.0, 2: None, 3: None, 4: None, 5: 4.0, 6: None}
    assert {r.tick: r.last_draft for r in alarms.as_of(points, states, ["draft"], ["rank"]).collect()}[1] == 2.0


def test_an_id_at_two_places_is_one_alarm(spark):
    ticks = spark.createDataFrame([(1, k, 42 + k * 100 * METRE, -71.0) for k in range(1, 31)], "vessel long, tick int, lat double, lon double")
    places = spark.createDataFrame([("h", 42 + m * METRE, -71.0) for m in (1030, 1030, 1830)] + [("n", None, -71.0)], "id string, p_lat double, p_lon double")
    got = [tuple(r) for r in alarms.episodes(ticks, places, 500.0).collect()]
    reach = [min(abs(k * 100 - 1030), abs(k * 100 - 1830)) for k in range(1, 31)]
    ((_, _, raised, cleared),) = got
    assert (raised, cleared) == (next(k for k, d in enumerate(reach, 1) if d <= 500), next(k for k, d in enumerate(reach, 1) if k > 18 and d > 600))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_longitudes(spark):
    for x, want in ((180.0, 180.0), (-180.0, -180.0), (190.0, -170.0), (540.0, 180.0), (-540.0, -180.0), (-190.0, 170.0), (float("nan"), None), (float("inf"), None)):
        assert one(spark, geo.wrap_longitude(F.lit(x))) == want
    inside = lambda lon, w, e: one(spark, geo.in_bbox(F.lit(0.0), F.lit(lon), -1, 1, w, e))
    assert inside(-179.0, 170, -170) and inside(180.0, 180, -180) and not inside(0.0, 180, -180) and inside(0.0, -180, 180)


def test_tiles(spark):
    assert one(spark, geo.tile_key(F.lit(0.0), F.lit(180.0))) == 900 * 3600 + 3599
    assert one(spark, geo.snap_out(F.lit(-71.05), False)) == -71.1 and one(spark, geo.snap_out(F.lit(42.3), True)) == 42.3


def test_numbers(spark):
    assert one(spark, numbers.round_half_up(F.lit(-2.5), 0)) == -2.0
    for raw, want in (("12", 12), ("012", None), ("9007199254740991", 2**53 - 1), ("9007199254740992", None), ("1.5", None), ("0", None)):
        assert one(spark, numbers.safe_positive_integer(F.lit(raw))) == want
    assert one(spark, numbers.height_m(F.lit(10.0), F.lit(" Feet "))) == pytest.approx(3.048) and one(spark, numbers.height_m(F.lit(10.0), F.lit("furlong"))) is None
    assert one(spark, numbers.clamped(F.lit(float("nan")), 1, 5, 3)) == 3.0


def test_texts(spark):
    assert one(spark, text.present(F.lit("  x  "))) == "x" and one(spark, text.present(F.lit(" \t"))) is None
    assert one(spark, text.capital_first(F.lit("abC"))) == "AbC"
    for raw, want in (("ßab", "ẞab"), ("ﬁn", "ﬁn"), ("ᾳx", "ᾼx"), ("éa", "Éa"), ("", ""), (None, None)):  # one capital for one letter
        assert one(spark, text.capital_first(F.lit(raw).cast("string"))) == want
    assert one(spark, text.path_id(F.lit("a?b"))).startswith("escaped.") and one(spark, text.path_id(F.lit(""))) == "escaped._"
    assert one(spark, text.distance_text(F.lit(1249.0))) == "1.2 km" and one(spark, text.distance_text(F.lit(999.4))) == "999 m"
    assert [one(spark, text.eta_text(F.lit(float(s)))) for s in (59, 60, 3599, 7260)] == ["<1 min", "1 min", "1 h 0 min", "2 h 1 min"]
    assert one(spark, text.metres_text(F.lit(7.04))) == "7" and one(spark, text.metres_text(F.lit(7.06))) == "7.1"
    assert one(spark, text.namespace_of(F.lit("-x"))) is None and one(spark, text.local_id(F.lit("a-b-c"))) == "b-c"


def test_dates(spark):
    unit = lambda s: tuple(one(spark, dates.relative_units(F.lit(float(s)))))
    assert unit(-3599) == (-1, "hour") and unit(-59) == (-59, "second") and unit(59.6) == (1, "minute") and unit(86_400 * 29.9) == (1, "month") and unit(0) == (0, "second")
    leap = F.lit("2024-02-29 00:00:00").cast("timestamp")
    assert one(spark, dates.is_stale(F.lit("Hazard"), F.lit("2022-02-27 23:00:00").cast("timestamp"), leap))
    assert not one(spark, dates.is_stale(F.lit("Hazard"), F.lit("2022-02-28 00:00:00").cast("timestamp"), leap))
    assert not one(spark, dates.is_stale(F.lit("Lock"), F.lit("2000-01-01 00:00:00").cast("timestamp"), leap))


def test_filters(spark):
    assert predicates.selected_kinds({}) == list(predicates.SELECTABLE) and predicates.selected_kinds({"Lock": False}) is None
    keep = lambda kind, rating, least: one(spark, predicates.rated(F.lit(kind), F.lit(rating).cast("double"), least))
    assert not keep("Marina", None, 3.0) and keep("Hazard", None, 3.0) and keep("Marina", 3.0, 3.0) and keep("Marina", None, 0.0) and keep("Marina", None, float("nan"))
    assert not one(spark, predicates.blocks_vessel(F.lit(None).cast("double"), F.lit(9.0), 1.0)) and one(spark, predicates.blocks_vessel(F.lit(10.0), F.lit(9.0), 1.0))
    assert not one(spark, predicates.outside_us_gate(F.lit(None).cast("double"), F.lit(0.0))) and one(spark, predicates.outside_us_gate(F.lit(50.0), F.lit(0.0)))


def test_pages_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "pages")
    frame = lambda rows: spark.createDataFrame(rows, "id long, page string")
    store.replace_pages(frame([(1, "a"), (2, "b")]), path)
    store.replace_pages(frame([(3, "b"), (4, "b")]), path)
    assert sorted(r.id for r in store.read_pages(spark, path).collect()) == [1, 3, 4]
    assert [r.id for r in store.read_pages(spark, path, frame([(0, "a")])).collect()] == [1]
    assert store.unchanged(frame([(1, "a")]), frame([(1, "a")]), ["id"]) and not store.unchanged(frame([(1, "a")]), frame([(1, "b")]), ["id"])


def test_notes_carry_the_icons_of_rows_and_of_every_kind(spark):
    kinds = {"BoatRamp": "boatramp", "Dam": "dam", "Ferry": "ferry", "Inlet": "inlet", "Lock": "lock", "Airport": "notice-to-mariners"}
    rows = spark.createDataFrame([(k, k, 1.0, 2.0, None, [], k) for k in kinds], "id string, name string, lat double, lon double, url string, sources array<string>, type string")
    shown = lambda df: {r.id: r.x for r in detail.notes(df).select("id", detail.property_of(F.col("note"), "properties.skIcon").alias("x")).collect()}
    assert shown(rows) == kinds
    own = F.when(F.col("type") == "Lock", "hazard")
    assert shown(rows.withColumn("sk_icon", own)) == kinds | {"Lock": "hazard"}


@pytest.mark.parametrize("centre, step", [((42.0, -71.0), 0.02), ((0.0, 179.98), 0.02), ((89.9, 20.0), 20.0), ((-45.0, 10.0), 30.0)])
def test_corridor_cells_hold_all_and_few_more(spark, centre, step):
    """Places close together along legs short and long, over the seam and near a pole: every one beside a leg, few pairs tried."""
    rng = random.Random(int(step))
    spread = step if step > 1 else 0.03
    route = [(max(-89.99, min(89.99, centre[0] + rng.uniform(-step, step) * (0.001 if centre[0] > 89 else 1))), boxes.wrapped(centre[1] + k * step)) for k in range(4)]
    legs = corridor.legs_of(corridor.route_points(spark, route))
    ends = legs.collect()
    places = []
    for k in range(1500):
        leg = rng.choice(ends)
        at = boxes.moved(leg.leg_lat, leg.leg_lon, math.degrees(leg.bearing), rng.uniform(-0.1, 1.1) * leg.length_m)
        at = boxes.moved(*at, rng.uniform(0, 360), rng.uniform(0, 900)) if rng.random() < 0.5 else (max(-90.0, min(90.0, at[0] + rng.uniform(-spread, spread))), boxes.wrapped(at[1] + rng.uniform(-spread, spread)))
        places.append((k, f"p{k}", "x", "Hazard", *at, "n", "a", None))
    poi = spark.createDataFrame(places, POI)
    every = poi.crossJoin(legs).withColumn("on", geo.onto_leg(F.col("leg_lat"), F.col("leg_lon"), F.col("bearing"), F.col("lat"), F.col("lon")))
    inside = every.where((F.abs("on.cross_m") <= 300) & F.col("on.along_m").between(0, F.col("length_m"))).select("id", "leg")
    near = corridor.candidates(poi, legs, 300.0).select("id", "leg")
    found, tried = {tuple(r) for r in inside.collect()}, [tuple(r) for r in near.collect()]
    assert len(tried) == len(set(tried)) and found <= set(tried) and len(found) > 100
    assert len(tried) <= 6 * len(found)
