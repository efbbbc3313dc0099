import http.server
import io
import json
import random
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from harborlight.operators import federate, sections
from harborlight.operators import federate
from harborlight.sources import activecaptain, enc, lightlist, listing, notices, openseamap, paged, ports, stations, structures


def put(folder, name, value):
    path = folder / name
    path.write_text(json.dumps(value))
    return str(path)


def feature(properties, place=(-71.0, 42.0), ref=None):
    return {"type": "Feature", "id": ref, "geometry": place and {"type": "Point", "coordinates": list(place)}, "properties": properties}


def by_id(df):
    return {r.id: r for r in df.collect()}


def shown(df, made):
    return [[s.id, *[(i.label, i.value) for i in s["items"]]] for s in df.select(made.alias("s")).first().s]


def test_seamarks(spark, tmp_path):
    raw = {"elements": [
        {"type": "node", "id": 1, "lat": 42.0, "lon": -71.0, "tags": {"seamark:type": " Bridge ", "name": " Low ", "maxheight": "none", "clearance": "10'6\""}},
        {"type": "way", "id": 2, "center": {"lat": 42.1, "lon": -71.1}, "tags": {"leisure": "marina"}, "timestamp": "2024-02-03T04:05:06Z"},
        {"type": "node", "id": 3, "lat": 95.0, "lon": 0.0, "tags": {"seamark:type": "rock"}},
        {"type": "area", "id": 4, "lat": 1.0, "lon": 0.0, "tags": {}},
        {"type": "node", "id": 5, "lat": 1.0, "lon": 0.0, "tags": {"seamark:type": "light_minor", "seamark:light:character": "Fl(2)", "seamark:light:period": "6",
                                                                 "seamark:light_minor:category": "a_b"}},
    ]}
    rows = openseamap.load(spark, put(tmp_path, "o.json", raw))
    got = by_id(openseamap.summaries(rows))
    assert set(got) == {"node_1", "way_2", "node_5"}
    assert (got["node_1"].type, got["node_1"].name, round(got["node_1"].clearance_m, 4)) == ("Bridge", "Low", 3.2004)
    assert (got["way_2"].type, got["way_2"].name, got["way_2"].lat, got["way_2"].ts.year) == ("Marina", "Unnamed marina", 42.1, 2024)
    assert got["node_5"].url == "https://www.openstreetmap.org/node/5"
    light = shown(rows.where("id = 5"), sections.seamark_sections())
    assert light == [["feature", ("Category", "a b")], ["light", ("Character", "flashing (2)"), ("Period", "6.0")]]


def test_community(spark, tmp_path):
    poi = lambda i, **more: {"id": i, "poiType": "Marina", "name": "M", "mapLocation": {"latitude": 42, "longitude": -71}, **more}
    raw = {"pointsOfInterest": [
        poi(1, reviewSummary={"averageRating": 4.5, "numberOfReviews": 2}), poi(2, reviewSummary={"averageRating": 0, "numberOfReviews": 0}),
        poi(3, poiCount=4), poi(4, name=""), poi(5, poiType="Sauna"),
    ]}
    got = by_id(activecaptain.summaries(activecaptain.load(spark, put(tmp_path, "a.json", raw))))
    assert set(got) == {"1", "2", "5"} and (got["1"].rating, got["1"].review_count) == (4.5, 2)
    assert got["2"].rating is None and got["5"].sk_icon == "notice-to-mariners"


def test_community_sections(spark, tmp_path):
    raw = {
        "pointOfInterest": {"id": 1, "poiType": "Marina", "notes": [{"field": "poiNotes", "value": "Quiet"}, {"field": "dockAccess", "value": ""}]},
        "reviewSummary": {"averageRating": 4.0, "numberOfReviews": 3}, "dockage": {"isFree": False, "total": 0, "loaMax": 60, "distanceUnit": "Foot", "liveaboard": "Unknown"},
        "fuel": {"diesel": "Yes", "gas": "Nearby", "propane": "Unknown"}, "contact": {"phone": "1 2", "website": "javascript:x"},
    }
    rows = spark.read.schema(sections.community_schema()).option("multiLine", True).json(put(tmp_path, "d.json", raw))
    assert shown(rows, sections.community_sections()) == [
        ["review", ("Average rating", "4.0"), ("Reviews", "3")], ["notes", ("Notes", "Quiet")], ["dockage", ("Docks", "false"), ("Maximum LOA", "60.0")],
        ["contact", ("Phone", "tel:1 2")], ["fuel", ("Diesel", "Yes"), ("Unleaded", "Nearby")],
    ]


def test_light_list(spark, tmp_path):
    base = {"LIGHT_LIST_NUMBER": 12.5, "DECIMAL_LATITUDE": 42.0, "DECIMAL_LONGITUDE": -71.25, "VOLUME_NUMBER": "1"}
    raw = {"features": [
        feature(base | {"NAME": "Rock Light", "LIGHT_CHAR": "Fl W 4s", "LIGHT_NOM_RANGE": 9, "LIGHT_NOM_RANGE_UNIT": "NAUT MI", "MODIFIED_DATE": 1700000000000}),
        feature(base | {"LIGHT_LIST_NUMBER": 13, "AID_TYPE": "Buoy", "REMARK": "Marks isolated danger"}), feature(base | {"LIGHT_LIST_NUMBER": 14, "INACTIVE": "true"}),
        feature(base | {"LIGHT_LIST_NUMBER": None}), feature(base | {"LIGHT_LIST_NUMBER": 15, "VOLUME_NUMBER": "x"}), feature(base | {"LIGHT_LIST_NUMBER": 16, "DECIMAL_LATITUDE": None}),
    ]}
    rows = lightlist.load(spark, put(tmp_path, "l.json", raw))
    got = by_id(lightlist.summaries(rows))
    assert {k: (r.name, r.sk_icon) for k, r in got.items()} == {
        "12.5": ("Rock Light", "navigation-structure"), "13": ("Unnamed Buoy", "hazard"), "14": ("Unnamed navigation aid", "notice-to-mariners"),
    }
    assert got["12.5"].url.endswith("&mlat=42.00000&mlon=-71.25000") and got["12.5"].ts.year == 2023
    parts = shown(lightlist.records(rows).where("llnr = '12.5'"), sections.light_list_sections())
    assert parts[0] == ["light", ("Character", "flashing, white, 4 s period"), ("Nominal range", "9.0")]


def test_notices(spark, tmp_path):
    place = {"DECIMAL_LATITUDE": 42.0, "DECIMAL_LONGITUDE": -71.0}
    raw = {"features": [
        feature(place | {"MSI_UID": 5, "WATERWAY_NAME": "Bay", "TYPE": "Wreck", "CREATE_DATE": 1700000000000, "DESCRIPTION": "a\r\n\n b "}),
        feature({"ESRI_OID": 6, "TITLE": " One / two"}, ref=9), feature(place, ref="7"), feature(place),
    ]}
    rows = notices.load(spark, put(tmp_path, "n.json", raw), "haznav")
    got = by_id(notices.summaries(rows, "haznav"))
    assert {k: r.name for k, r in got.items()} == {"haznav_5": "Bay: Wreck", "haznav_6": "One", "haznav_7": "Hazard to Navigation"}
    assert rows.where("MSI_UID = 5").select(notices.notice_lines(F.col("DESCRIPTION"))).first()[0] == "a<br>b"
    raw = {"features": [feature(place | {"LNM_UID": 1, "NAME": "Buoy 4", "DISCREP_STATUS": "LT EXT/OFF STA", "DISCREP_CORR_STATUS": "N/A", "COLOR": "G", "DESCRIPTION_TYPE": "DBN"})]}
    rows = notices.load(spark, put(tmp_path, "d.json", raw), "discfedaid")
    assert by_id(notices.summaries(rows, "discfedaid"))["discfedaid_1"].type == "Hazard"
    assert shown(rows, sections.notice_sections("discfedaid"))[0] == ["condition", ("Status", "light extinguished; off station"), ("Affected aid", "green daybeacon")]


def test_charts_and_structures(spark, tmp_path):
    raw = {"features": [
        feature({"OBJECTID": "3", "CATWRK": "non-dangerous wreck", "VALSOU": 4.5, "QUASOU": "6", "WATLEV": 3, "SORDAT": "202402"}),
        feature({"OBJECTID": 0}), feature({"OBJNAM": "X"}, ref=8), feature({"OBJECTID": 4}, place=None),
    ]}
    rows = enc.load(spark, put(tmp_path, "e.json", raw))
    got = by_id(enc.summaries(rows, "wreck"))
    assert {k: r.name for k, r in got.items()} == {"wreck_3": "Wreck", "wreck_8": "X"} and got["wreck_3"].ts.month == 2
    assert shown(rows.where("OBJECTID = '3'"), sections.enc_sections("wreck")) == [
        ["feature", ("Dangerous", "false")], ["depth", ("Least depth", "4.5"), ("Water level", "always submerged")],
        ["quality", ("Position quality", "least depth known")], ["source", ("Surveyed", "2024-02")],
    ]
    raw = {"features": [feature({"OBJECTID": 1, "PMSNAME": " Lock 5 ", "LENGTH": 100, "RIVERMI": 12.25, "YEAROPEN": 1936.0})]}
    rows = structures.load(spark, put(tmp_path, "u.json", raw))
    assert by_id(structures.summaries(rows, "lock"))["lock_1"].name == "Lock 5"
    assert shown(rows, sections.structure_sections("lock")) == [
        ["chamber", ("Name", "Lock 5"), ("Length", "30.48")], ["location", ("River mile", "12.3")], ["source", ("Opened", "1936")],
    ]


def test_stations_and_ports(spark, tmp_path):
    raw = {"stations": [{"id": 8443970, "name": "Boston", "lat": 42.35, "lng": -71.05, "state": "MA"}, {"id": "A B", "lat": 1, "lng": 1}, {"id": " ", "lat": 1, "lng": 1}]}
    rows = stations.load(spark, put(tmp_path, "s.json", raw))
    got = by_id(stations.summaries(rows, "tide"))
    assert got["tide_A B"].url.endswith("?id=A%20B") and got["tide_A B"].name == "Station A B" and set(got) == {"tide_8443970", "tide_A B"}
    raw = {"ports": [{"portNumber": 7, "portName": " ", "xcoord": 1.0, "ycoord": 2.0, "harborSize": "s", "chDepth": "7.5", "maxVesselLength": "no"}, {"portNumber": None}]}
    rows = ports.load(spark, put(tmp_path, "p.json", raw))
    assert by_id(ports.summaries(rows))["7"].name == "Port 7"
    assert shown(rows.where("portNumber = 7"), sections.port_sections()) == [["harbor", ("Size", "Small")], ["depths", ("Channel depth", "7.5")]]


def test_union_of_sources(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "id long, name string")
    b = spark.createDataFrame([("n-1", 2.0)], "id string, rating double")
    rows = federate.union_sources([("s1", a), ("s2", b)])
    assert sorted((r.id, r["rank"]) for r in rows.collect()) == [("s1-1", 0), ("s2-n-1", 1)]
    assert [(r.owner, r.raw_id) for r in federate.routed(rows.where("source = 's2'")).collect()] == [("s2", "n-1")]


@pytest.fixture()
def service():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)
            west, _, east, _ = map(float, asked["geometry"][0].split(","))
            every = [feature({"n": k}, (lon, 1.0), k) for k, lon in enumerate((179.0, 179.5, 180.0, -179.5, -179.0, 10.0))]
            if west == -180.0:
                every.append(feature({"n": 2}, (180.0, 1.0), 2))
            inside = [f for f in every if west <= f["geometry"]["coordinates"][0] <= east or (west == -180.0 and f["id"] == 2)]
            at, n = int(asked["resultOffset"][0]), int(asked["resultRecordCount"][0])
            body = json.dumps({"features": inside[at : at + n], "exceededTransferLimit": at + n < len(inside)}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_paged_features_over_the_antimeridian(spark, service):
    spark.dataSource.register(paged.PagedFeatures)
    read = spark.read.format("paged_features").option("url", service).option("layers", "0,1").option("pagerows", 2).option("bbox", "178,-5,-178,5")
    rows = paged.once(read.load())
    assert sorted((r.layer, int(r.feature_id)) for r in rows.collect()) == [(layer, k) for layer in "01" for k in range(5)]


class Asked(list):
    """A service of 400 features at random places, some at one place, with what it was asked for."""

    def __init__(self):
        super().__init__()
        rng = random.Random(5)
        self.places = {k: (rng.uniform(-180, 180), rng.uniform(-90, 90)) if k % 8 else (0.0, 0.0) for k in range(400)}

    def answer(self, url, timeout=None):
        query = urllib.parse.parse_qs(urllib.parse.urlparse(url).query)
        self.append((url.split("/")[-2], query))
        if "objectIds" in query:
            found = [int(k) for k in query["objectIds"][0].split(",") if int(k) in self.places]
        else:
            west, south, east, north = map(float, query["geometry"][0].split(","))
            found = [k for k, (lon, lat) in self.places.items() if west <= lon <= east and south <= lat <= north]
        at, n = int(query["resultOffset"][0]), int(query["resultRecordCount"][0])
        return io.BytesIO(json.dumps({"features": [feature({"k": k}, self.places[k], k) for k in found[at : at + n]], "exceededTransferLimit": at + n < len(found)}).encode())


def read_by(monkeypatch, filters=(), **options):
    asked = Asked()
    monkeypatch.setattr(paged.urllib.request, "urlopen", asked.answer)
    reader = paged.PushingReader({"url": "http://x", "layers": "0,1", **options})
    list(reader.pushFilters(list(filters)))
    return asked, [row for part in reader.partitions() for row in reader.read(part)]


def test_a_box_of_many_pages_is_read_by_its_quarters(monkeypatch):
    asked, rows = read_by(monkeypatch, layers="0", pagerows="10", maxpages="6")
    assert sorted(int(r[1]) for r in rows) == list(range(400)) and len(asked) > 40
    asked, rows = read_by(monkeypatch, layers="0", pagerows="10")
    assert len(asked) == 40
    with pytest.raises(ValueError, match="at one place"):  # 50 features at one place, 40 at most
        read_by(monkeypatch, layers="0", pagerows="10", maxpages="4")


def test_filters_become_requests(monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    asked, rows = read_by(monkeypatch, [EqualTo(("layer",), "1"), GreaterThanOrEqual(("lon",), 10.0), LessThan(("lat",), -20.0)])
    assert [(layer, q["geometry"]) for layer, q in asked] == [("1", ["10.0,-90.0,180.0,-20.0"])]
    assert {int(r[1]) for r in rows} == {k for k, (lon, lat) in asked.places.items() if lon >= 10 and lat <= -20}
    asked, rows = read_by(monkeypatch, [In(("feature_id",), ("7", "9", "5000"))])
    assert [q["objectIds"] for _, q in asked] == [["7,9,5000"]] * 2 and [r[:2] for r in rows] == [("0", "7"), ("0", "9"), ("1", "7"), ("1", "9")]
    assert not any("geometry" in q for _, q in asked)
    asked, rows = read_by(monkeypatch, [EqualTo(("layer",), "4")])
    assert not asked and not rows
    asked, rows = read_by(monkeypatch, [In(("feature_id",), tuple(map(str, range(250))))], layers="0")
    assert len(asked) == 3 and len(rows) == 250


def test_pushed_filters_through_spark(spark, service):
    frame = paged.opened(spark, url=service, layers="0,1", pagerows=2, bbox="178,-5,-178,5")
    rows = paged.once(frame.where("layer = '1' and lon > 179.2")).collect()
    assert sorted((r.layer, r.lon) for r in rows) == [("1", 179.5), ("1", 180.0)]
    assert frame.where("layer = '7'").count() == 0


def test_paged_features_are_whole(spark, service):
    spark.dataSource.register(paged.PagedFeatures)
    read = lambda pages: spark.read.format("paged_features").options(url=service, layers="0", pagerows=2, maxpages=pages, bbox="0,-5,180,5").load()
    for pages in (2, 1):  # one page is too little for the box, and enough for its quarters
        assert {int(r.feature_id) for r in read(pages).collect()} == {0, 1, 2, 5}


def test_paged_features_of_a_service_with_smaller_pages(monkeypatch):
    def answer(url, timeout):
        at = int(urllib.parse.parse_qs(urllib.parse.urlparse(url).query)["resultOffset"][0])
        return io.BytesIO(json.dumps({"features": [feature({}, ref=k) for k in range(at, min(at + 2, 7))], "exceededTransferLimit": at + 2 < 7}).encode())

    monkeypatch.setattr(paged.urllib.request, "urlopen", answer)
    reader = paged.PagedReader({"url": "http://x", "layers": "0", "bbox": "0,-5,180,5"})
    assert [row[1] for row in reader.read(reader.partitions()[0])] == list("0123456")
    monkeypatch.setattr(paged.urllib.request, "urlopen", lambda url, timeout: io.BytesIO(json.dumps({"features": [feature({}, ref=1)], "exceededTransferLimit": True}).encode()))
    with pytest.raises(ValueError, match="more is announced after 200 pages"):
        list(reader.read(reader.partitions()[0]))


def test_layers_are_fanned_out_and_failures_told(spark, tmp_path):
    (tmp_path / "coastal").mkdir()
    for layer, k in (("wreck", 5), ("rock", 6)):
        put(tmp_path / "coastal", f"{layer}.geojson", {"features": [feature({"OBJECTID": k}, ref=k)]})
    one = lambda name: (name, lambda: enc.summaries(enc.load(spark, f"{tmp_path}/coastal/{name}.geojson"), name))
    rows, failed = listing.fanned_out([one(name) for name in enc.LAYERS])
    assert {(r.layer, r.id) for r in rows.collect()} == {("wreck", "wreck_5"), ("rock", "rock_6")} and set(failed) == {"obstruction"}
    with pytest.raises(ValueError, match="no layer"):
        listing.fanned_out([one("obstruction")])
    assert {r.id for r in enc.layers(spark, str(tmp_path), "coastal", ["wreck", "rock"]).collect()} == {"wreck_5", "rock_6"}
    assert enc.layers(spark, str(tmp_path), "coastal", []).columns == enc.layers(spark, str(tmp_path), "coastal", ["rock"]).columns


def test_no_details_are_no_rows(spark):
    assert federate.details_of(spark.createDataFrame([("a-1",)], "id string"), []).count() == 0


def test_rows_of_long_work_are_spread_over_tasks(spark):
    """The part table is one split; its rows' details are parsed by many tasks."""
    from harborlight.plans import queries, source_queries  # noqa: F401  (registers)

    made = queries.QUERIES["community_sections"](spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(made) > 4 and max(r["count"] for r in made) < 0.5 * sum(r["count"] for r in made)


def test_courses_are_spread_over_tasks(spark):
    from harborlight.plans import queries, value_queries  # noqa: F401  (registers)

    made = queries.QUERIES["waypoints_ahead"](spark, "/root/testdata/sf0.01").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(made) > 4 and max(r["count"] for r in made) < 0.5 * sum(r["count"] for r in made)
