"""A Spark data source for feature services that give GeoJSON in pages.

    opened(spark, url=..., layers="0,1", bbox="w,s,e,n")

A row is (layer, feature_id, lon, lat, coordinates, properties as JSON). With the option pushfilters (opened sets it) filters become requests: `layer` chooses layers, ranges of `lon` and `lat`
cut the box (by default the world), and `feature_id` asks for features by their ids instead. One partition for each layer and each part of the box that
doesn't wrap, or for IDS ids. A partition reads page after page while the service says there is more; where it still says so
after maxpages pages (200 unless that option says otherwise), the box is read by its quarters, and so on: what is returned is
whole, or an error where a service announces more and gives nothing new.
"""

from __future__ import annotations

import json
import math
import urllib.parse
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..boxes import Box, parts
from ..operators.federate import first_by_key

PAGE_ROWS, MOST_PAGES, MOST_BYTES = 1000, 200, 64 << 20
#: Ids in a request.
IDS = 100


class Piece(InputPartition):
    """A layer, and a box (west, south, east, north) or ids of features."""

    def __init__(self, layer: str, envelope: tuple[float, float, float, float] | None, ids: tuple[str, ...] = ()):
        super().__init__((layer, envelope, ids))
        self.layer, self.envelope, self.ids = layer, envelope, ids


def quarters(envelope: tuple[float, float, float, float]) -> list[tuple[float, float, float, float]]:
    west, south, east, north = envelope
    lon, lat = (west + east) / 2, (south + north) / 2
    return [(west, south, lon, lat), (lon, south, east, lat), (west, lat, lon, north), (lon, lat, east, north)]


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self._url, self._layers = options["url"].rstrip("/"), [x.strip() for x in options["layers"].split(",")]
        self._rows, self._timeout = int(options.get("pagerows", PAGE_ROWS)), float(options.get("timeout", 30))
        self._pages = int(options.get("maxpages", MOST_PAGES))
        west, south, east, north = map(float, options.get("bbox", "-180,-90,180,90").split(","))
        self._boxes = parts(Box(south, north, west, east))
        self._bounds = {"lon": (-math.inf, math.inf), "lat": (-math.inf, math.inf)}
        self._ids: list[str] | None = None

    def partitions(self):
        if self._ids is not None:
            chunks = [tuple(self._ids[a : a + IDS]) for a in range(0, len(self._ids), IDS)]
            return [Piece(layer, None, ids) for layer in self._layers for ids in chunks]
        (west, east), (south, north) = self._bounds["lon"], self._bounds["lat"]
        cut = [(max(b.west, west), max(b.south, south), min(b.east, east), min(b.north, north)) for b in self._boxes]
        return [Piece(layer, e) for layer in self._layers for e in cut if e[0] <= e[2] and e[1] <= e[3]]

    def read(self, partition: Piece | None):
        if partition is None:  # no layer, or no box, is left
            return
        if partition.ids:
            for row in self._found(partition.layer, {"objectIds": ",".join(partition.ids)}):
                if any(self._holds((b.west, b.south, b.east, b.north), row, True, True) for b in self._boxes):
                    yield row
            return
        yield from self._within(partition.layer, partition.envelope, partition.envelope)

    @staticmethod
    def _holds(envelope, row, east_too: bool, north_too: bool) -> bool:
        (west, south, east, north), lon, lat = envelope, row[2], row[3]
        return lon is not None and lat is not None and west <= lon and south <= lat and (lon < east or east_too and lon <= east) and (lat < north or north_too and lat <= north)

    def _within(self, layer: str, envelope, whole):
        """A box's features. Of quarters that share an edge, the one east or north of it has what lies there."""
        asked = {"geometryType": "esriGeometryEnvelope", "geometry": ",".join(map(str, envelope)), "inSR": 4326}
        found = self._found(layer, asked)
        if found is None:
            if max(envelope[2] - envelope[0], envelope[3] - envelope[1]) < 1e-7:
                raise ValueError(f"{self._url}/{layer}: more is announced after {self._pages} pages at one place; raise maxpages or pagerows")
            for quarter in quarters(envelope):
                yield from self._within(layer, quarter, whole)
            return
        for row in found:
            if envelope == whole or self._holds(envelope, row, envelope[2] == whole[2], envelope[3] == whole[3]):
                yield row

    def _found(self, layer: str, asked: dict) -> list | None:
        """All rows of a request; None where more is announced after the last page."""
        offset, rows, seen, fresh = 0, [], set(), True
        for _ in range(self._pages):
            query = {"f": "geojson", "outFields": "*", **asked, "resultOffset": offset, "resultRecordCount": self._rows}
            url = f"{self._url}/{layer}/query?{urllib.parse.urlencode(query)}"
            with urllib.request.urlopen(url, timeout=self._timeout) as answer:
                body = answer.read(MOST_BYTES + 1)
            if len(body) > MOST_BYTES:
                raise ValueError(f"{url}: over {MOST_BYTES} bytes")
            got = json.loads(body)
            if "features" not in got:
                raise ValueError(f"{url}: {str(got)[:200]}")
            known = len(seen)
            for f in got["features"]:
                place = (f.get("geometry") or {}).get("coordinates")
                place = place and [float(x) for x in place]
                ref = f.get("id")
                row = (layer, None if ref is None else str(ref), *(place[:2] if place and len(place) > 1 else (None, None)), place, json.dumps(f.get("properties") or {}))
                rows.append(row)
                seen.add(str(row))
            fresh = len(seen) > known
            more = got.get("exceededTransferLimit") or (got.get("properties") or {}).get("exceededTransferLimit")
            if not more or not got["features"]:
                return rows
            offset += len(got["features"])
        if not fresh or "geometry" not in asked:
            raise ValueError(f"{self._url}/{layer}: more is announced after {self._pages} pages, and the last one had nothing new, or ids were asked for")
        return None


class PushingReader(PagedReader):
    """A reader into which Spark pushes filters; with these, it wants spark.sql.python.filterPushdown.enabled to be set."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if name == "layer" and values is not None:
                self._layers = [x for x in self._layers if x in values]
                continue
            if name == "feature_id" and values is not None and all(isinstance(v, str) and v.isascii() and v.isdigit() for v in values):
                asked = list(dict.fromkeys(values))
                self._ids = asked if self._ids is None else [x for x in self._ids if x in asked]
            elif name in self._bounds and isinstance(getattr(f, "value", None), (int, float)):
                low, high = self._bounds[name]
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low = max(low, f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = min(high, f.value)
                self._bounds[name] = (low, high)
            yield f  # a box takes in its edge, and services may match more: Spark looks again


class PagedFeatures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_features"

    def schema(self) -> str:
        return "layer string, feature_id string, lon double, lat double, coordinates array<double>, properties string"

    def reader(self, schema) -> DataSourceReader:
        return (PushingReader if self.options.get("pushfilters", "false").lower() == "true" else PagedReader)(self.options)


def opened(spark: SparkSession, **options) -> DataFrame:
    """The features of a service, with filters pushed into its requests."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedFeatures)
    return spark.read.format("paged_features").options(pushfilters="true", **options).load()


def once(rows: DataFrame) -> DataFrame:
    """Each feature of a layer once, as both parts of a box may have it; features without an id all stay."""
    return first_by_key(rows, ["layer", "feature_id"], [F.col("properties"), F.col("coordinates")])
