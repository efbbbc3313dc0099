"""Seamarks of a volunteer map, from landed query responses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clearance_m, light_character, lookup, present, spaced_enum
from .common import as_poi

SOURCE, ATTRIBUTION = "openseamap", "OpenStreetMap contributors"
# Kind, icon and label by seamark type.
SEAMARKS = {
    "rock": ("Hazard", "hazard", "Rock"), "wreck": ("Hazard", "hazard", "Wreck"), "obstruction": ("Hazard", "hazard", "Obstruction"),
    "harbour": ("Marina", "marina", "Harbour"), "marina": ("Marina", "marina", "Marina"), "lock_basin": ("Lock", "lock", "Lock"),
    "bridge": ("Bridge", "bridge", "Bridge"), "light_major": ("Navigational", "navigation-structure", "Major light"),
    "light_minor": ("Navigational", "navigation-structure", "Minor light"),
    "light_float": ("Navigational", "navigation-structure", "Light float"),
    "light_vessel": ("Navigational", "navigation-structure", "Light vessel"),
    "landmark": ("Navigational", "navigation-structure", "Landmark"),
    "beacon_lateral": ("Navigational", "navigation-structure", "Lateral beacon"),
    "beacon_cardinal": ("Navigational", "navigation-structure", "Cardinal beacon"),
    "beacon_isolated_danger": ("Navigational", "hazard", "Isolated-danger beacon"),
    "beacon_safe_water": ("Navigational", "navigation-structure", "Safe-water beacon"),
    "beacon_special_purpose": ("Navigational", "navigation-structure", "Special-purpose beacon"),
    "buoy_lateral": ("Navigational", "navigation-structure", "Lateral buoy"),
    "buoy_cardinal": ("Navigational", "navigation-structure", "Cardinal buoy"),
    "buoy_isolated_danger": ("Navigational", "hazard", "Isolated-danger buoy"),
    "buoy_safe_water": ("Navigational", "navigation-structure", "Safe-water buoy"),
    "buoy_special_purpose": ("Navigational", "navigation-structure", "Special-purpose buoy"),
    "anchorage": ("Anchorage", "anchorage", "Anchorage"), "anchor_berth": ("Anchorage", "anchorage", "Anchor berth"),
    "mooring": ("Anchorage", "anchorage", "Mooring"),
}
OTHER_ICON = "notice-to-mariners"
# Tags that may hold a bridge's clearance, in order.
CLEARANCE_TAGS = ("seamark:bridge:clearance_height", "maxheight", "maxheight:physical", "clearance")

SCHEMA = (
    "elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,"
    "tags:map<string,string>,timestamp:string>>"
)


def tag(tags: Column, name: str) -> Column:
    return F.try_element_at(tags, F.lit(name))


def marking(tags: Column) -> Column:
    """The struct (type, icon) of an element by its seamark type, else as a marina, else unknown."""
    mark = F.nullif(F.lower(F.trim(tag(tags, "seamark:type"))), F.lit(""))
    marina = F.coalesce(F.lower(F.trim(tag(tags, "leisure"))) == "marina", F.lit(False))
    kinds, icons = {k: v[0] for k, v in SEAMARKS.items()}, {k: v[1] for k, v in SEAMARKS.items()}
    kind = F.when(mark.isNotNull(), F.coalesce(lookup(kinds, mark), F.lit("Unknown"))).when(marina, "Marina").otherwise("Unknown")
    icon = F.when(mark.isNotNull(), F.coalesce(lookup(icons, mark), F.lit(OTHER_ICON))).when(marina, "marina").otherwise(OTHER_ICON)
    return F.struct(kind.alias("type"), icon.alias("icon"))


def light_line(tags: Column) -> Column:
    """One line on an element's light, null where no tag says anything of it."""
    get = lambda name: present(tag(tags, f"seamark:light:{name}"))
    around = lambda before, x, after: F.concat(F.lit(before), x, F.lit(after))
    line = F.concat_ws(
        ", ", light_character(get("character")), spaced_enum(get("colour")), around("", get("period"), " s period"), around("", get("range"), " NM range"),
        around("", get("height"), " m high"), around("shown at ", spaced_enum(get("exhibition")), ""),
    )
    return F.nullif(line, F.lit(""))


def bridge_clearance(tags: Column) -> Column:
    """The first clearance tag that can be read."""
    return F.coalesce(*(clearance_m(tag(tags, k)) for k in CLEARANCE_TAGS))


def of_groups(tags: Column, marks: list[str], marinas: bool) -> Column:
    """Whether an element has one of the seamark types, or is a marina where those are asked for."""
    wanted = [tag(tags, "seamark:type").isin(*marks)] if marks else [F.lit(False)]
    if marinas:
        wanted.append(tag(tags, "leisure") == "marina")
    return F.coalesce(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), wanted), F.lit(False))


def load(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    return raw.select(F.explode("elements").alias("e")).select("e.*")


def summaries(rows: DataFrame) -> DataFrame:
    mark = marking(F.col("tags"))
    kind = mark["type"]
    known = F.col("type").isin("node", "way", "relation") & (F.col("id") > 0)
    ref = F.when(known, F.concat_ws("_", "type", F.col("id").cast("string")))
    name = F.coalesce(present(tag(F.col("tags"), "name")), present(tag(F.col("tags"), "seamark:name")), F.concat(F.lit("Unnamed "), F.lower(kind)))
    return as_poi(
        rows, SOURCE, ATTRIBUTION, id=ref, type=kind, lat=F.coalesce("lat", "center.lat"), lon=F.coalesce("lon", "center.lon"), name=name,
        url=F.concat(F.lit("https://www.openstreetmap.org/"), "type", F.lit("/"), F.col("id").cast("string")), sk_icon=mark["icon"],
        ts=F.try_to_timestamp("timestamp"), clearance_m=F.when(kind == "Bridge", bridge_clearance(F.col("tags"))),
    )
