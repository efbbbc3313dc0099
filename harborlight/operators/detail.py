"""Detail sections, notes and their sink form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escaped, lookup, safe_link

# Icons by kind.
ICONS = {
    "Hazard": "hazard", "Bridge": "bridge", "Lock": "lock", "Marina": "marina", "Anchorage": "anchorage",
    "Navigational": "navigation-structure", "Business": "business", "BoatRamp": "boatramp", "Dam": "dam", "Ferry": "ferry", "Inlet": "inlet",
}
DEFAULT_ICON = "notice-to-mariners"
ITEM = "struct<label:string,value:string,kind:string,unit:string>"


def icon(kind: Column) -> Column:
    return F.coalesce(lookup(ICONS, kind), F.lit(DEFAULT_ICON))


def item(label: str, value: Column, kind: str = "text", unit: str | None = None) -> Column:
    """An item of a section; null where there is no value."""
    made = F.struct(F.lit(label).alias("label"), value.cast("string").alias("value"), F.lit(kind).alias("kind"), F.lit(unit).cast("string").alias("unit"))
    return F.when(F.nullif(value.cast("string"), F.lit("")).isNotNull(), made)


def sections(parts: list[tuple[str, str, list[Column]]]) -> Column:
    """Sections (id, title, items) that have items, in order."""
    made = [
        F.struct(F.lit(name).alias("id"), F.lit(title).alias("title"), F.filter(F.array(*items), lambda i: i.isNotNull()).alias("items"))
        for name, title, items in parts
    ]
    return F.filter(F.array(*made), lambda s: F.size(s["items"]) > 0)


def description(made: Column) -> Column:
    """The sections as HTML: a heading and a paragraph for each item."""

    def one(s: Column) -> Column:
        lines = F.transform(
            s["items"],
            lambda i: F.concat(
                F.lit("<p><strong>"), escaped(i["label"]), F.lit(":</strong> "), escaped(i["value"]),
                F.coalesce(F.concat(F.lit(" "), escaped(i["unit"])), F.lit("")), F.lit("</p>"),
            ),
        )
        return F.concat(F.lit("<h4>"), escaped(s["title"]), F.lit("</h4>"), F.array_join(lines, ""))

    return F.array_join(F.transform(made, one), "")


def notes(rows: DataFrame, html: Column | None = None) -> DataFrame:
    """(id, note): each row (id, name, lat, lon, url, sources, type) as a JSON note; absent values have no field.

    Sources are named only if there are several, a link only if its scheme is allowed, a type of text only with text. The icon is the
    row's own sk_icon, else its kind's.
    """
    own = F.col("sk_icon") if "sk_icon" in rows.columns else F.lit(None).cast("string")
    html = F.lit(None).cast("string") if html is None else html
    sources = F.when(F.size("sources") > 1, F.col("sources"))
    note = F.struct(
        F.col("name"), F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("position"),
        safe_link(F.col("url")).alias("url"), html.alias("description"), F.when(html.isNotNull(), F.lit("text/html")).alias("mimeType"),
        F.struct(F.coalesce(own, icon(F.col("type"))).alias("skIcon"), sources.alias("sources")).alias("properties"),
    )
    return rows.select("id", F.to_json(note).alias("note"))


def property_of(note: Column, path: str) -> Column:
    """The value at a dotted path of a JSON note, null if it isn't there."""
    return F.get_json_object(note, "$." + path)


def parsed(note: Column) -> Column:
    """A JSON note as a variant, parsed once for all that is read of it; null where it is no JSON."""
    return F.try_parse_json(note)


def _path(names: list[str | int]) -> str:
    """Names one below another, with dots or not, and places in arrays. A name may hold one kind of quotes."""
    if any(isinstance(n, str) and ("'" in n and '"' in n or not n) for n in names):
        raise ValueError(f"no path leads to {names}")
    return "$" + "".join(f"[{n}]" if isinstance(n, int) else f'["{n}"]' if "'" in n else f"['{n}']" for n in names)


def typed_property(note: Column, names: list[str | int], kind: str) -> Column:
    """The value of a variant note there, as a type; null where it is missing, null, or can't be that type."""
    return F.try_variant_get(note, _path(names), kind)


def property_kind(note: Column, names: list[str | int]) -> Column:
    """What there is: `null`, or the type's name (BIGINT, STRING, BOOLEAN, OBJECT, ARRAY, ...); null where nothing is."""
    value = F.try_variant_get(note, _path(names), "variant")
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.when(value.isNotNull(), F.when(F.is_variant_null(value), "null").otherwise(kind))
