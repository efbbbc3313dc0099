"""Named queries of what is asked for, of labels and of page tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import folders, testbed
from ..functions import numbers, requests, text
from ..operators import sections, status, store
from .queries import _corner, query

#: The numbers of a text by the kind of the row: west, south, east, north. 5 and 6 are no box, 0 has no text.
_W, _S = "(event_id * 101 % 341 - 170)", "(event_id * 37 % 121 - 60)"
_TEXTS = {
    1: (_W, _S, f"({_W} + event_id % 18)", f"({_S} + event_id % 15)"), 2: ("175", _S, "(event_id % 3 - 175)", f"({_S} + 1)"), 3: (_W, _S, f"({_W} + 25)", f"({_S} + 1)"),
    4: (_W, f"({_S} + 1)", f"({_W} + 1)", _S), 7: (_W, "(85 + event_id % 4)", f"({_W} + 1)", "(89 + event_id % 4)"),
}
_NUMBERS = ", ".join(f"case event_id % 8 {' '.join(f'when {k} then {v[n]}' for k, v in _TEXTS.items())} end as {name}" for n, name in enumerate(("a", "b", "c", "d")))
_SPAN = "(case when c >= a then c - a else 360 - a + c end)"
BOXES_SQL = f"""numbers as (select event_id, {_NUMBERS} from events),
explicit as (select event_id, b::double as s, d::double as n, a::double as w, c::double as e from numbers
  where a between -180 and 180 and c between -180 and 180 and b >= -90 and d <= 90 and b <= d and d - b <= 20 and {_SPAN} <= 20),
near0 as (select event_id, {_S}::double as lat, {_W}::double as lon from events where event_id % 8 = 0 and event_id % 3 = 1),
near as (select event_id, {_corner("-45e0", "nw")}, {_corner("135e0", "se")} from near0),
boxes as (select event_id, lat_se / 1e6 as s, lat_nw / 1e6 as n, lon_nw / 1e6 as w, lon_se / 1e6 as e from near union all select * from explicit)"""


def _asked(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    rows = testbed.table(spark, sf_dir, "events").select("event_id", *(F.expr(f"case event_id % 8 {' '.join(f'when {k} then {v[n]}' for k, v in _TEXTS.items())} end").alias(name) for n, name in enumerate("abcd")))
    four = F.concat_ws(", ", *(F.col(c).cast("string") for c in "abcd"))
    asked = F.when(e % 8 == 5, "a,b,c,d").when(e % 8 == 6, "1, 2, 3").when(e % 8 != 0, F.when(e % 2 == 1, F.concat(F.lit("["), four, F.lit("]"))).otherwise(four))
    distance = F.when(e % 3 == 1, 500.0).when(e % 3 == 2, F.when(e % 5 == 0, 0.0).when(e % 5 == 1, -4.0).when(e % 5 == 2, 2e6).when(e % 5 == 3, float("nan")))
    return rows.select("event_id", requests.asked_box(asked, F.expr(f"cast({_S} as double)"), F.expr(f"cast({_W} as double)"), distance).alias("box")).where("box is not null")


def _e6(box: str):
    return [F.floor(F.col(f"{box}.{name}") * 1e6 + 0.5).cast("long").alias(f"{short}_e6") for short, name in zip("snwe", ("south", "north", "west", "east"))]


def _e6_sql(*columns: str) -> str:
    return ", ".join(f"cast(floor({x} * 1e6 + 0.5e0) as bigint) as {short}_e6" for short, x in zip("snwe", columns))


@query(
    "asked_boxes",
    f"""select event_id, 0 as part, {_e6_sql('s', 'n', 'w', 'case when w <= e then e else 180e0 end')} from boxes
      union all select event_id, 1, {_e6_sql('s', 'n', '-180e0', 'e')} from boxes where w > e""", BOXES_SQL,
)
def asked_boxes(spark, sf_dir):
    """Boxes from texts, good and bad, and around positions, in parts that don't wrap."""
    return _asked(spark, sf_dir).select("event_id", F.posexplode(requests.box_parts(F.col("box"))).alias("part", "b")).select("event_id", "part", *_e6("b"))


_WIDE = "(case when e >= w then e - w else 360 - w + e end)"


@query(
    "clamped_boxes",
    f"""select event_id, {_e6_sql(*(f"case when n - s <= 2 then {x} else (s + n) / 2 {sign} 1 end" for x, sign in (('s', '-'), ('n', '+'))),
      *(f"case when {_WIDE} <= 2 then {x} when w + {_WIDE} / 2 {sign} 1 > 180 then w + {_WIDE} / 2 {sign} 1 - 360 else w + {_WIDE} / 2 {sign} 1 end" for x, sign in (('w', '-'), ('e', '+'))))} from boxes""",
    BOXES_SQL,
)
def clamped_boxes(spark, sf_dir):
    """Boxes of two degrees at most about their middle, over the antimeridian too."""
    return _asked(spark, sf_dir).select("event_id", requests.clamped_box(F.col("box")).alias("b")).select("event_id", *_e6("b"))


@query(
    "numbers_of_texts",
    """select event_id, case event_id % 9 when 0 then event_id * 1e3 when 1 then 2500 when 2 then -500 when 3 then 25000 end::bigint as milli from events""",
)
def numbers_of_texts(spark, sf_dir):
    e = F.col("event_id")
    raw = F.get(F.array(e.cast("string"), F.lit(" 2.5 "), F.lit("-.5"), F.lit("2.5e1"), F.lit(""), F.lit("NaN"), F.lit("Infinity"), F.lit("12x"), F.lit(None).cast("string")), (e % 9).cast("int"))
    return testbed.table(spark, sf_dir, "events").select("event_id", numbers.scaled(requests.number_of(raw), 1e3).alias("milli"))


@query("one_decimal", "select event_id, case when event_id % 2 = 0 then '-' else '' end || (floor(value * 10 + 0.5e0)::bigint // 10) || '.' || (floor(value * 10 + 0.5e0)::bigint % 10) as shown from events where value > 0")
def one_decimal(spark, sf_dir):
    value = F.when(F.col("event_id") % 2 == 0, -F.col("value")).otherwise(F.col("value"))
    return testbed.table(spark, sf_dir, "events").where("value > 0").select("event_id", sections._one_decimal(value).alias("shown"))


@query(
    "labelled_paragraphs",
    """select p_partkey as k, '<p><strong>Part:</strong> ' || replace(replace(p_name, '&', '&amp;'), '<', '&lt;') || ' &lt;&quot;' || p_brand || '&quot;&gt;</p>' as html from part""",
)
def labelled_paragraphs(spark, sf_dir):
    value = F.concat("p_name", F.lit(' <"'), "p_brand", F.lit('">'))
    return testbed.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), text.paragraph("Part", value).alias("html"))


@query(
    "unreachable_sources",
    "select source from (select user_id % 40 as source, arg_max(event_id % 3 <> 0, event_id) as ok from events group by 1) where not ok",
)
def unreachable_sources(spark, sf_dir):
    log = testbed.table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("source"), F.col("event_id").alias("at"), (F.col("event_id") % 3 != 0).alias("ok"))
    return status.unreachable(log)


@query(
    "pages_replaced",
    """select l_orderkey, l_linenumber, page, quantity from (select l_orderkey, l_linenumber, l_orderkey % 12 as page, l_quantity + case when l_orderkey % 12 in (2, 5) then 100 else 0 end as quantity from lineitem)
      where page <> 7 and not (page = 5 and l_linenumber > 2)""",
)
def pages_replaced(spark, sf_dir):
    """A table of pages of which two are replaced, one with fewer rows, and one is no longer in the catalogue."""
    rows = testbed.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 12).alias("page"), F.col("l_quantity").alias("quantity"))
    path = folders.scratch_path(spark, "pages")
    store.replace_pages(rows, path)
    fresh = rows.where("page = 2 or (page = 5 and l_linenumber <= 2)").withColumn("quantity", F.col("quantity") + 100)
    store.replace_pages(fresh, path)
    catalogue = rows.where("page <> 7").select("page").distinct()
    return store.read_pages(spark, path, catalogue).select("l_orderkey", "l_linenumber", F.col("page").cast("long").alias("page"), "quantity")
