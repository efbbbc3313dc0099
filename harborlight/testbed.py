"""Points of interest, vessel fixes and a route derived from the driver's tables by integer arithmetic.

The same derivation is written twice: as DataFrames here, and as SQL text (POI_SQL, FIXES_SQL) for the checks against DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("Hazard", "Bridge", "Lock", "Marina", "Anchorage", "Navigational", "Business")
SOURCES = ("activecaptain", "openseamap", "noaaenc")
#: A polyline through the middle of the points' box; the fourth leg has no length.
ROUTE = ((42.001, -70.999), (42.006, -70.993), (42.011, -70.995), (42.011, -70.995), (42.015, -70.984), (42.019, -70.981))

POI_SQL = """
k(g, source, k, bk) as (
  select 0, 'activecaptain', p_partkey, p_partkey from part
  union all select 1, 'openseamap', c_custkey, c_custkey from customer
  union all select 2, 'noaaenc', s_suppkey, s_suppkey * 3 from supplier
), k2 as (
  select *, (bk * 31 + case when g > 0 and k % 4 = 0 then 1 else 0 end) % 7 as ti,
         case when g = 0 then 0 else (k * 37 + g * 11) % 101 - 50 end as o1,
         case when g = 0 then 0 else (k * 53 + g * 17) % 101 - 50 end as o2
  from k
), poi as (
  select g * 1000000000 + k as seq, source || '-' || k as id, source,
         ['Hazard','Bridge','Lock','Marina','Anchorage','Navigational','Business'][(ti + 1)::int] as type,
         42e0 + ((bk * 7919) % 20011 + o1 * 10) / 1e6 as lat, -71e0 + ((bk * 104729) % 20021 + o2 * 10) / 1e6 as lon,
         'Point ' || k as name, source || ' data' as attribution,
         case when k % 4 <> 1 then ((k * 7) % 51) / 1e1 end as rating, k % 20 as review_count,
         case when k % 5 <> 2 then make_timestamp((1420070400 + (k * 37 % 4000) * 86400) * 1000000) end as ts,
         case when ti = 1 and k % 3 <> 0 then ((k * 13) % 200 + 20) / 1e1 end as clearance_m
  from k2
)"""

FIXES_SQL = """
fixes as (
  select user_id % 10 as vessel, event_id, ts, 42e0 + ((event_id * 6151) % 20011) / 1e6 as lat,
         -71e0 + ((event_id * 9973) % 20021) / 1e6 as lon, value as sog,
         case when event_id % 3 = 0 then (event_id % 90) / 1e1 end as air_draft
  from events
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows over all cores, four tasks each: small files of few splits may have rows that are long work, or are joined with many others."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(g: int, name: str, key: str, times: int) -> DataFrame:
        k = F.col(key).cast("long")
        return table(spark, sf_dir, name).select(F.lit(g).alias("g"), F.lit(SOURCES[g]).alias("source"), k.alias("k"), (k * times).alias("bk"))

    k, g, bk = F.col("k"), F.col("g"), F.col("bk")
    every = rows(0, "part", "p_partkey", 1).union(rows(1, "customer", "c_custkey", 1)).union(rows(2, "supplier", "s_suppkey", 3))
    every = every.withColumns({
        "ti": (bk * 31 + F.when((g > 0) & (k % 4 == 0), 1).otherwise(0)) % 7,
        "o1": F.when(g == 0, 0).otherwise((k * 37 + g * 11) % 101 - 50),
        "o2": F.when(g == 0, 0).otherwise((k * 53 + g * 17) % 101 - 50),
    })
    return every.select(
        (g.cast("long") * 1_000_000_000 + k).alias("seq"), F.concat_ws("-", "source", k.cast("string")).alias("id"), "source",
        F.element_at(F.array(*map(F.lit, KINDS)), (F.col("ti") + 1).cast("int")).alias("type"),
        (42.0 + ((bk * 7919) % 20011 + F.col("o1") * 10) / 1e6).alias("lat"),
        (-71.0 + ((bk * 104729) % 20021 + F.col("o2") * 10) / 1e6).alias("lon"),
        F.concat(F.lit("Point "), k.cast("string")).alias("name"), F.concat("source", F.lit(" data")).alias("attribution"),
        F.when(k % 4 != 1, ((k * 7) % 51) / 10.0).alias("rating"), (k % 20).alias("review_count"),
        F.when(k % 5 != 2, F.timestamp_micros((F.lit(1420070400) + (k * 37 % 4000) * 86400) * 1000000)).alias("ts"),
        F.when((F.col("ti") == 1) & (k % 3 != 0), ((k * 13) % 200 + 20) / 10.0).alias("clearance_m"),
    )


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("vessel"), "event_id", "ts", (42.0 + ((e * 6151) % 20011) / 1e6).alias("lat"),
        (-71.0 + ((e * 9973) % 20021) / 1e6).alias("lon"), F.col("value").alias("sog"),
        F.when(e % 3 == 0, (e % 90) / 10.0).alias("air_draft"),
    )
