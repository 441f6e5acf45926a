"""Serving table and its summaries.

The serving table materialises the lookup key ``train_no`` and the day an event is filed under.
It is stored in a folder for each ``service_day``, sorted by (``train_no``, ``eva``) inside: a
window of days reads its folders only, and Parquet min/max statistics let a lookup on the key
skip row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latewise.functions.keys import strip_zeros, train_key
from latewise.functions.text import fold_name
from latewise.operators.matching import service_day


SERVING_ORDER = ["service_day", "train_no", "eva"]
#: Layout of the stored files: row groups small enough that a lookup reads little, page indexes
#: inside them (Parquet's default), and Bloom filters for lookups by a key that the order does not
#: serve, a station alone. A Bloom filter needs plain pages, so that column has no dictionary.
LAYOUT = {"parquet.block.size": str(8 << 20), "parquet.page.row.count.limit": "5000", "parquet.bloom.filter.enabled#eva": "true",
          "parquet.bloom.filter.expected.ndv#eva": "4096", "parquet.enable.dictionary#eva": "false"}


def serving_table(events: DataFrame, partitions: int | None = None) -> DataFrame:
    """K3 content: stop events + ``train_no`` + ``service_day``, range-partitioned and sorted."""
    keyed = events.withColumns({"train_no": train_key(), "service_day": service_day()})
    keyed = keyed.repartitionByRange(partitions, *SERVING_ORDER) if partitions else keyed.repartitionByRange(*SERVING_ORDER)
    return keyed.sortWithinPartitions(*SERVING_ORDER)


def write_serving(events: DataFrame, path: str, partitions: int | None = None) -> None:
    serving_table(events, partitions).write.mode("overwrite").options(**LAYOUT).partitionBy("service_day").parquet(path)


def lookups(spark, path: str, asked: list[tuple]) -> DataFrame:
    """The rows of (service_day, train_no, eva) keys that a request asks for: few, as literals, so
    that they reach the scan (folders by day, row groups and pages by train and station)."""
    hit = F.lit(False)
    for day, train, eva in asked:
        hit = hit | ((F.col("service_day") == F.lit(day)) & (F.col("train_no") == F.lit(train)) & (F.col("eva") == F.lit(eva)))
    return spark.read.parquet(path).filter(hit)


def coverage(events: DataFrame) -> DataFrame:
    """A4: min and max planned-arrival day."""
    d = F.to_date("arrival_planned_time")
    return (events.filter(F.col("arrival_planned_time").isNotNull())
            .agg(F.min(d).alias("min_day"), F.max(d).alias("max_day")))


def row_count(events: DataFrame) -> DataFrame:
    """A5."""
    return events.agg(F.count(F.lit(1)).alias("rows"))


def station_volume(events: DataFrame) -> DataFrame:
    """Rows per (eva, name); blank names dropped."""
    return (events.filter(F.col("station_name").isNotNull() & (F.col("station_name") != "")
                          & F.col("eva").isNotNull())
            .groupBy("eva", "station_name").agg(F.count(F.lit(1)).alias("cnt")))


def station_index(events: DataFrame) -> DataFrame:
    """One entry per folded name - the busiest (eva, name) (ties: eva, then name),
    volume summed over the name's ids, main-station flag, unpadded id, location id."""
    vol = station_volume(events).withColumn("norm", fold_name("station_name"))
    best = (vol.groupBy("norm").agg(
        F.sum("cnt").alias("total"),
        F.min(F.struct((-F.col("cnt")).alias("neg"), "eva", "station_name")).alias("_b")))
    ext = strip_zeros(F.col("_b.eva"))
    return best.select(
        "norm", F.col("_b.station_name").alias("name"), F.col("_b.eva").alias("eva"),
        ext.alias("ext_id"),
        F.concat(F.lit("A=1@O="), F.col("_b.station_name"), F.lit("@L="), ext, F.lit("@")).alias("loc_id"),
        "total",
        F.array_contains(F.split("norm", " "), "hbf").alias("is_main"))


def station_search(index: DataFrame, queries: DataFrame, limit: int = 8) -> DataFrame:
    """T2 (batch form): for each query (``query_id, query``) up to ``limit`` stations:
    prefix match 0, word start 1, other substring 2; main stations first, then volume;
    a blank query matches nothing.

    Exact substring search without a cross join: a name is filed under its distinct pieces of
    one, two and three letters, a query is looked up by its first three (or all of a shorter
    one), and every hit is verified on the whole query."""
    q = (queries.withColumn("q", fold_name("query")).filter(F.col("q") != "")
         .select("query_id", "q"))
    n = F.length("norm")
    pieces = F.array_distinct(F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.when(
        n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col("norm"), i, k))).otherwise(F.array().cast("array<string>")))))
    filed = index.withColumn("piece", F.explode(pieces))
    rank = (F.when(F.startswith("norm", "q"), 0).when(F.contains("norm", F.concat(F.lit(" "), "q")), 1).otherwise(2))
    hits = q.join(filed, F.substring("q", 1, 3) == F.col("piece")).filter(F.contains("norm", "q")).withColumn("rank", rank)
    w = Window.partitionBy("query_id").orderBy(
        "rank", F.when(F.col("is_main"), 0).otherwise(1), F.desc("total"), "norm")
    return (hits.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= limit)
            .select("query_id", "pos", "loc_id", "ext_id", "name"))


def busiest_stations(events: DataFrame, n: int = 10) -> DataFrame:
    """Top n stations by events (ties: eva)."""
    return (events.groupBy("eva").agg(F.count(F.lit(1)).alias("events"))
            .orderBy(F.desc("events"), "eva").limit(n))
