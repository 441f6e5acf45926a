"""File sources and sinks.

Tables are written as generations: a complete write goes to a new directory and only
then becomes current (a numbered pointer file is renamed into place; the newest one counts),
so readers never see a half-written table and a failed build keeps the old one. All paths are plain
Hadoop paths; on a cluster they live on shared storage.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# -- sources -------------------------------------------------------------------------


def day_partition_scan(spark: SparkSession, root: str, days: Sequence | None = None) -> DataFrame | None:
    """A source's per-day files (partition ``service_day``); a missing source is
    tolerated (returns None and the caller skips it)."""
    if not _exists(spark, root):
        print(f"{root}: no data, skipping")
        return None
    df = spark.read.parquet(root)
    if days is not None:
        df = df.filter(F.col("service_day").isin(*days))
    return df


def ch_csv_scan(spark: SparkSession, path: str) -> DataFrame:
    """S3: ';'-separated CSV with header, every column text."""
    cols = ["BETRIEBSTAG", "FAHRT_BEZEICHNER", "PRODUKT_ID", "LINIEN_ID", "LINIEN_TEXT", "VERKEHRSMITTEL_TEXT",
            "FAELLT_AUS_TF", "BPUIC", "HALTESTELLEN_NAME", "ANKUNFTSZEIT", "AN_PROGNOSE", "AN_PROGNOSE_STATUS",
            "ABFAHRTSZEIT", "AB_PROGNOSE", "DURCHFAHRT_TF"]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cols])
    return spark.read.option("sep", ";").option("header", True).schema(schema).csv(path)


ARCHIVE_SCHEMA = T.StructType([
    T.StructField("Service:RDT-ID", T.LongType()), T.StructField("Service:Date", T.DateType()),
    T.StructField("Service:Type", T.StringType()), T.StructField("Service:Train number", T.LongType()),
    T.StructField("Service:Completely cancelled", T.BooleanType()), T.StructField("Stop:RDT-ID", T.StringType()),
    T.StructField("Stop:Station code", T.StringType()), T.StructField("Stop:Station name", T.StringType()),
    T.StructField("Stop:Arrival time", T.TimestampNTZType()), T.StructField("Stop:Arrival delay", T.IntegerType()),
    T.StructField("Stop:Arrival cancelled", T.BooleanType()), T.StructField("Stop:Departure time", T.TimestampNTZType()),
    T.StructField("Stop:Departure delay", T.IntegerType()), T.StructField("Stop:Departure cancelled", T.BooleanType()),
])


def archive_csv_scan(spark: SparkSession, path: str) -> DataFrame:
    """Gzip CSV with header, explicit types; column names hold ':' and blanks."""
    return (spark.read.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss")
            .schema(ARCHIVE_SCHEMA).csv(path))


def gtfs_scan(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four timetable CSVs (landed unpacked), all columns text."""
    out = {}
    for name in ("routes", "trips", "stops", "stop_times"):
        out[name] = spark.read.option("header", True).option("inferSchema", False).csv(os.path.join(folder, f"{name}.txt"))
    return out


def crosswalk_scan(spark: SparkSession, path: str) -> DataFrame:
    """Station crosswalk JSON, either a map ``code -> {eva, name}`` or an array of
    ``{eva, hafas_id, name}``; returns rows (code, eva, name)."""
    raw = spark.read.text(path, wholetext=True)
    text = F.trim(F.col("value"))
    as_map = F.from_json(text, "MAP<STRING, STRUCT<eva: STRING, name: STRING>>")
    as_arr = F.from_json(text, "ARRAY<STRUCT<eva: STRING, hafas_id: STRING, name: STRING>>")
    m = raw.filter(text.startswith("{")).select(F.explode(as_map).alias("code", "v")) \
        .select("code", F.col("v.eva").alias("eva"), F.col("v.name").alias("name"))
    a = raw.filter(text.startswith("[")).select(F.explode(as_arr).alias("v")) \
        .select(F.coalesce(F.col("v.hafas_id"), F.col("v.eva")).alias("code"), F.col("v.eva").alias("eva"),
                F.col("v.name").alias("name"))
    return m.unionByName(a)


def multi_month_scan(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several monthly releases as one relation (by name; missing columns NULL)."""
    dfs = [spark.read.parquet(p) for p in paths]
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


# -- sinks ---------------------------------------------------------------------------


def _jvm_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _jvm_fs(spark, path)
    return fs.exists(p)


def _pointers(spark: SparkSession, table: str) -> list[tuple[int, object]]:
    """The table's pointer files by number, oldest first."""
    fs, p = _jvm_fs(spark, table)
    if not fs.exists(p):
        return []
    names = [(st.getPath().getName(), st.getPath()) for st in fs.listStatus(p)]
    return sorted(((int(n.split(".")[1]), path) for n, path in names if re.fullmatch(r"_CURRENT\.\d+", n)), key=lambda x: x[0])


def current_generation(spark: SparkSession, table: str) -> str | None:
    """Path of the table's current generation: what its newest pointer file names."""
    found = _pointers(spark, table)
    return _named(spark, table, found[-1][1]) if found else None


def _named(spark: SparkSession, table: str, pointer) -> str | None:
    """The generation that a pointer file names."""
    fs, _ = _jvm_fs(spark, table)
    jvm = spark.sparkContext._jvm
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(pointer), "UTF-8"))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    return line.strip() if line else None


def read_table(spark: SparkSession, table: str) -> DataFrame:
    gen = current_generation(spark, table)
    if gen is None:
        raise FileNotFoundError(f"{table} has no current generation")
    return spark.read.parquet(gen)


def _switch(spark: SparkSession, table: str, gen: str) -> None:
    """Point the table at ``gen``: a pointer file with the next number is written aside and
    renamed into place. The pointer before stays until the new one is there, so a reader, or a
    crash at any step, finds a complete table; older pointers, and the generations that they name,
    are dropped afterwards."""
    fs, _ = _jvm_fs(spark, table)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    before = _pointers(spark, table)
    tmp = path(f"{table}/_tmp.{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(gen.encode()))
    out.close()
    if not fs.rename(tmp, path(f"{table}/_CURRENT.{before[-1][0] + 1 if before else 0}")):
        raise RuntimeError(f"{table}: another writer switched it meanwhile")
    for _, old in before[:-1]:
        dead = _named(spark, table, old)
        fs.delete(old, False)
        if dead:
            fs.delete(path(dead), True)


def table_sink(df: DataFrame, table: str, check=None, partition_by: Sequence[str] = ()) -> str:
    """K1: write a new generation completely, run ``check(spark, path)`` on it (K4), then
    switch the table to it. A failing check raises and leaves the old generation current."""
    spark = df.sparkSession
    gen = os.path.join(table, f"gen-{uuid.uuid4().hex}")
    w = df.write.mode("error")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(gen)
    if check is not None:
        check(spark, gen)
    _switch(spark, table, gen)
    return gen


def serving_check(spark: SparkSession, path: str) -> None:
    """K4: read the new serving table back: keyed rows > 0 and the optional column
    present, else fail before the switch."""
    back = spark.read.parquet(path)
    if "reason_code" not in back.columns:
        raise RuntimeError(f"{path}: optional column reason_code missing")
    rows = back.filter(F.col("train_no").isNotNull()).limit(1).count()
    if not rows:
        raise RuntimeError(f"{path}: serving table is empty")


def day_sink(df: DataFrame, root: str, day_col: str = "service_day", force: bool = False) -> None:
    """K2: one directory per service day. Existing days are kept unless ``force``;
    with dynamic partition overwrite only the days present in ``df`` are replaced."""
    spark = df.sparkSession
    if not force and _exists(spark, root):
        present = spark.read.parquet(root).select(day_col).distinct()
        df = df.join(present, day_col, "left_anti")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day_col).parquet(root)


def day_finalise(state: DataFrame, root: str, today, build, day_col: str = "service_day", keep_ratio: float = 0.5) -> DataFrame:
    """Rebuild D-1 and D-2 from the observation state on each run (D-1 becomes final on
    D+1); only those two day partitions are overwritten, and a day whose new build has fewer
    than ``keep_ratio`` of its rows is kept as it is (K5). Returns the decision for each day."""
    from latewise.operators.national import shrink_guard
    from latewise.session import stored
    spark = state.sparkSession
    days = [today - _days(1), today - _days(2)]
    part = stored(build(state.filter(F.col(day_col).isin(*days))), "finalise")
    rows = lambda df: df.groupBy(F.col(day_col).alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    old = spark.read.parquet(root).filter(F.col(day_col).isin(*days)) if _exists(spark, root) else part.limit(0)
    decided = stored(shrink_guard(rows(part), rows(old), keep_ratio), "decisions")
    write = decided.filter("decision = 'write'").select(F.col("day").alias(day_col))
    kept = part.join(write, day_col, "left_semi")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day_col).parquet(root)
    return decided


def prune_days(spark: SparkSession, root: str, keep_from, day_col: str = "service_day") -> list:
    """K6: delete the day folders before ``keep_from``; the days deleted."""
    import datetime as dt
    fs, p = _jvm_fs(spark, root)
    gone = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith(f"{day_col}=") and (day := dt.date.fromisoformat(name.partition("=")[2])) < keep_from:
            fs.delete(st.getPath(), True)
            gone.append(day)
    return sorted(gone)


def _days(n: int):
    import datetime as dt
    return dt.timedelta(days=n)
