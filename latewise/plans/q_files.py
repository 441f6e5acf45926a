"""Sinks and day bookkeeping, written and read back: K1, K2, K4, K6, K7, I5, S2, S11."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from latewise.operators import reports as RP
from latewise.operators import serving as SV
from latewise.plans.q_national import scratch
from latewise.plans.q_reports import _files, _missing
from latewise.plans.registry import fixture, query
from latewise.sources import files

CUT, TODAY = dt.date(2026, 7, 10), dt.date(2026, 7, 20)


def _events(fx):
    return fx.keyed.drop("train_no")


def _content(df):
    return df.groupBy("service_day", (F.col("station_name") == "changed").alias("changed")).agg(F.count(F.lit(1)).alias("n"))


@query("table_sink", "SELECT service_day, train_no, count(*) AS n FROM keyed GROUP BY service_day, train_no")
def table_sink(spark, sf_dir):
    """K1/K4: the serving table as a first generation of half the days, then a second of all,
    each read back before the switch; what readers see is the second."""
    table, se = scratch(spark, "serving"), fixture(spark, sf_dir).stop_events
    files.table_sink(SV.serving_table(se.filter(F.dayofmonth("time") > 15)), table, check=files.serving_check, partition_by=("service_day",))
    files.table_sink(SV.serving_table(se), table, check=files.serving_check, partition_by=("service_day",))
    return files.read_table(spark, table).groupBy("service_day", "train_no").agg(F.count(F.lit(1)).alias("n"))


@query("day_sink", f"""
SELECT service_day, service_day > DATE '{CUT}' AS changed, count(*) AS n FROM keyed GROUP BY service_day""")
def day_sink(spark, sf_dir):
    """K2: days up to the 10th are there; a second run with all days keeps those."""
    root, se = scratch(spark, "days"), _events(fixture(spark, sf_dir))
    files.day_sink(se.filter(F.col("service_day") <= CUT), root)
    files.day_sink(se.withColumn("station_name", F.lit("changed")), root)
    return _content(spark.read.parquet(root))


@query("day_partition_scan", f"""
SELECT service_day, id FROM keyed WHERE service_day IN (DATE '{CUT}', DATE '{TODAY}')""")
def day_partition_scan(spark, sf_dir):
    """Two days out of a source's day folders."""
    root = scratch(spark, "days")
    files.day_sink(_events(fixture(spark, sf_dir)), root)
    return files.day_partition_scan(spark, root, [CUT, TODAY]).select("service_day", "id")


@query("day_finalise", f"""
SELECT service_day, service_day = DATE '{TODAY}' - 1 AS changed, count(*) AS n FROM keyed GROUP BY service_day""")
def day_finalise(spark, sf_dir):
    """I5 with K5: D-1 is rebuilt, the new build of D-2 is too small and its day is kept."""
    root, se = scratch(spark, "days"), _events(fixture(spark, sf_dir))
    files.day_sink(se, root)
    small = (F.col("service_day") == TODAY - dt.timedelta(days=2)) & (F.col("train_line_station_num") > 1)
    files.day_finalise(se.filter(~small), root, TODAY, build=lambda d: d.withColumn("station_name", F.lit("changed")))
    return _content(spark.read.parquet(root))


@query("retention_prune", f"SELECT service_day, count(*) AS n FROM keyed WHERE service_day >= DATE '{TODAY}' GROUP BY service_day")
def retention_prune(spark, sf_dir):
    """K6: the folders of the days before the 20th are deleted."""
    root = scratch(spark, "days")
    files.day_sink(_events(fixture(spark, sf_dir)), root)
    files.prune_days(spark, root, TODAY)
    return spark.read.parquet(root).groupBy("service_day").agg(F.count(F.lit(1)).alias("n"))


@query("rebuild_needed", """
SELECT count(*) FILTER (WHERE s.stamp IS NULL OR n.newest_raw > s.stamp) AS reparsed,
       count(*) FILTER (WHERE s.stamp IS NULL OR n.newest_raw > s.stamp) > 0 AS rebuild
FROM (SELECT day, max(mtime) AS newest_raw FROM o_files GROUP BY day) n LEFT JOIN o_stamps s ON s.day = n.day""")
def rebuild_needed(spark, sf_dir):
    """K7: whether a build of today has to be made anew."""
    f, st = _files(fixture(spark, sf_dir))
    return RP.rebuild_needed(RP.stale_days(f, st), TODAY, TODAY)


@query("replay_finalise", """
WITH got AS (SELECT DISTINCT day FROM (SELECT day FROM o_missing UNION ALL SELECT CAST(day + 1 AS DATE) FROM o_missing) WHERE dayofmonth(day) % 5 > 0)
SELECT m.day, (SELECT count(*) FROM got WHERE got.day = m.day + 1) > 0 AS complete FROM o_missing m WHERE m.day IN (SELECT day FROM got)""")
def replay_finalise(spark, sf_dir):
    """Which missing days a replay consolidates, when every fifth day's archive is not on
    the mirror, and which of them with the day after ingested."""
    missing = _missing(fixture(spark, sf_dir))
    ingested = RP.ingest_days(missing, dt.date(2026, 7, 31)).filter(F.dayofmonth("day") % 5 > 0)
    return RP.finalise_order(missing, ingested)
