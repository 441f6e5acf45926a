"""Reports, day bookkeeping and raw scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latewise.functions.keys import strip_zeros
from latewise.operators.ordered import nearest_rank, positions


def trains_by_station_hour(events: DataFrame, stations: DataFrame, min_events: int = 5) -> DataFrame:
    """Per (station, arrival hour) the trains with at least ``min_events`` events,
    as a sorted pool (comma-joined). ``stations`` (``eva``) restricts the stations."""
    g = (events.filter(F.col("arrival_planned_time").isNotNull())
         .groupBy("eva", F.hour("arrival_planned_time").alias("h"), strip_zeros("train_number").alias("t"))
         .agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= min_events))
    # the counts meet the stations, not the events
    g = g.join(stations.select("eva").distinct(), "eva", "left_semi")
    return g.groupBy("eva", "h").agg(F.array_join(F.sort_array(F.collect_list("t")), ",").alias("pool"))


# Load-test pass limits (endpoint -> percentile, milliseconds).
PASS_CRITERIA = {"canary": ("p99", 250), "journeys_future": ("p95", 800), "journeys_past": ("p95", 800),
                 "static": ("p99", 300)}
QUANTILES = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}
MAX_ERROR_RATE = 0.005


def request_report(log: DataFrame, duration_s: Column) -> DataFrame:
    """Per endpoint n, nearest-rank percentiles (index ``min(n-1, int(n*p))`` of the
    sorted samples), max, errors, throughput, threshold breach; plus the total error-rate
    breach. Samples are ordered as distinct values with counts, in ranges."""
    ok = log.filter(~F.col("is_error"))
    pct = positions(ok.select("endpoint", "ms"), "ms", ["endpoint"]).groupBy("endpoint").agg(
        F.max("_n").alias("n"), F.max("ms").alias("max"), *(nearest_rank("ms", p).alias(name) for name, p in QUANTILES.items()))
    errs = log.groupBy("endpoint").agg(F.sum(F.col("is_error").cast("int")).cast("long").alias("errors"),
                                       F.count(F.lit(1)).alias("total"))
    r = errs.join(pct, "endpoint", "left")
    breach = F.lit(False)
    for ep, (metric, limit) in PASS_CRITERIA.items():
        breach = breach | ((F.col("endpoint") == ep) & F.coalesce(F.col(metric) > limit, F.lit(False)))
    total_err = log.select(F.sum(F.col("is_error").cast("int")) / F.count(F.lit(1))).scalar()
    return r.select("endpoint", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
                    *[F.round(name, 1).alias(name) for name in QUANTILES], F.round("max", 1).alias("max"), "errors",
                    F.round(F.col("total") / duration_s, 2).alias("rps"), breach.alias("breach"),
                    (total_err > MAX_ERROR_RATE).alias("error_rate_breach"))


def message_counts(raw: DataFrame, plan_rows: DataFrame, change_rows: DataFrame) -> DataFrame:
    """Per day the successful responses, plan rows and change rows."""
    r = raw.filter(F.col("status_code") == "200").groupBy("day").agg(F.count(F.lit(1)).alias("responses"))
    p = plan_rows.groupBy("day").agg(F.count(F.lit(1)).alias("plan_rows"))
    c = change_rows.groupBy("day").agg(F.count(F.lit(1)).alias("change_rows"))
    return (r.join(p, "day", "left").join(c, "day", "left")
            .select("day", "responses", F.coalesce("plan_rows", F.lit(0)).alias("plan_rows"),
                    F.coalesce("change_rows", F.lit(0)).alias("change_rows")))


def raw_window_scan(raw: DataFrame, days: Sequence) -> DataFrame:
    """Responses of the given days (partition columns), successful ones only."""
    return raw.filter(F.col("day").isin(*days) & (F.col("status_code") == "200"))


def date_spine(start, end) -> Column:
    return F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day")


def missing_days(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Wanted days minus present days."""
    return wanted.join(present.select("day").distinct(), "day", "left_anti")


def ingest_days(missing: DataFrame, end) -> DataFrame:
    """U4: each missing day and its successor, not beyond end + 1."""
    d = missing.select(F.explode(F.array(F.col("day"), F.date_add("day", 1))).alias("day")).distinct()
    return d.filter(F.col("day") <= F.date_add(F.lit(end), 1))


def stale_days(files: DataFrame, stamps: DataFrame) -> DataFrame:
    """K7: a day needs a re-parse when it has no cache, or its newest raw file is newer
    than the cache stamp."""
    newest = files.groupBy("day").agg(F.max("mtime").alias("newest_raw"))
    j = newest.join(stamps, "day", "left")
    return j.select("day", "newest_raw", "stamp",
                    (F.col("stamp").isNull() | (F.col("newest_raw") > F.col("stamp"))).alias("reparse"))


def rebuild_needed(decisions: DataFrame, built_day, today) -> DataFrame:
    """K7: how many days are parsed anew, and whether to rebuild: if any is, or the calendar
    day moved since the build (one row)."""
    n = F.sum(F.col("reparse").cast("long"))
    return decisions.agg(F.coalesce(n, F.lit(0)).alias("reparsed"), ((F.coalesce(n, F.lit(0)) > 0) | F.lit(built_day < today)).alias("rebuild"))


def finalise_order(missing: DataFrame, ingested: DataFrame) -> DataFrame:
    """A missing day is consolidated once it and its successor are ingested (``complete``:
    its trains that run past midnight end in the next day's archive); one whose successor is
    not there is built from what there is; one that is not there itself is not built."""
    got = ingested.select("day").distinct()
    nxt = got.select(F.date_sub("day", 1).alias("day"), F.lit(True).alias("_next"))
    return (missing.join(got, "day", "left_semi").join(nxt, "day", "left")
            .select("day", F.coalesce("_next", F.lit(False)).alias("complete")))


def reason_join(df: DataFrame, reasons: DataFrame, code: str = "reason_code") -> DataFrame:
    """Cause code -> text (left join; unknown codes -> NULL)."""
    return df.join(reasons.select(F.col("code").alias(code), "reason_text"), code, "left")
