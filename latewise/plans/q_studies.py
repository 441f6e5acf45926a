"""Persistence studies on the fixture: A9-A15, W5, T9, S8."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from latewise.operators import studies as S
from latewise.plans.oracle_fixture import register
from latewise.plans.registry import fixture, query
from latewise.session import checkpoint_dir
from latewise.sources import files

H1, H2, END = dt.date(2026, 7, 1), dt.date(2026, 7, 16), dt.date(2026, 7, 31)
MX, MY, MY_END = dt.date(2026, 6, 1), dt.date(2026, 7, 1), dt.date(2026, 7, 31)



def _profile_sql(src: str, cancelled: str, start: str, split: str, end: str) -> str:
    """Per train and part one row, then the two parts side by side."""
    parts = f"""
  SELECT train_type || ' ' || ltrim(train_number, '0') AS train, CAST(time AS DATE) >= DATE '{split}' AS late, min(train_type) AS kind,
         avg(delay_in_min) AS mean, count(*) AS stops
  FROM {src} WHERE train_number <> '' AND delay_in_min IS NOT NULL AND NOT ({cancelled})
    AND time >= TIMESTAMP '{start}' AND time < TIMESTAMP '{end}' + INTERVAL 1 DAY
  GROUP BY ALL HAVING count(*) >= 40"""
    return f"""
SELECT a.train, least(a.kind, b.kind) AS train_type, a.mean AS h1_avg, b.mean AS h2_avg, a.stops AS h1_n, b.stops AS h2_n
FROM ({parts}) a JOIN ({parts}) b ON b.train = a.train AND b.late AND NOT a.late"""


register("o_profile", _profile_sql("stop_events", "is_canceled", "2026-07-01", "2026-07-16", "2026-07-31"))
register("o_releases", """
SELECT train_type, train_number, time - INTERVAL 1 MONTH AS time, delay_in_min,
       is_canceled AND train_line_station_num % 4 = 0 AS arrival_is_canceled,
       is_canceled AND train_line_station_num % 4 = 2 AS departure_is_canceled
FROM stop_events WHERE train_line_station_num % 2 = 0
UNION ALL BY NAME
SELECT train_type, train_number, time, delay_in_min, reason_code,
       is_canceled AND train_line_station_num % 4 = 1 AS arrival_is_canceled,
       CASE WHEN train_line_station_num <> 5 THEN is_canceled AND train_line_station_num % 4 = 3 END AS departure_is_canceled
FROM stop_events WHERE train_line_station_num % 2 = 1""")
register("o_pair_profile", _profile_sql("o_releases", "arrival_is_canceled OR departure_is_canceled", "2026-06-01", "2026-07-01", "2026-07-31"))
register("o_ranked", """
SELECT *, (rank() OVER (PARTITION BY grp ORDER BY h1_avg) + (count(*) OVER (PARTITION BY grp, h1_avg) - 1) / 2.0) AS r1,
          (rank() OVER (PARTITION BY grp ORDER BY h2_avg) + (count(*) OVER (PARTITION BY grp, h2_avg) - 1) / 2.0) AS r2
FROM (SELECT *, 'ALL' AS grp FROM o_profile UNION ALL SELECT *, train_type AS grp FROM o_profile)""")


def profile(spark, sf_dir):
    return S.period_profile(fixture(spark, sf_dir).stop_events, H1, H2, END, 40)


def release_files(spark, sf_dir):
    """Two monthly releases as stored files: both have the split cancel flags (unknown for some
    rows), the older one lacks the cause."""
    se = fixture(spark, sf_dir).stop_events
    n = F.col("train_line_station_num")
    x = se.filter(n % 2 == 0).select(
        "train_type", "train_number", (F.col("time") - F.make_ym_interval(F.lit(0), F.lit(1))).alias("time"), "delay_in_min",
        (F.col("is_canceled") & (n % 4 == 0)).alias("arrival_is_canceled"),
        (F.col("is_canceled") & (n % 4 == 2)).alias("departure_is_canceled"))
    y = se.filter(n % 2 == 1).select(
        "train_type", "train_number", "time", "delay_in_min", "reason_code",
        (F.col("is_canceled") & (n % 4 == 1)).alias("arrival_is_canceled"),
        F.when(n != 5, F.col("is_canceled") & (n % 4 == 3)).alias("departure_is_canceled"))
    base = f"{checkpoint_dir(spark)}/releases-{uuid.uuid4().hex}"
    for name, df in (("older", x), ("newer", y)):
        df.write.parquet(f"{base}/{name}")
    return [f"{base}/older", f"{base}/newer"]


_RELEASES: dict = {}


def releases(spark, sf_dir):
    """The two releases read as one relation (by name, what one lacks is NULL)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RELEASES:
        _RELEASES[key] = release_files(spark, sf_dir)
    return files.multi_month_scan(spark, _RELEASES[key])


def pair_profile(spark, sf_dir):
    # a row whose flags are not known to be both unset is dropped, as NOT (a OR b) is then NULL
    canc = F.col("arrival_is_canceled") | F.col("departure_is_canceled")
    return S.period_profile(releases(spark, sf_dir), MX, MY, MY_END, 40, cancelled=canc)


@query("half_month_profile", "SELECT * FROM o_profile")
def half_month_profile(spark, sf_dir):
    return profile(spark, sf_dir)


@query("multi_month_scan", "SELECT * FROM o_releases")
def multi_month_scan(spark, sf_dir):
    return releases(spark, sf_dir)


@query("month_pair_profile", "SELECT * FROM o_pair_profile")
def month_pair_profile(spark, sf_dir):
    return pair_profile(spark, sf_dir)


@query("average_rank", """
SELECT train, rank() OVER (ORDER BY h1_avg) + (count(*) OVER (PARTITION BY h1_avg) - 1) / 2.0 AS r,
       (rank() OVER (ORDER BY h1_avg) + (count(*) OVER (PARTITION BY h1_avg) - 1) / 2.0) / count(*) OVER () AS r_pct
FROM o_pair_profile""")
def average_rank(spark, sf_dir):
    return S.average_rank(pair_profile(spark, sf_dir), "h1_avg", None, "r").select("train", "r", "r_pct")


@query("persistence_correlation", """
SELECT grp, count(*) AS n, round(corr(h1_avg, h2_avg), 6) AS pearson, round(corr(r1, r2), 6) AS spearman,
       CASE WHEN grp = 'ALL' THEN 0 ELSE 1 END AS is_type
FROM o_ranked GROUP BY grp HAVING count(*) >= 10 ORDER BY is_type, n DESC, grp""")
def persistence_correlation(spark, sf_dir):
    return S.persistence_correlation(profile(spark, sf_dir))


@query("persistence_quintiles", """
SELECT quintile, count(*) AS trains, round_even(avg(h1_avg), 2) AS h1_avg, round_even(avg(h2_avg), 2) AS h2_avg,
       round_even(median(h2_avg), 2) AS h2_median
FROM (SELECT *, CAST(floor(least(r1 / count(*) OVER () * 5, 4.999)) AS INTEGER) + 1 AS quintile
      FROM (SELECT *, rank() OVER (ORDER BY h1_avg) + (count(*) OVER (PARTITION BY h1_avg) - 1) / 2.0 AS r1 FROM o_pair_profile))
GROUP BY quintile""")
def persistence_quintiles(spark, sf_dir):
    return S.persistence_quintiles(pair_profile(spark, sf_dir))


INSIDE = "h1_avg >= 0 AND h2_avg >= 0 AND h1_avg <= 12 AND h2_avg <= 12"


@query("trend_line", f"""
SELECT count(*) AS trains, count(*) FILTER (WHERE {INSIDE}) AS inside,
       round(regr_slope(h2_avg, h1_avg) FILTER (WHERE {INSIDE}), 6) AS slope,
       round(regr_intercept(h2_avg, h1_avg) FILTER (WHERE {INSIDE}), 6) AS intercept,
       round(count(*) FILTER (WHERE {INSIDE}) / count(*), 6) AS share_inside,
       round(corr(h1_avg, h2_avg), 6) AS pearson
FROM o_pair_profile""")
def trend_line(spark, sf_dir):
    return S.trend_line(pair_profile(spark, sf_dir))


BAND_SQL = ("CASE WHEN h1_avg < 1 THEN 0 WHEN h1_avg >= 1 AND h1_avg < 2 THEN 1 WHEN h1_avg >= 2 AND h1_avg < 4 THEN 2 "
            "WHEN h1_avg >= 4 AND h1_avg < 6 THEN 3 WHEN h1_avg >= 6 THEN 4 END")


@query("violin_groups", f"""
SELECT {BAND_SQL} AS band, count(*) AS n, round(quantile_cont(h2_avg, 0.25), 6) AS q1,
       round(quantile_cont(h2_avg, 0.5), 6) AS med, round(quantile_cont(h2_avg, 0.75), 6) AS q3,
       round(avg(CASE WHEN h2_avg > 12 THEN 100.0 ELSE 0.0 END), 6) AS pct_over
FROM o_pair_profile GROUP BY band""")
def violin_groups(spark, sf_dir):
    return S.violin_groups(pair_profile(spark, sf_dir))


@query("violin_density", f"""
WITH v AS (SELECT {BAND_SQL} AS band, h2_avg FROM o_pair_profile),
d AS (SELECT band, gi, sum(exp(-0.5 * ((gi * 0.1 - h2_avg) / 0.4) * ((gi * 0.1 - h2_avg) / 0.4))) / sqrt(2 * pi())
             / (count(*) * 0.4) AS dens
      FROM v, range(0, 121) g(gi) GROUP BY band, gi)
SELECT band, gi, round(dens / nullif(max(dens) OVER (PARTITION BY band), 0), 6) AS width FROM d""")
def violin_density(spark, sf_dir):
    return S.violin_density(pair_profile(spark, sf_dir))


@query("scatter_sample", f"SELECT * FROM o_pair_profile WHERE {INSIDE} ORDER BY md5('7|' || train), train LIMIT 30")
def scatter_sample(spark, sf_dir):
    return S.scatter_sample(pair_profile(spark, sf_dir), 30, 7)
