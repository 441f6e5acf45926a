"""DE nightly build: W1, W2, A1, J1, X7, the window filter, A2, T10; country merge F6, S9, U1, A3."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from latewise.functions.keys import ride_id, stop_number
from latewise.operators import dedup as D
from latewise.operators import normalise as N
from latewise.plans.oracle_fixture import minutes_sql, register
from latewise.plans.registry import fixture, query

WIN_START, WIN_END = dt.datetime(2026, 7, 2), dt.datetime(2026, 7, 31)
WIN_SQL = "TIMESTAMP '2026-07-02 00:00:00'", "TIMESTAMP '2026-07-31 00:00:00'"

TB = "tb_part DESC, tb_supp DESC, tb_price DESC"

register("o_latest_plan", f"""
SELECT * FROM plan_msgs QUALIFY row_number() OVER (PARTITION BY id ORDER BY xml_timestamp DESC NULLS LAST, {TB}) = 1""")
register("o_latest_change", f"""
SELECT * FROM change_msgs QUALIFY row_number() OVER (PARTITION BY id ORDER BY xml_timestamp DESC NULLS LAST, {TB}) = 1""")
register("o_latest_reason", f"""
SELECT id, reason_code FROM change_msgs WHERE reason_code IS NOT NULL AND reason_ts IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY id ORDER BY reason_ts DESC, {TB}) = 1""")
register("o_patch", """
SELECT id, any_value(arrival_change_time) AS new_arr, any_value(departure_change_time) AS new_dep, bool_or(is_canceled) AS dropped,
       any_value(cause) AS cause
FROM (SELECT id, arrival_change_time, departure_change_time, is_canceled FROM o_latest_change
      UNION ALL BY NAME SELECT id, reason_code AS cause FROM o_latest_reason)
GROUP BY id""")
register("o_merged", """
SELECT plan.* EXCLUDE (xml_timestamp, tb_part, tb_supp, tb_price), ifnull(new_arr, arrival_planned_time) AS arrival_change_time,
       ifnull(new_dep, departure_planned_time) AS departure_change_time, ifnull(dropped, false) AS is_canceled, cause AS reason_code
FROM o_latest_plan plan LEFT JOIN o_patch USING (id)""")
register("o_de_build", f"""
SELECT m.*, seen.at AS time, seen.late AS delay_in_min, array_to_string(parts[1:len(parts) - 2], '-') AS train_line_ride_id,
       CAST(parts[len(parts)] AS INTEGER) AS train_line_station_num
FROM o_merged m, LATERAL (SELECT ifnull(m.departure_change_time, m.arrival_change_time) AS at,
                                 ifnull({minutes_sql('m.departure_planned_time', 'm.departure_change_time')},
                                        {minutes_sql('m.arrival_planned_time', 'm.arrival_change_time')}) AS late,
                                 string_split(m.id, '-') AS parts) seen
WHERE seen.at >= {WIN_SQL[0]} AND seen.at < {WIN_SQL[1]}""")


def de_build(fx):
    merged = D.plan_change_merge(fx.plan_msgs, fx.change_msgs)
    return N.time_window(N.de_transform(merged), WIN_START, WIN_END)


@query("latest_plan", "SELECT id, eva, train_number, arrival_planned_time, departure_planned_time, xml_timestamp, tb_part FROM o_latest_plan")
def latest_plan(spark, sf_dir):
    return D.latest_plan(fixture(spark, sf_dir).plan_msgs).select(
        "id", "eva", "train_number", "arrival_planned_time", "departure_planned_time", "xml_timestamp", "tb_part")


@query("latest_change", "SELECT id, arrival_change_time, departure_change_time, is_canceled, xml_timestamp, tb_part FROM o_latest_change")
def latest_change(spark, sf_dir):
    return D.latest_change(fixture(spark, sf_dir).change_msgs).select(
        "id", "arrival_change_time", "departure_change_time", "is_canceled", "xml_timestamp", "tb_part")


@query("latest_reason", "SELECT * FROM o_latest_reason")
def latest_reason(spark, sf_dir):
    return D.latest_reason(fixture(spark, sf_dir).change_msgs)


@query("plan_change_merge", "SELECT * FROM o_merged")
def plan_change_merge(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return D.plan_change_merge(fx.plan_msgs, fx.change_msgs)


@query("de_build", "SELECT * FROM o_de_build")
def de_build_q(spark, sf_dir):
    return de_build(fixture(spark, sf_dir))


@query("default_sort_order", "SELECT id, time FROM o_de_build ORDER BY time")
def default_sort_order(spark, sf_dir):
    """The build is written ordered by ``time`` (no effect on content)."""
    return de_build(fixture(spark, sf_dir)).select("id", "time").orderBy("time")


@query("ride_id_split", """
SELECT id, regexp_extract(id, '^(.*)-\\d{10}-\\d+$', 1) AS train_line_ride_id,
       TRY_CAST(split_part(id, '-', -1) AS INTEGER) AS train_line_station_num
FROM (SELECT id FROM responses
      UNION ALL SELECT 'x-' || CAST(ok AS VARCHAR) || '-' || CAST(ln AS VARCHAR) FROM responses WHERE ok % 97 = 0
      UNION ALL SELECT id || '-n' FROM responses WHERE ok % 89 = 0) t""")
def ride_id_split(spark, sf_dir):
    """X7 over every response id plus malformed variants (no 10-digit part, text stop number)."""
    r = fixture(spark, sf_dir).responses
    ids = (r.select("id")
           .unionByName(r.filter(F.col("ok") % 97 == 0).select(
               F.concat(F.lit("x-"), F.col("ok").cast("string"), F.lit("-"), F.col("ln").cast("string")).alias("id")))
           .unionByName(r.filter(F.col("ok") % 89 == 0).select(F.concat("id", F.lit("-n")).alias("id"))))
    return ids.select("id", ride_id("id").alias("train_line_ride_id"),
                      stop_number("id").alias("train_line_station_num"))


@query("day_summary", """
SELECT CAST(time AS DATE) AS day, count(*) AS stops, round(avg(delay_in_min), 2) AS avg_delay_min
FROM o_de_build GROUP BY day""")
def day_summary(spark, sf_dir):
    """A2: per day stops and average delay rounded to 2 (cancelled rows included)."""
    b = de_build(fixture(spark, sf_dir))
    return (b.groupBy(F.to_date("time").alias("day"))
            .agg(F.count(F.lit(1)).alias("stops"), F.round(F.avg("delay_in_min"), 2).alias("avg_delay_min")))


# ---- country merge -----------------------------------------------------------------

MERGE_START, MERGE_END = dt.datetime(2026, 7, 3), dt.datetime(2026, 7, 30)
M_SQL = "TIMESTAMP '2026-07-03 00:00:00'", "TIMESTAMP '2026-07-30 00:00:00'"
COLS = ("station_name, xml_station_name, eva, train_number, line_number, final_destination_station, "
        "delay_in_min, time, is_canceled, train_type, train_line_ride_id, train_line_station_num, "
        "arrival_planned_time, arrival_change_time, departure_planned_time, departure_change_time, id")


# a row belongs to the window if its time and, where it has one, its planned arrival lie in it;
# only the German source delivers causes
register("o_countries", "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{name}')" for name, p in N.SOURCES) + ") AS c(prefix, country)")
register("o_merged_countries", f"""
SELECT {COLS}, CASE WHEN country = 'DE' THEN reason_code END AS reason_code
FROM stop_events JOIN o_countries ON prefix = left(eva, 3)
WHERE least(time, ifnull(arrival_planned_time, time)) >= {M_SQL[0]} AND greatest(time, ifnull(arrival_planned_time, time)) < {M_SQL[1]}""")


def merged_countries(fx):
    se = fx.stop_events
    sources = [(name, se if name == "DE" else se.drop("reason_code")) for name, _ in N.SOURCES]
    return N.merge_countries(sources, MERGE_START, MERGE_END)


@query("merge_countries", "SELECT * FROM o_merged_countries")
def merge_countries(spark, sf_dir):
    return merged_countries(fixture(spark, sf_dir))


@query("country_window_filter", "SELECT * FROM o_merged_countries WHERE left(eva, 3) = '080'")
def country_window_filter(spark, sf_dir):
    return N.country_window_filter(fixture(spark, sf_dir).stop_events, "080", MERGE_START, MERGE_END)


@query("optional_column_scan", "SELECT id, CAST(NULL AS INTEGER) AS reason_code FROM stop_events")
def optional_column_scan(spark, sf_dir):
    return N.with_optional_columns(fixture(spark, sf_dir).stop_events.drop("reason_code")).select("id", "reason_code")


@query("country_summary", """
SELECT CASE substr(eva, 2, 2) WHEN '80' THEN 'DE' WHEN '81' THEN 'AT' WHEN '83' THEN 'IT' WHEN '84' THEN 'NL'
            WHEN '85' THEN 'CH' WHEN '87' THEN 'FR' ELSE substr(eva, 2, 2) END AS country,
       count(*) AS rows_, count(DISTINCT CAST(arrival_planned_time AS DATE)) AS days_
FROM o_merged_countries GROUP BY country""")
def country_summary(spark, sf_dir):
    """A3: per country code rows and distinct planned days."""
    from latewise.functions.keys import country_of
    m = merged_countries(fixture(spark, sf_dir))
    return m.groupBy(country_of("eva").alias("country")).agg(
        F.count(F.lit(1)).alias("rows_"), F.countDistinct(F.to_date("arrival_planned_time")).alias("days_"))
