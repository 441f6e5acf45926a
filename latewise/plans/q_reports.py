"""Reports, day bookkeeping, raw scans, board and trip-update decoding:
A16, A18, A20, S1, S11, U3, U4, K6, K7, J12, W3, J5, N4, N5."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from latewise.functions.keys import pad_station
from latewise.operators import messages as MS
from latewise.operators import reports as RP
from latewise.plans.oracle_fixture import register
from latewise.plans.registry import fixture, query
from latewise.sources import feeds, landed


@query("trains_by_station_hour", """
SELECT eva, h, string_agg(t, ',' ORDER BY t) AS pool FROM (
  SELECT eva, hour(arrival_planned_time) AS h, ltrim(train_number, '0') AS t, count(*) AS c FROM stop_events
  WHERE arrival_planned_time IS NOT NULL
    AND eva IN (SELECT CASE WHEN length(dest_id) < 8 THEN lpad(dest_id, 8, '0') ELSE dest_id END FROM legs
                WHERE NOT walking AND fahrt_nr IS NOT NULL AND fahrt_nr <> '')
  GROUP BY 1, 2, 3 HAVING count(*) >= 5)
GROUP BY eva, h""")
def trains_by_station_hour(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    st = (fx.legs.filter(~F.col("walking") & F.col("fahrt_nr").isNotNull() & (F.col("fahrt_nr") != ""))
          .select(pad_station("dest_id").alias("eva")))
    return RP.trains_by_station_hour(fx.stop_events, st)


# Fixture values (ours): endpoint of each event type of the request log.
ENDPOINTS = {"view": "static", "click": "journeys_future", "purchase": "journeys_past", "signup": "canary"}
register("o_reqlog", """
SELECT CASE event_type WHEN 'view' THEN 'static' WHEN 'click' THEN 'journeys_future' WHEN 'purchase' THEN 'journeys_past'
                       WHEN 'signup' THEN 'canary' ELSE 'locations' END AS endpoint,
       (CAST(round(value * 100) AS BIGINT) * 3 % 4000) / 10.0 AS ms, user_id % 17 = 0 AS is_error, ts
FROM events""")


def request_log(fx):
    ev = fx.table("events")
    ep = F.col("event_type")
    endpoint = F.when(ep == "view", "static").when(ep == "click", "journeys_future") \
        .when(ep == "purchase", "journeys_past").when(ep == "signup", "canary").otherwise("locations")
    ms = (F.round(F.col("value") * 100).cast("long") * 3 % 4000) / 10.0
    return ev.select(endpoint.alias("endpoint"), ms.alias("ms"), (F.col("user_id") % 17 == 0).alias("is_error"), "ts")


@query("request_report", """
WITH d AS (SELECT epoch(max(ts)) - epoch(min(ts)) AS dur, sum(CASE WHEN is_error THEN 1 ELSE 0 END) / count(*) AS err_rate FROM o_reqlog),
s AS (SELECT endpoint, ms, row_number() OVER (PARTITION BY endpoint ORDER BY ms) - 1 AS i,
             count(*) OVER (PARTITION BY endpoint) AS n FROM o_reqlog WHERE NOT is_error),
p AS (SELECT endpoint, max(n) AS n, max(ms) AS mx,
        max(CASE WHEN i = least(n - 1, floor(n * CAST(0.5 AS DOUBLE))) THEN ms END) AS p50,
        max(CASE WHEN i = least(n - 1, floor(n * CAST(0.9 AS DOUBLE))) THEN ms END) AS p90,
        max(CASE WHEN i = least(n - 1, floor(n * CAST(0.95 AS DOUBLE))) THEN ms END) AS p95,
        max(CASE WHEN i = least(n - 1, floor(n * CAST(0.99 AS DOUBLE))) THEN ms END) AS p99
      FROM s GROUP BY endpoint),
e AS (SELECT endpoint, CAST(sum(CASE WHEN is_error THEN 1 ELSE 0 END) AS BIGINT) AS errors, count(*) AS total FROM o_reqlog GROUP BY endpoint)
SELECT e.endpoint, CAST(coalesce(p.n, 0) AS BIGINT) AS n, round(p.p50, 1) AS p50, round(p.p90, 1) AS p90,
       round(p.p95, 1) AS p95, round(p.p99, 1) AS p99, round(p.mx, 1) AS max, e.errors,
       round(e.total / d.dur, 2) AS rps,
       coalesce((e.endpoint = 'canary' AND p.p99 > 250) OR (e.endpoint = 'journeys_future' AND p.p95 > 800)
                OR (e.endpoint = 'journeys_past' AND p.p95 > 800) OR (e.endpoint = 'static' AND p.p99 > 300), false) AS breach,
       d.err_rate > 0.005 AS error_rate_breach
FROM e LEFT JOIN p ON p.endpoint = e.endpoint CROSS JOIN d""")
def request_report(spark, sf_dir):
    log = request_log(fixture(spark, sf_dir))
    dur = log.select(F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 1e6).scalar()
    return RP.request_report(log, dur)


register("o_raw", """
SELECT CAST(xml_timestamp AS DATE) AS day, api, CASE WHEN ln = 5 AND ok % 9 = 0 THEN '404' ELSE '200' END AS status_code,
       id, ln, ok, arrival_change_time, departure_change_time, is_canceled
FROM responses, (VALUES ('timetables/v1/plan'), ('timetables/v1/fchg')) a(api)""")


@query("message_counts", """
SELECT day, count(*) AS responses,
       count(*) FILTER (WHERE api = 'timetables/v1/plan' AND ln <> 6) AS plan_rows,
       count(*) FILTER (WHERE api = 'timetables/v1/fchg' AND (arrival_change_time IS NOT NULL OR departure_change_time IS NOT NULL OR is_canceled)) AS change_rows
FROM o_raw WHERE status_code = '200' GROUP BY day""")
def message_counts(spark, sf_dir):
    raw = raw_table(fixture(spark, sf_dir))
    ok = raw.filter(F.col("status_code") == "200")
    plans = MS.plan_messages(ok.filter(F.col("api_name") == "timetables/v1/plan"), keep=("day",))
    changes = MS.change_messages(ok.filter(F.col("api_name") == "timetables/v1/fchg"), keep=("day",))
    return RP.message_counts(raw, plans, changes)


def raw_table(fx):
    """Raw responses as landed: day partition, api name, status code, XML payload."""
    status = F.when((F.col("ln") == 5) & (F.col("ok") % 9 == 0), F.lit("404")).otherwise(F.lit("200"))
    r = fx.responses.withColumn("status_code", status)
    cols = ["xml_timestamp", "status_code", "response_data"]
    p = landed.plan_documents(r, extra=("status_code",)).select(*cols).withColumn("api_name", F.lit("timetables/v1/plan"))
    c = landed.change_documents(r, extra=("status_code",)).select(*cols).withColumn("api_name", F.lit("timetables/v1/fchg"))
    both = p.unionByName(c)
    return both.withColumn("day", F.to_date("xml_timestamp")).withColumnRenamed("xml_timestamp", "timestamp")


WINDOW_DAYS = [dt.date(1996, 3, 1) + dt.timedelta(days=i) for i in range(31)]


@query("raw_window_scan", """
SELECT day, api AS api_name, count(*) AS n FROM o_raw
WHERE day BETWEEN DATE '1996-03-01' AND DATE '1996-03-31' AND status_code = '200' GROUP BY 1, 2""")
def raw_window_scan(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    # landed in a folder for each day: the scan lists the window's folders only
    raw = fx._memo("raw", lambda: fx._stored("raw", lambda: raw_table(fx), ["day"], "day"))
    s = RP.raw_window_scan(raw, WINDOW_DAYS)
    return s.groupBy("day", "api_name").agg(F.count(F.lit(1)).alias("n"))


SPINE = ("DATE '2026-06-25'", "DATE '2026-07-31'")
register("o_present", "SELECT DISTINCT CAST(time AS DATE) AS day FROM stop_events WHERE dayofmonth(time) % 4 <> 0")
register("o_missing", f"""
SELECT CAST(d AS DATE) AS day FROM generate_series({SPINE[0]}, {SPINE[1]}, INTERVAL 1 DAY) t(d)
WHERE CAST(d AS DATE) NOT IN (SELECT day FROM o_present)""")


def _missing(fx):
    se = fx.stop_events
    present = se.filter(F.dayofmonth("time") % 4 != 0).select(F.to_date("time").alias("day"))
    wanted = fx.spark.range(1).select(RP.date_spine(dt.date(2026, 6, 25), dt.date(2026, 7, 31)))
    return RP.missing_days(wanted, present)


@query("missing_days", "SELECT * FROM o_missing")
def missing_days(spark, sf_dir):
    return _missing(fixture(spark, sf_dir))


@query("ingest_days", f"""
SELECT DISTINCT day FROM (SELECT day FROM o_missing UNION ALL SELECT CAST(day + 1 AS DATE) FROM o_missing)
WHERE day <= CAST({SPINE[1]} + 1 AS DATE)""")
def ingest_days(spark, sf_dir):
    return RP.ingest_days(_missing(fixture(spark, sf_dir)), dt.date(2026, 7, 31))


register("o_files", """
SELECT CAST(xml_timestamp AS DATE) AS day, ok % 3 AS f, max(reason_ts) + to_hours(CAST(ok % 3 AS BIGINT)) AS mtime
FROM responses GROUP BY 1, 2, ok % 3""")
register("o_stamps", """
SELECT day, CASE WHEN dayofmonth(day) % 7 = 0 THEN max(mtime) - INTERVAL 1 DAY ELSE max(mtime) + INTERVAL 1 HOUR END AS stamp
FROM o_files WHERE dayofmonth(day) % 5 <> 0 GROUP BY day""")


def _files(fx):
    r = fx.responses
    f = r.groupBy(F.to_date("xml_timestamp").alias("day"), (F.col("ok") % 3).alias("f")).agg(
        F.max("reason_ts").alias("_m"))
    f = f.withColumn("mtime", F.col("_m") + F.make_dt_interval(hours=F.col("f").cast("int"))).drop("_m")
    st = (f.filter(F.dayofmonth("day") % 5 != 0).groupBy("day").agg(F.max("mtime").alias("_m"))
          .select("day", F.when(F.dayofmonth("day") % 7 == 0, F.col("_m") - F.make_dt_interval(days=F.lit(1)))
                  .otherwise(F.col("_m") + F.make_dt_interval(hours=F.lit(1))).alias("stamp")))
    return f, st


@query("stale_day_select", """
SELECT n.day, n.newest_raw, s.stamp, s.stamp IS NULL OR n.newest_raw > s.stamp AS reparse
FROM (SELECT day, max(mtime) AS newest_raw FROM o_files GROUP BY day) n LEFT JOIN o_stamps s ON s.day = n.day""")
def stale_day_select(spark, sf_dir):
    f, st = _files(fixture(spark, sf_dir))
    return RP.stale_days(f, st)


@query("reason_join", """
SELECT s.id, s.reason_code, r.reason_text FROM stop_events s
LEFT JOIN (SELECT DISTINCT reason_code AS code, 'cause ' || CAST(reason_code AS VARCHAR) AS reason_text
           FROM stop_events WHERE reason_code <= 60) r ON r.code = s.reason_code""")
def reason_join(spark, sf_dir):
    """J12 with a cause dimension landed as a table (here: codes up to 60 known)."""
    se = fixture(spark, sf_dir).stop_events
    dim = (se.filter(F.col("reason_code") <= 60).select(F.col("reason_code").alias("code")).distinct()
           .withColumn("reason_text", F.concat(F.lit("cause "), F.col("code").cast("string"))))
    return RP.reason_join(se.select("id", "reason_code"), dim)


@query("board_messages", """
SELECT strftime(coalesce(arrival_planned_time, departure_planned_time), '%Y%m%d') AS day, eva, CAST(ok * 10 + ln AS VARCHAR) AS zi,
  CASE WHEN ok % 9 = 0 THEN NULL ELSE nullif(trim(train_number), '') END AS train_number,
  nullif(trim(lower(train_type)), '') AS category, nullif(trim(line_number), '') AS line,
  CASE WHEN ln % 2 = 1 THEN final_destination_station END AS final_dest,
  arrival_planned_time AS arr_plan, arrival_change_time AS arr_real, departure_planned_time AS dep_plan,
  departure_change_time AS dep_real, CASE WHEN is_canceled AND ln % 2 = 0 THEN 1 ELSE 0 END AS arr_cncl,
  CASE WHEN is_canceled AND ln % 2 = 1 THEN 1 ELSE 0 END AS dep_cncl
FROM fx_latest WHERE ln <> 5 AND ok % 13 <> 0 AND ok % 11 <> 0""")
def board_messages(spark, sf_dir):
    return MS.board_messages(feeds.at_boards(fixture(spark, sf_dir).latest))


@query("trip_updates", """
WITH rows AS (SELECT * FROM o_fr_obs WHERE stop_id <> ''),
ent AS (SELECT start_date, trip_id, max(trip_rel) AS trip_rel FROM rows GROUP BY 1, 2),
marks AS (SELECT DISTINCT start_date, trip_id, trip_rel FROM o_fr_obs WHERE stop_id = '')
SELECT r.start_date, r.trip_id, r.stop_id, r.train_number, r.station_code AS uic8, r.arr_time, r.arr_delay,
       r.dep_time, r.dep_delay, e.trip_rel, r.stop_rel
FROM rows r JOIN ent e ON e.start_date = r.start_date AND e.trip_id = r.trip_id
WHERE r.arr_time IS NOT NULL OR r.dep_time IS NOT NULL OR coalesce(r.stop_rel = 1, false) OR e.trip_rel = 3
UNION ALL
SELECT start_date, trip_id, '', CASE WHEN regexp_extract(trip_id, '^OCESN(\\d+)F', 1) <> ''
                                     THEN ltrim(regexp_extract(trip_id, '^OCESN(\\d+)F', 1), '0') END,
       NULL, NULL, NULL, NULL, NULL, trip_rel, NULL
FROM marks WHERE trip_rel = 3""")
def trip_updates(spark, sf_dir):
    return MS.trip_updates(feeds.fr_entities(fixture(spark, sf_dir).latest))


@query("trip_updates_nl", """
WITH g AS (SELECT start_date, train_key, train_type, max(trip_rel) AS rel, max(headsign) AS sign FROM o_nl_obs GROUP BY ALL),
known AS (SELECT * FROM g WHERE CAST(split_part(train_key, ':', 2) AS INTEGER) % 7 <> 3),
stops AS (SELECT k.sign, k.rel, o.* FROM o_nl_obs o JOIN known k USING (start_date, train_key, train_type)
          WHERE NOT (k.rel = 3 AND k.train_type = 'IC') AND (o.arr_delay IS NULL OR o.arr_delay <> 0))
SELECT start_date, train_key, lower(station_code) AS station_code, ltrim(split_part(train_key, ':', 2), '0') AS train_number, train_type,
       sign AS headsign, arr_time, arr_delay, dep_time, dep_delay, rel AS trip_rel, stop_rel
FROM stops WHERE arr_time IS NOT NULL OR dep_time IS NOT NULL OR stop_rel = 1 OR rel = 3
UNION ALL
SELECT start_date, train_key, '', ltrim(split_part(train_key, ':', 2), '0'), train_type, sign, NULL, NULL, NULL, NULL, rel, NULL
FROM known WHERE rel = 3 AND train_type = 'IC'""")
def trip_updates_nl(spark, sf_dir):
    """N5, NL flavour: landed entities with the feed's extension fields."""
    return MS.trip_updates_nl(feeds.nl_entities(fixture(spark, sf_dir).latest))
