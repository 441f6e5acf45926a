"""Message explosion: N1-N3 over XML documents, N8-N9 over journey JSON payloads.

The oracle cannot parse the payloads; it reads the fixture columns the payloads were
built from (times at minute precision, as the compact format carries them)."""

from __future__ import annotations

from pyspark.sql import functions as F

from latewise.operators import messages as MS
from latewise.plans.q_matching import UNTRACKED_SQL
from latewise.plans.registry import fixture, query
from latewise.sources import landed


@query("change_messages", """
SELECT id, date_trunc('minute', arrival_change_time) AS arrival_change_time,
       date_trunc('minute', departure_change_time) AS departure_change_time, is_canceled, reason_code,
       CASE WHEN reason_code IS NOT NULL THEN strftime(reason_ts, '%y%m%d%H%M') END AS reason_ts, xml_timestamp
FROM responses WHERE arrival_change_time IS NOT NULL OR departure_change_time IS NOT NULL OR is_canceled""")
def change_messages(spark, sf_dir):
    return MS.change_messages(landed.change_documents(fixture(spark, sf_dir).responses))


@query("latest_cause", """
SELECT id, reason_code AS code FROM responses""")
def latest_cause(spark, sf_dir):
    """N3 with the live tie rule over every stop of every change document."""
    st = MS.explode_stops(landed.change_documents(fixture(spark, sf_dir).responses), cause="last")
    return st.select(F.col("s._id").alias("id"), F.col("cause.code").alias("code"))


@query("plan_messages", """
SELECT id, ltrim(train_number, '0') AS train,
       CASE WHEN l <> '' AND regexp_matches(l, '^\\d+$') AND train_type = 'S' THEN 'S' || l WHEN l <> '' THEN l END AS line,
       date_trunc('minute', arrival_planned_time) AS ar_pt, date_trunc('minute', departure_planned_time) AS dp_pt,
       xml_timestamp
FROM (SELECT *, replace(CASE WHEN arrival_planned_time IS NOT NULL AND line_number <> '' THEN line_number
                             WHEN departure_planned_time IS NOT NULL THEN line_number END, ' ', '') AS l
      FROM responses WHERE ln <> 6)""")
def plan_messages(spark, sf_dir):
    return MS.plan_messages(landed.plan_documents(fixture(spark, sf_dir).responses))


LEGS_N8 = """
SELECT CAST(journey_id AS VARCHAR) AS ref, CAST(row_number() OVER (PARTITION BY journey_id ORDER BY leg_idx) - 1 AS INTEGER) AS leg_pos,
       walking, line_name, CASE WHEN NOT walking THEN fahrt_nr END AS fahrt_nr, product, operator,
       ltrim(origin_id, '0') AS origin_id, ltrim(dest_id, '0') AS dest_id, planned_departure, planned_arrival,
       nullif(live_departure, planned_departure) AS departure, nullif(live_arrival, planned_arrival) AS arrival,
       coalesce(j.transfers, 0) AS transfers, j.price, j.dticket_covered, j.price_partial
FROM jlegs JOIN journeys j USING (journey_id) WHERE journey_id IN (SELECT journey_id FROM jlegs WHERE NOT walking)"""


def _payloads(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return landed.journey_payloads(fx.jlegs, fx.journeys)


@query("journey_legs", LEGS_N8)
def journey_legs(spark, sf_dir):
    return MS.journey_legs(_payloads(spark, sf_dir))


@query("journey_stops", f"""
WITH l AS ({LEGS_N8})
SELECT DISTINCT CASE WHEN length(station) < 8 THEN lpad(station, 8, '0') ELSE station END AS eva, t FROM (
  SELECT origin_id AS station, planned_departure AS t FROM l
  WHERE NOT walking AND fahrt_nr IS NOT NULL AND fahrt_nr <> '' AND coalesce(product, '') NOT IN ({UNTRACKED_SQL})
  UNION ALL
  SELECT dest_id, planned_arrival FROM l
  WHERE NOT walking AND fahrt_nr IS NOT NULL AND fahrt_nr <> '' AND coalesce(product, '') NOT IN ({UNTRACKED_SQL}))
WHERE station IS NOT NULL AND station <> '' AND t IS NOT NULL""")
def journey_stops(spark, sf_dir):
    return MS.journey_stops(MS.journey_legs(_payloads(spark, sf_dir)))


@query("rejected_documents", """
SELECT kind, doc, count(*) AS n FROM (
  SELECT 'xml' AS kind, id AS doc FROM responses WHERE ok % 101 = 0
  UNION ALL SELECT 'json', CAST(journey_id // 10 AS VARCHAR) FROM (SELECT DISTINCT journey_id // 10 * 10 AS journey_id FROM legs)
  WHERE journey_id // 10 % 13 = 0)
GROUP BY kind, doc""")
def rejected_documents(spark, sf_dir):
    """Change documents and search payloads that broke off on their way, by the parsers' own
    check; the parsers leave exactly these out."""
    fx = fixture(spark, sf_dir)
    xml = landed.change_documents(fx.responses, extra=("id", "ok"))
    xml = landed.cut_documents(xml, "response_data", F.col("ok") % 101 == 0)
    js = landed.cut_documents(_payloads(spark, sf_dir), "payload", F.col("search_id") % 13 == 0)
    bad = (MS.rejected(xml, "response_data", MS.TIMETABLE_SCHEMA, "xml").select(F.lit("xml").alias("kind"), F.col("id").alias("doc"))
           .unionByName(MS.rejected(js, "payload", MS.LEG_SCHEMA, "json").select(F.lit("json").alias("kind"), F.col("search_id").cast("string").alias("doc"))))
    return bad.groupBy("kind", "doc").agg(F.count(F.lit(1)).alias("n"))
