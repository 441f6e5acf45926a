"""Future-mode journey queries: W6, M4, A19, M10, T5-T8, W7, F8, F10, J13, M5, M11, X27."""

from __future__ import annotations

from pyspark.sql import functions as F

from latewise.operators import journeys as J
from latewise.operators import matching as M
from latewise.operators import messages as MS
from latewise.plans.oracle_fixture import register
from latewise.plans.q_matching import LOOKUP_LEGS_SQL, _stats_oracle, _stats_sql
from latewise.plans.registry import fixture, query
from latewise.sources import landed

register("o_leg_stats", _stats_oracle(7))
register("o_pairs", """
SELECT journey_id, a_idx, b_idx, station, a_planned_arrival, b_planned_departure, b_cum - a_cum AS walk_min,
  (epoch(coalesce(b_live_departure, b_planned_departure)) - epoch(coalesce(a_live_arrival, a_planned_arrival))) / 60.0
    - (b_cum - a_cum) AS transfer_min
FROM (
  SELECT journey_id, leg_idx AS a_idx, dest_name AS station, planned_arrival AS a_planned_arrival,
         live_arrival AS a_live_arrival, cum_walk AS a_cum,
         lead(leg_idx) OVER w AS b_idx, lead(planned_departure) OVER w AS b_planned_departure,
         lead(live_departure) OVER w AS b_live_departure, lead(cum_walk) OVER w AS b_cum
  FROM (SELECT *, sum(CASE WHEN walking AND planned_arrival IS NOT NULL AND planned_departure IS NOT NULL
                           THEN (epoch(planned_arrival) - epoch(planned_departure)) / 60.0 ELSE 0.0 END)
                  OVER (PARTITION BY journey_id ORDER BY leg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_walk
        FROM legs) x
  WHERE NOT walking
  WINDOW w AS (PARTITION BY journey_id ORDER BY leg_idx))
WHERE b_idx IS NOT NULL AND a_planned_arrival IS NOT NULL AND b_planned_departure IS NOT NULL""")
register("o_tight", """
SELECT p.journey_id, a_idx AS leg_index, b_idx AS dep_leg_index, station, walk_min, a_planned_arrival, b_planned_departure,
  greatest(0, CAST(round_even(transfer_min, 0) AS INTEGER)) AS transfer_minutes, s.median_delay,
  s.median_delay - transfer_min > 30 AS unlikely
FROM o_pairs p JOIN o_leg_stats s ON s.journey_id = p.journey_id AND s.leg_idx = p.a_idx
WHERE s.median_delay IS NOT NULL AND transfer_min - s.median_delay <= 2""")
register("o_metrics", """
SELECT t.journey_id, t.delay_score, t.max_leg_median, m.min_transfer_margin FROM
 (SELECT l.journey_id, arg_max_null(s.median_delay, l.leg_idx) AS delay_score, max(s.median_delay) AS max_leg_median
  FROM legs l LEFT JOIN o_leg_stats s ON s.journey_id = l.journey_id AND s.leg_idx = l.leg_idx
  WHERE NOT l.walking GROUP BY l.journey_id) t
 LEFT JOIN (SELECT p.journey_id, round(min(transfer_min - s.median_delay), 1) AS min_transfer_margin
            FROM o_pairs p JOIN o_leg_stats s ON s.journey_id = p.journey_id AND s.leg_idx = p.a_idx
            WHERE s.median_delay IS NOT NULL GROUP BY p.journey_id) m ON m.journey_id = t.journey_id""")
register("o_score", """
SELECT m.*, coalesce(t.n_tight, 0) AS n_tight, coalesce(t.any_unlikely, false) AS any_unlikely
FROM o_metrics m LEFT JOIN (SELECT journey_id, count(*) AS n_tight, bool_or(unlikely) AS any_unlikely
                            FROM o_tight GROUP BY journey_id) t ON t.journey_id = m.journey_id""")
register("o_pages", """
SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY first_dep NULLS LAST, journey_id) AS orig_pos
FROM (SELECT journey_id, arg_min_null(planned_departure, leg_idx) AS first_dep,
             arg_max_null(planned_arrival, leg_idx) AS last_arr,
             CAST(sum(CASE WHEN NOT walking THEN 1 ELSE 0 END) AS BIGINT) AS n_train, journey_id // 10 AS search_id
      FROM legs GROUP BY journey_id)""")


def leg_stats(spark, sf_dir, with_days: bool = False):
    fx = fixture(spark, sf_dir)
    return M.leg_delay_stats(fx.legs, fx.keyed, window_days=7, with_days=with_days)


def pages(fx):
    return J.page_order(fx.legs, (F.col("journey_id") / 10).cast("long"))


@query("transfer_pairs", "SELECT journey_id, a_idx, b_idx, round(walk_min, 4) AS walk_min, round(transfer_min, 4) AS transfer_min FROM o_pairs")
def transfer_pairs(spark, sf_dir):
    p = J.transfer_pairs(fixture(spark, sf_dir).legs)
    return p.select("journey_id", "a_idx", "b_idx", F.round("walk_min", 4).alias("walk_min"),
                    F.round("transfer_min", 4).alias("transfer_min"))


@query("tight_transfers", """
SELECT journey_id, leg_index, dep_leg_index, station, transfer_minutes, median_delay, unlikely FROM o_tight""")
def tight_transfers(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    t = J.tight_transfers(fx.legs, leg_stats(spark, sf_dir))
    return t.select("journey_id", "leg_index", "dep_leg_index", "station", "transfer_minutes", "median_delay", "unlikely")


@query("journey_metrics", "SELECT * FROM o_metrics")
def journey_metrics(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return J.journey_metrics(fx.legs, leg_stats(spark, sf_dir))


@query("journey_score", "SELECT * FROM o_score")
def journey_score(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return J.journey_score(fx.legs, leg_stats(spark, sf_dir)).drop("tight")


@query("sort_delay", """
SELECT s.journey_id, p.search_id, row_number() OVER (PARTITION BY p.search_id ORDER BY s.delay_score IS NULL,
       CASE WHEN s.delay_score IS NULL THEN NULL ELSE s.any_unlikely END, s.delay_score NULLS LAST,
       CASE WHEN s.delay_score IS NULL THEN NULL ELSE coalesce(s.max_leg_median, 0.0) END, p.orig_pos) AS pos_delay
FROM o_score s JOIN o_pages p ON p.journey_id = s.journey_id""")
def sort_delay(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    s = J.journey_score(fx.legs, leg_stats(spark, sf_dir)).drop("tight").join(pages(fx), "journey_id")
    return J.sort_delay(s).select("journey_id", "search_id", "pos_delay")


@query("sort_price", """
SELECT j.journey_id, p.search_id, row_number() OVER (PARTITION BY p.search_id ORDER BY
       (CASE WHEN j.dticket_covered THEN 0.0 ELSE j.price END) IS NULL,
       (CASE WHEN j.dticket_covered THEN 0.0 ELSE j.price END) NULLS LAST, p.orig_pos) AS pos_price
FROM journeys j JOIN o_pages p ON p.journey_id = j.journey_id""")
def sort_price(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    j = fx.journeys.join(pages(fx), "journey_id")
    return J.sort_price(j).select("journey_id", "search_id", "pos_price")


@query("sort_transfers", """
SELECT j.journey_id, p.search_id, row_number() OVER (PARTITION BY p.search_id ORDER BY
       coalesce(j.transfers, greatest(p.n_train - 1, 0)), p.orig_pos) AS pos_transfers
FROM journeys j JOIN o_pages p ON p.journey_id = j.journey_id""")
def sort_transfers(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    j = fx.journeys.join(pages(fx), "journey_id")
    return J.sort_transfers(j).select("journey_id", "search_id", "pos_transfers")


@query("sort_risk", """
SELECT s.journey_id, p.search_id, row_number() OVER (PARTITION BY p.search_id ORDER BY
       CASE WHEN s.any_unlikely THEN 2 WHEN s.n_tight > 0 THEN 1 ELSE 0 END,
       CASE WHEN coalesce(j.transfers, p.n_train - 1) <= 0 THEN 'inf'::DOUBLE
            ELSE coalesce(s.min_transfer_margin, '-inf'::DOUBLE) END DESC, p.orig_pos) AS pos_risk
FROM o_score s JOIN o_pages p ON p.journey_id = s.journey_id JOIN journeys j ON j.journey_id = s.journey_id""")
def sort_risk(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    s = (J.journey_score(fx.legs, leg_stats(spark, sf_dir)).drop("tight")
         .join(pages(fx), "journey_id").join(fx.journeys.select("journey_id", "transfers"), "journey_id"))
    return J.sort_risk(s).select("journey_id", "search_id", "pos_risk")


JKEY_SQL = """
SELECT journey_id, journey_id // 10 AS search_id,
  concat_ws('|', strftime(arg_min_null(planned_departure, leg_idx), '%Y-%m-%dT%H:%M:%S'),
                 strftime(arg_max_null(planned_arrival, leg_idx), '%Y-%m-%dT%H:%M:%S'),
                 coalesce(string_agg(CASE WHEN NOT walking THEN coalesce(line_name, '') END, '|' ORDER BY leg_idx), '')) AS jkey
FROM legs GROUP BY journey_id"""


@query("journey_dedup", f"""
WITH k AS ({JKEY_SQL}),
shown AS (SELECT * FROM k WHERE journey_id % 2 = 0),
page AS (SELECT search_id, journey_id, jkey FROM k WHERE journey_id % 2 = 1
         UNION ALL SELECT search_id, journey_id + 1, jkey FROM k WHERE journey_id % 2 = 0 AND journey_id % 3 = 0)
SELECT search_id, journey_id, jkey FROM shown
UNION ALL
SELECT p.search_id, p.journey_id, p.jkey FROM page p ANTI JOIN shown s ON s.search_id = p.search_id AND s.jkey = p.jkey""")
def journey_dedup(spark, sf_dir):
    """Even journeys are on screen; the next page brings the odd ones plus re-sent
    copies of some shown ones (same key, other id); copies are dropped."""
    fx = fixture(spark, sf_dir)
    k = J.journey_key(fx.legs).withColumn("search_id", (F.col("journey_id") / 10).cast("long"))
    shown = k.filter(F.col("journey_id") % 2 == 0).select("search_id", "journey_id", "jkey")
    page = (k.filter(F.col("journey_id") % 2 == 1).select("search_id", "journey_id", "jkey")
            .unionByName(k.filter((F.col("journey_id") % 2 == 0) & (F.col("journey_id") % 3 == 0))
                         .select("search_id", (F.col("journey_id") + 1).alias("journey_id"), "jkey")))
    return J.journey_dedup(shown, page)


@query("foreign_tariff_filter", """
SELECT journey_id, bool_or(coalesce(contains(lower(operator), 'flix'), false)
                           OR coalesce(starts_with(upper(line_name), 'FLX'), false)) AS foreign_tariff
FROM legs WHERE NOT walking GROUP BY journey_id""")
def foreign_tariff_filter(spark, sf_dir):
    return J.foreign_tariff_journeys(fixture(spark, sf_dir).legs)


@query("return_floor_filter", """
WITH pg AS (SELECT *, journey_id // 3 AS trip_id FROM o_pages),
o AS (SELECT trip_id, date_trunc('second', last_arr) AS fl FROM pg WHERE journey_id % 3 = 0)
SELECT r.trip_id, r.journey_id, r.first_dep FROM pg r JOIN o ON o.trip_id = r.trip_id
WHERE r.journey_id % 3 <> 0 AND (o.fl IS NULL OR r.first_dep >= o.fl)""")
def return_floor_filter(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    pg = pages(fx).withColumn("trip_id", (F.col("journey_id") / 3).cast("long"))
    out = pg.filter(F.col("journey_id") % 3 == 0).select("trip_id", "last_arr")
    ret = pg.filter(F.col("journey_id") % 3 != 0).select("trip_id", "journey_id", "first_dep")
    return J.return_floor_filter(out, ret)


@query("day_slots", """
WITH ql AS (SELECT DISTINCT journey_id, leg_idx, window_start, window_end FROM o_leg_stats),
spine AS (SELECT journey_id, leg_idx, CAST(unnest(generate_series(window_start, window_end, INTERVAL 1 DAY)) AS DATE) AS day FROM ql),
d AS (SELECT journey_id, leg_idx, day, delay, canceled, reason FROM (
  WITH ql AS (""" + LOOKUP_LEGS_SQL + """)
  """ + _stats_sql(7) + """
  SELECT journey_id, leg_idx, day, CASE WHEN is_canceled THEN NULL ELSE CAST(arr_delay AS INTEGER) END AS delay,
         is_canceled AS canceled, reason_code AS reason FROM best))
SELECT s.journey_id, s.leg_idx, s.day, d.delay, d.canceled, d.reason
FROM spine s LEFT JOIN d ON d.journey_id = s.journey_id AND d.leg_idx = s.leg_idx AND d.day = s.day""")
def day_slots(spark, sf_dir):
    return J.day_slots(leg_stats(spark, sf_dir, with_days=True))


@query("if_missed", """
WITH wl AS (SELECT journey_id, arg_max(dest_id, leg_idx) AS dest FROM jlegs WHERE NOT walking GROUP BY journey_id),
t AS (SELECT t.*, j.origin_id AS origin, wl.dest,
             t.a_planned_arrival + to_microseconds(CAST(round((t.walk_min + t.median_delay) * 60 * 1000000) AS BIGINT)) AS ready
      FROM o_tight t JOIN jlegs j ON j.journey_id = t.journey_id AND j.leg_idx = t.dep_leg_index
      JOIN wl ON wl.journey_id = t.journey_id),
c AS (SELECT * FROM connections WHERE NOT (coalesce(contains(lower(conn_operator), 'flix'), false)
                                           OR coalesce(starts_with(upper(conn_name), 'FLX'), false)))
SELECT journey_id, leg_index, arg_min(conn_id, (conn_arrival, conn_id)) AS conn_id, min(conn_arrival) AS arrival
FROM t JOIN c ON c.origin_id = t.origin AND c.final_dest = t.dest
WHERE (epoch(c.conn_departure) - epoch(t.ready)) / 60.0 > 2
GROUP BY journey_id, leg_index""")
def if_missed(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    t = J.tight_transfers(fx.legs, leg_stats(spark, sf_dir))
    return J.if_missed(t, fx.jlegs, fx.connections)


@query("cap_enrichment", """
SELECT t.journey_id, t.leg_index, p.search_id FROM o_tight t JOIN o_pages p ON p.journey_id = t.journey_id""")
def cap_enrichment(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    t = J.tight_transfers(fx.legs, leg_stats(spark, sf_dir))
    return J.cap_enrichment(t, pages(fx)).select("journey_id", "leg_index", "search_id")


@query("leg_flags", """
SELECT CAST(journey_id AS VARCHAR) AS ref, CAST(row_number() OVER (PARTITION BY journey_id ORDER BY leg_idx) - 1 AS INTEGER) AS leg_pos, walking,
  CASE WHEN live_departure IS NOT NULL AND (planned_departure IS NULL OR live_departure <> planned_departure) THEN live_departure END AS departure,
  CASE WHEN live_arrival IS NOT NULL AND (planned_arrival IS NULL OR live_arrival <> planned_arrival) THEN live_arrival END AS arrival,
  j.dticket_covered, j.price_partial, j.price, coalesce(j.transfers, 0) AS transfers
FROM legs JOIN journeys j USING (journey_id)
WHERE journey_id IN (SELECT journey_id FROM legs WHERE NOT walking)""")
def leg_flags(spark, sf_dir):
    """X27 out of the search payload: walking flag, live time only where it deviates, covered /
    partly priced, price and transfers."""
    fx = fixture(spark, sf_dir)
    legs = MS.journey_legs(landed.journey_payloads(fx.jlegs, fx.journeys))
    return legs.select("ref", "leg_pos", "walking", "departure", "arrival", "dticket_covered", "price_partial", "price", "transfers")
