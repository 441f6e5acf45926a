"""Leg matching queries: A8 and its per-day array, J5, W3, J6/M1/M2, F7."""

from __future__ import annotations

from pyspark.sql import functions as F

from latewise.operators import matching as M
from latewise.plans.oracle_fixture import tod_distance_sql
from latewise.plans.registry import fixture, query

UNTRACKED_SQL = ", ".join(f"'{p}'" for p in M.UNTRACKED_PRODUCTS)

LOOKUP_LEGS_SQL = f"""
SELECT *, ltrim(replace(fahrt_nr, ' ', ''), '0') AS q_train_no,
       CASE WHEN length(dest_id) < 8 THEN lpad(dest_id, 8, '0') ELSE dest_id END AS q_eva
FROM legs
WHERE NOT walking AND coalesce(product, '') NOT IN ({UNTRACKED_SQL})
  AND fahrt_nr IS NOT NULL AND fahrt_nr <> '' AND planned_arrival IS NOT NULL AND dest_id IS NOT NULL"""


def _stats_sql(window: int) -> str:
    return f"""
, bounds AS (SELECT max(CAST(arrival_planned_time AS DATE)) AS max_day FROM keyed WHERE arrival_planned_time IS NOT NULL)
, cand AS (
  SELECT q.journey_id, q.leg_idx, CAST(k.arrival_planned_time AS DATE) AS day, k.arrival_planned_time AS h_planned,
         k.arrival_change_time AS h_change, k.id AS h_id,
         date_diff('minute', k.arrival_planned_time, k.arrival_change_time) AS arr_delay,
         k.is_canceled, k.reason_code,
         {tod_distance_sql('k.arrival_planned_time', 'q.planned_arrival')} AS tod_diff,
         b.max_day
  FROM ql q JOIN keyed k ON k.train_no = q.q_train_no AND k.eva = q.q_eva CROSS JOIN bounds b
  WHERE k.arrival_planned_time IS NOT NULL AND CAST(k.arrival_planned_time AS DATE) >= b.max_day - {window - 1})
, best AS (
  SELECT * FROM cand WHERE tod_diff <= 120
  QUALIFY row_number() OVER (PARTITION BY journey_id, leg_idx, day
                             ORDER BY tod_diff, h_planned, h_change NULLS LAST, h_id) = 1)"""


def _stats_oracle(window: int) -> str:
    return f"""
WITH ql AS ({LOOKUP_LEGS_SQL}) {_stats_sql(window)}
SELECT journey_id, leg_idx,
  round(median(arr_delay) FILTER (WHERE NOT is_canceled AND arr_delay IS NOT NULL), 1) AS median_delay,
  CAST(max(arr_delay) FILTER (WHERE NOT is_canceled AND arr_delay IS NOT NULL) AS INTEGER) AS max_delay,
  count(*) AS days_matched,
  CAST(sum(CASE WHEN is_canceled THEN 1 ELSE 0 END) AS BIGINT) AS canceled_days,
  CAST(max(max_day) - {window - 1} AS DATE) AS window_start, max(max_day) AS window_end
FROM best GROUP BY journey_id, leg_idx"""


def _q_stats(window):
    def run(spark, sf_dir):
        fx = fixture(spark, sf_dir)
        return M.leg_delay_stats(fx.legs, fx.keyed, window_days=window, with_days=False)
    return run


query("leg_delay_stats", _stats_oracle(7))(_q_stats(7))
query("leg_delay_stats_15", _stats_oracle(15))(_q_stats(15))
query("leg_delay_stats_30", _stats_oracle(30))(_q_stats(30))


@query("leg_delay_windows", "\nUNION ALL ".join(f"SELECT CAST({w} AS INTEGER) AS window_days, * FROM ({_stats_oracle(w)})" for w in (7, 15, 30)))
def leg_delay_windows(spark, sf_dir):
    """A8 for 7, 15 and 30 days in one scan."""
    fx = fixture(spark, sf_dir)
    return M.leg_delay_windows(fx.legs, fx.keyed)


@query("leg_delay_days", f"""
WITH ql AS ({LOOKUP_LEGS_SQL}) {_stats_sql(7)}
SELECT journey_id, leg_idx, day, CASE WHEN is_canceled THEN NULL ELSE CAST(arr_delay AS INTEGER) END AS delay,
       is_canceled AS canceled, reason_code AS reason
FROM best""")
def leg_delay_days(spark, sf_dir):
    """A8's per-day array, exploded back to rows (the array itself is sorted by day)."""
    fx = fixture(spark, sf_dir)
    st = M.leg_delay_stats(fx.legs, fx.keyed, window_days=7, with_days=True)
    return st.select("journey_id", "leg_idx", F.inline("days"))


@query("untracked_product_filter", f"""
SELECT journey_id, leg_idx, product FROM legs
WHERE NOT walking AND coalesce(product, '') NOT IN ({UNTRACKED_SQL})""")
def untracked_product_filter(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return fx.legs.filter(~F.col("walking") & M.tracked_product()).select("journey_id", "leg_idx", "product")


def _on_date_oracle(side: str) -> str:
    p, c = f"{side}_planned_time", f"{side}_change_time"
    lp, station = f"planned_{side}", "dest_id" if side == "arrival" else "origin_id"
    reason = ", reason_code AS reason" if side == "arrival" else ""
    return f"""
WITH q AS (SELECT journey_id, leg_idx, ltrim(replace(fahrt_nr, ' ', ''), '0') AS q_train_no,
                  CASE WHEN length({station}) < 8 THEN lpad({station}, 8, '0') ELSE {station} END AS q_eva,
                  {lp} AS q_planned
           FROM jlegs WHERE fahrt_nr IS NOT NULL AND fahrt_nr <> '' AND {lp} IS NOT NULL AND {station} IS NOT NULL),
cand AS (
  SELECT q.journey_id, q.leg_idx, k.{p} AS h_planned, k.{c} AS h_change, k.id AS h_id, k.is_canceled, k.reason_code,
         date_diff('minute', k.{p}, k.{c}) AS d,
         abs(date_diff('minute', q.q_planned, k.{p})) AS abs_diff
  FROM q JOIN keyed k ON k.train_no = q.q_train_no AND k.eva = q.q_eva
   AND CAST(k.{p} AS DATE) = CAST(q.q_planned AS DATE)
  WHERE k.{p} IS NOT NULL
    AND {tod_distance_sql(f'k.{p}', 'q.q_planned')} <= 120
  QUALIFY row_number() OVER (PARTITION BY journey_id, leg_idx ORDER BY abs_diff, h_planned, h_change NULLS LAST, h_id) = 1)
SELECT journey_id, leg_idx, CASE WHEN is_canceled THEN NULL ELSE CAST(coalesce(d, 0) AS INTEGER) END AS delay_min,
       is_canceled AS canceled {reason}
FROM cand"""


@query("leg_delay_on_date", _on_date_oracle("arrival"))
def leg_delay_on_date(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return M.leg_on_date(fx.legs, fx.keyed, side="arrival")


@query("leg_departure_on_date", _on_date_oracle("departure"))
def leg_departure_on_date(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return M.leg_on_date(fx.jlegs, fx.keyed, side="departure", station="origin_id")


@query("leg_history_join", f"""
WITH ql AS ({LOOKUP_LEGS_SQL}) {_stats_sql(7)}
SELECT journey_id, leg_idx, h_id AS id, tod_diff FROM cand WHERE tod_diff <= 120""")
def leg_history_join(spark, sf_dir):
    """Legs x stop events of the window on (train key, station), within 120 min of
    time of day."""
    fx = fixture(spark, sf_dir)
    _, cand, _, _ = M.history_candidates(fx.legs, fx.keyed, 7)
    return cand.select("journey_id", "leg_idx", F.col("h_id").alias("id"), "tod_diff")


@query("closest_per_day", f"""
WITH ql AS ({LOOKUP_LEGS_SQL}) {_stats_sql(7)}
SELECT journey_id, leg_idx, day, h_id AS id, tod_diff FROM best""")
def closest_per_day(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return M.closest_per_day(fx.legs, fx.keyed, 7)
