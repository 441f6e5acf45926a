"""IT run snapshots, registry and poll cycle: N6, W8, N7, F12, T3, A17."""

from __future__ import annotations

from pyspark.sql import functions as F

from latewise.operators import runs as R
from latewise.plans.oracle_fixture import register
from latewise.plans.registry import fixture, query
from latewise.sources import feeds

FETCH_TS = 1784541600  # 2026-07-20 10:00 UTC, one poll cycle
MIN_DAY = "20260703"
X = "substr(eva, 4, 5)"

register("o_it_run", """
SELECT *, origin || '-' || number || '-' || CAST(dep_ms AS VARCHAR) AS train_key FROM (
  SELECT ok, arg_min('S' || substr(eva, 4, 5), ln) AS origin, arg_min(train_type, ln) AS category,
         arg_min(final_destination_station, ln) AS dest, CAST(ok % 900 + 100 AS VARCHAR) AS number,
         CASE WHEN ok % 23 = 0 THEN 1 ELSE 0 END AS provv,
         strftime(arg_min(coalesce(departure_planned_time, arrival_planned_time), ln), '%Y%m%d') AS day,
         epoch_ms(timezone('Europe/Rome', arg_min(coalesce(departure_planned_time, arrival_planned_time), ln))) AS dep_ms
  FROM fx_latest GROUP BY ok)""")
register("o_it_src", f"""
SELECT ok, ln, row_number() OVER (PARTITION BY ok ORDER BY ln) - 1 AS idx,
  CASE WHEN ln = 3 AND ok % 5 = 0 THEN NULL ELSE 'S' || {X} END AS code,
  epoch_ms(timezone('Europe/Rome', arrival_planned_time)) - sh AS ap,
  epoch_ms(timezone('Europe/Rome', arrival_change_time)) - sh AS ar,
  epoch_ms(timezone('Europe/Rome', departure_planned_time)) - sh AS dp,
  epoch_ms(timezone('Europe/Rome', departure_change_time)) - sh AS dr,
  CASE WHEN ln = 2 AND ok % 6 = 0 THEN 3 ELSE 0 END AS ftype
FROM (SELECT *, CASE WHEN ln >= 4 AND ok % 5 = 0 THEN 86400000 ELSE 0 END AS sh FROM fx_latest)""")

REPAIR_SQL = """
WITH RECURSIVE vals AS (
  SELECT s.ok, s.ln, t.k, CASE t.k WHEN 0 THEN ap WHEN 1 THEN ar WHEN 2 THEN dp ELSE dr END AS v,
         row_number() OVER (PARTITION BY s.ok ORDER BY s.ln, t.k) AS n
  FROM o_it_src s, range(0, 4) t(k) WHERE s.code IS NOT NULL),
rec AS (
  SELECT v.ok, v.n, v.ln, v.k, x.nv, CASE WHEN x.nv IS NULL THEN x.rm0 ELSE greatest(x.rm0, x.nv) END AS rm
  FROM vals v JOIN o_it_run r ON r.ok = v.ok,
       LATERAL (SELECT coalesce(r.dep_ms, 0) AS rm0,
                       CASE WHEN v.v IS NOT NULL AND v.v < coalesce(r.dep_ms, 0) - 43200000 THEN v.v + 86400000 ELSE v.v END AS nv) x
  WHERE v.n = 1
  UNION ALL
  SELECT v.ok, v.n, v.ln, v.k, x.nv, CASE WHEN x.nv IS NULL THEN rec.rm ELSE greatest(rec.rm, x.nv) END
  FROM rec JOIN vals v ON v.ok = rec.ok AND v.n = rec.n + 1,
       LATERAL (SELECT CASE WHEN v.v IS NOT NULL AND v.v < rec.rm - 43200000 THEN v.v + 86400000 ELSE v.v END AS nv) x),
stops AS (
  SELECT s.ok, s.ln, s.idx, s.code, s.ftype,
         max(rec.nv) FILTER (WHERE rec.k = 0) AS ap, max(rec.nv) FILTER (WHERE rec.k = 1) AS ar,
         max(rec.nv) FILTER (WHERE rec.k = 2) AS dp, max(rec.nv) FILTER (WHERE rec.k = 3) AS dr
  FROM o_it_src s JOIN rec ON rec.ok = s.ok AND rec.ln = s.ln
  GROUP BY s.ok, s.ln, s.idx, s.code, s.ftype)"""


def _local(ms: str) -> str:
    return f"timezone('Europe/Rome', to_timestamp({ms} / 1000.0))"


@query("cross_midnight_repair", REPAIR_SQL + """
SELECT r.train_key, s.idx AS stop_num, s.ap, s.ar, s.dp, s.dr FROM stops s JOIN o_it_run r ON r.ok = s.ok""")
def cross_midnight_repair(spark, sf_dir):
    """W8 on every run snapshot: repaired epoch-ms times per kept stop."""
    pl = feeds.it_run_payloads(fixture(spark, sf_dir).latest)
    p = pl.select("train_key", F.from_json("payload", R.RUN_SCHEMA).alias("r"))
    st = p.select("train_key", F.explode(R.repair_stops(F.col("r.fermate"), F.col("r.dataPartenzaTreno"))).alias("s"))
    return st.select("train_key", F.col("s.idx").alias("stop_num"), F.col("s.ap").alias("ap"), F.col("s.ar").alias("ar"),
                     F.col("s.dp").alias("dp"), F.col("s.dr").alias("dr"))


@query("run_snapshots", REPAIR_SQL + f"""
SELECT r.day, r.train_key, s.code AS stop_code, s.idx AS stop_num, r.number, r.category, r.dest,
  {_local('s.ap')} AS arr_plan, {_local('s.ar')} AS arr_real, {_local('s.dp')} AS dep_plan, {_local('s.dr')} AS dep_real,
  CAST(r.provv = 1 OR coalesce(s.ftype = 3, false) AS INTEGER) AS arr_cncl,
  CAST(r.provv = 1 OR coalesce(s.ftype = 3, false) AS INTEGER) AS dep_cncl
FROM stops s JOIN o_it_run r ON r.ok = s.ok WHERE s.ap IS NOT NULL OR s.dp IS NOT NULL""")
def run_snapshots(spark, sf_dir):
    stops, _ = R.run_snapshots(feeds.it_run_payloads(fixture(spark, sf_dir).latest))
    return stops


RUNS_SQL = REPAIR_SQL + """,
kept AS (SELECT * FROM stops WHERE ap IS NOT NULL OR dp IS NOT NULL),
lastf AS (SELECT ok, arg_max_null(ar, ln) IS NOT NULL AS arrived FROM o_it_src GROUP BY ok),
runs AS (
  SELECT r.day, r.train_key, (SELECT arg_max(coalesce(k.ap, k.dp), k.ln) FROM kept k WHERE k.ok = r.ok) AS last_plan_ms,
         coalesce(l.arrived, false) AS arrived,
         (SELECT count(*) FROM kept k WHERE k.ok = r.ok) > 0 AS has_rows, r.number
  FROM o_it_run r LEFT JOIN lastf l ON l.ok = r.ok)"""


@query("run_state", RUNS_SQL + "\nSELECT day, train_key, last_plan_ms, arrived, has_rows FROM runs")
def run_state(spark, sf_dir):
    """N6 per run: last planned arrival (ms) and whether the last stop reported."""
    _, runs = R.run_snapshots(feeds.it_run_payloads(fixture(spark, sf_dir).latest))
    return runs


REGISTRY_SQL = f"""
SELECT day, train_key, origin, num AS number, dep_ms, category, fetch_ts AS first_seen FROM (
  SELECT *, strftime({_local('dep_ms')}, '%Y%m%d') AS day, origin || '-' || num || '-' || CAST(dep_ms AS VARCHAR) AS train_key
  FROM (SELECT CASE WHEN l.ok % 31 = 0 THEN '' ELSE r.number END AS num,
               CASE WHEN l.ok % 29 = 0 THEN NULL ELSE r.origin END AS origin, r.dep_ms, l.train_type AS category,
               CAST(epoch(timezone('Europe/Rome', coalesce(l.arrival_planned_time, l.departure_planned_time))) AS BIGINT) - 3600 AS fetch_ts,
               l.ln AS seq, l.id AS board_id
        FROM fx_latest l JOIN o_it_run r ON r.ok = l.ok)
  WHERE num IS NOT NULL AND num <> '' AND origin IS NOT NULL AND origin <> '' AND dep_ms IS NOT NULL)
WHERE day >= '{MIN_DAY}'
QUALIFY row_number() OVER (PARTITION BY day, train_key ORDER BY fetch_ts, seq, board_id) = 1"""
register("o_registry", REGISTRY_SQL)


def registry(fx):
    return R.run_registry(feeds.it_board_rows(fx.latest), MIN_DAY)


@query("run_registry", "SELECT * FROM o_registry")
def run_registry(spark, sf_dir):
    return registry(fixture(spark, sf_dir))


LIFE_SQL = RUNS_SQL + f""",
reg AS (SELECT *, CAST(dep_ms // 60000 AS BIGINT) % 7 AS fails FROM o_registry),
answered AS (SELECT * FROM runs WHERE NOT ends_with(number, '3')),
life AS (
  SELECT g.day, g.train_key,
    CASE WHEN a.has_rows IS NOT NULL THEN 0 ELSE g.fails + 1 END AS fails,
    CAST(CASE WHEN a.has_rows IS NOT NULL
              THEN CASE WHEN a.has_rows THEN a.arrived OR {FETCH_TS}000 > coalesce(a.last_plan_ms, g.dep_ms) + 14400000
                        ELSE {FETCH_TS}000 > coalesce(a.last_plan_ms, g.dep_ms) + 14400000 END
              ELSE g.fails + 1 >= 5 AND {FETCH_TS}000 > g.dep_ms END AS INTEGER) AS done,
    CAST(CASE WHEN a.has_rows IS NOT NULL THEN greatest({FETCH_TS} + 900, CAST(trunc(g.dep_ms / 1000) AS BIGINT) - 900)
              ELSE {FETCH_TS} + 300 * (g.fails + 1) END AS BIGINT) AS next_poll
  FROM reg g LEFT JOIN answered a ON a.day = g.day AND a.train_key = g.train_key)"""


def lifecycle(fx):
    reg = registry(fx).withColumn("fails", (F.col("dep_ms") / 60000).cast("long") % 7)
    payloads = feeds.it_run_payloads(fx.latest).filter(~F.col("number").endswith("3"))
    _, runs = R.run_snapshots(payloads)
    return R.run_lifecycle(reg, runs, FETCH_TS)


@query("run_lifecycle", LIFE_SQL + "\nSELECT * FROM life")
def run_lifecycle(spark, sf_dir):
    return lifecycle(fixture(spark, sf_dir))


@query("due_runs", LIFE_SQL + f"""
SELECT * FROM life WHERE done = 0 AND next_poll <= {FETCH_TS + 7200} ORDER BY next_poll, day, train_key LIMIT 25""")
def due_runs(spark, sf_dir):
    return R.due_runs(lifecycle(fixture(spark, sf_dir)), FETCH_TS + 7200, 25)


@query("store_stats", LIFE_SQL + """
SELECT (SELECT count(*) FROM observations) AS obs_rows,
       (SELECT count(DISTINCT CAST(fetch_ts AS DATE)) FROM observations) AS obs_days,
       (SELECT count(*) FROM life WHERE done = 0) AS open_runs, (SELECT count(*) FROM life) AS total_runs""")
def store_stats(spark, sf_dir):
    """Observation rows and distinct days; registry open and total runs."""
    fx = fixture(spark, sf_dir)
    life = lifecycle(fx)
    runs = life.agg(F.count_if(F.col("done") == 0).alias("open_runs"), F.count(F.lit(1)).alias("total_runs"))
    seen = fx.observations.agg(F.count(F.lit(1)).alias("obs_rows"), F.countDistinct(F.to_date("fetch_ts")).alias("obs_days"))
    # one row each
    return seen.crossJoin(runs)
