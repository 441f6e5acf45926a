"""Observation folds on the ``events``-derived observation rows: I1-I4, I6, I8."""

from __future__ import annotations

from pyspark.sql import functions as F

from latewise.operators import fold as FO
from latewise.plans.registry import fixture, query


def _obs(spark, sf_dir):
    return fixture(spark, sf_dir).observations


@query("sided_upsert", """
SELECT obs_key,
  arg_max_null(arr_time, seq) FILTER (WHERE arr_time IS NOT NULL OR arr_delay IS NOT NULL) AS arr_time,
  arg_max_null(arr_delay, seq) FILTER (WHERE arr_time IS NOT NULL OR arr_delay IS NOT NULL) AS arr_delay,
  arg_max_null(dep_time, seq) FILTER (WHERE dep_time IS NOT NULL OR dep_delay IS NOT NULL) AS dep_time,
  arg_max_null(dep_delay, seq) FILTER (WHERE dep_time IS NOT NULL OR dep_delay IS NOT NULL) AS dep_delay,
  arg_max(descr, seq) AS descr, arg_max_null(status, seq) AS status, arg_max_null(fetch_ts, seq) AS fetch_ts
FROM observations GROUP BY obs_key""")
def sided_upsert(spark, sf_dir):
    return FO.sided_upsert(_obs(spark, sf_dir))


@query("sided_upsert_planned", """
SELECT obs_key,
  arg_max_null(arr_time, seq) FILTER (WHERE arr_time IS NOT NULL) AS arr_time,
  arg_max_null(arr_delay, seq) FILTER (WHERE arr_time IS NOT NULL) AS arr_delay,
  arg_max_null(dep_time, seq) FILTER (WHERE dep_time IS NOT NULL) AS dep_time,
  arg_max_null(dep_delay, seq) FILTER (WHERE dep_time IS NOT NULL) AS dep_delay,
  arg_max(descr, seq) AS descr, arg_max_null(status, seq) AS status, arg_max_null(fetch_ts, seq) AS fetch_ts
FROM observations GROUP BY obs_key""")
def sided_upsert_planned(spark, sf_dir):
    """I1 with the AT presence rule (a side counts only if its planned time is known)."""
    return FO.sided_upsert(_obs(spark, sf_dir), presence="planned")


@query("coalesce_upsert", """
SELECT obs_key, arg_max(arr_time, seq) AS arr_time, arg_max(arr_delay, seq) AS arr_delay,
       arg_max(dep_time, seq) AS dep_time, arg_max(dep_delay, seq) AS dep_delay, arg_max_null(status, seq) AS status
FROM observations GROUP BY obs_key""")
def coalesce_upsert(spark, sf_dir):
    return FO.coalesce_upsert(_obs(spark, sf_dir), "obs_key", "seq",
                              ["arr_time", "arr_delay", "dep_time", "dep_delay"], ["status"])


@query("non_empty_upsert", """
SELECT obs_key, arg_min_null(status, seq) AS status, arg_min_null(fetch_ts, seq) AS fetch_ts,
  coalesce(arg_max(descr, seq) FILTER (WHERE descr IS NOT NULL AND descr <> ''), arg_min_null(descr, seq)) AS descr,
  coalesce(arg_max(arr_delay, seq) FILTER (WHERE arr_delay IS NOT NULL), arg_min_null(arr_delay, seq)) AS arr_delay
FROM observations GROUP BY obs_key""")
def non_empty_upsert(spark, sf_dir):
    return FO.non_empty_upsert(_obs(spark, sf_dir), "obs_key", "seq", ["status", "fetch_ts"], "descr", "arr_delay")


@query("insert_or_ignore", """
SELECT obs_key, CAST(fetch_ts AS DATE) AS day, arg_min_null(seq, seq) AS seq, arg_min_null(status, seq) AS status,
       arg_min_null(fetch_ts, seq) AS fetch_ts
FROM observations GROUP BY obs_key, CAST(fetch_ts AS DATE)""")
def insert_or_ignore(spark, sf_dir):
    o = _obs(spark, sf_dir).withColumn("day", F.to_date("fetch_ts"))
    return FO.insert_or_ignore(o, ["obs_key", "day"], "seq", ["seq", "status", "fetch_ts"])


def _today(o):
    """The day of the newest poll: the clock of this data."""
    return o.select(F.max(F.to_date("fetch_ts"))).scalar()


@query("state_retention", """
SELECT obs_key, CAST(fetch_ts AS DATE) AS day, count(*) AS n FROM observations
WHERE CAST(fetch_ts AS DATE) >= (SELECT max(CAST(fetch_ts AS DATE)) FROM observations) - 3
GROUP BY obs_key, CAST(fetch_ts AS DATE)""")
def state_retention(spark, sf_dir):
    o = _obs(spark, sf_dir)
    kept = FO.state_retention(o, F.to_date("fetch_ts"), _today(o), 3)
    return kept.groupBy("obs_key", F.to_date("fetch_ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("poll_cycle_counts", """
SELECT time_bucket(INTERVAL 2 MINUTE, fetch_ts) AS cycle_start,
       time_bucket(INTERVAL 2 MINUTE, fetch_ts) + INTERVAL 2 MINUTE AS cycle_end, count(*) AS rows
FROM observations GROUP BY 1""")
def poll_cycle_counts(spark, sf_dir):
    return FO.poll_cycle_counts(_obs(spark, sf_dir))


def snapshots(spark, sf_dir):
    """Landed snapshot files: JSON arrays of a fetch minute, in parts of a bounded size (a poll
    grows with the data); some are truncated."""
    from latewise.operators.fold import JSON_TS
    name = F.concat(F.lit("snap-"), F.date_format("fetch_ts", "yyyyMMddHHmm"), F.lit("-"), F.lpad(F.floor(F.col("seq") / 4096).cast("string"), 12, "0"))
    o = _obs(spark, sf_dir).withColumn("name", name)
    g = o.groupBy("name").agg(F.sort_array(F.collect_list(F.struct(
        "seq", "obs_key", "fetch_ts", "arr_time", "arr_delay", "dep_time", "dep_delay", "status", "descr"))).alias("rows"))
    js = F.to_json("rows", JSON_TS)
    corrupt = F.substring("name", 16, 2).cast("int") % 17 == 0
    return g.select("name", F.when(corrupt, F.expr("substring(to_json(rows), 1, 20)")).otherwise(js).alias("payload"))


@query("snapshot_replay", """
SELECT obs_key,
  arg_max_null(arr_time, (name, seq)) FILTER (WHERE arr_time IS NOT NULL OR arr_delay IS NOT NULL) AS arr_time,
  arg_max_null(arr_delay, (name, seq)) FILTER (WHERE arr_time IS NOT NULL OR arr_delay IS NOT NULL) AS arr_delay,
  arg_max_null(dep_time, (name, seq)) FILTER (WHERE dep_time IS NOT NULL OR dep_delay IS NOT NULL) AS dep_time,
  arg_max_null(dep_delay, (name, seq)) FILTER (WHERE dep_time IS NOT NULL OR dep_delay IS NOT NULL) AS dep_delay,
  arg_max(descr, (name, seq)) AS descr, arg_max_null(status, (name, seq)) AS status,
  arg_max_null(fetch_ts, (name, seq)) AS fetch_ts
FROM (SELECT *, strftime(fetch_ts, '%Y%m%d%H%M') || lpad(CAST(seq // 4096 AS VARCHAR), 12, '0') AS name FROM observations)
WHERE minute(fetch_ts) % 17 <> 0
GROUP BY obs_key""")
def snapshot_replay(spark, sf_dir):
    state, _ = FO.snapshot_replay(snapshots(spark, sf_dir))
    return state


@query("snapshot_replay_skipped", """
SELECT count(DISTINCT strftime(fetch_ts, '%Y%m%d%H%M') || '-' || seq // 4096) AS skipped FROM observations WHERE minute(fetch_ts) % 17 = 0""")
def snapshot_replay_skipped(spark, sf_dir):
    _, bad = FO.snapshot_replay(snapshots(spark, sf_dir))
    return bad


def _sided_sql(keys: str) -> str:
    side = "FILTER (WHERE {0}_time IS NOT NULL OR {0}_delay IS NOT NULL) AS {0}_{1}"
    cols = [f"arg_max_null({s}_{f}, seq) " + side.format(s, f) for s in ("arr", "dep") for f in ("time", "delay")]
    return (f"SELECT {keys}, {', '.join(cols)}, arg_max(descr, seq) AS descr, arg_max_null(status, seq) AS status, "
            "arg_max_null(fetch_ts, seq) AS fetch_ts")


@query("stream_fold", _sided_sql("service_day, obs_key") + """
FROM observations WHERE service_day >= (SELECT max(CAST(fetch_ts AS DATE)) FROM observations) - 3
GROUP BY service_day, obs_key""")
def stream_fold(spark, sf_dir):
    """I1, I6 and S10 under Structured Streaming: the observations are landed as five snapshot
    files in the shared folder and drained with ``availableNow`` through the foreachBatch fold,
    keyed by the feed's service day, with three days of retention."""
    import uuid

    from latewise.session import checkpoint_dir
    from latewise.streaming.fold_stream import run_fold_stream
    base = f"{checkpoint_dir(spark)}/stream-fold-{uuid.uuid4().hex}"
    obs = _obs(spark, sf_dir)
    for p in range(5):
        obs.filter(F.col("seq") % 5 == p).write.parquet(f"{base}/landed/f{p}")
    today = obs.agg(F.max(F.to_date("fetch_ts"))).first()[0]
    return run_fold_stream(spark, f"{base}/landed/*", f"{base}/state", f"{base}/ckpt", max_files=1, today=today)
