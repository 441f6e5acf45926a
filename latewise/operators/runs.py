"""Run registry and run snapshots of the IT feed.

A run snapshot lists its stops in order; the cross-midnight repair (W8) is an
order-dependent fold, expressed with ``aggregate()`` over the stop array of each run,
so it runs per row, spread over the partitions of the snapshot table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latewise.functions.timefn import epoch_ms_to_local

DAY_MS = 86_400_000
HALF_DAY_MS = 12 * 3_600_000
RUN_SCHEMA = ("numeroTreno STRING, categoria STRING, destinazione STRING, provvedimento INT, dataPartenzaTreno BIGINT, "
              "fermate ARRAY<STRUCT<id: STRING, arrivo_teorico: BIGINT, arrivoReale: BIGINT, partenza_teorica: BIGINT, "
              "partenzaReale: BIGINT, actualFermataType: INT>>")
ROME = "Europe/Rome"


def _unwrapped(times: list[Column], rm: Column) -> Column:
    """Array of the running maximum ``rm`` and, after it, ``times`` in order: a time more than 12 h
    below the maximum of all before it moves one day forward. Each time is read once."""
    moved = lambda v, rm: F.when(v < rm - HALF_DAY_MS, v + DAY_MS).otherwise(v)
    return F.aggregate(F.array(*times), F.array(rm), lambda seen, v: F.concat(seen, F.array(moved(v, F.array_max(seen)))))


def repair_stops(fermate: Column, start_ms: Column) -> Column:
    """Fold over the stops in order (arrival plan, arrival real, departure plan,
    departure real); the running maximum starts at the run's departure and includes the
    moved values. Stops without a code are skipped (and do not move the maximum).
    Returns array<struct(idx, code, ap, ar, dp, dr, ftype)>."""
    indexed = F.transform(fermate, lambda f, i: F.struct(i.alias("idx"), f.alias("f")))
    coded = F.filter(indexed, lambda x: x.f.id.isNotNull() & (x.f.id != ""))
    # the stop before carries the maximum, as the greatest of its times and of the one it began with
    item = "STRUCT<idx: INT, code: STRING, ftype: INT, t: ARRAY<BIGINT>>"
    none = F.lit(None)
    init = F.array(F.struct(none.alias("idx"), none.alias("code"), none.alias("ftype"),
                            F.array(F.coalesce(start_ms, F.lit(0))).alias("t"))).cast(f"ARRAY<{item}>")

    def step(acc, x):
        f = x.f
        t = _unwrapped([f.arrivo_teorico, f.arrivoReale, f.partenza_teorica, f.partenzaReale], F.array_max(F.element_at(acc, -1).t))
        stop = F.struct(x.idx.alias("idx"), f.id.alias("code"), f.actualFermataType.alias("ftype"), t.alias("t"))
        return F.concat(acc, F.array(stop.cast(item)))
    folded = F.filter(F.aggregate(coded, init, step), lambda s: s.code.isNotNull())
    return F.transform(folded, lambda s: F.struct(
        s.idx.alias("idx"), s.code.alias("code"), *(s.t[i + 1].alias(c) for i, c in enumerate(("ap", "ar", "dp", "dr"))), s.ftype.alias("ftype")))


def run_snapshots(payloads: DataFrame, json_col: str = "payload") -> DataFrame:
    """Run snapshot JSON -> stop rows (stop order kept, cancelled flag, local times)
    and per-run ``last_plan_ms`` / ``arrived`` (last listed stop has a real arrival)."""
    p = payloads.select("day", "train_key", F.from_json(F.col(json_col), RUN_SCHEMA).alias("r"))
    r = F.col("r")
    fm = r.fermate
    p = p.select("day", "train_key",
                 r.numeroTreno.cast("string").alias("number"),
                 F.nullif(F.trim(r.categoria), F.lit("")).alias("category"),
                 F.nullif(F.trim(r.destinazione), F.lit("")).alias("dest"),
                 F.coalesce(r.provvedimento == 1, F.lit(False)).alias("train_cncl"),
                 ((F.size(F.coalesce(fm, F.array())) > 0)
                  & F.coalesce(F.try_element_at(fm, F.lit(-1)).arrivoReale.isNotNull(), F.lit(False))).alias("arrived"),
                 repair_stops(fm, r.dataPartenzaTreno).alias("stops"))
    kept = F.filter("stops", lambda s: s.ap.isNotNull() | s.dp.isNotNull())
    p = p.withColumn("kept", kept).withColumn(
        "last_plan_ms", F.try_element_at(F.transform("kept", lambda s: F.coalesce(s.ap, s.dp)), F.lit(-1)))
    # outer, as Spark would test what ``explode`` takes before it: read and fold each run once more
    rows = p.select("day", "train_key", "number", "category", "dest", "train_cncl", F.explode_outer("kept").alias("s")).filter(F.col("s").isNotNull())
    cncl = (F.col("train_cncl") | F.coalesce(F.col("s.ftype") == 3, F.lit(False))).cast("int")
    stops = rows.select(
        "day", "train_key", F.col("s.code").alias("stop_code"), F.col("s.idx").alias("stop_num"), "number", "category",
        "dest", epoch_ms_to_local(F.col("s.ap"), ROME).alias("arr_plan"), epoch_ms_to_local(F.col("s.ar"), ROME).alias("arr_real"),
        epoch_ms_to_local(F.col("s.dp"), ROME).alias("dep_plan"), epoch_ms_to_local(F.col("s.dr"), ROME).alias("dep_real"),
        cncl.alias("arr_cncl"), cncl.alias("dep_cncl"))
    runs = p.select("day", "train_key", "last_plan_ms", "arrived", (F.size("kept") > 0).alias("has_rows"))
    return stops, runs


def board_runs(board_rows: DataFrame, min_day: str) -> DataFrame:
    """Board rows with day and run key; rows without number, origin or departure are skipped,
    days before ``min_day`` dropped."""
    b = board_rows.filter(F.col("num").isNotNull() & (F.col("num") != "") & F.col("origin").isNotNull()
                          & (F.col("origin") != "") & F.col("dep_ms").isNotNull())
    b = b.withColumn("day", F.date_format(epoch_ms_to_local(F.col("dep_ms"), ROME), "yyyyMMdd")).filter(F.col("day") >= min_day)
    return b.withColumn("train_key", F.concat_ws("-", "origin", "num", F.col("dep_ms").cast("string")))


def run_registry(board_rows: DataFrame, min_day: str) -> DataFrame:
    """Board rows -> runs, first seen wins per (day, run key)."""
    b = board_runs(board_rows, min_day)
    first = F.struct("fetch_ts", "seq", "board_id")
    return b.groupBy("day", "train_key").agg(
        F.min_by("origin", first).alias("origin"), F.min_by("num", first).alias("number"),
        F.min_by("dep_ms", first).alias("dep_ms"), F.min_by("category", first).alias("category"),
        F.min("fetch_ts").alias("first_seen"))


def run_lifecycle(registry: DataFrame, runs: DataFrame, fetch_ts: int, repoll: int = 900) -> DataFrame:
    """one poll cycle. A run is done when its last stop has a real arrival or it is
    over 4 h past its last planned arrival (runs without stops only by the 4 h rule);
    without an answer the failure count grows and >= 5 misses after departure retire
    it. Next due = max(now + repoll, departure - 900 s)."""
    j = registry.join(runs, ["day", "train_key"], "left")
    answered = F.col("has_rows").isNotNull()
    now_ms = F.lit(fetch_ts * 1000)
    end_ms = F.coalesce(F.col("last_plan_ms"), F.col("dep_ms"))
    late = now_ms > end_ms + 4 * 3_600_000
    fails = F.when(answered, F.lit(0)).otherwise(F.col("fails") + 1)
    done = (F.when(answered, F.when(F.col("has_rows"), F.col("arrived") | late).otherwise(late))
            .otherwise((F.col("fails") + 1 >= 5) & (now_ms > F.col("dep_ms"))))
    nxt = F.when(answered, F.greatest(F.lit(fetch_ts + repoll), (F.col("dep_ms") / 1000).cast("long") - 900)) \
        .otherwise(F.lit(fetch_ts) + 300 * (F.col("fails") + 1))
    return j.select("day", "train_key", fails.alias("fails"), done.cast("int").alias("done"), nxt.cast("long").alias("next_poll"))


def due_runs(state: DataFrame, now: int, batch: int) -> DataFrame:
    """Open runs due by ``now``, earliest first (ties by key), at most ``batch``."""
    return (state.filter((F.col("done") == 0) & (F.col("next_poll") <= now))
            .orderBy("next_poll", "day", "train_key").limit(batch))
