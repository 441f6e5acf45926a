"""Structured Streaming form of the observation fold.

Landed feed snapshots arrive as files. An observation is keyed by the feed's own service day and
its key, whenever it was polled, so a run past midnight stays one row. The state is a
log-structured table (``sources.ledger``): a micro-batch is folded by itself and appended as one
run of the days that it touches; readers merge a day's runs by the sequence number of each side.
Where a day has ``FAN`` runs of one level, they are folded into one of the next level, so a row is
rewritten once a level: what a batch writes follows the size of the batch, not that of the day.

The commit of a batch carries its number. A batch that is replayed after a lost driver or executor
finds itself committed and does nothing; the streaming checkpoint records which files were
consumed. Rows without a service day or a key or a sequence number cannot be folded: they are
kept apart (``rejected``). Days before the retention leave the table with the next commit.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latewise.operators import fold
from latewise.sources.ledger import Ledger

OBS_SCHEMA = T.StructType([
    T.StructField("service_day", T.DateType()),
    T.StructField("obs_key", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("fetch_ts", T.TimestampNTZType()),
    T.StructField("arr_time", T.TimestampNTZType()), T.StructField("arr_delay", T.IntegerType()),
    T.StructField("dep_time", T.TimestampNTZType()), T.StructField("dep_delay", T.IntegerType()),
    T.StructField("status", T.StringType()), T.StructField("descr", T.StringType()),
])
KEY = ["service_day", "obs_key"]
#: Runs of a level that are folded into one of the next.
FAN = 4


def snapshot_source(spark: SparkSession, folder: str, schema: T.StructType = OBS_SCHEMA,
                    max_files: int | None = None, fmt: str = "parquet") -> DataFrame:
    """A folder of landed snapshots as a stream (explicit schema, no inference)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(folder)


def state_ledger(spark: SparkSession, state_dir: str) -> Ledger:
    return Ledger(spark, f"{state_dir}/state")


def rejected(spark: SparkSession, state_dir: str) -> DataFrame:
    """The observations that no batch could fold, as they came."""
    found = Ledger(spark, f"{state_dir}/rejected").read()
    return spark.createDataFrame([], OBS_SCHEMA) if found is None else found


def latest_state(spark: SparkSession, state_dir: str, days: list[str] | None = None) -> DataFrame | None:
    """The state (of the given days): the runs of each day, merged."""
    runs = state_ledger(spark, state_dir).read(parts=days)
    return None if runs is None else fold.merge_sided(runs, key=KEY)


def _foldable() -> F.Column:
    return F.col("service_day").isNotNull() & F.col("obs_key").isNotNull() & F.col("seq").isNotNull()


def _append_rejected(batch: DataFrame, state_dir: str, batch_id: int) -> None:
    bad = batch.filter(~_foldable())
    ledger = Ledger(batch.sparkSession, f"{state_dir}/rejected")
    if ledger.snapshot().meta.get("batch", -1) < batch_id and not bad.isEmpty():
        new = ledger.write(bad)
        ledger.update(lambda base: ({k: base.parts.get(k, []) + v for k, v in new.items()}, {"batch": batch_id}))


def compact(ledger: Ledger, fan: int = FAN) -> int:
    """Fold the runs of a level, where a day has ``fan`` of them, into one of the next level, all
    such days together; until there are none. Returns the number of rounds."""
    rounds = 0
    while True:
        due: dict[str, list[tuple[str, int]]] = {}
        base = ledger.snapshot()
        for day, runs in base.parts.items():
            for level in sorted({n for _, n in runs}):
                own = [r for r in runs if r[1] == level]
                if len(own) >= fan:
                    due[day] = own
                    break
        if not due:
            return rounds
        for level in sorted({v[0][1] for v in due.values()}):
            days = {d: v for d, v in due.items() if v[0][1] == level}
            merged = fold.merge_sided(ledger.read_folders([f for v in days.values() for f, _ in v]), key=KEY)
            new = ledger.write(merged, "service_day", level + 1)
            ledger.update(lambda now: (now.parts | {  # noqa: B023
                d: [r for r in now.parts[d] if r not in v] + new.get(d, []) for d, v in days.items() if d in now.parts}, None))  # noqa: B023
        rounds += 1


def fold_batch_writer(state_dir: str, presence: str = "any", retention_days: int | None = 3, today=None, fan: int = FAN):
    """foreachBatch function: append the folded micro-batch. Service days before ``today -
    retention_days`` leave the state, rows of them are not taken up (``today``: the clock's,
    unless given)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        ledger = state_ledger(batch.sparkSession, state_dir)
        if ledger.snapshot().meta.get("batch", -1) >= batch_id:
            return
        _append_rejected(batch, state_dir, batch_id)
        cutoff = None if retention_days is None else (today or dt.date.today()) - dt.timedelta(days=retention_days)
        rows = batch.filter(_foldable() & (F.lit(True) if cutoff is None else F.col("service_day") >= F.lit(cutoff)))
        new = ledger.write(fold.merge_sided(fold.to_sided(rows, presence=presence, key=KEY), key=KEY), "service_day")

        def change(base):
            old = {d: v for d, v in base.parts.items() if cutoff is None or d >= cutoff.isoformat()}
            return {d: old.get(d, []) + new.get(d, []) for d in [*old, *new]}, {"batch": batch_id}

        ledger.update(change)
        compact(ledger, fan)
        ledger.collect()
    return write


def run_fold_stream(spark: SparkSession, source_dir: str, state_dir: str, checkpoint: str,
                    max_files: int | None = 1, presence: str = "any", retention_days: int | None = 3, today=None) -> DataFrame:
    """Drain all landed files (``availableNow``) through the fold; return the final state."""
    q = (snapshot_source(spark, source_dir, max_files=max_files).writeStream
         .foreachBatch(fold_batch_writer(state_dir, presence, retention_days, today))
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return fold.flatten_sided(latest_state(spark, state_dir), key=KEY)
