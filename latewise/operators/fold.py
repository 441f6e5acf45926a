"""Observation folding: repeated snapshots of one stop -> one last-known record.

Every fold is an associative merge: each field carries the sequence number of the row it
came from, so folding a stored state together with new rows gives the same answer as
folding all rows at once. That is what lets the same function run in batch and under
Structured Streaming (``latewise.streaming.fold_stream``). All folds are grouped
aggregations with partial (map-side) aggregation before the shuffle on the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = {"arr": ("arr_time", "arr_delay"), "dep": ("dep_time", "dep_delay")}


def _present(cols: Sequence[str], mode: str) -> Column:
    """FR/NL: a side counts if its time OR delay is known; AT: only if its (first)
    planned time is."""
    if mode == "planned":
        return F.col(cols[0]).isNotNull()
    out = F.lit(False)
    for c in cols:
        out = out | F.col(c).isNotNull()
    return out


def to_sided(obs: DataFrame, key: str | Sequence[str] = "obs_key", seq: str = "seq", presence: str = "any",
             text: Sequence[str] = ("descr",), status: Sequence[str] = ("status",),
             sides: dict = SIDES) -> DataFrame:
    """Raw observation rows -> the fold's state shape (one sequence per field)."""
    cols = [F.col(k) for k in ([key] if isinstance(key, str) else key)]
    for side, fields in sides.items():
        p = _present(fields, presence)
        cols += [F.struct(*[F.col(f) for f in fields]).alias(side), F.when(p, F.col(seq)).alias(side + "_seq")]
    for t in text:
        cols += [F.col(t), F.when(F.col(t).isNotNull(), F.col(seq)).alias(t + "_seq")]
    for s in status:
        cols += [F.col(s), F.col(seq).alias(s + "_seq")]
    cols += [F.col("fetch_ts"), F.col(seq).alias("fetch_seq")]
    return obs.select(*cols)


def merge_sided(state: DataFrame, key: str | Sequence[str] = "obs_key", text: Sequence[str] = ("descr",),
                status: Sequence[str] = ("status",), sides: dict = SIDES) -> DataFrame:
    """I1 merge on the state shape: each side replaced as a unit by the newest row that
    carries it; text fields keep the newest non-NULL value; status fields take the
    newest value even if NULL."""
    aggs = []
    for side in sides:
        aggs += [F.max_by(side, side + "_seq").alias(side), F.max(side + "_seq").alias(side + "_seq")]
    for t in list(text):
        aggs += [F.max_by(t, t + "_seq").alias(t), F.max(t + "_seq").alias(t + "_seq")]
    for s in status:
        aggs += [F.max_by(s, s + "_seq").alias(s), F.max(s + "_seq").alias(s + "_seq")]
    aggs += [F.max_by("fetch_ts", "fetch_seq").alias("fetch_ts"), F.max("fetch_seq").alias("fetch_seq")]
    return state.groupBy(*([key] if isinstance(key, str) else key)).agg(*aggs)


def flatten_sided(state: DataFrame, key: str | Sequence[str] = "obs_key", text: Sequence[str] = ("descr",),
                  status: Sequence[str] = ("status",), sides: dict = SIDES) -> DataFrame:
    cols = [key] if isinstance(key, str) else list(key)
    for side, fields in sides.items():
        cols += [F.col(f"{side}.{f}").alias(f) for f in fields]
    return state.select(*cols, *text, *status, "fetch_ts")


def sided_upsert(obs: DataFrame, **kw) -> DataFrame:
    """I1 in batch: fold all observation rows of each key."""
    presence = kw.pop("presence", "any")
    return flatten_sided(merge_sided(to_sided(obs, presence=presence, **kw)))


def coalesce_upsert(obs: DataFrame, key: str, seq: str, fields: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Newest non-NULL value per field; flags take the newest value."""
    aggs = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(seq))).alias(f) for f in fields]
    aggs += [F.max_by(f, seq).alias(f) for f in flags]
    return obs.groupBy(key).agg(*aggs)


def non_empty_upsert(obs: DataFrame, key: str, seq: str, fields: Sequence[str], text: str, attachment: str) -> DataFrame:
    """The first row wins; a later non-empty text and a later non-NULL attachment
    override it."""
    t_ok = F.col(text).isNotNull() & (F.col(text) != "")
    aggs = [F.min_by(f, seq).alias(f) for f in fields]
    aggs += [F.coalesce(F.max_by(text, F.when(t_ok, F.col(seq))), F.min_by(text, seq)).alias(text),
             F.coalesce(F.max_by(attachment, F.when(F.col(attachment).isNotNull(), F.col(seq))),
                        F.min_by(attachment, seq)).alias(attachment)]
    return obs.groupBy(key).agg(*aggs)


def insert_or_ignore(obs: DataFrame, key: str | Sequence[str], seq: str, fields: Sequence[str]) -> DataFrame:
    """I4: the first row per key wins (min_by on the arrival sequence)."""
    keys = [key] if isinstance(key, str) else list(key)
    return obs.groupBy(*keys).agg(*[F.min_by(f, seq).alias(f) for f in fields])


def state_retention(state: DataFrame, day_col: Column, today, keep_days: int = 3) -> DataFrame:
    """Drop the observations of days before ``today - keep_days`` (that day stays). ``today``
    is the clock's day (a date or Column), not the newest row's, so a row with a date to come
    costs nothing."""
    today = today if isinstance(today, Column) else F.lit(today)
    return state.filter(day_col >= F.date_sub(today, keep_days))


def poll_cycle_counts(obs: DataFrame, ts: str = "fetch_ts", every: str = "2 minutes") -> DataFrame:
    """I8: rows per poll cycle (tumbling window on the fetch time)."""
    return (obs.groupBy(F.window(ts, every).alias("w")).agg(F.count(F.lit(1)).alias("rows"))
            .select(F.col("w.start").alias("cycle_start"), F.col("w.end").alias("cycle_end"), "rows"))


SNAPSHOT_ROW = ("ARRAY<STRUCT<seq: BIGINT, obs_key: BIGINT, fetch_ts: TIMESTAMP_NTZ, arr_time: TIMESTAMP_NTZ, "
                "arr_delay: INT, dep_time: TIMESTAMP_NTZ, dep_delay: INT, status: STRING, descr: STRING>>")
JSON_TS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def snapshot_replay(snapshots: DataFrame, name: str = "name", payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Replay an archive of snapshots in name order (names embed the fetch time);
    undecodable snapshots are skipped and counted. Arrival order = (file name, position
    in the file), used as the fold's sequence, so no global numbering is needed."""
    parsed = snapshots.select(name, F.from_json(F.col(payload), SNAPSHOT_ROW, JSON_TS).alias("_rows"))
    bad = parsed.filter(F.col("_rows").isNull()).agg(F.count(F.lit(1)).alias("skipped"))
    rows = parsed.filter(F.col("_rows").isNotNull()).select(name, F.posexplode("_rows").alias("pos", "r"))
    obs = rows.select(F.struct(F.col(name), F.col("pos")).alias("seq_in"), "r.*").drop("seq").withColumnRenamed("seq_in", "seq")
    return sided_upsert(obs), bad
