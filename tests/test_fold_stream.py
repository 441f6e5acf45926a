"""The streaming fold must equal the batch fold for any split of the input."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from latewise.operators import fold
from latewise.sources.fixture import Fixture
from latewise.streaming import fold_stream
from latewise.streaming.fold_stream import KEY, run_fold_stream

SF_SMALL = "/root/testdata/sf0.001"


def _rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(cols).collect()), key=repr)


def _batch(obs):
    return _rows(fold.flatten_sided(fold.merge_sided(fold.to_sided(obs, key=KEY), key=KEY), key=KEY))


@pytest.mark.parametrize("split", ["by turns", "in order", "newest first"])
def test_stream_equals_batch(spark, tmpdir_path, split):
    obs = Fixture(spark, SF_SMALL).observations
    src, state = os.path.join(tmpdir_path, "landed"), os.path.join(tmpdir_path, "state")
    part = {"by turns": F.col("seq") % 5, "in order": F.ntile(5).over(_w("seq")) - 1, "newest first": 5 - F.ntile(5).over(_w("seq"))}[split]
    parted = obs.withColumn("part", part.cast("int")).repartition(1)
    for p in range(5):
        parted.filter(F.col("part") == p).drop("part").write.parquet(f"{src}/f{p}")
    stream = run_fold_stream(spark, f"{src}/*", state, os.path.join(tmpdir_path, "ckpt"), max_files=1, retention_days=None)
    want = _batch(obs)
    assert _rows(stream) == want and len(want) > 0
    runs = fold_stream.state_ledger(spark, state).snapshot().parts
    assert all(len(v) < 2 * fold_stream.FAN for v in runs.values())


def _w(c):
    from pyspark.sql import Window
    return Window.orderBy(c)


def _obs(spark, rows):
    """(service day, key, seq, poll time, arrival delay, departure delay)"""
    return spark.createDataFrame([(d, k, s, ts, None, a, None, b, f"s{s}", None) for d, k, s, ts, a, b in rows], fold_stream.OBS_SCHEMA)


def test_a_key_polled_on_both_sides_of_midnight_is_one_row(spark, tmpdir_path):
    day, state = dt.date(2026, 7, 10), os.path.join(tmpdir_path, "state")
    first = _obs(spark, [(day, 7, 1, dt.datetime(2026, 7, 10, 23, 58), 4, 5)])
    second = _obs(spark, [(day, 7, 2, dt.datetime(2026, 7, 11, 0, 2), None, 9)])
    write = fold_stream.fold_batch_writer(state, today=dt.date(2026, 7, 11))
    write(first, 0)
    write(second, 1)
    got = fold.flatten_sided(fold_stream.latest_state(spark, state), key=KEY).collect()
    assert [(r.service_day, r.obs_key, r.arr_delay, r.dep_delay, r.status) for r in got] == [(day, 7, 4, 9, "s2")]
    assert _rows(fold.flatten_sided(fold_stream.latest_state(spark, state), key=KEY)) == _batch(first.unionByName(second))


def test_rows_that_cannot_be_filed_are_kept_apart(spark, tmpdir_path):
    day, ts, state = dt.date(2026, 7, 10), dt.datetime(2026, 7, 10, 8), os.path.join(tmpdir_path, "state")
    write = fold_stream.fold_batch_writer(state, today=day)
    odd = [(None, 1, 1, ts, 1, 1), (day, None, 2, ts, 1, 1), (day, 3, None, ts, 1, 1)]
    for _ in range(2):  # a replayed batch is taken once
        write(_obs(spark, [*odd, (day, 4, 4, None, 1, 1)]), 0)
    write(_obs(spark, [(None, 9, 9, ts, 1, 1)]), 1)
    assert sorted(r.status for r in fold_stream.rejected(spark, state).collect()) == ["s1", "s2", "s9", "sNone"]
    assert [(r.obs_key, r.fetch_ts) for r in fold_stream.latest_state(spark, state).collect()] == [(4, None)]


def test_retention_replay_and_untouched_days(spark, tmpdir_path):
    rows = lambda *days: _obs(spark, [(dt.date(2026, 7, d), i, i, dt.datetime(2026, 7, d, 8), 1, 1) for i, d in enumerate(days)])
    state = os.path.join(tmpdir_path, "state")
    ledger = fold_stream.state_ledger(spark, state)
    write = lambda n, df, today: fold_stream.fold_batch_writer(state, today=dt.date(2026, 7, today))(df, n)
    write(0, rows(10, 11, 12), 12)
    before = ledger.snapshot().parts
    write(1, rows(12, 13), 13)
    after = ledger.snapshot()
    assert {d: len(v) for d, v in after.parts.items()} == {"2026-07-10": 1, "2026-07-11": 1, "2026-07-12": 2, "2026-07-13": 1}
    assert after.parts["2026-07-10"] == before["2026-07-10"]  # an untouched day's files are as they were
    write(1, rows(12, 13), 13)  # a replayed batch
    assert ledger.snapshot() == after and fold_stream.latest_state(spark, state).count() == 5
    write(2, rows(10, 14), 14)  # the 10th is past retention by now
    assert list(ledger.snapshot().parts) == ["2026-07-11", "2026-07-12", "2026-07-13", "2026-07-14"]
    # what no kept commit names is gone from the disk
    kept = {f for v in ledger.versions() for fs in ledger.snapshot(v).parts.values() for f, _ in fs}
    assert not any("service_day=2026-07-10" in f for f in kept - {f for v in before.values() for f, _ in v})
    assert fold_stream.latest_state(spark, state).count() == 5


def test_rewritten_rows_follow_the_batch_not_the_day(spark, tmpdir_path, monkeypatch):
    """Sixteen batches on one day: a row is rewritten once a level, and a day has few runs."""
    written = []
    real = fold_stream.Ledger.write
    monkeypatch.setattr(fold_stream.Ledger, "write", lambda self, df, *a, **kw: (written.append(df.count()), real(self, df, *a, **kw))[1])
    state, day = os.path.join(tmpdir_path, "state"), dt.date(2026, 7, 10)
    write = fold_stream.fold_batch_writer(state, today=day)
    for b in range(16):
        write(_obs(spark, [(day, 100 * b + i, 100 * b + i, dt.datetime(2026, 7, 10, 8), 1, 1) for i in range(10)]), b)
        assert len(fold_stream.state_ledger(spark, state).snapshot().parts["2026-07-10"]) <= 2 * (fold_stream.FAN - 1)
    # each of the 160 rows once as it came, once at level one and once at level two
    assert sum(written) == 3 * 160 and fold_stream.latest_state(spark, state).count() == 160
    assert [n for _, n in fold_stream.state_ledger(spark, state).snapshot().parts["2026-07-10"]] == [2]
