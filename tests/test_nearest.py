"""Nearest stop events by running over a day's minutes (W3, A8), day slots from one reading of the
statistics (J13), and broadcasts by measured sizes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from latewise.operators import journeys as J
from latewise.operators import matching as M
from latewise.session import apply_session_defaults

DAY0 = dt.datetime(2026, 7, 25)


def _tables(spark, n_legs, n_events, seed):
    rnd = random.Random(seed)
    at = lambda: DAY0 + dt.timedelta(days=rnd.randrange(7), seconds=rnd.choice([0, 30]), minutes=rnd.choice([rnd.randrange(1440), rnd.randrange(150), 1439 - rnd.randrange(150)]))
    keyed = []
    for i in range(n_events):
        t = at()
        keyed.append((f"id{i:05d}" if rnd.random() < .9 else None, t, None if rnd.random() < .3 else t + dt.timedelta(minutes=rnd.randrange(9)),
                      rnd.random() < .2, rnd.choice(["5", "5", "6", None]), "08000105", rnd.choice([None, 3])))
    keyed.append(("last", DAY0 + dt.timedelta(days=6, hours=12), None, False, "9", "08000105", None))
    legs = [(i, 1, False, rnd.choice(["5", "05", "6"]), "8000105", "IC", at()) for i in range(n_legs)]
    return (spark.createDataFrame(legs, "journey_id long, leg_idx int, walking boolean, fahrt_nr string, dest_id string, product string, planned_arrival timestamp_ntz"),
            spark.createDataFrame(keyed, "id string, arrival_planned_time timestamp_ntz, arrival_change_time timestamp_ntz, is_canceled boolean, train_no string, eva string, reason_code int"), legs, keyed)


def _plain(legs, keyed):
    out = set()
    for j, _, _, train, _, _, q in legs:
        tod, best = q.hour * 60 + q.minute, {}
        for sid, p, c, *_, in [k for k in keyed if k[4] == train.lstrip("0")]:
            d = abs(p.hour * 60 + p.minute - tod)
            d = min(d, 1440 - d)
            if d <= 120:
                order = (d, p, c is None, c or p, sid is None, sid or "")
                best[p.date()] = min(best.get(p.date(), order), order)
        out |= {(j, day, o[5] or None, o[0]) for day, o in best.items()}
    return out


@pytest.mark.parametrize("n_events", [8, 60, 900])
def test_nearest_of_a_day_as_by_comparing_all(spark, n_events):
    legs, keyed, ll, kk = _tables(spark, 120, n_events, n_events)
    got = [tuple(r) for r in M.closest_per_day(legs, keyed, 7).select("journey_id", "day", "id", "tod_diff").collect()]
    assert len(got) == len(set(got)) and set(got) == _plain(ll, kk) != set()


def test_a_lookup_is_not_joined_with_the_events_of_its_train(spark):
    legs, keyed, _, _ = _tables(spark, 300, 3000, 1)
    _, best, _, _ = M.nearest_per_day(legs, keyed, 7)
    best.collect()

    def most(plan):
        plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
        plan = plan.plan() if plan.nodeName().startswith("ShuffleQueryStage") or plan.nodeName().startswith("BroadcastQueryStage") else plan
        own = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() and plan.metrics().contains("numOutputRows") else 0
        kids = plan.children()
        return max([own, *(most(kids.apply(i)) for i in range(kids.size()))])

    # 300 lookups on at most 7 days; pairs within two hours would be tens of thousands
    assert most(best._jdf.queryExecution().executedPlan()) <= 300 * 7


def test_slots_read_the_statistics_once(spark):
    legs, keyed, _, _ = _tables(spark, 20, 200, 3)
    st = M.leg_delay_stats(legs, keyed, 7)
    slots = J.day_slots(st)
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert joins(slots) <= joins(st)
    rows = slots.collect()
    want = {(r.journey_id, d.day): (d.delay, d.canceled, d.reason) for r in st.collect() for d in r.days}
    assert len(rows) == 7 * st.count()
    assert {(r.journey_id, r.day): (r.delay, r.canceled, r.reason) for r in rows if r.canceled is not None} == want


def test_files_are_not_broadcast_by_their_compressed_size(spark, tmpdir_path):
    apply_session_defaults(spark)
    path = f"{tmpdir_path}/t"
    # 400,000 rows that compress to under ten megabytes, but take more as rows
    spark.range(400_000, numPartitions=1).select("id", (F.rand(1) * 1e9).cast("long").alias("v"), F.repeat(F.lit("x"), 200).alias("s")).write.parquet(path)
    t = spark.read.parquet(path)
    size = int(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert 256 << 10 < size < 10 << 20
    j = t.join(t.withColumnRenamed("v", "w").withColumnRenamed("s", "u"), "id").where("length(s) + length(u) > 0")
    assert "BroadcastHashJoin" not in j._jdf.queryExecution().executedPlan().toString()
    j.agg(F.count("*")).collect()
    assert "BroadcastHashJoin" not in j._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n_events", [4, 80, 900])
def test_nearest_on_the_day_as_by_comparing_all(spark, n_events):
    legs, keyed, ll, kk = _tables(spark, 200, n_events, n_events + 1)
    got = {(r.journey_id, r.delay_min, r.canceled, r.reason) for r in M.leg_on_date(legs, keyed).collect()}
    want = set()
    for j, _, _, train, _, _, q in ll:
        found = []
        for sid, p, c, canc, tr, _, reason in kk:
            a, b = p.hour * 60 + p.minute, q.hour * 60 + q.minute
            if tr == train.lstrip("0") and p.date() == q.date() and min(abs(a - b), 1440 - abs(a - b)) <= 120:
                delay = None if canc else 0 if c is None else (c.date() - p.date()).days * 1440 + c.hour * 60 + c.minute - a
                found.append(((abs(a - b), p, c is None, c or p, sid is None, sid or ""), (j, delay, canc, reason)))
        if found:
            want.add(min(found, key=lambda x: x[0])[1])
    assert got == want != set()


def test_a_lookup_of_a_day_is_not_joined_with_its_events(spark):
    legs, keyed, _, _ = _tables(spark, 20, 200, 5)
    plan = M.leg_on_date(legs, keyed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the legs with the answers


def test_pairs_of_the_history_join_are_made_last_and_not_shuffled(spark):
    legs, keyed, ll, kk = _tables(spark, 80, 400, 3)
    _, cand, _, _ = M.history_candidates(legs, keyed, 7)
    got = cand.select("journey_id", "h_id", "h_planned", "tod_diff")
    lines = got._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert sum("Join" in x for x in lines) == 1
    want = []
    for j, _, _, train, _, _, q in ll:
        for sid, p, *_, in [k for k in kk if k[4] == train.lstrip("0")]:
            d = abs(p.hour * 60 + p.minute - q.hour * 60 - q.minute)
            if min(d, 1440 - d) <= 120:
                want.append((j, sid, p, min(d, 1440 - d)))
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r) for r in got.collect()) == order(want) != []
