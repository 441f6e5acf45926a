"""Each time of a run is read once, the life of the runs is taken once."""

from pyspark.sql import functions as F

from latewise.operators import runs as R
from latewise.plans.registry import fixture, load_all
from tests.conftest import SF_SMALL

H, DAY = 3_600_000, 86_400_000


def _plain(stops, start):
    rm, out = start or 0, []
    for i, (code, *times, ftype) in enumerate(stops):
        if not code:
            continue
        moved = []
        for v in times:
            if v is not None:
                v = v + DAY if v < rm - 12 * H else v
                rm = max(rm, v)
            moved.append(v)
        out.append((i, code, *moved, ftype))
    return out


CASES = [
    (20 * H, [("A", None, None, 20 * H, 21 * H, 0), ("", 99 * H, 99 * H, 99 * H, 99 * H, 0), ("B", H, None, 2 * H, 3 * H, None), (None, 1, 1, 1, 1, 1), ("C", 4 * H, 23 * H, None, None, 3)]),
    (None, [("A", 0, -13 * H, 14 * H, 1, 0)]),
    (5, []),
    (5, None),
    (30 * DAY, [("A", H, 2 * H, 3 * H, 4 * H, 0), ("B", None, None, None, None, 0)]),
    (0, [(None, 1, 2, 3, 4, 0)]),
]


def test_repair_against_a_plain_walk(spark):
    stop = "STRUCT<id: STRING, arrivo_teorico: BIGINT, arrivoReale: BIGINT, partenza_teorica: BIGINT, partenzaReale: BIGINT, actualFermataType: INT>"
    df = spark.createDataFrame([(i, s, f) for i, (s, f) in enumerate(CASES)], f"n INT, start BIGINT, f ARRAY<{stop}>")
    got = df.select("n", R.repair_stops(F.col("f"), F.col("start")).alias("s")).collect()
    for r in got:
        start, stops = CASES[r.n]
        want = None if stops is None else _plain(stops, start)
        assert (None if r.s is None else [(x.idx, x.code, x.ap, x.ar, x.dp, x.dr, x.ftype) for x in r.s]) == want, r.n
    kind = df.select(R.repair_stops(F.col("f"), F.col("start")).alias("s")).schema["s"].dataType.elementType
    assert kind.simpleString() == "struct<idx:int,code:string,ap:bigint,ar:bigint,dp:bigint,dr:bigint,ftype:int>"


def test_repair_does_not_repeat_its_times(spark):
    stop = "STRUCT<id: STRING, arrivo_teorico: BIGINT, arrivoReale: BIGINT, partenza_teorica: BIGINT, partenzaReale: BIGINT, actualFermataType: INT>"
    df = spark.createDataFrame([], f"start BIGINT, f ARRAY<{stop}>").select(R.repair_stops(F.col("f"), F.col("start")).alias("s"))
    assert df._jdf.queryExecution().analyzed().toString().count("arrivo_teorico") < 10


def test_store_stats_takes_the_life_once(spark):
    from latewise.plans.q_runs import store_stats
    load_all()
    fixture(spark, SF_SMALL)
    plan = store_stats(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and "scalar-subquery" not in plan


def test_stops_read_and_fold_a_run_once(spark):
    runs = spark.createDataFrame([("d", "k", "1", '{"dataPartenzaTreno": 0, "fermate": [{"id": "A", "arrivo_teorico": 5}]}'), ("d", "l", "1", "{}"), ("d", "m", "1", None)],
                                 "day string, train_key string, number string, body string")
    # derived like the landed payloads, so that each further reading would build it again
    stops, _ = R.run_snapshots(runs.select("day", "train_key", "number", F.trim("body").alias("payload")))
    plan = stops._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("trim(body") == 1 and plan.count("aggregate(") == 2
    assert [(r.train_key, r.stop_code) for r in stops.collect()] == [("k", "A")]


def test_a_run_and_its_payload_are_taken_from_one_grouping(spark):
    from latewise.sources import feeds
    plan = feeds.it_run_payloads(fixture(spark, SF_SMALL).latest)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [ok") == 1 and "Join" not in plan


def test_rome_times_on_the_nights_of_the_clock_change(spark):
    import datetime as dt
    from zoneinfo import ZoneInfo

    from latewise.functions.timefn import epoch_ms_to_local
    rome = ZoneInfo("Europe/Rome")
    ms = [(int(dt.datetime(2026, m, d, tzinfo=dt.UTC).timestamp()) + 900 * k) * 1000 + 7 for m, d in ((3, 28), (10, 24)) for k in range(192)]
    got = spark.createDataFrame([(x,) for x in ms], "ms long").select("ms", epoch_ms_to_local("ms", "Europe/Rome").alias("t")).collect()
    assert all(r.t == (dt.datetime.fromtimestamp(r.ms // 1000, rome).replace(tzinfo=None) + dt.timedelta(milliseconds=7)) for r in got)
