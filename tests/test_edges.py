"""Edge cases of the matching, message and journey rules on literal tables
(FIXTURES.md §3.5)."""

import datetime as dt

from pyspark.sql import functions as F

from latewise.operators import fold as FO
from latewise.operators import journeys as J
from latewise.operators import matching as M
from latewise.operators import messages as MS
from latewise.operators import national as NA
from latewise.operators import ordered as O
from latewise.operators import pastmode as P
from latewise.operators import runs as R
from latewise.operators import studies as ST

D = dt.datetime


def _keyed(spark, rows):
    """rows: (id, apt, act, canceled)"""
    data = [("08000105", "S5", r[0], r[1], r[2], r[1] and r[1] + dt.timedelta(minutes=3), None, r[3], None) for r in rows]
    return spark.createDataFrame(data, "eva string, train_no string, id string, arrival_planned_time timestamp_ntz, "
                                       "arrival_change_time timestamp_ntz, departure_planned_time timestamp_ntz, "
                                       "departure_change_time timestamp_ntz, is_canceled boolean, reason_code int")


def _legs(spark, planned):
    return spark.createDataFrame([(1, 1, False, "S5", "8000105", "S", planned, planned)],
                                 "journey_id long, leg_idx int, walking boolean, fahrt_nr string, dest_id string, "
                                 "product string, planned_arrival timestamp_ntz, planned_departure timestamp_ntz")


def test_tolerance_120_in_121_out_and_midnight_wrap(spark):
    leg = _legs(spark, D(2026, 7, 31, 23, 50))
    keyed = _keyed(spark, [
        ("a", D(2026, 7, 30, 0, 10), D(2026, 7, 30, 0, 15), False),    # 20 min across midnight
        ("b", D(2026, 7, 29, 21, 50), D(2026, 7, 29, 21, 52), False),  # exactly 120
        ("c", D(2026, 7, 28, 21, 49), D(2026, 7, 28, 21, 50), False),  # 121: rejected
        ("d", D(2026, 7, 31, 12, 0), D(2026, 7, 31, 12, 0), False),    # far away, keeps the window end
    ])
    st = M.leg_delay_stats(leg, keyed, 7).first()
    assert st.days_matched == 2
    assert sorted(d.day for d in st.days) == [dt.date(2026, 7, 29), dt.date(2026, 7, 30)]


def test_equal_distance_tie_even_median_cancelled_only_day(spark):
    leg = _legs(spark, D(2026, 7, 31, 10, 0))
    keyed = _keyed(spark, [
        ("x1", D(2026, 7, 30, 9, 50), D(2026, 7, 30, 9, 54), False),   # equal distance; earlier planned wins
        ("x2", D(2026, 7, 30, 10, 10), D(2026, 7, 30, 10, 30), False),
        ("y", D(2026, 7, 29, 10, 0), D(2026, 7, 29, 10, 7), False),
        ("z", D(2026, 7, 28, 10, 0), None, True),                       # cancelled-only day
        ("n", D(2026, 7, 31, 10, 0), None, False),                      # no change reported: unknown delay
    ])
    st = M.leg_delay_stats(leg, keyed, 7).first()
    assert st.days_matched == 4 and st.canceled_days == 1
    assert st.median_delay == 5.5 and st.max_delay == 7          # median of 4 and 7
    day30 = [d for d in st.days if d.day == dt.date(2026, 7, 30)][0]
    assert day30.delay == 4


def test_on_date_unknown_change_is_on_time(spark):
    leg = _legs(spark, D(2026, 7, 31, 10, 0))
    keyed = _keyed(spark, [("n", D(2026, 7, 31, 10, 1), None, False)])
    r = M.leg_on_date(leg, keyed, "arrival").first()
    assert r.delay_min == 0 and not r.canceled


def test_latest_cause_tie_rule_depth_and_long_codes(spark):
    stop = ('<s id="1"><ar ct="2607011000"><x><m t="d" c="12" ts="2607011000"/></x></ar><m/>'
            '<m ts="2607011000" c="43" t="d"></m><m t="d" c="x9" ts="2607011200"/><m t="f" c="99" ts="2607011300"/></s>')
    long_code = '<s id="2"><dp><m t="d" c="99999999999999" ts="2607011000"/></dp></s>'
    df = spark.createDataFrame([(stop,), (long_code,)], "s string")
    a, b = df.select(MS.latest_cause(F.col("s"), "first").code.alias("f"), MS.latest_cause(F.col("s"), "last").code.alias("l")).collect()
    assert (a.f, a.l) == (12, 43) and (b.f, b.l) == (None, None)


def test_documents_that_break_off_are_found(spark):
    whole = '<timetable><s id="a-2607011000-1"><ar ct="2607011000"/></s><s id="b-2607011000-2"><dp clt="2607011000"/></s></timetable>'
    docs = spark.createDataFrame([(1, whole), (2, whole[:60]), (3, "no xml"), (4, None), (5, "<timetable></timetable>")], "n int, x string")
    assert sorted(r.n for r in MS.rejected(docs, "x", MS.TIMETABLE_SCHEMA, "xml").collect()) == [2, 3, 4]
    rows = MS.change_messages(docs.withColumnRenamed("x", "response_data"), keep=("n",)).collect()
    assert sorted((r.n, r.id, r.is_canceled) for r in rows) == [(1, "a-2607011000-1", False), (1, "b-2607011000-2", True)]
    js = spark.createDataFrame([(1, '{"verbindungen": []}'), (2, '{"verbindungen": [{"ref": '), (3, None)], "n int, x string")
    assert sorted(r.n for r in MS.rejected(js, "x", MS.LEG_SCHEMA, "json").collect()) == [2, 3]


def test_cross_midnight_repair(spark):
    h = 3_600_000
    dep = 1_784_000_000_000
    fermate = [(dep, None, dep + 1 * h, None), (dep + 2 * h - 86_400_000, None, None, None), (dep + 3 * h, None, None, None)]
    arr = F.array(*[F.struct(F.lit(f"S0000{i}").alias("id"), F.lit(a).cast("long").alias("arrivo_teorico"),
                             F.lit(b).cast("long").alias("arrivoReale"), F.lit(c).cast("long").alias("partenza_teorica"),
                             F.lit(d).cast("long").alias("partenzaReale"), F.lit(0).alias("actualFermataType"))
                    for i, (a, b, c, d) in enumerate(fermate)])
    out = spark.range(1).select(F.explode(R.repair_stops(arr, F.lit(dep))).alias("s")).select("s.ap").collect()
    assert [r.ap for r in out] == [dep, dep + 2 * h, dep + 3 * h]   # the regressed time moved one day forward


def test_bare_cancelled_trip_marker(spark):
    ent = '{"trip_update": {"trip": {"trip_id": "OCESN001234F5:TER:FR", "start_date": "20260701", "schedule_relationship": 3}, "stop_time_update": []}}'
    rows = MS.trip_updates(spark.createDataFrame([(ent,)], "entity string")).collect()
    assert len(rows) == 1 and rows[0].stop_id == "" and rows[0].train_number == "1234" and rows[0].trip_rel == 3


def test_slack_exactly_two_minutes_is_missed(spark):
    # leg 1 arrives 10:00 on time, leg 2 departs 10:02: slack 2 min -> missed (needs > 2)
    jl = spark.createDataFrame([
        (1, 1, False, "100", "08000001", "08000000", "ICE", "l1", "DB", "A", D(2026, 7, 20, 9, 0), D(2026, 7, 20, 10, 0)),
        (1, 2, False, "200", "08000002", "08000001", "ICE", "l2", "DB", "B", D(2026, 7, 20, 10, 2), D(2026, 7, 20, 11, 0)),
        (2, 1, False, "100", "08000001", "08000000", "ICE", "l1", "DB", "A", D(2026, 7, 20, 9, 0), D(2026, 7, 20, 10, 0)),
        (2, 2, False, "300", "08000002", "08000001", "ICE", "l2", "DB", "B", D(2026, 7, 20, 10, 3), D(2026, 7, 20, 11, 0)),
    ], "journey_id long, leg_idx int, walking boolean, fahrt_nr string, dest_id string, origin_id string, product string, "
       "line_name string, operator string, origin_name string, planned_departure timestamp_ntz, planned_arrival timestamp_ntz")
    keyed = spark.createDataFrame([
        ("08000001", "100", "a", D(2026, 7, 20, 10, 0), D(2026, 7, 20, 10, 0), None, None, False, None),
    ], "eva string, train_no string, id string, arrival_planned_time timestamp_ntz, arrival_change_time timestamp_ntz, "
       "departure_planned_time timestamp_ntz, departure_change_time timestamp_ntz, is_canceled boolean, reason_code int")
    fm = {r.journey_id: r for r in P.first_miss(jl, keyed).collect()}
    assert fm[1].missed_at_leg_idx == 2 and fm[2].missed_at_leg_idx is None
    assert (fm[1].miss_station, fm[1].miss_train) == ("B", "l2")


def _scored(spark, rows):
    return spark.createDataFrame(rows, "search_id int, orig_pos int, journey_id int, delay_score double, any_unlikely boolean, max_leg_median double")


def test_journeys_without_a_score_keep_page_order(spark):
    rows = [(1, 1, 11, None, True, 9.0), (1, 2, 12, 5.0, True, 5.0), (1, 3, 13, None, False, 1.0), (1, 4, 14, 7.0, False, 7.0), (1, 5, 15, 5.0, True, None)]
    got = [r.journey_id for r in J.sort_delay(_scored(spark, rows)).orderBy("pos_delay").collect()]
    assert got == [14, 15, 12, 11, 13]


def test_past_orders(spark):
    df = spark.createDataFrame([(1, 1, 11, None, 2), (1, 2, 12, 30, None), (1, 3, 13, -2, 4), (1, 4, 14, 30, None)],
                               "search_id int, orig_pos int, journey_id int, arrival_delay int, missed_at_leg_idx int")
    assert [r.journey_id for r in J.sort_delay(df, past=True).orderBy("pos_delay").collect()] == [13, 12, 14, 11]
    assert [r.journey_id for r in J.sort_risk(df, past=True).orderBy("pos_risk").collect()] == [12, 14, 11, 13]


def test_sixty_day_window_has_sixty_slots(spark):
    leg = _legs(spark, D(2026, 7, 31, 10, 0))
    keyed = _keyed(spark, [("a", D(2026, 6, 3, 10, 0), D(2026, 6, 3, 10, 5), False), ("b", D(2026, 7, 31, 10, 0), D(2026, 7, 31, 10, 1), False)])
    slots = J.day_slots(M.leg_delay_stats(leg, keyed, 60)).collect()
    assert len(slots) == 60 and {s.day: s.delay for s in slots if s.delay is not None} == {dt.date(2026, 6, 3): 5, dt.date(2026, 7, 31): 1}


def test_enrichment_has_no_cap_unless_asked(spark):
    tight = spark.createDataFrame([(1, i) for i in range(9)], "journey_id int, leg_index int")
    page = spark.createDataFrame([(1, 7, 1)], "journey_id int, search_id int, orig_pos int")
    assert J.cap_enrichment(tight, page).count() == 9 and J.cap_enrichment(tight, page, 3).count() == 3


def test_retention_keeps_the_third_day_back_and_future_rows(spark):
    df = spark.createDataFrame([(dt.date(2026, 7, d),) for d in (1, 16, 17, 18, 20)] + [(dt.date(2031, 1, 1),)], "day date")
    kept = sorted(r.day for r in FO.state_retention(df, F.col("day"), dt.date(2026, 7, 20)).collect())
    assert kept == [dt.date(2026, 7, 17), dt.date(2026, 7, 18), dt.date(2026, 7, 20), dt.date(2031, 1, 1)]


def test_nl_rows_without_a_number_stay_fr_ones_go(spark):
    cw = spark.createDataFrame([("c1", "08400001", "Ut")], "code string, eva string, name string")
    cols = ("start_date string, train_key string, trip_id string, train_number string, train_type string, headsign string, station_code string, stop_id string, "
            "arr_time long, arr_delay long, dep_time long, dep_delay long, trip_rel int, stop_rel int")
    obs = spark.createDataFrame([("20260701", "IC:0", "t", n, "IC", "x", "c1", "s", 1782900000, 60, None, None, 0, 0) for n in ("", None, "12")], cols)
    assert NA.gtfsrt_normalise(obs, cw, "NL").count() == 3 and NA.gtfsrt_normalise(obs, cw, "FR").count() == 1


def test_trip_cancelled_by_one_row_on_its_day_only(spark):
    obs = spark.createDataFrame([("1", "t", 0), ("1", "t", 3), ("2", "t", 0), ("1", None, 3), ("1", "u", None)], "start_date string, trip_id string, trip_rel int")
    got = sorted(((r.start_date, r.trip_id, r.trip_canceled) for r in NA.with_trip_cancelled(obs, "start_date", "trip_id").collect()), key=str)
    assert got == sorted([("1", "t", True), ("1", "t", True), ("2", "t", False), ("1", None, False), ("1", "u", False)], key=str)


def test_unknown_cancel_flag_drops_the_row(spark):
    rows = [("IC", "7", D(2026, 7, 1 + i % 2, 8, 0), 4, a, b) for i, (a, b) in enumerate([(False, False), (False, None), (None, False), (True, None), (False, False)])]
    df = spark.createDataFrame(rows, "train_type string, train_number string, time timestamp_ntz, delay_in_min int, a boolean, b boolean")
    r = ST.period_profile(df, dt.date(2026, 7, 1), dt.date(2026, 7, 2), dt.date(2026, 7, 2), 0, cancelled=F.col("a") | F.col("b")).first()
    assert (r.h1_n, r.h2_n) == (2, 0)


def test_default_repoll_is_a_quarter_of_an_hour(spark):
    reg = spark.createDataFrame([("d", "k", 1_000_000, 0)], "day string, train_key string, dep_ms long, fails int")
    runs = spark.createDataFrame([("d", "k", None, False, True)], "day string, train_key string, last_plan_ms long, arrived boolean, has_rows boolean")
    assert R.run_lifecycle(reg, runs, 2000).first().next_poll == 2900


def test_ranks_quantiles_and_ties_over_buckets(spark):
    import random
    r = random.Random(1)
    rows = [(r.choice("ab"), float(r.randrange(40))) for _ in range(700)] + [("c", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    ranks = {}
    for g in "abc":
        own = sorted(v for k, v in rows if k == g)
        ranks[g] = {v: own.index(v) + (own.count(v) + 1) / 2 for v in own}
    for x in O.average_rank(df, "v", ["g"], "rk").collect():
        assert x.rk == ranks[x.g][x.v] and abs(x.rk_pct - x.rk / sum(1 for k, _ in rows if k == x.g)) < 1e-12
    everyone = sorted(v for _, v in rows)
    assert {(x.v, x.rk) for x in O.average_rank(df, "v", None, "rk").collect()} == {(v, everyone.index(v) + (everyone.count(v) + 1) / 2) for v in everyone}
    import numpy as np
    q = O.positions(df, "v", ["g"]).groupBy("g").agg(O.linear_quantile("v", 0.3).alias("q"), O.nearest_rank("v", 0.9).alias("p"))
    for x in q.collect():
        own = sorted(v for k, v in rows if k == x.g)
        assert abs(x.q - np.quantile(own, 0.3)) < 1e-9 and x.p == own[min(len(own) - 1, int(len(own) * 0.9))]


def test_suffix_minimum_over_days_and_ties(spark):
    import random
    r = random.Random(2)
    t = lambda: D(2026, 7, r.randint(1, 4), r.randint(0, 23), r.choice([0, 30]))
    cands = [(r.choice("xy"), t(), r.random() < 0.5, r.randrange(1000)) for _ in range(150)]
    asked = [(r.choice("xyz"), t()) for _ in range(80)] + [("x", None)]
    got = O.suffix_min(spark.createDataFrame(asked, "k string, t timestamp_ntz"),
                       spark.createDataFrame(cands, "k string, t timestamp_ntz, at_t boolean, val int"), ["k"])
    want = {(k, x): min(v) for k, x in set(asked) if x and (v := [c[3] for c in cands if c[0] == k and (c[1] > x or c[2] and c[1] == x)])}
    assert {(x.k, x.t): x.val for x in got.collect()} == want


def test_a_replacement_that_breaks_inside_is_replanned_there(spark):
    leg = "leg_idx int, walking boolean, fahrt_nr string, product string, operator string, line_name string, origin_id string, origin_name string, dest_id string, " \
          "planned_departure timestamp_ntz, planned_arrival timestamp_ntz"
    T = lambda h, m: D(2026, 7, 20, h, m)
    A, B, C, X = "08000001", "08000002", "08000003", "08000009"
    jl = spark.createDataFrame([(1, 1, False, "1", "ICE", "DB", "ICE 1", A, "A", B, T(9, 0), T(10, 0)),
                                (1, 2, False, "2", "ICE", "DB", "ICE 2", B, "B", C, T(10, 5), T(11, 0))], "journey_id long, " + leg)
    cl = spark.createDataFrame([
        (10, C, 0, False, "3", "RE", "DB", "RE 3", B, "B", X, T(10, 20), T(10, 40)), (10, C, 1, False, "4", "RE", "DB", "RE 4", X, "X", C, T(10, 45), T(11, 10)),
        (11, C, 0, False, "5", "RE", "DB", "RE 5", X, "X", C, T(11, 5), T(11, 30)),
        (12, C, 0, False, "6", "RE", "Flix", "FLX 6", B, "B", C, T(10, 21), T(10, 30))], "conn_id long, final_dest string, " + leg)
    ev = lambda i, eva, no, arr, late, dep=None: (eva, no, i, arr, arr and arr + dt.timedelta(minutes=late), dep, dep, False, None)
    keyed = spark.createDataFrame([ev("a", B, "1", T(10, 0), 10), ev("b", X, "3", T(10, 40), 4), ev("c", C, "5", T(11, 30), 1)],
                                  "eva string, train_no string, id string, arrival_planned_time timestamp_ntz, arrival_change_time timestamp_ntz, "
                                  "departure_planned_time timestamp_ntz, departure_change_time timestamp_ntz, is_canceled boolean, reason_code int")
    r = P.journey_outcome(jl, keyed, cl).first()
    # late at B, misses ICE 2; rides RE 3, misses RE 4 at X by a minute of slack; rides RE 5
    assert (r.missed_at_leg_idx, r.replans, r.ridden, r.arrival_delay, r.incomplete, r.pending) == (2, 2, "10:1,11:1", 31, False, True)
    r = P.simulate_walk(jl, keyed, cl, max_replans=1).first()
    assert (r.replans, r.ridden, r.incomplete) == (1, "10:1", True)
