"""Edge cases of the scalar helpers on literal tables."""

import datetime as dt

from pyspark.sql import functions as F

from latewise.functions import journey as J
from latewise.functions import keys as K
from latewise.functions import text as X
from latewise.functions import timefn as T


def one(spark, col, **lits):
    df = spark.range(1)
    for k, v in lits.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(col.alias("r")).first()["r"]


def test_minute_diff_counts_boundaries(spark):
    a, b = dt.datetime(2026, 7, 1, 0, 0, 59), dt.datetime(2026, 7, 1, 0, 1, 1)
    assert one(spark, T.minute_diff("a", "b"), a=a, b=b) == 1
    assert one(spark, T.minute_diff("b", "a"), a=a, b=b) == -1


def test_midnight_wrap_tod_distance(spark):
    a, b = dt.datetime(2026, 7, 1, 23, 50), dt.datetime(2026, 7, 2, 0, 10)
    assert one(spark, T.tod_distance(T.minute_of_day("a"), T.minute_of_day("b")), a=a, b=b) == 20


def test_round_half_even(spark):
    assert one(spark, T.round_minutes(F.lit(30))) == 0
    assert one(spark, T.round_minutes(F.lit(90))) == 2
    assert one(spark, T.round_minutes(F.lit(-30))) == 0


def test_pad_never_truncates(spark):
    assert one(spark, K.pad_station(F.lit("8000105"))) == "08000105"
    assert one(spark, K.pad_station(F.lit("800010512"))) == "800010512"


def test_fold_name(spark):
    assert one(spark, X.fold_name(F.lit("  Frankfurt (Main)  Hauptbahnhof"))) == "frankfurt (main) hbf"
    assert one(spark, X.fold_name(F.lit("St.Pölten-Süd"))) == "st polten sud"
    assert one(spark, X.fold_name(F.lit("Straße"))) == "strasse"


def test_train_key(spark):
    df = spark.createDataFrame(
        [("S", "08000105", "S 5", "00123"), ("S", "08000105", "7", "00123"), ("S", "08500105", "S 5", "00123"),
         ("ICE", "08000105", None, "0077")], "train_type string, eva string, line_number string, train_number string")
    assert [r[0] for r in df.select(K.train_key()).collect()] == ["S5", "S7", "123", "77"]


def test_compensation(spark):
    vals = [None, 59, 60, 119, 120, -5]
    df = spark.createDataFrame([(v,) for v in vals], "d int")
    assert [r[0] for r in df.select(J.compensation_pct("d")).collect()] == [None, 0, 25, 25, 50, 0]


def test_dst_epoch_to_local(spark):
    # 2026-03-29 01:00 UTC = 03:00 CEST (clocks jump); 2026-10-25 01:00 UTC = 02:00 CET
    spring = int(dt.datetime(2026, 3, 29, 1, 0, tzinfo=dt.timezone.utc).timestamp())
    autumn = int(dt.datetime(2026, 10, 25, 1, 0, tzinfo=dt.timezone.utc).timestamp())
    assert one(spark, T.epoch_to_local(F.lit(spring))) == dt.datetime(2026, 3, 29, 3, 0)
    assert one(spark, T.epoch_to_local(F.lit(autumn))) == dt.datetime(2026, 10, 25, 2, 0)


def test_parse_local_time_lenient(spark):
    assert one(spark, T.parse_local_time(F.lit("1.7.2026 9:30"))) == dt.datetime(2026, 7, 1, 9, 30)
    assert one(spark, T.parse_local_time(F.lit("01.07.2026 09:30:15"))) == dt.datetime(2026, 7, 1, 9, 30, 15)
    assert one(spark, T.parse_local_time(F.lit("garbage"))) is None


def test_board_time_day_offset(spark):
    assert one(spark, T.parse_board_time(F.lit("20260701"), F.lit("01002500"))) == dt.datetime(2026, 7, 2, 0, 25)
    assert one(spark, T.parse_board_time(F.lit("20260701"), F.lit("235900"))) == dt.datetime(2026, 7, 1, 23, 59)
