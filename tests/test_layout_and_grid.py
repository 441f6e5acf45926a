"""The serving layout (K3), dead generations (K1), the grid join (J10), one scan for all windows
(A8), and the optional text operators of the driver's entry."""

import glob
import math
import os
import random
import subprocess
import sys

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from latewise.operators import matching as M
from latewise.operators import serving as SV
from latewise.operators import stations as ST
from latewise.sources import files
from latewise.sources.fixture import Fixture

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _rows_scanned(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_a_lookup_reads_one_row_group_of_its_day(spark, tmpdir_path, monkeypatch):
    monkeypatch.setitem(SV.LAYOUT, "parquet.block.size", "4096")
    path = os.path.join(tmpdir_path, "srv")
    events = Fixture(spark, "/root/testdata/sf0.01").stop_events
    SV.write_serving(events, path, partitions=8)
    back = spark.read.parquet(path)
    asked = back.filter("train_no IS NOT NULL AND eva IS NOT NULL").orderBy(F.xxhash64("id")).select("service_day", "train_no", "eva").limit(5).collect()
    for r in asked:
        groups = hit = 0
        for f in glob.glob(f"{path}/service_day={r.service_day}/*.parquet"):
            meta = pq.ParquetFile(f).metadata
            at = [meta.row_group(0).column(i).path_in_schema for i in range(meta.num_columns)].index("train_no")
            for g in range(meta.num_row_groups):
                s = meta.row_group(g).column(at).statistics
                groups, hit = groups + 1, hit + (s.min <= r.train_no <= s.max)
        assert groups >= 3 and hit <= 2
        got = SV.lookups(spark, path, [tuple(r)])
        want = back.filter((F.col("service_day") == r.service_day) & (F.col("train_no") == r.train_no) & (F.col("eva") == r.eva)).count()
        assert got.count() == want > 0
        day = back.filter(F.col("service_day") == r.service_day).count()
        assert _rows_scanned(SV.lookups(spark, path, [tuple(r)])) < day / 2


def test_a_station_that_no_train_serves_is_found_missing_by_the_filters(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "srv")
    SV.write_serving(Fixture(spark, SF).stop_events, path, partitions=4)
    back = spark.read.parquet(path)
    lo, hi = back.select(F.min("eva"), F.max("eva")).first()
    # inside the range of stations, so no minimum or maximum tells
    absent = [f"0830000{i}x" for i in range(10)]
    assert all(lo < x < hi for x in absent)
    assert sum(_rows_scanned(spark.read.parquet(path).filter(F.col("eva") == x)) for x in absent) < back.count()


def test_dead_generations_go(spark, tmpdir_path):
    table = os.path.join(tmpdir_path, "t")
    for n in range(1, 6):
        files.table_sink(spark.range(n), table)
    assert files.read_table(spark, table).count() == 5
    assert len([x for x in os.listdir(table) if x.startswith("gen-")]) == 2  # the one before is kept for its readers


def test_pairs_within_a_distance_equal_brute_force(spark):
    r = random.Random(8)
    points, places = [], []
    for lat0 in (0.0, -33.0, 47.3, 64.9, 78.0):
        for out in (points, places):
            out += [(len(out), lat0 + r.uniform(-0.06, 0.06), 11.0 + r.uniform(-0.15, 0.15)) for _ in range(60)]
    points += [(900, None, 11.0), (901, 47.3, None)]
    places += [(900, None, None)]

    def km(a, b):
        dx = (b[2] - a[2]) * 111.32 * math.cos(math.radians((a[1] + b[1]) / 2))
        return math.hypot(dx, (b[1] - a[1]) * 111.32)

    want = sorted((a[0], b[0]) for a in points for b in places if None not in (*a, *b) and km(a, b) < 2.0)
    got = ST.within_distance(spark.createDataFrame(points, "p int, lat double, lon double"),
                             spark.createDataFrame(places, "q int, c_lat double, c_lon double"), 2.0)
    assert sorted((x.p, x.q) for x in got.collect()) == want and len(want) > 100


def test_one_scan_for_all_windows(spark):
    fx = Fixture(spark, SF)
    cols = ["journey_id", "leg_idx", "median_delay", "max_delay", "days_matched", "canceled_days", "window_start", "window_end"]
    rows = lambda df: sorted(map(tuple, df.select(*cols).collect()))
    both = M.leg_delay_windows(fx.legs, fx.keyed, windows=(3, 20))
    for w in (3, 20):
        assert rows(both.filter(F.col("window_days") == w)) == rows(M.leg_delay_stats(fx.legs, fx.keyed, window_days=w, with_days=False)) != []
    scans = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("FileScan")
    assert scans(both) <= scans(M.leg_delay_stats(fx.legs, fx.keyed, window_days=20, with_days=False))


def test_entry_stands_without_what_the_text_operators_need():
    """A missing library of theirs leaves the delay queries as they are."""
    code = ("import sys; sys.modules['public_tokenizers'] = None; sys.modules['zstandard'] = None; import __spark_entry__ as e; "
            "q = e.queries(); o = e.oracle_sql(); print('leg_delay_stats' in q, set(q) == set(o), 'op1_decontamination' in q or 'pipeline' in q)")
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, check=True).stdout
    assert out.split() == ["True", "True", "False"]
