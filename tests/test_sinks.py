"""Sources and sinks that touch the file system: S2-S6, K1-K4, I5."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from latewise.operators import matching as M
from latewise.operators import national as NA
from latewise.operators import serving as SV
from latewise.sources import feeds, files
from latewise.sources.fixture import Fixture

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fx(spark):
    return Fixture(spark, SF)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_table_sink_generations_and_check(spark, fx, tmpdir_path):
    table = os.path.join(tmpdir_path, "serving")
    good = SV.serving_table(fx.stop_events)
    gen1 = files.table_sink(good, table, check=files.serving_check)
    assert files.current_generation(spark, table) == gen1
    assert files.read_table(spark, table).count() == fx.stop_events.count()
    bad = SV.serving_table(fx.stop_events.drop("reason_code"))
    with pytest.raises(RuntimeError):
        files.table_sink(bad, table, check=files.serving_check)
    assert files.current_generation(spark, table) == gen1  # the old generation stays current


def test_serving_layout_sorted(spark, fx, tmpdir_path):
    path = os.path.join(tmpdir_path, "srv")
    SV.write_serving(fx.stop_events, path, partitions=4)
    back = spark.read.parquet(path).withColumn("f", F.input_file_name())
    ranges = back.groupBy("service_day", "f").agg(F.min("train_no").alias("lo"), F.max("train_no").alias("hi")).orderBy("service_day", "lo").collect()
    for a, b in zip(ranges, ranges[1:], strict=False):
        assert a["service_day"] != b["service_day"] or a["hi"] <= b["lo"]  # a day's files do not overlap on the key


def test_a_window_reads_its_days_only(spark, fx):
    """Filters on the partition column reach the scans."""
    def partition_filters(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [x for x in plan.split("PartitionFilters: [")[1:] if "service_day" in x.split("]")[0] and (">=" in x.split("]")[0])]

    assert partition_filters(M.leg_delay_stats(fx.legs, fx.keyed, 7))
    assert partition_filters(M.leg_on_date(fx.legs, fx.keyed, "arrival"))
    assert partition_filters(M.leg_on_date(fx.jlegs, fx.keyed, "departure", station="origin_id"))


def test_a_killed_switch_leaves_the_old_table(spark, fx, tmpdir_path, monkeypatch):
    table = os.path.join(tmpdir_path, "t")
    gens = [files.table_sink(spark.range(n), table) for n in (1, 2, 3)]
    assert files.current_generation(spark, table) == gens[-1] and len(files._pointers(spark, table)) == 2
    real = files._jvm_fs

    class Dies:
        """A file system that breaks at the rename."""

        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            if name == "rename":
                raise RuntimeError("killed")
            return getattr(self.fs, name)

    monkeypatch.setattr(files, "_jvm_fs", lambda s, p: (Dies(real(s, p)[0]), real(s, p)[1]))
    with pytest.raises(RuntimeError):
        files.table_sink(spark.range(9), table)
    monkeypatch.undo()
    assert files.read_table(spark, table).count() == 3


def test_day_sink_keeps_existing_days(spark, fx, tmpdir_path):
    root = os.path.join(tmpdir_path, "days")
    se = fx.stop_events.withColumn("service_day", F.to_date("time"))
    first = se.filter(F.col("service_day") <= dt.date(2026, 7, 10))
    files.day_sink(first, root)
    n_first = spark.read.parquet(root).count()
    changed = se.withColumn("station_name", F.lit("changed"))
    files.day_sink(changed, root)  # existing days kept, new days added
    back = spark.read.parquet(root)
    assert back.filter(F.col("service_day") <= dt.date(2026, 7, 10)).filter(F.col("station_name") == "changed").count() == 0
    assert back.count() == se.count() and n_first < se.count()
    files.day_sink(changed.filter(F.col("service_day") == dt.date(2026, 7, 5)), root, force=True)
    back = spark.read.parquet(root)
    assert back.filter((F.col("service_day") == dt.date(2026, 7, 5)) & (F.col("station_name") != "changed")).count() == 0


def test_day_partition_scan_missing_source(spark, tmpdir_path):
    assert files.day_partition_scan(spark, os.path.join(tmpdir_path, "nope")) is None


def test_day_finalise_rewrites_two_days_and_keeps_a_shrunken_one(spark, fx, tmpdir_path):
    root = os.path.join(tmpdir_path, "fin")
    se = fx.stop_events.withColumn("service_day", F.to_date("time"))
    files.day_sink(se, root)
    before = spark.read.parquet(root).groupBy("service_day").count()
    new = se.withColumn("station_name", F.lit("final"))
    files.day_finalise(new, root, dt.date(2026, 7, 20), build=lambda d: d)
    back = spark.read.parquet(root)
    rewritten = back.filter(F.col("station_name") == "final").select("service_day").distinct()
    assert sorted(r[0] for r in rewritten.collect()) == [dt.date(2026, 7, 18), dt.date(2026, 7, 19)]
    assert back.groupBy("service_day").count().subtract(before).count() == 0
    small = new.filter((F.col("service_day") != dt.date(2026, 7, 24)) | (F.col("train_line_station_num") == 1))
    got = {r.day: r.decision for r in files.day_finalise(small, root, dt.date(2026, 7, 25), build=lambda d: d).collect()}
    assert got == {dt.date(2026, 7, 24): "keep", dt.date(2026, 7, 23): "write"}
    assert spark.read.parquet(root).groupBy("service_day").count().subtract(before).count() == 0


def test_prune_days_deletes_folders(spark, fx, tmpdir_path):
    root = os.path.join(tmpdir_path, "old")
    files.day_sink(fx.stop_events.withColumn("service_day", F.to_date("time")), root)
    gone = files.prune_days(spark, root, dt.date(2026, 7, 20))
    assert gone and max(gone) < dt.date(2026, 7, 20)
    assert spark.read.parquet(root).agg(F.min("service_day")).first()[0] == dt.date(2026, 7, 20)


def test_no_shared_folder_is_refused_off_a_local_session():
    from latewise import session

    class Conf:
        def get(self, *_):
            return None

    class Sc:
        master = "spark://cluster"

        def getConf(self):
            return Conf()

    class Fake:
        conf, sparkContext = Conf(), Sc()

    with pytest.raises(ValueError):
        session.checkpoint_dir(Fake())


def test_ch_csv_roundtrip(spark, fx, tmpdir_path):
    path = os.path.join(tmpdir_path, "ch.csv")
    raw = feeds.ch_raw(fx.latest)
    raw.write.option("sep", ";").option("header", True).csv(path)
    back = files.ch_csv_scan(spark, path)
    assert _rows(NA.ch_normalise(back)) == _rows(NA.ch_normalise(raw))


def test_archive_csv_roundtrip(spark, fx, tmpdir_path):
    path = os.path.join(tmpdir_path, "nl.csv.gz")
    raw = feeds.nl_raw(fx.latest)
    raw.write.option("header", True).option("compression", "gzip") \
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path)
    back = files.archive_csv_scan(spark, path)
    assert _rows(back) == _rows(raw)


def test_gtfs_scan(spark, fx, tmpdir_path):
    folder = os.path.join(tmpdir_path, "gtfs")
    stops, routes, trips, stop_times = feeds.gtfs_tables(fx.latest)
    for name, df in (("stops", stops), ("routes", routes), ("trips", trips), ("stop_times", stop_times)):
        df.coalesce(1).write.option("header", True).csv(os.path.join(folder, f"{name}.txt"))
    t = files.gtfs_scan(spark, folder)
    assert t["stops"].count() == stops.count() and set(t["stop_times"].columns) == {"trip_id", "stop_id"}


def test_crosswalk_scan_map_and_array(spark, tmpdir_path):
    m = os.path.join(tmpdir_path, "map.json")
    a = os.path.join(tmpdir_path, "arr.json")
    os.makedirs(m), os.makedirs(a)
    with open(os.path.join(m, "x.json"), "w") as f:
        json.dump({"ut": {"eva": "08400621", "name": "Utrecht Centraal"}, "asd": {"eva": "08400058", "name": "Amsterdam"}}, f)
    with open(os.path.join(a, "x.json"), "w") as f:
        json.dump([{"eva": "08100003", "hafas_id": "1290401", "name": "Wien Hbf"}], f)
    rows = _rows(files.crosswalk_scan(spark, m)) + _rows(files.crosswalk_scan(spark, a))
    assert ("ut", "08400621", "Utrecht Centraal") in rows and ("1290401", "08100003", "Wien Hbf") in rows
