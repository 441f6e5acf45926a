"""Spark session defaults for the delay engine.

All stored times are naive local wall-clock times (``TIMESTAMP_NTZ``); the session
time zone is pinned to UTC so that no implicit zone conversion ever touches them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Before a query runs, Spark knows only the compressed size of the files that a join reads, and
#: rows may be a hundred times that: only small files are broadcast on it. While a query runs, rows
#: are measured as they are shuffled, and a side is broadcast on what it really takes.
BROADCAST_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "256k",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
}


def build_session(master: str | None = None, app: str = "latewise",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    apply_session_defaults(spark)
    return spark


def apply_session_defaults(spark: SparkSession) -> None:
    """Pin the settings the operators rely on (safe on an existing session): times are
    naive local wall-clock values, so literals and parsed times are ``TIMESTAMP_NTZ``
    and no session time zone is ever applied to them."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.timestampType", "TIMESTAMP_NTZ")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in BROADCAST_CONF.items():
        spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``. Only a
    local session (unit tests, a laptop) may go without: it gets a scratch folder, once."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="latewise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def stored(df: DataFrame, name: str, partition_by: tuple = ()) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: what follows does not
    run it twice, has its statistics, and a lost executor costs the reading of a file."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    w = df.write.partitionBy(*partition_by) if partition_by else df.write
    w.parquet(path)
    # a table by partitions has no file to read a schema from if it is empty
    return (spark.read.schema(df.schema) if partition_by else spark.read).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what has run. It does so when the driver's garbage
    collector finds a plan unused, and in a chain of large steps that may be only at the end."""
    spark.sparkContext._jvm.System.gc()
