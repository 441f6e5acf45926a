"""Stop-event normalisation and the country merge (DE transform, F6, S9, U1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latewise.functions.keys import ride_id, stop_number
from latewise.functions.timefn import minute_diff
from latewise.schema import ALL_COLUMNS, CORE_COLUMNS, OPTIONAL_COLUMNS


def de_transform(merged: DataFrame) -> DataFrame:
    """DE rule: delay = departure difference, else arrival difference (minute
    boundaries); time = departure change, else arrival change; ride id and stop number
    from the stop id."""
    return merged.select(
        "station_name", "xml_station_name", "eva", "train_number", "line_number",
        "final_destination_station",
        F.coalesce(minute_diff("departure_planned_time", "departure_change_time"),
                   minute_diff("arrival_planned_time", "arrival_change_time")).cast("int").alias("delay_in_min"),
        F.coalesce("departure_change_time", "arrival_change_time").alias("time"),
        "is_canceled", "train_type",
        ride_id("id").alias("train_line_ride_id"),
        stop_number("id").alias("train_line_station_num"),
        "arrival_planned_time", "arrival_change_time", "departure_planned_time",
        "departure_change_time", "id",
        F.col("reason_code").cast("int").alias("reason_code"))


def time_window(df: DataFrame, start, end, col: str = "time") -> DataFrame:
    """``col`` in [start, end)."""
    return df.filter((F.col(col) >= F.lit(start)) & (F.col(col) < F.lit(end)))


def with_optional_columns(df: DataFrame) -> DataFrame:
    """A typed NULL for every optional column the source lacks."""
    for name, typ in OPTIONAL_COLUMNS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(typ))
    return df


def country_window_filter(df: DataFrame, prefix: str, start, end) -> Column | DataFrame:
    """id prefix + ``time`` in [start, end) + planned arrival NULL or in [start, end).
    Plain comparisons, so Catalyst pushes them into the Parquet scan of each source."""
    s, e = F.lit(start), F.lit(end)
    apt = F.col("arrival_planned_time")
    return df.filter(F.col("eva").startswith(prefix) & (F.col("time") >= s) & (F.col("time") < e)
                     & (apt.isNull() | ((apt >= s) & (apt < e))))


# Country sources and their padded station-id prefixes.
SOURCES = [("DE", "080"), ("AT", "081"), ("NL", "084"), ("CH", "085"), ("FR", "087"), ("IT", "083")]


def merge_countries(sources: Sequence[tuple[str, DataFrame | None]], start, end) -> DataFrame:
    """UNION ALL of the per-country tables, each cut to its own id prefix and the
    window, 18 columns. A missing source (None) is skipped."""
    prefix = dict(SOURCES)
    parts = []
    for name, df in sources:
        if df is None:
            continue
        df = with_optional_columns(df).select(*ALL_COLUMNS)
        parts.append(country_window_filter(df, prefix[name], start, end))
    if not parts:
        raise ValueError("no source data found - nothing to merge")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

