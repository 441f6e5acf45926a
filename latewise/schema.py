"""Core schema: the stop event (17 columns + optional ``reason_code``)."""

from __future__ import annotations

from pyspark.sql import types as T

STOP_EVENT_SCHEMA = T.StructType([
    T.StructField("station_name", T.StringType()),
    T.StructField("xml_station_name", T.StringType()),
    T.StructField("eva", T.StringType()),
    T.StructField("train_number", T.StringType()),
    T.StructField("line_number", T.StringType()),
    T.StructField("final_destination_station", T.StringType()),
    T.StructField("delay_in_min", T.IntegerType()),
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("is_canceled", T.BooleanType()),
    T.StructField("train_type", T.StringType()),
    T.StructField("train_line_ride_id", T.StringType()),
    T.StructField("train_line_station_num", T.IntegerType()),
    T.StructField("arrival_planned_time", T.TimestampNTZType()),
    T.StructField("arrival_change_time", T.TimestampNTZType()),
    T.StructField("departure_planned_time", T.TimestampNTZType()),
    T.StructField("departure_change_time", T.TimestampNTZType()),
    T.StructField("id", T.StringType()),
])

OPTIONAL_COLUMNS = {"reason_code": T.IntegerType()}

CORE_COLUMNS = [f.name for f in STOP_EVENT_SCHEMA.fields]

ALL_COLUMNS = CORE_COLUMNS + list(OPTIONAL_COLUMNS)
