"""Declared schemas of the two raw trip tables and the silver views.

Timestamps are wall-clock values without a zone, so they are declared as
TIMESTAMP_NTZ; nothing downstream depends on the session time zone.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

PARTITION_COLUMN = "year"
# Partition projection range of the declared tables.
PARTITION_YEARS = (2022, 2023, 2024, 2025, 2026)

YELLOW_COLUMNS = StructType([
    StructField("tpep_pickup_datetime", TimestampNTZType()),
    StructField("tpep_dropoff_datetime", TimestampNTZType()),
    StructField("pulocationid", IntegerType()),
    StructField("dolocationid", IntegerType()),
    StructField("fare_amount", DoubleType()),
    StructField("tip_amount", DoubleType()),
    StructField("trip_distance", DoubleType()),
    StructField("passenger_count", LongType()),
    StructField("congestion_surcharge", DoubleType()),
])

FHV_COLUMNS = StructType([
    StructField("hvfhs_license_num", StringType()),
    StructField("request_datetime", TimestampNTZType()),
    StructField("on_scene_datetime", TimestampNTZType()),
    StructField("pickup_datetime", TimestampNTZType()),
    StructField("dropoff_datetime", TimestampNTZType()),
    StructField("pulocationid", IntegerType()),
    StructField("dolocationid", IntegerType()),
    StructField("trip_miles", DoubleType()),
    StructField("trip_time", LongType()),
    StructField("base_passenger_fare", DoubleType()),
    StructField("tolls", DoubleType()),
    StructField("congestion_surcharge", DoubleType()),
    StructField("tips", DoubleType()),
    StructField("driver_pay", DoubleType()),
    StructField("shared_request_flag", StringType()),
    StructField("shared_match_flag", StringType()),
])


def with_partition(schema: StructType) -> StructType:
    return StructType(list(schema.fields) + [StructField(PARTITION_COLUMN, IntegerType())])


YELLOW_SCHEMA = with_partition(YELLOW_COLUMNS)
FHV_SCHEMA = with_partition(FHV_COLUMNS)

FEEDS = {
    "yellow": {"schema": YELLOW_SCHEMA, "pickup": "tpep_pickup_datetime", "file_prefix": "yellow_tripdata"},
    "fhv": {"schema": FHV_SCHEMA, "pickup": "pickup_datetime", "file_prefix": "fhvhv_tripdata"},
}
