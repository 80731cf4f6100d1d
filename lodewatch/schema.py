"""Schemas of events, alerts and raw log lines."""

from __future__ import annotations

from pyspark.sql import types as T

ACTOR = T.StructType([T.StructField(c, T.StringType()) for c in ("user", "process", "session")])
ENDPOINT = T.StructType([T.StructField("ip", T.StringType()), T.StructField("port", T.IntegerType()), T.StructField("hostname", T.StringType()), T.StructField("mac", T.StringType())])
THREAT = T.StructType(
    [
        T.StructField("reputation_score", T.IntegerType()),
        T.StructField("threat_category", T.StringType()),
        T.StructField("threat_indicators", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)
METADATA = T.MapType(T.StringType(), T.StringType())

#: A normalised event. Everything that only one vendor has goes to `metadata`.
EVENT = T.StructType(
    [
        T.StructField("uuid", T.StringType()),
        T.StructField("time", T.TimestampType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("class_uid", T.IntegerType()),
        T.StructField("category_uid", T.IntegerType()),
        T.StructField("class_name", T.StringType()),
        T.StructField("category_name", T.StringType()),
        T.StructField("actor", ACTOR),
        T.StructField("src_endpoint", ENDPOINT),
        T.StructField("dst_endpoint", ENDPOINT),
        T.StructField("message", T.StringType()),
        T.StructField("raw_data", T.StringType()),
        T.StructField("threat_info", THREAT),
        T.StructField("ueba_score", T.DoubleType()),
        T.StructField("metadata", METADATA),
    ]
)

#: A log line as it arrived.
RAW = T.StructType(
    [
        T.StructField("raw_id", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("arrived", T.TimestampType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("vendor_type", T.StringType()),
        T.StructField("metadata", METADATA),
    ]
)
