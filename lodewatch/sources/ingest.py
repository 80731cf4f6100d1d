"""Raw log lines in: files, collector envelopes, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UDP_BYTES, TCP_BYTES = 65_507, 1 << 20
ENVELOPE = "time string, host string, source string, sourcetype string, index string, event string, fields map<string,string>"


def read_raw_logs(spark: SparkSession, path: str, tenant: str, vendor: str | None = None) -> DataFrame:
    """Lines of text files as raw rows; the file's modification time is the arrival."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_modification_time")
    return lines.select(
        F.sha2(F.concat_ws("|", "file_path", "value"), 256).alias("raw_id"), F.col("value").alias("data"), F.col("file_modification_time").alias("arrived"), F.lit(tenant).alias("tenant_id"),
        F.lit(vendor).cast("string").alias("vendor_type"), F.create_map(F.lit("file"), F.col("file_path")).alias("metadata"),
    )


def decode_hec(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds event, time, host, source, sourcetype, index and accepted; an envelope without an event is refused. time is whole seconds."""
    out = df.withColumn("_e", F.from_json(body, ENVELOPE))
    e = lambda c: F.col(f"_e.{c}")
    return out.select(
        *df.columns, e("event").alias("event"), F.timestamp_seconds(F.floor(e("time").try_cast("double"))).alias("time"), e("host").alias("host"), e("source").alias("source"), e("sourcetype").alias("sourcetype"),
        e("index").alias("index"), e("event").isNotNull().alias("accepted"),
    )


def tenant_from_token(df: DataFrame, tokens: DataFrame, header: str = "authorization") -> DataFrame:
    """Adds tenant_id by the collector token of `Splunk <token>`, looked up in tokens (token, tenant_id); unknown ones are null.

    A token listed twice for one tenant counts once; for several, it belongs to none.
    """
    known = tokens.groupBy("token").agg(F.min("tenant_id").alias("tenant_id"), F.max("tenant_id").alias("_other")).where(F.col("tenant_id") == F.col("_other")).drop("_other")
    return df.withColumn("token", F.regexp_replace(header, "^Splunk ", "")).join(known, "token", "left")


def validate_raw(df: DataFrame, most_bytes: int = UDP_BYTES, strip_newline: bool = False, data: str = "data", tenant: str | None = "tenant_id") -> DataFrame:
    """Adds reject_reason, null for a good line: empty, too large, or without a tenant."""
    line: Column = F.col(data)
    if strip_newline:
        df = df.withColumn(data, F.regexp_replace(line, r"\n$", ""))
    reason = F.when(line.isNull() | (line == ""), "empty").when(F.octet_length(line) > most_bytes, "too large")
    if tenant:
        reason = reason.when(F.col(tenant).isNull() | (F.col(tenant) == ""), "no tenant")
    return df.withColumn("reject_reason", reason)


def with_arrival(df: DataFrame, time: str, arrived: str) -> DataFrame:
    """A time that is missing or not positive (epoch ms) becomes the arrival's."""
    return df.withColumn("time", F.when(F.col(time) > 0, F.timestamp_millis(time)).otherwise(F.col(arrived)))


def ingest_report(df: DataFrame) -> DataFrame:
    """(tenant_id, accepted, refused)."""
    return df.groupBy("tenant_id").agg(F.count_if(F.col("reject_reason").isNull()).alias("accepted"), F.count_if(F.col("reject_reason").isNotNull()).alias("refused"))
