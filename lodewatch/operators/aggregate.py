"""Terms, histograms, rollups and the merging of partial aggregates."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def top_terms(df: DataFrame, field: str, k: int, blanks: bool = True) -> DataFrame:
    """(field, n): the k commonest values, ties by value."""
    rows = df.where(F.col(field).isNotNull() & (F.lit(blanks) | (F.col(field).cast("string") != "")))
    return rows.groupBy(field).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(field)).limit(k)


def nested_top_terms(df: DataFrame, by: list[str], k: int = 1000) -> DataFrame:
    """At each level, the k commonest values within their parent; one row for each path that is left, with its count."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    for depth in range(1, len(by) + 1):
        path = by[:depth]
        level = counts.groupBy(*path).agg(F.sum("n").alias("_n"))
        order = F.desc("_n"), F.asc(path[-1])
        kept = level.withColumn("_rank", F.row_number().over(Window.partitionBy(*path[:-1]).orderBy(*order))).where(F.col("_rank") <= k) if depth > 1 else level.orderBy(*order).limit(k)
        counts = counts.join(kept.select(*path), path, "left_semi")
    return counts


def counts_by(df: DataFrame, field: str, k: int | None = None) -> DataFrame:
    out = df.groupBy(field).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), F.asc(field)).limit(k) if k else out.orderBy(field)


def hourly_counts(df: DataFrame) -> DataFrame:
    """Only hours that have events."""
    return df.groupBy(F.date_trunc("hour", "time").alias("hour")).agg(F.count("*").alias("n"))


def date_histogram(df: DataFrame, unit: str = "day") -> DataFrame:
    """(bucket, n) by calendar unit, with zeros between the first and the last bucket that has events."""
    counted = df.groupBy(F.date_trunc(unit, "time").alias("bucket")).agg(F.count("*").alias("n")).where("bucket is not null")
    span = counted.agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"))
    all_buckets = span.where("first is not null").select(F.explode(F.sequence("first", "last", F.expr(f"interval 1 {unit}"))).alias("bucket"))
    return all_buckets.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


ROLLUP_KEYS = ("event_hour", "tenant_id", "category_name", "severity")


def hourly_rollup(df: DataFrame, exact: bool = False) -> DataFrame:
    """Events, users, source addresses and mean score (column score) by hour, tenant, category and severity."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    return df.groupBy(F.date_trunc("hour", "time").alias("event_hour"), *ROLLUP_KEYS[1:]).agg(
        F.count("*").alias("event_count"), distinct("actor_user").alias("unique_users"), distinct("src_ip").alias("unique_src_ips"), F.avg("score").alias("avg_score")
    )


def rollup_state(df: DataFrame) -> DataFrame:
    """A rollup that can be merged: sums and sketches instead of means and distinct counts."""
    return df.groupBy(F.date_trunc("hour", "time").alias("event_hour"), *ROLLUP_KEYS[1:]).agg(
        F.count("*").alias("event_count"), F.hll_sketch_agg("actor_user").alias("users"), F.hll_sketch_agg("src_ip").alias("ips"), F.sum("score").alias("score_sum"), F.count("score").alias("score_count")
    )


def merge_rollup(state: DataFrame, keys: list[str]) -> DataFrame:
    """Rolled-up rows brought to fewer keys; distinct counts are estimates of the union, not sums."""
    return state.groupBy(*keys).agg(
        F.sum("event_count").alias("event_count"),
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("unique_users"),
        F.hll_sketch_estimate(F.hll_union_agg("ips")).alias("unique_src_ips"),
        (F.sum("score_sum") / F.sum("score_count")).alias("avg_score"),
    )


def add_to_rollup(events: DataFrame, path: str, increment: str) -> None:
    """Adds events to a kept rollup: their states by hour, in a folder of their own by increment and day. Only these events are read.

    The same increment written again replaces itself. Late events are an increment as any other: their hours are merged on reading.
    """
    state = rollup_state(events).withColumn("event_day", F.to_date("event_hour"))
    state.hint("rebalance", "event_day").write.mode("overwrite").partitionBy("event_day").parquet(f"{path}/increment={increment}")


def read_rollup(spark: SparkSession, path: str, keys: list[str], first: date | None = None, last: date | None = None) -> DataFrame:
    """A kept rollup by `keys` (event_hour and the others of ROLLUP_KEYS), over the days from first to last; only their folders are read."""
    state = spark.read.parquet(path)
    if first is not None or last is not None:
        state = state.where(F.col("event_day").between(F.lit(first or date.min), F.lit(last or date.max)))
    return merge_rollup(state, keys)


def merge_aggregates(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Partial rows (keys, n, total, low, high) merged: counts and sums add, extremes stay extremes, the mean is sum by count."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), (F.sum("total") / F.sum("n")).alias("mean")
    )


def merge_buckets(parts: list[DataFrame], key: str) -> DataFrame:
    """Bucket rows (key, doc_count, low, high) merged, largest first."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy(key).agg(F.sum("doc_count").alias("doc_count"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy(F.desc("doc_count"), F.asc(key))


def ip_counts(df: DataFrame, window: str) -> DataFrame:
    """(tenant_id, window_start, ip, n): events of each source address in a tumbling window, as rows; no address is `unknown`."""
    each = df.groupBy("tenant_id", F.window("time", window).alias("w"), F.coalesce("src_ip", F.lit("unknown")).alias("ip")).agg(F.count("*").alias("n"))
    return each.select("tenant_id", F.col("w.start").alias("window_start"), "ip", "n")
