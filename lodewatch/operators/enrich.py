"""Threat intelligence, profiles and tenants joined to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewatch.functions.columns import is_known_safe

#: An indicator table is broadcast up to this number of rows, else Spark chooses a shuffled join.
BROADCAST_INDICATORS = 500_000
THREAT_ABOVE = 50


def _sized(small: DataFrame) -> DataFrame:
    """Marked for broadcast if it is small; a streaming side can't be counted and is left to Spark."""
    if small.isStreaming:
        return small
    return F.broadcast(small) if small.limit(BROADCAST_INDICATORS + 1).count() <= BROADCAST_INDICATORS else small


def read_indicators(spark: SparkSession, path: str) -> DataFrame:
    """(indicator, kind, reputation, category) from Parquet or, by its ending, CSV with a header or JSON lines; rows without an indicator go."""
    schema = "indicator string, kind string, reputation int, category string"
    reader = spark.read.schema(schema)
    table = reader.csv(path, header=True) if path.endswith(".csv") else reader.json(path) if path.endswith(".json") else reader.parquet(path)
    return table.where(F.trim("indicator") != "")


def enrich_threat_intel(df: DataFrame, intel: DataFrame, on: str | Column, kind: str = "ip", safe_list: bool = True) -> DataFrame:
    """Adds reputation, threat_category and is_threat. Unknown and private addresses are safe (0, `safe`); no address gives nulls."""
    key = F.col(on) if isinstance(on, str) else on
    own = intel.where(F.col("kind") == kind).groupBy("indicator").agg(F.max_by(F.struct("reputation", "category"), "reputation").alias("_hit"))
    out = df.withColumn("_key", key).join(_sized(own), F.col("_key") == F.col("indicator"), "left")
    known = F.col("_key").isNotNull() & (F.col("_key") != "")
    hit = F.when(is_known_safe(F.col("_key")), F.lit(None)).otherwise(F.col("_hit")) if safe_list and kind == "ip" else F.col("_hit")
    out = out.withColumn("reputation", F.when(known, F.coalesce(hit["reputation"], F.lit(0)))).withColumn("threat_category", F.when(known, F.coalesce(hit["category"], F.lit("safe"))))
    return out.withColumn("is_threat", F.coalesce(F.col("reputation") > THREAT_ABOVE, F.lit(False))).drop("_key", "_hit", "indicator")


DEFAULT_PROFILE = {"avg_volume": 0.0, "std_volume": 1.0, "avg_logins": 0.0, "std_logins": 1.0}


def with_profile(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each event with its user's profile by (tenant, user); an unknown user has the default one."""
    out = df.join(profiles, ["tenant_id", "actor_user"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULT_PROFILE.items()})


def of_tenants(df: DataFrame, tenants: DataFrame, statuses: tuple[str, ...] = ("active",)) -> DataFrame:
    """Rows of tenants in one of the statuses: active for ingestion, active or provisioning for reading."""
    allowed = tenants.where(F.col("status").isin(*statuses)).select(F.col("id").alias("tenant_id"))
    return df.join(F.broadcast(allowed) if allowed.limit(100_001).count() <= 100_000 else allowed, "tenant_id", "left_semi")


def tenant_violations(df: DataFrame, tenant: str) -> DataFrame:
    """Rows that aren't the caller's; null tenants are violations, too."""
    return df.where(~F.col("tenant_id").eqNullSafe(F.lit(tenant)))
