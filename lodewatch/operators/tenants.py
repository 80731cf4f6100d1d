"""Tenant tables, provisioning and quotas."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def by_status(tenants: DataFrame, *statuses: str) -> DataFrame:
    return tenants.where(F.col("status").isin(*statuses))


def count_by_status(tenants: DataFrame) -> DataFrame:
    return tenants.groupBy("status").agg(F.count("*").alias("n"))


def by_id(tenants: DataFrame, tenant: str) -> DataFrame:
    return tenants.where(F.col("id") == F.lit(tenant))


def all_tenants(tenants: DataFrame) -> DataFrame:
    return tenants.orderBy("id")


def exists(tenants: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, exists) of the ids asked for, each once."""
    known = tenants.select("id").distinct().withColumn("exists", F.lit(True))
    return ids.select("id").distinct().join(known, "id", "left").select("id", F.coalesce("exists", F.lit(False)).alias("exists"))


def delete_tenants(tenants: DataFrame, ids: list[str]) -> DataFrame:
    return tenants.where(~F.col("id").isin(*ids))


def provision_tenants(requests: DataFrame) -> DataFrame:
    """Tenants from requests (id, name, dedicated, max_eps, retention_days): defaults by kind; without id or name, a reject reason."""
    d = F.coalesce("dedicated", F.lit(False))
    missing = F.coalesce(F.trim("id") == "", F.lit(True)) | F.coalesce(F.trim("name") == "", F.lit(True))
    return requests.select(
        "id", "name", d.alias("dedicated"), F.when(d, "enterprise").otherwise("standard").alias("tier"), F.coalesce("max_eps", F.when(d, 100_000).otherwise(10_000)).alias("max_eps"),
        F.coalesce("retention_days", F.when(d, 365).otherwise(90)).alias("retention_days"), F.when(missing, "rejected").otherwise("provisioning").alias("status"), F.when(missing, "id and name are required").alias("reject_reason"),
    )


def events_per_second(df: DataFrame, tenants: DataFrame) -> DataFrame:
    """(tenant_id, peak, max_eps, over): the busiest second of each tenant against its limit."""
    seconds = df.groupBy("tenant_id", F.date_trunc("second", "time").alias("s")).agg(F.count("*").alias("n"))
    peak = seconds.groupBy("tenant_id").agg(F.max("n").alias("peak"))
    return peak.join(tenants.select(F.col("id").alias("tenant_id"), "max_eps"), "tenant_id").withColumn("over", F.col("peak") > F.col("max_eps"))


def quota_audit(df: DataFrame, capacity: int, refill: float, unit: str = "second") -> DataFrame:
    """(tenant_id, slot, n, level, refused) of a token bucket of `capacity`, refilled by `refill` a second, at one token an event.

    A slot takes all its tokens or, if they aren't there, is refused whole and the bucket stays as it was last saved, its
    refill clock running. Only slots with events count. Counts are partial before they are shuffled; then a tenant's slots
    pass in order through one task, in batches, with the bucket carried along: linear in time, and nothing is gathered.
    """
    slots = df.groupBy("tenant_id", F.date_trunc(unit, "time").alias("slot")).agg(F.count("*").alias("n")).withColumn("_s", F.unix_seconds(F.col("slot").cast("timestamp")))

    def run(batches):
        tenant, saved, clock, begun = None, float(capacity), 0, False
        for batch in batches:
            levels, refused = [], []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("tenant_id", "_s", "n")]
            for who, at, n in zip(*columns):
                if not begun or who != tenant:
                    tenant, saved, clock, begun = who, float(capacity), at, True
                level = min(float(capacity), saved + (at - clock) * refill)
                levels.append(level)
                refused.append(level < n)
                if level >= n:
                    saved, clock = level - n, at
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(levels, pa.float64()), pa.array(refused, pa.bool_())], [*batch.schema.names, "level", "refused"])

    kind = T.StructType([*slots.schema.fields, T.StructField("level", T.DoubleType()), T.StructField("refused", T.BooleanType())])
    return slots.repartition("tenant_id").sortWithinPartitions("tenant_id", "_s").mapInArrow(run, kind).drop("_s")
