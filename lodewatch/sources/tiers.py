"""The three storage tiers as partitioned Parquet, and what moves rows between them.

hot: by day; warm: by month, sorted by tenant and time; cold: by year, month and tenant. A write replaces whole partitions. A row's
tier follows from its age in whole days. Migrations are logged by file (see `moves`): broken off anywhere and run again,
each row is in one tier, as often as it was written.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodewatch.functions.times import tiers_for_range
from lodewatch.sources import moves

LAYOUT = {"hot": ["event_date"], "warm": ["event_month"], "cold": ["year", "month", "tenant_id"]}
_ADDED = {
    "event_date": lambda: F.to_date("time"), "event_month": lambda: F.date_format("time", "yyyy-MM"), "year": lambda: F.year("time"), "month": lambda: F.date_format("time", "MM"),
}


def write_tier(df: DataFrame, root: str, tier: str, mode: str = "overwrite") -> None:
    """Rows of a tier under root/tier; only the partitions that the rows fall into are replaced."""
    keys = LAYOUT[tier]
    rows = df.withColumns({k: _ADDED[k]() for k in keys if k in _ADDED})
    # a partition's rows meet in as many tasks as there are rows for, so one large day isn't one task
    rows = rows.hint("rebalance", *keys).sortWithinPartitions(*keys, *(["tenant_id"] if "tenant_id" not in keys else []), "time")
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*keys).option("compression", "snappy").parquet(f"{root}/{tier}")


def read_tiers(spark: SparkSession, root: str, start: datetime, end: datetime, as_of: datetime, hot_days: int = 7, warm_days: int = 90) -> DataFrame:
    """Rows from start to end out of the tiers that the range touches, with their tier. Filters reach the partitions.

    Rows become of age by whole days, and stay in the younger tier until they are migrated, so younger tiers are looked into as well: where
    nothing is late, no partition of theirs passes the filter. Tiers that aren't there yet have no rows.
    """
    touched, out = tiers_for_range(start, end, as_of, hot_days, warm_days), None
    running = moves.moves(spark, root)
    for tier in list(LAYOUT)[: max((list(LAYOUT).index(t) + 1 for t in touched), default=0)]:
        t = moves.visible(spark, root, tier, running)
        if t is None:
            continue
        kind = t.schema["time"].dataType
        t = t.where(F.col("time").between(F.lit(start).cast(kind), F.lit(end).cast(kind)))
        if tier == "hot":
            t = t.where(F.col("event_date").between(start.date(), end.date()))
        elif tier == "warm":
            t = t.where(F.col("event_month").between(f"{start:%Y-%m}", f"{end:%Y-%m}"))
        else:
            t = t.where(F.col("year").between(start.year, end.year))
        t = t.drop(*(k for k in LAYOUT[tier] if k != "tenant_id")).withColumn("tier", F.lit(tier))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no tier under {root}")
    return out


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def split_by_age(df: DataFrame, as_of: datetime, days: int) -> tuple[DataFrame, DataFrame]:
    """(rows at least `days` whole days old, the rest)."""
    cutoff = F.lit((as_of - timedelta(days=days)).date())
    old = F.coalesce(F.to_date("time") <= cutoff, F.lit(False))
    return df.where(old), df.where(~old)


_REPORT = "moved long, source_rows long, copy_rows long, same boolean, removed long"


def migrate(spark: SparkSession, root: str, source: str, target: str, as_of: datetime, days: int, drop: bool = True, reached: Callable[[str], None] = lambda step: None) -> DataFrame:
    """Moves a tier's rows of at least `days` whole days to the next tier; one row: moved, source_rows, copy_rows, same, removed.

    A run notes the files that hold such rows, writes those rows for the next tier and the younger rows of the same files for the
    source, both aside, and checks counts and sums of hashes against what it has read. Only then is it committed: its files become
    part of the tiers and those it has read go. A run that breaks off earlier leaves nothing, one that breaks off later is finished by
    the next; so every row is in one tier, as often as it was written, equal rows that arrive late included. With drop=False
    the old files stay until the next run, but aren't read any more. Rows without a time stay where they are.

    A run that finishes an earlier one counts that one's rows as source_rows and copy_rows, and none as moved. `reached` is told each step.
    """
    report = {"moved": 0, "source_rows": 0, "copy_rows": 0, "same": True, "removed": 0}
    for earlier, gone in moves.recover(spark, root):
        for k in ("source_rows", "copy_rows"):
            report[k] += earlier.report()[k]
        report["removed"] += gone
    store = moves.Store(spark, root)
    if next(store.files(f"{root}/{source}"), None):
        table = spark.read.parquet(f"{root}/{source}")
        limit = (as_of - timedelta(days=days)).date()
        old = split_by_age(table, as_of, days)[0]
        if source == "hot":
            old = old.where(F.col("event_date") <= limit)
        elif source == "warm":
            old = old.where(F.col("event_month") <= f"{limit:%Y-%m}")
        move = moves.Move(store)
        old.select(F.col("_metadata.file_path").alias("file")).distinct().write.parquet(f"{move.at}/reads")
        move.mark("planned")
        reached("planned")
        names = [r["file"] for r in move.reads().toLocalIterator()]
        if not names:
            move.roll_back()
        else:
            own = _stage(spark, table, move, names, source, target, as_of, days, reached)
            for k in ("source_rows", "copy_rows"):
                report[k] += own[k]
            report["same"] = own["same"]
            if own["same"]:
                report["moved"] = own["copy_rows"]
                move.mark("committed", own)
                reached("committed")
                move.publish()
                reached("published")
                if drop:
                    report["removed"] += move.drop()
            else:
                move.roll_back()
    return spark.createDataFrame([tuple(report.values())], _REPORT)


def _stage(spark, table: DataFrame, move: moves.Move, names: list[str], source: str, target: str, as_of: datetime, days: int, reached) -> dict:
    """Writes a run's rows aside; source_rows, copy_rows, and whether what was written is what was read."""
    columns = [c for c in table.columns if c not in LAYOUT[source] or c == "tenant_id"]
    # only the files noted, so those that come meanwhile aren't looked at
    rows = spark.read.option("basePath", f"{move.store.root}/{source}").schema(table.schema).parquet(*map(unquote, names))
    counts, same = {}, True
    for tier, part in zip((target, source), split_by_age(rows, as_of, days)):
        part = part.select(*columns)
        if tier == source and part.isEmpty():
            continue
        write_tier(part, f"{move.at}/staged", tier, "append")
        reached(f"staged {tier}")
        found = verify_migration(part, spark.read.schema(_with_keys(part, tier)).parquet(move.staged(tier)), columns).first()
        same = same and found["same"]
        if tier == target:
            counts = {"source_rows": found["source_rows"], "copy_rows": found["copy_rows"]}
    return {**counts, "same": same}


def _with_keys(rows: DataFrame, tier: str) -> T.StructType:
    """The schema of rows in a tier's layout."""
    keys = {"event_date": T.DateType(), "event_month": T.StringType(), "year": T.IntegerType(), "month": T.StringType()}
    return T.StructType([*rows.schema.fields, *(T.StructField(k, keys[k]) for k in LAYOUT[tier] if k in keys)])


def migrate_hot_to_warm(spark: SparkSession, root: str, as_of: datetime, days: int = 7, drop: bool = True) -> DataFrame:
    """migrate() from hot to warm."""
    return migrate(spark, root, "hot", "warm", as_of, days, drop)


def migrate_warm_to_cold(spark: SparkSession, root: str, as_of: datetime, days: int = 90, drop: bool = True) -> DataFrame:
    """migrate() from warm to cold."""
    return migrate(spark, root, "warm", "cold", as_of, days, drop)


def verify_migration(source: DataFrame, copy: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows of both sides, and whether their counts and the sums of their rows' hashes agree."""
    plain = lambda df, c: F.array_sort(F.map_entries(c)) if isinstance(df.schema[c].dataType, T.MapType) else F.col(c)
    side = lambda df, p: df.agg(F.count("*").alias(f"{p}_rows"), F.sum(F.xxhash64(*(plain(df, c) for c in columns)).cast("decimal(38,0)")).alias(f"{p}_sum"))
    both = side(source, "source").join(side(copy, "copy"), F.lit(True))  # one row each
    return both.select("source_rows", "copy_rows", ((F.col("source_rows") == F.col("copy_rows")) & F.col("source_sum").eqNullSafe(F.col("copy_sum"))).alias("same"))


def rehydrate(cold: DataFrame, start: datetime, end: datetime, tenant: str | None = None) -> DataFrame:
    """Cold rows of a range, and a tenant, to be written to hot; the filters reach the partitions."""
    kind = cold.schema["time"].dataType
    out = cold.where(F.col("time").between(F.lit(start).cast(kind), F.lit(end).cast(kind)))
    if "year" in cold.columns:
        out = out.where(F.col("year").between(start.year, end.year))
    return out.where(F.col("tenant_id") == tenant) if tenant is not None else out


def apply_retention(df: DataFrame, tenants: DataFrame, as_of: datetime, default_days: int = 90) -> DataFrame:
    """Rows younger than their tenant's retention_days."""
    days = tenants.select(F.col("id").alias("tenant_id"), "retention_days")
    out = df.join(F.broadcast(days) if days.limit(100_001).count() <= 100_000 else days, "tenant_id", "left")
    return out.where(F.to_date("time") >= F.date_sub(F.lit(as_of.date()), F.coalesce("retention_days", F.lit(default_days)))).drop("retention_days")


def expire_partitions(spark: SparkSession, root: str, as_of: datetime, days: int, tier: str = "hot") -> list[str]:
    """Removes a tier's day partitions (hot) or months (warm) that end before the last `days` days, and says which."""
    moves.recover(spark, root)
    key = LAYOUT[tier][0]
    limit = (as_of - timedelta(days=days)).date()
    values = [str(r[0]) for r in spark.read.parquet(f"{root}/{tier}").select(F.col(key).cast("string")).distinct().collect() if r[0] is not None]
    gone = sorted(v for v in values if v < (limit.isoformat() if tier == "hot" else f"{limit:%Y-%m}"))
    _remove(spark, [f"{root}/{tier}/{key}={v}" for v in gone])
    return gone


def within_days(df: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Rows of days within the last `days`."""
    return df.where(F.to_date("time") >= F.lit((as_of - timedelta(days=days)).date()))


def file_manifest(df: DataFrame) -> DataFrame:
    """(file, size, rows) of a table's files."""
    return df.select("_metadata.file_path", "_metadata.file_size").groupBy(F.col("file_path").alias("file"), F.col("file_size").alias("size")).agg(F.count("*").alias("rows"))


def worm_audit(then: DataFrame, now: DataFrame) -> DataFrame:
    """(file, violation): files that were there and are missing or changed; new files are none."""
    old, new = then.select("file", F.col("size").alias("old_size")), now.select("file", F.col("size").alias("new_size"))
    both = old.join(new, "file", "left").where(F.col("new_size").isNull() | (F.col("new_size") != F.col("old_size")))
    return both.select("file", F.when(F.col("new_size").isNull(), "missing").otherwise("changed").alias("violation"))


def tier_report(df: DataFrame) -> DataFrame:
    """(tier, tenant_id, rows, oldest, newest) of rows with a tier."""
    return df.groupBy("tier", "tenant_id").agg(F.count("*").alias("rows"), F.min("time").alias("oldest"), F.max("time").alias("newest"))


def tier_files(spark: SparkSession, root: str) -> DataFrame:
    """(tier, files, bytes, rows) of the tiers under a root."""
    out = None
    for tier in LAYOUT:
        if _there(spark, f"{root}/{tier}"):
            own = file_manifest(spark.read.parquet(f"{root}/{tier}")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("rows").alias("rows"))
            own = own.select(F.lit(tier).alias("tier"), "files", "bytes", "rows")
            out = own if out is None else out.unionByName(own)
    return out if out is not None else spark.createDataFrame([], "tier string, files long, bytes long, rows long")
