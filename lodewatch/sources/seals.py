"""Evidence that a tier's files are as they were written: digests of their bytes, each sealed together with those before it.

A manifest has a row for each file (folder, n, file, size, digest, seal). A seal is the hash of the seal before it in the folder and of its own
row, so a row that is edited, left out or put in later breaks all seals after it; head() is one hash over the last seals of all folders,
to be kept elsewhere, and shows rows cut off the end. A file is read whole by one task, so it should be of the size that writers here give it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewatch.sources.moves import Store

_ENTRY = "array<struct<n: int, file: string, size: bigint, digest: string, seal: string>>"
COLUMNS = ("folder", "n", "file", "size", "digest", "seal")


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(folder, file, size, digest) of the data files below a folder, by their bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return found.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.col("path").alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))


def _seal(before: Column, x: Column) -> Column:
    return F.sha2(F.concat_ws("|", before, x["file"], x["size"].cast("string"), x["digest"]), 256)


def seal(files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """The manifest of contents(), or with `manifest` that one with the files that it doesn't have yet, sealed behind its own rows."""
    last = None
    if manifest is not None:
        last = manifest.groupBy("folder").agg(F.max("n").alias("last_n"), F.max_by("seal", "n").alias("last_seal"))
        files = files.join(manifest.select("file"), "file", "left_anti")
    each = files.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("file", "size", "digest"))).alias("files"))
    each = each.join(last, "folder", "left") if last is not None else each.withColumns({"last_n": F.lit(None).cast("int"), "last_seal": F.lit(None).cast("string")})
    start = F.struct(F.coalesce("last_seal", F.lit("")).alias("seal"), F.array().cast(_ENTRY).alias("out"))

    def step(acc, x):
        now = _seal(acc["seal"], x)
        entry = F.struct((F.coalesce("last_n", F.lit(0)) + F.size(acc["out"]) + 1).cast("int").alias("n"), x["file"].alias("file"), x["size"].alias("size"), x["digest"].alias("digest"), now.alias("seal"))
        return F.struct(now.alias("seal"), F.concat(acc["out"], F.array(entry)).alias("out"))

    new = each.select("folder", F.explode(F.aggregate("files", start, step, lambda acc: acc["out"])).alias("x")).select("folder", "x.*").select(*COLUMNS)
    return manifest.select(*COLUMNS).unionByName(new) if manifest is not None else new


def head(manifest: DataFrame) -> str:
    """One hash over the last seal of every folder."""
    ends = manifest.groupBy("folder").agg(F.max_by("seal", "n").alias("seal"))
    return ends.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "folder", "seal"))), "\n"), 256)).first()[0]


def audit(manifest: DataFrame, files: DataFrame, kept_head: str | None = None) -> DataFrame:
    """(file, violation): `missing` and `changed` files, by their bytes; `manifest` where a row doesn't fit the seals, or for file `*` the head that was kept. New files are none."""
    rows = manifest.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("n", "file", "size", "digest", "seal"))).alias("rows"))
    before = lambda i: F.when(i == 0, F.lit("")).otherwise(F.get("rows", i - 1)["seal"])
    checked = F.transform("rows", lambda x, i: F.struct(x["file"].alias("file"), ((_seal(before(i), x) == x["seal"]) & (x["n"] == i + 1)).alias("fits")))
    edited = rows.select(F.explode(checked).alias("x")).where("not x.fits").select("x.file", F.lit("manifest").alias("violation"))
    now = files.select("file", F.col("size").alias("now_size"), F.col("digest").alias("now_digest"))
    both = manifest.select("file", "size", "digest").join(now, "file", "left")
    differs = both.where("now_digest is null or now_digest <> digest or now_size <> size").select("file", F.when(F.col("now_digest").isNull(), "missing").otherwise("changed").alias("violation"))
    out = edited.unionByName(differs)
    if kept_head is not None and head(manifest) != kept_head:
        out = out.unionByName(manifest.sparkSession.createDataFrame([("*", "manifest")], "file string, violation string"))
    return out


def tenant_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(tenant_id, files, bytes) of the cold tier, from the folders of its partitions; no file is read."""
    import re
    from urllib.parse import unquote

    store, sums = Store(spark, path), {}
    for at, size in store.sizes(path):
        found = re.search(r"tenant_id=([^/]+)/", at)
        tenant = unquote(found[1]) if found else None
        n, total = sums.get(tenant, (0, 0))
        sums[tenant] = (n + 1, total + size)
    return spark.createDataFrame([(None if t == "__HIVE_DEFAULT_PARTITION__" else t, n, b) for t, (n, b) in sorted(sums.items(), key=lambda x: x[0] or "")], "tenant_id string, files long, bytes long")
