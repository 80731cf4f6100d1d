"""Shared pieces: shared-folder tables, connected components, and vectorised word handling on Arrow buffers."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodewatch.sources.shared import shared_dir

# ---------------------------------------------------------------- tables in the shared folder


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clear(spark: SparkSession, root: str) -> None:
    try:
        _delete(spark, root)
    except Exception:  # the session has ended before the interpreter
        return


class Stored:
    """Parquet tables in the shared folder: they cut lineage and outlive a lost executor. drop() removes one early.

    The files go when the program ends; until then only their folder's name is kept, and no table with its plans.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}", {}
        self.n = 0
        atexit.register(_clear, spark, self.root)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{self.n}"
        self.n += 1
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def again(self, tables: list[DataFrame]) -> DataFrame:
        """All rows of tables of one schema that were put here, as one table."""
        return self.spark.read.schema(tables[0].schema).parquet(*(self.paths[id(t)][0] for t in tables))

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, self.paths.pop(id(t))[0])


#: Edges from which on the neighbours' minima are stored before they are joined.
MANY_EDGES = 1_000_000


def components(edges: DataFrame, stored: Stored, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable over undirected edges (a, b), for every id with an edge.

    Alternating large-star and small-star steps; each is a grouped minimum (combined before the shuffle) joined back, and only
    two numbers a round come to the driver. Minima of many edges are stored first: a join of two plain shuffles is one that
    adaptive execution splits where a hub's edges fill a partition.
    Null ends, self-loops and repeated edges are ignored; no edges give no rows.
    """
    now = stored.put(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct(),
        "edges",
    )
    seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        if seen[0] > MANY_EDGES:
            least = stored.put(least, "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = stored.put(small, "edges")
        then = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        stored.drop(now, *([least] if seen[0] > MANY_EDGES else []))
        now, done = after, tuple(then) == tuple(seen)
        seen = then
        if done:
            break
    own = now.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(own)


# ---------------------------------------------------------------- order


def in_order(df: DataFrame, stored: Stored, order: list[str], at: str = "at") -> DataFrame:
    """The rows sorted by `order` (nulls first) over all partitions, with a long that ascends with it; not gapless. Stored, so the places stay.

    Ranges take in all columns of `order`, so one frequent value of the first is spread over many.
    """
    return stored.put(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ordered")


def places(rows: DataFrame, group: list[str], at: str = "at", i: str = "i", n: str = "n") -> DataFrame:
    """The rows of in_order() with `i`, their place from 0 within their group, and `n`, the group's rows. The order must begin with the group's columns.

    No group meets in one task: places within ranges are shifted by the counts of the ranges before, one row a group and range.
    """
    rows = rows.withColumn("range", F.shiftright(at, 33))
    runs = rows.groupBy("range", *group).agg(F.min(at).alias("first"), F.count("*").alias("here"))
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    before = F.coalesce(F.sum("here").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("range").alias("in_range"), *(F.col(c).alias(f"of_{c}") for c in group), (before - F.col("first")).alias("shift"), F.sum("here").over(whole).alias(n))
    same = F.col("range") == F.col("in_range")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    out = rows.join(runs, same).withColumn(i, F.col(at) + F.col("shift"))
    return out.drop("range", "in_range", "shift", *(f"of_{c}" for c in group))


def numbered(df: DataFrame, stored: Stored, group: list[str], order: list[str]) -> DataFrame:
    """places() of the rows sorted by `order`."""
    return places(in_order(df, stored, order), group).drop("at")


# ---------------------------------------------------------------- Arrow batches

ARROW_BYTES = 4 << 20


def give_back() -> None:
    """Returns freed memory to the system: workers live on, and what one stage has used must not add to the next one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def send_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, unless they start where it is on the path."""
    root = Path(__file__).resolve().parents[2]
    known = {os.path.realpath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), "."]}
    context = spark.sparkContext
    if str(root) in known or getattr(context, "_package_sent", False):
        return
    context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-package-')}/{root.name}-package", "zip", root, Path(__file__).resolve().parents[1].name))
    context._package_sent = True


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with one function a task, made by make(); it may return a batch or yield several. Batches are cut by bytes.

    A function with an attribute `ends` carries something from batch to batch, and is called with None after the last one.
    """
    send_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))

    def run(batches):
        f = make()
        for batch in chain(batches, [None] if getattr(f, "ends", False) else []):
            got = f(batch)
            if isinstance(got, pa.RecordBatch):
                yield got
            else:
                yield from got
            del got, batch
        give_back()

    return df.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most `limit` bytes of text each (or a single row)."""
    n = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    ends, start = np.cumsum(n), 0
    while start < len(n):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


# ---------------------------------------------------------------- words as 64-bit hashes, without a Python loop

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that end a word of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (digits, a-z and all of UTF-8 beyond ASCII stay).
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[*range(0, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_POWER, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, p in enumerate((_POWER, _INVERSE)):
            x = np.full(size, p, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a text column, where each row starts and the end). Null text: no bytes."""
    texts = pa.compute.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def running(raw: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any run of bytes follows."""
    return np.cumsum(_TABLE[raw] * _grown(len(raw))[0][: len(raw)], dtype=np.uint64)


def run_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """A hash of the bytes from each s to its e (inclusive)."""
    sums = running(raw) if sums is None else sums
    h = sums[e] - np.where(s > 0, sums[np.maximum(s, 1) - 1], np.uint64(0))
    return mix(h * _powers[1][s])


def word_spans(raw: np.ndarray, at: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of each run of bytes that aren't `breaks`, within rows."""
    word = ~breaks[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last)


def word_hashes(texts: pa.Array, breaks: np.ndarray = SPACES, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of the first word of each row and one past the last). Null text: no words.

    Words are runs of bytes that aren't `breaks`; A-Z is folded first if lower is set.
    """
    raw, at = text_bytes(texts)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    if lower:
        raw = LOWER[raw]
    s, e = word_spans(raw, at, breaks)
    return run_hashes(raw, s, e), np.searchsorted(s, at)


def shingles(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of k words, row starts). A row with 1 to k-1 words gives one shingle, the whole row; an empty one none."""
    n = np.diff(rows)
    size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    starts = np.concatenate([[0], np.cumsum(size)])
    if not starts[-1]:
        return np.zeros(0, np.uint64), starts
    row = np.repeat(np.arange(len(n)), size)
    at = np.arange(starts[-1]) - starts[row] + rows[row]
    length = np.minimum(n[row], k)
    h = length.astype(np.uint64)
    for j in range(k):
        take = length > j
        h = h * np.uint64(0xD6E8FEB86659FD93) + np.where(take, words[np.minimum(at + j, len(words) - 1)], np.uint64(0))
    return mix(h), starts


def distinct(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values sorted and made distinct within each row, with the new row starts."""
    out, size = [], np.zeros(len(starts) - 1, np.int64)
    for r in range(len(starts) - 1):
        v = values[starts[r] : starts[r + 1]]
        if len(v) > 1:
            v = np.sort(v)
            v = v[np.concatenate([[True], v[1:] != v[:-1]])]
        size[r] = len(v)
        out.append(v)
    return (np.concatenate(out) if out else values[:0]), np.concatenate([[0], np.cumsum(size)])
