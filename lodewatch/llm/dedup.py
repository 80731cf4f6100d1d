"""Near-duplicate documents by MinHash with odd sketches.

Each document's distinct word shingles give MinHash samples. Samples are hashed in bands to find candidates; the same samples
are folded into a parity bitmap (an odd sketch), and the population count of two bitmaps' XOR estimates a high similarity
precisely enough to drop nearly all false candidates; the rest are verified on their full shingle sets.

Documents with equal sets are one class from the start. In a bucket every class is first compared with the bucket's least
one, so a large group of copies costs one pair each. Links make components, and likely pairs make (larger) clusters. Then

* within a cluster that still has several components, all sets outside its largest one are compared exactly with all others,
  block by block;
* across clusters, members of a bucket outside the least one's component are compared with those of other components.

So every pair that shares a bucket is compared, or connected already, or told apart by its sketches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, arrow_map, components, distinct, mix, shingles, sliced, word_hashes

#: Bands of ROWS samples each: at similarity 0.8 a pair shares no band once in 190,000 times.
BANDS, ROWS = 40, 6
SAMPLES = BANDS * ROWS
#: Longs in an odd sketch. At 0.8 about 80 of 512 bits differ, give or take 11; beyond DIFFER (about 0.6) a pair is dropped.
SKETCH_LONGS, DIFFER = 8, 135
PART_BYTES = 1 << 20
#: Documents of a block when a cluster is compared exactly.
BLOCK_DOCS = 256
#: Members of a band that are compared in one task with those outside its least one's component; more are split.
BAND_DOCS = 1_000
#: Candidate ids are sent to all executors up to this number (12 bytes each), else the texts are shuffled to them.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(11)
_FACTOR = _rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSET = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)


def minhash(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SAMPLES x rows minima; every row must have a value."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((SAMPLES, len(starts) - 1), np.uint32)
    for i in range(SAMPLES):
        out[i] = np.minimum.reduceat(x * _FACTOR[i] + _OFFSET[i], starts[:-1])
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps, rows x SKETCH_LONGS, of the sets {(i, sample i)}."""
    bits = SKETCH_LONGS * 64
    place = mix(samples.astype(np.uint64) + (np.arange(len(samples), dtype=np.uint64) << np.uint64(32))[:, None]) % np.uint64(bits)
    n = samples.shape[1]
    parity = np.bincount((place.astype(np.int64) + np.arange(n) * bits).ravel(), minlength=n * bits) & 1
    return np.packbits(parity.astype(np.uint8).reshape(n, bits), axis=1).view(">i8").astype(np.int64)


def _set_ids(values: np.ndarray, own: np.ndarray) -> list[pa.Array]:
    """set_a and set_b, which tell sets apart: sum and XOR of the values of each (non-empty) row."""
    return [pa.array(x.astype(np.int64)) for x in (np.add.reduceat(values, own[:-1]), np.bitwise_xor.reduceat(mix(values), own[:-1]))]


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands, odd) of each row (doc_id, text); without shingles the last four are null."""

    def make():
        def run(batch: pa.RecordBatch):
            for part in sliced(batch, "text", PART_BYTES):
                values, starts = distinct(*shingles(*word_hashes(part.column("text")), k))
                n = np.diff(starts)
                some = np.flatnonzero(n)
                back = np.full(len(n), -1)
                back[some] = np.arange(len(some))
                if len(some):
                    own = np.append(starts[:-1][some], starts[-1])
                    samples = minhash(values, own)
                    banded = np.zeros((len(some), BANDS), np.uint64)
                    for b in range(BANDS):
                        h = np.full(len(some), b, np.uint64)
                        for r in range(ROWS):
                            h = mix(h * np.uint64(31) + samples[b * ROWS + r])
                        banded[:, b] = h
                    odd = odd_sketch(samples)
                    take = pa.array(back, mask=back < 0)
                    lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.int64).ravel()), x.shape[1]).cast(pa.list_(pa.int64())).take(take) for x in (banded, odd)]
                    sets = [x.take(take) for x in _set_ids(values, own)]
                else:
                    lists, sets = [pa.nulls(len(n), pa.list_(pa.int64()))] * 2, [pa.nulls(len(n), pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *sets, *lists], ["doc_id", "n_shingles", "set_a", "set_b", "bands", "odd"])

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs, make, f"doc_id {kind}, n_shingles long, set_a long, set_b long, bands array<bigint>, odd array<bigint>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, set_a, set_b, shingles): the sorted distinct 64-bit hashes of each row's shingles as bytes. Rows without words are left out."""

    def make():
        def run(batch: pa.RecordBatch):
            for part in sliced(batch, "text", PART_BYTES):
                values, starts = distinct(*shingles(*word_hashes(part.column("text")), k))
                some = np.flatnonzero(np.diff(starts))
                if not len(some):
                    continue
                raw, own = values.tobytes(), np.append(starts[:-1][some], starts[-1])
                sets = pa.array([raw[8 * a : 8 * b] for a, b in zip(own[:-1], own[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(some)), *_set_ids(values, own), sets], ["doc_id", "set_a", "set_b", "shingles"])

        return run

    return arrow_map(docs, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, set_a long, set_b long, shingles binary")


def _similar(percent: int):
    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                if not len(p) or 100 * len(p) < percent * len(q):
                    keep.append(False)
                    continue
                both = int(np.count_nonzero(q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return run

    return make


def _sketches_allow(percent: int) -> Column:
    """Whether sizes and sketches (n_a, odd_a, n_b, odd_b) leave a similarity of `percent` possible."""
    differ = sum((F.bit_count(F.col("odd_a")[i].bitwiseXOR(F.col("odd_b")[i])) for i in range(SKETCH_LONGS)), F.lit(0))
    return (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (differ <= DIFFER)


def sets_of(ids: DataFrame, reps: DataFrame, docs: DataFrame, k: int, stored: Stored) -> DataFrame:
    """(rep, shingles) of the classes with these numbers, each read from a document of the class.

    reps: rep, least, set_a, set_b. The documents' ids are broadcast if they are few, else the texts are shuffled to them.
    """
    wanted = stored.put(reps.join(ids.select("rep"), "rep", "left_semi").select("rep", F.col("least").alias("doc_id"), "set_a", "set_b"), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    near = F.broadcast if few else lambda df: df
    texts = docs.join(near(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    # an id may have several texts, and a text may stand several times under it
    sets = shingle_sets(texts, k).join(near(wanted), ["doc_id", "set_a", "set_b"]).select("rep", "shingles")
    return stored.put(sets.groupBy("rep").agg(F.first("shingles").alias("shingles")), "sets")


def verified(likely: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int, stored: Stored) -> DataFrame:
    """Those pairs (a, b) of classes whose full sets are similar enough."""
    ids = stored.put(likely.select(F.col("a").alias("rep")).union(likely.select(F.col("b").alias("rep"))).distinct(), "ids")
    sets = sets_of(ids, reps, docs, k, stored)
    joined = likely.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
    out = stored.put(arrow_map(joined.select("a", "b", "x", "y"), _similar(percent), "a long, b long").distinct(), "links")
    stored.drop(sets, ids)
    return out


def _block(percent: int):
    """Links between a block's documents that are in different components, as a forest."""

    def run(pdf):
        import pandas as pd

        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        links = []
        if len(left) and len(right):
            p, q = ([np.frombuffer(x, np.uint64) for x in side["shingles"]] for side in (left, right))
            n_p, n_q = np.array([len(x) for x in p]), np.array([len(x) for x in q])
            flat, owner = np.concatenate(q), np.repeat(np.arange(len(q)), n_q)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            ids = [*left["rep"], *right["rep"]]
            part = np.unique(np.array([*left["component"], *right["component"]]), return_inverse=True)[1]
            for r, x in enumerate(p):
                lo, hi = np.searchsorted(flat, x), np.searchsorted(flat, x, "right")
                size = hi - lo
                at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
                both = np.bincount(owner[at], minlength=len(q))
                for c in np.flatnonzero((100 * both >= percent * (n_p[r] + n_q - both)) & (part[len(p) :] != part[r])):
                    if part[len(p) + c] != part[r]:
                        links.append((ids[r], ids[len(p) + c]))
                        part[part == part[len(p) + c]] = part[r]
        return pd.DataFrame(links, columns=["a", "b"])

    return run


def within_clusters(cluster: DataFrame, label: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int, stored: Stored) -> DataFrame:
    """Links between different components of a cluster; cluster and label: (id, component).

    What is in the cluster's largest component isn't compared with itself: blocks of it come after all others' and meet only these.
    """
    sizes = cluster.select(F.col("id").alias("rep"), F.col("component").alias("cluster")).join(label.withColumnRenamed("id", "rep"), "rep", "left")
    sizes = stored.put(sizes.withColumn("component", F.coalesce("component", "rep")), "sizes")
    parts = sizes.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("several")).where("n > 2 and several > 1")
    blocks = lambda n: F.expr(f"({n} + {BLOCK_DOCS - 1}) div {BLOCK_DOCS}")
    grid = mixed.select("cluster", F.col("main.component").alias("largest"), blocks("n - main.n").alias("first"), blocks("main.n").alias("then"))
    chosen = sizes.join(grid, "cluster").withColumn("outside", F.col("component") != F.col("largest"))
    own = F.when(F.col("outside"), F.pmod(F.xxhash64("rep"), F.col("first"))).otherwise(F.col("first") + F.pmod(F.xxhash64("rep"), F.col("then")))
    meets = F.when(F.col("outside"), F.col("first") + F.col("then")).otherwise(F.col("first"))
    chosen = stored.put(chosen.select("cluster", "rep", "component", own.alias("own"), meets.alias("meets")), "chosen")
    sets = sets_of(chosen, reps, docs, k, stored)
    each = chosen.join(sets, "rep").withColumn("other", F.explode(F.expr("sequence(0L, meets - 1)")))
    i, j = F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    # a block pair (i, j) compares block i with block j; within a block, with itself
    sides = F.when(F.col("own") == F.col("other"), F.array(F.lit(0), F.lit(1))).when(F.col("own") < F.col("other"), F.array(F.lit(0))).otherwise(F.array(F.lit(1)))
    rows = each.select("cluster", i, j, F.explode(sides).alias("side"), "rep", "component", "shingles")
    return stored.put(rows.groupBy("cluster", "i", "j").applyInPandas(_block(percent), "a long, b long"), "links")


def _extended(label: DataFrame, links: DataFrame, stored: Stored) -> DataFrame:
    """Components (id, component) after further links; the old ones stand in as stars, and stay if there is no new link."""
    if links.isEmpty():
        return label
    stars = label.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    return stored.put(components(stars.unionByName(links.select("a", "b")), stored), "components")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each document, links at 100 * shared >= percent * union.

    Words are runs without white space, A-Z folded; a text of fewer than k words is one shingle; one without words, or null,
    has none and is linked with nothing. Rows with a null id are linked with nothing, have a null component and are kept.
    Ids may be of any type with an order. Rows of one id share a component, whatever their texts. An empty table gives no rows;
    columns other than key and text are left out.
    """
    stored = Stored(docs.sparkSession)
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    known = docs.where("doc_id is not null")
    sig = stored.put(sketch(docs, k), "sketches")
    full = sig.where("doc_id is not null and n_shingles > 0")
    # a class of equal sets has a number of its own, as an id may stand for several texts; it is stored, so it stays
    of_set = ["set_a", "set_b"]
    some = full.groupBy(of_set).agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "odd")))
    reps = stored.put(some.withColumn("rep", F.monotonically_increasing_id()), "reps")
    members = stored.put(full.select("doc_id", "n_shingles", *of_set).join(reps.select("rep", *of_set), of_set).drop(*of_set), "members")
    several_texts = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).where("a < most").select("doc_id", "a")
    same_id = stored.put(members.join(several_texts, "doc_id").where("rep > a").select("a", F.col("rep").alias("b")).distinct(), "same_id")
    rest = stored.put(sig.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles"), "rest")
    stored.drop(sig)

    banded = reps.select("rep", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("band", "least")
    buckets = stored.put(banded.join(shared, "band"), "buckets")
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("odd").alias(f"odd_{c}"), F.col("n_shingles").alias(f"n_{c}"))
    star = buckets.where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    likely = stored.put(star.join(side("a"), "a").join(side("b"), "b").where(_sketches_allow(percent)).select("a", "b"), "likely")
    links = verified(likely, reps, known, k, percent, stored)
    label = stored.put(components(links.unionByName(same_id), stored), "components")
    cluster = stored.put(components(likely, stored), "clusters")
    inner = within_clusters(cluster, label, reps, known, k, percent, stored)
    label = _extended(label, inner, stored)

    # members of a bucket outside the least one's component, against members of other components and clusters
    named = (
        buckets.join(label.withColumnRenamed("id", "rep"), "rep", "left")
        .join(cluster.select(F.col("id").alias("rep"), F.col("component").alias("cluster")), "rep", "left")
        .select("band", "rep", "least", F.coalesce("component", "rep").alias("component"), F.coalesce("cluster", "rep").alias("cluster"))
    )
    named = stored.put(named, "named")
    mixed = named.groupBy("band").agg(F.min("cluster").alias("c0"), F.max("cluster").alias("c1"), F.count("*").alias("n")).where("c0 <> c1")
    mixed = mixed.select("band", F.expr(f"(n + {BAND_DOCS - 1}) div {BAND_DOCS}").alias("parts"))
    several = stored.put(named.join(mixed, "band").join(reps.select("rep", "odd", "n_shingles"), "rep"), "several")
    heads = several.where("rep = least").select("band", F.col("component").alias("head"))
    outside = several.join(heads, "band").where("component <> head")
    outside = outside.select(
        "band", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.col("rep").alias("a"), F.col("component").alias("p"), F.col("cluster").alias("q"), F.col("odd").alias("odd_a"), F.col("n_shingles").alias("n_a")
    )
    others = several.where("rep <> least").select(
        "band", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part"), F.col("rep").alias("b"), "component", "cluster", F.col("odd").alias("odd_b"), F.col("n_shingles").alias("n_b")
    )
    crossed = outside.join(others, ["band", "part"]).where((F.col("p") != F.col("component")) & (F.col("q") != F.col("cluster")) & _sketches_allow(percent))
    cross = stored.put(crossed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cross")
    more = verified(cross, reps, known, k, percent, stored)
    stored.drop(buckets, named, several)
    both = _extended(label, more, stored)

    # grouped minima are stored before they are joined, so that a hot component or class can be split where it is joined
    linked = stored.put(reps.select("rep", "least").join(both.withColumnRenamed("id", "rep"), "rep"), "linked")
    smallest = stored.put(linked.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    named_by = stored.put(linked.join(smallest, "component").select("rep", F.col("component_id").alias("joined")), "ids")
    alone = reps.select("rep", "least").join(named_by, "rep", "left").select("rep", F.coalesce("joined", "least").alias("component_id"))
    found = members.join(stored.put(alone, "component_ids"), "rep").select("doc_id", "n_shingles", "component_id")
    out = found.unionByName(rest.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
