"""Toxicity by class-conditional Kneser-Ney models.

A word is read in pieces: its first four bytes, the next two, two more, and the rest; a cut within a letter moves behind it.
Two models, one of toxic and one of ordinary documents, give the probability of each piece after the word's beginning. What
discounting takes away goes to shared continuation counts (after how many beginnings a piece stands, in either class). So
words that were never seen are judged by how they begin, and rare ones hardly count. A text's passages are compared by their
length-normalised log-likelihoods under both models; the most toxic short and long passage and the whole text give a
calibrated score.

The model is two tables: the log ratio of each pair of beginning and piece that the discount leaves, and of each beginning, for
all other pieces after it (there the shared counts cancel out). It grows with the vocabulary. Up to MODEL_ROWS rows it goes
to the tasks by broadcast; a larger one is joined with the distinct pairs of blocks of texts. Arrays of about 30 bytes for
each byte of a text are held at once, of PART_BYTES of text or the longest single one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SYMBOLS, Stored, arrow_map, run_hashes, running, sliced, text_bytes, word_spans

#: Bits of a beginning's and a piece's hash; the rows of a model that is broadcast (12 bytes each, 96 MB).
HASHED, MODEL_ROWS = 31, 8_000_000
#: Where a word is cut; words in a short and a long passage; bytes of text at once; bytes of text in a block.
CUTS, PASSAGES, PART_BYTES, BLOCK_BYTES = (0, 4, 6, 8), (4, 64), 8 << 20, 32 << 20
#: The discount (estimates from counts of counts did worse, see the README); weight of a piece in the shared distribution besides its count; least probability.
DISCOUNT, UNSEEN, LEAST = 3.0, 0.5, 1e-12
#: Labelled rows at most for the calibration of the score (three weights and a constant), the first by hash of their id.
CALIBRATION_ROWS = 50_000
CLASSES = ("toxic", "ordinary")


def word_pairs(texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each cut (index of the words that reach it, number of the cut, beginning and piece in one long); and the row starts of the words."""
    raw, at = text_bytes(texts)
    if not len(raw):
        return [], np.zeros(len(at), np.int64)
    raw = LOWER[raw]
    s, e = word_spans(raw, at, SYMBOLS)
    sums, out, shift = running(raw), [], np.uint64(64 - HASHED)
    starts = []
    for cut in CUTS:
        start = np.minimum(s + cut, e + 1)
        for _ in range(3):
            inside = np.minimum(start, len(raw) - 1)
            start = start + ((start <= e) & (raw[inside] & 0xC0 == 0x80))
        starts.append(start if cut else s)
    starts.append(e + 1)
    for i, (start, end) in enumerate(zip(starts, starts[1:])):
        reach = np.flatnonzero((start <= e) & (end > start))
        first, last = start[reach], end[reach] - 1
        context = run_hashes(raw, s[reach], first - 1, sums) >> shift if CUTS[i] else np.zeros(len(reach), np.uint64)
        piece = run_hashes(raw, first, last, sums) >> shift
        out.append((reach, ((np.uint64(i) << np.uint64(2 * HASHED)) | (context << np.uint64(HASHED)) | piece).view(np.int64)))
    return out, np.searchsorted(s, at)


def count_pairs(rows: DataFrame) -> DataFrame:
    """(pair, toxic, ordinary): how often a pair stands in the documents of each class. rows: text, toxic (0 or 1)."""

    def make():
        def run(batch: pa.RecordBatch):
            for part in sliced(batch, "text", PART_BYTES):
                cuts, at = word_pairs(part.column("text"))
                bad_word = np.repeat(part.column("toxic").to_numpy(zero_copy_only=False) == 1, np.diff(at))
                pairs = np.concatenate([p for _, p in cuts]) if cuts else np.zeros(0, np.int64)
                bad = np.concatenate([bad_word[i] for i, _ in cuts]) if cuts else pairs
                order = np.argsort(pairs, kind="stable")
                pairs, bad = pairs[order], bad[order].astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else pairs
                toxic = np.add.reduceat(bad, first) if len(first) else first
                both = np.diff(np.append(first, len(pairs)))
                yield pa.RecordBatch.from_arrays([pa.array(pairs[first]), pa.array(toxic), pa.array(both - toxic)], ["pair", "toxic", "ordinary"])

        return run

    return arrow_map(rows, make, "pair long, toxic long, ordinary long").groupBy("pair").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def train(rows: DataFrame, stored: Stored) -> tuple[DataFrame, DataFrame]:
    """The model from labelled rows (text, toxic): (pair, ratio) and (context, ratio), log P(toxic) - log P(ordinary).

    A pair that the discount takes away in both classes has its beginning's ratio, and so has one that was never seen, as the
    shared counts cancel out: neither has a row. Beginnings whose ratio is 0 have none either. Four numbers of pairs and
    pieces come to the driver, one for each cut.
    """
    context, cut = F.expr(f"shiftrightunsigned(pair, {HASHED})"), F.expr(f"cast(shiftrightunsigned(pair, {2 * HASHED}) as int)")
    pairs = stored.put(count_pairs(rows).withColumns({"context": context, "cut": cut, "piece": F.expr(f"pair & {(1 << HASHED) - 1}L")}), "pairs")
    over = {c: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) for c in CLASSES}
    n, left = (lambda c: F.col(f"n_{c}")), (lambda c: F.col(f"left_{c}"))
    own = pairs.groupBy("cut", "context").agg(*(F.sum(c).alias(f"n_{c}") for c in CLASSES), *(F.sum(over[c]).alias(f"over_{c}") for c in CLASSES))
    own = own.select("cut", "context", *(n(c) for c in CLASSES), *(F.when(n(c) > 0, (n(c) - F.col(f"over_{c}")) / n(c)).otherwise(1.0).alias(f"left_{c}") for c in CLASSES))
    contexts = stored.put(own, "contexts")
    follow = stored.put(pairs.groupBy("cut", "piece").agg(F.count("*").alias("follows")), "pieces")
    mass = {r["cut"]: r["pairs"] + UNSEEN * (r["pieces"] + 1) for r in follow.groupBy("cut").agg(F.sum("follows").alias("pairs"), F.count("*").alias("pieces")).collect()}
    mass = F.array(*(F.lit(float(mass.get(i, 1))) for i in range(len(CUTS))))[F.col("cut")]
    kept = pairs.where(" or ".join(f"{c} > {DISCOUNT}" for c in CLASSES))
    # the first pieces of all words have one beginning, the empty one: its row goes to them
    first = kept.where("cut = 0").join(F.broadcast(contexts.where("cut = 0").drop("cut")), "context")
    seen = first.unionByName(kept.where("cut > 0").join(contexts.where("cut > 0").drop("cut"), "context")).join(follow, ["cut", "piece"])
    share = (F.col("follows") + UNSEEN) / mass
    p = {c: over[c] / F.greatest(n(c), F.lit(1)) + left(c) * share for c in CLASSES}
    ratio = lambda a, b: (F.log(F.greatest(a, F.lit(LEAST))) - F.log(F.greatest(b, F.lit(LEAST)))).cast("float").alias("ratio")
    model = stored.put(seen.select("pair", ratio(p["toxic"], p["ordinary"])), "model"), contexts.select("context", ratio(left("toxic"), left("ordinary"))).where("ratio <> 0")
    stored.drop(pairs, follow)
    return model


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of the wanted keys, whether they are there); keys ascend."""
    if not len(keys):
        return np.zeros(len(wanted), np.float32), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return values[i], keys[i] == wanted


def held_ratios(model: dict[str, np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """A look-up of pairs in a model at hand: the pair's ratio, else its beginning's, else 0."""

    def look(pairs: np.ndarray) -> np.ndarray:
        own, there = _found(model["pair"], model["pair_ratio"], pairs)
        begun, known = _found(model["context"], model["context_ratio"], (pairs.view(np.uint64) >> np.uint64(HASHED)).view(np.int64))
        return np.where(there, own, np.where(known, begun, np.float32(0)))

    return look


def log_ratios(cuts: list[tuple[np.ndarray, np.ndarray]], n_words: int, look: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """log P(word | toxic) - log P(word | ordinary) of each word."""
    out = np.zeros(n_words)
    for reach, pairs in cuts:
        distinct, back = np.unique(pairs, return_inverse=True)
        out[reach] += look(distinct)[back]
    return out


def passages(texts: pa.Array, look: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """Mean log ratio of each text's most toxic passages of PASSAGES words, and of the whole text; 0 for no words."""
    cuts, at = word_pairs(texts)
    n = np.diff(at)
    most, whole, some = [np.zeros(len(n)) for _ in PASSAGES], np.zeros(len(n)), np.flatnonzero(n)
    if len(some):
        sums = np.concatenate([[0.0], np.cumsum(log_ratios(cuts, int(at[-1]), look))])
        whole[some] = ((sums[at[1:]] - sums[at[:-1]]) / np.maximum(n, 1))[some]
        index, row_start, row_size = np.arange(at[-1]), np.repeat(at[:-1], n), np.repeat(n, n)
        for out, size in zip(most, PASSAGES):
            start, full = np.maximum(index - size + 1, row_start), np.minimum(size, row_size)
            means = np.where(index - start + 1 == full, (sums[index + 1] - sums[start]) / full, -np.inf)
            out[some] = np.maximum.reduceat(means, at[:-1][some])
    return [x.round(6) for x in (*most, whole)]


FEATURES = ["short", "long", "whole"]


def compare(df: DataFrame, model: tuple[DataFrame, DataFrame], stored: Stored, text: str = "text", key: str = "doc_id", model_rows: int = MODEL_ROWS) -> DataFrame:
    """(key, short, long, whole): passages() of every row. A model of more than `model_rows` rows is joined, not broadcast."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{x} double" for x in FEATURES)
    if sum(t.count() for t in model) > model_rows:
        return _compare_joined(rows, model, stored, schema).withColumnRenamed("key", key)
    arrays = {}
    for name, table in zip(("pair", "context"), model):
        got = table.toArrow()
        keys, values = got.column(name).to_numpy(), got.column("ratio").to_numpy()
        order = np.argsort(keys)
        arrays[name], arrays[f"{name}_ratio"] = keys[order], values[order]
    held = df.sparkSession.sparkContext.broadcast(arrays)

    def make():
        look = held_ratios(held.value)

        def run(batch: pa.RecordBatch):
            for part in sliced(batch, "text", PART_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(x) for x in passages(part.column("text"), look))], ["key", *FEATURES])

        return run

    return arrow_map(rows, make, schema).withColumnRenamed("key", key)


def _compare_joined(rows: DataFrame, model: tuple[DataFrame, DataFrame], stored: Stored, schema: str) -> DataFrame:
    """The same for a model of any size: blocks of about BLOCK_BYTES of text (rows by hash of their number) ask for the ratios of
    their distinct pairs, which two joins find, and meet them again. Texts are stored once and shuffled twice."""
    blocks = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES + 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    dealt = stored.put(dealt.repartition("block").sortWithinPartitions("block"), "dealt")

    def make():
        def run(batch: pa.RecordBatch):
            for part in sliced(batch, "text", PART_BYTES):
                cuts, at = word_pairs(part.column("text"))
                of_word = np.repeat(part.column("block").to_numpy(), np.diff(at))
                pairs, of = (np.concatenate(x) for x in zip(*((p, of_word[i]) for i, p in cuts))) if cuts else (np.zeros(0, np.int64),) * 2
                for block in np.unique(of):
                    own = np.unique(pairs[of == block])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(own)], ["block", "pair"])

        return run

    asked = arrow_map(dealt.select("block", "text"), make, "block long, pair long").distinct()
    known, contexts = model[0].withColumnRenamed("ratio", "own"), model[1].withColumnRenamed("ratio", "begun")
    told = asked.join(known, "pair", "left").withColumn("context", F.expr(f"shiftrightunsigned(pair, {HASHED})"))
    whole = contexts.where(f"shiftrightunsigned(context, {HASHED}) = 0")
    told = told.where(f"shiftrightunsigned(pair, {2 * HASHED}) = 0").join(F.broadcast(whole), "context", "left").unionByName(
        told.where(f"shiftrightunsigned(pair, {2 * HASHED}) <> 0").join(contexts, "context", "left")
    )
    told = told.select("block", "pair", F.coalesce("own", "begun").alias("ratio")).where("ratio <> 0")

    def meet(texts: pa.Table, ratios: pa.Table) -> pa.Table:
        order = np.argsort(ratios.column("pair").to_numpy())
        keys, values = ratios.column("pair").to_numpy()[order], ratios.column("ratio").to_numpy()[order]

        def look(pairs: np.ndarray) -> np.ndarray:
            own, there = _found(keys, values, pairs)
            return np.where(there, own, np.float32(0))

        out = []
        for batch in texts.combine_chunks().to_batches():
            for part in sliced(batch, "text", PART_BYTES):
                out.append(pa.Table.from_arrays([part.column("key"), *(pa.array(x) for x in passages(part.column("text"), look))], ["key", *FEATURES]))
        return pa.concat_tables(out)

    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(meet, schema)


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and constant of a logistic regression with a small ridge (Newton's method)."""
    if not len(y) or y.min() == y.max():
        return np.append(np.full(x.shape[1], 1.0), -2.0)
    a, w = np.column_stack([x, np.ones(len(y))]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([1e-2] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", folds: int = 5, held: int = 0, broadcast_labels: int = 2_000_000, model_rows: int = MODEL_ROWS) -> DataFrame:
    """(key, held_out, score, predicted) of every whole text; labels: (key, toxic), learnt from outside the held-out fold only.

    A row is held out if crc32(key as text) mod `folds` is `held`; null keys are, too. Where a key has several labels, 1
    wins; null labels count as none. Empty and null texts score as a text that speaks for neither class. Repeated rows
    stay; other columns are left out. Labels go to all executors up to `broadcast_labels` rows, else by a shuffle.
    """
    stored = Stored(docs.sparkSession)
    outside = F.crc32(F.col(key).cast("string")) % folds != held
    taught = labels.where(outside).groupBy(key).agg(F.max("toxic").alias("toxic")).where("toxic is not null")
    taught = stored.put(taught, "labels")
    small = taught.count() <= broadcast_labels
    rows = docs.where(outside & F.col(text).isNotNull()).select(key, F.col(text).alias("text")).join(F.broadcast(taught) if small else taught, key)
    model = train(rows.select("text", "toxic"), stored)
    compared = stored.put(compare(docs, model, stored, text, key, model_rows), "compared")
    sample = compared.join(taught, key).orderBy(F.xxhash64(key), key, *FEATURES).limit(CALIBRATION_ROWS).select(*FEATURES, "toxic").toPandas()
    w = calibrate(sample[FEATURES].to_numpy(float), (sample["toxic"] == 1).to_numpy(float))
    odds = sum((F.lit(float(a)) * F.col(c) for a, c in zip(w, FEATURES)), F.lit(float(w[3])))
    score = F.round(1 / (1 + F.exp(-odds)), 6)
    return compared.select(
        key, F.coalesce(F.crc32(F.col(key).cast("string")) % folds == held, F.lit(True)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted")
    )
