"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A three-letter sequence is bound by multiplying its letters' vectors, each
permuted (rotated) by its place; a text is the bundle (sum) of its sequences; a language is the bundle of its documents'
directions. A document gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, sliced

#: Vector length; letter slots (a-z have their own, other letters share the rest by code point); bytes of text at once.
DIMENSIONS, SLOTS, PART_BYTES = 512, 128, 2 << 20
#: Prototypes are whole numbers of this fraction, so their sums don't depend on order.
GRAIN = 1 << 20


@lru_cache(maxsize=1)
def _letter_slots() -> np.ndarray:
    """Slot of every code point, 0 if it isn't a letter."""
    alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    code = np.arange(0x110000)
    slot = np.where((code >= 97) & (code <= 122), code - 96, 27 + code % (SLOTS - 27))
    return np.where(alpha, slot, 0).astype(np.int32)


@lru_cache(maxsize=1)
def _letter_vectors() -> np.ndarray:
    return np.random.default_rng(7).choice(np.array([-1, 1], np.int8), (SLOTS, DIMENSIONS))


def document_vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(unit vector of each text, whether it has a letter). Text without letters, and null: zeros."""
    lowered = [t.lower() for t in pc.fill_null(texts, "").to_pylist()]
    size = np.fromiter(map(len, lowered), np.int64, len(lowered))
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    out, any_letter = np.zeros((len(lowered), DIMENSIONS), np.float32), np.zeros(len(lowered), bool)
    row = np.repeat(np.arange(len(lowered)), size)
    slot = _letter_slots()[codes]
    keep = slot > 0  # a run of other characters becomes one blank, and each text ends in one
    keep[1:] |= (slot[:-1] > 0) & (row[1:] == row[:-1])
    slot, row = slot[keep], row[keep]
    if not len(slot):
        return out, any_letter
    any_letter[row[slot > 0]] = True
    before = np.concatenate([[0], slot[:-1]])
    before[1:][row[1:] != row[:-1]] = 0
    last = np.concatenate([[0], before[:-1]])
    last[1:][row[1:] != row[:-1]] = 0
    grams = (last * SLOTS + before) * SLOTS + slot
    there = np.zeros(SLOTS**3, bool)
    there[grams] = True
    own = np.flatnonzero(there)
    place = np.zeros(SLOTS**3, np.int32)
    place[own] = np.arange(len(own))
    letters = _letter_vectors()
    bound = np.roll(letters, 2, 1)[own // SLOTS**2] * np.roll(letters, 1, 1)[own // SLOTS % SLOTS] * letters[own % SLOTS]
    bound = bound.astype(np.float32)
    place = place[grams]
    step = max(1, (32 << 20) // (4 * len(own)))  # rows whose counts fit in 32 MB
    for a in range(0, len(lowered), step):
        take = slice(*np.searchsorted(row, [a, a + step]))
        n = min(step, len(lowered) - a)
        counts = np.bincount((row[take] - a) * len(own) + place[take], minlength=n * len(own)).reshape(n, -1).astype(np.float32)
        out[a : a + n] = counts @ bound
    norm = np.sqrt((out.astype(np.float64) ** 2).sum(1, keepdims=True))
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32), any_letter


def train_prototypes(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Language -> prototype, over all rows with a text and a language. One row for each language comes to the driver."""

    def make():
        def run(batch: pa.RecordBatch):
            for part in sliced(batch, "text", PART_BYTES):
                vectors, _ = document_vectors(part.column("text"))
                langs = part.column("lang").dictionary_encode()
                which = langs.indices.to_numpy(zero_copy_only=False)
                whole = np.rint(vectors.astype(np.float64) * GRAIN).astype(np.int64)
                sums = [whole[which == k].sum(0) for k in range(len(langs.dictionary))]
                yield pa.RecordBatch.from_arrays([langs.dictionary.cast(pa.string()), pa.array([s.tolist() for s in sums], pa.list_(pa.int64()))], ["lang", "total"])

        return run

    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    parts = arrow_map(rows, make, "lang string, total array<bigint>")
    total = parts.select("lang", F.posexplode("total")).groupBy("lang", "pos").agg(F.sum("col").alias("n"))
    found = total.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("v")).collect()
    return {r["lang"]: np.array([x["n"] for x in r["v"]], np.float64) for r in found}


def predict_language(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", key: str = "doc_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, extra columns, lang_pred, score): the closest prototype and its cosine from 0 to 1, both about the prototypes' mean.

    A null text, or one without letters, gives `und` and 0, as does an empty set of prototypes. Ties go to the first
    language by name. Repeated rows stay; other columns are left out.
    """
    names = sorted(k for k, v in prototypes.items() if np.any(v))
    unit = np.array([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]) if names else np.zeros((0, DIMENSIONS))
    middle = unit.mean(0) if len(names) > 1 else np.zeros(DIMENSIONS)
    ways = unit - middle
    ways = (ways / np.maximum(np.linalg.norm(ways, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    middle = middle.astype(np.float32)

    def make():
        def run(batch: pa.RecordBatch):
            for part in sliced(batch, "text", PART_BYTES):
                vectors, there = document_vectors(part.column("text"))
                off = vectors - middle
                off /= np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-12)
                if names:
                    cosine = off @ ways.T
                    best = cosine.argmax(1)
                    score = np.where(there, np.clip((1 + cosine[np.arange(len(best)), best]) / 2, 0, 1), 0.0)
                    said = [names[b] if t else "und" for b, t in zip(best, there)]
                else:
                    score, said = np.zeros(len(there)), ["und"] * len(there)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(said, pa.string()), pa.array(score.round(6).astype(np.float64))], ["key", "lang_pred", "score"])

        return run

    kind = df.schema[key].dataType.simpleString()
    out = arrow_map(df.select(F.col(key).alias("key"), F.col(text).alias("text")), make, f"key {kind}, lang_pred string, score double")
    return out.withColumnRenamed("key", key)


def identify_languages(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", folds: int = 3, held: int = 1) -> DataFrame:
    """(key, held_out, lang_pred, score): prototypes from the rows with a language outside the held-out fold, applied to every row.

    A row is held out if crc32(key as text) mod `folds` is `held`; one with a null key is, too.
    """
    fold = F.crc32(F.col(key).cast("string")) % folds
    prototypes = train_prototypes(docs.where(fold != held), text, lang)
    out = predict_language(docs, prototypes, text, key)
    return out.select(key, F.coalesce(F.crc32(F.col(key).cast("string")) % folds == held, F.lit(True)).alias("held_out"), "lang_pred", "score")
