"""Language profiles against their definition, letter by letter."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodewatch.llm import langid


def slot(c):
    if not c.isalpha():
        return 0
    return ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % (langid.SLOTS - 27)


def plain_vector(text):
    """Each letter, and the first other character after one, bound with the two kept before it; bundled and made a unit."""
    letters = np.random.default_rng(7).choice(np.array([-1, 1], np.int8), (langid.SLOTS, langid.DIMENSIONS)).astype(float)
    kept, out, was = [0, 0], np.zeros(langid.DIMENSIONS), 0
    for c in (text or "").lower():
        s = slot(c)
        if s or was:
            kept.append(s)
            out += np.roll(letters[kept[-3]], 2) * np.roll(letters[kept[-2]], 1) * letters[s]
        was = s
    norm = np.linalg.norm(out)
    return out / norm if norm else out


TEXTS = ["", None, "a", " a", "a ", "12 34", "The QUICK, brown fox -- jumps!", "größe ß İ ñandú élève", "漢字かな", "x" * 500, "ab" * 3 + "\n\n\tcd"]


def test_vectors_are_those_of_the_definition():
    got, there = langid.document_vectors(pa.array(TEXTS))
    for text, v, has in zip(TEXTS, got, there):
        assert np.allclose(v, plain_vector(text), atol=1e-6) and has == any(c.isalpha() for c in (text or "").lower())


def test_predictions_are_those_of_the_definition(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    vectors = {i: plain_vector(t) for i, t, _ in rows}
    sums = defaultdict(lambda: np.zeros(langid.DIMENSIONS))
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1 and lang is not None and t is not None:
            sums[lang] += np.rint(vectors[i] * langid.GRAIN)
    names = sorted(sums)
    unit = np.array([sums[k] / np.linalg.norm(sums[k]) for k in names])
    ways = unit - unit.mean(0)
    ways /= np.linalg.norm(ways, axis=1, keepdims=True)
    texts = {i: t for i, t, _ in rows}
    for r in langid.identify_languages(docs).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        off = vectors[r["doc_id"]] - unit.mean(0)
        cosine = ways @ (off / max(np.linalg.norm(off), 1e-12))
        if not any(c.isalpha() for c in texts[r["doc_id"]] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        assert r["score"] == pytest.approx((1 + cosine.max()) / 2, abs=1e-4)
        assert r["lang_pred"] == names[cosine.argmax()] or cosine.max() - cosine[names.index(r["lang_pred"])] < 1e-4
