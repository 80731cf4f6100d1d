"""Operators on training data against plain versions, and on odd rows: nulls, empty and long texts, ties, copies, clashing names."""

import bisect
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodewatch.llm import common, decontaminate, dedup, embeddings, langid, licenses, packing, pii, quality, tokens, toxicity
from lodewatch.llm.queries import QUERIES, tokenizer

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "One two three."), (4, "One two three."), (None, "one word"), (5, "x" * 50_000), (6, "é ß ñ 漢字 😀 <|endoftext|> it's"), (7, "a b " * 9_000)]


def documents(spark, rows=ODD):
    """With extra columns under names that the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    extra = ["key", "kind", "row", "rep", "length", "n_words", "offset", "bands", "score", "text_hash", "a", "component", "at"]
    return df.withColumns({c: F.lit(c) for c in extra}).withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")})


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark).where("false")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_token_counts(spark, docs, empty):
    library = tokens._library(tokenizer("byte_bpe_50k.json"))
    both = documents(spark).select("doc_id", "text").union(docs.select("doc_id", "text"))
    got = tokens.count_tokens(documents(spark), tokenizer("byte_bpe_50k.json")).union(tokens.count_tokens(docs, tokenizer("byte_bpe_50k.json"))).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in both.collect()]
    assert sorted(map(str, [(r[0], r[1], r[2]) for r in got])) == sorted(map(str, want))
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert tokens.count_tokens(empty, tokenizer("byte_bpe_50k.json")).count() == 0
    text = "some words, and more " * 500
    assert "".join(tokens.pieces(text, 100)) == text and len(tokens.pieces(text, 100)) > 10


def test_word_ids_are_the_librarys():
    path = tokenizer("word_bpe_49k.json")
    library, own = tokens._library(path), tokens.WordIds(path)
    texts = ["".join(map(chr, range(0x250))), " ".join(map(chr, range(0x250))), "I'm 'S <|endoftext|>x", "foo_bar __!! x212 ÀÉÖØÞß", "漢字 é", "", "a\x1cb", *(f"a{chr(c)}b {chr(c)}{chr(c)}" for c in range(256))]
    assert [x.tolist() for x in own.encode(pa.array(texts))] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_packing(spark, empty):
    path = tokenizer("word_bpe_49k.json")
    rows = packing.pack_documents(documents(spark), path, 64).collect()
    library = tokens._library(path)
    for i in (1, 2, 3):
        assert [(r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i] == [(1, zlib.crc32(b"\0\0\0\0"))]
    ids = [*library.encode("a b " * 9_000, add_special_tokens=False).ids, 0]
    own = sorted((r for r in rows if r["doc_id"] == 7), key=lambda r: r["piece"])
    assert [r["start"] for r in own] == list(range(0, len(ids), 64)) and sum(r["length"] for r in own) == len(ids)
    assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in own)
    for s in {r["sequence_id"] for r in rows}:
        place = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == place
            place += r["length"]
        assert place <= 64
    assert packing.pack_documents(empty, path).count() == 0


def packed(spark, lengths, size):
    pieces = common.Stored(spark).put(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long"), "pieces")
    rows = packing.pack_pieces(pieces, size, common.Stored(spark)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(lengths)))
    used = {}
    for r in rows:
        assert r["length"] == lengths[r["doc_id"]]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in used.values():
        items.sort()
        assert items[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(items, items[1:])) and items[-1][0] + items[-1][1] <= size
    return len(used)


def best_fit_decreasing(lengths, size):
    gaps, bins = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, length)
        gap = gaps.pop(at) if at < len(gaps) else size
        bins += gap == size
        if gap > length:
            bisect.insort(gaps, gap - length)
    return bins


@pytest.mark.parametrize("kind", ["hot", "alike"])
def test_rounds_pack_as_best_fit_decreasing_does(spark, kind, monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(packing, "LEAST_PART", 50)  # runs are split
    lengths = {"hot": np.where(rng.random(1500) < 0.4, 100, rng.geometric(0.05, 1500).clip(1, 100)), "alike": np.full(700, 15)}[kind].tolist()
    assert packed(spark, lengths, 100) <= 1.02 * best_fit_decreasing(lengths, 100) + 1


def test_a_sweep_serves_the_longest_that_fit(spark):
    rows = lambda xs, kind: spark.createDataFrame(xs, kind)
    got = packing.sweep(rows([(5, 1), (8, 2), (9, 1)], "length int, n long"), rows([(4, 0, 9), (8, 0, 1), (9, 0, 1), (20, 0, 1)], "gap int, part int, n long"), 10).collect()
    served = {r["length"]: r["used"] for r in got if r["side"] == 0}
    assert served == {5: 1, 8: 2, 9: 1} and {r["gap"]: (r["first"], r["used"]) for r in got if r["side"] == 1} == {8: (0, 1), 9: (1, 1), 20: (2, 2)}
    few = packing.sweep(rows([(5, 1), (8, 2), (9, 1)], "length int, n long"), rows([(8, 0, 1), (9, 0, 1)], "gap int, part int, n long"), 10).collect()
    assert {r["length"]: r["used"] for r in few if r["side"] == 0} == {8: 1, 9: 1}


def test_near_duplicates(spark, empty):
    base = [f"w{i}" for i in range(60)]
    near = base[:30] + ["new"] + base[31:]
    far = base[:15] + [f"z{i}" for i in range(45)]
    rows = ODD + [(10, " ".join(base)), (11, " ".join(base).upper()), (12, " ".join(near)), (13, " ".join(far)), (14, "one WORD"), (15, "one word")]
    got = {}
    for r in dedup.near_duplicates(documents(spark, rows), k=4).collect():
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert got[1] == [(0, 1, True)] and got[2] == [(0, 2, True)] and got[3] == [(0, 3, True)]
    assert got[4] == [(1, 4, True)] * 2 and got[None][0][1:] == (None, True)
    assert [got[i][0][1] for i in (10, 11, 12, 13, 14, 15)] == [10, 10, 10, 13, 14, 14]
    assert dedup.near_duplicates(empty).count() == 0


def test_one_id_with_several_texts_loses_no_link(spark):
    a, b, c = ([f"{x}{i}" for i in range(40)] for x in "abc")
    near = lambda words: " ".join(words[:39] + ["other"])
    rows = [(7, " ".join(a)), (7, " ".join(b)), (2, near(b)), (9, near(a)), (7, " ".join(a)), (7, ""), (4, " ".join(c)), (4, " ".join(c))]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in dedup.near_duplicates(documents(spark, rows), k=4).collect())
    assert got == [(2, 37, 2, True), (4, 37, 4, True), (4, 37, 4, True), (7, 0, 7, True), *[(7, 37, 2, False)] * 3, (9, 37, 2, False)]
    text = spark.createDataFrame([(str(i), t) for i, t in rows], "doc_id string, text string")
    assert {(r["doc_id"], r["component_id"]) for r in dedup.near_duplicates(text, k=4).collect() if r["n_shingles"]} == {(x, "4" if x == "4" else "2") for x in "2479"}


def test_many_near_copies_are_grouped_as_by_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(700):
        w = list(base)
        for p in rng.choice(120, rng.integers(0, 12), replace=False):
            w[p] = f"e{i}-{p}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[j : j + 4]) for j in range(117)} for _, t in rows]
    root = list(range(700))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(700):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["doc_id"]: r["component_id"] for r in dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    assert got == {i: find(i) for i in range(700)}


@pytest.mark.parametrize("many", [1_000_000, 0])
def test_components(spark, many, monkeypatch):
    monkeypatch.setattr(common, "MANY_EDGES", many)
    stored = common.Stored(spark)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 100)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(pairs, "a long, b long"), stored).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 100}
    assert common.components(spark.createDataFrame([], "a long, b long"), stored).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x[150:] = x[:150] + rng.normal(size=(150, 8)) * 0.15
    rows = [(i, [float(v) for v in r], i % 3 if i % 50 else None) for i, r in enumerate(x)]
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 8, 1), (403, [float("nan")] * 8, 1), (404, [1.0, None] + [0.0] * 6, 1), (405, rows[1][1], 1), (406, [2 * v for v in rows[1][1]], 1), (407, [1.0] * 5, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("unit", F.lit("x"))
    links = {i: set() for i, _, _ in rows}
    good = [(i, np.array(v), k) for i, v, k in rows if k is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for i, v, k in good:
        for j, w, m in good:
            if i != j and k == m and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.98:
                links[i].add(j)
    for cell in (embeddings.CELL_ROWS, 20):
        embeddings.CELL_ROWS, before = cell, embeddings.CELL_ROWS
        got = {r["vec_id"]: r for r in embeddings.near_vectors(df).collect()}
        embeddings.CELL_ROWS = before
        assert {i: r["n_links"] for i, r in got.items()} == {i: len(s) for i, s in links.items()}
        for i in links:
            seen, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            assert got[i]["component_id"] == min(seen) and got[i]["kept"] == (min(seen) == i)
    assert embeddings.near_vectors(df.where("false")).count() == 0
    twice = spark.createDataFrame([("a", [1.0, 0.0], 1), ("a", [0.0, 1.0], 1), ("b", [0.0, 1.001], 1), ("c", [1.0, 1.0], 1)], "vec_id string, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_vectors(twice).collect())
    assert got == [("a", 0, "a"), ("a", 1, "a"), ("b", 1, "a"), ("c", 0, "c")]


def test_leaks(spark, sf, docs):
    item = "the quick brown fox jumps over the lazy dog near the river bank at noon today while birds sing"
    near = item.replace("noon", "dusk")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny item"), (5, item)], "item_id long, text string")
    rows = ODD + [(20, f"intro words here {item.upper()} and a tail"), (21, f"pre {near.replace('at dusk', 'at noon')} post"), (22, "the quick brown fox jumps high"), (23, "a TINY, item!"), (24, item[:60])]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(documents(spark, rows), bench).collect()}
    assert set(got) == {(20, 1), (20, 5), (21, 1), (21, 5)}
    assert got[20, 1]["first_word"] == 3 and got[20, 1]["similarity"] == 1.0
    left = decontaminate.without_leaks(documents(spark, rows), bench)
    assert left.columns == documents(spark, rows).columns and left.count() == len(rows) - 2
    assert decontaminate.find_leaks(documents(spark).where("false"), bench).count() == 0 and decontaminate.find_leaks(documents(spark), bench.where("false")).count() == 0
    assert decontaminate.without_leaks(documents(spark), bench.where("false")).count() == len(ODD)
    # every document of the tables, by brute force over all windows with weights
    items = [(r["item_id"], shingle_list(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i in leaked(shingle_list(r["text"]), items)}
    assert {(r["doc_id"], r["item_id"]) for r in QUERIES["op2_decontamination"](spark, sf).collect()} == want


def shingle_list(text, k=5):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def leaked(own, items, least=0.8):
    """Items that a window of their size is similar to, with weights, and how similar the best one is."""
    out, every = {}, set(own)
    for i, item in items:
        if not every & set(item):
            continue
        c, n = Counter(item), min(len(item), len(own))
        for a in range(len(own) - n + 1):
            both = sum((Counter(own[a : a + n]) & c).values())
            s = both / (n + len(item) - both)
            if s >= max(least, out.get(i, 0)):
                out[i] = s
    return out


def test_all_windows_are_looked_at(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    items = [(i, [words[j] for j in rng.integers(0, 400 if i % 3 else 6, rng.integers(30, 60))]) for i in range(60)]
    rows = []
    for i, (_, w) in enumerate(items * 6):
        w = list(w)
        half = len(w) // 2
        if i % 4 == 0:
            w = w[half:] + w[:half]  # the halves swapped
        elif i % 4 == 1:
            w[half] = "other"
        elif i % 4 == 2:
            del w[half]
        rows.append((i, " ".join([*rng.choice(words, 20), *w, *rng.choice(words, 30)])))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_leaks(docs, bench).collect()}
    plain = [(i, shingle_list(" ".join(w))) for i, w in items]
    want = {(d, i): s for d, t in rows for i, s in leaked(shingle_list(t), plain).items()}
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want) and sum(d % 4 == 0 for d, _ in want) > 40
    assert all(got[x] <= want[x] + 1e-9 for x in got) and sum(abs(got[x] - want[x]) < 1e-9 for x in got) >= 0.99 * len(got)


def test_the_index_finds_all_within_the_radius_and_little_else():
    rng = np.random.default_rng(4)
    values = [rng.integers(0, 1 << 63, 40, dtype=np.uint64) for _ in range(6000)]
    many, few = decontaminate.Sized(44, list(range(6000)), values), decontaminate.Sized(44, list(range(50)), values[:50])
    asked = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    for j in range(40):  # near some of the items
        asked[j] = many.prints[j] ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, j % 20, replace=False).astype(np.uint64), initial=np.uint64(0))
    for sized in (many, few):
        w, i, reached = sized.near(asked)
        assert {*zip(w.tolist(), i.tolist())} == {*zip(*(x.tolist() for x in np.nonzero(np.bitwise_count(asked[:, None] ^ sized.prints) <= decontaminate.RADIUS)))}
        assert reached <= 0.2 * len(asked) * len(sized.prints)


def plain_labels(w):
    """All labels of a text's words, by the definition: merged diagonals, the best of neighbouring ones, words in order."""
    labels, k, near = set(), licenses.K, licenses.NEAR
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        labels |= {label} if any(w[i : i + len(p)] == p for i in range(len(w))) else set()
    for text, label in licenses.PASSAGES:
        p = text.split()
        of, hits = len(p) - k + 1, {}
        places = {}
        for j in range(of):
            places.setdefault(tuple(p[j : j + k]), []).append(j)
        for i in range(len(w) - k + 1):
            for j in places.get(tuple(w[i : i + k]), ()):
                hits.setdefault(i - j, []).append((i, j))
        found = []
        for d in sorted(hits):
            own = [x for e in range(d - near, d + near + 1) for x in hits.get(e, ())]
            held = len({j for _, j in own})
            if held >= licenses.LEAST * of:
                found.append((d, held, min(i for i, _ in own), max(i for i, _ in own) + k))
        runs = []
        for x in found:
            if runs and x[0] - runs[-1][-1][0] <= near:
                runs[-1].append(x)
            else:
                runs.append([x])
        for run in runs:
            _, _, start, end = min(run, key=lambda x: (-x[1], x[3] - x[2], x[0]))
            row = [0] * (end - start + 1)  # of the table of longest common subsequences
            for word in p:
                above, row = row, [0]
                for i, x in enumerate(w[start:end]):
                    row.append(above[i] + 1 if x == word else max(above[i + 1], row[i]))
            labels |= {label} if row[-1] >= licenses.LEAST * len(p) else set()
    return ",".join(sorted(labels))


def test_licenses(spark, docs, empty):
    def plain(text):
        w, places, labels = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD)), [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), plain_labels(w)

    isc, mit = licenses.PASSAGES[3][0], licenses.PASSAGES[1][0]
    rng = np.random.default_rng(2)
    odd = [
        "MIT License, mit license; CC BY. GNU general public license gnu GENERAL public license",
        "Permission is hereby granted, free of charge, to any other person obtaining a copy of this software and associated documentation files",
        f"to use a to use b to use c to use {isc}",
        "the license " * 9,
        f"{'the software ' * 4}{mit}",
        f"{isc} {isc} and {mit} {mit}",
        " ".join(reversed(isc.split())),
    ]
    for text, _ in licenses.PASSAGES:
        for cut in (0.05, 0.12, 0.3):
            w = [x for x in text.split() if rng.random() > cut / 2]
            for _ in range(int(len(w) * cut / 2)):
                w.insert(int(rng.integers(len(w))), "zz")
            odd.append("before it " + " ".join(w) + " after it")
    rows = documents(spark, ODD + [(9030 + i, t) for i, t in enumerate(odd)])
    both = rows.select("doc_id", "text").union(docs.select("doc_id", "text"))
    got = licenses.scan_licenses(both)
    found = got.collect()
    shown = sorted(str((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"])) for r in found)
    assert shown == sorted(str((r["doc_id"], *plain(r["text"]))) for r in both.collect())
    by_id = {r["doc_id"]: (r["labels"], r["score"]) for r in found if r["doc_id"] and r["doc_id"] > 9000}
    assert (by_id[9031][0], by_id[9032], by_id[9033], by_id[9034], by_id[9036][0]) == ("mit", ("isc", 1.0), ("", 0.0), ("mit", 1.0), "")
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString() and licenses.scan_licenses(empty).count() == 0


def test_no_label_is_lost_with_a_word(spark):
    """Every license passage with each one of its words left out, or doubled."""
    rows = []
    for text, label in licenses.PASSAGES:
        p = text.split()
        of = len(p) - licenses.K + 1
        for i in range(len(p)):
            rows += [(len(rows), " ".join(p[:i] + p[i + 1 :]), label, of - licenses.K >= licenses.LEAST * of), (len(rows) + 1, " ".join(p[: i + 1] + p[i:]), label, True)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan_licenses(df).collect()}
    assert len(rows) > 1000 and [r for r in rows if r[3] and r[2] not in got[r[0]]] == []


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pii(spark, docs, empty):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def plain(text):
        out = []
        for kind, p in patterns.items():
            for m in re.finditer(p, text or ""):
                d = re.sub("[^0-9]", "", m[0])
                if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                    out.append(f"{kind}:{m.start()}:{m.end()}")
        return hashlib.sha256(",".join(out).encode()).hexdigest()

    texts = ["a@b.c_d@e.f", "a@b.com-x@y.z foo@bar", "@a.b x@y.z.", "😀 a@b.co 1.2.3.4 256.1.1.1 0001.002.3.4", "4111 1111 1111 1111 4111-1111-1111-1111", "+1 (234) 567-8901 +12 ++49 30 123456", "a" * 4000 + " " + "1" * 4000 + " a@" + "b." * 3000 + "c", "1.2.3.4.5.6.7.8.9", "x@y.z" * 3]
    rows = documents(spark, ODD + [(100 + i, t) for i, t in enumerate(texts)] + [(None, "q@w.e"), (None, "q@w.e")])
    both = rows.select("doc_id", "text").union(docs.select("doc_id", "text"))
    got = pii.scan_pii(both).collect()
    assert sorted(str((r["doc_id"], r["base_sha256"])) for r in got) == sorted(str((r["doc_id"], plain(r["text"]))) for r in both.collect())
    clean = pii.sanitise(rows)
    assert clean.columns == rows.columns
    by_id = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert by_id[101] == "[email]@y.z foo@bar" and by_id[1] is None and by_id[4] == "One two three."
    assert pii.scan_pii(empty).count() == 0 and pii.sanitise(empty).count() == 0


def test_terms_that_reveal_an_entity(spark):
    rows = [(i, f"call bob smithson at bob@x.org today, number {i}") for i in range(8)] + [(100 + i, f"nothing at today, call number {i}") for i in range(200)]
    got = pii.scan_pii(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id < 8").collect()
    assert {r["spans"] for r in got} == {"email:21:30,term:5:8,term:9:17"} and {r["n_term"] for r in got} == {2}


def test_languages(spark, sf, empty):
    got = QUERIES["op6_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    odd = {r["doc_id"]: r for r in langid.identify_languages(documents(spark)).collect()}
    assert odd[1]["lang_pred"] == odd[2]["lang_pred"] == odd[3]["lang_pred"] == "und" and odd[None]["held_out"]
    assert langid.identify_languages(empty).count() == 0


def word_pieces(word):
    """(cut, beginning, piece) by the definition: after 4, 6 and 8 bytes, or behind the letter that a cut falls in."""
    raw = word.encode()
    starts = [next(j for j in range(min(c, len(raw)), len(raw) + 1) if j == len(raw) or raw[j] & 0xC0 != 0x80) for c in toxicity.CUTS] + [len(raw)]
    return [(i, raw[: toxicity.CUTS[i] and a], raw[a:b]) for i, (a, b) in enumerate(zip(starts, starts[1:])) if b > a]


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_model(rows):
    """(counts, log ratio of a word) from (text, label), by the definition of the smoothed probabilities."""
    counts = Counter((p, label) for text, label in rows for w in plain_words(text) for p in word_pieces(w))
    pairs = {p for p, _ in counts}
    follow, own = Counter((cut, piece) for cut, _, piece in pairs), {}
    for p in pairs:
        own.setdefault(p[:2], []).append(p)

    def probability(p, label):
        n = sum(counts[q, label] for q in own.get(p[:2], []))
        over = sum(max(counts[q, label] - toxicity.DISCOUNT, 0) for q in own.get(p[:2], []))
        level = [k for k in follow if k[0] == p[0]]
        shared = (follow[p[0], p[2]] + toxicity.UNSEEN) / (sum(follow[k] for k in level) + toxicity.UNSEEN * (len(level) + 1))
        return max(counts[p, label] - toxicity.DISCOUNT, 0) / max(n, 1) + ((n - over) / n if n else 1) * shared

    seen = {}

    def ratio(word):
        if word not in seen:
            seen[word] = sum(math.log(max(probability(p, 1), 1e-12) / max(probability(p, 0), 1e-12)) for p in word_pieces(word))
        return seen[word]

    return counts, ratio


def plain_passages(text, ratio):
    r = [ratio(w) for w in plain_words(text)]
    means = lambda size: [sum(r[i : i + size]) / size for i in range(len(r) - size + 1)]
    return [max(means(min(size, len(r)))) if r else 0.0 for size in toxicity.PASSAGES] + [sum(r) / len(r) if r else 0.0]


VOCABULARY = ["kind", "Kindness", "cruel", "cruelly", "of", "überall", "größeres", "abcéfg", "漢字かな", "x" * 12, "é" * 5]


def random_texts(n, most):
    rng = np.random.default_rng(9)
    labels = [int(x) for x in rng.random(n) < 0.4]
    return [(" ".join(rng.choice(VOCABULARY, rng.integers(0, most), p=np.roll(np.arange(1, 12), 4 * y) / 66)), y) for y in labels]


def test_counts_and_probabilities_are_those_of_a_plain_model(spark):
    rows = random_texts(60, 60) + [("", 1), (None, 0)]
    counts, ratio = plain_model(rows)
    df = spark.createDataFrame(rows, "text string, toxic int")
    got = toxicity.count_pairs(df).collect()
    assert sorted((r["toxic"], r["ordinary"]) for r in got) == sorted((counts[p, 1], counts[p, 0]) for p in {p for p, _ in counts})
    stored = common.Stored(spark)
    model = toxicity.train(df, stored)
    texts = [*VOCABULARY, "unseen", "kindest", "crueller", "größe", "漢字", " ".join(VOCABULARY * 7), "", None, "..."]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (toxicity.MODEL_ROWS, 0):
        found = {r["doc_id"]: r for r in toxicity.compare(asked, model, stored, model_rows=most).collect()}
        assert len(found) == len(texts)
        for i, text in enumerate(texts):
            assert [found[i][c] for c in toxicity.FEATURES] == pytest.approx(plain_passages(text, ratio), abs=1e-4)


@pytest.mark.parametrize("block", [32 << 20, 300])
def test_scores_are_those_of_a_plain_model_by_broadcast_and_by_join(spark, monkeypatch, block):
    """The same from a model that is broadcast and from one that is joined, in one block of texts and in many; repeated rows and null keys stay."""
    monkeypatch.setattr(toxicity, "BLOCK_BYTES", block)
    texts = random_texts(120, 40)
    rows = [(i, t) for i, (t, _) in enumerate(texts)] + [(3, texts[3][0])] * 5 + [(None, "cruel"), (500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, y) for i, (_, y) in enumerate(texts)]
    taught = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 5}
    _, ratio = plain_model([(t, taught[i]) for i, t in rows if i in taught and t is not None])
    x = [plain_passages(t, ratio) for _, t in rows]
    learnt = [k for k, (i, _) in enumerate(rows) if i in taught]
    w = toxicity.calibrate(np.array([x[k] for k in learnt]), np.array([float(taught[rows[k][0]]) for k in learnt]))
    want = sorted((str(i), round(1 / (1 + math.exp(-(np.dot(w[:3], v) + w[3]))), 2)) for (i, _), v in zip(rows, x))
    for most in (toxicity.MODEL_ROWS, 0):
        found = toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), model_rows=most).collect()
        got = sorted((str(r["doc_id"]), r["score"]) for r in found)
        assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=0.011)
        assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)


def test_toxicity(spark, empty):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES["op3_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.93 * len(got)
    odd = toxicity.score_toxicity(documents(spark), labels).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score_toxicity(empty, labels).count() == toxicity.score_toxicity(empty, labels, model_rows=-1).count() == 0
    none = toxicity.score_toxicity(documents(spark), labels.where("false")).collect()
    assert {r["predicted"] for r in none} == {0}


def test_quality(spark, empty):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op7_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = [r["kept"] for r in got if r["quality"] == 1], [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)
    odd = {r["doc_id"]: r for r in quality.score_quality(documents(spark)).collect()}
    assert odd[1]["score"] == odd[2]["score"] == odd[3]["score"] == 0
    assert quality.score_quality(empty).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, left = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.Stored(spark).put(stage(spark, docs, sf), name)
        if name != "packing":
            assert docs.columns == columns and docs.join(before, "doc_id", "left_anti").count() == 0
        left.append(docs.select("doc_id").distinct().count())
    assert left[0] > left[1] > left[2] >= left[3] == left[4] == left[5]
    assert QUERIES["pipeline"](spark, sf).select("doc_id").distinct().count() == left[5]


def test_pipeline_keeps_one_row_of_repeated_ids(spark, sf):
    import corpus_pipeline

    words = [" ".join(f"{x}{i}" for i in range(40)) for x in "abc"]
    rows = [(1, words[0]), (1, words[0]), (2, words[0] + " more"), (3, None), (3, ""), (3, ""), (None, words[1]), (None, words[1]), (5, words[2]), (5, ""), (6, words[1])]
    docs = documents(spark, rows)
    got = corpus_pipeline.dedup_stage(spark, docs, sf)
    assert got.columns == docs.columns
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    kept = [rows[0], *rows[3:11]]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == sorted(kept, key=key)


def test_pipeline_on_odd_rows(spark, sf):
    import corpus_pipeline

    bench = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    for rows in (documents(spark, [*ODD, (90, bench), (91, "write to jo.doe@example.com or call +1 202 555 0143 about the plan today and tomorrow")]), documents(spark).where("false")):
        docs, n = rows, rows.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, docs = docs, common.Stored(spark).put(stage(spark, docs, sf), name)
            assert docs.columns == rows.columns and docs.count() <= before.count()
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
        assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.select("doc_id").collect()} and (n == 0) == (not packed)
        assert "jo.doe" not in " ".join(r["text"] or "" for r in docs.collect())


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def test_each_pipeline_stage_does_what_a_plain_version_does(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, texts = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.Stored(spark).put(stage(spark, docs, sf), name)
        texts.append({r["doc_id"]: r["text"] for r in docs.collect()} if name != "packing" else docs.collect())
    quality_out, dedup_out, clean, sanitised, packed = texts

    # near-duplicates: all pairs by sets of five words
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := _words(t)) else set() for i, t in quality_out.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for at, i in enumerate(ids):
        for j in ids[:at]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert dedup_out == {i: quality_out[i] for i in ids if find(i) == i}

    # decontamination: no item stands in what is kept, and nothing goes that shares no five words with any item
    items = [_words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    known = {tuple(w[j : j + 5]) for w in items for j in range(max(1, len(w) - 4))}
    for i, t in dedup_out.items():
        if not sets[i] & known:
            assert clean[i] == t
        if any(f" {' '.join(w)} " in f" {' '.join(_words(t))} " for w in items if len(w) >= 5):
            assert i not in clean

    # PII: ids stay, patterns go, texts without any stay as they are unless a term in them was found to reveal one
    assert clean.keys() == sanitised.keys()
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert any(mail.search(t or "") for t in clean.values()) and not any(mail.search(t or "") for t in sanitised.values())

    # packing: every text's ids, in pieces that fill sequences without gaps
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    lengths = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in sanitised.items()}
    got, rows = Counter(), {}
    for r in packed:
        got[r["doc_id"]] += r["length"]
        rows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert dict(got) == lengths
    for places in rows.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(rows) <= 1.02 * -(-sum(lengths.values()) // 2048) + 1
