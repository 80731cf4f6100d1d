"""Terms that disclose an entity, counted and cut over whole documents."""

import math
import re
from collections import Counter

import pytest

from lodewatch.llm import pii


def spans(rows, least=3, threshold=0.9):
    """By the definition, over e-mail addresses: {doc_id: [(start, end)]}."""
    words = {i: {w.lower() for w in re.findall(r"[^\W_]+", t)} for i, t in rows}
    held = {i: set(re.findall(r"\w+@\w+\.\w+", t)) for i, t in rows}
    n, n_t, n_e = len(rows), Counter(w for x in words.values() for w in x), Counter(e for x in held.values() for e in x)
    both = Counter((e, w) for i in words for e in held[i] for w in words[i])
    told = {w for (e, w), k in both.items() if k >= least and n_e[e] < n and math.log(n * k / (n_t[w] * n_e[e])) / math.log(n / n_e[e]) >= threshold}
    out = {}
    for i, t in rows:
        inside = [m.span() for m in re.finditer(r"\w+@\w+\.\w+", t)]
        out[i] = [m.span() for m in re.finditer(r"[^\W_]+", t) if m[0].lower() in told and not any(a <= m.start() and m.end() <= b for a, b in inside)]
    return out


@pytest.fixture(scope="module")
def rows():
    far = "and so on with much more of the same " * 9
    own = [(i, f"Smithson wrote. {far} See bob@x.org or 12 34 then {far} 李明 and smithson") for i in range(6)]
    elsewhere = [(50, f"here Smithson alone, {far}"), (51, "😀 李明 again")]
    return own + elsewhere + [(100 + i, f"nothing {far} number {i} {i % 7}") for i in range(300)]


def test_terms_count_in_whole_documents_and_are_cut_everywhere(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("term")] for r in pii.scan_pii(docs, threshold=0.8).collect()}
    want = spans(rows, threshold=0.8)
    assert got == want and len(want[0]) >= 3 and len(want[50]) == 1 and want[51] == [(2, 4)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, threshold=0.8).collect()}
    assert not any("mithson" in clean[i] or "李明" in clean[i] for i in (*range(6), 50, 51)) and clean[51] == "😀 [term] again"


def test_repeated_rows_change_no_term(spark, rows):
    """Four documents share a name with an address, one row of them stands ten times, and so does one without."""
    docs = spark.createDataFrame(rows + [rows[0]] * 9 + [rows[-1]] * 30, "doc_id long, text string")
    got = {r["doc_id"]: [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("term")] for r in pii.scan_pii(docs, threshold=0.8).collect()}
    assert got == spans(rows, threshold=0.8)


def test_no_python_runs(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for found in (pii.scan_pii(docs), pii.sanitise(docs)):
        assert not any(x in found._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Pandas"))
