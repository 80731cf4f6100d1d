"""Quality by a weak-label model: overlapping heuristic labellers, EM over their votes, and a hashed linear scorer.

Each labeller looks at one trait of a text and votes good, bad or not at all. How often each pattern of votes occurs in
the whole corpus is enough for expectation-maximisation to estimate every labeller's accuracy, and with it the posterior
that a text is good. A logistic scorer on hashed word shapes learns the posteriors and then judges every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Stored, arrow_map, distinct, give_back, mix, run_hashes, running, sliced, text_bytes, word_spans

#: Buckets of hashed shapes; texts that the scorer is fitted on at most (the first by hash of their id); bytes at once.
BUCKETS, FIT_ROWS, PART_BYTES = 1_024, 10_000, 1 << 20

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")
_LINE = np.zeros(256, bool)
_LINE[10] = True
#: Trait, side on which it speaks for a bad text, from where on, and the fewest words to vote. They overlap: junk of any kind
#: shows in two or more.
LABELLERS = (
    ("symbol_share", "above", 0.10, 8),
    ("capital_share", "above", 0.30, 8),
    ("bare_symbol_words", "above", 0.08, 8),
    ("repeats_before", "above", 0.20, 12),
    ("distinct_words", "below", 0.15, 30),
    ("repeated_lines", "above", 0.35, 30),
    ("tailed_words", "above", 0.30, 8),
    ("plain_words", "below", 0.70, 8),
)
TRAITS = tuple(x[0] for x in LABELLERS)
#: The only trait that can speak for a good text, from this share on: words of letters that don't repeat the one before.
PROSE = 0.92


def _sums(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def measure(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(traits, rows x TRAITS; hashed shapes, rows x BUCKETS, each row's sum 1; words in each row)."""
    raw, at = text_bytes(texts)
    n_rows = len(at) - 1
    if not len(raw):
        return np.zeros((n_rows, len(TRAITS))), np.zeros((n_rows, BUCKETS), np.float32), np.zeros(n_rows, np.int64)
    kind = _CLASS[raw]
    s, e = word_spans(raw, at, SPACES)
    rows = np.searchsorted(s, at)
    n = np.diff(rows)
    row = np.repeat(np.arange(n_rows), n)
    sums = running(raw)
    words = run_hashes(raw, s, e, sums)
    letters, capitals = _sums((kind == 97) | (kind == 65), at), _sums(kind == 65, at)
    marks = (kind != 97) & (kind != 65) & (kind != 48) & ~SPACES[raw]
    common = (raw == 46) | (raw == 44) | (raw == 39) | (raw == 45) | (raw == 34)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    _, own = distinct(words, rows)
    ls, le = word_spans(raw, at, _LINE)
    line_rows = np.searchsorted(ls, at)
    _, own_lines = distinct(run_hashes(raw, ls, le, sums), line_rows)
    lines = np.diff(line_rows)
    mark_words = marks[s] & marks[e] & (e - s < 2)
    tail = np.where(e - s >= 3, marks[e] & marks[np.maximum(e - 1, 0)], False)
    odd_before = np.concatenate([[0], np.cumsum(marks & ~common)])
    capitals_before = np.concatenate([[0], np.cumsum(kind == 65)])
    shouted = (e > s) & (capitals_before[e + 1] - capitals_before[s] >= np.maximum(2, (e - s) // 2 + 1))
    plain = (odd_before[e + 1] == odd_before[s]) & ~shouted & ~same & ~(marks[s] & (e == s))
    per_word, per_byte = np.maximum(n, 1), np.maximum(_sums(~SPACES[raw], at), 1)
    traits = np.stack(
        [
            _sums(marks & ~common, at) / per_byte,
            capitals / np.maximum(letters, 1),
            np.bincount(row, weights=mark_words, minlength=n_rows) / per_word,
            np.bincount(row, weights=same, minlength=n_rows) / per_word,
            np.diff(own) / np.sqrt(per_word) / np.maximum(1, np.sqrt(per_word) / 8),
            1 - np.diff(own_lines) / np.maximum(lines, 1),
            np.bincount(row, weights=tail, minlength=n_rows) / per_word,
            np.bincount(row, weights=plain, minlength=n_rows) / per_word,
        ],
        1,
    )
    shape = run_hashes(kind, np.maximum(s, e - 2), e) ^ mix(kind[s].astype(np.uint64))
    shape = np.where(same, np.uint64(1), shape % np.uint64(BUCKETS - 2) + np.uint64(2)).astype(np.int64)
    hashed = np.bincount(row * BUCKETS + shape, minlength=n_rows * BUCKETS).astype(np.float32).reshape(n_rows, BUCKETS)
    hashed /= per_word[:, None]
    hashed[:, 0] = traits[:, 5]
    return traits, hashed, n


def votes(traits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """1: good, -1: bad, 0: no vote; rows x labellers."""
    out = np.zeros(traits.shape, np.int8)
    for i, (_, side, bad, least) in enumerate(LABELLERS):
        spoken = traits[:, i] >= bad if side == "above" else traits[:, i] < bad
        out[:, i] = np.where(n < least, 0, np.where(spoken, -1, 0))
    out[(traits[:, -1] >= PROSE) & (n >= LABELLERS[-1][3]), -1] = 1
    return out


def vote_patterns(docs: DataFrame) -> DataFrame:
    """(doc_id, pattern) of each row (doc_id, text): a character -, 0 or + for each labeller."""

    def make():
        letters = np.array([ord("-"), ord("0"), ord("+")], np.uint8)

        def run(batch: pa.RecordBatch):
            for part in sliced(batch, "text", PART_BYTES):
                traits, _, n = measure(part.column("text"))
                rows = letters[votes(traits, n) + 1]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([r.tobytes().decode() for r in rows], pa.string())], ["doc_id", "pattern"])

        return run

    return arrow_map(docs, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, pattern string")


def expectation_maximisation(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray, float]:
    """(posterior of good for each pattern, P(vote | class) as labellers x classes x votes, prior of good).

    Labellers are taken as independent given the class; bad is class 0. At the start, a vote is much likelier to be right
    than wrong, and not voting says little.
    """
    names = sorted(patterns)
    if not names:
        return {}, np.zeros((0, 2, 3)), 0.5
    v = np.array([[" -0+".index(c) - 1 for c in p] for p in names])
    n = np.array([patterns[p] for p in names], float)
    given = np.tile(np.array([[0.40, 0.55, 0.05], [0.03, 0.77, 0.20]]), (v.shape[1], 1, 1))
    prior = 0.8
    for _ in range(rounds):
        log = np.log([1 - prior, prior])[None] + np.log(given[np.arange(v.shape[1])[None, :, None], np.arange(2)[None, None], v[:, :, None]]).sum(1)
        good = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        after = np.clip((n * good).sum() / n.sum(), 0.05, 0.99)
        for k in range(v.shape[1]):
            for c, w in enumerate((n * (1 - good), n * good)):
                count = np.bincount(v[:, k], weights=w, minlength=3) + np.array([[1.0, 1.0, 0.2], [0.2, 1.0, 1.0]])[c]
                given[k, c] = count / count.sum()
        if abs(after - prior) < 1e-9:
            break
        prior = after
    return dict(zip(names, good.tolist())), given, float(prior)


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights and constant of a ridge logistic regression on soft labels (accelerated gradient steps)."""
    y = y.astype(np.float32)
    w, b, look, look_b, t = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0, 1.0
    if not len(y):
        return np.append(w, 3.0)
    squares = np.concatenate([(x[i : i + 500] ** 2).sum(1) for i in range(0, len(x), 500)])
    rate = np.float32(4.0 / (float(squares.mean()) + 1))
    for _ in range(rounds):
        miss = 1 / (1 + np.exp(-np.clip(x @ look + np.float32(look_b), -30, 30))) - y
        new, new_b = look - rate * (miss @ x / np.float32(len(y)) + np.float32(1e-5) * look), look_b - float(rate) * float(miss.mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_b, w, b, t = new + np.float32((t - 1) / t2) * (new - w), new_b + (t - 1) / t2 * (new_b - b), new, new_b, t2
    return np.append(w, b)


def train_quality(docs: DataFrame, stored: Stored) -> tuple[np.ndarray, dict[str, float]]:
    """(scorer, posterior of each vote pattern) from the texts alone. docs: doc_id, text."""
    patterns = stored.put(vote_patterns(docs), "patterns")
    counts = {r["pattern"]: r["n"] for r in patterns.groupBy("pattern").agg(F.count("*").alias("n")).collect()}  # 3 ** labellers rows at most
    posterior, _, _ = expectation_maximisation(counts)
    sample = patterns.orderBy(F.xxhash64("doc_id"), "doc_id", "pattern").limit(FIT_ROWS)

    def make():
        def run(batch: pa.RecordBatch):
            for part in sliced(batch, "text", PART_BYTES):
                hashed = measure(part.column("text"))[1]
                at = [np.flatnonzero(r) for r in hashed]
                places, values = [i.astype(np.uint16).tobytes() for i in at], [r[i].tobytes() for r, i in zip(hashed, at)]
                yield pa.RecordBatch.from_arrays([part.column("pattern"), pa.array(places, pa.binary()), pa.array(values, pa.binary())], ["pattern", "at", "x"])

        return run

    # only what isn't zero comes to the driver, which holds one matrix
    rows = arrow_map(docs.join(F.broadcast(sample), "doc_id").select("pattern", "text"), make, "pattern string, at binary, x binary").limit(2 * FIT_ROWS).collect()
    x, y = np.zeros((len(rows), BUCKETS), np.float32), np.array([posterior[r["pattern"]] for r in rows])
    for own, r in zip(x, rows):
        own[np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["x"], np.float32)
    del rows
    scorer = fit_scorer(x, y)
    del x
    give_back()
    stored.drop(patterns)
    return scorer, posterior


def _scores(texts: pa.Array, scorer: np.ndarray) -> np.ndarray:
    _, hashed, n = measure(texts)
    return np.where(n > 0, 1 / (1 + np.exp(-np.clip(hashed @ scorer[:-1] + scorer[-1], -30, 30))), 0.0)


def score_quality(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, posterior, score, kept): the weak-label posterior and the scorer's probability that a text is good; kept from 0.5.

    Null texts and texts without words have score 0. Labellers don't vote on short texts, which so depend on the scorer.
    Repeated rows stay; an empty table gives no rows; other columns are left out.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    scorer, posterior = train_quality(docs, Stored(docs.sparkSession))

    def make():
        def run(batch: pa.RecordBatch):
            for part in sliced(batch, "text", PART_BYTES):
                traits, hashed, n = measure(part.column("text"))
                seen = ["".join("-0+"[v + 1] for v in r) for r in votes(traits, n)]
                score = np.where(n > 0, 1 / (1 + np.exp(-np.clip(hashed @ scorer[:-1] + scorer[-1], -30, 30))), 0.0).round(6)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([round(posterior.get(p, 0.5), 6) for p in seen]), pa.array(score)], ["doc_id", "posterior", "score"])

        return run

    out = arrow_map(docs, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, posterior double, score double")
    return out.select(F.col("doc_id").alias(key), "posterior", "score", (F.col("score") >= 0.5).alias("kept"))


def good_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that the scorer keeps, with all their columns."""
    scorer, _ = train_quality(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), Stored(docs.sparkSession))

    def make():
        def run(batch: pa.RecordBatch):
            for part in sliced(batch, text, PART_BYTES):
                yield part.filter(pa.array(_scores(part.column(text), scorer).round(6) >= 0.5))

        return run

    return arrow_map(docs, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
