"""Benchmark decontamination: SimHash fingerprints of item-sized windows, multi-index Hamming blocks, exact verification.

All windows of a document with as many words as an item are compared with it by weighted Jaccard similarity of their word
shingles (weights are occurrences). A window and an item of m shingles each that are similar to t share 2t/(1+t) m of them, so
a window in which fewer shingles are known from any item of that size is left out first: that is exact, and says nothing about
where in an item they stand. The others are fingerprinted by running sums. Of fingerprints within RADIUS (19) bits, one of the
four blocks of 16 bits differs in 4 bits at most, so looking up those neighbours of every block finds all items within the
radius; the index reaches 15 % of unrelated ones. Those within the radius are verified exactly.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import SYMBOLS, arrow_map, mix, shingles, sliced, word_hashes

#: At similarity 0.8 about 10 of 64 bits differ, give or take 3, more where shingles repeat.
BLOCKS, BLOCK_BITS, RADIUS, PART_BYTES = 4, 16, 19, 1 << 20
#: Bytes of item texts compared in one pass over the documents; more items take more passes. Windows looked up at once.
PASS_BYTES, WINDOWS = 8 << 20, 256
_BITS = np.arange(64, dtype=np.uint64)


def _neighbours(distance: int) -> np.ndarray:
    """All block values with at most `distance` bits set."""
    return np.array([sum(1 << b for b in c) for d in range(distance + 1) for c in combinations(range(BLOCK_BITS), d)], np.uint16)


#: If RADIUS bits differ at most, one of the first RADIUS % BLOCKS + 1 blocks differs in RADIUS // BLOCKS or fewer, or another in one less.
_AROUND = [_neighbours(RADIUS // BLOCKS), *[_neighbours(RADIUS // BLOCKS - (RADIUS % BLOCKS < b)) for b in range(1, BLOCKS)]]


def votes(values: np.ndarray) -> np.ndarray:
    """For each shingle, its 64 bits as 0 and 1."""
    return ((mix(values)[:, None] >> _BITS) & np.uint64(1)).astype(np.int32)


def fingerprints(sums: np.ndarray, n: int) -> np.ndarray:
    """64 bits from sums of votes of n shingles each: whether most have a bit set."""
    return np.bitwise_or.reduce(np.where(2 * sums > n, np.uint64(1) << _BITS, np.uint64(0)), axis=1)


def weighted_jaccard(p: np.ndarray, q: np.ndarray) -> float:
    a, n = np.unique(p, return_counts=True)
    b, m = np.unique(q, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(p) + len(q) - both) if len(p) + len(q) else 0.0


class Sized:
    """The items of one size in words: their shingles, fingerprints, and an index of the fingerprints' blocks."""

    def __init__(self, words: int, items: list[int], values: list[np.ndarray]):
        self.words, self.items, self.shingles = words, items, values
        self.known = np.unique(np.concatenate(values))
        self.prints = np.concatenate([fingerprints(votes(v).sum(0)[None], len(v)) for v in values])
        blocks = self.prints.view(np.uint16).reshape(-1, BLOCKS)
        self.order = [np.argsort(blocks[:, b], kind="stable") for b in range(BLOCKS)]
        self.sorted = [blocks[o, b] for b, o in enumerate(self.order)]

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(window, item, how many pairs the index reached) of all pairs of fingerprints within RADIUS."""
        found, blocks = [], prints.view(np.uint16).reshape(-1, BLOCKS)
        for b, around in enumerate(_AROUND):
            if len(self.prints) < len(around):  # fewer blocks than neighbours: those are compared, with the same outcome
                most = int(np.bitwise_count(around[-1]))
                w, i = np.nonzero(np.bitwise_count(blocks[:, b, None] ^ self.prints.view(np.uint16).reshape(-1, BLOCKS)[:, b]) <= most)
                found.append(w * len(self.prints) + i)
                continue
            asked = blocks[:, b, None] ^ around
            lo, hi = np.searchsorted(self.sorted[b], asked), np.searchsorted(self.sorted[b], asked, "right")
            w, k = np.nonzero(hi > lo)
            n = (hi - lo)[w, k]
            at = np.repeat(lo[w, k] - np.cumsum(n) + n, n) + np.arange(n.sum())
            found.append(np.repeat(w, n) * len(self.prints) + self.order[b][at])
        pairs = np.unique(np.concatenate(found))
        w, i = pairs // len(self.prints), pairs % len(self.prints)
        close = np.bitwise_count(prints[w] ^ self.prints[i]) <= RADIUS
        return w[close], i[close], len(pairs)


class Benchmark:
    """Items by their number of words, and which shingles any of them holds."""

    def __init__(self, ids: list, texts: list[str], k: int):
        words, rows = word_hashes(pa.array(texts, pa.string()), SYMBOLS)
        values, starts = shingles(words, rows, k)
        self.k, self.ids, self.sizes = k, ids, []
        size = np.diff(rows)
        for n in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == n).tolist()
            self.sizes.append(Sized(n, own, [values[starts[i] : starts[i + 1]] for i in own]))
        self.known = np.unique(values)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.known >> np.uint64(44)] = True

    def matches(self, values: np.ndarray, n_words: int, known: np.ndarray, least: float) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window of a document for each item. known: which shingles items have."""
        best: dict[int, tuple[float, int, int]] = {}
        so_far = np.concatenate([[0], np.cumsum(known)])
        for sized in self.sizes:
            m = max(1, sized.words - self.k + 1)  # shingles of an item
            n = min(m, len(values))  # and of a window; a shorter document is one
            if sized.words < self.k and n_words != sized.words:
                continue
            need = int(np.ceil(least * (m + n) / (1 + least) - 1e-9))
            starts = np.flatnonzero(so_far[n:] - so_far[:-n] >= need)
            if not len(starts):
                continue
            # of this size alone
            own = np.flatnonzero(known)
            there = np.zeros(len(values), bool)
            there[own] = sized.known[np.minimum(np.searchsorted(sized.known, values[own]), len(sized.known) - 1)] == values[own]
            own_sums = np.concatenate([[0], np.cumsum(there)])
            starts = starts[own_sums[starts + n] - own_sums[starts] >= need]
            for part in np.split(starts, range(WINDOWS, len(starts), WINDOWS)) if len(starts) else ():
                cut = [part[0], *(part[1:][np.diff(part) > n]), part[-1] + 1]  # where windows lie apart, nothing between is summed
                sums = np.concatenate([self._sums(values, part[(part >= a) & (part < b)], n) for a, b in zip(cut[:-1], cut[1:])])
                for w, i in zip(*sized.near(fingerprints(sums, n))[:2]):
                    start, item = int(part[w]), sized.items[i]
                    s = weighted_jaccard(values[start : start + n], sized.shingles[i])
                    if s >= least and (item not in best or (-s, start) < (-best[item][0], best[item][1])):
                        best[item] = (s, start, min(sized.words, n_words))
        return sorted((i, *found) for i, found in best.items())

    @staticmethod
    def _sums(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        running = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(votes(values[starts[0] : starts[-1] + n]), axis=0, dtype=np.int32)])
        return running[starts - starts[0] + n] - running[starts - starts[0]]

    def scan(self, texts: pa.Array, least: float):
        """(row, item, similarity, first word, words) of every match in a column of texts."""
        words, rows = word_hashes(texts, SYMBOLS)
        values, starts = shingles(words, rows, self.k)
        some = np.flatnonzero(self.maybe[values >> np.uint64(44)])
        if len(self.known):
            some = some[self.known[np.minimum(np.searchsorted(self.known, values[some]), len(self.known) - 1)] == values[some]]
        known = np.zeros(len(values), bool)
        known[some] = True
        for r in np.unique(np.searchsorted(starts, some, "right") - 1):
            own = slice(starts[r], starts[r + 1])
            for found in self.matches(values[own], int(rows[r + 1] - rows[r]), known[own], least):
                yield int(r), *found


def _passes(benchmark: DataFrame, k: int, text: str, item: str):
    """The items, about PASS_BYTES at a time; only the benchmark comes to the driver, and never more than a pass of it."""
    n_bytes = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    passes = max(1, -(-n_bytes // PASS_BYTES))
    dealt = benchmark.where(F.col(text).isNotNull()).select(item, text, F.pmod(F.xxhash64(item, text), F.lit(passes)).alias("_pass"))
    for p in range(passes):
        rows = dealt.where(F.col("_pass") == p).collect()
        yield Benchmark([r[0] for r in rows], [r[1] for r in rows], k)


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window of each document for each item it holds.

    Words are runs of letters, digits and characters beyond ASCII, A-Z folded. An item of fewer than k words is one shingle
    and is looked for among whole documents of as many words. A document shorter than an item is one window. Null and
    empty texts and items match nothing; ties go to the first window; equal items are all reported; repeated rows are
    reported each; other columns are left out; an empty table gives no rows.
    """
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    arrow_kind = to_arrow_type(benchmark.schema[item].dataType)
    out = None
    for held in _passes(benchmark, k, text, item):
        sent = docs.sparkSession.sparkContext.broadcast(held)

        def make(sent=sent):
            items = sent.value

            def run(batch: pa.RecordBatch):
                for part in sliced(batch, "text", PART_BYTES):
                    found = list(items.scan(part.column("text"), least))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id").take(pa.array([f[0] for f in found], pa.int64())),
                            pa.array([items.ids[f[1]] for f in found], arrow_kind),
                            *(pa.array([f[c] for f in found], t) for c, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64()))),
                        ],
                        ["doc_id", "item_id", "similarity", "first_word", "n_words"],
                    )

            return run

        got = arrow_map(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), make, f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, first_word long, n_words long")
        out = got if out is None else out.unionByName(got)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, text: str = "text", item: str = "item_id") -> DataFrame:
    """The documents that hold no item, with all their columns; one pass for each PASS_BYTES of items."""
    out = docs
    for held in _passes(benchmark, k, text, item):
        sent = docs.sparkSession.sparkContext.broadcast(held)

        def make(sent=sent):
            items = sent.value

            def run(batch: pa.RecordBatch):
                for part in sliced(batch, text, PART_BYTES):
                    keep = np.ones(len(part), bool)
                    keep[[f[0] for f in items.scan(part.column(text), least)]] = False
                    yield part.filter(pa.array(keep))

            return run

        out = arrow_map(out, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
    return out
