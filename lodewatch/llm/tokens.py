"""Token counts and token ids of whole texts with public tokenizer files.

Both follow the `tokenizers` library exactly. Where a text holds only characters for which the rules are simple
(below U+0250), the merges run on bytes in a rank encoder, which is several times faster; all else goes to the library.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, arrow_map, run_hashes, sliced, text_bytes

#: Text bytes encoded at once; longer texts are cut at safe boundaries.
BATCH_BYTES, PIECE_CHARS = 1 << 20, 1 << 16
#: Entries that a worker remembers before it starts anew.
REMEMBERED = 800_000
_PLAIN = re.compile("[^\x00-\x1b\x20-ɏ]")
#: One space between two other characters: no token of a byte-level vocabulary reaches across its left side.
_SAFE = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")
#: Texts with such characters (RE2 syntax) go to the library: contractions, special tokens, control characters that some take for white space, and all but ASCII and the letters of U+00C0 to U+00FF.
_ODD = r"[^\x00-\x1b\x20-\x26\x28-\x7f\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]|<\|"
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, others from U+0100 on."""
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = {}, 256
    for b in range(256):
        if b in printing:
            out[chr(b)] = b
        else:
            out[chr(extra)], extra = b, extra + 1
    return out


@lru_cache(maxsize=4)
def _library(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _ranked(path: str):
    """(rank encoder over bytes, id of each rank). A word's end is the byte 0xFF, which UTF-8 never holds; it binds first."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, letters = spec["model"], _byte_letters()
    end = model.get("end_of_word_suffix") or ""

    def raw(token: str) -> bytes:
        ends = bool(end) and token.endswith(end)
        return bytes(letters[c] for c in (token[: -len(end)] if ends else token)) + b"\xff" * ends

    ranks = {bytes([b]): b for b in range(256)}
    if end:
        ranks |= {bytes([b, 255]): 256 + b for b in range(256)}
    for merge in model["merges"]:
        ranks.setdefault(raw("".join(merge.split(" ") if isinstance(merge, str) else merge)), len(ranks))
    ids, special = np.zeros(len(ranks), "<u4"), {x["content"] for x in spec.get("added_tokens", [])}
    for token, i in model["vocab"].items():
        if token not in special:
            ids[ranks[raw(token)]] = i
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ids


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """A text in parts of about `size` characters, cut only before a space between two letters."""
    if len(text) <= 2 * size:
        return [text]
    out, at = [], 0
    while len(text) - at > 2 * size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", limit: int = 1024) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every whole text, as the library for the byte-level file `tokenizer` counts.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows stay rows of their own; other columns are ignored.
    A file path is opened on the executors, so the vocabulary must lie at the same place on each of them.
    """

    def make():
        ranked, library = _ranked(tokenizer)[0], _library(tokenizer)
        special = [t.content for t in library.get_added_tokens_decoder().values()]

        def count(texts: list[str]) -> np.ndarray:
            n, slow = np.zeros(len(texts), np.int64), []
            for i, t in enumerate(texts):
                if _PLAIN.search(t) or any(s in t for s in special):
                    slow.append(i)
                else:
                    n[i] = len(ranked.encode_ordinary(t))
            for i in range(0, len(slow), 64):
                for j, e in zip(slow[i : i + 64], library.encode_batch_fast([texts[j] for j in slow[i : i + 64]], add_special_tokens=False)):
                    n[j] = len(e)
            return n

        def run(batch: pa.RecordBatch):
            for part in sliced(batch, "text", BATCH_BYTES):
                texts = pc.fill_null(part.column("text"), "")
                parts = [(r, p) for r, t in enumerate(texts.to_pylist()) for p in (pieces(t) if not any(s in t for s in special) else [t])]
                n = np.bincount([r for r, _ in parts], weights=count([p for _, p in parts]), minlength=len(texts)).astype(np.int64)
                n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("key"), n_bytes, pa.array(n)], ["key", "n_bytes", "n_tokens"])

        return run

    kind = df.schema[key].dataType.simpleString()
    out = arrow_map(df.select(F.col(key).alias("key"), F.col(text).alias("text")), make, f"key {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


class WordIds:
    """Ids of texts for a vocabulary whose tokens never reach across white space.

    Each distinct word (run of letters, single digit, run of other characters) is encoded once and remembered by its hash;
    a batch of texts is then cut, looked up and joined by array operations.
    """

    def __init__(self, path: str):
        self.ranked, self.ids = _ranked(path)
        self.library = _library(path)
        self.forget()

    def forget(self) -> None:
        self.hashes, self.starts, self.sizes, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _remember(self, hashes: np.ndarray, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        one = self.ranked._core_bpe.encode_single_piece
        buffer = raw.tobytes()
        got = [one(buffer[a : b + 1] + b"\xff") for a, b in zip(s.tolist(), e.tolist())]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, self.ids[np.fromiter((i for x in got for i in x), np.int64, int(sizes.sum()))]])
        order = np.argsort(all_hashes := np.concatenate([self.hashes, hashes]), kind="stable")
        self.hashes, self.starts, self.sizes = all_hashes[order], np.concatenate([self.starts, starts])[order], np.concatenate([self.sizes, sizes])[order]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, as arrays."""
        texts = pc.fill_null(texts, "")
        odd = np.asarray(pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False), bool)
        raw, at = text_bytes(pc.if_else(pa.array(odd), "", texts))
        if len(self.hashes) > REMEMBERED:
            self.forget()
        ids, cut = self._plain(raw, at)
        out = [ids[cut[i] : cut[i + 1]] for i in range(len(at) - 1)]
        for i in np.flatnonzero(odd):
            out[i] = np.array(self.library.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, "<u4")
        return out

    def _plain(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return self.flat[:0], np.zeros(len(at), np.int64)
        low = LOWER[raw]
        low[1:] += np.where((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E), 32, 0).astype(np.uint8)
        kind = _KIND[low]
        edge = np.zeros(len(raw) + 1, bool)
        edge[at] = True
        border = edge.copy()
        border[1:-1] |= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        s, e = np.flatnonzero(border[:-1] & (kind > 0)), np.flatnonzero(border[1:] & (kind > 0))
        own, first, back = np.unique(run_hashes(low, s, e), return_index=True, return_inverse=True)
        known = np.searchsorted(self.hashes, own)
        new = np.flatnonzero(own != self.hashes[np.minimum(known, len(self.hashes) - 1)]) if len(self.hashes) else np.arange(len(own))
        if len(new):
            self._remember(own[new], low, s[first[new]], e[first[new]])
            known = np.searchsorted(self.hashes, own)
        index = known[back]
        sizes = self.sizes[index]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[index] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[np.searchsorted(s, at)]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One memory a worker: later tasks find the words of earlier ones."""
    return WordIds(path)


def id_pieces(df: DataFrame, tokenizer: str, size: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32): each text's ids and a closing id 0, cut into pieces of `size` ids.

    Null text counts as empty and gives one piece holding the closing id. Repeated rows give repeated pieces.
    """

    def make():
        encoder = word_ids(tokenizer)

        def run(batch: pa.RecordBatch):
            for part in sliced(batch, "text", BATCH_BYTES):
                keys, row, piece, start, length, crc = part.column("key"), [], [], [], [], []
                for r, found in enumerate(encoder.encode(part.column("text"))):
                    ids = found.tobytes() + b"\0\0\0\0"
                    for p, at in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[at : at + 4 * size]
                        row.append(r), piece.append(p), start.append(at // 4), length.append(len(own) // 4), crc.append(zlib.crc32(own))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["key", "piece", "start", "length", "ids_crc32"],
                )

        return run

    kind = df.schema[key].dataType.simpleString()
    out = arrow_map(df.select(F.col(key).alias("key"), F.col(text).alias("text")), make, f"key {kind}, piece int, start long, length long, ids_crc32 long")
    return out.withColumnRenamed("key", key)
