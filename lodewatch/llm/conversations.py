"""Repair of conversations: faults, and the cheapest edits that give them turns in order, with a record of the edits."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, arrow_map, in_order

#: Rows of a conversation that are worked through as one piece; pieces are worked out apart and then joined.
PIECE_BITS = 10
_WORD = "[^\\x20\\x09-\\x0D]"
#: Where a conversation can stand: nothing yet, after system, after user, after assistant. It may end at 0 and 3.
START, SYSTEM, USER, ASSISTANT = range(4)
#: (state, initial of the role, state after it).
_MOVES = ((START, "s", SYSTEM), (START, "u", USER), (SYSTEM, "u", USER), (USER, "a", ASSISTANT), (ASSISTANT, "u", USER))
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
_MOD, _BASE = (1 << 61) - 1, 911382323


class Audits:
    """Records of edits as linked nodes: a record is its last node, and records with one beginning share its nodes.

    Each node has its letter, its length, a rolling hash of the whole record and its ancestors 1, 2, 4, ... back.
    """

    def __init__(self, mod: int = _MOD, base: int = _BASE):
        self.mod, self.base = mod, base
        self.letter, self.size, self.hash, self.up = [""], [0], [0], [[]]

    def add(self, node: int, letter: str) -> int:
        ups, k, at = [node], 0, node
        while k < len(self.up[at]):  # the ancestor 2^k back of the one 2^k back
            at = self.up[at][k]
            ups.append(at)
            k += 1
        self.letter.append(letter)
        self.size.append(self.size[node] + 1)
        self.hash.append((self.hash[node] * self.base + ord(letter)) % self.mod)
        self.up.append(ups)
        return len(self.letter) - 1

    def _back(self, node: int, steps: int) -> int:
        k = 0
        while steps:
            if steps & 1:
                node = self.up[node][k]
            steps >>= 1
            k += 1
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _diverge(self, a: int, b: int) -> tuple[int, int]:
        """The first nodes of two records of one length at which they differ; (0, 0) if they don't.

        Jumps back while hashes differ, so what lies before has the same hash; that it is the same is verified letter by
        letter back to a node that both share, and the first letter that differs all the same (a collision) counts.
        """
        if self.hash[a] == self.hash[b]:
            x, y, last = a, b, (0, 0)
        else:
            for k in reversed(range(len(self.up[a]))):
                if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                    a, b = self.up[a][k], self.up[b][k]
            x, y, last = self.up[a][0], self.up[b][0], (a, b)
        while x != y:
            if self.letter[x] != self.letter[y]:
                last = (x, y)
            x, y = self.up[x][0], self.up[y][0]
        return last

    def less(self, a: int, b: int) -> bool:
        """Whether record a stands before record b, byte by byte, the shorter of two that agree first."""
        if a == b:
            return False
        n = min(self.size[a], self.size[b])
        x, y = self._diverge(self._back(a, self.size[a] - n), self._back(b, self.size[b] - n))
        return self.letter[x] < self.letter[y] if x else self.size[a] < self.size[b]


def _better(audits: Audits, best: dict[int, tuple[int, int]], state: int, cost: int, node: int, letter: str) -> None:
    """Takes `node` and a letter as the record for a state if it is cheaper, or as cheap and before it."""
    have = best.get(state)
    if have is None or cost < have[0] or cost == have[0] and audits.less(new := audits.add(node, letter), have[1]):
        best[state] = (cost, audits.add(node, letter) if have is None or cost < have[0] else new)


def _inserted(audits: Audits, best: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """The states reached when empty turns may be put in next."""
    out = dict(best)
    for _ in range(3):  # as many in a row can be of use
        for state, role, to in _MOVES:
            if role != "s" and state in out:
                _better(audits, out, to, out[state][0] + INSERT, out[state][1], "I")
    return out


@lru_cache(maxsize=1 << 13)
def _short(codes: str, begin: int) -> tuple[tuple[int, int, str], ...]:
    return repairs(codes, begin)


def repairs(codes: str, begin: int, mod: int = _MOD) -> tuple[tuple[int, int, str], ...]:
    """(state, cost, edits) of the cheapest edits of a run of turns from a state to each state that can be reached, ties least.

    Each turn is two letters: its role's initial (any other than s, u and a counts as x) and its fault: b, d (both must go), t or -.
    A dynamic program over turns and states; no insertions after the last turn.
    """
    audits = Audits(mod)
    best = {begin: (0, 0)}
    for k in range(0, len(codes), 2):
        role, fault = codes[k], codes[k + 1]
        best, after = _inserted(audits, best), {}
        for state, (cost, node) in best.items():
            _better(audits, after, state, cost + DELETE, node, "D")
        if fault not in "bd":
            extra = TRUNCATED * (fault == "t")
            for state, needed, to in _MOVES:
                if state in best:
                    cost, node = best[state]
                    if role == needed:
                        _better(audits, after, to, cost + KEEP + extra, node, "K")
                    if needed != "s":
                        _better(audits, after, to, cost + REROLE + extra, node, "R")
        best = after
    return tuple((state, cost, audits.text(node)) for state, (cost, node) in sorted(best.items()))


class Joined:
    """The cheapest edits of a whole conversation out of those of its pieces, in order.

    Nodes are linked here, too, each with a piece's edits. Two records of as many pieces are compared from the node that they last share.
    """

    def __init__(self):
        self.edits, self.depth, self.up = [""], [0], [[]]
        self.best: dict[int, tuple[int, int]] = {START: (0, 0)}

    def _add(self, node: int, edits: str) -> int:
        ups, k, at = [node], 0, node
        while k < len(self.up[at]):
            at = self.up[at][k]
            ups.append(at)
            k += 1
        self.edits.append(edits)
        self.depth.append(self.depth[node] + 1)
        self.up.append(ups)
        return len(self.edits) - 1

    def _shared(self, a: int, b: int) -> int:
        for k in reversed(range(len(self.up[a]))):
            if k < len(self.up[a]) and self.up[a][k] != self.up[b][k]:
                a, b = self.up[a][k], self.up[b][k]
        return a if a == b else self.up[a][0]

    def _since(self, node: int, shared: int) -> str:
        out = []
        while node != shared:
            out.append(self.edits[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _take(self, best: dict, state: int, cost: int, node: int, edits: str) -> None:
        have = best.get(state)
        if have is not None and cost > have[0]:
            return
        if have is not None and cost == have[0]:
            shared = self._shared(node, self.up[have[1]][0])
            if self._since(node, shared) + edits >= self._since(have[1], shared):
                return
        best[state] = (cost, self._add(node, edits))

    def piece(self, codes: str) -> None:
        after: dict[int, tuple[int, int]] = {}
        for state, (cost, node) in self.best.items():
            for to, more, edits in (_short if len(codes) <= 64 else repairs)(codes, state):
                self._take(after, to, cost + more, node, edits)
        self.best = after

    def end(self) -> tuple[int, str]:
        """(cost, edits) of the conversation, which may end with empty turns put in."""
        found = []
        tail = {START: (0, ""), SYSTEM: (2, "II"), USER: (1, "I"), ASSISTANT: (0, "")}
        for state, (cost, node) in self.best.items():
            n, edits = tail[state]
            found.append((cost + n * INSERT, self._since(node, 0) + edits))
        return min(found)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conversation, turn, role, text) with faults put in by CRC-32 of `conv_id:turn` modulo 20; null values are read as one space.

    0 drops the row, 1 empties its text, 2 takes `.`, `!` and `?` out of it, 3 repeats the row, 4 sets the role to user. `conversation` is
    conv_id as text.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(space("conv_id").alias("conversation"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("kind"))
    rows = rows.where("kind <> 0").withColumns({
        "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")),
    })
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def repair(rows: DataFrame) -> DataFrame:
    """(conversation, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of conversations (conversation, turn, role, text).

    Rows of a conversation are taken by turn, nulls first, then role and text. A row's first fault counts: blank; duplicate of an earlier row's role and text;
    truncated, if the last character that isn't space is none of `.!?`. The edits are the cheapest ones that give roles system (or none), then user and assistant in
    turns, or nothing: Keep 0, Rerole 2, Delete 3 (a must for blank and duplicate rows), Insert an empty turn 2, and 1 for a truncated row that stays; ties go to the
    record that is first in ASCII order. Roles count by their initials. No value may be null. An empty table gives no rows.

    Rows are sorted over all partitions; runs of at most 2^PIECE_BITS rows of a conversation are gathered as two letters a row, and their edits are found apart, so a
    long conversation is many tasks' work. Only the hash of its repaired text, which can't be split, is worked out in one task, as its rows stream through it.
    """
    stored = Stored(rows.sparkSession)
    last = F.substr(F.rtrim(F.translate("text", "\t\n\v\f\r", "     ")), F.lit(-1))
    marks = {"digest": F.sha2("text", 256), "blank": ~F.col("text").rlike(_WORD), "cut": ~last.isin(".", "!", "?")}
    placed = in_order(rows.select("conversation", "turn", "role", "text"), stored, ["conversation", "turn", "role", "text"])
    marked = stored.put(placed.select("conversation", "turn", "role", "at", *(c.alias(k) for k, c in marks.items())), "marked")
    again = marked.groupBy("conversation", "role", "digest").agg(F.min("at").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    turns = marked.join(again, ["conversation", "role", "digest"], "left")
    fault = F.when(F.col("blank"), "b").when(F.col("at") > F.col("first"), "d").when(F.col("cut"), "t").otherwise("-")
    initial = F.left("role", F.lit(1))
    turns = turns.select("conversation", F.shiftright("at", PIECE_BITS).alias("piece"), "at", "turn", F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("x"), fault).alias("code"))
    pieces = turns.groupBy("conversation", "piece").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "").alias("codes"),
        F.min("turn").alias("first"), F.max("turn").alias("last"), F.size(F.collect_set("turn")).cast("long").alias("turns"),
    )
    found = arrow_map(pieces.repartition("conversation").sortWithinPartitions("conversation", "piece"), _whole, _FOUND)
    found = stored.put(found, "found")
    texts = placed.select("conversation", "at", "role", "text").unionByName(found.select("conversation", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text")))
    hashes = arrow_map(texts.repartition("conversation").sortWithinPartitions("conversation", "at"), _hashed, "conversation string, repaired_sha256 string")
    return found.join(hashes, "conversation")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_FOUND = "conversation string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string"


def _whole():
    """Of pieces in order: one row a conversation. Carries the conversation that the batch before ended in."""
    now: list = []  # conversation, Joined, counts of faults, illegal, first and last turn, distinct turns, last role

    def close() -> list[tuple]:
        if not now:
            return []
        name, joined, counts, illegal, first, last, turns, _ = now
        cost, audit = joined.end()
        return [(name, (last - first + 1 - turns) if turns else 0, *counts, illegal, cost, audit)]

    def run(batch: pa.RecordBatch | None):
        out = []
        for name, codes, first, last, turns in zip(*(batch.column(c).to_pylist() for c in ("conversation", "codes", "first", "last", "turns"))) if batch is not None else ():
            if not now or now[0] != name:
                out += close()
                now[:] = [name, Joined(), [0, 0, 0], 0, first, last, 0, ""]
            now[1].piece(codes)
            faults, roles = codes[1::2], now[7] + codes[::2]
            now[2] = [n + faults.count(f) for n, f in zip(now[2], "bdt")]
            now[3] += sum(roles[k : k + 2] not in ("su", "ua", "au") for k in range(len(roles) - 1))
            now[6] += turns - (turns > 0 and now[6] > 0 and first == now[5])  # the turn goes on
            now[4] = first if now[4] is None else now[4]
            now[5], now[7] = last if last is not None else now[5], roles[-1:]
        if batch is None:
            out += close()
        kinds = [pa.string(), *[pa.int64()] * len(_COUNTS), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["conversation", *_COUNTS, "audit"])

    run.ends = True
    return run


def _hashed():
    """Of rows in order, each conversation's audit first: the hash of its repaired text, one row at a time."""
    now: list = []  # conversation, audit, place in it, state, hash, whether a line is there

    def line(role: str, text: str) -> None:
        if now[5]:
            now[4].update(b"\n")
        now[4].update(f"{role}:{text}".encode())
        now[5] = True

    def needed() -> str:
        now[3] = ASSISTANT if now[3] == USER else USER
        return "assistant" if now[3] == ASSISTANT else "user"

    def inserts() -> None:
        while now[2] < len(now[1]) and now[1][now[2]] == "I":
            line(needed(), "")
            now[2] += 1

    def close() -> list[tuple]:
        if not now:
            return []
        inserts()
        return [(now[0], now[4].hexdigest())]

    def run(batch: pa.RecordBatch | None):
        out = []
        for name, at, role, text in zip(*(batch.column(c).to_pylist() for c in ("conversation", "at", "role", "text"))) if batch is not None else ():
            if at < 0:
                out += close()
                now[:] = [name, text, 0, START, hashlib.sha256(), False]
                continue
            inserts()
            edit = now[1][now[2]]
            now[2] += 1
            if edit == "K":
                now[3] = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                line(role, text)
            elif edit == "R":
                line(needed(), text)
        if batch is None:
            out += close()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in (0, 1)], ["conversation", "repaired_sha256"])

    run.ends = True
    return run


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conv_id, after damaged().

    A conversation of which no row is left has zeros, an empty audit and the hash of nothing. Null conv_ids are one conversation. Repeated rows stay, and count as
    duplicates. Other columns are ignored. An empty table gives no rows.
    """
    found = repair(damaged(conversations))
    ids = conversations.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conversation")).distinct()
    nothing: dict[str, Column] = {**{c: F.lit(0).cast("long") for c in _COUNTS}, "audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return ids.join(found, "conversation", "left").select("conv_id", *(F.coalesce(F.col(c), v).alias(c) for c, v in nothing.items()))
