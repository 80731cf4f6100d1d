"""Web archives, conversations and manifests against plain versions and SQL, and on odd rows."""

import gzip
import hashlib
import io
import itertools
import json
import os
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lodewatch.llm import conversations, merkle, warc
from lodewatch.llm.common import Stored, numbered
from lodewatch.llm.queries import ORACLE_SQL, QUERIES


def by_sql(name, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{sf_dir}/{t}.parquet') else ''}')")
    found = con.sql(ORACLE_SQL[name])
    return found.columns, found.fetchall()


def same(spark, name, sf_dir):
    columns, want = by_sql(name, sf_dir)
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    got = got.select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    return got


@pytest.mark.parametrize("name", ["op11_warc", "op12_conversations", "op13_merkle"])
def test_as_sql(spark, sf, name):
    assert same(spark, name, sf)


# ---------------------------------------------------------------- archives

PAGES = [
    (1, "http://www.Example.org:80/a?b#c", "x" * 200), (2, "https://example.org/a?b", "x" * 200), (3, None, "x" * 99), (4, "not a url", "x" * 99), (5, "http://example.org", None), (None, "http://u@example.org:8080/é ß\n", "x" * 200),
    (6, "http://a.b.example.org?q", "é" * 60 + "\r\n\r\nWARC/1.1\r\n"), (7, "http://a.b.example.org/", "é" * 60 + "\r\n\r\nWARC/1.1\r\n"), (1, "http://example.org/a?b", "x" * 200), (8, "", ""), (9, "http://example.org/long", "y" * 3_000_000), (None, "http://n.org/", "only here " * 20), (None, "http://n.org/", "only here " * 20),
]


def test_odd_pages(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("digest", "file", "captured", "run", "at", "first_id")})
    df.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    rows = same(spark, "op11_warc", str(tmp_path))
    got = {(r["page_id"], r["url_key"]): r for r in rows if r["page_id"] is not None}
    assert got[1, "org,example)/a?b"]["record_type"] == "response" and got[2, "org,example)/a?b"]["refers_to"] == 1 and got[7, "org,example,b,a)/"]["refers_to"] == 6
    assert got[5, "org,example)/"]["payload_bytes"] == 0 and got[9, "org,example)/long"]["payload_bytes"] == 3_000_000 and got[4, "not%20a%20url"]["record_type"] == "response"
    assert sorted(r["refers_to"] or 0 for r in rows if r["page_id"] is None) == [0, 0, 1]
    assert warc.archive_pages(df.where("false")).count() == 0


def test_archives_are_read_back_whole(spark):
    """Every payload byte by byte, from archives cut small, and each record again by its place alone."""
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").where("page_id is not null")
    stored = Stored(spark)
    rows = df.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "\\s", "%20").alias("url"), F.lit("2024-01-01T00:00:00Z").alias("captured"), F.coalesce("html", F.lit("")).cast("binary").alias("html"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.lit(None).cast("long").alias("first_id"))
    files = stored.put(warc.write_archives(rows.withColumn("url_key", warc.url_key(F.col("url"))).repartition(2), f"{stored.root}/archives", 500), "archives")
    found = warc.read_archives(files, payload=True).collect()
    assert sum(r["records"] for r in files.collect()) == len(found) == df.count() > files.count() > 2 and all(r["intact"] for r in found)
    assert sorted((int(r["page_id"]), bytes(r["payload"])) for r in found) == sorted((r["page_id"], (r["html"] or "").encode()) for r in df.collect())
    for r in found:
        with open(r["file"].removeprefix("file://").removeprefix("file:"), "rb") as f:
            f.seek(r["offset"])
            one = warc.parsed(gzip.decompress(f.read(r["size"])))
        assert one["payload_digest"] == r["payload_digest"] == hashlib.sha256(r["payload"]).hexdigest()


def test_a_record_says_when_it_was_changed():
    page = {"page_id": 1, "url": "http://a.b/", "captured": "2024-01-01T00:00:00Z", "html": b"abc", "digest": hashlib.sha256(b"abc").hexdigest(), "first_id": None}
    assert warc.parsed(warc.record(page))["intact"] and not warc.parsed(warc.record(page).replace(b"abc", b"abd"))["intact"]
    again = warc.parsed(warc.record({**page, "first_id": 0}))
    assert (again["type"], again["payload_bytes"], again["refers_to"], again["payload"]) == ("revisit", 3, "0", b"")
    data = b"".join(gzip.compress(x) for x in (b"one", b"", b"three" * 1000))
    assert [x for _, _, x in warc.members(io.BytesIO(data), 7)] == [b"one", b"", b"three" * 1000]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-1]), 7))


def test_the_tree_of_losers_merges():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((r.randrange(20), f"{i}-{j}") for j in range(r.randrange(30))) for i in range(k)]
        assert list(warc.Losers(map(iter, runs))) == sorted(itertools.chain(*runs))


def test_captures_of_one_url_are_spread(spark):
    """A URL with most captures, in many ranges: places and captures count on."""
    rows = spark.range(3000).select(F.concat(F.lit("f"), (F.col("id") % 7).cast("string")).alias("file"), F.lit(1).cast("long").alias("size"), F.lit("response").alias("type"), F.col("id").alias("page"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("u"), (F.col("id") % 50).cast("string"))).alias("url_key"), F.format_string("t%04d", (F.col("id") * 7919) % 1000).alias("captured"), F.lit(5).cast("long").alias("payload_bytes"), F.lit("d").alias("payload_digest"), F.lit(None).cast("long").alias("refers_to"))
    stored = Stored(spark)
    runs = stored.put(rows.repartition(7, "file").sortWithinPartitions("file", "url_key", "captured", "page").withColumn("offset", F.monotonically_increasing_id()), "rows")
    got = sorted(warc.capture_index(runs, stored).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(3000))
    assert [(r["url_key"], r["captured"], r["page"]) for r in got] == sorted((r["url_key"], r["captured"], r["page"]) for r in runs.collect())
    for key, own in itertools.groupby(got, lambda r: r["url_key"]):
        assert [r["capture"] for r in own] == list(range(sum(r["url_key"] == key for r in got)))


# ---------------------------------------------------------------- conversations


def cheapest(turns):
    """Every way to edit (initial, fault) turns, by growing records one letter at a time."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best, todo = None, [(0, 0, 0, "")]
    seen = {}
    while todo:
        i, state, cost, audit = todo.pop()
        if best is not None and cost > best[0] or seen.get((i, state, audit), 99) <= cost or audit.count("I") > len(turns) + 3:
            continue
        seen[i, state, audit] = cost
        if i == len(turns) and state in (0, 3):
            best = min(best or (cost, audit), (cost, audit))
        for (s, role), to in step.items():
            if s == state and role != "s":
                todo.append((i, to, cost + 2, audit + "I"))
        if i < len(turns):
            initial, fault = turns[i]
            todo.append((i + 1, state, cost + 3, audit + "D"))
            if fault not in "bd":
                for (s, role), to in step.items():
                    if s == state:
                        if role == initial:
                            todo.append((i + 1, to, cost + (fault == "t"), audit + "K"))
                        if role != "s":
                            todo.append((i + 1, to, cost + 2 + (fault == "t"), audit + "R"))
    return best


def test_the_cheapest_edits_of_every_short_conversation():
    turns = list(itertools.product("suax", "-t")) + [("u", "b"), ("a", "d")]
    cases = [c for n in range(3) for c in itertools.product(turns, repeat=n)] + [random.Random(k).choices(turns, k=5) for k in range(60)]
    for case in cases:
        whole = conversations.Joined()
        whole.piece("".join(map("".join, case)))
        parts = conversations.Joined()  # the same turn by turn
        for turn in case:
            parts.piece("".join(turn))
        assert whole.end() == parts.end() == cheapest(case), case


@pytest.mark.parametrize("mod", [(1 << 61) - 1, 3, 1])
def test_records_are_compared_whatever_their_hashes(mod):
    """With a modulus of 3 or 1 hashes collide; what they claim is verified."""
    r, audits = random.Random(mod), conversations.Audits(mod)
    nodes = [0]
    for _ in range(400):
        nodes.append(audits.add(r.choice(nodes[-40:]), r.choice("DIK")))
    for _ in range(2000):
        a, b = r.choice(nodes), r.choice(nodes)
        assert audits.less(a, b) == (audits.text(a) < audits.text(b))
    codes = "".join(r.choice(["u-", "a-", "ut", "x-", "s-", "ad"]) for _ in range(200))
    assert conversations.repairs(codes, 0, mod) == conversations.repairs(codes, 0)


TALKS = [
    (1, 0, "user", "Hello?"), (1, 1, "assistant", None), (1, 2, None, "What."), (2, None, "user", "One."), (2, None, "user", "One."), (2, 5, "assistant", "x" * 50_000), (2, 5, "assistant", "Two!"), (None, 0, "system", "S."), (None, None, "user", "é?"), (None, 1, "assistant", "ß."),
    (3, None, "tool", "\t\n"), (4, 7, "", ""), (5, 2, "assistant", "only."), (6, 1, "user", "a\nb."), (6, 2, "assistant", "c.\x0b"), (6, 9, "system", "late."),
]


def test_odd_conversations(spark, tmp_path):
    more = [(10 + k % 40, k // 40, ("user", "assistant", "system", "tool")[k * 7 % 11 % 4], ("Fine.", "cut", " ", "Same.")[k * 5 % 13 % 4]) for k in range(400)]
    df = spark.createDataFrame(TALKS + more, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(c) for c in ("conversation", "at", "piece", "codes", "kind", "copy")})
    df.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    rows = same(spark, "op12_conversations", str(tmp_path))
    assert len(rows) == 47 and any(r["conv_id"] is None for r in rows)
    gone = next(n for n in range(100, 10_000) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    alone = conversations.repair_damaged(spark.createDataFrame([(gone, 0, "user", "x")], "conv_id long, turn long, role string, text string")).first()
    assert tuple(alone) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert conversations.repair_damaged(df.where("false")).count() == 0


def test_a_long_conversation_is_many_pieces(spark, tmp_path):
    """One conversation of 3,000 turns and some short ones: pieces of 1,024 turns, and the counts at their edges."""
    r = random.Random(5)
    rows = [(1, k // 2, r.choice(["user", "assistant", "tool"]), r.choice(["a.", "b!", "c", f"{k}.", ""])) for k in range(3000)] + [(2 + k % 5, k, "user", f"{k}.") for k in range(20)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = same(spark, "op12_conversations", str(tmp_path))
    assert max(len(r["audit"]) for r in got) > 2048


# ---------------------------------------------------------------- manifests


def tree(nodes):
    """(root, proofs) of a list of hex digests."""
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    proofs, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, joined = [], []
        for k in range(0, len(nodes), 2):
            pair = nodes[k : k + 2]
            if len(pair) == 2:
                for side in (0, 1):
                    for leaf in groups[k + side]:
                        proofs[leaf].append(pair[1 - side])
            above.append(h("".join(pair)))
            joined.append(sum(groups[k : k + 2], []))
        nodes, groups = above, joined
    return nodes[0], proofs


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_every_size_of_tree(spark, monkeypatch, levels):
    """Groups of 1 to 17 rows, in passes of few levels, with equal rows, null keys and a null group."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    rows = [(k, None if n == 0 else f"ß{n}", f"text {k}") for n in (0, 1, 2, 3, 4, 5, 8, 17) for k in range(n or 6)] + [(None, "ß3", None), (1, "ß5", "text 1"), (1, "ß5", "text 1")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumns({c: F.lit(c) for c in ("g", "k", "h", "i", "n", "block", "path", "top")})
    changed = {"text": F.when(F.col("doc_id") == 2, F.lit("other"))}
    got = merkle.merkle_audit(df.repartition(3), ("doc_id", "lang", "text"), changed=changed).collect()
    groups, want, tops = {}, [], []
    for k, lang, text in rows:
        groups.setdefault(lang, []).append((k is not None, k or 0, h(part(k) + part(lang) + part(text)), k))
    order = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {lang: tree([x[2] for x in sorted(groups[lang])]) for lang in order}
    root, tops = tree([trees[lang][0] for lang in order])
    for lang, top in zip(order, tops):
        for x, proof in zip(sorted(groups[lang]), trees[lang][1]):
            want.append((x[3], x[2], trees[lang][0], root, h("".join([*proof, *top])), x[3] != 2))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["verified"])) for r in got)
    assert all((r["folded_root"] == root) == r["verified"] for r in got)


def test_empty_tables_and_single_rows(spark):
    df = spark.createDataFrame([(7, None, None, None, "")], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.merkle_audit(df.where("false")).count() == 0
    one = merkle.merkle_audit(df).first()
    assert one["leaf"] == hashlib.sha256(b"1:7---0:").hexdigest() == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == hashlib.sha256().hexdigest()


def test_numbers_within_groups_go_on_over_ranges(spark):
    stored = Stored(spark)
    df = stored.put(spark.range(2000).select(F.when(F.col("id") % 3 > 0, 1).alias("g"), (F.col("id") * 37 % 2000).alias("k")), "rows")
    got = numbered(df, stored, ["g"], ["g", "k"]).collect()
    for g in (None, 1):
        own = sorted((r["k"], r["i"]) for r in got if r["g"] == g)
        assert [i for _, i in own] == list(range(len(own))) and {r["n"] for r in got if r["g"] == g} == {len(own)}
    assert json.dumps(sorted(r["k"] for r in got)) == json.dumps(list(range(2000)))
