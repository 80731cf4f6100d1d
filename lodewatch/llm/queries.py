"""The registered queries opN_<name>: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 2048)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=5, least=0.8)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), 0.98)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify_languages

    return identify_languages(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import scan_pii

    return scan_pii(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=1024)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    found = archive_pages(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "capture", "place")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import repair_damaged

    return repair_damaged(_table(spark, sf_dir, "conversations"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .merkle import merkle_audit

    more = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1)
    return merkle_audit(_table(spark, sf_dir, "documents"), changed={"n_chars": more})


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_decontamination, op3_toxicity, op4_embeddings, op5_licenses, op6_language, op7_quality, op8_minhash, op9_pii, op10_token_counts, op11_warc, op12_conversations, op13_merkle, pipeline)}

#: CRC-32 of an ASCII text d.
CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(d) + 1), lambda i: CAST(ascii(d[i]) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""


def _conversations_sql() -> str:
    """Turn by turn, the cheapest repair that leads to each of four states, as {c: cost, a: edits, r: repaired lines}."""
    add = lambda s, cost, edit, line="''": f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 'r': {s}.r || {line}}}"
    line = lambda role: f"chr(10) || '{role}:' || text"
    never = "{'c': 1000000000, 'a': '', 'r': ''}"
    only = lambda condition, s: f"CASE WHEN {condition} THEN {s} ELSE {never} END"
    put = lambda s, role: add(s, 2, "I", f"chr(10) || '{role}:'")
    least = lambda *s: f"list_min([{', '.join(s)}])"
    stays, more = "fault IN ('t', '-')", "(fault = 't')::INT"
    keep = lambda s, initial: only(f"{stays} AND initial = '{initial}'", add(s, more, "K", "chr(10) || role || ':' || text"))
    rerole = lambda s, role: only(stays, add(s, f"2 + {more}", "R", line(role)))
    return f"""
WITH RECURSIVE source AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS d FROM conversations),
kinds AS (SELECT *, {CRC32} % 20 AS kind FROM source),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
turns AS MATERIALIZED (SELECT *, left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS previous,
  CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '-' END AS fault FROM placed),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (previous || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
states AS (SELECT conv_id, n, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 'r': ''}} AS nothing, {{'c': CAST(1000000000 AS BIGINT), 'a': '', 'r': ''}} AS s, {{'c': CAST(1000000000 AS BIGINT), 'a': '', 'r': ''}} AS u, {{'c': CAST(1000000000 AS BIGINT), 'a': '', 'r': ''}} AS b FROM counts
  UNION ALL SELECT conv_id, n, i, {add('nothing', 3, 'D')}, {least(add('s', 3, 'D'), keep('nothing', 's'))},
    {least(add('u', 3, 'D'), *(f(x, y) for x in ('nothing', 's', 'b') for f, y in ((keep, 'u'), (rerole, 'user'))))}, {least(add('b', 3, 'D'), keep('u', 'a'), rerole('u', 'assistant'))}
  FROM (SELECT x.* EXCLUDE (b), {least('x.b', put('x.u', 'assistant'))} AS b FROM (
    SELECT p.conv_id, p.n, t.i, p.nothing, p.s, p.b, {least('p.u', put('p.nothing', 'user'), put('p.s', 'user'), put('p.b', 'user'))} AS u, t.role, t.text, t.initial, t.fault
    FROM states p JOIN turns t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i + 1) x)),
ends AS (SELECT conv_id, {least('nothing', add('s', 4, 'II', "chr(10) || 'user:' || chr(10) || 'assistant:'"), put('u', 'assistant'), 'b')} AS e FROM states WHERE i = n)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.c, 0) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(e.r[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends ON o.conv_id IS NOT DISTINCT FROM ends.conv_id
"""


ORACLE_SQL: dict[str, str] = {
    "op4_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, label, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS size FROM v
      WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.label = q.label AND p.vec_id <> q.vec_id
          WHERE p.size > 0 AND q.size > 0 AND len(p.x) = len(q.x) AND list_inner_product(p.x, q.x) / (p.size * q.size) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON e.vec_id = least.a LEFT JOIN counts ON e.vec_id = counts.a
""",
    "op8_minhash": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT p.doc_id AS a, q.doc_id AS b FROM e p JOIN e q ON p.g = q.g AND p.doc_id <> q.doc_id
          GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN least ON doc_id = a
""",
    "op11_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(trim(coalesce(url, '')), '[\\p{Z}\\p{C}]+', '%20', 'g') AS url FROM pages),
q AS (SELECT *, sha256(html) AS digest, strlen(html) AS size, lower(url) AS low, regexp_replace(regexp_replace(lower(url), '^[a-z][a-z0-9+.-]*://', ''), '#.*$', '') AS bare FROM p),
f AS (SELECT digest, min(page_id) AS first_id FROM q WHERE size >= 100 GROUP BY digest),
k AS (SELECT q.*, CASE WHEN size >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to,
  strftime(to_timestamp(1704067200 + coalesce(page_id, 0) % 31536000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS captured,
  CASE WHEN NOT contains(low, '://') THEN low ELSE array_to_string(list_reverse(string_split(regexp_replace(regexp_extract(bare, '^(?:[^/?@]*@)?([^/?:]*)', 1), '^www[0-9]*\\.', ''), '.')), ',')
    || regexp_replace(regexp_extract(bare, '^(?:[^/?@]*@)?[^/?:]*(:[0-9]+)?', 1), '^:(80|443)$', '') || ')' || CASE WHEN regexp_matches(bare, '^[^/?]*/') THEN '' ELSE '/' END || regexp_replace(bare, '^[^/?]*', '') END AS url_key
  FROM q LEFT JOIN f ON q.digest = f.digest)
SELECT page_id, size AS payload_bytes, digest AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, url_key, captured,
  row_number() OVER (PARTITION BY url_key ORDER BY captured, page_id NULLS FIRST) - 1 AS capture, row_number() OVER (ORDER BY url_key, captured, page_id NULLS FIRST) - 1 AS place FROM k
""",
    "op12_conversations": _conversations_sql(),
    "op13_merkle": """
WITH RECURSIVE bits AS (SELECT doc_id, text, lang, source, n_chars, CAST(doc_id AS VARCHAR) AS d FROM documents),
crc AS (SELECT *, """ + CRC32 + """ AS crc FROM bits),
parts AS (SELECT doc_id, lang, crc % 7 = 0 AND n_chars IS NOT NULL AS hit,
  CASE WHEN doc_id IS NULL THEN '-' ELSE len(d) || ':' || d END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS a,
  CASE WHEN n_chars IS NULL THEN '-' ELSE len(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS b, len(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) AS c,
  CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS e FROM crc),
leaves AS MATERIALIZED (SELECT doc_id, lang, sha256(a || b || e) AS leaf, CASE WHEN hit THEN sha256(a || c || e) ELSE sha256(a || b || e) END AS found FROM parts),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (SELECT 0 AS level, lang, i, n, leaf AS h FROM placed
  UNION ALL SELECT level + 1, lang, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY level, lang, i // 2, n),
subroots AS MATERIALIZED (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, i, n, h FROM subroots
  UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2, n),
steps AS (SELECT p.lang, p.i, m.level, CASE WHEN s.h IS NULL THEN 'N' WHEN (p.i >> m.level) % 2 = 1 THEN 'L' || s.h ELSE 'R' || s.h END AS step
  FROM placed p JOIN (SELECT DISTINCT lang, level FROM nodes WHERE n > 1) m ON p.lang IS NOT DISTINCT FROM m.lang
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = m.level AND s.i = xor(p.i >> m.level, 1)),
low AS (SELECT lang, i, list(step ORDER BY level) AS path FROM steps GROUP BY lang, i),
high AS (SELECT p.lang, list(CASE WHEN s.h IS NULL THEN 'N' WHEN (p.i >> m.level) % 2 = 1 THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY m.level) AS path
  FROM subroots p JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) m ON true LEFT JOIN tops s ON s.level = m.level AND s.i = xor(p.i >> m.level, 1) GROUP BY p.lang),
paths AS (SELECT p.doc_id, p.leaf, p.found, r.h AS subroot, t.h AS root, list_concat(coalesce(low.path, []), coalesce(high.path, [])) AS path
  FROM placed p JOIN subroots r ON p.lang IS NOT DISTINCT FROM r.lang JOIN (SELECT h FROM tops WHERE n = 1) t ON true
  LEFT JOIN low ON low.lang IS NOT DISTINCT FROM p.lang AND low.i = p.i LEFT JOIN high ON high.lang IS NOT DISTINCT FROM p.lang),
folded AS (SELECT *, list_reduce(list_prepend(found, path), lambda have, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] ELSE '' END || have || CASE WHEN s[1] = 'R' THEN s[2:] ELSE '' END)) AS folded_root FROM paths)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda s: s[2:]), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
""",
}
