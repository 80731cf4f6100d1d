"""Web archives: pages written as WARC records, read back, and indexed as capture histories in the order of URL key and time."""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, arrow_map, places

#: Payloads below this size are never replaced by a revisit.
LEAST_REVISIT = 100
#: An archive is closed, and the next one begun, beyond this size.
ARCHIVE_BYTES = 64 << 20
#: Rows of archives that a batch may hold, and its bytes.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "file string, offset long, size long, type string, record_id string, page_id string, url string, captured string, payload_bytes long, payload_digest string, refers_to string, intact boolean"


def url_key(url: Column) -> Column:
    """The key under which an index keeps a URL: host parts from the last to the first, then port, path and query; case and `www` don't count.

    `http://www.Example.org:80/a?b#c` gives `org,example)/a?b`. What isn't like a URL is its own key in lower case; null gives an empty key.
    """
    text = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    bare = F.regexp_replace(F.regexp_replace(text, "^[a-z][a-z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_replace(F.regexp_extract(bare, "^(?:[^/?@]*@)?([^/?:]*)", 1), "^www[0-9]*\\.", "")
    port = F.regexp_replace(F.regexp_extract(bare, "^(?:[^/?@]*@)?[^/?:]*(:[0-9]+)?", 1), "^:(80|443)$", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(text.contains("://"), F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), port, F.lit(")"), path)).otherwise(text)


# ---------------------------------------------------------------- files in any store that the tasks reach


def _store(url: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else f"file://{url}")


def record(page: dict) -> bytes:
    """A WARC record of a page (page_id, url, captured, html as bytes, digest, first_id), not compressed; the url must be one line."""
    payload = page["html"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = page["first_id"] is not None
    block = http if revisit else http + payload
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:page:{'' if page['page_id'] is None else page['page_id']}>", "WARC-Date": page["captured"], "WARC-Target-URI": page["url"], "WARC-Payload-Digest": f"sha256:{page['digest']}"}
    if revisit:
        head |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": f"<urn:page:{page['first_id']}>"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {k: batch.column(k)[i].as_py() for k in batch.schema.names}


def write_archives(pages: DataFrame, folder: str, most: int = ARCHIVE_BYTES) -> DataFrame:
    """(file, records, bytes) of archives under `folder` with a record for each page, in the order of (url_key, captured, page_id) within each.

    Pages have page_id, url, url_key, captured, html, digest and first_id (of the page with the same payload that a revisit refers to, else null). Each record is a
    gzip member of its own. Every attempt of a task writes files under new names, and only those that its rows name are ever read, so a lost or repeated
    task leaves nothing behind but files that nobody reads. Archives are closed beyond `most` bytes. The result must be stored: working it out again writes again.
    """

    def make():
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        state: dict = {}

        def close() -> list[tuple]:
            if not state:
                return []
            state["out"].close()
            done = (state["file"], state["records"], state["bytes"])
            state.clear()
            return [done]

        def run(batch: pa.RecordBatch | None):
            done = []
            for page in _rows(batch) if batch is not None else ():
                if not state:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    state.update(file=f"{folder}/{name}", out=store.open_output_stream(f"{root}/{name}", compression=None), records=0, bytes=0)
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = member.compress(record(page)) + member.flush()
                state["out"].write(data)
                state["records"] += 1
                state["bytes"] += len(data)
                if state["bytes"] >= most:
                    done += close()
            if batch is None:
                done += close()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

        run.ends = True
        return run

    return arrow_map(pages.sortWithinPartitions("url_key", "captured", "page_id"), make, "file string, records long, bytes long")


def members(source, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, size, content) of each gzip member of a stream; one member is held at a time."""
    offset, data = 0, source.read(chunk)
    while data:
        out, parts, size = zlib.decompressobj(31), [], 0
        while not out.eof:
            if not data:
                raise ValueError(f"archive ends within the record at {offset}")
            parts.append(out.decompress(data))
            size += len(data) - len(out.unused_data)
            data = out.unused_data if out.eof else source.read(chunk)
        yield offset, size, b"".join(parts)
        offset += size
        data = data or source.read(chunk)


def _headers(stream: io.BytesIO) -> dict[str, str]:
    out = {}
    while (line := stream.readline().rstrip(b"\r\n")) != b"":
        k, _, v = line.decode(errors="replace").partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def parsed(content: bytes) -> dict:
    """The fields and the payload of one WARC record."""
    stream = io.BytesIO(content)
    version = stream.readline().strip()
    if not version.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    head = _headers(stream)
    block = io.BytesIO(stream.read(int(head.get("content-length", 0))))
    http: dict[str, str] = {}
    if head.get("content-type", "").startswith("application/http"):
        block.readline()
        http = _headers(block)
    payload, named = block.read(), head.get("warc-payload-digest", "").rpartition(":")[2] or None
    number = lambda k: head[k].removeprefix("<urn:page:").rstrip(">") if head.get(k, "").startswith("<urn:page:") else None
    revisit = head.get("warc-type") == "revisit"
    digest = named if revisit else hashlib.sha256(payload).hexdigest()
    size = int(http.get("content-length", len(payload))) if revisit else len(payload)
    return {
        "type": head.get("warc-type"), "record_id": head.get("warc-record-id"), "page_id": number("warc-record-id") or None, "url": head.get("warc-target-uri"), "captured": head.get("warc-date"),
        "payload_bytes": size, "payload_digest": digest, "refers_to": number("warc-refers-to"), "intact": named in (None, digest), "payload": payload,
    }


def read_archives(files: DataFrame, payload: bool = False) -> DataFrame:
    """A row for each record of the archives named in `file`, with its place (file, offset, size); its payload as bytes too, if asked for.

    Size and digest of a response are those of the payload that was read, and `intact` says whether they are the ones written; a revisit has those of the
    record it refers to. An archive passes through one task, a record at a time.
    """
    fields = [f.split(" ")[0] for f in _RECORD.split(", ")] + ["payload"] * payload
    kinds = {"offset": pa.int64(), "size": pa.int64(), "payload_bytes": pa.int64(), "intact": pa.bool_(), "payload": pa.binary()}

    def make():
        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in fields], fields)

        def run(batch: pa.RecordBatch):
            rows, held = [], 0
            for name in batch.column("file").to_pylist():
                store, path = _store(name)
                with store.open_input_stream(path, compression=None) as source:
                    for offset, size, content in members(source):
                        row = parsed(content)
                        held += len(row["payload"]) if payload else 200
                        rows.append({k: v for k, v in row.items() if payload or k != "payload"} | {"file": name, "offset": offset, "size": size})
                        if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
            yield batch_of(rows)

        return run

    return arrow_map(files.select("file"), make, _RECORD + ", payload binary" * payload)


# ---------------------------------------------------------------- the index


class Losers:
    """Merges sorted runs: a tree of the losers of matches between them, so the next row takes one match a level."""

    def __init__(self, runs: Iterable[Iterator[tuple]]):
        self.runs = list(runs)
        self.size = max(1, len(self.runs))
        self.head = [next(r, None) for r in self.runs] + [None] * (self.size - len(self.runs))
        self.tree = [-1] * self.size
        for run in range(self.size):
            self._play(run, filling=True)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, run: int, filling: bool = False) -> None:
        at = (run + self.size) // 2
        while at > 0:
            other = self.tree[at]
            if filling and other < 0:  # waits for an opponent
                self.tree[at] = run
                return
            if self._before(other, run):
                self.tree[at], run = run, other
            at //= 2
        self.tree[0] = run

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and (row := self.head[win := self.tree[0]]) is not None:
            yield row
            self.head[win] = next(self.runs[win], None)
            self._play(win)


def _segments(keys: list[tuple], runs: list) -> list[Iterator[tuple]]:
    """Rows that stand run by run, as an iterator of (key, place) for each run."""
    starts = [k for k in range(len(runs)) if k == 0 or runs[k] != runs[k - 1]] + [len(runs)]
    return [((keys[k], k) for k in range(a, b)) for a, b in zip(starts, starts[1:])]


def _merge():
    """Of one range's rows, run by run in their order: the rows in the order of (url_key, captured, page, run)."""
    held: list[pa.RecordBatch] = []

    def run(batch: pa.RecordBatch | None):
        if batch is not None:
            if batch.num_rows:
                held.append(batch)
            return
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        columns = [rows.column(c).to_pylist() for c in ("url_key", "captured", "page")]
        keys = [(u, t, p is not None, p or 0) for u, t, p in zip(*columns)]
        order = [k for _, k in Losers(_segments(keys, rows.column("file").to_pylist()))]
        yield from rows.take(pa.array(order, pa.int64())).to_batches(max_chunksize=BATCH_ROWS)

    run.ends = True
    return run


#: Captures that one task merges, as a mean.
RANGE_ROWS = 100_000


def capture_index(captures: DataFrame, stored: Stored) -> DataFrame:
    """The captures of archives (rows of read_archives() with url_key) in global order of URL key and time: `place` counts them from 0, `capture` within their URL.

    Each archive is a sorted run. Ranges of the key (with time, page and place, so one frequent URL is spread over many) go to
    tasks, each of which gets a segment of every run and merges them by a tree of losers; RANGE_ROWS captures are what a task holds.
    """
    spark, schema = captures.sparkSession, "file string, offset long, size long, type string, page long, url_key string, captured string, payload_bytes long, payload_digest string, refers_to long"
    runs = stored.put(captures.select(*(f.split(" ")[0] for f in schema.split(", "))), "runs")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    keys = ["url_key", "captured", "page", "file", "offset"]
    dealt = runs.repartitionByRange(parts, *keys).sortWithinPartitions("file", "offset")  # segments by number; texts are compared in the merge only
    merged = stored.put(arrow_map(dealt, _merge, schema).withColumn("at", F.monotonically_increasing_id()), "merged")
    return places(places(merged, ["url_key"], i="capture", n="captures"), [], i="place", n="all").drop("at", "all")


def archive_pages(pages: DataFrame, captured: Column | None = None, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes pages (page_id, url, html) as archives, reads them back, and gives their index: page_id, payload_bytes, payload_digest, record_type, refers_to,
    url_key, captured, capture, place, file, offset, size.

    The payload is the html in UTF-8, none for null. Of equal payloads of at least `least` bytes the one with the smallest page_id is a response and the others are
    revisits that refer to it; all others are responses. Rows that repeat the smallest page_id are responses, too; a row without an id is a revisit
    if a row with one has its payload, and is never referred to. `captured` is a text like 2024-01-01T00:00:00Z; by default page_id counts seconds from
    there. Blanks and control characters in URLs are written as %20; null URLs are empty. Other columns are ignored. An empty table gives no rows.

    Payloads are compared by SHA-256. Groups of equal payloads are counted before they meet their rows, and that join is one whose large
    partitions adaptive execution splits.
    """
    spark = pages.sparkSession
    stored = Stored(spark)
    when = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(31536000))), "yyyy-MM-dd'T'HH:mm:ss'Z'") if captured is None else captured
    url = F.regexp_replace(F.trim(F.coalesce("url", F.lit(""))), "[\\p{Z}\\p{C}]+", "%20")
    html = F.coalesce("html", F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), when.alias("captured"), html.cast("binary").alias("html"), F.sha2(html, 256).alias("digest"))
    large = F.octet_length("html") >= least
    first = stored.put(own.where(large).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("times")).where("times > 1").drop("times"), "first")
    rows = own.join(first, "digest", "left").withColumn("first_id", F.when(large & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")))
    files = stored.put(write_archives(rows.withColumn("url_key", url_key(F.col("url"))), f"{stored.root}/archives"), "archives")
    found = read_archives(files.repartition(max(1, files.count()), "file")).withColumns({"url_key": url_key(F.col("url")), "page": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})
    index = capture_index(found, stored)
    return index.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "url_key", "captured", "capture", "place", "file", "offset", "size")
