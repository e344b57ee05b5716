"""WARC archives: write, read back, and merge the capture index.

Every row becomes a WARC/1.1 record. Of records with equal payloads of at
least ``min_payload`` bytes the one with the smallest page id is a response and
the others are revisits that refer to it. Records are written by Spark's text
writer, whose record separator is the two line ends that close a WARC record,
so each part file is a valid archive in whatever store the folder is in, and
a lost task writes its file anew. Files are bounded in records and in bytes: records go
to classes of sizes, each with half the records a file of the one before; a
record above the bound is a file of its own (one must stay below 2 GB).

Reading takes every archive as bytes, walks its records by Content-Length and
yields one capture a record. Each archive's captures form a run sorted by URL
key and timestamp. The runs are range-partitioned by (key, timestamp, page id)
and every partition merges its slices of the runs with a loser tree: together
the partitions are the globally ordered capture histories. As the timestamp is
part of the range, a URL with a third of all captures spans several
partitions; each holds a bounded number of narrow index rows.

Defined cases: a null html counts as empty; a null URL has the key ""; empty
and short payloads are always responses; rows that repeat a page id are
records of their own, and with equal payloads have the same type; a null page
id loses to every other (copies that all lack an id are responses); an empty table gives no archive and an empty result; other columns
are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.common import cut, text_or_empty

CRLF = "\r\n"
CAPTURES = ("page_id long, url_key string, captured_at string, record_type string, refers_to long, "
            "payload_bytes long, payload_digest string, archive string, at long, length long")
RECORDS_PER_ARCHIVE = 2000
ARCHIVE_BYTES = 256 << 20
HEAD_BYTES = 1024                # header fields of a record but its URL, at most
ROWS_PER_MERGE = 50_000
BROADCAST_GROUPS = 200_000
MARK_BITS = 16                   # of the bitmap, for each group
MARK_BUCKETS = 8192              # of 4 KB: 32 MB


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def decide(pages: DataFrame, min_payload: int, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Add payload, its size and digest, and the response a revisit refers to.

    Payloads stay where they are read: the groups of equal ones, as (digest,
    smallest id), are broadcast up to ``broadcast_groups``. Beyond that a
    broadcast bitmap of their digests tells which rows may be in a group, and
    only those are shuffled.
    """
    rows = (pages.select("page_id", "url", "captured_at", text_or_empty("html").alias("payload"))
            .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
            .withColumn("payload_digest", F.sha2("payload", 256)))
    # equal payloads are reduced to (digest, smallest id) before they meet; only groups of two or more go on
    first = cut(rows.where(F.col("payload_bytes") >= min_payload).groupBy("payload_digest")
                .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
                .where("copies > 1 and first_id is not null").select("payload_digest", "first_id"))
    groups = first.count()
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    refers_to = F.when(revisit, F.col("first_id"))
    if groups <= broadcast_groups:
        return rows.join(F.broadcast(first), "payload_digest", "left").withColumn("refers_to", refers_to)
    marked = mark(rows, first, groups)
    shared = marked.where("marked").join(first, "payload_digest", "left").withColumn("refers_to", refers_to)
    alone = marked.where("not marked").withColumn("refers_to", F.lit(None).cast("long"))
    columns = [*rows.columns, "refers_to"]
    return alone.select(columns).unionByName(shared.select(columns))


def mark(rows: DataFrame, first: DataFrame, groups: int) -> DataFrame:
    """Add whether a row's digest may be in ``first`` (``marked``), without shuffling ``rows``.

    The digests of ``first`` set bits of a bitmap that is broadcast. False for
    a digest of ``first`` never, true for another one of about ``MARK_BITS``.
    """
    buckets = min(MARK_BUCKETS, -(-MARK_BITS * groups // 32768))       # of the bitmap functions' 32,768 bits
    place = F.pmod(F.xxhash64("payload_digest"), F.lit(32768 * buckets)) + 1
    bits = (first.select(F.bitmap_bucket_number(place).alias("__bucket"), F.bitmap_bit_position(place).alias("__bit"))
            .groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits")))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return (rows.withColumn("__bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "__bucket", "left")
            .withColumn("marked", found).drop("__bucket", "__bits"))


def records(rows: DataFrame) -> DataFrame:
    """One string a row: a WARC record without the two line ends that close it."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A")),
        line("WARC-Date", F.col("captured_at")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", record_id(F.col("refers_to"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF))
    return rows.select(F.concat(head, block).alias("value"))


def size_class(payload_bytes: Column, records_per_archive: int, archive_bytes: int) -> Column:
    """k for records of at most 2^k times the bytes that each of ``records_per_archive`` may have."""
    bound = payload_bytes + 3 * F.octet_length(F.coalesce("url", F.lit(""))) + HEAD_BYTES
    ordinary = max(1, archive_bytes // records_per_archive)
    return sum((F.when(bound > ordinary << k, 1).otherwise(0) for k in range(records_per_archive.bit_length())), F.lit(0))


def write_archives(pages: DataFrame, path: str, min_payload: int = 100,
                   records_per_archive: int = RECORDS_PER_ARCHIVE, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``pages`` (page_id, url, html, captured_at) as archives into a new folder."""
    sizes = pages.select(size_class(F.octet_length(text_or_empty("html")), records_per_archive, archive_bytes).alias("k"))
    present = [r["k"] for r in sizes.distinct().collect()]          # a dozen at most
    rows = decide(pages, min_payload).withColumn("__class", size_class(F.col("payload_bytes"), records_per_archive, archive_bytes))
    for k in sorted(present) or [0]:
        (records(rows.where(F.col("__class") == k)).write.mode("append").option("lineSep", CRLF * 2)
         .option("maxRecordsPerFile", max(1, records_per_archive >> k)).text(path))


def url_key(url: str) -> str:
    """Sortable key: host labels reversed, then path and query (scheme, port and fragment left out)."""
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname or ""
    except ValueError:
        return url
    if host.startswith("www."):
        host = host[4:]
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")


def walk(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields in lower case, block) of every record."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:end].decode().split(CRLF)
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        start = end + 4
        stop = start + int(fields["content-length"])
        if archive[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield at, stop + 4 - at, fields, archive[start:stop]
        at = stop + 4


def _page_id(urn: str) -> int | None:
    value = urn[len("<urn:page:"):-1]
    return None if value == "null" else int(value)


def captures_of(archive: bytes, name: str) -> list[tuple]:
    """The captures of one archive as CAPTURES rows, sorted by URL key, timestamp and page id: a run."""
    import hashlib
    out = []
    for at, length, f, block in walk(archive):
        http, _, payload = block.partition(b"\r\n\r\n")
        digest, size = f["warc-payload-digest"].removeprefix("sha256:"), len(payload)
        target = None
        if f["warc-type"] == "revisit":
            target = _page_id(f["warc-refers-to"])
            size = int(http.rpartition(b"Content-Length: ")[2])
        elif hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload digest of {f['warc-record-id']} differs")
        out.append((_page_id(f["warc-record-id"]), url_key(f["warc-target-uri"]), f["warc-date"], f["warc-type"],
                    target, size, digest, name, at, length))
    return sorted(out, key=lambda r: (r[1], r[2], r[0] is not None, r[0]))


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """One CAPTURES row per record of the archives below ``path``."""
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(),
             pa.int64(), pa.int64()]
    names = [x.split()[0] for x in CAPTURES.split(", ")]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = captures_of(batch.column(1)[k].as_py(), batch.column(0)[k].as_py())
                cols = list(zip(*rows)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=names)

    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
            .select("path", "content").mapInArrow(read, CAPTURES))


class LoserTree:
    """k-way merge of sorted lists: each step replays one path, about log2(k) comparisons."""

    _END = (1,)                 # sorts after every (0, key)

    def __init__(self, runs: list[list], key):
        self.runs, self.key = runs, key
        self.at = [0] * len(runs)
        self.heads = [self._head(r) for r in range(len(runs))]
        k = len(runs)
        # inner nodes 1..k-1 keep losers; leaves k..2k-1 are the runs
        winners = [0] * k + list(range(k))
        self.losers = [0] * k
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.heads[a] <= self.heads[b] else (b, a)
        self.winner = winners[1] if k > 1 else 0

    def _head(self, run: int):
        rows = self.runs[run]
        return (0, self.key(rows[self.at[run]])) if self.at[run] < len(rows) else self._END

    def __iter__(self):
        while self.runs and self.heads[self.winner] != self._END:
            run = self.winner
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self.heads[run] = self._head(run)
            node = (run + len(self.runs)) // 2
            while node >= 1 and len(self.runs) > 1:
                other = self.losers[node]
                if self.heads[other] < self.heads[run]:
                    self.losers[node], run = run, other
                node //= 2
            self.winner = run


def merge_index(captures: DataFrame, partitions: int | None = None) -> DataFrame:
    """Captures in global order of (url_key, captured_at, page_id), with ``order``, increasing in that order.

    ``captures`` is counted, so that a partition holds about ``ROWS_PER_MERGE`` of them.
    """
    keys = ["url_key", "captured_at", F.col("page_id").asc_nulls_first()]
    partitions = partitions or max(1, -(-captures.count() // ROWS_PER_MERGE))
    ranged = captures.repartitionByRange(partitions, *keys)
    schema = CAPTURES + ", order long"

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[dict]] = {}
        for batch in batches:                        # rows of a run arrive in the run's order
            for row in batch.to_pylist():
                runs.setdefault(row["archive"], []).append(row)
        tree = LoserTree(list(runs.values()), key=lambda r: (r["url_key"], r["captured_at"],
                                                             r["page_id"] is not None, r["page_id"] or 0,
                                                             r["archive"], r["at"]))
        base, out, n = TaskContext.get().partitionId() << 40, [], 0
        for row in tree:
            out.append(row | {"order": base + n})
            n += 1
            if len(out) == 1000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    sorted_runs = ranged.sortWithinPartitions("archive", *keys, "at")
    return sorted_runs.mapInArrow(merge, schema)


def _rows(rows: list[dict]) -> pa.RecordBatch:
    text = {"url_key", "captured_at", "record_type", "payload_digest", "archive"}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], type=pa.string() if n in text else pa.int64())
                                       for n in rows[0]], names=list(rows[0]))


def archive_pages(spark: SparkSession, pages: DataFrame, path: str, min_payload: int = 100) -> DataFrame:
    """Write ``pages`` to ``path``, read the archives back and return their merged capture index."""
    write_archives(pages, path, min_payload)
    return merge_index(cut(read_captures(spark, path)))
