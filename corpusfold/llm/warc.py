"""Operator 10 - WARC archives with an index made by external merge.

Writing. Each page becomes a WARC/1.1 record (gzip member of its own): a
``response`` with the HTTP head and the html, or, for a payload of ``LEAST_BYTES``
or more that a page of larger page_id has too, a ``revisit`` with the head only
that refers to that page's record. Digests are SHA-1, identity of payloads is
SHA-1 and length. Tasks write archive parts: rows (archive, part, bytes) of a
binary column through Spark's own writer, whose commit makes retried and lost
tasks harmless on any store; an archive file is its parts in order.

Index. Every archive's captures are sorted by URL key (host reversed, then path),
timestamp and page_id: a *run*. Runs are cut at global boundaries (from a sample of
keys that only balances), packed in sorted blocks, and each range is merged by one
task, k runs at a time by a loser tree, where each output costs log2 k
comparisons and each run holds one block in memory. Ranges are in order too, so
the parts together are the ordered capture history.

Reading. ``read_records`` decompresses each member and parses it; the query checks
payloads against their digests and takes its rows from the records read back
through the merged index (archive, part, offset, length).

Stand-in. `pages` has no capture time; a page's is ``EPOCH`` plus page_id seconds.

Cases. Null html: an empty payload. Null url: key ``-``, target URI omitted. A null
page_id: the record has no page number; it is always a response and never referred
to. Rows that share a page_id are separate records; of equal payloads one of them
is the response, the others of the same page_id revisit it. Very long pages are
whole records. Other columns are ignored; an empty table writes and returns nothing.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusfold.llm.common import on_workers, read_table
from corpusfold.session import cut_lineage, scratch_path

LEAST_BYTES = 1000
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
PART_BYTES = 4 << 20
RUN_BLOCK = 512                 # captures of a packed block of a run
GZIP_LEVEL = 1
READ_BYTES = 1 << 13            # compressed bytes read at once
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n"


def url_key(url: str | None) -> str:
    """Sort-friendly key of a URL: reversed host, then port, path and query, lower-cased, without fragment."""
    if not url:
        return "-"
    rest = url.split("#", 1)[0].split("://", 1)[-1].lower()
    host, slash, path = rest.partition("/")
    host, _, port = host.rpartition("@")[2].partition(":")
    parts = host.split(".")
    if parts[0] == "www":
        parts = parts[1:]
    return ",".join(reversed(parts)) + (f":{port}" if port else "") + ")" + slash + path


def timestamp(page_id: int | None) -> datetime:
    return EPOCH + timedelta(seconds=(page_id or 0) % (10 ** 9))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, as a gzip member."""
    head = _HEAD % len(payload)
    body = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
              ("WARC-Date", timestamp(page_id).strftime("%Y-%m-%dT%H:%M:%SZ")),
              ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields.append(("Content-Length", str(len(body))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(text.encode() + body + b"\r\n\r\n", GZIP_LEVEL, mtime=0)


def read_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, fields, body) of each record of an archive part."""
    view, at = memoryview(data), 0
    while at < len(data):
        member, end, out = zlib.decompressobj(wbits=31), at, []
        while not member.eof:
            if end >= len(data):
                raise ValueError(f"the record at {at} does not end")
            out.append(member.decompress(view[end:end + READ_BYTES]))
            end += READ_BYTES
        raw, size = b"".join(out), min(end, len(data)) - at - len(member.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        yield at, size, fields, rest[:int(fields["Content-Length"])]
        at += size


def _page(uri: str | None) -> int | None:
    number = uri[len("<urn:page:"):-1] if uri else ""
    return int(number) if number else None


def _archive_parts(batches):
    """Archive parts of a task, and the captures they hold as a sorted, packed run."""
    archive, part, held, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        for row in batch.to_pylist():
            payload = (row["html"] or "").encode()
            held.append(record(row["page_id"], row["url"], payload, hashlib.sha1(payload).hexdigest(), row["refers_to"]))
            size += len(held[-1])
            if size >= PART_BYTES:
                yield _part(archive, part, held)
                part, held, size = part + 1, [], 0
    if held:
        yield _part(archive, part, held)


def _part(archive: int, part: int, records: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([archive], pa.int32()), pa.array([part], pa.int32()), pa.array([b"".join(records)], pa.binary())],
                                      names=["archive", "part", "warc"])


def write_archives(pages: DataFrame, out: str) -> None:
    """Write ``pages`` (page_id, url, html) as archive parts under ``out``."""
    on_workers(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    same = ["digest", "size"]
    rows = pages.select("page_id", "url", "html", F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).alias("size"))
    # digests that several pages have, one row each; written, so that a hot digest can be split in the join
    copied = cut_lineage(rows.where((F.col("size") >= LEAST_BYTES) & F.col("page_id").isNotNull()).groupBy(*same)
                         .agg(F.max("page_id").alias("keeper"), F.count("*").alias("k")).where("k > 1"))
    keys = cut_lineage(pages.select("page_id").where("page_id is not null").groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1"))
    joined = rows.join(copied.drop("k"), same, "left")
    # rows that repeat the keeper's page_id: the first of them (by url) is the response
    twin = (joined.where("page_id = keeper").join(keys.select("page_id"), "page_id", "left_semi")
            .groupBy("page_id", *same).agg(F.min(F.struct(F.col("url").isNotNull(), F.col("url"))).alias("u"))
            .select("page_id", *same, F.col("u.url").alias("first_url"), F.lit(True).alias("twin")))
    refers = F.when(F.col("page_id") < F.col("keeper"), F.col("keeper")).when(
        F.col("twin") & ~F.col("url").eqNullSafe(F.col("first_url")), F.col("keeper"))
    joined = joined.join(cut_lineage(twin), ["page_id", *same], "left") if keys.limit(1).count() else joined.withColumns(
        {"first_url": F.lit(None).cast("string"), "twin": F.lit(False)})
    (joined.select("page_id", "url", "html", refers.alias("refers_to"))
     .mapInArrow(_archive_parts, "archive int, part int, warc binary").write.parquet(out))


_CAPTURE = [("urlkey", pa.string()), ("stamp", pa.int64()), ("page_id", pa.int64()), ("archive", pa.int32()), ("part", pa.int32()),
            ("offset", pa.int64()), ("length", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("record_type", pa.string()), ("refers_to", pa.int64())]
_CAPTURE_SCHEMA = pa.schema(_CAPTURE)
_CAPTURE_DDL = ("urlkey string, stamp long, page_id long, archive int, part int, offset long, length long, payload_bytes long, "
                "payload_digest string, record_type string, refers_to long")


def _captures(batches):
    """Every record of every archive part, read back and checked."""
    for batch in batches:
        for archive, part, data in zip(batch.column("archive").to_pylist(), batch.column("part").to_pylist(), batch.column("warc")):
            rows = []
            for offset, length, f, body in read_records(data.as_py()):
                head, _, payload = body.partition(b"\r\n\r\n")
                size = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
                digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                if f["WARC-Type"] == "response":
                    size, read = len(payload), hashlib.sha1(payload).hexdigest()
                    if read != digest:
                        raise ValueError(f"archive {archive}, part {part}: digest of the record at {offset}")
                page = _page(f["WARC-Record-ID"])
                stamp = int(datetime.strptime(f["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp())
                rows.append((url_key(f.get("WARC-Target-URI")), stamp, page, archive, part, offset, length, size, digest,
                             f["WARC-Type"], _page(f.get("WARC-Refers-To"))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _CAPTURE)], schema=_CAPTURE_SCHEMA)


def capture_key(row: dict) -> tuple:
    return row["urlkey"].encode(), row["stamp"], row["page_id"] is not None, row["page_id"] or 0, row["archive"], row["part"], row["offset"]


class LoserTree:
    """k-way merge of sorted iterators: an inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[Iterator], key):
        self.key = key
        self.runs = [iter(r) for r in runs]
        self.k = len(runs)
        self.heads: list = [None] * self.k
        self.keys: list = [None] * self.k               # None: the run has ended
        for i in range(self.k):
            self._next(i)
        self.loser = [-1] * max(self.k, 1)
        self.winner = self._build(1) if self.k else -1

    def _next(self, i: int) -> None:
        self.heads[i] = next(self.runs[i], None)
        self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])

    def _before(self, i: int, j: int) -> bool:
        a, b = self.keys[i], self.keys[j]
        return b is None or (a is not None and a <= b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._before(a, b) else (b, a)
        self.loser[node] = lose
        return win

    def __iter__(self) -> Iterator:
        while self.k and self.keys[self.winner] is not None:
            i = self.winner
            yield self.heads[i]
            self._next(i)
            node = (i + self.k) // 2
            while node:
                if not self._before(i, self.loser[node]):
                    self.loser[node], i = i, self.loser[node]
                node //= 2
            self.winner = i


def _packed(rows: list[dict]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _CAPTURE_SCHEMA, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(pa.Table.from_pylist(rows, schema=_CAPTURE_SCHEMA))
    return sink.getvalue().to_pybytes()


def _unpacked(block: bytes) -> list[dict]:
    return pa.ipc.open_stream(block).read_all().to_pylist()


_BLOCK = "range int, run long, seq int, block binary"


def _runs(bounds: list[tuple]):
    """The captures of a task as a sorted run, cut at the bounds and packed in blocks."""
    from bisect import bisect_right

    def run(batches):
        name = TaskContext.get().partitionId()
        rows = sorted((r for b in batches for r in b.to_pylist()), key=capture_key)
        lo = 0
        while lo < len(rows):
            where = bisect_right(bounds, capture_key(rows[lo])[:4])
            hi = lo + 1
            while hi < len(rows) and hi - lo < RUN_BLOCK and bisect_right(bounds, capture_key(rows[hi])[:4]) == where:
                hi += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([where], pa.int32()), pa.array([name], pa.int64()), pa.array([lo], pa.int32()), pa.array([_packed(rows[lo:hi])], pa.binary())],
                names=["range", "run", "seq", "block"])
            lo = hi
    return run


def _merge(key, table):
    """One range: its runs' blocks, merged by a loser tree; a run's next block is unpacked when the last one is used up."""
    where = key[0].as_py()
    blocks: dict[int, list] = {}
    for run, seq, i in sorted(zip(table.column("run").to_pylist(), table.column("seq").to_pylist(), range(table.num_rows))):
        blocks.setdefault(run, []).append(i)
    packed = table.column("block")

    def rows(of: list[int]) -> Iterator[dict]:
        for i in of:
            yield from _unpacked(packed[i].as_py())

    merged = list(LoserTree([rows(b) for b in blocks.values()], capture_key))
    out = pa.Table.from_pylist(merged, schema=_CAPTURE_SCHEMA)
    out = out.append_column("range", pa.array([where] * len(merged), pa.int32()))
    return out.append_column("place", pa.array(range(len(merged)), pa.int64()))


RANGE_ROWS = 20000              # captures of a range, while the sample has enough keys to cut so many
SAMPLE_KEYS = 1 << 16           # keys that the driver cuts ranges by, whatever the number of captures


def capture_index(spark: SparkSession, archives: str) -> DataFrame:
    """Captures of all archives read back, in global order by (range, place): URL key, timestamp, page_id."""
    on_workers(spark)
    parts = spark.read.schema("archive int, part int, warc binary").parquet(archives)
    captures = cut_lineage(parts.mapInArrow(_captures, _CAPTURE_DDL))
    n = captures.count()
    ranges = max(1, min(-(-n // RANGE_ROWS), SAMPLE_KEYS // 8))
    bounds: list[tuple] = []
    if ranges > 1:
        # the sample only balances the ranges
        sample = captures.sample(False, min(1.0, SAMPLE_KEYS / n), 10).select(
            "urlkey", "stamp", "page_id", "archive", "part", "offset")
        keys = sorted(capture_key(r.asDict())[:4] for r in sample.collect())
        bounds = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []
    blocks = captures.mapInArrow(_runs(bounds), _BLOCK)
    return blocks.groupBy("range").applyInArrow(_merge, _CAPTURE_DDL + ", range int, place long")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over all `pages`: archived and read back through the merged capture index, a row per page."""
    out = scratch_path(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages"), out)
    return capture_index(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
