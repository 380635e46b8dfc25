"""WARC archives: write, read back, and merge capture indexes into globally ordered histories.

Archives are WARC/1.1 files with a gzip member for each record, so a record is read alone from its
offset and length. They are written through Spark's text sink: a row holds the members of several
records but for the last byte, which is the sink's line separator (a gzip member ends in the high
byte of its size, zero below 16 MB; an empty member follows a larger one). So they go to any file
system Spark can write and survive lost executors by its commit protocol. Rows are cut by bytes
and files by rows, so a file has a bounded size, but for a record that is larger by itself.

The index follows the method of external merging: each archive gives a run of entries sorted by
URL key and time; runs are cut at common key ranges, and within a range a loser tree merges the
cuts of all runs, so that ranges in order are the global order. The range key ends in the record's
id, so a URL with very many captures is spread over ranges; its ranks go on from range to range.

Cases: null payloads are empty ones; null URLs get an empty target; null ids stay null (their
records are named by URL and payload, and refer to a record with an id where one has the payload);
repeated rows each get a record (rows with the response's own id are all responses); an empty table
gives archives without records; other columns are left aside.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialize, scratch_path

CRLF = "\r\n"
END = b"\r\n\r\n"
#: Second of the first capture; a page without a time of its own is captured at this plus its id's remainder.
EPOCH, SPAN = 1_700_000_000, 1 << 30
#: Unpacked bytes of a row of members, rows of a file; revisited digests that are broadcast (28 bytes each), counted before.
ROW_BYTES, FILE_ROWS, BROADCAST_DIGESTS = 4 << 20, 32, 500_000
#: Index entries of a range.
RANGE_ROWS = 100_000
INDEX_SCHEMA = (
    "url_key string, captured_at long, record_id long, target string, record_type string, payload_digest string, "
    "payload_bytes long, refers_to long, archive string, offset long, length long"
)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """A sortable key: host labels reversed and comma-joined, then the rest, without scheme and fragment."""
    _, _, rest = (url or "").partition("://")
    rest = rest.partition("#")[0]
    cut = min((p for p in (rest.find("/"), rest.find("?")) if p >= 0), default=len(rest))
    host, tail = rest[:cut].lower(), rest[cut:]
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (tail or "/") if host else ""


def record(record_id: int | None, target: str, at: int, kind: str, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One record with the CRLFs after it; a revisit's block has the HTTP head only."""
    import time

    head = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF}{CRLF}".encode()
    block = head if kind == "revisit" else head + payload
    stamp = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(at))
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(f'{target} {payload_digest}' if record_id is None else record_id)}", f"WARC-Date: {stamp}"]
    if record_id is not None:
        lines.append(f"X-Record-Key: {record_id}")
    if target:
        lines.append("WARC-Target-URI: " + target.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Key: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return (CRLF.join(lines) + CRLF + CRLF).encode() + block + END


def _urn(name: int | str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(name))}>"


def member(data: bytes) -> bytes:
    """A gzip member that ends in a zero byte; an empty one follows where the size doesn't end so."""
    packed = gzip.compress(data, 6, mtime=0)
    return packed if packed.endswith(b"\0") else packed + gzip.compress(b"", 6, mtime=0)


def plan_records(pages: DataFrame, key: str, url: str, html: str, min_bytes: int) -> DataFrame:
    """(record_id, url, html, record_type, refers_to) for each row.

    Counts per payload are reduced before they are shuffled, so that a payload with a third of all
    rows costs a row per task. Only payloads that occur twice join back, as digest and id: they are
    broadcast while their counted rows stay under a limit, and beyond it the join has a row per
    digest on that side, so a very common payload can be split.
    """
    sha1 = F.unhex(F.sha1(F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")))
    rows = pages.select(F.col(key).cast("long").alias("record_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", sha1).withColumn("bytes", F.octet_length("html").cast("long"))
    shared = rows.where(F.col("bytes") >= min_bytes).groupBy("sha").agg(F.max("record_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL").drop("n")
    shared = materialize(shared, "shared-payloads")
    joined = rows.join(F.broadcast(shared) if shared.count() <= BROADCAST_DIGESTS else shared, "sha", "left")
    other = F.col("first_id").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first_id"))
    return joined.select("record_id", "url", "html", F.when(other, "revisit").otherwise("response").alias("record_type"), F.when(other, F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, row_bytes: int = ROW_BYTES, file_rows: int = FILE_ROWS) -> str:
    """Write a record for each row below ``path``; equal payloads of at least ``min_bytes`` are stored once."""
    planned = plan_records(pages, key, url, html, min_bytes)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for rid, target, text, kind, refers in zip(*(batch.column(c) for c in ("record_id", "url", "html", "record_type", "refers_to")), strict=True):
                payload, number = text.as_py().encode(), rid.as_py()
                made = record(number, target.as_py() or "", EPOCH + (number or 0) % SPAN, kind.as_py(), payload, digest(payload), refers.as_py())
                held.append(member(made))
                size += len(made)
                if size >= row_bytes:
                    yield _row(held)
                    held, size = [], 0
        if held:
            yield _row(held)

    def _row(held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])

    records = planned.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.option("lineSep", "\0").option("maxRecordsPerFile", file_rows).option("compression", "none").mode("overwrite").text(path)
    return path


def members(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(unpacked bytes, offset, length) of each gzip member that isn't empty, one at a time."""
    view, at = memoryview(data), 0
    while at < len(data):
        unpack, parts, start = zlib.decompressobj(wbits=31), [], at
        while not unpack.eof:
            if at >= len(data):
                raise ValueError(f"the member at byte {start} is cut short")
            parts.append(unpack.decompress(view[at : at + (1 << 16)]))
            at = min(len(data), at + (1 << 16)) - len(unpack.unused_data)
        if whole := b"".join(parts):
            yield whole, start, at - start


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, by the size in its headers."""
    end = data.index(END)
    lines = data[:end].decode().split(CRLF)
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    if len(data) != end + 4 + size + 4:
        raise ValueError("a record's size doesn't fit its header")
    return headers, data[end + 4 : end + 4 + size]


def read_index_runs(spark: SparkSession, path: str) -> DataFrame:
    """One run per archive: its entries in order of URL key, time and record id; offsets and lengths are those in the file.

    Payload digests and sizes of responses are recomputed from the payload read back, and differing
    from the header is an error; those of revisits are the header's.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import calendar
        import time

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for data, offset, length in members(content.as_py()):
                    headers, block = parse_record(data)
                    head, _, payload = block.partition(END)
                    fields = dict(line.split(": ", 1) for line in head.decode().split(CRLF)[1:])
                    kind, size = headers["WARC-Type"], int(fields["Content-Length"])
                    said = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != size or digest(payload) != said):
                        raise ValueError(f"the payload at byte {offset} of {name} doesn't fit its header")
                    at = calendar.timegm(time.strptime(headers["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ"))
                    own, refers = headers.get("X-Record-Key"), headers.get("X-Refers-To-Key")
                    target = headers.get("WARC-Target-URI", "")
                    rows.append((url_key(target), at, None if own is None else int(own), target, kind, said, size, None if refers is None else int(refers), name, offset, length))
                rows.sort(key=lambda r: _order(r[0], r[1], r[2]))
                columns = list(zip(*rows, strict=True)) or [()] * 11
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                names = [c.strip().split(" ")[0] for c in INDEX_SCHEMA.split(",")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return files.mapInArrow(index, INDEX_SCHEMA)


def _order(key: str, at: int, record_id: int | None) -> tuple:
    """By bytes of the key, time and id; null ids first."""
    return key.encode(), at, record_id is not None, record_id or 0


class LoserTree:
    """k-way merging of sorted runs: one comparison per level for each entry that leaves.

    ``nodes[0]`` is the winner, the others hold the loser of the match played there; an ended run
    loses to all others.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.size = max(1, len(runs))
        self.heads = [next(run, None) for run in runs] or [None]
        self.nodes = [-1] * self.size
        for leaf in range(self.size):
            self._play(leaf)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b)) if x is not None or y is not None else a < b

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.size) // 2
        while node > 0:
            if self.nodes[node] == -1:
                self.nodes[node] = winner
                return
            if self._less(self.nodes[node], winner):
                self.nodes[node], winner = winner, self.nodes[node]
            node //= 2
        self.nodes[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.heads[self.nodes[0]] is not None:
            run = self.nodes[0]
            yield self.heads[run]
            self.heads[run] = next(self.runs[run], None) if self.runs else None
            self._play(run)


def merge_index(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The runs' entries, which must be materialized, in global order of (url_key, captured_at, record_id), over range partitions.

    Adds ``history_rank``, an entry's place, from 0, among all captures of its URL key, and
    ``range_id``: ranges in order are the global order.
    """
    n = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // range_rows))
    cut = runs.repartitionByRange(n, F.encode("url_key", "UTF-8"), F.col("captured_at"), F.col("record_id"))
    names = runs.columns

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = pa.Table.from_batches(held) if (held := list(batches)) else None
        if table is None or not table.num_rows:
            return
        keys = [(_order(*k), i) for i, k in enumerate(zip(*(table.column(c).to_pylist() for c in ("url_key", "captured_at", "record_id")), strict=True))]
        cuts: dict[str, list] = {}
        for name, key in zip(table.column("archive").to_pylist(), keys, strict=True):
            cuts.setdefault(name, []).append(key)
        for run in cuts.values():  # what a run sent may come in several blocks, out of order
            if any(a > b for a, b in zip(run[:-1], run[1:], strict=True)):
                run.sort()
        order, ranks, last, rank = [], [], None, 0
        for key, at in LoserTree([iter(cuts[name]) for name in sorted(cuts)]):
            rank = rank + 1 if key[0] == last else 0
            last = key[0]
            order.append(at)
            ranks.append(rank)
        out = table.select(names).take(pa.array(order, pa.int64()))
        out = out.append_column("place", pa.array(ranks, pa.int64()))
        out = out.append_column("range_id", pa.array(np.full(len(order), TaskContext.get().partitionId()), pa.int32()))
        yield from out.to_batches(max_chunksize=10_000)

    merged = materialize(cut.mapInArrow(merge, INDEX_SCHEMA + ", place long, range_id int"), "warc-merged")
    # Ranges are in the order of keys, so each has two keys at most that other ranges hold too.
    counts = merged.groupBy("url_key", "range_id").agg(F.count("*").alias("n"))
    spread = counts.withColumn("ranges", F.count("*").over(Window.partitionBy("url_key"))).where("ranges > 1")
    before = spread.select("url_key", "range_id", (F.sum("n").over(Window.partitionBy("url_key").orderBy("range_id")) - F.col("n")).alias("before"))
    ranked = merged.join(F.broadcast(before), ["url_key", "range_id"], "left")
    return ranked.select(*names, (F.col("place") + F.coalesce("before", F.lit(0))).alias("history_rank"), "range_id")


def capture_index(pages: DataFrame, path: str | None = None, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives (at ``path``, or in the shared folder), read them back and merge their index."""
    spark = pages.sparkSession
    path = write_archives(pages, path or scratch_path(spark, "warc"), key, url, html, min_bytes)
    runs = materialize(read_index_runs(spark, path), "warc-runs")
    return merge_index(runs)
