"""WARC archives and a two-level capture index.

Every page is a record of its own gzip member. Of equal payloads the one with the smallest page_id is a
response, others are revisits that refer to it and carry no payload. The index sorts captures by reversed
host and path (``com,example)/path``) into compressed blocks inside range-partitioned shards; each shard
ends in a sparse directory, one key per block, and the manifest has one row per shard. A lookup bisects the
manifest, then a shard's directory, reads one block, and reads the record by its range. ``archived`` looks
all pages up that way, keys sorted by shard; ``CaptureIndex`` looks up a single URL.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AtomicFile, filesystem, small, work_dir, written
from .sstable import Shard, ShardWriter

#: Payloads of fewer bytes are never revisits.
LEAST = 100
SALTS = 16
ARCHIVE_BYTES = 1 << 30
INDEX_BLOCK = 64 << 10
#: Captures of an index shard, about; a small index has a shard for each core, of SHARD_LEAST captures at least.
SHARD_CAPTURES, SHARD_LEAST = 500_000, 1000
#: Ranges this close are read at once; archive bytes that a task reads back, about.
READ_BYTES, TASK_BYTES = 4 << 20, 128 << 20
DATE = "1970-01-01T00:00:00Z"  # pages have no capture time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "surt string, page_id long, part int, path string, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def surt(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, then port, path and query; scheme and user dropped."""
    try:
        u = urlsplit((url or "").strip())
        host, port = (u.hostname or "").rstrip("."), u.port
    except ValueError:
        return (url or "").strip()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{key}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'page {page_id}'.encode()).digest()[:16], version=4)}>"


def record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member; html is left out of a revisit, whose HTTP header still tells its length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=''.join(map(chr, range(33, 127))))}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    body = http if refers_to is not None else http + html
    head.append(f"Content-Length: {len(body)}")
    z = zlib.compressobj(1, wbits=31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of a gzip member; field names in lower case."""
    data = zlib.decompress(member, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict((k.lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:]))
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, dict((k.lower(), v.strip()) for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])), payload


def described(member: bytes) -> tuple:
    """A record as RECORD has it; a response's payload is hashed again and checked."""
    fields, http, payload = parse(member)
    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "response":
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"page {page}: payload and digest differ")
        size = len(payload)
    else:
        size = int(http["content-length"])
    return None if page is None else int(page), size, digest, fields["warc-type"], None if refers is None else int(refers)


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, html (binary, null: empty), digest and refers_to; the payloads are shuffled once, a hot one over many tasks."""
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    groups = rows.filter(F.octet_length("html") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = groups.filter("n > 1 AND first IS NOT NULL").select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    found = salted.join(groups, ["digest", "salt"], "left")
    return found.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, out: str) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``out``; returns where each capture lies.

    Null html is empty, a null url an empty one. Rows that repeat a page_id and its payload are responses
    alike. A page without page_id is a revisit if its payload has a response. An empty table writes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file, path = TaskContext.get().partitionId(), None, ""
        for b in small(batches):
            rows = []
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                if file is None:
                    # A name of its own for each attempt: captures name the file that their attempt wrote.
                    path = f"{out}/warc/part-{part:06d}-{uuid.uuid4().hex[:8]}.warc.gz"
                    file = AtomicFile(path)
                at = file.tell()
                rows.append((surt(url), page_id, part, path, at, file.write(record(page_id, url, html, digest, refers_to))))
                if file.size >= ARCHIVE_BYTES:
                    file.close()
                    file = None
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in CAPTURES.split(", ")])
        if file is not None:
            file.close()

    return written(decided(pages).mapInArrow(run, CAPTURES), f"{out}/captures")


def index_key(key: str, page_id: int | None) -> bytes:
    return key.encode("utf-8", "surrogatepass") + b"\0" + struct.pack(">Q", (page_id if page_id is not None else -(1 << 63)) + (1 << 63))


def write_index(captures: DataFrame, out: str, n: int | None = None) -> DataFrame:
    """Write the index shards of ``n`` captures (counted if not given) below ``out``; returns the manifest: part, path, n, first_key, last_key."""
    n = captures.count() if n is None else n
    shards = max(1, -(-n // SHARD_CAPTURES), min(captures.sparkSession.sparkContext.defaultParallelism, n // SHARD_LEAST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), None
        for b in batches:
            for key, page_id, p, path, at, size in zip(*(c.to_pylist() for c in b.columns)):
                shard = shard or ShardWriter(f"{out}/index/part-{part:06d}.idx", 1, INDEX_BLOCK)
                shard.add(index_key(key, page_id), struct.pack("<IQQ", p, at, size) + path.encode())
        if shard is not None:
            uri, n, _, _, first, last = shard.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([uri]), pa.array([n], pa.int64()), pa.array([first], pa.binary()), pa.array([last], pa.binary())], names=["part", "path", "n", "first_key", "last_key"])

    order = ["surt", "page_id", "path", "offset"]
    ordered = captures.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("surt", "page_id", "part", "path", "offset", "length")
    return written(ordered.mapInArrow(run, "part int, path string, n long, first_key binary, last_key binary"), f"{out}/manifest")


class CaptureIndex:
    """Point lookups by URL. Holds the manifest: one row per shard."""

    def __init__(self, manifest: DataFrame):
        self.shards = sorted((bytes(r["first_key"]), bytes(r["last_key"]), r["path"]) for r in manifest.collect())

    def captures(self, url: str) -> Iterator[tuple[int | None, str, int, int]]:
        """(page_id, archive, offset, length) of every capture of a URL."""
        low = surt(url).encode("utf-8", "surrogatepass") + b"\0"
        for first, last, path in self.shards[bisect_left(self.shards, low, key=lambda s: s[1]) :]:
            if first[: len(low)] > low:
                return
            shard = Shard(path)
            for i in range(bisect_left(shard.last_keys, low), len(shard.ranges)):
                for key, value in shard.block(i):
                    if key[: len(low)] > low:
                        return
                    if key.startswith(low) and len(key) == len(low) + 8:
                        _, at, size = struct.unpack_from("<IQQ", value)
                        page = struct.unpack(">Q", key[-8:])[0] - (1 << 63)
                        yield None if page == -(1 << 63) else page, value[20:].decode(), at, size

    def fetch(self, url: str) -> list[tuple[dict, dict, bytes]]:
        """The records of a URL, each by one range read."""
        out = []
        for _, path, at, size in self.captures(url):
            fs, p = filesystem(path)
            with fs.open_input_file(p) as f:
                out.append(parse(f.read_at(size, at)))
        return out


def lookup_keys(pages: DataFrame) -> DataFrame:
    """key (surt and page_id as the index has them), each once, of the rows of ``pages``; html is not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([index_key(surt(u), p) for p, u in zip(*(c.to_pylist() for c in b.columns))], pa.binary())], names=["key"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, "key binary").distinct()


def looked_up(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """path, offset, length of every capture of ``keys``: the manifest is bisected for shards, a shard's directory for blocks.

    The manifest (a row per shard) is held by every task; a shard's keys come sorted to one task, which reads
    each block that they fall into once. A key whose captures fill several shards is looked up in each.
    """
    shards = sorted((bytes(r["first_key"]), bytes(r["last_key"]), r["path"]) for r in manifest.collect())
    firsts, lasts = [f for f, _, _ in shards], [z for _, z, _ in shards]

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [(i, k) for k in b.column(0).to_pylist() for i in range(bisect_left(lasts, k), bisect_right(firsts, k))]
            if at:
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in at], pa.int32()), pa.array([k for _, k in at], pa.binary())], names=["shard", "key"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, shard, at, block = None, None, -1, []
        for b in batches:
            rows = []
            for i, key in zip(*(c.to_pylist() for c in b.columns)):
                if i != opened:
                    opened, shard, at = i, Shard(shards[i][2]), -1
                n = bisect_left(shard.last_keys, key)
                while n < len(shard.ranges):
                    if n != at:
                        at, block = n, list(shard.block(n))
                    lo = bisect_left(block, key, key=lambda e: e[0])
                    hi = bisect_right(block, key, lo, key=lambda e: e[0])
                    rows += [(v[20:].decode(), *struct.unpack_from("<QQ", v, 4)) for _, v in block[lo:hi]]
                    if hi < len(block):
                        break
                    n += 1  # equal keys may go on in the next block
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))], names=["path", "offset", "length"])

    asked = keys.mapInArrow(homes, "shard int, key binary").repartition(max(1, len(shards)), "shard").sortWithinPartitions("shard", "key")
    return asked.mapInArrow(find, "path string, offset long, length long")


def read_records(found: DataFrame, total: int) -> DataFrame:
    """RECORD of every capture (path, offset, length): tasks follow the archives' ``total`` bytes, each reads spans of archives in order."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_path, file, held, held_at = None, None, b"", 0
        for b in batches:
            rows = []
            for path, at, size in zip(*(c.to_pylist() for c in b.columns)):
                if path != open_path:
                    fs, p = filesystem(path)
                    open_path, file, held = path, fs.open_input_file(p), b""
                if at < held_at or at + size > held_at + len(held):
                    held, held_at = file.read_at(max(size, READ_BYTES), at), at
                rows.append(described(held[at - held_at : at - held_at + size]))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in RECORD.split(", ")])

    n = max(found.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    spans = found.repartition(n, "path", F.expr(f"offset div {READ_BYTES}")).sortWithinPartitions("path", "offset")
    return spans.mapInArrow(records, RECORD)


def archived(pages: DataFrame, out: str | None = None) -> DataFrame:
    """Write the archives and the index of ``pages`` and return every page's record, looked up by its key and read back.

    A row per row of ``pages``: null page_ids, repeated rows and rows without url are captures like others;
    null html is an empty payload; an empty table gives no rows; columns besides page_id, url and html are
    not read.
    """
    spark: SparkSession = pages.sparkSession
    out = out or work_dir(spark, "warc")
    captures = write_archives(pages, out)
    n, total = captures.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    return read_records(looked_up(write_index(captures, out, n), lookup_keys(pages)), total)
