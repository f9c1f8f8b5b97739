"""WARC archives and their two-level capture index.

Writing: each attempt of a task writes its rows as one archive, a gzip member for each record, under a name of its own,
which its capture lines carry. Only lines of attempts that Spark commits are kept, so what a lost or repeated attempt
wrote is never read. Archives lie in the shared folder, reached through pyarrow's file systems.

Index: capture lines are sorted by reversed-host URL key into compressed blocks; a sparse directory keeps each block's
first and last key. A look-up finds blocks by binary search in the directory, lines by binary search in the block, and
reads one range of one archive for each. The directory has at most DIRECTORY entries of at most KEY characters a key:
blocks grow with the number of captures. Wanted keys are dealt to blocks in lots of LOT, so a key with many captures is
read from as many blocks as it fills, and no task holds more than a block and a lot.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import col, join_sized, shared_path, slices, stored

LINES = 2000
DIRECTORY = 200_000
#: Characters of a key that the directory holds at most; a longer one is cut, and blocks around it are looked into.
KEY = 256
LOT = 4096
EMPTY_DATE = "1970-01-01T00:00:00Z"
CRLF = b"\r\n"


def url_key(url: str | None) -> str:
    """Reversed-host key: http://www.A.com:80/x?q -> com,a)/x?q. A null URL has the empty key."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    host = host.removeprefix("www.")
    odd = f":{port}" if port and port != {"http": 80, "https": 443}.get(u.scheme) else ""
    return ",".join(reversed(host.split("."))) + odd + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def one_line(value: str) -> str:
    """A header's value without line ends."""
    return " ".join(value.split())


def record(kind: str, page: str, url: str, payload: bytes, sha: str, of: str | None) -> bytes:
    """The bytes of a WARC 1.1 record; a revisit refers to page `of` and carries no payload."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {EMPTY_DATE}", f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: sha1:{sha}", f"X-Page-Id: {page}", f"X-Payload-Length: {len(payload)}",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(of or '')}", f"X-Refers-To-Page: {of}"]
        block = http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one record. Raises ValueError if it is broken."""
    head, cut, rest = raw.partition(CRLF * 2)
    if not cut or not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    named = {k.lower(): v for k, v in named.items()}
    block = rest[: int(named["content-length"])]
    if len(block) != int(named["content-length"]) or rest[len(block) :] != CRLF * 2:
        raise ValueError("a record of another length than it says")
    return named, block.partition(CRLF * 2)[2]


def _file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def classify(pages: DataFrame, page_id: str = "page_id", html: str = "html", least: int = 0) -> DataFrame:
    """id, url, payload, size and of (the response that a revisit refers to), by digest and length of the payload.

    Null html is the empty payload. Of equal payloads the smallest id is the response; rows without an id are revisits
    of it, or responses if none has an id. Many equal payloads don't meet in one task.
    """
    payload = F.coalesce(col(html), F.lit("")).cast("binary")
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(col(page_id).alias("id"), url.alias("url"), payload.alias("payload")).withColumn("hex", F.sha1("payload")).withColumn("size", F.length("payload").cast("long"))
    first = stored(rows.where(F.col("size") >= least).groupBy("hex", "size").agg(F.min("id").alias("of"), F.count(F.lit(1)).alias("n")).where("n > 1 and of is not null"), "warc-first")
    met = join_sized(rows, first, ["hex", "size"], "n", F.xxhash64("id", "url"))
    return met.select("id", "url", "payload", "size", F.when(F.col("of").isNotNull() & ~F.col("id").eqNullSafe(F.col("of")), F.col("of")).alias("of"))


INDEX = "key string, page string, file string, offset long, length long, sha string"


def write(pages: DataFrame, folder: str, page_id: str = "page_id", html: str = "html", least: int = 0, level: int = 1) -> DataFrame:
    """Writes archives below `folder` and returns the capture lines (INDEX), one for each row of pages, in the shared folder.

    Null html is the empty payload, a null URL the empty one. Rows that repeat an id are captures of their own; of
    equal payloads under the same smallest id all are responses.
    """
    rows = classify(pages, page_id, html, least).select(F.col("id").cast("string").alias("page"), F.coalesce("url", F.lit("")).alias("url"), "payload", F.col("of").cast("string").alias("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = _file_system(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        lines, at, out = [], 0, None

        def batch():
            got = pa.RecordBatch.from_pylist([dict(zip(("key", "page", "file", "offset", "length", "sha"), x, strict=True)) for x in lines])
            lines.clear()
            return got

        for whole in batches:
            for b in slices(whole, "payload"):
                for page, url, payload, of in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
                    page = "" if page is None else page
                    sha = digest(payload)
                    packed = gzip.compress(record("response" if of is None else "revisit", page, url, payload, sha, of), level, mtime=0)
                    out.write(packed)
                    lines.append((url_key(url), page, name, at, len(packed), sha))
                    at += len(packed)
                if len(lines) >= 10_000:  # kept only if the task ends well, and then the archive is whole
                    yield batch()
        if out is not None:
            out.close()
        if lines:
            yield batch()

    return stored(rows.mapInArrow(run, INDEX), "warc-lines")


def build_index(lines: DataFrame, per_block: int = LINES) -> DataFrame:
    """(block, first, last, n, data): sorted compressed blocks of capture lines, in the shared folder."""
    n = lines.count()
    per_block = max(per_block, -(-n // DIRECTORY))
    width = max(1, min(n // (4 * per_block), 4096))
    dealt = lines.repartitionByRange(width, "key", "page", "offset").sortWithinPartitions("key", "page", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held = TaskContext.get().partitionId(), 0, []

        def block():
            text = "".join(f"{json.dumps(x)}\n" for x in held)
            return pa.RecordBatch.from_pylist([{"block": f"{part:06d}-{k:06d}", "first": held[0][0], "last": held[-1][0], "n": len(held), "data": zlib.compress(text.encode(), 6)}])

        for b in batches:
            for line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(line)
                if len(held) >= per_block:
                    yield block()
                    k, held = k + 1, []
        if held:
            yield block()

    return stored(dealt.mapInArrow(run, "block string, first string, last string, n long, data binary"), "warc-index")


def directory(index: DataFrame) -> list[tuple[str, str, str]]:
    """(first key, last key, block) of every block, sorted: at most DIRECTORY entries, so executors may hold it.

    A key that is cut stands for the least of its beginnings as a first, for the greatest as a last one.
    """
    rows = index.select(F.substring("first", 1, KEY), F.when(F.length("last") > KEY, F.concat(F.substring("last", 1, KEY), F.lit("\U0010ffff"))).otherwise(F.col("last")), "block")
    return sorted(tuple(r) for r in rows.toLocalIterator())


class Directory:
    """The sparse directory in memory, searched by halving."""

    def __init__(self, entries: list[tuple[str, str, str]]):
        self.first, self.last, self.block = ([e[k] for e in entries] for k in range(3))

    def blocks_of(self, key: str) -> list[str]:
        """Blocks that may hold the key: blocks are sorted, so those between the first that ends at or after it and the last that begins at or before it."""
        return self.block[bisect.bisect_left(self.last, key) : bisect.bisect_right(self.first, key)]


def look_up(index: DataFrame, folder: str, wanted: DataFrame, url: str = "url") -> DataFrame:
    """Records by URL, read back from the archives: page, kind, of, size, sha, payload, ok; one for each capture of a wanted URL.

    wanted: a frame with a URL column; repeated URLs are looked up once, null ones are the empty URL. ok is false for a
    record whose payload doesn't have the digest of its header and its capture line.
    """
    spark = index.sparkSession
    fields = T.StructType([T.StructField("page", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("of", T.StringType()), T.StructField("size", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("ok", T.BooleanType())])
    known = spark.sparkContext.broadcast(Directory(directory(index)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            keys = {url_key(u) for u in b.column(0).to_pylist()} - seen
            if len(seen) < 100_000:
                seen |= keys
            hits = [(x, k) for k in keys for x in known.value.blocks_of(k)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in hits], pa.string()), pa.array([k for _, k in hits], pa.string())], names=["block", "key"])

    keys = stored(wanted.select(col(url).cast("string")).mapInArrow(route, "block string, key string").dropDuplicates(), "warc-wanted")
    lots = keys.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / LOT).alias("lots"))
    dealt = keys.join(lots, "block").groupBy("block", F.pmod(F.xxhash64("key"), F.col("lots")).alias("lot")).agg(F.collect_list("key").alias("keys"))
    src = index.select("block", "data").join(dealt, "block").select("data", "keys")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(folder)
        files: dict[str, pa.NativeFile] = {}
        for data, keys in ((d.as_py(), k.as_py()) for b in batches for d, k in zip(b.column(0), b.column(1), strict=True)):
            block = [json.loads(x) for x in zlib.decompress(data).decode().split("\n")[:-1]]
            first, lines = [x[0] for x in block], []
            for key in keys:
                lines += block[bisect.bisect_left(first, key) : bisect.bisect_right(first, key)]
            yield from records(fs, base, files, lines)

    def records(fs, base, files, lines) -> Iterator[pa.RecordBatch]:
        lines.sort(key=lambda x: (x[2], x[3]))
        out, held = [], 0
        for _, _, name, offset, length, sha in lines:
            if name not in files:
                if len(files) > 64:
                    files.clear()
                files[name] = fs.open_input_file(f"{base}/{name}")
            head, payload = parse(gzip.decompress(files[name].read_at(length, offset)))
            said = head["warc-payload-digest"].removeprefix("sha1:")
            kind = head["warc-type"]
            good = said == sha and (kind == "revisit" or digest(payload) == sha)
            out.append((head["x-page-id"], kind, head.get("x-refers-to-page"), int(head["x-payload-length"]) if kind == "revisit" else len(payload), said, payload, good))
            held += len(payload)
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out, strict=True), TYPES, strict=True)], names=fields.names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out, strict=True), TYPES, strict=True)], names=fields.names)

    return src.mapInArrow(read, fields)


TYPES = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]


def scan(spark: SparkSession, folder: str, lines: DataFrame) -> DataFrame:
    """Every record of the archives that the capture lines name, from first to last byte: path and the records' fields."""

    kinds = pa.schema([("path", pa.string()), ("page", pa.string()), ("kind", pa.string()), ("of", pa.string()), ("size", pa.int64()), ("sha", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                while content:
                    z = zlib.decompressobj(31)
                    head, payload = parse(z.decompress(content) + z.flush())
                    content = z.unused_data
                    yield pa.RecordBatch.from_pylist([{"path": path, "page": head["x-page-id"], "kind": head["warc-type"], "of": head.get("x-refers-to-page"), "size": int(head["x-payload-length"]), "sha": head["warc-payload-digest"].removeprefix("sha1:")}], schema=kinds)

    named = lines.select(F.col("file").alias("name")).dropDuplicates()
    found = spark.read.format("binaryFile").load(f"{folder}/*.warc.gz").withColumn("name", F.element_at(F.split("path", "/"), -1)).join(named, "name", "left_semi")
    return found.select("path", "content").mapInArrow(run, "path string, page string, kind string, of string, size long, sha string")


def archive(pages: DataFrame, page_id: str = "page_id", html: str = "html", least: int = 0) -> DataFrame:
    """Writes, indexes and reads back by URL: page_id, payload_bytes, payload_digest, record_type, refers_to, intact; a row for each row.

    Every page is found again by its own URL through directory and blocks. Null html and null URLs are the empty ones;
    rows that repeat an id are captures of their own; an empty table gives no rows; other columns are not used.
    """
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    kind = next(f.dataType for f in pages.schema.fields if f.name.lower() == page_id.lower())
    urls = pages.select("url") if "url" in pages.columns else spark.createDataFrame([(None,)], "url string")
    got = look_up(build_index(write(pages, folder, page_id, html, least)), folder, urls)
    back: Column = F.when(F.col("page") != "", F.col("page")).cast(kind)
    return got.select(back.alias("page_id"), F.col("size").alias("payload_bytes"), F.col("sha").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("of").cast(kind).alias("refers_to"), F.col("ok").alias("intact"))
