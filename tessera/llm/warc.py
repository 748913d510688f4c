"""WARC archives (operator 7): write records, index them, read chosen records back by coalesced byte ranges."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import batch, materialise, pieces, scratch_dir, small_batches, spread, table

#: Payloads under this many bytes are always stored in full.
LEAST_REVISIT = 1000
#: A new archive file begins at this size; ranges of one file this far apart or nearer are read at once, up to READ bytes.
FILE_BYTES, GAP, READ = 64 << 20, 64 << 10, 8 << 20
DATE = "2024-01-01T00:00:00Z"
#: Fixed by the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"

FILES = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string())])
RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_()), ("payload", pa.binary())])


def _open(uri: str):
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def record(page_id, url, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One gzip member with a response, or with a revisit, which has the headers of the response but not its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1F\x7F]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    c = zlib.compressobj(1, wbits=31)
    return c.compress(VERSION + b"\r\n" + "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n") + c.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def _page(urn: str | None):
    m = re.fullmatch(rf"<{ID}(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def write_archives(pages: DataFrame, to: str) -> DataFrame:
    """Write ``page_id, url, payload, digest, refers_to`` as ``*.warc.gz`` files below ``to``; returns ``file, bytes, records``.

    Each task writes files of its own under fresh names. Only those whose names a finished task returned count, so what
    a lost executor or a second attempt leaves behind is never read.
    """

    def run(batches):
        store, path = _open(to)
        out, name, size, n = None, "", 0, 0
        for b in pieces(batches):
            for row in zip(*(b[c].to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                data = record(*row)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    yield batch(FILES, [[f"{to}/{name}"], [size], [n]])
        if out is not None:
            out.close()
            yield batch(FILES, [[f"{to}/{name}"], [size], [n]])

    store, path = _open(to)
    store.create_dir(path, recursive=True)
    small_batches(pages.sparkSession)
    return materialise(pages.mapInArrow(run, "file string, bytes long, records long"), "archives")


def index_archives(files: DataFrame) -> DataFrame:
    """``file, offset, length, url, digest`` of every record, from one sequential pass over each of the ``file`` s."""

    def members(stream):
        start, size, d, got, data = 0, 0, zlib.decompressobj(31), [], b""
        while True:
            data = data or stream.read(1 << 20)
            if not data:
                if size:
                    raise ValueError("an archive ends within a record")
                return
            got.append(d.decompress(data))
            size += len(data) - len(d.unused_data)
            data = d.unused_data
            if d.eof:
                yield start, size, b"".join(got)
                start, size, d, got = start + size, 0, zlib.decompressobj(31), []

    def run(batches):
        for b in batches:
            for file in b["file"].to_pylist():
                store, path = _open(file)
                rows = [[], [], [], [], []]
                with store.open_input_stream(path, compression=None) as stream:
                    for offset, length, data in members(stream):
                        h, _ = parse(data)
                        for out, x in zip(rows, (file, offset, length, h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:")), strict=True):
                            out.append(x)
                        if len(rows[0]) >= 4096:
                            yield batch(INDEX, rows)
                            rows = [[], [], [], [], []]
                if rows[0]:
                    yield batch(INDEX, rows)

    return spread(files.select("file")).mapInArrow(run, "file string, offset long, length long, url string, digest string")


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that rows of an index name: ids, URL, size and SHA-1 of the full payload, type, and whether it is intact.

    Rows are dealt by file and stretch of the file, sorted by offset, and near ranges are read in one request. A revisit
    has the size and digest that its headers give; its payload is null.
    """

    def run(batches):
        def flush(file, todo):
            if not todo:
                return
            with opened(file) as f:
                f.seek(todo[0][0])
                base, data = todo[0][0], f.read(todo[-1][0] + todo[-1][1] - todo[0][0])
            rows = [[] for _ in RECORDS]
            for offset, length in todo:
                h, block = parse(zlib.decompress(data[offset - base : offset - base + length], wbits=31))
                http, _, payload = block.partition(b"\r\n\r\n")
                kind, digest = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:")
                size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
                intact = kind == "revisit" or (len(payload) == size and hashlib.sha1(payload).hexdigest() == digest)
                if kind != "revisit":
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                row = (_page(h["warc-record-id"]), h.get("warc-target-uri"), size, digest, kind, _page(h.get("warc-refers-to")), intact, payload if payloads and kind != "revisit" else None)
                for out, x in zip(rows, row, strict=True):
                    out.append(x)
            yield batch(RECORDS, rows)

        def opened(file):
            store, path = _open(file)
            return store.open_input_file(path)

        now, todo = None, []
        for b in batches:
            for file, offset, length in zip(*(b[c].to_pylist() for c in ("file", "offset", "length")), strict=True):
                if todo and (file != now or offset - sum(todo[-1]) > GAP or offset + length - todo[0][0] > READ):
                    yield from flush(now, todo)
                    todo = []
                now = file
                todo.append((offset, length))
        yield from flush(now, todo)

    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = index.withColumn("stretch", F.floor(F.col("offset") / READ))
    cut = cut.repartition(n, "file", "stretch").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return cut.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean, payload binary")


def assign_types(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: of equal payloads of LEAST_REVISIT bytes or more the largest page_id
    is the response (``refers_to`` null), others revisit it. Null html is an empty payload; rows without id, which sort
    below all ids, revisit too if an equal payload has an id; rows that repeat the largest id are all responses."""
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    narrow = materialise(p.select("page_id", F.octet_length("payload").alias("n"), F.sha1("payload").alias("digest")).filter(F.col("n") >= LEAST_REVISIT), "digests")
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("c")).filter("c > 1 AND last IS NOT NULL").drop("c")
    later = narrow.join(spread(groups), "digest").filter("page_id IS NULL OR page_id <> last").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "last").distinct()
    j = p.withColumn("digest", F.sha1("payload"))
    j = j.join(spread(later), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    return j.select("page_id", "url", "payload", "digest", F.col("last").alias("refers_to"))


def archive(pages: DataFrame, to: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write pages to archives (below ``to``, else the shared folder) and index them: the files and the index."""
    to = to or f"{scratch_dir(pages.sparkSession)}/tessera-{pages.sparkSession.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    files = write_archives(assign_types(pages), to)
    return files, materialise(index_archives(files), "index")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to, TRUE AS intact
FROM g
"""
