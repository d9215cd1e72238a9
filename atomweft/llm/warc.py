"""WARC archives: writing captures, reading records, assembling transactions.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record;
request and metadata name the capture's record in WARC-Concurrent-To. Records of one capture
may stand in different archives: assembly groups them by that identifier and gives one nested
row a capture. Archives are gzip members, one a record, written to the shared folder under a
temporary name and renamed, so that a repeated task leaves one whole file.

Of captures with equal payloads of at least `least` bytes, that with the largest page_id is a
response and the others revisit it; repeated rows with that id are all responses. Null html
counts as empty, null page_ids never are the largest unless all are null. A null url goes
without a target, one that can't be parsed is kept as it is, and "/" is asked for. Revisits keep the HTTP head, so the payload's length is read back from it.
An empty table makes no archive and no row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import urllib.parse
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, store
from .components import joined_anew

ARCHIVE_BYTES = 128 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, concurrent_to string, kind string, uri string, date string, payload_bytes long, payload_digest string, page_id long, http string, payload binary"
_FIELDS = pa.schema([(n, pa.string()) for n in ("record_id", "concurrent_to", "kind", "uri", "date")] + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("page_id", pa.int64()), ("http", pa.string()), ("payload", pa.binary())])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """Without what would end a header line."""
    return "".join(urllib.parse.quote(c) if c in "\r\n" else c for c in value)


def target(url: str | None) -> tuple[str, str]:
    """Host and path to ask for; of a url that can't be parsed no host and "/"."""
    try:
        where = urllib.parse.urlsplit(_clean(url or ""))
    except ValueError:
        return "", "/"
    return where.netloc, (where.path or "/") + f"?{where.query}" * bool(where.query)


def record(kind: str, record_id: str, block: bytes, content_type: str, **named: str | None) -> bytes:
    """One record as a gzip member; named headers have _ for -."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}"]
    lines += [f"WARC-{k.replace('_', '-')}: {_clean(v)}" for k, v in named.items() if v is not None]
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 3, mtime=0)


def capture(page_id: int | None, url: str | None, payload: bytes, origin: tuple | None, name: str) -> bytes:
    """Request, response or revisit (of `origin`: its url in a tuple) and metadata."""
    ids = [f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{part}')}>" for part in ("response", "request", "metadata")]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = f"sha1:{base32_sha1(payload)}"
    if origin is None:
        main = record("response", ids[0], head + payload, "application/http; msgtype=response", Target_URI=url, Payload_Digest=digest)
    else:
        main = record("revisit", ids[0], head, "application/http; msgtype=response", Target_URI=url, Payload_Digest=digest, Profile=PROFILE, Refers_To_Target_URI=origin[0], Refers_To_Date=DATE)
    host, path = target(url)
    ask = f"GET {path} HTTP/1.1\r\n" + f"Host: {host}\r\n" * bool(host) + "\r\n"
    request = record("request", ids[1], ask.encode(), "application/http; msgtype=request", Target_URI=url, Concurrent_To=ids[0])
    fields = "".join(f"{k}: {v}\r\n" for k, v in (("pageId", page_id),) if v is not None)
    return request + main + record("metadata", ids[2], fields.encode(), "application/warc-fields", Target_URI=url, Concurrent_To=ids[0])


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload and `origin`: for a revisit, a struct with the url of the response.

    The largest page_id of each payload digest is found before the join, combined map-side. The
    join is dealt anew on both sides, so that a payload's many copies can be split at run time.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    first = rows.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("most"))
    rows = joined_anew(rows, first, "digest", anew=F.reverse)
    other = (F.octet_length("payload") >= least) & F.col("most.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("most.page_id"))
    return rows.select("page_id", "url", "payload", F.when(other, F.struct(F.col("most.url").alias("url"))).alias("origin"))


def write(plan: DataFrame, out_dir: str, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the planned captures; returns the archives' paths."""

    def run(batches):
        from pyspark import TaskContext

        part, seq, n, held = TaskContext.get().partitionId(), 0, 0, io.BytesIO()

        def flush():
            uri = f"{out_dir}/capture-{part:06d}-{seq:04d}.warc.gz"
            store.write_atomic(uri, held.getvalue())
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], names=["path", "captures"])

        for batch in batches:
            for page_id, url, payload, origin in zip(*[c.to_pylist() for c in batch.columns]):
                held.write(capture(page_id, url, payload, None if origin is None else (origin["url"],), f"{out_dir}/{part}/{seq}/{n}"))
                n += 1
                if held.tell() >= limit:
                    yield flush()
                    seq, n, held = seq + 1, 0, io.BytesIO()
        if n:
            yield flush()

    return common.materialise(plan.mapInArrow(run, "path string, captures long"), f"{out_dir}/archives")


def parse(stream, with_payload: bool = True):
    """Tuples of RECORD's fields from an uncompressed stream of records."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode().partition(":")
            head[key.strip().lower()] = value.strip()
        block, kind = stream.read(int(head["content-length"])), head["warc-type"]
        size = digest = page_id = http = payload = None
        if kind in ("response", "revisit"):
            top, _, body = block.partition(b"\r\n\r\n")
            http = top.decode("utf-8", "replace")
            if kind == "response":
                size, digest, payload = len(body), base32_sha1(body), body
            else:
                size = next((int(x.split(":")[1]) for x in http.split("\r\n") if x.lower().startswith("content-length:")), None)
                digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        elif kind == "request":
            http = block.partition(b"\r\n\r\n")[0].decode("utf-8", "replace")
        elif kind == "metadata":
            fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
            page_id = int(fields["pageId"]) if "pageId" in fields else None
        yield head["warc-record-id"], head.get("warc-concurrent-to"), kind, head.get("warc-target-uri"), head.get("warc-date"), size, digest, page_id, http, payload if with_payload else None


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of all archives (column `path`), an archive a task."""
    n = max(1, archives.count())

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                raw = store.mapped(uri)
                rows = []
                for row in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(memoryview(raw)))), with_payload):
                    rows.append(row)
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)

    return archives.select("path").repartition(n, "path").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row a capture: capture_id, kind, and the nested request, response and metadata (null where there is none)."""
    of = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.struct(*[c for c in records.columns if c != "concurrent_to"])))
    keyed = records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
    rows = keyed.groupBy("capture_id").agg(of("request").alias("request"), of("response", "revisit").alias("response"), of("metadata").alias("metadata"))
    return rows.select("capture_id", F.col("response.kind").alias("kind"), "request", "response", "metadata")


def referred(captures: DataFrame) -> DataFrame:
    """captures with `refers_to`: the page_id of the response whose payload a revisit shares."""
    captures = captures.withColumn("payload_digest", F.col("response.payload_digest"))
    origins = captures.filter("kind = 'response'").groupBy("payload_digest").agg(F.max("metadata.page_id").alias("origin"))
    # sizes can't be estimated behind the archives' short list, so no side may be broadcast
    return joined_anew(captures, origins.hint("merge"), "payload_digest", "left", F.reverse).withColumn("refers_to", F.when(F.col("kind") == "revisit", F.col("origin"))).drop("origin")


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SQL = f"""WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS most FROM p),
v AS (SELECT *, most IS NOT NULL AND page_id IS DISTINCT FROM most AS other FROM m)
SELECT page_id, payload_bytes, array_to_string([substr('{_BASE32}', 1 + ((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN other THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN other THEN most END AS refers_to FROM v"""
