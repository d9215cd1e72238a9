"""Token-id files with Elias-Fano document boundaries.

Documents go by ascending doc_id (null first; repeated ids in the input's order) into shards, each a
contiguous range of doc_ids. A shard file holds a header, the Elias-Fano coded doc_ids, the
Elias-Fano coded end offsets of its documents and the concatenated ids (16 bits each while
the vocabulary allows). Select on the offsets gives a document's place without a table of
64-bit numbers.

Null text counts as empty; each document gets the end id, so an empty one has one id. An
empty table makes no file and no row. Further columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, store, wordpiece
from .elias_fano import EliasFano

MAGIC = b"EFTOKEN1"
_HEAD = struct.Struct("<8sB7xQQ")  # magic, bytes an id, null doc_ids in front, ids
SHARD_BYTES = 256 << 20
READ_DOCS = 4096  #: documents whose places are looked up at once
MANIFEST = "part int, seq int, path string, n_docs long, n_ids long"


def shard_bytes(doc_ids: list[int | None], ids: list[bytes], width: int) -> list[bytes]:
    """The pieces of a shard file for documents in ascending order."""
    nulls = sum(d is None for d in doc_ids)
    ends = np.cumsum([len(x) // width for x in ids], dtype=np.int64)
    known = EliasFano.encode(np.array([d for d in doc_ids if d is not None], np.int64))
    return [_HEAD.pack(MAGIC, width, nulls, int(ends[-1]) if len(ends) else 0), known.to_bytes(), EliasFano.encode(ends).to_bytes(), *ids]


class Shard:
    """A shard file, opened by memory map where the store is mounted."""

    def __init__(self, uri: str):
        buf = store.mapped(uri)
        magic, width, self.nulls, self.n_ids = _HEAD.unpack_from(buf, 0)
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.known, at = EliasFano.from_buffer(buf, _HEAD.size)
        self.ends, at = EliasFano.from_buffer(buf, at)
        self.ids = np.frombuffer(buf, f"<u{width}", self.n_ids, at)

    def __len__(self) -> int:
        return len(self.ends)

    def bounds(self, i: int) -> tuple[int, int]:
        """Place of the i-th document's ids, by two selects."""
        return (self.ends[i - 1] if i else 0), self.ends[i]

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.ids[a:b]

    def several(self, a: int, b: int) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        """doc_ids, starts and ends of documents a to b (exclusive), by select: no table of all of them is made."""
        ends = self.ends.many(np.arange(a, b))
        first = self.ends[a - 1] if a else 0
        known = self.known.many(np.arange(max(a, self.nulls), max(b, self.nulls)) - self.nulls).tolist()
        return [None] * (b - a - len(known)) + known, np.concatenate([[first], ends[:-1]]).astype(np.int64), ends


def write(docs: DataFrame, out_dir: str, tokenizer: str, shard_limit: int = SHARD_BYTES) -> DataFrame:
    """Encode and write all documents; returns the manifest (one row per shard), in `MANIFEST`'s columns.

    One range shuffle by doc_id, and by the row's place in the input, so that rows of equal or
    null ids are dealt to as many tasks; a task keeps at most one shard of `shard_limit` bytes.
    """

    def run(batches):
        from pyspark import TaskContext

        enc, part = wordpiece.encoder(tokenizer), TaskContext.get().partitionId()
        seq, size, names, ids = 0, 0, [], []

        def flush():
            uri = f"{out_dir}/shard-{part:06d}-{seq:04d}.bin"
            chunks = shard_bytes(names, ids, enc.kind.itemsize)
            store.write_atomic(uri, *chunks)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": uri, "n_docs": len(names), "n_ids": size // enc.kind.itemsize}], schema=schema)

        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(enc.encode(text))
                names.append(d)
                size += len(ids[-1])
                if size >= shard_limit:
                    yield flush()
                    seq, size, names, ids = seq + 1, 0, [], []
        if names:
            yield flush()

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    ranged = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange("doc_id", "__row").sortWithinPartitions("doc_id", "__row")
    return common.materialise(ranged.select("doc_id", "text").mapInArrow(run, MANIFEST), f"{out_dir}/manifest")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.

    The window runs over the manifest only: one row per shard.
    """
    order = Window.orderBy("part", "seq")
    based = manifest.withColumn("base", F.sum("n_ids").over(order) - F.col("n_ids"))
    n = max(1, manifest.count())

    def run(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(uri)
                for first in range(0, len(shard), READ_DOCS):
                    doc_ids, starts, ends = shard.several(first, min(first + READ_DOCS, len(shard)))
                    crc = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.select("path", "base").repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
