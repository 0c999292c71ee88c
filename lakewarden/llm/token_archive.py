"""Operator 10, token-ID output: documents as token ids in segment files.

A segment holds consecutive documents in ascending doc_id order: the ids of all of them
in one array (uint16 where the vocabulary allows, else uint32), the document boundaries
Elias-Fano coded, and the doc_ids. ``select`` on the boundaries gives a document's
offset without decoding the rest. Each segment is one file of bounded size, written by
Spark's own file sink, so the output committer keeps what a finished task wrote and
drops what a lost one left, on any file system that Spark writes.

File layout, little-endian: magic ``LWTOK2``, a byte for the width of an id, a zero,
then part, segment of the part, ids of the part before this segment, ids, documents,
documents without a doc_id (they come first), least doc_id (seven int64), then what the
doc_ids lie above the least (Elias-Fano, ascending), boundaries (Elias-Fano, ``documents
+ 1`` values), and the ids. Bytes after them are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, parts
from .elias_fano import EliasFano
from .token_codec import codec, slices

MAGIC = b"LWTOK2"
HEAD = "<6sBBqqqqqqq"
#: A segment is closed when its ids take this many bytes; it may exceed them by a slice
#: of texts, or by one document.
SEGMENT_BYTES = 8 << 20


@dataclass
class Segment:
    part: int
    number: int
    before: int  # ids of the same part before this segment
    doc_ids: list[int | None]
    bounds: EliasFano
    ids: np.ndarray

    def tokens(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]

    def to_bytes(self) -> bytes:
        keys = [x for x in self.doc_ids if x is not None]
        least = keys[0] if keys else 0
        head = struct.pack(HEAD, MAGIC, self.ids.dtype.itemsize, 0, self.part, self.number, self.before, len(self.ids), len(self.doc_ids), len(self.doc_ids) - len(keys), least)
        above = EliasFano.encode(np.array([x - least for x in keys], np.uint64))
        return head + above.to_bytes() + self.bounds.to_bytes() + self.ids.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "Segment":
        magic, width, _, part, number, before, n_ids, _, nulls, least = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = struct.calcsize(HEAD)
        above, took = EliasFano.from_bytes(memoryview(data)[at:])
        at += took
        bounds, took = EliasFano.from_bytes(memoryview(data)[at:])
        ids = np.frombuffer(data, f"<u{width}", n_ids, at + took)
        keys = (above.decode().view(np.uint64) + np.uint64(least % 2**64)).view(np.int64).tolist()
        return cls(part, number, before, [None] * nulls + keys, bounds, ids)


def write_token_archive(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, write segments under ``path``.

    A null text is empty (its document holds the end id alone); rows with a null id come
    first; rows that repeat an id stay, ordered by text; an empty table leaves a folder
    without segments. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    ordered = rows.repartitionByRange(parts(spark), "k").sortWithinPartitions("k", "t")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, before = TaskContext.get().partitionId(), 0, 0
        words = codec(tokenizer)
        keys: list[int | None] = []
        held: list[np.ndarray] = []  # ids, one array for each slice of texts
        sizes: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            data = Segment(part, made, before, keys, EliasFano.encode(bounds), np.concatenate(held)).to_bytes()
            return pa.RecordBatch.from_pydict({"segment": pa.array([data], pa.binary())})

        for batch in batches:
            for a, n in slices(batch.column(1), 6 << 20):
                ids, bounds = words.encode(batch.column(1).slice(a, n), end_id)
                keys += batch.column(0).slice(a, n).to_pylist()
                held.append(ids)
                sizes.append(np.diff(bounds))
                size += ids.nbytes
                if size >= SEGMENT_BYTES:
                    yield close()
                    made, before = made + 1, before + size // words.dtype.itemsize
                    keys, held, sizes, size = [], [], [], 0
        if keys:
            yield close()
        give_back()

    # a binary cast to string keeps its bytes, and the text sink writes them as they are
    made = ordered.mapInArrow(encode, "segment binary").select(F.col("segment").cast("string").alias("value"))
    made.write.option("maxRecordsPerFile", 1).text(path)


def read_token_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row per document: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of the ids as little-endian uint32)."""
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    segments = files.where(F.substring("content", 1, len(MAGIC)) == F.lit(MAGIC))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [struct.unpack(HEAD, x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"part": [x[3] for x in found], "n": [x[6] for x in found]})

    totals = segments.select(F.substring("content", 1, struct.calcsize(HEAD)).alias("h")).mapInArrow(heads, "part long, n long")
    # a row for each part that was written: bounded by the number of shuffle partitions
    sums = {r["part"]: r["n"] for r in totals.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(sums):
        base[part] = total
        total += sums[part]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                s = Segment.from_bytes(data.as_py())
                bounds = s.bounds.decode()
                ids = s.ids.astype("<u4")
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                starts = bounds[:-1] + (base[s.part] + s.before)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(s.doc_ids, pa.int64()), "start": starts, "n_tokens": np.diff(bounds), "ids_crc32": pa.array(crcs, pa.int64())})

    return segments.select("content").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
