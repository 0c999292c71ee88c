"""Operator 7, packing: documents into token sequences of fixed capacity, by sum of squares.

Every piece goes where the sum over residual gaps g of N(g)^2 becomes smallest, N(g)
being the number of open sequences with gap g (a new sequence counts as gap
``capacity``); ties go to the smallest gap. Pieces are dealt to groups by a hash of
their identity; a group is packed by one task, and group sizes are bounded, so a task's
memory is bounded at any input size. Within a group pieces come in hash order, but the
smallest fifth comes last, largest first, and fills what gaps are left. Only the last, partly
filled sequences of each group are lost to the split.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialise
from .token_codec import codec, slices

#: Pieces that a group holds on average.
GROUP_PIECES = 32_768
#: Share of a group's pieces, the smallest, that are placed last.
LAST = 0.2

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text (null or empty: the end alone), append ``end_id``, cut at
    ``capacity``. Null and repeated ids are kept as they are; other columns are not read; an
    empty table gives an empty one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = codec(tokenizer)
        for batch in batches:
            for a, n in slices(batch.column(1)):
                ids, bounds = words.encode(batch.column(1).slice(a, n), end_id)
                ids = ids.astype("<u4")
                sizes = np.diff(bounds)
                pieces = -(-sizes // capacity)
                owner = np.repeat(np.arange(n), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(sizes[owner] - start, capacity)
                crcs = [zlib.crc32(ids[x:y]) for x, y in zip((bounds[owner] + start).tolist(), (bounds[owner] + start + length).tolist(), strict=True)]
                columns = [batch.column(0).slice(a, n).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the order given."""
    open_bins = np.zeros(capacity + 1, np.int64)  # by gap; a gap of 0 is closed and not counted
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i, s in enumerate(lengths.tolist()):
        # moving a bin from gap g to g - s changes the sum by 2 (N(g-s) - N(g)) + 2, or by 1 - 2 N(g) if it fills it
        gain = open_bins[: capacity - s + 1] - open_bins[s:]
        gain = 2 * gain + 2
        gain[0] = 1 - 2 * open_bins[s]
        gain[open_bins[s:] == 0] = np.iinfo(np.int64).max
        fresh = 2 * open_bins[capacity - s] + 1 if s < capacity else 0
        at = int(gain.argmin())
        if gain[at] <= fresh:
            g = at + s
            b = stacks[g].pop()
            open_bins[g] -= 1
        else:
            g, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - g
        if g > s:
            stacks[g - s].append(b)
            open_bins[g - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows of ``cut_pieces``. No sequence exceeds the
    capacity, offsets are gapless, and every row comes back once, also repeated rows and
    rows with a null doc_id. An empty table gives an empty one."""
    pieces = materialise(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    h = F.xxhash64("doc_id", "piece", "ids_crc32")
    grouped = pieces.withColumn("h", h).withColumn("g", F.pmod(F.col("h"), F.lit(groups)).cast("int"))

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        length = rows["length"].to_numpy()
        small = length < np.quantile(length, LAST)
        rows = rows.take(pa.array(np.argsort(np.where(small, capacity + 1 - length, 0), kind="stable")))
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        first = rows["g"][0].as_py() << 32
        return rows.drop_columns(["g", "h"]).append_column("sequence_id", pa.array(first + bins)).append_column("offset", pa.array(offsets))

    return grouped.groupBy("g").applyInArrow(place, PIECES + ", sequence_id long, offset long")
