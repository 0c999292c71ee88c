"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import CLEANUP, discard, materialise, scratch, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(df: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of df whose ``row`` (a number of monotonically_increasing_id) is among those of
    ``rows``. A bit a row goes to all tasks, so df itself is not shuffled."""

    def pack(found: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 16, np.uint8)
        bits[found["bit"].to_numpy()] = 1
        data = np.packbits(bits).tobytes().rstrip(b"\0")
        return pa.table({"block": found["block"].slice(0, 1).cast(pa.int64()), "bits": pa.array([data], pa.binary())})

    placed = rows.select(F.shiftright("row", 16).alias("block"), F.col("row").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("bit"))
    blocks = {r["block"]: bytes(r["bits"]) for r in placed.groupBy("block").applyInArrow(pack, "block long, bits binary").collect()}
    held = df.sparkSession.sparkContext.broadcast(blocks)

    def among(row: pd.Series) -> pd.Series:
        x = row.to_numpy()
        out = np.zeros(len(x), bool)
        block, bit = x >> 16, x & 0xFFFF
        for k in np.unique(block):
            at = np.flatnonzero(block == k)
            data = np.frombuffer(held.value.get(int(k), b""), np.uint8)
            own = at[bit[at] < 8 * len(data)]
            out[own] = np.unpackbits(data)[bit[own]]
        return pd.Series(out)

    return df.where(F.pandas_udf(among, "boolean")("row"))


def crc_mod(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def crc_mod_py(doc_id, k: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % k


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What a worker keeps from task to task, of any operator.
CACHES: list[dict] = []


def forget() -> None:
    """Drop what a worker still keeps for other operators, for one that needs its memory."""
    for cache in CACHES:
        cache.clear()


def give_back() -> None:
    """Return freed memory of a worker to the machine: workers outlive their tasks, and what
    one task no longer needs must not stand in the way of the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def mapped(docs: DataFrame, keep: list[str], inputs: list[Column], fn: Callable[[list[pa.Array]], list[pa.Array]], out: str) -> DataFrame:
    """The columns ``keep``, untouched, beside what ``fn`` makes of ``inputs`` in slices of at
    most 1000 rows; ``out`` is the schema of that. Values stay in Arrow, so that ids keep all
    their bits beside nulls, and names of ``keep`` may be any, also repeated."""
    own = [docs[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(*own, *(c.alias(f"x{i}") for i, c in enumerate(inputs)))
    n = len(keep)
    names = [f.name for f in StructType.fromDDL(out)]
    kinds = StructType([*rows.schema.fields[:n], *StructType.fromDDL(out).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                some = batch.slice(a, 1000)
                yield pa.RecordBatch.from_arrays([*some.columns[:n], *fn(some.columns[n:])], [f"k{i}" for i in range(n)] + names)
        give_back()

    return rows.mapInArrow(run, kinds).toDF(*keep, *names)
