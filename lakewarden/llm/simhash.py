"""Operator 4, SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits share a variant within half the radius of both,
and any two that share one are within the radius. So every distinct fingerprint emits
all its variants, equal variants meet, and those that meet form a star of links.

The variants are not shipped one by one. A fingerprint is sent to each value that the
top ``bits`` bits of its variants take; the task of such a value makes the variants
that begin with it, in slices of bounded size (a slice that would be too large is
halved by the next bit), sorts them, and links what collides. Equal fingerprints are one
row throughout, and a task emits a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialise
from .components import components

SEED = 42
#: Variants that a task holds at a time.
SLICE = 1 << 21


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """Hashes of the ``width``-word shingles, repeats included; see ``fingerprints``."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], "<u8")
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-width]]
    return np.array([digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[width - 1 :], strict=True)], "<u8")


def fingerprint(text: bytes | None, width: int) -> int:
    """SimHash of the ``width``-word shingles, repeats included; see ``fingerprints``."""
    h = shingle_hashes(text, width)
    if len(h) < 2:
        return int(h.sum())
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long). Words are runs of other bytes than blank and
    \\x09-\\x0D, A-Z lower-cased; a text of fewer words is one shingle; one without words,
    or null, has fingerprint zero."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())})
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(hashed, "doc_id long, fp long")


def _masks(bits: int, most: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)], np.uint64)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least vertex of each vertex's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _collide(fps: np.ndarray, left: np.ndarray, value: int, fixed: int, out: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Links among fps by the variants whose top ``fixed`` bits are ``value``; ``left`` is
    how many of the lower bits each may still change."""
    if len(fps) < 2:
        return
    low = 64 - fixed
    size = sum(int((left == k).sum()) * sum(comb(low, i) for i in range(k + 1)) for k in np.unique(left))
    if size > SLICE and low:
        bit = ((fps >> np.uint64(low - 1)) & np.uint64(1)).astype(np.int8)
        for v in (0, 1):
            rest = left - (bit != v)
            _collide(fps[rest >= 0], rest[rest >= 0], 2 * value + v, fixed + 1, out)
        return
    keep = np.uint64((1 << low) - 1)
    variants, owners = [], []
    for k in np.unique(left):
        own = np.flatnonzero(left == k)
        masks = _masks(low, int(k))
        variants.append(((fps[own] & keep)[:, None] ^ masks).ravel())
        owners.append(np.repeat(own, len(masks)))
    v, o = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(v)
    v, o = v[order], o[order]
    again = v[1:] == v[:-1]
    if not again.any():
        return
    first = np.flatnonzero(np.append(True, ~again))
    centre = o[np.repeat(first, np.diff(np.append(first, len(v))))]
    linked = np.flatnonzero(o != centre)
    label = _forest(len(fps), o[linked], centre[linked])
    moved = np.flatnonzero(label != np.arange(len(fps)))
    out.append((fps[moved], fps[label[moved]]))


def ball_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all within
    ``radius`` bits, directly or through others; every link is a path of such pairs."""
    if radius % 2:
        raise ValueError("the radius must be even")
    half = radius // 2
    count = fps.count()
    bits = min(24, max(8, (count // 2048).bit_length()))
    flips = F.array(*(F.lit(int(m)) for m in _masks(bits, half)))
    prefix = F.shiftrightunsigned("fp", 64 - bits).cast("int")
    dealt = fps.select("fp", prefix.alias("prefix")).select("fp", F.explode(F.transform(flips, lambda m: F.col("prefix").bitwiseXOR(m.cast("int")))).alias("key"))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, key = pdf["fp"].to_numpy().view(np.uint64), int(pdf["key"].iloc[0])
        used = np.bitwise_count((fp >> np.uint64(64 - bits)) ^ np.uint64(key)).astype(np.int64)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        _collide(fp, half - used, key, bits, out)
        a = np.concatenate([x for x, _ in out] or [np.zeros(0, np.uint64)])
        b = np.concatenate([x for _, x in out] or [np.zeros(0, np.uint64)])
        pairs = np.unique(np.stack([a, b]), axis=1)
        return pd.DataFrame({"a": pairs[0].view(np.int64), "b": pairs[1].view(np.int64)})

    return dealt.groupBy("key").applyInPandas(link, "a long, b long")


def near_duplicates(docs: DataFrame, width: int, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (least doc_id of those that links reach, itself included).

    A row per input row. Rows with a null id are linked like others but give no
    component their name: a component of such rows alone has a null id. Equal texts have
    equal fingerprints and so one component. An empty table gives an empty one."""
    rows = materialise(fingerprints(docs, width, id_col, text_col), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(ball_links(distinct.select("fp"), radius))
    named = distinct.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.select("fp", "root").join(names, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
