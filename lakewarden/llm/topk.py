"""Operator 5, exact top-k by inner product over a pivot-distance index.

Index. Equal vectors are one row with their k + 1 least ids: no query takes more of them.
Every row is keyed by its nearest pivot and its distance to it. Sorted by that
key the table is cut into blocks: annuli around a pivot, at most ``BLOCK`` vectors each,
with their range of distances and norms.

Search. Queries are cut into blocks in the same order. For a query q, a block around
pivot p at distances [d0, d1] and norms up to n, the triangle inequality gives
|q - v| >= max(|q - p| - d1, d0 - |q - p|, 0), hence
q.v <= (|q|^2 + n^2 - that^2) / 2, and Cauchy-Schwarz gives q.v <= q.p + |q| d1. First
each query searches the annuli that promise most, expanding until it has k scores; the
k-th is its threshold. Then it visits the other blocks whose bound reaches the
threshold, and no others. Sums are exact, since all
scores lie below 2^53; a vector whose square does not is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, parts

#: Vectors in an index block, queries in a query block.
BLOCK, QUERIES = 2048, 512
#: Pivots, chosen from at most this many rows: those with the least hashes.
PIVOTS, PIVOT_SAMPLE = 32, 4096
#: Blocks that a query block searches first.
FIRST = 3


def quantise(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v: floor(scale * x) of each component, x as double. Rows with a null vector,
    or with a null, NaN or infinite component, or without components, take no part, nor do
    rows with a null id."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e")).where("vec_id is not null and size(e) > 0")
    good = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(good).select("vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """Farthest-first choice from a bounded sample of vectors."""
    some = rows.orderBy(F.xxhash64("vec_id")).limit(PIVOT_SAMPLE).collect()
    if not some:
        return np.zeros((0, 0))
    x = np.array([r.v for r in some])
    chosen, gap = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(pivots, len(x)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _dump(x: np.ndarray) -> bytes:
    """A byte for the kind, then 16-bit integers where they are exact, else doubles."""
    if np.abs(x).max() < 2**15:
        return b"h" + x.astype("<i2").tobytes()
    return b"d" + x.astype("<f8").tobytes()


def _load(data: bytes, n: int) -> np.ndarray:
    kind = "<i2" if data[:1] == b"h" else "<f8"
    return np.frombuffer(data, kind, offset=1).reshape(n, -1).astype(np.float64)


KEYED = "vec_id long, ids array<long>, v array<double>, pivot int, d double"
BLOCKS = "id long, pivot int, lo double, hi double, norm double, n int, ids binary, counts binary, vecs binary"


def _one_size(rows: DataFrame, size: int) -> DataFrame:
    """Shorter vectors get zeros at their end, which change no product."""
    return rows.withColumn("v", F.when(F.size("v") == size, F.col("v")).otherwise(F.concat("v", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("v")))))


def _collapsed(rows: DataFrame, k: int) -> DataFrame:
    """vec_id (the least), ids, v: a row for each different vector, with its k + 1 least ids, a
    repeated id k times at the most."""
    each = rows.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    least = each.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "n"))), lambda x: F.array_repeat(x["vec_id"], x["n"])))
    return least.groupBy("v").agg(ids.alias("ids")).select(F.get("ids", F.lit(0)).alias("vec_id"), "ids", "v")


def _keyed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    square = (pivots**2).sum(axis=1)

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                if (x**2).sum(axis=1).max() >= 2.0**53:
                    raise ValueError("the vectors are too long: their scores would not be exact")
                far = np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + square, 0)
                near = far.argmin(axis=1)
                yield pdf.assign(pivot=near.astype(np.int32), d=np.sqrt(far[np.arange(len(x)), near]))

    return rows.mapInPandas(key, KEYED)


def _blocks(keyed: DataFrame, size: int, name: str) -> DataFrame:
    """Sorted by (pivot, distance, id) and cut; a block has one pivot."""
    n = parts(keyed.sparkSession)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        made, held = TaskContext.get().partitionId() << 32, None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            while len(held):
                run = int((held["pivot"] == held["pivot"].iloc[0]).to_numpy().argmin()) or len(held)
                if run == len(held) and run < size:
                    break  # the next batch may go on
                take = min(run, size)
                yield row(made, held.iloc[:take])
                made, held = made + 1, held.iloc[take:].reset_index(drop=True)
        if held is not None and len(held):
            yield row(made, held)

    def row(i: int, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy())
        return pd.DataFrame({"id": [i], "pivot": [int(pdf["pivot"].iloc[0])], "lo": [pdf["d"].min()], "hi": [pdf["d"].max()], "norm": [np.sqrt((x**2).sum(axis=1).max())], "n": [len(x)], "ids": [np.concatenate(pdf["ids"].to_list()).astype(np.int64).tobytes()], "counts": [pdf["ids"].map(len).to_numpy(np.int64).tobytes()], "vecs": [_dump(x)]})

    ordered = keyed.repartitionByRange(n, "pivot", "d", "vec_id").sortWithinPartitions("pivot", "d", "vec_id")
    return materialise(ordered.mapInPandas(pack, BLOCKS), name)


def bounds(q: np.ndarray, pivots: np.ndarray, pivot: np.ndarray, lo: np.ndarray, hi: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """(queries, blocks): no vector of the block has a greater inner product."""
    p = pivots[pivot]
    dot, square = q @ p.T, (q**2).sum(axis=1)[:, None]
    gap = np.sqrt(np.maximum(square - 2 * dot + (p**2).sum(axis=1), 0))
    away = np.maximum(np.maximum(gap - hi, lo - gap), 0)
    # one more for what floats lose; scores are integers
    return np.minimum(np.minimum((square + norm**2 - away**2) / 2, dot + np.sqrt(square) * hi), np.sqrt(square) * norm) + 1


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _search(k: int, with_threshold: bool):
    """mapInPandas over pairs of a query block and an index block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                qid, vid, counts = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64), np.frombuffer(r.counts, np.int64)
                q, x, starts = _load(r.q_vecs, len(qid)), _load(r.vecs, len(counts)), np.cumsum(counts) - counts
                scores = q @ x.T
                floor = np.frombuffer(r.floor) if with_threshold else np.full(len(qid), -np.inf)
                last = np.frombuffer(r.last, np.int64) if with_threshold else np.zeros(len(qid), np.int64)
                out = []
                for i in np.flatnonzero(scores.max(axis=1) >= floor):
                    # the k + 1 best vectors, and those that tie with the last: one may be the query's own
                    least = floor[i] if len(counts) <= k + 1 else max(floor[i], np.partition(scores[i], len(counts) - k - 1)[len(counts) - k - 1])
                    some = np.flatnonzero(scores[i] >= least)
                    n = counts[some]
                    ids = vid[np.arange(n.sum()) + np.repeat(starts[some] - (np.cumsum(n) - n), n)]
                    own = np.repeat(scores[i][some], n)
                    ok = ((own > floor[i]) | (own == floor[i]) & (ids < last[i])) & (ids != qid[i])
                    ids, own = ids[ok], own[ok]
                    at = _best(ids, own, k)
                    out.append(pd.DataFrame({"qb": r.qb, "query_id": qid[i], "vec_id": ids[at], "score": own[at].astype(np.int64)}))
                if out:
                    yield pd.concat(out, ignore_index=True)

    return run


FOUND = "qb long, query_id long, vec_id long, score long"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k rows of highest inner product,
    all if fewer, without rows of the query's own id; ties to the smaller id. ``rows`` and
    ``queries`` are as ``quantise`` makes them; a shorter vector counts as followed by zeros.
    Repeated ids are separate candidates, repeated query ids one query. Empty tables give an
    empty one."""
    size = max(t.agg(F.max(F.size("v"))).first()[0] or 0 for t in (rows, queries))
    queries = _one_size(queries, size)
    rows = materialise(_collapsed(_one_size(rows, size), k), "vectors")
    p = choose_pivots(rows, pivots)
    if not len(p):
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    index = _blocks(_keyed(rows, p), BLOCK, "index")
    asked = _blocks(_keyed(queries.dropDuplicates(["vec_id"]).select("vec_id", F.array("vec_id").alias("ids"), "v"), p), QUERIES, "queries")
    q = asked.select(F.col("id").alias("qb"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    # a row per index block: summaries only
    about = index.select("id", "pivot", "lo", "hi", "norm", "n")

    def plan(first: bool):
        def run(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pairs:
                for r in pdf.itertuples(index=False):
                    x = _load(r.q_vecs, len(r.q_ids) // 8)
                    b = [np.array([s[c] for s in r.about]) for c in ("pivot", "lo", "hi", "norm", "id", "n")]
                    top = bounds(x, p, *b[:4])
                    if first:
                        order = np.argsort(-top.max(axis=0), kind="stable")
                        need = int(np.searchsorted(np.cumsum(b[5][order]), k + 1)) + 1
                        use = order[: max(FIRST, need)]
                    else:
                        use = np.flatnonzero((top >= np.frombuffer(r.floor)[:, None]).any(axis=0))
                    yield pd.DataFrame({"qb": r.qb, "id": b[4][use]})

        return run

    # summaries travel in chunks to every query block: blocks against blocks, no vectors
    chunked = about.groupBy(F.pmod(F.xxhash64("id"), F.lit(_chunks(about))).alias("c")).agg(F.collect_list(F.struct("id", "pivot", "lo", "hi", "norm", "n")).alias("about"))
    seeds = q.crossJoin(chunked).mapInPandas(plan(True), "qb long, id long")
    blocks = index.select("id", "ids", "counts", "vecs")
    seeds = materialise(seeds, "seeds")
    found = materialise(seeds.join(q, "qb").join(blocks, "id").mapInPandas(_search(k, False), FOUND), "found")
    # the k-th row so far: only rows that would stand before it can still matter
    kth = _ranked(found, k).where(F.col("rank") == k).select("qb", "query_id", F.struct(F.col("score").cast("double").alias("score"), F.col("vec_id")).alias("kth"))
    floors = kth.groupBy("qb").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "kth"))).alias("by"))

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, last = [], []
            for ids, by in zip(pdf["q_ids"], pdf["by"], strict=True):
                by = dict(by) if by is not None else {}
                vals = [by.get(i) for i in np.frombuffer(ids, np.int64).tolist()]
                out.append(np.array([-np.inf if v is None else v["score"] for v in vals], float).tobytes())
                last.append(np.array([0 if v is None else v["vec_id"] for v in vals], np.int64).tobytes())
            yield pdf.drop(columns="by").assign(floor=out, last=last)

    q = materialise(q.join(floors, "qb", "left").mapInPandas(aligned, "qb long, q_ids binary, q_vecs binary, floor binary, last binary"), "floors")
    rest = q.crossJoin(chunked).mapInPandas(plan(False), "qb long, id long").join(seeds, ["qb", "id"], "left_anti")
    more = rest.join(q, "qb").join(blocks, "id").mapInPandas(_search(k, True), FOUND)
    return _ranked(found.unionByName(more), k).select("query_id", "rank", "vec_id", "score")


def _chunks(about: DataFrame) -> int:
    return max(1, about.count() // 4096)
