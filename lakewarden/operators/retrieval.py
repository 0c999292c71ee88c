"""Exact vector search, its evaluation, and latency figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def clamp_k(k: int | None) -> int:
    """1 to 20; none means 5."""
    return 5 if k is None else max(1, min(20, int(k)))


def search(rows: DataFrame, query: list[float], k: int | None = 5, floor: float = 0.0, vec: str = "embedding", order: str = "vec_id") -> DataFrame:
    """The k best rows for one query: score rounded to 4 places after ranking, ties in
    order; rows under the floor are dropped. A heap per partition, merged."""
    q = F.array(*map(F.lit, map(float, query)))
    best = rows.withColumn("_s", dot(F.col(vec), q)).orderBy(F.desc("_s"), order).limit(clamp_k(k))
    return best.where(F.col("_s") >= floor).withColumn("score", F.round("_s", 4)).drop("_s")


#: Queries and rows in a block.
QUERY_BLOCK, ROW_BLOCK = 512, 4096


def _blocked(df: DataFrame, key: str, vec: str, size: int) -> DataFrame:
    """ids, vecs: blocks of about ``size`` rows, dealt by the hash of their ids."""
    some = df.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    blocks = F.lit(max(1, -(-some.count() // size)))
    packed = some.groupBy(F.pmod(F.xxhash64("id", F.hash("v")), blocks).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("r"))
    return packed.select(F.col("r.id").alias("ids"), F.flatten("r.v").alias("vecs"))


def search_batch(rows: DataFrame, queries: DataFrame, k: int, vec: str = "embedding", row_id: str = "vec_id", query_id: str = "query_id", query_vec: str = "query_vec", exclude_self: bool = True) -> DataFrame:
    """query_id, rank, row_id, score (unrounded) of a stated set of queries against all rows,
    blocks of queries against blocks of rows; a pair of blocks keeps k rows a query. Rows and
    queries without an id or a vector take no part."""
    import numpy as np
    import pandas as pd

    def scan(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                q_ids, ids = np.asarray(r.q_ids), np.asarray(r.ids)
                s = np.asarray(r.q_vecs, float).reshape(len(q_ids), -1) @ np.asarray(r.vecs, float).reshape(len(ids), -1).T
                if exclude_self:
                    s[q_ids[:, None] == ids] = -np.inf
                out = []
                for i, own in enumerate(s):
                    at = np.flatnonzero(own >= np.partition(own, len(own) - k)[len(own) - k]) if len(own) > k else np.arange(len(own))
                    at = at[np.isfinite(own[at])]
                    at = at[np.lexsort((ids[at], -own[at]))[:k]]
                    out.append(pd.DataFrame({query_id: q_ids[i], row_id: ids[at], "score": own[at]}))
                yield pd.concat(out)

    asked = _blocked(queries, query_id, query_vec, QUERY_BLOCK).select(F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    found = asked.crossJoin(_blocked(rows, row_id, vec, ROW_BLOCK)).mapInPandas(scan, f"{query_id} long, {row_id} long, score double")
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), row_id)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def evaluate(top: DataFrame, gold: DataFrame, query_id: str = "query_id") -> DataFrame:
    """questions, hits, hit_rate, mrr (over all questions), mean_rank (over hits), floor
    (least best score among hits). ``top`` has query_id, rank, source, score; ``gold`` has
    query_id, source, several rows for a question with alternatives."""
    questions = gold.select(query_id).distinct()
    rank = top.join(gold, [query_id, "source"], "left_semi").groupBy(query_id).agg(F.min("rank").alias("hit"))
    first = top.where("rank = 1").select(query_id, F.col("score").alias("top1"))
    j = questions.join(rank, query_id, "left").join(first, query_id, "left")
    return j.agg(
        F.count("*").alias("questions"),
        F.count("hit").alias("hits"),
        F.round(F.count("hit") / F.count("*"), 4).alias("hit_rate"),
        F.round(F.coalesce(F.sum(1 / F.col("hit")), F.lit(0.0)) / F.count("*"), 4).alias("mrr"),
        F.round(F.avg("hit"), 4).alias("mean_rank"),
        F.round(F.min(F.when(F.col("hit").isNotNull(), F.col("top1"))), 4).alias("floor"),
    )


def agreement(a: DataFrame, b: DataFrame, row_id: str = "vec_id", query_id: str = "query_id") -> DataFrame:
    """queries, same_top1, mean_overlap of two result sets (query_id, rank, row_id)."""
    pack = lambda d, n: d.groupBy(query_id).agg(F.min(F.when(F.col("rank") == 1, F.col(row_id))).alias(f"t{n}"), F.collect_set(row_id).alias(f"s{n}"))
    j = pack(a, "a").join(pack(b, "b"), query_id)
    share = F.size(F.array_intersect("sa", "sb")) / F.size("sa")
    return j.agg(F.count("*").alias("queries"), F.round(F.avg((F.col("ta") == F.col("tb")).cast("double")), 4).alias("same_top1"), F.round(F.avg(share), 4).alias("mean_overlap"))


def latency_stats(df: DataFrame, by: str, value: str, accuracy: int = 10_000) -> DataFrame:
    """n, mean, p50, p95 (nearest rank, ties to even), min, max by group.

    No group is sorted or collected. A first pass finds, with a sketch of bounded rank error,
    values that enclose each wanted rank; a second counts the values below, and those of the
    enclosed ones by value, which are a few in ``accuracy``; the rank is then found exactly."""
    margin, wanted = 4 / accuracy, {"p50": 0.5, "p95": 0.95}
    rows = df.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).alias("v"))
    ends = [min(max(p + d, 0.0), 1.0) for p in wanted.values() for d in (-margin, margin)]
    first = rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.percentile_approx("v", ends, accuracy).alias("e"))
    spans = F.array(*(F.struct(F.lit(name).alias("p"), (F.bround(F.lit(p) * (F.col("n") - 1), 0) + 1).alias("rank"), F.col("e")[2 * i].alias("low"), F.col("e")[2 * i + 1].alias("high")) for i, (name, p) in enumerate(wanted.items())))
    asked = first.select(F.col("g").alias("ag"), F.explode(spans).alias("s")).select("ag", "s.*")
    # a row a group and rank against rows: values at most the upper end, those below the lower as one
    met = rows.join(asked, F.col("g").eqNullSafe(F.col("ag"))).where("v <= high").select("g", "p", "rank", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v"))
    counted = met.groupBy("g", "p", "rank", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("g", "p").orderBy(F.col("v").asc_nulls_first()))
    found = counted.withColumn("upto", upto).where("upto >= rank and v is not null").groupBy("g").agg(*(F.min(F.when(F.col("p") == name, F.col("v"))).alias(name) for name in wanted))
    j = first.join(found.withColumnRenamed("g", "fg"), F.col("g").eqNullSafe(F.col("fg")), "left")
    return j.select(F.col("g").alias(by), "n", F.round("mean", 6).alias("mean"), *wanted, "min", "max")


def search_docs(rows: DataFrame, query: list[float], k: int | None = 5, floor: float = 0.0, vec: str = "embedding", order: str = "vec_id") -> tuple[DataFrame, dict]:
    """The passages at or above the floor among the k best, and the report on them: k,
    min_score, top_score, dropped_below_floor, and a note if none is left. At most 20 rows are
    looked at on the driver."""
    best = search(rows, query, k, float("-inf"), vec, order).collect()
    kept = [r for r in best if r["score"] >= floor]
    report = {"k": clamp_k(k), "min_score": floor, "top_score": best[0]["score"] if best else None, "dropped_below_floor": len(best) - len(kept), "note": None}
    if not kept:
        report["note"] = f"nothing reaches the score {floor}; the nearest has {report['top_score']}. No passage answers this: say so and cite none."
    schema = rows.select("*", F.lit(0.0).alias("score")).schema
    return rows.sparkSession.createDataFrame([tuple(r[f.name] for f in schema) for r in kept], schema), report
