"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise


def sample(docs: DataFrame, labels: DataFrame, label: str, use: Column, most: int, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """label (int), text and ``extra`` of at most about ``most`` rows, those of documents of
    least hash of the id, among rows of ``labels`` where ``use`` (over id and label) holds.
    Null labels and ids are left out; of several labels of one id the largest counts. Rows
    that repeat an id are rows of their own; if they bring more than ``most`` rows, rows are
    chosen by hash."""
    known = labels.select(F.col(id_col).alias("k"), F.col(label).cast("int").alias("label")).where("k is not null and label is not null").where(use)
    known = known.groupBy("k").agg(F.max("label").alias("label"))
    n = known.count()
    if n > most:
        share = int(most / n * 2**31)
        known = known.where(F.pmod(F.xxhash64(F.lit("sample"), "k"), F.lit(2**31)) < share)
    kept = materialise(known, "labels")
    texts = docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(f"extra{i}") for i, c in enumerate(extra)))
    rows = materialise(texts.join(F.broadcast(kept), "k").drop("k").withColumn("row", F.monotonically_increasing_id()), "labelled")
    got = rows.count()
    if got > 2 * most:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("rows"), "row"), F.lit(2**31)) < int(most / got * 2**31))
    return rows.drop("row")
