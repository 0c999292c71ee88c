"""What the data itself says: profiles, keys, joins that lose or multiply rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, rows, nulls, null_frac, n_distinct: all columns in one pass."""
    columns = columns or df.columns
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        aggs += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"n{i}"), F.countDistinct(c).alias(f"d{i}")]
    wide = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"n{i}").alias("nulls"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(columns)))
    out = wide.select(F.explode(rows).alias("r")).select("r.*")
    return out.select("column", "rows", "nulls", F.round(F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows")).otherwise(0.0), 6).alias("null_frac"), "n_distinct")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()))


def key_uniqueness(df: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """key, rows, distinct_rows, is_unique for each candidate key."""
    out = []
    for name, columns in keys.items():
        per = df.groupBy(*columns).agg(F.count("*").alias("n"))
        out.append(per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows")).select(F.lit(name).alias("key"), "rows", "distinct_rows"))
    return reduce(DataFrame.unionByName, out).withColumn("is_unique", F.col("rows") == F.col("distinct_rows"))


def fanout(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, measure: str) -> DataFrame:
    """How a join multiplies a sum: one row. The child is counted by key before the join, so
    no multiplied row is made, and a key with very many rows is one row."""
    n = child.groupBy(F.col(child_key).alias("_k")).agg(F.count("*").alias("_n"))
    j = parent.join(n, parent[parent_key] == F.col("_k"), "left")
    m = F.col(measure)
    return j.agg(
        F.round(F.sum(m), 2).alias("sum_before"),
        F.round(F.sum(m * F.col("_n")), 2).alias("sum_after"),
        F.count("*").alias("rows_before"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_after"),
        F.count(F.when(F.col("_n") > 1, 1)).alias("multiplied_rows"),
    )


def left_join_cancelled(left: DataFrame, right: DataFrame, left_key: str, right_key: str, test: Column) -> DataFrame:
    """Rows of the left side that a left join keeps and that a test on the right side then
    drops: kept_by_join, kept_by_test, unmatched, lost."""
    n = right.groupBy(F.col(right_key).alias("_k")).agg(F.count(F.when(test, 1)).alias("_ok"))
    j = left.join(n, left[left_key] == F.col("_k"), "left")
    kept, ok = F.count("*"), F.count(F.when(F.col("_ok") > 0, 1))
    return j.agg(kept.alias("kept_by_join"), ok.alias("kept_by_test"), F.count(F.when(F.col("_k").isNull(), 1)).alias("unmatched")).withColumn("lost", F.col("kept_by_join") - F.col("kept_by_test"))


def not_in_trap(outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: Column) -> DataFrame:
    """Rows that NOT IN and NOT EXISTS keep: they differ when the inner side holds a null."""
    keys = inner.select(inner_key.alias("_k"))
    exists = outer.join(keys.where("_k is not null").distinct(), outer[outer_key] == F.col("_k"), "left_anti").agg(F.count("*").alias("not_exists_rows"))
    nulls = keys.agg(F.count(F.when(F.col("_k").isNull(), 1)).alias("null_keys"))
    return exists.join(nulls, F.lit(True)).select("not_exists_rows", F.when(F.col("null_keys") > 0, 0).otherwise(F.col("not_exists_rows")).cast("long").alias("not_in_rows"), "null_keys")


def null_join_loss(df: DataFrame, key: Column, other: DataFrame, other_key: str) -> DataFrame:
    """Rows that an inner join loses: for a null key, and for want of a partner."""
    j = df.select(key.alias("_a")).join(other.select(F.col(other_key).alias("_b")).where("_b is not null").distinct(), F.col("_a") == F.col("_b"), "left")
    return j.agg(F.count("*").alias("rows"), F.count(F.when(F.col("_a").isNull(), 1)).alias("null_keys"), F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNull(), 1)).alias("no_partner"), F.count("_b").alias("joined"))


def float_drift(df: DataFrame, by: str, value: str) -> DataFrame:
    """Sums of money kept as double against exact cents."""
    d = F.col(value)
    return df.groupBy(by).agg(F.round(F.sum(d), 2).alias("double_sum"), F.sum(d.cast("decimal(18,2)")).cast("double").alias("exact_sum")).withColumn("drifts", F.abs(F.col("double_sum") - F.col("exact_sum")) > 0.005)


def reconcile(steps: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """step, rows, lost (against the step before)."""
    counts = reduce(DataFrame.unionByName, (steps[s].agg(F.count("*").alias("rows")).select(F.lit(i).alias("n"), F.lit(s).alias("step"), "rows") for i, s in enumerate(order)))
    before = counts.select((F.col("n") + 1).alias("n"), F.col("rows").alias("_before"))
    return counts.join(before, "n", "left").select("step", "rows", (F.coalesce("_before", "rows") - F.col("rows")).alias("lost"))
