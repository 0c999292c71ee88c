"""Spark's catalogue as facts: the counterpart of reading a live database's catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scripts import SCHEMAS, looks_like_key, looks_like_money, looks_like_time


def catalog_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Column facts of the tables and views of a database."""
    rows = []
    for t in spark.catalog.listTables(database):
        name = ".".join([*(t.namespace or []), t.name])
        for c in spark.catalog.listColumns(name):
            rows.append((c.name, name, f"{name}.{c.name}", c.dataType, c.dataType.lower(), c.nullable, False, None, None, c.description or None, False, False, looks_like_key(c.name), looks_like_money(c.name), looks_like_time(c.name), False, None))
    return spark.createDataFrame(rows, SCHEMAS["column"])


def catalog_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Table facts of the tables and views of a database."""
    rows = []
    for t in spark.catalog.listTables(database):
        name = ".".join([*(t.namespace or []), t.name])
        cols = spark.catalog.listColumns(name)
        said = sum(bool(c.description) for c in cols)
        rows.append((t.name, ".".join(t.namespace or []), name, t.description or None, len(cols), [], False, 0, 0, said, len(cols) - said, False, False, 0))
    return spark.createDataFrame(rows, SCHEMAS["table"])


def capped(df: DataFrame, cap: int, what: str) -> DataFrame:
    """At most ``cap`` rows; a read that fills the cap is refused, not cut."""
    some = df.limit(cap)
    if some.count() >= cap:
        raise ValueError(f"{what}: the read filled its cap of {cap} rows")
    return some


def build_facts(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """Column facts from catalogue rows (ns, table, column, type, nullable, default, comment)
    and key rows (ns, table, columns, is_primary, is_unique): the keys of a table are joined
    to its columns by membership."""
    k = keys.select("ns", "table", F.explode("columns").alias("column"), F.col("is_primary").alias("p"), (F.col("is_unique") & (F.size("columns") == 1)).alias("u"))
    k = k.groupBy("ns", "table", "column").agg(F.max("p").alias("p"), F.max("u").alias("u"))
    j = columns.join(k, ["ns", "table", "column"], "left")
    false = F.lit(False)
    low = F.lower("column")
    has = lambda words: F.lit(False) if not words else F.greatest(*(F.contains(low, F.lit(w)) for w in words))
    from .scripts import MONEY, TIME_ENDS, TIME_STARTS

    at = F.concat_ws(".", "ns", "table")
    return j.select(
        F.col("column").alias("name"), at.alias("table"), F.concat_ws(".", at, "column").alias("qualified"), "type",
        F.trim(F.regexp_replace(F.lower("type"), r"\s+", " ")).alias("base_type"), "nullable", F.col("default").isNotNull().alias("has_default"), "default",
        F.lit(None).cast(T.StringType()).alias("references"), "comment", F.coalesce("p", false).alias("is_primary"), F.coalesce("u", "p", false).alias("is_unique"),
        ((low == "id") | F.endswith(low, F.lit("_id"))).alias("looks_like_key"), has(MONEY).alias("looks_like_money"),
        F.greatest(*(F.endswith(low, F.lit(e)) for e in TIME_ENDS), *(F.startswith(low, F.lit(s)) for s in TIME_STARTS)).alias("looks_like_time"), false.alias("added_by_change"), F.lit(None).cast(T.StringType()).alias("added_by"),
    )


def table_stats(spark: SparkSession, tables: dict[str, DataFrame], most: int = 20) -> DataFrame:
    """table, rows, files of the largest tables. Dead rows and vacuum times have no counterpart
    here and are null."""
    from functools import reduce

    rows = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows", F.lit(len(df.inputFiles())).alias("files"), F.lit(None).cast("long").alias("dead_rows"), F.lit(None).cast("timestamp").alias("last_vacuum")) for n, df in tables.items()]
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc("rows"), "table").limit(most)
