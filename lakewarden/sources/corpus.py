"""Corpora, question banks and script folders as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _stem() -> "F.Column":
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """source (file stem), text of every .md and .txt below a folder."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").text(path)
    return files.select(_stem().alias("source"), F.col("value").alias("text"))


def read_script_folder(spark: SparkSession, path: str) -> DataFrame:
    """script_id (path), sql of every .sql below a folder."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.sql").text(path)
    return files.select(F.col("_metadata.file_path").alias("script_id"), F.col("value").alias("sql"))


def merge_corpora(corpora: list[DataFrame]) -> DataFrame:
    """Union of corpora; a source in two of them is an error."""
    out = corpora[0]
    for c in corpora[1:]:
        out = out.unionByName(c)
    twice = out.groupBy("source").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError("sources in more than one corpus: " + ", ".join(sorted(r.source for r in twice)))
    return out


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """question, gold (alternatives) from the rows of Markdown tables."""
    cells = F.transform(F.split(F.trim("value"), r"\|"), F.trim)
    rows = spark.read.text(path).where(F.trim("value").startswith("|")).select(cells.alias("c")).where("size(c) >= 5")
    rows = rows.select(F.col("c")[1].alias("n"), F.col("c")[2].alias("question"), F.col("c")[3].alias("gold")).where(~F.col("n").isin("#", "") & ~F.col("n").rlike(r"^:?-+:?$"))
    return rows.select("question", F.filter(F.transform(F.split("gold", "/"), F.trim), lambda g: g != "").alias("gold"))


def draft_questions(docs: DataFrame, most: int = 2) -> DataFrame:
    """source, question: up to ``most`` drafts from the second-level headings of each note."""
    head = F.regexp_extract(F.col("line"), r"^##\s+(.*?)\s*#*\s*$", 1)
    lines = docs.select("source", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).withColumn("h", head).where("h <> ''")
    low = F.lower("h")
    ask = F.when(low.rlike("why|cause|原因"), F.concat(F.lit("What causes "), "h", F.lit("?"))).when(low.rlike("how|fix|steps|处理|步骤"), F.concat(F.lit("How to handle "), "h", F.lit("?"))).otherwise(F.concat(F.lit("What is "), "h", F.lit("?")))
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("source").orderBy("pos"))
    return lines.withColumn("k", k).where(F.col("k") <= most).select("source", ask.alias("question"))
