"""Reviews of many scripts at once: facts, packs, outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scripts import SCHEMAS, read_scripts
from . import rules

SUBJECTS = {"table": "qualified", "column": "qualified", "index": "qualified", "change": "subject"}


def review_scripts(scripts: DataFrame, packs: list[dict], key: str = "script_id", text: str = "sql") -> tuple[DataFrame, DataFrame]:
    """(applied, findings) by script: rule, matched, fired; and findings, of equal (script,
    check, subject) the first. Each target's facts are read once for all scripts and rules."""
    by: dict[str, list[dict]] = {}
    for p in packs:
        for r in p["rules"]:
            by.setdefault(r["target"], []).append(r)
    counts, found = [], []
    for target, rs in by.items():
        facts = read_scripts(scripts, target, key, text)
        preds = [rules._predicates(r, facts) for r in rs]
        wide = facts.groupBy(key).agg(*[x for i, (sel, bad) in enumerate(preds) for x in (F.count(F.when(sel, 1)).alias(f"m{i}"), F.count(F.when(bad, 1)).alias(f"f{i}"))])
        cells = F.array(*(F.struct(F.lit(r["id"]).alias("rule"), F.col(f"m{i}").alias("matched"), F.col(f"f{i}").alias("fired")) for i, r in enumerate(rs)))
        counts.append(wide.select(key, F.explode(cells).alias("r")).select(key, "r.*"))
        some = rules.findings(rs, facts, F.to_json(F.struct(F.col(key).alias("k"), F.col(SUBJECTS[target]).alias("s"))))
        parts = F.from_json("subject", "k string, s string")
        found.append(some.withColumn("_p", parts).select(F.col("_p.k").alias(key), "check", "severity", "title", F.coalesce("_p.s", F.lit("")).alias("subject"), "detail", "fix"))
    applied = reduce(DataFrame.unionByName, counts)
    # a script without facts of a target still has a row for each of its rules
    ids = scripts.select(F.col(key).cast("string").alias(key)).distinct()
    names = scripts.sparkSession.createDataFrame([(r["id"],) for rs in by.values() for r in rs], "rule string")
    applied = ids.join(F.broadcast(names), F.lit(True)).join(applied, [key, "rule"], "left").na.fill(0, ["matched", "fired"])
    return applied, reduce(DataFrame.unionByName, found).orderBy(key, rules.severity_rank(), "check", "subject")


def outcomes(applied: DataFrame, key: str = "script_id") -> DataFrame:
    """script, code: 2 if no rule met a row, 1 if any found one, else 0."""
    per = applied.groupBy(key).agg(F.sum("matched").alias("m"), F.sum("fired").alias("f"))
    return per.select(key, F.when(F.col("m") == 0, 2).when(F.col("f") > 0, 1).otherwise(0).alias("code"))


def batch_outcome(codes: DataFrame) -> DataFrame:
    return codes.agg(F.coalesce(F.max("code"), F.lit(0)).alias("code"))


def verify_pack(spark: SparkSession, pack: dict) -> list[str]:
    """Rules that judge one of their own examples wrongly; all examples run in one job."""
    rows = [(f"{r['id']}|{kind}|{i}", r["id"], kind, sql) for r in pack["rules"] for kind in ("fires", "silent") for i, sql in enumerate(r["examples"][kind])]
    scripts = spark.createDataFrame(rows, "script_id string, rule string, kind string, sql string")
    applied, _ = review_scripts(scripts, [pack])
    got = scripts.join(applied, ["script_id", "rule"]).where((F.col("kind") == "fires") != (F.col("fired") > 0))
    return sorted(r.script_id for r in got.select("script_id").collect())


def overlay(catalog: DataFrame, script: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(indexes, tables not in the catalogue): a script's indexes on catalogue tables replace
    those of the same name; those on unknown tables are listed, not merged."""
    known = catalog.select("table").distinct()
    mine = script.join(known, "table", "left_semi").select(catalog.columns)
    kept = catalog.join(mine.select("table", "name"), ["table", "name"], "left_anti").select(catalog.columns)
    return kept.unionByName(mine), script.join(known, "table", "left_anti").select("table").distinct()


def latest_by(rows: DataFrame, by: str, order: Column) -> DataFrame:
    """The last run of each suite."""
    w = Window.partitionBy(by).orderBy(order.desc())
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def empty_facts(spark: SparkSession, target: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[target])
