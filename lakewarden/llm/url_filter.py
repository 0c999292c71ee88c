"""Operator 6, URL filters: rules over host and path prefixes as a sort-merge range join.

A host's canonical key is its labels in reverse order, each followed by a low separator,
so that a host and all its subdomains form one interval of keys, and a rule is that
interval with a path prefix. Distinct hosts (not pages, so a host that holds a third of
the pages is one row) and rules are dealt to key ranges; a rule goes to every range that
its interval meets. Each task sweeps its sorted range once with a stack of the rules
whose intervals are open, which are nested by construction, and gives each host its
rules. A page then takes, of its host's rules, the longest whose path prefix fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, parts

SEP = "\x01"
RULES = "rule_host string, rule_path string, verdict string"
#: Hosts that are looked at, by the least hashes of their keys, to choose range bounds.
BOUND_SAMPLE = 20_000


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/ ? #`` or the end, A-Z
    lower-cased; path then up to ``? #`` or the end. Both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    tail = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(tail, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(tail, r"\A[^/?#]*([^?#]*)", 1)
    return _lower_ascii(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), SEP), F.lit(SEP))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) triples as the rules table."""
    return spark.createDataFrame(rules, RULES)


def _range_of(key: Column, bounds: list[str]) -> Column:
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= key))


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (range, key, kind): rules before hosts of the same key."""
    stack: list[tuple[str, dict]] = []
    at = None
    for pdf in batches:
        hosts, found = [], []
        for rng, key, kind, host, path, verdict in pdf.itertuples(index=False):
            if rng != at:
                stack, at = [], rng
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, {"rule_host": host, "rule_path": path, "verdict": verdict}))
            elif stack:
                hosts.append(host)
                found.append([r for _, r in stack])
        if hosts:
            yield pd.DataFrame({"host": hosts, "rules": found})


def apply_rules(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page id, host, path, rule (host and path of the rule that won, null if none fits)
    and verdict, a row per input row.

    Of the rules that fit, the longest (host and path together) wins, then the one with
    the longer path, then ``block`` before ``allow``. Null urls have empty host and path
    and get ``default``; so do all pages when there are no rules. Rules with a null or
    empty host fit nothing; a null path is empty. Other columns are not read.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    hosts = materialise(rows.select("host").where("host <> ''").distinct().withColumn("key", host_key(F.col("host"))), "hosts")
    clean = rules.where("rule_host <> ''").select(_lower_ascii(F.col("rule_host")).alias("rule_host"), F.coalesce("rule_path", F.lit("")).alias("rule_path"), "verdict").distinct()
    n = parts(spark)
    # quantiles of a bounded sample of keys
    some = sorted(r.key for r in hosts.orderBy(F.xxhash64("key")).limit(BOUND_SAMPLE).select("key").collect())
    bounds = sorted({some[i * len(some) // n] for i in range(1, n)}) if some else []
    lo = host_key(F.col("rule_host"))
    keyed = clean.withColumn("key", lo)
    # the interval of a key ends before the key with its last separator raised by one
    spans = F.sequence(_range_of(F.col("key"), bounds), _range_of(F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("\x02")), bounds))
    both = keyed.select(F.explode(spans).alias("rng"), "key", F.lit(0).alias("kind"), F.col("rule_host").alias("host"), F.col("rule_path").alias("path"), "verdict").unionByName(
        hosts.select(_range_of(F.col("key"), bounds).alias("rng"), "key", F.lit(1).alias("kind"), "host", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("verdict"))
    )
    swept = both.repartition(n, "rng").sortWithinPartitions("rng", "key", "kind").mapInPandas(_sweep, "host string, rules array<struct<rule_host:string,rule_path:string,verdict:string>>")
    joined = rows.join(swept, "host", "left")
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"]))
    best = F.array_max(
        F.transform(
            fits,
            lambda r: F.struct(
                (F.length(r["rule_host"]) + F.length(r["rule_path"])).alias("n"),
                F.length(r["rule_path"]).alias("m"),
                (r["verdict"] == "block").alias("b"),
                F.concat(r["rule_host"], r["rule_path"]).alias("rule"),
                r["verdict"].alias("verdict"),
            ),
        )
    )
    return joined.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
