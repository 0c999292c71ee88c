"""Rule packs over any DataFrame: select, then assert or forbid, then findings.

A pack is a dict or JSON: ``rulepack``, ``version``, ``applies_to``, ``rules``; a rule has
id, severity, target, title, detail, fix, select, assert or forbid, and examples. All
rules of a target share one scan for their counts and one for their findings.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.predicates import ASSERT_OPS, assertion, render, selection, split_key

SEVERITIES = ("high", "medium", "low")
FINDING = "check string, severity string, title string, subject string, detail string, fix string"


def load_pack(source: str | dict) -> dict:
    """A pack from a dict, JSON text or the path of a JSON file."""
    if isinstance(source, dict):
        return source
    if source.lstrip().startswith("{"):
        return json.loads(source)
    with open(source, encoding="utf-8") as f:
        return json.load(f)


def validate_pack(pack: dict, schemas: dict) -> list[str]:
    """What is wrong with a pack; ``schemas`` gives each target's StructType."""
    wrong = []
    if not isinstance(pack.get("rulepack"), str) or not pack.get("rulepack"):
        wrong.append("rulepack: a name is missing")
    if pack.get("version") != 1:
        wrong.append("version: only 1 is known")
    seen = set()
    for i, r in enumerate(pack.get("rules") or []):
        at = r.get("id") or f"rule {i + 1}"
        if not re.fullmatch(r"[a-z0-9][a-z0-9-]*", str(r.get("id", ""))):
            wrong.append(f"{at}: id must be lower-case words joined by -")
        if at in seen:
            wrong.append(f"{at}: id is used twice")
        seen.add(at)
        if r.get("severity") not in SEVERITIES:
            wrong.append(f"{at}: severity must be one of {', '.join(SEVERITIES)}")
        schema = schemas.get(r.get("target"))
        if schema is None:
            wrong.append(f"{at}: unknown target {r.get('target')!r}")
            continue
        for k in ("title", "detail", "fix"):
            text = r.get(k)
            if not isinstance(text, str) or not text:
                wrong.append(f"{at}: {k} is missing")
            else:
                wrong += [f"{at}: {k} names unknown field {f}" for f in re.findall(r"\{(\w+)\}", text) if f not in schema.names]
        for key, value in (r.get("select") or {}).items():
            try:
                _, op = split_key(key, schema)
            except ValueError as e:
                wrong.append(f"{at}: select: {e}")
                continue
            if op in ("in", "not_in", "matches_all") and not isinstance(value, list):
                wrong.append(f"{at}: select {key} takes a list")
            if op in ("present", "absent") and not isinstance(value, bool):
                wrong.append(f"{at}: select {key} takes true or false")
            for p in [value] if op in ("matches", "not_matches") else value if op == "matches_all" and isinstance(value, list) else []:
                wrong += _bad_pattern(at, p)
        tests = r.get("assert")
        if bool(tests) == bool(r.get("forbid")):
            wrong.append(f"{at}: exactly one of assert and forbid")
        for a in tests or []:
            if a.get("field") not in schema.names:
                wrong.append(f"{at}: assert: unknown field {a.get('field')!r}")
            if a.get("op") not in ASSERT_OPS:
                wrong.append(f"{at}: assert: unknown operator {a.get('op')!r}")
            for p in [a.get("value")] if a.get("op") in ("matches", "not_matches") else []:
                wrong += _bad_pattern(at, p)
    if not pack.get("rules"):
        wrong.append("rules: none")
    return wrong


def _bad_pattern(at: str, pattern: Any) -> list[str]:
    try:
        re.compile(pattern)
    except (re.error, TypeError):
        return [f"{at}: {pattern!r} is no pattern"]
    return []


def _predicates(rule: dict, df: DataFrame) -> tuple[Column, Column]:
    """(selected, failing) of a rule."""
    sel = selection(rule.get("select"), df.schema)
    if rule.get("forbid"):
        return sel, sel
    held = reduce(Column.__and__, (assertion(a, df.schema) for a in rule["assert"]))
    return sel, sel & ~held


def applied(rules: list[dict], df: DataFrame) -> DataFrame:
    """rule, matched, fired for every rule on one target, in one aggregation."""
    aggs = []
    for i, r in enumerate(rules):
        sel, bad = _predicates(r, df)
        aggs += [F.count(F.when(sel, 1)).alias(f"m{i}"), F.count(F.when(bad, 1)).alias(f"f{i}")]
    counts = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(r["id"]).alias("rule"), F.col(f"m{i}").alias("matched"), F.col(f"f{i}").alias("fired")) for i, r in enumerate(rules)))
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def findings(rules: list[dict], df: DataFrame, subject: Column, dedup: bool = True) -> DataFrame:
    """A row for each row that a rule finds; of equal (check, subject) the first rule's
    stays. One scan: a row is expanded to the rules that it fails, which is mostly none."""
    subject = F.coalesce(subject.cast("string"), F.lit(""))
    hits = []
    for i, r in enumerate(rules):
        _, bad = _predicates(r, df)
        text = [render(r.get(k, ""), df.schema).alias(k) for k in ("title", "detail", "fix")]
        hits.append(F.when(bad, F.struct(F.lit(i).alias("n"), F.lit(r["id"]).alias("check"), F.lit(r["severity"]).alias("severity"), text[0], subject.alias("subject"), *text[1:])))
    some = df.select(F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")).select("h.*")
    if dedup:
        w = Window.partitionBy("check", "subject").orderBy("n", "title", "detail", "fix")
        some = some.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    return some.select("check", "severity", "title", "subject", "detail", "fix")


def severity_rank(severity: str = "severity") -> Column:
    return F.when(F.col(severity) == "high", 0).when(F.col(severity) == "medium", 1).when(F.col(severity) == "low", 2).otherwise(3)


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy(severity_rank(), "check", "subject")


def run_pack(pack: dict, targets: dict[str, tuple[DataFrame, Column]]) -> tuple[DataFrame, DataFrame]:
    """(applied, findings) of a pack over its targets."""
    by: dict[str, list[dict]] = {}
    for r in pack["rules"]:
        by.setdefault(r["target"], []).append(r)
    counts = [applied(rs, targets[t][0]) for t, rs in by.items()]
    found = [findings(rs, *targets[t]) for t, rs in by.items()]
    return reduce(DataFrame.unionByName, counts), ordered(reduce(DataFrame.unionByName, found))


def outcome(report: DataFrame, found: DataFrame) -> DataFrame:
    """One row, code: 2 if no rule matched a row, 1 if there are findings, else 0."""
    a = report.agg(F.coalesce(F.sum("matched"), F.lit(0)).alias("matched"))
    f = found.agg(F.count("*").alias("n"))
    return a.join(f, F.lit(True)).select(F.when(F.col("matched") == 0, 2).when(F.col("n") > 0, 1).otherwise(0).alias("code"))


def signature(rule: dict) -> str:
    """The same for rules that judge the same rows alike."""
    tests = sorted(rule.get("assert") or [], key=lambda a: json.dumps(a, sort_keys=True))
    return json.dumps({"target": rule["target"], "select": rule.get("select") or {}, "assert": tests, "forbid": bool(rule.get("forbid"))}, sort_keys=True, ensure_ascii=False)


def overlaps(rules: list[dict]) -> list[dict]:
    """Pairs of rules that are equal, redundant (one selects a subset under the same
    assertions) or conflicting (opposite assertions on a common selection)."""
    opposite = {("present", "absent"), ("matches", "not_matches"), ("equals", "not_equals"), ("in", "not_in")}
    out = []
    for i, a in enumerate(rules):
        for b in rules[i + 1 :]:
            if a["target"] != b["target"]:
                continue
            sa, sb = a.get("select") or {}, b.get("select") or {}
            inside = sa.items() <= sb.items() or sb.items() <= sa.items()
            same = sorted(map(str, a.get("assert") or [])) == sorted(map(str, b.get("assert") or [])) and bool(a.get("forbid")) == bool(b.get("forbid"))
            clash = any(x["field"] == y["field"] and x.get("value") == y.get("value") and ((x["op"], y["op"]) in opposite or (y["op"], x["op"]) in opposite) for x, y in product(a.get("assert") or [], b.get("assert") or []))
            kind = "exact" if signature(a) == signature(b) else "redundant" if inside and same else "conflicting" if inside and clash else None
            if kind:
                out.append({"kind": kind, "first": a["id"], "second": b["id"]})
    return out


def infer(df: DataFrame, labels: Column, candidates: list[tuple[dict, dict]]) -> DataFrame:
    """Which (select, assertion) pairs separate labelled rows: n (the candidate's place),
    right, wrong and separates, the plainest first. ``labels`` is true for rows that must
    be found. One aggregation judges all candidates."""
    aggs = []
    for i, (sel, a) in enumerate(candidates):
        bad = selection(sel, df.schema) & ~assertion(a, df.schema)
        aggs += [F.count(F.when(bad == labels, 1)).alias(f"r{i}"), F.count(F.when(bad != labels, 1)).alias(f"w{i}")]
    counts = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(i).alias("n"), F.lit(len(sel)).alias("terms"), F.col(f"r{i}").alias("right"), F.col(f"w{i}").alias("wrong")) for i, (sel, _) in enumerate(candidates)))
    return counts.select(F.explode(rows).alias("r")).select("r.*").withColumn("separates", F.col("wrong") == 0).orderBy(F.desc("separates"), "wrong", "terms", "n")


def vocabulary(schemas: dict) -> dict:
    """What a rule may say."""
    from ..functions.predicates import SELECT_OPS

    return {"targets": {t: {f.name: f.dataType.simpleString() for f in s} for t, s in schemas.items()}, "select": ["equals", *SELECT_OPS], "assert": list(ASSERT_OPS), "severities": list(SEVERITIES)}


def findings_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, FINDING)
