"""The queries over the standard tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import predicates, text
from .operators import evidence, knowledge, retrieval, rules
from .streaming import audit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# selectors and assertions: name -> (table, columns of the result, condition, SQL condition)
_CONTACT = "nullif(c_name, 'Customer#000000007')"
SELECTORS = {
    "sel_equals": ("customer", "c_custkey", {"c_mktsegment": "BUILDING"}, "c_mktsegment = 'BUILDING'"),
    "sel_in": ("orders", "o_orderkey", {"o_orderpriority_in": ["1-URGENT", "2-HIGH"]}, "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "sel_not_in": ("orders", "o_orderkey", {"o_orderpriority_not_in": ["1-URGENT", "2-HIGH"]}, "o_orderpriority IS NULL OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
    "sel_matches": ("part", "p_partkey", {"p_type_matches": "(?i)promo|^s"}, "regexp_matches(coalesce(p_type, ''), '(?i)promo|^s')"),
    "sel_not_matches": ("part", "p_partkey", {"p_type_not_matches": "(?i)promo|^s"}, "NOT regexp_matches(coalesce(p_type, ''), '(?i)promo|^s')"),
    "sel_matches_all": ("part", "p_partkey", {"p_name_matches_all": ["a", "r.*e"]}, "regexp_matches(coalesce(p_name, ''), 'a') AND regexp_matches(coalesce(p_name, ''), 'r.*e')"),
    "sel_present": ("events", "event_id", {"props_present": True, "event_type": "click"}, "length(coalesce(props, '')) > 0 AND event_type = 'click'"),
    "sel_absent": ("lineitem", "l_orderkey", {"l_tax_absent": True}, "coalesce(l_tax, 0) = 0"),
}
ASSERTIONS = {
    "assert_present": ("lineitem", "l_orderkey", {"field": "l_discount", "op": "present"}, "coalesce(l_discount, 0) <> 0"),
    "assert_absent": ("lineitem", "l_orderkey", {"field": "l_tax", "op": "absent"}, "coalesce(l_tax, 0) = 0"),
    "assert_equals": ("orders", "o_orderkey", {"field": "o_orderstatus", "op": "equals", "value": "F"}, "o_orderstatus IS NOT DISTINCT FROM 'F'"),
    "assert_not_equals": ("orders", "o_orderkey", {"field": "o_orderstatus", "op": "not_equals", "value": "F"}, "o_orderstatus IS DISTINCT FROM 'F'"),
    "assert_in": ("customer", "c_custkey", {"field": "c_mktsegment", "op": "in", "value": ["BUILDING", "MACHINERY"]}, "coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY'), false)"),
    "assert_not_in": ("customer", "c_custkey", {"field": "c_mktsegment", "op": "not_in", "value": ["BUILDING", "MACHINERY"]}, "NOT coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY'), false)"),
    "assert_matches": ("part", "p_partkey", {"field": "p_brand", "op": "matches", "value": "[1-3]$"}, "regexp_matches(coalesce(p_brand, ''), '[1-3]$')"),
    "assert_not_matches": ("part", "p_partkey", {"field": "p_brand", "op": "not_matches", "value": "[1-3]$"}, "NOT regexp_matches(coalesce(p_brand, ''), '[1-3]$')"),
    "assert_matches_all": ("events", "event_id", {"field": "props", "op": "matches_all", "value": ["k", "[13579]"]}, "regexp_matches(coalesce(props, ''), 'k') AND regexp_matches(coalesce(props, ''), '[13579]')"),
    "assert_matches_none": ("events", "event_id", {"field": "props", "op": "matches_none", "value": ["[5-9]", "z"]}, "NOT (regexp_matches(coalesce(props, ''), '[5-9]') OR regexp_matches(coalesce(props, ''), 'z'))"),
    "assert_gte": ("orders", "o_orderkey", {"field": "o_totalprice", "op": "gte", "value": 100000}, "o_totalprice >= 100000"),
    "assert_lte": ("lineitem", "l_orderkey", {"field": "l_discount", "op": "lte", "value": 0.05}, "l_discount <= 0.05"),
}


def _selector(table: str, key: str, select: dict):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = t(spark, sf_dir, table)
        return df.where(predicates.selection(select, df.schema)).select(key)

    return run


def _failing(table: str, key: str, test: dict):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = t(spark, sf_dir, table)
        return df.where(~predicates.assertion(test, df.schema)).select(key)

    return run


for _name, (_table, _key, _select, _sql) in SELECTORS.items():
    QUERIES[_name] = _selector(_table, _key, _select)
    ORACLE_SQL[_name] = f"SELECT {_key} FROM {_table} WHERE {_sql}"
for _name, (_table, _key, _test, _sql) in ASSERTIONS.items():
    QUERIES[_name] = _failing(_table, _key, _test)
    ORACLE_SQL[_name] = f"SELECT {_key} FROM {_table} WHERE NOT ({_sql})"

PACK = {
    "rulepack": "order-quality",
    "version": 1,
    "applies_to": ["table"],
    "rules": [
        {"id": "urgent-is-large", "severity": "high", "target": "orders", "title": "small urgent order", "detail": "order {o_orderkey} is {o_orderpriority}", "fix": "check the priority", "select": {"o_orderpriority": "1-URGENT"}, "assert": [{"field": "o_totalprice", "op": "gte", "value": 50000}]},
        {"id": "no-pending", "severity": "low", "target": "orders", "title": "pending order", "detail": "status {o_orderstatus}", "fix": "close it", "select": {"o_orderstatus": "P"}, "forbid": True},
        {"id": "status-is-known", "severity": "medium", "target": "orders", "title": "unknown status", "detail": "{o_orderstatus}", "fix": "use F, O or P", "assert": [{"field": "o_orderstatus", "op": "in", "value": ["F", "O", "P"]}]},
        {"id": "never-selected", "severity": "low", "target": "orders", "title": "x", "detail": "x", "fix": "x", "select": {"o_orderstatus": "none"}, "forbid": True},
    ],
}
_FINDINGS_SQL = """
    SELECT 'urgent-is-large' AS "check", 'high' AS severity, 'small urgent order' AS title, CAST(o_custkey AS VARCHAR) AS subject,
           'order ' || o_orderkey || ' is ' || o_orderpriority AS detail, 'check the priority' AS fix, 0 AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND NOT o_totalprice >= 50000
    UNION ALL SELECT 'no-pending', 'low', 'pending order', CAST(o_custkey AS VARCHAR), 'status ' || o_orderstatus, 'close it', 1 FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT 'status-is-known', 'medium', 'unknown status', CAST(o_custkey AS VARCHAR), o_orderstatus, 'use F, O or P', 2 FROM orders WHERE NOT coalesce(o_orderstatus IN ('F', 'O', 'P'), false)"""


@query("rule_findings", f'SELECT "check", severity, title, subject, detail, fix FROM ({_FINDINGS_SQL})')
def rule_findings(spark, sf_dir):
    return rules.findings(PACK["rules"], t(spark, sf_dir, "orders"), F.col("o_custkey"), dedup=False)


@query("rule_findings_dedup_sorted", f'SELECT "check", severity, title, subject, detail, fix FROM (SELECT *, row_number() OVER (PARTITION BY "check", subject ORDER BY n, title, detail, fix) AS k FROM ({_FINDINGS_SQL})) WHERE k = 1')
def rule_findings_dedup_sorted(spark, sf_dir):
    return rules.run_pack(PACK, {"orders": (t(spark, sf_dir, "orders"), F.col("o_custkey"))})[1]


_APPLIED_SQL = """
    SELECT 'urgent-is-large' AS rule, count(*) FILTER (o_orderpriority = '1-URGENT') AS matched, count(*) FILTER (o_orderpriority = '1-URGENT' AND NOT o_totalprice >= 50000) AS fired FROM orders
    UNION ALL SELECT 'no-pending', count(*) FILTER (o_orderstatus = 'P'), count(*) FILTER (o_orderstatus = 'P') FROM orders
    UNION ALL SELECT 'status-is-known', count(*), count(*) FILTER (NOT coalesce(o_orderstatus IN ('F', 'O', 'P'), false)) FROM orders
    UNION ALL SELECT 'never-selected', count(*) FILTER (o_orderstatus = 'none'), count(*) FILTER (o_orderstatus = 'none') FROM orders"""


@query("rule_pack_report", _APPLIED_SQL)
def rule_pack_report(spark, sf_dir):
    return rules.applied(PACK["rules"], t(spark, sf_dir, "orders"))


@query("rule_idle_rules", f"SELECT rule FROM ({_APPLIED_SQL}) WHERE matched = 0")
def rule_idle_rules(spark, sf_dir):
    return rule_pack_report(spark, sf_dir).where("matched = 0").select("rule")


@query("rule_outcome", f"SELECT CAST(CASE WHEN sum(matched) = 0 THEN 2 WHEN sum(fired) > 0 THEN 1 ELSE 0 END AS INTEGER) AS code FROM ({_APPLIED_SQL})")
def rule_outcome(spark, sf_dir):
    return rules.outcome(*rules.run_pack(PACK, {"orders": (t(spark, sf_dir, "orders"), F.col("o_custkey"))}))


@query("findings_summary", f"SELECT severity, count(*) AS n FROM ({_FINDINGS_SQL}) GROUP BY severity")
def findings_summary(spark, sf_dir):
    return rule_findings(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"))


@query("rule_forbid", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def rule_forbid(spark, sf_dir):
    return rules.findings([PACK["rules"][1]], t(spark, sf_dir, "orders"), F.col("o_orderkey"), dedup=False).select(F.col("subject").cast("long").alias("o_orderkey"))


@query("rule_render_text", "SELECT o_orderkey, 'order ' || o_orderkey || ' (' || o_orderstatus || ')' AS detail FROM orders")
def rule_render_text(spark, sf_dir):
    df = t(spark, sf_dir, "orders")
    return df.select("o_orderkey", predicates.render("order {o_orderkey} ({o_orderstatus})", df.schema).alias("detail"))


@query("rule_inference", "SELECT CAST(n AS INTEGER) AS n, wrong, wrong = 0 AS separates FROM (SELECT 0 AS n, count(*) FILTER ((o_totalprice < 100000) <> (o_totalprice < 100000)) AS wrong FROM orders UNION ALL SELECT 1, count(*) FILTER (NOT coalesce(o_orderstatus = 'F', false) <> (o_totalprice < 100000)) FROM orders)")
def rule_inference(spark, sf_dir):
    candidates = [({}, {"field": "o_totalprice", "op": "gte", "value": 100000}), ({}, {"field": "o_orderstatus", "op": "equals", "value": "F"})]
    return rules.infer(t(spark, sf_dir, "orders"), F.col("o_totalprice") < 100000, candidates).select("n", "wrong", "separates")


@query("key_uniqueness", """
    SELECT 'orders' AS key, count(*) AS rows, count(DISTINCT o_orderkey) AS distinct_rows, count(*) = count(DISTINCT o_orderkey) AS is_unique FROM orders
    UNION ALL SELECT 'orders_by_customer', count(*), count(DISTINCT o_custkey), count(*) = count(DISTINCT o_custkey) FROM orders""")
def key_uniqueness(spark, sf_dir):
    return evidence.key_uniqueness(t(spark, sf_dir, "orders"), {"orders": ["o_orderkey"], "orders_by_customer": ["o_custkey"]})


@query("fanout_evidence", """
    SELECT round((SELECT sum(o_totalprice) FROM orders), 2) AS sum_before, round(sum(o_totalprice * n), 2) AS sum_after, count(*) AS rows_before,
           CAST(sum(n) AS BIGINT) AS rows_after, count(*) FILTER (n > 1) AS multiplied_rows
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def fanout_evidence(spark, sf_dir):
    return evidence.fanout(t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", "o_totalprice")


@query("left_join_cancelled_evidence", """
    SELECT count(*) AS kept_by_join, count(*) FILTER (ok > 0) AS kept_by_test, count(*) FILTER (l_orderkey IS NULL) AS unmatched, count(*) - count(*) FILTER (ok > 0) AS lost
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_quantity > 0) AS ok FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def left_join_cancelled_evidence(spark, sf_dir):
    return evidence.left_join_cancelled(t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", F.col("l_quantity") > 0)


@query("not_in_null_trap", """
    WITH i AS (SELECT nullif(o_custkey, (SELECT min(o_custkey) FROM orders)) AS k FROM orders)
    SELECT (SELECT count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM i WHERE k = c_custkey)) AS not_exists_rows,
           (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT k FROM i)) AS not_in_rows, (SELECT count(*) FROM i WHERE k IS NULL) AS null_keys""")
def not_in_null_trap(spark, sf_dir):
    orders = t(spark, sf_dir, "orders")
    least = orders.agg(F.min("o_custkey")).first()[0]
    return evidence.not_in_trap(t(spark, sf_dir, "customer"), orders, "c_custkey", F.nullif(F.col("o_custkey"), F.lit(least)))


@query("null_join_loss", """
    WITH o AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey END AS k FROM orders)
    SELECT count(*) AS rows, count(*) FILTER (k IS NULL) AS null_keys, count(*) FILTER (k IS NOT NULL AND c_custkey IS NULL) AS no_partner, count(c_custkey) AS joined
    FROM o LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) ON k = c_custkey""")
def null_join_loss(spark, sf_dir):
    key = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey"))
    return evidence.null_join_loss(t(spark, sf_dir, "orders"), key, t(spark, sf_dir, "customer").where("c_custkey % 3 <> 0"), "c_custkey")


_PROFILE = ["c_custkey", "c_nationkey", "c_mktsegment"]


@query("column_profile", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, round(1 - count({c}) / count(*), 6) AS null_frac, count(DISTINCT {c}) AS n_distinct FROM customer""" for c in _PROFILE))
def column_profile(spark, sf_dir):
    return evidence.column_profile(t(spark, sf_dir, "customer"), _PROFILE)


_ALL = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@query("row_estimates", " UNION ALL ".join(f"""SELECT '{n}' AS "table", count(*) AS rows FROM {n}""" for n in _ALL))
def row_estimates(spark, sf_dir):
    return evidence.row_counts({n: t(spark, sf_dir, n) for n in _ALL})


@query("float_money_drift", "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS double_sum, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS exact_sum, abs(round(sum(o_totalprice), 2) - CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE)) > 0.005 AS drifts FROM orders GROUP BY 1")
def float_money_drift(spark, sf_dir):
    return evidence.float_drift(t(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice")


@query("reconcile_steps", """
    WITH s AS (SELECT 'orders' AS step, count(*) AS rows, count(*) AS b FROM orders
    UNION ALL SELECT 'finished', count(*) FILTER (o_orderstatus = 'F'), count(*) FROM orders
    UNION ALL SELECT 'large', count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 100000), count(*) FILTER (o_orderstatus = 'F') FROM orders)
    SELECT step, rows, b - rows AS lost FROM s""")
def reconcile_steps(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    f = o.where("o_orderstatus = 'F'")
    return evidence.reconcile({"orders": o, "finished": f, "large": f.where("o_totalprice > 100000")}, ["orders", "finished", "large"])


@query("near_duplicate_names", """
    WITH n AS (SELECT DISTINCT p_name AS name FROM part WHERE length(p_name) >= 6)
    SELECT a.name AS first, b.name AS second, CAST(levenshtein(a.name, b.name) AS INTEGER) AS distance FROM n a JOIN n b ON a.name < b.name AND levenshtein(a.name, b.name) <= 2""")
def near_duplicate_names(spark, sf_dir):
    from .operators.schema_checks import near_names

    return near_names(t(spark, sf_dir, "part").select(F.col("p_name").alias("name")), 2, 6)


@query("token_estimate", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[一-鿿]')) + floor(len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+')) * 1.3::DOUBLE) + 1 AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


_SENTENCES = "[x FOR x IN [trim(y) FOR y IN regexp_extract_all(line, '[^。！？；!?;]+[。！？；!?;]?')] IF x <> '']"


@query("sentence_split", f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, CAST(sum(len({_SENTENCES})) AS BIGINT) AS sentences FROM l GROUP BY doc_id")
def sentence_split(spark, sf_dir):
    lines = t(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.size(text.sentences(x)).cast("long")).alias("n"))
    return lines.select("doc_id", F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("sentences"))


_TOKENS = "regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+')"


@query("text_features", f"SELECT doc_id, token, count(*) AS weight FROM (SELECT doc_id, lower(unnest({_TOKENS})) AS token FROM documents) GROUP BY ALL")
def text_features(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.explode(text.word_features(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("weight"))


_IDF = f"SELECT token, count(*) AS df, round(ln(1 + (SELECT count(*) FROM documents) / count(*)), 3) AS idf FROM (SELECT DISTINCT doc_id, lower(unnest({_TOKENS})) AS token FROM documents) GROUP BY token"


@query("build_idf", _IDF)
def build_idf(spark, sf_dir):
    return knowledge.build_idf(t(spark, sf_dir, "documents"), "text")


@query("tfidf_top_terms", f"WITH i AS ({_IDF}), f AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, lower(unnest({_TOKENS})) AS token FROM documents) GROUP BY ALL), w AS (SELECT doc_id, token, round(tf * idf, 3) AS weight FROM f JOIN i USING (token)) SELECT doc_id, CAST(rank AS INTEGER) AS rank, token, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, token) AS rank FROM w) WHERE rank <= 3")
def tfidf_top_terms(spark, sf_dir):
    return knowledge.tfidf_top(t(spark, sf_dir, "documents"), "doc_id", "text", 3)


_CHUNK_SQL = """
    WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ln FROM documents),
    p AS (SELECT doc_id, ln, unnest(regexp_extract_all(line, '[^。！？；!?;]+[。！？；!?;]?')) AS s, generate_subscripts(regexp_extract_all(line, '[^。！？；!?;]+[。！？；!?;]?'), 1) AS sn FROM l),
    s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ln, sn) AS i, len(regexp_extract_all(s, '[一-鿿]')) AS c, len(regexp_extract_all(s, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+')) AS w FROM p WHERE trim(s) <> ''),
    r AS (SELECT doc_id, i, 0 AS chunk_no, c, w, 1 AS n FROM s WHERE i = 1
          UNION ALL
          SELECT s.doc_id, s.i, CASE WHEN full_ THEN chunk_no + 1 ELSE chunk_no END, CASE WHEN full_ THEN s.c ELSE r.c + s.c END, CASE WHEN full_ THEN s.w ELSE r.w + s.w END, CASE WHEN full_ THEN 1 ELSE n + 1 END
          FROM (SELECT *, c + floor(w * 1.3::DOUBLE) + 1 >= 512 AS full_ FROM r) r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1)
    SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(max(c) + floor(max(w) * 1.3::DOUBLE) + 1 AS BIGINT) AS tokens, CAST(max(n) AS BIGINT) AS sentences FROM r GROUP BY doc_id, chunk_no"""


@query("chunk_documents", _CHUNK_SQL)
def chunk_documents(spark, sf_dir):
    return knowledge.chunk_sentences(t(spark, sf_dir, "documents"), "doc_id", "text", 512)


@query("chunk_documents_overlap", None)
def chunk_documents_overlap(spark, sf_dir):
    return knowledge.chunk_documents(t(spark, sf_dir, "documents"), 512, 64, "doc_id", "text")


@query("hashed_embedding", None)
def hashed_embedding(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    return knowledge.embed_chunks(docs, knowledge.build_idf(docs, "text"), "doc_id", "text")


_V = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _first_vector(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    return e, e.orderBy("vec_id").first()["embedding"]


@query("vector_topk", f"{_V} SELECT vec_id, round(s, 4) AS score FROM (SELECT vec_id, list_dot_product(v, (SELECT v FROM e ORDER BY vec_id LIMIT 1)) AS s FROM e) ORDER BY s DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    e, q = _first_vector(spark, sf_dir)
    return retrieval.search(e, q, 10, floor=-1.0).select("vec_id", "score")


@query("vector_topk_floor", f"{_V} SELECT vec_id, round(s, 4) AS score FROM (SELECT vec_id, list_dot_product(v, (SELECT v FROM e ORDER BY vec_id LIMIT 1)) AS s FROM e ORDER BY s DESC, vec_id LIMIT 20) WHERE s >= 0.3")
def vector_topk_floor(spark, sf_dir):
    e, q = _first_vector(spark, sf_dir)
    return retrieval.search(e, q, 99, floor=0.3).select("vec_id", "score")


def _batch(spark, sf_dir, k, dim=64):
    e = t(spark, sf_dir, "embeddings")
    if dim < 64:
        e = e.withColumn("embedding", F.slice("embedding", 1, dim))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return e, retrieval.search_batch(e, q, k)


def _batch_sql(k, dim=64):
    return f"""(SELECT query_id, vec_id, label, s, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM (
        SELECT q.vec_id AS query_id, c.vec_id, c.label, list_dot_product(q.v[1:{dim}], c.v[1:{dim}]) AS s FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id) QUALIFY rank <= {k})"""


@query("vector_topk_batch", f"{_V} SELECT query_id, rank, vec_id, round(s, 4) AS score FROM {_batch_sql(5)}")
def vector_topk_batch(spark, sf_dir):
    return _batch(spark, sf_dir, 5)[1].select("query_id", "rank", "vec_id", F.round("score", 4).alias("score"))


def _evaluated(spark, sf_dir, k, dim=64):
    e, top = _batch(spark, sf_dir, k, dim)
    names = e.select("vec_id", F.col("label").cast("string").alias("source"))
    gold = names.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.evaluate(top.join(names, "vec_id"), gold)


def _evaluated_sql(k, dim=64):
    return f"""SELECT count(*) AS questions, count(hit) AS hits, round(count(hit) / count(*), 4) AS hit_rate, round(coalesce(sum(1 / hit), 0) / count(*), 4) AS mrr, round(avg(hit), 4) AS mean_rank,
        round(min(CASE WHEN hit IS NOT NULL THEN top1 END), 4) AS floor FROM (
        SELECT q.vec_id, min(CASE WHEN r.label = q.label THEN rank END) AS hit, max(CASE WHEN rank = 1 THEN s END) AS top1 FROM e q JOIN {_batch_sql(k, dim)} r ON r.query_id = q.vec_id GROUP BY q.vec_id)"""


@query("retrieval_eval_hit_mrr", f"{_V} {_evaluated_sql(5)}")
def retrieval_eval_hit_mrr(spark, sf_dir):
    return _evaluated(spark, sf_dir, 5)


_GRID = [(k, d) for k in (3, 5, 10) for d in (16, 32, 64)]


@query("tune_grid", f"{_V} " + " UNION ALL ".join(f"SELECT {k} AS k, {d} AS dim, hit_rate, mrr FROM ({_evaluated_sql(k, d)})" for k, d in _GRID))
def tune_grid(spark, sf_dir):
    from functools import reduce

    # one search a dimension serves every k
    rows = []
    for d in (16, 32, 64):
        e, top = _batch(spark, sf_dir, 10, d)
        names = e.select("vec_id", F.col("label").cast("string").alias("source"))
        gold = names.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
        found = top.join(names, "vec_id")
        rows += [retrieval.evaluate(found.where(F.col("rank") <= k), gold).select(F.lit(k).alias("k"), F.lit(d).alias("dim"), "hit_rate", "mrr") for k in (3, 5, 10)]
    return reduce(DataFrame.unionByName, rows)


@query("store_agreement", f"{_V}, a AS (SELECT query_id, min(CASE WHEN rank = 1 THEN vec_id END) AS f, list(vec_id) AS s FROM {_batch_sql(5)} GROUP BY 1), b AS (SELECT query_id, min(CASE WHEN rank = 1 THEN vec_id END) AS f, list(vec_id) AS s FROM {_batch_sql(5, 16)} GROUP BY 1) SELECT count(*) AS queries, round(avg(CAST(a.f = b.f AS INTEGER)), 4) AS same_top1, round(avg(len(list_intersect(a.s, b.s)) / len(a.s)), 4) AS mean_overlap FROM a JOIN b USING (query_id)")
def store_agreement(spark, sf_dir):
    return retrieval.agreement(_batch(spark, sf_dir, 5)[1], _batch(spark, sf_dir, 5, 16)[1])


@query("store_replace", "SELECT source, count(*) AS chunks, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT source, n_chars FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 0) UNION ALL SELECT source, -1 FROM documents WHERE doc_id % 97 = 0) GROUP BY source")
def store_replace(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    new = d.where("doc_id % 97 = 0").withColumn("n_chars", F.lit(-1).cast("long"))
    return knowledge.replace_sources(d, new).groupBy("source").agg(F.count("*").alias("chunks"), F.sum("n_chars").alias("chars"))


@query("store_orphans", "SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 0)")
def store_orphans(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "source")
    return knowledge.orphans(d, d.where("doc_id % 97 = 0"))


@query("store_stats", "SELECT count(DISTINCT source) AS documents, count(*) AS chunks, CAST(round_even(avg(n_chars), 0) AS BIGINT) AS avg_tokens FROM documents")
def store_stats(spark, sf_dir):
    return knowledge.store_stats(t(spark, sf_dir, "documents"), "source", "n_chars")


@query("latency_stats", """
    WITH r AS (SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k FROM events WHERE value IS NOT NULL)
    SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(CASE WHEN k = round_even(0.5 * (n - 1), 0) + 1 THEN value END) AS p50,
           max(CASE WHEN k = round_even(0.95::DOUBLE * (n - 1), 0) + 1 THEN value END) AS p95, min(value) AS min, max(value) AS max FROM r GROUP BY event_type""")
def latency_stats(spark, sf_dir):
    return retrieval.latency_stats(t(spark, sf_dir, "events"), "event_type", "value")


def _audit(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    layer = F.when(F.col("event_type") == "error", F.concat(F.lit("L"), (F.col("event_id") % 6 + 1).cast("string"))).otherwise("none")
    return e.select("ts", F.col("event_type").alias("tool"), F.col("props").alias("args"), F.when(F.col("event_type") == "error", "blocked").otherwise("ok").alias("decision"), layer.alias("layer"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("ms"))


_AUDIT_SQL = "(SELECT ts, CASE WHEN event_type = 'error' THEN 'blocked' ELSE 'ok' END AS decision, CASE WHEN event_type = 'error' THEN 'L' || (event_id % 6 + 1) ELSE 'none' END AS layer, event_type <> 'error' AS ok, value AS ms FROM events)"


@query("audit_decisions", f"SELECT decision, layer, count(*) AS n, count(*) FILTER (ok) AS ok_n, round(avg(ms), 4) AS mean_ms FROM {_AUDIT_SQL} GROUP BY ALL")
def audit_decisions(spark, sf_dir):
    return audit.decisions(_audit(spark, sf_dir))


@query("audit_tumbling", f"SELECT time_bucket(INTERVAL '1 day', ts) AS start, decision, layer, count(*) AS n FROM {_AUDIT_SQL} GROUP BY ALL")
def audit_tumbling(spark, sf_dir):
    return audit.windowed(_audit(spark, sf_dir), "1 day")


# ---- scripts, checks, the gate: literal inputs, golden rows
SHOP = """
CREATE TABLE shop.users (id BIGSERIAL PRIMARY KEY, email TEXT, phone TEXT NOT NULL, status SMALLINT NOT NULL DEFAULT 1, created_at TIMESTAMPTZ NOT NULL DEFAULT now());
COMMENT ON TABLE shop.users IS 'accounts'; COMMENT ON COLUMN shop.users.email IS 'null for guests'; COMMENT ON COLUMN shop.users.status IS '1 active';
CREATE TABLE shop.orders (id BIGSERIAL PRIMARY KEY, user_id BIGINT, status SMALLINT NOT NULL, amount DOUBLE PRECISION NOT NULL, currency CHAR(3) NOT NULL DEFAULT 'CNY', create_time TIMESTAMP NOT NULL DEFAULT now());
CREATE TABLE shop.orders_archive (id BIGSERIAL PRIMARY KEY, user_id BIGINT, status SMALLINT NOT NULL, amount DOUBLE PRECISION NOT NULL, currency CHAR(3) NOT NULL DEFAULT 'CNY', create_time TIMESTAMP NOT NULL DEFAULT now());
COMMENT ON TABLE shop.orders_archive IS 'closed orders';
CREATE TABLE shop.refunds (id BIGSERIAL PRIMARY KEY, order_id BIGINT NOT NULL, refund_amount NUMERIC(12,2) NOT NULL, reason TEXT, refunded_at TIMESTAMP NOT NULL DEFAULT now());
COMMENT ON TABLE shop.refunds IS 'refunds'; COMMENT ON COLUMN shop.refunds.reason IS 'free text';
CREATE TABLE shop.blacklist (user_id BIGINT, reason TEXT, added_at TIMESTAMPTZ NOT NULL DEFAULT now());
COMMENT ON TABLE shop.blacklist IS 'blocked users'; COMMENT ON COLUMN shop.blacklist.user_id IS 'user';
CREATE TABLE shop.user_profile (user_id BIGINT PRIMARY KEY, nickname TEXT, level SMALLINT NOT NULL DEFAULT 1);
COMMENT ON TABLE shop.user_profile IS 'profile';
CREATE TABLE shop.user_events (id BIGSERIAL PRIMARY KEY, user_id BIGINT, event_type TEXT NOT NULL, occurred_at TEXT NOT NULL, payload JSONB);
COMMENT ON TABLE shop.user_events IS 'events'; COMMENT ON COLUMN shop.user_events.occurred_at IS 'ISO text';
"""
#: The sample schema's findings by check and severity: 16 in all.
SHOP_SUMMARY = [("1", "high", 1), ("2", "medium", 4), ("3", "high", 3), ("3", "medium", 3), ("4", "high", 1), ("H", "low", 2), ("H", "medium", 2)]


def _shop(spark):
    from .sources.scripts import read_scripts

    scripts = spark.createDataFrame([("shop", SHOP)], "script_id string, sql string")
    return read_scripts(scripts, "table"), read_scripts(scripts, "column")


def _values(rows, names):
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS v({', '.join(names)})"


@query("schema_findings_summary", "SELECT \"check\", severity, CAST(n AS BIGINT) AS n FROM (" + _values(SHOP_SUMMARY, ['"check"', "severity", "n"]) + ")")
def schema_findings_summary(spark, sf_dir):
    from .operators.schema_checks import check_schema

    return check_schema(*_shop(spark)).groupBy("check", "severity").agg(F.count("*").alias("n"))


def _check_query(name, which, golden):
    @query(name, _values(golden, ["severity", "subject"]))
    def run(spark, sf_dir, which=which):
        from .operators import schema_checks

        tables, columns = _shop(spark)
        f = {"1": lambda: schema_checks.check_names(tables, columns), "2": lambda: schema_checks.check_join_keys(columns), "3": lambda: schema_checks.check_types(columns), "4": lambda: schema_checks.check_null_semantics(columns), "H": lambda: schema_checks.check_hygiene(tables, columns)}[which]()
        return f.select("severity", "subject")


_check_query("archive_pair_names", "1", [("high", "shop.orders  vs  shop.orders_archive")])
_check_query("check_join_keys", "2", [("medium", f"shop.{x}.user_id") for x in ("orders", "orders_archive", "blacklist", "user_events")])
_check_query("check_types", "3", [("high", "shop.orders.amount  (DOUBLE PRECISION)"), ("high", "shop.orders_archive.amount  (DOUBLE PRECISION)"), ("high", "shop.user_events.occurred_at  (TEXT)"), ("medium", "shop.orders.create_time  (TIMESTAMP)"), ("medium", "shop.orders_archive.create_time  (TIMESTAMP)"), ("medium", "shop.refunds.refunded_at  (TIMESTAMP)")])
_check_query("check_null_semantics", "4", [("high", "shop.blacklist.user_id")])
_check_query("check_hygiene", "H", [("medium", "shop.orders"), ("low", "shop.orders_archive"), ("low", "shop.user_profile"), ("medium", "created time: create_time, created_at")])


@query("duplicate_index", _values([("t", "b", "a"), ("t", "c", "a"), ("t", "a", "b")], ['"table"', '"index"', "duplicate_of"]))
def duplicate_index(spark, sf_dir):
    from .operators.schema_checks import duplicate_indexes
    from .sources.scripts import read_scripts

    sql = "CREATE TABLE t (x INT, y INT); CREATE INDEX a ON t (x, y); CREATE INDEX b ON t (x, y); CREATE INDEX d ON t (y, x); CREATE INDEX e ON t (lower(x), y)"
    full = duplicate_indexes(read_scripts(spark.createDataFrame([("s", sql)], "script_id string, sql string"), "index"))
    partial = "CREATE TABLE t (x INT); CREATE INDEX a ON t (x); CREATE INDEX c ON t (x) WHERE x > 1"
    return full.unionByName(duplicate_indexes(read_scripts(spark.createDataFrame([("s", partial)], "script_id string, sql string"), "index")))


STATEMENTS = [
    ("", False, "L1"), ("-- nothing", False, "L1"), ("SELECT 1; DROP TABLE shop.users", False, "L1"), ("SELECT 1;", True, None),
    ("DROP TABLE shop.orders", False, "L2"), ("UPDATE shop.orders SET amount = 0", False, "L2"), ("SELECT * FROM shop.orders FOR UPDATE", False, "L2"), ("SELECT * FROM shop.orders FOR NO KEY UPDATE", False, "L2"), ("SELECT * FROM shop.orders FOR KEY SHARE", False, "L2"),
    ("WITH recent AS (SELECT 1 AS x) SELECT * FROM recent", True, None), ("TABLE shop.orders", True, None), ("VALUES (1), (2)", True, None), ("EXPLAIN SELECT * FROM shop.orders", True, None),
    ("WITH x AS (UPDATE shop.orders SET amount = 0 RETURNING id) SELECT * FROM x", False, "L3"), ("SELECT * FROM shop.orders INTO archived_orders", False, "L3"), ("SELECT 1 /* TRUNCATE TABLE shop.orders */", True, None), ("SELECT 'DELETE FROM shop.orders' AS example", True, None),
    ("SELECT pg_sleep(10)", False, "L4"), ("SELECT nextval('shop.orders_id_seq')", False, "L4"), ("SELECT current_setting('search_path')", False, "L4"), ("SELECT pg_size_pretty(1024)", True, None),
    ("SELECT * FROM shop.users", False, "L5"), ("SELECT o.id FROM shop.orders o JOIN shop.users u ON u.id = o.customer_id", False, "L5"), ("SELECT * FROM shop.orders o, shop.users u", False, "L5"), ('SELECT * FROM "shop"."users"', False, "L5"), ("SELECT extract(year FROM created_at) FROM shop.orders", True, None),
    ("SELECT * FROM (shop.users CROSS JOIN shop.orders)", False, "L5"), ("SELECT * FROM (shop.users)", False, "L5"), ("SELECT * FROM ((shop.orders o), shop.users u)", False, "L5"), ("WITH users AS (SELECT * FROM users) SELECT * FROM users", False, "L5"),
    ("WITH a AS (SELECT * FROM shop.orders), b(x) AS (SELECT id FROM a) SELECT * FROM b, (a)", True, None), ("WITH RECURSIVE n AS (SELECT 1 AS x UNION ALL SELECT x + 1 FROM n WHERE x < 5) SELECT * FROM n", True, None), ("SELECT * FROM (WITH users AS (SELECT 1 AS x) SELECT * FROM users) q JOIN users ON true", False, "L5"),
    ("SELECT * FROM shop.orders WHERE id IN (SELECT user_id FROM shop.users)", False, "L5"), ("SELECT * FROM shop.orders UNION ALL TABLE shop.users", False, "L5"), ("SELECT * FROM generate_series(1, 5) g, shop.orders", True, None), ("SELECT trim(BOTH ' ' FROM note) FROM shop.orders", True, None), ("(SELECT * FROM shop.orders) UNION (SELECT * FROM shop.users)", False, "L5"),
    ("GRANT SELECT ON shop.orders TO public", False, "L2"), ("COPY shop.orders TO '/tmp/x'", False, "L2"), ("SELECT lo_import('/etc/passwd')", False, "L4"), ("SELECT $$DROP TABLE x$$ AS t", True, None), ("EXPLAIN DELETE FROM shop.orders", False, "L3"), ("SELECT * FROM dblink('x', 'y') AS t(a int)", False, "L4"),
]


@query("guard_verdicts", _values([(i, ok, layer) for i, (_, ok, layer) in enumerate(STATEMENTS)], ["n", "ok", "layer"]))
def guard_verdicts(spark, sf_dir):
    from .plans.gate import guard_column

    s = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(STATEMENTS)], "n int, sql string")
    return s.select("n", guard_column(F.col("sql"), allowed=["shop.orders"]).alias("v")).select("n", "v.ok", "v.layer")


LIMITS = [("SELECT * FROM shop.orders", "SELECT * FROM shop.orders\nLIMIT 100", True), ("SELECT * FROM shop.orders LIMIT 5", "SELECT * FROM shop.orders LIMIT 5", False), ("SELECT 'limit 3' AS marker FROM shop.orders", "SELECT 'limit 3' AS marker FROM shop.orders\nLIMIT 100", True), ("select * from shop.orders limit 7;", "select * from shop.orders limit 7", False), ("SELECT * FROM shop.orders LIMIT 5000", "SELECT * FROM shop.orders LIMIT 100", True), ("SELECT * FROM shop.orders LIMIT ALL", "SELECT * FROM shop.orders LIMIT 100", True), ("SELECT * FROM (SELECT 1 LIMIT 3) x", "SELECT * FROM (SELECT 1 LIMIT 3) x\nLIMIT 100", True), ("SELECT * FROM shop.orders FETCH FIRST 9 ROWS ONLY", "SELECT * FROM shop.orders FETCH FIRST 9 ROWS ONLY", False), ("SELECT * FROM shop.orders LIMIT 1+100000", "SELECT * FROM shop.orders LIMIT 100", True), ("SELECT * FROM shop.orders LIMIT (SELECT 7) OFFSET 3", "SELECT * FROM shop.orders LIMIT 100 OFFSET 3", True), ("SELECT * FROM shop.orders LIMIT 1e9", "SELECT * FROM shop.orders LIMIT 100", True), ("SELECT * FROM shop.orders FETCH FIRST ROW ONLY", "SELECT * FROM shop.orders FETCH FIRST ROW ONLY", False), ("SELECT * FROM shop.orders FETCH NEXT 900 ROWS ONLY", "SELECT * FROM shop.orders FETCH NEXT 100 ROWS ONLY", True)]


@query("guard_limit_rewrite", _values([(i, b, r) for i, (_, b, r) in enumerate(LIMITS)], ["n", "sql", "rewritten"]))
def guard_limit_rewrite(spark, sf_dir):
    from .plans.gate import guard_column

    s = spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(LIMITS)], "n int, q string")
    return s.select("n", guard_column(F.col("q")).alias("v")).select("n", "v.sql", "v.rewritten")


CHAIN = """
CREATE TABLE shop.orders (id BIGSERIAL PRIMARY KEY, user_id BIGINT, status SMALLINT NOT NULL, paid_amount NUMERIC(12,2) NOT NULL, paid_at TIMESTAMPTZ, created_at TIMESTAMPTZ);
CREATE TABLE shop.order_items (id BIGSERIAL PRIMARY KEY, order_id BIGINT NOT NULL, sku TEXT NOT NULL, qty INT NOT NULL, line_amount NUMERIC(12,2) NOT NULL);
CREATE TABLE shop.refunds (id BIGSERIAL PRIMARY KEY, order_id BIGINT NOT NULL, refund_amount NUMERIC(12,2) NOT NULL, status TEXT NOT NULL);
CREATE TABLE shop.order_audit (order_id BIGINT PRIMARY KEY, note TEXT);
"""
REVIEWS = [
    ("SELECT SUM(o.paid_amount) FROM shop.orders o JOIN shop.order_items i ON i.order_id = o.id", "S1"),
    ("SELECT SUM(i.line_amount) FROM shop.orders o JOIN shop.order_items i ON i.order_id = o.id", None),
    ("SELECT SUM(o.paid_amount) FROM shop.orders o JOIN shop.order_audit a ON a.order_id = o.id", None),
    ("SELECT i.order_id, SUM(o.paid_amount) FROM shop.orders o JOIN shop.order_items i ON i.order_id = o.id GROUP BY i.order_id", None),
    ("SELECT o.id FROM shop.orders o LEFT JOIN shop.refunds r ON r.order_id = o.id WHERE r.status = 'done'", "S3"),
    ("SELECT o.id FROM shop.orders o LEFT JOIN shop.refunds r ON r.order_id = o.id WHERE r.id IS NULL", None),
    ("SELECT SUM(o.paid_amount) FROM shop.order_items i JOIN shop.orders o ON o.id = i.order_id", "S1"),
    ("SELECT SUM(DISTINCT o.paid_amount) FROM shop.orders o JOIN shop.order_items i ON i.order_id = o.id", None),
]


@query("statement_findings", _values([(i, c) for i, (_, c) in enumerate(REVIEWS)], ["n", "code"]))
def statement_findings(spark, sf_dir):
    from .plans.statement_checks import check_statement
    from .sources.scripts import read_script

    schema = read_script(CHAIN)

    @F.pandas_udf("string")
    def codes(sql: pd.Series) -> pd.Series:
        return pd.Series([",".join(f[0] for f in check_statement(q, schema).findings) or None for q in sql], dtype=object)

    s = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(REVIEWS)], "n int, sql string")
    return s.select("n", codes("sql").alias("code"))


QUESTIONS = [("Delete all old orders", "refuse"), ("How do I delete duplicate rows?", "docs"), ("How many orders were paid yesterday?", "query"), ("Which tables have the most dead tuples?", "stats"), ("Explain this slow query", "plan"), ("What causes replication lag?", "docs"), ("help", "clarify"), ("", "clarify"), ("please drop table users", "refuse"), ("show the total order amount", "query"), ("帮我删掉 orders 表 2024 年之前的数据", "refuse"), ("帮我删掉 orders 表的数据，可以吗？", "refuse"), ("drop table orders", "refuse"), ("清空 t 表", "refuse"), ("delete from shop.orders where id = 1", "refuse"), ("把参数从配置文件里删掉和设成 0，效果一样吗？", "docs"), ("怎么安全地删除大表的历史分区？", "docs"), ("truncate 大表会锁多久？", "docs"), ("授权给只读账号要注意什么？", "docs"), ("怎么建表更合理？", "docs"), ("orders 表膨胀了", "stats"), ("这条语句很慢", "plan"), ("列出昨天的订单", "query"), ("随便", "clarify")]


@query("route_decisions", _values([(i, r) for i, (_, r) in enumerate(QUESTIONS)], ["n", "tool"]))
def route_decisions(spark, sf_dir):
    from .plans.router import route

    return spark.createDataFrame([(i, q) for i, (q, _) in enumerate(QUESTIONS)], "n int, q string").select("n", route(F.col("q")).alias("tool"))


@query("plan_scores", _values([("shop.orders", 6), ("shop.orders_archive", 8), ("shop.refunds", 4)], ['"table"', "score"]))
def plan_scores(spark, sf_dir):
    from .plans.router import plan_scores as score

    asked = spark.createDataFrame([("total order amount",)], "question string")
    return score(asked, *_shop(spark)).select("table", F.col("score").cast("int").alias("score"))


CHANGES = """
CREATE TABLE shop.coupons (code TEXT, owner_id BIGINT, note TEXT, kind TEXT);
COMMENT ON TABLE shop.coupons IS 'coupons'; COMMENT ON COLUMN shop.coupons.code IS 'code, standard: DS-7';
ALTER TABLE shop.orders ADD COLUMN channel TEXT NOT NULL;
ALTER TABLE shop.orders DROP COLUMN legacy;
DROP TABLE shop.old;
DELETE FROM shop.carts WHERE id < 5;
"""


@query("review_change_script", _values([("table-must-have-primary-key", 1, 1), ("table-must-have-comment", 1, 0), ("table-comment-states-role", 1, 1), ("column-must-have-comment", 5, 4), ("column-comment-cites-standard", 1, 0), ("no-drop-table", 1, 1), ("no-drop-column", 1, 1), ("update-or-delete-needs-a-where", 0, 0), ("no-truncate", 0, 0), ("new-not-null-column-needs-a-default", 1, 1)], ["rule", "matched", "fired"]))
def review_change_script(spark, sf_dir):
    from .operators.review import review_scripts
    from .packs import default_packs

    scripts = spark.createDataFrame([("change", CHANGES)], "script_id string, sql string")
    applied, _ = review_scripts(scripts, default_packs("ddl"))
    return applied.select("rule", F.col("matched").cast("int").alias("matched"), F.col("fired").cast("int").alias("fired"))


@query("pack_examples", "SELECT pack, CAST(wrong AS BIGINT) AS wrong FROM (VALUES ('table-hygiene', 0), ('change-review', 0), ('index-hygiene', 0)) AS v(pack, wrong)")
def pack_examples(spark, sf_dir):
    from .operators.review import verify_pack
    from .packs import PACKS

    return spark.createDataFrame([(n, len(verify_pack(spark, p))) for n, p in PACKS.items()], "pack string, wrong long")


@query("search_docs_report", f"{_V}, r AS (SELECT round(list_dot_product(v, (SELECT v FROM e ORDER BY vec_id LIMIT 1)), 4) AS s FROM e ORDER BY list_dot_product(v, (SELECT v FROM e ORDER BY vec_id LIMIT 1)) DESC, vec_id LIMIT 20) SELECT f AS floor, CAST(count(*) FILTER (s >= f) AS BIGINT) AS hits, CAST(count(*) FILTER (s < f) AS BIGINT) AS dropped, max(s) AS top_score, count(*) FILTER (s >= f) = 0 AS noted FROM r, (VALUES (0.3::DOUBLE), (0.9::DOUBLE), (2.0::DOUBLE)) AS v(f) GROUP BY f")
def search_docs_report(spark, sf_dir):
    e, q = _first_vector(spark, sf_dir)
    rows = []
    for floor in (0.3, 0.9, 2.0):
        hits, report = retrieval.search_docs(e, q, 99, floor)
        rows.append((floor, hits.count(), report["dropped_below_floor"], report["top_score"], report["note"] is not None))
    return spark.createDataFrame(rows, "floor double, hits long, dropped long, top_score double, noted boolean")


CALLS = [("run_sql", {"sql": "SELECT n_name FROM reviewed_nation ORDER BY n_name"}, "ok", "none"), ("run_sql", {"sql": "DROP TABLE reviewed_nation"}, "blocked", "L2"), ("run_sql", {"sql": "SELECT * FROM other_nation"}, "blocked", "L5"), ("explain_sql", {"sql": "SELECT * FROM reviewed_nation"}, "ok", "none"), ("explain_sql", {"sql": "DELETE FROM reviewed_nation"}, "blocked", "L3"), ("run_sql", {"sql": "SELECT no_such_column FROM reviewed_nation"}, "tool-error", "none"), ("run_sql", {}, "bad-arguments", "none"), ("drop_all", {}, "unknown-tool", "none"), ("get_table_stats", {}, "ok", "none"), ("search_docs", {"query": "x"}, "ok", "none")]


@query("toolbox_decisions", _values([(i, tool, d, layer) for i, (tool, _, d, layer) in enumerate(CALLS)], ["n", "tool", "decision", "layer"]))
def toolbox_decisions(spark, sf_dir):
    from .operators.toolbox import Toolbox

    nation = t(spark, sf_dir, "nation")
    nation.createOrReplaceTempView("reviewed_nation")
    box = Toolbox(spark, tables={"nation": nation}, allowed=["reviewed_nation"], max_rows=5)
    for tool, args, _, _ in CALLS:
        box.call(tool, args)
    return spark.createDataFrame([(i, e["tool"], e["decision"], e["layer"]) for i, e in enumerate(box.entries)], "n int, tool string, decision string, layer string")
