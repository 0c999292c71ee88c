"""Questions to tools, and questions to tables, as Columns over a batch of questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: Chinese and English words of the router, found anywhere in a question
WRITES = ("删掉", "删除", "清空", "清除", "改一下", "改掉", "drop", "delete", "truncate", "update ", "insert", "写入", "导入数据", "建表", "授权")
ORDERS = ("帮我", "给我", "请帮", "麻烦帮", "麻烦你", "来删", "来改", "来建", "执行一下", "跑一下", "直接执行", "直接跑", "帮我做", "你来")
ASKS = ("?", "？", "吗", "呢", "怎么", "如何", "为什么", "是否", "能不能", "可不可以", "要不要", "需要注意", "注意什么", "区别", "一样", "哪个", "哪里", "是什么", "什么意思")
VAGUE = ("我不确定", "不知道查什么", "不知道", "随便", "帮我看看", "看看有什么问题", "你看着办", "有啥问题")
DOCS = ("怎么", "如何", "为什么", "原理", "是什么", "处理", "方案", "经验", "区别", "注意", "风险", "坑", "治理", "优化", "建议", "流程", "how ", "why ", "what is", "best practice")
PLAN = ("慢", "执行计划", "explain", "耗时", "性能", "卡", "超时", "plan")
STATS = ("膨胀", "表大小", "多大", "多少行", "死元组", "死行", "统计信息", "索引情况", "占多少", "空间", "vacuum", "bloat")
DATA = ("多少", "几条", "列出", "查一下", "查出", "合计", "总额", "统计一下", "top", "最多", "最少", "count", "sum", "平均", "明细")
# English forms beyond them
_WRITE = r"(?i)\b(delete|drop|truncate|update|insert|alter|grant|remove|wipe|purge)\b"
_ASKING = r"(?i)^\s*(how|what|why|when|which|where|who|does|do|is|are|can|should|explain)\b"
_STATS = r"(?i)\b(dead tuples?|table size|largest tables?)\b"
_PLAN = r"(?i)\b(query plan|execution plan|slow query)\b"
_DATA = r"(?i)\b(how many|total|average|list|show)\b"
_VAGUE = r"(?i)^[^\p{L}\p{N}]*(help|hi|hello|it is slow|something is wrong)?[^\p{L}\p{N}]*$"
_STOP = ("the", "a", "an", "of", "in", "on", "for", "to", "is", "are", "what", "which", "how", "many", "and", "by", "me", "show", "list")


def route(question: Column) -> Column:
    """refuse, clarify, stats, plan, query or docs; the first that fits.

    A word of writing is an order, and refused, unless the question is put as one and gives
    no order; then it is about practice."""
    q = F.lower(F.coalesce(question, F.lit("")))
    holds = lambda words: reduce(lambda a, b: a | b, (F.contains(q, F.lit(w)) for w in words))
    write = holds(WRITES) | q.rlike(_WRITE)
    asking = holds(ASKS) | q.rlike(_ASKING)
    return (
        F.when(write & (holds(ORDERS) | ~asking), "refuse")
        .when(write, "docs")
        .when(holds(VAGUE) | q.rlike(_VAGUE), "clarify")
        .when(holds(STATS) | q.rlike(_STATS), "stats")
        .when(holds(PLAN) | q.rlike(_PLAN), "plan")
        .when(holds(DATA) | q.rlike(_DATA), "query")
        .otherwise("docs")
    )


def plan_scores(questions: DataFrame, tables: DataFrame, columns: DataFrame, question: str = "question") -> DataFrame:
    """question, table, score: 4 for a table's name, 2 for its comment or a column's name, 1
    for a column's comment, for each word of a question. Words meet name parts by equality
    (plural s dropped), so questions and tables are joined by words, not each with each."""
    stem = lambda w: F.regexp_replace(F.lower(w), "(?<=...)s$", "")
    parts = lambda c: F.array_distinct(F.transform(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) > 1) & ~w.isin(*_STOP)), stem))
    asked = questions.select(question, F.explode(parts(F.col(question))).alias("w"))
    words = tables.select(F.col("qualified").alias("table"), F.explode(parts(F.col("name"))).alias("w"), F.lit(4).alias("s"))
    words = words.unionByName(tables.select(F.col("qualified").alias("table"), F.explode(parts(F.col("comment"))).alias("w"), F.lit(2).alias("s")))
    words = words.unionByName(columns.select("table", F.explode(parts(F.col("name"))).alias("w"), F.lit(2).alias("s")).distinct())
    words = words.unionByName(columns.select("table", F.explode(parts(F.col("comment"))).alias("w"), F.lit(1).alias("s")).distinct())
    return asked.join(words, "w").groupBy(question, "table").agg(F.sum("s").alias("score"))
