import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lakewarden.functions import predicates
from lakewarden.operators import knowledge, retrieval, rules, schema_checks, toolbox
from lakewarden.streaming import audit


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "abc", ["x"], True, 5.0), (2, None, None, None, None), (3, "", [], False, 0.0), (4, "Überß9", ["a", "b"], True, float("nan"))], "id long, s string, l array<string>, b boolean, n double")


@pytest.mark.parametrize("select,ids", [({"s": None}, [2]), ({"s_present": True}, [1, 4]), ({"l_absent": True}, [2, 3]), ({"b_absent": True}, [2, 3]), ({"n_present": False}, [2, 3]), ({"s_in": ["abc", None]}, [1, 2]), ({"s_not_in": ["abc"]}, [2, 3, 4]), ({"s_matches": r"^\w+$"}, [1, 4]), ({"s_not_matches": "a"}, [2, 3, 4]), ({"s_matches_all": []}, [1, 2, 3, 4]), ({"s_matches_all": ["a", "c"]}, [1]), ({}, [1, 2, 3, 4])])
def test_selects_are_two_valued(rows, select, ids):
    c = predicates.selection(select, rows.schema)
    assert sorted(r.id for r in rows.where(c).collect()) == ids
    assert sorted(r.id for r in rows.where(~c).collect()) == [i for i in range(1, 5) if i not in ids]


@pytest.mark.parametrize("op,value,ids", [("equals", "abc", [1]), ("not_equals", "abc", [2, 3, 4]), ("in", None, []), ("matches_all", [], []), ("matches_none", [], [1, 2, 3, 4]), ("matches_none", ["b"], [2, 3]), ("absent", None, [2, 3])])
def test_assertions_are_two_valued(rows, op, value, ids):
    c = predicates.assertion({"field": "s", "op": op, "value": value}, rows.schema)
    assert sorted(r.id for r in rows.where(c).collect()) == ids


def test_numbers(rows):
    c = predicates.assertion({"field": "n", "op": "gte", "value": 1}, rows.schema)
    assert [r.id for r in rows.where("n is not null").where(c).collect()] == [1]
    with pytest.raises(Exception, match="not a number"):
        rows.where(c).collect()


def test_pack_validation_overlaps_and_render(rows):
    schemas = {"t": rows.schema}
    rule = {"id": "r-one", "severity": "low", "target": "t", "title": "x", "detail": "{s} {l} {b}", "fix": "x", "assert": [{"field": "s", "op": "present"}]}
    assert rules.validate_pack({"rulepack": "p", "version": 1, "rules": [rule]}, schemas) == []
    bad = [rule | {"id": "Bad Id"}, rule, rule | {"severity": "x"}, rule | {"id": "b", "target": "none"}, rule | {"id": "c", "detail": "{none}"}, rule | {"id": "d", "select": {"zz": 1}}, rule | {"id": "e", "forbid": True}, rule | {"id": "f", "select": {"s_matches": "("}}]
    wrong = rules.validate_pack({"rulepack": "p", "version": 2, "rules": bad}, schemas)
    assert len(wrong) == 9
    pairs = [rule, rule | {"id": "r-two"}, rule | {"id": "r-three", "select": {"b": True}}, rule | {"id": "r-four", "assert": [{"field": "s", "op": "absent"}]}]
    kinds = {(o["first"], o["second"]): o["kind"] for o in rules.overlaps(pairs)}
    assert kinds[("r-one", "r-two")] == "exact" and kinds[("r-one", "r-three")] == "redundant" and kinds[("r-one", "r-four")] == "conflicting"
    assert [r.x for r in rows.orderBy("id").select(predicates.render("{s}|{l}|{b}|{q}", rows.schema).alias("x")).collect()] == ["abc|x|True|{q}", "|||{q}", "||False|{q}", "Überß9|a, b|True|{q}"]


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@pytest.mark.parametrize("distance", [1, 2])
def test_near_names_equal_brute_force(spark, distance):
    r = random.Random(distance)
    names = list({"".join(r.choice("ab") for _ in range(r.randint(4, 9))) for _ in range(120)})
    got = {(x.first, x.second, x.distance) for x in schema_checks.near_names(spark.createDataFrame([(n,) for n in names], "name string"), distance, 6).collect()}
    assert got == {(min(a, b), max(a, b), lev(a, b)) for a in names for b in names if a != b and min(len(a), len(b)) >= 6 and lev(a, b) <= distance}


def test_chunker():
    out = knowledge.chunk_text("lost\n# A\none two three. four;\n## B\n" + "five six seven eight nine ten;" * 80 + "\n# C\nend", 128, 20)
    assert out[0][0] == "A" and out[0][1].startswith("A。 one two three. four;")
    assert all(n == knowledge.estimate_tokens(c) for _, c, n in out) and "lost" not in "".join(c for _, c, _ in out)
    assert knowledge.chunk_text("", 128, 0) == [] and knowledge.chunk_text("no heading", 128, 0)[0][0] == "(untitled)"


GOLDEN = [
    # text, target, overlap, (section, content)
    ("# A\none; two\n## B\nthree", 512, 0, [("A", "A。 one; two B。 three")]),
    ("preface; words\n# A\nbody", 512, 64, [("A", "A。 body")]),
    (" ".join(["lead"] * 70) + "\n# A\nx", 90, 0, [("(untitled)", " ".join(["lead"] * 70)), ("A", "A。 x")]),
    ("# A\n" + "alpha beta gamma. " * 40 + "\n# C #\ntail", 120, 0, [("A", "A。 " + ("alpha beta gamma. " * 40).strip()), ("C", "C。 tail")]),
    ("# A\na b c; d e f; g h i;", 8, 6, [("A", "A。 a b c; d e f;"), ("A", "A。 a b c; g h i;"), ("A", "A。 a b c;")]),
    ("# 表\n甲乙丙。丁戊己！", 512, 0, [("表", "表。 甲乙丙。 丁戊己！")]),
]


@pytest.mark.parametrize("text,target,overlap,want", GOLDEN)
def test_chunker_golden(text, target, overlap, want):
    assert [(s, c) for s, c, _ in knowledge.chunk_text(text, target, overlap)][: len(want)] == want


def test_latency_ranks_equal_sorting(spark):
    r = random.Random(3)
    rows = [("a", r.random()) for _ in range(3000)] + [("b", 5.0)] * 2000 + [("b", 1.0)] * 1999 + [("c", 2.5), (None, 1.5), (None, 3.5), ("a", None)]
    got = {x.g: x for x in retrieval.latency_stats(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    for g in ("a", "b", "c", None):
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert (got[g].n, got[g].min, got[g].max) == (len(v), v[0], v[-1])
        assert (got[g].p50, got[g].p95) == (v[round(0.5 * (len(v) - 1))], v[round(0.95 * (len(v) - 1))])


def test_ingest_and_toolbox(spark, tmp_path):
    notes = [("bloat", "# Bloat\ndead tuples make a table large; vacuum frees them"), ("locks", "# Locks\na long transaction holds row locks"), ("none", None)]
    docs = spark.createDataFrame(notes, "source string, text string")
    store, embedder = knowledge.ChunkStore(spark, str(tmp_path)), knowledge.Embedder(64)
    chunks = knowledge.ingest(docs, store, "v1", embedder)
    assert sorted(r.source for r in chunks.collect()) == ["bloat", "locks"] and "corpus idf" in embedder.label
    box = toolbox.Toolbox(spark, chunks, embedder)
    hits = box.call("search_docs", {"query": "vacuum dead tuples", "k": 0})
    assert hits.ok and [h["source"] for h in hits.data["hits"]] == ["bloat"] and hits.brief() == "1 passages"
    box.floor = 2.0
    assert box.call("search_docs", {"query": "vacuum"}).data["note"] and box.answer("drop table x")["refused"]
    assert box.answer("How are locks held?")["steps"][0].tool == "search_docs"
    with pytest.raises(ValueError, match="64 numbers"):
        toolbox.Toolbox(spark, chunks, knowledge.Embedder(32))
    box.register("twice", lambda n: {"rows": [n, n]})
    assert box.call("twice", {"n": 1}).brief() == "2 rows" and box.audit_rows().count() == len(box.entries)
    assert box.call("run_sql", {"sql": "SELECT repeat('x', 900) AS x"}).data["rows"][0][0].endswith("…")
    assert [toolbox.human_bytes(x) for x in (5, 2048, 3 << 40)] == ["5 B", "2.0 KB", "3.0 TB"]


def test_columns_equal_plain_chunker(spark):
    text = "alpha beta; gamma? delta!\n\nepsilon " * 30
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.tokens, r.sentences) for r in knowledge.chunk_sentences(df, "doc_id", "text", 40).orderBy("chunk_no").collect()]
    plain = [(n, c) for _, c, n in knowledge.chunk_text(text, 40, 0)]
    assert [t for t, _ in got] == [n for n, _ in plain] and sum(n for _, n in got) == 91


def test_embedding_equals_hashlib(spark):
    df = spark.createDataFrame([("a", "one two two 数据库"), ("b", "three")], "chunk_id string, content string")
    idf = knowledge.build_idf(df)
    weights = {r.token: r.idf for r in idf.collect()}
    got = {r.chunk_id: r.vector for r in knowledge.embed_chunks(df, idf, dim=32).collect()}
    for k, text in (("a", "one two two 数据库"), ("b", "three")):
        assert got[k] == pytest.approx(knowledge.embed(text, weights, 32))
    assert knowledge.token_hash("x") == int.from_bytes(hashlib.blake2b(b"x", digest_size=8).digest(), "big")


@pytest.mark.parametrize("held", [0, 3, 1000])
def test_embedding_by_held_and_joined_tokens(spark, held):
    texts = {1: "One two two 数据库 one_2", 2: "two 数 42 two", 3: "Ünï 3x three 据库据库", None: "two four", 7: "one"}
    df = spark.createDataFrame([*texts.items(), (4, None), (5, "!"), (7, "four one")], "doc_id long, text string")
    idf = knowledge.build_idf(df, "text")
    weights = {r.token: r.idf for r in idf.collect()}
    rows = knowledge.embed_chunks(df, idf, "doc_id", "text", 16, held).collect()
    assert sorted(map(str, (r.doc_id for r in rows))) == ["1", "2", "3", "7", "None"]
    for r in rows:
        text = texts[r.doc_id] + (" four one" if r.doc_id == 7 else "")
        assert r.vector == pytest.approx(knowledge.embed(text, weights, 16))
    plain = knowledge.embed_chunks(df, None, "doc_id", "text", 16, held).where("doc_id in (3, 7)").collect()
    for r in plain:
        assert r.vector == pytest.approx(knowledge.embed("one four one" if r.doc_id == 7 else texts[3], None, 16))


@pytest.mark.parametrize("held", [0, 1000])
def test_tokens_that_cancel_give_zeros(spark, held):
    a, b = next((f"a{i}", f"b{j}") for i in range(99) for j in range(99) if (x := knowledge.token_hash(f"a{i}")) % 4 == (y := knowledge.token_hash(f"b{j}")) % 4 and (x // 4 + y // 4) % 2)
    df = spark.createDataFrame([("x", f"{a} {b}")], "chunk_id string, content string")
    assert [r.vector for r in knowledge.embed_chunks(df, knowledge.build_idf(df), dim=4, held=held).collect()] == [[0.0] * 4]


def test_vectors_are_not_looked_up_place_by_place(spark):
    df = spark.createDataFrame([("a", "one two")], "chunk_id string, content string")
    for held in ({}, {"held": 0}):
        plan = knowledge.embed_chunks(df, knowledge.build_idf(df), **held)._jdf.queryExecution().toString()
        assert "element_at" not in plan and "sequence" not in plan


@pytest.mark.parametrize("held", [0, 2, 5, 1000])
def test_top_terms_by_held_and_joined_tokens(spark, held):
    rnd, words = random.Random(held), [f"w{i}" for i in range(40)] + ["Ab", "aB", "7"]
    texts = [(i, " ".join(rnd.choices(words, [1 / (j + 1) for j in range(43)], k=rnd.choice([0, 1, 3, 30, 200])))) for i in range(60)]
    texts += [(None, "w1 w2 w2 ünï 数据"), (None, "w1 w39"), (5, "w2 w40 only"), (99, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    idf = {r.token: r.idf for r in knowledge.build_idf(df, "text").collect()}
    counts = {}
    for i, x in texts:
        for t in re.findall("[a-z_][a-z0-9_]*|[0-9]+", (x or "").lower()):
            counts.setdefault(i, {}).setdefault(t, 0)
            counts[i][t] += 1
    want = {(i, n + 1, t, -w) for i, c in counts.items() for n, (w, t) in enumerate(sorted((-round(n * idf[t], 3), t) for t, n in c.items())[:3])}
    got = knowledge.tfidf_top(df, "doc_id", "text", 3, held).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top_terms_shuffle_few_rows(spark):
    df = spark.range(300).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 200), i -> concat('w', i))) AS text")
    top = knowledge.tfidf_top(df, "doc_id", "text", 3)
    assert top.count() == 900 and "(explode" not in (plan := top._jdf.queryExecution().toString()) and "explode(" not in plan


def test_clamps_and_stats(spark):
    assert [retrieval.clamp_k(k) for k in (None, 0, 3, 99)] == [5, 1, 3, 20]
    df = spark.createDataFrame([("a", float(i)) for i in range(6)], "g string, v double")
    r = retrieval.latency_stats(df, "g", "v").first()
    assert (r.p50, r.p95, r.n) == (2.0, 5.0, 6)


def test_audit_stream(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:01:00' ts, 't' tool, '{}' args, 'ok' decision, 'none' layer, true ok, 1.0D ms union all select timestamp'2024-01-01 00:07:00', 't', '{}', 'blocked', 'L2', false, 2.0D")
    audit.append(rows, f"{tmp_path}/a")
    q = audit.windowed(audit.read_stream(spark, f"{tmp_path}/a")).writeStream.outputMode("complete").format("memory").queryName("audit_w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.decision, r.n) for r in spark.table("audit_w").collect()) == [("blocked", 1), ("ok", 1)]


def test_store(spark, tmp_path):
    d = spark.createDataFrame([("a", "one", 3), ("b", "two", 4)], "source string, content string, token_count int")
    s = knowledge.ChunkStore(spark, str(tmp_path))
    s.save(knowledge.replace_sources(d, spark.createDataFrame([("b", "new", 9)], d.schema)), "v1")
    assert sorted(r.content for r in s.chunks("v1").collect()) == ["new", "one"] and s.idf("v1").count() == 2
    assert knowledge.store_stats(s.chunks("v1")).first() == (2, 2, 6)
    assert knowledge.orphans(d, d.where(F.col("source") == "a")).collect() == [("b",)]
