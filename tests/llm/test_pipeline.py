import random

import corpus_pipeline
import numpy as np
from pyspark.sql.classic.dataframe import DataFrame

from lakewarden.llm import shingle_pairs, simhash, token_codec, toxicity

from test_pairs import classes_brute, fp_brute, grams


def test_stages_against_plain_versions(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        path = f"{tmp_path}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(d.columns == columns for n, d in seen.items() if n != "packing")
    ids = {n: {r.doc_id for r in d.collect()} for n, d in seen.items()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert not [i for i in ids["quality"] if i in labels and labels[i].quality == 0]
    before = {r.doc_id: r.text for r in seen["toxicity"].collect()}
    fps = {i: fp_brute(t.lower(), 5) for i, t in before.items()}
    cls = classes_brute(fps.values(), 4)
    group = {i: cls[f] for i, f in fps.items()}
    shingles = {i: set(zip(*(t.lower().encode().split()[k:] for k in range(5)), strict=False)) or {tuple(t.lower().encode().split())} for i, t in before.items()}
    for i, a in shingles.items():
        for j, b in shingles.items():
            if i < j and 5 * len(a & b) >= 4 * len(a | b) and a != {()}:
                old, new = group[i], group[j]
                group = {k: new if v == old else v for k, v in group.items()}
    least = {}
    for i, g in group.items():
        least[g] = min(i, least.get(g, i))
    assert ids["near-dedup"] == set(least.values())
    items = [g for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if (g := grams(r.text))]
    clean = {i for i in ids["near-dedup"] if not any(len(g & grams(before[i])) >= 0.8 * len(g) - 1e-9 for g in items)}
    assert ids["decontamination"] == clean == ids["packing"]
    assert seen["packing"].groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


def test_null_ids_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (None, "x"), (3, None)], "doc_id long, text string")
    got = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert sorted((str(r.doc_id) for r in got.collect())) == ["1", "3", "None"]
    assert simhash.near_duplicates(docs, 5).count() == 5


def test_near_copies_down_to_a_jaccard_of_four_fifths(spark):
    r = random.Random(5)
    say = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    grams5 = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    texts = []
    for n in (12, 60, 200, 900):
        for edits in range(1, 8):
            base = say(n)
            copy = list(base)
            for k in range(edits):
                copy[(k + 1) * n // (edits + 1)] = f"e{k}"
            texts += [base, copy, ["licence", "line", "of", "them", "all", "here"] + say(n)]
    docs = [(i, " ".join(w)) for i, w in enumerate(texts)]
    fps = {i: fp_brute(t, 5) for i, t in docs}
    group = {i: i for i, _ in docs}
    beyond = 0
    for i, a in enumerate(texts):
        for j in range(i):
            x, y = grams5(a), grams5(texts[j])
            jaccard = 5 * len(x & y) >= 4 * len(x | y)
            near = bin(fps[i] ^ fps[j]).count("1") <= 4
            beyond += jaccard and not near
            if jaccard or near:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if v == old else v for k, v in group.items()}
    assert beyond > 5
    got = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "")
    assert {r.doc_id for r in got.collect()} == set(group.values())


def test_a_text_that_repeats_an_id_stays(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "a b c d e f g")], "doc_id long, text string")
    got = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert sorted((r.doc_id, r.text[0]) for r in got.collect()) == [(1, "a"), (1, "h")]


def test_decontamination_goes_by_row(spark, tmp_path):
    item = "one two three four five six seven"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, f"so {item}"), (None, "clean"), (1, f"{item} so"), (1, "clean too")], "doc_id long, text string")
    got = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == [("1", "clean too"), ("None", "clean")]


def test_stages_on_odd_tables(spark, tmp_path):
    sf = f"{tmp_path}/sf"
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    kinds = "doc_id long, text string, n_chars long, score string, hits string, `row` string, `a.b` string, _text string, fp string, root string, doc string"
    extra = ("s", "h", "r", "d", "t", "f", "o", "x")
    odd = [(2**60 + 1, None, None, *extra), (None, None, None, *([None] * 8)), (1, "clean words in a row here", 3, *extra), (1, "other words in the row here", 3, *extra), (2, "", 0, *extra), (3, "w " * 60_000, 9, *extra)]
    whole = spark.createDataFrame(odd, kinds)
    for docs in (whole, whole.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, sf)
            if name != "packing":
                assert got.columns == whole.columns, name
            ids = sorted(str(r.doc_id) for r in got.select("doc_id").distinct().collect())
            if docs is not whole:
                assert ids == []
            else:
                # the empty texts are copies: 2 stays, 2**60 + 1 goes, and the row without an id stays
                assert ids == (["1", "2", "3", "None"] if name == "near-dedup" else ["1", str(2**60 + 1), "2", "3", "None"]), name


def test_near_copies_below_the_threshold_are_not_all_verified(spark, monkeypatch):
    r = random.Random(7)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    texts = []
    for _ in range(120):
        copy = list(base)
        for k in r.sample(range(150), r.randrange(1, 9)):
            copy[k] = f"e{r.randrange(10**6)}"
        texts.append(copy)
    sets = [{tuple(w[i : i + 5]) for i in range(146)} for w in texts]
    reach = [(i, j) for i, a in enumerate(sets) for j in range(i) if 5 * len(a & sets[j]) >= 4 * len(a | sets[j])]
    assert 0 < len(reach) < 1000
    seen = []
    verified = shingle_pairs._verified
    monkeypatch.setattr(shingle_pairs, "_verified", lambda docs, pairs, *rest: seen.append(pairs.count()) or verified(docs, pairs, *rest))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "row long, text string")
    found = [(r.a, r.b) for r in shingle_pairs.similar(docs, 5, 0.8).collect()]
    join = lambda pairs: {i: min(c) for c in _classes(pairs, len(texts)) for i in c}
    assert join(found) == join(reach)
    assert sum(seen) < 700


def _classes(pairs, n):
    of = {i: {i} for i in range(n)}
    for a, b in pairs:
        if of[a] is not of[b]:
            of[a] |= of[b]
            for i in of[b]:
                of[i] = of[a]
    return list({id(c): c for c in of.values()}.values())


def test_stages_do_not_shuffle_texts(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, f"a b c d e f g {i % 7}") for i in range(50)], "doc_id long, text string")
    for stage in (corpus_pipeline.near_dedup_stage, corpus_pipeline.decontamination_stage):
        plan = stage(spark, docs, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan, stage.__name__


def test_frequent_shingles_reach_the_driver_in_few_rows(spark, monkeypatch):
    texts = [" ".join(f"w{k}" for k in range(a, a + 400)) for a in range(0, 60, 10)]
    docs = spark.createDataFrame(list(enumerate([*texts, None, ""])), "row long, text string")
    held = {}
    for t in texts:
        for h in np.unique(simhash.shingle_hashes(t.encode(), 5)).tolist():
            held[h] = held.get(h, 0) + 1
    rows, plans, collect = [], [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or rows.extend(got := collect(df)) or got)
    most = sorted(h for h, n in held.items() if n >= 3)
    assert shingle_pairs._frequent(docs, 5).tolist() == most and len(most) > 300
    assert len(rows) < 10 and "HashAggregate" not in plans[-1]  # nor does a shuffle hold a row a shingle
    monkeypatch.setattr(shingle_pairs, "FREQUENT", 7)
    few = sorted(held, key=lambda h: (-held[h], h - (h >> 63 << 64)))[:7]
    assert shingle_pairs._frequent(docs, 5).tolist() == sorted(few)


def test_near_dedup_drops_what_workers_keep_for_others():
    token_codec._codecs["some"] = toxicity._matchers[()] = object()
    list(shingle_pairs._sliced(iter([])))
    assert not token_codec._codecs and not toxicity._matchers


def test_decontamination_runs_no_python_on_executors(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(9)] + [(None, None)], "doc_id long, text string")
    spark.createDataFrame([(1, " ".join(f"w3x{k}" for k in range(12)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(i) for i in [*range(3), *range(4, 9), None])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_last_pairing_does_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    r = random.Random(11)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    texts = []
    for edits in [2] * 110 + [1] * 10:  # two of two edits each are beyond the threshold, one of one edit is near to all
        copy = list(base)
        for k in range(edits):
            copy[r.randrange(5 + 70 * k, 70 + 70 * k)] = f"e{r.randrange(10**6)}"
        texts.append(copy)
    r.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(146)} for w in texts]
    reach = [(i, j) for i, a in enumerate(sets) for j in range(i) if 5 * len(a & sets[j]) >= 4 * len(a | sets[j])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "row long, text string")
    seen = []
    ordered = shingle_pairs._ordered
    monkeypatch.setattr(shingle_pairs, "_ordered", lambda met: seen.append((met.count(), met.select("a", "b").distinct().count())) or ordered(met))
    groups = lambda pairs: sorted(sorted(c) for c in _classes(pairs, len(texts)))
    found = [(x.a, x.b) for x in shingle_pairs.similar(docs, 5, 0.8).collect()]
    assert groups(found) == groups(reach)
    assert seen[-1][0] < len(texts), seen
    monkeypatch.setattr(shingle_pairs, "STARS", ())  # all is left to the last pairing: every pair once, none lost
    found = {(x.a, x.b) for x in shingle_pairs.similar(docs, 5, 0.8).collect()}
    assert found == {(j, i) for i, j in reach}
    assert len(reach) > 1000 and seen[-1][0] < 1.1 * seen[-1][1], seen
