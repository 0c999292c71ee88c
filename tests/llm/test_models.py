import heapq
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakewarden.llm import context_mixing, labelled, quality, toxicity
from lakewarden.llm.common import crc_mod, crc_mod_py


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_automaton_equals_edit_distance():
    r = random.Random(3)
    say = lambda a, b: "".join(r.choice("abc") for _ in range(r.randint(a, b)))
    entries = sorted({(say(3, 10), r.random() < 0.3) for _ in range(25)})
    m = toxicity.Matcher(entries)
    for _ in range(1500):
        w = say(1, 12)
        want = None
        for e, stem in entries:
            allowed = 0 if len(e) < (6 if stem else 5) else 1 if len(e) < 8 or stem else 2
            d = min(lev(w[:k], e) for k in range(len(w) + 1)) if stem else lev(w, e)
            if d <= allowed:
                want = min(want or (9, True), (d, stem))
        assert m.match(w) == want, w
    assert toxicity.Matcher([]).match("a") is None
    assert toxicity.Matcher([("idiot", False)]).match("1di0t") == (0, False)


def test_quotation_is_told_from_abuse():
    m = toxicity.Matcher([("idiot", False)])
    assert [h[4] for h in toxicity.hits('you idiot. he said "an idiot" to me. well that was a very long time ago, idioot', m)] == [False, True, False]
    assert toxicity.hits("", m) == []


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(11)
    plain = ["".join(r.choice(["ta", "ri", "mo", "ke", "lu"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    docs, labels = [(0, "", 0, "en"), (None, "no id", None, None), (900, None, None, "en")], []
    for i in range(1, 500):
        words = [r.choice(plain) for _ in range(r.randint(5, 60))]
        bad, low = i % 7 == 0, i % 5 == 0
        if bad:
            words[r.randrange(len(words))] = r.choice(["zorgle", "blixter", f"vunk{r.choice(plain)}"])
        if low:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), 7, "en"))
        if i % 10:
            labels.append((i, int(not low), int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string, n_chars long, score string"), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (777777, 1, 0)], "doc_id long, quality int, toxic int")


def held_out_accuracy(scored, labels, k, rest, label):
    rows = scored.where(crc_mod(F.col("doc_id"), k) == rest).join(labels, "doc_id").where(F.col(label).isNotNull()).collect()
    assert len(rows) > 60
    return np.mean([(r.score >= 0.7) == bool(r[label]) for r in rows])


def test_toxicity_on_held_out(corpus):
    docs, labels = corpus
    model = toxicity.train(docs, labels, crc_mod(F.col("k"), 3) != 1)
    assert {"zorgle", "blixter"} <= {e for e, _ in model[0]} and ("vunk", True) in model[0]
    scored = toxicity.score(docs, model, ["doc_id"])
    assert held_out_accuracy(scored, labels, 3, 1, "toxic") >= 0.97
    assert scored.count() == docs.count()
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).count() == 0
    odd = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert odd[0] == [] and 0 <= toxicity.score(docs, odd, ["doc_id"]).first().score < 0.5


def test_long_terms_and_their_misspellings(spark):
    r = random.Random(4)
    term = "abominablescoundrelous"
    say = lambda: " ".join("".join(r.choice("bcdfg") + r.choice("aeiou") for _ in range(3)) for _ in range(20))
    docs = [(i, say() + (f" {term}" if i % 3 == 0 else "")) for i in range(150)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), labels, F.lit(True))
    assert (term, False) in model[0]
    odd = [(1, f"you {term}"), (2, "you abominablescoundrelus"), (3, f"you {term}x and"), (4, f'"{"so " * 200}{term}" and'), (5, f"a {term}, he said"), (6, "x" * 300_000), (2**60 + 1, None), (None, "")]
    got = toxicity.score(spark.createDataFrame(odd, "doc_id long, text string").coalesce(1), model, ["doc_id"])
    by = {x.doc_id: x for x in got.collect()}
    assert [by[k].score >= 0.7 for k in (1, 2, 3, 4, 5, 6)] == [True, True, True, False, False, False] and 2**60 + 1 in by and None in by


def test_clashing_columns_and_exact_ids(spark, corpus):
    docs, labels = corpus
    kinds = "doc_id long, text string, n_chars long, score string, hits string, _text string, x0 int, label string, k string"
    odd = spark.createDataFrame([(2**60 + 1, "a b", 3, "s", "h", "t", 1, "l", "k"), (None, None, None, None, None, None, None, None, None), (7, "c " * 50_000, 5, "s", "h", "t", 2, "l", "k")], kinds)
    for model, op in ((quality.train(docs, labels, F.lit(True)), quality), (toxicity.train(docs, labels, F.lit(True)), toxicity)):
        rows = op.score(odd, model, odd.columns).toDF(*(f"c{i}" for i in range(9 + (2 if op is toxicity else 1)))).collect()
        assert {x.c0 for x in rows} == {2**60 + 1, None, 7} and {x.c3 for x in rows} == {"s", None} and all(0 <= x.c9 <= 1 for x in rows)


def test_sample_of_repeated_ids_is_bounded(spark):
    docs = spark.createDataFrame([(i % 3, f"t{i}", i) for i in range(3000)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    assert 0 < labelled.sample(docs, labels, "quality", F.lit(True), 100).count() < 250


def test_quality_on_held_out(corpus):
    docs, labels = corpus
    model = quality.train(docs, labels, crc_mod(F.col("k"), 4) != 2)
    scored = quality.score(docs, model, ["doc_id"])
    assert held_out_accuracy(scored, labels, 4, 2, "quality") >= 0.97
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    flat = quality.train(docs, labels.limit(0), F.lit(True))
    assert quality.score(docs, flat, ["doc_id"]).where("abs(score - 0.5) > 1e-6").count() == 0


def test_linear_time_identity():
    r = np.random.default_rng(0)
    m = quality.FactorisationMachine(0.3, r.normal(size=50).astype(np.float32), r.normal(size=(50, quality.FACTORS)).astype(np.float32))
    idx, val = r.choice(50, 12, False).astype(np.int32), r.normal(size=12).astype(np.float32)
    pairs = sum(m.v[idx[i]] @ m.v[idx[j]] * val[i] * val[j] for i in range(12) for j in range(i))
    assert m.raw([(idx, val)])[0] == pytest.approx(0.3 + m.w[idx] @ val + pairs, rel=1e-4)


def brute_mix(training, texts, hot, escape, table_bits):
    """The mixer a bit at a time in plain Python; ``hot`` are (word, count) in order."""
    u = 0xFFFFFFFF

    def mixed(x, salt=0):
        x = ((x ^ (salt * 0x9E3779B1 & u)) * 0x85EBCA6B) & u
        x = ((x ^ (x >> 15)) * 0xC2B2AE35) & u
        return x ^ (x >> 13)

    n = len(hot)
    heap, up, total = [(c, i) for i, (_, c) in enumerate([*hot, (None, escape)])], {}, {}
    heapq.heapify(heap)
    total.update({i: c for c, i in heap})
    top = n
    while len(heap) > 1:
        (x, a), (y, b) = heapq.heappop(heap), heapq.heappop(heap)
        top += 1
        up[a], up[b], total[top] = (top, 0), (top, 1), x + y
        heapq.heappush(heap, (x + y, top))
    rank = {w: i for i, (w, _) in enumerate(hot)}

    def path(w):
        x, out = rank.get(w, n), []
        while x != top:
            out.append(up[x])
            x = up[x][0]
        return out[::-1]

    ones = {}
    for x, (node, bit) in up.items():
        ones[node] = ones.get(node, 0) + bit * total[x]

    def steps(words):
        before, last = 1, context_mixing.COMMON
        for w in words:
            for place, (node, bit) in enumerate(path(w)):
                slot = (((mixed(before, 2) ^ mixed(node - n - 1, 1)) * 0x9E3779B1) & u) >> (32 - table_bits)
                yield node, bit, slot if place < context_mixing.HEAD else None, (last, node)
            before = zlib.crc32(w)
            if rank.get(w, n) < min(context_mixing.COMMON, n):
                last = rank[w]

    by_slot, by_common = {}, {}
    for words in training:
        for _, bit, slot, pair in steps(words):
            by_common.setdefault(pair, [0, 0])[bit] += 1
            if slot:  # the first slot stays empty
                by_slot.setdefault(slot, [0, 0])[bit] += 1

    def known(t, s):
        c = t.get(s, [0, 0])
        value = round(min(max(math.log((c[1] + 0.4) / (c[0] + 0.4)), -7.9), 7.9) * 16) / 16
        return sum(sum(c) > x for x in (0, 3, 30, 300)), value

    out = []
    for words in texts:
        weights = context_mixing.first_weights().astype(float)
        squares = np.full(weights.shape, 0.1)
        table = 1 / (1 + np.exp(-np.linspace(-8, 8, context_mixing.BUCKETS)))
        score, a, b = 0.0, 0, context_mixing.BLOCK
        while a < len(words):
            grad, hits = np.zeros(weights.shape), {}
            # contexts of the block's words follow from the words before them
            skip = sum(len(path(w)) for w in words[:a])
            size = sum(len(path(w)) for w in words[a:b])
            for node, bit, slot, pair in itertools.islice(steps(words), skip, skip + size):
                alone = math.log((ones[node] + 0.4) / (total[node] - ones[node] + 0.4))
                level, value = known(by_common, pair)
                if slot is None:
                    z = context_mixing.LATER[0][level] * alone + context_mixing.LATER[1][level] * value
                    score -= math.log10(1 + math.exp(-z if bit else z))
                    continue
                got = known(by_slot, slot)
                gate = got[0] * context_mixing.LEVELS + level
                x = np.array([alone, got[1], value])
                z = min(max(float(weights[gate] @ x), -8), 8)
                p = 1 / (1 + math.exp(-z))
                cell = round((z + 8) * (context_mixing.BUCKETS - 1) / 16)
                final = (p + table[cell]) / 2
                score += math.log10(final if bit else 1 - final)
                grad[gate] += (bit - p) * x
                hits.setdefault(cell, []).append(bit)
            squares += grad**2
            weights += context_mixing.RATE * grad / np.sqrt(squares)
            for cell, seen in hits.items():
                table[cell] += (sum(seen) / len(seen) - table[cell]) * (1 - math.exp(-context_mixing.MAP_RATE * len(seen)))
            table = np.clip(table, 1e-4, 1 - 1e-4)
            a, b = b, 2 * b
        out.append(score)
    return out


def test_lm_score_equals_brute_force(spark, monkeypatch):
    """The whole score: mixed bits a bit at a time, shares of rare words, and spelled new words."""
    monkeypatch.setattr(context_mixing, "HOT_WORDS", 40)
    monkeypatch.setattr(context_mixing, "COMMON", 4)
    r = random.Random(2)
    say = lambda k: " ".join(f"w{min(int(r.expovariate(0.06)), 90)}" for _ in range(k))
    docs = [(i, say(r.randint(0, 90)) + (f" New{i}" if i % 4 == 0 else "")) for i in range(40)]
    got = {x.doc_id: x for x in context_mixing.score(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") % 4 == 0).collect()}
    words = {i: t.lower().encode().split() + [b"\n"] for i, t in docs}
    training = [w for i, w in words.items() if i % 4]
    counts = Counter(w for ws in training for w in ws)
    order = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    least = next(c for c in sorted(set(counts.values())) if sum(v >= c for v in counts.values()) <= 40)
    hot = [(w, c) for w, c in order if c >= least]
    rare = sum(c for w, c in order if c < least)
    once = max(sum(c == 1 for c in counts.values()), 1)
    bits = context_mixing._fit_bits((context_mixing.TABLE_BITS,), 2 * sum(counts.values()))[0]
    want = dict(zip(words, brute_mix(training, words.values(), hot, rare + once, bits), strict=True))
    new = once / (rare + once)
    spell_bits = context_mixing._fit_bits(context_mixing.SPELL_BITS, 16 * len(counts))
    tables = [np.zeros(2 << b, np.int64) for b in spell_bits]
    _, hashed, node, bit = context_mixing._spelled(list(counts))
    for t, h, b in zip(tables, hashed, spell_bits, strict=True):
        np.add.at(t, 2 * context_mixing._slots(h, node, b) + bit, 1)
    tables = [context_mixing._logits(t[0::2], t[1::2]) for t in tables]
    for i, ws in words.items():
        for w in ws:
            if w not in dict(hot):
                want[i] += math.log10((1 - new) * counts[w] / rare) if w in counts else math.log10(new) + context_mixing.spell(tables, [w])[0]
        assert got[i].score == pytest.approx(want[i], rel=1e-4), i


def test_every_bit_of_a_word_is_mixed_with_the_word_before():
    words = [b"w%d" % i for i in range(1024)]
    code = context_mixing.Code(words, [1] * 1024, 1)
    last = {code.nodes[code.starts[i + 1] - 1]: i for i in range(100, 1024)}
    zero, one, node = next((i, last[k], k) for i in range(100, 1024) if last[k := code.nodes[code.starts[i + 1] - 1]] != i)
    if code.bits[code.starts[zero + 1] - 1]:
        zero, one = one, zero
    tables = context_mixing.Tables(code, 16)
    w = context_mixing.Words(pa.array([f"w0 w{zero}", f"w0 w{one}"]))
    before = context_mixing.contexts(code, w)[1][1:2]
    tables.before[context_mixing._slots(before, context_mixing._hash(np.array([node], np.uint32), 1), 16)] = context_mixing._logits(np.zeros(1), np.full(1, 1000.0))
    low, high = context_mixing.mix(code, tables, w)[0]
    assert high > low + 0.5


def test_spelling_is_a_probability():
    tables = [context_mixing._logits(np.arange(1 << b) % 3, np.arange(1 << b) % 5) for b in context_mixing.SPELL_BITS]
    one = 10 ** context_mixing.spell(tables, [bytes([b]) for b in range(256)])
    assert 0 < one.sum() < 1
    assert context_mixing.spell(tables, [b"x" * 5000])[0] < -1000 and len(context_mixing.spell(tables, [])) == 0


def test_code_is_prefix_free_and_follows_counts():
    code = context_mixing.Code([b"a", b"b", b"c"], [8, 4, 1], 2)
    sizes = np.diff(code.starts)
    assert (2.0**-sizes).sum() == 1 and sizes[0] == 1
    assert np.diff(context_mixing.Code([], [], 1).starts).tolist() == [0]


def test_lm_counts_equal_brute_force(spark, corpus):
    docs, _ = corpus
    got = context_mixing.score(docs, crc_mod(F.col("doc_id"), 5) == 1).collect()
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b"\n"], crc_mod_py(r.doc_id, 5) == 1) for r in docs.collect()]
    counts = {}
    for _, ws, held in rows:
        for w in ws if not held else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = {k: (held, len(ws), sum(w in counts for w in ws), n, sum(np.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for k, ws, held in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], abs=1e-6) and r.score < 0
    assert context_mixing.score(docs.limit(0), F.lit(False)).count() == 0
    for other in (docs.repartition(3), docs.repartition(1).orderBy(F.desc("doc_id"))):
        again = {r.doc_id: r.score for r in context_mixing.score(other, crc_mod(F.col("doc_id"), 5) == 1).collect()}
        assert all(again[r.doc_id] == pytest.approx(r.score, rel=1e-9) for r in got)


def test_lm_odd_tables(spark):
    kinds = "doc_id long, text string, word string, row string, held_out string"
    docs = spark.createDataFrame([(1, None, "x", "y", "z"), (1, "", "x", "y", "z"), (None, " A\x0bb\tÉ ", "x", "y", "z"), (2, "a " * 40_000 + "q" * 70_000, "x", "y", "z")], kinds)
    for held in (F.lit(False), F.lit(True), F.lit(None).cast("boolean")):
        got = context_mixing.score(docs, held).collect()
        assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 1), ("1", 1), ("2", 40_002), ("None", 4)]
        assert all(r.score <= 0 and np.isfinite(r.score) and np.isfinite(r.base_score) for r in got)


def test_lm_beats_the_base_and_knows_what_it_read(spark):
    got = context_mixing.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), crc_mod(F.col("doc_id"), 5) == 1)
    r = got.groupBy("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).collect()
    assert all(x.s > (0.95 if x.held_out else 0.85) * x.b for x in r)
