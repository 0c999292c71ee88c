import random

import numpy as np
import pytest
import xxhash

from lakewarden.llm import decontaminate, simhash, topk
from lakewarden.llm.components import components


def fp_brute(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_brute(fps, radius):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    u = sorted(set(fps))
    for i, a in enumerate(u):
        for b in u[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in u}


def test_fingerprints_and_components(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(300)] + ["É", "ß"]
    base = [[r.choice(vocab) for _ in range(r.choice([1, 3, 4, 5, 60, 200]))] for _ in range(60)]
    texts = [None, "", " \n", "one", "One", "one two three four"] + [" ".join(b) for b in base]
    for b in base[:40]:
        c = list(b)
        c[r.randrange(len(c))] = "changed"
        texts += ["\t".join(b).upper(), " ".join(c)]
    docs = spark.createDataFrame([(i + 10, t, "x") for i, t in enumerate(texts)] + [(None, "one", "x")], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs, 4).collect()}
    fps = {i + 10: fp_brute("".join(c.lower() if c.isascii() else c for c in t) if t else t, 4) for i, t in enumerate(texts)}
    assert {k: v[0] for k, v in got.items() if k} == fps
    cls = classes_brute(fps.values(), 4)
    least = {}
    for i, f in fps.items():
        least[cls[f]] = min(i, least.get(cls[f], i))
    assert {k: v[1] for k, v in got.items() if k} == {i: least[cls[f]] for i, f in fps.items()}
    assert got[None][1] == got[13][1]
    assert simhash.near_duplicates(docs.limit(0), 4).count() == 0


def test_ball_links_on_dense_balls(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 3000)  # on this machine workers read the module's own value
    r = random.Random(6)
    fps = set()
    for _ in range(20):
        c = r.getrandbits(64)
        for _ in range(40):
            c2 = c
            for b in r.sample(range(64), r.randrange(0, 6)):
                c2 ^= 1 << b
            fps.add(c2)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.ball_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4)
    roots = {r.v: r.root for r in components(links).collect()}
    cls = classes_brute(fps, 4)
    mine = {}
    for f, s in zip(fps, signed, strict=True):
        mine.setdefault(roots.get(s, s), set()).add(f)
    want = {}
    for f, c in cls.items():
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_collide_splits_slices_exactly(monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 500)
    r = np.random.default_rng(1)
    centre = r.integers(0, 2**63, 5, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, 4), False)) for _ in range(15)], np.uint64) for c in centre]))
    out = []
    simhash._collide(fps, np.full(len(fps), 2), 0, 0, out)
    a, b = np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        root[find(x)] = find(y)
    cls = classes_brute(fps.tolist(), 4)
    for x in cls:
        for y in cls:
            assert (find(x) == find(y)) == (cls[x] == cls[y])


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000), (7, 8)]
    got = {r.v: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in range(1000, 1400)} == {1000} and 5000 not in got


def topk_brute(vecs, queries, k):
    good = {i: np.floor(64 * np.array(v, float)) for i, v in vecs if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in good:
        if q in queries:
            s = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:k]
            out += [(q, n, i, -x) for n, (x, i) in enumerate(s, 1)]
    return sorted(out)


@pytest.mark.parametrize("n,k", [(700, 5), (30, 50), (1, 3)])
def test_topk_is_exact(spark, n, k, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERIES", 16)
    r = np.random.default_rng(n)
    centre = r.normal(size=(6, 8))
    vecs = [(i, (centre[i % 6] + 0.2 * r.normal(size=8)).astype(np.float32).tolist()) for i in range(n)]
    vecs += [(n + i, vecs[0][1]) for i in range(n // 3)]
    vecs += [(9001, None), (9002, [float("nan")] * 8), (9003, [1.0, None] + [0.0] * 6), (9004, [float("inf")] + [0.0] * 7), (None, vecs[0][1])]
    df = spark.createDataFrame([(*v, "x") for v in vecs], "vec_id long, embedding array<float>, id string")
    rows = topk.quantise(df)
    got = topk.top_k(rows, rows.where("vec_id % 20 = 0"), k).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == topk_brute(vecs, {i for i, _ in vecs if i is not None and i % 20 == 0}, k)


def test_topk_of_copies_odd_sizes_and_repeated_ids(spark):
    vecs = [(i, [1.0, 2.0, 3.0]) for i in range(200)] + [(200 + i, [float(i % 7), 1.0]) for i in range(60)]
    got = topk.top_k(rows := topk.quantise(spark.createDataFrame(vecs, "vec_id long, embedding array<double>")), rows.where("vec_id % 20 = 0"), 6).collect()
    padded = [(i, (v + [0.0])[:3]) for i, v in vecs]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == topk_brute(padded, {i for i, _ in vecs if i % 20 == 0}, 6)
    rows = topk.quantise(spark.createDataFrame([(1, [1.0])] * 9 + [(0, [1.0]), (2, [1.0])], "vec_id long, embedding array<double>"))
    got = topk.top_k(rows, rows.where("vec_id < 2"), 4).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 1), (0, 3, 1), (0, 4, 1), (1, 1, 0), (1, 2, 2)]


def test_topk_refuses_what_it_cannot_score_exactly(spark):
    rows = topk.quantise(spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="would not be exact"):
        topk.top_k(rows, rows, 2).collect()


def test_topk_of_nothing(spark):
    df = topk.quantise(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(df, df, 3).count() == 0


def grams(text):
    import regex

    w = [x for x in regex.split(r"[^\p{L}\p{M}\p{N}]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("literal", [True, False])
def test_containment_equals_brute_force(spark, literal, monkeypatch):
    if not literal:
        monkeypatch.setattr(decontaminate, "FILTER_SLOTS", 2)  # all pass in vain
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(400)] + ["Élan", "naïve"]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [say(r.choice([3, 5, 6, 14, 30])) for _ in range(40)]
    docs = [None, "", "one two"]
    for i in items:
        part = list(i)
        if r.random() < 0.6:
            part[r.randrange(len(part))] = "edited"
        docs.append(", ".join(say(r.randrange(0, 900)) + part + say(r.randrange(0, 50))))
        docs.append(" ".join(say(50) + i[: len(i) // 2] + say(5)).upper())
    docs += [docs[3], " ".join(items[0])]
    texts = [" ".join(i) for i in items] + [None, "", " ".join(items[3])]
    d = spark.createDataFrame([(i % 70, t, "x") for i, t in enumerate(docs)] + [(None, docs[3], "x")], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    got = sorted(((x.doc_id, x.item_id, x.shared, x.size) for x in decontaminate.contained(d, b).collect()), key=str)
    want = []
    for i, t in [*((i % 70, t) for i, t in enumerate(docs)), (None, docs[3])]:
        for j, u in enumerate(texts):
            g = grams(u)
            if g and len(g & grams(t)) >= 0.8 * len(g) - 1e-9:
                want.append((i, j, len(g & grams(t)), len(g)))
    assert got == sorted(want, key=str) and len(got) > 20
    assert decontaminate.contained(d, b.limit(0)).count() == 0 and decontaminate.contained(d.limit(0), b).count() == 0


def test_plans_do_not_hold_the_filter(spark):
    d = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(9)], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(f"w3x{k}" for k in range(12)))], "item_id long, text string")
    kept = []
    make = decontaminate.materialise
    with pytest.MonkeyPatch.context() as m:
        m.setattr(decontaminate, "materialise", lambda df, name: kept.append(df) or make(df, name))
        got = decontaminate.contained(d, b).collect()
    assert [(r.doc_id, r.item_id, r.containment) for r in got] == [(3, 1, 1.0)]
    assert len(kept) == 3
    assert max(len(df._jdf.queryExecution().toString()) for df in kept) < 100_000
