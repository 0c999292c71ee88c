import functools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from lakewarden.llm import packing, token_archive, token_codec
from lakewarden.llm.common import scratch
from lakewarden.llm.elias_fano import EliasFano
from lakewarden.llm.token_codec import WordCodec

TEXTS = ["", None, "one two", " lead", "a  b", "a\n b", "don't stop", "İ ſ x", "trail ", "<|endoftext|> x", "word " * 3000 + "end", "one two", "word <|EndOfText|> word", "a\nb.\nC", "\n", "A.B, c.\nD!", "a\x00b \x01c \x02.", "K <|startoftext|>", "e\u0301 \u0301x", "\u0915\u093c\u0958 ok.", "it's 12 3.5. ... !? (x).\n\ny", "x\ty", "a\u00a0 b", "I\u0307 X. \u0130."]


@functools.cache
def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def reference(name, text, end):
    k = library(name)
    return [*k.encode(text or "", add_special_tokens=False).ids, end]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(7 * i % 5 if i % 5 else i + 100, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_codec_equals_library(name):
    c = WordCodec(public_tokenizers.path(name))
    for texts in (TEXTS, *([t] for t in TEXTS), TEXTS[::-1]):  # the last from the cache
        ids, bounds = c.encode(pa.array([t or "" for t in texts]), 3)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [reference(name, t, 3) for t in texts]
    assert c.encode(pa.array([], pa.string()), 3)[1].tolist() == [0]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_codec_on_real_texts_and_a_full_cache(name, monkeypatch):
    monkeypatch.setattr(token_codec, "CACHE_WORDS", 500)
    c = WordCodec(public_tokenizers.path(name))
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].combine_chunks().cast(pa.string()).fill_null("")
    for a, n in token_codec.slices(texts, 100_000):
        ids, bounds = c.encode(texts.slice(a, n))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [reference(name, t, 0)[:-1] for t in texts.slice(a, n).to_pylist()]


def test_segment_keys():
    for keys in ([None, None, -(2**63), -5, -5, 2**63 - 1], [None], [7], [2**60 + 1, 2**60 + 2]):
        s = token_archive.Segment(1, 2, 3, keys, EliasFano.encode(np.arange(len(keys) + 1)), np.arange(len(keys), dtype="<u2"))
        assert token_archive.Segment.from_bytes(s.to_bytes()).doc_ids == keys


@pytest.mark.parametrize("step", [1, 2, 900])
def test_elias_fano_round_trip(step):
    v = np.cumsum(np.random.default_rng(3).integers(0, step, 2000))
    e, _ = EliasFano.from_bytes(EliasFano.encode(v).to_bytes())
    assert e.decode().tolist() == v.tolist()
    assert [e.select(i) for i in range(2000)] == v.tolist()
    assert EliasFano.encode(np.array([], np.int64)).decode().tolist() == []
    with pytest.raises(IndexError):
        e.select(2000)


def test_archive_round_trip(spark, docs):
    path = scratch(spark, "t")
    token_archive.write_token_archive(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    got = token_archive.read_token_archive(spark, path).orderBy("start").collect()
    keys = [r.doc_id for r in got]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    want = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect())
    start = 0
    for (k, text), r in zip(want, got, strict=True):
        ids = reference("byte_bpe_50k.json", text, 2)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    first = token_archive.Segment.from_bytes(bytes(spark.read.format("binaryFile").load(path).orderBy("path").first().content))
    assert first.tokens(0).tolist() == reference("byte_bpe_50k.json", want[0][1], 2)


def test_archive_of_nothing(spark, docs):
    path = scratch(spark, "t")
    token_archive.write_token_archive(docs.limit(0), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert token_archive.read_token_archive(spark, path).count() == 0


def test_packing_is_exact(docs):
    pieces = packing.cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 1, 64)
    rows = packing.pack(pieces, 64, group_pieces=20).collect()
    want = []
    for r in docs.collect():
        ids = reference("word_bpe_49k.json", r.text, 1)
        want += [(r.doc_id, i, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for i, a in enumerate(range(0, len(ids), 64))]
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 64


def test_packing_against_all_gaps():
    """Each place is the one of least sum of squares, by trying all gaps."""
    r = np.random.default_rng(11)
    for _ in range(20):
        capacity = int(r.integers(5, 40))
        x = r.integers(1, capacity + 1, 150)
        bins, offsets = packing.sum_of_squares(x, capacity)
        gaps = {}
        for s, b, o in zip(x.tolist(), bins.tolist(), offsets.tolist(), strict=True):
            counts = np.bincount(list(gaps.values()), minlength=capacity + 1)

            def after(g, fresh):
                n = counts.copy()
                n[g] -= not fresh
                n[g - s] += 1
                return int((n[1:] ** 2).sum())

            found = {g: after(g, False) for g in range(s, capacity + 1) if counts[g]}
            found[0] = after(capacity, True)  # a new sequence
            now = gaps.get(b, capacity)
            assert capacity - now == o and (found[now] if b in gaps else found[0]) == min(found.values())
            gaps[b] = now - s


def test_ids_beside_null_ids_stay_exact(spark):
    docs = spark.createDataFrame([(2**60 + 1, "a b"), (None, "c")], "doc_id long, text string")
    got = packing.pack(packing.cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 1, 64), 64).collect()
    assert {r.doc_id for r in got} == {2**60 + 1, None}


def test_packing_of_nothing(docs):
    assert packing.pack(packing.cut_pieces(docs.limit(0), public_tokenizers.path("word_bpe_49k.json"), 1, 64), 64).count() == 0


def test_sum_of_squares_is_near_the_bound():
    x = np.random.default_rng(5).integers(1, 300, 8000)
    bins, offsets = packing.sum_of_squares(x, 1000)
    assert np.bincount(bins, x).max() <= 1000
    assert bins.max() + 1 <= 1.03 * np.ceil(x.sum() / 1000)


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_full_cache_keeps_the_words_at_hand(file, monkeypatch):
    monkeypatch.setattr(token_codec, "CACHE_WORDS", 5)
    c = token_codec.WordCodec(public_tokenizers.path(file))
    learned, learn = [], c._learn
    monkeypatch.setattr(c, "_learn", lambda new: learned.extend(new) or learn(new))
    for texts in (["one two three\nfour, five", "six seven eight nine"], ["nine eight  odd ", "", "five two eleven four"], ["eleven one\nnine, two", "ten"]):
        own = [c.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        for end in (None, 2):
            ids, bounds = c.encode(pa.array(texts), end)
            ends = [] if end is None else [end]
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [x + ends for x in own]
    first = len(learned)
    for _ in range(2):
        c.encode(pa.array(["eleven one\nnine, two", "ten"]), 2)
    assert len(learned) == first
