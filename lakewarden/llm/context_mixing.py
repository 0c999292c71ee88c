"""Operator 9, language-model scoring by online logistic context mixing.

A text is its words (runs of bytes other than blank and \\x09-\\x0D, A-Z lower-cased) and
an end sign. A word is coded in bits: the ``HOT_WORDS`` commonest words of the training
documents by the path of a Huffman tree over their counts, all others by the path of an
escape leaf and then a tail. Every bit is predicted from several contexts, which cross
blanks: the node alone, with the last common word (of ``COMMON``), and hashed with the
word before. Each has counts of zeros and ones over all training documents. The logits are
combined with weights that a gate chooses by how often the contexts were seen; an adaptive
map over the mixed logit refines the result. Weights and map start each text from the same
state and are learned online while it goes on, after blocks of 16, 16, 32, 64 ... words.
The model is fixed by the training documents and a text is scored in one pass, so a score
depends neither on partitions nor on tasks that are run again.

The tail of a word that training holds is its share of the rare words' counts. The tail
of a new word is spelled: byte by byte, each bit mixed from contexts of the last one to
four and six bytes, with counts over all distinct training words. A tail
depends on the word alone, so counts and tails of rare words are joined to the documents;
no task holds the vocabulary. Minus the sum of the log2 probabilities over the text's
bytes is its bits per byte.

Hashed tables have two slots for each training word, at most 2 ** ``TABLE_BITS`` (the
memory of a task): beyond that contexts share slots, but every document is counted.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialise
from .token_codec import slices

HOT_WORDS, COMMON = 100_000, 64
#: Bits of a word that are mixed from all contexts: all, since no path is as long.
HEAD = 128
#: log2 of the most slots of the table of the word before.
TABLE_BITS = 22
END = b"\n"
#: Distinct words that a task counts before it hands them on.
FLUSH = 200_000
CELLS = 1 << 17  # counts in a chunk of a table
LEVELS = 5  # of how often a context was seen
BLOCK, RATE, BUCKETS, MAP_RATE = 16, 0.2, 33, 0.05
#: Bytes of text that are scored together, and tokens of theirs that are mixed at a time.
SLICE, PART = 1 << 19, 1 << 14

_U32 = np.uint32


def _hash(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x ^ _U32(salt * 0x9E3779B1 & 0xFFFFFFFF)) * _U32(0x85EBCA6B)
    x = (x ^ (x >> _U32(15))) * _U32(0xC2B2AE35)
    return x ^ (x >> _U32(13))


# words ---------------------------------------------------------------------------------


class Words:
    """The words of a slice of texts: ``distinct`` (bytes), and for each token, ends included,
    its place in ``distinct`` (the end: -1). Text i has the tokens from first[i] to first[i+1]."""

    def __init__(self, texts: pa.Array) -> None:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = lists.flatten().dictionary_encode()
        self.distinct: list[bytes] = coded.dictionary.cast(pa.binary()).to_pylist()
        self.sizes = np.append(pc.binary_length(coded.dictionary).to_numpy() + 1, 1)  # bytes, a blank included
        codes = coded.indices.to_numpy()
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        if b"" in self.distinct:
            real = codes != self.distinct.index(b"")
            cuts = np.concatenate([[0], np.cumsum(real)])[cuts]
            codes = codes[real]
        self.codes = np.insert(codes, cuts[1:], -1).astype(np.int32)
        self.first = cuts + np.arange(len(cuts))

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _word_counts(docs: DataFrame) -> DataFrame:
    """word, c: how often it stands in training documents (0 if it stands in others only)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.binary()), "c": pa.array(seen.values(), pa.int64())})
            seen.clear()
            return out

        for batch in batches:
            for a, n in slices(batch.column(1)):
                w = Words(batch.column(1).slice(a, n))
                train = ~batch.column(2).slice(a, n).to_numpy(zero_copy_only=False).astype(bool)
                counts = np.bincount(w.codes[train[w.owner()]] + 1, minlength=len(w.distinct) + 1).tolist()
                get = seen.get
                for word, c in zip(w.distinct, counts[1:], strict=True):
                    seen[word] = get(word, 0) + c
                seen[END] = get(END, 0) + counts[0]
                seen.pop(b"", None)
                if len(seen) > FLUSH:
                    yield flush()
        if seen:
            yield flush()
        give_back()

    return docs.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Code:
    """The Huffman code of the hot words (by falling count, then value) and the escape leaf."""

    def __init__(self, words: list[bytes], counts: list[int], escape: int) -> None:
        self.index = dict(zip(words, range(len(words)), strict=True))
        self.counts = np.array([*counts, 0], np.int64)
        self.escape = n = len(words)
        self.common = min(COMMON, n)
        total = np.zeros(2 * n + 1, np.int64)
        total[: n + 1] = [*counts, escape]
        above, bit = np.zeros(2 * n + 1, np.int64), np.zeros(2 * n + 1, np.int8)
        heap = list(zip(total[: n + 1].tolist(), range(n + 1), strict=True))
        heapq.heapify(heap)
        top = n
        while len(heap) > 1:
            (x, a), (y, b) = heapq.heappop(heap), heapq.heappop(heap)
            top += 1
            above[a] = above[b] = top
            bit[b], total[top] = 1, x + y
            heapq.heappush(heap, (x + y, top))
        nodes: list[int] = []
        bits: list[int] = []
        starts = [0]
        up, one = above.tolist(), bit.tolist()
        for leaf in range(n + 1):
            path, x = [], leaf
            while x != top:
                path.append((up[x], one[x]))
                x = up[x]
            nodes += [p - n - 1 for p, _ in reversed(path)]
            bits += [b for _, b in reversed(path)]
            starts.append(len(nodes))
        self.nodes, self.bits, self.starts = np.array(nodes, np.int32), np.array(bits, np.uint8), np.array(starts, np.int64)
        self.sizes = np.diff(self.starts)
        # the leaves in the order of the tree: an inner node's zeros stand from low to mid, its ones from mid to high
        self.order = np.zeros(n + 1, np.int64)
        self.low, self.mid, self.high = (np.zeros(n, np.int64) for _ in range(3))
        below: dict[int, list[int]] = {}
        for x in range(top):
            below.setdefault(up[x], [0, 0])[one[x]] = x
        todo, place = [(top, 0)], 0
        while todo:
            x, step = todo.pop()
            if x <= n:
                self.order[place] = x
                place += 1
            elif step == 0:
                self.low[x - n - 1] = place
                todo += [(x, 1), (below[x][0], 0)]
            elif step == 1:
                self.mid[x - n - 1] = place
                todo += [(x, 2), (below[x][1], 0)]
            else:
                self.high[x - n - 1] = place
        self.logit = np.zeros(0, np.float32)
        zeros, ones = self.split(total[: n + 1])
        self.logit = np.log((ones + 0.4) / (zeros + 0.4)).astype(np.float32)
        assert self.sizes.max() <= HEAD
        self.hashes = _hash(self.nodes.astype(_U32), 1)

    def split(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Zeros and ones of each inner node, from counts of the leaves."""
        sums = np.concatenate([[0], np.cumsum(counts[self.order])])
        return sums[self.mid] - sums[self.low], sums[self.high] - sums[self.mid]

    def steps(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all bits of the leaves: the place of its leaf, and its own in ``nodes``, ``bits`` and ``hashes``."""
        sizes = self.sizes.take(leaf)
        at = np.arange(int(sizes.sum())) + np.repeat(self.starts.take(leaf) - (np.cumsum(sizes) - sizes), sizes)
        return np.repeat(np.arange(len(leaf)), sizes), at

    def leaves(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each distinct word, and of the end last, and their hashes."""
        words = [*w.distinct, END]
        leaf = np.fromiter(map(self.index.get, words, repeat(self.escape)), np.int32, len(words))
        return leaf, np.fromiter(map(zlib.crc32, words), _U32, len(words))


def contexts(code: Code, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token the leaf, the hash of the word before, and the last common word's leaf
    (``code.common`` without one)."""
    leaf, hashed = code.leaves(w)
    leaf, hashed = leaf[w.codes], hashed[w.codes]
    n = len(leaf)
    begin = w.first[w.owner()]
    at = np.arange(n)
    before = np.where(at > begin, np.roll(hashed, 1), _U32(1))
    common = np.maximum.accumulate(np.where(leaf < code.common, at, -1)) if n else at
    last = np.concatenate([[-1], common[:-1]]) if n else at
    return leaf, _hash(before, 2), np.where(last >= begin, leaf[last], code.common)


def _slots(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Of contexts (a column) and their nodes (rows)."""
    return _slot(context[:, None], node, bits)


def _slot(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    return (((context ^ node) * _U32(0x9E3779B1)) >> _U32(32 - bits)).astype(np.intp)


# counts of a table: zeros and ones of each slot side by side --------------------------------


def _pack(x: np.ndarray) -> bytes:
    kind = next(k for k in ("u1", "u2", "u4", "u8") if not len(x) or int(x.max()) <= np.iinfo(k).max)
    return kind.encode() + pa.compress(x.astype(f"<{kind}").tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, cells: int) -> np.ndarray:
    kind = data[:2].decode()
    return np.frombuffer(pa.decompress(data[2:], cells * int(kind[1]), codec="zstd", asbytes=True), f"<{kind}").astype(np.int64)


def _chunks(tables: list[np.ndarray], cells: list[int], salt: int) -> Iterator[pa.RecordBatch]:
    for k, (t, size) in enumerate(zip(tables, cells, strict=True)):
        for a in range(0, len(t), size):
            part = t[a : a + size]
            if part.any():
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "a": pa.array([a // size], pa.int32()), "cells": pa.array([len(part)], pa.int32()), "salt": pa.array([salt], pa.int32()), "data": pa.array([_pack(part)], pa.binary())})


CHUNK = "k int, a int, cells int, salt int, data binary"


def _summed(chunks: DataFrame) -> DataFrame:
    """k, a, cells, data: the sums of chunks, in two steps so that no task reads those of all
    tasks; sums of integers do not depend on the order."""

    def add(rows: pa.Table) -> pa.Table:
        total = 0
        for data in rows["data"]:
            total = total + _unpack(data.as_py(), rows["cells"][0].as_py())
        return rows.slice(0, 1).set_column(4, "data", pa.array([_pack(total)], pa.binary())).cast(rows.schema)

    salted = chunks.withColumn("salt", F.pmod("salt", F.lit(16)))
    return salted.groupBy("k", "a", "salt").applyInArrow(add, CHUNK).withColumn("salt", F.lit(0)).groupBy("k", "a").applyInArrow(add, CHUNK)


def _logits(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """A slot's level and its logit, in sixteenths, as one number."""
    n = zeros + ones
    level = (n > 0).astype(np.uint16) + (n > 3) + (n > 30) + (n > 300)
    logit = np.rint(np.clip(np.log((ones + 0.4) / (zeros + 0.4)), -7.9, 7.9) * 16).astype(np.int64) + 128
    return (level.astype(np.uint16) << np.uint16(8)) | logit.astype(np.uint16)


def _collected(chunks: DataFrame, finish: Callable[[int, int, np.ndarray], bytes]) -> Iterator[tuple[int, int, bytes]]:
    """k, a and what ``finish`` makes of each chunk, on the driver: tables of a bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, a, cells, data in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "a": pa.array([a], pa.int32()), "data": pa.array([finish(k, a, _unpack(data, cells))], pa.binary())})

    for r in _summed(chunks).mapInArrow(run, "k int, a int, data binary").collect():
        yield r.k, r.a, bytes(r.data)


EMPTY = int(_logits(np.zeros(1), np.zeros(1))[0])


def _hashed_tables(chunks: DataFrame, bits: tuple[int, ...]) -> list[np.ndarray]:
    out = [np.full(1 << b, EMPTY, np.uint16) for b in bits]
    for k, a, data in _collected(chunks, lambda k, a, x: _logits(x[0::2], x[1::2]).tobytes()):
        part = np.frombuffer(data, np.uint16)
        out[k][a * CELLS // 2 : a * CELLS // 2 + len(part)] = part
    return out


VALUE = ((np.arange(LEVELS * 256) % 256 - 128) / 16).astype(np.float32)


class Tables:
    """Of the word before: a hashed table. Of the last common word: its values at all nodes."""

    def __init__(self, code: Code, bits: int) -> None:
        self.before, self.bits = np.full(1 << bits, EMPTY, np.uint16), bits
        self.common = np.full((code.common + 1, code.escape), EMPTY, np.uint16)


def _context_tables(docs: DataFrame, code, bits: int) -> Tables:
    """Of all training documents."""
    leaves = code.value.escape + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c: Code = code.value
        before, pairs = np.zeros(2 << bits, np.uint32), np.zeros((c.common + 1) * leaves, np.uint32)
        for batch in batches:
            train = batch.column(1).filter(pc.invert(batch.column(2)))
            for a, n in slices(train, SLICE):
                w = Words(train.slice(a, n))
                leaf, hashed, common = contexts(c, w)
                np.add.at(pairs, common * leaves + leaf, _U32(1))
                token, step = c.steps(leaf)
                at = _slot(hashed.take(token), c.hashes.take(step), bits)
                at += at
                at += c.bits.take(step)
                np.add.at(before, at, _U32(1))
                del token, step, at
        before[:2] = 0  # the first slot stays empty
        yield from _chunks([before, pairs], [CELLS, leaves], TaskContext.get().partitionId())
        del before, pairs
        give_back()

    def finish(k: int, a: int, x: np.ndarray) -> bytes:
        if k == 0:
            return _logits(x[0::2], x[1::2]).tobytes()
        return _logits(*code.value.split(x)).tobytes()

    out = Tables(code.value, bits)
    for k, a, data in _collected(docs.mapInArrow(count, CHUNK), finish):
        part = np.frombuffer(data, np.uint16)
        if k == 0:
            out.before[a * CELLS // 2 : a * CELLS // 2 + len(part)] = part
        else:
            out.common[a] = part
    return out


def first_weights() -> np.ndarray:
    """By gate (level of the word before, level of the last common word) and input: the node
    alone, with the word before, with the last common word."""
    w = np.empty((LEVELS, LEVELS, 3), np.float32)
    w[:, :, 0] = [0.8, 0.5, 0.3, 0.2, 0.15]
    w[:, :, 1] = [[0.0], [0.25], [0.35], [0.4], [0.45]]
    w[:, :, 2] = [0.0, 0.3, 0.45, 0.5, 0.5]
    return w.reshape(-1, 3)


def mix(code: Code, tables: Tables, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of the coded bits of each text, and the leaf of each token."""
    texts = len(w.first) - 1
    leaf, hashed, common = contexts(code, w)
    sizes, owner = np.diff(w.first), w.owner()
    total = np.zeros(texts)
    row, flat = common.astype(np.int64) * tables.common.shape[1], tables.common.ravel()
    gates = LEVELS * LEVELS
    weights = [np.tile(x, texts) for x in first_weights().T]
    squares = [np.full(texts * gates, 0.1) for _ in weights]
    refined = np.tile((1 / (1 + np.exp(-np.linspace(-8, 8, BUCKETS)))).astype(np.float32), texts)

    def block(some: np.ndarray, a: int, b: int) -> None:
        n = np.minimum(sizes[some], b) - a
        at = np.arange(int(n.sum())) + np.repeat(w.first[some] + a - (np.cumsum(n) - n), n)
        token, step = code.steps(leaf.take(at))
        if not len(token):
            return
        at, node = at.take(token), code.nodes.take(step)
        before = tables.before.take(_slot(hashed.take(at), code.hashes.take(step), tables.bits))
        last = flat.take(row.take(at) + node)
        x = [code.logit.take(node), VALUE.take(before), VALUE.take(last)]
        text, ones = owner.take(at), code.bits.take(step).astype(np.float32)
        gate = text * gates
        gate += (before >> np.uint16(8)) * np.uint16(LEVELS) + (last >> np.uint16(8))
        del token, step, node, at, before, last
        z = weights[0].take(gate) * x[0]
        for v, y in zip(weights[1:], x[1:], strict=True):
            z += v.take(gate) * y
        np.clip(z, -8, 8, out=z)
        p = 1 / (1 + np.exp(-z))
        cell = text * BUCKETS
        cell += np.rint((z + 8) * np.float32((BUCKETS - 1) / 16)).astype(np.intp)
        right = 1 - np.abs(ones - (p + refined.take(cell)) * np.float32(0.5))
        total[:] += np.bincount(text, np.log(right), texts)
        # only texts that go on have something to learn for
        more = np.flatnonzero((sizes > b).take(text))
        gate, cell, ones = gate.take(more), cell.take(more), ones.take(more)
        err = ones - p.take(more)
        for v, y, q in zip(weights, x, squares, strict=True):
            g = np.bincount(gate, err * y.take(more), len(v))
            q += g * g
            v += (RATE * g / np.sqrt(q)).astype(np.float32)
        hits = np.bincount(cell, minlength=len(refined))
        mean = np.bincount(cell, ones, len(refined)) / np.maximum(hits, 1)
        refined[:] += np.where(hits > 0, (mean - refined) * (1 - np.exp(-MAP_RATE * hits)), 0).astype(np.float32)
        np.clip(refined, 1e-4, 1 - 1e-4, out=refined)

    a, b = 0, BLOCK
    live = np.arange(texts)
    while len(live := live[sizes[live] > a]):
        ends = np.cumsum(np.minimum(sizes[live], b) - a)
        i = done = 0
        while i < len(live):  # whole texts at a time, of about PART tokens
            j = max(i + 1, int(np.searchsorted(ends, done + PART, "right")))
            some, i, done = live[i:j], j, int(ends[j - 1])
            block(some, a, b)
        a, b = b, 2 * b
    return total / np.log(10), leaf


# new words ------------------------------------------------------------------------------

#: Bytes before that a context of the speller holds, and log2 of the most slots of its table.
ORDERS, SPELL_BITS = (1, 2, 3, 4, 6), (16, 19, 21, 21, 21)
#: The speller's weights, by the level of its longest context and by context.
SPELL_WEIGHTS = np.array([[0.10, 0.30, 0.48, 0.42, 0.0], [0.05, 0.24, 0.46, 0.48, 0.0], [0.05, 0.20, 0.36, 0.52, 0.05], [0.05, 0.20, 0.35, 0.50, 0.12], [0.05, 0.15, 0.25, 0.40, 0.42]])


def _spelled(words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Of the words, a blank after each: the word of every bit, the hashes of every byte's
    contexts, and by byte and bit the hash of the byte so far and the bit."""
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    sizes = np.array([len(w) + 1 for w in words])
    place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    h, out = np.full(len(data), 17, _U32), []
    for k in range(1, max(ORDERS) + 1):
        before = np.zeros(len(data), _U32)
        before[k:] = data[:-k]
        before[place < k] = 0
        h = _hash(h ^ before, k)
        if k in ORDERS:
            out.append(h)
    shifts = np.arange(7, -1, -1).astype(_U32)
    wide = data.astype(_U32)[:, None]
    so_far = (wide | _U32(256)) >> (shifts + _U32(1))
    return np.repeat(np.arange(len(words)), 8 * sizes), out, _hash(so_far, 9), ((wide >> shifts) & _U32(1)).astype(np.intp)


def _spell_tables(words: DataFrame, bits: tuple[int, ...]) -> list[np.ndarray]:
    """Of all distinct training words, each counted once: new words are like words, not like text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tables = [np.zeros(2 << b, np.uint32) for b in bits]
        for batch in batches:
            for a, n in slices(batch.column(0), 64 << 10):
                _, hashed, node, bit = _spelled(batch.column(0).slice(a, n).to_pylist())
                for t, h, b in zip(tables, hashed, bits, strict=True):
                    np.add.at(t, (2 * _slots(h, node, b) + bit).ravel(), _U32(1))
        yield from _chunks(tables, [CELLS] * len(tables), TaskContext.get().partitionId())
        del tables
        give_back()

    return _hashed_tables(words.select("word").mapInArrow(count, CHUNK), bits)


def spell(tables: list[np.ndarray], words: list[bytes]) -> np.ndarray:
    """log10 probability of the bytes of each word."""
    if not words:
        return np.zeros(0)
    owner, hashed, node, bit = _spelled(words)
    values = [t.take(_slots(h, node, len(t).bit_length() - 1)).ravel() for t, h in zip(tables, hashed, strict=True)]
    level = values[-1] >> np.uint16(8)
    z = np.zeros(bit.size)
    for k, v in enumerate(values):
        z += SPELL_WEIGHTS[:, k].take(level) * VALUE.take(v)
    z = np.clip(np.where(bit.ravel() == 1, z, -z), -12, 12)
    return np.bincount(owner, -np.log1p(np.exp(-z)), len(words)) / np.log(10)


def _tails(rare: DataFrame, tables, rare_tokens: int, new: float) -> DataFrame:
    """word, c, tail: log10 of a rare word's probability after the escape leaf. ``new``: the
    probability that it is new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n in slices(batch.column(0), 64 << 10):
                part = batch.slice(a, n)
                c = part.column(1).to_numpy()
                tail = np.log10(np.maximum(c, 1) * ((1 - new) / max(rare_tokens, 1)) if new < 1 else np.ones(n))
                fresh = np.flatnonzero(c == 0)
                tail[fresh] = np.log10(new) + spell(tables.value, part.column(0).take(pa.array(fresh)).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(tail)], ["word", "c", "tail"])

    return rare.select("word", "c").mapInArrow(run, "word binary, c long, tail double")


def _fit_bits(most: tuple[int, ...], slots: int) -> tuple[int, ...]:
    """log2 of the slots of tables for so many contexts, and not more than ``most``."""
    return tuple(min(k, max(16, int(slots).bit_length())) for k in most)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    The model learns from rows where ``held_out`` is not true. A null text is empty: its only
    token is the end. Rows come back as often as they came, also with null ids; other columns
    are not read. An empty table gives an empty one; without training documents all counts
    are zero."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = materialise(_word_counts(base), "word-counts")
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.count(F.when(F.col("c") == 1, 1)).alias("once")).first()
    total, vocab, once = sums["n"] or 0, sums["v"] or 0, max(sums["once"] or 0, 1)
    # the least count that at most HOT_WORDS words reach
    by_count = counts.where("c > 0").groupBy("c").count().orderBy(F.desc("c")).limit(HOT_WORDS).collect()
    least, words = None, 0
    for r in by_count:
        words += r["count"]
        if words > HOT_WORDS:
            break
        least = r["c"]
    hot = sorted(((r.c, bytes(r.word)) for r in counts.where(F.col("c") >= least).collect()), key=lambda x: (-x[0], x[1])) if least else []
    rare_tokens = total - sum(c for c, _ in hot)
    code = spark.sparkContext.broadcast(Code([w for _, w in hot], [c for c, _ in hot], rare_tokens + once))
    tables = spark.sparkContext.broadcast(_context_tables(base, code, _fit_bits((TABLE_BITS,), 2 * total)[0]))
    spelling = spark.sparkContext.broadcast(_spell_tables(counts.where("c > 0"), _fit_bits(SPELL_BITS, 16 * vocab)))
    new = once / (rare_tokens + once)
    rare = counts if least is None else counts.where(F.col("c") < least)
    tails = materialise(_tails(rare, spelling, rare_tokens, new), "word-tails")
    smooth = total + 0.5 * (vocab + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        c = code.value
        base_of = np.log10((c.counts + 0.5) / smooth)
        base_of[c.escape] = 0.0
        for batch in batches:
            for a, n in slices(batch.column(1), SLICE):
                w = Words(batch.column(1).slice(a, n))
                score, leaf = mix(c, tables.value, w)
                owner, size = w.owner(), w.sizes[w.codes]
                sum_of = lambda x: np.bincount(owner, x, n)
                own = [batch.column(0).slice(a, n), batch.column(2).slice(a, n), *(pa.array(x) for x in (np.diff(w.first), sum_of(leaf != c.escape).astype(np.int64), sum_of(base_of[leaf]), score, sum_of(size).astype(np.int64)))]
                # words whose counts have to be fetched; no word holds a blank, so a document's own key meets none
                wide = len(w.distinct) + 1
                escaped = leaf == c.escape
                pairs, times = np.unique(owner[escaped] * wide + w.codes[escaped] % wide, return_counts=True)
                word = pa.array([*w.distinct, END], pa.binary()).take(pa.array(pairs % wide))
                keys = pa.array([b" %d" % (row + i) for i in range(n)], pa.binary())
                numbers = pa.array(np.concatenate([row + pairs // wide, row + np.arange(n)]))
                empty = lambda x: pa.concat_arrays([pa.nulls(len(pairs), x.type), x])
                del w, leaf, owner, size
                yield pa.RecordBatch.from_arrays([numbers, pa.concat_arrays([word, keys]), pa.concat_arrays([pa.array(times), pa.nulls(n, pa.int64())]), *map(empty, own)], ["row", "word", "times", *DOC])
                row += n
        give_back()

    rows = base.mapInArrow(run, "row long, word binary, times long, doc_id long, held_out boolean, n_tokens long, known long, base double, p double, size long")
    met = rows.join(tails, "word", "left")
    seen = F.when(F.col("c") > 0, F.col("times"))
    per = met.groupBy("row").agg(
        *(F.max(x).alias(x) for x in ("doc_id", "held_out", "n_tokens", "size")),
        F.sum(F.coalesce("known", seen, F.lit(0))).alias("n_known"),
        F.sum(F.coalesce("base", F.col("times") * F.log10((F.col("c") + 0.5) / F.lit(smooth)))).alias("base_score"),
        F.sum(F.coalesce("p", F.col("times") * F.col("tail"))).alias("score"),
    )
    bits = -F.col("score") / F.log10(F.lit(2.0)) / F.col("size")
    return per.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))


DOC = ["doc_id", "held_out", "n_tokens", "known", "base", "p", "size"]
