"""Tokenising whole texts with a tokenizers file, a distinct word at a time.

Both supported files split a text into pre-tokens before any merge, and a blank or a
newline that stands alone between two other characters always starts a pre-token. So the
ids of a text are the ids of its words, one after the other. A batch of texts is cut into
words and these are numbered by their values, in Arrow; only words that the worker has
not met go through the library, and the ids of all texts are gathered in one step. Texts
where that does not hold (two blanks in a row, a blank at either end, other white space,
an added token such as an end mark) are encoded whole, as the library does by default.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import CACHES

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words that a worker remembers; beyond that it keeps those of the texts at hand that it knew.
CACHE_WORDS = 400_000
#: Put before a word that a newline precedes, before the first word of a text, and before
#: signs that close a word (they are pre-tokens of their own after a letter that no file
#: turns into something else than letters).
_LINE, _FIRST, _TAIL = _MARKS = "\x00", "\x01", "\x02"
_CLOSED = r"([A-Za-zÀ-ÖØ-öø-\x{12f}\x{131}-\x{17f}\x{3b1}-\x{3c9}\x{400}-\x{481}\x{4e00}-\x{9fff}])([.,;:!?]+)( |\z)"
_ODD = r"[ \n][ \n]|\A[ \n]|[ \n]\z|[\x00\x01\x02\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_codecs: dict[str, "WordCodec"] = {}
CACHES.append(_codecs)


class WordCodec:
    """Texts to ids as little-endian uint16 or uint32 (``dtype``)."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 65_536 else np.dtype("<u4")
        # a lower-casing file with word ends drops blanks; a byte-level one keeps them as part of the word
        same = lambda a, b: np.array_equal(*self._ids([a, b]))
        self.lower, self.lead = same("Ab", "ab"), "" if same(" a", "a") else " "
        self.line = self._ids(["\n"])[0]
        vocab = self.tokenizer.get_vocab()
        mark = (lambda t: t.startswith("Ġ")) if self.lead else (lambda t: t.endswith("</w>"))
        self.marks = np.zeros(max(vocab.values()) + 1, bool)
        self.marks[[i for t, i in vocab.items() if mark(t)]] = True
        added = "|".join(re.escape(str(t.content)) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content)
        self.odd = f"{_ODD}|(?i:{added})" if added else _ODD
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, self.dtype)
        self.starts = np.zeros((1 << 18) + 1, np.int64)  # of each word's ids, and the end of the last

    def _keep(self, words: list[str], number: np.ndarray) -> None:
        """Forget all words but these, which are numbered anew in this order."""
        flat, starts = self.flat, self.starts
        first, sizes = starts.take(number), np.diff(starts).take(number)
        self._forget()
        done = np.cumsum(sizes) - sizes
        self._add(words, flat.take(np.repeat(first - done, sizes) + np.arange(int(sizes.sum()))), sizes)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str], first: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and sizes of words of letters alone, encoded as one text: each is one pre-token,
        and its first (or last) id is marked as such in the vocabulary. Words without a blank
        before them (``first``) are parted by newlines. None if the marks do not add up."""
        text = "\n".join(words) if first else self.lead + " ".join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        if first:
            at = np.flatnonzero(ids == self.line[0]) if len(self.line) == 1 else None
            if at is None or len(at) != len(words) - 1:
                return None
            return np.delete(ids, at), np.diff(at, prepend=-1, append=len(ids)) - 1
        at = np.flatnonzero(self.marks[ids])
        if len(at) != len(words):
            return None
        return ids, np.diff(at, append=len(ids)) if self.lead else np.diff(at, prepend=-1)

    def _learn(self, new: list[str]) -> None:
        """Add words that are not in the index; letters alone go through the library together."""
        groups: dict[str, list[str]] = {"": [w for w in new if w.isalpha()]}
        alone = []
        for w in new:
            if not w.isalpha():
                mark = w[:1] if w[:1] in _MARKS else ""
                if mark and mark != _TAIL and self.lead and w[1:].isalpha():
                    groups.setdefault(mark, []).append(w)
                else:
                    alone.append(w)
        for mark, words in groups.items():
            for a in range(0, len(words), 512):
                some = words[a : a + 512]
                got = self._joined([w[1:] for w in some] if mark else some, bool(mark))
                if got is None:
                    alone += some
                else:
                    ids, sizes = got
                    if mark == _LINE:
                        ids, sizes = np.insert(ids, np.cumsum(sizes) - sizes, self.line[0]), sizes + 1
                    self._add(some, ids, sizes)
        for a in range(0, len(alone), 4096):
            some = alone[a : a + 4096]
            found = self._ids([w[1:] if w[:1] in _MARKS else self.lead + w for w in some])
            found = [np.concatenate([self.line, x]) if w[:1] == _LINE else x for w, x in zip(some, found, strict=True)]
            self._add(some, np.concatenate(found), np.array([len(x) for x in found]))

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.index)
        at = self.starts[n]
        while at + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        while n + len(words) + 1 > len(self.starts):
            self.starts = np.append(self.starts, np.zeros_like(self.starts))
        self.flat[at : at + len(ids)] = ids
        self.starts[n + 1 : n + 1 + len(words)] = at + np.cumsum(sizes)
        self.index.update(zip(words, range(n, n + len(words)), strict=True))

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's ids begin (and the last
        end). ``end`` is put after each text. Texts must not be null."""
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        odd = np.flatnonzero(pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False))
        plain = texts
        if len(odd):
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            plain = pc.if_else(pa.array(mask), "", texts)
        if self.lower:
            plain = pc.ascii_lower(plain)
        marked = pc.binary_join_element_wise(_FIRST, pc.replace_substring(plain, "\n", " " + _LINE), "")
        marked = pc.replace_substring_regex(marked, _CLOSED, rf"\1 {_TAIL}\2\3")
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        number = np.fromiter(map(self.index.get, distinct, repeat(-1)), np.int64, len(distinct))
        if len(self.index) > CACHE_WORDS:
            met = np.flatnonzero(number >= 0)
            self._keep([distinct[i] for i in met.tolist()], number[met])
            number[met] = np.arange(len(met))
        missing = np.flatnonzero(number < 0).tolist()
        if missing:
            new = [distinct[i] for i in missing]
            self._learn(new)
            number[missing] = np.fromiter(map(self.index.__getitem__, new), np.int64, len(new))
        number = number.take(coded.indices.to_numpy())
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        ends = int(end is not None and not len(odd))  # put in place with the words, or after odd texts are
        starts = self.starts.take(number)
        sizes = np.diff(self.starts).take(number)
        done = np.concatenate([[0], np.cumsum(sizes)])
        bounds = done.take(cuts)
        if ends:
            # each text's words stand by the texts before it further on
            done[:-1] += np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        at = np.repeat(starts - done[:-1], sizes)
        if ends:
            bounds = bounds + np.arange(len(bounds))
            ids = np.full(bounds[-1], end, self.dtype)
            own = np.ones(len(ids), bool)
            own[bounds[1:] - 1] = False
            at += np.flatnonzero(own)
            ids[own] = self.flat.take(at)
            return ids, bounds
        at += np.arange(len(at))
        ids = self.flat.take(at)
        if len(odd):
            parts = np.split(ids, bounds[1:-1])
            for i, data in zip(odd.tolist(), self._ids([texts[int(i)].as_py() for i in odd]), strict=True):
                parts[i] = data
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        if end is not None:
            ids = np.insert(ids, bounds[1:], self.dtype.type(end))
            bounds = bounds + np.arange(len(bounds))
        return ids, bounds


def slices(texts: pa.Array, most: int = 2 << 20) -> list[tuple[int, int]]:
    """(offset, length) of runs of texts of about ``most`` bytes; a longer text is alone."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    out, a, before = [], 0, 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(sizes, before + most, "right")))
        out.append((a, b - a))
        a, before = b, int(sizes[b - 1])
    return out


def codec(path: str) -> WordCodec:
    """The worker's codec for a file; it lives as long as the worker."""
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
    return _codecs[path]
