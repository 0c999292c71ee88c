"""Operator 1, toxicity: Levenshtein automata intersected with a lexicon trie.

The lexicon is learned from labelled documents: word beginnings that are far commoner
in toxic documents, followed down the trie of beginnings to a whole word, or to a stem
where the words that follow differ (inflected terms). The Levenshtein automata of all
words of a text run against the trie at once, as one automaton that is made
deterministic while it is used: a state is a set of (trie node, edits so far), and a
word costs one look-up a character until no entry can match. How many edits an entry
allows grows with its length.

A hit's window says whether it is abuse or quotation: hits inside quotation marks or
a few words after a word of report, or before one in the same sentence, count apart. Counts (as square roots, from four on alike) of exact, misspelled, stem and quoted hits,
and their density, go into a logistic score, fitted to the labelled documents around
given prior weights, so that kinds of hits that labels never show keep their weight.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHES, mapped, materialise
from .decontaminate import shingle_hashes, words
from .labelled import sample

#: Labelled documents used at most; least and greatest length of a beginning. A longer word
#: hangs, whole, below its longest beginning.
SAMPLE, SHORTEST, LONGEST = 12_000, 3, 14
#: Least toxic documents of an entry, as a number and as a share, and least log-odds.
LEAST, SHARE, ODDS = 5, 0.02, 3.0
#: States of the automaton and words remembered at most, by each worker.
STATES, WORDS = 50_000, 400_000
WINDOW = 4

_WORD = re.compile(r"\w+")
_SENTENCE_END = re.compile(r"[.!?\n]")
_LEET = str.maketrans("013457", "oieast")
_QUOTES = re.compile("\"[^\"\n]+\"|“[^”\n]+”|«[^»\n]+»|„[^“”\n]+[“”]")
#: Words that report what someone said.
_REPORT = frozenset("said says say quote quoted quotes wrote word term called reported dit écrit mot terme sagte schrieb wort dijo escribió palabra".split())


def _beginnings(text: str) -> set[str]:
    out = set()
    for w in set(_WORD.findall(text.lower())):
        out.update(w[:k] for k in range(SHORTEST, min(len(w), LONGEST) + 1))
        out.add(w + "$")
    return out


def _parent(b: str) -> str:
    """The beginning that a beginning, or a whole word (it ends with ``$``), hangs below."""
    return b[:-1][:LONGEST] if b.endswith("$") else b[:-1]


def without_copies(rows: DataFrame) -> DataFrame:
    """One of the rows whose texts share a label and the least hash of their five-word
    shingles: the words of a text that was copied often must not pass for toxic terms."""
    w = rows.select("label", "text", words(F.col("text")).alias("w"), F.monotonically_increasing_id().alias("row"))
    least = F.coalesce(F.array_min(shingle_hashes(F.col("w"), 5)), F.xxhash64("text"))
    return materialise(w.withColumn("least", least).dropDuplicates(["label", "least"]).select("label", "text"), "labelled")


def learn_lexicon(rows: DataFrame) -> list[tuple[str, bool]]:
    """(entry, is a stem) from rows of label and text."""
    totals = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    p, n = totals.get(1, 0), totals.get(0, 0)
    if not p or not n:
        return []

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 200):
                c: Counter[str] = Counter()
                for t in pdf["text"].iloc[a : a + 200]:
                    c.update(_beginnings(t))
                if c:
                    yield pd.DataFrame({"b": list(c.keys()), "n": list(c.values())})

    toxic = rows.where("label = 1").mapInPandas(explode, "b string, n long").groupBy("b").agg(F.sum("n").alias("n"))
    pos = {r.b: r.n for r in toxic.where(F.col("n") >= max(LEAST, p * SHARE)).collect()}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter[str] = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                c.update(_beginnings(t) & pos.keys())
        if c:
            yield pd.DataFrame({"b": list(c.keys()), "n": list(c.values())})

    neg = {r.b: r.n for r in rows.where("label = 0").mapInPandas(count, "b string, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()}
    odds = {b: np.log((k + 0.5) / (p + 1)) - np.log((neg.get(b, 0) + 0.5) / (n + 1)) for b, k in pos.items()}
    good = {b for b, x in odds.items() if x >= ODDS}
    below: dict[str, list[str]] = {}
    for b in good:
        below.setdefault(_parent(b), []).append(b)
    entries: list[tuple[str, bool]] = []

    def follow(b: str) -> None:
        if b.endswith("$"):
            entries.append((b[:-1], False))
            return
        down = sorted(below.get(b, []), key=pos.get, reverse=True)
        if down and pos[down[0]] >= 0.9 * pos[b]:
            follow(down[0])
        elif down and sum(pos[d] for d in down[:3]) >= 0.9 * pos[b] and pos[down[0]] < pos[b] * 0.9 and len(down) <= 3:
            for d in down:
                follow(d)
        else:
            entries.append((b, True))

    for b in sorted(good):
        if _parent(b) not in good:
            follow(b)
    entries.sort(key=lambda e: (-odds.get(e[0] + "$", odds.get(e[0], 0)), e))
    return entries


class Matcher:
    """The automaton. ``match`` gives (edits, is a stem) of a word's best entry, or None."""

    def __init__(self, entries: list[tuple[str, bool]], friends: frozenset[str] = frozenset()) -> None:
        self.friends = friends  # clean words that are near an entry
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, bool]]] = [[]]  # (edits allowed, stem)
        self.edits = [0]  # most edits that an entry below allows
        for word, stem in entries:
            # short entries are near too many words
            allowed = 0 if len(word) < (6 if stem else 5) else 1 if len(word) < 8 or stem else 2
            node = 0
            path = [0]
            for c in word:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.edits.append(0)
                node = nxt
                path.append(node)
            self.ends[node].append((allowed, stem))
            for x in path:
                self.edits[x] = max(self.edits[x], allowed)
        self._reset()

    def _reset(self) -> None:
        self.sets: list[frozenset] = []
        self.ids: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.start = self._state({(0, 0)}, None)
        self.known: dict[str, tuple[int, bool] | None] = {}

    def _state(self, items: set, stem: int | None) -> int:
        todo = list(items)
        least: dict[int, int] = {}
        while todo:
            node, e = todo.pop()
            if e > self.edits[node] or least.get(node, 9) <= e:
                continue
            least[node] = e
            todo += [(x, e + 1) for x in self.children[node].values()]  # a character left out
        for node, e in least.items():
            for allowed, is_stem in self.ends[node]:
                if is_stem and e <= allowed and (stem is None or e < stem):
                    stem = e
        key = frozenset(least.items()) | ({("stem", stem)} if stem is not None else frozenset())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
        return self.ids[key]

    def _step(self, s: int, c: str) -> int:
        items, stem = set(), None
        for node, e in self.sets[s]:
            if node == "stem":
                stem = e
                continue
            items.add((node, e + 1))  # a character too many
            for d, x in self.children[node].items():
                items.add((x, e if d == c else e + 1))
        got = self.steps[s][c] = self._state(items, stem)
        return got

    def match(self, word: str) -> tuple[int, bool] | None:
        if word in self.known:
            return self.known[word]
        if len(self.known) > WORDS:
            self.known.clear()
        if len(self.sets) > STATES:
            self._reset()
        s = self.start
        for c in word:
            nxt = self.steps[s].get(c)
            s = self._step(s, c) if nxt is None else nxt
            if not self.sets[s]:
                break
        best = None
        for node, e in self.sets[s]:
            if node == "stem":
                best = min(best or (9, True), (e, True))
            else:
                for allowed, stem in self.ends[node]:
                    if e <= allowed:
                        best = min(best or (9, True), (e, stem))
        if best is None and any(x.isdigit() for x in word):
            plain = word.translate(_LEET)
            if plain != word and not plain.isdigit():
                best = self.match(plain)
        if best and best[0] and word in self.friends:
            best = None
        self.known[word] = best
        return best


_matchers: dict[tuple, Matcher] = {}
CACHES.append(_matchers)


def matcher_of(entries: list[tuple[str, bool]], friends: frozenset[str] = frozenset()) -> Matcher:
    """The worker's matcher of a lexicon; it lives as long as the worker."""
    key = (tuple(entries), friends)
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(entries, friends)
    return _matchers[key]


#: Prior weights: bias, exact, one edit, two edits, stem, quoted, density of hits.
PRIOR = np.array([-3.0, 4.5, 4.0, 2.5, 4.0, 0.7, 1.0])


def hits(text: str, matcher: Matcher) -> list[tuple[int, int, int, bool, bool]]:
    """(start, end, edits, is a stem, is quoted) of each hit."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    match = matcher.match
    if not any(match(w) for w in set(_WORD.findall(low))):
        return []
    spans = [m.span() for m in _QUOTES.finditer(low)]
    found = list(_WORD.finditer(low))
    out = []
    for i, m in enumerate(found):
        got = match(m.group())
        if got:
            near = {x.group() for x in found[max(0, i - WINDOW) : i]}
            rest = found[i + 1 : i + 1 + WINDOW]
            end = _SENTENCE_END.search(low, m.end(), rest[-1].start()) if rest else None
            near |= {x.group() for x in rest if end is None or x.start() < end.start()}
            quoted = any(a <= m.start() and m.end() <= b for a, b in spans) or bool(near & _REPORT)
            out.append((m.start(), m.end(), got[0], got[1], quoted))
    return out


def measures(text: str, matcher: Matcher) -> list[float]:
    found = hits(text, matcher)
    if not found:
        return [1.0, 0, 0, 0, 0, 0, 0]
    count = lambda f: min(sum(map(f, found)), 4) ** 0.5
    return [
        1.0,
        count(lambda h: not h[4] and not h[3] and h[2] == 0),
        count(lambda h: not h[4] and not h[3] and h[2] == 1),
        count(lambda h: not h[4] and not h[3] and h[2] == 2),
        count(lambda h: not h[4] and h[3]),
        count(lambda h: h[4]),
        min(1.0, 20 * len(found) / (1 + len(text) / 6)),
    ]


def fit(x: np.ndarray, y: np.ndarray, pull: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Logistic weights by Newton's method, drawn to PRIOR with strength ``pull``."""
    w = PRIOR.copy()
    if not len(x):
        return w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pull * (w - PRIOR)
        h = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(h, g)
        step *= min(1.0, 1.0 / np.abs(step).max()) if step.any() else 1.0  # far from the optimum a full step overshoots
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, use: Column, label: str = "toxic", most: int = SAMPLE) -> tuple[list[tuple[str, bool]], np.ndarray, frozenset[str]]:
    """Lexicon, weights, and the words of clean documents that are near an entry without being
    one (they are no misspellings; all come from the bounded sample). ``use`` says, over k (the id) and label, what may be learned from."""
    rows = without_copies(sample(docs, labels, label, use, most))
    entries = learn_lexicon(rows)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = matcher_of(entries)
        for pdf in batches:
            found = {w for t in pdf["text"] for w in set(_WORD.findall(t.lower())) if (m := matcher.match(w)) and m[0]}
            if found:
                yield pd.DataFrame({"w": sorted(found)})

    clean = rows.where("label = 0").mapInPandas(near, "w string").distinct()
    friends = frozenset(r.w for r in clean.collect())

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = matcher_of(entries, friends)
        for pdf in batches:
            yield pd.DataFrame({"label": pdf["label"], "x": [measures(t, matcher) for t in pdf["text"]]})

    got = rows.mapInPandas(measure, "label int, x array<double>").collect()  # at most ``most`` rows
    return entries, fit(np.array([r.x for r in got]), np.array([r.label for r in got], float)), friends


def score(docs: DataFrame, model: tuple[list[tuple[str, bool]], np.ndarray, frozenset[str]], keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep``, score (0 to 1) and hits (whether a term was met) of each
    whole text; null texts are empty, and a text without hits has the score of the bias. Rows
    come back as often as they came, an empty table gives an empty one, and other columns are
    not read."""
    # lexicon and near words come from a bounded sample of documents
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(columns: list[pa.Array]) -> list[pa.Array]:
        entries, weights, friends = shared.value
        matcher = matcher_of(entries, friends)
        x = np.array([measures(t, matcher) for t in columns[0].to_pylist()]).reshape(-1, len(PRIOR))
        z = np.clip((x * weights).sum(axis=1), -30, 30)
        return [pa.array(1 / (1 + np.exp(-z))), pa.array(x[:, 1:6].sum(axis=1) > 0)]

    return mapped(docs, keep, [F.coalesce(F.col(text_col), F.lit(""))], apply, "score double, hits boolean")
