"""Toxicity of whole texts from a learned lexicon, matched with misspellings and in context.

The lexicon's trie is intersected with Levenshtein automata: a state is the set of (trie node, edits
spent) pairs that a word's letters so far can reach, and transitions are worked out when first
met. A match then counts by its surroundings: between quotation marks or after a word of
reporting it counts less, close to another match more.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendero.llm.tables import if_small, written
from tendero.llm.words import slices

#: Labelled rows of each class that the classifier is fitted on, at most; the lexicon is counted in all of them.
FIT_ROWS = 6000
MAX_TERMS = 2000
#: Share of the lexicon's terms that may be there by chance, as expected.
FALSE_SHARE = 0.1
WORD_ODDS, STEM_ODDS = 2.5, 3.5
#: Letters from which a term may be misspelled by one edit.
FUZZY_LENGTH = 5
WINDOW = 5
REMEMBERED = 100_000

PUNCTUATION = ".,;:!?\"'()[]{}«»„“”‚‘’…*_-–—"
_OPEN, _CLOSE = "\"'«„“‚‘»", "\"'»“”‘’«"


def _letters() -> list[tuple[int, int]]:
    """Ranges of the characters that are letters, digits or marks."""
    ranges: list[tuple[int, int]] = []
    for code in range(sys.maxunicode + 1):
        if unicodedata.category(chr(code))[0] in "LNM":
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1] = (ranges[-1][0], code)
            else:
                ranges.append((code, code))
    return ranges


_LETTERS = _letters()
#: Runs of other characters cut words, in learning and in matching alike. Java takes one character at a time and
#: tells the common ones apart first, as it tries the ranges one by one.
CUT_JAVA = (r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]|(?![\x00-\x7F\xC0-\xD6\xD8-\xF6\xF8-\x{17F}])[^"
            + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in _LETTERS) + "]")
CUT = re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _LETTERS) + "]+")

#: Words that report what others say, in the corpus languages.
REPORTING = frozenset((
    "said", "says", "called", "wrote", "writes", "quoted", "quote", "word", "term", "meaning",
    "dijo", "dice", "llamó", "escribió", "palabra", "dit", "écrit", "appelé", "mot",
    "sagte", "sagt", "nannte", "schrieb", "wort"))


class Matcher:
    """Words against a lexicon: ``terms`` as a whole with one edit if long, ``stems`` as beginnings."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.next: list[dict[str, int]] = [{}]
        self.term: list[tuple[str, float] | None] = [None]
        self.stem: list[tuple[str, float] | None] = [None]
        self.fuzzy: list[bool] = [False]  # some term below may be misspelled
        for text, weight in terms.items():
            self.term[self._insert(text, len(text) >= FUZZY_LENGTH)] = (text, weight)
        for text, weight in stems.items():
            self.stem[self._insert(text, False)] = (text, weight)
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[str, float, int] | None] = []
        self.done: list[tuple[str, float, int] | None] = []
        self.start = self._state({(0, 0)})

    def _insert(self, text: str, fuzzy: bool) -> int:
        node = 0
        self.fuzzy[0] |= fuzzy
        for letter in text:
            if letter not in self.next[node]:
                self.next[node][letter] = len(self.next)
                self.next.append({})
                self.term.append(None)
                self.stem.append(None)
                self.fuzzy.append(False)
            node = self.next[node][letter]
            self.fuzzy[node] |= fuzzy
        return node

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """The number of a set of pairs, with all that a letter left out of the word reaches."""
        full = set(pairs)
        for node, edits in pairs:
            if not edits:
                full.update((child, 1) for child in self.next[node].values() if self.fuzzy[child])
        key = frozenset(full)
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.moves.append({})
            ends = [(*self.term[n], e) for n, e in key if self.term[n] and (not e or len(self.term[n][0]) >= FUZZY_LENGTH)]
            begun = [(*self.stem[n], 0) for n, e in key if self.stem[n] and not e]
            self.found.append(min(ends, key=lambda x: (x[2], -x[1], x[0]), default=None))
            self.done.append(max(begun, key=lambda x: (x[1], x[0]), default=None))
        return self.states[key]

    def _move(self, state: int, letter: str) -> int:
        reached = set()
        for node, edits in self.members[state]:
            child = self.next[node].get(letter)
            if child is not None and (not edits or self.fuzzy[child]):
                reached.add((child, edits))
            if not edits and self.fuzzy[node]:
                reached.add((node, 1))  # a letter too many
                reached.update((other, 1) for other in self.next[node].values() if self.fuzzy[other])  # another letter
        self.moves[state][letter] = to = self._state(reached) if reached else -1
        return to

    def match(self, word: str) -> tuple[str, float, int] | None:
        """The term, its weight and the edits between, or None."""
        state = self.start
        moves, done = self.moves, self.done
        for letter in word:
            to = moves[state].get(letter)
            state = self._move(state, letter) if to is None else to
            if state < 0:
                return None
            if done[state]:
                return done[state]
        return self.found[state]


@dataclass
class Model:
    terms: dict[str, float]
    stems: dict[str, float]
    weights: list[float]
    known: dict = field(default_factory=dict)
    matcher: Matcher | None = None

    def matches(self, text: str | None) -> tuple[list[tuple[int, tuple[str, float, int]]], list[str]]:
        """Place and match of every word that matches, and all words.

        A word between spaces is cut like those of the lexicon; if no piece matches it is tried as a whole, so that
        a sign in place of a letter is one edit.
        """
        if self.matcher is None:
            self.matcher = Matcher(self.terms, self.stems)
        words, known, matcher = (text or "").lower().split(), self.known, self.matcher
        hits = {}
        for word in set(words):
            if word in known:
                found = known[word]
            else:
                pieces = [p for p in CUT.split(word) if p]
                found = [m for m in map(matcher.match, pieces) if m]
                if not found and len(pieces) > 1:
                    inner = word[word.index(pieces[0]):word.rindex(pieces[-1]) + len(pieces[-1])]
                    found = [m for m in [matcher.match(inner)] if m]
                if len(known) < REMEMBERED:
                    known[word] = found
            if found:
                hits[word] = found
        return ([(i, m) for i, w in enumerate(words) for m in hits.get(w, ())] if hits else []), words

    def features(self, text: str | None) -> np.ndarray:
        """Of a whole text: matches as spelled and misspelled, by context, their share, and the heaviest."""
        found, words = self.matches(text)
        if not found:
            return np.zeros(FEATURES)
        exact = fuzzy = 0.0
        places = [i for i, _ in found]
        for n, (at, (_, weight, edits)) in enumerate(found):
            value = weight * context(words, at, n and at - places[n - 1] <= WINDOW or n + 1 < len(places) and places[n + 1] - at <= WINDOW)
            if edits:
                fuzzy += value
            else:
                exact += value
        return np.array([math.log1p(exact), math.log1p(fuzzy), math.log1p(100 * (exact + fuzzy) / len(words)), math.log1p(max(m[1] for _, m in found if not m[2]) if any(not m[2] for _, m in found) else 0.0)])

    def score(self, text: str | None) -> float:
        z = self.weights[-1] + float(np.dot(self.weights[:-1], self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


FEATURES = 4


def context(words: list[str], at: int, crowded: bool) -> float:
    """How much a match counts: quotation and reporting lower it, another match nearby raises it."""
    value = 1.25 if crowded else 1.0
    before, after = words[max(0, at - WINDOW):at + 1], words[at:at + WINDOW + 1]
    if any(w[0] in _OPEN for w in before) and any(w.rstrip(".,;:!?")[-1:] in _CLOSE and w.rstrip(".,;:!?") for w in after):
        value *= 0.25
    if any(w.strip(PUNCTUATION) in REPORTING for w in before[:-1]):
        value *= 0.5
    return value


def misspelled(text: str, model: Model) -> str:
    """The text with one letter changed in each matching term that may be misspelled; for training."""
    found, words = model.matches(text)
    for at, (term, _, edits) in found:
        if not edits and len(term) >= FUZZY_LENGTH and term in model.terms:
            cut = 1 + (at + len(term)) % (len(term) - 2)
            words[at] = term[:cut] + "#" + term[cut + 1:] if at % 2 else term[:cut] + term[cut + 1:]
    return " ".join(words)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights and intercept by Newton steps, both classes counting alike."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + ridge / 10 * w
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + ridge / 10 * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return w


def training_rows(docs: DataFrame, labels: DataFrame, rows: int | None = None) -> DataFrame:
    """``doc_id, text, toxic`` of labelled rows that are not held out: all, or ``rows`` of each class at most, in an order by hash."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if rows is None:
        chosen = if_small(known, 16)
    else:
        by_hash = lambda toxic: known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = F.broadcast(by_hash(1).unionByName(by_hash(0)))  # two times ``rows`` at most
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select("doc_id", "text", "toxic")


def chance(t: int, c: int, toxic: int, clean: int) -> float:
    """Probability that of ``t + c`` rows drawn from all rows ``t`` or more are toxic."""
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    term = math.exp(choose(toxic, t) + choose(clean, c) - choose(toxic + clean, t + c))
    total = 0.0
    while term > total * 1e-9:
        total += term
        if not c or t == toxic:
            break
        term *= (toxic - t) * c / ((t + 1) * (clean - c + 1))
        t, c = t + 1, c - 1
    return min(1.0, total)


def significant(counts: DataFrame, candidates: DataFrame, toxic: int, clean: int) -> DataFrame:
    """The candidates whose rows ``t`` and ``c`` of each class are not by chance, given how many others were counted.

    A level is as high as it can be with ``FALSE_SHARE`` of what it admits expected by chance; only counts that
    could reach the level in toxic rows alone add to what is expected.
    """
    most = 1000  # larger counts reach whatever level this one reaches
    sizes = {r["n"]: r["words"] for r in counts.groupBy(F.least(F.col("t") + F.col("c"), F.lit(most)).alias("n")).agg(F.count("*").alias("words")).collect()}
    least = sorted((chance(min(n, toxic), n - min(n, toxic), toxic, clean), words) for n, words in sizes.items() if n <= toxic + clean)
    pairs = candidates.groupBy("t", "c").agg(F.count("*").alias("words")).collect()  # distinct pairs of counts
    found = sorted((chance(r["t"], r["c"], toxic, clean), r["t"], r["c"], r["words"]) for r in pairs)
    level, admitted = -1.0, 0
    for p, _, _, words in found:
        admitted += words
        if p * sum(w for q, w in least if q <= p) <= FALSE_SHARE * admitted:
            level = p
    kept = [(t, c) for p, t, c, _ in found if p <= level]
    return candidates.join(F.broadcast(candidates.sparkSession.createDataFrame(kept, "t long, c long")), ["t", "c"])


def held_out(doc_id):
    """Whether the row is kept from training; a null id is not, but has no label either."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """Lexicon and classifier; None where a class has no rows or no term tells the classes apart."""
    cut = F.regexp_replace(F.lower("text"), CUT_JAVA, " ")
    every = training_rows(docs, labels)
    words = every.select("toxic", F.explode(F.concat(F.array(F.lit("")), F.array_distinct(F.filter(F.split(cut, " "), lambda w: w != "")))).alias("word"))
    words = written(words.where("word IS NOT NULL").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")), "word-counts")
    totals = words.where("word = ''").first()  # every text has this one
    if not totals or not totals["t"] or not totals["c"]:
        return None
    toxic, clean_ = totals["t"], totals["c"]
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean_ + 1))
    words = words.where("word != ''")
    best = lambda df, name: df.orderBy(F.desc("odds"), name).limit(MAX_TERMS).collect()
    long = words.where(F.length("word") >= 3)
    terms = best(significant(long, long.withColumn("odds", odds).where(F.col("odds") >= WORD_ODDS), toxic, clean_), "word")
    starts = words.select("t", "c", F.explode(F.transform(F.sequence(F.lit(4), F.lit(6)), lambda k: F.when(F.length("word") > k, F.left("word", k)))).alias("stem"))
    starts = starts.where("stem IS NOT NULL").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.max(F.struct("t", "c")).alias("top"))
    # a stem needs evidence besides that of its most frequent word
    starts = starts.withColumn("odds", odds).select(
        "stem", "odds", F.least(F.col("t") - F.col("top.t"), F.lit(toxic)).alias("t"), F.least(F.col("c") - F.col("top.c"), F.lit(clean_)).alias("c"))
    starts = starts.where("t + c > 0")
    starts = best(significant(starts, starts.where(F.col("odds") >= STEM_ODDS), toxic, clean_), "stem")
    stems: dict[str, float] = {}
    for r in sorted(starts, key=lambda r: (len(r["stem"]), r["stem"])):
        if not any(r["stem"].startswith(s) for s in stems):
            stems[r["stem"]] = r["odds"]
    model = Model({r["word"]: r["odds"] for r in terms}, stems, [])
    if not model.terms and not model.stems:
        return None
    rows_ = written(training_rows(docs, labels, rows), "labelled").repartition(16, "doc_id")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, toxic = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.append(model.features(text).tolist())
                toxic.append(label)
                if label:
                    found.append(model.features(misspelled(text or "", model)).tolist())
                    toxic.append(label)
            yield pa.RecordBatch.from_pydict({"x": pa.array(found, pa.list_(pa.float64())), "y": pa.array(toxic, pa.int32())})

    fitted = rows_.select("text", "toxic").mapInArrow(describe, "x array<double>, y int").orderBy("x", "y").collect()  # three times ``rows`` at most
    model.known, model.matcher = {}, None
    model.weights = logistic(np.array([r["x"] for r in fitted]), np.array([r["y"] for r in fitted], float)).tolist()
    return model


def _score(model: Model) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [model.score(text) for text in batch.column("text").to_pylist()]
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(made, pa.float64())], names=[*rest, "score"])

    return score


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, row, held_out, score, predicted`` for each row of ``docs`` (``doc_id``, ``text``).

    ``score`` is from 0 to 1 and uses the text alone, the whole of it; a null or empty text scores as one
    without matches. Without a model every score is 0. Null ids and repeated rows are scored like
    others; ``row`` is a hash of id and text. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), held_out(F.col("doc_id")).alias("held_out"), "text")
    if model is None:
        rows = docs.drop("text").withColumn("score", F.lit(0.0))
    else:
        rows = docs.mapInArrow(_score(model), "doc_id long, row long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` predicted not toxic, all columns as they were."""
    if model is None:
        return docs

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.string()).to_pylist()
            yield batch.filter(pa.array([model.score(text) < 0.5 for text in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
