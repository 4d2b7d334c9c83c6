"""Pseudo-likelihood of documents under a bidirectional window network in numpy.

Every word is predicted from the words on both sides, never from itself. Frequent words are
tokens; the others share hashed buckets. The network gives the token or bucket: every task trains a copy on all of its
documents, from one start; the copies are averaged, weighted by the words they have seen. Inside a bucket a word is told from the others
by its neighbours too: they tell the odds of some classes of context, and every class has shares of its own for the slots of a
bucket, from expected counts over the whole corpus. The classes start as kinds of tokens that the network tells apart. The most frequent
words have slots of their own; rare words share some and have shares of those by count. All words are counted. A document's score is the
sum of the log-probabilities of its words, each given its neighbours. Texts are split into words once and written as numbers. Shares of
the most frequent words go with the tasks; those of all others are joined by word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendero.llm.tables import written
from tendero.llm.words import slices

#: Tokens and buckets for up to ``SMALL`` distinct words; both grow with the fourth root of more.
FREQUENT = 95
BUCKETS = 32
SMALL = 1 << 20
#: Words whose shares go with the tasks, at most.
KNOWN = 1 << 16
HASHES = 1 << 16
#: Words with a slot of their own, at most, and slots that all others share.
OWN = 1 << 16
REST = 1 << 12
#: Classes of context at most, the passes that count what each holds, and the words by which an unseen slot counts as even.
CLASSES = 8
PASSES = 2
EVEN = 1.0
#: Places whose classes are worked out together, and slots whose sums move together.
CHUNK = 1 << 18
BLOCK = 1 << 10
SIDE = 2
HIDDEN = 16
STEP = 4096
RATE = 0.5
STEEP = 60.0
COUNTER_WORDS = 400_000

TOKENS = 1 + FREQUENT + BUCKETS  # 0 stands outside a text; of a network that has not grown
PLACES = [k for k in range(-SIDE, SIDE + 1) if k]


@dataclass
class Classes:
    """Classes of context, with the odds that slots give them and shares of slots in each.

    A slot is one word, or a hash for some words of a bucket; slot 0 stands outside a text. ``slot`` is for lines of a
    vocabulary, ``odds`` the logarithm by which a slot changes a class's probability, ``ratio`` how many times its share of
    its bucket a slot has in a class. Shares of a bucket add up to the same in every class.
    """

    slot: np.ndarray
    prior: np.ndarray
    odds: np.ndarray
    ratio: np.ndarray

    def _chunks(self, line: np.ndarray, own: bool) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Places, their slots and the probabilities of their classes, from both sides and, if asked for, the place itself."""
        for k in range(SIDE, len(line) - SIDE, CHUNK):
            here = slice(k, min(k + CHUNK, len(line) - SIDE))
            slots = self.slot.take(line[here.start - SIDE:here.stop + SIDE])
            odds, n = self.odds.take(slots, axis=0), here.stop - here.start
            found = np.broadcast_to(self.prior, (n, len(self.prior))).copy()
            for place in PLACES + [0] * own:
                found += odds[SIDE + place:SIDE + place + n]
            for a in range(0, n, STEP):  # some that stay near the processor
                few = found[a:a + STEP]
                few -= reduce(np.maximum, few.T)[:, None]
                np.exp(few, out=few)
                few /= (few @ np.ones(few.shape[1], np.float32))[:, None]
            yield here, slots[SIDE:SIDE + n], found

    def log_ratios(self, line: np.ndarray) -> np.ndarray:
        """For every place of a line, the logarithm of how many times its share its slot has between its neighbours."""
        ratios = np.zeros(len(line), np.float32)
        for here, slots, found in self._chunks(line, False):
            ratios[here] = np.log(np.einsum("ij,ij->i", found, self.ratio.take(slots, axis=0)))
        return ratios

    def count(self, line: np.ndarray, sums: np.ndarray) -> None:
        """Add the words of a line to the sums of their slots, dealt over classes."""
        for _, slots, found in self._chunks(line, True):
            for k in range(sums.shape[1]):
                sums[:, k] += np.bincount(slots, found[:, k], len(sums))


@dataclass
class Network:
    """``around``: a table of vectors for each place of the window; ``out`` and ``bias`` give the logits.

    ``token`` and ``share`` are for lines of a vocabulary: the token of each of its values, and the logarithm of
    the value's share of that token, which ``classes`` change by what stands around. Without them a line holds tokens.
    """

    around: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    token: np.ndarray | None = None
    share: np.ndarray | None = None
    classes: Classes | None = None

    @classmethod
    def start(cls, tokens: int = TOKENS) -> Network:
        random = np.random.default_rng(11)
        scale = lambda *shape: (0.1 * random.standard_normal(shape)).astype(np.float32)
        return cls(scale(len(PLACES), tokens, HIDDEN), scale(HIDDEN, tokens), np.zeros(tokens, np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.around.ravel(), self.out.ravel(), self.bias])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        flat = flat.astype(np.float32)
        tokens = len(flat) // (len(PLACES) * HIDDEN + HIDDEN + 1)
        a, b = len(PLACES) * tokens * HIDDEN, HIDDEN * tokens
        return cls(flat[:a].reshape(len(PLACES), tokens, HIDDEN), flat[a:a + b].reshape(HIDDEN, tokens), flat[a + b:])

    def _forward(self, line: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hidden values with a one behind them, what the logits are powers of, the sums of that, and log-probabilities.

        Hidden values lie between -1 and 1, so logits that cannot be large are not brought down before powers are taken.
        """
        hidden = self.around[0].take(line[at + PLACES[0]], axis=0)
        for table, place in zip(self.around[1:], PLACES[1:], strict=True):
            hidden += table.take(line[at + place], axis=0)
        inner = np.ones((len(at), HIDDEN + 1), np.float32)
        np.tanh(hidden, out=inner[:, :HIDDEN])
        out = np.concatenate([self.out, self.bias[None]])
        logits = inner @ out
        if not np.abs(out).sum(axis=0).max() < STEEP:
            logits -= logits.max(axis=1, keepdims=True)
        own = logits.take(np.arange(len(at)) * logits.shape[1] + line[at])
        np.exp(logits, out=logits)
        sums = logits @ np.ones(logits.shape[1], np.float32)
        return inner, logits, sums, own - np.log(sums)

    def log_probabilities(self, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the words or tokens at the given places of a line that has ``SIDE`` zeros around each text."""
        values, line = line, line if self.token is None else self.token[line]
        made = [self._forward(line, at[k:k + STEP])[3] for k in range(0, len(at), STEP)]
        found = np.concatenate(made) if made else np.empty(0, np.float32)
        if self.classes is not None:
            found = found + self.classes.log_ratios(values)[at]
        return found if self.share is None else found + self.share[values[at]]

    def train(self, line: np.ndarray, at: np.ndarray, sums: Network) -> None:
        """One pass of steps with rates by the gradients so far (``sums``)."""
        line, tokens = line if self.token is None else self.token[line], len(self.bias)
        for k in range(0, len(at), STEP):
            some = at[k:k + STEP]
            inner, p, whole, _ = self._forward(line, some)
            p *= (1 / (len(some) * whole))[:, None]
            p[np.arange(len(some)), line[some]] -= np.float32(1 / len(some))
            hidden, slope = inner[:, :HIDDEN], inner.T @ p
            back = (p @ self.out.T) * (1 - hidden * hidden)
            steps = [(self.out, sums.out, slope[:HIDDEN]), (self.bias, sums.bias, slope[HIDDEN])]
            for n, place in enumerate(PLACES):
                cells = (line[some + place][:, None] * HIDDEN + np.arange(HIDDEN)).ravel()
                grad = np.bincount(cells, back.ravel(), tokens * HIDDEN).astype(np.float32).reshape(tokens, HIDDEN)
                steps.append((self.around[n], sums.around[n], grad))
            for value, total, grad in steps:
                total += grad * grad
                value -= RATE * grad / np.sqrt(total + 1e-8)


def hashed(word: bytes) -> int:
    return zlib.crc32(word) % HASHES


def hashed_column(word: str) -> Column:
    return F.pmod(F.crc32(F.col(word).cast("binary")), F.lit(HASHES)).cast("int")


class Vocabulary:
    """Value of a word: its own if known, else one of ``HASHES`` behind those. The first ``told`` words have shares in tasks."""

    def __init__(self, words: list[str], told: int | None = None):
        self.known = {w.encode(): 1 + i for i, w in enumerate(words)}
        self.told = len(words) if told is None else told

    def line(self, texts: list[str | None], rest: list[list[str]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts in one line with zeros between, the places of their words, and how many each has.

        ``rest`` takes the words of each text that have no share in tasks.
        """
        get, first, crc = self.known.get, 1 + len(self.known), zlib.crc32
        rows, lengths = [np.zeros(SIDE, np.int64)], []
        for text in texts:
            words = (text or "").encode().lower().split()
            row = np.zeros(len(words) + SIDE, np.int64)
            row[:len(words)] = [get(w) or first + crc(w) % HASHES for w in words]
            rows.append(row)
            lengths.append(len(words))
            if rest is not None:
                rest.append([words[k].decode() for k in np.flatnonzero(row > self.told).tolist()])
        line = np.concatenate(rows)
        return line, np.flatnonzero(line), np.array(lengths, np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in counts], pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    counts: Counter = Counter()
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            counts.update((text or "").encode().lower().split())
        if len(counts) > COUNTER_WORDS:
            yield rows()
            counts.clear()
    if counts:
        yield rows()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` for every word of all texts."""
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_words, "word string, n long")
    return written(counts.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def _most(counts: DataFrame, known: int) -> dict[str, int]:
    """Words with the highest counts, ``known`` at most: all that have some count or more, ties by spelling."""
    least, kept = None, 0
    for row in sorted(counts.groupBy("n").agg(F.count("*").alias("words")).collect(), reverse=True):  # one for each count
        kept += row["words"]
        if kept > known:
            break
        least = row["n"]
    if least is None:
        return {}
    best = counts.where(F.col("n") >= least).collect()  # ``known`` at most
    return {r["word"]: r["n"] for r in sorted(best, key=lambda r: (-r["n"], r["word"]))}


def frequent_words(docs: DataFrame, known: int = KNOWN) -> list[str]:
    """The most frequent words of all texts, ties by spelling; ``known`` at most."""
    return list(_most(word_counts(docs), known))


@dataclass
class Shares:
    """Sizes of the network, and the words and distinct words that are no tokens, by hash."""

    tokens: int
    buckets: int
    by_hash: np.ndarray
    distinct_by_hash: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame, best: dict[str, int]) -> Shares:
        grown = max(1.0, counts.count() / SMALL) ** 0.25
        tokens, buckets = min(len(best), round(FREQUENT * grown)), round(BUCKETS * grown)
        shares = cls(tokens, buckets, np.zeros(HASHES), np.zeros(HASHES))
        found = counts.groupBy(hashed_column("word").alias("hash")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).toArrow()  # one a hash
        at = found.column("hash").to_numpy()
        shares.by_hash[at], shares.distinct_by_hash[at] = found.column("n").to_numpy(), found.column("words").to_numpy()
        for word in list(best)[:tokens]:
            shares.by_hash[hashed(word.encode())] -= best[word]
            shares.distinct_by_hash[hashed(word.encode())] -= 1
        return shares

    def _in_buckets(self, by_hash: np.ndarray) -> np.ndarray:
        return np.bincount(np.arange(HASHES) % self.buckets, by_hash, self.buckets)

    @property
    def words(self) -> np.ndarray:
        return self._in_buckets(self.by_hash)

    @property
    def distinct(self) -> np.ndarray:
        return self._in_buckets(self.distinct_by_hash)

    def bucket(self, word: str) -> int:
        return hashed(word.encode()) % self.buckets

    def column(self, word: str) -> Column:
        return F.pmod(hashed_column(word), F.lit(self.buckets))

    def whole(self) -> np.ndarray:
        """What the counts in a bucket are divided by. Each word counts half a time more, and so does an unseen one."""
        return self.words + 0.5 * (self.distinct + 1)

    def told(self, best: dict[str, int], known: int) -> int:
        """How many of the words have shares in tasks: all of some count or more, ``known`` at most, and tokens, which need none."""
        counts = list(best.values())
        return len(counts) if len(counts) <= known else max(self.tokens, sum(n > counts[known] for n in counts))

    def named(self, network: Network, best: dict[str, int], told: int) -> Network:
        """The network for lines of a vocabulary of the words; the shares of words but the first ``told`` are left out."""
        buckets = np.array([self.bucket(w) for w in best], np.int64)
        token = 1 + self.tokens + np.concatenate([[0], buckets, np.arange(HASHES) % self.buckets]).astype(np.int64)
        token[:1 + self.tokens] = np.arange(1 + self.tokens)
        share = np.zeros(len(token))
        rare = np.array(list(best.values()), float)[self.tokens:]
        share[1 + self.tokens:1 + len(best)] = np.log((rare + 0.5) / self.whole()[buckets[self.tokens:]])
        share[1 + told:] = 0
        return replace(network, token=token, share=share)

    def slots(self, best: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The slot of each value of a vocabulary; the bucket of each slot and the counts of its words, half a time more each."""
        each, known = max(1, REST // self.buckets), 1 + len(best)
        hashes, own = np.arange(HASHES), np.array([hashed(w.encode()) for w in best], np.int64)[self.tokens:]
        counts = np.array(list(best.values()), float)[self.tokens:] + 0.5
        others = self.by_hash + 0.5 * self.distinct_by_hash - np.bincount(own, counts, HASHES)
        shared = hashes % self.buckets * each + hashes // self.buckets % each
        slot = np.concatenate([np.arange(known), known + shared])
        bucket = np.concatenate([np.zeros(1 + self.tokens, np.int64), own % self.buckets, np.arange(self.buckets).repeat(each)])
        return slot, bucket, np.concatenate([np.zeros(1 + self.tokens), counts, np.bincount(shared, others, self.buckets * each)])

    def classes(self, best: dict[str, int], sums: np.ndarray, prior: np.ndarray | None = None) -> Classes:
        """Classes by the words of each slot in each class; the slots' shares of a bucket are those of all their words."""
        slot, bucket, share = self.slots(best)
        prior = (sums.sum(axis=0) + 1) / (sums.sum() + sums.shape[1]) if prior is None else prior
        odds = (sums + EVEN * prior) / (sums.sum(axis=1, keepdims=True) + EVEN) / prior
        ratio = odds.copy()
        whole = np.bincount(bucket, share, self.buckets)
        for k in range(sums.shape[1]):
            held = np.bincount(bucket, share * ratio[:, k], self.buckets)
            ratio[:, k] *= np.where(held > 0, whole / np.where(held > 0, held, 1), 1)[bucket]
        odds[0] = ratio[:1 + self.tokens] = 1
        return Classes(slot, np.log(prior).astype(np.float32), np.log(odds).astype(np.float32), ratio.astype(np.float32))

    def kinds(self, network: Network, best: dict[str, int]) -> Classes | None:
        """The classes to start from: kinds of tokens that stand in like places and have like places around them."""
        weights = np.array(list(best.values())[:self.tokens], float)
        if not len(weights):
            return None
        own = slice(1, 1 + self.tokens)
        vectors = np.concatenate([*network.around[:, own], network.out[:, own].T], axis=1).astype(float)
        vectors -= np.average(vectors, axis=0, weights=weights)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        centres = vectors[:1]
        while len(centres) < min(CLASSES, self.tokens):
            centres = np.concatenate([centres, vectors[[(vectors @ centres.T).max(axis=1).argmin()]]])
        for _ in range(20):
            kind = (vectors @ centres.T).argmax(axis=1)
            sums = np.array([weights[kind == k] @ vectors[kind == k] for k in range(len(centres))])
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        each = np.bincount(kind, weights, len(centres))
        kind, each = (np.cumsum(each > 0) - 1)[kind], each[each > 0]
        sums = np.zeros((len(self.slots(best)[1]), len(each)))
        sums[1 + np.arange(self.tokens), kind] = 4.0 * EVEN
        return self.classes(best, sums, each / each.sum())

    def joined(self, counts: DataFrame, best: dict[str, int], told: int) -> DataFrame:
        """``word, share`` for all words but the first ``told``."""
        if best:
            ordered = list(best.values())
            counts = counts.where(F.col("n") <= ordered[told] if told < len(ordered) else F.col("n") < ordered[-1])
        whole = F.element_at(F.array(*[F.lit(float(x)) for x in self.whole()]), self.column("word") + 1)
        return counts.select("word", F.log((F.col("n") + 0.5) / whole).alias("share"))


def _number(words: list[str], told: int) -> Callable:
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(words, told)
        for batch in slices(batches):
            rest: list[list[str]] = []
            line, at, lengths = vocabulary.line(batch.column("text").to_pylist(), rest)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            numbers = line[at].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([numbers[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()), pa.array(rest, pa.list_(pa.string()))],
                names=["doc_id", "numbers", "rest"])

    return number


def numbered(docs: DataFrame, best: dict[str, int], told: int) -> DataFrame:
    """``row, doc_id, numbers, rest``: the words of each text as a vocabulary's values of four bytes, and those whose shares are joined."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(_number(list(best), told), "doc_id long, numbers binary, rest array<string>")
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "numbers")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches with what :meth:`Vocabulary.line` gave for their texts."""
    for batch in slices(batches, "numbers"):
        texts = batch.column("numbers").to_pylist()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) // 4
        at = np.arange(lengths.sum()) + SIDE * np.repeat(np.arange(1, len(texts) + 1), lengths)
        line = np.zeros(len(at) + SIDE * (len(texts) + 1), np.int64)
        line[at] = np.frombuffer(b"".join(texts), np.int32)
        yield batch, line, at, lengths


def _train(start: Network) -> Callable:
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, seen = replace(Network.of(start.flat()), token=start.token), 0
        sums = Network.of(np.zeros(len(network.flat())))
        for _, line, at, _ in _lines(batches):
            network.train(line, at, sums)
            seen += len(at)
        if seen:
            yield pa.RecordBatch.from_pydict({"seen": pa.array([seen], pa.int64()), "weights": pa.array([network.flat()], pa.list_(pa.float32()))})

    return train


def _count_classes(classes: Classes) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(classes.odds.shape)
        for _, line, _, _ in _lines(batches):
            classes.count(line, sums)
        blocks = [k for k in range(0, len(sums), BLOCK) if sums[k:k + BLOCK].any()]
        if blocks:
            yield pa.RecordBatch.from_pydict({"block": pa.array(blocks, pa.int32()), "sums": pa.array([sums[k:k + BLOCK].astype(np.float32).tobytes() for k in blocks], pa.binary())})

    return count


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            whole[block] = whole.get(block, 0) + np.frombuffer(sums, np.float32).astype(np.float64)
    if whole:
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(whole), pa.int32()), "sums": pa.array([x.tobytes() for x in whole.values()], pa.binary())})


def fit(docs: DataFrame, known: int = KNOWN) -> tuple[list[str], Network]:
    """The words of a vocabulary and the network from all texts. Without words it is the network before training.

    The network's probabilities are those of whole words, other than for words that are not among the ``known`` most frequent: of those their
    share of the bucket is left out.
    """
    counts = word_counts(docs)
    best = _most(counts, max(known, OWN))
    shares = Shares.of(counts, best)
    told = shares.told(best, known)
    return list(best), _fit(numbered(docs, best, told), best, shares, told)


def _fit(rows: DataFrame, best: dict[str, int], shares: Shares, told: int) -> Network:
    numbers = rows.select("numbers")
    start = shares.named(Network.start(1 + shares.tokens + shares.buckets), best, told)
    copies = written(numbers.mapInArrow(_train(start), "seen long, weights array<float>"), "networks")
    weights = copies.select("seen", F.posexplode("weights").alias("at", "w"))
    mean = weights.groupBy("at").agg((F.sum(F.col("w").cast("double") * F.col("seen")) / F.sum("seen")).alias("w"))
    flat = start.flat()
    for row in mean.collect():  # as many as the network has weights
        flat[row["at"]] = row["w"]
    network = replace(Network.of(flat), token=start.token, share=start.share)
    classes = shares.kinds(network, best)
    for _ in range(PASSES if classes else 0):
        sums = np.zeros(classes.odds.shape)
        counted = numbers.mapInArrow(_count_classes(classes), "block int, sums binary")
        for row in counted.repartition("block").mapInArrow(_add_blocks, "block int, sums binary").collect():  # one for some slots
            part = np.frombuffer(row["sums"]).reshape(-1, sums.shape[1])
            sums[row["block"]:row["block"] + len(part)] = part
        sums[0] = 0
        classes = shares.classes(best, sums)
    return replace(network, classes=classes)


def _score(network: Network) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, line, at, lengths in _lines(batches):
            found = network.log_probabilities(line, at).astype(np.float64)
            sums = np.bincount(np.repeat(np.arange(len(lengths)), lengths), found, len(lengths))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(lengths), pa.array(sums, pa.float64())],
                names=["row", "doc_id", "n_words", "log_likelihood"])

    return score


def pseudo_likelihood(docs: DataFrame, known: int = KNOWN) -> DataFrame:
    """``doc_id, n_words, log_likelihood, score`` for each row of ``docs`` (``doc_id``, ``text``).

    ``log_likelihood`` sums over all words of the whole text, A-Z folded; ``score`` is its mean by word. A null or
    empty text has no words, the sum 0 and a null score. Null ids and repeated rows are scored like others;
    other columns are ignored. ``known`` words at most are looked up inside tasks, all others by a join.
    """
    counts = word_counts(docs)
    best = _most(counts, max(known, OWN))
    shares = Shares.of(counts, best)
    told = shares.told(best, known)
    texts = numbered(docs, best, told)
    network = _fit(texts, best, shares, told)
    scores = texts.select("row", "doc_id", "numbers").mapInArrow(_score(network), "row long, doc_id long, n_words long, log_likelihood double")
    rows = written(scores, "bucket-scores")
    words = texts.select("row", F.explode("rest").alias("word"))
    sums = words.join(shares.joined(counts, best, told), "word").groupBy("row").agg(F.sum("share").alias("more"))
    whole = rows.join(sums, "row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("more", F.lit(0.0)))
    return whole.select("doc_id", "n_words", "log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("score"))
