"""The masked network: its probabilities, its gradient, and what it learns."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import documents, tokens

from tendero.llm.masked_lm import BUCKETS, FREQUENT, HASHES, KNOWN, SIDE, SMALL, TOKENS, Network, Shares, Vocabulary, fit, frequent_words, pseudo_likelihood


def test_probabilities_do_not_look_at_the_word_itself():
    network = Network.start()
    line = np.array([0] * SIDE + [5, 9, 3, 7, 2] + [0] * SIDE)
    at = np.array([SIDE + 2])
    total = 0.0
    for token in range(TOKENS):
        line[SIDE + 2] = token
        total += np.exp(network.log_probabilities(line, at)[0])
    assert abs(total - 1) < 1e-4


def test_gradient_is_that_of_the_likelihood():
    network, sums = Network.start(), Network.of(np.full(len(Network.start().flat()), 1e12))
    pick = np.random.default_rng(0)
    line = np.concatenate([np.zeros(SIDE, int), pick.integers(1, TOKENS, 40), np.zeros(SIDE, int)])
    at = np.flatnonzero(line)
    flat, moved = network.flat().astype(np.float64), Network.of(network.flat())
    moved.train(line, at, sums)
    step = moved.flat().astype(np.float64) - flat
    for k in pick.choice(np.flatnonzero(np.abs(step) > 0), 12):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-2
        down[k] -= 1e-2
        slope = (Network.of(up).log_probabilities(line, at).mean() - Network.of(down).log_probabilities(line, at).mean()) / 2e-2
        assert slope == pytest.approx(step[k] * 1e6 / 0.5, abs=2e-2, rel=0.2) or abs(slope) < 2e-3


def test_orderly_text_scores_higher_than_shuffled(spark):
    pick = random.Random(9)
    line = "the cat sat on the mat and the dog lay by the door while rain fell on the old roof".split()
    rows = []
    for k in range(400):
        text = line * 6
        if k % 2:
            text = pick.sample(text, len(text))
        rows.append((k, " ".join(text)))
    found = {r["doc_id"]: r["score"] for r in pseudo_likelihood(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    even, odd = [found[k] for k in range(0, 400, 2)], [found[k] for k in range(1, 400, 2)]
    assert min(even) > max(odd)


def test_scores_are_those_of_the_whole_text(docs):
    words, network = fit(docs)
    assert words == frequent_words(docs)
    vocabulary = Vocabulary(words)
    wanted = []
    for i, text, *_ in documents():
        line, at, lengths = vocabulary.line([text])
        wanted.append((i, len(tokens(text)), round(float(network.log_probabilities(line, at).astype(float).sum()), 0)))
        assert lengths[0] == len(tokens(text)) == len(at)
    rows = pseudo_likelihood(docs).collect()
    for (i, n, total), r in zip(sorted(wanted, key=str), sorted(((r["doc_id"], r["n_words"], r["log_likelihood"], r["score"]) for r in rows), key=str), strict=True):
        assert (i, n) == r[:2] and r[2] == pytest.approx(total, rel=0.02, abs=1.5) and (r[3] is None) == (n == 0)


def test_empty_table(no_docs):
    assert pseudo_likelihood(no_docs).collect() == []


def test_every_word_has_its_own_probability(spark):
    """Words of one bucket differ by their counts, inside tasks and by the join alike; a bucket's words add up to it."""
    pick = random.Random(3)
    texts = [" ".join(f"w{int(600 * pick.random() ** 3)}" for _ in range(200)) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (60, None), (None, texts[0])], "doc_id long, text string").repartition(1)
    counts = Counter(w for t in [*texts, texts[0]] for w in t.encode().split())
    words, network = fit(docs)
    assert len(words) == len(counts) > 3 * TOKENS
    line = Vocabulary(words).line([" ".join(words)])[0]
    token, share = network.token[line], network.share[line]
    assert len({x for x, t in zip(share, token, strict=True) if t == TOKENS - 1}) > 1
    for bucket in range(TOKENS - 32, TOKENS):
        inside = np.exp(share[token == bucket])
        n = sum(counts[w.encode()] for w, t in zip(words, token[line > 0], strict=True) if t == bucket)
        assert inside.sum() == pytest.approx(1 - 0.5 / (n + 0.5 * (len(inside) + 1)))
    whole, joined = ({(r["doc_id"], r["n_words"]): r["log_likelihood"] for r in pseudo_likelihood(docs, known).collect()} for known in (KNOWN, 100))
    assert whole.keys() == joined.keys() and len(frequent_words(docs, 100)) <= 100
    for key in whole:
        assert joined[key] == pytest.approx(whole[key], rel=1e-6)


def test_network_grows_with_the_vocabulary(spark):
    best = {f"w{k}": 1 for k in range(5000)}
    few = spark.createDataFrame(list(best.items()), "word string, n long")
    small, large = Shares.of(few, best), Shares.of(spark.range(16 * SMALL).selectExpr("concat('w', id) AS word", "1L AS n"), best)
    assert (small.tokens, small.buckets) == (FREQUENT, BUCKETS) and (large.tokens, large.buckets) == (2 * FREQUENT, 2 * BUCKETS)
    assert large.words.sum() == large.distinct.sum() == 16 * SMALL - large.tokens


@pytest.fixture(scope="module")
def tongues(spark):
    """Texts in one of two languages that share no word: 40 frequent words and 1,500 others each, dealt at random."""
    pick = random.Random(5)
    texts = []
    for k in range(240):
        frequent, others = [f"{'ab'[k % 2]}{n}" for n in range(40)], [f"{'xy'[k % 2]}{n}" for n in range(1500)]
        texts.append(" ".join(pick.choice(frequent if pick.random() < 0.5 else others) for _ in range(200)))
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).cache()


def test_words_of_a_bucket_are_told_apart_by_both_sides(tongues):
    """A word of no token is likelier among words of its language, and whichever side they stand on."""
    words, network = fit(tongues[1])
    vocabulary = Vocabulary(words)

    def inside(text, at):
        """Log-probability of a word given its bucket."""
        line, _, _ = vocabulary.line([text])
        flat = Network(network.around, network.out, network.bias, network.token)
        return float(network.log_probabilities(line, np.array([SIDE + at]))[0] - flat.log_probabilities(line, np.array([SIDE + at]))[0])

    rare = [w for w in words if w[0] in "xy"][200:240]
    assert all(network.token[line] > FREQUENT for w in rare for line in [vocabulary.line([w])[0][SIDE]])
    own, other = ([f"{x}{n}" for n in range(4)] for x in "ab")
    for w in rare:
        near, far = (own, other) if w[0] == "x" else (other, own)
        assert inside(" ".join([*near[:2], w, *near[2:]]), 2) > inside(" ".join([*far[:2], w, *far[2:]]), 2) + 1
        assert inside(" ".join([*near, w]), 4) > inside(" ".join([*far, w]), 4) + 0.5
        assert inside(" ".join([w, *near]), 0) > inside(" ".join([w, *far]), 0) + 0.5


def test_probabilities_of_all_words_add_up(tongues):
    """Between any neighbours; what is missing is kept for words not seen, half a word in each bucket."""
    words, network = fit(tongues[1])
    line, at, _ = Vocabulary(words).line([f"x7 a1 {w} a2 y3" for w in words])
    found = np.exp(network.log_probabilities(line, at[2::5]).astype(float))
    tokens = network.token[line[at[2::5]]]
    size, held = Counter(w for t in tongues[0] for w in t.split()), Counter()
    for w, t in zip(words, tokens, strict=True):
        held[t] += size[w] + 0.5
    flat = Network(network.around, network.out, network.bias)
    line = np.array([0] * SIDE + [int(network.token[v]) for v in Vocabulary(words).line(["x7 a1 x7 a2 y3"])[0][SIDE:-SIDE]] + [0] * SIDE)
    for t in sorted(set(tokens.tolist())):
        line[SIDE + 2] = t
        whole = np.exp(flat.log_probabilities(line, np.array([SIDE + 2]))[0])
        assert found[tokens == t].sum() == pytest.approx(whole * (held[t] / (held[t] + 0.5) if t > FREQUENT else 1), rel=1e-4)


def test_scores_by_a_plain_loop(tongues):
    """Classes, their odds and the shares of words, worked out word by word."""
    texts, docs = tongues
    words, network = fit(docs)
    rows = {r["doc_id"]: r for r in pseudo_likelihood(docs).collect()}
    counts = Counter(w for t in texts for w in t.split())
    classes, tokens = network.classes, {w: 1 + k for k, w in enumerate(words[:FREQUENT])}
    hashed = lambda w: zlib.crc32(w.encode()) % HASHES
    slot = {w: 1 + k for k, w in enumerate(words)}.get  # all have one of their own
    token = lambda w: tokens.get(w) or 1 + FREQUENT + hashed(w) % BUCKETS
    whole = Counter()
    for w, n in counts.items():
        whole[token(w)] += n + 0.5
    for k in range(2):
        text, total = texts[k].split(), 0.0
        for i, w in enumerate(text):
            near = [(p, text[i + p]) for p in (-2, -1, 1, 2) if 0 <= i + p < len(text)]
            places = [p for p in (-2, -1, 1, 2)]
            beside = {p: 0 for p in places} | {p: token(x) for p, x in near}
            hidden = np.tanh(sum(network.around[n][beside[p]].astype(float) for n, p in enumerate(places)))
            logits = hidden @ network.out.astype(float) + network.bias
            total += logits[token(w)] - math.log(sum(math.exp(x) for x in logits))
            if w not in tokens:
                weights = [math.exp(classes.prior[c] + sum(float(classes.odds[slot(x), c]) for _, x in near)) for c in range(len(classes.prior))]
                tilt = sum(g * float(classes.ratio[slot(w), c]) for c, g in enumerate(weights)) / sum(weights)
                total += math.log(tilt * (counts[w] + 0.5) / (whole[token(w)] + 0.5))
        assert rows[k]["n_words"] == len(text) and rows[k]["log_likelihood"] == pytest.approx(total, rel=1e-4)


def test_few_words_make_few_classes(spark):
    """One word, no word, and words that never meet another."""
    for texts in (["a"], [""], [None, "   "], ["a", "b", "a a a"]):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows = pseudo_likelihood(docs).collect()
        assert len(rows) == len(texts) and all(math.isfinite(r["log_likelihood"]) and (r["score"] is None) == (not r["n_words"]) for r in rows)
