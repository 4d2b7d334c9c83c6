"""Misspelled terms, context, and held-out accuracy."""

import random
import zlib
from math import comb

import pytest
from cases import documents
from pyspark.sql import functions as F

from corpus_pipeline import STAGES
from tendero.llm.toxicity import CUT, CUT_JAVA, Matcher, Model, chance, clean, context, fit, scored


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_matcher_is_the_edit_distance():
    terms = {"idiot": 3.0, "stupid": 2.0, "scum": 4.0, "worthless": 1.0, "stupor": 1.5}
    matcher = Matcher(terms, {"lowei": 5.0})
    pick = random.Random(1)
    words = list(terms) + ["loweichen", "lowe", "lowei", "", "x", "über"]
    for term in terms:
        for _ in range(300):
            letters = list(term)
            for _ in range(pick.choice([1, 1, 2])):
                at = pick.randrange(len(letters))
                what = pick.randrange(3)
                if what == 0:
                    letters[at] = pick.choice("abcdeistupodwé")
                elif what == 1 and len(letters) > 1:
                    del letters[at]
                else:
                    letters.insert(at, pick.choice("abcdeistupodwé"))
            words.append("".join(letters))
    for word in words:
        near = [t for t in terms if distance(word, t) <= (len(t) >= 5)]
        found = matcher.match(word)
        assert (found is not None) == (bool(near) or word.startswith("lowei")), word
        if found and not word.startswith("lowei"):
            assert found[2] == min(distance(word, t) for t in near)


def test_quotation_counts_less_than_abuse():
    plain, quoted, told = "you are an idiot today".split(), 'he is an "idiot" today'.split(), "she said idiot once".split()
    assert context(plain, 3, False) == 1.0
    assert context(quoted, 3, False) < 0.5 and context(told, 2, False) == 0.5 and context(plain, 3, True) > 1


def labelled(spark):
    pick = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        text = [f"v{pick.randrange(300)}" for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                text[pick.randrange(60)] = pick.choice(["blockhead", "numbskull", "grubend", "grubix", "grubor", "grubal", "grubet", "grubas"])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows + [(i, t) for i, t, *_ in documents() if i is None], "doc_id long, text string")
    return docs, spark.createDataFrame([*labels, (5000, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels}


def test_held_out_accuracy_and_misspellings(spark):
    docs, labels, truth = labelled(spark)
    model = fit(docs, labels)
    rows = {r["doc_id"]: r for r in scored(docs, model).collect()}
    assert rows[None]["predicted"] == 0
    for i, toxic in truth.items():
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= rows[i]["score"] <= 1 and rows[i]["predicted"] == (rows[i]["score"] >= 0.5)
    held = [i for i in truth if rows[i]["held_out"]]
    assert sum(rows[i]["predicted"] == truth[i] for i in held) >= 0.98 * len(held)
    assert model.score("v1 v2 such a blokhead and a numbskul and blockheed v3 v4") > model.score("v1 v2 such a v9 and a v8 v3 v4")
    assert clean(docs, model).columns == docs.columns


@pytest.mark.parametrize("rows", [[], [(1, 1, 0)], [(1, 1, 1)]])
def test_without_both_classes_nothing_is_rejected(spark, docs, no_docs, rows):
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    model = fit(docs, labels)
    assert model is None and {r["score"] for r in scored(docs, model).collect()} == {0.0}
    assert scored(no_docs, model).collect() == [] and clean(docs, model).count() == docs.count()


def test_empty_and_odd_texts_score_alike(docs):
    model = Model({"idiot": 3.0}, {}, [1.0, 1.0, 1.0, 1.0, -3.0])
    rows = [r for r in scored(docs, model).collect() if r["doc_id"] in (8, 9, 10, 16)]
    assert len(rows) == 4 and len({r["score"] for r in rows}) == 1


def few(spark, toxic_word):
    """200 documents, 12 of them labelled toxic and of those not held out fewer than 12."""
    pick = random.Random(8)
    rows, labels = [], []
    for i in range(200):
        text = [f"v{pick.randrange(400)}" for _ in range(40)]
        if i % 16 == 5:
            text[pick.randrange(40)] = toxic_word or text[0]
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 16 == 5)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_few_toxic_rows_are_enough(spark, tmp_path):
    docs, labels = few(spark, "blockhead")
    model = fit(docs, labels)
    assert "blockhead" in model.terms and "v1" not in model.terms
    wanted = {i for i in range(200) if i % 16 == 5}
    assert {r["doc_id"] for r in scored(docs, model).where("predicted = 1").collect()} == wanted
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = dict(STAGES)["toxicity"](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == set(range(200)) - wanted


def test_labels_without_a_telling_word_reject_nothing(spark):
    docs, labels = few(spark, None)
    model = fit(docs, labels)
    assert model is None and clean(docs, model).count() == 200 and {r["predicted"] for r in scored(docs, model).collect()} == {0}


def test_chance_is_the_share_of_draws():
    assert chance(3, 1, 5, 7) == pytest.approx((comb(5, 3) * comb(7, 1) + comb(5, 4)) / comb(12, 4))
    assert chance(0, 4, 5, 7) == pytest.approx(1)


def test_words_are_cut_alike_in_learning_and_matching(spark):
    signs = [chr(k) for k in range(0x2FFFF) if not 0xD800 <= k < 0xE000]
    text = "a" + "a".join(signs)
    cut = spark.createDataFrame([(text,)], "text string").select(F.split(F.regexp_replace("text", CUT_JAVA, " "), " ")).first()[0]
    assert [w for w in cut if w] == [w for w in CUT.split(text) if w]
    model = Model({"idiot": 3.0, "scum": 2.0, "blockhead": 4.0}, {}, [1.0, 1.0, 1.0, 1.0, -3.0])
    for word, terms in (("idiot###", ["idiot"]), ("$$Scum&&&", ["scum"]), ("x-scum", ["scum"]), ("idiot,blockhead", ["idiot", "blockhead"]),
                        ("block#ead", ["blockhead"]), ("id#ot!", ["idiot"]), ("###", []), ("scu#m", [])):
        assert [m[0] for _, m in model.matches(f"you {word} there")[0]] == terms, word
