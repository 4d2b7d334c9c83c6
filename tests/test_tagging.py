"""Tags of single questions, worked out by hand."""

import datetime as dt

import pytest
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from tendero.operators import routing, tagging
from tendero.operators.tagging import Category, Dictionary
from tendero.streaming import questions as stream

AS_OF = dt.date(2026, 6, 20)
DICTIONARY = Dictionary((
    Category("alimentos", "Alimentos", None, ("alimento", "alimentos")),
    Category("cafe", "Alimentos", "Café soluble", ("cafe", "café"), ("dolca", "La Virginia"),
             {"kg": ("1 kg", "500g")}),
    Category("cervezas", "Bebidas", "Cervezas", ("cerveza", "paleta"), ("quilmes", "andes")),
    Category("fiambres", "Frescos", "Fiambres", ("paleta", "jamon")),
    Category("mascotas", None, "Alimentos para mascot", ("perro", "alimento para perro")),
))

CASES = {
    "alimento para perro adulto": {"category": "mascotas", "family": None, "subfamily": "Alimentos para mascot"},
    "perro y cerveza": {"category": "cervezas"},
    "jamon y perro": {"category": "fiambres"},
    "paleta": {"category": "fiambres"},
    "Precio de CAFÉ 1 kg la virginia": {"category": "cafe", "brands": ["la virginia"], "size_label": "1 kg",
                                       "size_kind": "kg"},
    "cafeteria": {"category": None},
    "quilmes, dolca": {"category": None, "brands": ["dolca", "quilmes"]},
    "más de 900cc": {"min_cc": 900, "max_cc": None, "min_g": None, "top_n": 10},
    "mas de 1,5 litros": {"min_cc": 1500},
    "superior a 2 l": {"min_cc": 2000, "min_g": None},
    "menos de 500ml": {"max_cc": 500},
    "menor que 250 gramos": {"max_g": 250, "max_cc": None},
    "más de 2 kg": {"min_g": 2000, "min_cc": None},
    "más de 3 lavarropas": {"min_cc": None, "min_g": None, "top_n": 3},
    "los 30 más vendidos": {"top_n": 30, "wants_ranking": True},
    "top 51": {"top_n": 10, "wants_ranking": True},
    "900cc y 5": {"top_n": 5},
    "99999999999999 y 5": {"top_n": 10},
    "comprarle a Don Gastón": {"supplier": "don gaston"},
    "pedir quilmes": {"supplier": "quilmes", "brands": []},
    "stock en Sabin y hiper": {"branches": ["hiper", "sabin"], "wants_stock": True},
    "última oc": {"wants_price": True},
    "focos y tocador": {"wants_price": False},
    "precio oc": {"wants_price": True},
    "reposición de otoño": {"wants_stock": True, "wants_alert": True, "wants_season": True},
    "ventas de hoy": {"date_from": AS_OF, "date_to": AS_OF},
    "esta semana": {"date_from": dt.date(2026, 6, 13)},
    "este mes": {"date_from": dt.date(2026, 6, 1)},
    "último mes": {"date_from": dt.date(2026, 5, 21)},
    "ultimos 90 dias": {"date_from": dt.date(2026, 3, 22)},
    "mayo 2026": {"date_from": dt.date(2026, 5, 1)},
    "junio de 2026": {"date_from": dt.date(2026, 6, 1)},
    "en mayo": {"date_from": dt.date(2026, 5, 1), "date_to": AS_OF},
    "desde apertura": {"date_from": dt.date(2026, 6, 6)},
    "nada": {"date_from": None, "date_to": None, "supplier": None, "brands": [], "branches": []},
}

ROUTES = {
    "qué vendemos bajo el costo": "below_cost",
    "cuánto perdimos este mes": "lost_sales_value",
    "qué sucursal vendió más cerveza": "sales_by_branch",
    "qué sucursal vendió más": None,
    "qué comprarle a tremblay": "restock_by_supplier",
    "cuánto tengo que pedir de cerveza": "how_much_to_order",
    "cuánto tengo que pedir": None,
    "qué va en oferta": "offer_candidates",
    "qué está subiendo": "trend_items",
    "hola": None,
    "presupuesto de compra de cerveza": "budget_by_supplier",
    "exceso de stock de cerveza": "excess_for_transfer",
    "cuál es la familia con mejor margen, cerveza o café": "family_margin_leaders",
    "qué genera más plata pero casi no deja ganancia en café": "high_sales_low_margin",
    "alertas de stock de cerveza": "critical_with_sales",
    "precio de venta vs compra de cerveza": "sale_vs_purchase",
    "precio de compra de la cerveza más vendida": "top_sellers_with_cost",
    "precio de compra de cerveza": "purchase_prices",
    "qué cervezas o paleta pueden quedar sin stock": "bestsellers_at_risk",
    "cerveza con riesgo de quiebre": "critical_with_sales",
    "stock de cerveza": "stock_by_category",
    "stock de alimentos": "top_sellers",
    "cerveza": "top_sellers",
    "impacto de la apertura de sabin en cerveza": "before_after_event",
}


@pytest.fixture(scope="module")
def tagged(spark):
    texts = list(dict.fromkeys([*CASES, *ROUTES]))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = routing.route_label(tagging.tag_texts(df, "text", DICTIONARY, AS_OF), "text").collect()
    return {r["text"]: r for r in rows}


@pytest.mark.parametrize("text", CASES)
def test_tags(tagged, text):
    row = tagged[text]
    assert {k: row[k] for k in CASES[text]} == CASES[text]


@pytest.mark.parametrize("text", ROUTES)
def test_routes(tagged, text):
    assert tagged[text]["route"] == ROUTES[text]


def test_every_tag_is_there(tagged):
    assert set(tagging.TAGS) < set(tagged["nada"].asDict())


def test_null_text(spark):
    df = spark.createDataFrame([(None,)], "text string")
    row = routing.route_label(tagging.tag_texts(df, "text", DICTIONARY, AS_OF), "text").first()
    assert row["category"] is None and row["route"] is None and row["top_n"] == 10


def test_dictionary_table(spark):
    frame = DICTIONARY.to_frame(spark)
    synonyms, brands = tagging.dictionary_frames(frame)
    assert dict(map(tuple, synonyms.collect()))["paleta"] == "fiambres"
    assert dict(map(tuple, brands.collect()))["la virginia"] == "cafe"
    back = Dictionary.from_frame(frame)
    assert back.synonyms() == DICTIONARY.synonyms() and back.brands() == DICTIONARY.brands()
    assert [c.sizes for c in back.categories] == [dict(c.sizes) for c in DICTIONARY.categories]


def test_table_and_expression_tag_alike(spark):
    texts = [*CASES, "una cerveza quilmes", "café 500g", "paleta", "alimento", "ni idea de dolca", "", "CAFÉ  La Virginia 1 kg"]
    df = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)] + [(None,)], "text string")
    columns = ("category", "family", "subfamily", "size_label", "size_kind")
    by_table = {r["text"]: r for r in tagging.tag_items(df, "text", DICTIONARY.to_frame(spark)).collect()}
    lowered = F.lower(F.trim("text"))
    number = tagging.category_number(lowered, DICTIONARY)
    plain = tagging.tag_category(df, "text", DICTIONARY).withColumns({
        "brands": tagging.brands_in(lowered, number, DICTIONARY), "_size": tagging.size_in(lowered, number, DICTIONARY)})
    plain = plain.withColumns({"size_label": F.col("_size.label"), "size_kind": F.col("_size.kind")})
    for r in plain.where("text IS NOT NULL").collect():
        assert [by_table[r["text"]][c] for c in columns] == [r[c] for c in columns], r["text"]
        assert set(by_table[r["text"]]["brands"]) == set(r["brands"]), r["text"]


def test_plan_does_not_grow_with_the_dictionary(spark):
    def plan(categories):
        dictionary = spark.range(categories).selectExpr(
            "id AS position", "concat('c', id) AS category", "'f' AS family", "'s' AS subfamily",
            "array(concat('word', id), concat('two words', id)) AS synonyms", "array(concat('brand', id)) AS brands")
        df = spark.createDataFrame([("word7 brand7",), ("two words9",)], "text string")
        tagged = tagging.tag_items(df, "text", dictionary)
        assert {r["category"] for r in tagged.collect()} == {"c7", "c9"}
        return len(tagged._jdf.queryExecution().optimizedPlan().toString())

    assert plan(10_000) < 1.1 * plan(10)


def test_special_characters_are_literal(spark):
    d = Dictionary((Category("j", "F", None, ("j.walker", "c+c")),))
    df = spark.createDataFrame([("un j.walker",), ("un jxwalker",)], "text string")
    assert [r["category"] for r in tagging.tag_category(df, "text", d).collect()] == ["j", None]


WORDS = st.sampled_from(["perro", "alimento", "para", "cerveza", "jamon", "paleta", "café", "x", "alimentos"])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(WORDS, max_size=6).map(" ".join), min_size=1, max_size=40))
def test_category_against_trying_each_synonym(spark, texts):
    """Brute force: all synonyms, the longest that stands between word edges."""
    owner = DICTIONARY.synonyms()

    def expected(text):
        padded = f" {text} "
        hits = [s for s in sorted(owner, key=len, reverse=True) if f" {s} " in padded]
        return DICTIONARY.categories[owner[hits[0]]].key if hits else None

    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = tagging.tag_category(df, "text", DICTIONARY).collect()
    assert [r["category"] for r in got] == [expected(r["text"]) for r in got]


def test_no_python_worker(spark):
    df = spark.createDataFrame([("x",)], "text string")
    plan = routing.route_label(tagging.tag_texts(df, "text", DICTIONARY, AS_OF), "text")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Exchange" not in text


def test_stream_tags_each_question_once(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = [(dt.datetime(2026, 6, 20), t, "", None, 1.0) for t in ROUTES]
    columns = "timestamp timestamp, pregunta string, respuesta string, modo string, tiempo_seg double"
    df = spark.createDataFrame(rows, columns)
    df.limit(5).write.json(source)
    for _ in range(2):
        tagged = stream.tag_and_route(stream.read_questions(spark, source), DICTIONARY, AS_OF)
        stream.write_tagged(tagged.select("pregunta", "route"), out, check).awaitTermination()
    assert spark.read.json(out).count() == 5
    df.limit(3).write.mode("append").json(source)
    tagged = stream.tag_and_route(stream.read_questions(spark, source), DICTIONARY, AS_OF)
    stream.write_tagged(tagged.select("pregunta", "route"), out, check).awaitTermination()
    back = spark.read.json(out).collect()
    assert len(back) == 8
    assert all(r.asDict().get("route") == ROUTES[r["pregunta"]] for r in back)


def _brand_table(spark, categories):
    rows = [(i, f"c{i}", None, None, list(s), list(b)) for i, (s, b) in enumerate(categories)]
    return spark.createDataFrame(rows, "position int, category string, family string, subfamily string, synonyms array<string>, brands array<string>")


BRANDS = [
    (["café"], ["La Virginia", "ñ", "virginia", "LA", "La Virginia", None, ""]),
    (["té", "té verde"], ["taragüi", "a.b*c", "😀 ok", "x" * 300]),
    (["nada"], []),
    ([], ["zz", "the", "the best of the best", "best", "aaaa", "aaaaaaaa"]),
]


def test_brands_by_table_against_looking_for_each(spark):
    texts = ["café LA VIRGINIA", "  café de la virginia y ñandú", "té A.B*C taragüi the", "the best of the best", "aaaaaaa", "aaaaaaaaa", "zz😀 ok", "nada zz", "", " ",
             "x" * 299, "té " + "x" * 301, "the " * 20000 + "virginia", "taragüi sin categoría", "taragui", "best\nof", "😀", "é ñ"]
    df = spark.createDataFrame([(t,) for t in texts] * 3 + [(None,)], "text string").repartition(3)
    table = _brand_table(spark, BRANDS)

    def expected(text, category):
        lowered = text.strip(" ").lower()
        if category is not None:
            return [b.lower() for b in BRANDS[int(category[1:])][1] if b and b.lower() in lowered]
        return sorted({b.lower() for _, bs in BRANDS for b in bs if b and b.lower() in lowered}, key=str.encode)

    found = tagging.tag_items(df, "text", table).collect()
    assert len(found) == 3 * len(texts) + 1
    for r in found:
        assert r["brands"] == ([] if r["text"] is None else expected(r["text"], r["category"])), r["text"][:60]


def test_tagging_by_table_keeps_the_callers_columns(spark):
    df = spark.createDataFrame([("té zz", 1, 2, 3, 4, "own", 5)], "`a.text` string, _text int, _entry int, _all int, entry int, brands string, text int")
    made = tagging.tag_items(df, "a.text", _brand_table(spark, BRANDS))
    assert made.columns == ["a.text", "_text", "_entry", "_all", "entry", "text", "category", "family", "subfamily", "brands"]
    assert tuple(made.first()) == ("té zz", 1, 2, 3, 4, 5, "c1", None, None, [])
    assert tagging.tag_items(df.limit(0), "a.text", _brand_table(spark, BRANDS)).collect() == []
    none = tagging.tag_items(df, "a.text", _brand_table(spark, BRANDS).limit(0))
    assert (none.first()["category"], none.first()["brands"]) == (None, [])
    only = tagging.tag_items(df, "a.text", _brand_table(spark, [(["té"], [])]))
    assert (only.first()["category"], only.first()["brands"]) == ("c0", [])


def test_many_brands_come_up_by_their_rarest_run(spark):
    """A hundred thousand brands that share all runs but a few, and a text that a third of the rows repeat."""
    dictionary = spark.range(100_000).selectExpr(
        "id AS position", "concat('c', id) AS category", "'f' AS family", "'s' AS subfamily", "array(concat('word', id)) AS synonyms",
        "array(concat('grand maison no. ', id, '!')) AS brands")
    asked = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'from grand maison no. 77!', concat('a grand maison no. ', id * 31, '! please')) AS text")
    made = tagging.tag_items(asked, "text", dictionary)
    found = {r["id"]: r["brands"] for r in made.collect()}
    assert all(found[i] == [f"grand maison no. {77 if i % 3 == 0 else i * 31}!"] for i in range(3000))
    assert "collect_set" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_table_tags_are_looked_up_in_written_steps(spark):
    """No run of characters moves in the last plan, and a text that repeats or is null keeps all its rows."""
    texts = ["una cerveza quilmes", "una cerveza quilmes", "ni idea", "", None, None]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    tagged = tagging.tag_items(df, "text", DICTIONARY.to_frame(spark))
    plan = tagged._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("Exchange") <= 10
    rows = {r["n"]: r for r in tagged.collect()}
    assert sorted(rows) == list(range(6)) and rows[0]["category"] == rows[1]["category"] == "cervezas" and rows[5]["brands"] == []
