"""Tags for a column of questions or other free text.

Every tag is a native column expression, so tagging is one projection: no shuffle, no
Python worker, any number of rows, and it runs on a stream as it does on a table. The
dictionary is an argument of the expression, like the text of a query.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tendero import constants as K
from tendero.functions import predicates as P, text as T, words as W
from tendero.sources.shared import written

DEFAULT_TOP_N = 10
TOP_N_RANGE = (2, 50)


@dataclass(frozen=True)
class Category:
    """A kind of item: where it sits in the catalogue and how people call it."""

    key: str
    family: str | None = None
    subfamily: str | None = None
    synonyms: Sequence[str] = ()
    brands: Sequence[str] = ()
    sizes: Mapping[str, Sequence[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Dictionary:
    """Categories in order, with the supplier and branch names to look for."""

    categories: Sequence[Category]
    suppliers: Sequence[str] = W.KNOWN_SUPPLIERS
    branches: Sequence[str] = K.ALL_BRANCHES

    def synonyms(self) -> dict[str, int]:
        """Synonym to category number. A synonym listed twice belongs to the last category."""
        return {s.lower(): i for i, c in enumerate(self.categories) for s in c.synonyms}

    def brands(self) -> list[str]:
        return list(dict.fromkeys(b.lower() for c in self.categories for b in c.brands))

    @staticmethod
    def from_frame(df: DataFrame, **names: Sequence[str]) -> "Dictionary":
        """Read a small dictionary table: position, category, family, subfamily, synonyms, brands, sizes.

        It becomes part of the expression, which suits the dictionary of one shop. A large one stays a
        table: :func:`tag_items` joins with it and collects nothing.
        """
        sizes = "sizes" in df.columns
        return Dictionary(tuple(
            Category(r["category"], r["family"], r["subfamily"], tuple(r["synonyms"] or ()), tuple(r["brands"] or ()),
                     {k: tuple(v) for k, v in (r["sizes"] or {}).items()} if sizes else {})
            for r in df.orderBy("position").collect()
        ), **names)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, c.key, c.family, c.subfamily, list(c.synonyms), list(c.brands), {k: list(v) for k, v in c.sizes.items()})
                for i, c in enumerate(self.categories)]
        return spark.createDataFrame(
            rows, "position int, category string, family string, subfamily string, "
                  "synonyms array<string>, brands array<string>, sizes map<string, array<string>>")


# ---- dictionary tables --------------------------------------------------------

def _word_to_category(dictionary: DataFrame, column: str, name: str) -> DataFrame:
    words = dictionary.select("category", "position", F.posexplode(column).alias("place", "word"))
    latest = Window.partitionBy("word").orderBy(F.desc("position"), F.desc("place"))
    return (
        words.withColumn("word", F.lower("word"))
        .withColumn("_n", F.row_number().over(latest)).where(F.col("_n") == 1)
        .select(F.col("word").alias(name), "category")
    )


def dictionary_frames(dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Synonym to category and brand to category; a word listed twice keeps the last one."""
    return (_word_to_category(dictionary, "synonyms", "synonym"),
            _word_to_category(dictionary, "brands", "brand"))


def _phrase(text: Column) -> Column:
    """The words of a text, lower-cased, with one space between."""
    return F.array_join(F.split(F.btrim(F.regexp_replace(F.lower(text), r"(?U)\W+", " ")), " "), " ")


def _category_of(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``id, position`` of the category whose longest synonym stands in each of the ``texts`` (``id``, ``text``).

    Every run of words up to the length of the longest synonym is looked up by a join. Of
    synonyms equally long the one listed first wins; one listed twice belongs to the last category.
    """
    listed = dictionary.select("position", F.posexplode("synonyms").alias("place", "word"))
    listed = listed.withColumn("phrase", _phrase(F.col("word"))).where("phrase != ''")
    at = F.struct("position", "place")
    listed = written(listed.groupBy("phrase").agg(
        F.max_by("position", at).alias("position"), F.min(at).alias("listed"), F.max(F.length("word")).alias("letters")), "phrases")
    longest = listed.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 0
    words = F.split(_phrase(F.col("text")), " ")

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("words") - n + 1)
        found = F.transform(starts, lambda i: F.array_join(F.slice("words", i, n), " "))
        return F.when(F.size("words") >= n, found).otherwise(F.array().cast("array<string>"))

    # explode keeps the optimizer from splitting the text again for every run
    split = texts.select("id", F.explode(F.array(words)).alias("words"))
    looked = split.select("id", F.explode(F.array_distinct(F.flatten(F.array(*map(runs, range(1, longest + 1))))
                                                           if longest else F.array().cast("array<string>"))).alias("phrase"))
    return looked.join(listed, "phrase").groupBy("id").agg(
        F.min_by("position", F.struct(-F.col("letters"), F.col("listed"))).alias("position"))


#: Length of the character runs that brands are filed under; shorter brands are filed whole.
GRAM = 4


def _grams(text: Column, lengths: Sequence[int]) -> Column:
    """Every run of so many characters in a text, each once, found in one pass per length."""
    runs = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths]
    return F.array_distinct(F.flatten(F.array(*runs)))


def _brands_of(texts: DataFrame, placed: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``id, brands`` for those of the ``texts`` (``id``, ``text``) that name a brand; ``placed`` has the position of their category.

    An inverted index of character runs: each brand is filed under that of its runs which fewest texts hold, so a
    run that is everywhere brings up only brands that are no more than that run. Of a text only runs that some brand has
    are counted, and only runs that a brand is filed under are looked up; then the brand is looked for in the text itself.
    A text of a category has the brands of that category as they are listed there, any other those of all categories by
    name. An empty brand is none.
    """
    listed = dictionary.select("position", F.posexplode("brands").alias("place", "brand")).withColumn("brand", F.lower("brand")).where("brand != ''")
    names = listed.select("brand").distinct()
    lengths = [r[0] for r in names.select(F.least(F.length("brand"), F.lit(GRAM))).distinct().collect()]  # GRAM of them at most
    if not lengths:
        return texts.select("id", F.array().cast("array<string>").alias("brands")).where("false")
    lowered = F.lower(F.trim("text"))
    held = texts.select("id", F.explode(_grams(lowered, lengths)).alias("gram"))
    by_length = F.array(*[F.when(F.least(F.length("brand"), F.lit(GRAM)) == n, _grams(F.col("brand"), [n])) for n in lengths])
    runs = written(names.select("brand", F.explode(F.flatten(F.array_compact(by_length))).alias("gram")), "brand-runs")
    busy = held.join(runs.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    filed = written(runs.join(busy, "gram", "left").groupBy("brand").agg(
        F.min_by("gram", F.struct(F.coalesce("texts", F.lit(0)), "gram")).alias("gram")), "filed-brands")
    met = held.join(filed, "gram").select("id", "brand")
    hits = texts.join(met, "id").where(F.contains(lowered, F.col("brand"))).select("id", "brand").join(placed, "id", "left")
    own = hits.where("position IS NOT NULL").join(listed, ["position", "brand"]).select("id", "place", "brand")
    other = hits.where("position IS NULL").select("id", F.lit(0).alias("place"), "brand")
    named = own.union(other).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "brand"))).alias("named"))
    return named.select("id", F.col("named.brand").alias("brands"))


def tag_items(df: DataFrame, text_col: str, dictionary: DataFrame) -> DataFrame:
    """Add category, family, subfamily, brands and, if the table has them, sizes from a dictionary table.

    The dictionary stays a table, however large: synonyms are looked up by a join on runs of words and brands by
    one on runs of characters, so the plan does not grow with it. A text of some category has the brands of that
    category, any other those of all; a null text has no tags. All other columns of ``df`` stay as they are, of whatever name;
    one that is called like a tag gives way to it. Distinct texts move once and get numbers, by which all lookups go;
    each step is written before the next is planned. Rows find their tags by the SHA-256 of the text.
    """
    keep = [c for c in ("category", "family", "subfamily", "sizes") if c in dictionary.columns]
    dictionary = written(dictionary.select("position", *keep, "synonyms", "brands"), "dictionary")
    key = lambda text: F.unhex(F.sha2(text.cast("binary"), 256))
    texts = df.select(F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL").distinct()
    texts = written(texts.withColumn("id", F.monotonically_increasing_id()), "texts")
    placed = written(_category_of(texts, dictionary), "placed")
    brands = written(_brands_of(texts, placed, dictionary), "brands")
    found = texts.select("id", key(F.col("text")).alias("key")).join(placed, "id", "left").join(brands, "id", "left")
    found = found.join(dictionary.select("position", F.struct(*keep).alias("entry")), "position", "left").select("key", "entry", "brands")
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    text = F.col(f"row.`{text_col}`")
    rows = row.join(found, key(text) == F.col("key"), "left")
    tags = {c: F.col(f"entry.{c}") for c in keep if c != "sizes"}
    tags["brands"] = F.coalesce("brands", F.array().cast("array<string>"))
    if "sizes" in keep:
        pairs = F.flatten(F.transform(F.map_entries("entry.sizes"), lambda e: F.transform(
            e["value"], lambda label: F.struct(e["key"].alias("kind"), label.alias("label")))))
        size = F.get(F.filter(pairs, lambda s: F.contains(F.lower(F.trim(text)), s["label"])), F.lit(0))
        tags |= {"size_label": size["label"], "size_kind": size["kind"]}
    kept = [F.col(f"row.`{c}`") for c in df.columns if c not in tags]
    return rows.select(*kept, *(tag.alias(name) for name, tag in tags.items()))


def catalog_dictionary(catalog: DataFrame) -> DataFrame:
    """A dictionary table made from the catalogue itself.

    Each family and each subfamily is a category called by its own name, with and without
    accents. A subfamily comes after the families, so its name wins where both are alike.
    """
    named = catalog.where(P.present("family"))
    families = named.select("family", F.lit(None).cast("string").alias("subfamily"),
                            F.col("family").alias("name"), F.lit(0).alias("level"))
    subfamilies = named.where(P.present("subfamily")).groupBy("subfamily").agg(
        F.max("family").alias("family")).select(
        "family", "subfamily", F.col("subfamily").alias("name"), F.lit(1).alias("level"))
    return families.distinct().unionByName(subfamilies).select(
        F.struct("level", "name").alias("position"),
        F.lower("name").alias("category"), "family", "subfamily",
        F.array_distinct(F.array(F.lower("name"), T.fold(F.col("name")))).alias("synonyms"),
        F.array().cast("array<string>").alias("brands"),
    )


def subfamily_to_family(catalog: DataFrame) -> DataFrame:
    """Family of each subfamily; where the catalogue has several, the last by name."""
    named = catalog.where(P.present("subfamily") & P.present("family"))
    return named.groupBy("subfamily").agg(F.max("family").alias("family"))



# ---- single tags ---------------------------------------------------------------

def category_number(lowered: Column, dictionary: Dictionary) -> Column:
    """Number of the category whose longest synonym stands in the text as whole words.

    Of synonyms equally long the one listed first wins.
    """
    owner = dictionary.synonyms()
    ranked = sorted(owner, key=len, reverse=True)
    if not ranked:
        return F.lit(None).cast("int")
    owners = F.array(*[F.lit(owner[s]) for s in ranked])
    return F.get(owners, T.best_rank(lowered, ranked))


def _of_category(number: Column, values: Sequence[str | None]) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), number)


def brands_in(lowered: Column, number: Column, dictionary: Dictionary) -> Column:
    """Brands found in the text: those of its category, or of all where it has none."""
    per_category = F.array(*[T.string_array([b.lower() for b in c.brands]) for c in dictionary.categories])
    candidates = F.when(number.isNull(), T.string_array(dictionary.brands())).otherwise(
        F.get(per_category, number))
    return F.filter(candidates, lambda brand: F.contains(lowered, brand))


def size_in(lowered: Column, number: Column, dictionary: Dictionary) -> Column:
    """First size spelling of the category found in the text, as (kind, label), else null."""
    def spellings(category: Category) -> Column:
        pairs = [F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"))
                 for kind, labels in category.sizes.items() for label in labels]
        empty = F.array().cast("array<struct<kind:string,label:string>>")
        return F.array(*pairs) if pairs else empty

    options = F.get(F.array(*[spellings(c) for c in dictionary.categories]), number)
    return F.get(F.filter(options, lambda s: F.contains(lowered, s["label"])), F.lit(0))


def amount_in(lowered: Column, opening: str, units: Mapping[str, int]) -> Column:
    """Amount after an opening such as "más de", in the base unit; null where there is none."""
    names = "|".join(sorted(units, key=len, reverse=True))
    pattern = rf"(?U)(?:{opening})\s*(\d+(?:[.,]\d*)?)\s*({names})\b"
    number = F.regexp_extract(lowered, pattern, 1)
    unit = F.regexp_extract(lowered, pattern, 2)
    factor = F.element_at(F.create_map(*[F.lit(x) for pair in units.items() for x in pair]), unit)
    return F.when(number != "", F.floor(F.replace(number, F.lit(","), F.lit(".")).try_cast("double")
                                        * factor).try_cast("int"))


def supplier_in(folded: Column, suppliers: Sequence[str]) -> Column:
    """First listed supplier that stands in the text as whole words, without accents."""
    names = list(dict.fromkeys(T.fold_word(s) for s in suppliers))
    if not names:
        return F.lit(None).cast("string")
    return F.get(F.array(*[F.lit(n) for n in names]), T.best_rank(folded, names))


def top_n_in(lowered: Column) -> Column:
    """First number standing alone if it is a sensible list length, else ten."""
    number = F.when(lowered.rlike("[0-9]"), F.regexp_extract(lowered, r"(?U)\b(\d+)\b", 1)).try_cast("int")
    return F.when(number.between(*TOP_N_RANGE), number).otherwise(F.lit(DEFAULT_TOP_N))


def period_in(folded: Column, as_of: Column) -> tuple[Column, Column]:
    """First and last day of the period asked for; null where none is named."""
    def says(*phrases: str) -> Column:
        return T.any_phrase(folded, phrases)

    # fixed values: named periods, in the order they are looked for
    rules = (
        (says("hoy"), as_of),
        (says("esta semana"), F.date_sub(as_of, 7)),
        (says("este mes", "mes actual"), P.month_start(as_of)),
        (says("último mes"), F.date_sub(as_of, 30)),
        (says("últimos 90", "90 días"), F.date_sub(as_of, 90)),
        (says("2026") & says("mayo"), P.as_date("2026-05-01")),
        (says("2026") & says("junio"), P.as_date("2026-06-01")),
        (says("mayo"), F.make_date(F.year(as_of), F.lit(5), F.lit(1))),
        (says("desde apertura", "apertura sabin"), P.as_date(K.EVENT_DATE)),
    )
    start = F
    for test, day in rules:
        start = start.when(test, day)
    start = start.otherwise(F.lit(None).cast("date"))
    return start, F.when(start.isNotNull(), as_of)


# ---- all tags -------------------------------------------------------------------

TAGS = (
    "category", "family", "subfamily", "brands", "size_label", "size_kind", "min_cc", "max_cc",
    "min_g", "max_g", "supplier", "branches", "wants_price", "wants_ranking", "wants_stock",
    "wants_alert", "wants_season", "top_n", "date_from", "date_to",
)


def tag_texts(
    df: DataFrame, text_col: str, dictionary: Dictionary, as_of: P.DateLike,
) -> DataFrame:
    """Add every tag to a table (or stream) of texts."""
    text = F.lower(F.trim(F.col(text_col)))
    lowered, folded = F.col("_lowered"), F.col("_folded")
    number, found, bought = F.col("_number"), F.col("_brands"), F.col("_bought")
    size = F.col("_size")
    day = P.as_date(as_of)
    start, end = period_in(folded, day)
    categories = dictionary.categories
    return (
        df.withColumns({"_lowered": text, "_folded": T.fold(text)})
        .withColumn("_number", category_number(lowered, dictionary))
        .withColumns({
            "_brands": brands_in(lowered, number, dictionary),
            "_size": size_in(lowered, number, dictionary),
        })
        # "buy from <brand>" names a supplier, not an item
        .withColumn("_bought", T.any_phrase(folded, W.BUY_WORDS) & (F.size(found) > 0))
        .withColumns({
            "category": _of_category(number, [c.key for c in categories]),
            "family": _of_category(number, [c.family for c in categories]),
            "subfamily": _of_category(number, [c.subfamily for c in categories]),
            "brands": F.when(bought, T.string_array([])).otherwise(found),
            "size_label": size["label"],
            "size_kind": size["kind"],
            "min_cc": amount_in(lowered, f"{W.MORE_THAN}|{W.ABOVE}", W.VOLUME_UNITS),
            "max_cc": amount_in(lowered, f"{W.LESS_THAN}|{W.BELOW}", W.VOLUME_UNITS),
            "min_g": amount_in(lowered, W.MORE_THAN, W.WEIGHT_UNITS),
            "max_g": amount_in(lowered, W.LESS_THAN, W.WEIGHT_UNITS),
            "supplier": F.coalesce(supplier_in(folded, dictionary.suppliers),
                                   F.when(bought, F.get(found, F.lit(0)))),
            "branches": T.found_in(lowered, dictionary.branches),
            "wants_price": T.any_phrase(folded, W.PRICE_WORDS, W.PRICE_WHOLE_WORDS),
            "wants_ranking": T.any_phrase(folded, W.RANKING_WORDS),
            "wants_stock": T.any_phrase(folded, W.STOCK_WORDS),
            "wants_alert": T.any_phrase(folded, W.ALERT_WORDS),
            "wants_season": T.any_phrase(folded, W.SEASON_WORDS),
            "top_n": top_n_in(lowered),
            "date_from": start,
            "date_to": end,
        })
        .drop("_lowered", "_folded", "_number", "_brands", "_size", "_bought")
    )


def tag_category(df: DataFrame, text_col: str, dictionary: Dictionary) -> DataFrame:
    """Add category, family and subfamily alone."""
    number = F.col("_number")
    categories = dictionary.categories
    return (
        df.withColumn("_number", category_number(F.lower(F.trim(F.col(text_col))), dictionary))
        .withColumns({
            "category": _of_category(number, [c.key for c in categories]),
            "family": _of_category(number, [c.family for c in categories]),
            "subfamily": _of_category(number, [c.subfamily for c in categories]),
        })
        .drop("_number")
    )
