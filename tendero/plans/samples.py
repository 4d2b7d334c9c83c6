"""Parameters of the registered queries, and questions derived from the item table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from tendero.operators.tagging import Category, Dictionary
from tendero.sources.star import read_table

SALE_BRANCHES = ("africa", "america", "asia", "europe")
ALL_BRANCHES = SALE_BRANCHES + ("middle east",)
AS_OF = dt.date(2001, 11, 4)
CUT_DATE = dt.date(1999, 1, 1)
EVENT_DATE = dt.date(2001, 6, 6)
EVENT_START = dt.date(2001, 5, 1)
YEARS = (1999, 2000, 2001)

DICTIONARY = Dictionary(
    categories=(
        Category("ring", "STANDARD", "Brand#2", ("ring", "rings", "red ring"),
                 ("small", "large", "red"), {"cc": ("550cc", "900cc")}),
        Category("gear", "ECONOMY", None, ("gear", "gears", "hot gear"), ("hot", "cold")),
        Category("anvil", "MEDIUM", "Brand#4", ("anvil",)),
        Category("plate", "PROMO", "Brand#17", ("plate", "plates", "old plate"),
                 ("old", "new"), {"ml": ("500ml",), "kg": ("2 kg", "1 kg")}),
        Category("gizmo", "LARGE", "Brand#5", ("gizmo",), ("small", "new")),
        Category("bolt", "SMALL", "Brand#6", ("bolt", "bolts"), ("blue", "cold")),
        Category("rod", None, "Brand#7", ("rod", "rods"), ("red", "hot")),
        Category("widget", "STANDARD", None, ("widget", "red ring", "café"), ("large", "blue")),
    ),
    suppliers=("tremblay", "don gastón", "la serenísima", "serenísima"),
    branches=ALL_BRANCHES,
)

# words frequent in the conversation texts, standing in for item names
LANGUAGE_DICTIONARY = Dictionary(
    categories=(
        Category("english", "germanic", "west", ("the", "and", "of the", "that"), ("tion", "hand")),
        Category("german", "germanic", "west", ("der", "die", "und", "nicht", "und der"), ("keit", "schaft")),
        Category("french", "romance", "gallo", ("le", "la", "dans", "de la", "elle"), ("eau", "ment")),
        Category("spanish", "romance", "iberian", ("el", "la", "los", "que la", "para"), ("ción", "dad")),
    ),
)

QUESTIONS = (
    "cuáles se venden bajo el costo", "cuánto perdimos por quiebre en", "qué sucursal vendió más",
    "qué tengo que comprarle a Tremblay de", "cuánto tengo que pedir de", "qué ponemos en OFERTA de",
    "qué viene subiendo en", "cuánto dinero perdí con", "costo de reposición de",
    "qué conviene ofrecer de", "sabin le quitó ventas a hiper en", "presupuesto de compra de",
    "exceso de stock de", "cuál es la familia con mejor margen de",
    "qué genera más plata pero casi no me deja en", "clasificar productos críticos de",
    "comparar precio venta vs compra de", "precio de compra de los 30 más vendidos de",
    "último precio de", "los más vendidos con riesgo de quiebre de", "stock de", "top 5 de", "",
    "CAFÉ y", "orden de compra para", "alertas de stock de", "qué temporada conviene para",
    "precio oc de", "Cuánto SALE", "proveedor don gastón:", "focos y tocador de",
)
SIZES = ("", "de más de 900cc", "de más de 1,5 litros", "de menos de 500ml", "de mas de 2 kg",
         "menor a 250 gramos", "x550cc")
PERIODS = ("", "hoy", "esta semana", "este mes", "último mes", "últimos 90 días", "en mayo 2026",
           "en junio de 2026", "desde mayo", "desde apertura", "más de 3 lavarropas")
PLACES = ("", "en africa", "en Asia y Europe", "en middle east", "para plate y rings")


def pick(values: tuple[str, ...]) -> F.Column:
    index = (F.col("p_partkey") % len(values)).cast("int")
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """One question per item, made of its name and phrases chosen by its key."""
    key, name = F.col("p_partkey"), F.col("p_name")
    item = F.when(key % 13 == 0, F.lit("")).when(key % 3 == 0, F.upper(name)).otherwise(name)
    text = F.concat_ws(" ", pick(QUESTIONS), item, pick(SIZES), pick(PERIODS), pick(PLACES))
    return read_table(spark, folder, "part").select(key.alias("question_id"), text.alias("text"))
