"""Lists of choices read from the item catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tendero.functions import predicates as P
from tendero.plans.filters import keep


def families(catalog: DataFrame) -> DataFrame:
    return keep(catalog, P.present("family")).select("family").distinct().orderBy("family")


def subfamilies(catalog: DataFrame, family: str | None = None) -> DataFrame:
    rows = keep(catalog, P.present("subfamily"), P.equals("family", family) if family else None)
    return rows.select("subfamily").distinct().orderBy("subfamily")


def suppliers(catalog: DataFrame, family: str | None = None, subfamily: str | None = None) -> DataFrame:
    rows = keep(catalog, P.present("supplier"),
                P.equals("family", family) if family else None,
                P.equals("subfamily", subfamily) if subfamily else None)
    return rows.select(F.trim("supplier").alias("supplier")).distinct().orderBy("supplier")
