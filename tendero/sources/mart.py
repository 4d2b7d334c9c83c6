"""The mart: four tables read by name, checked against a schema, written by month."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tendero import constants as K
from tendero.operators.trend import Rollup
from tendero.sources.snapshots import DAILY, LATEST, LINES, MONTHS, SOLD, Snapshot, can_keep, line_batches, publish, read_batches, snapshot, write_batch


@dataclass(frozen=True)
class Mart:
    """The four frames every operator works on.

    ``newest`` is the newest sale date of ``tickets`` as a whole, where the version that was read tells it: the day to
    pass to reports over those lines. A frame cut from ``tickets`` has a newest day of its own. ``latest`` holds the latest
    lines of ``tickets``, where the mart keeps them: a small table that reports on latest sale prices can take for all lines;
    ``rollup`` likewise has what trends are added up from, and ``sold`` the day totals that ``operators.daybook`` reports on.
    """

    tickets: DataFrame
    alerts: DataFrame
    last_prices: DataFrame
    catalog: DataFrame
    newest: dt.date | None = None
    latest: DataFrame | None = None
    rollup: Rollup | None = None
    sold: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in SCHEMAS}


# ---- columns an operator may rely on ----------------------------------------
# Stock per branch (stk_*) and units to send per branch (order_*) are open-ended:
# every column with the prefix is carried along.

TICKETS_SCHEMA = T.StructType([
    T.StructField("sale_date", T.DateType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("item_key", T.LongType()),
    T.StructField("description", T.StringType()),
    T.StructField("family", T.StringType()),
    T.StructField("subfamily", T.StringType()),
    T.StructField("branch", T.StringType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("price_total", T.DoubleType()),
    T.StructField("cost_total", T.DoubleType()),
    T.StructField("price_unit", T.DoubleType()),
    T.StructField("cost_unit", T.DoubleType()),
    T.StructField("margin_ratio", T.DoubleType()),
])

ALERTS_SCHEMA = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("item_key", T.LongType()),
    T.StructField("description", T.StringType()),
    T.StructField("family", T.StringType()),
    T.StructField("subfamily", T.StringType()),
    T.StructField("supplier", T.StringType()),
    T.StructField("pack_units", T.LongType()),
    T.StructField("units_90d", T.LongType()),
    T.StructField("stk_total", T.LongType()),
    T.StructField("days_cover", T.LongType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("restock_alert", T.StringType()),
    T.StructField("abc_class", T.StringType()),
    T.StructField("to_order", T.LongType()),
    T.StructField("budget", T.DoubleType()),
    T.StructField("price_now", T.DoubleType()),
    T.StructField("cost_unit", T.DoubleType()),
    T.StructField("below_cost", T.BooleanType()),
    T.StructField("excess", T.LongType()),
    T.StructField("lost_value", T.DoubleType()),
    T.StructField("lost_units", T.LongType()),
    T.StructField("month_rank", T.LongType()),
    T.StructField("active_months", T.LongType()),
])

LAST_PRICES_SCHEMA = T.StructType([
    T.StructField("item_key", T.LongType()),
    T.StructField("last_cost", T.DoubleType()),
    T.StructField("last_po_date", T.DateType()),
    T.StructField("po_supplier", T.StringType()),
])

CATALOG_SCHEMA = T.StructType([
    T.StructField("item_key", T.LongType()),
    T.StructField("description", T.StringType()),
    T.StructField("family", T.StringType()),
    T.StructField("subfamily", T.StringType()),
    T.StructField("supplier", T.StringType()),
    T.StructField("stk_total", T.DoubleType()),
])

# type of the open-ended per-branch columns
BRANCH_PREFIXES = ("stk_", "order_")
BRANCH_TYPES = {"alerts": T.LongType(), "catalog": T.DoubleType()}

SCHEMAS = {
    "tickets": TICKETS_SCHEMA,
    "alerts": ALERTS_SCHEMA,
    "last_prices": LAST_PRICES_SCHEMA,
    "catalog": CATALOG_SCHEMA,
}

# ---- fixed values: table and column names of the retailer's warehouse --------
SOURCE_TABLES = {
    "tickets": "tickets_all",
    "alerts": "result_final_alert_all",
    "last_prices": "ultimos_precios",
    "catalog": "proveedores",
}
SOURCE_COLUMNS = {
    "tickets": {
        "fecha_comprobante": "sale_date",
        "idarticulo": "item_id",
        "idartalfa": "item_key",
        "descripcion": "description",
        "familia": "family",
        "subfamilia": "subfamily",
        "sucursal": "branch",
        "cantidad_total": "quantity",
        "precio_total": "price_total",
        "costo_total": "cost_total",
        "precio_unitario": "price_unit",
        "costo_unitario": "cost_unit",
        "margen_porcentual": "margin_ratio",
    },
    "alerts": {
        "idarticulo": "item_id",
        "idarticuloalfa": "item_key",
        "descripcion": "description",
        "familia": "family",
        "subfamilia": "subfamily",
        "proveedor": "supplier",
        "uxb": "pack_units",
        "cant_total": "units_90d",
        "dias_cobertura": "days_cover",
        "nivel_riesgo": "risk_level",
        "alerta_reabastecer": "restock_alert",
        "clase_abc": "abc_class",
        "total_abastecer": "to_order",
        "cor_abastecer": "order_corrientes",
        "exp_abastecer": "order_express",
        "for_abastecer": "order_formosa",
        "sab_abastecer": "order_sabin",
        "hip_abastecer": "order_hiper",
        "presupuesto": "budget",
        "precio_actual": "price_now",
        "costo_unit": "cost_unit",
        "precio_bajo_costo": "below_cost",
        "exceso_stk": "excess",
        "valor_perdido_total": "lost_value",
        "unidades_perdidas_total": "lost_units",
        "ranking_mes": "month_rank",
        "mes_actual": "month_share",
        "meses_act_estac": "active_months",
    },
    "last_prices": {
        "idartalfa": "item_key",
        "ultimo_precio_compra": "last_cost",
        "fecha_ultima_oc": "last_po_date",
        "proveedor_oc": "po_supplier",
        "fecha_extraccion": "extracted_on",
    },
    "catalog": {
        "idartalfa": "item_key",
        "idarticulo": "item_id",
        "idarticuloalfa": "item_key_alt",
        "descripcion": "description",
        "familia": "family",
        "subfamilia": "subfamily",
        "proveedor": "supplier",
        "uxb": "pack_units",
    },
}


# ---- reading ----------------------------------------------------------------

def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename by a source-to-ours map; the match ignores case, the rest stays lower-cased."""
    ours = {source.lower(): name for source, name in names.items()}
    return df.toDF(*[ours.get(c.lower(), c.lower()) for c in df.columns])


def parse_date(column: str) -> F.Column:
    """Text to date; text that is no date becomes null instead of failing the job."""
    return F.col(column).try_cast("date")


def unparsed_dates(df: DataFrame, column: str = "sale_date") -> DataFrame:
    """Rows in all, rows with a usable date and rows whose date text is unusable."""
    raw, parsed = F.col(column), parse_date(column)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(parsed).alias("dated"),
        F.count_if(raw.isNotNull() & parsed.isNull()).alias("unusable"),
    )


def conform(df: DataFrame, table: str) -> DataFrame:
    """Check that the table's columns exist and give each its type; keep the others.

    Dates held as text are converted here, once, so that filters on them stay
    plain comparisons. A value that does not fit its type becomes null.
    """
    wanted = {f.name: f.dataType for f in SCHEMAS[table]}
    have = {c.lower() for c in df.columns}
    missing = [name for name in wanted if name not in have]
    if missing:
        raise ValueError(f"{table}: missing columns: {', '.join(missing)}")
    out = []
    for field in df.schema:
        name = field.name.lower()
        target = wanted.get(name)
        if target is None and name.startswith(BRANCH_PREFIXES):
            target = BRANCH_TYPES.get(table)
        same = target is None or target == field.dataType
        out.append(F.col(field.name) if same else F.col(field.name).try_cast(target).alias(name))
    return df.select(*out)


def nulled_values(df: DataFrame, table: str) -> DataFrame:
    """``column_name, filled, nulled`` for each typed column of a table about to be conformed.

    ``nulled`` counts the values that :func:`conform` will turn into null because they do not fit.
    """
    wanted = {f.name: f.dataType for f in SCHEMAS[table]}
    counts = []
    for field in df.schema:
        target = wanted.get(field.name.lower())
        if target is None and field.name.lower().startswith(BRANCH_PREFIXES):
            target = BRANCH_TYPES.get(table)
        if target is not None:
            value = F.col(field.name)
            lost = F.lit(False) if target == field.dataType else value.isNotNull() & value.try_cast(target).isNull()
            counts.append(F.struct(F.lit(field.name.lower()).alias("column_name"), F.count(value).alias("filled"), F.count_if(lost).alias("nulled")))
    return df.agg(F.array(*counts).alias("counts")).select(F.inline("counts"))


def load_report(
    spark: SparkSession,
    path: str,
    tables: Mapping[str, str] | None = None,
    columns: Mapping[str, Mapping[str, str]] | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """``table_name, column_name, filled, nulled``: what :func:`load_mart` with the same arguments loses."""
    tables, columns = tables or {}, columns or {}
    parts = []
    for name in SCHEMAS:
        df = spark.read.format(fmt).load(f"{path.rstrip('/')}/{tables.get(name, name)}")
        df = rename_columns(df, columns[name]) if name in columns else df
        parts.append(nulled_values(df, name).select(F.lit(name).alias("table_name"), "*"))
    return reduce(DataFrame.unionByName, parts)


def make_mart(**tables: DataFrame) -> Mart:
    return Mart(**{name: conform(df, name) for name, df in tables.items()})


def load_mart(
    spark: SparkSession,
    path: str,
    tables: Mapping[str, str] | None = None,
    columns: Mapping[str, Mapping[str, str]] | None = None,
    fmt: str = "parquet",
    version: int | None = None,
) -> Mart:
    """Read the four tables under ``path``.

    ``tables`` and ``columns`` give the names used in the source; pass
    ``SOURCE_TABLES`` and ``SOURCE_COLUMNS`` for a warehouse extract, nothing for a
    folder written by ``write_mart``. Of such a folder the newest version is read, or the one asked for.
    """
    found = None if tables else snapshot(spark, path, version)
    if found:
        return mart_of(spark, found)
    if version is not None:
        raise ValueError(f"no version {version}")
    tables, columns = tables or {}, columns or {}
    frames = {}
    for name in SCHEMAS:
        df = spark.read.format(fmt).load(f"{path.rstrip('/')}/{tables.get(name, name)}")
        frames[name] = rename_columns(df, columns[name]) if name in columns else df
    return make_mart(**frames)


def mart_of(spark: SparkSession, found: Snapshot) -> Mart:
    """The tables of one version."""
    mart = make_mart(**{name: read_batches(spark, found.base, found.of(name)) for name in SCHEMAS})
    kept = {name: read_batches(spark, found.base, found.of(name)) for name in (LATEST, DAILY, MONTHS, SOLD) if found.of(name)}
    late = min((b.oldest for b in found.of(DAILY)[1:] if b.oldest), default=None)
    rollup = Rollup(kept[DAILY], kept.get(MONTHS), late) if DAILY in kept else None
    return replace(mart, newest=found.newest, latest=kept.get(LATEST), rollup=rollup, sold=kept.get(SOLD))


# ---- writing ----------------------------------------------------------------

def write_mart(mart: Mart, path: str, mode: str = "overwrite") -> Snapshot:
    """Write the four tables as the next version of the mart under ``path``.

    They replace what is there, or with ``mode="append"`` are added to it. The version counts once all
    four are written; until then, and if the job breaks off, readers see the one before. What reports on latest prices (of lines with
    ``order_id`` and ``line_no``) and trends need is kept beside the lines, and later appends add theirs.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode: {mode}")
    batches = line_batches(mart.tickets, path, can_keep(mart.tickets))
    batches += [write_batch(df, path, name) for name, df in mart.tables().items() if name != LINES]
    return publish(mart.tickets.sparkSession, path, batches, mode == "overwrite")


# ---- caller's own SQL -------------------------------------------------------

_OPENING = re.compile(r"(?:\s|--[^\n]*(?:\n|$)|/\*.*?\*/)*(select|with)\b", re.IGNORECASE | re.DOTALL)
#: Parts of an analysed plan that read nothing by themselves.
_OWN_LEAVES = {"OneRowRelation", "LocalRelation", "ResolvedInlineTable", "CTERelationRef", "UnionLoopRef"}
#: Parts that run programs.
_OUTSIDE = {"ScriptTransformation"}


def check_select(sql: str) -> str:
    """The statement without its closing semicolon; ``ValueError`` if it is empty or opens as no SELECT or WITH."""
    text = re.sub(r"[\s;]+$", "", sql or "")
    if not text:
        raise ValueError("empty statement")
    if not _OPENING.match(text):
        raise ValueError("only SELECT or WITH statements are allowed")
    return text


def _items(found: Any) -> list:
    return [found.apply(i) for i in range(found.size())]


def foreign_parts(rows: DataFrame, views: set[str]) -> list[str]:
    """What the analysed plan of some rows reads or calls besides the given views.

    Names are already resolved in it, each in its own scope, so the plan is looked at and not the text: every
    leaf must lie in one of the views, and no expression may call into the JVM.
    """
    found, plans = [], [rows._jdf.queryExecution().analyzed()]
    while plans:
        node = plans.pop()
        kind = node.getClass().getSimpleName()
        below = _items(node.children())
        if kind == "View":
            name = node.desc().identifier().table()
            if name not in views:
                found.append(name)
            continue
        if kind in _OUTSIDE or not below and kind not in _OWN_LEAVES:
            found.append(str(node.simpleString(100)))
        plans += below + _items(node.subqueries())
        calls = _items(node.expressions())
        while calls:
            call = calls.pop()
            if call.prettyName().lower() in K.FORBIDDEN_CALLS:
                found.append(call.prettyName())
            calls += _items(call.children())
    return sorted(set(found))


def run_select(
    spark: SparkSession,
    sql: str,
    mart: Mart | Mapping[str, DataFrame] | None = None,
    args: Mapping[str, object] | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Run a caller's SELECT over the mart's tables; ``max_rows`` cuts the result, None keeps all.

    The statement sees the given tables under their names and nothing else: no other table or view, no
    files by path, no call into the JVM, no program. The caller's own views stay as they are. It must be one query:
    it is parsed as a subquery, which no other kind of statement can be, and nothing of it runs before its plan has been
    looked at. Values belong in ``args`` as named parameters (``:since``), never in the text.
    """
    statement = check_select(sql)
    tables = mart.tables() if isinstance(mart, Mart) else dict(mart or {})
    names = {name: f"tendero_{uuid.uuid4().hex}" for name in tables}
    try:
        for name, view in names.items():
            tables[name].createTempView(view)
        given = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in names.items())
        rows = spark.sql(f"{f'WITH {given} ' if given else ''}SELECT * FROM (\n{statement}\n)", args=dict(args or {}))
    except ParseException as wrong:
        raise ValueError(f"only one SELECT or WITH statement is allowed: {wrong}") from wrong
    except AnalysisException as wrong:
        if wrong.getCondition() != "TABLE_OR_VIEW_NOT_FOUND":
            raise
        raise ValueError(f"not a table of the mart: {wrong}") from wrong
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)
    foreign = foreign_parts(rows, set(names.values()))
    if foreign:
        raise ValueError(f"not of the mart: {', '.join(foreign)}")
    return rows if max_rows is None else rows.limit(max_rows)
