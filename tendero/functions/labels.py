"""Labels and bands derived from one number."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tendero import constants as K
from tendero.functions.predicates import as_col

# fixed values: coverage labels, upper bound in days of cover -> label
AT_RISK_LABELS = ((3, "🔴 CRÍTICO"), (7, "🟠 URGENTE"), (14, "🟡 BAJO"))
AT_RISK_NO_STOCK = "🔴 SIN STOCK"
AT_RISK_ELSE = "🟡 PRECAUCIÓN"
CRITICAL_LABELS = ((3, "🔴 CRÍTICO"), (7, "🟠 URGENTE"), (14, "🟡 BAJO"))
CRITICAL_ELSE = "🟢 OK"

# fixed values: urgency index, lower bound -> suggested action
URGENCY_ACTIONS = ((0.7, "🔴 Comprar ya"), (0.5, "🟠 OC próximos días"), (0.3, "🟡 Monitorear"))
URGENCY_ELSE = "🟢 Sin urgencia"


def coverage_label(column: str | Column, scheme: str = "at_risk") -> Column:
    """Label for the days of cover: ``at_risk`` has five levels, ``critical`` four."""
    cover = as_col(column)
    if scheme == "at_risk":
        chain, bounds, rest = F.when(cover == 0, AT_RISK_NO_STOCK), AT_RISK_LABELS, AT_RISK_ELSE
    elif scheme == "critical":
        chain, bounds, rest = F, CRITICAL_LABELS, CRITICAL_ELSE
    else:
        raise ValueError(f"unknown coverage scheme: {scheme}")
    for upper, label in bounds:
        chain = chain.when(cover <= upper, label)
    return chain.otherwise(rest)


def urgency_action(column: str | Column) -> Column:
    """Suggested action; a missing index falls to the lowest level."""
    index, chain = as_col(column), F
    for lower, label in URGENCY_ACTIONS:
        chain = chain.when(index >= lower, label)
    return chain.otherwise(URGENCY_ELSE)


def margin_band(column: str | Column) -> Column:
    """Margin percent as negative, low (under ten) or healthy."""
    margin = as_col(column)
    return (F.when(margin < 0, "negative").when(margin < 10, "low")
            .when(margin.isNotNull(), "healthy"))


def trend_class(points: Column, slope: Column) -> Column:
    """Direction of sales: needs two days, and a slope beyond the threshold."""
    return (F.when(points < 2, K.TREND_FLAT)
            .when(slope > K.TREND_SLOPE, K.TREND_UP)
            .when(slope < -K.TREND_SLOPE, K.TREND_DOWN)
            .otherwise(K.TREND_FLAT))


def month_abbr(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in K.MONTH_ABBR]), month)


def day_label(day: Column) -> Column:
    """Short Spanish date such as ``4 nov``."""
    return F.concat_ws(" ", F.dayofmonth(day).cast("string"), month_abbr(F.month(day)))
