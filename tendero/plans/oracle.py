"""Independent SQL for every registered query, written for DuckDB.

The mart is restated here as views over the star schema, step by step, without the
single-pass shortcuts of the Spark jobs. Money is rounded through DECIMAL, so that a
half cent rounds up on both sides whatever order a sum was taken in.
"""

from __future__ import annotations

from tendero.functions import labels as L, words as W
from tendero.functions.text import fold_word
from tendero.plans import samples as X

# ---- the mart as views --------------------------------------------------------

VIEWS = {
    "tickets": ((), """
        SELECT CAST(l.l_shipdate AS DATE) AS sale_date,
               l.l_orderkey AS order_id, l.l_linenumber AS line_no,
               l.l_partkey AS item_id, l.l_partkey AS item_key, l.l_suppkey AS supplier_id,
               concat(p.p_name, ' x', CAST(p.p_size*50 AS VARCHAR), 'cc') AS description,
               p.p_type AS family, p.p_brand AS subfamily, lower(r.r_name) AS branch,
               l.l_quantity AS quantity,
               l.l_extendedprice*(1-l.l_discount) AS price_total,
               l.l_extendedprice*(0.95-l.l_tax) AS cost_total,
               l.l_extendedprice*(1-l.l_discount)/l.l_quantity AS price_unit,
               l.l_extendedprice*(0.95-l.l_tax)/l.l_quantity AS cost_unit,
               (0.05-l.l_discount+l.l_tax)/(1-l.l_discount) AS margin_ratio
        FROM lineitem l
        JOIN part p ON l.l_partkey = p.p_partkey
        JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN region r ON n.n_regionkey = r.r_regionkey"""),
    "catalog": ((), """
        SELECT b.item_key, b.description, b.family, b.subfamily, b.pack_units,
               CASE WHEN b.item_key % 3 = 0 THEN concat(s.s_name, '  ') ELSE s.s_name END AS supplier,
               b.stk_1, b.stk_2, b.stk_3, b.stk_4, b.stk_5, b.stk_6, b.stk_7,
               b.stk_1+b.stk_2+b.stk_3+b.stk_4+b.stk_5+b.stk_6+b.stk_7 AS stk_total
        FROM (SELECT p_partkey AS item_key,
                     concat(p_name, ' x', CAST(p_size*50 AS VARCHAR), 'cc') AS description,
                     p_type AS family, p_brand AS subfamily, CAST(p_size AS BIGINT) AS pack_units,
                     p_partkey % (SELECT count(*) FROM supplier) AS sk,
                     (p_partkey*7)%6 AS stk_1, (p_partkey*11)%5 AS stk_2, (p_partkey*13)%4 AS stk_3,
                     (p_partkey*17)%3 AS stk_4, (p_partkey*19)%2 AS stk_5,
                     p_partkey%2 AS stk_6, (p_partkey*5)%3 AS stk_7
              FROM part) b
        JOIN supplier s ON s.s_suppkey = b.sk"""),
    "last_sale": (("tickets",), """
        SELECT * FROM (
          SELECT t.*, ROW_NUMBER() OVER (PARTITION BY item_key
                 ORDER BY sale_date DESC, order_id, line_no) AS rn FROM tickets t) z
        WHERE rn = 1"""),
    "last_prices": (("last_sale",), """
        SELECT x.item_key, x.cost_unit AS last_cost, x.sale_date AS last_po_date,
               s.s_name AS po_supplier
        FROM last_sale x JOIN supplier s ON s.s_suppkey = x.supplier_id
        WHERE x.item_key % 50 <> 0"""),
    "month_units": (("tickets",), """
        SELECT item_key, RANK() OVER (PARTITION BY item_key ORDER BY q DESC) AS month_rank,
               COUNT(*) OVER (PARTITION BY item_key) AS active_months, m
        FROM (SELECT item_key, EXTRACT(MONTH FROM sale_date) AS m, SUM(quantity) AS q
              FROM tickets GROUP BY item_key, EXTRACT(MONTH FROM sale_date)) g"""),
    "alerts": (("catalog", "tickets", "last_sale", "month_units"), """
        SELECT y.*,
          CASE WHEN days_cover <= 7 THEN 'Sí' WHEN days_cover <= 14 THEN 'Ver' ELSE 'No' END AS restock_alert,
          CASE WHEN days_cover <= 7 THEN 'Alto' WHEN days_cover <= 14 THEN 'Medio'
               WHEN days_cover <= 30 THEN 'Bajo' ELSE 'Muy Bajo' END AS risk_level,
          CASE WHEN units_90d >= 60 THEN 'A' WHEN units_90d >= 30 THEN 'B'
               WHEN units_90d > 0 THEN 'C' ELSE '0' END AS abc_class,
          greatest(stk_total - need, 0) AS excess,
          need - stk_total AS to_order,
          need_2w - stk_1 AS order_1, need_2w - stk_2 AS order_2, need_2w - stk_3 AS order_3,
          need_2w - stk_4 AS order_4, need_2w - stk_5 AS order_5,
          greatest(need - stk_total, 0)*cost_unit AS budget,
          CASE WHEN days_cover = 0 THEN greatest(need - stk_total, 0) ELSE 0 END AS lost_units,
          CASE WHEN days_cover = 0 THEN greatest(need - stk_total, 0)*price_now ELSE 0 END AS lost_value,
          price_now < cost_unit AS below_cost
        FROM (
          SELECT c.*, c.item_key AS item_id, CAST(coalesce(u.units_90d, 0) AS BIGINT) AS units_90d,
                 CAST(CASE WHEN coalesce(u.units_90d, 0) = 0 THEN 999
                      ELSE floor(c.stk_total*90/u.units_90d) END AS BIGINT) AS days_cover,
                 CAST(round(coalesce(u.units_90d, 0)/3) AS BIGINT) AS need,
                 CAST(round(coalesce(u.units_90d, 0)/15) AS BIGINT) AS need_2w,
                 pr.price_unit AS price_now, pr.cost_unit AS cost_unit,
                 mu.month_rank, mu.active_months
          FROM catalog c
          LEFT JOIN (SELECT item_key, sum(quantity) AS units_90d FROM tickets
                     WHERE sale_date > (SELECT max(sale_date) FROM tickets) - INTERVAL '90' DAY
                     GROUP BY item_key) u ON c.item_key = u.item_key
          LEFT JOIN last_sale pr ON c.item_key = pr.item_key
          LEFT JOIN (SELECT * FROM month_units
                     WHERE m = (SELECT EXTRACT(MONTH FROM max(sale_date)) FROM tickets)) mu
                 ON c.item_key = mu.item_key) y"""),
}


def with_views(sql: str, *needed: str) -> str:
    """The statement with the views it needs in front, each after those it reads."""
    order: list[str] = []

    def add(name: str) -> None:
        for below in VIEWS[name][0]:
            add(below)
        if name not in order:
            order.append(name)

    for name in needed:
        add(name)
    views = [f"{name} AS MATERIALIZED ({VIEWS[name][1]})" for name in order]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        views.append(body[5:])
        return "WITH " + ",\n".join(views)
    return "WITH " + ",\n".join(views) + "\n" + body


# ---- building blocks ----------------------------------------------------------

def fx(value: str, places: int) -> str:
    """Half-up rounding of a double, free of the noise of summation order."""
    return f"CAST(ROUND(CAST({value} AS DECIMAL(38,6)), {places}) AS DOUBLE)"


def tot(column: str, places: int) -> str:
    return fx(f"SUM({column})", places)


def mil(value: str, places: int) -> str:
    return fx(f"({value})/1e6", places)


def ids(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def like_any(column: str, values) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{v.lower()}')" for v in values) + ")"


MEAN_MARGIN = fx("AVG(margin_ratio)*100", 1)
SUM_MARGIN = fx("(SUM(price_total)-SUM(cost_total))/NULLIF(SUM(price_total),0)*100", 1)
PROFIT = "price_total-cost_total"
FOUR = f"lower(branch) IN ({ids(X.SALE_BRANCHES)})"
FIVE = f"lower(branch) IN ({ids(X.ALL_BRANCHES)})"
LAST_DAY = "(SELECT max(sale_date) FROM tickets)"
PRICE_COLS = f"""{fx('op.last_cost', 2)} AS last_cost, trim(op.po_supplier) AS po_supplier,
    CAST(op.last_po_date AS DATE) AS last_po_date"""
STOCK = ", ".join(f"stk_{i}" for i in range(1, 8))
STOCK_DOUBLE = ", ".join(f"CAST(stk_{i} AS DOUBLE) AS stk_{i}" for i in range(1, 8))
ORDERS = ", ".join(f"order_{i}" for i in range(1, 6))

ORACLE: dict[str, str] = {}


def put(name: str, sql: str, *views: str) -> None:
    ORACLE[name] = with_views(sql, *views) if views else sql.strip()


# ---- sources ------------------------------------------------------------------

put("table_rows", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows, count(DISTINCT item_key) AS items FROM {t}"
    for t in ("tickets", "alerts", "last_prices", "catalog")),
    "tickets", "alerts", "last_prices", "catalog")
put("normalised_dates", """
    SELECT count(*) AS rows, count(TRY_CAST(d AS DATE)) AS dated,
           count(*) FILTER (WHERE d IS NOT NULL AND TRY_CAST(d AS DATE) IS NULL) AS unusable
    FROM (SELECT CASE WHEN l_linenumber = 7 THEN strftime(l_shipdate, '%d.%m.%Y')
                      ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS d FROM lineitem)""")
put("adhoc_select", """
    SELECT subfamily, count(*) AS items, CAST(sum(stk_total) AS BIGINT) AS stock, max(days_cover) AS max_cover
    FROM alerts WHERE family = 'PROMO' AND days_cover <= 30 GROUP BY subfamily ORDER BY subfamily""",
    "alerts")
put("adhoc_select_scoped", """
    SELECT 'update' AS word, CAST(days AS INT) AS days, count(item_key) AS items, CAST(sum(stk_total) AS BIGINT) AS stock
    FROM range(31) r(days) LEFT JOIN alerts ON family = 'PROMO' AND days_cover = days GROUP BY days""", "alerts")
put("detail_export", """
    SELECT description, trim(supplier) AS supplier, days_cover, to_order, budget FROM alerts
    WHERE budget > 0 ORDER BY budget DESC, item_key""", "alerts")
put("query_log", """
    SELECT 1000000000 + q.conv_id*60 + q.turn AS timestamp, q.text AS pregunta, a.text AS respuesta,
           CASE WHEN q.conv_id % 2 = 0 THEN 'template' ELSE 'ninguno' END AS modo,
           CASE WHEN q.turn > 0 THEN round_even(q.turn*0.25::DOUBLE, 1) END AS tiempo_seg
    FROM conversations q LEFT JOIN conversations a
      ON q.conv_id = a.conv_id AND q.turn + 1 = a.turn AND a.role = 'assistant'
    WHERE q.role = 'user'""")
_TURNS_ASKED = """
    SELECT 1000000000 + conv_id*7200 + turn AS asked_at,
           CAST(to_timestamp(1000000000 + conv_id*7200 + turn) AT TIME ZONE 'UTC' AS DATE) AS day, text AS pregunta,
           CASE WHEN length(role) > 0 THEN role ELSE 'ninguno' END AS modo,
           CASE WHEN turn <> 0 THEN round_even(turn*0.25::DOUBLE, 1) END AS tiempo_seg
    FROM conversations"""
put("folded_query_log", _TURNS_ASKED)
put("questions_by_day", f"""
    SELECT day, modo, count(*) AS questions, sum(tiempo_seg) AS seconds FROM ({_TURNS_ASKED})
    WHERE day BETWEEN DATE '2001-09-15' AND DATE '2001-09-28' GROUP BY day, modo""")
put("load_report", """
    SELECT 'sale_date' AS column_name, count(*) AS filled, count(*) FILTER (WHERE l_linenumber = 7) AS nulled FROM lineitem
    UNION ALL SELECT 'item_key', count(*), count(*) FILTER (WHERE l_linenumber = 6) FROM lineitem
    UNION ALL SELECT 'quantity', count(*), 0 FROM lineitem""")
put("filter_date_to", """
    SELECT family, count(*) AS lines FROM tickets WHERE sale_date <= DATE '1995-12-31' GROUP BY family""", "tickets")
put("pack_size_matches", """
    WITH c AS (SELECT TRY_CAST(regexp_extract(lower(description), 'x([0-9]+)cc', 1) AS DOUBLE) AS cc FROM catalog)
    SELECT count(*) FILTER (WHERE cc >= 960) AS from_960, count(*) FILTER (WHERE cc < 355) AS below_355,
           CAST(0 AS BIGINT) AS from_500g, count(cc) AS with_volume, max(cc) AS largest FROM c""", "catalog")

_FILTERS = {
    "subfamily_contains": ("tickets", "lower(subfamily) LIKE '%brand#2%'"),
    "subfamily_equals": ("tickets", "subfamily = 'Brand#2'"),
    "family_equals": ("tickets", "family = 'PROMO'"),
    "brands": ("tickets", "lower(description) LIKE '%red%' OR lower(description) LIKE '%blue%'"),
    "branches": ("tickets", "lower(branch) IN ('asia','europe')"),
    "branches_exact": ("tickets", "branch IN ('asia','Europe')"),
    "period": ("tickets", "sale_date BETWEEN DATE '2000-02-01' AND DATE '2000-02-29'"),
    "since_month_start": ("tickets", f"sale_date >= date_trunc('month', {LAST_DAY})"),
    "last_7_days": ("tickets", f"sale_date >= {LAST_DAY} - INTERVAL 6 DAY"),
    "month": ("tickets", "strftime(sale_date, '%Y-%m') = '2000-02'"),
    "years": ("tickets", "EXTRACT(YEAR FROM sale_date) IN (1996, 1998)"),
    "previous_month": ("tickets", f"""EXTRACT(YEAR FROM sale_date)*12 + EXTRACT(MONTH FROM sale_date)
        = EXTRACT(YEAR FROM {LAST_DAY})*12 + EXTRACT(MONTH FROM {LAST_DAY}) - 1"""),
    "size_label": ("tickets", like_any("description", ["500g", "500 g", "x500", "x500g", "500gr"])),
    "min_volume": ("tickets", like_any("description", [
        "960", "960cc", "1000", "1l", "1 l", "1000ml", "litro", "x1l", "x 1l", "1lt", "1.5l", "1,5l",
        "1.5 l", "1500ml", "2l", "2 l", "2000ml", "x2l", "2lt", "2 lt", "3l", "3 l", "3000ml"])),
    "min_volume_fallback": ("tickets", "lower(description) LIKE '%5000%'"),
    "max_volume": ("tickets", like_any("description", [
        "220cc", "x220", "250cc", "x250", "250ml", "330cc", "330ml", "x330", "354cc", "354ml", "x354"])),
    "max_volume_fallback": ("tickets", "lower(description) LIKE '%100%'"),
    "min_weight": ("tickets", like_any("description", [
        "500g", "500 g", "x500", "1kg", "1 kg", "x1kg", "1000g", "2kg", "2 kg"])),
    "min_weight_fallback": ("tickets", "lower(description) LIKE '%9000g%'"),
    "text_contains": ("tickets", "lower(description) LIKE '%giz%'"),
    "present": ("tickets", "description IS NOT NULL"),
    "supplier": ("alerts", "lower(trim(supplier)) LIKE '%supplier#00000001%'"),
    "needs_restock": ("alerts", "restock_alert = 'Sí'"),
    "cover_zero": ("alerts", "days_cover = 0"),
    "cover_1_3": ("alerts", "days_cover BETWEEN 1 AND 3"),
    "cover_4_7": ("alerts", "days_cover BETWEEN 4 AND 7"),
    "cover_up_to_30": ("alerts", "days_cover <= 30"),
    "excess": ("alerts", "excess > 0"),
    "below_cost": ("alerts", "below_cost = true"),
    "markup": ("alerts", "price_now > cost_unit AND (price_now-cost_unit)/NULLIF(cost_unit,0) > 0.05"),
}
put("filter_matches", " UNION ALL ".join(
    f"SELECT '{name}' AS filter_name, count(*) AS rows FROM {table} WHERE {test}"
    for name, (table, test) in _FILTERS.items()), "tickets", "alerts")
_PRECEDENCE = {
    "subfamily_family_brands": "lower(subfamily) LIKE '%brand#2%'",
    "subfamily_brands": "lower(description) LIKE '%red%'",
    "subfamily_family": "family = 'PROMO'",
    "subfamily_and_brands": "lower(subfamily) LIKE '%brand#2%' AND lower(description) LIKE '%red%'",
    "supplier_first": "lower(trim(supplier)) LIKE '%supplier#00000000%'",
    "brands_first": "lower(description) LIKE '%red%'",
    "exact_subfamily": "subfamily = 'brand#2'",
}
put("filter_precedence", " UNION ALL ".join(
    f"SELECT '{name}' AS precedence, count(*) AS items FROM alerts WHERE {test}"
    for name, test in _PRECEDENCE.items()), "alerts")

# ---- sales --------------------------------------------------------------------

_TOP = f"""SELECT description, branch, {tot('price_total', 2)} AS sales, {tot(PROFIT, 2)} AS profit,
    {tot('quantity', 0)} AS units, {MEAN_MARGIN} AS margin_pct
    FROM tickets WHERE %s GROUP BY description, branch ORDER BY sales DESC, description, branch LIMIT %d"""
put("top_sellers", _TOP % (
    f"family = 'PROMO' AND sale_date BETWEEN '2000-01-01' AND '2001-12-31' AND {FOUR}", 30), "tickets")
put("top_sellers_brands", _TOP % (
    like_any("description", ["red", "blue"]) + " AND " +
    like_any("description", ["220cc", "x220", "250cc", "x250", "250ml"]) +
    " AND lower(branch) IN ('asia','europe')", 20), "tickets")
_BY_BRANCH = f"""SELECT branch, {mil('SUM(price_total)', 2)} AS sales_m, {mil(f'SUM({PROFIT})', 2)} AS profit_m,
    {tot('quantity', 0)} AS units, {SUM_MARGIN} AS margin_pct, count(DISTINCT item_id) AS items
    FROM tickets %s GROUP BY branch ORDER BY sales_m DESC"""
put("sales_by_branch", _BY_BRANCH % "", "tickets")
put("branch_totals_kept", _BY_BRANCH % "", "tickets")
put("month_totals_kept", f"""SELECT CAST(date_trunc('month', sale_date) AS DATE) AS month, {mil('SUM(price_total)', 2)} AS sales_m,
    {mil(f'SUM({PROFIT})', 2)} AS profit_m, {tot('quantity', 0)} AS units, {SUM_MARGIN} AS margin_pct, count(DISTINCT item_id) AS items
    FROM tickets WHERE {FOUR} AND sale_date BETWEEN '1997-03-10' AND DATE '{X.CUT_DATE}' + 200 GROUP BY 1""", "tickets")
put("sales_by_branch_filtered", _BY_BRANCH % """WHERE lower(subfamily) LIKE '%brand#1%'
    AND sale_date BETWEEN '1999-03-01' AND '2001-08-31'""", "tickets")


def _leaders(when: str, min_family: int, min_item: int) -> str:
    return f"""
    WITH ranking AS (
        SELECT family, {MEAN_MARGIN} AS margin_pct, {mil('SUM(price_total)', 1)} AS sales_m,
               {mil(f'SUM({PROFIT})', 1)} AS profit_m, count(DISTINCT item_id) AS items,
               ROW_NUMBER() OVER (ORDER BY AVG(margin_ratio) DESC, family) AS rn
        FROM tickets WHERE {FOUR} AND {when}
        GROUP BY family HAVING SUM(price_total) > {min_family}),
    best AS (
        SELECT t.description, t.family, t.subfamily, {MEAN_MARGIN} AS margin_pct,
               {mil('SUM(price_total)', 1)} AS sales_m, {tot('quantity', 0)} AS units
        FROM tickets t JOIN ranking r ON t.family = r.family AND r.rn = 1
        WHERE {FOUR} AND {when} AND t.description IS NOT NULL
        GROUP BY t.description, t.family, t.subfamily HAVING SUM(price_total) > {min_item}
        ORDER BY {tot('price_total', 2)} DESC, t.description, t.subfamily LIMIT 8)
    SELECT 'family' AS row_type, family, margin_pct, sales_m, profit_m, items,
           NULL::VARCHAR AS subfamily, NULL::VARCHAR AS description, NULL::DOUBLE AS units
    FROM ranking WHERE rn = 1
    UNION ALL
    SELECT 'item', family, margin_pct, sales_m, NULL, NULL, subfamily, description, units FROM best"""


put("family_margin_leaders", _leaders(f"sale_date >= {LAST_DAY} - INTERVAL 30 DAY", 100_000, 10_000), "tickets")
put("family_margin_leaders_period",
    _leaders("sale_date BETWEEN '2000-01-01' AND '2000-12-31'", 1_000_000, 100_000), "tickets")
put("before_after_event", f"""
    SELECT branch, CASE WHEN sale_date < '{X.EVENT_DATE}' THEN 'before' ELSE 'after' END AS phase,
           {mil('SUM(price_total)', 1)} AS sales_m, count(DISTINCT sale_date) AS days,
           {fx('SUM(price_total)/1e6/count(DISTINCT sale_date)', 2)} AS sales_per_day_m
    FROM tickets WHERE branch IN ('asia','europe','middle east')
      AND sale_date BETWEEN '{X.EVENT_START}' AND {LAST_DAY}
    GROUP BY ALL""", "tickets")


def _kpis(day: str) -> str:
    month = "EXTRACT(YEAR FROM sale_date)*12 + EXTRACT(MONTH FROM sale_date)"
    target = f"EXTRACT(YEAR FROM {day})*12 + EXTRACT(MONTH FROM {day})"
    return f"""
    SELECT a.*, b.*, p.* FROM
    (SELECT {mil('SUM(price_total)', 2)} AS sales_m, {mil(f'SUM({PROFIT})', 2)} AS profit_m,
            {SUM_MARGIN} AS margin_pct, count(DISTINCT sale_date) AS days
     FROM tickets WHERE {FIVE} AND {month} = {target}) a,
    (SELECT {mil('SUM(price_total)', 2)} AS prev_sales_m, {mil(f'SUM({PROFIT})', 2)} AS prev_profit_m
     FROM tickets WHERE {FIVE} AND {month} = {target} - 1) b,
    (SELECT {mil('SUM(budget)', 2)} AS budget_m, count(DISTINCT item_id) AS items FROM alerts) p"""


put("month_kpis", _kpis(LAST_DAY), "tickets", "alerts")
put("appended_month_kpis", _kpis(LAST_DAY), "tickets", "alerts")
put("month_over_month", f"""
    WITH k AS ({_kpis("DATE '2001-10-15'")})
    SELECT *,
      {fx("(sales_m-coalesce(nullif(prev_sales_m,0),1))/coalesce(nullif(prev_sales_m,0),1)*100", 1)} AS sales_change_pct,
      {fx("(profit_m-coalesce(nullif(prev_profit_m,0),1))/coalesce(nullif(prev_profit_m,0),1)*100", 1)} AS profit_change_pct,
      {fx("sales_m/days", 1)} AS sales_per_day_m, margin_pct >= 18 AS margin_on_target
    FROM k""", "tickets", "alerts")
put("branch_sales_month", f"""
    SELECT branch, {mil('SUM(price_total)', 2)} AS sales_m, {MEAN_MARGIN} AS margin_pct
    FROM tickets WHERE strftime(sale_date, '%Y-%m') = '2001-05' AND {FIVE} GROUP BY branch""", "tickets")
put("daily_profit", f"""
    SELECT sale_date, {mil(f'SUM({PROFIT})', 2)} AS profit_m
    FROM tickets WHERE strftime(sale_date, '%Y-%m') = '2000-02' AND {FIVE} GROUP BY sale_date""", "tickets")
_MONTHLY = f"""SELECT CAST(EXTRACT(YEAR FROM sale_date) AS INT) AS year,
    CAST(EXTRACT(MONTH FROM sale_date) AS INT) AS month, {mil(f'SUM({PROFIT})', 3)} AS profit_m
    FROM tickets WHERE {FIVE} AND EXTRACT(YEAR FROM sale_date) IN (1999,2000,2001) GROUP BY ALL"""
put("monthly_profit", _MONTHLY, "tickets")
put("monthly_profit_pivot", f"""
    SELECT month, max(profit_m) FILTER (WHERE year = 1999) AS profit_m_1999,
           max(profit_m) FILTER (WHERE year = 2000) AS profit_m_2000,
           max(profit_m) FILTER (WHERE year = 2001) AS profit_m_2001
    FROM ({_MONTHLY}) GROUP BY month""", "tickets")
put("last_data_date", "SELECT max(sale_date) AS last_date FROM tickets", "tickets")
put("last_data_date_filtered", f"SELECT max(sale_date) AS last_date FROM tickets WHERE sale_date <= DATE '{X.CUT_DATE}'", "tickets")
put("version_lines", f"""
    SELECT 1 AS version, max(sale_date) AS newest, count(*) AS lines FROM tickets WHERE sale_date <= DATE '{X.CUT_DATE}'
    UNION ALL SELECT v, max(sale_date), count(*) FROM tickets, (VALUES (2), (3)) t(v) GROUP BY v""", "tickets")
put("category_branch_month", f"""
    SELECT branch, {mil('SUM(price_total)', 2)} AS sales_m, {tot('quantity', 0)} AS units
    FROM tickets WHERE lower(subfamily) LIKE '%brand#2%'
      AND EXTRACT(MONTH FROM sale_date) = 6 AND EXTRACT(YEAR FROM sale_date) = 2000
    GROUP BY branch""", "tickets")
put("year_over_year", f"""
    SELECT CAST(EXTRACT(YEAR FROM sale_date) AS INT) AS year, {mil('SUM(price_total)', 1)} AS sales_m
    FROM tickets WHERE family = 'ECONOMY' AND (sale_date BETWEEN '2001-06-01' AND '2001-06-30'
      OR sale_date BETWEEN '2000-06-01' AND '2000-06-30') GROUP BY ALL""", "tickets")
put("sized_top_sellers", f"""
    SELECT description, branch, {tot('price_total', 2)} AS sales, {tot('quantity', 0)} AS units
    FROM tickets WHERE {like_any('description', ['ring', 'gear'])} AND {like_any('description', [
        '940', '940cc', '940 cc', '960', '960cc', '1000', '1l', '1 l', '1000ml', 'litro', 'x1l', 'x 1l', '1lt',
        '1.5l', '1,5l', '1.5 l', '1500ml', '2l', '2 l', '2000ml', 'x2l', '2lt', '2 lt', '3l', '3 l', '3000ml'])}
      AND {FOUR} GROUP BY description, branch ORDER BY sales DESC, description, branch LIMIT 20""", "tickets")
_RANKED = f"""SELECT description, min(family) AS family, min(subfamily) AS subfamily,
    {tot('quantity', 0)} AS units, {tot('price_total', 2)} AS sales, {tot(PROFIT, 2)} AS profit,
    {SUM_MARGIN} AS margin_pct FROM tickets %s GROUP BY description"""
put("items_ranked", _RANKED % "" + " ORDER BY units DESC, description LIMIT 40", "tickets")
put("items_ranked_by_margin", _RANKED % """WHERE family = 'SMALL'
    AND sale_date BETWEEN '2001-01-01' AND '2001-12-31' AND lower(branch) = 'asia'"""
    + " ORDER BY margin_pct DESC, description LIMIT 25", "tickets")
put("days_above_mean", f"""
    WITH d AS (SELECT sale_date, {mil(f'SUM({PROFIT})', 2)} AS profit_m
      FROM tickets WHERE strftime(sale_date, '%Y-%m') = '2001-05' AND {FIVE} GROUP BY sale_date)
    SELECT *, {fx('profit_m', 6)} >= (SELECT {fx('avg(profit_m)', 6)} FROM d) AS above_mean FROM d""", "tickets")
_PURCHASE = f"""SELECT trim(c.description) AS description, c.family, c.subfamily, trim(c.supplier) AS supplier,
    {PRICE_COLS}, CAST(c.stk_total AS DOUBLE) AS stk_total
    FROM catalog c JOIN last_prices op ON c.item_key = op.item_key
    WHERE op.last_cost IS NOT NULL AND %s ORDER BY op.last_cost DESC, c.item_key LIMIT %d"""
put("price_extremes", f"""
    WITH p AS ({_PURCHASE % ("c.family = 'SMALL'", 20)})
    SELECT *, CASE WHEN last_cost = (SELECT max(last_cost) FROM p) THEN 'max'
                   WHEN last_cost = (SELECT min(last_cost) FROM p) THEN 'min' ELSE 'other' END AS extreme
    FROM p""", "catalog", "last_prices")

# ---- prices -------------------------------------------------------------------

put("purchase_prices", _PURCHASE % ("lower(c.subfamily) LIKE '%brand#2%' AND " + like_any("c.description", [
    "940", "960", "1000", "1l", "1 l", "litro", "x 1l", "1lt", "1.5l", "1,5l", "1.5 l", "1500ml",
    "2l", "2 l", "2000ml", "2lt", "2 lt", "3l", "3 l", "3000ml"]), 25), "catalog", "last_prices")
put("purchase_prices_no_filter", _PURCHASE % ("false", 25), "catalog", "last_prices")
put("purchase_prices_by_size", f"""
    SELECT trim(c.description) AS description, trim(c.supplier) AS supplier, {PRICE_COLS}
    FROM catalog c JOIN last_prices op ON c.item_key = op.item_key
    WHERE op.last_cost IS NOT NULL AND lower(c.description) LIKE '%ring%'
      AND {like_any('c.description', ['500g', '500 g', 'x500', 'x500g', '500gr', 'x1000'])}""",
    "catalog", "last_prices")
put("top_sellers_with_cost", f"""
    WITH best AS (
      SELECT item_key, description, {tot('quantity', 0)} AS units, {tot('price_total', 2)} AS sales,
             {MEAN_MARGIN} AS margin_pct
      FROM tickets WHERE lower(description) LIKE '%ring%' AND sale_date >= '2000-01-01'
      GROUP BY item_key, description ORDER BY units DESC, item_key, description LIMIT 30)
    SELECT description, units, sales, margin_pct, {PRICE_COLS}
    FROM best LEFT JOIN last_prices op ON best.item_key = op.item_key""", "tickets", "last_prices")


def _sale_vs_purchase(test: str, tail: str) -> str:
    return f"""
    WITH pv AS (
      SELECT description, item_key, {fx('price_unit', 2)} AS price, sale_date,
             ROW_NUMBER() OVER (PARTITION BY description
                                ORDER BY sale_date DESC, item_key, order_id, line_no) AS rn
      FROM tickets WHERE {test} AND price_unit > 0)
    SELECT pv.description, pv.price AS last_sale_price, pv.sale_date AS last_sale_date,
           {fx('(pv.price-op.last_cost)/NULLIF(op.last_cost,0)*100', 2)} AS real_margin_pct, {PRICE_COLS}
    FROM pv JOIN last_prices op ON pv.item_key = op.item_key
    WHERE pv.rn = 1 {tail}"""


put("sale_vs_purchase", _sale_vs_purchase(
    "subfamily = 'Brand#2'", "ORDER BY real_margin_pct ASC NULLS LAST, pv.description LIMIT 20"),
    "tickets", "last_prices")
put("sale_vs_purchase_all", _sale_vs_purchase("true", ""), "tickets", "last_prices")
put("sale_vs_purchase_appended", _sale_vs_purchase("true", ""), "tickets", "last_prices")
put("margin_bands", f"""
    WITH s AS (SELECT * FROM ({_sale_vs_purchase("true", "")}))
    SELECT CASE WHEN real_margin_pct < 0 THEN 'negative' WHEN real_margin_pct < 10 THEN 'low'
                WHEN real_margin_pct IS NOT NULL THEN 'healthy' END AS band, count(*) AS items
    FROM s GROUP BY ALL""", "tickets", "last_prices")


def _thin(test: str, more: str, n: int) -> str:
    return f"""
    WITH up AS (
      SELECT item_key, {fx('price_unit', 2)} AS price,
             ROW_NUMBER() OVER (PARTITION BY item_key ORDER BY sale_date DESC, order_id, line_no) AS rn
      FROM tickets WHERE price_unit > 0 AND {test}),
    vt AS (SELECT item_key, description, {tot('price_total', 2)} AS sales_total, {tot('quantity', 0)} AS units
           FROM tickets GROUP BY item_key, description)
    SELECT * FROM (
      SELECT vt.item_key, vt.description, vt.sales_total, vt.units, up.price AS last_sale_price,
             {fx('op.last_cost', 2)} AS last_cost,
             {fx('(up.price-op.last_cost)/NULLIF(op.last_cost,0)*100', 1)} AS real_margin_pct
      FROM vt JOIN up ON vt.item_key = up.item_key AND up.rn = 1
      JOIN last_prices op ON vt.item_key = op.item_key WHERE op.last_cost > 0) z
    WHERE {more} ORDER BY sales_total DESC, item_key, description LIMIT {n}"""


_DROP_KEY = "SELECT * EXCLUDE (item_key) FROM ({})"
put("high_sales_low_margin", _DROP_KEY.format(_thin("true", "true", 40)), "tickets", "last_prices")
put("high_sales_low_margin_brand", _DROP_KEY.format(
    _thin("lower(description) LIKE '%blue%'", "real_margin_pct <= 5", 25)), "tickets", "last_prices")
_MARKUP = fx("(price_now-cost_unit)/NULLIF(cost_unit,0)*100", 1)
put("below_cost", f"""
    SELECT description, family, subfamily, trim(supplier) AS supplier, {fx('price_now', 2)} AS price_now,
           {fx('cost_unit', 2)} AS cost_unit, {_MARKUP} AS margin_pct, units_90d
    FROM (SELECT * FROM alerts WHERE below_cost = true AND lower(trim(supplier)) LIKE '%supplier#00000000%'
          ORDER BY units_90d DESC, item_key LIMIT 40)""", "alerts")
put("last_sale_price", f"""
    SELECT description, sale_date AS last_date, {fx('price_unit', 2)} AS last_sale_price FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY description
             ORDER BY sale_date DESC, item_key, order_id, line_no) AS rn
      FROM tickets WHERE price_unit > 0) WHERE rn = 1""", "tickets")

# ---- stock --------------------------------------------------------------------


def cover_label(bounds, first: str | None, rest: str) -> str:
    head = f"WHEN days_cover = 0 THEN '{first}' " if first else ""
    return ("CASE " + head + " ".join(f"WHEN days_cover <= {b} THEN '{s}'" for b, s in bounds)
            + f" ELSE '{rest}' END")


AT_RISK = cover_label(L.AT_RISK_LABELS, L.AT_RISK_NO_STOCK, L.AT_RISK_ELSE)
CRITICAL = cover_label(L.CRITICAL_LABELS, None, L.CRITICAL_ELSE)

put("stock_by_category", f"""
    SELECT trim(description) AS description, subfamily, trim(supplier) AS supplier, {STOCK_DOUBLE},
           CAST(stk_total AS DOUBLE) AS stk_total
    FROM (SELECT * FROM catalog WHERE lower(subfamily) LIKE '%brand#2%'
          ORDER BY stk_total DESC, item_key LIMIT 25)""", "catalog")
_RISK = f"""SELECT description, family, subfamily, trim(supplier) AS supplier, units_90d, stk_total, days_cover,
    risk_level, abc_class, budget AS budget_30d, to_order, lost_value, {AT_RISK} AS alert
    FROM (SELECT * FROM alerts WHERE restock_alert = 'Sí' AND units_90d > 0 AND %s
          ORDER BY units_90d DESC, item_key LIMIT %d)"""
put("bestsellers_at_risk", _RISK % ("days_cover <= 30", 60), "alerts")
put("bestsellers_at_risk_urgent", _RISK % (
    "days_cover <= 7 AND " + like_any("description", ["red", "hot"]), 20), "alerts")
put("critical_with_sales", f"""
    SELECT r.description, r.family, r.subfamily, r.supplier, r.days_cover, r.risk_level, r.stk_total,
           r.stk_1, r.stk_2, r.stk_3, r.abc_class, coalesce(v.month_sales, 0) AS month_sales,
           coalesce(v.month_units, 0) AS month_units, {CRITICAL} AS level
    FROM alerts r LEFT JOIN (
      SELECT item_key, {tot('price_total', 2)} AS month_sales, {tot('quantity', 0)} AS month_units
      FROM tickets WHERE sale_date >= date_trunc('month', {LAST_DAY}) GROUP BY item_key) v
      ON r.item_key = v.item_key
    WHERE r.days_cover >= 0 AND r.days_cover <= 14
    ORDER BY r.days_cover, coalesce(v.month_sales, 0) DESC, r.item_key LIMIT 120""", "alerts", "tickets")
put("lost_sales_value", """
    SELECT description, family, subfamily, trim(supplier) AS supplier, lost_value, lost_units, days_cover,
           stk_total, risk_level
    FROM alerts WHERE lost_value > 0 ORDER BY lost_value DESC, item_key LIMIT 15""", "alerts")
put("lost_sales_summary", f"""
    SELECT {tot('lost_value', 2)} AS lost_value, CAST(SUM(lost_units) AS BIGINT) AS lost_units, count(*) AS items
    FROM alerts WHERE lost_value > 0""", "alerts")
put("budget_by_supplier", f"""
    SELECT trim(a.supplier) AS supplier, count(*) AS items, {tot('budget', 2)} AS budget_total,
           {fx('AVG(days_cover)', 1)} AS mean_days_cover
    FROM alerts a WHERE budget > 0 GROUP BY trim(a.supplier) ORDER BY budget_total DESC, 1 LIMIT 40""", "alerts")
put("excess_for_transfer", """
    SELECT description, family, subfamily, excess, stk_1, stk_2, stk_3, stk_4, days_cover
    FROM alerts WHERE excess > 0 AND family = 'PROMO' ORDER BY excess DESC, item_key LIMIT 25""", "alerts")
put("offer_candidates", f"""
    SELECT description, family, subfamily, trim(supplier) AS supplier, excess, stk_total, days_cover,
           {fx('price_now', 2)} AS price_now, {fx('cost_unit', 2)} AS cost_unit, {_MARKUP} AS margin_pct, units_90d
    FROM (SELECT * FROM alerts WHERE excess > 0 AND price_now > cost_unit
            AND (price_now-cost_unit)/NULLIF(cost_unit,0) > 0.05 AND units_90d > 0
          ORDER BY excess DESC, item_key LIMIT 60)""", "alerts")
_TO_ORDER = f"""
    SELECT r.description, r.family, r.subfamily, trim(r.supplier) AS supplier, r.to_order, r.budget,
           r.days_cover, r.stk_total, r.units_90d, {PRICE_COLS}
    FROM alerts r LEFT JOIN last_prices op ON r.item_key = op.item_key
    WHERE r.to_order > 0 AND %s ORDER BY r.budget DESC NULLS LAST, r.item_key LIMIT %d"""
put("how_much_to_order", _TO_ORDER % ("r.family = 'ECONOMY'", 40), "alerts", "last_prices")
put("how_much_to_order_no_filter", _TO_ORDER % ("false", 15), "alerts", "last_prices")
put("restock_by_supplier", f"""
    SELECT r.description, r.family, r.subfamily, trim(r.supplier) AS supplier, r.days_cover, r.stk_total,
           r.units_90d, r.to_order, r.budget, r.risk_level, {PRICE_COLS}
    FROM alerts r LEFT JOIN last_prices op ON r.item_key = op.item_key
    WHERE lower(trim(r.supplier)) LIKE '%supplier#0000000%' AND r.restock_alert = 'Sí'
    ORDER BY r.budget DESC NULLS LAST, r.item_key LIMIT 50""", "alerts", "last_prices")
put("alert_kpis", f"""
    SELECT count(*) AS items,
      CAST(SUM(CASE WHEN restock_alert = 'Sí' AND days_cover = 0 THEN 1 ELSE 0 END) AS BIGINT) AS no_stock,
      CAST(SUM(CASE WHEN restock_alert = 'Sí' AND days_cover <= 3 AND days_cover > 0 THEN 1 ELSE 0 END) AS BIGINT) AS critical,
      CAST(SUM(CASE WHEN restock_alert = 'Sí' AND days_cover <= 7 AND days_cover > 3 THEN 1 ELSE 0 END) AS BIGINT) AS urgent,
      CAST(SUM(CASE WHEN excess > 0 THEN 1 ELSE 0 END) AS BIGINT) AS excess,
      {mil('SUM(lost_value)', 1)} AS lost_value_m, {mil('SUM(budget)', 1)} AS budget_m
    FROM alerts""", "alerts")


def _detail(name: str, test: str, extra: str, cut: str = "LIMIT 50") -> None:
    put(name, f"""
        SELECT description, family, subfamily, trim(supplier) AS supplier, days_cover, pack_units, {extra}
               {STOCK}, stk_total, {ORDERS}, to_order, budget
        FROM alerts WHERE {test} ORDER BY budget DESC NULLS LAST, item_key {cut}""", "alerts")


_detail("detail_no_stock", "restock_alert = 'Sí' AND days_cover = 0", "units_90d,")
_detail("detail_critical", "restock_alert = 'Sí' AND days_cover BETWEEN 1 AND 3", "units_90d,")
_detail("detail_urgent", "restock_alert = 'Sí' AND days_cover BETWEEN 4 AND 7", "units_90d,")
_detail("detail_excess", "excess > 0", "excess,")
_detail("detail_lost_value", "lost_value > 0", "lost_value, lost_units,")
_detail("detail_budget", "budget > 0", "")
_detail("detail_budget_all", "budget > 0", "", "")
put("coverage_labels", f"""
    SELECT {AT_RISK} AS at_risk, {CRITICAL} AS critical, count(*) AS items FROM alerts GROUP BY ALL""", "alerts")
put("seasonal_items", """
    SELECT item_key, description, family, subfamily,
           CASE WHEN month_rank <= 3 THEN 'best' ELSE 'worst' END AS moment, month_rank, active_months,
           active_months < 4 AS strongly_seasonal, units_90d, stk_total
    FROM alerts WHERE month_rank <= 3 OR month_rank > 9""", "alerts")

# ---- trend --------------------------------------------------------------------


def _trend(days: int) -> str:
    return f"""
    WITH base AS (
      SELECT item_id, branch, sale_date, SUM(quantity) AS q FROM tickets
      WHERE sale_date >= {LAST_DAY} - INTERVAL {days - 1} DAY GROUP BY ALL),
    dated AS (
      SELECT *, date_diff('day', MIN(sale_date) OVER (PARTITION BY item_id, branch), sale_date) AS x FROM base),
    fit AS (
      SELECT item_id, branch, count(*) AS points, SUM(q) AS units, AVG(q) AS mean_daily,
             CASE WHEN count(*) >= 2 THEN round(regr_slope(q, x), 9) END AS slope
      FROM dated GROUP BY item_id, branch),
    trend AS (
      SELECT *, CASE WHEN points < 2 THEN 'estable' WHEN slope > 0.1 THEN 'alta'
                     WHEN slope < -0.1 THEN 'baja' ELSE 'estable' END AS trend FROM fit)"""


_TREND_ROWS = f"""{{}} SELECT item_id, branch, points, {fx('units', 0)} AS units, {fx('mean_daily', 1)} AS mean_daily,
    {fx('slope', 2)} AS slope, trend FROM trend"""
put("weekly_trend", _TREND_ROWS.format(_trend(7)), "tickets")
put("quarterly_trend", _TREND_ROWS.format(_trend(90)), "tickets")
_TREND_SUMMARY = f"""{_trend(90)},
    per AS (SELECT branch, trend, count(*) AS items FROM trend GROUP BY ALL),
    tot AS (SELECT branch, CAST(SUM(items) AS BIGINT) AS total_items FROM per GROUP BY branch)
    SELECT per.branch, per.trend, per.items, tot.total_items,
           CAST(round(per.items*100.0::DOUBLE/tot.total_items) AS DOUBLE) AS pct
    FROM per JOIN tot ON per.branch = tot.branch"""
put("trend_summary", _TREND_SUMMARY, "tickets")
put("trend_summary_rolled", _TREND_SUMMARY.replace("INTERVAL 89 DAY", "INTERVAL 1199 DAY"), "tickets")
put("trend_report_rolled", f"WITH cut AS (SELECT * FROM tickets WHERE sale_date <= DATE '{X.CUT_DATE}')," + _TREND_ROWS.format(_trend(1200)).strip()[4:].replace("tickets", "cut")
    .replace("(SELECT max(sale_date) FROM cut)", f"DATE '{X.CUT_DATE}'"), "tickets")
put("trend_summary_until", f"WITH cut AS (SELECT * FROM tickets WHERE sale_date <= DATE '{X.CUT_DATE}')," + _TREND_SUMMARY.strip()[4:].replace("tickets", "cut"), "tickets")


def _detail_trend(branch: str, trend: str, n: int | None) -> str:
    return f"""
    SELECT a.description, a.family, a.subfamily, trim(a.supplier) AS supplier, {fx('c.units', 0)} AS units,
           {fx('c.mean_daily', 1)} AS mean_daily, {fx('c.slope', 2)} AS slope, a.days_cover, a.stk_total, a.budget
    FROM trend c JOIN alerts a ON c.item_id = a.item_id
    WHERE c.trend = '{trend}' AND c.branch = '{branch}'
    ORDER BY {fx('c.units', 0)} DESC, a.item_key {f'LIMIT {n}' if n else ''}"""


put("trend_detail", _trend(90) + _detail_trend("asia", "alta", 100), "tickets", "alerts")
put("trend_items", f"""{_trend(90)}
    SELECT a.description, c.branch, a.family, a.subfamily, trim(a.supplier) AS supplier,
           {fx('c.units', 0)} AS units, {fx('c.slope', 2)} AS slope, a.days_cover, a.stk_total
    FROM trend c JOIN alerts a ON c.item_id = a.item_id WHERE c.trend = 'baja'
    ORDER BY {fx('c.units', 0)} DESC, a.item_key, c.branch LIMIT 30""", "tickets", "alerts")
_SHORT_MONTH = "list_extract(['ene','feb','mar','abr','may','jun','jul','ago','sep','oct','nov','dic'], month({0}))"
_SHORT_DAY = "concat(CAST(day({0}) AS VARCHAR), ' ', " + _SHORT_MONTH + ")"
put("trend_range", f"""
    WITH d AS (SELECT CAST(max(sale_date) - INTERVAL 6 DAY AS DATE) AS date_from, max(sale_date) AS date_to FROM tickets)
    SELECT *, {_SHORT_DAY.format('date_from')} AS label_from, {_SHORT_DAY.format('date_to')} AS label_to FROM d""",
    "tickets")
_ACTIONS = " ".join(f"WHEN urgency_index >= {b} THEN '{s}'" for b, s in L.URGENCY_ACTIONS)


def _urgency(n: int | None, trend: str) -> str:
    norm = ("CASE WHEN max({0}) OVER () > min({0}) OVER () THEN ({0}-min({0}) OVER ())"
            "/nullif(max({0}) OVER ()-min({0}) OVER (), 0) ELSE {0}*0 END")
    return f"""{_trend(90)},
    d AS ({_detail_trend('africa', trend, n)}),
    g AS (SELECT *, slope/CASE WHEN mean_daily = 0 THEN 1 ELSE mean_daily END AS growth,
                 (30-greatest(least(days_cover, 30), 0))/30.0::DOUBLE AS stock_risk FROM d),
    s AS (SELECT *, round_even({norm.format('growth')}*0.4::DOUBLE + stock_risk*0.4::DOUBLE
                     + {norm.format('budget')}*0.2::DOUBLE, 3) AS urgency_index FROM g)
    SELECT * EXCLUDE (growth), CASE {_ACTIONS} ELSE '{L.URGENCY_ELSE}' END AS suggested_action FROM s"""


put("urgency_index", _urgency(100, "alta"), "tickets", "alerts")
put("urgency_index_flat", _urgency(None, "estable"), "tickets", "alerts")

# ---- selectors ----------------------------------------------------------------

put("families", "SELECT DISTINCT family FROM catalog WHERE family IS NOT NULL", "catalog")
put("subfamilies", "SELECT DISTINCT subfamily FROM catalog WHERE subfamily IS NOT NULL AND family = 'PROMO'", "catalog")
put("suppliers", "SELECT DISTINCT trim(supplier) AS supplier FROM catalog WHERE supplier IS NOT NULL", "catalog")
put("suppliers_of_subfamily", """SELECT DISTINCT trim(supplier) AS supplier FROM catalog
    WHERE supplier IS NOT NULL AND family = 'PROMO' AND subfamily = 'Brand#2'""", "catalog")
put("subfamily_to_family", "SELECT subfamily, max(family) AS family FROM catalog GROUP BY subfamily", "catalog")

# ---- text ---------------------------------------------------------------------


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def pick(values) -> str:
    return f"list_extract({sql_list(values)}, CAST(p_partkey % {len(values)} + 1 AS BIGINT))"


QUESTIONS = f"""questions AS MATERIALIZED (SELECT p_partkey AS question_id, concat({pick(X.QUESTIONS)}, ' ',
    CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END, ' ',
    {pick(X.SIZES)}, ' ', {pick(X.PERIODS)}, ' ', {pick(X.PLACES)}) AS text FROM part)"""


def folded(column: str) -> str:
    return f"translate({column}, 'áéíóúñ', 'aeioun')"


def whole_word(text: str, word: str) -> str:
    edge = r"[^\p{L}\p{N}_]"
    return f"regexp_matches({text}, '(^|{edge}){word}({edge}|$)')"


def category_case(dictionary) -> str:
    """Synonyms tried one by one, the longest first and equals in listed order."""
    words = sorted(dictionary.synonyms().items(), key=lambda pair: -len(pair[0]))
    return "CASE " + " ".join(f"WHEN {whole_word('low', w)} THEN {n}" for w, n in words) + " END"


def category_rows(dictionary) -> str:
    def text(value) -> str:
        return "NULL" if value is None else f"'{value}'"

    return ", ".join(
        f"({i}, {text(c.key)}, {text(c.family)}, {text(c.subfamily)}, "
        f"{sql_list(c.brands) if c.brands else '[]::VARCHAR[]'}, "
        f"{sql_list([s for v in c.sizes.values() for s in v]) if c.sizes else '[]::VARCHAR[]'}, "
        f"{sql_list([k for k, v in c.sizes.items() for s in v]) if c.sizes else '[]::VARCHAR[]'})"
        for i, c in enumerate(dictionary.categories))


def categorised(source: str, key: str, dictionary) -> str:
    """Texts with their category and the brands and size spellings they hold."""
    return f"""
    cat(number, category, family, subfamily, brand_list, sizes, kinds) AS (VALUES {category_rows(dictionary)}),
    texts AS MATERIALIZED (SELECT *, lower(trim(text)) AS low, {folded('lower(trim(text))')} AS fold FROM {source}),
    hits AS MATERIALIZED (SELECT {key}, {category_case(dictionary)} AS number FROM texts),
    found AS MATERIALIZED (
      SELECT texts.*, cat.category, cat.family, cat.subfamily,
             [b FOR b IN (CASE WHEN cat.number IS NULL THEN {sql_list(dictionary.brands())}
                          ELSE cat.brand_list END) IF contains(low, b)] AS all_brands,
             list_position([contains(low, s) FOR s IN cat.sizes], true) AS size_at, cat.sizes, cat.kinds
      FROM texts JOIN hits h USING ({key})
      LEFT JOIN cat ON h.number = cat.number)"""


def says(phrases, whole=()) -> str:
    parts = [fold_word(p) for p in phrases] + [rf"\b{fold_word(w)}\b" for w in whole]
    return f"regexp_matches(fold, '(?s){'|'.join(parts)}')"


def amount(opening: str, units) -> str:
    names = "|".join(sorted(units, key=len, reverse=True))
    pattern = rf"(?:{opening})\s*(\d+(?:[.,]\d*)?)\s*({names})\b"
    factor = "CASE regexp_extract(low, '{0}', 2) {1} END".format(
        pattern, " ".join(f"WHEN '{u}' THEN {f}" for u, f in units.items()))
    return (f"CASE WHEN regexp_matches(low, '{pattern}') THEN CAST(floor(CAST(replace("
            f"regexp_extract(low, '{pattern}', 1), ',', '.') AS DOUBLE) * {factor}) AS INT) END")


def _supplier_case(names) -> str:
    unique = list(dict.fromkeys(fold_word(n) for n in names))
    literal = [f"WHEN {whole_word('fold', n)} THEN '{n}'" for n in unique]
    return "CASE " + " ".join(literal) + " END"


_DAY = f"DATE '{X.AS_OF}'"
_PERIOD = f"""CASE WHEN {says(['hoy'])} THEN {_DAY}
    WHEN {says(['esta semana'])} THEN CAST({_DAY} - INTERVAL 7 DAY AS DATE)
    WHEN {says(['este mes', 'mes actual'])} THEN CAST(date_trunc('month', {_DAY}) AS DATE)
    WHEN {says(['ultimo mes'])} THEN CAST({_DAY} - INTERVAL 30 DAY AS DATE)
    WHEN {says(['ultimos 90', '90 dias'])} THEN CAST({_DAY} - INTERVAL 90 DAY AS DATE)
    WHEN {says(['2026'])} AND {says(['mayo'])} THEN DATE '2026-05-01'
    WHEN {says(['junio'])} AND {says(['2026'])} THEN DATE '2026-06-01'
    WHEN {says(['mayo'])} THEN make_date(year({_DAY}), 5, 1)
    WHEN {says(['desde apertura', 'apertura sabin'])} THEN DATE '2026-06-06' END"""


def tagged(source: str, key: str, dictionary) -> str:
    bought = f"({says(W.BUY_WORDS)} AND len(all_brands) > 0)"
    number = r"TRY_CAST(nullif(regexp_extract(low, '\b(\d+)\b', 1), '') AS INT)"
    return f"""{categorised(source, key, dictionary)},
    tags AS MATERIALIZED (SELECT *,
      CASE WHEN {bought} THEN []::VARCHAR[] ELSE all_brands END AS brands,
      sizes[size_at] AS size_label, kinds[size_at] AS size_kind,
      {amount(W.MORE_THAN + '|' + W.ABOVE, W.VOLUME_UNITS)} AS min_cc,
      {amount(W.LESS_THAN + '|' + W.BELOW, W.VOLUME_UNITS)} AS max_cc,
      {amount(W.MORE_THAN, W.WEIGHT_UNITS)} AS min_g, {amount(W.LESS_THAN, W.WEIGHT_UNITS)} AS max_g,
      coalesce({_supplier_case(dictionary.suppliers)}, CASE WHEN {bought} THEN all_brands[1] END) AS supplier,
      [b FOR b IN {sql_list(dictionary.branches)} IF contains(low, b)] AS branches,
      {says(W.PRICE_WORDS, W.PRICE_WHOLE_WORDS)} AS wants_price, {says(W.RANKING_WORDS)} AS wants_ranking,
      {says(W.STOCK_WORDS)} AS wants_stock, {says(W.ALERT_WORDS)} AS wants_alert,
      {says(W.SEASON_WORDS)} AS wants_season,
      CASE WHEN {number} BETWEEN 2 AND 50 THEN {number} ELSE 10 END AS top_n,
      {_PERIOD} AS date_from, CASE WHEN {_PERIOD} IS NOT NULL THEN {_DAY} END AS date_to
      FROM found)"""


_TAGS = f"WITH {QUESTIONS}, {tagged('questions', 'question_id', X.DICTIONARY)}"
for _name, _columns in {
    "tag_category": "category, family, subfamily",
    "tag_brands": "array_to_string(brands, ',') AS brands",
    "tag_measure": "size_label, size_kind",
    "tag_volume_range": "min_cc, max_cc",
    "tag_weight_range": "min_g, max_g",
    "tag_supplier": "supplier, array_to_string(brands, ',') AS brands",
    "tag_branches": "array_to_string(branches, ',') AS branches",
    "tag_intents": "wants_price, wants_ranking, wants_stock, wants_alert, wants_season",
    "tag_top_n": "top_n",
    "tag_period": "date_from, date_to",
}.items():
    put(_name, f"{_TAGS} SELECT question_id, {_columns} FROM tags")

put("tag_conversations", f"""WITH turns AS (SELECT *, conv_id*1000+turn AS k FROM conversations),
    {categorised('turns', 'k', X.LANGUAGE_DICTIONARY)}
    SELECT conv_id, turn, category, family, subfamily FROM found""")
put("tag_document_brands", f"""WITH docs AS (SELECT doc_id, text FROM documents),
    {tagged('docs', 'doc_id', X.LANGUAGE_DICTIONARY)}
    SELECT doc_id, category, array_to_string(brands, ',') AS brands, top_n FROM tags""")
put("tag_descriptions", f"""WITH lines AS (SELECT description AS text, count(*) AS n FROM tickets GROUP BY 1),
    {categorised('lines', 'text', X.DICTIONARY)}
    SELECT category, CAST(sum(n) AS BIGINT) AS lines FROM found GROUP BY category""", "tickets")

_HAS = {c: f"{c} IS NOT NULL" for c in
        ("category", "subfamily", "family", "supplier", "min_cc", "max_cc", "size_label")}
_BRANDS = "len(brands) > 0"
_ROUTE = f"""CASE
    WHEN {says(W.BELOW_COST_FIRST)} THEN 'below_cost'
    WHEN {says(W.LOST_VALUE_FIRST)} THEN 'lost_sales_value'
    WHEN {says(W.BY_BRANCH)} AND ({_HAS['category']} OR {_BRANDS} OR {_HAS['subfamily']}) THEN 'sales_by_branch'
    WHEN {says(W.FROM_SUPPLIER)} AND {_HAS['supplier']} THEN 'restock_by_supplier'
    WHEN {says(W.HOW_MUCH_TO_ORDER)} AND ({_BRANDS} OR {_HAS['subfamily']} OR {_HAS['family']}) THEN 'how_much_to_order'
    WHEN {says(W.OFFER)} THEN 'offer_candidates'
    WHEN {says(W.TREND)} THEN 'trend_items'
    WHEN {says(W.LOST_VALUE_WIDE)} THEN 'lost_sales_value'
    WHEN {says(W.BELOW_COST_WIDE)} THEN 'below_cost'
    WHEN NOT ({_HAS['category']} OR {_BRANDS} OR {_HAS['min_cc']} OR {_HAS['supplier']}) THEN NULL
    WHEN {says(W.OFFER_WIDE)} THEN 'offer_candidates'
    WHEN {says(W.EVENT_IMPACT)} THEN 'before_after_event'
    WHEN {says(W.BUDGET)} THEN 'budget_by_supplier'
    WHEN {says(W.TRANSFER)} THEN 'excess_for_transfer'
    WHEN {says(W.FAMILY_MARGIN)} THEN 'family_margin_leaders'
    WHEN {says(W.THIN_MARGIN)} THEN 'high_sales_low_margin'
    WHEN {says(W.CRITICAL)} OR (wants_alert AND wants_stock) THEN 'critical_with_sales'
    WHEN {says(W.COMPARE_PRICES)} AND {_HAS['category']} THEN 'sale_vs_purchase'
    WHEN wants_price AND wants_ranking THEN 'top_sellers_with_cost'
    WHEN wants_price AND NOT wants_ranking AND NOT {says(W.COMPARE_PRICES)}
         AND ({_HAS['subfamily']} OR {_HAS['family']} OR {_BRANDS} OR {_HAS['size_label']}
              OR {_HAS['min_cc']} OR {_HAS['max_cc']}) THEN 'purchase_prices'
    WHEN {says(W.AT_RISK)} OR (wants_ranking AND wants_stock) THEN 'bestsellers_at_risk'
    WHEN wants_stock AND ({_HAS['subfamily']} OR {_BRANDS}) THEN 'stock_by_category'
    WHEN wants_ranking OR {_HAS['min_cc']} OR {_HAS['size_label']} OR {_HAS['category']} THEN 'top_sellers'
    END"""
put("route_label", f"{_TAGS} SELECT question_id, {_ROUTE} AS route FROM tags")
put("route_counts", f"{_TAGS} SELECT {_ROUTE} AS route, count(*) AS texts FROM tags GROUP BY ALL")

put("stream_tagged_log", f"""
    WITH turns AS (SELECT 1000000000 + conv_id*60 + turn AS k, text FROM conversations WHERE role = 'user'),
    {tagged('turns', 'k', X.LANGUAGE_DICTIONARY)}
    SELECT k AS asked_at, text AS pregunta, category, {_ROUTE} AS route FROM tags""")

_PAIRS = """SELECT DISTINCT p_type || '/' || split_part(p_name, ' ', 2) AS category, p_type,
    split_part(p_name, ' ', 2) AS noun, split_part(p_name, ' ', 1) AS adjective FROM part"""
put("catalog_dictionary", """
    SELECT DISTINCT lower(family) AS category, family, NULL::VARCHAR AS subfamily, lower(family) AS synonyms
    FROM catalog
    UNION ALL
    SELECT lower(subfamily), max(family), subfamily, lower(subfamily) FROM catalog GROUP BY subfamily""", "catalog")
put("tag_turns_by_table", r"""
    WITH d AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part
               UNION SELECT unnest(['the', 'de la', 'und die', 'le'])),
    t AS (SELECT conv_id, turn, lower(trim(text)) AS low,
            concat(' ', trim(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}_]+', ' ', 'g')), ' ') AS norm FROM conversations),
    m AS (SELECT conv_id, turn, (list(word ORDER BY length(word) DESC, word))[1] AS word
          FROM t JOIN d ON contains(norm, concat(' ', word, ' ')) GROUP BY ALL),
    b AS (SELECT conv_id, turn, string_agg(word, ',' ORDER BY word) AS words FROM t JOIN d ON contains(low, word) GROUP BY ALL)
    SELECT t.conv_id, t.turn, upper(m.word) AS category,
           CASE WHEN m.word IS NULL THEN coalesce(b.words, '') WHEN contains(low, m.word) THEN m.word ELSE '' END AS brands
    FROM t LEFT JOIN m USING (conv_id, turn) LEFT JOIN b USING (conv_id, turn)""")
put("tag_arrivals", r"""
    WITH n AS (SELECT DISTINCT string_split(lower(p_name), ' ') AS w FROM part),
    a AS (SELECT w[2] AS word, 0 AS late FROM n UNION ALL SELECT w[1], 1 FROM n UNION ALL SELECT unnest(['the', 'de la']), 0),
    d AS (SELECT word, min(late) AS late FROM a WHERE word IS NOT NULL GROUP BY word),
    t AS (SELECT conv_id, turn, text, lower(trim(text)) AS low,
            concat(' ', trim(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}_]+', ' ', 'g')), ' ') AS norm FROM conversations),
    m AS (SELECT conv_id, turn, (list(word ORDER BY length(word) DESC, word))[1] AS word
          FROM t JOIN d ON contains(norm, concat(' ', word, ' ')) AND late <= conv_id % 2 GROUP BY ALL),
    b AS (SELECT conv_id, turn, string_agg(word, ',' ORDER BY word) AS words
          FROM t JOIN d ON contains(low, word) AND late <= conv_id % 2 GROUP BY ALL)
    SELECT 1000000000 + t.conv_id*60 + t.turn AS asked_at, t.text AS pregunta, upper(m.word) AS category,
           CASE WHEN m.word IS NULL THEN coalesce(b.words, '') WHEN contains(low, m.word) THEN m.word ELSE '' END AS brands
    FROM t LEFT JOIN m USING (conv_id, turn) LEFT JOIN b USING (conv_id, turn)""")
put("tag_catalog_by_table", """
    WITH n AS (SELECT DISTINCT family, split_part(description, ' ', 2) AS noun, split_part(description, ' ', 1) AS adjective FROM catalog),
    o AS (SELECT noun, max(concat(family, '/', noun)) AS category FROM n GROUP BY noun),
    b AS (SELECT concat(family, '/', noun) AS category, list_sort(list(adjective)) AS words FROM n GROUP BY ALL)
    SELECT item_key, category, array_to_string([w FOR w IN words IF contains(lower(description), w)], ',') AS brands
    FROM catalog JOIN o ON noun = split_part(description, ' ', 2) JOIN b USING (category)""", "catalog")
put("dictionary_synonyms", f"""WITH p AS ({_PAIRS}), w AS (
      SELECT noun AS synonym, category FROM p UNION ALL SELECT noun || 's', category FROM p
      UNION ALL SELECT lower(p_type) || ' ' || noun, category FROM p)
    SELECT synonym, max(category) AS category FROM w GROUP BY synonym""")
put("dictionary_brands", f"SELECT adjective AS brand, max(category) AS category FROM ({_PAIRS}) GROUP BY adjective")
