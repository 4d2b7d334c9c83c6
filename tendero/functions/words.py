"""Words people use when they ask for a report.

Fixed values, stated in their accented form; texts and words are compared without
accents. A phrase may hold ``.*`` for words in between. A phrase that merely
extends another of its list is left out, since the shorter one already matches.
"""

from __future__ import annotations

# ---- fixed values: supplier names, the first one found wins ------------------
KNOWN_SUPPLIERS = (
    "tremblay", "don gastón", "calchaquí", "abastecedora calchaquí", "liebig", "coop liebig",
    "williner", "alfredo williner", "cremigal", "serenísima", "la serenísima", "mastellone",
    "arcor", "unilever", "unilever bpc", "la papelera", "papelera del plata",
    "distribuidora jota", "jota be", "sancor", "ilolay", "molinos", "cañuelas", "molino cañuelas",
    "ledesma", "bimbo", "fargo", "est. las marias", "las marias", "cachuera", "la cachuera",
    "abril distribuciones", "dreamco", "guerra hnos", "rosales ramon", "logística la serenísima",
    "butter", "rap", "produmen", "hreñuk", "pbsa", "pepsico",
)

# ---- fixed values: what is asked for -----------------------------------------
PRICE_WORDS = (
    "precio compra", "precio de compra", "precios de compra", "precios a proveedor",
    "precio proveedor", "cuánto cuesta", "cuánto sale", "precio oc", "última oc", "último precio",
)
PRICE_WHOLE_WORDS = ("oc",)
RANKING_WORDS = (
    "más vendido", "mayor venta", "top", "ranking", "más vendida", "mejor vendido",
    "mayor cantidad", "más unidades",
)
STOCK_WORDS = (
    "stock", "quiebre", "cobertura", "faltante", "disponibilidad", "clasificar", "clasificación",
    "riesgo", "pueden faltar", "van a faltar", "reposición", "reabastecer",
)
ALERT_WORDS = ("alerta", "crítico", "reponer", "reabastecer", "reposición", "quiebre", "falta")
SEASON_WORDS = (
    "estación", "temporada", "invierno", "verano", "otoño", "primavera", "mejor momento",
)
BUY_WORDS = (
    "comprar", "pedir", "reponer", "cuánto tengo que", "cuánto le tengo", "proveedor",
    "orden de compra", "oc a",
)

# ---- fixed values: how sizes are asked for -----------------------------------
MORE_THAN = r"m[aá]s\s*de|mayor\s*(?:a|que)"
LESS_THAN = r"m[ae]nos\s*de|menor\s*(?:a|que)"
ABOVE = r"superior\s*(?:a|que)"
BELOW = r"inferior\s*(?:a|que)"
VOLUME_UNITS = {"cc": 1, "ml": 1, "l": 1000, "litro": 1000, "litros": 1000}
WEIGHT_UNITS = {"g": 1, "gr": 1, "kg": 1000, "kilo": 1000, "kilos": 1000, "gramos": 1}

# ---- fixed values: phrases of each report ------------------------------------
BELOW_COST_FIRST = (
    "bajo costo", "bajo el costo", "debajo del costo", "vendiendo a pérdida",
    "vendemos por debajo", "precio menor al costo", "margen negativo", "vendiendo bajo",
)
BELOW_COST_WIDE = (
    "bajo costo", "bajo el costo", "debajo del costo", "vendiendo a pérdida",
    "costo de reposición", "menor al costo", "vendemos bajo", "vendemos por debajo",
)
LOST_VALUE_FIRST = (
    "perdiendo plata", "perdiendo dinero", "perdemos plata", "cuánto perdimos", "valor perdido",
    "pérdida por quiebre",
)
LOST_VALUE_WIDE = (
    "cuánto perdí", "cuánto se perdió", "valor perdido", "pérdida por quiebre", "dinero perdido",
    "ventas perdidas", "cuánto dinero perdí", "perdiendo plata", "perdiendo dinero",
    "perdemos plata", "perdemos dinero", "cuánto perdemos",
)
BY_BRANCH = ("qué sucursal", "por sucursal", "cada sucursal", "sucursal vendió", "cuánto vendió cada")
FROM_SUPPLIER = (
    "tremblay", "don gastón", "calchaquí", "liebig", "williner", "cremigal", "serenísima", "arcor",
    "unilever", "la papelera", "distribuidora jota", "comprarle a", "pedirle a", "proveedor",
)
HOW_MUCH_TO_ORDER = (
    "cuánto tengo que pedir", "cuánto pedir", "cuánto hay que pedir", "a quién le compro",
    "a quién compro", "a qué proveedor", "quién me vende", "dónde compro",
    "cuánto tengo que comprar", "proveedor.*pedir", "pedir.*proveedor",
)
OFFER = ("oferta", "liquidar", "liquidación", "descuento")
OFFER_WIDE = (
    "oferta", "descuento", "liquidar", "liquidación", "promoci", "precio especial",
    "qué podemos ofrecer", "qué conviene ofrecer",
)
TREND = ("tendencia", "subiendo", "bajando", "en alza", "en baja", "creciendo", "cayendo",
         "últimos 6 días", "últimos seis días")
EVENT_IMPACT = ("sabin.*quitó", "sabin.*hiper", "canibaliz", "sabin.*mercado nuevo",
                "impacto.*sabin", "apertura.*sabin.*hiper")
BUDGET = ("presupuesto de compra", "presupuesto total", "presupuesto.*proveedor",
          "cuánto tengo que comprar", "presupuesto.*30 días")
TRANSFER = ("exceso de stock", "sobrestock", "trasladar", "traslado entre sucursales", "exceso.*sucursal")
FAMILY_MARGIN = (
    "familia con mejor margen", "familia con más margen", "qué familia deja más",
    "mejor margen por familia", "familia más rentable", "cuál es la familia",
)
THIN_MARGIN = (
    "genera más plata", "más plata pero", "casi no me deja", "casi no deja ganancia",
    "vende mucho pero", "alta venta.*bajo margen", "mucha plata.*poco margen",
)
CRITICAL = ("clasificar", "clasificación", "productos críticos", "críticos según",
            "necesitan stock", "bajo stock")
COMPARE_PRICES = (
    "comparar precio", "precio venta vs", "venta vs compra", "precio de venta vs",
    "precio venta y compra", "precio de compra vs", "compra con precio", "compra con venta",
    "precios de compra con", "precios de venta", "precio de compra con", "compra y venta",
)
AT_RISK = (
    "riesgo de quiebre", "riesgo quiebre", "quiebre de stock", "pueden quedar sin stock",
    "pueden faltar", "van a faltar", "más vendidos.*stock", "riesgo.*stock", "stock.*riesgo",
    "necesitan reposición", "necesitan reabastecimiento",
)
