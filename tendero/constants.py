"""Fixed values shared by the operators.

Everything here is data: names and codes stored in the tables, words people use
in questions, and thresholds printed on reports. Functions take these as
defaults, so a caller with other branches or other words passes its own.
"""

from __future__ import annotations

import datetime as dt

# ---- fixed values: branches -------------------------------------------------
SALE_BRANCHES = ("hiper", "corrientes", "sabin", "formosa")
DEPOT_BRANCHES = ("tirol", "central")
SPECIAL_BRANCHES = ("express",)
DASHBOARD_BRANCHES = SALE_BRANCHES + SPECIAL_BRANCHES
ALL_BRANCHES = SALE_BRANCHES + DEPOT_BRANCHES + SPECIAL_BRANCHES

# ---- fixed values: codes stored in the alert table --------------------------
RESTOCK_YES = "Sí"

# ---- fixed values: trend classes and their slope threshold ------------------
TREND_UP, TREND_DOWN, TREND_FLAT = "alta", "baja", "estable"
TREND_SLOPE = 0.1

# ---- fixed values: report thresholds ----------------------------------------
MIN_FAMILY_SALES = 50_000_000
MIN_ITEM_SALES = 500_000
OFFER_MARKUP = 0.20
TARGET_MARGIN_PCT = 18
FEW_ACTIVE_MONTHS = 4
ADHOC_MAX_ROWS = 50
DEFAULT_SINCE = dt.date(2026, 1, 1)
DEFAULT_YEARS = (2024, 2025, 2026)

# ---- fixed values: opening of the newest branch -----------------------------
EVENT_DATE = dt.date(2026, 6, 6)
EVENT_START = dt.date(2026, 5, 1)
EVENT_BRANCHES = ("hiper", "sabin", "corrientes")

# ---- fixed values: Spanish month abbreviations, January first ---------------
MONTH_ABBR = ("ene", "feb", "mar", "abr", "may", "jun",
              "jul", "ago", "sep", "oct", "nov", "dic")

# ---- fixed values: functions that reach past the tables of a statement -------
FORBIDDEN_CALLS = ("reflect", "try_reflect", "java_method")

# ---- fixed values: how pack sizes are spelled in item descriptions ----------
SIZE_SPELLINGS = {
    "1 kg": ("1 kg", "x1kg", "x 1kg", "1kg", " 1 kg", "x1 kg"),
    "500g": ("500g", "500 g", "x500", "x500g", "500gr"),
    "1kg": ("1kg", "1 kg", "x1kg"),
}
LARGE_VOLUME_LABELS = {
    940: ("940", "940cc", "940 cc"),
    960: ("960", "960cc"),
    1000: ("1000", "1l", "1 l", "1000ml", "litro", "x1l", "x 1l", "1lt"),
    1500: ("1.5l", "1,5l", "1.5 l", "1500ml"),
    2000: ("2l", "2 l", "2000ml", "x2l", "2lt", "2 lt"),
    3000: ("3l", "3 l", "3000ml"),
}
SMALL_VOLUME_LABELS = {
    220: ("220cc", "x220"),
    250: ("250cc", "x250", "250ml"),
    330: ("330cc", "330ml", "x330"),
    354: ("354cc", "354ml", "x354"),
    355: ("355cc", "355ml", "x355"),
    473: ("473cc", "473ml", "x473"),
}
LARGE_WEIGHT_LABELS = {
    500: ("500g", "500 g", "x500"),
    1000: ("1kg", "1 kg", "x1kg", "1000g"),
    2000: ("2kg", "2 kg"),
}
