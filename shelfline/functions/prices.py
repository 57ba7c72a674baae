"""Price text parsing (E17) and currency-from-symbol detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_

# --- fixed values (must equal the reference's table) -------------------------
# Currency symbols tested in this order; the first one contained wins.
CURRENCY_SYMBOLS = [
    ("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₹", "INR"), ("₩", "KRW"),
    ("R$", "BRL"), ("kr", "SEK"), ("CHF", "CHF"), ("A$", "AUD"), ("C$", "CAD"),
]
# Number shapes: European grouping, US grouping, plain comma decimal.
EU_PRICE = r"^\d{1,3}(\.\d{3})*(,\d{2})?$"
US_PRICE = r"^\d{1,3}(,\d{3})*(\.\d{2})?$"
COMMA_DECIMAL = r"^\d+,\d{2}$"
# ----------------------------------------------------------------------------


def currency_from_symbol(text) -> Column:
    """First symbol contained in the text -> ISO code, else NULL."""
    t = col_(text)
    expr = None
    for sym, code in CURRENCY_SYMBOLS:
        cond = t.contains(sym)
        expr = F.when(cond, F.lit(code)) if expr is None else expr.when(cond, F.lit(code))
    return expr


def parse_price(text) -> Column:
    """Price text -> clean numeric string; NULL when nothing numeric.

    Branch order is the semantics: ``1.299`` is read as European (1299),
    ``99.99`` falls through to US, ``1299.00`` matches no branch and is kept.
    """
    t = col_(text)
    cleaned = F.regexp_replace(t, r"[^0-9.,]", "")
    eu = F.regexp_replace(F.regexp_replace(cleaned, r"\.", ""), ",", ".")
    us = F.regexp_replace(cleaned, ",", "")
    simple = F.regexp_replace(cleaned, ",", ".")
    out = (F.when(cleaned.rlike(EU_PRICE), eu)
           .when(cleaned.rlike(US_PRICE), us)
           .when(cleaned.rlike(COMMA_DECIMAL), simple)
           .otherwise(cleaned))
    # parseFloat succeeds iff the string starts with a digit or '.digit'
    return F.when((t.isNotNull()) & (t != "") & (cleaned != "") & out.rlike(r"^(\d|\.\d)"), out)
