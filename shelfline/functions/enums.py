"""Availability (T6) and item-condition (T7) enums."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, js_trim, replace_first

# --- fixed values (must equal the reference's maps) --------------------------
AVAILABILITY_MAP = {
    "instock": "InStock", "in stock": "InStock", "in_stock": "InStock",
    "outofstock": "OutOfStock", "out of stock": "OutOfStock", "out_of_stock": "OutOfStock",
    "preorder": "PreOrder", "pre-order": "PreOrder", "pre_order": "PreOrder",
    "presale": "PreSale", "pre-sale": "PreSale",
    "backorder": "BackOrder", "back order": "BackOrder",
    "discontinued": "Discontinued",
    "soldout": "SoldOut", "sold out": "SoldOut", "sold_out": "SoldOut",
    "limitedavailability": "LimitedAvailability", "limited availability": "LimitedAvailability",
    "madetoorder": "MadeToOrder", "made to order": "MadeToOrder",
    "onlineonly": "OnlineOnly", "online only": "OnlineOnly",
    "instoreonly": "InStoreOnly", "in store only": "InStoreOnly",
    "reserved": "Reserved",
}
CONDITION_MAP = {
    "newcondition": "NewCondition", "new": "NewCondition",
    "refurbishedcondition": "RefurbishedCondition", "refurbished": "RefurbishedCondition",
    "usedcondition": "UsedCondition", "used": "UsedCondition",
    "damagedcondition": "DamagedCondition", "damaged": "DamagedCondition",
}
AVAILABILITY_VALUES = [
    "BackOrder", "Discontinued", "InStock", "InStoreOnly", "LimitedAvailability",
    "MadeToOrder", "OnlineOnly", "OutOfStock", "PreOrder", "PreSale", "Reserved", "SoldOut",
]
CONDITION_VALUES = ["DamagedCondition", "NewCondition", "RefurbishedCondition", "UsedCondition"]
SCHEMA_ORG_PREFIXES = ["https://schema.org/", "http://schema.org/"]
# ----------------------------------------------------------------------------


def strip_schema_org(value) -> Column:
    """Remove the first ``https://schema.org/`` then the first ``http://schema.org/``."""
    v = col_(value)
    for p in SCHEMA_ORG_PREFIXES:
        v = replace_first(v, p)
    return v


def _lookup(value, mapping: dict) -> Column:
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    key = F.lower(js_trim(F.lower(strip_schema_org(value))))
    v = col_(value)
    return F.when(v.isNotNull() & (v != ""), F.try_element_at(m, key))


def normalize_availability(value) -> Column:
    """Free text -> availability enum, NULL when unknown."""
    return _lookup(value, AVAILABILITY_MAP)


def normalize_condition(value) -> Column:
    """Free text -> condition enum, NULL when unknown."""
    return _lookup(value, CONDITION_MAP)
