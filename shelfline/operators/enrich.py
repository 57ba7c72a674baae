"""Category assignment and cleanup, name classes, related products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col_

# --- fixed values: name classification rules, in priority order --------------
NAME_CLASS_RULES = [
    ("tees", r"\btee\b|t-shirt"),
    ("hoodies-sweaters", r"hoodie|crewneck|pullover|sweater|zip-up|sherpa jacket|windbreaker"),
    ("polos-buttonups", r"polo|button-up"),
    ("vests", r"vest\b"),
    ("hats", r"\bhat\b|bucket hat"),
    ("socks", r"socks"),
    ("bags-totes", r"backpack|tote|folio|bag strap|belt bag|pouch|luggage"),
    ("drinkware", r"tumbler|mug|bottle|carafe|glass|wine chiller"),
    ("stickers", r"sticker"),
    ("pins", r"\bpin\b|lapel pin"),
    ("patches", r"patch\b"),
    ("journals-notecards", r"journal|notecard"),
    ("pens", r"\bpen\b|pens\b|stylus"),
    ("tech", r"earbuds|headphones|speaker|camera|charger|adapter|USB|webcam|powerbank"),
    ("home-kitchen", r"blanket|pillow|candle|apron|planter|tray|magnet|desk pad|lap desk|umbrella"),
    ("kids-baby", r"toddler|youth|onesie|bib|llama plush|unicorn plush"),
    ("gift-sets", r"gift set|gift card|coloring kit"),
    ("accessories", r"keychain|keytag|lanyard|sunglasses|shoe charm|playing card|pickleball|frisbee|towel|skin|"
                    r"door hanger|print\b"),
]
META_CATEGORIES = ["all-products", "featured"]
RELATED_COUNT = 5
# ------------------------------------------------------------------------------


def name_class(name) -> Column:
    """First matching rule (case-insensitive), else ``other``."""
    n = col_(name)
    out = None
    for cat, pat in NAME_CLASS_RULES:
        cond = F.coalesce(n.rlike("(?i)" + pat), F.lit(False))
        out = F.when(cond, F.lit(cat)) if out is None else out.when(cond, F.lit(cat))
    return out.otherwise(F.lit("other"))


def class_histogram(df: DataFrame, class_col: str = "class") -> DataFrame:
    """Products per class, largest first."""
    return df.groupBy(class_col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), class_col)


def assign_categories(products: DataFrame, membership: DataFrame, categories: DataFrame | None = None,
                      sku: str = "sku") -> DataFrame:
    """X5 + X6: membership (category_id|path, sku) -> cleaned category list.

    Meta categories are dropped; deepest paths first, then by path.  Products
    without membership keep ``categories`` NULL (custom left untouched);
    products with only meta categories get an empty list.
    """
    m = membership
    if categories is not None:
        m = m.join(categories, "category_id").select(sku, "path")
    per = m.groupBy(sku).agg(F.collect_list("path").alias("_all"))
    kept = F.filter("_all", lambda p: ~p.isin(*META_CATEGORIES))
    depth_sorted = F.array_sort(kept, lambda a, b: F.when(F.size(F.split(b, "/")) != F.size(F.split(a, "/")),
                                                          F.size(F.split(b, "/")) - F.size(F.split(a, "/")))
                                .when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0)))
    per = per.select(sku, depth_sorted.alias("categories"))
    return products.join(per, sku, "left")


def related_ring(products: DataFrame, class_col: str = "class", key: str = "path",
                 k: int = RELATED_COUNT) -> DataFrame:
    """``k`` related keys per product from its own class.

    Deterministic stand-in for the random pick: all products stand in one
    order of (class, md5(key), key), found with range partitions; inside its
    class each takes the next ``k`` on the ring.  Classes with at most ``k``
    members give all their others and fill from the products that follow the
    class in the order (around its end).  Every partner is found by an
    equi-join on its place, whatever the size of a class: no window over a
    class, no pairs of classes.
    """
    from .state import numbered
    base = products.select(F.col(key).alias("_key"), F.col(class_col).alias("_class"), F.md5(F.col(key)).alias("_h"))
    placed = numbered(base, "_class", "_h", "_key").select("_key", "_class", "idx")
    spans = placed.groupBy(F.col("_class").alias("_of")).agg(F.min("idx").alias("_first"), F.count(F.lit(1)).alias("_m"))
    total = placed.agg(F.count(F.lit(1)).alias("_n"))
    own = placed.join(spans, F.col("_class").eqNullSafe(F.col("_of"))).crossJoin(total)
    want = own.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    ring = F.col("_first") + (F.col("idx") - F.col("_first") + F.col("rank")) % F.col("_m")
    # the class's other members come first, then the followers of the class
    after = (F.col("_first") + F.col("rank")) % F.col("_n")
    want = want.filter(F.col("rank") < F.col("_n")) \
        .withColumn("_partner", F.when(F.col("rank") < F.col("_m"), ring).otherwise(after))
    partner = placed.select(F.col("idx").alias("_partner"), F.col("_key").alias("related"))
    return want.join(partner, "_partner").select(F.col("_key").alias(key), F.col("rank").cast("int").alias("rank"), "related")
