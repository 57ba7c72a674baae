"""Entry 1 (page crawl) as one lazy plan: pages -> E0..E23 -> T1..T12 -> V1.

Outcome per page, as the reference records it in the crawl state:
``crawled`` (valid product), ``failed`` (transform or validation errors) or
``skipped`` (soft 404 or no product data).  The plan is narrow end to end:
the only Python stage is the E0 tokenizer and nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import url_origin, url_pathname
from ..operators.extract import extract_pages, merge_fields, page_fields
from ..operators.platforms import site_platforms
from ..operators.transform import transform_frame
from ..session import checkpoint_dir


def crawl_shops(pages: DataFrame, prefix: str | None = None, default_currency: str = "USD", url_col: str = "url",
                html_col: str = "html") -> DataFrame:
    """Entry 1 over many shops in one plan: E2 detects each site's platform on
    its homepage (path ``/``; sites without one are generic), and one scan of
    the pages reads each with that platform's selectors (E3) in one stage,
    merge and transform.  The verdicts (one row a site, from the homepages
    alone) are checkpointed."""
    checkpoint_dir(pages.sparkSession)
    sited = pages.withColumn("site", url_origin(url_col))
    home = sited.withColumn("is_home", F.coalesce(url_pathname(url_col) == "/", F.lit(False)))
    sites = site_platforms(home.withColumnRenamed(html_col, "html"), "site", "is_home", url_col).checkpoint()
    routed = sited.join(sites.select("site", F.col("platform").alias("_platform")), "site", "left") \
        .select(*sited.columns, F.coalesce("_platform", F.lit("generic")).alias("platform"))
    return _outcomes(merge_fields(page_fields(routed, None, url_col, html_col)), prefix, default_currency, url_col)


def crawl_pages(pages: DataFrame, platform: str = "generic", prefix: str | None = None,
                default_currency: str = "USD", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Entry 1 over the pages of one platform."""
    return _outcomes(extract_pages(pages, platform, url_col, html_col), prefix, default_currency, url_col)


def _outcomes(ex: DataFrame, prefix: str | None, default_currency: str, url_col: str) -> DataFrame:
    """T, V and the status of every extracted page (extraction and transform are
    each large and are planned one by one, see ``once``)."""
    t = transform_frame(ex, "raw", url_col, prefix, default_currency)
    status = (F.when(F.col("rejected"), F.lit("skipped"))
              .when(F.col("product").isNotNull(), F.lit("crawled"))
              .otherwise(F.lit("failed")))
    error = (F.when(F.col("rejected"), F.lit("No product data found"))
             .when(F.col("product").isNull(), F.array_join("errors", "; ")))
    return t.withColumn("status", status).withColumn("error", error)
