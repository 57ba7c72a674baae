"""Sitemap XML scan, index resolution and fallback choice.

Fetching is replaced by a table ``sitemaps(url, xml)``, whose documents are
parsed with ``from_xml`` (malformed XML gives NULLs -> no URLs), or by XML files
(``scan_sitemap_files``), which are streamed; an index is resolved by equi-joins
on the child URL, level by level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: candidate locations when robots.txt lists no sitemap -------
COMMON_SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-products.xml", "/product-sitemap.xml",
                        "/sitemap_products_1.xml"]
# ------------------------------------------------------------------------------

_SCHEMA = "sitemap array<struct<loc:string>>, url array<struct<loc:string>>"


def parse_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """(url, kind, pos, loc) rows; kind = 'index' for <sitemap>, 'url' for <url>.
    Each document is parsed once."""
    p = sitemaps.select("url", F.from_xml(F.col("xml"), _SCHEMA, {"mode": "PERMISSIVE"}).alias("d"))
    tagged = lambda c, kind: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")),
                                         lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("loc")))
    rows = p.select("url", F.posexplode(F.concat(tagged("d.sitemap.loc", "index"), tagged("d.url.loc", "url"))).alias("pos", "x"))
    return rows.select("url", "x.kind", F.col("pos").cast("long").alias("pos"), F.trim("x.loc").alias("loc")).filter(F.col("loc").isNotNull())


def scan_sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """S2 over XML files: (file, kind, pos, loc), one row for each <url> and
    <sitemap> element.

    Files are streamed element by element and split between tasks, so a task's
    memory does not depend on their size.  Of a file that breaks off, the
    elements before the break are read.  ``pos`` orders the elements of a file.
    """
    def tagged(tag: str, kind: str) -> DataFrame:
        rows = spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").schema("loc string").load(path)
        return rows.select(F.col("_metadata.file_path").alias("file"), F.lit(kind).alias("kind"),
                           F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_n"),
                           F.trim("loc").alias("loc"))
    rows = tagged("sitemap", "index").unionByName(tagged("url", "url"))
    return rows.filter(F.col("loc").isNotNull()).select("file", "kind", F.struct("_at", "_n").alias("pos"), "loc")


def resolve(roots: DataFrame, parsed: DataFrame) -> DataFrame:
    """S3: (origin, url, ordinal) of the URLs reachable from ``roots(origin, url,
    place)`` through sitemap indexes of any depth.

    ``ordinal`` is the smallest path of places that leads to the URL: places
    compare like a depth-first walk.  An index is opened again only where a
    smaller path reaches it, so circles end.  Levels are checkpointed to the
    shared folder until none is left."""
    from ..session import checkpoint_dir
    checkpoint_dir(parsed.sparkSession)
    path = F.array(F.col("place").cast("long"))
    frontier = roots.groupBy("origin", F.col("url").alias("sm")).agg(F.min(path).alias("path"))
    best, found = frontier, None
    while True:
        docs = frontier.join(parsed, frontier.sm == parsed.url) \
            .select("origin", "kind", "loc", F.concat("path", F.array("pos")).alias("path")).checkpoint()
        urls = docs.filter(F.col("kind") == "url").groupBy("origin", F.col("loc").alias("url")).agg(F.min("path").alias("ordinal"))
        found = urls if found is None else found.unionByName(urls)
        reached = docs.filter(F.col("kind") == "index").groupBy("origin", F.col("loc").alias("sm")).agg(F.min("path").alias("path"))
        frontier = reached.join(best.withColumnRenamed("path", "_known"), ["origin", "sm"], "left") \
            .filter(F.col("_known").isNull() | (F.col("path") < F.col("_known"))).select("origin", "sm", "path").checkpoint()
        if frontier.isEmpty():
            return found.groupBy("origin", "url").agg(F.min("ordinal").alias("ordinal"))
        best = best.unionByName(frontier).groupBy("origin", "sm").agg(F.min("path").alias("path"))


def candidates(origins: DataFrame) -> DataFrame:
    """(origin, url, place) of the common locations of each origin."""
    paths = F.array(*[F.lit(p) for p in COMMON_SITEMAP_PATHS])
    return origins.select("origin", F.posexplode(paths).alias("place", "_p")).select("origin", F.concat("origin", "_p").alias("url"), "place")


def fallback_roots(origins: DataFrame, parsed: DataFrame) -> DataFrame:
    """First candidate location (in the fixed order) that leads to URLs,
    itself or through the indexes it lists."""
    first = resolve(candidates(origins), parsed).groupBy("origin").agg(F.min(F.get("ordinal", 0)).alias("place"))
    return candidates(origins).join(first, ["origin", "place"]).select("origin", "url")
