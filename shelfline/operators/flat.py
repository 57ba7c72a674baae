"""Products <-> wide CSV rows (parent row + one row per variant)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import capitalize_first, first_and_last, let
from ..schemas import CSV_COLUMNS, IMAGE, NUM_IMAGE_COLS, csv_columns


def _s(c) -> Column:
    return F.coalesce(c, F.lit(""))


def _image_cols(images: Column, n: int) -> list[Column]:
    return [*[_s(F.get(images, i)["url"]).alias(f"image_{i + 1}") for i in range(n)],
            *[_s(F.array_join(F.get(images, i)["roles"], "|")).alias(f"image_{i + 1}_roles") for i in range(n)]]


def _opt(options: Column, oid: str, field: str) -> Column:
    return _s(F.get(F.filter(options, lambda o: o["id"] == oid), 0)[field])


def _chunks(images: Column, n: int) -> Column:
    """Row numbers 0, 1, ... that hold all ``images``, ``n`` to a row."""
    return F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.coalesce(F.size(images), F.lit(0)) / n) - 1, F.lit(0)).cast("int")))


def _rows(df: DataFrame, kind: Column, images: Column, n: int, keys: list[Column], values: dict[str, Column]) -> DataFrame:
    """A row of ``values`` for each row of ``df``, and an ``images`` row (its
    number in ``name``) for each ``n`` images more."""
    split = df.select("*", _chunks(images, n).alias("_chunk"))
    main = F.col("_chunk") == 0
    only = lambda c: F.when(main, _s(c)).otherwise(F.lit(""))
    shown = {c: only(v) for c, v in values.items()}
    shown["name"] = F.when(main, _s(values["name"])).otherwise(F.col("_chunk").cast("string"))
    cols = {"type": F.when(main, kind).otherwise(F.lit("images")), **{k: _s(c) for k, c in zip(("sku", "parent_sku"), keys)}, **shown}
    here = F.slice(images, F.col("_chunk") * n + 1, F.lit(n))
    return split.select(*[c.alias(k) for k, c in cols.items()], *_image_cols(here, n)).select(*csv_columns(n))


def _parent_values() -> dict[str, Column]:
    p = F.col
    none = F.lit("")
    return {
        "name": p("name"), "path": p("path"), "url": p("url"), "description": p("description"), "meta_title": p("metaTitle"),
        "meta_description": p("metaDescription"), "price_currency": p("price.currency"), "price_regular": p("price.regular"),
        "price_final": p("price.final"), "availability": p("availability"), "option_size": none, "option_color": none,
        "option_size_uid": none, "option_color_uid": none, "categories": F.array_join(p("custom.categories"), "|"),
        "related": F.array_join(p("custom.related"), "|")}


def _variant_values(v: Column) -> dict[str, Column]:
    none = F.lit("")
    return {
        "name": v["name"], "path": none, "url": v["url"], "description": none, "meta_title": none, "meta_description": none,
        "price_currency": v["price"]["currency"], "price_regular": v["price"]["regular"], "price_final": v["price"]["final"],
        "availability": v["availability"], "option_size": _opt(v["options"], "size", "value"),
        "option_color": _opt(v["options"], "color", "value"), "option_size_uid": _opt(v["options"], "size", "uid"),
        "option_color_uid": _opt(v["options"], "color", "uid"), "categories": none, "related": none}


def parent_rows(products: DataFrame, images: int = NUM_IMAGE_COLS) -> DataFrame:
    """X1 parent rows from products (PRODUCT shape)."""
    return _rows(products, F.lit("parent"), F.col("images"), images, [F.col("sku"), F.lit("")], _parent_values())


def variant_rows(variants: DataFrame, parent_sku_col: str = "parent_sku", variant_col: str = "v",
                 images: int = NUM_IMAGE_COLS) -> DataFrame:
    """X1 variant rows from the exploded variants table (parent_sku, v)."""
    v = F.col(variant_col)
    return _rows(variants, F.lit("variant"), v["images"], images, [v["sku"], F.col(parent_sku_col)], _variant_values(v))


def _product_rows(products: DataFrame, images: int) -> DataFrame:
    """X1 rows from products with their ``variants``: each product's parent row
    and then its variants in their order, in one pass over the products."""
    kind = products.schema["variants"].dataType
    entries = F.concat(F.array(F.lit(None).cast(kind.elementType)), F.coalesce("variants", F.array().cast(kind)))
    rows = products.select("*", F.posexplode(entries).alias("_place", "_v"))
    v, parent = F.col("_v"), F.col("_place") == 0
    pick = lambda p, c: F.when(parent, p).otherwise(c)
    own = _variant_values(v)
    return _rows(rows, pick(F.lit("parent"), F.lit("variant")), pick(F.col("images"), v["images"]), images,
                 [pick(F.col("sku"), v["sku"]), pick(F.lit(""), F.col("sku"))], {k: pick(p, own[k]) for k, p in _parent_values().items()})


def flat_rows(products: DataFrame, variants: DataFrame | None = None, images: int = NUM_IMAGE_COLS) -> DataFrame:
    """Parents union variants, fixed column order; narrow (no shuffle, and
    no job while the plan is built).  A row has ``images`` image columns; more
    images follow in rows of type ``images`` with the SKUs of their row.

    ``variants`` is the exploded form (parent_sku, v, ordinal); when omitted
    the rows of ``products.variants`` follow each product's row.
    """
    if variants is None:
        return _product_rows(products, images)
    return parent_rows(products, images).unionByName(variant_rows(variants, images=images)).select(*csv_columns(images))


def flat_counts(rows: DataFrame) -> DataFrame:
    """Rows per type."""
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("count"))


#: Records of a CSV file, unless the caller says otherwise.
MAX_RECORDS = 1_000_000


def write_csv(rows: DataFrame, path: str, max_records: int = MAX_RECORDS, compression: str = "none") -> None:
    """RFC 4180 CSV with header, quotes doubled, empty for NULL; a file has
    at most ``max_records`` records.  ``compression`` (as ``gzip``) is for files that
    ``read_csv`` reads again, which does not split them anyway."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", max_records).option("header", True).option("quote", '"') \
        .option("escape", '"').option("nullValue", "").option("emptyValue", "") \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("compression", compression).csv(path)


def read_csv(spark, path: str) -> DataFrame:
    """Header-keyed wide CSV; quoted newlines; missing fields -> ''.  One
    task reads a file; ``sources.quoted_csv`` splits large ones."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    there = df.columns
    names = [*CSV_COLUMNS, *[c for c in there if c not in CSV_COLUMNS]]
    df = df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_row", F.monotonically_increasing_id())
    return df.select(*[(F.coalesce(F.col(c), F.lit("")) if c in there else F.lit("")).alias(c) for c in names], "_file", "_row")


def _images_from_row(n: int) -> Column:
    imgs = F.array(*[F.struct(F.col(f"image_{i}").alias("url"), F.lit(None).cast("string").alias("label"),
                              F.when(F.col(f"image_{i}_roles") != "",
                                     F.filter(F.split(F.col(f"image_{i}_roles"), r"\|"), lambda r: r != ""))
                              .alias("roles")) for i in range(1, n + 1)])
    return F.filter(imgs, lambda im: im["url"] != "")


def _price_from_row() -> Column:
    c, r, f = F.col("price_currency"), F.col("price_regular"), F.col("price_final")
    return F.when((c != "") | (r != "") | (f != ""), F.struct(
        F.when(c != "", c).alias("currency"), F.when(r != "", r).alias("regular"), F.when(f != "", f).alias("final")))


def assemble_products(rows: DataFrame, ordinal_col: str = "_row") -> DataFrame:
    """X2 + X3: wide rows (with their image rows) -> products; variants attach by ``parent_sku`` in row
    order; options rebuilt size then color, last UID wins.

    Variants are gathered with one aggregation keyed by parent SKU (the
    product's own variant list is the unit of output).
    """
    here = _images_from_row(len([c for c in rows.columns if re.fullmatch(r"image_\d+", c)]))
    # image rows of one SKU pair, in the order of their numbers
    more = rows.filter(F.col("type") == "images").groupBy("parent_sku", "sku").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("name").cast("int").alias("n"), here.alias("i")))), lambda x: x["i"])).alias("_more"))
    images = F.concat(here, F.coalesce("_more", F.array().cast(f"array<{IMAGE.simpleString()}>")))
    parents = rows.filter(F.col("type") == "parent").join(more, ["parent_sku", "sku"], "left")
    # variants and their image rows meet where the variants of a parent are gathered, so these are shuffled once; the
    # image rows of parents have a blank parent SKU and stay away, but for those that a variant without parent shares
    orphans = rows.filter((F.col("type") == "variant") & (F.col("parent_sku") == "")) \
        .select("parent_sku", "sku").distinct().withColumn("_orphan", F.lit(True))
    theirs = more.join(orphans, ["parent_sku", "sku"], "left") \
        .filter(((F.col("parent_sku") != "") | F.col("_orphan")) & F.col("sku").isNotNull()).drop("_orphan")
    options = {"size": "option_size", "size_uid": "option_size_uid", "color": "option_color", "color_uid": "option_color_uid"}
    var = rows.filter(F.col("type") == "variant").select(
        "parent_sku", "sku", F.col(ordinal_col).alias("_o"), here.alias("_here"), _price_from_row().alias("_price"),
        "name", "url", "availability", *options.values(), F.lit(True).alias("_variant"))
    pair = F.first("_more", True).over(Window.partitionBy("parent_sku", "sku"))
    var = var.unionByName(theirs, allowMissingColumns=True).repartition("parent_sku").withColumn("_more", pair).filter("_variant")
    images_of_variant = F.concat("_here", F.coalesce("_more", F.array().cast(f"array<{IMAGE.simpleString()}>")))
    choice = [F.col(c).alias(k) for k, c in options.items()]
    var = var.select(
        "parent_sku", "_o",
        F.struct(F.col("sku"), F.col("name"), F.when(F.col("url") != "", F.col("url")).alias("url"),
                 F.when(F.size(images_of_variant) > 0, images_of_variant).alias("images"),
                 F.col("_price").alias("price"),
                 F.when(F.col("availability") != "", F.col("availability")).alias("availability"), *choice).alias("v"),
        F.struct(*choice).alias("c"))

    def in_order(c):
        return F.transform(F.sort_array(F.collect_list(F.struct("_o", c))), lambda x: x[c])
    # two lists, so a plan that asks for the options only does not move the rest
    grouped = var.groupBy(F.col("parent_sku").alias("sku")).agg(in_order("v").alias("_vs"), in_order("c").alias("_cs"))

    def opts_of(vs):
        pairs = F.flatten(F.transform(vs, lambda v: F.filter(F.array(
            F.when(v["size"] != "", F.struct(F.lit("size").alias("id"), v["size"].alias("value"),
                                             v["size_uid"].alias("uid"))),
            F.when(v["color"] != "", F.struct(F.lit("color").alias("id"), v["color"].alias("value"),
                                              v["color_uid"].alias("uid")))), lambda x: x.isNotNull())))

        def options(ends):  # first and last element of every id and value, in order
            def build(oid, i):
                return F.struct(oid.alias("id"), capitalize_first(oid).alias("label"), (i + 1).alias("position"), F.transform(
                    F.filter(ends, lambda e: e["first"]["id"] == oid),
                    lambda e: F.struct(e["first"]["value"].alias("value"), F.nullif(e["last"]["uid"], F.lit("")).alias("uid"))).alias("values"))
            return F.transform(F.array_distinct(F.transform(ends, lambda e: e["first"]["id"])), build)
        return let(first_and_last(pairs, lambda o: (o["id"], o["value"])), options)

    out = parents.join(grouped, "sku", "left")
    vs = F.col("_vs")
    variants = F.transform(vs, lambda v: F.struct(
        v["sku"].alias("sku"), v["name"].alias("name"), v["url"].alias("url"), v["images"].alias("images"),
        v["price"].alias("price"), v["availability"].alias("availability"),
        F.when((v["size"] != "") | (v["color"] != ""), F.filter(F.array(
            F.when(v["size"] != "", F.struct(F.lit("size").alias("id"), v["size"].alias("value"),
                                             F.when(v["size_uid"] != "", v["size_uid"]).alias("uid"))),
            F.when(v["color"] != "", F.struct(F.lit("color").alias("id"), v["color"].alias("value"),
                                              F.when(v["color_uid"] != "", v["color_uid"]).alias("uid")))),
            lambda x: x.isNotNull())).alias("options")))
    return out.select(
        F.col("path"), F.col("sku"), F.col("name"), F.when(F.col("url") != "", F.col("url")).alias("url"),
        F.when(F.col("description") != "", F.col("description")).alias("description"),
        F.when(F.col("meta_title") != "", F.col("meta_title")).alias("metaTitle"),
        F.when(F.col("meta_description") != "", F.col("meta_description")).alias("metaDescription"),
        _price_from_row().alias("price"),
        F.when(F.col("availability") != "", F.col("availability")).alias("availability"),
        F.when(F.size(images) > 0, images).alias("images"),
        F.when(F.size(vs) > 0, variants).alias("variants"),
        F.when(F.size("_cs") > 0, opts_of(F.col("_cs"))).alias("options"),
        F.when((F.col("categories") != "") | (F.col("related") != ""), F.struct(
            F.when(F.col("categories") != "", F.filter(F.split("categories", r"\|"), lambda x: x != "")).alias("categories"),
            F.when(F.col("related") != "", F.filter(F.split("related", r"\|"), lambda x: x != "")).alias("related"),
        )).alias("custom"))
