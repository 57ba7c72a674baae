"""V1-V4: product validation with a complete error list (not first-fail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.enums import AVAILABILITY_VALUES, CONDITION_VALUES
from ..functions.urls import MAX_PATH_LENGTH, PATH_PATTERN


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def validate_product(p: Column) -> Column:
    """V1: ``array<string>`` of every rule the product breaks (empty = valid)."""
    path = p["path"]
    checks = [
        F.when(_blank(p["sku"]), F.lit("sku is required and must be a string")),
        F.when(_blank(p["name"]), F.lit("name is required and must be a string")),
        F.when(_blank(path), F.lit("path is required and must be a string")),
        F.when(~_blank(path) & ~path.rlike(PATH_PATTERN),
               F.format_string('path "%s" does not match required pattern', path)),
        F.when(~_blank(path) & (F.length(path) > MAX_PATH_LENGTH), F.lit("path must be 900 characters or fewer")),
        F.when(p["availability"].isNotNull() & ~p["availability"].isin(*AVAILABILITY_VALUES),
               F.lit("availability must be one of: " + ", ".join(AVAILABILITY_VALUES))),
        F.when(p["itemCondition"].isNotNull() & ~p["itemCondition"].isin(*CONDITION_VALUES),
               F.lit("itemCondition must be one of: " + ", ".join(CONDITION_VALUES))),
    ]
    fixed = F.filter(F.array(*checks), lambda x: x.isNotNull())
    img_errs = F.filter(F.transform(F.coalesce(p["images"], F.array()),
                                    lambda im, i: F.when(_blank(im["url"]), F.format_string(
                                        "images[%d].url is required and must be a string", i))),
                        lambda x: x.isNotNull())

    def variant_errs(v, i):
        return F.filter(F.array(
            F.when(_blank(v["sku"]), F.format_string("variants[%d].sku is required", i)),
            F.when(_blank(v["name"]), F.format_string("variants[%d].name is required", i)),
            F.when(_blank(v["url"]), F.format_string("variants[%d].url is required", i)),
            F.when(v["images"].isNull(), F.format_string("variants[%d].images is required and must be an array", i)),
        ), lambda x: x.isNotNull())

    var_errs = F.flatten(F.transform(F.coalesce(p["variants"], F.array()), variant_errs))
    meta = p["metadata"]
    meta_errs = F.transform(F.filter(F.map_entries(F.coalesce(meta, F.create_map().cast("map<string,string>"))),
                                     lambda kv: kv["value"].isNull()),
                            lambda kv: F.format_string("metadata.%s must be a string", kv["key"]))
    return F.concat(fixed, img_errs, var_errs, meta_errs)


# --- fixed values: fields that must be strings where given -------------------
TEXT_FIELDS = ["description", "metaTitle", "metaDescription", "url", "brand", "gtin"]
PRICE_FIELDS = ["currency", "regular", "final"]
RATING_FIELDS = ["ratingValue", "reviewCount", "bestRating", "worstRating"]
# ------------------------------------------------------------------------------


def validate_raw(raw: str = "raw") -> Column:
    """V1 on a record as it was read (VARIANT column ``raw``): every rule,
    types included.  A JSON null is given but has no right type; a missing
    field is not given."""
    get = lambda path, of=raw: f"try_variant_get({of}, '$.{path}', 'variant')"
    kind = lambda v: f"left(schema_of_variant({v}), 3)"
    is_text = lambda v: f"coalesce({kind(v)} = 'STR', false)"
    is_full = lambda v: f"({is_text(v)} AND coalesce(try_variant_get({v}, '$', 'string') <> '', false))"
    is_object = lambda v: f"coalesce({kind(v)} IN ('OBJ', 'ARR'), false)"
    when = lambda test, text: f"if({test}, \"{text}\", NULL)"

    def given(path, test, text):
        return when(f"{get(path)} IS NOT NULL AND NOT ({test})", text)

    def one_of(path, values):
        listed = ", ".join(f"'{x}'" for x in values)
        return given(path, f"{is_text(get(path))} AND try_variant_get({raw}, '$.{path}', 'string') IN ({listed})",
                     f"{path} must be one of: {', '.join(values)}")

    def members(path, names):
        return [given(path, is_object(get(path)), f"{path} must be an object"),
                *[given(f"{path}.{n}", is_text(get(f"{path}.{n}")), f"{path}.{n} must be a string") for n in names]]

    def each(path, body):
        elements = f"coalesce(try_variant_get({raw}, '$.{path}', 'array<variant>'), cast(array() AS array<variant>))"
        return f"flatten(transform({elements}, (x, i) -> {body}))"

    def missing(name, tail, test=is_full):
        return f"if({test(get(name, 'x'))}, NULL, concat('{{}}[', i, '].{name} is required{tail}'))"
    path_text = f"try_variant_get({raw}, '$.path', 'string')"
    flat = [
        *[when(f"NOT {is_full(get(k))}", f"{k} is required and must be a string") for k in ("sku", "name", "path")],
        f"if({is_full(get('path'))} AND NOT ({path_text} RLIKE '{PATH_PATTERN}'), "
        f"concat('path \"', {path_text}, '\" does not match required pattern'), NULL)",
        when(f"{is_full(get('path'))} AND length({path_text}) > {MAX_PATH_LENGTH}", f"path must be {MAX_PATH_LENGTH} characters or fewer"),
        *[given(k, is_text(get(k)), f"{k} must be a string") for k in TEXT_FIELDS],
        *members("price", PRICE_FIELDS),
        one_of("availability", AVAILABILITY_VALUES), one_of("itemCondition", CONDITION_VALUES),
        given("images", f"{kind(get('images'))} = 'ARR'", "images must be an array"),
    ]
    image = f"array({missing('url', ' and must be a string').replace('{}', 'images')})"
    is_list = lambda v: f"coalesce({kind(v)} = 'ARR', false)"
    variant = ("array(" + ", ".join([*[missing(k, "") for k in ("sku", "name", "url")],
                                     missing("images", " and must be an array", is_list)]) + ")").replace("{}", "variants")
    tail = [given("variants", f"{kind(get('variants'))} = 'ARR'", "variants must be an array")]
    last = [*members("aggregateRating", RATING_FIELDS), given("metadata", is_object(get("metadata")), "metadata must be an object")]
    entries = f"coalesce(map_entries(try_variant_get({raw}, '$.metadata', 'map<string,variant>')), array())"
    meta = (f"transform(filter({entries}, e -> NOT {is_text('e.value')}), e -> concat('metadata.', e.key, ' must be a string'))")
    found = (f"filter(concat(array({', '.join(flat)}), {each('images', image)}, array({', '.join(tail)}), {each('variants', variant)}, "
             f"array({', '.join(last)}), {meta}), e -> e IS NOT NULL)")
    return F.expr(f"if({is_object(raw)}, {found}, array('product must be an object'))")


def validate_batch(products: DataFrame, product_col: str = "product", index_col: str = "index") -> DataFrame:
    """V2: per-row (index, valid, errors); overall flag via :func:`batch_valid`."""
    errs = validate_product(F.col(product_col))
    return products.select(index_col, (F.size(errs) == 0).alias("valid"), errs.alias("errors"))


def batch_valid(results: DataFrame) -> DataFrame:
    return results.agg(F.coalesce(F.bool_and("valid"), F.lit(True)).alias("valid"))


def validate_assembled(p: Column) -> Column:
    """V3: the three rules applied to products assembled from CSV rows."""
    sku = p["sku"]
    return F.filter(F.array(
        F.when(_blank(sku), F.lit("Missing SKU in a product")),
        F.when(_blank(p["name"]), F.format_string("Missing name for SKU %s", F.coalesce(sku, F.lit("undefined")))),
        F.when(_blank(p["path"]), F.format_string("Missing path for SKU %s", F.coalesce(sku, F.lit("undefined")))),
    ), lambda x: x.isNotNull())


def dry_run_report(files: DataFrame, raw_col: str = "raw", file_col: str = "file",
                   corrupt_col: str = "parse_error") -> DataFrame:
    """V4: total / valid / skipped with one reason row per skipped file.

    ``files`` has one row per product: the record as it was read (``raw``), or
    a parse error.  Returns (total, valid, skipped) and the reasons as a second
    frame.
    """
    errs = F.when(F.col(corrupt_col).isNotNull(), F.array(F.col(corrupt_col))).otherwise(validate_raw(raw_col))
    checked = files.select(file_col, errs.alias("errors"))
    summary = checked.agg(F.count(F.lit(1)).alias("total"),
                          F.count_if(F.size("errors") == 0).alias("valid"),
                          F.count_if(F.size("errors") > 0).alias("skipped"))
    reasons = checked.filter(F.size("errors") > 0).select(
        file_col, F.concat(F.col(file_col), F.lit(": "), F.array_join("errors", ", ")).alias("reason"))
    return summary, reasons
