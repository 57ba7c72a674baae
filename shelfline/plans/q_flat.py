"""Round trip through the wide CSV file: X1 -> S12 -> S13 -> X2/X3 -> V3."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions.text import once
from ..operators import flat as FL
from ..operators.validate import validate_assembled
from ..session import checkpoint_dir
from . import standins as S
from .registry import query

_PAIRS = """pr AS (SELECT l_partkey, l_suppkey, arg_min(l_linenumber, (l_orderkey, l_linenumber)) AS ln
            FROM lineitem GROUP BY l_partkey, l_suppkey),
vr AS (SELECT 'P-' || CAST(l_partkey AS VARCHAR) AS psku,
              'P-' || CAST(l_partkey AS VARCHAR) || '-S-' || CAST(l_suppkey AS VARCHAR) AS vsku,
              CAST(ln AS VARCHAR) AS size, 'S' || CAST(l_suppkey AS VARCHAR) AS size_uid,
              split_part(p_name, ' ', 1) AS color, 'C' || CAST(l_suppkey AS VARCHAR) AS color_uid
       FROM pr JOIN part ON pr.l_partkey = part.p_partkey)"""


def _roundtrip(spark, sf_dir):
    # each product's rows come from one record: they stay together and in SKU order inside one file
    rows = FL.flat_rows(S.products_with_variants(spark, sf_dir))
    path = os.path.join(checkpoint_dir(spark), "flat", uuid.uuid4().hex)
    FL.write_csv(rows, path, compression="gzip")
    back = FL.read_csv(spark, path)
    place = F.struct(F.substring_index("_file", "/", -1), "_row")  # all files lie in one folder
    return FL.assemble_products(back.withColumn("_ord", place), ordinal_col="_ord")


@query("flat_roundtrip", f"""
WITH {_PAIRS},
n AS (SELECT psku, count(*) AS n FROM vr GROUP BY psku)
SELECT 'P-' || CAST(p_partkey AS VARCHAR) AS sku, p_name AS name,
  CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price_final, CAST(coalesce(n.n, 0) AS INTEGER) AS n_variants,
  '' AS errors
FROM part LEFT JOIN n ON n.psku = 'P-' || CAST(p_partkey AS VARCHAR)
""")
def flat_roundtrip(spark, sf_dir):
    """X1 rows written as CSV (S12), read back (S13), reassembled (X2), checked (V3)."""
    p = _roundtrip(spark, sf_dir)
    return p.select("sku", "name", F.col("price.final").alias("price_final"),
                    F.coalesce(F.size("variants"), F.lit(0)).cast("int").alias("n_variants"),
                    F.array_join(validate_assembled(F.struct("sku", "name", "path")), "; ").alias("errors"))


@query("flat_options", f"""
WITH {_PAIRS},
o AS (SELECT psku, vsku, 'size' AS option_id, 1 AS position, size AS value, size_uid AS uid FROM vr
      UNION ALL SELECT psku, vsku, 'color', 2, color, color_uid FROM vr),
v AS (SELECT psku, option_id, position, value, min(vsku) AS first, arg_max(uid, vsku) AS uid
      FROM o GROUP BY psku, option_id, position, value)
SELECT psku AS sku, option_id, CASE option_id WHEN 'size' THEN 'Size' ELSE 'Color' END AS label,
  CAST(position AS INTEGER) AS position,
  CAST(row_number() OVER (PARTITION BY psku, option_id ORDER BY first) AS INTEGER) AS value_position, value, uid
FROM v
""")
def flat_options(spark, sf_dir):
    """Options rebuilt from the CSV rows (size then color, last UID wins)."""
    p = _roundtrip(spark, sf_dir)
    o = p.select("sku", once("options").alias("os")).select("sku", F.explode("os").alias("o"))
    vals = o.select("sku", "o.id", "o.label", "o.position", F.posexplode("o.values").alias("vp", "val"))
    return vals.select("sku", F.col("id").alias("option_id"), "label", F.col("position").cast("int"),
                       (F.col("vp") + 1).cast("int").alias("value_position"), F.col("val.value").alias("value"),
                       F.col("val.uid").alias("uid"))
