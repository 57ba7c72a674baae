"""The CSV round trip moves each variant once, and its files are compressed."""

import glob

import pytest
from pyspark.sql import functions as F

from shelfline.operators.flat import assemble_products, flat_rows, read_csv, write_csv
from shelfline.plans import QUERIES, load_all
from shelfline.schemas import CSV_COLUMNS, PRODUCT
from shelfline.session import checkpoint_dir

ROW = ", ".join(f"{c} string" for c in CSV_COLUMNS)


def _rows(spark, *rows):
    values = [tuple(r.get(c, "") for c in CSV_COLUMNS) + (n,) for n, r in enumerate(rows)]
    return spark.createDataFrame(values, ROW + ", _row long").repartition(3)


def _tables(spark, folder):
    spark.createDataFrame([(p, "red blue" if p != 1 else "green blue", "B", "T", 1, 9.5) for p in (0, 1, 1, 2, None)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double") \
        .write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(o, p, s, (o + (s or 0)) % 2 + 1, "N") for o in range(2) for p in (1, 2, 5, None) for s in (1, 2, None)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string") \
        .write.parquet(f"{folder}/lineitem.parquet")


def test_variants_are_shuffled_once(spark):
    out = assemble_products(_rows(spark, {"type": "parent", "sku": "A"}))
    for columns in (["sku", "options"], ["sku", "variants"]):
        plan = out.select(*columns)._jdf.queryExecution().executedPlan().toString()
        # dealt by parent as single rows: neither the images nor the list of a parent need another exchange
        lines = plan.split("\n")
        made, = [n for n, line in enumerate(lines) if "[collect_list(struct(_o" in line]
        dealt = next(n for n in range(made, len(lines)) if "Exchange" in lines[n])
        assert "hashpartitioning(parent_sku#" in lines[dealt] and "REPARTITION_BY_COL" in lines[dealt]
        assert "partial_collect_list(struct(_o" in lines[made + 1]
        assert ("Window" in "".join(lines[made:dealt])) == ("variants" in columns)
    options = out.select("sku", "options")._jdf.queryExecution().optimizedPlan().toString()
    assert options.count("collect_list(") == 1 and "_here" not in options


def test_image_rows_reach_parents_variants_and_variants_without_parent(spark):
    images = lambda sku, parent, n, *urls: {"type": "images", "sku": sku, "parent_sku": parent, "name": str(n), **{
        f"image_{i + 1}": u for i, u in enumerate(urls)}}
    p = {r.sku: r for r in assemble_products(_rows(
        spark, {"type": "variant", "sku": "b", "parent_sku": "A", "image_1": "b0"}, images("b", "A", 2, "b3"), images("A", "", 1, "a1", "a2"),
        {"type": "parent", "sku": "A", "image_1": "a0"}, images("b", "A", 1, "b1", "b2"), {"type": "variant", "sku": "a", "parent_sku": "A"},
        {"type": "variant", "sku": "A", "parent_sku": "", "image_1": "o"}, {"type": "parent", "sku": "", "name": "none"},
        {"type": "variant", "sku": "x", "parent_sku": "gone"}, images("b", "C", 1, "c"))).collect()}
    urls = lambda x: [i.url for i in x.images] if x.images else None
    assert set(p) == {"A", ""} and urls(p["A"]) == ["a0", "a1", "a2"]
    assert [(v.sku, urls(v)) for v in p["A"].variants] == [("b", ["b0", "b1", "b2", "b3"]), ("a", None)]
    assert [(v.sku, urls(v)) for v in p[""].variants] == [("A", ["o", "a1", "a2"])]


def test_rows_of_a_product_follow_each_other(spark, tmp_path):
    image = [{"url": f"i{n}"} for n in range(12)]
    one = lambda sku, variants: {"sku": sku, "name": sku, "images": image if sku == "B" else None, "variants": variants}
    df = spark.createDataFrame([one("A", None), one("B", [{"sku": "2", "images": image}, None, {"sku": "1"}]), one(None, [])], PRODUCT).coalesce(1)
    rows = [(r.type, r.sku, r.parent_sku, r.name, r.image_1) for r in flat_rows(df).collect()]
    assert rows == [("parent", "A", "", "A", ""), ("parent", "B", "", "B", "i0"), ("images", "B", "", "1", "i10"), ("variant", "2", "B", "", "i0"),
                    ("images", "2", "B", "1", "i10"), ("variant", "", "B", "", ""), ("variant", "1", "B", "", ""), ("parent", "", "", "", "")]
    assert flat_rows(df)._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0
    write_csv(flat_rows(df), str(tmp_path / "plain"))
    write_csv(flat_rows(df), str(tmp_path / "packed"), compression="gzip")
    assert glob.glob(f"{tmp_path}/plain/*.csv") and glob.glob(f"{tmp_path}/packed/*.csv.gz")
    read = lambda name: sorted(map(tuple, read_csv(spark, str(tmp_path / name)).drop("_file").collect()))
    assert read("plain") == read("packed") and len(read("plain")) == len(rows)


@pytest.mark.parametrize("query", ["flat_options", "flat_roundtrip"])
def test_round_trip_of_odd_keys(spark, tmp_path, query):
    load_all()
    _tables(spark, tmp_path)
    before = set(glob.glob(f"{checkpoint_dir(spark)}/flat/*"))
    got = QUERIES[query](spark, str(tmp_path)).collect()
    made, = set(glob.glob(f"{checkpoint_dir(spark)}/flat/*")) - before
    assert glob.glob(f"{made}/*.csv.gz") and not glob.glob(f"{made}/*.csv")
    if query == "flat_roundtrip":  # part 1 comes twice, so each of its records gets the variants of both
        assert sorted((r.sku, r.n_variants) for r in got) == [("", 0), ("P-0", 0), ("P-1", 6), ("P-1", 6), ("P-2", 3)]
        assert {r.name for r in got if r.sku == "P-1"} == {"green blue"}
    else:
        size = sorted((r.value_position, r.value, r.uid) for r in got if r.sku == "P-2" and r.option_id == "size")
        assert size == [(1, "2", "S1"), (2, "1", "S2")] or size[0][1] == "1"
        assert [(r.value, r.uid) for r in got if r.sku == "P-2" and r.option_id == "color"] == [("red", "C2")]
        assert sum(r.sku == "P-1" for r in got) == 2 * sum(r.sku == "P-2" for r in got)
