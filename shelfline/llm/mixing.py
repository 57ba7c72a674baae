"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Sources get target sizes in proportion to their weights, but at most
``max_repeats`` times their own size; what is above goes to the others by
weight.  A document's expected number of copies is its source's target over
its source's size (times its importance, if given): the whole part are
certain copies, the rest is its inclusion probability ``p``.  With a random
number ``u`` of the document, documents are ranked by random odds over
inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``, and the head of that order
whose total size comes nearest to what the target still needs gets one more
copy: a sample of fixed size with unequal probabilities.

The head is found without sorting a source in one task: the rank is mapped to
(0, 1) and cut into ``BINS`` equal bins, sizes are summed by bin (a partial
aggregate), and only the bin in which the head ends is ordered row by row.
The table of sources (one row each) is ranked in one task.

Defined results: null text has size 0; the null source is a source like any
other; equal ids have equal random numbers and are ordered by size; null ids
count as one id; extra columns are kept by ``mix`` and may have any name that
``plan_columns`` does not list; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
BINS = 1 << 16
#: 13 hexadecimal digits: 52 bits, exact in a double.
_SPACE = float(1 << 52)


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str = "") -> Column:
    """Reproducible number in (0, 1) from the id's MD5."""
    named = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double") + 0.5) / _SPACE


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
                   share: float = 1.0) -> DataFrame:
    """``source, source_size, target`` from one row a source.

    Sources fill up in the order of their limit over weight.  While the level
    (words left over weight left) of the next source is above its limit over
    weight it is full; the highest level is the one all others share.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", w.alias("weight"),
                     (F.col("source_size") * float(max_repeats)).alias("limit"))
    fill = Window.orderBy((F.col("limit") / F.col("weight")), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("limit").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum(F.col("source_size").cast("double")).over(everything) * share
    s = s.withColumn("level", (total - before) / weight_left)
    level = F.max("level").over(everything)
    return s.select("source", "source_size", F.least("limit", F.col("weight") * level).alias("target"))


def _ranked(each: DataFrame, weights: tuple[int, ...], max_repeats: int, seed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``each(source, size, importance, key, ...)`` with the Pareto rank of every
    row, the sources' targets, and the bin in which each source's sample ends."""
    sums = each.groupBy("source").agg(F.sum("size").alias("source_size"),
                                      F.sum(F.col("size") * F.col("importance")).alias("heavy"))
    targets = source_targets(sums.select("source", "source_size"), weights, max_repeats).alias("t") \
        .join(sums.alias("m"), F.col("t.source").eqNullSafe(F.col("m.source"))) \
        .select(F.col("t.source").alias("_source"), F.col("t.source_size").alias("source_size"), "target", "heavy")
    targets = stored(targets, "targets")
    one = _rank(each.join(targets, F.col("source").eqNullSafe(F.col("_source"))), max_repeats, seed)
    # words that the sample of each source must give, and the bin in which it ends
    rows = one.groupBy("_source", "bin").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("whole")).alias("sure"),
                                             F.first("target").alias("target"))
    of_source = Window.partitionBy("_source")
    need = F.col("target") - F.sum("sure").over(of_source)
    upto = F.coalesce(F.sum("words").over(of_source.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sample = F.sum(F.when(F.col("bin").isNotNull(), F.col("words"))).over(of_source)
    cut = rows.select("_source", "bin", "words", need.alias("need"), sample.alias("sample"),
                      F.max("bin").over(of_source).alias("last_bin"),
                      F.when(F.col("bin").isNotNull(), upto - F.coalesce(
                          F.sum(F.when(F.col("bin").isNull(), F.col("words"))).over(of_source), F.lit(0))).alias("before")) \
        .filter(((F.col("before") < F.col("need")) & (F.col("before") + F.col("words") >= F.col("need")))
                | ((F.col("need") > F.col("sample")) & (F.col("bin") == F.col("last_bin")))) \
        .select(F.col("_source").alias("_cut_source"), F.col("bin").alias("end_bin"), "need", "before")
    cut = stored(cut, "cuts")
    return one, targets, cut


def _rank(rows: DataFrame, max_repeats: int, seed: str) -> DataFrame:
    """Adds expected and certain copies, the rank and its bin to rows with their source's ``target`` and ``heavy``."""
    fraction = F.when(F.col("heavy") > 0, F.col("target") / F.col("heavy") * F.col("importance")).otherwise(F.lit(0.0))
    return rows.withColumn("expected", F.least(fraction, F.lit(float(max_repeats)))) \
        .withColumn("whole", F.floor("expected")) \
        .withColumn("p", F.col("expected") - F.col("whole")) \
        .withColumn("u", uniform(F.col("key"), seed)) \
        .withColumn("rank", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))) \
        .withColumn("bin", F.floor(F.col("rank") / (F.col("rank") + 1) * BINS))


def _last_bin(one: DataFrame, cut: DataFrame) -> DataFrame:
    """The rows of the bins in which samples end, ``extra`` = 1 for those taken."""
    inside = Window.partitionBy("_source").orderBy("rank", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    return one.join(cut, F.col("_source").eqNullSafe(F.col("_cut_source"))).filter("bin = end_bin") \
        .withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))) \
        .withColumn("extra", (F.col("ahead") * 2 + F.col("size") <= F.col("need") * 2).cast("long"))


def mix_plan(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source",
             weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, importance: Column | None = None,
             seed: str = "") -> DataFrame:
    """One row for each document: ``doc_id, source, size, source_size, target,
    copies`` and ``taken`` (its words in the mix, copies counted)."""
    wide = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"),
                       (F.lit(1.0) if importance is None else importance.cast("double")).alias("importance"),
                       F.col(id_col).cast("string").alias("key"), F.lit(0).cast("long").alias("row"))
    one, _, cut = _ranked(stored(wide, "sizes"), weights, max_repeats, seed)
    # a source that needs more than its sample ends in its last bin, which it takes whole
    joined = one.join(cut, F.col("_source").eqNullSafe(F.col("_cut_source")), "left")
    rest = joined.filter("bin is null or end_bin is null or bin <> end_bin") \
        .withColumn("extra", F.when(F.col("bin") < F.col("end_bin"), 1).otherwise(0).cast("long"))
    cols = ["doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies")]
    out = _last_bin(one, cut).select(*cols).unionByName(rest.select(*cols))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
        max_repeats: int = MAX_REPEATS, importance: Column | None = None, seed: str = "") -> DataFrame:
    """The mixed documents themselves: each row as often as the mix takes it.
    Rows of documents without words are not taken.

    The sample of a source is the rows up to its last one in Pareto order, so a
    row's copies follow from the row and one row of its source: texts are
    stored once, with row numbers, and not joined or shuffled.  Rows are told
    apart by their number: rows of equal ids are taken one by one, and rows
    without an id have random numbers of their own.
    """
    name = F.col(id_col).cast("string")
    row = F.monotonically_increasing_id()
    rows = stored(docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"),
                              (F.lit(1.0) if importance is None else importance.cast("double")).alias("importance"), row.alias("row"),
                              F.coalesce(name, F.concat(F.lit("null "), row.cast("string"))).alias("key")), "rows")
    one, targets, cut = _ranked(rows.drop("doc"), weights, max_repeats, seed)
    place = F.struct("rank", "doc_id", "size", "row")
    last = _last_bin(one, cut).filter("extra = 1").groupBy(F.col("_source").alias("_last_source")).agg(F.max(place).alias("last"))
    ends = targets.join(cut, F.col("_source").eqNullSafe(F.col("_cut_source")), "left") \
        .join(last, F.col("_source").eqNullSafe(F.col("_last_source")), "left").select("_source", "target", "heavy", "end_bin", "last")
    ends = stored(ends, "ends")  # one row a source
    ranked = _rank(rows.join(ends, F.col("source").eqNullSafe(F.col("_source"))), max_repeats, seed)
    extra = F.when(F.col("bin") < F.col("end_bin"), 1).when((F.col("bin") == F.col("end_bin")) & (place <= F.col("last")), 1).otherwise(0)
    out = ranked.filter("size > 0").select("doc", (F.col("whole") + extra).cast("int").alias("copies")).filter("copies > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
