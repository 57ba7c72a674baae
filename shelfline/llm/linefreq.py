"""Quality rules with cross-document line frequency (DataFrame functions only).

Base rules look at one text: words, symbols, repeated lines and words in
repeated windows of five.  The line rule looks across documents: lines are
normalised (white space runs to one blank, lower case) and hashed, and the
documents of each host that hold a line are counted.  A line held by more
than ``max(min_docs, min(max_docs, max_share * documents of the host))``
documents is boilerplate and removed: a share of small hosts, a fixed number of
documents on large ones; a document is depleted, and rejected, when the rest
has fewer than ``min_words`` words or less than ``min_left`` of its words.

The texts are read once; what the rules need (counts, and a hash and a word
count for each line) is written as a narrow table.  Counting combines before
its shuffle and a document counts a line once, so a line that is everywhere
costs one row a task.  Boilerplate lines meet the lines of the documents in a
join on host and hash.

Defined results: null text has no words and no lines; the null host is a host
like any other; repeated rows are documents of their own; null ids are kept;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
MIN_DOCS = 10
MAX_SHARE = 0.05
MAX_DOCS = 20
MIN_LEFT = 0.5
SYMBOLS = "#*$%&|<>"
_WS = "[\\x20\\x09-\\x0D]+"


def _words(c: Column) -> Column:
    return F.array_remove(F.split(c, _WS), "")


def base_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``doc_id, host``, the base counts and ``lines`` (hash and words of each
    normalised line with a word)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"))
    has_word = lambda x: x.rlike("[^\\x20\\x09-\\x0D]")
    d = d.select("*", _words(F.col("text")).alias("words"),
                 F.filter(F.split("text", "\n"), has_word).alias("raw_lines"))
    d = d.select("*", F.size("words").cast("long").alias("n_words"),
                 F.transform("raw_lines", lambda x: F.lower(F.trim(F.regexp_replace(x, _WS, " ")))).alias("norm"))
    # hashes of the windows of five words, by position
    gram = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])
    d = d.withColumn("grams", F.when(F.col("n_words") >= WINDOW, F.transform(
        F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")), gram)))
    # only a text with a repeated window is sorted: equal hashes become neighbours
    d = d.withColumn("placed", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(
        F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda e, k: (F.coalesce(F.get("placed", k - 1)["h"] == e["h"], F.lit(False))
                         | F.coalesce(F.get("placed", k + 1)["h"] == e["h"], F.lit(False)))
    d = d.withColumn("found", F.sort_array(F.transform(F.filter("placed", twin), lambda e: e["i"])))
    # each repeated window covers the words since the one before, five at most
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at"))
    covered = F.aggregate("found", start, lambda a, p: F.struct(
        (a["n"] + F.least(p - a["at"], F.lit(WINDOW))).alias("n"), p.alias("at")), lambda a: a["n"])
    line = lambda x: F.struct(F.xxhash64(x).alias("h"),
                              (F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1).alias("words"))
    squeezed = F.regexp_replace("text", _WS, "")
    return d.select(
        "doc_id", "host", "n_words", F.length(squeezed).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("raw_lines") - F.size(F.array_distinct("raw_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.transform("norm", line).alias("lines"))


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
               min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS, min_words: int = MIN_WORDS,
               min_left: float = MIN_LEFT) -> DataFrame:
    """One row for each document: the base counts, ``base_failed``,
    ``words_left`` (without boilerplate lines) and ``kept``."""
    metrics = base_metrics(docs, id_col, text_col, host_col).withColumn("row", F.monotonically_increasing_id())
    each = stored(metrics, "lines")
    hosts = each.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"))
    held = each.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")) \
        .groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_docs)
    often = held.alias("l").join(hosts.alias("o"), F.col("l.host").eqNullSafe(F.col("o.host"))) \
        .filter((F.col("n") > max_docs) | (F.col("n") > F.col("n_docs") * max_share)) \
        .select(F.col("l.host").alias("_host"), F.col("h").alias("_h"))
    often = stored(often, "often")
    # words in boilerplate lines, by document; only rows with such a line go on to the sum
    line = each.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.*")
    gone = line.join(often, (F.col("h") == F.col("_h")) & F.col("host").eqNullSafe(F.col("_host"))) \
        .groupBy(F.col("row").alias("_row")).agg(F.sum("words").alias("gone"))
    out = each.join(gone, F.col("row") == F.col("_row"), "left")
    out = out.withColumn("words_left", F.col("n_words") - F.coalesce("gone", F.lit(0)))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    depleted = (F.col("words_left") < min_words) | (F.col("words_left") < F.col("n_words") * min_left)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), "words_left", (~failed & ~depleted).alias("kept"))
