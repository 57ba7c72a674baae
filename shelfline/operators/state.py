"""Crawl-state table, reports, batch plan and delivery summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BATCH_SIZE = 50
AUTH_FAIL_CODES = [401, 403]
RECENT_FAILURES = 10
RECENT_ERRORS = 20


def upsert_frontier(state: DataFrame | None, discovered: DataFrame, key: str = "url",
                    ordinal: str = "ordinal") -> DataFrame:
    """New keys enter as pending; existing keys are untouched (anti join)."""
    new = discovered.groupBy(key).agg(F.min(ordinal).alias(ordinal)).select(
        key, F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("timestamp").alias("crawled_at"), ordinal)
    if state is None:
        return new
    return state.unionByName(new.join(state.select(key), key, "left_anti"))


def apply_outcomes(state: DataFrame, outcomes: DataFrame, key: str = "url") -> DataFrame:
    """R2: replay outcomes (key, seq, status, error, at) onto known keys.

    Final status is the last outcome's; ``crawled_at`` is the last crawl time
    (failed/skipped do not clear it) and ``error`` the last failure or skip
    reason (crawled does not clear it).  Unknown keys are ignored (inner join).
    ``max_by`` aggregates partially before the shuffle, so a hot key costs one
    row per map task.
    """
    last = outcomes.groupBy(key).agg(
        F.max_by("status", "seq").alias("_status"),
        F.max_by(F.when(F.col("status") == "crawled", F.col("at")),
                 F.when(F.col("status") == "crawled", F.col("seq"))).alias("_at"),
        F.max_by(F.when(F.col("status").isin("failed", "skipped"), F.col("error")),
                 F.when(F.col("status").isin("failed", "skipped"), F.col("seq"))).alias("_error"))
    j = state.join(last, key, "left")
    return j.select(key, F.coalesce("_status", "status").alias("status"),
                    F.coalesce("_error", "error").alias("error"),
                    F.coalesce("_at", "crawled_at").alias("crawled_at"), "ordinal")


def pending(state: DataFrame) -> DataFrame:
    """Keys still to process."""
    return state.filter(F.col("status") == "pending")


def stats(state: DataFrame) -> DataFrame:
    """R4/R5/R7 in one pass: counts, percentages of discovered, completion."""
    agg = state.agg(F.count(F.lit(1)).alias("discovered"),
                    F.count_if(F.col("status") == "crawled").alias("crawled"),
                    F.count_if(F.col("status") == "failed").alias("failed"),
                    F.count_if(F.col("status") == "skipped").alias("skipped"))
    agg = agg.withColumn("pending", F.col("discovered") - F.col("crawled") - F.col("failed") - F.col("skipped"))

    def pct(c):
        return F.when(F.col("discovered") > 0,
                      F.format_string("%.1f%%", F.col(c) * 100.0 / F.col("discovered"))) \
            .otherwise(F.lit("0%"))
    return agg.select("*", *[pct(c).alias(f"{c}_pct") for c in ("crawled", "failed", "skipped", "pending")],
                      (F.col("pending") == 0).alias("complete"))


def recent_failures(state: DataFrame, key: str = "url", n: int = RECENT_FAILURES) -> DataFrame:
    """First ``n`` failed keys in insertion order."""
    return state.filter(F.col("status") == "failed").orderBy("ordinal").limit(n).select(key, "error", "ordinal")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``idx``, the row's place (from 0) in the total order of ``order``.

    No window over the data: rows are range-partitioned and sorted, written to
    the shared checkpoint folder (so every reader sees the same partitioning,
    even after executors are lost), numbered inside their partition and moved
    by the rows of the partitions before.  The only unpartitioned window runs
    over one row per partition.
    """
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()) \
        .checkpoint(eager=True)
    part = F.shiftright("_mid", 33)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sorted_.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n")) \
        .select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return sorted_.join(offsets, part == F.col("_p")) \
        .withColumn("idx", F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_mid", "_p", "_off")


def batch_plan(products: DataFrame, *order: str, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Consecutive chunks of ``batch_size`` in the order of ``order``, whose
    last column should be unique so that reruns agree (path, then SKU).
    """
    return numbered(products, *order).withColumn("batch", F.floor(F.col("idx") / batch_size).cast("long")) \
        .withColumn("pos", (F.col("idx") % batch_size).cast("int"))


def delivered(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Batches that were sent, with their outcome (batch, n, status_code): an
    authorisation failure stops every later batch."""
    sizes = plan.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    j = sizes.join(outcomes, "batch", "left")
    cut = j.agg(F.min(F.when(F.col("status_code").isin(*AUTH_FAIL_CODES), F.col("batch"))).alias("_cut"))
    return j.crossJoin(cut).filter(F.col("_cut").isNull() | (F.col("batch") <= F.col("_cut"))).drop("_cut")


def failed_skus(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row for each SKU of a failed batch (sku, batch, status_code)."""
    bad = delivered(plan, outcomes).filter(~F.coalesce(F.col("status_code").between(200, 299), F.lit(False)))
    return plan.select("sku", "batch").join(bad.select("batch", "status_code"), "batch").select("sku", "batch", "status_code")


def delivery_errors(plan: DataFrame, outcomes: DataFrame, n: int = RECENT_ERRORS) -> DataFrame:
    """The first ``n`` failed batches in batch order."""
    bad = delivered(plan, outcomes).filter(~F.coalesce(F.col("status_code").between(200, 299), F.lit(False)))
    return bad.orderBy("batch").limit(n)


def delivery_summary(plan: DataFrame, outcomes: DataFrame, skipped: int = 0) -> DataFrame:
    """Totals from per-batch outcomes (batch, status_code); one row."""
    ok = F.coalesce(F.col("status_code").between(200, 299), F.lit(False))
    return delivered(plan, outcomes).agg(
        F.sum("n").alias("counted"),
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("uploaded"),
        F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).alias("failed"),
        F.lit(skipped).alias("skipped"),
        F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).alias("failed_skus"),
        F.min(F.when(~ok, F.col("batch"))).alias("first_failed_batch"),
    )
