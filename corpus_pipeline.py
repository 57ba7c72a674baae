"""Training-corpus pipeline: documents to packed token sequences.

``STAGES`` are applied in order; each stage's result is written as Parquet and
read again as the next stage's documents.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import mixing, packing, quality, simhash, suffixes
from shelfline.llm.common import stored
from shelfline.llm.queries import held_out
from shelfline.session import ship_package

#: Texts change in several stages and packing is not SQL: the pipeline is tested against a plain version.
ORACLE_SQL = None

SHINGLE, MAX_BITS = 3, 3
#: Bytes of a repeat that is cut, below 50 words of running text (51 words have
#: 235 bytes or more in 99 % of the places of sf0.1, 314 in the middle).
MIN_REPEAT = 240
MAX_TOKENS = 4096


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more.

    Null and empty texts are scored like others; repeated rows and ids are
    scored one by one; null ids are scored but not learned from; columns of any
    name are kept; an empty table gives no rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(docs, quality.fit(docs, labels, ~held_out()))
    return scored.filter(F.col(scored.columns[-1]) >= 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest id.

    Texts without words (null, empty) are copies of each other; of rows with
    the same id (or none) the first stored one stays, if they are in one
    component; different texts under one id all stay; columns of any name are
    kept; an empty table gives no rows."""
    return simhash.drop_near_duplicates(docs, SHINGLE, MAX_BITS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of ``MIN_REPEAT`` bytes that start at two places
    or more.

    Documents without a word left (null and empty texts too) go; a repeated row
    is a repeat of its twin, so both lose their text; null ids are kept; columns
    of any name are kept, ``n_chars`` is counted anew; an empty table gives no rows."""
    out = suffixes.remove_repeats(docs, MIN_REPEAT)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix by source takes them.

    Texts without words are not taken; rows of equal ids, repeated rows and rows
    without an id are taken one by one; the null source is a source; columns of
    any name are kept; an empty table gives no rows."""
    return mixing.mix(docs, mixing.word_count(F.col("text")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 4,096 tokens.

    Null and empty texts are one end token; null ids are kept; repeated rows are
    packed as often as they come; other columns are ignored; an empty table
    gives no rows."""
    from public_tokenizers import path
    return packing.pack(docs, path("word_bpe_49k.json"), max_tokens=MAX_TOKENS)


STAGES = [("quality", keep_quality), ("near_copies", drop_near_copies), ("repeats", cut_repeats),
          ("mix", mix_sources), ("pack", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
