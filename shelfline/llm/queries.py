"""Registered queries of the operators and their DuckDB SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"

MIX_SQL = f"""
WITH each AS (
  SELECT doc_id, source, {WORDS}::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM each GROUP BY source),
weighed AS (
  SELECT source, source_size, source_size * 3.0::DOUBLE AS lim,
         (1 + (row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3)::DOUBLE AS weight
  FROM named),
levels AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(lim) OVER (
               ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, least(lim, weight * max(level) OVER ()) AS target FROM levels),
parts AS (
  SELECT e.doc_id, e.source, e.size, t.source_size, t.target, e.u,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0 END AS expected
  FROM each e JOIN targets t ON e.source IS NOT DISTINCT FROM t.source),
ranked AS (
  SELECT *, floor(expected) AS whole, expected - floor(expected) AS p,
         CASE WHEN expected > floor(expected)
              THEN (u / (1 - u)) / ((expected - floor(expected)) / (1 - (expected - floor(expected)))) END AS rk
  FROM parts),
filled AS (
  SELECT *, target - sum(size * whole) OVER (PARTITION BY source) AS need,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY rk, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM ranked)
SELECT doc_id, source, size, source_size, target,
       (whole + CASE WHEN rk IS NOT NULL AND ahead * 2 + size <= need * 2 THEN 1 ELSE 0 END)::BIGINT AS copies,
       ((whole + CASE WHEN rk IS NOT NULL AND ahead * 2 + size <= need * 2 THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM filled"""


@query("op1_pareto_mix", MIX_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents: weights 1, 2, 3 by source, sizes in words."""
    from .mixing import mix_plan, word_count
    return mix_plan(table(spark, sf_dir, "documents"), word_count(F.col("text")))


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints (3-word shingles) and components of links of 3 bits or fewer."""
    from .simhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


@query("op8_suffix_repeats")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without its 400-byte repeats; the kept text last."""
    from .suffixes import repeat_digest
    return repeat_digest(table(spark, sf_dir, "documents"), min_len=400)


@query("op10_vector_pack")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing of all documents into sequences of at most 4,096 tokens."""
    from public_tokenizers import path

    from .packing import pack
    pieces = pack(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"), max_tokens=4096, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def held_out(id_col: str = "doc_id"):
    """The contracts' test rows: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query("op5_attention_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels of two thirds of the ids."""
    from . import quality
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return quality.score(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                             (F.col("score") >= 0.5).cast("int").alias("predicted"))


LINES_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rid, doc_id, host, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
grams AS (
  SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
covered AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest(range(i, i + 5)) AS p
        FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1)
  GROUP BY rid),
raw AS (
  SELECT rid, host, line, lower(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS norm
  FROM (SELECT rid, host, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM raw GROUP BY rid),
hosts AS (
  SELECT host, count(*) AS n_docs FROM d GROUP BY host),
often AS (
  SELECT r.host, r.norm
  FROM (SELECT host, norm, count(DISTINCT rid) AS n FROM raw GROUP BY host, norm) r
  JOIN hosts h ON r.host IS NOT DISTINCT FROM h.host
  WHERE r.n > 10 AND (r.n > 20 OR r.n > h.n_docs * 0.05::DOUBLE)),
gone AS (
  SELECT r.rid, sum(len(string_split(r.norm, ' '))) AS n_gone
  FROM raw r JOIN often o ON r.host IS NOT DISTINCT FROM o.host AND r.norm = o.norm GROUP BY r.rid),
counts AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         (len(words) - coalesce(n_gone, 0))::BIGINT AS words_left
  FROM w LEFT JOIN covered USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND words_left >= 10 AND words_left >= n_words * 0.5::DOUBLE AS kept
FROM counts"""


@query("op6_line_frequency", LINES_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the boilerplate rule by source over all documents."""
    from .linefreq import line_rules
    return line_rules(table(spark, sf_dir, "documents"))


@query("op7_chat_format")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1 through fingerprint, template and back."""
    from . import chat
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema))
    records = rows.select("conv_id", F.to_json(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")),
                                               {"ignoreNullFields": "false"}).alias("record"))
    return chat.conversation_digest(chat.formatted_turns(chat.canonical_turns(records)))


def _layouts(turns: DataFrame) -> DataFrame:
    """``(conv_id, layout, record)``: every conversation in ten layouts of JSON; those that
    hold one exchange have it for each user turn that an assistant turn follows."""
    turns = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    record = lambda layout, **f: (F.lit(layout).alias("layout"), F.to_json(F.struct(*[c.alias(k) for k, c in f.items()])).alias("record"))
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    whole = turns.groupBy("conv_id").agg(said.alias("t"))
    each = lambda role, text: F.transform("t", lambda x: F.struct(x["role"].alias(role), x["text"].alias(text)))
    lists = [whole.select("conv_id", *record(name, **{array: each(role, text)})) for name, array, role, text in (
        ("messages", "messages", "role", "content"), ("conversations", "conversations", "from", "value"),
        ("conversations_content", "conversations", "role", "content"), ("messages_value", "messages", "from", "value"))]
    pairs = whole.select("conv_id", F.explode(F.filter(F.transform("t", lambda x, i: F.struct(
        x["role"].alias("r"), x["text"].alias("q"), F.get("t", i + 1)["role"].alias("r2"), F.get("t", i + 1)["text"].alias("a"))),
        lambda x: (x["r"] == "user") & (x["r2"] == "assistant"))).alias("x"))
    q, a = F.col("x.q"), F.col("x.a")
    ones = [pairs.select("conv_id", *record(name, **{ask: q, reply: a})) for name, ask, reply in (
        ("instruction", "instruction", "output"), ("instruction_response", "instruction", "response"), ("prompt_response", "prompt", "response"),
        ("prompt_completion", "prompt", "completion"), ("question_answer", "question", "answer"))]
    rows = turns.select("conv_id", *record("turn_row", role=F.col("role"), text=F.col("text"), turn=F.col("turn")))
    return functools.reduce(DataFrame.unionByName, [*lists, *ones, rows])


LAYOUTS_SQL = """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text,
             lead(role) OVER w AS role2, lead(coalesce(text, '')) OVER w AS text2
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, coalesce(text, ''))),
layouts AS (SELECT unnest(['messages', 'conversations', 'conversations_content', 'messages_value', 'turn_row']) AS layout),
pairs AS (SELECT unnest(['instruction', 'instruction_response', 'prompt_response', 'prompt_completion', 'question_answer']) AS layout),
said AS (SELECT conv_id, layout, role, text FROM t, layouts
         UNION ALL SELECT conv_id, layout, role, text FROM t, pairs WHERE role = 'user' AND role2 = 'assistant'
         UNION ALL SELECT conv_id, layout, role2, text2 FROM t, pairs WHERE role = 'user' AND role2 = 'assistant')
SELECT conv_id, layout, count(*)::BIGINT AS n_turns, count(*) FILTER (WHERE role = 'assistant')::BIGINT AS n_loss,
       sum(length(text))::BIGINT AS n_chars, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars
FROM said GROUP BY conv_id, layout"""


@query("chat_layouts", LAYOUTS_SQL)
def chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in ten layouts: the mapping that the fingerprint selects
    for each record, its turns, formatted and read back."""
    from . import chat
    records = _layouts(table(spark, sf_dir, "conversations")).select("conv_id", "record")
    turns = chat.canonical_turns(records)
    bears = F.col("role") == "assistant"
    return turns.groupBy("conv_id", "layout").agg(
        F.count(F.lit(1)).alias("n_turns"), F.count_if(bears).alias("n_loss"), F.sum(F.length("text")).alias("n_chars"),
        F.coalesce(F.sum(F.when(bears, F.length("text"))), F.lit(0)).alias("loss_chars"))


@query("chat_packed")
def chat_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted turns of all conversations packed under three limits: 2,048
    tokens, 12 segments and 512 loss-bearing tokens (assistant turns) a sequence."""
    from public_tokenizers import path

    from . import chat
    from .packing import pack
    rows = table(spark, sf_dir, "conversations")
    records = rows.select("conv_id", F.to_json(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")),
                                               {"ignoreNullFields": "false"}).alias("record"))
    turns = chat.formatted_turns(chat.canonical_turns(records)).withColumn("bears", F.col("loss_start").isNotNull()) \
        .withColumn("turn_id", F.struct("conv_id", "turn", "place", "bears"))
    pieces = pack(turns, path("word_bpe_49k.json"), id_col="turn_id", text_col="formatted", loss_col="bears",
                  max_tokens=2048, max_segments=12, max_loss=512)
    return pieces.select("doc_id.*", "start", "length", "doc_tokens", "sequence_id", "offset")


@query("op9_trie_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and unigram tokens of every document."""
    from public_tokenizers import path

    from .triecount import token_counts
    return token_counts(table(spark, sf_dir, "documents"), path("piece_bpe_32k.model"))


@query("op4_language_masks")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of the ids."""
    from . import langid
    docs = table(spark, sf_dir, "documents")
    filters = langid.learn(docs, ~held_out())
    return langid.predict(docs, filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op2_nn_descent")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest embeddings of every embedding whose id is divisible by 50."""
    from .nndescent import nearest
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, top=5)


@query("op11_vector_codes", sql.codes_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings: 4 parts, 256 entries, 4 exact rounds."""
    from .vectorcodes import vector_codes
    coded = vector_codes(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


@query("op12_spelling_variants", sql.spelling_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of the words of all documents."""
    from .spelling import spelling_variants, words
    return spelling_variants(words(table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_jaccard_join", sql.jaccard_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    from .setjoin import jaccard_components
    return jaccard_components(table(spark, sf_dir, "documents"), shingle=4, percent=85)
