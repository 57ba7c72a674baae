import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from shelfline.llm import chat, langid, linefreq, mixing, packing, quality, triecount

TOKENS = P.path("word_bpe_49k.json")
PIECES = P.path("piece_bpe_32k.model")


# --- packing -----------------------------------------------------------------

def test_packing_is_gapless_and_covers_every_id(docs, rows):
    got = packing.pack(docs, TOKENS, max_tokens=256, max_segments=8, pool=40).collect()
    tok = packing.WordTokenizer(TOKENS)
    want = Counter()
    for r in rows:
        ids = tok.ids(r[1] or "") + [2]
        want.update((r[0], len(ids), i, x) for i, x in enumerate(ids))
    have = Counter()
    sequences = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        have.update((r.doc_id, r.doc_tokens, r.start + k, x) for k, x in enumerate(ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert have == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256 and at & (at - 1) == 0 and len(parts) <= 8


def test_packer_keeps_the_loss_limit():
    p = packing.Packer(64, 6, 32, 0)
    out, loss = [], {}
    for i in range(50):
        loss[i] = i % 2 == 0
        out += p.add(i, 1 + i * 7 % 90, loss[i])
    out += p.drain()
    tokens, bearing, seen = Counter(), Counter(), Counter()
    for i, start, length, seq, _ in out:
        tokens[seq] += length
        bearing[seq] += length * loss[i]
        seen[i] += length
    assert max(tokens.values()) <= 64 and max(bearing.values()) <= 32
    assert max(Counter(o[3] for o in out).values()) <= 6 and seen == Counter({i: 1 + i * 7 % 90 for i in range(50)})


@pytest.mark.parametrize("text", ["It's <|EndOfText|> <|endoftext|>x a b \x1cx!\x1c!", "ÉCOLE İstanbul ΣΑΣ é ªº ßẞ",
                                  "don't. a.b, 12 ''", "😀 ok 가", "Le " * 50, ""])
def test_word_tokenizer_equals_the_tokenizer(text):
    tok = packing.WordTokenizer(TOKENS, cache_words=4)
    assert np.frombuffer(tok.encode(text), "<u4").tolist() == tok.ids(text)


# --- token counts ------------------------------------------------------------

def plain_tokens(model, text):
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        ways = []
        for start in range(max(0, end - model.longest), end):
            s = model.score.get(text[start:end])
            if s is not None:
                ways.append((best[start][0] + s, -best[start][1] - 1))
            elif start == end - 1:
                n = len(text[start].encode())
                ways.append((best[start][0] + n * model.byte_score, -best[start][1] - n))
        top = max(ways)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_trie_counts_against_plain_segmentation(docs, rows):
    model = triecount.pieces(PIECES)
    for nodes in (600_000, 50):
        got = Counter(tuple(r) for r in triecount.token_counts(docs, PIECES, max_nodes=nodes).collect())
        want = Counter()
        for r in rows:
            words = (r[1] or "").encode().split()
            want[(r[0], len(words), sum(plain_tokens(model, "▁" + w.decode()) for w in words))] += 1
        assert got == want


# --- mixing ------------------------------------------------------------------

def test_mix_meets_its_targets(docs, rows):
    plan = mixing.mix_plan(docs, mixing.word_count(F.col("text"))).collect()
    assert len(plan) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    names = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not full:
            break
        target.update({s: 3.0 * sizes[s] for s in full})
        free -= full
        left -= sum(3.0 * sizes[s] for s in full)
    target.update({s: weight[s] * level for s in free})
    taken = Counter()
    for r in plan:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    biggest = {s: max(r.size for r in plan if r.source == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= biggest[s] / 2 + 1 for s in names)
    again = mixing.mix_plan(docs.repartition(5), mixing.word_count(F.col("text"))).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in plan)


def test_pareto_order_takes_heavier_documents_more_often(spark):
    docs = spark.createDataFrame([(i, "s", 1 + i % 2) for i in range(4000)], "doc_id long, source string, w int")
    plan = mixing.mix_plan(docs, F.lit(10).cast("long"), weights=(1,), importance=F.col("w") / F.lit(3.0))
    got = dict(plan.groupBy((F.col("doc_id") % 2).alias("k")).agg(F.avg("copies")).collect())
    assert abs(got[1] / got[0] - 2) < 0.25 and abs(plan.agg(F.sum("taken")).first()[0] - 40000) <= 10


def test_capped_importance_keeps_the_sample(spark):
    docs = spark.createDataFrame([(100 * k + i, s, 1e6 if i == 0 else 1.0) for k, s in enumerate("ab") for i in range(100)],
                                 "doc_id long, source string, w double")
    plan = mixing.mix_plan(docs, F.lit(10).cast("long"), weights=(1, 3), importance=F.col("w"))
    copies = {r.doc_id: r.copies for r in plan.filter("source = 'b'").collect()}
    assert copies == {100: 3, **{i: 1 for i in range(101, 200)}}


def test_mixed_documents(docs):
    out = mixing.mix(docs, mixing.word_count(F.col("text")))
    assert out.columns == docs.columns and out.filter("text is null").count() == 0
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 9  # id 0 comes three times


def test_rows_without_an_id_meet_the_targets(spark):
    rows = [(None, f"w{i} x", "a") for i in range(3000)] + [(None, f"w{i} y z", "b") for i in range(2000)] + [(7, "same id", "a")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", F.lit(1).alias("row"), F.lit(2).alias("target"))
    out = mixing.mix(docs, mixing.word_count(F.col("text")))
    assert out.columns == docs.columns
    got = {r.source: r.n for r in out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    total = 3050 * 2 + 2000 * 3
    assert abs(got["a"] - total / 3) <= 3 and abs(got["b"] - total * 2 / 3) <= 3
    plan = mixing.mix_plan(docs.withColumn("doc_id", F.monotonically_increasing_id()), mixing.word_count(F.col("text")))
    assert {r.source: r.n for r in plan.groupBy("source").agg(F.sum("taken").alias("n")).collect()}.keys() == got.keys()


# --- quality -----------------------------------------------------------------

def test_forward_pass_by_loops():
    r = np.random.default_rng(8)
    model = quality.AttentionModel(seed=3)
    model.p = {k: r.normal(0, 0.5, v.shape) for k, v in model.p.items()}
    model.mean, model.scale, model.constant = r.normal(0, 1, quality.WIDTH), r.random(quality.WIDTH) + 0.5, None
    bags = [r.normal(0, 1, (n, quality.WIDTH)) for n in (1, 4, 2)]
    got = model.score(np.concatenate(bags), np.array([0, 1, 5]))
    p, sig = model.p, lambda v: 1 / (1 + math.exp(-v))
    for bag, score in zip(bags, got):
        hidden, weights = [], []
        for x in bag:
            x = [min(max((v - m) / s, -6), 6) for v, m, s in zip(x, model.mean, model.scale)]
            h = [math.tanh(sum(x[i] * p["W"][i, j] for i in range(len(x))) + p["b"][j]) for j in range(quality.HIDDEN)]
            gate = [math.tanh(sum(h[i] * p["V"][i, j] for i in range(len(h)))) * sig(sum(h[i] * p["U"][i, j] for i in range(len(h))))
                    for j in range(quality.HIDDEN)]
            hidden.append(h)
            weights.append(math.exp(sum(g * w for g, w in zip(gate, p["w"]))))
        z = [sum(w * h[j] for w, h in zip(weights, hidden)) / sum(weights) for j in range(quality.HIDDEN)]
        assert math.isclose(score, sig(sum(a * b for a, b in zip(z, p["c"])) + p["d"][0]), rel_tol=1e-9)


def test_fit_does_not_depend_on_which_text_comes_first(spark, words):
    rows = [(i % 40, " ".join(words[(7 * i + k) % 400] for k in range(30 + i)), i % 2) for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    a, b = (quality.fit(docs.repartition(n, F.md5("text")), labels, F.lit(True)) for n in (1, 5))
    assert all(np.array_equal(a.p[k], b.p[k]) for k in a.p)
    clash = quality.score(docs.withColumn("score", F.lit("own")).withColumn("score_", F.lit(1)), a)
    assert clash.columns == ["doc_id", "text", "score", "score_", "score__"] and clash.first().score == "own"
    assert len(quality.drawn_passages(np.arange(500)[:, None])) == quality.SAMPLE_PASSAGES


def test_quality_learns_and_scores_every_row(spark, docs, rows, words):
    r = np.random.default_rng(1)
    good = [(i, " ".join(r.choice(words, 200))) for i in range(1000, 1120)]
    junk = [(i, " ".join(f"{w}***" for w in r.choice(words, 150))) for i in range(2000, 2120)]
    train = spark.createDataFrame(good + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 2000)) for i, _ in good + junk] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = quality.fit(train, labels, F.col("doc_id") % 2 == 0)
    out = quality.score(train, model).collect()
    assert np.mean([(x.score >= 0.5) == (x.doc_id < 2000) for x in out if x.doc_id % 2]) > 0.97
    every = quality.score(docs, model)  # has a column score of its own
    every = every.select(F.col(every.columns[-1]).alias("score"))
    assert every.count() == len(rows) and every.filter("score is null or score < 0 or score > 1 or isnan(score)").count() == 0
    again = quality.fit(train.repartition(7), labels, F.col("doc_id") % 2 == 0)
    assert all(np.allclose(model.p[k], again.p[k]) for k in model.p)


def test_quality_gradients():
    r = np.random.default_rng(0)
    model = quality.AttentionModel()
    x, starts, y = r.normal(size=(9, quality.WIDTH)) / 5, np.array([0, 2, 6]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(np.log(np.where(y == 1, (o := model._forward(x, starts)[5]), 1 - o)))
    grads = model._gradients(x, starts, y)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep = model.p[k][at]
        model.p[k][at] = keep + 1e-5
        up = loss()
        model.p[k][at] = keep - 1e-5
        slope = (up - loss()) / 2e-5
        model.p[k][at] = keep
        assert math.isclose(slope, g[at], rel_tol=1e-3)


def test_quality_without_labels(spark, docs, no_docs):
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert {r[-1] for r in quality.score(docs, model).collect()} == {0.5}
    assert quality.score(no_docs, model).count() == 0


# --- languages ---------------------------------------------------------------

def test_languages(spark, rows):
    en, de = ["the", "and", "thing", "over", "with"], ["der", "und", "nicht", "über", "schön"]
    r = np.random.default_rng(3)
    data = [(i, " ".join(r.choice([en, de][i % 2], 30)), ["en", "de"][i % 2]) for i in range(80)]
    docs = spark.createDataFrame(data + [(r[0], r[1], None) for r in rows], "doc_id long, text string, lang string")
    filters = langid.learn(docs, F.col("doc_id") < 60)
    got = langid.predict(docs, filters).collect()
    assert len(got) == len(data) + len(rows)
    by_id = {x.doc_id: x for x in got if x.doc_id is not None and 60 <= x.doc_id < 80}
    assert all(by_id[i].lang_pred == data[i][2] for i in range(60, 80))
    assert {x.doc_id for x in got if x.lang_pred == "und"} >= {200, 201, 202, 204}
    assert all(0 <= x.score <= 1 for x in got)


def test_a_language_of_one_short_text_is_learned(spark):
    df = spark.createDataFrame([(0, "the cat and the dog and the cat", "en"), (1, "zwölf ju", "de")],
                               "doc_id long, text string, lang string")
    filters = langid.learn(df, F.lit(True))
    assert {r.doc_id: r.lang_pred for r in langid.predict(df, filters).collect()} == {0: "en", 1: "de"}


def test_filters_hold_every_gram_of_every_language():
    grams = {f"l{i:03d}": langid.gram_hashes(f"wort{i} nummer{i}" * 3) for i in range(70)}
    f = langid.MaskFilters(grams, slots=1 << 16)
    for i, lang in enumerate(f.langs):
        masks = np.bitwise_and.reduce([f.tables[i // 64][s] for s in langid._slots(grams[lang], 1 << 16)])
        assert ((masks >> np.uint64(i % 64)) & np.uint64(1)).all()
    assert langid.MaskFilters({}).predict("abc") == ("und", 0.0)


# --- line frequency ----------------------------------------------------------

def test_line_rules_against_brute_force(docs, rows):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.words_left, r.kept)
                  for r in linefreq.line_rules(docs, min_docs=1, max_share=0.1).collect())
    norm = lambda s: " ".join(w.decode() for w in s.encode().split()).lower()
    held, per_host = Counter(), Counter(r[3] for r in rows)
    for r in rows:
        held.update({(r[3], norm(s)) for s in (r[1] or "").split("\n") if s.encode().split()})
    want = Counter()
    for r in rows:
        text = r[1] or ""
        words = text.encode().split()
        grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        often = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
        lines = [s for s in text.split("\n") if s.encode().split()]
        gone = sum(len(s.encode().split()) for s in lines
                   if held[r[3], norm(s)] > 1 and held[r[3], norm(s)] > per_host[r[3]] * 0.1)
        n, left = len(words), len(words) - gone
        failed = n < 10 or 100 * len(covered) > 20 * n
        want[(r[0], n, sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text)),
              len(lines) - len(set(lines)), len(covered), failed, left, not failed and left >= 10 and left >= n * 0.5)] += 1
    assert got == want


# --- chat --------------------------------------------------------------------

RECORDS = [
    {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}]},
    {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "system": "s", "id": 3},
    {"instruction": "do", "input": "x", "output": "y"}, {"instruction": "do", "output": "y", "input": ""},
    {"prompt": "p", "response": "r"}, {"prompt": "p", "completion": "c", "meta": {"a": [1]}},
    {"question": "q", "answer": "a", "context": "c"}, {"unknown": 1}, [1, 2], None,
]


def test_layouts_become_turns(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(RECORDS)] + [(20, "not json"), (21, None)],
                               "conv_id long, record string")
    got = {}
    for r in chat.canonical_turns(df).orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append((r.layout, r.role, r.text))
    assert got[0] == [("messages", "user", "hi"), ("messages", "assistant", "")]
    assert got[1] == [("conversations", "system", "s"), ("conversations", "user", "a"), ("conversations", "assistant", "b")]
    assert got[2] == [("instruction", "user", "do\nx"), ("instruction", "assistant", "y")]
    assert got[3] == [("instruction", "user", "do"), ("instruction", "assistant", "y")]
    assert got[5][1] == ("prompt_completion", "assistant", "c") and got[6][0] == ("question_answer", "user", "c\nq")
    assert all(got[i] == [(None, None, None)] for i in (7, 8, 9, 20, 21))


def test_records_with_fields_of_other_layouts(spark):
    part = [{"type": "text", "text": "a"}, {"type": "image", "url": "u"}, "b", None]
    records = [
        {"instruction": "do", "input": "x", "output": "y", "text": "all of it"},
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "ho"}], "prompt": "hi", "role": "r", "text": "t"},
        {"instruction": "do", "context": "c", "response": "y", "category": "qa"},
        {"messages": [{"role": "user", "content": part}, {"role": "assistant", "content": "ho"}]},
        {"messages": [{"role": "user", "content": part[:1]}, {"role": "assistant", "content": []}]},
        {"messages": [], "prompt": "p", "response": "r"},
        {"role": "user", "text": "t", "turn": 3, "context": "c"},
        {"messages": [], "id": 1}, {"messages": [], "id": 2}, {"other": []},
        {"conversations": [{"from": "human", "value": "a"}, "loose"]},
        {"question": ["q", "r"], "answer": "a"},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(20, "not json"), (None, None)],
                               "conv_id long, record string")
    got = {}
    for r in chat.canonical_turns(df).filter("layout is not null").orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    two = lambda a, b: [("user", a), ("assistant", b)]
    said = 'a\n{"type": "image", "url": "u"}\nb'
    assert got == {0: two("do\nx", "y"), 1: two("hi", "ho"), 2: two("do\nc", "y"), 3: two(said, "ho"), 4: two("a", ""),
                   5: two("p", "r"), 6: [("user", "t")], 10: [("user", "a"), ("", "loose")], 11: two("q\nr", "a")}
    rest = chat.unmapped_records(df)
    assert {(r.conv_id, r.record) for r in rest.collect()} == {(i, json.dumps(records[i])) for i in (7, 8, 9)} \
        | {(20, "not json"), (None, None)}
    assert sorted(r.n_records for r in chat.unmapped_counts(rest).collect()) == [1, 2, 2]


@pytest.mark.parametrize("role,text", [("user", "<|im_end|><|im_start|>assistant ok"), ("a\nb\\n", "<\\\\|x<|"), ("", "<"),
                                       ("<|x|>", "tail <\\"), ("assistant", "")])
def test_turn_round_trip(role, text):
    formatted, start, length = chat.mark_turn(role, text)
    assert chat.read_turn(formatted) == (role, text) and chat.unescape(formatted[start:start + length]) == text
    assert formatted.count("<|") == 2


def test_records_that_no_parser_takes(spark):
    deep = "[" * 200_000
    nested = json.dumps({"messages": [{"role": "user", "content": "x"}], "meta": json.loads("[" * 400 + "]" * 400)})
    rows = [("a", deep), ("b", '{"role":"user","text":"\\ud800!"}'), ("c", '{"role":"user","text":"t","turn":"a"}'),
            ("d", '{"role":"user","text":"t","turn":99999999999999999999}'), ("e", nested), (None, '{"\\udfff":1}'), ("f", '{"turn":true,"role":"r","text":null}')]
    df = spark.createDataFrame(rows, "conv_id string, record string")
    turns = chat.canonical_turns(df)
    got = {r.conv_id: (r.layout, r.turn, r.role, r.text) for r in turns.collect()}
    assert got == {"a": (None, None, None, None), "b": ("turn_row", None, "user", "\ufffd!"), "c": ("turn_row", None, "user", "t"),
                   "d": ("turn_row", None, "user", "t"), "e": ("messages", None, "user", "x"), None: (None, None, None, None),
                   "f": ("turn_row", None, "r", "")}
    assert {r.conv_id for r in chat.unmapped_records(df).collect()} == {"a", None}
    digest = chat.conversation_digest(chat.formatted_turns(turns)).collect()
    assert {r.conv_id for r in digest} == {"b", "c", "d", "e", "f"}


def test_limits_that_bind(spark):
    r = random.Random(17)
    rows = [(i, " ".join(r.choice(["the", "of", "and"]) for _ in range(r.choice([1, 3, 40, 300]))), i % 3 == 0) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bears boolean").coalesce(2)
    pieces = packing.pack(df, TOKENS, loss_col="bears", max_tokens=256, max_segments=6, max_loss=64).collect()
    of, loss = {}, dict((i, b) for i, _, b in rows)
    for p in pieces:
        of.setdefault(p.sequence_id, []).append(p)
    tokens = {k: sum(p.length for p in v) for k, v in of.items()}
    bearing = {k: sum(p.length for p in v if loss[p.doc_id]) for k, v in of.items()}
    assert all(t <= 256 for t in tokens.values()) and max(len(v) for v in of.values()) == 6 and max(bearing.values()) == 64
    for i, text, _ in rows:
        own = sorted((p.start, p.length) for p in pieces if p.doc_id == i)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) == len(text.split()) + 1


def test_conversation_digest(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "a"), (1, None, "assistant", "last"), (2, 0, "user", None),
            (None, 0, "assistant", "z"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = df.select("conv_id", F.to_json(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")),
                                             {"ignoreNullFields": "false"}).alias("record"))
    got = {r.conv_id: r for r in chat.conversation_digest(chat.formatted_turns(chat.canonical_turns(records))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, None} and got[3].n_turns == 2
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb<|im_end|>\nassistant\nlast\n")
    assert got[1].loss_sha256 == sha("b<|im_end|>last") and got[1].loss_chars == 15 and got[2].loss_chars == 0


def test_empty(spark, no_docs):
    assert packing.pack(no_docs, TOKENS).count() == 0
    assert triecount.token_counts(no_docs, PIECES).count() == 0
    assert mixing.mix_plan(no_docs, mixing.word_count(F.col("text"))).count() == 0
    assert linefreq.line_rules(no_docs).count() == 0
    assert langid.predict(no_docs, langid.learn(no_docs, F.lit(True))).count() == 0
    none = spark.createDataFrame([], "conv_id long, record string")
    assert chat.conversation_digest(chat.formatted_turns(chat.canonical_turns(none))).count() == 0


def test_held_out_is_the_contracts_remainder(spark):
    from shelfline.llm.queries import held_out
    got = spark.range(-5, 200).withColumnRenamed("id", "doc_id").select("doc_id", held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_record_batches_are_cut_in_slices():
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"x": list(range(2500))})
    parts = list(chat._slices(iter([batch, batch.slice(0, 0)])))
    assert [p.num_rows for p in parts] == [1000, 1000, 500] and pa.Table.from_batches(parts).column(0).to_pylist() == list(range(2500))


def test_words_are_looked_up_once_for_all_texts():
    tok = packing.WordTokenizer(TOKENS)
    asked = []
    ask = tok._word
    tok._word = lambda word: asked.append(word) or ask(word)
    texts = ["One two  two", None, "", " \tTWO one\x0b", "né, <|endoftext|> İx two!", "\x1c\xa0"]
    ids = [tok.ids(t or "") for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in tok.encode_all(pa.array(texts[:4]))] == ids[:4]
    assert sorted(asked) == [b"", b"one", b"two"]
    assert [np.frombuffer(x, "<u4").tolist() for x in tok.encode_all(pa.array(texts).slice(1))] == ids[1:]
