import hashlib
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from shelfline.llm import packing, quality, simhash
from shelfline.llm.queries import held_out

from .test_dedup import brute_components, brute_fingerprint, brute_repeats


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{at}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i != 205 and i != 208)) for i in [*range(60), 205, 208, 206]], "doc_id long, quality int")
    labels.write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_against_plain_versions(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        before, after = docs.collect(), out.collect()
        if name != "pack":
            assert out.columns == given.columns
        ids = {r.doc_id for r in after}
        if name == "quality":
            model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
            score = lambda t: model.score(quality.passages(t).astype(np.float64), np.array([0]))[0]
            assert Counter(map(tuple, after)) == Counter(tuple(r) for r in before if score(r.text) >= 0.5)
            assert ids <= {r.doc_id for r in before} and 0 < len(after) <= len(before)
        if name == "near_copies":
            fps = [brute_fingerprint(r.text) for r in before]
            tops = brute_components(fps, 3)
            least = {}
            for t, r in zip(tops, before):
                if r.doc_id is not None:
                    least[t] = min(least.get(t, r.doc_id), r.doc_id)
            assert ids - {None} == set(least.values())
        if name == "repeats":
            cut = brute_repeats([r.text for r in before], corpus_pipeline.MIN_REPEAT)
            whole = {(r.doc_id, b[3]) for r, b in zip(before, cut)}
            assert all(r.n_chars == len(r.text) and r.text.encode().split() for r in after)
            exact = Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in after)
            # rows whose cuts fall between characters are compared by text, the others by id
            assert sum(k in whole for k in exact) > 0.9 * len(exact) and {i for i, _ in exact} <= {i for i, _ in whole}
        if name == "mix":
            copies, given_rows = Counter(map(tuple, after)), Counter(map(tuple, before))
            assert set(copies) <= set(given_rows) and all(r.text.encode().split() for r in after)
            assert all(n <= 3 * given_rows[r] for r, n in copies.items())
        if name == "pack":
            tok = packing.WordTokenizer(corpus_path())
            total = sum(len(tok.ids(r.text)) + 1 for r in before)
            assert sum(r.length for r in after) == total
            for r in after[:5]:
                assert len(np.frombuffer(r.ids, "<u4")) == r.length
        docs = out


def corpus_path():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def test_run_is_the_stages_in_order(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.agg(F.max("length")).first()[0] <= 4096 and out.count() > 0
    assert simhash.SEGMENTS > corpus_pipeline.MAX_BITS


def test_a_shared_passage_of_55_words_goes(spark, words):
    r = random.Random(31)
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    part = say(55)
    rows = [(i, f"{say(40)} {part if i % 2 else say(55)} {say(40)}", "s", 1, "x") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, spans string")
    out = corpus_pipeline.cut_repeats(spark, docs, "")
    assert out.columns == docs.columns
    left = {x.doc_id: x.text for x in out.collect()}
    assert all(part not in left[i] and left[i].startswith(rows[i][1][:150]) and left[i].endswith(rows[i][1][-150:]) for i in range(1, 20, 2))
    assert all(left[i] == rows[i][1] for i in range(0, 20, 2))
