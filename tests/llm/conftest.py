import random

import pytest
from pyspark.sql import functions as F

CLASHES = ["gram", "tkey", "size", "target", "words", "bucket", "score", "u", "id", "node", "n", "host", "_id", "rank"]


@pytest.fixture(scope="session")
def words():
    r = random.Random(3)
    return ["".join(r.choice(["an", "er", "th", "on", "é", "st", "ö"]) for _ in range(r.randint(1, 4))) for _ in range(400)]


@pytest.fixture(scope="session")
def rows(words):
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, ties,
    repeated rows, copies, near copies and shared passages."""
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = say(120)
    out = []
    for i in range(60):
        text = f"Line of {i}.\n{say(r.randint(5, 80))}\n{say(20)}"
        if i % 7 == 0:
            text = f"{say(15)} {passage} {say(15)}"
        if i % 11 == 0:
            text = f"Shared line everywhere\n{text}"
        out.append((i, text, ["en", "fr", None][i % 3], [f"s{i % 4}", None][i % 9 == 0]))
    base = out[3][1] + " " + say(300)
    out += [(100 + i, base, "en", "s1") for i in range(5)]                      # copies
    out += [(110 + i, base.replace(words[7], words[8 + i]), "en", "s2") for i in range(4)]  # near copies
    out += [(200, None, "en", "s0"), (201, "", None, "s0"), (202, " \n\t ", "fr", None), (203, "one", "fr", "s3"),
            (204, "!!! 123", "en", "s3"), (205, "Le " * 300, "fr", "s3"), (206, "x" * 3000, "fr", "s3"),
            (207, say(4000), "en", "s3"), (None, say(50), "en", "s0"), (None, None, None, None),
            (208, "a b c d e " * 100, "en", "s1")]
    out += [out[0], out[0], (5, say(40), "en", "s1")]                            # repeated rows, a repeated id
    return [(*x, len(x[1]) if x[1] is not None else None) for x in out]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *[F.lit(c).alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
