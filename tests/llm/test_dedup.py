import hashlib
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F
from shelfline.llm import common, simhash, suffixes
from shelfline.llm.common import components


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, bits):
    up = list(range(len(values)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= bits:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


def test_simhash_against_brute_force(docs, rows):
    for bucket_rows in (50_000, 2):
        got = Counter((r.doc_id, r.fingerprint, r.component_id)
                      for r in simhash.near_duplicates(docs, bucket_rows=bucket_rows).collect())
        fps = [brute_fingerprint(r[1]) for r in rows]
        tops = brute_components(fps, 3)
        least = {}
        for t, r in zip(tops, rows):
            if r[0] is not None:
                least[t] = min(least.get(t, r[0]), r[0])
        assert got == Counter((r[0], f"{f:016x}", least.get(t)) for r, f, t in zip(rows, fps, tops))


def test_ring_links_find_all_pairs():
    r = np.random.default_rng(1)
    seeds = r.integers(0, 1 << 63, 40).astype(np.uint64)
    near = [s ^ np.uint64(sum(1 << int(b) for b in r.choice(64, k, replace=False))) for s in seeds for k in (1, 2, 3, 4)]
    fps = np.unique(np.concatenate([seeds, np.array(near, np.uint64)]))
    want = {(i, j) for j in range(len(fps)) for i in range(j) if bin(int(fps[i]) ^ int(fps[j])).count("1") <= 3}
    got = set()
    for start in range(4):
        values = (fps >> np.uint64(48 - 16 * start)) & np.uint64(0xFFFF)
        for v in np.unique(values):
            at = np.flatnonzero(values == v)
            a, b = simhash.ring_links(fps[at], start, 3)
            got |= {tuple(sorted((int(at[x]), int(at[y])))) for x, y in zip(a, b)}
    assert got == want


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (7, 7)]
    got = {r.node: r.root for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}


def test_drop_near_duplicates(spark, docs, rows):
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    given = [i for i in ids if i is not None]
    assert 100 in given and not set(range(101, 105)) & set(given) and Counter(given)[0] == 1
    assert given.count(5) == 2 and ids.count(None) == 1  # two texts under one id; the null text without an id is a copy
    again = [("a b c d", 1), ("a b c d", 1), ("x y z w", 1), ("a b c d", None), ("x y z w", None), ("q r s t", None), ("q r s t", None)]
    left = simhash.drop_near_duplicates(spark.createDataFrame(again, "text string, doc_id long"))
    assert sorted(map(tuple, left.collect()), key=str) == [("a b c d", 1), ("q r s t", None), ("x y z w", 1)]


def brute_repeats(texts, size):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - size + 1):
            if seen[d[i:i + size]] > 1:
                gone[i:i + size] = b"\1" * size
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_against_brute_force(docs, rows):
    for size, group_rows in ((400, 20_000), (60, 20_000), (60, 3)):
        out = suffixes.repeat_digest(docs, size, group_rows=group_rows).collect()
        assert Counter(tuple(r[:5]) for r in out) == Counter((r[0], *b) for r, b in zip(rows, brute_repeats([r[1] for r in rows], size)))
        assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in out if "\ufffd" not in r.kept_text
                   and len(r.kept_text.encode()) == r.n_bytes - r.n_removed)


def test_a_window_with_many_places_is_dealt_out(spark, words):
    r = random.Random(21)
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    part = say(20)
    rows = [(i, f"{say(6)} {part} {say(6)}") for i in range(200)]
    out = suffixes.repeat_digest(spark.createDataFrame(rows, "doc_id long, text string"), 60, group_rows=3).collect()
    assert Counter(tuple(r[:5]) for r in out) == Counter((r[0], *b) for r, b in zip(rows, brute_repeats([r[1] for r in rows], 60)))


def test_repeated_keys_heavy_and_light(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 7 if i < 70 else 100 + i % 40 if i < 130 else i, i) for i in range(300)], "k long, v long")
    counts = rows.groupBy("k").count().withColumnRenamed("count", "n").filter("n > 1")
    for heavy in (10_000, 40, 1):  # all keys broadcast, some, none
        monkeypatch.setattr(common, "HEAVY", heavy)
        got = Counter(map(tuple, common.repeated(rows, counts, ["k"]).select("k", "v", "n").collect()))
        n = Counter(r.k for r in rows.collect())
        assert got == Counter((r.k, r.v, n[r.k]) for r in rows.collect() if n[r.k] > 1)


def test_key_filter_lets_all_keys_through(spark):
    keys = spark.range(500).selectExpr("unhex(md5(cast(id as string))) as k")
    rows = spark.range(20_000).selectExpr("id", "unhex(md5(cast(id as string))) as k")
    passed = {r.id for r in rows.filter(common.key_filter(keys, "k")(F.col("k"))).collect()}
    assert set(range(500)) <= passed and len(passed) < 600
    assert rows.filter(common.key_filter(keys.limit(0), "k")(F.col("k"))).count() == 0


def test_interval_scan_reports_all_occurrences():
    text = ["xxabcdefyy", "zzabcdefww", "qqabcdefyy"]
    found = []
    left = [t[:4][::-1].encode() for t in text]
    right = [t[4:].encode() for t in text]
    reach = suffixes.interval_scan(left, right, 6, lambda *g: found.append(g))
    assert reach == [(2, 6), (2, 4), (2, 6)]
    assert sorted((n, ext, sorted(m)) for n, ext, m in found) == [(6, 2, [0, 1, 2]), (8, 2, [0, 2])]


def test_repeat_groups_hold_every_place(spark, words):
    r = random.Random(9)
    say = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    part = say(90)
    docs = spark.createDataFrame([(i, f"{say(70)}{chr(65 + i)}{part}{chr(75 + i)}{say(50)}") for i in range(6)], "doc_id long, text string")
    groups = suffixes.repeat_groups(docs, 60).collect()
    whole = [g for g in groups if g.length == 90]
    assert {(g.doc_id, g.start) for g in whole} == {(i, 71) for i in range(6)} and len({g.group_id for g in whole}) == 1


def test_equal_texts_are_a_group(spark):
    r = random.Random(8)
    say = lambda n: "".join(r.choice("abcdefghé ") for _ in range(n))
    same = say(300)
    docs = spark.createDataFrame([(i, same) for i in range(4)] + [(9, say(300)), (10, "x" * 20), (11, "x" * 20)], "doc_id long, text string")
    groups = suffixes.repeat_groups(docs, 60).collect()
    assert sorted((g.doc_id, g.start, g.length) for g in groups) == [(i, 0, len(same.encode())) for i in range(4)]
    assert {g.group_id for g in groups} == {hashlib.md5(same.encode()).hexdigest()}


def test_remove_repeats_keeps_columns_and_clean_texts(docs, rows):
    out = suffixes.remove_repeats(docs, 400)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[1] == rows[1][1] and texts[203] == "one" and 100 not in texts and 200 not in texts


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert suffixes.repeat_digest(no_docs).count() == 0


def test_clean_texts_have_no_second_worker(spark):
    docs = spark.createDataFrame([(i, f"{i} " * 200 + ("again " * 90 if i < 3 else "")) for i in range(30)], "doc_id long, text string")
    out = suffixes.remove_repeats(docs, 400)
    plan = out._jdf.queryExecution().executedPlan().toString()
    clean = plan[plan.rindex("\n   +- "):]  # the second part of the union
    assert "MapInArrow" in clean and "ArrowEvalPython" not in clean


def test_lean_maps_yield_all_batches_and_free_memory(monkeypatch):
    freed = []
    monkeypatch.setattr(common, "release_memory", lambda: freed.append(1))
    assert list(common.lean(lambda it: (x + 1 for x in it))([1, 2])) == [2, 3] and freed == [1]
