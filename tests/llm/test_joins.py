import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F
from shelfline.llm import setjoin, spelling, vectorcodes
from shelfline.llm.common import arrow_groups, by_bytes

# --- vector codes ------------------------------------------------------------


def brute_codes(points, parts, entries, rounds):
    """Codes, squared errors and codebooks; ``points`` in the order of their ids."""
    points = np.array(points, np.int64)
    width = points.shape[1] // parts
    codes, error, books = [], 0, []
    for p in range(parts):
        x = points[:, p * width:(p + 1) * width]
        book = x[:entries].copy()
        for step in range(rounds + 1):
            d = ((x[:, None, :] - book[None]) ** 2).sum(2)
            near = d.argmin(1)
            if step < rounds:
                for e in range(len(book)):
                    if (near == e).any():
                        book[e] = x[near == e].sum(0) // (near == e).sum()
        codes.append(near)
        error = error + d[np.arange(len(x)), near]
        books.append(book)
    return np.stack(codes, 1), error, hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()


def test_vector_codes_against_brute_force(spark):
    r = np.random.default_rng(3)
    centers = r.integers(-3, 3, (30, 8))
    points = [tuple((centers[i % 30] + r.integers(-1, 2, 8)).tolist()) for i in range(400)] + [tuple(range(8))] * 5
    for entries, group, rounds in ((40, 8, 4), (16, 3, 2)):
        rows = [(i, [v / 4 + 0.1 for v in p], [None, 1, 2][i % 3], "x") for i, p in enumerate(points)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, v string").repartition(3)
        out = vectorcodes.vector_codes(df, parts=4, entries=entries, rounds=rounds, scale=4, group=group).collect()
        codes, error, digest = brute_codes([[int(np.floor(4 * (v / 4 + 0.1))) for v in p] for p in points], 4, entries, rounds)
        assert {(x.vec_id, tuple(x.code), x.error) for x in out} == {(i, tuple(codes[i]), int(error[i])) for i in range(len(points))}
        total = Counter()
        for i, e in enumerate(error):
            total[[None, 1, 2][i % 3]] += int(e)
        assert all(x.label_error == total[x.label] and x.codebooks_sha256 == digest for x in out)


def test_bounds_spare_scans_and_change_nothing():
    r = np.random.default_rng(4)
    x = np.concatenate([c + r.integers(-4, 5, (200, 4)) for c in r.integers(-900, 900, (12, 4))]).astype(np.int64)
    books = vectorcodes.Codebooks(np.stack([x[:48, :2], x[:48, 2:]]), group=6)
    state, scans = books.assign(x, None)
    full = scans
    for _ in range(6):
        sums = np.zeros((2, 48, 2), np.int64)
        counts = np.zeros((2, 48), np.int64)
        for p in range(2):
            np.add.at(sums[p], state["entry"][:, p], x[:, 2 * p:2 * p + 2])
            np.add.at(counts[p], state["entry"][:, p], 1)
        books.renew(sums, counts)
        state, scans = books.assign(x, state)
        for p in range(2):
            d = vectorcodes.squared(x[:, 2 * p:2 * p + 2], books.history[-1][p])
            assert (d.argmin(1) == state["entry"][:, p]).all()
    assert scans < full / 3
    large = (x * (1 << 15)) % (1 << 25)
    assert (vectorcodes.squared(large, large[:9]) == ((large[:, None] - large[None, :9]) ** 2).sum(2)).all()


def test_vectors_that_take_no_part(spark):
    rows = [(1, [0.5, 0.25], 1), (2, None, 1), (3, [None, 1.0], 1), (4, [float("nan"), 0.0], 1), (5, [float("inf"), 0.0], None),
            (6, [1e300, 0.0], 1), (None, [0.5, 0.25], None), (7, [1.0, 2.0, 3.0, 4.0], 1), (8, [], 1), (1, [0.5, 0.25], 1), (9, [-0.5, 3.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = vectorcodes.vector_codes(df, parts=2).collect()
    assert Counter(x.vec_id for x in out) == Counter([1, 1, 9, None]) and all(x.error == 0 for x in out)
    assert vectorcodes.vector_codes(df.limit(0)).collect() == [] and vectorcodes.vector_codes(df, parts=3).collect() == []


# --- spelling variants -------------------------------------------------------

def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(n, factor):
    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in close.items() if vs}
    form = {w: f for w, f in form.items() if n[f] >= factor * n[w]}

    def root(w):
        return root(form[w]) if w in form else w
    return {(w, n[w], len(close[w]), form.get(w), n[form[w]] if w in form else None, root(w)) for w in n}


def test_spelling_variants_against_brute_force(spark):
    r = random.Random(6)
    base = ["".join(r.choice("abcdeéÿ") for _ in range(r.randint(6, 9))) for _ in range(60)]
    n = {}
    for w in base:
        n[w] = r.choice([5, 20, 100, 3000])
        for _ in range(6):
            i = r.randrange(len(w))
            n.setdefault(r.choice([w[:i] + r.choice("abcé") + w[i + 1:], w[:i] + w[i + 1:], w[:i] + "d" + w[i:]]), r.choice([1, 4, 5, 30]))
    n["a" * 3000], n["a" * 2999 + "b"], n["a" * 2999] = 50, 5, 9  # very long words
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    want = brute_variants(n, 5)
    for leaf in (8192, 20):
        assert {tuple(x) for x in spelling.spelling_variants(df, leaf=leaf).select("word", "n", "n_near", "form", "form_n", "root").collect()} == want
    assert spelling.spelling_variants(df.limit(0)).collect() == []


def test_words_of_documents(spark):
    rows = [(i, f"Strasse straße STRASSE {'ÀÀÀÀÀÀ' * (i % 2)} x1y2 abcdef-abcdef {'z' * 5000}", "clash") for i in range(60)] \
        + [(None, "abcdef", "c"), (7, None, "c"), (8, "", "c"), (8, "", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    want = Counter()
    for i, text, _ in rows:
        for run in __import__("re").findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            want[w[:h % len(w)] + w[h % len(w) + 1:] if h % 7 == 0 else w] += 1
    want = {w: c for w, c in want.items() if len(w) >= 6 and c >= 5}
    assert dict(spelling.words(df, drop_one_in=7).collect()) == want and any(len(w) == 4999 for w in want)


def test_trees_find_what_is_in_reach():
    r = np.random.default_rng(5)
    points = r.integers(0, 4, (500, spelling.DIMS))
    points[:100] = points[0]
    q = points + (r.random(points.shape) < 0.03)
    for tight in (True, False):
        tree = spelling.Tree(points, 20, tight)
        found = {(int(a), int(b)) for node, who in tree.search(q, 2) for a in who for b in tree.members[node]}
        apart = np.abs(q[:, None] - points[None]).sum(2)
        assert {tuple(map(int, x)) for x in np.argwhere(apart <= 2)} <= found
        assert sorted(int(i) for n in tree.leaves for i in tree.members[n]) == list(range(500))


# --- Jaccard join ------------------------------------------------------------

def brute_sets(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def brute_links(rows, k, percent):
    sets = brute_sets([r[1] for r in rows], k)
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(r[0], least.get(top(i), r[0]))
    return Counter((r[0], len(s), least.get(top(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets)))


def family(r, n, words, base, id0):
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(r.randint(0, 3)):
            own[r.randrange(len(own))] = r.choice(words)
        out.append((id0 + i, " ".join(own)))
    return out


def test_jaccard_components_against_brute_force(spark, docs, rows, words):
    r = random.Random(12)
    own = [(x[0], x[1]) for x in rows]
    for k in range(3):
        own += family(r, 40, words, [r.choice(words) for _ in range(60)], 1000 * (k + 1))
    own += [(5000 + i, f"short {i % 3}") for i in range(9)] + [(5100, "A b C d"), (5101, "a B c D"), (5102, "a b c d a b c d")]
    df = spark.createDataFrame(own, "doc_id long, text string").repartition(3) \
        .select("*", *[F.lit(c).alias(c) for c in ("token", "cls", "n", "point", "tkey", "rare")])
    want = brute_links(own, 4, 85)
    got = Counter(tuple(x) for x in setjoin.jaccard_components(df, part_points=15, part_tokens=1000).collect())
    assert got == want
    assert setjoin.jaccard_components(df.limit(0)).collect() == []


def test_bounds_lose_no_link():
    r = random.Random(13)
    sets = []
    for _ in range(150):
        s = set(r.sample(range(10**6), r.randint(5, 400)))
        for _ in range(4):
            own = set(s)
            for _ in range(r.randint(0, max(1, len(s) // 8))):
                own.discard(next(iter(own))) if len(own) > 2 else None
                own.add(r.randrange(10**6))
            sets.append(np.unique(np.array([xxhash.xxh64_intdigest(str(x)) for x in own], np.uint64)))
    points = np.stack([setjoin.point(s) for s in sets])
    tree = setjoin.CountTree(points, 85)
    linked = 0
    for i, a in enumerate(sets):
        near = set(tree.search(points[i], len(a)).tolist())
        for j, b in enumerate(sets):
            same = len(np.intersect1d(a, b))
            if 100 * same >= 85 * (len(a) + len(b) - same):
                linked += i != j
                assert j in near
    assert linked > 100
    wide = np.array([[300] + [0] * 63, [1] * 64])
    assert (setjoin.fold(setjoin.unpack_points([setjoin.pack_point(p) for p in wide]), 64) == wide).all()
    # sets of different numbers of groups find each other
    big = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 1100).astype(np.uint64))
    pair = [big[:1000], big[:1030], np.unique(np.random.default_rng(3).integers(0, 1 << 63, 1000).astype(np.uint64))]
    widths = [setjoin.group_count(len(x)) for x in pair]
    assert widths[0] < widths[1] and setjoin.possible([setjoin.point(x, g) for x, g in zip(pair, widths)], [0, 1, 2], 85).tolist() == [True, True, False]


def test_each_pair_has_one_tree():
    r = random.Random(3)
    sets = [np.sort(np.array(r.sample(range(1 << 40), 200), np.uint64)) for _ in range(2)]
    sets = [sets[0], sets[0][:195], sets[1], sets[1][:195], sets[1][:190]]
    points, comps = [setjoin.point(s) for s in sets], [0, 1, 2, 3, 4]
    none = [np.empty(0, np.int64)] * 5
    assert setjoin.possible(points, comps, 85, None, none).tolist() == [True] * 5
    # 7 is an earlier tree of the first two, and of one of the others only
    before = [np.array(x, np.int64) for x in ([7], [5, 7], [7], [], [8])]
    assert setjoin.possible(points, comps, 85, None, before).tolist() == [False, False, True, True, True]
    # 0 is a number like others, not the padding
    before = [np.array(x, np.int64) for x in ([0], [5, 6], [0], [0], [])]
    assert setjoin.possible(points, comps, 85, None, before).tolist() == [True, True, True, True, True]


def test_trees_in_order(spark):
    rows = [(t, bytes([c]), n) for t, n, cs in ((10, 2, (1, 2)), (20, 3, (1, 2, 3)), (-5, 2, (1, 3))) for c in cs]
    df = spark.createDataFrame(rows, "token long, cls binary, n long")
    got = {(x.token, x.cls[0]): (x["at"], list(x.before)) for x in setjoin.in_order(df).collect()}
    assert got == {(20, 1): (0, []), (-5, 1): (1, [20]), (10, 1): (2, [20, -5]), (20, 2): (0, []), (10, 2): (1, [20]),
                   (20, 3): (0, []), (-5, 3): (1, [20])}


def test_whole_sets_of_asked_texts(spark):
    words = [f"a b c d {i}" for i in range(300)]
    docs = spark.createDataFrame([(w,) for w in words * 2] + [("",)], "text string").coalesce(1) \
        .withColumn("tkey", F.unhex(F.md5("text")))
    asked = docs.limit(100).select("tkey")
    got = setjoin.whole_sets(docs, asked, 4).collect()
    names = {bytes(x.tkey) for x in got}
    assert len(got) == len(names) and names >= {bytes(x.tkey) for x in asked.collect()} and len(names) < 110
    assert all(x.n == 2 and len(x.tokens) == 16 for x in got)


def test_arrow_helpers():
    import pyarrow as pa
    batches = [pa.record_batch({"k": ["a", "a", "b"], "v": [1, 2, 3]}), pa.record_batch({"k": ["b"], "v": [4]}),
               pa.record_batch({"k": pa.array([], pa.string()), "v": pa.array([], pa.int64())}), pa.record_batch({"k": ["c"], "v": [5]})]
    assert [(t["k"][0].as_py(), t["v"].to_pylist()) for t in arrow_groups(batches)] == [("a", [1, 2]), ("b", [3, 4]), ("c", [5])]
    texts = pa.record_batch({"t": ["x" * 10, None, "y" * 25, "", "z"]})
    assert [b["t"].to_pylist() for b in by_bytes([texts], 0, 20)] == [["x" * 10, None], ["y" * 25, "", "z"]]
