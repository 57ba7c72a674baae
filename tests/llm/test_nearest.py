import numpy as np
from pyspark.sql import functions as F
from shelfline.llm import nndescent


def brute(rows, top):
    use = {}
    for i, v in rows:
        if i is not None and v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            use.setdefault(i, np.array(v, np.float32).astype(float))
    ids = np.array(sorted(use))
    x = np.stack([use[i] for i in ids])
    x /= np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for q in ids[ids % 5 == 0]:
        s = x @ use[q] / np.linalg.norm(use[q])
        s[ids == q] = -9
        order = np.lexsort((ids, -np.round(s, 9)))[:top]
        out[int(q)] = [(int(ids[o]), float(s[o])) for o in order]
    return out


def test_nearest_against_brute_force(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=16).tolist()) for i in range(900)]
    rows += [(2000 + i, rows[3][1]) for i in range(300)]                       # copies of one vector
    rows += [(3000, None), (3005, [0.0] * 16), (3010, [float("nan")] * 16), (3015, [None] + [1.0] * 15), (3020, [1.0, 2.0]),
             (None, [1.0] * 16), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("raw", F.lit(1))
    got = {}
    for x in nndescent.nearest(df, F.col("id") % 5 == 0, top=5, k=12, beam=48).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    want = brute(rows, 5)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    found = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want])
    assert found >= 0.9
    assert [i for i, _ in got[2000]] == [3, 2001, 2002, 2003, 2004]
    for q in got:
        scores = dict(want[q])
        assert all(abs(scores[i] - s) < 1e-9 for i, s in got[q] if i in scores)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.5, 0.5]), (7, [0.0, 2.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in nndescent.nearest(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50), (0, 2, 7), (50, 1, 0), (50, 2, 7)]
    assert nndescent.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_search_goes_on_until_the_beam_is_open(spark):
    unit = lambda a: np.array([np.cos(a), np.sin(a)], np.float16).tobytes()
    n, asked = 18, 100
    nodes = spark.createDataFrame([(i, bytearray(unit(0.06 * i))) for i in range(n)] + [(asked, bytearray(unit(0.06 * n)))],
                                  "id long, unit binary")
    graph = spark.createDataFrame([(i, i + 1, 0.99, True) for i in range(n - 1)] + [(asked, 0, 0.3, True)],
                                  "id long, nbr long, sim float, fresh boolean")
    queries = spark.createDataFrame([(asked,)], "q long")
    # one node a step: the nearest is 17 steps away
    assert n - 1 in {r.node for r in nndescent.greedy_search(graph, nodes, queries, beam=3, k=2).collect()}


def test_lists_and_beam_grow():
    sizes = [nndescent.sizes(n) for n in (1, 2_000, 50_000, 3_000_000)]
    assert sizes[0] == (nndescent.K, nndescent.BEAM) and sizes[1] < sizes[2] < sizes[3]
