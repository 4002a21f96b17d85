"""Vector operators against comparing every pair."""

import numpy as np

from medialoom.llm.ads_search import nearest
from medialoom.llm.itq_neardup import embedding_components
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<double>, label int, id string"
NAN, INF = float("nan"), float("inf")


def odd_rows(start):
    odd = [None, [], [0.0] * 16, [1.0] * 15 + [None], [1.0] * 15 + [NAN], [1.0] * 15 + [INF], [1.0, 2.0]]
    return [(start + i, v, 1, "x") for i, v in enumerate(odd)]


def clusters(n=260, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, 16))
    rows = []
    for i in range(n):
        v = centres[rng.integers(40)] * rng.uniform(0.5, 2) + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.15, 0.3])
        rows.append((i, v.tolist(), None if i % 50 == 3 else int(rng.integers(3)), "x"))
    return rows + [(n, rows[0][1], rows[0][2], "copy"), (n + 1, [2 * x for x in rows[0][1]], rows[0][2], "longer")]


def test_links_like_all_pairs(spark):
    good = clusters()
    rows = good + odd_rows(900) + [(None, good[0][1], 1, "no id")]
    got = {r.vec_id: r for r in embedding_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    x = np.array([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    same = np.array([[a[2] is not None and a[2] == b[2] for b in good] for a in good])
    link = (x @ x.T >= 0.93) & same & ~np.eye(len(good), dtype=bool)
    found = np.array([got[r[0]].n_links for r in good])
    assert found.sum() >= 0.99 * link.sum() and (found <= link.sum(1)).all()
    reach = np.eye(len(good), dtype=bool) | link
    for _ in range(9):
        reach = reach @ reach
    want = [int(np.nonzero(r)[0][0]) for r in reach]
    assert np.mean([got[r[0]].component_id == w for r, w in zip(good, want)]) > 0.99
    assert all(got[r[0]].n_links == 0 and got[r[0]].component_id == r[0] and got[r[0]].kept for r in rows[len(good) : -1])
    assert got[None].n_links == 0 and got[None].component_id is None


def test_links_of_vectors_with_a_common_direction(spark):
    """The cosine is not centred: most of every vector's length may lie in one direction that all share."""
    rng = np.random.default_rng(31)
    for n, dims, common in ((1200, 64, 0.9), (1200, 64, 0.8), (900, 24, 0.6)):
        own = rng.standard_normal((n, dims)) + (1.5 if dims > 30 else 4) * rng.standard_normal((n // 20, dims))[np.arange(n) % (n // 20)]
        own[:, 0] = 0
        x = np.sqrt(1 - common) * own / np.linalg.norm(own, axis=1, keepdims=True)
        x[:, 0] = np.sqrt(common)
        rows = [(i, v.tolist(), i % 2, "x") for i, v in enumerate(x)]
        same = (np.arange(n) % 2)[:, None] == np.arange(n) % 2
        link = (x @ x.T >= 0.93) & same & ~np.eye(n, dtype=bool)
        got = {r.vec_id: r.n_links for r in embedding_components(spark.createDataFrame(rows, SCHEMA)).collect()}
        found = np.array([got[i] for i in range(n)])
        assert link.sum() > 2000 and (found <= link.sum(1)).all()
        assert found.sum() >= 0.97 * link.sum(), (dims, common, found.sum() / link.sum())


def test_links_of_an_empty_table(spark):
    assert embedding_components(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.kept for r in embedding_components(spark.createDataFrame(odd_rows(0)[:3], SCHEMA)).collect()] == [True] * 3


def exact(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = []
    for i in np.nonzero(ids % 20 == 0)[0]:
        score = np.einsum("ij,j->i", x, x[i])
        order = [j for j in np.lexsort((ids, -score.round(12))) if ids[j] != ids[i]][:k]
        out += [(ids[i], n + 1, ids[j], score[j]) for n, j in enumerate(order)]
    return out


def test_nearest_with_every_list_is_exact(spark):
    rows = clusters(700, 2)
    df = spark.createDataFrame(rows + odd_rows(2000), SCHEMA)
    got = nearest(df, F.col("vec_id") % 20 == 0, lists=4, probes=4).orderBy("query_id", "rank").collect()
    want = sorted(exact(rows, 20))
    assert len(got) == len(want)
    hits = {(r.query_id, r.vec_id) for r in got} & {(w[0], w[2]) for w in want}
    assert len(hits) >= 0.99 * len(want)
    assert np.allclose([r.score for r in got], [w[3] for w in want], atol=0.3)


def test_recall_with_production_parameters(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {(r.query_id, r.vec_id) for r in nearest(df, F.col("vec_id") % 20 == 0).collect()}
    want = {(w[0], w[2]) for w in exact(rows, 20)}
    assert len(got & want) >= 0.9 * len(want)


def test_recall_at_a_larger_size(spark):
    """20,000 rows in overlapping groups: the lists are many more than at the given size, and far more are left out."""
    rng = np.random.default_rng(21)
    centres = rng.standard_normal((60, 32))
    x = centres[rng.integers(60, size=20_000)] + 0.7 * rng.standard_normal((20_000, 32))
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(x)]
    got = nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 400 == 0).collect()
    assert len(got) == 50 * 20
    hits = 0
    for i in range(0, 20_000, 400):
        score = x @ x[i]
        score[i] = -np.inf
        hits += len({r.vec_id for r in got if r.query_id == i} & set(np.argsort(-score)[:20].tolist()))
    assert hits >= 0.9 * 1000


def test_nearest_of_repeated_ids(spark):
    """Rows of one id are one row: as a query they get k distinct rows, as candidates they are found once."""
    rng = np.random.default_rng(22)
    x = rng.standard_normal((60, 8))
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(x)]
    for repeats in (2, 41):
        more = [rows[20]] * (repeats - 1) + [rows[7]] * 3
        got = nearest(spark.createDataFrame(rows + more, SCHEMA), F.col("vec_id") % 20 == 0, k=20).collect()
        for i in (0, 20, 40):
            score = x @ x[i]
            score[i] = -np.inf
            mine = sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)
            assert [r.rank for r in mine] == list(range(1, 21))
            assert [r.vec_id for r in mine] == np.argsort(-score, kind="stable")[:20].tolist()
    unlike = [(5, [9.0] * 8, 1, "x"), (5, [-9.0] * 8, 1, "x")]
    got = nearest(spark.createDataFrame(rows[:5] + rows[6:] + unlike, SCHEMA), F.lit(True), k=100).collect()
    assert len({(r.query_id, r.vec_id) for r in got}) == len(got) == 60 * 59
    assert {r.score for r in got if r.query_id == 5 and r.vec_id == 8} == {float(np.einsum("i,i", [-9.0] * 8, x[8]))}


def test_shorter_vectors_end_in_zeros(spark):
    rows = [(0, [1.0, 2.0], 1, ""), (1, [3.0], 1, ""), (2, [0.0, 1.0, 7.0], 1, "")]
    got = nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 3.0), (0, 2, 2, 2.0)]


def test_nearest_of_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, ""), (1, [1.0, 1.0], 1, ""), (2, [1.0, 1.0], 1, "")], SCHEMA)
    got = [tuple(r) for r in nearest(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert nearest(few.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_of_small_tables_is_whole(spark):
    rng = np.random.default_rng(11)
    for n in (14, 16, 18, 21, 40):
        x = rng.standard_normal((n, 16))
        rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(x)]
        got = nearest(spark.createDataFrame(rows, SCHEMA), F.lit(True)).groupBy("query_id").count().collect()
        assert [r["count"] for r in got] == [min(20, n - 1)] * n
        if n <= 21:  # every other row is asked for, so the order is exact
            some = {r.query_id: r.vec_id for r in nearest(spark.createDataFrame(rows, SCHEMA), F.lit(True)).where("rank = 1").collect()}
            score = x @ x.T - 1e9 * np.eye(n)
            assert [some[i] for i in range(n)] == score.argmax(1).tolist()
