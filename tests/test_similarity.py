"""Blocked similarity joins against numpy."""

import numpy as np
import pytest
from medialoom.operators.similarity import top_k_by_lists, top_k_similar
from pyspark.sql import functions as F


def frame(spark, x, name, key=str):
    return spark.createDataFrame([(key(i), v.tolist()) for i, v in enumerate(x)], f"{name} {'int' if key is int else 'string'}, vec array<double>")


def brute(q, t, k):
    """Ids as text, so the order of equal scores is that of the text."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    names = sorted(range(len(t)), key=str)
    score = np.round(unit(q) @ unit(t[names]).T, 6)
    return {(i, r + 1, str(names[j])) for i in range(len(q)) for r, j in enumerate(np.argsort(-score[i], kind="stable")[:k])}


@pytest.mark.parametrize("max_bytes", [1 << 24, 4000, 300])
def test_exact_with_ties_and_zero_rows(spark, max_bytes):
    rng = np.random.default_rng(3)
    t = rng.integers(-1, 2, size=(150, 3)).astype(float)  # few directions: ties everywhere
    q = np.vstack([rng.standard_normal((30, 3)), np.zeros((1, 3))])
    got = top_k_similar(frame(spark, q, "q", int), frame(spark, t, "t"), "q", "t", k=4, max_bytes=max_bytes)
    assert {(r.q, r.rank, r.hit_id) for r in got.collect()} == brute(q, t, 4)
    assert top_k_similar(frame(spark, q, "q", int), frame(spark, t, "t"), "q", "t", k=4, threshold=0.9, max_bytes=max_bytes).filter("score < 0.9").count() == 0


def test_few_or_no_rows(spark):
    q = frame(spark, np.eye(2), "q", int).unionByName(spark.createDataFrame([(9, None)], "q int, vec array<double>"))
    t = frame(spark, np.eye(2), "t")
    for search in (top_k_similar, top_k_by_lists):
        assert sorted((r.q, r.rank, r.hit_id, r.score) for r in search(q, t, "q", "t", k=5).collect()) == [(0, 1, "0", 1.0), (0, 2, "1", 0.0), (1, 1, "1", 1.0), (1, 2, "0", 0.0)]
        assert search(q, t.filter("false"), "q", "t").count() == 0
        assert search(q.filter("false"), t, "q", "t").count() == 0


def test_a_million_words(spark):
    """Vectors made in Spark, so that only the expected rows of 20 queries are computed here."""
    made = lambda n, seed: spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(2001)).cast("double") - 1000).alias("vec"))
    table, queries = made(1_000_000, 1), made(20, 2)
    got = {(r.id, r.rank, r.hit_id) for r in top_k_similar(queries, table, "id", "id", k=3).collect()}
    t, q = (np.array(df.orderBy("id").select("vec").toArrow()["vec"].to_numpy().tolist()) for df in (table, queries))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    score = np.round(unit(q) @ unit(t).T, 6)
    want = set()
    for i, s in enumerate(score):
        some = np.nonzero(s >= np.partition(s, -3)[-3])[0]
        want |= {(i, r + 1, str(j)) for r, (_, j) in enumerate(sorted((-s[j], str(j)) for j in some)[:3])}
    assert got == want


@pytest.mark.parametrize("spread", [0.3, 1.0, 30.0])
def test_lists_find_nine_of_ten(spark, spread):
    """From tight groups to no groups at all."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((50, 16))
    t = centres[rng.integers(50, size=20_000)] + spread * rng.standard_normal((20_000, 16))
    q = centres[rng.integers(50, size=100)] + spread * rng.standard_normal((100, 16))
    got = {(r.q, r.hit_id) for r in top_k_by_lists(frame(spark, q, "q", int), frame(spark, t, "t"), "q", "t", k=10, max_bytes=1 << 18).collect()}
    want = {(i, j) for i, _, j in brute(q, t, 10)}
    assert len(got) == len(want)
    assert len(got & want) >= 0.9 * len(want)


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", F.col("embedding").alias("vec"))
    exact = {(r.vec_id, r.hit_id) for r in top_k_similar(rows, rows, "vec_id", "vec_id", k=10).collect()}
    near = {(r.vec_id, r.hit_id) for r in top_k_by_lists(rows, rows, "vec_id", "vec_id", k=10).collect()}
    assert len(near & exact) >= 0.9 * len(exact)
