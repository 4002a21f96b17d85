"""k-means from several starts against plain numpy, and overlap resolution of long chains."""

import time

import numpy as np
from medialoom.operators import clusters
from medialoom.operators.tagging import resolve_overlaps
from pyspark.sql import functions as F


def items(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")


def plain(x, centres, rounds=clusters.ROUNDS):
    """Lloyd's algorithm for every start by itself."""
    out = []
    for c in centres:
        for _ in range(rounds):
            own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
            moved, c = np.abs(new - c).max(), new
            if moved == 0:
                break
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        out.append((d.min(1).sum(), d.argmin(1)))
    return out


def test_like_plain_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((6, 5))[rng.integers(6, size=400)] * 4 + rng.standard_normal((400, 5))
    df = items(spark, x)
    centres = clusters.first_centres(df, 6, list(range(42, 52)))
    assert all(len({tuple(c) for c in start}) == 6 for start in centres)
    want = min(plain(x, centres), key=lambda r: r[0])
    got = {r.id: r.cluster_id for r in clusters.kmeans_clusters(df, k=6).collect()}
    own = np.array([got[i] for i in range(400)])
    cost = sum(((x[own == j] - x[own == j].mean(0)) ** 2).sum() for j in set(own))
    assert cost <= want[0] * 1.001
    assert np.mean(own == want[1]) > 0.99


def test_scans_do_not_grow_with_the_starts(spark, monkeypatch):
    df, rounds = items(spark, np.random.default_rng(2).standard_normal((60, 3))), []
    real = clusters.one_round
    monkeypatch.setattr(clusters, "one_round", lambda rows, centres: rounds.append(centres.shape[0]) or real(rows, centres))
    for seeds in (1, 12):
        rounds.clear()
        clusters.kmeans_clusters(df, k=3, seeds=seeds, rounds=4)
        assert len(rounds) <= 5 and set(rounds) == {seeds}


def test_few_items(spark):
    assert clusters.kmeans_clusters(items(spark, np.zeros((0, 2)))).count() == 0
    assert [r.cluster_id for r in clusters.kmeans_clusters(items(spark, np.ones((1, 2)))).collect()] == [0]
    assert {r.cluster_id for r in clusters.kmeans_clusters(items(spark, np.ones((3, 2)))).collect()} == {0}


def test_a_hundred_thousand_chained_spans(spark):
    """Each overlaps the next two; with falling priority every third is kept from the end on."""
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("sid"), (n - F.col("id")).alias("seq"), (F.col("id") * 2).cast("int").alias("start_offset"), (F.col("id") * 2 + 5).cast("int").alias("end_offset"))
    begun = time.time()
    got = sorted(r.start_offset for r in resolve_overlaps(df, ["sid"], F.lit(1)).select("start_offset").collect())
    assert time.time() - begun < 30
    assert got == sorted(range(2 * (n - 1), -1, -6))
