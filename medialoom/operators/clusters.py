"""k-means of vectors from several starts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialoom.functions.ranking import top_n
from medialoom.session import materialize

# Rounds at most, how far centres may still move at the end, and the rows of a distance matrix.
ROUNDS, STILL, ROWS_AT_ONCE = 50, 1e-4, 4096


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances ``(starts, rows, clusters)`` to the centres ``(starts, clusters, width)``."""
    flat = centres.reshape(-1, centres.shape[-1])
    d = (x**2).sum(1)[:, None] + (flat**2).sum(1)[None] - 2 * x @ flat.T
    return np.maximum(d, 0).reshape(len(x), *centres.shape[:2]).transpose(1, 0, 2)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1)


def first_centres(items: DataFrame, k: int, seeds: list[int]) -> np.ndarray:
    """``k`` items a start, those of smallest hash with the start's seed: one pass, ``k`` rows a start are collected."""
    order = F.xxhash64(F.col("id").cast("string"), F.col("seed"))
    dealt = items.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))).withColumn("order", order)
    per = top_n(dealt, ["seed"], [F.col("order"), F.col("id")], k).select("seed", "rank", "vec")
    rows = sorted(per.collect(), key=lambda r: (r["seed"], r["rank"]))
    return np.array([r["vec"] for r in rows], np.float64).reshape(len(seeds), k, -1)


def one_round(items: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """New centres of all starts, their sizes, and each start's cost under the given centres: one pass over the items."""
    starts, k, width = centres.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((starts, k, width + 2))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                x = _matrix(batch.column("vec").slice(at, ROWS_AT_ONCE))
                for s, d in enumerate(distances(x, centres)):
                    own = d.argmin(1)
                    np.add.at(total[s], own, np.hstack([x, np.ones((len(x), 1)), d.min(1)[:, None]]))
        start, cluster, place = np.indices(total.shape).reshape(3, -1)
        yield pa.RecordBatch.from_pydict({"start": start, "cluster": cluster, "place": place, "part": total.ravel()})

    # as many rows a task as there are numbers in the centres; summed by Spark, so the driver gets that many in all
    parts = items.select("vec").mapInArrow(sums, "start bigint, cluster bigint, place bigint, part double")
    out = np.zeros((starts, k, width + 2))
    for r in parts.groupBy("start", "cluster", "place").agg(F.sum("part").alias("part")).collect():
        out[r["start"], r["cluster"], r["place"]] = r["part"]
    n = out[:, :, width]
    moved = np.where(n[:, :, None] > 0, out[:, :, :width] / np.maximum(n, 1)[:, :, None], centres)
    return moved, n, out[:, :, width + 1].sum(1)


def kmeans_clusters(items: DataFrame, k: int | None = None, seeds: int = 10, rounds: int = ROUNDS) -> DataFrame:
    """Cluster of each item, best of several starts; ``k`` follows the number of items unless given.

    All starts go through their rounds together, so items are read once a round however many starts there are. The start
    of least cost (ties: the smaller seed) gives the result; an item between centres goes to the first of them.
    """
    items = materialize(items.select("id", F.col("vec").cast("array<double>").alias("vec")), "items")
    n = items.count()
    if n <= 1:
        return items.select("id", F.lit(0).alias("cluster_id"))
    k = min(k or max(2, min(5, -(-n // 6))), n)
    centres = first_centres(items, k, list(range(42, 42 + seeds)))
    for _ in range(rounds):
        moved, _, _ = one_round(items, centres)
        still = np.abs(moved - centres).max() <= STILL
        centres = moved
        if still:
            break
    best = centres[one_round(items, centres)[2].argmin()][None]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = distances(_matrix(batch.column("vec")), best)[0].argmin(1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own.astype(np.int32))], ["id", "cluster_id"])

    return items.mapInArrow(assign, f"id {items.schema['id'].dataType.simpleString()}, cluster_id int")
