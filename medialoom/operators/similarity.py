"""Nearest vectors by cosine as a blocked matrix join: exact, and approximate over lists fitted on a bounded sample.

Both cut the table into blocks of bounded size and send rows and queries of a block to one task by a single shuffle,
sorted so that the block's table rows come first. The task keeps them as one matrix and lets the queries stream by, one
matrix product a slice. The best rows of every block are merged by a rank filter, which Spark prunes in each partition
before the shuffle. Neither table nor queries pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialoom.functions.ranking import top_n
from medialoom.session import materialize

# The size of a block of table rows, of the scores held at once, of the vectors sent to lists or their cosines
# with the centres, and the decimals of a score. A task holds
# one block and one matrix of scores, besides an Arrow batch.
BLOCK_BYTES, SCORE_BYTES, PIECE_BYTES, DECIMALS = 16 << 20, 32 << 20, 4 << 20, 6
SAMPLE_ROWS, SAMPLED_IN_LIST, LISTS_PER_ROOT, ROUNDS, TRIALS = 8192, 16, 2, 6, 256
TABLE_SIDE, QUERY_SIDE = 0, 1


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Rows of equal length scaled to length one; zero rows stay."""
    m = np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def best_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise top ``k`` by rounded score, ties by column."""
    rounded = np.round(scores, DECIMALS)
    if rounded.shape[1] > 8 * k:  # all columns that can be among the first, ties at the edge included
        edge = np.partition(rounded, -k, axis=1)[:, -k]
        width = int((rounded >= edge[:, None]).sum(1).max())
        if width <= rounded.shape[1] // 2:
            some = np.sort(np.argpartition(rounded, -width, axis=1)[:, -width:], axis=1)
            order = np.argsort(-np.take_along_axis(rounded, some, 1), axis=1, kind="stable")[:, :k]
            order = np.take_along_axis(some, order, 1)
            return order, np.take_along_axis(rounded, order, 1)
    order = np.argsort(-rounded, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(rounded, order, 1)


def piece_rows(width: int) -> int:
    """Rows of ``width`` numbers that a task works on at once."""
    return max(1, PIECE_BYTES // (8 * max(1, width)))


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in batches of at most ``rows``."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _streamed(k: int, query_id: str):
    """Table rows of a block are gathered, its queries multiplied with them; blocks come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, parts, table = None, [], [], None
        for batch in batches:
            block, salt, side = (np.asarray(batch.column(c)) for c in ("block", "salt", "side"))
            turns = np.nonzero((np.diff(block) != 0) | (np.diff(salt) != 0) | (np.diff(side) != 0))[0] + 1
            for a, b in zip([0, *turns], [*turns, batch.num_rows], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if at != (block[a], salt[a]):
                    at, names, parts, table = (block[a], salt[a]), [], [], None
                if side[a] == TABLE_SIDE:
                    names += part.column("hit_id").to_pylist()
                    parts.append(unit_rows(part.column("vec")))
                    continue
                if not parts:
                    continue
                if table is None:
                    table, held = np.concatenate(parts).T, np.array(names, object)
                step = max(1, SCORE_BYTES // (8 * table.shape[1]))
                for i in range(0, part.num_rows, step):
                    piece = part.slice(i, step)
                    order, score = best_columns(unit_rows(piece.column("vec")) @ table, k)
                    width = order.shape[1]
                    ids = piece.column(query_id).take(pa.array(np.repeat(np.arange(piece.num_rows), width)))
                    rank = pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), piece.num_rows))
                    yield pa.RecordBatch.from_arrays([ids, rank, pa.array(held[order.ravel()], pa.string()), pa.array(score.ravel())], [query_id, "rank", "hit_id", "score"])

    return run


def _multiplied(table: DataFrame, queries: DataFrame, query_id: str, k: int, merge: bool) -> DataFrame:
    """Best rows per query from ``table(block, salt, hit_id, vec)`` and ``queries(block, salt, query_id, vec)``."""
    kind = queries.schema[query_id].dataType.simpleString()
    rows = table.select("block", "salt", F.lit(TABLE_SIDE).alias("side"), "hit_id", F.lit(None).cast(kind).alias(query_id), "vec").unionByName(
        queries.select("block", "salt", F.lit(QUERY_SIDE).alias("side"), F.lit(None).cast("string").alias("hit_id"), query_id, "vec")
    )
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "block", "salt").sortWithinPartitions("block", "salt", "side", "hit_id")
    found = rows.mapInArrow(_streamed(k, query_id), f"{query_id} {kind}, rank int, hit_id string, score double")
    if not merge:
        return found
    ranked = top_n(found.drop("rank"), [query_id], [F.col("score").desc(), F.col("hit_id")], k)
    return ranked.select(query_id, F.col("rank").cast("int").alias("rank"), "hit_id", "score")


def _sides(queries: DataFrame, table: DataFrame, query_id: str, table_id: str) -> tuple[DataFrame, DataFrame]:
    vec = F.col("vec").cast("array<double>").alias("vec")
    rows = table.select(F.col(table_id).cast("string").alias("hit_id"), vec).filter("vec IS NOT NULL")
    return queries.select(query_id, vec).filter("vec IS NOT NULL"), rows


def _numbers(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def top_k_similar(
    queries: DataFrame,
    table: DataFrame,
    query_id: str,
    table_id: str,
    k: int = 3,
    threshold: float | None = None,
    max_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Exact ``k`` most similar table rows of each query (column ``vec`` on both sides): ``(query_id, rank, hit_id, score)``.

    Order is by score, rounded, then by id as text. The table is cut into as many blocks as its counted bytes ask for; with
    fewer blocks than tasks, a block's queries are dealt to several tasks. Rows without a vector are left out.
    """
    asked, rows = _sides(queries, table, query_id, table_id)
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    blocks = max(1, -(-n * (width or 1) * 8 // max_bytes))
    salts = max(1, -(-int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks))
    held = rows.withColumns({"block": F.pmod(F.xxhash64("hit_id"), F.lit(blocks)).cast("int"), "salt": _numbers(salts)})
    sent = asked.withColumns({"salt": F.pmod(F.xxhash64(query_id), F.lit(salts)).cast("int"), "block": _numbers(blocks)})
    found = _multiplied(held, sent, query_id, k, blocks > 1)
    return found if threshold is None else found.filter(F.col("score") >= threshold)


@dataclass
class Lists:
    """Centres fitted on a bounded sample of unit vectors, and how far beyond its nearest one a query looks."""

    centres: np.ndarray
    margin: float

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, k: int, recall: float) -> Lists:
        rng = np.random.default_rng(4)
        centres = sample[rng.permutation(len(sample))[:lists]]
        for _ in range(ROUNDS):
            near = (sample @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, sample)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
        asked = sample[rng.permutation(len(sample))[:TRIALS]]
        found = best_columns(asked @ sample.T, min(k + 1, len(sample)))[0]
        cosine = asked @ centres.T
        away = cosine.max(1, keepdims=True) - np.take_along_axis(cosine, (sample @ centres.T).argmax(1)[found], 1)
        return cls(centres, float(np.quantile(away, recall)))

    def own(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centres.T).argmax(1)

    def wanted(self, x: np.ndarray, held: np.ndarray, k: int) -> list[np.ndarray]:
        """Lists up to the margin, and on until they hold ``k`` rows."""
        cosine = x @ self.centres.T
        order = np.argsort(-cosine, axis=1, kind="stable")
        near = np.take_along_axis(cosine, order, 1)
        near = (near[:, :1] - near <= self.margin).sum(1)
        enough = (np.cumsum(held[order], 1) < k).sum(1) + 1
        return [o[: max(a, b)].astype(np.int32) for o, a, b in zip(order, near, enough, strict=True)]


def top_k_by_lists(
    queries: DataFrame,
    table: DataFrame,
    query_id: str,
    table_id: str,
    k: int = 3,
    recall: float = 0.95,
    max_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Approximate twin of ``top_k_similar`` that looks into the lists near a query only.

    Table rows go to the list of the nearest of about two centres for the root of their number. How far a query looks is
    taken from a trial on the sample of about ``SAMPLE_ROWS`` rows that the centres are fitted on, so that ``recall`` of the
    nearest sampled rows are in the lists looked into. Long lists are cut into blocks.
    """
    spark = table.sparkSession
    asked, rows = _sides(queries, table, query_id, table_id)
    rows = materialize(rows, "table")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    kind = queries.schema[query_id].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"{query_id} {kind}, rank int, hit_id string, score double")
    share = round(min(1.0, SAMPLE_ROWS / n) * (1 << 30))
    sample = unit_rows(rows.filter(F.pmod(F.xxhash64("hit_id"), F.lit(1 << 30)) < share).select("vec").toArrow()["vec"].combine_chunks())
    index = Lists.fit(sample, max(1, min(int(LISTS_PER_ROOT * n**0.5), len(sample) // SAMPLED_IN_LIST)), k, recall) if len(sample) else Lists(np.zeros((1, width)), np.inf)

    step = piece_rows(max(len(index.centres), width))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, step):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(index.own(unit_rows(b.column("vec"))).astype(np.int32))], ["hit_id", "vec", "list"])

    listed = materialize(rows.mapInArrow(assign, "hit_id string, vec array<double>, list int"), "lists")
    held = np.zeros(len(index.centres), np.int64)
    for r in listed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # one number a list
        held[r["list"]] = r["n"]
    cuts = F.array(*[F.lit(max(1, -(-int(h) * width * 8 // max_bytes))) for h in held])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, step):
            lists = index.wanted(unit_rows(b.column("vec")), held, k)
            at = np.repeat(np.arange(b.num_rows), [len(w) for w in lists])
            looked = np.concatenate(lists)
            for i in range(0, len(at), piece_rows(width)):
                taken = b.take(pa.array(at[i : i + piece_rows(width)]))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(looked[i : i + piece_rows(width)])], [query_id, "vec", "block"])

    sent = asked.mapInArrow(ask, f"{query_id} {kind}, vec array<double>, block int")
    sent = sent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.get(cuts, F.col("block")) - 1)))
    blocks = listed.withColumn("salt", F.pmod(F.xxhash64("hit_id"), F.get(cuts, F.col("list"))).cast("int")).withColumnRenamed("list", "block")
    return _multiplied(blocks, sent, query_id, k, True)
