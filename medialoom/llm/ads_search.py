"""Approximate nearest neighbours: inverted lists scanned in column blocks with early abandonment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialoom.llm.common import bounded_sample, usable
from medialoom.session import materialize

# The index is fitted on about so many rows; lists hold so many of them at least, and are so many for the root of all rows.
SAMPLE_ROWS, SAMPLED_IN_LIST, LISTS_PER_ROOT = 10_000, 8, 4
ROUNDS, TRIAL_QUERIES, TRIAL_RECALL = 4, 256, 0.97
ROWS_IN_BLOCK, QUERIES_IN_BLOCK = 4096, 512
COLUMNS, SPARSE = 16, 1 / 16
DOUBT = 2.1


def rotation(width: int) -> np.ndarray:
    turn, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((width, width)))
    return turn


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def filled(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix of doubles; shorter rows end in zeros."""
    flat, sizes = np.asarray(lists.flatten(), np.float64), np.asarray(lists.value_lengths(), np.int64)
    if len(flat) == width * len(sizes):
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None] < sizes[:, None]] = flat
    return out


def best_first(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest scores of every row, in no order; all, if there are no more."""
    return np.argpartition(score, -k, axis=1)[:, -k:] if score.shape[1] > k else np.tile(np.arange(score.shape[1]), (len(score), 1))


@dataclass
class Index:
    """What the executors know of the index: a bounded sample, the centres of the lists, and how far to look."""

    width: int
    top: float
    ids: np.ndarray
    sample: np.ndarray
    centres: np.ndarray
    margin: float

    def rows(self, x: np.ndarray) -> np.ndarray:
        """One more component makes all norms equal, so the largest inner product is the smallest distance."""
        return np.hstack([x, np.sqrt(np.maximum(self.top - (x**2).sum(1), 0))[:, None]]) @ rotation(self.width + 1)

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.zeros((len(x), 1))]) @ rotation(self.width + 1)

    def list_of(self, x: np.ndarray) -> np.ndarray:
        return squared(self.rows(x), self.centres).argmin(1)

    @classmethod
    def fit(cls, ids: np.ndarray, x: np.ndarray, top: float, lists: int, k: int) -> Index:
        self = cls(x.shape[1], top, ids, x, np.zeros((0, 0)), np.inf)
        lifted = self.rows(x)
        centres = lifted[np.random.default_rng(2).permutation(len(x))[:lists]]
        for _ in range(ROUNDS):
            near = squared(lifted, centres).argmin(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, lifted)
            n = np.bincount(near, minlength=len(centres))[:, None]
            centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
        # neighbours in a walk from centre to nearest centre not yet seen are put into groups of lists
        left, walk = np.ones(len(centres), bool), [0]
        between = squared(centres, centres)
        for _ in range(len(centres) - 1):
            left[walk[-1]] = False
            walk.append(int(np.where(left, between[walk[-1]], np.inf).argmin()))
        self.centres = centres[walk]
        self.margin = self.looked_up_to(k)
        return self

    def looked_up_to(self, k: int) -> float:
        """How much farther than the nearest centre a list's centre may be, so that the lists up to there hold
        ``TRIAL_RECALL`` of the nearest sampled rows of some sampled queries."""
        asked = np.random.default_rng(3).permutation(len(self.sample))[:TRIAL_QUERIES]
        score = self.sample[asked] @ self.sample.T
        score[np.arange(len(asked)), asked] = -np.inf
        found = best_first(score, min(k, max(1, len(self.sample) - 1)))
        away = squared(self.queries(self.sample[asked]), self.centres)
        away -= away.min(1, keepdims=True)
        needed = np.take_along_axis(away, self.list_of(self.sample)[found], 1)
        return float(np.quantile(needed, TRIAL_RECALL))

    def others(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Inner products with the sampled rows of other ids."""
        return np.where(ids[:, None] == self.ids[None], -np.inf, x @ self.sample.T)

    def probes(self, ids: np.ndarray, x: np.ndarray, held: np.ndarray, k: int, probes: int | None) -> tuple[list[np.ndarray], np.ndarray]:
        """Per query the lists to look into, as many as hold ``k`` others at least, and a distance that its k-th nearest
        row can't exceed, since so many sampled rows are as near."""
        turned = self.queries(x)
        away = squared(turned, self.centres)
        order = np.argsort(away, axis=1, kind="stable")
        sizes = np.cumsum(held[order], axis=1)
        enough = (sizes < k + 1).sum(1) + 1
        far = np.take_along_axis(away, order, 1)
        wanted = np.full(len(x), probes) if probes else (far - far[:, :1] <= self.margin).sum(1)
        lists = [o[: max(a, b)].astype(np.int32) for o, a, b in zip(order, enough, wanted, strict=True)]
        if len(self.sample) <= k:
            return lists, np.full(len(x), np.inf)
        least = np.partition(self.others(ids, x), -k, axis=1)[:, -k]
        return lists, np.where(np.isfinite(least), (x**2).sum(1) + self.top - 2 * least, np.inf)


def scan(q: np.ndarray, x: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, row) that no test has abandoned and their squared distances, from rotated ``q`` and ``x``.

    Squared distances grow by blocks of columns; after each block a candidate is abandoned when its partial distance,
    scaled up to all columns, is beyond what the query's ``limit`` allows. While many candidates are left a block is one
    matrix product, later the candidates are taken one by one.
    """
    width = x.shape[1]
    allowed = lambda d: ((1 + 1e-9 if d == width else (1 + DOUBT / np.sqrt(d)) ** 2) * limit + 1e-9 * (1 + np.abs(limit))) * (d / width)
    dist, d = np.zeros((len(q), len(x))), 0
    while d < width:
        cols = slice(d, min(d + COLUMNS, width))
        dist += squared(q[:, cols], x[:, cols])
        d = cols.stop
        live = dist <= allowed(d)[:, None]
        if live.sum() <= SPARSE * live.size:
            break
        dist[~live] = np.inf
    i, j = np.nonzero(live)
    left = dist[i, j]
    while d < width and len(i):
        cols = slice(d, min(d + COLUMNS, width))
        left = left + ((q[i, cols] - x[j, cols]) ** 2).sum(1)
        d = cols.stop
        live = left <= allowed(d)[i]
        i, j, left = i[live], j[live], left[live]
    return i, j, left


def search_block(index: Index, qs: pa.StructArray, xs: pa.StructArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of queries, ids of rows and scores: the ``k`` best rows of the block for every query, of the lists it looks into."""
    xs = xs.take(pa.array(np.argsort(np.asarray(xs.field("list")), kind="stable")))
    qid, xid, own = np.asarray(qs.field("id")), np.asarray(xs.field("id")), np.asarray(xs.field("list"))
    q, x = filled(qs.field("v"), index.width), filled(xs.field("v"), index.width)
    turned, rows = index.queries(q), index.rows(x)
    limit = np.asarray(qs.field("bound")).copy()
    lists, first = np.unique(own, return_index=True)
    asked = qs.field("lists")
    who, what = np.repeat(np.arange(len(q)), np.asarray(asked.value_lengths())), np.asarray(asked.flatten())
    best = np.full((len(q), k), np.inf)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for name, a, b in zip(lists, first, [*first[1:], len(own)], strict=True):
        asking = who[what == name]
        if not len(asking):
            continue
        i, j, dist = scan(turned[asking], rows[a:b], limit[asking])
        i, j = asking[i], j + a
        other = qid[i] != xid[j]
        i, j, dist = i[other], j[other], dist[other]
        found.append((i, j))
        near = np.full((len(asking), b - a), np.inf)
        near[np.searchsorted(asking, i), j - a] = dist
        both = np.hstack([best[asking], near])
        best[asking] = np.partition(both, k - 1, axis=1)[:, :k]
        limit[asking] = np.minimum(limit[asking], best[asking].max(1))
    if not found:
        return qid[:0], xid[:0], np.zeros(0)
    i, j = (np.concatenate(p) for p in zip(*found, strict=True))
    score = np.einsum("ij,ij->i", q[i], x[j])
    order = np.lexsort((xid[j], -score, i))
    at = i[order]
    order = order[np.arange(len(at)) - np.searchsorted(at, at) < k]
    return qid[i[order]], xid[j[order]], score[order]


def nearest(
    vectors: DataFrame,
    is_query: Column,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = 20,
    lists: int | None = None,
    probes: int | None = None,
) -> DataFrame:
    """The ``k`` rows of largest inner product with each query row: ``(query_id, rank, vec_id, score)``.

    Rows go to the list of the nearest centre. There are ``lists`` of them, by default about four for the root of the
    number of rows, as far as the sample of about ``SAMPLE_ROWS`` rows that they are fitted on allows. A query looks into
    its ``probes`` nearest lists, by default into those up to a distance beyond its nearest one that a trial on the sample
    gave, and on into the next ones until they hold ``k`` other rows. Neighbouring lists form groups; a group's rows are cut
    into blocks of about ``ROWS_IN_BLOCK`` rows, its queries into blocks of about ``QUERIES_IN_BLOCK``. A task joins one of
    each and scans rotated column blocks list by list, abandoning candidates by hypothesis tests against the query's bound,
    which starts from the sample and so holds in all blocks. Scores are double-precision inner products of the original
    vectors; ties go to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components and null ids take no part; shorter vectors end
    in zeros. Of rows that share an id the one with the smallest vector stands for all, and asks if any does. Fewer
    candidates than ``k`` are all returned. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("v"), is_query.alias("ask"))
    rows = rows.where(usable("v") & F.col("id").isNotNull())
    rows = materialize(rows.groupBy("id").agg(F.min("v").alias("v"), F.coalesce(F.max("ask"), F.lit(False)).alias("ask")), "rows")
    norm = F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)
    n, width, top = rows.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = bounded_sample(rows.select("id", "v"), "id", SAMPLE_ROWS).toArrow().sort_by("id").combine_chunks()
    ids, x = np.asarray(sample["id"]), filled(sample["v"].combine_chunks(), width)
    index = Index.fit(ids, x, top, lists or max(1, min(int(LISTS_PER_ROOT * n**0.5), len(ids) // SAMPLED_IN_LIST)), k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(at, ROWS_IN_BLOCK) for at in range(0, b.num_rows, ROWS_IN_BLOCK)):
                own = index.list_of(filled(part.column("v"), width)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own)], ["id", "v", "ask", "list"])

    listed = materialize(rows.mapInArrow(assign, "id bigint, v array<double>, ask boolean, list int"), "index")
    held = np.zeros(len(index.centres), np.int64)
    for r in listed.groupBy("list").agg(F.count("*").alias("n")).collect():  # one number a list
        held[r["list"]] = r["n"]
    group = (np.cumsum(held) - held) // ROWS_IN_BLOCK
    salts = [max(1, -(-int(held[group == g].sum()) // ROWS_IN_BLOCK)) for g in range(int(group.max()) + 1)]
    salt_of = F.array(*[F.lit(s) for s in salts])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(at, QUERIES_IN_BLOCK) for at in range(0, b.num_rows, QUERIES_IN_BLOCK)):
                wanted, bound = index.probes(np.asarray(part.column("id")), filled(part.column("v"), width), held, k, probes)
                places = [(r, g, w[group[w] == g]) for r, w in enumerate(wanted) for g in np.unique(group[w])]
                at, g, w = zip(*places, strict=True)
                taken = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [taken.column("id"), taken.column("v"), pa.array(bound[list(at)]), pa.array(np.array(g, np.int32)), pa.array(w, pa.list_(pa.int32()))],
                    ["id", "v", "bound", "group", "lists"],
                )

    queries = listed.where("ask").select("id", "v").mapInArrow(ask, "id bigint, v array<double>, bound double, group int, lists array<int>")
    asking = listed.where("ask").count()
    queries = queries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.get(salt_of, F.col("group")) - 1)))
    part = F.pmod(F.xxhash64("id"), F.lit(-(-asking // QUERIES_IN_BLOCK) or 1))
    queries = queries.groupBy("group", "salt", part.alias("part")).agg(F.collect_list(F.struct("id", "v", "bound", "lists")).alias("qs"))
    group_of = F.get(F.array(*[F.lit(int(g)) for g in group]), F.col("list"))
    blocks = listed.select("id", "v", "list", group_of.alias("group")).withColumn("salt", F.pmod(F.xxhash64("id"), F.get(salt_of, F.col("group"))).cast("int"))
    blocks = blocks.groupBy("group", "salt").agg(F.collect_list(F.struct("id", "v", "list")).alias("xs"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qs, xs in zip(b.column("qs"), b.column("xs"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in search_block(index, qs.values, xs.values, k)], ["query_id", "vec_id", "score"])

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(at, QUERIES_IN_BLOCK) for at in range(0, b.num_rows, QUERIES_IN_BLOCK)):
                qid, q = np.asarray(part.column("id")), filled(part.column("v"), width)
                near = best_first(index.others(qid, q), k).ravel()
                i = np.repeat(np.arange(len(q)), len(near) // len(q))
                score = np.einsum("ij,ij->i", q[i], index.sample[near])
                other = qid[i] != index.ids[near]
                yield pa.RecordBatch.from_arrays([pa.array(a[other]) for a in (qid[i], index.ids[near], score)], ["query_id", "vec_id", "score"])

    met = queries.join(blocks, ["group", "salt"]).select("qs", "xs")
    # the sampled rows that gave the bound are found in any case, so there are ``k`` rows for every query
    found = met.mapInArrow(search, "query_id bigint, vec_id bigint, score double").unionByName(
        listed.where("ask").select("id", "v").mapInArrow(sampled, "query_id bigint, vec_id bigint, score double")
    )
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
