"""What a row shares with a small table that travels with the function: candidates of a source, terms of a set of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType, arrow_udf

# Pairs and items of one step, sources of one step, items looked up at once, and bytes of remembered rows.
PAIRS_AT_ONCE, SOURCES_AT_ONCE, ITEMS_AT_ONCE, KEPT_BYTES = 1 << 17, 512, 4096, 32 << 20
COUNTS = ("issue_overlap_count", "shared_entity_count", "shared_keyword_count")


class Holders:
    """Which rows of the side hold an item, as a row of bytes that is made once an item and kept up to a bounded size."""

    def __init__(self, lists: pa.Array, texts: pa.Array | None = None) -> None:
        self.size, self.kept, self.at = len(lists), {}, {}
        for i, items in enumerate(lists.to_pylist()):
            for item in items or ():
                self.at.setdefault(item, []).append(i)
        self.texts = None if texts is None else texts.to_pylist()

    def row(self, item: str) -> np.ndarray:
        if item not in self.kept:
            if (len(self.kept) + 1) * self.size > KEPT_BYTES:
                self.kept.clear()
            row = np.zeros(self.size, np.uint8)
            if self.texts is not None:
                row[:] = np.fromiter((t is not None and item in t for t in self.texts), np.uint8, self.size)
            row[self.at.get(item, [])] = 1
            self.kept[item] = row
        return self.kept[item]

    def counts(self, lists: pa.Array, source: np.ndarray, no: np.ndarray) -> np.ndarray:
        """How many items of a pair's source its side row holds."""
        out = np.zeros(len(source), np.int32)
        sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
        coded = lists.flatten().dictionary_encode()
        codes, names = np.asarray(coded.indices), coded.dictionary.to_pylist()
        first, many = (np.cumsum(sizes) - sizes)[source], sizes[source]
        for low in range(0, len(names), ITEMS_AT_ONCE):
            held = np.stack([self.row(name) for name in names[low : low + ITEMS_AT_ONCE]])
            for j in range(sizes.max(initial=0)):
                live = np.nonzero(many > j)[0]
                code = codes[first[live] + j] - low
                if len(names) > ITEMS_AT_ONCE:
                    inside = (code >= 0) & (code < len(held))
                    live, code = live[inside], code[inside]
                out[live] += held[code, no[live]]
        return out


def widths(vectors: pa.Array) -> np.ndarray:
    """Length of each vector, -1 for those that are null or hold nulls."""
    out = np.array(vectors.value_lengths().fill_null(-1), np.int64)
    if vectors.flatten().null_count:
        for i, v in enumerate(vectors.to_pylist()):
            if v is not None and None in v:
                out[i] = -1
    return out


def rows_of_width(vectors: pa.Array, at: np.ndarray, width: int) -> np.ndarray:
    return np.asarray(vectors.take(pa.array(at)).flatten(), np.float64).reshape(len(at), width)


class Similarity:
    """Dot products with the side's vectors, limited to [0, 1]; null where a vector is missing or the lengths differ."""

    def __init__(self, vectors: pa.Array) -> None:
        self.width = widths(vectors)
        self.groups = {int(w): np.nonzero(self.width == w)[0] for w in np.unique(self.width[self.width >= 0])}
        self.rows = {w: rows_of_width(vectors, at, w) for w, at in self.groups.items()}

    def pairs(self, vectors: pa.Array, source: np.ndarray, no: np.ndarray) -> pa.Array:
        width = widths(vectors)
        value = np.zeros((len(vectors), len(self.width)))
        for w, at in self.groups.items():
            mine = np.nonzero(width == w)[0]
            with np.errstate(all="ignore"):
                value[np.ix_(mine, at)] = rows_of_width(vectors, mine, w) @ self.rows[w].T
        found = value[source, no]
        found = np.where(np.isnan(found), 1.0, np.clip(found, 0.0, 1.0))  # in Spark's order NaN is the largest number
        known = (width[source] == self.width[no]) & (width[source] >= 0)
        return pa.array(found, mask=~known)


def steps(pairs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of the sources that hold ``PAIRS_AT_ONCE`` pairs at most, or one source."""
    start, held = 0, 0
    for i, n in enumerate(pairs.tolist()):
        if i > start and (held + n > PAIRS_AT_ONCE or i - start >= SOURCES_AT_ONCE):
            yield start, i
            start, held = i, 0
        held += n
    if len(pairs):
        yield start, len(pairs)


def pair_counts(side: pa.Table) -> Callable[[Iterator[tuple[pa.Array, ...]]], Iterator[pa.Array]]:
    """A function of ``(candidates, their number, issues, entities, lower-case keywords, vector)`` that lists a source's pairs.

    ``side(no, video_id, c_issues, c_entities, c_keywords, c_hay, c_vec)`` is small, not empty, and travels with the function.
    A candidate gives one entry for every side row of its id: its own fields, the row's ``no``, the counts and ``semantic``.
    """
    side = side.sort_by("video_id")

    def listed(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        column = lambda name: side.column(name).combine_chunks()
        holders = Holders(column("c_issues")), Holders(column("c_entities")), Holders(column("c_keywords"), column("c_hay"))
        near, numbers, ids = Similarity(column("c_vec")), np.asarray(column("no")), column("video_id").dictionary_encode()
        copies = np.bincount(np.asarray(ids.indices))
        begin = np.cumsum(copies) - copies
        for lists, many, *items, vectors in batches:
            own = [lists.type.value_type.field(i) for i in range(lists.type.value_type.num_fields)]
            more = [pa.field("no", pa.int64()), *[pa.field(c, pa.int32()) for c in COUNTS], pa.field("semantic", pa.float64())]
            out = [pa.array([], pa.list_(pa.struct([*own, *more])))]
            for low, high in steps(np.maximum(np.asarray(many.fill_null(0)), 0)):
                cut = lambda x: x.slice(low, high - low)  # noqa: E731, B023
                flat, sizes = cut(lists).flatten(), np.asarray(cut(lists).value_lengths().fill_null(0), np.int64)
                known = np.asarray(pc.index_in(flat.field("video_id"), value_set=ids.dictionary, skip_nulls=True).fill_null(-1), np.int64)
                times = np.where(known >= 0, copies[known], 0)
                place, ends = np.repeat(np.arange(len(flat)), times), np.cumsum(times)
                no = begin[known[place]] + np.arange(len(place)) - (ends - times)[place]
                source = np.repeat(np.arange(len(sizes)), sizes)[place]
                fields = [flat.field(i).take(pa.array(place)) for i in range(len(own))]
                counts = [pa.array(h.counts(cut(x), source, no)) for h, x in zip(holders, items, strict=True)]
                pairs = pa.StructArray.from_arrays([*fields, pa.array(numbers[no]), *counts, near.pairs(cut(vectors), source, no)], fields=[*own, *more])
                ends = np.concatenate([[0], np.cumsum(np.bincount(source, minlength=len(sizes)))])
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs).cast(out[0].type))
            yield pa.concat_arrays(out)

    return listed


def with_pairs(met: DataFrame, side: pa.Table, keywords: Column) -> DataFrame:
    """``met`` with ``candidates`` replaced by the pairs of ``pair_counts``, from ``s_issues``, ``s_entities``, ``keywords`` and ``s_vec``."""
    own = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in met.schema["candidates"].dataType.elementType.fields)
    counts = ", ".join(f"{c}: int" for c in COUNTS)
    kind = f"array<struct<{own}, no: bigint, {counts}, semantic: double>>"
    listed = arrow_udf(pair_counts(side), kind, ArrowUDFType.SCALAR_ITER)
    # candidates are named twice, so the optimizer leaves what makes them in a projection of its own
    return met.withColumn(
        "candidates", listed("candidates", F.size("candidates"), F.array_distinct("s_issues"), F.array_distinct("s_entities"), keywords, "s_vec")
    )


class Terms:
    """Weights of a set's words: the points of the terms whose words are all in the set. ``table(rarest, words)``."""

    def __init__(self, table: pa.Table) -> None:
        words = table.column("words").combine_chunks()
        flat, sizes = words.flatten(), np.asarray(words.value_lengths(), np.int64)
        coded = flat.field("needle").dictionary_encode()
        self.at = {word: i for i, word in enumerate(coded.dictionary.to_pylist())}
        self.word, self.points = np.asarray(coded.indices, np.int64), np.asarray(flat.field("points"), np.float64)
        self.ends = np.cumsum(sizes)
        self.sizes = sizes
        by_word: dict[str, list[int]] = {}
        for i, word in enumerate(table.column("rarest").to_pylist()):
            by_word.setdefault(word, []).append(i)
        self.by_word = {word: np.array(x) for word, x in by_word.items()}
        self.held = np.zeros(len(self.at) + 1, np.int64)

    def weights(self, names: list[str]) -> list[float] | None:
        """A weight for every name, None if no term matches."""
        tried = [self.by_word[name] for name in names if name in self.by_word]
        if not tried:
            return None
        terms = np.concatenate(tried)
        ids = [self.at.get(name, len(self.at)) for name in names]
        self.held[ids] = 1
        self.held[-1] = 0
        sizes = self.sizes[terms]
        starts = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(self.ends[terms] - sizes - starts, sizes)
        word = self.word[at]
        match = np.add.reduceat(self.held[word], starts) == sizes
        self.held[ids] = 0
        if not match.any():
            return None
        kept = np.repeat(match, sizes)
        sums = np.bincount(word[kept], self.points[at[kept]], len(self.at) + 1)
        return sums[ids].tolist()


def weights_of_terms(table: pa.Table) -> Callable:
    """A function of a set of words that gives ``Terms.weights`` of it."""

    def weights(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms = Terms(table)
        for sets in batches:
            yield pa.array([terms.weights(names) for names in sets.to_pylist()], pa.list_(pa.float64()))

    return arrow_udf(weights, "array<double>", ArrowUDFType.SCALAR_ITER)
