"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The word separators of every operator here, and the largest slice of rows handled at once in a task.
WORD = r"[^\x20\x09-\x0D]+"
ROWS_AT_ONCE = 512

MIX = np.uint64(0x9E3779B97F4A7C15)
FINISH = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """64-bit word hashes, remembered up to a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_set(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words count as one shingle, no words as none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(k, len(h))
    n = len(h) - width + 1
    acc = np.full(n, width, np.uint64)
    for j in range(width):
        acc = (acc ^ h[j : j + n]) * MIX
        acc ^= acc >> np.uint64(29)
    acc *= FINISH
    acc ^= acc >> np.uint64(32)
    return np.unique(acc)


def map_slices(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """``mapInArrow`` over slices of bounded row count; ``fn`` gets and returns a dict of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                out = fn({n: part.column(i) for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def unused(names: list[str], *wanted: str) -> list[str]:
    """Names for columns of our own that are none of ``names``, whatever their case."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column without nulls as a two-dimensional array of doubles."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1 if len(column) else (width or 1))


def usable(vec: str):
    """Vectors that take part: not null or empty, finite without null components, not all zero."""
    v = F.col(vec)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(
        v.isNotNull() & (F.size(v) > 0) & F.forall(v, fine) & F.exists(v, lambda x: x != 0), F.lit(False)
    )


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows (all, if there are no more), chosen by a hash of ``key``, so reruns choose the same."""
    share = min(1.0, rows / max(1, df.count()))
    return df.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) < round(share * (1 << 30))).limit(2 * rows)
