"""Search of many literal terms in texts, each read once: an Aho-Corasick automaton, or a bit map and a join for more terms."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from medialoom.session import materialize

# Up to so many terms an expression per term is cheaper, and the characters of all terms that one automaton
# may have. A state takes about 50 bytes, so an automaton that is sent to the executors has 50 MB at most.
FEW_TERMS, MAX_CHARACTERS = 32, 1 << 20
# Beyond: bits of the map for each term, and at most (as a power of two, 32 MB); odd factors of its hashes; code points of a
# text that are hashed at once.
BITS_A_TERM, MAX_BITS, STEP = 32, 28, 1 << 20
BASE, SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
PROBES = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F)
WHOLE, START = 0, 1


def automaton(terms: Iterable[str]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for term in terms:
        built.add_word(term, term)
    built.make_automaton()
    return built


def counted(built: ahocorasick.Automaton, text: str) -> dict[str, int]:
    """Occurrences of every term, from left to right without overlaps of a term with itself."""
    found: dict[str, int] = {}
    free: dict[str, int] = {}
    if not len(built):
        return found
    for last, term in built.iter(text):
        if last - len(term) >= free.get(term, -1):
            found[term] = found.get(term, 0) + 1
            free[term] = last
    return found


def _hits(count_in: Callable[[str], dict[str, int]], batch: pa.RecordBatch, keys: list[str], text: str) -> pa.RecordBatch:
    at, terms, n = [], [], []
    for i, value in enumerate(batch.column(text).to_pylist()):
        if value:
            for term, count in count_in(value).items():
                at.append(i)
                terms.append(term)
                n.append(count)
    rows = batch.select(keys).take(pa.array(at, pa.int64()))
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(terms, pa.string()), pa.array(n, pa.int64())], [*keys, "term", "n"])


def term_hits(rows: DataFrame, keys: list[str], text: str, terms: DataFrame, max_characters: int = MAX_CHARACTERS) -> DataFrame:
    """``(*keys, term, n)``: every term that occurs in a row's text, and how often, without overlaps.

    ``terms(term)`` may repeat; null and empty terms are never found, a null text holds none. The characters of the
    distinct terms are counted first. Within ``max_characters`` one automaton is built and sent to the executors. Beyond, a
    bit map of the terms' hashes is sent, and what may be a term by it is joined with the terms. Texts stay where they are.
    """
    if {"term", "n"} & set(keys):
        raise ValueError("term and n are names of the result")
    spark = rows.sparkSession
    wanted = terms.select(F.col("term").cast("string").alias("term")).filter("term <> ''").distinct()
    schema = StructType([rows.schema[k] for k in keys]).add("term", "string").add("n", "long")
    size = wanted.agg(F.sum(F.length("term").cast("bigint"))).first()[0] or 0
    texts = rows.select(*keys, F.col(text).alias("_text"))
    if size <= max_characters:
        built = spark.sparkContext.broadcast(automaton(r["term"] for r in wanted.toLocalIterator()))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _hits(lambda text: counted(built.value, text), batch, keys, "_text")

        return texts.mapInArrow(search, schema)
    listed = materialize(wanted, "terms")
    found = texts.mapInArrow(_possible_hits(listed, keys), schema)
    return found.join(listed.hint("merge"), "term", "left_semi").select(*schema.names)


class Windows:
    """Hashes of all windows of a text, from its running sum of code points times powers of a base, modulo 2^64.

    Equal strings always have equal hashes. The places of a hash are ``PROBES`` bits of a map of ``2^bits``.
    """

    def __init__(self, most: int, bits: int) -> None:
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.full(most, BASE, np.uint64))
            self.inverse = np.cumprod(np.full(most, pow(BASE, -1, 1 << 64), np.uint64))
        self.shift = np.uint64(64 - bits)

    def sums(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * self.powers[: len(codes)])])

    def hashes(self, sums: np.ndarray, at: np.ndarray, size: int, kind: int) -> np.ndarray:
        """``kind`` keeps whole terms and the beginnings of terms apart."""
        return (sums[at + size] - sums[at]) * self.inverse[at] + np.uint64((2 * size + kind) * SPREAD % (1 << 64))

    def slots(self, hashes: np.ndarray, probe: int) -> np.ndarray:
        return (hashes * np.uint64(PROBES[probe])) >> self.shift

    def marked(self, bitmap: np.ndarray, sums: np.ndarray, at: np.ndarray, size: int, kind: int) -> np.ndarray:
        """The places among ``at`` whose window of ``size`` code points may be in the map."""
        hashes = self.hashes(sums, at, size, kind)
        for probe in range(len(PROBES)):
            slots = self.slots(hashes, probe)
            good = (bitmap[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 != 0
            at, hashes = at[good], hashes[good]
        return at


def _classes(sizes: Iterable[int]) -> dict[int, list[int]]:
    """Sizes of terms by the length of the beginning that is looked up first: the largest power of two, or the only size."""
    out: dict[int, list[int]] = {}
    for size in sorted(sizes):
        out.setdefault(1 << (size.bit_length() - 1), []).append(size)
    return {(of[0] if len(of) == 1 else start): of for start, of in out.items()}


def _possible_hits(terms: DataFrame, keys: list[str]):
    """A step that counts every window of a text that may be one of ``terms(term)``, by a bit map of bounded size."""
    spark = terms.sparkSession
    n = terms.count()
    classes = _classes(r[0] for r in terms.select(F.length("term")).distinct().collect())
    start_of = {size: start for start, of in classes.items() for size in of if len(of) > 1}
    bits = min(MAX_BITS, max(16, (n * BITS_A_TERM).bit_length()))
    longest = max(max(of) for of in classes.values())

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, first = Windows(longest, bits), np.zeros(1, np.int64)
        for batch in batches:
            found = []
            for term in batch.column("term").to_pylist():
                sums = windows.sums(term)
                kinds = [(len(term), WHOLE)] + ([(start_of[len(term)], START)] if len(term) in start_of else [])
                hashes = [windows.hashes(sums, first, size, kind) for size, kind in kinds]
                found += [windows.slots(h, probe)[0] for h in hashes for probe in range(len(PROBES))]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(found, np.uint64).astype(np.int64))], ["slot"])

    # Spark's bit maps count from one.
    slot = F.col("slot") + 1
    parts = terms.mapInArrow(places, "slot long").groupBy(F.bitmap_bucket_number(slot).alias("bucket"))
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    for row in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).toLocalIterator():
        piece = np.frombuffer(row["bits"], np.uint8)
        at = (row["bucket"] - 1) * len(piece)
        bitmap[at : at + len(piece)] = piece[: len(bitmap) - at]
    sent = spark.sparkContext.broadcast(bitmap)

    def counts(windows: Windows, text: str) -> dict[str, int]:
        found: dict[str, int] = {}
        free: dict[str, int] = {}
        for a in range(0, len(text), STEP):
            part = text[a : a + STEP + longest - 1]
            sums = windows.sums(part)
            for start, of in classes.items():
                at = np.arange(max(0, min(STEP, len(part) - start + 1)))
                if len(of) > 1:
                    at = windows.marked(sent.value, sums, at, start, START)
                for size in of:
                    for place in windows.marked(sent.value, sums, at[at + size <= len(part)], size, WHOLE).tolist():
                        term = part[place : place + size]
                        if a + place >= free.get(term, 0):
                            found[term] = found.get(term, 0) + 1
                            free[term] = a + place + size
        return found

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(STEP + longest, bits)
        for batch in batches:
            yield _hits(lambda text: counts(windows, text), batch, keys, "_text")

    return search
