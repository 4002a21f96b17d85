"""Substring deduplication: content-defined chunks of a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialoom.llm.common import map_slices
from medialoom.session import materialize

WORDS_IN_CHUNK = 5
LEAST_BYTES = 64
#: Longer chunks get edges at any code point, about every ``POINTS_IN_CHUNK``-th; none is longer than ``LONGEST_BYTES``.
LONG_BYTES, POINTS_IN_CHUNK, LONGEST_BYTES = 256, 16, 1024
#: Slots of the bitmap of repeated digests, and how many of them are put together at once.
SLOTS, SLOTS_IN_PART = 1 << 26, 1 << 20
GEAR = np.random.default_rng(3).integers(0, 1 << 32, 256, dtype=np.uint32)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def edges(data: bytes, words: int = WORDS_IN_CHUNK) -> np.ndarray:
    """Chunk edges, 0 and the length included. An edge may stand after white space or before a wide character, about
    every ``words``-th such place has one; which, depends on the 16 bytes before it alone. Where that leaves more than
    ``LONG_BYTES`` without an edge, as in text without white space, any code point may start a chunk, by a stricter mask of the
    same hash. Only text of a short period has no edge then either; it is cut every ``LONGEST_BYTES`` or a little less."""
    b = np.frombuffer(data, np.uint8)
    h = GEAR[b]
    for by in (1, 2, 4, 8):
        h[by:] = h[by:] + (h[:-by] << np.uint32(by))
    may = SPACE[b[:-1]] & ~SPACE[b[1:]] | (b[1:] >= 0xE3)
    part = h[:-1] >> np.uint32(8) & np.uint32(0xFF)
    found = np.concatenate([[0], np.nonzero(may & (part < 256 // words))[0] + 1, [len(b)]])
    if (np.diff(found) <= LONG_BYTES).all():
        return found
    starts = (b & 0xC0) != 0x80
    more = np.nonzero(starts[1:] & (part < 256 // POINTS_IN_CHUNK))[0] + 1
    at = np.searchsorted(found, more, side="right")
    found = np.union1d(found, more[found[at] - found[at - 1] > LONG_BYTES])
    forced = [np.arange(x + LONGEST_BYTES, y, LONGEST_BYTES) for x, y in zip(found[:-1], found[1:], strict=True) if y - x > LONGEST_BYTES]
    if not forced:
        return found
    point = np.maximum.accumulate(np.where(starts, np.arange(len(b)), 0))
    return np.union1d(found, point[np.concatenate(forced)])


def chunk_rows(docs: DataFrame, doc_id: str, text: str, words: int, wanted=None) -> DataFrame:
    """``(id, own, start, length, d1, d2)`` in UTF-8 bytes: each chunk with the next one, a lone chunk by itself.

    ``own`` tells texts of equal id apart; ``d1`` and ``d2`` are a digest of 128 bits. With ``wanted``, a broadcast bitmap,
    only chunks whose slot is set in it are given out.
    """

    def cut(cols: dict) -> dict:
        at, start, length, digests = [], [], [], []
        bitmap = None if wanted is None else wanted.value
        for i, value in enumerate(cols["text"]):
            data = (value.as_py() or "").encode("utf-8", "replace")
            if not data:
                continue
            e = edges(data, words)
            lo, hi = (e[:-2], e[2:]) if len(e) > 2 else (e[:-1], e[1:])
            both = b"".join([xxhash.xxh3_128_digest(data[x:y]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)])
            both = np.frombuffer(both, "<i8").reshape(-1, 2)
            if bitmap is not None:
                slot = both[:, 0] & (SLOTS - 1)
                held = bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1
                lo, hi, both = lo[held], hi[held], both[held]
            at.append(np.full(len(lo), i))
            start.append(lo)
            length.append(hi - lo)
            digests.append(both)
        join = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts]).astype(kind)
        rows = pa.array(join(at, np.int64))
        both = np.concatenate([np.empty((0, 2), np.int64), *digests])
        return {
            "id": cols["id"].take(rows),
            "own": cols["own"].take(rows),
            "start": pa.array(join(start, np.int32)),
            "length": pa.array(join(length, np.int32)),
            "d1": pa.array(np.ascontiguousarray(both[:, 0])),
            "d2": pa.array(np.ascontiguousarray(both[:, 1])),
        }

    return map_slices(keyed_rows(docs, doc_id, text).where("id IS NOT NULL"), cut, "id bigint, own bigint, start int, length int, d1 bigint, d2 bigint")


def keyed_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.withColumn("own", F.xxhash64("text"))


def slots_of(known: DataFrame) -> np.ndarray:
    """A bitmap over the slots of the digests: of a fixed size, put together by executors in parts."""

    def pack(batches):
        at, bits = None, None
        for batch in batches:
            for part, slot in zip(np.asarray(batch.column("part")).tolist(), np.asarray(batch.column("slot")).tolist(), strict=True):
                if part != at:
                    if at is not None:
                        yield pa.RecordBatch.from_pydict({"part": [at], "bits": [np.packbits(bits, bitorder="little").tobytes()]})
                    at, bits = part, np.zeros(SLOTS_IN_PART, bool)
                bits[slot & (SLOTS_IN_PART - 1)] = True
        if at is not None:
            yield pa.RecordBatch.from_pydict({"part": [at], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    slots = known.select(F.col("d1").bitwiseAND(SLOTS - 1).alias("slot")).distinct()
    slots = slots.withColumn("part", F.floor(F.col("slot") / SLOTS_IN_PART)).repartition("part").sortWithinPartitions("part")
    out = np.zeros(SLOTS // 8, np.uint8)
    for r in slots.mapInArrow(pack, "part bigint, bits binary").collect():  # 8 MB at most
        out[r["part"] * SLOTS_IN_PART // 8 : (r["part"] + 1) * SLOTS_IN_PART // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def repeated_spans(docs: DataFrame, doc_id: str, text: str, words: int, least_bytes: int) -> DataFrame:
    """``(id, own, spans)``: byte spans of chunks that a document of smaller id has too, runs of ``least_bytes`` and more.

    Texts are cut twice: for the digests that several ids have, and then for the places of those digests alone. The bitmap
    between the two only decides how many other chunks are moved.
    """
    both = ["d1", "d2"]
    known = chunk_rows(docs, doc_id, text, words).groupBy(*both).agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    known = materialize(known.select(*both, "first"), "digests")  # so that the join's hot digests can be split
    wanted = docs.sparkSession.sparkContext.broadcast(slots_of(known))
    again = chunk_rows(docs, doc_id, text, words, wanted).join(known, both).where("id > first")
    spans = again.groupBy("id", "own").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("stop")))).alias("spans"))

    def join(acc, x):
        last = F.element_at(acc, -1)
        longer = F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop")))
        touches = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["stop"] >= x["start"])
        return F.when(touches, F.concat(F.slice(acc, 1, F.size(acc) - 1), longer)).otherwise(F.concat(acc, F.array(x)))

    none = F.array().cast("array<struct<start:int,stop:int>>")
    runs = F.filter(F.aggregate("spans", none, join), lambda s: s["stop"] - s["start"] >= least_bytes)
    return spans.select("id", "own", runs.alias("spans")).where(F.size("spans") > 0)


def dedup_substrings(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS_IN_CHUNK, least_bytes: int = LEAST_BYTES
) -> DataFrame:
    """One row per input row: ``(doc_id, n_bytes, removed_bytes, spans, text)``.

    Text is cut where a gear rolling hash says so, into chunks of about ``words`` words, so an insertion moves no edge
    beyond the next few words; text without white space is cut between code points instead. A chunk is repeated if it follows or precedes the same chunk in a document of smaller
    id; runs of repeated chunks of ``least_bytes`` and more are removed, ``spans`` has their bytes. The document of
    smallest id keeps a passage.

    A null text gives null with no spans. Null ids are never changed; rows of equal id are not compared with each other, and each
    loses what its own text repeats. Very long texts are cut whole, one at a time.
    Other columns are ignored; an empty table gives an empty result.
    """
    found = repeated_spans(docs, doc_id, text, words, least_bytes)
    rows = keyed_rows(docs, doc_id, text).join(found, ["id", "own"], "left")

    def cut(cols: dict) -> dict:
        texts, sizes, gone = [], [], []
        for value, spans in zip(cols["text"], cols["spans"], strict=True):
            data, out, at = (value.as_py() or "").encode("utf-8", "replace"), [], 0
            for span in spans.as_py() or []:
                out.append(data[at : span["start"]])
                at = span["stop"]
            left = b"".join([*out, data[at:]])
            texts.append(left.decode("utf-8", "replace") if value.is_valid else None)
            sizes.append(len(data))
            gone.append(len(data) - len(left))
        return {"id": cols["id"], "n_bytes": pa.array(sizes, pa.int64()), "removed_bytes": pa.array(gone, pa.int64()), "spans": cols["spans"], "text": pa.array(texts, pa.string())}

    out = map_slices(rows, cut, "id bigint, n_bytes bigint, removed_bytes bigint, spans array<struct<start:int,stop:int>>, text string")
    return out.withColumnRenamed("id", doc_id)
