"""Packing token pieces into sequences by minimum bin slack."""

from __future__ import annotations

import base64
import json
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialoom.llm.common import map_slices
from medialoom.session import materialize

LIMIT = 1024
END_ID = 2
ROWS_IN_BLOCK = 20_000


@cache
def encoder(ranks_path: str, vocabulary_path: str):
    """The byte-level BPE of a rank file; text that spells an added token of the vocabulary is that token."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(vocabulary_path, encoding="utf-8") as vocabulary:
        added = {x["content"]: x["id"] for x in json.load(vocabulary)["added_tokens"]}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def default_path(kind: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"byte_bpe_50k.{kind}")


def token_pieces(docs: DataFrame, doc_id: str, text: str, limit: int, ranks_path: str, vocabulary_path: str, keep_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``, with ``ids`` on demand: every document's tokens and an end token.

    Only documents longer than ``limit`` are cut, into pieces of ``limit``; the first piece takes what is left over.
    """

    def cut(cols: dict) -> dict:
        bpe = encoder(ranks_path, vocabulary_path)
        rows: dict[str, list] = {c: [] for c in ("at", "piece", "start", "length", "ids_crc32", "ids")}
        for at, value in enumerate(cols["text"]):
            ids = bpe.encode_to_numpy((value.as_py() or "").encode("utf-8", "replace").decode(), allowed_special="all")
            ids = np.append(ids, END_ID).astype("<u4")
            first = len(ids) % limit or limit
            edges = [0, *range(first, len(ids) + 1, limit)]
            for piece, (start, stop) in enumerate(zip(edges, edges[1:], strict=False)):
                part = ids[start:stop]
                for c, v in zip(rows, (at, piece, start, len(part), zlib.crc32(part.tobytes()), part if keep_ids else None), strict=True):
                    rows[c].append(v)
        at = pa.array(rows.pop("at"), pa.int64())
        ids = rows.pop("ids")
        out = {"doc_id": cols["doc_id"].take(at), "piece": pa.array(rows.pop("piece"), pa.int32())}
        out |= {c: pa.array(v, pa.int64()) for c, v in rows.items()}
        return out | ({"ids": pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))} if keep_ids else {})

    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = f"doc_id {dict(texts.dtypes)['doc_id']}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return map_slices(texts, cut, schema + (", ids array<int>" if keep_ids else ""))


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Available lengths with the largest sum up to ``room``: subset sums as bits of an integer, largest lengths first."""
    mask, sums, history = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            history.append((length, take, sums))
            sums |= (sums << (length * take)) & mask
            left -= take
            take *= 2
            if sums >> room & 1:
                break
        if sums >> room & 1:
            break
    total, chosen = sums.bit_length() - 1, []
    for length, take, before in reversed(history):
        if not before >> total & 1:
            chosen += [length] * take
            total -= length * take
    return chosen


def plan(counts: dict[int, int], limit: int) -> list[tuple[list[int], int]]:
    """Combinations of lengths and how many sequences take each. Each starts with the longest length still there.

    A combination is repeated as long as its lengths last, so the work depends on how many lengths there are, not on
    how many pieces.
    """
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        combo = [longest, *fullest({k: v for k, v in left.items() if v > 0}, limit - longest)]
        left[longest] += 1
        need = {x: combo.count(x) for x in combo}
        times = min(left[x] // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((combo, times))
    return out


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, ranks_path: str | None = None, keep_ids: bool = False,
    vocabulary_path: str | None = None,
) -> DataFrame:
    """One row per piece: ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, and ``ids`` on demand.

    Sequences hold at most ``limit`` tokens. Which lengths go together is planned on the counts of the at most
    ``limit`` lengths; pieces are then numbered within their length, in blocks of bounded size, and the number says
    which sequence and place a piece gets. So only the length counts reach the driver.

    A null or empty text is a document of the end token alone. Null ids and repeated rows are documents like others.
    Other columns are ignored; an empty table gives an empty result. ``ranks_path`` and ``vocabulary_path``, the JSON file
    that has the added tokens, must be readable on every node.
    """
    pieces = materialize(token_pieces(docs, doc_id, text, limit, ranks_path or default_path("tiktoken"), vocabulary_path or default_path("json"), keep_ids), "pieces")
    spark = docs.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, base, used = [], 0, dict.fromkeys(counts, 0)
    for combo, times in plan(counts, limit):
        places: dict[int, list[int]] = {}
        at = 0
        for x in combo:
            places.setdefault(x, []).append(at)
            at += x
        for x, offsets in places.items():
            slots.append((x, used[x], used[x] + times * len(offsets), base, offsets))
            used[x] += times * len(offsets)
        base += times
    table = spark.createDataFrame(slots, "length bigint, first bigint, stop bigint, base bigint, offsets array<bigint>")
    sizes = spark.createDataFrame(
        [(k, -(-v // ROWS_IN_BLOCK)) for k, v in counts.items()], "length bigint, blocks bigint"
    )
    # both tables are bounded by ``limit``: one row per length, and the places of the planned combinations
    cut = pieces.join(F.broadcast(sizes), "length")
    cut = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("blocks"))).drop("blocks")
    before = cut.groupBy("length", "block").agg(F.count("*").alias("n"))
    order = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    in_block = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("number", F.row_number().over(in_block)).join(before, ["length", "block"])
    ranked = ranked.withColumn("number", F.col("number") + F.col("before") - 1).drop("before", "block")
    placed = ranked.join(F.broadcast(table.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("stop")))
    step = F.col("number") - F.col("first")
    return placed.select(
        F.col("doc_id").alias(doc_id), "piece", "start", "length", "ids_crc32",
        (F.col("base") + F.floor(step / F.size("offsets"))).cast("bigint").alias("sequence_id"),
        F.get("offsets", (step % F.size("offsets")).cast("int")).alias("offset"),
        *(["ids"] if keep_ids else []),
    )
