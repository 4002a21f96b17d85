"""Line deduplication: documents that share rare lines or runs are aligned with patience diff, common blocks go from the later one."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialoom.llm.common import map_slices, unused
from medialoom.session import materialize

BLOCK_CHARS = 50
RARE_CHARS, RARE_TIMES = 20, 8  # a rare line has at least so many characters and is in the corpus at most so often
GAP_LINES = 2
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matching line numbers of two documents: lines unique in both anchor the alignment, within gaps again."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {a[i]: i for i in range(a0, a1) if in_a[a[i]] == 1}
        both = [(place[b[j]], j) for j in range(b0, b1) if in_b[b[j]] == 1 and b[j] in place]
        if not both:
            continue
        tops: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for n, (i, _) in enumerate(both):
            at = bisect_left(tops, i)
            tops[at : at + 1] = [i]
            ends[at : at + 1] = [n]
            back.append(ends[at - 1] if at else -1)
        chain, n = [], ends[-1]
        while n >= 0:
            chain.append(both[n])
            n = back[n]
        chain.reverse()
        out += chain
        for (i, j), (i2, j2) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)], strict=True):
            todo.append((i + 1, i2, j + 1, j2))
    return sorted(out)


def common_lines(
    pairs: list[tuple[int, int]], chars: list[int], rare: set[int], least: int, gap: int
) -> tuple[list[int], list[int]]:
    """Line numbers of the later document that aligned pairs of line numbers delete: from unbroken and from rare blocks.

    An unbroken block has at least ``least`` characters. In a rare block up to ``gap`` lines of either document may stand
    between two aligned ones; its lines in ``rare`` have at least ``least`` characters, and it goes from the first of them
    to the last.
    """
    whole, broken = [], []
    block: list[int] = []
    wide: list[int] = []
    last = (-2, -2)
    for i, j in [*pairs, (1 << 40, 1 << 40)]:
        steps = (i - last[0], j - last[1])
        if steps != (1, 1):
            if sum(chars[x] for x in block) >= least:
                whole += block
            block = []
        if max(steps) > gap + 1:
            known = [n for n, x in enumerate(wide) if x in rare]
            if sum(chars[wide[n]] for n in known) >= least:
                broken += wide[known[0] : known[-1] + 1]
            wide = []
        block.append(j)
        wide.append(j)
        last = (i, j)
    return whole, broken


def held_runs(a: list[int], b: list[int], runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches of ``b`` that cover those of its ``runs`` that are, line by line, in ``a`` as well."""
    at: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        at.setdefault(x, []).append(i)
    found = [(0, 0)]
    for start, stop in sorted(runs):
        if found[-1][0] <= start and stop <= found[-1][1]:
            continue
        key = min(range(start, stop), key=lambda j: len(at.get(b[j], ())))
        for i in at.get(b[key], ()):
            i += start - key
            if i >= 0 and a[i : i + stop - start] == b[start:stop]:
                end, i = stop, i + stop - start
                while end < len(b) and i < len(a) and a[i] == b[end]:  # later runs on the same diagonal need no search
                    end, i = end + 1, i + 1
                found.append((start, end))
                break
    return found[1:]


def runs_of(lines: np.ndarray, chars: np.ndarray, edges: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the runs of lines that just reach ``least`` characters, from each line on and up to each line.

    ``edges`` part the lines into documents; no run crosses them. Any longer run is covered by such runs within it.
    """
    n = len(lines)
    total = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
    places = np.arange(n)
    doc = np.searchsorted(edges, places, side="right")
    on = np.searchsorted(total, total[:-1] + least, side="left")
    up = np.searchsorted(total, total[1:] - least, side="right") - 1
    fits, reaches = on <= edges[doc], up >= edges[doc - 1]
    pairs = np.unique(np.concatenate([np.stack([places, on], 1)[fits], np.stack([up, places + 1], 1)[reaches]]), axis=0)
    start, stop = pairs[:, 0], pairs[:, 1]
    # a polynomial of the line hashes modulo 2^64, divided by the power of its first line, is the same at any place
    up_powers, down_powers = (np.cumprod(np.array([1] + [x] * n, np.uint64), dtype=np.uint64) for x in (BASE, BACK))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lines.view(np.uint64) * up_powers[:-1], dtype=np.uint64)])
    key = (sums[stop] - sums[start]) * down_powers[start] + (stop - start).astype(np.uint64)
    return start, stop, key.view(np.int64)


def removed_lines(docs: DataFrame, doc_id: str, text: str, block_chars: int, rare_times: int, gap_lines: int) -> DataFrame:
    """``(id, removed)``: numbers of the lines that go, for documents that lose any; ids repeat as often as rows do."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.split(F.col(text).cast("string"), "\n").alias("lines"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lines").isNotNull()).withColumn("lines", F.transform("lines", lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c"))))
    hashed = rows.select("id", F.transform("lines", lambda x: F.xxhash64(x)).alias("lines"), F.transform("lines", lambda x: F.length(x)).alias("chars"))
    hashed = materialize(hashed.withColumn("digest", F.xxhash64("lines")), "lines")

    def cut(cols: dict) -> dict:
        edges = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(cols["lines"])))]).astype(np.int64)
        lines, chars = np.asarray(cols["lines"].flatten()), np.asarray(cols["chars"].flatten())
        start, stop, key = runs_of(lines, chars, edges, block_chars)
        # lines that are no run by themselves may be rare; their keys are those that runs of one line have
        alone = np.flatnonzero((chars >= RARE_CHARS) & (chars < block_chars))
        weak = np.repeat([False, True], [len(start), len(alone)])
        start, stop = np.concatenate([start, alone]), np.concatenate([stop, alone + 1])
        key = np.concatenate([key, (lines[alone].view(np.uint64) + np.uint64(1)).view(np.int64)])
        doc = np.searchsorted(edges, start, side="right") - 1
        at = pa.array(doc)
        places = {c: pa.array((x - edges[doc]).astype(np.int32)) for c, x in (("start", start), ("stop", stop))}
        return {"id": cols["id"].take(at), "digest": cols["digest"].take(at)} | places | {"weak": pa.array(weak), "run": pa.array(key)}

    runs = map_slices(hashed, cut, "id bigint, digest bigint, start int, stop int, weak boolean, run bigint")
    shared = runs.groupBy("run").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"), F.max("weak").alias("only"))
    shared = shared.where("first < last").select("run", "first", (F.col("n") <= rare_times).alias("rare"), "only")
    shared = materialize(shared.where("rare OR NOT only").drop("only"), "shared")  # so that hot runs can be split
    met = runs.join(shared, "run").where("id > first").groupBy("id", "digest", "first")
    met = met.agg(F.collect_set(F.struct("start", "stop", "weak", "rare")).alias("runs"))
    met = met.where(F.exists("runs", lambda r: ~r["weak"]) | (F.size("runs") > 1))  # a single weak line is no block
    earlier = hashed.select(F.col("id").alias("first"), F.col("lines").alias("a"))
    later = hashed.select("id", "digest", F.col("lines").alias("b"), "chars")
    met = met.join(earlier, "first").join(later, ["id", "digest"]).select("id", "digest", "runs", "a", "b", "chars")

    def align(cols: dict) -> dict:
        found = []
        for a, b, c, held in zip(*(cols[x].to_pylist() for x in ("a", "b", "chars", "runs")), strict=True):
            rare = {r["start"] for r in held if r["rare"] and r["stop"] == r["start"] + 1}
            whole, broken = common_lines(patience(a, b), c, rare, block_chars, gap_lines)
            gone = np.zeros(len(b) + 1, np.int64)
            gone[whole] = 1
            before = np.concatenate([[0], np.cumsum(gone)])
            left = [(r["start"], r["stop"]) for r in held if not r["weak"]]
            left = [(i, j) for i, j in left if before[j] - before[i] < j - i]  # not aligned: not unique, or in another order
            for i, j in held_runs(a, b, left) if left else []:
                gone[i:j] = 1
            gone[broken] = 1
            found.append(np.flatnonzero(gone).astype(np.int32))
        return {"id": cols["id"], "digest": cols["digest"], "lines": pa.array(found, pa.list_(pa.int32()))}

    aligned = map_slices(met, align, "id bigint, digest bigint, lines array<int>")
    gone = aligned.select("id", "digest", F.explode("lines").alias("line")).distinct()
    return gone.groupBy("id", "digest").agg(F.collect_set("line").alias("removed"))


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    block_chars: int = BLOCK_CHARS,
    rare_times: int = RARE_TIMES,
    gap_lines: int = GAP_LINES,
) -> DataFrame:
    """All rows and columns of ``docs`` with repeated blocks of lines deleted from the text, and ``n_lines``, ``n_removed``.

    Lines are compared without white space at their ends. Two things lead a document to an earlier one, the holder of
    smallest id: a rare line, which has at least 20 characters and is in the corpus at most ``rare_times`` times, and a
    run of consecutive lines, rare or not, that just reaches ``block_chars`` characters, short and empty lines included.
    So a line leads to one partner by itself and to two by its runs, however many documents share it. Each pair is aligned
    by patience diff, and the later document loses

    * aligned blocks of at least ``block_chars`` characters without a gap;
    * aligned blocks with gaps of at most ``gap_lines`` lines in either document, from their first rare line to their
      last, if the rare ones have at least ``block_chars`` characters: a passage in which lines were changed, inserted or
      left out. Lines in the gaps stay;
    * shared runs that the alignment leaves out, because a line is not unique or the order differs, after a comparison
      line by line.

    So every line goes that is in a run of at least ``block_chars`` characters that a document of smaller id has too, and
    beyond these only what rare lines and their order prove to be a changed copy. With ``rare_times`` 0 only runs go.

    A null text stays null with 0 lines; an empty text is one empty line. Rows with a null id are never changed. Rows of
    equal id are not compared with each other. Texts of any length are handled whole; the two documents of a pair have to
    fit into a task. Columns named ``n_lines`` or ``n_removed`` are replaced. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    key, own, removed = unused(docs.columns, "_id", "_digest", "_removed")
    gone = removed_lines(docs, doc_id, text, block_chars, rare_times, gap_lines)
    gone = gone.select(F.col("id").alias(key), F.col("digest").alias(own), F.col("removed").alias(removed))
    lines = F.split(F.col(text).cast("string"), "\n")
    digest = F.xxhash64(F.transform(lines, lambda x: F.xxhash64(F.btrim(x, F.lit(" \t\r\x0b\x0c")))))
    met = docs.select(*names).join(gone, (F.col(doc_id).cast("bigint") == F.col(key)) & (digest == F.col(own)), "left")
    gone_at = F.coalesce(removed, F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone_at)
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    return met.select(
        *[F.when(F.size(gone_at) > 0, kept).otherwise(F.col(c)).alias(c) if c == text else c for c in names],
        F.coalesce(F.when(F.col(text).isNotNull(), F.size(lines)), F.lit(0)).cast("bigint").alias("n_lines"),
        F.size(gone_at).cast("bigint").alias("n_removed"),
    )
