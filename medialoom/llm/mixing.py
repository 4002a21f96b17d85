"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialoom.llm.common import WORD, unused
from medialoom.session import materialize

# Weights of the sources in code point order, repeating, and how often a document may be taken.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
ROWS_IN_BLOCK = 4096
STATE = "id bigint, digest bigint, size bigint, source_size bigint, target double, source_no int, block bigint, blocks bigint, copies int, share double, luck double"


def targets(sized: DataFrame) -> DataFrame:
    """``(source, source_no, source_size, target, blocks)`` per source, from rows of ``(source, size)``.

    A source's target is its weight times one level common to all, or ``MOST_COPIES`` times its size if that is less:
    where resharing the excess ends. The level is found on the sorted source table.
    """
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    # one row per source from here on
    stats = stats.withColumn("source_no", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.col("source_no") % len(WEIGHTS) + F.when(F.col("source_no") % len(WEIGHTS) == 0, len(WEIGHTS)).otherwise(0))
    stats = stats.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(MOST_COPIES))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    later = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)
    stats = stats.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    fitting = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("source_no"), F.col("level").alias("level")))).over(everything)
    stats = stats.withColumn("common", fitting["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("common"), F.col("cap")))
    return stats.select("source", "source_no", "source_size", target.alias("target"), F.ceil(F.col("n") / ROWS_IN_BLOCK).alias("blocks"))


def round_shares(rows: pd.DataFrame, last: bool) -> pd.DataFrame:
    """Move words between pairs of fractional rows until one row is left fractional at most, or none if ``last``.

    The words all rows take together stay the same, and each row's expected share too. Larger rows come first. The
    luck of a step is fixed by the row that it adds.
    """
    rows = rows.sort_values(["size", "luck", "id", "digest"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
    size, share, copies, luck = (rows[c].tolist() for c in ("size", "share", "copies", "luck"))
    held = None
    for i, p in enumerate(share):
        if p is None or p != p:
            continue
        if held is None:
            held = i
            continue
        a, b = held, i
        up = min((1 - share[a]) * size[a], share[b] * size[b])
        down = min(share[a] * size[a], (1 - share[b]) * size[b])
        words = up if luck[b] * (up + down) < down else -down
        gains, loses = share[a] + words / size[a], share[b] - words / size[b]
        held = None
        for j, q in ((a, gains), (b, loses)):
            if q < 1e-9 or q > 1 - 1e-9:
                copies[j] += int(q > 0.5)
                share[j] = None
            else:
                share[j] = q
                held = j if held is None else held
    if last and held is not None:
        copies[held] += int(share[held] >= 0.5)
        share[held] = None
    return rows.assign(copies=copies, share=pd.Series(share, dtype="float64"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per input row: ``(doc_id, size, source_size, target, taken)`` and ``copies``, ``digest``.

    All documents of a source have the same expected number of copies, target over size. Its fraction is rounded in
    blocks of about ``ROWS_IN_BLOCK`` rows; the one fractional row each block leaves goes to the next level of a tree,
    until one is left per source, which is rounded to the nearer side. So a source misses its target by half a
    document at most, and a hot source is spread over many tasks. Luck is a hash of id and text: reruns agree.

    Null or blank text has size 0 and is not taken. A null source is a source of its own, last in order. Null ids and
    repeated rows are documents like others. Other columns are ignored; an empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("id"), F.col(source).cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("digest")
    )
    rows = materialize(rows, "sizes")
    of_source = materialize(targets(rows), "targets")
    state = rows.join(of_source.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    ratio = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + 1e-9)
    part = ratio - whole
    state = state.withColumns(
        {
            "copies": whole.cast("int"),
            "share": F.when(part > 1e-9, part),
            "block": F.pmod(F.xxhash64("digest", "id"), F.col("blocks")),
            "luck": F.pmod(F.xxhash64("id", "digest", F.lit(7)), F.lit(1 << 52)) / float(1 << 52),
        }
    ).select(*[x.split()[0] for x in STATE.split(", ")])
    most = of_source.agg(F.max("blocks")).first()[0] or 0
    done = state.where("share IS NULL")
    state = state.where("share IS NOT NULL")
    while most:
        rounded = state.groupBy("source_no", "block").applyInPandas(
            lambda pdf: round_shares(pdf, bool(pdf["blocks"].iloc[0] <= 1)), STATE
        )
        rounded = materialize(rounded, "rounded")
        done = done.unionByName(rounded.where("share IS NULL"))
        state = rounded.where("share IS NOT NULL")
        state = state.withColumns({"block": F.floor(F.col("block") / ROWS_IN_BLOCK), "blocks": F.ceil(F.col("blocks") / ROWS_IN_BLOCK)})
        most = 0 if most <= 1 else -(-most // ROWS_IN_BLOCK)
    return done.select(
        F.col("id").alias(doc_id), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "digest"
    )


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents that the mix takes, with all columns of ``docs``, each as often as it is taken."""
    names = docs.columns
    key, own, key_, own_, copies, rows, place, n = unused(names, "_id", "_digest", "_of", "_is", "_copies", "_rows", "_at", "_n")
    taken = mix(docs, doc_id, text, source).groupBy(F.col(doc_id).cast("bigint").alias(key_), F.col("digest").alias(own_))
    taken = taken.agg(F.sum("copies").alias(copies), F.count("*").alias(rows)).where(F.col(copies) > 0)
    keyed = docs.withColumns({key: F.col(doc_id).cast("bigint"), own: F.xxhash64(text)})
    met = keyed.join(taken, F.col(key).eqNullSafe(F.col(key_)) & (F.col(own) == F.col(own_)))
    at = F.row_number().over(Window.partitionBy(key, own).orderBy(F.lit(0)))
    share = F.floor(F.col(copies) / F.col(rows)) + F.when(F.col(place) <= F.col(copies) % F.col(rows), 1).otherwise(0)
    met = met.withColumn(place, F.when(F.col(rows) > 1, at).otherwise(1))
    return met.withColumn(n, F.explode(F.array_repeat(F.lit(0), share.cast("int")))).select(*names)
