"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialoom.functions.columns import bounded_broadcast
from medialoom.llm.common import WordHashes, map_slices, shingle_set, words_of
from medialoom.llm.components import connected_components
from medialoom.session import materialize

SLOT_BITS = 20
BLOCKS = 64
FAN_IN = 64
BITMAP_WORDS = 16
SETS_AT_ONCE = 32


def slot_counts(texts: DataFrame, k: int) -> np.ndarray:
    """How often the shingles of each of 2**SLOT_BITS hash slots occur in all documents.

    A task counts its own rows; the counts are then summed block by block in a tree of bounded fan-in. The size of
    the result is fixed, whatever the input.
    """
    slots, width = 1 << SLOT_BITS, (1 << SLOT_BITS) // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hashes = np.zeros(slots, np.int64), WordHashes()
        for batch in batches:
            for text in batch.column(0):
                found = shingle_set(text.as_py(), k, hashes) >> np.uint64(64 - SLOT_BITS)
                np.add.at(total, found.astype(np.int64), 1)
        yield pa.RecordBatch.from_pydict(
            {
                "block": pa.array(range(BLOCKS), pa.int32()),
                "part": pa.array([TaskContext.get().partitionId()] * BLOCKS, pa.int64()),
                "counts": pa.array([total[i * width : (i + 1) * width].tobytes() for i in range(BLOCKS)], pa.binary()),
            }
        )

    def add(pdf):
        total = np.sum([np.frombuffer(c, np.int64) for c in pdf["counts"]], axis=0)
        return pdf.head(1)[["block", "part"]].assign(part=pdf["part"].iloc[0] // FAN_IN, counts=total.tobytes())

    schema = "block int, part bigint, counts binary"
    parts, left = texts.mapInArrow(count, schema), texts.rdd.getNumPartitions()
    while True:
        parts = parts.groupBy("block", F.floor(F.col("part") / FAN_IN)).applyInPandas(
            lambda key, pdf: add(pdf), schema
        )
        left = -(-left // FAN_IN)
        if left <= 1:
            break
    blocks = {r["block"]: np.frombuffer(r["counts"], np.int64) for r in parts.collect()}
    return np.concatenate([blocks[b] if b in blocks else np.zeros(width, np.int64) for b in range(BLOCKS)])


def prefix_length(n: int, percent: int) -> int:
    """Two sets of the wanted similarity share a shingle among the first so many of either."""
    return n - -(-percent * n // 100) + 1


def prefixes(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, counts: np.ndarray) -> DataFrame:
    """Per document: set size, set digest, parity bitmap, and the rarest shingles in the global order."""
    counts = counts.astype(np.int64)

    def describe(cols: dict) -> dict:
        hashes = describe.__dict__.setdefault("hashes", WordHashes())
        n, s1, s2, maps, pre = [], [], [], [], []
        for text in cols["text"]:
            found = shingle_set(text.as_py(), k, hashes)
            size = len(found)
            order = np.lexsort((found, counts[(found >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]))
            digest = xxhash.xxh3_128_digest(found.tobytes())
            bits = np.bincount((found & np.uint64(64 * BITMAP_WORDS - 1)).astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
            n.append(size)
            s1.append(int.from_bytes(digest[:8], "little", signed=True))
            s2.append(int.from_bytes(digest[8:], "little", signed=True))
            maps.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
            pre.append(found[order[: prefix_length(size, percent) if size else 0]].view(np.int64))
        return {
            "id": cols["id"],
            "n": pa.array(n, pa.int64()),
            "s1": pa.array(s1, pa.int64()),
            "s2": pa.array(s2, pa.int64()),
            "bitmap": pa.array(maps, pa.list_(pa.int64())),
            "prefix": pa.array(pre, pa.list_(pa.int64())),
        }

    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_slices(texts, describe, "id bigint, n bigint, s1 bigint, s2 bigint, bitmap array<bigint>, prefix array<bigint>")


def may_link(percent: int, n_a: str, n_b: str, pos_a: str, pos_b: str):
    """Length filter, and positional filter: what the sets can still share if they meet at these positions."""
    a, b, p, q = F.col(n_a), F.col(n_b), F.col(pos_a), F.col(pos_b)
    length = F.least(a, b) * 100 >= F.greatest(a, b) * percent
    most = F.least(p, q) + 1 + F.least(a - p - 1, b - q - 1)
    return length & (most * (100 + percent) >= (a + b) * percent)


def bitmaps_near(percent: int, n_a: str, n_b: str, bits_a: str, bits_b: str):
    """Suffix filter on sets partitioned by hash: sets whose parities differ in d parts differ in d shingles at least.

    A null bitmap rules nothing out.
    """
    both = F.col(n_a) + F.col(n_b)
    parts = [F.coalesce(F.get(bits_a, F.lit(i)).bitwiseXOR(F.get(bits_b, F.lit(i))), F.lit(0)) for i in range(BITMAP_WORDS)]
    return (both - sum((F.bit_count(x) for x in parts), F.lit(0))) * (100 + percent) >= both * 2 * percent


def verified(near: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """Those of the distinct pairs ``(a, b)`` whose sets reach the similarity. Each pair is looked at once.

    Only the documents of the pairs are looked at again. Their compressed words travel, a fraction of the sets' size, and
    the sets are built where a pair is compared.
    """
    wanted = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct()
    wanted = bounded_broadcast(materialize(wanted, "wanted"), 1_000_000)  # counted; beyond that a shuffle join
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def squeeze(cols: dict) -> dict:
        packed = [zlib.compress(b" ".join(words_of(t.as_py())), 6) for t in cols["text"]]
        return {"id": cols["id"], "words": pa.array(packed, pa.binary())}

    words = materialize(map_slices(texts.join(wanted, "id"), squeeze, "id bigint, words binary"), "words")

    def compare(cols: dict) -> dict:
        hashes, keep = compare.__dict__.setdefault("hashes", WordHashes()), []
        sets = lru_cache(SETS_AT_ONCE)(lambda packed: shingle_set(zlib.decompress(packed).decode(), k, hashes))
        for x, y in zip(cols["wa"], cols["wb"], strict=True):
            x, y = sets(x.as_py()), sets(y.as_py())
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
        mask = pa.array(keep, pa.bool_())
        return {c: cols[c].filter(mask) for c in "ab"}

    first, second = (words.select(F.col("id").alias(x), F.col("words").alias(f"w{x}")) for x in "ab")
    return map_slices(near.join(first, "a").join(second, "b"), compare, "a bigint, b bigint").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``(id_col, n_shingles, component_id)``.

    Two documents link when the Jaccard similarity of their sets of k-word shingles is at least ``percent`` percent.
    Documents with equal sets are one class, represented by its smallest id, so exact copies cost one row each.
    Classes that share one of their rarest shingles, of sizes that allow it, are candidates. They are first compared with the smallest class
    that has the shingle; what that links falls together. Shingles whose classes are then all in one component are
    done; for the others every pair of classes in different components is compared. So no link that could join two
    components is lost, and a large group of near copies does not expand into its pairs.

    Null or blank text: no shingles, linked with nothing. A null id keeps its row with a null component. Rows that
    repeat an id are judged by their own text. Other columns are ignored. Empty input gives an empty result.
    """
    counts = slot_counts(docs.select(F.col(text_col).cast("string").alias("text")), k)
    meta = materialize(prefixes(docs, id_col, text_col, k, percent, counts), "prefixes")
    live = meta.where("n > 0 AND id IS NOT NULL")
    classes = materialize(live.groupBy("s1", "s2").agg(F.min("id").alias("rep")), "classes")
    reps = live.join(classes.withColumnRenamed("rep", "id"), ["s1", "s2", "id"], "left_semi").select("id", "n", "bitmap", "prefix")
    reps = materialize(reps, "reps")
    posting = reps.select("id", "n", F.posexplode("prefix").alias("pos", "key"))
    known = posting.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
    known = materialize(known, "keys")  # joins with written tables can be split at hot keys
    shared = materialize(posting.join(known, "key"), "postings")
    # an id that stands for several texts has no bitmap of its own
    bitmaps = reps.groupBy("id").agg(F.first("bitmap").alias("bitmap"), F.count("*").alias("texts"))
    bitmaps = bitmaps.select("id", F.when(F.col("texts") == 1, F.col("bitmap")).alias("bitmap"))
    width = math.log(100 / percent) * 1.000001
    shared = shared.withColumn("home", F.floor(F.log("n") / width)).withColumn("step", F.explode(F.array(F.lit(0), F.lit(1))))
    shared = shared.select("key", (F.col("home") + F.col("step")).alias("size"), F.struct("id", "step", "n", "pos").alias("x"))
    lead = shared.groupBy("key", "size").agg(F.min("x").alias("lead"), F.max("x.id").alias("last"), F.min("x.step").alias("least"))
    lead = materialize(lead.where("lead.id < last AND least = 0").select("key", "size", "lead"), "leads")
    shared = materialize(shared.join(lead, ["key", "size"]).where("x != lead"), "postings")
    near = bitmaps_near(percent, "na", "nb", "ma", "mb")
    args = (docs, id_col, text_col, k, percent)

    def fits(a: str, b: str):
        sizes = may_link(percent, f"{a}.n", f"{b}.n", f"{a}.pos", f"{b}.pos")
        return (F.col(f"{a}.id") < F.col(f"{b}.id")) & sizes & (F.col(f"{a}.step") + F.col(f"{b}.step") < 2)

    ends = [F.col(f"{x}.{c}").alias(to) for x, i in (("lead", "a"), ("x", "b")) for c, to in (("id", i), ("n", f"n{i}"))]
    star = shared.where(fits("lead", "x")).select(*ends).distinct()
    both = [bitmaps.select(F.col("id").alias(x), F.col("bitmap").alias(f"m{x}")) for x in "ab"]
    star = materialize(star.join(both[0], "a").join(both[1], "b").where(near).select("a", "b"), "pairs")
    links = materialize(verified(star, *args), "links")
    comps = materialize(connected_components(links, "a", "b"), "components")

    # every pair with a lead has been compared; what is left of a key matters if it lies in several components
    named = shared.select("key", "size", "x", F.col("x.id").alias("id")).join(comps, "id", "left")
    named = materialize(named.withColumn("component", F.coalesce("component", "id")), "postings")
    several = named.groupBy("key", "size").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key", "size")
    rest = named.join(materialize(several, "keys"), ["key", "size"])
    rest = materialize(rest.join(bitmaps, "id").select("key", "size", "x", "component", "bitmap"), "rest")
    met = (F.col("l.key") == F.col("r.key")) & (F.col("l.size") == F.col("r.size")) & (F.col("l.component") != F.col("r.component"))
    met &= fits("l.x", "r.x") & bitmaps_near(percent, "l.x.n", "r.x.n", "l.bitmap", "r.bitmap")
    cross = rest.alias("l").join(rest.alias("r"), met).select(F.col("l.x.id").alias("a"), F.col("r.x.id").alias("b")).distinct()
    cross = materialize(cross.join(star, ["a", "b"], "left_anti"), "pairs")
    # the stars of the first search stand for its links
    links = comps.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(verified(cross, *args))
    comps = materialize(connected_components(links, "a", "b"), "components")

    of_class = classes.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select(
        "s1", "s2", F.coalesce("component", "rep").alias("component")
    )
    out = meta.select("id", "n", "s1", "s2").join(of_class, ["s1", "s2"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component_id"),
    )
