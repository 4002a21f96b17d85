"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, reranking with the vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialoom.llm.common import bounded_sample, map_slices, usable
from medialoom.llm.components import connected_components
from medialoom.session import materialize

BITS = 64
CHUNKS = (16, 12, 10, 8, 6, 4)  # bits per table, tried in this order
SAMPLE_ROWS = 20_000
ROUNDS = 30
TRIAL_ROWS, TRIAL_LINKS, TRIAL_RECALL = 2_000, 200, 0.99


def padded(column: pa.Array, width: int) -> np.ndarray:
    """List column as unit rows of doubles; shorter lists are filled with zeros."""
    sizes = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, int)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), sizes), np.concatenate([np.arange(s) for s in sizes] or [[]]).astype(int)] = (
        np.asarray(column.flatten(), dtype=np.float64)
    )
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def fit_rotation(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Projection and thresholds of ``BITS`` bits: principal axes, rotated so that signs fit best, each bit split at its
    median. Vectors of fewer dimensions get several rotations."""
    mean = x.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov((x - mean).T).reshape(x.shape[1], -1) if len(x) > 1 else np.eye(x.shape[1]))
    axes = axes[:, ::-1][:, :BITS]
    v = (x - mean) @ axes
    random, parts = np.random.default_rng(0), []
    while sum(p.shape[1] for p in parts) < BITS:
        turn, _ = np.linalg.qr(random.standard_normal((v.shape[1], v.shape[1])))
        for _ in range(ROUNDS):
            z = v @ turn
            u, _, w = np.linalg.svd(np.where(z >= 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        parts.append(axes @ turn)
    projection = np.concatenate(parts, axis=1)[:, :BITS]
    return projection, np.median(x @ projection, axis=0)


def links_of_sample(x: np.ndarray, labels: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of the sample's first ``TRIAL_ROWS`` rows with all; if they are few, these rows and the same rows turned
    by the angle of ``cosine`` in any direction."""
    pairs = []
    for at in range(0, min(len(x), TRIAL_ROWS), 250):
        i, j = np.nonzero((x[at : at + 250] @ x.T >= cosine) & (labels[at : at + 250, None] == labels[None, :]))
        keep = i + at < j
        pairs.append(np.stack([i + at, j], 1)[keep][:20_000])
    found = np.concatenate(pairs)
    if len(found) >= TRIAL_LINKS:
        return x[found[:, 0]], x[found[:, 1]]
    near = x[:TRIAL_ROWS]
    aside = np.random.default_rng(1).standard_normal(near.shape)
    aside -= np.einsum("ij,ij->i", aside, near)[:, None] * near
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-300)
    return near, cosine * near + np.sqrt(max(0.0, 1 - cosine**2)) * aside


def plan_tables(differ: np.ndarray) -> tuple[int, int]:
    """``(chunk, radius)`` from the bits in which linked pairs differ: the widest chunk whose tables find ``TRIAL_RECALL`` of
    the pairs (two bits apart in some chunk at most), and how many bits all but a thousandth of the pairs differ in."""
    radius = max(20, int(np.quantile(differ.sum(axis=1), 0.999)) + 2)
    for chunk in CHUNKS:
        tables = BITS // chunk
        apart = differ[:, : tables * chunk].reshape(len(differ), tables, chunk).sum(axis=2)
        if (apart.min(axis=1) <= 2).mean() >= TRIAL_RECALL:
            break
    return chunk, radius


def embedding_links(vectors: DataFrame, vec_id: str, embedding: str, label: str, cosine: float) -> tuple[DataFrame, DataFrame]:
    """``(classes, links)``: distinct vectors of a label ``(label, h1, h2, cid, rep, copies)``, where ``cid`` is a hash of the
    class and ``rep`` its smallest id, and linked pairs ``(a, b)`` of classes. See ``embedding_components``."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).alias("v"), F.col(label).alias("label"))
    rows = rows.where(usable("v") & F.col("label").isNotNull() & F.col("id").isNotNull())
    keyed = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")})
    classes = keyed.groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("cid", F.xxhash64("label", "h1", "h2")), "classes")
    reps = keyed.join(classes.select("label", "h1", "h2", "cid", F.col("rep").alias("id")), ["label", "h1", "h2", "id"])
    reps = reps.dropDuplicates(["cid"]).select(F.col("cid").alias("id"), "label", "v")
    width = reps.agg(F.max(F.size("v"))).first()[0]
    sample = bounded_sample(reps.select("id", F.xxhash64("label").alias("label"), "v"), "id", SAMPLE_ROWS).toArrow() if width else []
    if len(sample) < 1:
        return classes, classes.selectExpr("cid AS a", "cid AS b").where("false")
    x = padded(sample["v"].combine_chunks(), width)
    projection, cut = fit_rotation(x)
    one, other = links_of_sample(x, sample["label"].to_numpy(), cosine)
    chunk, radius = plan_tables((one @ projection > cut) != (other @ projection > cut))
    tables = BITS // chunk
    weights = (np.uint64(1) << np.arange(BITS, dtype=np.uint64)).astype(np.uint64)

    def encode(cols: dict) -> dict:
        bits = padded(cols["v"], width) @ projection > cut
        code = (bits * weights).sum(axis=1, dtype=np.uint64).view(np.int64)
        return {"id": cols["id"], "label": cols["label"], "v": cols["v"], "code": pa.array(code)}

    fields = {f.name: f.dataType.simpleString() for f in reps.schema}
    coded = materialize(
        map_slices(reps, encode, f"id bigint, label {fields['label']}, v {fields['v']}, code bigint"), "codes"
    )
    flips = F.array(*[F.lit(x) for x in [0, *(1 << i for i in range(chunk))]])
    probes = (
        coded.select("id", "label", F.size("v").alias("dim"), "code", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("t"))
        .withColumn("chunk", F.expr(f"shiftrightunsigned(code, t * {chunk}) & {(1 << chunk) - 1}").cast("int"))
        .withColumn("flip", F.explode(flips))
        .select("label", "dim", "t", F.col("chunk").bitwiseXOR(F.col("flip")).alias("key"), "id", "code", "flip")
    )
    x, y = probes.alias("x"), probes.alias("y")
    diff = F.col("x.code").bitwiseXOR(F.col("y.code"))
    part = lambda i: F.bit_count(F.shiftrightunsigned(diff, i * chunk).bitwiseAND((1 << chunk) - 1))
    first = F.lit(False)
    for i in range(tables):
        here = F.col("x.t") == i
        for j in range(i):
            here &= part(j) > 2
        flips_met = ((part(i) <= 1) & (F.col("x.flip") == 0)) | (
            (part(i) == 2) & (F.col("x.flip") != 0) & (F.col("x.flip") < F.col("y.flip"))
        )
        first |= here & flips_met
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("label", "dim", "t", "key")]
    pairs = x.join(y, same[0] & same[1] & same[2] & same[3] & (F.col("x.id") < F.col("y.id")) & (F.bit_count(diff) <= radius) & first)
    pairs = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.label").alias("label"))

    def rerank(cols: dict) -> dict:
        near = np.einsum("ij,ij->i", padded(cols["va"], width), padded(cols["vb"], width)) >= cosine
        return {c: cols[c].filter(pa.array(near)) for c in "ab"}

    va, vb = (coded.select(F.col("id").alias(c), "label", F.col("v").alias(f"v{c}")) for c in "ab")
    links = map_slices(pairs.join(va, ["a", "label"]).join(vb, ["b", "label"]).select("a", "b", "va", "vb"), rerank, "a bigint, b bigint")
    return classes, materialize(links, "links")


def embedding_components(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.93
) -> DataFrame:
    """One row per input row: ``(vec_id, n_links, component_id, kept)``.

    Vectors of equal, non-null label link when their cosine in double precision is at least ``cosine``. Equal vectors of
    a label are one class; a rotation learned by iterative quantisation on about ``SAMPLE_ROWS`` rows gives every class
    64 balanced bits. Classes that differ in at most two bits of some chunk (each table holds every code under its own chunk
    and all chunks one bit away, so two codes meet two bits apart) are compared by their vectors, each pair once. Chunks
    have 16 bits, or fewer if links of the sample ask for it: where all vectors share a direction, codes of linked vectors
    differ in many bits. The same links give the number of bits beyond which no pair is compared, 20 at least.

    Null, empty or zero vectors, those with null or non-finite components, null labels and null ids link with nothing.
    Vectors of unequal length never link. Repeated rows link with each other; rows that share an id but not the vector or
    the label are linked by what they hold. Other columns are ignored; an empty
    table gives an empty result.
    """
    classes, links = embedding_links(vectors, vec_id, embedding, label, cosine)
    size_of = classes.select(F.col("cid").alias("id"), "copies")
    ends = links.select(F.col("a").alias("cid"), F.col("b").alias("id")).unionByName(links.select(F.col("b").alias("cid"), F.col("a").alias("id")))
    others = ends.join(size_of, "id").groupBy("cid").agg(F.sum("copies").alias("others"))
    comps = materialize(connected_components(links, "a", "b").select(F.col("id").alias("cid"), F.col("component").alias("of")), "components")
    first = comps.join(classes.select("cid", "rep"), "cid").groupBy("of").agg(F.min("rep").alias("component"))
    of_class = classes.join(others, "cid", "left").join(comps.join(first, "of"), "cid", "left").select(
        "label", "h1", "h2",
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n"),
        F.coalesce("component", "rep").alias("component"),
    )
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).alias("v"), F.col(label).alias("label"))
    part = usable("v") & F.col("id").isNotNull()
    rows = rows.select("id", F.when(part, F.col("label")).alias("label"), F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"))
    out = rows.join(of_class, ["label", "h1", "h2"], "left")
    return out.select(
        F.col("id").alias(vec_id),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        (F.col("id") == F.coalesce("component", "id")).alias("kept"),
    )
