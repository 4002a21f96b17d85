"""Language identification with string kernels: Nystroem landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medialoom.functions.columns import bounded_broadcast
from medialoom.llm.common import map_slices
from medialoom.session import materialize

ROWS_PER_LANGUAGE = 600
LANDMARKS_PER_LANGUAGE = 64
GRAM_BITS = 13
LONGEST_GRAM = 3
RIDGE = 1e-2
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str | None, out: np.ndarray) -> bool:
    """Mark the hash slots of the n-grams present in the whole text; false if it has no letter.

    Letters are lower-cased, anything else counts as one blank character each.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return False
    c = np.where(is_letter, points, 32).astype(np.uint64)
    h = np.zeros(len(c), np.uint64)
    for n in range(1, LONGEST_GRAM + 1):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] * np.uint64(1_000_003) + c[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        out[(h >> np.uint64(64 - GRAM_BITS)).astype(np.int64)] = 1
    return True


def presence(texts) -> tuple[np.ndarray, np.ndarray]:
    """Rows of n-gram presence scaled to length one, and which texts have a letter."""
    x = np.zeros((len(texts), 1 << GRAM_BITS), np.float32)
    known = np.fromiter((grams(t.as_py(), row) for t, row in zip(texts, x, strict=True)), bool, len(texts))
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1)), known


class Model:
    """Languages, landmark rows and the weights of each language on kernel values with the landmarks."""

    def __init__(self, x: np.ndarray, langs: list[str], is_landmark: np.ndarray):
        self.languages = sorted(set(langs))
        self.landmarks = x[is_landmark]
        gram = (self.landmarks @ self.landmarks.T).astype(np.float64)
        values, vectors = np.linalg.eigh(gram)
        keep = values > 1e-6
        root = vectors[:, keep] / np.sqrt(values[keep])
        z = np.hstack([(x @ self.landmarks.T) @ root, np.ones((len(x), 1))])
        y = np.where(np.array(langs)[:, None] == np.array(self.languages)[None], 1.0, -1.0)
        w = np.linalg.solve(z.T @ z + RIDGE * np.eye(z.shape[1]), z.T @ y)
        self.weights, self.bias = (root @ w[:-1]).astype(np.float32), w[-1]

    def predict(self, texts) -> tuple[list[str], list[float]]:
        x, known = presence(texts)
        values = (x @ self.landmarks.T) @ self.weights + self.bias
        best = values.argmax(axis=1)
        score = np.clip((values[np.arange(len(best)), best] + 1) / 2, 0, 1)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0).tolist()


def held_out(doc_id: str) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, doc_id: str, text: str, lang: str) -> Model | None:
    """Fit on at most ``ROWS_PER_LANGUAGE`` distinct texts of each language, chosen by a hash; the first of them are landmarks."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    rows = rows.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).withColumn("key", F.xxhash64("text"))
    # hashes below a share of each language's distinct texts leave about three times the texts wanted, whatever the input
    sizes = materialize(rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")), "languages")
    low = F.pmod("key", F.lit(1 << 40)) / float(1 << 40) * F.col("n") <= 3.0 * ROWS_PER_LANGUAGE
    keys = rows.select("lang", "key").join(bounded_broadcast(sizes), "lang").where(low).select("lang", "key").distinct()
    order = Window.partitionBy("lang").orderBy("key")
    keys = materialize(keys.withColumn("at", F.row_number().over(order)).where(F.col("at") <= ROWS_PER_LANGUAGE), "keys")
    sample = rows.join(bounded_broadcast(keys), ["lang", "key"]).dropDuplicates(["lang", "key"])

    def pack(cols: dict) -> dict:
        x = np.zeros((len(cols["text"]), 1 << GRAM_BITS), np.uint8)
        known = [grams(t.as_py(), row) for t, row in zip(cols["text"], x, strict=True)]
        mask = pa.array(known, pa.bool_())
        bits = pa.array([row.tobytes() for row in np.packbits(x, axis=1)], pa.binary())
        return {"lang": cols["lang"].filter(mask), "at": cols["at"].filter(mask), "bits": bits.filter(mask)}

    found = map_slices(sample.select("lang", "at", "text"), pack, "lang string, at int, bits binary").orderBy("lang", "at").collect()
    if not found:
        return None
    x = np.unpackbits(np.stack([np.frombuffer(r["bits"], np.uint8) for r in found]), axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    return Model(x, [r["lang"] for r in found], np.array([r["at"] <= LANDMARKS_PER_LANGUAGE for r in found]))


def predict_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred`` and ``score`` (0 to 1).

    The features are the n-grams of one to three characters present in the whole text. Learns only from rows with
    text and language outside the held-out third; predictions see the text alone. Null texts and texts without a
    letter give ``und`` and 0, as does everything if there is nothing to learn from. A null id is not learned from.
    Ties go to the first language by name. Columns named ``lang_pred`` or ``score`` are replaced. Repeated rows get equal
    results; an empty table gives an empty result.
    """
    model = fit(docs, doc_id, text, lang)
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})

    def predict(batches):
        for batch in batches:
            at = batch.schema.names.index(text)
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                names, scores = model.predict(part.column(at).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang_pred", "score"]
                )

    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(predict, schema)


def language_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row; see ``predict_language``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    out = predict_language(rows)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
