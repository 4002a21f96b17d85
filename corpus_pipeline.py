"""Training corpus from raw documents: language, repeated lines, near duplicates, source mix, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medialoom.functions.columns import bounded_broadcast
from medialoom.llm.common import WORD, unused
from medialoom.llm.jaccard_join import jaccard_components
from medialoom.llm.language import UNKNOWN, held_out, predict_language
from medialoom.llm.line_dedup import dedup_lines
from medialoom.llm.mixing import mixed_documents
from medialoom.llm.packing import pack
from medialoom.session import materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, with the predicted one in ``lang``; those without text or without a letter go.

    A document goes too if its score is below the least that a labelled document outside the learned rows has for its own
    language, so none of those does. Without any to measure, or without a model, letters alone decide, and without a model
    ``lang`` stays as it is.
    """
    found = materialize(predict_language(docs), "predicted")
    own = held_out("doc_id") & (F.col("lang_pred") == F.col("lang"))
    seen = found.agg(F.min(F.when(own, F.col("score"))).alias("least"), F.max(F.col("lang_pred") != UNKNOWN).alias("learned")).first()
    if not seen["learned"]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    fine = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= (seen["least"] or 0.0))
    return found.where(fine).withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has are deleted; documents that lose all their words go."""
    left = dedup_lines(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    counted = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", counted).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar five-word shingles the smallest id stays.

    Every row is judged by its own text: where rows share an id but not the text, the text of smallest hash goes by the id
    and the others by numbers of their own, from 2^62 on. Rows of equal id and text are one. Documents without an id or
    without words stay as they are.
    """
    own, least, key, place = unused(docs.columns, "_own", "_least", "_key", "_place")
    judged = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    rows = docs.where(judged).withColumn(own, F.xxhash64("text"))
    several = rows.groupBy("doc_id").agg(F.min(own).alias(least), F.max(own).alias("most")).where(F.col(least) < F.col("most"))
    several = bounded_broadcast(materialize(several.drop("most"), "several"))
    number = F.when(F.col(least) < F.col(own), F.xxhash64("doc_id", own).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62))
    rows = rows.join(several, "doc_id", "left").withColumn(key, F.coalesce(number, F.col("doc_id").cast("bigint")))
    groups = jaccard_components(rows.select(F.col(key).alias("doc_id"), "text"))
    first = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(key)).distinct()
    at = F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))
    stay = rows.join(first, key, "left_semi").withColumn(place, at).where(F.col(place) == 1).select(*docs.columns)
    return stay.unionByName(docs.where(~judged))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in the sequences."""
    return pack(docs)


STAGES = [
    ("language", known_language),
    ("lines", without_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("mix", mixed),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
