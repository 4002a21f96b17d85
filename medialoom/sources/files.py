"""File sources and sinks: CSV, JSON lines, JSON arrays and the request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from medialoom.functions.columns import bounded_broadcast, strip
from medialoom.operators.text import caption_lines, parse_flag
from medialoom.session import materialize

CORRUPT = "_corrupt"


def read_csv_trimmed(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header, every cell a stripped string; a missing cell is blank."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    raw = spark.read.schema(schema).csv(path, header=True, enforceSchema=False, encoding="UTF-8", ignoreLeadingWhiteSpace=False)
    return raw.select(*[strip(F.coalesce(c, F.lit(""))).alias(c) for c in columns])


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str, required: str) -> DataFrame:
    """JSON lines; broken lines and rows without ``required`` are dropped."""
    full = f"{schema}, {CORRUPT} string"
    rows = spark.read.schema(full).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    return rows.filter(F.col(CORRUPT).isNull() & (strip(F.coalesce(F.col(required), F.lit(""))) != "")).drop(CORRUPT)


def check_eval_rows(rows: DataFrame) -> DataFrame:
    """Evaluation rows with the first rule each breaks. ``rows(sentence_text, gold, relevance)`` as strings."""
    relevance = F.col("relevance").try_cast("int")
    reason = (
        F.when(F.coalesce(strip(F.col("sentence_text")), F.lit("")) == "", "sentence_text")
        .when(F.col("gold").isNull(), "missing gold")
        .when(parse_flag(F.col("gold")).isNull(), "gold")
        .when(relevance.isNull() | ~relevance.between(0, 3), "relevance")
    )
    return rows.withColumn("reject_reason", reason)


def read_jsonl_strict(spark: SparkSession, path: str, schema: str, fail: bool = True) -> DataFrame:
    """JSON lines that must all be valid.

    With ``fail`` the first broken row stops the job; without it the rows keep their ``reject_reason``.
    """
    full = f"{schema}, {CORRUPT} string"
    rows = spark.read.schema(full).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    checked = check_eval_rows(rows)
    reason = F.when(F.col(CORRUPT).isNotNull(), "not json").otherwise(F.col("reject_reason"))
    checked = checked.withColumn("reject_reason", reason).drop(CORRUPT)
    if not fail:
        return checked
    message = F.concat(F.lit("invalid row: "), F.col("reject_reason"))
    return checked.withColumn("reject_reason", F.when(F.col("reject_reason").isNotNull(), F.raise_error(message)))


def require_rows(df: DataFrame) -> DataFrame:
    """The frame itself; an empty one is an error."""
    if df.isEmpty():
        raise ValueError("no rows in the evaluation set")
    return df


def read_json_array(spark: SparkSession, path: str, schema: str, whole_file: bool = True) -> DataFrame:
    """Files that hold one JSON array of objects each, or one array per line."""
    return spark.read.schema(schema).json(path, multiLine=whole_file)


def read_jsonl_dir(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All JSON-lines files of a folder."""
    return spark.read.schema(schema).option("pathGlobFilter", "*.json*").json(path)


def read_caption_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_index, line_text)``: the caption lines of every file at ``path``, numbered in file order.

    Files are read in splits, a line whole in one of them, so no file has to be one row or fit into a task. A line's number is
    the number of lines that the file's earlier splits hold, which is a small table, and its place in its own split. Markup
    that goes on over a line's end stays.
    """
    at = ["file", "block"]
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("read"),  # grows with the place within a split
        F.col("value").alias("text"),
    )
    kept = materialize(caption_lines(lines, "text").withColumnRenamed("line_index", "part"), "captions")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = kept.groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
    starts = blocks.select(*at, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy(*at).orderBy("read", "part"))
    numbered = kept.withColumn("place", place).join(bounded_broadcast(starts), at)
    return numbered.select("file", (F.col("start") + F.col("place") - 1).alias("line_index"), "line_text")


def write_jsonl(df: DataFrame, path: str, append: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """Relational table read in ``parts`` ranges of a numeric key; filters are pushed to the database."""
    return spark.read.jdbc(
        url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options
    )


def recent_requests(log: DataFrame, since: Column, limit: int) -> DataFrame:
    """Newest log rows since a time with their sentence list decoded; blanks dropped."""
    listed = F.coalesce(F.from_json("sentences_json", "array<string>"), F.array().cast("array<string>"))
    kept = F.filter(listed, lambda s: s.isNotNull() & (strip(s) != ""))
    rows = log.filter(F.col("created_at") >= since).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)
    return rows.withColumn("sentences", F.transform(kept, lambda s: F.struct(s.alias("sentence_text")))).drop("sentences_json")


def request_payload(df: DataFrame, sentences: str) -> DataFrame:
    """Sentences stripped, blanks dropped, counted and encoded."""
    clean = F.filter(F.transform(F.col(sentences), strip), lambda s: s.isNotNull() & (s != ""))
    return df.withColumn(sentences, clean).withColumns(
        {"sentence_count": F.size(sentences), "sentences_json": F.to_json(sentences)}
    ).drop(sentences)


def sync_analysis(videos: DataFrame, results: DataFrame) -> DataFrame:
    """Analysis rows joined onto graph videos; videos without a row are reported as missing."""
    rows = results.filter(F.col("target_type") == "VIDEO").select(
        "target_id", F.coalesce("overall_bias_score", F.lit(0.0)).alias("overall_bias_score"), F.coalesce("opinion_score", F.lit(0.0)).alias("opinion_score"), F.lit("synced").alias("state")
    )
    joined = videos.select("video_id", "target_id").join(rows, "target_id", "left")
    return joined.withColumn("state", F.coalesce("state", F.lit("missing")))


def graph_stats(nodes: DataFrame, edges: DataFrame, n: int = 30) -> DataFrame:
    """Rows per node label and the ``n`` most frequent relationship types."""
    labels = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), F.col("label").alias("name"), "n")
    rels = edges.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "rel_type").limit(n)
    return labels.unionByName(rels.select(F.lit("edge").alias("kind"), F.col("rel_type").alias("name"), "n"))


def vector_table(rows: DataFrame, path: str) -> DataFrame:
    """Unit vectors with their payload columns, replacing the table at ``path``."""
    from medialoom.functions.vectors import unit

    rows.withColumn("vec", unit(F.col("vec"))).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def vector_table_stats(table: DataFrame) -> DataFrame:
    return table.agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.size("vec")).alias("min_width"), F.max(F.size("vec")).alias("max_width"), F.min("id").alias("sample_id")
    )
