"""Domain views over the star-schema and text tables.

Each view is a lazy DataFrame; column pruning and filters reach the parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialoom.functions.columns import let, round4, strip, tokens
from medialoom.functions.lexemes import LANGUAGE_COUNTRY, TAG_SUFFIXES
from medialoom.operators import text as text_ops
from medialoom.session import materialize

# Fixed value: bytes of text that one task takes apart into words it counts.
PART_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table, spread over all cores when its files give fewer splits than that.

    Splitting and matching text is heavy per row, so a small table read as one split is dealt out first. At
    scale the scan has more splits than cores and nothing is added to the plan.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_parts(df: DataFrame, text: str) -> int:
    """As many parts as keep one below ``PART_BYTES`` of text on average."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def partitioned_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Texts shuffled once by ``key``, into as many parts as keep one below ``PART_BYTES`` of text on average.

    What is grouped by the key afterwards, word by word, then needs no shuffle, and its tables per task stay the same size
    however large the input is.
    """
    return df.repartition(text_parts(df, text), key)


# --- text ------------------------------------------------------------------------------------------


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    country = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in LANGUAGE_COUNTRY.items()])
    return text_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("target_id"),
        strip(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"),
        F.col("text").alias("raw_text"),
        F.col("lang").alias("language"),
        country.alias("country"),
        F.col("source").alias("channel"),
    )


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = articles(spark, sf_dir).select(F.col("target_id").alias("doc_id"), "language", "raw_text")
    return text_ops.split_sentences(docs, "raw_text")


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = articles(spark, sf_dir).select(F.col("target_id").alias("doc_id"), "language", "raw_text")
    return text_ops.prepared_sentences(docs, "raw_text")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    from medialoom.operators import tagging

    return tagging.classify_by_rule(prepared(spark, sf_dir))


def classified_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``classified`` in partitions of whole documents, for counts per document."""
    from medialoom.operators import tagging

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"), F.col("text").alias("raw_text"))
    return tagging.classify_by_rule(text_ops.prepared_sentences(partitioned_texts(docs, "doc_id", "raw_text"), "raw_text"))


def tag_of(form: Column) -> Column:
    """Part of speech of a plain word by the default rules; byte comparisons, no regex on the usual path."""
    digits = form.between("0", ":") & form.rlike("^[0-9]+$")
    chain = F.when(form.isNull(), F.lit(None).cast("string")).when(digits, "SN")
    chain = chain.when((form >= "A") & (form < "["), "NNP")
    for suffix, tag in TAG_SUFFIXES:
        chain = chain.when(form.endswith(suffix), tag)
    return chain.otherwise("NNG")


def word_rows(labelled: DataFrame) -> DataFrame:
    """One row per token of each sentence, without offsets; stays in the JVM.

    Tags are set before the explode: a later filter then cannot make the optimizer tag a word twice.
    """
    tagged = F.transform(tokens(F.col("sentence_text")), lambda f: F.struct(f.alias("form"), tag_of(f).alias("tag")))
    keep = [c for c in labelled.columns if c != "sentence_text"]
    rows = labelled.select(*keep, F.posexplode(tagged).alias("token_index", "_t"))
    return rows.select(*keep, "token_index", F.col("_t.form").alias("form"), F.col("_t.tag").alias("tag"))


def keywords_in(labelled: DataFrame, keyword: Callable[[Column, Column], Column]) -> DataFrame:
    """One row per token that has a ``keyword(form, tag)``, which is made once and within the row.

    The optimizer moves filters below a projection and would make the keyword anew in each; it moves none below an explode.
    """
    words = F.transform(tokens(F.col("sentence_text")), lambda f: let(tag_of(f), lambda t: keyword(f, t)))
    keep = [c for c in labelled.columns if c != "sentence_text"]
    return labelled.select(*keep, F.explode(F.array_compact(words)).alias("keyword"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emotion dictionary: the distinct lower-case words of the reference passages."""
    words = (
        table(spark, sf_dir, "benchmark")
        .select(F.explode(tokens(F.lower("text"))).alias("word"))
        .distinct()
    )
    size = F.length("word")
    sign = F.when(size % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    return words.select(
        "word",
        F.col("word").alias("embed_text"),
        F.when(F.col("word").endswith("ing"), F.concat("word", F.lit("다")))
        .otherwise(F.col("word"))
        .alias("clean_seed"),
        (sign * F.when(size >= 8, F.lit(2)).otherwise(F.lit(1))).cast("int").alias("polarity"),
        F.when(size % 3 == 0, F.lit("DIRECT_EMOTION"))
        .when(sign < 0, F.lit("NEGATIVE_STATE"))
        .otherwise(F.lit("EVALUATIVE_WORD"))
        .alias("category"),
        ((size % 5 + 5) / 10.0).cast("decimal(10,4)").alias("score_hint"),
    )


def lexicon_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emotion spans by exact dictionary match on the words of opinion sentences."""
    from medialoom.operators import tagging

    words = word_rows(classified(spark, sf_dir).filter(F.col("label") == "opinion_like"))
    return tagging.dictionary_spans(words, lexicon(spark, sf_dir))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review decisions as (section, item): short words of the reference passages, some as objects."""
    w, size = F.col("word"), F.length("word")
    return lexicon(spark, sf_dir).filter(size <= 4).select(
        F.when(size == 2, "block_confirmed")
        .when((size == 3) & w.startswith("t"), "review_promoted_from_added_data")
        .when((size == 3) & w.endswith("n"), "auto_review_blocked")
        .when(size == 3, "keep_confirmed")
        .otherwise("review_pending")
        .alias("section"),
        F.when(size == 3, F.concat(F.lit('{"surface": " '), w, F.lit('", "reason": "short"}')))
        .otherwise(F.concat(F.lit(" "), w))
        .alias("item"),
    )


def blocked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from medialoom.operators import tagging

    return tagging.blocklist(decisions(spark, sf_dir))


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opinion sentences with label scores counted from their text, gated."""
    from medialoom.operators import tagging

    t = F.col("sentence_text")
    scores = F.create_map(
        F.lit("화남/분노"), F.least(F.lit(1.0), F.regexp_count(t, F.lit("!")) / 2.0),
        F.lit("의심/불신"), F.least(F.lit(1.0), F.regexp_count(t, F.lit("[?]")) / 2.0),
        F.lit("기쁨"), (F.length(t) % 10) / 10.0,
        F.lit("행복"), (F.length(t) % 7) / 10.0,
        F.lit("없음"), F.lit(0.1),
    )
    opinions = classified(spark, sf_dir).filter(F.col("label") == "opinion_like")
    return tagging.emotion_gate(opinions.withColumn("label_scores", scores)).drop("label_scores")


def opinion_tokens(spark: SparkSession, sf_dir: str, variant: bool = False, opinions: DataFrame | None = None) -> DataFrame:
    """Filtered tokens of the gated opinion sentences, rejects included. ``opinions`` are ``gated`` rows, if made already."""
    from medialoom.operators import tagging

    rows = tagging.token_rows((gated(spark, sf_dir) if opinions is None else opinions).filter("gate_passed"), tag_of)
    return tagging.filter_tokens(rows, blocked_words(spark, sf_dir), variant=variant)


def lexicon_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return word_vectors(lexicon(spark, sf_dir).select("word"), emb, "word")


def keyword_vectors(spark: SparkSession, sf_dir: str):
    emb = table(spark, sf_dir, "embeddings")
    return lambda keywords: word_vectors(keywords, emb, "keyword_text")


def resolved(spark: SparkSession, sf_dir: str, trace: bool = False, variant: bool = False, tokens_: DataFrame | None = None) -> DataFrame:
    """Candidates with their decision; ``trace`` searches without a score threshold. Tokens feed the search and the decision, so
    they are written once, unless the caller has them written as ``tokens_``."""
    from medialoom.operators import tagging

    if tokens_ is None:
        tokens_ = materialize(opinion_tokens(spark, sf_dir, variant), "tokens")
    if variant:
        passed = tokens_.filter("reject_reason IS NULL").withColumns(
            {
                "keyword_text": F.col("surface"),
                "start_offset": F.col("start"),
                "end_offset": F.col("start") + F.col("len"),
                "matched_word": F.col("surface"),
            }
        )
    else:
        passed = tagging.build_candidates(tokens_).filter("reject_reason IS NULL")
    hits = tagging.hit_lists(
        passed,
        lexicon(spark, sf_dir),
        keyword_vectors(spark, sf_dir),
        lexicon_vectors(spark, sf_dir),
        threshold=None if trace or variant else tagging.SIMILARITY,
    )
    # Written once: the hit table is counted for the broadcast and then joined.
    return tagging.resolve_hits(passed, materialize(hits, "hits"), match_seed=not variant, allow_unsigned=not variant)


def word_vectors(words: DataFrame, embeddings: DataFrame, word: str) -> DataFrame:
    """Vector of a word: the stored vector its hash points at."""
    size = embeddings.agg(F.count(F.lit(1)).alias("_size"))
    slot = F.conv(F.substring(F.md5(F.col(word)), 1, 8), 16, 10).cast("bigint")
    keyed = words.join(F.broadcast(size)).withColumn("vec_id", slot % F.col("_size")).drop("_size")
    vectors = embeddings.select("vec_id", F.col("embedding").alias("vec"))
    return keyed.join(vectors, "vec_id")


# --- property graph ----------------------------------------------------------------------------------


def _share(total: Column, n: Column) -> Column:
    """Ten times the mean, at most 1; null without lines."""
    return F.when(n.isNotNull(), round4(F.least(F.lit(1.0), total.cast("double") / n * 10.0)))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, seen as a published video with its analysis."""
    lines = table(spark, sf_dir, "lineitem")
    per_video = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min("l_suppkey").alias("supp"),
        F.sum(F.col("l_discount").cast("decimal(12,2)")).alias("disc"),
        F.sum(F.col("l_tax").cast("decimal(12,2)")).alias("tax"),
        F.count(F.lit(1)).alias("n"),
    )
    geo = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "r_name")
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders")
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(per_video, "o_orderkey", "left")
        .select(
            F.col("o_orderkey").cast("string").alias("video_id"),
            F.col("o_orderkey").alias("target_id"),
            F.concat_ws(" ", "c_mktsegment", F.substring("o_orderpriority", 3, 20)).alias("title"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_at"),
            F.col("o_totalprice").alias("view_count"),
            F.col("r_name").alias("country"),
            F.lower(F.substring("r_name", 1, 2)).alias("language"),
            F.concat(F.lit("ch"), F.col("supp").cast("string")).alias("channel"),
            F.when(F.col("o_orderstatus") == "F", "SUCCESS")
            .when(F.col("o_orderstatus") == "P", "FAILED")
            .alias("status"),
            F.substring("o_orderpriority", 3, 20).alias("tone"),
            _share(F.col("disc"), F.col("n")).alias("opinion_score"),
            _share(F.col("tax"), F.col("n")).alias("bias_score"),
        )
    )


def video_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").cast("string").alias("video_id"),
        "l_linenumber",
        "p_name",
        "p_brand",
        "p_type",
    )


def part_of(lines: DataFrame) -> DataFrame:
    """PART_OF edges with the issue's cluster type (odd brand numbers are curated by hand)."""
    return line_edges(lines).select("video_id", "issue_id", "cluster_type").distinct()


def line_edges(lines: DataFrame) -> DataFrame:
    """Every line with the edges and the keyword that it stands for."""
    number = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
    return lines.select(
        "video_id",
        F.col("p_brand").alias("issue_id"),
        F.when(number % 2 == 1, "CURATION_MANUAL").otherwise("SEARCH_AUTO").alias("cluster_type"),
        F.col("p_type").alias("entity_key"),
        F.col("p_name").alias("keyword"),
        F.col("l_linenumber").alias("position"),
    )


def has_entity(lines: DataFrame) -> DataFrame:
    return lines.select("video_id", F.col("p_type").alias("entity_key")).distinct()


def keyword_rows(lines: DataFrame) -> DataFrame:
    """Distinct raw keywords of a video with their first position."""
    return lines.groupBy("video_id", F.col("p_name").alias("keyword")).agg(
        F.min("l_linenumber").alias("position")
    )


# --- logs and ingest ---------------------------------------------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def video_key(props: Column) -> Column:
    return F.concat(F.lit("v"), F.get_json_object(props, "$.k"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest candidates: one request per user and week, in event order."""
    number = F.get_json_object("props", "$.k").cast("int")
    raw = events(spark, sf_dir)
    return raw.select(
        F.concat_ws(
            "-", F.lit("rt"), F.col("user_id").cast("string"), F.weekofyear("ts").cast("string")
        ).alias("request_id"),
        F.col("event_id").alias("seq"),
        video_key(F.col("props")).alias("video_id"),
        F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("title"),
        F.when(number % 3 == 0, " kr ").when(number % 3 == 1, "us").otherwise("cn").alias("country_code"),
        F.when(number % 3 == 0, "KO").when(number % 3 == 1, "en").otherwise("zh ").alias("language"),
        F.col("value").alias("view_count"),
        "event_type",
        "ts",
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")
