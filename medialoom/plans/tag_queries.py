"""Label, gate, token, similarity and span queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialoom.functions.columns import bounded_broadcast, round4, tokens
from medialoom.operators import tagging as G
from medialoom.plans.registry import query
from medialoom.plans.sqlviews import s_resolve, s_round4, s_tag, with_views
from medialoom.session import materialize
from medialoom.sources import views as V


@query(
    "classify_rule",
    with_views("classified", f"SELECT doc_id, sentence_id, label, {s_round4('confidence')} AS confidence FROM classified"),
)
def classify_rule(spark, sf):
    return V.classified(spark, sf).select("doc_id", "sentence_id", "label", round4(F.col("confidence")).alias("confidence"))


@query("classify_ml")
def classify_ml(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "text")
    quality = V.table(spark, sf, "labels").select("doc_id", "quality")
    model = G.fit_label_model(docs.join(quality, "doc_id"), "text", "quality")
    labelled = G.classify_by_model(docs, model, "text", ("fact_like", "opinion_like"))
    return labelled.select("doc_id", "label", round4(F.col("confidence")).alias("confidence"))


@query(
    "emotion_gate",
    with_views(
        "gated",
        f"""SELECT doc_id, sentence_id, {s_round4('gate_score')} AS gate_score, gate_passed,
        array_to_string(top_labels, '|') AS top_labels, array_to_string(allowed, ',') AS allowed FROM gated""",
    ),
)
def emotion_gate(spark, sf):
    return V.gated(spark, sf).select(
        "doc_id",
        "sentence_id",
        round4(F.col("gate_score")).alias("gate_score"),
        "gate_passed",
        F.array_join("top_labels", "|").alias("top_labels"),
        F.array_join(F.col("allowed").cast("array<string>"), ",").alias("allowed"),
    )


@query("blocklist_union", with_views("blocked", "SELECT word FROM blocked"))
def blocklist_union(spark, sf):
    return V.blocked_words(spark, sf)


@query(
    "token_filter",
    with_views("filtered", "SELECT doc_id, sentence_id, token_index, form, tag, start::BIGINT AS start, reject_reason FROM filtered"),
)
def token_filter(spark, sf):
    return V.opinion_tokens(spark, sf).select(
        "doc_id", "sentence_id", "token_index", "form", "tag", F.col("start").cast("bigint").alias("start"), "reject_reason"
    )


@query(
    "token_candidates",
    with_views(
        "tcands",
        """SELECT doc_id, sentence_id, token_index, keyword_text, start_offset::BIGINT AS start_offset,
        end_offset::BIGINT AS end_offset, matched_word FROM tcands""",
    ),
)
def token_candidates(spark, sf):
    return G.build_candidates(V.opinion_tokens(spark, sf)).filter("reject_reason IS NULL").select(
        "doc_id",
        "sentence_id",
        "token_index",
        "keyword_text",
        F.col("start_offset").cast("bigint").alias("start_offset"),
        F.col("end_offset").cast("bigint").alias("end_offset"),
        "matched_word",
    )


@query(
    "vector_topk",
    with_views("slot_hits", "SELECT q AS vec_id, rank::INT AS rank, word, score FROM slot_hits"),
)
def vector_topk(spark, sf):
    queries = V.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    hits = G.top_k_similar(queries, V.lexicon_vectors(spark, sf), "vec_id", "word")
    return hits.select("vec_id", "rank", F.col("hit_id").alias("word"), "score")


@query("vector_topk_lsh")
def vector_topk_lsh(spark, sf):
    queries = V.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    near = G.top_k_by_lists(queries, V.lexicon_vectors(spark, sf), "vec_id", "word")
    return near.select("vec_id", "rank", F.col("hit_id").alias("word"), "score")


_SPAN = """SELECT doc_id, sentence_id, start_offset::BIGINT AS start_offset, end_offset::BIGINT AS end_offset, matched_word, score
FROM resolved WHERE decision IS NULL"""


def _span(df):
    return df.filter("reject_reason IS NULL").select(
        "doc_id",
        "sentence_id",
        F.col("start_offset").cast("bigint").alias("start_offset"),
        F.col("end_offset").cast("bigint").alias("end_offset"),
        "matched_word",
        "score",
    )


@query(
    "emotion_spans",
    with_views("tcands slot_hits", f"WITH cand AS (SELECT * FROM tcands), resolved AS ({s_resolve(True, G.SIMILARITY)}) {_SPAN}"),
)
def emotion_spans(spark, sf):
    return _span(V.resolved(spark, sf))


_VARIANT = """SELECT doc_id, sentence_id, allowed, tag, form AS keyword_text, start AS start_offset, start + length(form) AS end_offset,
form AS matched_word FROM tokmarks WHERE tag IN ('NNG', 'VV', 'VA', 'MAG', 'XR') AND length(form) >= 2 AND NOT is_blocked"""


@query(
    "emotion_spans_variant",
    with_views("tokmarks slot_hits", f"WITH cand AS ({_VARIANT}), resolved AS ({s_resolve(False, None)}) {_SPAN}"),
)
def emotion_spans_variant(spark, sf):
    return _span(V.resolved(spark, sf, variant=True))


@query(
    "reject_stats",
    with_views(
        "filtered tcands slot_hits gated",
        f"""WITH cand AS (SELECT * FROM tcands), resolved AS ({s_resolve(True, None)}), reasons AS (
        SELECT coalesce(reject_reason, 'invalid_pos') AS reason FROM filtered WHERE reject_reason IS NOT NULL OR tag = 'XR'
        UNION ALL SELECT coalesce(decision, 'accepted') FROM resolved
        UNION ALL SELECT CASE WHEN gate_passed THEN 'gate_passed' ELSE 'low_gate_score' END FROM gated)
        SELECT reason, count(*) AS n FROM reasons GROUP BY 1""",
    ),
)
def reject_stats(spark, sf):
    opinions = materialize(V.gated(spark, sf), "opinions")
    written = materialize(V.opinion_tokens(spark, sf, opinions=opinions), "tokens")
    before = G.build_candidates(written).filter("reject_reason IS NOT NULL").select(F.col("reject_reason").alias("reason"))
    after = V.resolved(spark, sf, trace=True, tokens_=written).select(F.coalesce("reject_reason", F.lit("accepted")).alias("reason"))
    gate = opinions.select(F.when(F.col("gate_passed"), "gate_passed").otherwise("low_gate_score").alias("reason"))
    return before.unionByName(after).unionByName(gate).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "emotion_spans_simple",
    with_views(
        "words slot_hits",
        f"""SELECT doc_id, sentence_id, token_index, form, word AS matched_word, {s_round4('score')} AS score FROM words
        JOIN slot_hits ON q = ('0x' || substr(md5(form), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings)
        WHERE rank = 1 AND score >= 0.88::DOUBLE""",
    ),
)
def emotion_spans_simple(spark, sf):
    forms = tokens(F.col("sentence_text")).alias("forms")
    listed = materialize(V.prepared(spark, sf).select("doc_id", "sentence_id", forms), "words")
    words = listed.select("doc_id", "sentence_id", F.posexplode("forms").alias("token_index", "form"))
    vocabulary = words.select(F.col("form").alias("keyword_text")).distinct()
    hits = G.top_k_similar(
        V.keyword_vectors(spark, sf)(vocabulary), V.lexicon_vectors(spark, sf), "keyword_text", "word", k=1, threshold=G.SIMILARITY
    )
    hits = bounded_broadcast(materialize(hits.withColumnRenamed("keyword_text", "form"), "hits"))
    return words.join(hits, "form").select(
        "doc_id", "sentence_id", "token_index", "form", F.col("hit_id").alias("matched_word"), round4(F.col("score")).alias("score")
    )


def overlapping_spans(spark, sf):
    """Token pairs and single tokens of the gated sentences, so neighbours overlap."""
    rows = V.opinion_tokens(spark, sf)
    pair_end = F.when(F.col("next_start").isNotNull() & (F.col("token_index") % 2 == 0), F.col("next_start") + F.length("next_form"))
    return rows.select(
        "doc_id",
        "sentence_id",
        F.col("token_index").cast("bigint").alias("seq"),
        F.col("start").alias("start_offset"),
        F.coalesce(pair_end, F.col("start") + F.col("len")).alias("end_offset"),
        F.when(F.col("tag") == "NNG", "EMOTIONALLY_LOADED").otherwise("OPINION_LIKE").alias("label_type"),
    )


@query("resolve_overlaps")
def resolve_overlaps(spark, sf):
    priority = F.when(F.col("label_type") == "EMOTIONALLY_LOADED", F.lit(1)).otherwise(F.lit(99))
    return G.resolve_overlaps(overlapping_spans(spark, sf), ["doc_id", "sentence_id"], priority)


@query(
    "span_keep_filter",
    with_views(
        "words lexicon",
        """SELECT doc_id, sentence_id, token_index, lower(form) AS keyword, CASE WHEN tag = 'VV' THEN 'OPINION_LIKE' ELSE
        'EMOTIONALLY_LOADED' END AS label_type FROM words WHERE label = 'opinion_like' AND (tag = 'VV' OR lower(form) IN
        (SELECT word FROM lexicon WHERE category = 'DIRECT_EMOTION'))""",
    ),
)
def span_keep_filter(spark, sf):
    words = V.word_rows(V.classified(spark, sf).filter(F.col("label") == "opinion_like"))
    spans = words.select(
        "doc_id",
        "sentence_id",
        "token_index",
        F.lower("form").alias("keyword"),
        F.when(F.col("tag") == "VV", "OPINION_LIKE").otherwise("EMOTIONALLY_LOADED").alias("label_type"),
    )
    return G.keep_filter(spans, V.lexicon(spark, sf).filter(F.col("category") == "DIRECT_EMOTION"))
