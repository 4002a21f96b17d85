"""Sentence labels, the emotion gate, token candidates, similarity search and emotion spans."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from medialoom.functions.columns import (
    TOKEN,
    among,
    bounded_broadcast,
    clamp01,
    let,
    literal_array,
    round4,
    strip,
    tokens,
)
from medialoom.functions.lexemes import (
    BASE_BLOCKLIST,
    EMOTION_NOUN_MARKERS,
    EMOTION_NOUN_SUFFIXES,
    NEGATIVE_LABELS,
    POSITIVE_LABELS,
    SPAN_BOUNDARY,
)
from medialoom.operators.similarity import top_k_by_lists, top_k_similar  # noqa: F401

# Thresholds of the gate and the similarity match.
GATE_SCORE, LABEL_SCORE, LABELS_KEPT = 0.35, 0.20, 3
SIMILARITY, TOP_K, MARGIN = 0.88, 3, 0.06
FALLBACK_SCORE = 0.93
VALID_TAGS = ["NNG", "XR"]
VARIANT_TAGS = ["NNG", "VV", "VA", "MAG", "XR"]
BLOCK_SECTIONS = ["block_confirmed", "review_promoted_from_added_data", "auto_review_blocked"]


# --- labels ------------------------------------------------------------------------------------------


def classify_by_rule(sentences: DataFrame, opinion_cue: str = "[!?]") -> DataFrame:
    """Deterministic label: opinion when the cue occurs, confidence growing with length."""
    label = F.when(F.col("sentence_text").rlike(opinion_cue), "opinion_like").otherwise("fact_like")
    confidence = F.least(F.lit(0.99), F.lit(0.5) + F.length("sentence_text") / 400.0)
    return sentences.withColumns({"label": label, "confidence": confidence})


def fit_label_model(labelled: DataFrame, text: str, label: str, features: int = 1 << 14) -> PipelineModel:
    """Hashed TF-IDF and logistic regression on ``labelled``."""
    stages = [
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol=label, maxIter=20, regParam=0.01),
    ]
    training = labelled.withColumn("_tokens", tokens(F.lower(text))).withColumn(
        label, F.col(label).cast("double")
    )
    return Pipeline(stages=stages).fit(training)


def classify_by_model(df: DataFrame, model: PipelineModel, text: str, names: tuple[str, str]) -> DataFrame:
    """Label and confidence (the larger class probability) of every row."""
    scored = model.transform(df.withColumn("_tokens", tokens(F.lower(text))))
    chances = vector_to_array("probability")
    return scored.select(
        *df.columns,
        F.when(F.col("prediction") == 1.0, names[1]).otherwise(names[0]).alias("label"),
        F.array_max(chances).alias("confidence"),
    )


# --- gate --------------------------------------------------------------------------------------------


def emotion_gate(df: DataFrame, scores: str = "label_scores", enabled: bool = True) -> DataFrame:
    """Best label score, the labels kept, whether the sentence passes, and the polarities it allows.

    ``scores`` is MAP<STRING, DOUBLE>. Ties go to the label that sorts first.
    """
    if not enabled:
        ranked = F.array().cast("array<struct<neg:double,label:string>>")
        score, passed = F.lit(1.0), F.lit(True)
    else:
        entries = F.map_entries(scores)
        ranked = F.array_sort(
            F.transform(entries, lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("label")))
        )
        score = -F.get(ranked, F.lit(0))["neg"]
    kept = F.transform(
        F.slice(F.filter(ranked, lambda e: e["neg"] <= -LABEL_SCORE), 1, LABELS_KEPT), lambda e: e["label"]
    )
    if enabled:
        passed = (score >= GATE_SCORE) & (F.size(kept) > 0)
    out = df.withColumn("top_labels", kept).withColumns(
        {"gate_score": score, "gate_passed": F.coalesce(passed, F.lit(False))}
    )
    return out.withColumn("allowed", allowed_polarities(F.col("top_labels")))


def allowed_polarities(labels: Column) -> Column:
    negative = F.arrays_overlap(labels, literal_array(NEGATIVE_LABELS))
    positive = F.arrays_overlap(labels, literal_array(POSITIVE_LABELS))
    return (
        F.when(negative & ~positive, F.array(F.lit(-2), F.lit(-1)))
        .when(positive & ~negative, F.array(F.lit(1), F.lit(2)))
        .otherwise(F.array(F.lit(-2), F.lit(-1), F.lit(1), F.lit(2)))
    )


# --- blocklist ---------------------------------------------------------------------------------------


def blocklist(decisions: DataFrame, base: list[str] = BASE_BLOCKLIST) -> DataFrame:
    """Blocked words: a fixed base and the blocking sections of the review decisions.

    ``decisions(section, item)``: an item is a word or a JSON object naming its word, parsed once.
    """
    item = strip(F.col("item"))
    named = F.coalesce(
        *[F.nullif(strip(F.try_variant_get("parsed", f"$.{k}", "string")), F.lit("")) for k in ("surface", "keyword", "keyword_text")]
    )
    word = F.when(F.col("item").startswith("{"), named).otherwise(F.col("item"))
    items = decisions.filter(F.col("section").isin(*BLOCK_SECTIONS)).select(item.alias("item"))
    parsed = F.when(F.col("item").startswith("{"), F.try_parse_json("item"))
    reviewed = items.select("item", parsed.alias("parsed")).select(word.alias("word"))
    fixed = decisions.sparkSession.createDataFrame([(w,) for w in base], "word string")
    return reviewed.unionByName(fixed).filter(F.col("word") != "").distinct()


def block_keys(blocked: DataFrame) -> DataFrame:
    """Forms each blocked word blocks: itself, and its stem without the predicate endings.

    Expanding the small list replaces trying every ending on each token.
    """
    w = F.col("word")
    stems = F.array(
        w,
        F.when(w.endswith("하다"), F.expr("left(word, length(word) - 2)")),
        F.when(w.endswith("다"), F.expr("left(word, length(word) - 1)")),
    )
    return (
        blocked.select(w, F.explode(stems).alias("key"))
        .filter(F.col("key").isNotNull() & ((F.col("key") == w) | ~F.col("key").endswith("다")))
        .select("key", (F.col("key") == F.col("word")).alias("exact"))
        .groupBy("key")
        .agg(F.max("exact").alias("exact"))
    )


def mark_blocked(
    words: DataFrame, blocked: DataFrame, form: str = "form", surface: str = "surface", strip_digits: bool = True
) -> DataFrame:
    """``blocked`` flag: surface or form, with or without leading digits or predicate endings, is listed."""
    keys = bounded_broadcast(block_keys(blocked))
    out = words
    digits = "^[0-9]+"
    probes = {
        "_k0": (F.col(form), True),
        "_k1": (F.regexp_replace(form, digits, ""), True),
        "_k2": (F.col(surface), False),
        "_k3": (F.regexp_replace(surface, digits, ""), False),
    }
    if not strip_digits:
        probes = {k: v for k, v in probes.items() if k in ("_k0", "_k2")}
    if form == surface:
        probes = {k: v for k, v in probes.items() if k in ("_k0", "_k1")}
    hits = []
    for name, (probe, stems) in probes.items():
        side = keys.select(F.col("key").alias(name), F.col("exact").alias(f"{name}x"))
        out = out.join(side, probe == F.col(name), "left")
        found = F.col(f"{name}x").isNotNull() if stems else F.coalesce(f"{name}x", F.lit(False))
        hits.append(found)
    flag = hits[0]
    for h in hits[1:]:
        flag = flag | h
    return out.withColumn("blocked", flag).drop(*probes, *[f"{n}x" for n in probes])


# --- tokens and candidates ---------------------------------------------------------------------------

_WORD = re.compile(TOKEN)

@F.pandas_udf(ArrayType(IntegerType()))
def _starts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: np.fromiter((m.start() for m in _WORD.finditer(t or "")), np.int32))


def token_rows(sentences: DataFrame, tag) -> DataFrame:
    """Default token table with offsets; ``tag`` maps a form column to a part of speech.

    The next token rides along, so adjacency needs no window. Python gives the places only, one array of numbers a sentence.
    """
    located = sentences.withColumns({"_starts": _starts("sentence_text"), "_forms": tokens(F.col("sentence_text"))})
    out = located.select("*", F.posexplode("_forms").alias("token_index", "_form"))
    after = F.col("token_index") + 1
    out = out.withColumns({"_next": F.get("_forms", after), "_start": F.get("_starts", F.col("token_index")), "_behind": F.get("_starts", after)})
    return out.select(
        *sentences.columns,
        "token_index",
        F.col("_form").alias("form"),
        F.col("_form").alias("surface"),
        tag(F.col("_form")).alias("tag"),
        F.col("_start").alias("start"),
        F.length("_form").alias("len"),
        F.col("_next").alias("next_form"),
        tag(F.col("_next")).alias("next_tag"),
        F.col("_behind").alias("next_start"),
    )


def _is_predicate(tag: Column) -> Column:
    return (tag == "VV") | tag.startswith("VA")


def filter_tokens(token_table: DataFrame, blocked: DataFrame, variant: bool = False) -> DataFrame:
    """Each token with the reason it is no candidate, or none. Rejects are kept for the trace."""
    tag = F.col("tag")
    valid = among(tag, VARIANT_TAGS) if variant else among(tag, VALID_TAGS) | _is_predicate(tag)
    marked = mark_blocked(token_table, blocked)
    reason = (
        F.when(tag == "NNP", "proper_noun")
        .when(~valid, "invalid_pos")
        .when(F.length("form") < 2, "too_short")
        .when(F.col("blocked"), "blocked_stopword")
    )
    return marked.withColumn("reject_reason", reason).drop("blocked")


def _dictionary_form(stem: Column) -> Column:
    return F.when(stem.endswith("다"), stem).otherwise(F.concat(stem, F.lit("다")))


_GROWTH = "^[^" + r"\p{IsWhite_Space}" + re.sub(r"([\[\]\\^-])", r"\\\1", SPAN_BOUNDARY) + "]*"


def build_candidates(filtered: DataFrame) -> DataFrame:
    """Keyword text and span of each token that passed; roots without a verb ending become rejects.

    Nouns keep their surface. Predicates take their dictionary form and grow to the end of the word, as do
    roots directly followed by the verb ending.
    """
    tag, end = F.col("tag"), F.col("start") + F.col("len")
    root = (
        (tag == "XR")
        & (F.col("next_start") == end)
        & (F.col("next_tag") == "XSA")
        & (F.col("next_form") == "하")
    )
    root = F.coalesce(root, F.lit(False))
    grown = end + F.length(F.regexp_extract(F.expr("substring(sentence_text, start + len + 1)"), _GROWTH, 0))
    passed = F.col("reject_reason").isNull()
    usable = (tag == "NNG") | _is_predicate(tag) | root
    keyword = (
        F.when(tag == "NNG", F.col("surface"))
        .when(_is_predicate(tag), _dictionary_form(F.col("form")))
        .when(root, F.concat("form", F.lit("하다")))
    )
    out = filtered.withColumns(
        {
            "reject_reason": F.when(passed & ~usable, "invalid_pos").otherwise(F.col("reject_reason")),
            "keyword_text": F.when(passed & usable, keyword),
            "start_offset": F.col("start"),
            "end_offset": F.when(tag == "NNG", end).otherwise(grown),
        }
    )
    return out.withColumn(
        "matched_word", F.expr("substring(sentence_text, start_offset + 1, end_offset - start_offset)")
    )


# --- emotion spans -----------------------------------------------------------------------------------


def hit_lists(keywords: DataFrame, lexicon: DataFrame, word_vectors, lexicon_vectors: DataFrame, **search) -> DataFrame:
    """Ranked lexicon hits per distinct keyword as one array of at most ``k`` entries.

    Searching distinct keywords, not tokens, keeps the work proportional to the vocabulary.
    """
    vocabulary = keywords.select("keyword_text").filter(F.col("keyword_text").isNotNull()).distinct()
    hits = top_k_similar(word_vectors(vocabulary), lexicon_vectors, "keyword_text", "word", k=TOP_K, **search)
    entry = F.struct(
        "rank",
        "score",
        F.col("word"),
        "embed_text",
        "clean_seed",
        F.coalesce("polarity", F.lit(0)).alias("polarity"),
        "category",
    )
    known = bounded_broadcast(lexicon)
    return (
        hits.join(known, F.col("hit_id") == F.col("word"))
        .groupBy("keyword_text")
        .agg(F.array_sort(F.collect_list(entry)).alias("hits"))
    )


def resolve_hits(
    candidates: DataFrame,
    hits: DataFrame,
    threshold: float = SIMILARITY,
    margin: float = MARGIN,
    match_seed: bool = True,
    allow_unsigned: bool = True,
) -> DataFrame:
    """Accept or reject each candidate from its hit list; needs ``keyword_text``, ``tag``, ``allowed``.

    Steps: polarity filter, seed match (or, without one, the similarity fallback), first hit per seed,
    threshold, margin between the best two.
    """
    joined = candidates.join(bounded_broadcast(hits), "keyword_text", "left").withColumn(
        "hits", F.coalesce("hits", F.array())
    )
    keyword, tag = F.col("keyword_text"), F.col("tag")

    def right_sign(h: Column) -> Column:
        listed = F.array_contains("allowed", h["polarity"])
        return (h["polarity"] == 0) | listed if allow_unsigned else listed

    markers = F.lit(False)
    for m in EMOTION_NOUN_MARKERS:
        markers = markers | F.contains(keyword, F.lit(m))
    for m in EMOTION_NOUN_SUFFIXES:
        markers = markers | keyword.endswith(m)
    fallback_ok = tag.startswith("VA") | (tag == "XR") | ((tag == "NNG") & markers)

    with_signs = joined.withColumn("_signed", F.filter("hits", right_sign))
    if match_seed:
        seeded = F.filter(
            "_signed",
            lambda h: F.array_contains(F.array(h["clean_seed"], h["embed_text"], h["word"]), keyword),
        )
        similar = F.filter(
            "_signed",
            lambda h: fallback_ok & (h["score"] >= max(threshold, FALLBACK_SCORE)) & (h["category"] == "DIRECT_EMOTION"),
        )
        chosen = F.when(F.size("_seeded") > 0, F.col("_seeded")).otherwise(similar)
        with_signs = with_signs.withColumn("_seeded", seeded)
    else:
        chosen = F.col("_signed")
    picked = let(
        chosen,
        lambda c: F.filter(
            c,
            lambda h, i: F.array_position(F.transform(c, lambda x: x["clean_seed"]), h["clean_seed"]) == i + 1,
        ),
    )
    out = with_signs.withColumn("_picked", picked)
    top, second = F.get("_picked", F.lit(0)), F.get("_picked", F.lit(1))
    reason = F.when(F.size("_picked") == 0, F.lit("polarity_mismatch"))
    if match_seed:
        reason = (
            F.when((F.size("_signed") > 0) & (F.size("_picked") == 0), "seed_mismatch")
            .when((F.size("_picked") == 0) & (F.size("hits") == 0), "no_hit")
            .when(F.size("_picked") == 0, "polarity_mismatch")
        )
    reason = reason.when(top["score"] < threshold, "below_threshold").when(
        top["score"] - second["score"] < margin, "low_margin"
    )
    return out.withColumns(
        {"reject_reason": reason, "score": round4(clamp01(top["score"])), "hit_word": top["word"]}
    ).drop("_signed", "_seeded", "_picked", "hits")


def dictionary_spans(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Exact dictionary matches as emotion spans.

    The lexicon is broadcast when its counted size allows, so the token table is not shuffled.
    """
    lookup = bounded_broadcast(lexicon.select("word", F.col("score_hint").alias("score"), "polarity"))
    return words.join(lookup, F.lower("form") == F.col("word")).select(
        "doc_id",
        "sentence_id",
        "index",
        "total",
        "token_index",
        F.col("form").alias("matched_word"),
        "score",
        "polarity",
    )


def resolve_overlaps(spans: DataFrame, group: list[str], priority: Column) -> DataFrame:
    """Greedy choice of non-overlapping spans per sentence, best priority first, then input order ``seq``.

    A sentence's spans stream by in that order after one shuffle and a sort. The kept ones are held in order of place; as
    they don't overlap, their ends are in order too, and a span is tried against one neighbour only. Spans without a start
    or an end are left out; an end is not before its start.
    """
    tasks = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = spans.select(*group, priority.cast("int").alias("_p"), "seq", "start_offset", "end_offset")
    rows = rows.filter("start_offset IS NOT NULL AND end_offset IS NOT NULL")
    rows = rows.repartition(tasks, *group).sortWithinPartitions(*group, "_p", "seq")
    schema = rows.drop("_p").schema

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept = None, []
        for batch in batches:
            taken = []
            keys = zip(*[batch.column(c).to_pylist() for c in group], strict=True)
            for i, (key, start, stop) in enumerate(zip(keys, batch.column("start_offset").to_pylist(), batch.column("end_offset").to_pylist(), strict=True)):
                if key != at:
                    at, kept = key, []
                before = bisect_left(kept, (stop,)) - 1
                if before < 0 or kept[before][1] <= start:
                    insort(kept, (start, stop))
                    taken.append(i)
            yield batch.select(schema.names).take(pa.array(taken, pa.int64()))

    return rows.mapInArrow(choose, schema)


def keep_filter(spans: DataFrame, keep: DataFrame | None, keyword: str = "keyword") -> DataFrame:
    """Emotion spans whose keyword is on the keep list, and all other spans; no list keeps everything."""
    if keep is None:
        return spans
    words = bounded_broadcast(keep.select(F.col("word").alias(keyword)).distinct().withColumn("_keep", F.lit(True)))
    joined = spans.join(words, keyword, "left")
    return joined.filter((F.col("label_type") != "EMOTIONALLY_LOADED") | F.col("_keep").isNotNull()).drop("_keep")


def sane_keep_list(proposed: Column, candidates: Column) -> Column:
    """Proposed words that are among the candidates."""
    return F.array_intersect(F.transform(proposed, strip), candidates)
