"""Keyword and evidence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from medialoom.functions.columns import among, clamp01, round4, strip
from medialoom.functions.lexemes import FOCUS_STOPWORDS, KEYWORD_STOPWORDS

# List lengths, quota and minimum counts.
TOP_N, NOUN_QUOTA = 5, 2
MIN_TF, MIN_DF = 2, 2
FRAME_TAGS = ["NNG", "NNP", "VV"]
TOPIC_TAGS = ["NNG", "NNP"]
NOUN_TAGS = ["NNG", "NNP"]


def predicate_text(form: Column) -> Column:
    return F.when(form.endswith("다"), form).otherwise(F.concat(form, F.lit("다")))


def emotion_keyword(word: Column, tag1: Column, form1: Column, tag2: Column, form2: Column) -> Column:
    """Dictionary form of a matched word from its first two tokens."""
    hada = F.coalesce(form2 == "하", F.lit(False))
    verb = (tag1 == "VV") | tag1.startswith("VA") | (tag1 == "XSV")
    derived = ((tag1 == "XR") & (tag2 == "XSA") & hada) | ((tag1 == "NNG") & (tag2 == "XSV") & hada)
    return (
        F.when(verb, predicate_text(form1))
        .when(F.coalesce(derived, F.lit(False)), F.concat(form1, F.lit("하다")))
        .otherwise(strip(word))
    )


def morpheme_keyword(form: Column, tag: Column, tags: list[str]) -> Column:
    verbs = [t for t in tags if t.startswith("VV")]
    keyword = F.when(among(tag, [t for t in tags if t in NOUN_TAGS]), form)
    if verbs:
        keyword = keyword.when(tag.startswith("VV"), predicate_text(form))
    return F.when(F.length(keyword) >= 2, keyword)


def stopword(c: Column, words: list[str] = KEYWORD_STOPWORDS) -> Column:
    return among(F.lower(strip(c)), words)


def keyword_shares(rows: DataFrame, weight: Column, group: list[str]) -> DataFrame:
    """Weight of each keyword and its share of the group's total.

    Rows are summed per keyword first; the total is a window over those far fewer rows. Rows that come partitioned by
    columns of the group are not shuffled again. A weight that is a decimal of eight digits is summed as a long number.
    """
    kind = rows.select(weight).schema[0].dataType
    exact = weight if isinstance(kind, DecimalType) and kind.scale <= 4 else weight.cast("decimal(20,4)")
    weights = rows.groupBy(*group, "keyword").agg(F.sum(exact).alias("weight"))
    totals = weights.withColumn("_all", F.sum("weight").over(Window.partitionBy(*group)))
    share = F.col("weight").cast("double") / F.col("_all").cast("double")
    return (
        totals.filter(F.col("_all") > 0)
        .withColumn("score", round4(clamp01(share)))
        .withColumn("weight", F.col("weight").cast("double"))
        .drop("_all")
    )


def with_noun_quota(
    ranked: DataFrame, group: list[str], order: list[Column], limit: int = TOP_N, quota: int = NOUN_QUOTA
) -> DataFrame:
    """Top ``limit`` keywords where at least ``quota`` are nouns, if the list has them.

    Missing nouns are taken from below the cut, best first, and overwrite the lowest-ranked predicates; a
    replaced row keeps its slot. One pass in the order of the ranks: only ``2 * limit + quota`` rows per group go
    beyond the ranking step, and nothing is joined.
    """
    payload = [c for c in ranked.columns if c not in group]
    best = Window.partitionBy(*group).orderBy(*order)
    nouns = F.count_if("is_noun").over(best.rowsBetween(Window.unboundedPreceding, 0))
    placed = ranked.withColumn("is_noun", ~F.col("keyword").endswith("다"))
    placed = placed.withColumns({"slot": F.row_number().over(best), "_nth": nouns})
    head = F.col("slot") <= limit
    few = placed.filter(head | (F.col("is_noun") & (F.col("_nth") <= limit + quota)))

    whole = Window.partitionBy(*group)
    own = F.count_if(head & F.col("is_noun")).over(whole)
    behind = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("_open").desc(), F.col("slot").desc()))
    few = few.withColumns({"_held": own, "_open": head & ~F.col("is_noun"), "_own": F.struct(*payload)})
    few = few.withColumn("_j", F.when(F.col("_open"), behind).when(~head, F.col("_nth") - F.col("_held")))
    # A group has one spare noun per number, so the aggregate over the group is that noun.
    spare = lambda n: F.first(F.when(~head & (F.col("_j") == n), F.col("_own")), ignorenulls=True).over(whole)
    spares = F.array(*[spare(n) for n in range(1, quota + 1)]) if quota else F.array(F.lit(None))
    replaced = F.col("_open") & (F.col("_j") <= F.lit(quota) - F.col("_held"))
    fill = F.when(replaced, F.get("_spares", F.col("_j").cast("int") - 1)) if quota else F.lit(None)
    out = few.withColumn("_spares", spares).filter(head)
    return out.select(*group, "slot", F.coalesce(fill, F.col("_own")).alias("_row")).select(*group, "slot", "_row.*")


def focus_keyword(form: Column, tag: Column) -> Column:
    """Keyword of a stripped form: nouns as they are, verbs with the predicate ending."""
    return F.when(among(tag, NOUN_TAGS), form).when(tag.startswith("VV"), predicate_text(form))


def focus_words(tokens: DataFrame) -> DataFrame:
    """Tokens whose keyword is long enough and no stopword, nor their surface."""
    keyword = focus_keyword(strip(F.col("form")), F.col("tag"))
    return tokens.withColumn("keyword", keyword).filter(
        (F.length("keyword") >= 2)
        & ~among(F.lower("keyword"), FOCUS_STOPWORDS)
        & ~among(F.lower(strip(F.col("surface"))), FOCUS_STOPWORDS)
    )


def focus_keywords(tokens: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Repeated keywords per document scored by sentence share and frequency, before the quota.

    ``tokens(doc_id, sentence_id, form, surface, tag)``, or what ``focus_words`` leaves of them with ``keyword`` in
    place of the last three; ``totals(doc_id, total)``; without totals, each
    token carries the ``total`` of its document, and the sentences are read once. Occurrences are first counted
    per sentence, so distinct sentences are plain row counts. Tokens that come partitioned by document are not shuffled.
    """
    rows = tokens if "keyword" in tokens.columns else focus_words(tokens)
    carried = [F.max("total").alias("total")] if totals is None else []
    per_sentence = rows.groupBy("doc_id", "keyword", "sentence_id").agg(F.count(F.lit(1)).alias("n"), *carried)
    counted = per_sentence.groupBy("doc_id", "keyword").agg(
        F.sum("n").alias("occurrence_count"), F.count(F.lit(1)).alias("sentence_count"), *carried
    )
    repeated = counted.filter((F.col("occurrence_count") >= MIN_TF) & (F.col("sentence_count") >= MIN_DF))
    scored = repeated.withColumn("_max", F.max("occurrence_count").over(Window.partitionBy("doc_id")))
    score = 0.8 * (F.col("sentence_count") / F.col("total")) + 0.2 * (F.col("occurrence_count") / F.col("_max"))
    return (
        (scored if totals is None else scored.join(totals, "doc_id"))
        .withColumn("score", round4(clamp01(score)))
        .drop("_max", "total")
    )


def focus_order() -> list[Column]:
    return [
        F.col("sentence_count").desc(),
        F.col("occurrence_count").desc(),
        F.col("score").desc(),
        F.col("keyword"),
    ]


def display_surface(tokens: DataFrame) -> DataFrame:
    """Most frequent surface per keyword, the keyword itself preferred on a tie, then by text."""
    counted = tokens.groupBy("keyword", "surface").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct((-F.col("n")).alias("a"), (F.col("surface") != F.col("keyword")).alias("b"), F.col("surface").alias("c"))
    return counted.groupBy("keyword").agg(F.min_by("surface", order).alias("display_text"))


# Evidence types and titles by span label.
EVIDENCE = {"EMOTIONALLY_LOADED": ("EMOTION", "감정적 표현"), "OPINION_LIKE": ("OPINION", "주관적 의견")}


def evidence_rows(classified: DataFrame, spans: DataFrame) -> DataFrame:
    """Evidence per emotion or opinion span and per opinion sentence.

    Spans carry ``sentence_text``, so no join is needed.
    """

    def titled(index: int) -> Column:
        out = F.lit(None).cast("string")
        for label, names in EVIDENCE.items():
            out = F.when(F.col("label_type") == label, names[index]).otherwise(out)
        return out

    cut = F.expr("substring(sentence_text, start_offset + 1, end_offset - start_offset)")
    word = F.when(F.col("matched_word") != "", F.col("matched_word"))
    from_spans = spans.filter(among(F.col("label_type"), list(EVIDENCE))).select(
        "doc_id",
        "sentence_id",
        titled(0).alias("evidence_type"),
        titled(1).alias("title"),
        F.col("sentence_text").alias("description"),
        F.coalesce(word, cut).alias("source_text"),
        round4(clamp01(F.col("score").cast("double"))).alias("confidence"),
    )
    kind, title = EVIDENCE["OPINION_LIKE"]
    from_sentences = classified.filter(F.col("label") == "opinion_like").select(
        "doc_id",
        "sentence_id",
        F.lit(kind).alias("evidence_type"),
        F.lit(title).alias("title"),
        F.col("sentence_text").alias("description"),
        F.col("sentence_text").alias("source_text"),
        round4(clamp01(F.col("confidence"))).alias("confidence"),
    )
    return from_spans.unionByName(from_sentences)
