"""Per-document scores, headline/body gap, texts built from scores, and the assembled result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialoom.functions.columns import ratio, round4
from medialoom.functions.ranking import dense_position, top_n
from medialoom.functions.vectors import cosine

# Weights and thresholds of the scores.
WEIGHTS = {"opinion": 0.4, "emotion": 0.3, "fact": 0.3}
FRONT, MIDDLE = 0.33, 0.66
FRONT_WEIGHT, MIDDLE_WEIGHT, BACK_WEIGHT = "1.3", "1.0", "0.8"
GAP_HIGH, GAP_MID = 0.7, 0.4
DECAY, LEAD, TAIL = 0.3, 3, 3
TRUSTWORTHY, CLICKBAIT, BURIED, UNEVEN = 0.30, 0.40, 0.40, 0.20
TOP_FACTS = 10


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    if abs(sum(weights.values()) - 1.0) > 1e-6:
        raise ValueError(f"score weights must add up to 1, got {weights}")
    return weights


def position_weight(index: Column, total: Column) -> Column:
    """Weight of a sentence by its place in the document, as an exact decimal."""
    place = F.when(total <= 1, F.lit(0.0)).otherwise(index / total)
    dec = lambda v: F.lit(v).cast("decimal(4,2)")
    return (
        F.when(place < FRONT, dec(FRONT_WEIGHT)).when(place < MIDDLE, dec(MIDDLE_WEIGHT)).otherwise(dec(BACK_WEIGHT))
    )


def emotion_by_doc(spans: DataFrame) -> DataFrame:
    """Weighted emotion, span and sentence counts per document.

    ``spans(doc_id, sentence_id, index, total, score DECIMAL)``. Both levels combine before their shuffle,
    and sums are exact decimals, so the result does not depend on task order.
    """
    per_sentence = spans.groupBy("doc_id", "sentence_id", "index", "total").agg(
        F.sum("score").alias("raw"), F.count(F.lit(1)).alias("n_spans")
    )
    intensity = F.least(F.col("raw"), F.lit(1).cast("decimal(20,4)"))
    weighted = intensity * position_weight(F.col("index"), F.col("total"))
    return per_sentence.groupBy("doc_id").agg(
        F.sum(weighted.cast("decimal(20,6)")).alias("weighted"),
        F.sum("n_spans").alias("span_count"),
        F.count(F.lit(1)).alias("emotional_sentences"),
    )


def document_scores(
    docs: DataFrame, classified: DataFrame, spans: DataFrame, weights: dict[str, float] = WEIGHTS
) -> DataFrame:
    """One row of scores per document; a document without sentences scores 0 throughout."""
    check_weights(weights)
    labels = classified.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("label") == "opinion_like").alias("opinion_count"),
        F.count_if(F.col("label") == "fact_like").alias("fact_count"),
    )
    joined = docs.join(labels, "doc_id", "left").join(emotion_by_doc(spans), "doc_id", "left")
    joined = joined.fillna(0, ["total", "opinion_count", "fact_count", "span_count", "emotional_sentences"])
    scored = joined.withColumns(
        {
            "_o": ratio(F.col("opinion_count"), F.col("total")),
            "_f": ratio(F.col("fact_count"), F.col("total")),
            "_e": F.least(F.lit(1.0), ratio(F.coalesce("weighted", F.lit(0)), F.col("total"))),
        }
    )
    overall = F.least(
        F.lit(1.0),
        F.col("_o") * weights["opinion"] + F.col("_e") * weights["emotion"] + (1.0 - F.col("_f")) * weights["fact"],
    )
    return scored.withColumns(
        {
            "opinion_score": round4(F.col("_o")),
            "emotion_score": round4(F.col("_e")),
            "fact_ratio": round4(F.col("_f")),
            "overall_bias_score": F.when(F.col("total") == 0, 0.0).otherwise(round4(overall)),
        }
    ).drop("_o", "_e", "_f", "weighted")


def score_map(opinion: Column, emotion: Column, fact: Column) -> Column:
    return F.create_map(F.lit("OPINION"), opinion, F.lit("EMOTIONAL"), emotion, F.lit("FACT"), fact)


def fixed2(c: Column) -> Column:
    """Two-decimal text, rounded half up."""
    return (F.floor(c * 100.0 + 0.5) / 100.0).cast("decimal(12,2)").cast("string")


def percent(c: Column) -> Column:
    """Whole percent, ties to even."""
    return F.bround(c * 100.0).cast("bigint").cast("string")


def evidence_text(df: DataFrame, gap: Column) -> Column:
    """Sentences that explain a score; needs the columns of ``document_scores``."""
    share = ratio(F.col("opinion_count"), F.col("total"))
    emotional = F.col("emotional_sentences") > 0
    text = F.concat_ws(
        " ",
        F.concat(F.lit("전체 문장 중 "), percent(share), F.lit("%가 주관적 문장입니다.")),
        F.when(
            emotional,
            F.concat(
                F.lit("감정적 표현 "), F.col("span_count").cast("string"), F.lit("건이 "),
                F.col("emotional_sentences").cast("string"), F.lit("개 문장에서 감지되었습니다."),
            ),
        ),
        F.when(
            emotional & (F.col("emotion_score") >= 0.3),
            F.concat(F.lit("감정 표현 강도가 높습니다. (감정 점수: "), fixed2(F.col("emotion_score")), F.lit(")")),
        ),
        F.when(F.col("fact_ratio") < 0.3, F.lit("사실 기반 문장 비율이 낮습니다.")),
        F.when(gap >= GAP_HIGH, F.concat(F.lit("제목과 본문 내용의 차이가 큽니다. (갭 점수: "), fixed2(gap), F.lit(")")))
        .when(gap >= GAP_MID, F.concat(F.lit("제목과 본문 사이에 다소 차이가 있습니다. (갭 점수: "), fixed2(gap), F.lit(")"))),
    )
    return F.when(F.col("total") == 0, "").otherwise(text)


# Sentences of the reason text, by score band and by score.
BAND_TEXT = [
    (20, "이 영상은 사실을 전달하는 문장이 비교적 많아 주관성 점수가 낮은 편입니다."),
    (40, "이 영상은 일부 문장에서 보도자의 해석이나 주장이 나타나 주관성 점수가 약간 있는 편입니다."),
    (60, "이 영상은 사실 전달과 보도자의 해석이나 주장이 함께 나타나 주관성 점수가 중간 수준입니다."),
    (80, "이 영상은 보도자의 해석이나 주장이 드러나는 문장이 많아 주관성 점수가 높은 편입니다."),
    (None, "이 영상은 감정적이거나 주장형 표현이 강하게 나타나 주관성 점수가 매우 높은 편입니다."),
]
OPINION_TEXT = [
    (0.45, "보도자의 해석이나 주장이 들어간 문장이 여러 곳에서 확인되어 점수에 크게 반영되었습니다."),
    (0.15, "일부 문장에서 보도자의 해석이나 주장이 섞여 점수에 반영되었습니다."),
    (None, "보도자의 해석이나 주장이 들어간 문장은 많지 않았습니다."),
]
FACT_TEXT = [
    (0.7, "대부분은 사실 전달 중심이라 점수가 크게 높아지지는 않았습니다."),
    (0.4, "사실 전달 문장도 함께 있어 점수가 중간 수준으로 조정되었습니다."),
    (None, "사실 전달보다 해석이나 주장으로 읽히는 흐름이 더 강하게 나타났습니다."),
]
EMOTION_TEXT = [
    (0.2, "의견 문장 안에서 감정이 실린 표현도 함께 감지되어 주관성 점수를 높였습니다."),
    (None, "감정이 실린 표현은 일부만 감지되어 점수에는 제한적으로 반영되었습니다."),
    ("none", "감정이 실린 표현은 거의 감지되지 않아 점수를 크게 높이지 않았습니다."),
]
BAND_NAMES = [
    (20, "주관적 표현이 낮은 구간"),
    (40, "약간의 해석이 있는 구간"),
    (60, "의견과 정보가 섞여 있는 중간 구간"),
    (80, "주관적 표현이 많은 구간"),
    (None, "감정적이거나 주장형 표현이 강한 구간"),
]


def _at_most(value: Column, table: list) -> Column:
    out = F.lit(table[-1][1])
    for bound, text in reversed(table[:-1]):
        out = F.when(value <= bound, F.lit(text)).otherwise(out)
    return out


def _at_least(value: Column, table: list) -> Column:
    out = F.lit(table[-1][1])
    for bound, text in reversed(table[:-1]):
        out = F.when(value >= bound, F.lit(text)).otherwise(out)
    return out


def score_band(overall: Column) -> Column:
    return _at_most(F.bround(overall * 100.0), BAND_NAMES)


def reason_text(overall: Column, opinion: Column, emotion: Column, fact: Column) -> Column:
    """Plain-language reason for a score from fixed sentences."""
    feeling = F.when(emotion > 0, _at_least(emotion, EMOTION_TEXT[:2])).otherwise(F.lit(EMOTION_TEXT[2][1]))
    return F.concat_ws(
        " ", _at_most(F.bround(overall * 100.0), BAND_TEXT), _at_least(opinion, OPINION_TEXT), _at_least(fact, FACT_TEXT), feeling
    )


def gap_label(score: Column, lead: Column, tail: Column, spread: Column) -> Column:
    return (
        F.when(score.isNull(), "unknown")
        .when(lead > CLICKBAIT, "clickbait")
        .when(tail - lead > BURIED, "buried_lede")
        .when((score < TRUSTWORTHY) & (spread <= UNEVEN), "trustworthy")
        .otherwise("neutral")
    )


def title_body_gap(titles: DataFrame, body: DataFrame) -> DataFrame:
    """Distance between a headline vector and its body vectors.

    ``titles(doc_id, title_vec)``, ``body(doc_id, pos, vec)`` with a numeric, unique ``pos``. Sentences are
    numbered without gathering a document in one task; vectors are summed per dimension with map-side
    combine, so a document's size only adds rows to scan.
    """
    placed = dense_position(body.withColumn("_same", F.lit(0)), ["doc_id"], "_same", "pos", "place")
    totals = body.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = placed.join(totals, "doc_id").join(titles, "doc_id").withColumn("i", F.col("place") - 1)
    tail_from = F.greatest(F.least(F.lit(LEAD), F.col("n")), F.col("n") - TAIL)
    per_dim = (
        rows.select(
            "doc_id",
            "n",
            F.exp(-DECAY * F.col("i")).alias("w"),
            (F.col("i") < LEAD).alias("in_lead"),
            (F.col("i") >= tail_from).alias("in_tail"),
            F.posexplode(F.arrays_zip(F.col("vec").alias("b"), F.col("title_vec").alias("t"))).alias("dim", "x"),
        )
        .groupBy("doc_id", "n", "dim")
        .agg(
            F.max("x.t").cast("double").alias("t"),
            F.sum(F.col("x.b").cast("double") * F.col("w")).alias("body"),
            F.sum(F.when(F.col("in_lead"), F.col("x.b").cast("double"))).alias("lead"),
            F.sum(F.when(F.col("in_tail"), F.col("x.b").cast("double"))).alias("tail"),
        )
    )

    def gap(part: str) -> Column:
        dot = F.sum(F.col(part) * F.col("t"))
        length = F.sqrt(F.sum(F.col(part) * F.col(part))) * F.sqrt(F.sum(F.col("t") * F.col("t")))
        return round4(1.0 - F.coalesce(F.try_divide(dot, length), F.lit(0.0)))

    gaps = per_dim.groupBy("doc_id", "n").agg(
        gap("body").alias("gap_score"), gap("lead").alias("gap_lead"), gap("tail").alias("_tail")
    )
    spread = (
        body.join(titles, "doc_id")
        .groupBy("doc_id")
        .agg(round4(F.stddev_pop(cosine(F.col("title_vec"), F.col("vec")))).alias("gap_std"))
    )
    out = titles.select("doc_id").join(gaps, "doc_id", "left").join(spread, "doc_id", "left")
    out = out.withColumn("gap_tail", F.when(F.col("n") > LEAD, F.col("_tail")).otherwise(F.col("gap_lead")))
    label = gap_label(F.col("gap_score"), F.col("gap_lead"), F.col("gap_tail"), F.col("gap_std"))
    return out.withColumn("gap_label", label).fillna(0.0).drop("n", "_tail")


def dataset_diagnostics(scores: DataFrame) -> DataFrame:
    """Records, spans and mean emotion score per dataset."""
    mean = F.sum(F.col("emotion_score").cast("decimal(20,4)")).cast("double") / F.count(F.lit(1))
    return scores.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("span_count").alias("spans"),
        round4(mean).alias("avg_emotion_score"),
    )


def top_facts(classified: DataFrame, n: int = TOP_FACTS) -> DataFrame:
    """Most confident fact sentences of each document, earlier ones first on a tie."""
    facts = classified.filter(F.col("label") == "fact_like")
    return top_n(facts, ["doc_id"], [F.col("confidence").desc(), F.col("sentence_order")], n)
