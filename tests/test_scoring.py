import math

import pytest
from pyspark.sql import functions as F

from medialoom.operators import keywords as K
from medialoom.operators import scoring as S

SENT = "doc_id int, sentence_id int, sentence_order int, label string, confidence double"
SPAN = "doc_id int, sentence_id int, index int, total int, score decimal(10,4)"


def spans(spark, rows):
    from decimal import Decimal

    return spark.createDataFrame([(d, s, i, t, Decimal(str(x))) for d, s, i, t, x in rows], SPAN)


def score(spark, sentences, span_rows):
    docs = spark.createDataFrame([(1,)], "doc_id int")
    rows = spark.createDataFrame([(1, i, i, label, 0.9) for i, label in enumerate(sentences)], SENT)
    return S.document_scores(docs, rows, spans(spark, span_rows)).first()


def test_no_sentences_scores_zero(spark):
    row = score(spark, [], [])
    assert (row.overall_bias_score, row.opinion_score, row.emotion_score, row.fact_ratio) == (0.0, 0.0, 0.0, 0.0)


def test_intensity_is_capped_and_front_weighted(spark):
    row = score(spark, ["opinion_like"] * 2, [(1, 0, 0, 2, 0.9), (1, 0, 0, 2, 0.9)])
    assert row.emotion_score == 0.65
    assert (row.span_count, row.emotional_sentences) == (2, 1)


def test_early_emotion_weighs_more(spark):
    early = score(spark, ["opinion_like"] * 6, [(1, 0, 0, 6, 0.8)]).emotion_score
    late = score(spark, ["opinion_like"] * 6, [(1, 5, 5, 6, 0.8)]).emotion_score
    assert early > late


def test_overall_formula(spark):
    row = score(spark, ["opinion_like", "fact_like", "fact_like", "fact_like"], [])
    assert row.overall_bias_score == pytest.approx(0.4 * 0.25 + 0.3 * 0.25, abs=1e-4)


def test_weights_must_add_up(spark):
    with pytest.raises(ValueError):
        S.check_weights({"opinion": 0.5, "emotion": 0.5, "fact": 0.5})


def test_gap_sentences(spark):
    docs = spark.createDataFrame([(1,)], "doc_id int")
    rows = spark.createDataFrame([(1, 0, 0, "opinion_like", 0.9)], SENT)
    df = S.document_scores(docs, rows, spans(spark, []))
    text = lambda g: df.select(S.evidence_text(df, F.lit(g))).first()[0]
    assert "차이가 큽니다. (갭 점수: 0.80)" in text(0.8)
    assert "다소 차이가 있습니다" in text(0.5)
    assert "갭" not in text(0.1)
    assert "100%가 주관적" in text(0.1)


def test_reason_bands(spark):
    df = spark.range(1)
    value = lambda *a: df.select(S.reason_text(*[F.lit(x) for x in a])).first()[0]
    assert value(0.1, 0.0, 0.0, 0.9).startswith("이 영상은 사실을 전달하는")
    assert "거의 감지되지 않아" in value(0.1, 0.0, 0.0, 0.9)
    assert value(0.9, 0.5, 0.3, 0.1).startswith("이 영상은 감정적이거나")


def gap(spark, title, body):
    titles = spark.createDataFrame([(1, title)], "doc_id int, title_vec array<float>")
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(body)], "doc_id int, pos int, vec array<float>")
    return S.title_body_gap(titles, rows).first()


SAME, OTHER = [1.0, 0.0], [0.0, 1.0]


def test_gap_of_one_vector(spark):
    row = gap(spark, SAME, [[math.sqrt(0.5), math.sqrt(0.5)]])
    assert (row.gap_score, row.gap_std, row.gap_lead, row.gap_tail) == (0.2929, 0.0, 0.2929, 0.2929)


def test_gap_is_front_weighted(spark):
    assert gap(spark, SAME, [SAME, OTHER]).gap_score < 0.25


@pytest.mark.parametrize(
    "body,label",
    [
        ([SAME] * 3 + [OTHER] * 3, "buried_lede"),
        ([OTHER] * 5, "clickbait"),
        ([OTHER] * 3 + [SAME] * 3, "clickbait"),
        ([SAME, OTHER], "neutral"),
        ([SAME] * 4, "trustworthy"),
    ],
)
def test_gap_labels(spark, body, label):
    assert gap(spark, SAME, body).gap_label == label


def test_gap_without_body_is_unknown(spark):
    titles = spark.createDataFrame([(1, SAME)], "doc_id int, title_vec array<float>")
    empty = spark.createDataFrame([], "doc_id int, pos int, vec array<float>")
    row = S.title_body_gap(titles, empty).first()
    assert (row.gap_label, row.gap_score) == ("unknown", 0.0)


def test_keyword_shares(spark):
    rows = spark.createDataFrame([(1, "분노", 0.5), (1, "분노", 0.5), (1, "불안", 1.0)], "doc_id int, keyword string, s double")
    got = {r.keyword: r.score for r in K.keyword_shares(rows, F.col("s"), ["doc_id"]).collect()}
    assert got == {"분노": 0.5, "불안": 0.5}


def plain_quota(rows, limit=5, quota=2):
    """Stepwise statement of the quota on (keyword, score) rows in rank order."""
    picked = rows[:limit]
    missing = quota - sum(not k.endswith("다") for k, _ in picked)
    spare = [r for r in rows[limit:] if not r[0].endswith("다")]
    for slot in range(len(picked) - 1, -1, -1):
        if missing <= 0 or not spare:
            break
        if picked[slot][0].endswith("다"):
            picked[slot] = spare.pop(0)
            missing -= 1
    return [k for k, _ in picked]


def test_noun_quota_equals_the_stepwise_rule(spark):
    import random

    rng = random.Random(3)
    rows, want = [], {}
    for d in range(60):
        n = rng.randint(1, 12)
        words = [(f"w{i}" + ("다" if rng.random() < 0.7 else ""), round(1 - i * 0.05, 2)) for i in range(n)]
        rows += [(d, k, s) for k, s in words]
        want[d] = plain_quota(words)
    df = spark.createDataFrame(rows, "doc_id int, keyword string, score double")
    out = K.with_noun_quota(df, ["doc_id"], [F.col("score").desc(), F.col("keyword")])
    got: dict[int, list] = {}
    for r in out.orderBy("doc_id", "slot").collect():
        got.setdefault(r.doc_id, []).append(r.keyword)
    assert got == want


def test_focus_keywords(spark):
    words = [(0, "정책"), (1, "정책"), (2, "정책"), (0, "경제"), (1, "사회")]
    tokens = spark.createDataFrame([(1, s, w, w, "NNG") for s, w in words], "doc_id int, sentence_id int, form string, surface string, tag string")
    totals = spark.createDataFrame([(1, 3)], "doc_id int, total int")
    rows = K.focus_keywords(tokens, totals).collect()
    assert [(r.keyword, r.occurrence_count, r.sentence_count, r.score) for r in rows] == [("정책", 3, 3, 1.0)]


def test_emotion_keyword_forms(spark):
    df = spark.createDataFrame(
        [("무섭게", "VA", "무섭", "EC", "게"), ("불쾌하게", "XR", "불쾌", "XSA", "하"), ("걱정하는", "NNG", "걱정", "XSV", "하"), ("분노", "NNG", "분노", None, None)],
        "w string, t1 string, f1 string, t2 string, f2 string",
    )
    got = [r[0] for r in df.select(K.emotion_keyword(*[F.col(c) for c in ("w", "t1", "f1", "t2", "f2")])).collect()]
    assert got == ["무섭다", "불쾌하다", "걱정하다", "분노"]
