"""Document score, gap, reason, keyword and evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialoom.functions.columns import among, round4
from medialoom.functions.lexemes import FOCUS_STOPWORDS, KEYWORD_STOPWORDS
from medialoom.operators import keywords as K
from medialoom.operators import scoring as S
from medialoom.plans.registry import query
from medialoom.plans.sqlviews import VIEWS, s_in, s_round4, with_views
from medialoom.sources import views as V

VIEWS["scores"] = (
    ("classified", "lspans"),
    f"""SELECT *, {s_round4('o')} AS opinion_score, {s_round4('e')} AS emotion_score, {s_round4('f')} AS fact_ratio,
    CASE WHEN total = 0 THEN 0::DOUBLE ELSE {s_round4("least(1::DOUBLE, o * 0.4::DOUBLE + e * 0.3::DOUBLE + (1::DOUBLE - f) * 0.3::DOUBLE)")} END
    AS overall_bias_score FROM (SELECT *, coalesce(opinion_count::DOUBLE / nullif(total, 0), 0::DOUBLE) AS o,
    coalesce(fact_count::DOUBLE / nullif(total, 0), 0::DOUBLE) AS f,
    least(1::DOUBLE, coalesce(weighted::DOUBLE / nullif(total, 0), 0::DOUBLE)) AS e FROM (SELECT d.doc_id, d.lang,
    coalesce(c.total, 0) AS total, coalesce(opinion_count, 0) AS opinion_count, coalesce(fact_count, 0) AS fact_count,
    coalesce(span_count, 0)::BIGINT AS span_count, coalesce(emotional_sentences, 0) AS emotional_sentences, coalesce(weighted, 0) AS weighted
    FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS total, count(*) FILTER (label = 'opinion_like') AS opinion_count,
    count(*) FILTER (label = 'fact_like') AS fact_count FROM classified GROUP BY 1) c USING (doc_id)
    LEFT JOIN (SELECT doc_id, sum(least(raw, 1::DECIMAL(20,4)) * w) AS weighted, sum(n) AS span_count, count(*) AS emotional_sentences
    FROM (SELECT doc_id, sum(score) AS raw, count(*) AS n, CASE WHEN total <= 1 OR idx / total < 0.33::DOUBLE THEN 1.3::DECIMAL(4,2)
    WHEN idx / total < 0.66::DOUBLE THEN 1.0::DECIMAL(4,2) ELSE 0.8::DECIMAL(4,2) END AS w FROM lspans
    GROUP BY doc_id, sentence_id, idx, total) GROUP BY 1) USING (doc_id)))""",
)
_GAP = "((length(split_part(text, chr(10), 1)) % 100) / 100::DOUBLE)"
_SCORE_COLS = "opinion_score, emotion_score, fact_ratio, overall_bias_score"


def doc_scores(spark, sf, classified=None):
    docs = V.table(spark, sf, "documents").select("doc_id")
    rows = V.classified(spark, sf).select("doc_id", "label") if classified is None else classified
    return S.document_scores(docs, rows, V.lexicon_spans(spark, sf))


@query("doc_bias_score", with_views("scores", f"SELECT doc_id, total, opinion_count, span_count, emotional_sentences, {_SCORE_COLS} FROM scores"))
def doc_bias_score(spark, sf):
    return doc_scores(spark, sf).select(
        "doc_id", "total", "opinion_count", "span_count", "emotional_sentences", *_SCORE_COLS.split(", ")
    )


def with_gap(spark, sf):
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    gap = V.table(spark, sf, "documents").select("doc_id", ((F.length(title) % 100) / 100.0).alias("gap"))
    return doc_scores(spark, sf).join(gap, "doc_id")


def _fixed2(e):
    return f"(floor(({e}) * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE)::DECIMAL(12,2)::VARCHAR"


def _pct(e):
    return f"round_even(({e}) * 100::DOUBLE, 0)::BIGINT::VARCHAR"


_EVIDENCE = f"""CASE WHEN total = 0 THEN '' ELSE concat_ws(' ', '전체 문장 중 ' || {_pct('opinion_count / total')} || '%가 주관적 문장입니다.',
CASE WHEN emotional_sentences > 0 THEN '감정적 표현 ' || span_count::VARCHAR || '건이 ' || emotional_sentences::VARCHAR || '개 문장에서 감지되었습니다.' END,
CASE WHEN emotional_sentences > 0 AND emotion_score >= 0.3::DOUBLE THEN '감정 표현 강도가 높습니다. (감정 점수: ' || {_fixed2('emotion_score')} || ')' END,
CASE WHEN fact_ratio < 0.3::DOUBLE THEN '사실 기반 문장 비율이 낮습니다.' END,
CASE WHEN gap >= 0.7::DOUBLE THEN '제목과 본문 내용의 차이가 큽니다. (갭 점수: ' || {_fixed2('gap')} || ')'
WHEN gap >= 0.4::DOUBLE THEN '제목과 본문 사이에 다소 차이가 있습니다. (갭 점수: ' || {_fixed2('gap')} || ')' END) END"""


@query(
    "score_evidence",
    with_views("scores", f"SELECT doc_id, {_EVIDENCE} AS score_evidence FROM (SELECT s.*, {_GAP} AS gap FROM scores s JOIN documents USING (doc_id))"),
)
def score_evidence(spark, sf):
    df = with_gap(spark, sf)
    return df.select("doc_id", S.evidence_text(df, F.col("gap")).alias("score_evidence"))


def _le(value, table):
    arms = " ".join(f"WHEN {value} <= {b} THEN '{t}'" for b, t in table[:-1])
    return f"CASE {arms} ELSE '{table[-1][1]}' END"


def _ge(value, table):
    arms = " ".join(f"WHEN {value} >= {b}::DOUBLE THEN '{t}'" for b, t in table[:-1])
    return f"CASE {arms} ELSE '{table[-1][1]}' END"


_POINTS = "round_even(overall_bias_score * 100::DOUBLE, 0)"
_REASON = f"""concat_ws(' ', {_le(_POINTS, S.BAND_TEXT)}, {_ge('opinion_score', S.OPINION_TEXT)}, {_ge('fact_ratio', S.FACT_TEXT)},
CASE WHEN emotion_score > 0 THEN {_ge('emotion_score', S.EMOTION_TEXT[:2])} ELSE '{S.EMOTION_TEXT[2][1]}' END)"""


@query("score_reason", with_views("scores", f"SELECT doc_id, {_le(_POINTS, S.BAND_NAMES)} AS score_band, {_REASON} AS reason FROM scores"))
def score_reason(spark, sf):
    return doc_scores(spark, sf).select(
        "doc_id",
        S.score_band(F.col("overall_bias_score")).alias("score_band"),
        S.reason_text(*[F.col(c) for c in ("overall_bias_score", "opinion_score", "emotion_score", "fact_ratio")]).alias("reason"),
    )


def _dimsum(cond):
    return f"sum(CASE WHEN {cond} THEN v END)"


_COS = "1::DOUBLE - coalesce(sum({p} * t) / nullif(sqrt(sum({p} * {p})) * sqrt(sum(t * t)), 0), 0::DOUBLE)"


@query(
    "title_body_gap",
    f"""WITH t AS (SELECT label AS doc_id, arg_min(embedding, vec_id)::DOUBLE[] AS tv, min(vec_id) AS tid FROM embeddings GROUP BY 1),
    b AS (SELECT label AS doc_id, vec_id, embedding::DOUBLE[] AS vec, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i,
    count(*) OVER (PARTITION BY label) AS n FROM embeddings JOIN t ON label = doc_id AND vec_id <> tid),
    x AS (SELECT b.doc_id, n, i, unnest(vec) AS v, unnest(tv) AS t, generate_subscripts(vec, 1) AS dim FROM b JOIN t USING (doc_id)),
    d AS (SELECT doc_id, n, dim, max(t) AS t, sum(v * exp(-0.3::DOUBLE * i)) AS body, {_dimsum('i < 3')} AS lead,
    {_dimsum('i >= greatest(least(3, n), n - 3)')} AS tail FROM x GROUP BY ALL),
    g AS (SELECT doc_id, n, {s_round4(_COS.format(p='body'))} AS gap_score, {s_round4(_COS.format(p='lead'))} AS gap_lead,
    {s_round4(_COS.format(p='tail'))} AS raw_tail FROM d GROUP BY ALL),
    sd AS (SELECT b.doc_id, {s_round4('stddev_pop(list_cosine_similarity(vec, tv))')} AS gap_std FROM b JOIN t USING (doc_id) GROUP BY 1)
    SELECT *, CASE WHEN gap_lead > 0.4::DOUBLE THEN 'clickbait' WHEN gap_tail - gap_lead > 0.4::DOUBLE THEN 'buried_lede'
    WHEN gap_score < 0.3::DOUBLE AND gap_std <= 0.2::DOUBLE THEN 'trustworthy' ELSE 'neutral' END AS gap_label FROM (
    SELECT doc_id, gap_score, gap_lead, CASE WHEN n > 3 THEN raw_tail ELSE gap_lead END AS gap_tail, gap_std FROM g JOIN sd USING (doc_id))""",
)
def title_body_gap(spark, sf):
    emb = V.table(spark, sf, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))
    first = emb.groupBy("doc_id").agg(F.min("pos").alias("first"), F.min_by("vec", "pos").alias("title_vec"))
    body = emb.join(first.select("doc_id", "first"), "doc_id").filter(F.col("pos") != F.col("first")).drop("first")
    return S.title_body_gap(first.select("doc_id", "title_vec"), body)


@query(
    "dataset_diagnostics",
    with_views(
        "scores",
        f"""SELECT CASE WHEN quality = 1 THEN 'B' ELSE 'A' END AS dataset, count(*) AS records, sum(span_count)::BIGINT AS spans,
        {s_round4('sum(emotion_score::DECIMAL(20,4))::DOUBLE / count(*)')} AS avg_emotion_score FROM scores JOIN labels USING (doc_id) GROUP BY 1""",
    ),
)
def dataset_diagnostics(spark, sf):
    sets = V.table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "B").otherwise("A").alias("dataset"))
    return S.dataset_diagnostics(doc_scores(spark, sf).join(sets, "doc_id"))


@query(
    "top_facts",
    with_views(
        "classified",
        f"""SELECT doc_id, rank::INT AS rank, sentence_id, {s_round4('confidence')} AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
        ORDER BY confidence DESC, sentence_order) AS rank FROM classified WHERE label = 'fact_like') WHERE rank <= 10""",
    ),
)
def top_facts(spark, sf):
    return S.top_facts(V.classified(spark, sf)).select("doc_id", "rank", "sentence_id", round4(F.col("confidence")).alias("confidence"))


# --- keywords ----------------------------------------------------------------------------------------

_STOP = s_in(KEYWORD_STOPWORDS)
VIEWS["ekw"] = (
    ("lspans", "blocked"),
    f"""SELECT doc_id, keyword, sum(score) AS weight FROM (SELECT doc_id, score, CASE WHEN regexp_matches(matched_word, 'ing$|(est|ous)$')
    AND NOT regexp_matches(matched_word, '^[0-9]+$|^[A-Z]') AND NOT (regexp_matches(matched_word, 'ly$'))
    THEN matched_word || '다' ELSE matched_word END AS keyword FROM lspans)
    WHERE length(keyword) >= 2 AND lower(keyword) NOT IN {_STOP} AND keyword NOT IN (SELECT word FROM blocked)
    AND regexp_replace(keyword, '^[0-9]+', '') NOT IN (SELECT word FROM blocked)
    AND (keyword LIKE '%다' OR (keyword || '다' NOT IN (SELECT word FROM blocked) AND keyword || '하다' NOT IN (SELECT word FROM blocked)))
    GROUP BY 1, 2""",
)
_SHARE = s_round4("weight::DOUBLE / (sum(weight) OVER (PARTITION BY {g}))::DOUBLE")


def s_quota(src: str, group: str, order: str) -> str:
    """Top five per group with at least two nouns, over columns keyword and score of ``src``."""
    g = group
    using = group
    return f"""WITH r AS (SELECT *, NOT ends_with(keyword, '다') AS is_noun, row_number() OVER (PARTITION BY {g} ORDER BY {order}) AS slot FROM {src}),
    h AS (SELECT *, greatest(0, 2 - count(*) FILTER (is_noun) OVER (PARTITION BY {g})) AS missing,
    row_number() OVER (PARTITION BY {g}, is_noun ORDER BY slot DESC) AS j FROM r WHERE slot <= 5),
    sp AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY slot) AS j FROM r WHERE is_noun AND slot > 5)
    SELECT {', '.join('h.' + c for c in group.split(', '))}, h.slot::INT AS slot, coalesce(sp.keyword, h.keyword) AS keyword, coalesce(sp.score, h.score) AS score
    FROM h LEFT JOIN (SELECT {using}, j, keyword, score FROM sp) sp ON {' AND '.join(f'h.{c} = sp.{c}' for c in group.split(', '))}
    AND NOT h.is_noun AND h.j <= h.missing AND h.j = sp.j"""


def emotion_keyword_rows(spark, sf):
    from medialoom.operators import tagging

    spans = V.lexicon_spans(spark, sf)
    tag = V.tag_of(F.col("matched_word"))
    none = F.lit(None).cast("string")
    rows = spans.withColumn("keyword", K.emotion_keyword(F.col("matched_word"), tag, F.col("matched_word"), none, none))
    rows = rows.filter((F.length("keyword") >= 2) & ~K.stopword(F.col("keyword")))
    return tagging.mark_blocked(rows, V.blocked_words(spark, sf), "keyword", "keyword").filter(~F.col("blocked"))


@query(
    "emotion_keywords",
    with_views(
        "ekw",
        f"""WITH s AS (SELECT doc_id, keyword, {_SHARE.format(g='doc_id')} AS score FROM ekw),
        {s_quota('s', 'doc_id', 'score DESC, keyword')[5:]}""",
    ),
)
def emotion_keywords(spark, sf):
    shares = K.keyword_shares(emotion_keyword_rows(spark, sf), F.col("score"), ["doc_id"]).drop("weight")
    return K.with_noun_quota(shares, ["doc_id"], [F.col("score").desc(), F.col("keyword")])


VIEWS["ftkw"] = (
    ("words",),
    f"""SELECT doc_id, keyword_type, keyword, {_SHARE.format(g='doc_id, keyword_type')} AS score FROM (SELECT doc_id, keyword_type, keyword,
    sum(confidence::DECIMAL(20,4)) AS weight FROM (SELECT doc_id, confidence, CASE WHEN label = 'opinion_like' THEN 'FRAME' ELSE 'TOPIC' END AS keyword_type,
    CASE WHEN tag IN ('NNG', 'NNP') THEN form WHEN tag = 'VV' AND label = 'opinion_like' THEN form || '다' END AS keyword FROM words)
    WHERE length(keyword) >= 2 AND lower(keyword) NOT IN {_STOP} GROUP BY 1, 2, 3)""",
)


def frame_topic_shares(spark, sf):
    # Turned into a decimal once per sentence; with eight digits it is summed as a long number.
    sentences = V.classified_by_document(spark, sf).withColumn("confidence", F.col("confidence").cast("decimal(8,4)"))
    opinion = F.col("label") == "opinion_like"
    made = lambda form, tag: F.when(opinion, K.morpheme_keyword(form, tag, K.FRAME_TAGS)).otherwise(K.morpheme_keyword(form, tag, K.TOPIC_TAGS))
    words = V.keywords_in(sentences.select("doc_id", "label", "confidence", "sentence_text"), made)
    rows = words.withColumn("keyword_type", F.when(opinion, "FRAME").otherwise("TOPIC")).filter(~among(F.lower("keyword"), KEYWORD_STOPWORDS))
    return K.keyword_shares(rows, F.col("confidence"), ["doc_id", "keyword_type"]).drop("weight")


@query(
    "frame_topic_keywords",
    with_views(
        "ftkw",
        """SELECT doc_id, keyword_type, rank::INT AS rank, keyword, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, keyword_type
        ORDER BY score DESC, keyword) AS rank FROM ftkw) WHERE rank <= 5""",
    ),
)
def frame_topic_keywords(spark, sf):
    from medialoom.functions.ranking import top_n

    return top_n(
        frame_topic_shares(spark, sf), ["doc_id", "keyword_type"], [F.col("score").desc(), F.col("keyword")], K.TOP_N
    ).select("doc_id", "keyword_type", "rank", "keyword", "score")


@query("keyword_quota", with_views("ftkw", s_quota("ftkw", "doc_id, keyword_type", "score DESC, keyword")))
def keyword_quota(spark, sf):
    return K.with_noun_quota(
        frame_topic_shares(spark, sf), ["doc_id", "keyword_type"], [F.col("score").desc(), F.col("keyword")]
    )


_FOCUS = s_in(FOCUS_STOPWORDS)
VIEWS["fwords"] = (
    ("words",),
    f"""SELECT doc_id, sentence_id, total, form, CASE WHEN tag IN ('NNG', 'NNP') THEN form WHEN tag = 'VV' THEN form || '다' END AS keyword
    FROM words WHERE tag IN ('NNG', 'NNP', 'VV') AND lower(form) NOT IN {_FOCUS}
    AND lower(CASE WHEN tag = 'VV' THEN form || '다' ELSE form END) NOT IN {_FOCUS}""",
)


def focus_tokens(spark, sf):
    """Keywords of the tokens; a form is its own surface."""
    sentences = V.classified_by_document(spark, sf).select("doc_id", "sentence_id", "total", "sentence_text")
    words = V.keywords_in(sentences, lambda form, tag: F.when(~among(F.lower(form), FOCUS_STOPWORDS), K.focus_keyword(form, tag)))
    return words.filter((F.length("keyword") >= 2) & ~among(F.lower("keyword"), FOCUS_STOPWORDS))


@query(
    "focus_keywords",
    with_views(
        "fwords",
        f"""WITH c AS (SELECT doc_id, keyword, max(total) AS total, count(*) AS occurrence_count, count(DISTINCT sentence_id) AS sentence_count
        FROM fwords GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT sentence_id) >= 2),
        s AS (SELECT doc_id, keyword, occurrence_count, sentence_count, {s_round4("least(1::DOUBLE, 0.8::DOUBLE * (sentence_count / total) + 0.2::DOUBLE * (occurrence_count / max(occurrence_count) OVER (PARTITION BY doc_id)))")} AS score FROM c),
        {s_quota('s', 'doc_id', 'sentence_count DESC, occurrence_count DESC, score DESC, keyword')[5:]}""",
    ),
)
def focus_keywords(spark, sf):
    ranked = K.focus_keywords(focus_tokens(spark, sf))
    return K.with_noun_quota(ranked, ["doc_id"], K.focus_order()).select("doc_id", "slot", "keyword", "score")


@query(
    "focus_surface",
    """SELECT keyword, display_text FROM (SELECT keyword, surface AS display_text, row_number() OVER (PARTITION BY keyword ORDER BY n DESC,
    surface <> keyword, surface) AS rn FROM (SELECT lower(form) AS keyword, form AS surface, count(*) AS n FROM (SELECT
    unnest(regexp_extract_all(text, '[A-Za-z0-9가-힣]{2,}')) AS form FROM documents) GROUP BY 1, 2)) WHERE rn = 1""",
)
def focus_surface(spark, sf):
    from medialoom.functions.columns import tokens

    words = V.table(spark, sf, "documents").select(F.explode(tokens(F.col("text"))).alias("surface"))
    return K.display_surface(words.withColumn("keyword", F.lower("surface")))


@query(
    "evidence_rows",
    with_views(
        "classified lspans",
        f"""SELECT l.doc_id, l.sentence_id, 'EMOTION' AS evidence_type, '감정적 표현' AS title, sentence_text AS description,
        matched_word AS source_text, {s_round4('least(1::DOUBLE, score::DOUBLE)')} AS confidence FROM lspans l JOIN classified USING (doc_id, sentence_id)
        UNION ALL SELECT doc_id, sentence_id, 'OPINION', '주관적 의견', sentence_text, substr(sentence_text, 1, 10), 0.5::DOUBLE
        FROM classified WHERE contains(sentence_text, '?')
        UNION ALL SELECT doc_id, sentence_id, 'OPINION', '주관적 의견', sentence_text, sentence_text, {s_round4('confidence')}
        FROM classified WHERE label = 'opinion_like'""",
    ),
)
def evidence_rows(spark, sf):
    from medialoom.functions.columns import bounded_broadcast, tokens

    sents = V.classified(spark, sf)
    opinions = sents.filter(F.col("label") == "opinion_like")
    lookup = bounded_broadcast(V.lexicon(spark, sf).select("word", F.col("score_hint").alias("score")))
    words = opinions.withColumn("matched_word", F.explode(tokens(F.col("sentence_text"))))
    shape = ["doc_id", "sentence_id", "sentence_text", "label_type", "matched_word", "start_offset", "end_offset", "score"]
    emotion = words.join(lookup, F.lower("matched_word") == F.col("word")).withColumns(
        {"label_type": F.lit("EMOTIONALLY_LOADED"), "start_offset": F.lit(0), "end_offset": F.lit(0)}
    )
    asking = sents.filter(F.contains("sentence_text", F.lit("?"))).withColumns(
        {
            "label_type": F.lit("OPINION_LIKE"),
            "matched_word": F.lit(None).cast("string"),
            "start_offset": F.lit(0),
            "end_offset": F.lit(10),
            "score": F.lit("0.5").cast("decimal(10,4)"),
        }
    )
    return K.evidence_rows(sents, emotion.select(*shape).unionByName(asking.select(*shape)))


@query(
    "doc_result",
    with_views(
        "scores classified ftkw",
        f"""WITH kw AS (SELECT doc_id, string_agg(keyword_type || ':' || keyword, '|' ORDER BY keyword_type, rank) AS keywords FROM (SELECT *,
        row_number() OVER (PARTITION BY doc_id, keyword_type ORDER BY score DESC, keyword) AS rank FROM ftkw) WHERE rank <= 5 GROUP BY 1),
        tf AS (SELECT doc_id, string_agg(sentence_id::VARCHAR, ',' ORDER BY rank) AS fact_ids FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
        ORDER BY confidence DESC, sentence_order) AS rank FROM classified WHERE label = 'fact_like') WHERE rank <= 10 GROUP BY 1)
        SELECT doc_id, split_part(text, chr(10), 1) AS title, d.lang AS language, {_SCORE_COLS}, coalesce(keywords, '') AS keywords,
        coalesce(fact_ids, '') AS fact_ids FROM documents d JOIN scores USING (doc_id) LEFT JOIN kw USING (doc_id) LEFT JOIN tf USING (doc_id)""",
    ),
)
def doc_result(spark, sf):
    kw = frame_topic_keywords(spark, sf).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("keyword_type", "rank", "keyword"))).alias("k")
    )
    kw = kw.select("doc_id", F.array_join(F.transform("k", lambda x: F.concat(x["keyword_type"], F.lit(":"), x["keyword"])), "|").alias("keywords"))
    facts = S.top_facts(V.classified(spark, sf).select("doc_id", "sentence_id", "sentence_order", "confidence", "label"))
    facts = facts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "sentence_id"))).alias("f"))
    facts = facts.select("doc_id", F.array_join(F.transform("f", lambda x: x["sentence_id"].cast("string")), ",").alias("fact_ids"))
    heads = V.table(spark, sf, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("lang").alias("language"))
    out = heads.join(doc_scores(spark, sf), "doc_id").join(kw, "doc_id", "left").join(facts, "doc_id", "left")
    return out.select("doc_id", "title", "language", *_SCORE_COLS.split(", "), F.coalesce("keywords", F.lit("")).alias("keywords"), F.coalesce("fact_ids", F.lit("")).alias("fact_ids"))
