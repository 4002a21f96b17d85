"""Lexicon building and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialoom.functions.lexemes import NEWS_MODIFIERS, NEWS_TOPICS
from medialoom.operators import lexicon as L
from medialoom.operators import text as T
from medialoom.plans.registry import query
from medialoom.plans.sqlviews import VIEWS, s_in, s_list, s_round4, s_sentences, s_tag, with_views
from medialoom.sources import views as V

LATIN = "[a-z]{2}"
NOUNS = ["the", "that", "thing", "rest", "her"]
KEEP, BLOCK, CONTEXT = ["the", "her"], ["to", "of", "in"], ["is", "it"]

VIEWS["lblock"] = (("decisions",), "SELECT word FROM decisions WHERE section = 'review_pending' AND word LIKE 'th%'")
VIEWS["dictionary"] = (
    (),
    f"""SELECT item_id * 100000 + i AS row_id, w[1] || coalesce(' ' || w[2], '') || coalesce(' ' || w[3], '') AS word, CASE WHEN i % 5 = 0 THEN ' ' ELSE lower(w[1] || coalesce(' ' || w[2], '')) END AS word_root,
    CASE length(s) % 4 WHEN 0 THEN 'x' WHEN 1 THEN '-1' WHEN 2 THEN ' 1 ' ELSE '-2' END AS polarity FROM (SELECT item_id, s, i, regexp_split_to_array(s, ' ') AS w FROM (SELECT item_id,
    unnest(l) AS s, generate_subscripts(l, 1) - 1 AS i FROM (SELECT item_id, {s_sentences('text')} AS l FROM benchmark)))""",
)


def _contents(text):
    return f"""list_filter(list_transform(regexp_extract_all({text}, '[A-Za-z0-9가-힣]{{2,}}'), lambda f: {{'form': f, 'tag': {s_tag('f')}}}), lambda p: regexp_matches(p.form, '{LATIN}'))"""


_GENERIC = "(form IN (SELECT word FROM lblock) OR form || '다' IN (SELECT word FROM lblock) OR form || '하다' IN (SELECT word FROM lblock))"
VIEWS["cleaned"] = (
    ("dictionary", "lblock"),
    f"""SELECT row_id, word, word_root, polarity, reject_reason, CASE WHEN reject_reason IS NULL THEN seed END AS clean_seed, CASE WHEN reject_reason IS NOT NULL THEN NULL
    WHEN seed IN {s_in(NOUNS)} THEN 'DIRECT_EMOTION' WHEN polarity < 0 THEN 'NEGATIVE_STATE' ELSE 'EVALUATIVE_WORD' END AS category FROM (SELECT b.*, seed, CASE WHEN polarity IS NULL THEN 'invalid_polarity'
    WHEN source_text = '' THEN 'empty_text' WHEN NOT regexp_matches(source_text, '{LATIN}') THEN 'non_korean' WHEN seed IS NULL THEN 'no_emotion_candidate' END AS reject_reason FROM (
    SELECT row_id, trim(word) AS word, trim(word_root) AS word_root, nullif(try_cast(trim(polarity) AS INT), 0) AS polarity, CASE WHEN trim(word_root) <> '' THEN trim(word_root) ELSE trim(word) END AS source_text FROM dictionary) b
    LEFT JOIN (SELECT row_id, arg_min(seed, kind * 1000 + place) AS seed FROM (SELECT *, CASE WHEN tag = 'NNG' AND form IN {s_in(NOUNS)} THEN 1 WHEN tag IN ('VV', 'VA') THEN 2 WHEN tag = 'XR' THEN 3 END AS kind,
    CASE WHEN tag = 'NNG' THEN form WHEN tag IN ('VV', 'VA') THEN form || '다' ELSE form || '하다' END AS seed FROM (SELECT row_id, p.form AS form, p.tag AS tag, place FROM (SELECT row_id, unnest(c) AS p,
    generate_subscripts(c, 1) AS place FROM (SELECT row_id, {_contents("CASE WHEN trim(word_root) <> '' THEN trim(word_root) ELSE trim(word) END")} AS c FROM dictionary))) WHERE NOT {_GENERIC}) WHERE kind IS NOT NULL GROUP BY 1) s USING (row_id))""",
)
VIEWS["surfaces"] = (
    ("cleaned", "lblock"),
    f"""SELECT embed_text, polarity, clean_seed AS canonical_seed, coalesce(category, 'BROAD_KNU') AS category, row_id FROM (SELECT *, row_number() OVER (PARTITION BY embed_text, polarity ORDER BY row_id, place) AS rn FROM (
    SELECT row_id, polarity, clean_seed, category, 0 AS place, word AS embed_text FROM cleaned UNION ALL SELECT row_id, polarity, clean_seed, category, 1, word_root FROM cleaned) WHERE polarity IS NOT NULL AND embed_text <> ''
    AND regexp_matches(embed_text, '{LATIN}')) t WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM lblock b WHERE contains(replace(t.embed_text, ' ', ''), b.word))""",
)


def dictionary(spark, sf):
    pieces = T.split_sentences(V.table(spark, sf, "benchmark").select("item_id", "text"), "text")
    w = F.split("sentence_text", " ")
    at = lambda i: F.get(w, F.lit(i))
    size = F.length("sentence_text") % 4
    return pieces.select(
        (F.col("item_id") * 100000 + F.col("sentence_id")).alias("row_id"),
        F.concat_ws(" ", at(0), at(1), at(2)).alias("word"),
        F.when(F.col("sentence_id") % 5 == 0, " ").otherwise(F.lower(F.concat_ws(" ", at(0), at(1)))).alias("word_root"),
        F.when(size == 0, "x").when(size == 1, "-1").when(size == 2, " 1 ").otherwise("-2").alias("polarity"),
    )


def block_words(spark, sf):
    rows = V.decisions(spark, sf).filter(F.col("section") == "review_pending")
    return rows.select(F.trim("item").alias("word")).filter(F.col("word").startswith("th"))


def cleaned(spark, sf):
    return L.clean_dictionary(dictionary(spark, sf), block_words(spark, sf), V.tag_of, LATIN, NOUNS)


@query("lexicon_clean", with_views("cleaned", "SELECT * FROM cleaned"))
def lexicon_clean(spark, sf):
    return cleaned(spark, sf)


@query("lexicon_surface", with_views("surfaces", "SELECT * FROM surfaces"))
def lexicon_surface(spark, sf):
    return L.surface_rows(cleaned(spark, sf), block_words(spark, sf), V.tag_of, LATIN)


_LABELS = """list_filter([CASE WHEN contains(sentence_text, '!') THEN '화남/분노' END, CASE WHEN contains(sentence_text, '?') THEN '의심/불신' END, CASE WHEN length(sentence_text) % 2 = 1 THEN '기쁨' END,
CASE WHEN length(sentence_text) % 2 = 0 THEN '슬픔' END, CASE WHEN length(sentence_text) % 11 = 0 THEN '없음' END], lambda x: x IS NOT NULL)"""
VIEWS["mined"] = (
    ("prepared", "lblock"),
    f"""SELECT embed_text, CASE WHEN neg_count >= pos_count THEN -1 ELSE 1 END AS polarity, CASE WHEN embed_text IN {s_in(NOUNS)} THEN 'DIRECT_EMOTION' WHEN neg_count >= pos_count THEN 'NEGATIVE_STATE' ELSE 'EVALUATIVE_WORD' END AS category,
    {s_round4('greatest(neg_count, pos_count) / (neg_count + pos_count)')} AS score_hint, neg_count + pos_count AS count_hint, neg_count, pos_count FROM (SELECT embed_text, sum(neg)::BIGINT AS neg_count, sum(pos)::BIGINT AS pos_count FROM (
    SELECT CASE WHEN {s_tag('form')} = 'NNG' AND form IN {s_in(NOUNS)} THEN form WHEN {s_tag('form')} IN ('VV', 'VA') THEN form || '다' WHEN {s_tag('form')} = 'XR' THEN form || '하다' END AS embed_text, neg, pos FROM (SELECT form,
    count(*) FILTER (sign < 0) AS neg, count(*) FILTER (sign > 0) AS pos FROM (SELECT unnest(list_distinct(w)) AS form, sign FROM (SELECT regexp_extract_all(sentence_text, '[A-Za-z0-9가-힣]{{2,}}') AS w,
    CASE WHEN list_contains(labels, '없음') THEN NULL WHEN n > p THEN -1 WHEN p > n THEN 1 END AS sign FROM (SELECT *, len(list_filter(labels, lambda x: x IN ('화남/분노', '의심/불신', '슬픔'))) AS n,
    len(list_filter(labels, lambda x: x = '기쁨')) AS p FROM (SELECT sentence_text, {_LABELS} AS labels FROM prepared))) WHERE sign IS NOT NULL) WHERE regexp_matches(form, '{LATIN}') GROUP BY 1) WHERE NOT {_GENERIC})
    WHERE embed_text IS NOT NULL GROUP BY 1) WHERE neg_count + pos_count >= 20 AND greatest(neg_count, pos_count) / (neg_count + pos_count) >= 0.6::DOUBLE""",
)


def mined(spark, sf):
    t = F.col("sentence_text")
    labels = F.array_compact(
        F.array(
            F.when(F.contains(t, F.lit("!")), "화남/분노"), F.when(F.contains(t, F.lit("?")), "의심/불신"), F.when(F.length(t) % 2 == 1, "기쁨"),
            F.when(F.length(t) % 2 == 0, "슬픔"), F.when(F.length(t) % 11 == 0, "없음"),
        )
    )
    corpus = V.prepared(spark, sf).select(t.alias("text"), labels.alias("labels"))
    return L.mine_lexicon(corpus, block_words(spark, sf), V.tag_of, LATIN, NOUNS, min_ratio=0.6)


@query("lexicon_mine", with_views("mined", "SELECT * FROM mined"))
def lexicon_mine(spark, sf):
    return mined(spark, sf)


VIEWS["seeds"] = (
    ("cleaned",),
    "SELECT clean_seed AS embed_text, polarity, arg_min(category, row_id) AS category FROM cleaned WHERE reject_reason IS NULL GROUP BY 1, 2",
)


@query(
    "lexicon_merge",
    with_views(
        "seeds mined",
        """SELECT embed_text, polarity, coalesce(s.category, m.category) AS category, concat_ws('+', CASE WHEN s.category IS NOT NULL THEN 'knu' END, CASE WHEN m.category IS NOT NULL THEN 'kote' END) AS source,
        score_hint, count_hint FROM seeds s FULL JOIN mined m USING (embed_text, polarity)""",
    ),
)
def lexicon_merge(spark, sf):
    seeds = L.first_per_key(
        cleaned(spark, sf).filter("reject_reason IS NULL").select(F.col("clean_seed").alias("embed_text"), "polarity", "category", "row_id"),
        ["embed_text", "polarity"],
        ["row_id"],
    )
    return L.merge_lexicons(seeds, mined(spark, sf))


@query(
    "lexicon_v1",
    with_views(
        "dictionary",
        f"""SELECT embed_text, row_id, word_root, polarity FROM (SELECT *, row_number() OVER (PARTITION BY embed_text ORDER BY row_id, place) AS rn FROM (SELECT row_id, word_root, polarity, 0 AS place, word AS embed_text FROM dictionary
        UNION ALL SELECT row_id, word_root, polarity, 1, word_root FROM dictionary) WHERE try_cast(trim(polarity) AS INT) <= -1 AND regexp_matches(word_root, '{LATIN}') AND regexp_matches(embed_text, '{LATIN}')) WHERE rn = 1""",
    ),
)
def lexicon_v1(spark, sf):
    return L.first_lexicon(dictionary(spark, sf), LATIN).select("embed_text", "row_id", "word_root", "polarity")


# --- review ------------------------------------------------------------------------------------------

VIEWS["rspans"] = (("lspans",), "SELECT s.*, lower(matched_word) AS keyword, matched_word AS surface, source AS search_keyword FROM lspans s JOIN documents USING (doc_id)")
VIEWS["rstats"] = (
    ("rspans",),
    f"""SELECT keyword, count(*) AS count, count(DISTINCT doc_id) AS video_count, count(DISTINCT search_keyword) AS search_words, max(score)::DOUBLE AS max_score, {s_round4('sum(score)::DOUBLE / count(*)')} AS avg_score FROM rspans GROUP BY 1""",
)


def spans(spark, sf):
    sources = V.table(spark, sf, "documents").select("doc_id", F.col("source").alias("search_keyword"))
    rows = V.lexicon_spans(spark, sf).join(sources, "doc_id")
    return rows.withColumns({"keyword": F.lower("matched_word"), "surface": F.col("matched_word")})


@query(
    "review_candidates",
    with_views(
        "rstats rspans",
        """SELECT r.*, surfaces, examples FROM rstats r JOIN (SELECT keyword, string_agg(surface || ':' || n::VARCHAR, '|' ORDER BY rn) AS surfaces FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY n DESC, surface) AS rn
        FROM (SELECT keyword, surface, count(*) AS n FROM rspans GROUP BY 1, 2)) WHERE rn <= 5 GROUP BY 1) USING (keyword) JOIN (SELECT keyword, string_agg(doc_id::VARCHAR || '/' || sentence_id::VARCHAR, '|' ORDER BY rn) AS examples FROM (
        SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY doc_id, sentence_id, token_index) AS rn FROM rspans) WHERE rn <= 5 GROUP BY 1) USING (keyword)""",
    ),
)
def review_candidates(spark, sf):
    return L.review_candidates(spans(spark, sf))


VIEWS["decided"] = (
    ("rstats", "decisions"),
    f"""SELECT keyword, count, video_count, max_score, CASE WHEN keyword IN {s_in(KEEP)} THEN 'PROTECTED' WHEN keyword IN {s_in(BLOCK)} THEN 'BLOCK' ELSE 'REVIEW' END AS decision, CASE WHEN keyword IN {s_in(KEEP)} THEN 'core emotion word'
    WHEN keyword IN {s_in(BLOCK)} THEN 'general or functional word' WHEN keyword IN {s_in(CONTEXT)} THEN 'depends on context' WHEN keyword LIKE '%다' THEN 'new predicate' ELSE 'new noun' END AS reason,
    row_number() OVER (ORDER BY count DESC, video_count DESC, max_score DESC, keyword) AS place FROM rstats WHERE keyword NOT IN (SELECT word FROM decisions WHERE section = 'review_pending')""",
)
VIEWS["chosen"] = (
    ("decided",),
    """SELECT * FROM (SELECT *, count(*) FILTER (decision <> 'PROTECTED') OVER (ORDER BY place) AS taken FROM decided) WHERE CASE WHEN decision <> 'PROTECTED' THEN taken <= 50 ELSE taken < 50 END""",
)


def known_words(spark, sf):
    return V.decisions(spark, sf).filter(F.col("section") == "review_pending").select(F.trim("item").alias("word"))


def decided(spark, sf):
    stats = L.review_candidates(spans(spark, sf))
    return L.review_decisions(stats, known_words(spark, sf), keep=KEEP, block=BLOCK, context=CONTEXT)


@query("review_decisions", with_views("chosen", "SELECT keyword, count, video_count, max_score, decision, reason FROM chosen"))
def review_decisions(spark, sf):
    return decided(spark, sf)


@query(
    "decision_merge",
    with_views(
        "chosen decisions",
        """SELECT section, word, FALSE AS added FROM decisions WHERE section IN ('keep_confirmed', 'review_pending') UNION ALL SELECT DISTINCT CASE WHEN decision = 'BLOCK' THEN 'block_confirmed' ELSE 'auto_review_blocked' END, keyword, TRUE FROM chosen
        WHERE decision <> 'PROTECTED' AND keyword NOT IN (SELECT word FROM decisions WHERE section = 'keep_confirmed')""",
    ),
)
def decision_merge(spark, sf):
    rows = V.decisions(spark, sf).filter(F.col("section").isin("keep_confirmed", "review_pending"))
    item = F.trim("item")
    word = F.when(item.startswith("{"), F.trim(F.get_json_object(item, "$.surface"))).otherwise(item)
    return L.merge_decisions(rows.select("section", word.alias("word")), decided(spark, sf))


_TOPICS = " UNION ALL ".join(f"SELECT '{t}', {1_000_000 + i}" for i, t in enumerate(NEWS_TOPICS))


@query(
    "search_phrases",
    f"""WITH e AS (SELECT c_mktsegment AS topic, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) AS place FROM customer GROUP BY 1), t AS (SELECT topic, min(place) AS place FROM (SELECT topic, place FROM e UNION ALL {_TOPICS}) GROUP BY 1)
    SELECT topic || ' ' || m.x || ' 뉴스' AS phrase, place::BIGINT AS place, (m.i - 1)::INT AS m FROM t, (SELECT unnest({s_list(NEWS_MODIFIERS)}) AS x, generate_subscripts({s_list(NEWS_MODIFIERS)}, 1) AS i) m ORDER BY place, m.i LIMIT 60""",
)
def search_phrases(spark, sf):
    counted = V.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    ranked = L.top_n(counted.withColumn("_g", F.lit(0)), ["_g"], [F.col("n").desc(), F.col("topic")], 60, "place")
    return L.search_phrases(ranked.select("topic", "place"), 60)


@query(
    "token_summary",
    with_views(
        "lspans",
        f"""WITH t AS (SELECT *, {s_tag('matched_word')} AS tag FROM lspans) SELECT b.*, tags, polarities FROM (SELECT matched_word AS surface, count(*) AS accept_count, count(DISTINCT doc_id::VARCHAR || '/' || sentence_id::VARCHAR) AS sentence_count,
        count(DISTINCT doc_id) AS doc_count, max(score)::DOUBLE AS max_score FROM t GROUP BY 1) b JOIN (SELECT surface, string_agg(tag || ':' || n::VARCHAR, '|' ORDER BY n DESC, tag) AS tags FROM (SELECT matched_word AS surface, tag, count(*) AS n FROM t GROUP BY 1, 2) GROUP BY 1) USING (surface)
        JOIN (SELECT surface, string_agg(polarity::VARCHAR || ':' || n::VARCHAR, '|' ORDER BY n DESC, polarity) AS polarities FROM (SELECT matched_word AS surface, polarity, count(*) AS n FROM t GROUP BY 1, 2) GROUP BY 1) USING (surface)""",
    ),
)
def token_summary(spark, sf):
    rows = V.lexicon_spans(spark, sf).withColumns({"surface": F.col("matched_word"), "tag": V.tag_of(F.col("matched_word"))})
    return L.token_summary(rows)
