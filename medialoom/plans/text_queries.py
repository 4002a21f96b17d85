"""Sentence, text, caption and record queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from medialoom.functions.columns import blank_to_null, clamp01, first_text, strip, surrogate_id
from medialoom.functions.lexemes import CAPTION_LANGUAGES, FUNCTION_WORDS, TRANSITIONS
from medialoom.operators import text as T
from medialoom.plans.registry import query
from medialoom.plans.sqlviews import (
    SPACE,
    s_clean_list,
    s_sentences,
    s_squeeze,
    s_strip,
    s_votes,
    with_views,
)
from medialoom.session import scratch_path
from medialoom.sources import views as V
from medialoom.sources.files import read_caption_files


@query(
    "sentence_split",
    with_views("sentences", "SELECT doc_id, sentence_id, sentence_id AS sentence_order, sentence_text FROM sentences"),
)
def sentence_split(spark, sf):
    return V.sentences(spark, sf).select("doc_id", "sentence_id", "sentence_order", "sentence_text")


_LINES = f"regexp_split_to_array(text, '{T.LINE_END}')"
_KO = (
    f"flatten(list_transform({_LINES}, lambda y: string_split(regexp_replace({s_strip('y')}, "
    f"'([.!?다요죠네까]){SPACE}+', '\\1' || chr(1), 'g'), chr(1))))"
)


@query(
    "sentence_split_ko",
    f"""SELECT doc_id, unnest(l) AS sentence_text, generate_subscripts(l, 1) - 1 AS sentence_id
    FROM (SELECT doc_id, {s_clean_list(_KO)} AS l FROM documents)""",
)
def sentence_split_ko(spark, sf):
    docs = V.text_table(spark, sf, "documents").select("doc_id", "text")
    return T.split_sentences_ko(docs, "text").select("doc_id", "sentence_id", "sentence_text")


_PHRASE = "|".join(re.escape(t).replace("\\ ", " ") for t in TRANSITIONS)
_BACK = "strpos(reverse(left(t, a)), ',')"


def _s_pair(cut: str, rest: str) -> str:
    return f"{{'l': trim(left(t, {cut}), ' ,'), 'r': {s_strip(f'substr(t, {rest} + 1)')}}}"


def _s_cut(source: str) -> str:
    """Rows ``(doc_id, piece_id, way, t)`` with the two halves of ``t`` as ``cut``, null where it is short or can't be cut."""
    starts = "list_transform(range(1, len(h) + 1), lambda i: (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::BIGINT)"
    by_phrase = f"flatten(list_transform({starts}, lambda a: [{_s_pair('a', 'a')}, CASE WHEN {_BACK} > 0 THEN {_s_pair(f'a - {_BACK}', f'a - {_BACK} + 1')} END]))"
    by_space = f"[CASE WHEN near IS NOT NULL THEN {{'l': {s_strip('left(t, near)')}, 'r': {s_strip('substr(t, near + 1)')}}} END]"
    fits = f"lambda o: o IS NOT NULL AND length(o.l) >= {T.MIN_CHUNK} AND length(o.r) >= {T.MIN_CHUNK}"
    space = f"list_max(list_filter(range({T.CUT_FROM}, least({T.CUT_TO}, length(t) - {T.MIN_CHUNK}) + 1), lambda i: regexp_full_match(substr(t, i + 1, 1), '{SPACE}')))"
    return f"""SELECT doc_id, piece_id, way, t, CASE WHEN length(t) > {T.LONG_CHUNK} THEN list_filter(list_concat({by_phrase}, {by_space}), {fits})[1] END AS cut
    FROM (SELECT *, regexp_extract_all(t, '{_PHRASE}') AS h, regexp_split_to_array(t, '{_PHRASE}') AS g, {space} AS near FROM ({source}))"""


_HALF = "SELECT doc_id, piece_id, way || side AS way, CASE side WHEN '0' THEN cut.l ELSE cut.r END AS t FROM parts, (VALUES ('0'), ('1')) AS s(side) WHERE cut IS NOT NULL"


@query(
    "sentence_split_long",
    f"""WITH RECURSIVE pieces AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS piece_id, '' AS way FROM (SELECT doc_id, {s_clean_list(_KO)} AS l FROM documents)),
    parts AS ({_s_cut('SELECT doc_id, piece_id, way, t FROM pieces')} UNION ALL {_s_cut(_HALF)})
    SELECT doc_id, piece_id::INT AS piece_id, (row_number() OVER (PARTITION BY doc_id, piece_id ORDER BY way) - 1)::INT AS part_id, t AS sentence_text FROM parts WHERE cut IS NULL""",
)
def sentence_split_long(spark, sf):
    return T.split_long(V.text_table(spark, sf, "documents").select("doc_id", "text"), "text")


_VOTE_ORDER = sorted(FUNCTION_WORDS)
_BEST = "greatest(" + ", ".join(f"v_{k}" for k in _VOTE_ORDER) + ")"
_WINNER = (
    "CASE " + " ".join(f"WHEN v_{k} > 0 AND v_{k} = {_BEST} THEN '{k}'" for k in _VOTE_ORDER) + " END"
)


@query(
    "sentence_prepare",
    with_views(
        "prepared",
        f"""SELECT doc_id, sentence_id, position, sentence_text FROM (SELECT *, {s_votes('sentence_text')}
        FROM prepared) WHERE {_WINNER} = language""",
    ),
)
def sentence_prepare(spark, sf):
    out = T.prepare(V.sentences(spark, sf), expected_language=F.col("language"))
    return out.select("doc_id", "sentence_id", "position", "sentence_text")


@query(
    "language_vote",
    with_views(
        "prepared",
        f"""SELECT doc_id, sentence_id, {_WINNER} AS detected, ({_WINNER} = language) IS TRUE AS as_expected
        FROM (SELECT *, {s_votes('sentence_text')} FROM prepared)""",
    ),
)
def language_vote(spark, sf):
    voted = V.prepared(spark, sf).withColumn("detected", T.detected_language(F.col("sentence_text")))
    return voted.select(
        "doc_id",
        "sentence_id",
        "detected",
        F.coalesce(F.col("detected") == F.col("language"), F.lit(False)).alias("as_expected"),
    )


def _sql_unescape(e: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        e = f"replace({e}, '{name}', '{char}')"
    return e


@query(
    "clean_transcript",
    f"""SELECT page_id, {s_squeeze("regexp_replace(" + _sql_unescape('html') + f", '(?i)^{SPACE}*Kind:{SPACE}*captions{SPACE}+Language:{SPACE}*ko{SPACE}*', '')")}
    AS clean_text FROM pages""",
)
def clean_transcript(spark, sf):
    return V.text_table(spark, sf, "pages").select("page_id", T.clean_transcript(F.col("html")).alias("clean_text"))


@query(
    "script_ratio_filter",
    """SELECT doc_id, script_chars, other_chars FROM (SELECT doc_id,
    len(regexp_extract_all(text, '[àâçéèêëîïôûùü]')) AS script_chars,
    len(regexp_extract_all(text, '[A-Za-z]')) AS other_chars FROM documents WHERE lower(lang) = 'fr')
    WHERE script_chars >= 50 AND script_chars / (script_chars + other_chars) >= 0.2::DOUBLE""",
)
def script_ratio_filter(spark, sf):
    docs = V.table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("language"))
    out = T.script_ratio_filter(docs, "text", "fr", script="[àâçéèêëîïôûùü]", min_chars=50, min_ratio=0.2)
    return out.select("doc_id", "script_chars", "other_chars")


@query(
    "caption_lines",
    f"""SELECT page_id, unnest(l) AS line_text, generate_subscripts(l, 1) - 1 AS line_index FROM (SELECT page_id,
    list_filter(list_transform(regexp_split_to_array(regexp_replace(html, '<[^>]+>', '', 'g'), '{T.LINE_END}'),
    lambda x: {s_strip('x')}), lambda x: x <> '' AND NOT starts_with(x, 'WEBVTT') AND NOT contains(x, '-->')
    AND NOT regexp_matches(x, '^\\p{{Nd}}+$')) AS l FROM pages)""",
)
def caption_lines(spark, sf):
    return T.caption_lines(V.text_table(spark, sf, "pages").select("page_id", "html"), "html")


@query(
    "scan_caption_files",
    """SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, length(unnest(l)) AS n_chars, generate_subscripts(l, 1) - 1 AS place
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
)
def scan_caption_files(spark, sf):
    """Every document is written as a caption track, one cue a line; place counts lines from the track's first."""
    cue = lambda x, i: F.concat(F.lit("00:00.000 --> 00:09.000\n<v A>"), "doc_id", F.lit(":"), i, F.lit(":"), F.length(x), F.lit("</v>\n"))
    cues = F.transform(F.split("text", "\n"), cue)
    path = scratch_path(spark, "tracks")
    V.table(spark, sf, "documents").where("text IS NOT NULL").select(F.concat(F.lit("WEBVTT\n\n"), F.array_join(cues, "\n"))).write.text(path)
    part = lambda i, kind: F.get(F.split("line_text", ":"), F.lit(i)).cast(kind)
    lines = read_caption_files(spark, path).select(
        part(0, "bigint").alias("doc_id"), part(1, "int").alias("line"), part(2, "int").alias("n_chars"), "file", "line_index"
    )
    first = lines.where("line = 0").select("doc_id", F.col("line_index").alias("first"))
    placed = lines.join(first, "doc_id")
    return placed.select("doc_id", "line", "n_chars", (F.col("line_index") - F.col("first")).alias("place"))


_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')"
_OVERLAP = "coalesce(list_max(list_filter(range(1, least(len(known), len(words)) + 1), lambda k: known[len(known) - k + 1:] = words[1:k])), 0)"


@query(
    "caption_merge",
    f"""WITH RECURSIVE segments AS (SELECT conv_id, turn, {_WORDS} AS words FROM conversations),
    merged AS (SELECT conv_id, turn, words AS known, words AS fresh FROM segments WHERE turn = 0
    UNION ALL SELECT conv_id, turn, known || words[o + 1:], words[o + 1:] FROM (SELECT s.conv_id, s.turn, known, words, {_OVERLAP} AS o FROM merged m JOIN segments s ON s.conv_id = m.conv_id AND s.turn = m.turn + 1))
    SELECT conv_id::VARCHAR AS video_id, turn AS position, array_to_string(fresh, ' ') AS new_text FROM merged""",
)
def caption_merge(spark, sf):
    segments = V.turns(spark, sf).select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("position"), F.col("text").alias("segment_text")
    )
    return T.merge_captions(segments)


_REGION = "CASE doc_id // 4 % 3 WHEN 0 THEN 'KR' WHEN 1 THEN 'US' ELSE 'DE' END"
_PREF_KR = " ".join(
    f"WHEN region_code = '{r}' THEN " + "CASE " + " ".join(f"WHEN contains(file_name, '{x}') THEN {i}" for i, x in enumerate(ls)) + f" ELSE {len(ls)} END"
    for r, ls in CAPTION_LANGUAGES.items()
)


@query(
    "caption_track_pick",
    f"""SELECT video_id, region_code, file_name FROM (SELECT *, row_number() OVER (PARTITION BY video_id,
    region_code ORDER BY preference, file_name) AS rn FROM (SELECT *, CASE {_PREF_KR} WHEN
    contains(file_name, 'en') THEN 0 ELSE 1 END AS preference FROM (SELECT 'v' || (doc_id // 4)::VARCHAR AS
    video_id, {_REGION} AS region_code, 't' || doc_id::VARCHAR || '.' || lang || '.vtt' AS file_name
    FROM documents))) WHERE rn = 1""",
)
def caption_track_pick(spark, sf):
    video = F.floor(F.col("doc_id") / 4)
    tracks = V.table(spark, sf, "documents").select(
        F.concat(F.lit("v"), video.cast("string")).alias("video_id"),
        F.when(video % 3 == 0, "KR").when(video % 3 == 1, "US").otherwise("DE").alias("region_code"),
        F.concat(F.lit("t"), F.col("doc_id").cast("string"), F.lit("."), "lang", F.lit(".vtt")).alias("file_name"),
    )
    return T.pick_track(tracks).select("video_id", "region_code", "file_name")


@query(
    "fixed_chunks",
    """SELECT doc_id, (pos // 4500)::BIGINT AS chunk_index, substr(text, pos + 1, 4500) AS chunk_text FROM
    (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 4500)) AS pos FROM documents
    WHERE length(text) > 0)""",
)
def fixed_chunks(spark, sf):
    docs = V.text_table(spark, sf, "documents").select("doc_id", "text")
    return T.fixed_chunks(docs, "text").select("doc_id", "chunk_index", "chunk_text")


@query(
    "transcript_status",
    f"""SELECT page_id, CASE WHEN body = '' THEN 'failed' ELSE 'success' END AS transcript_status,
    length(body) AS n_chars FROM (SELECT page_id, {s_strip("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS body FROM pages)""",
)
def transcript_status(spark, sf):
    body = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    return V.text_table(spark, sf, "pages").select(
        "page_id",
        T.transcript_status(body).alias("transcript_status"),
        F.length(strip(body)).cast("bigint").alias("n_chars"),
    )


@query(
    "log_sentences",
    f"""SELECT doc_id, origin, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS index FROM (
    SELECT doc_id, CASE WHEN len(listed) > 0 THEN 'sentences' WHEN single <> '' THEN 'sentence_text' ELSE
    'raw_text' END AS origin, CASE WHEN len(listed) > 0 THEN listed WHEN single <> '' THEN [single] ELSE
    {s_sentences(s_strip('text'))} END AS l FROM (SELECT doc_id, text, CASE WHEN lang IN ('fr', 'de') THEN
    {s_clean_list("string_split(text, chr(10))")} ELSE [] END AS listed, CASE WHEN lang = 'es' THEN
    {s_strip("split_part(text, chr(10), 1)")} ELSE '' END AS single FROM documents))""",
)
def log_sentences(spark, sf):
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("sentence_text")))
    records = V.table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("lang").isin("fr", "de"), lines).alias("sentences"),
        F.when(F.col("lang") == "es", F.split_part("text", F.lit("\n"), F.lit(1))).alias("sentence_text"),
        F.col("text").alias("raw_text"),
        F.col("lang").alias("language"),
    )
    return T.log_sentences(records).select("doc_id", "origin", "index", "text")


@query(
    "parse_ts",
    """SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'error' THEN epoch(date_trunc('second', ts))::BIGINT
    WHEN 'signup' THEN epoch(date_trunc('day', ts))::BIGINT ELSE epoch(date_trunc('second', ts))::BIGINT END AS epoch_s
    FROM events""",
)
def parse_ts(spark, sf):
    kind = F.col("event_type")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = V.events(spark, sf).select(
        "event_id",
        F.when(kind == "click", F.concat(F.lit(" "), iso, F.lit("Z ")))
        .when(kind == "signup", F.date_format("ts", "yyyy-MM-dd"))
        .when(kind == "purchase", F.lit("not a time"))
        .when(kind == "view", F.lit(" "))
        .alias("created_at"),
        F.when(kind == "purchase", F.concat(iso, F.lit("+00:00"))).alias("requested_at"),
        F.when(kind == "error", F.unix_timestamp("ts").cast("double")).alias("epoch"),
    )
    parsed = T.parse_timestamp(F.col("created_at"), F.col("requested_at"), epoch=F.col("epoch"))
    return raw.select("event_id", F.unix_timestamp(parsed).cast("bigint").alias("epoch_s"))


@query(
    "video_summary",
    with_views(
        "videos",
        f"""SELECT video_id, title, CASE WHEN channel IS NULL THEN 'unknown' ELSE channel END AS channel_name,
        upper(country) AS country_code, language, view_count, coalesce(status, 'SUCCESS') AS analysis_status,
        opinion_score FROM videos""",
    ),
)
def video_summary(spark, sf):
    raw = V.videos(spark, sf).select(
        "video_id",
        "title",
        F.lit(" ").alias("channel_name"),
        F.col("channel").alias("channelName"),
        F.lit("").alias("country_code"),
        F.concat(F.lit(" "), F.lower("country")).alias("countryCode"),
        F.upper("language").alias("language"),
        F.col("view_count").cast("string").alias("viewCount"),
        "status",
        F.when(F.col("opinion_score").isNotNull(), F.lit("n/a")).alias("opinionScore"),
        (F.col("opinion_score") * 1.0).cast("string").alias("opinion_score"),
    )
    return summarize_videos(raw)


def summarize_videos(raw):
    """Loose video records to the summary columns: aliases, case rules, numeric coercion, clamped score."""
    opinion = F.coalesce(*[F.col(c).try_cast("double") for c in ("opinionScore", "opinion_score")])
    return raw.select(
        "video_id",
        "title",
        F.coalesce(first_text(F.col("channel_name"), F.col("channelName")), F.lit("unknown")).alias("channel_name"),
        F.upper(first_text(F.col("country_code"), F.col("countryCode"))).alias("country_code"),
        F.lower(blank_to_null(F.col("language"))).alias("language"),
        F.coalesce(F.col("viewCount").try_cast("double"), F.lit(0.0)).alias("view_count"),
        F.coalesce(blank_to_null(F.col("status")), F.lit("SUCCESS")).alias("analysis_status"),
        F.when(opinion.isNotNull(), clamp01(opinion)).alias("opinion_score"),
    )


_SPACED = "regexp_replace(x, '[' || chr(13) || chr(10) || chr(9) || ']+', ' ', 'g')"
_TERM = f"left({s_squeeze(_SPACED)}, 80)"


@query(
    "term_normalize",
    f"""SELECT doc_id, string_agg(term, '|' ORDER BY i) AS terms FROM (SELECT *, row_number() OVER (PARTITION
    BY doc_id ORDER BY i) AS rn FROM (SELECT doc_id, min(i) AS i, arg_min(term, i) AS term FROM (SELECT doc_id,
    {_TERM} AS term, i FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id,
    [split_part(text, chr(10), 1)] || string_split(text, '.') AS l FROM documents))) WHERE term <> ''
    GROUP BY doc_id, lower(term))) WHERE rn <= 10 GROUP BY doc_id""",
)
def term_normalize(spark, sf):
    return V.table(spark, sf, "documents").select(
        "doc_id",
        F.array_join(
            T.normalize_terms(F.split_part("text", F.lit("\n"), F.lit(1)), F.split("text", "[.]"), 10), "|"
        ).alias("terms"),
    )


@query(
    "synthetic_id",
    "SELECT o_orderkey, ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 15))::BIGINT AS target_id FROM orders",
)
def synthetic_id(spark, sf):
    return V.table(spark, sf, "orders").select(
        "o_orderkey", surrogate_id(F.col("o_orderkey").cast("string")).alias("target_id")
    )


_INTENT = "CASE event_type WHEN 'click' THEN 'RANK_ANALYSIS' WHEN 'view' THEN 'SEARCH_ANALYSIS' WHEN 'error' THEN 'GENERAL_CHAT' ELSE 'GENERAL_CHAT' END"


@query(
    "intent_clean",
    f"""SELECT event_id, {_INTENT} AS intent,
    CASE WHEN event_type = 'error' THEN '' ELSE event_type || '|k' || k::VARCHAR END AS keywords,
    CASE WHEN event_type = 'click' THEN 'EMOTION_SCORE' END AS sort_by,
    CASE WHEN event_type = 'click' THEN 'ASC' ELSE 'DESC' END AS sort_direction,
    CASE WHEN event_type = 'error' THEN NULL ELSE k END AS candidate_index,
    CASE WHEN event_type = 'purchase' THEN 'SCORE' END AS answer_task,
    CASE WHEN event_type = 'error' THEN 5 WHEN k = 0 THEN 5 ELSE least(greatest(k, 1), 10) END AS "limit",
    CASE WHEN event_type = 'error' THEN 0::DOUBLE ELSE greatest(0::DOUBLE, least(1::DOUBLE, value / 100::DOUBLE)) END AS confidence
    FROM (SELECT event_id, event_type, value, (props->>'$.k')::INT AS k FROM events)""",
)
def intent_clean(spark, sf):
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    intent = F.when(kind == "click", "rank_analysis").when(kind == "view", "SEARCH_ANALYSIS").otherwise(kind)
    reply = F.concat(
        F.lit('Sure: {"intent": "'), intent, F.lit('", "keywords": ["'), kind, F.lit('", " ", "k'), k,
        F.lit('"], "sortBy": "'), F.when(kind == "click", "emotion_score").otherwise("size"),
        F.lit('", "sort_direction": "'), F.when(kind == "click", "asc").otherwise("sideways"),
        F.lit('", "candidateIndex": "'), k, F.lit('", "answer_task": "'),
        F.when(kind == "purchase", "score").otherwise("none"), F.lit('", "limit": '), k,
        F.lit(', "confidence": '), (F.col("value") / 100.0).cast("string"), F.lit("} done."),
    )
    messages = V.events(spark, sf).select(
        "event_id", F.when(kind == "error", "no json here").otherwise(reply).alias("message")
    )
    return T.clean_intent(messages, "message")


@query(
    "context_text",
    with_views(
        "classified",
        """SELECT doc_id, string_agg('- ' || sentence_text, chr(10) ORDER BY rn) AS opinion_text FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_order) AS rn FROM classified
        WHERE label = 'opinion_like') WHERE rn <= 10 GROUP BY doc_id""",
    ),
)
def context_text(spark, sf):
    opinions = V.classified(spark, sf).filter(F.col("label") == "opinion_like")
    return T.first_n_text(opinions, ["doc_id"], "sentence_order", "sentence_text", 10, "opinion_text")
