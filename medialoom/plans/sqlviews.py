"""SQL of the domain views, so each check query states only its own step."""

from __future__ import annotations

from medialoom.functions.columns import TOKEN
from medialoom.functions.lexemes import (
    BASE_BLOCKLIST,
    EMOTION_NOUN_MARKERS,
    EMOTION_NOUN_SUFFIXES,
    FUNCTION_WORDS,
    LANGUAGE_COUNTRY,
    NEGATIVE_LABELS,
    POSITIVE_LABELS,
    SPAN_BOUNDARY,
    TAG_SUFFIXES,
)

# The same whitespace class in the regex dialect of the checking engine.
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def s_strip(e: str) -> str:
    return f"regexp_replace({e}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def s_squeeze(e: str) -> str:
    return s_strip(f"regexp_replace({e}, '{SPACE}+', ' ', 'g')")


def s_round4(e: str) -> str:
    return f"(floor(({e}) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE)"


def s_sentences(text: str) -> str:
    """Stripped, non-blank sentences of a text as a list."""
    marked = f"regexp_replace({text}, '([.!?]){SPACE}+', '\\1' || chr(1), 'g')"
    return s_clean_list(f"string_split({marked}, chr(1))")


def s_clean_list(lst: str) -> str:
    return f"list_filter(list_transform({lst}, lambda x: {s_strip('x')}), lambda x: x <> '')"


def s_in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + ")"


def s_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def s_tag(form: str) -> str:
    arms = " ".join(f"WHEN ends_with({form}, '{p}') THEN '{t}'" for p, t in TAG_SUFFIXES)
    return f"CASE WHEN regexp_matches({form}, '^[0-9]+$') THEN 'SN' WHEN regexp_matches({form}, '^[A-Z]') THEN 'NNP' {arms} ELSE 'NNG' END"


def s_first_seen(lst: str) -> str:
    """Case-insensitive dedupe that keeps order."""
    return (
        f"list_transform(list_filter(list_transform({lst}, lambda x, i: {{'x': x, 'i': i}}), "
        f"lambda s: list_position(list_transform({lst}, lambda y: lower(y)), lower(s.x)) = s.i), lambda s: s.x)"
    )


def s_votes(text: str) -> str:
    words = f"regexp_extract_all(lower({text}), '\\p{{L}}+')"
    return ", ".join(
        f"len(list_filter({words}, lambda w: w IN {s_in(v)})) AS v_{k}" for k, v in FUNCTION_WORDS.items()
    )


SQL_BOUNDARY = "".join("\\" + ch if ch in "[]-^" else ch for ch in SPAN_BOUNDARY).replace("'", "''")


def s_resolve(match_seed: bool, threshold: float | None) -> str:
    """Decision per candidate row with columns keyword_text, tag, allowed and the hit list ``hits``."""
    unsigned = "h.polarity = 0 OR " if match_seed else ""
    signed = f"list_filter(hits, lambda h: {unsigned}list_contains(allowed, h.polarity))"
    noun = " OR ".join([f"contains(keyword_text, '{m}')" for m in EMOTION_NOUN_MARKERS] + [f"ends_with(keyword_text, '{m}')" for m in EMOTION_NOUN_SUFFIXES])
    ok = f"(tag LIKE 'VA%' OR tag = 'XR' OR (tag = 'NNG' AND ({noun})))"
    seeded = "list_filter(signed, lambda h: keyword_text IN (h.clean_seed, h.embed_text, h.word))"
    similar = f"list_filter(signed, lambda h: {ok} AND h.score >= 0.93::DOUBLE AND h.category = 'DIRECT_EMOTION')"
    chosen = f"CASE WHEN len({seeded}) > 0 THEN {seeded} ELSE {similar} END" if match_seed else "signed"
    first = "list_filter(chosen, lambda h, i: list_position(list_transform(chosen, lambda x: x.clean_seed), h.clean_seed) = i)"
    none = (
        "CASE WHEN len(picked) = 0 AND len(signed) > 0 THEN 'seed_mismatch' WHEN len(picked) = 0 AND len(hits) = 0 THEN 'no_hit' "
        "WHEN len(picked) = 0 THEN 'polarity_mismatch' "
        if match_seed
        else "CASE WHEN len(picked) = 0 THEN 'polarity_mismatch' "
    )
    score = s_round4("greatest(0::DOUBLE, least(1::DOUBLE, picked[1].score))")
    return f"""SELECT * EXCLUDE (hits, signed, chosen, picked), {none} WHEN picked[1].score < 0.88::DOUBLE THEN 'below_threshold'
    WHEN picked[1].score - picked[2].score < 0.06::DOUBLE THEN 'low_margin' END AS decision, {score} AS score, picked[1].word AS hit_word
    FROM (SELECT *, {first} AS picked FROM (SELECT *, {chosen} AS chosen FROM (SELECT *, {signed} AS signed FROM (
    SELECT c.*, coalesce(h.hits, []) AS hits FROM cand c LEFT JOIN (SELECT q, list({{'rank': rank, 'score': score, 'word': word,
    'embed_text': embed_text, 'clean_seed': clean_seed, 'polarity': polarity, 'category': category}} ORDER BY rank) AS hits
    FROM slot_hits {'WHERE score >= ' + str(threshold) + '::DOUBLE' if threshold else ''} GROUP BY q) h
    ON h.q = ('0x' || substr(md5(c.keyword_text), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings)))))"""


_COUNTRY = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGE_COUNTRY.items())

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "articles": (
        (),
        f"""SELECT doc_id AS target_id, {s_strip("split_part(text, chr(10), 1)")} AS title, text AS raw_text,
        lang AS language, CASE lang {_COUNTRY} END AS country, source AS channel FROM documents""",
    ),
    "sentences": (
        (),
        f"""SELECT doc_id, language, unnest(l) AS sentence_text, generate_subscripts(l, 1) - 1 AS sentence_id
        FROM (SELECT doc_id, lang AS language, {s_sentences('text')} AS l FROM documents)""",
    ),
    "prepared": (
        ("sentences",),
        f"""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_id) - 1 AS idx,
        count(*) OVER (PARTITION BY doc_id) AS total FROM (SELECT doc_id, language, sentence_id, sentence_id AS sentence_order,
        sentence_id + 1 AS position, {s_squeeze('sentence_text')} AS sentence_text FROM sentences)
        WHERE length(sentence_text) >= 5""",
    ),
    "classified": (
        ("prepared",),
        """SELECT *, CASE WHEN regexp_matches(sentence_text, '[!?]') THEN 'opinion_like' ELSE 'fact_like' END
        AS label, least(0.99::DOUBLE, 0.5::DOUBLE + length(sentence_text) / 400::DOUBLE) AS confidence
        FROM prepared""",
    ),
    "words": (
        ("classified",),
        f"""SELECT * EXCLUDE (l), {s_tag('form')} AS tag FROM (
        SELECT doc_id, sentence_id, idx, total, label, confidence, l, unnest(l) AS form, generate_subscripts(l, 1) - 1
        AS token_index FROM (SELECT *, regexp_extract_all(sentence_text, '{TOKEN}') AS l FROM classified))""",
    ),
    "lexicon": (
        (),
        f"""SELECT word, word AS embed_text, CASE WHEN word LIKE '%ing' THEN word || '다' ELSE word END AS
        clean_seed, (CASE WHEN length(word) % 2 = 0 THEN 1 ELSE -1 END * CASE WHEN length(word) >= 8 THEN 2
        ELSE 1 END)::INT AS polarity, CASE WHEN length(word) % 3 = 0 THEN 'DIRECT_EMOTION' WHEN
        length(word) % 2 = 1 THEN 'NEGATIVE_STATE' ELSE 'EVALUATIVE_WORD' END AS category,
        ((length(word) % 5 + 5) / 10.0)::DECIMAL(10,4) AS score_hint
        FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS word FROM benchmark)""",
    ),
    "lspans": (
        ("words", "lexicon"),
        """SELECT doc_id, sentence_id, idx, total, token_index, form AS matched_word, score_hint AS score, polarity
        FROM words JOIN lexicon ON lower(form) = word WHERE label = 'opinion_like'""",
    ),
    "decisions": (
        ("lexicon",),
        """SELECT CASE WHEN length(word) = 2 THEN 'block_confirmed' WHEN length(word) = 3 AND word LIKE 't%' THEN
        'review_promoted_from_added_data' WHEN length(word) = 3 AND word LIKE '%n' THEN 'auto_review_blocked'
        WHEN length(word) = 3 THEN 'keep_confirmed' ELSE 'review_pending' END AS section, word
        FROM lexicon WHERE length(word) <= 4""",
    ),
    "blocked": (
        ("decisions",),
        f"""SELECT DISTINCT word FROM (SELECT word FROM decisions WHERE section IN ('block_confirmed',
        'review_promoted_from_added_data', 'auto_review_blocked') UNION ALL SELECT unnest({s_list(BASE_BLOCKLIST)}))""",
    ),
    "gated": (
        ("classified",),
        f"""SELECT * EXCLUDE (ranked, kept), ranked[1].s AS gate_score, ranked[1].s >= 0.35::DOUBLE AND len(kept) > 0 AS gate_passed,
        kept AS top_labels,
        CASE WHEN len(list_intersect(kept, {s_list(NEGATIVE_LABELS)})) > 0 AND len(list_intersect(kept, {s_list(POSITIVE_LABELS)})) = 0 THEN [-2, -1]
        WHEN len(list_intersect(kept, {s_list(POSITIVE_LABELS)})) > 0 AND len(list_intersect(kept, {s_list(NEGATIVE_LABELS)})) = 0 THEN [1, 2]
        ELSE [-2, -1, 1, 2] END AS allowed
        FROM (SELECT *, list_transform(list_slice(list_filter(ranked, lambda e: e.s >= 0.2::DOUBLE), 1, 3), lambda e: e.l) AS kept
        FROM (SELECT *, list_transform(list_sort([{{'n': -e1, 'l': '화남/분노'}}, {{'n': -e2, 'l': '의심/불신'}},
        {{'n': -e3, 'l': '기쁨'}}, {{'n': -e4, 'l': '행복'}}, {{'n': -0.1::DOUBLE, 'l': '없음'}}]), lambda e: {{'s': -e.n, 'l': e.l}}) AS ranked
        FROM (SELECT *, least(1::DOUBLE, len(regexp_extract_all(sentence_text, '!')) / 2::DOUBLE) AS e1,
        least(1::DOUBLE, len(regexp_extract_all(sentence_text, '[?]')) / 2::DOUBLE) AS e2,
        (length(sentence_text) % 10) / 10::DOUBLE AS e3, (length(sentence_text) % 7) / 10::DOUBLE AS e4
        FROM classified WHERE label = 'opinion_like')))""",
    ),
    "located": (
        ("gated",),
        f"""SELECT * EXCLUDE (g), sum(length(g) + length(form)) OVER w - length(form) AS start, {s_tag('form')} AS tag
        FROM (SELECT doc_id, sentence_id, sentence_text, allowed, unnest(words) AS form, unnest(gaps[1:len(words)]) AS g,
        generate_subscripts(words, 1) - 1 AS token_index FROM (SELECT *,
        regexp_extract_all(sentence_text, '{TOKEN}') AS words, regexp_split_to_array(sentence_text, '{TOKEN}') AS gaps
        FROM gated WHERE gate_passed)) WINDOW w AS (PARTITION BY doc_id, sentence_id ORDER BY token_index)""",
    ),
    "tokmarks": (
        ("located", "blocked"),
        """SELECT *, form IN (SELECT word FROM blocked) OR regexp_replace(form, '^[0-9]+', '') IN (SELECT word FROM blocked)
        OR (form NOT LIKE '%다' AND (form || '다' IN (SELECT word FROM blocked) OR form || '하다' IN (SELECT word FROM blocked)
        OR regexp_replace(form, '^[0-9]+', '') || '다' IN (SELECT word FROM blocked)
        OR regexp_replace(form, '^[0-9]+', '') || '하다' IN (SELECT word FROM blocked))) AS is_blocked FROM located""",
    ),
    "filtered": (
        ("tokmarks",),
        """SELECT *, CASE WHEN tag = 'NNP' THEN 'proper_noun' WHEN tag NOT IN ('NNG', 'XR', 'VV') AND tag NOT LIKE 'VA%'
        THEN 'invalid_pos' WHEN length(form) < 2 THEN 'too_short' WHEN is_blocked THEN 'blocked_stopword' END AS reject_reason
        FROM tokmarks""",
    ),
    "tcands": (
        ("filtered",),
        f"""SELECT *, substr(sentence_text, start_offset::INT + 1, (end_offset - start_offset)::INT) AS matched_word FROM (
        SELECT *, start AS start_offset, CASE WHEN tag = 'NNG' THEN form WHEN form LIKE '%다' THEN form ELSE form || '다' END
        AS keyword_text, CASE WHEN tag = 'NNG' THEN start + length(form) ELSE start + length(form) +
        length(regexp_extract(substr(sentence_text, (start + length(form))::INT + 1), '^[^{SPACE[1:-1]}{SQL_BOUNDARY}]*')) END AS end_offset
        FROM filtered WHERE reject_reason IS NULL AND tag <> 'XR')""",
    ),
    "lexvec": (
        ("lexicon",),
        """SELECT *, ('0x' || substr(md5(word), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings) AS vec_id FROM lexicon""",
    ),
    "pairsims": (
        (),
        """SELECT a.vec_id AS q, b.vec_id AS v, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim
        FROM embeddings a, embeddings b""",
    ),
    "slot_hits": (
        ("lexvec", "pairsims"),
        """SELECT q, rank, sim AS score, word, embed_text, clean_seed, polarity, category FROM (SELECT *, row_number() OVER
        (PARTITION BY q ORDER BY sim DESC, word) AS rank FROM pairsims JOIN lexvec ON v = vec_id) WHERE rank <= 3""",
    ),
    "videos": (
        (),
        f"""SELECT o_orderkey::VARCHAR AS video_id, o_orderkey AS target_id,
        c_mktsegment || ' ' || substr(o_orderpriority, 3) AS title,
        strftime(o_orderdate, '%Y-%m-%d') AS published_at, o_totalprice AS view_count, r_name AS country,
        lower(substr(r_name, 1, 2)) AS language, 'ch' || supp::VARCHAR AS channel,
        CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'P' THEN 'FAILED' END AS status,
        substr(o_orderpriority, 3) AS tone,
        CASE WHEN n IS NOT NULL THEN {s_round4("least(1::DOUBLE, disc::DOUBLE / n * 10::DOUBLE)")} END AS opinion_score,
        CASE WHEN n IS NOT NULL THEN {s_round4("least(1::DOUBLE, tax::DOUBLE / n * 10::DOUBLE)")} END AS bias_score
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS supp, sum(l_discount::DECIMAL(12,2)) AS disc,
                   sum(l_tax::DECIMAL(12,2)) AS tax, count(*) AS n FROM lineitem GROUP BY 1)
        ON l_orderkey = o_orderkey""",
    ),
    "vlines": (
        (),
        """SELECT l_orderkey::VARCHAR AS video_id, l_linenumber, p_name, p_brand, p_type
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    ),
    "part_of": (
        ("vlines",),
        """SELECT DISTINCT video_id, p_brand AS issue_id, CASE WHEN
        regexp_extract(p_brand, '([0-9]+)$', 1)::INT % 2 = 1 THEN 'CURATION_MANUAL' ELSE 'SEARCH_AUTO' END
        AS cluster_type FROM vlines""",
    ),
    "has_entity": (("vlines",), "SELECT DISTINCT video_id, p_type AS entity_key FROM vlines"),
    "kwrows": (
        ("vlines",),
        "SELECT video_id, p_name AS keyword, min(l_linenumber) AS position FROM vlines GROUP BY 1, 2",
    ),
    "candidates": (
        (),
        """SELECT 'rt-' || user_id::VARCHAR || '-' || weekofyear(ts)::VARCHAR AS request_id, event_id AS seq,
        'v' || (props->>'$.k') AS video_id, ' ' || event_type || ' ' AS title,
        CASE (props->>'$.k')::INT % 3 WHEN 0 THEN ' kr ' WHEN 1 THEN 'us' ELSE 'cn' END AS country_code,
        CASE (props->>'$.k')::INT % 3 WHEN 0 THEN 'KO' WHEN 1 THEN 'en' ELSE 'zh ' END AS language,
        value AS view_count, event_type, ts FROM events""",
    ),
}


def with_views(names: str, body: str) -> str:
    """Prefix ``body`` with the named views and what they depend on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for need in VIEWS[name][0]:
            add(need)
        ordered.append(name)

    for name in names.split():
        add(name)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
