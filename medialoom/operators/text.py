"""Sentence and text preparation.

Splitting, cleaning and numbering happen inside the row with array functions, so none of these operators
shuffles; only ``pick_track`` and ``merge_captions`` group rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from medialoom.functions.columns import (
    SPACE,
    first_seen,
    let,
    ratio,
    squeeze,
    strip,
)
from medialoom.functions.lexemes import CAPTION_LANGUAGES, FUNCTION_WORDS, TRANSITIONS
from medialoom.functions.ranking import first_per_key
from medialoom.session import materialize

# Length bounds of the splitter and the sentence filter.
MIN_CHARS = 5
LONG_CHUNK = 120
MIN_CHUNK = 20
CUT_FROM, CUT_TO = 100, 120
CHUNK_CHARS = 4500

SENTENCE_END = rf"(?<=[.!?]){SPACE}+"
SENTENCE_END_KO = rf"(?<=[.!?]){SPACE}+|(?<=[다요죠네까]){SPACE}+"
LINE_END = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def _numbered(df: DataFrame, pieces: Column, drop: str) -> DataFrame:
    """Explode a string array into stripped, non-blank, 0-based numbered sentences."""
    clean = F.filter(F.transform(pieces, strip), lambda s: s != "")
    keep = [c for c in df.columns if c != drop]
    return df.select(*keep, F.posexplode(clean).alias("sentence_id", "sentence_text")).withColumn(
        "sentence_order", F.col("sentence_id")
    )


def split_sentences(df: DataFrame, text: str) -> DataFrame:
    """Generic split after ``.``, ``!`` or ``?`` followed by whitespace."""
    return _numbered(df, F.split(F.col(text), SENTENCE_END), text)


def korean_pieces(text: Column) -> Column:
    """Per line, split after sentence punctuation or a sentence-final syllable."""
    return F.flatten(F.transform(F.split(text, LINE_END), lambda line: F.split(strip(line), SENTENCE_END_KO)))


def split_sentences_ko(df: DataFrame, text: str) -> DataFrame:
    return _numbered(df, korean_pieces(F.col(text)), text)


def split_sentences_by_language(df: DataFrame, text: str, language: str = "language") -> DataFrame:
    """Korean rule for ``ko`` rows, generic rule for all others."""
    pieces = F.when(F.col(language) == "ko", korean_pieces(F.col(text))).otherwise(
        F.split(F.col(text), SENTENCE_END)
    )
    return _numbered(df, pieces, text)


def prepared_sentences(df: DataFrame, text: str, pieces: Column | None = None) -> DataFrame:
    """Split and prepared sentences in one pass, with their index among the kept ones and the total.

    Everything is done on the row's own array, so scoring needs no window to number sentences.
    """
    if pieces is None:
        pieces = F.split(F.col(text), SENTENCE_END)
    split = F.filter(F.transform(pieces, strip), lambda s: s != "")
    numbered = F.transform(split, lambda s, i: F.struct(i.alias("id"), squeeze(s).alias("text")))
    kept = F.filter(numbered, lambda s: F.length(s["text"]) >= MIN_CHARS)
    sized = let(kept, lambda k: F.transform(k, lambda s: F.struct(s["id"].alias("id"), s["text"].alias("text"), F.size(k).alias("n"))))
    keep = [c for c in df.columns if c != text]
    rows = df.select(*keep, F.posexplode(sized).alias("index", "_s"))
    return rows.select(
        *keep,
        F.col("_s.id").alias("sentence_id"),
        F.col("_s.id").alias("sentence_order"),
        F.col("_s.text").alias("sentence_text"),
        "index",
        F.col("_s.n").alias("total"),
    )


# --- long chunks -------------------------------------------------------------------------------------

_TRANSITION = re.compile("|".join(map(re.escape, TRANSITIONS)))


def _plain_halves(left: str, right: str) -> tuple[str, str] | None:
    left, right = left.strip(), right.strip()
    return (left, right) if min(len(left), len(right)) >= MIN_CHUNK else None


def _plain_cut(chunk: str) -> tuple[str, str] | None:
    """Best single cut of an over-long chunk: at a transition phrase, else at whitespace near the limit."""
    for hit in _TRANSITION.finditer(chunk):
        at = hit.start()
        comma = chunk.rfind(",", 0, at)
        options = [(chunk[:at].strip(" ,"), chunk[at:])]
        if comma >= 0:
            options.append((chunk[:comma].strip(" ,"), chunk[comma + 1 :]))
        for left, right in options:
            right = right.strip()
            if len(left) >= MIN_CHUNK and len(right) >= MIN_CHUNK:
                return left, right
    last = min(CUT_TO, len(chunk) - MIN_CHUNK)
    spaces = [i for i in range(CUT_FROM, last + 1) if chunk[i].isspace()]
    return _plain_halves(chunk[: spaces[-1]], chunk[spaces[-1] :]) if spaces else None


def chunk_pieces(sentence: str) -> list[str]:
    """``cut_pieces`` of one string on the driver; the two are held against each other by a test."""
    done: list[str] = []
    todo = [sentence.strip()]
    while todo:
        chunk = todo.pop()
        cut = _plain_cut(chunk) if len(chunk) > LONG_CHUNK else None
        if cut is None:
            done.append(chunk)
        else:
            todo.extend(reversed(cut))
    return done


_PHRASE = "|".join(map(re.escape, TRANSITIONS))


def _places(chunk: Column) -> Column:
    """Starts of the transition phrases, from left to right without overlaps: lengths of what is between them and of them."""
    phrases = F.regexp_extract_all(chunk, F.lit(_PHRASE), F.lit(0))
    parts = let(phrases, lambda p: F.arrays_zip(F.slice(F.split(chunk, _PHRASE, -1), F.lit(1), F.size(p)).alias("gap"), p.alias("phrase")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        here = s["at"] + F.length(x["gap"])
        return F.struct((here + F.length(x["phrase"])).alias("at"), F.concat(s["out"], F.array(here)).alias("out"))

    return F.when(chunk.rlike(_PHRASE), F.aggregate(parts, start, step)["out"]).otherwise(F.array().cast("array<int>"))


def _halves(left: Column, right: Column) -> Column:
    return let(F.array(left, right), lambda halves: F.when(F.forall(halves, lambda h: F.length(h) >= MIN_CHUNK), halves))


def _cut_once(chunk: Column) -> Column:
    """Best single cut of an over-long chunk: at a transition phrase or the comma before it, else at whitespace near the limit."""
    before = lambda at: F.btrim(F.left(chunk, at), F.lit(" ,"))
    after = lambda at: strip(F.substring(chunk, at + 1, F.length(chunk)))

    def options(at: Column) -> Column:
        back = F.instr(F.reverse(F.left(chunk, at)), ",")
        return F.array(_halves(before(at), after(at)), F.when(back > 0, _halves(before(at - back), after(at - back + 1))))

    at_phrase = F.get(F.filter(F.flatten(F.transform(_places(chunk), options)), lambda o: o.isNotNull()), 0)
    last = F.least(F.lit(CUT_TO), F.length(chunk) - MIN_CHUNK)
    back = F.regexp_instr(F.reverse(F.substring(chunk, F.lit(CUT_FROM + 1), last - CUT_FROM + 1)), F.lit(SPACE))
    at_space = F.when((last >= CUT_FROM) & (back > 0), _halves(strip(F.left(chunk, last - back + 1)), after(last - back + 1)))
    return F.coalesce(at_phrase, at_space)


def cut_pieces(sentence: Column) -> Column:
    """Pieces of one sentence, each at most ``LONG_CHUNK`` characters unless it cannot be cut.

    A fold over rounds: each cuts every open piece once, and closes those that are short or can't be cut. A cut leaves at
    least ``MIN_CHUNK`` characters on either side, which bounds the rounds.
    """
    piece = lambda text, open_: F.struct(text.alias("text"), open_.alias("open"))
    too_long = lambda text: F.length(text) > LONG_CHUNK

    def once(x: Column) -> Column:
        parts = let(_cut_once(x["text"]), lambda cut: F.when(cut.isNull(), F.array(piece(x["text"], F.lit(False)))).otherwise(F.transform(cut, lambda t: piece(t, too_long(t)))))
        return F.when(x["open"], parts).otherwise(F.array(x))

    whole = let(strip(sentence), lambda t: F.array(piece(t, too_long(t))))
    rounds = F.sequence(F.lit(0), F.floor(F.length(sentence) / MIN_CHUNK).cast("int"))
    step = lambda pieces, _: F.when(F.exists(pieces, lambda x: x["open"]), F.flatten(F.transform(pieces, once))).otherwise(pieces)
    return F.transform(F.aggregate(rounds, whole, step), lambda x: x["text"])


def split_long(df: DataFrame, text: str) -> DataFrame:
    """Korean split, then every over-long piece cut further; numbered per document."""
    clean = F.filter(F.transform(korean_pieces(F.col(text)), strip), lambda s: s != "")
    keep = [c for c in df.columns if c != text]
    pieces = df.select(*keep, F.posexplode(clean).alias("_piece", "_text"))
    cut = pieces.withColumn("_cut", F.when(F.length("_text") > LONG_CHUNK, cut_pieces(F.col("_text"))).otherwise(F.array("_text")))
    return cut.select(
        *keep,
        F.col("_piece").alias("piece_id"),
        F.posexplode("_cut").alias("part_id", "sentence_text"),
    )


# --- cleaning and filters ----------------------------------------------------------------------------


def prepare(sentences: DataFrame, expected_language: Column | None = None) -> DataFrame:
    """Normalise whitespace, drop short sentences and, if asked, those voted to another language.

    Sentence ids are kept; ``position`` is the 1-based order among the split sentences.
    """
    out = sentences.withColumn("sentence_text", squeeze(F.col("sentence_text"))).withColumn(
        "position", F.col("sentence_order") + 1
    )
    out = out.filter(F.length("sentence_text") >= MIN_CHARS)
    if expected_language is not None:
        out = out.filter(detected_language(F.col("sentence_text")) == expected_language)
    return out


def detected_language(text: Column) -> Column:
    """Language with the most function words; the first by name on a tie; null without any.

    The words are extracted once per row and each list is counted on them.
    """
    vocabulary = sorted({w for words in FUNCTION_WORDS.values() for w in words})
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w.isin(*vocabulary))

    def votes(found: Column, language: str) -> Column:
        listed = FUNCTION_WORDS[language]
        hits = F.size(F.filter(found, lambda w: w.isin(*listed)))
        return F.struct((-hits).alias("votes"), F.lit(language).alias("language"))

    best = let(words, lambda found: F.array_min(F.array(*[votes(found, k) for k in FUNCTION_WORDS])))
    return let(best, lambda b: F.when(b["votes"] < 0, b["language"]))


@F.pandas_udf(StringType())
def _unescape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(html.unescape, na_action="ignore")


def clean_transcript(text: Column) -> Column:
    """HTML entities decoded, caption prefix dropped, whitespace collapsed.

    Only rows with an ampersand are sent to Python.
    """
    decoded = F.coalesce(_unescape(F.when(F.contains(text, F.lit("&")), text)), text)
    prefix = rf"(?i)^{SPACE}*Kind:{SPACE}*captions{SPACE}+Language:{SPACE}*ko{SPACE}*"
    return squeeze(F.regexp_replace(decoded, prefix, ""))


def script_ratio_filter(
    df: DataFrame,
    text: str,
    language: str,
    script: str = "[가-힣]",
    other: str = "[A-Za-z]",
    min_chars: int = 50,
    min_ratio: float = 0.5,
) -> DataFrame:
    """Rows of one language whose text is mostly written in ``script``."""
    counted = df.filter(F.lower("language") == language).withColumns(
        {
            "script_chars": F.regexp_count(text, F.lit(script)).cast("bigint"),
            "other_chars": F.regexp_count(text, F.lit(other)).cast("bigint"),
        }
    )
    share = ratio(F.col("script_chars"), F.col("script_chars") + F.col("other_chars"))
    return counted.filter((F.col("script_chars") >= min_chars) & (share >= min_ratio))


def fixed_chunks(df: DataFrame, text: str, width: int = CHUNK_CHARS) -> DataFrame:
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(width))
    return (
        df.filter(F.length(text) > 0)
        .withColumn("_at", F.explode(starts))
        .withColumn("chunk_text", F.substring(F.col(text), F.col("_at") + 1, F.lit(width)))
        .withColumn("chunk_index", (F.col("_at") / width).cast("bigint"))
        .drop("_at")
    )


def transcript_status(text: Column) -> Column:
    return F.when(strip(F.coalesce(text, F.lit(""))) == "", "failed").otherwise("success")


# --- captions ----------------------------------------------------------------------------------------


def caption_lines(df: DataFrame, text: str) -> DataFrame:
    """Caption file text to ordered lines: markup, header, cue times and counters removed."""
    lines = F.transform(F.split(F.regexp_replace(F.col(text), "<[^>]+>", ""), LINE_END), strip)
    wanted = F.filter(
        lines,
        lambda x: (x != "")
        & ~x.startswith("WEBVTT")
        & ~F.contains(x, F.lit("-->"))
        & ~x.rlike(r"^\p{Nd}+$"),
    )
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.posexplode(wanted).alias("line_index", "line_text"))


def pick_track(tracks: DataFrame) -> DataFrame:
    """Best caption file per video: region's language order, else the first file by name.

    ``tracks(video_id, region_code, file_name)``. A single aggregation with map-side combine.
    """
    ranked = F.lit(len(max(CAPTION_LANGUAGES.values(), key=len)))
    for region, languages in CAPTION_LANGUAGES.items():
        here = F.lit(len(languages))
        for place, language in reversed(list(enumerate(languages))):
            here = F.when(F.contains("file_name", F.lit(language)), F.lit(place)).otherwise(here)
        ranked = F.when(F.col("region_code") == region, here).otherwise(ranked)
    default = F.when(F.contains("file_name", F.lit("en")), F.lit(0)).otherwise(F.lit(1))
    ranked = F.when(F.col("region_code").isin(*CAPTION_LANGUAGES), ranked).otherwise(default)
    return first_per_key(
        tracks.withColumn("preference", ranked), ["video_id", "region_code"], ["preference", "file_name"]
    )


LOOKBACK = 512


def word_overlap(known: list[str], words: list[str]) -> int:
    """Longest start of ``words`` that ``known`` ends with, by prefix function: one pass over both."""
    fall, k = [0] * len(words), 0
    for i in range(1, len(words)):
        while k and words[i] != words[k]:
            k = fall[k - 1]
        k += words[i] == words[k]
        fall[i] = k
    k = 0
    for word in known[max(0, len(known) - len(words)) :] if words else ():
        while k and (k == len(words) or word != words[k]):
            k = fall[k - 1]
        k += word == words[k]
    return k


def _merge_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """New words of each segment of one block, given segments before it as context."""
    pdf = pdf.sort_values("position", kind="stable")
    at_start = bool(pdf["is_first"].iloc[0])
    known: list[str] = []
    rows = []
    for position, own, text in zip(pdf["position"], pdf["own"], pdf["segment_text"]):
        words = (text or "").split()
        exact = at_start or len(words) <= len(known)
        overlap = word_overlap(known, words)
        if exact:
            known += words[overlap:]
        else:
            known = words
        if own:
            rows.append((position, " ".join(words[overlap:]), exact))
    return pd.DataFrame(rows, columns=["position", "new_text", "exact"]).assign(
        video_id=pdf["video_id"].iloc[0], block_id=pdf["block_id"].iloc[0]
    )


_MERGED = "video_id string, block_id bigint, position bigint, new_text string, exact boolean"


def merge_captions(segments: DataFrame, block: int = LOOKBACK) -> DataFrame:
    """Rolling captions: each segment minus its longest word overlap with the text so far.

    ``segments(video_id, position, segment_text)``, positions numbered from 0 without gaps. Merged text
    always ends with the whole last segment, so a block of ``block`` segments only needs its predecessor
    as context unless a segment is longer than all new words of that context. Blocks with such segments
    are merged again with four times the context, until that holds enough words or starts with the video;
    no other block of the video is touched.
    """
    base = segments.select(F.col("video_id").cast("string"), F.col("position").cast("bigint"), "segment_text")
    home = base.withColumn("_home", F.floor(F.col("position") / block))
    placed = home.select("*", F.explode(F.array("_home", F.col("_home") + 1)).alias("block_id"))
    behind, done = 1, None
    while True:
        marked = placed.select(
            "video_id",
            "position",
            "segment_text",
            "block_id",
            (F.col("_home") == F.col("block_id")).alias("own"),
            (F.col("block_id") <= behind).alias("is_first"),
        )
        merged = materialize(marked.groupBy("video_id", "block_id").applyInPandas(_merge_block, _MERGED), "captions")
        unsure = merged.filter(~F.col("exact")).select("video_id", "block_id").distinct()
        sure = merged.join(unsure, ["video_id", "block_id"], "left_anti").select("video_id", "position", "new_text")
        done = sure if done is None else done.unionByName(sure)
        if unsure.isEmpty():
            return done
        behind *= 4
        context = unsure.select("video_id", "block_id", F.explode(F.sequence(F.greatest(F.col("block_id") - behind, F.lit(0)), "block_id")).alias("_home"))
        placed = home.join(context, ["video_id", "_home"])


# --- records -----------------------------------------------------------------------------------------


def log_sentences(records: DataFrame) -> DataFrame:
    """Sentences of a log record: its list, else its single sentence, else its raw text split.

    ``records(..., sentences ARRAY<STRUCT<sentence_text>>, sentence_text, raw_text, language)``.
    """
    listed = F.filter(
        F.transform(F.coalesce("sentences", F.array()), lambda s: strip(s["sentence_text"])),
        lambda s: s.isNotNull() & (s != ""),
    )
    single = strip(F.coalesce("sentence_text", F.lit("")))
    raw = strip(F.coalesce("raw_text", F.lit("")))
    pieces = F.when(F.col("language") == "ko", korean_pieces(raw)).otherwise(F.split(raw, SENTENCE_END))
    split = F.filter(F.transform(pieces, strip), lambda s: s != "")
    chosen = (
        F.when(F.size(listed) > 0, listed).when(single != "", F.array(single)).otherwise(split)
    )
    origin = (
        F.when(F.size(listed) > 0, "sentences").when(single != "", "sentence_text").otherwise("raw_text")
    )
    keep = [c for c in records.columns if c not in ("sentences", "sentence_text", "raw_text")]
    return records.select(*keep, origin.alias("origin"), F.posexplode(chosen).alias("index", "text"))


ISO_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def parse_timestamp(*values: Column, epoch: Column | None = None) -> Column:
    """First of several ISO strings that parses (naive times are UTC), else epoch seconds."""
    parsed = [
        F.when(strip(v).rlike(ISO_TIME), strip(v).try_cast("timestamp")) for v in values
    ]
    if epoch is not None:
        parsed.append(F.timestamp_seconds(epoch))
    return F.coalesce(*parsed)


def normalize_term(c: Column) -> Column:
    """Control characters to spaces, collapsed, at most 80 characters."""
    return F.left(squeeze(F.regexp_replace(c, "[\r\n\t]+", " ")), F.lit(80))


def normalize_terms(seed: Column, terms: Column, limit: int) -> Column:
    """Seed first, then the terms; blanks and case-insensitive repeats dropped, at most ``limit``."""
    cleaned = F.filter(
        F.transform(F.concat(F.array(seed), terms), normalize_term), lambda t: t.isNotNull() & (t != "")
    )
    return first_seen(cleaned, limit)


def keyword_slug(keyword: Column) -> Column:
    slug = F.regexp_replace(F.lower(strip(keyword)), "[^0-9A-Za-z가-힣一-龥]+", "-")
    slug = F.left(F.regexp_replace(slug, "^-+|-+$", ""), F.lit(80))
    return F.concat(F.lit("search:"), F.when(slug == "", "unknown").otherwise(slug))


def text_template(c: Column) -> Column:
    """Digits replaced by a marker and whitespace collapsed."""
    return squeeze(F.regexp_replace(c, r"\p{Nd}+", "<NUM>"))


def parse_flag(c: Column) -> Column:
    """Lenient boolean; null when the word is not known."""
    word = F.lower(strip(c))
    return F.when(word.isin("1", "true", "t", "yes", "y"), True).when(
        word.isin("0", "false", "f", "no", "n"), False
    )


# --- structured replies ------------------------------------------------------------------------------

# Names a reply may use.
INTENTS = [
    "GENERAL_CHAT", "LIST_ANALYZED_VIDEOS", "SEARCH_ANALYSIS", "SELECT_CANDIDATE", "RANK_ANALYSIS",
    "RANK_CURRENT_CANDIDATES",
]
SORTS = ["RECENT", "OVERALL_BIAS_SCORE", "EMOTION_SCORE", "OPINION_SCORE"]
TASKS = ["SUMMARY", "SCORE", "DETAIL", "COMPARE"]


def clean_intent(df: DataFrame, message: str) -> DataFrame:
    """Reply text to typed columns: the JSON slice is cut out, names checked, numbers coerced, bounds kept.

    The slice is parsed once into a variant, from which every field is taken. What is no JSON object, or names a key twice,
    gives the defaults.
    """
    reply = "_reply"
    while reply in df.columns:
        reply += "_"

    def field(*names: str) -> Column:
        values = [F.try_variant_get(reply, f"$.{n}", "string") for n in names]
        return F.coalesce(*[F.when(v != "", v) for v in values])

    def named(options: list[str], *names: str, default: str | None = None) -> Column:
        value = F.upper(field(*names))
        return F.when(value.isin(*options), value).otherwise(F.lit(default))

    listed = F.try_variant_get(reply, "$.keywords", "array<string>")
    words = F.slice(
        F.filter(F.transform(F.coalesce(listed, F.array()), strip), lambda w: w.isNotNull() & (w != "")),
        1,
        5,
    )
    whole = field("limit").try_cast("double").try_cast("int")
    limit = F.coalesce(F.when(whole != 0, whole), F.lit(5))
    keep = [c for c in df.columns if c != message]
    parsed = F.try_parse_json(F.regexp_extract(F.col(message), r"(?s)\{.*\}", 0))
    return df.withColumn(reply, parsed).select(
        *keep,
        named(INTENTS, "intent", default="GENERAL_CHAT").alias("intent"),
        F.array_join(words, "|").alias("keywords"),
        named(SORTS, "sort_by", "sortBy").alias("sort_by"),
        named(["ASC", "DESC"], "sort_direction", "sortDirection", default="DESC").alias("sort_direction"),
        field("candidate_index", "candidateIndex").try_cast("double").try_cast("int").alias("candidate_index"),
        named(TASKS, "answer_task", "answerTask").alias("answer_task"),
        F.least(F.greatest(limit, F.lit(1)), F.lit(10)).alias("limit"),
        F.greatest(
            F.lit(0.0), F.least(F.lit(1.0), F.coalesce(field("confidence").try_cast("double"), F.lit(0.0)))
        ).alias("confidence"),
    )


def context_line(items: Column, keys: list[str], limit: int = 8) -> Column:
    """First non-blank of ``keys`` of each of the first ``limit`` structs, joined."""
    picked = F.transform(
        F.slice(items, 1, limit), lambda s: F.coalesce(*[F.when(s[k] != "", s[k]) for k in keys])
    )
    return F.array_join(F.filter(picked, lambda v: v.isNotNull()), ", ")


def first_n_text(
    df: DataFrame, group: list[str], order: str, text: str, n: int, out: str
) -> DataFrame:
    """First ``n`` texts per group as one bulleted string; each group carries at most ``n`` texts."""
    from medialoom.functions.ranking import top_n

    ranked = top_n(df, group, [F.col(order)], n)
    packed = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- "), F.col(text)).alias("t"))))
    return ranked.groupBy(*group).agg(F.array_join(F.transform(packed, lambda s: s["t"]), "\n").alias(out))
