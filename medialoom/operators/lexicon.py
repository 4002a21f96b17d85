"""Lexicon building, mining and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialoom.functions.columns import among, let, round4, strip, tokens
from medialoom.functions.lexemes import (
    ADJECTIVE_NOUNS,
    BLOCK_PREDICATES,
    BLOCK_SURFACES,
    CONTEXT_PREDICATES,
    CORE_KEEP,
    DESCRIPTOR_NOUNS,
    EMOTION_NOUNS,
    GENERIC_NOUNS,
    GENERIC_PREDICATES,
    LEXICON_BLACKLIST,
    MINING_STOPWORDS,
    NEGATIVE_LABELS,
    NEUTRAL_LABEL,
    NEWS_MODIFIERS,
    NEWS_TOPICS,
    NOUN_VERB_SEEDS,
    POSITIVE_LABELS,
    RAW_BLACKLIST,
    SEED_BLACKLIST_V1,
)
from medialoom.functions.ranking import first_per_key, top_n
from medialoom.operators.tagging import mark_blocked
from medialoom.operators.terms import term_hits
from medialoom.session import materialize

HANGUL = "[가-힣]"
GENERIC = sorted({*LEXICON_BLACKLIST, *DESCRIPTOR_NOUNS, *GENERIC_NOUNS, *GENERIC_PREDICATES})

# Mining bounds and list lengths.
MIN_FREQ, MIN_RATIO = 20, 0.7
NEW_DECISIONS = 50


def predicate_seed(form: Column) -> Column:
    return F.when(form.endswith("다"), form).otherwise(F.concat(form, F.lit("다")))


def root_seed(form: Column) -> Column:
    return F.when(form.endswith("하다"), form).otherwise(F.concat(form, F.lit("하다")))


def valid_polarity(c: Column) -> Column:
    """Non-zero integer polarity, else null."""
    value = strip(c.cast("string")).try_cast("int")
    return F.when(value != 0, value)


def category(seed: Column, polarity: Column, emotion_nouns: list[str] = EMOTION_NOUNS) -> Column:
    return (
        F.when(among(seed, emotion_nouns), "DIRECT_EMOTION").when(polarity < 0, "NEGATIVE_STATE").otherwise("EVALUATIVE_WORD")
    )


def content_tokens(text: Column, tag, script: str = HANGUL) -> Column:
    """Content words as (form, tag): particles, endings, suffixes and descriptor nouns dropped."""
    pairs = F.transform(tokens(text), lambda f: F.struct(f.alias("form"), tag(f).alias("tag")))
    return F.filter(
        pairs,
        lambda p: p["form"].rlike(script) & ~p["tag"].rlike("^(J|E|XS)") & ~among(p["form"], DESCRIPTOR_NOUNS),
    )


def mark_generic(rows: DataFrame, blocked: DataFrame, form: str) -> DataFrame:
    """``generic`` flag: the form or its base, with any predicate ending, is blocked or a general word."""
    base = F.when(F.col(form).endswith("다"), F.expr(f"left({form}, length({form}) - 1)")).otherwise(F.col(form))
    marked = mark_blocked(rows.withColumn("_base", base), blocked, "_base", form, strip_digits=False)
    return marked.withColumn("generic", F.col("blocked") | among(F.col("_base"), GENERIC)).drop("blocked", "_base")


def clean_dictionary(
    rows: DataFrame, blocked: DataFrame, tag, script: str = HANGUL, emotion_nouns: list[str] = EMOTION_NOUNS
) -> DataFrame:
    """Dictionary rows with their clean seed or the reason they are rejected.

    ``rows(row_id, word, word_root, polarity)``. The seed is the first by kind: fixed noun and verb pairs,
    direct emotion nouns, predicates, roots, adjective nouns; then by position.
    """
    word, root = strip(F.coalesce("word", F.lit(""))), strip(F.coalesce("word_root", F.lit("")))
    source = F.when(root != "", root).otherwise(word)
    base = rows.select(
        "row_id", word.alias("word"), root.alias("word_root"), valid_polarity(F.col("polarity")).alias("polarity"), source.alias("source_text")
    )
    usable = base.filter((F.col("source_text") != "") & F.col("source_text").rlike(script))
    listed = usable.select("row_id", content_tokens(F.col("source_text"), tag, script).alias("_c"))
    each = listed.select("row_id", "_c", F.posexplode("_c").alias("place", "_t")).withColumn("_n", F.get("_c", F.col("place") + 1))
    each = each.select("row_id", "place", F.col("_t.form").alias("form"), F.col("_t.tag").alias("tag"), F.col("_n.form").alias("nf"), F.col("_n.tag").alias("nt"))
    marked = mark_generic(each, blocked, "form")
    form, kind = F.col("form"), F.col("tag")
    pair = F.lit(None).cast("string")
    for (noun, verb), seed in NOUN_VERB_SEEDS.items():
        pair = F.when((form == noun) & (F.col("nf") == verb) & (kind == "NNG") & F.col("nt").startswith("VV"), seed).otherwise(pair)
    plain = ~F.col("generic")
    choice = (
        F.when(pair.isNotNull(), F.struct(F.lit(0).alias("kind"), "place", pair.alias("seed")))
        .when(plain & (kind == "NNG") & among(form, emotion_nouns), F.struct(F.lit(1).alias("kind"), "place", form.alias("seed")))
        .when(plain & kind.rlike("^(VA|VV)"), F.struct(F.lit(2).alias("kind"), "place", predicate_seed(form).alias("seed")))
        .when(plain & (kind == "XR"), F.struct(F.lit(3).alias("kind"), "place", root_seed(form).alias("seed")))
        .when(plain & (kind == "NNG") & among(form, ADJECTIVE_NOUNS), F.struct(F.lit(4).alias("kind"), "place", root_seed(form).alias("seed")))
    )
    seeds = marked.groupBy("row_id").agg(F.min(choice)["seed"].alias("clean_seed"))
    reason = (
        F.when(F.col("polarity").isNull(), "invalid_polarity")
        .when(F.col("source_text") == "", "empty_text")
        .when(~F.col("source_text").rlike(script), "non_korean")
        .when(F.col("clean_seed").isNull(), "no_emotion_candidate")
    )
    out = base.join(seeds, "row_id", "left").withColumn("reject_reason", reason)
    good = F.col("reject_reason").isNull()
    return out.withColumns(
        {
            "clean_seed": F.when(good, F.col("clean_seed")),
            "category": F.when(good, category(F.col("clean_seed"), F.col("polarity"), emotion_nouns)),
        }
    ).drop("source_text")


def surface_rows(cleaned: DataFrame, blocked: DataFrame, tag, script: str = HANGUL) -> DataFrame:
    """Surface entries from word and root, first row per (text, polarity).

    A text is dropped when it is listed, contains a listed word once spaces are removed, or holds a general
    word. All listed words are searched at once, by one automaton.
    """
    texts = cleaned.filter(F.col("polarity").isNotNull()).select(
        "row_id", "polarity", "clean_seed", "category", F.posexplode(F.array("word", "word_root")).alias("place", "embed_text")
    )
    first = first_per_key(
        texts.filter((F.col("embed_text") != "") & F.col("embed_text").rlike(script)), ["embed_text", "polarity"], ["row_id", "place"]
    )
    listed = first.filter(~among(F.col("embed_text"), LEXICON_BLACKLIST) & ~among(F.col("embed_text"), RAW_BLACKLIST))
    words = blocked.select(F.replace("word", F.lit(" "), F.lit("")).alias("term"))
    compact = listed.select("embed_text", F.replace("embed_text", F.lit(" "), F.lit("")).alias("_compact")).distinct()
    holding = term_hits(compact, ["embed_text"], "_compact", words).select("embed_text").distinct()
    clear = listed.join(holding, "embed_text", "left_anti")
    each = clear.select("embed_text", "polarity", F.explode(content_tokens(F.col("embed_text"), tag, script)).alias("_t"))
    generic = mark_generic(each.select("embed_text", "polarity", F.col("_t.form").alias("form")), blocked, "form")
    bad = generic.filter("generic").select("embed_text", "polarity").distinct()
    return clear.join(bad, ["embed_text", "polarity"], "left_anti").select(
        "embed_text",
        "polarity",
        F.col("clean_seed").alias("canonical_seed"),
        F.coalesce("category", F.lit("BROAD_KNU")).alias("category"),
        "row_id",
    )


def row_polarity(labels: Column) -> Column:
    """-1 or 1 by the majority of label signs; null for the neutral label, a tie or no label."""
    count = lambda names: F.size(F.filter(labels, lambda x: x.isin(*names)))
    neg, pos = count(NEGATIVE_LABELS), count(POSITIVE_LABELS)
    return F.when(
        (F.size(labels) > 0) & ~F.array_contains(labels, NEUTRAL_LABEL) & (neg != pos), F.when(neg > pos, -1).otherwise(1)
    )


def mine_lexicon(
    corpus: DataFrame,
    blocked: DataFrame,
    tag,
    script: str = HANGUL,
    emotion_nouns: list[str] = EMOTION_NOUNS,
    min_freq: int = MIN_FREQ,
    min_ratio: float = MIN_RATIO,
) -> DataFrame:
    """Seeds of a labelled corpus with one dominant sign.

    ``corpus(text, labels ARRAY<STRING>)``. A seed counts once per text: its forms are grouped inside the
    row's own array, so there is no distinct over the corpus, and blocking is decided once per form list.
    """
    def seed_of(form: Column) -> Column:
        return let(
            tag(form),
            lambda kind: F.when((kind == "NNG") & among(form, emotion_nouns), form)
            .when((kind == "NNG") & among(form, ADJECTIVE_NOUNS), root_seed(form))
            .when(kind.startswith("VA") | kind.startswith("VV"), predicate_seed(form))
            .when(kind == "XR", root_seed(form)),
        )

    signed = corpus.select(tokens(F.col("text")).alias("_w"), row_polarity(F.col("labels")).alias("sign")).filter("sign IS NOT NULL")
    pairs = F.transform(F.array_distinct("_w"), lambda f: F.struct(seed_of(f).alias("seed"), f.alias("form")))
    usable = lambda p: (
        p["seed"].isNotNull() & p["form"].rlike(script) & ~among(p["form"], LEXICON_BLACKLIST) & ~among(p["form"], MINING_STOPWORDS)
    )
    named = signed.select("sign", F.filter(pairs, usable).alias("_p"))
    seeds = F.array_distinct(F.transform("_p", lambda p: p["seed"]))
    alone = F.transform("_p", lambda p: F.struct(p["seed"].alias("seed"), F.array(p["form"]).alias("forms")))
    grouped = F.transform(
        seeds,
        lambda s: F.struct(
            s.alias("seed"),
            F.array_sort(F.transform(F.filter("_p", lambda p: p["seed"] == s), lambda p: p["form"])).alias("forms"),
        ),
    )
    entries = F.when(F.size(seeds) == F.size("_p"), alone).otherwise(grouped)
    counted = (
        named.select("sign", F.inline(entries))
        .groupBy("seed", "forms")
        .agg(F.count_if(F.col("sign") < 0).alias("neg"), F.count_if(F.col("sign") > 0).alias("pos"))
    )
    each = counted.select("seed", "forms", "neg", "pos", F.explode("forms").alias("form"))
    open_forms = mark_generic(each, blocked, "form").filter(~F.col("generic"))
    once = open_forms.groupBy("seed", "forms").agg(F.max("neg").alias("neg"), F.max("pos").alias("pos"))
    sums = once.groupBy(F.col("seed").alias("embed_text")).agg(F.sum("neg").alias("neg_count"), F.sum("pos").alias("pos_count"))
    total = F.col("neg_count") + F.col("pos_count")
    share = F.greatest("neg_count", "pos_count") / total
    polarity = F.when(F.col("neg_count") >= F.col("pos_count"), -1).otherwise(1)
    return sums.filter((total >= min_freq) & (share >= min_ratio)).select(
        "embed_text",
        polarity.alias("polarity"),
        category(F.col("embed_text"), polarity, emotion_nouns).alias("category"),
        round4(share).alias("score_hint"),
        total.alias("count_hint"),
        "neg_count",
        "pos_count",
    )


def merge_lexicons(first: DataFrame, mined: DataFrame) -> DataFrame:
    """Union on (text, polarity): the first list's row wins and carries the mined hints."""
    a = first.select("embed_text", "polarity", F.col("category").alias("_ca"), F.lit("knu").alias("_a"))
    b = mined.select("embed_text", "polarity", F.col("category").alias("_cb"), "score_hint", "count_hint", F.lit("kote").alias("_b"))
    joined = a.join(b, ["embed_text", "polarity"], "full_outer")
    return joined.select(
        "embed_text", "polarity", F.coalesce("_ca", "_cb").alias("category"), F.concat_ws("+", "_a", "_b").alias("source"), "score_hint", "count_hint"
    )


def first_lexicon(rows: DataFrame, script: str = HANGUL, blacklist: list[str] = SEED_BLACKLIST_V1) -> DataFrame:
    """Negative entries only: distinct texts of word and root whose root is not blacklisted, first row wins."""
    kept = rows.filter(
        (valid_polarity(F.col("polarity")) <= -1) & F.col("word_root").rlike(script) & ~among(F.col("word_root"), blacklist)
    )
    texts = kept.select("row_id", "word_root", "polarity", F.posexplode(F.array("word", "word_root")).alias("place", "embed_text"))
    return first_per_key(texts.filter(F.col("embed_text").rlike(script)), ["embed_text"], ["row_id", "place"]).drop("place")


# --- review ------------------------------------------------------------------------------------------


def review_candidates(spans: DataFrame, surfaces_kept: int = 5, examples_kept: int = 5) -> DataFrame:
    """Statistics per emotion keyword found in the corpus.

    ``spans(keyword, surface, score DECIMAL, doc_id, sentence_id, token_index, search_keyword)``. Counts
    run over partial aggregates; the short lists come from pruned rankings, so a frequent keyword never
    sends its rows to one task. The spans are written once, because four aggregates read them.
    """
    columns = ["keyword", "surface", "score", "doc_id", "sentence_id", "token_index", "search_keyword"]
    spans = materialize(spans.select(*columns), "spans")
    per_doc = spans.groupBy("keyword", "doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.max("score").alias("m"), F.collect_set("search_keyword").alias("q")
    )
    stats = per_doc.groupBy("keyword").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("video_count"), F.sum("s").alias("_s"), F.max("m").cast("double").alias("max_score")
    )
    searches = per_doc.select("keyword", F.explode("q").alias("q")).distinct().groupBy("keyword").agg(F.count(F.lit(1)).alias("search_words"))
    by_surface = spans.groupBy("keyword", "surface").agg(F.count(F.lit(1)).alias("n"))
    top_surfaces = top_n(by_surface, ["keyword"], [F.col("n").desc(), F.col("surface")], surfaces_kept)
    surfaces = top_surfaces.groupBy("keyword").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "surface", F.col("n").cast("string")).alias("t")))).alias("_l")
    )
    order = [F.col("doc_id"), F.col("sentence_id"), F.col("token_index")]
    examples = top_n(spans.select("keyword", "doc_id", "sentence_id", "token_index"), ["keyword"], order, examples_kept)
    examples = examples.groupBy("keyword").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("sentence_id").cast("string")).alias("t")))).alias("_e")
    )
    joined = stats.join(searches, "keyword").join(surfaces, "keyword").join(examples, "keyword")
    text = lambda c: F.array_join(F.transform(c, lambda x: x["t"]), "|")
    return joined.select(
        "keyword", "count", "video_count", "search_words", "max_score", round4(F.col("_s").cast("double") / F.col("count")).alias("avg_score"),
        text("_l").alias("surfaces"), text("_e").alias("examples"),
    )


def auto_decision(
    keyword: Column,
    keep: list[str] = CORE_KEEP,
    block: list[str] = BLOCK_PREDICATES + BLOCK_SURFACES,
    context: list[str] = CONTEXT_PREDICATES,
) -> Column:
    """Decision and its kind for an unreviewed keyword."""
    kind = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))
    return (
        F.when((keyword == "") | among(keyword, keep), kind("PROTECTED", "core emotion word"))
        .when(among(keyword, block), kind("BLOCK", "general or functional word"))
        .when(among(keyword, context), kind("REVIEW", "depends on context"))
        .when(keyword.endswith("다"), kind("REVIEW", "new predicate"))
        .otherwise(kind("REVIEW", "new noun"))
    )


def review_decisions(stats: DataFrame, known: DataFrame, n: int = NEW_DECISIONS, **lists) -> DataFrame:
    """The ``n`` most supported unknown keywords with a decision, and the protected ones met before the cut."""
    fresh = stats.join(known.select(F.col("word").alias("keyword")).distinct(), "keyword", "left_anti")
    decided = fresh.withColumn("_d", auto_decision(F.col("keyword"), **lists)).select(
        "keyword", "count", "video_count", "max_score", F.col("_d.decision").alias("decision"), F.col("_d.reason").alias("reason")
    )
    support = F.struct((-F.col("count")).alias("a"), (-F.col("video_count")).alias("b"), (-F.col("max_score")).alias("c"), F.col("keyword").alias("d"))
    ranked = materialize(decided, "decided").withColumn("_s", support)
    chosen = ranked.filter(F.col("decision") != "PROTECTED").orderBy("_s").limit(n)
    cut = chosen.agg(F.max("_s").alias("_cut"), F.count(F.lit(1)).alias("_n"))
    protected = ranked.filter(F.col("decision") == "PROTECTED").join(F.broadcast(cut))
    reached = (F.col("_n") < n) | (F.col("_s") < F.col("_cut"))
    return chosen.drop("_s").unionByName(protected.filter(reached).drop("_s", "_cut", "_n"))


def merge_decisions(existing: DataFrame, decided: DataFrame) -> DataFrame:
    """Existing (section, word) rows and the new words no section holds yet."""
    section = F.when(F.col("decision") == "BLOCK", "block_confirmed").otherwise("auto_review_blocked")
    new = decided.filter(F.col("decision") != "PROTECTED").select(section.alias("section"), F.col("keyword").alias("word")).distinct()
    known = existing.filter(F.col("section") != "review_pending").select("word").distinct()
    return existing.select("section", "word", F.lit(False).alias("added")).unionByName(
        new.join(known, "word", "left_anti").select("section", "word", F.lit(True).alias("added"))
    )


def search_phrases(existing: DataFrame, limit: int) -> DataFrame:
    """Topic and modifier phrases: topics of the data first, then the fixed ones, at most ``limit``.

    ``existing(topic, place)``. The modifiers are literals exploded per topic; nothing is cross joined.
    """
    spark = existing.sparkSession
    fixed = spark.createDataFrame([(t, 1_000_000 + i) for i, t in enumerate(NEWS_TOPICS)], "topic string, place bigint")
    listed = existing.select(strip(F.col("topic")).alias("topic"), F.col("place").cast("bigint").alias("place"))
    topics = listed.unionByName(fixed).filter("topic <> ''").groupBy("topic").agg(F.min("place").alias("place"))
    few = topics.orderBy("place").limit(limit)
    rows = few.select("topic", "place", F.posexplode(F.array(*[F.lit(m) for m in NEWS_MODIFIERS])).alias("m", "modifier"))
    phrase = F.concat_ws(" ", "topic", "modifier", F.lit("뉴스"))
    return rows.orderBy("place", "m").limit(limit).select(phrase.alias("phrase"), "place", "m")


def histogram(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Value counts per key as one text, most frequent first. Values come from a small vocabulary."""
    counted = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    item = F.struct((-F.col("n")).alias("a"), F.col(value).alias("v"), F.col("n").alias("n"))
    packed = counted.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_h"))
    text = F.transform("_h", lambda x: F.concat_ws(":", x["v"].cast("string"), x["n"].cast("string")))
    return packed.select(key, F.array_join(text, "|").alias(out))


def token_summary(accepted: DataFrame) -> DataFrame:
    """Accepted tokens per surface: counts, distinct sentences and documents, histograms, best score."""
    per_sentence = accepted.groupBy("surface", "doc_id", "sentence_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("m"))
    per_doc = per_sentence.groupBy("surface", "doc_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("s"), F.max("m").alias("m"))
    base = per_doc.groupBy("surface").agg(
        F.sum("n").alias("accept_count"), F.sum("s").alias("sentence_count"), F.count(F.lit(1)).alias("doc_count"), F.max("m").cast("double").alias("max_score")
    )
    return (
        base.join(histogram(accepted, "surface", "tag", "tags"), "surface")
        .join(histogram(accepted, "surface", "polarity", "polarities"), "surface")
    )
