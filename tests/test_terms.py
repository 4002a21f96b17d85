"""Many-term search against plain string methods, and the operators that use it against their literal twins."""

import random

import pytest
from medialoom.operators import country, evaluate, graph, lexicon, terms
from medialoom.operators.terms import term_hits
from pyspark.sql import functions as F

ALPHABET = "abß🙂é "


def made(seed, n, longest):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("max_characters", [1 << 20, 300, 20])
def test_like_str_count(spark, max_characters):
    texts, words = made(1, 300, 40), made(2, 200, 5) + ["aa", "aaa"]
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(900, None, "n"), (901, "aaaaa", "n"), (901, "aaaaa", "n")]
    df = spark.createDataFrame(rows, "id int, body string, m string")
    got = [tuple(r) for r in term_hits(df, ["id", "m"], "body", spark.createDataFrame([(w,) for w in [*words, None]], "term string"), max_characters).collect()]
    want = [(i, "n", w, t.count(w)) for i, t, _ in rows if t for w in set(words) if w and w in t]
    assert sorted(got) == sorted(want)


def test_no_terms_and_no_texts(spark):
    df = spark.createDataFrame([(1, "a")], "id int, body string")
    none = spark.createDataFrame([("",), (None,)], "term string")
    assert term_hits(df, ["id"], "body", none).count() == 0
    with pytest.raises(ValueError):
        term_hits(df.withColumnRenamed("id", "n"), ["n"], "body", none)
    assert term_hits(df.filter("false"), ["id"], "body", spark.createDataFrame([("a",)], "term string")).count() == 0


def test_fifty_thousand_terms(spark):
    """Every id in words is a term; each text holds three of them."""
    words = spark.range(50_000).select(F.concat(F.lit("w"), F.col("id"), F.lit(".")).alias("term"))
    texts = spark.range(2_000).select("id", F.concat_ws(" ", *[F.concat(F.lit("w"), F.col("id") * 25 + j, F.lit(".")) for j in (0, 7, 24)]).alias("body"))
    out = term_hits(texts, ["id"], "body", words)
    assert out.count() == 6_000
    assert out.select("term").distinct().count() == 6_000
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def context(spark):
    rng = random.Random(4)
    words = ["Trade", "war", "tariff", "the", "Taiwan", "x-ray", "a/b", "summit"]
    rows = []
    for i in range(200):
        title = " ".join(rng.choices(words, k=rng.randint(1, 5)))
        rows.append((f"v{i:03d}", rng.choice(["KR", "US"]), title, rng.choices(words, k=3), "2026-01-0" + str(rng.randint(1, 9)), float(rng.randint(0, 9)), rng.choice(["SUCCESS", None, "FAILED"])))
    return spark.createDataFrame(rows, "video_id string, country string, title string, keywords array<string>, published_at string, view_count double, status string")


def test_search_with_few_and_with_many_terms(spark, monkeypatch):
    df, wanted = context(spark), [" Trade War", "x-ray", "tariff tariff", "the", "a/b", "gone", "", "Taiwan the summit", "war"]
    few = [tuple(r) for r in graph.search_videos(df, wanted, 20).orderBy("country", "rank").collect()]
    monkeypatch.setattr(graph, "FEW_TERMS", 0)
    assert [tuple(r) for r in graph.search_videos(df, wanted, 20).orderBy("country", "rank").collect()] == few != []


def test_terms_are_tried_once_per_set_of_words(spark):
    """Texts of one set of words share the trials, and their own counts still decide their points."""
    rows = [(f"v{i:02d}", "KR", " ".join(["war"] * (i + 1) + ["trade"]), ["war trade"], "", 0.0, None) for i in range(12)]
    df = spark.createDataFrame(rows, "video_id string, country string, title string, keywords array<string>, published_at string, view_count double, status string")
    terms = spark.createDataFrame([("war trade",), ("war war",), ("trade",), ("gone war",)], "term string")
    out = graph.search_videos_by_terms(df, terms, 20)
    assert "_set" in out._jdf.queryExecution().toString()
    want = {r.video_id: r.score for r in graph.search_videos(df, [t.term for t in terms.collect()], 20).collect()}
    assert {r.video_id: r.score for r in out.collect()} == want and len(set(want.values())) == 12


def test_issues_and_target_words_with_few_and_with_many(spark, monkeypatch):
    df, issues = context(spark), ["Taiwan", "WAR", "war", "ra", "nothing"]
    run = lambda: sorted(map(repr, country.issue_records(df, ["kr"], issues, "2026-01-02", "2026-01-08").select("video_id", "issues").collect()))
    rows = df.select(F.col("title").alias("sentence_text"), (F.col("view_count") > 2).alias("pred"), "video_id")
    hits = lambda: sorted(map(repr, evaluate.keyword_hits(rows, ["war", "Tr", "war ", "w"]).collect()))
    few = run(), hits()
    monkeypatch.setattr(country, "FEW_TERMS", 0)
    monkeypatch.setattr(evaluate, "FEW_TERMS", 0)
    assert (run(), hits()) == few
    assert all(few)


def test_blocked_words_need_no_nested_loop(spark):
    rows = [(1, 1, "good mood", "mood", "c", "mood"), (2, -1, "bad mood", "bad", "c", "bad"), (3, 1, "fine", "fine", "c", "fine")]
    cleaned = spark.createDataFrame(rows, "row_id int, polarity int, word string, word_root string, category string, clean_seed string")
    blocked = spark.createDataFrame([("ad m",), (" ",)], "word string")
    out = lexicon.surface_rows(cleaned, blocked, lambda form: F.lit("NNG"), r"[a-z]")
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
    assert {r.embed_text for r in out.collect()} == {"good mood", "mood", "bad", "fine"}
    assert terms.FEW_TERMS > 0


def test_many_terms_leave_texts_where_they_are(spark):
    """No text is shuffled however many terms there are; only what may be a term is."""
    texts = spark.range(300).select("id", F.concat_ws(" ", F.lit("x" * 50), F.concat(F.lit("w"), F.col("id")), F.lit("w7")).alias("body"))
    words = spark.range(300).select(F.concat(F.lit("w"), F.col("id")).alias("term"))
    out = term_hits(texts, ["id"], "body", words, 20)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    want = sum(f"w{j}" in f"w{i} w7" for i in range(300) for j in range(300))
    assert out.count() == want


def test_windows_over_the_end_of_a_step(spark, monkeypatch):
    monkeypatch.setattr(terms, "STEP", 7)
    texts, words = made(5, 60, 60), [*made(6, 80, 9), "aa", "aaa", "aaaaaaaaaaaa"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "a" * 40])], "id int, body string")
    step = terms._possible_hits(spark.createDataFrame([(w,) for w in sorted({*words} - {""})], "term string"), ["id"])
    rows = df.select("id", F.col("body").alias("_text")).mapInArrow(step, "id int, term string, n long").collect()
    got = {(r.id, r.term, r.n) for r in rows if r.term in words}
    assert got == {(i, w, t.count(w)) for i, t in enumerate([*texts, "a" * 40]) for w in words if w and w in t}
