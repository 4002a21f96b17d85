import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from medialoom.functions.ranking import dense_position, first_per_key, top_n
from medialoom.operators import country as C
from medialoom.operators import evaluate as E
from medialoom.operators import graph as P
from medialoom.operators import ingest as I
from medialoom.operators import lexicon as L
from medialoom.operators import quality as Q
from medialoom.sources import files as R
from medialoom.streaming import streams as X


# --- ranking helpers ---------------------------------------------------------------------------------


def test_dense_position_equals_row_number_on_ties(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.choice([0.1, 0.5, 0.5])) for g in "ab" for i in rng.sample(range(5000), 400)]
    want = {}
    for g in "ab":
        ordered = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        want.update({(g, r[1]): n + 1 for n, r in enumerate(ordered)})
    df = spark.createDataFrame(rows, "g string, id bigint, s double")
    assert {(r.g, r.id): r["rank"] for r in dense_position(df, ["g"], "s", "id").collect()} == want


def test_first_per_key_and_top_n(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, o int, v string")
    assert {(r.k, r.v) for r in first_per_key(df, ["k"], ["o"]).collect()} == {("a", "y"), ("b", "z")}
    assert {(r.k, r.v) for r in top_n(df, ["k"], [F.col("o").desc()], 1).collect()} == {("a", "x"), ("b", "z")}


# --- ingest ------------------------------------------------------------------------------------------


def plain_select(rows, limit):
    used, seen, out = {}, set(), []
    for seq, video, country in sorted(rows):
        if video in seen or used.get(country, 0) >= limit:
            continue
        seen.add(video)
        used[country] = used.get(country, 0) + 1
        out.append((seq, video, country))
    return out


def test_selection_equals_the_sequential_rule(spark):
    rng = random.Random(9)
    rows, want = [], set()
    for q in range(60):
        items = [(i, f"v{rng.randint(0, 6)}", rng.choice(["KR", "US"]) if q % 2 else "KR") for i in range(rng.randint(1, 15))]
        if q % 2 == 0:
            items = [(i, v, "KR" if int(v[1:]) % 2 else "US") for i, v, _ in items]
        rows += [(f"r{q}", *x) for x in items]
        want |= {(f"r{q}", *x) for x in plain_select(items, 2)}
    df = spark.createDataFrame(rows, "request_id string, seq int, video_id string, country_code string")
    assert {tuple(r) for r in I.select_candidates(df, 2).collect()} == want


def test_oversized_request_is_rejected(spark):
    df = spark.createDataFrame([("r", i, f"v{i}", "KR") for i in range(121)], "request_id string, seq int, video_id string, country_code string")
    assert I.select_candidates(df, 5).count() == 0


def test_requests_of_any_size_are_selected_exactly(spark):
    rng = random.Random(4)
    plain = [(i, f"v{i % 90}", "KR" if i % 90 % 2 else "US") for i in range(400)]
    mixed = [(i, f"v{rng.randint(0, 150) if i > 60 else i % 2}", rng.choice(["KR", "US", "CN"])) for i in range(400)]
    rows = [("plain", *x) for x in plain] + [("mixed", *x) for x in mixed]
    want = {("plain", *x) for x in plain_select(plain, 3)} | {("mixed", *x) for x in plain_select(mixed, 3)}
    df = spark.createDataFrame(rows, "request_id string, seq int, video_id string, country_code string")
    assert {tuple(r) for r in I.select_candidates(df, 3, most=None).collect()} == want


def test_ingest_queries_select_from_large_requests(spark, tmp_path):
    from medialoom.plans import ingest_queries

    ts = datetime.datetime(2024, 1, 3)
    rows = [(i, ts, user, "view", 1.0, f'{{"k": {i % 40}}}') for i in range(300) for user in (7, i)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    out = ingest_queries.ingest_candidates(spark, str(tmp_path)).filter("request_id = 'rt-7-1'").collect()
    assert {(r.seq, r.video_id, r.country_code) for r in out} == {(i, f"v{i}", ("KR", "US", "CN")[i % 3]) for i in range(6)}


def test_candidate_fields(spark):
    rows = [("r", 1, " v1 ", " t ", "kr", "KO", 1.0), ("r", 2, "v2", " ", "kr", "ko", 1.0), ("r", 3, "v3", "t", "k", "ko", 1.0), ("r", 4, "v4", "t", "kr", "ko", -1.0)]
    df = spark.createDataFrame(rows, "request_id string, seq int, video_id string, title string, country_code string, language string, view_count double")
    out = I.normalize_candidates(df).orderBy("seq").collect()
    assert (out[0].video_id, out[0].country_code, out[0].language) == ("v1", "KR", "ko")
    assert [r.reject_reason for r in out] == [None, "title", "country_code", "view_count"]


def test_existing_success_is_skipped(spark):
    df = spark.createDataFrame([("r", 1, "kr1", "KR"), ("r", 2, "kr2", "KR"), ("r", 3, "us1", "US")], "request_id string, seq int, video_id string, country_code string")
    done = spark.createDataFrame([("us1",)], "video_id string")
    out = {r.video_id: r.skipped for r in I.mark_existing(I.select_candidates(df, 1), done).collect()}
    assert out == {"kr1": False, "us1": True}


def test_job_states(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 1, 1)], "queued_count int, success_count int, failed_count int")
    assert [r[0] for r in df.select(I.job_status()).collect()] == ["QUEUED", "RUNNING", "COMPLETED", "COMPLETED_WITH_ERRORS"]


def test_latest_row_keeps_creation_time(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 3, "new"), ("a", 2, "mid")], "k string, t int, v string")
    row = I.latest_rows(df, ["k"], ["t"], "t").first()
    assert (row.v, row.created_at) == ("new", 1)


def test_recent_or_all(spark):
    df = spark.createDataFrame([(1, 10), (2, None), (3, 1)], "id int, t int")
    assert {r.id for r in I.recent_or_all(df, "t", F.lit(5)).collect()} == {1, 2}
    assert {r.id for r in I.recent_or_all(df.filter("t is not null"), "t", F.lit(50)).collect()} == {1, 3}


# --- streams -----------------------------------------------------------------------------------------


def test_streams_over_several_batches_equal_the_batch_result(spark, tmp_path):
    rng = random.Random(4)
    schema = "user_id int, v int, t int"
    everything = []
    for b in range(4):
        rows = [(rng.randint(0, 5), rng.randint(0, 9), b * 100 + i) for i in range(20)]
        everything += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{b}"))
    batch = spark.createDataFrame(everything, schema)
    want = {tuple(r) for r in I.latest_rows(batch, ["user_id"], ["t"], "t").collect()}
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    got = X.upsert_stream(spark, stream, ["user_id"], ["t"], "t").select("user_id", "v", "t", "created_at")
    assert {tuple(r) for r in got.collect()} == want

    outcome = F.when(F.col("v") < 5, "success").otherwise("failed")
    shaped = lambda df: df.select(F.col("user_id").cast("string").alias("request_id"), outcome.alias("outcome"))
    jobs = X.job_stream(spark, shaped(stream)).select("request_id", "success_count", "failed_count")
    plain = I.job_counts(shaped(batch)).select("request_id", "success_count", "failed_count")
    assert {tuple(r) for r in jobs.collect()} == {tuple(r) for r in plain.collect()}


def test_log_falls_back_and_drops_old_days(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_dt_interval(id) AS ts, id FROM range(10)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = X.log_stream(spark, stream, "ts", str(tmp_path / "log"), str(tmp_path / "second"), keep_days=3)
    assert {str(r.day) for r in out.select("day").distinct().collect()} == {"2024-01-07", "2024-01-08", "2024-01-09", "2024-01-10"}


# --- files -------------------------------------------------------------------------------------------


def test_csv_with_bom_and_padding(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("﻿id,name\n 1 , a \n2,\n", encoding="utf-8")
    rows = R.read_csv_trimmed(spark, str(path), ["id", "name"]).collect()
    assert [tuple(r) for r in rows] == [("1", "a"), ("2", "")]


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\nnot json\n{"id": " "}\n')
    assert [r.id for r in R.read_jsonl_tolerant(spark, str(tmp_path / "a.jsonl"), "id string", "id").collect()] == ["1"]
    (tmp_path / "b.json").write_text('[{"id": "1"},\n {"id": "2"}]')
    assert R.read_json_array(spark, str(tmp_path / "b.json"), "id string").count() == 2
    (tmp_path / "c.jsonl").write_text('{"sentence_text": "x", "gold": "yes", "relevance": "9"}\n')
    schema = "sentence_text string, gold string, relevance string"
    assert R.read_jsonl_strict(spark, str(tmp_path / "c.jsonl"), schema, fail=False).first().reject_reason == "relevance"
    with pytest.raises(Exception, match="invalid row"):
        R.read_jsonl_strict(spark, str(tmp_path / "c.jsonl"), schema).collect()
    with pytest.raises(ValueError):
        R.require_rows(spark.createDataFrame([], "id int"))


def test_request_payload(spark):
    df = spark.createDataFrame([(["  첫 문장  ", "", "둘째 문장"],)], "sentences array<string>")
    row = R.request_payload(df, "sentences").first()
    assert (row.sentence_count, row.sentences_json) == (2, '["첫 문장","둘째 문장"]')


# --- graph -------------------------------------------------------------------------------------------


def video(i, country, views, opinion=0.5, status="SUCCESS"):
    return (i, f"{country} title", country, f"2026-01-{views % 28 + 1:02d}", float(views), status, opinion)


VIDEO = "video_id string, title string, country string, published_at string, view_count double, status string, opinion_score double"


def test_same_issue_pairs_equal_all_pairs(spark):
    rng = random.Random(8)
    vids = [video(f"v{i}", rng.choice(["KR", "US", "CN"]), rng.randint(1, 10**6)) for i in range(80)]
    edges = sorted({(f"v{rng.randint(0, 79)}", f"i{rng.choice([0, 0, 0, 1, 2])}") for _ in range(120)})
    issues: dict[str, set] = {}
    for v, i in edges:
        issues.setdefault(v, set()).add(i)
    by_id = {v[0]: v for v in vids}
    want = set()
    for s in issues:
        for c in ("KR", "US", "CN"):
            if c == by_id[s][2]:
                continue
            pool = [v for v in vids if v[2] == c and v[0] != s and issues.get(v[0], set()) & issues[s]]
            pool.sort(key=lambda v: v[0])
            pool.sort(key=lambda v: (v[4], v[3]), reverse=True)
            want |= {(s, c, v[0]) for v in pool[:3]}
    videos, part_of = spark.createDataFrame(vids, VIDEO), spark.createDataFrame([(*e, "X") for e in edges], "video_id string, issue_id string, cluster_type string")
    best = P.best_per_issue(videos, part_of, 3)
    got = {(r.source_id, r.country, r.video_id) for r in P.same_issue_pairs(videos, part_of, best, 3).collect()}
    assert got == want


def test_candidates_are_ranked_per_issue_set(spark):
    """A hundred sources of one set of issues cost one list, whatever their number; the fallback fills short lists in the row."""
    vids = [video(f"v{i:03}", "KR" if i < 100 else "US", i + 1) for i in range(104)] + [video("x", "CN", 5)]
    edges = [(f"v{i:03}", "i0", "X") for i in range(104)]
    videos, part_of = spark.createDataFrame(vids, VIDEO), spark.createDataFrame(edges, "video_id string, issue_id string, cluster_type string")
    sources = P.issue_sets(videos, part_of)
    assert sources.count() == 105
    per_set = P.best_per_set(sources, P.best_per_issue(videos, part_of, 3), 3)
    assert per_set.count() == 6
    lists = P.lists_of_sources(sources, per_set.drop("rank"))
    assert {r.source_id: r.candidates for r in lists.collect()}["v000"] == [("US", "v101"), ("US", "v102"), ("US", "v103")]
    pool = spark.createDataFrame([("US", "v100"), ("US", "v103"), ("CN", "x"), (None, "y")], "country string, video_id string")
    filled = {r.source_id: [tuple(c) for c in r.candidates] for r in P.with_fallback(lists, pool, 4).collect()}
    assert sorted(filled["v000"]) == [("CN", "x", 1), ("US", "v100", 1), ("US", "v101", 0), ("US", "v102", 0), ("US", "v103", 0)]
    assert sorted(filled["x"]) == [("US", "v100", 1), ("US", "v103", 1)]


def test_keyword_extraction(spark):
    df = spark.createDataFrame([(["a, b", "A", "news", None], "x"), ([], "the Big title")], "raw array<string>, t string")
    got = [r[0] for r in df.select(P.extract_keywords(F.col("raw"), F.col("t"), 5)).collect()]
    assert got == [["a", "b"], ["Big", "title"]]


def test_dictionary_expansion(spark):
    terms = spark.createDataFrame([("트럼프 대만",), ("트럼프 경제",)], "term string")
    words = spark.createDataFrame([("트럼프", "trump", "特朗普"), ("대만", "taiwan", "台湾")], "token string, en string, zh string")
    got = {r.term: (r.en_terms, r.zh_terms[0]) for r in P.expand_terms(terms, words, 4).collect()}
    assert got["트럼프 대만"] == (["trump taiwan", "trump", "taiwan"], "特朗普 台湾")
    assert got["트럼프 경제"] == (["트럼프 경제", "trump"], "트럼프 경제")


def test_default_keywords_only_without_data(spark):
    some = spark.createDataFrame([("k", 1, 1)], "keyword string, n_countries bigint, n_videos bigint")
    assert [r.keyword for r in P.with_default_keywords(some, 5).collect()] == ["k"]
    assert P.with_default_keywords(some.filter("false"), 5).count() == 5


# --- reports, quality, evaluation, lexicon -----------------------------------------------------------


def test_balanced_sample(spark):
    rows = [(f"v{i}", f"2026-01-{i:02d}", ["a"] if i > 4 else ["a", "b"]) for i in range(1, 10)]
    df = spark.createDataFrame(rows, "video_id string, published_at string, issues array<string>")
    got = {r.video_id: r.picked_for for r in C.balanced_sample(df, ["a", "b"], 5).collect()}
    assert got == {"v9": "a", "v8": "a", "v4": "b", "v3": "b", "v7": "top-up"}


def test_quality_rules(spark):
    cols = "row_number int, " + ", ".join(f"{c} string" for c in Q.REQUIRED) + ", backup_rank string"
    good = ["demo", "Demo", "KR", "ko", "y1", "t", "c", "c1", "2026-01-01T00:00:00Z", "r", ""]
    bad = ["x", "Other", "JP", "ja", "y1", "", "c", "c1", "soon", "r", "1"]
    df = spark.createDataFrame([(2, *good), (3, *bad)], cols)
    assert [(r.row_number, r.column_name) for r in Q.required_cells(df).collect()] == [(3, "title")]
    assert {r.rule for r in Q.row_rules(df, "demo", "Demo").collect()} == {"issue_id", "issue_name", "country_code", "published_at"}
    assert [r.row_number for r in Q.duplicate_keys(df, "youtube_video_id").collect()] == [3]
    assert {r.country: r.finding for r in Q.country_counts(df, draft=True).collect()} == {c: "warning: too few" for c in ("KR", "US", "CN")}
    assert Q.column_report(["issue_id", "zzz"])[1] == ["zzz"]


def test_error_patterns(spark):
    rows = [("FP", "w", f"text {chr(97 + i)}") for i in range(4)] + [("FP", "sure", f"a{i} b" if i < 3 else f"c{i}") for i in range(5)]
    got = {r.word: (r.support_unique_text, r.template_count, r.status) for r in E.error_patterns(spark.createDataFrame(rows, "error_type string, word string, sentence_text string")).collect()}
    assert got == {"w": (4, 4, "candidate"), "sure": (5, 2, "confirmed")}


def test_rank_stability(spark):
    rows = [("base", i, s, "A") for i, s in enumerate([0.9, 0.8, 0.7, 0.6])] + [("rev", i, s, "A") for i, s in enumerate([0.6, 0.7, 0.8, 0.9])]
    df = spark.createDataFrame(rows, "variant string, target_id int, overall double, dataset string")
    got = {(r.variant, r.part): r.spearman for r in E.rank_stability(df, "base").collect()}
    assert got == {("base", "ALL"): 1.0, ("base", "A"): 1.0, ("rev", "ALL"): -1.0, ("rev", "A"): -1.0}


def test_sweeps_have_the_expected_variants():
    assert len(E.simplex_weights(10)) == 66
    names = E.relevance_variants()
    assert len(names) == len(set(names.values())) == 1 + 14 + 125 - 7
    with pytest.raises(ValueError):
        E.simplex_weights(0)


def test_sweep_means_equal_those_of_the_multiplied_rows(spark):
    """Groups of one row, ties, groups over several Arrow batches, and groups without a relevant row; rows are not multiplied."""
    rng = random.Random(4)
    rows = [(f"s{i % 9 if i % 3 else 0}", "k" if i % 2 else None, "KR", i, rng.randint(0, 3), *(float(rng.randint(0, 2)) for _ in range(4)), i % 2 == 0, 0.5, True) for i in range(300)]
    rows += [("one", "k", "KR", 1, 0, 1.0, 1.0, 1.0, 1.0, True, 0.1, True)]
    cols = "source_id string, keyword string, country string, candidate_id int, relevance int, issue_overlap_count double, shared_keyword_count double, shared_entity_count double, semantic_similarity double, analysis_success boolean, view_score double, published_at boolean"
    df = spark.createDataFrame(rows, cols)
    df = df.fillna("none", ["keyword"])
    names = dict(list(E.relevance_variants().items())[:12])
    scored = E.variant_scores(df, names)
    want = sorted(map(tuple, E.variant_means(E.ranking_metrics(scored), E.against_baseline(scored)).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        means = E.sweep_means(df, names)
        assert sorted(map(tuple, means.collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Generate" not in means._jdf.queryExecution().toString()


def test_ab_separation(spark):
    rows = [("v", "A", 0.9), ("v", "A", 0.8), ("v", "B", 0.2)]
    r = E.ab_separation(spark.createDataFrame(rows, "variant string, dataset string, overall double")).first()
    assert (r.a_mean, r.b_mean, r.margin, r.strict_ok) == (0.85, 0.2, 0.6, True)
    assert r.loss == pytest.approx((0.01 + 0.04) / 2 + 0.04, abs=1e-4)


def test_dictionary_cleaning(spark):
    rows = [(1, "아름다운 모양", "아름답 모양", "1"), (2, "분노", "", "-2"), (3, "x", "", "1"), (4, "분노", "", "0"), (5, "", "", "1")]
    df = spark.createDataFrame(rows, "row_id int, word string, word_root string, polarity string")
    tag = lambda f: F.when(f == "아름답", "VA").otherwise("NNG")
    none = spark.createDataFrame([], "word string")
    got = {r.row_id: (r.clean_seed, r.category, r.reject_reason) for r in L.clean_dictionary(df, none, tag).collect()}
    assert got[1] == ("아름답다", "EVALUATIVE_WORD", None)
    assert got[2] == ("분노", "DIRECT_EMOTION", None)
    assert [got[i][2] for i in (3, 4, 5)] == ["non_korean", "invalid_polarity", "empty_text"]


def test_mining_counts_a_seed_once_per_text(spark):
    rows = [("가난 가난하다 슬프", ["슬픔"])] * 3 + [("슬프", ["기쁨"])]
    tag = lambda f: F.when(f == "가난하다", "VA").when(f == "슬프", "VA").otherwise("NNG")
    none = spark.createDataFrame([], "word string")
    out = L.mine_lexicon(spark.createDataFrame(rows, "text string, labels array<string>"), none, tag, min_freq=3)
    assert {r.embed_text: (r.count_hint, r.polarity) for r in out.collect()} == {"가난하다": (3, -1), "슬프다": (4, -1)}


def test_merge_keeps_both_signs(spark):
    a = spark.createDataFrame([("s", -1, "x"), ("s", 1, "x")], "embed_text string, polarity int, category string")
    b = spark.createDataFrame([("s", -1, "y", 0.9, 30)], "embed_text string, polarity int, category string, score_hint double, count_hint int")
    assert {(r.polarity, r.source) for r in L.merge_lexicons(a, b).collect()} == {(-1, "knu+kote"), (1, "knu")}


def test_decisions(spark):
    rows = [("분노", 9), ("말하다", 8), ("어렵다", 7), ("먹다", 6), ("책", 5), ("알려진", 4)]
    stats = spark.createDataFrame([(k, n, 1, 0.5) for k, n in rows], "keyword string, count int, video_count int, max_score double")
    known = spark.createDataFrame([("알려진",)], "word string")
    got = {r.keyword: (r.decision, r.reason) for r in L.review_decisions(stats, known, n=3).collect()}
    assert got == {"분노": ("PROTECTED", "core emotion word"), "말하다": ("BLOCK", "general or functional word"), "어렵다": ("REVIEW", "depends on context"), "먹다": ("REVIEW", "new predicate")}


def test_review_statistics(spark):
    rows = [("k", "K", Decimal("0.5"), 1, 0, 0, "q1"), ("k", "k", Decimal("0.7"), 1, 1, 0, "q1"), ("k", "k", Decimal("0.6"), 2, 0, 0, "q2")]
    df = spark.createDataFrame(rows, "keyword string, surface string, score decimal(10,4), doc_id int, sentence_id int, token_index int, search_keyword string")
    r = L.review_candidates(df).first()
    assert (r["count"], r.video_count, r.search_words, r.max_score, r.avg_score, r.surfaces, r.examples) == (3, 2, 2, 0.7, 0.6, "k:2|K:1", "1/0|1/1|2/0")
