"""Steps whose tables per task or shuffles must not grow with the input."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from medialoom.operators import country, graph, ingest
from medialoom.operators import keywords as K
from medialoom.operators import similarity, tagging
from medialoom.plans import lexicon_queries, tag_queries
from medialoom.sources import views as V


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange " in line or line.strip(" +-:").startswith("Exchange") for line in plan.splitlines())


def focus_rows(spark):
    return spark.createDataFrame(
        [(d, s, w, w, "VV" if w == "run" else "NNG", 2) for d in (1, 2) for s in (0, 1) for w in ("run", "tree", "house")],
        "doc_id int, sentence_id int, form string, surface string, tag string, total int",
    )


def test_focus_keywords_shuffle_partitioned_tokens_once(spark):
    ranked = K.focus_keywords(focus_rows(spark).repartition(4, "doc_id"))
    out = K.with_noun_quota(ranked, ["doc_id"], K.focus_order())
    assert exchanges(out) == 1
    rows = sorted((r.doc_id, r.slot, r.keyword) for r in out.collect())
    assert rows == [(d, n, w) for d in (1, 2) for n, w in ((1, "house"), (2, "run다"), (3, "tree"))]


def test_keyword_shares_shuffle_partitioned_rows_once(spark):
    rows = spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.25), (1, "b", 0.25)], "doc_id int, keyword string, s double")
    rows = rows.withColumn("s", F.col("s").cast("decimal(8,4)")).repartition(4, "doc_id")
    shares = K.keyword_shares(rows, F.col("s"), ["doc_id"])
    assert exchanges(shares) == 1
    assert {r.keyword: r.score for r in shares.collect()} == {"a": 0.75, "b": 0.25}


def test_noun_quota_takes_nouns_below_the_cut_in_order(spark):
    words = ["p1다", "p2다", "p3다", "p4다", "n1", "p5다", "n2", "n3"]
    df = spark.createDataFrame([(1, w, float(9 - i)) for i, w in enumerate(words)], "doc_id int, keyword string, score double")
    out = K.with_noun_quota(df, ["doc_id"], [F.col("score").desc(), F.col("keyword")], 5, 3)
    assert [r.keyword for r in out.orderBy("slot").collect()] == ["p1다", "p2다", "n3", "n2", "n1"]


def test_text_parts_follow_the_bytes_of_the_text(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(64)], "doc_id int, text string")
    monkeypatch.setattr(V, "PART_BYTES", 100)
    assert V.partitioned_texts(docs, "doc_id", "text").rdd.getNumPartitions() == 64


def test_pieces_hold_no_more_rows_than_asked_and_lose_none():
    batch = pa.RecordBatch.from_arrays([pa.array(range(10))], ["x"])
    cut = list(similarity.pieces(iter([batch, batch.slice(0, 0)]), 4))
    assert [b.num_rows for b in cut] == [4, 4, 2]
    assert [x for b in cut for x in b.column("x").to_pylist()] == list(range(10))


def test_search_in_lists_is_the_same_in_small_pieces(spark, monkeypatch):
    rows = spark.range(300).select(F.col("id").cast("string").alias("word"), F.array(*[F.sin(F.col("id") * k) for k in range(1, 9)]).alias("vec"))
    asked = rows.select(F.col("word").cast("long").alias("q"), "vec")
    find = lambda: sorted(map(tuple, similarity.top_k_by_lists(asked, rows, "q", "word").collect()))
    whole = find()
    monkeypatch.setattr(similarity, "PIECE_BYTES", 8 * 8 * 16)
    assert find() == whole


def test_token_places_leave_python_as_numbers_in_code_points(spark):
    assert tagging._starts.returnType.simpleString() == "array<int>"
    rows = spark.createDataFrame([(1, "\U0001f600 ab 가나, x cd"), (2, "!"), (3, None)], "doc_id int, sentence_text string")
    found = tagging.token_rows(rows, V.tag_of).orderBy("token_index").collect()
    assert [(r.doc_id, r.form, r.start, r.next_form, r.next_start) for r in found] == [(1, "ab", 2, "가나", 5), (1, "가나", 5, "cd", 11), (1, "cd", 11, None, None)]


def test_lexical_similarity_shuffles_no_single_words(spark):
    texts = spark.createDataFrame([(1, "war war trade"), (2, "War trade deal"), (3, "!"), (4, None), (5, "sun"), (5, "sun rain")], "id int, text string")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 1), (2, 3), (3, 4), (2, 5), (5, 5), (1, 9)], "left_id int, right_id int")
    out = graph.lexical_similarity(pairs, texts)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "token" in line]
    got = {(r.left_id, r.right_id): r.similarity for r in out.collect()}
    assert got == {(1, 2): 0.7746, (2, 1): 0.7746, (1, 1): 1.0, (2, 3): None, (3, 4): None, (2, 5): 0.0, (5, 5): 1.0, (1, 9): None}


def test_candidates_are_shuffled_once_into_parts_that_follow_their_number(spark, monkeypatch):
    monkeypatch.setattr(ingest, "PART_ROWS", 20, raising=False)
    rows = [(f"r{i % 40}", i, f"v{i % 7}", "KR" if i % 40 or i % 7 else ("KR", "US")[i % 2]) for i in range(400)]
    rows += [("large", 1000 + i, f"w{i}", "KR") for i in range(121)] + [(None, 2000, "v1", "KR")]
    df = spark.createDataFrame(rows, "request_id string, seq int, video_id string, country_code string")
    out = ingest.select_candidates(df, 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    shuffles = {re.sub(r"#\d+", "", line.split("Exchange ")[1].split(", [plan_id")[0]) for line in plan.splitlines() if "Exchange hashpartitioning" in line}
    counts, rows_once = "hashpartitioning(request_id, 8), ENSURE_REQUIREMENTS", "hashpartitioning(request_id, 27), REPARTITION_BY_NUM"
    assert shuffles == {counts, rows_once}
    want = set()
    for request in {r[0] for r in rows} - {None, "large"}:
        used, seen = {}, set()
        for _, seq, video, country in sorted((r for r in rows if r[0] == request), key=lambda r: r[1]):
            if video not in seen and used.get(country, 0) < 2:
                seen.add(video)
                used[country] = used.get(country, 0) + 1
                want.add((request, seq, video, country))
    assert {tuple(r) for r in out.collect()} == want


def test_runs_are_made_once_to_be_compared(spark):
    a, b = spark.range(6).select((F.col("id") % 3).alias("x")), spark.range(7).select((F.col("id") % 3).alias("x"))
    out = country.same_rows(a, b)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 2
    assert tuple(out.first()) == (0, 1, False)
    assert tuple(country.same_rows(b, a).first()) == (1, 0, False)
    assert tuple(country.same_rows(a, a).first()) == (0, 0, True)
    assert tuple(country.same_rows(a.limit(0), a.limit(0)).first()) == (0, 0, True)


def test_context_reads_lines_once(spark):
    rows = [("1", 2, "b a", "Brand#12", "t"), ("1", 1, "c", "Brand#13", "t"), ("1", 3, "c", "Brand#12", "u"), ("2", 1, "the", "Brand#2", "t"), ("4", 1, "x1", "Brand#2", "t")]
    lines = spark.createDataFrame(rows, "video_id string, l_linenumber int, p_name string, p_brand string, p_type string")
    videos = spark.createDataFrame([("1", "title one"), ("2", ""), ("3", "alone here")], "video_id string, title string")
    out = graph.video_context_of_lines(videos, V.line_edges(lines))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
    want = graph.video_context(videos, V.part_of(lines), V.has_entity(lines), V.keyword_rows(lines))
    assert sorted(map(tuple, out.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


SMALL = "/root/testdata/sf0.001"


def reads_documents(df):
    return any("documents.parquet" in f for f in df.inputFiles())


def test_words_are_cut_once(spark):
    assert not reads_documents(tag_queries.emotion_spans_simple(spark, SMALL))


def test_opinions_and_tokens_are_made_once(spark):
    assert not reads_documents(tag_queries.reject_stats(spark, SMALL))


def test_spans_are_found_once(spark):
    assert not reads_documents(lexicon_queries.review_decisions(spark, SMALL))


def video_records(spark):
    rows = [(f"v{i:02d}", ("KR", "US")[i % 2], f"2026-01-{1 + i % 9:02d}", [["War", "sun"], ["war Trade"], ["x"]][i % 3], "ch" + str(i % 4), float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "video_id string, country string, published_at string, keywords array<string>, channel string, view_count double")
    return df.select("*", F.lit("A Deal").alias("title"), F.lit(None).cast("string").alias("status"))


def test_records_make_keywords_and_issues_once(spark):
    slow = video_records(spark).withColumn("keywords", F.transform("keywords", lambda k: F.concat(k, F.lit("marker"))))
    out = country.issue_records(slow, ["KR", "US"], ["war", "trademarker", "deal"], "2026-01-01", "2026-01-09")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("marker), namedlambda") <= 1
    assert {(r.video_id, tuple(r.issues)) for r in out.collect()} == {(f"v{i:02d}", [("war", "deal"), ("war", "trademarker", "deal"), ("deal",)][i % 3]) for i in range(30)}
    assert country.issue_records(slow, ["KR", "US"], ["gone"], "2026-01-01", "2026-01-09").count() == 0


def test_sample_and_channels_read_records_once(spark):
    records = country.issue_records(video_records(spark), ["KR", "US"], ["war", "sun"], "2026-01-01", "2026-01-09")
    sample = country.balanced_sample(records, ["sun", "war"], 6)
    assert sample._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    newest = sorted((r.published_at, r.video_id, r.issues) for r in records.collect())[::-1]
    suns = [v for _, v, i in newest if "sun" in i][:3]
    wars = [v for _, v, i in newest if v not in suns][:3]
    assert {tuple(r) for r in sample.collect()} == {(v, "sun") for v in suns} | {(v, "war") for v in wars}
    best = country.channel_centrality(country.by_issue(records), 5)
    assert "LogicalRDD" not in best._jdf.queryExecution().optimizedPlan().toString()
    assert {r.community_size for r in best.collect()} == {2}
