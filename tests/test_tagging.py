import random

import numpy as np
from pyspark.sql import functions as F

from medialoom.operators import tagging as G

TOKEN = "sentence_id int, sentence_text string, form string, surface string, tag string, start int, len int, next_form string, next_tag string, next_start int"


def blocked(spark, *words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def token(text, form, tag, start, n, nxt=(None, None, None)):
    return (1, text, form, text[start : start + n], tag, start, n, *nxt)


def test_reject_cascade(spark):
    rows = [token("서울", "서울", "NNP", 0, 2), token("빨리", "빨리", "MAG", 0, 2), token("화", "화", "NNG", 0, 1), token("대해", "대해", "NNG", 0, 2), token("2현재", "2현재", "NNG", 0, 3), token("분노", "분노", "NNG", 0, 2), token("따르", "따르", "VV", 0, 2)]
    out = G.filter_tokens(spark.createDataFrame(rows, TOKEN), blocked(spark, "대해", "현재", "따르다"))
    got = {r.form: r.reject_reason for r in out.collect()}
    assert got == {"서울": "proper_noun", "빨리": "invalid_pos", "화": "too_short", "대해": "blocked_stopword", "2현재": "blocked_stopword", "분노": None, "따르": "blocked_stopword"}


def test_candidates_grow_and_take_dictionary_form(spark):
    text = "너무 무섭습니다, 불쾌하게 분노"
    rows = [token(text, "무섭", "VA", 3, 2), token(text, "불쾌", "XR", 10, 2, ("하", "XSA", 12)), token(text, "분노", "NNG", 15, 2), token(text, "불쾌", "XR", 10, 2, ("하", "XSA", 13))]
    out = G.build_candidates(spark.createDataFrame(rows, TOKEN).withColumn("reject_reason", F.lit(None).cast("string")))
    got = [(r.keyword_text, r.start_offset, r.end_offset, r.matched_word) for r in out.filter("reject_reason IS NULL").collect()]
    assert got == [("무섭다", 3, 8, "무섭습니다"), ("불쾌하다", 10, 14, "불쾌하게"), ("분노", 15, 17, "분노")]


HIT = "array<struct<rank:int,score:double,word:string,embed_text:string,clean_seed:string,polarity:int,category:string>>"


def resolve(spark, keyword, hits, tag="NNG", allowed=(-2, -1), **kw):
    cand = spark.createDataFrame([(keyword, tag, list(allowed))], "keyword_text string, tag string, allowed array<int>")
    rows = [(i + 1, s, w, w, c, p, cat) for i, (s, w, c, p, cat) in enumerate(hits)]
    table = spark.createDataFrame([(keyword, rows)], f"keyword_text string, hits {HIT}")
    r = G.resolve_hits(cand, table, **kw).first()
    return r.reject_reason, r.score


def test_seed_match_is_accepted_and_score_clamped(spark):
    assert resolve(spark, "분노", [(1.0000002, "분노", "분노", -2, "DIRECT_EMOTION")]) == (None, 1.0)
    assert resolve(spark, "분노", [(0.95, "분노", "분노", -2, "DIRECT_EMOTION")]) == (None, 0.95)


def test_reject_reasons(spark):
    assert resolve(spark, "분노", [(0.95, "분노", "분노", 2, "DIRECT_EMOTION")])[0] == "polarity_mismatch"
    assert resolve(spark, "책상", [(0.95, "분노", "분노", -1, "DIRECT_EMOTION")])[0] == "seed_mismatch"
    assert resolve(spark, "분노", [(0.5, "분노", "분노", -1, "X")])[0] == "below_threshold"
    assert resolve(spark, "분노", [])[0] == "no_hit"
    two = [(0.95, "분노", "분노", -1, "X"), (0.92, "분노", "분노2", -1, "X")]
    assert resolve(spark, "분노", two)[0] == "low_margin"


def test_fallback_needs_an_emotion_like_noun(spark):
    hit = [(0.94, "격분", "격분", -1, "DIRECT_EMOTION")]
    assert resolve(spark, "배신감", hit)[0] is None
    assert resolve(spark, "배신", hit)[0] == "seed_mismatch"
    assert resolve(spark, "배신하다", hit, tag="VV")[0] == "seed_mismatch"


def test_unsigned_hits_pass_unless_strict(spark):
    hit = [(0.95, "분노", "분노", 0, "X")]
    assert resolve(spark, "분노", hit)[0] is None
    assert resolve(spark, "분노", hit, allow_unsigned=False, match_seed=False)[0] == "polarity_mismatch"


def test_gate(spark):
    df = spark.createDataFrame([(1, {"슬픔": 0.5, "기쁨": 0.3, "없음": 0.1}), (2, {"기쁨": 0.3})], "id int, label_scores map<string,double>")
    a, b = G.emotion_gate(df).orderBy("id").collect()
    assert (a.gate_score, a.gate_passed, a.top_labels, a.allowed) == (0.5, True, ["슬픔", "기쁨"], [-2, -1, 1, 2])
    assert (b.gate_passed, b.allowed) == (False, [1, 2])
    off = G.emotion_gate(df, enabled=False).first()
    assert (off.gate_score, off.gate_passed, off.top_labels) == (1.0, True, [])


def test_blocklist_sections(spark):
    rows = [("block_confirmed", "대해"), ("auto_review_blocked", '{"surface": " 함께 "}'), ("keep_confirmed", "분노"), ("block_confirmed", " ")]
    words = {r.word for r in G.blocklist(spark.createDataFrame(rows, "section string, item string"), ["결국"]).collect()}
    assert words == {"대해", "함께", "결국"}


def test_top_k_equals_brute_force_in_one_or_many_slices(spark):
    rng = np.random.default_rng(0)
    q, t = rng.normal(size=(40, 8)), rng.normal(size=(60, 8))
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "qid int, vec array<double>")
    table = spark.createDataFrame([(f"t{i:02d}", [float(x) for x in v]) for i, v in enumerate(t)], "tid string, vec array<double>")
    cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (t / np.linalg.norm(t, axis=1, keepdims=True)).T
    want = {(i, r + 1, f"t{j:02d}") for i in range(40) for r, j in enumerate(np.argsort(-np.round(cos[i], 6), kind="stable")[:3])}
    for limit in (1 << 20, 1000):
        got = {(r.qid, r.rank, r.hit_id) for r in G.top_k_similar(queries, table, "qid", "tid", max_bytes=limit).collect()}
        assert got == want


def test_overlaps_equal_the_greedy_rule(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for s in range(40):
        items = []
        for i in range(rng.randint(1, 10)):
            a = rng.randint(0, 20)
            items.append((i, a, a + rng.randint(1, 6), rng.choice([1, 99])))
        rows += [(s, *x) for x in items]
        kept = []
        for i, a, b, p in sorted(items, key=lambda x: (x[3], x[0])):
            if all(b <= ka or a >= kb for _, ka, kb in kept):
                kept.append((i, a, b))
        want[s] = sorted(kept)
    df = spark.createDataFrame(rows, "sid int, seq bigint, start_offset int, end_offset int, p int")
    got: dict[int, list] = {}
    for r in G.resolve_overlaps(df, ["sid"], F.col("p")).collect():
        got.setdefault(r.sid, []).append((r.seq, r.start_offset, r.end_offset))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_keep_filter(spark):
    df = spark.createDataFrame([("분노", "EMOTIONALLY_LOADED"), ("걱정", "EMOTIONALLY_LOADED"), ("걱정", "OPINION_LIKE")], "keyword string, label_type string")
    kept = G.keep_filter(df, spark.createDataFrame([("분노",)], "word string"))
    assert sorted((r.keyword, r.label_type) for r in kept.collect()) == [("걱정", "OPINION_LIKE"), ("분노", "EMOTIONALLY_LOADED")]
    assert G.keep_filter(df, None).count() == 3
