import random

from pyspark.sql import functions as F

from medialoom.functions import columns as C
from medialoom.operators import text as T
from medialoom.sources.files import read_caption_files


def col(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, v {kind}")


def values(df, expr):
    return [r[0] for r in df.orderBy("id").select(expr).collect()]


def test_strip_and_squeeze_any_whitespace(spark):
    df = col(spark, ["\t a b \n", "　x", "  ", "a  b"])
    assert values(df, C.strip(F.col("v"))) == ["a b", "x", "", "a  b"]
    assert values(df, C.squeeze(F.col("v"))) == ["a b", "x", "", "a b"]


def test_round_clamp_and_ratio(spark):
    df = col(spark, [1.00005, -0.2, None, 0.12344], "double")
    assert values(df, C.clamp01(F.col("v"))) == [1.0, 0.0, None, 0.12344]
    assert values(df, C.round4(F.col("v")))[3] == 0.1234
    assert values(df, C.ratio(F.lit(1), F.lit(0)))[0] == 0.0


def test_first_seen_keeps_order_and_first_spelling(spark):
    df = spark.createDataFrame([(0, ["b", "A", "a", "B", "c"])], "id int, v array<string>")
    assert values(df, C.first_seen(F.col("v"))) == [["b", "A", "c"]]
    assert values(df, C.first_seen(F.col("v"), 2)) == [["b", "A"]]


def test_literal_count_does_not_overlap(spark):
    df = col(spark, ["aaaa", "a.b.c", "x"])
    assert values(df, C.literal_count(F.col("v"), F.lit("aa"))) == [2, 0, 0]
    assert values(df, C.literal_count(F.col("v"), F.lit("."))) == [0, 2, 0]


def test_generic_split_numbers_from_zero(spark):
    df = spark.createDataFrame([(1, "One. Two!  Three?\n\n Four")], "doc_id int, t string")
    rows = T.split_sentences(df, "t").orderBy("sentence_id").collect()
    assert [(r.sentence_id, r.sentence_text) for r in rows] == [(0, "One."), (1, "Two!"), (2, "Three?"), (3, "Four")]


def test_korean_split_uses_lines_and_final_syllables(spark):
    df = spark.createDataFrame([(1, "첫 문장이다 둘째예요 셋째\n넷째 줄. 다섯")], "doc_id int, t string")
    rows = T.split_sentences_ko(df, "t").orderBy("sentence_id").collect()
    assert [r.sentence_text for r in rows] == ["첫 문장이다", "둘째예요", "셋째", "넷째 줄.", "다섯"]


def test_prepared_sentences_keep_ids_and_count_the_kept(spark):
    df = spark.createDataFrame([(1, "Hi. A  longer   one. No. Another long one!")], "doc_id int, t string")
    rows = T.prepared_sentences(df, "t").orderBy("index").collect()
    assert [(r.sentence_id, r["index"], r.total, r.sentence_text) for r in rows] == [
        (1, 0, 2, "A longer one."),
        (3, 1, 2, "Another long one!"),
    ]


def test_long_chunks_cut_at_transition():
    left, right = "가" * 70 + " 나" * 10, "하지만 " + "다" * 60
    pieces = T.chunk_pieces(f"{left} {right}")
    assert pieces == [left, right]


def test_long_chunks_without_transition_are_cut_at_whitespace():
    text = " ".join(["가나다라"] * 40)
    pieces = T.chunk_pieces(text)
    assert all(20 <= len(p) <= 120 for p in pieces)
    assert " ".join(pieces) == text
    assert T.chunk_pieces("가" * 300) == ["가" * 300]


def test_split_long_distributes_the_same_pieces(spark):
    text = " ".join(["word"] * 120) + "\nshort"
    df = spark.createDataFrame([(7, text)], "doc_id int, t string")
    rows = T.split_long(df, "t").orderBy("piece_id", "part_id").collect()
    assert [r.sentence_text for r in rows] == T.chunk_pieces(text.split("\n")[0]) + ["short"]


def test_language_votes(spark):
    df = col(spark, ["the cat and the dog", "der Hund und die Katze", "1 2 3", "le la les"])
    assert values(df, T.detected_language(F.col("v"))) == ["en", "de", None, "fr"]


def test_clean_transcript(spark):
    df = col(spark, ["Kind: captions Language: ko  A &amp; B\n&lt;c&gt;", "plain  text"])
    assert values(df, T.clean_transcript(F.col("v"))) == ["A & B <c>", "plain text"]


def test_caption_lines(spark):
    vtt = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\n<c>Hello</c> there\n12\n  again "
    df = spark.createDataFrame([("v", vtt)], "video_id string, t string")
    assert [r.line_text for r in T.caption_lines(df, "t").orderBy("line_index").collect()] == ["Hello there", "again"]


def test_pick_track_prefers_region_language_then_first(spark):
    rows = [("a", "KR", "a.en.vtt"), ("a", "KR", "a.ko.vtt"), ("b", "KR", "b.fr.vtt"), ("b", "KR", "b.de.vtt"), ("c", "XX", "c.en.vtt"), ("c", "XX", "c.aa.vtt")]
    df = spark.createDataFrame(rows, "video_id string, region_code string, file_name string")
    got = {r.video_id: r.file_name for r in T.pick_track(df).collect()}
    assert got == {"a": "a.ko.vtt", "b": "b.de.vtt", "c": "c.en.vtt"}


def brute_merge(segments):
    out = segments[0].split() if segments else []
    for seg in segments[1:]:
        words = seg.split()
        best = 0
        for k in range(1, min(len(out), len(words)) + 1):
            if out[len(out) - k :] == words[:k]:
                best = k
        out += words[best:]
    return " ".join(out)


def test_merge_captions_equals_a_plain_fold(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for v in range(12):
        n = rng.randint(1, 40)
        segs = [" ".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 3, 8]))) for _ in range(n)]
        rows += [(f"v{v}", i, s) for i, s in enumerate(segs)]
        want[f"v{v}"] = brute_merge(segs)
    df = spark.createDataFrame(rows, "video_id string, position bigint, segment_text string")
    for block in (2, 4, 512):
        got: dict[str, list] = {}
        for r in T.merge_captions(df, block=block).collect():
            got.setdefault(r.video_id, []).append((r.position, r.new_text))
        assert {v: " ".join(t for _, t in sorted(p) if t) for v, p in got.items()} == want


def test_timestamps(spark):
    df = col(spark, ["2026-01-02T03:04:05Z", "2026-01-02", "2026", "soon", None, "2026-01-02 03:04:05+09:00"])
    got = values(df, F.unix_timestamp(T.parse_timestamp(F.col("v"), epoch=F.when(F.col("id") == 4, F.lit(5.0)))))
    assert got == [1767323045, 1767312000, None, None, 5, 1767323045 - 9 * 3600]


def test_terms_slugs_flags_and_templates(spark):
    df = col(spark, [" A\r\nb ", "x" * 100])
    assert values(df, T.normalize_term(F.col("v"))) == ["A b", "x" * 80]
    terms = T.normalize_terms(F.lit("Seed"), F.array(F.lit("seed"), F.lit(" b "), F.lit(""), F.lit("c")), 2)
    assert values(df, terms)[0] == ["Seed", "b"]
    slugs = col(spark, ["  US / China: 대만! ", "!!!"])
    assert values(slugs, T.keyword_slug(F.col("v"))) == ["search:us-china-대만", "search:unknown"]
    flags = col(spark, ["Yes", " 0 ", "maybe"])
    assert values(flags, T.parse_flag(F.col("v"))) == [True, False, None]
    assert values(col(spark, ["12  of 345"]), T.text_template(F.col("v"))) == ["<NUM> of <NUM>"]


def test_log_sentence_cascade(spark):
    schema = "id int, sentences array<struct<sentence_text:string>>, sentence_text string, raw_text string, language string"
    rows = [(1, [(" a ",), ("",)], "x", "y. z", "en"), (2, [(" ",)], " x ", "y", "en"), (3, None, None, "One. Two.", "en")]
    out = T.log_sentences(spark.createDataFrame(rows, schema)).orderBy("id", "index").collect()
    assert [(r.id, r.origin, r.text) for r in out] == [(1, "sentences", "a"), (2, "sentence_text", "x"), (3, "raw_text", "One."), (3, "raw_text", "Two.")]


def test_intent_cleaning(spark):
    msg = 'ok {"intent": "rank_analysis", "keywords": [" a ", "", "b"], "sortBy": "recent", "sort_direction": "up", "limit": 99, "confidence": 3} end'
    row = T.clean_intent(spark.createDataFrame([(1, msg), (2, "no json")], "id int, m string"), "m").orderBy("id").collect()
    assert (row[0].intent, row[0].keywords, row[0].sort_by, row[0].sort_direction, row[0].limit, row[0].confidence) == (
        "RANK_ANALYSIS", "a|b", "RECENT", "DESC", 10, 1.0,
    )
    assert (row[1].intent, row[1].limit, row[1].confidence) == ("GENERAL_CHAT", 5, 0.0)


def test_surrogate_id(spark):
    import hashlib

    df = col(spark, ["abc", "영상"])
    assert values(df, C.surrogate_id(F.col("v"))) == [int(hashlib.sha256(s.encode()).hexdigest()[:15], 16) for s in ("abc", "영상")]


def test_pieces_as_columns_equal_the_plain_ones(spark):
    rng = random.Random(9)
    parts = ["하지만", "그러나", "라고 밝혔다", "고 말했다", "이라며", "라고", ",", ", ", " ", "  ", "\t", "\u3000", "가나다", "word", "ß🙂", "x" * 30, "문제는"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 120))) for _ in range(400)] + ["", " ", "가" * 300, "a b" * 3000]
    df = col(spark, texts)
    assert values(df, T.cut_pieces(F.col("v"))) == [T.chunk_pieces(t) for t in texts]
    assert "Python" not in T.split_long(df.withColumnRenamed("v", "t"), "t")._jdf.queryExecution().toString()


def test_word_overlap_like_trying_every_length():
    rng = random.Random(10)
    for _ in range(3000):
        known, words = (["ab"[rng.random() < p] for _ in range(rng.randint(0, 12))] for p in (0.3, 0.3))
        want = max(k for k in range(min(len(known), len(words)) + 1) if known[len(known) - k :] == words[:k])
        assert T.word_overlap(known, words) == want


def test_merge_with_long_segments_after_many_repeats(spark):
    """The last segment is longer than all new words of thousands of segments before it, in one of the videos only."""
    n = 3000
    rows = [("long", i, "w1" if i else " ".join(f"w{j}" for j in range(1500, 0, -1))) for i in range(n)] + [("long", n, " ".join(f"w{j}" for j in range(1500, 0, -1)) + " end")]
    rows += [("plain", i, f"x{i} x{i + 1}") for i in range(n)]
    df = spark.createDataFrame(rows, "video_id string, position bigint, segment_text string")
    got = {(r.video_id, r.position): r.new_text for r in T.merge_captions(df, block=16).collect()}
    assert len(got) == 2 * n + 1
    assert got["long", n] == "end" and not any(got["long", i] for i in range(1, n))
    assert got["plain", 0] == "x0 x1" and all(got["plain", i] == f"x{i + 1}" for i in range(1, n))


def test_intent_fields_like_one_lookup_each(spark):
    """One parse into a variant gives what a look into the text for every field gave."""
    rng = random.Random(12)
    some = lambda: rng.choice(['"recent"', '"SCORE"', "7", "0", "2.5", '"3"', "null", "true", '""', '"asc"', "[1]", '{"a":1}', "1e1", "-4"])
    keys = ["intent", "sort_by", "sortBy", "sort_direction", "sortDirection", "candidate_index", "candidateIndex", "answer_task", "answerTask", "limit", "confidence"]
    replies = []
    for _ in range(150):
        fields = [f'"{k}": {some()}' for k in rng.sample(keys, rng.randrange(len(keys)))]
        fields += rng.choice([[], ['"keywords": [" a ", "", "b c", null, 3]'], ['"keywords": "a"'], ['"keywords": []']])
        replies.append("so " + "{" + ", ".join(fields) + rng.choice(["}", "}", "} end", ""]))
    df = col(spark, replies)
    body = F.regexp_extract("v", r"(?s)\{.*\}", 0)

    def field(*names):
        return F.coalesce(*[F.nullif(F.get_json_object(body, f"$.{n}"), F.lit("")) for n in names])

    one_of = lambda options, c, other=None: F.when(F.upper(c).isin(*options), F.upper(c)).otherwise(F.lit(other))
    number = lambda c: c.try_cast("double").try_cast("int")
    listed = F.coalesce(F.from_json(field("keywords"), "array<string>"), F.array())
    want = df.select(
        "id",
        one_of(T.INTENTS, field("intent"), "GENERAL_CHAT"),
        F.array_join(F.filter(F.transform(listed, C.strip), lambda w: w != ""), "|"),
        one_of(T.SORTS, field("sort_by", "sortBy")),
        one_of(["ASC", "DESC"], field("sort_direction", "sortDirection"), "DESC"),
        number(field("candidate_index", "candidateIndex")),
        one_of(T.TASKS, field("answer_task", "answerTask")),
        F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce(F.nullif(number(field("limit")), F.lit(0)), F.lit(5)))),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(field("confidence").try_cast("double"), F.lit(0.0)))),
    )
    got = T.clean_intent(df, "v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1 and "get_json_object" not in plan


def test_caption_files_in_splits(spark, tmp_path):
    """Files cut into many splits give the lines of the whole files, in their order."""
    rng = random.Random(13)
    for n in range(3):
        cues = [f"{i}\n00:{i:03}.000 --> 00:{i:03}.900\n<c>track {n} {i}</c> {'é' * rng.randrange(60)}\n" for i in range(200 * n)]
        (tmp_path / f"{n}.vtt").write_bytes(("WEBVTT\n\n" + rng.choice(["\n", "\r\n"]).join(cues)).encode())
    whole = spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    want = sorted(map(tuple, T.caption_lines(whole, "value").collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = read_caption_files(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got)) == want and len(want) == 600


def test_broadcast_is_bounded_in_rows_and_bytes(spark):
    df = spark.range(1000).select("id", F.repeat(F.lit("x"), 1000).alias("s"), F.array(F.lit("y" * 500)).alias("a"), F.lit(None).cast("map<string,int>").alias("m"))
    hinted = lambda **bounds: "broadcast" in C.bounded_broadcast(df, **bounds)._jdf.queryExecution().logical().toString()
    assert hinted() and not hinted(max_rows=999) and not hinted(max_bytes=1_400_000) and hinted(max_bytes=1_700_000)
