"""Rows that share an id but not the text or vector, hot copies, and columns with the names of inner ones."""

import random

import corpus_pipeline
from medialoom.llm.itq_neardup import embedding_components
from medialoom.llm.language import language_report
from medialoom.llm.line_dedup import dedup_lines
from medialoom.llm.mixing import mixed_documents
from medialoom.llm.substring_dedup import dedup_substrings


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))


def test_substrings_of_one_id_with_two_texts(spark):
    p, q = prose(1), prose(2)
    rows = [(1, p), (5, p), (5, q), (6, q[:300] + prose(3))]
    got = {(r.doc_id, r.n_bytes): r for r in dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[5, len(q)].removed_bytes == 0 and got[5, len(q)].text == q
    assert got[5, len(p)].removed_bytes == len(p) and got[1, len(p)].removed_bytes == 0
    assert 150 < got[6, len(rows[3][1])].removed_bytes <= 320


def test_vectors_of_one_id(spark):
    v, w = [1.0, 0.0, 0.2, 0.1], [0.0, 1.0, 0.1, -0.3]
    near = lambda x: [a + 0.01 for a in x]
    rows = [(1, v, 1), (1, w, 1), (2, near(v), 1), (3, near(w), 1), (3, v, 2), (4, v, 2)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_components(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (3, 1, 3), (4, 1, 3)]


def test_near_duplicates_of_one_id(spark):
    p, q = prose(4), prose(5)
    rows = [(1, p), (2, p), (2, q), (2, q), (3, p + " one more"), (9, ""), (9, None), (8, " "), (None, p)]
    df = spark.createDataFrame([(*r, "en", "s", 1, 7) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, _place int")
    out = corpus_pipeline.one_of_each_group(spark, df, "")
    assert out.columns == df.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted([(1, p), (2, q), (9, ""), (9, None), (8, " "), (None, p)], key=key)


def test_a_language_of_many_copies_is_learned(spark):
    rng = random.Random(6)
    word = lambda letters: "".join(rng.choices(letters, k=5))
    zz = [" ".join(word("xyzw") for _ in range(40)) for _ in range(3)]
    rows = [(i, zz[i % 3], "zz") for i in range(6000)] + [(10_000 + i, " ".join(word("abcd") for _ in range(40)), "aa") for i in range(300)]
    got = language_report(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert {(r.lang, r["count"]) for r in got.selectExpr("CASE WHEN doc_id < 10000 THEN 'zz' ELSE 'aa' END AS lang", "lang_pred").where("lang = lang_pred").groupBy("lang").count().collect()} == {("zz", 6000), ("aa", 300)}


def test_clashing_names_are_kept(spark):
    line = "this line has far more than fifty characters, and it is in both of them"
    names = ["_id", "_digest", "_removed", "_at", "_n", "_copies", "_rows", "_of", "_is"]
    rows = [(1, line, "a", *range(9)), (2, f"{line}\nown", "a", *range(9, 18))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"{n} int" for n in names))
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert got[2].text == "own" and [got[2][n] for n in names] == list(range(9, 18))
    mixed = mixed_documents(df)
    assert mixed.columns == df.columns
    assert all([r[n] for n in names] == list(range(9 * (r.doc_id - 1), 9 * r.doc_id)) for r in mixed.collect())
