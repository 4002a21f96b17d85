"""The Jaccard join against comparing all pairs of word-shingle sets."""

import itertools
import random
import re

import pytest

from medialoom.llm.jaccard_join import jaccard_components

SCHEMA = "doc_id bigint, text string, n bigint, id string"


def brute(rows, k, percent):
    sets = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = {i: i for i in range(len(rows))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
            parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups.setdefault(find(i), []).append(d)
    return sorted(
        ((d, len(s), min(groups[find(i)]) if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str
    )


def made_up(n=160):
    rng = random.Random(5)
    words = [f"W{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 20, 60, 200]))] for _ in range(25)]
    rows = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(t)))
    return rows + [(900, None), (901, ""), (902, " \n "), (903, "x"), (904, "X"), (905, "É x y"), (906, "é x y"), (None, "a b c d")]


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 50)])
def test_like_all_pairs(spark, k, percent):
    rows = made_up()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in jaccard_components(df, k=k, percent=percent).collect()), key=str)
    assert got == brute(rows, k, percent)


def test_long_text_repeated_row_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    df = spark.createDataFrame([(1, long, 0, ""), (2, long + " end", 0, ""), (2, long + " end", 0, "")], SCHEMA)
    assert sorted(map(tuple, jaccard_components(df).collect())) == [(1, 69996, 1), (2, 69997, 1), (2, 69997, 1)]
    assert jaccard_components(df.where("false")).count() == 0


def test_one_id_with_several_texts_links_by_each_of_them(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(5, one), (5, two), (6, one + " end"), (7, two + " end"), (8, "nothing like these at all")]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_components(df).collect()}
    assert got == {(5, 5), (6, 5), (7, 5), (8, 8)}
