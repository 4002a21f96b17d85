"""Collocations and count automata against plain counting."""

import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from medialoom.llm.automata import CountAutomaton, union
from medialoom.llm.collocations import collocations

SCHEMA = "doc_id bigint, text string, lang string, n string, score string, part string"
WORDS = st.lists(st.sampled_from([b"a", b"b", b"c", "ß".encode()]), min_size=1, max_size=5).map(tuple)
COUNTS = st.dictionaries(WORDS, st.integers(1, 9), max_size=40)


def brute(docs, least, longest=5, percent=100, top=2000):
    out = []
    named = lambda lang: "und" if lang is None else lang
    for lang in {named(d[1]) for d in docs}:
        grams, n = Counter(), 0
        for text, of in docs:
            if named(of) != lang:
                continue
            lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
                words = re.findall(r"[^\x20\x09]+", piece)
                n += len(words)
                grams.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
        found = []
        for p, a in grams.items():
            if len(p) < 2 or a < least:
                continue
            holds = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
            if any(len(q) > len(p) and b >= least and 100 * b >= percent * a and holds(q) for q, b in grams.items()):
                continue
            score, _, l, r = min((1000 * a * n // (grams[p[:k]] * grams[p[k:]]), k, grams[p[:k]], grams[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "ßA", "x y", "naïve", "end", "🙂", "z\x1cq", "in", "\x00"]
    ends = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\x0b", "!", ": "]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice([text, text + "Once upon a time, in the end of it all"]), rng.choice(["en", "en", "de", None, "und", ""])))
    return rows + [(None, "en"), ("", "en"), ("alone", "xx"), ("Once upon a time " * 5000, "de")]


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, t, l, "n", "s", "p") for i, (t, l) in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in collocations(df, **more).collect())


def test_like_plain_counting(spark):
    rows = texts(1, 400)
    assert found(spark, rows, least=20) == brute(rows, 20) != []
    assert found(spark, rows, least=60, longest=3, percent=50, top=7) == brute(rows, 60, 3, 50, 7) != []


def test_repeated_rows_count_each_and_large_counts_stay_exact(spark):
    rows = [("to be or not to be. Or not", "en")] * 300 + [("to be", None)] * 300
    assert found(spark, rows, least=300) == brute(rows, 300) != []


def test_shards_and_flushes_give_the_same(spark, monkeypatch):
    from medialoom.llm import collocations as module

    rows = texts(2, 300)
    monkeypatch.setattr(module, "IDS_HELD", 5)
    monkeypatch.setattr(module, "WINDOWS_HELD", 50)
    monkeypatch.setattr(module, "BYTES_AT_ONCE", 100)
    assert [b for t in (b"abc. d" * 50, b"x" * 500) for b in [b"".join(module.cut_long(t))]] == [b"abc. d" * 50, b"x" * 500]
    every = np.full((module.LEVELS, (1 << 16) // 8), 255, np.uint8)
    one, total = module.Shard(every, 16, 4, 5), Counter()
    for text, lang in rows:
        for part in module.cut_long((text or "").encode()):
            one.add(str(lang), [part])
            if one.full():
                for l, _, data in one.given_out():
                    for string, n in CountAutomaton.from_bytes(data).strings():
                        total[l, string] += n
                one.clear()
    for l, _, data in one.given_out():
        for string, n in CountAutomaton.from_bytes(data).strings():
            total[l, string] += n
    want = Counter()
    for text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = [w.encode() for w in re.findall(r"[^\x20\x09]+", piece)]
            for i in range(len(words)):
                want[str(lang), (words[i],)] += 1
                if i + 1 < len(words):
                    want[str(lang), tuple(words[i : i + 5])] += 1
    assert total == want


def test_nothing_to_count(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None), ("", "en"), ("a b", "en")], least=2) == []


@settings(max_examples=200, deadline=None)
@given(COUNTS, COUNTS, COUNTS)
def test_automata(a, b, asked):
    both = Counter(a) + Counter(b)
    machines = [CountAutomaton.from_bytes(CountAutomaton.build(sorted(x.items())).to_bytes()) for x in (a, b)]
    assert dict(machines[0].strings()) == a
    one = union(machines)
    assert list(one.strings()) == sorted(both.items())
    starting = lambda p: sum(n for s, n in both.items() if s[: len(p)] == p)
    prefixes = {s[:k] for s in both for k in range(2, len(s) + 1)}
    want = {p: starting(p) for p in prefixes if starting(p) >= 5} | {s: n for s, n in both.items() if len(s) == 1 and n >= 5}
    assert dict(one.prefixes(5)) == want
    got = dict(one.compose(CountAutomaton.build(sorted(asked.items()))))
    assert got == {s: both[s] if len(s) == 1 else starting(s) for s in asked if s in both or len(s) > 1 and starting(s)}


def test_automata_are_minimal():
    strings = sorted((x, y, z) for x in (b"a", b"b") for y in (b"c", b"d") for z in (b"e", b"f"))
    assert len(CountAutomaton.build((s, 1) for s in strings).starts) - 1 == 4
