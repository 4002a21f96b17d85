"""Reply trees against walking every tree in plain Python, and round trips through the template."""

import hashlib
import random
import re

from medialoom.llm.reply_trees import escaped, format_chats, format_turns, read_back, unescaped
from pyspark.sql import functions as F

SCHEMA = "conv bigint, msg string, parent string, role string, text string, score double, tree string, branch int"
NASTY = ["<s>", "<\\s>", "</s>", "<\\\\/s>", "[INST]", "[/INST]", "[\\INST]", "<<SYS>>", "<</SYS>>", "<|im_end|>", "<|im_end|>\n", "<|im_start|>", "\\", "<", "[", "<|im_end|", "\n", "", "ß🙂", "%", "%0A", "<|endoftext|>", "$1"]


def conversations(spark, rows, branches=1):
    df = spark.createDataFrame([(*r, "t", 9) for r in rows], SCHEMA)
    out = format_chats(df, branches)
    return out.withColumns(read_back(F.col("formatted"), F.col("mask"))).collect()


def brute(rows, branches):
    """(conv, branch) to the turns of its path; every message once in these tests."""
    out = {}
    for conv in {r[0] for r in rows}:
        held = {r[1]: r for r in rows if r[0] == conv and r[1] is not None}
        above = lambda m: held[m][2] if held[m][2] in held and held[m][2] != m else None  # noqa: E731, B023
        paths = []
        for leaf in held:
            if any(above(m) == leaf for m in held):
                continue
            path, seen = [leaf], {leaf}
            while (up := above(path[-1])) is not None and up not in seen:
                path.append(up)
                seen.add(up)
            if above(path[-1]) is None:
                paths.append((-sum(held[m][5] or 0.0 for m in path), -len(path), leaf, path[::-1]))
        for n, (*_, path) in enumerate(sorted(paths)[:branches]):
            out[conv, n + 1] = [(held[m][3] or "", held[m][4] or "") for m in path]
    return out


def test_best_branches_like_walking_the_trees(spark):
    rng = random.Random(1)
    rows = []
    for conv in [None, *range(12)]:
        n = rng.choice([1, 2, 9, 40])
        for i in range(n):
            parent = rng.choice([None, "gone", f"m{i:02d}"]) if i == 0 or rng.random() < 0.05 else f"m{rng.randrange(i):02d}"
            text = rng.choice([None, "".join(rng.choices(NASTY, k=rng.randint(0, 6)))])
            rows.append((conv, f"m{i:02d}", parent, rng.choice(["user", "assistant", None, "to%ol\n"]), text, rng.choice([None, 1.0, 2.0, -1.0])))
    rows += [(3, None, "m00", "user", "no id", 9.0), (20, "a", "b", "user", "circle", 1.0), (20, "b", "a", "user", "circle", 1.0), (20, "c", "a", "user", "below", 1.0)]
    for branches in (1, 3):
        want = brute([r for r in rows if r[0] != 20], branches)
        got = {(r.conv, r.branch): r for r in conversations(spark, rows, branches)}
        assert set(got) == set(want)
        for key, turns in want.items():
            r = got[key]
            assert list(zip(r.roles, r.texts, strict=True)) == turns and r.n_turns == len(turns)
            assert r.learned == "".join(t for who, t in turns if who == "assistant")
            assert len(r.mask) == sum(who == "assistant" for who, _ in turns)


def test_long_chain_and_repeated_ids(spark):
    rows = [(1, f"{i:04d}", f"{i - 1:04d}", "assistant" if i % 2 else "user", f"t{i}", 0.0) for i in range(300)]
    rows += [(1, "0007", "0006", "assistant", "other part", 0.0), (1, "0008", "0007", "user", "t8", 0.0)]
    (r,) = conversations(spark, rows)
    want = [f"t{i}" for i in range(300)]
    want[8:9] = ["t8", "t8"]
    want[7:8] = ["other part", "t7"]
    assert r.texts == want


def test_no_control_string_is_left_in_a_text(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices(NASTY, k=8)) for _ in range(400)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(escaped(F.col("t")).alias("e"), unescaped(escaped(F.col("t"))).alias("t")).collect()
    assert [r.t for r in got] == texts
    assert not any(re.search(r"<(/?s>|</?SYS>>|\|\w+\|>)|\[/?INST\]", r.e) for r in got)


def test_turns_read_back(spark):
    rng = random.Random(3)
    rows = []
    for conv in [None, *range(30)]:
        for turn in rng.sample(range(50), rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "".join(rng.choices(NASTY, k=5))]), "x"))
    rows += [(5, None, "user", "turn unknown", "x"), (40, 0, "user", "same", "x"), (40, 0, "user", "same", "x"), (41, 0, "user", "y" * 200_000, "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, tree string")
    got = {r.conv_id: r for r in format_turns(df).withColumns(read_back(F.col("formatted"), F.col("mask"))).collect()}
    assert len(got) == 33
    for conv, r in got.items():
        mine = [x for x in rows if x[0] == conv]
        key = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", hashlib.md5((x[3] or "").encode()).hexdigest())
        turns = [(x[2] or "", x[3] or "") for x in sorted(mine, key=key)]
        assert list(zip(r.roles, r.texts, strict=True)) == turns
        assert r.learned == "".join(t for who, t in turns if who == "assistant")
        assert [r.formatted[m.start : m.stop] for m in r.mask] == [spread for who, t in turns if who == "assistant" for spread in [re.sub(r"(\[)(\\*)(/?INST\])", r"\1\\\2\3", re.sub(r"(<)(\\*)(/?s>|</?SYS>>|\|[A-Za-z0-9_]+\|>)", r"\1\\\2\3", t))]]


def test_no_turns(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    assert format_turns(empty).count() == 0
    assert conversations(spark, []) == []
