"""Mixing and packing against their definitions, and the pipeline stage by stage."""

import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from medialoom.llm.mixing import mix, mixed_documents
from medialoom.llm.packing import fullest, pack, plan

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def made_up(spark, n=300, seed=8):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randrange(1, 6) for _ in range(rng.randrange(1, 90))), "en", rng.choice(["b", "a", "c", "d", None, "a", "a"]), 1) for i in range(n)]
    return rows, [*rows, (900, None, None, "a", None), (901, " \n", None, "e", 0), (None, "x y", "en", "a", 3), (1, *rows[1][1:])]


def water(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * level for s in free}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mix(spark):
    _, rows = made_up(spark)
    df = spark.createDataFrame(rows, DOCS)
    got = mix(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    want = water(sizes)
    source = {r[0]: r[3] for r in rows}
    assert len(got) == len(rows) and sorted((r.size for r in got)) == sorted(size(r[1]) for r in rows)
    taken = {}
    for r in got:
        s = source[r.doc_id]
        taken[s] = taken.get(s, 0) + r.taken
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.taken <= 3 * r.size
    assert all(abs(taken[s] - want[s]) <= 90 for s in want)
    again = mix(df.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    expanded = mixed_documents(df)
    assert expanded.columns == df.columns and expanded.count() == sum(r.copies for r in got)
    assert mix(df.where("false")).count() == 0 and mixed_documents(df.where("false")).count() == 0


def test_fullest_like_all_subsets():
    rng = random.Random(1)
    for _ in range(60):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(0, 60)
        items = [x for x, n in counts.items() for _ in range(n)]
        best = max((sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room), default=0)
        chosen = fullest(counts, room)
        assert sum(chosen) == best and all(chosen.count(x) <= counts[x] for x in chosen)
    assert sum(n for _, n in plan({512: 10, 256: 4, 1024: 3}, 1024)) == 9


def test_pack(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "Straße", "été", "x1", "<|endoftext|>", "日本"]) for _ in range(rng.randrange(0, 700))) for _ in range(60)]
    texts += [None, "", "same", "same", "word " * 30_000]
    rows = [(i if t != "same" else 7000, t, "en", "s", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    got = pack(df, keep_ids=True).collect()
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t, *_ in rows:
        ids = [*bpe.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(r.length for r in got) // 1024) + 1
    assert pack(df.where("false")).count() == 0


def test_pack_like_tokenizers_by_default(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n  y", "<|endoftext |> <|im_start|>", "it's 2,500 été 日本 😀\t  z ", "word <|endoftext|>" * 900]
    got = pack(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS), keep_ids=True).collect()
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in enumerate(texts):
        ids = [x for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start) for x in r.ids]
        assert ids == [*bpe.encode(text, add_special_tokens=False).ids, 2]


def test_language_stage_decides(spark):
    letters = {"en": "thsandowe", "de": "schünßtei", "fr": "çéèauxlou"}
    rng = random.Random(4)
    text = lambda some: " ".join("".join(rng.choice(some) for _ in range(rng.randrange(3, 9))) for _ in range(40))
    rows = [(i, text(letters[lang]), lang, "s", 1) for i in range(200) for lang in [rng.choice(list(letters))]]
    wrong = next(i for i in range(910, 950) if zlib.crc32(str(i).encode()) % 3 == 1)  # not learned from
    odd = [(900, text(letters["de"]), None, "s", 1), (wrong, text(letters["fr"]), "en", "s", 1), (902, text("жщфыйцукен"), None, "s", 1), (903, "12 !", "en", "s", 1), (904, None, "en", "s", 1)]
    stage = dict(corpus_pipeline.STAGES)["language"]
    got = {r.doc_id: r.lang for r in stage(spark, spark.createDataFrame(rows + odd, DOCS), "").collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert len(held) > 30 and all(got[r[0]] == r[2] for r in held)
    want = {900: "de", wrong: "fr", 902: None, 903: None, 904: None}
    assert {r[0]: got.get(r[0]) for r in odd} == {r[0]: want[r[0]] for r in odd}
    unlabelled = spark.createDataFrame([(*r[:2], None, *r[3:]) for r in rows + odd], DOCS)
    kept = stage(spark, unlabelled, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(r[0] for r in rows + odd if r[0] not in (903, 904)) and {r.lang for r in kept} == {None}


def test_pipeline_stages(spark):
    rng = random.Random(9)
    prose = lambda n: "\n".join(" ".join("".join(rng.choice("thsandowei") for _ in range(rng.randrange(2, 8))) for _ in range(12)) for _ in range(n))
    rows = [(i, prose(rng.randrange(2, 9)), "en", f"s{i % 4}", 1) for i in range(60)]
    near = rows[5][1].replace("\n", " ").split()
    rows += [(70, rows[3][1], "en", "s1", 1), (71, " ".join(near), "en", "s2", 1), (72, "123", "en", "s1", 3), (73, None, "en", "s1", None), (74, " ".join(near + ["more"]), "en", "s2", 1)]
    df = spark.createDataFrame(rows, DOCS)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "near_duplicates", "mix", "packing"]
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    kept = stages["language"](spark, df, "").cache()
    assert ids(kept) == [*range(60), 70, 71, 74] and kept.columns == df.columns
    lines = stages["lines"](spark, kept, "").cache()
    assert ids(lines) == [*range(60), 71, 74] and lines.columns == df.columns
    one = stages["near_duplicates"](spark, lines, "").cache()
    assert ids(one) == [*range(60)] and one.columns == df.columns
    taken = stages["mix"](spark, one, "").cache()
    want = {r.doc_id: r.copies for r in mix(one).collect()}
    assert ids(taken) == sorted(i for i, n in want.items() for _ in range(n)) and taken.columns == df.columns
    assert stages["packing"](spark, taken, "").where("piece = 0").count() == taken.count()
    empty = df.where("false")
    assert all(stage(spark, empty, "").count() == 0 for stage in stages.values())
