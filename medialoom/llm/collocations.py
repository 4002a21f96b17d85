"""Phrase collocations from count automata that are built per shard, united by prefix range and composed for lookups."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialoom.llm.automata import CountAutomaton, Words, union
from medialoom.llm.common import FINISH, MIX
from medialoom.session import materialize

# What parts pieces and words, and the lower-casing of A to Z. Other characters belong to words.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
PLAIN = bytes.maketrans(bytes(range(65, 91)) + BREAKS + b"\t", bytes(range(97, 123)) + b"\n" * len(BREAKS) + b" ")
PIECE_END = re.compile(b"[" + BREAKS + b"]")
EMPTY, BREAK = 0, 1
UNKNOWN = "und"

BYTES_AT_ONCE = 4 << 20
IDS_HELD, WINDOWS_HELD = 400_000, 1_000_000
# Slots for counting: enough for rare words to stay far below the least count together, but at most 2^26, so that the
# bitmaps sent to the executors have 24 MB at most. Words, pairs and triples have a bitmap each.
LEAST_BITS, MOST_BITS, CHUNK, LEVELS = 16, 26, 1 << 16, 3
WORDS_IN_RANGE = 1 << 20


class WordIds(dict):
    """Numbers of words in order of first sight, with the hash of each."""

    def __init__(self) -> None:
        super().__init__({b"": EMPTY, b"\n": BREAK})
        self.words: list[bytes] = [b"", b"\n"]
        self.hashes = np.zeros(1 << 16, np.uint64)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self.words)
        self.words.append(word)
        if at == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[at] = xxhash.xxh64_intdigest(word)
        return at

    def read(self, texts: list[bytes]) -> np.ndarray:
        """Numbers of all words of the texts in order, with a break between pieces."""
        tokens = b"\n".join(texts).translate(PLAIN).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return ids[ids != EMPTY]


def word_hash(word: bytes) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(word)], np.uint64)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a ^ (b * FINISH)) * MIX
    out ^= out >> np.uint64(29)
    return out * FINISH


def slots(hashes: list[np.ndarray], lang: np.ndarray, bits: int) -> np.ndarray:
    """Slots of word sequences, from the hashes of their first words, of their second words, and so on."""
    return mixed(reduce(mixed, hashes), lang) >> np.uint64(64 - bits)


def range_of(first: np.ndarray, second: np.ndarray | None, bits: int) -> np.ndarray:
    """The prefix range of strings, over the hash of their first two words: even, and the same in every shard."""
    both = mixed(first, np.zeros_like(first) if second is None else second)
    return (both >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(first), np.int64)


def cut_long(text: bytes) -> Iterator[bytes]:
    """A text in parts of whole pieces, of about ``BYTES_AT_ONCE`` or one longer piece."""
    at = 0
    while len(text) - at > BYTES_AT_ONCE and (end := PIECE_END.search(text, at + BYTES_AT_ONCE)):
        yield text[at : end.end()]
        at = end.end()
    yield text[at:]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, of about ``BYTES_AT_ONCE`` together."""
    for batch in batches:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for part in cut_long(text):
                held.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part)
                if sizes[lang] >= BYTES_AT_ONCE:
                    yield lang, held.pop(lang)
                    sizes[lang] = 0
        yield from held.items()


def both(ok: np.ndarray) -> np.ndarray:
    """From where sequences of a length may start to where those one word longer may."""
    return np.append(ok[:-1] & ok[1:], False)


def frequent_slots(rows: DataFrame, least: int, bits: int) -> np.ndarray:
    """Bitmaps over slots of the hashes of words, pairs and triples: whether all that a slot holds counts ``least``."""
    dtype = np.uint8 if least < 256 else np.uint32
    top = min(least, np.iinfo(dtype).max)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((LEVELS, 1 << bits), dtype)
        ids = WordIds()
        for lang, texts in slices(batches):
            code = word_hash(lang.encode())
            read = ids.read(texts)
            hashes, ok = ids.hashes[read], read != BREAK
            for level in range(LEVELS):
                places = np.nonzero(ok)[0]
                slot, n = np.unique(slots([hashes[places + j] for j in range(level + 1)], code, bits).astype(np.uint32), return_counts=True)
                counts[level][slot] = np.minimum(counts[level][slot] + n, top)
                ok = both(ok)
            if len(ids) > IDS_HELD:
                ids = WordIds()
        for level, row in enumerate(counts):
            for chunk in np.nonzero(row.reshape(-1, CHUNK).any(1))[0]:
                part = zstandard.compress(row[chunk * CHUNK : (chunk + 1) * CHUNK].tobytes())
                yield pa.RecordBatch.from_pydict({"level": [level], "chunk": [int(chunk)], "counts": [part]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(CHUNK, np.int64)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"level": [at[0]], "chunk": [at[1]], "bits": [np.packbits(total >= least).tobytes()]})

        for batch in batches:
            for level, chunk, part in zip(*(batch.column(i) for i in range(3)), strict=True):
                if at != (level.as_py(), chunk.as_py()):
                    if at:
                        yield row()
                    at, total = (level.as_py(), chunk.as_py()), np.zeros(CHUNK, np.int64)
                total = np.minimum(total + np.frombuffer(zstandard.decompress(part.as_py()), dtype), least)
        if at:
            yield row()

    sums = rows.mapInArrow(count, "level bigint, chunk bigint, counts binary").repartition("level", "chunk").sortWithinPartitions("level", "chunk")
    out = np.zeros((LEVELS, (1 << bits) // 8), np.uint8)
    for r in sums.mapInArrow(add, "level bigint, chunk bigint, bits binary").collect():  # of a bounded size, at most 24 MB
        out[r["level"], r["chunk"] * CHUNK // 8 : (r["chunk"] + 1) * CHUNK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


class Shard:
    """Counts of the words and windows of one shard, given out as automata by language and prefix range."""

    def __init__(self, bitmaps: np.ndarray, bits: int, range_bits: int, width: int) -> None:
        self.bitmaps, self.bits, self.range_bits, self.width = bitmaps, bits, range_bits, width
        self.total: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.ids = WordIds()
        self.words: dict[str, np.ndarray] = {}
        self.windows: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held = 0

    def hit(self, hashes: list[np.ndarray], lang: np.ndarray) -> np.ndarray:
        at = slots(hashes, lang, self.bits)
        return (self.bitmaps[len(hashes) - 1][at >> np.uint64(3)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1

    def add(self, lang: str, texts: list[bytes]) -> None:
        code, read = word_hash(lang.encode()), self.ids.read(texts)
        hashes = self.ids.hashes
        seen = np.bincount(read, minlength=len(self.ids))
        seen[BREAK] = 0
        self.total[lang] = self.total.get(lang, 0) + int(seen.sum())
        before = self.words.get(lang, np.zeros(0, np.int64))
        seen[: len(before)] += before
        self.words[lang] = seen
        known = np.zeros(len(self.ids), bool)
        own = np.nonzero(seen)[0]
        known[own] = self.hit([hashes[own]], code)
        ok, window = known[read], None
        for length in range(2, self.width + 1):
            ok = both(ok)
            places = np.nonzero(ok)[0]
            if length <= LEVELS:
                fine = self.hit([hashes[read[places + j]] for j in range(length)], code)
                ok[places[~fine]] = False
                places = places[fine]
            if window is None:
                window, row = np.full((len(places), self.width), EMPTY, np.int64), np.zeros(len(read), np.int64)
                row[places] = np.arange(len(places))
                window[:, 0] = read[places]
            window[row[places], length - 1] = read[places + length - 1]
        if len(window):
            self.windows.setdefault(lang, []).append((window, np.ones(len(window), np.int64)))
            self.held += len(window)

    def shrink(self) -> None:
        """Equal windows become one with a count."""
        for lang, parts in self.windows.items():
            window, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            key = np.zeros(len(window), np.int64)
            for j in range(self.width):  # numbers of equal prefixes, one word longer each time
                key = np.unique(key << 32 | window[:, j], return_inverse=True)[1]
            _, first = np.unique(key, return_index=True)
            self.windows[lang] = [(window[first], np.bincount(key, n).astype(np.int64))]
        self.held = sum(len(parts[0][0]) for parts in self.windows.values())

    def full(self) -> bool:
        """To be asked after every ``add``: words, or windows that differ, are as many as may be held."""
        if self.held > WINDOWS_HELD // 2:
            self.shrink()
        return len(self.ids) > IDS_HELD or self.held > WINDOWS_HELD // 2

    def given_out(self) -> Iterator[tuple[str, int, bytes]]:
        """``(lang, range, automaton)``: one-word strings with their counts, and windows of two words or more."""
        self.shrink()
        hashes = self.ids.hashes
        for lang, seen in self.words.items():
            own = np.nonzero(seen)[0]
            own = own[self.hit([hashes[own]], word_hash(lang.encode()))]
            one = np.full((len(own), self.width), EMPTY, np.int64)
            one[:, 0] = own
            window, n = self.windows[lang][0] if lang in self.windows else (one[:0], seen[:0])
            place = np.concatenate([range_of(hashes[own], None, self.range_bits), range_of(hashes[window[:, 0]], hashes[window[:, 1]], self.range_bits)])
            window, n = np.concatenate([one, window]), np.concatenate([seen[own], n])
            used = np.unique(window)
            order = np.zeros(len(self.ids), np.int64)
            order[sorted(used.tolist(), key=self.ids.words.__getitem__)] = np.arange(len(used))  # the empty word comes first
            rows = np.lexsort([*order[window].T[::-1], place])
            words = self.ids.words
            edges = np.nonzero(np.diff(place[rows], prepend=-1))[0].tolist() + [len(rows)]
            for a, b in zip(edges, edges[1:], strict=False):
                part = rows[a:b]
                strings = ((tuple(words[i] for i in w if i), c) for w, c in zip(window[part].tolist(), n[part].tolist(), strict=True))
                yield lang, int(place[part[0]]), CountAutomaton.build(strings).to_bytes()


def phrase_range(words: Words, range_bits: int) -> int:
    return int(range_of(word_hash(words[0]), word_hash(words[1]) if len(words) > 1 else None, range_bits)[0])


def written(words: Words) -> str:
    return b" ".join(words).decode("utf-8", "replace")


def count_automata(rows: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame, int]:
    """The united automata ``(lang, range, automaton)``, the words ``(lang, n)`` of every language, and the ranges' bits."""
    size = rows.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    words = size // 6 + 1
    bits = min(MOST_BITS, max(LEAST_BITS, (2 * words // least).bit_length()))
    range_bits = max(4, (words // WORDS_IN_RANGE).bit_length())
    bitmaps = rows.sparkSession.sparkContext.broadcast(frequent_slots(rows, least, bits))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(bitmaps.value, bits, range_bits, longest)

        def out() -> Iterator[pa.RecordBatch]:
            found = list(shard.given_out())
            for i in range(0, len(found), 512):
                lang, place, data = zip(*found[i : i + 512], strict=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "range": pa.array(place, pa.int64()), "automaton": pa.array(data, pa.binary()), "n": pa.array([0] * len(lang), pa.int64())})
            shard.clear()

        for lang, texts in slices(batches):
            shard.add(lang, texts)
            if shard.full():
                yield from out()
        yield from out()
        for lang, n in shard.total.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "range": pa.array([None], pa.int64()), "automaton": pa.array([None], pa.binary()), "n": [n]})

    def unite(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        both = union([CountAutomaton.from_bytes(x) for x in rows["automaton"]])
        return pd.DataFrame({"lang": [key[0]], "range": [key[1]], "automaton": [both.to_bytes()]}, dtype=object)

    found = materialize(rows.mapInArrow(shards, "lang string, range bigint, automaton binary, n bigint"), "shards")
    counted = found.groupBy("lang").agg(F.sum("n").alias("n"))
    united = found.where("range IS NOT NULL").groupBy("lang", "range").applyInPandas(unite, "lang string, range bigint, automaton binary")
    return materialize(united, "automata"), counted, range_bits


def cut_phrases(automata: DataFrame, least: int, range_bits: int) -> DataFrame:
    """Every candidate with every cut: ``(lang, phrase, a, cut, head, head_range, tail, tail_range)``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, data in zip(batch["lang"], batch["automaton"], strict=True):
                out = []
                for words, a in CountAutomaton.from_bytes(data).prefixes(least):
                    if len(words) > 1:
                        phrase = written(words)
                        for k in range(1, len(words)):
                            head, tail = words[:k], words[k:]
                            out.append((lang, phrase, a, k, written(head), phrase_range(head, range_bits), written(tail), phrase_range(tail, range_bits)))
                yield pd.DataFrame(out, columns=["lang", "phrase", "a", "cut", "head", "head_range", "tail", "tail_range"], dtype=object)

    schema = "lang string, phrase string, a bigint, cut int, head string, head_range bigint, tail string, tail_range bigint"
    return automata.select("lang", "automaton").mapInPandas(cut, schema)


def part_counts(parts: DataFrame, automata: DataFrame) -> DataFrame:
    """``(lang, part, n)``: the parts ``(lang, range, part)`` of every range, as an automaton, composed with the range's counts."""

    def look_up(key: tuple, asked: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or counts.empty:
            return pd.DataFrame({"lang": [], "part": [], "n": []}, dtype=object)
        wanted = CountAutomaton.build((w, 1) for w in sorted(tuple(p.encode().split(b" ")) for p in asked["part"]))
        found = [(written(w), n) for w, n in CountAutomaton.from_bytes(counts["automaton"].iloc[0]).compose(wanted)]
        return pd.DataFrame([(key[0], p, n) for p, n in found], columns=["lang", "part", "n"], dtype=object)

    return parts.groupBy("lang", "range").cogroup(automata.groupBy("lang", "range")).applyInPandas(look_up, "lang string, part string, n bigint")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, percent: int = 100, top: int = 2000
) -> DataFrame:
    """The best phrases of every language: ``(lang, rank, phrase, a, l, r, n, score)``.

    Texts are lower-cased (A to Z), cut into pieces at ``. , ; : ! ?`` and line ends, and pieces into words at spaces and tabs.
    ``n`` counts a language's words, a phrase counts all its occurrences within pieces. Phrases of 2 to ``longest`` words
    that occur ``least`` times are candidates. The lowest of floor(1000 * a * n / (l * r)) over the cuts of a phrase into a
    part that occurs l times and one that occurs r times is its score (ties: the earliest cut). A candidate goes if a longer
    candidate that holds it occurs ``percent`` percent as often. Of the others each language's ``top`` are returned, by
    score, then a, then phrase.

    At every place the window of up to ``longest`` words counts, and a phrase's count is the sum over the windows that
    start with it. A shard sorts its windows and builds count automata from them, cut by prefix range; the automata of a
    range are united, and the parts of candidates are composed with them. Windows end where a word, a pair or a
    triple can't occur ``least`` times, which tables of hashed counts over all texts tell. Their size is bounded, and they
    decide only how much is shuffled. Ranges grow in number with the texts, so none grows in size.

    A null text is empty, a null language is ``und``; very long texts are read whole, in parts of whole pieces. Repeated rows count
    each. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    automata, counted, range_bits = count_automata(rows, least, longest)
    cuts = materialize(cut_phrases(automata, least, range_bits), "cuts")
    heads = cuts.select("lang", F.col("head_range").alias("range"), F.col("head").alias("part"))
    tails = cuts.select("lang", F.col("tail_range").alias("range"), F.col("tail").alias("part"))
    counts = materialize(part_counts(heads.unionByName(tails).distinct(), automata), "parts")
    of = lambda side, name: counts.select("lang", F.col("part").alias(side), F.col("n").alias(name))
    scored = cuts.join(of("head", "l"), ["lang", "head"]).join(of("tail", "r"), ["lang", "tail"]).join(counted, "lang")
    wide = lambda c: f"cast({c} as decimal(17,0))"
    score = F.expr(f"(1000 * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    best = scored.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    best = best.select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    words = F.split("phrase", " ")
    shorter = F.flatten(
        F.transform(F.sequence(F.lit(2), F.size(words) - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " ")))
    )
    longer = cuts.where("cut = 1").where(F.size(words) > 2).select("lang", F.col("a").alias("held"), F.explode(F.array_distinct(shorter)).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    left = best.join(longer, ["lang", "phrase"], "left").where(F.col("held").isNull() | (100 * F.col("held") < percent * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
