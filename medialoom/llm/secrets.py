"""Secret scans with built-in functions only: fixed patterns, and sliding-window entropy of candidate strings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds in order with their patterns, the least length, and the group it is asked of.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy_base64", "entropy_hex", "entropy_lower", "entropy_upper", "entropy_short", "entropy_letters")
LEAST_ASSIGNED = 12

# Character classes: candidate pattern, alphabet, window, least entropy in bits, and what a candidate must have.
CLASSES = {
    "entropy_base64": (
        r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_=",
        24,
        3.9,
        r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])",
    ),
    "entropy_hex": (r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])", "0123456789ABCDEF", 32, 3.0, r"^(?=.*[0-9])(?=.*[A-Fa-f])"),
    "entropy_lower": (r"(?<![A-Za-z0-9])[a-z0-9]{24,}(?![A-Za-z0-9])", "abcdefghijklmnopqrstuvwxyz0123456789", 24, 3.7, r"^(?=.*[0-9])(?=.*[a-z])"),
    "entropy_upper": (r"(?<![A-Za-z0-9])[A-Z0-9]{24,}(?![A-Za-z0-9])", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 24, 3.7, r"^(?=.*[0-9])(?=.*[A-Z])"),
    "entropy_short": (
        r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9]{20,23}(?![A-Za-z0-9+/_-])",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
        20,
        3.7,
        r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])",
    ),
    # letters alone: names of several words have few short lower-case runs after two capitals
    "entropy_letters": (
        r"(?<![A-Za-z0-9+/_-])[A-Za-z]{24,}(?![A-Za-z0-9+/_-])",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
        24,
        3.9,
        r"[A-Z]{2}[a-z]{1,2}[A-Z].*?[A-Z]{2}[a-z]{1,2}[A-Z]",
    ),
}
# Hot stretches that are no secrets: those with a place holder in them, and paths of words. A place holder that is a part
# between other characters than letters and digits by itself only parts the stretches.
WORDS = "example|sample|dummy|placeholder|changeme|redacted"
HOLDERS = WORDS + "|x{6,}|0{8,}|1234567|abcdefg"
ALLOWED = rf"(?i){WORDS}|^(?:[a-z]+[/_+-])+[a-z]+$"
# Keyboard sequences hold against a stretch only if too little for a window is left without them.
SEQUENCES = "(?i)x{6,}|0{8,}|0?1234567(?:89?0?)?|abcdefg[h-z]*"
PARTING = rf"(?i)(?:(?<![a-z0-9])(?=(?:{HOLDERS})(?![a-z0-9]))|(?!^)\G)[a-z0-9]"

SPAN = "array<struct<start:int,kind:int,stop:int>>"


def located(text: Column, pattern: str, found: Column, kind: int, keep: Column | None = None) -> Column:
    """Spans of the matches ``found`` of ``pattern``: the pieces between them give their places in code points."""
    pieces = F.split(text, pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        stop = start + F.length(x["match"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.when(x["keep"], span).otherwise(F.array().cast(SPAN))).alias("out"))

    rows = F.arrays_zip(
        F.slice(pieces, 1, F.size(found)).alias("before"),
        found.alias("match"),
        (keep if keep is not None else F.transform(found, lambda _: F.lit(True))).alias("keep"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(rows, start, step)["out"]).otherwise(F.array().cast(SPAN))


def hot_windows(candidate: Column, alphabet: str, width: int, least: float) -> Column:
    """``array(struct(lo, hi))``: the maximal stretches of ``candidate`` covered by windows of at least ``least`` bits.

    Windows with a character outside the alphabet do not count.
    Counts per character and the sum of c log2 c change by one entering and one leaving character at a time.
    """
    f = lambda c: F.when(c > 1, c * F.log2(F.greatest(c, F.lit(1)))).otherwise(0.0)

    def add(state: Column, code: Column, by: int) -> tuple[Column, Column]:
        was = F.coalesce(F.get(state["counts"], code), F.lit(0))
        counts = F.transform(state["counts"], lambda c, k: F.when(k == code, c + by).otherwise(c))
        return counts, state["sum"] + f(was + by) - f(was)

    def step(codes: Column, state: Column, at: Column) -> Column:
        counts, total = add(state, F.get(codes, at), 1)
        grown = F.struct(counts.alias("counts"), total.alias("sum"))
        counts, total = add(grown, F.get(codes, at - width), -1)
        moved = F.when(at >= width, F.struct(counts.alias("counts"), total.alias("sum"))).otherwise(grown)
        other = F.when(F.get(codes, at) < 0, at).otherwise(state["other"])
        return once(moved, lambda m: once(other, lambda o: stretched(state, at, m, o)))

    def stretched(state: Column, at: Column, moved: Column, other: Column) -> Column:
        hot = (at - other >= width) & (F.lit(math.log2(width)) - moved["sum"] / width >= least)
        apart = hot & (state["hi"] >= 0) & (state["hi"] < at - width + 1)
        past = F.array(F.struct(state["lo"].alias("lo"), state["hi"].alias("hi")))
        return F.struct(
            moved["counts"].alias("counts"),
            moved["sum"].alias("sum"),
            F.when(apart | hot & (state["lo"] < 0), at - width + 1).otherwise(state["lo"]).alias("lo"),
            F.when(hot, at + 1).otherwise(state["hi"]).alias("hi"),
            other.alias("other"),
            F.when(apart, F.concat(state["past"], past)).otherwise(state["past"]).alias("past"),
        )

    once = lambda value, use: F.get(F.transform(F.array(value), use), 0)  # noqa: E731  evaluated one time, used often

    start = F.struct(
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(-1).alias("lo"),
        F.lit(-1).alias("hi"),
        F.lit(-1).alias("other"),
        F.array().cast("array<struct<lo:int,hi:int>>").alias("past"),
    )
    places = F.sequence(F.lit(0), F.length(candidate) - 1)
    every = lambda s: F.concat(s["past"], F.array(F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"))))
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    # the codes are no part of the state, which is copied at each step
    return F.filter(once(codes, lambda c: F.aggregate(places, start, lambda s, at: step(c, s, at), every)), lambda w: w["lo"] >= 0)


def entropy_spans(text: Column, found: Column, name: str) -> Column:
    pattern, alphabet, width, least, has = CLASSES[name]
    kind = KINDS.index(name)

    def secret(stretch: Column) -> Column:
        return ~stretch.rlike(ALLOWED) & (F.length(F.regexp_replace(stretch, SEQUENCES, "")) >= width)

    def narrowed(span: Column) -> Column:
        candidate = F.substring(text, span["start"] + 1, span["stop"] - span["start"])
        plain = F.upper(candidate) if name == "entropy_hex" else candidate
        windows = F.when(candidate.rlike(has), hot_windows(F.regexp_replace(plain, PARTING, " "), alphabet, width, least))
        return F.transform(
            F.filter(F.coalesce(windows, F.array().cast("array<struct<lo:int,hi:int>>")), lambda w: secret(F.substring(candidate, w["lo"] + 1, w["hi"] - w["lo"]))),
            lambda w: F.struct((span["start"] + w["lo"]).alias("start"), F.lit(kind).alias("kind"), (span["start"] + w["hi"]).alias("stop")),
        )

    return F.flatten(F.transform(located(text, pattern, found, kind), narrowed))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))))


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` of every row, over the whole text.

    Base spans are the matches of the three fixed patterns. The method adds, per character class, every stretch of
    a candidate string whose sliding windows reach the class's entropy, unless it is on the allow-list or lies within one
    base span; what reaches beyond a base span is given whole, so spans may overlap. A span is kind:start:end in code points, end exclusive, in order of start, then kind.

    A null text is empty: no spans. Null ids and repeated rows are scanned like others. Other columns are ignored; an
    empty table gives an empty result.
    """
    t = F.col("text")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    every = lambda p, g=0: F.regexp_extract_all(t, F.lit(p), F.lit(g))
    rows = rows.withColumns(
        {"m0": every(ASSIGN), "m1": every(ACCESS), "m2": every(HEX)} | {f"c{i}": every(c[0]) for i, c in enumerate(CLASSES.values())}
    )
    values = F.when(F.size("m0") > 0, every(ASSIGN, 2)).otherwise(F.array().cast("array<string>"))
    long_enough = F.transform(values, lambda v: F.length(v) >= LEAST_ASSIGNED)
    base = F.concat(located(t, ASSIGN, F.col("m0"), 0, long_enough), located(t, ACCESS, F.col("m1"), 1), located(t, HEX, F.col("m2"), 2))
    more = F.concat(*[entropy_spans(t, F.col(f"c{i}"), name) for i, name in enumerate(CLASSES)])
    rows = rows.withColumns({"base": base, "more": more})
    beyond = lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["stop"] <= b["stop"]))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return rows.select(
        F.col("doc_id").alias(doc_id),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.concat("base", F.filter("more", beyond))).alias("spans"),
    )
