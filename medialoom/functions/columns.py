"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

# The characters treated as whitespace (as a class and as a list), and the token pattern.
SPACE = r"[\p{IsWhite_Space}\x{1C}-\x{1F}]"
UNEVEN = rf"[{SPACE}&&[^ ]]|  "
SPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
TOKEN = r"[A-Za-z0-9가-힣]{2,}"


def strip(c: Column) -> Column:
    """Drop whitespace of any kind from both ends (``trim`` only drops spaces)."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def squeeze(c: Column) -> Column:
    """Collapse whitespace runs to one space and strip. Text whose only whitespace is single spaces is not rebuilt."""
    return strip(F.when(c.rlike(UNEVEN), F.regexp_replace(c, f"{SPACE}+", " ")).otherwise(c))


def blank_to_null(c: Column) -> Column:
    stripped = strip(c)
    return F.when(stripped != "", stripped)


def first_text(*cs: Column) -> Column:
    """First non-blank of several string columns, stripped."""
    return F.coalesce(*[blank_to_null(c) for c in cs])


def clamp01(c: Column) -> Column:
    """Value limited to [0, 1]; null stays null (``least`` alone would turn it into 1)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def round4(c: Column) -> Column:
    """Round half up to four digits with plain arithmetic, so any engine gives the same double."""
    return F.floor(c * 10000.0 + 0.5) / 10000.0


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double, 0 when the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def among(c: Column, words: Sequence[str]) -> Column:
    return c.isin(*sorted(words)) if words else F.lit(False)


def literal_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def let(value: Column | str, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_seen(arr: Column, limit: int | None = None) -> Column:
    """Case-insensitive dedupe of a string array; keeps the first spelling and the order."""

    def pick(pair: Column) -> Column:
        keys = F.array_distinct(pair["lowered"])
        if limit is not None:
            keys = F.slice(keys, 1, limit)
        at = lambda key: F.array_position(pair["lowered"], key).cast("int") - 1
        return F.transform(keys, lambda key: F.get(pair["arr"], at(key)))

    with_keys = let(arr, lambda a: F.struct(a.alias("arr"), F.transform(a, F.lower).alias("lowered")))
    return let(with_keys, pick)


def literal_count(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a literal string."""
    stripped = F.replace(text, needle, F.lit(""))
    return F.coalesce(
        F.try_divide(F.length(text) - F.length(stripped), F.length(needle)).cast("bigint"),
        F.lit(0).cast("bigint"),
    )


def surrogate_id(c: Column) -> Column:
    """First 15 hex digits of SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 15), 16, 10).cast("bigint")


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row holds: eight for a number or time, else the length of the text or of its JSON."""
    sizes = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (StringType, BinaryType)):
            sizes.append(F.octet_length(c))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            sizes.append(F.octet_length(F.to_json(F.struct(c))))
        else:
            sizes.append(F.lit(8))
    return F.lit(8).cast("bigint") + sum((F.coalesce(x, F.lit(0)) for x in sizes), F.lit(0))


def bounded_broadcast(small: DataFrame, max_rows: int = 100_000, max_bytes: int = 128 << 20) -> DataFrame:
    """Broadcast ``small`` only after one count shows at most ``max_rows`` rows of at most ``max_bytes`` in all.

    Beyond a bound the plain frame is returned and the join runs as a shuffle join, where adaptive
    execution splits skewed keys.
    """
    seen = small.select(row_bytes(small).alias("bytes")).limit(max_rows + 1)
    found = seen.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    if found["rows"] <= max_rows and found["bytes"] <= max_bytes:
        return F.broadcast(small)
    return small
