"""Incremental ingest as batch steps: selection, outcomes, job counters, graph rows and upserts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialoom.functions.columns import bounded_broadcast, first_seen, first_text, strip, surrogate_id
from medialoom.functions.ranking import first_per_key, top_n
from medialoom.operators.text import keyword_slug
from medialoom.session import materialize

# Contract bounds, candidates that one task ranks, and job states.
MAX_CANDIDATES = 120
PART_ROWS = 200_000
SUMMARY_CHARS = 500
QUEUED, RUNNING, COMPLETED, WITH_ERRORS = "QUEUED", "RUNNING", "COMPLETED", "COMPLETED_WITH_ERRORS"


def normalize_candidates(df: DataFrame) -> DataFrame:
    """Candidates with trimmed fields, upper country and lower language, and why a row is invalid."""
    out = df.withColumns(
        {
            "video_id": strip(F.col("video_id")),
            "title": strip(F.col("title")),
            "country_code": F.upper(strip(F.col("country_code"))),
            "language": F.lower(strip(F.col("language"))),
            "view_count": F.coalesce("view_count", F.lit(0.0)),
        }
    )
    reason = (
        F.when(F.coalesce("video_id", F.lit("")) == "", "video_id")
        .when(F.coalesce("title", F.lit("")) == "", "title")
        .when(~F.coalesce(F.length("country_code").between(2, 8), F.lit(False)), "country_code")
        .when(~F.coalesce(F.length("language").between(2, 16), F.lit(False)), "language")
        .when(F.col("view_count") < 0, "view_count")
    )
    return out.withColumn("reject_reason", reason)


def by_request(df: DataFrame, most: int | None = MAX_CANDIDATES) -> DataFrame:
    """Requests with at most ``most`` candidates; larger ones break the contract as a whole. None: requests of any size.

    Rows are written once, because they are counted, and shuffled once: a part holds ``PART_ROWS`` rows on average and
    whole requests. Too large requests go before that shuffle, or behind it where there are too many to broadcast.
    """
    rows = materialize(df.filter(F.col("request_id").isNotNull()), "candidates")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, -(-rows.count() // PART_ROWS))
    if most is None:
        return rows.repartition(parts, "request_id")
    sizes = rows.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") > most).select("request_id")
    return rows.join(bounded_broadcast(large), "request_id", "left_anti").repartition(parts, "request_id")


def select_candidates(df: DataFrame, max_per_country: int, most: int | None = MAX_CANDIDATES) -> DataFrame:
    """First row per video id and at most ``max_per_country`` per country, in arrival order ``seq``.

    A video over its country's quota is not used up and may return under another country. Only requests
    where one id names two countries need that; they are walked as groups. All others are two pruned rankings. None of it
    shuffles the parts of ``by_request`` again, where ``most`` is explained.

    A group holds what can be chosen, however large its request is: of a video's rows that name one country the first, and of
    those a country's first ``max_per_country`` times the number of countries. All quotas together take no more videos than that,
    so a country that passed so many has filled its own.
    """
    rows = by_request(df, most)
    per_id = Window.partitionBy("request_id", "video_id")
    several = rows.withColumn("_several", (F.min("country_code").over(per_id) != F.max("country_code").over(per_id)))
    per_request = Window.partitionBy("request_id")
    marked = several.withColumn("_mixed", F.max("_several").over(per_request)).drop("_several")
    plain = top_n(marked.filter(~F.col("_mixed")), ["request_id", "video_id"], [F.col("seq")], 1).drop("rank")
    quick = top_n(plain, ["request_id", "country_code"], [F.col("seq")], max_per_country).drop("rank", "_mixed")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        used: dict[str, int] = {}
        seen: set[str] = set()
        keep = []
        for video, country in zip(pdf["video_id"], pdf["country_code"]):
            good = video not in seen and used.get(country, 0) < max_per_country
            keep.append(good)
            if good:
                seen.add(video)
                used[country] = used.get(country, 0) + 1
        return pdf[keep]

    once = top_n(marked.filter("_mixed"), ["request_id", "video_id", "country_code"], [F.col("seq")], 1).drop("rank")
    place = F.row_number().over(Window.partitionBy("request_id", "country_code").orderBy("seq"))
    countries = F.size(F.collect_set("country_code").over(per_request)) + 1  # null is not collected
    ahead = once.withColumns({"_place": place, "_countries": countries}).filter(F.col("_place") <= F.col("_countries") * max_per_country)
    slow = ahead.select(*df.columns).groupBy("request_id").applyInPandas(walk, df.schema)
    return quick.select(*df.columns).unionByName(slow)


def mark_existing(selected: DataFrame, existing: DataFrame) -> DataFrame:
    """``skipped`` for videos that already have a successful analysis. ``existing(video_id)``."""
    known = existing.select("video_id").distinct().withColumn("_known", F.lit(True))
    return selected.join(known, "video_id", "left").withColumn("skipped", F.col("_known").isNotNull()).drop("_known")


def clicked_first(df: DataFrame, selected: DataFrame, max_per_country: int) -> DataFrame:
    """The clicked video ahead of the selection from its related candidates, itself left out.

    ``selected`` holds one row per request with the columns of ``df``.
    """
    own = selected.select("request_id", F.col("video_id").alias("_own"))
    related = df.join(own, "request_id").filter(F.col("video_id") != F.col("_own")).drop("_own")
    chosen = select_candidates(related.select(*df.columns), max_per_country)
    return selected.withColumn("priority", F.lit(0)).unionByName(chosen.withColumn("priority", F.lit(1)))


def outcomes(candidates: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Outcome per queued candidate: skipped, failed (no or blank transcript) or success.

    ``candidates(…, video_id, skipped)``, ``transcripts(video_id, transcript)``.
    """
    told = transcripts.withColumn("_blank", F.coalesce(strip(F.col("transcript")), F.lit("")) == "")
    joined = candidates.join(told, "video_id", "left")
    blank = F.coalesce("_blank", F.lit(True))
    return joined.withColumn(
        "outcome", F.when(F.col("skipped"), "skipped").when(blank, "failed").otherwise("success")
    ).drop("_blank")


def job_counts(rows: DataFrame) -> DataFrame:
    """Counters per request. ``rows(request_id, outcome)``."""
    return rows.groupBy("request_id").agg(
        F.count_if(F.col("outcome") == "queued").alias("queued_count"),
        F.count_if(F.col("outcome") == "success").alias("success_count"),
        F.count_if(F.col("outcome") == "failed").alias("failed_count"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped_count"),
    )


def job_status() -> Column:
    """State of a job from its counters: open work first, then whether anything failed."""
    done = F.col("success_count") + F.col("failed_count")
    return (
        F.when((F.col("queued_count") > 0) & (done == 0), QUEUED)
        .when(F.col("queued_count") > 0, RUNNING)
        .when(F.col("failed_count") > 0, WITH_ERRORS)
        .otherwise(COMPLETED)
    )


def merge_keywords(keywords: Column, focus: Column) -> Column:
    """Keywords then focus keywords, blanks and case-insensitive repeats dropped."""
    return first_seen(F.filter(F.transform(F.concat(keywords, focus), strip), lambda k: k != ""))


def graph_rows(candidates: DataFrame, keyword: Column, keep: list[str] | None = None) -> DataFrame:
    """Node and edge properties of an analysed candidate with their defaults.

    Needs ``transcript``, ``keywords`` and ``focus_keywords`` next to the candidate columns; ``keep`` names
    columns to carry along.
    """
    target = surrogate_id(F.col("video_id"))
    return candidates.select(
        *(keep or []),
        "video_id",
        target.alias("target_id"),
        "title",
        F.coalesce(first_text(F.col("description")), F.left("transcript", F.lit(SUMMARY_CHARS))).alias("description"),
        "country_code",
        "language",
        F.coalesce("view_count", F.lit(0.0)).alias("view_count"),
        F.coalesce(first_text(F.col("channel_id")), F.concat(F.lit("runtime:"), "video_id")).alias("channel_id"),
        F.coalesce(first_text(F.col("channel_name")), F.lit("UNKNOWN_CHANNEL")).alias("channel_name"),
        keyword_slug(keyword).alias("issue_id"),
        F.concat_ws(":", F.lit("runtime"), "video_id", target.cast("string")).alias("analysis_id"),
        merge_keywords(F.col("keywords"), F.col("focus_keywords")).alias("analysis_keywords"),
    )


def latest_rows(versions: DataFrame, key: list[str], order: list[str], created: str) -> DataFrame:
    """Last write per key, with the earliest creation time kept.

    One aggregation with map-side combine: a key written many times is reduced before the shuffle.
    """
    rest = [c for c in versions.columns if c not in key]
    reduced = versions.groupBy(*key).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"), F.min(created).alias("created_at")
    )
    return reduced.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest], "created_at")


def unprocessed(incoming: DataFrame, processed: DataFrame, key: str = "video_id") -> DataFrame:
    """First arrival of every id that no earlier run has processed."""
    fresh = first_per_key(incoming, [key], ["seq"])
    return fresh.join(processed.select(key).distinct(), key, "left_anti")


def stage_counts(rows: DataFrame) -> DataFrame:
    """Errors per stage and how many items got through. ``rows(stage, error)``, null error = success."""
    return rows.groupBy("stage").agg(
        F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.col("error").isNull()).alias("successes")
    )


def recent_or_all(df: DataFrame, time: str, cutoff: Column) -> DataFrame:
    """Rows since ``cutoff`` and rows without a time; all rows when that leaves none.

    The check is one row joined to the data, so nothing is read on the driver.
    """
    recent = F.col(time).isNull() | (F.col(time) >= cutoff)
    any_recent = df.filter(recent).limit(1).agg((F.count(F.lit(1)) > 0).alias("_any"))
    return df.join(F.broadcast(any_recent)).filter(recent | ~F.col("_any")).drop("_any")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in an order fixed by the seed and the key."""
    mixed = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("_o", mixed).orderBy("_o").limit(n).drop("_o")


def daily_counts(df: DataFrame, time: str) -> DataFrame:
    return df.groupBy(F.to_date(time).alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
