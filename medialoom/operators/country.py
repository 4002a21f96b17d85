"""Country comparison report.

Every table is an aggregate over (issue, country[, channel]) rows; money-like views are summed as exact
decimals so repeated runs agree to the last digit.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialoom.functions.columns import ratio, round4
from medialoom.functions.ranking import top_n
from medialoom.operators.terms import FEW_TERMS, term_hits
from medialoom.session import materialize

# Marks and weights of the approach scorecard, and its acceptance marks.
MARKS = {
    "rule_based": {"interpretability": 4.5, "runtime": 4.5, "ops_cost": 4.6},
    "graph_based": {"interpretability": 3.8, "runtime": 3.5, "ops_cost": 3.6},
}
SCORE_WEIGHTS = {"accuracy": 0.4, "interpretability": 0.25, "runtime": 0.15, "reproducibility": 0.1, "ops_cost": 0.1}


def round2(c: Column) -> Column:
    return F.floor(c * 100.0 + 0.5) / 100.0


def _views() -> Column:
    return F.col("view_count").cast("decimal(24,2)")


def issue_records(context: DataFrame, countries: list[str], issues: list[str], date_from: str, date_to: str) -> DataFrame:
    """Usable videos with the issues their title, keywords or issue names mention, in configured order.

    All conditions are plain filters on the scan. Issues are searched in title and keywords, which a zero character parts: a few
    as literals, more by one automaton. The optimizer moves no filter below an explode, so keywords and issues are made once.
    """
    kept = context.filter(
        F.upper("country").isin(*[c.upper() for c in countries])
        & F.col("published_at").between(date_from, date_to)
        & (F.col("view_count") >= 0)
        & (F.upper(F.coalesce("status", F.lit("SUCCESS"))) != "FAILED")
        & (F.coalesce("video_id", F.lit("")) != "")
    )

    if len(issues) > FEW_TERMS:
        return issues_by_terms(kept, issues)

    def mentioned(text: Column) -> Column:
        return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(i.lower())), F.lit(i)) for i in issues]))

    matched = F.transform(F.array(searched()), mentioned)
    return kept.select("*", F.explode(F.filter(matched, lambda m: F.size(m) > 0)).alias("issues"))


def searched() -> Column:
    return F.lower(F.concat_ws("\x00", "title", F.array_join("keywords", "\x00")))


def issues_by_terms(kept: DataFrame, issues: list[str]) -> DataFrame:
    """Rows of ``kept(video_id, title, keywords, ...)`` with the issues they mention, in the order of ``issues``."""
    spark = kept.sparkSession
    listed = spark.createDataFrame([(i.lower(), n, i) for n, i in enumerate(issues)], "term string, place int, issue string")
    found = term_hits(kept.select("video_id", searched().alias("text")), ["video_id"], "text", listed.select("term"))
    named = found.join(listed, "term").groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("place", "issue"))).alias("_issues"))
    return kept.join(named, "video_id").withColumn("issues", F.col("_issues.issue")).drop("_issues")


def balanced_sample(records: DataFrame, issues: list[str], size: int) -> DataFrame:
    """Equal newest share per issue without repeats, topped up with the newest of the rest.

    Only the newest ``size`` rows of each issue and overall can ever be chosen, so the data is cut to those
    first; the greedy choice then sees at most ``size * (len(issues) + 1)`` rows whatever the input. The records are read once:
    null stands for all issues.
    """
    quota = max(1, size // max(1, len(issues)))
    slim = records.select("video_id", "published_at", "issues")
    newest = [F.col("published_at").desc(), F.col("video_id").desc()]
    known = F.filter("issues", lambda i: i.isin(*issues)) if issues else F.array().cast("array<string>")
    per_issue = slim.select("*", F.explode(F.concat(known, F.array(F.lit(None).cast("string")))).alias("_issue"))
    head = top_n(per_issue, ["_issue"], newest, size).select("video_id", "published_at", "issues")
    pool = head.dropDuplicates(["video_id"]).withColumn("_g", F.lit(0))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["published_at", "video_id"], ascending=False)
        taken: dict[str, str] = {}
        for issue in issues:
            fresh = [v for v, i in zip(pdf["video_id"], pdf["issues"]) if issue in i and v not in taken]
            taken.update(dict.fromkeys(fresh[:quota], issue))
        rest = [v for v in pdf["video_id"] if v not in taken][: max(0, size - len(taken))]
        taken.update(dict.fromkeys(rest, "top-up"))
        return pd.DataFrame({"video_id": list(taken), "picked_for": list(taken.values())})

    return pool.groupBy("_g").applyInPandas(choose, "video_id string, picked_for string")


def by_issue(records: DataFrame) -> DataFrame:
    return records.select("*", F.explode("issues").alias("issue")).drop("issues")


def country_issue_kpi(rows: DataFrame) -> DataFrame:
    total = F.sum(_views()).cast("double")
    n = F.count(F.lit(1))
    bias = F.sum(F.coalesce("bias_score", F.lit(0.0)).cast("decimal(24,4)")).cast("double")
    return rows.groupBy("issue", "country").agg(
        n.alias("video_count"),
        total.alias("total_views"),
        round2(total / n).alias("avg_views"),
        round4(bias / n).alias("avg_bias_score"),
    )


def tone_distribution(rows: DataFrame, n: int) -> DataFrame:
    counted = rows.groupBy("issue", "country", F.upper("tone").alias("tone_label")).agg(F.count(F.lit(1)).alias("n"))
    return top_n(counted, ["issue", "country"], [F.col("n").desc(), F.col("tone_label")], n)


def channel_views(rows: DataFrame) -> DataFrame:
    """Views per (issue, country, channel): the base of shares, centrality and bridges."""
    name = F.coalesce("channel", F.lit("UNKNOWN_CHANNEL"))
    return rows.groupBy("issue", "country", name.alias("channel")).agg(F.sum(_views()).alias("views"))


def channel_share(rows: DataFrame, n: int) -> DataFrame:
    """Top channels with the share of the best three in all views."""
    per_channel = materialize(channel_views(rows), "channels")
    totals = per_channel.groupBy("issue", "country").agg(F.sum("views").alias("_all"))
    best = top_n(per_channel, ["issue", "country"], [F.col("views").desc(), F.col("channel")], max(n, 3))
    three = best.filter(F.col("rank") <= 3).groupBy("issue", "country").agg(F.sum("views").alias("_three"))
    share = round4(ratio(F.col("_three"), F.col("_all")))
    return (
        best.filter(F.col("rank") <= n)
        .join(three.join(totals, ["issue", "country"]), ["issue", "country"])
        .select("issue", "country", "rank", "channel", F.col("views").cast("double").alias("views"), share.alias("top_channel_share"))
    )


def country_ranking(rows: DataFrame) -> DataFrame:
    """Countries of an issue by total views; ranks run over one row per country."""
    kpi = country_issue_kpi(rows)
    w = Window.partitionBy("issue").orderBy(F.col("total_views").desc(), "country")
    return kpi.select("issue", F.row_number().over(w).alias("rank"), "country", "total_views", "video_count")


def channel_centrality(rows: DataFrame, n: int) -> DataFrame:
    """Channels by weighted degree with the number of channels of their (issue, country)."""
    per_channel = materialize(channel_views(rows), "channels")
    sizes = per_channel.groupBy("issue", "country").agg(F.count(F.lit(1)).alias("community_size"))
    best = top_n(per_channel, ["issue", "country"], [F.col("views").desc(), F.col("channel")], n)
    return best.join(sizes, ["issue", "country"]).select(
        "issue", "country", "rank", "channel", F.col("views").cast("double").alias("centrality_score"), "community_size"
    )


def bridge_channels(rows: DataFrame, n: int) -> DataFrame:
    """Channels seen in two or more countries, by views times countries."""
    joined = channel_views(rows).groupBy("issue", "channel").agg(
        F.count(F.lit(1)).alias("country_count"),
        F.sum("views").alias("views"),
        F.array_sort(F.collect_set("country")).alias("countries"),
    )
    score = round2((F.col("views") * F.col("country_count")).cast("double"))
    return (
        joined.filter(F.col("country_count") >= 2)
        .select("issue", "channel", "country_count", F.array_join("countries", ",").alias("countries"), score.alias("bridge_score"))
        .orderBy(F.col("bridge_score").desc(), "issue", "channel")
        .limit(n)
    )


def validation_accuracy(records: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of labelled videos whose tone agrees; null ratio without overlap."""
    wanted = expected.filter((F.col("video_id") != "") & (F.col("expected_tone") != ""))
    met = records.join(wanted, "video_id").select((F.upper("tone") == F.upper("expected_tone")).alias("ok"))
    return met.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("matched")).select(
        "total", "matched", round4(F.try_divide(F.col("matched").cast("double"), F.col("total"))).alias("accuracy")
    )


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two runs hold the same rows, and how many differ; each run is made once."""
    both = a.withColumn("_s", F.lit(1)).unionByName(b.withColumn("_s", F.lit(-1)))
    more = both.groupBy(*a.columns).agg(F.sum("_s").alias("_d"))
    surplus = lambda d: F.coalesce(F.sum(F.when(d > 0, d)), F.lit(0).cast("bigint"))
    counts = more.agg(surplus(F.col("_d")).alias("only_first"), surplus(-F.col("_d")).alias("only_second"))
    return counts.withColumn("reproducible", F.col("only_first") + F.col("only_second") == 0)


def scorecard(accuracy: DataFrame, reproducible: DataFrame, records: DataFrame) -> DataFrame:
    """Marks, weighted totals and the decision per approach. All inputs are single-row reports."""
    n = records.agg(F.count(F.lit(1)).alias("n_records"))
    one = accuracy.select("accuracy").join(F.broadcast(reproducible.select("reproducible"))).join(F.broadcast(n))
    spark = accuracy.sparkSession
    fixed = spark.createDataFrame(
        [(k, m["interpretability"], m["runtime"], m["ops_cost"]) for k, m in MARKS.items()],
        "approach string, interpretability double, runtime double, ops_cost double",
    )
    rule = F.col("approach") == "rule_based"
    measured = round2(F.col("_ratio") * 5.0)
    mark = (
        F.when(F.col("n_records") == 0, 0.0)
        .when(F.col("_ratio").isNull(), F.when(rule, 3.5).otherwise(3.3))
        .when(rule, measured)
        .otherwise(F.greatest(F.lit(0.0), round2(measured - 0.2)))
    )
    rows = fixed.join(F.broadcast(one.withColumnRenamed("accuracy", "_ratio"))).withColumns(
        {"accuracy": mark, "reproducibility": F.when(F.col("reproducible"), 5.0).otherwise(2.5)}
    )
    total = F.lit(0.0)
    for name, weight in SCORE_WEIGHTS.items():
        total = total + F.col(name) * weight
    rows = rows.withColumn("total", F.floor(total * 1000.0 + 0.5) / 1000.0)
    good = (F.col("accuracy") >= 3.5) & (F.col("reproducibility") >= 4.0) & (F.col("interpretability") >= 3.5)
    place = F.row_number().over(Window.orderBy(F.col("total").desc(), "approach"))
    return rows.withColumn("place", place).withColumn(
        "status",
        F.when(F.col("n_records") == 0, "blocked")
        .when(F.col("place") > 1, "not_selected")
        .when(good, "adopted")
        .otherwise("needs_poc"),
    ).drop("_ratio", "reproducible", "n_records")


def validation_template(records: DataFrame, size: int = 50) -> DataFrame:
    """Newest records to be labelled by hand, with their first issue."""
    newest = records.orderBy(F.col("published_at").desc(), F.col("video_id").desc()).limit(size)
    return newest.select("video_id", F.get("issues", F.lit(0)).alias("issue"), "country", "title", F.lit("").alias("expected_tone"))


def smoke_subset(records: DataFrame, countries: list[str], issue: str, date_from: str) -> DataFrame:
    """First issue, two countries, recent days only."""
    return records.filter(
        F.col("country").isin(*countries[:2]) & F.array_contains("issues", issue) & (F.col("published_at") >= date_from)
    )
