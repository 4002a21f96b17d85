"""Evaluation metrics, error patterns, weight sweeps and rank stability.

Sweeps multiply per-document or per-candidate features by a literal list of variants after the features
have been aggregated and partitioned, never the texts or sentences behind them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialoom.functions.columns import ratio, round4
from medialoom.functions.ranking import dense_position, first_per_key, top_n
from medialoom.operators.graph import RELEVANCE
from medialoom.operators.scoring import check_weights
from medialoom.operators.terms import FEW_TERMS, term_hits
from medialoom.operators.text import text_template

# Confirmation bounds, gate tolerance, grids and named weight sets.
CONFIRM_TEXTS, CONFIRM_TEMPLATES, CANDIDATES_KEPT = 5, 2, 20
MAX_DROP = 0.02
THRESHOLDS, MARGINS, KS = ["0.86", "0.88", "0.90"], ["0.04", "0.06", "0.08"], [2, 3]
NAMED_WEIGHTS = {
    "default_40_30_30": (0.40, 0.30, 0.30),
    "opinion_heavy_50_25_25": (0.50, 0.25, 0.25),
    "emotion_heavy_35_45_20": (0.35, 0.45, 0.20),
    "fact_guard_35_25_40": (0.35, 0.25, 0.40),
}
GRID_FIELDS = ["issue_overlap", "shared_keyword", "semantic_similarity"]
GRID_VALUES = [0.0, 0.5, 1.0, 1.5, 2.0]
TOP_K, RELEVANT = 3, 3


# --- classification metrics --------------------------------------------------------------------------


def confusion(rows: DataFrame, group: list[str]) -> DataFrame:
    """Counts and rates of ``gold`` against ``pred`` per group; one aggregation."""
    g, p = F.col("gold"), F.col("pred")
    counts = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(p & g).alias("tp"),
        F.count_if(p & ~g).alias("fp"),
        F.count_if(~p & g).alias("fn"),
        F.count_if(~p & ~g).alias("tn"),
    )
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(2.0 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r"))
    return (
        counts.withColumns({"_p": precision, "_r": recall})
        .withColumns(
            {
                "precision": round4(F.col("_p")),
                "recall": round4(F.col("_r")),
                "f1": round4(f1),
                "accuracy": round4(ratio(F.col("tp") + F.col("tn"), F.col("count"))),
            }
        )
        .drop("_p", "_r")
    )


def dedupe_by_text(rows: DataFrame, text: str, order: str) -> DataFrame:
    """First row of every text."""
    return first_per_key(rows, [text], [order])


def error_cases(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """Wrong predictions with the words that matched. ``matches(sentence_id, matched_word)``."""
    words = matches.groupBy("sentence_id").agg(F.array_sort(F.collect_set("matched_word")).alias("matched_words"))
    wrong = rows.filter(F.col("gold") != F.col("pred"))
    return wrong.join(words, "sentence_id", "left").select(
        *rows.columns,
        F.when(F.col("pred"), "FP").otherwise("FN").alias("error_type"),
        F.coalesce("matched_words", F.array().cast("array<string>")).alias("matched_words"),
    )


def error_patterns(words: DataFrame) -> DataFrame:
    """Support per error word: distinct texts and templates, confirmed or one of the best candidates.

    ``words(error_type, word, sentence_text)``. Texts are counted per template first, so no distinct
    aggregate expands the rows.
    """
    texts = words.select("error_type", "word", "sentence_text").distinct()
    per_template = texts.groupBy("error_type", "word", text_template(F.col("sentence_text")).alias("_t")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    support = per_template.groupBy("error_type", "word").agg(
        F.sum("_n").alias("support_unique_text"), F.count(F.lit(1)).alias("template_count")
    )
    sure = (F.col("support_unique_text") >= CONFIRM_TEXTS) & (F.col("template_count") >= CONFIRM_TEMPLATES)
    marked = support.withColumn("status", F.when(sure, "confirmed").otherwise("candidate"))
    order = [F.col("support_unique_text").desc(), F.col("template_count").desc(), F.col("word").desc()]
    candidates = top_n(marked.filter(F.col("status") == "candidate"), ["error_type"], order, CANDIDATES_KEPT)
    return marked.filter(F.col("status") == "confirmed").unionByName(candidates.drop("rank"))


def stage_delta(metrics: DataFrame, base: str, other: str) -> DataFrame:
    """Metrics of ``other`` minus ``base`` per stage."""
    names = ["fp", "fn", "precision", "recall", "f1"]
    a = metrics.filter(F.col("variant") == base).select("stage", *[F.col(c).alias(f"_{c}") for c in names])
    b = metrics.filter(F.col("variant") == other).select("stage", *names)
    return b.join(a, "stage").select(
        "stage",
        *[(F.col(c) - F.col(f"_{c}")).alias(f"delta_{c}") for c in ("fp", "fn")],
        *[round4(F.col(c) - F.col(f"_{c}")).alias(f"delta_{c}") for c in ("precision", "recall", "f1")],
    )


def release_gate(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Whether the current metrics may replace the baseline: one row against one row per stage."""
    a = baseline.select("stage", *[F.col(c).alias(f"_{c}") for c in ("fp", "precision", "recall", "f1")])
    slack = MAX_DROP + 1e-9
    out = current.join(a, "stage").select(
        "stage",
        (F.col("fp") <= F.col("_fp")).alias("fp_non_increase"),
        (F.col("_precision") - F.col("precision") <= slack).alias("precision_ok"),
        (F.col("_recall") - F.col("recall") <= slack).alias("recall_ok"),
        (F.col("f1") >= F.col("_f1")).alias("f1_non_decrease"),
    )
    every = F.col("fp_non_increase") & F.col("precision_ok") & F.col("recall_ok") & F.col("f1_non_decrease")
    return out.withColumn("passed", every)


def threshold_grid(hits: DataFrame, gold: DataFrame, n: int = 5) -> DataFrame:
    """Best settings of threshold, margin and k.

    ``hits(sentence_id, scores ARRAY<DECIMAL>)`` sorted downwards, ``gold(sentence_id, gold)``. The grid is
    a literal array exploded over the distinct score lists of each sentence.
    """
    dec = lambda v: F.lit(v).cast("decimal(6,4)")
    grid = F.array(
        *[
            F.struct(dec(t).alias("threshold"), dec(m).alias("margin"), F.lit(k).alias("k"))
            for t, m, k in itertools.product(THRESHOLDS, MARGINS, KS)
        ]
    )
    kept = F.filter(F.slice("scores", 1, F.col("k")), lambda s: s >= F.col("threshold"))
    accepted = (F.size("kept") == 1) | ((F.size("kept") > 1) & (F.get("kept", F.lit(0)) - F.get("kept", F.lit(1)) >= F.col("margin")))
    per_sentence = (
        hits.distinct()
        .select("sentence_id", "scores", F.inline(grid))
        .withColumn("kept", kept)
        .groupBy("sentence_id", "threshold", "margin", "k")
        .agg(F.max(accepted).alias("hit"))
    )
    every = gold.select("*", F.inline(grid))
    rows = every.join(per_sentence, ["sentence_id", "threshold", "margin", "k"], "left").withColumn(
        "pred", F.coalesce("hit", F.lit(False))
    )
    metrics = confusion(rows, ["threshold", "margin", "k"])
    order = [F.col("f1").desc(), F.col("precision").desc(), F.col("fp"), F.col("threshold"), F.col("margin"), F.col("k")]
    return metrics.orderBy(*order).limit(n)


def keyword_hits(rows: DataFrame, targets: list[str]) -> DataFrame:
    """Predicted sentences that contain target words, in the order of ``targets``.

    A few words are literals; more are searched by one automaton in the distinct sentences.
    """
    if len(targets) > FEW_TERMS:
        listed = rows.sparkSession.createDataFrame(list(enumerate(dict.fromkeys(targets))), "place int, term string")
        pred = rows.filter("pred")
        hits = term_hits(pred.select("sentence_text").distinct(), ["sentence_text"], "sentence_text", listed)
        per = hits.join(listed, "term").groupBy("sentence_text").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("_found"))
        return pred.join(per, "sentence_text").withColumn("matched", F.col("_found.term")).select(*pred.columns, "matched")
    found = F.array_compact(F.array(*[F.when(F.contains("sentence_text", F.lit(w)), F.lit(w)) for w in targets]))
    return rows.filter("pred").withColumn("matched", found).filter(F.size("matched") > 0)


# --- score weights -----------------------------------------------------------------------------------


def simplex_weights(divisions: int = 10) -> dict[str, tuple[float, float, float]]:
    """All weight triples in steps of ``1/divisions`` that add up to 1, by name."""
    if divisions <= 0:
        raise ValueError("divisions must be positive")
    out = {}
    for o in range(divisions + 1):
        for e in range(divisions + 1 - o):
            w = (o / divisions, e / divisions, (divisions - o - e) / divisions)
            out["grid_" + "_".join(f"{x:.2f}" for x in w)] = w
    return out


def weight_array(variants: dict[str, tuple[float, float, float]]) -> Column:
    rows = []
    for name, (o, e, f) in variants.items():
        check_weights({"opinion": o, "emotion": e, "fact": f})
        rows.append(
            F.struct(F.lit(name).alias("variant"), F.lit(o).alias("w_opinion"), F.lit(e).alias("w_emotion"), F.lit(f).alias("w_fact"))
        )
    return F.array(*rows)


def weight_sweep(scores: DataFrame, variants: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Overall score of every document under every variant; ``scores`` carries the three shares."""
    rows = scores.select("*", F.inline(weight_array(variants)))
    overall = F.least(
        F.lit(1.0),
        F.col("opinion_score") * F.col("w_opinion")
        + F.col("emotion_score") * F.col("w_emotion")
        + (1.0 - F.col("fact_ratio")) * F.col("w_fact"),
    )
    return rows.withColumn("overall", round4(overall))


def ab_separation(sweep: DataFrame) -> DataFrame:
    """Means, extremes, margin and squared loss of the two sets per variant; sums are exact decimals."""
    s = F.col("overall").cast("decimal(10,4)")
    a, b = F.col("dataset") == "A", F.col("dataset") == "B"
    one = F.lit(1).cast("decimal(10,4)")
    mean = lambda c, v: F.sum(F.when(c, v)).cast("double") / F.count_if(c)
    out = sweep.groupBy("variant").agg(
        round4(mean(a, s)).alias("a_mean"),
        round4(mean(b, s)).alias("b_mean"),
        F.min(F.when(a, F.col("overall"))).alias("a_min"),
        F.max(F.when(b, F.col("overall"))).alias("b_max"),
        round4(mean(a, (s - one) * (s - one)) + mean(b, s * s)).alias("loss"),
    )
    return out.withColumns(
        {
            "margin": round4(F.col("a_min") - F.col("b_max")),
            "direction_ok": F.col("a_mean") > F.col("b_mean"),
            "strict_ok": F.col("a_min") > F.col("b_max"),
        }
    )


def rank_stability(sweep: DataFrame, baseline: str) -> DataFrame:
    """Spearman and top-k overlap against the baseline for all documents and for each set.

    Ranks come from score histograms (see ``dense_position``), so ranking a set of any size is distributed.
    """
    rows = sweep.select("variant", "target_id", "overall", F.explode(F.array(F.lit("ALL"), F.col("dataset"))).alias("part"))
    ranked = dense_position(rows, ["variant", "part"], "overall", "target_id", "pos")
    base = ranked.filter(F.col("variant") == baseline).select("part", "target_id", F.col("pos").alias("base_pos"))
    pairs = ranked.join(base, ["part", "target_id"])
    d = (F.col("pos") - F.col("base_pos")).cast("decimal(20,0)")
    both = lambda k: F.count_if((F.col("pos") <= k) & (F.col("base_pos") <= k))
    agg = pairs.groupBy("variant", "part").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((d * d).cast("decimal(38,0)")).cast("double").alias("_d2"),
        both(5).alias("_t5"),
        both(10).alias("_t10"),
    )
    n = F.col("n").cast("double")
    spearman = F.when(F.col("n") < 2, 1.0).otherwise(1.0 - 6.0 * F.col("_d2") / (n * (n * n - 1.0)))

    def jaccard(k: int, c: str) -> Column:
        taken = F.least(F.lit(k), F.col("n")) * 2 - F.col(c)
        return round4(F.coalesce(F.try_divide(F.col(c).cast("double"), taken.cast("double")), F.lit(1.0)))

    return agg.select(
        "variant", "part", "n", round4(spearman).alias("spearman"),
        jaccard(5, "_t5").alias("top5_jaccard"), jaccard(10, "_t10").alias("top10_jaccard"),
    )


def sweep_summary(stability: DataFrame, separation: DataFrame) -> DataFrame:
    """Minimum, median, maximum and mean of each stability metric, and the direction ratios.

    Inputs hold one row per variant (and part).
    """
    metrics = stability.select(
        F.inline(
            F.array(
                F.struct(F.concat(F.lit("spearman_"), F.lower("part")).alias("metric"), F.col("spearman").alias("v")),
                F.struct(F.when(F.col("part") == "ALL", "top5_jaccard").alias("metric"), F.col("top5_jaccard").alias("v")),
                F.struct(F.when(F.col("part") == "ALL", "top10_jaccard").alias("metric"), F.col("top10_jaccard").alias("v")),
            )
        )
    ).filter(F.col("metric").isNotNull())
    flags = separation.select(
        F.inline(
            F.array(
                F.struct(F.lit("direction_ok").alias("metric"), F.col("direction_ok").cast("int").cast("double").alias("v")),
                F.struct(F.lit("strict_ok").alias("metric"), F.col("strict_ok").cast("int").cast("double").alias("v")),
            )
        )
    )
    mean = F.sum(F.col("v").cast("decimal(20,4)")).cast("double") / F.count("v")
    return metrics.unionByName(flags).groupBy("metric").agg(
        F.count("v").alias("variants"), F.min("v").alias("min"), round4(F.median("v")).alias("median"),
        F.max("v").alias("max"), round4(mean).alias("mean"),
    )


def best_and_worst(stability: DataFrame, n: int) -> DataFrame:
    """The ``n`` most and least stable variants over all documents."""
    whole = stability.filter(F.col("part") == "ALL")
    keys = ["spearman", "top10_jaccard", "top5_jaccard", "variant"]
    best = whole.orderBy(*[F.col(k).desc() for k in keys]).limit(n).withColumn("side", F.lit("best"))
    worst = whole.orderBy(*[F.col(k).asc() for k in keys]).limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


# --- relevance weights -------------------------------------------------------------------------------


def relevance_variants(fields: list[str] = GRID_FIELDS, values: list[float] = GRID_VALUES) -> dict[str, tuple[float, ...]]:
    """Baseline, each weight dropped or doubled, and the multiplier grid; equal vectors keep their first name."""
    names = list(RELEVANCE)
    wanted: list[tuple[str, dict[str, float]]] = [("baseline", {})]
    for f in names:
        wanted += [(f"ablate_{f}", {f: 0.0}), (f"double_{f}", {f: RELEVANCE[f] * 2.0})]
    for mult in itertools.product(values, repeat=len(fields)):
        label = "grid__" + "_".join(f"{f}x{m:.2f}" for f, m in zip(fields, mult))
        wanted.append((label, {f: RELEVANCE[f] * m for f, m in zip(fields, mult)}))
    out: dict[tuple[float, ...], str] = {}
    for name, change in wanted:
        out.setdefault(tuple(change.get(f, RELEVANCE[f]) for f in names), name)
    return {name: vector for vector, name in out.items()}


FEATURES = [
    "issue_overlap_count", "shared_keyword_count", "shared_entity_count", "semantic_similarity", "analysis_success",
    "view_score", "published_at",
]
GROUP = ["source_id", "keyword", "country"]


def _slim(rows: DataFrame) -> DataFrame:
    values = [F.col(f).cast("int").cast("double") if f in ("analysis_success", "published_at") else F.col(f).cast("double") for f in FEATURES]
    return rows.select(*GROUP, "candidate_id", "relevance", F.array(*values).alias("f"))


def variant_scores(rows: DataFrame, variants: dict[str, tuple[float, ...]]) -> DataFrame:
    """Score of every candidate under every variant.

    Rows are shuffled once by their group; the variants are exploded behind that shuffle, so every later
    window and aggregate over (variant, group) finds its rows in place.
    """
    grid = F.array(
        *[
            F.struct(F.lit(n).alias("variant"), F.array(*[F.lit(float(w)) for w in v]).alias("w"))
            for n, v in variants.items()
        ]
    )
    slim = _slim(rows)
    # A fixed number keeps adaptive execution from merging partitions that are about to grow many times.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = slim.repartition(parts, *GROUP)
    out = placed.select("*", F.inline(grid))
    score = F.lit(0.0)
    for i in range(len(FEATURES)):
        score = score + F.get("f", F.lit(i)) * F.get("w", F.lit(i))
    return out.withColumn("score", score).drop("f", "w")


def ranking_metrics(scored: DataFrame, k: int = TOP_K, relevant: int = RELEVANT) -> DataFrame:
    """nDCG, recall, reciprocal rank and relevant items in the top ``k`` per (variant, group).

    A group holds the candidates of one source in one country, which the ranking step bounds.
    """
    keys = ["variant", *GROUP]
    by_score = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "candidate_id")
    by_worth = Window.partitionBy(*keys).orderBy(F.col("relevance").desc(), "candidate_id")
    ranked = scored.withColumns({"rank": F.row_number().over(by_score), "ideal": F.row_number().over(by_worth)})
    good = F.col("relevance") >= relevant
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1.0
    dcg = lambda r: F.sum(F.when(F.col(r) <= k, gain / F.log2(F.col(r) + 1.0)).otherwise(0.0))
    agg = ranked.groupBy(*keys).agg(
        dcg("rank").alias("_dcg"), dcg("ideal").alias("_idcg"), F.count_if(good).alias("_all"),
        F.count_if(good & (F.col("rank") <= k)).alias("top_relevant"), F.min(F.when(good, F.col("rank"))).alias("_first"),
    )
    return agg.select(
        *keys,
        round4(F.when(F.col("_idcg") == 0, 1.0).otherwise(F.col("_dcg") / F.col("_idcg"))).alias("ndcg"),
        round4(F.when(F.col("_all") == 0, 1.0).otherwise(F.col("top_relevant") / F.col("_all"))).alias("recall"),
        round4(F.coalesce(1.0 / F.col("_first"), F.lit(0.0))).alias("mrr"),
        "top_relevant",
    )


def against_baseline(scored: DataFrame, k: int = TOP_K) -> DataFrame:
    """Spearman and top-``k`` overlap of each (variant, group) with the baseline ranking."""
    keys = ["variant", *GROUP]
    ranked = scored.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "candidate_id"))
    ).select(*keys, "candidate_id", "rank")
    item = Window.partitionBy(*GROUP, "candidate_id")
    paired = ranked.withColumn("base", F.max(F.when(F.col("variant") == "baseline", F.col("rank"))).over(item))
    d = F.col("rank") - F.col("base")
    agg = paired.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum((d * d).cast("bigint")).alias("_d2"),
        F.count_if((F.col("rank") <= k) & (F.col("base") <= k)).alias("_both"),
    )
    n = F.col("n").cast("double")
    spearman = F.when(F.col("n") < 2, 1.0).otherwise(1.0 - 6.0 * F.col("_d2") / (n * (n * n - 1.0)))
    union = F.least(F.lit(k), F.col("n")) * 2 - F.col("_both")
    return agg.select(*keys, round4(spearman).alias("spearman"), round4(F.col("_both") / union).alias("jaccard"))


def variant_means(metrics: DataFrame, stability: DataFrame) -> DataFrame:
    """Mean of every metric per variant over all groups."""
    mean = lambda c: round4(F.sum(F.col(c).cast("decimal(20,4)")).cast("double") / F.count(F.lit(1))).alias(f"mean_{c}")
    joined = metrics.join(stability, ["variant", *GROUP])
    return joined.groupBy("variant").agg(
        F.count(F.lit(1)).alias("groups"), *[mean(c) for c in ("ndcg", "recall", "mrr", "top_relevant", "jaccard", "spearman")]
    )


def _group_metrics(rows: dict[str, np.ndarray], weights: np.ndarray, base: int, k: int, relevant: int) -> np.ndarray:
    """``(variants, 6)``: nDCG, recall, reciprocal rank, relevant in the top, overlap and Spearman in units of 0.0001,
    each summed over the groups. Rows are sorted by group, then candidate, so stable sorts break ties by candidate."""
    starts = np.flatnonzero(np.diff(rows["group"], prepend=rows["group"][0] - 1))
    sizes = np.diff(starts, append=len(rows["group"]))
    group = np.repeat(np.arange(len(starts)), sizes)
    ranks = np.arange(len(group)) - starts[group] + 1
    worth = rows["relevance"]  # NaN where there is none
    good = worth >= relevant
    gain = np.nan_to_num(np.power(2.0, worth) - 1.0)
    discount = np.log2(ranks + 1.0)
    top = ranks <= k
    units = lambda x: np.floor(x * 10000.0 + 0.5).astype(np.int64).sum()

    def dcg(order: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.where(top, gain[order] / discount, 0.0), starts)

    ideal = dcg(np.lexsort((-worth, group)))
    relevant_all = np.add.reduceat(good.astype(np.int64), starts)

    def order_of(w: np.ndarray) -> np.ndarray:
        score = np.zeros(len(group))
        for i, x in enumerate(w):
            score = score + rows["f"][:, i] * x
        return np.lexsort((-score, group))

    def places(order: np.ndarray) -> np.ndarray:
        out = np.empty(len(order), np.int64)
        out[order] = ranks
        return out

    at_base = places(order_of(weights[base]))
    n = sizes.astype(float)
    out = []
    for w in weights:
        order = order_of(w)
        place = places(order)
        hits = np.add.reduceat((good[order] & top).astype(np.int64), starts)
        first = np.minimum.reduceat(np.where(good[order], ranks, np.inf), starts)
        apart = np.add.reduceat((place - at_base) ** 2, starts).astype(float)
        both = np.add.reduceat(((place <= k) & (at_base <= k)).astype(np.int64), starts)
        with np.errstate(divide="ignore", invalid="ignore"):
            ndcg = np.where(ideal == 0, 1.0, dcg(order) / ideal)
            recall = np.where(relevant_all == 0, 1.0, hits / relevant_all)
            spearman = np.where(n < 2, 1.0, 1.0 - 6.0 * apart / (n * (n * n - 1.0)))
        jaccard = both / (np.minimum(k, sizes) * 2 - both)
        out.append([units(ndcg), units(recall), units(1.0 / first), hits.sum() * 10000, units(jaccard), units(spearman)])
    return np.array(out, np.int64)


MEANS = ["ndcg", "recall", "mrr", "top_relevant", "jaccard", "spearman"]


def sweep_means(rows: DataFrame, variants: dict[str, tuple[float, ...]], k: int = TOP_K, relevant: int = RELEVANT) -> DataFrame:
    """``variant_means`` of ``ranking_metrics`` and ``against_baseline``, for many variants.

    One shuffle brings the candidates of a group together; a batch of whole groups is then scored and ranked under every
    variant, and only sums per variant leave the task. So rows are never multiplied by the variants. Metrics are rounded
    to four digits before they are summed, as whole numbers.
    """
    names, weights = list(variants), np.array(list(variants.values()), float)
    base = names.index("baseline")
    slim = _slim(rows).withColumns({"relevance": F.col("relevance").cast("double"), "group": F.struct(*GROUP)}).drop(*GROUP)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = slim.repartition(parts, "group").sortWithinPartitions("group", "candidate_id").select("group", "relevance", "f")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, groups, rest = np.zeros((len(names), len(MEANS)), np.int64), 0, None

        def add(table: pa.Table) -> None:
            nonlocal sums, groups
            number = _numbers(table)
            flat = table["f"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
            part = {"group": number, "relevance": table["relevance"].to_numpy().astype(float), "f": flat.reshape(len(number), -1)}
            sums = sums + _group_metrics(part, weights, base, k, relevant)
            groups += int(number[-1]) + 1

        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            number = _numbers(rest) if len(rest) else np.zeros(0, int)
            whole = int(np.searchsorted(number, number[-1])) if len(number) else 0  # the last group may go on
            if whole:
                add(rest.slice(0, whole))
                rest = rest.slice(whole)
        if rest is not None and len(rest):
            add(rest)
        if groups:
            columns = [pa.array(names), pa.array([groups] * len(names), pa.int64()), *[pa.array(c) for c in sums.T]]
            yield pa.RecordBatch.from_arrays(columns, ["variant", "groups", *MEANS])

    found = placed.mapInArrow(summed, "variant string, groups long, " + ", ".join(f"{c} long" for c in MEANS))
    mean = lambda c: round4(F.sum(c).cast("double") / 10000.0 / F.sum("groups")).alias(f"mean_{c}")
    return found.groupBy("variant").agg(F.sum("groups").alias("_n"), *[mean(c) for c in MEANS]).withColumnRenamed("_n", "groups")


def _numbers(table: pa.Table) -> np.ndarray:
    """Number of each row's group, from 0; rows are sorted by group."""
    fields = table["group"].combine_chunks().flatten()
    changed = np.zeros(len(table), bool)
    for values in fields:
        codes = values.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        changed[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(changed)


def country_stability(stability: DataFrame) -> DataFrame:
    mean = F.sum(F.col("jaccard").cast("decimal(20,4)")).cast("double") / F.count(F.lit(1))
    return stability.groupBy("variant", "country").agg(round4(mean).alias("mean_jaccard"))


def stable_and_weak(means: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most stable and the ``n`` weakest variants."""
    keys = ["mean_ndcg", "mean_recall", "mean_jaccard", "mean_spearman", "variant"]
    stable = means.orderBy(*[F.col(c).desc() for c in keys]).limit(n).withColumn("side", F.lit("stable"))
    weak = means.orderBy(*[F.col(c).asc() for c in keys]).limit(n).withColumn("side", F.lit("weak"))
    return stable.unionByName(weak)
