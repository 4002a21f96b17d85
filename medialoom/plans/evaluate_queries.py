"""Metric, error-pattern, sweep and stability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialoom.functions.columns import round4, tokens
from medialoom.operators import evaluate as E
from medialoom.operators.graph import RELEVANCE
from medialoom.plans.registry import query
from medialoom.plans.score_queries import doc_scores
from medialoom.plans.sqlviews import VIEWS, s_round4, s_squeeze, s_tag, with_views
from medialoom.session import materialize
from medialoom.sources import views as V

_TITLE = "split_part(text, chr(10), 1)"
VIEWS["matches"] = (
    ("lexicon",),
    f"""SELECT DISTINCT sentence_id, w AS matched_word, length(w) AS size, score_hint FROM (SELECT doc_id AS sentence_id, lower(unnest(regexp_extract_all({_TITLE},
    '[A-Za-z0-9가-힣]{{2,}}'))) AS w FROM documents JOIN labels USING (doc_id)) JOIN lexicon ON w = word WHERE category = 'DIRECT_EMOTION'""",
)
VIEWS["evalrows"] = (
    ("matches",),
    f"""SELECT variant, sentence_id, sentence_text, gold, CASE WHEN variant = 'legacy' THEN m >= 3 ELSE m >= 6 END IS TRUE AS pred FROM (SELECT doc_id AS sentence_id,
    {_TITLE} AS sentence_text, toxic = 1 AS gold FROM documents JOIN labels USING (doc_id)) LEFT JOIN (SELECT sentence_id, max(size) AS m FROM matches GROUP BY 1)
    USING (sentence_id), (VALUES ('legacy'), ('improved')) v(variant)""",
)
VIEWS["staged"] = (
    ("evalrows",),
    """SELECT 'raw' AS stage, * FROM evalrows UNION ALL SELECT 'deduped', * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY variant, sentence_text
    ORDER BY sentence_id) AS rn FROM evalrows) WHERE rn = 1""",
)
_P, _R = "coalesce(tp / nullif(tp + fp, 0), 0::DOUBLE)", "coalesce(tp / nullif(tp + fn, 0), 0::DOUBLE)"


def s_confusion(src, group):
    return f"""SELECT {group}, count, tp, fp, fn, tn, {s_round4('p')} AS precision, {s_round4('r')} AS recall, {s_round4('coalesce(2::DOUBLE * p * r / nullif(p + r, 0), 0::DOUBLE)')} AS f1,
    {s_round4('(tp + tn) / count')} AS accuracy FROM (SELECT *, {_P} AS p, {_R} AS r FROM (SELECT {group}, count(*) AS count, count(*) FILTER (pred AND gold) AS tp,
    count(*) FILTER (pred AND NOT gold) AS fp, count(*) FILTER (NOT pred AND gold) AS fn, count(*) FILTER (NOT pred AND NOT gold) AS tn FROM {src} GROUP BY {group}))"""


VIEWS["metrics"] = (("staged",), s_confusion("staged", "stage, variant"))


def eval_base(spark, sf):
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("sentence_id"), title.alias("sentence_text"))
    gold = V.table(spark, sf, "labels").select(F.col("doc_id").alias("sentence_id"), (F.col("toxic") == 1).alias("gold"))
    return docs.join(gold, "sentence_id")


def matches(spark, sf):
    words = eval_base(spark, sf).select("sentence_id", F.explode(F.array_distinct(tokens(F.lower("sentence_text")))).alias("matched_word"))
    direct = V.lexicon(spark, sf).filter(F.col("category") == "DIRECT_EMOTION")
    lookup = direct.select(F.col("word").alias("matched_word"), "score_hint")
    return words.join(lookup, "matched_word").withColumn("size", F.length("matched_word"))


def eval_rows(spark, sf):
    longest = matches(spark, sf).groupBy("sentence_id").agg(F.max("size").alias("m"))
    both = eval_base(spark, sf).join(longest, "sentence_id", "left").select(
        "*", F.explode(F.array(F.lit("legacy"), F.lit("improved"))).alias("variant")
    )
    pred = F.when(F.col("variant") == "legacy", F.col("m") >= 3).otherwise(F.col("m") >= 6)
    return both.select("variant", "sentence_id", "sentence_text", "gold", F.coalesce(pred, F.lit(False)).alias("pred"))


def staged(spark, sf):
    raw = eval_rows(spark, sf)
    first = E.first_per_key(raw, ["variant", "sentence_text"], ["sentence_id"])
    return raw.withColumn("stage", F.lit("raw")).unionByName(first.withColumn("stage", F.lit("deduped")))


def metrics(spark, sf):
    return E.confusion(staged(spark, sf), ["stage", "variant"])


@query("confusion_metrics", with_views("metrics", "SELECT * FROM metrics"))
def confusion_metrics(spark, sf):
    return metrics(spark, sf)


@query("dedupe_text", "SELECT text, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def dedupe_text(spark, sf):
    return E.dedupe_by_text(V.table(spark, sf, "documents").select("doc_id", "text", "source"), "text", "doc_id")


@query(
    "error_cases",
    with_views(
        "evalrows matches",
        """SELECT variant, sentence_id, sentence_text, gold, pred, CASE WHEN pred THEN 'FP' ELSE 'FN' END AS error_type, coalesce(words, '') AS matched_words FROM evalrows
        LEFT JOIN (SELECT sentence_id, string_agg(matched_word, '|' ORDER BY matched_word) AS words FROM matches GROUP BY 1) USING (sentence_id) WHERE gold <> pred""",
    ),
)
def error_cases(spark, sf):
    return E.error_cases(eval_rows(spark, sf), matches(spark, sf)).withColumn("matched_words", F.array_join("matched_words", "|"))


_TEMPLATE = s_squeeze("regexp_replace(sentence_text, '\\p{Nd}+', '<NUM>', 'g')")


@query(
    "error_patterns",
    with_views(
        "evalrows matches",
        f"""WITH bad AS (SELECT * FROM evalrows WHERE gold <> pred AND variant = 'legacy'), w AS (SELECT 'FP' AS error_type, matched_word AS word, sentence_text FROM bad JOIN matches USING (sentence_id)
        WHERE pred UNION ALL SELECT 'FN', word, sentence_text FROM (SELECT sentence_text, unnest(regexp_extract_all(sentence_text, '[A-Za-z0-9가-힣]{{2,}}')) AS word FROM bad WHERE NOT pred)
        WHERE {s_tag('word')} IN ('NNG', 'NNP', 'VV', 'VA', 'MAG', 'XR')),
        s AS (SELECT error_type, word, count(DISTINCT sentence_text) AS support_unique_text, count(DISTINCT {_TEMPLATE}) AS template_count FROM w GROUP BY 1, 2),
        m AS (SELECT *, CASE WHEN support_unique_text >= 5 AND template_count >= 2 THEN 'confirmed' ELSE 'candidate' END AS status FROM s)
        SELECT error_type, word, support_unique_text, template_count, status FROM (SELECT *, row_number() OVER (PARTITION BY error_type, status ORDER BY support_unique_text DESC,
        template_count DESC, word DESC) AS rn FROM m) WHERE status = 'confirmed' OR rn <= 20""",
    ),
)
def error_patterns(spark, sf):
    bad = eval_rows(spark, sf).filter((F.col("variant") == "legacy") & (F.col("gold") != F.col("pred")))
    fp = bad.filter("pred").join(matches(spark, sf), "sentence_id").select(F.lit("FP").alias("error_type"), F.col("matched_word").alias("word"), "sentence_text")
    fn = bad.filter("NOT pred").select(F.lit("FN").alias("error_type"), F.explode(tokens(F.col("sentence_text"))).alias("word"), "sentence_text")
    fn = fn.filter(V.tag_of(F.col("word")).isin("NNG", "NNP", "VV", "VA", "MAG", "XR"))
    return E.error_patterns(fp.unionByName(fn))


@query(
    "stage_delta",
    with_views(
        "metrics",
        f"""SELECT stage, b.fp - a.fp AS delta_fp, b.fn - a.fn AS delta_fn, {s_round4('b.precision - a.precision')} AS delta_precision, {s_round4('b.recall - a.recall')} AS delta_recall,
        {s_round4('b.f1 - a.f1')} AS delta_f1 FROM metrics a JOIN metrics b USING (stage) WHERE a.variant = 'legacy' AND b.variant = 'improved'""",
    ),
)
def stage_delta(spark, sf):
    return E.stage_delta(metrics(spark, sf), "legacy", "improved")


@query(
    "release_gate",
    with_views(
        "metrics",
        """SELECT stage, b.fp <= a.fp AS fp_non_increase, a.precision - b.precision <= 0.02::DOUBLE + 1e-9::DOUBLE AS precision_ok, a.recall - b.recall <= 0.02::DOUBLE + 1e-9::DOUBLE AS recall_ok,
        b.f1 >= a.f1 AS f1_non_decrease, b.fp <= a.fp AND a.precision - b.precision <= 0.02::DOUBLE + 1e-9::DOUBLE AND a.recall - b.recall <= 0.02::DOUBLE + 1e-9::DOUBLE AND b.f1 >= a.f1 AS passed
        FROM metrics a JOIN metrics b USING (stage) WHERE a.variant = 'legacy' AND b.variant = 'improved'""",
    ),
)
def release_gate(spark, sf):
    m = metrics(spark, sf)
    return E.release_gate(m.filter(F.col("variant") == "legacy"), m.filter(F.col("variant") == "improved"))


_GRID = " CROSS JOIN ".join(
    f"(VALUES {', '.join(f'({v})' for v in vals)}) {n}({n})" for n, vals in (("threshold", [f"{t}::DECIMAL(6,4)" for t in E.THRESHOLDS]), ("margin", [f"{m}::DECIMAL(6,4)" for m in E.MARGINS]), ("k", E.KS))
)


@query(
    "threshold_grid",
    with_views(
        "matches evalrows",
        f"""WITH grid AS (SELECT * FROM {_GRID}), hit AS (SELECT sentence_id, [s, (s - g)::DECIMAL(6,4), (s - g - 0.02)::DECIMAL(6,4)] AS scores FROM (SELECT sentence_id,
        (score_hint + 0.05)::DECIMAL(6,4) AS s, (size % 4 * 0.03)::DECIMAL(6,4) AS g FROM matches)),
        p AS (SELECT sentence_id, threshold, margin, k, max(CASE WHEN len(kept) = 1 OR (len(kept) > 1 AND kept[1] - kept[2] >= margin) THEN 1 ELSE 0 END) AS hit FROM (SELECT *,
        list_filter(scores[1:k], lambda s: s >= threshold) AS kept FROM hit, grid) GROUP BY ALL),
        r AS (SELECT g.threshold, g.margin, g.k, gold, coalesce(hit, 0) = 1 AS pred FROM (SELECT DISTINCT sentence_id, gold FROM evalrows) e CROSS JOIN grid g LEFT JOIN p USING (sentence_id, threshold, margin, k))
        SELECT threshold::DOUBLE AS threshold, margin::DOUBLE AS margin, k, tp, fp, fn, precision, recall, f1 FROM ({s_confusion('r', 'threshold, margin, k')})
        ORDER BY f1 DESC, precision DESC, fp, threshold, margin, k LIMIT 5""",
    ),
)
def threshold_grid(spark, sf):
    s = (F.col("score_hint") + F.lit("0.05").cast("decimal(6,4)")).cast("decimal(6,4)")
    gap = (F.col("size") % 4 * F.lit("0.03").cast("decimal(6,4)")).cast("decimal(6,4)")
    dec = lambda c: c.cast("decimal(6,4)")
    hits = matches(spark, sf).select("sentence_id", F.array(s, dec(s - gap), dec(s - gap - F.lit("0.02").cast("decimal(6,4)"))).alias("scores"))
    out = E.threshold_grid(hits, eval_base(spark, sf).select("sentence_id", "gold"))
    return out.select(F.col("threshold").cast("double").alias("threshold"), F.col("margin").cast("double").alias("margin"), "k", "tp", "fp", "fn", "precision", "recall", "f1")


@query(
    "keyword_hits",
    with_views(
        "evalrows",
        "SELECT variant, sentence_id, CASE WHEN contains(sentence_text, 'the') AND contains(sentence_text, 'ing') THEN 'the|ing' WHEN contains(sentence_text, 'the') THEN 'the' ELSE 'ing' END AS matched FROM evalrows WHERE pred AND (contains(sentence_text, 'the') OR contains(sentence_text, 'ing'))",
    ),
)
def keyword_hits(spark, sf):
    hits = E.keyword_hits(eval_rows(spark, sf), ["the", "ing"])
    return hits.select("variant", "sentence_id", F.array_join("matched", "|").alias("matched"))


# --- weight sweeps -----------------------------------------------------------------------------------

GRID = {**E.NAMED_WEIGHTS, **E.simplex_weights(10)}


def _values(variants, cols):
    rows = ", ".join("('" + n + "', " + ", ".join(f"{w!r}::DOUBLE" for w in v) + ")" for n, v in variants.items())
    return f"(VALUES {rows}) v({cols})"


def _sweep_sql(variants, source):
    overall = s_round4("least(1::DOUBLE, opinion_score * w_opinion + emotion_score * w_emotion + (1::DOUBLE - fact_ratio) * w_fact)")
    return f"SELECT variant, w_opinion, w_emotion, w_fact, target_id, dataset, {overall} AS overall FROM {source}, {_values(variants, 'variant, w_opinion, w_emotion, w_fact')}"


VIEWS["abdocs"] = (("scores",), "SELECT doc_id AS target_id, CASE WHEN quality = 1 THEN 'B' ELSE 'A' END AS dataset, opinion_score, emotion_score, fact_ratio FROM scores JOIN labels USING (doc_id)")
VIEWS["alldocs"] = (("scores",), "SELECT doc_id AS target_id, 'ALL' AS dataset, opinion_score, emotion_score, fact_ratio FROM scores")
VIEWS["sweep"] = (("abdocs",), _sweep_sql(GRID, "abdocs"))
VIEWS["separation"] = (
    ("sweep",),
    f"""SELECT variant, a_mean, b_mean, a_min, b_max, loss, {s_round4('a_min - b_max')} AS margin, a_mean > b_mean AS direction_ok, a_min > b_max AS strict_ok FROM (
    SELECT variant, {s_round4("(sum(s) FILTER (dataset = 'A'))::DOUBLE / count(*) FILTER (dataset = 'A')")} AS a_mean, {s_round4("(sum(s) FILTER (dataset = 'B'))::DOUBLE / count(*) FILTER (dataset = 'B')")} AS b_mean,
    min(overall) FILTER (dataset = 'A') AS a_min, max(overall) FILTER (dataset = 'B') AS b_max,
    {s_round4("(sum((s - 1) * (s - 1)) FILTER (dataset = 'A'))::DOUBLE / count(*) FILTER (dataset = 'A') + (sum(s * s) FILTER (dataset = 'B'))::DOUBLE / count(*) FILTER (dataset = 'B')")} AS loss
    FROM (SELECT *, overall::DECIMAL(10,4) AS s FROM sweep) GROUP BY 1)""",
)
VIEWS["stability"] = (
    ("sweep",),
    f"""SELECT variant, part, n, {s_round4('CASE WHEN n < 2 THEN 1::DOUBLE ELSE 1::DOUBLE - 6::DOUBLE * d2 / (n::DOUBLE * (n::DOUBLE * n::DOUBLE - 1::DOUBLE)) END')} AS spearman,
    {s_round4('t5 / (least(5, n) * 2 - t5)')} AS top5_jaccard, {s_round4('t10 / (least(10, n) * 2 - t10)')} AS top10_jaccard FROM (SELECT r.variant, r.part, count(*) AS n, sum((r.pos - b.pos) * (r.pos - b.pos))::DOUBLE AS d2,
    count(*) FILTER (r.pos <= 5 AND b.pos <= 5) AS t5, count(*) FILTER (r.pos <= 10 AND b.pos <= 10) AS t10 FROM ranked r JOIN ranked b ON b.variant = 'default_40_30_30' AND b.part = r.part
    AND b.target_id = r.target_id GROUP BY 1, 2)""",
)
VIEWS["ranked"] = (
    ("sweep",),
    """SELECT variant, part, target_id, row_number() OVER (PARTITION BY variant, part ORDER BY overall DESC, target_id) AS pos FROM (SELECT *, unnest(['ALL', dataset]) AS part FROM sweep)""",
)
VIEWS["stability"] = (("ranked",), VIEWS["stability"][1])


def ab_docs(spark, sf):
    sets = V.table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "B").otherwise("A").alias("dataset"))
    scores = doc_scores(spark, sf).join(sets, "doc_id")
    return scores.select(F.col("doc_id").alias("target_id"), "dataset", "opinion_score", "emotion_score", "fact_ratio")


def sweep(spark, sf):
    """Document features are computed once and written; the sweep only reads three numbers per document."""
    return E.weight_sweep(materialize(ab_docs(spark, sf), "features"), GRID)


@query(
    "weight_grid",
    with_views(
        "alldocs",
        f"SELECT variant, w_opinion, w_emotion, w_fact, count(*) AS docs, {s_round4('sum(overall::DECIMAL(20,4))::DOUBLE / count(*)')} AS mean_overall FROM ({_sweep_sql(GRID, 'alldocs')}) GROUP BY 1, 2, 3, 4",
    ),
)
def weight_grid(spark, sf):
    scores = materialize(doc_scores(spark, sf).select("opinion_score", "emotion_score", "fact_ratio"), "features")
    rows = E.weight_sweep(scores, GRID)
    mean = F.sum(F.col("overall").cast("decimal(20,4)")).cast("double") / F.count(F.lit(1))
    return rows.groupBy("variant", "w_opinion", "w_emotion", "w_fact").agg(F.count(F.lit(1)).alias("docs"), round4(mean).alias("mean_overall"))


@query("weight_sweep", with_views("alldocs", f"SELECT variant, target_id, overall FROM ({_sweep_sql(E.NAMED_WEIGHTS, 'alldocs')})"))
def weight_sweep(spark, sf):
    scores = doc_scores(spark, sf).select(F.col("doc_id").alias("target_id"), "opinion_score", "emotion_score", "fact_ratio")
    return E.weight_sweep(scores, E.NAMED_WEIGHTS).select("variant", "target_id", "overall")


@query("ab_separation", with_views("separation", "SELECT * FROM separation"))
def ab_separation(spark, sf):
    return E.ab_separation(sweep(spark, sf))


@query("rank_stability", with_views("stability", "SELECT * FROM stability"))
def rank_stability(spark, sf):
    return E.rank_stability(sweep(spark, sf), "default_40_30_30")


@query(
    "sweep_summary",
    with_views(
        "stability separation",
        f"""WITH m AS (SELECT 'spearman_' || lower(part) AS metric, spearman AS v FROM stability UNION ALL SELECT 'top5_jaccard', top5_jaccard FROM stability WHERE part = 'ALL'
        UNION ALL SELECT 'top10_jaccard', top10_jaccard FROM stability WHERE part = 'ALL' UNION ALL SELECT 'direction_ok', direction_ok::INT::DOUBLE FROM separation
        UNION ALL SELECT 'strict_ok', strict_ok::INT::DOUBLE FROM separation)
        SELECT metric, count(*) AS variants, min(v) AS min, {s_round4('median(v)')} AS median, max(v) AS max, {s_round4('sum(v::DECIMAL(20,4))::DOUBLE / count(*)')} AS mean FROM m GROUP BY 1""",
    ),
)
def sweep_summary(spark, sf):
    rows = sweep(spark, sf)
    return E.sweep_summary(E.rank_stability(rows, "default_40_30_30"), E.ab_separation(rows))


# --- relevance ---------------------------------------------------------------------------------------

VIEWS["rel"] = (
    (),
    """SELECT 'c' || o_custkey::VARCHAR AS source_id, c_mktsegment AS keyword, CASE WHEN o_orderkey % 2 = 0 THEN 'KR' ELSE 'US' END AS country, o_orderkey AS candidate_id,
    (o_orderkey * 7 % 4)::INT AS relevance, (o_orderkey % 4)::DOUBLE AS f1, ((o_custkey + o_orderkey) % 5)::DOUBLE AS f2, (o_orderkey // 4 % 3)::DOUBLE AS f3,
    (o_orderkey % 101) / 100::DOUBLE AS f4, (o_orderstatus = 'F')::INT::DOUBLE AS f5, o_totalprice / 1000000::DOUBLE AS f6, 1::DOUBLE AS f7 FROM orders JOIN customer ON o_custkey = c_custkey""",
)
VARIANTS = E.relevance_variants()
_WCOLS = ", ".join(f"w{i}" for i in range(1, 8))
_RSCORE = "0::DOUBLE + " + " + ".join(f"f{i} * w{i}" for i in range(1, 8))
VIEWS["rscored"] = (("rel",), f"SELECT *, {_RSCORE} AS score FROM rel, {_values(VARIANTS, 'variant, ' + _WCOLS)}")
_K = "variant, source_id, keyword, country"
VIEWS["rranked"] = (
    ("rscored",),
    f"""SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY score DESC, candidate_id) AS rank, row_number() OVER (PARTITION BY {_K} ORDER BY relevance DESC, candidate_id) AS ideal FROM rscored""",
)


def s_rank_metrics(src):
    dcg = lambda r: f"sum(CASE WHEN {r} <= 3 THEN (pow(2::DOUBLE, relevance) - 1::DOUBLE) / log2({r} + 1::DOUBLE) ELSE 0::DOUBLE END)"
    return f"""SELECT {_K}, {s_round4('CASE WHEN i = 0 THEN 1::DOUBLE ELSE d / i END')} AS ndcg, {s_round4('CASE WHEN al = 0 THEN 1::DOUBLE ELSE top_relevant / al END')} AS recall,
    {s_round4('coalesce(1::DOUBLE / f, 0::DOUBLE)')} AS mrr, top_relevant FROM (SELECT {_K}, {dcg('rank')} AS d, {dcg('ideal')} AS i, count(*) FILTER (relevance >= 3) AS al,
    count(*) FILTER (relevance >= 3 AND rank <= 3) AS top_relevant, min(rank) FILTER (relevance >= 3) AS f FROM {src} GROUP BY {_K})"""


VIEWS["rmetrics"] = (("rranked",), s_rank_metrics("rranked"))
VIEWS["rstab"] = (
    ("rranked",),
    f"""SELECT {_K}, {s_round4('CASE WHEN n < 2 THEN 1::DOUBLE ELSE 1::DOUBLE - 6::DOUBLE * d2 / (n::DOUBLE * (n::DOUBLE * n::DOUBLE - 1::DOUBLE)) END')} AS spearman, {s_round4('both_k / (least(3, n) * 2 - both_k)')} AS jaccard
    FROM (SELECT {_K}, count(*) AS n, sum((rank - base) * (rank - base))::DOUBLE AS d2, count(*) FILTER (rank <= 3 AND base <= 3) AS both_k FROM (SELECT *, max(rank) FILTER (variant = 'baseline')
    OVER (PARTITION BY source_id, keyword, country, candidate_id) AS base FROM rranked) GROUP BY {_K})""",
)


def relevance_rows(spark, sf):
    customers = V.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    key = F.col("o_orderkey")
    return V.table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_id"),
        F.col("c_mktsegment").alias("keyword"),
        F.when(key % 2 == 0, "KR").otherwise("US").alias("country"),
        key.alias("candidate_id"),
        (key * 7 % 4).cast("int").alias("relevance"),
        (key % 4).alias("issue_overlap_count"),
        ((F.col("o_custkey") + key) % 5).alias("shared_keyword_count"),
        (F.floor(key / 4) % 3).alias("shared_entity_count"),
        ((key % 101) / 100.0).alias("semantic_similarity"),
        (F.col("o_orderstatus") == "F").alias("analysis_success"),
        (F.col("o_totalprice") / 1000000.0).alias("view_score"),
        F.lit(True).alias("published_at"),
    )


@query(
    "relevance_variants",
    with_views(
        "rscored",
        f"SELECT variant, {', '.join(f'w{i + 1} AS {n}' for i, n in enumerate(RELEVANCE))}, count(*) AS candidates, {s_round4('max(score)')} AS best_score FROM rscored GROUP BY ALL",
    ),
)
def relevance_variants(spark, sf):
    names = list(RELEVANCE)
    table = spark.createDataFrame([(n, *map(float, v)) for n, v in VARIANTS.items()], ["variant", *names])
    best = E.variant_scores(relevance_rows(spark, sf), VARIANTS).groupBy("variant").agg(
        F.count(F.lit(1)).alias("candidates"), round4(F.max("score")).alias("best_score")
    )
    return best.join(F.broadcast(table), "variant").select("variant", *names, "candidates", "best_score")


@query("ndcg_metrics", with_views("rmetrics", "SELECT source_id, keyword, country, ndcg, recall, mrr, top_relevant FROM rmetrics WHERE variant = 'baseline'"))
def ndcg_metrics(spark, sf):
    scored = E.variant_scores(relevance_rows(spark, sf), {"baseline": VARIANTS["baseline"]})
    return E.ranking_metrics(scored).drop("variant")


@query(
    "relevance_sweep",
    with_views(
        "rmetrics rstab",
        "SELECT variant, count(*) AS groups, "
        + ", ".join(f"{s_round4(f'sum({c}::DECIMAL(20,4))::DOUBLE / count(*)')} AS mean_{c}" for c in ("ndcg", "recall", "mrr", "top_relevant", "jaccard", "spearman"))
        + f" FROM rmetrics JOIN rstab USING ({_K}) GROUP BY 1",
    ),
)
def relevance_sweep(spark, sf):
    return E.sweep_means(relevance_rows(spark, sf), VARIANTS)
