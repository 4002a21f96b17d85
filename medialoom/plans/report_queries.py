"""Country report and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialoom.functions.columns import round4
from medialoom.operators import country as C
from medialoom.operators import graph as P
from medialoom.operators import quality as Q
from medialoom.plans.graph_queries import Graph
from medialoom.plans.registry import query
from medialoom.plans.sqlviews import VIEWS, s_round4, with_views
from medialoom.session import materialize
from medialoom.sources import views as V

COUNTRIES = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]
ISSUES = ["Brand#12", "ring", "URGENT"]
FROM, TO = "1996-01-01", "2000-12-31"

_M = ", ".join(
    f"CASE WHEN contains(lower(title), '{i.lower()}') OR len(list_filter(keywords, lambda k: contains(lower(k), '{i.lower()}'))) > 0 THEN '{i}' END" for i in ISSUES
)
VIEWS["records"] = (
    ("ctx",),
    f"""SELECT * FROM (SELECT *, list_filter([{_M}], lambda x: x IS NOT NULL) AS issues FROM ctx WHERE country IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')
    AND published_at BETWEEN '{FROM}' AND '{TO}' AND view_count >= 0 AND coalesce(status, 'SUCCESS') <> 'FAILED') WHERE len(issues) > 0""",
)
VIEWS["irows"] = (("records",), "SELECT *, unnest(issues) AS issue FROM records")
VIEWS["chviews"] = (
    ("irows",),
    "SELECT issue, country, coalesce(channel, 'UNKNOWN_CHANNEL') AS channel, sum(view_count::DECIMAL(24,2)) AS views FROM irows GROUP BY 1, 2, 3",
)


def _round2(e):
    return f"(floor(({e}) * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE)"


_KPI = f"""SELECT issue, country, count(*) AS video_count, sum(view_count::DECIMAL(24,2))::DOUBLE AS total_views,
{_round2('sum(view_count::DECIMAL(24,2))::DOUBLE / count(*)')} AS avg_views,
{s_round4('sum(coalesce(bias_score, 0)::DECIMAL(24,4))::DOUBLE / count(*)')} AS avg_bias_score FROM irows GROUP BY 1, 2"""


def records(spark, sf):
    return C.issue_records(Graph(spark, sf).context(), COUNTRIES, ISSUES, FROM, TO)


def rows(spark, sf):
    return C.by_issue(records(spark, sf))


@query("issue_records", with_views("irows", "SELECT video_id, issue, country, published_at, view_count FROM irows"))
def issue_records(spark, sf):
    return rows(spark, sf).select("video_id", "issue", "country", "published_at", "view_count")


def _sample_sql(size):
    quota = size // len(ISSUES)
    ctes, parts = [], []
    for n, issue in enumerate(ISSUES):
        earlier = " ".join(f"AND video_id NOT IN (SELECT video_id FROM p{m})" for m in range(n))
        ctes.append(
            f"p{n} AS (SELECT video_id, '{issue}' AS picked_for FROM records WHERE list_contains(issues, '{issue}') {earlier} ORDER BY published_at DESC, video_id DESC LIMIT {quota})"
        )
        parts.append(f"SELECT * FROM p{n}")
    picked = " UNION ALL ".join(parts)
    return f"""WITH {', '.join(ctes)}, pk AS ({picked}), rest AS (SELECT video_id, 'top-up' AS picked_for, row_number() OVER (ORDER BY published_at DESC, video_id DESC) AS rn
    FROM records WHERE video_id NOT IN (SELECT video_id FROM pk)) SELECT * FROM pk UNION ALL SELECT video_id, picked_for FROM rest WHERE rn <= {size} - (SELECT count(*) FROM pk)"""


@query("issue_balanced_sample", with_views("records", _sample_sql(200)))
def issue_balanced_sample(spark, sf):
    return C.balanced_sample(records(spark, sf), ISSUES, 200)


@query("country_issue_kpi", with_views("irows", _KPI))
def country_issue_kpi(spark, sf):
    return C.country_issue_kpi(rows(spark, sf))


@query(
    "tone_distribution",
    with_views(
        "irows",
        """SELECT issue, country, tone_label, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY issue, country ORDER BY n DESC, tone_label) AS rank
        FROM (SELECT issue, country, upper(tone) AS tone_label, count(*) AS n FROM irows GROUP BY 1, 2, 3)) WHERE rank <= 3""",
    ),
)
def tone_distribution(spark, sf):
    return C.tone_distribution(rows(spark, sf), 3)


@query(
    "channel_share",
    with_views(
        "chviews",
        f"""WITH r AS (SELECT *, sum(views) OVER (PARTITION BY issue, country) AS total, row_number() OVER (PARTITION BY issue, country ORDER BY views DESC, channel) AS rank FROM chviews),
        t AS (SELECT issue, country, {s_round4('sum(views)::DOUBLE / max(total)::DOUBLE')} AS top_channel_share FROM r WHERE rank <= 3 GROUP BY 1, 2)
        SELECT issue, country, rank::INT AS rank, channel, views::DOUBLE AS views, top_channel_share FROM r JOIN t USING (issue, country) WHERE rank <= 5""",
    ),
)
def channel_share(spark, sf):
    return C.channel_share(rows(spark, sf), 5)


@query(
    "country_ranking",
    with_views("irows", f"SELECT issue, row_number() OVER (PARTITION BY issue ORDER BY total_views DESC, country)::INT AS rank, country, total_views, video_count FROM ({_KPI})"),
)
def country_ranking(spark, sf):
    return C.country_ranking(rows(spark, sf))


@query(
    "channel_centrality",
    with_views(
        "chviews",
        """SELECT issue, country, rank::INT AS rank, channel, views::DOUBLE AS centrality_score, community_size FROM (SELECT *, count(*) OVER (PARTITION BY issue, country) AS community_size,
        row_number() OVER (PARTITION BY issue, country ORDER BY views DESC, channel) AS rank FROM chviews) WHERE rank <= 5""",
    ),
)
def channel_centrality(spark, sf):
    return C.channel_centrality(rows(spark, sf), 5)


@query(
    "bridge_channels",
    with_views(
        "chviews",
        f"""SELECT issue, channel, count(*) AS country_count, string_agg(country, ',' ORDER BY country) AS countries, {_round2('(sum(views) * count(*))::DOUBLE')} AS bridge_score
        FROM chviews GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY bridge_score DESC, issue, channel LIMIT 20""",
    ),
)
def bridge_channels(spark, sf):
    return C.bridge_channels(rows(spark, sf), 20)


_EXPECTED = "SELECT o_orderkey::VARCHAR AS video_id, CASE WHEN o_custkey % 4 = 0 THEN 'HIGH' ELSE substr(o_orderpriority, 3) END AS expected_tone FROM orders"
_ACC = f"""SELECT count(*) AS total, count(*) FILTER (upper(tone) = upper(expected_tone)) AS matched,
{s_round4("count(*) FILTER (upper(tone) = upper(expected_tone))::DOUBLE / nullif(count(*), 0)")} AS accuracy FROM records JOIN ({_EXPECTED}) USING (video_id)"""


def expected_tones(spark, sf):
    tone = F.when(F.col("o_custkey") % 4 == 0, "HIGH").otherwise(F.substring("o_orderpriority", 3, 20))
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("video_id"), tone.alias("expected_tone"))


@query("validation_accuracy", with_views("records", _ACC))
def validation_accuracy(spark, sf):
    return C.validation_accuracy(records(spark, sf), expected_tones(spark, sf))


@query("reproducible", "SELECT 0::BIGINT AS only_first, 0::BIGINT AS only_second, TRUE AS reproducible")
def reproducible(spark, sf):
    return C.same_rows(C.country_issue_kpi(rows(spark, sf)), C.country_issue_kpi(rows(spark, sf)))


_CARD = f"""WITH a AS ({_ACC}), m AS (SELECT * FROM (VALUES ('rule_based', 4.5::DOUBLE, 4.5::DOUBLE, 4.6::DOUBLE), ('graph_based', 3.8::DOUBLE, 3.5::DOUBLE, 3.6::DOUBLE))
t(approach, interpretability, runtime, ops_cost)), x AS (SELECT m.*, 5::DOUBLE AS reproducibility, CASE WHEN approach = 'rule_based' THEN {_round2('accuracy * 5::DOUBLE')}
ELSE greatest(0::DOUBLE, {_round2(_round2('accuracy * 5::DOUBLE') + ' - 0.2::DOUBLE')}) END AS accuracy FROM m, a),
y AS (SELECT *, floor((0::DOUBLE + accuracy * 0.4::DOUBLE + interpretability * 0.25::DOUBLE + runtime * 0.15::DOUBLE + reproducibility * 0.1::DOUBLE + ops_cost * 0.1::DOUBLE) * 1000::DOUBLE + 0.5::DOUBLE) / 1000::DOUBLE AS total FROM x),
z AS (SELECT *, row_number() OVER (ORDER BY total DESC, approach)::INT AS place FROM y) SELECT *, CASE WHEN place > 1 THEN 'not_selected' WHEN accuracy >= 3.5 AND interpretability >= 3.5 THEN 'adopted' ELSE 'needs_poc' END AS status FROM z"""


@query("approach_scorecard", with_views("records", _CARD))
def approach_scorecard(spark, sf):
    """The first run's records are written once; the second run, which must agree with it, starts from the tables again."""
    first = materialize(records(spark, sf).select("video_id", "country", "tone", "view_count", "bias_score", "issues"), "records")
    same = C.same_rows(C.country_issue_kpi(C.by_issue(first)), C.country_issue_kpi(rows(spark, sf)))
    return C.scorecard(C.validation_accuracy(first, expected_tones(spark, sf)), same, first)


@query(
    "validation_template",
    with_views("records", "SELECT video_id, issues[1] AS issue, country, title, '' AS expected_tone FROM records ORDER BY published_at DESC, video_id DESC LIMIT 50"),
)
def validation_template(spark, sf):
    return C.validation_template(records(spark, sf), 50)


# --- data quality ------------------------------------------------------------------------------------

ISSUE_ID, ISSUE_NAME = "demo", "Demo issue"
VIEWS["curation"] = (
    (),
    """SELECT c_custkey + 2 AS row_number, CASE WHEN c_nationkey = 7 THEN 'other' ELSE 'demo' END AS issue_id, CASE WHEN c_nationkey = 8 THEN 'Else' ELSE 'Demo issue' END AS issue_name,
    CASE c_mktsegment WHEN 'FURNITURE' THEN 'KR' WHEN 'MACHINERY' THEN 'US' WHEN 'BUILDING' THEN 'CN' WHEN 'AUTOMOBILE' THEN 'JP' ELSE ' kr ' END AS country_code,
    CASE c_mktsegment WHEN 'FURNITURE' THEN 'ko' WHEN 'MACHINERY' THEN 'EN' WHEN 'BUILDING' THEN 'en' WHEN 'AUTOMOBILE' THEN 'ja' ELSE 'ko' END AS language,
    'y' || (c_custkey // 2)::VARCHAR AS youtube_video_id, CASE WHEN c_nationkey = 3 THEN ' ' ELSE c_name END AS title, c_name AS channel_name,
    CASE WHEN c_nationkey < 12 THEN 'c0' WHEN c_nationkey = 13 THEN '' ELSE 'c' || c_nationkey::VARCHAR END AS channel_id,
    CASE c_nationkey % 4 WHEN 0 THEN 'yesterday' WHEN 1 THEN '' WHEN 2 THEN '2026-01-' || lpad((c_nationkey + 1)::VARCHAR, 2, '0') || 'T03:04:05Z' ELSE '2026-02-' || lpad((c_nationkey + 1)::VARCHAR, 2, '0') END AS published_at,
    'x' AS curation_reason, CASE WHEN c_acctbal < 0 THEN '1' ELSE '' END AS backup_rank FROM customer""",
)


def curation(spark, sf):
    nation, seg = F.col("c_nationkey"), F.col("c_mktsegment")
    day = F.lpad((nation + 1).cast("string"), 2, "0")
    return V.table(spark, sf, "customer").select(
        (F.col("c_custkey") + 2).alias("row_number"),
        F.when(nation == 7, "other").otherwise("demo").alias("issue_id"),
        F.when(nation == 8, "Else").otherwise("Demo issue").alias("issue_name"),
        F.when(seg == "FURNITURE", "KR").when(seg == "MACHINERY", "US").when(seg == "BUILDING", "CN").when(seg == "AUTOMOBILE", "JP").otherwise(" kr ").alias("country_code"),
        F.when(seg == "FURNITURE", "ko").when(seg == "MACHINERY", "EN").when(seg == "BUILDING", "en").when(seg == "AUTOMOBILE", "ja").otherwise("ko").alias("language"),
        F.concat(F.lit("y"), F.floor(F.col("c_custkey") / 2).cast("string")).alias("youtube_video_id"),
        F.when(nation == 3, " ").otherwise(F.col("c_name")).alias("title"),
        F.col("c_name").alias("channel_name"),
        F.when(nation < 12, "c0").when(nation == 13, "").otherwise(F.concat(F.lit("c"), nation.cast("string"))).alias("channel_id"),
        F.when(nation % 4 == 0, "yesterday").when(nation % 4 == 1, "").when(nation % 4 == 2, F.concat(F.lit("2026-01-"), day, F.lit("T03:04:05Z"))).otherwise(F.concat(F.lit("2026-02-"), day)).alias("published_at"),
        F.lit("x").alias("curation_reason"),
        F.when(F.col("c_acctbal") < 0, "1").otherwise("").alias("backup_rank"),
    )


_CELLS = " UNION ALL ".join(f"SELECT row_number, '{c}' AS column_name FROM curation WHERE trim({c}) = ''" for c in Q.REQUIRED)
_RULES = """SELECT row_number, 'issue_id' AS rule, 'error' AS severity FROM curation WHERE issue_id <> 'demo'
UNION ALL SELECT row_number, 'issue_name', 'warning' FROM curation WHERE issue_name <> 'Demo issue'
UNION ALL SELECT row_number, 'country_code', 'error' FROM curation WHERE upper(trim(country_code)) NOT IN ('KR', 'US', 'CN')
UNION ALL SELECT row_number, 'language', 'error' FROM curation WHERE (upper(trim(country_code)), lower(language)) IN (('CN', 'en'))
UNION ALL SELECT row_number, 'published_at', 'error' FROM curation WHERE published_at = 'yesterday'"""
_DUPS = "SELECT row_number, youtube_video_id AS key FROM (SELECT *, row_number() OVER (PARTITION BY youtube_video_id ORDER BY row_number) AS rn FROM curation) WHERE rn > 1"


@query("dq_required", with_views("curation", _CELLS))
def dq_required(spark, sf):
    return Q.required_cells(curation(spark, sf))


@query("dq_rules", with_views("curation", _RULES))
def dq_rules(spark, sf):
    return Q.row_rules(curation(spark, sf), ISSUE_ID, ISSUE_NAME)


@query("dq_duplicates", with_views("curation", _DUPS))
def dq_duplicates(spark, sf):
    return Q.duplicate_keys(curation(spark, sf), "youtube_video_id")


@query(
    "dq_country_counts",
    with_views(
        "curation",
        """SELECT e.country, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) < 10 THEN 'error: too few' WHEN n > 15 THEN 'error: too many' ELSE 'ok' END AS finding
        FROM (VALUES ('KR'), ('US'), ('CN')) e(country) LEFT JOIN (SELECT upper(trim(country_code)) AS country, count(*) AS n FROM curation GROUP BY 1) USING (country)""",
    ),
)
def dq_country_counts(spark, sf):
    return Q.country_counts(curation(spark, sf))


@query(
    "dq_channel_dominance",
    with_views(
        "curation",
        f"""SELECT country, n, top1_share, n >= 10 AND top1_share > 0.4::DOUBLE AS dominated FROM (SELECT country, sum(n)::BIGINT AS n,
        {s_round4("max(n) FILTER (channel_id <> '')::DOUBLE / sum(n)::DOUBLE")} AS top1_share FROM (SELECT upper(trim(country_code)) AS country, channel_id, count(*) AS n
        FROM curation GROUP BY 1, 2) WHERE country IN ('KR', 'US', 'CN') GROUP BY 1)""",
    ),
)
def dq_channel_dominance(spark, sf):
    return Q.channel_dominance(curation(spark, sf))


@query(
    "dq_summary",
    with_views(
        "curation",
        f"""WITH f AS (SELECT 'error' AS severity FROM ({_CELLS}) UNION ALL SELECT severity FROM ({_RULES}) UNION ALL SELECT 'error' FROM ({_DUPS})),
        d AS (SELECT try_cast(left(published_at, 10) AS DATE) AS d FROM curation)
        SELECT count(*) AS row_count, count(*) FILTER (backup_rank <> '') AS backup_count, (SELECT min(d) FROM d)::VARCHAR AS period_from, (SELECT max(d) FROM d)::VARCHAR AS period_to,
        (SELECT count(*) FROM f WHERE severity = 'error') AS errors, (SELECT count(*) FROM f WHERE severity = 'warning') AS warnings, (SELECT count(*) FROM f WHERE severity = 'error') = 0 AS ok FROM curation""",
    ),
)
def dq_summary(spark, sf):
    data = curation(spark, sf)
    return Q.summary(data, Q.required_cells(data), Q.row_rules(data, ISSUE_ID, ISSUE_NAME), Q.duplicate_keys(data, "youtube_video_id"))


_NODES = """SELECT 'Video' AS label, video_id AS key FROM videos UNION ALL SELECT 'Channel', channel FROM videos WHERE channel IS NOT NULL
UNION ALL SELECT 'Issue', p_brand FROM part UNION ALL SELECT 'Entity', p_type FROM part"""


def node_keys(spark, sf):
    videos, parts = V.videos(spark, sf), V.table(spark, sf, "part")
    pick = lambda df, label, c: df.select(F.lit(label).alias("label"), F.col(c).alias("key"))
    return (
        pick(videos, "Video", "video_id")
        .unionByName(pick(videos.filter("channel IS NOT NULL"), "Channel", "channel"))
        .unionByName(pick(parts, "Issue", "p_brand"))
        .unionByName(pick(parts, "Entity", "p_type"))
    )


@query("dq_unique_keys", with_views("videos", f"SELECT label, key, count(*) AS n FROM ({_NODES}) GROUP BY 1, 2 HAVING count(*) > 1"))
def dq_unique_keys(spark, sf):
    return Q.duplicate_nodes(node_keys(spark, sf))


@query(
    "dq_graph",
    with_views(
        "fdirect videos",
        """WITH w AS (SELECT v.video_id AS source_id, c.country FROM videos v JOIN (SELECT DISTINCT country FROM videos) c ON c.country <> v.country),
        s AS (SELECT w.*, coalesce(n, 0) AS n FROM w LEFT JOIN (SELECT source_id, country, count(*) AS n FROM fdirect WHERE NOT dropped GROUP BY 1, 2) USING (source_id, country)),
        p AS (SELECT source_id, sum(n) AS edges, count(*) FILTER (n < 3) AS short FROM s GROUP BY 1)
        SELECT 'source_country_leaked' AS "check", 0::BIGINT AS violations UNION ALL SELECT 'related_shortage', sum(short)::BIGINT FROM p
        UNION ALL SELECT 'edge_shortage', count(*) FILTER (edges < 10) FROM p UNION ALL SELECT 'edge_field_missing', 0::BIGINT""",
    ),
)
def dq_graph(spark, sf):
    ctx, pairs = Graph(spark, sf).related()
    ranked = P.rank_related(pairs, 5)
    edges = ranked.select(
        "source_id", "source_country", "country", F.col("relevance").alias("weight"),
        round4(F.col("similarity")).alias("similarity_score"), P.relation_type().alias("relation_type"),
    )
    return Q.graph_checks(edges, ctx, min_per_country=3, min_edges=10)
