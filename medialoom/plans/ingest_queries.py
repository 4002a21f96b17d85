"""File, log, vector-table, ingest and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialoom.functions.columns import round4
from medialoom.functions.vectors import unit
from medialoom.operators import ingest as I
from medialoom.plans.registry import query
from medialoom.plans.sqlviews import VIEWS, s_clean_list, s_round4, with_views
from medialoom.session import scratch_path
from medialoom.sources import files as R
from medialoom.sources import views as V
from medialoom.streaming import streams as X

PER_COUNTRY = 2

# --- files -------------------------------------------------------------------------------------------


@query("scan_csv_trimmed", "SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def scan_csv_trimmed(spark, sf):
    pad = lambda c: F.concat(F.lit(" \t"), F.col(c).cast("string"), F.lit("  "))
    rows = V.table(spark, sf, "customer").select(pad("c_custkey").alias("id"), pad("c_name").alias("name"), pad("c_mktsegment").alias("segment"))
    path = scratch_path(spark, "csv")
    rows.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return R.read_csv_trimmed(spark, path, ["id", "name", "segment"])


def _jsonl(spark, rows, name):
    path = scratch_path(spark, name)
    rows.write.text(path)
    return path


@query("scan_jsonl_tolerant", "SELECT 'v' || (props->>'$.k') AS video_id, event_id, value FROM events WHERE event_type NOT IN ('error', 'view')")
def scan_jsonl_tolerant(spark, sf):
    """Error events become broken lines and views lose their id; both must be dropped."""
    good = F.to_json(F.struct(F.when(F.col("event_type") == "view", " ").otherwise(V.video_key(F.col("props"))).alias("video_id"), "event_id", "value"))
    lines = V.events(spark, sf).select(F.when(F.col("event_type") == "error", F.concat(F.lit('{"video_id": '), F.col("event_id").cast("string"))).otherwise(good).alias("value"))
    return R.read_jsonl_tolerant(spark, _jsonl(spark, lines, "jsonl"), "video_id string, event_id bigint, value double", "video_id")


@query(
    "scan_jsonl_strict",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'sentence_text' WHEN 'view' THEN 'gold' WHEN 'click' THEN 'missing gold' ELSE CASE WHEN event_id % 5 = 4 THEN 'relevance' END END AS reject_reason FROM events""",
)
def scan_jsonl_strict(spark, sf):
    kind = F.col("event_type")
    row = F.struct(
        "event_id",
        F.when(kind == "error", "  ").otherwise(kind).alias("sentence_text"),
        F.when(kind == "view", "maybe").when(kind != "click", " Yes").alias("gold"),
        (F.col("event_id") % 5).cast("string").alias("relevance"),
    )
    path = _jsonl(spark, V.events(spark, sf).select(F.to_json(row).alias("value")), "strict")
    schema = "event_id bigint, sentence_text string, gold string, relevance string"
    return R.read_jsonl_strict(spark, path, schema, fail=False).select("event_id", "reject_reason")


@query("scan_json_array", "SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations")
def scan_json_array(spark, sf):
    """Each conversation is written as one array of turns."""
    turn = F.struct("conv_id", "turn", "role", "text")
    rows = V.turns(spark, sf).groupBy("conv_id").agg(F.to_json(F.collect_list(turn)).alias("value")).select("value")
    path = _jsonl(spark, rows, "arrays")
    out = R.read_json_array(spark, path, "conv_id bigint, turn bigint, role string, text string", whole_file=False)
    return out.select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n_chars"))


@query("scan_jsonl_dir", "SELECT lang, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def scan_jsonl_dir(spark, sf):
    path = scratch_path(spark, "corpus")
    V.table(spark, sf, "documents").select("doc_id", "lang", "n_chars").repartition(4).write.json(path)
    rows = R.read_jsonl_dir(spark, path, "doc_id bigint, lang string, n_chars bigint")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))


@query("sink_jsonl", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY 1")
def sink_jsonl(spark, sf):
    """Overwritten once and appended once, so every row must be there twice."""
    rows = V.events(spark, sf).select("event_id", "event_type")
    path = scratch_path(spark, "sink")
    R.write_jsonl(rows, path, append=False)
    R.write_jsonl(rows, path)
    back = spark.read.schema("event_id bigint, event_type string").json(path)
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# --- logs and vectors --------------------------------------------------------------------------------


@query(
    "log_recent_export",
    """SELECT id, source_endpoint, target_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, 2 AS n_sentences FROM (SELECT event_id AS id, event_type AS source_endpoint, user_id AS target_id, ts FROM events
    WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY ORDER BY ts DESC, event_id DESC LIMIT 1000)""",
)
def log_recent_export(spark, sf):
    events = V.events(spark, sf)
    log = events.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("source_endpoint"), F.col("user_id").alias("target_id"),
        F.col("ts").alias("created_at"), F.to_json(F.array(F.col("event_type"), F.lit(" "), F.col("props"))).alias("sentences_json"),
    )
    newest = events.agg(F.max("ts").alias("_newest"))
    rows = log.join(F.broadcast(newest))
    out = R.recent_requests(rows, F.col("_newest") - F.expr("INTERVAL 7 DAYS"), 1000)
    return out.select("id", "source_endpoint", "target_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.size("sentences").alias("n_sentences"))


@query(
    "log_payload",
    f"""SELECT doc_id AS target_id, language, len(l)::INT AS sentence_count, to_json(l)::VARCHAR AS sentences_json FROM (SELECT doc_id, lang AS language, {s_clean_list("string_split(text, chr(10))")} AS l FROM documents)""",
)
def log_payload(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("target_id"), F.col("lang").alias("language"), F.split("text", "\n").alias("sentences"))
    return R.request_payload(docs, "sentences")


@query(
    "vector_normalize",
    f"""SELECT vec_id, len(u) AS width, {s_round4('u[1]')} AS first_value, {s_round4('u[len(u)]')} AS last_value, {s_round4('list_sum(u)')} AS total FROM (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u
    FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3::DOUBLE) AS e FROM embeddings))""",
)
def vector_normalize(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * 3.0)
    rows = V.table(spark, sf, "embeddings").select("vec_id", unit(scaled).alias("u"))
    total = F.aggregate("u", F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "vec_id", F.size("u").cast("bigint").alias("width"), round4(F.get("u", F.lit(0))).alias("first_value"),
        round4(F.get("u", F.size("u") - 1)).alias("last_value"), round4(total).alias("total"),
    )


@query("vector_table_stats", "SELECT count(*) AS rows, min(len(embedding))::INT AS min_width, max(len(embedding))::INT AS max_width, min(vec_id) AS sample_id FROM embeddings")
def vector_table_stats(spark, sf):
    rows = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return R.vector_table_stats(R.vector_table(rows, scratch_path(spark, "vectors")))


@query(
    "sync_analysis",
    with_views(
        "videos",
        """SELECT video_id, target_id, CASE WHEN opinion_score IS NOT NULL AND coalesce(status, 'SUCCESS') = 'SUCCESS' THEN opinion_score END AS opinion_score,
        CASE WHEN opinion_score IS NOT NULL AND coalesce(status, 'SUCCESS') = 'SUCCESS' THEN 'synced' ELSE 'missing' END AS state FROM videos""",
    ),
)
def sync_analysis(spark, sf):
    videos = V.videos(spark, sf)
    done = videos.filter((F.coalesce("status", F.lit("SUCCESS")) == "SUCCESS") & F.col("opinion_score").isNotNull())
    results = done.select("target_id", F.lit("VIDEO").alias("target_type"), F.col("bias_score").alias("overall_bias_score"), "opinion_score")
    return R.sync_analysis(videos, results).select("video_id", "target_id", "opinion_score", "state")


@query(
    "graph_stats",
    with_views(
        "videos part_of has_entity",
        """SELECT 'node' AS kind, 'Video' AS name, count(*) AS n FROM videos UNION ALL SELECT 'node', 'Issue', count(DISTINCT issue_id) FROM part_of UNION ALL SELECT 'node', 'Entity', count(DISTINCT entity_key) FROM has_entity
        UNION ALL SELECT 'edge', 'PART_OF', count(*) FROM part_of UNION ALL SELECT 'edge', 'HAS_ENTITY', count(*) FROM has_entity UNION ALL SELECT 'edge', 'PUBLISHED_BY', count(channel) FROM videos""",
    ),
)
def graph_stats(spark, sf):
    lines, videos = V.video_lines(spark, sf), V.videos(spark, sf)
    issues, entities = V.part_of(lines), V.has_entity(lines)
    label = lambda df, name: df.select(F.lit(name).alias("label"))
    rel = lambda df, name: df.select(F.lit(name).alias("rel_type"))
    nodes = label(videos, "Video").unionByName(label(issues.select("issue_id").distinct(), "Issue")).unionByName(label(entities.select("entity_key").distinct(), "Entity"))
    edges = rel(issues, "PART_OF").unionByName(rel(entities, "HAS_ENTITY")).unionByName(rel(videos.filter("channel IS NOT NULL"), "PUBLISHED_BY"))
    return R.graph_stats(nodes, edges)


# --- ingest ------------------------------------------------------------------------------------------

VIEWS["cand"] = (
    ("candidates",),
    "SELECT request_id, seq, video_id, trim(title) AS title, upper(trim(country_code)) AS country_code, lower(trim(language)) AS language, view_count, event_type FROM candidates WHERE view_count >= 0",
)
VIEWS["existing"] = ((), "SELECT DISTINCT 'v' || (props->>'$.k') AS video_id FROM events WHERE event_type = 'purchase' AND user_id % 7 = 0")
VIEWS["selected"] = (
    ("cand",),
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, country_code ORDER BY seq) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY request_id, video_id ORDER BY seq) AS first
    FROM cand) WHERE first = 1) WHERE rn <= 2""",
)


def candidates(spark, sf):
    rows = I.normalize_candidates(V.candidates(spark, sf)).filter(F.col("reject_reason").isNull())
    return rows.drop("reject_reason", "ts")


def existing(spark, sf):
    done = V.events(spark, sf).filter((F.col("event_type") == "purchase") & (F.col("user_id") % 7 == 0))
    return done.select(V.video_key(F.col("props")).alias("video_id"))


def selected(spark, sf):
    """Selected candidates of requests of any size; the bound of the service's contract is none of the stored events."""
    return I.mark_existing(I.select_candidates(candidates(spark, sf), PER_COUNTRY, most=None), existing(spark, sf))


@query(
    "ingest_candidates",
    with_views("selected existing", "SELECT request_id, seq, video_id, country_code, language, video_id IN (SELECT video_id FROM existing) AS skipped FROM selected"),
)
def ingest_candidates(spark, sf):
    return selected(spark, sf).select("request_id", "seq", "video_id", "country_code", "language", "skipped")


@query(
    "ingest_clicked",
    with_views(
        "cand",
        """WITH sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY seq) AS rn FROM cand WHERE event_type = 'click') WHERE rn = 1),
        rel AS (SELECT c.* FROM cand c JOIN sel s ON s.request_id = c.request_id AND s.video_id <> c.video_id), pick AS (SELECT *, row_number() OVER (PARTITION BY request_id, country_code ORDER BY seq) AS rn FROM (
        SELECT *, row_number() OVER (PARTITION BY request_id, video_id ORDER BY seq) AS first FROM rel) WHERE first = 1)
        SELECT request_id, 0 AS priority, seq, video_id, country_code FROM sel UNION ALL SELECT request_id, 1, seq, video_id, country_code FROM pick WHERE rn <= 2""",
    ),
)
def ingest_clicked(spark, sf):
    rows = candidates(spark, sf)
    clicked = I.first_per_key(rows.filter(F.col("event_type") == "click"), ["request_id"], ["seq"])
    return I.clicked_first(rows, clicked, PER_COUNTRY).select("request_id", "priority", "seq", "video_id", "country_code")


VIEWS["transcripts"] = ((), "SELECT 'v' || doc_id::VARCHAR AS video_id, CASE WHEN lang = 'es' THEN ' ' ELSE text END AS transcript, source FROM documents")
VIEWS["outcomes"] = (
    ("selected", "existing", "transcripts"),
    """SELECT s.*, t.transcript, t.source, CASE WHEN s.video_id IN (SELECT video_id FROM existing) THEN 'skipped' WHEN coalesce(trim(transcript), '') = '' THEN 'failed' ELSE 'success' END AS outcome FROM selected s LEFT JOIN transcripts t USING (video_id)""",
)


def transcripts(spark, sf):
    return V.table(spark, sf, "documents").select(
        F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("video_id"), F.when(F.col("lang") == "es", " ").otherwise(F.col("text")).alias("transcript"), "source"
    )


def outcome_rows(spark, sf):
    return I.outcomes(selected(spark, sf), transcripts(spark, sf))


@query("ingest_outcomes", with_views("outcomes", "SELECT request_id, seq, video_id, outcome FROM outcomes"))
def ingest_outcomes(spark, sf):
    return outcome_rows(spark, sf).select("request_id", "seq", "video_id", "outcome")


_COUNTS = "count(*) FILTER (outcome = 'queued') AS queued_count, count(*) FILTER (outcome = 'success') AS success_count, count(*) FILTER (outcome = 'failed') AS failed_count, count(*) FILTER (outcome = 'skipped') AS skipped_count"
_STATUS = "CASE WHEN queued_count > 0 AND success_count + failed_count = 0 THEN 'QUEUED' WHEN queued_count > 0 THEN 'RUNNING' WHEN failed_count > 0 THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END AS status"
_EVENT_OUTCOME = "CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'queued' END AS outcome"
_JOBS = f"SELECT *, {_STATUS} FROM (SELECT request_id, {_COUNTS} FROM (SELECT 'rt-' || user_id::VARCHAR || '-' || strftime(ts, '%Y%m%d') AS request_id, {_EVENT_OUTCOME} FROM events) GROUP BY 1)"


def event_outcomes(events, span="yyyyMMdd", *keep):
    kind = F.col("event_type")
    outcome = F.when(kind == "purchase", "success").when(kind == "error", "failed").when(kind == "view", "skipped").otherwise("queued")
    request = F.concat_ws("-", F.lit("rt"), F.col("user_id").cast("string"), F.date_format("ts", span))
    return events.select(*keep, request.alias("request_id"), outcome.alias("outcome"))


@query("ingest_jobs", _JOBS)
def ingest_jobs(spark, sf):
    return I.job_counts(event_outcomes(V.events(spark, sf))).withColumn("status", I.job_status())


@query(
    "graph_rows",
    with_views(
        "outcomes",
        """SELECT request_id, video_id, ('0x' || substr(sha256(video_id), 1, 15))::BIGINT AS target_id, title, substr(transcript, 1, 500) AS description, country_code, language, view_count, 'runtime:' || video_id AS channel_id,
        source AS channel_name, 'search:' || title || '-news' AS issue_id, 'runtime:' || video_id || ':' || ('0x' || substr(sha256(video_id), 1, 15))::BIGINT::VARCHAR AS analysis_id, title || '|' || source AS analysis_keywords
        FROM outcomes WHERE outcome = 'success'""",
    ),
)
def graph_rows(spark, sf):
    rows = outcome_rows(spark, sf).filter(F.col("outcome") == "success").withColumns(
        {
            "description": F.lit(" "),
            "channel_id": F.lit(None).cast("string"),
            "channel_name": F.col("source"),
            "keywords": F.array(F.col("title"), F.lit(" "), F.upper("title")),
            "focus_keywords": F.array(F.col("source"), F.col("title")),
        }
    )
    out = I.graph_rows(rows, F.concat(F.lit(" "), "title", F.lit(" / NEWS! ")), keep=["request_id"])
    return out.withColumn("analysis_keywords", F.array_join("analysis_keywords", "|"))


@query(
    "upsert_latest",
    "SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value, arg_max(event_id, ts) AS event_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created_at FROM events GROUP BY 1",
)
def upsert_latest(spark, sf):
    versions = V.events(spark, sf).select("user_id", "event_type", "value", "event_id", "ts")
    out = I.latest_rows(versions, ["user_id"], ["ts", "event_id"], "ts")
    return out.select("user_id", "event_type", "value", "event_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query(
    "skip_processed",
    """SELECT user_id, seq FROM (SELECT user_id, min(event_id) AS seq FROM events WHERE event_type = 'purchase' GROUP BY 1) WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error'
    AND ts < TIMESTAMP '2024-01-03')""",
)
def skip_processed(spark, sf):
    events = V.events(spark, sf)
    incoming = events.filter(F.col("event_type") == "purchase").select("user_id", F.col("event_id").alias("seq"))
    processed = events.filter((F.col("event_type") == "error") & (F.col("ts") < F.lit("2024-01-03").cast("timestamp"))).select("user_id")
    return I.unprocessed(incoming, processed, "user_id").select("user_id", "seq")


@query(
    "stage_errors",
    with_views(
        "outcomes",
        """SELECT stage, count(error) AS errors, count(*) - count(error) AS successes FROM (SELECT 'transcript' AS stage, CASE WHEN outcome = 'failed' THEN 'empty transcript' END AS error FROM outcomes WHERE outcome <> 'skipped'
        UNION ALL SELECT 'analysis', CASE WHEN length(transcript) < 200 THEN 'too short' END FROM outcomes WHERE outcome = 'success') GROUP BY 1""",
    ),
)
def stage_errors(spark, sf):
    rows = outcome_rows(spark, sf).filter(F.col("outcome") != "skipped")
    first = rows.select(F.lit("transcript").alias("stage"), F.when(F.col("outcome") == "failed", "empty transcript").alias("error"))
    second = rows.filter(F.col("outcome") == "success").select(F.lit("analysis").alias("stage"), F.when(F.length("transcript") < 200, "too short").alias("error"))
    return I.stage_counts(first.unionByName(second))


@query(
    "recent_or_all",
    """SELECT 'recent' AS case_name, event_id FROM events WHERE event_type = 'view' OR ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY UNION ALL SELECT 'none', event_id FROM events WHERE event_type <> 'view'""",
)
def recent_or_all(spark, sf):
    """One cutoff inside the data, with views counted as undated, and one after it."""
    newest = F.broadcast(V.events(spark, sf).agg(F.max("ts").alias("_newest")))
    dated = V.events(spark, sf).withColumn("at", F.when(F.col("event_type") != "view", F.col("ts"))).join(newest)
    a = I.recent_or_all(dated, "at", F.col("_newest") - F.expr("INTERVAL 7 DAYS")).select(F.lit("recent").alias("case_name"), "event_id")
    later = I.recent_or_all(dated.filter("at IS NOT NULL"), "at", F.col("_newest") + F.expr("INTERVAL 7 DAYS"))
    return a.unionByName(later.select(F.lit("none").alias("case_name"), "event_id"))


@query("seeded_sample", "SELECT event_id, event_type FROM events ORDER BY md5('42-' || event_id::VARCHAR) LIMIT 400")
def seeded_sample(spark, sf):
    return I.seeded_sample(V.events(spark, sf), "event_id", 400).select("event_id", "event_type")


@query("events_daily", "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_daily(spark, sf):
    return I.daily_counts(V.events(spark, sf), "ts")


# --- streams -----------------------------------------------------------------------------------------


def event_stream(spark, sf):
    rows = X.file_stream(spark, sf, "events.parquet", V.events(spark, sf).schema)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_daily",
    """SELECT ts::DATE AS day, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2""",
)
def stream_daily(spark, sf):
    return X.daily_stream(spark, event_stream(spark, sf), "ts")


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, sf):
    return X.dedupe_stream(spark, event_stream(spark, sf), "ts", ["user_id", "event_type"], "400 days")


@query(
    "stream_upsert",
    "SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value, arg_max(event_id, ts) AS event_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created_at FROM events GROUP BY 1",
)
def stream_upsert(spark, sf):
    versions = event_stream(spark, sf).select("user_id", "event_type", "value", "event_id", "ts")
    out = X.upsert_stream(spark, versions, ["user_id"], ["ts", "event_id"], "ts")
    return out.select("user_id", "event_type", "value", "event_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("stream_ingest_jobs", _JOBS)
def stream_ingest_jobs(spark, sf):
    return X.job_stream(spark, event_outcomes(event_stream(spark, sf)))


@query(
    "stream_log_sink",
    "SELECT ts::DATE AS day, event_type AS source_endpoint, count(*) AS n FROM events WHERE ts::DATE >= (SELECT max(ts)::DATE FROM events) - 14 GROUP BY 1, 2",
)
def stream_log_sink(spark, sf):
    log = event_stream(spark, sf).select(F.col("ts").alias("created_at"), F.col("event_type").alias("source_endpoint"), F.col("user_id").alias("target_id"), "props")
    rows = X.log_stream(spark, log, "created_at", scratch_path(spark, "log"), scratch_path(spark, "log-second"), keep_days=14)
    return rows.groupBy("day", "source_endpoint").agg(F.count(F.lit(1)).alias("n"))


# --- state over several batches ----------------------------------------------------------------------


def in_files(parts, folder, first=0):
    """The rows of every part as one more file group of a stream's folder."""
    for n, part in enumerate(parts, first):
        part.write.mode("overwrite").parquet(f"{folder}/part={n:02d}")


_MONTHLY = _JOBS.replace("%Y%m%d", "%Y%m")


@query("stream_job_states", _MONTHLY)
def stream_job_states(spark, sf):
    """The events in four files, the last of which repeats the first; between the second and the third the stream restarts."""
    events = V.events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = event_outcomes(events, "yyyyMM", "event_id", "ts")
    folder, out, state = (scratch_path(spark, name) for name in ("job-events", "job-states", "job-checkpoint"))
    third = F.pmod(F.col("event_id"), F.lit(3))
    parts = [rows.filter(third == n) for n in range(3)]
    read = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).option("basePath", folder)
    in_files(parts[:2], folder)
    X.run_job_states(spark, read.parquet(f"{folder}/*"), out, state, delay="400 days")
    in_files([parts[2], parts[0]], folder, 2)
    X.run_job_states(spark, read.parquet(f"{folder}/*"), out, state, delay="400 days")
    return X.current_jobs(spark, out)


@query(
    "stream_upsert_buckets",
    "SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value, arg_max(event_id, ts) AS event_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created_at FROM events GROUP BY 1",
)
def stream_upsert_buckets(spark, sf):
    """Four batches, the second taken into the base before the others arrive, and written once more after that."""
    rows = V.events(spark, sf).select("user_id", "event_type", "value", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    table = X.BucketTable(spark, scratch_path(spark, "buckets"), rows.schema, ["user_id"], ["ts", "event_id"], "ts", buckets=16)
    folder = scratch_path(spark, "upsert-events")
    in_files([rows.filter(F.pmod(F.col("event_id"), F.lit(4)) == n) for n in range(4)], folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(f"{folder}/*")

    def write(batch, batch_id):
        table.write(batch, batch_id)
        if batch_id == 1:
            table.compact()
            table.write(batch, batch_id)

    X.run_to_end(stream, write, scratch_path(spark, "upsert-checkpoint"))
    return table.read().select("user_id", "event_type", "value", "event_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))
