"""Operational reports over documents, jobs and the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvina.functions import text as T
from corvina.operators import tables as R
from corvina.session import table


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.zero_filled(table(spark, d, "documents"), "status", list(R.PHASE_PROGRESS)).select("status", "n", _progress().alias("progress"))


def _progress():
    out = F.lit(None).cast("int")
    for k, v in R.PHASE_PROGRESS.items():
        out = F.when(F.col("status") == k, F.lit(v)).otherwise(out)
    return out


def document_list(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    user = docs.agg(F.min("created_by")).first()[0]
    mine = R.owned(docs, user)
    return R.page(mine, [F.desc("created_at"), F.asc("doc_id")], 20).select("doc_id", "filename", "status", "created_at").crossJoin(F.broadcast(mine.agg(F.count(F.lit(1)).alias("total"))))


def recent_jobs(spark: SparkSession, d: str) -> DataFrame:
    jobs, docs = table(spark, d, "ingestion_jobs").distinct(), table(spark, d, "documents")
    joined = jobs.join(docs.select(F.col("doc_id").alias("document_id"), "filename"), "document_id")
    return R.page(joined, [F.desc("created_at"), F.asc("job_id"), F.desc("updated_at")], 500).select("job_id", "document_id", "filename", F.col("status").alias("job_status"), "created_at")


def latest_job_per_document(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "ingestion_jobs").select("document_id", "job_id", "status", "created_at", "updated_at")
    return R.latest(jobs, ["document_id"], ["created_at", "updated_at", "job_id"])


def query_log_search(spark: SparkSession, d: str) -> DataFrame:
    logs = table(spark, d, "query_logs")
    found = R.filtered(logs, [F.lower(F.trim("source")) == "librechat", F.col("intent") == "factual", F.col("query").ilike("%smart working%"), None])
    return found.select("log_id", "query", "latency_ms", F.col("error").isNotNull().alias("has_error")).distinct()


def query_errors(spark: SparkSession, d: str) -> DataFrame:
    logs = table(spark, d, "query_logs").dropDuplicates(["log_id"])
    return logs.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.round(F.coalesce(F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))), F.lit(0.0)), 4).alias("mean_latency"))


def kb_info(spark: SparkSession, d: str) -> DataFrame:
    docs, chunks = table(spark, d, "documents"), table(spark, d, "chunks")
    per_doc = docs.groupBy("created_by").agg(F.count(F.lit(1)).alias("documents"))
    per_chunk = chunks.join(docs.select(F.col("doc_id").alias("document_id"), "created_by"), "document_id").groupBy("created_by").agg(F.count(F.lit(1)).alias("chunks"))
    return per_doc.join(per_chunk, "created_by", "left").select("created_by", "documents", F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"))


def service_health(spark: SparkSession, d: str) -> DataFrame:
    """Last call, last measured latency, slow calls and staleness of each tool, against the newest row of the log."""
    logs = table(spark, d, "query_logs").where("tool_used is not null").dropDuplicates(["log_id"])
    newest = logs.agg(F.max("created_at").alias("now"))
    per = logs.groupBy("tool_used").agg(F.max("created_at").alias("last_check_at"), F.max_by("latency_ms", F.when(F.col("latency_ms").isNotNull(), F.struct("created_at", "log_id"))).alias("last_latency_ms"), F.count_if(F.col("latency_ms") > 1000).alias("slow"))
    age = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("last_check_at").cast("timestamp"))) / F.lit(1_000_000)
    return per.crossJoin(F.broadcast(newest)).select("tool_used", "last_check_at", F.coalesce(F.col("last_latency_ms") > 1000, F.lit(False)).alias("is_degraded"), "slow", (age > 60).alias("is_stale"))


def usage_cost(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and estimated cost per source, were all questions answered by one model."""
    logs = table(spark, d, "query_logs").dropDuplicates(["log_id"])
    per = logs.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    models = F.explode(T.strings(["gpt-4o", "gpt-4o-mini", "unlisted"])).alias("model")
    return per.select("*", models).select("source", "model", "input_tokens", "output_tokens", T.cost_usd(F.col("model"), F.col("input_tokens"), F.col("output_tokens")).alias("cost_usd"))


#: Counted uses of models, by the phase of a job that makes them.
USES = {"embeddings": "embedding", "extraction": "graph_indexing", "contextual_retrieval": "contextual_retrieval"}


def usage_counters(spark: SparkSession, d: str) -> DataFrame:
    """Calls and tokens of each use of a model as one row; what never happened is 0."""
    jobs = table(spark, d, "ingestion_jobs").distinct()
    calls = [F.count_if(F.col("phase") == phase).alias(f"{use}_calls") for use, phase in USES.items()]
    tokens = [F.coalesce(F.sum(F.when(F.col("phase") == phase, F.col("input_tokens"))), F.lit(0)).cast("bigint").alias(f"{use}_tokens") for use, phase in USES.items()]
    return jobs.agg(*calls, *tokens)


def ingestion_cost(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "ingestion_jobs").distinct()
    return jobs.groupBy("status").agg(F.countDistinct("job_id").alias("jobs"), F.sum("input_tokens").alias("input_tokens"), F.round(F.sum("cost_estimate_usd"), 6).alias("cost_usd"), F.sum("chunk_count").alias("chunks"))


def job_durations(spark: SparkSession, d: str) -> DataFrame:
    """Seconds of each phase a job ended in, newest state of each job."""
    jobs = R.latest(table(spark, d, "ingestion_jobs").select("job_id", "phase", "status", "started_at", "completed_at", "updated_at"), ["job_id"], ["updated_at", "completed_at"])
    secs = F.unix_seconds(F.col("completed_at").cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))
    return jobs.groupBy("phase", "status").agg(F.count(F.lit(1)).alias("jobs"), F.sum(secs).alias("seconds"), F.count_if(F.col("completed_at").isNull()).alias("unfinished"))


def schedulable_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("status").isin(*R.SCHEDULABLE)).select("doc_id", "status", F.col("error_message").isNotNull().alias("has_error"))


def content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "created_by", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "created_at")
    return R.hash_duplicates(docs, "created_by", "digest", ["created_at", "doc_id"]).select("doc_id", "is_duplicate")


def caller_sources(spark: SparkSession, d: str) -> DataFrame:
    """The caller's system by e-mail, against what the log says."""
    mail = F.lower(F.coalesce("user_email", F.lit("")))
    by_mail = F.when(mail.startswith("librechat"), "librechat").when(mail.startswith("mcp"), "mcp").otherwise("admin")
    logs = table(spark, d, "query_logs").dropDuplicates(["log_id"])
    return logs.groupBy(by_mail.alias("caller"), F.lower(F.trim("source")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def owner_check(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose owner is an active user."""
    users = table(spark, d, "users").where("is_active").select(F.col("id").alias("created_by"))
    return table(spark, d, "documents").join(users, "created_by", "left_semi").groupBy("created_by").agg(F.count(F.lit(1)).alias("documents"))


def merged_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs after a merge of late updates into what was first seen: first creation, newest state."""
    jobs = table(spark, d, "ingestion_jobs").select("job_id", "document_id", "status", "created_at", "updated_at")
    newest = R.latest(jobs, ["job_id"], ["updated_at", "status"])
    oldest = jobs.groupBy("job_id").agg(F.min("created_at").alias("created_at"))
    old = newest.drop("created_at").join(oldest, "job_id").select(*newest.columns)
    return R.upsert(old, newest, ["job_id"], keep_first=["created_at"])


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is left of chunks and jobs when failed documents are deleted."""
    docs = table(spark, d, "documents")
    gone = docs.where("status = 'error'").select(F.col("doc_id").alias("document_id"))
    left = [R.without(table(spark, d, t).select("document_id").distinct() if t == "ingestion_jobs" else table(spark, d, t).select("document_id"), gone, "document_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n") for t in ("chunks", "ingestion_jobs")]
    return left[0].unionAll(left[1])


def document_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One document by key and owner."""
    docs = table(spark, d, "documents")
    key = docs.agg(F.min(F.struct("doc_id", "created_by")).alias("k")).first()["k"]
    return R.owned(docs.where(F.col("doc_id") == key["doc_id"]), key["created_by"]).select("doc_id", "filename", "created_by").limit(1)


QUERIES = {f.__name__: f for f in (status_counts, document_list, recent_jobs, latest_job_per_document, query_log_search, query_errors, kb_info, service_health, usage_cost, usage_counters, ingestion_cost, job_durations, schedulable_documents, content_hash_dedup, caller_sources, owner_check, merged_jobs, cascade_delete, document_lookup)}

_ONE = "(SELECT DISTINCT ON (log_id) * FROM query_logs)"
_RATE = "CASE m WHEN 'gpt-4o' THEN {a} ELSE {b} END"
ORACLES = {
    "status_counts": "SELECT s.status, count(d.doc_id) AS n, CAST(s.p AS INTEGER) AS progress FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in R.PHASE_PROGRESS.items()) + ") s(status, p) LEFT JOIN documents d ON d.status = s.status GROUP BY s.status, s.p",
    "document_list": "SELECT doc_id, filename, status, created_at, count(*) OVER () AS total FROM documents WHERE created_by = (SELECT min(created_by) FROM documents) ORDER BY created_at DESC, doc_id LIMIT 20",
    "recent_jobs": "SELECT j.job_id, j.document_id, d.filename, j.status AS job_status, j.created_at FROM (SELECT DISTINCT * FROM ingestion_jobs) j JOIN documents d ON d.doc_id = j.document_id ORDER BY j.created_at DESC, j.job_id, j.updated_at DESC LIMIT 200",
    "latest_job_per_document": "SELECT document_id, job_id, status, created_at, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC NULLS LAST, updated_at DESC NULLS LAST, job_id DESC NULLS LAST, status DESC NULLS LAST) AS rn FROM ingestion_jobs) WHERE rn = 1",
    "query_log_search": "SELECT DISTINCT log_id, query, latency_ms, error IS NOT NULL AS has_error FROM query_logs WHERE lower(trim(source)) = 'librechat' AND intent = 'factual' AND query ILIKE '%smart working%'",
    "query_errors": f"SELECT lower(trim(source)) AS source, count(*) AS n, count(error) AS errors, round(coalesce(avg(latency_ms) FILTER (latency_ms > 0), 0), 4) AS mean_latency FROM {_ONE} GROUP BY 1",
    "kb_info": "SELECT d.created_by, d.documents, coalesce(c.chunks, 0) AS chunks FROM (SELECT created_by, count(*) AS documents FROM documents GROUP BY 1) d LEFT JOIN (SELECT created_by, count(*) AS chunks FROM chunks JOIN documents ON doc_id = document_id GROUP BY 1) c USING (created_by)",
    "service_health": f"WITH l AS (SELECT * FROM {_ONE} WHERE tool_used IS NOT NULL) SELECT tool_used, max(created_at) AS last_check_at, coalesce(arg_max(latency_ms, (created_at, log_id)) > 1000, false) AS is_degraded, count(*) FILTER (latency_ms > 1000) AS slow, date_diff('microsecond', max(created_at), (SELECT max(created_at) FROM l)) / 1e6 > 60 AS is_stale FROM l GROUP BY 1",
    "usage_cost": f"SELECT source, m AS model, i AS input_tokens, o AS output_tokens, round(i / 1e6 * {_RATE.format(a='2.5e0', b='0.15e0')} + o / 1e6 * {_RATE.format(a='10e0', b='0.6e0')}, 6) AS cost_usd FROM (SELECT lower(trim(source)) AS source, CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(output_tokens) AS BIGINT) AS o FROM {_ONE} GROUP BY 1), (VALUES ('gpt-4o'), ('gpt-4o-mini'), ('unlisted')) t(m)",
    "usage_counters": "SELECT " + ", ".join(f"count(*) FILTER (phase = '{p}') AS {u}_calls, CAST(coalesce(sum(input_tokens) FILTER (phase = '{p}'), 0) AS BIGINT) AS {u}_tokens" for u, p in USES.items()) + " FROM (SELECT DISTINCT * FROM ingestion_jobs)",
    "ingestion_cost": "SELECT status, count(DISTINCT job_id) AS jobs, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, round(sum(cost_estimate_usd), 6) AS cost_usd, CAST(sum(chunk_count) AS BIGINT) AS chunks FROM (SELECT DISTINCT * FROM ingestion_jobs) GROUP BY 1",
    "job_durations": "SELECT phase, status, count(*) AS jobs, CAST(sum(floor(epoch(completed_at)) - floor(epoch(started_at))) AS BIGINT) AS seconds, count(*) FILTER (completed_at IS NULL) AS unfinished FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC NULLS LAST, completed_at DESC NULLS LAST, phase DESC NULLS LAST, status DESC NULLS LAST, started_at DESC NULLS LAST) AS rn FROM ingestion_jobs) WHERE rn = 1 GROUP BY 1, 2",
    "schedulable_documents": "SELECT doc_id, status, error_message IS NOT NULL AS has_error FROM documents WHERE status IN ('uploaded', 'error')",
    "content_hash_dedup": "SELECT doc_id, row_number() OVER (PARTITION BY created_by, coalesce(text, '') ORDER BY created_at, doc_id) > 1 AS is_duplicate FROM documents",
    "caller_sources": f"SELECT CASE WHEN starts_with(m, 'librechat') THEN 'librechat' WHEN starts_with(m, 'mcp') THEN 'mcp' ELSE 'admin' END AS caller, source, count(*) AS n FROM (SELECT lower(coalesce(user_email, '')) AS m, lower(trim(source)) AS source FROM {_ONE}) GROUP BY 1, 2",
    "owner_check": "SELECT created_by, count(*) AS documents FROM documents WHERE created_by IN (SELECT id FROM users WHERE is_active) GROUP BY 1",
    "merged_jobs": "SELECT job_id, document_id, status, min_created AS created_at, updated_at FROM (SELECT *, min(created_at) OVER (PARTITION BY job_id) AS min_created, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC NULLS LAST, status DESC NULLS LAST, document_id DESC NULLS LAST, created_at DESC NULLS LAST) AS rn FROM ingestion_jobs) WHERE rn = 1",
    "cascade_delete": "WITH g AS (SELECT doc_id FROM documents WHERE status = 'error') SELECT 'chunks' AS table_name, count(*) AS n FROM chunks WHERE document_id NOT IN (FROM g) UNION ALL SELECT 'ingestion_jobs', count(DISTINCT document_id) FROM ingestion_jobs WHERE document_id NOT IN (FROM g)",
    "document_lookup": "SELECT doc_id, filename, created_by FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)",
}
