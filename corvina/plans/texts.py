"""Text functions, sources and sinks over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvina.functions import text as T
from corvina.operators.tables import current_chunks
from corvina.plans.search import CURRENT_SQL, REFERENCE_SQL, quote_sql, token_set_sql, tokens_sql
from corvina.sources import readers, sinks
from corvina.session import table


def quotes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("text is not null").select("chunk_id", T.quote(F.col("text")).alias("quote"))


def references(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "filename")
    c = table(spark, d, "chunks").join(docs, "document_id", "left")
    return c.select("chunk_id", T.reference(F.col("filename"), F.col("page_start"), F.col("page_end"), F.col("section_title"), F.col("chunk_index")).alias("reference"))


def section_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("text is not null").select("chunk_id", T.section_title(F.col("text")).alias("title"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("text is not null")
    return c.select("chunk_id", T.token_count(F.col("text")).alias("tokens"), (T.token_count(F.col("text")).eqNullSafe(F.col("token_count"))).alias("agrees"))


def token_sets(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("text is not null")
    return c.select("chunk_id", F.size(T.token_set(F.col("text"))).cast("bigint").alias("in_set"), F.size(T.sparse_tokens(F.col("text"))).cast("bigint").alias("sparse"))


def safe_filenames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.safe_filename(F.concat_ws("/", "source", "filename")).alias("name"))


def text_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Whether stored hashes fit the texts."""
    c = table(spark, d, "chunks").where("text is not null")
    return c.groupBy((F.sha2("text", 256) == F.col("text_hash")).alias("fits")).agg(F.count(F.lit(1)).alias("n"))


def embedding_inputs(spark: SparkSession, d: str) -> DataFrame:
    """A digest of what is embedded for each current chunk: header, section and text."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), T.document_context(F.col("filename"), F.col("category"), F.col("description")).alias("context"))
    c = current_chunks(table(spark, d, "chunks").select("chunk_id", "document_id", "chunk_index", "text", "section_title", "created_at")).where("text is not null")
    return c.join(docs, "document_id").select("chunk_id", F.md5(T.embedding_input(F.col("context"), F.col("section_title"), F.col("text"))).alias("digest"))


def query_latency(spark: SparkSession, d: str) -> DataFrame:
    """Milliseconds between asking and receiving, by source."""
    logs = table(spark, d, "query_logs").dropDuplicates(["log_id"])
    ms = F.floor((F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1000)
    return logs.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum(ms).alias("total_ms"), F.max(ms).cast("bigint").alias("most_ms"))


def upload_validation(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy(readers.upload_error(F.col("content_type"), F.col("size_bytes")).alias("refused"), "content_type").agg(F.count(F.lit(1)).alias("n"))


def format_dispatch(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy(readers.parser_of(F.col("content_type"), F.col("filename")).alias("chosen"), "parser").agg(F.count(F.lit(1)).alias("n"))


def html_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as HTML and read back."""
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit("<html><head><style>p {}</style><script>x()</script></head><body><h1>Doc</h1><p>"), F.regexp_replace(escaped, "\n\n", "</p><p class='b'>"), F.lit("</p></body></html>"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.html_text(html)).alias("digest"), F.length(T.html_text(html)).cast("bigint").alias("chars"))


def nation_tables(spark: SparkSession, d: str) -> DataFrame:
    """The nations of each region as a Markdown table."""
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    rows = F.concat(F.array(F.array(F.lit("key"), F.lit("name|title"))), F.transform("r", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"])))
    return n.select("n_regionkey", T.markdown_table(rows).alias("markdown"))


def upsert_batches(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as vector points in batches of at most 100 points and 64 kB."""
    c = table(spark, d, "chunks").where("text is not null")
    points = c.select("chunk_id", sinks.point_bytes(F.col("text"), F.lit(64), F.size(T.token_set(F.col("text")))).alias("bytes"))
    out = sinks.batched(points, ["chunk_id"], most=100, most_bytes=65536)
    return out.groupBy("shard", "batch").agg(F.count(F.lit(1)).alias("points"), F.sum("bytes").alias("bytes"))


def point_sizes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("text is not null")
    return c.select("chunk_id", sinks.point_bytes(F.col("text"), F.lit(64), F.size(T.sparse_tokens(F.col("text")))).cast("bigint").alias("bytes"))


def graph_query_guard(spark: SparkSession, d: str) -> DataFrame:
    """Logged questions wrapped as graph queries, and whether the guard lets them pass."""
    logs = table(spark, d, "query_logs").where("query is not null").dropDuplicates(["log_id"])
    q = F.when(F.col("log_id") % 3 == 0, F.concat(F.lit("MATCH (n {name: '"), F.regexp_replace("query", "'", ""), F.lit("'}) RETURN n"))).when(F.col("log_id") % 3 == 1, F.concat(F.lit("MATCH (n) SET n.x = 1 // "), "query")).otherwise(F.col("query"))
    return logs.select((F.col("log_id") % 3).alias("kind"), T.read_only_pattern(q).alias("allowed")).groupBy("kind", "allowed").agg(F.count(F.lit(1)).alias("n"))


def chunk_uuids(spark: SparkSession, d: str) -> DataFrame:
    """Stable ids of chunks from document, index and text, the same at every ingestion."""
    name = F.concat_ws(":", F.lit("corvina"), F.lit("chunk"), F.col("document_id").cast("string"), F.col("chunk_index").cast("string"), F.sha2("text", 256))
    return table(spark, d, "chunks").where("text is not null").select("chunk_id", T.uuid5(name).alias("uuid"))


def index_progress(spark: SparkSession, d: str) -> DataFrame:
    """The progress that is shown while the chunks of each document are indexed, at most twenty steps."""
    total = table(spark, d, "chunks").groupBy("document_id").agg(F.countDistinct("chunk_index").alias("total"))
    steps = total.select("document_id", "total", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("total"))).alias("done"))
    shown = (F.col("done") % F.greatest(F.lit(1), F.floor(F.col("total") / 20)) == 0) | (F.col("done") == F.col("total"))
    return steps.where(shown).select("document_id", "done", T.indexing_progress(F.col("done"), F.col("total")).alias("progress"))


def usage_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty owners with their documents, as lines of text."""
    docs = table(spark, d, "documents").groupBy("created_by").agg(F.count(F.lit(1)).alias("documents")).orderBy(F.desc("documents"), "created_by").limit(20)
    return docs.select(T.row_lines(F.struct("created_by", "documents"), ["created_by", "documents"]).alias("line"))


QUERIES = {f.__name__: f for f in (chunk_uuids, index_progress, usage_lines, quotes, references, section_titles, token_counts, token_sets, safe_filenames, text_hashes, embedding_inputs, query_latency, upload_validation, format_dispatch, html_paragraphs, nation_tables, upsert_batches, point_sizes, graph_query_guard)}

_BL = r"[ \t\n\r\f\v]+"
_words = f"len(list_filter(regexp_split_to_array(text, '{_BL}'), lambda t: t <> ''))"
_ESC = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_HTML = f"'<html><head><style>p {{}}</style><script>x()</script></head><body><h1>Doc</h1><p>' || replace({_ESC}, chr(10) || chr(10), '</p><p class=''b''>') || '</p></body></html>'"
_BLOCKS = "address|article|aside|blockquote|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"


def _html_sql(h: str) -> str:
    t = f"regexp_replace({h}, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g')"
    t = f"regexp_replace({t}, '(?i)<({_BLOCKS})\\b[^>]*>', chr(10) || chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', '', 'g')"
    t = f"replace(replace(replace({t}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
    t = f"regexp_replace({t}, '[ \\t\\r\\f\\v]+', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '\\n[ \\t]+', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


_ONE = "(SELECT DISTINCT ON (log_id) * FROM query_logs)"
_H = "sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat_ws(':', 'corvina', 'chunk', document_id, chunk_index, sha256(text))))"
ORACLES = {
    "chunk_uuids": f"SELECT chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT chunk_id, {_H} AS h FROM chunks WHERE text IS NOT NULL)",
    "index_progress": "SELECT document_id, done, CAST(80 + floor(done / total * 18) AS INTEGER) AS progress FROM (SELECT document_id, total, unnest(range(1, total + 1)) AS done FROM (SELECT document_id, count(DISTINCT chunk_index) AS total FROM chunks GROUP BY 1)) WHERE done % greatest(1, total // 20) = 0 OR done = total",
    "usage_lines": "SELECT '- created_by: ' || created_by || ', documents: ' || n AS line FROM (SELECT created_by, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, created_by LIMIT 20)",
    "quotes": f"SELECT chunk_id, {quote_sql('text')} AS quote FROM chunks WHERE text IS NOT NULL",
    "references": f"SELECT chunk_id, {REFERENCE_SQL} AS reference FROM chunks LEFT JOIN (SELECT doc_id, filename FROM documents) ON doc_id = document_id",
    "section_titles": "SELECT chunk_id, CASE WHEN length(l) <= 120 AND ((upper(l) = l AND lower(l) <> l) OR NOT regexp_matches(l, '[.:;,]$')) THEN l END AS title FROM (SELECT chunk_id, list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda s: trim(regexp_replace(s, '^[ \\t\\f\\v]+|[ \\t\\f\\v]+$', '', 'g'))), lambda s: s <> '')[1] AS l FROM chunks WHERE text IS NOT NULL)",
    "token_counts": f"SELECT chunk_id, t AS tokens, t IS NOT DISTINCT FROM token_count AS agrees FROM (SELECT chunk_id, token_count, CAST(greatest(1, {_words} * 135 // 100) AS INTEGER) AS t FROM chunks WHERE text IS NOT NULL)",
    "token_sets": f"SELECT chunk_id, len({token_set_sql('text')}) AS in_set, len({tokens_sql('text')}) AS sparse FROM chunks WHERE text IS NOT NULL",
    "safe_filenames": "SELECT doc_id, substr(regexp_replace(coalesce(nullif(trim(regexp_extract(concat_ws('/', source, filename), '[^/\\\\]*$')), ''), 'unnamed'), '[^A-Za-z0-9._ -]', '_', 'g'), 1, 180) AS name FROM documents",
    "text_hashes": "SELECT sha256(text) = text_hash AS fits, count(*) AS n FROM chunks WHERE text IS NOT NULL GROUP BY 1",
    "embedding_inputs": f"WITH {CURRENT_SQL} SELECT chunk_id, md5(concat_ws(chr(10) || chr(10), concat_ws(chr(10), 'Documento: ' || filename, 'Categoria: ' || nullif(category, ''), 'Descrizione: ' || trim(nullif(description, ''))), 'Sezione: ' || nullif(section_title, ''), cur.text)) AS digest FROM cur JOIN documents ON doc_id = document_id",
    "query_latency": f"SELECT lower(trim(source)) AS source, CAST(sum(ms) AS BIGINT) AS total_ms, CAST(max(ms) AS BIGINT) AS most_ms FROM (SELECT source, floor(date_diff('microsecond', created_at, received_at) / 1000) AS ms FROM {_ONE}) GROUP BY 1",
    "upload_validation": "SELECT CASE WHEN NOT coalesce(content_type IN (" + ", ".join(f"'{x}'" for x in readers.ACCEPTED) + f") OR starts_with(content_type, 'text/'), false) THEN 'unsupported type' WHEN coalesce(size_bytes, 0) <= 0 THEN 'empty file' WHEN size_bytes > {readers.MOST_BYTES} THEN 'too large' END AS refused, content_type, count(*) AS n FROM documents GROUP BY 1, 2",
    "format_dispatch": "SELECT CASE WHEN c = 'application/pdf' OR f LIKE '%.pdf' THEN 'pdf' WHEN c IN ('application/msword', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document') OR f LIKE '%.docx' OR f LIKE '%.doc' THEN 'docx' WHEN c = 'text/html' OR f LIKE '%.html' OR f LIKE '%.htm' THEN 'html' WHEN c LIKE 'text/%' OR c = 'application/json' OR regexp_matches(f, '\\.(txt|csv|json|md)$') THEN 'text' ELSE 'text_fallback' END AS chosen, parser, count(*) AS n FROM (SELECT lower(coalesce(content_type, '')) AS c, lower(coalesce(filename, '')) AS f, parser FROM documents) GROUP BY 1, 2",
    "html_paragraphs": f"SELECT doc_id, md5(h) AS digest, length(h) AS chars FROM (SELECT doc_id, {_html_sql(_HTML)} AS h FROM documents WHERE text IS NOT NULL)",
    "nation_tables": "SELECT n_regionkey, '| key | name\\|title |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY 1",
    "point_sizes": f"SELECT chunk_id, strlen(text) + 64 * 14 + len({tokens_sql('text')}) * 22 + 128 AS bytes FROM chunks WHERE text IS NOT NULL",
    "graph_query_guard": "SELECT k AS kind, starts_with(upper(trim(b)), 'MATCH') AND NOT regexp_matches(upper(b), '\\b(CREATE|DELETE|DETACH|SET|REMOVE|MERGE|DROP)\\b') AS allowed, count(*) AS n FROM (SELECT log_id % 3 AS k, regexp_replace(CASE log_id % 3 WHEN 0 THEN 'MATCH (n {name: ''' || replace(query, '''', '') || '''}) RETURN n' WHEN 1 THEN 'MATCH (n) SET n.x = 1 // ' || query ELSE query END, '''[^'']*''|\"[^\"]*\"', '', 'g') AS b FROM (SELECT DISTINCT log_id, query FROM query_logs WHERE query IS NOT NULL)) GROUP BY 1, 2",
}
