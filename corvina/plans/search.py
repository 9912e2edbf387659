"""Retrieval queries over the current chunks of the knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from corvina.functions import text as T
from corvina.operators import retrieval as R
from corvina.operators.tables import current_chunks, numbered
from corvina.session import spread, stored, table, written

QUERY = "rimborso delle spese mediche dopo la denuncia del sinistro firmata"
TOP_K, OVERSAMPLING = 12, 3


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return current_chunks(spread(table(spark, d, "chunks").select("chunk_id", "document_id", "chunk_index", "text", "section_title", "page_start", "page_end", "created_at"))).where("text is not null")


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return written(R.term_counts(_chunks(spark, d), "chunk_id", F.col("text")))


def search_index(spark: SparkSession, d: str) -> R.Index:
    """The BM25 index of the current chunks of ``d``, stored by the first question."""
    return R.open_index(spark, stored("bm25", [table(spark, d, "chunks")], lambda path: R.build_index(_terms(spark, d), path)))


def _one(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("query_id"), F.lit(QUERY).alias("query_text"))


def text_terms(spark: SparkSession, d: str) -> R.TextTerms:
    """Term counts of the current chunks of ``d``, stored by the first query of many questions."""
    # Texts are placed by chunk first, so counting their terms needs no shuffle of its own.
    counts = lambda: R.term_counts(_chunks(spark, d).select("chunk_id", "text").repartition("chunk_id"), "chunk_id", F.col("text"))
    return R.open_text_terms(spark, stored("text_terms", [table(spark, d, "chunks")], lambda path: R.build_text_terms(counts(), path)))


def _sparse_top(spark: SparkSession, d: str, queries: DataFrame, k: int) -> DataFrame:
    """The best ``k`` chunks of a few queries (query_id, query_text); only their terms are read."""
    index = search_index(spark, d)
    q = R.term_counts(queries, "query_id", F.col("query_text"))
    index = index.of_terms([r.term for r in q.select("term").distinct().collect()])
    weights = R.weighted(q, index.df.select("term", "df"), index.stats).withColumnRenamed("id", "query_id")
    return R.ranked(R.sparse_scores(weights, index.postings.drop("bucket")), k, "score", "id", ["query_id"])


def _sparse_top_of_many(spark: SparkSession, d: str, queries: DataFrame, k: int) -> DataFrame:
    """The best ``k`` chunks of many queries; those with the same words are scored once."""
    texts = text_terms(spark, d)
    q = R.term_counts(queries, "query_id", F.col("query_text"))
    bags = q.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "tf", "len"))).alias("words"))
    same = written(bags.groupBy("words").agg(F.min("id").alias("bag"), F.collect_list("id").alias("query_ids")))
    asked = same.select(F.col("bag").alias("id"), F.inline("words"))
    weights = written(R.weighted(asked, texts.df, texts.stats)).withColumnRenamed("id", "query_id")
    postings = written(texts.of_terms(weights.select("term").distinct()))
    best = R.sparse_best(weights, postings, k).withColumnRenamed("query_id", "bag")
    return best.join(same.select("bag", F.explode("query_ids").alias("query_id")), "bag").select("query_id", "id", "score", "rank")


def bm25_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    terms = _terms(spark, d)
    vocab = terms.agg(F.countDistinct("term").alias("terms"))
    return R.corpus_stats(terms).select("n", "tokens", F.round("avg_len", 6).alias("avg_len")).crossJoin(F.broadcast(vocab))


def bm25_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return R.document_frequency(_terms(spark, d))


def bm25_weights(spark: SparkSession, d: str) -> DataFrame:
    """Sums over the weight vector of each chunk."""
    terms = _terms(spark, d)
    w = R.weighted(terms, R.document_frequency(terms), R.corpus_stats(terms))
    return w.groupBy(F.col("id").alias("chunk_id")).agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 4).alias("total"), F.round(F.max("weight"), 4).alias("top"))


def bm25_snapshot_df(spark: SparkSession, d: str) -> DataFrame:
    """Statistics as they were before each document came in: df per term, chunks and tokens."""
    chunks = _chunks(spark, d)
    terms = written(R.term_counts(chunks, "chunk_id", F.col("text")).join(chunks.select(F.col("chunk_id").alias("id"), "document_id"), "id"))
    # Running sums in two steps, over blocks of documents and within them: a term of every document is no hot group.
    per_term = terms.groupBy("document_id", "term").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.floor(F.col("document_id") / 4096))
    blocks = Window.partitionBy("term").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("term", "block").orderBy("document_id").rowsBetween(Window.unboundedPreceding, -1)
    earlier = per_term.groupBy("term", "block").agg(F.sum("n").alias("m")).withColumn("earlier", F.coalesce(F.sum("m").over(blocks), F.lit(0))).drop("m")
    df = per_term.join(earlier, ["term", "block"]).withColumn("df_before", F.col("earlier") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    return df.groupBy("document_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("df_before").alias("df_before"), F.count_if(F.col("df_before") == 0).alias("new_terms"))


def vocabulary_ids(spark: SparkSession, d: str) -> DataFrame:
    """Stable term ids: terms of the first half of the documents keep theirs, new ones follow."""
    chunks = _chunks(spark, d)
    middle = chunks.agg(F.percentile_approx("document_id", 0.5, 1_000_000)).first()[0]
    terms = written(R.term_counts(chunks, "chunk_id", F.col("text")).join(chunks.select(F.col("chunk_id").alias("id"), "document_id"), "id").groupBy("term").agg(F.min("document_id").alias("first_doc")))
    old = numbered(terms.where(F.col("first_doc") <= middle).select("term"), ["term"], "term_id")
    new = numbered(terms.where(F.col("first_doc") > middle).select("term"), ["term"], "term_id")
    most = old.agg(F.coalesce(F.max("term_id"), F.lit(0)).alias("most"))
    return old.unionByName(new.crossJoin(F.broadcast(most)).select("term", (F.col("term_id") + F.col("most")).alias("term_id")))


def sparse_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: one question, BM25 vectors, the best chunks with quote and reference."""
    top = written(_sparse_top(spark, d, _one(spark), TOP_K))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "filename")
    rows = top.join(_chunks(spark, d), F.col("id") == F.col("chunk_id")).join(docs, "document_id", "left")
    return rows.select("rank", "chunk_id", "document_id", F.round("score", 6).alias("score"), T.quote(F.col("text")).alias("quote"), T.reference(F.col("filename"), F.col("page_start"), F.col("page_end"), F.col("section_title"), F.col("chunk_index")).alias("reference"))


def log_search(spark: SparkSession, d: str) -> DataFrame:
    """The three best chunks for every logged question whose id is divisible by 100."""
    logs = table(spark, d, "query_logs").where("log_id % 100 = 0 and query is not null").select(F.col("log_id").alias("query_id"), F.col("query").alias("query_text")).distinct()
    return _sparse_top_of_many(spark, d, logs, 3).select(F.col("query_id").alias("log_id"), F.col("id").alias("chunk_id"), "rank", F.round("score", 6).alias("score"))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 100."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    return R.ranked(R.dense_scores(v, q, k=6).where("id <> query_id"), 5, "score", "id", ["query_id"]).select("query_id", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


def pseudo_embeddings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", T.hash_components(F.coalesce("text", F.lit("")), 32).alias("v"))
    return docs.select("doc_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", 32), 6).alias("last"))


def _fused(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, id, score, rank): sparse and hash-vector lists for one question, fused by reciprocal rank."""
    search_k = TOP_K * OVERSAMPLING
    sparse = _sparse_top(spark, d, _one(spark), search_k)
    vec = _one(spark).select(T.hash_components(F.col("query_text"), 32).alias("q"))
    dense = _chunks(spark, d).select(F.col("chunk_id").alias("id"), T.hash_components(F.col("text"), 32).alias("v")).crossJoin(F.broadcast(vec)).select(F.lit(0).cast("bigint").alias("query_id"), "id", R.dot(F.col("q"), F.col("v")).alias("score"))
    fused = R.reciprocal_rank_fusion([sparse, R.ranked(dense, search_k, "score", "id")])
    return R.ranked(fused, search_k, "score", "id")


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("rank", F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"))


def lexical_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The sparse pool of one question, reranked by shared words."""
    pool = _sparse_top(spark, d, _one(spark), TOP_K * OVERSAMPLING).select("id", F.round("score", 6).alias("score"))
    rows = pool.join(_chunks(spark, d), F.col("id") == F.col("chunk_id")).withColumn("query_text", F.lit(QUERY))
    out = R.lexical_hybrid(rows, floor=0.05).select("id", F.round("lexical_score", 6).alias("lexical_score"), F.round("hybrid_score", 6).alias("hybrid_score"))
    return R.ranked(out, TOP_K, "hybrid_score", "id").withColumnRenamed("id", "chunk_id")


def diversified_results(spark: SparkSession, d: str) -> DataFrame:
    top = _sparse_top(spark, d, _one(spark), TOP_K * OVERSAMPLING)
    rows = top.join(_chunks(spark, d).select(F.col("chunk_id").alias("id"), "text"), "id")
    return R.diversified(rows).where(F.col("kept_rank") <= TOP_K).select(F.col("id").alias("chunk_id"), "rank", "kept_rank")


def retrieved(spark: SparkSession, d: str, chunks: DataFrame) -> DataFrame:
    """The fused pool above the floor, reranked by shared words and diversified: (id, kept_rank, score), at most 12."""
    pool = written(_fused(spark, d).drop("rank"))
    rows = R.lexical_hybrid(pool.join(chunks.select(F.col("chunk_id").alias("id"), "text"), "id").withColumn("query_text", F.lit(QUERY)))
    order = R.ranked(rows.select("query_id", "id", "hybrid_score", "score", "text"), TOP_K * OVERSAMPLING, "hybrid_score", "id", ["query_id"])
    kept = R.diversified(order).where(F.col("kept_rank") <= TOP_K)
    return kept.select("query_id", "id", "kept_rank").join(rows.select("query_id", "id", "hybrid_score"), ["query_id", "id"]).select("id", "kept_rank", F.col("hybrid_score").alias("score"))


def full_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid pool, floor, lexical rerank, diversification, whole citations and context blocks for one question."""
    chunks = current_chunks(spread(table(spark, d, "chunks").select("chunk_id", "document_id", "chunk_index", "text", "section_title", "char_start", "char_end", "page_start", "page_end", "created_at"))).where("text is not null")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "filename", F.col("page_count").alias("document_page_count"))
    cited = retrieved(spark, d, chunks).join(chunks.withColumnRenamed("chunk_id", "id"), "id").join(docs, "document_id", "left")
    ref = T.reference(F.col("filename"), F.col("page_start"), F.col("page_end"), F.col("section_title"), F.col("chunk_index"))
    block = F.concat(F.lit("---\nFonte: "), ref, F.lit('\nEstratto: "'), T.quote(F.col("text")), F.lit('"\nTesto completo:\n'), F.col("text"))
    names = ["document_id", "filename", "text", "chunk_index", "char_start", "char_end", "page_start", "page_end", "document_page_count"]
    return cited.select(F.col("kept_rank").alias("rank"), F.col("id").alias("chunk_id"), *names, F.nullif("section_title", F.lit("")).alias("section_title"), F.round("score", 6).alias("score"), T.quote(F.col("text")).alias("quote"), ref.alias("reference"), block.alias("context_block"))


def retrieval_eval(spark: SparkSession, d: str) -> DataFrame:
    """Mean precision, recall and document coverage at 5: questions are section titles, relevant are the chunks under them.

    Every title that is not blank is a case. Hits are found by joining the best five with the rows
    of the titles, so a title of any number of chunks is whole and none is held as an array.
    """
    chunks = written(_chunks(spark, d).select("chunk_id", "document_id", "section_title"))
    titled = written(chunks.where(r"section_title rlike '\\S'").select(F.xxhash64("section_title").alias("query_id"), F.col("section_title").alias("query_text"), "chunk_id", "document_id"))
    cases = written(titled.groupBy("query_id", "query_text").agg(F.countDistinct("chunk_id").alias("relevant"), F.countDistinct("document_id").alias("documents")))
    top = written(_sparse_top_of_many(spark, d, cases.select("query_id", "query_text"), 5).select("query_id", F.col("id").alias("chunk_id")))
    hits = top.join(titled.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    docs = top.join(chunks.drop("section_title"), "chunk_id").select("query_id", "document_id").distinct()
    covered = docs.join(titled.select("query_id", "document_id").distinct(), ["query_id", "document_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("covered"))
    got = cases.join(hits, "query_id", "left").join(covered, "query_id", "left")
    share = lambda n, of: F.coalesce(F.col(n), F.lit(0)) / of
    each = got.select(share("hits", F.lit(5.0)).alias("p"), share("hits", F.col("relevant")).alias("r"), share("covered", F.col("documents")).alias("c"))
    mean = lambda x: F.round(F.coalesce(F.avg(x), F.lit(0.0)), 4)
    return each.agg(F.count(F.lit(1)).alias("cases"), mean("p").alias("precision_at_5"), mean("r").alias("recall_at_5"), mean("c").alias("document_coverage"))


def intent_routing(spark: SparkSession, d: str) -> DataFrame:
    logs = table(spark, d, "query_logs").dropDuplicates(["log_id"])
    return logs.groupBy(T.intent(F.col("query")).alias("routed"), "intent").agg(F.count(F.lit(1)).alias("n"))


def query_entities(spark: SparkSession, d: str) -> DataFrame:
    logs = table(spark, d, "query_logs").where("query is not null").select("log_id", "query").distinct()
    return logs.select("log_id", F.array_join(F.slice(T.query_entities(F.col("query")), 1, 3), "|").alias("entities"))


QUERIES = {f.__name__: f for f in (sparse_bm25_topk, bm25_corpus_stats, bm25_document_frequency, bm25_weights, bm25_snapshot_df, vocabulary_ids, log_search, dense_topk, pseudo_embeddings, hybrid_rrf, lexical_rerank, diversified_results, full_retrieval, retrieval_eval, intent_routing, query_entities)}

# --- SQL ------------------------------------------------------------------------------------

_STOP = "[" + ", ".join(f"'{w}'" for w in T.SPARSE_STOP_WORDS) + "]"
_SETSTOP = "[" + ", ".join(f"'{w}'" for w in T.SET_STOP_WORDS) + "]"
_EDGE = r'[.,;:!?()\[\]{}"«»–—-]+'
_BL = r"[ \t\n\r\f\v]+"


def tokens_sql(text: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(lower({text}), '{_BL}'), lambda t: regexp_replace(t, '^{_EDGE}|{_EDGE}$', '', 'g')), lambda t: length(t) >= 3 AND regexp_full_match(t, '\\p{{L}}+') AND NOT list_contains({_STOP}, t))"


def token_set_sql(text: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({text}), '[0-9A-Za-z_À-ÿ]{{3,}}')), lambda t: NOT list_contains({_SETSTOP}, t))"


def quote_sql(t: str) -> str:
    c = f"trim(regexp_replace({t}, '{_BL}', ' ', 'g'), ' ' || chr(160))"
    head = f"substr({c}, 1, 320)"
    return f"CASE WHEN length({c}) <= 320 THEN {c} ELSE regexp_replace(CASE WHEN instr({head}, ' ') > 0 THEN regexp_replace({head}, ' [^ ]*$', '') ELSE {head} END, '[.,;:]+$', '') || '...' END"


REFERENCE_SQL = """concat_ws(', ', coalesce(nullif(filename, ''), 'documento'), CASE WHEN page_start IS NOT NULL THEN CASE WHEN page_end IS NOT NULL AND page_end <> page_start THEN 'pagine ' || page_start || '-' || page_end ELSE 'pagina ' || page_start END
WHEN coalesce(section_title, '') <> '' THEN 'sezione: ' || section_title WHEN chunk_index IS NOT NULL THEN 'parte ' || (chunk_index + 1) END)"""
CURRENT_SQL = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, chunk_index ORDER BY created_at DESC NULLS LAST, chunk_id DESC) AS rn FROM chunks) WHERE rn = 1 AND text IS NOT NULL)"
_TERMS = f"""{CURRENT_SQL}, tok AS (SELECT chunk_id AS id, document_id, {tokens_sql('text')} AS t FROM cur), terms AS (SELECT id, any_value(document_id) AS document_id, term, any_value(len) AS len, count(*) AS tf FROM (SELECT id, document_id, len(t) AS len, unnest(t) AS term FROM tok) GROUP BY id, term),
stats AS (SELECT count(*) AS n, sum(l) AS tokens, sum(l) / count(*) AS avg_len FROM (SELECT id, max(len) AS l FROM terms GROUP BY id)), df AS (SELECT term, count(*) AS df FROM terms GROUP BY term)"""


def _weighted(src: str, name: str) -> str:
    return f"""{name}_w AS (SELECT id, term, ln((n - df + 0.5e0) / (df + 0.5e0) + 1) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * len / greatest(avg_len, 1))) AS w FROM {src} JOIN df USING (term), stats),
{name} AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM {name}_w)"""


def _query(rows: str) -> str:
    return f"""qtok AS (SELECT query_id AS id, {tokens_sql('query_text')} AS t FROM ({rows})), qterms AS (SELECT id, term, any_value(len) AS len, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM qtok) GROUP BY id, term), {_weighted('qterms', 'qv')},
scored AS (SELECT qv.id AS query_id, v.id, sum(qv.weight * v.weight) AS score FROM qv JOIN v USING (term) GROUP BY 1, 2), sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM scored)"""


_ONE_SQL = f"SELECT 0 AS query_id, '{QUERY}' AS query_text"
_FULL = f"WITH {_TERMS}, {_weighted('terms', 'v')}, {_query(_ONE_SQL)}"


def hash_vector_sql(text: str, dims: int = 32) -> str:
    return f"list_transform(range({dims}), lambda i: CAST(('0x' || substr(sha256({text}), CAST((i % 32) * 2 + 1 AS BIGINT), 2)) AS INTEGER) / 255e0 * 2 - 1)"


_CASES = f"""WITH {_TERMS}, {_weighted('terms', 'v')}, titled AS (SELECT DISTINCT section_title AS query_id, chunk_id, document_id FROM cur WHERE regexp_matches(section_title, '\\S')),
cases AS (SELECT query_id, count(DISTINCT chunk_id) AS relevant, count(DISTINCT document_id) AS documents FROM titled GROUP BY 1), {_query('SELECT query_id, query_id AS query_text FROM cases')},
best AS (SELECT query_id, id AS chunk_id, document_id FROM sparse JOIN cur ON chunk_id = id WHERE rank <= 5),
hits AS (SELECT query_id, count(*) AS hits FROM best JOIN titled USING (query_id, chunk_id) GROUP BY 1), docs AS (SELECT query_id, count(DISTINCT document_id) AS covered FROM best JOIN titled USING (query_id, document_id) GROUP BY 1)"""
_FUSED = f"dv AS (SELECT chunk_id AS id, {hash_vector_sql('text')} AS x FROM cur), qvv AS (SELECT {hash_vector_sql(chr(39) + QUERY + chr(39))} AS y), dense AS (SELECT id, row_number() OVER (ORDER BY round(list_cosine_similarity(x, y), 6) DESC, id) AS rank FROM dv, qvv), fused AS (SELECT id, sum(1 / (2e0 + rank - 1)) AS score FROM (SELECT id, rank FROM sparse WHERE rank <= 36 UNION ALL SELECT id, rank FROM dense WHERE rank <= 36) GROUP BY 1), pool AS (SELECT row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank, id, score FROM fused ORDER BY rank LIMIT 36)"
_HYBRID = f", {_FUSED}, lx AS (SELECT id, score, {token_set_sql('text')} AS a, {token_set_sql(chr(39) + QUERY + chr(39))} AS b FROM pool JOIN cur ON chunk_id = id WHERE score >= 0.25), lh AS (SELECT id, score * 0.85e0 + CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END * 0.15e0 AS hybrid FROM lx), lex AS (SELECT id, hybrid, row_number() OVER (ORDER BY round(hybrid, 6) DESC, id) AS place FROM lh)"


def _greedy(source: str, place: str, score: str, steps: str = "") -> str:
    """One candidate a step, kept if it is not too like one kept before."""
    alike = "len(list_intersect(o.t, c.t)) > 0.82e0 * (len(o.t) + len(c.t) - len(list_intersect(o.t, c.t)))"
    return f"""WITH RECURSIVE {_FULL[5:]}{steps}, cand AS (SELECT p.place, p.id, p.score, {token_set_sql('text')} AS t FROM (SELECT {place} AS place, id, {score} AS score FROM {source}) p JOIN cur ON chunk_id = p.id),
g AS (SELECT CAST(0 AS BIGINT) AS step, CAST([] AS STRUCT(id BIGINT, rank BIGINT, score DOUBLE, t VARCHAR[])[]) AS held UNION ALL SELECT g.step + 1, CASE WHEN len(c.t) > 0 AND len(list_filter(g.held, lambda o: len(o.t) > 0 AND {alike})) > 0 THEN g.held ELSE list_append(g.held, {{'id': c.id, 'rank': c.place, 'score': c.score, 't': c.t}}) END FROM g JOIN cand c ON c.place = g.step + 1),
kept AS (SELECT x.id, x.rank, x.score, kept_rank FROM (SELECT unnest(held) AS x, generate_subscripts(held, 1) AS kept_rank FROM (SELECT held FROM g ORDER BY step DESC LIMIT 1)))"""


_ROUTE = "CASE WHEN trim(q) = '' OR {d} THEN 'direct' WHEN {s} THEN 'summary' WHEN {r} THEN 'relational' ELSE 'factual' END"
_has = lambda ws: "(" + " OR ".join(f"contains(q, '{w}')" for w in ws) + ")"
ORACLES = {
    "sparse_bm25_topk": f"{_FULL} SELECT s.rank, chunk_id, document_id, round(score, 6) AS score, {quote_sql('c.text')} AS quote, {REFERENCE_SQL} AS reference FROM sparse s JOIN cur c ON s.id = c.chunk_id LEFT JOIN (SELECT doc_id, filename FROM documents) ON doc_id = document_id WHERE s.rank <= {TOP_K}",
    "bm25_corpus_stats": f"WITH {_TERMS} SELECT n, CAST(tokens AS BIGINT) AS tokens, round(avg_len, 6) AS avg_len, (SELECT count(*) FROM df) AS terms FROM stats",
    "bm25_document_frequency": f"WITH {_TERMS} SELECT term, df FROM df",
    "bm25_weights": f"WITH {_TERMS}, {_weighted('terms', 'v')} SELECT id AS chunk_id, count(*) AS terms, round(sum(weight), 4) AS total, round(max(weight), 4) AS top FROM v GROUP BY 1",
    "bm25_snapshot_df": f"WITH {_TERMS}, per AS (SELECT document_id, term, count(*) AS n FROM terms GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY term ORDER BY document_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS df_before FROM per) SELECT document_id, count(*) AS terms, CAST(sum(df_before) AS BIGINT) AS df_before, count(*) FILTER (df_before = 0) AS new_terms FROM b GROUP BY 1",
    "vocabulary_ids": f"WITH {_TERMS}, f AS (SELECT term, min(document_id) AS first_doc FROM terms GROUP BY 1), m AS (SELECT quantile_disc(document_id, 0.5) AS middle FROM cur) SELECT term, row_number() OVER (ORDER BY first_doc > middle, term) AS term_id FROM f, m",
    "log_search": f"WITH {_TERMS}, {_weighted('terms', 'v')}, {_query('SELECT DISTINCT log_id AS query_id, query AS query_text FROM query_logs WHERE log_id % 100 = 0 AND query IS NOT NULL')} SELECT query_id AS log_id, id AS chunk_id, rank, round(score, 6) AS score FROM sparse WHERE rank <= 3",
    "dense_topk": "SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id) WHERE rank <= 5",
    "pseudo_embeddings": f"SELECT doc_id, round(v[1] / n, 6) AS first, round(v[32] / n, 6) AS last FROM (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT doc_id, {hash_vector_sql('coalesce(text, chr(0)[1:0])')} AS v FROM documents))",
    "hybrid_rrf": f"{_FULL}, {_FUSED} SELECT rank, id AS chunk_id, round(score, 6) AS score FROM pool",
    "lexical_rerank": f"{_FULL}, p AS (SELECT id, round(score, 6) AS score, {token_set_sql('text')} AS a, {token_set_sql(chr(39) + QUERY + chr(39))} AS b FROM sparse JOIN cur ON chunk_id = id WHERE rank <= 36 AND round(score, 6) >= 0.05), x AS (SELECT id, CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END AS lex, score FROM p), y AS (SELECT id AS chunk_id, round(lex, 6) AS lexical_score, round(score * 0.85e0 + lex * 0.15e0, 6) AS hybrid_score FROM x) SELECT *, row_number() OVER (ORDER BY hybrid_score DESC, chunk_id) AS rank FROM y ORDER BY rank LIMIT 12",
    "diversified_results": f"{_greedy('sparse WHERE rank <= 36', 'rank', 'score')} SELECT id AS chunk_id, rank, kept_rank FROM kept WHERE kept_rank <= {TOP_K}",
    "full_retrieval": f"""{_greedy('lex', 'place', 'hybrid', _HYBRID)} SELECT kept_rank AS rank, c.chunk_id, c.document_id, filename, c.text, c.chunk_index, char_start, char_end, page_start, page_end, page_count AS document_page_count, nullif(section_title, '') AS section_title, round(k.score, 6) AS score, {quote_sql('c.text')} AS quote, {REFERENCE_SQL} AS reference, '---' || chr(10) || 'Fonte: ' || reference || chr(10) || 'Estratto: "' || quote || '"' || chr(10) || 'Testo completo:' || chr(10) || c.text AS context_block
FROM kept k JOIN cur c ON k.id = c.chunk_id LEFT JOIN (SELECT doc_id, filename, page_count FROM documents) ON doc_id = document_id WHERE kept_rank <= {TOP_K}""",
    "retrieval_eval": f"{_CASES} SELECT count(*) AS cases, round(avg(coalesce(hits, 0) / 5e0), 4) AS precision_at_5, round(avg(coalesce(hits, 0) / relevant), 4) AS recall_at_5, round(avg(coalesce(covered, 0) / documents), 4) AS document_coverage FROM cases LEFT JOIN hits USING (query_id) LEFT JOIN docs USING (query_id)",
    "intent_routing": f"SELECT {_ROUTE.format(d=_has(T.DIRECT), s=_has(T.SUMMARY), r=_has(T.RELATIONAL))} AS routed, intent, count(*) AS n FROM (SELECT DISTINCT ON (log_id) lower(coalesce(query, '')) AS q, intent FROM query_logs) GROUP BY 1, 2",
    "query_entities": """SELECT log_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(query, '"([^"]+)"', 1), regexp_extract_all(query, '[A-Z][a-zA-Z \\t\\n]+')), lambda s: trim(s)), lambda s: length(s) > 2)))[1:3], '|') AS entities FROM (SELECT DISTINCT log_id, query FROM query_logs WHERE query IS NOT NULL)""",
}
ORACLES["pseudo_embeddings"] = ORACLES["pseudo_embeddings"].replace("coalesce(text, chr(0)[1:0])", "coalesce(text, '')")
