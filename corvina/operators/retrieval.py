"""Sparse and dense retrieval: BM25 vectors, cosine, rank fusion, reranking, diversification."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from corvina.functions import text as T

K1, B = 1.5, 0.75
LEXICAL_WEIGHT, SCORE_FLOOR, MOST_ALIKE = 0.15, 0.25, 0.82


def term_counts(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, term, tf, len): how often each term occurs in a text, and the text's tokens."""
    # The one-row explode keeps the tokens from being computed again for each use.
    toks = rows.select(F.col(id_col).alias("id"), F.explode(F.array(T.sparse_tokens(text))).alias("tokens")).where(F.size("tokens") > 0)
    return toks.select("id", F.size("tokens").alias("len"), F.explode("tokens").alias("term")).groupBy("id", "term", "len").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(terms: DataFrame) -> DataFrame:
    """One row (n, tokens, avg_len); the average is 1 for an empty corpus."""
    per = terms.groupBy("id").agg(F.max("len").alias("len"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens")).withColumn("avg_len", F.when(F.col("n") > 0, F.col("tokens") / F.col("n")).otherwise(F.lit(1.0)))


def document_frequency(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25(tf: Column, length: Column, df: Column, n: Column, avg_len: Column) -> Column:
    idf = F.when(n > 0, F.log((n - df + 0.5) / (df + 0.5) + 1)).otherwise(F.log(F.lit(2.0)))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.greatest(avg_len, F.lit(1.0))))


def raw_weights(terms: DataFrame, df: DataFrame, stats: DataFrame) -> DataFrame:
    """(id, term, weight): BM25 weights above 0."""
    w = terms.join(df, "term").crossJoin(F.broadcast(stats)).withColumn("weight", bm25(F.col("tf"), F.col("len"), F.col("df"), F.col("n"), F.col("avg_len"))).where("weight > 0")
    return w.select("id", "term", "weight")


def norms_of(weights: DataFrame) -> DataFrame:
    return weights.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def weighted(terms: DataFrame, df: DataFrame, stats: DataFrame, norms: DataFrame | None = None) -> DataFrame:
    """(id, term, weight): BM25 weights above 0, each text's vector of length 1.

    ``norms`` (id, norm) are given where ``terms`` are only a part of the texts' terms.
    """
    w = raw_weights(terms, df, stats)
    return w.join(norms_of(w) if norms is None else norms, "id").select("id", "term", (F.col("weight") / F.col("norm")).alias("weight"))


#: Folders of the index; a question reads those of its terms.
INDEX_BUCKETS = 64
DF_SCHEMA, STATS_SCHEMA = "term string, df bigint, bucket int", "n bigint, tokens bigint, avg_len double"


@dataclass(frozen=True)
class Index:
    """A stored BM25 index: postings (term, id, weight, bucket), df (term, df, bucket) and stats (one row)."""

    postings: DataFrame
    df: DataFrame
    stats: DataFrame

    def of_terms(self, terms: Sequence[str]) -> Index:
        """The part of a few given terms: other buckets are not listed, other row groups are skipped."""
        buckets = {r[0] for r in self.df.sparkSession.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term"))).collect()}
        narrow = lambda x: x.where(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms))
        return Index(narrow(self.postings), narrow(self.df), self.stats)


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(INDEX_BUCKETS)).cast("int")


def build_index(terms: DataFrame, path: str) -> None:
    """Write the index of term counts (id, term, tf, len) below ``path``.

    Rows are range-partitioned and sorted by bucket, term and id, so a term that every text has is
    split over files, and the statistics of a file's row groups tell which terms they hold.
    """
    spark = terms.sparkSession

    def put(df: DataFrame, name: str, order: list[str]) -> None:
        placed = df.withColumn("bucket", bucket_of(F.col("term"))).repartitionByRange("bucket", *order)
        placed.sortWithinPartitions("bucket", *order).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")

    df = document_frequency(terms)
    put(df, "df", ["term"])
    corpus_stats(terms).write.mode("overwrite").parquet(f"{path}/stats")
    counted = spark.read.schema(DF_SCHEMA).parquet(f"{path}/df").select("term", "df")
    put(weighted(terms, counted, spark.read.schema(STATS_SCHEMA).parquet(f"{path}/stats")), "postings", ["term", "id"])


def open_index(spark: SparkSession, path: str, id_type: str = "bigint") -> Index:
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    return Index(read("postings", f"term string, id {id_type}, weight double, bucket int"), read("df", DF_SCHEMA), read("stats", STATS_SCHEMA))


#: Document frequencies of so many terms are sent to every task; more are joined by a shuffle.
MOST_SENT = 500_000


@dataclass(frozen=True)
class TextTerms:
    """Stored term counts by text (id, term, tf, len), with df (term, df), stats (one row) and norms (id, norm)."""

    counts: DataFrame
    df: DataFrame
    stats: DataFrame
    norms: DataFrame

    def of_terms(self, terms: DataFrame) -> DataFrame:
        """(id, term, weight): the weights of some terms (term)."""
        return weighted(self.counts.join(terms, "term", "left_semi"), _sent(self.df), self.stats, self.norms)


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_SENT else df


def build_text_terms(counts: DataFrame, path: str) -> None:
    """Write the term counts (id, term, tf, len) below ``path`` with what weights need; only sums are shuffled."""

    def put(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")

    counts = put(counts, "counts")
    df = put(document_frequency(counts), "df")
    put(norms_of(raw_weights(counts, _sent(df), put(corpus_stats(counts), "stats"))), "norms")


def open_text_terms(spark: SparkSession, path: str, id_type: str = "bigint") -> TextTerms:
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    return TextTerms(read("counts", f"id {id_type}, term string, tf bigint, len int"), read("df", "term string, df bigint"), read("stats", STATS_SCHEMA), read("norms", f"id {id_type}, norm double"))


def ranked(scores: DataFrame, k: int, score: str, tie: str, by: list[str] | None = None) -> DataFrame:
    """The k best per query with their rank from 1; equal scores (to six places) are ordered by ``tie``."""
    w = Window.partitionBy(*(by or [])).orderBy(F.desc(F.round(score, 6)), F.asc(tie)) if by else None
    if w is None:
        top = scores.orderBy(F.desc(F.round(score, 6)), F.asc(tie)).limit(k)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round(score, 6)), F.asc(tie))))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sparse_scores(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, id, score): dot products over shared terms. queries: (query_id, term, weight)."""
    return queries.withColumnRenamed("weight", "q_weight").join(postings, "term").groupBy("query_id", "id").agg(F.sum(F.col("q_weight") * F.col("weight")).alias("score"))


#: Question-term postings and questions that meet in one task.
POSTINGS_PER_PART, QUESTIONS_PER_BLOCK = 1_000_000, 50_000


def sparse_best(queries: DataFrame, postings: DataFrame, k: int, per_part: int = POSTINGS_PER_PART, block: int = QUESTIONS_PER_BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the k best of every query, as ``sparse_scores`` and ``ranked`` give them.

    queries (query_id, term, weight) are many. They are cut into blocks and the texts into parts;
    each pair of them meets in one task, which scores every text of the part that shares a term
    with a query and keeps the k best, so what is shuffled follows the postings and the queries,
    not the texts that share a term with a query.
    """
    queries = queries.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.select("query_id").distinct().count() // block)))).cast("int"))
    blocks = queries.agg(F.coalesce(F.max("b"), F.lit(0))).first()[0] + 1
    parts = max(postings.sparkSession.sparkContext.defaultParallelism, -(-postings.count() // per_part))
    slot = lambda p: (F.col("b") * F.lit(parts) + p).cast("int").alias("slot")
    left = queries.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(slot(F.col("p")), F.lit(0).alias("side"), F.col("query_id").alias("id"), "term", "weight")
    right = postings.join(queries.select("b", "term").distinct(), "term").select(slot(F.pmod(F.xxhash64("id"), F.lit(parts))), F.lit(1).alias("side"), "id", "term", "weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (read := list(batches)):
            return
        held = pa.Table.from_batches(read)
        term = held["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        side, ids, weight = (held[c].to_numpy() for c in ("side", "id", "weight"))
        del held, read
        asked, there = side == 0, side == 1
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if asked.any() and there.any():
            names, text = np.unique(ids[there], return_inverse=True)
            # Postings by term; a term stands once for a text.
            pair, place = np.unique(term[there].astype(np.int64) * len(names) + text, return_inverse=True)
            w = np.bincount(place, weights=weight[there])
            edges = np.searchsorted(pair, np.arange(int(term.max()) + 2, dtype=np.int64) * len(names))
            at = pair % len(names)
            order = np.argsort(ids[asked], kind="stable")
            q_ids, q_term, q_weight = ids[asked][order], term[asked][order], weight[asked][order]
            starts = np.append(np.flatnonzero(np.append(True, q_ids[1:] != q_ids[:-1])), len(q_ids))
            score = np.zeros(-(-len(names) // 64) * 64)
            for a, z in zip(starts[:-1].tolist(), starts[1:].tolist()):
                score.fill(0.0)
                for t, x in zip(q_term[a:z].tolist(), q_weight[a:z].tolist()):
                    where = slice(edges[t], edges[t + 1])
                    score[at[where]] += x * w[where]
                # The k-th of the blocks' best bounds the k-th best; scores that round alike are near it.
                top = score.reshape(-1, 64).max(axis=1)
                least = np.partition(top, -k)[-k] if len(top) > k else 0.0
                i = np.flatnonzero((score >= least - 2e-6) & (score > 0))
                i = i[np.lexsort((names[i], -score[i].round(6)))[:k]]
                out.append((np.full(len(i), q_ids[a]), names[i], score[i]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "id", "score"])

    placed = left.unionByName(right).repartitionById(blocks * parts, F.col("slot"))
    found = placed.select("side", "id", "term", "weight").mapInArrow(run, "query_id bigint, id bigint, score double")
    return ranked(found, k, "score", "id", ["query_id"])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is all zeros."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def dense_scores(vectors: DataFrame, queries: DataFrame, least: float | None = None, k: int | None = None, block: int = 2_000) -> DataFrame:
    """(query_id, id, score): cosine of every query with every vector.

    queries (query_id, embedding) is a stated set. It is cut into blocks of about ``block`` rows and
    the vectors into parts; each pair of them meets in one task, which keeps the block and streams
    the part past it, so a vector travels once a block of queries and no row holds more than itself.
    With ``least`` only scores of at least that remain, with ``k`` the best k of each query in a
    part (equal ones, to six places, by id), so little leaves a task. A null vector meets nothing.
    """
    usable = "embedding is not null and size(embedding) > 0"
    q, v = queries.where(usable).select("query_id", "embedding"), vectors.where(usable).select("id", "embedding")
    blocks = max(1, -(-q.count() // block))
    parts = max(1, v.sparkSession.sparkContext.defaultParallelism // blocks)
    left = q.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), F.lit(0).alias("side"), F.col("query_id").alias("id"), "embedding")
    right = v.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("p"), F.lit(1).alias("side"), "id", "embedding")

    def unit(rows: list) -> np.ndarray:
        m = np.array(rows, dtype=float)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def best(f: pd.DataFrame) -> pd.DataFrame:
        if k is None or f.empty:
            return f
        f = f.assign(_r=-f["score"].round(6)).sort_values(["query_id", "_r", "id"])
        return f.groupby("query_id").head(k).drop(columns="_r")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, held, matrix, found = None, [], [], None, []
        for f in frames:
            for key, g in f.groupby(["b", "p"], sort=False):
                if key != at:
                    if found:
                        yield best(pd.concat(found))
                    at, ids, held, matrix, found = key, [], [], None, []
                own = g[g["side"] == 0]
                ids += own["id"].tolist()
                held += own["embedding"].tolist()
                g = g[g["side"] == 1]
                if not held or g.empty:
                    continue
                matrix = unit(held) if matrix is None else matrix
                s = matrix @ unit(g["embedding"].tolist()).T
                i, j = np.nonzero(s >= (least if least is not None else -2))
                found.append(pd.DataFrame({"query_id": np.array(ids)[i], "id": g["id"].to_numpy()[j], "score": s[i, j]}))
                if k is not None:
                    found = [best(pd.concat(found))]
                elif len(found) > 8:
                    yield pd.concat(found)
                    found = []
        if found:
            yield best(pd.concat(found))

    placed = left.unionByName(right).repartition("b", "p").sortWithinPartitions("b", "p", "side")
    return placed.mapInPandas(run, "query_id bigint, id bigint, score double")


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = 2) -> DataFrame:
    """(query_id, id, score): sum of 1 / (k + rank - 1) over ranked lists (query_id, id, rank)."""
    every = lists[0].select("query_id", "id", "rank")
    for x in lists[1:]:
        every = every.unionAll(x.select("query_id", "id", "rank"))
    return every.groupBy("query_id", "id").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank") - 1)).alias("score"))


def lexical_hybrid(results: DataFrame, query_text: str = "query_text", text: str = "text", weight: float = LEXICAL_WEIGHT, floor: float | None = SCORE_FLOOR) -> DataFrame:
    """Adds lexical_score and hybrid_score; results under the floor are left out first.

    A query without tokens keeps its scores: hybrid_score is then null.
    """
    w = min(max(weight, 0.0), 1.0)
    if floor is not None:
        results = results.where(F.col("score") >= floor)
    q = T.token_set(F.col(query_text))
    lex = T.jaccard(q, T.token_set(F.col(text)))
    usable = (F.size(q) > 0) & F.lit(w > 0)
    return results.withColumn("lexical_score", F.when(usable, lex)).withColumn("hybrid_score", F.when(usable, F.col("score") * (1 - w) + lex * w))


def diversified(results: DataFrame, most: float = MOST_ALIKE) -> DataFrame:
    """Greedy per query in rank order: a result stays if no kept one is more alike than ``most``.

    Results without tokens always stay. results: (query_id, id, rank, text), a few per query.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        kept: list[set[str]] = []
        keep = []
        f = f.sort_values("rank")
        for toks in f["tokens"]:
            t = set(toks)
            ok = not t or all(not o or len(t & o) / len(t | o) <= most for o in kept)
            keep.append(ok)
            if ok:
                kept.append(t)
        out = f[keep].copy()
        out["kept_rank"] = range(1, len(out) + 1)
        return out[["query_id", "id", "rank", "kept_rank"]]

    rows = results.select("query_id", "id", "rank", T.token_set(F.coalesce("text", F.lit(""))).alias("tokens"))
    return rows.groupBy("query_id").applyInPandas(run, "query_id bigint, id bigint, rank int, kept_rank int")


def precision_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """Hits among the first k, divided by k; repeats count; 0 without relevant ones."""
    hits = F.size(F.filter(F.slice(retrieved, 1, k), lambda x: F.array_contains(relevant, x)))
    return F.when((F.size(relevant) == 0) | F.lit(k <= 0), F.lit(0.0)).otherwise(hits / F.lit(float(max(k, 1))))


def recall_at(retrieved: Column, relevant: Column, k: int) -> Column:
    rel = F.array_distinct(relevant)
    return F.when(F.size(rel) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(F.slice(retrieved, 1, k), rel)) / F.size(rel))
