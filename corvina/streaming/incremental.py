"""Statistics kept up to date as documents come and go, and windows over event time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvina.operators import retrieval as R
from corvina.plans.search import tokens_sql
from corvina.session import shared_folder, table


def delta_of(chunks: DataFrame, sign: int = 1) -> DataFrame:
    """(term, df, chunks, tokens): what a set of chunks adds to, or takes from, the statistics."""
    terms = R.term_counts(chunks, "chunk_id", F.col("text"))
    per_term = terms.groupBy("term").agg((F.count(F.lit(1)) * sign).alias("df")).select("term", "df", F.lit(0).cast("bigint").alias("chunks"), F.lit(0).cast("bigint").alias("tokens"))
    totals = terms.groupBy("id").agg(F.max("len").alias("len")).agg((F.count(F.lit(1)) * sign).alias("chunks"), (F.coalesce(F.sum("len"), F.lit(0)) * sign).alias("tokens"))
    return per_term.unionByName(totals.select(F.lit("").alias("term"), F.lit(0).cast("bigint").alias("df"), "chunks", "tokens"))


def current(deltas: DataFrame) -> DataFrame:
    """Deltas added up; counts never fall below 0. The row with an empty term holds the totals."""
    total = deltas.groupBy("term").agg(*[F.greatest(F.sum(c), F.lit(0)).alias(c) for c in ("df", "chunks", "tokens")])
    return total.where("term = '' or df > 0")


def needs_rebuild(cached: int | None, actual: int, tolerance: int = 5) -> bool:
    """Whether counted chunks are missing or have drifted by more than the tolerance."""
    return cached is None or abs(actual - cached) > tolerance


def maintain(spark: SparkSession, source: str, state: str, checkpoint: str, schema) -> None:
    """Follow a folder of chunk files and append each micro-batch's delta to the table at ``state``.

    A batch that is replayed after a failure overwrites its own partition, so nothing counts twice.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        delta_of(batch).write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(source)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def event_counts(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events per type in tumbling windows of event time; rows later than ``late`` are left out of a stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    counts = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return event_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def streaming_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """The same counts from a stream: each micro-batch updates its windows in the shared folder."""
    base = f"{shared_folder(spark)}/corvina-stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{base}/out/part={batch_id}")

    event_counts(stream).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out").drop("part")
    newest = out.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return newest.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "x.n", "x.total")


def incremental_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics after all chunks were added and those of failed documents taken away again."""
    chunks = table(spark, d, "chunks").where("text is not null").select("chunk_id", "document_id", "text")
    gone = chunks.join(table(spark, d, "documents").where("status = 'error' or doc_id % 10 = 0").select(F.col("doc_id").alias("document_id")), "document_id", "left_semi")
    return current(delta_of(chunks).unionByName(delta_of(gone, -1)))


QUERIES = {f.__name__: f for f in (event_windows, streaming_event_windows, incremental_stats)}
_W = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
_I = f"""WITH gone AS (SELECT doc_id FROM documents WHERE status = 'error' OR doc_id % 10 = 0), tok AS (SELECT chunk_id, {tokens_sql('text')} AS t FROM chunks WHERE text IS NOT NULL AND document_id NOT IN (FROM gone)),
terms AS (SELECT DISTINCT chunk_id, unnest(t) AS term FROM tok) SELECT term, count(*) AS df, 0 AS chunks, 0 AS tokens FROM terms GROUP BY term UNION ALL SELECT '', 0, count(*), CAST(sum(len(t)) AS BIGINT) FROM tok WHERE len(t) > 0"""
ORACLES = {"event_windows": _W, "streaming_event_windows": _W, "incremental_stats": _I}
