"""Operators on the relational tables: filters, joins, latest rows, counts, upserts and deletes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Every state of a document, in order, with its progress in per cent (fixed values).
PHASE_PROGRESS = {"uploaded": 0, "parsing": 10, "chunking": 25, "embedding": 45, "vector_indexing": 65, "graph_indexing": 80, "completed": 100, "error": 100}
SCHEDULABLE = ("uploaded", "error")


def owned(df: DataFrame, user: str | None, column: str = "created_by") -> DataFrame:
    """Rows of one tenant; None sees all."""
    return df if user is None else df.where(F.col(column) == user)


def page(df: DataFrame, order: Sequence[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of an ordering; the limit is held within 1 and 200."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(limit, 1), 200))


def filtered(df: DataFrame, conditions: Sequence[Column | None]) -> DataFrame:
    """Conditions that are given, all at once."""
    for c in conditions:
        if c is not None:
            df = df.where(c)
    return df


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``; ties go to the greatest remaining columns.

    An aggregate, not a window: rows are combined before the shuffle, so a hot key is small.
    """
    rest = [c for c in df.columns if c not in keys]
    first = [c for c in order if c in rest]
    ordered = first + [c for c in rest if c not in first]
    top = df.groupBy(*keys).agg(F.max(F.struct(*ordered)).alias("_top"))
    return top.select(*keys, *[F.col(f"_top.{c}").alias(c) for c in rest]).select(*df.columns)


def current_chunks(chunks: DataFrame) -> DataFrame:
    """The last ingestion of each chunk of a document.

    Only keys are compared and shuffled; the texts stay where they are read, less the few chunks
    that a later ingestion replaced.
    """
    keys = chunks.select("document_id", "chunk_index", F.struct("created_at", "chunk_id").alias("_at"))
    newest = keys.groupBy("document_id", "chunk_index").agg(F.max("_at").alias("_newest"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    newest = newest.select(F.col("document_id").alias("_d"), F.col("chunk_index").alias("_i"), "_newest")
    same = F.col("document_id").eqNullSafe(F.col("_d")) & F.col("chunk_index").eqNullSafe(F.col("_i"))
    replaced = keys.join(newest, same).where(F.col("_at") != F.col("_newest")).select(F.col("_at.chunk_id").alias("chunk_id"))
    return chunks.join(replaced, "chunk_id", "left_anti").select(*chunks.columns)


def zero_filled(df: DataFrame, column: str, domain: Sequence[str], name: str = "n") -> DataFrame:
    """Counts for a fixed domain, zeros included."""
    every = df.sparkSession.createDataFrame([(d,) for d in domain], f"{column} string")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias(name))
    return F.broadcast(every).join(counts, column, "left").select(column, F.coalesce(name, F.lit(0)).cast("bigint").alias(name))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_first: Sequence[str] = ()) -> DataFrame:
    """MERGE by key: columns of ``keep_first`` stay as first seen, others take the newer value."""
    cols = [c for c in old.columns if c not in keys]
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_seq", F.lit(1)))
    pick = [(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_seq"))) if c in keep_first else F.max_by(c, "_seq")).alias(c) for c in cols]
    return both.groupBy(*keys).agg(*pick).select(*old.columns)


def without(df: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not among those deleted."""
    return df.join(gone.select(on).distinct(), on, "left_anti")


def hash_duplicates(docs: DataFrame, owner: str, digest: str, order: Sequence[str]) -> DataFrame:
    """Marks all but the first upload of a content per owner; rows without a hash are first."""
    keyed = docs.where(F.col(digest).isNotNull())
    first = keyed.groupBy(F.col(owner).alias("_owner"), F.col(digest).alias("_digest")).agg(F.min(F.struct(*order)).alias("_first"))
    same = F.col(owner).eqNullSafe(F.col("_owner")) & (F.col(digest) == F.col("_digest"))
    marked = keyed.join(first, same, "left").select(*docs.columns, (F.struct(*order) != F.col("_first")).alias("is_duplicate"))
    return marked.unionByName(docs.where(F.col(digest).isNull()).withColumn("is_duplicate", F.lit(False)))


def numbered(df: DataFrame, order: Sequence[str], name: str = "id", start: int = 1) -> DataFrame:
    """Consecutive numbers over all rows in order, without one task that sorts them all.

    Rows are range-partitioned; each partition's offset comes from the counts before it.
    """
    from corvina.session import written

    parted = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parted.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    nth = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parted.withColumn("_nth", nth).join(F.broadcast(offsets), "_p").withColumn(name, (F.col("_before") + F.col("_nth") + start - 1).cast("bigint")).drop("_p", "_nth", "_before")
