"""Filling containers of fixed capacity, shortest pack first over the histogram of lengths.

Only the histogram (at most ``capacity`` rows, whatever the input) reaches the driver. Lengths
are placed longest first: always into the packs with most room left, several equal packs at a
time, so the result is a list of patterns with counts. Each pattern takes a range of ranks of
each length it holds; items get a rank within their length and look their container up. An
item above the capacity is cut into full containers and a rest, which is packed like an item.

Items of size 0, null or less take no container and are left out. Equal rows keep their own
places (they rank apart); an id that occurs twice gets two places.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from corvina.llm.encoding import TOKENIZERS, token_counts
from corvina.session import table, written

CAPACITY = 2048
#: Items of one length that are ranked in one task.
RANKED = 500_000


def plan_packs(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how many packs, lengths in each) by shortest-pack-first."""
    # (room, order, lengths, packs); the pack with most room is first.
    packs: list[tuple[int, int, tuple[int, ...], int]] = []
    order = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if packs and -packs[0][0] >= length:
                room, _, held, n = heapq.heappop(packs)
                take = min(n, left)
                if take < n:
                    heapq.heappush(packs, (room, order, held, n - take))
                    order += 1
                heapq.heappush(packs, (room + length, order, (*held, length), take))
            else:
                # Open no more packs than are sure to be needed, so that short items fill each other's packs.
                per = capacity // length
                take = -(-left // per) if per > 1 else left
                heapq.heappush(packs, (length - capacity, order, (length,), take))
            order += 1
            left -= take
    return [(n, held) for _, _, held, n in sorted(packs, key=lambda p: (p[2], p[1]))]


class Places:
    """The container and offset of the r-th item of each length."""

    def __init__(self, packs: list[tuple[int, tuple[int, ...]]]):
        self.starts: dict[int, list[int]] = {}
        self.where: dict[int, list[tuple[int, int, int]]] = {}
        used: dict[int, int] = {}
        base = 0
        for n, held in packs:
            at = 0
            for length in held:
                first = used.get(length, 0)
                self.starts.setdefault(length, []).append(first)
                self.where.setdefault(length, []).append((base, first, at))
                used[length] = first + n
                at += length
            base += n
        self.containers = base

    def find(self, length: int, rank: int) -> tuple[int, int]:
        base, first, at = self.where[length][bisect_right(self.starts[length], rank) - 1]
        return base + rank - first, at


def pack(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """(container_id, offset, doc_id, piece, start, n_tokens): where each piece of each item lies.

    ``start`` is the piece's first token in its item, ``offset`` its place in the container.
    Full pieces of items above the capacity have containers of their own after the others.
    """
    kind = sizes.schema[id_col].dataType.simpleString()
    items = sizes.select(F.col(id_col).alias("doc_id"), F.col(size_col).cast("bigint").alias("size")).where("size > 0")
    items = items.select("doc_id", "size", (F.col("size") % capacity).alias("rest"), F.floor(F.col("size") / capacity).alias("full"))
    total = sizes.sparkSession.sparkContext.defaultParallelism
    counted = items.groupBy("rest").agg(F.count(F.lit(1)).alias("n")).where("rest > 0")
    histogram = {r["rest"]: r["n"] for r in counted.collect()}  # below ``capacity`` rows
    places = Places(plan_packs(histogram, capacity))
    salts = max(total, -(-max(histogram.values(), default=1) // RANKED))

    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    before = Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("rest", "salt").agg(F.count(F.lit(1)).alias("m")).withColumn("start", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    within = Window.partitionBy("rest", "salt").orderBy("doc_id", "size")
    ranked = (
        salted.where("rest > 0")
        .withColumn("nth", F.row_number().over(within) - 1)
        .join(starts, ["rest", "salt"])
        .select("doc_id", "rest", (F.col("size") - F.col("rest")).alias("start"), F.col("full").cast("int").alias("piece"), (F.col("start") + F.col("nth")).alias("rank"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, ranks = b.column("rest").to_pylist(), b.column("rank").to_pylist()
            found = np.array([places.find(n, r) for n, r in zip(lengths, ranks)], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[:, 0]), pa.array(found[:, 1].astype(np.int32)), b.column("doc_id"), b.column("piece"), b.column("start"), b.column("rest").cast(pa.int32())],
                names=["container_id", "offset", "doc_id", "piece", "start", "n_tokens"],
            )

    rests = ranked.mapInArrow(run, f"container_id bigint, offset int, doc_id {kind}, piece int, start bigint, n_tokens int")
    # Full pieces: one container each, numbered by item through running totals of salted groups.
    large = items.where("full > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    ahead = Window.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    salt_starts = large.groupBy("salt").agg(F.sum("full").alias("m")).withColumn("salt_start", F.coalesce(F.sum("m").over(ahead), F.lit(0))).drop("m")
    own = Window.partitionBy("salt").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    fulls = (
        large.withColumn("before", F.coalesce(F.sum("full").over(own), F.lit(0)))
        .join(salt_starts, "salt")
        .select("doc_id", "before", "salt_start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("k"))
        .select(
            (F.lit(places.containers) + F.col("salt_start") + F.col("before") + F.col("k")).alias("container_id"),
            F.lit(0).alias("offset"),
            "doc_id",
            F.col("k").cast("int").alias("piece"),
            (F.col("k") * capacity).alias("start"),
            F.lit(capacity).alias("n_tokens"),
        )
    )
    return rests.unionByName(fulls)


def p8_packed(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return pack(written(token_counts(table(spark, sf_dir, "documents"), tokenizers=tokenizers)))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of the capacity that is used."""
    packed = p8_packed(spark, sf_dir)
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.round(F.sum("used") / (F.count(F.lit(1)) * CAPACITY), 6).alias("fill"), F.max("used").alias("fullest"))


QUERIES = {"p8_packed": p8_packed, "p8_fill": p8_fill}
ORACLES: dict[str, str] = {}
