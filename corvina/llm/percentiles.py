"""Exact, mergeable percentiles per group by bisection of value intervals.

``value_counts`` reduces the rows to (group, value, count); such tables from other days or
partitions combine by adding counts. ``percentiles`` keeps one value interval per group and
percentile, counts the rows below the midpoints in each pass and narrows every interval until
the target rank is resolved to a single value. Four levels of bisection are answered per pass.

The error is bounded by ``resolution``: values are counted as integers of that step, so with
integer data and resolution 1 the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from corvina.session import checkpointed, table, written

SPLITS = 16


def value_counts(rows: DataFrame, groups: Sequence[str], value: str | Column, resolution: float = 1.0) -> DataFrame:
    """(groups..., step bigint, n bigint): how often each value occurs, partially summed before the shuffle.

    Null and NaN values are left out; rows whose group columns are null form a group of their own.
    """
    v = F.col(value) if isinstance(value, str) else value
    step = F.round(v / F.lit(resolution)).cast("bigint")
    return (
        rows.where(v.isNotNull() & ~F.isnan(v.cast("double")))
        .groupBy(*groups, step.alias("step"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def combine_counts(tables: Sequence[DataFrame], groups: Sequence[str]) -> DataFrame:
    """Counts of several days or partitions added up."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(*groups, "step").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, groups: Sequence[str], wanted: Sequence[float], resolution: float = 1.0) -> DataFrame:
    """(groups..., percentile double, value double, n bigint) from a ``value_counts`` table.

    The value is that of rank ceil(percentile * n) in ascending order (the lower median for 0.5).
    An empty table gives no rows; ties are one value with a count; a group of one row gives that row.
    """
    bad = [p for p in wanted if not 0 < p <= 1]
    if bad:
        raise ValueError(f"percentiles must be in (0, 1]: {bad}")
    keys = [f"_g{i}" for i in range(len(groups))]
    base = counts.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], "step", "n")
    state = (
        base.groupBy(*keys)
        .agg(F.min("step").alias("lo"), F.max("step").alias("hi"), F.sum("n").alias("total"))
        .select("*", F.explode(F.array(*[F.lit(float(p)) for p in wanted])).alias("p"))
        .withColumn("rank", F.ceil(F.round(F.col("p") * F.col("total"), 9)).cast("bigint"))
        .withColumn("rank", F.greatest(F.lit(1), F.least("rank", "total")))
        .withColumn("below", F.lit(0).cast("bigint"))
    )
    state = checkpointed(state)
    while (width := state.agg(F.max(F.col("hi") - F.col("lo"))).first()[0]) is not None and width > 0:
        s, b = state.where("hi > lo").alias("s"), base.alias("b")
        size = F.ceil((F.col("s.hi") - F.col("s.lo") + 1) / F.lit(SPLITS)).cast("bigint")
        part = F.floor((F.col("b.step") - F.col("s.lo")) / size).cast("bigint")
        found = (
            s.join(b, _same("s", "b", keys) & F.col("b.step").between(F.col("s.lo"), F.col("s.hi")))
            .groupBy(*[F.col(f"s.{k}").alias(k) for k in keys], F.col("s.p").alias("p"), part.alias("part"))
            .agg(F.sum("b.n").alias("m"), F.first("s.lo").alias("lo"), F.first("s.hi").alias("hi"), F.first("s.total").alias("total"), F.first("s.rank").alias("rank"), F.first("s.below").alias("below"))
        )
        w = Window.partitionBy(*keys, "p").orderBy("part")
        size = F.ceil((F.col("hi") - F.col("lo") + 1) / F.lit(SPLITS)).cast("bigint")
        narrowed = (
            found.withColumn("upto", F.col("below") + F.sum("m").over(w))
            .where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("m") < F.col("rank")))
            .select(
                *keys,
                (F.col("lo") + F.col("part") * size).alias("lo"),
                F.least("hi", F.col("lo") + (F.col("part") + 1) * size - 1).alias("hi"),
                "total",
                "p",
                "rank",
                (F.col("upto") - F.col("m")).alias("below"),
            )
        )
        state = checkpointed(state.where("hi = lo").unionByName(narrowed))
    return state.select(
        *[F.col(k).alias(g) for g, k in zip(groups, keys)],
        F.col("p").alias("percentile"),
        (F.col("lo") * F.lit(float(resolution))).alias("value"),
        F.col("total").alias("n"),
    )


def _same(a: str, b: str, keys: Sequence[str]) -> Column:
    return _all([F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


GROUPS = ("log_day", "source", "intent")


def latency_counts(logs: DataFrame) -> DataFrame:
    """Counts of measured latencies (above 0) per UTC day, source and intent, each log_id once.

    Rows without an intent form groups of their own; p6_found alone leaves them out.
    """
    once = logs.where("latency_ms > 0").select("log_id", F.date_format("created_at", "yyyy-MM-dd").alias("log_day"), F.lower(F.trim("source")).alias("source"), "intent", "latency_ms")
    # Repeated deliveries agree in every column, so any copy stands for the others.
    once = once.groupBy("log_id").agg(*[F.first(c).alias(c) for c in (*GROUPS, "latency_ms")])
    return value_counts(once, GROUPS, "latency_ms")


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles(written(latency_counts(table(spark, sf_dir, "query_logs"))), GROUPS, (0.5, 0.9, 0.99))


def p6_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per source and intent, combined from the counts of single days."""
    days = written(latency_counts(table(spark, sf_dir, "query_logs")))
    groups = ("source", "intent")
    return percentiles(combine_counts([days.drop("log_day")], groups), groups, (0.5, 0.9, 0.99))


def p6_found(spark: SparkSession, sf_dir: str, least: int = 5, limit_ms: float = 6000.0) -> DataFrame:
    counts = written(latency_counts(table(spark, sf_dir, "query_logs").where("intent is not null")))
    return percentiles(counts, GROUPS, (0.5,)).where((F.col("n") >= least) & (F.col("value") > limit_ms)).select(*GROUPS)


QUERIES = {"p6_found": p6_found, "p6_percentiles": p6_percentiles, "p6_combined": p6_combined}

_ONCE = """once AS (SELECT DISTINCT log_id, strftime(created_at, '%Y-%m-%d') AS log_day, lower(trim(source)) AS source, intent, latency_ms
FROM query_logs WHERE latency_ms > 0)"""
_PER = """SELECT {g}, CAST(p.percentile AS DOUBLE) AS percentile, CAST(min(o.latency_ms) FILTER (o.rk >= ceil(round(p.percentile * o.n, 9))) AS DOUBLE) AS value, max(o.n) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY latency_ms) AS rk, count(*) OVER (PARTITION BY {g}) AS n FROM once) o,
(VALUES (0.5e0), (0.9e0), (0.99e0)) p(percentile) GROUP BY {g}, p.percentile"""
ORACLES = {
    "p6_found": f"""WITH {_ONCE} SELECT log_day, source, intent FROM once WHERE intent IS NOT NULL GROUP BY log_day, source, intent
HAVING count(*) >= 5 AND quantile_disc(latency_ms, 0.5) > 6000""",
    "p6_percentiles": f"WITH {_ONCE} " + _PER.format(g="log_day, source, intent"),
    "p6_combined": f"WITH {_ONCE} " + _PER.format(g="source, intent"),
}
