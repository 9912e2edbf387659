"""Graph operators: components of links, expansion, resolution and communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from corvina.functions import text as T
from corvina.session import written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component): the least id of each connected component, for every id in an edge.

    Large-star/small-star contraction: edges are rewired to ever smaller neighbours until
    nothing changes, which takes a number of rounds logarithmic in the longest chain.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    e = written(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # Large star: larger neighbours of a node go to its smallest neighbour.
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: smaller neighbours and the node itself go to the smallest of them.
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        e = written(small.where("a <> b").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component").unionAll(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge (edge_id, src, type, dst) in both directions."""
    return edges.unionByName(edges.select("edge_id", F.col("dst").alias("src"), "type", F.col("src").alias("dst")))


def trails(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(start, edge_id): edges on paths of up to ``depth`` steps that use no edge twice.

    starts: (start). One join a step; a path carries the edges it has used.
    """
    if not 1 <= depth <= 3:
        raise ValueError("the depth must be 1, 2 or 3")
    both = undirected(edges).select("edge_id", F.col("src").alias("here"), F.col("dst").alias("next"))
    paths = starts.select("start", F.col("start").alias("here"), F.array().cast("array<string>").alias("used"))
    found = None
    for _ in range(depth):
        paths = paths.join(both, "here").where(~F.array_contains("used", F.col("edge_id"))).select("start", F.col("next").alias("here"), F.concat("used", F.array("edge_id")).alias("used"))
        step = paths.select("start", F.element_at("used", -1).alias("edge_id"))
        found = step if found is None else found.unionAll(step)
    return found.distinct()


def neighbour_facts(mentions: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(chunk_id, source, rel_type, target): relations of the entities a chunk mentions, as matched."""
    names = entities.select("id", "name")
    hit = mentions.select("chunk_id", F.col("entity_id").alias("src")).join(undirected(edges), "src")
    hit = hit.join(names.select(F.col("id").alias("src"), F.col("name").alias("source")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("target")), "dst")
    return hit.select("chunk_id", "source", F.col("type").alias("rel_type"), "target")


def first_by_key(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key (expressions) by ``order`` (columns)."""
    named = [(k if not isinstance(k, str) else F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)]
    rest = [c for c in rows.columns if c not in order]
    top = rows.groupBy(*named).agg(F.min(F.struct(*order, *rest)).alias("_top"))
    return top.select(*[F.col(f"_top.{c}").alias(c) for c in rows.columns])


def similar_pairs(vectors: DataFrame, threshold: float, block: int = 1000) -> DataFrame:
    """(id_a, id_b, score), id_a < id_b: cosine above ``threshold`` within a type.

    vectors: (id, type, embedding). A type is cut into blocks of about ``block`` vectors that
    meet in pairs, so no task holds a whole type; only pairs above the threshold leave a task.
    """
    import numpy as np
    import pandas as pd

    sizes = vectors.groupBy("type").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    placed = vectors.join(sizes, "type").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    keyed = every.select("id", "type", "embedding", "b", F.least("b", "other").alias("x"), F.greatest("b", "other").alias("y"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x, y = f["x"].iloc[0], f["y"].iloc[0]
        left = f[f["b"] == x]
        right = f[f["b"] == y]
        if left.empty or right.empty:
            return pd.DataFrame({"id_a": [], "id_b": [], "score": []})
        unit = lambda g: (lambda v: v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, 1))(np.array(g["embedding"].tolist(), dtype=float))
        s = unit(left) @ unit(right).T
        i, j = np.nonzero(s > threshold)
        a, b = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
        keep = a < b if x == y else a != b
        return pd.DataFrame({"id_a": np.minimum(a, b)[keep], "id_b": np.maximum(a, b)[keep], "score": s[i, j][keep]})

    return keyed.groupBy("type", "x", "y").applyInPandas(run, "id_a bigint, id_b bigint, score double")


def canonical_of(groups: DataFrame, names: DataFrame) -> DataFrame:
    """(id, canonical_id): in each component the entity with the shortest name, then the least id.

    groups: (id, component); names: (id, name).
    """
    g = groups.join(names, "id")
    best = g.groupBy("component").agg(F.min(F.struct(F.length("name").alias("l"), F.col("id").alias("canonical_id"))).alias("best"))
    return g.join(best, "component").select("id", F.col("best.canonical_id").alias("canonical_id"))


def merged_edges(edges: DataFrame, canonical: DataFrame) -> DataFrame:
    """Edges (src, type, dst) after entities were merged; loops that a merge makes are dropped."""
    m = canonical.select(F.col("id").alias("src"), F.col("canonical_id").alias("new_src"))
    n = canonical.select(F.col("id").alias("dst"), F.col("canonical_id").alias("new_dst"))
    out = edges.join(m, "src", "left").join(n, "dst", "left")
    out = out.select(F.coalesce("new_src", "src").alias("src"), "type", F.coalesce("new_dst", "dst").alias("dst"))
    return out.where("src <> dst").distinct()


def communities(edges: DataFrame, nodes: DataFrame | None = None, resolution: float = 1.0, least_gain: float = 1e-3) -> DataFrame:
    """(id, leaf, root): communities by moving nodes to where modularity gains most, then contracting.

    A cycle lets the nodes of two halves (by hash, other halves each cycle) move in turns, so that
    neighbours do not swap places; each turn is joins and aggregates over the edge table. A level
    ends when a cycle raises modularity by less than ``least_gain``, the hierarchy when a level
    does. ``leaf`` is the first level, ``root`` the last; where nothing merges they are the same.
    Labels are the least node id. Nodes (id) without an edge are communities of their own.
    """
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().withColumn("w", F.lit(1.0))
    e = written(e)
    total = e.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    ends = e.select(F.col("a").alias("id")).unionAll(e.select(F.col("b").alias("id")))
    assigned = written(ends.distinct().select("id", F.col("id").alias("leaf"), F.col("id").alias("root")))
    level, reached = 0, None
    while total:
        both = written(e.where("a <> b").select("a", "b", "w").unionAll(e.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
        loops = e.where("a = b").select("a", (F.col("w") * 2).alias("w"))
        degree = both.select("a", "w").unionAll(loops).groupBy("a").agg(F.sum("w").alias("k"))
        label = written(degree.select(F.col("a").alias("id"), "k", F.col("a").alias("c")))
        began = best_seen = _modularity(e, label, total, resolution)
        kept, cycle = label, 0
        while True:
            for half in (0, 1):
                label = _turn(both, label, F.pmod(F.xxhash64("a", F.lit(level), F.lit(cycle)), F.lit(2)) == half, total, resolution)
            now = _modularity(e, label, total, resolution)
            gained = now - best_seen
            if gained > 0:
                kept, best_seen = label, now
            cycle += 1
            if gained < least_gain:
                break
        if level and best_seen - began < least_gain:
            break
        names = kept.groupBy("c").agg(F.min("id").alias("name"))
        renamed = written(kept.join(names, "c").select("id", "name"))
        step = assigned.join(renamed.withColumnRenamed("id", "root"), "root")
        assigned = written(step.select("id", (F.col("name") if level == 0 else F.col("leaf")).alias("leaf"), F.col("name").alias("root")))
        ra, rb = renamed.select(F.col("id").alias("a"), F.col("name").alias("x")), renamed.select(F.col("id").alias("b"), F.col("name").alias("y"))
        e = written(e.join(ra, "a").join(rb, "b").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w")))
        level += 1
    if nodes is None:
        return assigned
    alone = nodes.select("id").distinct().join(assigned, "id", "left_anti")
    return assigned.unionByName(alone.select("id", F.col("id").alias("leaf"), F.col("id").alias("root")))


def _turn(both: DataFrame, label: DataFrame, may_move: Column, total: float, resolution: float) -> DataFrame:
    """Labels (id, k, c) after the nodes that may move went where the gain is greatest."""
    size = label.groupBy("c").agg(F.sum("k").alias("tot"))
    near = both.where(may_move).join(label.select(F.col("id").alias("b"), F.col("c").alias("d")), "b").groupBy("a", "d").agg(F.sum("w").alias("links"))
    own = label.select(F.col("id").alias("a"), "k", "c")
    # Staying is an option even where no neighbour shares the community.
    options = near.unionAll(own.select("a", F.col("c").alias("d"), F.lit(0.0).alias("links"))).groupBy("a", "d").agg(F.sum("links").alias("links"))
    scored = options.join(own, "a").join(size.withColumnRenamed("c", "d"), "d")
    rest = F.col("tot") - F.when(F.col("d") == F.col("c"), F.col("k")).otherwise(F.lit(0.0))
    scored = scored.withColumn("gain", F.round(F.col("links") - resolution * F.col("k") * rest / (2 * total), 9))
    best = scored.groupBy("a").agg(F.max(F.struct("gain", (F.col("d") == F.col("c")).alias("stay"), F.xxhash64("d").alias("h"), "d")).alias("best"), F.first("k").alias("k"))
    return written(best.select(F.col("a").alias("id"), "k", F.col("best.d").alias("c")))


def _modularity(e: DataFrame, label: DataFrame, total: float, resolution: float) -> float:
    at = lambda end, name: label.select(F.col("id").alias(end), F.col("c").alias(name))
    inner = e.join(at("a", "x"), "a").join(at("b", "y"), "b").where("x = y").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    squares = label.groupBy("c").agg(F.sum("k").alias("t")).agg(F.coalesce(F.sum(F.col("t") * F.col("t")), F.lit(0.0))).first()[0]
    return inner / total - resolution * squares / (2 * total) ** 2


def community_records(assigned: DataFrame, relations: DataFrame, names: DataFrame, most: int = 10, salts: int = 16) -> DataFrame:
    """(community_id, level, label, entity_count, relation_count, summary) of all leaf and root communities.

    assigned: (id, leaf, root); relations: (src, dst); names: (id, name). The least names of a
    community are ranked in salted parts first, so a large one is not gathered in one place.
    """
    levels = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(x).alias("label")) for x in ("leaf", "root")])).alias("l")
    members = assigned.join(names, "id").select("id", "name", levels).select("id", "name", "l.*")
    src = assigned.select(F.col("id").alias("src"), F.col("leaf").alias("src_leaf"), F.col("root").alias("src_root"))
    dst = assigned.select(F.col("id").alias("dst"), "leaf", "root")
    joined = relations.join(src, "src").join(dst, "dst").where("root = src_root")
    inner = joined.select("src_leaf", levels).where("l.level = 'root' or l.label = src_leaf").groupBy("l.level", "l.label").agg(F.count(F.lit(1)).alias("relation_count"))
    nth = F.row_number().over(Window.partitionBy("level", "label", F.pmod(F.xxhash64("id"), F.lit(salts))).orderBy("name", "id"))
    parts = members.withColumn("n", nth).where(F.col("n") <= most)
    top = parts.groupBy("level", "label").agg(F.slice(F.array_sort(F.collect_list(F.struct("name", "id"))), 1, most).alias("top"))
    counts = members.groupBy("level", "label").agg(F.count(F.lit(1)).alias("entity_count"))
    rows = counts.join(top, ["level", "label"]).join(inner, ["level", "label"], "left")
    text = F.concat(F.lit("[MODALITÀ TEST] Community "), "label", F.lit(" con entità: "), F.array_join(F.transform("top", lambda x: x["name"]), ", "), F.lit("."))
    community = T.uuid5(F.concat(F.lit("community-"), "level", F.lit("-"), "label"), T.NAMESPACE_DNS)
    return rows.select(community.alias("community_id"), "level", "label", "entity_count", F.coalesce("relation_count", F.lit(0)).alias("relation_count"), text.alias("summary"))
