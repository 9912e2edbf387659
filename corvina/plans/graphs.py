"""Entities, relations and communities.

Two graphs: what the chunks mention (capitalised words, linked when they follow each other in a
chunk), and the star schema as nodes and typed edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from corvina.functions import text as T
from corvina.operators import chunking as C, graph as G
from corvina.operators.tables import current_chunks
from corvina.plans import search
from corvina.session import stored, table, written

NAME = r"[A-Z][a-z]{3,}"


def raw_mentions(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, pos, name, type): the rule-based extractor."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lower(F.substring(F.coalesce("lang", F.lit("")), 1, 2)).alias("type"))
    chunks = current_chunks(table(spark, d, "chunks").select("chunk_id", "document_id", "chunk_index", "text", "created_at")).where("text is not null")
    return chunks.join(docs, "document_id").select("chunk_id", "type", F.posexplode(F.regexp_extract_all("text", F.lit(NAME), F.lit(0))).alias("pos", "name"))


def mentions(raw: DataFrame) -> DataFrame:
    return raw.select("chunk_id", T.entity_id(F.col("name"), F.col("type")).alias("entity_id")).distinct()


def entities(raw: DataFrame) -> DataFrame:
    """(id, name, type, normalized_name, mentions): the name as first seen."""
    keyed = raw.select(T.entity_id(F.col("name"), F.col("type")).alias("id"), "name", "type", "chunk_id", "pos")
    first = keyed.groupBy("id").agg(F.min(F.struct("chunk_id", "pos", "name", "type")).alias("f"), F.countDistinct("chunk_id").alias("mentions"))
    return first.select("id", "f.name", "f.type", T.normalised_name(F.col("f.name")).alias("normalized_name"), "mentions")


def relations(raw: DataFrame) -> DataFrame:
    """(edge_id, src, type, dst): names that follow each other, loops dropped, first of each kept."""
    keyed = raw.select("chunk_id", "pos", T.entity_id(F.col("name"), F.col("type")).alias("id"), F.col("type").alias("lang"))
    nxt = F.lead("id").over(Window.partitionBy("chunk_id").orderBy("pos"))
    pairs = keyed.withColumn("dst", nxt).where("dst is not null and dst <> id")
    typed = pairs.select("chunk_id", "pos", F.col("id").alias("src"), "dst", T.relation_type(F.concat(F.lit(" next to "), "lang")).alias("type"))
    kept = G.first_by_key(typed, ["src", "dst", F.lower("type")], ["chunk_id", "pos"])
    return kept.select(F.concat_ws(":", "src", "type", "dst").alias("edge_id"), "src", "type", "dst")


def canonical_entities(spark: SparkSession, d: str) -> DataFrame:
    return entities(raw_mentions(spark, d))


def entity_relations(spark: SparkSession, d: str) -> DataFrame:
    return relations(raw_mentions(spark, d)).select("src", "type", "dst")


def relation_types(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    values = docs.select(F.col("category").alias("raw")).unionAll(docs.select("description")).where("raw is not null").distinct()
    return values.select("raw", T.relation_type(F.col("raw")).alias("relation_type"))


def local_graph_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts around the chunks whose id is divisible by 100: 200 matches, then the first 20 different ones."""
    raw = raw_mentions(spark, d)
    facts = G.neighbour_facts(mentions(raw).where("chunk_id % 100 = 0"), relations(raw), entities(raw))
    order = ["chunk_id", "source", "rel_type", "target"]
    first = facts.orderBy(*order).limit(200)
    unique = G.first_by_key(first, [F.lower("source"), F.lower("rel_type"), F.lower("target")], order)
    return unique.orderBy(*order).limit(20).select(F.concat("source", F.lit(" --["), "rel_type", F.lit("]--> "), "target").alias("fact"))


def expansion_text(spark: SparkSession, d: str) -> DataFrame:
    """What the graph knows about the three most mentioned entities: at most five relations each."""
    raw = raw_mentions(spark, d)
    ents = entities(raw)
    top = ents.orderBy(F.desc("mentions"), "id").limit(3).select("id", F.col("name").alias("entity"))
    rel = G.undirected(relations(raw)).join(top.withColumnRenamed("id", "src"), "src").join(ents.select(F.col("id").alias("dst"), F.col("name").alias("other")), "dst")
    line = F.concat(F.lit("- "), "entity", F.lit(" --["), "type", F.lit("]--> "), "other")
    lines = rel.select("src", "entity", "type", "other", "dst", line.alias("line")).distinct()
    nth = F.row_number().over(Window.partitionBy("src").orderBy("type", "other", "dst"))
    five = lines.withColumn("n", nth).where("n <= 5")
    return five.groupBy("src", "entity").agg(F.concat(F.lit("Informazioni correlate a '"), F.first("entity"), F.lit("':\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")).alias("text")).select("entity", "text")


def orphan_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities that no chunk mentions once the chunks of failed documents are gone."""
    raw = raw_mentions(spark, d)
    chunks = table(spark, d, "chunks").select("chunk_id", "document_id")
    gone = chunks.join(table(spark, d, "documents").where("status = 'error' or doc_id % 2 = 0").select(F.col("doc_id").alias("document_id")), "document_id", "left_semi")
    left = mentions(raw).join(gone.select("chunk_id"), "chunk_id", "left_anti")
    return entities(raw).select("id", "name").join(left.select(F.col("entity_id").alias("id")).distinct(), "id", "left_anti")


def graph_stats_user(spark: SparkSession, d: str) -> DataFrame:
    """Distinct entities, and their outgoing relations, of each owner's documents."""
    raw = raw_mentions(spark, d)
    owner = table(spark, d, "chunks").select("chunk_id", "document_id").join(table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "created_by"), "document_id").select("chunk_id", "created_by")
    mine = mentions(raw).join(owner, "chunk_id").select("created_by", "entity_id").distinct()
    degree = relations(raw).groupBy(F.col("src").alias("entity_id")).agg(F.count(F.lit(1)).alias("n"), F.collect_set("type").alias("types"))
    return mine.join(degree, "entity_id", "left").groupBy("created_by").agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("relations"))


def graph_stats_global(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of each label and relationships of each kind."""
    raw = raw_mentions(spark, d)
    chunks = current_chunks(table(spark, d, "chunks").select("chunk_id", "document_id", "chunk_index", "text", "created_at"))
    rows = [
        (table(spark, d, "documents"), "Document"),
        (chunks, "Chunk"),
        (entities(raw), "Entity"),
        (chunks.where("document_id is not null"), "BELONGS_TO"),
        (mentions(raw), "MENTIONS"),
        (relations(raw), "RELATED"),
    ]
    out = None
    for df, label in rows:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("kind"), "n")
        out = one if out is None else out.unionAll(one)
    return out


# --- star schema ----------------------------------------------------------------------------


def star_nodes(spark: SparkSession, d: str) -> DataFrame:
    """(id, name, type) of regions, nations, suppliers and customers."""
    out = None
    for t, key, name in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name")):
        one = table(spark, d, t).select(F.concat(F.lit(f"{t}:"), F.col(key).cast("string")).alias("id"), F.col(name).alias("name"), F.lit(t).alias("type"))
        out = one if out is None else out.unionAll(one)
    return out


def star_edges(spark: SparkSession, d: str) -> DataFrame:
    """(edge_id, src, type, dst): what lies where."""
    out = None
    for t, key, to, ref, kind in (("nation", "n_nationkey", "region", "n_regionkey", "PART_OF"), ("supplier", "s_suppkey", "nation", "s_nationkey", "LOCATED_IN"), ("customer", "c_custkey", "nation", "c_nationkey", "LOCATED_IN")):
        src, dst = F.concat(F.lit(f"{t}:"), F.col(key).cast("string")), F.concat(F.lit(f"{to}:"), F.col(ref).cast("string"))
        one = table(spark, d, t).select(F.concat_ws(">", src, dst).alias("edge_id"), src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst"))
        out = one if out is None else out.unionAll(one)
    return out


def _explore(spark: SparkSession, d: str, depth: int) -> DataFrame:
    """Relations within reach of the first 25 entities whose name holds a text; ordered, at most 200."""
    nodes, edges = star_nodes(spark, d), star_edges(spark, d)
    starts = nodes.where(F.lower("name").contains("_1") & F.col("type").isin("nation", "region")).orderBy("id").limit(25).select(F.col("id").alias("start"))
    hit = G.trails(starts, edges, depth).select("edge_id").distinct().join(edges, "edge_id")
    names = nodes.select("id", "name")
    out = hit.join(names.select(F.col("id").alias("src"), F.col("name").alias("source")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("target")), "dst")
    return out.select("source", "type", "target").distinct().orderBy("source", "type", "target").limit(200)


def explore_entity_d1(spark: SparkSession, d: str) -> DataFrame:
    return _explore(spark, d, 1)


def explore_entity_d2(spark: SparkSession, d: str) -> DataFrame:
    return _explore(spark, d, 2)


def explore_entity_d3(spark: SparkSession, d: str) -> DataFrame:
    return _explore(spark, d, 3)


def explore_entities(spark: SparkSession, d: str) -> DataFrame:
    """The entities that start an exploration or lie within two steps, whether or not they have a relation."""
    nodes, edges = star_nodes(spark, d), star_edges(spark, d)
    starts = nodes.where(F.lower("name").contains("_1") & F.col("type").isin("nation", "region")).orderBy("id").limit(25).select(F.col("id").alias("start"))
    hit = G.trails(starts, edges, 2).select("edge_id").distinct().join(edges, "edge_id")
    ids = starts.select(F.col("start").alias("id")).unionAll(hit.select(F.explode(F.array("src", "dst")).alias("id"))).distinct()
    return nodes.join(ids, "id").select("id", F.trim(F.regexp_replace("name", T.BLANKS, " ")).alias("name"), "type")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("type"), "embedding")


THRESHOLD = 0.3


def entity_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    return G.similar_pairs(_vectors(spark, d), THRESHOLD).select("id_a", "id_b", F.round("score", 6).alias("score"))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    pairs = written(G.similar_pairs(_vectors(spark, d), THRESHOLD))
    groups = G.connected_components(pairs, "id_a", "id_b")
    return G.canonical_of(groups, _vectors(spark, d).select("id", F.concat(F.lit("entity "), F.col("id").cast("string")).alias("name")))


def entity_canonical_map(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d)


def entity_resolution_stats(spark: SparkSession, d: str) -> DataFrame:
    m = _resolved(spark, d)
    examined = _vectors(spark, d).agg(F.count(F.lit(1)).alias("examined"))
    return m.agg(F.countDistinct("canonical_id").alias("merged_groups"), F.count_if(F.col("id") != F.col("canonical_id")).alias("removed_entities")).crossJoin(F.broadcast(examined))


def _detected(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Assignment (id, leaf, root) and records of the communities of the names in chunks, stored by the first query."""

    def build(path: str) -> None:
        raw = raw_mentions(spark, d)
        nodes, rel = written(entities(raw)), written(relations(raw))
        G.communities(rel, nodes).write.parquet(f"{path}/assigned")
        G.community_records(spark.read.schema(ASSIGNED).parquet(f"{path}/assigned"), rel, nodes.select("id", "name")).write.parquet(f"{path}/records")

    path = stored("communities", [table(spark, d, "chunks"), table(spark, d, "documents")], build)
    return spark.read.schema(ASSIGNED).parquet(f"{path}/assigned"), spark.read.schema(RECORDS).parquet(f"{path}/records")


ASSIGNED = "id string, leaf string, root string"
RECORDS = "community_id string, level string, label string, entity_count bigint, relation_count bigint, summary string"


def community_assign(spark: SparkSession, d: str) -> DataFrame:
    """Leaf and root communities of the graph of names in chunks."""
    return _detected(spark, d)[0]


def community_records(spark: SparkSession, d: str) -> DataFrame:
    """Id, size and summary of every detected community of both levels."""
    return _detected(spark, d)[1]


def community_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for any partition: each level has every entity once, and roots are unions of leaves."""
    assigned, records = _detected(spark, d)
    split = assigned.groupBy("leaf").agg(F.countDistinct("root").alias("roots")).agg(F.count_if(F.col("roots") > 1).alias("split_leaves"))
    return records.groupBy("level").agg(F.sum("entity_count").alias("entities"), (F.countDistinct("community_id") == F.count(F.lit(1))).alias("distinct_ids")).crossJoin(F.broadcast(split))


MOST_SUMMARIES = 5


def community_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Context for a question about the whole: the largest root communities."""
    return _detected(spark, d)[1].where("level = 'root'").orderBy(F.desc("entity_count"), "community_id").limit(MOST_SUMMARIES).select("community_id", "entity_count", "relation_count", "summary")


def community_by_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Without root summaries: from the chunks found for a question to the names in them and their leaf communities."""
    assigned, records = _detected(spark, d)
    chunks = current_chunks(table(spark, d, "chunks").select("chunk_id", "document_id", "chunk_index", "text", "created_at")).where("text is not null")
    found = search.retrieved(spark, d, chunks).select(F.col("id").alias("chunk_id"))
    ids = mentions(raw_mentions(spark, d)).join(found, "chunk_id", "left_semi").select(F.col("entity_id").alias("id")).distinct()
    labels = assigned.join(ids, "id").select(F.col("leaf").alias("label")).distinct()
    hit = records.where("level = 'leaf'").join(labels, "label").orderBy(F.desc("entity_count"), "community_id").limit(20)
    return hit.orderBy(F.desc("entity_count"), "community_id").limit(MOST_SUMMARIES).select("community_id", "entity_count", "relation_count", "summary")


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the star graph: what lies in one region."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("community_id"), F.col("n_name").alias("name"))
    out = nation.select(F.concat(F.lit("nation:"), F.col("k").cast("string")).alias("entity_id"), "name", "community_id")
    for t, key, ref, name in (("supplier", "s_suppkey", "s_nationkey", "s_name"), ("customer", "c_custkey", "c_nationkey", "c_name")):
        one = table(spark, d, t).select(F.concat(F.lit(f"{t}:"), F.col(key).cast("string")).alias("entity_id"), F.col(name).alias("name"), F.col(ref).alias("k")).join(nation.select("k", "community_id"), "k")
        out = out.unionByName(one.select("entity_id", "name", "community_id"))
    return out


def community_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Entities, internal relations and a summary of ten names for each community.

    The ten least names are found by rank within salted parts first, so a large community is not
    gathered in one place.
    """
    m = written(_members(spark, d))
    inner = star_edges(spark, d).join(m.select(F.col("entity_id").alias("src"), F.col("community_id").alias("x")), "src").join(m.select(F.col("entity_id").alias("dst"), F.col("community_id").alias("y")), "dst").where("x = y").groupBy(F.col("x").alias("community_id")).agg(F.count(F.lit(1)).alias("relation_count"))
    salted = m.withColumn("salt", F.pmod(F.xxhash64("entity_id"), F.lit(16)))
    part = salted.withColumn("r", F.row_number().over(Window.partitionBy("community_id", "salt").orderBy("name", "entity_id"))).where("r <= 10")
    names = part.groupBy("community_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("name", "entity_id"))), 1, 10).alias("top"))
    counts = m.groupBy("community_id").agg(F.count(F.lit(1)).alias("entity_count"))
    text = F.concat(F.lit("Entità: "), F.array_join(F.transform("top", lambda x: x["name"]), ", "))
    return counts.join(names, "community_id").join(inner, "community_id", "left").select("community_id", "entity_count", F.coalesce("relation_count", F.lit(0)).alias("relation_count"), text.alias("summary"))


def community_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of the communities that given entities belong to, the largest first, each once."""
    picked = _members(spark, d).where(F.col("name").rlike("0{5,}[1-9]$")).select("community_id")
    found = picked.join(community_summaries(spark, d), "community_id").orderBy(F.desc("entity_count"), "community_id").limit(20)
    return found.distinct()


def community_context(spark: SparkSession, d: str) -> DataFrame:
    """The numbered text blocks of all communities as one text."""
    s = community_summaries(spark, d)
    n = F.row_number().over(Window.orderBy(F.desc("entity_count"), "community_id"))
    block = F.concat(F.lit("Argomento "), F.col("n").cast("string"), F.lit(" ("), F.col("entity_count").cast("string"), F.lit(" entità, "), F.col("relation_count").cast("string"), F.lit(" relazioni collegate):\n"), F.col("summary"))
    return s.orderBy(F.desc("entity_count"), "community_id").limit(5).withColumn("n", n).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))


# --- chunks ---------------------------------------------------------------------------------


def chunk_spans(spark: SparkSession, d: str) -> DataFrame:
    return C.chunked(table(spark, d, "documents"), most=160, overlap=24).select("doc_id", "chunk_index", "start", "end", F.sha2("text", 256).alias("text_hash"))


def paragraph_offsets(spark: SparkSession, d: str) -> DataFrame:
    return C.paragraphs(table(spark, d, "documents")).select("doc_id", "start", "end", F.length("paragraph").cast("bigint").alias("chars"))


def chunk_page_map(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each chunk from the spans of pages, next to what the table says."""
    chunks = table(spark, d, "chunks").where("char_start is not null and char_end is not null")
    pages = chunks.where("page_start = page_end").groupBy("document_id", F.col("page_start").alias("page")).agg(F.min("char_start").alias("page_start"), F.max("char_end").alias("page_end"))
    return C.pages_of_spans(chunks.select("document_id", "chunk_id", F.col("char_start").alias("start"), F.col("char_end").alias("end")), pages)


QUERIES = {
    f.__name__: f
    for f in (canonical_entities, entity_relations, relation_types, local_graph_facts, expansion_text, orphan_entities, graph_stats_user, graph_stats_global, explore_entity_d1, explore_entity_d2, entity_similarity_pairs, entity_canonical_map, entity_resolution_stats, explore_entity_d3, explore_entities, community_assign, community_records, community_coverage, community_retrieval, community_by_chunks, community_summaries, community_lookup, community_context, chunk_spans, paragraph_offsets, chunk_page_map)
}

_CUR = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, chunk_index ORDER BY created_at DESC NULLS LAST, chunk_id DESC) AS rn FROM chunks) WHERE rn = 1)"
_EID = "substr(sha256(concat_ws(':', CASE WHEN {t} = '' THEN 'unknown' ELSE {t} END, lower({n}))), 1, 32)"
_RAW = f"""{_CUR}, m0 AS (SELECT chunk_id, lower(substr(coalesce(lang, ''), 1, 2)) AS type, regexp_extract_all(cur.text, '[A-Z][a-z]{{3,}}') AS ns FROM cur JOIN documents ON doc_id = document_id WHERE cur.text IS NOT NULL),
m1 AS (SELECT chunk_id, type, unnest(ns) AS name, generate_subscripts(ns, 1) - 1 AS pos FROM m0), raw AS (SELECT *, {_EID.format(t='type', n='name')} AS id FROM m1), men AS (SELECT DISTINCT chunk_id, id AS entity_id FROM raw),
ent AS (SELECT id, arg_min(name, (chunk_id, pos)) AS name, arg_min(type, (chunk_id, pos)) AS type, count(DISTINCT chunk_id) AS mentions FROM raw GROUP BY id),
nx AS (SELECT id AS src, lead(id) OVER (PARTITION BY chunk_id ORDER BY pos) AS dst, type AS lang FROM raw),
rel AS (SELECT DISTINCT src, trim(upper('NEXT_TO_' || lang)) AS type, dst FROM (SELECT src, dst, lang FROM nx WHERE dst IS NOT NULL AND dst <> src)),
rel2 AS (SELECT src, regexp_replace(type, '_+$', '') AS type, dst FROM rel), und AS (SELECT * FROM rel2 UNION ALL SELECT dst, type, src FROM rel2)"""
_NODES = "nodes AS (SELECT 'region:' || r_regionkey AS id, r_name AS name, 'region' AS type FROM region UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation' FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier' FROM supplier UNION ALL SELECT 'customer:' || c_custkey, c_name, 'customer' FROM customer)"
_EDGES = "edges AS (SELECT 'nation:' || n_nationkey AS src, 'PART_OF' AS type, 'region:' || n_regionkey AS dst FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'LOCATED_IN', 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'customer:' || c_custkey, 'LOCATED_IN', 'nation:' || c_nationkey FROM customer)"
_REACH = f"WITH RECURSIVE {_NODES}, {_EDGES}, e AS (SELECT src || '>' || dst AS eid, src AS a, dst AS b FROM edges UNION ALL SELECT src || '>' || dst, dst, src FROM edges), s AS (SELECT id FROM nodes WHERE contains(lower(name), '_1') AND type IN ('nation', 'region') ORDER BY id LIMIT 25), p AS (SELECT id AS here, CAST([] AS VARCHAR[]) AS used, 0 AS n FROM s UNION ALL SELECT e.b, list_append(p.used, e.eid), p.n + 1 FROM p JOIN e ON e.a = p.here AND NOT list_contains(p.used, e.eid) WHERE p.n < {{depth}}), hit AS (SELECT DISTINCT unnest(used) AS eid FROM p)"
_EXPL = _REACH + " SELECT DISTINCT x.name AS source, g.type, y.name AS target FROM edges g JOIN hit ON eid = src || '>' || dst JOIN nodes x ON x.id = src JOIN nodes y ON y.id = dst ORDER BY 1, 2, 3 LIMIT 200"
_PAIRS = "pairs AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.3)"
_RES = f"WITH RECURSIVE {_PAIRS}, ed AS (SELECT id_a AS a, id_b AS b FROM pairs UNION SELECT id_b, id_a FROM pairs), reach AS (SELECT a AS id, a AS other FROM ed UNION SELECT r.id, ed.b FROM reach r JOIN ed ON ed.a = r.other), canon AS (SELECT id, arg_min(other, (length('entity ' || other), other)) AS canonical_id FROM reach GROUP BY id)"
_MEM = "nat AS (SELECT n_nationkey AS k, n_regionkey AS community_id, n_name AS name FROM nation), mem AS (SELECT 'nation:' || k AS entity_id, name, community_id FROM nat UNION ALL SELECT 'supplier:' || s_suppkey, s_name, community_id FROM supplier JOIN nat ON k = s_nationkey UNION ALL SELECT 'customer:' || c_custkey, c_name, community_id FROM customer JOIN nat ON k = c_nationkey)"
_SUM = f"{_MEM}, {_EDGES}, inn AS (SELECT x.community_id, count(*) AS relation_count FROM edges JOIN mem x ON x.entity_id = src JOIN mem y ON y.entity_id = dst AND x.community_id = y.community_id GROUP BY 1), summ AS (SELECT community_id, count(*) AS entity_count, 'Entità: ' || array_to_string(list(name ORDER BY name, entity_id)[1:10], ', ') AS summary FROM mem GROUP BY 1), cs AS (SELECT community_id, entity_count, coalesce(relation_count, 0) AS relation_count, summary FROM summ LEFT JOIN inn USING (community_id))"
ORACLES = {
    "canonical_entities": f"WITH {_RAW} SELECT id, name, type, lower(name) AS normalized_name, mentions FROM ent",
    "entity_relations": f"WITH {_RAW} SELECT src, type, dst FROM rel2",
    "relation_types": "SELECT raw, CASE WHEN regexp_matches(t, '^[A-Z]') THEN t ELSE 'RELATED_TO' END AS relation_type FROM (SELECT raw, regexp_replace(regexp_replace(regexp_replace(upper(trim(raw)), '[^A-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS t FROM (SELECT category AS raw FROM documents UNION SELECT description FROM documents) WHERE raw IS NOT NULL)",
    "local_graph_facts": f"WITH {_RAW}, f AS (SELECT chunk_id, x.name AS source, und.type AS rel_type, y.name AS target FROM men JOIN und ON und.src = entity_id JOIN ent x ON x.id = und.src JOIN ent y ON y.id = und.dst WHERE chunk_id % 100 = 0 ORDER BY 1, 2, 3, 4 LIMIT 200), u AS (SELECT *, row_number() OVER (PARTITION BY lower(source), lower(rel_type), lower(target) ORDER BY chunk_id, source, rel_type, target) AS rn FROM f) SELECT source || ' --[' || rel_type || ']--> ' || target AS fact FROM u WHERE rn = 1 ORDER BY chunk_id, source, rel_type, target LIMIT 20",
    "expansion_text": f"WITH {_RAW}, top3 AS (SELECT id, name AS entity FROM ent ORDER BY mentions DESC, id LIMIT 3), l AS (SELECT DISTINCT und.src, entity, und.type, ent.name AS other, und.dst FROM und JOIN top3 ON top3.id = und.src JOIN ent ON ent.id = und.dst), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY type, other, dst) AS n FROM l) SELECT any_value(entity) AS entity, 'Informazioni correlate a ''' || any_value(entity) || ''':' || chr(10) || string_agg('- ' || entity || ' --[' || type || ']--> ' || other, chr(10) ORDER BY n) AS text FROM r WHERE n <= 5 GROUP BY src",
    "orphan_entities": f"WITH {_RAW}, gone AS (SELECT chunk_id FROM chunks JOIN documents ON doc_id = document_id WHERE status = 'error' OR doc_id % 2 = 0) SELECT id, name FROM ent WHERE id NOT IN (SELECT entity_id FROM men WHERE chunk_id NOT IN (FROM gone))",
    "graph_stats_user": f"WITH {_RAW}, mine AS (SELECT DISTINCT created_by, entity_id FROM men JOIN chunks USING (chunk_id) JOIN documents ON doc_id = document_id), deg AS (SELECT src, count(*) AS n FROM rel2 GROUP BY 1) SELECT created_by, count(*) AS entities, CAST(coalesce(sum(n), 0) AS BIGINT) AS relations FROM mine LEFT JOIN deg ON src = entity_id GROUP BY 1",
    "graph_stats_global": f"WITH {_RAW} SELECT 'Document' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'Chunk', count(*) FROM cur UNION ALL SELECT 'Entity', count(*) FROM ent UNION ALL SELECT 'BELONGS_TO', count(document_id) FROM cur UNION ALL SELECT 'MENTIONS', count(*) FROM men UNION ALL SELECT 'RELATED', count(*) FROM rel2",
    "explore_entity_d1": _EXPL.format(depth=1),
    "explore_entity_d2": _EXPL.format(depth=2),
    "explore_entity_d3": _EXPL.format(depth=3),
    "explore_entities": _REACH.format(depth=2) + " SELECT n.id, n.name, n.type FROM nodes n WHERE n.id IN (SELECT id FROM s UNION ALL SELECT src FROM edges JOIN hit ON eid = src || '>' || dst UNION ALL SELECT dst FROM edges JOIN hit ON eid = src || '>' || dst)",
    "community_coverage": f"WITH {_RAW} SELECT level, count(*) AS entities, true AS distinct_ids, 0 AS split_leaves FROM ent, (VALUES ('leaf'), ('root')) v(level) GROUP BY level",
    "entity_similarity_pairs": f"WITH {_PAIRS} SELECT id_a, id_b, round(score, 6) AS score FROM pairs",
    "entity_canonical_map": f"{_RES} SELECT id, canonical_id FROM canon",
    "entity_resolution_stats": f"{_RES} SELECT count(DISTINCT canonical_id) AS merged_groups, count(*) FILTER (id <> canonical_id) AS removed_entities, (SELECT count(*) FROM embeddings) AS examined FROM canon",
    "community_summaries": f"WITH {_SUM} SELECT * FROM cs",
    "community_lookup": f"WITH {_SUM} SELECT DISTINCT * FROM (SELECT cs.* FROM mem JOIN cs USING (community_id) WHERE regexp_matches(name, '0{{5,}}[1-9]$') ORDER BY entity_count DESC, community_id LIMIT 20)",
    "community_context": f"WITH {_SUM}, t AS (SELECT *, row_number() OVER (ORDER BY entity_count DESC, community_id) AS n FROM cs) SELECT string_agg('Argomento ' || n || ' (' || entity_count || ' entità, ' || relation_count || ' relazioni collegate):' || chr(10) || summary, chr(10) || chr(10) ORDER BY n) AS context FROM t WHERE n <= 5",
    "paragraph_offsets": "WITH p AS (SELECT doc_id, unnest(s) AS paragraph, generate_subscripts(s, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS s FROM documents WHERE text IS NOT NULL)), o AS (SELECT *, coalesce(sum(length(paragraph) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p) SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(start + length(paragraph) AS BIGINT) AS \"end\", length(paragraph) AS chars FROM o WHERE regexp_matches(paragraph, '[^ \\t\\n\\r\\f\\v]')",
    "chunk_page_map": "WITH c AS (SELECT * FROM chunks WHERE char_start IS NOT NULL AND char_end IS NOT NULL), pg AS (SELECT document_id, page_start AS page, min(char_start) AS ps, max(char_end) AS pe FROM c WHERE page_start = page_end GROUP BY 1, 2) SELECT chunk_id, min(page) AS first_page, max(page) AS last_page FROM c JOIN pg USING (document_id) WHERE pe >= char_start AND ps <= char_end GROUP BY 1",
}
