import io
import uuid
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvina.functions import text as T
from corvina.operators import chunking, graph, retrieval, tables
from corvina.sources import readers, sinks
from corvina.streaming import incremental


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {k}" for n, k in zip(names, [_kind(v) for v in values.values()])))
    return df.select(column.alias("x")).first()["x"]


def _kind(v):
    return {str: "string", int: "int", list: "array<array<string>>", type(None): "string"}[type(v)]


def test_sparse_tokens(spark):
    assert one(spark, T.sparse_tokens(F.col("t")), t="The risk approval per policy X") == ["risk", "approval", "policy"]
    assert one(spark, T.sparse_tokens(F.col("t")), t="(Firewall), «perimetrale» dell'arte 12") == ["firewall", "perimetrale"]


def test_token_set_and_jaccard(spark):
    assert sorted(one(spark, T.token_set(F.col("t")), t="The cat and the Cat: un gatto")) == ["cat", "gatto"]
    assert one(spark, T.jaccard(T.token_set(F.col("a")), T.token_set(F.col("b"))), a="alfa beta", b="beta gamma") == pytest.approx(1 / 3)
    assert one(spark, T.jaccard(T.token_set(F.col("a")), T.token_set(F.col("b"))), a="", b="beta") == 0.0


def test_quote_and_reference(spark):
    assert one(spark, T.quote(F.col("t")), t="  uno\n due ") == "uno due"
    long = one(spark, T.quote(F.col("t")), t="parola, " * 60)
    assert long.endswith("parola...") and len(long) <= 323
    ref = T.reference(F.col("f"), F.col("a"), F.col("b"), F.lit(None), F.lit(3))
    assert one(spark, ref, f="manuale.pdf", a=4, b=5) == "manuale.pdf, pagine 4-5"
    assert one(spark, T.reference(F.col("f"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(3)), f="") == "documento, parte 4"


def test_entity_ids_ignore_case_and_blanks(spark):
    a = one(spark, T.entity_id(F.col("n"), F.col("k")), n="  Mario   ROSSI ", k="Person")
    assert a == one(spark, T.entity_id(F.col("n"), F.col("k")), n="mario rossi", k="person") and len(a) == 32
    assert a != one(spark, T.entity_id(F.col("n"), F.col("k")), n="mario rossi", k="company")


def test_relation_types(spark):
    for raw, want in (("depends on", "DEPENDS_ON"), (" è-parte di ", "PARTE_DI"), ("1x", "RELATED_TO"), ("__", "RELATED_TO")):
        assert one(spark, T.relation_type(F.col("t")), t=raw) == want


def test_costs(spark):
    assert one(spark, T.cost_usd(F.col("m"), F.lit(1_000_000), F.lit(500_000)), m="gpt-4o-mini") == pytest.approx(0.45)
    assert one(spark, T.cost_usd(F.col("m"), F.lit(1_000_000), F.lit(500_000)), m="other") == pytest.approx(0.45)


def test_intents(spark):
    for q, want in (("ciao", "direct"), ("Quali sistemi dipendono dal firewall?", "relational"), ("Quali sono i temi principali?", "summary"), ("Cosa dice la polizza?", "factual"), ("", "direct")):
        assert one(spark, T.intent(F.col("q")), q=q) == want


def test_html_and_tables(spark):
    html = "<html><script>x</script><h1>Titolo</h1><p>uno <b>due</b></p><p>tre &amp; quattro</p></html>"
    assert one(spark, T.html_text(F.col("t")), t=html) == "Titolo\n\nuno due\n\ntre & quattro"
    assert one(spark, T.markdown_table(F.col("r")), r=[["a", None], ["b|c", "d\ne"], ["", ""]]) == "| a |  |\n| --- | --- |\n| b\\|c | d e |"
    assert one(spark, T.markdown_table(F.col("r")), r=[["", None]]) == ""


def test_graph_query_guard(spark):
    for q, want in (("MATCH (n) RETURN n", True), ("MATCH (n) DELETE n", False), ("RETURN 1", False), ("MATCH (n {a: 'SET'}) RETURN n", True), ("", False)):
        assert one(spark, T.read_only_pattern(F.col("q")), q=q) is want


def test_chunk_spans():
    text = "Breve paragrafo.\n\nAltro paragrafo breve."
    assert chunking.spans_of(text, 512, 64) == [(0, len(text))]
    assert chunking.spans_of(" \n\n ", 512, 64) == []
    long = ". ".join(f"frase numero {i} con parole" for i in range(100)) + "."
    spans = chunking.spans_of(long, 50, 10)
    assert len(spans) > 5 and spans[0][0] == 0 and spans[-1][1] == len(long)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert c <= b and len(long[a:b].split()) <= 60


def test_latest_takes_the_newest(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1), "a"), (1, datetime(2024, 1, 2), "b"), (2, None, "c")], "k int, at timestamp, v string")
    assert {(r.k, r.v) for r in tables.latest(df, ["k"], ["at"]).collect()} == {(1, "b"), (2, "c")}
    assert tables.latest(df.limit(0), ["k"], ["at"]).count() == 0


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([("a", "Alfa", 1), ("b", "Beta", 2)], "id string, name string, n int")
    new = spark.createDataFrame([("b", "BETA", 3), ("c", "Gamma", 4)], "id string, name string, n int")
    got = {r.id: (r.name, r.n) for r in tables.upsert(old, new, ["id"], keep_first=["name"]).collect()}
    assert got == {"a": ("Alfa", 1), "b": ("Beta", 3), "c": ("Gamma", 4)}
    assert [r.id for r in tables.without(old, new, "id").collect()] == ["a"]


def test_hash_duplicates_and_numbers(spark):
    df = spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (3, "v", "x"), (4, "u", None)], "id int, owner string, digest string")
    got = {r.id: r.is_duplicate for r in tables.hash_duplicates(df, "owner", "digest", ["id"]).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False}
    numbers = {r.digest: r.n for r in tables.numbered(df.select("digest").where("digest is not null").distinct(), ["digest"], "n").collect()}
    assert numbers == {"x": 1}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8), (8, 9), (9, 10), (10, 11), (5, 5)], "src long, dst long")
    got = {r.id: r.component for r in graph.connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 10: 7, 11: 7}
    assert graph.connected_components(e.limit(0)).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    assert {r.component for r in graph.connected_components(chain).collect()} == {0}


def test_two_triangles_are_two_communities(spark):
    e = spark.createDataFrame([(a, b) for a, b in ("ab", "bc", "ca", "de", "ef", "fd", "cd")], "src string, dst string")
    rows = graph.communities(e).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.leaf, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [["a", "b", "c"], ["d", "e", "f"]]


def test_trails_use_no_edge_twice(spark):
    edges = spark.createDataFrame([("1", "a", "T", "b"), ("2", "b", "T", "c"), ("3", "c", "T", "d")], "edge_id string, src string, type string, dst string")
    start = spark.createDataFrame([("a",)], "start string")
    assert {r.edge_id for r in graph.trails(start, edges, 2).collect()} == {"1", "2"}
    with pytest.raises(ValueError):
        graph.trails(start, edges, 4)


def test_similar_pairs_and_merge(spark):
    v = spark.createDataFrame([(1, "t", [1.0, 0.0]), (2, "t", [0.9, 0.1]), (3, "t", [0.0, 1.0]), (4, "u", [1.0, 0.0]), (5, "u", [0.0, 0.0])], "id long, type string, embedding array<double>")
    for block in (1, 1000):
        assert [(r.id_a, r.id_b) for r in graph.similar_pairs(v, 0.9, block).collect()] == [(1, 2)]
    groups = spark.createDataFrame([(1, 1), (2, 1)], "id long, component long")
    names = spark.createDataFrame([(1, "Mario Rossi"), (2, "M. Rossi")], "id long, name string")
    canon = graph.canonical_of(groups, names)
    assert {(r.id, r.canonical_id) for r in canon.collect()} == {(1, 2), (2, 2)}
    edges = spark.createDataFrame([(1, "T", 2), (1, "T", 3), (2, "T", 3)], "src long, type string, dst long")
    assert [tuple(r) for r in graph.merged_edges(edges, canon).collect()] == [(2, "T", 3)]


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame([(1, "risk approval"), (2, "approval policy"), (3, "approval contract")], "id long, t string")
    terms = retrieval.term_counts(docs, "id", F.col("t"))
    w = {(r.id, r.term): r.weight for r in retrieval.weighted(terms, retrieval.document_frequency(terms), retrieval.corpus_stats(terms)).collect()}
    assert w[1, "risk"] > w[1, "approval"] and w[1, "risk"] ** 2 + w[1, "approval"] ** 2 == pytest.approx(1)


def test_fusion_and_diversity(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(0, 2, 1), (0, 3, 2)], "query_id long, id long, rank int")
    got = {r.id: r.score for r in retrieval.reciprocal_rank_fusion([a, b]).collect()}
    assert got[2] == pytest.approx(1 / 3 + 1 / 2) and got[1] == pytest.approx(0.5)
    rows = spark.createDataFrame([(0, 1, 1, "alfa beta gamma"), (0, 2, 2, "alfa beta gamma"), (0, 3, 3, "delta"), (0, 4, 4, None)], "query_id long, id long, rank int, text string")
    assert sorted(r.id for r in retrieval.diversified(rows).collect()) == [1, 3, 4]


def test_lexical_share_lifts_a_lower_score(spark):
    rows = spark.createDataFrame([("firewall", 0.79, "firewall perimetrale"), ("firewall", 0.80, "altro testo"), ("firewall", 0.1, "firewall")], "query_text string, score double, text string")
    got = retrieval.lexical_hybrid(rows).orderBy(F.desc("hybrid_score")).collect()
    assert len(got) == 2 and got[0].score == 0.79


def test_metrics(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], ["b", "d", "e"])], "got array<string>, rel array<string>")
    r = df.select(retrieval.precision_at(F.col("got"), F.col("rel"), 2).alias("p"), retrieval.recall_at(F.col("got"), F.col("rel"), 4).alias("r"), retrieval.precision_at(F.col("got"), F.array().cast("array<string>"), 2).alias("z")).first()
    assert (r.p, r.r, r.z) == (0.5, pytest.approx(2 / 3), 0.0)


def test_pages_of_spans(spark):
    pages = spark.createDataFrame([(1, 1, 0, 13), (1, 2, 15, 28)], "document_id int, page int, page_start int, page_end int")
    spans = spark.createDataFrame([(1, 1, 10, 20), (1, 2, 15, 23), (2, 3, 0, 5)], "document_id int, chunk_id int, start int, end int")
    assert {(r.chunk_id, r.first_page, r.last_page) for r in chunking.pages_of_spans(spans, pages).collect()} == {(1, 1, 2), (2, 2, 2)}


def test_files(spark, tmp_path):
    word = io.BytesIO()
    with zipfile.ZipFile(word, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Uno</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Due</w:t></w:r></w:p></w:body></w:document>')
    for name, data in (("a.txt", "però".encode() + b"\xff"), ("b.html", b"<p>x</p><p>y</p>"), ("c.docx", word.getvalue()), ("d.docx", b"broken"), ("e.pdf", b"%PDF"), ("f.txt", b"")):
        (tmp_path / name).write_bytes(data)
    by_name = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert by_name["a.txt"] == ("però", None) and by_name["b.html"] == ("x\n\ny", None) and by_name["c.docx"] == ("Uno\n\nDue", None)
    assert by_name["d.docx"] == (None, "broken file") and by_name["e.pdf"][1] == "no parser for pdf" and "f.txt" not in by_name


def test_extraction_of_model_output(spark):
    text = 'Here: {"entities": [{"id": "1", "name": "Firewall", "type": "System"}, {"id": "2", "name": "Backup"}, {"id": "3", "name": " "}], "relations": [{"source_id": "1", "target_id": "2", "type": "depends on"}, {"source_id": "1", "target_id": "2", "type": "Depends On"}, {"source_id": "1", "target_id": "1"}, {"source_id": "1", "target_id": "9"}]} done'
    rows = spark.createDataFrame([(1, text), (2, "no json"), (3, None)], "chunk_id int, output string")
    entities, relations = readers.extracted(rows, "chunk_id", "output")
    assert sorted(r.name for r in entities.collect()) == ["Backup", "Firewall"]
    assert [(r.chunk_id, r.type) for r in relations.collect()] == [(1, "DEPENDS_ON")]


def test_batches(spark):
    points = spark.range(250).select("id", F.lit(10).alias("bytes")).coalesce(1)
    got = sinks.batched(points, ["id"], most=100, most_bytes=10_000).groupBy("shard", "batch").count().collect()
    assert sum(r["count"] for r in got) == 250 and max(r["count"] for r in got) <= 100
    big = sinks.batched(points, ["id"], most=100, most_bytes=5).groupBy("shard", "batch").count()
    assert big.agg(F.max("count")).first()[0] == 1


def test_merge_into(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.merge_into(spark.createDataFrame([(1, "a")], "k int, v string"), path, ["k"])
    sinks.merge_into(spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), path, ["k"])
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {(1, "b"), (2, "c")}
    sinks.truncate(spark.read.parquet(path), path + "2")
    assert spark.read.parquet(path + "2").count() == 0


def test_eval_cases(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"cases": [{"query": "x"}, {"query": "y"}]}')
    (tmp_path / "b.json").write_text('[{"query": "z"}]')
    assert readers.read_cases(spark, str(tmp_path / "a.json")).count() == 2
    assert readers.read_cases(spark, str(tmp_path / "b.json")).first().query == "z"


def test_statistics_follow_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "firewall perimetrale"), (2, "firewall")], "chunk_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    incremental.maintain(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "cp"), df.schema)
    got = {r.term: (r.df, r.chunks, r.tokens) for r in incremental.current(spark.read.parquet(str(tmp_path / "state"))).collect()}
    assert got == {"firewall": (2, 0, 0), "perimetrale": (1, 0, 0), "": (0, 2, 3)}
    assert incremental.needs_rebuild(None, 1) and incremental.needs_rebuild(90, 100) and not incremental.needs_rebuild(97, 100)


def test_index_gives_the_weights_of_the_corpus(spark, tmp_path):
    docs = spark.createDataFrame([(1, "risk approval"), (2, "approval policy"), (3, "approval contract"), (4, ""), (5, None)], "id long, t string")
    terms = retrieval.term_counts(docs, "id", F.col("t"))
    retrieval.build_index(terms, str(tmp_path / "i"))
    index = retrieval.open_index(spark, str(tmp_path / "i"))
    want = {tuple(r) for r in retrieval.weighted(terms, retrieval.document_frequency(terms), retrieval.corpus_stats(terms)).collect()}
    assert {(r.id, r.term, r.weight) for r in index.postings.collect()} == want
    part = index.of_terms(["risk", "approval", "unseen"])
    assert {(r.id, r.term) for r in part.postings.collect()} == {(1, "risk"), (1, "approval"), (2, "approval"), (3, "approval")}
    assert len(part.postings.inputFiles()) <= len(index.postings.inputFiles()) and part.df.count() == 2
    assert index.of_terms([]).postings.count() == 0


def test_index_of_an_empty_table(spark, tmp_path):
    terms = retrieval.term_counts(spark.createDataFrame([], "id long, t string"), "id", F.col("t"))
    retrieval.build_index(terms, str(tmp_path / "i"))
    index = retrieval.open_index(spark, str(tmp_path / "i"))
    assert index.postings.count() == 0 and index.stats.first().avg_len == 1.0


def test_communities_keep_isolated_nodes_and_have_records(spark):
    e = spark.createDataFrame([(a, b) for a, b in ("ab", "bc", "ca", "de", "ef", "fd", "cd")], "src string, dst string")
    nodes = spark.createDataFrame([(x, x.upper()) for x in "abcdefg"], "id string, name string")
    assigned = graph.communities(e, nodes)
    rows = {(r.level, r.label): r for r in graph.community_records(assigned, e, nodes).collect()}
    leaf = {k[1]: (r.entity_count, r.relation_count) for k, r in rows.items() if k[0] == "leaf"}
    assert leaf == {"a": (3, 3), "d": (3, 3), "g": (1, 0)}
    assert rows["leaf", "a"].summary == "[MODALITÀ TEST] Community a con entità: A, B, C."
    assert rows["leaf", "a"].community_id == str(uuid.uuid5(uuid.NAMESPACE_DNS, "community-leaf-a"))
    assert sum(r.entity_count for k, r in rows.items() if k[0] == "root") == 7
    assert graph.communities(e.limit(0)).count() == 0


def test_best_of_many_questions_equal_the_ranked_scores(spark):
    rng = np.random.default_rng(5)
    vec = lambda n, per, name: spark.createDataFrame([(i, f"t{t}", float(rng.integers(1, 4)) / 8) for i in range(n) for t in rng.choice(40, per, replace=False)], f"{name} bigint, term string, weight double")
    queries, postings = vec(90, 3, "query_id"), vec(700, 5, "id")
    want = retrieval.ranked(retrieval.sparse_scores(queries, postings), 4, "score", "id", ["query_id"])
    got = retrieval.sparse_best(queries, postings, 4, per_part=500, block=25)
    rows = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) == 360
    assert retrieval.sparse_best(queries.limit(0), postings, 4).count() == retrieval.sparse_best(queries, postings.limit(0), 4).count() == 0


def test_questions_of_the_log_shuffle_no_scores_of_pairs(spark, tmp_path, monkeypatch):
    """``sparse_scores`` shuffles a row for each pair of question and chunk that share a word."""
    from corvina.plans import search

    d = str(tmp_path)
    chunks = spark.range(150).selectExpr("id chunk_id", "id document_id", "0 chunk_index", "concat('polizza ', repeat('a', 3 + cast(id as int) % 7), ' sinistro') text", "cast(null as string) section_title", "1 page_start", "1 page_end", "timestamp'2024-01-01' created_at")
    chunks.write.parquet(f"{d}/chunks.parquet")
    spark.range(60).selectExpr("id * 100 log_id", "concat('polizza sinistro ', repeat('b', 3 + cast(id as int) % 9)) query").write.parquet(f"{d}/query_logs.parquet")
    monkeypatch.delattr(retrieval, "sparse_scores")
    out = search.log_search(spark, d).collect()
    assert len(out) == 180 and {r["rank"] for r in out} == {1, 2, 3}
