"""Reading files: validation, dispatch by type, and text of each format."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvina.functions import text as T

#: Content types an upload may have, besides text/* (fixed values).
ACCEPTED = ("application/pdf", "application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/html", "application/json", "application/octet-stream")
MOST_BYTES = 100 * 1024 * 1024
WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def upload_error(content_type: Column, size: Column) -> Column:
    """Why an upload is refused, or null."""
    known = content_type.isin(*ACCEPTED) | content_type.startswith("text/")
    return F.when(~F.coalesce(known, F.lit(False)), "unsupported type").when(F.coalesce(size, F.lit(0)) <= 0, "empty file").when(size > MOST_BYTES, "too large")


def parser_of(content_type: Column, filename: Column) -> Column:
    """The parser for a file by content type or extension, in a fixed order."""
    c, n = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.coalesce(filename, F.lit("")))
    word = c.isin("application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
    plain = F.lit(False)
    for e in (".txt", ".csv", ".json", ".md"):
        plain = plain | n.endswith(e)
    return (
        F.when((c == "application/pdf") | n.endswith(".pdf"), "pdf")
        .when(word | n.endswith(".docx") | n.endswith(".doc"), "docx")
        .when((c == "text/html") | n.endswith(".html") | n.endswith(".htm"), "html")
        .when(c.startswith("text/") | (c == "application/json") | plain, "text")
        .otherwise("text_fallback")
    )


def docx_text(data: bytes) -> str | None:
    """Paragraphs with text, separated by a blank line; None for a broken file."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{WORD_NS}t")) for p in root.iter(f"{WORD_NS}p"))
    return "\n\n".join(p for p in paragraphs if p.strip())


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, parser, text, error) of all files under ``path``.

    HTML and plain text are decoded in the JVM, DOCX in Arrow batches. A file that cannot be
    read gets an error instead of a text; PDF and images need a parser that is not built in.
    Spark's file source leaves out files of no bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
    files = files.withColumn("parser", parser_of(F.lit(""), F.col("path"))).withColumn("size_error", F.when(F.col("length") == 0, "empty file").when(F.col("length") > MOST_BYTES, "too large"))
    # Bytes that are no UTF-8 are left out.
    decoded = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    simple = files.where("parser <> 'docx'").select(
        "path",
        "parser",
        F.when(F.col("size_error").isNull() & (F.col("parser") == "html"), T.html_text(decoded)).when(F.col("size_error").isNull() & F.col("parser").isin("text", "text_fallback"), decoded).alias("text"),
        F.coalesce("size_error", F.when(F.col("parser") == "pdf", F.lit("no parser for pdf"))).alias("error"),
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [None if e else docx_text(bytes(c)) for c, e in zip(f["content"], f["size_error"])]
            yield pd.DataFrame({"path": f["path"], "parser": f["parser"], "text": texts, "error": [e or (None if t is not None else "broken file") for t, e in zip(texts, f["size_error"])]})

    word = files.where("parser = 'docx'").mapInPandas(run, "path string, parser string, text string, error string")
    return simple.unionByName(word)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Retrieval cases of a JSON file: an object with ``cases``, or a bare list."""
    df = spark.read.option("multiLine", "true").json(path)
    return df.select(F.explode("cases").alias("c")).select("c.*") if "cases" in df.columns else df


def tolerant_json(text: Column, schema: str) -> Column:
    """A JSON object, also when other text surrounds it; null if there is none."""
    whole = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    inner = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)
    return F.when(F.try_parse_json(F.trim(text)).isNotNull(), whole).otherwise(inner)


EXTRACTION = "struct<entities:array<struct<id:string,name:string,type:string>>,relations:array<struct<source_id:string,target_id:string,type:string>>>"


def extracted(rows: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Entities (id_col, temp_id, id, name, type) and relations (id_col, src, type, dst) from model output.

    Relations whose ends are no listed entities, or are the same, are left out; of equal ones the
    first stays; entities without a name are skipped; a missing relation type is RELATED_TO.
    """
    parsed = rows.select(F.col(id_col), tolerant_json(F.col(text_col), EXTRACTION).alias("j")).where("j is not null")
    ents = parsed.select(id_col, F.explode("j.entities").alias("e")).where("length(trim(e.name)) > 0").select(id_col, F.coalesce("e.id", "e.name").alias("temp_id"), T.entity_id(F.col("e.name"), F.col("e.type")).alias("id"), F.trim("e.name").alias("name"), F.coalesce("e.type", F.lit("unknown")).alias("type"))
    rels = parsed.select(id_col, F.posexplode("j.relations").alias("pos", "r")).select(id_col, "pos", "r.source_id", "r.target_id", F.coalesce(F.nullif(F.trim("r.type"), F.lit("")), F.lit("RELATED_TO")).alias("type"))
    ids = ents.select(id_col, "temp_id", "id").distinct()
    rels = rels.join(ids.select(id_col, F.col("temp_id").alias("source_id"), F.col("id").alias("src")), [id_col, "source_id"]).join(ids.select(id_col, F.col("temp_id").alias("target_id"), F.col("id").alias("dst")), [id_col, "target_id"]).where("src <> dst")
    kept = rels.groupBy(id_col, "src", "dst", F.lower("type").alias("_t")).agg(F.min_by("type", "pos").alias("type"))
    return ents, kept.select(id_col, "src", T.relation_type(F.col("type")).alias("type"), "dst")
