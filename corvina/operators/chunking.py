"""Splitting documents into overlapping spans with exact offsets, and spans against pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph, start, end): pieces between blank lines with their offsets; blank ones are left out."""
    parts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n\n", -1)).alias("pos", "paragraph"))
    before = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("paragraph") + 2).over(before), F.lit(0)).cast("bigint")
    out = parts.withColumn("start", start).withColumn("end", F.col("start") + F.length("paragraph"))
    return out.where(F.col("paragraph").rlike(r"[^ \t\n\r\f\x0B]")).select(id_col, "paragraph", "start", "end")


def spans_of(text: str, most: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the chunks of one text.

    Paragraphs are gathered until the next would exceed ``most`` words; one that is too long by
    itself is gathered by sentences. A chunk starts with the last pieces of the one before, as
    many as fit into ``overlap`` words, so it may exceed ``most`` by that much.
    """
    pieces: list[tuple[int, int, int]] = []  # start, end, words
    for m in re.finditer(r"(?s)(?:(?!\n\n).)+", text):
        part = m.group()
        if not part.strip():
            continue
        n = len(part.split())
        if n <= most:
            pieces.append((m.start(), m.end(), n))
            continue
        at = 0
        for cut in [*(s.end() for s in re.finditer(r"\. ", part)), len(part)]:
            if cut > at:
                pieces.append((m.start() + at, m.start() + cut, len(part[at:cut].split())))
                at = cut
    out: list[tuple[int, int]] = []
    held: list[tuple[int, int, int]] = []
    size = 0
    for piece in pieces:
        if held and size + piece[2] > most:
            out.append((held[0][0], held[-1][1]))
            keep, size = [], 0
            for p in reversed(held):
                if size + p[2] > overlap:
                    break
                keep.append(p)
                size += p[2]
            held = keep[::-1]
        held.append(piece)
        size += piece[2]
    if held:
        out.append((held[0][0], held[-1][1]))
    return out


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 512, overlap: int = 64) -> DataFrame:
    """(id, chunk_index, start, end, text): text is always the document's slice start:end."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(i, k, a, b, t[a:b]) for i, t in zip(f["id"], f["text"]) for k, (a, b) in enumerate(spans_of(t, most, overlap))]
            yield pd.DataFrame(out, columns=[id_col, "chunk_index", "start", "end", "text"])

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"{id_col} {kind}, chunk_index int, start bigint, end bigint, text string")


def pages_of_spans(spans: DataFrame, pages: DataFrame, doc: str = "document_id", key: str = "chunk_id") -> DataFrame:
    """(key, first_page, last_page): pages that overlap a span, both ends inclusive.

    spans: (doc, key, start, end); pages: (doc, page, page_start, page_end).
    """
    hit = spans.join(pages, doc).where((F.col("page_end") >= F.col("start")) & (F.col("page_start") <= F.col("end")))
    return hit.groupBy(key).agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))
