"""Cutting oversized texts at natural boundaries by recursive bisection.

A text above the limit is cut at the strongest boundary near its midpoint (blank line, line
end, sentence end, semicolon or colon, comma or dash, space); halves that still exceed the
limit less the overlap are cut again; then every piece but the first is extended backwards by
up to the overlap, starting at a pause within it where there is one.

Only texts above the limit leave the JVM. Null, empty and blank texts and texts within the
limit give no rows. A text without any pause is cut between words near the midpoints. Equal
rows are split alike, each under its own chunk_id. Where ``char_start`` is null it is derived
from ``char_end``, else from the text's place in the document; if the document is missing or
does not hold the text, the pieces' offsets are null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvina.session import table

LIMIT, OVERLAP = 160, 24
#: A word here is a run of characters other than space, tab, line feed and carriage return.
WORD = re.compile(r"[^ \t\n\r]+")
#: Abbreviations after which a full stop ends no sentence (fixed values, lower case).
ABBREVIATIONS = frozenset("art artt n nn nr no pag p pp sig sigg dott avv ing geom rag prof mr mrs ms dr st vs es ecc cfr cap lett ed rev fig tab tel fax co ltd inc approx etc bzw z.b d.h abs av sr sra m mme".split())
PARAGRAPH, LINE, SENTENCE, CLAUSE, COMMA, SPACE = 5, 4, 3, 2, 1, 0


def strengths(text: str, words: list[tuple[int, int]]) -> list[int]:
    """How strongly the text pauses after each word."""
    out = []
    for i, (start, end) in enumerate(words):
        gap = text[end : words[i + 1][0]] if i + 1 < len(words) else ""
        lines = gap.replace("\r\n", "\n").replace("\r", "\n").count("\n")
        tail = text[start:end].rstrip("\"'»”’)]*_")
        if lines > 1:
            out.append(PARAGRAPH)
        elif lines:
            out.append(LINE)
        elif tail.endswith(("!", "?", "…")) or tail.endswith(".") and not _abbreviated(tail, text, words, i):
            out.append(SENTENCE)
        elif tail.endswith((";", ":")):
            out.append(CLAUSE)
        elif tail.endswith((",", "–", "—")):
            out.append(COMMA)
        else:
            out.append(SPACE)
    return out


def _abbreviated(tail: str, text: str, words: list[tuple[int, int]], i: int) -> bool:
    bare = tail[:-1].lower().strip("(«\"'[")
    if bare in ABBREVIATIONS or len(bare) == 1 and bare.isalpha():
        return True
    following = text[words[i + 1][0] : words[i + 1][1]].lstrip("«\"'([*") if i + 1 < len(words) else ""
    return following[:1].islower()


def cuts(strength: list[int], most: int) -> list[tuple[int, int]]:
    """Word ranges of at most ``most`` words, by bisection."""
    done, todo = [], [(0, len(strength))]
    while todo:
        lo, hi = todo.pop()
        n = hi - lo
        if n <= most:
            done.append((lo, hi))
            continue
        middle = lo + n / 2
        best = None
        # Near the midpoint first; the whole range only if the text does not pause there.
        for a, b in ((lo + n // 4, hi - n // 4), (lo + 1, hi)):
            near = [(strength[k - 1], -abs(k - middle), -k) for k in range(max(a, lo + 1), min(b, hi - 1) + 1)]
            best = max(near)
            if best[0] > SPACE:
                break
        if best[0] == SPACE:
            best = (SPACE, 0.0, -(lo + n // 2))
        k = -best[2]
        todo += [(lo, k), (k, hi)]
    return sorted(done)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, words) of the pieces of a text above the limit; the whole text otherwise."""
    words = [m.span() for m in WORD.finditer(text)]
    if len(words) <= limit:
        return [(words[0][0], words[-1][1], len(words))] if words else []
    strength = strengths(text, words)
    out, previous = [], 0
    for lo, hi in cuts(strength, limit - overlap):
        first = lo
        if lo and overlap:
            least = max(lo - overlap, previous)
            # The overlap begins where the text pauses, if it does within reach.
            first = max(((strength[k - 1], -k) for k in range(least, lo) if k > 0 and strength[k - 1] > SPACE), default=(0, -least))[1] * -1
        out.append((words[first][0], words[hi - 1][1], hi - first))
        previous = lo
    return out


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Rows whose text has more than ``limit`` words."""
    long_enough = F.length("text") > 2 * limit  # so many words need as many separators
    return chunks.where(long_enough & (F.size(F.split(F.trim(F.col("text"), F.lit(" \t\n\r")), "[ \t\n\r]+")) > limit))


def split_oversized(chunks: DataFrame, documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, document_id, piece_index, text, char_start, char_end, token_count) of all oversized chunks."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and below the limit")
    long = oversized(chunks.select("chunk_id", "document_id", "text", "char_start", "char_end"), limit)
    at = F.coalesce(F.col("char_start"), F.col("char_end") - F.length("text")).cast("bigint")
    long = long.withColumn("at", at).drop("char_start", "char_end")
    docs = documents.select(F.col("doc_id").alias("document_id"), F.col("text").alias("whole"))
    lost = long.where("at is null")
    needed = docs.join(lost.select("document_id").distinct(), "document_id", "left_semi")
    located = lost.join(needed, "document_id", "left").select("chunk_id", "document_id", "text", F.expr("nullif(instr(whole, text), 0) - 1").cast("bigint").alias("at"))
    rows = long.where("at is not null").select("chunk_id", "document_id", "text", "at").unionByName(located)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for chunk, doc, text, at in zip(f["chunk_id"], f["document_id"], f["text"], f["at"]):
                for i, (a, b, n) in enumerate(split_text(text, limit, overlap)):
                    known = at is not None and at == at
                    out.append((chunk, doc, i, text[a:b], int(at) + a if known else None, int(at) + b if known else None, max(1, n * 135 // 100)))
            frame = pd.DataFrame(out, columns=["chunk_id", "document_id", "piece_index", "text", "char_start", "char_end", "token_count"])
            yield frame.astype({"chunk_id": "Int64", "document_id": "Int64", "char_start": "Int64", "char_end": "Int64"})

    return rows.mapInPandas(run, "chunk_id bigint, document_id bigint, piece_index int, text string, char_start bigint, char_end bigint, token_count int")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "documents"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pieces(spark, sf_dir).where("piece_index = 0").select("chunk_id")


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}
ORACLES = {"p1_found": r"SELECT chunk_id FROM chunks WHERE len(regexp_extract_all(text, '[^ \t\n\r]+')) > 160"}
