"""Repair of text from scanned pages: page furniture, line-end hyphens and misread words.

1. Documents whose lines are wrapped are scans (``ocr_used`` is a hint only).
2. The vocabulary is every word of all other documents. Words of scans that it lacks are looked
   up by intersecting a Levenshtein automaton that also knows merges and splits of two letters
   with tries of the vocabulary. Within reach is what one step of any kind, or two steps that
   scanners are known for (``CONFUSED``), make of a word; every such candidate is found.
   Tries hold the words of one length and one beginning or ending. A step leaves the beginning
   or the ending of a word whole, so a form only visits the tries its automaton can reach.
3. Candidates are ranked by the cost of their edits, how often the word follows its
   neighbour in the corpus, and frequency. A candidate that takes an edit that no scanner is
   known for must be borne out by its neighbour and its frequency, and by the form being rare.
4. Lines at the edges of pages that carry page numbers, or repeat on other pages of their
   document or at page edges of other documents, are furniture. The rest is joined to
   paragraphs, broken words are closed and misread words replaced.

Null, empty and blank texts and chunks of other documents give no rows. A word without a
candidate stays as it is. Chunks that were ingested twice are treated alike, each by itself.
Missing pages, titles or document rows only take evidence away.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvina.session import table, written

HYPHENS = "-‐­¬"
#: What scanners take for what (fixed values: read, meant).
CONFUSED = (
    [("c", "e"), ("e", "c"), ("@", "a"), ("†", "t"), ("0", "o"), ("!", "i"), ("ri", "n"), ("ii", "u"), ("(", "c"), ("5", "s"), ("cl", "d"), ("1", "l"), ("1", "i"), ("rn", "m")]
    + [("y", "v"), ("v", "y"), ("9", "g"), ("ü", "ti"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("6", "b"), ("h", "li"), ("li", "h"), ("2", "z"), ("m", "rn"), ("m", "in"), ("d", "cl"), ("n", "ri"), ("8", "b"), ("3", "e"), ("$", "s"), ("|", "l"), ("vv", "w"), ("u", "ii"), ("in", "m"), ("l", "i"), ("i", "l"), ("4", "a"), ("7", "t"), ("¢", "c"), ("tn", "m"), ("nn", "m"), ("iu", "m"), ("ni", "m")]
)
COST = {pair: 0.2 for pair in CONFUSED}
PLAIN_COST = 1.0
SYMBOLS = set("@†!(0512346789ﬁﬂ$|¢")
NUMBER_LIKE = re.compile(r"^[\W\d_]*$|^\W*(?:[A-Z]{1,4}[-/.]?)?\d[\d\W]*(?:[A-Za-z]{0,3}|bis|ter)?\W*$|.*@.+\..+|.*(?:www\.|https?:|\.(?:example|it|com|org|pdf|docx|md|html))|^\W*\d+(?:st|nd|rd|th|h|°|ª|º|€)\W*$|^\W*[A-Z0-9/.-]*\d[A-Z0-9/.-]*\W*$")
#: Words of page numbers (fixed values).
PAGE_WORDS, OF_WORDS = ("pag", "pagina", "page", "p", "s", "seite", "página"), ("di", "of", "de", "von")
#: Marks of an edition or form in a header, before its number (fixed values).
EDITION_WORDS = ("ed", "ediz", "edizione", "edition", "rev", "vers", "mod")
ROMAN = re.compile(r"^[IVX]{1,5}$")
END = tuple(".!?…:;»”\"")
PART = re.compile(r"['’‘]")
EDGE = ".,;:»«\"“”…)]}[{*_"


def read_cost(read: str, meant: str) -> float:
    return 0.0 if read == meant else COST.get((read, meant), PLAIN_COST)


# --- the automaton and the trie -------------------------------------------------------------


#: States of the automaton by the steps taken: none, one known confusion, one other, two known confusions.
NONE, ONE, OTHER, TWO = range(4)
STEPS = (0, 1, 1, 2)
LEFT = (2, 1, 0, 0)
#: Letters of a beginning or ending that a trie is kept for; words are longer than two of them.
WINDOW = 4


def build_trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        add_word(root, w)
    return root


def add_word(root: dict, word: str) -> None:
    node = root
    for ch in word:
        node = node.setdefault(ch, {})
    node[""] = word


def lookup(word: str, trie: dict, length: int | None = None) -> list[tuple[str, int, float]]:
    """(candidate, steps, cost) of every word of the trie within reach.

    A step replaces, inserts or drops a letter, or reads one letter as two or two as one. One step
    of any kind is within reach, and two that are in ``CONFUSED``. The states of the automaton are
    the positions in ``word`` with the steps taken so far; branches of the trie that no state
    survives are not entered. ``length``: of all words of the trie, if they have the same.
    """
    n = len(word)
    found: list[tuple[str, int, float]] = []

    def step(state: int, cost: float) -> int | None:
        if state == NONE:
            return ONE if cost < PLAIN_COST else OTHER
        return TWO if state == ONE and cost < PLAIN_COST else None

    def walk(node: dict, depth: int, states: dict, earlier: dict, letter: str) -> None:
        if "" in node:
            ends = [(c, k) for (i, k), c in states.items() if i == n] + [(PLAIN_COST, OTHER) for (i, k) in states if i == n - 1 and k == NONE]
            if ends:
                c, k = min(ends)
                found.append((node[""], STEPS[k], c))
        for ch, child in node.items():
            if not ch:
                continue
            new: dict[tuple[int, int], float] = {}

            def put(i: int, k: int | None, c: float) -> None:
                if k is not None and c < new.get((i, k), math.inf) and (length is None or abs(length - depth - 1 - n + i) <= LEFT[k]):
                    new[i, k] = c

            for (i, k), c in states.items():
                if i < n and word[i] == ch:
                    put(i + 1, k, c)
                if k in (NONE, ONE):
                    if k == NONE:
                        put(i, OTHER, c + PLAIN_COST)  # a letter that the form lacks
                        if i + 1 < n and word[i + 1] == ch:
                            put(i + 2, OTHER, c + PLAIN_COST)  # one that it has too much
                    if i < n and word[i] != ch:
                        x = read_cost(word[i], ch)
                        put(i + 1, step(k, x), c + x)
                    if i + 1 < n:
                        x = read_cost(word[i : i + 2], ch)
                        put(i + 2, step(k, x), c + x)
            for (i, k), c in earlier.items():
                if k in (NONE, ONE) and i < n:
                    x = read_cost(word[i], letter + ch)
                    put(i + 1, step(k, x), c + x)
            if new:
                walk(child, depth + 1, new, states, ch)

    walk(trie, 0, {(0, NONE): 0.0}, {}, "")
    return found


def window(length: int) -> int:
    return min(WINDOW, (length - 1) // 2)


def form_keys(form: str) -> set[str]:
    """The keys of all tries that hold candidates of a form (those of words: ``word_keys``).

    The beginning and the ending of a word are apart by at least a letter, so no step touches
    both: one step leaves one of them whole. Of two, either one touches the beginning, or none
    touches the ending.
    """
    n, out = len(form), set()
    for m in range(max(1, n - 2), n + 3):
        h = window(m)
        if h <= n:
            out |= {f"<{m}:{form[:h]}", f">{m}:{form[n - h :]}" if h else f"<{m}:"}
        for i in range(min(n, h + 2)):
            for read, meant in CONFUSED:
                if form.startswith(read, i):
                    out.add(f"<{m}:{(form[:i] + meant + form[i + len(read) :])[:h]}")
    return out


# --- words of a page ------------------------------------------------------------------------


def bare(token: str) -> str:
    """A token without the punctuation around it; marks that may be misread letters stay inside."""
    t = token.strip(EDGE)
    while t[-1:] in "!?" and t[-1:]:
        t = t[:-1].rstrip(EDGE)
    return t.lstrip("(").strip(EDGE)


def forms(token: str) -> list[str]:
    """The lower-case words of a token, or none if it is a number, code or address."""
    if NUMBER_LIKE.match(token):
        return []
    out = []
    for p in PART.split(token):
        b = bare(p)
        if any(c.isalpha() or c in "†" for c in b) and len(b) > 1 and not NUMBER_LIKE.match(b):
            out.append(b.lower())
        edge = p.strip(EDGE).lower()
        if edge != b.lower() and len(edge) > 2 and (edge[0] == "(" or edge[-1] == "!") and any(c.isalpha() for c in edge):
            out.append(edge)  # the mark at its edge may be a letter
    return out


def page_lines(text: str) -> list[str]:
    return text.replace("\r\n", "\n").split("\n")


def broken(line: str) -> str | None:
    """The part of a word before a hyphen at the end of a line."""
    s = line.rstrip()
    if len(s) > 1 and s[-1] in HYPHENS and (s[-2].isalpha() or s[-2] in SYMBOLS) and not s[-2].isdigit():
        return PART.split(s.split()[-1])[-1][:-1].lstrip(EDGE + "(")
    return None


def next_text(lines: list[str], i: int) -> int | None:
    for j in range(i + 1, min(i + 6, len(lines))):
        if lines[j].strip():
            return j
    return None


def wanted_forms(text: str) -> dict[str, bool]:
    """The words of a page whose spelling has to be known, and whether candidates are wanted for them.

    Words broken by a line end are closed in both ways; only the closed word may be misread.
    """
    out: dict[str, bool] = {}
    lines = page_lines(text)

    def want(token: str, candidates: bool) -> None:
        for f in forms(token):
            out[f] = out.get(f, False) or candidates

    skip = False
    for i, line in enumerate(lines):
        tokens = line.split()
        head = broken(line)
        for j, t in enumerate(tokens):
            if j == 0 and skip:
                parts = PART.split(t)
                want(parts[0], False)
                want("'".join(parts[1:]), True)
            elif head is not None and j == len(tokens) - 1:
                want(head, False)
                want("'".join(PART.split(t)[:-1]), True)
            else:
                want(t, "-" not in t)
                if "-" in t:
                    for x in t.split("-"):
                        want(x, True)
        skip = skip and not tokens
        if head is not None:
            for j in range(i + 1, min(i + 6, len(lines))):
                first = lines[j].split()[:1]
                if first and (first[0][0].islower() or first[0][0] in SYMBOLS and not first[0].isdigit()):
                    tail = PART.split(first[0])[0]
                    want(head + tail, True)
                    want(head + "-" + tail, False)
                    skip = skip or j == i + 1
                    if not tail.startswith("www"):
                        break
    return out


# --- furniture ------------------------------------------------------------------------------

FOLDS = (("ü", "ti"), ("ﬁ", "fi"), ("@", "a"), ("†", "t"), ("0", "o"), ("!", "i"), ("(", "c"), ("5", "s"), ("1", "l"), ("9", "g"), ("6", "b"), ("2", "z"), ("e", "c"), ("y", "v"), ("cl", "d"), ("rn", "m"), ("ri", "n"), ("in", "m"), ("ii", "u"), ("li", "h"))


def looks(line: str) -> str:
    """A line as it looks: digits as #, letters that are taken for each other alike."""

    def fold(m: re.Match) -> str:
        p = m.group().lower()
        if not any(c.isalpha() or c in "@†" for c in p):
            return "#" if any(c.isdigit() for c in p) else p
        if sum(c.isdigit() for c in p) > sum(c.isalpha() for c in p):
            return "#"
        for a, b in FOLDS:
            p = p.replace(a, b)
        return p

    return re.sub(r"[^\s.,:;/–—-]+", fold, line.strip())


def skeleton(line: str) -> str:
    """A line as it looks, its numbers as # each."""
    return re.sub(r"#(?:[.,:/-]#)*", "#", looks(line))


def _alike(words: tuple[str, ...]) -> str:
    return "|".join(sorted({looks(w) for w in words}, key=len, reverse=True))


#: Page numbers and editions as they look: misread ones look alike.
PAGE = re.compile(rf"^(?:{_alike(PAGE_WORDS)})?\.?\s*#(?:\s*(?:/|{_alike(OF_WORDS)})\s*#)?$|^[-–—]\s*#\s*[-–—]$")
TAIL_PAGE = re.compile(rf"\s{{2,}}(?:(?:{_alike(PAGE_WORDS)})\.?\s*)?(?:#(?:\s*(?:/|{_alike(OF_WORDS)})\s*#)?|[-–—]\s*#\s*[-–—]|[ivx]{{1,5}})$")
EDITION = re.compile(rf"[-–—]\s*(?:{_alike(EDITION_WORDS)})\.?\s*#")


def is_page_number(line: str) -> bool:
    return bool(PAGE.match(looks(line))) or bool(ROMAN.match(line.strip()))


def core(line: str) -> str:
    """A line's skeleton without the page number at its end."""
    p = line.rstrip()
    m = re.search(r"\s{2,}\S.{0,16}$", p)
    if m and (is_page_number(m.group().strip())):
        p = p[: m.start()]
    return skeleton(p)


def edges(lines: list[str]) -> tuple[list[int], list[int]]:
    """Lines at the top and at the bottom of pages: of the chunk, and around blank lines inside it."""
    filled = [i for i, s in enumerate(lines) if s.strip()]
    if not filled:
        return [], []
    tops, bottoms = [filled[0]], [filled[-1]]
    for a, b in zip(filled, filled[1:]):
        if b > a + 1 and looks_final(lines, a):
            bottoms.append(a)
            tops.append(b)
    # One more line inwards next to a line that is surely a page number.
    for t in list(tops):
        k = filled.index(t)
        if is_page_number(lines[t]) and k + 1 < len(filled) and filled[k + 1] == t + 1:
            tops.append(filled[k + 1])
    for b in list(bottoms):
        k = filled.index(b)
        if k and filled[k - 1] == b - 1 and not lines[b].rstrip().endswith(END):
            bottoms.append(filled[k - 1])
    return tops, bottoms


def looks_final(lines: list[str], i: int) -> bool:
    """Whether a paragraph that ends in this line may end its page: the line is no sentence but ends a block that has one."""
    s = lines[i].rstrip()
    if s.endswith(END) and not PAGE.match(looks(s)):
        return False
    if i == 0 or not lines[i - 1].strip():
        return False
    # Rows of figures are a table, not a page number under text.
    before = lines[i - 1].rstrip()
    if NUMBER_LIKE.match(s) and NUMBER_LIKE.match(before) and not is_page_number(before):
        return False
    return before.endswith(END) or is_page_number(s) or not before[:1].islower()


FIGURES = re.compile(r"^(?:EUR |€ ?|\$ ?)?\d[\d.,/%-]*(?: (?:€|euro|euros|EUR|[^\W\d_]+ \d{4}|per cent))?$")


def in_table(lines: list[str], i: int) -> bool:
    """Whether a line is one of several rows of figures."""
    if not FIGURES.match(lines[i].strip()):
        return False
    near = [lines[j].strip() for j in (i - 1, i + 1) if 0 <= j < len(lines)]
    return any(FIGURES.match(s) and not (is_page_number(s) and not s.isdigit()) for s in near)


def furniture(text: str, page: int | None, heads: set[str], corpus: set[str]) -> set[int]:
    """Indexes of lines printed around the body."""
    lines = page_lines(text)
    tops, bottoms = edges(lines)
    width = max((len(s) for s in lines), default=0)
    out: set[int] = set()
    for b in sorted(bottoms, reverse=True):
        s = lines[b].strip()
        inner = b + 1 < len(lines) and lines[b + 1].strip() and b + 1 not in out
        if inner or FIGURES.match(s) and not is_page_number(s):
            continue
        if is_page_number(s):
            if s.isdigit() and (len(s) > 3 or in_table(lines, b) and (page is None or int(s) not in (page, page + 1))):
                continue
            out.add(b)
        elif skeleton(s) in corpus and (not s.endswith(END)) and not s[:1].islower() or s.lower().startswith("www"):
            out.add(b)
        elif b and (skeleton(s) in corpus or core(s) in heads) and not s.endswith(END):
            out.add(b)
    for t in sorted(tops):
        s = lines[t].strip()
        if t and lines[t - 1].strip() and t - 1 not in out:
            continue
        if is_page_number(s):
            if s.isdigit() and (len(s) > 3 or in_table(lines, t)):
                continue
            out.add(t)
            continue
        p = looks(s)
        below = lines[t + 1].strip() if t + 1 < len(lines) else ""
        if TAIL_PAGE.search(p) or EDITION.search(p):
            out.add(t)
            continue
        if len(s) > 90 or s.endswith((".", ",", ";", "!", "?")) or s[-1] in HYPHENS or FIGURES.match(s) or below[:1].islower():
            continue
        if core(s) in heads or skeleton(s) in corpus:
            out.add(t)
            continue
        j = t + 1
        if j < len(lines) and lines[j].strip():
            first = lines[j].split()[0]
            # Too short to have been wrapped, and a new sentence begins below: a header without a gap.
            if len(s) + 1 + len(first) < width - 1 and (first[:1].isupper() or first[:1] in "«\"“") and broken(s) is None and not NUMBER_LIKE.match(lines[j].strip()):
                out.add(t)
    return out


# --- one chunk ------------------------------------------------------------------------------


def defects(text: str, page: int | None, heads: set[str], corpus: set[str], known: set[str], fixes: dict[str, str]) -> list[tuple[int, str]]:
    """(line from 1, defect) of one page's text."""
    lines = page_lines(text)
    around = furniture(text, page, heads, corpus)
    out: list[tuple[int, str]] = []
    body = [i for i, s in enumerate(lines) if s.strip() and i not in around]
    carried = None  # the rest of a word broken in the line before
    for k, i in enumerate(body):
        tokens = lines[i].split()
        head = broken(lines[i])
        misread = False
        nxt = lines[body[k + 1]].split() if k + 1 < len(body) else []
        tail = PART.split(nxt[0])[0] if nxt else ""
        if head is not None:
            whole, joined = head + tail, head + "-" + tail
            own = _one(joined, known) and not _one(whole, known)
            split_ok = not own and not (lines[i].rstrip()[-1] == "-" and head[-1:].isdigit())
            if lines[i].rstrip()[-1] == "-" and not own and not _one(whole, known) and not _fixable(whole, fixes):
                # Neither spelling is known: its own hyphen where both parts are words of their own.
                split_ok = not (_one(head, known) and _one(tail, known)) and not head.isupper()
            if split_ok and (not tail or tail[:1].islower() or tail[:1] in SYMBOLS or tail.isupper() and head.isupper()):
                out.append((i + 1, "hyphenation"))
                if _fixable(whole, fixes) and not _one(whole, known):
                    good, bad = fixes_of(whole, fixes), bare(whole).lower()
                    at = _first_change(bad, good)
                    if at < len(bare(head)) or at < 0:
                        misread = True
                    last = _last_change(bad, good)
                    if last >= len(bare(head)):
                        carried_next = True
                    else:
                        carried_next = False
                else:
                    carried_next = False
                skip_last = True
            else:
                skip_last, carried_next = False, False
        else:
            skip_last, carried_next = False, False
        for j, t in enumerate(tokens):
            if j == 0 and carried is not None:
                misread |= carried
                rest = PART.split(t)[1:]
                if rest and any(_bad(x, known, fixes) for x in rest):
                    misread = True
                continue
            if skip_last and j == len(tokens) - 1:
                if any(_bad(x, known, fixes) for x in PART.split(t)[:-1]):
                    misread = True
                continue
            if _bad(t, known, fixes):
                misread = True
        carried = carried_next if skip_last else None
        if misread:
            out.append((i + 1, "misread"))
    out += [(i + 1, "furniture") for i in around]
    return sorted(out)


def _one(word: str, known: set[str]) -> bool:
    f = forms(word)
    return bool(f) and f[0] in known


def _fixable(word: str, fixes: dict[str, str]) -> bool:
    f = forms(word)
    return bool(f) and f[0] in fixes


def fixes_of(word: str, fixes: dict[str, str]) -> str:
    return fixes[forms(word)[0]]


def _first_change(a: str, b: str) -> int:
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return i
    return -1 if a == b else min(len(a), len(b))


def _last_change(a: str, b: str) -> int:
    return len(a) - 1 - max(_first_change(a[::-1], b[::-1]), 0)


def _bad(token: str, known: set[str], fixes: dict[str, str]) -> bool:
    """Whether a token holds a wrongly read character."""
    if NUMBER_LIKE.match(token):
        return False
    for f in forms(token):
        if f in known:
            continue
        if f in fixes:
            if f[0] == "(" and forms(f[1:]) and forms(f[1:])[0] in known or f[-1] == "!" and forms(f[:-1]) and forms(f[:-1])[0] in known:
                continue  # a bracket or mark beside a known word
            return True
        if "-" in f:
            if any(_bad(x, known, fixes) for x in f.split("-")):
                return True
            continue
    return False


def fixed(token: str, known: set[str], fixes: dict[str, str]) -> str:
    """A token with its misread words replaced, in their case."""
    out = token
    done: list[str] = []
    # A form with a mark at its edge that may be a letter comes before the same without it.
    for f in sorted(forms(token), key=len, reverse=True):
        if f in known or any(f in x for x in done):
            continue
        # A compound that nothing stands for is repaired in its parts.
        for x in [f] if f in fixes else [p for part in f.split("-") for p in forms(part) if p not in known and p in fixes]:
            at = out.lower().find(x)
            if at >= 0:
                old, new = out[at : at + len(x)], fixes[x]
                new = new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new
                out = out[:at] + new + out[at + len(x) :]
                done.append(f)
    return out


def repaired(text: str, page: int | None, heads: set[str], corpus: set[str], known: set[str], fixes: dict[str, str]) -> str:
    """The body as paragraphs separated by a blank line."""
    lines = page_lines(text)
    around = furniture(text, page, heads, corpus)
    hyphenated = {i for i, d in defects(text, page, heads, corpus, known, fixes) if d == "hyphenation"}
    paragraphs: list[str] = []
    current, gap, open_word = "", False, False
    for i, line in enumerate(lines):
        if i in around:
            gap = gap or not current.rstrip().endswith(END) is False
            continue
        s = line.strip()
        if not s:
            gap = True
            continue
        goes_on = current and not current.rstrip().endswith(END) and (s[:1].islower() or open_word)
        if current and gap and not goes_on and not open_word:
            paragraphs.append(current)
            current = ""
        gap = False
        if open_word:
            current += s
        else:
            current += (" " if current and not current.endswith("-") else "") + s
        open_word = i + 1 in hyphenated
        if open_word:
            current = current[:-1]
    if current:
        paragraphs.append(current)
    return "\n\n".join(" ".join(fixed(t, known, fixes) for t in p.split()) for p in paragraphs)


# --- the corpus -----------------------------------------------------------------------------


def scan_pages(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, document_id, text, page) of the chunks of scans."""
    single = F.col("text").rlike(r"[^\n]\n[^\n]")
    wraps = F.size(F.regexp_extract_all("text", F.lit(r"(?:[\p{Ll},]|[-‐¬\xad])\n[\p{Ll}\p{So}]"), F.lit(0)))
    cand = chunks.where(single).select("chunk_id", "document_id", "text", F.coalesce("page_start", F.lit(-1)).alias("page"), wraps.alias("wraps"))
    hint = documents.where("ocr_used").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("hint"))
    scans = cand.groupBy("document_id").agg(F.sum("wraps").alias("wraps")).join(hint, "document_id", "left")
    scans = scans.where((F.col("wraps") >= 2) | (F.col("wraps") >= 1) & F.col("hint").isNotNull()).select("document_id")
    return cand.drop("wraps").join(scans, "document_id", "left_semi")


WORD_SQL = r"[\p{L}]+(?:-[\p{L}]+)*"


def vocabulary(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(word, n): how often each word occurs in chunks that are not of scans."""
    other = chunks.where("text is not null").join(pages.select("document_id").distinct(), "document_id", "left_anti")
    words = other.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD_SQL), F.lit(0))).alias("word"))
    # Words with a hyphen of their own are few; scans show them too, unbroken in most lines. They count if
    # other documents know all their parts, else a misread one would vouch for itself.
    compounds = pages.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+(?:-[\p{L}]+)+"), F.lit(0))).alias("word"))
    counted = written(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    compounds = written(compounds.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    doubtful = compounds.select(F.col("word").alias("compound"), F.explode(F.split("word", "-")).alias("word")).join(counted, "word", "left_anti").select(F.col("compound").alias("word")).distinct()
    counted = counted.unionByName(compounds.join(doubtful, "word", "left_anti"))
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def word_keys() -> Column:
    """The keys of the tries that hold a ``word``: by its length, and its beginning or ending."""
    m = F.length("word")
    h = F.least(F.lit(WINDOW), F.floor((m - 1) / 2)).cast("int")
    first = F.concat(F.lit("<"), m, F.lit(":"), F.substring(F.col("word"), F.lit(1), h))
    last = F.concat(F.lit(">"), m, F.lit(":"), F.expr(f"right(word, least({WINDOW}, cast(floor((length(word) - 1) / 2) as int)))"))
    return F.when(h > 0, F.array(first, last)).otherwise(F.array(first))


def corrections(unknown: DataFrame, vocab: DataFrame, most: int = 20_000) -> DataFrame:
    """(form, word, cost, n) for every unknown form and every candidate within reach.

    Words and forms meet by the keys of tries; a key with more than ``most`` words is split by the
    hash of the word, and its forms visit every part. Forms whose key no word has are dropped
    before they reach a task. A task builds one trie after the other from rows sorted by key.
    """
    words = vocab.select("word", "n", F.explode(word_keys()).alias("key")).withColumn("h", F.xxhash64("word"))

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(x, k) for x in f["form"] for k in form_keys(x)]
            yield pd.DataFrame(rows, columns=["form", "key"])

    parts = words.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("parts"))
    forms = unknown.select("form").mapInPandas(keyed, "form string, key string").join(parts, "key")
    right = forms.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "form", F.lit(0).cast("bigint").alias("n"))
    left = words.join(parts, "key").select("key", F.pmod("h", "parts").cast("int").alias("part"), F.lit(0).alias("side"), F.col("word").alias("form"), "n")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, trie, count = None, {}, {}
        for b in batches:
            out: list[tuple] = []
            for key, part, side, form, n in zip(*(b.column(c).to_pylist() for c in ("key", "part", "side", "form", "n"))):
                if (key, part) != at:
                    at, trie, count = (key, part), {}, {}
                if side == 0:
                    add_word(trie, form)
                    count[form] = n
                elif trie:
                    length = int(key[1 : key.index(":")])
                    out += [(form, w, c, count[w]) for w, _, c in lookup(form, trie, length)]
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.float64(), pa.int64()))], names=["form", "word", "cost", "n"])

    placed = left.unionByName(right).repartition("key", "part").sortWithinPartitions("key", "part", "side")
    return placed.mapInArrow(meet, "form string, word string, cost double, n bigint").groupBy("form", "word").agg(F.min("cost").alias("cost"), F.max("n").alias("n"))


#: Documents that have a word only scans know, and how many times as many as have what is read as it.
OWN_LEAST, OWN_TIMES = 3, 3
#: What a candidate with an edit that no scanner is known for has to reach, in logarithms of counts.
BORNE_OUT = 3.0


def same_letters(form: Column, word: Column) -> Column:
    """Whether two words differ in accents only, which are a way to write, not misread letters."""
    bare = lambda c: F.translate(c, "àáâäèéêëìíîïòóôöùúûü", "aaaaeeeeiiiioooouuuu")
    return bare(form) == bare(word)


def rank(cost: Column, follows: Column, n: Column) -> Column:
    return F.least(F.log1p(follows), F.lit(6.0)) + F.log1p(n) * 0.3 - cost * 10


def borne_out(cost: Column, follows: Column, n: Column, documents: Column) -> Column:
    """Whether a candidate stands: by a known confusion, or by its neighbour and frequency against the documents that have the form."""
    return (cost < PLAIN_COST) | (F.least(F.log1p(follows), F.lit(6.0)) + F.log1p(n) * 0.3 - F.log(documents) * 2 >= BORNE_OUT)


def evidence(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, document_id, text, page, known, fixes, heads, corpus): all that a page needs to be repaired."""
    pages = written(scan_pages(chunks, documents))
    vocab = written(vocabulary(chunks, pages))

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for c, d, t in zip(f["chunk_id"], f["document_id"], f["text"]):
                before = {}
                for line in page_lines(t):
                    prev = ""
                    for tok in line.split():
                        for w in forms(tok):
                            before.setdefault(w, prev)
                            prev = w
                rows += [(c, d, w, before.get(w, ""), x) for w, x in wanted_forms(t).items()]
            yield pd.DataFrame(rows, columns=["chunk_id", "document_id", "form", "before", "candidates"])

    found = written(pages.select("chunk_id", "document_id", "text").mapInPandas(extract, "chunk_id bigint, document_id bigint, form string, before string, candidates boolean"))
    known = vocab.select(F.col("word").alias("form"), F.lit(True).alias("is_known"))
    marked = found.join(known, "form", "left")
    unknown = written(marked.where("is_known is null and candidates").groupBy("form").agg(F.countDistinct("document_id").alias("documents")))
    cands = written(corrections(unknown, vocab))
    # Words that only scans have: letters, in several documents, and nothing that a scanner may have misread.
    own = unknown.where((F.col("documents") >= OWN_LEAST) & F.col("form").rlike(r"^\p{L}+$"))
    own = written(own.join(cands.where(F.col("cost") < PLAIN_COST).select("form").distinct(), "form", "left_anti").select(F.col("form").alias("word"), F.col("documents").alias("n")))
    rest = corrections(unknown, own).where("form <> word").join(unknown, "form").where(F.col("n") > OWN_TIMES * F.col("documents")).select("form", "word", "cost", "n")
    cands = written(cands.unionByName(rest))
    # Context: how often the candidate follows the word before it.
    asked = written(marked.where("is_known is null").join(cands, "form").select("chunk_id", "form", "word", "cost", "n", F.concat_ws(" ", "before", "word").alias("pair")))
    need = asked.select("pair").distinct()
    toks = F.regexp_extract_all(F.lower("text"), F.lit(WORD_SQL), F.lit(0))
    other = chunks.where("text is not null").join(pages.select("document_id").distinct(), "document_id", "left_anti").select(toks.alias("w"))
    grams = other.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 1)), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))).alias("pair"))
    # Tasks count before anything is shuffled, so a frequent pair travels once a task.
    seen = grams.groupBy("pair").agg(F.count(F.lit(1)).alias("follows")).join(need, "pair", "left_semi")
    follows = F.coalesce("follows", F.lit(0))
    ranked = (
        asked.join(seen, "pair", "left")
        .join(unknown, "form")
        .where(~same_letters(F.col("form"), F.col("word")))
        .where(borne_out(F.col("cost"), follows, F.col("n"), F.col("documents")))
        .groupBy("chunk_id", "form")
        .agg(F.max_by("word", F.struct(rank(F.col("cost"), follows, F.col("n")), "word")).alias("fix"))
    )
    per_chunk = (
        marked.where("is_known").select("chunk_id", "form", F.lit(None).cast("string").alias("fix")).unionByName(ranked)
        .groupBy("chunk_id")
        .agg(F.collect_list(F.struct("form", "fix")).alias("spelling"))
    )

    # Lines at page edges: repeated within the document or, at page ends and tops, across documents.
    def edge_lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for c, d, t in zip(f["chunk_id"], f["document_id"], f["text"]):
                lines = page_lines(t)
                tops, bottoms = edges(lines)
                whole = lambda i: not lines[i].rstrip().endswith((*END, ",")) and not FIGURES.match(lines[i].strip())
                rows += [(c, d, core(lines[i]), i, "top") for i in set(tops) if whole(i)] + [(c, d, skeleton(lines[i]), i, "bottom") for i in set(bottoms) if whole(i)]
            yield pd.DataFrame(rows, columns=["chunk_id", "document_id", "line", "line_no", "place"])

    at_edge = written(pages.select("chunk_id", "document_id", "text").mapInPandas(edge_lines, "chunk_id bigint, document_id bigint, line string, line_no int, place string"))
    index = chunks.where(F.col("text").rlike(r"[^\n]\n[^\n]")).select("chunk_id", "chunk_index")
    # A chunk that was ingested again repeats its own lines: places in the document count once.
    repeated = at_edge.join(index, "chunk_id").groupBy("document_id", "line").agg(F.countDistinct("chunk_index", "line_no").alias("times"), F.countDistinct("chunk_index").alias("pages"))
    heads = repeated.where("times > 1").groupBy("document_id").agg(F.collect_list("line").alias("heads"))
    # Lines of body text, to tell headings from furniture.
    def own_lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, t in zip(f["document_id"], f["text"]):
                rows += [(d, skeleton(s)) for s in t.split("\n") if s.strip() and len(s) < 90 and not s.rstrip().endswith(END)]
            yield pd.DataFrame(rows, columns=["document_id", "line"])

    headings = chunks.where("text is not null").join(pages.select("document_id").distinct(), "document_id", "left_anti").select("document_id", F.explode(F.split("text", "\n")).alias("text")).where("length(text) between 1 and 90 and text not rlike '[.!?:;,]\\\\s*$'").distinct()
    headings = headings.mapInPandas(own_lines, "document_id bigint, line string").groupBy("line").agg(F.count(F.lit(1)).alias("elsewhere"))
    everywhere = at_edge.groupBy("line").agg(F.countDistinct("document_id").alias("docs")).where("docs >= 3").join(headings, "line", "left").where("coalesce(elsewhere, 0) * 5 < docs")
    marks = at_edge.join(everywhere.select("line"), "line", "left_semi").groupBy("chunk_id").agg(F.collect_set("line").alias("corpus"))
    return pages.join(per_chunk, "chunk_id", "left").join(heads, "document_id", "left").join(marks, "chunk_id", "left")


def _inputs(f: pd.DataFrame) -> Iterator[tuple]:
    for c, t, p, spelling, heads, corpus in zip(f["chunk_id"], f["text"], f["page"], f["spelling"], f["heads"], f["corpus"]):
        spelling = spelling if spelling is not None and not isinstance(spelling, float) else []
        known = {x["form"] for x in spelling if x["fix"] is None}
        fixes = {x["form"]: x["fix"] for x in spelling if x["fix"] is not None}
        as_set = lambda v: set(v) if v is not None and not isinstance(v, float) else set()
        yield c, t, (int(p) if p >= 0 else None), as_set(heads), as_set(corpus), known, fixes


def line_defects(proof: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(c, i, d) for c, *rest in _inputs(f) for i, d in defects(*rest)], columns=["chunk_id", "line_no", "defect"])

    return proof.mapInPandas(run, "chunk_id bigint, line_no int, defect string")


def repaired_texts(proof: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(c, repaired(*rest)) for c, *rest in _inputs(f)], columns=["chunk_id", "text"])

    return proof.mapInPandas(run, "chunk_id bigint, text string")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_defects(evidence(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "documents")))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_texts(evidence(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "documents")))


QUERIES = {"p2_found": p2_found, "p2_repaired": p2_repaired}
ORACLES: dict[str, str] = {}
