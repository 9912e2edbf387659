"""Scalar text functions as Column expressions: they stay inside the JVM.

Patterns use ASCII classes for blanks (space, tab, line ends, form feed, vertical tab).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLANKS = r"[ \t\n\r\f\x0B]+"
#: Marks stripped from both ends of a token (fixed values).
EDGE_MARKS = r"[.,;:!?()\[\]{}\"«»–—-]+"
#: Words without weight in sparse vectors (fixed values).
SPARSE_STOP_WORDS = (
    "a ad agl agli ai al all alla alle allo anche are che chi ci coi col come con contro da dagl dagli dai dal dall dalla dalle dallo degl degli dei "
    "del dell della delle dello di e ed egli ella esso fur gli ha hai hanno ho i il in io l la le li lo ma me mi mia mie miei mio ne negl negli "
    "nei nel nell nella nelle nello noi non nostri nostro o od per poi qua quale quanta quante quanti quanto quel quella quelle quelli quest questa queste questi questo "
    "qui se sei si sia siamo siete sono su sua sue sugl sugli sui sul sull sulla sulle sullo suo suoi ti tra tu tua tue tuo tuoi tutti tutto un una uno vi voi "
    "vostri vostro the and for but not you all can had her was one our out day get has him his how its may new now old see two who boy did she use "
    "way many oil sit set run eat far sea eye ago off too any say man try ask end why let put own tell very when much would"
).split()
#: Words left out of token sets (fixed values).
SET_STOP_WORDS = "the and for con per che del della gli una".split()


def strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def sparse_tokens(text: Column) -> Column:
    """Lower-case words of at least three letters, without stop words and marks around them."""
    parts = F.split(F.lower(text), BLANKS)
    bare = F.transform(parts, lambda t: F.regexp_replace(t, f"^{EDGE_MARKS}|{EDGE_MARKS}$", ""))
    # A list of literals is looked up as a hash set.
    return F.filter(bare, lambda t: (F.length(t) >= 3) & t.rlike(r"^\p{L}+$") & ~t.isin(*SPARSE_STOP_WORDS))


def token_set(text: Column) -> Column:
    """Distinct runs of three or more word characters, lower-case, without ten stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[0-9A-Za-z_À-ÿ]{3,}"), F.lit(0))), strings(SET_STOP_WORDS))


def jaccard(a: Column, b: Column) -> Column:
    """0 when either set is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "), F.lit(" \u00a0"))


def quote(text: Column, most: int = 320) -> Column:
    """The start of a text, cut after a whole word, with dots where it was cut."""
    clean = one_line(text)
    head = F.substring(clean, 1, most)
    whole = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.regexp_replace(whole, r"[.,;:]+$", ""), F.lit("...")))


def reference(filename: Column, page_start: Column, page_end: Column, section: Column, index: Column) -> Column:
    """File name with pages, else section, else part."""
    pages = F.when(page_end.isNotNull() & (page_end != page_start), F.concat(F.lit("pagine "), page_start.cast("string"), F.lit("-"), page_end.cast("string"))).otherwise(
        F.concat(F.lit("pagina "), page_start.cast("string"))
    )
    where = (
        F.when(page_start.isNotNull(), pages)
        .when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("sezione: "), section))
        .when(index.isNotNull(), F.concat(F.lit("parte "), (index + 1).cast("string")))
    )
    return F.concat_ws(", ", F.coalesce(F.nullif(filename, F.lit("")), F.lit("documento")), where)


def section_title(text: Column) -> Column:
    """The first line with text if it is at most 120 characters and reads like a heading."""
    line = F.element_at(F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), lambda s: F.trim(F.regexp_replace(s, r"^[ \t\f\x0B]+|[ \t\f\x0B]+$", ""))), lambda s: s != ""), 1)
    upper = (F.upper(line) == line) & (F.lower(line) != line)
    return F.when((F.length(line) <= 120) & (upper | ~line.rlike(r"[.:;,]$")), line)


def token_count(text: Column) -> Column:
    """max(1, floor(words * 1.35))."""
    words = F.size(F.filter(F.split(text, BLANKS), lambda t: t != ""))
    return F.greatest(F.lit(1), F.floor(words * F.lit(135) / F.lit(100))).cast("int")


def safe_filename(name: Column) -> Column:
    base = F.trim(F.element_at(F.split(name, r"[/\\]"), -1))
    return F.substring(F.regexp_replace(F.coalesce(F.nullif(base, F.lit("")), F.lit("unnamed")), r"[^A-Za-z0-9._ -]", "_"), 1, 180)


def document_context(filename: Column, category: Column, description: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Documento: "), filename),
        F.concat(F.lit("Categoria: "), F.nullif(category, F.lit(""))),
        F.concat(F.lit("Descrizione: "), F.trim(F.nullif(description, F.lit("")))),
    )


def embedding_input(context: Column, section: Column, text: Column) -> Column:
    return F.concat_ws("\n\n", context, F.concat(F.lit("Sezione: "), F.nullif(section, F.lit(""))), text)


def normalised_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), BLANKS, " "))


def entity_id(name: Column, kind: Column) -> Column:
    """The first 32 hex digits of sha256 of type and name; a missing type is 'unknown'."""
    k = normalised_name(F.coalesce(kind, F.lit("")))
    return F.substring(F.sha2(F.concat_ws(":", F.when(k == "", F.lit("unknown")).otherwise(k), normalised_name(name)), 256), 1, 32)


def relation_type(value: Column) -> Column:
    """Upper case; other characters become one underscore; must start with a letter."""
    t = F.regexp_replace(F.regexp_replace(F.upper(F.trim(value)), r"[^A-Z0-9_]", "_"), r"_+", "_")
    t = F.regexp_replace(t, r"^_+|_+$", "")
    return F.when(t.rlike(r"^[A-Z]"), t).otherwise(F.lit("RELATED_TO"))


def hash_components(text: Column, dims: int = 64) -> Column:
    """A unit vector made of the bytes of sha256, repeated: the stand-in for an embedding model."""
    # One-element arrays bind the digest, the bytes and their norm, so each is computed once a text.
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    bytes_of = lambda digest: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 * 2 - 1)
    raw = once(F.sha2(text, 256), bytes_of)
    with_norm = once(raw, lambda r: F.struct(r.alias("r"), F.sqrt(F.aggregate(r, F.lit(0.0), lambda a, x: a + x * x)).alias("n")))
    return once(with_norm, lambda v: F.transform(v["r"], lambda x: F.when(v["n"] > 0, x / v["n"]).otherwise(x)))


def html_text(html: Column) -> Column:
    """Text of an HTML page: script and style dropped, a blank line before each block element."""
    blocks = "address|article|aside|blockquote|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, rf"(?i)<({blocks})\b[^>]*>", "\n\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"[ \t\r\f\x0B]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\n[ \t]+", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def markdown_table(rows: Column) -> Column:
    """array<array<string>> as a table: nulls are empty, pipes escaped, blank rows left out, rows padded."""
    cell = lambda c: F.replace(F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(clean, F.size))
    padded = F.transform(clean, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = line(F.array_repeat(F.lit("---"), width))
    lines = F.concat(F.array(line(F.element_at(padded, 1)), rule), F.transform(F.slice(padded, 2, F.greatest(F.size(padded) - 1, F.lit(0))), line))
    return F.when(F.size(clean) > 0, F.array_join(lines, "\n")).otherwise(F.lit(""))


#: US dollars a million tokens, input and output (fixed values).
MODEL_COSTS = {
    "gpt-5.4": (2.50, 10.00),
    "gpt-5.4-mini": (0.15, 0.60),
    "gpt-5.4-nano": (0.075, 0.30),
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4o": (2.50, 10.00),
    "text-embedding-3-large": (0.13, 0.0),
    "text-embedding-3-small": (0.02, 0.0),
}


def cost_usd(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """Rounded to six places; an unknown model costs what gpt-4o-mini costs."""
    i, o = F.lit(MODEL_COSTS["gpt-4o-mini"][0]), F.lit(MODEL_COSTS["gpt-4o-mini"][1])
    for name, (a, b) in MODEL_COSTS.items():
        i, o = F.when(model == name, F.lit(a)).otherwise(i), F.when(model == name, F.lit(b)).otherwise(o)
    return F.round(input_tokens / F.lit(1e6) * i + output_tokens / F.lit(1e6) * o, 6)


#: Words that decide the intent of a question, by priority (fixed values).
DIRECT = ["ciao", "salve", "buongiorno", "buonasera", "chi sei", "come stai", "cosa sai fare", "come funzioni", "chi ti ha creato"]
SUMMARY = ["sommario", "temi principali", "riassumi", "panoramica", "argomenti", "tema", "argomento", "trattati", "trattate", "sintesi", "overview", "riassunto"]
RELATIONAL = [
    "quali", "elenca", "dipende", "dipendono", "collegato", "collegati", "collegata", "relazione", "relazioni", "connessione", "connessioni", "collega",
    "legati", "legato", "collegamento", "collegamenti", "associato", "associati", "collegato a", "legato a",
]


def intent(query: Column) -> Column:
    """direct, summary, relational or factual by words contained; an empty question is direct."""
    q = F.lower(F.coalesce(query, F.lit("")))

    def has(words: list[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | q.contains(w)
        return out

    return F.when((F.trim(q) == "") | has(DIRECT), "direct").when(has(SUMMARY), "summary").when(has(RELATIONAL), "relational").otherwise("factual")


def query_entities(query: Column) -> Column:
    """Quoted strings and capitalised runs of more than two letters, sorted."""
    quoted = F.regexp_extract_all(query, F.lit(r'"([^"]+)"'), F.lit(1))
    runs = F.regexp_extract_all(query, F.lit(r"[A-Z][a-zA-Z \t\n]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(quoted, runs), lambda s: F.trim(s)), lambda s: F.length(s) > 2)))


def read_only_pattern(query: Column) -> Column:
    """Whether a graph query starts with MATCH and holds no writing keyword outside of strings."""
    bare = F.regexp_replace(query, r"'[^']*'|\"[^\"]*\"", "")
    return F.coalesce(F.upper(F.trim(bare)).startswith("MATCH") & ~F.upper(bare).rlike(r"\b(CREATE|DELETE|DETACH|SET|REMOVE|MERGE|DROP)\b"), F.lit(False))


#: Name spaces of name-based identifiers (fixed values of RFC 9562).
NAMESPACE_DNS, NAMESPACE_URL = "6ba7b8109dad11d180b400c04fd430c8", "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """The name-based UUID (version 5) of a string, from SHA-1 inside the JVM."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def indexing_progress(done: Column, total: Column) -> Column:
    """80 to 98 per cent while chunks are indexed."""
    return (F.lit(80) + F.floor(done / total * 18)).cast("int")


def setting_list(value: Column) -> Column:
    """The parts of a comma-separated setting, without blank ones."""
    return F.filter(F.transform(F.split(value, ","), F.trim), lambda x: x != "")


def row_lines(row: Column, names: list[str]) -> Column:
    """One result row as ``- name: value, name: value``."""
    return F.concat(F.lit("- "), F.concat_ws(", ", *[F.concat(F.lit(f"{n}: "), row[n].cast("string")) for n in names]))


def merged_context(*parts: Column) -> Column:
    """Context texts one after the other; empty ones are left out."""
    return F.concat_ws("\n", *[F.nullif(F.trim(p), F.lit("")) for p in parts])
