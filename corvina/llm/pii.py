"""Personal information in free text: found in a normalised copy, replaced in the source.

A transducer rewrites what hides identifiers (homoglyphs, invisible characters, "chiocciola",
"(at)", "[at]", "punto", "(dot)", blanks around @, spelled digits) and records for every
character of the result which source characters it stands for. Patterns run over the
normalised text; their spans are mapped back, so finds are cut from the source exactly as
written and everything else stays untouched.

Names are one or two given names or an initial with a surname, in either order and any case,
and two unknown capitalised words after a title. A surname is a word that the corpus does not
use in lower case like a common word. Given names are a seed list and what the corpus shows to
be one: a word that is never common and mostly stands before words that follow known given
names (``learnt_given``). Both are counted over all chunks. Spans inside an e-mail or an
address are no finds of their own.

Null, empty and blank texts give no finds and stay as they are. A field's equal finds are one
row; a log_id that was delivered twice is one row. Texts of any length are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvina.session import table, written

KINDS = ("email", "phone", "identity", "address", "name")
#: Given names (fixed values: Italian, English, French, German and Spanish ones in common use).
GIVEN = frozenset(
    """alberto alessandra alessandro alessia andrea angela angelo anna antonio antonella arianna beatrice bruno camilla carla carlo
    caterina cecilia chiara cinzia claudia claudio cristina daniela daniele dario davide donatella edoardo elena eleonora elisa
    elisabetta emanuele emma enrico enzo fabio federica federico filippo francesca francesco gabriele giacomo gianluca gianni
    giorgia giorgio giovanni giulia giuseppe giuseppina ilaria irene laura leonardo lorenzo luca lucia luciano luisa ludovica luigi
    maddalena manuela marco margherita maria mario marta martina massimo matteo maurizio mauro michela michele monica nadia
    nicola nicoletta paola paolo patrizia pietro raffaele renato riccardo rita roberta roberto rosa salvatore sandra sara
    sergio silvia simona simone sofia stefania stefano teresa tommaso umberto valentina valeria valerio veronica vincenzo vittorio
    adam alice amy andrew anthony benjamin charles charlotte christopher daniel david edward eleanor elizabeth emily ethan george
    grace hannah harriet helen henry isabel jack jacob james jane jessica john joseph joshua julia kate katherine lucy margaret
    mark martin matthew michael nicholas oliver olivia patrick peter philip rachel rebecca richard robert samuel sarah simon sophie
    stephen susan thomas victoria william pierre jean luc marie hans karl jürgen juan josé carmen pablo""".split()
)
PARTICLE = r"(?:[Dd]['’]\s?|D['’]|(?:Di|De|Del|Della|Dal|Dalla|Lo|La|Li|Da|Van|Von|Mac|Mc|O['’]|DI|DE|DEL|LO|LA|di|de|lo|la|del|della|dal)\s(?!\s))"
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
SURNAME_RIGHT = re.compile(rf"\s{{1,2}}({PARTICLE}?)([{LETTER}]{{3,}}(?:[-][{LETTER}]{{3,}})?)(?![{LETTER}'’])")
SURNAME_LEFT = re.compile(rf"(?<![{LETTER}'’.@])({PARTICLE}?)([{LETTER}]{{3,}}(?:[-][{LETTER}]{{3,}})?)\s{{1,2}}$")
WORD = re.compile(rf"[{LETTER}]+")
INITIAL = re.compile(rf"(?<![\w.@/-])([A-Za-z])\.\s?((?:{PARTICLE})?)([{LETTER}]{{4,}}(?:-[{LETTER}]{{3,}})?)(?![{LETTER}'’@])")
NEXT_GIVEN = re.compile(rf"\s{{1,2}}([{LETTER}]+)(?![{LETTER}])")
NEXT_INITIAL = re.compile(r"\s([A-Z]\.)(?=\s)")
TITLED = re.compile(rf"(?<![\w.])(?:[Ss]igg?\.(?:ra)?|[Ss]ignora?|[Dd]ott\.(?:ssa)?|[Dd]ottoressa|[Aa]vv\.|[Ii]ng\.|[Gg]eom\.|[Rr]ag\.|[Pp]rof\.(?:ssa)?|Mr\.?|Mrs\.?|Ms\.?|Miss|Dr\.?)\s([A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{{2,}})\s((?:{PARTICLE})?[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{{2,}}(?:-[{LETTER}]{{3,}})?)(?![{LETTER}'’@])")
#: The words that ``TITLED`` begins with.
TITLES = frozenset("sig sigg signor signora dott dottoressa avv ing geom rag prof mr mrs ms miss dr".split())
#: Words before a name that are titles or functions and never its surname (fixed values).
NO_SURNAME = frozenset("sig sigg signor signora signore dott dottor dottoressa avv ing geom rag prof mr mrs ms miss dr sono chiamo contattare con per dal del alla della name contact call from sir il la lo che non and with the for mister polizza modulo progetto policy module project claim file".split())

STREET_IT = r"(?:[Vv]ia|VIA|[Vv]iale|VIALE|[Vv]\.le|V\.LE|[Pp]iazza|PIAZZA|[Pp]\.zza|P\.ZZA|[Pp]\.za|[Pp]iazzale|PIAZZALE|[Pp]\.le|[Cc]orso|CORSO|[Cc]\.so|C\.SO|[Ll]argo|LARGO|[Ll]\.go|[Vv]icolo|VICOLO|[Vv]ico|[Cc]ontrada|CONTRADA|[Cc]\.da|[Ss]trada|STRADA|[Ss]alita|[Ll]ungomare|[Ll]ocalità|[Ff]razione|[Rr]ione|[Bb]orgata|[Vv]\.)"
LINK = r"(?:dei|del|della|delle|degli|dell['’]|dello|di|da|d['’]|al|alla|ai|la|lo|il|e|in|DEI|DEL|DELLA|DELLE|DEGLI|DELL['’]|DI|DA|D['’])"
PROPER = rf"[A-ZÀ-ÖØ-Þ][{LETTER}'’.]*"
HOUSE_IT = r"(?:,?\s(?:n\.?|N\.?|n°|nr\.?|num\.?|numero|civico)\s?|,?\s)(\d{1,4}(?:\s?/\s?(?:\d{1,3}|[A-Za-z])(?!\w)|\s?(?:bis|ter|BIS|TER)(?!\w)|[A-Za-z](?!\w))?)(?![\w/]|[.,]\d)"
ADDRESS_IT = re.compile(rf"(?<![\w'’.]){STREET_IT}\s(?:{LINK}\s?)?(?:{PROPER}\s(?:{LINK}\s?)?){{0,4}}{PROPER}{HOUSE_IT}")
ADDRESS_LOW = re.compile(rf"(?<![\w'’.])(?:via|viale|piazza|largo|vicolo|contrada|corso|strada|v\.le|p\.zza|c\.so|l\.go)\s(?:{LINK}\s?)?(?:[a-zà-ÿ'’]+\s(?:{LINK}\s?)?){{0,3}}[a-zà-ÿ]{{3,}}{HOUSE_IT}")
NOT_LOW = re.compile(r"\b(?:mese|pec|di\s\d|per|con|telematica|breve|giorno|anno|formazione|segnalazioni|il|che|alle|ore|dal)\b")
STREET_EN = r"(?:Street|Road|Avenue|Lane|Row|Drive|Close|Way|Square|Court|Place|Terrace|Crescent|Gardens|Hill|Grove|Walk|Mews|St\.|Rd\.?|Ave\.?)"
ADDRESS_EN = re.compile(rf"(?<![\w/.,-])\d{{1,4}}\s?[A-Za-z]?\s(?:[A-Z][a-z'’]+\s){{1,4}}{STREET_EN}(?![a-z])|(?<![\w/.,-])\d{{1,4}}[A-Z]?\s(?:[A-Z'’]+\s){{1,4}}(?:STREET|ROAD|AVENUE|LANE|ROW|DRIVE|CLOSE|WAY|SQUARE|COURT)(?![A-Z])|(?<=\bat )\d{{1,4}}[a-z]?\s(?:[a-z'’]+\s){{1,3}}(?:street|road|avenue|lane|row|drive|close|way|square|court)\b")
STREET_WORDS = frozenset("via viale piazza piazzale corso largo vicolo vico contrada strada salita lungomare località frazione rione borgata zza".split())
STREET_SHORT = ("v.", "v.le", "c.so", "p.za", "l.go", "p.le", "c.da")
STREET_EN_WORDS = frozenset("street road avenue lane row drive close way square court place terrace crescent gardens hill grove walk mews st rd ave".split())

EMAIL = re.compile(r"(?<![\w.+@-])[A-Za-z0-9_][\w.+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w@])")
PHONE = re.compile(
    r"(?<![\w/,+-])(?<!\d\.)(?<![-/]\d)(?:"
    r"(?:\+|00)\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ ./-]?\d{2,4}){1,4}"
    r"|\(\+?\d{2,4}\)[ .-]?\d{3,4}(?:[ .-]?\d{2,4}){0,2}"
    r"|(?:0\d{1,4}|3\d{2})[ /.-]\d{2,4}(?:[ .-]?\d{2,4}){1,3}"
    r"|(?:0\d{1,4}|3\d{2})/\d{5,8}"
    r"|0\d{4}[ -]\d{6}"
    r"|[03]\d{8,10}"
    r"|[2-9]\d{2}[-.]\d{3}[-.]\d{4}"
    r")(?![\w/]|[.,-]\d)"
)
DATE = re.compile(r"^\d{1,2}[./-]\d{1,2}[./-]\d{4}$|^\d{4}[-/]")
CODE_BEFORE = re.compile(r"(?:\bn\.?|\bN\.?|n°|\bno\.?|case|pratica|ticket|fattura|invoice|polizza|policy|codice|code|registro|documento|document|EUR|€|\$)\s*$")
IDENTITY = re.compile(
    r"(?<![\w-])(?:[A-Za-z]{3} ?[A-Za-z]{3} ?[\dLMNP-V]{2}[A-EHLMPR-Ta-ehlmpr-t][\dLMNP-V]{2} ?[A-Za-z][\dLMNP-V]{3} ?[A-Za-z]"
    r"|[A-Z]{2} ?\d{7}|[A-Z]{2} ?\d{5} ?[A-Z]{2}|[a-z]{2}\d{5}[a-z]{2})(?![\w-])"
)
IDENTITY_LOW = re.compile(r"(?:(?<=documento )|(?<=passport )|(?<=passaporto )|(?<=identità )|(?<=fiscale )|(?<=document ))[a-z]{2} ?\d{7}(?!\w)")
SEVEN_DIGITS = re.compile(r"\d{7}")

HOMOGLYPHS = {  # look-alikes of other scripts, blanks and dashes (fixed values)
    **dict(zip("\u0430\u0435\u043e\u0440\u0441\u0445\u0443\u0456", "aeopcxyi")),
    **dict(zip("\u0410\u0412\u0415\u041a\u041c\u041d\u041e\u0420\u0421\u0422\u0425", "ABEKMHOPCTX")),
    **dict(zip("\u03bf\u03b1\u039f\u0391", "oaOA")),
    **dict.fromkeys("\u00a0\u2007\u2009\u202f\u3000", " "),
    **dict.fromkeys("\u2010\u2011\u2012\u2013\u2212", "-"),
    "\uff20": "@",
    "\uff0e": ".",
}
INVISIBLE = frozenset("\u200b\u200c\u200d\u2060\ufeff\u00ad")
DIGITS = {w: str(i) for ws in ("zero uno due tre quattro cinque sei sette otto nove", "zero one two three four five six seven eight nine") for i, w in enumerate(ws.split())} | {"oh": "0"}
AT = re.compile(r"(?<=[\w])(?:\s?[\[({<]\s?(?:at|chiocciola)\s?[\])}>]\s?|\s+(?:chiocciola|AT|CHIOCCIOLA)\s+|\s?@\s?|\s+at\s+(?=[\w-]+\s+(?:dot|punto)\s))(?=\w)", re.I)
DOT = re.compile(r"(?<=\w)(?:\s?[\[({<]\s?(?:dot|punto)\s?[\])}>]\s?|\s+(?:punto|dot|PUNTO|DOT)\s+)(?=\w)", re.I)
SPELLED = re.compile(rf"\b(?:{'|'.join(DIGITS)})(?:[\s,-]+(?:{'|'.join(DIGITS)})){{5,}}\b", re.I)
HAS_AT = re.compile(r"@|chiocciola|[\[({<]\s?at\s?[\])}>]|\bat\s+[\w-]+\s+(?:dot|punto)\b", re.I)
PLAIN = re.compile(r"^[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u20ac\u00ab\u00bb\u201c\u201d\u2018\u2019\u2026\u2022]*$")


def normalise(text: str) -> tuple[str, list[int]]:
    """(normalised text, for each of its characters and its end the place in ``text``)."""
    norm, at, _ = _normalised(text)
    return norm, list(at)


def _normalised(text: str) -> tuple[str, Sequence[int], list[str]]:
    """As ``normalise``, with the words in lower case; the places of a text that stays as it is are a range."""
    plain = PLAIN.match(text) is not None
    if plain:
        norm, at = text, range(len(text) + 1)
    else:
        out: list[str] = []
        at = []
        for i, c in enumerate(text):
            if c in INVISIBLE:
                continue
            d = HOMOGLYPHS.get(c)
            if d is None:
                d = unicodedata.normalize("NFKC", c) if ord(c) > 0xFEFF or 0x2460 <= ord(c) <= 0x24FF else c
            for x in d:
                out.append(x)
                at.append(i)
        at.append(len(text))
        norm = "".join(out)
    lower = norm.lower()
    words = WORD.findall(lower)
    # In a plain text a word tells whether a pattern can match; others have letters that only patterns fold.
    has_at = not plain or "@" in norm or "at" in words or "chiocciola" in lower
    spelled = not plain or sum(map(DIGITS.__contains__, words)) >= 6
    before = norm
    for rule, put in ((AT, "@"), (DOT, ".")):
        if (rule is AT and has_at and HAS_AT.search(norm)) or (rule is DOT and "@" in norm):
            norm, at = _rewrite(norm, at, rule, lambda m, p=put: p)
    if spelled and SPELLED.search(norm):
        norm, at = _rewrite(norm, at, SPELLED, lambda m: "".join(DIGITS[w.lower()] for w in re.findall(r"[A-Za-z]+", m.group())))
    return norm, at, words if norm == before else WORD.findall(norm.lower())


def _rewrite(text: str, at: Sequence[int], rule: re.Pattern, put) -> tuple[str, list[int]]:
    out, places, last = [], [], 0
    for m in rule.finditer(text):
        if rule is DOT and "@" not in text[max(0, m.start() - 60) : m.start()] and "@" not in text[m.end() : m.end() + 40]:
            continue
        new = put(m)
        out += [text[last : m.start()], new]
        places += at[last : m.start()]
        # The first character stands for the start of what it replaces.
        places += [at[m.start()]] * len(new)
        last = m.end()
    out.append(text[last:])
    places += at[last:]
    return "".join(out), places


def _end(at: Sequence[int], text: str, end: int) -> int:
    """The source place just after normalised character ``end - 1``."""
    stop = at[end]
    # Characters that were left out after the find do not belong to it.
    while stop > at[end - 1] + 1 and (text[stop - 1] in INVISIBLE or text[stop - 1].isspace()):
        stop -= 1
    return stop


def finds(text: str, common: frozenset | set, given_names: frozenset = GIVEN) -> list[tuple[int, int, str]]:
    """(start, end, kind) in ``text``, in order and apart."""
    norm, at, found = _normalised(text)
    lower = norm.lower()
    words = set(found)
    digit = re.search(r"\d", norm) is not None
    given = not given_names.isdisjoint(words)
    titled = not TITLES.isdisjoint(words) and TITLED.search(norm) is not None
    initial = INITIAL.search(norm) is not None
    street = digit and (not STREET_WORDS.isdisjoint(words) or any(s in lower for s in STREET_SHORT))
    street_en = digit and not STREET_EN_WORDS.isdisjoint(words)
    if not ("@" in norm or given or initial or digit or titled):
        return []
    taken: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= s or a >= e for s, e, _ in taken)

    if "@" in norm:
        taken += [(m.start(), m.end(), "email") for m in EMAIL.finditer(norm) if not m.group().lower().startswith("www.")]
    if street or street_en:
        for m in ADDRESS_IT.finditer(norm) if street else ():
            if free(*m.span()):
                taken.append((*m.span(), "address"))
        for m in ADDRESS_LOW.finditer(norm) if street else ():
            before = norm[max(0, m.start() - 12) : m.start()].split()[-1:]
            if free(*m.span()) and not NOT_LOW.search(m.group().split(None, 1)[1]) and (before or [""])[0] not in ("per", "nel", "il", "al", "in" if m.group().startswith("corso") else "", "un", "la", "del", "sul"):
                taken.append((*m.span(), "address"))
        for m in ADDRESS_EN.finditer(norm) if street_en else ():
            if free(*m.span()):
                taken.append((*m.span(), "address"))
    for m in IDENTITY.finditer(norm):
        if free(*m.span()):
            taken.append((*m.span(), "identity"))
    for m in IDENTITY_LOW.finditer(norm) if digit and SEVEN_DIGITS.search(norm) else ():
        if free(*m.span()):
            taken.append((*m.span(), "identity"))
    for m in PHONE.finditer(norm) if digit else ():
        s = m.group()
        n = sum(c.isdigit() for c in s)
        if 8 <= n <= 14 and not DATE.match(s) and free(*m.span()) and not (CODE_BEFORE.search(norm[max(0, m.start() - 14) : m.start()]) and s.isdigit() and n < 9):
            taken.append((*m.span(), "phone"))
    for a, b in names(norm, common, given_names) if given or initial or titled else ():
        if free(a, b):
            taken.append((a, b, "name"))
    return sorted((at[a], _end(at, text, b), k) for a, b, k in taken)


def _surname(word: str, like: str, common: set, given: frozenset = GIVEN) -> bool:
    """Whether a word may be a surname beside a given name written like ``like``."""
    parts = word.split("-")
    w = parts[0].lower()
    if len(w) < 3 or w in NO_SURNAME or w in given or w in common and all(p.lower() in common for p in parts):
        return False
    if like.isupper() and len(like) > 1:
        return word.isupper()
    if like[:1].isupper():
        return word[:1].isupper()
    return word.islower()


def names(text: str, common: set, given: frozenset = GIVEN) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    done = 0
    for m in WORD.finditer(text):
        if m.start() < done or m.group().lower() not in given:
            continue
        if m.end() < len(text) and text[m.end()] in "'’-@_" or m.start() and text[m.start() - 1] in "'’-@_.":
            continue
        start, end = m.span()
        while True:
            g = NEXT_GIVEN.match(text, end)
            if g and g.group(1).lower() in given and (g.group(1)[:1].isupper() == m.group()[:1].isupper()):
                end = g.end(1)
                continue
            g = NEXT_INITIAL.match(text, end)
            if g:
                end = g.end(1)
                continue
            break
        right = SURNAME_RIGHT.match(text, end)
        if right and not _surname(right.group(2), m.group(), common, given) and right.group(1):
            right = None
        if right and _surname(right.group(2), m.group(), common, given):
            # An initial before the given name belongs to it.
            out.append((start, right.end(2)))
        else:
            left = SURNAME_LEFT.search(text[max(0, start - 50) : start])
            if left and _surname(left.group(2), m.group(), common, given):
                base = max(0, start - 50)
                begin = left.start(1) if left.group(1) and _particle_ok(left.group(1), m.group()) else left.start(2)
                if not (out and base + begin < out[-1][1]):
                    out.append((base + begin, end))
        done = end
    for m in INITIAL.finditer(text):
        surname = m.group(3)
        if m.group(1).islower() and (surname[:1].isupper() or m.group(1) in "np" or len(surname) < 6):
            continue
        if m.group(1).isupper() and not surname[:1].isupper():
            continue
        if surname.lower() in common or surname.lower() in NO_SURNAME or surname.lower() in given:
            continue
        if all(m.end() <= a or m.start() >= b for a, b in out):
            out.append((m.start(), m.end(3)))
    for m in TITLED.finditer(text):
        words = [w.lower() for w in WORD.findall(m.group(2))][-1:] + [m.group(1).lower()]
        if all(m.end() <= a or m.start(1) >= b for a, b in out) and not any(w in common or w in NO_SURNAME for w in words):
            out.append((m.start(1), m.end(2)))
    return sorted(out)


def _particle_ok(particle: str, like: str) -> bool:
    p = particle.strip()
    return p[:1].isupper() == like[:1].isupper() and (p[-1] in "'’" or like[:1].isupper())


PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}


def redact(text: str | None, common: set, given: frozenset = GIVEN) -> str | None:
    if not text:
        return text
    out, last = [], 0
    for a, b, k in finds(text, common, given):
        out += [text[last:a], PLACEHOLDER[k]]
        last = b
    out.append(text[last:])
    return "".join(out)


# --- Spark ----------------------------------------------------------------------------------

#: Common words that are sent to every task; of more, only those that stand beside a name in some text.
MOST_COMMON = 2_000_000
#: A common word is seen at least so often, and a learnt given name before so many surnames.
LEAST_SEEN, LEAST_SURNAMES = 3, 2


@dataclass(frozen=True)
class Lexicon:
    common: frozenset[str]
    given: frozenset[str]


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, next, low, high): how often texts write a word in lower case and with a capital.

    Where ``next`` is not null: how often the capitalised word stands before that capitalised word.
    """
    token = re.compile(rf"(?<![\w.@+-])[{LETTER}]{{3,}}(?![\w@+]|[._-]\w)")  # not inside addresses
    pair = re.compile(r"(?<![\w.@'’-])([A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{2,}) (?=([A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{2,})(?![\w@'’]))")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: Counter[str] = Counter()
        high: Counter[str] = Counter()
        pairs: Counter[tuple[str, str]] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    for w, n in Counter(token.findall(t)).items():
                        if w.islower():
                            low[w] += n
                        else:
                            high[w.lower()] += n
                    for x, y in pair.findall(t):
                        pairs[x.lower(), y.lower()] += 1
        keys = list(low.keys() | high.keys())
        words = [*keys, *(x for x, _ in pairs)]
        after = [*[None] * len(keys), *(y for _, y in pairs)]
        lows = [*(low[k] for k in keys), *[0] * len(pairs)]
        highs = [*(high[k] for k in keys), *pairs.values()]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(after, pa.string()), pa.array(lows, pa.int64()), pa.array(highs, pa.int64())], names=["word", "next", "low", "high"])

    counted = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, next string, low bigint, high bigint")
    return counted.groupBy("word", "next").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))


def learnt_given(counted: DataFrame, common: DataFrame) -> DataFrame:
    """(word): given names that the seed list lacks, by the company they keep.

    A surname follows a known given name and is not common. A word is a given name if at least
    ``LEAST_SURNAMES`` different surnames follow it, if it stands before words that are not common
    more often than after known given names (where second given names stand too, but surnames
    mostly), and if it is not common itself.
    """
    seeds = sorted(GIVEN)
    follows = counted.where("next is not null").join(common.select(F.col("word").alias("next")), "next", "left_anti")
    after = follows.where(F.col("word").isin(seeds) & ~F.col("next").isin(seeds)).groupBy(F.col("next").alias("name")).agg(F.sum("high").alias("after"))
    before = follows.where(~F.col("word").isin(seeds)).join(after.select(F.col("name").alias("next"), F.lit(1).alias("surname")), "next", "left")
    before = before.groupBy("word").agg(F.count("surname").alias("surnames"), F.sum("high").alias("times")).where(F.col("surnames") >= LEAST_SURNAMES)
    found = before.join(common, "word", "left_anti").join(after.withColumnRenamed("name", "word"), "word", "left")
    return found.where(F.col("times") > F.coalesce("after", F.lit(0))).select("word")


def lexicon(texts: DataFrame, fields: DataFrame | None = None, most: int = MOST_COMMON) -> Lexicon:
    """Common words and given names of ``texts``.

    A common word is written in lower case at least ``LEAST_SEEN`` times and as often as with a
    capital. If there are more than ``most``, those that stand beside a name in ``fields``, whose
    finds they are to decide, are looked up first, and no others are collected.
    """
    counted = written(word_counts(texts))
    common = counted.where("next is null").where((F.col("low") >= LEAST_SEEN) & (F.col("low") >= F.col("high"))).select("word")
    given = frozenset(r["word"] for r in learnt_given(counted, common).collect()) | GIVEN
    if fields is not None and common.count() > most:
        common = common.join(asked_words(fields, given), "word", "left_semi")
    return Lexicon(frozenset(r["word"] for r in common.collect()), given)


class _Asked(set):
    """Notes the words that are looked up in it; all are in it, or none."""

    def __init__(self, answer: bool):
        super().__init__()
        self.answer = answer

    def __contains__(self, word: object) -> bool:
        self.add(word)
        return self.answer


def asked_words(fields: DataFrame, given: frozenset[str]) -> DataFrame:
    """(word): the words whose being common decides about a name in some text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set[str] = set()
            for t in b.column(0).to_pylist():
                for answer in (True, False):
                    asked = _Asked(answer)
                    finds(t, asked, given)
                    seen.update(asked)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], names=["word"])

    return fields.select("text").mapInArrow(run, "word string").distinct()


def _fields(chunks: DataFrame, logs: DataFrame) -> DataFrame:
    """All texts as (table_name, row_id, field_name, text)."""
    out = chunks.select(F.lit("chunks").alias("table_name"), F.col("chunk_id").cast("bigint").alias("row_id"), F.lit("text").alias("field_name"), "text")
    for c in ("query", "answer"):
        out = out.unionAll(logs.select(F.lit("query_logs"), F.col("log_id").cast("bigint"), F.lit(c), F.col(c)))
    return out.where("length(text) > 0")


def pii_finds(fields: DataFrame, words: Lexicon) -> DataFrame:
    """(table_name, row_id, field_name, pii_kind, found_text), each once."""
    shared = fields.sparkSession.sparkContext.broadcast(words)  # at most MOST_COMMON words, or those beside names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, given = shared.value.common, shared.value.given
        for b in batches:
            at, kinds, texts = [], [], []
            for i, t in enumerate(b.column(3).to_pylist()):
                for s, e, k in finds(t, common, given):
                    at.append(i), kinds.append(k), texts.append(t[s:e])
            pick = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pick) for c in range(3)), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], names=["table_name", "row_id", "field_name", "pii_kind", "found_text"])

    return fields.mapInArrow(run, "table_name string, row_id bigint, field_name string, pii_kind string, found_text string").distinct()


def redacted(fields: DataFrame, words: Lexicon) -> DataFrame:
    """(table_name, row_id, field_name, text) with typed placeholders."""
    shared = fields.sparkSession.sparkContext.broadcast(words)  # at most MOST_COMMON words, or those beside names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, given = shared.value.common, shared.value.given
        for b in batches:
            texts = [redact(t, common, given) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(texts, pa.string())], names=["table_name", "row_id", "field_name", "text"])

    return fields.mapInArrow(run, "table_name string, row_id bigint, field_name string, text string")


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Lexicon]:
    chunks = table(spark, sf_dir, "chunks")
    fields = _fields(chunks, table(spark, sf_dir, "query_logs"))
    return fields, lexicon(chunks, fields)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_finds(*_inputs(spark, sf_dir))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(*_inputs(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p4_redacted": p4_redacted}
ORACLES: dict[str, str] = {}
