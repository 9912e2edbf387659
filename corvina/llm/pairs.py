"""Defects of prompt and response pairs by a multi-label linear classifier.

Features are hashed: words and word pairs of the answer, its last words and how it ends, how
much of it comes from the question, and the languages of both. The training rows are made from
a bounded sample of the log: answers are cut off, questions handed back in altered form,
answers exchanged for ones in another language and refusals composed, each next to harmless
look-alikes (a remark before real content, a question repeated before its answer, a sentence
without its full stop, a translation that was asked for). Rows of the sample that the first
fit finds defective are left out of the second, and its refusals are learnt from, so that the log's own
ways to decline are known. Each defect's threshold is set on held-out rows: rows of other pairs,
and with refusals in other wordings, than those learnt from.

The languages are told apart by words of the documents, whose ``lang`` is known.

Null answers, and answers of blanks, punctuation or a placeholder, are ``empty``. A null question
shares no words with any answer and has no language. A log_id that was delivered twice is
judged once. Without rows to learn from, only ``empty`` is found.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvina.session import table

#: Log rows that training rows are made from, and documents that languages are learnt from.
MOST_ROWS, MOST_DOCS = 6_000, 3_000
LANGUAGES = ("it", "en", "fr", "de", "es")
LABELS = ("truncated", "refusal", "copy", "other_language", "empty")
#: Labels told by words, of which every row shows some that others lack.
WORDED = ("truncated", "refusal")
BITS = 18
LANG_BITS = 16
WORD = re.compile("[^\\W\\d_]+|\\d[\\d.,/:]*|\x01")
#: Stand-ins for a missing value (fixed values, lower case).
PLACEHOLDERS = frozenset("null none nan nil na n/a n.d. nd n.a. undefined empty <empty> <null> <none> missing void tbd vuoto leer vide vacío (null) (none) (empty) [null] [none] {} [] \"\" ''".split())
_PLACEHOLDERS = sorted(PLACEHOLDERS)
#: A language asked for (fixed values: language, names of it).
ASKED = {
    "it": r"italian[oa]?|italien|italienisch|auf italienisch",
    "en": r"inglese|english|anglais|englisch|inglés",
    "fr": r"francese|french|français|französisch|francés",
    "de": r"tedesco|german|allemand|deutsch|alemán",
    "es": r"spagnolo|spanish|espagnol|spanisch|español|castellano",
}
ASKED_RE = {k: re.compile(rf"\b(?:{v})\b", re.I) for k, v in ASKED.items()}
ANY_ASKED = re.compile("|".join(ASKED.values()), re.I)
CITED = re.compile(r"(?:\s*(?:\[\d+\]|\(art\.?\s*\d+\)))+\s*$")
CONNECTORS = {  # what an answer may break off after (fixed values)
    "it": "di,del,della,con,per,a,in,da,che,tra cui,per cui,perché,pari a,come ad esempio:,e,il,la,un,secondo,quando,se,al,nel,sulla,mentre,oppure,ovvero,nel caso in cui,in quanto il,a condizione che,in base a,come ad esempio,ai sensi di".split(","),
    "en": "of,the,with,for,to,in,that,such as:,because the,and,a,by,when,if,on,which,under,including,as well as,or,from,in the case of,provided that,such as,according to".split(","),
    "fr": "de,la,avec,pour,à,dans,que,comme:,parce que,et,le,un,selon,si,du,des,ainsi que,dans le cas où,à condition que,selon le".split(","),
    "de": "der,die,mit,für,zu,in,dass,wie zum Beispiel:,weil,und,den,ein,wenn,von,auf,sowie,für den Fall dass,unter der,aus".split(","),
    "es": "de,la,con,para,a,en,que,como por ejemplo:,porque,y,el,un,según,si,del,así como,en el caso de que,siempre que,según el".split(","),
}
#: Ways to decline or to find nothing, and soft remarks that are no refusal (composed for training).
REFUSALS = {
    "it": (
        [f"{a} {b}{c}" for a in ("Mi dispiace, ma non posso", "Spiacente, non mi è consentito", "Purtroppo non sono in grado di", "Al momento non riesco a", "Non sono autorizzato a", "Non mi è possibile", "Come assistente virtuale non posso", "Preferirei non", "Non ho la facoltà di", "Chiedo scusa, non so", "Per ragioni di riservatezza evito di", "Non posso", "Non sono in condizione di", "Mi è impossibile", "Devo declinare: non posso", "Sono costretto a non", "Non intendo", "Non ci è permesso") for b in ("rispondere a questa domanda", "aiutarti con questo", "fornire questa informazione", "trattare la richiesta", "esprimermi sull'argomento", "assisterti su questo punto", "dare una risposta", "dire nulla in merito a {x}", "parlare di {x}", "comunicare {x}", "dare indicazioni su {x}") for c in (".", " perché esula dalle mie competenze.", " senza ulteriori elementi.")]
        + [f"{a} {{x}}{c}" for a in ("Nei documenti disponibili non trovo nulla su", "Non risultano informazioni utili su", "I passaggi recuperati non parlano di", "Non ho trovato informazioni su", "Le fonti non riportano nulla su", "Non c'è alcun riferimento a", "Nessun documento tratta di", "La ricerca non ha prodotto risultati su", "Nella base documentale manca ogni riferimento a") for c in (".", ", quindi non rispondo.", ": non posso dirti altro.")]
        + ["Nessuna delle fonti consultate contiene la risposta.", "La knowledge base non tratta questo tema.", "Non ho trovato alcuna informazione utile.", "Nessun risultato per questa domanda.", "Non so rispondere.", "Informazione non disponibile nei documenti.", "Non dispongo di questa informazione.", "I documenti non contengono la risposta.", "Non ho elementi per rispondere."]
    ),
    "en": (
        [f"{a} {b}{c}" for a in ("I'm sorry, but I can't", "Unfortunately I am unable to", "I am not able to", "I am not authorised to", "As a virtual assistant I cannot", "I would rather not", "I cannot", "I must decline to", "At the moment I can't", "For reasons of confidentiality I will not", "I am not allowed to", "I apologise, I don't know how to", "It is not possible for me to") for b in ("answer this question", "help with that", "provide this information", "comment on the matter", "handle the request", "assist you on this point", "say anything about {x}", "give an answer", "share {x}", "give details about {x}") for c in (".", " because it is outside my remit.", " without further details.")]
        + [f"{a} {{x}}{c}" for a in ("The available documents contain nothing on", "I found nothing about", "I found no information about", "There is no information on", "The retrieved passages do not mention", "No useful information was found on", "The sources say nothing about", "The search returned no results on", "I could not find anything on") for c in (".", ", so I will not answer.", ": I cannot tell you more.")]
        + ["None of the sources consulted contains the answer.", "The knowledge base does not cover this topic.", "No information was found.", "I don't know.", "The documents do not contain the answer.", "This information is not available.", "No results for this question.", "I have nothing to base an answer on."]
    ),
    "fr": [f"{a} {b}." for a in ("Je suis désolé, je ne peux pas", "Malheureusement je ne suis pas en mesure de", "Je ne suis pas autorisé à", "Il ne m'est pas possible de") for b in ("répondre à cette question", "vous aider sur ce point", "fournir cette information", "traiter la demande")] + ["Je n'ai rien trouvé dans les documents sur {x}.", "Les documents disponibles ne contiennent rien sur {x}.", "Aucune source consultée ne contient la réponse.", "Les sources ne disent rien à ce sujet.", "Les documents ne mentionnent pas ce point.", "Aucune information trouvée."],
    "de": [f"{a} {b}." for a in ("Es tut mir leid, ich kann", "Leider kann ich", "Ich bin nicht befugt, ich kann") for b in ("diese Frage nicht beantworten", "dabei nicht helfen", "diese Auskunft nicht geben", "die Anfrage nicht bearbeiten")] + ["Es tut mir leid, dazu kann ich keine Auskunft geben.", "Dazu habe ich in den Dokumenten nichts gefunden.", "Die Dokumente enthalten nichts zu {x}.", "Keine der Quellen enthält die Antwort.", "In den Unterlagen steht dazu nichts.", "Dazu steht nichts in den Quellen.", "Leider liegen keine Informationen zu {x} vor."],
    "es": [f"{a} {b}." for a in ("Lo siento, no puedo", "Lamentablemente no puedo", "No estoy autorizado a", "No me es posible") for b in ("responder a esta pregunta", "ayudarle con esa consulta", "facilitar esa información", "tratar la solicitud")] + ["No he encontrado nada en los documentos sobre {x}.", "Los documentos disponibles no contienen nada sobre {x}.", "Ninguna de las fuentes contiene la respuesta.", "Las fuentes no dicen nada sobre esto.", "Los documentos no dicen nada al respecto.", "No hay información sobre {x}."],
}
REMARKS = {
    "it": ["Non posso garantire che i valori siano definitivi; in ogni caso le fonti riportano questo.", "Non posso garantire che la tabella sia aggiornata; in ogni caso i documenti riportano questo.", "Non ho trovato un importo unico, ma il testo chiarisce quanto segue.", "Mi dispiace per il ritardo, ecco la risposta.", "Purtroppo la copertura è esclusa in questo caso.", "L'assicuratore non può rifiutare la denuncia tardiva.", "Non sono previsti limiti.", "Non è necessario alcun documento.", "Scusa l'attesa, di seguito i dettagli.", "La garanzia non opera all'estero.", "Nessuna franchigia è dovuta."],
    "en": ["I cannot guarantee that the table is up to date; in any case the documents state the following.", "I did not find a single amount, but the text says this.", "Sorry for the delay, here is the answer.", "Unfortunately this case is excluded.", "The insurer cannot refuse late notice.", "There are no limits.", "No document is needed.", "The cover does not apply abroad.", "No deductible is due."],
    "fr": ["Désolé pour le retard, voici la réponse.", "Malheureusement ce cas est exclu.", "Aucune franchise n'est due."],
    "de": ["Entschuldigung für die Verzögerung, hier die Antwort.", "Leider ist dieser Fall ausgeschlossen.", "Es fällt keine Selbstbeteiligung an."],
    "es": ["Perdón por la demora, aquí está la respuesta.", "Lamentablemente este caso está excluido.", "No se aplica franquicia."],
}
SHORT = ["Sì.", "No.", "Yes.", "No, è escluso.", "No, it is excluded.", "Prego!", "You are welcome!", "Di nulla, resto a disposizione.", "Ciao! Come posso aiutarti oggi?", "Hello! How can I help you today?", "Grazie a te!", "Buongiorno, sono l'assistente: chiedimi pure.", "Oui.", "Ja.", "Sí.", "Circa 20 ore", "About 30 hours", "45 giorni.", "12 days.", "1.250 euro", "Il 3 maggio 2024."]
WRAPPERS = frozenset("domanda question pregunta frage quesito".split())
SEED = 11


class _Hashes(dict):
    """32-bit hashes of words; all numbers are one word."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 2_000_000:
            self.clear()
        text = "#" if word[0].isdigit() else word
        v = 0 if word == "\x01" else xxhash.xxh32_intdigest(text.encode("utf-8", "replace")) or 1
        self[word] = v
        return v


_hashes = _Hashes()
NUMBER = _hashes["0"]
CONTENTLESS = np.array([_hashes[w] for w in WRAPPERS], dtype=np.int64)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and where each text's words begin (one more entry at the end)."""
    words = WORD.findall("\x01".join(texts).lower())
    h = np.fromiter(map(_hashes.__getitem__, words), np.int64, len(words))
    cut = h == 0
    starts = np.concatenate([[0], np.flatnonzero(cut) - np.arange(cut.sum()), [len(h) - cut.sum()]]).astype(np.int64)
    return h[~cut], starts


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def clean(texts: list[str | None]) -> list[str]:
    return [t.replace("\x01", " ") if t else "" for t in texts]


def no_text(answer: str | None) -> bool:
    """Null, blanks or punctuation: empty by definition."""
    return answer is None or not any(c.isalnum() for c in answer)


@dataclass
class Model:
    language: np.ndarray  # (2**LANG_BITS, languages)
    weights: list[np.ndarray]
    thresholds: np.ndarray
    scales: np.ndarray


def _row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return total[starts[1:]] - total[starts[:-1]]


def language_scores(model_language: np.ndarray, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return _row_sums(model_language[h & (2**LANG_BITS - 1)], starts)


def _member(a: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each a is among ``of``."""
    if not len(of):
        return np.zeros(len(a), bool)
    of = np.sort(of)
    at = np.searchsorted(of, a)
    at[at == len(of)] = 0
    return of[at] == a


def _bins(x: np.ndarray, edges: list[float]) -> np.ndarray:
    return np.digitize(x, edges)


def features(language: np.ndarray, queries: list[str | None], answers: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each label (feature ids, start of each row)."""
    q_text, a_text = clean(queries), clean(answers)
    n = len(a_text)
    bodies, ends, flags = [], np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, t in enumerate(a_text):
        s = CITED.sub("", t).rstrip()
        cited = len(s) < len(t.rstrip())
        s = s.rstrip("*_»\"” ")
        last = s[-1:] or " "
        kind = ".!?…:;,-([{)]".find(last)
        kind = kind + 1 if kind >= 0 else 20 if last.isalpha() else 21 if last.isdigit() else 22
        if s.endswith("..."):
            kind = 4
        opened = (s.count("(") > s.count(")")) + 2 * (s.count("[") > s.count("]"))
        line = s.rsplit("\n", 1)[-1].strip()
        bullet = 1 if line in ("-", "*", "•", "–") or re.fullmatch(r"\d+[.)]?", line) and "\n" in s else 0
        listing = 1 if line[:1] in "-*•" or re.match(r"\d+[.)] ", line) else 0
        word = (s.split() or [""])[-1]
        capital = word[:1].isupper()
        ends[i] = kind
        flags[i] = opened + 4 * bullet + 8 * listing + 16 * cited + 32 * capital + 64 * (len(word) < 3)
        bodies.append(s)
    qh, qs = tokens(q_text)
    ah, as_ = tokens(a_text)
    bh, bs = tokens(bodies)
    a_len, q_len = np.diff(as_), np.diff(qs)
    rows_a, rows_q = np.repeat(np.arange(n), a_len), np.repeat(np.arange(n), q_len)
    key_a, key_q = rows_a << 32 | ah, rows_q << 32 | qh
    shared = _member(key_a, key_q)
    novel = ~shared & ~_member(ah, CONTENTLESS)
    n_novel = _row_sums(novel.astype(float), as_)
    n_shared = _row_sums(shared.astype(float), as_)
    back = _row_sums(_member(key_q, key_a).astype(float), qs) / np.maximum(q_len, 1)

    # Endings: the last three words where no full stop follows.
    def nth(k: int) -> np.ndarray:
        at = bs[1:] - k
        return np.where(at >= bs[:-1], bh[np.clip(at, 0, max(len(bh) - 1, 0))] if len(bh) else 0, 0)

    w1, w2, w3 = nth(1), nth(2), nth(3)
    open_end = np.isin(ends, (4, 5, 6, 7, 8, 9, 10, 11, 20, 21, 22))
    gate = np.where(open_end, ends + 1, 0)
    cut = np.stack(
        [
            _mix(ends, 1),
            _mix(ends * 128 + flags, 2),
            _mix(gate << 40 | w1, 3) * (gate > 0),
            _mix(gate << 40 | (w1 * 31 + w2) & 0xFFFFFFFFFF, 4) * (gate > 0),
            _mix(gate << 40 | (w1 * 31 * 31 + w2 * 31 + w3) & 0xFFFFFFFFFF, 5) * (gate > 0),
            _mix(ends * 16 + _bins(a_len, [1, 2, 3, 5, 8]), 6),
            _mix(ends * 8 + (flags & 7), 7),
        ],
        axis=1,
    )
    copy = np.stack(
        [
            _mix(_bins(n_novel, [1, 2, 3, 4, 6, 9]), 11),
            _mix(_bins(n_novel, [1, 2, 3, 4, 6]) * 16 + _bins(back, [0.2, 0.4, 0.6, 0.8, 0.999]), 12),
            _mix(_bins(n_novel / np.maximum(a_len, 1), [0.001, 0.05, 0.1, 0.2, 0.3, 0.5]) * 16 + _bins(n_shared, [1, 2, 3, 5, 8]), 13),
            _mix(_bins(n_novel, [1]) * 64 + _bins(a_len, [1, 2, 3, 4, 6]) * 8 + _bins(back, [0.3, 0.6]), 14),
        ],
        axis=1,
    )
    # Languages.
    lq, la = language_scores(language, qh, qs), language_scores(language, ah, as_)
    words_q, words_a = _row_sums((qh != NUMBER).astype(float), qs), _row_sums((ah != NUMBER).astype(float), as_)
    best_q, best_a = lq.argmax(axis=1), la.argmax(axis=1)
    top_q, top_a = lq.max(axis=1), la.max(axis=1)
    lead_a = top_a - la[np.arange(n), best_q]  # how much better the answer fits another language
    lead_q = top_q - lq[np.arange(n), best_a]
    asked = np.zeros(n, np.int64)
    for i, t in enumerate(q_text):
        if ANY_ASKED.search(t):
            asked[i] = 1 + (1 if ASKED_RE[LANGUAGES[best_a[i]]].search(t) else 0)
    same = (best_q == best_a).astype(np.int64)
    lang = np.stack(
        [
            _mix(same * 4 + asked, 21),
            _mix((same * 4 + asked) * 64 + _bins(lead_a, [1, 2, 4, 8, 16]) * 8 + _bins(lead_q, [1, 2, 4, 8, 16]), 22),
            _mix((same * 4 + asked) * 64 + _bins(words_a, [1, 2, 3, 5]) * 8 + _bins(words_q, [1, 2, 3, 5]), 23),
            _mix((same * 4 + asked) * 64 + _bins(lead_a / np.maximum(words_a, 1), [0.1, 0.3, 0.6, 1, 2]), 24),
        ],
        axis=1,
    )
    # Words and word pairs of the answer.
    bag = _mix(ah, 31)
    pair_at = np.arange(len(ah) - 1) if len(ah) > 1 else np.zeros(0, np.int64)
    inside = rows_a[1:] == rows_a[:-1] if len(ah) > 1 else np.zeros(0, bool)
    pairs = _mix(ah[:-1] * 131071 + ah[1:] * 31, 32)[inside] if len(ah) > 1 else np.zeros(0, np.int64)
    pair_rows = rows_a[:-1][inside] if len(ah) > 1 else pair_at
    extra = _mix(_bins(a_len, [1, 2, 4, 8, 16, 24]) * 8 + _bins(n_shared, [1, 2, 4]), 33)
    extra2 = _mix(ends, 34)
    ids = np.concatenate([bag, pairs, extra, extra2])
    rows = np.concatenate([rows_a, pair_rows, np.arange(n), np.arange(n)])
    order = np.argsort(rows, kind="stable")
    ids, rows = ids[order], rows[order]
    starts = np.searchsorted(rows, np.arange(n + 1))
    even = lambda x: (x.reshape(-1), np.arange(0, x.size + 1, x.shape[1]))
    # What a short answer is written as: stand-ins for a missing value are short.
    letters = np.fromiter((sum(map(str.isalnum, t)) if len(t) < 60 else 60 for t in a_text), np.int64, n)
    sizes = np.fromiter((min(len(t), 60) for t in a_text), np.int64, n)
    names = np.fromiter((_hashes["w" + t.strip().lower()] if len(t) < 60 else 0 for t in a_text), np.int64, n)
    inner = np.fromiter((_hashes["w" + t.strip("<>[](){}\"'.*_- \t\n").lower()] if len(t) < 60 else 0 for t in a_text), np.int64, n)
    edges = np.fromiter((_hashes["w" + "".join(c for c in t.strip() if not c.isalnum())] if len(t) < 60 else 0 for t in a_text), np.int64, n)
    blank = np.stack(
        [
            _mix(_bins(letters, [1, 2, 3, 5, 8, 12, 20, 40]), 41),
            _mix(names, 42),
            _mix(inner, 43),
            _mix(edges * 16 + _bins(letters, [1, 2, 4, 8, 16]), 44),
            _mix(_bins(sizes, [1, 2, 4, 8, 16, 32]) * 8 + _bins(a_len, [1, 2, 3]), 45),
        ],
        axis=1,
    )
    return [even(cut), (ids, starts), even(copy), even(lang), even(blank)]


# --- training -------------------------------------------------------------------------------


def fit_languages(texts: list[str], langs: list[str], pairs: list[tuple[str, str]] = ()) -> np.ndarray:
    """Log odds of each hashed word for each language.

    Questions use words that documents lack; these are learnt from the language of the answers.
    """
    counts = np.full((2**LANG_BITS, len(LANGUAGES)), 0.05)
    for text, lang in zip(texts, langs):
        if lang in LANGUAGES:
            h, _ = tokens([text])
            h = h[h != NUMBER]
            np.add.at(counts[:, LANGUAGES.index(lang)], h & (2**LANG_BITS - 1), 1.0)
    if pairs:
        ah, starts = tokens(clean([a for _, a in pairs]))
        scores = language_scores(_log_odds(counts), ah, starts)
        order = np.sort(scores, axis=1)
        sure = order[:, -1] - order[:, -2] > 6
        added = np.zeros_like(counts)
        for (q, _), k, ok in zip(pairs, scores.argmax(axis=1).tolist(), sure.tolist()):
            if ok:
                h, _ = tokens(clean([q]))
                np.add.at(added[:, k], h[h != NUMBER] & (2**LANG_BITS - 1), 1.0)
        # What most answers to questions with a word are written in; some answers are in another language.
        asked = np.log(added + 0.3) - np.log(added + 0.3).mean(axis=1, keepdims=True)
        known = _log_odds(counts)
        new = (np.abs(known).sum(axis=1) == 0) & (added.sum(axis=1) >= 2)
        return np.where(new[:, None], np.clip(asked, -4, 4), known)
    return _log_odds(counts)


def _log_odds(counts: np.ndarray) -> np.ndarray:
    rate = counts / counts.sum(axis=0)
    seen = counts.sum(axis=1) > 0.05 * len(LANGUAGES) + 0.5
    score = np.log(rate) - np.log(rate).mean(axis=1, keepdims=True)
    return np.where(seen[:, None], np.clip(score, -4, 4), 0.0)


def _altered(rng: random.Random, q: str) -> str:
    words = q.split()
    k = rng.randrange(13)
    if k == 0:
        return q.upper()
    if k == 1:
        return q.lower()
    if k == 2 and len(words) > 3:
        m = rng.randrange(1, len(words) - 1)
        return " ".join(words[m:] + words[:m]).rstrip("?")
    if k == 3:
        return q + " " + q
    if k == 4 and len(words) > 3:
        m = rng.randrange(len(words))
        return " ".join(words[:m] + words[m + 1 :])
    if k == 5:
        return f"> {q}\n"
    if k == 6:
        return f"*{q}*:"
    if k == 7:
        return q.rstrip("?.") + rng.choice(("...", ".", "", "…"))
    if k == 8 and len(words) > 4:
        return " ".join(words[: rng.randrange(max(2, len(words) // 2), len(words))])
    if k == 9 and len(words) > 4:
        return " ".join(words[rng.randrange(1, len(words) // 2) :])
    if k == 10:
        return rng.choice(("Domanda: ", "Question: ")) + q
    if k == 11 and len(words) > 3:
        rng.shuffle(words)
        return " ".join(words)
    return q


#: Where someone who declines sends the reader (fixed values, after refusals).
REFERRALS = {
    "it": ["Rivolgiti al tuo referente.", "Posso aiutarti con altro?", "Ti suggerisco di contattare l'assistenza.", "Contatta l'ufficio competente.", "Prova a riformulare la domanda."],
    "en": ["Please contact your adviser.", "Can I help you with anything else?", "Can I help with something else?", "I suggest you contact support.", "Try rephrasing the question.", "Please ask the office in charge."],
    "fr": ["Veuillez contacter votre conseiller.", "Puis-je vous aider pour autre chose ?"],
    "de": ["Bitte wenden Sie sich an Ihren Berater.", "Kann ich sonst helfen?"],
    "es": ["Póngase en contacto con su asesor.", "¿Puedo ayudarle con otra cosa?"],
}


#: Refusals of each language: what names a topic, what does not, and the last of these, each drawn as often.
_DRAWS = {k: (([r for r in v if "{x}" in r] or v), (fixed := [r for r in v if "{x}" not in r]), fixed[-9:] if len(fixed) > 20 else fixed) for k, v in REFUSALS.items()}


def wording(refusal: str) -> int:
    """A number for the way a refusal begins; wordings are held out as a whole."""
    import xxhash

    return xxhash.xxh32_intdigest(" ".join(WORD.findall(refusal.lower())[:4])) % 5


def _refusal(rng: random.Random, lang: str, topic: str) -> tuple[str, int]:
    """A refusal and its wording; ways to decline and ways to find nothing are drawn alike, whatever their number."""
    made = rng.choice(rng.choice(_DRAWS[lang]))
    text = made.format(x=topic)
    if rng.random() < 0.3:
        text += " " + rng.choice(REFERRALS[lang])
    return text, wording(made)


def _placeholder(rng: random.Random) -> str:
    """A stand-in for a missing value, or punctuation and blanks."""
    if rng.random() < 0.3:
        return rng.choice((" ", "\n", "\t")) * rng.randrange(4) + rng.choice(("-", ".", "...", "—", "?", "", "\"\"", "***", "{}", "[]", "//")) * rng.randrange(1, 3)
    word = rng.choice(_PLACEHOLDERS)
    word = rng.choice((str, str.upper, str.title))(word)
    left, right = rng.choice((("", ""), ("", ""), ("<", ">"), ("(", ")"), ("[", "]"), ('"', '"'), ("", "."), (" ", "\n")))
    return left + word + right


def _triples(text: str) -> set[tuple[str, ...]]:
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


DECLINING = frozenset(t for v in REFUSALS.values() for r in v for t in _triples(r))


def _usable(answer: str) -> bool:
    """Whether a log answer may stand for a sound one: it ends, it does not decline and is no stand-in."""
    if answer.strip().lower() in PLACEHOLDERS:
        return False
    end = CITED.sub("", answer).rstrip()[-1:]
    return end in ".!?)]»\"" and not answer.rstrip().endswith("...") and not DECLINING & _triples(answer)


def _cut(rng: random.Random, answer: str, lang: str) -> str | None:
    s = answer.rstrip()
    words = list(re.finditer(r"\S+", s))
    if len(words) < 4:
        return None
    k = rng.randrange(10)
    m = words[rng.randrange(2, len(words))]
    if k < 5:
        letters = [i for i in range(m.start() + 1, m.end() - 1) if s[i - 1].isalpha() and s[i].isalpha() and s[i + 1 : i + 2].isalpha()]
        if not letters:
            return None
        at = rng.choice(letters)
        return s[:at] + rng.choice(("", "", "", "-", "…", "..."))
    if k == 5:
        prev = s[: m.start()].rstrip()
        return None if prev[-1:] in ".!?]):;" else prev + rng.choice(("", "", ",", "…"))
    base = re.sub(r"[.\s]+$", "", CITED.sub("", s))
    if k == 6:
        return base + rng.choice((",", ", [", " (", " [", ":\n-", ":\n1.", "\n-", ";\n- ", ", («"))
    return base + rng.choice(("", ",", "")) + " " + rng.choice(CONNECTORS[lang])


#: A training row: question, answer, labels as bits, the number of what it was made from, its wording (-1: none).
Made = tuple[str, str, int, int, int]


def synthetic(pairs: list[tuple[str, str, str]], seed: int, connectors: dict[str, list[str]] | None = None) -> list[Made]:
    """Training rows from (question, answer, language)."""
    rng = random.Random(seed)
    connectors = connectors or {}
    by_lang: dict[str, list[str]] = {}
    for _, a, lang in pairs:
        if len(a.split()) > 4:
            by_lang.setdefault(lang, []).append(a)
    out: list[Made] = []
    for i, (q, a, lang) in enumerate(pairs):

        def add(question: str, answer: str, labels: int, words: int = -1, i: int = i) -> None:
            out.append((question, answer, labels, i, words))

        add(q, a, 0)
        full = len(a.split()) > 4
        if full:
            bare = re.sub(r"[.\s]+$", "", a)
            if bare[-1:].isalnum():
                add(q, bare, 0)
            sentences = [x for x in re.split(r"(?<=[.])\s+", bare) if len(x) > 15]
            mark = rng.choice(("- ", "• ", "* ", "1) ", "1. ", ""))
            listed = "\n".join(mark + x.rstrip(".") for x in sentences)
            if listed and bare[-1:].isalnum():
                add(q, listed, 0)
            for text in (a, a, listed):
                if (c := _cut(rng, text, lang)) is not None:
                    add(q, c, 1)
            if connectors.get(lang) and rng.random() < 0.5:
                add(q, re.sub(r"[.\s]+$", "", CITED.sub("", a)) + rng.choice(("", ",")) + " " + rng.choice(connectors[lang]), 1)
        topic = " ".join(q.rstrip("?.").split()[-rng.randrange(1, 6) :])
        refusal, words = _refusal(rng, lang, topic)
        add(q, refusal if rng.random() < 0.9 else refusal.rstrip("."), 2, words)
        add(q, *(lambda r: (r[0], 2, r[1]))(_refusal(rng, lang, topic)))
        if full:
            add(q, (rng.choice(REMARKS[lang]) if rng.random() < 0.6 else refusal) + " " + a, 0)
        if rng.random() < 0.3:
            add(q, rng.choice(REMARKS[lang]), 0)
        if rng.random() < 0.3:
            add(q, _placeholder(rng), 16)
        if len(q.split()) > 2:
            add(q, _altered(rng, q), 4)
            if full:
                add(q, rng.choice((f"**{q}**\n\n{a}", f"«{q}» {a}", f"{q} {a}", f"Q: {q}\nA: {a}", f"{q}\n{a}")), 0)
        others = [x for x in by_lang if x != lang]
        if others and len(q.split()) > 3:
            other = rng.choice(others)
            foreign = rng.choice(by_lang[other])
            add(q, foreign, 8)
            if rng.random() < 0.5:
                name = rng.choice(ASKED[other].split("|")).replace("[oa]?", "o")
                add(rng.choice((f"{q} ({name})", f"{name}: {q}", f"Traduci in {name} {q}", f"Please answer in {name}: {q}", f"Rispondi in {name}: {q}")), foreign, 0)
        if rng.random() < 0.2:
            add(q, rng.choice(SHORT), 0)
    return out


def _sentences(text: str) -> list[str]:
    return [s for p in text.split("\n\n") for s in re.split(r"(?<=[.])\s+", " ".join(p.split())) if s.endswith(".") and 30 < len(s) < 400]


def _connectors(texts: list[str], langs: list[str], seed: int, most: int = 400) -> dict[str, list[str]]:
    """For each language, words that documents use inside sentences before others: two words, the last of them short."""
    rng = random.Random(seed)
    out: dict[str, set[str]] = {}
    for text, lang in zip(texts, langs):
        for s in rng.sample(found := _sentences(text), min(2, len(found))):
            words = s.split()
            for x, y in zip(words[1:-2], words[2:-1]):
                if len(y) < 5 and x.isalpha() and y.isalpha() and x.islower() and y.islower() and len(out.setdefault(lang, set())) < most:
                    out[lang].add(f"{x} {y}" if len(x) < 7 else y)
    return {k: sorted(v) for k, v in out.items()}


def _endings(texts: list[str], langs: list[str], seed: int, first: int, per_text: int = 4) -> list[Made]:
    """Sentences of documents, without their full stop and cut off, so that endings of all languages are known."""
    rng = random.Random(seed)
    out: list[Made] = []
    for i, (text, lang) in enumerate(zip(texts, langs), first):
        found = _sentences(text)
        for s in rng.sample(found, min(per_text, len(found))):
            bullet = rng.choice(("", "", "- ", "• ", "1) ", "* "))
            out.append(("", bullet + s.rstrip("."), 0, i, -1))
            if (c := _cut(rng, s, lang)) is not None:
                out.append(("", bullet + c, 1, i, -1))
    return out


def _fit(ids: np.ndarray, starts: np.ndarray, y: np.ndarray, rounds: int = 120, l2: float = 2e-6) -> np.ndarray:
    """Logistic regression on feature lists, by Adam over all rows."""
    used = np.flatnonzero(np.bincount(ids, minlength=2**BITS))
    place = np.zeros(2**BITS, np.int64)
    place[used] = np.arange(len(used))
    ids, rows = place[ids], np.repeat(np.arange(len(y)), np.diff(starts))
    weight = np.where(y > 0, len(y) / max(y.sum(), 1) / 2, len(y) / max((1 - y).sum(), 1) / 2)
    w, m, v = (np.zeros(len(used)) for _ in range(3))
    for t in range(1, rounds + 1):
        z = np.bincount(rows, w[ids], len(y))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        grad = np.bincount(ids, g[rows], len(used)) + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    out = np.zeros(2**BITS, np.float32)
    out[used] = w
    return out


def _scores(weights: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return _row_sums(weights[ids].astype(np.float64), starts)


#: How much more a sound look-alike weighs than a defect when a threshold is set: as often as logs have one for each row made.
NEGATIVES = {"truncated": 4.0, "refusal": 1.0, "copy": 4.0, "other_language": 4.0, "empty": 4.0}


def _threshold(score: np.ndarray, y: np.ndarray, negatives: float) -> float:
    """The cut with the best F1 when negatives weigh more than they were made."""
    order = np.argsort(-score)
    s, t = score[order], y[order]
    tp, fp = np.cumsum(t), np.cumsum(1 - t) * negatives
    f1 = 2 * tp / np.maximum(tp + fp + t.sum(), 1)
    f1[:-1][s[1:] == s[:-1]] = -1  # between equal scores there is no cut
    best = int(np.argmax(f1))
    after = s[best + 1] if best + 1 < len(s) else s[best] - 1
    return float((s[best] + after) / 2)


def split(made: list[Made]) -> tuple[np.ndarray, np.ndarray]:
    """(learnt from, held out): what came from one pair stays together, and so does a wording; rows that would mix them are in neither."""
    source, words = np.array([m[3] for m in made]) % 5 == 0, np.array([m[4] for m in made])
    return ~source & (words != 0), source & (words <= 0)


def fit(pairs: list[tuple[str, str]], texts: list[str], langs: list[str]) -> Model:
    return fit_with_report(pairs, texts, langs)[0]


def fit_with_report(pairs: list[tuple[str, str]], texts: list[str], langs: list[str]) -> tuple[Model, dict[str, tuple[float, float]]]:
    """The model, and for each label (precision, recall) on the held-out rows."""
    language = fit_languages(texts, langs, pairs)
    empty = Model(language, [np.zeros(2**BITS, np.float32)] * len(LABELS), np.full(len(LABELS), np.inf), np.ones(len(LABELS)))
    if not pairs:
        return empty, {}
    h, s = tokens(clean([a if len(a.split()) > 2 else q for q, a in pairs]))
    scores = language_scores(language, h, s)
    every = [(q, a, LANGUAGES[k]) for (q, a), k in zip(pairs, scores.argmax(axis=1))]
    base = [b for b in every if _usable(b[1])]
    if not base:
        return empty, {}
    connectors = _connectors(texts, langs, SEED)
    endings = _endings(texts, langs, SEED, len(pairs))
    learnt: list[Made] = []
    for turn in range(2):
        made = synthetic(base, SEED + turn, connectors) + endings + learnt
        y = np.array([m[2] for m in made])
        feats = features(language, [m[0] for m in made], [m[1] for m in made])
        train, held = split(made)
        weights, cuts, scales, report = [], [], [], {}
        for k, (ids, starts) in enumerate(feats):
            t = (y >> k & 1).astype(float)
            size = np.diff(starts)
            w = _fit(ids[np.repeat(train, size)], np.concatenate([[0], np.cumsum(size[train])]), t[train])
            z = _scores(w, ids, starts)
            cut = _threshold(z[held], t[held], NEGATIVES[LABELS[k]]) if t[held].any() else np.inf
            hit = (z[held] > cut) & (t[held] > 0)
            report[LABELS[k]] = (float(hit.sum() / max(1, (z[held] > cut).sum())), float(hit.sum() / max(1, t[held].sum())))
            if turn and LABELS[k] in WORDED and np.isfinite(cut):
                # The cut holds for rows that were not learnt from; the last weights come from all rows, their scores brought to the scale of the first.
                w = _fit(ids, starts, t)
                again = _scores(w, ids, starts)
                slope, base_line = np.polyfit(z[train], again[train], 1)
                cut, z = slope * cut + base_line, again
            weights.append(w)
            cuts.append(cut)
            scales.append(max(float(np.std(z)), 1e-6))
        model = Model(language, weights, np.array(cuts), np.array(scales))
        if turn == 0:
            found = predict(model, [q for q, _, _ in every], [a for _, a, _ in every])
            learnt = [(q, a, 2, i, wording(a)) for i, ((q, a, _), f) in enumerate(zip(every, found)) if f == "refusal"]
            sound = {(q, a) for (q, a, _), f in zip(every, found) if f is None}
            base = [b for b in base if b[:2] in sound]
            if not base:
                break
    return model, report


def predict(model: Model, queries: list[str | None], answers: list[str | None]) -> list[str | None]:
    """The defect of each pair, or None."""
    if not answers:
        return []
    feats = features(model.language, queries, answers)
    z = np.stack([(_scores(w, ids, starts) - c) / s for w, c, s, (ids, starts) in zip(model.weights, model.thresholds, model.scales, feats)], axis=1)
    best = z.argmax(axis=1)
    top = z[np.arange(len(best)), best]
    return ["empty" if no_text(a) else LABELS[k] if v > 0 else None for a, k, v in zip(answers, best.tolist(), top.tolist())]


# --- Spark ----------------------------------------------------------------------------------


HASHES = 1 << 30


def _below(key: str, most: int, n: int) -> Column:
    """Whether a row is among about ``most`` of ``n``, by the hash of its key."""
    return F.pmod(F.xxhash64(key), F.lit(HASHES)) < F.lit(min(HASHES, math.ceil(HASHES * most / max(n, 1))))


def train(logs: DataFrame, documents: DataFrame) -> Model:
    """Fit on about MOST_ROWS log rows and MOST_DOCS documents, drawn by hash of their ids in one pass over each table."""
    return fit(*sampled(logs, documents))


def sampled(logs: DataFrame, documents: DataFrame) -> tuple[list[tuple[str, str]], list[str], list[str]]:
    """(pairs, texts of documents, their languages)."""
    rows = logs.where(_below("log_id", MOST_ROWS, logs.count())).where("query is not null and answer is not null").select("log_id", "query", "answer").limit(2 * MOST_ROWS).collect()
    lang = F.lower(F.substring("lang", 1, 2))
    docs = documents.select("doc_id", "text", lang.alias("lang")).where(F.col("lang").isin(*LANGUAGES))
    # As many documents of each language as there are, up to an equal share.
    share = MOST_DOCS // len(LANGUAGES)
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    near = F.lit(False)
    for k, n in counts.items():
        near |= (F.col("lang") == k) & _below("doc_id", share, n)
    found = docs.where(near & (F.length("text") > 100)).limit(2 * MOST_DOCS).collect()
    pairs = {r["log_id"]: (r["query"], r["answer"]) for r in rows if not no_text(r["answer"])}
    found = sorted({r["doc_id"]: r for r in found}.values(), key=lambda r: r["doc_id"])
    return [pairs[k] for k in sorted(pairs)], [r["text"] for r in found], [r["lang"] for r in found]


def pair_defects(logs: DataFrame, model: Model) -> DataFrame:
    """(log_id, defect) of every log_id whose answer has a defect."""
    shared = logs.sparkSession.sparkContext.broadcast(model)  # fixed size: hashed weights
    rows = logs.select("log_id", "query", "answer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = predict(m, b.column(1).to_pylist(), b.column(2).to_pylist())
            keep = [i for i, f in enumerate(found) if f is not None]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([found[i] for i in keep], pa.string())], names=["log_id", "defect"])

    # Deliveries of one log_id agree, so its verdicts do; they are merged after judging, when few are left.
    return rows.mapInArrow(run, "log_id bigint, defect string").groupBy("log_id").agg(F.min("defect").alias("defect"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "query_logs")
    return pair_defects(logs, train(logs, table(spark, sf_dir, "documents")))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects by kind, with how many of them the log itself calls an error or leaves uncited."""
    logs = table(spark, sf_dir, "query_logs")
    found = p3_found(spark, sf_dir)
    hints = logs.select("log_id", F.col("error").isNotNull().alias("has_error"), (F.coalesce("citation_count", F.lit(0)) == 0).alias("uncited"))
    hints = hints.groupBy("log_id").agg(F.max("has_error").alias("has_error"), F.max("uncited").alias("uncited"))
    return found.join(hints, "log_id").groupBy("defect").agg(F.count(F.lit(1)).alias("answers"), F.count_if("has_error").alias("with_error"), F.count_if("uncited").alias("uncited"))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report}
ORACLES: dict[str, str] = {}
