"""The training-data operators against brute force, exact round trips and held-out rows."""

import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvina.llm import encoding, neardup, ocr, packing, pairs, percentiles, pii, queries, reading, splitting

VOCABULARY = os.path.join(encoding.TOKENIZERS, encoding.VOCABULARY)
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="vocabulary files are not here")
SENTENCE = "Il perito incaricato controlla la pressione del circuito, poi scrive il verbale; la ditta ripara il tubo e chiude la pratica. "


def test_every_problem_has_its_query():
    names = set(queries.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 9)} | {"p7_ids", "p8_packed"} <= names
    assert set(queries.oracle_sql()) <= names


# --- 1 --------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", [SENTENCE * 40, "parola " * 700, "uno\n\n" * 400, "x" * 5000 + " y" * 400, ("Art. 12 n. 5 del contratto " * 90).strip()])
def test_pieces_cover_the_text_within_the_limits(text):
    words = [m.span() for m in splitting.WORD.finditer(text)]
    pieces = splitting.split_text(text)
    assert pieces[0][0] == words[0][0] and pieces[-1][1] == words[-1][1]
    for a, b, n in pieces:
        assert n == len(splitting.WORD.findall(text[a:b])) <= 160
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        assert c > a and len(splitting.WORD.findall(text[c:b])) <= 24
        assert not text[b:c].strip() if c >= b else True


def test_pieces_end_where_the_text_pauses():
    text = SENTENCE * 40
    assert all(text[a:b].rstrip()[-1] in ".;," for a, b, _ in splitting.split_text(text))


def test_short_texts_are_not_cut():
    assert splitting.split_text("") == [] and splitting.split_text(" \n\t") == []
    assert len(splitting.split_text("una parola")) == 1


def test_split_rows(spark):
    whole = "Inizio. " + SENTENCE * 20
    part = whole[8:]
    chunks = spark.createDataFrame([(1, 10, part, 8, 8 + len(part), "q"), (2, 10, part, None, None, "q"), (3, 11, part, None, None, "q"), (4, 10, None, 0, 0, "q"), (5, 10, "breve", 0, 5, "q"), (1, 10, part, 8, 8 + len(part), "q")], "chunk_id long, document_id long, text string, char_start int, char_end int, at string")
    docs = spark.createDataFrame([(10, whole, "clash")], "doc_id long, text string, at string")
    rows = splitting.split_oversized(chunks, docs).collect()
    assert {r.chunk_id for r in rows} == {1, 2, 3}
    for r in rows:
        assert r.token_count == max(1, len(r.text.split()) * 135 // 100)
        if r.chunk_id != 3:
            assert whole[r.char_start : r.char_end] == r.text
        else:
            assert r.char_start is None and r.char_end is None
    assert splitting.split_oversized(chunks.limit(0), docs).count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(chunks, docs, 10, 10)


# --- 6 --------------------------------------------------------------------------------------


def test_percentiles_against_sorting(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(-1000, 10**6)) for _ in range(400)] + [("c", 5)] + [("d", 7)] * 20 + [(None, 9), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    got = {(r.g, r.percentile): (r.value, r.n) for r in percentiles.percentiles(percentiles.value_counts(df, ["g"], "v"), ["g"], (0.5, 0.9, 1.0)).collect()}
    for g in ("a", "b", "c", "d", None):
        values = sorted(v for k, v in rows if k == g and v is not None)
        for p in (0.5, 0.9, 1.0):
            assert got[g, p] == (values[max(1, int(np.ceil(round(p * len(values), 9)))) - 1], len(values))


def test_percentiles_combine_and_bound_the_error(spark):
    a = spark.createDataFrame([("x", float(i) / 7) for i in range(100)], "g string, v double")
    b = spark.createDataFrame([("x", float(i)) for i in range(100)], "g string, v double")
    counts = percentiles.combine_counts([percentiles.value_counts(t, ["g"], "v", 0.01) for t in (a, b)], ["g"])
    got = percentiles.percentiles(counts, ["g"], (0.5,), 0.01).first()
    exact = sorted([i / 7 for i in range(100)] + list(range(100)))[99]
    assert abs(got.value - exact) <= 0.01 and got.n == 200
    assert percentiles.percentiles(counts.limit(0), ["g"], (0.5,)).count() == 0
    with pytest.raises(ValueError):
        percentiles.percentiles(counts, ["g"], (0.0,))


def test_latencies_without_intent_are_a_group(spark):
    from datetime import datetime

    rows = [(i, datetime(2024, 1, 1), "web", "factual" if i else None, 10 + i) for i in range(3)]
    logs = spark.createDataFrame(rows, "log_id long, created_at timestamp, source string, intent string, latency_ms int")
    got = percentiles.percentiles(percentiles.latency_counts(logs), percentiles.GROUPS, (0.5,)).collect()
    assert {(r.intent, r.value, r.n) for r in got} == {(None, 10.0, 1), ("factual", 11.0, 2)}


# --- 7 and 8 --------------------------------------------------------------------------------


@needs_vocabulary
def test_ids_agree_with_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    rng = random.Random(1)
    letters = "ab \n\t é1€ \x1c<|endoftext|>'s'lle  xyzABC保🚗.,!?-"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["a" * 5000, "ab" * 3000, " " * 999, SENTENCE * 50, "<|endoftext|>"]
    enc = encoding.encoder(VOCABULARY)
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(enc.encode(text), np.int32).tolist() == want.ids


@needs_vocabulary
def test_every_row_gets_ids(spark):
    df = spark.createDataFrame([(1, "ciao mondo", 0), (2, "", 0), (3, None, 0), (1, "ciao mondo", 0), (None, "x", 0)], "doc_id long, text string, ids int")
    rows = [(r.doc_id, r.ids) for r in encoding.encode_ids(df).collect()]
    assert len(rows) == 5 and dict(rows)[2] == dict(rows)[3] == [] and rows[0][1] == rows[3][1]
    assert encoding.encode_ids(df.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in encoding.token_counts(df).collect()}[2] == 0


def test_packs(spark):
    rng = random.Random(5)
    sizes = [(i, rng.choice([0, 3, 17, 17, 17, 100, 900, 2048, 2049, 5000, 1500])) for i in range(600)] + [(9999, None), (1, 17)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens int")
    rows = packing.pack(df).collect()
    assert sum(r.n_tokens for r in rows) == sum(n or 0 for _, n in sizes)
    held = {}
    for r in rows:
        held.setdefault(r.container_id, []).append((r.offset, r.n_tokens))
    for places in held.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 2048
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
    for i, n in sizes[:600]:
        if i != 1:
            assert sum(k for _, k in pieces.get(i, [])) == n
            assert len(pieces.get(i, [])) == -(-n // 2048)
    least = -(-sum(n or 0 for _, n in sizes) // 2048)
    assert len(held) <= least * 1.05 + 1
    assert packing.pack(df.limit(0)).count() == 0


# --- 5 --------------------------------------------------------------------------------------


def brute(rows, shingle, threshold, least):
    import regex

    sets = {}
    for i, t in rows:
        w = regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
        if len(w) >= max(least, shingle):
            sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}


@pytest.mark.parametrize("shingle,threshold,least", [(3, 0.6, 20), (5, 0.8, 0)])
def test_near_duplicates_against_brute_force(spark, shingle, threshold, least):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(15, 90))]
        rows.append((i * 10, " ".join(base)))
        for k in range(1, rng.randrange(1, 5)):
            new = list(base)
            for _ in range(rng.randrange(0, 8)):
                new[rng.randrange(len(new))] = rng.choice(words)
            if rng.random() < 0.3:
                new = new[5:] + new[:5]
            rows.append((i * 10 + k, " ".join(new).upper() if k == 2 else " ".join(new)))
    rows += [(9001, None), (9002, ""), (9003, "uno due"), (9004, "x " * 3000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "chunk_id long, text string, lo int")
    members, links = neardup.near_duplicates(df, "chunk_id", "text", shingle, threshold, least)
    assert {tuple(r) for r in neardup.expanded_pairs(members, links).collect()} == brute(rows, shingle, threshold, least)
    groups = neardup.duplicate_groups(members, links).collect()
    assert len(groups) == members.count()


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "chunk_id long, text string")
    members, links = neardup.near_duplicates(df, "chunk_id", "text")
    assert members.count() == 0 and links.count() == 0 and neardup.expanded_pairs(members, links).count() == 0


def test_hot_sequences_are_split(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 3)
    monkeypatch.setattr(neardup, "GROUP", 2)
    rows = [(i, f"alfa beta gamma delta epsilon zeta eta theta iota kappa v{i}") for i in range(25)]
    df = spark.createDataFrame(rows, "chunk_id long, text string")
    members, links = neardup.near_duplicates(df, "chunk_id", "text", 3, 0.6)
    assert {tuple(r) for r in neardup.expanded_pairs(members, links).collect()} == brute(rows, 3, 0.6, 0)


def test_few_buckets_and_small_blocks(spark, monkeypatch):
    """As on an input with far more sequences than buckets: every bucket holds more than HOT, and blocks and hot partners are split."""
    for name, value in (("BUCKET_BITS", 4), ("BLOCKS", 4), ("HOT", 3), ("PAIRS_PER_BLOCK", 4), ("CHARS_PER_BLOCK", 500)):
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(5)
    rows = [(i, " ".join(["alfa beta gamma delta epsilon zeta eta theta iota kappa"] + [f"v{rng.randrange(6)}" for _ in range(4)])) for i in range(40)]
    rows += [(100 + i, " ".join(f"u{rng.randrange(900)}" for _ in range(40))) for i in range(40)]
    df = spark.createDataFrame([*rows, (3, "uno due tre quattro"), rows[0]], "chunk_id long, text string")
    members, links = neardup.near_duplicates(df, "chunk_id", "text", 3, 0.6, 5)
    assert {tuple(r) for r in neardup.expanded_pairs(members, links).collect()} == brute(rows, 3, 0.6, 5)


def test_very_long_texts_are_compared(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", 1)  # as if the rarest sequence of one had been edited
    rng = random.Random(4)
    base = [f"w{rng.randrange(50_000)}" for _ in range(100_000)]
    rows = []
    for i in range(2):
        new = list(base)
        for _ in range(200):
            new[rng.randrange(len(new))] = "neu"
        rows.append((i, " ".join(new)))
    df = spark.createDataFrame(rows, "chunk_id long, text string")
    members, links = neardup.near_duplicates(df, "chunk_id", "text", 5, 0.8)
    assert {tuple(r) for r in neardup.expanded_pairs(members, links).collect()} == brute(rows, 5, 0.8, 0) == {(0, 1)}


def test_sequences_follow_the_rule_of_words():
    import regex

    rng = random.Random(8)
    texts = ["", None, "x", "a\x01b c d", "ΟΔΟΣ Σας straße İstanbul ½ ² _a_b_ c", "\U0001d400 \U0001f600 中文 字 ée e\u0301", "w" * 5_000 + " b c", "W" * 5_001 + " b c"]
    texts += ["".join(rng.choice("aB_ \x01é½ \n9Σ-'́中") for _ in range(rng.randrange(60))) for _ in range(500)]
    sets = neardup.shingle_sets(texts, 2, 0)
    ours, theirs = {}, {}
    for t, s in zip(texts, sets):
        w = regex.findall(r"[\p{L}\p{N}]+", (t or "").replace("\x01", " ").lower())
        want = {(a, b) for a, b in zip(w, w[1:])}
        assert (s is None) == (len(w) < 2) and (s is None or len(s) == len(want))
        if s is not None:
            ours.setdefault(s.tobytes(), len(ours)), theirs.setdefault(frozenset(want), len(theirs))
            assert ours[s.tobytes()] == theirs[frozenset(want)]


def test_words_are_hashed_together():
    """The work per word is not done in Python, where it took most of the time of p5."""
    import sys

    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += 1

    texts = [" ".join(f"w{i * 500 + k}" for k in range(500)) for i in range(20)]
    neardup.shingle_sets(texts, 3, 0)
    sys.setprofile(count)
    try:
        neardup.shingle_sets([t.replace("w", "v") for t in texts], 3, 0)
    finally:
        sys.setprofile(None)
    assert calls < 5_000


def test_postings_that_no_pair_can_need_are_not_paired(monkeypatch):
    """A sequence so late in the smaller set that even a set of that size could not reach the threshold."""
    sizes = [80] * 300 + [120] * 300
    rest = [55] * 300 + [78] * 300
    frame = pd.DataFrame({
        "token": [np.full(600, 7, np.uint32).tobytes()],
        "holder": [np.arange(600, dtype=np.uint16).tobytes()],
        "rest": [np.array(rest, np.uint16).tobytes()],
        "sizes": [np.ones(600, np.uint8).tobytes()],
        "lo": [np.arange(600, dtype=np.int64).tobytes()],
        "n": [np.array(sizes, np.int32).tobytes()],
        "bits": [b"\xff" * (600 * neardup.SKETCH_BITS // 8)],
    })
    longest, repeat = 0, np.repeat

    def counted(*args, **named):
        nonlocal longest
        out = repeat(*args, **named)
        longest = max(longest, len(out))
        return out

    monkeypatch.setattr(np, "repeat", counted)
    assert len(neardup._candidates(frame, 0.6)) == 0 and longest <= 600


def test_long_texts_that_share_phrases_are_no_candidates(spark):
    rng = random.Random(6)
    phrases = [" ".join(f"w{rng.randrange(5_000)}" for _ in range(10)) for _ in range(400)]
    rows = spark.createDataFrame([(i, " ".join(rng.sample(phrases, 100))) for i in range(30)], "id long, text string")
    counts = spark.sparkContext.broadcast(neardup._Counts(neardup._bucket_counts(neardup._profile(rows, 3, 0))))
    posted = neardup._post(neardup._leading(rows, counts, 3, 0, 0.6), counts, 1).toPandas()
    assert posted["sizes"].map(len).sum() > 0 and len(neardup._candidates(posted, 0.6)) == 0


# --- 2 --------------------------------------------------------------------------------------


def within_reach(form: str, word: str) -> bool:
    """One step of any kind or two known confusions, by all alignments."""
    ways: list[list[set]] = [[set() for _ in range(len(word) + 1)] for _ in range(len(form) + 1)]
    ways[0][0].add((0, 0))
    for i in range(len(form) + 1):
        for j in range(len(word) + 1):
            for confused, other in ways[i][j]:
                for di, dj in ((1, 1), (1, 0), (0, 1), (2, 1), (1, 2)):
                    if i + di <= len(form) and j + dj <= len(word):
                        read, meant = form[i : i + di], word[j : j + dj]
                        step = (0, 0) if read == meant else (1, 0) if (read, meant) in ocr.COST else (0, 1)
                        new = (confused + step[0], other + step[1])
                        if new in ((0, 0), (1, 0), (2, 0), (0, 1)):
                            ways[i + di][j + dj].add(new)
    return bool(ways[len(form)][len(word)])


WORDS = sorted({"".join(random.Random(n).choice("abcdeilmnrt") for _ in range(2 + n % 9)) for n in range(500)} | set("ordina firma clima turni ditta garanzia contratto polizza modulo consegna".split()))
READ = ["orclina", "firrna", "d1tta", "tumi", "cl", "a", "abc", "turrii", "garanxia", "garanzja", "conhratto", "poljzza", "modlo", "polizzza", "c0nsegn@", "(0nsegna", "garanziaa", "gwanzia", *WORDS[::25]]


def test_automaton_finds_every_candidate():
    trie = ocr.build_trie(WORDS)
    for form in (*READ, ""):
        want = {w for w in WORDS if within_reach(form, w)}
        assert {w for w, _, _ in ocr.lookup(form, trie)} == want, form


def test_corrections_are_complete(spark):
    """Every candidate arrives through the tries that a form visits, hot keys split or not, with edits that no table has too."""
    vocab = spark.createDataFrame([(w, 5) for w in WORDS], "word string, n long")
    unknown = spark.createDataFrame([(f,) for f in sorted(set(READ))], "form string")
    want = {(f, w) for f in READ for w in WORDS if within_reach(f, w)}
    assert {("garanxia", "garanzia"), ("garanzja", "garanzia"), ("conhratto", "contratto"), ("poljzza", "polizza"), ("c0nsegn@", "consegna")} <= want
    for most in (20_000, 2):
        assert {(r.form, r.word) for r in ocr.corrections(unknown, vocab, most).collect()} == want
    assert ocr.corrections(unknown.limit(0), vocab).count() == 0 and ocr.corrections(unknown, vocab.limit(0)).count() == 0


def test_plain_edits_are_repaired(spark):
    """An edit outside the table of confusions is repaired where neighbours bear it out; accents and repeated unknown words stay."""
    line = "Il perito controlla la garanzia del contratto e la modalità di consegna. "
    plain = [(i, 100 + i, 0, line * 4, None, None) for i in range(30)]
    page = "Il perito controlla la garanxia del\ncontratto e la modalita' di\nconsegna. Il perito Garanxi controlla\nla garanzia del conhratto."
    schema = "chunk_id long, document_id long, chunk_index int, text string, page_start int, section_title string"
    chunks = spark.createDataFrame(plain + [(50, 7, 0, page, 2, None)], schema)
    docs = spark.createDataFrame([(7, True)], "doc_id long, ocr_used boolean")
    proof = ocr.evidence(chunks, docs)
    assert [(r.line_no, r.defect) for r in ocr.line_defects(proof).orderBy("line_no").collect() if r.defect == "misread"] == [(1, "misread"), (4, "misread")]
    assert "la garanzia del contratto e la modalita' di consegna" in ocr.repaired_texts(proof).first().text


PAGE = "Rondine - Allegato 114\nIl perito controlla la pres-\nsione del circuito con strumenti ta-\nrati e conserva le r!cevute in ambito post-\nvendita. La clitta ripara il tubo.\n\n299\n308\n\nIl broker firma la quietanza.\nRev. 8\n2"


def test_page_is_repaired():
    known = {w for line in ocr.page_lines(PAGE) for t in line.split() for w in ocr.forms(t)} - {"r!cevute", "clitta", "pres", "sione", "ta", "rati"} | {"pressione", "tarati", "post-vendita"}
    fixes = {"r!cevute": "ricevute", "clitta": "ditta"}
    heads = {ocr.core("Rondine - Allegato 114")}
    found = ocr.defects(PAGE, 2, heads, {ocr.skeleton("Rev. 8")}, known, fixes)
    assert found == [(1, "furniture"), (2, "hyphenation"), (3, "hyphenation"), (4, "misread"), (5, "misread"), (11, "furniture"), (12, "furniture")]
    text = ocr.repaired(PAGE, 2, heads, {ocr.skeleton("Rev. 8")}, known, fixes)
    assert text.startswith("Il perito controlla la pressione del circuito con strumenti tarati e conserva le ricevute in ambito post-vendita. La ditta ripara il tubo.")
    assert "Rev" not in text and text.endswith("Il broker firma la quietanza.")


def test_scans_in_rows(spark):
    plain = [(i, 100 + i, 0, "Il perito controlla la pressione del circuito con strumenti tarati e conserva le ricevute. La ditta ripara il tubo. Il broker firma la quietanza.", None, None) for i in range(5)]
    rows = plain + [(50, 7, 0, PAGE, 2, None), (51, 8, 0, None, 1, None), (52, 9, 0, "", 1, None), (50, 7, 0, PAGE, 2, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, chunk_index int, text string, page_start int, known string")
    docs = spark.createDataFrame([(7, True), (8, None)], "doc_id long, ocr_used boolean")
    proof = ocr.evidence(chunks, docs)
    found = {(r.chunk_id, r.line_no, r.defect) for r in ocr.line_defects(proof).collect()}
    assert {(50, 2, "hyphenation"), (50, 4, "misread"), (50, 5, "misread"), (50, 12, "furniture")} <= found and {c for c, _, _ in found} == {50}
    assert "pressione del circuito" in ocr.repaired_texts(proof).first().text
    assert ocr.line_defects(ocr.evidence(chunks.limit(0), docs)).count() == 0


def test_compounds_of_scans_do_not_judge_themselves(spark):
    plain = [(i, 100 + i, "Il servizio vendita risponde al post di assistenza.") for i in range(4)]
    scans = [(50, 7, "Il servizio post-vendita e post-vcndita risponde")]
    schema = "chunk_id long, document_id long, text string"
    words = {r.word for r in ocr.vocabulary(spark.createDataFrame(plain + scans, schema), spark.createDataFrame(scans, schema)).collect()}
    assert "post-vendita" in words and "post-vcndita" not in words
    known, fixes = {"post", "vendita"}, {"vcndita": "vendita"}
    assert ocr._bad("post-vcndita", known, fixes) and ocr.fixed("Post-vcndita,", known, fixes) == "Post-vendita,"


# --- 3 --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def fitted(spark, data):
    larger = data.replace("0.001", "0.01")  # a few thousand rows to learn from
    data = larger if os.path.isdir(larger) else data
    logs, docs = spark.read.parquet(f"{data}/query_logs.parquet"), spark.read.parquet(f"{data}/documents.parquet")
    return pairs.fit_with_report(*pairs.sampled(logs, docs))


@pytest.fixture(scope="module")
def model(fitted):
    return fitted[0]


def test_empty_answers(model):
    empty = [None, "", " \n", "...", "N/A", "null", "{}", "[]", "—", "<empty>", "\xa0", "n.d.", "(none)", "NULL."]
    full = ["No.", "Sì", "12", "nulla osta", "Prego!", "45 giorni."]
    got = pairs.predict(model, ["Qual è la penale?"] * len(empty + full), empty + full)
    assert got[: len(empty)] == ["empty"] * len(empty)
    assert "empty" not in got[len(empty) :]
    assert pairs.no_text("\xa0. ") and not pairs.no_text("12")


def test_defects_of_pairs(model):
    q = "Qual è la franchigia per il portale fornitori?"
    good = "Il perito incaricato esegue il check-up dell'impianto e invia il riepilogo dei costi."
    cases = [
        (q, good, None),
        (q, good.rstrip("."), None),
        (q, None, "empty"),
        (None, good, None),
        (q, "N/A", "empty"),
        (q, "Qual è la franchigia per il portale fornitori", "copy"),
        (q, q.upper(), "copy"),
        (q, f"**{q}**\n\n{good}", None),
        (q, "Mi dispiace, ma non posso rispondere a questa domanda.", "refusal"),
        (q, "Non ho trovato informazioni su questo.", "refusal"),
        (q, "The licensed installer renews the support contract and checks the papers received.", "other_language"),
        (f"Traduci in inglese: {q}", "The licensed installer renews the support contract and checks the papers received.", None),
        (q, "Il perito incaricato esegue il check-up dell'impi", "truncated"),
        (q, "Il perito incaricato esegue il check-up, [", "truncated"),
    ]
    got = pairs.predict(model, [c[0] for c in cases], [c[1] for c in cases])
    right = sum(g == w for g, (_, _, w) in zip(got, cases))
    assert right >= len(cases) - 1, list(zip(got, cases))


def test_held_out_defects(fitted):
    """Rows of other pairs, and refusals in other wordings, than those learnt from; every label counts."""
    report = fitted[1]
    assert set(report) == set(pairs.LABELS)
    assert all(p > 0.85 and r > 0.8 for p, r in report.values()), report


def test_every_defect_occurs_in_the_log(model, data):
    """The last weights and the thresholds fit each other: no label vanishes, none takes over."""
    logs = pd.read_parquet(f"{data}/query_logs.parquet", columns=["query", "answer"]).astype(object)
    logs = logs.where(logs.notna(), None)
    got = pd.Series(pairs.predict(model, logs["query"].tolist(), logs["answer"].tolist()))
    share = got.value_counts() / len(got)
    assert all(0.004 < share.get(label, 0) < 0.06 for label in pairs.LABELS), share


def test_split_keeps_sources_and_wordings_apart():
    made = pairs.synthetic([(f"Qual è la penale numero {i} per il portale?", "Il perito esegue il controllo dell'impianto. La ditta invia il conto.", "it") for i in range(60)], 3)
    train, held = pairs.split(made)
    assert not (train & held).any() and train.any() and held.any()
    for k in (3, 4):
        seen, unseen = {m[k] for m, t in zip(made, train) if t}, {m[k] for m, h in zip(made, held) if h}
        assert not (seen & unseen) - {-1}


def test_pairs_in_rows(spark, model):
    df = spark.createDataFrame([(1, "Qual è la penale?", None, "x"), (1, "Qual è la penale?", None, "x"), (2, None, None, "x"), (3, "Ciao", "Ciao! Come posso aiutarti oggi?", "x")], "log_id long, query string, answer string, defect string")
    assert {tuple(r) for r in pairs.pair_defects(df, model).collect()} == {(1, "empty"), (2, "empty")}
    assert pairs.pair_defects(df.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    logs = spark.createDataFrame([], "log_id long, query string, answer string")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    m = pairs.train(logs, docs)
    assert pairs.predict(m, ["Qual è la penale?", "x"], ["Cento euro.", ""]) == [None, "empty"]


# --- 4 --------------------------------------------------------------------------------------

COMMON = frozenset("il la pratica chiede ha risposto confermando danno per contattare numero residente presenza conferma codice fiscale documento presso abito indirizzo".split())


@pytest.mark.parametrize(
    "text,want",
    [
        ("Scrivere a m.rossi@example.com.", [("email", "m.rossi@example.com")]),
        ("Scrivere a m.rossi (at) mail (dot) example (dot) net oppure", [("email", "m.rossi (at) mail (dot) example (dot) net")]),
        ("Scrivere a irene66 chiocciola example punto net entro", [("email", "irene66 chiocciola example punto net")]),
        ("Scrivere a d.neri @ example.org entro", [("email", "d.neri @ example.org")]),
        ("Scrivere a m​.rossi@exam­ple.com ora", [("email", "m​.rossi@exam­ple.com")]),
        ("Chiamare +39 399 005 1322 o (06) 0777872", [("phone", "+39 399 005 1322"), ("phone", "(06) 0777872")]),
        ("Il numero è 06-095.7666.", [("phone", "06-095.7666")]),
        ("pratica n. 98328512 del 12/05/2021 per 11.932,33 euro, SX-2022-284966", []),
        ("codice fiscale PLV SLV 78M21 Z943N.", [("identity", "PLV SLV 78M21 Z943N")]),
        ("documento AW 5212717, passaporto CR93326BQ", [("identity", "AW 5212717"), ("identity", "CR93326BQ")]),
        ("Abito in Via del Mulino Vecchio, n. 174/B: sono coperto?", [("address", "Via del Mulino Vecchio, n. 174/B")]),
        ("I live at 21B Tanners Row, is it covered?", [("address", "21B Tanners Row")]),
        ("per via di 53 segnalazioni nel corso 12 di formazione", []),
        ("Ha risposto Maria Luisa D'Ancorvi confermando", [("name", "Maria Luisa D'Ancorvi")]),
        ("La sig.ra Laura Anna D'Ancorvi, residente", [("name", "Laura Anna D'Ancorvi")]),
        ("Contattare Corvandrei Simone al numero", [("name", "Corvandrei Simone")]),
        ("contattare paolo draghezzani per", [("name", "paolo draghezzani")]),
        ("Chiede T. Quillstead", [("name", "T. Quillstead")]),
        ("La polizza Diana Impresa e il progetto Ametista", []),
        ("", []),
    ],
)
def test_finds(text, want):
    found = [(k, text[a:b]) for a, b, k in pii.finds(text, COMMON)]
    assert found == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("Il 12/05/2021 lascia il numero zero sei tre due uno nove otto sette due oggi", [("phone", "zero sei tre due uno nove otto sette due")]),
        ("Vedi [1]: zero sei tre due uno nove otto sette due", [("phone", "zero sei tre due uno nove otto sette due")]),
        ("Ha risposto M\u0430rio Draghezzani confermando", [("name", "M\u0430rio Draghezzani")]),
        ("Ha risposto Ma\u200brio Draghezzani confermando", [("name", "Ma\u200brio Draghezzani")]),
        ("Chiede \u0422. Quillstead", [("name", "\u0422. Quillstead")]),
        ("Abito in Vi\u0430 del Mulino Vecchio, n. 174", [("address", "Vi\u0430 del Mulino Vecchio, n. 174")]),
        ("Abito in Piaz\u00adza Garibaldi, n. 12", [("address", "Piaz\u00adza Garibaldi, n. 12")]),
        ("Abito in V. Garibaldi, n. 12", [("address", "V. Garibaldi, n. 12")]),
        ("I live at 21 Tanners R\u043ew, is it covered?", [("address", "21 Tanners R\u043ew")]),
        ("Scrivere a info\uff20acme.it entro", [("email", "info\uff20acme.it")]),
    ],
)
def test_gates_see_the_normalised_text(text, want):
    assert [(k, text[a:b]) for a, b, k in pii.finds(text, COMMON)] == want


def test_redaction_leaves_the_rest(spark):
    text = "Scrivere a m.rossi@example.com o chiamare 06-095.7666, grazie."
    assert pii.redact(text, COMMON) == "Scrivere a [EMAIL] o chiamare [PHONE], grazie."
    assert pii.redact(None, COMMON) is None and pii.redact("", COMMON) == ""
    long = "parola " * 20000 + "m.rossi@example.com"
    assert pii.redact(long, COMMON).endswith("parola [EMAIL]")


def test_finds_in_rows(spark):
    chunks = spark.createDataFrame([(1, "a x@example.com x@example.com", 0), (2, None, 0)], "chunk_id long, text string, found_text int")
    logs = spark.createDataFrame([(7, "chiamare 06-095.7666", None), (7, "chiamare 06-095.7666", None)], "log_id long, query string, answer string")
    rows = {tuple(r) for r in pii.pii_finds(pii._fields(chunks, logs), pii.lexicon(chunks)).collect()}
    assert rows == {("chunks", 1, "text", "email", "x@example.com"), ("query_logs", 7, "query", "phone", "06-095.7666")}
    assert pii.pii_finds(pii._fields(chunks.limit(0), logs.limit(0)), pii.lexicon(chunks.limit(0))).count() == 0


def test_given_names_are_learnt(spark):
    """A given name that no list has is known by the surnames after it; companies before surnames are not."""
    texts = [f"{g} {n} ha chiamato. " for g in ("Mario", "Anna", "Ezechiele") for n in ("Brambilla", "Rossetti", "Ferlenzi")]
    texts += ["Edilcasa Brambilla ha chiuso. Edilcasa ha riaperto. Edilcasa Nord ha vinto. Edilcasa paga."] * 2 + ["il perito ha chiamato e ha chiuso la pratica, paga chi ha vinto e chi ha riaperto"] * 3
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id long, text string")
    words = pii.lexicon(chunks)
    assert "ezechiele" in words.given and "edilcasa" not in words.given and "brambilla" not in words.given
    find = lambda t: [t[a:b] for a, b, k in pii.finds(t, words.common, words.given) if k == "name"]
    assert find("Oggi Ezechiele Sconosciuti ha vinto") == ["Ezechiele Sconosciuti"]
    assert find("La signora Priya Sharma ha chiamato, e Mr. Kofi Mensah-Boateng paga") == ["Priya Sharma", "Kofi Mensah-Boateng"]
    fields = chunks.select(F.lit("chunks").alias("table_name"), F.col("chunk_id").alias("row_id"), F.lit("text").alias("field_name"), "text")
    few = pii.lexicon(chunks, fields, most=0)
    assert few.common < words.common and few.given == words.given
    rows = lambda w: {tuple(r) for r in pii.pii_finds(fields, w).collect()}
    assert rows(few) == rows(words) != set()


def test_normalised_places_point_at_the_source():
    for text in ("a (at) b (dot) com ​x", "１２ 保 ok", "zero sei tre due uno nove otto", ""):
        norm, at = pii.normalise(text)
        assert len(at) == len(norm) + 1 and at == sorted(at) and at[-1] == len(text)


# --- 9 --------------------------------------------------------------------------------------


def test_isotonic_is_monotone_and_pools():
    x, y = reading.isotonic(np.array([1, 2, 3, 4.0]), np.array([1, 3, 2, 4.0]))
    assert list(y) == sorted(y) and y[1] == 2.5


def test_held_out_reading_levels(spark, data):
    larger = data.replace("0.001", "0.01")
    if not os.path.isdir(larger):
        pytest.skip("tables are not here")
    texts, levels = reading.graded(spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/reading_labels.parquet"))
    r = reading.fit_ranker(texts[::2], levels[::2])
    assert np.mean([r.level(r.score(t)) == y for t, y in zip(texts[1::2], levels[1::2])]) > 0.85


def test_reading_rows(spark):
    easy, hard = "Il cane vede la casa. " * 12, "Subordinatamente al perfezionamento della surrogazione, il fideiussore coobbligato rinuncia irrevocabilmente all'eccezione. " * 6
    docs = spark.createDataFrame([(1, easy, "it"), (2, hard, "IT-it"), (3, None, "it"), (4, "breve", "it"), (5, easy, None), (6, easy, "de"), (1, easy, "it"), (7, "- " * 60, "it")], "doc_id long, text string, lang string")
    r = reading.fit_ranker([easy, hard] * 3, [1, 4] * 3, least_docs=1)
    rows = [(x.doc_id, x.reading_level) for x in reading.reading_levels(docs, r).collect()]
    assert sorted(rows)[:3] == [(1, 1), (1, 1), (2, 4)] and {i for i, _ in rows} <= {1, 2, 7}
    assert reading.reading_levels(docs.limit(0), r).count() == 0
    assert reading.fit_ranker([], []).level(0.3) == 2 and reading.fit_ranker([easy], [3]).level(9.0) == 3


def test_patterns_that_words_rule_out_are_not_tried(monkeypatch):
    class Never:
        def search(self, text):
            raise AssertionError(text)

    for name in ("HAS_AT", "SPELLED", "TITLED"):
        monkeypatch.setattr(pii, name, Never())
    assert pii.finds("La polizza n. 12 copre tre danni e due furti.", frozenset()) == []


def test_ruling_patterns_out_by_words_loses_no_find(monkeypatch):
    import re

    class Every(frozenset):
        def isdisjoint(self, other):
            return False

    parts = "Sig.ra|Dott.|Mr|MS.|Rossini|Verdelli|Anna|anna|at|AT|[at]|(at)|chiocciola|CHIOCCIOLA|punto|dot|uno|Due|tre|sei|OTTO|nine|oh|-|,|mail|esempio|it|documento|passport|ab1234567|AB 1234567|333 1234567|via Roma 12|_at|3sei|@|sig|Miss|fine.".split("|")
    draw = random.Random(4)
    texts = [draw.choice((" ", " ", "\n")).join(draw.choices(parts, k=draw.randint(1, 24))) for _ in range(4_000)]
    texts += ["chiama tre tre tre uno due sei otto nove uno due", "mail anna at esempio dot it", "Sig.ra Orsola Verdelli", "passport ab 1234567"]
    gated = [pii.finds(t, frozenset()) for t in texts]
    monkeypatch.setattr(pii, "PLAIN", re.compile("(?!)"))
    monkeypatch.setattr(pii, "TITLES", Every())
    monkeypatch.setattr(pii, "SEVEN_DIGITS", re.compile(""))
    assert gated == [pii.finds(t, frozenset()) for t in texts] and all(gated[-4:])
