"""Reading level of documents from a linear pairwise ranker with isotonic calibration.

Graded documents (a bounded sample: ``MOST_LABELS``) are joined with their texts and described
by syntax features (length of words and sentences, linked clauses, commas, nominal endings),
by how often they use each word and word stem, averaged over sentences, and by vocabulary
components: the main directions in which the words of all documents occur together, so that a
word that no graded document has still counts by the company it keeps. The components come from
the second moments of hashed word shares, summed over every document; their size is fixed.

A linear ranker is fitted so that of two documents of different grade the higher one scores
higher. Isotonic regression turns scores into levels; it is fitted on scores that each graded
document got from a ranker fitted without it. Spark scores all documents.

Null, empty and blank texts and texts under ``least_words`` words get no level, nor do
documents in other languages. Documents that occur twice are scored twice. Without labels, or
with labels of one level only, every document gets the nearest level known (2 without any).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvina.session import table

#: Labelled documents that the ranker is fitted on; more are left out by order of the hash of their id.
MOST_LABELS = 5_000
#: Pairs of documents of different grade in one fit; more are drawn at random.
MOST_PAIRS = 200_000
#: Hashed words whose joint use is summed, the directions kept, and parts the sums travel in.
BUCKETS, COMPONENTS, BLOCKS = 1024, 5, 16
COMPONENT_WEIGHT, WORD_SCALE, STEM, FOLDS = 2.0, 0.04, 5, 10
LEVELS = (1, 2, 3, 4)
BREAK = re.compile(r"(?<=[.!?…])[ \t]+(?=[\"«“(]?[A-ZÀ-ÖØ-Þ])|\n[ \t]*\n\s*|(?<=[.!?:;])\s*\n\s*|\n(?=\d)")
TOKEN = re.compile(r"[^\W\d_]+")
#: Words that link a clause to another (fixed values: Italian, then English).
LINKS = frozenset(
    "se quando qualora purché affinché poiché perché mentre benché sebbene nonostante finché appena dopo prima dato ove salvo salva affinche cui quale quali che nonché".split()
    + "if when unless provided because while although though despite until once since so whose which whom that whereas notwithstanding albeit even".split()
)
#: Endings of abstract nouns (fixed values).
ABSTRACT = ("zione", "zioni", "mento", "menti", "ità", "enza", "anza", "ezza", "aggio", "ura", "tion", "tions", "ment", "ments", "ity", "ence", "ance", "ness", "ship", "sion", "sione")
SYNTAX = 12


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence, lower case; headings and other short lines without an end are left out."""
    out = []
    for part in BREAK.split(text):
        words = TOKEN.findall(part.lower())
        if not words or len(words) < 8 and part.rstrip()[-1:] not in ".!?…":
            continue
        out.append((part, words))
    return out


def syntax(parts: list[tuple[str, list[str]]]) -> np.ndarray:
    x = np.zeros(SYNTAX)
    for part, words in parts:
        n = len(words)
        long = sum(len(w) > 9 for w in words)
        linked = sum(w in LINKS for w in words)
        commas = part.count(",")
        x += (
            min(n, 80) / 20,
            n <= 8,
            n > 25,
            n > 45,
            sum(map(len, words)) / n / 5,
            long / n,
            min(commas, 8) / 4,
            linked > 0,
            linked > 1,
            min(linked, 5) / 5,
            sum(w.endswith(ABSTRACT) for w in words) / n,
            part.count(";") > 0,
        )
    return x / max(1, len(parts))


def parts_of(text: str) -> list[tuple[str, list[str]]]:
    return sentences(text) or [(text, TOKEN.findall(text.lower()) or [""])]


def word_use(parts: list[tuple[str, list[str]]]) -> dict[str, float]:
    """The share of each word and stem, every sentence counting the same."""
    use: Counter[str] = Counter()
    for _, words in parts:
        for w in words:
            use[w] += 1 / len(words)
            use["<" + w[:STEM]] += 1 / len(words)
    return {w: v / len(parts) for w, v in use.items()}


class _Buckets(dict):
    """The bucket of a word."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        v = self[word] = xxhash.xxh32_intdigest(word.encode("utf-8", "replace")) % BUCKETS
        return v


_buckets = _Buckets()


def bucket_shares(parts: list[tuple[str, list[str]]]) -> np.ndarray:
    """The share of each bucket among the words of a document."""
    at = [_buckets[w] for _, words in parts for w in words]
    return np.bincount(at, minlength=BUCKETS) / max(1, len(at))


@dataclass
class Components:
    """Directions of joint use: a document's shares, less ``mean``, times ``axes``."""

    mean: np.ndarray
    axes: np.ndarray  # (BUCKETS, COMPONENTS)

    @staticmethod
    def of(n: float, sums: np.ndarray, moments: np.ndarray) -> Components:
        """From the number of documents, the sums of their shares and of the products of shares."""
        if n < 2:
            return Components(np.zeros(BUCKETS), np.zeros((BUCKETS, COMPONENTS)))
        mean = sums / n
        cov = moments / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-5
        _, axes = np.linalg.eigh(cov / np.outer(sd, sd))
        return Components(mean, axes[:, -COMPONENTS:] / sd[:, None])


class _WordValues(dict):
    """What one word adds to the mean of its sentence."""

    def __init__(self, weights: np.ndarray, words: dict[str, float]):
        super().__init__()
        self.weights, self.words = weights.tolist(), words

    def __missing__(self, word: str) -> float:
        if len(self) > 1_000_000:
            self.clear()
        w = self.weights
        v = self.words.get(word, 0.0) + self.words.get("<" + word[:STEM], 0.0)
        v += len(word) / 5 * w[4] + (len(word) > 9) * w[5] + word.endswith(ABSTRACT) * w[10]
        self[word] = v
        return v


class _BucketValues(dict):
    """What one word adds to the mean of its document."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) > 1_000_000:
            self.clear()
        v = self[word] = self.weights[_buckets[word]]
        return v


@dataclass
class Ranker:
    syntax: np.ndarray
    words: dict[str, float]
    scores: np.ndarray  # calibration: ascending scores
    levels: np.ndarray  # and the level at each
    buckets: np.ndarray  # what the components make of each bucket
    base: float = 0.0

    def __post_init__(self) -> None:
        self.value, self.company = _WordValues(self.syntax, self.words), _BucketValues(self.buckets)

    def score(self, text: str) -> float:
        """The linear score; what depends on single words is summed from two numbers a word."""
        parts = parts_of(text)
        w, value, company, linking = self.syntax.tolist(), self.value.__getitem__, self.company.__getitem__, LINKS.__contains__
        total, shared, every = 0.0, 0.0, 0
        for part, words in parts:
            n = len(words)
            every += n
            linked = sum(map(linking, words))
            shared += sum(map(company, words))
            total += sum(map(value, words)) / n + min(n, 80) / 20 * w[0] + min(part.count(","), 8) / 4 * w[6] + min(linked, 5) / 5 * w[9]
            total += (w[1] if n <= 8 else 0.0) + (w[2] if n > 25 else 0.0) + (w[3] if n > 45 else 0.0)
            total += (w[7] if linked else 0.0) + (w[8] if linked > 1 else 0.0) + (w[11] if ";" in part else 0.0)
        return total / len(parts) + shared / every + self.base

    def level(self, score: float) -> int:
        return int(np.clip(round(float(np.interp(score, self.scores, self.levels))), LEVELS[0], LEVELS[-1]))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the non-decreasing step function nearest to y over sorted x."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # [sum, count, first x, last x]
    for i in order:
        blocks.append([float(y[i]), 1, float(x[i]), float(x[i])])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    xs = [v for b in blocks for v in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    ys = [b[0] / b[1] for b in blocks for _ in ((0, 1) if b[3] > b[2] else (0,))]
    return np.array(xs), np.array(ys)


def _rank(x: np.ndarray, y: np.ndarray, rounds: int, l2: float, seed: int) -> np.ndarray:
    """Logistic loss on pairs of different level, by gradient descent with momentum."""
    lower, upper = np.nonzero(y[:, None] < y[None, :])
    if len(lower) > MOST_PAIRS:
        pick = np.random.default_rng(seed).choice(len(lower), MOST_PAIRS, replace=False)
        lower, upper = lower[pick], upper[pick]
    gap = y[upper] - y[lower]
    w, v = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(rounds):
        s = x @ w
        # The wanted margin is the difference of the levels.
        p = gap / (1 + np.exp(np.clip(2 * (s[upper] - s[lower] - gap), -50, 50)))
        g = np.bincount(lower, p, len(y)) - np.bincount(upper, p, len(y))
        v = 0.9 * v - 0.3 * (x.T @ g / max(1, len(lower)) + l2 * w)
        w = w + v
    return w


def fit_ranker(texts: list[str], levels: list[int], components: Components | None = None, rounds: int = 400, l2: float = 3e-3, least_docs: int = 2, seed: int = 7) -> Ranker:
    """The pairwise ranker with levels calibrated on scores from rankers that did not see the document."""
    if len(set(levels)) < 2:
        only = float(levels[0]) if levels else 2.0
        return Ranker(np.zeros(SYNTAX), {}, np.array([0.0]), np.array([only]), np.zeros(BUCKETS))
    components = components or Components.of(0, np.zeros(0), np.zeros(0))
    parts = [parts_of(t) for t in texts]
    uses = [word_use(p) for p in parts]
    df = Counter(w for u in uses for w in u)
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, n in df.items() if n >= least_docs))}
    y = np.array(levels, dtype=float)
    words = SYNTAX + len(vocabulary)
    x = np.zeros((len(texts), words + COMPONENTS))
    for i, (p, u) in enumerate(zip(parts, uses)):
        x[i, :SYNTAX] = syntax(p)
        for w, v in u.items():
            if w in vocabulary:
                x[i, SYNTAX + vocabulary[w]] = v
        x[i, words:] = (bucket_shares(p) - components.mean) @ components.axes
    spread = lambda k: x[:, k].std(axis=0)
    scale = np.concatenate([spread(slice(SYNTAX)) + 1e-6, np.full(len(vocabulary), WORD_SCALE), spread(slice(words, None)) / COMPONENT_WEIGHT + 1e-6])
    x /= scale
    w = _rank(x, y, rounds, l2, seed)
    fold = np.random.default_rng(seed).permutation(len(y)) % min(FOLDS, len(y))
    unseen = np.zeros(len(y))
    for k in range(fold.max() + 1):
        rest = fold != k
        unseen[~rest] = x[~rest] @ _rank(x[rest], y[rest], rounds, l2, seed)
    xs, ys = isotonic(unseen, y)
    w = w / scale
    buckets = components.axes @ w[words:]
    return Ranker(w[:SYNTAX], dict(zip(vocabulary, w[SYNTAX:words].tolist())), xs, ys, buckets, -float(components.mean @ buckets))


def joint_use(documents: DataFrame, least_words: int = 40) -> Components:
    """The vocabulary components of all documents that get a level.

    Every task sums its documents' shares and products of shares; a few megabytes a task are
    added up, block by block, and a matrix of fixed size reaches the driver.
    """
    rows = _levelled(documents, least_words).select("text")
    step = BUCKETS // BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, moments = 0, np.zeros(BUCKETS), np.zeros((BUCKETS, BUCKETS))
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if enough_words(t, least_words)]
            for at in range(0, len(texts), 500):
                x = np.stack([bucket_shares(parts_of(t)) for t in texts[at : at + 500]]).astype(np.float32)
                n, sums = n + len(x), sums + x.sum(axis=0)
                moments += x.T @ x
        if n:
            # Products are symmetric: a block holds its rows from the diagonal on.
            cut = [np.concatenate([[n] if k == 0 else [0.0], sums[k * step : (k + 1) * step], moments[k * step : (k + 1) * step, k * step :].ravel()]).astype(np.float32) for k in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary())], names=["block", "sums"])

    def add(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.float32).astype(np.float64) for c in f["sums"])
        return pd.DataFrame({"block": [key[0]], "sums": [total.tobytes()]})

    n, sums, moments = 0.0, np.zeros(BUCKETS), np.zeros((BUCKETS, BUCKETS))
    for r in rows.mapInArrow(run, "block int, sums binary").groupBy("block").applyInPandas(add, "block int, sums binary").collect():
        v, k = np.frombuffer(r["sums"]), r["block"] * step
        n += v[0]
        sums[k : k + step] = v[1 : 1 + step]
        moments[k : k + step, k:] = v[1 + step :].reshape(step, -1)
    upper = np.triu(moments)
    return Components.of(n, sums, upper + np.triu(upper, 1).T)


def graded(documents: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """Texts and levels of at most ``MOST_LABELS`` labelled documents, drawn by the hash of their id."""
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    rows = (
        documents.select("doc_id", "text")
        .join(F.broadcast(labels.select("doc_id", "reading_level").where("reading_level is not null").orderBy(*order).limit(MOST_LABELS)), "doc_id")
        .where("length(trim(text)) > 0")
        .orderBy(*order)
        .limit(MOST_LABELS)
        .collect()
    )
    return [r["text"] for r in rows], [int(r["reading_level"]) for r in rows]


def enough_words(text: str, least_words: int) -> bool:
    return len(re.findall(r"[^ \t\n\r]+", text)) >= least_words


def _levelled(documents: DataFrame, least_words: int) -> DataFrame:
    lang = F.lower("lang")
    return documents.where(lang.startswith("it") | lang.startswith("en")).where(F.length("text") >= 2 * least_words - 1)


def reading_levels(documents: DataFrame, ranker: Ranker, least_words: int = 40) -> DataFrame:
    """(doc_id, reading_level, score) of every document of enough words in Italian or English."""
    rows = _levelled(documents, least_words).select("doc_id", "text")
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, levels, scores = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if enough_words(t, least_words):
                    s = ranker.score(t)
                    ids.append(i), scores.append(s), levels.append(ranker.level(s))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(levels, pa.int32()), pa.array(scores, pa.float64())], names=["doc_id", "reading_level", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, reading_level int, score double")


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return reading_levels(documents, fit_ranker(*graded(documents, table(spark, sf_dir, "reading_labels")), joint_use(documents)))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_levels(spark, sf_dir).select("doc_id", "reading_level")


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each level by category, to profile and filter the knowledge base."""
    levels = p9_levels(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "category")
    return levels.join(docs, "doc_id").groupBy("category", "reading_level").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {"p9_found": p9_found, "p9_levels": p9_levels, "p9_profile": p9_profile}
ORACLES: dict[str, str] = {}
