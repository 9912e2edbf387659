"""Near-duplicate texts by a token-group matrix: exact, without comparing all pairs.

A text is the set of its sequences of ``shingle`` consecutive words. Sets that agree are one
class, and only classes are compared.

* Sequences are ordered from rare to frequent by counts in a table of fixed size (2**22
  buckets over all rows). Two sets of the wanted similarity must share a sequence among the
  first ``(1 - threshold)`` part of both, so only these *leading* sequences are posted. Where
  the input has so many different sequences that they share buckets, the order is less sharp,
  not less right; a bucket counts as hot by what it holds more than the middle one.
* Classes with the same rarest shared sequence form a group of up to 64 similar classes. The
  matrix holds the union of each group's sequences as a bit row.
* Bit rows of long texts are up to eight times as long, or they would be full and bound nothing;
  two rows are compared at the length of the shorter one.
* A leading sequence brings groups together. For each class of one and the bit row of the
  other the overlap is bounded: a sequence whose bit is missing is surely not in the group.
  Only qualifying groups are opened, and their members bounded in the same way.
* What is left is compared exactly on the texts.

Hot groups and hot sequences are split by salt; copies are merged inside the tasks that read
them, before anything is shuffled. All bounds are upper bounds, so no link is lost. Pairs are
compared block by block: a text travels once for each block of its partners, not for each pair.

Null and empty texts, and texts with fewer than ``least_words`` words or than one sequence,
take part in nothing. Equal texts under different ids are copies. An empty table gives no rows.
"""

from __future__ import annotations

import math
import sys
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvina.operators.graph import connected_components
from corvina.session import table, written

BUCKET_BITS, BLOCKS = 22, 64
SKETCH_BITS = 320
#: Sequences that a bit row of that many bits serves; rows of longer texts are doubled, at most so often.
FULL_ROW, MOST_LEVELS = 200, 3
GROUP = 64
#: Rows of one group or sequence beyond which it is split.
HOT = 50_000
#: Postings that one task compares, pairs and characters of texts in one block of the last comparison.
PER_TASK = 1_000_000
#: Pairs of postings that are compared at once.
PAIRS_AT_ONCE = 200_000
PAIRS_PER_BLOCK, CHARS_PER_BLOCK = 100_000, 64_000_000
#: Sequences after a leading one are counted up to this many; it stands for any larger number too.
REST_OPEN = 65_535
#: Characters of texts that are hashed at once.
CHARS_AT_ONCE = 300_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * MIX[0]
    x ^= x >> np.uint64(32)
    x *= MIX[1]
    return x ^ (x >> np.uint64(29))


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: whether its small letter belongs to words, and that letter's number in their hashes."""
    small = [chr(c).lower()[0] for c in range(sys.maxunicode + 1)]
    return np.array([c.isalnum() for c in small]), _mixed(np.array([ord(c) for c in small]))


def _words(texts: list[str]) -> tuple[np.ndarray, list[int]]:
    """Hashes of the words of all texts, and where each text's words begin and the last one's end."""
    joined = "\x01".join(texts)
    if "\u0130" in joined or "\u03a3" in joined:  # the only letters whose small form is longer or depends on what is beside them
        joined = joined.lower()
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    of_word, number = _letters()
    inside = of_word[code]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False)).reshape(-1, 2)
    if not len(edge):
        return np.empty(0, np.uint64), [0] * (len(texts) + 1)
    cuts = np.searchsorted(edge[:, 0], np.flatnonzero(code == 1)).tolist()
    length = edge[:, 1] - edge[:, 0]
    first = _firsts(length)
    letters = number[code[inside]]
    # A letter counts by its place in the word, so the letters of all words are summed at once.
    letters *= (_mixed(np.arange(int(length.max())) + len(number)) | np.uint64(1))[np.arange(len(letters)) - np.repeat(first, length)]
    return _mixed(np.add.reduceat(letters, first)), [0, *cuts, len(edge)]


def shingle_sets(texts: list[str | None], shingle: int, least_words: int) -> list[np.ndarray | None]:
    """The sorted distinct sequence hashes of each text; None where a text takes no part."""
    clean = [(t.replace("\x01", " ") if "\x01" in t else t) if t else "" for t in texts]
    block = (np.cumsum([len(t) for t in clean], dtype=np.int64) // CHARS_AT_ONCE).tolist()
    out: list[np.ndarray | None] = []
    while len(out) < len(clean):
        h, ends = _words(clean[len(out) : bisect_right(block, block[len(out)])])
        n = len(h) - shingle + 1
        if n > 0:
            s = h[:n].copy()
            for j in range(1, shingle):
                s *= MIX[0]
                s ^= s >> np.uint64(31)
                s += h[j : n + j]
            s *= MIX[1]
            s ^= s >> np.uint64(29)
            s *= MIX[2]
            s ^= s >> np.uint64(32)
        for a, b in pairwise(ends):
            if b - a < max(least_words, shingle):
                out.append(None)
                continue
            x = np.sort(s[a : b - shingle + 1])
            new = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=new[1:])
            out.append(x[new])
    return out


def set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set; no set is empty."""
    if not sets:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    s = np.concatenate(sets)
    first = _firsts(np.array([len(x) for x in sets]))
    x = s * MIX[0]
    x ^= x >> np.uint64(32)
    y = (s ^ MIX[2]) * MIX[1]
    y ^= y >> np.uint64(31)
    return np.add.reduceat(x, first).view(np.int64), np.add.reduceat(y, first).view(np.int64)


def _firsts(times: np.ndarray) -> np.ndarray:
    """Where each part begins, of parts of these lengths."""
    return np.cumsum(times) - times


def _levels(n: np.ndarray) -> np.ndarray:
    """How often the bit row of a set of this size is doubled, so that those of long texts are not full."""
    return np.clip(np.ceil(np.log2(np.maximum(n, 1) / FULL_ROW)), 0, MOST_LEVELS).astype(np.int64)


def overlap_needed(a, b, threshold: float):
    """The least overlap of two sets of these sizes that reaches the threshold."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def _profile(rows: DataFrame, shingle: int, least_words: int) -> DataFrame:
    """Members (id, hash, size) and, in rows without an id, this task's bucket counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, dtype=np.int32)
        names = ["id", "hi", "lo", "n", "block", "counts"]
        for b in batches:
            sets = shingle_sets(b.column(1).to_pylist(), shingle, least_words)
            ids = [i for i, x in zip(b.column(0).to_pylist(), sets) if x is not None]
            sets = [x for x in sets if x is not None]
            hi, lo = set_hashes(sets)
            if sets:
                counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts)).astype(np.int32)
            k = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hi), pa.array(lo), pa.array([len(x) for x in sets], pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        parts = counts.reshape(BLOCKS, -1)
        used = [i for i in range(BLOCKS) if parts[i].any()]
        k = len(used)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=names)

    return rows.mapInArrow(run, "id bigint, hi bigint, lo bigint, n int, block int, counts binary")


def _bucket_counts(profile: DataFrame) -> np.ndarray:
    """The counts of all tasks added up: 2**22 numbers, whatever the input."""

    def add(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << BUCKET_BITS) // BLOCKS, dtype=np.int64)
        for c in f["counts"]:
            total += np.frombuffer(c, dtype=np.int32)
        return pd.DataFrame({"block": [key[0]], "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})

    summed = profile.where("block is not null").select("block", "counts").groupBy("block").applyInPandas(add, "block int, counts binary")
    out = np.zeros((BLOCKS, (1 << BUCKET_BITS) // BLOCKS), dtype=np.int32)
    for r in summed.collect():
        out[r["block"]] = np.frombuffer(r["counts"], dtype=np.int32)
    return out.reshape(-1)


class _Counts:
    """Counts of buckets; how often a sequence is split follows what its bucket has more than the middle one."""

    def __init__(self, freq: np.ndarray):
        self.freq, self.middle = freq, int(np.median(freq))
        self.shift = np.uint64(65 - len(freq).bit_length())

    def of(self, s: np.ndarray) -> np.ndarray:
        return self.freq[(s >> self.shift).astype(np.int64)]

    def splits(self, s: np.ndarray, hot: int) -> np.ndarray:
        return np.maximum(self.of(s).astype(np.int64) - self.middle, 0) // hot + 1


def _leading(rows: DataFrame, counts, shingle: int, least_words: int, threshold: float) -> DataFrame:
    """One row per class and task: group key, hash, size, bit row and leading sequences."""

    def rows_at_once(sets: list[np.ndarray], keys: list[tuple[int, int]], freq: _Counts, out: list[tuple]) -> None:
        size = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        width = SKETCH_BITS << _levels(size)
        row = _firsts(width)
        bits = np.zeros(int(width.sum()), np.uint8)
        bits[np.repeat(row, size) + ((every & np.uint64(0xFFFFFFFF)) % np.repeat(width, size).astype(np.uint64)).astype(np.int64)] = 1
        packed = np.packbits(bits).tobytes()
        row, width = (row // 8).tolist(), (width // 8).tolist()
        counted = freq.of(every)
        for i, (s, key, a) in enumerate(zip(sets, keys, _firsts(size).tolist())):
            f = counted[a : a + len(s)]
            lead = len(s) - math.ceil(threshold * len(s) - 1e-9) + 1
            order = np.argsort(f, kind="stable")[:lead]  # equal counts in the order of the hashes
            # A bucket counted once holds a sequence of this text alone.
            alone = f[order] <= 1
            tokens = s[order[~alone]]
            if not len(tokens):
                continue
            anchor = int(tokens[0].view(np.int64))
            salt = (key[1] & 0xFFFFFFFF) % int(freq.splits(tokens[:1], HOT)[0])
            out.append((anchor, salt, len(s), key[1], packed[row[i] : row[i] + width[i]], tokens.tobytes(), np.packbits(~alone).tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = counts.value
        seen: set[tuple[int, int]] = set()
        for b in batches:
            out: list[tuple] = []
            sets = [s for s in shingle_sets(b.column(0).to_pylist(), shingle, least_words) if s is not None]
            new, keys = [], []
            for s, key in zip(sets, zip(*(h.tolist() for h in set_hashes(sets)))):
                if key not in seen:
                    seen.add(key)
                    new.append(s), keys.append(key)
            for k in range(0, len(new), 1_000):
                rows_at_once(new[k : k + 1_000], keys[k : k + 1_000], freq, out)
            cols = list(zip(*out)) if out else [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["anchor", "salt", "n", "lo", "bits", "tokens", "places"])

    return rows.select("text").mapInArrow(run, "anchor bigint, salt int, n int, lo bigint, bits binary, tokens binary, places binary")


PACKED = "part int, token binary, holder binary, rest binary, sizes binary, lo binary, n binary, bits binary"


def _post(leading: DataFrame, counts, parts: int) -> DataFrame:
    """Group the classes and send each group to the tasks of its leading sequences, packed by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = counts.value
        for b in batches:
            groups: list[list[int]] = []
            at = None
            n, lo = b.column("n").to_numpy(), b.column("lo").to_numpy()
            anchor, salt = b.column("anchor").to_pylist(), b.column("salt").to_pylist()
            for i in range(b.num_rows):
                key = (anchor[i], salt[i])
                if key == at and n[i] == n[groups[-1][-1]] and lo[i] == lo[groups[-1][-1]]:
                    continue  # a copy that another task read
                if key != at or len(groups[-1]) >= GROUP or n[i] > 1.25 * n[groups[-1][0]]:
                    groups.append([])
                    at = key
                groups[-1].append(i)
            if not groups:
                continue
            tokens = [np.frombuffer(x, np.uint64) for x in b.column("tokens").to_pylist()]
            places = [np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8))) for x in b.column("places").to_pylist()]
            rests = [np.minimum(m - 1 - x, REST_OPEN).astype(np.uint16) for m, x in zip(n.tolist(), places)]
            bits = b.column("bits").to_pylist()
            t_all, r_all, g_all = [], [], []
            for g, members in enumerate(groups):
                if len(members) == 1:
                    t, r = tokens[members[0]], rests[members[0]]
                else:
                    t = np.concatenate([tokens[i] for i in members])
                    r = np.concatenate([rests[i] for i in members])
                    order = np.lexsort((r, t))
                    t, r = t[order], r[order]
                    last = np.append(t[1:] != t[:-1], True)
                    t, r = t[last], r[last]
                t_all.append(t), r_all.append(r), g_all.append(np.full(len(t), g, np.int32))
            t, r, g = np.concatenate(t_all), np.concatenate(r_all), np.concatenate(g_all)
            size = np.array([len(x) for x in groups], np.int32)
            first = np.append(0, np.cumsum(size)[:-1])
            member = np.array([i for x in groups for i in x])
            # A hot sequence is split: blocks of groups meet in pairs.
            blocks = freq.splits(t, HOT)
            key = t
            if (blocks > 1).any():
                cold = blocks == 1
                keys, holders, rest = [key[cold]], [g[cold]], [r[cold]]
                for k in np.flatnonzero(~cold):
                    m = int(blocks[k])
                    own = int(lo[groups[g[k]][0]]) % m
                    for other in range(m):
                        keys.append(np.array([(int(key[k]) * 1_000_003 + min(own, other) * 8191 + max(own, other) + 1) & (2**64 - 1)], np.uint64))
                        holders.append(g[k : k + 1]), rest.append(r[k : k + 1])
                key, g, r = np.concatenate(keys), np.concatenate(holders), np.concatenate(rest)
            part = ((key * MIX[0]) >> np.uint64(33)).astype(np.int64) % parts
            key = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)  # enough in one part; a key of two sequences only adds pairs to compare
            order = np.argsort(part, kind="stable")
            key, g, r, part = key[order], g[order], r[order], part[order]
            edges = np.searchsorted(part, np.arange(parts + 1))
            small = np.uint16 if len(groups) <= 2**16 else np.uint32  # told apart by length when read
            rows: list[tuple] = []
            for p in range(parts):
                a, z = edges[p], edges[p + 1]
                if a == z:
                    continue
                held, where = np.unique(g[a:z], return_inverse=True)
                own = np.concatenate([member[first[x] : first[x] + size[x]] for x in held])
                rows.append((p, key[a:z].tobytes(), where.astype(small).tobytes(), r[a:z].tobytes(), size[held].astype(np.uint8).tobytes(), lo[own].tobytes(), n[own].astype(np.int32).tobytes(), b"".join([bits[i] for i in own.tolist()])))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=[x.split()[0] for x in PACKED.split(", ")])

    placed = leading.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "n", "lo")
    return placed.mapInArrow(run, PACKED)


def _candidates(f: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Pairs of class hashes that pass all bounds, among the groups of one task."""
    key = np.frombuffer(b"".join(f["token"]), np.uint32)
    rest = np.frombuffer(b"".join(f["rest"]), np.uint16).astype(np.int64)
    size = np.frombuffer(b"".join(f["sizes"]), np.uint8).astype(np.int32)
    lo = np.frombuffer(b"".join(f["lo"]), np.int64)
    n = np.frombuffer(b"".join(f["n"]), np.int32)
    rows = np.frombuffer(b"".join(f["bits"]), np.uint64)
    level = _levels(n)
    row = _firsts((SKETCH_BITS // 64) << level)
    # wide[k]: rows of the classes that were doubled k times or more, folded to that length.
    held = [np.flatnonzero(level >= k) for k in range(int(level.max()) + 1)]
    wide = [np.empty((len(x), (SKETCH_BITS // 64) << k), np.uint64) for k, x in enumerate(held)]
    for c, x in enumerate(held):
        x = x[level[x] == c]
        own = rows[row[x][:, None] + np.arange((SKETCH_BITS // 64) << c)]
        for k in range(c + 1):
            wide[k][np.searchsorted(held[k], x)] = np.bitwise_or.reduce(own.reshape(len(x), 1 << (c - k), (SKETCH_BITS // 64) << k), axis=1)
    bits = wide[0]
    offsets = np.append(0, np.cumsum([len(x) for x in f["sizes"]])[:-1])
    holder = np.concatenate([np.frombuffer(x, np.uint16 if len(x) * 2 == len(k) else np.uint32).astype(np.int32) + np.int32(o) for x, k, o in zip(f["holder"], f["token"], offsets)])
    first = _firsts(size)
    union = np.ascontiguousarray(np.bitwise_or.reduceat(bits, first, axis=0).T)
    bits = np.ascontiguousarray(bits.T)
    least, most = np.minimum.reduceat(n, first), np.maximum.reduceat(n, first)
    share = threshold / (1 + threshold)

    order = np.lexsort((least[holder], key))
    key, holder, rest = key[order], holder[order], rest[order]
    small = least[holder]

    def partners(rest: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The largest partner that leaves enough overlap; a number of following sequences that did not fit bounds nothing."""
        return np.clip(np.floor(np.where(rest >= REST_OPEN, np.inf, (rest + 1 - share * of + 1e-9) / share)), 0, 2**31 - 1).astype(np.int32)

    slack = partners(rest, small)
    rank = (np.cumsum(np.append(True, key[1:] != key[:-1])) - 1) * 2**31
    # Partners come before a posting in its run, so only what bears one of its own size or more can be a partner.
    early = np.flatnonzero(slack >= small)
    before = np.searchsorted(early, np.arange(len(key)))
    early_rank, early_small, early_slack, early_holder = (rank + small)[early], small[early], slack[early], holder[early]
    early_large, early_union = most[early_holder], union[:, early_holder]
    # Each class of a posting is held against the groups of its partners, which are not much smaller either.
    times = size[holder]
    own = np.repeat(np.arange(len(key), dtype=np.int32), times)
    q = np.repeat(first[holder], times) + _ranges(times)
    low = np.searchsorted(early_rank, rank + np.ceil(threshold * small / 1.25 - 1e-9).astype(np.int64))[own]
    high = np.minimum(before[own], np.searchsorted(early_rank, rank[own] + partners(rest[own], n[q]), side="right"))
    todo = np.flatnonzero(high > low)
    q, low, width = q[todo], low[todo], (high - low)[todo]

    found: list[np.ndarray] = []

    def over(bits_a: np.ndarray, bits_b: np.ndarray, of_a, of_b, spare: np.ndarray) -> np.ndarray:
        """Places of the pairs in which no more than ``spare`` bits of a's row are surely missing in b's."""
        left, miss = np.arange(len(spare)), np.zeros(len(spare), np.int16)
        for k in range(len(bits_a)):
            miss += np.bitwise_count(of_a(bits_a[k], left) & ~of_b(bits_b[k], left))
            if k >= 2 or len(bits_a) == k + 1:  # before, few pairs are over
                ok = np.flatnonzero(miss <= spare)
                left, miss, spare = left[ok], miss[ok], spare[ok]
        return left

    def may_overlap(a: np.ndarray, b: np.ndarray, spare: np.ndarray, bits_b: np.ndarray = bits) -> np.ndarray:
        return over(bits, bits_b, lambda x, left: x[a[left]], lambda x, left: x[b[left]], spare)

    def open_groups(q: np.ndarray, group: np.ndarray) -> None:
        """q: classes; group: the groups whose members they are held against."""
        times = size[group]
        d = np.repeat(first[group], times) + _ranges(times)
        q = np.repeat(q, times)
        ok = (np.minimum(n[q], n[d]) >= threshold * np.maximum(n[q], n[d]) - 1e-9) & (lo[q] != lo[d])
        q, d = q[ok], d[ok]
        need = overlap_needed(n[q], n[d], threshold)
        ok = may_overlap(q, d, n[q] - need)
        q, d, need = q[ok], d[ok], need[ok]
        ok = may_overlap(d, q, n[d] - need)
        q, d, need = q[ok], d[ok], need[ok]
        common = np.minimum(level[q], level[d])
        ok = common == 0
        for k in range(1, len(wide)):
            x = np.flatnonzero(common == k)
            a, b = wide[k][np.searchsorted(held[k], q[x])], wide[k][np.searchsorted(held[k], d[x])]
            miss = [n[of[x]] - np.bitwise_count(i & ~o).sum(axis=1, dtype=np.int64) for of, i, o in ((q, a, b), (d, b, a))]
            ok[x] = np.minimum(*miss) >= need[x]
        x, y = lo[q[ok]], lo[d[ok]]
        found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))

    total = np.cumsum(width)
    at = 0
    while at < len(q):
        # Blocks of classes, as many pairs at a time as a core's cache holds; a longer row is cut too.
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        p, l, w = q[at:stop], low[at:stop], width[at:stop]
        at = stop
        for cut in range(0, int(w[0]) if len(p) == 1 else 1, PAIRS_AT_ONCE):
            w_now = np.minimum(w - cut, PAIRS_AT_ONCE) if len(p) == 1 else w
            j = np.repeat(l + cut - _firsts(w_now), w_now)
            j += np.arange(len(j))
            i = np.repeat(np.arange(len(p)), w_now)
            n_now = n[p][i]
            ok = np.flatnonzero((early_slack[j] >= n_now) & (early_large[j] >= threshold * n_now - 1e-9))
            i, j, n_now = i[ok], j[ok], n_now[ok]
            ok = over(bits[:, p], early_union, lambda x, left: x[i[left]], lambda x, left: x[j[left]], n_now - overlap_needed(n_now, early_small[j], threshold))
            open_groups(p[i[ok]], early_holder[j[ok]])
    inner = np.flatnonzero(size > 1)
    for k in range(0, len(inner), 20_000):
        g = inner[k : k + 20_000]
        a, b = np.repeat(first[g], size[g]) + _ranges(size[g]), np.repeat(g, size[g])
        ok = may_overlap(a, b, n[a] - overlap_needed(n[a], least[b], threshold), union)
        open_groups(a[ok], b[ok])
    pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    a, b = pairs[:, 0], pairs[:, 1]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    return pd.DataFrame({"lo_a": a[new], "lo_b": b[new]})


def _ranges(times: np.ndarray) -> np.ndarray:
    """0..t-1 for each t."""
    return np.arange(int(times.sum())) - np.repeat(_firsts(times), times)


def _verified(pairs: DataFrame, rows: DataFrame, shingle: int, least_words: int, threshold: float) -> DataFrame:
    """The pairs (lo_a, lo_b) of classes (id_a, lo_a, id_b, lo_b) whose texts reach the threshold, with their similarity.

    Partners b are placed in blocks of bounded size; one with very many pairs is in several.
    A task keeps the sets of one block and streams the other texts past them, each once a block.
    """
    per_b = pairs.groupBy("id_b", "lo_b").agg(F.ceil(F.count(F.lit(1)) / F.lit(PAIRS_PER_BLOCK)).cast("int").alias("splits"))
    chars = rows.select(F.col("id").alias("id_b"), F.length("text").alias("chars")).groupBy("id_b").agg(F.max("chars").alias("chars"))
    per_b = written(per_b.join(chars, "id_b"))
    total = per_b.agg(F.coalesce(F.sum(F.col("chars").cast("bigint") * F.col("splits")), F.lit(0)).alias("chars")).first()["chars"]
    blocks = max(1, math.ceil(total / CHARS_PER_BLOCK), math.ceil(pairs.count() / PAIRS_PER_BLOCK))
    block = lambda salt: F.pmod(F.xxhash64("lo_b", salt), F.lit(blocks)).cast("int").alias("block")
    held = per_b.select("id_b", "lo_b", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("salt")).select(F.col("id_b").alias("id"), F.col("lo_b").alias("lo"), block(F.col("salt"))).distinct()
    held = held.select("id", "lo", "block", F.lit(0).alias("side"), F.lit(None).cast("array<bigint>").alias("others"))
    past = pairs.join(per_b.select("lo_b", "splits"), "lo_b").select("id_a", "lo_a", "lo_b", block(F.pmod(F.xxhash64("lo_a"), "splits").cast("int")))
    past = past.groupBy(F.col("id_a").alias("id"), F.col("lo_a").alias("lo"), "block").agg(F.collect_set("lo_b").alias("others"))  # at most the classes of one block
    past = past.select("id", "lo", "block", F.lit(1).alias("side"), "others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets, met = None, {}, set()
        for batch in batches:
            out: list[tuple] = []
            own = shingle_sets(batch.column("text").to_pylist(), shingle, least_words)
            hashes = iter(set_hashes([s for s in own if s is not None])[1].tolist())
            for place, side, x, s, others in zip(*(batch.column(c).to_pylist() for c in ("block", "side", "lo")), own, batch.column("others").to_pylist()):
                if place != at:
                    at, sets, met = place, {}, set()
                if s is None or next(hashes) != x:
                    continue  # another text under the same id
                if side == 0:
                    sets[x] = s
                    continue
                if x in met:
                    continue  # the same text under the same id
                met.add(x)
                for y in others:
                    t = sets[y]
                    o = len(np.intersect1d(s, t, assume_unique=True))
                    out.append((x, y, o / (len(s) + len(t) - o)))
            cols = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["lo_a", "lo_b", "similarity"])

    placed = held.unionByName(past).join(rows, "id").select("block", "side", "lo", "text", "others").repartition(max(12, blocks), "block").sortWithinPartitions("block", "side")
    return placed.mapInArrow(run, "lo_a bigint, lo_b bigint, similarity double").where(F.col("similarity") >= threshold - 1e-9)


def near_duplicates(rows: DataFrame, id_col: str, text_col: str, shingle: int = 5, threshold: float = 0.8, least_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    members: (id, hi, lo, n): each row that takes part and its class (hi, lo).
    links: (hi_a, lo_a, hi_b, lo_b, similarity): every pair of classes that reaches the threshold.
    """
    if not 0 < threshold <= 1 or shingle < 1:
        raise ValueError("the threshold must be in (0, 1] and a sequence at least one word")
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    profile = written(_profile(rows, shingle, least_words))
    members = profile.where("id is not null").select("id", "hi", "lo", "n")
    freq = _bucket_counts(profile)
    counts = spark.sparkContext.broadcast(_Counts(freq))  # 16 MB, whatever the input
    parts = max(12, math.ceil(int(freq.sum(dtype=np.int64)) * (1 - threshold) / PER_TASK))
    posted = _post(_leading(rows, counts, shingle, least_words, threshold), counts, parts)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(frames)
        if held:
            yield _candidates(pd.concat(held), threshold)

    # One part a task: parts hold about as many postings each, so tasks are even.
    pairs = posted.repartitionById(parts, F.col("part")).mapInPandas(compare, "lo_a bigint, lo_b bigint").distinct()
    classes = members.groupBy("hi", "lo").agg(F.min("id").alias("id"))
    side = lambda s: classes.select(F.col("hi").alias(f"hi_{s}"), F.col("lo").alias(f"lo_{s}"), F.col("id").alias(f"id_{s}"))
    pairs = written(pairs.join(side("a"), "lo_a").join(side("b"), "lo_b"))
    checked = _verified(pairs.select("id_a", "lo_a", "id_b", "lo_b"), rows, shingle, least_words, threshold)
    links = written(checked.join(pairs, ["lo_a", "lo_b"]).select("hi_a", "lo_a", "hi_b", "lo_b", "similarity"))
    return members, links


def expanded_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs (id_a, id_b), id_a < id_b, that links and copies stand for."""
    side = lambda s: members.select(F.col("hi").alias(f"hi_{s}"), F.col("lo").alias(f"lo_{s}"), F.col("id").alias(f"id_{s}"))
    across = links.join(side("a"), ["hi_a", "lo_a"]).join(side("b"), ["hi_b", "lo_b"]).select("id_a", "id_b")
    copies = side("a").join(side("b"), (F.col("hi_a") == F.col("hi_b")) & (F.col("lo_a") == F.col("lo_b")) & (F.col("id_a") < F.col("id_b"))).select("id_a", "id_b")
    pairs = across.unionByName(copies).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return pairs.where("id_a <> id_b").distinct()  # an id may stand in several rows


def duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, group_id, copies, links): one row per member; groups are chains of links and copies.

    ``group_id`` is the least id of the group, ``copies`` the members with the same set and
    ``links`` the number of other classes that this member's class is linked with.
    """
    classes = members.groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    side = lambda s: classes.select(F.col("hi").alias(f"hi_{s}"), F.col("lo").alias(f"lo_{s}"), F.col("rep").alias(f"rep_{s}"))
    edges = written(links.join(side("a"), ["hi_a", "lo_a"]).join(side("b"), ["hi_b", "lo_b"]).select(F.col("rep_a").alias("src"), F.col("rep_b").alias("dst")))
    parts = connected_components(edges)
    degree = edges.select("src").unionAll(edges.select(F.col("dst").alias("src"))).groupBy("src").agg(F.count(F.lit(1)).alias("links"))
    per_class = classes.join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left").join(degree.withColumnRenamed("src", "rep"), "rep", "left")
    per_class = per_class.select("hi", "lo", F.coalesce("component", "rep").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(per_class, ["hi", "lo"]).select("id", "group_id", "copies", "links")


#: Fixed for this knowledge base (TESTDATA.md, p5).
CHUNKS = {"shingle": 3, "threshold": 0.6, "least_words": 60}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = expanded_pairs(*near_duplicates(table(spark, sf_dir, "chunks"), "chunk_id", "text", **CHUNKS))
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = duplicate_groups(*near_duplicates(table(spark, sf_dir, "chunks"), "chunk_id", "text", **CHUNKS))
    return groups.withColumnRenamed("id", "chunk_id")


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}
ORACLES = {
    "p5_found": r"""WITH w AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM chunks WHERE text IS NOT NULL),
s AS (SELECT DISTINCT chunk_id, hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS h FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 60)),
n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.chunk_id AS x, b.chunk_id AS y, count(*) AS o FROM s a JOIN s b ON a.h = b.h AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
SELECT x AS chunk_id_a, y AS chunk_id_b FROM o JOIN n p ON p.chunk_id = x JOIN n q ON q.chunk_id = y WHERE o >= 0.6e0 * (p.n + q.n - o) - 1e-9""",
}
