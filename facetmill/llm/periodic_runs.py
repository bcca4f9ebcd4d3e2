"""Runs (maximal periodicities) over the words of a text, by suffix trees.

Ukkonen's suffix trees of the words and of their reversal answer, through range minima over their
Euler tours, how far two places agree to the right and to the left in constant time. Every run has a
root that is the longest Lyndon word at its place under the order of words or under the opposite one
(the next smaller suffix ends it), so two candidates a place, each extended both ways, find all runs.

Trees are built where a run can be: each word of a run of 12 words or more lies in a six-word window
that its text holds twice, so all else is cut away first, exactly. Stretches of several texts share a
tree, with separators of their own between them.

Defined results: a null text has no words; a null doc_id repeats nothing; rows are independent, so
repeated ids give a row each. Memory follows the longest stretch of one text (about 0.5 KB a word).
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table
from .decontaminate import slices

LEAST, WINDOW = 12, 6  # a run has at least LEAST words, so it repeats WINDOW of them
AT_ONCE = 50_000
FIELDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class SuffixTree:
    """Ukkonen's tree of whole numbers below ``size``; the last one occurs once."""

    def __init__(self, s: list[int], size: int):
        n = len(s)
        first, last, link, depth, suffix = [0], [0], [0], [0], [-1]
        child: dict[int, int] = {}
        get = child.get
        node = edge = length = left = 0
        for i, c in enumerate(s):
            need = -1
            left += 1
            while left:
                if not length:
                    edge = i
                key = node * size + s[edge]
                below = get(key)
                if below is None:
                    child[key] = len(first)
                    first.append(i), last.append(n), link.append(0), depth.append(n - i + left - 1), suffix.append(i - left + 1)
                    if need >= 0:
                        link[need] = node
                        need = -1
                else:
                    span = last[below] - first[below]
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    f = first[below]
                    if s[f + length] == c:
                        length += 1
                        if need >= 0:
                            link[need] = node
                        break
                    inner = len(first)
                    first.append(f), last.append(f + length), link.append(0), depth.append(left - 1), suffix.append(-1)
                    first.append(i), last.append(n), link.append(0), depth.append(n - i + left - 1), suffix.append(i - left + 1)
                    child[key] = inner
                    child[inner * size + c] = inner + 1
                    first[below] = f + length
                    child[inner * size + s[f + length]] = below
                    if need >= 0:
                        link[need] = inner
                    need = inner
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        self.n, self.size = n, size
        keys = np.fromiter(child.keys(), np.int64, len(child))
        nodes = np.fromiter(child.values(), np.int64, len(child))
        self.parent = np.zeros(len(first), np.int64)
        self.parent[nodes] = keys // size
        self.letter = np.zeros(len(first), np.int64)
        self.letter[nodes] = keys % size
        self.depth, self.suffix = np.array(depth, np.int64), np.array(suffix, np.int64)

    def tour(self, letter: np.ndarray) -> np.ndarray:
        """Nodes in the order of a walk that takes children in the order of ``letter``."""
        order = np.lexsort((-letter, self.parent))
        order = order[order != 0]  # the root is nobody's child
        at = np.searchsorted(self.parent[order], np.arange(len(self.parent) + 1)).tolist()
        kids = order.tolist()
        stack, walk = [0], []
        pop, push, note = stack.pop, stack.extend, walk.append
        while stack:
            v = pop()
            note(v)
            push(kids[at[v] : at[v + 1]])  # the smallest comes last, so it is next
        return np.array(walk, np.int64)

    def ranks(self, walk: np.ndarray) -> np.ndarray:
        """The place of each suffix among the leaves of a walk."""
        leaves = self.suffix[walk]
        leaves = leaves[leaves >= 0]
        rank = np.empty(self.n, np.int64)
        rank[leaves] = np.arange(self.n)
        return rank

    def common(self, walk: np.ndarray) -> RangeMinima:
        """Depths of the lowest common ancestors of neighbouring leaves: minima over the walk between them."""
        up = self.depth[self.parent[walk]]
        leaf = np.flatnonzero(self.suffix[walk] >= 0)
        return RangeMinima(np.minimum.reduceat(up, np.append(0, leaf[:-1] + 1)))


class RangeMinima:
    """Minima of ranges of an array in constant time each."""

    def __init__(self, values: np.ndarray):
        self.rows = [values.astype(np.int32)]
        k = 1
        while 2 * k <= len(values):
            row = self.rows[-1]
            self.rows.append(np.minimum(row[: len(row) - k], row[k:]))
            k *= 2

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minima over (min, max] of the two places, which differ."""
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            m = level == k
            row = self.rows[k]
            out[m] = np.minimum(row[lo[m]], row[hi[m] - (1 << int(k))])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix the next one that is smaller (the number of suffixes where there is none)."""
    ranks, n = rank.tolist(), len(rank)
    out, stack = [n] * n, []
    for i in range(n - 1, -1, -1):
        r = ranks[i]
        while stack and ranks[stack[-1]] > r:
            stack.pop()
        if stack:
            out[i] = stack[-1]
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(pieces: list[np.ndarray], least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(piece, start, length, period) of all runs of at least ``least`` and two periods, in order of these."""
    marks = len(pieces) + 1  # separators before, between and after the pieces, smaller than all words
    words, dense = np.unique(np.concatenate(pieces), return_inverse=True)
    size = marks + len(words)
    lengths = np.array([len(p) for p in pieces], np.int64)
    begin = np.cumsum(lengths + 1) - lengths  # of each piece in the whole
    s = np.empty(int(lengths.sum()) + marks, np.int64)
    s[np.append(begin - 1, len(s) - 1)] = np.arange(marks)
    inside = s_mask(len(s), begin, lengths)
    s[inside] = dense + marks
    m = len(s)
    tree = SuffixTree(s.tolist(), size)
    walk = tree.tour(tree.letter)
    rank, right = tree.ranks(walk), tree.common(walk)
    turned = np.where(tree.letter < marks, tree.letter, size + marks - tree.letter)
    opposite = tree.ranks(tree.tour(turned))
    del tree, walk
    back = SuffixTree(s[::-1].tolist(), size)
    walk = back.tour(back.letter)
    back_rank, left = back.ranks(walk), back.common(walk)
    del back, walk
    places = np.flatnonzero(inside)
    i = np.concatenate([places, places])
    j = np.concatenate([next_smaller(rank)[places], next_smaller(opposite)[places]])
    on = right.between(rank[i], rank[j])
    before = left.between(back_rank[m - i], back_rank[m - j])  # of i - 1 and j - 1
    period, start, length = j - i, i - before, before + (j - i) + on
    good = length >= np.maximum(least, 2 * period)
    found = np.unique(np.stack([start[good], period[good], length[good]], 1), axis=0)
    start, period, length = found.T
    piece = np.searchsorted(begin, start, "right") - 1
    return piece, start - begin[piece], length, period


def s_mask(n: int, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which places hold words."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def stretches(ids: np.ndarray, starts: np.ndarray, window: int = WINDOW, least: int = LEAST) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of texts that are covered by windows which their text holds twice."""
    n = len(ids)
    if n < least:
        return []
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    text = np.searchsorted(starts, np.arange(n), "right").astype(np.uint64)
    key = text[: n - window + 1] * np.uint64(0xD6E8FEB86659FD93)
    for k in range(window):
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : n - window + 1 + k]
    whole = text[: n - window + 1] == text[window - 1 :]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)  # equal by chance only adds a stretch
    again = np.flatnonzero((counts[inverse] > 1) & whole)
    edge = np.zeros(n + 1, np.int64)
    edge[again] += 1
    edge[again + window] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    fresh = np.zeros(n, bool)
    fresh[starts[starts < n]] = True
    begins = np.flatnonzero(covered & (fresh | ~np.append(False, covered[:-1])))
    ends = np.flatnonzero(covered & np.append(fresh[1:] | ~covered[1:], True)) + 1
    return [(b, e) for b, e in zip(begins.tolist(), ends.tolist()) if e - b >= least]


def repeated_words(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words after the contract's planted repetition, by the checksum of the id."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def found_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start, then period."""
    number: dict[bytes, int] = defaultdict(lambda: len(number))
    ids = np.array([number[w] for words in texts for w in words], np.int64)
    lengths = np.array([len(words) for words in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    group: list[tuple[int, int]] = []

    def flush() -> None:
        if not group:
            return
        piece, start, length, period = runs_of([ids[b:e] for b, e in group])
        at = np.array([b for b, _ in group], np.int64)[piece] + start
        owner = np.searchsorted(starts + lengths, at, "right")
        for o, s, n, p in zip(owner.tolist(), (at - starts[owner]).tolist(), length.tolist(), period.tolist()):
            out[o].append((s, n, p))
        group.clear()

    size = 0
    for b, e in stretches(ids, starts):
        if size + e - b > AT_ONCE:
            flush()
            size = 0
        group.append((b, e))
        size += e - b
    flush()
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def digest(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The fields of a text: number of runs, the longest one, checksums of the runs and of the collapsed text."""
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    kept = words
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        kept = [w for w, d in zip(words, (np.cumsum(edge[:-1]) > 0).tolist()) if not d]
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    longest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def with_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """(doc_id, fields of ``digest``) of every text; ``planted``: repeat words by the id's checksum first."""
    names = ["doc_id", *(f.split(" ")[0] for f in FIELDS.split(", "))]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", 3_000_000):
                ids = part.column(0).to_pylist()
                texts = [(t or b"").split() for t in part.column(1).cast(pa.binary()).to_pylist()]  # bytes split at ASCII white space
                if planted:
                    texts = [repeated_words(w, i) for w, i in zip(texts, ids)]
                rows = [digest(w, r) for w, r in zip(texts, found_runs(texts))]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 5 + [pa.string()] * 2)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, {FIELDS}")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, after the contract's repetition."""
    return with_runs(table(spark, sf_dir, "documents"), planted=True)
