"""Benchmark decontamination with spaced seeds.

A seed mask fixes which words of a short window count and which are ignored, so a window still
matches when an ignored word was replaced. Seeds of the benchmark items are joined with those of
every position of every text; around each hit the item is laid over the text along that diagonal,
and a stretch of it must hold at least ``min_words`` equal words and ``min_share`` of its words; of
such stretches the one with the most equal words is given. The masks hit every such stretch.

Words are runs of letters and digits after lower-casing and dropping other signs. An item of fewer
than ``min_words`` words must occur as a whole.

Defined cases: null or empty texts and items overlap with nothing; null ids are kept as they are
(each row is judged by its own text); repeated rows are judged alike; an empty benchmark finds
nothing; extra columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, lean, stored, table

#: 1: the word counts; 0: it is ignored.
MASKS = ("111111", "11011011", "1110010011", "110100111", "10101010101", "1100110011", "11101011")
OVERLAPS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("words", T.LongType()), T.StructField("matched", T.LongType())]))
#: Characters of benchmark text in one index; a larger benchmark is searched in several passes.
INDEX_CHARS = 1 << 22


def word_lists(texts) -> pa.ListArray:
    """The words of each text; they may include empty strings, which are no words."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pN\s\pZ]+", "")
    return pc.utf8_split_whitespace(plain)


def offsets_of(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


class SeedIndex:
    """Seeds of benchmark items: (hash, item, position), sorted, with a bit table in front."""

    def __init__(self, items: list[tuple[int | None, str | None]], masks=MASKS, min_words: int = 10, min_share: float = 0.8):
        self.min_words, self.min_share = min_words, min_share
        self.names = [i for i, _ in items]
        lists = word_lists(pa.array([t for _, t in items], pa.string()))
        words = [[w for w in x if w] for x in lists.to_pylist()]
        self.vocabulary = pa.array(sorted({w for x in words for w in x}), pa.string())
        number = {w: i + 1 for i, w in enumerate(self.vocabulary.to_pylist())}
        self.items = [np.array([number[w] for w in x], np.int64) for x in words]
        short = sorted({len(x) for x in self.items if 0 < len(x) < max(map(len, masks))})
        self.masks = [offsets_of(m) for m in masks] + [list(range(n)) for n in short if n < 6]
        self.factors = np.random.default_rng(7).integers(1, 1 << 62, 64, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        hashes, item, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, x in enumerate(self.items):
            for m, mask in enumerate(self.masks):
                h = self.seeds(x, m)
                if len(h):
                    hashes.append(h)
                    item.append(np.full(len(h), k))
                    at.append(np.arange(len(h)))
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.at = h[order], np.concatenate(item)[order], np.concatenate(at)[order]
        self.bits = min(26, max(16, int(len(h) * 16).bit_length()))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.hash >> np.uint64(64 - self.bits)] = True

    def seeds(self, ids: np.ndarray, m: int) -> np.ndarray:
        """The hash of mask m at each position where it fits."""
        mask = self.masks[m]
        n = len(ids) - mask[-1]
        if n <= 0:
            return np.zeros(0, np.uint64)
        ids = ids.astype(np.uint64)
        out = np.full(n, m + 1, np.uint64) * self.factors[0]
        for i, o in enumerate(mask):
            out += ids[o : o + n] * self.factors[i + 1]
        return (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)

    def hits(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Distinct (text, item, diagonal) of seed hits in concatenated texts."""
        found = [np.zeros((0, 3), np.int64)]
        for m, mask in enumerate(self.masks):
            h = self.seeds(ids, m)
            p = np.flatnonzero(self.seen[h >> np.uint64(64 - self.bits)])
            if not len(p):
                continue
            h = h[p]
            lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            text = np.searchsorted(ends, p, "right")
            ok = (hi > lo) & (p + mask[-1] < ends[np.minimum(text, len(ends) - 1)])
            p, lo, n, text = p[ok], lo[ok], (hi - lo)[ok], text[ok]
            each = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            found.append(np.stack([np.repeat(text, n), self.item[each], np.repeat(p, n) - self.at[each]], 1))
        return np.unique(np.concatenate(found), axis=0)

    def verified(self, ids: np.ndarray, start: int, end: int, item: int, diagonal: int) -> tuple[int, int, int] | None:
        """(first word in the text, words, equal words) of the best stretch, if it is an overlap."""
        x = self.items[item]
        need = min(self.min_words, len(x))
        lo, hi = max(start, diagonal), min(end, diagonal + len(x))
        equal = np.append(0, np.cumsum(ids[lo:hi] == x[lo - diagonal : hi - diagonal]))
        if equal[-1] < need:
            return None
        spare = equal - self.min_share * np.arange(len(equal))
        # from each start, the furthest end up to which the share holds; then both ends shrink to equal words
        reach = np.maximum.accumulate(spare[::-1])
        last = np.searchsorted(equal, equal[len(equal) - 1 - np.searchsorted(reach, spare - 1e-9)])
        first = np.searchsorted(equal, equal, "right") - 1
        best = int(np.argmax((equal[last] - equal) * len(equal) - (last - first)))  # most equal words, then shortest
        first, last, equal = int(first[best]), int(last[best]), int(equal[last[best]] - equal[best])
        return (lo + first - start, last - first, equal) if equal >= need else None

    def overlaps(self, texts) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        if not len(self.hash):
            return out
        lists = word_lists(texts)
        flat, cuts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        words = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        cuts = np.append(0, np.cumsum(words))[cuts]
        coded = flat.dictionary_encode()
        ids = pc.fill_null(pc.index_in(coded.dictionary, self.vocabulary), -1).to_numpy() + 1
        ids = ids[coded.indices.to_numpy()][words].astype(np.int64)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for text, item, diagonal in self.hits(ids, cuts[1:]).tolist():
            got = self.verified(ids, int(cuts[text]), int(cuts[text + 1]), item, diagonal)
            if got and got[2] > best.get((text, item), (0, 0, 0))[2]:
                best[text, item] = got
        for (text, item), (first, n, equal) in best.items():
            out[text].append({"item_id": self.names[item], "first_word": first, "words": n, "matched": equal})
        return out


def slices(batch: pa.RecordBatch, column: str, at_once: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes in a column."""
    n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, first = np.cumsum(n), 0
    while first < len(batch):
        stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + at_once)))
        yield batch.slice(first, stop - first)
        first = stop


def with_overlaps(docs: DataFrame, benchmark: DataFrame, column: str = "overlaps", **options) -> DataFrame:
    """The documents with a column of their overlaps with benchmark items, at most one an item.

    A column that the documents have under that name is an error.

    The benchmark is read to the driver and sent out in parts of about ``INDEX_CHARS`` characters,
    each searched against all documents in a pass of its own; usually there is one part.
    """
    if column != free_name(docs, column):
        raise ValueError(f"the documents have a column {column} already")
    spark, items = docs.sparkSession, benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = chars // INDEX_CHARS + 1
    out = docs.withColumn(column, F.array().cast(OVERLAPS))
    for part in range(parts):
        rows = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        sent = spark.sparkContext.broadcast([tuple(r) for r in rows.collect()])  # at most INDEX_CHARS characters, more or less

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = SeedIndex(sent.value, **options)
            for whole in batches:
                for batch in slices(whole, "text"):
                    kind = batch.schema.field(column).type
                    old = batch.column(column).to_pylist()
                    new = pa.array([a + b for a, b in zip(old, index.overlaps(batch.column("text")))], kind)
                    yield batch.set_column(batch.schema.get_field_index(column), pa.field(column, kind), new)

        out = out.mapInArrow(lean(run), out.schema)
        if part < parts - 1:
            out = stored(out, "overlaps")  # one index in memory at a time
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without overlaps, each row judged by its own text."""
    column = free_name(docs, "overlaps")
    return with_overlaps(docs, benchmark, column, **options).filter(F.size(column) == 0).drop(column)


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that overlap."""
    found = with_overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("overlaps").alias("o")).select("doc_id", "o.*")
