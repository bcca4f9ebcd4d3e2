"""N-gram Jaccard join by chosen paths.

A text is the set of its shingles (five words; a shorter text is one shingle of all its words).
Texts with equal sets form a class, joined once. In each of several runs a class chooses, on every
level, the shingles whose hash for that run and level falls below 1 / (threshold x set size), about
1 / threshold of them; classes that chose a common shingle meet in a bucket. A bucket of at most
``leaf`` classes is compared pair by pair; a larger one is split by the next level's choices. A
bucket that the next level does not split (most of it is one group of near copies), or that the last
level leaves large, is compared exactly in blocks, so no bucket is cut short and no task holds more
than two blocks. The chance that a pair at the threshold meets in one run is 1 - 1/e at least, so
``runs`` repeats reach the target recall.

A pair counts only in the smallest bucket that holds it, which both sides know from their lists of
buckets; so pairs need not be emitted to be counted once. First only these lists travel, then the
shingle sets of the classes that have a pair to compare, to the buckets where they have one. Tasks
return counts of links and spanning links, and the components of these give a text its class id.

Defined cases: null texts and texts without words link with nothing; rows with a null id link with
nothing but count as copies; repeated rows are copies of each other; texts that share an id
share one class id; an empty table gives an empty result; extra columns are ignored, or pass
through the filter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, row_hash, small, stored, table
from .components import components
from .decontaminate import slices

WORDS = 5
#: Levels of choices that a class brings along.
LEVELS = 3
#: Classes in a block of a large bucket, at most (about: they are dealt by a hash).
BLOCK = 512


def runs_for(recall: float, meet: float = 1 - math.exp(-1), levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold, split ``levels`` times, was together with this chance."""
    return math.ceil(math.log(1 - recall) / math.log(1 - meet**levels))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of all texts, concatenated, and where each text's begin."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat, cuts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    real = pc.not_equal(flat, "")
    cuts = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))[cuts]
    coded = flat.filter(real).dictionary_encode()
    h = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    h = h[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    n = np.diff(cuts)
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        rolled = _mixed(rolled + h[k : k + len(rolled)] + np.uint64(k + 1))
    out, ends = [], [0]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a >= words:
            s = np.sort(rolled[a : b - words + 1])
            s = s[np.append(True, s[1:] != s[:-1])]
        else:
            s = np.zeros(min(1, b - a), np.uint64)
            for k in range(a, b):
                s = _mixed(s + h[k] + np.uint64(100 + b - a))
        out.append(s)
        ends.append(ends[-1] + len(s))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array(ends, np.int64)


def set_keys(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set: 128 bits that name it."""
    keys = []
    for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        total = np.append(np.uint64(0), np.cumsum(_mixed(flat * np.uint64(salt | 1) + np.uint64(salt >> 7))))
        keys.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
    return keys[0], keys[1]


def chosen_paths(flat: np.ndarray, ends: np.ndarray, threshold: float, runs: int) -> list[list[list[int]]]:
    """For each set, run and level (run-major): the shingles that it chooses."""
    n = np.diff(ends)
    with np.errstate(divide="ignore"):
        limit = np.minimum(2.0**32 - 1, 2.0**32 / (threshold * n)).astype(np.uint64)
    limit, owner = np.repeat(limit, n), np.repeat(np.arange(len(n)), n)
    out: list[list[list[int]]] = [[] for _ in range(len(n))]
    signed = flat.view(np.int64)
    rng = np.random.default_rng(17)
    for _ in range(runs * LEVELS):
        factor, shift = rng.integers(1, 1 << 62, 2, np.int64).astype(np.uint64)
        hit = np.flatnonzero(((flat + shift) * (factor * np.uint64(2) + np.uint64(1))) >> np.uint64(32) < limit)
        at = np.searchsorted(owner[hit], np.arange(len(n) + 1))
        picked = signed[hit].tolist()
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            out[i].append(picked[a:b])
    return out


FACTS = "doc_id long, mark long, n long, k1 long, k2 long, chosen array<array<long>>"


def text_facts(docs: DataFrame, threshold: float, runs: int) -> DataFrame:
    kind = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("chosen", pa.list_(pa.list_(pa.int64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                flat, ends = shingle_sets(batch.column("text"))
                k1, k2 = set_keys(flat, ends)
                chosen = chosen_paths(flat, ends, threshold, runs)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(np.diff(ends)), pa.array(k1), pa.array(k2), pa.array(chosen, kind.field("chosen").type)], schema=kind)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").mapInArrow(lean(run), FACTS)


def buckets(classes: DataFrame, leaf: int) -> DataFrame:
    """(key, cid, size): the buckets in which classes (cid, chosen) meet and are to be compared."""
    runs = classes.select("cid", F.posexplode("chosen").alias("at", "picked")).filter(F.col("at") % LEVELS == 0)
    level = runs.select("cid", "at", F.explode("picked").alias("shingle")).select("cid", "at", F.xxhash64("at", "shingle").alias("key"))
    done = None
    for depth in range(1, LEVELS + 1):
        sizes = stored(level.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), f"sizes{depth}")
        met = stored(level.join(small(sizes), "key"), f"buckets{depth}")
        ready = met.filter(F.col("size") <= leaf)
        large = met.filter(F.col("size") > leaf)
        if depth == LEVELS or not large.limit(1).count():
            ready = met
        else:
            picks = classes.select("cid", "chosen")
            split = large.join(picks, "cid").select("cid", F.col("key").alias("parent"), F.col("size").alias("of"), (F.col("at") + 1).alias("at"), F.col("chosen")[F.col("at") + 1].alias("picked"))
            split = stored(split.select("cid", "parent", "of", "at", F.explode("picked").alias("shingle")).withColumn("key", F.xxhash64("parent", "shingle")).drop("shingle"), f"split{depth}")
            # buckets of which half stays together on the next level are one group of near copies
            parts = split.groupBy("parent", "key").agg(F.count("*").alias("part"), F.any_value("of").alias("of"))
            dense = stored(parts.filter("2 * part > of").select(F.col("parent").alias("key")).distinct(), f"dense{depth}")
            ready = ready.unionByName(large.join(small(dense), "key", "left_semi"))
            level = split.join(small(dense.withColumnRenamed("key", "parent")), "parent", "left_anti").select("cid", "at", "key")
            done = ready if done is None else done.unionByName(ready)
            continue
        done = ready if done is None else done.unionByName(ready)
        break
    return stored(done.select("key", "cid", "size"), "buckets")


def blocked(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Deal large buckets into blocks; a member goes to every pair of blocks that its own is in (x <= y)."""
    parts = F.ceil(F.col("size") / block)
    own = F.pmod(F.xxhash64("cid", "key"), parts)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    out = members.withColumns({"parts": parts, "own": own}).withColumn("other", other)
    return out.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("parts", "other")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], heavy: str | None = None) -> Iterator[pd.DataFrame]:
    """Runs of rows with equal keys in sorted batches; a run may go on in the next batch. Batches are taken in
    parts by the bytes of their ``heavy`` column."""
    rest: pd.DataFrame | None = None
    for batch in (part for whole in batches for part in (slices(whole, heavy, 4_000_000) if heavy else [whole])):
        rows = batch.to_pandas()
        if rest is not None:
            rows = pd.concat([rest, rows], ignore_index=True)
        if not len(rows):
            continue
        changed = np.zeros(len(rows), bool)
        changed[0] = True
        for k in keys:
            v = rows[k].to_numpy()
            changed[1:] |= v[1:] != v[:-1]
        start = np.flatnonzero(changed)
        for a, b in zip(start[:-1], start[1:]):
            yield rows.iloc[a:b]
        rest = rows.iloc[start[-1] :]
    if rest is not None and len(rest):
        yield rest


def own_pairs(group: pd.DataFrame) -> np.ndarray:
    """Which pairs of a bucket (or of two of its blocks) count here: no smaller common bucket."""
    key, x, y = int(group["key"].iloc[0]), group["x"].iloc[0], group["y"].iloc[0]
    n, own = len(group), group["own"].to_numpy()
    pairs = np.triu(np.ones((n, n), bool), 1)
    if x != y:
        pairs &= own[:, None] != own[None, :]
    lists = [v[v < key] for v in group["all"]]
    flat = np.concatenate(lists)
    who = np.repeat(np.arange(n), [len(v) for v in lists])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
    for a, b in zip(start, np.append(start[1:], len(flat))):
        if b - a > 1:
            pairs[np.ix_(who[a:b], who[a:b])] = False
    return pairs


def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members that have a pair to compare, bucket by bucket."""
    names, rows, n = ["key", "x", "y", "own", "cid"], [], 0
    kind = pa.schema([(c, pa.int64()) for c in names])
    for group in groups(batches, ["key", "x", "y"]):
        if len(group) < 2:
            continue
        pairs = own_pairs(group)
        keep = pairs.any(0) | pairs.any(1)
        if keep.any():
            rows.append(group.loc[keep, names])
            n += int(keep.sum())
        if n > 20_000:
            yield pa.RecordBatch.from_pandas(pd.concat(rows), kind, preserve_index=False)
            rows, n = [], 0
    if rows:
        yield pa.RecordBatch.from_pandas(pd.concat(rows), kind, preserve_index=False)


def common_counts(sets: list[np.ndarray], columns: int = 4_096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    n = len(sets)
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    first = np.append(True, flat[1:] != flat[:-1])
    shared = ~(first & np.append(first[1:], True))  # not alone
    column = np.cumsum(first[shared]) - 1
    who = who[shared]
    out = np.zeros((n, n), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [lo, lo + columns])
        m = np.zeros((n, min(columns, int(column[b - 1]) + 1 - lo)), np.float32)
        m[who[a:b], column[a:b] - lo] = 1
        out += m @ m.T
    return out


def compared(threshold: float):
    """(cid, links, root) of the members of buckets: links weighted by the copies of the other side."""
    kind = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for group in groups(batches, ["key", "x", "y"], "shingles"):
            group = group.drop_duplicates("cid")  # a repeated row brings its class twice
            if len(group) < 2:
                continue
            sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
            size = np.array([len(s) for s in sets], np.float64)
            common = common_counts(sets)
            link = own_pairs(group) & (common * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-6)
            if not link.any():
                continue
            both = link | link.T
            links, cid = both @ group["copies"].to_numpy(np.int64), group["cid"].to_numpy()
            root = cid.copy()
            while True:
                low = np.minimum(root, np.where(both, root[None, :], np.iinfo(np.int64).max).min(1))
                if (low == root).all():
                    break
                root = low
            keep = links > 0
            rows.append(pd.DataFrame({"cid": cid[keep], "links": links[keep], "root": root[keep]}))
            n += int(keep.sum())
            if n > 20_000:
                yield pa.RecordBatch.from_pandas(pd.concat(rows), kind, preserve_index=False)
                rows, n = [], 0
        if rows:
            yield pa.RecordBatch.from_pandas(pd.concat(rows), kind, preserve_index=False)

    return run


WANTED = "array<struct<key:bigint,x:bigint,y:bigint,own:bigint>>"


def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of texts that are needed; rows whose set is not the class's are left out."""
    for whole in batches:
        for batch in slices(whole, "text", 2_000_000):
            flat, ends = shingle_sets(batch.column("text"))
            k1, k2 = set_keys(flat, ends)
            sets = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            same = (k1 == batch.column("k1").to_numpy()) & (k2 == batch.column("k2").to_numpy())
            out = pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("copies"), batch.column("wanted"), batch.column("all"), pa.array(sets, pa.binary())], ["cid", "copies", "wanted", "all", "shingles"])
            yield out.filter(pa.array(same))


def near_copies(docs: DataFrame, threshold: float = 0.8, recall: float = 0.99, leaf: int = 128) -> DataFrame:
    """doc_id, class_id, n_links, kept of every row of (doc_id, text).

    ``class_id`` is the smallest id reachable by links (a null id for rows with a null id);
    ``n_links`` counts the other rows with similarity ``threshold`` or more, exact copies included;
    ``kept`` marks the rows whose id is their class id.
    """
    return _classed(docs, threshold, recall, leaf).drop("mark")


def _classed(docs: DataFrame, threshold: float, recall: float, leaf: int) -> DataFrame:
    """The same, with a hash of the text beside the id."""
    runs = runs_for(recall)
    facts = stored(text_facts(docs, threshold, runs), "facts")
    some = facts.filter("n > 0")
    classes = some.groupBy("k1", "k2").agg(F.min("doc_id").alias("cid"), F.count("*").alias("copies"), F.any_value("chosen").alias("chosen"))
    classes = stored(classes.filter("cid is not null"), "classes")
    members = buckets(classes, leaf)
    lists = stored(members.groupBy("cid").agg(F.collect_list("key").alias("all")), "lists")  # some per run
    dealt = blocked(members).join(lists, "cid").select("key", "x", "y", "own", "cid", "all")
    wanted = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(lean(needed), "key long, x long, y long, own long, cid long")
    wanted = wanted.groupBy("cid").agg(F.collect_list(F.struct("key", "x", "y", "own")).alias("wanted"))
    wanted = stored(wanted.join(lists, "cid").join(classes.drop("chosen"), "cid"), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("cid"), "text").join(wanted, "cid")
    texts = texts.select("cid", "text", "copies", "wanted", "all", "k1", "k2")
    sets = texts.mapInArrow(lean(with_sets), f"cid long, copies long, wanted {WANTED}, all array<bigint>, shingles binary")
    spread = sets.select("cid", "copies", "all", "shingles", F.explode("wanted").alias("w")).select("w.*", "cid", "copies", "all", "shingles")
    links = spread.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(lean(compared(threshold)), "cid long, links long, root long")
    links = stored(links, "links")
    reach = components(links.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    reach = reach.join(links.groupBy("cid").agg(F.sum("links").alias("links")).withColumnRenamed("cid", "node"), "node", "left")
    known = stored(classes.select("k1", "k2", "cid", "copies").join(reach, F.col("cid") == F.col("node"), "left").select("k1", "k2", "copies", F.coalesce("component", "cid").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")), "reach")
    slim = facts.select("doc_id", "mark", "n", "k1", "k2")
    linked = slim.filter("n > 0 and doc_id is not null").join(known, ["k1", "k2"]).select("doc_id", "mark", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    alone = slim.filter("n = 0 or doc_id is null").select("doc_id", "mark", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def without_near_copies(docs: DataFrame, threshold: float = 0.8, recall: float = 0.99, leaf: int = 128) -> DataFrame:
    """One document of each class: the one with the smallest id. Rows with a null id stay.

    Of rows that repeat an id and a text one stays, the first by a hash of all its columns; a text
    that an id has besides is a document of its own.
    """
    kept = _classed(docs, threshold, recall, leaf).filter("kept and doc_id is not null").select(F.col("doc_id").alias("id"), "mark").distinct()
    row = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("mark"), row_hash(docs).alias("order"), F.struct(*docs.columns).alias("row"))
    one = row.join(kept, ["id", "mark"], "left_semi").groupBy("id", "mark").agg(F.min_by("row", "order").alias("row"))
    return one.select("row.*").unionByName(docs.filter("doc_id is null"))


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))
