"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Golden-ratio points run through the cumulative target shares, so that every stretch of the
schedule holds each source in proportion. The slots of a source are ranked; its documents, in a
hashed order, form a circular stream of words that is cut into as many equal blocks as the source
has slots; slot ``r`` plays block ``r``.

Defined cases: null text has size 0; a null source is a source of its own, ranked last; null and
repeated ids are ordinary rows; a source without words has target 0; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_hash, small, stored, table

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = (math.sqrt(5) - 1) / 2


def source_targets(sizes: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, repeat: float = 2.0) -> DataFrame:
    """(source_rank, source, source_size, weight, target) from rows (source, source_size).

    Sources by code point, null last, take the weights in turn. The level at which weight x level
    sums to the wanted words, each source stopping at ``repeat`` x its size, is found with prefix
    sums over the sources sorted by the level at which they stop. One row per source passes here.
    """
    ranked = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    w = sizes.withColumn("source_rank", F.row_number().over(ranked).cast("long"))
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int")))
    w = w.withColumns({"cap": F.col("source_size") * F.lit(float(repeat)), "wanted": F.sum("source_size").over(everything) * F.lit(float(share))})
    w = w.withColumn("stop", F.col("cap") / F.col("weight"))
    order = Window.orderBy("stop", "source_rank")
    w = w.withColumn("stopped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("level", (F.col("wanted") - F.col("stopped")) / F.col("rest"))
    w = w.withColumn("at", F.max(F.when(F.col("level") <= F.col("stop"), F.col("level"))).over(everything))
    target = F.when(F.col("at").isNull() | (F.col("stop") < F.col("at")), F.col("cap")).otherwise(F.col("weight") * F.col("at"))
    return w.select("source_rank", "source", "source_size", "weight", target.alias("target"))


def slot_schedule(targets: DataFrame, slots: int = 1 << 17, chunk: int = 512, cells: int = 1024) -> DataFrame:
    """(slot, source_rank, rank): golden-ratio points mapped through cumulative shares, ranked per source.

    Points and shares meet in an equi-join on cells of the unit interval. Ranks are prefix counts
    over chunks of the schedule plus a row number inside a chunk, so that no task holds all the
    slots of one source. A source with a target but no point gets one slot at the end.
    """
    spark = targets.sparkSession
    order = Window.orderBy("source_rank")
    parts = targets.filter(F.col("words") > 0).withColumn("all", F.sum("words").over(Window.partitionBy()))
    parts = parts.withColumn("hi", F.sum("words").over(order) / F.col("all"))
    parts = parts.withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0)))
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1))
    spans = parts.select("source_rank", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 0.5) * F.lit(GOLDEN)).alias("x"))
    points = points.select("slot", (F.col("x") - F.floor("x")).alias("u"))
    points = points.withColumn("cell", cell(F.col("u")))
    hit = points.join(spans, "cell").filter((F.col("u") >= F.col("lo")) & ((F.col("u") < F.col("hi")) | ((F.col("hi") >= 1) & (F.col("lo") < 1))))
    hit = hit.select("slot", "source_rank", F.floor(F.col("slot") / chunk).alias("chunk"))
    sums = hit.groupBy("source_rank", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source_rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("source_rank", "chunk", F.coalesce(before, F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("source_rank", "chunk").orderBy("slot"))
    ranked = hit.withColumn("inner", inner).join(sums, ["source_rank", "chunk"])
    ranked = ranked.select("slot", "source_rank", (F.col("before") + F.col("inner") - 1).alias("rank"))
    missed = parts.join(hit.select("source_rank").distinct(), "source_rank", "left_anti")
    return ranked.unionByName(missed.select((F.lit(slots) + F.col("source_rank")).alias("slot"), "source_rank", F.lit(0).cast("long").alias("rank")))


def _plan(docs: DataFrame, weights, share, repeat, slots, seed) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their place in their source's stream; the targets; the schedule."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = stored(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("mixed")), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(per_source, weights, share, repeat)
    words = F.least(F.round("target"), F.col("source_size") * F.lit(float(repeat))).cast("long")
    targets = stored(targets.withColumn("words", words), "mix-targets")
    schedule = stored(slot_schedule(targets, slots), "mix-slots")
    played = targets.join(schedule.groupBy("source_rank").agg(F.count("*").alias("n_slots")), "source_rank", "left")
    buckets = max(16, math.isqrt(sized.count()))
    keyed = sized.join(small(played), sized["source"].eqNullSafe(played["source"])).drop(played["source"])
    keyed = keyed.withColumn("bucket", F.pmod("mixed", F.lit(buckets)))
    sums = keyed.groupBy("source_rank", "bucket").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source_rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("source_rank", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inside = Window.partitionBy("source_rank", "bucket").orderBy("mixed", "doc_id", "size")
    placed = keyed.withColumns({"nth": F.row_number().over(inside), "upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    placed = placed.join(sums, ["source_rank", "bucket"])
    return placed.withColumn("offset", F.col("before") + F.col("upto") - F.col("size")).drop("before", "upto"), targets, schedule


def _pieces(placed: DataFrame, repeat: float) -> DataFrame:
    """One row per document, pass over its source and block that the document has words in."""
    # whole numbers: words of a mix times slots must stay below 2**63
    cut = lambda i: F.expr(f"(({i}) * words + n_slots - 1) div n_slots")
    block = lambda p: F.expr(f"(({p}) * n_slots) div nullif(words, 0)")
    passes = F.transform(F.sequence(F.lit(0), F.lit(max(1, math.ceil(repeat)) - 1)), lambda e: F.struct(e.alias("turn"), (e * F.col("source_size") + F.col("offset")).alias("first")))
    rows = placed.withColumn("turn", F.explode(passes)).select("*", "turn.first", F.col("turn.turn").alias("epoch")).drop("turn")
    rows = rows.withColumn("last", F.least(F.col("first") + F.col("size"), F.coalesce("words", F.lit(0))))
    span = F.when(F.col("last") > F.col("first"), F.sequence(block("first"), block("last - 1")))
    rows = rows.withColumn("rank", F.explode_outer(span))
    took = F.least(F.col("last"), cut("rank + 1")) - F.greatest(F.col("first"), cut("rank"))
    return rows.withColumn("took", F.greatest(F.coalesce(took, F.lit(0)), F.lit(0)).cast("long"))


def mix_sources(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, repeat: float = 2.0, slots: int = 1 << 17, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, first_slot, copies.

    ``taken`` counts the words that the scheduled blocks take, repeats counted; ``first_slot`` is
    the earliest slot that plays part of the document (null if none); ``copies`` is the number of
    passes that take at least half of it.
    """
    placed, _, schedule = _plan(docs, weights, share, repeat, slots, seed)
    pieces = _pieces(placed, repeat)
    played = pieces.join(schedule, ["source_rank", "rank"], "left")
    taken = F.when(F.col("slot").isNotNull(), F.col("took")).otherwise(0)
    key = ["source_rank", "bucket", "nth", "doc_id", "mixed", "source", "size", "source_size", "target"]
    each = played.groupBy(*key, "epoch").agg(F.sum(taken).alias("part"), F.min(F.when(taken > 0, F.col("slot"))).alias("slot"))
    whole = F.sum(F.when((F.col("size") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0))
    out = each.groupBy(*key).agg(F.sum("part").alias("taken"), F.min("slot").alias("first_slot"), whole.alias("copies"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot", "copies", "mixed")


def mixed_documents(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mix as documents, each as often as its source's passes take at least half of it.

    Rows that repeat both id and text are played together: one row stands for them, the first by
    a hash of all its columns.
    """
    row = docs.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("mixed"), row_hash(docs).alias("order"), F.struct(*docs.columns).alias("row"))
    once = row.groupBy("id", "mixed").agg(F.min_by("row", "order").alias("row"))
    copies = mix_sources(docs, seed=seed, **options).groupBy("doc_id", "mixed").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    copies = copies.withColumnsRenamed({"doc_id": "other_id", "mixed": "other"})
    joined = once.join(copies, (once["mixed"] == copies["other"]) & once["id"].eqNullSafe(copies["other_id"]))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of the mix of all documents."""
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot", "copies")
