"""Chunked document indexes and cosine search."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import scratch
from ..functions.scalars import l2_normalize

# Where sentences end, and the sizes of chunks.
SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z(])")
LEAST, MOST = 200, 1500


def split_sentences(text: str, most: int = MOST) -> list[str]:
    """A text of at most ``most`` characters as it is; a longer one as runs of sentences, cut hard where a sentence is longer."""
    if len(text) <= most:
        return [text] if text else []
    done = [""]
    for s in SENTENCE_END.split(text):
        if done[-1] and len(done[-1]) + 1 + len(s) <= most:
            done[-1] += " " + s
        else:
            done += [s[i : i + most] for i in range(0, len(s), most)]
    return [x for x in done if x]


def pack_paragraphs(text: str, least: int = LEAST, most: int = MOST, paragraph: str = r"\n\s*\n") -> list[str]:
    """Chunks of a page: paragraphs gather until there are ``least`` characters; what has gathered is cut at sentence ends to ``most``."""
    groups: list[str] = []
    for piece in (p.strip() for p in re.split(paragraph, text or "")):
        if piece and groups and len(groups[-1]) < least:
            groups[-1] += "\n\n" + piece
        elif piece:
            groups.append(piece)
    return [chunk for group in groups for chunk in split_sentences(group, most)]


def chunk_documents(pages: DataFrame, least: int = LEAST, most: int = MOST, paragraph: str = r"\n\s*\n") -> DataFrame:
    """(source, page, chunk_id, text): chunks of every page, numbered from 0 over the pages of a source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            chunks = [pack_paragraphs(t, least, most, paragraph) for t in batch["text"]]
            n = [len(c) for c in chunks]
            if not sum(n):
                continue
            yield pd.DataFrame({"source": np.repeat(batch["source"].to_numpy(object), n), "page": np.repeat(batch["page"].to_numpy(), n), "pos": [i for k in n for i in range(k)], "text": np.array([c for x in chunks for c in x], object)}, dtype=object)

    rows = pages.select("source", F.col("page").cast("long").alias("page"), "text").mapInPandas(run, "source string, page long, pos long, text string")
    return number_chunks(rows)


def number_chunks(rows: DataFrame) -> DataFrame:
    """chunk_id from 0 in the order of page and position: counts per page give each page's first number."""
    per = rows.groupBy("source", "page").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("source", "page", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(per, ["source", "page"]).select("source", "page", (F.col("before") + F.col("pos")).alias("chunk_id"), "text")


def drop_blank(df: DataFrame) -> DataFrame:
    return df.filter(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)


def hash_embedding(text: str, dim: int):
    """One-hot at the sum of code points modulo dim: an embedder for tests, without Python. A text is read once."""
    at = F.aggregate(F.split(F.col(text), ""), F.lit(0).cast("long"), lambda a, x: a + F.ascii(x)) % dim  # an empty piece counts 0
    places = F.array(*[F.lit(float(i == dim - 1)) for i in range(2 * dim - 1)])
    return F.slice(places, (dim - at).cast("int"), dim)


@dataclass(frozen=True)
class Embedder:
    """A model for texts: ``load`` makes the function from a list of texts to rows of ``dim`` numbers.

    It is called once in a worker process, whatever the number of batches and tasks that come there;
    ``name`` tells models apart and is noted in the index.
    """

    load: Callable[[], Callable[[list[str]], np.ndarray]]
    dim: int
    name: str


_LOADED: dict[str, Callable[[list[str]], np.ndarray]] = {}


def loaded(model: Embedder) -> Callable[[list[str]], np.ndarray]:
    """The model's function in this process."""
    if model.name not in _LOADED:
        _LOADED[model.name] = model.load()
    return _LOADED[model.name]


def embedder(model: Embedder):
    """A column function from texts to their embeddings; missing texts count as empty."""

    @F.pandas_udf("array<double>")
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = loaded(model)
        for texts in batches:
            rows = np.asarray(embed(texts.fillna("").tolist()), np.float64).reshape(len(texts), -1)
            if len(rows) and rows.shape[1] != model.dim:
                raise ValueError(f"{model.name} says {model.dim} dimensions and gave {rows.shape[1]}")
            yield pd.Series(list(rows))

    return column


def build_index(chunks: DataFrame, embed: Embedder | None = None, dim: int = 8, model: str = "hash") -> tuple[DataFrame, DataFrame]:
    """Chunks with unit embeddings, and one row of facts about the index."""
    rows = drop_blank(chunks)
    vector = embedder(embed)(F.col("text")) if embed else hash_embedding("text", dim)
    rows = rows.withColumn("embedding", vector).withColumn("embedding", l2_normalize("embedding"))  # in a column of its own, made once and read several times
    name, dim = (embed.name, embed.dim) if embed else (model, dim)
    return rows, rows.agg(F.lit(name).alias("model"), F.lit(dim).alias("dim"), F.count("*").alias("n_chunks"))


#: Bytes of query vectors that are sent out at once, and queries that are scored at once.
SENT_BYTES, SCORED = 64 << 20, 1024


def _nearest(score: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by key."""
    if len(score) > 4 * k:
        near = np.flatnonzero(score >= np.partition(score, -k)[-k])
        return near[np.lexsort((keys[near], -score[near]))[:k]]
    return np.lexsort((keys, -score))[:k]


def _best_of(ids: list, queries: np.ndarray, k: int):
    """A task's k best chunks of each query, over all its batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        for batch in batches:
            if not len(batch) or not len(ids):
                continue
            vectors, keys = np.stack([np.asarray(v, np.float64) for v in batch["embedding"]]), batch["key"].to_numpy(np.int64)
            for first in range(0, len(ids), SCORED):
                for i, row in enumerate(queries[first : first + SCORED] @ vectors.T, first):
                    top = _nearest(row, keys, k)
                    scores, named = np.append(best[i][0], row[top]), np.append(best[i][1], keys[top])
                    keep = np.lexsort((named, -scores))[:k]
                    best[i] = (scores[keep], named[keep])
        n = [len(s) for s, _ in best]
        if sum(n):
            scores, named = (np.concatenate([x[j] for x in best]) for j in range(2))
            yield pd.DataFrame({"query_id": np.repeat(np.asarray(ids), n), "key": named, "score": scores})

    return run


def search(queries: DataFrame, chunks: DataFrame, k: int = 3, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(query_id, rank, key, score): the k most similar chunks (key, embedding) of each query (query_id, embedding).

    The stated queries go out in blocks of so many bytes to where the chunks are; a task keeps k candidates a
    query, and one shuffle by query ranks them. One block is one plan; of more, each is a job of its own that
    adds its candidates to a table of the shared folder. Unit vectors; equal scores rank by key.
    """
    spark, k = queries.sparkSession, max(1, k)
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    blocks = max(1, -(-size["n"] * (size["dim"] or 1) * 8 // sent_bytes))
    slim, kind = chunks.select(F.col("key").cast("long").alias("key"), "embedding"), "query_id long, key long, score double"

    def candidates(part: DataFrame) -> DataFrame:
        rows = part.select("query_id", "embedding").collect()  # a block of the stated queries
        return slim.mapInPandas(_best_of([r[0] for r in rows], np.array([r[1] for r in rows], np.float64), k), kind)

    if blocks == 1:
        found = candidates(queries)
    else:
        path = scratch(spark, "candidates")
        for b in range(blocks):
            part = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
            candidates(part).write.mode("append").parquet(path)
        found = spark.read.schema(kind).parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def search_status(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, status): ok, empty_query or no_index."""
    empty = chunks.limit(1).count() == 0
    blank = F.length(F.trim(F.coalesce("query", F.lit("")))) == 0
    return queries.select("query_id", F.when(blank, "empty_query").when(F.lit(empty), "no_index").otherwise("ok").alias("status"))
