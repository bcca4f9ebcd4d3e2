"""Neighbourhood-mean graph network over face adjacency, with given weights.

A layer is relu(mean of neighbours @ neigh + bias + own @ self), the last one without relu. Faces
without neighbours have mean 0. Whole parts meet once, faces with pairs of faces, and run through all
layers in Arrow batches, over one block-diagonal adjacency (rows of neighbours, compressed) a batch; of
tables clustered by part nothing is shuffled. Parts of more than ``GIANT_FACES`` faces run a layer at a
time, as joins and grouped means over (part, face).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import small
from ..functions.scalars import clamp01, face_feature_vector
from ..schemas import DEFECT_CLASSES
from .measures import GIANT_FACES
from .scores import heuristic_scores
from .topology import edge_index, face_adjacency


@dataclass(frozen=True)
class Params:
    """Layers of (neigh, bias, self); heads of (weights, bias)."""

    layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    refine: tuple[np.ndarray, float]
    complexity: tuple[np.ndarray, float]
    defect: tuple[np.ndarray, np.ndarray]


def neighbour_mean(x: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """(part_id, face_index, x, mean): the mean of each position is an aggregate of its own, so nothing is exploded."""
    near = edges.join(x.select("part_id", F.col("face_index").alias("src"), "x"), ["part_id", "src"])
    means = near.groupBy("part_id", F.col("dst").alias("face_index")).agg(F.array(*[F.avg(F.col("x")[i]) for i in range(width)]).alias("mean"))
    return x.join(means, ["part_id", "face_index"], "left")


def _apply(rows: DataFrame, function, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield function(batch)

    return rows.mapInPandas(run, schema)


def _matrix(column, width: int) -> np.ndarray:
    return np.stack([np.zeros(width) if v is None else np.asarray(v, np.float64) for v in column])


EMBEDDED = "part_id long, face_index int, x array<double>"
HEADS = "refinement_prob double, complexity_score double"


def _heads(e: np.ndarray, params: Params) -> dict[str, np.ndarray]:
    sig = lambda w: 1 / (1 + np.exp(-(e @ w[0] + w[1])))
    return {"refinement_prob": sig(params.refine), "complexity_score": sig(params.complexity)}


def _layered(features: DataFrame, adjacency: DataFrame, params: Params, heads: bool) -> DataFrame:
    """A layer at a time: joins and grouped means, for parts of any size."""
    edges = edge_index(adjacency)
    x = features.select("part_id", "face_index", F.col("features").alias("x"))
    for i, (neigh, bias, own) in enumerate(params.layers):
        last = i == len(params.layers) - 1

        def layer(batch, neigh=neigh, bias=bias, own=own, last=last):
            out = _matrix(batch["mean"], len(neigh)) @ neigh + bias + _matrix(batch["x"], len(own)) @ own
            got = {"part_id": batch["part_id"], "face_index": batch["face_index"], "x": list(out if last else np.maximum(out, 0))}
            return pd.DataFrame(got | (_heads(out, params) if last and heads else {}))

        x = _apply(neighbour_mean(x, edges, len(neigh)), layer, f"{EMBEDDED}, {HEADS}" if last and heads else EMBEDDED)
    return x


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths of the lists of a column and their values in a row; null lists are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lengths, column.flatten()


def neighbour_rows(owner: np.ndarray, face: np.ndarray, pair_owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours, ends): places of the neighbours of each face, one face after the other, and where each one's end.

    Faces are in order of (owner, face); pairs with a face that is not there are left out.
    """
    span = int(max(face.max(initial=0), a.max(initial=0), b.max(initial=0))) + 1
    keys = owner * span + face
    at = [np.minimum(np.searchsorted(keys, pair_owner * span + end), max(len(keys) - 1, 0)) for end in (a, b)]
    there = (keys[at[0]] == pair_owner * span + a) & (keys[at[1]] == pair_owner * span + b) if len(keys) else np.zeros(len(a), bool)
    src, dst = np.concatenate([at[0][there], at[1][there]]), np.concatenate([at[1][there], at[0][there]])
    order = np.argsort(dst, kind="stable")
    return src[order], np.cumsum(np.bincount(dst, minlength=len(keys)))


def all_layers(x: np.ndarray, neighbours: np.ndarray, ends: np.ndarray, params: Params) -> np.ndarray:
    """Embeddings of all faces of a batch."""
    count = np.diff(ends, prepend=0)
    some = np.flatnonzero(count)
    starts = (ends - count)[some]
    for i, (neigh, bias, own) in enumerate(params.layers):
        mean = np.zeros_like(x)
        if len(some):
            mean[some] = np.add.reduceat(x[neighbours], starts, axis=0) / count[some, None]
        x = mean @ neigh + bias + x @ own
        if i < len(params.layers) - 1:
            x = np.maximum(x, 0)
    return x


def _wide(values: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(values).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)


def _batched(features: DataFrame, adjacency: DataFrame, params: Params, output: str, at_once: int = 100_000) -> DataFrame:
    """All layers in one pass over whole parts; ``output``: faces, faces with heads, or the mean of each part."""
    width = len(params.layers[0][0])
    one = F.struct("face_index", F.col("features").cast("array<double>").alias("features"))
    faces = features.groupBy("part_id").agg(F.array_sort(F.collect_list(one), lambda a, b: a["face_index"] - b["face_index"]).alias("faces"))
    pairs = adjacency.groupBy("part_id").agg(F.collect_list(F.struct("face_a", "face_b")).alias("pairs"))
    rows = faces.join(pairs, "part_id", "left").select("part_id", "faces", "pairs")

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ends, first = np.cumsum(_lists(batch.column(1))[0]), 0
        while first < len(batch):
            stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + at_once)))
            yield batch.slice(first, stop - first)
            first = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in parts(whole)):
            n_faces, flat = _lists(batch.column(1))
            n_pairs, pairs = _lists(batch.column(2))
            index, vectors = flat.field(0), flat.field(1)
            x = np.zeros((len(flat), width))
            given = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
            x[given] = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            owner = np.repeat(np.arange(len(batch)), n_faces)
            face = index.to_numpy(zero_copy_only=False).astype(np.int64)
            ends = [pairs.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2)]
            out = all_layers(x, *neighbour_rows(owner, face, np.repeat(np.arange(len(batch)), n_pairs), *ends), params)
            if output == "parts":
                starts = np.cumsum(n_faces) - n_faces
                mean = np.add.reduceat(out, starts, axis=0) / n_faces[:, None]  # a part here has a face
                yield pa.RecordBatch.from_arrays([batch.column(0), _wide(mean)], names=["part_id", "x"])
                continue
            columns = {"part_id": batch.column(0).take(pa.array(owner)), "face_index": pa.array(face.astype(np.int32)), "x": _wide(out)}
            if output == "heads":
                columns |= {k: pa.array(v) for k, v in _heads(out, params).items()}
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, {"faces": EMBEDDED, "heads": f"{EMBEDDED}, {HEADS}", "parts": "part_id long, x array<double>"}[output])


def _by_size(features: DataFrame, adjacency: DataFrame, giant: int):
    """(features, adjacency) of the parts that a task may read whole, and of the others where there are any."""
    big = features.groupBy("part_id").agg(F.count("*").alias("n")).filter(F.col("n") > giant).select("part_id").persist()
    n = big.count()
    if not n:
        big.unpersist()
        return (features, adjacency), None
    ids = small(big, n)
    side = lambda how: tuple(df.join(ids, "part_id", how) for df in (features, adjacency))
    return side("left_anti"), side("left_semi")


def sage_forward(features: DataFrame, adjacency: DataFrame, params: Params, heads: bool = False, giant: int = GIANT_FACES) -> DataFrame:
    """(part_id, face_index, x): embeddings of faces from (part_id, face_index, features); with ``heads``
    the probabilities of ``face_heads`` come along, from the same pass."""
    rest, giants = _by_size(features, adjacency, giant)
    out = _batched(*rest, params, "heads" if heads else "faces")
    return out.unionByName(_layered(*giants, params, heads)) if giants else out


def part_means(features: DataFrame, adjacency: DataFrame, params: Params, giant: int = GIANT_FACES) -> DataFrame:
    """(part_id, x): the mean embedding of each part's faces, in the pass that makes them."""
    rest, giants = _by_size(features, adjacency, giant)
    out = _batched(*rest, params, "parts")
    return out.unionByName(_pooled(_layered(*giants, params, False), params)) if giants else out


def face_heads(x: DataFrame, params: Params) -> DataFrame:
    """(part_id, face_index, refinement_prob, complexity_score)."""
    heads = lambda batch: pd.DataFrame({"part_id": batch["part_id"], "face_index": batch["face_index"]} | _heads(_matrix(batch["x"], len(params.refine[0])), params))
    return _apply(x, heads, f"part_id long, face_index int, {HEADS}")


def _pooled(x: DataFrame, params: Params) -> DataFrame:
    return x.groupBy("part_id").agg(F.array(*[F.avg(F.col("x")[i]) for i in range(len(params.defect[0]))]).alias("x"))


def graph_head(x: DataFrame, params: Params) -> DataFrame:
    """(part_id, defect, confidence, probs) from the mean embedding of a part's faces: of ``part_means``, or of faces."""
    pooled = _pooled(x, params) if "face_index" in x.columns else x

    def head(batch):
        z = _matrix(batch["x"], len(params.defect[0])) @ params.defect[0] + params.defect[1]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return pd.DataFrame({"part_id": batch["part_id"], "p": list(p)})

    out = _apply(pooled, head, "part_id long, p array<double>")
    names = F.array(*map(F.lit, DEFECT_CLASSES))
    best = F.array_position("p", F.array_max("p")).cast("int")
    return out.select("part_id", F.element_at(names, best).alias("defect"), F.array_max("p").alias("confidence"), F.map_from_arrays(names, "p").alias("probs"))


def learned_scores(x: DataFrame, dim: int = 128) -> DataFrame:
    """(part_id, face_index, score, embedding): the mean of both heads, which ``x`` has along; embeddings padded or cut."""
    padded = F.slice(F.concat("x", F.array_repeat(F.lit(0.0), dim)), 1, dim)
    score = clamp01(0.5 * F.col("refinement_prob") + 0.5 * F.col("complexity_score"))
    return x.select("part_id", "face_index", score.alias("score"), padded.alias("embedding"), F.lit("learned").alias("score_source"), F.lit(True).alias("weights_loaded"))


def score_faces(t, params: Params | None = None) -> DataFrame:
    """Learned scores where weights are given, else the heuristic; both say where they come from."""
    adjacency = face_adjacency(t.coedges)
    if params is None:
        return heuristic_scores(t.faces, adjacency)
    x = sage_forward(face_feature_vector(t.faces).select("part_id", "face_index", "features"), adjacency, params, heads=True)
    return learned_scores(x).drop("embedding")
