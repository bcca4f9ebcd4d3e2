"""Near-duplicate vectors by hierarchical navigable small-world graphs.

Vectors of a label are dealt into shards of at most about ``SHARD`` distinct vectors; a task builds
the graph of one shard. Every vector then queries every shard of its label, a block of queries and
one graph at a time: it descends to the nearest part of the graph with a beam, and from there walks
on through everything near the threshold, so a vector with thousands of links finds them all. Each
block audits some of its queries against brute force over the shard and widens the beam until they
agree in full; a block whose audit still fails at the widest beam is compared with the shard exactly.
Cosines are verified in double precision; components come from spanning links.

Exactly equal vectors are one node with a count, and vectors of one direction (to six places) share a
place in the graph, so copies and scaled copies neither crowd its links nor lose any.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, rows with a
null label and rows with a null id link with nothing; vectors of other lengths are never compared;
rows that repeat an id are counted as vectors of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored, table
from .components import components

#: Distinct vectors in a graph, and in a block of queries, at most (about: shards are dealt by a hash).
SHARD, BLOCK = 8192, 1024
#: Beams at which an audit may still fail before the block is compared exactly.
WIDEST = 1024
#: Tasks of one stage, at most; beyond that a task takes several graphs one after another.
MOST_TASKS = 20_000


class Graph:
    """A small-world graph over unit vectors; similarity is the dot product."""

    def __init__(self, x: np.ndarray, m: int = 12, beam: int = 64, links: list[np.ndarray] | None = None, entry: int = 0):
        self.x, self.m, self.n = x, m, len(x)
        self.seen, self.mark = np.zeros(self.n, np.int64), 0
        self.links, self.entry = links or [], entry
        if links is None:
            self._build(beam)
        # who links to a node: a crowded node may have dropped its link back
        to = self.links[0].ravel()
        order = np.argsort(to, kind="stable")[int((to < 0).sum()) :]
        self.from_flat = order // self.links[0].shape[1]
        self.from_count = np.bincount(to[order], minlength=self.n)
        self.from_start = np.cumsum(self.from_count) - self.from_count

    def _build(self, beam: int) -> None:
        u = np.random.default_rng(3).random(self.n)
        levels = np.minimum((-np.log(u) / np.log(self.m)).astype(np.int64), 6)
        self.links = [np.full((self.n, 2 * self.m if k == 0 else self.m), -1, np.int32) for k in range(int(levels.max(initial=0)) + 1)]
        top = int(levels[0]) if self.n else 0
        for i in range(1, self.n):
            q, at, level = self.x[i], [self.entry], int(levels[i])
            for k in range(top, level, -1):
                at = [self.search(q, at, 1, k)[0][1]]
            for k in range(min(top, level), -1, -1):
                found = self.search(q, at, beam, k)
                at = [j for _, j in found]
                own = self._spread(np.array([s for s, _ in found]), np.array(at), self.m)
                self.links[k][i, : len(own)] = own
                for j in own.tolist():
                    self._add(k, j, i)
            if level > top:
                top, self.entry = level, i

    def _spread(self, sims: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
        """The nearest, but first those that are nearer to the centre than to any chosen one. Sorted by similarity."""
        if len(ids) <= most:
            return ids
        between = self.x[ids] @ self.x[ids].T
        near = np.full(len(ids), -2.0, np.float32)
        chosen, rest = [], []
        for k in range(len(ids)):
            if sims[k] > near[k]:
                chosen.append(k)
                if len(chosen) == most:
                    break
                np.maximum(near, between[k], out=near)
            else:
                rest.append(k)
        return ids[(chosen + rest)[:most]]

    def _add(self, k: int, j: int, i: int) -> None:
        row = self.links[k][j]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = i
            return
        ids = np.append(row, i)
        sims = self.x[ids] @ self.x[j]
        order = np.argsort(-sims)
        row[:] = self._spread(sims[order], ids[order], len(row))

    def search(self, q: np.ndarray, at: list[int], beam: int, k: int) -> list[tuple[float, int]]:
        """The best ``beam`` nodes of level k, best first."""
        self.mark += 1
        self.seen[at] = self.mark
        first = [(float(self.x[j] @ q), j) for j in at]
        todo = [(-s, j) for s, j in first]
        best = first[:]
        heapq.heapify(todo)
        heapq.heapify(best)
        while len(best) > beam:
            heapq.heappop(best)
        links, seen, x = self.links[k], self.seen, self.x
        while todo:
            s, j = heapq.heappop(todo)
            if len(best) >= beam and -s < best[0][0]:
                break
            near = links[j]
            near = near[near >= 0]
            near = near[seen[near] != self.mark]
            if not len(near):
                continue
            seen[near] = self.mark
            for s, j in zip((x[near] @ q).tolist(), near.tolist()):
                if len(best) < beam:
                    heapq.heappush(best, (s, j))
                    heapq.heappush(todo, (-s, j))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, j))
                    heapq.heappush(todo, (-s, j))
        return sorted(best, reverse=True)

    def within(self, q: np.ndarray, least: float, beam: int, slack: float = 0.03) -> np.ndarray:
        """Nodes of similarity ``least`` or more that the beam and a walk from it through all nodes not far below reach."""
        at = [self.entry]
        for k in range(len(self.links) - 1, 0, -1):
            at = [self.search(q, at, 1, k)[0][1]]
        found = self.search(q, at, beam, 0)
        walk = np.array([j for s, j in found if s >= least - slack], np.int64)
        if not len(walk):
            return walk
        inside, links = [walk], self.links[0]
        seen = np.zeros(self.n, bool)
        seen[walk] = True
        while len(walk):
            near = links[walk].ravel()
            back = np.repeat(self.from_start[walk] - np.cumsum(self.from_count[walk]) + self.from_count[walk], self.from_count[walk])
            back = self.from_flat[back + np.arange(len(back))]
            near = np.unique(np.concatenate([near[near >= 0], back]))
            near = near[~seen[near]]
            seen[near] = True
            walk = near[self.x[near] @ q >= least - slack]
            inside.append(walk)
        inside = np.concatenate(inside)
        return inside[self.x[inside] @ q >= least]


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return (raw / np.linalg.norm(raw, axis=1, keepdims=True)).astype(np.float32)


def directions(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, place): the first vector of each direction, and which direction each vector has; to six places."""
    unit = raw / np.abs(raw).max(axis=1, keepdims=True)  # so that no norm over- or underflows
    unit = np.round(unit / np.linalg.norm(unit, axis=1, keepdims=True), 6) + 0.0
    _, first, place = np.unique(unit, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)  # directions in the order in which they come
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return first[order], rank[place.ravel()]


def build_graph(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One row: the shard's ids, counts, vectors, their directions and links between these, as bytes."""
    rows = rows.sort_values("node")
    raw = _matrix(rows["embedding"])
    first, place = directions(raw)
    graph = Graph(_unit(raw[first]))
    row = {
        "label": key[0], "dim": key[1], "shard": key[2], "blocks": rows["blocks"].iloc[0], "nodes": rows["node"].to_numpy(np.int64).tobytes(),
        "counts": rows["n"].to_numpy(np.int64).tobytes(), "vectors": raw.tobytes(), "firsts": first.astype(np.int64).tobytes(), "places": place.astype(np.int64).tobytes(),
        "links": b"".join(k.tobytes() for k in graph.links), "levels": len(graph.links), "entry": graph.entry,
    }
    return pd.DataFrame({k: [v] for k, v in row.items()})


GRAPH = (
    "label long, dim long, shard long, blocks long, nodes binary, counts binary, vectors binary, firsts binary, places binary, "
    "links binary, levels long, entry long"
)


def _opened(row) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    nodes, counts, first, place = (np.frombuffer(row[c], np.int64) for c in ("nodes", "counts", "firsts", "places"))
    raw = np.frombuffer(row["vectors"], np.float64).reshape(len(nodes), -1)
    flat, m, links, at = np.frombuffer(row["links"], np.int32), 12, [], 0
    for k in range(int(row["levels"])):
        width = 2 * m if k == 0 else m
        links.append(flat[at : at + len(first) * width].reshape(len(first), width))
        at += len(first) * width
    return Graph(_unit(raw[first]), m, links=links, entry=int(row["entry"])), nodes, counts, raw, place


def found_by(graph: Graph, q: np.ndarray, near: np.float32, audits: int, beam: int, widest: int):
    """For each query the places of similarity ``near`` or more: through the graph with the first beam whose
    audit finds all that brute force finds, and by brute force if none does."""
    sample = np.random.default_rng(5).permutation(len(q))[:audits]
    truth = [np.flatnonzero(graph.x @ q[i] >= near) for i in sample]
    while not all(len(np.intersect1d(graph.within(q[i], near, beam), t)) == len(t) for i, t in zip(sample, truth)):
        if beam >= min(graph.n, widest):
            return (np.flatnonzero(graph.x @ v >= near) for v in q)
        beam *= 2
    return (graph.within(v, near, beam) for v in q)


def search_block(least: float, audits: int = 128, beam: int = 32, widest: int = WIDEST):
    """Queries of a block against one graph: (node, links counted, local root) and spanning links."""

    def run(key: tuple, queries: pd.DataFrame, graphs: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        if not len(queries) or not len(graphs):
            return none
        graph, nodes, counts, raw, place = _opened(graphs.iloc[0])
        queries = queries.sort_values("node")
        mine, own = queries["node"].to_numpy(np.int64), _matrix(queries["embedding"])
        members = np.argsort(place, kind="stable")  # of each direction, one after the other
        size = np.bincount(place, minlength=graph.n)
        begin = np.cumsum(size) - size
        unit, own_unit = (x / np.abs(x).max(axis=1, keepdims=True) for x in (raw, own))
        norms, own_norms = np.linalg.norm(unit, axis=1), np.linalg.norm(own_unit, axis=1)
        left, right = [], []
        for i, hit in enumerate(found_by(graph, _unit(own), np.float32(least - 1e-4), audits, beam, widest)):
            n = size[hit]
            hit = members[np.repeat(begin[hit] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            hit = hit[(unit[hit] @ own_unit[i]) / (norms[hit] * own_norms[i]) >= least]
            hit = hit[nodes[hit] != mine[i]]
            left.append(np.full(len(hit), i))
            right.append(hit)
        left, right = np.concatenate(left), np.concatenate(right)
        links = np.bincount(left, counts[right], len(mine)).astype(np.int64)
        # smallest node reached inside this block, by repeated minima over its links
        root, other = mine.copy(), nodes.copy()
        while len(left):
            low = np.minimum(root[left], other[right])
            if (low == root[left]).all() and (low == other[right]).all():
                break
            np.minimum.at(root, left, low)
            np.minimum.at(other, right, low)
        linked = np.unique(right)
        node, to = np.concatenate([mine, nodes[linked]]), np.concatenate([root, other[linked]])
        return pd.DataFrame({"node": node, "links": np.concatenate([links, np.zeros(len(linked), np.int64)]), "root": to})

    return run


def similar_vectors(vectors: DataFrame, least: float = 0.93, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label)."""
    e = F.col("embedding").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.forall(e, finite) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), e.alias("embedding"), F.coalesce(usable, F.lit(False)).alias("usable"))
    rows = rows.withColumns({"a": F.xxhash64("embedding"), "b": F.xxhash64(F.lit(1), "embedding"), "dim": F.size("embedding").cast("long")})
    group = ["label", "dim", "a", "b"]
    nodes = rows.filter("usable").groupBy(*group).agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding"))
    # numbers of their own: an id may come again with another vector or label
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    sizes = nodes.groupBy("label", "dim").count()
    sizes = sizes.select("label", "dim", F.ceil(F.col("count") / shard).alias("shards"), F.ceil(F.col("count") / block).alias("blocks"))
    # a task for each graph and each meeting of a graph with a block, so that no few tasks hold the work
    n = sizes.agg(F.coalesce(F.sum("shards"), F.lit(1)).alias("graphs"), F.coalesce(F.sum(F.col("shards") * F.col("blocks")), F.lit(1)).alias("meetings")).first()
    tasks = lambda k: max(1, min(2 * int(k), MOST_TASKS))
    dealt = nodes.join(small(sizes), ["label", "dim"]).select("label", "dim", "node", "n", "embedding", "shards", "blocks")
    home = F.pmod(F.xxhash64("node", F.lit("shard")), "shards").alias("shard")
    graphs = stored(dealt.withColumn("shard", home).repartition(tasks(n["graphs"]), "label", "dim", "shard").groupBy("label", "dim", "shard").applyInPandas(build_graph, GRAPH), "graphs")
    each = dealt.select("label", "dim", "node", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("node", F.lit("block")), "blocks").cast("long").alias("block"))
    sent = graphs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = ["label", "dim", "shard", "block"]
    each, sent = (x.repartition(tasks(n["meetings"]), *keys) for x in (each, sent))
    found = each.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(search_block(least), "node long, links long, root long")
    found = stored(found, "links")
    joined = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    facts = stored(nodes.select(*group, "node", "first", "n").join(links, "node", "left").join(joined, "node", "left"), "vector-facts")
    firsts = facts.filter("component is not null").groupBy("component").agg(F.min("first").alias("smallest"))
    facts = facts.join(small(stored(firsts, "smallest")), "component", "left")
    slim = rows.select("vec_id", "label", "dim", "a", "b", "usable")
    known = facts.select(*group, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("smallest", "first").alias("component"))
    linked = slim.filter("usable").join(known, group).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = slim.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_hnsw_dedup(spark, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"))
