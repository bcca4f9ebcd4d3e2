"""Vectors in cliques, scaled copies and shards whose audit fails: links equal brute force."""

import numpy as np
import pandas as pd
import pytest

from facetmill.llm import hnsw_dedup, queries


def shard(x, seed=None):
    order = np.arange(len(x)) if seed is None else np.random.default_rng(seed).permutation(len(x))
    return pd.DataFrame({"node": np.arange(len(x)), "n": 1, "embedding": [x[i].tolist() for i in order], "blocks": 1}), order


def links_of(rows, **options):
    graph = hnsw_dedup.build_graph((0, len(rows["embedding"][0]), 0), rows)
    search = hnsw_dedup.search_block(0.93, **options)
    got = pd.concat([search((0, 0, 0, 0), rows.iloc[k : k + 1024], graph) for k in range(0, len(rows), 1024)])
    return got.groupby("node")["links"].sum().reindex(rows["node"], fill_value=0).to_numpy()


def brute(rows):
    x = np.array(rows["embedding"].tolist())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return ((u @ u.T) >= 0.93).sum(1) - 1


@pytest.mark.parametrize("seed", range(15))
def test_scaled_copies_in_a_shard(seed):
    """20 directions with 100 scalings each, in order and shuffled: no link is lost."""
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(20, 1, 32)) * rng.uniform(0.1, 10, (1, 100, 1))).reshape(-1, 32)
    for order in (None, seed):
        rows, _ = shard(x, order)
        assert (links_of(rows) == brute(rows)).all()


def test_cliques_of_near_copies():
    """More near copies than a node has links for, none of one direction; and a beam that cannot pass its audit."""
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(12, 16)), 60, axis=0) + rng.normal(0, 0.01, (720, 16))
    rows, _ = shard(x, 3)
    want = brute(rows)
    assert (links_of(rows) == want).all()
    graph = hnsw_dedup.Graph(hnsw_dedup._unit(x))
    for level in graph.links:  # torn apart: nothing but the entry is found
        level[:] = -1
    graph.from_count[:] = 0
    got = list(hnsw_dedup.found_by(graph, graph.x, np.float32(0.93), 8, 4, 16))
    assert [len(g) for g in got] == [int((graph.x @ v >= np.float32(0.93)).sum()) for v in graph.x]


def test_vectors_equal_their_sql_twin(spark, tmp_path):
    """A table with scaled copies, cliques, chains and odd rows, against the registered SQL."""
    import duckdb

    rng = np.random.default_rng(14)
    x = (rng.normal(size=(8, 1, 12)) * rng.uniform(0.1, 1e3, (1, 25, 1))).reshape(-1, 12)
    near = np.repeat(rng.normal(size=(5, 12)), 30, axis=0) + rng.normal(0, 0.12, (150, 12))
    turn = np.linspace(0, 3, 40)
    chain = np.zeros((40, 12))
    chain[:, 0], chain[:, 1] = np.cos(turn), np.sin(turn)
    rows = [(int(i), v.tolist(), int(i % 3)) for i, v in enumerate(rng.permutation(np.concatenate([x, near, chain])))]
    rows += [(9000, None, 0), (9001, [0.0] * 12, 0), (9002, [1.0], 0), (9003, rows[0][1], None), (9004, [float("nan")] + [1.0] * 11, 1), (5, rows[7][1], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings/*.parquet'")
    want = sorted(con.execute(queries.ORACLES["op5_hnsw_dedup"]).fetchall())
    got = hnsw_dedup.similar_vectors(df, shard=64, block=50).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == want and sum(r[1] for r in want) > 3000
