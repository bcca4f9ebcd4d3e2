"""Pinned values, fixtures and invariants of the catalog jobs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetmill.functions import scalars as S
from facetmill.operators import boxes, checks, datasets, documents, graphnet, scores, specs, topology, traces
from facetmill.plans import catalog


@pytest.fixture(scope="session")
def box(spark):
    t = boxes.generate_boxes(spark, 3, "clean", 1)
    return t


def names(df, part=None):
    rows = df.filter(F.col("part_id") == part) if part is not None else df
    return sorted(r["check"] for r in rows.collect())


def test_box_topology(box):
    row = topology.topology_counts(box).filter("part_id = 0").first()
    assert (row.face_count, row.oriented_edges, row.unique_edges, row.adjacency_count, row.solid_count) == (6, 24, 12, 12, 1)
    assert topology.coedge_mates(box.coedges).filter("part_id = 0").count() == 24


def test_thin_plate_and_open_shell(spark, box):
    thin = boxes.generate_boxes(spark, 2, "thin_plate", 1)
    found, rule = checks.run_checks(thin)
    assert "ThinWalls" in names(found, 0)
    assert rule.filter("part_id = 0").count() == 6
    opened, manifest = datasets.inject_defect(box, "open_shell")
    got = names(checks.run_checks(opened)[0], 1)
    assert got.count("OpenBoundaries") == 2 and "OrientationNuance" in got
    assert manifest.filter("status = 'ok'").count() == 3
    twice, _ = datasets.inject_defect(box, "self_intersection")
    assert "MultiBodyDetected" in names(checks.run_checks(twice)[0], 3)
    sliver, _ = datasets.inject_defect(box, "sliver_face")
    assert "ThinSolid" in names(checks.run_checks(sliver)[0], 2)
    zero, _ = datasets.inject_defect(box, "zero_length_edge")
    assert "DegenerateEdges" in names(checks.run_checks(zero)[0], 4)


def test_fusion_and_scores(spark):
    rule = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.2)], "part_id long, face_index int, score double")
    ml = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.8)], "part_id long, face_index int, score double")
    fused = {r.face_index: round(r.score, 6) for r in scores.fuse_scores(rule, ml).collect()}
    assert fused == {1: 0.8, 2: 0.56}
    parts = spark.createDataFrame([(1,)], "part_id long")
    found = spark.createDataFrame([(1, 0, "A", "Major"), (1, 1, "B", "Minor")], "part_id long, finding_seq int, check string, severity string")
    assert scores.score_parts(parts, found, rule, ml).first().overall == 80.0
    one = scores.score_parts(parts, found.filter("severity = 'Minor'"), rule, ml.withColumn("score", F.when(F.col("face_index") == 1, 0.5).otherwise(1.0)), True).first()
    assert (one.overall, one.ml_penalty) == (80.0, 15.0)
    labels = spark.createDataFrame([(95.0,), (75.0,), (55.0,), (10.0,)], "s double").select(S.score_label("s").alias("l"))
    assert [r.l for r in labels.collect()] == ["SimulationReady", "ReviewRecommended", "NeedsAttention", "NotReady"]
    tiers = spark.createDataFrame([(6,), (100,), (500,), (1500,)], "n int").select(S.complexity_tier("n")["tier"].alias("t"))
    assert [r.t for r in tiers.collect()] == ["simple", "moderate", "complex", "very_complex"]


def test_partition_count_does_not_matter(spark, sf_dir):
    from facetmill.plans import binding

    t = binding.tables(spark, sf_dir)
    results = []
    for n in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = catalog.analyse(t)["parts"].select("part_id", "label", F.round("overall", 6)).collect()
        assert all(0 <= r[2] <= 100 for r in rows)
        results.append(sorted(map(tuple, rows)))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert results[0] == results[1]


def test_graph_network_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x, pairs = rng.normal(size=(5, 3)), [(0, 1), (1, 2), (2, 3)]
    p = graphnet.Params([(rng.normal(size=(3, 4)), rng.normal(size=4), rng.normal(size=(3, 4))), (rng.normal(size=(4, 2)), rng.normal(size=2), rng.normal(size=(4, 2)))], (rng.normal(size=2), 0.1), (rng.normal(size=2), 0.2), (rng.normal(size=(2, 4)), rng.normal(size=4)))
    h = x
    for i, (neigh, bias, own) in enumerate(p.layers):
        m = np.array([np.mean([h[b] for a, b in pairs + [(b, a) for a, b in pairs] if a == k] or [np.zeros(h.shape[1])], 0) for k in range(5)])
        h = m @ neigh + bias + h @ own
        h = np.maximum(h, 0) if i == 0 else h
    features = spark.createDataFrame([(1, k, x[k].tolist()) for k in range(5)], "part_id long, face_index int, features array<double>")
    adjacency = spark.createDataFrame([(1, a, b) for a, b in pairs], "part_id long, face_a int, face_b int")
    out = graphnet.sage_forward(features, adjacency, p)
    got = np.array([r.x for r in out.orderBy("face_index").collect()])
    assert np.allclose(got, h)
    head = graphnet.graph_head(out, p).first()
    assert math.isclose(sum(head.probs.values()), 1.0)


def test_chunks(spark):
    assert documents.pack_paragraphs("a" * 199 + "\n\n" + "b" * 50) == ["a" * 199 + "\n\n" + "b" * 50]
    assert documents.pack_paragraphs("a" * 200 + "\n\n" + "b" * 50) == ["a" * 200, "b" * 50]
    assert [len(c) for c in documents.pack_paragraphs("x" * 3100)] == [1500, 1500, 100]
    pages = spark.createDataFrame([("s", 1, "one"), ("s", 2, "two\n\n" + "y" * 300), ("t", 1, None)], "source string, page long, text string")
    rows = documents.chunk_documents(pages).orderBy("source", "chunk_id").collect()
    assert [(r.page, r.chunk_id) for r in rows] == [(1, 0), (2, 1)]
    # what a long paragraph leaves over does not swallow the next one
    text = "A" * 1400 + ". " + "B" * 150 + ".\n\n" + "c" * 20
    assert [len(c) for c in documents.pack_paragraphs(text)] == [1401, 151, 20]


def test_chunks_of_documents(spark, sf_dir):
    import re

    def reference(text):  # sentence by sentence, group by group
        out, group = [], ""
        for p in [*[p.strip() for p in text.split("\n") if p.strip()], None]:
            if p is not None and (not group or len(group) < 200):
                group = f"{group}\n\n{p}" if group else p
                continue
            line = ""
            for s in re.split(r"(?<=[.!?])\s+(?=[A-Z(])", group) if len(group) > 1500 else [group]:
                if line and len(line) + 1 + len(s) > 1500:
                    out.append(line)
                    line = ""
                line = f"{line} {s}" if line else s
                while len(line) > 1500:
                    out.append(line[:1500])
                    line = line[1500:]
            out += [line] if line else []
            group = p or ""
        return out

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.col("doc_id").alias("page"), "text")
    want, n = [], {}
    for r in sorted(docs.collect(), key=lambda r: (r.source or "", r.page)):
        for chunk in reference(r.text or ""):
            want.append((r.source, n.get(r.source, 0), chunk))
            n[r.source] = n.get(r.source, 0) + 1
    got = [(r.source, r.chunk_id, r.text) for r in documents.chunk_documents(docs, paragraph=r"\n").collect()]
    assert sorted(got, key=lambda r: (r[0] or "", r[1])) == want


def test_degenerate_edges_count_once(box):
    """Two uses of one flagged edge are one degenerated edge."""
    flagged = box.with_(edges=box.edges.withColumn("is_degenerated", F.col("edge_index") == 3))
    row = checks.run_checks(flagged)[0].filter("check = 'DegenerateTopology' and part_id = 1").first()
    assert row.measure == 1.0


def test_registered_checks_score_faces(box):
    checks.register_check("Third", lambda: checks.Check("Third", F.col("face_count") > 0, F.lit("Info"), F.lit(1.0), F.lit(None).cast("double"), F.lit("x"), "y", face_score=F.when(F.col("face_index") == 3, 0.25)))
    try:
        found, rule = checks.run_checks(box)
        assert found.filter("check = 'Third'").count() == 3
        assert [(r.face_index, r.score) for r in rule.filter("part_id = 0").collect()] == [(3, 0.25)]
    finally:
        del checks._REGISTRY["Third"], checks.NAMES["Third"]


def test_invalid_parts_and_trimmed_reports(box):
    t = box.with_(parts=box.parts.withColumn("is_valid", F.col("part_id") != 1).withColumn("load_check", F.when(F.col("part_id") == 2, "NullShape")))
    rows = {r.part_id: r for r in catalog.reports(t, catalog.analyse(t)).collect()}
    assert [rows[k].status == "InvalidInput" for k in range(3)] == [False, True, True]
    assert rows[1].validation.errors[0].check == "BRepCheckFailure" and rows[2].validation.errors[0].check == "NullShape"
    assert rows[1].geometry is None and rows[1].findings == [] and rows[1].per_face_scores is None
    assert rows[0].graph.adjacency_count == 12 and rows[0].graph.edge_count == 12 and len(rows[0].combined_per_face_scores) == 6
    full = catalog.reports(box, catalog.analyse(box))
    more = full.withColumn("findings", F.array_repeat(F.struct(*[F.lit("x" if k == "string" else 1).cast(k).alias(n) for n, k in (f.split(":") for f in full.schema["findings"].dataType.elementType.simpleString()[7:-1].split(","))]), 30))
    cut = catalog.trim_report(more, 2000).first()
    assert cut.per_face_scores is None and cut.ml.per_face_scores is None and len(cut.findings) == 21
    assert cut.findings[20].check == "TRUNCATED" and cut.findings[20].detail == "10 more findings omitted."
    assert catalog.trim_report(full, 100_000).first().omitted == []


def test_copies_have_keys_of_their_own(box):
    for defect in ("self_intersection", "zero_length_edge"):
        t, _ = datasets.inject_defect(box, defect)
        for name, key in (("faces", "face_index"), ("edges", "edge_index"), ("coedges", "coedge_index"), ("solids", "solid_id")):
            df = getattr(t, name)
            assert df.count() == df.select("part_id", key).distinct().count(), (defect, name)


def test_trace_scores(spark):
    """Order: expected calls that were made, as often and in the expected order; rows with errors and rows without themes stay out."""
    kind = "expected_tool_calls array<string>, expected_answer_themes array<string>, tool_calls array<string>, final_text string, error string"
    rows = spark.createDataFrame([
        (["analyze", "suggest"], ["thin"], ["analyze"], "Verdict: thin", None), (["analyze"], None, ["analyze", "analyze"], "x", None),
        (["a", "b"], None, ["b", "a"], "x", None), (["a"], ["q"], [], "", "timeout"),
    ], kind)
    scored = traces.score_traces(rows)
    assert [r.order_ok for r in scored.filter("error is null").collect()] == [True, False, False]
    total = traces.aggregate_eval(scored).first()
    assert (total.n, total.n_error, total.theme_rate) == (3, 1, 1.0)


def test_exact_splits(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    for n in (0, 1, 137, 1000):
        got = datasets.smallest(rows, F.col("k").cast("string"), n, bits=4, together=20)
        want = rows.orderBy(F.md5(F.col("k").cast("string"))).limit(n)
        assert sorted(r.k for r in got.collect()) == sorted(r.k for r in want.collect())


def test_search(spark):
    basis = spark.createDataFrame([(i, [float(i == k) for k in range(4)]) for i in range(3)], "key long, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    rows = documents.search(q, basis, 99).orderBy("rank").collect()
    assert [(r.key, r.score) for r in rows] == [(0, 1.0), (1, 0.0), (2, 0.0)]


def test_search_in_blocks(spark):
    """Queries in many blocks find what all at once find, ties by key; none is lost where there are no chunks."""
    rng = np.random.default_rng(6)
    v = np.round(rng.normal(size=(300, 4)), 1)
    rows = spark.createDataFrame([(i, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(v)], "key long, embedding array<double>").repartition(5)
    q = rows.filter("key % 3 = 0").withColumnRenamed("key", "query_id")
    found = {b: sorted(map(tuple, documents.search(q, rows, 7, b).select("query_id", "rank", "key").collect())) for b in (1 << 20, 640)}
    x = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = [(i, r + 1, int(j)) for i in range(0, 300, 3) for r, j in enumerate(np.lexsort((np.arange(300), -(x @ x[i])))[:7])]
    assert found[1 << 20] == found[640] and len(want) == len(found[640])
    assert sum(a == b for a, b in zip(want, found[640])) > 0.99 * len(want)  # ties may fall otherwise by the last bit
    assert documents.search(q, rows.limit(0), 7).collect() == [] == documents.search(q.limit(0), rows, 7).collect()


def test_specs(spark):
    cases = {
        '{"steps":[{"op":"box","dx":1,"dy":1,"dz":1}]}': True,
        '{"steps":[{"op":"cyl","r":501,"h":1}]}': False,
        '{"steps":[]}': False,
        '{"steps":[{"op":"box","dx":1,"dy":1,"dz":1},{"op":"fuse","a":0,"b":1}]}': False,
        '{"steps":[{"op":"box","dx":1,"dy":1,"dz":1},{"op":"box","dx":1,"dy":1,"dz":1},{"op":"cut","a":0,"b":1}]}': True,
        '{"steps":[{"op":"box","dx":-1,"dy":1,"dz":1}]}': False,
        '{"steps":[{"op":"box","dx":1,"dy":1,"dz":1}],"rotation":45}': False,
    }
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(cases)], "spec_id long, spec_json string")
    assert [r.valid for r in specs.validate_specs(rows).orderBy("spec_id").collect()] == list(cases.values())


def test_tool_calls_become_text(spark):
    from facetmill.schemas import MESSAGES

    call = [("1", "function", ("analyze", '{"path": "a.step"}')), ("2", "function", ("look", "not json"))]
    rows = spark.createDataFrame([([("user", "q", None, None), ("assistant", None, None, call), ("tool", "r", "1", None), ("debug", "x", None, None)],)], f"messages {MESSAGES}")
    out = rows.select(traces.convert_messages("messages").alias("m"), traces.extract_tools("messages").alias("t")).first()
    assert [m.role for m in out.m] == ["user", "assistant", "user"]
    assert '{"name":"analyze","arguments":{"path":"a.step"}}' in out.m[1].content and '"not json"' in out.m[1].content
    assert out.t == ["analyze", "look"]


def test_urls_and_colours(spark):
    rows = spark.createDataFrame([("http://x.org/a%20b.pdf?q=1",), ("http://x.org/",), ("http://x.org/c/d.PDF",)], "u string")
    assert [r.f for r in rows.select(S.url_file_name("u").alias("f")).collect()] == ["a b.pdf", "download.pdf", "d.PDF"]


def test_traces_land_once(spark, tmp_path):
    import json

    from facetmill.streaming.streams import append_new, read_trace_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("".join(json.dumps({"id": i, "question": "q"}) + "\n" for i in ("a", "b", "a")))
    go = lambda: append_new(read_trace_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    go()
    (tmp_path / "in" / "b.json").write_text("".join(json.dumps({"id": i, "question": "q"}) + "\n" for i in ("b", "c")))
    go()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_runs_fold_as_events_arrive(spark, tmp_path):
    import json

    from facetmill.streaming.streams import fold_runs, folded

    kind = "run_id string, seq long, type string, name string, tokens_in long, tokens_out long, model string"
    events = [("a", 1, "iteration_start", None, 5, 1, None), ("a", 2, "tool_call", "x", None, None, "m1"), ("a", 3, "tool_call", "y", 2, 2, "m2"), ("a", 4, "final_text", None, 1, 1, None), ("b", 1, "iteration_start", None, 1, 1, "m"), ("b", 2, "max_iterations", None, None, None, None)]
    (tmp_path / "in").mkdir()
    for k, part in enumerate((events[2:5], events[:2], events[5:])):  # out of order, over several batches
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps(dict(zip(("run_id", "seq", "type", "name", "tokens_in", "tokens_out", "model"), e))) + "\n" for e in part))
        fold_runs(spark.readStream.schema(kind).json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.run_id: r.asDict() for r in folded(spark, str(tmp_path / "out")).collect()}
    table = spark.createDataFrame(events, kind)
    for r in traces.fold_events(table).join(traces.sum_usage(table), "run_id").collect():
        assert got[r.run_id] == r.asDict()
    assert got["a"]["tool_calls"] == ["x", "y"] and got["b"]["stop_reason"] == "max_iterations"


def test_readers(spark, tmp_path, box):
    import json

    from facetmill.sources import readers as R

    (tmp_path / "parts" / "deep").mkdir(parents=True)
    for name in ("b.STEP", "a.stp", "deep/c.step", "notes.txt"):
        (tmp_path / "parts" / name).write_text("x")
    assert [r.stem for r in R.list_part_files(spark, [str(tmp_path / "parts")]).collect()] == ["a", "b", "c"]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "p.graph.json").write_text(json.dumps({"faces": [{"face_index": 0, "surface_type": "plane", "area": 2.0}], "edges": [{"edge_index": 0, "length": 1.0}], "coedges": [{"coedge_index": 0, "face_index": 0, "edge_index": 0, "orientation": 1}], "adjacency": [[0, 1]]}))
    g = R.read_graphs(spark, str(tmp_path / "g"))
    assert (g["faces"].first().stem, g["adjacency"].first().face_b) == ("p", 1)
    (tmp_path / "g" / "p.labels.json").write_text(json.dumps({"refinement": {"0": True}, "rule_per_face": {"1": 0.5}, "graph_label": 2}))
    faces, graphs = R.read_labels(spark, str(tmp_path / "g"))
    assert sorted((r.face_index, r.refinement, r.rule_score) for r in faces.collect()) == [(0, True, 0.0), (1, False, 0.5)] and graphs.first().graph_label == 2
    manifest = spark.createDataFrame([("s", "s__x", ["x"], "ok", None)], "source_stem string, stem string, defect_tags array<string>, status string, reason string")
    R.write_manifest(manifest, str(tmp_path / "m"))
    assert R.read_manifest(spark, str(tmp_path / "m")).first() == manifest.first()
    (tmp_path / "t.jsonl").write_text('{"id": "a"}\n\nnot json\n[1]\n')
    rows, rejected, counts = R.read_traces(spark, str(tmp_path / "t.jsonl"))
    assert [r.id for r in rows.collect()] == ["a"] and counts == {"rows": 1, "rejected": 2}
    assert sorted(r.line for r in rejected.collect()) == ["[1]", "not json"] and rejected.first().file.endswith("t.jsonl")
    reports = catalog.reports(box, catalog.analyse(box))
    R.write_reports(reports, str(tmp_path / "r"))
    schema = "part_id long, per_face_scores map<string,double>, combined_per_face_scores map<string,double>, ml struct<per_face_scores:map<string,double>>, bodies array<struct<per_face_scores:map<string,double>>>"
    back = R.read_reports(spark, str(tmp_path / "r"), schema).filter("part_id = 1").first()
    assert set(back.combined_per_face_scores) == set(back.ml.per_face_scores) == set(range(6))
    chunks, meta = documents.build_index(spark.createDataFrame([("s", 1, 0, "a text"), ("s", 1, 1, " ")], "source string, page long, chunk_id long, text string"))
    R.save_index(chunks, meta, str(tmp_path / "i"))
    assert R.load_index(spark, str(tmp_path / "i"))[0].count() == 1
    R.save_index(chunks.unionByName(chunks), meta, str(tmp_path / "j"))
    with pytest.raises(ValueError):
        R.load_index(spark, str(tmp_path / "j"))


def test_small_functions(spark):
    rows = spark.createDataFrame([("what?", "a.step"), ("see a.step", "a.step"), ("what?", None)], "q string, p string")
    assert [r.x for r in rows.select(traces.build_question("q", "p").alias("x")).collect()] == ["what?\n\nFile: a.step", "see a.step", "what?"]
    assert spark.range(1).select(S.preview(F.lit("x" * 201)).alias("x")).first().x == "x" * 200 + "...[truncated]"
    text = lambda **n: spark.range(1).select(S.severity_string({k: F.lit(v) for k, v in n.items()}).alias("x")).first().x
    assert (text(Critical=1, Major=0, Minor=4, Info=0), text(Critical=0, Major=0)) == ("C1 M4", "-")
    parts = spark.createDataFrame([(1, 9), (2, None), (3, 4), (4, 4)], "part_id long, face_count int")
    assert [r.part_id for r in scores.order_parts(parts).collect()] == [2, 3, 4, 1]
    q = spark.createDataFrame([(1, "x"), (2, " "), (3, None)], "query_id long, query string")
    for chunks, status in ((spark.range(1), "ok"), (spark.range(0), "no_index")):
        assert {r.query_id: r.status for r in documents.search_status(q, chunks).collect()} == {1: status, 2: "empty_query", 3: "empty_query"}
    one = spark.createDataFrame([("ab",)], "text string").select(documents.hash_embedding("text", 8).alias("e")).first().e
    assert one == [float(i == (97 + 98) % 8) for i in range(8)]
    texts = ["", "a", "\U0001f600\u00e9", "z" * 3000, None]
    hot = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", documents.hash_embedding("text", 3).alias("e")).collect()
    assert {r.i: r.e for r in hot} == {i: None if t is None else [float(k == sum(map(ord, t)) % 3) for k in range(3)] for i, t in enumerate(texts)}
    # a text's code points are read once, however often its vector is
    plan = documents.build_index(spark.createDataFrame([("ab",)], "text string"))[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    chunks, meta = documents.build_index(spark.createDataFrame([("ab",), (" ",), (None,)], "text string"), documents.Embedder(lambda: lambda texts: np.array([[3.0, 4.0]] * len(texts)), 2, "mine"))
    assert [r.embedding for r in chunks.collect()] == [[0.6, 0.8]] and (meta.first().model, meta.first().dim, meta.first().n_chunks) == ("mine", 2, 1)
    probs = spark.createDataFrame([(0, [0.5, 0.5]), (1, [0.75, 0.25])], "y int, p array<double>")
    assert math.isclose(datasets.cross_entropy(probs, "y", "p").first().cross_entropy, (math.log(2) + math.log(4)) / 2)


def test_boxes_overlap_in_parts_of_any_size(spark):
    """The grid follows the part, so a large part makes no more rows than a small one."""
    rng = np.random.default_rng(2)
    for scale in (1.0, 1e6):
        lo = rng.uniform(0, 10, (60, 3))
        hi = lo + rng.uniform(0, 4, (60, 3))
        rows = [(1, i, *(lo[i] * scale).tolist(), *(hi[i] * scale).tolist()) for i in range(60)]
        df = spark.createDataFrame(rows, "part_id long, solid_id int, xmin double, ymin double, zmin double, xmax double, ymax double, zmax double")
        want = {(a, b) for a in range(60) for b in range(a + 1, 60) if ((lo[a] < hi[b]) & (lo[b] < hi[a])).all()}
        got = [(r.a, r.b) for r in checks.overlapping_boxes(df, "solid_id").collect()]
        assert set(got) == want and len(got) == len(want)


def test_boxes_of_very_different_sizes(spark):
    """Small boxes in a large one cost what they overlap; all pairs as by brute force."""
    rng = np.random.default_rng(4)
    n = 400
    lo = rng.uniform(0, 100, (n, 3))
    hi = lo + 10 ** rng.uniform(-3, 1.5, (n, 3)) * rng.choice([0, 1], (n, 1), p=[0.05, 0.95])
    lo[0], hi[0] = 0, 140
    kind = "part_id long, solid_id int, xmin double, ymin double, zmin double, xmax double, ymax double, zmax double"
    rows = [(k % 2, i, *lo[i].tolist(), *hi[i].tolist()) for i in range(n) for k in (0, 1)] + [(0, n, None, 0.0, 0.0, 1.0, 1.0, 1.0)]
    got = checks.overlapping_boxes(spark.createDataFrame(rows, kind), "solid_id").filter("part_id = 0").collect()
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if ((lo[a] < hi[b]) & (lo[b] < hi[a])).all()}
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_many_small_boxes_grow_linearly(spark):
    """Candidates a box do not grow with the part: boxes in a row, each overlapping the next, and one around all."""
    def candidates(n):
        x = F.col("id").cast("double")
        small = spark.range(1, n).select(F.lit(1).cast("long").alias("part_id"), F.col("id").cast("int").alias("solid_id"), x.alias("xmin"), F.lit(0.0).alias("ymin"), F.lit(0.0).alias("zmin"), (x + 1.5).alias("xmax"), F.lit(1.0).alias("ymax"), F.lit(1.0).alias("zmax"))
        large = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, float(n + 2), 2.0 * n, 2.0 * n)], small.schema)
        return checks.overlapping_boxes(small.unionByName(large), "solid_id").count()

    assert candidates(100_000) == 99_999 + 99_998


def test_models_load_once_a_worker(spark, tmp_path):
    """Many batches and tasks, one load in each worker process; a model that gives other dimensions is an error."""
    notes = str(tmp_path / "loads")

    def load():
        import os

        with open(notes, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda texts: np.array([[len(t), 1.0] for t in texts]).reshape(-1, 2)

    rows = spark.range(4000).repartition(16).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "50")
    try:
        chunks, meta = documents.build_index(rows, documents.Embedder(load, 2, str(tmp_path)))
        assert chunks.select(F.sum(F.col("embedding")[0])).first()[0] > 3900 and meta.first().dim == 2
    finally:
        spark.conf.set(key, before)
    pids = open(notes).read().split()
    assert len(pids) == len(set(pids)) <= 8
    wrong = documents.build_index(rows, documents.Embedder(lambda: lambda texts: np.ones((len(texts), 3)), 2, f"{tmp_path}x"))[0]
    with pytest.raises(Exception, match="says 2 dimensions and gave 3"):
        wrong.collect()


def test_healed_parts(box):
    """A part that was not valid is judged if healing made it so, and its report says both."""
    states = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(a).alias("a")) for b, a in ((False, True), (True, False), (False, False))])[F.col("part_id").cast("int")]
    t = box.with_(parts=box.parts.drop("is_valid").withColumns({"valid_before": states["b"], "valid_after": states["a"], "elapsed_seconds": F.lit(1.5)}))
    rows = {r.part_id: r for r in catalog.reports(t, catalog.analyse(t)).collect()}
    assert [rows[k].status == "InvalidInput" for k in range(3)] == [False, False, True]
    healed = rows[0].validation
    assert healed.is_valid and healed.errors == [] and healed.initial_errors[0].check == "BRepCheckFailure" and healed.healed_after_validation_failure
    assert rows[1].validation.errors[0].check == "BRepCheckFailure" and rows[1].validation.initial_errors is None and rows[1].score is not None
    assert (rows[0].heal.valid_before, rows[0].heal.valid_after, rows[0].heal.notes) == (False, True, ["Validity improved after healing."])
    assert rows[2].score is None and rows[2].heal.attempted and rows[2].elapsed_seconds == 1.5


def test_labelling_manifest_round_trip(spark, tmp_path, box):
    """Labels and manifest are one table; what was labelled is what a data set finds."""
    from facetmill.operators import labelling
    from facetmill.sources import readers as R

    parts = box.parts.unionByName(box.parts.withColumns({"part_id": F.col("part_id") + 3, "stem": F.concat(F.lit("empty_"), "stem")}))
    fault = F.when(F.col("part_id") == 1, "LoadError").when(F.col("part_id") == 2, "AnalysisTimeout")
    t = box.with_(parts=parts.withColumn("load_check", fault))
    tags = spark.createDataFrame([("clean_0000", ["sliver_face"])], "stem string, defect_tags array<string>")
    R.write_labels(labelling.label_parts(checks.measured(t), tags), str(tmp_path / "l"))
    manifest = R.read_label_manifest(spark, str(tmp_path / "l"))
    got = {r.input_file: (r.status, r.reason, r.face_count, r.graph_label) for r in manifest.collect()}
    assert got == {
        "clean_0000": ("ok", None, 6, 2), "clean_0001": ("skipped", "validation_failed", None, None), "clean_0002": ("error", "AnalysisTimeout", None, None),
        **{f"empty_clean_000{k}": ("skipped", "empty_graph", None, None) for k in range(3)},
    }
    faces, graphs = R.read_part_labels(spark, str(tmp_path / "l"))
    assert sorted(r.face_index for r in faces.collect()) == list(range(6)) and graphs.first().graph_label == 2
    assert [r.stem for r in datasets.discover_samples(manifest, graphs, graphs).collect()] == ["clean_0000"]


def test_small_sources(spark, tmp_path):
    """Tags that are missing or malformed, splits, gold rows, prompts, a source list and an imported index."""
    import json

    from facetmill.sources import readers as R

    (tmp_path / "tags").mkdir()
    (tmp_path / "tags" / "a.tags.json").write_text(json.dumps({"stem": "a", "defect_tags": ["x"]}))
    (tmp_path / "tags" / "b.tags.json").write_text("{broken")
    stems = spark.createDataFrame([("a",), ("b",), ("c",)], "stem string")
    assert {r.stem: r.defect_tags for r in R.read_tags(spark, str(tmp_path / "tags"), stems).collect()} == {"a": ["x"], "b": [], "c": []}
    R.write_split(spark.createDataFrame([("1", "train"), ("2", "val"), ("3", "train")], "id string, split string"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s" / "split=train")).count() == 2
    (tmp_path / "gold.jsonl").write_text(json.dumps({"id": "g", "step_path": None, "question": "q", "category": "c", "expected_tool_calls": ["analyze"], "expected_answer_themes": ["thin"]}) + "\n")
    assert R.read_gold(spark, str(tmp_path / "gold.jsonl")).first().expected_tool_calls == ["analyze"]
    (tmp_path / "p.jsonl").write_text('{"id": "p", "prompt": "x", "expect": {"faces": [6, 8]}}\n')
    assert R.read_prompts(spark, str(tmp_path / "p.jsonl")).first().expect.faces == [6, 8]
    (tmp_path / "sources.txt").write_text("# list\nhttp://x.org/a.pdf # one\n\nhttp://x.org/\n")
    assert [r.file_name for r in R.read_source_list(spark, str(tmp_path / "sources.txt")).collect()] == ["a.pdf", "download.pdf"]
    index = {"entries": [{"source": "s", "page": 1, "chunk_id": 0, "text": "t"}], "embeddings": [[1.0, 0.0]]}
    (tmp_path / "i.json").write_text(json.dumps(index))
    assert R.import_index(spark, str(tmp_path / "i.json")).first().embedding == [1.0, 0.0]
    (tmp_path / "i.json").write_text(json.dumps(index | {"embeddings": []}))
    with pytest.raises(Exception, match="differ in length"):
        R.import_index(spark, str(tmp_path / "i.json")).collect()


def test_intermediate_tables_are_deleted(spark, sf_dir):
    """After clearing, no intermediate table is left, and queries make theirs anew."""
    import os

    from facetmill import common
    from facetmill.plans import binding

    t = binding.tables(spark, sf_dir)
    n = t.parts.count()
    common.stored(spark.range(3), "three")
    paths = list(common._MADE[spark.sparkContext.applicationId])
    assert any(os.path.exists(p.removeprefix("file://")) for p in paths)
    assert common.clear_scratch(spark) == len(paths) and not any(os.path.exists(p.removeprefix("file://")) for p in paths)
    assert binding.tables(spark, sf_dir).parts.count() == n


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_clustered_catalog_is_not_shuffled(spark, sf_dir):
    """On tables in buckets of parts, faces, parts and the network need no exchange, and no window runs over a part."""
    from facetmill.common import co_located
    from facetmill.operators import measures
    from facetmill.plans import binding

    t = binding.tables(spark, sf_dir)
    m = checks.measured(t)
    with co_located(spark):
        rows = measures.measured_faces(t, ("part_id",), checks.registered())
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert _exchanges(rows) == 0
        assert _exchanges(measures.part_rows(t, m.sides[0].rows, ("part_id",), checks.registered())) == 0
    for line in plan.splitlines():
        assert "Window [" not in line or "edge_index" in line
    assert _exchanges(m.faces) == 0 and _exchanges(m.parts) == 0


def test_reports_of_a_clustered_catalog_shuffle_bodies_only(spark, sf_dir):
    """What a report gathers lies in the buckets of parts; what is said of bodies is gathered there once, whatever the number of shuffle partitions."""
    from facetmill.common import co_located
    from facetmill.plans import binding

    t = binding.tables(spark, sf_dir)
    r, bodies = catalog.analyse(t), catalog.analyse(catalog.as_bodies(t), keys=catalog.BODY)
    key, before = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    bodies["parts"]  # its tables are stored
    with co_located(spark):
        spark.conf.set(key, "64")
        try:
            assert _exchanges(catalog.reports(t, r)) == 0
            assert _exchanges(catalog.reports(t, r, bodies)) == 1
        finally:
            spark.conf.set(key, before)


def test_giant_parts_spread_and_agree(spark, sf_dir):
    """Parts beyond the limit go by face and by edge over many tasks, with the same rows in the end."""
    from facetmill.plans import binding

    t = binding.tables(spark, sf_dir)
    whole, cut = checks.measured(t), checks.measured(t, giant=30)
    assert len(cut.sides) == 2 and cut.sides[1].spread
    assert "RepartitionByExpression [part_id" in (plan := cut.sides[1].tables.faces._jdf.queryExecution().optimizedPlan().toString()) and "face_index" in plan.split("\n")[0]
    for name, columns in (("faces", ["part_id", "face_index", "degree", "rule_score", "ml_score", "proxy"]), ("parts", ["part_id", "total_faces", "findings", "mean"])):
        a, b = (getattr(x, name) for x in (whole, cut))
        if name == "parts":
            a, b = (x.select("part_id", F.col("face_count").alias("total_faces"), "findings", F.round("rule_face_mean", 9).alias("mean")) for x in (a, b))
        assert a.select(columns).exceptAll(b.select(columns)).count() == 0 and a.count() == b.count()
    from facetmill.plans.data_queries import _P

    features = S.face_feature_vector(t.faces).select("part_id", "face_index", "features")
    near = topology.face_adjacency(t.coedges)
    a = graphnet.sage_forward(features, near, _P, heads=True).withColumnRenamed("refinement_prob", "p")
    b = graphnet.sage_forward(features, near, _P, heads=True, giant=30).withColumnRenamed("refinement_prob", "q")
    row = a.join(b.select("part_id", "face_index", "q"), ["part_id", "face_index"]).agg(F.count("*").alias("n"), F.max(F.abs(F.col("p") - F.col("q"))).alias("d")).first()
    assert row.n == t.faces.count() and row.d < 1e-12
    means = graphnet.graph_head(graphnet.part_means(features, near, _P, giant=30), _P)
    assert means.select("part_id", F.round("confidence", 9)).exceptAll(graphnet.graph_head(a, _P).select("part_id", F.round("confidence", 9))).count() == 0


def test_failing_checks_leave_the_others(spark, box):
    """Values that cannot be computed skip a check on their part only; its scores go with it."""
    t = box.with_(faces=box.faces.withColumn("normal", F.when((F.col("part_id") == 0) & (F.col("face_index") == 1), F.slice("normal", 1, 2)).otherwise(F.col("normal"))))
    one = (F.col("part_id") == 1) & (F.col("face_index") == 2)
    more = [
        ("Edge", checks.Check("Edge", F.lit(True), F.lit("Minor"), F.lit(1.0), F.lit(None), F.lit("x"), "y", edge_score=F.lit(1) / F.when(F.col("part_id") == 2, 0).otherwise(4))),
        ("Face", checks.Check("Face", F.lit(True), F.lit("Minor"), F.lit(1.0), F.lit(None), F.lit("x"), "y", face_score=F.when(one, "half").otherwise("0.5").cast("double"))),
        ("Part", checks.Check("Part", F.array(F.lit(True))[F.when(F.col("part_id") == 1, 5).otherwise(0)], F.lit("Minor"), F.lit(1.0), F.lit(None), F.lit("x"), "y")),
    ]
    m = checks.Measured(t, topology.PART, [*checks.registered(), *more])
    rows = checks.findings(m.judged).collect()
    skipped = {(r.part_id, r.detail.split(" ")[0]) for r in rows if r.check == "CheckSkipped"}
    assert skipped == {(0, "SharpEdges"), (2, "Edge"), (1, "Face"), (1, "Part")}
    assert {(r.part_id, r.check) for r in rows if r.check in ("Edge", "Face", "Part")} == {(0, "Edge"), (1, "Edge"), (0, "Face"), (2, "Face"), (0, "Part"), (2, "Part")}
    assert all(r.severity == "Info" for r in rows if r.check == "CheckSkipped")
    scores_of = {(r.part_id, r.face_index): r.rule_score for r in m.faces.collect()}
    assert [scores_of[p, 2] for p in range(3)] == [0.5, 0.25, 0.5]


def test_crowded_and_loose_edges(spark, box):
    """An edge of many faces and one of none, whatever their number of uses."""
    n = 500
    faces = box.faces.filter("part_id = 0 and face_index = 0").drop("face_index").crossJoin(spark.range(6, 6 + n).select(F.col("id").cast("int").alias("face_index")))
    uses = spark.range(n).select(F.lit(0).cast("long").alias("part_id"), (F.col("id") + 100).cast("int").alias("coedge_index"), (F.col("id") + 6).cast("int").alias("face_index"), F.lit(3).alias("edge_index"), F.lit(1).alias("orientation"), F.lit(0).alias("loop_position"))
    loose = spark.createDataFrame([(1, 77, 1e-9, False)], box.edges.select("part_id", "edge_index", "length", "is_degenerated").schema)
    t = box.with_(faces=box.faces.unionByName(faces.select(box.faces.columns)), coedges=box.coedges.unionByName(uses.select(box.coedges.columns)), edges=box.edges.select(loose.columns).unionByName(loose))
    m = checks.measured(t)
    facts = {r.part_id: r for r in m.judged.collect()}
    assert (facts[0].crowded_edges, facts[0].edge_count, facts[0].duplicate_faces) == (1, 24 + n, n)
    assert (facts[1].zero_edges, facts[1].open_edges, facts[1].edge_count) == (1, 0, 25)
    degree = {r.face_index: r.degree for r in m.faces.filter("part_id = 0").collect()}
    want = {r.face_index: r.degree for r in topology.face_degree(topology.face_adjacency(t.coedges.filter("part_id = 0"))).collect()}
    assert degree == {**dict.fromkeys(degree, 0), **want}


def test_buckets_grow_with_the_catalog(spark, sf_dir, monkeypatch):
    """A larger catalog has more buckets, not larger ones; its line items are shuffled once, and what is measured stays where they lie."""
    from facetmill import common
    from facetmill.plans import binding

    few = checks.measured(binding.tables(spark, sf_dir))
    monkeypatch.setattr(common, "BUCKET_ROWS", 500)
    monkeypatch.setattr(binding, "_STORED", {})
    t = binding.tables(spark, sf_dir)
    assert t.buckets == 12 and common.bucket_count(spark, 10**9 * 500) == common.MOST_BUCKETS
    assert _exchanges(common.clustered(binding.uses(spark, sf_dir, 12), "uses", ["part_id"], 12)) == 0
    many = checks.measured(t)
    assert _exchanges(many.parts) == 0 and "12 out of 12" in many.parts._jdf.queryExecution().executedPlan().toString()
    columns = ["part_id", "face_count", "findings", "total"]
    a, b = (m.parts.withColumn("total", F.round("rule_face_mean", 9)).select(columns) for m in (few, many))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_defects_of_a_clustered_catalog_keep_its_buckets(spark, sf_dir):
    """Degraded tables are written once in buckets; what is measured on them is neither shuffled nor sent whole through the driver."""
    from facetmill.common import co_located
    from facetmill.operators import measures
    from facetmill.plans import binding

    t = binding.tables(spark, sf_dir)
    made = datasets.inject_defect(t, "sliver_face")[0]
    kept = datasets.settled(made)
    assert kept.buckets == t.buckets
    for name in ("parts", "solids", "faces", "edges", "coedges"):
        assert getattr(kept, name).exceptAll(getattr(made, name)).count() == 0 and getattr(kept, name).count() == getattr(made, name).count()
    with co_located(spark):
        rows = measures.measured_faces(kept, ("part_id",), checks.registered())
        assert _exchanges(rows) == 0 and "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def test_joins_by_face_and_edge_stay_in_buckets(spark, sf_dir):
    """Joins by face or edge of a clustered catalog shuffle nothing, neither while they are computed nor when their rows are read."""
    from facetmill.common import co_located
    from facetmill.plans import binding, queries

    t = binding.tables(spark, sf_dir)
    with co_located(spark):
        for rows in (topology.edge_features(t.edges, t.faces, t.coedges), queries._heuristic(t), checks.interference(t)):
            assert _exchanges(rows) == 0
    for name in ("edge_features", "heuristic_scores", "fallback_embedding", "box_overlaps"):
        assert _exchanges(queries.QUERIES[name](spark, sf_dir)) == 0


def test_reports_are_written_compressed(spark, tmp_path):
    import os

    from facetmill.sources import readers as R

    R.write_reports(spark.createDataFrame([(1, "ok"), (2, "bad")], "part_id long, status string"), str(tmp_path / "r"))
    files = [f for _, _, names in os.walk(tmp_path / "r") for f in names if f.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files)
    assert R.read_reports(spark, str(tmp_path / "r"), "part_id long, status string").count() == 2
