"""Streams: restarts, late and repeated events, compaction."""

import json

import pytest
from pyspark.sql import functions as F

from facetmill.operators import traces
from facetmill.streaming import streams

KIND = "run_id string, seq long, at timestamp, type string, name string, tokens_in long, tokens_out long, model string"
NAMES = [f.split(" ")[0] for f in KIND.split(", ")]


def at(minute):
    return f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"


EVENTS = [
    ("a", 1, at(0), "iteration_start", None, 5, 1, None), ("a", 2, at(1), "tool_call", "x", None, None, "m1"), ("a", 3, at(2), "tool_call", "y", 2, 2, "m2"),
    ("a", 4, at(3), "final_text", None, 1, 1, None), ("b", 1, at(2), "iteration_start", None, 1, 1, "m"), ("b", 2, at(4), "max_iterations", None, None, None, None),
    ("c", 1, at(5), "tool_call", "z", None, None, None), ("d", 1, at(300), "iteration_start", None, None, None, None),
]


@pytest.fixture
def feed(tmp_path):
    (tmp_path / "in").mkdir()
    count = iter(range(100))

    def put(events):
        (tmp_path / "in" / f"{next(count):03d}.json").write_text("".join(json.dumps(dict(zip(NAMES, e))) + "\n" for e in events))

    return put


def test_runs_go_out_once_when_they_end(spark, tmp_path, feed):
    """Restarted after every batch; events come late, out of order and again."""

    def go():
        stream = spark.readStream.schema(KIND).json(str(tmp_path / "in"))
        streams.emit_runs(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "10 minutes", 3_600_000).awaitTermination()
        try:
            rows = spark.read.schema(streams.RUNS).parquet(str(tmp_path / "out")).collect()
        except Exception as e:  # nothing went out yet
            assert "PATH_NOT_FOUND" in str(e)
            rows = []
        return {r.run_id: r for r in rows}, len(rows)

    feed([EVENTS[3], EVENTS[1], EVENTS[4]])  # the end first
    assert go()[1] == 0
    feed([EVENTS[0], EVENTS[1], EVENTS[2], EVENTS[5]])  # late and repeated
    assert go()[1] == 0
    feed([EVENTS[6], ("e", 1, at(20), "tool_call", "q", None, None, None)])  # the watermark passes a's and b's ends
    got, n = go()
    assert set(got) == {"a", "b"} and n == 2
    feed([("a", 1, at(0), "iteration_start", None, 5, 1, None)])  # too late: dropped, not a run of its own
    feed([EVENTS[7]])
    got, n = go()
    assert n == 4 and got["c"].stop_reason is None and got["e"].tool_calls == ["q"]
    table = spark.createDataFrame([(r, s, t, n, i, o, m) for r, s, _, t, n, i, o, m in EVENTS if r in "ab"], "run_id string, seq long, type string, name string, tokens_in long, tokens_out long, model string")
    for r in traces.fold_events(table).join(traces.sum_usage(table), "run_id").collect():
        assert got[r.run_id].asDict() == r.asDict()


def test_partial_folds_compact(spark, tmp_path, feed):
    """Compaction in between changes nothing; repeated batches do not count twice."""

    def go():
        stream = spark.readStream.schema(KIND).json(str(tmp_path / "in")).drop("at")
        streams.fold_runs(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return {r.run_id: r.asDict() for r in streams.folded(spark, str(tmp_path / "out")).collect()}

    for k in range(0, 6, 2):
        feed(EVENTS[k : k + 2])
        before = go()
        if k:
            assert streams.compact(spark, str(tmp_path / "out")) == k // 2
            assert {r.run_id: r.asDict() for r in streams.folded(spark, str(tmp_path / "out")).collect()} == before
    assert len(list((tmp_path / "out" / "folds").glob("kind=*/number=*"))) == 1
    assert streams.compact(spark, str(tmp_path / "out")) == 2
    assert before["a"]["tool_calls"] == ["x", "y"] and before["a"]["tokens_in"] == 8


def test_keys_of_their_own(spark, tmp_path):
    """A repeated key stays out over restarts; the target is read without its keys."""
    (tmp_path / "in").mkdir()
    for k, ids in enumerate((["a", "b", "a"], ["b", "c"], ["a", "c", "d"])):
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps({"id": i, "question": f"q{k}"}) + "\n" for i in ids))
        streams.append_new(streams.read_trace_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).select("id", "question").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("a", "q0"), ("b", "q0"), ("c", "q1"), ("d", "q2")]
    assert spark.read.parquet(str(tmp_path / "out" / "_keys")).agg(F.count_distinct("id")).first()[0] == 4
