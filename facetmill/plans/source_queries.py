"""Queries of readers and writers, streams and small functions: tables go out in their format and come back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import scratch, stored
from ..functions import scalars as S
from ..operators import boxes, checks, datasets, documents, labelling, scores, topology, traces
from ..schemas import BOX
from ..sources import readers as R
from ..streaming import streams
from . import binding, catalog
from .binding import read, sql
from .data_queries import _PRED, _TRACES, _eval_rows, conversation_traces, predictions
from .queries import _RANK, ORACLES, QUERIES, _r, query  # noqa: F401

# --- files ------------------------------------------------------------------------------------------------------------


@query(
    "graph_files",
    sql(
        """SELECT stem, coalesce(f.n, 0) AS faces, round(f.a, 6) AS area, coalesce(e.n, 0) AS edges, round(e.l, 6) AS length, coalesce(c.n, 0) AS coedges, coalesce(a.n, 0) AS pairs, a.s AS pair_sum FROM parts
        LEFT JOIN (SELECT part_id, count(*) AS n, sum(area) AS a FROM faces GROUP BY ALL) f USING (part_id) LEFT JOIN (SELECT part_id, count(*) AS n, sum(length) AS l FROM edges GROUP BY ALL) e USING (part_id)
        LEFT JOIN (SELECT part_id, count(*) AS n FROM coedges GROUP BY ALL) c USING (part_id) LEFT JOIN (SELECT part_id, count(*) AS n, sum(face_a * 1000 + face_b)::BIGINT AS s FROM adjacency GROUP BY ALL) a USING (part_id)
        WHERE coalesce(f.n, 0) > 0""",
        False,
    ),
)
def graph_files(spark, sf_dir) -> DataFrame:
    """Graph payloads of all parts, written and read."""
    R.write_graphs(binding.tables(spark, sf_dir), path := scratch(spark, "graphs"))
    g = R.read_graphs(spark, path, lines=True)
    out = g["faces"].groupBy("stem").agg(F.count("*").alias("faces"), F.round(F.sum("area"), 6).alias("area"))
    out = out.join(g["edges"].groupBy("stem").agg(F.count("*").alias("edges"), F.round(F.sum("length"), 6).alias("length")), "stem", "left")
    out = out.join(g["coedges"].groupBy("stem").agg(F.count("*").alias("coedges")), "stem", "left")
    pairs = g["adjacency"].groupBy("stem").agg(F.count("*").alias("pairs"), F.sum(F.col("face_a") * 1000 + F.col("face_b")).alias("pair_sum"))
    return out.join(pairs, "stem", "left").na.fill(0, ["edges", "coedges", "pairs"])


@query("label_files", sql("SELECT stem, face_index, coalesce(score, 0) > 0.5 AS refinement, round(coalesce(score, 0), 6) AS rule_score FROM faces JOIN good USING (part_id) LEFT JOIN rule_scores USING (part_id, face_index)"))
def label_files(spark, sf_dir) -> DataFrame:
    """Labels of all labelled parts, written and read."""
    t = binding.tables(spark, sf_dir)
    tags = t.parts.select("stem", F.array(F.split_part("stem", F.lit("__"), F.lit(2))).alias("defect_tags"))
    rows = labelling.label_parts(checks.measured(t), tags).filter("status = 'ok'")
    rows.select("stem", "refinement", "complexity_proxy", "rule_per_face", "graph_label").write.json(path := scratch(spark, "labels"))
    return R.read_labels(spark, path, lines=True)[0].select("stem", "face_index", "refinement", _r("rule_score"))


@query("tag_files", sql("SELECT stem, CASE WHEN part_id % 4 = 0 THEN [] ELSE [split_part(stem, '__', 2)] END AS defect_tags FROM parts", False))
def tag_files(spark, sf_dir) -> DataFrame:
    """Tags of degraded parts, written and read; clean ones have no file."""
    p = binding.parts(spark, sf_dir)
    tags = p.filter("part_id % 4 <> 0").select("stem", F.array(F.split_part("stem", F.lit("__"), F.lit(2))).alias("defect_tags"))
    tags.write.json(path := scratch(spark, "tags"))
    return R.read_tags(spark, path, p, lines=True)


@query("report_files", sql("SELECT l.part_id, label AS status, round(overall, 9) AS overall, CASE WHEN label <> 'InvalidInput' THEN coalesce(m.s, []) END AS combined_scores FROM everything l LEFT JOIN (SELECT part_id, list(round(score, 6) ORDER BY face_index) AS s FROM fused GROUP BY ALL) m USING (part_id)"))
def report_files(spark, sf_dir) -> DataFrame:
    """Reports, written by status and read, with whole-number keys again."""
    t = binding.tables(spark, sf_dir)
    R.write_reports(catalog.reports(t, catalog.analyse(t)).drop("bodies"), path := scratch(spark, "reports"))
    rows = R.read_reports(spark, path, "part_id long, status string, score struct<overall:double>, per_face_scores map<string,double>, combined_per_face_scores map<string,double>")
    listed = F.transform(F.array_sort(F.map_entries("combined_per_face_scores")), lambda x: F.round(x["value"], 6))
    return rows.select("part_id", "status", F.round("score.overall", 9).alias("overall"), listed.alias("combined_scores"))


@query("manifest_files", sql("SELECT stem AS source_stem, stem || '__sliver_face' AS stem, ['sliver_face'] AS defect_tags, CASE WHEN load_check IS NULL THEN 'ok' ELSE 'error' END AS status, 'not read: ' || load_check AS reason FROM parts", False))
def manifest_files(spark, sf_dir) -> DataFrame:
    """The manifest of a defect, written and read."""
    R.write_manifest(datasets.inject_defect(binding.tables(spark, sf_dir), "sliver_face")[1], path := scratch(spark, "manifest"))
    return R.read_manifest(spark, path)


@query("split_files", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM documents")
def split_files(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train").alias("split"))
    R.write_split(rows, path := scratch(spark, "split"))
    return spark.read.schema("doc_id long, split string").json(path)


_HOT = "(list_sum(list_transform(string_split(text, ''), lambda c: unicode(c))) % 8)::INT"


@query("index_files", f"SELECT doc_id AS page, {_HOT} AS hot, 'hash' AS model, 8 AS dim, (SELECT count(*) FROM documents WHERE length(trim(text, ' ')) > 0) AS n_chunks FROM documents WHERE length(trim(text, ' ')) > 0")
def index_files(spark, sf_dir) -> DataFrame:
    """An index over whole documents, saved and loaded; blank ones are dropped."""
    chunks, meta = documents.build_index(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "text"))
    R.save_index(chunks, meta, path := scratch(spark, "index"))
    chunks, meta = R.load_index(spark, path)
    hot = (F.array_position("embedding", F.lit(1.0)) - 1).cast("int")
    return chunks.select("page", hot.alias("hot")).crossJoin(meta.select("model", "dim", "n_chunks"))  # one row of facts


@query("trace_files", f"WITH {_TRACES} SELECT id, id % 7 <> 0 AS ok, CASE WHEN id % 7 = 0 THEN id || ' is no trace' END AS line, count(*) FILTER (id % 7 <> 0) OVER () AS n_rows, count(*) FILTER (id % 7 = 0) OVER () AS n_rejected FROM traces")
def trace_files(spark, sf_dir) -> DataFrame:
    """Traces as lines, some of them broken and some blank: rows, rejected lines and counts of one reading."""
    rows = conversation_traces(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "messages", "final_text", "stop_reason", "category")
    broken = F.col("id").cast("long") % 7 == 0
    line = F.when(broken, F.concat("id", F.lit(" is no trace"))).otherwise(F.to_json(F.struct(*rows.columns)))
    rows.select(F.explode(F.array(line, F.lit(" "))).alias("value")).write.text(path := scratch(spark, "traces"))
    good, bad, counts = R.read_traces(spark, path)
    bad = bad.select(F.split_part("line", F.lit(" "), F.lit(1)).alias("id"), F.lit(False).alias("ok"), "line")
    both = good.select("id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("line")).unionByName(bad)
    return both.select(F.col("id").cast("long").alias("id"), "ok", "line", F.lit(counts["rows"]).cast("long").alias("n_rows"), F.lit(counts["rejected"]).cast("long").alias("n_rejected"))


@query("gold_files", f"WITH {_TRACES} SELECT id::VARCHAR AS id, category, 2 AS n_calls, CASE WHEN id % 5 <> 0 THEN 2 END AS n_themes FROM traces")
def gold_files(spark, sf_dir) -> DataFrame:
    """Gold rows, written and read."""
    rows = _eval_rows(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "category", "expected_tool_calls", "expected_answer_themes")
    rows.write.json(path := scratch(spark, "gold"))
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return R.read_gold(spark, path).select("id", "category", n("expected_tool_calls").alias("n_calls"), n("expected_answer_themes").alias("n_themes"))


@query("append_missing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def append_missing(spark, sf_dir) -> DataFrame:
    done = read(spark, sf_dir, "labels").filter("toxic = 0")
    return traces.append_missing(read(spark, sf_dir, "documents").select("doc_id"), done, "doc_id")


# --- streams ----------------------------------------------------------------------------------------------------------

_KINDS = {"view": "iteration_start", "click": "tool_call", "error": "max_iterations", "purchase": "final_text"}
_FOLD = """count(*) FILTER (event_type = 'view') AS iterations, coalesce(list(event_type || (event_id % 3) ORDER BY event_id) FILTER (event_type = 'click'), []) AS tool_calls,
CASE WHEN bool_or(event_type = 'error') THEN 'max_iterations' WHEN bool_or(event_type = 'purchase') THEN 'stop' END AS stop_reason, sum(event_id % 7)::BIGINT AS tokens_in, sum(event_id % 5)::BIGINT AS tokens_out, min_by(event_type, event_id) AS model"""


def _event_stream(spark, sf_dir) -> DataFrame:
    """The table of events as a stream of run events."""
    source = spark.readStream.schema(read(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    kind = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    return source.select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), F.try_element_at(kind, "event_type").alias("type"),
        F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("name"), (F.col("event_id") % 7).alias("tokens_in"), (F.col("event_id") % 5).alias("tokens_out"), F.col("event_type").alias("model"),
    )


@query("stream_folds", f"SELECT user_id::VARCHAR AS run_id, {_FOLD} FROM events GROUP BY ALL")
def stream_folds(spark, sf_dir) -> DataFrame:
    """Runs folded from the stream of events, after a compaction."""
    path = scratch(spark, "folds")
    streams.fold_runs(_event_stream(spark, sf_dir).drop("at"), path, f"{path}-progress").awaitTermination()
    streams.compact(spark, path)
    return streams.folded(spark, path)


@query(
    "stream_runs",
    f"""SELECT user_id::VARCHAR AS run_id, {_FOLD} FROM events GROUP BY user_id HAVING coalesce(max(epoch_ms(ts)) FILTER (event_type IN ('error', 'purchase')), max(epoch_ms(ts)) + 3600000) <= (SELECT max(epoch_ms(ts)) - 600000 FROM events)""",
)
def stream_runs(spark, sf_dir) -> DataFrame:
    """Runs that had ended, or gone quiet, ten minutes before the last event."""
    path = scratch(spark, "runs")
    streams.emit_runs(_event_stream(spark, sf_dir), path, f"{path}-progress", "10 minutes", 3_600_000).awaitTermination()
    return spark.read.schema(streams.RUNS).parquet(path)


# --- small functions --------------------------------------------------------------------------------------------------


@query("build_question", "SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN lang || ' about ' || source WHEN doc_id % 3 = 2 THEN lang || chr(10) || chr(10) || 'File: ' || source ELSE lang END AS question FROM documents")
def build_question(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    k = F.col("doc_id") % 3
    rows = d.select("doc_id", F.when(k == 1, F.concat("lang", F.lit(" about "), "source")).otherwise(F.col("lang")).alias("q"), F.when(k != 0, F.col("source")).alias("p"))
    return rows.select("doc_id", traces.build_question("q", "p").alias("question"))


@query("extract_tools", "SELECT conv_id AS id, coalesce(list('tool' || (turn % 4) ORDER BY turn, role, text) FILTER (role = 'assistant' AND turn % 3 <> 0 AND turn % 5 <> 0), []) AS tools FROM conversations GROUP BY ALL")
def extract_tools(spark, sf_dir) -> DataFrame:
    """Assistants call a tool in two turns of three; names of calls in every fifth turn are empty."""
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))

    def message(x):
        name = F.when(x["turn"] % 5 != 0, F.concat(F.lit("tool"), (x["turn"] % 4).cast("string"))).otherwise("")
        call = F.struct(F.lit("1").alias("id"), F.lit("function").alias("type"), F.struct(name.alias("name"), F.lit("{}").alias("arguments")).alias("function"))
        return F.struct(x["role"].alias("role"), x["text"].alias("content"), F.lit(None).cast("string").alias("tool_call_id"), F.when(x["turn"] % 3 != 0, F.array(call)).alias("tool_calls"))

    return rows.select(F.col("conv_id").alias("id"), F.transform("m", message).alias("messages")).select("id", traces.extract_tools("messages").alias("tools"))


@query("severity_text", sql("SELECT part_id, coalesce(nullif(concat_ws(' ', CASE WHEN n_critical > 0 THEN 'C' || n_critical END, CASE WHEN n_major > 0 THEN 'M' || n_major END, CASE WHEN n_minor > 0 THEN 'M' || n_minor END, CASE WHEN n_info > 0 THEN 'I' || n_info END), ''), '-') AS text FROM digest"))
def severity_text(spark, sf_dir) -> DataFrame:
    rows = scores.summarize_findings(checks.findings(checks.part_facts(binding.tables(spark, sf_dir))))
    return rows.select("part_id", S.severity_string({s: F.col(f"n_{s.lower()}") for s in scores.SEVERITIES}).alias("text"))


@query("preview", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...[truncated]' ELSE text END AS preview FROM documents")
def preview(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", S.preview("text").alias("preview"))


@query("drop_blank", "SELECT doc_id FROM documents WHERE doc_id % 10 NOT IN (3, 7) AND length(trim(text, ' ')) > 0")
def drop_blank(spark, sf_dir) -> DataFrame:
    k = F.col("doc_id") % 10
    rows = read(spark, sf_dir, "documents").select("doc_id", F.when(k == 3, "   ").when(k == 7, None).otherwise(F.col("text")).alias("text"))
    return documents.drop_blank(rows).select("doc_id")


@query("cross_entropy", f"WITH {_PRED} SELECT round(avg(-ln(greatest(1e-12, CASE WHEN quality = 1 THEN prob ELSE 1 - prob END))), 6) AS cross_entropy FROM predictions")
def cross_entropy(spark, sf_dir) -> DataFrame:
    rows = predictions(spark, sf_dir).select("quality", F.array(1 - F.col("prob"), "prob").alias("probs"))
    return datasets.cross_entropy(rows, "quality", "probs").select(_r("cross_entropy"))


@query(
    "order_parts",
    sql("SELECT part_id, row_number() OVER (ORDER BY coalesce(face_count, -1), part_id) - 1 AS place FROM everything"),
)
def order_parts(spark, sf_dir) -> DataFrame:
    """Parts in order of size, each with its place: sorted ranges and the number of rows before each."""
    t = binding.tables(spark, sf_dir)
    rows = scores.order_parts(catalog.all_parts(catalog.analyse(t)).select("part_id", "face_count"))
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    rows = stored(rows, "ordered")
    sizes = rows.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n")).collect()  # a row a range of the sort
    before, starts = 0, []
    for r in sorted(sizes):
        starts.append((r["range"], before))
        before += r["n"]
    offsets = spark.createDataFrame(starts, "range long, before long")
    rows = rows.withColumn("range", F.shiftright("at", 33)).join(F.broadcast(offsets), "range")
    return rows.select("part_id", (F.col("before") + F.col("at") - F.shiftleft(F.col("range"), 33)).alias("place"))


@query(
    "box_solids",
    sql(
        """SELECT part_id, 6 AS faces, round(2 * (x * y + y * z + x * z), 6) AS area, 12 AS edges, round(4 * (x + y + z), 6) AS length, 24 AS uses, 0 AS turns, 12 AS pairs
        FROM (SELECT part_id, xmax - xmin AS x, ymax - ymin AS y, zmax - zmin AS z FROM parts)""",
        False,
    ),
)
def box_solids(spark, sf_dir) -> DataFrame:
    """A box solid with the box of each part, closed: every edge is used once each way."""
    s = boxes.box_solid(binding.parts(spark, sf_dir).select("part_id", *BOX))
    out = s["faces"].groupBy("part_id").agg(F.count("*").alias("faces"), F.round(F.sum("area"), 6).alias("area"))
    out = out.join(s["edges"].groupBy("part_id").agg(F.count("*").alias("edges"), F.round(F.sum("length"), 6).alias("length")), "part_id")
    out = out.join(s["coedges"].groupBy("part_id").agg(F.count("*").alias("uses"), F.sum("orientation").alias("turns")), "part_id")
    return out.join(topology.face_adjacency(s["coedges"]).groupBy("part_id").agg(F.count("*").alias("pairs")), "part_id")


# --- bodies -----------------------------------------------------------------------------------------------------------

_BODY = "(part_id - 1) // 1000 AS part_id, (part_id - 1) % 1000 AS solid_id"


def _body_findings(spark, sf_dir) -> DataFrame:
    bodies = checks.measured(catalog.as_bodies(binding.tables(spark, sf_dir)), catalog.BODY)
    return checks.findings(bodies.judged, catalog.BODY)


@query(
    "body_top_findings",
    sql(f"SELECT {_BODY}, rank, \"check\", severity, total FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY {_RANK}, finding_seq) AS rank, count(*) OVER (PARTITION BY part_id) AS total FROM findings) WHERE rank <= 3", views=binding.BODIES),
)
def body_top_findings(spark, sf_dir) -> DataFrame:
    return scores.top_findings(_body_findings(spark, sf_dir), 3, catalog.BODY).select(*catalog.BODY, "rank", "check", "severity", "total")


@query("body_findings_summary", sql(f"SELECT {_BODY}, total, n_critical, n_major, n_minor, n_info FROM digest", views=binding.BODIES))
def body_findings_summary(spark, sf_dir) -> DataFrame:
    return scores.summarize_findings(_body_findings(spark, sf_dir), catalog.BODY).drop("major_checks")


@query(
    "body_fixes",
    sql(
        f"SELECT {_BODY}, rank, \"check\", severity, total_findings, count(*) OVER (PARTITION BY part_id) AS returned FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY {_RANK}, finding_seq) AS rank FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY part_id, \"check\" ORDER BY {_RANK}, finding_seq) AS nth, count(*) OVER (PARTITION BY part_id) AS total_findings FROM findings) WHERE nth = 1) WHERE rank <= 5",
        views=binding.BODIES,
    ),
)
def body_fixes(spark, sf_dir) -> DataFrame:
    return scores.suggest_fixes(_body_findings(spark, sf_dir), keys=catalog.BODY).select(*catalog.BODY, "rank", "check", "severity", "total_findings", "returned")
