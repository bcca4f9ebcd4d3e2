"""Queries of the data-set, trace, document and specification jobs, on tables derived from the driver's."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import in_place
from ..functions import scalars as S
from ..operators import checks, datasets, documents, graphnet, labelling, specs, topology, traces, validity
from ..schemas import BOX, MESSAGES
from ..sources.readers import source_list
from . import binding
from .binding import read, sql
from .queries import ORACLES, QUERIES, _r, query  # noqa: F401

# --- labels and predictions ----------------------------------------------------------------------

_PRED = "predictions AS (SELECT doc_id, quality, (n_chars % 100) / 100.0::DOUBLE AS prob, lang, CASE WHEN n_chars % 5 = 0 THEN 'en' ELSE lang END AS guess FROM labels JOIN documents USING (doc_id))"


def predictions(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "labels").select("doc_id", "quality").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return rows.select("doc_id", "quality", ((F.col("n_chars") % 100) / 100.0).alias("prob"), "lang", F.when(F.col("n_chars") % 5 == 0, "en").otherwise(F.col("lang")).alias("guess"))


@query(
    "binary_metrics",
    f"""WITH {_PRED}, c AS (SELECT count(*) AS n, count(*) FILTER (quality = 1 AND prob >= 0.5) AS tp, count(*) FILTER (quality <> 1 AND prob >= 0.5) AS fp, count(*) FILTER (quality = 1 AND prob < 0.5) AS fn, count(*) FILTER (quality <> 1 AND prob < 0.5) AS tn FROM predictions),
    m AS (SELECT *, (tp + tn) / n AS accuracy, tp / (tp + fp) AS "precision", tp / (tp + fn) AS recall FROM c) SELECT n, tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(2 * "precision" * recall / ("precision" + recall), 6) AS f1 FROM m""",
)
def binary_metrics(spark, sf_dir) -> DataFrame:
    return datasets.binary_metrics(predictions(spark, sf_dir), "quality", "prob").select("n", "tp", "fp", "fn", "tn", *[_r(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("regression_metrics", f"WITH {_PRED} SELECT round(avg((quality - prob) * (quality - prob)), 6) AS mse, round(avg(abs(quality - prob)), 6) AS mae FROM predictions")
def regression_metrics(spark, sf_dir) -> DataFrame:
    return datasets.regression_metrics(predictions(spark, sf_dir), "quality", "prob").select(_r("mse"), _r("mae"))


@query("class_metrics", f"WITH {_PRED} SELECT c AS class, count(lang) AS n, count(*) FILTER (lang = guess) AS \"right\", round(count(*) FILTER (lang = guess) / nullif(count(lang), 0), 6) AS accuracy FROM (SELECT unnest(['en', 'fr', 'de', 'es', 'xx']) AS c) LEFT JOIN predictions ON lang = c GROUP BY ALL")
def class_metrics(spark, sf_dir) -> DataFrame:
    return datasets.class_metrics(predictions(spark, sf_dir), "lang", "guess", ["en", "fr", "de", "es", "xx"]).select("class", "n", "right", _r("accuracy"))


@query("confusion_matrix", f"WITH {_PRED} SELECT lang, " + ", ".join(f"count(*) FILTER (guess = '{x}') AS {x}" for x in ("en", "fr", "de", "es")) + " FROM predictions GROUP BY ALL")
def confusion_matrix(spark, sf_dir) -> DataFrame:
    return datasets.confusion_matrix(predictions(spark, sf_dir), "lang", "guess", ["en", "fr", "de", "es"])


@query("majority_baseline", f"WITH {_PRED} SELECT round(max(n) / sum(n), 6) AS baseline FROM (SELECT count(*) AS n FROM predictions GROUP BY lang)")
def majority_baseline(spark, sf_dir) -> DataFrame:
    return datasets.majority_baseline(predictions(spark, sf_dir), "lang").select(_r("baseline"))


@query("loss_metrics", f"WITH {_PRED} SELECT round(avg(-(quality * ln(p) + (1 - quality) * ln(1 - p))), 6) AS bce, round(avg((quality - prob) * (quality - prob)), 6) AS mse FROM (SELECT *, greatest(1e-7, least(1 - 1e-7, prob)) AS p FROM predictions)")
def loss_metrics(spark, sf_dir) -> DataFrame:
    return datasets.loss_metrics(predictions(spark, sf_dir), "quality", "prob").select(_r("bce"), _r("mse"))


# --- labels of parts, splits, defects ------------------------------------------------------------


def _labels(spark, sf_dir):
    m = checks.measured(binding.tables(spark, sf_dir))
    return datasets.face_labels(m.faces)


@query("build_labels", sql("SELECT f.part_id, f.face_index, coalesce(score, 0) > 0.5 AS refinement, round(coalesce(score, 0), 6) AS rule_score FROM faces f JOIN good USING (part_id) LEFT JOIN rule_scores USING (part_id, face_index)"))
def build_labels(spark, sf_dir) -> DataFrame:
    return _labels(spark, sf_dir).select("part_id", "face_index", "refinement", _r("rule_score"))


@query("label_stats", sql("SELECT f.part_id, count(*) AS face_count, count(*) FILTER (score > 0.5) AS positive_refinement FROM faces f JOIN good USING (part_id) LEFT JOIN rule_scores USING (part_id, face_index) GROUP BY ALL"))
def label_stats(spark, sf_dir) -> DataFrame:
    return datasets.label_stats(_labels(spark, sf_dir))


@query("training_rows", sql("SELECT f.part_id, f.face_index, coalesce(score > 0.5, false) AS refinement FROM faces f LEFT JOIN (SELECT * FROM rule_scores WHERE score > 0.3) USING (part_id, face_index)"))
def training_rows(spark, sf_dir) -> DataFrame:
    t = binding.tables(spark, sf_dir)
    some = _labels(spark, sf_dir).filter("rule_score > 0.3").drop("rule_score")
    return in_place(datasets.training_rows(t.faces, some), "training-rows").select("part_id", "face_index", "refinement")


_CLASS = "CASE split_part(stem, '__', 2) WHEN 'open_shell' THEN 1 WHEN 'sliver_face' THEN 2 WHEN 'self_intersection' THEN 3 ELSE 0 END"


@query("graph_labels", sql(f"SELECT stem, {_CLASS} AS graph_label, split_part(stem, '__', 2) AS graph_label_name FROM parts", False))
def graph_labels(spark, sf_dir) -> DataFrame:
    p = binding.parts(spark, sf_dir)
    tags = p.select("stem", F.array(F.lit("unknown"), F.split_part("stem", F.lit("__"), F.lit(2))).alias("defect_tags"))
    return datasets.graph_labels(p, tags)


@query("split_by_source", sql("SELECT stem, split_part(stem, '__', 1) AS source, CASE WHEN source IN (SELECT source FROM (SELECT DISTINCT split_part(stem, '__', 1) AS source FROM parts) ORDER BY md5('7|' || source), source LIMIT (SELECT greatest(1, round_even(count(DISTINCT split_part(stem, '__', 1)) * 0.2, 0))::BIGINT FROM parts)) THEN 'val' ELSE 'train' END AS split FROM parts", False))
def split_by_source(spark, sf_dir) -> DataFrame:
    return datasets.split_by_source(binding.parts(spark, sf_dir).select("stem"), 0.2, 7)


@query("split_train_val", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('7|' || doc_id::VARCHAR), doc_id) <= greatest(1, (SELECT floor(count(*) * 0.2) FROM documents)) THEN 'val' ELSE 'train' END AS split FROM documents")
def split_train_val(spark, sf_dir) -> DataFrame:
    return datasets.split_train_val(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.2, 7)


@query("discover_samples", sql("SELECT stem FROM parts WHERE part_id % 10 <> 0 AND part_id % 7 <> 0 AND part_id % 3 <> 0", False))
def discover_samples(spark, sf_dir) -> DataFrame:
    p = binding.parts(spark, sf_dir)
    manifest = p.select("part_id", "stem", F.when(F.col("part_id") % 10 == 0, "error").otherwise("ok").alias("status"))
    return datasets.discover_samples(manifest, p.filter("part_id % 7 <> 0"), p.filter("part_id % 3 <> 0")).select("stem")


_BOXED = ", ".join(f"round(p.{c}, 6) AS {c}" for c in BOX)
_COUNTED = f"SELECT p.part_id, p.stem, {_BOXED}, coalesce(f.n, 0) AS faces, coalesce(c.n, 0) AS coedges, coalesce(e.n, 0) AS edges, coalesce(s.n, 0) AS solids FROM parts p " + " ".join(
    f"LEFT JOIN (SELECT part_id, count(*) AS n FROM {t} GROUP BY ALL) {t[0]} USING (part_id)" for t in ("faces", "coedges", "edges", "solids")
)


def _defect_rows(spark, sf_dir, defect) -> DataFrame:
    """Boxes of the degraded parts and how many rows each of their tables has."""
    t = datasets.settled(datasets.inject_defect(binding.tables(spark, sf_dir), defect)[0])
    out = t.parts.select("part_id", "stem", *[_r(c) for c in BOX])
    for name in ("faces", "coedges", "edges", "solids"):
        out = out.join(getattr(t, name).groupBy("part_id").agg(F.count("*").alias(name)), "part_id", "left")
    return out.na.fill(0, ["faces", "coedges", "edges", "solids"])


def _defect_findings(spark, sf_dir, defect) -> DataFrame:
    """What the checks say of the degraded parts."""
    t = datasets.settled(datasets.inject_defect(binding.tables(spark, sf_dir), defect)[0])
    return checks.findings(checks.part_facts(t)).select("part_id", "finding_seq", "check", "severity", _r("measure"))


for _d, _views in binding.DEGRADED.items():
    query(f"inject_{_d}", sql(_COUNTED, False, _views))(lambda spark, sf_dir, d=_d: _defect_rows(spark, sf_dir, d))
    query(f"findings_{_d}", sql('SELECT part_id, finding_seq, "check", severity, round(measure, 6) AS measure FROM findings', views=_views))(lambda spark, sf_dir, d=_d: _defect_findings(spark, sf_dir, d))


_MANIFEST = f"""SELECT stem AS input_file, status, CASE status WHEN 'ok' THEN NULL WHEN 'error' THEN load_check ELSE CASE WHEN valid THEN 'empty_graph' ELSE 'validation_failed' END END AS reason,
CASE WHEN status = 'ok' THEN stem END AS stem, CASE WHEN status = 'ok' THEN n END AS face_count, CASE WHEN status = 'ok' THEN k END AS positive_refinement, CASE WHEN status = 'ok' THEN g END AS graph_label, CASE WHEN status = 'ok' THEN split_part(stem, '__', 2) END AS graph_label_name
FROM (SELECT stem, load_check, is_valid AND load_check IS NULL AS valid, n, k, {_CLASS} AS g, CASE WHEN load_check IN ('AnalysisError', 'AnalysisTimeout') THEN 'error' WHEN load_check IS NOT NULL OR NOT is_valid OR n IS NULL THEN 'skipped' ELSE 'ok' END AS status
FROM parts LEFT JOIN (SELECT f.part_id, count(*) AS n, count(*) FILTER (score > 0.5) AS k FROM faces f LEFT JOIN rule_scores USING (part_id, face_index) GROUP BY ALL) USING (part_id))"""


@query("label_manifest", sql(_MANIFEST))
def label_manifest(spark, sf_dir) -> DataFrame:
    """Every part labelled, skipped or an error."""
    t = binding.tables(spark, sf_dir)
    tags = t.parts.select("stem", F.array(F.split_part("stem", F.lit("__"), F.lit(2))).alias("defect_tags"))
    return labelling.label_parts(checks.measured(t), tags).select(*labelling.MANIFEST)


_HEALED = "(SELECT part_id, load_check, part_id % 5 <> 0 AS b, part_id % 3 <> 0 AS a, load_check IS NULL AS loaded FROM parts)"


@query(
    "validity",
    sql(
        f"""SELECT part_id, loaded AND (a OR b) AS judged, loaded AND a AS is_valid, CASE WHEN NOT loaded THEN load_check WHEN NOT a THEN 'BRepCheckFailure' END AS error,
        CASE WHEN loaded AND a AND NOT b THEN 'BRepCheckFailure' END AS initial_error, CASE WHEN loaded AND a AND NOT b THEN true END AS healed, loaded AS attempted, CASE WHEN loaded THEN b END AS valid_before,
        CASE WHEN loaded THEN a END AS valid_after FROM {_HEALED}""",
        False,
    ),
)
def validity_states(spark, sf_dir) -> DataFrame:
    """All four states of validity before and after healing, and parts that did not load."""
    p = binding.parts(spark, sf_dir).withColumns({"valid_before": F.expr("part_id % 5 <> 0"), "valid_after": F.expr("part_id % 3 <> 0")})
    judged = validity.split_valid(p)[0].select("part_id", F.lit(True).alias("judged"))
    rows = validity.with_validity(p).join(judged, "part_id", "left")
    v, h = F.col("validation"), F.col("heal")
    first = lambda x: F.try_element_at(x, F.lit(1))["check"]
    return rows.select(
        "part_id", F.coalesce("judged", F.lit(False)).alias("judged"), v["is_valid"].alias("is_valid"), first(v["errors"]).alias("error"), first(v["initial_errors"]).alias("initial_error"),
        v["healed_after_validation_failure"].alias("healed"), h["attempted"].alias("attempted"), h["valid_before"].alias("valid_before"), h["valid_after"].alias("valid_after"),
    )


@query("class_counts", sql(f"SELECT {_CLASS} AS graph_label, count(*) AS count FROM parts GROUP BY ALL", False))
def class_counts(spark, sf_dir) -> DataFrame:
    rows = graph_labels(spark, sf_dir).select("stem", "graph_label")
    return datasets.class_counts(datasets.assemble_dataset(rows.filter("graph_label = 0"), rows.filter("graph_label > 0").unionByName(rows.filter("graph_label = 1"))))


def _params() -> graphnet.Params:
    rng = np.random.default_rng(1)
    m = lambda *s: rng.normal(0, 0.3, s)
    return graphnet.Params([(m(12, 8), m(8), m(12, 8)), (m(8, 8), m(8), m(8, 8))], (m(8), 0.1), (m(8), -0.1), (m(8, 4), m(4)))


def _network_sql(p: graphnet.Params) -> str:
    """The network in SQL: vectors as rows (part, face, place, value), weights as tables."""
    values = lambda name, rows: f"{name} AS (SELECT * FROM (VALUES {', '.join(map(str, rows))}) AS t({', '.join('ijw'[3 - len(rows[0]) :])}))"
    table = lambda m: [(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])]
    column = lambda v: [(i, float(x)) for i, x in enumerate(v)]
    hot = ", ".join(f"(surface_type = '{x}')::INT::DOUBLE" for x in ("plane", "cylinder", "cone", "sphere", "torus", "bspline", "other"))
    out = [
        "both_ways AS (SELECT part_id, face_a AS src, face_b AS dst FROM adjacency UNION ALL SELECT part_id, face_b, face_a FROM adjacency)",
        f"x0 AS (SELECT part_id, face_index, unnest([{hot}, ln(1 + area), abs(nx) + abs(ny) + abs(nz), mean_curvature, du, dv]) AS v, unnest(range(12)) AS i FROM faces)",
    ]
    for k, (neigh, bias, own) in enumerate(p.layers):
        out += [values(f"neigh{k}", table(neigh)), values(f"own{k}", table(own)), values(f"bias{k}", column(bias))]
        out.append(f"mean{k} AS (SELECT b.part_id, b.dst AS face_index, i, avg(v) AS v FROM both_ways b JOIN x{k} x ON x.part_id = b.part_id AND x.face_index = b.src GROUP BY ALL)")
        total = f"SELECT part_id, face_index, j, v * w AS s FROM mean{k} JOIN neigh{k} USING (i) UNION ALL SELECT part_id, face_index, j, v * w FROM x{k} JOIN own{k} USING (i) UNION ALL SELECT part_id, face_index, j, w FROM (SELECT DISTINCT part_id, face_index FROM x{k}), bias{k}"
        out.append(f"x{k + 1} AS (SELECT part_id, face_index, j AS i, {'sum(s)' if k == len(p.layers) - 1 else 'greatest(0, sum(s))'} AS v FROM ({total}) GROUP BY ALL)")
    for name, (w, _) in (("refine", p.refine), ("complexity", p.complexity)):
        out.append(f"w_{name} AS (SELECT i, w FROM (VALUES {', '.join(map(str, column(w)))}) AS t(i, w))")
    out.append(f"w_defect AS (SELECT * FROM (VALUES {', '.join(map(str, table(p.defect[0])))}) AS t(i, j, w))")
    out.append(f"b_defect AS (SELECT * FROM (VALUES {', '.join(map(str, column(p.defect[1])))}) AS t(j, w))")
    return ", ".join(out)


_P = _params()
_TOP = f"x{len(_P.layers)}"
_SAGE = sql("", False).rstrip() + ", " + _network_sql(_P)


@query(
    "sage_scores",
    f"""{_SAGE} SELECT part_id, face_index, round(0.5 / (1 + exp(-(sum(v * r.w) + {_P.refine[1]}))) + 0.5 / (1 + exp(-(sum(v * c.w) + {_P.complexity[1]}))), 6) AS score, 'learned' AS score_source
    FROM {_TOP} JOIN w_refine r USING (i) JOIN w_complexity c USING (i) GROUP BY ALL""",
)
def sage_scores(spark, sf_dir) -> DataFrame:
    return graphnet.score_faces(binding.tables(spark, sf_dir), _P).select("part_id", "face_index", _r("score"), "score_source")


@query(
    "sage_defects",
    f"""{_SAGE}, pooled AS (SELECT part_id, i, avg(v) AS v FROM {_TOP} GROUP BY ALL), z AS (SELECT part_id, j, sum(v * d.w) + any_value(b.w) AS z FROM pooled JOIN w_defect d USING (i) JOIN b_defect b USING (j) GROUP BY ALL)
    SELECT part_id, ['clean', 'open_shell', 'sliver_face', 'self_intersection'][arg_max(j, z)::BIGINT + 1] AS defect, round(exp(max(z)) / sum(exp(z)), 6) AS confidence FROM z GROUP BY part_id""",
)
def sage_defects(spark, sf_dir) -> DataFrame:
    t = binding.tables(spark, sf_dir)
    x = graphnet.part_means(S.face_feature_vector(t.faces).select("part_id", "face_index", "features"), topology.face_adjacency(t.coedges), _P)
    return graphnet.graph_head(x, _P).select("part_id", "defect", _r("confidence"))


# --- traces --------------------------------------------------------------------------------------


def conversation_traces(spark, sf_dir) -> DataFrame:
    """Conversations as traces: messages by turn; a trace stopped properly if an assistant spoke last."""
    one = F.struct("turn", "role", "text")
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("m"))
    null = F.lit(None)
    calls = f"array<{MESSAGES.split('tool_calls:array<')[1][:-2]}"
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"), null.cast("string").alias("tool_call_id"), null.cast(calls).alias("tool_calls")))
    last = F.element_at("m", -1)
    return rows.select(
        F.col("conv_id").alias("id"), messages.alias("messages"), last["text"].alias("final_text"), F.when(last["role"] == "assistant", "stop").otherwise("max_iterations").alias("stop_reason"),
        F.when(F.col("conv_id") % 3 == 0, "standards").otherwise("file").alias("category"),
    )


_TRACES = """traces AS (SELECT conv_id AS id, list(role ORDER BY turn, role, text) AS roles, list(text ORDER BY turn, role, text) AS texts, coalesce(sum(length(text)), 0)::BIGINT // 4 AS token_estimate, roles[-1] = 'assistant' AS stopped, texts[-1] AS final_text,
CASE WHEN conv_id % 3 = 0 THEN 'standards' ELSE 'file' END AS category FROM conversations GROUP BY conv_id)"""


@query("prep_report", f"WITH {_TRACES} SELECT count(*) AS total, count(*) FILTER (NOT stopped) AS incomplete, 0 AS empty, count(*) FILTER (stopped AND token_estimate > 300) AS over_cap, count(*) FILTER (stopped AND token_estimate <= 300) AS kept FROM traces")
def prep_report(spark, sf_dir) -> DataFrame:
    return traces.prep_report(conversation_traces(spark, sf_dir), 300)


@query("filter_traces", f"WITH {_TRACES} SELECT id, token_estimate FROM traces WHERE stopped AND token_estimate <= 300")
def filter_traces(spark, sf_dir) -> DataFrame:
    return traces.filter_traces(conversation_traces(spark, sf_dir), 300).select("id", "token_estimate")


@query("nearest_rank", f"WITH {_TRACES}, r AS (SELECT token_estimate, row_number() OVER (ORDER BY token_estimate) - 1 AS i, count(*) OVER () AS n FROM traces) SELECT p::INT AS percent, token_estimate AS value FROM r JOIN (SELECT unnest([25, 50, 75, 95]) AS p) ON i = least(n * p // 100, n - 1)")
def nearest_rank(spark, sf_dir) -> DataFrame:
    return traces.nearest_rank(traces.with_drop_reason(conversation_traces(spark, sf_dir)), "token_estimate")


_RANKS = ", ".join(f"(list(token_estimate ORDER BY token_estimate))[least(count(*) * {p} // 100, count(*) - 1) + 1] AS p{p}" for p in (25, 50, 75, 95))


@query(
    "split_stats",
    f"""WITH {_TRACES}, s AS (SELECT *, CASE WHEN stopped THEN 'train' ELSE 'val' END AS split FROM traces) SELECT split, category, count(*) AS n, max(token_estimate) AS max_tokens, count(*) FILTER (token_estimate > 2048) AS over_2048, any_value(p25) AS p25,
    any_value(p50) AS p50, any_value(p75) AS p75, any_value(p95) AS p95 FROM s JOIN (SELECT split, {_RANKS} FROM s GROUP BY split) USING (split) GROUP BY split, category""",
)
def split_stats(spark, sf_dir) -> DataFrame:
    rows = traces.with_drop_reason(conversation_traces(spark, sf_dir)).withColumn("split", F.when(F.col("stop_reason") == "stop", "train").otherwise("val"))
    return traces.split_stats(rows)


@query("chatml", f"WITH {_TRACES} SELECT id, array_to_string(list_transform(list_zip(list_filter(roles, lambda r: true), texts), lambda z: '<|im_start|>' || z[1] || chr(10) || trim(z[2], ' ') || '<|im_end|>'), chr(10)) AS text FROM traces")
def chatml(spark, sf_dir) -> DataFrame:
    return conversation_traces(spark, sf_dir).select("id", traces.to_chatml(traces.convert_messages("messages")).alias("text"))


def _eval_rows(spark, sf_dir):
    arr = lambda *x: F.array(*map(F.lit, x))
    rows = conversation_traces(spark, sf_dir)
    return rows.select(
        "id", "category", "final_text", arr("analyze", "suggest").alias("expected_tool_calls"), F.when(F.col("id") % 5 != 0, arr("the", "de")).alias("expected_answer_themes"),
        F.when(F.col("id") % 4 == 0, arr("analyze", "suggest")).when(F.col("id") % 4 == 1, arr("suggest", "analyze")).when(F.col("id") % 4 == 2, arr("analyze"))
        .when(F.col("id") % 8 == 3, arr("analyze", "analyze", "suggest")).otherwise(arr("lookup", "analyze", "suggest")).alias("tool_calls"),
        F.when(F.col("id") % 11 == 0, "timeout").alias("error"),
    )


# calls are in order if those expected are made in the expected order, each as often: not in 1 of 4 (swapped) and 3 of 8 (one repeated)
@query(
    "aggregate_eval",
    f"""WITH {_TRACES} SELECT category, count(*) FILTER (id % 11 <> 0) AS n, count(*) FILTER (id % 11 = 0) AS n_error, round(avg(CASE WHEN id % 4 < 2 OR id % 8 = 3 THEN 1 ELSE 0 END) FILTER (id % 11 <> 0), 6) AS exact,
    round(avg(CASE WHEN id % 4 <> 2 THEN 1 ELSE 0 END) FILTER (id % 11 <> 0), 6) AS partial, round(avg(CASE WHEN id % 4 = 1 OR id % 8 = 3 THEN 0 ELSE 1 END) FILTER (id % 11 <> 0), 6) AS order_ok,
    round(avg(CASE WHEN contains(lower(final_text), 'verdict:') THEN 1 ELSE 0 END) FILTER (id % 11 <> 0), 6) AS format_ok, round(avg(CASE WHEN contains(lower(final_text), 'issues:') AND contains(lower(final_text), 'fixes:') THEN 1 ELSE 0 END) FILTER (id % 11 <> 0), 6) AS sections_ok,
    round(avg(CASE WHEN contains(lower(final_text), 'the') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(final_text), 'de') THEN 0.5 ELSE 0 END) FILTER (id % 11 <> 0 AND id % 5 <> 0), 6) AS theme_rate FROM traces GROUP BY ALL""",
)
def aggregate_eval(spark, sf_dir) -> DataFrame:
    out = traces.aggregate_eval(traces.score_traces(_eval_rows(spark, sf_dir)), ["category"])
    return out.select("category", "n", "n_error", *[_r(c) for c in ("exact", "partial", "order_ok", "format_ok", "sections_ok", "theme_rate")])


@query("hold_out", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def hold_out(spark, sf_dir) -> DataFrame:
    return traces.hold_out(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id")


@query("drop_missing", "SELECT doc_id FROM documents WHERE lang = 'fr' OR source IN (SELECT DISTINCT source FROM documents WHERE lang = 'de' AND n_chars > 5000)")
def drop_missing(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    gold = d.select("doc_id", F.when(F.col("lang") != "fr", F.col("source")).alias("step_path"))
    return traces.drop_missing(gold, d.filter("lang = 'de' and n_chars > 5000").select(F.col("source").alias("path")).distinct())[0].select("doc_id")


@query(
    "seed_pool",
    sql(
        """, sizes AS (SELECT count(*) AS n, floor(count(*) * 0.12)::BIGINT AS s FROM parts), grid AS (SELECT stem AS path, template, 'file' AS category, 0 AS turn FROM parts, (SELECT unnest(['What is wrong?', 'Is it thin?']) AS template)),
        chosen AS (SELECT * FROM grid ORDER BY md5('0|' || path || '|' || template), path, template LIMIT (SELECT n - s FROM sizes)), pool AS (SELECT * FROM chosen UNION ALL SELECT NULL, 'Which standard?', 'standards', unnest(range(0, s)) FROM sizes)
        SELECT md5(coalesce(path, '-') || '|' || template || '|' || turn) AS seed_id, path, template, category FROM pool""",
        False,
    ),
)
def seed_pool(spark, sf_dir) -> DataFrame:
    """One seed a part: every stem with a template, and standards questions."""
    p = binding.parts(spark, sf_dir).select(F.col("stem").alias("path"))
    templates = spark.createDataFrame([("What is wrong?", "file"), ("Is it thin?", "file"), ("Which standard?", "standards")], "template string, category string")
    return traces.build_seed_pool(p, templates, p.count()).select("seed_id", "path", "template", "category")


# --- events as run events and stage timings --------------------------------------------------------


def timings(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("part"), (F.col("user_id") % 4).cast("string")).alias("part"), F.col("event_type").alias("stage"), F.col("value").alias("seconds"), ((F.col("event_type") == "error") & (F.col("value") > 50)).alias("timeout"))


_TIMINGS = "timings AS (SELECT 'part' || (user_id % 4) AS part, event_type AS stage, value AS seconds, event_type = 'error' AND value > 50 AS timeout FROM events)"


@query("stage_matrix", f"WITH {_TIMINGS} SELECT stage, " + ", ".join(f"round(max(seconds) FILTER (part = 'part{i}'), 6) AS part{i}" for i in range(4)) + " FROM timings GROUP BY ALL")
def stage_matrix(spark, sf_dir) -> DataFrame:
    return traces.stage_matrix(timings(spark, sf_dir), [f"part{i}" for i in range(4)])


@query("culprits", f"WITH {_TIMINGS} SELECT stage, count(*) AS timeouts, max(seconds) AS worst FROM timings WHERE timeout GROUP BY ALL")
def culprits(spark, sf_dir) -> DataFrame:
    return traces.culprits(timings(spark, sf_dir))


@query("mark_blocked", f"WITH {_TIMINGS} SELECT part, stage, count(*) AS n, bool_or(stage = 'purchase' AND part IN (SELECT part FROM timings WHERE timeout)) AS blocked FROM timings GROUP BY ALL")
def mark_blocked(spark, sf_dir) -> DataFrame:
    prereqs = spark.createDataFrame([("purchase", "error")], "stage string, prereq string")
    return traces.mark_blocked(timings(spark, sf_dir), prereqs).groupBy("part", "stage").agg(F.count("*").alias("n"), F.bool_or("blocked").alias("blocked"))


@query(
    "fold_events",
    """SELECT user_id AS run_id, count(*) FILTER (event_type = 'view') AS iterations, coalesce(list(event_type || (event_id % 3) ORDER BY event_id) FILTER (event_type = 'click'), []) AS tool_calls,
    CASE WHEN bool_or(event_type = 'error') THEN 'max_iterations' WHEN bool_or(event_type = 'purchase') THEN 'stop' END AS stop_reason FROM events GROUP BY ALL""",
)
def fold_events(spark, sf_dir) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for kv in (("view", "iteration_start"), ("click", "tool_call"), ("error", "max_iterations"), ("purchase", "final_text")) for x in kv])
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.try_element_at(kind, "event_type").alias("type"), F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("name"))
    return traces.fold_events(e)


@query("sum_usage", "SELECT user_id AS run_id, sum(event_id % 7)::BIGINT AS tokens_in, sum(event_id % 5)::BIGINT AS tokens_out, min_by(event_type, event_id) AS model FROM events GROUP BY ALL")
def sum_usage(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 7).alias("tokens_in"), (F.col("event_id") % 5).alias("tokens_out"), F.col("event_type").alias("model"))
    return traces.sum_usage(e)


@query("last_build", "SELECT user_id AS run_id, seq, valid, spec FROM (SELECT user_id, event_id AS seq, value > 20 AS valid, event_type AS spec, row_number() OVER (PARTITION BY user_id ORDER BY value > 20 DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def last_build(spark, sf_dir) -> DataFrame:
    return traces.last_build(read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), (F.col("value") > 20).alias("valid"), F.col("event_type").alias("spec")))


_GATE = "(SELECT p_brand AS model, p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 AND p_size BETWEEN 10 AND 40 AS passed, p_retailprice / 20 AS wall_seconds FROM part)"


@query("gen_gate", f"SELECT model, count(*) AS n, round(avg(CASE WHEN passed THEN 1 ELSE 0 END), 6) AS pass_rate, round(min(wall_seconds), 6) AS fastest, round(max(wall_seconds), 6) AS slowest FROM {_GATE} GROUP BY ALL")
def gen_gate(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("model"), (F.col("p_partkey") % 13 != 0).alias("step_exists"), (F.col("p_partkey") % 17 != 0).alias("occ_valid"), F.col("p_size").alias("faces"), F.array(F.lit(10), F.lit(40)).alias("expect_faces"), (F.col("p_retailprice") / 20).alias("wall_seconds")
    )
    return traces.gate_summary(traces.gen_gate(rows)).select("model", "n", _r("pass_rate"), _r("fastest"), _r("slowest"))


@query(
    "validate_specs",
    """SELECT p_partkey AS spec_id, error IS NULL AS valid, error FROM (SELECT p_partkey, CASE p_partkey % 7 WHEN 1 THEN 'step 1: unknown op' WHEN 2 THEN 'step 2: reference to the same step twice' WHEN 3 THEN 'step 0: never used' WHEN 4 THEN 'step 0: unknown field' WHEN 5 THEN 'step 0: size out of range' WHEN 6 THEN 'unknown field' END AS error FROM part)""",
)
def validate_specs(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey") % 7
    box = F.concat(F.lit('{"op":"box","dx":'), F.when(k == 5, "1000.5").otherwise(F.col("p_size").cast("string")), F.lit(',"dy":5,"dz":5'), F.when(k == 4, ',"color":1').otherwise(""), F.lit("}"))
    cyl = F.concat(F.lit('{"op":"'), F.when(k == 1, "cone").otherwise("cyl"), F.lit('","r":2,"h":9,"at":[0,0,1]}'))
    cut = F.concat(F.lit('{"op":"cut","a":'), F.when(k == 3, "1").otherwise("0"), F.lit(',"b":'), F.when(k == 2, "0").otherwise("1"), F.lit("}"))
    cut = F.when(k == 3, F.lit('{"op":"box","dx":1,"dy":1,"dz":1}')).otherwise(cut)
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("spec_id"), F.concat(F.lit('{"steps":['), box, F.lit(","), cyl, F.lit(","), cut, F.lit("]"), F.when(k == 6, ',"rotation":45').otherwise(""), F.lit("}")).alias("spec_json"))
    return specs.validate_specs(rows)


# --- documents -----------------------------------------------------------------------------------


def _chunks(spark, sf_dir):
    pages = read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), "text")
    return documents.chunk_documents(pages, paragraph=r"\n")


# Texts between chr(1) are chunks so far, between chr(2) sentences; no text holds either.
_LAST = "length(list_last(string_split(acc, chr(1))))"
_CHUNKS = f"""lines AS (SELECT source, doc_id AS page, list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(p)), lambda p: p <> '') AS ps FROM documents),
grouped AS (SELECT source, page, string_split(list_reduce(ps, lambda acc, p: CASE WHEN {_LAST} < 200 THEN acc || chr(10) || chr(10) || p ELSE acc || chr(1) || p END), chr(1)) AS gs FROM lines WHERE len(ps) > 0),
each AS (SELECT source, page, unnest(gs) AS g, unnest(range(len(gs))) AS k FROM grouped),
cut AS (SELECT source, page, k, g, list_transform(string_split(regexp_replace(g, '([.!?])\\s+([A-Z(])', '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda s: array_to_string(list_transform(range((length(s) + 1499) // 1500), lambda i: substr(s, i * 1500 + 1, 1500)), chr(1))) AS ss FROM each),
packed AS (SELECT source, page, k, CASE WHEN length(g) <= 1500 THEN [g] ELSE string_split(list_reduce(ss, lambda acc, s: CASE WHEN {_LAST} + 1 + length(s) <= 1500 THEN acc || ' ' || s ELSE acc || chr(1) || s END), chr(1)) END AS cs FROM cut),
chunks AS (SELECT source, page, row_number() OVER (PARTITION BY source ORDER BY page, k, j) - 1 AS chunk_id, text FROM (SELECT source, page, k, unnest(cs) AS text, unnest(range(len(cs))) AS j FROM packed))"""


@query("chunk_documents", f"WITH {_CHUNKS} SELECT * FROM chunks")
def chunk_documents(spark, sf_dir) -> DataFrame:
    return _chunks(spark, sf_dir)


@query("build_index", f"WITH {_CHUNKS} SELECT *, list_transform(range(16), lambda i: CASE WHEN i = list_sum(list_transform(string_split(text, ''), lambda c: unicode(c))) % 16 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS embedding FROM chunks")
def build_index(spark, sf_dir) -> DataFrame:
    return documents.build_index(_chunks(spark, sf_dir), dim=16)[0]


@query(
    "vector_search",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v)
    SELECT query_id, rank, key, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, d.vec_id AS key, list_dot_product(q.e, d.e) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, d.e) DESC, d.vec_id) AS rank FROM n q, n d WHERE q.vec_id % 100 = 0) WHERE rank <= 3""",
)
def vector_search(spark, sf_dir) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), S.l2_normalize(F.col("embedding").cast("array<double>")).alias("embedding"))
    queries = v.filter("key % 100 = 0").select(F.col("key").alias("query_id"), "embedding")  # the stated query set
    return documents.search(queries, v, 3).select("query_id", F.col("rank").cast("long").alias("rank"), "key", _r("score"))


@query("source_list", "SELECT url, CASE WHEN lower(f) LIKE '%.pdf' THEN f ELSE f || '.pdf' END AS file_name FROM (SELECT split_part(url, '#', 1) AS url, CASE WHEN name = '' THEN 'download' ELSE name END AS f FROM (SELECT url, regexp_extract(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '^https?://[^/]*', ''), '([^/]*)$', 1) AS name FROM pages))")
def sources(spark, sf_dir) -> DataFrame:
    return source_list(read(spark, sf_dir, "pages"), "url")


