"""Registered queries over the driver's tables, each with its DuckDB counterpart where SQL can say it."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import in_place
from ..functions import scalars as S
from ..operators import checks, scores, topology
from . import binding, catalog
from .binding import sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _r(c: str, n: int = 6):
    """Rounded, so that both engines agree on the last digits."""
    return F.round(F.col(c), n).alias(c)


def _analysed(spark, sf_dir):
    t = binding.tables(spark, sf_dir)
    return t, catalog.analyse(t)


@query(
    "catalog_scores",
    sql("SELECT part_id, face_count, total, n_critical, n_major, n_minor, n_info, round(rule_face_mean, 9) AS rule_face_mean, round(overall, 9) AS overall, label, tier FROM everything"),
)
def catalog_scores(spark, sf_dir) -> DataFrame:
    parts = catalog.all_parts(_analysed(spark, sf_dir)[1])
    return parts.select("part_id", "face_count", "total", "n_critical", "n_major", "n_minor", "n_info", _r("rule_face_mean", 9), _r("overall", 9), "label", F.col("complexity.tier").alias("tier"))


@query("split_valid", sql("SELECT part_id, stem, coalesce(load_check, 'BRepCheckFailure') AS \"check\" FROM parts WHERE load_check IS NOT NULL OR NOT is_valid", False))
def split_valid(spark, sf_dir) -> DataFrame:
    return checks.split_valid(binding.tables(spark, sf_dir).parts)[1].select("part_id", "stem", "check")


@query("findings", sql("SELECT part_id, finding_seq, \"check\", severity, round(measure, 6) AS measure FROM findings"))
def all_findings(spark, sf_dir) -> DataFrame:
    return checks.findings(checks.part_facts(binding.tables(spark, sf_dir))).select("part_id", "finding_seq", "check", "severity", _r("measure"))


for _name in list(checks.NAMES):

    def _one(spark, sf_dir, name=_name):
        return all_findings(spark, sf_dir).filter(F.col("check") == name)

    query("check_" + "".join("_" + x.lower() if x.isupper() else x for x in _name).lstrip("_"), sql(f"SELECT part_id, finding_seq, \"check\", severity, round(measure, 6) AS measure FROM findings WHERE \"check\" = '{_name}'"))(_one)


@query("rule_scores", sql("SELECT part_id, face_index, round(score, 6) AS score FROM rule_scores"))
def rule_scores(spark, sf_dir) -> DataFrame:
    return checks.rule_scores(binding.tables(spark, sf_dir)).select("part_id", "face_index", _r("score"))


def _failing() -> list[tuple[str, checks.Check]]:
    """Checks of which some parts make an error: a division by zero, a cast of text, an index beyond its array."""
    left, none = F.col("face_count") % 5, F.lit(None).cast("double")
    text = F.when(F.col("part_id") % 7 == 0, "n/a").otherwise(F.col("face_count").cast("string"))
    place = F.when((F.col("part_id") % 37 == 3) & (F.col("face_index") < 2), 1).otherwise(0)
    make = lambda name, fires, measure, **more: (name, checks.Check(name, fires, F.lit("Minor"), measure, none, F.lit("x"), "y", **more))
    return [
        make("Divides", F.lit(100) / left > 30, F.lit(100) / left), make("Casts", text.cast("int") > 20, text.cast("double")),
        make("Indexes", F.col("face_count") > 30, F.col("face_count"), face_score=F.array("area")[place]),
    ]


@query(
    "isolated_checks",
    sql(
        """, own AS (SELECT part_id, face_count, face_count % 5 AS m FROM facts), more AS (
          SELECT part_id, 18 AS seq, 'Divides' AS name, m = 0 AS bad, 1.0 AS n, 100 / nullif(m, 0) AS measure, 100 / nullif(m, 0) > 30 AS fires FROM own
          UNION ALL SELECT part_id, 19, 'Casts', part_id % 7 = 0, 1, face_count, face_count > 20 FROM own
          UNION ALL SELECT part_id, 20, 'Indexes', part_id % 37 = 3 AND face_count > 0, least(face_count, 2), face_count, face_count > 30 FROM own),
        rows AS (SELECT part_id, finding_seq, "check", severity, measure FROM findings WHERE (part_id, finding_seq) NOT IN (SELECT (part_id, seq) FROM lost) UNION ALL SELECT part_id, seq, 'CheckSkipped', 'Info', n FROM lost
          UNION ALL SELECT part_id, seq, CASE WHEN bad THEN 'CheckSkipped' ELSE name END, CASE WHEN bad THEN 'Info' ELSE 'Minor' END, CASE WHEN bad THEN n ELSE measure END FROM more WHERE bad OR fires)
        SELECT part_id, finding_seq, "check", severity, round(measure, 6) AS measure FROM rows""",
        views=binding.MALFORMED,
    ).replace("rule_rows AS (", f"{binding.LOST.strip()}, rule_rows AS (", 1),
)
def isolated_checks(spark, sf_dir) -> DataFrame:
    """Findings of parts with values that cannot be computed, by the checks of the catalog and by some that fail."""
    t = binding.malformed(binding.tables(spark, sf_dir))
    m = checks.Measured(t, topology.PART, [*checks.registered(), *_failing()])
    return checks.findings(m.judged).select("part_id", "finding_seq", "check", "severity", _r("measure"))


@query("findings_summary", sql("SELECT d.*, coalesce(m.major_checks, []) AS major_checks FROM digest d LEFT JOIN (SELECT part_id, list(\"check\" ORDER BY finding_seq) AS major_checks FROM findings WHERE severity = 'Major' GROUP BY ALL) m USING (part_id)"))
def findings_summary(spark, sf_dir) -> DataFrame:
    return scores.summarize_findings(checks.findings(checks.part_facts(binding.tables(spark, sf_dir))))


_RANK = "CASE severity WHEN 'Critical' THEN 0 WHEN 'Major' THEN 1 WHEN 'Minor' THEN 2 ELSE 3 END"


@query("top_findings", sql(f"SELECT part_id, rank, \"check\", severity, total FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY {_RANK}, finding_seq) AS rank, count(*) OVER (PARTITION BY part_id) AS total FROM findings) WHERE rank <= 3"))
def top_findings(spark, sf_dir) -> DataFrame:
    return scores.top_findings(_found(spark, sf_dir), 3).select("part_id", "rank", "check", "severity", "total")


def _found(spark, sf_dir):
    return checks.findings(checks.part_facts(binding.tables(spark, sf_dir)))


@query("head_findings", sql("SELECT part_id, rank, \"check\" FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY finding_seq) AS rank FROM findings) WHERE rank <= 8"))
def head_findings(spark, sf_dir) -> DataFrame:
    return scores.head_findings(_found(spark, sf_dir)).select("part_id", "rank", "check")


@query(
    "suggest_fixes",
    sql(
        f"SELECT part_id, rank, \"check\", severity, total_findings, count(*) OVER (PARTITION BY part_id) AS returned FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY {_RANK}, finding_seq) AS rank FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY part_id, \"check\" ORDER BY {_RANK}, finding_seq) AS nth, count(*) OVER (PARTITION BY part_id) AS total_findings FROM findings) WHERE nth = 1) WHERE rank <= 5"
    ),
)
def suggest_fixes(spark, sf_dir) -> DataFrame:
    return scores.suggest_fixes(_found(spark, sf_dir)).select("part_id", "rank", "check", "severity", "total_findings", "returned")


@query("finding_status", sql("SELECT part_id, CASE WHEN label = 'InvalidInput' OR n_critical > 0 THEN 'InvalidInput' WHEN n_major > 0 THEN 'NeedsAttention' WHEN total > 0 THEN 'ReviewRecommended' ELSE 'SimulationReady' END AS finding_status FROM everything"))
def finding_status(spark, sf_dir) -> DataFrame:
    """Parts that failed to load count as one critical finding."""
    t = binding.tables(spark, sf_dir)
    failed = checks.split_valid(t.parts)[1].select("part_id", F.lit(0).alias("finding_seq"), "check", F.lit("Critical").alias("severity"))
    return scores.finding_status(t.parts, _found(spark, sf_dir).select("part_id", "finding_seq", "check", "severity").unionByName(failed))


@query("edge_faces", sql("SELECT part_id, edge_index, uses, fs AS faces FROM incident JOIN edge_uses USING (part_id, edge_index)", False))
def edge_faces(spark, sf_dir) -> DataFrame:
    return topology.edge_faces(binding.tables(spark, sf_dir).coedges)


@query("face_adjacency", sql("SELECT * FROM adjacency", False))
def face_adjacency(spark, sf_dir) -> DataFrame:
    return topology.face_adjacency(binding.tables(spark, sf_dir).coedges)


@query("face_degree", sql("SELECT * FROM degree", False))
def face_degree(spark, sf_dir) -> DataFrame:
    return topology.face_degree(face_adjacency(spark, sf_dir))


@query("edge_index", sql("SELECT part_id, face_a AS src, face_b AS dst FROM adjacency UNION ALL SELECT part_id, face_b, face_a FROM adjacency", False))
def edge_index(spark, sf_dir) -> DataFrame:
    return topology.edge_index(face_adjacency(spark, sf_dir))


_COS = "least(1.0, greatest(-1.0, (a.nx * b.nx + a.ny * b.ny + a.nz * b.nz) / nullif(sqrt(a.nx * a.nx + a.ny * a.ny + a.nz * a.nz) * sqrt(b.nx * b.nx + b.ny * b.ny + b.nz * b.nz), 0)))"
_COS = f"CASE WHEN (a.nx * a.nx + a.ny * a.ny + a.nz * a.nz) * (b.nx * b.nx + b.ny * b.ny + b.nz * b.nz) > 0 THEN {_COS} END"


@query(
    "edge_features",
    sql(
        f"""SELECT part_id, edge_index, round(length, 6) AS length, len(fs) AS n_faces, CASE WHEN two AND cos > 0.98 THEN 'smooth' WHEN two AND cos >= 0 THEN 'convex' WHEN two AND cos IS NOT NULL THEN 'concave' ELSE 'unknown' END AS convexity,
        CASE WHEN two THEN round(degrees(acos(cos)), 4) END AS dihedral_angle FROM (SELECT e.part_id, e.edge_index, e.length, fs, len(fs) >= 2 AS two, {_COS} AS cos FROM edges e JOIN incident i USING (part_id, edge_index)
        LEFT JOIN faces a ON a.part_id = e.part_id AND a.face_index = fs[1] LEFT JOIN faces b ON b.part_id = e.part_id AND b.face_index = fs[2])""",
        False,
    ),
)
def edge_features(spark, sf_dir) -> DataFrame:
    t = binding.tables(spark, sf_dir)
    return in_place(topology.edge_features(t.edges, t.faces, t.coedges), "edge-features").select("part_id", "edge_index", _r("length"), F.size("faces").cast("long").alias("n_faces"), "convexity", _r("dihedral_angle", 4))


@query("coedge_mates", sql("SELECT a.part_id, a.coedge_index, b.coedge_index AS mate FROM coedges a JOIN coedges b ON a.part_id = b.part_id AND a.edge_index = b.edge_index AND a.coedge_index <> b.coedge_index JOIN edge_uses u ON u.part_id = a.part_id AND u.edge_index = a.edge_index WHERE uses = 2", False))
def coedge_mates(spark, sf_dir) -> DataFrame:
    return topology.coedge_mates(binding.tables(spark, sf_dir).coedges)


@query("number_coedges", sql("SELECT part_id, face_index, edge_index, loop_position, row_number() OVER (PARTITION BY part_id ORDER BY face_index, loop_position) - 1 AS coedge_index FROM coedges", False))
def number_coedges(spark, sf_dir) -> DataFrame:
    rows = binding.tables(spark, sf_dir).coedges.select("part_id", "face_index", "edge_index", "loop_position")
    return topology.number_coedges(rows, order=("face_index", "loop_position")).withColumn("coedge_index", F.col("coedge_index").cast("long"))


@query("reindex_faces", sql("SELECT part_id, solid_id, face_index, row_number() OVER (PARTITION BY part_id, solid_id ORDER BY face_index) - 1 AS body_face_index FROM faces WHERE solid_id IS NOT NULL", False))
def reindex_faces(spark, sf_dir) -> DataFrame:
    faces = binding.tables(spark, sf_dir).faces.filter("solid_id is not null")
    return topology.reindex_faces(faces.select("part_id", "solid_id", "face_index")).select(*[F.col(c).cast("long") for c in ("part_id", "solid_id", "face_index", "body_face_index")])


@query("rollup_bbox", sql("SELECT part_id, min(xmin) AS xmin, min(ymin) AS ymin, min(zmin) AS zmin, max(xmax) AS xmax, max(ymax) AS ymax, max(zmax) AS zmax FROM faces GROUP BY ALL", False))
def rollup_bbox(spark, sf_dir) -> DataFrame:
    return topology.rollup_bbox(binding.tables(spark, sf_dir).faces)


@query(
    "topology_counts",
    sql(
        """SELECT p.part_id, coalesce(f.n, 0) AS face_count, 0 AS face_feature_errors, coalesce(c.n, 0) AS oriented_edges, coalesce(c.u, 0) AS unique_edges, coalesce(a.n, 0) AS adjacency_count, coalesce(s.n, 0) AS solid_count FROM parts p
        LEFT JOIN (SELECT part_id, count(*) AS n FROM faces GROUP BY ALL) f USING (part_id) LEFT JOIN (SELECT part_id, count(*) AS n, count(DISTINCT edge_index) AS u FROM coedges GROUP BY ALL) c USING (part_id)
        LEFT JOIN (SELECT part_id, count(*) AS n FROM adjacency GROUP BY ALL) a USING (part_id) LEFT JOIN (SELECT part_id, count(*) AS n FROM solids GROUP BY ALL) s USING (part_id)""",
        False,
    ),
)
def topology_counts(spark, sf_dir) -> DataFrame:
    return topology.topology_counts(binding.tables(spark, sf_dir))


@query("bbox_dims", sql("SELECT part_id, max_dim, least(xmax, ymax, zmax) AS min_dim FROM parts", False))
def bbox_dims(spark, sf_dir) -> DataFrame:
    return S.with_bbox_dims(binding.parts(spark, sf_dir)).select("part_id", "max_dim", "min_dim")


_HOT = "[" + ", ".join(f"CASE WHEN surface_type = '{s}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for s in ("plane", "cylinder", "cone", "sphere", "torus", "bspline", "other")) + "]"


@query("surface_one_hot", sql(f"SELECT part_id, face_index, surface_type, {_HOT} AS one_hot FROM faces", False))
def surface_one_hot(spark, sf_dir) -> DataFrame:
    return S.with_surface_type(binding.tables(spark, sf_dir).faces).select("part_id", "face_index", "surface_type", "one_hot")


@query("face_features", sql("SELECT part_id, face_index, round(ln(1 + area), 6) AS f_area, round(abs(nx) + abs(ny) + abs(nz), 6) AS f_normal, mean_curvature AS f_curvature, round(du, 6) AS f_u, round(dv, 6) AS f_v, 12 AS n FROM faces", False))
def face_features(spark, sf_dir) -> DataFrame:
    rows = S.face_feature_vector(binding.tables(spark, sf_dir).faces)
    v = F.col("features")
    return rows.select("part_id", "face_index", *[F.round(v[7 + i], 6).alias(n) for i, n in enumerate(("f_area", "f_normal", "f_curvature", "f_u", "f_v"))], F.size(v).alias("n"))


@query("heuristic_scores", sql("SELECT part_id, face_index, round(score, 6) AS score FROM ml_scores"))
def heuristic_scores(spark, sf_dir) -> DataFrame:
    t = binding.tables(spark, sf_dir)
    return in_place(_heuristic(t), "ml-scores").select("part_id", "face_index", _r("score"))


def _heuristic(t) -> DataFrame:
    return scores.heuristic_scores(t.faces, topology.face_adjacency(t.coedges))


@query("aggregate_ml", sql("SELECT p.part_id, round(coalesce(m, 0.5), 9) AS aggregate_score FROM parts p LEFT JOIN (SELECT part_id, avg(score) AS m FROM ml_scores GROUP BY ALL) USING (part_id)"))
def aggregate_ml(spark, sf_dir) -> DataFrame:
    t = binding.tables(spark, sf_dir)
    return in_place(scores.aggregate_ml(t.parts, _heuristic(t)), "ml-means").select("part_id", _r("aggregate_score", 9))


@query(
    "complexity_proxy",
    sql(
        """SELECT part_id, face_index, round(least(1.0, 0.1 + 0.4 * (1 - ln(1 + area) / ln(1 + most)) + CASE WHEN surface_type IN ('plane', 'cylinder') THEN 0 ELSE 0.4 END + least(0.5, 0.05 * coalesce(degree, 0))), 6) AS proxy
        FROM (SELECT *, max(area) OVER (PARTITION BY part_id) AS most FROM faces) LEFT JOIN degree USING (part_id, face_index)""",
        False,
    ),
)
def complexity_proxy(spark, sf_dir) -> DataFrame:
    t = binding.tables(spark, sf_dir)
    return in_place(scores.complexity_proxy(t.faces, topology.face_adjacency(t.coedges)), "proxies").select("part_id", "face_index", _r("proxy"))


@query("fuse_scores", sql("SELECT part_id, face_index, round(score, 6) AS score FROM fused"))
def fuse_scores(spark, sf_dir) -> DataFrame:
    return _analysed(spark, sf_dir)[1]["combined"].select("part_id", "face_index", _r("score"))


_COLOR = "CASE WHEN score >= 0.75 THEN '#ef4444' WHEN score >= 0.4 THEN '#f59e0b' ELSE '#22c55e' END AS color, CASE WHEN m >= 0.75 THEN '#fb923c' WHEN m >= 0.4 THEN '#60a5fa' ELSE '#1d4ed8' END AS ml_color"


@query("face_overlay", sql(f"SELECT part_id, face_index, round(score, 6) AS score, round(m, 6) AS ml_score, {_COLOR} FROM fused"))
def face_overlay(spark, sf_dir) -> DataFrame:
    r = _analysed(spark, sf_dir)[1]
    return in_place(scores.face_overlay(r["combined"], r["ml"]), "overlay").select("part_id", "face_index", _r("score"), _r("ml_score"), "color", "ml_color")


@query(
    "fallback_embedding",
    sql(
        """SELECT part_id, face_index, list_transform(range(128), lambda i: four[i % 4 + 1]) AS embedding
        FROM (SELECT *, [round(tanh(score), 6), round(tanh(area + 0.1), 6), round(tanh(abs(nx) + abs(ny) + abs(nz) + 0.2), 6), round(tanh(1.0 + 0.3::DOUBLE), 6)] AS four FROM (SELECT *, least(1.0, 0.32 + CASE WHEN area <= 1e-6 THEN 0.18 ELSE least(0.18, 1 / (1 + area)) END + CASE WHEN surface_type IN ('plane', 'cylinder') THEN 0 ELSE 0.08 END + least(0.22, 0.03 * coalesce(degree, 0)) + least(0.1, 0.02 * (abs(nx) + abs(ny) + abs(nz)))) AS score
        FROM faces LEFT JOIN degree USING (part_id, face_index)))""",
        False,
    ),
)
def fallback_embedding(spark, sf_dir) -> DataFrame:
    t = binding.tables(spark, sf_dir)
    patterns = in_place(scores.embedding_pattern(t.faces, _heuristic(t)), "patterns")
    return scores.repeated(patterns).select("part_id", "face_index", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query("catalog_rollup", sql("SELECT label AS status, tier, count(*) AS parts, round(avg(overall), 8) AS mean_score, grouping_id(label, tier) AS level FROM everything GROUP BY ROLLUP (label, tier)"))
def catalog_rollup(spark, sf_dir) -> DataFrame:
    return scores.catalog_rollup(catalog.all_parts(_analysed(spark, sf_dir)[1])).select("status", "tier", "parts", _r("mean_score", 8), "level")


@query(
    "catalog_summary",
    sql(
        """SELECT count(*) FILTER (ok) AS analysed, count(*) FILTER (status = 'too_large') AS skipped, count(*) FILTER (status = 'error') AS errored, count(*) FILTER (ok AND predicted <> 'clean') AS flagged, min(face_count) FILTER (ok) AS min_faces, max(face_count) FILTER (ok) AS max_faces,
        count(*) FILTER (ok AND face_count > 200) AS large_parts, sum(CASE WHEN ok THEN n_critical ELSE 0 END)::BIGINT AS sum_critical, sum(CASE WHEN ok THEN n_major ELSE 0 END)::BIGINT AS sum_major, sum(CASE WHEN ok THEN n_minor ELSE 0 END)::BIGINT AS sum_minor,
        sum(CASE WHEN ok THEN n_info ELSE 0 END)::BIGINT AS sum_info, round(count(*) FILTER (ok AND predicted <> 'clean') / count(*) FILTER (ok), 6) AS false_positive_rate
        FROM (SELECT *, status = 'ok' AS ok FROM (SELECT l.*, CASE WHEN label = 'InvalidInput' THEN 'error' WHEN face_count > 40 THEN 'too_large' ELSE 'ok' END AS status, split_part(stem, '__', 2) AS predicted FROM everything l JOIN parts USING (part_id)))"""
    ),
)
def catalog_summary(spark, sf_dir) -> DataFrame:
    rows = scores.guard_parts(catalog.all_parts(_analysed(spark, sf_dir)[1]), 40).withColumn("predicted", F.split_part("stem", F.lit("__"), F.lit(2)))
    return scores.catalog_summary(rows).withColumn("false_positive_rate", F.round("false_positive_rate", 6))


@query(
    "slim_reports",
    sql(
        f"""SELECT l.part_id, label AS status, round(overall, 9) AS overall, l.face_count, total, n_major, coalesce(t.top_checks, []) AS top_checks, CASE WHEN label <> 'InvalidInput' THEN 'heuristic' END AS score_source,
        CASE WHEN label = 'InvalidInput' THEN 1 ELSE 0 END AS validation_errors, greatest(1, coalesce(solid_count, 0)) AS body_count FROM everything l LEFT JOIN facts USING (part_id)
        LEFT JOIN (SELECT part_id, list("check" ORDER BY rank) AS top_checks FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY {_RANK}, finding_seq) AS rank FROM findings) WHERE rank <= 12 GROUP BY ALL) t USING (part_id)"""
    ),
)
def slim_reports(spark, sf_dir) -> DataFrame:
    t, r = _analysed(spark, sf_dir)
    rows = catalog.slim_reports(t, r)
    return rows.select("part_id", "status", _r("overall", 9), "face_count", "total", "n_major", F.col("top_findings.check").alias("top_checks"), "score_source", "validation_errors", "body_count")


_REPORT = """SELECT l.part_id, stem AS input_file, label AS status, label <> 'InvalidInput' AS is_valid, CASE WHEN label = 'InvalidInput' THEN coalesce(load_check, 'BRepCheckFailure') END AS error, l.total, l.total AS n_findings,
CASE WHEN label <> 'InvalidInput' THEN coalesce(c.n, 0) END AS edge_count, CASE WHEN label <> 'InvalidInput' THEN coalesce(c.u, 0) END AS unique_edges, CASE WHEN label <> 'InvalidInput' THEN coalesce(a.n, 0) END AS adjacency_count,
CASE WHEN label <> 'InvalidInput' THEN coalesce(r.f, []) END AS rule_faces, CASE WHEN label <> 'InvalidInput' THEN coalesce(r.s, []) END AS rule_scores, CASE WHEN label <> 'InvalidInput' THEN coalesce(m.s, []) END AS combined_scores,
CASE WHEN label <> 'InvalidInput' THEN coalesce(m.m, []) END AS ml_scores, round(CASE WHEN label <> 'InvalidInput' THEN coalesce(m.ml, 0.5) END, 9) AS ml_aggregate, BODIES FROM everything l JOIN parts USING (part_id)
LEFT JOIN (SELECT part_id, count(*) AS n, count(DISTINCT edge_index) AS u FROM coedges GROUP BY ALL) c USING (part_id) LEFT JOIN (SELECT part_id, count(*) AS n FROM adjacency GROUP BY ALL) a USING (part_id)
LEFT JOIN (SELECT part_id, list(face_index ORDER BY face_index) AS f, list(round(score, 6) ORDER BY face_index) AS s FROM rule_scores GROUP BY ALL) r USING (part_id)
LEFT JOIN (SELECT part_id, list(round(score, 6) ORDER BY face_index) AS s, list(round(m, 6) ORDER BY face_index) AS m, avg(m) AS ml FROM fused GROUP BY ALL) m USING (part_id)"""


@query("reports", sql(_REPORT.replace("BODIES", "CASE WHEN label <> 'InvalidInput' AND n_solids > 1 THEN n_solids ELSE 0 END AS n_bodies")))
def reports(spark, sf_dir) -> DataFrame:
    t, r = _analysed(spark, sf_dir)
    rows = catalog.reports(t, r, catalog.analyse(catalog.as_bodies(t), keys=catalog.BODY))
    listed = lambda c: F.transform(F.array_sort(F.map_entries(c)), lambda x: F.round(x["value"], 6))
    return rows.select(
        "part_id", "input_file", "status", F.col("validation.is_valid").alias("is_valid"), F.try_element_at("validation.errors", F.lit(1))["check"].alias("error"), F.col("summary.total").alias("total"), F.size("findings").cast("long").alias("n_findings"),
        F.col("geometry.edge_count").alias("edge_count"), F.col("graph.edge_count").alias("unique_edges"), F.col("graph.adjacency_count").alias("adjacency_count"), F.transform(F.array_sort(F.map_entries("per_face_scores")), lambda x: x["key"]).alias("rule_faces"),
        listed("per_face_scores").alias("rule_scores"), listed("combined_per_face_scores").alias("combined_scores"), listed("ml.per_face_scores").alias("ml_scores"), F.round("ml.aggregate_score", 9).alias("ml_aggregate"), F.size("bodies").alias("n_bodies"),
    )


@query(
    "trim_reports",
    sql("SELECT part_id, total, CASE WHEN label = 'InvalidInput' THEN 0 ELSE 3 END AS n_omitted FROM everything"),
)
def trim_reports(spark, sf_dir) -> DataFrame:
    """Reports cut to a budget that none with scores by face meets; those without are below it."""
    t, r = _analysed(spark, sf_dir)
    rows = catalog.trim_report(catalog.reports(t, r), 400)
    return rows.select("part_id", F.col("summary.total").alias("total"), F.size("omitted").alias("n_omitted"))


@query(
    "trim_long_reports",
    sql("SELECT part_id, CASE WHEN 3 * total > 20 THEN 21 ELSE 3 * total END AS n_findings, least(part_id % 9, 5) AS n_bodies, CASE WHEN label = 'InvalidInput' THEN 0 ELSE 3 END + (3 * total > 20)::INT + (part_id % 9 > 5)::INT AS n_omitted, CASE WHEN 3 * total > 20 THEN (3 * total - 20) || ' more findings omitted.' END AS note FROM everything"),
)
def trim_long_reports(spark, sf_dir) -> DataFrame:
    """Reports of many findings and bodies, cut to a budget that none meets: every cut is made."""
    t, r = _analysed(spark, sf_dir)
    rows = catalog.reports(t, r)
    bodies = F.transform(F.slice(F.sequence(F.lit(1), F.lit(9)), F.lit(1), (F.col("part_id") % 9).cast("int")), lambda k: F.struct(k.alias("solid_id")))
    rows = rows.withColumns({"findings": F.flatten(F.array_repeat("findings", 3)), "bodies": bodies})
    rows = catalog.trim_report(rows, 100)
    last = F.element_at("findings", -1)
    note = F.when((F.size("findings") > 0) & (last["check"] == "TRUNCATED"), last["detail"])
    return rows.select("part_id", F.size("findings").cast("long").alias("n_findings"), F.size("bodies").cast("long").alias("n_bodies"), F.size("omitted").alias("n_omitted"), note.alias("note"))


@query(
    "report_bodies",
    sql(
        """SELECT (part_id - 1) // 1000 AS part_id, (part_id - 1) % 1000 AS solid_id, label AS status, round(overall, 9) AS overall, face_count, total AS n_findings, coalesce(n, 0) AS n_scored, round(coalesce(s, 0), 6) AS rule_sum
        FROM labelled LEFT JOIN (SELECT part_id, count(*) AS n, sum(score) AS s FROM rule_scores GROUP BY ALL) USING (part_id)""",
        views=binding.BODIES,
    ),
)
def report_bodies(spark, sf_dir) -> DataFrame:
    """What the reports of parts say of each of their bodies."""
    t, r = _analysed(spark, sf_dir)
    rows = catalog.reports(t, r, catalog.analyse(catalog.as_bodies(t), keys=catalog.BODY)).select("part_id", F.explode("bodies").alias("b"))
    scores_of = F.map_values("b.per_face_scores")
    total = F.aggregate(scores_of, F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "part_id", "b.solid_id", "b.status", F.round("b.score.overall", 9).alias("overall"), "b.geometry.face_count", F.size("b.findings").cast("long").alias("n_findings"),
        F.size(scores_of).cast("long").alias("n_scored"), F.round(total, 6).alias("rule_sum"),
    )


@query(
    "box_overlaps",
    sql(
        """SELECT s.part_id, s.solid_id AS a, r.solid_id AS b FROM solids s JOIN solids r ON s.part_id = r.part_id AND s.solid_id < r.solid_id AND s.xmin < r.xmax AND r.xmin < s.xmax AND s.ymin < r.ymax AND r.ymin < s.ymax AND s.zmin < r.zmax AND r.zmin < s.zmax
        WHERE s.part_id IN (SELECT part_id FROM parts WHERE is_valid AND load_check IS NULL) AND s.part_id NOT IN (SELECT part_id FROM faces GROUP BY ALL HAVING count(*) > 150 OR count(*) FILTER (surface_type IN ('bspline', 'bezier')) > 0)""",
        False,
    ),
)
def box_overlaps(spark, sf_dir) -> DataFrame:
    return in_place(checks.interference(binding.tables(spark, sf_dir)), "overlaps")


@query(
    "face_overlaps",
    sql(
        """, fit AS (SELECT part_id FROM parts WHERE is_valid AND load_check IS NULL AND part_id NOT IN (SELECT part_id FROM faces GROUP BY ALL HAVING count(*) > 150 OR count(*) FILTER (surface_type IN ('bspline', 'bezier')) > 0)),
        fit_faces AS (SELECT part_id, face_index, xmin, ymin, zmin, xmax, ymax, zmax FROM faces JOIN fit USING (part_id)),
        near AS (SELECT DISTINCT x.part_id, x.face_index AS a, y.face_index AS b FROM coedges x JOIN coedges y ON x.part_id = y.part_id AND x.edge_index = y.edge_index AND x.face_index < y.face_index)
        SELECT s.part_id, s.face_index AS a, r.face_index AS b FROM fit_faces s JOIN fit_faces r ON s.part_id = r.part_id AND s.face_index < r.face_index AND s.xmin < r.xmax AND r.xmin < s.xmax AND s.ymin < r.ymax AND r.ymin < s.ymax AND s.zmin < r.zmax AND r.zmin < s.zmax
        ANTI JOIN near ON near.part_id = s.part_id AND near.a = s.face_index AND near.b = r.face_index""",
        False,
    ),
)
def face_overlaps(spark, sf_dir) -> DataFrame:
    return in_place(checks.interference(binding.tables(spark, sf_dir), "face_index"), "overlaps")


@query(
    "body_scores",
    sql("SELECT (part_id - 1) // 1000 AS part_id, (part_id - 1) % 1000 AS solid_id, face_count, total, n_major, round(rule_face_mean, 9) AS rule_face_mean, round(overall, 9) AS overall, label FROM labelled", views=binding.BODIES),
)
def body_scores(spark, sf_dir) -> DataFrame:
    """The catalog analysis at the grain of bodies, for parts with several."""
    parts = catalog.analyse(catalog.as_bodies(binding.tables(spark, sf_dir)), keys=catalog.BODY)["parts"]
    return parts.select("part_id", "solid_id", "face_count", "total", "n_major", _r("rule_face_mean", 9), _r("overall", 9), "label")
