"""The catalog analysis: B-rep tables to findings, face scores, part scores and reports."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import severity_string
from ..operators import checks, scores
from ..operators.topology import PART
from ..operators.validity import with_validity
from ..schemas import BOX, Tables

BODY = ("part_id", "solid_id")


class Analysis:
    """findings, rule, ml and combined (per face), faces, parts (one row a valid part, scored), invalid."""

    def __init__(self, t: Tables, ml: DataFrame | None = None, ml_available: bool = True, keys=PART):
        self.measured, self.given, self.available, self.keys = checks.measured(t, keys), ml, ml_available, tuple(keys)
        self.face = [*keys, "face_index"]

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    @cached_property
    def faces(self) -> DataFrame:
        faces = self.measured.faces
        if self.given is None:
            return faces
        given = self.given.select(*self.face, F.col("score").alias("ml_score"))
        return faces.drop("ml_score").join(given, self.face, "left")

    @cached_property
    def parts(self) -> DataFrame:
        parts = self.measured.parts
        if self.given is not None:
            parts = parts.drop("ml_mean", "combined_face_mean").join(self.faces.groupBy(*self.keys).agg(*checks.face_means()), list(self.keys), "left")
        counts = {f"n_{s.lower()}": v for s, v in checks.counts_of(F.col("findings")).items()}
        ml_mean = F.coalesce("ml_mean", F.lit(0.0)) if self.available else F.lit(0.0)
        return scores.with_complexity(scores.with_scores(parts.withColumns(counts | {"total": F.size("findings").cast("long"), "ml_mean": ml_mean})))

    @property
    def findings(self) -> DataFrame:
        return checks.findings(self.measured.judged, self.keys)

    def _scored(self, score) -> DataFrame:
        return self.faces.select(*self.face, score.alias("score")).filter("score is not null")

    @property
    def rule(self) -> DataFrame:
        return self._scored(F.col("rule_score"))

    @property
    def ml(self) -> DataFrame:
        return self._scored(F.col("ml_score"))

    @property
    def combined(self) -> DataFrame:
        return self._scored(scores.fused(F.col("rule_score"), F.col("ml_score")))

    @property
    def invalid(self) -> DataFrame:
        return checks.split_valid(self.measured.tables.parts, self.keys)[1]


def analyse(t: Tables, ml: DataFrame | None = None, ml_available: bool = True, keys=PART) -> Analysis:
    """The analysis of a catalog; each of its tables is computed when it is asked for.

    ``ml``: (keys, face_index, score) in place of the heuristic scores. ``keys``: PART, or BODY for
    tables of bodies.
    """
    return Analysis(t, ml, ml_available, keys)


def _unjudged(result: Analysis, keys) -> DataFrame:
    """A row each part that could not be judged: status InvalidInput, its error, counts of 0."""
    counts = ["total", *[f"n_{s.lower()}" for s in scores.SEVERITIES]]
    return result.invalid.select(*keys, "stem", F.lit("InvalidInput").alias("label"), *[F.lit(0).cast("long").alias(x) for x in counts], F.col("check").alias("failed_check"), F.col("detail").alias("failed_detail"))


def all_parts(result: Analysis, keys=PART) -> DataFrame:
    """Scored parts, and those that could not be judged: status InvalidInput, no score and no geometry."""
    return result.parts.unionByName(_unjudged(result, keys), allowMissingColumns=True)


def as_bodies(t: Tables) -> Tables:
    """The tables of the parts with several solids, one body a solid, keyed by (part_id, solid_id)."""
    many = t.solids.groupBy("part_id").agg(F.count("*").alias("n")).filter("n > 1").select("part_id")
    solids = t.solids.join(many, "part_id", "left_semi").select(*BODY, *BOX)
    parts = solids.join(t.parts.drop(*BOX), "part_id")
    faces = t.faces.filter("solid_id is not null").join(many, "part_id", "left_semi")
    coedges = t.coedges.join(faces.select(*BODY, "face_index"), ["part_id", "face_index"])
    edges = t.edges.join(coedges.select(*BODY, "edge_index").distinct(), ["part_id", "edge_index"])
    return Tables(parts, solids, faces, edges, coedges, t.buckets)


def _by_face(column: str):
    return F.map_from_entries(F.coalesce(column, F.array().cast("array<struct<face_index:int,score:double>>")))


def reports(t: Tables, result: Analysis, bodies: Analysis | None = None, ml_source: str = "heuristic") -> DataFrame:
    """One nested document a part: validation, score, geometry, summary, findings, scores of faces, ML, bodies.

    ``bodies``: the analysis of ``as_bodies``; without it every part has an empty list. Parts that
    are not valid have the status InvalidInput, their error, and neither geometry nor scores.
    """
    said = with_validity(t.parts).withColumn("elapsed", F.col("elapsed_seconds") if "elapsed_seconds" in t.parts.columns else F.lit(None).cast("double"))
    said = said.select("part_id", "validation", "heal", "elapsed")
    # a union lies in no buckets: what judged parts are joined with meets them before it
    judged = result.parts.join(checks.scores_by_face(result.faces), "part_id", "left").join(said, "part_id")
    if bodies is not None:
        judged = judged.join(_body_rows(bodies, t.buckets), "part_id", "left")
    rows = judged.unionByName(_unjudged(result, PART).join(said, "part_id"), allowMissingColumns=True)
    counts = {s: F.col(f"n_{s.lower()}") for s in scores.SEVERITIES}
    ok = F.col("failed_check").isNull()
    when = lambda x: F.when(ok, x)
    summary = F.struct("total", F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), v)]).alias("by_severity"), severity_string(counts).alias("text"))
    score = F.struct("overall", "label", "rule_face_mean", "rule_face_count", "combined_face_mean", (F.col("ml_penalty") > 0).alias("ml_penalty_applied"), F.col("ml_penalty").alias("ml_penalty_points"))
    out = rows.select(
        "part_id", F.col("stem").alias("input_file"), F.col("label").alias("status"),
        "validation", "heal", F.col("elapsed").alias("elapsed_seconds"),
        when(score).alias("score"), when(F.struct("face_count", "edge_count", "solid_count", F.struct(*BOX).alias("bounding_box"))).alias("geometry"), summary.alias("summary"),
        F.coalesce("findings", F.array().cast(rows.schema["findings"].dataType)).alias("findings"),
        when(_by_face("rule_faces")).alias("per_face_scores"), when(_by_face("combined_faces")).alias("combined_per_face_scores"),
        when(F.struct(F.lit(ml_source).alias("score_source"), F.lit(ml_source != "heuristic").alias("weights_loaded"), F.coalesce(F.when(F.col("face_count") > 0, F.col("ml_mean")), F.lit(0.5)).alias("aggregate_score"), _by_face("ml_faces").alias("per_face_scores"))).alias("ml"),
        when(F.struct("face_count", F.col("unique_edges").alias("edge_count"), F.col("edge_count").alias("coedge_count"), F.floor(F.col("degrees") / 2).alias("adjacency_count"), F.col("bad_areas").alias("face_feature_errors"))).alias("graph"),
        "complexity", *(["bodies"] if bodies is not None else []),
    )
    if bodies is None:
        return out.withColumn("bodies", F.array())
    return out.withColumn("bodies", F.coalesce("bodies", F.array().cast(rows.schema["bodies"].dataType)))


def _body_rows(bodies: Analysis, buckets: int | None) -> DataFrame:
    """(part_id, bodies): what a part's report says of its bodies, in their order; in as many partitions as the parts have buckets."""
    one = F.struct("solid_id", F.col("label").alias("status"), F.struct("overall", "label", "rule_face_mean").alias("score"), F.struct("face_count", "edge_count").alias("geometry"), "findings", _by_face("rule_faces").alias("per_face_scores"), _by_face("combined_faces").alias("combined_per_face_scores"))
    each = bodies.parts.join(checks.scores_by_face(bodies.faces, BODY), list(BODY), "left").select("part_id", one.alias("body"))
    each = each.repartition(buckets, "part_id") if buckets else each
    each = each.groupBy("part_id").agg(F.collect_list("body").alias("bodies"))
    return each.withColumn("bodies", F.array_sort("bodies", lambda a, b: a["solid_id"] - b["solid_id"]))  # maps have no order


def trim_report(reports: DataFrame, max_chars: int = 8000) -> DataFrame:
    """Reports of at most about so many characters of JSON, with ``omitted``: what was left out.

    In this order, each only while a report is too long and has it: scores by face, findings beyond 20
    (a TRUNCATED entry tells how many), bodies beyond 5.
    """
    names = reports.columns
    rows = reports.withColumn("omitted", F.array().cast("array<string>"))
    long = F.length(F.to_json(F.struct(*names))) > max_chars
    rows = rows.withColumn("long", long)

    def cut(column: str, value, note) -> None:
        nonlocal rows
        if column in names:
            here = F.col("long") & F.col(column).isNotNull()
            cut = F.concat("omitted", F.array(note))
            rows = rows.withColumns({column: F.when(here, value).otherwise(F.col(column)), "omitted": F.when(here, cut).otherwise(F.col("omitted"))})

    for c in ("per_face_scores", "combined_per_face_scores"):
        cut(c, F.lit(None), F.lit(c))
    if "ml" in names:
        cut("ml", F.col("ml").withField("per_face_scores", F.lit(None).cast(reports.schema["ml"].dataType["per_face_scores"].dataType)), F.lit("ml.per_face_scores"))
    for column, most in (("findings", 20), ("bodies", 5)):
        if column not in names:
            continue
        rows = rows.withColumn("long", F.col("long") & (F.length(F.to_json(F.struct(*names))) > max_chars) & (F.size(column) > most))
        more = (F.size(column) - most).cast("string")
        kept = F.slice(column, 1, most)
        if column == "findings":
            kind = reports.schema[column].dataType.elementType
            last = {"check": F.lit("TRUNCATED"), "severity": F.lit("Info"), "detail": F.concat(more, F.lit(" more findings omitted."))}
            kept = F.concat(kept, F.array(F.struct(*[last.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])))
        cut(column, kept, F.concat(more, F.lit(f" more {column}")))
        if column == "findings":  # whoever is still too long goes on
            rows = rows.withColumn("long", F.length(F.to_json(F.struct(*names))) > max_chars)
    return rows.drop("long")


def slim_reports(t: Tables, result: Analysis, n: int = 12, ml_source: str = "heuristic") -> DataFrame:
    """Status, score, counts, worst findings, ML source, validation errors and body count of each part."""
    order = lambda x: F.struct(scores.severity_rank(x["severity"]).alias("rank"), x["finding_seq"].alias("seq"), x["check"].alias("check"), x["severity"].alias("severity"))
    top = F.transform(F.slice(F.array_sort(F.transform("findings", order)), 1, n), lambda x: F.struct(x["check"].alias("check"), x["severity"].alias("severity")))
    bad = F.col("failed_check").isNotNull()
    return all_parts(result).select(
        "part_id", F.col("label").alias("status"), "overall", "face_count", "total", *[f"n_{s.lower()}" for s in scores.SEVERITIES], F.coalesce(top, F.array().cast("array<struct<check:string,severity:string>>")).alias("top_findings"),
        F.when(~bad, ml_source).alias("score_source"), F.when(~bad, ml_source != "heuristic").alias("weights_loaded"), bad.cast("long").alias("validation_errors"), F.greatest("solid_count", F.lit(1)).alias("body_count"),
    )
