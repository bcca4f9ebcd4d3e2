"""The rule checks as one plan.

A check names the facts of a part that make it fire and, if it has any, the scores that it gives edges and
faces; ``measures`` computes the facts of all checks in one pass, so a further check is a registry entry
and not another pass over the tables. A check that fails on a part skips it and leaves an Info row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ramp
from ..schemas import Tables
from . import measures
from .measures import (  # noqa: F401
    MANY_FACES, MANY_SHORT, SHARP_DEGREES, SHORT_EDGE, SMALL_AREA, SMALL_EDGE, SMALL_RADIUS, THIN_SOLID_RATIO, THIN_WALL, ZERO_LENGTH, Measured, face_means, split_valid,
)
from .measures import scale as _scale
from .overlaps import interference, overlapping_boxes  # noqa: F401
from .scores import SEVERITIES, fused
from .topology import PART


@dataclass(frozen=True)
class Check:
    """``fires``, severity, measure, threshold and detail are columns over the facts of a part;
    ``edge_score`` is one over an edge with its uses, ``face_score`` one over a face that knows the
    facts of its part. A face's rule score is the highest that any check gives it or its edges.

    ``broken``: over the facts, how many values that the check needs could not be computed. With
    ``guarded``, errors of the check's own columns (a division by zero, an index or a cast that fails)
    count as such too; checks that use the ``try_`` functions throughout need no guard."""

    name: str
    fires: Column
    severity: Column
    measure: Column
    threshold: Column
    detail: Column
    suggestion: str
    edge_score: Column | None = None
    face_score: Column | None = None
    broken: Column | None = None
    guarded: bool = True

    def result(self) -> Column:
        values = {"fires": self.fires, "severity": self.severity, "measure": self.measure.cast("double"), "threshold": self.threshold.cast("double"), "detail": self.detail}
        return F.struct(*[v.alias(n) for n, v in values.items()])


_REGISTRY: dict[str, Callable[[], Check]] = {}
#: Names of the findings that the registry can make; CheckSkipped stands for any check that failed on a part.
NAMES: dict[str, None] = {}


def register_check(key: str, make: Callable[[], Check], name: str | None = None) -> None:
    """Add a check, or replace the one of that key; order of registration is the order of findings."""
    _REGISTRY[key] = make
    NAMES[name or key] = None


def _check(name, fires, severity, measure, threshold, detail, suggestion, key=None, edge=None, face=None, broken=()):
    def make() -> Check:
        sev = F.lit(severity) if isinstance(severity, str) else severity()
        what = measure().cast("double")
        text = F.format_string(detail.replace("%s", "%.6g"), what) if isinstance(detail, str) else detail()
        limit = (threshold() if threshold else F.lit(None)).cast("double")
        lost = sum((F.col(b) for b in broken[1:]), F.col(broken[0])) if broken else None
        return Check(name, fires(), sev, what, limit, text, suggestion, edge and edge(), face and face(), lost, guarded=False)

    register_check(key or name, make, name)


c = F.col


def _between(column: str, most: Column, least: float = 0.0) -> Column:
    """A score for values above ``least`` and below ``most``; null for others."""
    return F.when((c(column) > least) & (c(column) < most), ramp(column, most))


_check("DegenerateGeometry", lambda: (c("face_count") == 0) | (c("edge_count") == 0), "Major", lambda: c("face_count"), None, "%s faces: the part has no faces or no edges", "Export the part again.")
_check("DegenerateEdges", lambda: c("zero_edges") > 0, "Major", lambda: c("zero_edges"), lambda: F.lit(ZERO_LENGTH), "%s edge uses of no length", "Remove or merge edges of no length.", broken=["bad_lengths"])
_check(
    "NonManifoldEdges", lambda: c("crowded_edges") > 0, "Major", lambda: c("crowded_edges"), None, "%s edges are used more than twice", "Separate the bodies that share these edges.",
    edge=lambda: F.when(c("uses") > 2, 1.0),
)
_check(
    "OpenBoundaries", lambda: (c("face_count") > 0) & (c("solid_count") == 0), "Major", lambda: c("face_count"), None, "%s faces form no solid", "Close the shell into a solid.",
    face=lambda: F.when(c("solid_count") == 0, 0.8),
)
_check(
    "OpenBoundaries", lambda: c("open_edges") > 0, "Major", lambda: c("open_edges"), None, "%s edges belong to one face only", "Stitch the open edges.", "OpenBoundaryEdges",
    edge=lambda: F.when(c("uses") == 1, 1.0),
)
_check(
    "DegenerateTopology", lambda: c("degenerate_edges") > 0, "Major", lambda: c("degenerate_edges"), None, "%s degenerated edges", "Rebuild the faces around them.",
    edge=lambda: F.when(c("is_degenerated"), 0.9),
)
_check(
    "PotentialGaps", lambda: (c("open_edges") == 0) & (c("same_way_edges") > 0), "Major", lambda: c("same_way_edges"), None, "%s edges are run the same way by both faces", "Make the orientation of the shell consistent.",
    face=lambda: F.when((c("open_edges") == 0) & (c("same_way_edges") > 0), 0.7),
)
_check(
    "ShortEdges", lambda: (c("short_threshold") > 0) & (c("short_edges") > 0), lambda: F.when(c("short_edges") >= MANY_SHORT, "Major").otherwise("Minor"), lambda: c("short_edges"), lambda: c("short_threshold"), "%s very short edge uses", "Merge tiny edges.",
    edge=lambda: _between("length", _scale(SHORT_EDGE), ZERO_LENGTH), broken=["bad_lengths"],
)
_check(
    "ThinWalls", lambda: c("thin_ratio") < THIN_WALL, "Major", lambda: c("thin_ratio"), lambda: F.lit(THIN_WALL), "thickness ratio %s", "See whether the solver can mesh the thin region.",
    face=lambda: F.when(c("thin_ratio") < THIN_WALL, ramp("thin_ratio", F.lit(THIN_WALL))),
)
_check(
    "SmallFeatures", lambda: (c("max_dim") > 0) & (c("small_faces") + c("small_edges") > 0), "Minor", lambda: c("small_faces") + c("small_edges"), lambda: _scale(SMALL_AREA, 2),
    lambda: F.format_string("%d small faces and %d small edge uses", "small_faces", "small_edges"), "Remove details that would force a fine mesh.",
    edge=lambda: _between("length", _scale(SMALL_EDGE), ZERO_LENGTH), face=lambda: _between("area", _scale(SMALL_AREA, 2)), broken=["bad_areas", "bad_lengths"],
)
_check(
    "SmallFilletsOrHoles", lambda: (c("max_dim") > 0) & (c("small_cylinders") > 0), "Minor", lambda: c("small_cylinders"), lambda: _scale(SMALL_RADIUS), "%s cylinders of small radius", "Remove or refine small fillets and holes.",
    face=lambda: F.when((c("surface_type") == "cylinder") & (c("radius") <= _scale(SMALL_RADIUS)), ramp("radius", _scale(SMALL_RADIUS))), broken=["bad_radii"],
)
_check("DuplicateBodyHeuristic", lambda: (c("solid_count") > 1) & (c("duplicate_solids") > 0), "Major", lambda: c("duplicate_solids"), None, "%s solids repeat the box of another", "Delete duplicate solids.", broken=["bad_solids"])
_check(
    "ThinSolid", lambda: c("thin_solids") > 0, "Major", lambda: c("worst_aspect"), lambda: F.lit(THIN_SOLID_RATIO),
    lambda: F.format_string("%d solids of an aspect ratio up to %.6g", "thin_solids", "worst_aspect"), "Remove sliver solids.", broken=["bad_solids"],
)
_check(
    "DuplicateFaceHeuristic", lambda: c("duplicate_faces") > 0, lambda: F.when(c("solid_count") == 0, "Major").otherwise("Minor"), lambda: c("duplicate_faces"), None, "%s faces repeat the box of another", "Delete duplicate faces.",
    face=lambda: F.when(c("alike") > 1, 0.8), broken=["bad_boxes"],
)
_check("OrientationNuance", lambda: (c("face_count") > 0) & (c("solid_count") == 0), "Minor", lambda: c("face_count"), None, "%s faces without a solid have no defined outside", "Check the normals.")
_check(
    "SharpEdges", lambda: c("sharp_edges") > 0, "Minor", lambda: c("sharp_edges"), lambda: F.lit(SHARP_DEGREES), "%s edges between faces of almost equal normals", "See whether the transitions are meant.",
    edge=lambda: F.when(c("angle") < SHARP_DEGREES, ramp("angle", F.lit(SHARP_DEGREES), 0.3)), broken=["bad_angles"],
)
_check("SelfIntersectionSkipped", lambda: (c("freeform_faces") > 0) | (c("face_count") > MANY_FACES), "Minor", lambda: F.when(c("freeform_faces") > 0, c("freeform_faces")).otherwise(c("face_count")), None, "self-intersection was not tested (%s faces)", "Test the part for self-intersection elsewhere.")
NAMES["CheckSkipped"] = None
_check("MultiBodyDetected", lambda: c("solid_count") > 1, "Info", lambda: c("solid_count"), None, "%s bodies", "Look at the report of each body.")


def registered() -> list[tuple[str, Check]]:
    return [(key, make()) for key, make in _REGISTRY.items()]


def measured(t: Tables, keys=PART, giant: int = measures.GIANT_FACES) -> Measured:
    """Everything the registered checks and the scores need; see ``measures``.

    Uses of faces that the table does not hold, and rows of parts that are not there or not valid,
    count nowhere.
    """
    return Measured(t, keys, registered(), giant)


def scores_by_face(faces: DataFrame, keys=PART) -> DataFrame:
    """(keys, rule_faces, ml_faces, combined_faces): arrays of (face_index, score) in order of faces."""
    scores = {"rule_faces": F.col("rule_score"), "ml_faces": F.col("ml_score"), "combined_faces": fused(F.col("rule_score"), F.col("ml_score"))}
    one = lambda v: F.when(v.isNotNull(), F.struct("face_index", v.alias("score")))
    return faces.groupBy(*keys).agg(*[F.array_sort(F.collect_list(one(v))).alias(k) for k, v in scores.items()])


def part_facts(t: Tables, keys=PART) -> DataFrame:
    """One row per valid part with every fact that a check looks at, and its findings."""
    return measured(t, keys).judged


def findings(facts: DataFrame, keys=PART) -> DataFrame:
    """(keys, finding_seq, check, severity, measure, threshold, detail, suggestion), in registry order."""
    return facts.select(*keys, F.explode("findings").alias("f")).select(*keys, "f.*")


def rule_scores(t: Tables, keys=PART) -> DataFrame:
    """(keys, face_index, score): the highest score that any check gives a face."""
    return measured(t, keys).faces.filter("rule_score is not null").select(*keys, "face_index", F.col("rule_score").alias("score"))


def merge_scores(scores: list[DataFrame], keys=PART) -> DataFrame:
    """The highest score of each face over several tables; faces without any are left out."""
    out = scores[0]
    for s in scores[1:]:
        out = out.unionByName(s)
    return out.filter("score is not null").groupBy(*keys, "face_index").agg(F.max("score").alias("score"))


def run_checks(t: Tables, keys=PART) -> tuple[DataFrame, DataFrame]:
    """All findings and all rule scores."""
    m = measured(t, keys)
    return findings(m.judged, keys), m.faces.filter("rule_score is not null").select(*keys, "face_index", F.col("rule_score").alias("score"))


def counts_of(found: Column) -> dict[str, Column]:
    """Numbers of findings by severity (a missing one is Info) from an array of findings."""
    return {s: F.size(F.filter(found, lambda f: F.coalesce(f["severity"], F.lit("Info")) == s)).cast("long") for s in SEVERITIES}
