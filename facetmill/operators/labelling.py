"""The labelling job: each part is labelled, skipped or an error, with its labels in the same row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import defect_class, defect_name
from .datasets import face_labels
from .measures import Measured
from .validity import split_valid

#: Failures of the analysis itself; all others mean a part that did not pass validation.
ERRORS = ("AnalysisError", "AnalysisTimeout")
MANIFEST = ("input_file", "status", "reason", "stem", "face_count", "positive_refinement", "graph_label", "graph_label_name")
_MAPS = {"refinement": "boolean", "complexity_proxy": "double", "rule_per_face": "double"}


def label_parts(m: Measured, tags: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row a part: the columns of ``MANIFEST``, and for labelled parts maps of labels by face.

    ``tags``: (stem, defect_tags); a stem without any is clean. A part is an error if its analysis failed,
    skipped if it did not load or is not valid (validation_failed) or has no faces (empty_graph).
    """
    parts = m.tables.parts
    label = defect_class("defect_tags")
    one = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("face_index", c))))
    faces = face_labels(m.faces, threshold).groupBy("part_id").agg(
        F.count("*").alias("face_count"), F.count_if("refinement").alias("positive_refinement"),
        one("refinement").alias("refinement"), one("complexity_proxy").alias("complexity_proxy"), one("rule_score").alias("rule_per_face"),
    )
    failed = split_valid(parts)[1].select("part_id", "check")
    rows = parts.select("part_id", "stem").join(failed, "part_id", "left").join(faces, "part_id", "left").join(tags.select("stem", "defect_tags"), "stem", "left")
    wrong, empty = F.col("check"), F.col("face_count").isNull()
    status = F.when(wrong.isin(*ERRORS), "error").when(wrong.isNotNull() | empty, "skipped").otherwise("ok")
    reason = F.when(wrong.isin(*ERRORS), wrong).when(wrong.isNotNull(), "validation_failed").when(empty, "empty_graph")
    rows = rows.withColumns({"status": status, "reason": reason, "label": label.cast("int")})
    ok = lambda c: F.when(F.col("status") == "ok", c)
    return rows.select(
        F.col("stem").alias("input_file"), "status", "reason", ok(F.col("stem")).alias("stem"), ok(F.col("face_count")).alias("face_count"),
        ok(F.col("positive_refinement")).alias("positive_refinement"), ok(F.col("label")).alias("graph_label"), ok(defect_name(F.col("label"))).alias("graph_label_name"), *_MAPS,
    )
