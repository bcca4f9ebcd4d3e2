"""Labels, splits, metrics and defect injection for data sets of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import clustered, co_located
from ..functions.scalars import defect_class, defect_name, source_part
from ..schemas import BOX, DEFECT_CLASSES, Tables
from .boxes import box_solid
from .topology import rollup_bbox


def training_rows(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """Faces with their labels; False and 0 where there is none."""
    rows = faces.select("part_id", "face_index").join(labels, ["part_id", "face_index"], "left")
    return rows.select("part_id", "face_index", F.coalesce("refinement", F.lit(False)).alias("refinement"), F.coalesce("complexity_proxy", F.lit(0.0)).alias("complexity_proxy"))


def build_labels(faces: DataFrame, rule: DataFrame, proxy: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(part_id, face_index, refinement, complexity_proxy, rule_score)."""
    rows = faces.select("part_id", "face_index").join(rule.withColumnRenamed("score", "rule_score"), ["part_id", "face_index"], "left").join(proxy, ["part_id", "face_index"], "left")
    score = F.coalesce("rule_score", F.lit(0.0))
    return rows.select("part_id", "face_index", (score > threshold).alias("refinement"), F.coalesce("proxy", F.lit(0.0)).alias("complexity_proxy"), score.alias("rule_score"))


def face_labels(faces: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The same from measured faces, which carry both scores."""
    score = F.coalesce("rule_score", F.lit(0.0))
    return faces.select("part_id", "face_index", (score > threshold).alias("refinement"), F.coalesce("proxy", F.lit(0.0)).alias("complexity_proxy"), score.alias("rule_score"))


def graph_labels(parts: DataFrame, tags: DataFrame) -> DataFrame:
    """(stem, graph_label, graph_label_name) from (stem, defect_tags); no tags mean clean."""
    label = defect_class("defect_tags")
    return parts.select("stem").join(tags.select("stem", "defect_tags"), "stem", "left").select("stem", label.alias("graph_label"), defect_name(label).alias("graph_label_name"))


def smallest(df: DataFrame, text, n: int, bits: int = 16, together: int = 100_000) -> DataFrame:
    """The n rows with the smallest md5 of ``text`` (equal ones by the text), without ordering the table.

    Rows are counted by the first bits of the hash; whole buckets below the border are in, and only
    the border bucket is put in order, by finer bits while it holds more than ``together`` rows.
    """
    rows = df.withColumn("_text", text).withColumn("_hash", F.md5("_text"))
    prefix, digits = "", bits // 4
    while True:
        depth = len(prefix) + digits
        inside = rows.filter(F.col("_hash").startswith(prefix)) if prefix else rows
        counts = sorted((r[0], r[1]) for r in inside.groupBy(F.substring("_hash", 1, depth)).count().collect())  # 2 ** bits rows at most
        left = n if not prefix else left
        border, size = "g", 0
        for value, k in counts:
            if k > left:
                border, size = value, k
                break
            left -= k
        if border == "g" or size <= together or depth >= 32:
            break
        prefix = border
    below = rows.filter(F.substring("_hash", 1, len(border)) < border)
    if border != "g" and left:
        below = below.unionByName(rows.filter(F.col("_hash").startswith(border)).orderBy("_hash", "_text").limit(left))
    return below.drop("_text", "_hash")


def _marked(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Add split: the n rows of the smallest hashes of the key are val."""
    val = smallest(df.select(key), F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), n).withColumn("split", F.lit("val"))
    return df.join(val, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def split_train_val(df: DataFrame, key: str, frac: float, seed: int = 0) -> DataFrame:
    """Add split: exactly max(1, int(n * frac)) rows are val, those of the smallest hashes; keys are distinct."""
    return _marked(df, key, max(1, int(df.count() * frac)), seed)


def split_by_source(samples: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """Add source and split; all samples of a source fall on one side; max(1, round(sources * ratio)) sources are val."""
    rows = samples.withColumn("source", source_part("stem"))
    sources = rows.select("source").distinct()
    marked = _marked(sources, "source", max(1, round(sources.count() * ratio)), seed)
    return rows.join(marked, "source")


def discover_samples(manifest: DataFrame, graphs: DataFrame, labels: DataFrame) -> DataFrame:
    """Manifest rows of status ok with a stem for which both files exist."""
    ok = manifest.filter((F.col("status") == "ok") & F.col("stem").isNotNull())
    return ok.join(graphs.select("stem"), "stem", "left_semi").join(labels.select("stem"), "stem", "left_semi")


def binary_metrics(df: DataFrame, label: str, prob: str, t: float = 0.5) -> DataFrame:
    """One row: counts, accuracy, precision, recall, F1 (0 where a denominator is 0)."""
    y, p = F.col(label) == 1, F.col(prob) >= t
    one = df.agg(F.count("*").alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    one = one.withColumns({"accuracy": safe(tp + tn, n), "precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn)})
    return one.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def regression_metrics(df: DataFrame, label: str, value: str) -> DataFrame:
    d = F.col(label) - F.col(value)
    return df.agg(F.coalesce(F.avg(d * d), F.lit(0.0)).alias("mse"), F.coalesce(F.avg(F.abs(d)), F.lit(0.0)).alias("mae"))


def class_metrics(df: DataFrame, label: str, predicted: str, classes: list[str]) -> DataFrame:
    """One row a class: n, right, accuracy (null for an absent class)."""
    names = df.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    got = df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"), F.count_if(F.col(label) == F.col(predicted)).alias("right"))
    return names.join(got, "class", "left").na.fill(0, ["n", "right"]).withColumn("accuracy", F.try_divide(F.col("right").cast("double"), F.col("n").cast("double")))


def confusion_matrix(df: DataFrame, label: str, predicted: str, classes: list[str]) -> DataFrame:
    return df.groupBy(label).pivot(predicted, classes).count().na.fill(0)


def majority_baseline(df: DataFrame, label: str) -> DataFrame:
    c = df.groupBy(label).count()
    return c.agg((F.max("count") / F.sum("count")).alias("baseline"))


def loss_metrics(df: DataFrame, label: str, prob: str, eps: float = 1e-7) -> DataFrame:
    """Binary cross-entropy and squared error, as means."""
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(prob)))
    y = F.col(label).cast("double")
    return df.agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("bce"), F.avg((y - F.col(prob)) * (y - F.col(prob))).alias("mse"))


def cross_entropy(df: DataFrame, label: str, probs: str) -> DataFrame:
    """Mean of -log of the probability of the true class; probs is an array in class order."""
    return df.agg(F.avg(-F.log(F.greatest(F.lit(1e-12), F.element_at(F.col(probs), F.col(label) + 1)))).alias("cross_entropy"))


def label_stats(labels: DataFrame) -> DataFrame:
    return labels.groupBy("part_id").agg(F.count("*").alias("face_count"), F.count_if("refinement").alias("positive_refinement"))


def assemble_dataset(clean: DataFrame, degraded: DataFrame) -> DataFrame:
    """Clean and degraded samples in one set, distinct."""
    return clean.unionByName(degraded).distinct()


def class_counts(dataset: DataFrame) -> DataFrame:
    return dataset.groupBy("graph_label").count()


# --- defects, at the level of tables -----------------------------------------------------------

_SHIFT = {"open_shell": 1, "sliver_face": 2, "self_intersection": 3, "zero_length_edge": 4}
_NAMES = ("parts", "solids", "faces", "edges", "coedges")
# Thickness and share of the diagonal of a sliver, shift of a copy, length of an edge of none.
SLIVER, SLIVER_SHARE, COPY_SHIFT, NO_LENGTH = 1e-3, 0.1, 0.25, 1e-9


def _renamed(t: Tables, defect: str, factor: int = 10) -> Tables:
    """The same tables under new part ids (part_id * 10 + number of the defect) and stems."""
    key = F.col("part_id") * factor + _SHIFT[defect]
    new = {n: getattr(t, n).withColumn("part_id", key) for n in _NAMES}
    new["parts"] = new["parts"].withColumn("stem", F.concat("stem", F.lit(f"__{defect}")))
    return Tables(**new, buckets=t.buckets)


def _kept(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """Written in buckets of parts; joins with rows in such buckets are made where these lie."""
    with co_located(df.sparkSession):
        return clustered(df, name, ["part_id"], buckets)


def settled(t: Tables) -> Tables:
    """The tables of a clustered catalog that was changed, each written once in buckets of its parts; others as they are."""
    if not t.buckets:
        return t
    return Tables(*[_kept(getattr(t, n), f"defect-{n}", t.buckets) for n in _NAMES], t.buckets)


def _diagonal():
    """Of a part's box; at least 1, and 1 without a box."""
    d = [(F.col(f"{a}max") - F.col(f"{a}min")) for a in "xyz"]
    return F.coalesce(F.greatest(F.lit(1.0), F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])), F.lit(1.0))


def _around(parts: DataFrame, other: DataFrame) -> DataFrame:
    """Parts with the box around theirs and another one (``n_`` columns); least and greatest pass over nulls."""
    box = {c: (F.least if c.endswith("min") else F.greatest)(c, f"n_{c}") for c in BOX}
    return parts.join(other, "part_id").withColumns(box).select(parts.columns)


def _added(own: DataFrame, more: DataFrame, start: DataFrame, numbers: dict[str, str]) -> DataFrame:
    """Rows with others whose numbers go on after the part's own."""
    more = more.join(start.select("part_id", *numbers.values()), "part_id").withColumns({c: (F.col(c) + F.col(n)).cast("int") for c, n in numbers.items()})
    return own.unionByName(more.select(own.columns))


def inject_defect(t: Tables, defect: str) -> tuple[Tables, DataFrame]:
    """The degraded tables and the manifest (source_stem, stem, defect_tags, status, reason).

    open_shell: all faces but the first, with the edges that they use, as no solid. sliver_face: a thin box
    at the origin beside the part, with faces, edges and uses of its own. self_intersection: a copy of all,
    moved in x. zero_length_edge: an edge at the origin that no face uses. Boxes of parts are those of what
    they hold then. Parts that did not load, and open shells of fewer than 2 faces, are errors.
    """
    if defect not in _SHIFT:
        raise ValueError(f"unknown defect {defect}")
    last = [("faces", "face_index", "nf"), ("edges", "edge_index", "ne"), ("coedges", "coedge_index", "nu"), ("solids", "solid_id", "ns")]
    fit = t.parts.select("part_id", "stem", *[c for c in ("load_check",) if c in t.parts.columns], _diagonal().alias("diag"))
    fit = fit.withColumn("failed", F.col("load_check") if "load_check" in fit.columns else F.lit(None).cast("string"))
    fit = fit.join(t.faces.groupBy("part_id").agg(F.count("*").alias("n_faces")), "part_id", "left").na.fill(0, ["n_faces"])
    for name, number, start in last:
        top = getattr(t, name).groupBy("part_id").agg((F.max(number) + 1).alias(start))
        fit = fit.join(top, "part_id", "left")
    fit = fit.na.fill(0, [start for *_, start in last])
    if t.buckets:  # counted once
        fit = _kept(fit, "defect-parts", t.buckets)
    short = (F.lit(defect) == "open_shell") & (F.col("n_faces") < 2)
    reason = F.when(F.col("failed").isNotNull(), F.concat(F.lit("not read: "), "failed")).when(short, "needs 2 faces")
    manifest = fit.select(
        F.col("stem").alias("source_stem"), F.concat("stem", F.lit(f"__{defect}")).alias("stem"), F.array(F.lit(defect)).alias("defect_tags"),
        F.when(reason.isNull(), "ok").otherwise("error").alias("status"), reason.alias("reason"),
    )
    start = fit.filter(reason.isNull()).select("part_id", "nf", "ne", "nu", "ns", "diag")
    t = Tables(*[getattr(t, n).join(start.select("part_id"), "part_id", "left_semi") for n in _NAMES], t.buckets)
    if defect == "open_shell":
        faces, uses = t.faces.filter("face_index <> 0"), t.coedges.filter("face_index <> 0")
        box = rollup_bbox(faces)
        parts = t.parts.drop(*BOX).join(box, "part_id").select(t.parts.columns)
        edges = t.edges.join(uses.select("part_id", "edge_index").distinct(), ["part_id", "edge_index"], "left_semi")
        shell = faces.withColumn("solid_id", F.lit(None).cast("int"))
        return _renamed(Tables(parts, t.solids.filter(F.lit(False)), shell, edges, uses, t.buckets), defect), manifest
    if defect == "zero_length_edge":
        edge = start.select("part_id", F.lit(0).alias("edge_index"), F.lit(NO_LENGTH).alias("length"), F.lit(False).alias("is_degenerated"))
        point = start.select("part_id", *[F.lit(NO_LENGTH if c == "xmax" else 0.0).alias(f"n_{c}") for c in BOX])
        t = t.with_(parts=_around(t.parts, point), edges=_added(t.edges, edge, start.select("part_id", "ne"), {"edge_index": "ne"}))
        return _renamed(t, defect), manifest
    if defect == "sliver_face":
        wide = SLIVER_SHARE * F.col("diag")
        box = start.select("part_id", *[F.lit(0.0).alias(f"{a}min") for a in "xyz"], wide.alias("xmax"), wide.alias("ymax"), F.lit(SLIVER).alias("zmax"))
        more = box_solid(box)
        around = box.withColumnsRenamed({c: f"n_{c}" for c in BOX})
    else:
        shift = COPY_SHIFT * F.col("diag")

        def moved(df: DataFrame) -> DataFrame:
            rows = df.join(start.select("part_id", "diag"), "part_id")
            return rows.withColumns({"xmin": F.col("xmin") + shift, "xmax": F.col("xmax") + shift}).drop("diag")

        more = {"faces": moved(t.faces), "solids": moved(t.solids), "edges": t.edges, "coedges": t.coedges}
        around = moved(t.parts.select("part_id", *BOX)).withColumnsRenamed({c: f"n_{c}" for c in BOX})
    numbers = {
        "faces": {"face_index": "nf", "solid_id": "ns"}, "solids": {"solid_id": "ns"}, "edges": {"edge_index": "ne"},
        "coedges": {"coedge_index": "nu", "face_index": "nf", "edge_index": "ne"},
    }
    whole = {n: _added(getattr(t, n), more[n], start, k) for n, k in numbers.items()}
    return _renamed(Tables(parts=_around(t.parts, around), **whole, buckets=t.buckets), defect), manifest


def known_classes() -> list[str]:
    return list(DEFECT_CLASSES)
