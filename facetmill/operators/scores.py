"""Scores of faces and parts, findings digests, labels of complexity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import abs_sum, clamp01, complexity_tier, ml_color, score_color, score_label, severity_rank
from ..schemas import SURFACE_TYPES
from .topology import PART, face_degree

# Weights of the heuristic and of the penalties.
BASE, TINY_AREA, AREA_SHARE, ODD_SURFACE, DEGREE_STEP, DEGREE_MOST, NORMAL_STEP, NORMAL_MOST = 0.32, 1e-6, 0.18, 0.08, 0.03, 0.22, 0.02, 0.1
MAJOR_POINTS, MINOR_POINTS, ML_POINTS, HIGH_SHARE, LOW_SHARE = 15.0, 5.0, 20.0, 0.6, 0.4
SEVERITIES = ["Critical", "Major", "Minor", "Info"]


def heuristic_score(degree: Column) -> Column:
    """A face's score from area, surface type, degree and normal."""
    area = F.when(F.col("area") <= TINY_AREA, AREA_SHARE).otherwise(F.least(F.lit(AREA_SHARE), 1 / (1 + F.col("area"))))
    odd = F.when(F.col("surface_type").isin("plane", "cylinder"), 0.0).otherwise(ODD_SURFACE)
    return clamp01(BASE + area + odd + F.least(F.lit(DEGREE_MOST), DEGREE_STEP * degree) + F.least(F.lit(NORMAL_MOST), NORMAL_STEP * abs_sum("normal")))


def heuristic_scores(faces: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(part_id, face_index, score) of ``heuristic_score``, with where it comes from."""
    rows = faces.join(face_degree(adjacency), ["part_id", "face_index"], "left")
    score = heuristic_score(F.coalesce("degree", F.lit(0)))
    return rows.select("part_id", "face_index", score.alias("score"), F.lit("heuristic").alias("score_source"), F.lit(False).alias("weights_loaded"))


def aggregate_ml(parts: DataFrame, scores: DataFrame) -> DataFrame:
    """(part_id, aggregate_score): mean of a part's scores, 0.5 without faces."""
    mean = scores.groupBy("part_id").agg(F.avg("score").alias("mean"))
    return parts.select("part_id").join(mean, "part_id", "left").select("part_id", F.coalesce("mean", F.lit(0.5)).alias("aggregate_score"))


def proxy_score(degree: Column, most: Column) -> Column:
    """A face's complexity from its smallness beside the part's largest face, surface type and degree."""
    log_share = F.when(F.col("area") > 0, F.try_divide(F.log1p("area"), F.log1p(most))).otherwise(0.0)
    odd = F.when(F.col("surface_type").isin("plane", "cylinder"), 0.0).otherwise(0.4)
    proxy = 0.1 + 0.4 * (1 - log_share) + odd + F.least(F.lit(0.5), 0.05 * degree)
    return F.when(most <= 0, 1.0).otherwise(F.least(F.lit(1.0), proxy))


def complexity_proxy(faces: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(part_id, face_index, proxy): relative smallness, surface type and degree."""
    rows = faces.join(face_degree(adjacency), ["part_id", "face_index"], "left").withColumn("most", F.max("area").over(Window.partitionBy("part_id")))
    return rows.select("part_id", "face_index", proxy_score(F.coalesce("degree", F.lit(0)), F.col("most")).alias("proxy"))


def fallback_embedding(faces: DataFrame, scores: DataFrame, dim: int = 128) -> DataFrame:
    """(part_id, face_index, embedding): tanh pattern over score, area, normal sum and one-hot length, repeated every four places."""
    return repeated(embedding_pattern(faces, scores), dim)


def embedding_pattern(faces: DataFrame, scores: DataFrame) -> DataFrame:
    """(part_id, face_index, pattern): the four values that an embedding repeats, which is what a table of them needs to hold."""
    rows = faces.join(scores.select("part_id", "face_index", "score"), ["part_id", "face_index"])
    hot = F.when(F.col("surface_type").isin(*SURFACE_TYPES), 1.0).otherwise(0.0)
    four = F.array(*[F.tanh(v + 0.1 * i) for i, v in enumerate((F.col("score"), F.col("area"), abs_sum("normal"), hot))])
    return rows.select("part_id", "face_index", four.alias("pattern"))


def repeated(patterns: DataFrame, dim: int = 128) -> DataFrame:
    return patterns.select("part_id", "face_index", F.slice(F.flatten(F.array_repeat("pattern", -(-dim // 4))), 1, dim).alias("embedding"))


def fused(rule: Column, ml: Column) -> Column:
    """0.6 of the higher and 0.4 of the lower score; a missing rule score is 0, a missing ML score 0.5."""
    r, m = clamp01(F.coalesce(rule, F.lit(0.0))), clamp01(F.coalesce(ml, F.lit(0.5)))
    return HIGH_SHARE * F.greatest(r, m) + LOW_SHARE * F.least(r, m)


def fuse_scores(rule: DataFrame, ml: DataFrame) -> DataFrame:
    """(part_id, face_index, score): 0.6 of the higher and 0.4 of the lower; missing rule 0, missing ML 0.5."""
    both = rule.select("part_id", "face_index", F.col("score").alias("r")).join(ml.select("part_id", "face_index", F.col("score").alias("m")), ["part_id", "face_index"], "full")
    return both.select("part_id", "face_index", fused(F.col("r"), F.col("m")).alias("score"))


def face_overlay(combined: DataFrame, ml: DataFrame) -> DataFrame:
    """Scores with display colours; missing ML counts as 0."""
    m = ml.select("part_id", "face_index", F.col("score").alias("ml_score"))
    rows = combined.join(m, ["part_id", "face_index"], "left").withColumn("ml_score", F.coalesce("ml_score", F.lit(0.0)))
    return rows.select("part_id", "face_index", "score", "ml_score", score_color("score").alias("color"), ml_color("ml_score").alias("ml_color"))


def mean_face_score(parts: DataFrame, scores: DataFrame, name: str = "mean", keys=PART) -> DataFrame:
    """(keys, mean, count) of clamped scores; 0 without any."""
    m = scores.groupBy(*keys).agg(F.avg(clamp01("score")).alias(name), F.count("*").alias(f"{name}_count"))
    return parts.select(*keys).join(m, list(keys), "left").na.fill(0)


def summarize_findings(found: DataFrame, keys=PART) -> DataFrame:
    """(keys, total, n_critical .. n_info, major_checks in order)."""
    sev = F.coalesce("severity", F.lit("Info"))
    counts = [F.count_if(sev == s).alias(f"n_{s.lower()}") for s in SEVERITIES]
    major = F.array_sort(F.collect_list(F.when(sev == "Major", F.struct("finding_seq", "check"))))
    return found.groupBy(*keys).agg(F.count("*").alias("total"), *counts, F.transform(major, lambda x: x["check"]).alias("major_checks"))


def finding_status(parts: DataFrame, found: DataFrame, keys=PART) -> DataFrame:
    """(keys, finding_status) by severity alone."""
    s = summarize_findings(found, keys).select(*keys, "total", "n_critical", "n_major")
    rows = parts.select(*keys).join(s, list(keys), "left").na.fill(0)
    status = F.when(F.col("n_critical") > 0, "InvalidInput").when(F.col("n_major") > 0, "NeedsAttention").when(F.col("total") > 0, "ReviewRecommended").otherwise("SimulationReady")
    return rows.select(*keys, status.alias("finding_status"))


def score_parts(parts: DataFrame, found: DataFrame, rule: DataFrame, ml: DataFrame, ml_available: bool = False, keys=PART) -> DataFrame:
    """One row a part (or whatever the keys name): counts, overall score 0 to 100, label, penalty, mean rule score."""
    keys = list(keys)
    counts = summarize_findings(found, keys).drop("major_checks")
    means = mean_face_score(parts, rule, "rule_face_mean", keys)
    rows = parts.select(*keys).join(counts, keys, "left").join(means, keys)
    if ml_available:
        rows = rows.join(mean_face_score(parts, ml, "ml_mean", keys).select(*keys, "ml_mean"), keys)
    else:
        rows = rows.withColumn("ml_mean", F.lit(0.0))
    return with_scores(rows.na.fill(0))


def with_scores(rows: DataFrame) -> DataFrame:
    """Add ml_penalty, overall (0 to 100) and label to rows of n_critical, n_major, n_minor, ml_mean."""
    penalty = F.col("ml_mean") * ML_POINTS
    left = 100.0 - MAJOR_POINTS * F.col("n_major") - MINOR_POINTS * F.col("n_minor") - penalty
    overall = F.when(F.col("n_critical") > 0, 0.0).otherwise(F.greatest(F.lit(0.0), left))
    return rows.withColumns({"ml_penalty": penalty, "overall": overall}).withColumn("label", score_label("overall"))


def with_complexity(rows: DataFrame) -> DataFrame:
    return rows.withColumn("complexity", complexity_tier("face_count"))


def _ranked(found: DataFrame, *order, keys=PART) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_findings(found: DataFrame, n: int = 12, keys=PART) -> DataFrame:
    """The n most severe findings of each part (0: all), in stable order, with the part's total."""
    rows = _ranked(found.withColumn("total", F.count("*").over(Window.partitionBy(*keys))), severity_rank("severity"), "finding_seq", keys=keys)
    return rows.filter(F.col("rank") <= n) if n else rows


def head_findings(found: DataFrame, n: int = 8) -> DataFrame:
    return _ranked(found, "finding_seq").filter(F.col("rank") <= n)


def suggest_fixes(found: DataFrame, n: int = 5, keys=PART) -> DataFrame:
    """The worst finding of each check, the n worst of these a part, with totals."""
    rows = found.withColumn("total_findings", F.count("*").over(Window.partitionBy(*keys)))
    first = F.row_number().over(Window.partitionBy(*keys, "check").orderBy(severity_rank("severity"), "finding_seq"))
    rows = _ranked(rows.withColumn("nth", first).filter("nth = 1").drop("nth"), severity_rank("severity"), "finding_seq", keys=keys)
    return rows.filter(F.col("rank") <= n).withColumn("returned", F.count("*").over(Window.partitionBy(*keys)))


def catalog_rollup(scored: DataFrame) -> DataFrame:
    """Counts and mean scores by status and tier, with subtotals; ``level`` tells them apart."""
    rows = scored.select(F.col("label").alias("status"), F.col("complexity.tier").alias("tier"), "overall")
    return rows.rollup("status", "tier").agg(F.count("*").alias("parts"), F.avg("overall").alias("mean_score"), F.grouping_id().alias("level"))


def order_parts(rows: DataFrame) -> DataFrame:
    """Smallest parts first, those without a face count (errors) before all."""
    return rows.orderBy(F.coalesce("face_count", F.lit(-1)), "part_id")


def guard_parts(rows: DataFrame, max_faces: int = 800) -> DataFrame:
    """Add status: error (label InvalidInput), skipped as too large, or ok."""
    return rows.withColumn("status", F.when(F.col("label") == "InvalidInput", "error").when(F.col("face_count") > max_faces, "too_large").otherwise("ok"))


def catalog_summary(rows: DataFrame) -> DataFrame:
    """One row over a catalog with columns status, face_count, predicted, n_critical .. n_info."""
    ok = F.col("status") == "ok"
    flagged = ok & (F.col("predicted") != "clean")
    return rows.agg(
        F.count_if(ok).alias("analysed"), F.count_if(F.col("status") == "too_large").alias("skipped"), F.count_if(F.col("status") == "error").alias("errored"), F.count_if(flagged).alias("flagged"),
        F.min(F.when(ok, F.col("face_count"))).alias("min_faces"), F.max(F.when(ok, F.col("face_count"))).alias("max_faces"), F.count_if(ok & (F.col("face_count") > 200)).alias("large_parts"),
        *[F.sum(F.when(ok, F.col(f"n_{s.lower()}")).otherwise(0)).alias(f"sum_{s.lower()}") for s in SEVERITIES],
        F.try_divide(F.count_if(flagged), F.count_if(ok)).alias("false_positive_rate"),
    )
