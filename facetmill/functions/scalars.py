"""Column functions: geometry, scores, labels and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DEFECT_CLASSES, SEVERITY_RANK, SURFACE_TYPES


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def with_bbox_dims(df: DataFrame) -> DataFrame:
    """Add max_dim and min_dim (smallest dimension above 0); 0 where there is no box."""
    dims = [F.col(f"{a}max") - F.col(f"{a}min") for a in "xyz"]
    positive = F.array_min(F.filter(F.array(*dims), lambda x: x > 0))
    return df.withColumns({"max_dim": F.coalesce(F.greatest(*dims), F.lit(0.0)), "min_dim": F.coalesce(positive, F.lit(0.0))})


def canonical_surface(surface) -> Column:
    known = _c(surface).isin(*SURFACE_TYPES[:-1])
    return F.when(known, _c(surface)).otherwise("other")


def surface_one_hot(surface) -> Column:
    """Seven places; unknown types count as other."""
    return F.array(*[(canonical_surface(surface) == s).cast("double") for s in SURFACE_TYPES])


def surface_one_hot_strict(surface) -> Column:
    """Seven places; unknown types leave all of them 0, as the model's input has it."""
    return F.array(*[F.coalesce(_c(surface) == s, F.lit(False)).cast("double") for s in SURFACE_TYPES])


def with_surface_type(df: DataFrame) -> DataFrame:
    return df.withColumn("one_hot", surface_one_hot("surface_type")).withColumn("surface_type", canonical_surface("surface_type"))


def abs_sum(vector) -> Column:
    """Of a vector in space; null if it is too short."""
    v = _c(vector)
    return F.abs(F.get(v, 0)) + F.abs(F.get(v, 1)) + F.abs(F.get(v, 2))


def face_feature_vector(df: DataFrame, column: str = "features") -> DataFrame:
    """The 12 numbers of a face: surface type, log area, normal sum, curvature, extents in u and v."""
    uv = F.col("uv_bounds")
    rest = F.array(F.log1p(F.greatest("area", F.lit(0.0))), abs_sum("normal"), F.col("mean_curvature"), F.get(uv, 1) - F.get(uv, 0), F.get(uv, 3) - F.get(uv, 2))
    return df.withColumn(column, F.concat(surface_one_hot_strict("surface_type"), rest))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine clamped to [-1, 1]; null if a norm is 0."""
    c = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c)))


def angle_deg(a, b) -> Column:
    """Between two vectors in space; null if a norm is 0."""
    return F.degrees(F.acos(cosine3(a, b)))


def dot3(a, b) -> Column:
    """Dot product in space, place by place (null if one is too short): stays in generated code, unlike ``dot``."""
    x, y = _c(a), _c(b)
    return F.get(x, 0) * F.get(y, 0) + F.get(x, 1) * F.get(y, 1) + F.get(x, 2) * F.get(y, 2)


def cosine3(a, b) -> Column:
    c = F.try_divide(dot3(a, b), F.sqrt(dot3(a, a)) * F.sqrt(dot3(b, b)))
    return F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c)))


def convexity(cos) -> Column:
    c = _c(cos)
    return F.when(c.isNull(), "unknown").when(c > 0.98, "smooth").when(c >= 0, "convex").otherwise("concave")


def guarded(value: Column, kind: str) -> Column:
    """A struct of ``v``, the value, or null if computing it raised an error (ANSI division, index, cast, overflow).

    ``try_to_binary`` gives null for any error of its argument, so the value makes the way through text.
    """
    text = F.decode(F.try_to_binary(F.to_json(F.struct(value.alias("v"))), F.lit("utf-8")), "utf-8")
    return F.from_json(text, f"v {kind}")


def clamp01(score) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), _c(score)))


def ramp(x, threshold, floor: float = 0.1) -> Column:
    """1 at 0, falling to ``floor`` at the threshold."""
    return F.least(F.lit(1.0), F.greatest(F.lit(floor), 1 - F.try_divide(_c(x), _c(threshold))))


# Limits of labels, tiers and colours below.
def score_label(score) -> Column:
    s = _c(score)
    return F.when(s >= 90, "SimulationReady").when(s >= 70, "ReviewRecommended").when(s >= 40, "NeedsAttention").otherwise("NotReady")


def complexity_tier(face_count) -> Column:
    n = _c(face_count)

    def tier(name, label, confidence, note):
        return F.struct(F.lit(name).alias("tier"), F.lit(label).alias("label"), F.lit(confidence).alias("confidence"), F.lit(note).alias("note"))

    return (
        F.when(n <= 50, tier("simple", "Simple", "high", "few faces, like the training parts"))
        .when(n <= 200, tier("moderate", "Moderate", "medium", "within the usual range"))
        .when(n <= 1000, tier("complex", "Complex", "low", "beyond the training range"))
        .otherwise(tier("very_complex", "Very complex", "very_low", "far beyond the training range"))
    )


def severity_rank(severity) -> Column:
    """Critical 0 to Info 3; a missing severity is Info, any other 99."""
    s = F.coalesce(_c(severity), F.lit("Info"))
    out = F.lit(99)
    for name, rank in reversed(SEVERITY_RANK.items()):
        out = F.when(s == name, rank).otherwise(out)
    return out


def score_color(score) -> Column:
    s = _c(score)
    return F.when(s >= 0.75, "#ef4444").when(s >= 0.4, "#f59e0b").otherwise("#22c55e")


def ml_color(score) -> Column:
    s = _c(score)
    return F.when(s >= 0.75, "#fb923c").when(s >= 0.4, "#60a5fa").otherwise("#1d4ed8")


def source_part(stem) -> Column:
    return F.split_part(_c(stem), F.lit("__"), F.lit(1))


def defect_class(tags) -> Column:
    """Label of the first recognised tag, else 0."""
    known = F.array(*map(F.lit, DEFECT_CLASSES[1:]))
    first = F.try_element_at(F.filter(F.coalesce(_c(tags), F.array().cast("array<string>")), lambda t: F.array_contains(known, t)), F.lit(1))
    return F.coalesce(F.array_position(known, first), F.lit(0)).cast("int")


def defect_name(label) -> Column:
    return F.element_at(F.array(*map(F.lit, DEFECT_CLASSES)), _c(label) + 1)


def token_estimate(messages) -> Column:
    """A quarter of the characters of all contents, rounded down."""
    chars = F.aggregate(_c(messages), F.lit(0).cast("long"), lambda n, m: n + F.coalesce(F.char_length(m["content"]), F.lit(0)))
    return F.floor(chars / 4).cast("long")


#: Fixed value: what stands for the rest of a text that was cut.
CUT = "...[truncated]"


def preview(text, n: int = 200) -> Column:
    t = _c(text)
    return F.when(F.char_length(t) > n, F.concat(F.substring(t, 1, n), F.lit(CUT))).otherwise(t)


def l2_normalize(vector) -> Column:
    """Unit length; a zero vector stays as it is."""
    v = _c(vector)
    n = norm(v)
    return F.zip_with(v, F.array_repeat(F.when(n == 0, 1.0).otherwise(n), F.size(v)), lambda x, y: x / y)  # the norm once, not per place


def severity_string(counts: dict[str, Column]) -> Column:
    """Such as ``C1 M4``: first letter and count of each severity that occurs; ``-`` if none."""
    text = F.concat_ws(" ", *[F.when(n > 0, F.concat(F.lit(k[0]), n.cast("string"))) for k, n in counts.items()])
    return F.when(text == "", "-").otherwise(text)


def url_file_name(url) -> Column:
    """Last piece of a URL's path, percent-decoded; ``download`` if empty; ends in .pdf."""
    path = F.coalesce(F.parse_url(_c(url), F.lit("PATH")), F.lit(""))
    last = F.element_at(F.split(path, "/"), -1)
    name = F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)
    name = F.when(F.trim(name) == "", "download").otherwise(name)
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))
