"""Box-shaped solids as full B-rep tables, and parts of one such solid from a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BOX, Tables

#: Smallest and largest size in x, y and z.
CATEGORIES = {"clean": ((20, 100), (20, 100), (20, 100)), "thin_plate": ((40, 120), (40, 120), (0.05, 0.8))}
#: The four edges of each face, as edge numbers: 0-3 along x, 4-7 along y, 8-11 along z.
FACE_EDGES = [[4, 8, 5, 9], [6, 10, 7, 11], [0, 8, 1, 10], [2, 9, 3, 11], [0, 4, 2, 6], [1, 5, 3, 7]]


def _uses() -> list[tuple[int, int, int, int]]:
    seen: dict[int, int] = {}
    return [(f, e, k, 1 if seen.setdefault(e, f) == f else -1) for f, es in enumerate(FACE_EDGES) for k, e in enumerate(es)]


#: (face, edge, place in its loop, orientation): each edge is used once forwards and once backwards.
USES = _uses()


def uniform(seed: int, key, salt: str):
    """Between 0 and 1, the same in every run: the first 13 hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|{salt}|"), key.cast("string"))), 1, 13), 16, 10).cast("double") / float(16**13)


def box_solid(rows: DataFrame) -> dict[str, DataFrame]:
    """faces, edges, coedges and solids of one box each for rows of (part_id, box): 6, 12, 24 and 1, numbered from 0."""
    size = {a: F.col(f"{a}max") - F.col(f"{a}min") for a in "xyz"}
    areas = (size["y"] * size["z"], size["x"] * size["z"], size["x"] * size["y"])

    def face(axis: int, side: int):
        normal = F.array(*[F.lit(float(side if axis == k else 0)) for k in range(3)])
        flat = "max" if side > 0 else "min"  # where the face lies along its axis
        corners = [F.col(f"{a}{flat if axis == k else end}").alias(f"{a}{end}") for end in ("min", "max") for k, a in enumerate("xyz")]
        return F.struct(F.lit(2 * axis + (side > 0)).alias("face_index"), normal.alias("normal"), areas[axis].alias("area"), *corners)

    six = F.array(*[face(axis, side) for axis in range(3) for side in (-1, 1)])
    side = F.sqrt("area")
    faces = rows.select("part_id", F.explode(six).alias("f")).select("part_id", F.lit(0).alias("solid_id"), "f.*").withColumns({
        "surface_type": F.lit("plane"), "mean_curvature": F.lit(0.0), "uv_bounds": F.array(F.lit(0.0), side, F.lit(0.0), side), "radius": F.lit(None).cast("double"),
    })
    lengths = F.array(*[size[a] for a in "xyz" for _ in range(4)])
    edges = rows.select("part_id", F.posexplode(lengths).alias("edge_index", "length")).withColumn("is_degenerated", F.lit(False))
    names = ("coedge_index", "face_index", "edge_index", "orientation", "loop_position")
    use = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, (i, f, e, o, k))]) for i, (f, e, k, o) in enumerate(USES)])
    coedges = rows.select("part_id", F.explode(use).alias("u")).select("part_id", "u.*")
    return {"faces": faces, "edges": edges, "coedges": coedges, "solids": rows.select("part_id", F.lit(0).alias("solid_id"), *BOX)}


def generate_boxes(spark: SparkSession, n: int, category: str = "clean", seed: int = 0) -> Tables:
    """n parts with 6 faces, 12 edges, 24 oriented edges and 1 solid each."""
    parts = spark.range(n).withColumnRenamed("id", "part_id")
    sizes = {a: F.round(lo + (hi - lo) * uniform(seed, F.col("part_id"), a), 3) for a, (lo, hi) in zip("xyz", CATEGORIES[category])}
    zero = {f"{a}min": F.lit(0.0) for a in "xyz"}
    parts = parts.withColumns({f"{a}max": v for a, v in sizes.items()} | zero)
    parts = parts.withColumns({"stem": F.format_string(f"{category}_%04d", "part_id"), "is_valid": F.lit(True)})
    return Tables(parts=parts, **box_solid(parts))
