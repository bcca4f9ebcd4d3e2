"""B-rep tables derived from the star-schema test tables, in Spark and, word for word, in DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import bucket_count, clustered, era
from ..common import table as read
from ..schemas import Tables

# Expressions that both engines read alike.
_PART = {
    "part_id": "p_partkey",
    "stem": "p_brand || '_' || CAST(CAST(floor(p_partkey / 4) AS BIGINT) AS VARCHAR(20)) || '__' || CASE p_partkey % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'open_shell' WHEN 2 THEN 'sliver_face' ELSE 'self_intersection' END",
    "is_valid": "p_partkey % 97 <> 0",
    "load_check": "CASE p_partkey % 97 * 10 + p_partkey % 7 WHEN 0 THEN 'FileNotFound' WHEN 1 THEN 'LoadError' WHEN 2 THEN 'NullShape' WHEN 3 THEN 'AnalysisTimeout' WHEN 4 THEN 'AnalysisError' END",
    "n_solids": "CAST(p_partkey % 4 AS INT)",
    "xmin": "CAST(0 AS DOUBLE)", "ymin": "CAST(0 AS DOUBLE)", "zmin": "CAST(0 AS DOUBLE)",
    "xmax": "CAST(p_size AS DOUBLE)", "ymax": "p_retailprice / 10", "zmax": "CAST(p_partkey % 7 * 5 + 1 AS DOUBLE)",
}
_TYPE = (
    "CASE WHEN l_linenumber = 7 AND l_suppkey % 16 = 3 THEN 'bspline' WHEN l_returnflag = 'R' THEN 'cylinder' WHEN l_returnflag = 'A' THEN 'plane' "
    "WHEN l_linenumber % 3 = 0 THEN 'cone' WHEN l_linenumber % 3 = 1 THEN 'plane' ELSE 'torus' END"
)
_FACE = {
    "part_id": "l_partkey",
    "surface_type": _TYPE,
    "area": "l_extendedprice / 100",
    "nx": "l_quantity - 25", "ny": "l_discount * 100 - 5", "nz": "l_tax * 100 - 4",
    "mean_curvature": "CAST(0 AS DOUBLE)",
    "radius": f"CASE WHEN ({_TYPE}) = 'cylinder' THEN l_quantity / 10 END",
    "du": "l_discount", "dv": "l_tax",
    "xmin": "CAST(l_linenumber AS DOUBLE)", "ymin": "CAST(l_suppkey % 4 AS DOUBLE)", "zmin": "CAST(0 AS DOUBLE)",
    "xmax": "CAST(l_linenumber + 1 AS DOUBLE)", "ymax": "CAST(l_suppkey % 4 + 2 AS DOUBLE)", "zmax": "CAST(1 + l_linenumber % 2 AS DOUBLE)",
    "edge_index": "CAST(l_suppkey % 16 AS INT)",
    "orientation": "CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END",
    "loop_position": "CAST(l_linenumber AS INT)",
}
_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]
#: What line items give.
_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
_LENGTH = "CASE WHEN edge_index = 0 THEN CAST(0 AS DOUBLE) WHEN edge_index < 3 THEN max_dim * 0.001 * (edge_index + 1) WHEN edge_index < 8 THEN max_dim * 0.02 * edge_index ELSE max_dim * 0.1 * edge_index END"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(*[f"{e.replace('VARCHAR(20)', 'STRING')} AS {c}" for c, e in _PART.items()])


_STORED: dict[tuple, Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The derived catalog, written to the shared folder in buckets of parts once an application: jobs read a catalog, they don't derive it.

    Uses are shuffled once; faces and edges are made of them, and uses are read from them, where they lie.
    """
    key = era(spark), sf_dir
    if key not in _STORED:
        n = bucket_count(spark, read(spark, sf_dir, "lineitem").count())
        keep = lambda df, name: clustered(df, name, ["part_id"], n)
        p, base = keep(parts(spark, sf_dir), "parts"), keep(uses(spark, sf_dir, n), "uses")
        coedges = base.select("part_id", F.col("face_index").alias("coedge_index"), "face_index", "edge_index", "orientation", "loop_position")
        _STORED[key] = Tables(p.drop("n_solids"), keep(_solids(p), "solids"), keep(_faces(base, p), "faces"), keep(_edges(coedges, p), "edges"), coedges, n)
    return _STORED[key]


def uses(spark: SparkSession, sf_dir: str, buckets: int) -> DataFrame:
    """A row a line item, which is a face and a use of an edge, with its number in the part."""
    index = F.row_number().over(Window.partitionBy("l_partkey").orderBy(*_ORDER)) - 1
    rows = read(spark, sf_dir, "lineitem").select(*_LINE).repartition(buckets, "l_partkey")
    return rows.select("*", index.alias("face_index")).selectExpr("face_index", *[f"{e} AS {c}" for c, e in _FACE.items()])


def _faces(base: DataFrame, p: DataFrame) -> DataFrame:
    faces = base.join(p.select("part_id", "n_solids"), "part_id")
    return faces.select(
        "part_id", F.when(F.col("n_solids") > 0, F.col("face_index") % F.expr("nullif(n_solids, 0)")).cast("int").alias("solid_id"), "face_index", "surface_type", "area", F.array("nx", "ny", "nz").alias("normal"),
        "mean_curvature", F.array(F.lit(0.0), "du", F.lit(0.0), "dv").alias("uv_bounds"), "radius", "xmin", "ymin", "zmin", "xmax", "ymax", "zmax",
    )


def _edges(coedges: DataFrame, p: DataFrame) -> DataFrame:
    scale = p.select("part_id", F.greatest("xmax", "ymax", "zmax").alias("max_dim"))
    return coedges.select("part_id", "edge_index").distinct().join(scale, "part_id").selectExpr("part_id", "edge_index", f"{_LENGTH} AS length", "edge_index = 0 AND part_id % 5 = 0 AS is_degenerated")


def _solids(p: DataFrame) -> DataFrame:
    solids = p.filter("n_solids > 0").select("part_id", "xmax", F.explode(F.sequence(F.lit(0), F.col("n_solids") - 1)).alias("solid_id"))
    return solids.selectExpr(
        "part_id", "solid_id", "CAST(0 AS DOUBLE) AS xmin", "CAST(0 AS DOUBLE) AS ymin", "CAST(0 AS DOUBLE) AS zmin", "xmax",
        "CAST(10 * (1 + CASE WHEN part_id % 5 = 0 THEN 0 ELSE solid_id END) AS DOUBLE) AS ymax", "xmax / CASE WHEN part_id % 11 = 0 THEN 200 ELSE 2 END AS zmax",
    )


_P = ", ".join(f"{e} AS {c}" for c, e in _PART.items())
_F = ", ".join(f"{e} AS {c}" for c, e in _FACE.items())

#: DuckDB: the same tables as common table expressions (without a leading WITH).
VIEWS = f"""
parts AS (SELECT {_P}, greatest(CAST(p_size AS DOUBLE), p_retailprice / 10, CAST(p_partkey % 7 * 5 + 1 AS DOUBLE)) AS max_dim FROM part),
base AS (SELECT row_number() OVER (PARTITION BY l_partkey ORDER BY {", ".join(_ORDER)}) - 1 AS face_index, {_F} FROM lineitem),
faces AS (SELECT base.* EXCLUDE (edge_index, orientation, loop_position), CASE WHEN n_solids > 0 THEN face_index % n_solids END AS solid_id FROM base JOIN parts USING (part_id)),
coedges AS (SELECT part_id, face_index AS coedge_index, face_index, edge_index, orientation, loop_position FROM base),
edges AS (SELECT part_id, edge_index, {_LENGTH} AS length, edge_index = 0 AND part_id % 5 = 0 AS is_degenerated FROM (SELECT DISTINCT part_id, edge_index FROM coedges) JOIN parts USING (part_id)),
solids AS (SELECT part_id, CAST(s AS INT) AS solid_id, 0.0::DOUBLE AS xmin, 0.0::DOUBLE AS ymin, 0.0::DOUBLE AS zmin, xmax, CAST(10 * (1 + CASE WHEN part_id % 5 = 0 THEN 0 ELSE s END) AS DOUBLE) AS ymax,
  xmax / CASE WHEN part_id % 11 = 0 THEN 200 ELSE 2 END AS zmax FROM (SELECT part_id, xmax, unnest(range(0, n_solids)) AS s FROM parts))
"""
#: DuckDB: incidence, adjacency, degree.
TOPOLOGY = """
seen AS (SELECT part_id, edge_index, face_index, min(coedge_index) AS pos FROM coedges GROUP BY ALL),
incident AS (SELECT part_id, edge_index, list(face_index ORDER BY pos) AS fs FROM seen GROUP BY ALL),
edge_uses AS (SELECT part_id, edge_index, count(*) AS uses, sum(orientation) AS turn FROM coedges GROUP BY ALL),
adjacency AS (SELECT DISTINCT part_id, least(fs[1], fs[2]) AS face_a, greatest(fs[1], fs[2]) AS face_b FROM incident WHERE len(fs) >= 2),
degree AS (SELECT part_id, face_index, count(*) AS degree FROM (SELECT part_id, face_a AS face_index FROM adjacency UNION ALL SELECT part_id, face_b FROM adjacency) GROUP BY ALL)
"""
#: DuckDB: findings and rule scores.
CHECKS = """
good AS (SELECT * FROM parts WHERE is_valid AND load_check IS NULL),
use_rows AS (SELECT c.part_id, c.face_index, c.edge_index, e.length, e.is_degenerated, u.uses, u.turn, p.max_dim FROM coedges c JOIN edges e USING (part_id, edge_index) JOIN edge_uses u USING (part_id, edge_index) JOIN good p USING (part_id)),
face_rows AS (SELECT f.*, p.max_dim, count(*) OVER (PARTITION BY f.part_id, f.xmin, f.ymin, f.zmin, f.xmax, f.ymax, f.zmax) AS alike FROM faces f JOIN good p USING (part_id)),
all_uses AS (SELECT part_id, edge_index, length, is_degenerated, max_dim FROM use_rows UNION ALL SELECT e.part_id, e.edge_index, e.length, e.is_degenerated, p.max_dim FROM edges e JOIN good p USING (part_id) ANTI JOIN edge_uses u ON u.part_id = e.part_id AND u.edge_index = e.edge_index),
use_facts AS (SELECT part_id, count(*) AS edge_count, count(*) FILTER (abs(length) <= 1e-7) AS zero_edges, count(DISTINCT edge_index) FILTER (is_degenerated) AS degenerate_edges,
  count(*) FILTER (length > 1e-7 AND length < max_dim * 0.005) AS short_edges, count(*) FILTER (length > 1e-7 AND length < max_dim * 0.2) AS small_edges FROM all_uses GROUP BY ALL),
edge_facts AS (SELECT part_id, count(*) FILTER (uses > 2) AS crowded_edges, count(*) FILTER (uses = 1) AS open_edges, count(*) FILTER (uses = 2 AND abs(turn) = 2) AS same_way_edges FROM edge_uses GROUP BY ALL),
face_facts AS (SELECT part_id, count(*) AS face_count, count(*) FILTER (area > 0 AND area < max_dim * max_dim * 0.02) AS small_faces, count(*) FILTER (surface_type = 'cylinder' AND radius <= max_dim * 0.03) AS small_cylinders,
  count(*) FILTER (surface_type IN ('bspline', 'bezier')) AS freeform_faces FROM face_rows GROUP BY ALL),
face_twins AS (SELECT part_id, sum(n - 1) AS duplicate_faces FROM (SELECT part_id, count(*) AS n FROM faces GROUP BY part_id, xmin, ymin, zmin, xmax, ymax, zmax) GROUP BY ALL),
solid_dims AS (SELECT *, least(xmax - xmin, ymax - ymin, zmax - zmin) AS lo, greatest(xmax - xmin, ymax - ymin, zmax - zmin) AS hi FROM solids),
solid_facts AS (SELECT part_id, count(*) AS solid_count, count(*) - count(DISTINCT (xmin, ymin, zmin, xmax, ymax, round(zmax, 5))) AS duplicate_solids,
  count(*) FILTER (lo > 0 AND hi / lo >= 100) AS thin_solids, max(hi / lo) FILTER (lo > 0) AS worst_aspect FROM solid_dims GROUP BY ALL),
sharp_rows AS (SELECT * FROM (SELECT i.part_id, i.edge_index, fs[1] AS fa, fs[2] AS fb, degrees(acos(least(1.0, greatest(-1.0, (a.nx * b.nx + a.ny * b.ny + a.nz * b.nz) / nullif(sqrt(a.nx * a.nx + a.ny * a.ny + a.nz * a.nz) * sqrt(b.nx * b.nx + b.ny * b.ny + b.nz * b.nz), 0))))) AS angle
  FROM incident i JOIN faces a ON a.part_id = i.part_id AND a.face_index = fs[1] JOIN faces b ON b.part_id = i.part_id AND b.face_index = fs[2] WHERE len(fs) = 2) WHERE angle < 15),
sharp_facts AS (SELECT part_id, count(*) AS sharp_edges FROM sharp_rows GROUP BY ALL),
facts AS (SELECT p.part_id, p.stem, p.max_dim, least(xmax - xmin, ymax - ymin, zmax - zmin) AS min_dim, coalesce(face_count, 0) AS face_count, coalesce(edge_count, 0) AS edge_count, coalesce(zero_edges, 0) AS zero_edges,
  coalesce(degenerate_edges, 0) AS degenerate_edges, coalesce(short_edges, 0) AS short_edges, coalesce(small_edges, 0) AS small_edges, coalesce(crowded_edges, 0) AS crowded_edges, coalesce(open_edges, 0) AS open_edges,
  coalesce(same_way_edges, 0) AS same_way_edges, coalesce(small_faces, 0) AS small_faces, coalesce(small_cylinders, 0) AS small_cylinders, coalesce(freeform_faces, 0) AS freeform_faces, coalesce(duplicate_faces, 0) AS duplicate_faces,
  coalesce(solid_count, 0) AS solid_count, coalesce(duplicate_solids, 0) AS duplicate_solids, coalesce(thin_solids, 0) AS thin_solids, worst_aspect, coalesce(sharp_edges, 0) AS sharp_edges
  FROM good p LEFT JOIN face_facts USING (part_id) LEFT JOIN use_facts USING (part_id) LEFT JOIN edge_facts USING (part_id) LEFT JOIN face_twins USING (part_id) LEFT JOIN solid_facts USING (part_id) LEFT JOIN sharp_facts USING (part_id)),
findings AS (
  SELECT part_id, 0 AS finding_seq, 'DegenerateGeometry' AS "check", 'Major' AS severity, face_count::DOUBLE AS measure FROM facts WHERE face_count = 0 OR edge_count = 0
  UNION ALL SELECT part_id, 1, 'DegenerateEdges', 'Major', zero_edges FROM facts WHERE zero_edges > 0
  UNION ALL SELECT part_id, 2, 'NonManifoldEdges', 'Major', crowded_edges FROM facts WHERE crowded_edges > 0
  UNION ALL SELECT part_id, 3, 'OpenBoundaries', 'Major', face_count FROM facts WHERE face_count > 0 AND solid_count = 0
  UNION ALL SELECT part_id, 4, 'OpenBoundaries', 'Major', open_edges FROM facts WHERE open_edges > 0
  UNION ALL SELECT part_id, 5, 'DegenerateTopology', 'Major', degenerate_edges FROM facts WHERE degenerate_edges > 0
  UNION ALL SELECT part_id, 6, 'PotentialGaps', 'Major', same_way_edges FROM facts WHERE open_edges = 0 AND same_way_edges > 0
  UNION ALL SELECT part_id, 7, 'ShortEdges', CASE WHEN short_edges >= 8 THEN 'Major' ELSE 'Minor' END, short_edges FROM facts WHERE max_dim > 0 AND short_edges > 0
  UNION ALL SELECT part_id, 8, 'ThinWalls', 'Major', min_dim / max_dim FROM facts WHERE min_dim / max_dim < 0.03
  UNION ALL SELECT part_id, 9, 'SmallFeatures', 'Minor', small_faces + small_edges FROM facts WHERE max_dim > 0 AND small_faces + small_edges > 0
  UNION ALL SELECT part_id, 10, 'SmallFilletsOrHoles', 'Minor', small_cylinders FROM facts WHERE max_dim > 0 AND small_cylinders > 0
  UNION ALL SELECT part_id, 11, 'DuplicateBodyHeuristic', 'Major', duplicate_solids FROM facts WHERE solid_count > 1 AND duplicate_solids > 0
  UNION ALL SELECT part_id, 12, 'ThinSolid', 'Major', worst_aspect FROM facts WHERE thin_solids > 0
  UNION ALL SELECT part_id, 13, 'DuplicateFaceHeuristic', CASE WHEN solid_count = 0 THEN 'Major' ELSE 'Minor' END, duplicate_faces FROM facts WHERE duplicate_faces > 0
  UNION ALL SELECT part_id, 14, 'OrientationNuance', 'Minor', face_count FROM facts WHERE face_count > 0 AND solid_count = 0
  UNION ALL SELECT part_id, 15, 'SharpEdges', 'Minor', sharp_edges FROM facts WHERE sharp_edges > 0
  UNION ALL SELECT part_id, 16, 'SelfIntersectionSkipped', 'Minor', CASE WHEN freeform_faces > 0 THEN freeform_faces ELSE face_count END FROM facts WHERE freeform_faces > 0 OR face_count > 150
  UNION ALL SELECT part_id, 17, 'MultiBodyDetected', 'Info', solid_count FROM facts WHERE solid_count > 1),
rule_rows AS (
  SELECT part_id, face_index, 1.0 AS score FROM use_rows WHERE uses <> 2
  UNION ALL SELECT part_id, face_index, 0.9 FROM use_rows WHERE is_degenerated
  UNION ALL SELECT part_id, face_index, least(1, greatest(0.1, 1 - length / (max_dim * 0.005))) FROM use_rows WHERE length > 1e-7 AND length < max_dim * 0.005
  UNION ALL SELECT part_id, face_index, least(1, greatest(0.1, 1 - length / (max_dim * 0.2))) FROM use_rows WHERE length > 1e-7 AND length < max_dim * 0.2
  UNION ALL SELECT part_id, face_index, least(1, greatest(0.1, 1 - area / (max_dim * max_dim * 0.02))) FROM face_rows WHERE area > 0 AND area < max_dim * max_dim * 0.02
  UNION ALL SELECT part_id, face_index, least(1, greatest(0.1, 1 - radius / (max_dim * 0.03))) FROM face_rows WHERE surface_type = 'cylinder' AND radius <= max_dim * 0.03
  UNION ALL SELECT part_id, face_index, 0.8 FROM face_rows WHERE alike > 1
  UNION ALL SELECT part_id, face_index, least(1, greatest(0.1, 1 - min_dim / facts.max_dim / 0.03)) FROM faces JOIN facts USING (part_id) WHERE min_dim / facts.max_dim < 0.03
  UNION ALL SELECT part_id, face_index, 0.8 FROM faces JOIN facts USING (part_id) WHERE solid_count = 0
  UNION ALL SELECT part_id, face_index, 0.7 FROM faces JOIN facts USING (part_id) WHERE open_edges = 0 AND same_way_edges > 0
  UNION ALL SELECT part_id, unnest([fa, fb]), least(1, greatest(0.3, 1 - angle / 15)) FROM sharp_rows JOIN good USING (part_id)),
rule_scores AS (SELECT part_id, face_index, max(score) AS score FROM rule_rows GROUP BY ALL),
ml_scores AS (SELECT part_id, face_index, least(1.0, 0.32 + CASE WHEN area <= 1e-6 THEN 0.18 ELSE least(0.18, 1 / (1 + area)) END + CASE WHEN surface_type IN ('plane', 'cylinder') THEN 0 ELSE 0.08 END
  + least(0.22, 0.03 * coalesce(degree, 0)) + least(0.1, 0.02 * (abs(nx) + abs(ny) + abs(nz)))) AS score FROM faces LEFT JOIN degree USING (part_id, face_index)),
fused AS (SELECT part_id, face_index, 0.6 * greatest(r, m) + 0.4 * least(r, m) AS score, m FROM (SELECT part_id, face_index, coalesce(r.score, 0) AS r, coalesce(m.score, 0.5) AS m FROM rule_scores r FULL JOIN (SELECT m.* FROM ml_scores m JOIN good USING (part_id)) m USING (part_id, face_index))),
digest AS (SELECT part_id, count(*) AS total, count(*) FILTER (severity = 'Critical') AS n_critical, count(*) FILTER (severity = 'Major') AS n_major, count(*) FILTER (severity = 'Minor') AS n_minor, count(*) FILTER (severity = 'Info') AS n_info FROM findings GROUP BY ALL),
scored AS (SELECT part_id, f.face_count, coalesce(total, 0) AS total, coalesce(n_critical, 0) AS n_critical, coalesce(n_major, 0) AS n_major, coalesce(n_minor, 0) AS n_minor, coalesce(n_info, 0) AS n_info, coalesce(rule_mean, 0) AS rule_face_mean, coalesce(ml_mean, 0) AS ml_mean,
  greatest(0.0, 100 - 15 * coalesce(n_major, 0) - 5 * coalesce(n_minor, 0) - 20 * coalesce(ml_mean, 0)) AS overall FROM facts f LEFT JOIN digest USING (part_id)
  LEFT JOIN (SELECT part_id, avg(score) AS rule_mean FROM rule_scores GROUP BY ALL) USING (part_id) LEFT JOIN (SELECT part_id, avg(score) AS ml_mean FROM ml_scores GROUP BY ALL) USING (part_id)),
labelled AS (SELECT *, CASE WHEN overall >= 90 THEN 'SimulationReady' WHEN overall >= 70 THEN 'ReviewRecommended' WHEN overall >= 40 THEN 'NeedsAttention' ELSE 'NotReady' END AS label,
  CASE WHEN face_count <= 50 THEN 'simple' WHEN face_count <= 200 THEN 'moderate' WHEN face_count <= 1000 THEN 'complex' ELSE 'very_complex' END AS tier FROM scored),
everything AS (SELECT * FROM labelled UNION ALL BY NAME SELECT part_id, 0::BIGINT AS total, 0::BIGINT AS n_critical, 0::BIGINT AS n_major, 0::BIGINT AS n_minor, 0::BIGINT AS n_info, 'InvalidInput' AS label FROM parts WHERE NOT (is_valid AND load_check IS NULL))
"""
#: DuckDB: the tables of the bodies of parts with several, under keys of their own: part_id * 1000 + solid_id + 1.
_RAW = re.sub(r"\b(parts|faces|coedges|edges|solids)\b(?! VARCHAR)", r"all_\1", VIEWS)
BODIES = f"""{_RAW},
many AS (SELECT part_id FROM all_solids GROUP BY part_id HAVING count(*) > 1),
parts AS (SELECT s.part_id * 1000 + s.solid_id + 1 AS part_id, p.stem, p.is_valid, p.load_check, s.xmin, s.ymin, s.zmin, s.xmax, s.ymax, s.zmax, greatest(s.xmax, s.ymax, s.zmax) AS max_dim FROM all_solids s JOIN all_parts p USING (part_id) JOIN many USING (part_id)),
faces AS (SELECT f.* REPLACE (part_id * 1000 + solid_id + 1 AS part_id) FROM all_faces f JOIN many USING (part_id) WHERE solid_id IS NOT NULL),
coedges AS (SELECT c.part_id * 1000 + f.solid_id + 1 AS part_id, c.coedge_index, c.face_index, c.edge_index, c.orientation, c.loop_position FROM all_coedges c JOIN all_faces f USING (part_id, face_index) JOIN many USING (part_id) WHERE f.solid_id IS NOT NULL),
edges AS (SELECT c.part_id, e.edge_index, e.length, e.is_degenerated FROM all_edges e JOIN (SELECT DISTINCT part_id, edge_index FROM coedges) c ON c.part_id // 1000 = e.part_id AND c.edge_index = e.edge_index),
solids AS (SELECT s.* REPLACE (part_id * 1000 + solid_id + 1 AS part_id) FROM all_solids s JOIN many USING (part_id))
"""

# Values that cannot be computed, as both engines read the conditions: (table, column, when).
_LOST = (
    ("faces", "area", "part_id % 17 = 2 AND face_index = 1"),
    ("faces", "radius", "part_id % 19 = 3"),
    ("faces", "xmax", "part_id % 31 = 6 AND face_index = 2"),
    ("edges", "length", "part_id % 23 = 4 AND edge_index = 5"),
    ("solids", "zmax", "part_id % 29 = 5 AND solid_id = 0"),
)
_SHORT_NORMAL = "part_id % 13 = 1 AND face_index = 0"
_NULLED = {t: ", ".join(f"CASE WHEN {w} THEN NULL ELSE {x} END AS {x}" for y, x, w in (*_LOST, ("faces", "nz", _SHORT_NORMAL)) if y == t) for t in ("faces", "edges", "solids")}
#: DuckDB: the tables with lost values, and (part_id, seq, n) of what the checks of the catalog lose by them.
MALFORMED = f"""{_RAW},
parts AS (SELECT * FROM all_parts), coedges AS (SELECT * FROM all_coedges),
{", ".join(f"{t} AS (SELECT * REPLACE ({x}) FROM all_{t})" for t, x in _NULLED.items())}
"""
LOST = """
lost_edges AS (SELECT part_id, count(*) AS n FROM edges WHERE length IS NULL GROUP BY ALL),
lost_areas AS (SELECT part_id, count(*) AS n FROM faces WHERE area IS NULL GROUP BY ALL),
lost_solids AS (SELECT part_id, count(*) AS n FROM solids WHERE zmax IS NULL GROUP BY ALL),
lost_angles AS (SELECT i.part_id, count(*) AS n FROM incident i JOIN faces a ON a.part_id = i.part_id AND a.face_index = fs[1] JOIN faces b ON b.part_id = i.part_id AND b.face_index = fs[2]
  WHERE len(fs) = 2 AND (a.nz IS NULL OR b.nz IS NULL) GROUP BY ALL),
lost AS (SELECT part_id, seq, sum(n)::DOUBLE AS n FROM (
  SELECT part_id, unnest([1, 7, 9]) AS seq, n FROM lost_edges UNION ALL SELECT part_id, 9, n FROM lost_areas UNION ALL SELECT part_id, unnest([11, 12]), n FROM lost_solids UNION ALL SELECT part_id, 15, n FROM lost_angles
  UNION ALL SELECT part_id, 10, count(*) FROM faces WHERE surface_type = 'cylinder' AND radius IS NULL GROUP BY ALL UNION ALL SELECT part_id, 13, count(*) FROM faces WHERE xmax IS NULL GROUP BY ALL
) JOIN good USING (part_id) GROUP BY ALL)
"""


def _degraded() -> dict[str, str]:
    """DuckDB: the tables of each defect, under part ids of their own."""
    from ..operators.boxes import USES

    key = lambda k: f"part_id * 10 + {k} AS part_id"
    box = ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")
    src = f"""{_RAW},
src AS (SELECT p.*, greatest(1.0, sqrt((xmax - xmin) ** 2 + (ymax - ymin) ** 2 + (zmax - zmin) ** 2)) AS diag, coalesce(f.n, 0) AS n_faces, coalesce(f.m + 1, 0) AS nf, coalesce(e.m + 1, 0) AS ne, coalesce(c.m + 1, 0) AS nu, coalesce(s.m + 1, 0) AS ns
  FROM all_parts p LEFT JOIN (SELECT part_id, count(*) AS n, max(face_index) AS m FROM all_faces GROUP BY ALL) f USING (part_id) LEFT JOIN (SELECT part_id, max(edge_index) AS m FROM all_edges GROUP BY ALL) e USING (part_id)
  LEFT JOIN (SELECT part_id, max(coedge_index) AS m FROM all_coedges GROUP BY ALL) c USING (part_id) LEFT JOIN (SELECT part_id, max(solid_id) AS m FROM all_solids GROUP BY ALL) s USING (part_id) WHERE load_check IS NULL)"""

    def parts(k: int, name: str, boxes: dict[str, str], source: str = "src") -> str:
        dims = ", ".join(f"{boxes[a + 'max']} - {boxes[a + 'min']}" for a in "xyz")
        return f"parts AS (SELECT {key(k)}, stem || '__{name}' AS stem, is_valid, load_check, {', '.join(f'{e} AS {c}' for c, e in boxes.items())}, greatest({dims}) AS max_dim FROM {source})"

    faces = "surface_type, area, nx, ny, nz, mean_curvature, radius, du, dv"
    uses = "orientation, loop_position"
    shell = ", ".join(f"{c[1:]}({c}) AS b_{c}" for c in box)
    open_shell = f"""{src}, shell AS (SELECT f.* FROM all_faces f JOIN src USING (part_id) WHERE n_faces >= 2 AND face_index <> 0), around AS (SELECT src.*, b.* EXCLUDE (part_id) FROM src JOIN (SELECT part_id, {shell} FROM shell GROUP BY ALL) b USING (part_id)),
{parts(1, "open_shell", {c: "b_" + c for c in box}, "around")}, faces AS (SELECT {key(1)}, face_index, {faces}, {', '.join(box)}, NULL::INT AS solid_id FROM shell),
coedges AS (SELECT c.part_id * 10 + 1 AS part_id, coedge_index, face_index, edge_index, {uses} FROM all_coedges c JOIN src USING (part_id) WHERE n_faces >= 2 AND face_index <> 0),
edges AS (SELECT {key(1)}, edge_index, length, is_degenerated FROM all_edges WHERE (part_id * 10 + 1, edge_index) IN (SELECT (part_id, edge_index) FROM coedges)), solids AS (SELECT * FROM all_solids WHERE false)"""
    six = ", ".join(f"({2 * k + (s > 0)}, {k}, {s})" for k in range(3) for s in (-1, 1))
    top = ("0.1 * diag", "0.1 * diag", "0.001")
    area = ("0.1 * diag * 0.001", "0.1 * diag * 0.001", "0.1 * diag * (0.1 * diag)")
    at = lambda k, end: f"CASE WHEN axis = {k} THEN CASE WHEN side > 0 THEN {top[k]} ELSE 0 END ELSE {top[k] if end == 'max' else 0} END"
    sliver_face = f"""{src}, {parts(2, "sliver_face", {c: f"least({c}, 0.0)" if c.endswith("min") else f"greatest({c}, {t})" for c, t in zip(box, (0, 0, 0, *top))})},
faces AS (SELECT f.part_id * 10 + 2 AS part_id, face_index, {faces}, {', '.join('f.' + c for c in box)}, solid_id FROM all_faces f JOIN src USING (part_id) UNION ALL SELECT {key(2)}, nf + i, 'plane', CASE axis WHEN 0 THEN {area[0]} WHEN 1 THEN {area[1]} ELSE {area[2]} END,
  {', '.join(f"CASE WHEN axis = {k} THEN side ELSE 0 END" for k in range(3))}, 0, NULL, 0, 0, {', '.join(at(k, e) for e in ("min", "max") for k in range(3))}, ns FROM src, (VALUES {six}) AS v(i, axis, side)),
edges AS (SELECT e.part_id * 10 + 2 AS part_id, edge_index, length, is_degenerated FROM all_edges e JOIN src USING (part_id) UNION ALL SELECT {key(2)}, ne + i, CASE WHEN i < 8 THEN 0.1 * diag ELSE 0.001 END, false FROM src, (SELECT unnest(range(12)) AS i)),
coedges AS (SELECT c.part_id * 10 + 2 AS part_id, coedge_index, face_index, edge_index, {uses} FROM all_coedges c JOIN src USING (part_id) UNION ALL SELECT {key(2)}, nu + i, nf + f, ne + e, o, k FROM src, (VALUES {', '.join(str((i, *u)) for i, u in enumerate(USES))}) AS v(i, f, e, k, o)),
solids AS (SELECT s.part_id * 10 + 2 AS part_id, solid_id, {', '.join('s.' + c for c in box)} FROM all_solids s JOIN src USING (part_id) UNION ALL SELECT {key(2)}, ns, 0, 0, 0, {', '.join(top)} FROM src)"""
    moved = lambda t: ", ".join(f"{t}.{c} + 0.25 * diag" if c[0] == "x" else f"{t}.{c}" for c in box)
    both = lambda t, own, copy: f"SELECT t.part_id * 10 + 3 AS part_id, {own} FROM all_{t} t JOIN src USING (part_id) UNION ALL SELECT t.part_id * 10 + 3, {copy} FROM all_{t} t JOIN src USING (part_id)"
    plain = ", ".join("t." + c for c in box)
    self_intersection = f"""{src}, {parts(3, "self_intersection", {c: f"greatest({c}, {c} + 0.25 * diag)" if c == "xmax" else c for c in box})},
faces AS ({both("faces", f"face_index, {faces}, {plain}, solid_id", f"face_index + nf, {faces}, {moved('t')}, solid_id + ns")}), edges AS ({both("edges", "edge_index, length, is_degenerated", "edge_index + ne, length, is_degenerated")}),
coedges AS ({both("coedges", f"coedge_index, face_index, edge_index, {uses}", f"coedge_index + nu, face_index + nf, edge_index + ne, {uses}")}), solids AS ({both("solids", f"solid_id, {plain}", f"solid_id + ns, {moved('t')}")})"""
    own = lambda t, columns: f"{t} AS (SELECT t.part_id * 10 + 4 AS part_id, {columns} FROM all_{t} t JOIN src USING (part_id))"
    zero_length_edge = f"""{src}, {parts(4, "zero_length_edge", {c: f"least({c}, 0.0)" if c.endswith("min") else f"greatest({c}, {1e-9 if c == 'xmax' else 0.0})" for c in box})},
{own("faces", f"face_index, {faces}, {plain}, solid_id")}, {own("coedges", f"coedge_index, face_index, edge_index, {uses}")}, {own("solids", f"solid_id, {plain}")},
edges AS (SELECT t.part_id * 10 + 4 AS part_id, edge_index, length, is_degenerated FROM all_edges t JOIN src USING (part_id) UNION ALL SELECT {key(4)}, ne, 1e-9, false FROM src)"""
    return {"open_shell": open_shell, "sliver_face": sliver_face, "self_intersection": self_intersection, "zero_length_edge": zero_length_edge}


#: DuckDB: the tables of each defect.
DEGRADED = _degraded()


def malformed(t: Tables) -> Tables:
    """The tables with lost values: areas, radii, lengths and boxes that are null, normals of two numbers."""
    faces = t.faces.withColumn("normal", F.when(F.expr(_SHORT_NORMAL), F.slice("normal", 1, 2)).otherwise(F.col("normal")))
    new = {"faces": faces, "edges": t.edges, "solids": t.solids}
    for name, column, when in _LOST:
        new[name] = new[name].withColumn(column, F.when(~F.expr(when), F.col(column)))
    return t.with_(**new)


def sql(select: str, checks: bool = True, views: str = VIEWS) -> str:
    """A DuckDB query over the derived tables."""
    return f"WITH {views}, {TOPOLOGY}{', ' + CHECKS if checks else ''} {select}"
