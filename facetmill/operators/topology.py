"""Topology of B-rep tables: incidence, adjacency, mates, counts, boxes, numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import angle_deg, convexity, cosine
from ..schemas import BOX, Tables

PART = ("part_id",)


def edge_faces(coedges: DataFrame, keys=PART) -> DataFrame:
    """(keys, edge_index, uses, faces): the distinct faces of each edge in coedge order."""
    seen = F.array_sort(F.collect_list(F.struct("coedge_index", "face_index")))
    return coedges.groupBy(*keys, "edge_index").agg(F.count("*").alias("uses"), F.array_distinct(F.transform(seen, lambda x: x["face_index"])).alias("faces"))


def face_adjacency(coedges: DataFrame, keys=PART) -> DataFrame:
    """(keys, face_a, face_b): unordered pairs of the first two faces of each edge, once each."""
    pairs = edge_faces(coedges, keys).filter(F.size("faces") >= 2)
    a, b = F.col("faces")[0], F.col("faces")[1]
    return pairs.select(*keys, F.least(a, b).alias("face_a"), F.greatest(a, b).alias("face_b")).distinct()


def edge_index(adjacency: DataFrame, keys=PART) -> DataFrame:
    """(keys, src, dst): every adjacency in both directions."""
    one = adjacency.select(*keys, F.col("face_a").alias("src"), F.col("face_b").alias("dst"))
    return one.unionByName(adjacency.select(*keys, F.col("face_b").alias("src"), F.col("face_a").alias("dst")))


def face_degree(adjacency: DataFrame, keys=PART) -> DataFrame:
    ends = adjacency.select(*keys, F.explode(F.array("face_a", "face_b")).alias("face_index"))  # no union, so that buckets stay buckets
    return ends.groupBy(*keys, "face_index").agg(F.count("*").alias("degree"))


def edge_features(edges: DataFrame, faces: DataFrame, coedges: DataFrame, keys=PART) -> DataFrame:
    """(keys, edge_index, length, faces, convexity, dihedral_angle, dihedral_signal) of every edge."""
    pairs = edge_faces(coedges, keys)
    normals = faces.select(*keys, "face_index", "normal")
    a = normals.withColumnsRenamed({"face_index": "face_a", "normal": "normal_a"})
    b = normals.withColumnsRenamed({"face_index": "face_b", "normal": "normal_b"})
    two = pairs.withColumns({"face_a": F.try_element_at("faces", F.lit(1)), "face_b": F.try_element_at("faces", F.lit(2))})
    out = edges.select(*keys, "edge_index", "length").join(two, [*keys, "edge_index"], "left").join(a, [*keys, "face_a"], "left").join(b, [*keys, "face_b"], "left")
    has_two = F.col("face_b").isNotNull()
    cos = cosine("normal_a", "normal_b")
    return out.select(
        *keys, "edge_index", "length", F.coalesce("faces", F.array().cast("array<int>")).alias("faces"),
        F.when(has_two, convexity(cos)).otherwise("unknown").alias("convexity"), F.when(has_two, angle_deg("normal_a", "normal_b")).alias("dihedral_angle"), F.when(has_two, cos).alias("dihedral_signal"),
    )


def coedge_mates(coedges: DataFrame, keys=PART) -> DataFrame:
    """(keys, coedge_index, mate): the other use of an edge that has exactly two."""
    w = Window.partitionBy(*keys, "edge_index")
    o = w.orderBy("coedge_index")
    mate = F.coalesce(F.lead("coedge_index").over(o), F.lag("coedge_index").over(o))
    return coedges.withColumns({"uses": F.count("*").over(w), "mate": mate}).filter("uses = 2").select(*keys, "coedge_index", "mate")


def number_coedges(coedges: DataFrame, keys=PART, order=("face_index", "wire_index", "loop_position")) -> DataFrame:
    return coedges.withColumn("coedge_index", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def reindex_faces(faces: DataFrame, keys=("part_id", "solid_id")) -> DataFrame:
    """Add body_face_index: faces of each body numbered from 0."""
    return faces.withColumn("body_face_index", F.row_number().over(Window.partitionBy(*keys).orderBy("face_index")) - 1)


def rollup_bbox(rows: DataFrame, keys=PART) -> DataFrame:
    """The box around all boxes of a key."""
    return rows.groupBy(*keys).agg(*[(F.min if c.endswith("min") else F.max)(c).alias(c) for c in BOX])


def topology_counts(t: Tables) -> DataFrame:
    """Counts per part: faces, oriented edges, unique edges, coedges, adjacent pairs, solids, features that could not be computed."""
    uses = t.coedges.groupBy("part_id").agg(F.count("*").alias("oriented_edges"), F.count_distinct("edge_index").alias("unique_edges"))
    faces = t.faces.groupBy("part_id").agg(F.count("*").alias("face_count"), F.count_if(F.col("area").isNull() | F.isnan("area")).alias("face_feature_errors"))
    pairs = face_adjacency(t.coedges).groupBy("part_id").agg(F.count("*").alias("adjacency_count"))
    solids = t.solids.groupBy("part_id").agg(F.count("*").alias("solid_count"))
    out = t.parts.select("part_id")
    for one in (faces, uses, pairs, solids):
        out = out.join(one, "part_id", "left")
    return out.na.fill(0)
