"""Readers and writers: part files, graph payloads, labels, tags, reports, traces, indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import co_located, stored
from ..functions.scalars import url_file_name, with_surface_type
from ..operators.labelling import MANIFEST as LABEL_MANIFEST
from ..operators.topology import edge_features, face_adjacency
from ..schemas import GOLD, GRAPH_FILE, LABEL_FILE, MANIFEST, PROMPTS, TAG_FILE, TRACES, Tables

CORRUPT = "_corrupt"


def list_part_files(spark: SparkSession, dirs: list[str]) -> DataFrame:
    """(path, stem, length): STEP files under the folders, one per path whatever its case, sorted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[sS][tT]*[pP]").load(dirs).select("path", "length")
    files = files.filter(F.lower("path").rlike(r"\.(step|stp)$")).groupBy(F.lower("path")).agg(F.min(F.struct("path", "length")).alias("f")).select("f.*")  # the first spelling in order
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.select("path", stem.alias("stem"), "length").orderBy("path")


def _with_stem(df: DataFrame, suffix: str) -> DataFrame:
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), suffix, "")
    return df.withColumn("stem", F.coalesce("stem", name))


def _payloads(spark: SparkSession, path: str, schema: str, suffix: str, lines: bool) -> DataFrame:
    """JSON documents, one a file of that suffix, or one a line of any files."""
    reader = spark.read.schema(schema)
    return (reader if lines else reader.option("multiLine", True).option("pathGlobFilter", f"*{suffix}")).json(path)


def write_graphs(t: Tables, path: str) -> None:
    """Graph payloads of all parts, one a line of compressed files: what ``read_graphs`` takes."""
    stems = t.parts.select("part_id", "stem")

    def listed(df: DataFrame, name: str, one: Column) -> DataFrame:
        return df.groupBy("part_id").agg(F.array_sort(F.collect_list(one)).alias(name))

    faces = with_surface_type(t.faces)
    names = ["face_index", "surface_type", "one_hot", "area", "normal", "mean_curvature", "uv_bounds"]
    hot = F.transform("one_hot", lambda x: x.cast("int")).alias("one_hot")
    rows = stems.join(listed(faces, "faces", F.struct(*[hot if n == "one_hot" else F.col(n) for n in names])), "part_id", "left")
    edges = edge_features(t.edges, t.faces, t.coedges)
    known = F.struct("edge_index", "length", F.col("faces").alias("connected_faces"), "convexity", "dihedral_angle", "dihedral_signal")
    rows = rows.join(listed(edges, "edges", known), "part_id", "left")
    rows = rows.join(listed(t.coedges, "coedges", F.struct("coedge_index", "face_index", "edge_index", "orientation", "loop_position")), "part_id", "left")
    rows = rows.join(listed(face_adjacency(t.coedges), "adjacency", F.array("face_a", "face_b")), "part_id", "left")
    with co_located(rows.sparkSession):
        rows.drop("part_id").write.mode("overwrite").json(path, compression="gzip")


def read_graphs(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """faces, edges, coedges and adjacency, each with the stem of its file or of its line."""
    g = _with_stem(_payloads(spark, path, GRAPH_FILE, ".graph.json", lines), r"\.graph\.json$")
    one = lambda c: g.select("stem", F.explode(c).alias("x")).select("stem", "x.*")
    pairs = g.select("stem", F.explode("adjacency").alias("x")).select("stem", F.col("x")[0].alias("face_a"), F.col("x")[1].alias("face_b"))
    return {"faces": one("faces"), "edges": one("edges"), "coedges": one("coedges"), "adjacency": pairs}


def read_labels(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Face labels (stem, face_index, refinement, complexity_proxy, rule_score) and graph labels (stem, graph_label)."""
    rows = _with_stem(_payloads(spark, path, LABEL_FILE, ".labels.json", lines), r"\.labels\.json$")
    keys = F.array_distinct(F.flatten(F.array(*[F.coalesce(F.map_keys(c), F.array().cast("array<string>")) for c in ("refinement", "complexity_proxy", "rule_per_face")])))
    each = rows.withColumn("k", F.explode(keys))
    at = lambda c, missing: F.coalesce(F.try_element_at(F.col(c), F.col("k")), F.lit(missing))
    faces = each.select("stem", F.col("k").cast("int").alias("face_index"), at("refinement", False).alias("refinement"), at("complexity_proxy", 0.0).alias("complexity_proxy"), at("rule_per_face", 0.0).alias("rule_score"))
    return faces, rows.select("stem", F.coalesce("graph_label", F.lit(0)).alias("graph_label"))


def read_tags(spark: SparkSession, path: str, stems: DataFrame, lines: bool = False) -> DataFrame:
    """(stem, defect_tags) of the given stems; absent or malformed sidecars mean no tags."""
    tags = _with_stem(_payloads(spark, path, TAG_FILE, ".json", lines).filter("defect_tags is not null"), r"\.tags\.json$|\.json$").select("stem", "defect_tags")
    return stems.select("stem").join(tags, "stem", "left").select("stem", F.coalesce("defect_tags", F.array().cast("array<string>")).alias("defect_tags"))


def read_traces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Rows of JSON lines, the lines that are no JSON objects (file, line), and how many of each there are.

    The files are read once, into a table of the shared folder that holds both; blank lines count as neither.
    """
    lines = spark.read.schema(f"{TRACES}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    bad, seen = F.col(CORRUPT).isNotNull(), Observation()
    lines = lines.withColumn("file", F.input_file_name()).observe(seen, F.count_if(~bad).alias("rows"), F.count_if(bad).alias("rejected"))
    both = stored(lines, "traces")
    return both.filter(~bad).drop(CORRUPT, "file"), both.filter(bad).select("file", F.col(CORRUPT).alias("line")), seen.get


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLD).json(path)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROMPTS).json(path)


def write_split(df: DataFrame, out: str) -> None:
    """JSON lines, one folder a split."""
    df.write.mode("overwrite").partitionBy("split").json(out)


def write_reports(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("overwrite").partitionBy("status").option("compression", "gzip").format(fmt).save(path)


def _whole_keys(column) -> Column:
    return F.transform_keys(column, lambda k, _: k.cast("int"))


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reports back from JSON; maps by face have whole-number keys again, in the report, its ``ml`` and each of its ``bodies``.

    ``schema`` states those maps with string keys, as JSON has them.
    """
    rows = spark.read.schema(schema).json(path)
    maps = ("per_face_scores", "combined_per_face_scores")
    for c in maps:
        if c in rows.columns:
            rows = rows.withColumn(c, _whole_keys(F.col(c)))
    if "ml" in rows.columns and "per_face_scores" in rows.schema["ml"].dataType.names:
        rows = rows.withColumn("ml", F.when(F.col("ml").isNotNull(), F.col("ml").withField("per_face_scores", _whole_keys(F.col("ml.per_face_scores")))))
    if "bodies" in rows.columns and hasattr(rows.schema["bodies"].dataType.elementType, "names"):
        kept = [c for c in maps if c in rows.schema["bodies"].dataType.elementType.names]

        def restored(body: Column) -> Column:
            for c in kept:
                body = body.withField(c, _whole_keys(body[c]))
            return body

        rows = rows.withColumn("bodies", F.transform("bodies", restored))
    return rows


def save_index(chunks: DataFrame, meta: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    meta.withColumn("created_at", F.current_timestamp().cast("string")).write.mode("overwrite").parquet(f"{path}/meta")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Chunks and facts; an error if their numbers differ."""
    chunks, meta = spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/meta")
    if chunks.count() != meta.first()["n_chunks"]:
        raise ValueError(f"{path}: the index does not hold as many chunks as it says")
    return chunks, meta


def import_index(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from one JSON document of parallel arrays (entries, embeddings); an error if lengths differ."""
    rows = spark.read.schema("entries array<struct<source:string,page:int,chunk_id:int,text:string>>, embeddings array<array<double>>").option("multiLine", True).json(path)
    checked = F.when(F.size("entries") == F.size("embeddings"), F.arrays_zip("entries", "embeddings")).otherwise(F.raise_error(F.lit("entries and embeddings differ in length")))
    return rows.select(F.explode(checked).alias("x")).select("x.entries.*", F.col("x.embeddings").alias("embedding"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows (source_stem, stem, defect_tags, status, reason) of a manifest of JSON lines."""
    return spark.read.schema(MANIFEST).json(path)


def write_manifest(df: DataFrame, path: str) -> None:
    df.select(*T.StructType.fromDDL(MANIFEST).names).write.mode("overwrite").json(path)


def write_labels(df: DataFrame, path: str) -> None:
    """Labelled parts of ``label_parts``, manifest and labels in one table that appears as one."""
    df.write.mode("overwrite").partitionBy("status").json(path)


def read_label_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest columns of what ``write_labels`` wrote, failures included."""
    kinds = dict.fromkeys(LABEL_MANIFEST, "string") | {"face_count": "long", "positive_refinement": "long", "graph_label": "int"}
    return spark.read.schema(", ".join(f"{n} {k}" for n, k in kinds.items())).json(path).select(*LABEL_MANIFEST)


def read_part_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Face labels and graph labels, as ``read_labels`` has them, of the parts that were labelled."""
    kinds = "status string, stem string, graph_label int, refinement map<string,boolean>, complexity_proxy map<string,double>, rule_per_face map<string,double>"
    rows = spark.read.schema(kinds).json(path).filter("status = 'ok'")
    entries = F.explode(F.map_keys("refinement")).alias("k")
    at = lambda c: F.try_element_at(F.col(c), F.col("k"))
    faces = rows.select("*", entries).select("stem", F.col("k").cast("int").alias("face_index"), at("refinement").alias("refinement"), at("complexity_proxy").alias("complexity_proxy"), at("rule_per_face").alias("rule_score"))
    return faces, rows.select("stem", "graph_label")


def read_source_list(spark: SparkSession, path: str) -> DataFrame:
    """(url, file_name) of a list with # comments and blank lines."""
    return source_list(spark.read.text(path), "value")


def source_list(df: DataFrame, column: str) -> DataFrame:
    url = F.trim(F.regexp_replace(column, "#.*$", ""))
    return df.select(url.alias("url")).filter("url <> ''").withColumn("file_name", url_file_name("url"))
