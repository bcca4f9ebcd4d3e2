"""Row types of the B-rep tables and of what is computed from them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

BOX = ["xmin", "ymin", "zmin", "xmax", "ymax", "zmax"]
_BOX = ", ".join(f"{c} double" for c in BOX)

PARTS = f"part_id long, stem string, is_valid boolean, load_check string, {_BOX}"
SOLIDS = f"part_id long, solid_id int, {_BOX}"
FACES = f"part_id long, solid_id int, face_index int, surface_type string, area double, normal array<double>, mean_curvature double, uv_bounds array<double>, radius double, {_BOX}"
EDGES = "part_id long, edge_index int, length double, is_degenerated boolean"
COEDGES = "part_id long, coedge_index int, face_index int, edge_index int, orientation int, loop_position int"
FINDINGS = "part_id long, finding_seq int, check string, severity string, measure double, threshold double, detail string, suggestion string"
FACE_SCORES = "part_id long, face_index int, score double"
TOOL_CALLS = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
MESSAGES = f"array<struct<role:string,content:string,tool_call_id:string,tool_calls:{TOOL_CALLS}>>"
TRACES = f"id string, step_path string, question string, category string, messages {MESSAGES}, final_text string, model string, usage map<string,long>, iterations int, stop_reason string, generated_at string"
MANIFEST = "source_stem string, stem string, defect_tags array<string>, status string, reason string"
GOLD = "id string, step_path string, question string, category string, expected_tool_calls array<string>, expected_answer_themes array<string>"
PROMPTS = "id string, prompt string, expect struct<faces:array<int>>"
GRAPH_FILE = (
    "stem string, faces array<struct<face_index:int,surface_type:string,one_hot:array<int>,area:double,centroid:array<double>,normal:array<double>,mean_curvature:double,uv_bounds:array<double>>>, "
    "edges array<struct<edge_index:int,length:double,midpoint_curvature:double,connected_faces:array<int>,convexity:string,dihedral_angle:double,dihedral_signal:double>>, "
    "coedges array<struct<coedge_index:int,face_index:int,edge_index:int,orientation:int,loop_position:int>>, adjacency array<array<int>>"
)
LABEL_FILE = "stem string, refinement map<string,boolean>, complexity_proxy map<string,double>, rule_per_face map<string,double>, graph_label int, graph_label_name string, name string"
TAG_FILE = "stem string, source_step string, defect_tags array<string>, synthesis string"

# Defect classes in label order.
DEFECT_CLASSES = ["clean", "open_shell", "sliver_face", "self_intersection"]
# Surface types in one-hot order.
SURFACE_TYPES = ["plane", "cylinder", "cone", "sphere", "torus", "bspline", "other"]
# Severity ranks.
SEVERITY_RANK = {"Critical": 0, "Major": 1, "Minor": 2, "Info": 3}


@dataclass(frozen=True)
class Tables:
    """The tables of a catalog, all keyed by ``part_id``; ``buckets``: of the parts, if the catalog is clustered."""

    parts: DataFrame
    solids: DataFrame
    faces: DataFrame
    edges: DataFrame
    coedges: DataFrame
    buckets: int | None = None

    def with_(self, **changed: DataFrame) -> Tables:
        return replace(self, **changed)
