"""What the checks look at: faces with what their edges say, and the facts of parts.

Tables that are clustered by part (``common.clustered``) are joined and grouped without a shuffle, a
bucket a task. Parts of more than ``GIANT_FACES`` faces go another way: their rows are shuffled by face
and by edge, so that they spread over tasks, and their facts are partial sums of every task first.

Facts of a part are sums over its faces that are joined back; no window runs over a part, only over the
uses of an edge. A value that cannot be computed (a normal of two numbers, an area that is null) makes
the checks that need it skip the part, with a row that says so; all other checks go on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import clustered, co_located, small, stored
from ..functions.scalars import angle_deg, clamp01, guarded, with_bbox_dims
from ..schemas import BOX, Tables
from .scores import fused, heuristic_score, proxy_score
from .topology import PART
from .validity import split_valid

# Thresholds, as shares of the part's largest dimension unless named otherwise.
SHORT_EDGE, THIN_WALL, SMALL_AREA, SMALL_EDGE, SMALL_RADIUS = 0.005, 0.03, 0.02, 0.2, 0.03
ZERO_LENGTH, THIN_SOLID_RATIO, SHARP_DEGREES, MANY_SHORT, MANY_FACES = 1e-7, 100.0, 15.0, 8, 150

#: Parts of more faces are spread over tasks; smaller ones may be read whole by one.
GIANT_FACES = 200_000
#: Facts of a part that add up over the uses of its edges, and over its faces.
EDGE_COUNTS = (
    "edge_count", "unique_edges", "zero_edges", "crowded_edges", "open_edges", "degenerate_edges", "same_way_edges",
    "short_edges", "small_edges", "sharp_edges", "bad_lengths", "bad_angles",
)
FACE_COUNTS = ("face_count", "small_faces", "small_cylinders", "freeform_faces", "duplicate_faces", "bad_areas", "bad_radii", "bad_boxes")
SOLID_COUNTS = ("solid_count", "duplicate_solids", "thin_solids", "bad_solids")
RESULT = "struct<fires:boolean,severity:string,measure:double,threshold:double,detail:string>"
_B = [f"b{i}" for i in range(6)]
_TABLES = ("parts", "solids", "faces", "edges", "coedges")

c = F.col


def scale(share: float, power: int = 1) -> Column:
    return F.lit(share) * (c("max_dim") if power == 1 else c("max_dim") * c("max_dim"))


def _missing(value: Column) -> Column:
    return value.isNull() | F.isnan(value)


def _malformed(vector: Column) -> Column:
    """Not three numbers."""
    broken = F.coalesce(F.size(vector), F.lit(0)) != 3
    for i in range(3):
        broken = broken | _missing(F.get(vector, i))
    return broken


def _no_box() -> Column:
    out = F.lit(False)
    for x in BOX:
        out = out | _missing(c(x))
    return out


def _rounded_box() -> list[Column]:
    return [F.bround(x, 5).alias(f"b{i}") for i, x in enumerate(BOX)]


def _thin_ratio() -> Column:
    return F.when((c("max_dim") > 0) & (c("min_dim") > 0), F.try_divide("min_dim", "max_dim"))


# --- faces ----------------------------------------------------------------------------------------------------------


def scaled_faces(t: Tables, keys=PART) -> DataFrame:
    """Faces of valid parts with the part's scale."""
    dims = with_bbox_dims(split_valid(t.parts, keys)[0]).select(*keys, "max_dim", "min_dim")
    own = ["face_index", "surface_type", "area", "normal", "radius"]
    return t.faces.select(*keys, *own, _no_box().alias("bad_box"), *_rounded_box()).join(dims, list(keys))


def measured_uses(t: Tables, faces: DataFrame, keys=PART) -> DataFrame:
    """A row a use: its edge's length and uses, the edge's first two faces, the angle of an edge of two faces.

    Windows run over the uses of one edge, in order where order matters, and keep nothing of them.
    """
    own = faces.select(*keys, "face_index", "normal", "max_dim")
    uses = t.coedges.select(*keys, "coedge_index", "face_index", "edge_index", "orientation").join(own, [*keys, "face_index"])
    edge = Window.partitionBy(*keys, "edge_index")
    inside = edge.orderBy("coedge_index")
    first = F.first(F.struct("face_index", "normal")).over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    uses = uses.withColumns({"nth": F.row_number().over(inside), "a": first})
    other = F.when(c("face_index") != c("a.face_index"), F.struct("coedge_index", "face_index", "normal"))
    uses = uses.withColumns({
        "uses": F.count("*").over(edge), "turn": F.sum("orientation").over(edge), "b": F.min(other).over(edge),
        "lo": F.min(other["face_index"]).over(edge), "hi": F.max(other["face_index"]).over(edge),
    })
    uses = uses.withColumns({"two": c("lo") == c("hi"), "fa": c("a.face_index"), "fb": c("b.face_index")})
    uses = uses.join(t.edges.select(*keys, "edge_index", "length", "is_degenerated"), [*keys, "edge_index"], "left")
    bad = c("two") & (_malformed(c("a.normal")) | _malformed(c("b.normal")))
    return uses.withColumns({"angle": F.when(c("two"), angle_deg("a.normal", "b.normal")), "bad_angle": F.coalesce(bad, F.lit(False))})


def measured_faces(t: Tables, keys, checks) -> DataFrame:
    """A row a face: what it is, what its edges count up to (``u_``) and how its edges are scored (``e_`` a check)."""
    faces = scaled_faces(t, keys)
    uses = measured_uses(t, faces, keys)
    first, long_enough = c("nth") == 1, c("length") > ZERO_LENGTH
    other = F.when(c("face_index") == c("fa"), c("fb")).when(c("face_index") == c("fb"), c("fa"))
    counts = (
        F.lit(True), first, F.abs("length") <= ZERO_LENGTH, first & (c("uses") > 2), first & (c("uses") == 1), first & c("is_degenerated"),
        first & (c("uses") == 2) & (F.abs("turn") == 2), long_enough & (c("length") < scale(SHORT_EDGE)), long_enough & (c("length") < scale(SMALL_EDGE)),
        first & (c("angle") < SHARP_DEGREES), first & _missing(c("length")), first & c("bad_angle"),
    )
    scored = {k: ck for k, ck in checks if ck.edge_score is not None}
    values = {f"v_{k}": guarded(ck.edge_score.cast("double"), "double") if ck.guarded else ck.edge_score.cast("double") for k, ck in scored.items()}
    uses = uses.withColumns(values) if values else uses
    score = {k: c(f"v_{k}.v") if ck.guarded else c(f"v_{k}") for k, ck in scored.items()}
    by_face = uses.groupBy(*keys, "face_index").agg(
        F.size(F.collect_set(other)).alias("degree"), *[F.count_if(v).alias(f"u_{n}") for n, v in zip(EDGE_COUNTS, counts)],
        *[F.max(score[k]).alias(f"e_{k}") for k in scored], *[F.count_if(c(f"v_{k}").isNull()).alias(f"x_{k}") for k, ck in scored.items() if ck.guarded],
    )
    alike = faces.filter("not bad_box").groupBy(*keys, *_B).agg(F.count("*").alias("alike"), F.min("face_index").alias("original")).filter("alike > 1")
    rows = faces.join(by_face, [*keys, "face_index"], "left").join(alike, [*keys, *_B], "left")
    degree = F.coalesce("degree", F.lit(0))
    cylinder = c("surface_type") == "cylinder"
    own = {
        "small_faces": (c("area") > 0) & (c("area") < scale(SMALL_AREA, 2)), "small_cylinders": cylinder & (c("radius") <= scale(SMALL_RADIUS)),
        "freeform_faces": c("surface_type").isin("bspline", "bezier"), "duplicate_faces": c("face_index") != c("original"),
        "bad_areas": _missing(c("area")), "bad_radii": cylinder & _missing(c("radius")), "bad_boxes": c("bad_box"),
    }
    return rows.select(
        *keys, "face_index", "surface_type", "area", "radius", degree.alias("degree"), F.coalesce("alike", F.lit(1)).alias("alike"),
        heuristic_score(degree).alias("ml_score"), *[c(f"u_{n}") for n in EDGE_COUNTS], *[v.alias(f"is_{n}") for n, v in own.items()],
        *[c(f"{p}_{k}") for k, ck in scored.items() for p in ("ex" if ck.guarded else "e")],
    )


# --- parts ----------------------------------------------------------------------------------------------------------


def _solid_facts(t: Tables, keys) -> DataFrame:
    dims = [c(f"{a}max") - c(f"{a}min") for a in "xyz"]
    least = F.least(*dims)
    aspect = F.when(~_no_box() & (least > 0), F.try_divide(F.greatest(*dims), least))
    solids = t.solids.select(*keys, *_rounded_box(), _no_box().alias("bad"), aspect.alias("aspect"))
    solids = solids.groupBy(*keys, *_B).agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.count_if(c("aspect") >= THIN_SOLID_RATIO).alias("thin"), F.max("aspect").alias("aspect"))
    again = F.sum(F.when(c("bad") == 0, c("n") - 1).otherwise(0))
    return solids.groupBy(*keys).agg(
        F.sum("n").alias("solid_count"), again.alias("duplicate_solids"), F.sum("thin").alias("thin_solids"), F.sum("bad").alias("bad_solids"), F.max("aspect").alias("worst_aspect")
    )


def _loose_edges(t: Tables, keys) -> DataFrame:
    """Edges that no face uses count as used once, but for openness."""
    dims = with_bbox_dims(split_valid(t.parts, keys)[0]).select(*keys, "max_dim")
    used = t.coedges.select(*keys, "edge_index")
    rows = t.edges.select(*keys, "edge_index", "length", "is_degenerated").join(used, [*keys, "edge_index"], "left_anti").join(dims, list(keys))
    long_enough = c("length") > ZERO_LENGTH
    counts = {
        "edge_count": F.lit(True), "unique_edges": F.lit(True), "zero_edges": F.abs("length") <= ZERO_LENGTH, "degenerate_edges": c("is_degenerated"),
        "short_edges": long_enough & (c("length") < scale(SHORT_EDGE)), "small_edges": long_enough & (c("length") < scale(SMALL_EDGE)), "bad_lengths": _missing(c("length")),
    }
    return rows.groupBy(*keys).agg(*[F.count_if(v).alias(f"loose_{n}") for n, v in counts.items()])


def part_rows(t: Tables, faces: DataFrame, keys, checks) -> DataFrame:
    """A row a valid part: its facts, and for each check whose values may fail how many did (``skip_``)."""
    faults = [k for k, ck in checks if ck.guarded and ck.edge_score is not None]
    per = faces.groupBy(*keys).agg(
        F.count("*").alias("face_count"), *[F.sum(F.coalesce(f"u_{n}", F.lit(0))).alias(n) for n in EDGE_COUNTS], *[F.count_if(f"is_{n}").alias(n) for n in FACE_COUNTS[1:]],
        F.max("area").alias("most_area"), *[F.sum(F.coalesce(f"x_{k}", F.lit(0))).alias(f"x_{k}") for k in faults],
    )
    loose = _loose_edges(t, keys)
    parts = with_bbox_dims(split_valid(t.parts, keys)[0])
    for one in (per, loose, _solid_facts(t, keys)):
        parts = parts.join(one, list(keys), "left")
    extra = [n for n in loose.columns if n.startswith("loose_")]
    parts = parts.na.fill(0, [*EDGE_COUNTS, *FACE_COUNTS, *SOLID_COUNTS, *extra, *[f"x_{k}" for k in faults]])
    parts = parts.withColumns({n.removeprefix("loose_"): c(n.removeprefix("loose_")) + c(n) for n in extra}).drop(*extra)
    parts = parts.withColumns({"thin_ratio": _thin_ratio(), "short_threshold": scale(SHORT_EDGE)})
    said = {f"p_{k}": guarded(ck.result(), RESULT) for k, ck in checks if ck.guarded}
    parts = parts.withColumns(said) if said else parts
    skips = {}
    for k, ck in checks:
        n = ck.broken.cast("long") if ck.broken is not None else F.lit(0).cast("long")
        if ck.guarded:
            n = n + c(f"p_{k}").isNull().cast("long") + (c(f"x_{k}") if k in faults else F.lit(0))
        if ck.guarded or ck.broken is not None:
            skips[f"skip_{k}"] = n
    return parts.withColumns(skips).drop(*[f"x_{k}" for k in faults])


@dataclass(frozen=True)
class _Side:
    """Parts that go one way: in buckets of parts, or spread."""

    tables: Tables
    keys: tuple[str, ...]
    checks: tuple
    spread: bool

    @cached_property
    def rows(self) -> DataFrame:
        with co_located(self.tables.parts.sparkSession):
            rows = measured_faces(self.tables, self.keys, self.checks)
            return stored(rows, "measured-faces") if self.spread else clustered(rows, "measured-faces", self.keys, self.tables.buckets)

    @cached_property
    def facts(self) -> DataFrame:
        rows = self.rows
        with co_located(rows.sparkSession):
            facts = part_rows(self.tables, rows, self.keys, self.checks)
            return stored(facts, "measured-parts") if self.spread else clustered(facts, "measured-parts", self.keys, self.tables.buckets)

    @cached_property
    def faces(self) -> DataFrame:
        """Faces with the facts of their part and their scores."""
        keys, facts = list(self.keys), self.facts
        drop = [x for x in facts.columns if x in self.rows.columns and x not in keys]
        facts = facts.drop(*drop, *BOX, "stem")
        rows = self.rows.join(small(facts) if self.spread else facts, keys)
        faced = [(k, ck) for k, ck in self.checks if ck.face_score is not None]
        careful = [k for k, ck in faced if ck.guarded]
        if careful:  # what fails on one face fails for its part
            rows = rows.withColumns({f"f_{k}": guarded(ck.face_score.cast("double"), "double") for k, ck in faced if ck.guarded})
            failed = rows.groupBy(*keys).agg(*[F.count_if(c(f"f_{k}").isNull()).alias(f"y_{k}") for k in careful])
            rows = rows.join(failed, keys)
        given = []
        for k, ck in self.checks:
            own = [c(f"e_{k}")] if ck.edge_score is not None else []
            if ck.face_score is not None:
                own.append(c(f"f_{k}.v") if ck.guarded else ck.face_score.cast("double"))
            ok = c(f"skip_{k}") == 0 if ck.guarded or ck.broken is not None else None
            if k in careful:
                ok = ok & (c(f"y_{k}") == 0)
            given += [v if ok is None else F.when(ok, v) for v in own]
        rule = F.array_max(F.array(*given)) if given else F.lit(None).cast("double")
        return rows.withColumns({"rule_score": rule, "proxy": proxy_score(c("degree"), c("most_area"))})

    @property
    def failed_faces(self) -> dict[str, Column]:
        """Aggregates over the faces of a part: how many faces each guarded check failed on."""
        return {f"y_{k}": F.max(f"y_{k}") for k, ck in self.checks if ck.guarded and ck.face_score is not None}

    @cached_property
    def judged(self) -> DataFrame:
        """Facts and findings."""
        facts, late = self.facts, self.failed_faces
        if late:
            found = self.faces.groupBy(*self.keys).agg(*[v.alias(n) for n, v in late.items()])
            facts = facts.join(found, list(self.keys), "left").na.fill(0, list(late))
        return facts.withColumn("findings", _findings(self.checks, set(late)))

    @cached_property
    def parts(self) -> DataFrame:
        clamped = F.when(c("rule_score").isNotNull(), clamp01("rule_score"))
        means = self.faces.groupBy(*self.keys).agg(F.avg(clamped).alias("rule_face_mean"), F.count("rule_score").alias("rule_face_count"), *face_means(), F.sum("degree").alias("degrees"))
        return self.judged.join(means, list(self.keys), "left").na.fill(0, ["rule_face_count", "rule_face_mean", "degrees"])


class Measured:
    """``faces``: a row per face with the facts of its part, its rule score (null: none), its heuristic score
    and its complexity proxy. ``judged``: a row per valid part with its facts and its findings as an array;
    ``parts``: with the means of its scores too. Rows of faces and facts of parts are stored once."""

    def __init__(self, t: Tables, keys: Sequence[str], checks, giant: int = GIANT_FACES):
        self.tables, self.keys, self.checks, self.giant = t, tuple(keys), tuple(checks), giant

    @cached_property
    def sides(self) -> list[_Side]:
        t, keys = self.tables, list(self.keys)
        big = t.faces.groupBy(*keys).agg(F.count("*").alias("n")).filter(c("n") > self.giant).select(*keys).drop_duplicates().persist()
        n = big.count()
        if not n:
            big.unpersist()
            return [_Side(t, self.keys, self.checks, False)]
        ids = small(stored(big, "giant-parts"), n)
        big.unpersist()
        spread_by = {"faces": ["face_index"], "edges": ["edge_index"], "coedges": ["edge_index"]}
        rest = {x: getattr(t, x).join(ids, keys, "left_anti") for x in _TABLES}
        giants = {x: getattr(t, x).join(ids, keys, "left_semi") for x in _TABLES}
        giants = {x: df.repartition(*keys, *spread_by[x]) if x in spread_by else df for x, df in giants.items()}
        giants["parts"] = small(giants["parts"], n)  # so that faces meet their part where they are
        return [_Side(Tables(**rest, buckets=t.buckets), self.keys, self.checks, False), _Side(Tables(**giants), self.keys, self.checks, True)]

    def _all(self, name: str) -> DataFrame:
        first, *more = [getattr(s, name) for s in self.sides]
        for other in more:
            first = first.unionByName(other)
        return first

    @cached_property
    def faces(self) -> DataFrame:
        return self._all("faces")

    @cached_property
    def judged(self) -> DataFrame:
        return self._all("judged")

    @cached_property
    def parts(self) -> DataFrame:
        return self._all("parts")


def _findings(checks, late: set[str]) -> Column:
    """An array of findings; a check that failed on the part is an Info row in its own place."""
    each = []
    for seq, (k, ck) in enumerate(checks):
        said = c(f"p_{k}") if ck.guarded else None
        r = {n: said["v"][n] if ck.guarded else getattr(ck, n) for n in ("fires", "severity", "measure", "threshold", "detail")}

        def row(name, severity, measure, threshold, detail, suggestion, seq=seq):
            values = {
                "finding_seq": F.lit(seq), "check": F.lit(name), "severity": severity, "measure": measure, "threshold": threshold, "detail": detail, "suggestion": F.lit(suggestion),
            }
            return F.struct(*[v.alias(n) for n, v in values.items()])

        found = F.when(r["fires"], row(ck.name, r["severity"], r["measure"].cast("double"), r["threshold"].cast("double"), r["detail"], ck.suggestion))
        if ck.guarded or ck.broken is not None:
            n = c(f"skip_{k}") + (c(f"y_{k}") if f"y_{k}" in late else F.lit(0))
            text = F.format_string(f"{ck.name} was skipped: %d of its values could not be computed", n)
            skipped = row("CheckSkipped", F.lit("Info"), n.cast("double"), F.lit(None).cast("double"), text, "Look at the part by hand.")
            found = F.when(n > 0, skipped).otherwise(found)
        each.append(found)
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def face_means() -> list[Column]:
    """Aggregates over a part's faces: means of the ML and of the combined scores."""
    return [F.avg("ml_score").alias("ml_mean"), F.avg(fused(c("rule_score"), c("ml_score"))).alias("combined_face_mean")]
