"""Items of a part whose boxes overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BOX, Tables
from .measures import MANY_FACES, split_valid
from .topology import PART, edge_faces


def overlapping_boxes(rows: DataFrame, item: str, keys=PART, finest: int = 16) -> DataFrame:
    """(keys, a, b): pairs of items of one key whose boxes overlap in all three directions, a < b.

    Boxes meet through a hierarchy of grids over the box around the key's items: level l cuts each direction
    into 2 ** l cells, and an item lies on the finest level whose cells are no smaller than it, so in two
    cells a direction at most. It meets the items of its own level there and, through the cells that it
    touches on coarser levels, the larger ones; a pair counts in the first cell that both touch. So items
    of very different sizes cost what they overlap, not the square of their number. Items without a box
    overlap nothing.
    """
    keys, axes = list(keys), "xyz"
    boxed = rows.select(*keys, F.col(item).alias("item"), *BOX).dropna(subset=BOX)
    around = boxed.groupBy(*keys).agg(*[F.min(f"{a}min").alias(f"lo_{a}") for a in axes], *[F.max(f"{a}max").alias(f"hi_{a}") for a in axes])

    def share(value: Column, a: str) -> Column:
        return F.coalesce(F.try_divide(value, F.col(f"hi_{a}") - F.col(f"lo_{a}")), F.lit(0.0))

    size = F.greatest(*[share(F.col(f"{a}max") - F.col(f"{a}min"), a) for a in axes])
    level = F.when(size > 0, F.least(F.lit(finest), F.greatest(F.lit(0), F.floor(-F.log2(size))))).otherwise(finest).cast("int")
    placed = boxed.join(around, keys).withColumn("level", level)
    levels = placed.groupBy(*keys).agg(F.collect_set("level").alias("levels"))  # finest + 1 at most

    def in_cells(df: DataFrame, side: str) -> DataFrame:
        """A row a cell of level ``l``; ``f`` is the first cell of each direction."""
        most = F.pow(F.lit(2.0), F.col("l")).cast("int") - 1

        def cell(value: str, a: str) -> Column:
            at = F.floor(share(F.col(value) - F.col(f"lo_{a}"), a) * (most + 1)).cast("int")
            return F.least(most, F.greatest(F.lit(0), at))

        for a in axes:
            df = df.withColumn(f"f{a}", cell(f"{a}min", a)).withColumn(f"c{a}", F.explode(F.sequence(F.col(f"f{a}"), cell(f"{a}max", a))))
        own = ["item", "level", *BOX, *[f"f{a}" for a in axes]]
        return df.select(*keys, "l", *[f"c{a}" for a in axes], *[F.col(x).alias(f"{side}_{x}") for x in own])

    held = in_cells(placed.withColumn("l", F.col("level")), "l")
    asking = in_cells(placed.join(levels, keys).withColumn("l", F.explode(F.filter("levels", lambda x: x <= F.col("level")))), "r")
    pairs = held.join(asking, [*keys, "l", "cx", "cy", "cz"]).filter((F.col("r_level") > F.col("l_level")) | (F.col("l_item") < F.col("r_item")))
    for a in axes:
        meet = (F.col(f"l_{a}min") < F.col(f"r_{a}max")) & (F.col(f"r_{a}min") < F.col(f"l_{a}max"))
        pairs = pairs.filter(meet & (F.col(f"c{a}") == F.greatest(f"l_f{a}", f"r_f{a}")))
    return pairs.select(*keys, F.least("l_item", "r_item").alias("a"), F.greatest("l_item", "r_item").alias("b"))


def interference(t: Tables, item: str = "solid_id") -> DataFrame:
    """(part_id, a, b): overlapping solids, or overlapping faces that share no edge (item face_index), of
    valid parts that a test for self-intersection would take: no freeform faces and not too many faces."""
    faces = t.faces.groupBy("part_id").agg(F.count_if(F.col("surface_type").isin("bspline", "bezier")).alias("free"), F.count("*").alias("n"))
    unfit = faces.filter((F.col("free") > 0) | (F.col("n") > MANY_FACES)).select("part_id")
    fit = split_valid(t.parts)[0].select("part_id").join(unfit, "part_id", "left_anti")
    rows = t.solids if item == "solid_id" else t.faces
    pairs = overlapping_boxes(rows.join(fit, "part_id", "left_semi"), item)
    if item == "solid_id":
        return pairs
    near = edge_faces(t.coedges.join(fit, "part_id", "left_semi")).filter(F.size("faces") >= 2)  # MANY_FACES at most
    both = near.select("part_id", F.explode("faces").alias("a"), "faces").select("part_id", "a", F.explode("faces").alias("b")).filter("a < b").distinct()
    return pairs.join(both, ["part_id", "a", "b"], "left_anti")
