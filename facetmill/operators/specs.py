"""Validation of part specifications (JSON lists of box, cyl, fuse and cut steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Limits of a specification.
MOST_STEPS, MOST_SIZE, MOST_RADIUS, MOST_PLACE = 16, 1000.0, 500.0, 10000.0
FIELDS = {"box": {"op", "dx", "dy", "dz", "at"}, "cyl": {"op", "r", "h", "at"}, "fuse": {"op", "a", "b"}, "cut": {"op", "a", "b"}}
STEP = "struct<op:string,dx:double,dy:double,dz:double,r:double,h:double,a:int,b:int,at:array<double>>"


def validate_specs(specs: DataFrame) -> DataFrame:
    """(spec_id, valid, error) of (spec_id, spec_json); the error is the first one in order of steps."""
    parsed = F.from_json("spec_json", f"struct<steps:array<{STEP}>>")["steps"]
    raw = F.from_json("spec_json", "struct<steps:array<string>>")["steps"]
    extra = F.size(F.array_except(F.json_object_keys("spec_json"), F.array(F.lit("steps")))) > 0
    rows = specs.select("spec_id", parsed.alias("steps"), raw.alias("raw"), extra.alias("extra"))
    n = F.size("steps")

    def within(x, most):
        return x.isNotNull() & (x > 0) & (x <= most)

    def error(s, i):
        keys = F.json_object_keys(F.get("raw", i))
        allowed = F.lit(None).cast("array<string>")
        for op, names in FIELDS.items():
            allowed = F.when(s["op"] == op, F.array(*map(F.lit, sorted(names)))).otherwise(allowed)
        place = s["at"].isNotNull() & ((F.size(s["at"]) != 3) | F.exists(s["at"], lambda v: v.isNull() | (F.abs(v) > MOST_PLACE)))
        refs = s["op"].isin("fuse", "cut")
        bad = (
            F.when(allowed.isNull(), "unknown op")
            .when(F.size(F.array_except(keys, allowed)) > 0, "unknown field")
            .when((s["op"] == "box") & ~(within(s["dx"], MOST_SIZE) & within(s["dy"], MOST_SIZE) & within(s["dz"], MOST_SIZE)), "size out of range")
            .when((s["op"] == "cyl") & ~(within(s["r"], MOST_RADIUS) & within(s["h"], MOST_SIZE)), "size out of range")
            .when(place, "placement out of range")
            .when(refs & (s["a"].isNull() | s["b"].isNull() | (s["a"] < 0) | (s["b"] < 0) | (s["a"] >= i) | (s["b"] >= i)), "reference to a later step")
            .when(refs & (s["a"] == s["b"]), "reference to the same step twice")
        )
        return F.when(bad.isNotNull(), F.concat(F.lit("step "), i.cast("string"), F.lit(": "), bad))

    first = F.try_element_at(F.filter(F.transform("steps", error), lambda e: e.isNotNull()), F.lit(1))
    used = F.flatten(F.transform("steps", lambda s: F.array(s["a"], s["b"])))
    orphans = F.array_except(F.sequence(F.lit(0), n - 1), F.concat(used, F.array(n - 1)))
    message = F.when(F.col("extra"), "unknown field").when(F.col("steps").isNull() | (n < 1), "no steps").when(n > MOST_STEPS, "too many steps").otherwise(F.coalesce(first, F.when(F.size(orphans) > 0, F.concat(F.lit("step "), orphans[0].cast("string"), F.lit(": never used")))))
    return rows.select("spec_id", message.isNull().alias("valid"), message.alias("error"))
