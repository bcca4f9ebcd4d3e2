"""Which parts can be judged: how they loaded, and whether they were valid before and after healing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .topology import PART

# What the notes of healing say.
IMPROVED, UNCHANGED = "Validity improved after healing.", "Healing completed without a change of validity."
UNHEALED = "The part did not load, so it was not healed."


def _given(df: DataFrame, name: str, kind: str, missing: Column | None = None) -> Column:
    """A column that a table may lack."""
    return F.col(name) if name in df.columns else (F.lit(None) if missing is None else missing).cast(kind)


def states(parts: DataFrame) -> dict[str, Column]:
    """load (what failed there, null if nothing), before, after: validity before and after healing.

    A table with ``is_valid`` alone says the same of both; parts whose validity is unknown are not valid.
    """
    once = _given(parts, "is_valid", "boolean")
    before = F.coalesce(_given(parts, "valid_before", "boolean", once), F.lit(False))
    after = F.coalesce(_given(parts, "valid_after", "boolean", once), F.lit(False))
    return {"load": _given(parts, "load_check", "string"), "before": before, "after": after}


def split_valid(parts: DataFrame, keys=PART) -> tuple[DataFrame, DataFrame]:
    """Parts that can be judged, and (keys, stem, check, detail) of the others.

    ``load_check``, where the table has it, names what failed (FileNotFound, LoadError, NullShape,
    BRepCheckFailure, AnalysisTimeout, AnalysisError). A part that was not valid is judged if healing made
    it so; one that was valid is judged whatever healing made of it. The rest failed the B-rep check.
    """
    s = states(parts)
    check = F.coalesce(s["load"], F.when(~(s["before"] | s["after"]), "BRepCheckFailure"))
    detail = F.coalesce(_given(parts, "load_detail", "string"), check)
    return parts.filter(check.isNull()), parts.filter(check.isNotNull()).select(*keys, "stem", check.alias("check"), detail.alias("detail"))


def _error(check: Column, detail: Column | None = None) -> Column:
    return F.struct(check.alias("check"), F.lit("Critical").alias("severity"), (check if detail is None else detail).alias("detail"))


def with_validity(parts: DataFrame) -> DataFrame:
    """Add ``validation`` (is_valid, errors, initial_errors, healed_after_validation_failure) and ``heal``
    (attempted, applied, valid_before, valid_after, notes) as a report has them.

    ``is_valid`` and ``errors`` are of the part as it was judged, so after healing; ``initial_errors`` and the
    flag are there only where it was not valid at first and healing led to a judgement.
    """
    s = states(parts)
    failed = F.lit("BRepCheckFailure")
    loaded = s["load"].isNull()
    none = F.array().cast("array<struct<check:string,severity:string,detail:string>>")
    detail = F.coalesce(_given(parts, "load_detail", "string"), s["load"])
    errors = F.when(~loaded, F.array(_error(s["load"], detail))).when(~s["after"], F.array(_error(failed))).otherwise(none)
    mended = loaded & ~s["before"] & s["after"]
    validation = F.struct(
        (loaded & s["after"]).alias("is_valid"), errors.alias("errors"), F.when(mended, F.array(_error(failed))).alias("initial_errors"),
        F.when(mended, True).alias("healed_after_validation_failure"),
    )
    notes = F.when(~loaded, UNHEALED).when(mended, IMPROVED).otherwise(UNCHANGED)
    heal = F.struct(
        loaded.alias("attempted"), loaded.alias("applied"), F.when(loaded, s["before"]).alias("valid_before"), F.when(loaded, s["after"]).alias("valid_after"),
        F.array(notes).alias("notes"),
    )
    return parts.withColumns({"validation": validation, "heal": heal})
