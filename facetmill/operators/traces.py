"""Preparation and evaluation of tool-call traces, and folding of run events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import token_estimate
from .datasets import smallest


def _call(c: Column) -> Column:
    """One tool call as a block of compact JSON; arguments that are no JSON stay a string."""
    args = F.try_parse_json(c["function"]["arguments"])
    text = F.coalesce(F.to_json(args), F.to_json(F.array(c["function"]["arguments"])).substr(F.lit(2), F.length(F.to_json(F.array(c["function"]["arguments"]))) - 2), F.lit("null"))
    name = F.to_json(F.array(c["function"]["name"]))
    return F.concat(F.lit('<tool_call>\n{"name":'), name.substr(F.lit(2), F.length(name) - 2), F.lit(',"arguments":'), text, F.lit("}\n</tool_call>"))


def convert_messages(messages) -> Column:
    """array<struct<role, content>>: calls and results as text blocks; other roles are dropped."""
    m = F.col(messages) if isinstance(messages, str) else messages
    kept = F.filter(m, lambda x: x["role"].isin("system", "user", "assistant", "tool"))

    def one(x):
        content = F.coalesce(x["content"], F.lit(""))
        calls = F.array_join(F.transform(F.coalesce(x["tool_calls"], F.array().cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>")), _call), "\n")
        body = F.when(x["role"] == "tool", F.concat(F.lit("<tool_response>\n"), content, F.lit("\n</tool_response>")))
        body = body.when((x["role"] == "assistant") & (calls != ""), F.when(content == "", calls).otherwise(F.concat(content, F.lit("\n"), calls))).otherwise(content)
        return F.struct(F.when(x["role"] == "tool", "user").otherwise(x["role"]).alias("role"), body.alias("content"))

    return F.transform(kept, one)


def to_chatml(messages) -> Column:
    m = F.col(messages) if isinstance(messages, str) else messages
    return F.array_join(F.transform(m, lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), F.trim(x["content"]), F.lit("<|im_end|>"))), "\n")


def build_question(question, path) -> Column:
    q, p = F.col(question), F.col(path)
    return F.when(p.isNotNull() & ~F.contains(q, p), F.concat(q, F.lit("\n\nFile: "), p)).otherwise(q)


def extract_tools(messages) -> Column:
    """Names of all calls of assistant messages, in order; empty names dropped."""
    calls = F.flatten(F.transform(F.filter(F.col(messages), lambda x: (x["role"] == "assistant") & x["tool_calls"].isNotNull()), lambda x: x["tool_calls"]))
    return F.filter(F.transform(calls, lambda c: c["function"]["name"]), lambda n: n.isNotNull() & (n != ""))


def with_drop_reason(df: DataFrame, max_tokens: int = 0) -> DataFrame:
    """Add token_estimate and drop_reason (null: kept): incomplete, empty, over_cap."""
    rows = df.withColumn("token_estimate", token_estimate("messages"))
    over = (F.col("token_estimate") > max_tokens) if max_tokens else F.lit(False)
    reason = F.when(~F.col("stop_reason").eqNullSafe("stop"), "incomplete").when(F.coalesce(F.size("messages"), F.lit(0)) <= 0, "empty").when(over, "over_cap")
    return rows.withColumn("drop_reason", reason)


def filter_traces(df: DataFrame, max_tokens: int = 0) -> DataFrame:
    return with_drop_reason(df, max_tokens).filter("drop_reason is null").drop("drop_reason")


def prep_report(df: DataFrame, max_tokens: int = 0) -> DataFrame:
    rows = with_drop_reason(df, max_tokens)
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col("drop_reason") == r).alias(r) for r in ("incomplete", "empty", "over_cap")], F.count_if(F.col("drop_reason").isNull()).alias("kept"))


def nearest_rank(df: DataFrame, column: str, percents=(25, 50, 75, 95), by: tuple[str, ...] = (), step: int = 4096) -> DataFrame:
    """(by, percent, value): of a whole-number column, the value at place int(n * p / 100) from 0, the last at most.

    Values are counted first, then gathered in ranges of ``step`` values: the running total passes
    over the ranges, and inside only those ranges that hold a wanted place. Ranges and totals are
    plain aggregates, so no task sees all rows, nor all distinct values.
    """
    by = list(by)
    part = F.floor(F.col("value") / step)
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("value")).agg(F.count("*").alias("n")).withColumn("part", part)
    ranges = counts.groupBy(*by, "part").agg(F.sum("n").alias("m"))
    ordered = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ranges = ranges.withColumns({"before": F.coalesce(F.sum("m").over(ordered), F.lit(0)), "total": F.sum("m").over(Window.partitionBy(*by))})
    place = F.least(F.floor(F.col("total") * F.col("percent") / 100), F.col("total") - 1)
    wanted = ranges.withColumn("percent", F.explode(F.array(*map(F.lit, percents)))).withColumn("place", place)
    wanted = wanted.filter((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("m")))
    inside = Window.partitionBy(*by, "percent", "part").orderBy("value")
    hit = counts.join(wanted.select(*by, "part", "percent", "place", "before"), [*by, "part"]).withColumn("upto", F.col("before") + F.sum("n").over(inside))
    return hit.filter(F.col("upto") > F.col("place")).groupBy(*by, "percent").agg(F.min("value").alias("value"))


def split_stats(df: DataFrame, split: str = "split", category: str = "category") -> DataFrame:
    """Per split and category: n, most tokens, how many are over 2048; and p25 to p95 of the tokens of the whole split."""
    ranks = nearest_rank(df, "token_estimate", by=(split,)).groupBy(split).agg(*[F.max(F.when(F.col("percent") == p, F.col("value"))).alias(f"p{p}") for p in (25, 50, 75, 95)])
    counts = df.groupBy(split, category).agg(F.count("*").alias("n"), F.max("token_estimate").alias("max_tokens"), F.count_if(F.col("token_estimate") > 2048).alias("over_2048"))
    return counts.join(F.broadcast(ranks), split, "left")  # a row a split


def score_traces(df: DataFrame) -> DataFrame:
    """Per row of (id, expected_tool_calls, expected_answer_themes, tool_calls, final_text, error): six scores."""
    want, got = F.col("expected_tool_calls"), F.coalesce("tool_calls", F.array().cast("array<string>"))
    text = F.lower(F.coalesce("final_text", F.lit("")))
    themes = F.coalesce("expected_answer_themes", F.array().cast("array<string>"))
    hits = F.size(F.filter(themes, lambda t: F.contains(text, F.lower(t))))
    made = F.filter(got, lambda g: F.array_contains(want, g))
    due = F.filter(want, lambda w: F.array_contains(got, w))
    return df.select(
        "*",
        (F.array_sort(F.array_distinct(want)) == F.array_sort(F.array_distinct(got))).alias("exact"),
        (F.size(F.array_except(want, got)) == 0).alias("partial"),
        (made == due).alias("order_ok"),  # expected calls that were made, in the expected order and as often
        F.contains(text, F.lit("verdict:")).alias("format_ok"),
        (F.contains(text, F.lit("issues:")) & F.contains(text, F.lit("fixes:"))).alias("sections_ok"),
        F.try_divide(hits.cast("double"), F.size(themes).cast("double")).alias("theme_rate"),  # null without themes
    )


def aggregate_eval(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, the rows without error, and means over them; n_error; theme_rate over those with themes."""
    ok = F.col("error").isNull()
    means = [F.avg(F.when(ok, F.col(c).cast("double"))).alias(c) for c in ("exact", "partial", "order_ok", "format_ok", "sections_ok", "theme_rate")]
    return scored.groupBy(*(by or [])).agg(F.count_if(ok).alias("n"), F.count_if(~ok).alias("n_error"), *means)


def sum_usage(events: DataFrame) -> DataFrame:
    """(run_id, tokens_in, tokens_out, model): sums, and the model seen first."""
    return events.groupBy("run_id").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.min_by("model", F.when(F.col("model").isNotNull(), F.col("seq"))).alias("model"))


def fold_events(events: DataFrame) -> DataFrame:
    """One row a run from (run_id, seq, type, name): iterations, calls in order, why it stopped."""
    calls = F.array_sort(F.collect_list(F.when(F.col("type") == "tool_call", F.struct("seq", "name"))))
    stop = F.when(F.bool_or(F.col("type") == "max_iterations"), "max_iterations").when(F.bool_or(F.col("type") == "final_text"), "stop")
    return events.groupBy("run_id").agg(F.count_if(F.col("type") == "iteration_start").alias("iterations"), F.transform(calls, lambda c: c["name"]).alias("tool_calls"), stop.alias("stop_reason"))


def build_seed_pool(files: DataFrame, templates: DataFrame, n: int, standards_share: float = 0.12, seed: int = 0) -> DataFrame:
    """n seeds (seed_id, path, template, category): every file with every template, repeated as needed,
    the rest standards questions (templates of category standards) without a file.

    Templates are a short list, held as one array; the last, incomplete turn takes the seeds of the
    smallest hashes.
    """
    n_standards = int(n * standards_share)
    kinds = F.struct("template", "category")
    lists = templates.groupBy().agg(F.collect_list(F.when(F.col("category") != "standards", kinds)).alias("plain"), F.collect_list(F.when(F.col("category") == "standards", kinds)).alias("standards")).first()
    each = lambda rows: F.explode(F.array(*[F.struct(F.lit(r["template"]).alias("template"), F.lit(r["category"]).alias("category")) for r in rows]))

    def turns(rows: DataFrame, key: list[str], wanted: int) -> DataFrame:
        size = rows.count()
        if not size or wanted <= 0:
            return rows.withColumn("turn", F.lit(0)).filter(F.lit(False))
        whole, rest = divmod(wanted, size)
        out = rows.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(whole - 1)))) if whole else None
        if rest:
            some = smallest(rows.withColumn("turn", F.lit(whole)), F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in key]), rest)
            out = some if out is None else out.unionByName(some)
        return out

    spark = files.sparkSession
    empty = spark.range(0).select(F.lit("").alias("path"), F.lit("").alias("template"), F.lit("").alias("category"))
    plain = files.select("path", each(lists["plain"]).alias("t")).select("path", "t.*") if lists["plain"] else empty
    std = spark.range(1).select(each(lists["standards"]).alias("t")).select(F.lit(None).cast("string").alias("path"), "t.*") if lists["standards"] else empty
    out = turns(plain, ["path", "template"], n - n_standards).unionByName(turns(std, ["path", "template"], n_standards))
    return out.withColumn("seed_id", F.md5(F.concat_ws("|", F.coalesce("path", F.lit("-")), "template", F.col("turn").cast("string"))))


def drop_missing(gold: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose file exists or that name none, and the others."""
    paths = files.select(F.col("path").alias("step_path"))
    named = gold.filter("step_path is not null")
    return gold.filter("step_path is null").unionByName(named.join(paths, "step_path", "left_semi").select(gold.columns)), named.join(paths, "step_path", "left_anti").select(gold.columns)


def hold_out(df: DataFrame, gold: DataFrame, key: str = "id") -> DataFrame:
    return df.join(gold.select(key), key, "left_anti")


def append_missing(todo: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key was not written yet."""
    return todo.join(done.select(key), key, "left_anti")


def mark_blocked(timings: DataFrame, prereqs: DataFrame) -> DataFrame:
    """Add blocked: a stage that this one needs timed out for the same part."""
    out = timings.filter("timeout").select("part", F.col("stage").alias("prereq")).distinct()
    blocked = prereqs.join(out, "prereq").select("part", "stage").distinct().withColumn("blocked", F.lit(True))
    return timings.join(blocked, ["part", "stage"], "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def stage_matrix(timings: DataFrame, parts: list[str]) -> DataFrame:
    """Seconds, one row a stage and one column a part."""
    return timings.groupBy("stage").pivot("part", parts).agg(F.round(F.max("seconds"), 6))


def culprits(timings: DataFrame) -> DataFrame:
    return timings.filter("timeout").groupBy("stage").agg(F.count("*").alias("timeouts"), F.max("seconds").alias("worst"))


def last_build(events: DataFrame) -> DataFrame:
    """The last valid build of each run, else its last build."""
    key = F.struct("valid", "seq")
    return events.groupBy("run_id").agg(F.max_by(F.struct("seq", "valid", "spec"), key).alias("b")).select("run_id", "b.*")


def gen_gate(df: DataFrame, slow: float = 60.0) -> DataFrame:
    """Add passed (file there, valid, faces in range) and slow_flag."""
    ok = F.col("step_exists") & F.col("occ_valid") & F.col("faces").between(F.col("expect_faces")[0], F.col("expect_faces")[1])
    return df.withColumns({"passed": F.coalesce(ok, F.lit(False)), "slow_flag": F.col("wall_seconds") > slow})


def gate_summary(gated: DataFrame) -> DataFrame:
    return gated.groupBy("model").agg(F.count("*").alias("n"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.min("wall_seconds").alias("fastest"), F.max("wall_seconds").alias("slowest"))
