"""Text quality by a sparse rule ensemble.

Statistics of the whole text are Spark columns. Small trees, boosted one after another on a bounded
sample of labelled rows, give conjunctive rules (every path from a root); a logistic model with an
L1 penalty keeps few of them; the kept rules are compiled back into one Spark column, so scoring
runs inside code generation without Python.

Labels come only from rows whose crc32 of the id, modulo 5, is not 0, at most ``sample`` of them in
the order of a hash of the id. Language, source, id and labels are no inputs.

Defined cases: null text counts as empty and is scored like an empty text; a null id counts as held
out; null labels are not learned from; without labels of both kinds every score is the share of
label 1 (0.5 without any); repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, table


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns of ``STATISTICS`` (doubles) over the whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_t", t).withColumn("_w", F.filter(F.split("_t", r"\s+"), lambda w: w != ""))
    share = lambda n, d: F.when(d > 0, n.cast("double") / d).otherwise(0.0)
    chars, words = F.char_length("_t"), F.size("_w")
    out = out.withColumns({"_c": chars, "_n": words})
    # the word before, cut to the same length
    shifted = F.concat(F.array(F.lit("")), F.slice(F.col("_w"), 1, F.greatest(F.col("_n") - 1, F.lit(0))))
    repeats = F.size(F.filter(F.zip_with("_w", shifted, lambda a, b: a == b), lambda x: x))
    count = lambda p: F.regexp_count("_t", F.lit(p))
    out = out.withColumns(
        {
            "q_log_chars": F.log1p(F.col("_c").cast("double")),
            "q_log_words": F.log1p(F.col("_n").cast("double")),
            "q_word_chars": share(F.col("_c") - F.col("_n"), F.col("_n")),
            "q_distinct": share(F.size(F.array_distinct("_w")), F.col("_n")),
            "q_upper": share(count(r"\p{Lu}"), F.col("_c")),
            "q_digits": share(count(r"[0-9]"), F.col("_c")),
            "q_odd": share(count(r"[^\p{L}\p{N}\s.,;:'\"()?-]"), F.col("_c")),
            "q_bangs": share(count("!!"), F.col("_n")),
            "q_bars": share(count(r" \| "), F.col("_n")),
            "q_stops": share(count(r"[.?!](\s|$)"), F.col("_n")),
            "q_lines": share(count(r"\n"), F.col("_n")),
            "q_repeats": share(repeats, F.col("_n")),
        }
    )
    return out.drop("_t", "_w", "_c", "_n")


STATISTICS = ("q_log_chars", "q_log_words", "q_word_chars", "q_distinct", "q_upper", "q_digits", "q_odd", "q_bangs", "q_bars", "q_stops", "q_lines", "q_repeats")

#: A condition: (statistic, True for <=, threshold). A rule is a tuple of conditions that all hold.
Rule = tuple[tuple[int, bool, float], ...]


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, low, at in rule:
        out &= (x[:, k] <= at) == low
    return out


def grown_rules(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, cuts: list[np.ndarray], least: int) -> tuple[list[Rule], np.ndarray]:
    """Paths of one regression tree on gradients, and its prediction (Newton steps at the leaves)."""
    rules: list[Rule] = []
    step = np.zeros(len(x))
    stack: list[tuple[Rule, np.ndarray]] = [((), np.arange(len(x)))]
    while stack:
        rule, rows = stack.pop()
        best = (1e-6, -1, 0.0)
        if len(rule) < depth and len(rows) >= 2 * least:
            g, h = grad[rows], hess[rows]
            total = g.sum() ** 2 / (h.sum() + 1)
            for k, edges in enumerate(cuts):
                if not len(edges):
                    continue
                cell = np.searchsorted(edges, x[rows, k], "left")  # cell i: value <= edges[i]
                gl, hl, nl = (np.cumsum(np.bincount(cell, w, len(edges) + 1))[:-1] for w in (g, h, np.ones(len(rows))))
                gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - total
                gain[(nl < least) | (len(rows) - nl < least)] = 0
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], k, float(edges[i]))
        if best[1] < 0:
            step[rows] = grad[rows].sum() / (hess[rows].sum() + 1)
            continue
        low = x[rows, best[1]] <= best[2]
        for side in (True, False):
            child = (*rule, (best[1], side, best[2]))
            rules.append(child)
            stack.append((child, rows[low if side else ~low]))
    return rules, step


def simplified(rule: Rule) -> Rule:
    """One lower and one upper bound a statistic at most."""
    bound: dict[tuple[int, bool], float] = {}
    for k, low, at in rule:
        bound[k, low] = min(bound.get((k, low), at), at) if low else max(bound.get((k, low), at), at)
    return tuple((k, low, at) for (k, low), at in sorted(bound.items()))


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient; the intercept is not penalised."""
    n, p = z.shape
    a = np.concatenate([z, np.ones((n, 1))], 1)
    v = np.ones(p + 1)
    for _ in range(30):  # largest eigenvalue, for the step
        v = a.T @ (a @ v)
        top = np.linalg.norm(v)
        v /= top
    step = 4 * n / top
    w = look = np.zeros(p + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    t = 1.0
    for _ in range(rounds):
        g = a.T @ (1 / (1 + np.exp(-(a @ look))) - y) / n
        new = look - step * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w[:-1], float(w[-1])


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 1e-3, cells: int = 64) -> tuple[list[tuple[Rule, float]], float]:
    """Weighted rules and intercept. Deterministic."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return [], float(np.log(p / (1 - p)))
    cuts = []
    for k in range(x.shape[1]):
        edges = np.unique(np.quantile(x[:, k], np.linspace(0, 1, cells + 1)[1:-1]))
        cuts.append(edges[edges < x[:, k].max()])
    f = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[Rule, None] = {}
    least = max(3, len(y) // 500)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        found, step = grown_rules(x, y - p, p * (1 - p), depth, cuts, least)
        rules |= dict.fromkeys(map(simplified, found))
        f += 0.3 * step
    z = np.stack([holds(r, x) for r in rules], 1).astype(np.float64)
    keep, first = [], {}
    for k in range(z.shape[1]):  # rules that mark the same rows are one
        if first.setdefault(z[:, k].tobytes(), k) == k and 0 < z[:, k].mean() < 1:
            keep.append(k)
    z, kept = z[:, keep], [list(rules)[k] for k in keep]
    w, b = lasso_logistic(z, y.astype(float), penalty)
    return [(r, float(c)) for r, c in zip(kept, w) if c], b


def rule_column(rules: list[tuple[Rule, float]], intercept: float, columns=STATISTICS) -> Column:
    """The ensemble as one column: 1 / (1 + exp(-sum))."""
    total = F.lit(intercept)
    for rule, weight in rules:
        test = F.lit(True)
        for k, low, at in rule:
            test = test & (F.col(columns[k]) <= at if low else F.col(columns[k]) > at)
        total = total + F.when(test, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """(doc_id, text, label) of at most ``sample`` labelled rows outside the held-out fold, in the order of a hash."""
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("_label"))
    cells = 1 << 20  # only a share of the labels, about twice as many as wanted, is put in order
    chosen = chosen.filter(F.pmod(F.xxhash64("doc_id"), F.lit(cells)) < max(1, 2 * sample * cells // max(1, chosen.count())))
    chosen = chosen.orderBy(F.md5(F.col("doc_id").cast("string")), "_label").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    return rows.groupBy("doc_id", "_label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # of a repeated id one text


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = 12_000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    learned = with_statistics(labelled_sample(docs, labels, "quality", sample)).select("_label", *STATISTICS)
    rows = learned.toPandas().sort_values([*STATISTICS, "_label"])
    rules, intercept = fit_rules(rows[list(STATISTICS)].to_numpy(float), rows["_label"].to_numpy(int))
    scored = with_statistics(docs.select("doc_id", "text"))
    out = scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), rule_column(rules, intercept).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
