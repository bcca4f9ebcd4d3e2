"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the sum of the hashed vectors of the word, of its first 3 to 6 letters and of its
letter groups of 3 and 4 (with word ends), so unseen forms of a word family still count. A vector
starts from how one-sided its cell is between toxic and clean texts, shrunk where evidence is thin,
and cells seen in fewer than ``SEEN`` texts stay zero. Windows of ``SPAN``
words overlap by half and cover the whole text; a text scores as its worst window, on a scale
fitted on the labelled texts.

Labels belong to texts, not to windows: the windows of a toxic text that count as toxic are chosen
first by how one-sided their word features are between toxic and clean texts, then by the network
itself; the worst windows of clean texts join random ones as counterexamples.

Labels come only from rows whose crc32 of the id, modulo 5, is not 0: at most ``sample`` of them in
the order of a hash of the id, of at most ``sample_chars`` characters each. Scoring has no bounds.

Defined cases: null text counts as empty; a text without words scores as a text with no evidence; a
null id counts as held out; without labels of both kinds every score is the share of label 1 (0 if
none); repeated rows are scored alike; extra columns are ignored, or pass through the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, give_back, held_out, lean, table
from .decontaminate import slices

SPAN, STRIDE = 24, 12
CELLS, DIM, HIDDEN = 1 << 18, 8, 12
#: Words whose features are laid out at once: bounds the memory.
AT_ONCE = 16_384
#: Cells of fewer texts carry nothing.
SEEN = 4
#: Words that a worker remembers before it starts anew: bounds its memory.
REMEMBERED = 100_000


def words_of(texts) -> tuple[pa.Array, np.ndarray]:
    """Words (runs of letters and digits, lower case) of all texts and where each text's begin."""
    lists = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pM\pN]+", " "))
    flat, cuts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    real = pc.not_equal(flat, "")
    return flat.filter(real), np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))[cuts]


def _cell(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(CELLS)).astype(np.int32)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all words in turn, and how many each has: the word, its beginnings of 3 to 6 letters,
    then its letter groups of 3 and of 4, with marks at both ends."""
    text = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(n) - n
    place = np.arange(len(text)) - np.repeat(start, n)
    lengths = 5 + (n - 2) + np.maximum(0, n - 3)
    first = np.cumsum(lengths) - lengths
    cells = np.zeros(int(lengths.sum()), np.int32)
    factor = np.uint64(0x100000001B3)
    h = np.zeros(len(words), np.uint64)
    for k in range(int(n.max(initial=0))):  # letter by letter, of the words that are so long
        on = np.flatnonzero(n > k)
        h[on] = h[on] * factor + text[start[on] + k]
        if k >= 512:  # the rest of very long words at once
            rest = np.flatnonzero(n > k + 1)
            if len(rest):
                tail = text * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * factor
                h[rest] += np.add.reduceat(tail, start)[rest]
            break
    cells[first] = _cell(h, 1)
    h = np.zeros(len(words), np.uint64)
    for k in range(1, 7):
        on = np.flatnonzero(n - 2 >= k)
        h[on] = h[on] * factor + text[start[on] + k]
        if k >= 3:
            cells[first + k - 2] = _cell(h, 2)
    for size, skip in ((3, 5), (4, None)):
        h = np.zeros(max(0, len(text) - size + 1), np.uint64)
        for k in range(size):
            h = h * factor + text[k : k + len(h)]
        at = np.flatnonzero(place[: len(h)] + size <= np.repeat(n, n)[: len(h)])
        own = np.repeat(np.arange(len(words)), n)[at]
        cells[first[own] + (5 if skip else 3 + n[own]) + place[at]] = _cell(h[at], size + 10)
    return cells, lengths


@dataclass
class Features:
    """Ragged cells of words: the word, four beginnings, then letter groups, which are shared evenly."""

    cells: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Features:
        parts = [word_features(words[i : i + AT_ONCE]) for i in range(0, len(words), AT_ONCE)] or [word_features([])]
        n = np.concatenate([n for _, n in parts])
        return cls(np.concatenate([c for c, _ in parts]), np.cumsum(n) - n, n)

    def taken(self, words: np.ndarray) -> Features:
        n = self.lengths[words]
        ends = np.cumsum(n)
        return Features(self.cells[np.repeat(self.starts[words] - ends + n, n) + np.arange(n.sum())], ends - n, n)

    def weights(self) -> np.ndarray:
        w = np.repeat(1 / np.maximum(1, self.lengths - 5), self.lengths).astype(np.float32)
        for k in range(5):
            w[self.starts + k] = 1 if k == 0 else 0.5
        return w

    def vectors(self, table: np.ndarray, dropped: np.ndarray | None = None) -> np.ndarray:
        if not len(self.starts):
            return np.zeros((0, table.shape[1]), np.float32)
        if dropped is None and len(self.starts) > AT_ONCE:
            return np.concatenate([self.taken(np.arange(i, min(i + AT_ONCE, len(self.starts)))).vectors(table) for i in range(0, len(self.starts), AT_ONCE)])
        w = self.weights() if dropped is None else self.weights() * dropped
        return np.add.reduceat(table[self.cells] * w[:, None], self.starts, axis=0)


def windows(cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of the overlapping windows that cover every text."""
    n = np.diff(cuts)
    k = np.where(n > SPAN, -(-(n - SPAN) // STRIDE) + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), k)
    first = cuts[:-1][text] + STRIDE * (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k))
    return text, first, np.minimum(SPAN, cuts[1:][text] - first)


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def some(*shape, scale):
        return rng.normal(0, scale, shape).astype(np.float32)

    p = {"table": np.zeros((CELLS, DIM), np.float32), "att": some(2 * HIDDEN, scale=0.3), "out": some(2 * HIDDEN, scale=0.3), "bias": np.full(1, -2, np.float32)}
    for d in "fb":
        p |= {f"w{d}": some(DIM, 3 * HIDDEN, scale=0.25), f"b{d}": np.zeros(3 * HIDDEN, np.float32), f"g{d}": some(HIDDEN, 2 * HIDDEN, scale=0.25), f"c{d}": some(HIDDEN, HIDDEN, scale=0.25)}
    return p


def recur(x: np.ndarray, mask: np.ndarray, g: np.ndarray, c: np.ndarray):
    """States after each step, and what the way back needs. x: steps x windows x 3 HIDDEN."""
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    states, kept = [], []
    for t in range(len(x)):
        gates = sigmoid(x[t, :, : 2 * HIDDEN] + h @ g)
        update, reset = gates[:, :HIDDEN] * mask[t][:, None], gates[:, HIDDEN:]
        new = np.tanh(x[t, :, 2 * HIDDEN :] + (reset * h) @ c)
        kept.append((h, gates, update, new))
        h = h + update * (new - h)
        states.append(h)
    return np.stack(states), kept


def recur_back(d_states, kept, mask, g, c):
    """Gradients of the inputs and of both matrices."""
    dx = np.zeros((*d_states.shape[:2], 3 * HIDDEN), np.float32)
    dg, dc, dh = np.zeros_like(g), np.zeros_like(c), np.zeros(d_states.shape[1:], np.float32)
    for t in range(len(kept) - 1, -1, -1):
        h, gates, update, new = kept[t]
        reset = gates[:, HIDDEN:]
        dh = dh + d_states[t]
        d_new = dh * update * (1 - new * new)
        d_reset_h = d_new @ c.T
        d_gate = np.concatenate([dh * (new - h) * mask[t][:, None], d_reset_h * h], 1) * gates * (1 - gates)
        dg += h.T @ d_gate
        dc += (reset * h).T @ d_new
        dx[t] = np.concatenate([d_gate, d_new], 1)
        dh = dh * (1 - update) + d_reset_h * reset + d_gate @ g.T
    return dx, dg, dc


def forward(p, ahead, back, slots, mask):
    """Logits of windows. ahead, back: inputs of both directions for each word slot; slots, mask: steps x windows."""
    hf, kf = recur(ahead[slots], mask, p["gf"], p["cf"])
    hb, kb = recur(back[slots[::-1]], mask[::-1], p["gb"], p["cb"])
    h = np.concatenate([hf, hb[::-1]], 2)
    s = np.where(mask > 0, h @ p["att"], -1e9)
    a = np.exp(s - s.max(0)) * (mask > 0)
    a /= np.maximum(a.sum(0), 1e-9)
    ctx = (a[:, :, None] * h).sum(0)
    return ctx @ p["out"] + p["bias"][0], (h, a, ctx, kf, kb)


def scored_states(x: np.ndarray, slots: np.ndarray, mask: np.ndarray, whole: np.ndarray, g: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The states of ``recur``, for scoring alone: nothing is kept for a way back. x: inputs of each word slot."""
    out = np.zeros((len(slots), slots.shape[1], HIDDEN), np.float32)
    h = np.zeros((slots.shape[1], HIDDEN), np.float32)
    for t in range(len(slots)):
        own = x[slots[t]]
        gates = h @ g
        gates += own[:, : 2 * HIDDEN]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        new = (gates[:, HIDDEN:] * h) @ c
        new += own[:, 2 * HIDDEN :]
        np.tanh(new, out=new)
        new -= h
        new *= gates[:, :HIDDEN]
        if not whole[t]:
            new *= mask[t][:, None]
        h = np.add(h, new, out=out[t])
    return out


def scored(p, ahead, back, slots, mask) -> np.ndarray:
    """Logits as ``forward`` gives them."""
    whole = mask.all(1)
    with np.errstate(over="ignore"):
        f = scored_states(ahead, slots, mask, whole, p["gf"], p["cf"])
        b = scored_states(back, slots[::-1], mask[::-1], whole[::-1], p["gb"], p["cb"])[::-1]
    s = f @ p["att"][:HIDDEN] + b @ p["att"][HIDDEN:]
    if not whole.all():
        s = np.where(mask > 0, s, np.float32(-1e9))
    a = np.exp(s - s.max(0))
    a /= np.maximum(a.sum(0), 1e-9)
    # the pooled state meets the output weights, so each state may meet them first
    return (a * (f @ p["out"][:HIDDEN] + b @ p["out"][HIDDEN:])).sum(0) + p["bias"][0]


def gradients(p, features: Features, slots, mask, y, alive, dropped):
    """Loss gradients of all parameters; those of the table come as (cells, rows), of live cells only."""
    x = features.vectors(p["table"], dropped)
    logit, (h, a, ctx, kf, kb) = forward(p, x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"], slots, mask)
    d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
    out = {"out": ctx.T @ d, "bias": np.array([d.sum()], np.float32)}
    d_ctx = d[:, None] * p["out"]
    d_a = (h * d_ctx).sum(2)
    d_s = a * (d_a - (a * d_a).sum(0))
    out["att"] = np.einsum("tn,tnk->k", d_s, h)
    d_h = a[:, :, None] * d_ctx + d_s[:, :, None] * p["att"]
    d_x = np.zeros_like(x)
    for k, kept, order in (("f", kf, slice(None)), ("b", kb, slice(None, None, -1))):
        part = d_h[order, :, :HIDDEN] if k == "f" else d_h[order, :, HIDDEN:]
        dx, out[f"g{k}"], out[f"c{k}"] = recur_back(part, kept, mask[order], p[f"g{k}"], p[f"c{k}"])
        flat, at = dx.reshape(-1, 3 * HIDDEN), slots[order].reshape(-1)
        by = np.argsort(at, kind="stable")
        start = np.flatnonzero(np.append(True, np.diff(at[by]) > 0))
        per = np.zeros((len(x), 3 * HIDDEN), np.float32)
        per[at[by][start]] = np.add.reduceat(flat[by], start, axis=0)
        out[f"w{k}"], out[f"b{k}"] = x.T @ per, per.sum(0)
        d_x += per @ p[f"w{k}"].T
    live = np.flatnonzero(alive[features.cells] & (dropped > 0))
    if len(live):
        each = np.repeat(np.arange(len(d_x)), features.lengths)[live]
        each = d_x[each] * (features.weights() * dropped)[live, None]
        cells = features.cells[live]
        by = np.argsort(cells, kind="stable")
        start = np.flatnonzero(np.append(True, np.diff(cells[by]) > 0))
        out["table"] = (cells[by][start], np.add.reduceat(each[by], start, axis=0))
    return out


class Adam:
    def __init__(self, p, rate):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, grads) -> None:
        self.t += 1
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            at, g = g if k == "table" else (slice(None), g)
            self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * g
            self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * g * g
            rate = self.rate / 10 if k == "table" else self.rate
            self.p[k][at] -= rate * fix * self.m[k][at] / (np.sqrt(self.v[k][at]) + 1e-8)


class Scorer:
    """Applies a fitted network to batches of texts."""

    def __init__(self, model: dict):
        self.p, self.scale = model["p"], model["scale"]
        self.known: dict[str, int] = {}
        self.ahead = self.back = np.zeros((0, 3 * HIDDEN), np.float32)

    def slots(self, words: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.ahead = self.back = self.ahead[:0]
        new = [w for w in words if w not in self.known]
        if new:
            x = Features.of(new).vectors(self.p["table"])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.ahead = np.concatenate([self.ahead, x @ self.p["wf"] + self.p["bf"]])
            self.back = np.concatenate([self.back, x @ self.p["wb"] + self.p["bb"]])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def window_logits(self, ids: np.ndarray, first: np.ndarray, n: np.ndarray, at_once: int = 4096) -> np.ndarray:
        out = np.zeros(len(first), np.float32)
        steps = np.arange(SPAN)[:, None]
        for i in range(0, len(first), at_once):
            f, m = first[i : i + at_once], n[i : i + at_once]
            out[i : i + at_once] = scored(self.p, self.ahead, self.back, ids[f + np.minimum(steps, m - 1)], (steps < m).astype(np.float32))
        return out

    def logits(self, texts) -> np.ndarray:
        """The worst window of each text; the bias where there is no window."""
        flat, cuts = words_of(texts)
        worst = np.full(len(texts), self.p["bias"][0], np.float32)
        if len(flat):
            coded = flat.dictionary_encode()
            ids = self.slots(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            text, first, n = windows(cuts)
            score = self.window_logits(ids, first, n)
            start = np.flatnonzero(np.append(True, np.diff(text) > 0))
            worst[text[start]] = np.maximum.reduceat(score, start)
        return worst

    def scores(self, texts) -> np.ndarray:
        return sigmoid(self.scale[0] * self.logits(texts).astype(np.float64) + self.scale[1])


def fitted(texts: list[str], y: np.ndarray, seed: int = 11, rounds=(3, 2), batch: int = 384) -> dict | None:
    """Train on whole texts with text labels; None without both labels. Deterministic."""
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    flat, cuts = words_of(pa.array(texts, pa.string()))
    coded = flat.dictionary_encode()
    vocabulary, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    features = Features.of(vocabulary)
    text, first, n = windows(cuts)
    label = y[text]
    # one-sidedness of cells between toxic and clean texts
    owner = np.repeat(np.arange(len(y)), np.diff(cuts))
    pairs = distinct(owner * len(vocabulary) + ids)
    counts = [np.zeros(CELLS), np.zeros(CELLS)]
    for lo in range(0, len(y), 50):  # some texts at a time
        part = pairs[np.searchsorted(pairs, lo * len(vocabulary)) : np.searchsorted(pairs, (lo + 50) * len(vocabulary))]
        w = part % len(vocabulary)
        own = features.taken(w)
        cells, k = own.cells, own.lengths
        once = distinct(np.repeat(part // len(vocabulary), k) * CELLS + cells)
        del own, cells
        for c in (0, 1):
            counts[c] += np.bincount(once[y[once // CELLS] == c] % CELLS, minlength=CELLS)
    share = y.mean()
    odds = np.log((counts[1] + 4 * share) / (counts[0] + 4 * (1 - share)) * (1 - share) / share)
    alive = counts[0] + counts[1] >= SEEN
    odds[~alive] = 0
    word_odds = np.maximum.reduceat(odds.astype(np.float32)[features.cells], features.starts)
    steps = np.arange(SPAN)[:, None]
    score = np.concatenate([word_odds[ids[first[i : i + 65536] + np.minimum(steps, n[i : i + 65536] - 1)]].max(0) for i in range(0, len(first), 65536)])
    p = initial(rng)
    p["table"][alive] = rng.normal(0, 0.02, (int(alive.sum()), DIM))
    p["table"][:, 0] += odds / 4
    opt = Adam(p, 0.01)
    start = np.flatnonzero(np.append(True, np.diff(text) > 0))
    for stage, epochs in enumerate(rounds):
        order = np.lexsort((-score, text))
        worst = order[start]
        # up to two windows of a toxic text, the second only if it is nearly as bad
        second = order[np.minimum(start + 1, len(order) - 1)]
        second = second[(text[second] == text[worst]) & (score[second] > 0.7 * score[worst]) & (score[worst] > 0)]
        bad = np.concatenate([worst[label[worst] == 1], second[label[second] == 1]])
        clean = np.flatnonzero(label == 0)
        good = np.unique(np.concatenate([worst[label[worst] == 0], rng.choice(clean, min(len(clean), 2 * len(y)), replace=False)]))
        rows = np.concatenate([np.repeat(bad, max(1, min(4, len(good) // max(1, 4 * len(bad))))), good])
        opt.rate = 0.01 if stage == 0 else 0.004
        for _ in range(epochs):
            rng.shuffle(rows)
            for i in range(0, len(rows), batch):
                b = rows[i : i + batch]
                used, slots = np.unique(ids[first[b] + np.minimum(steps, n[b] - 1)], return_inverse=True)
                own = features.taken(used)
                dropped = (rng.random(len(own.cells)) < 0.6).astype(np.float32) / 0.6
                opt.step(gradients(p, own, slots.reshape(SPAN, -1), (steps < n[b]).astype(np.float32), label[b].astype(np.float32), alive, dropped))
        scorer = Scorer({"p": p, "scale": (1.0, 0.0)})
        x = features.vectors(p["table"])
        scorer.ahead, scorer.back = x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]
        score = scorer.window_logits(ids, first, n).astype(np.float64)
    top = np.full(len(y), float(p["bias"][0]))
    top[text[start]] = np.maximum.reduceat(score, start)
    a, b = 1.0, 0.0  # the scale, by Newton steps with a weak pull to (1, 0)
    for _ in range(25):
        q = sigmoid(a * top + b)
        r, s = q * (1 - q), np.array([((q - y) * top).sum() + (a - 1), (q - y).sum() + 0.1 * b])
        hess = np.array([[(r * top * top).sum() + 1, (r * top).sum()], [(r * top).sum(), r.sum() + 0.1]])
        step = np.linalg.solve(hess, s)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    return {"p": p, "scale": (max(a, 0.05), b)}


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4_000, sample_chars: int = 40_000) -> tuple[dict | None, float]:
    """The network and the share of label 1 among the rows that it learned from."""
    chosen = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("_label"))
    chosen = chosen.orderBy(F.md5(F.col("doc_id").cast("string")), "_label").limit(sample)
    rows = docs.select("doc_id", "text").filter(F.length("text") <= sample_chars).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    rows = rows.groupBy("doc_id", "_label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # of a repeated id one text
    rows = rows.toArrow().to_pandas().sort_values(["doc_id", "text", "_label"])  # Arrow: no second copy as row objects
    y, texts = rows["_label"].to_numpy(np.int64), rows["text"].tolist()
    del rows
    give_back()
    model = fitted(texts, y)
    del texts
    give_back()
    return model, float(y.mean()) if len(y) else 0.0


def with_score(docs: DataFrame, model: dict | None, share: float, column: str = "score") -> DataFrame:
    """The documents with one more column, the score of the whole text."""
    if model is None:
        return docs.withColumn(column, F.lit(share))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                new = pa.array(scorer.scores(batch.column("text")), pa.float64())
                yield batch.set_column(batch.schema.get_field_index(column), pa.field(column, pa.float64()), new)

    out = docs.withColumn(column, F.lit(0.0))
    return out.mapInArrow(lean(run), out.schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model, share = fit(docs, labels, **bounds)
    out = with_score(docs.select("doc_id", "text"), model, share)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **bounds) -> DataFrame:
    """The documents that score below the threshold, each row judged by its own text."""
    model, share = fit(docs, labels, **bounds)
    column = free_name(docs, "toxicity")
    return with_score(docs, model, share, column).filter(F.col(column) < threshold).drop(column)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
