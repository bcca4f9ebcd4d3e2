"""Quality rules from how public tokenisers take a text (fertility), beside a base of word and line counts.

Every distinct word is encoded once a worker by two vocabularies: pieces with byte fallback, and
byte-level tokens of many languages. A text then has characters per piece and per token, the share of
pieces that are fallback bytes, and the entropy of its pieces (of the most that so many pieces can have).

Bands of these come from all texts that pass the base: medians and quartiles of a language, from counts
over bins, so they are the same however the rows are spread. A text is rejected if a measure is more
than ``WIDTH`` deviations (of the quartiles) from the median. Measures of few words scatter more, so a
text shorter than the median one is held to the square root of its share of it. A language of fewer than
``ENOUGH`` texts is judged by the bands of its script, and a script of fewer by those of all texts.

Defined results: a null text has no words, so it fails the base; a null language is one of its own; bands
of a table with too few texts reject nothing; words of over 1,000 characters are encoded in pieces of
1,000; rows are independent, so repeated ids give a row each.
"""

from __future__ import annotations

import base64
import bisect
import functools
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, small, stored, table
from .decontaminate import slices

WIDTH, ENOUGH, FLOOR = 6.0, 100, 0.02
BINS = 1000  # of one unit of a measure
# Fixed values of the base: fewest words, most repeated words of a hundred, window, symbols.
LEAST_WORDS, MOST_REPEATED, WINDOW, SYMBOLS = 20, 30, 8, b"#*$%&|<>"
LONG_WORD, MEMORY = 1000, 100_000
MEASURES = ("chars_per_piece", "chars_per_token", "fallback_share", "entropy")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# First code points of blocks, and the script that letters from there on have.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "other"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0780, "other"),
    (0x0900, "Devanagari"), (0x0980, "other"), (0x0E00, "Thai"), (0x0E80, "other"), (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"), (0xA000, "other"), (0xAC00, "Hangul"),
    (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"), (0x20000, "Han"), (0x32000, "other"),
)
STARTS = [s for s, _ in SCRIPTS]
NAMES = sorted({n for _, n in SCRIPTS})
CODES = [NAMES.index(n) for _, n in SCRIPTS]


class Vocabularies:
    """The two public vocabularies, and what they make of words; words that were seen are looked up."""

    def __init__(self, pieces: str, ranks: str, pattern: str):
        import sentencepiece
        import tiktoken

        self.sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.width = np.zeros(max(table.values()) + 1, np.int64)  # bytes of a token
        self.width[list(table.values())] = list(map(len, table))
        self.fallback = np.array([self.sp.is_byte(i) for i in range(self.sp.vocab_size())])
        self.size = self.sp.vocab_size()
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = defaultdict(lambda: len(self.index))
        #: Of each word: pieces and where they begin, tokens, characters, script of the first letter.
        self.pieces, self.first, self.tokens, self.chars, self.script = (np.zeros(0, np.int64) for _ in range(5))
        self.flat = np.zeros(0, np.int32)

    def numbers(self, texts: list[list[bytes]]) -> np.ndarray:
        """A number for each word of the texts; what is known of the words is in the arrays under it."""
        if len(self.index) > MEMORY:
            self.forget()
        known, at = len(self.index), self.index.__getitem__
        ids = np.fromiter((i for words in texts for i in map(at, words)), np.int64, sum(map(len, texts)))
        self._learn(list(itertools.islice(self.index, known, None)))
        return ids

    def _learn(self, words: list[bytes]) -> None:
        if not words:
            return
        texts = [w.decode("utf-8", "replace") for w in words]
        chars = np.fromiter(map(len, texts), np.int64, len(texts))
        cut = texts
        if chars.max() > LONG_WORD:
            cut = [t[i : i + LONG_WORD] for t in texts for i in range(0, len(t), LONG_WORD)]
        parts = -(-chars // LONG_WORD)  # of each word
        last = np.cumsum(parts) - 1
        ids = self.sp.encode(cut)
        n = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))[last]
        pieces = np.diff(n, prepend=0)
        self.first = np.append(self.first, len(self.flat) + n - pieces)
        self.flat = np.append(self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(n[-1])))
        self.pieces, self.chars = np.append(self.pieces, pieces), np.append(self.chars, chars)
        self.tokens = np.append(self.tokens, np.diff(np.cumsum(self._token_counts(cut))[last], prepend=0))
        self.script = np.append(self.script, np.fromiter(map(_script, texts), np.int64, len(texts)))

    def _token_counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word with a space before it. Tokens do not cross spaces, so all are encoded at once."""
        joined = " " + " ".join(words)
        ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words)))
        reached = np.cumsum(self.width[self.bpe.encode_to_numpy(joined, disallowed_special=())])
        at = np.searchsorted(reached, ends)
        if len(reached) and (reached[np.minimum(at, len(reached) - 1)] == ends).all():
            return np.diff(at + 1, prepend=0)
        return np.array([len(self.bpe.encode_ordinary(" " + w)) for w in words], np.int64)  # a token crosses all the same


def _script(word: str) -> int:
    letter = word[0] if word[0].isalpha() else next((c for c in word if c.isalpha()), None)
    return CODES[bisect.bisect_right(STARTS, ord(letter)) - 1] if letter else NAMES.index("other")


@functools.lru_cache(maxsize=1)
def vocabularies(pieces: str, ranks: str, pattern: str) -> Vocabularies:
    return Vocabularies(pieces, ranks, pattern)


def repeated_in_windows(ids: np.ndarray, text: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words lie in a window of so many words that their text holds twice; exact."""
    n = len(ids)
    covered = np.zeros(n, bool)
    if n < window:
        return covered
    m = n - window + 1
    key = text[:m].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(window):
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + ids[k : m + k].astype(np.uint64)
    place = np.flatnonzero(text[:m] == text[window - 1 :])
    _, inverse, counts = np.unique(key[place], return_inverse=True, return_counts=True)
    place = place[counts[inverse] > 1]
    if len(place):  # words decide, not hashes
        rows = np.column_stack([text[place], *[ids[place + k] for k in range(window)]])
        _, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        place = place[counts[inverse.ravel()] > 1]
    edge = np.zeros(n + 1, np.int64)
    edge[place] += 1
    edge[place + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def repeated_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def text_rows(texts: list[bytes], v: Vocabularies) -> dict[str, np.ndarray]:
    """Base counts and measures of UTF-8 texts."""
    split = [t.split() for t in texts]  # bytes split at ASCII white space
    ids = v.numbers(split)
    n_words = np.array([len(words) for words in split], np.int64)
    n, text = len(texts), np.repeat(np.arange(len(texts)), n_words)
    per = lambda values: np.bincount(text, values, n) if len(ids) else np.zeros(n)
    count = v.pieces[ids]
    end = np.cumsum(count)
    every = np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - count, count) + np.repeat(v.first[ids], count)
    owner, piece = np.repeat(text, count), v.flat[every]
    pieces = np.bincount(owner, minlength=n).astype(np.float64)
    cells, times = np.unique(owner * v.size + piece, return_counts=True)
    share = times / pieces[cells // v.size]
    entropy = np.bincount(cells // v.size, -share * np.log2(share), n) / np.log2(np.maximum(pieces, 2))
    fallback = np.bincount(owner, v.fallback[piece], n)
    scripts = np.bincount(text * len(NAMES) + v.script[ids], minlength=n * len(NAMES)).reshape(n, len(NAMES))
    word_chars, none = per(v.chars[ids]), np.maximum(pieces, 1)
    return {
        "n_words": n_words, "word_chars": word_chars.astype(np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([repeated_lines(t) for t in texts], np.int64),
        "n_repeat_words": per(repeated_in_windows(ids, text).astype(np.float64)).astype(np.int64),
        "script": np.array(NAMES)[scripts.argmax(1)] if n else np.zeros(0, "U1"),
        "chars_per_piece": word_chars / none, "chars_per_token": word_chars / np.maximum(per(v.tokens[ids]), 1),
        "fallback_share": fallback / none, "entropy": entropy,
    }


def measured(docs: DataFrame, pieces: str, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, lang, base counts, script, measures, base_failed) of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [*(f"{b} long" for b in BASE), "script string", *(f"{m} double" for m in MEASURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(pieces, ranks, pattern)
        for whole in batches:
            for part in slices(whole, "text", 2_000_000):
                rows = text_rows([t or b"" for t in part.column(2).cast(pa.binary()).to_pylist()], v)
                columns = [pa.array(c.tolist() if c.dtype.kind == "U" else c) for c in rows.values()]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *columns], names=["doc_id", "lang", *rows])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", lang.alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(lean(run), f"doc_id {kind}, lang string, {', '.join(fields)}")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def bands(rows: DataFrame) -> DataFrame:
    """(level, script, lang, n, words, m_ and d_ of each measure): medians and deviations over the rows that pass the base.

    ``level`` 0: a script and language, 1: a script, 3: all. Values are counted by bins first, so a
    group holds as many rows as there are bins.
    """
    sizes = F.struct(F.lit("n_words").alias("measure"), F.floor(F.log2("n_words") * BINS).alias("bin"))
    each = [F.struct(F.lit(m).alias("measure"), F.floor(F.col(m) * BINS).alias("bin")) for m in MEASURES]
    cells = rows.filter(~F.col("base_failed")).select("script", "lang", F.explode(F.array(sizes, *each)).alias("c"))
    cells = cells.groupBy("script", "lang", "c.measure", "c.bin").agg(F.count("*").alias("n"))
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), s.alias("s"), g.alias("g")) for k, s, g in (
        (0, F.col("script"), F.col("lang")), (1, F.col("script"), F.lit(None)), (3, F.lit(None), F.lit(None)),
    )]))
    cells = cells.withColumn("k", levels).groupBy("k.level", "k.s", "k.g", "measure", "bin").agg(F.sum("n").alias("n"))
    quartiles = F.expr("percentile(bin, array(0.25, 0.5, 0.75), n)")
    spread = cells.groupBy("level", "s", "g", "measure").agg(F.sum("n").alias("n"), quartiles.alias("q"))
    at = lambda m, i: F.max(F.when(F.col("measure") == m, F.col("q")[i])) / BINS
    of = [at(m, 1).alias(f"m_{m}") for m in MEASURES]
    of += [F.greatest(F.lit(FLOOR), (at(m, 2) - at(m, 0)) / 1.349).alias(f"d_{m}") for m in MEASURES]
    return spread.groupBy("level", "s", "g").agg(F.max("n").alias("n"), F.pow(F.lit(2.0), at("n_words", 1)).alias("words"), *of)


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """The rows with ``kept``: they pass the base and lie within the bands of the first level with enough texts."""
    facts = F.struct("words", *[f"{p}_{m}" for m in MEASURES for p in "md"])
    enough = limits.filter(F.col("n") >= ENOUGH).select("level", "s", "g", facts.alias("b"))
    for level, on in ((0, [("script", "s"), ("lang", "g")]), (1, [("script", "s")]), (3, [])):
        side = enough.filter(F.col("level") == level).select(F.col("s").alias(f"s{level}"), F.col("g").alias(f"g{level}"), F.col("b").alias(f"b{level}"))
        meet = F.lit(True)
        for a, b in on:
            meet = meet & F.col(a).eqNullSafe(F.col(f"{b}{level}"))
        if on:
            rows = rows.join(small(side), meet, "left").drop(f"s{level}", f"g{level}")
        else:  # one row at most
            one = side.select("b3").first()
            kind = side.schema["b3"].dataType
            whole = F.struct(*[F.lit(v).cast("double").alias(n) for n, v in one.b3.asDict().items()]) if one else F.lit(None).cast(kind)
            rows = rows.withColumn("b3", whole)
    b = F.coalesce("b0", "b1", "b3")
    ease = F.least(F.lit(1.0), F.sqrt(F.col("n_words") / b["words"]))
    off = lambda m: (F.col(m) - b[f"m_{m}"]) / b[f"d_{m}"] * ease
    out = off("fallback_share") > WIDTH  # few fallbacks are no fault
    for m in ("chars_per_piece", "chars_per_token", "entropy"):
        out = out | (F.abs(off(m)) > WIDTH)
    kept = ~F.col("base_failed") & ~F.coalesce(out, F.lit(False))
    return rows.withColumn("kept", kept).select("doc_id", *BASE, "base_failed", "kept", *MEASURES, "script")


def quality_verdicts(docs: DataFrame, pieces: str, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, base counts, base_failed, kept, measures, script) of every text."""
    rows = stored(measured(docs, pieces, ranks, pattern), "fertility")
    return judged(rows, stored(bands(rows), "fertility-bands"))


def op13_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    import public_tokenizers as P

    return quality_verdicts(table(spark, sf_dir, "documents"), P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
