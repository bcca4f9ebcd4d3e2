"""Conversation repair, periodic runs and fertility rules against brute force, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetmill.llm import convo_repair, fertility_rules, periodic_runs
from facetmill.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CONVERSATIONS = "conv_id long, turn long, role string, text string"


# --- conversation repair ------------------------------------------------------------------------------------------


def cheapest(rows):
    """(cost, audit, lines) of the cheapest edits of (role, text, must_delete, truncated), all of them tried."""
    fills = ["", *(x for k in (1, 2) for x in map("".join, itertools.product("ua", repeat=k)))]
    full = {"u": "user", "a": "assistant"}
    best = None

    def go(i, cost, audit, initials, lines):
        nonlocal best
        if best and cost > best[0]:
            return
        for fill in fills:
            c, a, w = cost + 2 * len(fill), audit + "I" * len(fill), initials + fill
            out = lines + [f"{full[x]}:" for x in fill]
            if i == len(rows):
                if re.fullmatch(r"(s?(ua)+)?", w) and (best is None or (c, a) < best[:2]):
                    best = (c, a, out)
                continue
            role, text, must, late = rows[i]
            go(i + 1, c + 3, a + "D", w, out)
            if not must:
                if role[:1] in ("s", "u", "a"):
                    go(i + 1, c + late, a + "K", w + role[:1], out + [f"{role}:{text}"])
                for x in "ua":
                    go(i + 1, c + 2 + late, a + "R", w + x, out + [f"{full[x]}:{text}"])

    go(0, 0, "", "", [])
    return best


def plain_repair(conversations):
    """The contract read row by row."""
    out = {}
    for conv in {c for c, *_ in conversations}:
        rows = []
        for c, turn, role, text in conversations:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts, marked = Counter(), []
        for i, (_, role, text) in enumerate(rows):
            body = text.rstrip(" \t\n\r\x0b\x0c")
            late = body[-1:] not in (".", "!", "?")
            again = (role, text) in [r[1:] for r in rows[:i]]
            counts["blank" if not body else "duplicate" if again else "truncated" if late else "fine"] += 1
            marked.append((role, text, not body or again, late))
        legal = ("su", "ua", "au")
        wrong = sum(a[1][:1] + b[1][:1] not in legal for a, b in zip(rows, rows[1:]))
        cost, audit, lines = cheapest(marked)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], wrong, cost, audit, digest)
    return out


def test_repair_equals_all_edits_tried(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 4)):
            rows.append((conv, turn * rng.choice([1, 1, 2]), rng.choice(["user", "assistant", "system", "tool", "user"]), rng.choice(["Yes.", "No", "a b!", " ", "Why?"])))
    rows += [(None, None, None, None), (None, 1, "user", "Hi."), (500, None, "user", "x."), (500, None, "user", "x."), (501, 3, "assistant", None)]
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumn("audit", F.lit("x")).withColumn("pos", F.lit(1))
    want = plain_repair(rows)
    for options in ({}, {"giant": 1}, {"giant_chars": 6}):  # in one piece, all cut into segments, some of both
        got = {r.conv_id: tuple(r)[1:] for r in convo_repair.repair(df, **options).collect()}
        assert got == want
    assert convo_repair.repair(df.limit(0)).collect() == []


def test_segments_of_a_giant_compose(spark, monkeypatch):
    """Segments of a few rows give what one task gives; the vectors at their borders decide ties alike."""
    monkeypatch.setattr(convo_repair, "SEGMENT_BITS", 3)
    rows = spark.range(400).select(
        F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.hash("id") % 3 == 0, "user").when(F.hash("id") % 7 == 1, "system").otherwise("assistant").alias("role"),
        F.concat(F.lit("t"), (F.col("id") % 300).cast("string"), F.when(F.hash("id") % 5 != 0, ".").otherwise("")).alias("text"),
    )
    whole, cut = convo_repair.repair(rows).collect(), convo_repair.repair(rows, giant=10).collect()
    assert whole == cut and whole[0].duplicate > 0 and len(whole[0].audit) > 300


@pytest.mark.parametrize("block", [1, 2, 3, 5])
def test_blocks_of_any_length_agree(block):
    rng, base, other = random.Random(block), convo_repair.tables(), convo_repair.tables(block)
    for _ in range(200):
        syms = bytes(rng.randrange(9) for _ in range(rng.randint(0, 30)))
        a, b = ("".join(t.trace(syms, t.end, 0)[0]) for t in (base, other))
        assert a == b
        to, add = other.mapped(syms)
        borders, total = other.borders(syms, other.end)
        assert (to[other.end], add[other.end]) == (borders[-1], total)


# --- runs -------------------------------------------------------------------------------------------------------


def all_runs(w, least=12):
    out = []
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            n = j - i + p
            if j > i and n >= max(least, 2 * p):
                s = w[i : i + n]
                if not any(s[q:] == s[:-q] for q in range(1, p)):
                    out.append((i, n, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        pieces = [np.array([rng.randint(0, rng.choice([0, 1, 2, 3])) for _ in range(rng.randint(1, 40))]) for _ in range(rng.randint(1, 4))]
        got = [[] for _ in pieces]
        for piece, *run in zip(*(x.tolist() for x in periodic_runs.runs_of(pieces, 2))):
            got[piece].append(tuple(run))
        assert [sorted(g, key=lambda r: (r[0], r[2])) for g in got] == [all_runs(p.tolist(), 2) for p in pieces]
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    texts = [[c.encode() for c in fib[-1]], [], [b"x"] * 50, [b"%d" % (i % 7) for i in range(100)], [b"%d" % i for i in range(100)]]
    assert periodic_runs.found_runs(texts) == [all_runs(t) for t in texts]


def test_runs_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(1).alias("start"), F.lit("x").alias("n_runs"))
    odd = spark.createDataFrame([(None, "a " * 20, 1, "x"), (5, None, 1, "x"), (5, "", 1, "x"), (5, "tick tock " * 9000, 1, "x")], docs.schema)
    docs = docs.unionByName(odd)
    got = periodic_runs.with_runs(docs, planted=True).collect()
    want = []
    for r in docs.collect():
        words = WORD.findall(r.text or "")
        n = len(words)
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        if len(words) > 3000:  # one word again and again
            runs = [(0, n, 1)] if len(set(words)) == 1 else None
        else:
            runs = all_runs(words)
        if runs is None:
            continue
        dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, " ".join(w for i, w in enumerate(words) if i not in dropped))]
        want.append((r.doc_id, len(runs), *longest, *digests))
    assert Counter(want) <= Counter(map(tuple, got)) and len(got) == docs.count() and len(want) > 190
    assert periodic_runs.with_runs(docs.limit(0)).collect() == []


# --- fertility ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabularies():
    P = pytest.importorskip("public_tokenizers")
    return P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


def test_base_counts_and_measures(spark, sf_dir, vocabularies):
    import sentencepiece

    odd = [(None, None, None), (1, "", "en"), (1, "x" * 5000 + " 中文 бу", "en"), (2, "a b\n" * 40 + "a b #|\n\n \n", None)]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    rows = fertility_rules.quality_verdicts(docs.withColumns({"b0": F.lit(1), "script": F.lit("x")}), *vocabularies).collect()
    got = Counter((r.doc_id, *(r[b] for b in fertility_rules.BASE), r.base_failed) for r in rows)
    want = Counter()
    for r in docs.collect():
        base = plain_base(r.text)
        want[(r.doc_id, *base, base[0] < 20 or 100 * base[4] > 30 * base[0])] += 1
    assert got == want
    assert not any(r.kept and r.base_failed for r in rows)
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabularies[0])
    text = {r.doc_id: r.text for r in docs.filter("doc_id between 10 and 40").collect()}
    for r in rows:
        if r.doc_id in text and r.n_words:
            pieces = [i for w in WORD.findall(text[r.doc_id]) for i in sp.encode(w)]
            assert abs(r.chars_per_piece - r.word_chars / len(pieces)) < 1e-12
            assert abs(r.fallback_share - sum(map(sp.is_byte, pieces)) / len(pieces)) < 1e-12
            p = np.array(list(Counter(pieces).values())) / len(pieces)
            assert abs(r.entropy + (p * np.log2(p)).sum() / np.log2(max(2, len(pieces)))) < 1e-9
    assert fertility_rules.quality_verdicts(docs.limit(0), *vocabularies).collect() == []


def test_bands_follow_the_language(spark):
    """Measures far off their language's median are rejected; a rare language is judged by its script, a short text with more ease."""
    measures = "n_words long, chars_per_piece double, chars_per_token double, fallback_share double, entropy double, base_failed boolean"
    ordinary = [(i, lang, "Latin", 400, m + (i % 11) * 0.01, m, 0.0, 0.7, False) for i in range(300) for lang, m in (("en", 4.0), ("fi", 2.0))]
    odd = [
        (1000, "en", "Latin", 400, 2.0, 4.0, 0.0, 0.7, False), (1001, "fi", "Latin", 400, 2.05, 2.0, 0.0, 0.7, False), (1002, "en", "Latin", 400, 4.0, 4.0, 0.5, 0.7, False),
        (1003, "xx", "Latin", 400, 20.0, 4.0, 0.0, 0.7, False), (1004, "xx", "Latin", 400, 3.0, 3.0, 0.0, 0.7, False), (1005, "en", "Latin", 400, 4.0, 4.0, 0.0, 0.7, True),
        (1006, "en", "Latin", 25, 4.45, 4.0, 0.0, 0.7, False), (1007, "en", "Latin", 400, 4.45, 4.0, 0.0, 0.7, False), (1008, None, "Han", 400, 4.0, 4.0, 0.0, 0.7, False),
    ]
    rows = spark.createDataFrame(ordinary + odd, f"doc_id long, lang string, script string, {measures}")
    rows = rows.withColumns({b: F.lit(0).cast("long") for b in fertility_rules.BASE if b != "n_words"})
    for n in (1, 7):
        spread = rows.repartition(n)
        kept = {r.doc_id: r.kept for r in fertility_rules.judged(spread, fertility_rules.bands(spread)).filter("doc_id >= 1000").collect()}
        assert kept == {1000: False, 1001: True, 1002: False, 1003: False, 1004: True, 1005: False, 1006: True, 1007: False, 1008: True}
