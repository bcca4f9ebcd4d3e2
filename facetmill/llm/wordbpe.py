"""Token counts for a lower-casing word BPE by rank-synchronous merging of ragged arrays.

A batch of distinct pre-tokens lies in one flat array of symbol ids with the owner of each symbol.
Each round looks up the rank of every adjacent pair, takes each owner's lowest rank, and applies
all those merges at once (a run of one repeated symbol merges from the left, every other pair).
What survives is the count. Words and pre-tokens met before are looked up.

Defined cases: null counts as the empty text, with 0 tokens; strings of the added tokens inside a
text are one token each, as the library has it by default; texts of any length are counted whole;
repeated rows are ordinary rows; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, table

#: Words that a worker remembers before it forgets the rare ones: bounds its memory.
REMEMBERED = 150_000
#: Bytes of text that are looked up at once.
SLICE = 4_000_000


def byte_symbols() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """Normalisation, pre-tokens and merges as the tokenizer file states them."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.find = regex.compile(pattern).findall
        self.find_lines = regex.compile(pattern + r"|\n").findall
        # code points that this Python does not know: the library may, so it is asked
        self.later = re.compile("[\u0378-\U0010ffff]").search
        self.path, self.library = path, None
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        end = model["end_of_word_suffix"]
        alphabet = byte_symbols()
        self.inner = np.array([vocab[alphabet[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[alphabet[b] + end] for b in range(256)], np.int64)
        self.n = max(vocab.values()) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]

    def segments(self, text: str) -> list[str]:
        """The text cut at added tokens, which keep their places (odd positions)."""
        return self.split_added(text) if self.split_added and "<|" in text else [text]

    def pre_tokens(self, segment: str) -> list[str]:
        """Normal form C, lower case letter by letter, then the file's pattern."""
        return self.asked(segment) if self.strange(segment) else self.find(self.normal(segment))

    def strange(self, segment: str) -> bool:
        return not segment.isascii() and bool(self.later(segment)) and any(unicodedata.category(c) == "Cn" for c in segment)

    def normal(self, segment: str) -> str:
        if not segment.isascii():
            segment = unicodedata.normalize("NFC", segment).replace("Σ", "σ")
        return segment.lower()

    def asked(self, segment: str) -> list[str]:
        """The library's own pre-tokens, back as text."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.bytes = {c: b for b, c in byte_symbols().items()}
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(segment))
        return [bytes(self.bytes[c] for c in part).decode("utf-8") for part, _ in parts]

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all the words, flat, and the number of each word's."""
        raw = [w.encode("utf-8") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[flat]
        last = np.cumsum(lengths)[lengths > 0] - 1
        symbols[last] = self.final[flat[last]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_ids, done_owner = [], []
        none = np.int64(len(self.keys))
        while len(symbols):
            key = symbols[:-1] * self.n + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.rank[at], none)
            rank = np.append(rank, none)
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, start)
            per = np.repeat(lowest, np.diff(np.append(start, len(symbols))))
            over = per == none
            if over.any():  # those words are finished
                done_ids.append(symbols[over])
                done_owner.append(owner[over])
            hit = np.flatnonzero((rank == per) & ~over)
            if len(hit):  # of adjacent hits, every other one from the left
                run = np.flatnonzero(np.append(True, np.diff(hit) > 1))
                first = np.repeat(hit[run], np.diff(np.append(run, len(hit))))
                hit = hit[(hit - first) % 2 == 0]
                at_hit = at[hit]
                symbols[hit] = self.made[at_hit]
            keep = ~over
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(words))


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, take: np.ndarray) -> np.ndarray:
    """The concatenation of the rows ``take`` of a ragged array."""
    n = lengths[take]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[take] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


class Grown:
    """A numpy array that doubles as it is appended to."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(self.n, len(more)) + 1024, self.data.dtype)])
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


class Remembered:
    """Strings and their token ids (ragged), learned once; ``learn`` gives flat ids and lengths of new ones."""

    def __init__(self, learn, kind=np.int32):
        self.learn, self.kind = learn, kind
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}  # slots count up in the dict's own order
        self.flat, self.starts, self.lengths, self.met = Grown(self.kind), Grown(np.int64), Grown(np.int64), Grown(np.int32)

    def add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first = self.starts.n
        self.slot.update(zip(words, range(first, first + len(words))))
        self.starts.add(self.flat.n + np.cumsum(lengths) - lengths)
        self.lengths.add(lengths)
        self.flat.add(ids)
        self.met.add(np.zeros(len(words), np.int32))

    def forget(self, most: int) -> None:
        """Keep what was met more than once since the last time, and at most so many: those met most."""
        met = self.met.data[: self.met.n]
        keep = np.flatnonzero(met > 1)
        if len(keep) > most:
            keep = np.sort(np.argsort(-met, kind="stable")[:most])
        names, ids, lengths = list(self.slot), self.ids(keep), self.lengths.data[keep]
        self.clear()
        self.add([names[i] for i in keep.tolist()], ids, lengths)

    def slots(self, words: list[str]) -> np.ndarray:
        """Slots of distinct words."""
        get = self.slot.get
        found = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            ids, lengths = self.learn(fresh)
            found[new] = np.arange(self.starts.n, self.starts.n + len(fresh))
            self.add(fresh, ids, lengths)
        self.met.data[found] += 1
        return found

    def ids(self, take: np.ndarray) -> np.ndarray:
        return ragged(self.flat.data, self.starts.data, self.lengths.data, take)


class TextTokens:
    """Token ids of whole texts. White space never lies inside a pre-token, so a text's ids are those
    of its words in turn; distinct words of a batch are found by Arrow, and only words not met
    before are cut into pre-tokens, and only pre-tokens not met before are merged."""

    def __init__(self, path: str, encode=None):
        bpe = self.bpe = WordBpe(path)
        self.parts = Remembered(encode or bpe.merged)
        self.words = Remembered(self._learn)
        self.split = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+").split

    def _make_room(self) -> None:
        for known in (self.words, self.parts):
            known.forget(REMEMBERED // 2)
        added = {text: number for text, number in self.bpe.added.items() if text not in self.parts.slot}  # no pre-token looks like these
        self.parts.add(list(added), np.array(list(added.values()), np.int64), np.ones(len(added), np.int64))

    def _cut(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The pre-tokens of all words in turn, and how many each has."""
        lines = "\n".join(words)
        if "<|" not in lines and lines.count("\n") == len(words) - 1 and not self.bpe.strange(lines):  # all in one go
            found = self.bpe.find_lines(self.bpe.normal(lines))
            ends = np.append(np.flatnonzero(np.fromiter((x == "\n" for x in found), bool, len(found))), len(found))
            return [x for x in found if x != "\n"], np.diff(ends, prepend=-1) - 1
        pre, n = [], np.zeros(len(words), np.int64)
        for i, word in enumerate(words):
            before = len(pre)
            for odd, segment in enumerate(self.bpe.segments(word)):
                if odd % 2:
                    pre.append(segment)
                elif segment:
                    pre += self.bpe.pre_tokens(segment)
            n[i] = len(pre) - before
        return pre, n

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pre, n = self._cut(words)
        distinct = dict.fromkeys(pre)
        slot = dict(zip(distinct, self.parts.slots(list(distinct)).tolist()))
        take = np.fromiter(map(slot.__getitem__, pre), np.int64, len(pre))
        lengths = self.parts.lengths.data[take]
        per = np.bincount(np.repeat(np.arange(len(words)), n), lengths, len(words)).astype(np.int64)
        return self.parts.ids(take), per

    def chunks(self, texts: pa.Array, at_once: int | None = None):
        """Slices of the texts of about so many bytes: (offsets of each text's words, slots of the words)."""
        texts, at_once = pc.fill_null(texts, ""), at_once or SLICE
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(texts):
            if not self.parts.slot or len(self.words.slot) > REMEMBERED:
                self._make_room()
            stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + at_once)))
            part = texts.slice(first, stop - first)
            if pc.any(pc.match_substring_regex(part, "[\x1c-\x1f]")).as_py():  # Arrow takes these for white space
                split = [self.split(t) for t in part.to_pylist()]
                offsets = np.cumsum([0, *map(len, split)])
                flat = pa.array([w for words in split for w in words], pa.string())
            else:
                lists = pc.utf8_split_whitespace(part)
                offsets, flat = lists.offsets.to_numpy(), lists.flatten()
            coded = flat.dictionary_encode()
            yield offsets, self.words.slots(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            first = stop

    def counts(self, texts: pa.Array) -> np.ndarray:
        out = []
        for offsets, slots in self.chunks(texts):
            total = np.append(0, np.cumsum(self.words.lengths.data[slots]))
            out.append(total[offsets[1:]] - total[offsets[:-1]])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def encoded(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each slice of the texts: flat ids and the number of each text's."""
        for offsets, slots in self.chunks(texts):
            total = np.append(0, np.cumsum(self.words.lengths.data[slots]))
            yield self.words.ids(slots), total[offsets[1:]] - total[offsets[:-1]]


def count_batches(path: str):
    """A function for mapInArrow over (doc_id, n_bytes, text) that yields (doc_id, n_bytes, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TextTokens(path)
        for batch in batches:
            counts = pa.array(tokens.counts(batch.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), counts], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(lean(count_batches(path)), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
