"""Token ids in fixed-width bit-packed files, and random access to them.

File: blocks of packed ids, then an index, then its length. Every id takes the least number of bits
that holds the vocabulary; a block holds ``BLOCK`` ids (the last one fewer) and the index holds the
byte offset of each block, so any range of ids is read from its blocks alone and unpacked with a few
numpy operations. The index also lists the documents and their numbers of ids, in file order.

Documents are range-partitioned and sorted by id (nulls first; equal ids by text), so file order is
id order; the ids before a document are prefix sums over the manifest of files and inside a file.
A task writes under a name of its own attempt, and the manifest, a table that Spark commits, names
the attempts that count: lost executors and repeated tasks leave no trace in the result.

Defined cases: null text is empty, so the document holds the end id alone; null ids sort first;
repeated rows are encoded once each; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, attempt_name, give_back, lean, open_input, open_output, scratch, stored, table

BLOCK = 8192
#: Lines of words that go to the library in one call: bounds what it returns at once.
LINES = 512
MAGIC = b"FMPACK01"


def width_of(vocabulary: int) -> int:
    """Bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another, ``bits`` bits each, least significant bit first."""
    n = len(ids)
    groups = np.zeros((-(-n // 8), 8), np.uint64)
    groups.reshape(-1)[:n] = ids
    out = np.zeros((len(groups), bits), np.uint8)
    for k in range(8):
        for byte in range(k * bits // 8, ((k + 1) * bits - 1) // 8 + 1):
            shift = k * bits - 8 * byte
            moved = groups[:, k] << np.uint64(shift) if shift >= 0 else groups[:, k] >> np.uint64(-shift)
            out[:, byte] |= moved.astype(np.uint8)
    return out.tobytes()[: -(-n * bits // 8)]


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed bytes, as unsigned 32-bit integers."""
    groups = np.zeros(-(-n // 8) * bits, np.uint8)
    raw = np.frombuffer(data, np.uint8)[: len(groups)]
    groups[: len(raw)] = raw
    groups = groups.reshape(-1, bits)
    out = np.zeros((len(groups), 8), np.uint64)
    for k in range(8):
        for byte in range(k * bits // 8, ((k + 1) * bits - 1) // 8 + 1):
            shift = k * bits - 8 * byte
            part = groups[:, byte].astype(np.uint64)
            out[:, k] |= part >> np.uint64(shift) if shift >= 0 else part << np.uint64(-shift)
    return (out & np.uint64((1 << bits) - 1)).astype(np.uint32).reshape(-1)[:n]


class PackWriter:
    """Writes one file; holds one block and the index of its documents."""

    def __init__(self, path: str, bits: int):
        self.path, self.bits, self.out = path, bits, open_output(path)
        self.held, self.n_held, self.n_ids, self.at = [], 0, 0, 0
        self.offsets: list[int] = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append((doc_ids, nulls, counts))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= 64 * BLOCK:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        full = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, full, BLOCK):
            data = pack(ids[i : min(i + BLOCK, full)], self.bits)
            self.offsets.append(self.at)
            self.at += self.out.write(data)
        self.held, self.n_held = [ids[full:]], len(ids) - full

    def close(self) -> dict:
        self._blocks(True)
        parts = [np.concatenate([d[k] for d in self.docs]) if self.docs else np.zeros(0, np.int64) for k in range(3)]
        head = {"bits": self.bits, "block": BLOCK, "ids": self.n_ids, "docs": len(parts[0])}
        index = b"".join([np.array(self.offsets, "<i8").tobytes(), parts[0].astype("<i8").tobytes(), parts[1].astype("u1").tobytes(), parts[2].astype("<i8").tobytes()])
        text = json.dumps(head).encode()
        self.out.write(index + text + struct.pack("<QQ", len(index), len(text)) + MAGIC)
        self.out.close()
        return {"path": self.path, "n_ids": self.n_ids, "n_docs": len(parts[0])}


class PackReader:
    def __init__(self, path: str):
        self.file = open_input(path)
        size = self.file.size()
        self.file.seek(size - 24)
        n_index, n_head = struct.unpack("<QQ", (tail := self.file.read(24))[:16])
        if tail[16:] != MAGIC:
            raise ValueError(f"{path} is not a packed file")
        self.file.seek(size - 24 - n_head)
        head = json.loads(self.file.read(n_head))
        self.bits, self.block, self.n_ids, n = head["bits"], head["block"], head["ids"], head["docs"]
        self.file.seek(size - 24 - n_head - n_index)
        index = self.file.read(n_index)
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(index, "<i8", blocks)
        self.doc_ids = np.frombuffer(index, "<i8", n, 8 * blocks)
        self.nulls = np.frombuffer(index, "u1", n, 8 * (blocks + n))
        self.counts = np.frombuffer(index, "<i8", n, 8 * (blocks + n) + n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop - 1 of the file, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        self.file.seek(int(self.offsets[first]))
        n = min((last + 1) * self.block, self.n_ids) - first * self.block
        whole = unpack(self.file.read(-(-n * self.bits // 8)), n, self.bits)  # full blocks end on a byte
        return whole[start - first * self.block : stop - first * self.block]


def write_packed(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int = 1, ids_per_file: int = 1 << 25) -> DataFrame:
    """Encode (doc_id, text) and write it; returns the stored manifest (path, partition, part, n_ids, n_docs, before)."""
    folder, bits = scratch(docs.sparkSession, "packed"), width_of(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .wordbpe import TextTokens

        tokens, name, writer, done = TextTokens(tokenizer, library_encoder(tokenizer)), attempt_name(f"{folder}/ids"), None, []

        def close():
            done.append({"partition": TaskContext.get().partitionId(), "part": len(done)} | writer.close())

        for batch in batches:
            doc_ids = batch.column("doc_id")
            nulls = doc_ids.is_null().to_numpy(zero_copy_only=False).astype("u1")
            doc_ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
            first = 0
            for ids, counts in tokens.encoded(batch.column("text")):
                ends = np.cumsum(counts + 1)
                full = np.full(ends[-1], end_id, np.uint32)
                keep = np.ones(len(full), bool)
                keep[ends - 1] = False
                full[keep] = ids
                writer = writer or PackWriter(f"{name}-{len(done):05d}.bin", bits)
                stop = first + len(counts)
                writer.add(doc_ids[first:stop], nulls[first:stop], counts + 1, full)
                first = stop
                if writer.n_ids >= ids_per_file:
                    close()
                    writer = None
                give_back()
        if writer:
            close()
        yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("partition", pa.int64()), ("part", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    with arrow_rows(docs.sparkSession, 1000):
        files = stored(rows.mapInArrow(lean(run), "path string, partition long, part long, n_ids long, n_docs long"), "packed-files")
    order = Window.orderBy("partition", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return files.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))


def library_encoder(path: str, together: int = 64):
    """Flat ids and lengths of pre-tokens from the tokenizers library.

    Pre-tokens go in as lines of ``together`` words; the last id of a word carries the vocabulary's
    word end, which tells the words of a line apart. A line where that does not count up is encoded
    word by word.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    end = library.model.end_of_word_suffix
    last = np.zeros(library.get_vocab_size(), bool)
    last[[i for token, i in library.get_vocab().items() if end and token.endswith(end)]] = True

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lines = [words[i : i + together] for i in range(0, len(words), together)]
        ids, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # some lines a call: the library's results take many times the room of the ids
        encoded = (e for i in range(0, len(lines), LINES) for e in library.encode_batch_fast([" ".join(x) for x in lines[i : i + LINES]], add_special_tokens=False))
        for line, got in zip(lines, encoded):
            flat = np.array(got.ids, np.int64)
            stops = np.flatnonzero(last[flat]) + 1
            if len(stops) != len(line) or stops[-1] != len(flat):
                each = [e.ids for e in library.encode_batch_fast(line, add_special_tokens=False)]
                flat, stops = np.array([i for x in each for i in x], np.int64), np.cumsum([len(x) for x in each])
            ids.append(flat)
            lengths.append(np.diff(stops, prepend=0))
        return np.concatenate(ids), np.concatenate(lengths)

    return encode


def read_packed(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, unpacked from the files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, before in zip(batch["path"], batch["before"]):
                file = PackReader(path)
                ends = np.cumsum(file.counts)
                first = 0
                while first < len(ends):  # some documents at a time
                    at = int(ends[first] - file.counts[first])
                    stop = max(first + 1, int(np.searchsorted(ends, at + (1 << 20), "right")))
                    data = memoryview(file.ids(at, int(ends[stop - 1])).astype("<u4").tobytes())
                    cuts = [0, *((ends[first:stop] - at) * 4).tolist()]
                    crc = np.fromiter((zlib.crc32(data[a:b]) for a, b in zip(cuts, cuts[1:])), np.int64, stop - first)
                    ids = pd.array(file.doc_ids[first:stop].copy(), "Int64")
                    ids[file.nulls[first:stop] == 1] = pd.NA
                    counts = file.counts[first:stop]
                    yield pd.DataFrame({"doc_id": ids, "start": before + ends[first:stop] - counts, "n_tokens": counts, "ids_crc32": crc})
                    first = stop

    n = manifest.count()
    return manifest.select("path", "before").repartition(max(1, n), "path").mapInPandas(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_pack(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def packed_digest(docs: DataFrame, tokenizer: str, vocabulary: int = 49408) -> DataFrame:
    """Write all documents and read them back."""
    return read_packed(stored(write_packed(docs, tokenizer, vocabulary), "packed-manifest"))
