"""WARC archives with a shared Zstandard dictionary.

A dictionary is trained on a bounded sample of the records' payloads. Every archive starts with a
skippable frame that holds the dictionary, then holds one Zstandard frame per record, compressed
with it, so any record can be read alone, given its offset.

Of records with equal payloads the one with the largest page id is a ``response``; the others are
``revisit`` records that name it and carry no payload. Tasks write under the name of their own
attempt, in a file system that pyarrow knows, and a manifest that Spark commits names the files that
count, so lost executors and repeated tasks leave no trace in the result.

Defined cases: null html is the empty payload; a payload shared by no other page, and payloads
smaller than ``least_bytes``, are responses; null page ids rank below all others, and rows that
repeat the largest page id (or have no id at all) are all responses; an empty table gives no archive
and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attempt_name, lean, open_input, open_output, scratch, small, stored, table

#: The skippable frame of a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{payload_digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, place: str = "") -> bytes:
    """One WARC/1.1 record; a revisit has the head of the response only.

    A response's id follows from its page and payload, so that revisits can name it; a revisit's, or that of a page without id, follows from
    its ``place`` in the archives too, as a row may come again.
    """
    mark = digest(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(page_id, f"{mark}:{place}" if kind == "revisit" or page_id is None else mark),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": "".join((url or "about:blank").split()),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{mark}",
        "X-Page-Id": "" if page_id is None else str(page_id),
    }
    if kind == "revisit":
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to, mark), "X-Refers-To-Page-Id": str(refers_to)}
    else:
        block += payload
    fields["Content-Length"] = str(len(block))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def facts(record: bytes) -> dict:
    """What a record says of its page, the digest computed anew where the payload is there."""
    fields, block = parsed(record)
    head, _, payload = block.partition(b"\r\n\r\n")
    number = lambda v: int(v) if v else None
    kind = fields["WARC-Type"]
    size = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
    mark = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (digest(payload) != mark or len(payload) != size):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {"page_id": number(fields["X-Page-Id"]), "payload_bytes": size, "payload_digest": mark, "record_type": kind, "refers_to": number(fields.get("X-Refers-To-Page-Id", "")), "url": fields["WARC-Target-URI"]}


def trained_dictionary(pages: DataFrame, samples: int = 400, sample_chars: int = 20_000, size: int = 64 << 10) -> bytes:
    """A dictionary from at most ``samples`` records in the order of a hash, each cut to ``sample_chars``
    for this purpose only; empty where there is too little to learn from."""
    import zstandard

    cells = 1 << 20  # only a share of the rows, about four times as many as wanted, is put in order
    some = F.pmod(F.xxhash64("page_id", "url"), F.lit(cells)) < max(1, 4 * samples * cells // max(1, pages.count()))
    rows = pages.filter(some).select("page_id", "url", F.substring(F.coalesce("html", F.lit("")), 1, sample_chars).alias("html"))
    rows = rows.orderBy(F.xxhash64("page_id", "url"), "page_id", "html").limit(samples).collect()
    data = [record_bytes(r["page_id"], r["url"], r["html"].encode(), "response", None) for r in rows]
    if len(data) < 8:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, data)) // 8)), data).as_bytes()
    except zstandard.ZstdError:  # e.g. all samples alike
        return b""


class ArchiveWriter:
    """One archive: the dictionary's frame, then a frame per record."""

    def __init__(self, path: str, dictionary: bytes, level: int = 3):
        import zstandard

        self.path, self.out, self.bytes, self.records = path, open_output(path), 0, 0
        if dictionary:
            self._write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, record: bytes) -> None:
        self._write(self.compressor.compress(record))
        self.records += 1

    def close(self) -> dict:
        self.out.close()
        return {"path": self.path, "bytes": self.bytes, "records": self.records}


def read_archive(path: str) -> Iterator[bytes]:
    """The records of an archive, one after another; the dictionary comes from its first frame."""
    import zstandard

    with open_input(path) as file:
        head = file.read(8)
        dictionary = b""
        if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_MAGIC:
            dictionary = file.read(struct.unpack("<II", head)[1])
            rest = b""
        else:
            rest = head
        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        while True:  # frame by frame
            one, out = opener.decompressobj(), io.BytesIO()
            while not one.eof:
                data = rest or file.read(1 << 18)
                if not data:
                    break
                out.write(one.decompress(data))
                rest = b""
            if not one.eof:
                if out.tell():
                    raise ValueError(f"{path} ends inside a record")
                return
            rest = one.unused_data
            yield out.getvalue()


def record_plan(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to (null for responses)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("mark", F.sha2("html", 256))
    groups = rows.filter(F.octet_length("html") >= least_bytes).groupBy("mark").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    groups = stored(groups.filter((F.col("n") > 1) & F.col("first").isNotNull()).select("mark", "first"), "repeated-payloads")
    joined = rows.join(small(groups), "mark", "left")  # few repeated payloads: no page is shuffled
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, least_bytes: int = 0, file_bytes: int = 256 << 20) -> DataFrame:
    """Write all pages; returns the stored manifest (path, bytes, records)."""
    folder, dictionary = scratch(pages.sparkSession, "warc"), trained_dictionary(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, writer, done = attempt_name(f"{folder}/pages"), None, []
        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                writer = writer or ArchiveWriter(f"{name}-{len(done):05d}.warc.zst", dictionary)
                to = refers.as_py()
                writer.add(record_bytes(page_id.as_py(), url.as_py(), html.as_py().encode(), "response" if to is None else "revisit", to, f"{writer.path}:{writer.records}"))
                if writer.bytes >= file_bytes:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return stored(record_plan(pages, least_bytes).mapInArrow(lean(run), "path string, bytes long, records long"), "warc-files")


def read_archives(manifest: DataFrame, at_once: int = 4096) -> DataFrame:
    """One row per record of the archives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows):
            out = pd.DataFrame(rows)
            return out.astype({"page_id": "Int64", "refers_to": "Int64"})

        rows: list[dict] = []
        for batch in batches:
            for path in batch["path"]:
                for record in read_archive(path):
                    rows.append(facts(record))
                    if len(rows) >= at_once:
                        yield frame(rows)
                        rows = []
        if rows:
            yield frame(rows)

    n = manifest.count()
    return manifest.select("path").repartition(max(1, n), "path").mapInPandas(run, RECORDS)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages")))
