"""Repeated ids, clashing column names, brute force on whole tables, stages of the pipeline on odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facetmill.llm import components, decontaminate, hnsw_dedup, html_extract, jaccard_join, mixing, quality_rules, token_pack, toxicity, warc, wordbpe
from facetmill.llm.common import file_system, free_name, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7), (3, "another text of the same id", "en", "a", 7), (None, "one two", None, "b", None), (7, "one two", "en", "a", 7), (8, "word " * 30000, "en", "b", 1)]
    return spark.createDataFrame(rows, DOCS)


def test_vectors_with_repeated_ids(spark):
    """An id may come again under another label or with another vector: links and components stay apart."""
    a, b, far = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, a, 0), (2, b, 0), (1, a, 1), (9, b, 1), (1, far, 0), (5, far, 0), (5, far, 0)]
    got = sorted(tuple(r) for r in hnsw_dedup.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (1, 1, 1, True), (9, 1, 1, False), (1, 2, 1, True), (5, 2, 1, False), (5, 2, 1, False)])


def test_components_need_an_end(spark):
    chain = spark.range(40).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.component for r in components.components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        components.components(chain, rounds=1)


def test_repeated_payloads(spark):
    pages = spark.createDataFrame([(i, "u", "same" if i % 3 else None) for i in range(300)], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(pages)).collect()
    assert len(got) == 300
    for r in got:
        last = 299 if r.page_id % 3 else 297
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == last else ("revisit", last))


def test_pages_through_spark(spark):
    page = "<article><p>Words of an article, enough of them to count.</p></article>"
    pages = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, None), (None, "u", "", "y")], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_extract.extracted(pages).collect()), key=str)
    want = "Words of an article, enough of them to count."
    assert got == sorted([(1, want, len(want)), (1, want, len(want)), (2, "", 0), (None, "", 0)], key=str)
    assert html_extract.extracted(pages.limit(0)).count() == 0


def test_deep_pages_stay_cheap():
    import time

    began = time.process_time()
    html_extract.main_text("<b><div>x</div>" * 20000)
    assert time.process_time() - began < 10


def test_clashing_columns(spark, odd):
    names = ["toxicity", "Overlaps", "mark", "mixed", "copies", "row", "id", "score", "_label", "key", "cid"]
    docs = odd.withColumns({n: F.lit("mine") for n in names})
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "another text of the same id")], "item_id long, text string")
    assert free_name(docs, "toxicity") == "toxicity_"
    for out in (toxicity.without_toxic(docs, labels), jaccard_join.without_near_copies(docs), decontaminate.decontaminated(docs, bench), mixing.mixed_documents(docs)):
        assert out.columns == docs.columns
        assert {v for r in out.select(*names).collect() for v in r} == {"mine"}
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    for out in (toxicity.toxicity_scores(docs, labels), quality_rules.quality_scores(docs, labels), jaccard_join.near_copies(docs), wordbpe.token_counts(docs, path), token_pack.packed_digest(docs, path), mixing.mix_sources(docs)):
        assert out.count() == 8
    with pytest.raises(ValueError):
        decontaminate.with_overlaps(docs, bench)


def test_other_texts_of_an_id_stay(odd):
    got = sorted(((r.doc_id, r.text) for r in jaccard_join.without_near_copies(odd).filter("doc_id = 3 or doc_id = 7 or doc_id is null").collect()), key=str)
    assert got == sorted([(3, "one two"), (3, "another text of the same id"), (None, "one two")], key=str)


def test_decontamination_by_brute_force(spark, sf_dir):
    """Every item along every diagonal of every text; copies of texts are judged once."""
    docs, bench = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = {(r.doc_id, o.item_id): o.matched for r in decontaminate.with_overlaps(docs, bench).collect() for o in r.overlaps}
    vocabulary: dict[str, int] = {}
    words = lambda t: np.array([vocabulary.setdefault(w, len(vocabulary)) for w in decontaminate.word_lists(pa.array([t]))[0].as_py() if w], np.int64)
    items = [(r.item_id, words(r.text)) for r in bench.collect()]
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    for doc_id, text in texts.items():
        known = set(text.tolist())
        for item_id, item in items:
            if sum(w in known for w in item.tolist()) < min(10, len(item)):
                assert (doc_id, item_id) not in found
                continue
            best = 0
            for d in range(1 - len(item), len(text)):
                lo, hi = max(0, d), min(len(text), d + len(item))
                equal = np.append(0, np.cumsum(text[lo:hi] == item[lo - d : hi - d]))
                if equal[-1] < max(min(10, len(item)), best + 1):
                    continue
                n = equal[None, :] - equal[:, None]
                length = np.arange(len(equal))[None, :] - np.arange(len(equal))[:, None]
                best = max(best, int(n[(n >= 0.8 * length - 1e-9) & (length > 0)].max(initial=0)))
            assert found.get((doc_id, item_id), 0) == (best if best >= min(10, len(item)) else 0), (doc_id, item_id)


def test_packed_ids_equal_the_library(spark, sf_dir):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    library, docs = Tokenizer.from_file(path), table(spark, sf_dir, "documents").select("doc_id", "text")
    at = 0
    for r in sorted(token_pack.packed_digest(docs, path).join(docs, "doc_id").collect(), key=lambda r: r.doc_id):
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_words_are_forgotten_rightly(monkeypatch):
    """A worker that keeps forgetting gives the same counts."""
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rng = np.random.default_rng(1)
    texts = pa.array([" ".join(f"w{k}x" for k in rng.integers(0, 900, 200)) for _ in range(60)])
    want = wordbpe.TextTokens(path).counts(texts)
    monkeypatch.setattr(wordbpe, "REMEMBERED", 200)
    monkeypatch.setattr(wordbpe, "SLICE", 3000)
    assert (wordbpe.TextTokens(path).counts(texts) == want).all()


def test_stages_on_odd_rows(spark, odd, sf_dir):
    import corpus_pipeline

    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.columns == (docs.columns if name != "token_ids" else ["doc_id", "start", "n_tokens", "ids_crc32"])
            n = out.count()
            assert n >= {"toxicity": 1, "near_copies": 6, "decontamination": 8, "mixing": 1, "token_ids": 8}[name] * bool(docs.count())


def test_file_systems():
    from pyarrow import fs

    for path in ("file:///a/b", "file:/a/b", "/a/b"):
        store, at = file_system(path)
        assert isinstance(store, fs.LocalFileSystem) and at == "/a/b"
