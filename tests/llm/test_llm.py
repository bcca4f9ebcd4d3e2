"""Training-data operators against brute force, round trips, libraries and held-out labels; odd inputs."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facetmill.llm import decontaminate, hnsw_dedup, html_extract, jaccard_join, mixing, quality_rules, token_pack, toxicity, warc, wordbpe
from facetmill.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7), (None, "one two", None, "b", None), (5, "word " * 30000, "en", None, 1), (6, "x" * 100000, "en", "b", 1), (7, "one two", "en", "a", 7)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_warc(spark):
    rows = [(1, "u", "a"), (2, "u", "a"), (3, None, None), (None, "x y", "a"), (5, "u", ""), (6, "u", "b" * 200000), (6, "u", "b" * 200000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(pages)).collect()}
    d = lambda t: warc.digest(t.encode())
    assert got == {(1, 1, d("a"), "revisit", 2), (2, 1, d("a"), "response", None), (None, 1, d("a"), "revisit", 2), (3, 0, d(""), "revisit", 5), (5, 0, d(""), "response", None), (6, 200000, d("b" * 200000), "response", None)}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_round_trip_with_dictionary(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    assert warc.trained_dictionary(pages)
    back = {r.page_id: r.payload_digest for r in warc.read_archives(warc.write_archives(pages)).collect()}
    assert back == {r.page_id: warc.digest((r.html or "").encode()) for r in pages.collect()}


def test_html():
    page = "<body><nav><ul><li><a href=/>Home</a></ul></nav><div class=cookie-notice><p>We use cookies, a long notice of many words here.</p></div><article><h1>Title</h1><p>First&nbsp;one &amp; more.<br>Same block.<p>Short.</article><aside><p>Side words of some length</p></aside><section id=comments><p>I think so too, really, very much.</p></section><footer>&copy; x</footer><script>var a='<p>no</p>'</script>"
    assert html_extract.main_text(page) == "Title\n\nFirst one & more. Same block.\n\nShort."
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p></p>") == ""
    assert html_extract.main_text("<b>just text") == "just text"
    assert html_extract.main_text("<div>" * 3000 + "deep") == "deep"


@pytest.mark.parametrize("wrapper", ["div class='content has-sidebar'", "div id='sidebar-right-layout'", "div class=widget", "form action=/"])
def test_html_wrappers_keep_the_article(wrapper):
    text, tag = " ".join(["word"] * 40), wrapper.split()[0]
    aside = "<nav><a href=/>Home</a></nav><div class=sidebar><a href=/a>Other page</a></div><section id=comments><p>I think so too.</p></section>"
    article = f"<h1>Title</h1><p>{text}</p><section id=related-work><p>Work.</p></section><section id=legal-form><h2 id=how-to-search>How</h2><p>{text}</p></section>"
    assert html_extract.main_text(f"<body><{wrapper}><article>{article}</article>{aside}</{tag}></body>") == f"Title\n\n{text}\n\nWork.\n\nHow\n\n{text}"
    assert html_extract.main_text(f"<body><{wrapper}><h1>Title</h1><p>{text}</p>{aside}</{tag}></body>") == f"Title\n\n{text}"


def test_min_cut_is_minimal():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n = 7
        costs = rng.integers(-9, 10, n).tolist()
        edges = [(a, b, int(rng.integers(0, 7))) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cut = lambda s: sum(max(0, c) if x else max(0, -c) for c, x in zip(costs, s)) + sum(w for a, b, w in edges if s[a] != s[b])
        assert cut(html_extract.min_cut(costs, edges)) == min(cut(s) for s in itertools.product((False, True), repeat=n))


def test_quality(spark, sf_dir, odd, none):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    rows = quality_rules.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out and quality is not null").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    out = quality_rules.quality_scores(odd, labels).collect()
    assert len(out) == 8 and all(0 <= r.score <= 1 for r in out)
    assert quality_rules.quality_scores(none, labels).count() == 0
    assert all(r.score == 0.5 for r in quality_rules.quality_scores(odd, labels.limit(0)).collect())


def test_recurrent_gradients():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in toxicity.initial(rng).items()}
    f = toxicity.Features.of(["alpha", "beta", "gamma", "x"])
    p["table"][f.cells] = rng.normal(0, 0.5, (len(f.cells), toxicity.DIM))
    slots, n = rng.integers(0, 4, (toxicity.SPAN, 3)), np.array([24, 5, 1])
    mask, y = (np.arange(toxicity.SPAN)[:, None] < n).astype(np.float64), np.array([1.0, 0.0, 1.0])

    def loss():
        x = f.vectors(p["table"])
        z = toxicity.forward(p, x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"], slots, mask)[0]
        return np.mean(np.log1p(np.exp(z)) - y * z)

    g = toxicity.gradients(p, f, slots, mask, y, np.ones(toxicity.CELLS, bool), np.ones(len(f.cells)))
    for k in ("out", "att", "gf", "cb", "wf", "bb"):
        i = tuple(rng.integers(0, s) for s in p[k].shape)
        old, eps = p[k][i], 1e-3
        p[k][i] = old + eps
        up = loss()
        p[k][i] = old - eps
        down = loss()
        p[k][i] = old
        assert abs((up - down) / (2 * eps) - g[k][i]) < 2e-3, k


def test_toxicity_learns_word_families(spark, odd, none):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("aeioutnrs"), 4)) for _ in range(300)]
    texts, y = [], []
    for i in range(400):
        w = rng.choice(words, 60).tolist()
        if i % 5 == 0:
            for k in rng.integers(0, 60, 3):
                w[k] = "vequ" + str(rng.choice(words))[:2]
        texts.append(" ".join(w))
        y.append(int(i % 5 == 0))
    model = toxicity.fitted(texts[:300], np.array(y[:300]))
    s = toxicity.Scorer(model).scores(pa.array(texts[300:]))
    assert np.mean((s >= 0.5) == np.array(y[300:])) > 0.9
    out = toxicity.with_score(odd, model, 0.1).collect()
    assert len(out) == 8 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.with_score(none, model, 0.1).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(odd, labels).collect()} == {0.0}


def test_vectors(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(40, 16))
    x = [(centre[i % 40] + rng.normal(0, 0.02 * (i % 3), 16)) for i in range(400)]
    rows = [(i, [float(v) for v in np.float32(x[i])], i % 2) for i in range(400)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, rows[0][1], None), (904, rows[0][1][:5], 0), (905, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in hnsw_dedup.similar_vectors(df, shard=64, block=50).collect()}
    ok = [r for r in rows if r[1] and len(r[1]) == 16 and r[2] is not None and np.isfinite(r[1]).all() and any(r[1])]
    m = np.array([r[1] for r in ok])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    link = (m @ m.T >= 0.93) & (np.array([r[2] for r in ok])[:, None] == np.array([r[2] for r in ok])[None])
    np.fill_diagonal(link, False)
    assert [got[r[0]].n_links for r in ok] == link.sum(1).tolist()
    comp = np.array([r[0] for r in ok])
    for _ in range(50):
        comp = np.minimum(comp, np.where(link, comp[None], 10**9).min(1))
    assert [got[r[0]].component_id for r in ok] == comp.tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904)) and got[905].component_id == 0
    assert hnsw_dedup.similar_vectors(df.limit(0)).count() == 0


def test_token_counts(tokenizer, spark, odd, none):
    from tokenizers import Tokenizer

    library, bpe = Tokenizer.from_file(tokenizer), wordbpe.TextTokens(tokenizer)
    rng = np.random.default_rng(0)
    texts = ["", "  ", "aaaaaaa", "<|endoftext|>x <|startoftext|>", "Σας ΟΔΟΣ İ", "a\x1cb\x85c\xa0d", "'S'll don't", "x" * 5000, "՘ new", *("".join(rng.choice(list("abcdeéöA !?$*1'")) for _ in range(60)) for _ in range(200))]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert bpe.counts(pa.array(texts)).tolist() == [len(w) for w in want]
    ids, n = next(iter(wordbpe.TextTokens(tokenizer, token_pack.library_encoder(tokenizer)).encoded(pa.array(texts))))
    assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]
    out = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in wordbpe.token_counts(odd, tokenizer).collect()}
    assert (1, 0, 0, False) in out and (3, 7, 2, False) in out and (5, 150000, 30000, True) in out
    assert wordbpe.token_counts(none, tokenizer).count() == 0


def test_packing(tokenizer, spark, odd, none):
    rng = np.random.default_rng(0)
    for bits in (1, 3, 8, 15, 16, 17, 31):
        for n in (0, 1, 7, 8, 1001):
            x = rng.integers(0, 1 << bits, n)
            assert (token_pack.unpack(token_pack.pack(x, bits), n, bits) == x).all()
    rows = token_pack.packed_digest(odd, tokenizer).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 3, 5, 6, 7]
    assert rows[1].n_tokens == 1 and rows[1].ids_crc32 == zlib.crc32(np.array([1], "<u4").tobytes())
    assert [r.start for r in rows] == np.append(0, np.cumsum([r.n_tokens for r in rows])[:-1]).tolist()
    path = token_pack.write_packed(odd, tokenizer, 49408).first()["path"]
    file = token_pack.PackReader(path)
    whole = file.ids(0, file.n_ids)
    assert (file.ids(2, min(9, file.n_ids)) == whole[2:9]).all()
    assert token_pack.packed_digest(none, tokenizer).count() == 0


def test_near_copies(spark, odd, none):
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocabulary, 120).tolist() for _ in range(12)]
    docs = []
    for i in range(260):
        w = list(base[i % 12 if i < 60 else 0])
        for k in rng.integers(0, 120, i % 4):
            w[k] = str(rng.choice(vocabulary))
        docs.append((i, " ".join(w)))
    got = {r.doc_id: r for r in jaccard_join.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), leaf=16).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for _, t in docs]
    link = np.array([[i != j and len(a & b) / len(a | b) >= 0.8 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    found = np.array([got[i].n_links for i in range(260)])
    assert found.sum() >= 0.98 * link.sum() and (found <= link.sum(1)).all()
    comp = np.arange(260)
    for _ in range(60):
        comp = np.minimum(comp, np.where(link, comp[None], 10**9).min(1))
    assert [got[i].class_id for i in range(260)] == comp.tolist()
    out = sorted(((r.doc_id, r.class_id) for r in jaccard_join.near_copies(odd).collect()), key=str)
    assert out.count((3, 3)) == 2 and (7, 3) in out and (None, None) in out and (1, 1) in out
    assert jaccard_join.near_copies(none).count() == 0
    assert sorted(r.doc_id or 0 for r in jaccard_join.without_near_copies(odd).collect()) == [0, 1, 2, 3, 5, 6]


def test_near_copies_on_the_last_level(spark):
    # every text is 10 of 25 passages, so buckets stay large but no half stays together; each has a copy at the threshold
    rng = np.random.default_rng(3)
    passages = [[f"p{p}w{i}" for i in range(20)] for p in range(25)]
    docs = []
    for i in range(300):
        w = sum((passages[p] for p in rng.permutation(25)[:10]), [])
        docs += [list(w), list(w)]
        for k in (10, 60, 110, 160):
            docs[-1][k] = f"x{i}"
        docs[-1][0] = f"x{i}"
    sets = [{tuple(w[k : k + 5]) for k in range(196)} for w in docs]
    near = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 600, 2)]
    assert all(0.8 <= s < 0.81 for s in near)
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in jaccard_join.near_copies(rows, leaf=8).collect()}
    assert 1 - (1 - (1 - np.exp(-1)) ** jaccard_join.LEVELS) ** jaccard_join.runs_for(0.99) >= 0.99
    assert np.mean([got[i] == got[i + 1] for i in range(0, 600, 2)]) >= 0.99


def test_decontamination(spark, odd, none):
    item = "the quick brown fox jumps over a lazy dog near the old river bank today"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny item here")], "item_id long, text string")
    changed = item.replace("jumps", "leaps").replace("river", "stream")
    texts = ["some words before " + changed.upper() + " and after", "nothing of the kind is said in this text at all", "it says: tiny, item here!", None, "tiny item there"]
    docs = spark.createDataFrame([(i, t, "junk") for i, t in enumerate(texts)], "doc_id long, text string, overlaps_ string")
    rows = decontaminate.with_overlaps(docs, bench).collect()
    assert [[o.item_id for o in r.overlaps] for r in sorted(rows, key=lambda r: r.doc_id)] == [[1], [], [4], [], []]
    assert sorted(r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()) == [1, 3, 4]
    assert decontaminate.decontaminated(odd, bench.limit(0)).count() == 8 and decontaminate.decontaminated(none, bench).count() == 0


def test_masks_tolerate_substitutions():
    for n, k in ((11, 2), (14, 2), (16, 3)):
        for hit in itertools.combinations(range(n), k):
            assert any(not any(p + o in hit for o in decontaminate.offsets_of(m)) for m in decontaminate.MASKS for p in range(n - len(m) + 1))


def test_short_items_with_replaced_words():
    for n, k in ((11, 1), (12, 2), *((n, k) for n in range(15, 26) for k in (2, 3)), (20, 4), (21, 4)):
        item = [f"w{i}" for i in range(n)]
        index = decontaminate.SeedIndex([(1, " ".join(item))])
        hits = list(itertools.combinations(range(n), k))
        found = index.overlaps(pa.array(["before it " + " ".join("x" if i in hit else w for i, w in enumerate(item)) + " after it" for hit in hits]))
        for hit, rows in zip(hits, found):
            equal = np.append(0, np.cumsum([i not in hit for i in range(n)])).tolist()
            best = max(equal[b] - equal[a] for a, b in itertools.combinations(range(n + 1), 2) if equal[b] - equal[a] >= 0.8 * (b - a))
            assert [r["matched"] for r in rows] == [best] and best >= max(10, 0.8 * rows[0]["words"]), (n, hit)
    index = decontaminate.SeedIndex([(1, " ".join(f"w{i}" for i in range(15)))])
    assert index.overlaps(pa.array([" ".join("x" if i in (2, 5, 8, 11) else f"w{i}" for i in range(15))])) == [[]]


def test_mixing(spark, odd, none, sf_dir):
    out = mixing.mix_sources(table(spark, sf_dir, "documents")).toPandas()
    per = out.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (per["size"] == per["source_size"]).all() and ((per["taken"] - per["target"]).abs() <= 1).all()
    assert (out["taken"] <= 2 * out["size"]).all() and abs(per["target"].sum() - 1.5 * per["size"].sum()) < 1e-6
    again = mixing.mix_sources(table(spark, sf_dir, "documents").repartition(7)).toPandas()
    assert sorted(out[["doc_id", "taken"]].itertuples(index=False)) == sorted(again[["doc_id", "taken"]].itertuples(index=False))
    assert mixing.mix_sources(odd).count() == 8 and mixing.mix_sources(none).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "mixing", "token_ids"]
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
