import time
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import plain
import pytest
import zstandard

from zephyria.llm import block_lstm, html_extract, html_parse, quality_cnn, quality_rules
from zephyria.llm.common import table


def test_base_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    extra = [(-1, None), (-2, ""), (-3, " \t\n"), (-4, "a b c d e f g h " * 40), (-5, "x\nx\n \nx y\r\nx"), (-6, "one\x0b\x0ctwo")]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    zstd = zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    for r in quality_rules.quality_rules(docs).collect():
        counts = plain.base_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        data = (r.text or "").encode()
        if data:
            assert r.zstd_ratio == len(data) / len(zstd.compress(data))
        assert not (r.base_failed and r.kept)


def test_rules_keep_good_and_reject_bad(spark, sf_dir):
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    docs = table(spark, "/root/testdata/sf0.01", "documents").join(labels, "doc_id")
    judged = quality_rules.quality_rules(docs).where("not base_failed").groupBy("quality").pivot("kept", [False, True]).count().fillna(0).collect()
    good = next(r for r in judged if r.quality == 1)
    assert good["false"] == 0 and good["true"] > 200
    noise = np.random.default_rng(1).integers(33, 0x2FF, 4000)
    incompressible = "".join(chr(c) + (" " if i % 7 == 0 else "") for i, c in enumerate(noise))
    varied = " ".join(["alpha beta gamma delta %d" % (i % 7) for i in range(400)])
    df = spark.createDataFrame([(1, incompressible), (2, varied)], "doc_id long, text string")
    assert not any(r.kept for r in quality_rules.quality_rules(df).collect())


def test_rules_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "w " * 30, "x", 2.0)], "doc_id long, text string, row string, kept double")
    out = quality_rules.quality_rules(df)
    assert out.columns[:3] == ["doc_id", "text", "row"] and out.schema["kept"].dataType.simpleString() == "boolean"
    assert quality_rules.keep_good(df).columns == df.columns
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


# ---------------------------------------------------------------- byte network


def test_chunks_cover_every_byte():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        data = bytes(i % 251 for i in range(n))
        chunks, step = quality_cnn.chunks_of(data), quality_cnn.CHUNK - quality_cnn.OVERLAP
        back = np.full(step * (len(chunks) - 1) + quality_cnn.CHUNK, quality_cnn.PAD)
        for i, c in enumerate(chunks):
            back[i * step : i * step + quality_cnn.CHUNK] = c
        assert bytes(back[:n].astype(np.uint8)) == data and (back[n:] == quality_cnn.PAD).all()


def numeric(loss, w, spots, eps=1e-2):
    for at in spots:
        old = w[at]
        w[at] = old + eps
        up = loss()
        w[at] = old - eps
        down = loss()
        w[at] = old
        yield (up - down) / (2 * eps)


def test_network_gradients():
    rng, net = np.random.default_rng(2), quality_cnn.ByteNet(seed=3)
    texts = [quality_cnn.chunks_of(bytes(rng.integers(32, 120, n).astype(np.uint8))) for n in (40, 700, 1500)]
    labels = np.array([1, 0, 1], np.float32)

    def loss():
        p = net._scores(texts)
        return float(-np.mean(np.log(np.where(labels == 1, p, 1 - p))))

    got = net.gradients(texts, labels)
    for name, spots in (("out", [(0,), (5,), (30,)]), ("bias", [(0,)]), ("shift", [(1,), (7,)])):
        for at, want in zip(spots, numeric(loss, net.w[name], spots)):
            assert got[name][at] == pytest.approx(want, abs=2e-3)


def test_quality_of_held_out_rows(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    out = quality_cnn.quality_scores(docs.select("doc_id", "text"), labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    good = [r.score for r in out if r.held_out and truth.get(r.doc_id) == 1]
    bad = [r.score for r in out if r.held_out and truth.get(r.doc_id) == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_fit_takes_long_texts_whole_and_repeated_ids_within_the_bound(spark, monkeypatch):
    """The only sign of a bad text is far inside it; one id has many rows."""
    monkeypatch.setattr(quality_cnn, "GRADIENT_CHUNKS", 16)
    filler = "plain words of some text " * 1000
    docs = [(i, filler[: 12_000] + ("#%$@" * 120 if i % 2 else " calm " * 80) + filler[: 11_000]) for i in range(0, 60)]
    docs += [(docs[3][0], docs[3][1])] * 200
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: r for r in quality_cnn.quality_scores(df, labels, per_class=20).collect()}
    assert sum(r.predicted == 1 - d % 2 for d, r in out.items() if r.held_out) >= 0.9 * sum(r.held_out for r in out.values())


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_cnn.quality_scores(docs, none).collect()
    assert [r.score for r in out] == [0.5, 0.5] and not any(r.held_out for r in out if r.doc_id is None)
    assert quality_cnn.quality_scores(docs.limit(0), none).count() == 0


# ---------------------------------------------------------------- pages

STORY = "This is a paragraph of a story about rivers, and it goes on for a while."


def test_blocks():
    page = '<p>a <b>b</b>c&amp;d&nbsp; e<br>f<p class="X y">g<!-- <p>no --><script>"</p>"</script>h<td title=">">i</td> 1 < 2 <li><a href=x>j</a>k'
    got = html_parse.blocks(page)
    assert [b.text for b in got] == ["a bc&d e", "f", "gh", "i", "1 < 2", "jk"]
    assert got[2].path.elements() == (("p", "x", "y"),) and got[5].link_chars == 1
    assert html_parse.blocks("") == [] and html_parse.blocks("<!-- open") == [] and html_parse.blocks("<script>x") == []


def test_formulas_and_elements_without_an_end():
    texts = lambda page: [b.text for b in html_parse.blocks(page)]
    page = "<p>so <math><mrow><mi>x</mi><mo>=</mo></mrow><mn>2</mn><annotation>x=2</annotation></math> holds</p><p>b</p>"
    assert texts(page) == ["so x=2 holds", "b"]
    assert [b.path.elements() for b in html_parse.blocks(page)] == [(("p",),), (("p",),)]
    for tag in sorted(html_parse.QUIET):
        assert texts(f"<article><p>a</p><{tag} class=k><p>b</p><p>c</p></article>") == ["a", "b", "c"]
        assert texts(f"<div>a<{tag}>b</div><p>c</p><{tag}></{tag}><p>d</p>") == ["ab", "c", "d"]
        assert texts(f"<p>a</{tag}>b</p><p>c<{tag}/>d</p>") == ["ab", "cd"]
        if tag != "math":
            assert texts(f"<p>a <{tag}><b>no</b><{tag}>no</{tag}><i>no</{tag}>b</p><p>c</p>") == ["a b", "c"]
            assert texts(f"<div>a <{tag}>no</div><p>c</p></{tag}>d") == ["a", "c", "d"]
    assert texts("<p>a<svg><script>'</svg>'</script>no</svg>b</p>") == ["ab"]
    assert texts("<p>a</p><script>b<p>c</p>") == ["a"]


def test_labeller_gradients():
    rng, net = np.random.default_rng(1), block_lstm.BlockLSTM(seed=2)
    page = html_parse.blocks(f"<nav>menu</nav><article><h1>t</h1><p>{STORY}</article><footer>end</footer>")
    features, labels = [block_lstm.PageFeatures(page), block_lstm.PageFeatures(page[:2])], [np.array([0, 1, 1, 0]), np.array([0, 1])]
    block_lstm.WORDS_OUT, before = 0.0, block_lstm.WORDS_OUT

    def loss():
        _, score, _ = net._forward([net.vectors(p) for p in features], False)
        return float(np.mean([-np.mean(np.log(np.where(y == 1, score[: len(y), b], 1 - score[: len(y), b]))) for b, y in enumerate(labels)]))

    try:
        got = net.gradients(features, labels, rng)
        for name, spots in (("out", [(0,), (45,)]), ("ahead", [(3, 5), (60, 70)]), ("back", [(50, 10), (10, 75)]), ("embedding", [(int(features[0].ids[0]), 2)])):
            for at, want in zip(spots, numeric(loss, net.w[name], spots)):
                assert got[name][at] == pytest.approx(want, abs=2e-3)
    finally:
        block_lstm.WORDS_OUT = before


def test_pages_of_the_table_and_others(spark, sf_dir):
    """Articles of the table exactly, and of pages laid out in ways the table has not."""
    import html
    import re

    pages = table(spark, sf_dir, "pages")
    others = [
        (-1, f"<body><header><h1>Site</h1></header><nav><a>Home</a></nav><main><article><h1>Head</h1><p>{STORY}</p></article><section id=comments><h3>Comments</h3><p>{STORY} I say</p></section></main><aside class=sidebar><h3>Related</h3><ul><li><a>One</a></ul></aside><form><label>Mail</label></form><footer>c</footer>", f"Head {STORY}"),
        (-2, f"<body><div class='cookie-notice'>We use cookies</div><div class=menu><ul><li><a>Home</a></ul></div><div class=content><h1>Head</h1><p>{STORY}<p>{STORY}<div class=advert>Buy</div><p>Last.</div><div class=comments><div class=comment>{STORY}</div></div><div class=footer>All</div>", f"Head {STORY} {STORY} Last."),
        (-3, None, ""),
        (-4, "", ""),
        (-5, "<script>x</script><style>y</style>", ""),
    ]
    more = spark.createDataFrame([(i, "u", h) for i, h, _ in others], pages.schema)
    out = {r.page_id: r for r in html_extract.extract_main(pages.unionByName(more)).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner.replace("<b>", "").replace("</b>", ""))).split())
        assert out[r.page_id].text == want
    for i, _, want in others:
        assert out[i].text == want and out[i].n_chars == len(want)


def test_pages_empty_and_clashing(spark):
    df = spark.createDataFrame([(1, None, "t", 5)], "page_id long, html string, text string, row long")
    row = html_extract.extract_main(df).collect()[0]
    assert (row.text, row["row"], row.n_chars) == ("", 5, 0)
    assert html_extract.extract_main(df.limit(0)).count() == 0


#: 1 MB each: deep nesting, tags without an end, short blocks, inline elements and quotes left open.
LONG = {
    "deep": ("<div>x" * 170_000, 170_000),
    "tags without an end": ("<a " * 350_000, 0),
    "short blocks": ("<p>x" * 250_000, 250_000),
    "inline": ("x<span>" * 150_000, 150_000),
    "open quotes": ('<a "' * 250_001 + ">x", 0),
    "broken names": ("<a" * 500_000 + '">', 0),
    "raw ends": ("<script>" + "</script" * 120_000, 0),
    "list items": ("<dl><dt><div>" + "<span>" * 100_000 + "<dd>x" * 50_000, 50_000),
}


@pytest.mark.parametrize("name", LONG)
def test_long_pages_are_read_whole_in_linear_time(name):
    page, n = LONG[name]
    start = time.process_time()
    got = html_parse.blocks(page)
    assert time.process_time() - start < 15
    assert sum(b.text.count("x") for b in got) == n or n == 0


def test_a_long_page_beside_short_ones(monkeypatch, other_labeller):
    """Batches are bounded by their padded size, and segments give the labels of the whole."""
    one = f"<article><p>{STORY}</p></article><div class=menu><a href=/>home</a></div>"
    pages = [html_parse.blocks(one * k) for k in (1, 3, 700, 2, 40)]
    net = block_lstm.BlockLSTM(other_labeller.w)
    whole = net.label(pages)
    seen = []
    forward = net._forward
    monkeypatch.setattr(net, "_forward", lambda v, keep: seen.append(len(v) * max(map(len, v))) or forward(v, keep))
    monkeypatch.setattr(block_lstm, "CELLS", 100)
    assert all((a == b).all() for a, b in zip(net.label(pages), whole)) and any(w.any() and not w.all() for w in whole)
    assert seen and max(seen) <= 100
    tracemalloc.start()
    monkeypatch.setattr(block_lstm, "CELLS", 16384)
    deep = html_parse.blocks("<div>x" * 60_000)
    assert len(net.label([deep, *pages])[0]) == 60_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20


#: Written by hand, in layouts that the drawn pages do not have.
OTHER = [
    ("<body><table><tr><td class=navcol><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></td><td class=storycol><h1>{0}</h1><p>{1}</p><p>{2}</p></td></tr></table><p class=copyright>Copyright 2020</p></body>"),
    ("<div id=page><div id=masthead><a href=/>Daily</a></div><div id=post-12 class='hentry post'><h2 class=entry-title>{0}</h2><div class=entry-content><p>{1}<p>{2}</div></div><div id=comments><h3>Replies</h3><div class=comment><p>Thanks for this.</div></div></div>"),
    ("<main><header><h1>{0}</h1></header><section><p>{1}</p><p>{2}</p></section></main><aside class=promo><p>Buy one today, get one free.</p></aside><footer><small>Legal</small></footer>"),
]


@pytest.mark.parametrize("page", range(len(OTHER)))
def test_paragraphs_of_other_layouts(other_labeller, page):
    parts = ["Rivers in flood", STORY, "The water rose for three days. " * 4]
    read = html_parse.blocks(OTHER[page].format(*parts))
    text = html_extract.main_text(read, other_labeller.label([read])[0])
    assert all(" ".join(p.split()) in text for p in parts[1:])
    assert not any(w in text for w in ("Copyright", "Thanks for", "Buy one", "Legal", "Daily"))


@pytest.fixture(scope="module")
def other_labeller(sf_dir):
    pages = pd.read_parquet(f"{sf_dir}/pages.parquet")["html"].dropna()
    return block_lstm.BlockLSTM(html_extract.learned(pages.tolist()[: html_extract.SAMPLE]))
