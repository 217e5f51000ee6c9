"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of text blocks. For each, a bidirectional LSTM reads
vectors of the element path (tags and the words of class, id and role), of the words,
and a few scalars, and decides in view of the whole page whether the block is article.

There are no labelled pages, so the labeller learns from two kinds of examples: at
most ``sample`` pages of the table, labelled where their elements say what a block
is, and as many times ``drawn`` pages laid out at random from the sample's own texts,
with menus, headers, notices, adverts, forms, sidebars, comments and footers whose
roles are known. Extraction itself reads every page whole.

Defined cases: null and empty html give the empty text; pages with nothing but markup
too; a page without any block that is labelled main has the empty text; very long and
deeply nested pages are read whole in time linear in their length, labelled in segments
with the state of both passes handed on, and learned from in segments; repeated rows
get equal results; result columns replace input columns of the same name; an empty
table gives no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyria.llm.block_lstm import SEGMENT, BlockLSTM, PageFeatures
from zephyria.llm.common import boxed, importable_on_workers, text_of, unboxed
from zephyria.llm.html_parse import Block, Path, blocks

#: Pages of the table that the labeller learns from at most, and pages drawn for each.
SAMPLE, DRAWN = 256, 6
#: Fewest pages to learn from; smaller tables have more drawn for each.
LEAST = 1200
#: Pages and characters that are read and labelled together.
GROUP_PAGES, GROUP_CHARS = 512, 4 << 20

#: Words by which pages name the parts that are not, and that are, the article.
ASIDE_WORDS = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav tabs pagination pager",
    "header": "header masthead top branding logo site-header banner",
    "notice": "notice cookie consent alert gdpr warning popup modal message disclaimer",
    "advert": "ad ads advert advertisement sponsored sponsor promo adbox dfp commercial",
    "form": "form search login subscribe newsletter signup contact",
    "sidebar": "aside sidebar side widget related recommended trending popular rail more",
    "comments": "comments comment replies reply discussion disqus respond reader responses",
    "footer": "footer bottom copyright legal colophon site-footer",
    "share": "share social tools sharing buttons meta byline tags",
}
MAIN_WORDS = "article main content post entry story text body entry-content post-content article-body page-content"
WRAPPERS = "container wrapper page row col layout outer inner site grid"

_ASIDE = frozenset(w for words in ASIDE_WORDS.values() for name in words.split() for w in name.split("-")) - {"page", "site", "top", "more", "text", "body", "content", "meta"}
_HEAD = frozenset({"head", "title", "button", "select", "textarea", "noscript", "option"})


def told_by_elements(page: list[Block]) -> np.ndarray | None:
    """Labels where elements say them: inside an article or main element, and in no other part.

    None if the page has neither element.
    """
    inside = np.array([b.path.derived("inside", False, lambda above, e: above or e[0] in ("article", "main")) for b in page], bool)
    if not inside.any():
        return None
    other = np.array([b.path.derived("other", False, lambda above, e: above or e[0] in _HEAD or not _ASIDE.isdisjoint(e)) for b in page], bool)
    return inside & ~other


class PageDraw:
    """Pages laid out at random from given texts, with the role of each block."""

    def __init__(self, texts: list[str], seed: int):
        self.rng, self.texts, self.root = random.Random(seed), texts or ["text"], Path()

    def block(self, path: tuple[tuple[str, ...], ...], text: str, link_chars: int) -> Block:
        return Block(self.root.down(path), text, link_chars)

    def words(self, low: int, high: int) -> str:
        pool = self.rng.choice(self.texts).split() or ["text"]
        n, at = self.rng.randint(low, high), self.rng.randrange(len(pool))
        return " ".join((pool + pool)[at : at + n])

    def element(self, tags: str, names: str = "", plain: float = 0.3) -> tuple[str, ...]:
        tag = self.rng.choice(tags.split())
        if not names or tag not in ("div", "section", "ul", "p", "span") and self.rng.random() < plain:
            return (tag,)
        name = self.rng.choice(names.split())
        extra = [self.rng.choice(("wrapper", "box", "list", "block", "area", "inner", "1", "left"))] if self.rng.random() < 0.3 else []
        return (tag, *dict.fromkeys([*name.split("-"), *extra]))

    def part(self, kind: str, above: tuple) -> list[tuple[Block, bool]]:
        rng, tags = self.rng, {"menu": "nav div ul", "header": "header div", "notice": "div section p", "advert": "div aside section", "form": "form div", "sidebar": "aside div section", "comments": "section div ol", "footer": "footer div", "share": "div ul"}
        path = (*above, self.element(tags[kind], ASIDE_WORDS[kind]))
        out: list[Block] = []
        link = lambda text: len(text)
        if kind in ("menu", "share"):
            for _ in range(rng.randint(2, 8)):
                text = self.words(1, 2)
                out.append(self.block((*path, ("ul",), ("li",)) if path[-1][0] != "ul" else (*path, ("li",)), text, link(text)))
        elif kind in ("notice", "advert"):
            inner = path if rng.random() < 0.5 else (*path, ("p",))
            out += [self.block(inner, self.words(3, 40), 0) for _ in range(rng.randint(1, 2))]
        elif kind == "form":
            out += [self.block((*path, (rng.choice(("label", "button", "p", "div")),)), self.words(1, 6), 0) for _ in range(rng.randint(1, 4))]
        elif kind == "comments":
            out.append(self.block((*path, (rng.choice(("h2", "h3")),)), self.words(1, 3), 0))
            for _ in range(rng.randint(1, 5)):
                one = self.element("div li article", "comment reply comment-body") if rng.random() < 0.7 else ("div",)
                out.append(self.block((*path, one, ("p",)), self.words(4, 90), 0))
        elif kind == "sidebar":
            out.append(self.block((*path, (rng.choice(("h2", "h3", "h4")),)), self.words(1, 4), 0))
            for _ in range(rng.randint(1, 5)):
                text, leaf = self.words(2, 50), rng.choice(((("ul",), ("li",)), (("p",),), (("div",),)))
                out.append(self.block((*path, *leaf), text, link(text) if rng.random() < 0.6 else 0))
        else:
            for _ in range(rng.randint(1, 3)):
                text, leaf = self.words(1, 20), rng.choice(((), (("p",),), (("div",),), (("h1",),) if kind == "header" else (("small",),)))
                out.append(self.block((*path, *leaf), text, link(text) if rng.random() < 0.3 else 0))
        return [(b, False) for b in out]

    def article(self, above: tuple) -> list[tuple[Block, bool]]:
        rng = self.rng
        home = rng.choice(((("article",),), (("main",),), (("main",), ("article",)), (self.element("div section article", MAIN_WORDS, 0.0),), (self.element("div", MAIN_WORDS), ("article",))))
        path, out = (*above, *home), []
        # a header inside the article is a header; sections inside it are the article
        titled = rng.random() < 0.15
        out.append((self.block((*path, *((("header",),) if titled else ()), (rng.choice(("h1", "h1", "h2")),)), self.words(3, 14), 0), not titled))
        within = rng.choice(((),) * 5 + ((("section",),), (("div",),)))
        for _ in range(rng.choice((0, 1, 2, 3, 5, 8, 14))):
            if rng.random() < 0.15:
                out += self.part(rng.choice(("advert", "share", "sidebar", "notice")), path)
            leaf = rng.choice(((("p",),),) * 8 + ((("h2",),), (("h3",),), (("ul",), ("li",)), (("blockquote",),), (("blockquote",), ("p",)), (("table",), ("tr",), ("td",)), (("figure",), ("figcaption",)), (("div",),), (("pre",),), ()))
            text = self.words(1, 12) if leaf and leaf[0][0] in ("h2", "h3") else self.words(3, 160)
            out.append((self.block((*path, *within, *leaf), text, int(len(text) * 0.2) if rng.random() < 0.15 else 0), True))
        return out

    def page(self) -> tuple[list[Block], np.ndarray]:
        rng, above = self.rng, (("html",), ("body",)) if self.rng.random() < 0.85 else ()
        out = [(self.block((("html",), ("head",), ("title",)), self.words(3, 14), 0), False)] if rng.random() < 0.9 else []
        wrap = [self.element("div", WRAPPERS) for _ in range(rng.choice((0, 0, 0, 1, 2)))]
        top = [k for k in ("header", "menu", "notice", "advert", "form", "share") if rng.random() < 0.45]
        end = [k for k in ("share", "sidebar", "comments", "form", "advert", "notice", "footer") if rng.random() < 0.5]
        rng.shuffle(top)
        for k in top:
            out += self.part(k, above)
        body, above = above, (*above, *wrap)
        if rng.random() < 0.2:
            out += self.part("sidebar", above)
        if rng.random() < 0.97:
            out += self.article(above)
        for k in end:
            out += self.part(k, body if k == "footer" else above)
        return [b for b, _ in out], np.array([y for _, y in out], bool)


def learned(pages: list[str], drawn: int = DRAWN) -> dict[str, np.ndarray]:
    """Weights of a labeller for pages like these."""
    root = Path()
    read = [b for b in (blocks(p, root) for p in pages) if b]
    examples = [(b, y) for b in read if (y := told_by_elements(b)) is not None]
    draw = PageDraw([x.text for b in read for x in b], seed=7)
    examples += [draw.page() for _ in range(max(LEAST, drawn * len(pages)))]
    parts = [(PageFeatures(b[a : a + SEGMENT], a, len(b)), y[a : a + SEGMENT]) for b, y in examples for a in range(0, len(b), SEGMENT)]
    return BlockLSTM().fit([p for p, _ in parts], [y for _, y in parts]).w


def labeller(pages: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Fit in one task, on a sample chosen by the hash of page_id."""

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts))
        if len(rows):
            weights = learned(rows.sort_values(["page_id", "html"])["html"].tolist())
            yield pd.DataFrame({"name": list(weights), "body": [v.astype("<f4").tobytes() for v in weights.values()], "shape": [list(v.shape) for v in weights.values()]})

    known = pages.where("html is not null").select("page_id", "html")
    ids = known.select("page_id").distinct().orderBy(F.xxhash64("page_id")).limit(sample)
    chosen = known.join(F.broadcast(ids), "page_id").limit(sample)
    rows = chosen.repartition(1).mapInPandas(fit, "name string, body binary, shape array<int>").collect()
    return {r.name: np.frombuffer(r.body, "<f4").reshape(r["shape"]) for r in rows}


def page_groups(batch: pa.Array) -> Iterator[list[str]]:
    """At most ``GROUP_PAGES`` pages and, but for a longer page, ``GROUP_CHARS`` characters at a time."""
    some: list[str] = []
    size = 0
    for h in batch:
        page = h.as_py()
        if some and (len(some) == GROUP_PAGES or size + len(page) > GROUP_CHARS):
            yield some
            some, size = [], 0
        some.append(page)
        size += len(page)
    if some:
        yield some


def main_text(page: list[Block], labels: np.ndarray) -> str:
    return " ".join(b.text for b, y in zip(page, labels) if y)


def extract_main(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``pages`` with text, n_chars, n_blocks and n_main_blocks."""
    importable_on_workers(pages.sparkSession)
    weights = labeller(pages, sample)

    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net, names = BlockLSTM(weights or None), ["text", "n_blocks", "n_main"]
        for batch in batches:
            rows = []
            for some in page_groups(batch):
                root = Path()
                read = [blocks(h, root) for h in some]
                rows += [(main_text(b, y), len(b), int(y.sum())) for b, y in zip(read, net.label(read))]
            columns = list(zip(*rows)) if rows else [[], [], []]
            yield pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=names)

    rows = boxed(pages, html=text_of("html"))
    read = rows.select("row", F.arrow_udf(extract, "struct<text:string,n_blocks:long,n_main:long>")("html").alias("found"))
    text = F.col("found.text")
    return unboxed(read, pages.columns, text=text, n_chars=F.length(text).cast("long"), n_blocks=F.col("found.n_blocks"), n_main_blocks=F.col("found.n_main"))
