"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of blocks: the words of each score positive, the tags before it negative. A word's weight is the
share of content among the words of its kind on labelled pages; its kind is the element that holds it, whether it is
link text, and whether it stands inside ``article`` or ``main``. A tag's weight is ``scale`` times the share of boilerplate
among its uses, so tags that run through articles cost little and containers cost much; ``scale`` is the value that gives
the best text on the labelled pages with their labels taken away. A linear scan finds the contiguous region of blocks with
the largest sum; of equal sums the region that starts, then ends, first.

Labels (``article`` and ``main``) serve the fit. When a page is read, they are ordinary containers; only the weight of
words outside them shrinks with the share of the page's words that stand inside. Elements that are never content by what
they are (scripts, styles, menus, headers and footers of the page, sidebars, forms, notices, adverts, reader comments) are
markup: one tag of the sequence, whose words are no words of it.

The fit sees a bounded sample of pages (``sample``, smallest by hash). White space is that of HTML (a no-break
space is none). Defined results: null html is the empty page, whose text is empty; pages without any words in the
sequence are empty; repeated rows give a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, smallest

#: Fixed values of HTML: elements without an end tag, with raw text, and that break a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
SHUT = frozenset("script style textarea title noscript template iframe svg math nav aside form footer header head button select dialog menu option label object canvas audio video xmp noembed noframes".split())
#: Words of class, id and role that name what isn't the article, and words that only say where such a thing stands.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner banners cookie cookies consent gdpr notice notices alert popup modal "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination footer masthead header sidebar sidebars aside form forms newsletter subscribe signup login search comment comments disqus reply replies respond "
    "share sharing social related contentinfo complementary".split()
)
PLACES = frozenset("site page main global top bottom left right inner outer primary secondary first last upper lower list area container wrapper wrap box block slot bar item items link links button buttons section unit thread posts tree form widget widgets native text js mobile desktop".split())
#: Tags that run through articles; a sample that never shows them tells nothing about them.
FLOW = frozenset("p br li ul ol dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption h1 h2 h3 h4 h5 h6 hr address details summary center".split())
LABELS = ("article", "main")
HIDDEN = "(never content)"
#: Words weigh so much at least, so that a page of nothing but an unlikely kind of block still has its text.
LEAST = 0.03
SCALES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|[^<]+|<", re.S)
ATTR = re.compile(r"(?:^|\s)(class|id|role|aria-label|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def _shut(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element is never content. Inside an article its own header belongs to it."""
    if tag in SHUT and not (tag == "header" and inside):
        return True
    if tag in ("body", "html", "main", "article") or not attrs:
        return False
    for name, *values in ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if name in ("class", "id", "role") and any(_other_name(w, inside) for w in value.split()):
            return True
    return False


def _other_name(word: str, inside: bool) -> bool:
    """Whether a class, id or role names what isn't the article: site-footer and ad-slot do, social-science and no-sidebar don't."""
    parts = [p for p in re.split(r"[^a-z]+", word) if p]
    found = NAMES.intersection(parts)
    return bool(found) and found.union(PLACES).issuperset(parts) and not (inside and found == {"header"})


class Block(NamedTuple):
    """A run of text between block tags: its text, whether it is never content, whether it is labelled as content, its
    kind, its words, the link words among them, and the tags since the last block."""

    text: str
    shut: bool
    label: bool
    kind: str
    words: int
    links: int
    tags: list[str]


def blocks(page: str) -> list[Block]:
    """The blocks of a page in page order, empty ones too."""
    out: list[Block] = []
    stack: list[tuple[str, bool]] = []
    shut = content = links = 0
    text: list[str] = []
    linked: list[str] = []
    tags: list[str] = []

    def flush() -> None:
        nonlocal text, linked, tags
        if text or tags:
            joined = SPACE.sub(" ", "".join(text)).strip(" ")
            if joined or tags:
                kind = next((t for t, _ in reversed(stack) if t in BLOCK), "")
                out.append(Block(joined, shut > 0, content > 0, "div" if kind in LABELS else kind, joined.count(" ") + 1 if joined else 0, len("".join(linked).split()), tags))
        text, linked, tags = [], [], []

    def close(k: int) -> None:
        nonlocal shut, content, links
        for t, s in stack[k:]:
            shut -= s
            content -= t in LABELS
            links -= t == "a"
        del stack[k:]

    def tag_seen(name: str) -> None:
        if not shut:
            tags.append(name)

    at, low = 0, page.lower() if page.isascii() else None
    while m := TOKEN.match(page, at):
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            s = m[0]
            if not s.startswith("<!") and not s.startswith("<?"):
                text.append(html.unescape(s))
                if links:
                    linked.append(text[-1])
            continue
        if tag in RAW and not m[1]:
            flush()
            if not m[3].rstrip().endswith("/") or tag in ("script", "style"):
                if low is not None:
                    end = low.find(f"</{tag}", at)
                else:
                    f = re.compile(rf"</{tag}", re.I).search(page, at)
                    end = f.start() if f else -1
                at = len(page) if end < 0 else (page.find(">", end) + 1 or len(page))
            continue
        if tag == "br":
            text.append(" ")
            continue
        name = "div" if tag in LABELS else tag
        if m[1]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            if tag in BLOCK or (k >= 0 and stack[k][1]):
                flush()
                tag_seen("/" + name)
            if k >= 0:
                close(k)
            continue
        if tag in VOID:
            if tag in BLOCK:
                flush()
                tag_seen(name)
            continue
        s = _shut(tag, m[3], content > 0)
        if tag in BLOCK or s:
            flush()
            tag_seen(HIDDEN if s else name)
        if tag in BLOCK:  # ends a paragraph that was left open
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCK), -1)
            if k >= 0 and stack[k][0] == "p":
                close(k)
        if tag in ("li", "option", "dt", "dd", "tr", "td", "th"):  # ends one of its kind that was left open
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in (tag, "ul", "ol", "table", "dl", "select")), -1)
            if k >= 0 and stack[k][0] == tag:
                close(k)
        stack.append((tag, s))
        shut += s
        content += tag in LABELS
        links += tag == "a"
    flush()
    return out


def word_kinds(b: Block) -> Iterable[tuple[str, int]]:
    """(kind, words) of a block's words: link text is a kind of its own."""
    links = min(b.links, b.words)
    if b.words - links:
        yield b.kind, b.words - links
    if links:
        yield b.kind + "+a", links


class Weights:
    """Of words by kind, positive; of tags by name, negative."""

    def __init__(self, words: dict[str, float], tags: dict[str, float], scale: float):
        self.words, self.tags, self.scale = words, tags, scale

    @classmethod
    def fit(cls, pages: Iterable[list[Block]]) -> Weights:
        """From pages with labels; without any, words weigh 0.5, link words 0.1, and tags as they do unseen."""
        labelled = [p for p in pages if any(b.label and b.words and not b.shut for b in p)]
        words, tags = Counter(), Counter()
        for page in labelled:
            for b in page:
                for kind, n in word_kinds(b):
                    words[kind, b.label and not b.shut] += n
                for t in b.tags:
                    tags[t, b.label] += 1
        share = lambda c, key, prior: (c[key, True] + 10 * prior) / (c[key, True] + c[key, False] + 10)
        by_kind = {k: max(share(words, k, 0.1 if k.endswith("+a") else 0.5), LEAST) for k, _ in words}
        by_tag = {t: 1 - share(tags, t, 0.98 if t.strip("/") in FLOW else 0.5) for t, _ in tags}
        tried = [cls(by_kind, by_tag, s) for s in SCALES]
        return max(tried, key=lambda w: (sum(w._agreement(p) for p in labelled), -w.scale))

    def word(self, kind: str) -> float:
        return self.words.get(kind, 0.1 if kind.endswith("+a") else 0.5)

    def tag(self, name: str) -> float:
        return -self.scale * self.tags.get(name, 0.02 if name.strip("/") in FLOW else 0.5)

    def sequence(self, page: list[Block], labels: bool = True) -> list[tuple[float, float]]:
        """(sum of the tags before it, sum of its words) of each block. Where labels hold most words, others weigh little."""
        inside = sum(b.words for b in page if b.label and not b.shut)
        total = sum(b.words for b in page if not b.shut)
        other = (1 - inside / total) ** 2 if labels and inside else 1.0
        gain = lambda b: 0.0 if b.shut else sum(n * self.word(k) for k, n in word_kinds(b)) * (1.0 if b.label else other)
        return [(sum(map(self.tag, b.tags)), gain(b)) for b in page]

    def _agreement(self, page: list[Block]) -> float:
        """F1 of the words found without labels against the labelled ones."""
        start, end = best_region(self.sequence(page, labels=False))
        found = sum(b.words for b in page[start:end] if not b.shut)
        right = sum(b.words for b in page[start:end] if b.label and not b.shut)
        return 2 * right / (found + sum(b.words for b in page if b.label and not b.shut))


def best_region(sequence: list[tuple[float, float]]) -> tuple[int, int]:
    """(start, end) of the blocks with the largest sum of words and of the tags between them, by one scan; (0, 0) if none is positive."""
    best, region, run, start = 0.0, (0, 0), 0.0, 0
    for k, (tags, words) in enumerate(sequence):
        if run + tags <= 0:
            run, start = 0.0, k
        else:
            run += tags
        run += words
        if run > best:
            best, region = run, (start, k + 1)
    return region


def main_text(page: str | None, weights: Weights) -> str:
    """The text blocks of the best contiguous region, joined by line breaks."""
    got = blocks(page or "")
    start, end = best_region(weights.sequence(got))
    return "\n".join(b.text for b in got[start:end] if b.text and not b.shut)


def fit_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = 500, longest: int = 200_000) -> Weights:
    """Weights from at most ``sample`` labelled pages of up to ``longest`` characters, the smallest by a hash of id and page.

    Executors take the pages apart; the driver gets the blocks' counts and tags, not their text.
    """
    h = F.col(html_col)
    labelled = pages.where(h.rlike("(?i)<(article|main)[\\s>]") & (F.length(h) <= longest))
    rows = smallest(labelled.select(id_col, html_col), sample, id_col, html_col)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps([x._replace(text="") for x in blocks(p)]) for p in b.column(0).to_pylist()], pa.string())], ["page"])

    return Weights.fit([[Block(*x) for x in json.loads(r[0])] for r in rows.select(h.cast("string")).mapInArrow(run, "page string").collect()])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = prepare(pages.sparkSession)
    blob = spark.sparkContext.broadcast(weights or fit_weights(pages, id_col, html_col))

    def run(batches):
        for b in batches:
            texts = [main_text(x, blob.value) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
