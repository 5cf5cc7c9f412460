"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is the chain of its leaf blocks. Features are the tags and class words of a block's
ancestors and figures of its text. The field has two labels, article and not; it is trained by
gradient ascent on the likelihood of labelled pages and a page is decoded by Viterbi.

Labelled pages are a bounded sample of the table's pages whose own markup tells the article
(at most ``FIT`` pages of ``FIT_BYTES`` and ``FIT_BLOCKS`` at most), and ``LAYOUTS``: frames
labelled by hand, filled with texts of the sample, so that pages without such markup are known
too. The model is a fixed number of weights and is broadcast; pages are read once, whole, and
not shuffled.

Null html counts as empty, and a page without article blocks has the empty text. Null page_ids
and repeated rows are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import batch
from .html_blocks import Block, page_blocks

FIT, FIT_BYTES, FIT_BLOCKS = 200, 1 << 16, 120
SIZE = 1 << 13  # weights for each label
EPOCHS, RATE, PENALTY = 120, 0.08, 2e-3

# Words of class names that mark what is not the article, wherever it stands.
ASIDE = frozenset(
    "ad ads advert advertisement advertisements adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent "
    "notice notices alert gdpr popup modal overlay sidebar side aside widget related recommended trending more menu nav "
    "navbar navigation breadcrumb breadcrumbs comment comments reply replies disqus discussion respond form login signup "
    "subscribe newsletter search share sharing social footer copyright legal masthead hidden pagination pager tags toolbar".split()
)
ASIDE_TAGS = frozenset("nav aside footer form button select textarea dialog head title".split())
MAIN_TAGS = frozenset("article main".split())
MAIN_NAMES = frozenset("article articlebody content entry main post story body text".split())


def marked_article(block: Block) -> bool:
    """Whether the markup itself says that a block belongs to the article."""
    inside = False
    for tag, names in block.path:
        if tag in MAIN_TAGS or "articlebody" in names:
            inside = True
        elif tag in ASIDE_TAGS or tag == "header" and not inside:
            return False
        if ASIDE.intersection(names):
            return False
    return inside


# Frames of pages: (text of kind, opening, closing, label). Kinds: line, long, links.
_NAV = [
    ("links", "<nav><ul>", "</ul></nav>", 0), ("links", '<div class="menu"><ul>', "</ul></div>", 0),
    ("links", '<div id="top-nav">', "</div>", 0), ("links", '<ul class="breadcrumbs">', "</ul>", 0),
]
_HEAD = [
    ("line", "<header><h1>", "</h1></header>", 0), ("line", '<div class="site-header"><p>', "</p></div>", 0),
    ("line", '<div id="masthead"><h2>', "</h2></div>", 0), ("line", "<header><div>", "</div></header>", 0),
]
_NOTE = [
    ("line", '<div class="cookie-notice"><p>', "</p></div>", 0), ("long", '<div id="gdpr-banner"><p>', "</p></div>", 0),
    ("line", '<div role="alert"><p>', "</p></div>", 0), ("line", '<div class="notice"><p>', "</p></div>", 0),
    ("long", '<section class="consent"><p>', "</p></section>", 0),
]
_AD = [
    ("line", '<div class="ad">', "</div>", 0), ("line", '<div class="advert"><p>', "</p></div>", 0),
    ("long", '<aside class="sponsored"><p>', "</p></aside>", 0), ("line", '<ins class="adsbygoogle">', "</ins>", 0),
    ("long", '<div class="promo"><p>', "</p></div>", 0), ("long", '<div class="ad-slot"><p>', "</p></div>", 0),
]
_SIDE = [
    ("links", "<aside><h3>More</h3><ul>", "</ul></aside>", 0), ("long", '<div class="sidebar"><p>', "</p></div>", 0),
    ("links", '<div class="related"><ul>', "</ul></div>", 0), ("long", "<aside><p>", "</p></aside>", 0),
    ("line", '<div id="side-widget"><p>', "</p></div>", 0),
]
_FORM = [
    ("line", '<form action="/s"><label>', "</label><input><button>Go</button></form>", 0),
    ("line", '<div class="newsletter"><form><p>', "</p></form></div>", 0),
    ("line", '<div class="share"><p>', "</p></div>", 0),
]
_COMMENTS = [
    ("long", '<section id="comments"><h3>Comments</h3><div class="comment"><p>', "</p></div></section>", 0),
    ("long", '<div class="comments"><p>', "</p></div>", 0), ("long", '<ol class="comment-list"><li>', "</li></ol>", 0),
    ("long", '<div class="reader-comments"><article class="comment"><p>', "</p></article></div>", 0),
    ("long", '<div id="disqus_thread"><p>', "</p></div>", 0),
]
_FOOT = [
    ("line", "<footer><p>", "</p></footer>", 0), ("long", '<div class="footer"><p>', "</p></div>", 0),
    ("line", "<footer>&copy; ", "</footer>", 0), ("links", '<div id="footer"><ul>', "</ul></div>", 0),
]
_BODIES = [
    ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
    ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"), ('<div class="post"><div class="entry-content">', "</div></div>"),
    ('<section class="story-body">', "</section>"), ('<div class="article-body">', "</div>"), ("<div>", "</div>"),
    ('<div itemprop="articleBody">', "</div>"),
]
LAYOUTS = (_NAV, _HEAD, _NOTE, _AD, _SIDE, _FORM, _COMMENTS, _FOOT)
_FILLER = "The long road went on past the old mill and the river, and nobody had seen the owner for years."


def layout_page(pick: random.Random, texts: list[str]) -> tuple[str, list[int]]:
    """A page in a random frame, and the label of each of its blocks."""

    def text(kind: str) -> str:
        words = pick.choice(texts).split()
        n = pick.randint(25, 90) if kind == "long" else pick.randint(2, 14)
        at = pick.randrange(max(1, len(words) - n))
        return " ".join(words[at : at + n]).replace("&", "&amp;").replace("<", "&lt;")

    def part(frame: tuple) -> str:
        kind, opening, closing, _ = frame
        if kind == "links":
            inner = "".join(f"<li><a href='/'>{text('line')[:30]}</a></li>" for _ in range(pick.randint(2, 6)))
        else:
            inner = text(kind)
        return opening + inner + closing

    before = [part(pick.choice(kind)) for kind in (_NAV, _HEAD, _NOTE, _AD) if pick.random() < 0.6]
    after = [part(pick.choice(kind)) for kind in (_SIDE, _FORM, _COMMENTS, _AD, _FOOT) if pick.random() < 0.6]
    pick.shuffle(before)
    opening, closing = pick.choice(_BODIES)
    inside: list[tuple[str, int]] = [(f"<h1>{text('line')}</h1>", 1)] if pick.random() < 0.7 else []
    for _ in range(pick.randint(2, 9)):
        chance = pick.random()
        if chance < 0.1:
            inside.append((part(pick.choice(pick.choice((_AD, _SIDE, _FORM)))), 0))
        elif chance < 0.2:
            inside.append((f"<h2>{text('line')}</h2>", 1))
        elif chance < 0.3:
            inside.append((f"<ul><li>{text('line')}</li><li>{text('line')}</li></ul>", 1))
        elif chance < 0.4:
            inside.append((f"<blockquote>{text('long')}</blockquote>", 1))
        else:
            inside.append((f"<p>{text(pick.choice(('long', 'long', 'line')))}</p>", 1))
    if pick.random() < 0.3:
        inside.append((part(pick.choice(_COMMENTS)), 0))
    labels: list[int] = []
    for piece, label in [(p, 0) for p in before] + inside + [(p, 0) for p in after]:
        labels += [label] * len(page_blocks(piece))
    head = "<title>" + text("line") + "</title>" if pick.random() < 0.8 else ""
    labels = [0] * len(page_blocks(f"<head>{head}</head>")) + labels
    body = "".join(before) + opening + "".join(p for p, _ in inside) + closing + "".join(after)
    return f"<html><head>{head}</head><body>{body}</body></html>", labels


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % SIZE


def features(block: Block, place: int, count: int) -> list[int]:
    """Weights a block uses: its ancestors, their class words, and figures of its text."""
    names = {"every"}
    inside = False
    for depth, (tag, words) in enumerate(reversed(block.path)):
        names.add(f"in {tag}")
        if depth == 0:
            names.add(f"own {tag}")
        inside = inside or tag in MAIN_TAGS
        for word in words:
            names.add(f"class {word}")
            if word in ASIDE:
                names.add("class aside")
            elif word in MAIN_NAMES:
                names.add("class main")
    if not inside:
        names.add("in no article")
    if any(tag in ASIDE_TAGS for tag, _ in block.path):
        names.add("in aside")
    words = len(block.text.split())
    names.add(f"words {min(words, 64).bit_length()}")
    names.add(f"linked {min(4, 5 * block.linked // max(1, len(block.text)))}")
    names.add(f"stop {block.text[-1] in '.!?…。'}")
    names.add(f"sign {'©' in block.text or '|' in block.text}")
    names.add(f"place {min(3, 4 * place // max(1, count))}")
    return sorted(map(_slot, names))


@dataclass
class Field:
    """Weights of the field: features by label, label after label, first label."""

    emit: np.ndarray
    step: np.ndarray
    first: np.ndarray

    def labels(self, chain: list[list[int]]) -> list[int]:
        """The most likely labels of a page (Viterbi); ties stay outside the article."""
        if not chain:
            return []
        emit = [self.emit[own].sum(axis=0).tolist() for own in chain]
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = self.first[0] + emit[0][0], self.first[1] + emit[0][1]
        back = []
        for e0, e1 in emit[1:]:
            to0, to1 = b + s10 > a + s00, b + s11 > a + s01
            back.append((int(to0), int(to1)))
            a, b = (b + s10 if to0 else a + s00) + e0, (b + s11 if to1 else a + s01) + e1
        out = [int(b > a)]
        for pair in reversed(back):
            out.append(pair[out[-1]])
        return out[::-1]


def train(pages: list[tuple[list[list[int]], list[int]]]) -> Field:
    """Maximum likelihood with a penalty, by Adam on all pages at once (forward-backward)."""
    n, longest = len(pages), max(len(labels) for _, labels in pages)
    used = np.zeros((n, longest), bool)
    gold = np.zeros((n, longest), np.int64)
    flat, owner = [], []
    for i, (chain, labels) in enumerate(pages):
        used[i, : len(labels)] = True
        gold[i, : len(labels)] = labels
        for t, own in enumerate(chain):
            flat += own
            owner += [i * longest + t] * len(own)
    flat, owner = np.array(flat), np.array(owner)
    truth = np.eye(2)[gold] * used[..., None]
    truth_step = np.einsum("nta,ntb->ab", truth[:, :-1], truth[:, 1:])
    values = [np.zeros((SIZE, 2)), np.zeros((2, 2)), np.zeros(2)]
    mean, square = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    log_sum = np.logaddexp
    for epoch in range(1, EPOCHS + 1):
        emit, step, first = values
        score = np.stack([np.bincount(owner, emit[flat, k], n * longest) for k in (0, 1)], axis=1).reshape(n, longest, 2)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = first + score[:, 0]
        for t in range(1, longest):
            came = ahead[:, t - 1, :, None] + step
            ahead[:, t] = np.where(used[:, t, None], log_sum(came[:, 0], came[:, 1]) + score[:, t], ahead[:, t - 1])
        total = log_sum(ahead[:, -1, 0], ahead[:, -1, 1])
        for t in range(longest - 2, -1, -1):
            goes = step + (score[:, t + 1] + behind[:, t + 1])[:, None, :]
            behind[:, t] = np.where(used[:, t + 1, None], log_sum(goes[..., 0], goes[..., 1]), 0.0)
        belief = np.exp(ahead + behind - total[:, None, None]) * used[..., None]
        joint = ahead[:, :-1, :, None] + step + (score + behind)[:, 1:, None, :] - total[:, None, None, None]
        joint = np.exp(np.where(used[:, 1:, None, None], joint, -np.inf)).sum(axis=(0, 1))
        lack = (truth - belief).reshape(-1, 2)
        by_feature = np.stack([np.bincount(flat, lack[owner, k], SIZE) for k in (0, 1)], axis=1)
        slopes = [by_feature / n, (truth_step - joint) / n, (truth[:, 0] - belief[:, 0]).sum(axis=0) / n]
        for i, slope in enumerate(slopes):
            slope = slope - PENALTY * values[i]
            mean[i] = 0.9 * mean[i] + 0.1 * slope
            square[i] = 0.99 * square[i] + 0.01 * slope**2
            values[i] = values[i] + RATE * (mean[i] / (1 - 0.9**epoch)) / (np.sqrt(square[i] / (1 - 0.99**epoch)) + 1e-6)
    return Field(*values)


def chain(blocks: list[Block]) -> list[list[int]]:
    return [features(b, i, len(blocks)) for i, b in enumerate(blocks)]


def fit(pages: list[str], layouts: int = 400) -> Field:
    """A field from sampled pages, labelled by their markup, and from the frames."""
    data, texts = [], []
    for page in pages:
        found = page_blocks(page)
        labels = [int(marked_article(b)) for b in found]
        texts += [b.text for b in found if len(b.text) > 200]
        if any(labels) and len(labels) <= FIT_BLOCKS:
            data.append((chain(found), labels))
    pick = random.Random(11)
    for _ in range(layouts):
        page, labels = layout_page(pick, texts or [_FILLER])
        found = page_blocks(page)
        if len(found) == len(labels):
            data.append((chain(found), labels))
    return train(data)


def sample(pages: DataFrame) -> list[str]:
    """At most ``FIT`` pages by a hash of their id."""
    html = F.col("html").cast("string")
    rows = pages.filter(html.isNotNull() & (F.octet_length(html) <= FIT_BYTES))
    rows = rows.select(html.alias("html"), F.xxhash64("page_id").alias("draw"))
    # About twice the number wanted, by hash, so that nothing is sorted as a whole.
    size = 1 << 30
    share = 2 * FIT * size // max(1, rows.count()) + 1
    # Rows of one repeated id are drawn together, so the number is limited before it comes to the driver.
    drawn = rows.filter(F.pmod("draw", F.lit(size)) < share).orderBy("draw", "html").limit(FIT).collect()
    return [r.html for r in sorted(drawn, key=lambda r: (r.draw, r.html))]


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(field or fit(sample(pages)))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def text(page: str) -> str:
        found = page_blocks(page)
        return " ".join(b.text for b, label in zip(found, shared.value.labels(chain(found))) if label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, 500):
                part = rows.slice(at, 500)
                texts = [text(page) for page in part["html"].to_pylist()]
                yield batch(schema, part["page_id"], part["url"].cast(pa.string()), texts, list(map(len, texts)))

    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
