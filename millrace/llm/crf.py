"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

Each block of a page is article or not. Scores come from features of its
ancestors and its text, and of its neighbour's label; the best labelling of the
whole page is decoded by Viterbi. The field is trained by the gradient of the
exact likelihood on labelled pages: a bounded sample of the table whose blocks
are labelled by the landmarks of their markup, and pages composed from the
sample's blocks in the layouts below, whose labels are known.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from millrace.llm.common import ready
from millrace.llm.dom import Block, blocks

SAMPLE_PAGES = 300  # of the table, that are labelled
SAMPLE_CHARS = 40_000  # longest page of the sample
COMPOSED = 500  # pages made for training
ROUNDS = 150
PLAIN = 0.3  # of the composed pages, whose elements and names tell nothing
RATE, RIDGE = 0.3, 1e-3
ENDS = '.!?…:”»"'  # of a sentence
TRAIN_BLOCKS = 80  # of a training page

#: Elements and names that tell what a part of a page is for (fixed values).
ARTICLE = frozenset("article main".split())
ASIDE = frozenset("nav header footer aside form menu dialog search fieldset".split())
ASIDE_NAMES = frozenset(
    "nav navigation navbar menu header masthead banner footer foot sidebar side aside widget ad ads advert advertisement adverts sponsor "
    "sponsored promo notice cookie cookies consent gdpr alert popup modal overlay comment comments reply replies respond discussion disqus "
    "form signup subscribe newsletter login search share social related recommended more breadcrumb breadcrumbs pager pagination copyright legal tags toolbar".split()
)
ARTICLE_NAMES = frozenset("article content main post entry story body text articlebody prose".split())
#: Parts of a class name that say where or of what kind, not what for; and those that only tell of a state (fixed values).
PLACES = frozenset("left right top bottom inner outer wrap wrapper container box list item area section block bar panel unit slot region group link links title".split())
STATES = frozenset("has with without no not is js show hide open closed".split())


def meaning(name: str) -> str:
    """What a class name, taken as a whole, is for: its last part, but for places and parts of something else."""
    parts = [x for x in name.split("-") if x]
    if not parts or len(parts) > 1 and parts[0] in STATES:
        return ""
    head = parts.pop()
    while parts and (head in PLACES or head in ARTICLE_NAMES and parts[-1] in ASIDE_NAMES):
        head = parts.pop()
    # the header of an article holds its heading
    return parts[-1] if head == "header" and parts and parts[-1] in ARTICLE_NAMES else head


@lru_cache(maxsize=50_000)
def path_features(path: tuple[tuple[str, str], ...]) -> tuple[str, ...]:
    """Of the ancestors: their tags, names and roles, and what the innermost telling one is for."""
    out = {f"leaf:{path[-1][0] if path else ''}"}
    inner = ""
    article = False
    for tag, names in path:
        out.add(f"tag:{tag}")
        words = {meaning(x) for x in names.rstrip("\0").split()}
        if tag in ARTICLE or tag in ("html", "body"):  # what they are, or the whole page; names tell of their state
            words -= ASIDE_NAMES
        out.update(f"name:{w}" for w in words & (ASIDE_NAMES | ARTICLE_NAMES))
        if tag in ASIDE or words & ASIDE_NAMES:
            inner = "aside" if article else "outside"
            if tag == "header" and article and not words & ASIDE_NAMES:
                inner = "heading"
        elif tag in ARTICLE or words & ARTICLE_NAMES:
            inner = "article"
            article = True
    out.add(f"inner:{inner}")
    if inner == "article":
        out.add(f"own:{path[-1][0]}")
    return tuple(sorted(out))


def text_features(block: Block) -> tuple[str, ...]:
    words = block.text.count(" ") + 1
    return (
        "bias",
        f"words:{min(words.bit_length(), 8)}",
        f"linked:{_level(block)}",
        f"ends:{block.text[-1] in ENDS}",
        f"copyright:{'©' in block.text[:200] or 'copyright' in block.text[:200].lower()}",
    )


def _level(block: Block) -> int:
    return min(4, block.linked * 5 // max(len(block.text), 1))


def features(page: list[Block]) -> list[tuple[str, ...]]:
    """Of each block by itself, of its neighbours' links, and of how often its path comes on the page."""
    alike = Counter(b.path for b in page)
    links = [_level(b) for b in page]
    out = []
    for k, b in enumerate(page):
        around = f"before:{links[k - 1] if k else 'none'}", f"after:{links[k + 1] if k + 1 < len(page) else 'none'}"
        words = min((b.text.count(" ") + 1).bit_length(), 8)
        out.append((*path_features(b.path), *text_features(b), *around, f"alike:{min(alike[b.path].bit_length(), 4)}:{links[k]}", f"shape:{words}:{links[k]}:{b.text[-1] in ENDS}"))
    return out


def landmarks(block: Block) -> bool | None:
    """The label that the markup gives away; None if it doesn't."""
    marks = [f for f in path_features(block.path) if f.startswith("inner:")]
    return {"inner:article": True, "inner:heading": True, "inner:aside": False, "inner:outside": False}.get(marks[0])


def _path(*steps: str) -> tuple[tuple[str, str], ...]:
    return (("html", ""), ("body", ""), *((tag, names) for tag, _, names in (s.partition(".") for s in steps)))


#: Layouts of composed pages: (label, fewest and most blocks, part of the page's text, alternatives of the path).
BEFORE = (
    (False, (1, 8), "menu", (("nav", "ul", "li"), ("div.nav menu", "ul", "li"), ("header", "nav", "ul", "li"), ("div.breadcrumb", "ul", "li"), ("ul.menu", "li"))),
    (False, (0, 2), "short", (("header",), ("header", "h1"), ("div.header",), ("div.masthead", "p"), ("header.banner", "div"))),
    (False, (0, 2), "short", (("div.ad",), ("div.advertisement", "p"), ("aside.ad", "p"), ("div.sponsor promo",), ("section.promo", "h2"))),
    (False, (0, 1), "short", (("div.notice",), ("div.cookie consent", "p"), ("div.alert",), ("section.notice", "p"), ("dialog", "p"))),
)
ROOTS = (("article",), ("main",), ("main", "article"), ("div.content",), ("div.post entry",), ("section.article body",), ("div.main content", "article"), ("div",), ())
INSIDE = (
    (True, (1, 1), "short", (("h1",), ("header", "h1"), ("h2",), ("div", "h1"))),
    (True, (1, 12), "long", (("p",), ("p",), ("div", "p"), ("section", "p"), ("blockquote", "p"), ("ul", "li"), ("h2",), ("pre",), ("table", "tr", "td"), ("figure", "figcaption"))),
    (False, (0, 1), "short", (("aside", "p"), ("div.ad",), ("form", "p"), ("div.share social",), ("aside.related", "ul", "li"), ("div.newsletter signup", "p"))),
    (True, (0, 6), "long", (("p",), ("p",), ("ol", "li"), ("section", "p"), ("h3",))),
    (False, (0, 3), "long", (("section.comments", "p"), ("div.comment", "p"), ("div.comments", "div", "p"), ("footer",), ("div.tags",))),
)
AFTER = (
    (False, (0, 4), "long", (("section.comments", "p"), ("div.comments", "div.comment", "p"), ("div.discussion", "ul", "li"), ("ol.comments", "li", "p"))),
    (False, (0, 4), "short", (("aside", "p"), ("div.sidebar", "ul", "li"), ("aside.sidebar", "div.widget", "p"), ("div.related", "ul", "li"), ("div.sidebar", "h2"))),
    (False, (0, 2), "short", (("form", "p"), ("form", "label"), ("form.newsletter", "div"), ("div.login", "form", "p"))),
    (False, (1, 2), "foot", (("footer",), ("footer", "p"), ("div.footer",), ("div.copyright", "p"), ("footer", "ul", "li"))),
)
FILLER = ("A longer piece of text, as articles have it, with more than one part.", "Some words.", "It goes on for a while, and then it ends.", "One more line of text follows here.")


def compose(texts: list[str], rng: random.Random, plain: bool = False) -> tuple[list[Block], list[bool]]:
    """A page in one of the layouts, with texts of the sample.

    On a ``plain`` page all elements are plain and names unknown, menus and lists
    of links are told by their links, and there is no text of others.
    """
    page: list[Block] = []
    labels: list[bool] = []

    def part(spec: tuple, root: tuple[str, ...] = ()) -> None:
        label, (least, most), kind, paths = spec
        if plain and not label and kind == "long":
            return
        path = rng.choice(paths)
        for _ in range(rng.randint(least, most)):
            if label and least != most:
                path = rng.choice(paths)
            text = rng.choice(texts)
            if kind == "menu":
                text = " ".join(text.split()[:2])
            elif kind != "long" and rng.random() < 0.7:
                text = " ".join(text.split()[: rng.randint(3, 14)])
            if kind == "foot":
                text = rng.choice(("© ", "Copyright ", "")) + text
            linked = kind == "menu" or (not label and rng.random() < (0.9 if plain else 0.2))
            steps = [f"{'div' if s.partition('.')[0] in ASIDE | ARTICLE else s.partition('.')[0]}.{spec[2]}x" for s in (*root, *path)] if plain else (*root, *path)
            page.append(Block(text, _path(*steps), len(text) if linked else 0))
            labels.append(label)

    for spec in BEFORE:
        part(spec)
    root = rng.choice(ROOTS)
    for spec in INSIDE:
        part(spec, root)
    for spec in AFTER:
        part(spec)
    return page, labels


class Field:
    """Weights of features and of neighbouring labels; label 1 is article."""

    def __init__(self, weights: dict[str, tuple[float, float]], edges: list[list[float]]) -> None:
        self.weights, self.edges = weights, edges

    def decode(self, page: list[Block]) -> list[bool]:
        """The most probable labelling, by Viterbi; of equal ones that with more article."""
        if not page:
            return []
        find, none, edges = self.weights.get, (0.0, 0.0), self.edges
        back: list[tuple[int, int]] = []
        low = high = 0.0
        for k, names in enumerate(features(page)):
            found = [find(f, none) for f in names]
            e0, e1 = sum(f[0] for f in found), sum(f[1] for f in found)
            if k:
                stay, fall = low + edges[0][0], high + edges[1][0]
                rise, keep = low + edges[0][1], high + edges[1][1]
                back.append((int(fall >= stay), int(keep >= rise)))
                low, high = max(stay, fall), max(rise, keep)
            low, high = low + e0, high + e1
        label = int(high >= low)
        out = [label]
        for step in reversed(back):
            out.append(label := step[label])
        return [bool(x) for x in reversed(out)]


def train(pages: list[tuple[list[Block], list[bool]]], rounds: int = ROUNDS) -> Field:
    """Maximum likelihood with a ridge, by gradient steps over all pages at once."""
    pages = [(p[:TRAIN_BLOCKS], y[:TRAIN_BLOCKS]) for p, y in pages if p]
    names: dict[str, int] = {}
    n, width = len(pages), max(len(p) for p, _ in pages)
    where: list[int] = []
    which: list[int] = []
    truth = np.zeros((n, width), np.int64)
    mask = np.zeros((n, width), bool)
    for a, (page, labels) in enumerate(pages):
        truth[a, : len(page)], mask[a, : len(page)] = labels, True
        for b, found in enumerate(features(page)):
            for f in found:
                where.append(a * width + b)
                which.append(names.setdefault(f, len(names)))
    at, of = np.array(where), np.array(which)
    weights, edges = np.zeros((len(names), 2)), np.zeros((2, 2))
    squares, edge_squares = np.full_like(weights, 1e-6), np.full_like(edges, 1e-6)
    gold = np.eye(2)[truth] * mask[:, :, None]
    both = mask[:, 1:] & mask[:, :-1]
    gold_edges = np.einsum("ati,atj->ij", gold[:, :-1] * both[:, :, None], gold[:, 1:] * both[:, :, None])
    for _ in range(rounds):
        emit = np.stack([np.bincount(at, weights[of, y], n * width) for y in (0, 1)], axis=1).reshape(n, width, 2)
        forward, backward = np.zeros((n, width, 2)), np.zeros((n, width, 2))
        forward[:, 0] = emit[:, 0]
        for t in range(1, width):
            step = np.logaddexp.reduce(forward[:, t - 1, :, None] + edges[None], axis=1) + emit[:, t]
            forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
        for t in range(width - 2, -1, -1):
            step = np.logaddexp.reduce(edges[None] + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(mask[:, t + 1, None], step, 0)
        whole = np.logaddexp.reduce(forward[:, -1], axis=1)
        share = np.exp(forward + backward - whole[:, None, None]) * mask[:, :, None]
        joint = forward[:, :-1, :, None] + edges[None, None] + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - whole[:, None, None, None]
        expected_edges = (np.exp(np.minimum(joint, 0)) * both[:, :, None, None]).sum(axis=(0, 1))
        miss = (gold - share).reshape(-1, 2)
        slope = np.stack([np.bincount(of, miss[at, y], len(names)) for y in (0, 1)], axis=1) - RIDGE * weights
        edge_slope = gold_edges - expected_edges - RIDGE * edges
        squares += slope**2
        edge_squares += edge_slope**2
        weights += RATE * slope / np.sqrt(squares)
        edges += RATE * edge_slope / np.sqrt(edge_squares)
    return Field({f: (float(weights[k, 0]), float(weights[k, 1])) for f, k in names.items()}, edges.tolist())


def labelled(sample: list[str]) -> list[tuple[list[Block], list[bool]]]:
    """Training pages: those of the sample whose markup labels all blocks, and composed ones."""
    parsed = [p for p in map(blocks, sample) if p]
    known = [(p, [bool(landmarks(b)) for b in p]) for p in parsed if all(landmarks(b) is not None for b in p)]
    texts = [b.text for p in parsed for b in p if len(b.text) < 2000] or list(FILLER)
    rng = random.Random(11)
    return known + [compose(texts, rng, rng.random() < PLAIN) for _ in range(COMPOSED)]


def fit(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> Field:
    """A field from at most ``SAMPLE_PAGES`` different pages of at most ``SAMPLE_CHARS`` characters, spread over the table by a hash.

    Hashes are chosen first; only the pages that have them are sent to the driver.
    """
    short = pages.where(F.length(html) <= SAMPLE_CHARS).select(F.col(html).alias("html"), F.xxhash64(page_id, html).alias("h"))
    chosen = [r["h"] for r in short.select("h").distinct().orderBy("h").limit(SAMPLE_PAGES).collect()]
    sample = short.where(F.col("h").isin(chosen)).groupBy("h").agg(F.first("html").alias("html")).orderBy("h") if chosen else short.limit(0)
    return train(labelled([r["html"] for r in sample.collect()]))


def extract(pages: DataFrame, field: Field, html: str = "html"):
    """A column of the main text of each whole page: the article's blocks in page order, joined by one space."""
    ready(pages.sparkSession)

    @F.arrow_udf(StructType.fromDDL("text string, n_chars bigint, n_blocks int"))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts, counts = [], []
            for x in batch:
                page = blocks(x.as_py() or "")
                texts.append(" ".join(b.text for b, y in zip(page, field.decode(page), strict=True) if y))
                counts.append(len(page))
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int32())], ["text", "n_chars", "n_blocks"])

    return run(F.col(html))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points) and n_blocks.

    Null or empty html gives the empty text. Pages stand alone: repeated rows
    and null ids are extracted like others. With no page to learn from, only
    composed pages with filler texts are. An empty table gives no rows.
    """
    got = extract(pages, fit(pages, page_id, html), html)
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), got.alias("x")).select("page_id", "url", "x.*")
