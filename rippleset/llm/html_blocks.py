"""Main text of web pages by a recurrent block labeller.

A page is read once into its leaf blocks: the tags and class words on the way to each block, and its text. A bidirectional LSTM
(numpy) reads the whole sequence of blocks, each as hashed path words, hashed text words and a few measures, and says of every block
whether it belongs to the article; so a block without telling tags is judged by what stands before and after it. The text of a
page is that of its article blocks, in order.

Tables of pages hold no labels. The labeller learns from a bounded sample of ``TRAINING_PAGES`` pages: as they are, where their own tags
name the article (``by_tags``), and rearranged into made pages (``made_page``) of other layouts, whose menus, notices, adverts, forms, sidebars and
comments carry the usual names. It is trained in one task, and goes to all tasks as one broadcast of fixed size.
Every page is read in full; a very long one is a long sequence in constant memory a block.

What is no block: scripts, styles, titles, text areas, comments and tags. Unclosed and stray tags are borne: a block tag ends an open
paragraph, a stray end tag is skipped, an unclosed comment or script takes the rest, and what is no tag is text. Character references are decoded once, also without their
semicolon as browsers do.

Cases: null, empty and blank pages and pages without an article have the text "". Repeated rows are each answered. Empty tables give no
rows. Only the key columns and the html are read, so other columns may have any names.
"""

from __future__ import annotations

import html as references
import pickle
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleset.llm.common import slices, table

#: Pages of the sample, their longest html, blocks of a training page, made pages for each page.
TRAINING_PAGES, LONGEST, TRAINING_BLOCKS, MADE = 256, 200_000, 48, 3
#: Buckets of path words and of text words, measures, state of each direction.
PATHS, WORDS, MEASURES, STATE = 256, 128, 6, 16
#: Pages and padded blocks that a task holds at a time.
PAGES, PADDED = 64, 32_768

# --- Fixed values: HTML's elements ---
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes template xmp svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}
# ---
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+|[^>]*)>""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
DEEPEST = 40

#: Words that name the article or what surrounds it, in tags, classes and ids.
ARTICLE = ("article", "main", "content", "post", "entry", "story", "articlebody")
AROUND = {
    "menu": ("nav", "menu", "navbar", "breadcrumb", "toc", "tabs"),
    "header": ("header", "masthead", "topbar", "branding"),
    "footer": ("footer", "colophon", "bottom", "copyright", "legal"),
    "sidebar": ("aside", "sidebar", "widget", "related", "popular", "recommended"),
    "notice": ("notice", "cookie", "consent", "banner", "alert", "gdpr", "popup", "modal"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsored", "promo"),
    "form": ("form", "search", "login", "newsletter", "subscribe", "signup"),
    "comments": ("comments", "comment", "reply", "respond", "discussion", "disqus"),
    "share": ("share", "social", "tags", "byline", "meta"),
}
AROUND_WORDS = frozenset(w for words in AROUND.values() for w in words)

Block = tuple[tuple[str, ...], str, float]


def names(attributes: str) -> list[str]:
    """Lower-cased words of the class, id, role and itemprop of a tag."""
    return [w.lower() for found in NAMES.findall(attributes) for w in PART.findall("".join(found))][:8]


def blocks(page: str | None) -> list[Block]:
    """(path words, text, share of it in links) of every leaf block, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    open_tags: dict[str, int] = {}
    text: list[str] = []
    linked, link = 0, False

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                out.append((stack[-1][1] if stack else (), whole, min(1.0, linked / len(whole))))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        piece = references.unescape(piece) if "&" in piece else piece
        text.append(piece)
        linked += len(piece) if link else 0

    def pop() -> str:
        tag = stack.pop()[0]
        open_tags[tag] -= 1
        return tag

    page, at, end = page or "", 0, len(page or "")
    last = page.rfind(">") + 1  # no tag ends behind it
    while at < end:
        found = TOKEN.search(page, at, last)
        if found is None:
            add(page[at:])
            break
        if found[0].startswith("<!--") and not found[0].endswith("-->"):
            add(page[at : found.start()])
            break
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        closing, tag, attributes = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if tag in INLINE:
            if tag == "a":
                link = not closing
            continue
        flush()
        link = False
        if tag in VOID:
            continue
        if closing:
            if open_tags.get(tag):
                while pop() != tag:
                    pass
            continue
        if stack and stack[-1][0] == "p":
            pop()
        while stack and stack[-1][0] in ENDED_BY.get(tag, ()):
            pop()
        above = stack[-1][1] if stack else ()
        stack.append((tag, (*above, tag, *names(attributes)) if len(above) < DEEPEST else above))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return out


def by_tags(path: tuple[str, ...]) -> bool:
    """Whether a block belongs to the article, as far as its path names the article."""
    return not AROUND_WORDS.intersection(path) if {"article", "main"}.intersection(path) else False


def made_page(rng: np.random.Generator, paragraphs: list[str]) -> tuple[list[Block], list[int]]:
    """A page of another layout: an article of some paragraphs in a container of any name, amid surroundings of all kinds."""
    pick = lambda options: options[int(rng.integers(len(options)))]
    words = lambda n: " ".join(pick(paragraphs).split()[: int(n)])
    outer = ("html", "body", *(w for _ in range(int(rng.integers(0, 3))) for w in ("div", *([pick(("wrapper", "container", "page", "site", "layout", "row", "app"))] if rng.random() < 0.7 else []))))
    made: list[tuple[Block, int]] = []

    def around(kind: str, above: tuple[str, ...]) -> None:
        name = pick(AROUND[kind])
        tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind, "section")
        own = (tag, *([name] if rng.random() < 0.6 else [])) if rng.random() < 0.5 else (pick(("div", "section", "ul")), name, *([pick(("box", "list", "block", "area", "item", "main", "content"))] if rng.random() < 0.3 else []))
        short = kind in ("menu", "share", "form") or (kind in ("sidebar", "header") and rng.random() < 0.5)
        for _ in range(int(rng.integers(1, 7 if short or kind == "comments" else 3))):
            inner = pick((("ul", "li"), ("li",), ("div",))) if short else pick((("p",), ("div",), (), ("div", "p"), ("li",)))
            made.append(((above + own + inner, words(rng.integers(1, 4) if short else rng.integers(3, 60)) or "x", float(short and kind != "form")), 0))

    before, after = ("header", "menu", "notice", "advert", "form", "sidebar", "share"), ("comments", "sidebar", "footer", "advert", "form", "notice", "share", "menu")
    for _ in range(int(rng.integers(0, 4))):
        around(pick(before), outer)
    style = rng.random()
    if style < 0.4:
        own: tuple[str, ...] = (pick(("article", "main")), *([pick(ARTICLE)] if rng.random() < 0.4 else []))
    elif style < 0.85:
        own = (pick(("div", "section", "article")), pick(ARTICLE), *([pick(("body", "text", "area", "inner"))] if rng.random() < 0.4 else []))
    else:
        own = (pick(("div", "section", "td")),)
    within = outer + own
    if rng.random() < 0.8:
        made.append(((within + ((pick(("h1", "h1", "h2")),) if rng.random() < 0.8 else ("header", "h1")), words(rng.integers(2, 12)) or "x", 0.0), 1))
    for _ in range(int(rng.integers(1, 16))):
        if rng.random() < 0.08:
            around(pick(("advert", "share", "form", "sidebar", "notice")), within)
        inner = pick((("p",), ("p",), ("p",), ("p",), (), ("div", "p"), ("ul", "li"), ("h2",), ("blockquote", "p"), ("pre",), ("table", "tr", "td")))
        length = pick((2, 5, 12, 40, 80, 200)) if rng.random() < 0.7 else 400
        made.append(((within + inner, words(length) or "x", 0.0), 1))
    if rng.random() < 0.4:
        around("comments", within)
    for _ in range(int(rng.integers(0, 5))):
        around(pick(after), outer)
    return [b for b, _ in made], [label for _, label in made]


class Features:
    """Blocks as sums of hashed parts; buckets of words and paths are remembered."""

    def __init__(self, remembered: int = 200_000):
        self.words: dict[str, int] = {}
        self.paths: dict[tuple[str, ...], np.ndarray] = {}
        self.remembered = remembered

    def path(self, path: tuple[str, ...]) -> np.ndarray:
        """Places of the path's words, their beginnings and its last word."""
        found = self.paths.get(path)
        if found is None:
            if len(self.paths) >= self.remembered:
                self.paths.clear()
            parts = {*path, *("^" + w[:4] for w in path), "last " + (path[-1] if path else "")}
            found = self.paths[path] = np.array(sorted(zlib.crc32(p.encode()) % PATHS for p in parts))
        return found

    def word_places(self, text: str) -> list[int]:
        """A place for each word."""
        known, out = self.words, []
        for word in text.split():
            place = known.get(word)
            if place is None:
                if len(known) >= self.remembered:
                    known.clear()
                place = known[word] = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORDS
            out.append(place)
        return out

    def matrix(self, given: list[Block]) -> np.ndarray:
        """A row of PATHS + WORDS + MEASURES numbers for each block."""
        out = np.zeros((len(given), PATHS + WORDS + MEASURES), np.float32)
        for row, (path, text, links) in zip(out, given, strict=True):
            np.add.at(row, self.path(path), 1)
            places = self.word_places(text)
            row[PATHS : PATHS + WORDS] = np.bincount(places, minlength=WORDS) / max(1, len(places))
            row[PATHS + WORDS :] = (np.log1p(len(text)) / 8, np.log1p(len(places)) / 6, links, text[-1] in ".!?", text[0].isupper(), 1.0)
        return out


@dataclass
class Labeller:
    """Weights of both directions (inputs, state) and of the answer."""

    inputs: list[np.ndarray]
    states: list[np.ndarray]
    answer: np.ndarray

    def article(self, pages: list[list[Block]], features: Features) -> list[np.ndarray]:
        """For every page, which of its blocks belong to the article."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            count = 1
            while at + count < len(order) and (count + 1) * len(pages[order[at + count]]) <= PADDED:
                count += 1
            chosen = order[at : at + count]
            at += count
            sizes = [len(pages[i]) for i in chosen]
            states = np.zeros((max(sizes), len(chosen), 2 * STATE), np.float32)
            for way in (0, 1):
                h = c = np.zeros((len(chosen), STATE), np.float32)
                for start in range(0, max(sizes), 1024):  # the inputs of so many places at a time
                    stop = min(start + 1024, max(sizes))
                    x = np.zeros((stop - start, len(chosen), 4 * STATE), np.float32)
                    for column, i in enumerate(chosen):
                        if sizes[column] > start:
                            some = pages[i][start:stop] if not way else pages[i][max(0, sizes[column] - stop) : sizes[column] - start][::-1]
                            x[: len(some), column] = features.matrix(some) @ self.inputs[way]
                    for t in range(stop - start):
                        h, c, _ = _step(x[t], h, c, self.states[way])
                        states[start + t, :, way * STATE : (way + 1) * STATE] = h
            for column, i in enumerate(chosen):
                mine = states[: sizes[column], column].copy()
                mine[:, STATE:] = mine[::-1, STATE:]
                out[i] = mine @ self.answer[:-1] + self.answer[-1] > 0
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _step(x: np.ndarray, h: np.ndarray, c: np.ndarray, u: np.ndarray):
    """One place of the sequence: new state, new cell and the gates."""
    a = x + h @ u
    gates = _sigmoid(a[:, : 3 * STATE])
    new = np.tanh(a[:, 3 * STATE :])
    take, keep, show = gates[:, :STATE], gates[:, STATE : 2 * STATE], gates[:, 2 * STATE :]
    cell = keep * c + take * new
    shown = np.tanh(cell)
    return show * shown, cell, (take, keep, show, new, shown)


def _back(x_rows: np.ndarray, w: np.ndarray, u: np.ndarray, slope: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of one direction's weights from the slopes at its states (places, pages, STATE)."""
    places, pages = slope.shape[:2]
    d_u, d_a = np.zeros_like(u), np.zeros((places, pages, 4 * STATE), np.float32)
    d_h = d_c = np.zeros((pages, STATE), np.float32)
    for t in range(places - 1, -1, -1):
        h_before, c_before, (take, keep, show, new, shown) = kept[t]
        d_h = d_h + slope[t]
        d_c = d_c + d_h * show * (1 - shown**2)
        d_a[t] = np.concatenate([d_c * new * take * (1 - take), d_c * c_before * keep * (1 - keep), d_h * shown * show * (1 - show), d_c * take * (1 - new**2)], 1)
        d_u += h_before.T @ d_a[t]
        d_h, d_c = d_a[t] @ u.T, d_c * keep
    return np.einsum("tbi,tbj->ij", x_rows, d_a, optimize=True), d_u


def train(pages: list[tuple[np.ndarray, np.ndarray]], steps: int = 240, batch: int = 24, rate: float = 0.02, seed: int = 0) -> Labeller:
    """Minimises the log loss over (block features, labels) of whole sequences, by Adam."""
    rng = np.random.default_rng(seed)
    size = PATHS + WORDS + MEASURES
    weights = [rng.normal(0, 0.1, (size, 4 * STATE)), rng.normal(0, 0.1, (size, 4 * STATE)), rng.normal(0, 0.2, (STATE, 4 * STATE)), rng.normal(0, 0.2, (STATE, 4 * STATE)), rng.normal(0, 0.2, 2 * STATE + 1)]
    weights = [w.astype(np.float32) for w in weights]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1 if pages else 1):
        chosen = [pages[i] for i in rng.integers(0, len(pages), batch)]
        places = max(len(y) for _, y in chosen)
        x, y, used = np.zeros((2, places, batch, size), np.float32), np.zeros((places, batch), np.float32), np.zeros((places, batch), np.float32)
        for b, (rows, labels) in enumerate(chosen):
            n = len(labels)
            x[0, :n, b], x[1, :n, b], y[:n, b], used[:n, b] = rows, rows[::-1], labels, 1
        hidden, kept = np.zeros((2, places, batch, STATE), np.float32), ([], [])
        for way in (0, 1):
            z, h, c = x[way] @ weights[way], np.zeros((batch, STATE), np.float32), np.zeros((batch, STATE), np.float32)
            for t in range(places):
                before = (h, c)
                h, c, gates = _step(z[t], h, c, weights[2 + way])
                kept[way].append((*before, gates))
                hidden[way, t] = h
        turned = np.zeros_like(hidden[1])
        for b, (_, labels) in enumerate(chosen):
            turned[: len(labels), b] = hidden[1, : len(labels), b][::-1]
        both = np.concatenate([hidden[0], turned], 2)
        slope = (_sigmoid(both @ weights[4][:-1] + weights[4][-1]) - y) * used / used.sum()
        gradient = [None] * 4 + [np.append(np.einsum("tbi,tb->i", both, slope), slope.sum()).astype(np.float32)]
        d = slope[:, :, None] * weights[4][:-1]
        d_turned = np.zeros_like(hidden[1])
        for b, (_, labels) in enumerate(chosen):
            d_turned[: len(labels), b] = d[: len(labels), b, STATE:][::-1]
        for way, of in ((0, d[:, :, :STATE]), (1, d_turned)):
            gradient[way], gradient[2 + way] = _back(x[way], weights[way], weights[2 + way], of, kept[way])
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for i, g in enumerate(gradient):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g**2
            weights[i] = weights[i] - now * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    weights = [w.astype(np.float32) for w in weights]
    return Labeller(weights[:2], weights[2:4], weights[4])


def fit(pages: DataFrame, html_col: str = "html", sample: int = TRAINING_PAGES, made: int = MADE, seed: int = 0) -> Labeller:
    """Learns from about ``sample`` pages, drawn by a hash of the page, and pages made of their paragraphs."""
    given = pages.select(F.col(html_col).cast("string").alias("page")).where(F.length("page").between(1, LONGEST))
    every = F.lit(max(1, pages.count() // sample))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = sorted(p for batch in batches for p in batch.column("page").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(drawn, made, seed))], pa.binary())], ["model"])

    drawn = given.where(F.pmod(F.xxhash64("page"), every) == 0).limit(2 * sample)  # one task, of pages whose length is bounded
    found = drawn.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else learn([])


def learn(drawn: list[str], made: int = MADE, seed: int = 0) -> Labeller:
    """A labeller from pages, as they are and rearranged."""
    rng, features = np.random.default_rng(seed), Features()
    known: list[tuple[list[Block], list[int]]] = []
    paragraphs: list[str] = []
    for page in drawn:
        found = blocks(page)
        labels = [int(by_tags(path)) for path, _, _ in found]
        paragraphs += [text for (_, text, _), label in zip(found, labels, strict=True) if label or not any(labels)]
        if any(labels):
            # Of a long page some blocks go, so that sequences stay short.
            keep = np.sort(rng.permutation(len(found))[:TRAINING_BLOCKS])
            known.append(([found[i] for i in keep], [labels[i] for i in keep]))
    paragraphs = paragraphs or ["text"]
    known += [made_page(rng, paragraphs) for _ in range(made * len(drawn))]
    return train([(features.matrix(of), np.array(labels, np.float32)) for of, labels in known if of], seed=seed)


def main_text(pages: DataFrame, model: Labeller, html_col: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keys``, ``text`` and ``n_chars`` of every page; no shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a few hundred kB
    given = pages.select(F.struct(*keys).alias("keys"), F.col(html_col).cast("string").alias("page"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in slices(batches, PAGES):
            found = [blocks(p) for p in batch.column("page").to_pylist()]
            chosen = shared.value.article(found, features)
            texts = [" ".join(text for (_, text, _), good in zip(of, article, strict=True) if good) for of, article in zip(found, chosen, strict=True)]
            # References may name half a code point; what is none can't be text.
            texts = [t if t.isascii() else t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("keys"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["keys", "text", "n_chars"])

    kinds = given.schema["keys"].dataType.simpleString()
    return given.mapInArrow(run, f"keys {kinds}, text string, n_chars bigint").select("keys.*", "text", "n_chars")


def op11_html_blocks(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, fit(pages))
