"""Main text of HTML pages by a tree-structured graphical model.

Every element of a page's tree is content or not. Node potentials come from what an element shows (its tag, names in
class, id and role, length and link share of its text), edge potentials from parent and child. Sum-product messages
go from the leaves up and from the root down; an element whose marginal is at least one half gives its own text.

Both kinds of potentials are smoothed counts over labelled pages. The pages have no labels of their own, so ``label`` marks
them by markup: inside ``article`` or ``main`` and outside all boilerplate. Up to ``sample`` pages (2,048; smallest hashes) are counted.

Two potentials are fixed. An element of page furniture, by its tag or by a name of ``NAMES``, has ``SEALED`` less log odds of its
own. It hears nothing from its children, however many they are, and if it is not content, nothing below it is. A name does not
make furniture of what frames the page: html, body, whatever holds a ``main``, and an outer article with half of the page's
text with all that holds it. Inside an article, a tag that no labelled article had speaks neither for nor against an element: lists,
tables and quotes follow their parent.

Text: character references decoded, white space inside a block as one space, blocks joined by one space, in page
order. Scripts, styles, templates, form controls and the head never give text, nor do forms, but for one that holds an article or half
of the page's text.

Nulls: a null or empty page has an empty text. Broken markup is read as far as it goes: unclosed elements end with
their parent, stray end tags are left out, an unclosed comment or script reaches to the end. Pages without id and repeated pages
all come out. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.kernel import chunks

SAMPLE = 2048
_SMOOTH = 0.5
SEALED = 12.0  # log odds: strong in itself, whatever the sample held
# Element names of HTML by their role, and words that name page furniture
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
NEVER = frozenset("head script style textarea title noscript template iframe form button select option svg math object".split())
FURNITURE = frozenset("nav header footer aside menu dialog".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
NAMES = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright dialog disclaimer discussion "
    "disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup "
    "privacy promo promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "teaser toolbar tracking warning widget".split()
)
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_NAME = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|[\s"'/])(?:hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_WORDS = re.compile(r"[a-z]+")


class Page:
    """Elements in page order: tag, parent, names; and pieces of text (element, block break before it, text)."""

    def __init__(self, source: str):
        self.tags, self.parents, self.names = ["#page"], [-1], [frozenset()]
        self.pieces: list[tuple[int, str]] = []
        self.direct = [0]
        self._read(source)

    def _text(self, node: int, text: str) -> None:
        if text:
            self.pieces.append((node, entities.unescape(text) if "&" in text else text))
            self.direct[node] += len(text)

    def _read(self, source: str) -> None:
        stack, at = [0], 0
        pieces, tags = self.pieces, self.tags
        while True:
            m = _TAG.search(source, at)
            if m is None:
                self._text(stack[-1], source[at:])
                return
            self._text(stack[-1], source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name, rest = name.lower(), m[3] or m[6] or ""
            if m[1] or m[4]:
                if name not in INLINE:
                    pieces.append((stack[-1], " "))
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == name:
                        del stack[k:]
                        break
                continue
            if name not in INLINE:
                pieces.append((stack[-1], " "))
            if name in ENDS_P:
                self._close(stack, {"p"}, {"table", "td", "th", "button", "object"})
            elif name in CLOSES:
                self._close(stack, CLOSES[name], WALLS[name])
            node = len(tags)
            tags.append(name)
            self.parents.append(stack[-1])
            self.direct.append(0)
            self.names.append(self._names(rest))
            if name in VOID or rest.endswith("/") and name in ("svg", "math", "path"):
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            stack.append(node)

    def _close(self, stack: list[int], names: set[str], walls: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[k]]
            if tag in names:
                del stack[k:]
                return
            if tag in walls:
                return

    @staticmethod
    def _names(rest: str) -> frozenset:
        if not rest:
            return frozenset()
        found = {w for m in _NAME.finditer(rest) for w in _WORDS.findall((m[2] or m[3] or m[4] or "").lower())} & NAMES
        return frozenset(found | {"#hidden"}) if _HIDDEN.search(rest) else frozenset(found)

    def features(self) -> list[tuple[str, ...]]:
        """What each element shows."""
        n = len(self.tags)
        total, linked = list(self.direct), [0] * n
        for i in range(n - 1, 0, -1):
            total[self.parents[i]] += total[i]
            linked[self.parents[i]] += total[i] if self.tags[i] == "a" else linked[i]
        return [
            (
                f"tag:{self.tags[i]}", "named" if self.names[i] else "plain", f"own:{min(self.direct[i], 4096).bit_length() // 3}",
                f"links:{int(4 * linked[i] / total[i]) if total[i] else 'none'}",
            )
            for i in range(n)
        ]

    def furniture(self) -> list[bool]:
        """Elements of page furniture: by tag, or by name unless they frame the page."""
        n = len(self.tags)
        total, frame, outer = list(self.direct), [t in ("#page", "html", "body", "main") for t in self.tags], [True] * n
        for i in range(n - 1, 0, -1):
            total[self.parents[i]] += total[i]
        for i in range(1, n):
            p = self.parents[i]
            outer[i] = outer[p] and self.tags[p] not in ("article", "main")
            frame[i] |= self.tags[i] == "article" and outer[i] and 2 * total[i] >= total[0]
        for i in range(n - 1, 0, -1):
            frame[self.parents[i]] |= frame[i]
        return [self.tags[i] in FURNITURE or bool(self.names[i]) and not frame[i] for i in range(n)]

    def silent(self) -> list[bool]:
        """Elements that never give text. A form does if it holds an article, or half of the page's text: then it frames the page."""
        n = len(self.tags)
        total, holds = list(self.direct), [t in ("article", "main") for t in self.tags]
        for i in range(n - 1, 0, -1):
            total[self.parents[i]] += total[i]
            holds[self.parents[i]] |= holds[i]
        return [t in NEVER and not (t == "form" and (holds[i] or 0 < total[0] <= 2 * total[i])) for i, t in enumerate(self.tags)]

    def inside(self) -> list[bool]:
        """Elements inside article or main."""
        out = [False]
        for tag, p in zip(self.tags[1:], self.parents[1:]):
            out.append(out[p] or tag in ("article", "main"))
        return out

    def labels(self) -> list[int]:
        """1 for elements inside article or main and outside boilerplate; by markup alone."""
        out, gone, furniture, silent, inside = [], [False], self.furniture(), self.silent(), self.inside()
        for i, p in enumerate(self.parents):
            if i:
                gone.append(gone[p] or silent[i] or furniture[i])
            out.append(int(inside[i] and not gone[i]))
        return out


def count(page: Page, tally: Counter) -> None:
    labels = page.labels()
    for i, (shown, y) in enumerate(zip(page.features(), labels)):
        tally["node", "", y] += 1
        for f in shown:
            tally["node", f, y] += 1
        if i:
            tally["edge", str(labels[page.parents[i]]), y] += 1


class Model:
    """Log potentials: score of content against not for each feature, and a table for parent and child."""

    def __init__(self, tally: dict):
        ones, zeros = tally.get(("node", "", 1), 0), tally.get(("node", "", 0), 0)
        self.prior = math.log((ones + _SMOOTH) / (zeros + _SMOOTH))
        self.shown: dict[str, float] = {}
        self.seen = {f for kind, f, y in tally if kind == "node" and y == 1 and tally[kind, f, y]}
        for kind, f, _ in list(tally):
            if kind == "node" and f:
                a, b = tally.get((kind, f, 1), 0), tally.get((kind, f, 0), 0)
                self.shown[f] = math.log((a + _SMOOTH) / (ones + 2 * _SMOOTH)) - math.log((b + _SMOOTH) / (zeros + 2 * _SMOOTH))
        edge = [[tally.get(("edge", str(p), c), 0) + _SMOOTH for c in (0, 1)] for p in (0, 1)]
        # P(child | parent) over P(child): what the parent says beyond the child's prior
        base = [edge[0][c] + edge[1][c] for c in (0, 1)]
        self.edge = [[math.log(edge[p][c] / sum(edge[p])) - math.log(base[c] / sum(base)) for c in (0, 1)] for p in (0, 1)]

    def marginals(self, page: Page) -> list[float]:
        """Log odds of content for each element, by sum-product messages up and down the tree; none go up into page furniture."""
        n, parents, furniture = len(page.tags), page.parents, page.furniture()
        # a tag that no labelled article had says nothing against an element inside one
        told = [[f for f in shown if not (within and f.startswith("tag:") and f not in self.seen)] for shown, within in zip(page.features(), page.inside())]
        own = [self.prior + sum(self.shown.get(f, 0.0) for f in shown) - SEALED * sealed for shown, sealed in zip(told, furniture)]
        e = self.edge
        up, message = own, [0.0] * n
        for i in range(n - 1, 0, -1):
            if not furniture[parents[i]]:
                message[i] = _pass(up[i], e[0][0], e[0][1], e[1][0], e[1][1])
                up[parents[i]] += message[i]
        out = list(up)
        for i in range(1, n):
            without = out[parents[i]] - message[i]
            out[i] = up[i] + _pass(without, e[0][0], e[1][0], e[0][1], e[1][1])
        return out

    def text(self, page: Page) -> str:
        odds, furniture, silent = self.marginals(page), page.furniture(), page.silent()
        gone = [False] * len(page.tags)
        for i in range(1, len(gone)):
            gone[i] = gone[page.parents[i]] or silent[i] or furniture[i] and odds[i] < 0
        blocks = [text if text == " " or (odds[i] >= 0 and not gone[i]) else "" for i, text in page.pieces]
        return " ".join("".join(blocks).split())


def _pass(odds: float, a0: float, a1: float, b0: float, b1: float) -> float:
    """Log odds of a message over an edge: sums over the sender's two states; a: receiver not content, b: content."""
    return _plus(b0, b1 + odds) - _plus(a0, a1 + odds)


def _plus(x: float, y: float) -> float:
    high = x if x > y else y
    return high + math.log1p(math.exp((y if x > y else x) - high))


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Model:
    """Potentials from at most ``sample`` pages; counts are summed in Spark."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html")).filter("html IS NOT NULL")
    chosen = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample).withColumnRenamed("id", "chosen")
    picked = rows.join(F.broadcast(chosen), F.col("id") == F.col("chosen")).select("html")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for batch in batches:
            for source in batch.column("html").to_pylist():
                count(Page(source), tally)
        kind, name, label = zip(*tally) if tally else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.string()), pa.array(name, pa.string()), pa.array(label, pa.int32()), pa.array(list(tally.values()), pa.int64())],
            names=["kind", "name", "label", "n"],
        )

    counted = picked.mapInArrow(work, "kind string, name string, label int, n long").groupBy("kind", "name", "label").agg(F.sum("n").alias("n"))
    return Model({(r.kind, r.name, r.label): r.n for r in counted.collect()})  # one row per feature


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                texts = [model.text(Page(source)) if source else "" for source in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = rows.mapInArrow(work, "id long, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
