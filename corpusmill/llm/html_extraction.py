"""Main-text extraction as a minimum cut.

A page is read into text blocks. A classifier (logistic regression, trained here
on generated labelled pages) gives each block a probability of being main text;
its negative logarithms are the capacities to source and sink. Edges between
blocks that follow one another, and between consecutive blocks of one container,
make it costly to part them: more the nearer they are in the document tree. The
maximum flow from source to sink parts main text from boilerplate at least cost.
Hidden elements and form controls are never text.

A null, empty or textless page gives an empty text and 0 characters. Broken
markup is read on as far as possible; pages of any length are read whole.
Repeated rows give repeated results, an empty table an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import deque
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._html import Block, Element, blocks
from ._memory import mapped
from ._store import table

_BOILER_TAGS = {"nav": 0, "footer": 1, "aside": 2, "form": 3, "header": 4, "menu": 0, "button": 3, "select": 3, "dialog": 2, "fieldset": 3, "option": 3, "legend": 3}
_MAIN_TAGS = frozenset(("article", "main"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CONTROLS = frozenset(("button", "select", "option"))
_BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notice|alert|sidebar|side|widget|menu|nav(?:bar|igation)?|breadcrumbs?|foot(?:er)?|masthead|header|topbar|toolbar|share|sharing|social|related|recommended|popular|trending|subscribe|newsletter|signup|login|search|popup|modal|overlay|pagination|pager|tags|copyright|legal|disclaimer|skip|complementary|contentinfo)(?:$|[\s_\d-])"
)
_COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|replies|reply|respond|responses?|discussion)(?:$|[\s_\d-])|comment")
_MAIN = re.compile(r"(?:^|[\s_-])(?:article(?:body)?|content|main|post(?:body)?|entry|story|text|body|prose|page)(?:$|[\s_\d-])")
_MARKS = re.compile(r"[.,;:!?]")

FEATURES = 16


def inherited(element: Element) -> tuple[list[float], bool, bool]:
    """The features that an element passes on to its text, whether it lies in the article, and in a form's control; kept with each element."""
    open_: list[Element] = []
    e: Element | None = element
    while e is not None and e.inherited is None:
        open_.append(e)
        e = e.parent
    x, inside, control = ([1.0] + [0.0] * (FEATURES - 1), False, False) if e is None else e.inherited
    for e in reversed(open_):  # from the root inwards
        x = list(x)
        if e.tag in _MAIN_TAGS or e.names and "article" in e.names.split():
            x[1], inside = 1.0, True
            x[6] = 0.0
        if (k := _BOILER_TAGS.get(e.tag)) is not None and not (e.tag == "header" and inside):
            x[2 + k] = 1.0
        if e.names and e.tag not in ("body", "html"):
            if _COMMENT.search(e.names):
                x[8] = 1.0
            elif _BOILER.search(e.names):
                x[7] = 1.0
            elif _MAIN.search(e.names):
                x[9] = 1.0
        control = control or e.tag in _CONTROLS
        e.inherited = x, inside, control
    return element.inherited


def features(block: Block) -> np.ndarray:
    x = np.array(inherited(block.element)[0])
    size = len(block.text)
    x[10] = min(1.0, block.linked / size)
    x[11] = min(1.0, math.log1p(size) / 7)
    x[12] = min(1.0, 10 * len(_MARKS.findall(block.text)) / size)
    x[13] = block.element.tag in _HEADINGS
    x[14] = block.element.tag in ("p", "blockquote", "pre", "td", "th", "dd")
    x[15] = block.element.tag == "li"
    return x


def labelled_pages(seed: int = 3, pages: int = 400) -> list[tuple[str, list[int]]]:
    """Generated pages, and for each text block whether it is main text: the classifier's training set."""
    rng = random.Random(seed)
    syllables = "ta re mi lo sun ber ka ven dor is el an po qu tri mes ol en ge ur".split()

    def words(low: int, high: int) -> str:
        out = " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) + rng.choice(("", "", "", "", ",", ".")) for _ in range(rng.randint(low, high)))
        return out[:1].upper() + out[1:]

    found = []
    for _ in range(pages):
        out, marks = [], []

        def add(text: str, main: int) -> None:
            out.append(text)
            marks.append(main)

        def many(kind: str, low: int, high: int, main: int) -> None:
            for _ in range(rng.randint(low, high)):
                link = rng.random() < 0.9 and not main
                add(f"<{kind}><a href='/x'>{words(1, 4)}</a></{kind}>" if link else f"<{kind}>{words(1, 60)}</{kind}>", main)

        head = rng.choice(("<header>", "<div class='header'>", "<div id='masthead'>", ""))
        if head:
            out.append(head)
            add(f"<div>{words(1, 6)}</div>", 0)
            out.append("</header>" if head == "<header>" else "</div>")
        out.append(rng.choice(("<nav><ul>", "<ul class='menu'>", "<div class='navigation'><ul>")))
        many("li", 3, 9, 0)
        out.append("</ul></div></nav>")
        for kind in rng.sample(("ad", "cookie-notice", "share", "banner", "promo"), rng.randint(0, 2)):
            add(f"<div class='{kind}'>{words(2, 40)}</div>", 0)
        opening, ending = rng.choice((("<article>", "</article>"), ("<main>", "</main>"), ("<div class='content'>", "</div>"), ("<div class='post'>", "</div>"), ("<div>", "</div>"), ("<main><article>", "</article></main>")))
        out.append(opening)
        add(f"<h1>{words(2, 12)}</h1>", 1)
        for i in range(rng.randint(1, 9)):
            roll = rng.random()
            if roll < 0.08:
                add(f"<h2>{words(1, 8)}</h2>", 1)
            elif roll < 0.16:
                out.append("<ul>")
                for _ in range(rng.randint(1, 5)):
                    add(f"<li>{words(2, 25)}</li>", 1)
                out.append("</ul>")
            elif roll < 0.22 and i:
                add(f"<div class='{rng.choice(('ad', 'related', 'share', 'newsletter'))}'>{words(2, 30)}</div>", 0)
            elif roll < 0.26 and i:
                add(f"<aside><p>{words(3, 40)}</p></aside>", 0)
            else:
                text = words(1, 120)
                add(f"<p>{text[: len(text) // 2]}<a href='/y'>{words(1, 3)}</a>{text[len(text) // 2 :]}</p>" if rng.random() < 0.2 else f"<p>{text}</p>", 1)
        if rng.random() < 0.3:
            out.append("<section class='comments'>")
            for _ in range(rng.randint(1, 5)):
                add(f"<p>{words(3, 60)}</p>", 0)
            out.append("</section>")
        out.append(ending)
        if rng.random() < 0.3:
            out.append("<div id='comments'>")
            for _ in range(rng.randint(1, 4)):
                add(f"<div class='comment'>{words(3, 60)}</div>", 0)
            out.append("</div>")
        if rng.random() < 0.4:
            out.append(rng.choice(("<aside>", "<div class='sidebar'>")))
            for _ in range(rng.randint(1, 4)):
                add(f"<p>{words(2, 40)}</p>", 0)
            out.append("</div></aside>")
        if rng.random() < 0.3:
            out.append("<form>")
            add(f"<p>{words(1, 12)}</p>", 0)
            out.append("</form>")
        out.append(rng.choice(("<footer>", "<div class='footer'>", "<div id='footer'>")))
        add(f"<p>{words(1, 40)}</p>", 0)
        found.append(("".join(out), marks))
    return found


@cache
def weights() -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge on the blocks of labelled_pages()."""
    rows, marks = [], []
    for page, own in labelled_pages():
        got = blocks(page)
        assert len(got) == len(own)
        rows += [features(b) for b in got]
        marks += own
    x, y = np.array(rows), np.array(marks, dtype=float)
    w = np.zeros(FEATURES)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve(x.T * (p * (1 - p)) @ x + 0.5 * np.eye(FEATURES), x.T @ (y - p) - 0.5 * w)
    return w


def min_cut(to_source: list[float], to_sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source: Dinic's maximum flow over symmetric edges, then what the source still reaches."""
    n = len(to_source)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def link(a: int, b: int, ab: float, ba: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(ab)
        head[b].append(len(to))
        to.append(a)
        room.append(ba)

    for i in range(n):
        direct = min(to_source[i], to_sink[i])  # this flow goes straight through
        if to_source[i] > direct:
            link(s, i, to_source[i] - direct, 0.0)
        if to_sink[i] > direct:
            link(i, t, to_sink[i] - direct, 0.0)
    for a, b, c in edges:
        link(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        next_ = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if room[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while next_[a] < len(head[a]):
                e = head[a][next_[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                next_[a] += 1
            if next_[a] < len(head[a]):
                path.append(head[a][next_[a]])
                a = to[path[-1]]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                next_[a] += 1
            else:
                break


#: The cost of parting neighbours whose nearest common ancestor is 0, 1, 2 ... steps above their parents.
SMOOTH = (0.8, 0.3, 0.1)


def around(block: Block) -> dict[int, int]:
    """The nearest elements around a block's own, by number, and how many steps above its parent they are."""
    found, e = {}, block.element.parent
    while e is not None and len(found) < len(SMOOTH):
        found[e.number] = len(found)
        e = e.parent
    return found


def main_blocks(found: list[Block]) -> list[Block]:
    found = [b for b in found if not inherited(b.element)[2]]
    if not found:
        return []
    p = 1 / (1 + np.exp(-np.clip(np.array([features(b) for b in found]) @ weights(), -30, 30)))
    p = np.clip(p, 1e-6, 1 - 1e-6)
    edges, last, before = [], {}, {}
    for i, b in enumerate(found):
        own = around(b)
        up = next((max(d, own[k]) for k, d in before.items() if k in own), None) if i else None
        if up is not None:
            edges.append((i - 1, i, SMOOTH[up]))
        parent = b.element.parent.number if b.element.parent else 0
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, SMOOTH[0] / 2))
        last[parent], before = i, own
    kept = min_cut((-np.log(1 - p)).tolist(), (-np.log(p)).tolist(), edges)
    return [b for b, k in zip(found, kept) if k]


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in main_blocks(blocks(page or "")))


def _extract() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars. One pass, no shuffle."""
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return mapped(own, _extract(), "page_id bigint, url string, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
