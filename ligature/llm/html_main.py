"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read as a stream of tags and text; blocks are the texts between block-level tags. A
logistic classifier over a block's features (its words, links, the tags and class names around it)
gives each block a cost of being content and one of being boilerplate: these are the capacities to
the two terminals. Neighbouring blocks are joined by smoothness edges, stronger where they share
their parent element and where they lie close in the tree. The minimum cut, found by maximum flow,
separates content from boilerplate; blocks whose own costs outweigh all of their edges are settled
beforehand, which leaves the cut as it is.

The classifier is trained here: on the library's own small grammar of invented pages, whose blocks
are labelled by construction (train()). Comments, scripts, styles and other elements without
text never give blocks. Null and empty pages, and pages without content blocks, give the empty
text. Unclosed and misnested tags are closed by their ancestors' end; text of any length is kept.
"""

from __future__ import annotations

import html as entities
import random
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligature.llm.common import read, sliced
from ligature.llm.toxicity import logistic

#: Element names of the HTML standard by what they mean here.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video select option datalist textarea button".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose class name tells of their own text, not of a part of the page.
OWN = frozenset("p h1 h2 h3 h4 h5 h6 li td dd dt blockquote pre".split())
APART = frozenset("nav footer aside form menu dialog fieldset header".split())
MAIN = frozenset("article main".split())
#: Parts of class names and ids that pages give their parts.
BAD_NAMES = "ad ads advert advertisement adverts banner sponsor sponsored promo promoted nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments reply replies respond disqus widget widgets pagination pager copyright legal disclaimer form search tags meta byline".split()
GOOD_NAMES = "article content main post entry story body text".split()

_TOKEN = regex.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*>?", regex.S)
_NAME = regex.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_NAMED = regex.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", regex.I)
_HIDDEN = regex.compile(r"""(?:\shidden(?=[\s>=/])|display\s*:\s*none|aria-hidden\s*=\s*["']?true)""", regex.I)
_PART = regex.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_BAD, _GOOD = frozenset(BAD_NAMES), frozenset(GOOD_NAMES)


class Node:
    """A block-level element of the tree."""

    __slots__ = ("parent", "depth")

    def __init__(self, parent: Node | None = None):
        self.parent, self.depth = parent, parent.depth + 1 if parent else 0


def steps_between(a: Node, b: Node, limit: int = 16) -> int:
    """Steps from one element to another in the tree, or ``limit`` if there are as many or more."""
    n = 0
    while a is not b and n < limit:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


class Block:
    __slots__ = ("text", "node", "tag", "linked", "apart", "bad", "good", "main")

    def __init__(self, text, node, tag, linked, apart, bad, good, main):
        self.text, self.node, self.tag, self.linked, self.apart, self.bad, self.good, self.main = text, node, tag, linked, apart, bad, good, main


@lru_cache(100_000)
def _names(tag: str) -> tuple[int, int]:
    """Whether a start tag's class, id or role has a telling name: (bad, good)."""
    words = {w.lower() for m in _NAMED.finditer(tag) for w in _PART.findall(m[1] or m[2] or m[3] or "")}
    bad = bool(words & _BAD) or bool(_HIDDEN.search(tag))
    return int(bad), int(not bad and bool(words & _GOOD))


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks in order."""
    out: list[Block] = []
    # open elements: (name, its block's name and node, apart, bad, good, main, silent)
    stack = [("", ("", Node()), 0, 0, 0, 0, 0)]
    opened: Counter[str] = Counter()
    held: list[str] = []
    linked = links = at = 0

    def close(first: int) -> None:
        opened.subtract(e[0] for e in stack[first:])
        del stack[first:]

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                top = stack[-1]
                out.append(Block(text, top[1][1], top[1][0], min(1.0, linked / max(1, len(text))), top[2], top[3], top[4], top[5]))
            held.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not stack[-1][6]:
            held.append(text)
            if links:
                linked += len(text.strip())

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        tag, at = m[0], m.end()
        name = _NAME.match(tag)
        if not name:
            if tag.startswith("<![CDATA["):
                continue
            continue
        name = name[1].lower()
        if tag[1] == "/":
            if name == "a":
                links = max(0, links - 1)
            if name == "br":
                held.append(" ")
                continue
            if name not in INLINE:
                flush()
            if opened[name] > 0:
                # what the loop passes is closed, but an inline end tag doesn't close blocks
                i = len(stack) - 1
                while stack[i][0] != name and (name not in INLINE or stack[i][0] in INLINE):
                    i -= 1
                if stack[i][0] == name:
                    close(i)
            continue
        if name in RAW:
            end = regex.compile(rf"</{name}\s*>", regex.I).search(page, at)
            at = end.end() if end else n
            if name not in INLINE:
                flush()
            continue
        if name not in INLINE:
            flush() if name != "br" else held.append("\n")
            if name == "br":
                continue
        if name in VOID or tag.endswith("/>") and name in INLINE:
            continue
        if name == "p" or name == "li" or name in ("td", "th", "tr", "dd", "dt"):
            # a start tag that ends its open sibling
            i = len(stack) - 1
            while i > 0 and (stack[i][0] in INLINE or name == "p" and stack[i][0] == "p"):
                i -= 1
            if i + 1 < len(stack) and any(e[0] == "p" for e in stack[i + 1 :]):
                close(i + 1)
        if name == "a":
            links += 1
        top, (bad, good) = stack[-1], _names(tag)
        apart = top[2] or int(name in APART)
        inside = int(name in MAIN) or top[5]
        # a header of an article belongs to it
        if name == "header" and top[5]:
            apart = top[2]
        opened[name] += 1
        block = top[1] if name in INLINE else (name, Node(top[1][1]))
        stack.append((name, block, apart, top[3] | (bad and (2 if name in OWN else 1)), good or (0 if bad else top[4]), inside, top[6] or int(name in SILENT)))
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """A row per block."""
    x = np.zeros((len(found), 11))
    for i, b in enumerate(found):
        n = b.text.count(" ") + 1
        ends = b.text[-1] in ".!?…。\"'»”"
        x[i] = (b.apart, b.bad & 1, b.bad >> 1, b.good, b.main, b.linked, min(n, 60) / 20, n <= 4, ends, b.tag == "li" and b.linked > 0.5, len(b.tag) == 2 and b.tag[0] == "h" and b.tag[1].isdigit())
    return x


#: Strength of smoothness edges, and costs' unit: capacities are whole numbers.
SMOOTH, UNIT = 0.6, 1000


def edges(found: list[Block]) -> list[tuple[int, int, int]]:
    """(i, j, capacity) between neighbouring blocks, and between blocks two apart: halved with each step
    that their elements are apart in the tree beyond two, as siblings are; one with a telling name of
    boilerplate and one without stand CONTRAST steps further apart."""
    out = []
    for gap, weight in ((1, 1.0), (2, 0.5)):
        for i in range(len(found) - gap):
            a, b = found[i], found[i + gap]
            far = steps_between(a.node, b.node) + CONTRAST * (a.bad != b.bad)
            out.append((i, i + gap, int(UNIT * SMOOTH * weight * 2.0 ** -max(0, far - 2))))
    return out


def minimum_cut(source: list[int], sink: list[int], between: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut; capacities are whole numbers.

    Nodes whose terminal costs differ by more than all their edges are settled first; what is left
    goes through maximum flow by shortest augmenting paths."""
    n = len(source)
    around: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for i, j, c in between:
        if c > 0:
            around[i].append((j, c))
            around[j].append((i, c))
    lead = [a - b for a, b in zip(source, sink, strict=True)]
    side: list[bool | None] = [None] * n
    loose = [sum(c for _, c in x) for x in around]
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(lead[i]) > loose[i]:
            side[i] = lead[i] > 0
            for j, c in around[i]:
                if side[j] is None:
                    lead[j] += c if side[i] else -c
                    loose[j] -= c
                    queue.append(j)
    free = [i for i in range(n) if side[i] is None]
    if not free:
        return [bool(s) for s in side]
    s, t = n, n + 1
    room: dict[int, dict[int, int]] = {i: {} for i in [*free, s, t]}
    for i in free:
        for a, b, c in ((s, i, max(0, lead[i])), (i, t, max(0, -lead[i]))):
            room[a][b], room[b][a] = c, room[b].get(a, 0)
        for j, c in around[i]:
            if side[j] is None:
                room[i][j] = room[i].get(j, 0) + c
    while True:
        came, queue = {s: s}, deque([s])
        while queue and t not in came:
            i = queue.popleft()
            for j, c in room[i].items():
                if c > 0 and j not in came:
                    came[j] = i
                    queue.append(j)
        if t not in came:
            break
        path, j = [], t
        while j != s:
            path.append((came[j], j))
            j = came[j]
        push = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= push
            room[b][a] = room[b].get(a, 0) + push
    for i in free:
        side[i] = i in came
    return [bool(x) for x in side]


def invented_pages(n: int, seed: int = 7, odd: float = 0.0) -> Iterator[tuple[str, list[tuple[str, bool]]]]:
    """Pages from a small grammar, with each block's text and whether it is content. The share ``odd`` of
    content bears a name of boilerplate, and of boilerplate no name at all."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randint(1, 9)))
    say = lambda a, b, end="": " ".join(word() for _ in range(r.randint(a, b))) + end
    for _ in range(n):
        told: list[tuple[str, bool]] = []

        def put(text: str, content: bool, told=told) -> str:
            told.append((text, content))
            return text

        def listed(told=told) -> str:
            return "<ul>" + "".join(f"<li><a href='/{word()}'>{put(say(1, 3), False)}</a></li>" for _ in range(r.randint(2, 7))) + "</ul>"

        def apart() -> str:
            kind = r.choice(["nav", "footer", "aside", "form", "class", "class", "class"])
            tag, name = ("div", f" class='{r.choice(BAD_NAMES)}'") if kind == "class" else (kind, "")
            if odd and r.random() < odd:
                tag, name = "div", ""
            inner = listed() if r.random() < 0.4 else "".join(f"<p>{put(say(1, 25, r.choice(['.', '', '!'])), False)}</p>" for _ in range(r.randint(1, 3)))
            return f"<{tag}{name}>{inner}</{tag}>"

        parts = [apart() for _ in range(r.randint(0, 3))]
        tag = r.choice(["article", "article", "main", "div class='content'", "div class='post'", "div", "section"])
        body = [f"<h1>{put(say(2, 10), True)}</h1>"]
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.1:
                body.append(f"<h2>{put(say(1, 6), True)}</h2>")
            elif kind < 0.2:
                body.append("<ul>" + "".join(f"<li>{put(say(2, 12), True)}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif kind < 0.28:
                body.append(apart())
            elif odd and r.random() < 3 * odd:
                body.append(f"<p class='{r.choice(BAD_NAMES)}'>{put(say(1, 25, r.choice(['.', '', '!'])), False)}</p>")
            else:
                mark = f" class='{r.choice(BAD_NAMES)}'" if odd and r.random() < odd else ""
                body.append(f"<p{mark}>{put(say(1, 60, '.'), True)}</p>")
        parts.append(f"<{tag}>{''.join(body)}</{tag.split()[0]}>")
        parts += [apart() for _ in range(r.randint(0, 3))]
        yield f"<html><body>{''.join(parts)}</body></html>", told


#: Steps in the tree that a difference of names counts as.
CONTRAST = 3
#: Share of odd blocks in the pages that the classifier learns from, so that no sign is certain and
#: neighbours can outweigh it.
ODD = 0.03


@lru_cache(1)
def train(n: int = 400) -> tuple[float, ...]:
    """Weights and intercept of the block classifier."""
    x, y = [], []
    for page, told in invented_pages(n, odd=ODD):
        found = blocks(page)
        if [b.text for b in found] == [t for t, _ in told]:
            x.append(features(found))
            y += [c for _, c in told]
    return logistic(np.concatenate(x), np.array(y, float), ridge=0.005)


def content(page: str | None, weights: tuple[float, ...]) -> list[str]:
    """The page's content blocks in order."""
    found = blocks(page or "")
    if not found:
        return []
    odds = features(found) @ np.array(weights[:-1]) + weights[-1]
    odds = np.clip(odds, -12, 12)
    keep = (np.logaddexp(0, odds) * UNIT).astype(int).tolist()  # the cost of calling it boilerplate
    drop = (np.logaddexp(0, -odds) * UNIT).astype(int).tolist()
    labels = minimum_cut(keep, drop, edges(found))
    return [b.text for b, c in zip(found, labels, strict=True) if c]


def html_main(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text."""
    weights = train()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [" ".join(content(p.as_py(), weights)) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(extract, "page_id long, url string, text string")


def op3_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_main(read(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
