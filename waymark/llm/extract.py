"""HTML extraction by tag-path ratios: text and punctuation per root-to-leaf tag path, smoothed and fused."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import rows_of

# Fixed values of HTML: elements by how they are written and what they hold.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: Elements that end an open element of the same list; the list's own elements, which bound the search.
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDS = {"ul": ("li",), "ol": ("li",), "menu": ("li",), "dl": ("dt", "dd"), "table": ("tr", "td", "th"), "tr": ("td", "th"), "select": ("option",)}
#: Elements that hold one paragraph, item or cell; a container lies above them.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead ul ol dl pre blockquote figcaption summary table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
#: Elements that stand around an article, and those that mostly do.
STRONG_SIDE = frozenset("nav footer aside button dialog menu head select textarea option title".split())
WEAK_SIDE = frozenset("form object svg math canvas template noscript iframe xmp noembed noframes".split())
#: Words in class, id and role values that speak for something around an article, or for the article.
SIDE_WORDS = frozenset(
    """ad ads advert adverts advertisement banner breadcrumb breadcrumbs button comment comments consent cookie cookies copyright discussion disqus footer gdpr
    legal login masthead menu menubar modal nav navbar navigation newsletter notice overlay pagination paywall popup promo promoted recommended related
    replies reply rss search share sharing sidebar signup social sponsor sponsored subscribe tags teaser toc toolbar topbar ugc widget widgets
    complementary contentinfo alert dialog""".split()
)
MAIN_WORDS = frozenset("article content entry main post story".split())
#: Parts of a class that tell a state or a topic of the element, not what it is.
STATES = frozenset("has with no not without is enabled disabled tag category".split())
PUNCTUATION = re.compile(r"[.,;:!?¿¡…。，、；：！？·]")
#: A notice, not a sentence about copyright.
COPYRIGHT = re.compile(r"(?:copyright\s*)?(?:©|\(c\)\s*\d{4}|copyright\s+\d{4}|all rights reserved)", re.I)
#: What the heading of readers' comments says.
COMMENTS = re.compile(r"(?:\d+\s+|reader\W*s?\s+|user\s+|your\s+)?(?:comments?|kommentare|commentaires|comentarios|replies|responses)(?:\s*\(?\d+\)?)?:?", re.I)

#: Weights of marks in a path's score, the share of the mean that a path must reach, and what may remain beside marks.
WEAK, STRONG, GOOD, THRESHOLD, REMAINS = 0.1, 0.02, 2.0, 0.3, 0.05
#: A container beside the largest one below the root is a minor one if it has less than this share of its text.
MINOR = 0.1

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_VALUES = re.compile(r"""[^>"']++|"[^"]*+"|'[^']*+'""")
_ATTRIBUTES = re.compile(rf"(?:{_VALUES.pattern})*+")
_MARKS = re.compile(r"""\b(class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""", re.I)
_PART = re.compile(r"[a-z]+")


@dataclass
class Paths:
    """The tag paths of a page as a tree, parents first; path 0 is the page itself."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    mark: list[int] = field(default_factory=lambda: [0])  # 2 stands around an article, 1 may do so
    good: list[bool] = field(default_factory=lambda: [False])
    known: dict[tuple, int] = field(default_factory=dict)
    above: list[int] = field(default_factory=lambda: [-1])  # of each element its parent's number
    at: list[int] = field(default_factory=lambda: [0])  # and its path

    def element(self, parent: int, path: int) -> int:
        self.above.append(parent)
        self.at.append(path)
        return len(self.at) - 1

    def under(self, parent: int, tag: str, name: str, mark: int, good: bool) -> int:
        key = (parent, tag, name, mark, good)
        if (at := self.known.get(key)) is None:
            at = self.known[key] = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
            self.mark.append(mark)
            self.good.append(good)
        return at


@dataclass
class Block:
    """A run of text between block elements."""

    path: int
    element: int
    text: list[str] = field(default_factory=list)
    linked: int = 0


@dataclass
class Node:
    tag: str
    path: int
    element: int
    link: bool
    p_at: int  # where on the stack a paragraph is open that a block element ends, or -1
    main: bool
    ends: dict[str, int]  # where items, cells and rows are open that another one ends
    inline: dict[str, int]  # how many inline elements of a name are open since the last block element


def _class_words(attributes: str) -> tuple[str, set[str]]:
    """The first class as a name, and the words of class, id and role that say what the element is."""
    name, words = "", set()
    for kind, value in _MARKS.findall(attributes):
        for token in value.strip("\"'").lower().split():
            parts = _PART.findall(token)
            if parts and not STATES.intersection(parts):
                words.update(parts)
                if not name and kind.lower() == "class":
                    name = "-".join(parts)
    return name, words


def read_page(page: str) -> tuple[list[Block], Paths]:
    """The page's text blocks in order, and their tag paths (inline elements left out).

    One pass that never goes back. What an end tag walks over it also ends, so work is in proportion to
    the page, whatever is open, nested or unclosed.
    """
    paths, out, now, at, end = Paths(), [], None, 0, len(page)
    stack = [Node("", 0, 0, False, -1, False, {}, {})]
    opened: dict[str, int] = {}
    never: set[str] = set()  # raw elements whose end tag does not come any more

    def add(text: str) -> None:
        nonlocal now
        if "&" in text:
            text = html.unescape(text)
        top = stack[-1]
        if now is None or now.element != top.element:
            now = Block(top.path, top.element)
            out.append(now)
        now.text.append(text)
        if top.link:
            now.linked += len(text)

    def cut(k: int) -> None:
        for n in stack[k:]:
            opened[n.tag] -= 1
            if n.tag in INLINE:
                n.inline[n.tag] -= 1
        del stack[k:]

    def push(node: Node) -> None:
        stack.append(node)
        opened[node.tag] = opened.get(node.tag, 0) + 1
        if node.tag in INLINE:
            node.inline[node.tag] = node.inline.get(node.tag, 0) + 1

    while at < end:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        if start > at:
            add(page[at:start])
        if page.startswith("<!--", start):
            close = page.find("-->", start + 4)
            at = end if close < 0 else close + 3
            continue
        closing = page.startswith("/", start + 1)
        m = _NAME.match(page, start + 1 + closing)
        if m is None:
            if closing or page.startswith(("!", "?"), start + 1):
                close = page.find(">", start)
                at = end if close < 0 else close + 1
            else:
                add("<")
                at = start + 1
            continue
        tag, begin = m[0].lower(), m.end()
        stop = _ATTRIBUTES.match(page, begin).end()
        if stop < end and page[stop] != ">":  # a quote that is not closed is a character
            close = page.find(">", stop)
            stop = end if close < 0 else close
        attributes, at = page[begin:stop], min(end, stop + 1)
        if closing:
            # What is walked over is cut: an end tag that ends nothing is told without a walk.
            if (stack[-1].inline if tag in INLINE else opened).get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        cut(k)
                        break
            if tag not in INLINE:
                now = None
            continue
        if tag in VOID:
            if tag == "br":
                if now is not None:
                    now.text.append("\n")
            elif tag == "hr":
                now = None
            continue
        if tag in RAW and not attributes.rstrip().endswith("/"):
            close = None if tag in never else re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*+>?", re.I).search(page, at)
            if close or tag in ("script", "style"):
                at, now = close.end() if close else end, None
                continue
            never.add(tag)
        if tag in CLOSES_P and stack[-1].p_at > 0:
            cut(stack[-1].p_at)
        if tag in SAME:
            places = [stack[-1].ends[t] for t in SAME[tag] if t in stack[-1].ends]
            if places:
                cut(min(places))
        top, k = stack[-1], len(stack)
        if tag in INLINE:
            push(Node(tag, top.path, top.element, top.link or tag == "a", top.p_at, top.main, top.ends, top.inline))
            continue
        now = None
        name, words = _class_words(attributes) if attributes else ("", set())
        page_itself = tag in ("html", "body")
        strong = tag in STRONG_SIDE or (tag == "header" and not top.main)
        weak = not page_itself and tag not in MAIN and (tag in WEAK_SIDE or bool(words & SIDE_WORDS))
        main = tag in MAIN
        good = main or bool(words & MAIN_WORDS)
        ends = top.ends
        if tag in SAME:
            ends = {**ends, tag: k}
        if tag in BOUNDS:
            ends = {t: v for t, v in ends.items() if t not in BOUNDS[tag]}
        path = paths.under(top.path, tag, "" if page_itself else name, 2 if strong else 1 if weak else 0, good and not page_itself)
        push(Node(tag, path, paths.element(top.element, path), top.link, k if tag == "p" else -1, top.main or main, ends, {}))
    return out, paths


def _up(values: np.ndarray, parent: list[int]) -> np.ndarray:
    """Sums over each path and all below it."""
    total = values.tolist()
    for k in range(len(parent) - 1, 0, -1):
        total[parent[k]] += total[k]
    return np.array(total)


def _down(own: list, parent: list[int], join) -> list:
    """Each path's value joined with those above it."""
    out = list(own)
    for k in range(1, len(parent)):
        out[k] = join(out[parent[k]], out[k])
    return out


def path_scores(of: np.ndarray, texts: list[str], free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each path's fused ratio (0 without a block), and its text that is no link, from its blocks in page order.

    ``of`` is each block's path, ``free`` its share of text outside links, ``n`` the number of paths.
    """
    length = np.array([len(t) for t in texts], np.float64)
    points = np.array([len(PUNCTUATION.findall(t)) for t in texts], np.float64)
    nodes = np.maximum(np.bincount(of, minlength=n), 1)
    fused = np.ones(len(texts))
    for value in (length, points + 1):
        series = np.pad((np.bincount(of, value * free, n) / nodes)[of], 1, mode="edge")
        fused *= np.convolve(series, (0.1, 0.8, 0.1), "valid")
    score = np.bincount(of, np.sqrt(fused) * length, n) / np.maximum(np.bincount(of, length, n), 1)
    return score, np.bincount(of, length * free, n)


def _above(path: int, top: int, parent: list[int]) -> Iterator[int]:
    """A path and those above it, up to ``top``, which is left out."""
    while path > top:
        yield path
        path = parent[path]


def _common(one: int, other: int, parent: list[int]) -> int:
    """The deepest path that both lie in; parents have smaller numbers."""
    while one != other:
        one, other = (parent[one], other) if one > other else (one, parent[other])
    return one


def _comments(blocks: list[Block], texts: list[str], paths: Paths) -> list[bool]:
    """Of each element whether it lies in one that begins with a heading of readers' comments, and holds no first heading or article."""
    own, seen = set(), [False] * len(paths.at)
    for block, text in zip(blocks, texts, strict=True):
        if not text:
            continue
        around = paths.above[block.element]
        if paths.tag[block.path] in HEADINGS and around > 0 and not seen[around] and COMMENTS.fullmatch(text):
            own.add(around)
        e = block.element
        while e > 0 and not seen[e]:
            seen[e] = True
            e = paths.above[e]
    if not own:
        return [False] * len(seen)
    holds = [paths.tag[p] in MAIN or paths.tag[p] in ("h1", "html", "body") for p in paths.at]
    for e in range(len(holds) - 1, 0, -1):
        holds[paths.above[e]] |= holds[e]
    own = {e for e in own if not holds[e]}
    inside = [False] * len(paths.at)
    for e in range(1, len(inside)):
        inside[e] = e in own or inside[paths.above[e]]
    return inside


def content_blocks(page: str) -> list[str]:
    """The texts of the page's content blocks, in page order.

    1. Ratios: for each tag path the mean text length and the mean punctuation per node, both
       damped by the share of linked text; smoothed over neighbouring blocks and fused by their
       geometric mean.
    2. Marks (element names, words of class, id and role) are weights in the fused score. Those that
       may err are void where the marked path holds an article, or a first heading and much of the
       text, or where next to nothing would remain beside them.
    3. Paths that reach a share of the mean score (weighted by text) are content paths.
    4. The root is the deepest article or main element with half of the content, else the deepest
       path that all content paths have in common, and the first heading with them, if that is a container
       of its own. Content nodes are the blocks below it, less marked subtrees without a content path.
       If the root is no article, less elements right below it, too, that mostly link, and (unless it is
       the first heading's container) that hold no content path or are minor beside the largest, and come
       before the first heading or content block or after the last content block; and less a last
       copyright notice.

    Parts that begin with a heading of readers' comments are left out before.
    """
    blocks, paths = read_page(page)
    texts = [" ".join("".join(b.text).split()) for b in blocks]
    said = _comments(blocks, texts, paths)
    live = [k for k, t in enumerate(texts) if t and not said[blocks[k].element]]
    if not live:
        return []
    parent, n = paths.parent, len(paths.parent)
    of = np.array([blocks[k].path for k in live])
    length = np.array([len(texts[k]) for k in live], np.float64)
    free = np.array([1 - min(1.0, blocks[k].linked / max(len(texts[k]), 1)) for k in live])
    score, text = path_scores(of, [texts[k] for k in live], free, n)

    mark = np.array(paths.mark)
    strong = np.array(_down((mark == 2).tolist(), parent, lambda a, b: a or b))

    def choose(weight: np.ndarray) -> np.ndarray:
        worth, mass = score * weight, text * weight
        return (worth > 0) & (worth >= THRESHOLD * (mass * worth).sum() / max(mass.sum(), 1e-9)) & (text > 0)

    def weights(weak: np.ndarray) -> np.ndarray:
        against = np.array(_down(np.where(mark == 2, STRONG, np.where(weak, WEAK, 1.0)).tolist(), parent, lambda a, b: a * b))
        return np.where((against == 1) & np.array(_down(paths.good, parent, lambda a, b: a or b)), GOOD, against)

    weak = mark == 1
    mass = np.where(choose(np.where(strong, STRONG, 1.0)) & ~strong, text, 0.0)
    below, total = _up(mass, parent), mass.sum()
    if weak.any() and total:
        heads = _up(np.array([float(t == "h1") for t in paths.tag]) * (np.bincount(of, minlength=n) > 0), parent)
        mains = _up(np.array([float(t in MAIN) for t in paths.tag]), parent)
        weak &= ~((mains > 0) | ((heads > 0) & (below >= 0.3 * total)))
        for most in (0.5, 0.5, 0.5, 0.5, 0.1, 0.0):
            outer = np.array(_down(weak.tolist(), parent, lambda a, b: a or b))
            if mass[~outer].sum() >= REMAINS * total or not weak.any():
                break
            above = np.array([False, *(bool(outer[p]) for p in parent[1:])])
            weak &= above | (below < most * total)
    chosen = choose(weights(weak))
    out = (mark == 2) | weak
    if not (chosen & ~strong).any():
        return []
    chosen &= ~np.array(_down(out.tolist(), parent, lambda a, b: a or b))
    if not chosen.any():
        return []

    content = _up(np.where(chosen, text, 0.0), parent)
    root, article = 0, False
    for k in range(n):
        if paths.tag[k] in MAIN and content[k] >= 0.5 * content[0] and not strong[k]:
            root, article = k, True
    if not article:
        held = [k for k in range(n) if content[k] >= content[0] and paths.tag[k] not in LEAVES]
        root, many = held[-1], np.bincount(paths.at, minlength=n)
        while root and many[root] > 1:  # several elements of one path are judged one by one
            root = parent[root]
        title = next((blocks[k].path for k in live if paths.tag[blocks[k].path] == "h1" and not strong[blocks[k].path]), None)
        wide = _common(root, title, parent) if title is not None else root
        titled = wide != root and many[wide] == 1 and paths.tag[wide] not in ("", "html", "body") and not any(out[p] for p in _above(title, wide, parent))
        root = wide if titled else root
    inside = _down([k == root for k in range(n)], parent, lambda a, b: a or b)
    beside = np.array(_down((out & (content == 0)).tolist(), parent, lambda a, b: a or b))
    holds = content > 0
    if article:
        return [texts[k] for k in live if inside[blocks[k].path] and not beside[blocks[k].path]]

    # The element right below the root that each element lies in, and that element's text.
    child = [-1] * len(paths.at)
    for k in range(1, len(child)):
        if inside[paths.at[paths.above[k]]]:
            child[k] = k if paths.at[paths.above[k]] == root and paths.at[k] != root else child[paths.above[k]]
    top = np.array([child[blocks[k].element] for k in live])
    order = [i for i, k in enumerate(live) if inside[blocks[k].path] and not beside[blocks[k].path]]
    whole, mine = (np.bincount(top[order] + 1, x[order], len(child) + 1)[1:] for x in (length, length * free))
    minor = [paths.tag[p] not in LEAVES and m < MINOR * mine.max() for p, m in zip(paths.at, mine, strict=True)]
    linked = 1 - mine / np.maximum(whole, 1)
    core = [i for i in order if chosen[of[i]] and (top[i] < 0 or not minor[top[i]])] or [i for i in order if chosen[of[i]]]
    heads = [i for i in order if paths.tag[of[i]] == "h1" and i < core[0]]
    first, last = min([*heads[-1:], core[0]]), core[-1]
    kept = []
    for i in order:
        c = top[i]
        if c < 0 or (holds[paths.at[c]] and not minor[c]) or (titled and linked[c] <= 0.5):
            kept.append(i)
        elif linked[c] <= 0.5 and (first <= i <= last or (paths.tag[paths.at[c]] in LEAVES and i > first)):
            kept.append(i)
    while len(kept) > 1 and length[kept[-1]] < 200 and COPYRIGHT.match(texts[live[kept[-1]]]):
        kept.pop()
    return [texts[live[i]] for i in kept]


def main_text(page: str) -> str:
    return " ".join(content_blocks(page))


def extract_pages(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """``pages`` without its html, with ``text`` (the article, empty if there is none) and ``n_chars``.

    Every page is read whole in the task that has it; nothing is shuffled. Null html counts as
    empty. Character references are decoded, white space inside a block becomes one space, and
    blocks are joined in page order by one space. Other columns pass through; columns named ``text``
    or ``n_chars`` are replaced. Repeated rows are each extracted.
    """
    carried = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            texts = [main_text(b.decode("utf-8", "replace")) for b in batch.column(len(carried)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*carried, "text", "n_chars"])

    source = pages.select(*carried, F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("__html"))
    fields = [f for f in source.schema.fields if f.name != "__html"]
    return source.mapInArrow(run, StructType([*fields, StructField("text", StringType()), StructField("n_chars", LongType())]))
