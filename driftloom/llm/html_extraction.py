"""Main-text extraction from HTML by a linear-chain conditional random field over leaf blocks.

A page becomes the sequence of its leaf blocks: runs of text between the tags of block
elements. Each block has features of its ancestors (tags, words of class, id and role) and
of its text (length, share in links, punctuation). The field scores labelings of the whole
sequence (main text or not), is trained by maximum likelihood on labelled pages, and
decoded by Viterbi.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .html_pages import labelled_pages

#: A tag from its "<" on. Quotes count after "=" only, as in browsers; nothing is tried twice.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
NAMES = re.compile(r"""\b(class|id|role|data-main)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Elements of HTML by how they bear on text.
RAW = frozenset(["script", "style"])  # up to their own end tag everything is data
DROPPED = frozenset(["head", "noscript", "template", "svg", "iframe", "object", "select", "textarea", "title", "math", "canvas", "video", "audio", "datalist"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])
BREAKS = frozenset(["hr", "input"])  # void elements that end a block
INLINE = frozenset(["a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "picture", "map", "output", "meter", "progress", "nobr"])
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "option": {"option"}}
LISTS = frozenset(["ul", "ol", "dl", "table"])
IN_HEAD = frozenset(["title", "meta", "link", "style", "script", "base", "noscript", "template"])  # anything else ends an open head


#: Elements nested deeper than this become siblings of the deepest one, as in browsers.
DEEPEST = 512


class Element:
    """An open element: its tag, the words of its names, its parent, and whether it is marked as main text."""

    __slots__ = ("inherited", "main", "names", "parent", "tag")

    def __init__(self, tag: str, names: frozenset[str], parent: Element | None, main: bool):
        self.tag, self.names, self.parent = tag, names, parent
        self.main = main or (parent is not None and parent.main)
        self.inherited = None  # what a field keeps of its features and its ancestors'

    def own_features(self) -> list[str]:
        """Features that every block inside has."""
        out = [] if self.tag in ("html", "body") else [f"in={self.tag}"]
        out += [f"name={n}" for n in self.names]
        if self.parent is not None:
            out.append(f"chain={self.parent.tag}>{self.tag}")
        return out

    def innermost_features(self) -> list[str]:
        """Features of the blocks whose innermost element this is."""
        return [f"tag={self.tag}"] if self.parent is None else [f"tag={self.tag}", f"above={self.parent.tag}"]


@dataclass
class Block:
    text: str
    linked: int  # code points inside links
    element: Element | None  # the innermost one
    main: bool


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, white space collapsed, references decoded, empty ones left out.

    The work grows with the page's length only: every tag is read once, and what is open of
    each tag is looked up, not searched for.
    """
    out: list[Block] = []
    stack: list[Element] = []
    where: dict[str, list[int]] = {}  # depths of the open elements of each tag
    parts: list[str] = []
    state = {"links": 0, "linked": 0, "dropped": 0}

    def flush() -> None:
        if not parts:
            return
        text = " ".join("".join(parts).split())
        if text:
            top = stack[-1] if stack else None
            out.append(Block(text, min(state["linked"], len(text)), top, top is not None and top.main))
        parts.clear()
        state["linked"] = 0

    def say(raw: str) -> None:
        if raw and stack and stack[-1].tag == "head" and not raw.isspace():
            pop_to(len(stack) - 1)  # text ends a head whose end tag was left out
        if raw and not state["dropped"]:
            text = decoded(raw) if "&" in raw else raw
            parts.append(text)
            if state["links"]:
                state["linked"] += len(text)

    def pop_to(depth: int) -> None:
        flush()
        for e in reversed(stack[depth:]):
            state["dropped"] -= e.tag in DROPPED
            where[e.tag].pop()
        del stack[depth:]

    def deepest(tags) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=-1)

    at, end_of, last_noscript = 0, len(page), None
    while at < end_of:
        start = page.find("<", at)
        if start < 0 or start + 1 >= end_of:
            say(page[at:])
            break
        say(page[at:start])
        mark = page[start + 1]
        if mark in "!?" or (mark == "/" and not page[start + 2 : start + 3].isalpha()):  # comments, declarations, stray ends
            comment = page.startswith("<!--", start)
            stop = page.find("-->" if comment else ">", start + (4 if comment else 2))
            at = end_of if stop < 0 else stop + (3 if comment else 1)
            continue
        if mark != "/" and not (mark.isascii() and mark.isalpha()):
            say("<")
            at = start + 1
            continue
        m = TAG.match(page, start)
        if not m:
            if mark == "/" and not page[start + 2].isascii():
                say("<")
                at = start + 1
                continue
            break  # a tag that is never closed swallows the rest
        at = m.end()
        close, name, rest = m[1], m[2].lower(), m[3]
        if name in RAW and not close:
            stop = re.compile(rf"</{name}\b[^>]*+>?", re.I).search(page, at)
            at = stop.end() if stop else end_of
        elif name == "br":
            parts.append(" ")
        elif name in VOID:
            if name in BREAKS:
                flush()
        elif name in INLINE:
            if name == "a":
                state["links"] = 0 if close else 1
        elif close:
            if where.get(name):
                pop_to(where[name][-1])
            else:
                flush()
            state["links"] = 0
        else:
            flush()
            state["links"] = 0
            if stack and stack[-1].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                pop_to(len(stack) - 1)
            if name in CLOSES:
                ends = deepest(CLOSES[name])
                if ends > deepest(LISTS):
                    pop_to(ends)
            if name == "body":
                pop_to(0)
            elif name not in IN_HEAD and where.get("head"):
                pop_to(where["head"][-1])
            if name == "noscript":
                if last_noscript is None:
                    last_noscript = max((e.start() for e in re.finditer(r"</noscript", page, re.I)), default=-1)
                if at > last_noscript:  # never closed: it hides nothing
                    continue
            if len(stack) >= DEEPEST:
                pop_to(DEEPEST - 1)
            names = NAMES.findall(rest) if rest else ()
            where.setdefault(name, []).append(len(stack))
            stack.append(Element(name, _words(names) if names else NO_NAMES, stack[-1] if stack else None, any(n[0].lower() == "data-main" for n in names)))
            state["dropped"] += name in DROPPED
            if rest.endswith("/") and name in DROPPED:
                pop_to(len(stack) - 1)
    flush()
    return out


NO_NAMES: frozenset[str] = frozenset()
LONG_REFERENCE = re.compile(r"&#0*+[0-9]{8,};?")


def decoded(raw: str) -> str:
    """``raw`` with its character references decoded; numbers beyond any character are U+FFFD."""
    return html.unescape(LONG_REFERENCE.sub("\ufffd", raw) if "&#" in raw else raw)


def _words(names: list[tuple[str, ...]]) -> frozenset[str]:
    return frozenset(w.lower().rstrip("s") or w.lower() for n in names if n[0].lower() != "data-main" for w in PART.findall(n[1] or n[2] or n[3]))


def context_features(element: Element | None) -> list[str]:
    """All features of a block from its innermost element and that one's ancestors."""
    out, e = set(element.innermost_features() if element else ["tag="]), element
    while e is not None:
        out.update(e.own_features())
        e = e.parent
    return sorted(out)


def text_key(b: Block) -> tuple:
    """What of a block's text counts, in classes."""
    n = len(b.text)
    words = b.text.count(" ") + 1
    return (min(7, words.bit_length()), round(4 * b.linked / n), b.text[-1] in ".!?…。", b.text[-1] == ":", min(3, b.text.count(",")), "©" in b.text or "(c)" in b.text)


def text_features(key: tuple) -> list[str]:
    size, linked, ends, colon, commas, copyright_ = key
    return ["bias", f"words={size}", f"linked={linked}", f"ends={ends}", f"colon={colon}", f"commas={commas}", f"copy={copyright_}", f"words={size},linked={linked}"]


@dataclass
class Field:
    """Weights of a two-label chain: of features for label 1 against 0, of label pairs, of first and last labels."""

    weights: dict[str, float]
    moves: np.ndarray
    first: np.ndarray
    last: np.ndarray
    _text: dict = field(default_factory=dict)
    _own: dict = field(default_factory=dict)
    _innermost: dict = field(default_factory=dict)

    def _of_text(self, key: tuple) -> float:
        found = self._text.get(key)
        if found is None:
            found = self._text[key] = sum(self.weights.get(f, 0.0) for f in text_features(key))
        return found

    def _inherited(self, element: Element) -> tuple[frozenset[str], float]:
        """The features known here that blocks inside ``element`` have from it and its ancestors, and their sum.

        Kept on every element: it shares its parent's set unless it adds a known feature.
        """
        path, e = [], element
        while e is not None and e.inherited is None:
            path.append(e)
            e = e.parent
        have, total = e.inherited if e is not None else (frozenset(), 0.0)
        for e in reversed(path):
            own = self._known(self._own, e, Element.own_features)
            if own and not own <= have:
                have, total = have | own, total + sum(self.weights[f] for f in sorted(own - have))
            e.inherited = have, total
        return have, total

    def _known(self, cache: dict, e: Element, features) -> frozenset[str]:
        """Those of an element's features that have a weight."""
        key = (e.tag, e.names, e.parent.tag if e.parent is not None else None)
        found = cache.get(key)
        if found is None:
            if len(cache) > 50_000:
                cache.clear()
            found = cache[key] = frozenset(f for f in features(e) if f in self.weights)
        return found

    def scores(self, page: list[Block]) -> list[float]:
        out, last, context = [], None, self.weights.get("tag=", 0.0)
        for b in page:
            if b.element is not last:
                last = b.element
                if last is None:
                    context = self.weights.get("tag=", 0.0)
                else:
                    context = self._inherited(last)[1] + sum(self.weights[f] for f in sorted(self._known(self._innermost, last, Element.innermost_features)))
            out.append(context + self._of_text(text_key(b)))
        return out

    def viterbi(self, scores: list[float]) -> list[int]:
        """The best labels for blocks with these scores for label 1 (label 0 has 0)."""
        if not scores:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        zero, one = self.first[0], self.first[1] + scores[0]
        back = []
        for s in scores[1:]:
            from0, from1 = zero + m01 > one + m11, zero + m00 >= one + m10
            back.append((0 if from1 else 1, 0 if from0 else 1))
            zero, one = max(zero + m00, one + m10), max(zero + m01, one + m11) + s
        label = int(one + self.last[1] > zero + self.last[0])
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]

    def extract(self, page: str | None) -> str:
        found = blocks(page or "")
        return "\n".join(b.text for b, y in zip(found, self.viterbi(self.scores(found)), strict=True) if y)


def train(pages: list[str] | None = None, steps: int = 120, rate: float = 0.15, l2: float = 2e-4) -> Field:
    """Maximum-likelihood field for labelled pages (main-text elements carry data-main), by Adam.

    All pages are run forward and backward together, position by position.
    """
    chains = [c for c in map(blocks, pages if pages is not None else labelled_pages()) if c]
    index: dict[str, int] = {}
    longest, n = max(map(len, chains)), len(chains)
    rows, columns = [], []
    y, mask = np.zeros((n, longest), dtype=int), np.zeros((n, longest), dtype=bool)
    for i, chain in enumerate(chains):
        for j, b in enumerate(chain):
            y[i, j], mask[i, j] = b.main, True
            for f in [*context_features(b.element), *text_features(text_key(b))]:
                rows.append(i * longest + j)
                columns.append(index.setdefault(f, len(index)))
    rows, columns = np.array(rows), np.array(columns)
    k, ends, spread = len(index), mask.sum(axis=1) - 1, np.arange(n)
    theta = np.zeros(k + 8)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, moves, first, last = theta[:k], theta[k : k + 4].reshape(2, 2), theta[k + 4 : k + 6], theta[k + 6 :]
        s = np.zeros((n, longest, 2))
        s[:, :, 1] = np.bincount(rows, weights=w[columns], minlength=n * longest).reshape(n, longest)
        s[:, 0] += first
        s[spread, ends] += last
        a, b = np.zeros_like(s), np.zeros_like(s)
        a[:, 0] = s[:, 0]
        for j in range(1, longest):
            a[:, j] = np.where(mask[:, j, None], np.logaddexp(a[:, j - 1, 0, None] + moves[0], a[:, j - 1, 1, None] + moves[1]) + s[:, j], a[:, j - 1])
        z = np.logaddexp(a[spread, ends, 0], a[spread, ends, 1])
        for j in range(longest - 2, -1, -1):
            nxt = b[:, j + 1] + s[:, j + 1]
            step = np.logaddexp(nxt[:, 0, None] + moves[:, 0], nxt[:, 1, None] + moves[:, 1])
            b[:, j] = np.where(mask[:, j + 1, None], step, 0.0)
        p = np.exp(a + b - z[:, None, None]) * mask[:, :, None]
        truth = np.stack([(y == 0) & mask, (y == 1) & mask], axis=2).astype(float)
        gap = p - truth
        g = np.zeros_like(theta)
        g[:k] = np.bincount(columns, weights=gap[:, :, 1].reshape(-1)[rows], minlength=k)
        pair = np.exp(a[:, :-1, :, None] + moves + (b[:, 1:] + s[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        both = truth[:, :-1, :, None] * truth[:, 1:, None, :]
        g[k : k + 4] = (pair - both).sum(axis=(0, 1)).reshape(-1)
        g[k + 4 : k + 6] = gap[:, 0].sum(axis=0)
        g[k + 6 :] = gap[spread, ends].sum(axis=0)
        g = g / n + l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Field({f: float(theta[i]) for f, i in index.items()}, theta[k : k + 4].reshape(2, 2), theta[k + 4 : k + 6], theta[k + 6 :])


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """``pages`` (with a column html) with text and n_chars in place of html, other columns as they are.

    Blocks of the main text are joined by one line feed in page order; inside a block white
    space is one space. Null html is empty; a page without main text gives the empty
    string. White space is what Unicode counts as such, no-break spaces included. Broken
    markup (missing or stray end tags, cut-off pages) is read as browsers do in the common
    cases, and never fails; a tag that is cut off by the end of the page is left out.
    Whole pages count, however long, in time in proportion to their length.
    """
    names = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    sent = pages.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            got = [m.extract(h) for h in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], names=[*names, "text", "n_chars"])

    rows = pages.select(*names, F.col("html").cast("string"))
    return map_texts(rows, run, pages.select(*names).schema.add("text", "string").add("n_chars", "long"))
