"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree: its block elements, the lines of text in them, and those inline elements of a line that
have a class, id or role or a name that HTML does not know. A node is frame (what holds the parts of a page),
content, junk or within junk. Its own evidence (tag, words of class, id and role; for a line its length, share of links and last
character; for a list or table those of all its items) and the potentials between parent and child are learned by
counting on labelled pages. Sum-product messages, once from the leaves up and once from the root down, give each
node's exact marginal; text whose marginal of content is half or more is kept.

All pages of a batch are one forest, and messages pass level by level in numpy.

Labelled pages come from labelled_pages(), which builds them from a seed with all usual parts around and
inside articles; any others with data-label attributes can be given. Only learn() reads these attributes.

Defined results: null, empty and text-less pages have an empty text; a page of bare text is all content; broken
markup is read leniently and in linear time: unclosed and stray tags as browsers do, a quote that never ends ends
with its tag, a tag that never ends is markup to the page's end, and what is nested deeper than MOST_DEPTH counts as a
sibling of what is that deep; scripts, styles and the like are never text; equal rows give equal results; only the
named columns are read.
"""

from __future__ import annotations

import html as references
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import with_scores

#: Fixed values of HTML: elements without an end, whose content is raw, and that never hold text to read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes plaintext".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes title svg object audio video canvas select option datalist textarea button".split())
#: Those that begin lines of their own, and inline ones that say nothing by themselves; all others are inline.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li listing main menu nav ol optgroup p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label map mark math nobr output q rb rp rt rtc ruby s samp slot small span strike strong sub sup time tt u var".split()
)
#: Blocks that say nothing by themselves; what their text is like does.
PLAIN = frozenset("div section ul ol li dl dt dd table tbody thead tfoot tr td th".split())
#: Elements that may stand in a head, that hold items, and whose lines count for the list that they are in.
_OF_HEAD = frozenset("base basefont bgsound link meta title style script template noscript noframes head".split())
_LISTS, _ITEMS = frozenset("ul ol menu dir dl table".split()), frozenset("li dt dd td th".split())
#: Elements that are the page itself, whose node is the root.
_ROOT = frozenset(("html", "body"))
#: Which open items of the same list a start tag ends, the outermost first; and blocks that do not end a paragraph.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_IN_PARAGRAPH = frozenset("body caption head html legend optgroup tbody td tfoot th thead tr".split())

#: Pages that the potentials are learned from, what is added to each count, and levels of a tree.
TRAINING_PAGES, SMOOTHING, SEED, MOST_DEPTH = 1000, 0.1, 5, 512
#: States of a node; kinds of nodes; a share that is not quite none.
FRAME, CONTENT, JUNK, WITHIN = STATES = range(4)
ELEMENT, LINE, PART = range(3)
NEVER = 1e-6

_NAME = re.compile(r"(/?)([a-zA-Z][^ \t\n\f\r/>]*+)")
_ATTRIBUTE = re.compile(r"""[ \t\n\f\r/]*+(?:([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"([^"]*+)"|'([^']*+)'|([^ \t\n\f\r>]*+)))?+)?""")
_RAW_END = {t: re.compile(rf"</{t}(?=[ \t\n\f\r/>])[^>]*+>?", re.IGNORECASE) for t in RAW}
_NAMED = frozenset(("class", "id", "role", "data-label"))
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


class Tree:
    """The nodes of one page, parents before children (-1: the root has none): parents, depths, kinds, evidence and
    labels; and the pieces of text in page order, each with its line's node and its own."""

    def __init__(self, label: int = FRAME):
        self.parent, self.depth, self.kind = [-1], [0], [ELEMENT]
        self.evidence: list[list[str]] = [[]]
        self.label = [label]
        self.pieces: list[tuple[int, int, str]] = []

    def add(self, parent: int, kind: int, evidence: list[str], label: int | None = None) -> int:
        """A new node's number; without a label it has its parent's."""
        if self.depth[parent] >= MOST_DEPTH:
            parent = self.parent[parent]
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.kind.append(kind)
        self.evidence.append(evidence)
        above = self.label[parent]
        self.label.append(WITHIN if above in (JUNK, WITHIN) else above if label is None else label)
        return len(self.parent) - 1

    def text(self, content: np.ndarray) -> str:
        """The lines of content, of which the pieces that are content."""
        kept = (content >= 0.5).tolist()
        lines, last = [], -1
        for line, node, piece in self.pieces:
            if kept[node]:
                if line != last:
                    lines.append([])
                    last = line
                lines[-1].append(piece)
        joined = (_plain("".join(own)) for own in lines)
        return "\n".join(x for x in joined if x)


def _plain(markup: str) -> str:
    return " ".join(references.unescape(markup).split())


def _words(value: str) -> list[str]:
    return list(dict.fromkeys(w.lower() for w in _WORD.findall(value)))


class _Open:
    """An open element: its tag, whether it is a block, the node that its blocks and lines belong to, and of an inline
    element that has no node of its own so far its evidence and label."""

    __slots__ = ("tag", "block", "node", "evidence", "label", "outer", "settled", "inside", "items", "of_list", "part")

    def __init__(self, tag: str, block: bool, node: int, below: _Open | None):
        self.tag, self.block, self.node = tag, block, node
        self.evidence: list[str] = []
        self.label: int | None = None
        self.outer = below  # the open element that it is in
        self.settled = block
        self.inside: dict[str, int] = {}  # of a block: how many inline elements of each tag are open in it
        self.items: dict[str, int] | None = None  # of a list: where its open items are
        self.of_list = -1 if below is None else below.of_list
        self.part = (-1, -1)  # line and node of an inline element in that line


class _Parser:
    def __init__(self, page: str, labelled: bool):
        self.page, self.labelled = page, labelled
        self.tree = Tree(CONTENT if labelled and "data-label" not in page else FRAME)
        first = _Open("", True, 0, None)
        first.items = {}
        self.stack = [first]
        self.blocks, self.lists = [0], [0]  # where the open blocks and lists are
        self.open: dict[str, int] = {}
        self.hidden = self.links = 0
        self.run: list[tuple[_Open, str]] = []
        self.linked = 0
        self.of_lists: dict[int, list[int]] = {}  # lines, words, linked characters, characters of a list's items

    def text(self, piece: str) -> None:
        if not self.hidden and piece:
            self.run.append((self.stack[-1], piece))
            self.linked += len(piece) if self.links else 0

    def flush(self) -> None:
        """End the line."""
        run, linked, self.run, self.linked = self.run, self.linked, [], 0
        line = _plain("".join(piece for _, piece in run)) if run else ""
        if not line:
            return
        tree, below, at = self.tree, self.stack[self.blocks[-1]], self.stack[-1]
        while not at.settled:
            at = at.outer
        words, links, of_list = line.count(" ") + 1, min(3, int(linked / len(line) * 3.0)), below.of_list
        if below.tag in _ITEMS and of_list >= 0:
            sums = self.of_lists.setdefault(of_list, [0, 0, 0, 0])
            for i, x in enumerate((1, words, linked, len(line))):
                sums[i] += x
            kinds = []
        else:
            kinds = [f"#words{min(6, words.bit_length())}", f"#{below.tag}/links{links}", f"#end{line[-1] in '.!?:;'}"]
        own = tree.add(at.node, LINE, kinds)
        for within, piece in run:
            tree.pieces.append((own, self.part(within, own) if piece.strip() else own, piece))
        self.settle()  # so that no later line walks the same elements again

    def part(self, at: _Open, line: int) -> int:
        """The node in a line of the innermost inline element around a piece that has evidence."""
        chain = []
        while not at.settled and at.part[0] != line:
            chain.append(at)
            at = at.outer
        node = line if at.settled else at.part[1]
        for own in reversed(chain):
            if own.evidence or own.label is not None:
                node = self.tree.add(node, PART, own.evidence, own.label)
            own.part = (line, node)
        return node

    def settle(self) -> int:
        """Give nodes to the inline elements that are open around a block or line that begins; the node it is in."""
        chain = []
        at = self.stack[-1]
        while not at.settled:
            chain.append(at)
            at = at.outer
        node = at.node
        for own in reversed(chain):
            if (own.evidence or own.label is not None) and not self.hidden:
                node = self.tree.add(node, ELEMENT, own.evidence, own.label)
            own.node, own.settled = node, True
        return node

    def close(self, n: int) -> None:
        """End all elements above the first n."""
        while len(self.stack) > n:
            own = self.stack[-1]
            if own.block:
                self.flush()
                self.blocks.pop()
                if own.items is not None:
                    self.lists.pop()
            elif own.settled and self.run:  # what follows is outside of it
                self.flush()
            self.stack.pop()
            at = len(self.stack)
            if own.block:
                self.open[own.tag] -= 1
                items = self.stack[self.lists[-1]].items
                if items.get(own.tag) == at:
                    del items[own.tag]
            else:
                self.stack[self.blocks[-1]].inside[own.tag] -= 1
                if own.tag in HIDDEN:
                    self.open[own.tag] -= 1
            self.hidden -= own.tag in HIDDEN
            self.links -= own.tag == "a"

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            if tag == "p" and not self.open.get("p"):
                self.flush()
            if self.open.get(tag):
                n = len(self.stack) - 1
                while self.stack[n].tag != tag:
                    n -= 1
                self.close(n)
            return
        if tag == "br":
            self.text(" ")
        inside = self.stack[self.blocks[-1]].inside
        if inside.get(tag):  # an inline end tag does not end blocks
            n = len(self.stack) - 1
            while self.stack[n].tag != tag:
                n -= 1
            self.close(n)
        elif tag in HIDDEN and self.open.get(tag):  # but those that hide what is in them do
            n = len(self.stack) - 1
            while self.stack[n].tag != tag:
                n -= 1
            self.close(n)

    def start(self, tag: str, attributes: dict[str, str], bare: bool) -> None:
        if self.stack[-1].tag == "head" and tag not in _OF_HEAD:
            self.close(len(self.stack) - 1)
        block = tag in BLOCK
        if block:
            if tag not in _IN_PARAGRAPH and self.stack[self.blocks[-1]].tag == "p":
                self.close(self.blocks[-1])
            if tag in _ENDS:
                items = self.stack[self.lists[-1]].items
                if found := [items[t] for t in _ENDS[tag] if t in items]:
                    self.close(min(found))
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.text(" ")
            return
        if bare and tag in HIDDEN and tag not in RAW:
            return
        evidence = [] if tag in PLAIN or tag in INLINE else [f"<{tag}>"] if block or tag in HIDDEN else _words(tag)
        for name in ("class", "id", "role"):
            if name in attributes:
                evidence += [w for w in _words(attributes[name]) if w not in evidence]
        label = int(attributes["data-label"]) if self.labelled and attributes.get("data-label") in ("0", "1", "2") else None
        if block:
            self.flush()
            above = self.settle()
            if tag in _ROOT and label is not None:
                self.tree.label[0] = label
            own = _Open(tag, True, above if self.hidden or tag in _ROOT else self.tree.add(above, ELEMENT, evidence, label), self.stack[-1])
            at = len(self.stack)
            if tag in _ENDS:
                self.stack[self.lists[-1]].items[tag] = at
            if tag in _LISTS:
                own.items = {}
                own.of_list = own.node
                self.lists.append(at)
            self.blocks.append(at)
            self.open[tag] = self.open.get(tag, 0) + 1
        else:
            own = _Open(tag, False, -1, self.stack[-1])
            own.evidence, own.label = evidence, label
            inside = self.stack[self.blocks[-1]].inside
            inside[tag] = inside.get(tag, 0) + 1
            if tag in HIDDEN:
                self.open[tag] = self.open.get(tag, 0) + 1
        self.stack.append(own)
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def attributes(self, at: int) -> tuple[dict[str, str], int]:
        """Those attributes that matter, and where the tag's > is (behind the page's end if there is none)."""
        out: dict[str, str] = {}
        page, size = self.page, len(self.page)
        while at < size and page[at] != ">":
            m = _ATTRIBUTE.match(page, at)
            if m[1] and (name := m[1].lower()) in _NAMED:
                out.setdefault(name, m[2] or m[3] or m[4] or "")
            at = m.end()
        return out, at

    def parsed(self) -> Tree:
        page, size, at = self.page, len(self.page), 0
        while at < size:
            begin = page.find("<", at)
            while 0 <= begin < size - 1 and not (page[begin + 1] in "!?/" or page[begin + 1].isalpha() and page[begin + 1].isascii()):
                begin = page.find("<", begin + 1)
            if begin < 0 or begin == size - 1:
                self.text(page[at:])
                break
            self.text(page[at:begin])
            m = _NAME.match(page, begin + 1)
            if not m:  # a comment, a declaration, or an end tag without a name
                stop, mark = -1, ">"
                if page.startswith("<!--", begin):
                    mark = "-->"
                    stop = page.find(mark, begin + 2)  # <!--> is a whole comment
                else:
                    stop = page.find(mark, begin + 2)
                at = size if stop < 0 else stop + len(mark)
                continue
            tag = m[2].lower()
            found, stop = self.attributes(m.end())
            if stop >= size:
                break
            at = stop + 1
            if m[1]:
                self.end(tag)
                continue
            self.start(tag, found, page[stop - 1] == "/")
            if tag in RAW and self.stack[-1].tag == tag:
                stop = None if tag == "plaintext" else _RAW_END[tag].search(page, at)
                if tag in ("xmp", "plaintext"):
                    self.text(page[at : stop.start() if stop else size].replace("&", "&amp;"))
                at = stop.end() if stop else size
                self.close(len(self.stack) - 1)
        self.close(1)
        self.flush()
        for node, (lines, words, linked, chars) in self.of_lists.items():
            self.tree.evidence[node] = self.tree.evidence[node] + [f"#list/links{min(3, int(linked / chars * 3.0))}", f"#list/words{min(6, (words // lines).bit_length())}"]
        return self.tree


def parsed(page: str, labelled: bool = False) -> Tree:
    """The tree of a page; labels are read only if asked for."""
    return _Parser(page, labelled).parsed()


@dataclass(frozen=True)
class Model:
    """Log-likelihoods of evidence in each state, log-potentials [kind of the child][parent state][child state], and those
    of the root's state."""

    evidence: dict[str, np.ndarray]
    edges: np.ndarray
    root: np.ndarray

    def marginals(self, trees: list[Tree]) -> list[np.ndarray]:
        """For each tree its nodes' probabilities of content."""
        sizes = [len(t.parent) for t in trees]
        first = np.r_[0, np.cumsum(sizes)]
        n = int(first[-1])
        parent = np.concatenate([np.array(t.parent) + a for t, a in zip(trees, first[:-1], strict=True)])
        depth = np.concatenate([t.depth for t in trees])
        kind = np.concatenate([t.kind for t in trees])
        up = np.zeros((n, len(STATES)))
        none = np.zeros(len(STATES))
        for i, words in enumerate(w for t in trees for w in t.evidence):
            for w in words:
                up[i] += self.evidence.get(w, none)
        up[first[:-1]] += self.root
        order = np.argsort(depth, kind="stable")
        level = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        message = np.zeros((n, len(STATES)))
        for d in range(int(depth.max()), 0, -1):  # from the leaves up
            own = order[level[d] : level[d + 1]]
            message[own] = _log_sums(self.edges[kind[own]] + up[own][:, None, :], 2)
            message[own] -= message[own].max(axis=1, keepdims=True)
            np.add.at(up, parent[own], message[own])
        for d in range(1, int(depth.max()) + 1):  # from the root down
            own = order[level[d] : level[d + 1]]
            rest = up[parent[own]] - message[own]
            rest -= rest.max(axis=1, keepdims=True)
            up[own] += _log_sums(self.edges[kind[own]] + rest[:, :, None], 1)
        content = np.exp(up[:, CONTENT] - _log_sums(up, 1))
        return [content[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def _log_sums(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis=axis)) + most.squeeze(axis)


def _sort(word: str) -> str:
    """What a piece of evidence is about: a name, or the feature whose value it is."""
    return "" if word[0] != "#" else "#links" if "/links" in word and not word.startswith("#list") else word.rstrip("0123456789TrueFals")


def learn(pages: list[str]) -> Model:
    """Potentials from pages whose elements state their labels in data-label (0 frame, 1 content, 2 junk; inherited by
    what is inside). A page that states none is all content."""
    trees = [parsed(p, labelled=True) for p in pages]
    seen: dict[str, list[float]] = {}
    edges = np.full((3, len(STATES), len(STATES)), SMOOTHING)
    # By meaning: what is within junk, and only that, is within; content holds no frame; text is not frame.
    edges[:, :, WITHIN] = edges[:, CONTENT, FRAME] = edges[LINE:, :, FRAME] = NEVER
    edges[:, JUNK:, :WITHIN], edges[:, JUNK:, WITHIN] = NEVER, 1.0
    root = np.full(len(STATES), SMOOTHING)
    for t in trees:
        root[t.label[0]] += 1
        for i, (parent, kind, evidence, label) in enumerate(zip(t.parent, t.kind, t.evidence, t.label, strict=True)):
            for w in evidence:
                seen.setdefault(w, [SMOOTHING] * len(STATES))[label] += 1
            if i:
                edges[kind, t.label[parent], label] += 1
    for w, c in seen.items():
        if w[0] == "#":  # text is alike at the top of junk and within
            c[JUNK] = c[WITHIN] = c[JUNK] + c[WITHIN] - SMOOTHING
    # Evidence that is absent says nothing: a word counts among the words of its sort (tags and names; or one feature).
    sorts: dict[str, np.ndarray] = {}
    for w, c in seen.items():
        sorts[_sort(w)] = sorts.get(_sort(w), 0) + np.array(c)
    evidence = {w: np.log(np.array(c) / sorts[_sort(w)]) for w, c in seen.items()}
    return Model(evidence, np.log(edges / edges.sum(axis=2, keepdims=True)), np.log(root / root.sum()))


_SYLLABLES = "an er on ti re sta mo li ve ra to ne ka su in or ma de".split()
#: Parts of pages and the names that sites give them.
_CONTAINERS = [("article", ""), ("main", ""), ("article", "post"), ("div", "content"), ("div", "article body"), ("div", "entry content"), ("div", "post"), ("section", "main content"), ("div", "story text"), ("main", "page main")]
_JUNK = {
    "menu": ["nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "tabs", "links"],
    "head": ["header", "masthead", "site header", "topbar", "logo", "branding", "hero"],
    "foot": ["footer", "site footer", "copyright", "legal", "bottom", "colophon"],
    "side": ["sidebar", "side", "aside", "widget", "rail", "related", "recommended", "popular", "trending", "tags"],
    "note": ["notice", "cookie", "cookie banner", "consent", "gdpr", "alert", "popup", "modal", "overlay", "banner", "message", "warning", "disclaimer"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "promoted", "banner ad"],
    "form": ["form", "search", "login", "signup", "subscribe", "newsletter", "contact"],
    "talk": ["comments", "comment", "replies", "discussion", "responses", "disqus", "thread", "reviews"],
    "share": ["share", "social", "sharing", "follow", "buttons", "meta", "byline"],
}
_TAGS = {"menu": ["nav", "nav", "div", "ul"], "head": ["header", "header", "div"], "foot": ["footer", "footer", "div"], "side": ["aside", "aside", "div", "section"], "note": ["div", "section", "aside"], "ad": ["div", "aside", "section"], "form": ["form", "form", "div"], "talk": ["section", "div", "ol"], "share": ["div", "ul"]}


#: Names of inline elements that are part of the text.
_WITHIN = ["term", "name", "highlight", "nowrap", "dropcap", "quote", "ref", "citation", "abbr", "date", "place", "small caps", "lead"]
_PREFIXES = ["x", "my", "app", "site"]


def labelled_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> list[str]:
    """Pages with all parts that contracts of extraction name, labelled; some of them without a container for the
    article, some of bare text."""
    rng = random.Random(seed)

    def sentence(words: int) -> str:
        return " ".join("".join(rng.choices(_SYLLABLES, k=rng.randint(1, 3))) for _ in range(words)).capitalize() + rng.choice([".", ".", ".", "", "!"])

    def paragraph() -> str:
        out = " ".join(sentence(rng.randint(1, 14)) for _ in range(rng.randint(1, 5)))
        if rng.random() < 0.2:
            out = out.replace(" ", f" <a href='#'>{sentence(2)}</a> ", 1)
        if rng.random() < 0.25:
            name, inside = rng.choice(_WITHIN), sentence(rng.randint(1, 3))
            own = f"{rng.choice(_PREFIXES)}-{name.replace(' ', '-')}"
            out = out.replace(" ", f" <{own}>{inside}</{own}> " if rng.random() < 0.2 else f" {element('span', name, None, inside)} ", 1)
        return out

    def advert() -> str:
        """An inline element that is no part of the line it stands in."""
        kind = rng.choice(["ad", "ad", "share", "note", "side"])
        name = rng.choice(_JUNK[kind])
        if rng.random() < 0.2:
            return f'<{(own := rng.choice(_PREFIXES) + "-" + name.replace(" ", "-"))} data-label="2">{sentence(rng.randint(1, 6))}</{own}>'
        return element(rng.choice(["span", "span", "a", "small", "strong"]), name, 2, sentence(rng.randint(1, 6)))

    def element(tag: str, names: str, label: int | None, inside: str) -> str:
        key = rng.choice(["class", "class", "class", "id"])
        return f"<{tag}" + (f' data-label="{label}"' if label is not None else "") + (f' {key}="{names.replace(" ", rng.choice(["-", " ", "_"]))}"' if names else "") + f">{inside}</{tag}>"

    def junk(kind: str) -> str:
        tag, names = rng.choice(_TAGS[kind]), rng.choice(_JUNK[kind])
        if tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.6:
            names = ""
        items = "".join(f"<li><a href='/x'>{sentence(rng.randint(1, 3))}</a></li>" for _ in range(rng.randint(2, 7)))
        if kind == "menu":
            inside = items if tag == "ul" else f"<ul>{items}</ul>"
        elif kind == "form":
            inside = f"<p>{sentence(4)}</p><label>{sentence(1)}</label><input name=q><button>Go</button>"
        elif kind == "talk":
            one = rng.choice(["article", "div", "div", "li"])
            inside = "".join(element(one, rng.choice(["comment", "reply", "comment body", ""]), 2, f"<p>{paragraph()}</p>") for _ in range(rng.randint(1, 8)))
            inside = f"<h{(h := rng.choice([3, 3, 4]))}>{sentence(2)}</h{h}>" + inside
        elif kind in ("side", "share"):
            inside = rng.choice([f"<h{(h := rng.choice([3, 3, 4]))}>{sentence(2)}</h{h}><ul>{items}</ul>", f"<p>{paragraph()}</p>", sentence(3)])
        else:
            inside = rng.choice([f"<p>{paragraph()}</p>", paragraph(), sentence(6), f"<h2>{sentence(2)}</h2><p>{sentence(8)}</p>"])
        return element(tag, names, 2, inside)

    def body() -> str:
        out = []
        if rng.random() < 0.9:
            title = f"<h1>{sentence(rng.randint(2, 9))}</h1>"
            out.append(f"<header>{title}</header>" if rng.random() < 0.08 else title)
        terse = rng.random() < 0.1  # an article of many short paragraphs
        for _ in range(rng.randint(10, 40) if terse else rng.randint(1, 9)):
            kind = 0.0 if terse else rng.random()
            if kind < 0.72:
                out.append(f"<p>{sentence(rng.randint(1, 4)) if terse else paragraph()}" + ("</p>" if rng.random() < 0.8 else ""))
            elif kind < 0.78:
                out.append(f"<h{(h := rng.choice([2, 2, 3]))}>{sentence(rng.randint(1, 6))}</h{h}>")
            elif kind < 0.82:  # a list of links that belongs to the article
                out.append("<ul>" + "".join(f"<li><a href='/x'>{sentence(rng.randint(1, 5))}</a></li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{sentence(rng.randint(1, 12))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.89:
                out.append(f"<blockquote><p>{paragraph()}</p></blockquote>")
            elif kind < 0.905:
                out.append(f"<pre>{sentence(6)}</pre>")
            elif kind < 0.92:
                out.append(f"<table><tr><td>{sentence(2)}</td><td>{sentence(3)}</td></tr></table>")
            elif kind < 0.935:
                out.append(f"<div>{paragraph()}</div>")
            elif kind < 0.96:
                out.append(advert() if rng.random() < 0.5 else f"<p>{sentence(4)} {advert()} {sentence(6)}</p>")
            else:
                out.append(junk(rng.choice(["ad", "share", "form", "note", "side", "talk", "menu"])))
        if rng.random() < 0.15:
            out.append(junk(rng.choice(["talk", "share", "foot", "side"])))
        return "".join(out)

    out = []
    for _ in range(n):
        before = [junk(k) for k in ("head", "menu", "note", "ad", "form", "side") if rng.random() < 0.5]
        after = [junk(k) for k in ("talk", "side", "ad", "foot", "share", "note") if rng.random() < 0.5]
        kind = rng.random()
        if kind < 0.03:
            out.append(paragraph())
            continue
        if kind < 0.11:  # no container: the body itself is the article
            whole = "".join(before[:2]) + body() + "".join(after[:2])
            out.append(f'<html data-label="0"><body data-label="1">{whole}</body></html>')
            continue
        tag, names = rng.choice(_CONTAINERS)
        whole = "".join(before) + element(tag, names, 1, body()) + "".join(after)
        if rng.random() < 0.3:
            whole = f"<div class='{rng.choice(['wrapper', 'container', 'page', 'row', 'site'])}'>{whole}</div>"
        out.append(f'<html data-label="0"><body>{whole}</body></html>')
    return out


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", html_col: str = "html", extra: dict[str, F.Column] | None = None) -> DataFrame:
    """(id, extra columns, text) of each page: its content blocks in page order, a line each."""
    shipped = pages.sparkSession.sparkContext.broadcast(model)

    def judge():
        def of(texts):
            trees = [parsed(t or "") for t in texts.to_pylist()]
            found = shipped.value.marginals(trees)
            return [[t.text(m) for t, m in zip(trees, found, strict=True)]]

        return of

    return with_scores(pages, id_col, html_col, judge, [("text", pa.string())], extra)
