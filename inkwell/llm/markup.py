"""Markup to clean text by wrapper induction.

A field value is read as one tree whatever its markup (HTML, Markdown, wiki, LaTeX): every piece of markup is a node, the
text between is a leaf. Values of one site that begin with the same kind of node form a class of pages. The commonest tree
of a class is its wrapper; every page is aligned with it by simple tree matching (the largest ordered matching of equally
labelled nodes). A leaf that holds the same text on nearly all pages aligned at that place is template, one whose text varies is content.

Clean text keeps headings and list items on lines of their own (items behind a bullet), code as it stands and formulas
between single dollar signs; the same pieces also come in a list with their kinds. Null values give no row, empty values
are clean already, values of any length are read whole.
"""

from __future__ import annotations

import functools
import html
import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.joins import merged, spread_join
from inkwell.session import checkpointed

# Element names, attributes without a value, LaTeX commands of running text.
TAGS = frozenset(
    "a abbr acronym address article aside b bdi bdo big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em "
    "fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark math meta "
    "nav nowiki ol option p pre q ref s samp script section select small span strike strong style sub summary sup table tbody td textarea tfoot th thead "
    "time title tr tt u ul var video wbr".split()
)
VOID = frozenset("br hr img input link meta wbr col".split())
BARE = "noshade|checked|disabled|nowrap|hidden|selected|readonly|async|defer"
COMMANDS = frozenset(
    "item text textbf textit textrm textsf texttt textsc textsl emph underline mbox hbox newline linebreak newpage pagebreak par paragraph subparagraph section "
    "subsection subsubsection chapter part title author date label ref eqref pageref cite citep citet footnote caption hspace vspace hfill vfill noindent indent "
    "centering raggedright raggedleft smallskip medskip bigskip quad qquad begin end maketitle tableofcontents includegraphics url href input include usepackage "
    "documentclass newcommand bfseries itshape large small tiny huge normalsize hline ldots dots frac sqrt sum int alpha beta gamma delta theta lambda mu pi sigma "
    "omega infty times cdot leq geq neq approx rightarrow leftarrow left right".split()
)
SILENT = frozenset("label ref eqref pageref cite citep citet hspace vspace includegraphics usepackage documentclass input include".split())
HEADS = {"chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5, "title": 1}
FORMULAS = frozenset("equation equation* align align* gather gather* multline multline* displaymath math eqnarray eqnarray*".split())
CODES = frozenset("verbatim lstlisting minted".split())
BLOCKS = frozenset("p div ul ol table tr blockquote section article header footer hr pre center dl form".split())

_ATTR = r"\s+[A-Za-z_:][\w:.-]*\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'|[^\s\"'<>]+)"
TOKEN = re.compile(
    rf"""
    (?=[<`&$\\{{\[!'*_~|\#=>]|[A-Za-z]:\\|^[ \t]*:?[-*])  # what a piece can begin with
    (?:(?P<path>(?<![A-Za-z])[A-Za-z]:\\\S*|\[IMG:[^\[\]]*\])
  | (?P<fence>```[^\n`]*\n(?P<fenced>.*?)(?:\n[ \t]*)?```)
  | (?P<remark><!--)
  | (?P<comment><!DOCTYPE[^<>]*>|<\?xml[^<>]*\?>)
  | (?P<tag><(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9]*(?::[A-Za-z]+)?)(?:{_ATTR}|\s+(?:{BARE})\b)*\s*(?P<void>/?)>)
  | (?P<auto><https?://[^\s<>]+>)
  | (?P<entity>&(?:\#\d{{1,7}}|\#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z][A-Za-z0-9]{{1,31}});)
  | (?P<display>\$\$(?P<displayed>[^$]+)\$\$)
  | (?P<formula>\$[^$]+\$)
  | (?P<paren>\\\((?=.)|\\\[(?=.))
  | (?P<command>\\(?P<cmd>[A-Za-z]+)\*?(?P<opt>\[[^\[\]\n]*\])?(?P<brace>\{{)?)
  | (?P<escape>\\\\(?:\[[^\[\]\n]*\])?|\\[%&\#_{{}}$])
  | (?P<template>\{{\{{[^{{}}]*\}}\}})
  | (?P<wikilink>\[\[(?P<target>[^\[\]|]*)(?:\|(?P<shown>[^\[\]]*))?\]\])
  | (?P<image>!\[(?P<alt>[^\[\]]*)\]\([^()\s]*(?:\s+"[^"]*")?\))
  | (?P<link>\[(?P<linked>(?:[^\[\]]|\[[^\[\]]*\])*(?:\][^\[\]]*)?)\]\([^()\s]+(?:\s+"[^"]*")?\))
  | (?P<outlink>\[https?://[^\s\]]+(?:\s+(?P<outtext>[^\[\]]*))?\])
  | (?P<code>`(?P<coded>[^`]+)`)
  | (?P<quotes>'''(?P<q3>(?:(?!''').)+?)'''|''(?P<q2>(?:(?!'').)+?)'')
  | (?P<strong>\*\*\*?(?=\S))
  | (?P<em>(?<![\w*])\*(?=[^\s*])(?P<b1>[^*\n]+?)(?<=[^\s*])\*(?![\w*]))
  | (?P<dunder>(?<!\w)__(?=[^\s_]))
  | (?P<under>(?<!\w)_(?=[^\s_])(?P<u1>[^_\n]+?)(?<=[^\s_])_(?!\w))
  | (?P<strike>~~(?=\S))
  | (?P<rule>^\|?[ \t]*:?-{{2,}}:?[ \t]*(?:\|[ \t]*:?-{{2,}}:?[ \t]*)*\|[ \t]*$)
  | (?P<row>^\|[^\n]*\|[ \t]*$)
  | (?P<wikitable>^\{{\|[^\n]*$|^\|\}}[ \t]*$|^\|-[^\n]*$)
  | (?P<head>^(?P<hashes>\#{{1,6}})[ \t]+(?P<headed>\S[^\n]*)$)
  | (?P<wikihead>^(?P<eqs>={{2,6}})[ \t]*(?P<wikiheaded>[^=\n]+?)[ \t]*(?P=eqs)[ \t]*$)
  | (?P<quote>^(?:>[ \t]?)+)
  | (?P<bullet>^[ \t]*\*[ \t]+(?=\S)))
    """,
    re.X | re.S | re.M,
)
#: Values without any of these have no markup; JVM and Python read it alike.
MAYBE = r"(?m)[<&`~\\$]|\*\S|\S\*|^[ \t]*\*|__|\b_|_\b|''|\[\[|\]\(|!\[|\{\{|^#|==|^>|^\||^\{\||\[http"


class Node:
    """label '#' is a leaf with its text; others have children. kind 'plain' marks what is no markup (formulas, paths)."""

    __slots__ = ("children", "label", "level", "text")

    def __init__(self, label: str, text: str = "", children: list | None = None, level: int = 0):
        self.label, self.text, self.children, self.level = label, text, children if children is not None else [], level


PLAIN = frozenset(["#", "formula", "page"])


def _known_entity(s: str) -> bool:
    return s[1] == "#" or s[1:] in html5


# How pieces end whose inside may hold anything: (pattern of the end, its length).
ENDS = {
    "remark": (re.compile("(?=-->)"), 3),
    "(": (re.compile(r"(?=\\\))"), 2),
    "[": (re.compile(r"(?=\\\])"), 2),
    "***": (re.compile(r"(?<=\S)(?=\*\*\*)"), 3),
    "**": (re.compile(r"(?<=\S)(?=\*\*)"), 2),
    "__": (re.compile(r"(?<=[^\s_])(?=__(?!\w))"), 2),
    "~~": (re.compile(r"(?<=\S)(?=~~)"), 2),
}
_ENVIRONMENT = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}")


class _Ends:
    """Where the pieces of one text end. Each kind of end is looked up once for the whole text, so an opener costs no scan of its own."""

    def __init__(self, s: str):
        self.s = s
        self.spots: dict[str, list[int]] = {}

    def first(self, kind: str, at: int, limit: int) -> int:
        """The first end of that kind from at on that lies before the limit, or -1."""
        pattern, size = ENDS[kind]
        if kind not in self.spots:
            self.spots[kind] = [m.start() for m in pattern.finditer(self.s)]
        spots = self.spots[kind]
        k = bisect_left(spots, at)
        return spots[k] if k < len(spots) and spots[k] + size <= limit else -1

    @functools.cached_property
    def braces(self) -> dict[int, int]:
        """The closing brace of each opening one."""
        out, opened = {}, []
        for m in re.finditer("[{}]", self.s):
            if m.group() == "{":
                opened.append(m.start())
            elif opened:
                out[opened.pop()] = m.start()
        return out

    @functools.cached_property
    def environments(self) -> dict[int, tuple[str, int, int, int]]:
        """(name, start and end of the body, end) of each environment that is closed, by where it begins."""
        out, opened = {}, defaultdict(list)
        for m in _ENVIRONMENT.finditer(self.s):
            if m[1] == "begin":
                opened[m[2]].append(m)
            elif opened[m[2]]:
                begin = opened[m[2]].pop()
                out[begin.start()] = (m[2], begin.end(), m.start(), m.end())
        return out


class _Frame:
    """A stretch of the text that is read as the inside of a piece: where it ends, where reading goes on after it, and the elements open in it."""

    __slots__ = ("limit", "names", "open", "resume")

    def __init__(self, children: list[Node], limit: int, resume: int):
        self.limit, self.resume = limit, resume
        self.open: list[tuple[str, list[Node]]] = [("", children)]
        self.names: Counter = Counter()

    def put(self, n: Node) -> None:
        self.open[-1][1].append(n)

    def enter(self, name: str, n: Node) -> None:
        self.open.append((name, n.children))
        self.names[name] += 1

    def leave(self, name: str) -> bool:
        """Closes the innermost element of that name and all inside it; False if none is open."""
        if not self.names[name]:
            return False
        while True:
            last, _ = self.open.pop()
            self.names[last] -= 1
            if last == name:
                return True


def parse(s: str) -> list[Node]:
    """The trees of a value's pieces in order, of any depth. One scan from left to right; the insides of pieces are frames on a stack."""
    top: list[Node] = []
    ends = _Ends(s)
    frames = [_Frame(top, len(s), len(s))]
    done = i = 0

    def sub(label: str, a: int, b: int, resume: int, level: int = 0) -> None:
        """A node whose inside is the stretch from a to b; reading goes on in it, then at resume."""
        nonlocal done, i
        n = Node(label, "", None, level)
        frames[-1].put(n)
        frames.append(_Frame(n.children, b, resume))
        done = i = a

    while frames:
        frame = frames[-1]
        m = TOKEN.search(s, i, frame.limit)
        if not m:
            if done < frame.limit:
                frame.put(Node("#", s[done : frame.limit]))
            frames.pop()
            done = i = frame.resume
            continue
        kind, start, end = m.lastgroup, m.start(), m.end()
        found = _ending(s, m, ends, frame.limit)
        if found is None or kind == "path":
            i = start + 1 if found is None else end
            continue
        if start > done:
            frame.put(Node("#", s[done:start]))
        done = i = end
        put, g = frame.put, m.group
        if kind == "remark":
            put(Node("comment"))
            done = i = found + 3
        elif kind == "comment":
            put(Node("comment"))
        elif kind == "tag":
            name = g("name").lower()
            if g("close"):
                if not frame.leave(name):
                    put(Node("stray"))
            else:
                if name in ("p", "li", "tr", "td") and frame.open[-1][0] == name:
                    frame.leave(name)  # these end where the next one begins
                n = Node(name)
                frame.put(n)
                if name not in VOID and not g("void"):
                    frame.enter(name, n)
        elif kind == "entity":
            put(Node("entity", html.unescape(g())))
        elif kind == "display":
            put(Node("display", g("displayed").strip()))
        elif kind == "paren":
            put(Node("display", s[end:found].strip()))
            done = i = found + 2
        elif kind == "formula":
            inner = _inside_formula(g()[1:-1])
            put(Node("dirty" if inner != g()[1:-1] else "formula", inner))
        elif kind == "command":
            name = g("cmd")
            a, b, after = found
            environment = ends.environments.get(start) if name == "begin" else None
            if environment and environment[3] <= frame.limit:
                name, a, b, after = environment
                if name in FORMULAS:
                    put(Node("display", s[a:b].strip()))
                elif name in CODES:
                    put(Node("code", s[a:b].strip("\n")))
                else:
                    sub("env", a, b, after)
                    continue
                done = i = after
            elif name == "item":
                put(Node("item"))
                done = i = after
                if b > a:
                    sub("group", a, b, after)
            elif name in HEADS:
                sub("head", a, b, after, HEADS[name])
            elif name in SILENT or name in BREAKS:
                put(Node("silent" if name in SILENT else "br"))
                done = i = after
            else:
                sub("command", a, b, after)
        elif kind == "escape":
            put(Node("br") if g().startswith("\\\\") else Node("entity", g()[1]))
        elif kind == "fence":
            put(Node("code", g("fenced")))
        elif kind == "code":
            put(Node("tick", g("coded")))
        elif kind == "template":
            put(Node("silent"))
        elif kind in ("image", "auto"):
            put(Node("image"))
        elif kind in ("rule", "wikitable"):
            put(Node("rule"))
        elif kind == "quote":
            put(Node("quote"))
        elif kind == "bullet":
            put(Node("item"))
        elif kind == "row":
            row = Node("row")
            put(row)
            cells = _cells(s, start, end)
            row.children = [Node("cell") for _ in cells]
            for k in range(len(cells) - 1, -1, -1):  # the first cell is read first
                frames.append(_Frame(row.children[k].children, cells[k][1], cells[k + 1][0] if k + 1 < len(cells) else end))
            done = i = cells[0][0]
        elif kind == "outlink":
            sub("link", *(m.span("outtext") if g("outtext") else (end, end)), end)
        elif kind == "head":
            sub("head", m.start("headed"), m.start("headed") + len(g("headed").rstrip("# \t")), end, len(g("hashes")))
        elif kind == "wikihead":
            sub("head", *m.span("wikiheaded"), end, len(g("eqs")) - 1)
        elif isinstance(found, tuple):
            sub(kind, *found)
        else:
            inside = next(n for n in INSIDES[kind] if g(n) is not None)
            sub("link" if kind in ("wikilink", "link") else kind, *m.span(inside), end)
    return top


INSIDES = {"wikilink": ("shown", "target"), "link": ("linked",), "quotes": ("q3", "q2"), "em": ("b1",), "under": ("u1",)}
BREAKS = frozenset("newline linebreak par newpage pagebreak".split())


def _ending(s: str, m: re.Match, ends: _Ends, limit: int):
    """What a match is, or None if it is no piece after all: where a piece ends whose inside may hold anything, (from, to, resume) of an inside, or True."""
    kind, start, end = m.lastgroup, m.start(), m.end()
    if kind == "tag":
        return True if m["name"].lower() in TAGS or ":" in m["name"] else None
    if kind == "entity":
        return True if _known_entity(m.group()) else None
    if kind == "command":
        if m["cmd"] not in COMMANDS and not m["brace"]:
            return None
        close = ends.braces.get(end - 1, limit) if m["brace"] else limit
        return (end, close, close + 1) if close < limit else (end, end, end)
    if kind == "remark":
        at = ends.first("remark", end, limit)
        return at if at >= 0 else None
    if kind == "paren":
        at = ends.first(s[start + 1], end + 1, limit)
        return at if at >= 0 else None
    if kind in ("strong", "dunder", "strike"):
        for mark in (m.group(), m.group()[:2]):
            if not s[start + len(mark) : start + len(mark) + 1].strip():
                continue
            at = ends.first(mark, start + len(mark) + 1, limit)
            if at >= 0:
                return start + len(mark), at, at + len(mark)
        return None
    return True


def _cells(s: str, a: int, b: int) -> list[tuple[int, int]]:
    """The cells of a table row, without the white space around."""
    while b > a and s[b - 1] in " \t|":
        if s[b - 1] == "|":
            while b > a and s[b - 1] == "|":
                b -= 1
            break
        b -= 1
    while a < b and s[a] == "|":
        a += 1
    out, at = [], a
    for part in s[a:b].split("|"):
        left = len(part) - len(part.lstrip())
        out.append((at + left, max(at + left, at + len(part.rstrip()))))
        at += len(part) + 1
    return out


_IN_FORMULA = re.compile(r"<!--.*?-->|</?(?P<name>[A-Za-z][A-Za-z0-9]*)(?:" + _ATTR + r")*\s*/?>|&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", re.S)


def _inside_formula(s: str) -> str:
    """A formula without the HTML in it."""

    def swap(m: re.Match) -> str:
        piece = m.group()
        if piece[0] == "&":
            return html.unescape(piece) if _known_entity(piece) else piece
        if m.group("name") and m.group("name").lower() not in TAGS:
            return piece
        return " " if (m.group("name") or "").lower() == "br" else ""

    return _IN_FORMULA.sub(swap, s) if "<" in s or "&" in s else s


def walk(nodes: list[Node]) -> Iterator[Node]:
    """All nodes, in pre-order."""
    stack = list(reversed(nodes))
    while stack:
        n = stack.pop()
        yield n
        stack += reversed(n.children)


def count_markup(nodes: list[Node]) -> int:
    return sum(n.label not in PLAIN for n in walk(nodes))


HIDDEN = frozenset("comment silent image rule quote stray script style".split())


def render(nodes: list[Node], pieces: list[tuple[str, str]], template: frozenset | set = frozenset()) -> str:
    """Clean text; pieces gets (kind, text) of headings, list items, code and formulas. template: ids of the leaves to leave out."""
    top: list[str] = []
    stack: list[tuple[Iterator[Node], list[str], list[str], str, str]] = [(iter(nodes), top, top, "", "")]  # inside, where it is written, where the whole goes, what kind, what follows
    while stack:
        inside, out, outer, kind, after = stack[-1]
        n = next(inside, None)
        if n is None:
            stack.pop()
            if kind:
                text = "".join(out)
                if kind == "code":
                    pieces.append(("code", text))
                    text = f"\n\ue000{text}\ue001\n"
                elif kind == "heading":
                    pieces.append(("heading", text.strip()))
                    text = f"\n{text.strip()}\n"
                else:
                    text = f"\n\ue002{text.strip()}\n"
                outer.append(text)
            elif after:
                out.append(after)
            continue
        label = n.label
        if id(n) in template or label in HIDDEN:
            continue
        if label in ("#", "entity", "tick"):
            out.append(n.text)
        elif label in ("formula", "dirty", "display"):
            pieces.append(("formula", n.text))
            out.append(f"${n.text}$")
        elif label == "code" and n.text:
            pieces.append(("code", n.text))
            out.append(f"\n\ue000{n.text}\ue001\n")
        elif label in ("br", "hr"):
            out.append("\n")
        elif label == "item":
            out.append("\n\ue002")
        elif label == "head" or (len(label) == 2 and label[0] == "h" and label[1].isdigit()):
            stack.append((iter(n.children), [], out, "heading", ""))
        elif label == "li" or label == "pre":
            stack.append((iter(n.children), [], out, "item" if label == "li" else "code", ""))
        elif label in ("cell", "td", "th"):
            stack.append((iter(n.children), out, out, "", "\t"))
        elif label == "row" or label in BLOCKS or label == "env":
            out.append("\n")
            stack.append((iter(n.children), out, out, "", "\n"))
        else:
            stack.append((iter(n.children), out, out, "", ""))
    return "".join(top)


_MAYBE = re.compile(MAYBE)


def clean(value: str | None) -> str | None:
    """Clean text of one value; values without markup come back as they are."""
    if value is None or not _MAYBE.search(value):
        return value
    nodes = parse(value)
    return tidy(render(nodes, [])) if count_markup(nodes) else value


def _without_gaps(s: str) -> str:
    """Without blank lines, and without blanks around line ends."""
    first, *rest = s.split("\n")
    if not rest:
        return s
    lines = [first.rstrip(" \t"), *filter(None, (line.strip(" \t") for line in rest[:-1])), rest[-1].lstrip(" \t")]
    return "\n".join(lines)


def tidy(s: str, pieces: list[tuple[str, str]] | None = None) -> str:
    """Rendered text without blank lines and edges; code stays as it is. pieces gets the list items."""
    out = []
    for i, part in enumerate(re.split("\ue000([^\ue000\ue001]*)\ue001", s)):
        if i % 2:
            out.append(part)
            continue
        part = re.sub("\ue002[ \t]*", "• ", _without_gaps(part))
        if pieces is not None:
            pieces += [("item", line[2:].strip()) for line in part.split("\n") if line.startswith("• ")]
        out.append(part)
    return "".join(out).strip()


def skeleton(nodes: list[Node]) -> str:
    """The tree's shape as text: labels and brackets, leaves as '#'."""
    out: list[str] = []
    stack: list = [(nodes, 0)]
    while stack:
        level, k = stack.pop()
        if k == len(level):
            if stack:
                out.append(")")
            continue
        if k:
            out.append(",")
        out.append(level[k].label)
        stack.append((level, k + 1))
        if level[k].children:
            out.append("(")
            stack.append((level[k].children, 0))
    return "".join(out)


def read_skeleton(s: str) -> list[Node]:
    top: list[Node] = []
    stack = [top]
    for m in re.finditer(r"[^(),]+|[()]", s):
        t = m.group()
        if t == "(":
            stack.append(stack[-1][-1].children)
        elif t == ")":
            stack.pop()
        else:
            stack[-1].append(Node(t))
    return top


def _shapes(nodes: list[Node], known: dict) -> tuple[dict[int, int], dict[int, int]]:
    """A number of each node's shape, equal for equal trees, and its size, by the node's id."""
    shape: dict[int, int] = {}
    size: dict[int, int] = {}
    for n in reversed(list(walk(nodes))):  # children before their parents
        key = (n.label, tuple(shape[id(c)] for c in n.children))
        shape[id(n)] = known.setdefault(key, len(known))
        size[id(n)] = 1 + sum(size[id(c)] for c in n.children)
    return shape, size


def match(a: list[Node], b: list[Node]) -> tuple[int, list[tuple[int, int, list | None]]]:
    """Simple tree matching of two forests: the size of the largest ordered matching, and the matched positions with theirs below (None: the trees are equal).

    Equal trees at both ends of two child lists are matched at once, which no matching can better; only what lies between goes through the
    table of all pairs. So equal trees cost linear time. Depth is no matter: the matchings below are steps on a stack.
    """
    known: dict = {}
    shape, size = _shapes(a, known)
    more = _shapes(b, known)
    shape |= more[0]
    size |= more[1]
    stack, value = [_matching(a, b, shape, size)], None
    while True:
        try:
            wanted = stack[-1].send(value)
        except StopIteration as e:
            stack.pop()
            value = e.value
            if not stack:
                return value
            continue
        stack.append(_matching(*wanted, shape, size))
        value = None


def _matching(a: list[Node], b: list[Node], shape: dict[int, int], size: dict[int, int]):
    """The matching of two child lists; asks for those below by yielding the lists, and gets them sent."""
    same = lambda x, y: shape[id(x)] == shape[id(y)]
    low, total = 0, 0
    while low < min(len(a), len(b)) and same(a[low], b[low]):
        total += size[id(a[low])]
        low += 1
    tail = 0
    while tail < min(len(a), len(b)) - low and same(a[-1 - tail], b[-1 - tail]):
        total += size[id(a[-1 - tail])]
        tail += 1
    n, m = len(a) - low - tail, len(b) - low - tail
    below: dict[tuple[int, int], tuple[int, list | None]] = {}
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1) if m else ():
        for j in range(1, m + 1):
            x, y = a[low + i - 1], b[low + j - 1]
            most = max(best[i - 1][j], best[i][j - 1])
            if x.label == y.label:
                if same(x, y):
                    below[i, j] = size[id(x)] - 1, None
                else:
                    below[i, j] = yield x.children, y.children
                most = max(most, best[i - 1][j - 1] + 1 + below[i, j][0])
            best[i][j] = most
    between, i, j = [], n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            between.append((low + i - 1, low + j - 1, below[i, j][1]))
            i, j = i - 1, j - 1
    ends = [(k, k, None) for k in range(low)]
    tails = [(len(a) - k, len(b) - k, None) for k in range(tail, 0, -1)]
    return total + best[n][m], [*ends, *between[::-1], *tails]


def aligned_nodes(page: list[Node], pairs: list | None) -> Iterator[tuple[Node, str]]:
    """(node of the page, path in the wrapper) of each matched node."""
    stack: list[tuple[list[Node], list | None, str]] = [(page, pairs, "")]
    while stack:
        nodes, matched, path = stack.pop()
        for i, j, below in [(k, k, None) for k in range(len(nodes))] if matched is None else matched:
            at = f"{path}/{j}"
            yield nodes[i], at
            if nodes[i].children:
                stack.append((nodes[i].children, below, at))


def aligned_leaves(page: list[Node], pairs: list) -> Iterator[tuple[Node, str, str]]:
    """(leaf of the page, path in the wrapper, text) of each matched leaf."""
    return ((n, at, n.text.strip()) for n, at in aligned_nodes(page, pairs) if n.label == "#")


def _first_label(nodes: list[Node]) -> str:
    return next((n.label for n in nodes if n.label not in PLAIN), "formula")


_PAGES = "host string, table_name string, record_id bigint, field string, value string, n_markup int, skeleton string, class_key string"


def pages(values: DataFrame) -> DataFrame:
    """Values (host, table_name, record_id, field, value) that may have markup, as pages: class_key, skeleton and number of markup nodes (0 where there is none after all)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            trees = [parse(v) for v in b["value"]]
            counts = [count_markup(t) for t in trees]
            b = b.assign(n_markup=counts, skeleton=[skeleton(t) if n else None for t, n in zip(trees, counts, strict=True)])
            b["class_key"] = [f"{h}|{f.split('.')[0]}|{_first_label(t)}" for h, f, t in zip(b["host"], b["field"], trees, strict=True)]
            yield b

    kept = values.filter(F.col("value").rlike(MAYBE)).select(F.coalesce("host", F.lit("")).alias("host"), "table_name", "record_id", "field", "value").dropDuplicates()
    return kept.mapInPandas(read, _PAGES)


def wrappers(found: DataFrame) -> DataFrame:
    """(class_key, wrapper): the commonest tree of each class; ties go to the smaller text."""
    counted = found.filter("n_markup > 0").groupBy("class_key", "skeleton").agg(F.count("*").alias("n"))
    return counted.groupBy("class_key").agg(F.min_by("skeleton", F.struct(-F.col("n"), "skeleton")).alias("wrapper"))


def slots(found: DataFrame, induced: DataFrame) -> DataFrame:
    """(class_key, slot, text, n): what each place of a wrapper holds, over its aligned pages."""

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, value, shape in zip(b["class_key"], b["value"], b["wrapper"], strict=True):
                page = parse(value)
                rows += [(key, w, text) for _, w, text in aligned_leaves(page, match(page, read_skeleton(shape))[1]) if text]
            yield pd.DataFrame(rows, columns=["class_key", "slot", "text"])

    joined = spread_join(found.filter("n_markup > 0"), induced, ["class_key"], ["record_id", "value"]).select("class_key", "value", "wrapper")
    return joined.mapInPandas(align, "class_key string, slot string, text string").groupBy("class_key", "slot", "text").agg(F.count("*").alias("n"))


def templates(held: DataFrame, least: int = 5, share: float = 0.9) -> DataFrame:
    """(class_key, template): the constant leaves of each wrapper as JSON {slot: text}; least pages must agree, and share of those aligned there."""
    per = held.groupBy("class_key", "slot").agg(F.sum("n").alias("pages"), F.max_by(F.struct("n", "text"), F.struct("n", "text")).alias("top"))
    const = per.filter((F.col("top.n") >= least) & (F.col("top.n") >= share * F.col("pages")))
    return const.groupBy("class_key").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("slot", "top.text")))).alias("template"))


_CLEANED = "table_name string, record_id bigint, field string, n_markup int, n_template int, clean_text string, structure string, template_text string"


def learned(found: DataFrame) -> DataFrame:
    """(class_key, wrapper, template): the wrapper of each class of pages with its constant leaves, a row per class."""
    induced = checkpointed(wrappers(found))
    return checkpointed(merged(induced, templates(slots(found, induced)), "class_key", "left"))


def aligned(found: DataFrame) -> DataFrame:
    """Pages with markup, each aligned with its class's wrapper: n_markup is the number of its markup nodes, n_template how many of them stand in the
    wrapper, template_text what the wrapper holds constant; clean_text and structure are what is left.

    found: pages(), kept in a table.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for value, shape, constant in zip(b["value"], b["wrapper"], b["template"], strict=True):
                page, drop, left = parse(value), set(), []
                fixed = json.loads(constant) if constant else {}
                common = 0
                for n, w in aligned_nodes(page, match(page, read_skeleton(shape))[1]):
                    common += n.label not in PLAIN
                    text = n.text.strip() if n.label == "#" else ""
                    if text and fixed.get(w) == text:
                        drop.add(id(n))
                        left.append(text)
                own = count_markup(page) - common
                pieces: list[tuple[str, str]] = []
                text = tidy(render(page, pieces, drop), pieces)
                rows.append((common + own, common, text, json.dumps(pieces, ensure_ascii=False), "\n".join(left) or None))
            made = pd.DataFrame(rows, columns=["n_markup", "n_template", "clean_text", "structure", "template_text"], index=b.index)
            yield pd.concat([b[["table_name", "record_id", "field"]], made], axis=1)

    with_wrapper = spread_join(found.filter("n_markup > 0"), learned(found), ["class_key"], ["record_id", "value"])
    return with_wrapper.select("table_name", "record_id", "field", "value", "wrapper", "template").mapInPandas(write, _CLEANED)


def marked(values: DataFrame) -> DataFrame:
    """aligned() of the values that have any markup."""
    return aligned(checkpointed(pages(values)))


def cleaned(values: DataFrame) -> DataFrame:
    """Every value with its clean text: (table_name, record_id, field, n_markup, n_template, clean_text, structure, template_text).

    values: (host, table_name, record_id, field, value); other columns are ignored. Repeated rows count once.
    Values without markup pass unchanged with n_markup 0 and null structure. structure is a JSON list of [kind, text];
    template_text is what was left out as template, null if nothing was.
    """
    values = values.select("host", "table_name", "record_id", "field", "value").filter(F.col("value").isNotNull())
    found = checkpointed(pages(values))
    none = F.lit(None).cast("string")
    as_is = ["table_name", "record_id", "field", F.lit(0).alias("n_markup"), F.lit(0).alias("n_template"), F.col("value").alias("clean_text"), none.alias("structure"), none.alias("template_text")]
    plain = values.filter(~F.col("value").rlike(MAYBE)).dropDuplicates().select(*as_is)
    return aligned(found).unionByName(plain).unionByName(found.filter("n_markup = 0").select(*as_is))
