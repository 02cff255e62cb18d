"""Markup of several languages to clean text that keeps headings, lists, code and formulas.

A text may mix HTML, Markdown, wiki markup and LaTeX. Code is set aside first and comes back unchanged. Of an HTML page the main
part is chosen by composite text density: for every node the characters per tag, adjusted for the characters and tags inside
links; the density of a page's body and of the nodes on the way to the node with the largest sum of its children's densities
gives a threshold, and within every node that reaches it the subtree of largest sum is taken and the text that stands directly in
the node, wherever in the page. Code is always kept, and so are headings, lists and tables next to something kept. A fragment
without a page around it loses only blocks of links whose density doesn't reach the threshold. Headings come
out as ``#`` lines, list items as ``- `` lines, code as fenced blocks or between backticks, formulas as written, table rows as
cells joined by `` | ``.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cairn.plans.arrow import by_slice
from cairn.plans.spread import spread

_FRONT = re.compile(r"---[ \t]*\n(?:[^\n]*\n)*?---[ \t]*(?:\n|\Z)")
_FENCE = r"(?P<fence>(?<![^\n])```[^\n]*\n(?:.*?\n)??```[^\n]*)"
_CODE = re.compile(
    _FENCE + r"|(?P<span>(?<!`)`(?!`)[^`\n]+`(?!`))|(?P<pre>(?i:<pre(?:\s[^<>]*)?>.*?</pre\s*>))|(?P<verbatim>\\begin\{verbatim\}.*?\\end\{verbatim\})", re.S
)
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>")
_REFERENCE = re.compile(r"&(?:[A-Za-z]+|#[0-9]+);")
_EOL = r"(?=\n|\Z)"
#: Marks of each kind in text without code, with a character that all matches hold, which is cheap to look for.
_MARKS = {
    "html": [("<", _TAG), ("<!--", None), ("&", _REFERENCE)],
    "wiki": [("\n==", re.compile(r"\n={2,} [^\n]* ={2,}[ \t]*" + _EOL)), ("[[", re.compile(r"\[\[[^\n]*?\]\]")), ("''", None), ("{{", re.compile(r"\{\{[^\n]*?\}\}")), ("\n{|", None)],
    "latex": [
        ("\\begin{", None), ("\\end{", None), ("\\item", None), ("\\", re.compile(r"\\[A-Za-z]+\{")), ("$$", None), ("\\(", None), ("\\[", None),
        ("$", re.compile(r"\$(?=[^\s$])(?=[^$\n]*[\\^_])[^$\n]*(?<=[^\s$])\$")),
    ],
    "markdown": [
        ("\n", re.compile(r"\n(?:#{1,6} |[-*+>] |[0-9]+\. |```|\|(?:[ \t]*:?-+:?[ \t]*\|)+[ \t]*" + _EOL + ")")),
        ("**", re.compile(r"\*\*[^\n]+?\*\*")), ("*", re.compile(r"(?<![*\w])\*\w+\*(?![*\w])")), ("__", re.compile(r"__\w+?__")), ("](", re.compile(r"\[[^\]\n]*\]\([^)\n]*\)")),
        ("\n----", re.compile(r"[^\W_]\n-{4,}[ \t]*" + _EOL)), ("\n====", re.compile(r"[^\W_]\n={4,}[ \t]*" + _EOL)),
    ],
}
KINDS = tuple(_MARKS)
_KIND_OF_CODE = {"fence": "markdown", "span": "markdown", "pre": "html", "verbatim": "latex"}


def body_of(doc: str) -> str:
    """The text with LF line ends and without leading frontmatter."""
    text = doc.replace("\r\n", "\n")
    front = _FRONT.match(text) if text.startswith("---") else None
    return text[front.end() :] if front else text


def set_aside(text: str) -> tuple[str, list[tuple[str, str]]]:
    """Text with code replaced by marks, and the pieces of code with their kinds."""
    if "`" not in text and "\\begin{verbatim}" not in text and "<pre" not in text.lower():
        return text, []
    pieces: list[tuple[str, str]] = []

    def keep(m: re.Match) -> str:
        pieces.append((m.lastgroup, m.group()))
        return f"\ue000{len(pieces) - 1}\ue001"

    return _CODE.sub(keep, text), pieces


def kinds_of(text: str, pieces: list[tuple[str, str]]) -> list[str]:
    """Kinds of markup in a text whose code has been set aside."""
    kinds = {_KIND_OF_CODE[k] for k, _ in pieces}
    lines = "\n" + text
    for kind, marks in _MARKS.items():
        if kind not in kinds and any(sign in lines and (pattern is None or pattern.search(lines)) for sign, pattern in marks):
            kinds.add(kind)
    return [k for k in KINDS if k in kinds]


# ---------------------------------------------------------------- HTML

#: Elements without an end tag, elements whose content isn't text, elements that start a paragraph of their own,
#: and for each element that may be closed silently the elements that close it.
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_SILENT = set("script style head template noscript".split())
_BLOCK = set("html body p div section article main header footer nav aside blockquote table ul ol dl figure form address pre h1 h2 h3 h4 h5 h6".split())
_HEADING = set("h1 h2 h3 h4 h5 h6".split())
_APART = _BLOCK | set("li tr td th dt dd thead tbody tfoot caption hr".split())
_IN_HEAD = set("base link meta noscript script style template title".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


class _Node:
    __slots__ = ("tag", "parent", "begin", "end", "chars", "tags", "link_chars", "link_tags", "density", "total", "alt", "number")

    def __init__(self, tag: str, parent: _Node | None, begin: int):
        self.tag, self.parent, self.begin, self.end = tag, parent, begin, begin
        self.chars = self.tags = self.link_chars = self.link_tags = self.number = 0
        self.density = self.total = 0.0
        self.alt = ""


class _Tree(HTMLParser):
    """Nodes in document order, and events: a node's start or end, or text with its node.

    With ``open_head`` a head ends before the first text or element that belongs in the body.
    """

    def __init__(self, open_head: bool = False):
        super().__init__(convert_charrefs=True)
        self.open_head = open_head
        self.root = self.at = _Node("", None, 0)
        self.nodes, self.events, self.open = [self.root], [], {}

    def handle_starttag(self, tag, attrs):
        closes = _CLOSES.get(tag)
        if closes and self.at.tag in closes:
            self._close(self.at.tag)
        if self.open_head and self.at.tag == "head" and tag not in _IN_HEAD:
            self._close("head")
        node = _Node(tag, self.at, len(self.events))
        self.nodes.append(node)
        self.events.append((1, node))
        if tag == "img":
            node.alt = next((v or "" for k, v in attrs if k == "alt"), "")
        if tag in _VOID:
            self.events.append((2, node))
            node.end = len(self.events)
        else:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def _close(self, tag):
        if not self.open.get(tag):
            return
        while True:
            node, self.at = self.at, self.at.parent
            self.open[node.tag] -= 1
            self.events.append((2, node))
            node.end = len(self.events)
            if node.tag == tag:
                return

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        if self.open_head and self.at.tag == "head" and data.strip():
            self._close("head")
        self.events.append((0, (self.at, data)))

    def done(self):
        self.close()
        while self.at is not self.root:
            self._close(self.at.tag)
        self.root.end = len(self.events)


def _measure(tree: _Tree, top: _Node) -> None:
    """Counts below every node, then densities and the sums of the children's densities."""
    for kind, x in tree.events:
        if kind == 0:
            node, data = x
            if node.tag not in _SILENT:
                node.chars += len("".join(data.split()))
    for node in reversed(tree.nodes):
        if node.tag == "a":
            node.link_chars = node.chars
            node.link_tags = node.tags + 1
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    whole, linked = max(top.chars, 1), top.link_chars
    for node in tree.nodes:
        if not node.chars:
            continue
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        base = math.log(c * lc / max(c - node.link_chars, 1) + linked * c / whole + math.e)
        ratio = c / lc * t / lt
        # the logarithm to `base` of the adjustment; texts made of links alone come out at or below zero
        node.density = c / t * math.log(ratio) / math.log(base) if ratio > 1 and base > 1 else c / t * min(ratio, 1.0)
    for node in tree.nodes:
        if node.parent is not None:
            node.parent.total += node.density


def _lines(items: list[tuple[int, int, _Node | str]], apart: set[int]) -> Iterator[tuple[int, int]]:
    """Spans between a node's block children that hold text of the node itself, and not more text inside links than outside."""
    begin, end, own, chars, linked = -1, -1, 0, 0, 0
    for b, e, x in items:
        if id(x) in apart:
            if own and 2 * linked <= chars:
                yield begin, end
            begin, own, chars, linked = -1, 0, 0, 0
            continue
        n = len("".join(x.split())) if isinstance(x, str) else 0
        begin, end, own = (b if begin < 0 else begin), e, own + n
        chars, linked = (chars + n, linked) if isinstance(x, str) else (chars + x.chars, linked + x.link_chars)
    if own and 2 * linked <= chars:
        yield begin, end


def _main_parts(tree: _Tree) -> list[tuple[int, int]]:
    """Spans of events with the main text, in document order and apart from each other.

    What stands outside the body is held against the body's threshold; text directly around it counts as the body's.
    """
    body = next((n for n in tree.nodes if n.tag == "body"), tree.root)
    _measure(tree, body)
    inside = [n for n in tree.nodes if body.begin <= n.begin < body.end] if body is not tree.root else tree.nodes
    best = max(inside, key=lambda n: n.total)
    threshold, node, above = best.density, best, set()
    while node is not None and node is not body.parent:
        threshold = min(threshold, node.density)
        node = node.parent
    while node is not None:
        above.add(id(node))
        node = node.parent
    # the best node at or below each, and nodes that are or hold a block: children come after parents
    top, apart, hidden = {id(n): n for n in tree.nodes}, set(), set()
    for n in reversed(tree.nodes):
        up = n.parent
        if n.tag in _APART or n.tag in _SILENT:
            apart.add(id(n))
        if up is not None:
            if top[id(n)].total > top[id(up)].total:
                top[id(up)] = top[id(n)]
            if id(n) in apart:
                apart.add(id(up))
    for n in tree.nodes:
        if n.tag in _SILENT or n.parent is not None and id(n.parent) in hidden and n is not body:
            hidden.add(id(n))
    keep, texts, items = bytearray(len(tree.events)), [], defaultdict(list)

    def take(begin: int, end: int) -> None:
        keep[begin:end] = b"\1" * (end - begin)

    for i, (kind, x) in enumerate(tree.events):
        if kind == 1:
            items[id(x.parent)].append((i, x.end, x))
        elif kind == 0:
            items[id(x[0])].append((i, i + 1, x[1]))
            if id(x[0]) not in hidden and x[1].strip():
                texts.append(i)
                keep[i] = "\ue000" in x[1]
    for n in tree.nodes:
        if id(n) in hidden:
            continue
        if id(n) in above:
            for span in _lines(items[id(n)], apart):
                take(*span)
        elif n.density >= threshold and n.chars:
            chosen = top[id(n)] if top[id(n)].total > 0 else n
            take(chosen.begin, chosen.end)
            for span in _lines(items[id(n)], apart):
                take(*span)
    for n in tree.nodes:  # no holes within a line
        if n is tree.root or id(n) in apart and id(n) not in hidden:
            for begin, end in _lines(items[id(n)], apart):
                if 1 in keep[begin:end]:
                    take(begin, end)
    kinds = _HEADING | {"ul", "ol", "dl", "table"}
    beside = [n for n in tree.nodes if n.tag in kinds and id(n) not in hidden and (n.tag in _HEADING or 2 * n.link_chars <= n.chars)]
    for nodes, after in ((beside, False), (beside[::-1], True)):
        for n in nodes:
            at = bisect_left(texts, n.end) if after else bisect_left(texts, n.begin) - 1
            if 0 <= at < len(texts) and keep[texts[at]]:
                take(n.begin, n.end)
    edges = [i for i in range(len(keep) + 1) if (i < len(keep) and keep[i]) != (i > 0 and keep[i - 1])]
    return list(zip(edges[::2], edges[1::2])) or [(body.begin, body.end)]


def _without_menus(tree: _Tree) -> list[tuple[int, int]]:
    """Spans of a fragment without its menus: blocks of several links that hold more text inside links than outside, and whose density,
    which the links lower, is below the least on the way to the node of largest sum."""
    _measure(tree, tree.root)
    best = max(tree.nodes, key=lambda n: n.total)
    least, node = best.density, best
    while node is not None:
        least = min(least, node.density)
        node = node.parent
    spans, at = [], 0
    for n in tree.nodes:  # in document order; what lies in a dropped node ends before it
        if n is not tree.root and n.begin >= at and n.tag in _APART and n.link_tags >= 3 and 2 * n.link_chars > n.chars and n.density < least:
            spans.append((at, n.begin))
            at = n.end
    spans.append((at, len(tree.events)))
    return spans


def _render(tree: _Tree, parts: list[tuple[int, int]]) -> str:
    """Text of the spans ``parts``; the blocks, lists and tables that they lie in keep their form."""
    keep = bytearray(len(tree.events))
    for begin, end in parts:
        keep[begin:end] = b"\1" * (end - begin)
    before = [0, *accumulate(keep)]
    out: list[str] = []
    silent, gap = 0, False
    lists: list[_Node] = []
    for i, (kind, x) in enumerate(tree.events):
        if kind == 0:
            if not keep[i]:
                gap = gap or bool(x[1].strip())
            elif not silent:
                data = x[1]
                if gap and out and not out[-1][-1:].isspace():
                    out.append("\n")
                gap = False
                out.append(re.sub(r"[ \t]*\n[ \t]*", "\n", data) if "\n" in data else data)
            continue
        tag, start = x.tag, kind == 1
        if before[x.begin] == before[x.end]:
            if tag == "li" and start and lists and lists[-1] is x.parent:
                x.parent.number += 1
            continue
        if tag in _SILENT:
            if keep[i]:
                silent = max(0, silent + (1 if start else -1))
        elif tag in _BLOCK:
            out.append("\n\n")
            if tag in _HEADING and start:
                out.append("#" * int(tag[1]) + " ")
            if tag in ("ul", "ol"):
                lists.append(x) if start else lists and lists.pop()
        elif tag == "li":
            if start:
                numbered = lists and lists[-1].tag == "ol"
                if numbered:
                    lists[-1].number += 1
                out.append("\n" + "  " * max(0, len(lists) - 1) + (f"{lists[-1].number}. " if numbered else "- "))
        elif tag in ("br", "tr", "dt", "dd"):
            if start:
                out.append("\n")
        elif tag == "hr":
            if start:
                out.append("\n\n")
        elif tag in ("td", "th"):
            if start and out and not out[-1].endswith("\n"):
                out.append(" | ")
        elif tag == "img" and start:
            out.append(x.alt)
    return "".join(out)


_PAGE = re.compile(r"<(?:html|body)(?:\s[^<>]*)?>", re.I)
_SILENT_TAG = re.compile(r"<(?P<end>/?)(?P<tag>" + "|".join(sorted(_SILENT)) + r")(?:\s[^<>]*)?(?P<empty>/?)>", re.I)


def _unclosed(text: str, page: bool) -> list[int]:
    """Places of start tags of silent elements without an end tag of their own; a page's head may go without."""
    opened: dict[str, list[int]] = defaultdict(list)
    raw = ""
    last = {t: text.lower().rfind(f"</{t}") for t in ("script", "style")}
    for m in _SILENT_TAG.finditer(text):
        tag = m["tag"].lower()
        if raw and not (m["end"] and tag == raw):
            continue  # tags in a script or style are none
        raw = ""
        if m["end"]:
            if opened[tag]:
                opened[tag].pop()
        elif not (m["empty"] or m[0].endswith("/>")):
            opened[tag].append(m.start())
            if last.get(tag, -1) > m.start():
                raw = tag
    return sorted(i for tag, at in opened.items() for i in at if not (page and tag == "head"))


def _from_html(text: str) -> str:
    if "<" in text:
        text = re.sub(r"<!--.*?-->", "", text, flags=re.S)
    if "<" in text and _TAG.search(text):
        # a `<` that starts no tag is text, whatever an HTML parser makes of it
        page = _PAGE.search(text) is not None
        unclosed = _unclosed(text, page)
        if unclosed:
            text = "&lt;".join(text[a:b] for a, b in zip([0, *(i + 1 for i in unclosed)], [*unclosed, len(text)]))
        tree = _Tree(open_head=page and "</head" not in text.lower())
        tree.feed(re.sub(r"<(?!/?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>)(?!![A-Za-z])", "&lt;", text))
        tree.done()
        page = any(n.tag in ("body", "html") for n in tree.nodes)
        return _render(tree, _main_parts(tree) if page else _without_menus(tree))
    return html.unescape(text) if "&" in text else text


# ---------------------------------------------------------------- wiki, LaTeX, Markdown

_FORMULA = re.compile(
    r"\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)|\\begin\{(?P<env>equation|align|gather|multline|eqnarray|displaymath|math)(?P<star>\*?)\}.*?\\end\{(?P=env)(?P=star)\}|\$(?=[^\s$])(?=[^$\n]*[\\^_])[^$\n]*(?<=[^\s$])\$", re.S
)
_LEVEL = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}


def _wiki_table(m: re.Match) -> str:
    rows, row = [], []
    for line in m.group().split("\n")[1:]:
        if line.startswith("|-") or line.startswith("|}"):
            rows += [row] if row else []
            row = []
        elif line[:1] in "|!":
            row += [c.strip() for c in re.split(r"\|\||!!", line[1:])]
        elif row and line.strip():
            row[-1] += " " + line.strip()
    return "\n".join(" | ".join(r) for r in rows)


def _from_wiki(text: str) -> str:
    if "\n{|" in text:
        text = re.sub(r"(?<=\n)\{\|.*?\n\|\}[^\n]*", _wiki_table, text, flags=re.S)
    if "\n==" in text:
        text = re.sub(r"\n(={2,}) ([^\n]*) ={2,}[ \t]*" + _EOL, lambda m: "\n" + "#" * min(len(m[1]), 6) + " " + m[2].strip(), text)
    if "[[" in text:
        text = re.sub(r"\[\[(?:[^\]\[|\n]*\|)*([^\]\[|\n]*)\]\]", r"\1", text)
    if "{{" in text:
        text = re.sub(r"\{\{[^{}|\n]*\|?([^{}\n]*)\}\}", lambda m: m[1].replace("|", " "), text)
    return re.sub(r"'{2,5}", "", text) if "''" in text else text


_OPENING = re.compile(r"(\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{)|([{}])")


def _bare_commands(text: str) -> str:
    """Commands with a braced argument become the argument, however deep they stand in one another, in one pass.

    Braces without a command stay, as do commands whose brace isn't closed.
    """
    out, opened, at = [], [], 0
    for m in _OPENING.finditer(text):
        out.append(text[at : m.start()])
        at = m.end()
        if m[0] != "}":
            opened.append((len(out), bool(m[1])))  # where the opening stands, to be dropped if it is closed
            out.append(m[0])
        elif opened:
            place, command = opened.pop()
            if command:
                out[place] = ""
            else:
                out.append("}")
        else:
            out.append("}")
    return "".join(out) + text[at:]


def _from_latex(text: str) -> str:
    if "\\" not in text:
        return text
    text = re.sub(r"\\(part|chapter|(?:sub){0,2}section|paragraph)\*?\{([^{}\n]*)\}", lambda m: "\n" + "#" * _LEVEL[m[1]] + " " + m[2], text)
    text = re.sub(r"[ \t]*\\item(?![A-Za-z])(?:\[([^\]\n]*)\])?[ \t]*", lambda m: "- " + (m[1] + " " if m[1] else ""), text)
    text = re.sub(r"\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\]|\{[^{}\n]*\})*\n?", "", text)
    text = re.sub(r"~?\\(?:label|ref|eqref|pageref|cite[a-z]*|vspace|hspace|usepackage|documentclass|bibliography|input|include)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}", "", text)
    text = _bare_commands(text)
    return re.sub(r"\\([%&_#$])", r"\1", text)


def _from_markdown(text: str) -> str:
    if "](" in text:
        text = re.sub(r"!?\[([^\]\n]*)\]\([^)\n]*\)", r"\1", text)
    if "\n--" in text or "\n==" in text:
        text = re.sub(r"\n([^\n]*[^\W_])\n(={4,}|-{4,})[ \t]*" + _EOL, lambda m: "\n" + ("# " if m[2][0] == "=" else "## ") + m[1], text)
    if "|" in text:
        text = re.sub(r"\n\|(?:[ \t]*:?-+:?[ \t]*\|)+[ \t]*" + _EOL, "", text)
        text = re.sub(r"\n\|([^\n]*)\|[ \t]*" + _EOL, lambda m: "\n" + " | ".join(c.strip() for c in m[1].split("|")), text)
    if "*" in text:
        text = re.sub(r"\*\*([^\n]+?)\*\*", r"\1", text)
        text = re.sub(r"(?<![*\w])\*(?=[^\s*])([^*\n]*?[^\s*]?)\*(?![*\w])", r"\1", text)
    return re.sub(r"__(\w+?)__", r"\1", text) if "__" in text else text


def _code_text(kind: str, code: str) -> str:
    if kind in ("fence", "span"):
        return code
    if kind == "pre":
        code = html.unescape(re.sub(r"(?i)</?(?:pre|code)(?:\s[^<>]*)?>", "", code))
    else:
        code = code[len("\\begin{verbatim}") : -len("\\end{verbatim}")]
    return "\n```\n" + code.strip("\n") + "\n```\n"


def clean_text(doc: str | None) -> tuple[list[str], str | None]:
    """Kinds of markup in ``doc`` and its clean text; no kinds and null for null."""
    if doc is None:
        return [], None
    text, pieces = set_aside(body_of(doc))
    kinds = kinds_of(text, pieces)
    if "html" in kinds:
        text = _from_html(text)
    formulas: list[str] = []
    if "$" in text or "\\" in text:

        def keep(m: re.Match) -> str:
            formulas.append(m.group())
            return f"\ue002{len(formulas) - 1}\ue003"

        text = _FORMULA.sub(keep, text)
    text = "\n" + text
    for kind, f in (("wiki", _from_wiki), ("latex", _from_latex), ("markdown", _from_markdown)):
        if kind in kinds:
            text = f(text)
    if formulas:
        text = re.sub("\ue002([0-9]+)\ue003", lambda m: formulas[int(m[1])] if int(m[1]) < len(formulas) else m[0], text)
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text))
    if pieces:
        text = re.sub("\ue000([0-9]+)\ue001", lambda m: _code_text(*pieces[int(m[1])]) if int(m[1]) < len(pieces) else m[0], text)
    return kinds, text.strip("\n")


def clean_markup(df: DataFrame, text: str = "doc", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all but ``text`` by default) with kinds (of html, wiki, latex, markdown) and clean.

    * null text has no kinds and null clean; empty and blank texts have no kinds and empty clean;
    * unclosed code, tags and tables are text as far as they can't be read; very long and deeply nested texts are read whole;
    * repeated rows each give their row, an empty table none; columns named kinds or clean are replaced.
    """
    kept = [c for c in (keep if keep is not None else df.columns) if c not in (text, "kinds", "clean")]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("kinds", T.ArrayType(T.StringType(), False), False), T.StructField("clean", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [clean_text(t) for t in batch.column(len(kept)).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(kept))), pa.array([k for k, _ in made], pa.list_(pa.string())), pa.array([c for _, c in made], pa.string())], names=schema.names
            )

        yield from by_slice(one)(batches)

    return spread(df.select(*kept, text)).mapInArrow(run, schema)
