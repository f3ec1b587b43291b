"""Markup residue in text documents: which kinds a text holds, and clean text that keeps its structure.

Code comes first, since what stands in it isn't markup: fences, inline code,
``<pre>``, ``<code>``, scripts and verbatim environments are set aside. Then
formulas, then each kind found is turned into blocks (headings, lists, code,
formulas, quotes, tables, text). HTML is parsed into a tree; every node gets
its composite text density, the characters per tag adjusted for links, and the
subtree with the greatest sum of its children's densities is the content,
together with whatever else reaches the least density on the path from the
body to it. Signs that only look like markup stay as they are.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.session import spread

KINDS = ("html", "markdown", "wiki", "latex")
# The names of HTML elements, in use or obsolete.
ELEMENTS = frozenset(
    """a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br
    button canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed
    fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe
    img input ins kbd label legend li link main map mark marquee menu meta meter nav nobr noframes noscript object ol
    optgroup option output p param picture pre progress q rp rt ruby s samp script search section select slot small
    source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr
    track tt u ul var video wbr""".split()
)
# Elements that begin a line of their own, and elements without an end.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
# What an element's start closes if it is still open.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}

_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>")
_COMMENT = re.compile(r"<!--.*?-->|<!(?:doctype|DOCTYPE)\b[^<>]*>", re.S)
_REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|([A-Za-z][A-Za-z0-9]*));")
_FENCE = re.compile(r"^ {0,3}(?:>[ ]?)*(`{3,}|~{3,})([^`\n]*)$", re.M)
_RAW_HTML = re.compile(r"<(pre|script|style|code|samp|kbd|tt|textarea)\b((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>(.*?)</\1\s*>", re.S | re.I)
_VERBATIM = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted|Verbatim|alltt)\}(.*?)\\end\{\1\}", re.S)
_VERB = re.compile(r"\\verb\*?([^A-Za-z\s*{])(.*?)\1")
_NOWIKI = re.compile(r"<(nowiki|syntaxhighlight|source)\b([^<>]*)>(.*?)</\1\s*>", re.S | re.I)
_INLINE = re.compile(r"(?<![`\\])(`+)(?!`)((?:[^`\n]|\n(?!\s*\n)|(?!\1(?!`))`)+?)(?<!`)\1(?!`)")
_DISPLAY = re.compile(r"(?<!\\)\$\$(?!\$)(.+?)(?<!\\)\$\$|\\\[(.+?)\\\]|\\begin\{((?:equation|align|gather|multline|displaymath|math|eqnarray)\*?)\}(.+?)\\end\{\3\}", re.S)
_FORMULA = re.compile(r"(?<![\\$\w])\$(?![\s$])((?:[^$\n\\]|\\.)+?)(?<![\s\\])\$(?![\d$])|\\\((.+?)\\\)", re.S)
_ENVIRONMENT = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}")
_COMMAND = re.compile(r"\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{")

_ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*$", re.M)
_SETEXT = re.compile(r"^(?=[^\n]*\w) {0,3}(?![-*+>#|=] ?)(\S[^\n]*)\n {0,3}(=+|-{2,})[ \t]*$", re.M)
_RULE = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$", re.M)
_BULLET = re.compile(r"^([ \t]*)([-*+])[ \t]+(?=\S)(\[[ xX]\][ \t]+)?", re.M)
_NUMBERED = re.compile(r"^([ \t]*)(\d{1,9})[.)][ \t]+(?=\S)", re.M)
_QUOTE = re.compile(r"^ {0,3}>[ \t]?(?=\S|$)", re.M)
_TABLE_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-+:?[ \t]*\|[ \t]*$", re.M)
_LINK = re.compile(r"(!?)\[((?:[^\[\]\n]|\[[^\[\]\n]*\])*)\]\(\s*<?([^()\s<>]*(?:\([^()\s]*\)[^()\s]*)*)>?(?:\s+(?:\"[^\"\n]*\"|'[^'\n]*'))?\s*\)")
_REF_LINK = re.compile(r"(!?)\[([^\[\]\n]+)\]\[([^\[\]\n]*)\]")
_REF_DEFINITION = re.compile(r"^ {0,3}\[([^\[\]\n]+)\]:[ \t]+\S+.*$", re.M)
_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^<>\s]+)>")
_STRONG = re.compile(r"(?<![\\*\w])(\*\*\*|\*\*)(?![\s*])([^\n]+?)(?<![\s\\*])\1(?!\*)|(?<![\\_\w])(___|__)(?![\s_])([^\n]+?)(?<![\s\\_])\3(?![\w_])")
_EM = re.compile(r"(?<![\\*\w])\*(?![\s*])([^*\n]+?)(?<![\s\\*])\*(?![*\w])|(?<![\\_\w])_(?![\s_])([^_\n]+?)(?<![\s\\_])_(?![\w_])")
_STRIKE = re.compile(r"(?<![~\w])~~(?![\s~])([^~\n]+?)(?<!\s)~~(?!~)")

_WIKI_HEADING = re.compile(r"^(={2,6})[ \t]*([^=\s](?:[^\n]*?[^=\s])?)[ \t]*\1[ \t]*$", re.M)
_WIKI_EMPHASIS = re.compile(r"(?<![\w'`])('{5}|'{3}|'{2})(?![\s'])([^\n]*?[^\s'])\1(?!')")
_WIKI_LINK = re.compile(r"\[\[(?![\[\s])([^\[\]\n|]+)(?:\|([^\[\]\n]*))?\]\]")
_TEMPLATE = re.compile(r"\{\{(?!\{)\s*([^{}|\n]+?)\s*((?:\|[^{}]*)?)\}\}", re.S)
_WIKI_TABLE = re.compile(r"^[ \t]*\{\|[^\n]*\n(.*?)^[ \t]*\|\}", re.M | re.S)
_WIKI_LIST = re.compile(r"^([:*#;]+)[ \t]+(?=\S)", re.M)

_SIGNS = re.compile(r"[<&#*_~`\[\]{}|\\$=>+\-]|''|^\s*\d+[.)]", re.M)
_FREE = [chr(c) for c in range(0xE000, 0xF8FF, 2)]


class _Held:
    """Places in a text for what must not be looked at; named by two characters that the text lacks."""

    def __init__(self, text: str) -> None:
        free = [c for c in _FREE if c not in text][:2]
        self.ok = len(free) == 2
        self.a, self.b = free if self.ok else ("", "")
        self.items: list[tuple[str, str]] = []
        self.pattern = re.compile(f"{self.a}(\\d+){self.b}") if self.ok else None

    def put(self, kind: str, content: str) -> str:
        if not self.ok:
            return content
        self.items.append((kind, content))
        return f"{self.a}{len(self.items) - 1}{self.b}"

    def expand(self, text: str, show=None) -> str:
        if not self.items:
            return text
        show = show or (lambda kind, content: content)
        return self.pattern.sub(lambda m: show(*self.items[int(m[1])]), text)


class _Node:
    __slots__ = ("tag", "children", "attrs", "chars", "tags", "link_chars", "link_tags", "density", "total", "parent")

    def __init__(self, tag: str, attrs: dict | None = None, parent: _Node | None = None) -> None:
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("body")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in ELEMENTS:
            self.at.children.append(self.get_starttag_text() or "")
            return
        if tag in ("html", "body", "head"):
            return
        shut = CLOSES.get(tag)
        while shut and self.at.tag in shut:
            self.at = self.at.parent
        if tag in BLOCKS and self.at.tag == "p":
            self.at = self.at.parent
        node = _Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ELEMENTS and tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        if tag not in ELEMENTS:
            self.at.children.append(f"</{tag}>")
            return
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def _post_order(root: _Node) -> list[_Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, _Node))
    return order[::-1]


def measure_density(root: _Node) -> None:
    """Composite text density of each node, and the sum of its children's.

    With C characters and T tags below a node, of which LC and LT in links,
    the density is C/T * log(C*T / (LC*LT)) to the base
    ln(C*LC/(C-LC) + LC_body*C/C_body + e). Denominators are at least 1.
    """
    order = _post_order(root)
    for node in order:
        for child in node.children:
            if isinstance(child, _Node):
                link = child.tag in ("a", "button", "select")
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.chars if link else child.link_chars
                node.link_tags += child.link_tags + link
            else:
                node.chars += len("".join(child.split()))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
    body_share = root.link_chars / max(root.chars, 1)
    for node in order:
        if node.chars:
            c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
            base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + body_share * c + math.e)
            node.density = c / t * max(0.0, math.log(max(c / lc * (t / lt), 1.0))) / max(math.log(base), 1.0)
        node.total = sum(child.density for child in node.children if isinstance(child, _Node)) + (node.density if node.tag == "body" and any(isinstance(x, str) and x.strip() for x in node.children) else 0.0)


def content_nodes(root: _Node) -> set[int]:
    """ids of the nodes that are content: the best subtree's ancestors, it with all below it, and what else is as dense."""
    measure_density(root)
    order = _post_order(root)[::-1]
    best = max(order, key=lambda n: n.total)
    path, node = [], best
    while node is not None:
        path.append(node)
        node = node.parent
    least = min(n.density for n in path)
    keep: set[int] = {id(n) for n in path}
    stack = [(root, best is root)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node is best
        dense = node.density >= least and node.parent is not None and node.chars > 0
        heading = node.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        if inside or dense or heading:
            keep.add(id(node))
            up = node.parent
            while up is not None and id(up) not in keep:
                keep.add(id(up))
                up = up.parent
        boiler = node.tag in ("nav", "footer", "script", "style", "template") and node is not best
        stack.extend((c, (inside or (dense and id(node) not in {id(p) for p in path})) and not boiler) for c in node.children if isinstance(c, _Node))
    return keep


def html_to_lines(text: str) -> str:
    """HTML to lines whose structure is told by plain signs: # headings, - items, > quotes, | cells.

    Character references become characters. Elements that no browser knows
    stay as text. What isn't content by its density is left out.
    """
    tree = _Tree()
    tree.feed(text)
    tree.close()
    keep = content_nodes(tree.root)
    out: list[str] = []
    # iterative, since documents may nest without bound
    stack: list = [tree.root]
    depth: list[str] = []
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        if isinstance(item, tuple):
            out.append(item[0])
            if item[1] and depth:
                depth.pop()
            continue
        if id(item) not in keep and item.chars:
            continue
        tag, before, after, pop = item.tag, "", "", False
        if tag in ("script", "style", "template"):
            continue
        if tag[0] == "h" and tag[1:].isdigit():
            before, after = f"\n\n{'#' * int(tag[1:])} ", "\n\n"
        elif tag in ("ul", "ol"):
            depth.append(tag)
            before = after = "\n" if len(depth) > 1 else "\n\n"
            pop = True
        elif tag == "li":
            before = f"\n{'  ' * max(0, len(depth) - 1)}- "
        elif tag in ("td", "th"):
            before = " | "
        elif tag == "br":
            before = "\n"
        elif tag == "hr":
            before = "\n\n"
        elif tag == "img":
            before = item.attrs.get("alt") or ""
        elif tag == "blockquote":
            before, after = "\n\n> ", "\n\n"
        elif tag == "tr":
            before = "\n"
        elif tag in BLOCKS and tag != "body":
            before = after = "\n\n"
        out.append(before)
        stack.append((after, pop))
        stack.extend(re.sub(r"[ \t\r\n]+", " ", c) if isinstance(c, str) and tag != "body" else c for c in reversed(item.children))
    return "".join(out)


def _language(info: str) -> str:
    return info.split()[0] if info.split() else ""


def _hold_fences(text: str, held: _Held, kinds: set[str]) -> str:
    """Fenced blocks; one that isn't closed goes to the end."""
    if "```" not in text and "~~~" not in text:
        return text
    out, at = [], 0
    while (m := _FENCE.search(text, at)) is not None:
        mark = m[1]
        end = re.compile(rf"^ {{0,3}}(?:>[ ]?)*{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", re.M).search(text, m.end() + 1)
        body = text[m.end() + 1 : end.start() if end else len(text)].rstrip("\n")
        kinds.add("markdown")
        out += [text[at : m.start()], "\n", held.put("code", f"{_language(m[2])}\n{body}"), "\n"]
        at = end.end() if end else len(text)
    return "".join([*out, text[at:]])


def _hold_code(text: str, held: _Held, kinds: set[str]) -> str:
    text = _hold_fences(text, held, kinds)

    def raw(m: re.Match) -> str:
        kinds.add("html")
        tag, body = m[1].lower(), m[3]
        if tag in ("script", "style"):
            return " "
        if tag in ("pre", "textarea"):
            body = re.sub(r"^\s*<code\b[^<>]*>|</code\s*>\s*$", "", body)
            body = html.unescape(_TAG.sub("", body)).strip("\n")
            return "\n\n" + held.put("code", "\n" + held.expand(body)) + "\n\n"
        return held.put("inline", html.unescape(_TAG.sub("", body)))

    def verbatim(m: re.Match) -> str:
        kinds.add("latex")
        return "\n\n" + held.put("code", "\n" + re.sub(r"^\[[^\]\n]*\]|^\{[^}\n]*\}", "", m[2]).strip("\n")) + "\n\n"

    def wiki_raw(m: re.Match) -> str:
        kinds.add("wiki")
        return held.put("inline" if m[1].lower() == "nowiki" or "\n" not in m[3] else "code", m[3] if m[1].lower() == "nowiki" or "\n" not in m[3] else "\n" + m[3].strip("\n"))

    def inline(m: re.Match) -> str:
        kinds.add("markdown")
        return held.put("inline", m[2].strip() or m[2])

    def verb(m: re.Match) -> str:
        kinds.add("latex")
        return held.put("inline", m[2])

    if "\\begin{" in text:
        text = _VERBATIM.sub(verbatim, text)
    if "\\verb" in text:
        text = _VERB.sub(verb, text)
    if "<" in text:
        text = _NOWIKI.sub(wiki_raw, text)
        if "</" in text:
            text = _RAW_HTML.sub(raw, text)
    return _INLINE.sub(inline, text) if "`" in text else text


def _hold_formulas(text: str, held: _Held, kinds: set[str]) -> str:
    def display(m: re.Match) -> str:
        kinds.add("latex")
        return "\n\n" + held.put("display", (m[1] or m[2] or m[4] or "").strip()) + "\n\n"

    def formula(m: re.Match) -> str:
        kinds.add("latex")
        return held.put("formula", (m[1] or m[2]).strip())

    if "$" in text or "\\" in text:
        text = _FORMULA.sub(formula, _DISPLAY.sub(display, text))
    return text


def _has_html(text: str) -> bool:
    return ("<" in text and (any(m[1].lower() in ELEMENTS for m in _TAG.finditer(text)) or _COMMENT.search(text) is not None)) or ("&" in text and any(m[1] is None or f"{m[1]};" in html5 for m in _REFERENCE.finditer(text)))


def _has_wiki(text: str) -> bool:
    return bool(("==" in text and _WIKI_HEADING.search(text)) or ("''" in text and _WIKI_EMPHASIS.search(text)) or ("[[" in text and _WIKI_LINK.search(text)) or ("{{" in text and _TEMPLATE.search(text)) or ("{|" in text and _WIKI_TABLE.search(text)))


def _has_latex(text: str) -> bool:
    return "\\" in text and (_ENVIRONMENT.search(text) is not None or _COMMAND.search(text) is not None)


def _has_markdown(text: str, wiki: bool) -> bool:
    """In wiki text, lines that begin with * or # are the wiki's own lists."""
    if _SETEXT.search(text) or _RULE.search(text) or _QUOTE.search(text) or _TABLE_RULE.search(text) or _NUMBERED.search(text):
        return True
    if any(not wiki or m[2] != "*" for m in _BULLET.finditer(text)):
        return True
    if any(not wiki or len(m[1]) > 1 for m in _ATX.finditer(text)):
        return True
    if "[" in text and (_LINK.search(text) or _REF_DEFINITION.search(text)):
        return True
    return bool(("*" in text or "_" in text) and (_STRONG.search(text) or _EM.search(text)) or ("~~" in text and _STRIKE.search(text)) or ("<" in text and _AUTOLINK.search(text)))


def _wiki_to_lines(text: str) -> str:
    text = _WIKI_LIST.sub(lambda m: "" if set(m[1]) <= {":", ";"} else "  " * (len(m[1].replace(":", "")) - 1) + "- ", text)
    text = _WIKI_HEADING.sub(lambda m: f"\n{'#' * len(m[1])} {m[2]}\n", text)

    def table(m: re.Match) -> str:
        rows = re.split(r"^[ \t]*\|-.*$", m[1], flags=re.M)
        lines = []
        for row in rows:
            cells = [c.strip() for c in re.split(r"\|\||!!|^[ \t]*[|!]", row, flags=re.M) if c.strip()]
            if cells:
                lines.append(" | " + " | ".join(" ".join(c.split()) for c in cells))
        return "\n" + "\n".join(lines) + "\n"

    text = _WIKI_TABLE.sub(table, text)
    for _ in range(8):  # templates within templates, from the inside
        new = _TEMPLATE.sub(lambda m: _template(m[1], m[2]), text)
        if new == text:
            break
        text = new
    text = _WIKI_LINK.sub(lambda m: m[2] if m[2] else m[1].split(":", 1)[-1] if m[1].lower().startswith(("category:", "file:", "image:")) else m[1], text)
    for _ in range(3):
        text = _WIKI_EMPHASIS.sub(lambda m: m[2], text)
    return text


def _template(name: str, rest: str) -> str:
    """A template's last positional value; of one with named values, the values as lines."""
    parts = [p.strip() for p in rest.split("|")[1:]]
    named = [p.split("=", 1) for p in parts if re.match(r"[\w ]+=", p)]
    free = [p for p in parts if p and not re.match(r"[\w ]+=", p)]
    if free:
        return free[-1]
    return "\n" + "\n".join(f"{k.strip()}: {v.strip()}" for k, v in named) + "\n" if named else "" if parts else name


_DROPPED = frozenset("label ref cite pageref eqref index vspace hspace usepackage documentclass bibliographystyle bibliography input include graphicspath includegraphics".split())


def _latex_to_lines(text: str) -> str:
    levels = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "title": 1}

    def table(m: re.Match) -> str:
        body = re.sub(r"\\(hline|toprule|midrule|bottomrule|cline\{[^}]*\})", "", m[1])
        return "\n" + "\n".join(" | " + " | ".join(" ".join(c.split()) for c in re.split(r"(?<!\\)&", row)) for row in body.split("\\\\") if row.strip()) + "\n"

    text = re.sub(r"\\begin\{tabular\*?\}(?:\{[^{}\n]*\})?(.*?)\\end\{tabular\*?\}", table, text, flags=re.S)
    text = re.sub(r"[ \t]*\\item(?:\[([^\]\n]*)\])?[ \t]*", lambda m: "\n- " + (f"{m[1]}: " if m[1] else ""), text)
    text = re.sub(r"\\(begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?", "\n", text)
    for _ in range(8):  # commands within commands, from the inside

        def command(m: re.Match) -> str:
            name, body = m[1], m[2]
            if name in levels:
                return f"\n\n{'#' * levels[name]} {body.strip()}\n\n"
            if name in _DROPPED:
                return ""
            return f" ({body.strip()})" if name == "footnote" else body

        new = re.sub(r"~?\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", command, text)
        if new == text:
            break
        text = new
    return re.sub(r"\\([#$%&_{}])", r"\1", text)


def _markdown_to_lines(text: str, wiki: bool) -> str:
    text = _TABLE_RULE.sub("", text)
    text = _SETEXT.sub(lambda m: f"{'#' if m[2][0] == '=' else '##'} {m[1].strip()}", text)
    text = _RULE.sub("", text)
    text = _REF_DEFINITION.sub("", text)
    if not wiki:
        text = _ATX.sub(lambda m: f"{m[1]} {m[2]}", text)
    text = _BULLET.sub(lambda m: f"{m[1]}- ", text)
    text = _NUMBERED.sub(lambda m: f"{m[1]}- ", text)
    for _ in range(3):
        text = _LINK.sub(lambda m: m[2], text)
    text = _REF_LINK.sub(lambda m: m[2], text)
    text = _AUTOLINK.sub(lambda m: m[1], text)
    for _ in range(3):
        text = _STRONG.sub(lambda m: m[2] or m[4], text)
        text = _EM.sub(lambda m: m[1] or m[2], text)
    return _STRIKE.sub(lambda m: m[1], text)


def clean(text: str | None) -> tuple[list[str], list[tuple[str, int, str]]]:
    """(kinds of markup, blocks) of a text; a block is (kind, level, text).

    Kinds of blocks: heading (with level), list (with depth), code, formula,
    quote, table, text. A text without markup is one text block, unchanged; null
    and blank texts have no blocks. Formulas within a line stay there as $...$.
    """
    if not text or not text.strip():
        return [], []
    if not _SIGNS.search(text):
        return [], [("text", 0, text)]
    kinds: set[str] = set()
    plain = text.replace("\r\n", "\n").replace("\r", "\n")
    held = _Held(plain)
    body = _hold_formulas(_hold_code(plain, held, kinds), held, kinds)
    if _has_html(body):
        kinds.add("html")
    bare = _COMMENT.sub("", body) if "html" in kinds else body
    wiki = _has_wiki(bare)
    if wiki:
        kinds.add("wiki")
    if _has_latex(bare):
        kinds.add("latex")
    if _has_markdown(_TAG.sub(lambda m: m[0] if m[1].lower() not in ELEMENTS else " ", bare) if "html" in kinds else bare, wiki):
        kinds.add("markdown")
    if not kinds:
        return [], [("text", 0, text)]
    if "html" in kinds and ("<" in body or "&" in body):
        body = html_to_lines(_AUTOLINK.sub(lambda m: m[1], body))
    if wiki:
        body = _wiki_to_lines(body)
    if "latex" in kinds:
        body = _latex_to_lines(body)
    if "markdown" in kinds:
        body = _markdown_to_lines(body, wiki)
    return [k for k in KINDS if k in kinds], _blocks(body, held)


_HEAD = re.compile(r"^ {0,3}(#{1,6}) +(.*)$")
_ITEM = re.compile(r"^([ \t]*)- +(.*)$")


def _blocks(body: str, held: _Held) -> list[tuple[str, int, str]]:
    show = lambda kind, content: f"${content}$" if kind in ("formula", "display") else content.split("\n", 1)[-1] if kind == "code" else content
    out: list[tuple[str, int, str]] = []
    prose: list[str] = []

    def flush() -> None:
        if any(p.strip() for p in prose):
            out.append(("text", 0, "\n".join(prose).strip("\n")))
        prose.clear()

    for line in body.split("\n"):
        alone = held.pattern.fullmatch(line.strip()) if held.ok else None
        if alone and held.items[int(alone[1])][0] in ("code", "display"):
            flush()
            kind, content = held.items[int(alone[1])]
            out.append(("code" if kind == "code" else "formula", 0, content.split("\n", 1)[-1] if kind == "code" else content))
            continue
        shown = held.expand(line, show)
        if not line.strip():
            flush()
        elif m := _HEAD.match(line):
            flush()
            out.append(("heading", len(m[1]), held.expand(m[2], show).strip()))
        elif m := _ITEM.match(line):
            flush()
            out.append(("list", len(m[1].expandtabs(4)) // 2 + 1, held.expand(m[2], show).strip()))
        elif line.startswith((">", " >")):
            flush()
            out.append(("quote", 0, shown.strip().lstrip("> ").strip()))
        elif line.lstrip().startswith("| ") or line.startswith(" | "):
            flush()
            out.append(("table", 0, " | ".join(c.strip() for c in shown.strip().strip("|").split("|"))))
        else:
            prose.append(shown.strip() if shown.strip() != shown and not out else shown)
    flush()
    return out


def render(blocks: list[tuple[str, int, str]]) -> str:
    """Blocks as plain text in which they can be told: # headings, - items, fenced code, $$ formulas, > quotes."""
    lines: list[str] = []
    before = ""
    for kind, level, text in blocks:
        if lines and not (kind == before and kind in ("list", "table", "quote")):
            lines.append("")
        before = kind
        lines.append({"heading": f"{'#' * max(1, level)} {text}", "list": f"{'  ' * max(0, level - 1)}- {text}", "code": f"```\n{text}\n```", "formula": f"$${text}$$", "quote": f"> {text}"}.get(kind, text))
    return "\n".join(lines)


def clean_fields(rows: DataFrame, keys: list[str], fields: dict[str, Column], with_text: bool = True) -> DataFrame:
    """(keys, field_name, kinds, blocks, clean_text) of each field that holds markup.

    ``blocks`` counts the blocks by kind, as a map. One scan, no shuffle; texts
    without markup, null and blank ones give no rows: they are clean as they
    are. A row that comes twice comes out twice; other columns aren't read.
    Keys must not be named as a result column (ValueError).
    """
    if clash := set(keys) & {"field_name", "kinds", "blocks", "clean_text"}:
        raise ValueError(f"key columns clash with result columns: {sorted(clash)}")
    names, width = list(fields), len(keys)
    slim = rows.select(*(F.col(k).cast("string").alias(k) for k in keys), *(e.alias(f"__{n}") for n, e in enumerate(fields.values())))
    schema = T.StructType([*(T.StructField(k, T.StringType()) for k in keys), T.StructField("field_name", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("blocks", T.MapType(T.StringType(), T.IntegerType())), *([T.StructField("clean_text", T.StringType())] if with_text else [])])
    types = [*[pa.string()] * (width + 1), pa.list_(pa.string()), pa.map_(pa.string(), pa.int32()), *([pa.string()] if with_text else [])]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                for name, text in zip(names, values[width:]):
                    kinds, blocks = clean(text)
                    if kinds:
                        count: dict[str, int] = {}
                        for kind, _, _ in blocks:
                            count[kind] = count.get(kind, 0) + 1
                        out.append((*values[:width], name, kinds, list(count.items()), *([render(blocks)] if with_text else [])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [f.name for f in schema])

    return spread(slim).mapInArrow(walk, schema)


def clean_nodes(nodes: DataFrame, with_text: bool = True) -> DataFrame:
    """``clean_fields`` of the docs nodes' content and embedding_text, by slug and node_id."""
    docs = nodes.filter(F.col("corpus") == "docs").select("slug", F.col("id").alias("node_id"), "content", "embedding_text")
    return clean_fields(docs, ["slug", "node_id"], {"content": F.col("content"), "embedding_text": F.col("embedding_text")}, with_text)


def found_markup(nodes: DataFrame) -> DataFrame:
    """Distinct (slug, node_id, field_name, markup): the kinds of markup that cleaning took out."""
    return clean_nodes(nodes, with_text=False).select("slug", "node_id", "field_name", F.explode("kinds").alias("markup")).distinct()
