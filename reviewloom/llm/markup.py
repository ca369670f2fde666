"""Texts that still carry HTML, Markdown, wiki or LaTeX notation, as a reader would see them.

HTML goes through a tree: every paragraph passes points for its length and its commas to its parent and half of them
to its grandparent, a node's points are discounted by its link density, and the best container is kept together with
its siblings that score well or read like running text; the rest of a page (menus, link lists) is dropped. A fragment
without containers is its own best container and is kept whole. The other notations are read construct by construct.

Headings, lists, code, tables and formulas come out as blocks of that kind; in the text a list item begins with `- `,
the cells of a table row are separated by tabs, code and formulas keep their characters.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAMILIES = ("html", "markdown", "wiki", "latex")

# fixed values: element names of HTML
_ELEMENTS = (
    "a abbr acronym address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data "
    "datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header "
    "hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noscript object ol optgroup option output p param picture "
    "pre progress q s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th "
    "thead time title tr track tt u ul var video wbr"
).split()
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("script style head template noscript".split())
_CONTAINERS = frozenset("body div section article main aside nav header footer td form".split())
_ASIDE = frozenset("nav aside footer form".split())
_HEADINGS = {f"h{i}": i for i in range(1, 7)}

_TAG = re.compile(r"</?(?:" + "|".join(sorted(_ELEMENTS, key=len, reverse=True)) + r")(?:\s[^<>]*|\s*/)?>", re.I)
_COMMENT = re.compile(r"<!--(?:(?!<!--).)*?-->", re.S)
_DOCTYPE = re.compile(r"<!doctype\s[^>]*>", re.I)
_CHARREF = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));")

# In the patterns below no content may hold its own opening sign again, and line contents are matched possessively: a text
# full of signs that are never closed takes linear time.
_SPECIAL = re.compile(r"[<&#*_~`\[{|=$\\]|''|^ {0,3}-{2,}", re.M)

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n`]*\n(.*?)(?:^ {0,3}\1[`~]*[ \t]*$|\Z)", re.M | re.S)
_TICKS = re.compile(r"(?<!`)(`{1,2})(?!`)([^\n]+?)(?<!`)\1(?!`)")
_ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+([^\n]*?)[ \t]*#*[ \t]*$", re.M)
_SETEXT = re.compile(r"^(?! {4})(?![ \t]*(?:[-*+|>]|\{\|)[ \t\n])(?=[ \t]*\S)([^\n]++)\n {0,3}(=+|-{2,})[ \t]*$", re.M)
_STAR = re.compile(r"(?<![\\*])(\*{1,3})(?![\s*])((?:[^*\n]|\n(?!\s*\n))+?)(?<![\s\\])\1(?!\*)")
_UNDER = re.compile(r"(?<![\w\\])(_{1,3})(?![\s_])((?:[^_\n]|(?<=\w)_(?=\w)|\n(?!\s*\n))+?)(?<![\s\\])\1(?!\w)")
_STRIKE = re.compile(r"(?<!~)~~(?![\s~])((?:[^~\n]|\n(?!\s*\n))+?)(?<!\s)~~(?!~)")
_LINK = re.compile(r"(!?)\[([^\[\]\n]*(?:\n(?!\n)[^\[\]\n]*)*)\]\(\s*<?[^\s()<>]*(?:\([^\s()]*\)[^\s()<>]*)*>?(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)")
_REFERENCE = re.compile(r"(!?)(?<![\w\[\]])\[([^\[\]\n]+(?:\n(?!\n)[^\[\]\n]+)*)\]\[([^\[\]\n]*)\]")
_DEFINITION = re.compile(r"^ {0,3}\[[^\[\]\n]+\]:[ \t]+\S+[^\n]*$", re.M)
_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>")
_RULER = re.compile(r"^[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*\|?|\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?)[ \t]*$", re.M)

_WIKI_HEAD = re.compile(r"^(={1,6})[ \t]*([^\n=](?:[^\n]*?[^\n=])?)[ \t]*\1[ \t]*$", re.M)
_APOS = re.compile(r"''+")
_WIKI_LINK = re.compile(r"\[\[([^\[\]\n]+(?:\n(?!\n)[^\[\]\n]+)*)\]\]")
_EXTERNAL = re.compile(r"\[((?:https?:|ftp:|mailto:)?//[^\s\[\]]+|mailto:[^\s\[\]]+)([ \t]+[^\[\]\n]*(?:\n(?!\n)[^\[\]\n]*)*)?\]")
_BRACES = re.compile(r"(\{\{(?!\{)|\}\})")
_BRACE_TABLE = re.compile(r"^[ \t]*\{\|([^\n]*)\n((?:(?!^[ \t]*\{\|).)*?)^[ \t]*\|\}", re.M | re.S)

_COMMAND = re.compile(r"(?<!\\)\\(?:[a-zA-Z]+\*?|['`^\"~=.][a-zA-Z{]|[,;:!%&_#{}]|\\[ \t]*(?=\n|$))")
_PATH = re.compile(r"\b[A-Za-z]:(?:\\[\w.$~-]+)+\\?")
_DISPLAY = re.compile(r"(?<!\\)\$\$(?=[^$])(.+?)(?<!\\)\$\$|(?<!\\)\\\[((?:(?!\\\[).)+?)\\\]", re.S)
_MATH = re.compile(r"(?<![\\$\w])\$(?![\s$])([^$\n]++)(?<![\s\\])\$(?![\d$])|(?<!\\)\\\(((?:(?!\\\().)+?)\\\)", re.S)
_EQUATION = re.compile(r"\\begin\{(equation|align|eqnarray|gather|multline|displaymath|math)(\*?)\}((?:(?!\\begin\{\1).)*?)\\end\{\1\2\}", re.S)
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\}(?:\[[^\]\n]*\])?\n?((?:(?!\\begin\{\1\}).)*?)\\end\{\1\}", re.S)
_ENVIRONMENT = re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}")


class _Count:
    """Constructs consumed, by family."""

    def __init__(self) -> None:
        self.of = dict.fromkeys(FAMILIES, 0)

    def sub(self, family: str, pattern: re.Pattern, by, t: str) -> str:
        t, n = pattern.subn(by, t)
        self.of[family] += n
        return t


def find_families(text: str | None) -> list[str]:
    """The notations of which the text's converters consume at least one construct.

    Each converter reads the text by itself. HTML goes through the tree; a formula's and a code block's signs belong to it, so
    wiki and Markdown are read without them.
    """
    if not text or not _SPECIAL.search(text):
        return []
    n = _Count()
    if "<" in text or "&" in text:
        n.of["html"] = _tree(text).consumed
    plain = _PATH.sub(" ", text) if ":\\" in text else text
    bare = _formulas(plain, n, lambda kind, s: " ") if "\\" in plain or "$" in plain else plain
    if "\\" in plain:
        _from_latex(plain, _Marks(plain), n)
    if "\\begin" in bare:
        bare = _VERBATIM.sub("\n", bare)
    _from_markdown(_code(bare, n, lambda kind, s: " "), _Marks(bare), n)
    wiki = _FENCE.sub("\n", bare) if "```" in bare or "~~~" in bare else bare
    if any(x in wiki for x in ("''", "[", "{{", "{|", "=")):
        _from_wiki(wiki, _Marks(wiki), n)
    return [f for f in FAMILIES if n.of[f]]


def _formulas(t: str, n: _Count, hold) -> str:
    for kind, pattern in (("formula", _EQUATION), ("formula", _DISPLAY), ("math", _MATH)):
        t = n.sub("latex", pattern, lambda x: hold(kind, x[3].strip() if pattern is _EQUATION else (x[1] or x[2]).strip()), t)  # noqa: B023
    return t


def _code(t: str, n: _Count, hold) -> str:
    if "`" in t or "~~~" in t:
        t = n.sub("markdown", _FENCE, lambda x: hold("code", x[2].rstrip("\n")), t)
        t = n.sub("markdown", _TICKS, lambda x: hold("ticks", x[2].strip()), t)
    return t


class _Node:
    __slots__ = ("children", "name", "parent", "points", "link", "size")

    def __init__(self, name: str, parent: _Node | None):
        self.name, self.parent, self.children, self.points, self.link, self.size = name, parent, [], 0.0, 0, 0


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("#root", None)
        #: Tags, comments, declarations and character references read.
        self.consumed = 0

    def handle_comment(self, data):
        self.consumed += 1

    def handle_decl(self, decl):
        self.consumed += 1

    def handle_starttag(self, tag, attrs):
        self.consumed += 1
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):
            self._close(tag, within=("ul", "ol", "table", "tr", "dl", "div", "#root") if tag != "p" else ("#root",) if self.at.name == "p" else ())
        n = _Node(tag, self.at)
        if tag == "img":
            n.children.append(dict(attrs).get("alt") or "")
        self.at.children.append(n)
        if tag not in _VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def _close(self, tag, within) -> None:
        n = self.at
        while n.name != "#root" and n.name not in within:
            if n.name == tag:
                self.at = n.parent
                return
            n = n.parent

    def handle_endtag(self, tag):
        self.consumed += 1
        n = self.at
        while n.parent is not None and n.name != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _walk(root: _Node) -> list[_Node]:
    """Parents before children, without recursion."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in reversed(n.children) if isinstance(c, _Node)]
    return out


def keep_best(root: _Node) -> list:
    """The parts of the tree to keep, in order.

    A paragraph gives 1 point, 1 for each comma and 1 for each 100 characters (3 at most): all to its parent, half to
    its grandparent. A container's points are multiplied by 1 less its link density. Kept is the best container and, beside it
    and beside each container around it, what has at least a fifth of its points (10 at least) or few links; navigation,
    asides, footers and forms only by their points.
    """
    nodes = _walk(root)
    text_of: dict[int, list[str]] = {}
    for n in reversed(nodes):
        own = [c for c in n.children if isinstance(c, str)] if n.name not in _UNSEEN else []
        n.size = sum(len(s.strip()) for s in own) + sum(c.size for c in n.children if isinstance(c, _Node))
        n.link = n.size if n.name == "a" else sum(c.link for c in n.children if isinstance(c, _Node))
        text_of[id(n)] = own
    if not any(n.name in _CONTAINERS and n.name != "td" for n in nodes):
        return [root]
    for n in nodes:
        if n.name in ("p", "pre", "blockquote", "li") and n.size >= 25:
            commas = sum(s.count(",") + s.count("、") for s in text_of[id(n)])
            points = 1 + commas + min(n.size / 100, 3)
            if n.parent is not None:
                n.parent.points += points
                if n.parent.parent is not None:
                    n.parent.parent.points += points / 2
    density = lambda n: n.link / n.size if n.size else 0.0
    score = lambda n: n.points * (1 - density(n))
    best = max((n for n in nodes if n.name in _CONTAINERS or n is root), key=score)
    if best.parent is None:
        # loose text around containers: drop what is mostly links
        return [c for c in root.children if isinstance(c, str) or c.name not in _CONTAINERS or density(c) < 0.5]
    least = max(10.0, score(best) * 0.2)
    kept: list = [best]
    inner = best
    while inner.parent is not None:
        before: list = []
        after: list = []
        side = before
        for c in inner.parent.children:
            if c is inner:
                side = after
            elif isinstance(c, str) or c.points and score(c) >= least or c.name not in _ASIDE and density(c) < 0.25:
                side.append(c)
        kept = before + kept + after
        inner = inner.parent
    return kept


class _Marks:
    """Characters absent from the text, to mark blocks and to hold verbatim parts aside."""

    def __init__(self, text: str):
        free = (chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in text)
        self.a, self.b, self.k = next(free, "\ue000"), next(free, "\ue001"), next(free, "\ue002")
        self.held: list[tuple[str, str]] = []

    def hold(self, kind: str, s: str) -> str:
        self.held.append((kind, s))
        mark = f"{self.a}{len(self.held) - 1}{self.b}"
        return f"\n\n{mark}\n\n" if kind in ("code", "formula") else mark

    def head(self, level: int, s: str) -> str:
        return f"\n\n{self.k}h{level}{self.k}{' '.join(s.split())}\n\n"

    def row(self, cells: list[str]) -> str:
        return f"{self.k}t{self.k}" + "\t".join(" ".join(c.split()) for c in cells)


def _render(node, m: _Marks, out: list[str]) -> None:
    """Appends a kept part's text; an explicit stack, since trees may be deep."""
    todo: list = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        if n.name in _UNSEEN:
            continue
        if n.name == "br":
            out.append("\n")
        elif n.name == "hr":
            out.append("\n\n")
        elif n.name == "img":
            out.append(n.children[0])
        elif n.name == "pre":
            out.append(m.hold("code", _flat(n).strip("\n")))
        elif n.name in _HEADINGS:
            out.append(m.head(_HEADINGS[n.name], _flat(n)))
        elif n.name == "tr":
            cells = [c for c in n.children if isinstance(c, _Node) and c.name in ("td", "th")]
            out.append("\n" + m.row([_flat(c) for c in cells]) + "\n")
        elif n.name == "li":
            todo += ["\n", *reversed(n.children)]
            out.append("\n- ")
        elif n.name in ("p", "div", "section", "article", "blockquote", "ul", "ol", "table", "dl", "main", "header", "footer", "body", "figure"):
            todo += ["\n\n", *reversed(n.children)]
            out.append("\n\n")
        else:
            todo += reversed(n.children)


def _flat(n: _Node) -> str:
    out, todo = [], [n]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.name == "br":
            out.append("\n")
        elif x.name not in _UNSEEN:
            todo += reversed(x.children)
    return "".join(out)


def _tree(text: str) -> _Tree:
    # a sign that opens no element is an ordinary character
    spans = sorted([x.span() for p in (_TAG, _COMMENT, _DOCTYPE) for x in p.finditer(text)])
    parts, plain, at = [], [], 0
    for a, b in spans:
        if a < at:
            continue
        plain.append(text[at:a])
        parts += [plain[-1].replace("<", "&lt;"), text[a:b]]
        at = b
    plain.append(text[at:])
    parts.append(plain[-1].replace("<", "&lt;"))
    tree = _Tree()
    tree.feed("".join(parts))
    tree.close()
    # the parser resolves references while it reads text
    tree.consumed += sum(not m[1] or m[1] + ";" in html.entities.html5 for p in plain if "&" in p for m in _CHARREF.finditer(p))
    return tree


def _from_html(text: str, m: _Marks) -> str:
    out: list[str] = []
    for part in keep_best(_tree(text).root):
        _render(part, m, out)
    return "".join(out).replace("\xa0", " ")


def _templates(t: str, n: _Count) -> str:
    """Templates by what their unnamed arguments say, inner ones first; braces that nest in no template stay."""
    stack: list[list[str]] = [[]]
    for x in _BRACES.split(t):
        if x == "{{":
            stack.append([])
        elif x == "}}" and len(stack) > 1:
            inner = "".join(stack.pop())
            name, *args = inner.split("|")
            if name.strip() and "\n" not in name.strip() and not {"{", "}"} & set(inner):
                n.of["wiki"] += 1
                stack[-1].append(" ".join(a for a in args if "=" not in a))
            else:
                stack[-1].append("{{" + inner + "}}")
        else:
            stack[-1].append(x)
    return "{{".join("".join(x) for x in stack)


def _from_wiki(t: str, m: _Marks, n: _Count) -> str:
    def table(x):
        rows: list[list[str]] = [[]]
        for line in x[2].split("\n"):
            line = line.strip()
            if line.startswith("|-"):
                rows.append([])
            elif line[:1] in ("|", "!") and line[:2] != "|}":
                rows[-1] += [c.rpartition("|")[2] if "=" in c.partition("|")[0] and "|" in c else c for c in re.split(r"\|\||!!", line[1:])]
        return "\n\n" + "\n".join(m.row(r) for r in rows if r) + "\n\n"

    def link(x):
        parts = x[1].split("|")
        if re.match(r"(?:File|Image|Datei|Archivo|Fichier):", parts[0].strip(), re.I):
            return parts[-1] if len(parts) > 1 and not re.fullmatch(r"thumb|frame|left|right|center|none|\d+px", parts[-1]) else ""
        return parts[-1]

    t = n.sub("wiki", _BRACE_TABLE, table, t)
    t = _templates(t, n) if "{{" in t else t
    t = n.sub("wiki", _WIKI_HEAD, lambda x: m.head(len(x[1]), x[2]), t)
    t = n.sub("wiki", _WIKI_LINK, link, t)
    t = n.sub("wiki", _EXTERNAL, lambda x: (x[2] or x[1]).strip(), t)
    t = n.sub("wiki", _APOS, lambda x: "'" if len(x[0]) == 4 else "", t)
    t = re.sub(r"(?:^ \S?[^\n]*(?:\n|\Z))+", lambda x: m.hold("code", re.sub(r"(?m)^ ", "", x[0]).rstrip("\n")), t, flags=re.M)
    return re.sub(r"^[*#]+[ \t]+", "- ", t, flags=re.M)


def _from_markdown(t: str, m: _Marks, n: _Count) -> str:
    t = n.sub("markdown", _ATX, lambda x: m.head(len(x[1]), x[2]), t)
    t = n.sub("markdown", _RULER, m.k + "r", t)
    lines = t.split("\n")
    for i, line in enumerate(lines):
        if line == m.k + "r":
            lines[i] = ""
            j = i - 1
            if j >= 0 and "|" in lines[j]:
                lines[j] = m.row(lines[j].strip().strip("|").split("|"))
            j = i + 1
            while j < len(lines) and "|" in lines[j] and lines[j].strip():
                lines[j] = m.row(lines[j].strip().strip("|").split("|"))
                j += 1
    t = "\n".join(x for i, x in enumerate(lines) if not (x == "" and i and lines[i - 1].startswith(m.k + "t") and i + 1 < len(lines) and lines[i + 1].startswith(m.k + "t")))
    def underlined(x):
        n.of["markdown"] += not _WIKI_HEAD.match(x[1])
        return m.head(1 if x[2][0] == "=" else 2, x[1])

    t = _SETEXT.sub(underlined, t)
    defined = {x[0].split("]:")[0].split("[", 1)[1] for x in _DEFINITION.finditer(t)} if "]:" in t else ()
    t = n.sub("markdown", _DEFINITION, "", t)
    t = n.sub("markdown", _LINK, lambda x: x[2], t)

    def reference(x):
        # without a definition, two numbers in brackets are places in an array or in a bibliography
        if x[2].isdigit() and x[3].isdigit() and x[3] not in defined:
            return x[0]
        n.of["markdown"] += 1
        return x[2]

    t = _REFERENCE.sub(reference, t) if "][" in t else t
    t = _AUTOLINK.sub(lambda x: x[1], t)
    before = None
    while t != before:  # one round a level of nesting
        before = t
        t = n.sub("markdown", _STAR, lambda x: x[2], t)
        t = n.sub("markdown", _UNDER, lambda x: x[2], t)
    t = n.sub("markdown", _STRIKE, lambda x: x[1], t)
    return re.sub(r"^[ \t]*[*+][ \t]+", "- ", t, flags=re.M)


# fixed values: combining marks of accent commands
_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307"}
_SECTION = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
_WORDS = {"dots": "…", "ldots": "…", "textbackslash": "\\", "LaTeX": "LaTeX", "TeX": "TeX", "quad": " ", "qquad": " ", "newline": "\n", "par": "\n\n"}
_DROPPED = frozenset("ref cite label eqref pageref citep citet bibliography bibliographystyle usepackage documentclass index vspace hspace".split())
_OPENER = re.compile(r"(?<!\\)\\([a-zA-Z]+)\*?(?:\[[^\]\n]*\])?\Z")
_TABULAR = re.compile(r"\\begin\{(tabular|array)\*?\}(?:\{[^}\n]*\})?((?:(?!\\begin\{\1).)*?)\\end\{\1\*?\}", re.S)


def _arguments(t: str, command) -> str:
    """Replaces commands by what `command` makes of (name, argument), inner ones first; other groups keep their braces."""
    stack: list[list[str]] = [[]]
    for x in re.split(r"(?<!\\)([{}])", t):
        if x == "{":
            stack.append([])
        elif x == "}" and len(stack) > 1:
            arg = "".join(stack.pop())
            last = stack[-1][-1] if stack[-1] else ""
            if opener := _OPENER.search(last):
                stack[-1][-1] = last[: opener.start()]
                stack[-1].append(command(opener[1], arg))
            else:
                stack[-1].append("{" + arg + "}")
        else:
            stack[-1].append(x)
    return "{".join("".join(x) for x in stack)


def _from_latex(t: str, m: _Marks, n: _Count) -> str:
    import unicodedata

    n.of["latex"] += sum(1 for p in (_COMMAND, _ENVIRONMENT) if p.search(t))
    t = re.sub(r"(?<!\\)\\(['`^\"~=.])(?:\{([a-zA-Z])\}|([a-zA-Z]))", lambda x: unicodedata.normalize("NFC", (x[2] or x[3]) + _ACCENTS[x[1]]), t)

    def table(x):
        rows = [r for r in re.split(r"\\\\(?:\[[^\]]*\])?", x[2].replace("\\hline", "")) if r.strip()]
        return "\n\n" + "\n".join(m.row([c for c in re.split(r"(?<!\\)&", r)]) for r in rows) + "\n\n"

    def command(name, arg):
        if name in _SECTION:
            return m.head(_SECTION[name], arg)
        if name in _DROPPED:
            return ""
        if name in ("begin", "end"):
            return "\n"
        if name == "footnote":
            return f" ({arg})"
        return arg

    t = _TABULAR.sub(table, t)
    t = re.sub(r"~(?=\\(?:ref|cite|eqref))", "", t)
    t = _arguments(t, command)
    t = re.sub(r"\\item\b[ \t]*(?:\[([^\]\n]*)\])?[ \t]*", lambda x: f"\n- {x[1] + ' ' if x[1] else ''}", t)
    t = re.sub(r"\{\\(?:bf|it|em|tt|sc|sl|rm|sf|small|large|Large|huge)\b[ \t]*([^{}]*)\}", r"\1", t)
    t = re.sub(r"\\([a-zA-Z]+)\*?[ \t]?", lambda x: _WORDS.get(x[1], ""), t)
    t = re.sub(r"\\\\(?:\[[^\]\n]*\])?", "\n", t)
    return re.sub(r"\\([,;:! ])", lambda x: "" if x[1] == "!" else " ", re.sub(r"\\([%&_#{}$])", r"\1", t))


def convert(text: str | None) -> tuple[str | None, list[tuple[str, int, str]], list[str]]:
    """(clean text, blocks of (kind, level, text), families). Null stays null; a text without notation stays as it is."""
    families = find_families(text)
    if text is None:
        return None, [], []
    if not families:
        return text, [("paragraph", 0, p) for p in re.split(r"\n\s*\n", text) if p.strip()], []
    m, n = _Marks(text), _Count()
    t = text
    if "latex" in families:
        t = _VERBATIM.sub(lambda x: m.hold("code", x[2].strip("\n")), t)
        t = _formulas(t, n, m.hold)
    if "markdown" in families:
        t = _code(t, n, m.hold)
    if "html" in families:
        t = _from_html(t, m)
    if "wiki" in families:
        t = _from_wiki(t, m, n)
    if "latex" in families:
        t = _from_latex(t, m, n)
    if "markdown" in families:
        t = _from_markdown(t, m, n)
    blocks = _blocks(t, m)
    return "\n\n".join(b[2] for b in _joined(blocks)), blocks, families


def _joined(blocks):
    """Neighbouring list items and table rows as one piece of text."""
    out: list[list] = []
    for kind, level, s in blocks:
        s = "- " + s if kind == "list" else s
        if out and kind in ("list", "table") and out[-1][0] == kind:
            out[-1][2] += "\n" + s
        else:
            out.append([kind, level, s])
    return out


def _blocks(t: str, m: _Marks) -> list[tuple[str, int, str]]:
    held = re.compile(f"{m.a}(\\d+){m.b}")

    def back(s: str) -> str:
        # a held part may hold one that was held before it
        while (new := held.sub(lambda x: m.held[int(x[1])][1], s)) != s:
            s = new
        return s

    out: list[tuple[str, int, str]] = []
    para: list[str] = []

    def flush():
        if para:
            out.append(("paragraph", 0, back("\n".join(para))))
            para.clear()

    for line in t.split("\n"):
        line = line.strip(" \t")
        if x := held.fullmatch(line):
            kind, s = m.held[int(x[1])]
            if kind in ("code", "formula"):
                flush()
                out.append((kind, 0, back(s)))
                continue
        if line.startswith(m.k):
            flush()
            tag, _, rest = line[1:].partition(m.k)
            out.append(("heading", int(tag[1:]), back(rest)) if tag[:1] == "h" else ("table", 0, back(rest)))
        elif line.startswith("- "):
            flush()
            out.append(("list", 0, back(line[2:])))
        elif line:
            para.append(re.sub(r"[ \t]{2,}", " ", line.replace(m.k, "")))
        else:
            flush()
    flush()
    return [b for b in out if b[2].strip()]


_SCHEMA = "id bigint, text string, blocks array<struct<kind:string,level:int,text:string>>, families array<string>"
_BLOCK = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())]))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [convert(t) for t in b.column(1).to_pylist()]
        blocks = [[{"kind": k, "level": n, "text": s} for k, n, s in r[1]] for r in rows]
        yield pa.record_batch(
            [b.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array(blocks, _BLOCK), pa.array([r[2] for r in rows], pa.list_(pa.string()))],
            names=["id", "text", "blocks", "families"],
        )


def clean_markup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, blocks, families) of every document, in one narrow pass without an exchange.

    Null text gives null text and no blocks; empty text stays empty. Broken notation (unclosed tags, stray signs) is
    ordinary text as far as its renderer would show it. An empty table gives an empty table; other columns are ignored.
    """
    src = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return src.mapInArrow(_run, _SCHEMA).withColumnRenamed("id", id)
