"""Conversion of texts with HTML, Markdown, wiki or LaTeX markup to clean text that keeps its structure.

Headings come out as "# ", list items as "- " or "1. ", code between ``` fences
(inline code between backticks) and formulas between $ or $$. HTML is parsed to a
tree, of every text that has any: every node gets its composite text density (its
link-adjusted characters per tag) and the sum of its children's; of a whole page the
subtree with the largest sum is the content, a fragment is the subtree itself; in it
the blocks below the least density on the path to the body go if they are page
furniture or links for the most part, in a whole page any such block.

The shape of the marks decides what is markup: `<`, `*`, `#`, `&`, `_`, `$` and
brackets as ordinary characters stay. List markers alone are no markup. Trees are
walked without recursion, so no depth of nesting is too much.
"""

from __future__ import annotations

import html
import math
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of HTML, and of the extensions wiki text uses.
HTML_NAMES = (
    "a abbr acronym address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data dd del details dfn dialog div dl dt em embed "
    "fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol optgroup option "
    "p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr"
).split()
WIKI_NAMES = "ref references nowiki math syntaxhighlight source gallery poem includeonly noinclude onlyinclude".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tr ul".split())
FURNITURE = frozenset("html body nav header footer aside script style form".split())
DROPPED = frozenset("script style head template noscript iframe object select button".split())

_NAMES = "|".join(sorted({*HTML_NAMES, *WIKI_NAMES}, key=len, reverse=True))
_TAG = re.compile(rf"</?(?:{_NAMES})(?:\s[^<>]*)?/?>", re.I)
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>|</?(?:{_NAMES})(?:\s[^<>]*)?/?>", re.I | re.S)
_TAG_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));")
_MD_HEAD = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$", re.M)
_SETEXT = re.compile(r"^(?=\S)([^\n]+)\n(={3,}|-{3,})[ \t]*$", re.M)
_BOLD = re.compile(r"(?<![\w*])(\*\*\*|\*\*)(?=[^\s*])([^\n]*?[^\s*])\1(?!\*)|(?<![\w_])__(?=[^\s_])([^\n_]*?[^\s_])__(?![\w_])")
_ITALIC = re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*[^\s*\\])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])([^_\n]*[^\s_])_(?![\w_])")
_STRIKE = re.compile(r"~~(?=\S)([^~\n]+?)(?<=\S)~~")
_FENCE = re.compile(r"^[ \t]*(```|~~~)[ \t]*([\w+-]*)[ \t]*\n(.*?)(?:^[ \t]*\1[ \t]*$|\Z)", re.M | re.S)
_FENCE_INLINE = re.compile(r"```([^`]+)```", re.S)
_CODE = re.compile(r"(?<!`)`([^`\n]+)`(?!`)")
_MD_LINK = re.compile(r"(!?)\[([^\[\]\n]*)\]\((?:<[^<>\s]*>|(?:https?:|/|#|\.|mailto:|www\.)[^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:\s+\"[^\"]*\")?\)")
_MD_QUOTE = re.compile(r"^>[ \t]+(?=\S)", re.M)
_MD_TABLE = re.compile(r"^\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$", re.M)
_W_LINK = re.compile(r"\[\[([^\[\]|]*)(?:\|([^\[\]]*))?\]\]")
_W_EXT = re.compile(r"\[(?:https?|ftp)://[^\s\]]+(?:\s+([^\[\]]*))?\]")
_W_QUOTE = re.compile(r"'{5}|'{2,3}")
_W_RUN = re.compile(r"'{2,}")
_W_HEAD = re.compile(r"^(={2,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", re.M)
_TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}")
_W_TABLE = re.compile(r"^\{\|.*?^\|\}[ \t]*$", re.M | re.S)
_MAGIC = re.compile(r"__(?:NO)?(?:TOC|EDITSECTION|INDEX|GALLERY)__|__FORCETOC__")
_TEX_CMD = re.compile(r"\\(?:[A-Za-z]{2,}\*?(?=[\s{}\[\]\\$^_.,;:)(|0-9=+-]|$)|[LlOoij]\b|[&%#_{}$](?=\S|\s)|[\[\]()](?=\s*\S)|[`'^\"~=.][A-Za-z{])")
_TEX_ANCHOR = re.compile(r"\\(?:(?:sub){0,2}(?:section|chapter|paragraph)\*?|begin|end|item|emph|text\w{2}|textbf|frac|sum|bar|leq|times|ln|cite|label|ref|href|url|footnote|underline|title|author|alpha|beta|cdot|sqrt|int|infty|math\w+|left|right|hline|newline|noindent|vspace|hspace|par|LaTeX|TeX)\b|\\[&%#_$](?=[\w\s])|\\\(.+?\\\)|\\\[.+?\\\]", re.S)
_MATH = re.compile(r"\$\$(?=\S)(.+?)(?<=\S)\$\$|(?<![\w$\\])\$(?=[^\s\d$])([^$\n]*[^\s$\\])\$(?![\w$])", re.S)
_TEX_ENV = re.compile(r"\\begin\{(equation|align|displaymath|math|gather|multline)(\*?)\}(.*?)(?:\\end\{\1\2\}|\Z)", re.S)
_TEX_VERB = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\}(?:\[[^\]]*\])?\n?(.*?)(?:\\end\{\1\}|\Z)", re.S)
_TEX_ARG = re.compile(r"\\(?:emph|text\w{2,5}|underline|mbox|textbf|textit|mathrm)\{([^{}]*)\}")
_TEX_HEAD = re.compile(r"\\(chapter|(?:sub){0,2}section|paragraph)\*?\{([^{}]*)\}")
_HOLD = re.compile("\ue000(\\d+)\ue001")


def _has_wiki_emphasis(text: str) -> bool:
    """Whether some quotes open (a character follows) and others after them close (one is before), however far apart."""
    opened = False
    for m in _W_RUN.finditer(text):
        if opened and text[m.start() - 1] not in " \t\n\r\u00a0":
            return True
        opened = opened or not text[m.end() : m.end() + 1].isspace() and m.end() < len(text)
    return False


def kinds_of(text: str) -> list[str]:
    """Which markup the text holds: of html, entity, markdown, wiki, latex; [] for ordinary text."""
    found = []
    if "<" in text and (_TAG.search(text) or "<!--" in text or "<!DOCTYPE" in text):
        found.append("html")
    if "&" in text and any(not m.group(1) or m.group(1) + ";" in html5 for m in _ENTITY.finditer(text)):
        found.append("entity")
    if (
        ("#" in text and _MD_HEAD.search(text))
        or ("**" in text and _BOLD.search(text))
        or ("__" in text and _BOLD.search(text))
        or ("*" in text and _ITALIC.search(text))
        or ("_" in text and _ITALIC.search(text))
        or ("](" in text and _MD_LINK.search(text))
        or ("```" in text)
        or ("`" in text and _CODE.search(text))
        or ("~~" in text and _STRIKE.search(text))
        or ("---" in text and (_MD_TABLE.search(text) or _SETEXT.search(text)))
    ):
        found.append("markdown")
    if (
        ("[[" in text and _W_LINK.search(text))
        or ("{{" in text)
        or ("''" in text and _has_wiki_emphasis(text))
        or ("==" in text and _W_HEAD.search(text))
        or ("[http" in text and _W_EXT.search(text))
        or ("{|" in text and _W_TABLE.search(text))
        or ("__" in text and _MAGIC.search(text))
    ):
        found.append("wiki")
    if ("\\" in text and _TEX_ANCHOR.search(text)) or ("$" in text and _MATH.search(text)):
        found.append("latex")
    return found


class Node:
    """An element: its tag, the text of its tag (kind), children, and what is measured of its subtree. marks, of the root
    only: how many tags and comments the text has."""

    __slots__ = ("chars", "children", "density", "kind", "link_chars", "link_tags", "marks", "tag", "tags", "total")

    def __init__(self, tag: str, kind: str = ""):
        self.tag, self.kind = tag, kind
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = self.marks = 0
        self.density = self.total = 0.0


_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def parse_html(text: str) -> Node:
    """A tree of the elements of text. Unclosed and stray tags are tolerated; comments are left out."""
    root = Node("#root")
    stack, at = [root], 0
    for m in _TOKEN.finditer(text):
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        token = m.group(0)
        root.marks += 1
        if token.startswith("<!"):
            continue
        tag = _TAG_NAME.match(token).group(1).lower()
        if token.startswith("</"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            else:
                if tag in BLOCK:
                    stack[-1].children.append("\n")
            continue
        while len(stack) > 1 and stack[-1].tag in _CLOSES.get(tag, ()):
            stack.pop()
        node = Node(tag, token)
        stack[-1].children.append(node)
        if tag not in VOID and not token.endswith("/>"):
            stack.append(node)
    if at < len(text):
        stack[-1].children.append(text[at:])
    return root


def _below(node: Node) -> list[tuple[Node, Node | None, bool]]:
    """(node, parent, whether it is in a link) of a subtree, parents first; elements that hold no text of the page left out."""
    order: list[tuple[Node, Node | None, bool]] = [(node, None, node.tag == "a")]
    for n, _, linked in order:
        order += [(c, n, linked or c.tag == "a") for c in n.children if not isinstance(c, str) and c.tag not in DROPPED]
    return order


def measure(root: Node) -> list[tuple[Node, Node | None, bool]]:
    """Characters, tags, link characters and link tags of every subtree; the nodes, parents first."""
    order = _below(root)
    for node, parent, linked in reversed(order):
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        node.chars += own
        node.link_chars += own if linked else 0
        if parent is not None:
            parent.chars += node.chars
            parent.tags += node.tags + 1
            parent.link_chars += node.link_chars
            parent.link_tags += node.link_tags + (node.tag == "a")
    return order


def _density(node: Node, body: Node) -> float:
    """Composite text density: characters per tag, the less the more of them are links."""
    c, t, lc, lt = max(node.chars, 1), max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
    other = max(node.chars - node.link_chars, 1)
    base = math.log(c / other * node.link_chars + body.link_chars / max(body.chars, 1) * node.chars + math.e)
    adjusted = c / lc * t / lt
    return node.chars / t * (math.log(max(adjusted, 1.0) + 1e-9) / math.log(base + 1e-9) if base > 1.0 + 1e-6 else math.log(adjusted + 1.0))


def main_content(root: Node) -> tuple[Node, float, bool]:
    """The subtree with the largest sum of its children's densities, the least density on its path to the body, and whether
    the text is a whole page. A fragment (neither html nor body nor page furniture) is the subtree itself."""
    order = measure(root)
    tags: dict[str, Node] = {}
    for n, _, _ in order:
        tags.setdefault(n.tag, n)
    page = bool(FURNITURE & tags.keys())
    body = tags.get("body") or tags.get("html") or root
    parents = {id(n): p for n, p, _ in order}
    for n, p, _ in order:
        n.density = _density(n, body)
        if p is not None:
            p.total += n.density
    inside = {id(body)}
    best = body
    for n, p, _ in order:
        if p is not None and id(p) in inside:
            inside.add(id(n))
            if page and n.total > best.total:
                best = n
    least, at = best.density, best
    while at is not None and at is not body:
        least = min(least, at.density)
        at = parents[id(at)]
    return (best if page else root), min(least, body.density), page


class Holder:
    """Keeps code and formulas out of the way of later steps."""

    def __init__(self) -> None:
        self.kept: list[str] = []

    def hold(self, text: str) -> str:
        self.kept.append(text)
        return f"\ue000{len(self.kept) - 1}\ue001"

    def release(self, text: str) -> str:
        while _HOLD.search(text):  # what is kept holds only what was kept before it
            text = _HOLD.sub(lambda m: self.kept[int(m.group(1))] if int(m.group(1)) < len(self.kept) else "", text)
        return text

    def code(self, body: str, name: str = "") -> str:
        return "\n\n" + self.hold(f"```{name}\n{body.strip(chr(10)).rstrip()}\n```") + "\n\n"

    def formula(self, body: str, block: bool) -> str:
        return self.hold(f"$${body.strip()}$$" if block else f"${body.strip()}$")


def _unescape(t: str) -> str:
    return html.unescape(html.unescape(t)) if "&" in t else t


_KEPT = frozenset("li h1 h2 h3 h4 h5 h6 pre br hr".split())
_SPACED = frozenset("p blockquote ul ol dl table div section article".split())


def _is_dropped(c: Node, least: float, page: bool) -> bool:
    if c.tag in DROPPED or c.tag in ("ref", "references"):
        return True
    if c.tag not in BLOCK or c.tag in _KEPT or not c.chars or c.density >= least:
        return False
    return page or c.tag in FURNITURE or 2 * c.link_chars > c.chars


def render(node: Node, keep: Holder, least: float = -math.inf, page: bool = False) -> str:
    """The text of a subtree with its structure, without blocks of too low a density. Headings, items and cells are put
    together when they end; everything else goes to the piece it stands in."""
    top: list[str] = []
    # node, next child, where its text goes, items so far
    frames: list[list] = [[node, 0, top, 0]]
    while frames:
        frame = frames[-1]
        node, at, out, _ = frame
        if at == len(node.children):
            frames.pop()
            if frames:
                _close(node, out, frames[-1])
            continue
        frame[1] += 1
        c = node.children[at]
        if isinstance(c, str):
            out.append(c)
            continue
        tag = c.tag
        if _is_dropped(c, least, page):
            continue
        if tag in ("pre", "syntaxhighlight", "source") and c.children:
            out.append(keep.code(_unescape(_flat(c))))
        elif tag in ("code", "kbd", "samp", "tt"):
            body = _unescape(_flat(c))
            out.append(keep.code(body) if "\n" in body.strip() else keep.hold(f"`{body.strip()}`"))
        elif tag == "math":
            out.append(keep.formula(_unescape(_flat(c)), False))
        elif tag == "br":
            out.append("\n")
        elif tag == "hr":
            out.append("\n\n")
        elif tag == "img":
            alt = re.search(r"\balt\s*=\s*[\"']([^\"']*)", c.kind)
            out.append(alt.group(1) if alt else "")
        elif tag in _OWN_PIECE:
            frames.append([c, 0, [], 0])
        else:
            out.append("\n\n" if tag in _SPACED else "\n" if tag in BLOCK else "")
            frames.append([c, 0, out, 0])
    return "".join(top)


_OWN_PIECE = frozenset("h1 h2 h3 h4 h5 h6 li td th".split())


def _close(c: Node, out: list[str], parent: list) -> None:
    if c.tag not in _OWN_PIECE:
        out.append("\n\n" if c.tag in _SPACED else "\n" if c.tag in BLOCK else "")
        return
    inner = "".join(out)
    if c.tag == "li":
        parent[3] += 1
        parent[2].append(f"\n{f'{parent[3]}.' if parent[0].tag == 'ol' else '-'} {inner.strip()}\n")
    elif c.tag in ("td", "th"):
        parent[2].append(f"{inner.strip()}\t")
    else:
        parent[2].append(f"\n\n{'#' * int(c.tag[1])} {' '.join(inner.split())}\n\n")


def _until_none(pattern: re.Pattern, to, text: str) -> str:
    """Replaces the innermost matches until there are none, however deep they are nested."""
    n = 1
    while n:
        text, n = pattern.subn(to, text)
    return text


def _flat(node: Node) -> str:
    parts, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            parts.append(n)
        elif n.tag == "br":
            parts.append("\n")
        else:
            todo.extend(reversed(n.children))
    return "".join(parts)


def _template(m: re.Match) -> str:
    parts = [p.strip() for p in m.group(1).split("|")]
    name = parts[0].lower()
    values = [re.sub(r"^[\w ]{1,20}=\s*", "", p) for p in parts[1:] if p and not re.match(r"^[A-Za-z_]+\s*=", p)]
    if re.search(r"citation|cite|fact|cn\b|clarify|who\b|when\b|dubious|verify|reflist|sfn|efn|short description|use \w+ dates|infobox", name):
        return ""
    if "date" in name:
        numbers = [v for v in values if v.isdigit()]
        return "-".join([numbers[0], *(n.zfill(2) for n in numbers[1:3])]) if numbers else " ".join(values)
    if "list" in name or name in ("ubl", "hlist", "bulleted list"):
        items = [i.strip(" *\n") for v in values for i in re.split(r"(?:^|\s)\*\s+|\n\*\s*", v)]
        return "\n" + "\n".join(f"- {i}" for i in items if i) + "\n"
    if name in ("ill", "lang", "transl"):
        return values[-1] if name != "ill" and values else values[0] if values else ""
    return " ".join(values)


def _wiki(t: str) -> str:
    t = _MAGIC.sub("", t)
    t = _W_TABLE.sub(lambda m: "\n".join(" \t".join(c.strip() for c in re.split(r"\|\||!!", line.lstrip("|! "))) for line in m.group(0).split("\n")[1:-1] if not line.startswith("|-")), t)
    t = _until_none(_TEMPLATE, _template, t)
    t = t.replace("{{", "").replace("}}", "")

    def link(m: re.Match) -> str:
        target = m.group(1).strip()
        if re.match(r"(?:category|file|image|media)\s*:", target, re.I):
            return ""
        return (m.group(2).split("|")[-1] if m.group(2) is not None else target).strip()

    t = _until_none(_W_LINK, link, t)
    t = _W_EXT.sub(lambda m: m.group(1) or "", t)
    t = _W_HEAD.sub(lambda m: f"\n{'#' * len(m.group(1))} {m.group(2)}\n", t)
    t = _W_QUOTE.sub("", t)
    return re.sub(r"^(\*+)[ \t]*(?=\S)", "- ", t, flags=re.M)


def _markdown(t: str, keep: Holder) -> str:
    t = _CODE.sub(lambda m: keep.hold(f"`{m.group(1)}`"), t)
    t = _MD_LINK.sub(lambda m: m.group(2), t)
    t = _SETEXT.sub(lambda m: f"{'#' if m.group(2)[0] == '=' else '##'} {m.group(1)}", t)
    t = _MD_HEAD.sub(lambda m: f"{m.group(1)} {m.group(2)}", t)
    t = _until_none(_BOLD, lambda m: m.group(2) or m.group(3), t)
    t = _ITALIC.sub(lambda m: m.group(1) or m.group(2), t)
    t = _STRIKE.sub(r"\1", t)
    t = _MD_TABLE.sub("", t)
    return re.sub(r"^([ \t]*)[*+][ \t]+(?=\S)", r"\1- ", t, flags=re.M)


def _latex(t: str, keep: Holder) -> str:
    t = re.sub(r"(?<!\\)%[^\n]*$", "", t, flags=re.M) if "\\documentclass" in t else t
    t = _TEX_HEAD.sub(lambda m: f"\n\n{'#' * {'chapter': 1, 'section': 1, 'subsection': 2, 'subsubsection': 3}.get(m.group(1), 4)} {m.group(2)}\n\n", t)
    number = [0]

    def item(m: re.Match) -> str:
        if m.group(0).startswith("\\begin"):
            number[0] = 1 if "enumerate" in m.group(0) else 0
            return "\n"
        if m.group(0).startswith("\\end"):
            return "\n"
        if number[0]:
            number[0] += 1
            return f"\n{number[0] - 1}. "
        return "\n- "

    t = re.sub(r"\\(?:begin|end)\{(?:itemize|enumerate|description)\}|\s*\\item\b(?:\[[^\]]*\])?\s*", item, t)
    t = _until_none(_TEX_ARG, r"\1", t)
    t = re.sub(r"\\(?:href)\{[^{}]*\}\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"\\(?:cite\w*|label|ref|footnote|vspace\*?|hspace\*?|usepackage|documentclass|bibliography\w*)(?:\[[^\]]*\])?\{[^{}]*\}", "", t)
    t = re.sub(r"\\(?:begin|end)\{[^{}]*\}", "\n", t)
    t = re.sub(r"\\\\(?:\[[^\]]*\])?", "\n", t)
    t = re.sub(r"\\([&%#_{}$])", r"\1", t)
    return re.sub(r"\\[A-Za-z]{2,}\*?(?:\{([^{}]*)\})?", lambda m: m.group(1) or "", t)


def to_text(text: str | None) -> tuple[str | None, list[str]]:
    """(clean text, kinds of markup found). NULL gives (None, []); text without markup comes back as it is."""
    if text is None:
        return None, []
    kinds = kinds_of(text)
    if not kinds:
        return text, kinds
    keep = Holder()
    t = text.replace("\ue000", "").replace("\ue001", "").replace("\r\n", "\n")
    if "```" in t or "~~~" in t:
        t = _FENCE.sub(lambda m: keep.code(m.group(3), m.group(2)), t)
        t = _FENCE_INLINE.sub(lambda m: keep.code(m.group(1)), t)
    if "latex" in kinds or "\\" in t:
        t = _TEX_VERB.sub(lambda m: keep.code(m.group(2)), t)
        t = _TEX_ENV.sub(lambda m: "\n" + keep.formula(m.group(3), True) + "\n", t)
        t = re.sub(r"\\\[(.+?)\\\]", lambda m: keep.formula(_unescape(m.group(1)), True), t, flags=re.S)
        t = re.sub(r"\\\((.+?)\\\)", lambda m: keep.formula(_unescape(m.group(1)), False), t, flags=re.S)
        t = _MATH.sub(lambda m: keep.formula(_unescape(m.group(1) or m.group(2)), m.group(1) is not None), t)
    if "html" in kinds:
        root = parse_html(t)
        if not root.marks:  # tags within code only
            kinds = [k for k in kinds if k != "html"] or ["markdown"]
        node, least, page = main_content(root)
        t = render(node, keep, least, page)
    if "wiki" in kinds:
        t = _wiki(t)
    if "latex" in kinds:
        t = _latex(t, keep)
    if "markdown" in kinds or "wiki" not in kinds:
        t = _markdown(t, keep)
    t = keep.release(_unescape(t)).replace("\u00a0", " ")
    t = re.sub(r"[ \t]+$", "", t, flags=re.M)
    return re.sub(r"\n{3,}", "\n\n", t).strip(), kinds


CLEANED = T.StructType([T.StructField("clean", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])


@F.pandas_udf(CLEANED)
def _convert(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([to_text(v) for v in values], columns=["clean", "kinds"])


def may_hold_markup(value: Column) -> Column:
    """False only for values that hold none of the characters any markup needs: those stay in the JVM."""
    signs = ("<", "&", "**", "# ", "$", "\\", "[[", "](", "{{", "''", "==", "`", "~~", "---", "[http", "__", "{|")
    out = F.lit(False)
    for s in signs:
        out = out | value.contains(s)
    # a single * or _ counts where it opens or closes a word
    return out | value.rlike(r"(?:^|[\s(\"'])[*_][^\s*_]|[^\s*_][*_](?:[\s.,;:!?)\"']|$)")


def convert(values: DataFrame) -> DataFrame:
    """values (.., value) with `clean` and `kinds` (in the place of columns of those names). NULL stays NULL; repeated rows
    stay; very long texts are read whole."""
    values = values.drop("clean", "kinds")
    hit = F.coalesce(may_hold_markup(F.col("value")), F.lit(False))
    marked = values.where(hit).withColumn("c", _convert("value")).select(*[f"`{c}`" for c in values.columns], "c.clean", "c.kinds")
    plain = values.where(~hit).withColumns({"clean": F.col("value"), "kinds": F.array().cast("array<string>")})
    return marked.unionByName(plain)
