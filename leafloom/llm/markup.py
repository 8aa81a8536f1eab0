"""Problem 1: markup residue of HTML, Markdown, MediaWiki and LaTeX, turned into clean text that keeps its structure.

HTML is read by the standard library's streaming parser; Markdown, MediaWiki and LaTeX by scanners that give events as it
does, one for each sign, in the order of the text. The events say which languages a text holds; a damaged construct (no end
tag, no closing sign) counts as well. For the clean text, code and formulas are set aside first. Each line gets its ratio of
text to events of all languages, the ratios are smoothed with a Gaussian, and lines below the threshold of the low cluster
are dropped unless they carry structure (headings, lists, tables, code, formulas). Then writers follow the events with a
stack, so templates, links and macros may be nested to any depth.
"""

from __future__ import annotations

import bisect
import html
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

FAMILIES = ["html", "markdown", "wiki", "latex"]
# Element names of HTML.
TAGS = set(
    "a abbr address article aside audio b base big blockquote body br button canvas caption center cite code col colgroup dd del details dfn div dl dt em "
    "embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link "
    "main map mark meta nav noscript object ol optgroup option p param picture pre q s samp script section select small source span strike strong style sub "
    "summary sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var video".split()
)
WIKI_TAGS = {"ref", "references", "nowiki", "gallery", "noinclude", "includeonly"}
# LaTeX commands that may stand without an argument in braces.
COMMANDS = "item hline maketitle newline newpage noindent par centering tableofcontents alpha beta gamma delta lambda mu pi sigma theta omega leq geq neq times cdot infty sum int approx pm ldots dots quad qquad LaTeX TeX"

_TAG = re.compile(r"<(?:!--|!doctype\b|(/?)([A-Za-z][A-Za-z0-9]*)(?=[\s/>]|$))", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_ANY_TAG = re.compile(r"<!--.*?(?:-->|$)|</?[A-Za-z][^<>\n]*(?:>|(?=\n|$|<))", re.S)
_FORMULA = r"\$(?![\d.,]+\s)(?=[^$\n]*(?:(?<![A-Za-z])\\[A-Za-z]{2,}|[A-Za-z0-9)][\^_][{A-Za-z0-9]))[^$\n]+\$"
_MATH = re.compile(r"\\\[.*?\\\]|\\\(.*?\\\)|\$\$.+?\$\$|" + _FORMULA, re.S)
_FRONT = re.compile(r"\A---\r?\n.*?\n---\r?\n?", re.S)
_PROJECT = re.compile(r"(?m)^%%page \d+%%$|^#{2,3}[ \t]|^>[ \t]?|^- |\[\^\d+\]:?")



class Scanner:
    """Streams the events of a markup language: (start, end, sign) of every mark, paired or damaged."""

    def __init__(self, *rules: tuple[str, str]):
        self.signs = [sign for sign, _ in rules]
        self.rules = [(sign, re.compile(pattern, re.M)) for sign, pattern in rules]
        self.pattern = re.compile("|".join(f"(?P<r{k}>{_unnamed(pattern)})" for k, (_, pattern) in enumerate(rules)), re.M)

    def events(self, text: str) -> Iterator[tuple[int, int, str]]:
        if any(sign in text for sign in self.signs):
            for m in self.pattern.finditer(text):
                yield m.start(), m.end(), self.signs[int(m.lastgroup[1:])]

    def found(self, text: str) -> bool:
        """Is there any event? Only the rules whose sign is in the text are tried."""
        return any(sign in text and rule.search(text) for sign, rule in self.rules)

    def __add__(self, other: Scanner) -> Scanner:
        return Scanner(*((sign, rule.pattern) for sign, rule in self.rules + other.rules))


def _unnamed(pattern: str) -> str:
    """The pattern with its only group, the equals signs of a heading, named, so that it can stand beside others."""
    return pattern.replace("(={2,6})", "(?P<eq>={2,6})").replace(r"\1", "(?P=eq)")


WIKI = Scanner(
    ("''", r"''+(?=[^\s'])|\S''"),
    ("[[", r"\[\[(?=\S)"),
    ("]]", r"\S\]\]"),
    ("{{", r"\{\{(?=[\w#:])"),
    ("{|", r"\{\|"),
    ("|}", r"^\|\}"),
    ("|-", r"^\|-\s*$"),
    ("==", r"^(={2,6})[^=\n]+?\1[ \t]*$"),
    ("#R", r"^#REDIRECT\b"),
    ("__", r"__(?:NO)?TOC__"),
)
LATEX = Scanner(
    ("\\", r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{|(?<![A-Za-z])\\(?:" + COMMANDS.replace(" ", "|") + r"|begin|end)\b|\\[\[\]()]"),
    ("$$", r"\$\$\S"),
    ("$", _FORMULA),
)
MARKDOWN = Scanner(
    ("`", r"^```|```|`[^`\s]|[^`\s]`"),
    ("~~", r"^~~~|~~\S"),
    ("*", r"(?<![\w*])\*{1,3}[^\s*]|[^\s*]\*{1,3}(?![\w*])|^[ \t]*\*[ \t]+\S"),
    ("_", r"(?<![\w\\$}])_{1,3}[^\W_]|[^\W_]_{1,3}(?![\w{])"),
    ("![", r"!\["),
    ("](", r"\]\((?=\S)"),
    ("]:", r"^\[[^\]\n]+\]:[ \t]+\S+://"),
    ("[", r"^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]"),
    ("+ ", r"^[ \t]*\+[ \t]+\S"),
    ("#", r"^#{4,6}[ \t]+\S|[ \t]#{2,6}[ \t]*$"),
    ("---", r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*\|"),
    ("===", r"^[ \t]*={3,}[ \t]*$"),
)
MARKDOWN_BLOCK = MARKDOWN + Scanner(("# ", r"^#{1,3}[ \t]+(?!\d)\S"), ("- ", r"^[ \t]*-[ \t]+\S[^\n]*\n[ \t]*-[ \t]+\S"), ("> ", r"^>[ \t]+\S"))
MARKDOWN_RUN = MARKDOWN + Scanner(("# ", r"^#[ \t]+(?!\d)\S"))


class _Events(HTMLParser):
    """Streaming parser events; says whether anything of HTML is there."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.found = False

    def handle_starttag(self, tag, attrs):
        self.found |= tag in TAGS

    def handle_endtag(self, tag):
        self.found |= tag in TAGS

    def handle_comment(self, data):
        self.found = True

    def handle_decl(self, decl):
        self.found |= decl[:7].lower() == "doctype"

    def handle_entityref(self, name):
        self.found |= name + ";" in html.entities.html5

    def handle_charref(self, name):
        self.found = True


def has_html(text: str) -> bool:
    opened = list(_TAG.finditer(text)) if "<" in text else []
    if not opened and not ("&" in text and _ENTITY.search(text)):
        return False
    events = _Events()
    try:
        events.feed(text)
        events.close()
    except AssertionError:  # the parser gives up on some broken declarations
        pass
    return events.found or any(m[2] is None or m[2].lower() in TAGS for m in opened)


def families(text: str, run: bool) -> list[str]:
    """Languages of which the text holds a construct; run: the project's own Markdown forms are none."""
    out = []
    if run:
        text = _PROJECT.sub(" ", _FRONT.sub("", text))
    if has_html(text):
        out.append("html")
        tags = {m[2].lower() for m in _TAG.finditer(text) if m[2]}
        if tags & WIKI_TAGS:
            out.append("wiki")
        text = _ANY_TAG.sub(" ", text)
    if LATEX.found(text):
        out.append("latex")
    if "$" in text or "\\" in text:
        text = _MATH.sub(" ", text)
    if "wiki" not in out and WIKI.found(text):
        out.append("wiki")
    if (MARKDOWN_RUN if run else MARKDOWN_BLOCK).found(text):
        out.append("markdown")
    return out


# ---- clean text ------------------------------------------------------------------------------------------------------


class _Writer(HTMLParser):
    """Rewrites HTML as plain text with headings, lists, tables, code and formulas kept."""

    BREAKS = {"p", "div", "section", "article", "blockquote", "table", "ul", "ol", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "dl", "figure"}
    SKIPPED = {"script", "style", "template", "noscript", "head", "svg"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.lists: list[list] = []
        self.cells = 0
        self.code = False

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self.skip += 1
        elif tag in self.BREAKS:
            self.out.append("\n\n")
            if tag[0] == "h" and tag[1:].isdigit():
                self.out.append("#" * int(tag[1:]) + " ")
            if tag == "pre":
                self.code = True
                self.out.append("```\n")
            if tag in ("ul", "ol"):
                self.lists.append([tag, 0])
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("li", "dt", "dd"):
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag == "tr":
            self.cells = 0
            self.out.append("\n|")
        elif tag in ("td", "th"):
            self.cells += 1
            self.out.append(" ")
        elif tag not in TAGS:  # an angle bracket in prose
            self.out.append(self.get_starttag_text() or "")

    def handle_endtag(self, tag):
        if tag in self.SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "pre":
            self.out.append("\n```\n\n")
        elif tag in ("td", "th"):
            self.out.append(" |")
        elif tag in self.BREAKS:
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


_FENCED = re.compile(r"(?ms)^[ \t]*(```|~~~)[^\n]*\n.*?(?:^[ \t]*\1|\Z)")
_VERBATIM = re.compile(r"(?s)\\begin\{(verbatim|lstlisting)\*?\}(.*?)(?:\\end\{\1\*?\}|\Z)")
_EQUATION = re.compile(r"(?s)\\begin\{(equation|align|gather|multline|eqnarray|math|displaymath)(\*?)\}.*?\\end\{\1\2\}")
_HELD = re.compile("\x00(\\d+)\x00")


class Aside:
    """Code and formulas, set aside before anything is rewritten and put back at the end."""

    def __init__(self):
        self.parts: list[str] = []

    def hold(self, part: str) -> str:
        self.parts.append(part)
        return f"\x00{len(self.parts) - 1}\x00"

    def take(self, text: str) -> str:
        if "\x00" in text:
            text = _HELD.sub(" ", text)
        if "```" in text or "~~~" in text:
            text = _FENCED.sub(lambda m: self.hold(m[0]), text)
        if "\\" in text:
            text = _VERBATIM.sub(lambda m: self.hold("```\n" + m[2].strip("\n") + "\n```"), text)
            text = _EQUATION.sub(lambda m: self.hold(m[0]), text)
        if "$" in text or "\\" in text:
            text = _MATH.sub(lambda m: self.hold(m[0]), text)
        return text

    def take_code(self, text: str) -> str:
        return _FENCED.sub(lambda m: self.hold(m[0]), text)

    def put_back(self, text: str) -> str:
        while _HELD.search(text):  # what was set aside later may hold what was set aside before
            text = _HELD.sub(lambda m: self.parts[int(m[1])], text)
        return text


_WIKI_SIGN = re.compile(r"(?m)\{\{|\}\}|\[\[|\]\]|^(={2,6})[ \t]*([^=\s][^\n]*?)[ \t]*\1[ \t]*$|(?<!')'{2,5}(?!')(?=\S)|(?<=[^\s'])'{2,5}(?!')|^#REDIRECT[ \t]*|__(?:NO)?TOC__")
# The spaces of pages that are no text.
_MEDIA = re.compile(r"(?:File|Image|Category|Datei|Fichier|Archivo|Kategorie|Catégorie|Categoría):")


def _unwiki(text: str) -> str:
    """Templates go, links become their words, headings #, tables rows; what isn't closed loses only its sign."""
    stack: list[tuple[str, list[str]]] = [("", [])]
    last = 0

    def put(part: str) -> None:
        stack[-1][1].append(part)

    def close(sign: str) -> str | None:
        """What stands since the sign was opened; signs inside that weren't closed are given up."""
        if not any(s == sign for s, _ in stack):
            return None
        inside: list[str] = []
        while True:
            opened, parts = stack.pop()
            inside = parts + inside
            if opened == sign:
                return "".join(inside)

    for m in _WIKI_SIGN.finditer(text):
        put(text[last : m.start()])
        last = m.end()
        if m[0] in ("{{", "[["):
            stack.append((m[0], []))
        elif m[0] == "}}":
            close("{{")
        elif m[0] == "]]":
            inside = close("[[")
            if inside is not None and not _MEDIA.match(inside):
                put(inside.split("|", 1)[-1] if "\n" not in inside else inside)
        elif m[1]:
            put("#" * len(m[1]) + " " + m[2])
    put(text[last:])
    return _wiki_tables("".join(p for _, parts in stack for p in parts))


def _wiki_tables(text: str) -> str:
    if "|" not in text:
        return text
    out: list[str] = []
    depth, row = 0, []

    def end_row() -> None:
        if row:
            out.append("| " + " | ".join(row) + " |")
            row.clear()

    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith("{|"):
            end_row()
            depth += 1
        elif bare.startswith("|}") :
            end_row()
            depth = max(0, depth - 1)
        elif bare.startswith("|-"):
            end_row()
        elif depth and bare[:1] in ("|", "!") and bare:
            row += [c.strip() for c in re.split(r"\|\||!!", bare[1:])]
        elif depth and row and bare:
            row[-1] += " " + bare
        else:
            end_row()
            out.append(line)
    end_row()
    return "\n".join(out)


_TEX_SIGN = re.compile(
    r"\\(?P<end>begin|end)\{(?P<env>[^{}\n]*)\}(?:\[[^\]\n]*\])?(?:\{[lcrp|@{}.\d\\a-z]*\}(?=[ \t]*\n))?[ \t]*\n?|~?\\(?P<macro>[A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{|\\item\b[ \t]*(?:\[(?P<term>[^\]\n]*)\][ \t]*)?"
    r"|(?<![A-Za-z\\])\\(?P<bare>" + COMMANDS.replace(" ", "|") + r")\b[ \t]*|\\(?P<sign>[%&_#${}])|[{}]|\n[ \t]*\n|\n"
)
_HEADINGS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "title": 1}
_POINTERS = ("cite", "ref", "label", "pageref", "eqref", "index", "vspace", "hspace", "usepackage", "documentclass", "includegraphics", "bibliography", "bibliographystyle", "pagestyle", "setlength")
# Signs that commands stand for.
_SIGNS = {"ldots": "…", "dots": "…", "LaTeX": "LaTeX", "TeX": "TeX", "newline": "\n", "quad": " ", "qquad": " ", "times": "×", "pm": "±", "cdot": "·", "leq": "≤", "geq": "≥", "neq": "≠", "approx": "≈", "infty": "∞"}


def _unlatex(text: str) -> str:
    """Macros become their text, sections #, items -, tables rows; formulas and code were set aside before."""
    stack: list[tuple[str, list[str]]] = [("", [])]
    tables, last = 0, 0

    def put(part: str) -> None:
        stack[-1][1].append(part)

    def close() -> None:
        macro, parts = stack.pop()
        inside = "".join(parts)
        if macro in _HEADINGS:
            put("#" * _HEADINGS[macro] + " " + inside)
        elif macro == "footnote":
            put(f" ({inside})")
        elif not macro.startswith(_POINTERS):
            put(inside)

    for m in _TEX_SIGN.finditer(text):
        put(text[last : m.start()])
        last = m.end()
        sign = m[0]
        if m["end"]:
            if m["env"].rstrip("*") in ("tabular", "tabularx", "longtable", "array"):
                tables += 1 if m["end"] == "begin" else -1
                put("\x01" if m["end"] == "begin" else "\x02")
        elif m["macro"]:
            stack.append((m["macro"], []))
        elif sign.startswith("\\item"):
            put("- " + (f"{m['term']}: " if m["term"] else ""))
        elif m["bare"]:
            put(_SIGNS.get(m["bare"], m[0] if m["bare"][0].islower() and m["bare"] not in ("hline", "maketitle", "newpage", "noindent", "par", "centering", "tableofcontents") else ""))
        elif m["sign"]:
            put(m["sign"])
        elif sign == "{":
            stack.append(("{", [])) if len(stack) > 1 else put(sign)
        elif sign == "}":
            close() if len(stack) > 1 else put(sign)
        else:  # a heading that isn't closed ends with its line, everything else with its paragraph
            while len(stack) > 1 and (sign.count("\n") > 1 or stack[-1][0] in _HEADINGS):
                close()
            put(sign)
    put(text[last:])
    while len(stack) > 1:
        close()
    return _tex_tables("".join(stack[0][1]))


def _tex_tables(text: str) -> str:
    """Rows of the tables that stand between the two marks."""

    def rows(m: re.Match) -> str:
        cut = [[c.strip() for c in r.split("&")] for r in re.split(r"\\\\(?:\[[^\]\n]*\])?", m[1]) if r.strip()]
        return "".join("| " + " | ".join(r) + " |\n" for r in cut)

    return re.sub("\x01([^\x01\x02]*)\x02", rows, text).replace("\x01", "").replace("\x02", "") if "\x01" in text or "\x02" in text else text


_MD = [
    (re.compile(r"`([^`\n]+)`?"), r"\1"),
    (re.compile(r"!?\[([^\[\]\n]*)\]\([^()\n]*\)?"), r"\1"),
    (re.compile(r"(?m)^(#{1,6}[ \t]+.*?)[ \t]+#+[ \t]*$"), r"\1"),
    (re.compile(r"(?m)^([^\n]+)\n[ \t]*={3,}[ \t]*$"), r"# \1"),
    (re.compile(r"(?m)^([ \t]*)[*+-][ \t]+(?:\[[ xX]\][ \t]+)?"), r"\1- "),
    (re.compile(r"(?<![\w*])\*{1,3}(?=[^\s*])|(?<=[^\s*])\*{1,3}(?![\w*])|(?<![\w_])_{1,3}(?=[^\W_])|(?<=[^\W_])_{1,3}(?!\w)|~~"), ""),
    (re.compile(r"(?m)^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*\n?"), ""),
]


def _unmarkdown(text: str) -> str:
    for pattern, to in _MD:
        text = pattern.sub(to, text)
    return text


_STRUCTURE = re.compile(r"<(?:h[1-6]|li|t[dhr]|table|pre|code|ul|ol|blockquote)\b|^\s*(?:#|\||!|\{\||[-*+]\s|\d+\.\s|={2,6}[^=]|[=-]{3,}\s*$|>|```|\$|\\)|\x00", re.I)


def _marks(text: str, found: list[str], run: bool) -> list[tuple[int, int]]:
    """Places of the marks of the languages that a text holds."""
    out = [m.span() for m in _ANY_TAG.finditer(text)] if "html" in found else []
    scanners = {"wiki": WIKI, "latex": LATEX, "markdown": MARKDOWN_RUN if run else MARKDOWN_BLOCK}
    for family in found:
        if family in scanners:
            out += [(a, b) for a, b, _ in scanners[family].events(text)]
    return sorted(out)


def content_lines(text: str, marks: list[tuple[int, int]] | None = None, *, sigma: float = 1.0) -> list[bool]:
    """Which lines belong to the content, by smoothed text-to-tag ratio; a line without marks always does."""
    lines = text.split("\n")
    marks = [m.span() for m in _ANY_TAG.finditer(text)] if marks is None else marks
    starts = [0]
    for x in lines[:-1]:
        starts.append(starts[-1] + len(x) + 1)
    tags, marked = [0] * len(lines), [0] * len(lines)
    for a, b in marks:
        k = bisect.bisect_right(starts, a) - 1
        tags[k] += 1
        marked[k] += min(b, starts[k] + len(lines[k])) - a
    if not any(tags):
        return [True] * len(lines)
    ratio = [max(0, len(x.strip()) - out) / max(1, n) for x, n, out in zip(lines, tags, marked)]
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    smooth = []
    for i in range(len(lines)):
        near = [(kernel[k + reach], ratio[i + k]) for k in range(-reach, reach + 1) if 0 <= i + k < len(lines)]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    mean = sum(smooth) / len(smooth)
    threshold = math.sqrt(sum((s - mean) ** 2 for s in smooth) / len(smooth)) / 2
    low, high = min(smooth), max(smooth)  # two clusters on the line of ratios, split between their means
    for _ in range(10):
        a = [s for s in smooth if abs(s - low) <= abs(s - high)]
        b = [s for s in smooth if abs(s - low) > abs(s - high)]
        if not a or not b:
            break
        low, high = sum(a) / len(a), sum(b) / len(b)
    threshold = min(threshold, (low + high) / 2)
    return [not n or s >= threshold or r >= threshold or bool(_STRUCTURE.search(x)) for x, n, s, r in zip(lines, tags, smooth, ratio)]


def clean_text(text: str, run: bool, found: list[str] | None = None) -> str:
    """The text without markup; headings as #, list items as -, tables as | rows, code fenced, formulas as they are. A text
    without any markup stays as it is."""
    found = families(text, run) if found is None else found
    if not found:
        return text
    front = _FRONT.match(text) if run else None
    head, text = (front[0], text[front.end() :]) if front else ("", text)
    aside = Aside()
    text = aside.take(text)
    keep = content_lines(text, _marks(text, found, run))
    if not all(keep):
        text = "\n".join(x for x, k in zip(text.split("\n"), keep) if k)
    if "html" in found:
        text = re.sub(r"<[A-Za-z/][^<>\n]*(?=\n|$|<)", "", text)  # tags cut off before their end
        writer = _Writer()
        writer.feed(re.sub(r"<(?![A-Za-z/!])", "&lt;", text))
        writer.close()
        text = aside.take_code("".join(writer.out)) if writer.code else "".join(writer.out)
        text = re.sub(r"\n{3,}", "\n\n", text).strip("\n")
    if "wiki" in found:
        text = _unwiki(text)
    if "latex" in found:
        text = _unlatex(text)
    if "markdown" in found:
        text = _unmarkdown(text)
    return head + aside.put_back(text)


#: Signs without which no construct of any family can be there, those of every rule among them; a text without them never
#: leaves the JVM.
SIGNS = "|".join([r"<[A-Za-z/!]", r"&[#A-Za-z]", *sorted({re.escape(sign) for sign in WIKI.signs + LATEX.signs + MARKDOWN_BLOCK.signs + MARKDOWN_RUN.signs})])


def residue(df: DataFrame) -> DataFrame:
    """(tab, row_id, families) of the rows of df (tab, row_id, text) that hold markup.

    The project's own forms are left alone where tab is ``ingest_results``. Null, empty and blank texts hold none;
    repeated rows come out as often as they came in. Map-only.
    """
    kind = df.schema["row_id"].dataType.simpleString()

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(rows):
            out = [(tab, row, found) for tab, row, text in pdf.itertuples(index=False) if (found := families(text, tab == "ingest_results"))]
            yield pd.DataFrame(out, columns=["tab", "row_id", "families"])

    return df.select("tab", "row_id", "text").filter(F.col("text").rlike(SIGNS)).mapInPandas(run, f"tab string, row_id {kind}, families array<string>")


def cleaned(df: DataFrame) -> DataFrame:
    """(tab, row_id, families, clean) of every row of df (tab, row_id, text): the text without markup, and of which languages
    there was any. A text without markup comes out as it is, without leaving the JVM; null stays null. Map-only."""
    kind = df.schema["row_id"].dataType.simpleString()
    signed = F.coalesce(F.col("text").rlike(SIGNS), F.lit(False))

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(rows, rows=100):
            out = []
            for tab, row, text in pdf.itertuples(index=False):
                found = families(text, tab == "ingest_results")
                out.append((tab, row, found, clean_text(text, tab == "ingest_results", found)))
            yield pd.DataFrame(out, columns=["tab", "row_id", "families", "clean"])

    df = df.select("tab", "row_id", "text")
    plain = df.filter(~signed).select("tab", "row_id", F.array().cast("array<string>").alias("families"), F.col("text").alias("clean"))
    return plain.unionByName(df.filter(signed).mapInPandas(run, f"tab string, row_id {kind}, families array<string>, clean string"))
