"""Problem 4: text from scanned pages, read and repaired into continuous paragraphs.

Page numbers and running headers are told by form and repetition. Every other line is decoded by the noisy channel of
``channel``; the path of a line says both which cases it holds and how it is printed. Words divided at line ends are
joined if the corpus knows the joined word better than the compound.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .channel import MARKS, SUSPENDED, Model, clean, corrected, learn, misread_at
from .common import slices

__all__ = ["Model", "learn", "read_text", "repaired", "repaired_markdown", "repaired_texts", "scan_cases"]

_DIVIDED = re.compile(r"([^\W\d_]+)([-‐‑¬\xad])\s*$")
_FIRST_WORD = re.compile(r"^[\s>]*([^\W\d_]+)(-[^\W\d_]+)?")
_NUMBER = r"(?:[\dlOIo]{1,4}|[ivxlc]{1,7})"
_PAGE_NO = re.compile(rf"^(?:{_NUMBER}|[-–—] ?{_NUMBER} ?[-–—]|\[{_NUMBER}\]|\({_NUMBER}\)|(?:page|seite|página|p\.) {_NUMBER}(?: (?:of|von|de|sur) {_NUMBER})?|[IVXl]{{1,6}}-[\dlO]{{1,4}})$", re.I)
_ONLY_NUMBER = re.compile(rf"{_NUMBER}$")
_DOCKET = re.compile(r"^[A-Z]{3,}(?: [A-Z]{2,})* [\dlO]{2,4}/[A-Z]{3,}$")
_EDGE = set("0123456789lOIoivxcIVX])-–—")
_NOTE = re.compile(r"\s*(?:\d{1,4}\s+\S*[^\W\d_]|\[\^\d+\]:)")
_FRONT = re.compile(r"\A---\r?\n.*?\n---[ \t]*(?:\r?\n|\Z)", re.S)
_TITLE = re.compile(r'^title: "?(.*?)"?\s*$', re.M)
_OPEN_END = re.compile(r"[\w,]\s*$")
_LETTERS = re.compile(r"[\W\d_]+")


def title_of(markdown: str | None) -> str:
    """The title in the front matter, however long that is; empty if there is none."""
    front = _FRONT.match(markdown) if markdown else None
    m = _TITLE.search(front[0]) if front else None
    return m[1] if m else ""


# ---- layout ----------------------------------------------------------------------------------------------------------


def _near(a: str, b: str) -> bool:
    return a == b or (len(a) == len(b) and len(a) > 8 and sum(x != y for x, y in zip(a, b)) <= 2)


def _numbered(s: str) -> str | None:
    """What stands beside a page number and a gap of two spaces or more, before or after it."""
    first, last = s.split(None, 1), s.rsplit(None, 1)
    if len(first) < 2:
        return None
    if _ONLY_NUMBER.match(first[0]) and len(s) - len(first[0]) - len(first[1]) > 1:
        return first[1]
    if _ONLY_NUMBER.match(last[1]) and len(s) - len(last[0].rstrip()) - len(last[1]) > 1:
        return last[0].rstrip()
    return None


def _like_title(s: str) -> bool:
    return s.isupper() or sum(w[:1].isupper() for w in s.split()) >= 3


def _in_title_case(s: str) -> bool:
    """Do all words of more than three letters begin with a capital, three at least?"""
    words = s.split()
    return s[0].isupper() and s[-1].isalpha() and len(words) > 2 and all(w[0].isupper() for w in words if len(w) > 3) and sum(w[0].isupper() for w in words) > 2


def furniture_lines(lines: list[str], title: str, *, markdown: bool) -> set[int]:
    """Numbers of the lines that are running headers, running footers or page numbers.

    A header repeats the title, or else comes with a page number or at least three times; where no title is known, a line
    in title case may be one too.
    """
    out: set[int] = set()
    keys: list[tuple[int, str, str, bool]] = []
    want = _LETTERS.sub("", title).lower()
    for i, line in enumerate(lines):
        s = line.strip()
        if not s or (markdown and s[0] in "#>%"):
            continue
        edge = s[-1] in _EDGE or s[0] in _EDGE
        if edge and _PAGE_NO.match(s):
            out.add(i)
            continue
        body = _numbered(s) if edge and "  " in s else None
        numbered, upper = body is not None, s.isupper()
        if not upper and not numbered and not (abs(len(s) - len(title)) <= 6 if want else _in_title_case(s)):
            continue
        body = body or s
        if "/" in body and _DOCKET.match(body):
            out.add(i)
            continue
        key = _LETTERS.sub("", body).lower()
        if want and len(key) > 8 and _near(key, want):
            out.add(i)
        elif len(key) > 8 and (numbered or upper or not want) and not re.search(r"[.·]{4,}", body):
            keys.append((i, key, body, numbered))
    many = Counter(k for _, k, _, _ in keys)
    with_number = {k for _, k, _, numbered in keys if numbered}
    by_size: dict[int, list[str]] = {}
    for k in many:
        by_size.setdefault(len(k), []).append(k)
    for i, key, body, _ in keys:
        if (key in with_number or many[key] > 2) and _like_title(body) and not re.match(r"^(?:[A-Z]|[IVXLC]+|\d+)\. ", body):
            if many[key] > 1 or any(_near(key, k) for k in by_size[len(key)] if k != key):
                out.add(i)
    return out


@dataclass
class Reading:
    """What is found in a text: (line, kind) cases."""

    cases: list[tuple[int, str]]
    printed: dict[int, str]  # the lines that change, as decoded
    furniture: set[int]
    divided: dict[int, int]  # line of the first part -> line of the second
    compounds: dict[int, int]  # the same for words that keep their mark
    second: set[int]  # lines that begin with the second part of a word, joined or not


def _body_lines(lines: list[str], furniture: set[int]) -> list[int]:
    """Numbers of the lines that are neither furniture nor, from a foot note to the next gap, notes."""
    out, notes = [], False
    for i, line in enumerate(lines):
        if i in furniture or not line.strip() or line.startswith("%%"):
            notes = False
        elif _NOTE.match(line):
            notes = True
        elif not notes:
            out.append(i)
    return out


def _second_part(model: Model, shown: list[str], i: int, part: str, furniture: set[int], body: list[int]) -> tuple[int, re.Match] | None:
    """(line, first word) of the second part of the word that line i ends in.

    It stands in the next line of the body, over furniture and notes. Since a line that begins with a number may be taken
    for a note or a note's end for a line of the body, a line that makes a known word is taken wherever it comes first: from
    the next line on up to the first line of the body that begins in the same case.
    """
    at = bisect_right(body, i)
    last = i
    for k in range(at, len(body)):
        last = body[k]
        h = _FIRST_WORD.match(shown[last])
        if h and h[1][0].islower() == part[-1].islower():
            break
    after = body[at] if at < len(body) else -1
    near = next((j for j in range(i + 1, len(shown)) if shown[j].strip() and j not in furniture and not shown[j].startswith("%%")), -1)
    stop = last if last > i else near
    first = None
    for j in range(near, stop + 1) if near >= 0 else ():
        if j in furniture or not shown[j].strip() or shown[j].startswith("%%") or not (h := _FIRST_WORD.match(shown[j])):
            continue
        if model.count((part + h[1]).lower()) or model.count(f"{part}-{h[1]}".lower()):
            return j, h
        if first is None and (after < 0 or (j >= after and (q := bisect_right(body, j)) and body[q - 1] == j)):
            first = (j, h)
    return first


def read_text(model: Model, text: str, title: str, *, markdown: bool) -> Reading:
    lines = text.split("\n")
    skip = 0
    if markdown and (front := _FRONT.match(text)):
        skip = front[0].count("\n")
    shown = [""] * skip + lines[skip:]
    furniture = furniture_lines(shown, title, markdown=markdown)
    cases = [(i, "furniture") for i in furniture]
    printed: dict[int, str] = {}
    divided: dict[int, int] = {}
    compounds: dict[int, int] = {}
    second: set[int] = set()
    body: list[int] | None = None
    for i, line in enumerate(shown):
        if i in furniture or not line.strip() or (markdown and line.startswith("%%")):
            continue
        m = _DIVIDED.search(line) if line.rstrip()[-1] in MARKS else None
        found = False
        if m:
            if body is None:
                body = _body_lines(shown, furniture)
            if best := _second_part(model, shown, i, m[1], furniture, body):
                second.add(best[0])
                if model.joins(m[1], best[1][1], best[1][2] or "", m[2]):
                    found, divided[i] = True, best[0]
                else:
                    compounds[i] = best[0]
        fixed, kinds = corrected(model, line, kept_first=i in second, kept_last=m is not None)
        if fixed != line:
            printed[i] = fixed
        cases += [(i, k) for k in kinds | ({"break"} if found else set())]
    return Reading(cases, printed, furniture, divided, compounds, second)


def misread_match(model: Model, match: str, context: str) -> bool:
    """Is the match of a review row a misreading, as its context shows?"""
    if not match or not match.strip():
        return False
    parts = match.split()
    if len(parts) > 1:
        return "misread" in corrected(model, match)[1]
    context = context or match
    at = min((m.start() for m in re.finditer(re.escape(match), context)), key=lambda i: abs(i - 40), default=-1)
    if at < 0:
        return misread_at(model, parts, 0)
    left = context[:at].split(" ")
    head, tail = left[-1], re.match(r"\S*", context[at + len(match) :])[0]
    tokens = [*[x for x in left[:-1] if x], head + match + tail, *context[at + len(match) + len(tail) :].split()]
    k = len([x for x in left[:-1] if x])
    if clean(head + match + tail) != match and clean(match):  # the match is a part of the word in the context
        whole = clean(head + match + tail)
        if "-" in whole or not whole:
            tokens[k] = match
    return misread_at(model, tokens, k)


def repair_line(model: Model, line: str, *, kept_first: bool = False) -> str:
    """A line as the channel decodes it, and decoded again as long as that changes it: what was joined may be misread too."""
    seen = set()
    while line not in seen:
        seen.add(line)
        line, _ = corrected(model, line, kept_first=kept_first, kept_last=line.rstrip()[-1:] in MARKED)
    return line


MARKED = frozenset(MARKS)


def _rejoined(model: Model, lines: list[str], found: Reading) -> tuple[list[str], dict[int, int]]:
    """The lines with the second part of each divided word moved up to the first, and which line each of them goes on in."""
    lines, goes_on = list(lines), {}
    joined = found.divided | {i: j for i, j in found.compounds.items() if _is_compound(model, lines, found, i, j)}
    claims: dict[int, tuple[bool, int]] = {}
    for i, j in joined.items():  # one word is the second part of one only: of a known word, or else of the nearest
        word = _DIVIDED.search(lines[i])[1] + _FIRST_WORD.match(lines[j])[1]
        claims[j] = max(claims.get(j, (False, -1)), (model.count(word.lower()) > 0, i))
    for i, j in sorted(((i, j) for j, (_, i) in claims.items()), reverse=True):
        m = _FIRST_WORD.match(lines[j])
        word = re.match(r"\S+", lines[j][m.start(1) :])[0]
        lines[j] = lines[j][: m.start(1)] + lines[j][m.start(1) + len(word) :].lstrip()
        lines[i] = lines[i].rstrip()[:-1] + ("" if i in found.divided else "-") + word
        goes_on[i] = j
    return lines, goes_on


def _is_compound(model: Model, lines: list[str], found: Reading, i: int, j: int) -> bool:
    """Do parts that aren't joined without the mark stand in one compound, rather than before a list's last item?"""
    h = _FIRST_WORD.match(lines[j])[1]
    near = all(k in found.furniture for k in range(i + 1, j))
    return h not in SUSPENDED and (model.count(f"{_DIVIDED.search(lines[i])[1]}-{h}".lower()) > 0 or (near and h[0].islower()))


def repaired(model: Model, text: str, title: str) -> str:
    """Continuous paragraphs: furniture dropped, divided words joined, misread words replaced.

    Foot notes between the parts of a word follow the paragraph that it stands in.
    """
    whole = text.split("\n")
    found = read_text(model, text, title, markdown=False)
    lines, goes_on = _rejoined(model, whole, found)
    moved = set(goes_on.values())
    to_do = found.printed.keys() | goes_on.keys()

    def gather(i: int, end: int) -> list[list[str]]:
        paragraphs: list[list[str]] = [[]]
        aside: list[list[str]] = []
        while i < end:
            if i in found.furniture:
                i += 1
                continue
            if not whole[i].strip():
                if paragraphs[-1] and not any(j in found.furniture for j in (i - 1, i + 1)):
                    paragraphs += [*aside, []]
                    aside = []
                i += 1
                continue
            fixed = repair_line(model, lines[i], kept_first=i in found.second and i not in moved) if i in to_do else lines[i]
            paragraphs[-1] += fixed.split()
            j = goes_on.get(i, end)
            if j < end:
                aside += gather(i + 1, j)
            i = j if j < end else i + 1
        return [*paragraphs, *aside]

    return "\n\n".join(" ".join(p) for p in gather(0, len(lines)) if p)


def _run_on(lines: list[str], found: Reading) -> dict[int, int]:
    """Lines of Markdown whose sentence goes on after page furniture, and the line it goes on in."""
    out: dict[int, int] = {}
    last, parted = -1, False
    for i, line in enumerate(lines):
        if i in found.furniture:
            parted = True
        elif line.strip():
            if parted and last >= 0 and _OPEN_END.search(lines[last]) and lines[last][0] not in "#%|[" and (h := _FIRST_WORD.match(line)) and h[1][0].islower():
                out[last] = i
            last, parted = i, False
    return out


def repaired_markdown(model: Model, text: str, title: str) -> str:
    """The same repair of Markdown; front matter, page marks and the forms of lines stay.

    A paragraph that page furniture or a divided word parts goes on in its first line; what stands between follows it.
    """
    whole = text.split("\n")
    front = _FRONT.match(text)
    skip = front[0].count("\n") if front else 0
    found = read_text(model, text, title, markdown=True)
    lines, goes_on = _rejoined(model, whole, found)
    for i, j in _run_on([""] * skip + whole[skip:], found).items():
        if i not in goes_on and j not in goes_on.values():
            goes_on[i] = j
    for i in sorted(goes_on, reverse=True):
        if rest := lines[goes_on[i]].lstrip(" \t>"):
            lines[i] = f"{lines[i].rstrip()} {rest}"
    moved = set(goes_on.values())
    to_do = found.printed.keys() | goes_on.keys()

    def gather(i: int, end: int) -> list[int]:
        out: list[int] = []
        aside: list[int] = []
        while i < end:
            if aside and (not whole[i].strip() or whole[i][0] in "#%["):
                out, aside = out + aside, []
            out.append(i)
            j = goes_on.get(i, end)
            if j < end:
                aside += gather(i + 1, j)
            i = j if j < end else i + 1
        return out + aside

    out: list[str] = []
    cut = False
    for i in gather(0, len(lines)):
        if i in found.furniture or i in moved:
            cut = True
        elif i < skip or whole[i].startswith("%%"):
            out.append(whole[i])
        elif whole[i].strip():
            out.append(repair_line(model, lines[i], kept_first=i in found.second) if i in to_do else lines[i])
            cut = i in goes_on
        elif not cut or (out and out[-1].strip()):  # of the blank lines around what is taken out one stays
            out.append(whole[i])
    return "\n".join(out)


# ---- in Spark ---------------------------------------------------------------------------------------------------------


def scan_cases(runs: DataFrame, suspects: DataFrame, model: Model) -> DataFrame:
    """(field, row_id, line_no, kind) of runs (row_id, source_text, markdown) and suspects (row_id, match_text, context).

    Null and empty texts have no cases; a null match is none; a match without context is judged alone; repeated rows give
    repeated cases.
    """
    spark = runs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kind = runs.schema["row_id"].dataType.simpleString()
    schema = f"field string, row_id {kind}, line_no int, kind string"
    names = ["field", "row_id", "line_no", "kind"]

    def lines(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for pdf in slices(rows):
            out = []
            for row, source, markdown in zip(pdf.row_id, pdf.source_text, pdf.markdown):
                title = title_of(markdown)
                if source:
                    out += [("source_text", row, i, k) for i, k in read_text(m, source, title, markdown=False).cases]
                if markdown:
                    out += [("markdown", row, i, k) for i, k in read_text(m, markdown, title, markdown=True).cases]
            yield pd.DataFrame(out, columns=names)

    def matches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for pdf in slices(rows):
            yield pd.DataFrame([("suspect", r, 0, "misread") for r, x, c in zip(pdf.row_id, pdf.match_text, pdf.context) if misread_match(m, x, c or "")], columns=names)

    found = runs.select("row_id", "source_text", "markdown").mapInPandas(lines, schema)
    queue = suspects.filter(F.col("match_text").isNotNull()).select("row_id", "match_text", "context").mapInPandas(matches, schema)
    return found.unionByName(queue)


def repaired_texts(runs: DataFrame, model: Model) -> DataFrame:
    """(field, row_id, paragraphs): the repaired source text and markdown of runs (row_id, source_text, markdown); null
    stays null."""
    sent = runs.sparkSession.sparkContext.broadcast(model)
    kind = runs.schema["row_id"].dataType.simpleString()

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for pdf in slices(rows):
            out = []
            for row, source, markdown in zip(pdf.row_id, pdf.source_text, pdf.markdown):
                title = title_of(markdown)
                out.append(("markdown", row, None if markdown is None else repaired_markdown(m, markdown, title)))
                out.append(("source_text", row, None if source is None else repaired(m, source, title)))
            yield pd.DataFrame(out, columns=["field", "row_id", "paragraphs"])

    return runs.select("row_id", "source_text", "markdown").mapInPandas(run, f"field string, row_id {kind}, paragraphs string")
