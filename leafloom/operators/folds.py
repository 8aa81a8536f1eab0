"""The inherently sequential part: one document is one fold, run inside the row that holds its text.

The note counter runs through the pages of a document, open headings absorb the lines below them, and paragraphs join
across page marks, so a window can't express them. Each document is read whole where its row lies: nothing is shuffled,
and a document of a few hundred pages is the unit of work. The functions are plain Python, tested without Spark.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.headings import ABBREVIATIONS, DANGLING
from ..functions.text import REPAIRS

# The patterns and thresholds of the documents' own rules.
_INLINE = re.compile(r'\s{0,8}([0-9]{1,4})\s{0,3}(?=[A-Za-z"“(])')
_STACKED = re.compile(r"\s{0,10}([0-9]{1,4})\s*\Z")
_FURNITURE = re.compile(r"\s*([0-9]{1,4}|[ivxlcdm]{1,8})\s*\Z", re.I)
_LEADERS = re.compile(r"[.·]{4,}\s*([0-9]{1,4})\s*\Z")
_ONE_ENTRY = re.compile(r"(.*?)[.·]{4,}\s*([0-9]{1,4})\Z")
_OWN_NUMBER = re.compile(r"([IVXLC]{1,6}|[A-Z]|[0-9]{1,2})\.\s+(.+)\Z")
_DANGLING = re.compile(rf"(?<![A-Za-z0-9_])(?:{'|'.join(DANGLING)})\Z", re.I)
_SHORT = re.compile(rf"(?<![A-Za-z0-9_])(?:{ABBREVIATIONS})\.\Z", re.I)
_INITIAL = re.compile(r"(?<![A-Za-z0-9_])[A-Z]\.\Z")
_MARKER = re.compile(r"([.,;:!?\"')])\s+([0-9]{1,4})(?=\s|\Z)")
# Words before a number that make it a citation.
_CITING = re.compile(r"(?:(?<![A-Za-z0-9_])(?:nos?|nn?|pp?|art|ch|sec|para|vol|ex|fig|tbl|id|at|see)\.?|§)\s*\Z", re.I)
_PYTHON_REPAIRS = [(re.compile(p), re.sub(r"\$(\d)", r"\\\1", to)) for p, to in REPAIRS]
_PLAIN = str.maketrans("\xa0‘’“”", " ''\"\"")


def normalise(line: str) -> str:
    return re.sub(r"[ \t]+", " ", line.translate(_PLAIN)).strip()


def indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def margin(lines: list[str]) -> int:
    counts = Counter(indent(x) for x in lines if x.strip())
    return min(counts, key=lambda k: (-counts[k], k)) if counts else 0


def candidates(lines: list[str]) -> list[tuple[int, int]]:
    """(line, note) of the lines that may open a note."""
    out, below = [], ""
    for i in range(len(lines) - 1, -1, -1):  # from below, so that the next line of text is at hand
        line = lines[i]
        if m := _INLINE.match(line):
            out.append((i, int(m[1])))
        elif (m := _STACKED.match(line)) and re.search("[A-Za-z]{2}", below) and not _STACKED.match(below):
            out.append((i, int(m[1])))
        if line.strip():
            below = line
    return out[::-1]


def block_start(found: list[tuple[int, int]], expected: int, size: int) -> int | None:
    """The line at which the notes of a page begin: the best of the candidates, ranked by how they are borne out.

    First comes the expected number, then the smallest of the six after it; either must be followed by its successor or lie
    low on the page. The rest is left to the longest run of successive numbers, of three or more and not too high up.
    """
    numbers = {n for _, n in found}
    ranked: list[tuple[tuple[int, int, int], int]] = []
    first: dict[int, int] = {}
    for line, n in found:
        first.setdefault(n, line)
    nearest = min((n for n in first if expected < n <= expected + 6), default=None)
    for rank, n in enumerate((expected, nearest)):
        if n in first and (n + 1 in numbers or first[n] > size * 0.55):
            ranked.append(((rank, 0, 0), first[n]))
    length = 0
    for k, (line, n) in enumerate(found):
        length = length + 1 if k and n == found[k - 1][1] + 1 else 1
        ranked.append(((2, -length, k), found[k - length + 1][0]))
    (rank, length, _), line = min(ranked)
    return line if rank < 2 or (length <= -3 and line > size * 0.4) else None


def split_page(lines: list[str], expected: int) -> tuple[int | None, list[str], list[str]]:
    """(printed number, body, notes) of a page; the line of the printed number is taken out."""
    printed, lines = None, list(lines)
    n = len(lines)
    for order in (range(n - 1, max(-1, n - 5), -1), range(min(3, n))):
        at = next((i for i in order if lines[i].strip()), None)
        if at is not None and _FURNITURE.match(lines[at]) and lines[at].strip().isascii() and lines[at].strip().isdigit():
            printed = int(lines.pop(at))
            break
    found = candidates(lines)
    start = block_start(found, expected, len(lines)) if found else None
    return (printed, lines, []) if start is None else (printed, lines[:start], lines[start:])


def parse_notes(lines: list[str], page: int) -> list[tuple[int, str, int]]:
    """(number, text, page) of the notes; lines before the first opener are left out, and so are notes without text."""
    notes: list[list] = []
    for line in lines:
        if not line.strip():
            continue
        if m := _INLINE.match(line):
            notes.append([int(m[1]), normalise(line[m.end() :]), page])
        elif m := _STACKED.match(line):
            notes.append([int(m[1]), "", page])
        elif notes:
            notes[-1][1] = normalise(f"{notes[-1][1]} {line}")
    return [tuple(x) for x in notes if x[1]]


def collapse(lines: list[str]) -> list[str]:
    """Line spacing taken out of a double-spaced page; wider gaps stay as one blank line."""
    blank = [not x.strip() for x in lines]
    text = blank.count(False)
    if text < 4 or sum(not a and b for a, b in zip(blank, blank[1:])) / text < 0.6:
        return lines
    out = []
    for i, line in enumerate(lines):
        if not blank[i]:
            out.append(line)
        elif (i == 0 or not blank[i - 1]) and i + 1 < len(lines) and blank[i + 1]:
            out.append("")
    return out


def heading(text: str) -> tuple[int, str] | None:
    t = text.strip()
    if not t or _LEADERS.search(t):
        return None
    body = re.sub(r"\s+[0-9]{1,4}\Z", "", t).strip()
    if not body or len(body.split()) > 14 or body[-1] in ";:,-­‐":
        return None
    if m := _OWN_NUMBER.match(body):
        title = m[2].strip()
        words = [w for w in title.split() if re.search("[A-Za-z]", w)]
        titular = title == title.upper() or (len(words) >= 2 and sum("A" <= w[0] <= "Z" for w in words) >= 0.6 * len(words))
        if "A" <= title[0] <= "Z" and title[-1] != "." and titular:
            return (2 if title == title.upper() else 3), title
    letters = len(re.sub("[^A-Za-z]", "", body))
    plain = body == body.upper() and body[-1] != "." and not re.search(r"[$%]|[0-9]{3}", body) and body.count(",") < 2
    return (2, body) if letters >= 4 and plain and letters > 0.6 * len(body) else None


def contents_page(lines: list[str]) -> list[dict] | None:
    """Blocks of a contents page; None for other pages."""
    if sum(bool(_LEADERS.search(x)) for x in lines) < 3:
        return None
    out, held = [], []
    for line in lines:
        if not line.strip():
            continue
        single = normalise(line)
        if m := _LEADERS.search(single):
            text = re.sub(r"[.·\s]+\Z", "", normalise(" ".join([*held, single[: m.start()]]))).strip()
            held = []
            if text:
                out.append({"kind": "contents", "text": text, "contents_page": m[1]})
        else:
            held.append(single)
    if rest := normalise(" ".join(held)):
        out.append({"kind": "paragraph", "text": rest})
    return out


def reflow(lines: list[str], left: int) -> list[dict]:
    """Hard-wrapped lines as blocks, by indent, blank lines and headings."""
    single = [normalise(x) for x in lines]
    heads = [heading(s) if s else None for s in single]
    deep = [bool(s) and heads[i] is None and not _LEADERS.search(s) and indent(lines[i]) >= left + 5 for i, s in enumerate(single)]
    quoted = [d and ((i > 0 and deep[i - 1]) or (i + 1 < len(deep) and deep[i + 1])) for i, d in enumerate(deep)]
    out: list[dict] = []
    open_lines: list[str] = []
    open_kind = "paragraph"

    def close() -> None:
        text = normalise(" ".join(open_lines))
        open_lines.clear()
        if not text or re.fullmatch(r"[0-9]{1,4}", text):
            return
        if open_kind == "paragraph" and (h := heading(text)):
            out.append({"kind": "heading", "level": h[0], "text": h[1]})
        else:
            out.append({"kind": open_kind, "text": text})

    for i, s in enumerate(single):
        if not s:
            close()
            continue
        m = _ONE_ENTRY.match(s)
        if m and m[1].strip():
            close()
            out.append({"kind": "contents", "text": m[1].strip().rstrip(".").strip(), "contents_page": m[2]})
            continue
        last = out[-1] if out and out[-1]["kind"] == "heading" else None
        if last and not open_lines and last["text"][-1] not in ".?!:" and _DANGLING.search(last["text"]) and "a" <= s[0] <= "z":
            last["text"] += " " + s
            continue
        if h := heads[i]:
            close()
            last = out[-1] if out and out[-1]["kind"] == "heading" else None
            if last and last["level"] == h[0] and last["text"][-1] not in ".?!:" and not re.match(r"(?:[IVXLC]{1,6}|[A-Z]|[0-9]{1,2})\.\s", s):
                last["text"] += " " + h[1]
            else:
                out.append({"kind": "heading", "level": h[0], "text": h[1]})
            continue
        kind = "quote" if quoted[i] else "paragraph"
        if open_lines and (kind != open_kind or (not quoted[i] and indent(lines[i]) > left + 1)):
            close()
        open_kind = kind
        open_lines.append(lines[i].strip())
    close()
    return out


def ends_sentence(text: str) -> bool:
    return text[-1:] in tuple(".?!:;\"')]") and not _SHORT.search(text) and not _INITIAL.search(text)


def merge_pages(blocks: list[dict]) -> list[dict]:
    """Paragraphs joined where a page break divides them; at most one page mark is looked past."""
    out: list[dict] = []
    for b in blocks:
        before = out[-1] if out else None
        if before and before["kind"] == "page":
            before = out[-2] if len(out) > 1 else None
        if before and b["kind"] == before["kind"] == "paragraph":
            head, tail = before["text"], b["text"]
            if head[-1] in "-­‐":
                before["text"] = head[:-1] + ("-" if "A" <= tail[0] <= "Z" else "") + tail
                continue
            if not ends_sentence(head) and (re.match("[a-z,;]", tail) or _SHORT.search(head) or _INITIAL.search(head)):
                before["text"] = f"{head} {tail}"
                continue
        out.append(dict(b))
    return out


def repair(text: str) -> tuple[str, int]:
    total = 0
    for pattern, to in _PYTHON_REPAIRS:
        text, n = pattern.subn(to, text)
        total += n
    return text, total


def link_markers(text: str, known: set[int]) -> str:
    """Bare numbers after punctuation become note references, if the note is known and no citation stands before."""

    def link(m: re.Match) -> str:
        if int(m[2]) not in known or _CITING.search(text[max(0, m.start() - 12) : m.start() + 1]):
            return m[0]
        return f"{m[1]}[^{int(m[2])}]"

    return _MARKER.sub(link, text)


def endnotes(notes: list[tuple[int, str, int]]) -> dict[int, str]:
    """One text per number, in order of first sight; different texts of a number are joined."""
    parts: dict[int, list[str]] = {}
    for number, text, _ in notes:
        own = parts.setdefault(number, [])
        if text not in own:
            own.append(text)
    return {n: " ".join(p) for n, p in parts.items()}


def serialise(blocks: list[dict]) -> str:
    forms = {"heading": lambda b: "#" * b["level"] + " " + b["text"], "quote": lambda b: "> " + b["text"], "contents": lambda b: f"- {b['text']} — {b['contents_page']}", "page": lambda b: f"%%page {b['printed']}%%"}
    return "\n\n".join(forms.get(b["kind"], lambda b: b["text"])(b) for b in blocks)


def pages_of(text: str, page_rows: int) -> list[tuple[int, list[str]]]:
    if "\f" in text:
        pages = [p.split("\n") for p in text.split("\f")]
    else:
        lines = text.split("\n")
        pages = [lines[k : k + page_rows] for k in range(0, len(lines), page_rows)]
    return [(k, p) for k, p in enumerate(pages) if any(x.strip() for x in p)]


def read_document(text: str, page_rows: int) -> dict:
    """All that is read from a document: its split pages, notes, blocks and merged blocks."""
    pages = pages_of(text, page_rows)
    left = margin([x for _, p in pages for x in p])
    expected, split, notes, blocks = 1, [], [], []
    for k, lines in pages:
        printed, body, foot = split_page(lines, expected)
        split.append((k, printed, body, foot))
        got = parse_notes(foot, k)
        notes += got
        if got:
            expected = max(n for n, _, _ in got) + 1
        body = collapse(body)
        found = contents_page(body)
        found = reflow(body, left) if found is None else found
        if printed is not None and found:
            blocks.append({"kind": "page", "printed": printed})
        blocks += found
    return {"pages": split, "notes": notes, "blocks": blocks, "merged": merge_pages(blocks)}


def to_markdown(read: dict, meta: dict[str, str | None]) -> tuple[str, int]:
    """(Markdown, repairs made) of a document; empty metadata are left out."""
    body, fixes = repair(serialise(read["merged"]))
    body = link_markers(body, {n for n, _, _ in read["notes"]})
    notes = []
    for number, text, page in read["notes"]:
        fixed, n = repair(text)
        notes.append((number, fixed, page))
        fixes += n
    head = [f"{k}: {json.dumps(str(v), ensure_ascii=False)}" for k, v in meta.items() if v] + [f"pages: {len(read['pages'])}", f"footnotes: {len(notes)}"]
    ends = "\n\n".join(f"[^{n}]: {t}" for n, t in endnotes(notes).items())
    parts = ["---\n" + "\n".join(head) + "\n---", body, f"## Notes\n\n{ends}" if ends else ""]
    return re.sub(r"\n{4,}", "\n\n\n", "\n\n".join(p for p in parts if p)).rstrip() + "\n", fixes


def unique_ids(bases: list[str]) -> list[str]:
    """Each base, or the base with the smallest free number from 2."""
    taken: set[str] = set()
    out = []
    for base in bases:
        name, n = base, 2
        while name in taken:
            name, n = f"{base}-{n}", n + 1
        taken.add(name)
        out.append(name)
    return out


# ---- in Spark ---------------------------------------------------------------------------------------------------------


def _each(docs: DataFrame, schema: str, rows_of, page_rows: int) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(doc, *row) for doc, text in zip(pdf.doc_id, pdf.text) for row in rows_of(read_document(text, page_rows))]
            yield pd.DataFrame(out, columns=names).astype({c: "Int64" for c in names if c in ("printed", "level")})

    return docs.filter(F.col("text").isNotNull()).select("doc_id", "text").mapInPandas(run, schema)


def split_pages(docs: DataFrame, *, page_rows: int = 40) -> DataFrame:
    """(doc_id, pg, printed, body, notes) of docs(doc_id, text). Null texts have no pages."""
    return _each(docs, "doc_id long, pg int, printed int, body array<string>, notes array<string>", lambda r: r["pages"], page_rows)


def page_notes(docs: DataFrame, *, page_rows: int = 40) -> DataFrame:
    return _each(docs, "doc_id long, seq int, number int, text string, page int", lambda r: [(k, *n) for k, n in enumerate(r["notes"])], page_rows)


def _block_rows(blocks: list[dict]) -> list[tuple]:
    return [(k, b["kind"], b.get("level"), b.get("text"), b.get("contents_page"), b.get("printed")) for k, b in enumerate(blocks)]


def blocks(docs: DataFrame, *, merged: bool = True, page_rows: int = 40) -> DataFrame:
    """(doc_id, seq, kind, level, text, contents_page, printed), joined across pages or not."""
    schema = "doc_id long, seq int, kind string, level int, text string, contents_page string, printed int"
    return _each(docs, schema, lambda r: _block_rows(r["merged" if merged else "blocks"]), page_rows)


def ingest(docs: DataFrame, *, page_rows: int = 40) -> DataFrame:
    """(doc_id, markdown, source_text, pages, footnotes, auto_fixes) of docs(doc_id, text[, title, authors, published_at, source_url])."""
    meta = [c for c in ("title", "authors", "published_at", "source_url") if c in docs.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                read = read_document(row.text, page_rows)
                md, fixes = to_markdown(read, {c: getattr(row, c) for c in meta})
                source = "\n".join(x for _, p in pages_of(row.text, page_rows) for x in p)
                out.append((row.doc_id, md, source, len(read["pages"]), len(read["notes"]), fixes))
            yield pd.DataFrame(out, columns=["doc_id", "markdown", "source_text", "pages", "footnotes", "auto_fixes"])

    return docs.filter(F.col("text").isNotNull()).select("doc_id", "text", *meta).mapInPandas(run, "doc_id long, markdown string, source_text string, pages int, footnotes int, auto_fixes int")


def gated(docs: DataFrame, *, page_rows: int = 40) -> DataFrame:
    """The ingested documents with their gate: ``ok``, and ``failed``, the number of checks that failed.

    docs as for ``ingest``. The checks lie in the row of the document, so nothing is joined back to it.
    """
    from . import fidelity

    return fidelity.with_verdict(ingest(docs, page_rows=page_rows))
