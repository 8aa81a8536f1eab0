"""Problem 5: cut oversized texts at natural boundaries, by packing a structure tree.

A text is parsed into a tree whose nodes lie one after the other and cover it: headed parts by level, in them paragraphs,
lists with nested items, tables, code blocks and formulas; paragraphs are made of the sentences that ``sentences`` finds,
sentences of lines and words. The tree is packed from below: the subtrees of one parent are merged, in order, while they
fit; only a node that is itself too large is opened, and what it is cut into isn't merged with its parent's other children,
except inside a paragraph. A heading stays with what follows it. The overlap each later piece begins with counts towards
the limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices
from .sentences import boundaries

LEVELS = 6
_HEADING = re.compile(r"(?:(#{1,6})[ \t]+\S|<h([1-6])\b|(={2,6})[^=\n].*={2,6}[ \t]*$|\\((?:sub)*)section\b)")
_FENCE = re.compile(r"[ \t]*(```|~~~)")
_ITEM = re.compile(r"([ \t]*)(?:[-*+•‣–][ \t]+|\(?\d{1,3}[.)][ \t]+|\(?[a-z]\)[ \t]+|\\item\b)")
_FORMULA_OPEN, _FORMULA_CLOSE = re.compile(r"[ \t]*(?:\$\$|\\\[|\\begin\{)"), {"$$": "$$", "\\[": "\\]"}
_WORD = re.compile(r"\S+\s*|\s+")


@dataclass
class Node:
    """text[start:end]; kind: part, heading, paragraph, sentence, list, item, table, code, formula, line, word."""

    start: int
    end: int
    kind: str
    level: int = 0
    children: list[Node] = field(default_factory=list)


def _heading_level(m: re.Match) -> int:
    if m[1]:
        return len(m[1])
    if m[2]:
        return int(m[2])
    if m[3]:
        return len(m[3])
    return 1 + len(m[4] or "") // 3


def _blocks(text: str) -> list[Node]:
    """The blocks of a text, in order; the blank lines after a block belong to it."""
    out: list[Node] = []
    at, close, blank = 0, "", True  # close: what ends the code block or formula that is open

    def begin(kind: str, level: int = 0) -> None:
        out.append(Node(at, at, kind, level))

    for line in text.splitlines(keepends=True) if "\r" not in text else re.findall(r"[^\n]*\n|[^\n]+\Z", text):
        bare = line.strip()
        if close:
            if bare.endswith(close) or close in ("```", "~~~") and bare.startswith(close):
                close = ""
                blank = True
        elif not bare:
            if not out:
                begin("paragraph")
            blank = True
        elif m := _HEADING.match(line):
            begin("heading", min(_heading_level(m), LEVELS))
            blank = True
        elif m := _FENCE.match(line):
            begin("code")
            close = "" if bare.count(m[1]) > 1 else m[1]
            blank = not close
        elif m := _FORMULA_OPEN.match(line):
            begin("formula")
            sign = m[0].strip()
            ends = _FORMULA_CLOSE.get(sign) or "\\end" + bare[len("\\begin") :].split("}")[0] + "}"
            close = "" if bare.find(ends, len(sign)) >= 0 else ends
            blank = not close
        elif line[0] == "|":
            if blank or out[-1].kind != "table":
                begin("table")
            blank = False
        elif _ITEM.match(line):
            if not out or out[-1].kind != "list":
                begin("list")
            blank = False
        else:
            if blank or out[-1].kind == "table":
                begin("paragraph")
            blank = False
        at += len(line)
        out[-1].end = at
    return out


def structure_tree(text: str) -> Node:
    """The tree of headed parts and their blocks."""
    root = Node(0, len(text), "part", 0)
    path = [root]
    for b in _blocks(text):
        if b.kind == "heading":
            while path[-1].level >= b.level:
                path.pop().end = b.start
            part = Node(b.start, len(text), "part", b.level, [b])
            path[-1].children.append(part)
            path.append(part)
        else:
            path[-1].children.append(b)
    return root


def _tiles(a: int, b: int, cuts: list[int], kind: str) -> list[Node]:
    """The parts of text[a:b] between the cuts; none if it has only one."""
    cuts = [a, *(c for c in cuts if a < c < b), b]
    return [Node(x, y, kind) for x, y in zip(cuts, cuts[1:])] if len(cuts) > 2 else []


def _items(text: str, node: Node) -> list[Node]:
    """The items of a list, each with the items that are set in under it."""
    root = Node(node.start, node.end, "list")
    path: list[tuple[int, Node]] = [(-1, root)]
    at = node.start
    for line in re.findall(r"[^\n]*\n|[^\n]+\Z", text[node.start : node.end]):
        if m := _ITEM.match(line):
            depth = len(m[1].expandtabs(4))
            while path[-1][0] >= depth:
                path.pop()[1].end = at
            item = Node(at, node.end, "item")
            if len(path) > 1 and not path[-1][1].children:
                path[-1][1].children.append(Node(path[-1][1].start, at, "paragraph"))  # the item's own words
            path[-1][1].children.append(item)
            path.append((depth, item))
        at += len(line)
    return root.children


def _opened(text: str, node: Node) -> list[Node]:
    """The parts of a node that is too large."""
    if node.children:
        return node.children
    a, b = node.start, node.end
    if node.kind == "list":
        return _items(text, node)
    if node.kind in ("paragraph", "item", "heading"):
        blank = [a + m.end() for m in re.finditer(r"\n[ \t]*\n\s*", text[a:b])]
        if parts := _tiles(a, b, blank, "paragraph"):
            return parts
        ends = [a + c for c in boundaries(text[a:b])]
        ends = [e + len(text[e:b]) - len(text[e:b].lstrip()) if text[e : e + 1].isspace() else e for e in ends] if b - a < 1 << 16 else _past_space(text, ends, b)
        if parts := _tiles(a, b, ends, "sentence"):
            return parts
    if node.kind not in ("line", "word"):
        if parts := _tiles(a, b, [a + m.end() for m in re.finditer(r"\n", text[a:b])], "line"):
            return parts
    if node.kind != "word":
        return _tiles(a, b, [a + m.end() for m in _WORD.finditer(text[a:b])], "word")
    return []


def _past_space(text: str, ends: list[int], stop: int) -> list[int]:
    out = []
    for e in ends:
        while e < stop and text[e].isspace():
            e += 1
        out.append(e)
    return out


#: Nodes whose fragments go on with what follows them: inside a paragraph there is no structure to keep apart.
_PROSE = {"paragraph", "sentence", "line", "word", "code", "table", "formula", "heading"}


def _packed(text: str, node: Node, room: int, lead: int) -> list[int]:
    """Ends of the units that a node is packed into, each of at most ``room`` characters. The first of them holds ``lead``
    characters that stand before the node as well: headings that must not be left alone."""
    if lead + node.end - node.start <= room:
        return [node.end]
    parts = _opened(text, node)
    if not parts:
        return [*range(node.start - lead + room, node.end, room), node.end] if lead < room else [node.start, *range(node.start + room, node.end, room), node.end]
    ends: list[int] = []
    begin = node.start - lead  # of the unit that is being filled
    open_end = -1  # its end so far, if more may be merged into it
    held = node.start > begin  # does it hold nothing but headings?
    for k, p in enumerate(parts):
        if p.kind == "heading" and k + 1 < len(parts) and p.end - begin <= room and open_end < 0:
            held = True
            continue
        if p.end - begin <= room:
            open_end, held = p.end, False
            continue
        if open_end > begin and not held:  # the unit is closed; the subtree stays whole in the next
            ends.append(open_end)
            begin = open_end
            if p.end - begin <= room:
                open_end = p.end
                continue
        own = _packed(text, p, room, p.start - begin)
        ends += own[:-1]
        begin = own[-2] if len(own) > 1 else begin
        held = False
        if p.kind in _PROSE and node.kind in _PROSE | {"item"}:
            open_end = own[-1]
        else:
            ends.append(own[-1])
            begin, open_end = own[-1], -1
    if not ends or ends[-1] < node.end:
        ends.append(node.end)
    return ends


def cut_points(text: str, limit: int, overlap: int) -> list[int]:
    """Ends of the pieces. Piece k has text[end(k-1) - overlap : end(k)], of at most ``limit`` characters."""
    if limit <= overlap:
        raise ValueError("the limit must be larger than the overlap")
    return _packed(text, structure_tree(text), limit - overlap, 0) if text else [0]


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece; a text within the limit, the empty one too, is one piece."""
    if len(text) <= limit:
        return [(0, len(text))]
    ends, out = cut_points(text, limit, overlap), []
    for k, end in enumerate(ends):
        # the overlap is taken of the piece before, which may be shorter than the overlap
        out.append((0 if k == 0 else max(out[-1][0], ends[k - 1] - overlap), end))
    return out


def pieces(df: DataFrame, *, limit: Column, overlap: Column) -> DataFrame:
    """(tab, row_id, piece_no, start_at, end_at, piece) of df (tab, row_id, text).

    Each piece after the first begins with the last ``overlap`` characters of the piece before it (with the whole of it,
    if it is shorter). Null texts have no piece; an empty text has one empty piece; repeated rows give repeated pieces.
    Texts within their limit never leave the JVM.
    """
    df = df.filter(F.col("text").isNotNull()).select("tab", "row_id", "text", limit.cast("int").alias("limit"), overlap.cast("int").alias("overlap"))
    kind = df.schema["row_id"].dataType.simpleString()
    schema = f"tab string, row_id {kind}, piece_no int, start_at int, end_at int, piece string"

    def cut(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(rows, rows=50):
            out = []
            for tab, row, text, most, lap in pdf.itertuples(index=False):
                out += [(tab, row, k, a, b, text[a:b]) for k, (a, b) in enumerate(split_text(text, int(most), int(lap)))]
            yield pd.DataFrame(out, columns=["tab", "row_id", "piece_no", "start_at", "end_at", "piece"])

    small = df.filter(F.length("text") <= F.col("limit")).select(
        "tab", "row_id", F.lit(0).alias("piece_no"), F.lit(0).alias("start_at"), F.length("text").alias("end_at"), F.col("text").alias("piece")
    )
    return small.unionByName(oversized_pieces(df, schema, cut))


def oversized_pieces(df: DataFrame, schema: str, cut) -> DataFrame:
    return df.filter(F.length("text") > F.col("limit")).mapInPandas(cut, schema)
