"""Markdown as blocks, paragraphs with durable ids and pages, and sections with slugs.

A document is parsed once, in its row, to an array of blocks; sections, ids, slugs and pages are worked out from that array
and only the result is exploded, so nothing is shuffled. Numbering ids and slugs, carrying the page on and merging short
parts go from one item to the next; these three take small arrays, never the texts, through Arrow.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..plan_aids import once
from .folds import unique_ids

PAGE_MARK = r"\A%%page ([0-9]+)%%\z"
HEADING = "^#{1,6} "


@F.pandas_udf(T.ArrayType(T.StringType()))
def numbered(bases: pd.Series) -> pd.Series:
    """Each base, or with the smallest free number from 2."""
    return bases.map(lambda b: unique_ids(list(b)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def carried(values: pd.Series) -> pd.Series:
    """Each value, or the last one before it that isn't null."""

    def fill(own):
        out, last = [], None
        for v in own:
            last = last if v is None or v != v else int(v)
            out.append(last)
        return out

    return values.map(fill)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])))
def merged_parts(opens: pd.Series, sizes: pd.Series, least: pd.Series) -> pd.Series:
    """(first, last) places of the sections. A part begins where ``opens``; a part smaller than ``least`` joins the one
    before, and a small first one the one after."""

    def merge(starts, lens, low):
        n = len(lens)
        if not n:
            return []
        cuts = [0] + [k for k in range(1, n) if starts[k]]
        before = np.concatenate([[0], np.cumsum(lens)])
        kept = [c for c, e in zip(cuts, [*cuts[1:], n]) if c == 0 or before[e] - before[c] - 1 >= low]
        if len(kept) > 1 and before[kept[1]] - 1 < low:
            kept.pop(1)
        return [{"first": a, "last": b - 1} for a, b in zip(kept, [*kept[1:], n])]

    return pd.Series([merge(*x) for x in zip(opens, sizes, least)])


def with_blocks(md: DataFrame) -> DataFrame:
    """md(doc_id, markdown, ...) with ``blocks``: an array of (seq, kind, level, text), without front matter and notes section."""
    body = X.strip_notes_section(X.strip_front_matter(F.col("markdown")))
    raw = F.filter(F.transform(F.split(body, "\n{2,}"), lambda x, i: F.struct(i.alias("seq"), X.trim_ws(x).alias("t"))), lambda b: b["t"] != "")
    return once(md.filter(F.col("markdown").isNotNull()), blocks=F.transform(raw, _block)).drop("markdown")


def _block(b: Column) -> Column:
    t = b["t"]
    kind = (
        F.when(t.rlike(PAGE_MARK), "page").when(t.rlike(HEADING), "heading").when(t.startswith("> "), "quote")
        .when(t.rlike("^- .* — [0-9]+\\z"), "contents").when(t.rlike(r"^\[\^[0-9]+\]:"), "note").otherwise("paragraph")
    )
    level = F.when(t.rlike(HEADING), F.length(F.regexp_extract(t, "^(#{1,6}) ", 1)))
    text = F.when(t.rlike(PAGE_MARK), F.regexp_extract(t, PAGE_MARK, 1)).otherwise(F.regexp_replace(t, "^(?:#{1,6}|>) +", ""))
    return F.struct(b["seq"].alias("seq"), kind.alias("kind"), level.alias("level"), text.alias("text"))


def markdown_blocks(md: DataFrame) -> DataFrame:
    """(doc_id, seq, kind, level, text) of md(doc_id, markdown)."""
    return with_blocks(md).select("doc_id", F.inline("blocks"))


def _is_paragraph(b: Column) -> Column:
    return b["kind"] == "paragraph"


def paragraph_pages(md: DataFrame) -> DataFrame:
    """(doc_id, seq, page) of the paragraphs: the last page mark before each, null before the first."""
    return with_paragraphs(with_blocks(md), ids=False).select("doc_id", F.inline("paragraphs")).select("doc_id", "seq", "page")


def with_paragraphs(docs: DataFrame, *, ids: bool = True) -> DataFrame:
    """docs(doc_id, blocks, ...) with ``paragraphs``: an array of (seq, text, page[, para_id]); the id is unique within the
    document and stable while the words stay."""
    pages = F.transform("blocks", lambda b: F.when(b["kind"] == "page", F.try_to_number(b["text"], F.lit("9999999999")).cast("int")))
    docs = once(docs, __pages=carried(pages))
    own = F.zip_with("blocks", "__pages", lambda b, p: F.struct(b["kind"].alias("kind"), b["seq"].alias("seq"), b["text"].alias("text"), p.alias("page")))
    docs = once(docs, __own=F.filter(own, _is_paragraph)).drop("__pages")
    if not ids:
        return docs.withColumn("paragraphs", F.transform("__own", lambda p: p.dropFields("kind"))).drop("__own")
    words = F.transform("__own", lambda p: F.struct(X.id_words(p["text"]).alias("all")))
    docs = once(docs, __ids=numbered(F.transform(words, lambda w: X.id_from_words(w["all"]))))
    full = F.zip_with("__own", "__ids", lambda p, i: F.struct(p["seq"].alias("seq"), p["text"].alias("text"), p["page"].alias("page"), i.alias("para_id")))
    return docs.withColumn("paragraphs", full).drop("__own", "__ids")


def paragraphs(md: DataFrame) -> DataFrame:
    """(doc_id, ..., seq, text, page, para_id): a row for each paragraph; other columns of md stay."""
    docs = with_paragraphs(with_blocks(md))
    return docs.select(*[c for c in docs.columns if c not in ("blocks", "paragraphs")], F.inline("paragraphs"))


def with_sections(docs: DataFrame, *, min_chars: int = 2500) -> DataFrame:
    """docs(doc_id, blocks, ...) with ``sections``: an array of (sec_ord, title, page, n_chars, words, first_seq, last_seq,
    slug, blocks).

    A part begins at each heading of level 2 or 3; a part shorter than ``min_chars`` joins the one before, and a short
    first part the one after. The page is the first page mark inside the section.
    """
    size = lambda b: F.when(b["kind"] == "page", 0).otherwise(F.length(b["text"]) + 1)
    ranges = merged_parts(F.transform("blocks", _opens), F.transform("blocks", size), F.lit(min_chars))
    docs = once(docs, __ranges=ranges)
    parts = F.transform("__ranges", lambda r: F.slice("blocks", r["first"] + 1, r["last"] - r["first"] + 1))
    docs = once(docs, __parts=parts)
    n_words = lambda b: F.size(F.filter(F.split(b["text"], f"{X.WS}+"), lambda w: w != ""))

    def section(p: Column, i: Column) -> Column:
        first = lambda test: F.get(F.filter(p, test), F.lit(0))["text"]
        return F.struct(
            (i + 1).alias("sec_ord"), F.coalesce(first(_opens), F.lit("Front matter")).alias("title"), first(lambda b: b["kind"] == "page").cast("int").alias("page"),
            (F.aggregate(p, F.lit(0), lambda s, b: s + size(b)) - 1).alias("n_chars"), F.aggregate(F.filter(p, lambda b: b["kind"] != "page"), F.lit(0), lambda s, b: s + n_words(b)).alias("words"),
            F.get(p, F.lit(0))["seq"].alias("first_seq"), F.element_at(p, -1)["seq"].alias("last_seq"), p.alias("blocks"),
        )

    docs = once(docs, __sections=F.transform("__parts", section))
    base = F.transform(F.transform("__sections", lambda s: X.slugify(s["title"])), lambda s: F.when(s == "", "section").otherwise(s))
    docs = once(docs, __slugs=numbered(base))
    return docs.withColumn("sections", F.zip_with("__sections", "__slugs", lambda s, g: s.withField("slug", g))).drop("__ranges", "__parts", "__sections", "__slugs")


def _opens(b: Column) -> Column:
    return F.coalesce((b["kind"] == "heading") & b["level"].isin(2, 3), F.lit(False))


def sections(md: DataFrame, *, min_chars: int = 2500) -> DataFrame:
    """(doc_id, sec_ord, slug, title, page, n_chars, words, first_seq, last_seq): a row for each section."""
    rows = with_sections(with_blocks(md), min_chars=min_chars).select("doc_id", F.inline("sections"))
    return rows.select("doc_id", "sec_ord", "slug", "title", "page", "n_chars", "words", "first_seq", "last_seq")


def section_nav(md: DataFrame, *, min_chars: int = 2500) -> DataFrame:
    """(doc_id, i, n, prev, slug, next): neighbours of each section."""
    docs = with_sections(with_blocks(md), min_chars=min_chars).select("doc_id", F.transform("sections", lambda s: s["slug"]).alias("slugs"))
    near = F.transform("slugs", lambda s, k: F.struct((k + 1).alias("i"), F.size("slugs").alias("n"), F.get("slugs", k - 1).alias("prev"), s.alias("slug"), F.get("slugs", k + 1).alias("next")))
    return once(docs, near=near).select("doc_id", F.inline("near"))


def section_texts(md: DataFrame, *, min_chars: int = 2500) -> DataFrame:
    """(doc_id, i, n, slug, title, page, prev, next, text): each section with its text, as Markdown, and its neighbours."""
    docs = with_sections(with_blocks(md), min_chars=min_chars).select("doc_id", "sections")
    mark = lambda b: (
        F.when(b["kind"] == "heading", F.concat(F.repeat(F.lit("#"), b["level"]), F.lit(" "), b["text"])).when(b["kind"] == "quote", F.concat(F.lit("> "), b["text"]))
        .when(b["kind"] == "page", F.concat(F.lit("%%page "), b["text"], F.lit("%%"))).otherwise(b["text"])
    )
    slug = lambda i: F.get("sections", i)["slug"]
    full = F.transform(
        "sections",
        lambda s, k: F.struct(
            (k + 1).alias("i"), F.size("sections").alias("n"), s["slug"].alias("slug"), s["title"].alias("title"), s["page"].alias("page"), slug(k - 1).alias("prev"), slug(k + 1).alias("next"),
            F.array_join(F.transform(s["blocks"], mark), "\n\n").alias("text"),
        ),
    )
    return once(docs, full=full).select("doc_id", F.inline("full"))


def paragraph_sections(md: DataFrame, *, min_chars: int = 2500) -> DataFrame:
    """(doc_id, para_id, slug): the section that holds each paragraph."""
    docs = with_paragraphs(with_sections(with_blocks(md), min_chars=min_chars)).select("doc_id", "paragraphs", F.transform("sections", lambda s: s.dropFields("blocks")).alias("sections"))
    held = F.flatten(
        F.transform("sections", lambda s: F.transform(F.filter("paragraphs", lambda p: (p["seq"] >= s["first_seq"]) & (p["seq"] <= s["last_seq"])), lambda p: F.struct(p["para_id"].alias("para_id"), s["slug"].alias("slug"))))
    )
    return once(docs, held=held).select("doc_id", F.inline("held"))
