"""Lines, pages and what layout says about them.

A page is one row with the array of its lines, cut from the document's text where it lies; what layout says about a page or
a document is worked out in that row. Only contents_entries moves rows, and those of contents pages alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import headings as H
from ..functions import text as X
from ..plan_aids import once

INLINE = "^" + X.WS + r"{0,8}([0-9]{1,4})" + X.WS + r"{0,3}[A-Za-z\"“(]"
STACKED = "^" + X.WS + r"{0,10}([0-9]{1,4})" + X.WS + r"*\z"
PAGE_NUMBER = "(?i)^" + X.WS + "*([0-9]{1,4}|[ivxlcdm]{1,8})" + X.WS + r"*\z"
BARE_NUMBER = "^" + X.WS + "*[0-9]{1,4}" + X.WS + r"*\z"


def doc_pages(docs: DataFrame, *, page_rows: int = 40) -> DataFrame:
    """(doc_id, pages) of docs(doc_id, text): pages is an array of (pg, lines).

    Form feeds part the pages; a document without any gets pages of ``page_rows`` lines. Pages without any text are left
    out, but keep their numbers. Null texts are left out.
    """
    fed = F.transform(F.split("text", "\f", -1), lambda p, i: F.struct(i.alias("pg"), F.split(p, "\n", -1).alias("lines")))
    docs = once(docs.filter(F.col("text").isNotNull()).select("doc_id", "text"), every=F.split("text", "\n", -1))
    starts = F.sequence(F.lit(0), F.floor((F.size("every") - 1) / page_rows).cast("int"))
    cut = F.transform(starts, lambda i: F.struct(i.alias("pg"), F.slice("every", i * page_rows + 1, F.lit(page_rows)).alias("lines")))
    pages = F.filter(F.when(F.contains("text", F.lit("\f")), fed).otherwise(cut), lambda p: F.exists(p["lines"], lambda t: ~X.is_blank(t)))
    return once(docs, pages=pages).select("doc_id", "pages")


def pages(docs: DataFrame, *, page_rows: int = 40) -> DataFrame:
    """(doc_id, pg, lines): a row for each page."""
    return doc_pages(docs, page_rows=page_rows).select("doc_id", F.inline("pages"))


def page_lines(docs: DataFrame, *, page_rows: int = 40) -> DataFrame:
    """(doc_id, pg, ln, t): a row for each line."""
    return pages(docs, page_rows=page_rows).select("doc_id", "pg", F.posexplode("lines").alias("ln", "t"))


def _text_lines(pages: Column) -> Column:
    return F.filter(F.flatten(F.transform(pages, lambda p: p["lines"])), lambda t: ~X.is_blank(t))


def doc_lines(books: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_nonblank) of books(doc_id, pages) with any page."""
    n = F.aggregate("pages", F.lit(0), lambda s, p: s + F.size(p["lines"]))
    return books.filter(F.size("pages") > 0).select("doc_id", n.cast("long").alias("n_lines"), F.size(_text_lines(F.col("pages"))).cast("long").alias("n_nonblank"))


def with_margin(books: DataFrame) -> DataFrame:
    """books(doc_id, pages) with ``margin``: the most frequent indent of the lines with text, the smaller on a tie, 0 for none."""
    books = once(books, indents=F.transform(_text_lines(F.col("pages")), X.indent))
    counted = F.transform(F.array_distinct("indents"), lambda d: F.struct(F.size(F.filter("indents", lambda x: x == d)).alias("n"), (-d).alias("less")))
    return books.withColumn("margin", F.coalesce(-F.array_max(counted)["less"], F.lit(0))).drop("indents")


def doc_margin(books: DataFrame) -> DataFrame:
    return with_margin(books.filter(F.size("pages") > 0)).select("doc_id", "margin")


def _spaced(page: DataFrame) -> DataFrame:
    """pages with ``blank`` (for each line), nonblank and alternating."""
    page = once(page, blank=F.transform("lines", X.is_blank))
    gaps = F.zip_with("blank", F.slice("blank", F.lit(2), F.size("blank")), lambda a, b: ~a & F.coalesce(b, F.lit(False)))
    return page.withColumn("nonblank", F.size(F.filter("blank", lambda b: ~b)).cast("long")).withColumn("alternating", F.size(F.filter(gaps, lambda g: g)).cast("long"))


def _is_double() -> Column:
    return (F.col("nonblank") >= 4) & (F.col("alternating") >= 0.6 * F.col("nonblank"))


def double_spaced(page: DataFrame) -> DataFrame:
    return _spaced(page).select("doc_id", "pg", "nonblank", "alternating", _is_double().alias("is_double"))


def collapse_spacing(page: DataFrame) -> DataFrame:
    """(doc_id, pg, ln, t): on double-spaced pages single blank lines go, and of longer gaps one blank line stays."""
    page = once(_spaced(page), wide=_is_double())
    b = lambda i: F.get("blank", i)
    first_of_gap = lambda i: ~F.coalesce(b(i - 1), F.lit(False)) & F.coalesce(b(i + 1), F.lit(False))
    kept = F.filter(
        F.transform("lines", lambda t, i: F.struct(i.alias("ln"), F.when(F.col("wide") & b(i), "").otherwise(t).alias("t"), (~F.col("wide") | ~b(i) | first_of_gap(i)).alias("kept"))),
        lambda x: x["kept"],
    )
    return page.select("doc_id", "pg", F.inline(kept)).select("doc_id", "pg", "ln", "t")


def printed_pages(page: DataFrame) -> DataFrame:
    """The printed number at the foot, or else at the head, of each page. A Roman number stops the search but is not taken."""
    text = lambda a: F.filter(a, lambda t: ~X.is_blank(t))
    n = F.size("lines")
    foot = F.try_element_at(text(F.slice("lines", F.greatest(n - 3, F.lit(1)), F.lit(4))), F.lit(-1))
    head = F.try_element_at(text(F.slice("lines", F.lit(1), F.lit(3))), F.lit(1))
    number = lambda c: F.when(F.col(c).rlike(BARE_NUMBER), X.trim_ws(F.col(c)).cast("int"))
    return page.select("doc_id", "pg", foot.alias("foot"), head.alias("head")).select("doc_id", "pg", F.coalesce(number("foot"), number("head")).alias("printed"))


def with_candidates(page: DataFrame) -> DataFrame:
    """pages with ``found``: an array of (ln, note) of the lines that may open a note, a number before prose or alone above
    prose."""
    after = lambda i: F.try_element_at(F.filter(F.slice("lines", i + 2, F.size("lines")), lambda t: ~X.is_blank(t)), F.lit(1))
    prose = lambda t: t.rlike("[A-Za-z]{2}") & ~t.rlike(STACKED)

    def note(t: Column, i: Column) -> Column:
        stacked = F.exists(F.array(after(i)), lambda x: F.coalesce(prose(x), F.lit(False)))
        number = F.when(t.rlike(INLINE), F.regexp_extract(t, INLINE, 1)).when(t.rlike(STACKED) & stacked, F.regexp_extract(t, STACKED, 1))
        return F.struct(i.alias("ln"), number.cast("int").alias("note"))

    return once(page, found=F.filter(F.transform("lines", note), lambda c: c["note"].isNotNull()))


def note_candidates(page: DataFrame) -> DataFrame:
    return with_candidates(page).select("doc_id", "pg", F.inline("found"))


def longest_note_run(page: DataFrame) -> DataFrame:
    """Per page the longest run of candidates each one more than the last, the earliest on a tie."""
    start = F.struct(*(F.lit(0).alias(c) for c in ("n", "ln", "best_n", "best_ln")), F.lit(-1).alias("last"))

    def step(s: Column, c: Column) -> Column:
        goes_on = (s["n"] > 0) & (c["note"] == s["last"] + 1)
        n, ln = F.when(goes_on, s["n"] + 1).otherwise(1), F.when(goes_on, s["ln"]).otherwise(c["ln"])
        longer = n > s["best_n"]
        return F.struct(n.alias("n"), ln.alias("ln"), F.when(longer, n).otherwise(s["best_n"]).alias("best_n"), F.when(longer, ln).otherwise(s["best_ln"]).alias("best_ln"), c["note"].alias("last"))

    best = with_candidates(page).filter(F.size("found") > 0).select("doc_id", "pg", F.aggregate("found", start, step).alias("s"))
    return best.select("doc_id", "pg", F.col("s.best_ln").alias("start_ln"), F.col("s.best_n").cast("long").alias("run_len"))


def heading_lines(lines: DataFrame) -> DataFrame:
    found = H.with_heading(lines, X.normalise(F.col("t"))).filter(F.col("h").isNotNull())
    return found.select("doc_id", "pg", "ln", F.col("h.level").alias("level"), F.col("h.text").alias("text"))


def contents_entries(page: DataFrame) -> DataFrame:
    """Entries of contents pages (three leader lines or more): wrapped lines join the leader line that ends them."""
    text = once(page, text=F.filter(F.transform("lines", lambda t, i: F.struct(i.alias("ln"), X.normalise(t).alias("single"))), lambda x: x["single"] != ""))
    text = text.filter(F.size(F.filter("text", lambda x: x["single"].rlike(H.LEADERS))) >= 3).select("doc_id", "pg", F.inline("text"))
    text = text.withColumn("leads", F.col("single").rlike(H.LEADERS))
    before = W.partitionBy("doc_id", "pg").orderBy("ln").rowsBetween(W.unboundedPreceding, -1)
    text = text.withColumn("entry", F.coalesce(F.count_if("leads").over(before), F.lit(0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ln", F.regexp_replace("single", H.LEADERS, "").alias("s")))), lambda x: x["s"])
    joined = X.trim_ws(F.regexp_replace(X.normalise(F.array_join("parts", " ")), r"[.·\s]+\z", ""))
    out = text.groupBy("doc_id", "pg", "entry").agg(parts.alias("parts"), F.max(F.when(F.col("leads"), F.regexp_extract("single", H.LEADERS, 1))).alias("page"))
    return out.filter(F.col("page").isNotNull()).select("doc_id", "pg", "entry", joined.alias("text"), "page").filter("text <> ''")


def quote_lines(books: DataFrame) -> DataFrame:
    """Lines set in by five or more beside another such line; headings and contents entries don't count.

    A line that is set in goes on with its neighbours that are set in too, so that headings are told apart without
    moving any line.
    """
    page = with_margin(books).select("doc_id", "margin", F.inline("pages"))
    deep = lambda t: ~X.is_blank(t) & (X.indent(t) >= F.col("margin") + 5) & ~H.is_contents_entry(X.normalise(t))
    page = once(page, deep=F.transform("lines", lambda t: F.when(deep(t), X.normalise(t))))
    beside = F.filter(
        F.transform("deep", lambda t, i: F.struct(i.alias("ln"), t.alias("own"), F.get("deep", i - 1).alias("above"), F.get("deep", i + 1).alias("below"))),
        lambda x: x["own"].isNotNull() & (x["above"].isNotNull() | x["below"].isNotNull()),
    )
    rows = page.select("doc_id", "pg", F.inline(beside))
    for c in ("own", "above", "below"):
        rows = H.with_heading(rows, F.coalesce(F.col(c), F.lit("")), to=f"{c}_h")
    set_in = lambda c: F.col(c).isNotNull() & F.col(f"{c}_h").isNull()
    return rows.filter(set_in("own") & (set_in("above") | set_in("below"))).select("doc_id", "pg", "ln")
