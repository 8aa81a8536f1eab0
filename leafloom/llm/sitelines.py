"""Problem 3: lines that a site repeats over its documents, found by compressed bitmaps and removed.

A line is known by its letters (Unicode letters, lower-cased), so variants that differ in digits, case, spacing or
punctuation share one key and their bitmaps are one from the start. For each (site, key) the documents are kept as a
word-aligned compressed bitmap: one row per non-zero 64-bit word, the absent words being the zero runs. ``bit_or`` unites the
words of all partitions, with partial results where the lines lie; exact cardinalities are sums of ``bit_count``, which
partial sums reduce to one row per line and partition before anything moves. So a hot site or a hot line never gathers in
one task: its words are spread by their number, and its counts are few.

A document is in the bitmap of each of its own lines, so the lookup of a line's bitmap at deletion comes down to whether
the line is a repeated one; that is tested in the document's own row, and no line or text is moved for it. Per site at most
1 / min_share lines are repeated for each line of an average document.

Keys are 64-bit hashes of table and letters within a 64-bit hash of the site. For a site of 10^10 lines and a hundred
repeated ones, the chance that any line is taken for a repeated one by its hash is below 10^-7.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plan_aids import once
from .common import settled

MIN_LETTERS, MIN_DOCS, MIN_SHARE = 12, 4, 0.2
#: Repeated lines of all sites that are broadcast; more of them are joined, each site in SALTS parts.
MAX_BROADCAST, SALTS = 500_000, 64


def line_keys(tab: Column, text: Column) -> Column:
    """The keys of a text's lines, in order; null for a line with too few letters."""
    letters = F.transform(F.split(text, "\n", -1), lambda x: F.when(F.length(x) >= MIN_LETTERS, F.regexp_replace(F.lower(x), r"[^\p{L}]+", "")))
    return F.transform(letters, lambda x: F.when(F.length(x) >= MIN_LETTERS, F.xxhash64(tab, x)))


def keyed(df: DataFrame) -> DataFrame:
    """df (tab, text, ...) with ``keys``, worked out once."""
    return once(df, keys=line_keys(F.col("tab"), F.col("text")))


def repeated_lines(df: DataFrame, site_docs: DataFrame, *, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(scope, key, n_docs) of the lines in enough documents of their site. df: site, doc, keys; site_docs: site, doc."""
    lines = df.filter(F.col("site").isNotNull() & F.col("doc").isNotNull()).select(
        F.xxhash64("site").alias("scope"), F.explode(F.filter("keys", lambda k: k.isNotNull())).alias("key"), F.expr("floor(doc / 64)").alias("word_no"), F.expr("shiftleft(1L, cast(pmod(doc, 64) as int))").alias("bit")
    )
    bitmaps = lines.groupBy("scope", "key", "word_no").agg(F.bit_or("bit").alias("word"))
    counted = bitmaps.groupBy("scope", "key").agg(F.sum(F.bit_count("word")).alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    totals = site_docs.filter(F.col("site").isNotNull()).groupBy(F.xxhash64("site").alias("scope")).agg(F.count_distinct("doc").alias("site_n"))
    return counted.join(totals, "scope").filter(F.col("n_docs") >= F.col("site_n") * F.lit(min_share)).select("scope", "key", "n_docs")


def _with_own(df: DataFrame, repeated: DataFrame, max_broadcast: int) -> DataFrame:
    """df (site, row_id, doc, keys, ...) with ``own``: the repeated lines of its site among the keys, null or empty for none."""
    by_site = repeated.groupBy(F.col("scope").alias("__scope")).agg(F.collect_list("key").alias("__repeated"))
    df = df.withColumn("__scope", F.xxhash64("site"))
    if repeated.count() <= max_broadcast:
        joined = df.join(F.broadcast(by_site), "__scope", "left")
    else:  # a hot site is split over SALTS tasks
        by_site = by_site.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = df.withColumn("__salt", F.expr(f"pmod(xxhash64(row_id), {SALTS})").cast("int")).join(by_site, ["__scope", "__salt"], "left").drop("__salt")
    own = F.when(F.col("site").isNotNull() & F.col("doc").isNotNull(), F.array_intersect("keys", "__repeated"))
    return once(joined, own=own).drop("__scope", "__repeated")


def excess_lines(df: DataFrame, site_docs: DataFrame, *, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(tab, site, row_id, doc, line_no) of every occurrence of a repeated line at its site.

    df: tab, site, row_id, doc and text or keys. Rows with a null site, document or text have no lines. Ties at the
    thresholds count. Repeated rows come out once. An empty input gives an empty result.
    """
    df = (df if "keys" in df.columns else keyed(df)).select("tab", "site", "row_id", "doc", "keys")
    repeated = settled(repeated_lines(df, site_docs, min_docs=min_docs, min_share=min_share))
    rows = _with_own(df, repeated, max_broadcast).filter(F.size("own") > 0)
    lines = rows.select("tab", "site", "row_id", "doc", "own", F.posexplode("keys").alias("line_no", "key"))
    return lines.filter(F.array_contains("own", F.col("key"))).select("tab", "site", "row_id", "doc", "line_no").distinct()


def clean_texts(df: DataFrame, site_docs: DataFrame, *, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(tab, row_id, text) of every row of df (tab, site, row_id, doc, text), its text without the repeated lines of its site.

    Rows without such lines keep their text as it is; a text of which every line goes becomes empty; null stays null;
    repeated rows come out as often as they came in.
    """
    df = df.select("tab", "site", "row_id", "doc", "text")
    repeated = settled(repeated_lines(keyed(df).drop("text"), site_docs, min_docs=min_docs, min_share=min_share))
    rows = _with_own(keyed(df), repeated, max_broadcast)
    kept = F.expr("array_join(filter(split(text, '\\n', -1), (x, i) -> not coalesce(array_contains(own, keys[i]), false)), '\\n')")
    return rows.select("tab", "row_id", F.when(F.size("own") > 0, kept).otherwise(F.col("text")).alias("text"))
