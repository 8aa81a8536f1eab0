"""Quality gates between a source text and its Markdown: structure, invented words, retained words, verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plan_aids import once


def word_counts(pairs: DataFrame) -> DataFrame:
    """(doc_id, source_words, output_words) of pairs(doc_id, source_text, markdown); a null side counts as none."""
    out = X.words(X.strip_front_matter(F.col("markdown")))
    return pairs.select("doc_id", F.size(F.coalesce(X.words(F.col("source_text")), F.array())).alias("source_words"), F.size(F.coalesce(out, F.array())).alias("output_words"))


def lossless(pairs: DataFrame, *, limit: float = 0.001) -> DataFrame:
    """(doc_id, num, den, ok): output words that neither the source nor its repaired form has, of all output words.

    A document without source text is not evaluated: ok is null. Row-local, since both texts lie in one row: the anti-join
    of words against the source's own vocabulary is a hashed array difference, and nothing is shuffled.
    """
    source = F.array_union(X.words(F.col("source_text")), X.words(X.auto_fix(F.col("source_text"))))
    output = X.words(X.strip_front_matter(F.col("markdown")))
    both = once(pairs.filter(F.col("markdown").isNotNull()), source=source, output=output).select("doc_id", "source", "output")
    both = once(both, foreign=F.array_except("output", "source"))
    num = F.size(F.filter("output", lambda w: F.array_contains("foreign", w)))
    both = both.select("doc_id", F.when(F.col("foreign").isNotNull(), num).alias("num"), F.size("output").alias("den"))
    ok = F.when(F.col("num").isNotNull(), F.when(F.col("den") > 0, F.col("num") < F.col("den") * F.lit(limit)).otherwise(False))
    return both.select("doc_id", "num", "den", ok.alias("ok"))


def foreign_samples(pairs: DataFrame, *, first: int = 5) -> DataFrame:
    """(doc_id, words): the first foreign words of each document, by an exploded anti-join, for documents whose words don't fit a row."""
    source = pairs.select("doc_id", F.explode(F.array_union(X.words(F.col("source_text")), X.words(X.auto_fix(F.col("source_text"))))).alias("w"))
    output = pairs.select("doc_id", F.posexplode(X.words(X.strip_front_matter(F.col("markdown")))).alias("pos", "w"))
    foreign = output.join(source.distinct(), ["doc_id", "w"], "left_anti")
    own = F.slice(F.array_sort(F.collect_list(F.struct("pos", "w"))), 1, first)
    return foreign.groupBy("doc_id").agg(F.transform(own, lambda x: x["w"]).alias("words"))


def retention(pairs: DataFrame) -> DataFrame:
    """(doc_id, num, den, ok): output words over source words, well inside (0.9, 1.05)."""
    n = word_counts(pairs)
    ok = (F.col("source_words") > 0) & (F.col("output_words") > 0.9 * F.col("source_words")) & (F.col("output_words") < 1.05 * F.col("source_words"))
    return n.select("doc_id", F.col("output_words").alias("num"), F.col("source_words").alias("den"), ok.alias("ok"))


def structural_checks(md: DataFrame) -> DataFrame:
    """(doc_id, name, ok, n): five checks per document, n being the number of offences (of headings for the fourth)."""
    body = X.strip_front_matter(F.col("markdown"))
    refs = F.regexp_extract_all("markdown", F.lit(r"\[\^([0-9]+)\]"), 1)
    defined = F.regexp_extract_all("markdown", F.lit(r"(?m)^\[\^([0-9]+)\]:"), 1)
    bare = F.size(F.filter(F.split(body, "\n", -1), lambda x: x.rlike(f"^{X.WS}*[0-9]{{1,4}}{X.WS}*\\z")))
    feeds = F.when(F.contains("markdown", F.lit("\f")), 1).otherwise(0)
    missing = F.size(F.filter(refs, lambda n: ~F.array_contains(defined, n)))
    heads = F.size(F.filter(F.split(body, "\n", -1), lambda x: x.rlike(f"^#{{1,6}}{X.WS}")))
    runs = F.when(F.col("markdown").rlike("\n{4,}"), 1).otherwise(0)
    checks = [("no bare page-number lines", bare, bare == 0), ("no form feeds", feeds, feeds == 0), ("every reference has a note", missing, missing == 0), ("document has headings", heads, heads > 0), ("no runs of blank lines", runs, runs == 0)]
    rows = F.array(*(F.struct(F.lit(name).alias("name"), ok.alias("ok"), n.cast("int").alias("n")) for name, n, ok in checks))
    return md.filter(F.col("markdown").isNotNull()).select("doc_id", F.inline(rows))


def all_checks(pairs: DataFrame) -> DataFrame:
    """(doc_id, name, ok) of all seven checks; a check without its source is left out."""
    loss = lossless(pairs).filter("ok is not null").select("doc_id", F.lit("output words all appear in the source").alias("name"), "ok")
    kept = retention(pairs.filter(F.col("markdown").isNotNull() & F.col("source_text").isNotNull())).select("doc_id", F.lit("content retained from source").alias("name"), "ok")
    return reduce(DataFrame.unionByName, [structural_checks(pairs).select("doc_id", "name", "ok"), loss, kept])


def verdict(checks: DataFrame) -> DataFrame:
    return checks.groupBy("doc_id").agg(F.bool_and("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))


def with_verdict(pairs: DataFrame) -> DataFrame:
    """pairs(doc_id, source_text, markdown, ...) with ``ok`` and ``failed``, worked out in the row of the document."""
    body = X.strip_front_matter(F.col("markdown"))
    source = F.array_union(X.words(F.col("source_text")), X.words(X.auto_fix(F.col("source_text"))))
    checked = once(pairs, __lines=F.split(body, "\n", -1), __all=source, __n=F.size(X.words(F.col("source_text"))), __out=X.words(body))
    checked = once(checked, __foreign=F.array_except("__out", "__all"))
    refs = F.regexp_extract_all("markdown", F.lit(r"\[\^([0-9]+)\]"), 1)
    defined = F.regexp_extract_all("markdown", F.lit(r"(?m)^\[\^([0-9]+)\]:"), 1)
    n_out, n_foreign = F.size("__out"), F.size(F.filter("__out", lambda w: F.array_contains("__foreign", w)))
    passed = [
        ~F.exists("__lines", lambda x: x.rlike(f"^{X.WS}*[0-9]{{1,4}}{X.WS}*\\z")), ~F.contains("markdown", F.lit("\f")), F.size(F.array_except(refs, defined)) == 0,
        F.exists("__lines", lambda x: x.rlike(f"^#{{1,6}}{X.WS}")), ~F.col("markdown").rlike("\n{4,}"),
        F.when(F.col("source_text").isNotNull(), (n_out > 0) & (n_foreign < n_out * F.lit(0.001))),
        F.when(F.col("source_text").isNotNull(), (F.col("__n") > 0) & (n_out > 0.9 * F.col("__n")) & (n_out < 1.05 * F.col("__n"))),
    ]
    checked = once(checked, failed=F.size(F.filter(F.array(*passed), lambda ok: ~ok)))
    return checked.withColumn("ok", F.col("failed") == 0).drop("__lines", "__all", "__n", "__out", "__foreign")


def verify(pairs: DataFrame, registry: DataFrame, *, report: str | None = None) -> DataFrame:
    """(report_id, ok, failed, volumes) of the ingested reports, and a row without report_id for the whole run.

    pairs: report_id, doc_id, source_text, markdown; registry: id, ingested. ``report`` chooses one report, before anything
    is read of the others. Reports that the registry doesn't count as ingested are passed over.
    """
    if report is not None:
        pairs = pairs.filter(F.col("report_id") == report)
    kept = registry.filter(F.coalesce("ingested", F.lit(True))).select(F.col("id").alias("report_id")).distinct()
    judged = with_verdict(pairs.filter(F.col("markdown").isNotNull()).join(kept, "report_id", "left_semi")).select("report_id", "ok", "failed")
    return judged.rollup("report_id").agg(F.bool_and("ok").alias("ok"), F.sum("failed").alias("failed"), F.count("*").alias("volumes"))
