"""Notes: endnotes, their definitions and references in Markdown, and the page each paragraph stands on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..plan_aids import once

DEFINITION = r"(?m)^\[\^([0-9]+)\]:[ \t]*(.+)$"
REFERENCE = r"\[\^([0-9]+)\](?!:)"


def endnotes(notes: DataFrame) -> DataFrame:
    """(doc_id, ord, number, text): one text per number, different texts joined in order; ord by first sight."""
    firsts = notes.groupBy("doc_id", "number", "text").agg(F.min("seq").alias("seq"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    joined = firsts.groupBy("doc_id", "number").agg(F.array_join(parts, " ").alias("text"), F.min("seq").alias("first"))
    return joined.withColumn("ord", F.row_number().over(W.partitionBy("doc_id").orderBy("first"))).select("doc_id", "ord", "number", "text")


def definitions(md: DataFrame) -> DataFrame:
    """(doc_id, number, text) of md(doc_id, markdown): the last definition of a number holds."""
    pairs = F.arrays_zip(F.regexp_extract_all("markdown", F.lit(DEFINITION), 1).alias("n"), F.regexp_extract_all("markdown", F.lit(DEFINITION), 2).alias("x"))
    rows = md.select("doc_id", F.posexplode(pairs).alias("pos", "d"))
    return rows.groupBy("doc_id", F.col("d.n").cast("int").alias("number")).agg(F.max_by("d.x", "pos").alias("text"))


def references(md: DataFrame) -> DataFrame:
    """(doc_id, pos, number): the references of the body, in order."""
    body = X.strip_notes_section(X.strip_front_matter(F.col("markdown")))
    return md.select("doc_id", F.posexplode(F.regexp_extract_all(body, F.lit(REFERENCE), 1)).alias("pos", "n")).select("doc_id", "pos", F.col("n").cast("int").alias("number"))


def resolution(md: DataFrame) -> DataFrame:
    """(doc_id, number, status, n_refs): ``used``, ``orphan`` (no reference) or ``missing`` (no definition)."""
    defs, refs = definitions(md), references(md).groupBy("doc_id", "number").agg(F.count("*").alias("n_refs"))
    both = defs.select("doc_id", "number", F.lit(True).alias("defined")).join(refs, ["doc_id", "number"], "full")
    status = F.when(F.col("defined").isNull(), "missing").when(F.col("n_refs").isNull(), "orphan").otherwise("used")
    return both.select("doc_id", "number", status.alias("status"), F.coalesce("n_refs", F.lit(0)).alias("n_refs"))


def sidenotes(md: DataFrame) -> DataFrame:
    """(doc_id, k, number, anchor, text): the resolved references, numbered in order of the text."""
    found = references(md).join(definitions(md), ["doc_id", "number"])
    k = F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))
    found = found.withColumn("k", k)
    return found.select("doc_id", "k", "number", F.concat_ws("-", F.lit("sn"), "number", "k").alias("anchor"), "text")


def orphans(md: DataFrame) -> DataFrame:
    """(doc_id, number, text) of the definitions that nothing refers to."""
    return definitions(md).join(references(md).select("doc_id", "number"), ["doc_id", "number"], "left_anti")


def with_sidenotes(md: DataFrame) -> DataFrame:
    """(doc_id, body, used) of md(doc_id, markdown): the body, each reference that has a definition replaced by its sidenote,
    numbered through the document; other references stay. Worked out in the row of the document."""
    md = md.filter(F.col("markdown").isNotNull())
    body = X.strip_notes_section(X.strip_front_matter(F.col("markdown")))
    numbers, texts = (F.regexp_extract_all("markdown", F.lit(DEFINITION), g) for g in (1, 2))
    md = once(md, body=body, notes=F.map_from_arrays(F.array_distinct(numbers), F.transform(F.array_distinct(numbers), lambda n: F.element_at(F.filter(F.zip_with(numbers, texts, lambda a, b: F.struct(a.alias("n"), b.alias("t"))), lambda d: d["n"] == n), -1)["t"])))
    md = once(md.select("doc_id", "body", "notes"), refs=F.regexp_extract_all("body", F.lit(r"\[\^([0-9]+)\]"), 1), gaps=F.split("body", r"\[\^[0-9]+\]", -1))
    md = once(md, found=F.transform("refs", lambda n: F.nullif(F.try_element_at("notes", n), F.lit(""))))
    nth = lambda i: F.size(F.filter(F.slice("found", F.lit(1), i + 1), lambda t: t.isNotNull()))
    mark = F.transform("refs", lambda n, i: F.coalesce(_sidenote(n, nth(i).cast("string"), F.get("found", i)), F.concat(F.lit("[^"), n, F.lit("]"))))
    text = F.concat(F.array_join(F.zip_with(F.slice("gaps", F.lit(1), F.size("refs")), mark, lambda g, m: F.concat(g, m)), ""), F.element_at("gaps", -1))
    return md.select("doc_id", text.alias("body"), F.size(F.array_distinct(F.filter(F.zip_with("refs", "found", lambda n, t: F.when(t.isNotNull(), n)), lambda n: n.isNotNull()))).alias("used"))


def _sidenote(number: Column, nth: Column, text: Column) -> Column:
    # The mark of a sidenote.
    name = F.concat_ws("-", F.lit("sn"), number, nth)
    parts = ['<label class="sidenote-toggle" for="', name, '" aria-label="Note ', number, '"><sup>', number, '</sup></label><input class="sidenote-checkbox" id="', name, '" type="checkbox" /><span class="sidenote"><sup>', number, "</sup> ", X.escape_html(text), "</span>"]
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
