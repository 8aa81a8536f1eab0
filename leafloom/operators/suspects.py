"""The review queue: doubtful places of scanned text, counted and ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import WS
from ..plan_aids import once

# Pattern of doubt, name, confidence.
RULES = [
    (r"(?<![A-Za-z0-9_])[A-Za-z0-9_]*[a-z]rn[a-z][A-Za-z0-9_]*", "possible rn/m confusion", "possible"),
    (r"(?<![A-Za-z0-9_])[A-Za-z]*[0-9][A-Za-z]+(?![A-Za-z0-9_])", "digit inside a word", "likely"),
    (r"[A-Za-z]{2,}[;!\\|][A-Za-z]{2,}", "stray punctuation inside a word", "likely"),
    (r"(?i)(?<![A-Za-z0-9_])(?:tum|modem|conceming|thc|fl-om|arid|bo th|ofthe|inthe)(?![A-Za-z0-9_])", "known OCR artefact", "likely"),
    (r"(?<![A-Za-z0-9_])[a-z]{1,2}[A-Z][a-z]", "case break inside a word", "possible"),
]
# Words that are right in spite of the first rule.
SAFE = (
    "turn turned turning modern concerning the from and government governmental attorney internal external alternate alternative "
    "return returned returning journal journalist eternal paternal fraternal burn burned learn learned"
).split()
ORDER = {"certain": 0, "likely": 1, "possible": 2}


def suspects(texts: DataFrame) -> DataFrame:
    """(doc_id, page, rule, at, pattern, match, context, confidence) of texts(doc_id, page, text), in one pass over them.

    The text is cut at every match by a pattern of two groups, so the lengths of the cuts give the places of all matches.
    """
    found = []
    for k, (rule, name, confidence) in enumerate(RULES):
        cut = ("(?si)" if "(?i)" in rule else "(?s)") + r"\G(.*?)(" + rule.replace("(?i)", "") + ")"
        one = lambda g: F.when(F.col("text").rlike(rule), F.regexp_extract_all("text", F.lit(cut), g))  # noqa: E731, B023
        found.append(F.struct(F.lit(k).alias("rule"), F.lit(name).alias("pattern"), F.lit(confidence).alias("confidence"), one(1).alias("gaps"), one(2).alias("hits")))
    rows = texts.select("doc_id", "page", "text", F.inline(F.array(*found))).filter(F.size("hits") > 0)
    # the place of a match: the running sum of the gaps and matches before it
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("end"))
    moves = F.arrays_zip("gaps", "hits")
    rows = once(rows, moves=moves).select("doc_id", "page", "text", "rule", "pattern", "confidence", "moves", F.posexplode("hits").alias("i", "match"))
    rows = rows.filter(~F.lower("match").isin(SAFE))
    at = F.aggregate(F.slice("moves", F.lit(1), F.col("i") + 1), zero, lambda s, m: F.struct((s["end"] + F.length(m["gaps"])).alias("at"), (s["end"] + F.length(m["gaps"]) + F.length(m["hits"])).alias("end")))["at"]
    rows = once(rows, at=at)
    start = F.greatest(F.col("at") - 40, F.lit(0))
    context = F.substring(F.col("text"), start + 1, F.col("at") - start + F.length("match") + 40)
    return rows.select("doc_id", "page", "rule", "at", "pattern", "match", F.trim(F.regexp_replace(context, f"{WS}+", " ")).alias("context"), "confidence")


def ranked(found: DataFrame, *, top: int | None = None) -> DataFrame:
    """(doc_id, rank, pattern, match, n, page, context, confidence): grouped matches, doubtful first, then by count and first sight."""
    first = F.struct("page", "rule", "at")
    groups = found.groupBy("doc_id", "pattern", "match").agg(
        F.count("*").alias("n"), F.min_by("page", first).alias("page"), F.min_by("context", first).alias("context"), F.first("confidence").alias("confidence"), F.min(first).alias("seen")
    )
    level = F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv])[F.col("confidence")]
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(level, F.col("n").desc(), "seen"))
    groups = groups.withColumn("rank", rank)
    if top:
        groups = groups.filter(F.col("rank") <= top)
    return groups.select("doc_id", "rank", "pattern", "match", "n", "page", "context", "confidence")
