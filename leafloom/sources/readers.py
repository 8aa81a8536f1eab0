"""Sources and sinks: page text, registries, Markdown, curated quotes; Markdown, review queues and manifests out."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import REGISTRY, SHARE_QUOTES


def read_page_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per text file of extracted pages, form feeds between pages."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("markdown"))


def bundled(spark: SparkSession, texts: dict[str, str], *, paths: list[str] | None = None) -> DataFrame:
    """(path, markdown) of texts that are handed over in memory; a path that is asked for and isn't there is an error."""
    if missing := [p for p in paths or () if p not in texts]:
        raise KeyError(f"not bundled: {', '.join(missing)}")
    return spark.createDataFrame([(p, texts[p]) for p in (paths or texts)], "path string, markdown string")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The catalog from a YAML file with a list ``reports``, in the order of the list; ``ingested`` defaults to true."""
    import yaml

    reports = (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}).get("reports") or []
    fields = [f.name for f in REGISTRY if f.name not in ("ord", "ingested")]
    rows = [{f: None if r.get(f) is None else str(r[f]) for f in fields} | {"ord": k + 1, "ingested": bool(r.get("ingested", True))} for k, r in enumerate(reports)]
    return spark.createDataFrame(rows, REGISTRY)


def read_share_quotes(spark: SparkSession, path: str) -> DataFrame:
    import yaml

    quotes = (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}).get("quotes") or []
    names = {"match_text": "match", "quote_text": "quote"}
    rows = [tuple(None if q.get(names.get(f.name, f.name)) is None else str(q[names.get(f.name, f.name)]) for f in SHARE_QUOTES) for q in quotes]
    return spark.createDataFrame(rows, SHARE_QUOTES)


def one_quote(spark: SparkSession, report: str, paragraph: str) -> DataFrame:
    """A single passage that is asked for by its report and paragraph, in the form of a curated quote."""
    return spark.createDataFrame([(report, paragraph, None, None, None)], SHARE_QUOTES)


def read_changelog(spark: SparkSession, path: str) -> DataFrame:
    """(path, entries) of a changelog: what follows its first rule."""
    return read_markdown(spark, path).select("path", X.entries_only(F.col("markdown")).alias("entries"))


def write_markdown(ingested: DataFrame, path: str, *, buckets: int = 64) -> None:
    """Markdown by document, in ``buckets`` folders by a hash of the key and sorted within, so that a reader of one document
    prunes to a part of one folder while the number of files doesn't follow the number of documents."""
    out = ingested.select("doc_id", "markdown", F.expr(f"pmod(xxhash64(doc_id), {buckets})").cast("int").alias("bucket"))
    out.repartition(buckets, "bucket").sortWithinPartitions("bucket", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(path)


def review_queue(ranked: DataFrame, ingested: DataFrame, *, top: int = 200) -> DataFrame:
    """(doc_id, rank, line): the first ``top`` suspects of each document as rows of a Markdown table, after lines with the
    document's counts and the table's head (rank 0 and below)."""
    cell = lambda c: F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "confidence", "pattern", F.concat(F.lit("`"), F.col("match"), F.lit("`")), F.col("page").cast("string"), cell("context")), F.lit(" |"))
    rows = ranked.filter(F.col("rank") <= top).select("doc_id", "rank", line.alias("line"))
    counts = F.concat(F.lit("Pages: "), F.col("pages"), F.lit("  ·  Footnotes: "), F.col("footnotes"), F.lit("  ·  Auto-fixes applied: "), F.col("auto_fixes"))
    # The head of the table.
    head = [counts, F.lit(""), F.lit("| Confidence | Pattern | Text | Page | Context |"), F.lit("| --- | --- | --- | --- | --- |")]
    heads = ingested.select("doc_id", F.posexplode(F.array(*head)).alias("k", "line")).select("doc_id", (F.col("k") - len(head) + 1).alias("rank"), "line")
    return heads.unionByName(rows)


def write_review_queue(ranked: DataFrame, ingested: DataFrame, path: str, *, top: int = 200) -> None:
    review_queue(ranked, ingested, top=top).write.mode("overwrite").parquet(path)
