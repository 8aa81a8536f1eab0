"""The pN_ queries over the tables of the test data, each with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import channel, encode, leaks, markup, pieces, scans, sentences, sitelines, stuffing
from ..plan_aids import spread
from .common import table, tagged

BLOCK_LIMIT, BLOCK_OVERLAP, RUN_LIMIT, RUN_OVERLAP = 2000, 200, 6000, 300


# ---- problem 1 -------------------------------------------------------------------------------------------------------


def _marked_texts(spark: SparkSession, d: str, *, nulls: bool = False) -> DataFrame:
    blocks = spread(table(spark, d, "blocks").select(F.lit("blocks").alias("tab"), F.col("block_id").alias("row_id"), "text"))
    runs = spread(table(spark, d, "ingest_results").select(F.lit("ingest_results").alias("tab"), F.col("result_id").alias("row_id"), F.col("markdown").alias("text")))
    texts = blocks.unionByName(runs)
    return texts if nulls else texts.filter(F.col("text").isNotNull())


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.residue(_marked_texts(spark, d)).select("tab", "row_id", F.explode("families").alias("family")).distinct()


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every text of both fields, null ones too, row by row."""
    return markup.cleaned(_marked_texts(spark, d, nulls=True))


# ---- problem 2 -------------------------------------------------------------------------------------------------------


def _quoted(spark: SparkSession, d: str) -> DataFrame:
    blocks = tagged(table(spark, d, "blocks"), "blocks", "block_id", "text", where=F.col("kind") == "quote")
    return tagged(table(spark, d, "share_quotes"), "share_quotes", "quote_id", "quote_text").unionByName(blocks)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(_quoted(spark, d)).select("tab", "row_id", "start_at", "end_at").distinct()


def p2_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of every quote and of every block, row by row."""
    blocks = tagged(spread(table(spark, d, "blocks").select("block_id", "text")), "blocks", "block_id", "text")
    return sentences.sentences(tagged(table(spark, d, "share_quotes"), "share_quotes", "quote_id", "quote_text").unionByName(blocks))


# ---- problem 3 -------------------------------------------------------------------------------------------------------


def _site_texts(spark: SparkSession, d: str, *, keys_only: bool) -> tuple[DataFrame, DataFrame]:
    """(tab, site, row_id, doc, text or keys) and (site, doc); keys are worked out before the join, so that no text moves."""
    runs = table(spark, d, "ingest_results")
    sites = runs.select(F.col("result_id").alias("doc"), "site")
    texts = runs.select(F.lit("ingest_results").alias("tab"), "site", F.col("result_id").alias("row_id"), F.col("result_id").alias("doc"), F.col("source_text").alias("text"))
    blocks = table(spark, d, "blocks").select(F.lit("blocks").alias("tab"), F.col("block_id").alias("row_id"), F.col("result_id").alias("doc"), "text")
    if keys_only:
        texts = sitelines.keyed(texts.filter(F.col("text").isNotNull())).drop("text")
        blocks = sitelines.keyed(blocks.filter(F.col("text").isNotNull())).drop("text")
    return texts.unionByName(blocks.join(sites, "doc", "left").select(*texts.columns)), sites


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    texts, sites = _site_texts(spark, d, keys_only=True)
    return sitelines.excess_lines(texts, sites).select("tab", "row_id", "line_no").distinct()


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every text of both tables without its site's lines, row by row."""
    texts, sites = _site_texts(spark, d, keys_only=False)
    return sitelines.clean_texts(texts, sites)


# ---- problem 4 -------------------------------------------------------------------------------------------------------


def _scanned(spark: SparkSession, d: str) -> tuple[DataFrame, channel.Model]:
    runs = spread(table(spark, d, "ingest_results").select(F.col("result_id").alias("row_id"), "source_text", "markdown"))
    return runs, channel.learn(runs.select(F.explode(F.array("source_text", "markdown")).alias("text")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    runs, model = _scanned(spark, d)
    queue = table(spark, d, "suspects").select(F.col("suspect_id").alias("row_id"), "match_text", "context")
    return scans.scan_cases(runs, queue, model).distinct()


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    runs, model = _scanned(spark, d)
    return scans.repaired_texts(runs, model)


# ---- problem 5 -------------------------------------------------------------------------------------------------------


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    texts = tagged(table(spark, d, "blocks"), "blocks", "block_id", "text").dropDuplicates(["row_id"])
    texts = texts.unionByName(tagged(table(spark, d, "ingest_results"), "ingest_results", "result_id", "markdown"))
    return pieces.pieces(texts, limit=_by_tab(BLOCK_LIMIT, RUN_LIMIT), overlap=_by_tab(BLOCK_OVERLAP, RUN_OVERLAP))


def _by_tab(blocks: int, runs: int):
    return F.when(F.col("tab") == "blocks", blocks).otherwise(runs)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts of which the operator makes a second piece."""
    texts = tagged(table(spark, d, "blocks"), "blocks", "block_id", "text")
    texts = texts.unionByName(tagged(table(spark, d, "ingest_results"), "ingest_results", "result_id", "markdown"))
    cut = pieces.pieces(texts, limit=_by_tab(BLOCK_LIMIT, RUN_LIMIT), overlap=_by_tab(BLOCK_OVERLAP, RUN_OVERLAP))
    return cut.filter(F.col("piece_no") == 1).select("tab", "row_id").distinct()


# ---- problem 6 -------------------------------------------------------------------------------------------------------


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_ids(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


# ---- problem 7 -------------------------------------------------------------------------------------------------------


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


# ---- problem 8 -------------------------------------------------------------------------------------------------------


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(spread(table(spark, d, "documents").select("doc_id", "text", "lang")), table(spark, d, "doc_labels")).select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    here = globals()
    return {n: here[n] for n in sorted(here) if n[:1] == "p" and n[1:2].isdigit()}
