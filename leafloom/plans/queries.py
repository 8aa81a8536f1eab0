"""The inventory's operators over the test tables: every query reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import fidelity, folds, layout, notes, passages, sections, suspects
from ..plan_aids import once, spread
from ..sources import readers

#: Sections of the test volumes are short, so the queries part them at a smaller size than the default.
SECTION_CHARS = 800
# Paths of an old site, and renamed reports.
OLD_PATHS = ["/archive-one", "/pages", "/search", "/feed.xml"]
RENAMED = [("old-boiler-room", "crevalby-boiler-room-001")]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(_table(spark, d, "ingest_results").select(F.col("result_id").alias("doc_id"), F.col("source_text").alias("text")))


def _md(spark: SparkSession, d: str) -> DataFrame:
    return spread(_table(spark, d, "ingest_results").select(F.col("result_id").alias("doc_id"), "markdown"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return spread(_table(spark, d, "ingest_results").select(F.col("result_id").alias("doc_id"), "source_text", "markdown"))


def _books(spark: SparkSession, d: str) -> DataFrame:
    return layout.doc_pages(_docs(spark, d))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return layout.pages(_docs(spark, d))


def doc_lines(spark, d):
    return layout.doc_lines(_books(spark, d))


def normalise_lines(spark, d):
    return layout.page_lines(_docs(spark, d)).select("doc_id", "pg", "ln", X.normalise(F.col("t")).alias("norm"))


def doc_margin(spark, d):
    return layout.doc_margin(_books(spark, d))


def double_spaced_pages(spark, d):
    return layout.double_spaced(_pages(spark, d))


def collapse_spacing(spark, d):
    return layout.collapse_spacing(_pages(spark, d))


def printed_pages(spark, d):
    return layout.printed_pages(_pages(spark, d))


def note_candidates(spark, d):
    return layout.note_candidates(_pages(spark, d))


def longest_note_run(spark, d):
    return layout.longest_note_run(_pages(spark, d))


def heading_lines(spark, d):
    return layout.heading_lines(layout.page_lines(_docs(spark, d)))


def contents_entries(spark, d):
    return layout.contents_entries(_pages(spark, d))


def quote_lines(spark, d):
    return layout.quote_lines(_books(spark, d))


def split_pages(spark, d):
    return folds.split_pages(_docs(spark, d)).select("doc_id", "pg", "printed", F.array_join("body", "\n").alias("body"), F.array_join("notes", "\n").alias("notes"))


def page_notes(spark, d):
    return folds.page_notes(_docs(spark, d))


def endnotes(spark, d):
    return notes.endnotes(folds.page_notes(_docs(spark, d)))


def blocks(spark, d):
    return folds.blocks(_docs(spark, d), merged=False)


def merged_blocks(spark, d):
    return folds.blocks(_docs(spark, d))


def markdown_out(spark, d):
    return folds.ingest(_docs(spark, d)).select("doc_id", "markdown", "pages", "footnotes", "auto_fixes")


def link_markers(spark, d):
    """(doc_id, n_links, numbers): the references of the body, in order."""
    got = folds.ingest(_docs(spark, d))
    refs = F.regexp_extract_all(X.strip_notes_section(F.col("markdown")), F.lit(r"\[\^([0-9]+)\]"), 1)
    return once(got.select("doc_id", "markdown"), refs=refs).select("doc_id", F.size("refs").alias("n_links"), F.array_join("refs", " ").alias("numbers"))


def ingest_gate(spark, d):
    return folds.gated(_docs(spark, d)).select("doc_id", "pages", "footnotes", "auto_fixes", "ok", "failed")


def auto_fix(spark, d):
    matches, changes = X.fix_counts(F.col("text"))
    return _docs(spark, d).filter(F.col("text").isNotNull()).select("doc_id", X.auto_fix(F.col("text")).alias("fixed"), matches.alias("n_matches"), changes.alias("n_changed"))


def _suspects(spark, d):
    return suspects.suspects(_pages(spark, d).select("doc_id", F.col("pg").alias("page"), F.array_join("lines", " ").alias("text")))


def suspect_matches(spark, d):
    return _suspects(spark, d).select("doc_id", "page", "pattern", F.col("at").alias("place"), "match", "context", "confidence")


def ranked_suspects(spark, d):
    return suspects.ranked(_suspects(spark, d), top=200)


def queue_by_pattern(spark, d):
    return _table(spark, d, "suspects").groupBy("pattern_label", "confidence").agg(F.count("*").alias("n"), F.sum("seen_count").alias("seen"))


def front_matter(spark, d):
    lines = F.filter(F.split(X.front_matter(F.col("markdown")), "\n"), lambda x: x.contains(": "))
    rows = _md(spark, d).filter(F.col("markdown").isNotNull()).select("doc_id", F.explode(lines).alias("x"))
    value = F.regexp_replace(F.substring(F.col("x"), F.instr("x", ": ") + 2, F.length("x")), r'\A"|"\z', "")
    return rows.select("doc_id", F.substring_index("x", ": ", 1).alias("key"), value.alias("value"))


def markdown_blocks(spark, d):
    return sections.markdown_blocks(_md(spark, d))


def paragraph_ids(spark, d):
    return sections.paragraphs(_md(spark, d)).select("doc_id", "seq", "para_id")


def paragraph_pages(spark, d):
    return sections.paragraph_pages(_md(spark, d))


def overview(spark, d):
    return passages.overview(_md(spark, d), min_chars=SECTION_CHARS)


def section_nav(spark, d):
    return sections.section_nav(_md(spark, d), min_chars=SECTION_CHARS)


def section_texts(spark, d):
    return sections.section_texts(_md(spark, d), min_chars=SECTION_CHARS)


def _runs(spark, d):
    return _table(spark, d, "ingest_results").select(F.col("report_id").alias("report"), F.col("result_id").alias("doc_id"))


def _asked(spark, d):
    """(doc_id, para_id): the passages that curated quotes name, in every volume of their report."""
    asked = _table(spark, d, "share_quotes").select("report", F.col("paragraph").alias("para_id")).distinct()
    return asked.join(_runs(spark, d), "report").select("doc_id", "para_id").distinct()


def resolve(spark, d):
    return passages.resolve(_asked(spark, d), sections.paragraph_sections(_md(spark, d), min_chars=SECTION_CHARS))


def notes_resolution(spark, d):
    return notes.resolution(_md(spark, d).filter(F.col("markdown").isNotNull()))


def sidenotes(spark, d):
    return notes.sidenotes(_md(spark, d).filter(F.col("markdown").isNotNull()))


def orphan_notes(spark, d):
    return notes.orphans(_md(spark, d).filter(F.col("markdown").isNotNull()))


def word_multiset(spark, d):
    return fidelity.word_counts(_pairs(spark, d))


def lossless(spark, d):
    return fidelity.lossless(_pairs(spark, d))


def foreign_words(spark, d):
    got = fidelity.foreign_samples(_pairs(spark, d).filter(F.col("source_text").isNotNull()))
    return got.select("doc_id", F.array_join("words", " ").alias("words"))


def retention(spark, d):
    return fidelity.retention(_pairs(spark, d))


def structural_checks(spark, d):
    return fidelity.structural_checks(_md(spark, d))


def verdict(spark, d):
    return fidelity.verdict(fidelity.all_checks(_pairs(spark, d)))


def html_text(spark, d):
    t = F.col("text")
    docs = _table(spark, d, "documents").filter(t.isNotNull())
    plain = once(docs.select("doc_id", "text"), plain=X.strip_tags(t))
    words = F.size(F.filter(F.split("plain", f"{X.WS}+"), lambda w: w != ""))
    return plain.select("doc_id", X.visible_length(t).alias("n_chars"), words.alias("words"), "plain", X.escape_html(t).alias("escaped"))


def catalog(spark, d):
    return passages.catalog(_table(spark, d, "registry"))


def catalog_count(spark, d):
    return passages.catalog(_table(spark, d, "registry")).agg(F.count("*").alias("n"))


def renamed_reports(spark, d):
    aliases = spark.createDataFrame(RENAMED, "old_id string, new_id string")
    old = aliases.select(F.col("old_id").alias("id"))
    return passages.renamed(_table(spark, d, "registry").select("id").unionByName(old), aliases)


def sitemap(spark, d):
    secs = overview(spark, d).join(_table(spark, d, "ingest_results").select(F.col("result_id").alias("doc_id"), F.col("report_id").alias("id")), "doc_id").select("id", "sec_ord", "slug")
    return passages.sitemap(_table(spark, d, "registry"), secs)


def passage_preview(spark, d):
    return passages.previews(sections.paragraphs(_md(spark, d)), _asked(spark, d))


def card_quotes(spark, d):
    quotes = _table(spark, d, "share_quotes")
    md = _table(spark, d, "ingest_results").select(F.col("report_id").alias("report"), F.col("result_id").alias("doc_id"), "markdown")
    wanted = md.join(quotes.select("report").distinct(), "report", "left_semi")
    return passages.card_quotes(quotes, sections.paragraphs(spread(wanted)))


def card_manifest(spark, d):
    quotes = _table(spark, d, "share_quotes").filter(F.col("report").isNotNull() & F.col("paragraph").isNotNull())
    return passages.card_manifest(quotes).select(F.array_join("keys", "\n").alias("keys"), F.size("keys").alias("n"))


def resolve_url(spark, d):
    return passages.resolve_url(_table(spark, d, "documents").select("url").filter(F.col("url").isNotNull()).distinct(), OLD_PATHS)


def json_ld(spark, d):
    return passages.json_ld(_table(spark, d, "registry"))


def sidenote_body(spark, d):
    return notes.with_sidenotes(_md(spark, d))


def entries_only(spark, d):
    return _md(spark, d).select("doc_id", X.entries_only(F.col("markdown")).alias("entries"))


def document_passage(spark, d):
    md = _table(spark, d, "ingest_results").select(F.col("result_id").alias("doc_id"), F.col("report_id").alias("report"), "markdown")
    asked = _table(spark, d, "share_quotes").select("report", F.col("paragraph").alias("para_id"))
    return passages.documents(spread(md), asked)


def section_of(spark, d):
    """Sections that links name by their slug: every volume's first and last, and one that isn't there."""
    secs = sections.section_texts(_md(spark, d), min_chars=SECTION_CHARS)
    asked = overview(spark, d).groupBy("doc_id").agg(F.min("slug").alias("a"), F.max("slug").alias("b"))
    asked = asked.select("doc_id", F.explode(F.array_distinct(F.array("a", "b", F.lit("no-such-section")))).alias("slug"))
    return passages.section(asked, secs)


def verify(spark, d):
    pairs = _table(spark, d, "ingest_results").select("report_id", F.col("result_id").alias("doc_id"), "source_text", "markdown")
    return fidelity.verify(spread(pairs), _table(spark, d, "registry"))


def review_queue(spark, d):
    counts = _table(spark, d, "ingest_results").select(F.col("result_id").alias("doc_id"), "pages", "footnotes", "auto_fixes")
    return readers.review_queue(suspects.ranked(_suspects(spark, d), top=200), counts)


NAMES = """doc_lines normalise_lines doc_margin double_spaced_pages collapse_spacing printed_pages note_candidates longest_note_run heading_lines
contents_entries quote_lines split_pages page_notes endnotes blocks merged_blocks markdown_out link_markers auto_fix suspect_matches ranked_suspects
queue_by_pattern front_matter markdown_blocks paragraph_ids paragraph_pages overview section_nav section_texts resolve notes_resolution sidenotes orphan_notes
word_multiset lossless foreign_words retention structural_checks verdict html_text catalog catalog_count renamed_reports sitemap passage_preview
card_quotes card_manifest resolve_url json_ld sidenote_body entries_only document_passage section_of verify review_queue ingest_gate""".split()
