"""Explicit schemas; nothing is inferred. Order is data, so every table carries an ordinal."""

from pyspark.sql import types as T

LINES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("pg", T.IntegerType()), T.StructField("ln", T.IntegerType()), T.StructField("t", T.StringType())])
SPLIT_PAGES = "doc_id long, pg int, printed int, body array<string>, notes array<string>"
NOTES = "doc_id long, seq int, number int, text string, page int"
BLOCKS = "doc_id long, seq int, kind string, level int, text string, contents_page string, printed int"
REGISTRY = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("ord", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("title", "authors", "published_at", "source_path", "source_url")]
    + [T.StructField("ingested", T.BooleanType())]
)
SHARE_QUOTES = T.StructType([T.StructField(c, T.StringType()) for c in ("report", "paragraph", "match_text", "note", "quote_text")])
