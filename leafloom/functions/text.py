"""Column functions over text: all built in, so they stay in whole-stage code generation.

White space and trimming follow the wide Unicode class, ``$`` is written ``\\z``, and word boundaries are ASCII, because
those are the semantics of the documents' own rules; Java's defaults differ in each.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t\n\x0B\f\r    -     　﻿]"
NOT_WS = WS.replace("[", "[^", 1)
HYPHENS = "-­‐"

# Words that don't identify a paragraph.
STOPWORDS = "the a an and or but of to in on at by for with as is was were that this it he she they mr mrs ms".split()
# Repairs without another legitimate reading, in order (pattern, replacement).
REPAIRS = [
    (r"(?<![A-Za-z0-9_])0 ([0-9])/([0-9]{2})/([0-9]{4})(?![A-Za-z0-9_])", "0$1/$2/$3"),
    (r"(?<![A-Za-z0-9_])([0-9]{1,2}) ?: ?([0-9]{2})(?![A-Za-z0-9_])", "$1:$2"),
    (r"(?<![A-Za-z0-9_])in tum(?![A-Za-z0-9_])", "in turn"),
    (r"(?<![A-Za-z0-9_])UnUed States(?![A-Za-z0-9_])", "United States"),
]


def is_blank(t: Column) -> Column:
    return ~t.rlike(NOT_WS)


def trim_ws(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, f"^{WS}+", ""), rf"{WS}+\z", "")


def indent(t: Column) -> Column:
    return F.length(t) - F.length(F.regexp_replace(t, f"^{WS}+", ""))


def normalise(t: Column) -> Column:
    """No-break spaces and curly quotes made plain, runs of blanks collapsed, ends trimmed."""
    plain = F.translate(t, " ‘’“”", " ''\"\"")
    return trim_ws(F.regexp_replace(plain, r"[ \t]+", " "))


def words(t: Column) -> Column:
    """The comparable words: without note marks, lower case, ASCII letters and digits only."""
    bare = F.lower(F.regexp_replace(t, r"\[\^[0-9]+\]:?", ""))
    return F.filter(F.transform(F.split(bare, f"{WS}+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", "")), lambda w: w != "")


def auto_fix(t: Column) -> Column:
    for pattern, to in REPAIRS:
        t = F.regexp_replace(t, pattern, to)
    return t


def fix_counts(t: Column) -> tuple[Column, Column]:
    """(matches, true changes): a repair that matches counts even where it changes nothing, in the first."""
    matches, changes = F.lit(0), F.lit(0)
    for k, (pattern, to) in enumerate(REPAIRS):
        matches = matches + F.regexp_count(t, F.lit(pattern))
        narrow = r"(?<![A-Za-z0-9_])[0-9]{1,2}(?: : ?| ?: )[0-9]{2}(?![A-Za-z0-9_])" if k == 1 else pattern
        changes = changes + F.regexp_count(t, F.lit(narrow))
        t = F.regexp_replace(t, pattern, to)
    return matches.cast("int"), changes.cast("int")


def strip_front_matter(md: Column) -> Column:
    return F.regexp_replace(md, r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "")


def front_matter(md: Column) -> Column:
    return F.regexp_extract(md, r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?", 1)


def strip_notes_section(md: Column) -> Column:
    return F.regexp_replace(md, r"(?s)\n## Notes\n.*", "")


def id_words(t: Column) -> Column:
    """The words of a paragraph that its id may hold."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(t), r"\[\^[0-9]+\]", " "), rf"[^\p{{L}}\p{{N}}\-{WS[1:-1]}]", " ")
    return F.filter(F.split(plain, f"{WS}+"), lambda w: w != "")


def id_from_words(words: Column) -> Column:
    telling = F.filter(words, lambda w: ~w.isin(STOPWORDS))
    base = F.array_join(F.slice(F.when(F.size(telling) >= 2, telling).otherwise(words), 1, 5), "-")
    base = F.regexp_replace(F.substring(base, 1, 60), r"-+\z", "")
    return F.when(base == "", "para").otherwise(base)


def paragraph_id_base(t: Column) -> Column:
    """The id that a paragraph's own opening words give."""
    return id_from_words(id_words(t))


def slugify(t: Column) -> Column:
    kept = trim_ws(F.regexp_replace(F.lower(t), rf"[^A-Za-z0-9_\-{WS[1:-1]}]", ""))
    return F.substring(F.regexp_replace(kept, f"{WS}+", "-"), 1, 80)


def strip_tags(t: Column) -> Column:
    t = F.regexp_replace(t, "<[^>]+>", "")
    for entity, sign in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return trim_ws(F.regexp_replace(t, f"{WS}+", " "))


def visible_length(t: Column) -> Column:
    return F.length(trim_ws(F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), f"{WS}+", " ")))


def escape_html(t: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(sign), F.lit(entity))
    return t


def truncate(t: Column, limit: int = 280) -> Column:
    """At most ``limit`` characters, cut at the last space if that is past six tenths of it, with an ellipsis."""
    cut = F.substring(t, 1, limit)
    space = F.length(cut) - F.instr(F.reverse(cut), " ")
    at = F.when((F.instr(cut, " ") > 0) & (space > limit * 0.6), space).otherwise(limit)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(trim_ws(F.substring(cut, F.lit(1), at)), F.lit("…")))


def fit_to_card(t: Column, limit: int = 420) -> Column:
    """At most ``limit`` characters, preferably up to the last sentence end past half of it."""
    cut = F.substring(t, 1, limit)
    stop = F.length(F.regexp_extract(cut, r"(?s)\A(.*[.?!]) ", 1))
    space = F.length(cut) - F.instr(F.reverse(cut), " ")
    return (
        F.when(F.length(t) <= limit, t)
        .when(stop > limit * 0.5, F.substring(cut, F.lit(1), stop))
        .otherwise(F.concat(F.substring(cut, F.lit(1), space), F.lit("…")))
    )


def wrap_in_quotes(t: Column) -> Column:
    return F.when(t.rlike(r"[\"“”]\z"), t).otherwise(F.concat(F.lit("“"), t, F.lit("”")))


def card_size(n: Column) -> Column:
    return F.when(n > 320, 34).when(n > 220, 40).when(n > 130, 48).otherwise(56)


def byline(*parts: Column) -> Column:
    return F.concat_ws(" · ", *(F.nullif(p, F.lit("")) for p in parts))


def citation_url(base: str, report: Column, paragraph: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/reports/"), report, F.lit("?p="), paragraph, F.lit("#"), paragraph)


def entries_only(md: Column) -> Column:
    """What follows the first rule of three hyphens, without the white space before it; the whole text if there is none."""
    at = F.instr(md, "\n---\n")
    return F.when(at == 0, md).otherwise(F.regexp_replace(F.substring(md, at + 5, F.length(md)), f"^{WS}+", ""))
