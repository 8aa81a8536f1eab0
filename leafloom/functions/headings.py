"""Classifiers of single lines and paragraphs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plan_aids import once
from .text import WS, trim_ws

LEADERS = r"[.·]{4,}" + WS + r"*([0-9]{1,4})" + WS + r"*\z"
NUMBERED = r"\A([IVXLC]{1,6}|[A-Z]|[0-9]{1,2})\." + WS + "+(.+)\\z"
# Words on which a finished title doesn't end.
DANGLING = "of the a an in to for and or with by from that was is are were on at as its their his her".split()
# Abbreviations that don't end a sentence.
ABBREVIATIONS = r"mr|mrs|ms|dr|prof|sen|rep|gov|st|nos?|vs?|inc|co|corp|ltd|jr|sr|u\.s|e\.g|i\.e|cf|ch|art|sec|fig|para|pp?|ecf|tr"


def is_contents_entry(t: Column) -> Column:
    return t.rlike(LEADERS)


def is_titular(t: Column) -> Column:
    """In capitals, or at least two words of which six in ten begin with a capital."""
    words = F.filter(F.split(t, f"{WS}+"), lambda w: w.rlike("[A-Za-z]"))
    capital = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    return (t == F.upper(t)) | ((F.size(words) >= 2) & (capital / F.size(words) >= 0.6))


def with_heading(df: DataFrame, line: Column, *, to: str = "h") -> DataFrame:
    """df with a column struct(level, text), null where ``line`` (normalised) is no heading. Its parts are worked out once
    per row each, since the rules name them many times."""
    df = once(df, __t=trim_ws(line))
    df = once(df, __b=trim_ws(F.regexp_replace("__t", WS + r"+[0-9]{1,4}\z", "")))
    df = once(df, __n=trim_ws(F.regexp_extract("__b", NUMBERED, 2)), __l=F.length(F.regexp_replace("__b", "[^A-Za-z]", "")))
    t, body, title, letters = (F.col(c) for c in ("__t", "__b", "__n", "__l"))
    fits = (t != "") & (body != "") & ~is_contents_entry(t) & ~body.rlike(r"[;:,\-­‐]\z") & (F.size(F.split(body, f"{WS}+")) <= 14)
    numbered = (title != "") & title.rlike("^[A-Z]") & ~title.rlike(r"\.\z") & is_titular(title)
    capitals = (
        (letters >= 4)
        & (body == F.upper(body))
        & ~body.rlike(r"\.\z|[$%]|[0-9]{3}")
        & (F.length(body) - F.length(F.replace(body, F.lit(","), F.lit(""))) < 2)
        & (letters / F.length(body) > 0.6)
    )
    level = F.when(title == F.upper(title), 2).otherwise(3)
    found = F.when(fits, F.when(numbered, F.struct(level.alias("level"), title.alias("text"))).when(capitals, F.struct(F.lit(2).alias("level"), body.alias("text"))))
    return once(df, **{to: found}).drop("__t", "__b", "__n", "__l")


def dangles(t: Column) -> Column:
    return ~t.rlike(r"[.?!:]\z") & trim_ws(t).rlike(rf"(?i)(?<![A-Za-z0-9_])({'|'.join(DANGLING)})\z")


def ends_sentence(t: Column) -> Column:
    short = t.rlike(rf"(?i)(?<![A-Za-z0-9_])({ABBREVIATIONS})\.\z") | t.rlike(r"(?<![A-Za-z0-9_])[A-Z]\.\z")
    return t.rlike(r"[.?!:;\"')\]]\z") & ~short
