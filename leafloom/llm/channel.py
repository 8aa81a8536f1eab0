"""Problem 4, the channel: what the scanner may have read for a printed word, and how likely each is in its line.

Two counts over all texts come first: the words, all that occur LEAST times; and the word pairs around words that the
scanner's confusions turn into one another. From the words the rate of every confusion is estimated: how often a rare
form stands where a far more frequent word, one confusion away, is printed. A line is a lattice of edges over its tokens:
a token as it stands, a word it may be a misreading of, two tokens that are one printed word, one token that is two, a
number with letters in it, a word parted by a hyphen. Each edge has its channel probability and the probability of its
word after the word before; Viterbi gives the cheapest path over the whole line. What is found and what is repaired are
both read off that path.
"""

from __future__ import annotations

import atexit
import math
import os
import re
import shutil
import sqlite3
import tempfile
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled

#: Rarer words are unknown to the model, at any size of the corpus; the same for word pairs.
LEAST, PAIR_LEAST = 5, 2
#: Up to so many words and pairs are broadcast; beyond that, the workers look them up on disk.
MAX_WORDS, MAX_PAIRS = 200_000, 1_000_000
MEMO = 400_000
#: Prior odds that a form the corpus knows is a misreading of a word by a confusion of average rate: a form is taken for
#: one if the word is more than so many times as frequent.
KNOWN = 1 / 15
#: A form counts for the rate of a confusion if the word is so many times as frequent.
CLEAR = 50
#: Log probabilities of a spelling that no word has: any, one with a capital, one with signs inside that words don't have.
NO_WORD, NO_NAME, NO_SPELLING = -24.0, -18.5, -54.0
#: The rate of a confusion before anything is counted, and how many places that weighs.
RATE, RATE_WEIGHT = 2e-4, 100_000

# The confusions of scanners, read word part -> printed word part.
PLAIN = [("c", "e"), ("l", "t"), ("ri", "n"), ("rn", "m"), ("ii", "u"), ("b", "h"), ("in", "m"), ("vv", "w"), ("m", "rn"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("fl-", "fr")]
CAPITAL = [("F", "E"), ("C", "G"), ("O", "Q"), ("B", "R")]
ODD = {"0": "o", "1": "li", "5": "s", "9": "g", "8": "b", "6": "b", "!": "il", "|": "li", "à": "a"}
STRAY = ";!\\|"
FUSED = [("of in to and at by for on from that with was were", "the"), ("in von mit aus bei nach", "der dem"), ("de à dans sur", "la"), ("de en por con", "los las")]

_OUTER = ".,:;!?\"“”„«»()…—–‘’'>‹›*"
_MARKUP = set("<>{}=_/`@&%$^~[]#*")
_BAD_NUMBER = re.compile(r"^(?=.*\d)(?:[lIO](?=[\d.,lIO])|(?<=.)[lIOS](?=$|[\d.,lIO])|[\d.,])+$")
_ORDINAL = re.compile(r"^\d+(?:st|nd|rd|th|e|er|ère|o|a|d|h)$|^\d[\d\-]*[a-z]$")
_BAD_TIME = re.compile(r"(?<![\d.])\d{1,2} :\d{2}\b|(?<![\d.])\d{1,2}: \d{2}(?!\d)|\b0 \d/\d{2}/\d{4}\b")
_DIGITS = str.maketrans("lIOS", "1105")
_INITIALS = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]?$")
_SURNAME = re.compile(r"^(?:Mc|Mac|[A-Za-z]{1,2}['’])[A-ZÀ-Ý][a-zß-ÿ]+$")
_MIXED = re.compile(r"[a-zà-ÿ][A-Z]|^[A-Z]{2,}[a-zß-ÿ]")
#: Words after which a hyphen before a gap stands for a part left out.
SUSPENDED = ("and", "or", "und", "oder", "et", "ou", "y", "o")
MARKS = "-‐‑¬\xad"
INLINE = re.compile(r"([^\W\d_]+)([-‐‑¬\xad])\s+([^\W\d_]+)")


def clean(token: str) -> str:
    """A token without the punctuation around it; empty if it belongs to markup or has no letter."""
    w = token.strip(_OUTER)
    if not w or not any(map(str.isalpha, w)) or not _MARKUP.isdisjoint(w) or w[0] == "\\":
        return ""
    return w


def _bad_number(t: str) -> str:
    """The number of a token, without what stands around it, if it holds letters for digits."""
    w = clean(t)
    bare = w or t.strip(_OUTER + "$()")
    bad = len(bare) > 1 and any(c in "lIOS" for c in bare) and _BAD_NUMBER.match(bare) and not (w and _ORDINAL.match(w.lower()))
    return bare if bad else ""


class _Memo(dict):
    """A dictionary that works out what it lacks; emptied when it grows large."""

    def __init__(self, work):
        super().__init__()
        self.work = work

    def __missing__(self, key):
        if len(self) > MEMO:
            self.clear()
        got = self[key] = self.work(key)
        return got


class Shelf:
    """A read-only mapping from words or word pairs to numbers, in an SQLite file that each worker gets; it is sent by name.

    What was looked up last is kept in memory. A shelf of words that satisfy a condition serves as a set.
    """

    def __init__(self, name: str, query: str):
        self.name, self.query = name, query
        self.found = _Memo(self._look_up)
        self.con: sqlite3.Connection | None = None

    def __reduce__(self):
        return (Shelf, (self.name, self.query))

    def _look_up(self, key: str | tuple[str, str]) -> int | None:
        if self.con is None:
            self.con = sqlite3.connect(f"file:{SparkFiles.get(self.name)}?mode=ro&immutable=1", uri=True, check_same_thread=False)
        row = self.con.execute(self.query, key if isinstance(key, tuple) else (key,)).fetchone()
        return row[0] if row else None

    def get(self, key, default=None):
        got = self.found[key]
        return default if got is None else got

    def __contains__(self, key) -> bool:
        return self.found[key] is not None

    def begins(self, start: str) -> bool:
        """Does any word of the shelf begin so?"""
        self.found[start]
        return self.con is not None and self.con.execute("SELECT 1 FROM t WHERE word >= ? AND word < ? LIMIT 1", (start, start + "\U0010ffff")).fetchone() is not None

    @staticmethod
    def fill(table: DataFrame, columns: str, query: str) -> Shelf:
        """A shelf of the rows of a table, which pass through the driver in turns; the first columns are the key."""
        name = f"shelf-{uuid.uuid4().hex}.db"
        names = columns.split()
        d = tempfile.mkdtemp()  # Spark serves the file from here as long as the driver runs
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        con = sqlite3.connect(path := os.path.join(d, name))
        con.execute("PRAGMA journal_mode = OFF")
        con.execute(f"CREATE TABLE t ({', '.join(names)}, PRIMARY KEY ({', '.join(names[: query.count('?')])})) WITHOUT ROWID")
        con.executemany(f"INSERT INTO t VALUES ({', '.join('?' * len(names))})", (tuple(r) for r in table.select(*names).toLocalIterator()))
        con.commit()
        con.close()
        table.sparkSession.sparkContext.addFile(path)
        return Shelf(name, query)


@dataclass(frozen=True)
class Edge:
    """One step through the lattice of a line: tokens ``start`` to ``end`` are printed as ``text``."""

    start: int
    end: int
    text: str
    kind: str  # "misread", "break", or "compound", which keeps its hyphen and is no case


@dataclass
class Model:
    """Counts sent to the workers: dictionaries and sets, or shelves where they are large."""

    total: int
    words: dict[str, int] | Shelf  # folded
    lower: set[str] | Shelf = field(default_factory=set)  # words that mostly stand in lower case
    pairs: dict[tuple[str, str], int] | Shelf = field(default_factory=dict)
    tracked: set[str] | Shelf = field(default_factory=set)
    rates: dict[str, float] = field(default_factory=dict)  # of each confusion, per printed place

    def __post_init__(self):
        own = [self.rates[r] for r in (f"{a}>{b}" for a, b in PLAIN) if r in self.rates]
        self.mean_rate = sum(own) / len(own) if own else RATE
        self.in_order: list[str] | None = None
        self.fused = {}
        for left, right in FUSED:
            for a in left.split():
                for b in right.split():
                    # the pair is printed at most as often as its rarer word
                    odds = math.log(max(1, min(self.count(a), self.count(b))) / (20 * max(1, self.count(a + b))))
                    if odds > 0 or not self.count(a + b) and self.count(a) and self.count(b):
                        self.fused[a + b] = (len(a), max(odds, 0.5))
        self.candidates, self.state, self.folded = _Memo(self._candidates), _Memo(self._state), _Memo(lambda t: clean(t).lower())

    def __getstate__(self):
        return (self.total, self.words, self.lower, self.pairs, self.tracked, self.rates)

    def __setstate__(self, kept):
        self.total, self.words, self.lower, self.pairs, self.tracked, self.rates = kept
        self.__post_init__()

    def count(self, w: str) -> int:
        return self.words.get(w, 0)

    # ---- the channel --------------------------------------------------------------------------------------------------

    def rate(self, rule: str) -> float:
        return self.rates.get(rule, RATE)

    def channel(self, rule: str, known: bool) -> float:
        """Log probability that the scanner gave this form for the printed word.

        A form the corpus knows has gathered a count of its own, which holds its misreadings too; for it the prior odds
        stand, raised for a confusion that is commoner than most.
        """
        return math.log(min(KNOWN * 4, KNOWN * max(1.0, self.rate(rule) / self.mean_rate)) if known else self.rate(rule))

    def _candidates(self, w: str) -> list[tuple[str, float]]:
        """(printed word, log of the channel probability) for a read word; the word itself first. Candidates that the word
        counts alone rule out are left out, unless word pairs are known for them."""
        found, odd = self.raw_candidates(w)
        low = w.lower()
        if odd:
            return [(w, NO_SPELLING - self.log_word(low)), *((c, p) for c, (p, _) in found.items())]
        own = NO_NAME if w[:1].isupper() and not w.isupper() and not self.count(low) else self.log_word(low)
        kept = [(c, p) for c, (p, _) in found.items() if (low in self.tracked and c in self.tracked) or self.log_word(c) + p > own]
        return [(low, own - self.log_word(low)), *kept]

    def raw_candidates(self, w: str) -> tuple[dict[str, tuple[float, str]], bool]:
        """(printed word -> (log channel probability, confusion), is the spelling one that no word has?)."""
        low = w.lower()
        known = self.count(low)
        out: dict[str, tuple[float, str]] = {}
        odd = False
        digits = any(c.isdigit() for c in w)
        if any(c in w[1:-1] for c in STRAY):
            odd = True
            for c in STRAY:
                self._try(out, low.replace(c, ""), "stray", False)
        if (digits and not _ORDINAL.match(low) and sum(c.isalpha() for c in w) > 1) or (len(w) > 2 and any(c in "!|à" for c in low)):
            for o in self._spelt(low):
                if o != low and not any(c.isdigit() for c in o):
                    odd |= self._try(out, o, "odd", False) and known * 3 < self.count(o)
        if _MIXED.search(w) and not _SURNAME.match(w) and not w[:-1].isupper() and known >= LEAST:
            odd = True
            out[low] = (self.channel("case", False), "case")
        if not odd and len(low) >= 3 and not digits and not _INITIALS.match(low):
            for c, rule in self._one_edit(w):
                self._try(out, c, rule, known > 0)
            if len(low) == 3:
                out = {c: p for c, p in out.items() if self.count(c) > self.total * 1e-3}
            if not out and not known and w.islower() and len(low) > 6:  # two confusions in one word
                for c, first in self._one_edit(low):
                    for d, second in self._one_edit(c):
                        self._try(out, d, first, False, math.log(self.rate(second)))
        out.pop(low if not odd else "", None)
        return out, odd

    def _spelt(self, low: str) -> list[str]:
        """Spellings of a word in which odd signs are read as letters; only beginnings of known words are followed, so
        their number stays small without any being cut off."""
        options = [""]
        for c in low:
            options = [o + r for o in options for r in ((c + ODD[c]) if c in "à!|" else ODD.get(c, c))]
            options = [o for o in options if self.begins_word(o)]
        return options

    def begins_word(self, start: str) -> bool:
        if isinstance(self.words, Shelf):
            return self.words.begins(start)
        if self.in_order is None:
            self.in_order = sorted(self.words)
        k = bisect_left(self.in_order, start)
        return k < len(self.in_order) and self.in_order[k].startswith(start)

    def _one_edit(self, w: str) -> Iterator[tuple[str, str]]:
        """(word with one confusion undone, confusion)."""
        low = w.lower()
        table, first = list(PLAIN), []
        if w.isupper():
            table += [(a.lower(), b.lower()) for a, b in CAPITAL]
        elif w[0].isupper() and len(low) > 3:
            first = [(a.lower(), b.lower()) for a, b in CAPITAL if a == w[0]]
        for a, b in table:
            k = low.find(a)
            while k >= 0:
                yield low[:k] + b + low[k + len(a) :], f"{a}>{b}"
                k = low.find(a, k + 1)
        for a, b in first:
            yield b + low[1:], f"{a}>{b}"

    def _try(self, out: dict[str, tuple[float, str]], c: str, rule: str, known: bool, extra: float = 0.0) -> bool:
        if c and self.count(c) >= LEAST:
            p = self.channel(rule, known) + extra
            if c not in out or p > out[c][0]:
                out[c] = (p, rule)
            return True
        return False

    def _state(self, t: str) -> bool:
        """Has a token another edge than itself?"""
        if _bad_number(t):
            return True
        w = clean(t)
        return bool(w) and (len(self.candidates[w]) > 1 or w.lower() in self.fused)

    def log_word(self, w: str) -> float:
        """Log probability of a word; an unknown one gets that of some word spelt so."""
        n = self.count(w)
        return math.log(n / self.total) if n else NO_WORD

    def log_after(self, before: str, w: str) -> float:
        if before and (w in self.tracked or before in self.tracked):
            n, smooth = self.count(before), 20.0
            if n:
                return math.log((self.pairs.get((before, w), 0) + smooth * math.exp(self.log_word(w))) / (n + smooth))
        return self.log_word(w)

    def joins(self, a: str, b: str, tail: str, mark: str) -> bool:
        """Do the parts of a divided word belong together without the mark?"""
        x, y = a.lower(), b.lower()
        joined, compound = self.count(x + y), self.count(f"{x}-{y}{tail or ''}") + self.count(f"{x}-{y}")
        if joined or compound:
            return joined >= compound
        if not b[0].islower():
            return False
        return mark != "-" or not (self.count(x) > LEAST and self.count(y) > LEAST)

    def glue_odds(self, a: str, b: str) -> float:
        """Log odds that two tokens are one printed word with a space in it; the pair is printed at most as often as its
        rarer word."""
        x, y = self.folded[a], self.folded[b]
        w = x + y
        if not x or not y or a[-1:] in ".,;:!?" or b[:1].isupper() or len(w) < 4 or not w.isalpha() or (n := self.count(w)) < LEAST:
            return -1.0
        if len(x) == 1 and x in "aoyeàé" and self.count(y) > 0:
            return -1.0
        return math.log(n / (8 * max(0.5, min(self.count(x), self.count(y)))))

    # ---- the lattice --------------------------------------------------------------------------------------------------

    def glued(self, tokens: list[str]) -> dict[int, float]:
        """First token -> log odds, of the pairs of tokens that are likelier one word."""
        words, out = [self.folded[t] for t in tokens], {}
        known = self.words
        for k, (x, y) in enumerate(zip(words, words[1:])):
            if x and y and x + y in known and (odds := self.glue_odds(tokens[k], tokens[k + 1])) > 0:
                out[k] = odds
        return out

    def decode(self, tokens: list[str], kept: frozenset[int] | set[int] = frozenset()) -> list[Edge]:
        """What changes on the likeliest printed line, by Viterbi over the whole lattice; tokens in ``kept`` stand as they are.

        A token that has no other edge adds the same to every path that comes to it by one word, so nothing is reckoned for it
        there; only where paths part is their cost needed.
        """
        state, folded = self.state, self.folded
        open_at = [state[t] for t in tokens]
        glued = self.glued(tokens)
        parted = self._parted(tokens, kept) if any(t[-1] in MARKS for t in tokens) else {}
        if not glued and not parted and not any(open_at):
            return []
        kept = set(kept) | {k + d for k in parted for d in (0, 1)}
        n = len(tokens)
        at: list[dict[str, tuple[float, tuple | None]] | None] = [None] * (n + 1)
        at[0] = {"": (0.0, None)}

        def reach(k: int, last: str, score: float, back: tuple | None) -> None:
            here = at[k]
            if here is None:
                at[k] = {last: (score, back)}
            elif last not in here or score > here[last][0]:
                here[last] = (score, back)

        for k, t in enumerate(tokens):
            here = at[k]
            if here is None:
                continue
            low = folded[t]
            if k in parted or k in kept or not low:
                score, back = max(here.values(), key=_cost)
                if k in parted:
                    text, kind = parted[k]
                    reach(k + 2, "", score, (back, Edge(k, k + 2, text, kind)) if kind else back)
                    continue
                bad = _bad_number(t) if open_at[k] and k not in kept else ""
                reach(k + 1, "", score, (back, Edge(k, k + 1, t.replace(bad, bad.translate(_DIGITS), 1), "misread")) if bad else back)
                continue
            glue = glued.get(k) if k + 1 not in kept else None
            if not open_at[k] and glue is None:
                if len(here) == 1 and at[k + 1] is None:
                    at[k + 1] = {low: next(iter(here.values()))}
                else:
                    for last, (score, back) in here.items():
                        reach(k + 1, low, score + self.log_after(last, low), back)
                continue
            if open_at[k] and (bad := _bad_number(t)):
                score, back = max(here.values(), key=_cost)
                reach(k + 1, "", score, (back, Edge(k, k + 1, t.replace(bad, bad.translate(_DIGITS), 1), "misread")))
                continue
            w = clean(t)
            options, split = self.candidates[w], self.fused.get(low)
            counts_decide = len(options) > 1 and low not in self.tracked  # a misread form has pairs of its own
            for last, (score, back) in here.items():
                for rank, (c, channel) in enumerate(options):
                    word = c.lower()
                    cost = score + (self.log_word(word) if counts_decide else self.log_after(last, word)) + channel
                    reach(k + 1, word, cost, (back, Edge(k, k + 1, t.replace(w, recased(w, c), 1), "misread")) if rank else back)
                as_read = score + self.log_after(last, low) + options[0][1]
                if glue is not None:
                    y = folded[tokens[k + 1]]
                    reach(k + 2, low + y, as_read + self.log_after(low, y) + self.candidates[clean(tokens[k + 1])][0][1] + glue, (back, Edge(k, k + 2, t + tokens[k + 1], "misread")))
                if split:
                    m, odds = split
                    reach(k + 1, low[m:], as_read + odds, (back, Edge(k, k + 1, t.replace(w, f"{w[:m]} {w[m:]}", 1), "misread")))
        path, step = [], max(at[n].values(), key=_cost)[1]
        while step is not None:
            step, edge = step
            path.append(edge)
        return path[::-1]

    def _parted(self, tokens: list[str], kept) -> dict[int, tuple[str, str]]:
        """First token -> (printed text, kind) of the words that a hyphen and a gap part inside the line."""
        out: dict[int, tuple[str, str]] = {}
        for k, (a, b) in enumerate(zip(tokens, tokens[1:])):
            if a[-1] in MARKS and k - 1 not in out and not {k, k + 1} & set(kept) and (m := INLINE.search(f"{a} {b}")) and m.end(2) == len(a):
                if m[3] in SUSPENDED:
                    continue
                if self.joins(m[1], m[3], "", m[2]):
                    out[k] = (a[:-1] + b, "break")
                else:
                    compound = self.count(f"{m[1]}-{m[3]}".lower())
                    out[k] = (f"{a[:-1]}-{b}", "compound") if compound else (f"{a} {b}", "")
        return out


def _cost(path: tuple[float, tuple | None]) -> float:
    return path[0]


def recased(read: str, printed: str) -> str:
    """A folded printed word in the case of the read one; what both share stays as read."""
    low = read.lower()
    if read.isupper():
        return printed.upper()
    if len(low) != len(read) or (_MIXED.search(read) and not _SURNAME.match(read)):
        return printed.capitalize() if read[0].isupper() and not read[1:2].isupper() else printed
    a = b = 0
    while a < min(len(low), len(printed)) and low[a] == printed[a]:
        a += 1
    while b < min(len(low), len(printed)) - a and low[-1 - b] == printed[-1 - b]:
        b += 1
    middle = printed[a : len(printed) - b]
    return read[:a] + (middle[:1].upper() + middle[1:] if not a and read[0].isupper() else middle) + read[len(read) - b :]


def corrected(model: Model, line: str, *, kept_first: bool = False, kept_last: bool = False) -> tuple[str, set[str]]:
    """(the line as printed, kinds of the cases in it): every case that is told is put right, and nothing else is changed.

    kept_first, kept_last: the line begins or ends with a part of a divided word, which is judged with its other part.
    """
    kinds: set[str] = set()
    if (" :" in line or ": " in line or "/" in line) and _BAD_TIME.search(line):
        line = _BAD_TIME.sub(lambda m: m[0].replace(" ", ""), line)
        kinds.add("misread")
    tokens = line.split()
    if not tokens:
        return line, kinds
    path = model.decode(tokens, ({0} if kept_first else set()) | ({len(tokens) - 1} if kept_last else set()))
    if not path:
        return line, kinds
    places = [m.span() for m in re.finditer(r"\S+", line)]
    for e in reversed(path):
        kinds.add(e.kind)
        line = line[: places[e.start][0]] + e.text + line[places[e.end - 1][1] :]
    return line, kinds - {"compound"}


def misread_at(model: Model, tokens: list[str], k: int) -> bool:
    """Is token k of a line misread?"""
    return any(e.kind == "misread" and e.start <= k < e.end for e in model.decode(tokens))


# ---- counts over the corpus ------------------------------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n, lower): the words of all texts (text), folded, and how often each stands in lower case; the empty word has
    the number of all words."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw: Counter = Counter()
        for pdf in rows:
            for t in pdf.text:
                raw.update(t.split())
            if len(raw) > MEMO:
                yield _counted(raw)
                raw = Counter()
        yield _counted(raw)

    return texts.mapInPandas(run, "word string, n long, lower long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("lower").alias("lower"))


def _counted(raw: Counter) -> pd.DataFrame:
    total: dict[str, list[int]] = {"": [0, 0]}
    for t, n in raw.items():
        if t[-1] in MARKS:
            continue
        if w := clean(t):
            c = total.setdefault(w.lower(), [0, 0])
            c[0] += n
            c[1] += n * w.islower()
            total[""][0] += n
    return pd.DataFrame([(w, *c) for w, c in total.items()], columns=["word", "n", "lower"])


def pair_counts(texts: DataFrame, tracked: set[str] | Shelf) -> DataFrame:
    """(a, b, n): pairs of successive words of which one is tracked."""
    sent = texts.sparkSession.sparkContext.broadcast(tracked)

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        track, out, memo = sent.value, Counter(), _Memo(lambda t: clean(t).lower())
        for pdf in rows:
            for text in pdf.text:
                words = [memo[t] for t in text.split()]
                places = [k for k, w in enumerate(words) if w in track]
                if places:
                    words.append("")
                    out.update((words[k - 1], words[k]) for k in places if k)
                    out.update((words[k], words[k + 1]) for k in places if words[k + 1] not in track)
            if len(out) > MEMO:
                yield pd.DataFrame([(a, b, n) for (a, b), n in out.items() if a and b], columns=["a", "b", "n"])
                out = Counter()
        yield pd.DataFrame([(a, b, n) for (a, b), n in out.items() if a and b], columns=["a", "b", "n"])

    return texts.mapInPandas(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def confusion_rates(counts: DataFrame, model: Model) -> dict[str, float]:
    """The rate of each confusion per printed place: forms one confusion away from a word that is CLEAR times as frequent
    are its misreadings; the places are where the printed part stands in known words. Counted where the words lie."""
    sent = counts.sparkSession.sparkContext.broadcast(model)
    parts = {f"{a}>{b}": b for a, b in PLAIN}

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, hits, places = sent.value, Counter(), Counter()
        for pdf in rows:
            for w, n in zip(pdf.word, pdf.n):
                if m.count(w) >= LEAST:
                    for rule, part in parts.items():
                        places[rule] += n * w.count(part)
                    for rule in ("odd", "stray"):
                        places[rule] += n * len(w)
                best = max(((m.count(c), rule) for c, (_, rule) in m.raw_candidates(w)[0].items()), default=None)
                if best and best[0] >= CLEAR * n:
                    hits[best[1]] += n
        yield pd.DataFrame([(r, hits[r], places[r]) for r in places | hits], columns=["rule", "hits", "places"])

    got = counts.filter("word <> ''").select("word", "n").mapInPandas(run, "rule string, hits long, places long").groupBy("rule").agg(F.sum("hits").alias("hits"), F.sum("places").alias("places")).collect()
    return {r.rule: (r.hits + RATE * RATE_WEIGHT) / (r.places + RATE_WEIGHT) for r in got}


def confusable(model: Model, words: Iterable[str]) -> set[str]:
    """Those of the words, and those they may stand for, that word counts alone can't tell apart."""
    out: set[str] = set()
    for w in words:
        if w.isalpha() and len(w) >= 3:
            for c, (p, _) in model.raw_candidates(w)[0].items():
                if c in model.lower and 1 / 200 < model.count(c) * math.exp(p) / model.count(w) < 20:
                    out |= {w, c}
    return out


def learn(texts: DataFrame, *, max_words: int = MAX_WORDS, max_pairs: int = MAX_PAIRS) -> Model:
    """The model of all texts (text): two passes of counting. Up to ``max_words`` and ``max_pairs`` go to the workers in
    memory, more of them on shelves."""
    texts = texts.filter(F.length("text") > 0).select("text")
    counts = settled(word_counts(texts))
    total = counts.filter("word = ''").agg(F.sum("n")).first()[0]
    if not total:
        return Model(1, {})
    known = counts.filter((F.col("n") >= LEAST) & (F.col("word") != ""))
    kept = known.limit(max_words + 1).toPandas()
    if len(kept) <= max_words:
        model = Model(int(total), dict(zip(kept.word, kept.n.astype(int))), set(kept.word[kept.lower * 2 > kept.n]))
    else:
        del kept
        shelf = Shelf.fill(known, "word n lower", "SELECT n FROM t WHERE word = ?")
        model = Model(int(total), shelf, Shelf(shelf.name, "SELECT n FROM t WHERE word = ? AND lower * 2 > n"))
    model = Model(model.total, model.words, model.lower, rates=confusion_rates(counts, model))
    tracked = _confusable_words(known.filter("lower * 2 > n").select("word"), model)
    first = [r.word for r in tracked.limit(max_words + 1).collect()]
    model.tracked = set(first) if len(first) <= max_words else Shelf.fill(tracked, "word n", "SELECT n FROM t WHERE word = ?")
    if isinstance(model.tracked, Shelf) or model.tracked:
        pairs = pair_counts(texts, model.tracked).filter(F.col("n") >= PAIR_LEAST)
        first = pairs.limit(max_pairs + 1).toPandas()
        if len(first) <= max_pairs:
            model.pairs = dict(zip(zip(first.a, first.b), first.n.astype(int)))
        else:
            model.pairs = Shelf.fill(pairs, "a b n", "SELECT n FROM t WHERE a = ? AND b = ?")
    return Model(model.total, model.words, model.lower, model.pairs, model.tracked, model.rates)


def _confusable_words(words: DataFrame, model: Model) -> DataFrame:
    """(word, n): the confusable words, found where the words lie."""
    sent = words.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            yield pd.DataFrame({"word": sorted(confusable(sent.value, pdf.word))}, dtype=object)

    return words.mapInPandas(run, "word string").distinct().withColumn("n", F.lit(1))
