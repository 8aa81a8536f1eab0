"""Problem 8: pages made of repeated keywords, runs of links, or lists of tags and products.

Every text is cut into segments, and each segment is judged by itself, so that the share of stuffed characters of a page
can be measured. The evidence is the regularity of term recurrence: in each page the gaps between the occurrences of a
term, and the autocorrelation of the sequence of terms over a window of lags. Written language repeats a pair of content
words rarely and at irregular distances; keyword lists repeat all of theirs, at short and even ones. Over all pages this
gives each term two counts, the pages that hold it and the pages in which it recurs unnaturally; the terms that mostly
recur so are search keywords wherever they stand. Lists of many nouns without function words, runs of links and tags are
the other signs. A logistic model, fitted on a bounded sample of the labelled pages, weighs the signs of a segment.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, slices

#: Most labelled pages that are read for the fit, chosen by a hash of their key.
SAMPLE = 4000
#: Lags of the autocorrelation, in terms.
LAGS = 40
#: A term recurs unnaturally in a page that has it this often, at a median gap of at most so many terms.
MIN_COUNT, MAX_GAP = 3, 14
#: A term is a keyword if it recurs so in at least this many pages, and either in this share of all pages that hold it, or
#: in these shares of them and of the pages that hold it more than once.
MIN_PAGES, MIN_RATIO, MIN_RATIO_ONCE, MIN_RATIO_TWICE = 3, 0.4, 0.25, 0.5
#: Most keywords sent to the workers at once; beyond it they are joined to the pages instead.
MAX_BROADCAST = 200_000
# Frequent function words of English, German, French and Spanish. Those of other languages are counted.
FUNCTION = frozenset(
    "a about after all although ve ll re nt isn don an and any anyone are as at be because been before between both but by could did do for from had has have he her his how i if in into is it its "
    "more most my no nor not of on one only or our out over said she since so than that the their them then there they this though to under until was we were what when which while who why with without would you your "
    "aber als am an auch auf aus bei bis dass das dem den der des die durch ein eine einem einen einer es für hat hatte im in ist mit nach nicht noch nur oder seit sich sie sind so über um und unter von vor war was weil wenn wer wie wurde zu zum zur "
    "au aux avec ce cette comme dans de des depuis du elle en est et était il la le les leur lui mais ne nous on ou où par pas plus pour puis qu que qui sa sans se ses si son sous sur un une "
    "al como con cuando de del desde el ella en entre era es esta este fue ha había la las le lo los más mientras ni no nos para pero por porque pues que quién se según ser si sin sobre su sus también un una y ya".split()
)
#: A word of another language counts as a function word if it stands in this share of the language's texts, of which there
#: must be so many.
COMMON, MIN_TEXTS = 0.3, 30
#: Signs that are written with the letter before them; a word goes on over them.
_COMBINED = "".join(chr(c) for c in range(0x300, 0x10000) if unicodedata.category(chr(c)) in ("Mn", "Mc"))
_SEGMENT = re.compile(r"[^\n]+?(?:[.!?](?=\s)|[。！？؟।](?:[”」])?|(?=\n)|$)|[^\n]+")
_LINK = re.compile(r"https?://\S+|www\.\S+|<a\b[^<>]*>|</a>", re.I)
_WORD = re.compile(rf"#?[^\W_]+(?:[{_COMBINED}]+[^\W_]*)*(?:['’][^\W_]+)?")
_SHORTENED = re.compile(r"['’](?:d|ll|m|re|s|t|ve)$")
_FIELD = re.compile(r"\s*[|/»›·•;,]\s+")
_FIELD_SIGN = re.compile(r"[|/»›·•;,]\s")

FEATURES = ["bias", "keyword", "keyword_high", "recurrent", "even_gaps", "correlated", "function", "linked", "tagged", "fields", "short_fields", "dense_list", "recurrent_nouns"]

Segment = tuple[str, list[str], list[tuple[str, int, int]]]


class Words:
    """What kind of word each is, remembered: 0 a function word or none that tells anything, 1 a content word, 2 one that
    is a term by itself (a tag, or a clause of a script without spaces)."""

    def __init__(self, function: frozenset[str] | set[str] = frozenset()):
        self.function = FUNCTION | function
        self.kinds: dict[str, int] = {}

    def __getstate__(self):
        return self.function

    def __setstate__(self, function):
        self.function, self.kinds = function, {}

    def kind(self, w: str) -> int:
        if len(self.kinds) > 500_000:
            self.kinds.clear()
        if w in self.function or w.isdigit() or len(w) < 2 or _SHORTENED.search(w):
            k = 0
        else:
            k = 2 if w[0] == "#" or w > "⺀" else 1
        self.kinds[w] = k
        return k


def parsed(text: str, known: Words) -> list[Segment]:
    """(segment, words, terms) of a text. A term is a pair of different content words that follow each other but for function
    words, a tag, or a clause of a script without spaces; it comes with the places of its first and last word."""
    out = []
    linked = "://" in text or "www." in text.lower() or "<" in text
    kinds, kind = known.kinds, known.kind
    for s in _SEGMENT.findall(text):
        if s.isspace():
            continue
        words = _WORD.findall((_LINK.sub(" ", s) if linked else s).lower())
        terms = []
        last, at, alone = "", 0, False
        for i, w in enumerate(words):
            k = kinds.get(w)
            if k is None:
                k = kind(w)
            if k:
                if last and last != w:
                    terms.append((f"{last} {w}", at, i))
                if k == 2:
                    terms.append((w, i, i))
                    alone = True
                last, at = w, i
        if alone:  # pairs come in order by themselves
            terms.sort(key=_place)
        out.append((s, words, terms))
    return out


def _place(term: tuple[str, int, int]) -> tuple[int, int]:
    return term[1], -term[2]


def page_terms(text: str, known: Words | None = None) -> dict[str, tuple[bool, bool]]:
    """The terms of a page, and whether each comes more than once, and whether it recurs unnaturally: often, at short gaps."""
    places: dict[str, list[int]] = {}
    k = 0
    for _, _, terms in parsed(text, known or Words()):
        for t, _, _ in terms:
            if t in places:
                places[t].append(k)
            else:
                places[t] = [k]
            k += 1
    return {t: (len(at) > 1, len(at) >= MIN_COUNT and _median_gap(at) <= MAX_GAP) for t, at in places.items()}


def _median_gap(at: list[int]) -> float:
    gaps = sorted(b - a for a, b in zip(at, at[1:]))
    m = len(gaps) // 2
    return gaps[m] if len(gaps) % 2 else (gaps[m - 1] + gaps[m]) / 2


def segment_signs(text: str, keywords, known: Words | None = None, cut: list[Segment] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signs, sizes): a row of FEATURES and the number of characters for each segment of the text, or of ``cut``, if it has
    been parsed before."""
    known = known or Words()
    cut = parsed(text, known) if cut is None else cut
    places: dict[str, list[int]] = {}
    length = 0
    for _, _, terms in cut:
        for t, _, _ in terms:
            if t in places:
                places[t].append(length)
            else:
                places[t] = [length]
            length += 1
    often, even, correlated = [0.0] * length, [0.0] * length, [0.0] * length
    for at in places.values():
        n = len(at)
        if n > 1:
            # positional autocorrelation: at how many lags of the window the term is met again
            low = high = 0
            for k in at:
                while at[low] < k - LAGS:
                    low += 1
                while high < n and at[high] <= k + LAGS:
                    high += 1
                correlated[k] = min(6, high - low - 1)
            if n >= MIN_COUNT:
                gaps = [b - a for a, b in zip(at, at[1:])]
                mean = sum(gaps) / len(gaps)
                spread = math.sqrt(sum((g - mean) ** 2 for g in gaps) / len(gaps))
                evenness = sum(g <= LAGS for g in gaps) / len(gaps) / (1 + spread / (mean + 1))
                for k in at:
                    often[k], even[k] = 1.0, evenness
    rows, sizes, k = [], [], 0
    hot = list(itertools.accumulate((c > 0 for c in correlated), initial=0))
    function = known.function
    linked_text = "://" in text or "www." in text.lower() or "<" in text
    for s, words, terms in cut:
        n, body = len(terms), s.strip()
        recurrent = evenness = correlation = 0.0
        if n and (hot[k + n] > hot[k] or any(often[k : k + n])):
            recurrent, evenness, correlation = sum(often[k : k + n]) / n, sum(even[k : k + n]) / n, sum(correlated[k : k + n]) / n
        k += n
        covered: set[int] = set()
        for t, i, j in terms:
            if t in keywords:
                covered.update(range(i, j + 1))
        keyword = 0.0
        if covered:
            lettered = [w.isalpha() or w[0] == "#" or "'" in w or "’" in w for w in words]
            keyword = sum(lettered[i] for i in covered) / sum(lettered) if any(lettered) else 0.0
        many_words = max(1, len(words))
        func = sum([w in function for w in words]) / many_words
        many = short = 0.0
        if _FIELD_SIGN.search(body):
            fields = [f for f in _FIELD.split(body) if f]
            many = min(len(fields), 12) / 12
            short = sum(len(f.split()) <= 4 for f in fields) / max(1, len(fields)) * many
        else:
            many, short = 1 / 12, (1 / 12 if len(body.split()) <= 4 else 0.0)
        rows.append(
            [
                1.0,
                keyword,
                float(keyword >= 0.3),
                recurrent,
                evenness,
                correlation / 6,
                min(func, 0.6),
                min(1.0, sum(len(m[0]) for m in _LINK.finditer(s)) / len(body) * 2) if linked_text else 0.0,
                sum(w[0] == "#" for w in words) / many_words if "#" in s else 0.0,
                many,
                short,
                float(len(words) >= 8 and func < 0.08),
                recurrent * (1 - min(1.0, func * 2.5)),
            ]
        )
        sizes.append(len(body))
    return np.array(rows, float).reshape(-1, len(FEATURES)), np.array(sizes, float)


def _most_stuffed(text: str, cut: list[Segment], weights: np.ndarray, keywords) -> float:
    """An upper bound of the stuffed share of a page, without working out any sign.

    A segment without a keyword, a term that comes again, a link or a tag has only the signs of its words' kinds and fields;
    where the weights of these can't outweigh the bias, such segments are never stuffed.
    """
    most = dict(zip(FEATURES, weights.tolist()))
    if most["bias"] + sum(max(0.0, most[f]) for f in ("function", "fields", "short_fields", "dense_list")) > 0:
        return 1.0
    counts = Counter([t for _, _, terms in cut for t, _, _ in terms])
    marked = "#" in text or "://" in text or "<" in text or "www." in text.lower()
    some = every = 0
    for s, _, terms in cut:
        n = len(s.strip())
        every += n
        if (marked and ("#" in s or _LINK.search(s))) or any(counts[t] > 1 or t in keywords for t, _, _ in terms):
            some += n
    return some / every if every else 0.0


def stuffed_share(text: str, weights: np.ndarray, keywords, known: Words | None = None, *, over: float = 0.0) -> float:
    """Share of the characters that stand in stuffed segments; 0 for an empty or blank text, and for one whose share can't be
    larger than ``over``."""
    cut = parsed(text, known := known or Words())
    if _most_stuffed(text, cut, weights, keywords) <= over:
        return 0.0
    signs, sizes = segment_signs(text, keywords, known, cut)
    if not len(sizes):
        return 0.0
    return float(sizes[signs @ weights > 0].sum() / sizes.sum())


#: Weights where no labels are at hand, in the order of FEATURES.
DEFAULT = np.array([-3.0, 5.0, 1.5, 0.5, 0.5, 0.5, -2.0, 3.0, 4.0, 0.3, 0.5, 0.3, 0.5])


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, *, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - ridge * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(texts: list[str], spam: list[bool], keywords, known: Words | None = None) -> np.ndarray:
    """Weights of the signs. A page's label holds for most of its characters only, so the segments of spam pages that
    look like writing are turned over in a few rounds, the most likely half always staying."""
    xs, ys, ws, docs = [], [], [], []
    for k, (t, y) in enumerate(zip(texts, spam)):
        signs, sizes = segment_signs(t, keywords, known)
        if len(sizes):
            xs.append(signs)
            ys.append(np.full(len(sizes), float(y)))
            ws.append(sizes / sizes.sum())
            docs.append(np.full(len(sizes), k))
    if not xs:
        return DEFAULT
    x, y0, w, doc = np.concatenate(xs), np.concatenate(ys), np.concatenate(ws), np.concatenate(docs)
    beta = DEFAULT
    for _ in range(8):
        score = x @ beta
        share = np.bincount(doc, w * (score > 0), len(texts))
        # a few labels are wrong: a page that contradicts its label altogether is left out of the fit
        trusted = np.where(np.bincount(doc, y0, len(texts)) > 0, share > 0.1, share < 0.9)[doc]
        y = y0.copy()
        for k in np.unique(doc[(y0 > 0) & trusted]):
            mine = np.flatnonzero(doc == k)
            order = mine[np.argsort(-score[mine], kind="stable")]
            before = np.cumsum(w[order]) - w[order]
            y[order[(before >= 0.5) & (score[order] <= 0)]] = 0.0
        if not (y[trusted] > 0).any() or (y[trusted] > 0).all():
            return DEFAULT
        v = w * trusted
        v = v * np.where(y > 0, 0.5 / v[y > 0].sum(), 0.5 / v[y == 0].sum()) * len(texts)
        beta = _logistic(x, y, v)
    return beta


def _chosen(labels: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` labelled pages, by a hash of their key; of several labels of a page one."""
    labels = labels.filter(F.col("label").isin("spam", "ok")).groupBy("doc_id").agg(F.max("label").alias("label"))
    return labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit_labels(docs: DataFrame, labels: DataFrame, keywords, known: Words | None = None, *, sample: int = SAMPLE) -> np.ndarray:
    """Fit on at most ``sample`` labelled pages. docs: doc_id, text; labels: doc_id, label (``spam`` or ``ok``)."""
    got = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(_chosen(labels, sample)), "doc_id").select("text", "label").collect()
    got = sorted((r.text, r.label == "spam") for r in got)
    if len({y for _, y in got}) < 2:
        return DEFAULT
    return fit([t for t, _ in got], [y for _, y in got], keywords, known)


def function_words(docs: DataFrame) -> frozenset[str]:
    """Function words of the languages that FUNCTION doesn't hold, by document frequency; docs: text, lang.

    A language has at most 1 / COMMON times as many of them as an average text of it has words.
    """

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: Counter = Counter()
        for pdf in slices(rows):
            for lang, text in zip(pdf.lang, pdf.text):
                count[lang, ""] += 1
                count.update((lang, w) for w in set(_WORD.findall(text.lower())))
            if len(count) > 500_000:
                yield _with_languages(count)
                count = Counter()
        yield _with_languages(count)

    texts = docs.filter((F.length("text") > 0) & F.col("lang").isNotNull() & ~F.col("lang").isin("en", "de", "fr", "es", "und")).select("lang", "text")
    counted = texts.mapInPandas(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    totals = settled(counted)
    size = totals.filter((F.col("word") == "") & (F.col("n") >= MIN_TEXTS)).select("lang", F.col("n").alias("total"))
    common = totals.filter("word <> ''").join(F.broadcast(size), "lang").filter(F.col("n") >= F.col("total") * F.lit(COMMON))
    return frozenset(r.word for r in common.select("word").distinct().collect())


def _with_languages(count: Counter) -> pd.DataFrame:
    return pd.DataFrame([(lang, w, n) for (lang, w), n in count.items()], columns=["lang", "word", "n"])


def without_copies(docs: DataFrame, *, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs (doc_id, text) with one of each group of equal texts. Only hashes and keys are moved to tell the copies; the
    keys of the groups are broadcast, and beyond ``max_broadcast`` groups the copies are taken out by their keys."""
    h = [F.xxhash64("text").alias("h1"), F.hash("text").alias("h2")]
    groups = settled(docs.select("doc_id", *h).groupBy("h1", "h2").agg(F.min("doc_id").alias("keep"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    if groups.count() <= max_broadcast:
        return docs.select("*", *h).join(F.broadcast(groups), ["h1", "h2"], "left").filter(F.col("keep").isNull() | (F.col("doc_id") == F.col("keep"))).drop("h1", "h2", "keep")
    copies = docs.select("doc_id", *h).join(groups, ["h1", "h2"]).filter(F.col("doc_id") != F.col("keep")).select("doc_id")
    return docs.join(copies, "doc_id", "left_anti")


def keyword_terms(docs: DataFrame, known: Words | None = None) -> DataFrame:
    """(term, pages, twice, recurring): the search keywords of all pages, from the recurrence of every term in every page.

    Equal texts count once, else a page copied often would make keywords of its own words.
    """
    sent = docs.sparkSession.sparkContext.broadcast(known or Words())

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, list[int]] = {}
        for pdf in slices(rows):
            for text in pdf.text:
                for t, (twice, unnatural) in page_terms(text, sent.value).items():
                    c = total.get(t)
                    if c is None:
                        c = total[t] = [0, 0, 0]
                    c[0] += 1
                    c[1] += twice
                    c[2] += unnatural
            if len(total) > 500_000:
                yield pd.DataFrame([(t, *c) for t, c in total.items()], columns=["term", "pages", "twice", "recurring"])
                total = {}
        yield pd.DataFrame([(t, *c) for t, c in total.items()], columns=["term", "pages", "twice", "recurring"])

    texts = without_copies(docs.filter(F.length("text") > 0)).select("text")
    counted = texts.mapInPandas(run, "term string, pages long, twice long, recurring long")
    counted = counted.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("pages", "twice", "recurring")))
    r = F.col("recurring")
    often = (r >= F.col("pages") * F.lit(MIN_RATIO)) | ((r >= F.col("pages") * F.lit(MIN_RATIO_ONCE)) & (r >= F.col("twice") * F.lit(MIN_RATIO_TWICE)))
    return counted.filter((r >= MIN_PAGES) & often)


def stuffed_pages(docs: DataFrame, labels: DataFrame, *, share: float = 0.5, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, share) of the pages of which more than ``share`` of the characters are stuffed.

    docs: doc_id, text[, lang]; labels: doc_id, label. Null, empty and blank texts are no such pages; a share of exactly the
    threshold is none; repeated rows come out as often as they came in; without labels of both kinds, fixed weights hold.
    """
    known = Words(function_words(docs) if "lang" in docs.columns else frozenset())
    docs = docs.select("doc_id", "text")
    terms = settled(keyword_terms(docs, known).select("term"))
    first = [r.term for r in terms.limit(max_broadcast + 1).collect()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.filter(F.col("text").isNotNull())
    if len(first) <= max_broadcast:
        keywords = frozenset(first)
        weights = fit_labels(docs, labels, keywords, known)
        sent = docs.sparkSession.sparkContext.broadcast((keywords, weights, known))

        def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keys, w, words = sent.value
            for pdf in slices(rows):
                got = pdf.text.map(lambda t: stuffed_share(t, w, keys, words, over=share)).astype(float)
                yield pd.DataFrame({"doc_id": pdf.doc_id[got > share], "share": got[got > share]})

        return texts.mapInPandas(run, f"doc_id {kind}, share double")
    return _stuffed_by_join(texts, labels, terms, kind, share, known)


def _stuffed_by_join(texts: DataFrame, labels: DataFrame, terms: DataFrame, kind: str, share: float, known: Words) -> DataFrame:
    """The same where the keywords are too many to send: each page gets its own keywords by a join on the term."""
    sent = texts.sparkSession.sparkContext.broadcast(known)

    def listed(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(rows):
            yield pd.DataFrame([(h, t) for h, x in zip(pdf.h, pdf.text) for t in page_terms(x, sent.value)], columns=["h", "term"])

    hashed = texts.withColumn("h", F.concat_ws(":", F.xxhash64("text").cast("string"), F.hash("text").cast("string")))
    own = hashed.select("h", "text").mapInPandas(listed, "h string, term string").distinct().join(terms, "term").groupBy("h").agg(F.collect_list("term").alias("known"))
    joined = hashed.join(own, "h", "left").select("doc_id", "text", F.coalesce("known", F.array()).alias("known"))
    got = sorted((r.text, r.label == "spam", tuple(r.known)) for r in joined.join(F.broadcast(_chosen(labels, SAMPLE)), "doc_id").collect())
    weights = fit([t for t, _, _ in got], [y for _, y, _ in got], frozenset(k for _, _, ks in got for k in ks), known) if len({y for _, y, _ in got}) == 2 else DEFAULT

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(rows):
            shares = pd.Series([stuffed_share(t, weights, set(k), sent.value, over=share) for t, k in zip(pdf.text, pdf.known)], index=pdf.index, dtype=float)
            yield pd.DataFrame({"doc_id": pdf.doc_id[shares > share], "share": shares[shares > share]})

    return joined.mapInPandas(run, f"doc_id {kind}, share double")
