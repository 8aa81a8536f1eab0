"""Problem 7: held-out passages in the corpus, by latent semantic retrieval and an exact alignment.

Windows of the passages become TF-IDF rows, with document frequencies counted over the whole corpus; a distributed
randomised SVD gives their latent space. Windows of every document are projected into it. The held-out windows are kept in
cells around centroids; a document's window is compared with those of the nearest cells, and the ones near by cosine name the
candidates. An alignment then finds, for each candidate, the longest common stretch in which at most one word in eight is
replaced; only that decides. Beside each pair stands whether the document holds the item's answer too.

The corpus is read once for the counts and once for the search, up to MAX_ITEMS held-out items at a time.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, slices

STRETCH, REPLACED = 15, 8
WINDOW, STRIDE, ITEM_STRIDE = 24, 8, 4
RANK, OVERSAMPLE, POWER = 192, 16, 2
COSINE = 0.5
#: Held-out items that are searched for in one pass over the corpus; more are taken in further passes. Their index is what is
#: sent to the workers: some 12 windows of RANK half-precision numbers each, so at most about 250 MB.
MAX_ITEMS = 50_000
#: Held-out windows up to which every one is compared; beyond it they are put into cells, of which so many are looked into.
#: The centroids are fitted on at most CELL_SAMPLE windows; every window is in a cell.
ALL_COMPARED, PROBES, CELL_SAMPLE = 1024, 16, 20_000

_WORDS = re.compile(r"[^\W_]+")
_LINE_HYPHEN = re.compile(r"[-‐‑¬\xad][ \t]*\r?\n\s*")
_INVISIBLE = re.compile("[​-‍⁠﻿\xad]")


def _plain(text: str) -> str:
    text = text.casefold()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text))
        text = "".join(c for c in text if not unicodedata.combining(c))
    return text


def words(text: str) -> list[str]:
    """Words without case, accents and punctuation; parts of a word divided at a line end are joined."""
    return _WORDS.findall(_plain(_LINE_HYPHEN.sub("", text)))


_RUN_BEFORE, _RUN_AFTER = re.compile(r"[^\W_]*$"), re.compile(r"[^\W_]*")


def readings(text: str, number: dict[str, int] | None = None) -> list[list[str]]:
    """The words of a text. Each hyphen at a line end is decided by itself, by which words the held-out set has: the joined
    one, or the two parts. Where it has both, or where no set is given, a second reading takes those hyphens as marks."""
    if not _LINE_HYPHEN.search(text):
        return [words(text)]
    if number is None:
        return [words(text), _WORDS.findall(_plain(text))]
    first, second, last, unsure = [], [], 0, False
    for m in _LINE_HYPHEN.finditer(text):
        before, gap = text[last : m.start()], ""
        a, b = "".join(words(_RUN_BEFORE.search(before)[0])), "".join(words(_RUN_AFTER.match(text, m.end())[0]))
        both, whole = a in number and b in number, a + b in number
        if both and not whole:
            gap = " "
        first += [before, gap]
        second += [before, " " if both else gap]
        unsure |= both and whole
        last = m.end()
    tail = text[last:]
    return [words("".join([*x, tail])) for x in ((first, second) if unsure else (first,))]


def shares_stretch(a: np.ndarray, b: np.ndarray) -> bool:
    """Do two sequences of word numbers share a stretch of at least STRETCH words with at most one in REPLACED replaced?

    Only replacements are allowed, so the common subsequence runs along a diagonal. A longer stretch always holds one of
    fewer than twice STRETCH words that does as well, so only those lengths are tried.
    """
    n, m = len(a), len(b)
    if n < STRETCH or m < STRETCH:
        return False
    if n > 4096:  # a long text is taken in overlapping parts; the overlap holds every stretch that is tried
        return any(shares_stretch(a[k : k + 4096], b) for k in range(0, n - STRETCH + 1, 4096 - 2 * STRETCH))
    if m > 4096:  # and so is a long passage
        return any(shares_stretch(a, b[k : k + 4096]) for k in range(0, m - STRETCH + 1, 4096 - 2 * STRETCH))
    same = a[:, None] == b[None, :]
    # a diagonal with a stretch has at least this many equal words
    need = STRETCH - STRETCH // REPLACED
    i, j = np.nonzero(same)
    shifts, hits = np.unique(i - j, return_counts=True)
    for shift in shifts[hits >= need]:
        run = np.diagonal(same, -shift)
        total = np.concatenate([[0], np.cumsum(~run)])
        for length in range(STRETCH, min(2 * STRETCH, len(run) + 1)):
            if (total[length:] - total[:-length] <= length // REPLACED).any():
                return True
    return False


@dataclass
class Space:
    """The latent space of all held-out items; its size follows their vocabulary."""

    number: dict[str, int]
    idf: np.ndarray
    rows: np.ndarray  # vocabulary x rank, each row times the word's weight


@dataclass
class Index:
    """The held-out items of one pass; its size follows their number, not the corpus."""

    latent: np.ndarray  # windows x rank, unit length, those of a cell together
    item_of: np.ndarray  # window -> place of the item
    cells: np.ndarray  # cell x rank, the centroids
    starts: np.ndarray  # where the windows of each cell begin, and the end
    passages: list[np.ndarray]
    answers: list[np.ndarray]
    ids: list
    least: np.ndarray  # for each item: least weight of a stretch with its replacements


def _item_windows(n: int) -> list[tuple[int, int]]:
    if n < STRETCH:
        return []
    return [(s, s + STRETCH) for s in sorted({*range(0, n - STRETCH + 1, ITEM_STRIDE), n - STRETCH})]


def document_frequencies(docs: DataFrame, number: dict[str, int]) -> tuple[np.ndarray, int]:
    """Over all documents: how many hold each word of the held-out vocabulary, and how many there are."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = np.zeros(len(number), np.int64), 0
        for pdf in slices(rows):
            for t in pdf.text:
                total += 1
                own = {k for w in set(words(t)) if (k := number.get(w)) is not None}
                count[list(own)] += 1
        at = np.flatnonzero(count)
        yield pd.DataFrame({"word": np.append(at, -1), "n": np.append(count[at], total)})

    got = docs.select("text").mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(len(number), np.int64), 0
    for r in got:
        if r.word < 0:
            total = r.n
        else:
            out[r.word] = r.n
    return out, total


def randomised_svd(rows: DataFrame, width: int, rank: int, *, seed: int = 7) -> np.ndarray:
    """Right singular vectors (width x rank) of the sparse matrix rows (at array<int>, value array<double>).

    Each partition multiplies its rows by the broadcast block and sends back one sum; the driver holds width x rank only.
    """
    size = min(rank + OVERSAMPLE, width)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0]
    for _ in range(POWER + 1):
        sent = rows.sparkSession.sparkContext.broadcast(block)

        def multiply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q, total = sent.value, np.zeros((width, size))
            for pdf in parts:
                for at, value in zip(pdf["at"], pdf["value"]):
                    a, v = np.asarray(at, np.int64), np.asarray(value)
                    total[a] += v[:, None] * (v @ q[a])
            used = np.flatnonzero(np.abs(total).sum(1))
            yield pd.DataFrame({"row": used, "total": pd.Series(list(total[used]), dtype=object)})

        product = np.zeros((width, size))
        for r in rows.mapInPandas(multiply, "row long, total array<double>").collect():
            product[r.row] += np.array(r.total)
        block, strength, _ = np.linalg.svd(product, full_matrices=False)
    return block[:, strength > 1e-9 * strength[0]][:, :rank]


def held_out(items: DataFrame) -> DataFrame:
    """(item_id, passage, answer) as arrays of words, of the items whose passage can leak."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(rows):
            read = [(i, words(p), words(a or "")) for i, p, a in zip(pdf.item_id, pdf.passage, pdf.answer)]
            yield pd.DataFrame([x for x in read if len(x[1]) >= STRETCH], columns=["item_id", "passage", "answer"])

    answer = F.col("answer") if "answer" in items.columns else F.lit("")
    texts = items.filter(F.col("passage").isNotNull()).select("item_id", "passage", answer.cast("string").alias("answer"))
    return texts.mapInPandas(run, f"item_id {kind}, passage array<string>, answer array<string>")


def latent_space(docs: DataFrame, held: DataFrame) -> Space:
    """The space of the held-out windows: one pass over the corpus for the weights, then the SVD of rows that are made where
    the items lie."""
    spoken = held.select(F.explode(F.array_union("passage", "answer")).alias("w")).distinct()
    number = {w: k for k, w in enumerate(sorted(r.w for r in spoken.collect()))}
    df, total = document_frequencies(docs, number)
    idf = np.log((total + 1) / (df + 1)) + 0.05
    sent = docs.sparkSession.sparkContext.broadcast((number, idf))

    def windows(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, weight = sent.value
        for pdf in slices(rows):
            out = []
            for p in pdf.passage:
                own = np.array([numbers[w] for w in p])
                for a, b in _item_windows(len(own)):
                    at, n = np.unique(own[a:b], return_counts=True)
                    v = n * weight[at]
                    out.append((at.tolist(), (v / np.linalg.norm(v)).tolist()))
            yield pd.DataFrame(out, columns=["at", "value"])

    matrix = held.select("passage").mapInPandas(windows, "`at` array<int>, `value` array<double>")
    space = randomised_svd(matrix, len(number), RANK)
    return Space(number, idf, (space * idf[:, None]).astype(np.float32))


def window_vectors(space: Space, ws: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Unit vectors of the windows (start, end) of a text; ws: word numbers, -1 unknown. Sums over windows are differences of
    running sums, taken in parts so that a long text needs no more memory than a short one."""
    out = np.zeros((len(spans), space.rows.shape[1]), np.float32)
    step = 8192
    for begin in range(0, len(spans), step):
        part = spans[begin : begin + step]
        low, high = int(part[0, 0]), int(part[:, 1].max())
        own = ws[low:high]
        known = np.flatnonzero(own >= 0)
        sums = np.zeros((len(known) + 1, space.rows.shape[1]), np.float32)
        np.cumsum(space.rows[own[known]], axis=0, out=sums[1:])
        a, b = np.searchsorted(known, part[:, 0] - low), np.searchsorted(known, part[:, 1] - low)
        out[begin : begin + step] = sums[b] - sums[a]
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


def _cells(latent: np.ndarray, *, seed: int = 7) -> np.ndarray:
    """Centroids of the cells, by spherical k-means on a bounded sample."""
    if len(latent) <= ALL_COMPARED:
        return latent[:1] * 0
    rng = np.random.default_rng(seed)
    sample = latent if len(latent) <= CELL_SAMPLE else latent[rng.choice(len(latent), CELL_SAMPLE, replace=False)]
    centres = sample[rng.choice(len(sample), max(2, int(len(latent) ** 0.5)), replace=False)].copy()
    for _ in range(6):
        near = (sample @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 0, total / np.maximum(size, 1e-9), centres)
    return centres


def build_index(space: Space, items: list[tuple]) -> Index | None:
    """items: (id, passage, answer) as words."""
    if not items:
        return None
    passages, answers, item_of, vectors, least = [], [], [], [], []
    for k, (_, p, a) in enumerate(items):
        own = np.array([space.number[w] for w in p])
        passages.append(own)
        answers.append(np.array([space.number[w] for w in a], np.int64))
        weight = np.sort(np.lib.stride_tricks.sliding_window_view(space.idf[own], STRETCH), axis=1)
        least.append(weight[:, : STRETCH - STRETCH // REPLACED].sum(axis=1).min())
        spans = np.array(_item_windows(len(own)))
        vectors.append(window_vectors(space, own, spans))
        item_of += [k] * len(spans)
    latent, owner = np.concatenate(vectors), np.array(item_of)
    centres = _cells(latent)
    cell = (latent @ centres.T).argmax(axis=1)
    order = np.argsort(cell, kind="stable")
    starts = np.searchsorted(cell[order], np.arange(len(centres) + 1))
    return Index(latent[order].astype(np.float16), owner[order], centres, starts, passages, answers, [i for i, _, _ in items], np.array(least))


def document_spans(space: Space, ws: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(windows, their weights) of a text that may hold a stretch of an item, by the weight of their words."""
    known = ws >= 0
    need = STRETCH - STRETCH // REPLACED
    if np.count_nonzero(known) < need:
        return np.zeros((0, 2), np.int64), np.zeros(0)
    starts = np.arange(0, max(1, len(ws) - STRETCH + STRIDE), STRIDE)
    ends = np.minimum(starts + WINDOW, len(ws))
    total = np.concatenate([[0.0], np.cumsum(np.where(known, space.idf[ws], 0.0))])
    count = np.concatenate([[0], np.cumsum(known)])
    weight = total[ends] - total[starts]
    keep = (weight >= least - 1e-6) & (count[ends] - count[starts] >= need)
    return np.stack([starts[keep], ends[keep]], axis=1), weight[keep]


def candidates(space: Space, index: Index, texts: list[np.ndarray], *, probes: int = PROBES) -> set[tuple[int, int]]:
    """(place of the text, place of the item) of the items that some window of a text is near to in the latent space."""
    vectors, weights, owner = [], [], []
    least = float(index.least.min())
    for k, ws in enumerate(texts):
        spans, weight = document_spans(space, ws, least)
        if len(spans):
            vectors.append(window_vectors(space, ws, spans))
            weights.append(weight)
            owner.append(np.full(len(spans), k))
    if not vectors:
        return set()
    x, weight, text = np.concatenate(vectors), np.concatenate(weights), np.concatenate(owner)
    out: set[tuple[int, int]] = set()
    for begin in range(0, len(x), 2048):  # bounded memory for long texts
        part, w, t = x[begin : begin + 2048], weight[begin : begin + 2048], text[begin : begin + 2048]
        if len(index.cells) <= probes:
            near = np.broadcast_to(np.arange(len(index.cells)), (len(part), len(index.cells)))
        else:
            near = np.argpartition(part @ index.cells.T, -probes, axis=1)[:, -probes:]
        row, cell = np.repeat(np.arange(len(part)), near.shape[1]), near.ravel()
        order = np.argsort(cell, kind="stable")
        row, cell = row[order], cell[order]
        cuts = np.searchsorted(cell, np.arange(len(index.cells) + 1))
        for c in np.unique(cell):
            a, b = index.starts[c], index.starts[c + 1]
            if a == b:
                continue
            rows = row[cuts[c] : cuts[c + 1]]
            i, j = np.nonzero(part[rows] @ index.latent[a:b].astype(np.float32).T >= COSINE)
            item = index.item_of[a + j]
            enough = w[rows[i]] >= index.least[item] - 1e-6
            out.update(zip(t[rows[i[enough]]].tolist(), item[enough].tolist()))
    return out


def _holds(ws: np.ndarray, answer: np.ndarray) -> bool:
    """Do the words of the answer stand in the text, one after the other?"""
    if not len(answer) or len(answer) > len(ws):
        return False
    at = np.flatnonzero(ws[: len(ws) - len(answer) + 1] == answer[0])
    return any((ws[k : k + len(answer)] == answer).all() for k in at)


def leaked(space: Space, index: Index, texts: list[str]) -> list[tuple[int, int, bool]]:
    """(place of the text, place of the item, does the text hold the answer?) of the items of which a text holds a stretch."""
    read, owner = [], []
    for k, t in enumerate(texts):
        for ws in readings(t, space.number):
            read.append(np.array([space.number.get(w, -1) for w in ws], np.int64))
            owner.append(k)
    found: dict[tuple[int, int], bool] = {}
    for r, item in sorted(candidates(space, index, read)):
        pair = (owner[r], item)
        if pair not in found and shares_stretch(read[r], index.passages[item]):
            found[pair] = _holds(read[r], index.answers[item])
    return [(*pair, answered) for pair, answered in sorted(found.items())]


def leaks(docs: DataFrame, items: DataFrame, *, max_items: int = MAX_ITEMS) -> DataFrame:
    """(doc_id, item_id, answered): each document with each held-out item of whose passage it holds a stretch, and whether it
    holds the answer as well.

    docs: doc_id, text; items: item_id, passage[, answer]. Null, empty and blank texts hold none; passages of fewer than
    STRETCH words, or null, leak nowhere; equal passages are all reported; repeated documents come out as often as they came
    in. No shuffle of texts.
    """
    spark = docs.sparkSession
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, answered boolean"
    texts = docs.select("doc_id", "text").filter(F.length("text") > 0)
    out = spark.createDataFrame([], schema)
    held = settled(held_out(items))
    n = held.count()
    if not n:
        return out
    space = latent_space(texts, held)
    shared = spark.sparkContext.broadcast(space)
    passes = -(-n // max_items)

    def search(index: Index) -> DataFrame:
        sent = spark.sparkContext.broadcast(index)

        def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in slices(rows, rows=200):
                ids, pairs = pdf.doc_id.tolist(), leaked(shared.value, sent.value, pdf.text.tolist())
                yield pd.DataFrame([(ids[k], sent.value.ids[item], answered) for k, item, answered in pairs], columns=["doc_id", "item_id", "answered"])

        return texts.mapInPandas(run, schema)

    for k in range(passes):
        part = held.filter(F.expr(f"pmod(xxhash64(item_id), {passes}) = {k}")).orderBy("item_id").collect()
        if index := build_index(space, [(r.item_id, r.passage, r.answer) for r in part]):
            out = out.unionByName(search(index))
    return out
