"""Problem 6: encode every text with a public tokenizer, by forced-boundary splitting.

A byte pair that lies inside no vocabulary token can never be joined by the encoder, so a text may be cut there and the
fragments encoded by themselves. ``ForcedCuts`` reads the pairs from the vocabulary and keeps the cuts at which the
tokenizer's own word pattern also starts afresh (it looks one white space ahead, and treats an apostrophe before letters
specially), so the concatenation equals the encoding of the whole text. Fragments repeat heavily in natural text: each
distinct one is encoded once per worker process, which keeps its encoder from one task to the next.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fragments kept per worker, and the longest that are kept; beyond the first the memory is emptied and refilled, longer ones
#: are encoded wherever they come up. Neither changes a result; together they bound the memory.
MEMO_FRAGMENTS, MEMO_LENGTH = 300_000, 100
#: The placeholder alphabet of byte-level vocabularies: printable Latin-1 bytes stand for themselves, others move up by 256.
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]


def default_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file: ``$TOKENIZER_DIR``, else the installed package of public tokenizers."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def vocabulary_tokens(path: str) -> list[bytes]:
    """The byte strings of a byte-level vocabulary (.json or .tiktoken)."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            return [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    moved = iter(range(256, 512))
    to_byte = {chr(b): b for b in _KEPT} | {chr(next(moved)): b for b in range(256) if b not in set(_KEPT)}
    special = {t["content"] for t in doc.get("added_tokens", [])}
    return [bytes(to_byte[c] for c in t) for t in doc["model"]["vocab"] if t not in special]


class ForcedCuts:
    """Certain cuts of a byte-level vocabulary; ``split`` gives fragments whose concatenation is the text."""

    SPACES, LETTERS = " \n\t\r", "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)]))
    PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # without the apostrophe

    def __init__(self, tokens: list[bytes]):
        self.joined = joined = np.zeros((256, 256), bool)
        for t in tokens:
            b = np.frombuffer(t, np.uint8)
            joined[b[:-1], b[1:]] = True
        parts = []
        for w in self.SPACES:  # a white space after anything else, unless some token joins the two bytes
            bad = [b for b in np.flatnonzero(joined[:, ord(w)]).tolist() if chr(b) not in self.SPACES and b < 128]
            if any(joined[128:, ord(w)]):
                # only white space and signs in non-ASCII bytes are joined: then cut after ASCII characters alone
                left = "".join(chr(b) for b in range(33, 127) if b not in bad)
                parts.append(f"(?<=[{re.escape(left)}])(?={re.escape(w)})")
            else:
                parts.append(rf"(?<=[^\s\x1c-\x1f\x85{re.escape(''.join(map(chr, bad)))}])(?={re.escape(w)})")
        right = "".join(c for c in self.PUNCTUATION if not any(joined[ord(a), ord(c)] for a in self.LETTERS))
        if right:  # punctuation after a letter or digit
            parts.append(rf"(?<=[0-9A-Za-z])(?=[{re.escape(right)}])")
        self.cut = re.compile("|".join(parts))

    def split(self, text: str) -> list[str]:
        return self.cut.split(text) if text else []


class FragmentEncoder:
    """Encodes texts fragment by fragment; the same ids as ``encode`` of the whole text without special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cuts = ForcedCuts(vocabulary_tokens(path))
        self.memo: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split, memo = [self.cuts.split(t or "") for t in texts], self.memo
        if len(memo) > MEMO_FRAGMENTS:
            memo.clear()
        new = list({f for x in split for f in x if f not in memo})
        now: dict[str, list[int]] = {}
        for f, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False)):
            (memo if len(f) <= MEMO_LENGTH else now)[f] = e.ids
        out = []
        for x in split:
            ids: list[int] = []
            for f in x:
                ids += memo[f] if f in memo else now[f]
            out.append(ids)
        return out


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> FragmentEncoder:
    return FragmentEncoder(path)


def encode_ids(df: DataFrame, key: str, text: str, *, vocabulary: str | None = None, key_as: str | None = None, ids: str = "ids") -> DataFrame:
    """(key, ids): the token ids of each row's text.

    Null and empty texts give an empty list; blank texts give the ids of their white space. One row comes out for each
    row that goes in, repeated keys and null keys included; other columns are left out. Map-only: no shuffle.
    """
    path, kind = vocabulary or default_vocabulary(), df.schema[key].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in rows:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                got = encoder.encode(part.column(1).to_pylist())
                offsets = np.zeros(len(got) + 1, np.int32)
                np.cumsum([len(x) for x in got], out=offsets[1:])
                flat = np.fromiter((i for x in got for i in x), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key_as or key, ids])

    return df.select(F.col(key).alias(key_as or key), F.col(text)).mapInArrow(run, f"`{key_as or key}` {kind}, `{ids}` array<int>")
