"""Encoding of whole texts with a public byte-level BPE vocabulary.

Method: each distinct short word is held as a contiguous array of part
boundaries and the ranks of adjacent parts; the smallest rank is found by a
scan, its boundary deleted and the two neighbouring ranks refreshed, until no
adjacent parts form a token.  Words of more than ``LONG`` bytes use a heap with
linked neighbours, whose merges come in the same order.  Workers keep the ids
of words already met.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LONG = 256
CACHE_WORDS = 300_000
NO_RANK = 1 << 60
DOCS_AT_ONCE = 512


def vocabulary_path() -> str:
    """The default vocabulary file: byte_bpe_50k."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def split_pattern() -> str:
    """The pattern that cuts a text into the words of the vocabulary."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank (the id) from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by the contiguous rank array."""
    starts = list(range(len(word) + 1))
    rank_of = ranks.get
    adjacent = [rank_of(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
    while adjacent:
        low = min(adjacent)
        if low == NO_RANK:
            break
        i = adjacent.index(low)
        del starts[i + 1], adjacent[i]
        if i < len(adjacent):
            adjacent[i] = rank_of(word[starts[i] : starts[i + 2]], NO_RANK)
        if i:
            adjacent[i - 1] = rank_of(word[starts[i - 1] : starts[i + 1]], NO_RANK)
    return [ranks[word[a:b]] for a, b in zip(starts, starts[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by a heap of adjacent pairs; the same merges in the same order."""
    n = len(word)
    end = list(range(1, n + 1))  # of the part that begins at i; 0 once merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class _Pieces(dict):
    """Piece of text to its number in the pool of ids."""

    def __init__(self, encoder: "Encoder"):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> int:
        number = self[piece] = self.encoder.add(piece)
        return number


class Encoder:
    """Ids of texts, without special tokens.

    A single blank before something that is not white space always begins a
    word of the pattern, so texts are cut there first, by plain string search,
    and each distinct piece is cut into words by the pattern once.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.words = ranks, regex.compile(pattern)
        self.cuts = regex.compile(r" (?=\S)")
        self.odd = regex.compile(r" (?:\s|$)")
        self.clear()

    def clear(self) -> None:
        self.pool, self.starts = array("i"), array("q", [0])
        self.first, self.rest = _Pieces(self), _Pieces(self)
        self.rest.encoder = _Blank(self)

    def word(self, text: str) -> list[int]:
        raw = text.encode()
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        return merge_short(raw, self.ranks) if len(raw) <= LONG else merge_long(raw, self.ranks)

    def add(self, piece: str) -> int:
        for w in self.words.findall(piece):
            self.pool.extend(self.word(w))
        self.starts.append(len(self.pool))
        return len(self.starts) - 2

    def numbers(self, text: str) -> np.ndarray:
        parts = self.cuts.split(text) if self.odd.search(text) else text.split(" ")
        if not parts[0] and len(parts) > 1:  # the text begins with a blank
            return np.fromiter(map(self.rest.__getitem__, parts[1:]), np.int64, len(parts) - 1)
        out = np.empty(len(parts), np.int64)
        out[0] = self.first[parts[0]]
        out[1:] = np.fromiter(map(self.rest.__getitem__, parts[1:]), np.int64, len(parts) - 1)
        return out

    def encode_many(self, texts: list[str | None], lengths_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(lengths of the lists, all ids one after the other); null and empty texts have no ids."""
        if len(self.first) + len(self.rest) > CACHE_WORDS:
            self.clear()
        numbers = [self.numbers(t) if t else np.empty(0, np.int64) for t in texts]
        sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
        flat = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
        starts = np.array(self.starts, np.int64)
        n_ids = starts[flat + 1] - starts[flat]
        ends = np.concatenate([[0], np.cumsum(n_ids)])
        row_ends = np.concatenate([[0], np.cumsum(sizes)])
        lengths = ends[row_ends[1:]] - ends[row_ends[:-1]]
        if lengths_only:
            return lengths, np.empty(0, np.int32)
        at = np.repeat(starts[flat] - ends[:-1], n_ids) + np.arange(ends[-1])
        return lengths, np.array(self.pool, np.int32)[at]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([text])[1].tolist()


class _Blank:
    """Adds a piece that followed a blank."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def add(self, piece: str) -> int:
        return self.encoder.add(" " + piece)


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(key: tuple, vocabulary) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary.value, key[1])
    return _ENCODERS[key]


def _encode(df: DataFrame, ids: list[str], text: str, out: str, path: str | None, lengths_only: bool) -> DataFrame:
    clash = [c for c in ids if c == out]
    if clash or text in ids:
        raise ValueError(f"{out} and {text} can't be among the kept columns {ids}")
    path = path or vocabulary_path()
    vocabulary = df.sparkSession.sparkContext.broadcast(read_ranks(path))  # bounded: the vocabulary
    key = (path, split_pattern())
    kept = df.select(*ids, text)
    kind = T.LongType() if lengths_only else T.ArrayType(T.IntegerType())
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS_AT_ONCE):
                b = whole.slice(at, DOCS_AT_ONCE)
                lengths, flat = encoder.encode_many(b.column(len(ids)).to_pylist(), lengths_only)
                if lengths_only:
                    last = pa.array(lengths)
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], last], names=[*ids, out])

    return kept.mapInArrow(run, schema)


def encode(df: DataFrame, ids: list[str], text: str, out: str = "ids", path: str | None = None) -> DataFrame:
    """The columns ``ids`` and the list of token ids of ``text`` by the vocabulary at ``path``.

    Null and empty texts have an empty list; text that looks like a special
    token is plain text.  Texts of any length are encoded whole.  Other columns
    are left out, rows neither dropped nor merged.  There is no shuffle.
    """
    return _encode(df, ids, text, out, path, False)


def count_tokens(df: DataFrame, ids: list[str], text: str, out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """As ``encode`` with the number of ids instead of the list (0 for null and empty texts)."""
    return _encode(df, ids, text, out, path, True)
