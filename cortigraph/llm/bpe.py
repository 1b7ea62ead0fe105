"""Byte-level BPE of whole texts with a public rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern of this public vocabulary that cuts a text before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Remembered pieces of a Python worker; above it the memory starts anew.
REMEMBERED = 200_000
REMEMBERED_LENGTH = 64

_NONE = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


class PairTree:
    """Segment tree over byte positions: the leftmost pair of least rank.

    Leaf i holds the rank of the pair that begins at position i, joined with i so
    that the least value is the leftmost least rank; a dead or unmergeable
    position holds a value above all ranks.
    """

    def __init__(self, values: list[int]):
        size = 1
        while size < len(values):
            size *= 2
        self.size = size
        t = [_NONE] * size + values + [_NONE] * (size - len(values))
        for i in range(size - 1, 0, -1):
            a, b = t[2 * i], t[2 * i + 1]
            t[i] = a if a < b else b
        self.nodes = t

    def put(self, i: int, value: int) -> None:
        t = self.nodes
        i += self.size
        t[i] = value
        while i > 1:
            i >>= 1
            a, b = t[2 * i], t[2 * i + 1]
            if b < a:
                a = b
            if t[i] == a:
                return
            t[i] = a

    def least(self) -> int:
        return self.nodes[1]


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the least-rank pair, the leftmost first, until none is left: O(n log n)."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    get = ranks.get
    stride = n + 1
    value = lambda i, j: r * stride + i if (r := get(piece[i:j])) is not None else _NONE
    after = list(range(1, n + 1))  # where the part that begins here ends
    before = list(range(-1, n))  # where the part before this one begins
    tree = PairTree([value(i, i + 2) for i in range(n - 1)] + [_NONE])
    while (least := tree.least()) < _NONE:
        i = least % stride
        j = after[i]
        end = after[j]
        after[i] = end
        tree.put(j, _NONE)
        if end < n:
            before[end] = i
            tree.put(i, value(i, after[end]))
        else:
            tree.put(i, _NONE)
        if (p := before[i]) >= 0:
            tree.put(p, value(p, end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class _Pieces(dict):
    """Ids by piece; each worker process encodes a piece that comes again once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> list[int]:
        ids = encode_piece(piece.encode("utf-8", "replace"), self.ranks)
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


_workers: dict[str, _Pieces] = {}


def encode(df: DataFrame, id_column: str, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Id column and `ids`: the token ids of each whole text, no special tokens.

    Null and empty texts give an empty list. Text that spells a special token is
    ordinary text. One row per input row, repeated and null ids included; other
    columns are dropped; there is no shuffle. A text of any length takes
    O(n log n) steps. The vocabulary is a fixed file of one entry per id; it is
    read on the driver and broadcast.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))
    id_type = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import chain

        import numpy as np
        import regex

        pieces = _workers.get(vocabulary) or _workers.setdefault(vocabulary, _Pieces(shared.value))
        cut, ids_of = regex.compile(pattern).findall, pieces.__getitem__
        for batch in batches:
            flat: list[int] = []
            offsets = [0]
            blocks = []
            for text_value in batch.column(1):
                s = text_value.as_py()
                if s:
                    flat.extend(chain.from_iterable(map(ids_of, cut(s))))
                offsets.append(offsets[-1] + len(flat))
                if flat:
                    blocks.append(np.array(flat, dtype=np.int32))
                    flat.clear()
            values = pa.array(np.concatenate(blocks) if blocks else np.empty(0, np.int32))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_column, "ids"])

    return df.select(F.col(id_column), F.col(text)).mapInArrow(run, f"`{id_column}` {id_type}, ids array<int>")


def decode(df: DataFrame, id_column: str, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Id column and `text` of token ids, the way back of `encode`; an unknown id is an error, null ids give a null text."""
    shared = df.sparkSession.sparkContext.broadcast({i: b for b, i in read_ranks(vocabulary).items()})
    id_type = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if v is None else decode_bytes(v, shared.value).decode("utf-8", "replace") for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    return df.select(F.col(id_column), F.col(ids)).mapInArrow(run, f"`{id_column}` {id_type}, text string")


def decode_bytes(ids: list[int], by_id: dict[int, bytes]) -> bytes:
    return b"".join(by_id[i] for i in ids)
