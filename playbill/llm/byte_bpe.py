"""Byte-level BPE: ranked merges folded over the bytes of distinct words, decoding by joining byte pieces.

Each task splits whole texts into words with the pattern, and folds the ranked merges over the bytes of every word it
has not met before; words met again take their ids from the worker's memory, which holds at most ``MEMORY`` words
(kept beside the broadcast, so that a worker's next task finds it).
Words of more than ``LONG`` bytes are folded with a heap instead of a scan, so their cost stays near linear.
The rank map is the vocabulary (a fixed size), read from a path that the caller gives, and broadcast.

Null and empty texts have no ids and decode to no bytes. Repeated rows give repeated results. Ids are packed as
little-endian unsigned 32-bit integers."""

from __future__ import annotations

import base64
import heapq
import struct

import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F

from playbill.llm.common import add_columns, binary, by_value

by_value(__name__)

MEMORY = 1_000_000
LONG = 96
NONE = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by byte piece, from a file of base64 pieces and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


class Merges:
    """The rank map as tables over ids: ``byte`` by byte, ``first`` by pair of bytes, ``pair`` by pair of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.first, self.pair = [NONE] * 65536, {}
        for piece, rank in ranks.items():
            if len(piece) == 2:
                self.first[piece[0] << 8 | piece[1]] = rank
            for i in range(1, len(piece)):
                left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
                if left is not None and right is not None:
                    self.pair[left << 32 | right] = rank

    def fold(self, word: bytes) -> list[int]:
        """Ids of one word: the leftmost pair of least rank is merged until no pair has a rank."""
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        if len(word) > LONG:
            return _fold_long(word, self.ranks)
        byte, first, rank_of = self.byte, self.first, self.pair.get
        ids = [byte[b] for b in word]
        pairs = [first[a << 8 | b] for a, b in zip(word, word[1:])]
        while pairs and (least := min(pairs)) != NONE:
            i = pairs.index(least)
            ids[i:i + 2] = (least,)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank_of(least << 32 | ids[i + 1], NONE)
            if i:
                pairs[i - 1] = rank_of(ids[i - 1] << 32 | least, NONE)
        return ids


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold: pieces are [start, end[start]), ranked pairs wait in a heap, outdated ones are skipped."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1" * n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i] = 0, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[word[i:end[i]]] for i in range(n) if alive[i]]


class Encoder(dict):
    """Packed ids by word; a word not met before is folded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.fold, self.split = Merges(ranks).fold, regex.compile(pattern).findall
        self.pieces = [b""] * (1 + max(ranks.values(), default=-1))
        for piece, rank in ranks.items():
            self.pieces[rank] = piece

    def __missing__(self, word: str) -> bytes:
        ids = self.fold(word.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= MEMORY:
            self.clear()
        if len(packed) <= 4 * LONG:
            self[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _coder(table, pattern: str) -> Encoder:
    if pattern not in table.value:
        table.value[pattern] = Encoder(table.value["ranks"], pattern)
    return table.value[pattern]


def encoded(documents: DataFrame, ranks_path: str, pattern: str, decode: bool = True) -> DataFrame:
    """The documents with ``ids`` (packed) and, if asked for, ``decoded`` (the bytes the ids stand for)."""
    table = documents.sparkSession.sparkContext.broadcast({"ranks": read_ranks(ranks_path)})

    def run(batch):
        coder = _coder(table, pattern)
        ids = [coder.encode(t.decode()) for t in binary(batch, "text")]
        return [ids, [coder.decode(i) for i in ids]] if decode else [ids]

    return add_columns(documents, "ids binary, decoded binary" if decode else "ids binary", run)


def decoded(rows: DataFrame, ranks_path: str) -> DataFrame:
    """Rows with packed ``ids`` and the bytes they stand for; null ids decode to no bytes."""
    table = rows.sparkSession.sparkContext.broadcast({"ranks": read_ranks(ranks_path)})

    def run(batch):
        coder = _coder(table, "")
        return [[coder.decode(i or b"") for i in batch.column("ids").to_pylist()]]

    return add_columns(rows, "decoded binary", run)


def digest(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per document: n_tokens, ids_sha256, decoded_sha256."""
    rows = encoded(documents.select("doc_id", "text"), ranks_path, pattern)
    return rows.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
