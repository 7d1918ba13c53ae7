"""Token ids as compressed binary blocks: canonical length-limited Huffman coding, decoded by table in independent blocks.

A folder in the format holds three tables. ``code`` has the length in bits of every id that occurs; lengths come from the counts of all ids in
all documents by package-merge, MAX_BITS at most, and canonical codes follow from the lengths alone (shorter first, then by id).
``blocks`` has the stream of ids in ascending doc_id order, cut into blocks of BLOCK ids: range partitions in order are the shards, and each block carries its
shard, its place there, the documents (or parts of them) in it, the coded bits, and the bit offset of every STEP-th id. ``shards`` has
the number of ids before each shard; it is written last, so a folder without it is not complete.

A block is read without any other: every checkpoint starts a lane, all lanes of some blocks look up MAX_BITS bits in one table and move on by the
length found there. A document longer than a block is in several of them; what is asked of it is put together from its parts.

Texts are split at ASCII white space, which no piece of the vocabulary's own pattern crosses, so a worker encodes each distinct word once
and keeps MEMORY of them, or those of one slice more; they are encoded by the tokenizers library itself, special tokens being ordinary text.

Defined results: null and empty texts have the end id alone; null doc_ids come first; of repeated doc_ids the smaller checksum of ids comes first,
and equal rows follow one another. No documents give empty tables, which read back as no rows. Other columns play no part."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from playbill.llm.common import by_value, map_rows, written
from playbill.llm.ordered import dealt_in_order

by_value(__name__)

END = 2
MAX_BITS = 20
BLOCK, STEP = 65_536, 256
#: Bytes of text that are split at once, letters of a word that is kept, words kept.
SLICE, LONG, MEMORY = 8 << 20, 64, 800_000


# Ids of texts.

# Characters before LATIN_END are composed already, and the marks are neither letters, digits nor white space. Bytes that
# print stand for themselves in the vocabulary, the others for characters from 256 on.
LATIN_END = "\u0250"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTED)}


class _Pieces(dict):
    """Packed ids by piece, as a mapping those of all texts of late."""

    def __init__(self, vocabulary: str, kind: str):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.coder, self.code = Tokenizer.from_str(vocabulary), np.dtype(kind).char
        self.words: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.coder.encode_special_tokens = True

    def learn(self, pieces: set[bytes]) -> None:
        """Pieces of Latin letters and marks are lower-cased and parted from the marks at their end, as the normalizer and the pattern of the
        vocabulary do; the words of letters alone then meet its model directly. Others are encoded as they are."""
        rest, words, code = [], self.words, self.code
        tokenize = self.coder.model.tokenize
        for piece in pieces:
            text = piece.decode()
            plain = text.isascii()
            if plain or max(text) < LATIN_END:
                text = text.lower()
                word = text.rstrip(MARKS)
                ids = words.get(word)
                if ids is None and word.isalpha():
                    letters = word if plain else word.encode().decode("latin-1").translate(BYTE_LETTERS)
                    ids = array(code, [t.id for t in tokenize(letters)]).tobytes()
                    if len(word) <= LONG:
                        words[word] = ids
                if ids is not None:
                    if len(word) < len(text):
                        marks = text[len(word):]
                        if marks not in self.marks:
                            self.marks[marks], = self._whole([marks])
                        ids += self.marks[marks]
                    self[piece] = ids
                    continue
            rest.append(piece)
        self.update(zip(rest, self._whole([p.decode() for p in rest]), strict=True))
        for kept in (words, self.marks):
            if len(kept) > MEMORY:
                kept.clear()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.coder.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text. They are joined from a smaller mapping of the pieces of these texts, so that the many lookups stay near."""
        split = [t.split() for t in texts]
        pieces = set().union(*split)
        if len(self) > MEMORY:
            self.clear()
        self.learn(pieces.difference(self))
        ids = dict(zip(pieces, map(self.__getitem__, pieces)))
        return [b"".join(map(ids.__getitem__, some)) for some in split]


def _pieces(table) -> _Pieces:
    """The worker's pieces, kept beside the broadcast for its next task."""
    if "pieces" not in table.value:
        table.value["pieces"] = _Pieces(table.value["vocabulary"], table.value["kind"])
    return table.value["pieces"]


def slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of at most SLICE bytes, or one longer text."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > SLICE:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def encoded(documents: DataFrame, vocabulary: str, end: int = END) -> tuple[DataFrame, str]:
    """(doc_id, ids, check) for each document, ids packed in the NumPy type that is returned too; ``vocabulary`` is the path of a
    tokenizer file, read here and sent to the tasks; ``check`` is a checksum of the ids."""
    from tokenizers import Tokenizer

    with open(vocabulary, encoding="utf-8") as file:
        text = file.read()
    kind = "<u2" if Tokenizer.from_str(text).get_vocab_size() <= 1 << 16 else "<u4"
    table = documents.sparkSession.sparkContext.broadcast({"vocabulary": text, "kind": kind})
    last = np.array([end], kind).tobytes()

    def run(batches):
        pieces = _pieces(table)
        for batch in batches:
            at = 0
            texts = (v or b"" for v in batch.column("text").cast(pa.binary()).to_pylist())
            for some in slices(texts):
                ids = [i + last for i in pieces.encoded(some)]
                yield [batch.column("doc_id").slice(at, len(some)), ids, [zlib.crc32(i) for i in ids]]
                at += len(some)

    key = documents.schema["doc_id"].dataType.simpleString()
    return map_rows(documents.select("doc_id", "text"), f"doc_id {key}, ids binary, check long", run), kind


# The code.

def id_counts(tokens: DataFrame, kind: str) -> dict[int, int]:
    """How often each id occurs in all of ``tokens``; at most one row for each id of the vocabulary comes to the driver."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind), minlength=len(total))
            n[:len(total)] += total
            total = n
        found = np.flatnonzero(total)
        yield [found.tolist(), total[found].tolist()]

    counts = map_rows(tokens.select("ids"), "id long, n long", run).groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in counts.toLocalIterator()}


def code_lengths(counts: dict[int, int], most: int = MAX_BITS) -> dict[int, int]:
    """Optimal code lengths of at most ``most`` bits by package-merge; a single id gets one bit."""
    symbols = sorted(counts, key=lambda i: (counts[i], i))
    n = len(symbols)
    if n > 1 << most:
        raise ValueError(f"{n} ids do not fit codes of {most} bits")
    if n < 2:
        return {i: 1 for i in symbols}
    weights = np.array([counts[i] for i in symbols], np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(most):
        merged = np.concatenate((weights, packages))
        order = np.argsort(merged, kind="stable")
        levels.append(order < n)
        merged = merged[order]
        packages = merged[0:len(merged) // 2 * 2:2] + merged[1::2][:len(merged) // 2]
    lengths = np.zeros(n, np.int64)
    taken = 2 * n - 2
    for own in reversed(levels):
        mine = int(own[:taken].sum())
        lengths[:mine] += 1
        taken = 2 * (taken - mine)
    return dict(zip(symbols, lengths.tolist()))


class Code:
    """Canonical codes of given lengths: ``bits`` and ``code`` by id to write, ``id_at`` and ``bits_at`` by leading bits to read."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.most = max(int(lengths.max(initial=1)), 1)
        spans = 1 << (self.most - lengths)
        starts = np.cumsum(spans) - spans
        self.bits, self.code = (np.zeros(int(ids.max(initial=0)) + 1, np.int64) for _ in range(2))
        self.bits[ids], self.code[ids] = lengths, starts >> (self.most - lengths)
        self.id_at, self.bits_at = np.zeros(1 << self.most, np.uint32), np.ones(1 << self.most, np.int64)
        self.id_at[:spans.sum()], self.bits_at[:spans.sum()] = np.repeat(ids, spans), np.repeat(lengths, spans)

    def pack(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """The bits of the ids, and the bit offset of every STEP-th of them."""
        bits, code = self.bits[ids], self.code[ids]
        at = np.cumsum(bits) - bits
        # Codes fill words of 32 bits from the top; none touches more than two, and no two share a bit, so sums are unions.
        wide = code << (64 - (at & 31) - bits)
        words = np.bincount(at >> 5, (wide >> 32) & 0xFFFFFFFF, minlength=int(bits.sum() + 63) // 32 + 1)
        words[1:] += np.bincount(at >> 5, wide & 0xFFFFFFFF, minlength=len(words))[:-1]
        data = words.astype(np.uint32).astype(">u4").tobytes()
        return data[:(int(bits.sum()) + 7) // 8], at[::STEP].astype("<u4").tobytes()

    def unpack(self, data: list[bytes], marks: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
        """Ids from lanes (bit offsets) of several blocks; of each block the first ``sizes`` ids."""
        room = np.cumsum([0] + [len(d) + 8 for d in data])
        joined = np.frombuffer(b"".join(d + bytes(8) for d in data) + bytes(8), np.uint8).astype(np.uint32)
        window = joined[:-3] << 24 | joined[1:-2] << 16 | joined[2:-1] << 8 | joined[3:]
        at = np.concatenate([m.astype(np.int64) + 8 * int(r) for m, r in zip(marks, room)])
        out = np.empty((STEP, len(at)), np.uint32)
        last = 8 * int(room[-1])
        for k in range(min(STEP, max(sizes, default=0))):
            front = ((window[at >> 3] << (at & 7).astype(np.uint32)) >> (32 - self.most)).astype(np.int64)
            out[k] = self.id_at[front]
            at = np.minimum(at + self.bits_at[front], last)
        lanes = np.cumsum([0] + [len(m) for m in marks])
        return [out[:, a:b].T.reshape(-1)[:n] for a, b, n in zip(lanes, lanes[1:], sizes)]


def code_of(table: DataFrame) -> Code:
    """The code of a folder; one row for each id that occurs comes to the driver."""
    rows = table.toPandas()
    return Code(rows["id"].to_numpy(np.int64), rows["bits"].to_numpy(np.int64))


# Writing and reading.

DOCS = "array<struct<doc_id:{0},at:bigint,n:bigint,lo:int,hi:int>>"


def _block_rows(tokens: DataFrame, kind: str, lengths: dict[int, int]) -> DataFrame:
    """Blocks of ``tokens``, whose partitions are in order; a document is (doc_id, place in its shard, ids, first and end place in the block)."""
    key = tokens.schema["doc_id"].dataType.simpleString()
    ids, bits = (np.array(x, np.int64) for x in (list(lengths), list(lengths.values())))
    block, end_type = BLOCK, DOCS.format(key)

    def run(batches):
        code, shard = Code(ids, bits), TaskContext.get().partitionId()
        held, docs = np.zeros(0, kind), []
        first, total, number = 0, 0, 0  # ids before the held ones, ids met, blocks made

        def made(n):
            nonlocal held, docs, first, number
            data, marks = code.pack(held[:n])
            parts = [(d, at, size, max(at - first, 0), min(at + size - first, n)) for d, at, size in docs if at < first + n]
            row = [[shard], [number], [first], [n], [[dict(zip(("doc_id", "at", "n", "lo", "hi"), p)) for p in parts]], [marks], [data]]
            held, first, number = held[n:], first + n, number + 1
            docs = [d for d in docs if d[1] + d[2] > first]
            return row

        for batch in batches:
            keys, blobs = batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()
            for doc, blob in zip(keys, blobs):
                size = len(blob) // held.itemsize
                docs.append((doc, total, size))
                total += size
            held = np.concatenate((held, np.frombuffer(b"".join(blobs), kind)))
            while len(held) >= block:
                yield made(block)
        if len(held):
            yield made(len(held))

    return map_rows(tokens.select("doc_id", "ids"), f"shard int, block int, first long, n int, docs {end_type}, marks binary, data binary", run)


def write_ids(documents: DataFrame, vocabulary: str, path: str, end: int = END) -> None:
    """Encodes the documents and writes a folder in the format."""
    spark = documents.sparkSession
    made, kind = encoded(documents, vocabulary, end)
    tokens = written(made, "tokens")
    lengths = code_lengths(id_counts(tokens, kind))
    spark.createDataFrame(list(lengths.items()), "id long, bits int").coalesce(1).write.parquet(f"{path}/code")
    _block_rows(dealt_in_order(tokens, "doc_id", "check"), kind, lengths).write.parquet(f"{path}/blocks")
    # One row for each partition.
    sizes = sorted((r["shard"], r["n"]) for r in spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n").alias("n")).collect())
    before = np.cumsum([0] + [n for _, n in sizes]).tolist()
    spark.createDataFrame([(s, b) for (s, _), b in zip(sizes, before)], "shard int, before long").coalesce(1).write.parquet(f"{path}/shards")


def _unpacked(rows: pa.RecordBatch, code: Code) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of blocks, some at a time."""
    for at in range(0, rows.num_rows, 8):
        part = rows.slice(at, 8)
        marks = [np.frombuffer(m, "<u4") for m in part.column("marks").to_pylist()]
        for k, ids in enumerate(code.unpack(part.column("data").to_pylist(), marks, part.column("n").to_pylist())):
            yield at + k, ids


def read_parts(spark: SparkSession, path: str, added: str, value) -> DataFrame:
    """(shard, at, doc_id, n, lo, count, <added>) for each document's part in each block: ``at`` is the document's place in its shard, ``n`` its
    ids, ``lo`` the first of them in the part, ``count`` how many are; ``value`` makes the column of the DDL ``added`` from the part's ids."""
    blocks = spark.read.parquet(f"{path}/blocks")
    code = code_of(spark.read.parquet(f"{path}/code"))
    key = blocks.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            shards, firsts, docs = (batch.column(c).to_pylist() for c in ("shard", "first", "docs"))
            for row, ids in _unpacked(batch, code):
                found = [(shards[row], d["at"], d["doc_id"], d["n"], firsts[row] + d["lo"] - d["at"], d["hi"] - d["lo"], value(ids[d["lo"]:d["hi"]])) for d in docs[row]]
                yield [list(c) for c in zip(*found)]

    return map_rows(blocks.select("shard", "first", "n", "docs", "marks", "data"), f"shard int, at long, doc_id {key}, n long, lo long, count long, {added}", run)


def read_span(spark: SparkSession, path: str, start: int, count: int) -> DataFrame:
    """(start, ids) for the blocks that hold any of ``count`` ids from ``start`` on, as long arrays; only the lanes needed are decoded."""
    blocks = spark.read.parquet(f"{path}/blocks").join(spark.read.parquet(f"{path}/shards"), "shard")
    place = F.col("before") + F.col("first")
    blocks = blocks.where((place < start + count) & (place + F.col("n") > start)).select(place.alias("place"), "n", "marks", "data")
    code = code_of(spark.read.parquet(f"{path}/code"))

    def run(batches):
        for batch in batches:
            for place, n, marks, data in zip(*(batch.column(c).to_pylist() for c in ("place", "n", "marks", "data"))):
                lo, hi = max(start - place, 0), min(start + count - place, n)
                lane = lo // STEP
                ids, = code.unpack([data], [np.frombuffer(marks, "<u4")[lane:-(-hi // STEP)]], [hi - lane * STEP])
                yield [[place + lo], [ids[lo - lane * STEP:].tolist()]]

    return map_rows(blocks, "start long, ids array<long>", run)


# Checksums of documents from checksums of their parts.

def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


def zero_bytes() -> list[list[int]]:
    """What 1, 2, 4, ... zero bytes do to a CRC-32, as matrices over its bits; enough for any length of a long."""
    step = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    for _ in range(3):
        step = [_times(step, row) for row in step]  # eight: one byte
    found = []
    for _ in range(63):
        found.append(step)
        step = [_times(step, row) for row in step]
    return found


def joined_crc(first: int, second: int, size: int, zeros: list[list[int]]) -> int:
    """CRC-32 of two byte strings one after the other, ``size`` being the length of the second: that of the first is moved on by so many zero bytes."""
    for k in range(size.bit_length()):
        if size >> k & 1:
            first = _times(zeros[k], first)
    return first ^ second


def digest(documents: DataFrame, vocabulary: str, path: str, end: int = END) -> DataFrame:
    """Writes the documents' ids to ``path`` and tells for each, from what is read there, where it starts, its ids and their checksum."""
    spark = documents.sparkSession
    write_ids(documents, vocabulary, path, end)
    parts = written(read_parts(spark, path, "crc long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes())), "token-parts")
    keys = ["shard", "at", "doc_id", "n"]

    def joined(batches):
        zeros = zero_bytes()
        for batch in batches:
            out = []
            for several in batch.column("parts").to_pylist():
                crc = 0
                for part in several:
                    crc = joined_crc(crc, part["crc"], 4 * part["count"], zeros)
                out.append(crc)
            yield [*(batch.column(k) for k in keys), out]

    types = ", ".join(f"`{k}` {parts.schema[k].dataType.simpleString()}" for k in keys)
    several = parts.where("count < n").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lo", "count", "crc"))).alias("parts"))
    rows = parts.where("count = n").select(*keys, "crc").unionByName(map_rows(several, f"{types}, crc long", joined))
    shards = spark.read.parquet(f"{path}/shards")
    return rows.join(shards, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
