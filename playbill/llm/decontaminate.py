"""Benchmark decontamination: a broadcast hash set of normalised n-grams scanned over the word windows of every document.

A window is ``n`` consecutive words of an item; an item of fewer words, but not none, is one window. In each
task a document's words are looked up among the windows' anchors (the longest word of each window); only around
an anchor is a whole window read and verified against the hash set. The set is broadcast in blocks of at most
``BLOCK_WINDOWS`` windows; a larger benchmark takes more passes, with results written in between.

Null texts and texts without words have no windows and no hits; repeated rows are scanned as they come; an empty
benchmark or an empty table gives no hits. A null item id counts as an item named by the empty string."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, functions as F

from playbill.llm.common import WORD_BYTES, add_columns, binary, by_value, map_rows, tidy_words, written

by_value(__name__)

NGRAM = 10
BLOCK_WINDOWS = 400_000
SPANS = "n_words long, spans array<struct<start: long, end: long>>, items array<string>"


def windows_of(words: list[bytes], n: int) -> list[bytes]:
    return [b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def benchmark_windows(benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """Distinct (window, item) pairs of the items (item_id, text)."""
    def made(batches):
        for batch in batches:
            pairs = [(w, i or "") for i, t in zip(batch.column("item").to_pylist(), binary(batch, "text"))
                     for w in dict.fromkeys(windows_of(tidy_words(t), n))]
            yield [p[0] for p in pairs], [p[1] for p in pairs]

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return map_rows(items, "gram binary, item string", made).distinct()


def hash_set(pairs) -> tuple[dict, dict]:
    """Items by window, and by anchor word the places it takes in windows: (words before it, words of the window)."""
    windows: dict[bytes, list] = {}
    anchors: dict[bytes, set] = {}
    for gram, item in pairs:
        windows.setdefault(gram, []).append(item)
        words = gram.split()
        at = max(range(len(words)), key=lambda i: len(words[i]))
        anchors.setdefault(words[at], set()).add((at, len(words)))
    return windows, {w: sorted(places) for w, places in anchors.items()}


def find_spans(words: list[bytes], windows: dict, anchors: dict) -> tuple[list[tuple[int, int]], set]:
    """Merged word spans that any window covers, and the items of those windows."""
    found, items = [], set()
    for i, w in enumerate(words):
        if w in anchors:
            for before, size in anchors[w]:
                start = i - before
                if start >= 0 and start + size <= len(words):
                    hit = windows.get(b" ".join(words[start:start + size]))
                    if hit:
                        found.append((start, start + size))
                        items.update(hit)
    return merged(found), items


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(s) for s in out]


def contaminated_spans(documents: DataFrame, benchmark: DataFrame, n: int = NGRAM, block: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents with ``n_words``, ``spans`` (word positions of the hits, merged) and ``items`` (ids, sorted as text)."""
    spark = documents.sparkSession
    pairs = written(benchmark_windows(benchmark, n), "benchmark-windows")
    # Blocks go by hash, so a block may hold a little more than the mean: aim at half of the bound.
    blocks = max(1, math.ceil(2 * pairs.count() / block))
    rows = documents
    for b in range(blocks):
        part = pairs.where(F.expr(f"pmod(xxhash64(gram), {blocks}) = {b}")) if blocks > 1 else pairs
        table = spark.sparkContext.broadcast(hash_set((bytes(r.gram), r.item) for r in part.toLocalIterator()))
        first = b == 0

        def scan(batch, table=table, first=first):
            windows, anchors = table.value
            n_words, spans, items = [], [], []
            old = [(), ()] if first else [batch.column("spans").to_pylist(), batch.column("items").to_pylist()]
            for k, text in enumerate(binary(batch, "text")):
                words = tidy_words(text)
                found, hit = find_spans(words, windows, anchors)
                if not first:
                    found = merged([*found, *((s["start"], s["end"]) for s in old[0][k])])
                    hit = {*hit, *old[1][k]}
                n_words.append(len(words))
                spans.append([{"start": s, "end": e} for s, e in found])
                items.append(sorted(hit))
            return [n_words, spans, items]

        if not first:
            rows = written(rows, "decontaminate")
        rows = add_columns(rows, SPANS, scan)
    return rows


def without_spans(marked: DataFrame) -> DataFrame:
    """The marked documents with the words of their spans cut from the text; what separates other words stays."""
    def cut(batch):
        out = []
        for text, spans in zip(binary(batch, "text"), batch.column("spans").to_pylist()):
            if spans:
                at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(WORD_BYTES))]
                for s in reversed(spans):
                    text = text[:at[s["start"]][0]] + text[at[s["end"] - 1][1]:]
            out.append(text.decode())
        return [out]

    return add_columns(marked, "text string", cut)


def decontaminated(documents: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns."""
    marked = contaminated_spans(documents.select(F.struct(*(documents[f"`{c}`"] for c in documents.columns)).alias("_row"), "text"), benchmark, n)
    return marked.where(F.size("spans") == 0).select("_row.*")


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    marked = contaminated_spans(documents.select("doc_id", "text"), benchmark)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return marked.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
