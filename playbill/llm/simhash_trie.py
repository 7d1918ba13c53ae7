"""Near-duplicate detection: fingerprints joined by a binary trie traversed in node pairs within a Hamming error budget.

Distinct fingerprints of ``bits`` bits are spread over ``budget + 1`` rotations: any two within the budget agree on the leading
block of one rotation, so below each block node the trie is joined with itself: pairs of nodes descend together, each
step that takes different branches spends one bit of the budget, and a pair is dropped once it has spent more. Sub-tries of more
than ``SPLIT_ROWS`` fingerprints are cut further into pairs of deeper nodes (again only those within the budget), so that no
task holds a hot sub-trie whole. A task descends level by level over sorted arrays, a bounded number of node pairs at a time.

Of the pairs found, a task passes on a spanning forest of each sub-trie: enough for groups, and linear in its rows. Groups
are the connected components of all forests, by alternating large-star and small-star rounds, each written to the shared folder.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a text of fewer words than a shingle is one
shingle, a text without words has fingerprint zero and is linked like any other. Null is an empty text. Repeated rows
share a fingerprint; a null doc_id is never the name of a group unless the group has no other. Empty tables give no rows."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from playbill.llm.common import add_columns, binary, by_value, map_rows, written

by_value(__name__)

BITS, BUDGET = 64, 2
SHINGLE = 3
SPLIT_ROWS = 20_000
FRONTIER = 400_000
UNITS_ROWS = 60_000


# Fingerprints.

def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of the text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, digest = len(words) - size + 1, xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[size - 1:].tolist())), np.uint64, n)


def simhash(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprinted(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The documents with ``print``, the fingerprint's 64 bits as a signed long."""
    def run(batch):
        prints = [simhash(shingle_hashes(t, size)) for t in binary(batch, "text")]
        return [np.array(prints, np.uint64).astype(np.int64).tolist()]

    return add_columns(documents, "print long", run)


# The trie join.

def masks(bits: int, budget: int) -> list[int]:
    """All words of so many bits with at most ``budget`` of them set."""
    found = [0]
    for _ in range(budget):
        found = sorted({m | 1 << b for m in found for b in range(bits)} | set(found))
    return found


class _Forest:
    """Union-find over positions, with the pairs that joined two sets."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def node_pairs(values: np.ndarray, pairs: np.ndarray, depth: np.ndarray, bits: int, budget: int):
    """Descends from the given node pairs; yields arrays (position, position) of distinct values within the budget.

    ``values`` are sorted within each node; a node is a range [lo, hi) of positions, a pair is (lo, hi, lo, hi, spent), a node
    with itself if both ranges are equal. ``depth`` is the level at which each pair starts."""
    zeros: dict[int, np.ndarray] = {}

    def split(lo, hi, level):
        """Where the branch of ones starts."""
        if level not in zeros:
            zeros[level] = np.concatenate(([0], np.cumsum((values >> np.uint64(bits - 1 - level)) & np.uint64(1) == 0)))
        return lo + zeros[level][hi] - zeros[level][lo]

    waiting = [(int(d), pairs[depth == d]) for d in sorted(set(depth.tolist()), reverse=True)]
    while waiting:
        level, front = waiting.pop()
        if len(front) > FRONTIER:
            half = len(front) // 2
            waiting += [(level, front[:half]), (level, front[half:])]
            continue
        single = (front[:, 1] - front[:, 0] == 1) & (front[:, 3] - front[:, 2] == 1)
        leaves = front[single & (front[:, 0] != front[:, 2])]
        if len(leaves):
            spent = np.bitwise_count(values[leaves[:, 0]] ^ values[leaves[:, 2]])
            near = spent <= budget
            if near.any():
                yield leaves[near, 0], leaves[near, 2]
        front = front[~single]
        if not len(front) or level >= bits:
            continue
        a0, a2, b0, b2, spent = front.T
        a1, b1 = split(a0, a2, level), split(b0, b2, level)
        same = (a0 == b0) & (a2 == b2)
        more = spent + 1
        made = [np.stack(c, 1) for c in ((a0, a1, b0, b1, spent), (a1, a2, b1, b2, spent), (a0, a1, b1, b2, more))]
        made.append(np.stack((a1, a2, b0, b1, more), 1)[~same])
        front = np.concatenate(made)
        front = front[(front[:, 0] < front[:, 1]) & (front[:, 2] < front[:, 3]) & (front[:, 4] <= budget)]
        if len(front):
            waiting.append((level + 1, front))


def _unit_pairs(columns: dict[str, np.ndarray], bits: int, block_bits: int):
    """Node pairs at which whole units start, and their levels; columns are sorted by unit and value."""
    values = columns["value"]
    keys = np.stack([columns[k] for k in ("part", "block", "low", "high")], 1)
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
    last = np.concatenate((first[1:], [len(values)]))
    pairs, depths = [], []
    for lo, hi in zip(first.tolist(), last.tolist()):
        if hi - lo < 2:
            continue
        cut, low, high = int(columns["cut"][lo]), int(columns["low"][lo]), int(columns["high"][lo])
        if low == high:
            pairs.append((lo, hi, lo, hi, 0))
        else:
            mid = lo + int(np.searchsorted((values[lo:hi] >> np.uint64(bits - block_bits - cut)) & np.uint64((1 << cut) - 1), high))
            if mid in (lo, hi):
                continue
            pairs.append((lo, mid, mid, hi, (low ^ high).bit_count()))
        depths.append(block_bits + cut)
    return np.array(pairs, np.int64).reshape(-1, 5), np.array(depths, np.int64)


def _joined_units(columns: dict[str, np.ndarray], bits: int, block_bits: int, budget: int):
    """Forest edges of whole units; columns are sorted by unit and value. Pairs go into the forest as they are found."""
    values, ids = columns["value"], columns["id"]
    pairs, depths = _unit_pairs(columns, bits, block_bits)
    forest, left, right = _Forest(), [], []
    for found in node_pairs(values, pairs, depths, bits, budget):
        for a, b in zip(*(f.tolist() for f in found)):
            if forest.join(a, b):
                left.append(int(ids[a]))
                right.append(int(ids[b]))
    return left, right


def trie_links(prints: DataFrame, bits: int = BITS, budget: int = BUDGET, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Links (a, b) of ids whose prints of one part differ in at most ``budget`` bits: a spanning forest of every sub-trie.

    ``prints`` has (part, print, id) with distinct (part, print); parts are joined apart from one another."""
    blocks = budget + 1
    block_bits = bits // blocks
    full = (1 << bits) - 1
    signed = lambda n: n - (1 << 64) if n >= 1 << 63 else n

    def rotated(k: int):
        r = k * block_bits
        p = F.col("print")
        if not r:
            return p
        turned = F.shiftleft(p, r).bitwiseOR(F.shiftrightunsigned(p.bitwiseAND(F.lit(signed(full))), bits - r))
        return turned.bitwiseAND(F.lit(signed(full)))

    turns = F.array(*(F.struct(F.lit(k).alias("k"), rotated(k).alias("value")) for k in range(blocks)))
    rows = prints.select("part", "id", F.explode(turns).alias("t")).select(
        (F.col("part") * blocks + F.col("t.k")).cast("int").alias("part"), "id", F.col("t.value").alias("value"))
    rows = rows.withColumn("block", F.shiftrightunsigned("value", bits - block_bits))
    sizes = rows.groupBy("part", "block").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = rows.join(sizes, ["part", "block"])
    most = min(20, bits - block_bits)
    cut = F.when(F.col("size") <= split_rows, 0).otherwise(F.least(F.lit(most), F.ceil(F.log2(F.col("size") / split_rows)) + 2)).cast("int")
    rows = rows.withColumn("cut", cut)
    # Deeper nodes of a hot sub-trie: a row goes to each pair of its own node with one within the budget.
    table = F.from_json(F.lit(str([masks(c, budget) for c in range(most + 1)])), "array<array<bigint>>")
    node = F.expr(f"shiftright(value, {bits - block_bits} - cut) & (shiftleft(1L, cut) - 1)")
    rows = rows.withColumn("node", node).withColumn("mask", F.explode(F.get(table, F.col("cut"))))
    other = F.col("node").bitwiseXOR(F.col("mask"))
    units = rows.select("part", "block", "cut", F.least("node", other).alias("low"), F.greatest("node", other).alias("high"), "value", "id")
    names = ("part", "block", "cut", "low", "high", "value", "id")

    def run(batches):
        held: list[dict[str, np.ndarray]] = []
        count = 0

        def flush(final: bool):
            """Joins the units that are complete and keeps the rows of the last one, unless the rows end here."""
            nonlocal held, count
            columns = {n: np.concatenate([h[n] for h in held]) for n in names}
            end = len(columns["id"])
            if not final:
                last = np.ones(end, bool)
                for n in ("part", "block", "low", "high"):
                    last &= columns[n] == columns[n][-1]
                end = int(np.argmax(last))
            held = [{n: v[end:] for n, v in columns.items()}]
            count = 0 if end else -UNITS_ROWS
            if not end:
                return [], []
            whole = {n: v[:end] for n, v in columns.items()}
            return _joined_units(whole, bits, block_bits, budget)

        for batch in batches:
            got = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
            got["value"] = got["value"].astype(np.int64).view(np.uint64)
            held.append(got)
            count += batch.num_rows
            if count >= UNITS_ROWS:
                yield flush(False)
        if held:
            yield flush(True)

    # Signed order differs from the trie's for values with the top bit set, so the sort flips that bit.
    order = F.col("value").bitwiseXOR(F.lit(-(1 << 63))) if bits == 64 else F.col("value")
    dealt = units.repartition("part", "block", "low", "high").sortWithinPartitions("part", "block", "low", "high", order)
    return map_rows(dealt, "a long, b long", run).distinct()


# Groups.

def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for every node with a link, label being the smallest node reachable."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, name)
        # Ends when a round changes no edge: their number and an order-free checksum stay.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def near_duplicates(documents: DataFrame, size: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """(doc_id, check, print, label, component_id): documents whose prints are linked, directly or through others, share a label, and the smallest
    doc_id as component_id (null if no document of them has one). ``check`` is a checksum of the text."""
    text = documents["`text`"]
    bare = documents.select(documents["`doc_id`"], text, F.xxhash64(text).alias("check"))
    rows = written(fingerprinted(bare, size).select("doc_id", "check", "print"), "prints")
    classes = rows.groupBy("print").agg(F.min("doc_id").alias("least"))
    links = trie_links(classes.select(F.lit(0).alias("part"), "print", F.col("print").alias("id")), BITS, budget)
    labels = components(links)
    named = classes.join(labels, classes["print"] == labels["node"], "left").withColumn("label", F.coalesce("label", "print"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.select("print", "label").join(least, "label").select("print", "label", "component_id")
    return rows.join(named, "print").select("doc_id", "check", "print", "label", "component_id")


def digest(documents: DataFrame) -> DataFrame:
    hexes = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return near_duplicates(documents).select("doc_id", hexes.alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, size: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest doc_id (null last), by checksum of the text where rows share it; all
    columns stay. Rows that share doc_id and text are one document, of which any row stays. Texts without words form a group as any other does."""
    rows = written(near_duplicates(documents, size, budget), "labels")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "check")
    groups = rows.groupBy("label").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    ranked = written(rows.join(groups, "label").select("doc_id", "check", (place == F.col("first")).alias("stays")), "ranked")
    dropped = ranked.where("not stays").select(F.col("doc_id").alias("_id"), F.col("check").alias("_check")).distinct()
    key = documents["`doc_id`"], F.xxhash64(documents["`text`"])
    left = documents.join(dropped, key[0].eqNullSafe(F.col("_id")) & (key[1] == F.col("_check")), "left_anti")
    repeated = ranked.where("stays").groupBy("doc_id", "check").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.isEmpty():
        return left
    again = repeated.select(F.col("doc_id").alias("_id"), F.col("check").alias("_check"))
    is_again = key[0].eqNullSafe(F.col("_id")) & (key[1] == F.col("_check"))
    row = F.struct(*(documents[f"`{c}`"] for c in documents.columns)).alias("row")
    once = left.join(again, is_again, "left_semi").select(key[0].alias("id"), key[1].alias("check"), row).groupBy("id", "check").agg(F.first("row").alias("row"))
    return left.join(again, is_again, "left_anti").unionByName(once.select("row.*"))
