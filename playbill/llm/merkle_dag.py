"""Merkle manifest of a dataset: a store of digest-to-children records, and proofs by descent from the root.

Rows become leaves, each the digest of its fields. The leaves of one tree (one ``lang``) are ranked by ``doc_id``; runs of FAN
consecutive nodes become their digest until one node is left, the tree's root. The roots of all trees, in the order of the trees, are the leaves of a
last tree of the same kind, whose root stands for the dataset. The store holds one record (digest, children) for each distinct inner
node: it is content-addressed, so equal subtrees share their records.

A proof is found by descent. The digits of a leaf's rank to the base FAN, highest first, tell which child to take; the store gives the
children of the node's digest, and those not taken are a segment of the path. All leaves below a node share its segments, so what descends is one row for
each node that has a requested leaf below it; leaves meet their path at the last inner node. The segments, reversed, are the proof.

Defined results: a null field is ``-``; a null tree is a tree of its own, before all others; a null doc_id sorts first and is a leaf like any other;
equal doc_ids are ordered by their leaf, and repeated rows are leaves of equal digests that take their places in any order (the digests are the same).
A tree of one leaf has the leaf as its root. No rows give no root and no proofs. Other columns of the table play no part."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from playbill.llm.common import written
from playbill.llm.ordered import ranked

FAN, DIGIT = 8, 3
#: Levels that one grouping builds: a group holds FAN ** LEVELS digests at most.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def joined_digest(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of the fields, each with its length in bytes before it."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(part, fields)), 256)


@dataclass
class Manifest:
    """``leaves``: (tree, doc_id, leaf, rank, ...); ``store``: (digest, children); ``trees``: (tree, height, digest, path), ``path``
    being the segments from the root of the dataset to that of the tree; ``root``: None without leaves."""
    leaves: DataFrame
    store: DataFrame
    trees: DataFrame
    root: str | None


def _parted(digests: str) -> Column:
    """The array cut into runs of FAN."""
    last = F.shiftright(F.size(digests) - 1, DIGIT)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(digests, i * FAN + 1, F.lit(FAN)))


def _records(nodes: DataFrame, heights: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Records of all inner nodes, and (tree, height, digest) of the roots, from ``nodes`` (tree, rank, digest) and ``heights`` (tree, height).
    Each round groups FAN ** LEVELS consecutive nodes and builds their levels in place; its result is written."""
    highest = heights.agg(F.max("height")).first()[0] or 0
    roots = [nodes.join(heights.where("height = 0"), "tree").select("tree", "height", "digest")]
    records = []
    for base in range(0, highest, LEVELS):
        runs = nodes.groupBy("tree", F.shiftright("rank", DIGIT * LEVELS).alias("rank")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"]).alias("d0"))
        runs = runs.join(heights.where(F.col("height") > base), "tree")
        for j in range(LEVELS):
            made = F.transform(_parted(f"d{j}"), lambda c: F.struct(joined_digest(c).alias("digest"), c.alias("children")))
            above = F.col("height") > base + j
            runs = runs.withColumn(f"r{j}", F.when(above, made))
            runs = runs.withColumn(f"d{j + 1}", F.when(above, F.transform(f"r{j}", lambda r: r["digest"])).otherwise(F.col(f"d{j}")))
        none = F.array().cast("array<struct<digest:string,children:array<string>>>")
        made = F.flatten(F.array(*(F.coalesce(f"r{j}", none) for j in range(LEVELS))))
        runs = written(runs.select("tree", "height", "rank", made.alias("made"), F.get(f"d{LEVELS}", F.lit(0)).alias("digest")), "merkle-runs")
        records.append(runs.select(F.explode("made").alias("m")).select("m.digest", "m.children"))
        roots.append(runs.where(F.col("height") <= base + LEVELS).select("tree", "height", "digest"))
        nodes = runs.where(F.col("height") > base + LEVELS).select("tree", "rank", "digest")
    whole = roots[0]
    for more in roots[1:]:
        whole = whole.unionByName(more)
    return records, written(whole, "merkle-roots")


def _heights(leaves: DataFrame) -> DataFrame:
    """Smallest height whose FAN ** height places hold the leaves of each tree."""
    n = F.count(F.lit(1))
    bits = F.length(F.bin(n - 1))
    return leaves.groupBy("tree").agg(F.when(n == 1, 0).otherwise(F.floor((bits + DIGIT - 1) / DIGIT)).cast("int").alias("height"))


def _store(records: list[DataFrame], leaves: DataFrame) -> DataFrame:
    store = leaves.sparkSession.createDataFrame([], "digest string, children array<string>")
    for more in records:
        store = store.unionByName(more)
    return store.groupBy("digest").agg(F.first("children").alias("children"))


def manifest(leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves``: (tree, doc_id, leaf) and any other columns, with a tree never null."""
    spark = leaves.sparkSession
    leaves = written(ranked(written(leaves, "merkle-leaves"), "tree", "doc_id", "leaf"), "merkle-ranked")
    heights = written(_heights(leaves), "merkle-heights")
    records, roots = _records(leaves.select("tree", "rank", F.col("leaf").alias("digest")), heights)
    top = ranked(roots.select(F.lit("").alias("all"), "tree", "height", "digest"), "all", "tree", name="merkle-trees")
    top = written(top.select(F.col("all").alias("tree"), "rank", F.col("tree").alias("name"), F.col("height").alias("name_height"), "digest"), "merkle-top")
    top_records, top_roots = _records(top.select("tree", "rank", "digest"), written(_heights(top), "merkle-heights"))
    store = written(_store(records + top_records, leaves), "merkle-store")
    found = top_roots.first()
    if found is None:
        empty = "tree string, height int, digest string, path array<struct<left:string,right:string>>"
        return Manifest(leaves, store, spark.createDataFrame([], empty), None)
    start = top_roots.withColumn("path", F.array().cast("array<struct<left:string,right:string>>"))
    paths = descended(store, start, top.select("tree", "rank", "name", "name_height", F.col("digest").alias("name_digest")))
    trees = written(paths.select(F.col("name").alias("tree"), F.col("name_height").alias("height"), F.col("name_digest").alias("digest"), "path"), "merkle-trees")
    return Manifest(leaves, store, trees, found["digest"])


def segment(children: Column, digit: Column) -> Column:
    """The children not taken, before and after the one that is."""
    return F.struct(F.array_join(F.slice(children, F.lit(1), digit), "").alias("left"),
                    F.array_join(F.slice(children, digit + 2, F.lit(FAN)), "").alias("right"))


def descended(store: DataFrame, trees: DataFrame, requests: DataFrame, every: bool = True) -> DataFrame:
    """``requests`` (tree, rank, ...) with ``path`` from the root of the dataset to the leaf, and ``subroot``, the root of its tree.

    ``trees`` are the roots to start from. One row for each node descends, a level at a time: it meets its record by digest and
    becomes a row for each child. With ``every`` all leaves are requested; else only nodes above a requested leaf are followed."""
    highest = trees.agg(F.max("height")).first()[0] or 0
    wanted: dict[int, DataFrame] = {}
    if not every:
        below = requests.select("tree", F.col("rank").alias("node"))
        for level in range(1, highest + 1):
            below = written(below.select("tree", F.shiftright("node", DIGIT).alias("node")).distinct(), "merkle-wanted")
            wanted[level] = below
    starts = trees.select("tree", "height", F.lit(0).cast("long").alias("node"), "digest", "path", F.col("digest").alias("subroot"))
    runs = starts.where("height = 0").select("tree", "node", F.lit(None).cast("array<string>").alias("children"), "path", "subroot")
    nodes = None
    for level in range(highest, 0, -1):
        entering = starts.where(F.col("height") == level).drop("height")
        nodes = entering if nodes is None else nodes.unionByName(entering)
        if not every:
            nodes = nodes.join(wanted[level], ["tree", "node"], "left_semi")
        opened = nodes.join(store, "digest").select("tree", "node", "children", "path", "subroot")
        if level == 1:
            runs = runs.unionByName(opened)
            break
        nodes = opened.select("*", F.posexplode("children").alias("digit", "digest")).select(
            "tree", (F.shiftleft("node", DIGIT) + F.col("digit")).alias("node"), "digest",
            F.array_append("path", segment(F.col("children"), F.col("digit"))).alias("path"), "subroot")
    runs = written(runs, "merkle-runs").withColumnRenamed("node", "run")
    last = segment(F.col("children"), F.pmod("rank", F.lit(FAN)).cast("int"))
    met = requests.withColumn("run", F.shiftright("rank", DIGIT)).join(runs, ["tree", "run"])
    return met.withColumn("path", F.when(F.col("children").isNull(), F.col("path")).otherwise(F.array_append("path", last))).drop("run", "children")


def proofs(found: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """Leaves with ``proof``, the segments from the leaf up to the root, and ``subroot``; of ``requests`` (tree, rank, ...) or of every leaf."""
    paths = descended(found.store, found.trees, found.leaves if requests is None else requests, requests is None)
    return paths.withColumn("proof", F.reverse("path")).drop("path")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def document_leaves(documents: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, claim): ``claim`` is the leaf of the tampered row, null where nothing was tampered with."""
    rows = documents.select(*(documents[f"`{c}`"] for c in FIELDS))
    fields = [F.col(c) for c in FIELDS]
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    lower = leaf_digest([*fields[:-1], F.translate("text", UPPER, LOWER)])
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return rows.select(tree.alias("tree"), "doc_id", leaf_digest(fields).alias("leaf"), F.when(tampered, lower).alias("claim"))


def digest(documents: DataFrame) -> DataFrame:
    """Every document's leaf, its proof's checksum, and the root that the (sometimes tampered) document leads to."""
    found = manifest(document_leaves(documents))
    rows = proofs(found).select("doc_id", "leaf", "subroot", F.lit(found.root).cast("string").alias("root"), "claim", "proof")
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
                       folded(F.coalesce("claim", "leaf"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
