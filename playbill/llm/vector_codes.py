"""Vector code compression: product codebooks by Lloyd rounds over members that stay with their entry's owner.

A vector's components become integers, the vector is cut into PARTS equal parts, and each part position has a codebook of ENTRIES. The
parts are stored in a table bucketed by (position, entry, salt): an owner is the group of those three, and its members lie together. In a
round every owner sums its resident members, the sums (one row for each position and entry) give the new codebooks, and each owner looks for the
nearest entry of its members. Members whose entry stays are written to the same bucket by the task that read them; only those that change their entry
go through a shuffle, to the bucket of their new owner. The bucketed table spares the exchange that a grouping would need otherwise. The salt, a hash
of the vector, holds an owner to about MEMBERS parts even if one entry takes all of a position.

Each round's table is written to the shared folder and the one before it is removed, so a lost executor repeats its tasks of one round at most. Codebooks
(PARTS x ENTRIES rows) are the only rows that come to the driver. All arithmetic is on whole numbers, so results do not depend on order.

Defined results: vectors that are null, hold a null or non-finite component, or differ in length from that of the smallest vec_id's (taken among lengths that PARTS
divides) are dropped; components saturate at LIMIT after scaling (|x| of 16,384), so that every error fits a long, and sums of errors
saturate there. Codebooks start from the smallest distinct vec_ids; of rows with the same vec_id the one with the smallest vector counts, a null vec_id comes
last, and fewer than ENTRIES vec_ids make smaller codebooks. Repeated rows each get their row. No rows give no rows. Other columns play no part."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from playbill.llm.common import by_value
from playbill.session import new_run_dir, removed, written

by_value(__name__)

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
LIMIT = 1 << 26
#: Parts that an owner holds at most, about; buckets at most (Spark's own bound is 100,000).
MEMBERS, BUCKETS = 50_000, 50_000
OWNER = ["position", "entry", "salt"]
Codebooks = list[list[list[int]]]


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the vectors that are kept, ``v`` being their whole numbers."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-LIMIT)), F.lit(LIMIT))).cast("int"))
    rows = vectors.select(*(vectors[f"`{c}`"] for c in ("vec_id", "embedding", "label")))
    return rows.where(x.isNotNull() & finite & (F.size(x) > 0) & (F.size(x) % PARTS == 0)).select("vec_id", "label", whole.alias("v"))


def first_vectors(rows: DataFrame, k: int = ENTRIES) -> list[list[int]]:
    """Vectors of the ``k`` smallest distinct vec_ids. Every pass reads ``k`` rows at most, and more than one is made only if vec_ids repeat."""
    found: list[list[int]] = []
    last, left = None, rows.where("vec_id is not null")
    while len(found) < k:
        got = (left if last is None else left.where(F.col("vec_id") > last)).orderBy("vec_id", "v").limit(k - len(found)).collect()
        if not got:
            break
        for r in got:
            if r["vec_id"] != last and (not found or len(r["v"]) == len(found[0])):
                found.append(list(r["v"]))
            last = r["vec_id"]
    if not found:
        found = [list(r["v"]) for r in rows.orderBy("v").limit(1).collect()]
    return found


def nearest(members: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of, and squared distance to, the nearest entry of each member; the lowest index where distances tie.

    Small whole numbers are exact in doubles, for which NumPy multiplies matrices fast; others are taken as long integers."""
    kind = np.float64 if max(np.abs(members).max(initial=0), np.abs(entries).max(initial=0)) < 1 << 20 and members.shape[1] <= 1024 else np.int64
    best, error = np.empty(len(members), np.int32), np.empty(len(members), np.int64)
    entries = entries.astype(kind)
    norms = (entries * entries).sum(1)
    for at in range(0, len(members), 8192):
        x = members[at:at + 8192].astype(kind)
        apart = norms - 2 * (x @ entries.T)
        best[at:at + 8192] = index = apart.argmin(1)
        error[at:at + 8192] = apart[np.arange(len(x)), index] + (x * x).sum(1)
    return best, error


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _placed(table: pa.Table, **columns) -> pa.Table:
    for name, values in columns.items():
        at = table.schema.get_field_index(name)
        kind = table.schema.field(name).type if at >= 0 else None
        values = pa.array(values, kind)
        table = table.append_column(name, values) if at < 0 else table.set_column(at, name, values)
    return table


def parts_of(rows: DataFrame, codebooks: Codebooks, salts: int) -> DataFrame:
    """One row for each part of each vector, with the entry nearest to it: (vec_id, label, h1, h2, position, entry, salt, part)."""
    books = np.array(codebooks, np.int64)
    size = books.shape[0] * books.shape[2]
    hashes = rows.where(F.size("v") == size).select(
        "vec_id", "label", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v")).reshape(batch.num_rows, books.shape[0], -1)
            h1 = batch.column("h1").to_numpy()
            for p, entries in enumerate(books):
                part = v[:, p].astype(np.int32)
                lists = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1], part.reshape(-1))
                place = [np.full(len(part), p, np.int32), nearest(v[:, p], entries)[0], (h1 % salts).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *map(pa.array, place), lists], names=names)

    names = ["vec_id", "label", "h1", "h2", *OWNER, "part"]
    kinds = {f.name: f.dataType.simpleString() for f in hashes.schema.fields}
    schema = ", ".join(f"{n} {kinds.get(n, 'int')}" for n in names[:-1]) + ", part array<int>"
    return hashes.mapInArrow(run, schema)


class _Members:
    """The bucketed table of members, a new one for each round."""

    def __init__(self, rows: DataFrame, buckets: int):
        self.spark, self.buckets, self.path = rows.sparkSession, buckets, ""
        self.store(rows.repartition(buckets, *OWNER))

    def store(self, rows: DataFrame) -> None:
        path = new_run_dir(self.spark, "members")
        name = path.rsplit("/", 1)[1].replace("-", "_")
        rows.write.format("parquet").bucketBy(self.buckets, *OWNER).option("path", path).saveAsTable(name)
        self.drop()
        self.path, self.name, self.rows = path, name, self.spark.table(name)

    def drop(self) -> None:
        if self.path:
            self.spark.sql(f"drop table {self.name}")
            removed(self.spark, self.path)

    def sums(self) -> list:
        """(position, entry, n, total): every owner adds up its members; owners of an entry are added in Spark."""
        def add(group: pa.Table) -> pa.Table:
            total = _matrix(group.column("part")).sum(0)
            return pa.table({"position": group.column("position")[:1], "entry": group.column("entry")[:1], "n": pa.array([len(group)], pa.int64()),
                             "total": pa.array([total.tolist()], pa.list_(pa.int64()))})

        own = self.rows.select(*OWNER, "part").groupBy(*OWNER).applyInArrow(add, "position int, entry int, n long, total array<long>")
        return own.select("position", "entry", "n", F.posexplode("total").alias("at", "s")).groupBy("position", "entry", "at").agg(
            F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()

    def seen(self, codebooks: Codebooks, final: bool = False) -> DataFrame:
        """Members with their nearest entry, ``moved`` if it is another than their owner's, or with ``error`` for the last time."""
        books = np.array(codebooks, np.int64)

        def look(group: pa.Table) -> pa.Table:
            position, entry = group.column("position")[0].as_py(), group.column("entry")[0].as_py()
            best, error = nearest(_matrix(group.column("part")), books[position])
            return _placed(group, entry=best, **({"error": error} if final else {"moved": best != entry}))

        added = "error long" if final else "moved boolean"
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.rows.schema.fields)
        return self.rows.groupBy(*OWNER).applyInArrow(look, f"{schema}, {added}")

    def migrate(self, codebooks: Codebooks) -> None:
        """The next table: members that stay are written where they are, only the others are shuffled."""
        looked = self.seen(codebooks)
        stay, move = looked.where("not moved").drop("moved"), looked.where("moved").drop("moved")
        self.store(stay.unionByName(move.repartition(self.buckets, *OWNER)))


def _updated(codebooks: Codebooks, sums: list) -> Codebooks:
    """Componentwise floor of the mean; entries without members stay."""
    new = [[list(e) for e in book] for book in codebooks]
    for r in sums:
        new[r["position"]][r["entry"]][r["at"]] = int(r["s"]) // r["n"]
    return new


def compressed(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame | None, Codebooks]:
    """(vec_id, label, h1, h2, position, entry, error), a row for each part of each kept vector, and the codebooks; no table where no vector is kept."""
    rows = scaled(vectors)
    first = first_vectors(rows)
    if not first:
        return None, []
    size = len(first[0]) // PARTS
    codebooks = [[v[p * size:(p + 1) * size] for v in first] for p in range(PARTS)]
    owners = 1 + vectors.count() // MEMBERS
    buckets = min(BUCKETS, max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * owners))
    members = _Members(parts_of(rows, codebooks, owners), buckets)
    for turn in range(rounds):
        new = _updated(codebooks, members.sums())
        if new == codebooks:
            break  # no entry moves any more, so nothing does
        codebooks = new
        if turn < rounds - 1:
            members.migrate(codebooks)
    coded = written(members.seen(codebooks, final=True).select("vec_id", "label", "h1", "h2", "position", "entry", "error"), "coded")
    members.drop()
    return coded, codebooks


def codes(coded: DataFrame) -> DataFrame:
    """(vec_id, label, code, error): one row for each vector. Equal rows meet in one group, their number being that of its parts by PARTS."""
    bits = F.expr(f"bit_or(shiftleft(cast(entry as bigint), 8 * ({PARTS} - 1 - position)))")
    rows = coded.groupBy("vec_id", "label", "h1", "h2").agg(bits.alias("bits"), F.sum("error").alias("e"), F.count(F.lit(1)).alias("n"))
    copies = (F.col("n") / PARTS).cast("long")
    rows = rows.select("vec_id", "label", F.lower(F.lpad(F.hex("bits"), 2 * PARTS, "0")).alias("code"), F.expr(f"e div (n div {PARTS})").alias("error"), copies.alias("copies"))
    # Many copies of a row are dealt out before they are written one by one.
    some = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / 1000)))
    once, many = rows.where("copies = 1").drop("copies"), rows.where("copies > 1").withColumn("k", some)
    many = many.repartition("vec_id", "k").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(1000), F.col("copies") - F.col("k") * 1000))))
    return once.unionByName(many.select(*once.columns))


def decoded(coded: DataFrame, codebooks: Codebooks) -> DataFrame:
    """Rows with a ``code`` and the ``approximation`` that it stands for: each part is its entry, scaled back."""
    books = np.array(codebooks, np.int64)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields)

    def run(batches):
        for batch in batches:
            entries = np.array([list(bytes.fromhex(c)) for c in batch.column("code").to_pylist()]).reshape(-1, len(books))
            values = books[np.arange(len(books)), entries].reshape(len(entries), -1) / SCALE
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values.tolist(), pa.list_(pa.float64()))], names=[*batch.schema.names, "approximation"])

    return coded.mapInArrow(run, f"{kinds}, approximation array<double>")


def codebooks_checksum(codebooks: Codebooks) -> str:
    return hashlib.sha256(",".join(str(c) for book in codebooks for entry in book for c in entry).encode()).hexdigest()


def digest(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row for each kept vector: its code and error, the error summed over its label, and a checksum of the codebooks."""
    coded, codebooks = compressed(vectors, rounds)
    if coded is None:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    rows = codes(coded)
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    met = rows.join(by_label, rows["label"].eqNullSafe(by_label["of"]))
    return met.select("vec_id", "code", "error", "label_error", F.lit(codebooks_checksum(codebooks)).alias("codebooks_sha256"))
