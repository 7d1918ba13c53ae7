"""A keyed table that grows by versions: readers see whole versions only, and of two writers that read the same version one wins.

A version is a small file that names the folders of its rows: a base, bucketed and sorted by the key, and the appends since. A writer writes its rows to a
new folder first, checks them there, and then publishes the next version by a rename that fails if that version exists; a writer that comes
too late raises ``StaleVersion`` and its folder is never read. (The rename must not replace a file: file systems with atomic renames give that;
a local disk checks first, which is enough for one machine.)

Keys are unique: an append is refused if it repeats a key, its own or one of the version it was made from. Lookups join the
base by its buckets, so only the requests are shuffled; appends are small, and ``compact`` moves them into a new base, reading the old one by its buckets too.

Parquet files that lie in the folder itself are read as an append of the first version, so a plain table may become a versioned one."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from playbill.sources.keys import assert_unique

VERSIONS, DATA = "_versions", "_data"


class StaleVersion(RuntimeError):
    """Another writer published first; read the table again."""


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    base: str | None = None
    buckets: int = 0
    appends: list[str] = field(default_factory=list)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(conf)
        self._jvm, self._conf = jvm, conf

    # Versions.

    def exists(self) -> bool:
        return self._files.exists(self._path(f"{self.path}/{VERSIONS}"))

    def manifest(self) -> Manifest:
        """The newest version; number 0 is what lies in the folder itself, or nothing."""
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(f"{self.path}/{VERSIONS}"))] if self.exists() else []
        published = sorted(n for n in names if n.endswith(".json") and not n.startswith("."))
        if not published:
            plain = self._files.globStatus(self._path(f"{self.path}/*.parquet"))
            return Manifest(appends=["."] if plain is not None and len(plain) else [])
        stream = self._files.open(self._path(f"{self.path}/{VERSIONS}/{published[-1]}"))
        try:
            return Manifest(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _publish(self, new: Manifest) -> None:
        folder = f"{self.path}/{VERSIONS}"
        self._files.mkdirs(self._path(folder))
        draft, final = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/{new.version:012d}.json")
        out = self._files.create(draft, False)
        out.write(json.dumps(new.__dict__).encode())
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(self._conf).getUri(), self._conf)
        keep = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, keep)
        except Exception as exc:
            self._files.delete(draft, False)
            if "FileAlreadyExists" in str(exc):
                raise StaleVersion(f"{self.path}: version {new.version} was published by another writer") from None
            raise

    # Rows.

    def _base(self, at: Manifest) -> DataFrame:
        """The base as a table that Spark knows to be bucketed."""
        name = f"base_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {at.buckets} BUCKETS LOCATION '{self.path}/{at.base}'")
        return self.spark.table(name)

    def _appends(self, at: Manifest) -> DataFrame:
        if not at.appends:
            return self.spark.createDataFrame([], self.schema)
        rows = None
        # A folder's own files are listed apart from what lies in its data folder.
        for folder in (["."] if "." in at.appends else []), [a for a in at.appends if a != "."]:
            if folder:
                part = self.spark.read.schema(self.schema).parquet(*(self.path if a == "." else f"{self.path}/{a}" for a in folder))
                rows = part if rows is None else rows.unionByName(part)
        return rows

    def read(self, at: Manifest | None = None) -> DataFrame:
        at = self.manifest() if at is None else at
        appends = self._appends(at)
        return appends if at.base is None else self._base(at).unionByName(appends)

    def missing(self, requested: DataFrame, at: Manifest | None = None) -> DataFrame:
        """Requested rows whose key the table lacks; the base is not shuffled."""
        at = self.manifest() if at is None else at
        if at.base is not None:
            requested = requested.join(self._base(at).select(self.key), self.key, "left_anti")
        return requested.join(self._appends(at).select(self.key), self.key, "left_anti") if at.appends else requested

    def found(self, requested: DataFrame, at: Manifest | None = None) -> DataFrame:
        """Rows of the table that are requested; the base is not shuffled."""
        at = self.manifest() if at is None else at
        keys = requested.select(self.key)
        parts = [] if at.base is None else [self._base(at)]
        if at.appends or not parts:
            parts.append(self._appends(at))
        parts = [p.join(keys, self.key, "left_semi") for p in parts]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    # Writers.

    def append(self, rows: DataFrame, at: Manifest) -> Manifest:
        """Publish ``rows`` after version ``at``, the one they were made from. Only they are written; the table may be an input of them."""
        folder = f"{DATA}/{uuid.uuid4().hex}"
        rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)).write.parquet(f"{self.path}/{folder}")
        new = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}")
        assert_unique(new, self.key)
        if new.isEmpty():
            return at
        twice = self.found(new, at).select(self.key).first()
        if twice is not None:
            raise ValueError(f"{self.key}={twice[0]} is in the table already")
        made = Manifest(at.version + 1, at.base, at.buckets, [*at.appends, folder])
        self._publish(made)
        return made

    def compact(self, buckets: int, at: Manifest | None = None) -> Manifest:
        """Publish a version of one bucketed and sorted base. The old base is read by its buckets: with the same number of them only the appends are shuffled."""
        at = self.manifest() if at is None else at
        folder = f"{DATA}/{uuid.uuid4().hex}"
        rows = self._appends(at).repartition(buckets, self.key)
        if at.base is not None:
            base = self._base(at)
            rows = (base if at.buckets == buckets else base.repartition(buckets, self.key)).unionByName(rows)
        name = f"compact_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(buckets, self.key).sortBy(self.key).option("path", f"{self.path}/{folder}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        made = Manifest(at.version + 1, folder, buckets, [])
        self._publish(made)
        return made
