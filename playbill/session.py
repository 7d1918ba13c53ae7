"""Session settings the operators rely on, and the shared folder for written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Settings that change results (duplicate JSON keys: the last one wins) or keep skewed joins
    splittable even where the split costs one more shuffle."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="playbill-")
    return _local_dirs[app]


def new_run_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(rows: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``rows`` to a new folder of the shared directory and read them back: several uses then
    cost one computation, and a lost executor repeats none of it. With ``by`` each value of that column has a folder
    of its own, so that a filter on it reads no other rows."""
    path = new_run_dir(rows.sparkSession, name)
    (rows.write.partitionBy(by) if by else rows.write).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``new_run_dir`` named, once nothing will read it again."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
