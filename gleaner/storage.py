"""Tables that outlive a plan: lineage is cut in a folder that all executors share."""

from __future__ import annotations

import contextlib
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: With it, Spark deletes a query's shuffle files as it ends; the written table has replaced them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: dict[str, str] = {}
_owner = [""]


@contextlib.contextmanager
def owned(name: str):
    """Tables materialised inside belong to `name` and go with release(owner=name)."""
    _owner.append(name)
    try:
        yield
    finally:
        _owner.pop()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gleaner-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


@contextlib.contextmanager
def _cleaned(spark: SparkSession):
    """Shuffle files of queries that run inside go as each ends."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and return a reader of it.

    Unlike localCheckpoint() the rows survive the loss of any executor, and
    unlike checkpoint() they are columnar and compressed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    _written[path] = _owner[-1]
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, count: int, name: str = "table", into: str | None = None) -> DataFrame:
    """materialise() in `count` buckets of a column, so that groups and joins by it need no exchange of the table.

    into: the name of a table of the same buckets that gets the rows besides its own, or of a new one.
    """
    spark = df.sparkSession
    own = into or f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{own}"
    with _cleaned(spark):
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(count, column).mode("append").saveAsTable(own)
    _written[path] = _owner[-1]
    return spark.table(own)


def release(spark: SparkSession, df: DataFrame | None = None, owner: str | None = None) -> None:
    """Delete tables of materialise(): those df reads, or those of an owner. Nothing may read them later."""
    jvm = spark.sparkContext._jvm
    if df is not None:
        files = df.inputFiles()
        gone = [p for p in _written if any(p.rsplit("/", 1)[1] in f for f in files)]
    else:
        gone = [p for p, who in _written.items() if who == owner]
    for path in gone:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        del _written[path]


def ship(spark: SparkSession) -> None:
    """Send this package to Python workers that start without it on their path; once for a context."""
    context = spark.sparkContext
    if getattr(context, "_gleaner_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(n for n in names if n.endswith(".py")):
                at = os.path.join(folder, name)
                z.write(at, os.path.join(os.path.basename(here), os.path.relpath(at, here)))
    path = f"{shared_dir(spark)}/gleaner-{uuid.uuid4().hex}.zip"
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(context._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(packed.getvalue()))
    finally:
        out.close()
    context.addPyFile(path)
    context._gleaner_shipped = True


def partitions(spark: SparkSession) -> int:
    """How many parts an exchange has; the cluster scales it with the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
