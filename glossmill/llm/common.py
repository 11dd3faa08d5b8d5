"""Helpers shared by the training-data operators: tables, the shared folder, materialised intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes handed to Python at once; a longer text makes a batch of its own.
ARROW_BYTES = 4 << 20
#: A key that holds more than one row in HOT is hot: there are fewer than HOT of these, whatever the size of the table.
HOT = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound the bytes of the batches that Python gets (a session setting that changes no result), and ship this package to the executors once for each application."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        name = Path(tempfile.mkdtemp(prefix="glossmill-")) / f"{package.name}.zip"
        with zipfile.ZipFile(name, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(name))
        _shipped.add(context.applicationId)


_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found is None:
        found = spark.conf.get("spark.glossmill.shared.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="glossmill-")
        spark.conf.set("spark.glossmill.shared.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read again: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What materialize() has written and nobody has removed yet.
_written: list[str] = []


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Remove what materialize() wrote, when nothing lazily reads it any more."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        _remove(df.sparkSession, folder)


def written() -> int:
    """How many tables materialize() has written so far; sweep() takes it."""
    return len(_written)


def sweep(spark: SparkSession, since: int, last: bool = True) -> None:
    """Remove the tables written since then, when nothing lazily reads them any more; with last the newest stays."""
    gone = _written[since:-1] if last else _written[since:]
    for folder in gone:
        _remove(spark, folder)
    _written[since:] = _written[-1:] if last else []


def with_row_id(docs: DataFrame, name: str = "gm_row") -> DataFrame:
    """docs with a column that tells rows apart, also those that are equal in all columns.

    Rows that come straight from Parquet files are known by file and place, which needs no copy and is the same in every scan. Others are
    written once with a number.
    """
    if "_metadata#" not in docs._jdf.queryExecution().analyzed().metadataOutput().toString():  # not a scan of files
        return materialize(docs.withColumn(name, F.struct(F.lit(0).cast("long").alias("f"), F.monotonically_increasing_id().alias("i"))), "rows")
    return docs.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").cast("long").alias("i")))


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """The rows of counts (one a key, n: its rows) whose key is hot: fewer than HOT, small enough to broadcast."""
    total = counts.agg(F.sum(n)).first()[0] or 0  # one number
    return counts.filter(F.col(n) > max(1, total // HOT))


def join_by(rows: DataFrame, facts: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """rows joined with facts (one row a key): hot keys by broadcast, so that none gathers in a task, the others by shuffle."""
    keys = F.broadcast(hot.select(key))
    few = F.broadcast(facts.join(keys, key, "left_semi"))
    often = rows.join(keys, key, "left_semi").join(few, key, "left")
    return often.unionByName(rows.join(keys, key, "left_anti").join(facts.hint("merge"), key))


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and a path in it, for executors that write or read plain files."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def commit_name() -> str:
    """A file name of this task attempt alone, so that a second attempt never writes over the first."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
