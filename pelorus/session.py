"""Where jobs keep what must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset a temporary one, on one machine only.

    Executors on other machines would each write to a disk of their own, so there it is an error.
    """
    context = spark.sparkContext
    known = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not known:
        if not (context.master or "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="pelorus-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(known)
    return context.getCheckpointDir() or known


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/pelorus-{spark.sparkContext.applicationId}"
    fs, at = _folder(spark, path)
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return path


def release(spark: SparkSession, *paths: str) -> None:
    """Deletes paths, or all that this application keeps; what was read from there can't be read again."""
    for path in paths or (own_dir(spark),):
        fs, at = _folder(spark, path)
        fs.delete(at, True)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, at = _folder(spark, path)
    fs.mkdirs(at)


def move_files(spark: SparkSession, source: str, target: str, prefix: str) -> int:
    """Moves the data files of one folder into another under a prefix; how many there were, none without the folder."""
    fs, at = _folder(spark, source)
    if not fs.exists(at):
        return 0
    names = [f.getPath().getName() for f in fs.listStatus(at) if f.isFile()]
    names = [n for n in names if not n.startswith(("_", "."))]
    for n in names:
        if not fs.rename(_folder(spark, f"{source}/{n}")[1], _folder(spark, f"{target}/{prefix}{n}")[1]):
            raise OSError(f"could not move {source}/{n}")
    return len(names)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df written to the shared folder as a table and read back."""
    return stored_at(df, shared_path(df.sparkSession, name), *partition_by)


def stored_at(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """df written to a path as a table and read back, for those who delete it again."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df computed now and kept in the shared folder; later plans start from its files.

    A written table rather than checkpoint(): that carries the constraints of its plan into the next, and
    over the rounds of a loop they outgrow the driver.
    """
    return stored(df, "cut")


def widened(table: DataFrame) -> DataFrame:
    """A table as read, spread over all cores where its files make fewer partitions than there are.

    Such a table is small: the engine splits files at spark.sql.files.maxPartitionBytes. For work that is dear by the row.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
