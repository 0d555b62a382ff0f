"""Session helpers: a local session for tests, and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

LOCAL_FILE_SYSTEMS = (
    "org.apache.hadoop.fs.LocalFileSystem",
    "org.apache.hadoop.fs.RawLocalFileSystem",
    "org.apache.hadoop.hive.ql.io.ProxyLocalFileSystem",  # the one for file: where Spark has its Hive classes
)


def local_session(cores: int | str = "*", app: str = "tidemark", **conf: str) -> SparkSession:
    """A single-machine session. On a cluster the deployment provides the session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        # Tables with many small partitions are bound by file creation on a local disk: skip the
        # checksum files, and let small writes keep several tasks.
        .config("spark.hadoop.fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster such a folder exists on
    one machine only.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write an intermediate result to ``path`` and continue from the written copy.

    Consumers read only the columns they need, the optimizer sees true file sizes, and a lost
    executor costs a re-read instead of a recomputation from the sources.
    """
    df.write.mode("overwrite").options(**small_files(df.sparkSession)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_files(spark: SparkSession) -> dict[str, str]:
    """Options for reading and writing very many small files.

    On a local disk without Hadoop's native library a file with a checksum costs four processes, without one
    a single process. Other file systems are not concerned; one that the session sets for ``file:`` stays.
    """
    if spark._jsc.hadoopConfiguration().get("fs.file.impl"):
        return {}
    return {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _filesystem(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _filesystem(spark, path)
    return fs.exists(target)


def current_folder(spark: SparkSession, path: str) -> str:
    """The folder that holds a dataset now: its path, or the version before it while it is being swapped."""
    return f"{path}.old" if not path_exists(spark, path) and path_exists(spark, f"{path}.old") else path


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path on a disk that driver and tasks share, if one of the usual file systems for ``file:`` is in
    charge of it."""
    fs, target = _filesystem(spark, path)
    usual = fs.getClass().getName() in LOCAL_FILE_SYSTEMS
    return fs.makeQualified(target).toUri().getPath() if usual else None


def move_folder(spark: SparkSession, path: str, to: str) -> None:
    """Give a folder another path, which must be free."""
    fs, source = _filesystem(spark, path)
    _, target = _filesystem(spark, to)
    if fs.exists(target) or not fs.rename(source, target):
        raise OSError(f"cannot move {path} to {to}")


def glob_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Files and folders that match a path pattern."""
    fs, target = _filesystem(spark, pattern)
    return [status.getPath().toString() for status in fs.globStatus(target) or []]


def inner_folders(spark: SparkSession, folders: list[str], most: int) -> list[str] | None:
    """The folders in ``folders``; None when there are more than ``most`` entries, or files beside them.

    Hidden entries are left out, as Spark's readers do.
    """
    listed = []
    for folder in folders:
        fs, target = _filesystem(spark, folder)
        listed.append(fs.listStatus(target))
        if sum(map(len, listed)) > most:
            return None
    inner = []
    for status in (status for statuses in listed for status in statuses):
        name = status.getPath().getName()
        if name.startswith(".") or (name.startswith("_") and "=" not in name):
            continue
        if not status.isDirectory():
            return None
        inner.append(status.getPath().toString())
    return inner


def folder_size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    fs, target = _filesystem(spark, path)
    return fs.getContentSummary(target).getLength()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file that appears whole or not at all; fails if it exists."""
    fs, target = _filesystem(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    _, draft = _filesystem(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, target):
        raise FileExistsError(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder and what it holds, if it exists."""
    fs, target = _filesystem(spark, path)
    fs.delete(target, True)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a path made by :func:`scratch`; anything else is refused."""
    if not path.startswith(f"{shared_dir(spark)}/tidemark/"):
        raise ValueError(f"not a scratch path: {path}")
    fs, target = _filesystem(spark, path)
    fs.delete(target, True)
