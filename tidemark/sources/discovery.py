"""Finding files and the newest batch without opening a file."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.keys import Batch, as_batch
from tidemark.session import glob_paths, inner_folders, setting, small_files

FILE_COLUMNS = "path string, modificationTime timestamp, length bigint, content binary"

# Folders that a listing is spread over: the first level of so many, and never more than that.
FOLDERS, MOST_FOLDERS = 64, 4096
LISTING_TASKS = 256
_DISCOVERY = "spark.sql.sources.parallelPartitionDiscovery"
_GLOB_SIGNS = re.compile(r"[{}\[\]*?\\]")

# Fixed layout of the snapshot folders.
_DATE_FOLDER = re.compile(r"/region=[^/]+/date=(\d{4}-\d{2}-\d{2})$")
_HOUR_FOLDER = re.compile(r"/hour=(\d{2})$")


def _listing_folders(spark: SparkSession, root: str) -> list[str]:
    """Folders that hold all files below ``root``: of the first level that has enough of them."""
    folders = [root]
    inner = glob_paths(spark, root)
    while inner and not any(map(_GLOB_SIGNS.search, inner)):
        folders = inner
        if len(folders) >= FOLDERS:
            break
        inner = inner_folders(spark, folders, MOST_FOLDERS)
    return folders


def lookup_tasks(spark: SparkSession) -> int:
    """Tasks that look up a list of files: Spark would start one for each."""
    return min(LISTING_TASKS, 2 * spark.sparkContext.defaultParallelism)


def scan_files(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*.json") -> DataFrame:
    """Every file below a folder, or a list of files, as Spark's ``binaryFile`` rows.

    A folder is listed by one job: left to itself, Spark starts a job for each folder that holds many
    others, with a task for each of these. The files of a list are looked up by a few tasks, not by one each.
    """
    reader = (
        spark.read.format("binaryFile")
        .schema(FILE_COLUMNS)
        .options(**small_files(spark))
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
    )
    # Where blocks lie matters little for small documents, and would be half of what listing sends to the driver.
    with setting(spark, "spark.sql.sources.ignoreDataLocality", "true"):
        if not isinstance(paths, str):
            with setting(spark, f"{_DISCOVERY}.parallelism", str(lookup_tasks(spark))):
                return reader.load(list(paths))
        with setting(spark, f"{_DISCOVERY}.threshold", "0"), setting(spark, f"{_DISCOVERY}.parallelism", str(LISTING_TASKS)):
            return reader.load(_listing_folders(spark, paths))


def list_files(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """Path, time and size of every file below ``root``. Content is pruned, so nothing is read."""
    return scan_files(spark, root, pattern).select("path", "modificationTime", "length")


def batch_glob(root: str, batch: Batch | None) -> str:
    """Only the folders of one batch; without a batch the whole root."""
    if batch is None:
        return root
    return f"{root.rstrip('/')}/region=*/date={batch.date.isoformat()}/hour={batch.hour:02d}"


def discover_latest_batch(spark: SparkSession, root: str, pattern: str = "*.json") -> Batch:
    """The newest landed batch that holds a file; fails when there is none.

    Only date folders are listed for all history, hour folders for the newest date alone (going back
    only while a date holds no file), and files only in the newest of them.
    """
    base = f"{root.rstrip('/')}/region=*"

    def newest(folders: list[str], pattern: re.Pattern) -> list[str]:
        return sorted({m[1] for m in map(pattern.search, folders) if m}, reverse=True)

    for date in newest(glob_paths(spark, f"{base}/date=*"), _DATE_FOLDER):
        for hour in newest(glob_paths(spark, f"{base}/date={date}/hour=*"), _HOUR_FOLDER):
            batch = as_batch(date, hour)
            if not list_files(spark, batch_glob(root, batch), pattern).isEmpty():
                return batch
    raise ValueError(f"no valid batch found below {root}")
