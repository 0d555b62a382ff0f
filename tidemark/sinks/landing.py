"""Landing fetched envelopes as JSON documents under partitioned paths."""

from __future__ import annotations

import datetime as dt
import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from tidemark.functions.text import utc_iso
from tidemark.session import delete_folder, local_path, move_folder, path_exists, setting, small_files

DOCUMENTS_PER_BATCH = 256

# Signs that Spark escapes in the values of partition folders.
_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")


def _instant(run: Column | dt.datetime) -> Column:
    return run if isinstance(run, Column) else F.lit(run)


def _utc(run: Column, fmt: str) -> Column:
    return F.date_format(F.to_utc_timestamp(run, F.current_timezone()), fmt)


def with_metadata(
    df: DataFrame,
    run: Column | dt.datetime,
    source: str,
    run_id: Column | None = None,
    count_items: bool = True,
) -> DataFrame:
    """Add the ``_pipeline_metadata`` object; region text is trimmed and lower-cased first.

    The run id is the run clock as ``yyyyMMdd_HHmmss`` unless given.
    """
    run = _instant(run)
    run_id = _utc(run, "yyyyMMdd_HHmmss") if run_id is None else run_id
    count = [F.size(F.coalesce("items", F.array())).alias("video_count")] if count_items else []
    return df.withColumn("region", F.lower(F.trim("region"))).withColumn(
        "_pipeline_metadata",
        F.struct(
            run_id.alias("ingestion_id"),
            F.col("region"),
            utc_iso(run).alias("ingestion_timestamp"),
            *count,
            F.lit(source).alias("source"),
        ),
    )


def _allowed(df: DataFrame, regions: Sequence[str] | None) -> DataFrame:
    if regions is None:
        return df
    return df.filter(F.col("region").isin([r.strip().lower() for r in regions]))


def _dealt(rows: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Rows dealt by ranges of folders, so a task holds whole folders and its output is moved as such when
    the job ends; a hash of the row cuts a folder that has most of the documents. The number of tasks follows
    the files to create, not their bytes."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    content = F.xxhash64(*[F.col(c) for c in rows.columns if c not in levels])
    return rows.repartitionByRange(tasks, *levels, content)


def document_writer(rows: DataFrame, levels: Sequence[str]) -> DataFrameWriter:
    """A writer of one file per row below folders of ``levels``, for any file system."""
    return (
        _dealt(rows, levels)
        .write.options(**small_files(rows.sparkSession))
        .option("maxRecordsPerFile", 1)
        .partitionBy(*levels)
    )


def _file_writer(folder: str, levels: Sequence[str], suffix: str) -> Callable[[Iterator], Iterator]:
    """What a task does with (levels, content): one file per row, all below a folder of this attempt, whose
    name it returns."""
    escaped, levels = _ESCAPED, tuple(levels)

    def segment(level: str, value: str | None) -> str:
        return f"{level}={escaped.sub(lambda m: f'%{ord(m[0]):02X}', value) if value else '__HIVE_DEFAULT_PARTITION__'}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, made, n = uuid.uuid4(), None, 0
        part = f"{TaskContext.get().partitionId():05d}"
        attempt = f"{part}-{job.hex}"
        for batch in batches:
            for *values, content in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                below = "/".join([folder, attempt, *map(segment, levels, values)])
                if below != made:
                    os.makedirs(below, exist_ok=True)
                    made = below
                with open(f"{below}/part-{part}-{job}.c{n:03d}.{suffix}", "xb") as file:
                    file.write((content or b"") + b"\n")
                n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"attempt": [attempt]})

    return run


def _merge(source: str, target: str) -> None:
    """Move a folder to its place; where there is one, what it holds."""
    if not os.path.exists(target):
        os.rename(source, target)
        return
    for name in os.listdir(source):
        _merge(f"{source}/{name}", f"{target}/{name}")


def _inner(folder: str, depth: int, below: str = "") -> Iterator[str]:
    """Paths, relative to ``folder``, of its folders ``depth`` levels down."""
    if not depth:
        yield below
        return
    for entry in os.scandir(f"{folder}/{below}"):
        if entry.is_dir():
            yield from _inner(folder, depth - 1, f"{below}/{entry.name}".lstrip("/"))


def _write_files(rows: DataFrame, levels: Sequence[str], form: str, draft: str) -> str:
    """Documents below ``draft``, a folder of the shared disk: tasks create the files themselves.

    Hadoop starts a process for each folder and file that it creates there. As Spark's committer does, only
    what the attempts that ended well have written is moved together.
    """
    own = [c for c in rows.columns if c not in levels]
    text = F.to_json(F.struct(*own)) if form == "json" else F.col(*own)
    documents = _dealt(rows, levels).select(
        *[F.col(c).cast("string") for c in levels], text.cast("binary").alias("__content")
    )
    suffix = {"text": "txt"}.get(form, form)
    with setting(rows.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(DOCUMENTS_PER_BATCH)):
        ended = (
            documents.sortWithinPartitions(*levels)
            .mapInArrow(_file_writer(f"{draft}/attempts", levels, suffix), "attempt string")
            .collect()
        )
    whole = f"{draft}/documents"
    os.makedirs(whole)
    for row in ended:
        _merge(f"{draft}/attempts/{row.attempt}", whole)
    with open(f"{whole}/_SUCCESS", "xb"):
        return whole


def _settle(whole: str, root: str, depth: int, replace: bool) -> None:
    """Move written folders below a root that exists, beside or instead of those of the same path."""
    for below in list(_inner(whole, depth)):
        if replace:
            shutil.rmtree(f"{root}/{below}", ignore_errors=True)
        os.makedirs(os.path.dirname(f"{root}/{below}"), exist_ok=True)
        _merge(f"{whole}/{below}", f"{root}/{below}")


def write_documents(
    rows: DataFrame, levels: Sequence[str], root: str, form: str = "json", replace: bool = False
) -> None:
    """One file per row below folders of ``levels``: ``json`` of the other columns, or the only one as ``text``.

    Below a root that exists files are added, or with ``replace`` take the place of those in the folders that
    ``rows`` has rows for. A first landing is written beside the root, hidden, and moved there whole.
    """
    spark, root = rows.sparkSession, root.rstrip("/")
    local = local_path(spark, root)
    parent, slash, name = (local or root).rpartition("/")
    draft = f"{parent}{slash}.{name}.{uuid.uuid4().hex}"
    try:
        if local is not None:
            whole = _write_files(rows, levels, form, draft)
            if os.path.exists(local):
                _settle(whole, local, len(levels), replace)
            else:
                os.rename(whole, local)
            return
        writer = document_writer(rows, levels).format(form)
        if not path_exists(spark, root):
            writer.save(draft)
            if not path_exists(spark, root):
                move_folder(spark, draft, root)
                return
        mode = "overwrite" if replace else "append"
        writer.mode(mode).option("partitionOverwriteMode", "dynamic").save(root)
    finally:
        if local is not None:
            shutil.rmtree(draft, ignore_errors=True)
        else:
            delete_folder(spark, draft)


def _land(rows: DataFrame, root: str, run: Column, levels: Sequence[str]) -> None:
    parts = {
        "date": _utc(run, "yyyy-MM-dd"),
        "hour": _utc(run, "HH"),
        "run": F.col("_pipeline_metadata.ingestion_id"),
    }
    for level in levels:
        rows = rows.withColumn(level, parts[level])
    write_documents(rows, ["region", *levels], root, replace=True)


def land_envelopes(
    df: DataFrame,
    root: str,
    run: Column | dt.datetime,
    source: str,
    *,
    run_id: Column | None = None,
    regions: Sequence[str] | None = None,
) -> None:
    """Write one document per input row below ``region=/date=/hour=/run=``.

    Input rows hold ``region``, ``items`` and any further envelope fields. The run folder makes a
    later run of the same hour sort after an earlier one by path. Landing a run again replaces its own
    folders and touches no others, so a retry is harmless: pass all documents of a run together.
    """
    rows = _allowed(with_metadata(df, run, source, run_id), regions)
    _land(rows, root, _instant(run), ["date", "hour", "run"])


def land_reference(
    df: DataFrame,
    root: str,
    run: Column | dt.datetime,
    source: str,
    *,
    run_id: Column | None = None,
    regions: Sequence[str] | None = None,
) -> None:
    """Write one reference document per input row below ``region=/date=/run=``; a run landed again
    replaces its own folders."""
    rows = _allowed(with_metadata(df, run, source, run_id, count_items=False), regions)
    _land(rows, root, _instant(run), ["date", "run"])
