"""Reference documents into the current dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.paths import region_from_path
from tidemark.functions.text import strip, utc_iso
from tidemark.operators.keys import restrict_to
from tidemark.operators.merge import upsert
from tidemark.operators.quality import require_unique_columns
from tidemark.operators.ranking import keep_last
from tidemark.operators.reshape import normalize_columns
from tidemark.plans.silver import OPEN_COST
from tidemark.schemas import REFERENCE, REFERENCE_KEYS, REFERENCE_PARTITIONS
from tidemark.session import drop_scratch, path_exists, scratch, setting, small_files, stage
from tidemark.sinks.partitions import finish_swap, swap_dataset, write_partitions
from tidemark.sources.reference import POS, read_reference, reference_items, reference_status
from tidemark.sources.tables import read_or_empty


def _standard_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("id", strip(F.col("id").cast("string"))).withColumn(
        "region", F.lower(strip(F.col("region").cast("string")))
    )


# The newer run wins; within one run the last file, and in it the last position.
NEWEST = ("ingestion_timestamp", "source_file", POS)


_RIVAL = "__rival"


def merge_reference(
    existing: DataFrame, incoming: DataFrame, order: Sequence[str] = NEWEST, rivals: DataFrame | None = None
) -> DataFrame:
    """The dimension after an upsert of tagged incoming rows on ``(region, id)``.

    ``rivals`` names files (``key``) whose stored rows give way by ``order`` only, as if they came along.
    """
    stored, rival = _standard_keys(normalize_columns(existing)), None
    if rivals is not None and "source_file" in stored.columns:
        marked = rivals.select(F.col("key").alias("source_file"), F.lit(True).alias(_RIVAL))
        stored, rival = stored.join(marked, "source_file", "left").select(*stored.columns, _RIVAL), F.col(_RIVAL)
    known = [c for c in order if c in incoming.columns]
    return require_unique_columns(upsert(stored, incoming, REFERENCE_KEYS, known, rival).drop(POS, _RIVAL))


def _files_can_stay(existing: DataFrame, incoming: DataFrame) -> bool:
    """Whether files of untouched regions agree with the merged rows: same column names and types (of a stored
    text, whatever comes becomes text), and regions in normal form."""
    stored = {f.name: f.dataType for f in existing.schema}
    if normalize_columns(existing).columns != existing.columns:
        return False
    if any(stored.get(f.name, f.dataType) not in (f.dataType, T.StringType()) for f in incoming.schema):
        return False
    region = F.col("region")
    odd = region.isNull() | (region != F.lower(strip(region.cast("string"))))
    return existing.filter(odd).isEmpty()


def upsert_reference(
    spark: SparkSession,
    paths: str | Sequence[str],
    target: str,
    ingestion_timestamp: str | None = None,
    report: str | None = None,
    pattern: str = "*.json",
    rivals: DataFrame | None = None,
) -> DataFrame:
    """Upsert a set of reference files into the dimension at ``target``; returns the report.

    Files are read and judged once, each by itself. All usable ones are merged in one job. Only the
    regions they touch are rewritten. The whole dataset is when stored names or regions are not in
    normal form, or when a column changes its type (files of untouched regions would keep the old one): a
    new version is then written beside the target and swapped in, so readers see the old or the new one.
    Merged rows are written to the shared folder before the target is replaced, since a job must not
    overwrite what it is reading; after a failure they are still there.

    The report, written to ``report`` (a folder of its own without it), has a row per file: key, region,
    elements found (``incoming_rows``), rows of its distinct ids (``distinct_rows``), rows of its region
    in the new dimension (``final_rows``), rows of the whole dimension (``dimension_rows``), and the error
    of an unusable file. Of a name that an object repeats the last value counts. ``rivals`` as in
    :func:`merge_reference`.
    """
    # Documents are small: at the usual cost of opening a file a task would read some 30, and write as little.
    with setting(spark, "spark.sql.variant.allowDuplicateKeys", "true"), setting(spark, "spark.sql.files.openCostInBytes", OPEN_COST):
        return _upsert(spark, paths, target, ingestion_timestamp, report, pattern, rivals)


def _upsert(
    spark: SparkSession, paths: str | Sequence[str], target: str, ingestion_timestamp: str | None, report: str | None,
    pattern: str, rivals: DataFrame | None = None,
) -> DataFrame:
    stamp = F.lit(ingestion_timestamp) if ingestion_timestamp else utc_iso(F.current_timestamp())
    work = scratch(spark)
    finish_swap(spark, target)
    documents = stage(read_reference(spark, paths, pattern=pattern), f"{work}/documents")
    status = reference_status(documents)
    usable = status.filter(F.col("error").isNull())
    changed = not usable.isEmpty()
    if changed:
        incoming = reference_items(documents, stamp)
        existing = read_or_empty(spark, target, REFERENCE)
        by_region = _files_can_stay(existing, incoming)
        if by_region:
            existing = restrict_to(existing, usable.select("region").distinct(), ["region"])
        merged = stage(merge_reference(existing, incoming, rivals=rivals), f"{work}/merged")
        (write_partitions if by_region else swap_dataset)(merged, target, REFERENCE_PARTITIONS)
    # What was just written is in normal form, so its columns need not be looked up in its files once more.
    stored = spark.read.schema("region string").parquet(target) if changed else read_or_empty(spark, target, REFERENCE)
    sizes = stored.groupBy("region").agg(F.count(F.lit(1)).alias("rows"))
    total = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("dimension_rows"))
    final = F.when(F.col("error").isNull(), F.coalesce("rows", F.lit(0))).otherwise(0).cast("bigint")
    outcome = stage(
        status.join(sizes, "region", "left")
        .crossJoin(total)  # one row
        .withColumn("final_rows", final)
        .select("key", "region", "incoming_rows", "distinct_rows", "final_rows", "dimension_rows", "error"),
        report or f"{scratch(spark)}/report",
    )
    drop_scratch(spark, work)
    return outcome


def upsert_each(
    spark: SparkSession,
    files: Sequence[str],
    target: str,
    ingestion_timestamp: str | None = None,
    report: str | None = None,
    pattern: str = "*.json",
    merged: str | None = None,
) -> int:
    """Upsert a bounded list of files; one that fails, for whatever cause, does not stop the others.

    When the upsert of all fails it is halved until the bad file stands alone: that one is set aside with
    its error in the report, and the others are merged. Files are merged in the order of their names, as
    :data:`NEWEST` orders them, so halves give the same dimension as the whole. A failure of all files, if
    there are several, is not theirs and is raised; so is that of a session that has ended. ``report`` is
    appended to. Calls that share a folder ``merged``, which keeps the names of the files, also give the same
    dimension as one call with the files of all, if they share the timestamp. Returns how many files were
    set aside.
    """
    bad: list[tuple[str, Exception]] = []

    def merge(some: Sequence[str]) -> None:
        work = scratch(spark)
        try:
            earlier = spark.read.schema("key string").parquet(merged) if merged and path_exists(spark, merged) else None
            outcome = upsert_reference(spark, some, target, ingestion_timestamp, f"{work}/report", pattern, earlier)
        except Exception as error:
            if spark.sparkContext._jsc is None:
                raise
            if len(some) == 1:
                bad.append((some[0], error))
                return
            half = len(some) // 2
            merge(some[:half])
            merge(some[half:])
            return
        if report:
            outcome.write.mode("append").parquet(report)
        if merged:
            usable = outcome.filter(F.col("error").isNull()).select("key")
            usable.coalesce(1).write.mode("append").options(**small_files(spark)).parquet(merged)
        drop_scratch(spark, work)

    merge(sorted(files))
    if bad and len(bad) == len(files) > 1:
        raise bad[0][1]
    if bad and report:
        rows = [(path, f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}") for path, error in bad]
        region = F.lower(strip(region_from_path(F.col("key"), "unknown")))
        zeros = [F.lit(0).cast("bigint").alias(c) for c in ("incoming_rows", "distinct_rows", "final_rows")]
        size = read_or_empty(spark, target, REFERENCE).count()
        (
            spark.createDataFrame(rows, "key string, error string")
            .select("key", region.alias("region"), *zeros, F.lit(size).cast("bigint").alias("dimension_rows"), "error")
            .write.mode("append")
            .parquet(report)
        )
    return len(bad)


def replace_regions(
    df: DataFrame, target: str, key: Sequence[str] = ("id",), order: Sequence[str] = NEWEST
) -> None:
    """Older form of the dimension load: the last row per id and region replaces the region."""
    known = [c for c in order if c in df.columns]
    write_partitions(keep_last(df, ["region", *key], known).drop(POS), target, REFERENCE_PARTITIONS)
