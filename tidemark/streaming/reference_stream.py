"""Reference files upserted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.dimension import upsert_each
from tidemark.session import delete_folder
from tidemark.sources.discovery import FILE_COLUMNS, lookup_tasks


def _listing_session(spark: SparkSession) -> SparkSession:
    """A copy of the session in which few tasks look up the files of a micro-batch, instead of one for each.

    The settings have to last as long as the stream runs, and nothing else should see them.
    """
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", lookup_tasks(spark))
    own.conf.set("spark.sql.sources.ignoreDataLocality", True)
    return own


def stream_reference(
    spark: SparkSession,
    root: str,
    target: str,
    checkpoint: str,
    *,
    ingestion_timestamp: str | None = None,
    files_per_batch: int = 1000,
    pattern: str = "*.json",
    report: str | None = None,
) -> StreamingQuery:
    """Process every file not seen before, then stop. Call again for later files.

    The stream carries only paths (at most ``files_per_batch`` per micro-batch); each micro-batch
    reads its files and infers their schema, so new fields need no restart. The upsert is
    idempotent, so a micro-batch repeated after a failure changes nothing. A file whose upsert fails is
    set aside, and the others of its micro-batch are merged. Spark deals files to micro-batches by their times;
    with ``ingestion_timestamp`` the files of one run are still merged in the order of their names, as one set
    of files is, wherever it was cut. Rows of earlier runs give way. With ``report`` the outcome per file is
    appended there, with the error of those set aside.
    """
    paths = (
        _listing_session(spark)
        .readStream.format("binaryFile")
        .schema(FILE_COLUMNS)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
        .select("path")
    )

    merged = f"{checkpoint}/merged" if ingestion_timestamp else None
    delete_folder(spark, f"{checkpoint}/merged")  # of the run before

    def merge(batch: DataFrame, _: int) -> None:
        files = [row.path for row in batch.collect()]  # at most ``files_per_batch``; an iterator starts a job for each task
        if files:
            upsert_each(spark, files, target, ingestion_timestamp, report, pattern, merged)

    return (
        paths.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
