"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage works on all rows its predecessor kept. Null and empty texts pass each stage by the rules of
its operator: they are scored, are one empty line, are near duplicates of nothing, have no words to mix
and so leave there. An empty table passes as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import round_trip
from tidemark.llm.lines import drop_shared_lines
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import mix_sources, mixed_texts
from tidemark.llm.quality import keep_quality
from tidemark.session import scratch, setting, stage

#: Words of a block in the mix; blocks hold whole documents.
MIX_BLOCK = 1 << 14
#: Whole texts that go to Python at a time: both sides hold them, beside what the encoder remembers.
TEXTS_PER_BATCH = 256
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _sized(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, n_chars being the code points of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_quality(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share go from all but one of them."""
    return _sized(drop_shared_lines(docs.select(*COLUMNS)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (shingles of five words, 0.8).

    Rows of one doc_id are one document, of which one row stays; rows without doc_id stay.
    """
    kept = near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    named = docs.join(kept, "doc_id", "left_semi").withColumn("_n", first).filter("_n = 1")
    return named.select(*COLUMNS).unionByName(docs.filter("doc_id IS NULL").select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document and copy that the mix of sources takes, each complete."""
    rows = docs.select(*COLUMNS)
    return _sized(mixed_texts(rows, mix_sources(rows, block_words=MIX_BLOCK, whole=True)))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each text, and digests of the ids and of the decoded text.

    They are written here, since the size of a batch holds for the rows made meanwhile.
    """
    import public_tokenizers

    tokens = round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_PER_BATCH)):
        return stage(tokens, f"{scratch(spark)}/tokens")


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("bpe", bpe),
]

#: A classifier is fitted on the way, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, one after the other."""
    docs, root = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark)
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"{root}/{name}")
    return docs
