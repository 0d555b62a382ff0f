"""Nested JSON snapshot envelopes, one document per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.keys import Batch
from tidemark.operators.reshape import explode_items
from tidemark.schemas import CORRUPT, ENVELOPE, ITEM
from tidemark.sources.discovery import batch_glob
from tidemark.sources.documents import is_object, read_texts, unreadable, with_elements

REJECTED = "_rejected"
_FILE = "_source_file"


def read_envelopes(
    spark: SparkSession,
    root: str,
    batch: Batch | None = None,
    *,
    keep_corrupt: bool = False,
    pattern: str = "*.json",
) -> DataFrame:
    """One row per file with its path in ``_source_file``.

    Each item is parsed by itself: elements that are no objects go to ``_rejected`` as text, and a
    field of another type than its column is NULL. A document that is no object, or whose items are no
    list, has NULL items; ``keep_corrupt`` adds its raw text in ``_corrupt_record``.
    """
    files = with_elements(read_texts(spark, batch_glob(root, batch), _FILE, pattern=pattern), ENVELOPE)
    broken = unreadable() | (F.col("document.items").isNotNull() & F.col("elements").isNull())
    items = F.transform(F.filter("elements", is_object), lambda text: F.from_json(text, ITEM))
    fields = {
        f.name: F.when(~broken, items).alias("items") if f.name == "items" else F.col("document")[f.name].alias(f.name)
        for f in ENVELOPE
    }
    rejected = F.coalesce(F.filter("elements", lambda text: ~is_object(text)), F.array().cast("array<string>"))
    corrupt = [F.when(broken, F.col("text")).alias(CORRUPT)] if keep_corrupt else []
    return files.select(*fields.values(), *corrupt, rejected.alias(REJECTED), _FILE)


def read_items_schemaless(
    spark: SparkSession, root: str, batch: Batch | None = None, *, pattern: str = "*.json"
) -> DataFrame:
    """One row per item as JSON text, for documents whose fields vary."""
    files = with_elements(read_texts(spark, batch_glob(root, batch), _FILE, pattern=pattern), ENVELOPE)
    objects = files.select(F.filter("elements", is_object).alias("items"), _FILE)
    return explode_items(objects).select(F.col("item").alias("_item_json"), "_pos", _FILE)
