"""Lines that many documents share, dropped from all but one; DataFrame functions only.

A text is split at U+000A. A line's key is the line without space and U+0009 to U+000D at both ends,
A-Z lower-cased. A key of at least ``min_chars`` code points that at least ``min_docs`` documents hold
loses its lines everywhere except in the largest doc_id that holds it.

Keys are counted as two 64-bit hashes with the document, so a key that a third of all documents hold is
pre-aggregated before it is shuffled, and never gathered. Hits come back as line positions; texts are
shuffled once, to meet them, and put together from the positions that are left.

Defined cases. A null or empty text is one empty line. Rows that share a doc_id count as one document;
each keeps its own lines. A null doc_id counts as no document and is never the one that keeps a line.
A text whose lines all go is empty. Columns of the input stay as they are, whatever their names, but for
``text`` and for columns called ``n_lines`` or ``n_dropped`` in any case, which are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_EDGES = " \t\n\x0b\x0c\r"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII alone take the quick way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def numbered(documents: DataFrame, own: Sequence[str], drop: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """``documents`` without columns called as in ``drop``, in any case; all but those in ``own`` named by
    number, so that no name of theirs meets one used inside. And the names they had."""
    kept = [i for i, name in enumerate(documents.columns) if name.lower() not in drop]
    renamed = documents.toDF(*[name if name in own else f"c{i}" for i, name in enumerate(documents.columns)])
    return renamed.select(*[renamed.columns[i] for i in kept]), [documents.columns[i] for i in kept]


def drop_shared_lines(documents: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The input's rows with shared lines dropped, and ``n_lines`` (before) and ``n_dropped``."""
    documents, names = numbered(documents, ("doc_id", "text"), ("n_lines", "n_dropped"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = F.transform(F.split(lower_ascii(F.col("_text")), "\n", -1), lambda x: F.trim(x, F.lit(_EDGES)))
    lines = (
        documents.select(F.col("doc_id").alias("_doc"), text.alias("_text"))
        .select("_doc", F.xxhash64("_text").alias("_row"), F.posexplode(keys).alias("_pos", "_key"))
        .filter(F.char_length("_key") >= min_chars)
        .select("_doc", "_row", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(7), "_key").alias("_h2"))
    )
    shared = (
        lines.groupBy("_h1", "_h2")
        .agg(F.countDistinct("_doc").alias("_docs"), F.max("_doc").alias("_keeper"))
        .filter(F.col("_docs") >= min_docs)
        .select("_h1", "_h2", "_keeper")
    )
    drops = (
        lines.join(shared, ["_h1", "_h2"])
        .filter(~F.col("_doc").eqNullSafe(F.col("_keeper")))
        .groupBy("_doc", "_row")
        .agg(F.collect_set("_pos").alias("_drops"))
        .withColumnsRenamed({"_doc": "_doc2", "_row": "_row2"})
    )
    rows = documents.select(
        *[F.col(c) for c in documents.columns if c != "text"],
        F.col("doc_id").alias("_doc"),
        text.alias("_text"),
        F.xxhash64(text).alias("_row"),
    )
    met = rows.join(
        drops, F.col("_doc").eqNullSafe(F.col("_doc2")) & (F.col("_row") == F.col("_row2")), "left"
    ).withColumn("_lines", F.split("_text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drops"))
    kept = F.array_join(F.transform(left, lambda p: F.get(F.col("_lines"), p)), "\n")
    columns = {c: F.col(c) for c in rows.columns if not c.startswith("_")}
    columns["text"] = F.when(F.col("_drops").isNull(), F.col("_text")).otherwise(kept).alias("text")
    return met.select(
        *[columns[c] for c in documents.columns],
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_drops"), F.lit(0)).cast("long").alias("n_dropped"),
    ).toDF(*names, "n_lines", "n_dropped")
