"""Evolving reference documents: ``{"items": [...]}`` or one bare object per file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.paths import region_from_path
from tidemark.functions.text import is_blank, strip
from tidemark.operators.quality import require_columns
from tidemark.operators.reshape import normal_names
from tidemark.schemas import REFERENCE_REQUIRED
from tidemark.sources.documents import is_object, read_texts, unreadable, with_elements

FILE = "__file"
POS = "__pos"

# Where each required column sits in an element.
_REQUIRED_PATHS = {"id": "$.id", "snippet_title": "$.snippet.title"}


def _region(path: Column) -> Column:
    return F.lower(strip(region_from_path(path, "unknown")))


def _usable(element: Column) -> Column:
    """An object whose snippet, if it has one, is an object too."""
    snippet = F.get_json_object(element, "$.snippet")
    return is_object(element) & F.try_parse_json(element).isNotNull() & (snippet.isNull() | is_object(snippet))


def _any_has(path: str) -> Column:
    return F.exists("items", lambda e: F.get_json_object(e["element"], path).isNotNull())


def read_reference(
    spark: SparkSession, paths: str | Sequence[str], *, pattern: str = "*.json"
) -> DataFrame:
    """One row per file: its path, the elements found, the usable ones with their positions, and why
    the file is unusable (NULL when it is usable).

    A document is judged inside its own row and before any common schema exists, so that no file can
    change the verdict on another. Elements that are no objects, and those whose snippet is none, are
    left out; the others of their file stay.
    """
    files = with_elements(read_texts(spark, paths, FILE, pattern=pattern), T.StructType())
    every = F.coalesce("elements", F.array("text"))
    numbered = F.transform(every, lambda e, i: F.struct(i.alias(POS), e.alias("element")))
    rows = files.select(
        FILE,
        unreadable().alias("unreadable"),
        F.size(every).cast("bigint").alias("found"),
        F.filter(numbered, lambda e: _usable(e["element"])).alias("items"),
    )
    reason = F.lit(None).cast("string")
    for name, path in reversed(_REQUIRED_PATHS.items()):
        has = _any_has(path)
        reason = F.when(~has, F.lit(f"missing required column {name}")).otherwise(reason)
    reason = F.when(F.col("found") == 0, F.lit("no items")).otherwise(reason)
    reason = F.when(F.col("unreadable"), F.lit("unreadable document")).otherwise(reason)
    return rows.withColumn("error", reason).drop("unreadable")


def reference_status(df: DataFrame) -> DataFrame:
    """One row per file: key, region, elements found, rows its distinct ids make, and the error or NULL."""
    ids = F.transform("items", lambda e: strip(F.get_json_object(e["element"], "$.id")))
    distinct = F.size(F.array_distinct(F.filter(ids, lambda i: ~is_blank(i))))
    unusable = F.col("error").isNotNull()
    return df.select(
        F.col(FILE).alias("key"),
        _region(F.col(FILE)).alias("region"),
        F.when(F.col("error") == "unreadable document", 0).otherwise(F.col("found")).cast("bigint").alias("incoming_rows"),
        F.when(unusable, 0).otherwise(distinct).cast("bigint").alias("distinct_rows"),
        "error",
    )


# Levels of nested objects that become columns; what lies deeper stays JSON text.
MAX_DEPTH = 24

_SCALARS = ("STRING", "BIGINT", "DOUBLE", "BOOLEAN")


def _column_type(found: str | None) -> str:
    """The column type for values of a common VARIANT type; what no plain type holds becomes text."""
    if found in _SCALARS:
        return found
    if found and found.startswith("DECIMAL"):
        return "DOUBLE"
    if found and found.startswith("ARRAY<"):
        return f"ARRAY<{_column_type(found.removeprefix('ARRAY<').removesuffix('>'))}>"
    return "STRING"


def _is_nested(value: Column) -> Column:
    """An object with fields."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit(""))
    return kind.startswith("OBJECT<") & (kind != "OBJECT<>")


def _fields(value: Column, text: Column, prefix: Column | None = None) -> Column:
    """(path, value, text) of each field of an object, in the order of the text.

    VARIANT tells what a value is, but sorts names; the text read as a map keeps them in order. Names are
    data in both, so any may occur.
    """
    held = value.cast("map<string,variant>")
    listed = F.map_entries(F.from_json(text, "map<string,string>"))

    def field(e: Column) -> Column:
        path = e["key"] if prefix is None else F.concat(prefix, F.lit("."), e["key"])
        return F.struct(path.alias("path"), F.try_element_at(held, e["key"]).alias("value"), e["value"].alias("text"))

    return F.coalesce(F.transform(listed, field), F.array().cast("array<struct<path:string,value:variant,text:string>>"))


def _opened(leaves: Column) -> Column:
    """The leaves with the fields of nested objects in their place."""
    inner = lambda leaf: _fields(leaf["value"], leaf["text"], leaf["path"])
    return F.flatten(F.transform(leaves, lambda leaf: F.when(_is_nested(leaf["value"]), inner(leaf)).otherwise(F.array(leaf))))


def _cells(usable: DataFrame) -> DataFrame:
    """(FILE, POS, cells): the leaves of each element as (name, value), names normalised.

    Every path of the file is in each row of it, in the order in which the file shows them first, so the
    first cell of a name with a value is the one that counts.
    """
    rows = F.transform(
        "items",
        lambda x: F.struct(x[POS].alias(POS), _fields(F.try_parse_json(x["element"]), x["element"]).alias("leaves")),
    )
    files = usable.select(FILE, rows.alias("rows"))
    opened = F.transform("rows", lambda r: F.struct(r[POS].alias(POS), _opened(r["leaves"]).alias("leaves")))
    deeper = F.exists("rows", lambda r: F.exists(r["leaves"], lambda leaf: _is_nested(leaf["value"])))
    for _ in range(0, MAX_DEPTH, 2):
        # Two levels are looked at in one job: an element with a snippet has objects on the first alone.
        below = files.withColumn("rows", opened)
        first, second = files.select(deeper.alias("first"), opened.alias("rows")).agg(
            F.max("first"), F.max(F.when(F.col("first"), deeper))
        ).first()
        if not first:
            break
        files = below
        if not second:
            break
        files = files.withColumn("rows", opened)
    paths = F.array_distinct(F.flatten(F.transform("rows", lambda r: F.transform(r["leaves"], lambda leaf: leaf["path"]))))

    def cell(leaves: Column, path: Column) -> Column:
        same = F.filter(leaves, lambda leaf: (leaf["path"] == path) & ~F.is_variant_null(leaf["value"]))
        return F.struct(normal_names(path).alias("name"), F.get(same, 0)["value"].alias("value"))

    exploded = files.select(FILE, paths.alias("paths"), F.explode("rows").alias("row"))
    cells = F.transform("paths", lambda path: cell(F.col("row.leaves"), path))
    return exploded.select(FILE, F.col(f"row.{POS}").alias(POS), cells.alias("cells"))


def reference_items(df: DataFrame, ingestion_timestamp: Column) -> DataFrame:
    """Flattened, normalised and tagged rows of every usable file; fails when there is none.

    Names are values until they are normalised: columns are picked by the normalised name from (name,
    VARIANT) cells, and typed by what all values of a name have in common. Fields that meet under one name
    merge by the first value that is not null, in the order of the file. Objects inside arrays are JSON
    text. Source columns are normalised once and the tags keep fixed names. ``__pos`` holds the position
    inside the file; with ``source_file`` it orders the rows of one key.
    """
    cells = _cells(df.filter(F.col("error").isNull()))
    kinds = (
        cells.select(F.explode("cells").alias("cell"))
        .groupBy("cell.name")
        .agg(F.expr("schema_of_variant_agg(cell.value)").alias("kind"))
        .collect()  # a row for each column
    )
    if not kinds:
        raise ValueError("no readable document holds items or an id")

    def column(name: str, kind: str) -> Column:
        found = F.filter("cells", lambda c: (c["name"] == name) & c["value"].isNotNull())
        value = F.get(found, 0)["value"]
        return (value.cast("string") if kind == "STRING" else F.try_variant_get(value, "$", kind)).alias(name)

    rows = cells.select(FILE, POS, *[column(r.name, _column_type(r.kind)) for r in sorted(kinds)])
    require_columns(rows, REFERENCE_REQUIRED)
    path = F.col(FILE)
    return (
        rows.withColumn("id", strip(F.col("id").cast("string")))
        .filter(F.col("id").isNotNull())
        .withColumn("ingestion_timestamp", ingestion_timestamp)
        .withColumn("source_file", path)
        .withColumn("region", _region(path))
        .drop(FILE)
    )
