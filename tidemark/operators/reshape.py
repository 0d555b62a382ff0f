"""Projection operators: exploding, extracting, flattening, renaming, conforming."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.casts import safe_cast


def explode_items(
    df: DataFrame, items: str = "items", alias: str = "item", position: str = "_pos"
) -> DataFrame:
    """One row per array element with its position; an empty or NULL array gives no row."""
    kept = [c for c in df.columns if c != items]
    # The outer form, since Spark would check the size of the array in a filter below and compute it twice.
    return df.select(*kept, F.posexplode_outer(items).alias(position, alias)).filter(F.col(position).isNotNull())


_PLAIN_PATH = re.compile(r"^\$(\.[A-Za-z0-9_-]+)+$")


def _path_schema(paths: Sequence[tuple[str, ...]]) -> T.StructType:
    """Objects along the paths, with text at their ends."""
    out = T.StructType()
    for head in dict.fromkeys(path[0] for path in paths):
        tails = [path[1:] for path in paths if path[0] == head and len(path) > 1]
        out.add(head, _path_schema(tails) if tails else T.StringType())
    return out


def extract_json(
    df: DataFrame, column: str, fields: Mapping[str, tuple[str, str]], *keep: str
) -> DataFrame:
    """Extract ``{name: (json path, type)}`` from JSON text; absent or unreadable gives NULL.

    Objects and arrays come as JSON text. All plain paths (``$.a.b``) are read in one parse of the
    document; a path with subscripts, or one that leads to another path's object, costs one more.
    """
    plain = {
        name: tuple(path[2:].split("."))
        for name, (path, _) in fields.items()
        if _PLAIN_PATH.match(path)
    }
    inner = {parts[:n] for parts in plain.values() for n in range(1, len(parts))}
    plain = {name: parts for name, parts in plain.items() if parts not in inner}

    parsed = "__parsed"
    if plain:
        schema = _path_schema(list(plain.values()))
        df = df.select(*keep, column, F.from_json(column, schema).alias(parsed))
    out: list[Column] = []
    for name, (path, kind) in fields.items():
        if name in plain:
            value = F.col(".".join([parsed, *(f"`{part}`" for part in plain[name])]))
        else:
            value = F.get_json_object(F.col(column), path)
        out.append((value if kind == "string" else safe_cast(value, kind)).alias(name))
    return df.select(*keep, *out)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``: in its order, cast, typed NULL where absent."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def _leaves(kind: T.DataType, names: tuple[str, ...] = (), path: tuple[int, ...] = ()) -> Iterator[tuple[tuple[str, ...], tuple[int, ...]]]:
    """Names and positions that lead to each leaf."""
    if not isinstance(kind, T.StructType):
        yield names, path
        return
    for i, field in enumerate(kind):
        yield from _leaves(field.dataType, (*names, field.name), (*path, i))


def _numbered(kind: T.DataType) -> T.DataType:
    """The same structs with fields named by position."""
    if not isinstance(kind, T.StructType):
        return kind
    return T.StructType([T.StructField(f"f{i}", _numbered(f.dataType)) for i, f in enumerate(kind)])


def flatten_structs(df: DataFrame, sep: str = ".", keep: Sequence[str] = ()) -> DataFrame:
    """Replace nested objects by one column per leaf, named by its path; arrays stay whole.

    Columns in ``keep`` come first, untouched. Fields are reached by position, so any name may occur, also
    names that differ in case only (the result then has such columns too: see :func:`normalize_columns`).
    """
    positional = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    out = [F.col(f"c{df.columns.index(name)}").alias(name) for name in keep]
    for i, field in enumerate(df.schema):
        if field.name in keep:
            continue
        for names, path in _leaves(field.dataType, (field.name,)):
            value = F.col(f"c{i}").cast(_numbered(field.dataType)) if path else F.col(f"c{i}")
            for step in path:
                value = value.getField(f"f{step}")
            out.append(value.alias(sep.join(names)))
    return positional.select(*out)


def normal_name(name: str) -> str:
    """Lower-case letters, digits and single inner underscores only."""
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-zA-Z_]", "_", name)).lower().strip("_")


def normal_names(name: Column) -> Column:
    """:func:`normal_name` of a text column."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(name, "[^0-9a-zA-Z_]", "_"), "_+", "_"))
    return F.trim(plain, F.lit("_"))


def normalize_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Normalise column names; columns that meet under one name merge by first non-NULL value.

    Merged columns move to the end. Columns of differing types merge as text. Columns in ``keep``
    come first, untouched.
    """
    groups: dict[str, list[int]] = {}
    for position, name in enumerate(df.columns):
        if name not in keep:
            groups.setdefault(normal_name(name), []).append(position)

    # Positional names make the columns addressable even when two share a name.
    positional = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    types = [field.dataType for field in df.schema]

    def merged(positions: list[int]) -> Column:
        same = len({types[i].simpleString() for i in positions}) == 1
        cols = [F.col(f"c{i}") for i in positions]
        if not same:
            cols = [as_text(c, types[i]) for c, i in zip(cols, positions)]
        return F.coalesce(*cols)

    ordered = sorted(groups.items(), key=lambda item: len(item[1]) > 1)
    return positional.select(
        *[F.col(f"c{df.columns.index(name)}").alias(name) for name in keep],
        *[merged(positions).alias(name) for name, positions in ordered],
    )


def as_text(value: Column, kind: T.DataType) -> Column:
    """Text form of a value; arrays, maps and structs become JSON."""
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    return value.cast("string")
