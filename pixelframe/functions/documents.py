"""JSON documents: one canonical spelling, and what differs between two of them, at every depth."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship


def canonical(document: Column, indent: int | None = None, ascii_only: bool = False) -> Column:
    """JSON text with keys in order at every depth: compact, or with ``indent`` on lines of their own; as Python's json module writes it, numbers included.

    Text that is no JSON gives null. Python does it, since shortest spellings of doubles differ between Java's versions.
    """
    separators = (",", ":") if indent is None else None

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), sort_keys=True, indent=indent, separators=separators, ensure_ascii=ascii_only)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def spell(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return spell(document)


def of_rows(rows: DataFrame, indent: int | None = None, ascii_only: bool = False) -> Column:
    """Each row of a frame as a canonical document; nulls are written."""
    ship(rows.sparkSession)
    return canonical(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"ignoreNullFields": "false"}), indent, ascii_only)


def _places(value, path: str = "") -> Iterator[tuple[str, str, str | None]]:
    """(path, type, value) of a value and of all inside it; paths are JSON pointers, so array places count."""
    if isinstance(value, dict):
        yield path, "object", None
        for key, inner in value.items():
            yield from _places(inner, f"{path}/{key.replace('~', '~0').replace('/', '~1')}")
    elif isinstance(value, list):
        yield path, "array", None
        for i, inner in enumerate(value):
            yield from _places(inner, f"{path}/{i}")
    elif isinstance(value, bool) or value is None:
        yield path, "null" if value is None else "boolean", json.dumps(value)
    elif isinstance(value, str):
        yield path, "string", value
    else:
        yield path, "number", repr(int(value) if value == value and abs(value) < 1e300 and value == int(value) else value)


def flattened(rows: DataFrame, key: str, document: str) -> DataFrame:
    """key, path, type and value of every place of each row's JSON; text that is no JSON is one place of type ``invalid``, null none."""
    ship(rows.sparkSession)
    schema = pa.schema([("_i", pa.int64()), ("path", pa.string()), ("type", pa.string()), ("value", pa.string())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = batch.column(0), []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                try:
                    out += [(i, *place) for place in _places(json.loads(text))]
                except (ValueError, RecursionError):
                    out.append((i, "", "invalid", text))
                if len(out) >= 50_000:
                    yield given(keys, out)
                    out = []
            yield given(keys, out)

    def given(keys: pa.Array, out: list) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, schema)]
        return pa.RecordBatch.from_arrays([keys.take(columns[0]), *columns[1:]], names=["key", "path", "type", "value"])

    chosen = rows.select(F.col(key).alias("key"), F.col(document).cast("string").alias("document"))
    return chosen.mapInArrow(walk, f"key {chosen.schema['key'].dataType.simpleString()}, path string, type string, value string").withColumnRenamed("key", key)


def differences(recorded: DataFrame, rebuilt: DataFrame, key: str, document: str) -> DataFrame:
    """Places at which the documents of a key differ: path and status, ``missing`` from the rebuilt one, ``added`` to it, or ``changed``.

    Keys of objects have no order, places of arrays do. A document that only one side has is missing or added at every place.
    """
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (key, "path")]
    both = flattened(recorded, key, document).alias("l").join(flattened(rebuilt, key, document).alias("r"), on, "full_outer")
    same = F.col("l.type").eqNullSafe(F.col("r.type")) & F.col("l.value").eqNullSafe(F.col("r.value"))
    status = F.when(F.col("r.type").isNull(), "missing").when(F.col("l.type").isNull(), "added").when(~same, "changed")
    told = F.col("l.type").isNotNull()
    out = both.select(F.when(told, F.col(f"l.{key}")).otherwise(F.col(f"r.{key}")).alias(key), F.when(told, F.col("l.path")).otherwise(F.col("r.path")).alias("path"), status.alias("status"))
    return out.where("status IS NOT NULL")
