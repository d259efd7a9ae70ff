"""Typed rows as the JSON texts that the record models write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..contracts import contracts


def _written(x: Column, kind: str) -> Column:
    """A value as it is written: objects of any content as objects, pairs as arrays, times as ISO text, records field by field."""
    if kind == "json":
        return F.try_parse_json(x)
    if kind == "pair":
        return F.when(x.isNotNull(), F.array(x["width"], x["height"]))
    if kind == "datetime":
        return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    if kind in contracts():
        return F.when(x.isNotNull(), F.struct(*[_written(x[f.name], f.type).alias(f.name) for f in contracts()[kind]]))
    if kind.startswith("list<") and kind[5:].rstrip("?>") in contracts():
        return F.transform(x, lambda e: _written(e, kind[5:].rstrip("?>")))
    return x


def to_records(df: DataFrame, contract: str, column: str = "json") -> DataFrame:
    """All columns and the row's JSON text; nulls are written, columns that the contract does not have are left out of the text."""
    fields = [_written(F.col(f.name), f.type).alias(f.name) for f in contracts()[contract]]
    return df.withColumn(column, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
