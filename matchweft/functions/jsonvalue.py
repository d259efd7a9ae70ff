"""Canonical forms of small JSON objects."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def json_fields(value: Column) -> Column:
    """A JSON object as map of field name to value text; null if the text is no object."""
    return F.from_json(value, "map<string,string>")


def scalar_text(text: Column) -> Column:
    """One spelling for a number, whether it was written as number or text (48, 48.0, "48", 4.8e1); other text in lower case, trimmed."""
    plain = F.lower(F.trim(text))
    number = F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d{1,2})?$"), plain.try_cast("decimal(38,9)"))
    return F.coalesce(number.cast("string"), plain)


def canonical_object(value: Column, ignore: Iterable[str] = ()) -> Column:
    """The object's fields in name order with ``scalar_text`` values; equal texts for equal objects.

    Field order, blanks, letter case, number spelling and the fields in ``ignore`` do not
    matter. A null value gives the text ``null``, text that is no JSON object itself.
    """
    fields = json_fields(value)
    kept = F.filter(F.map_entries(fields), lambda e: ~F.lower(e["key"]).isin(*ignore)) if ignore else F.map_entries(fields)
    pairs = F.transform(kept, lambda e: F.concat(F.lower(e["key"]), F.lit("\u0001"), F.coalesce(scalar_text(e["value"]), F.lit("\u0002"))))
    return F.coalesce(F.array_join(F.array_sort(pairs), "\u0003"), F.concat(F.lit("\u0004"), value), F.lit("null"))
