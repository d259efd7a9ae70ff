"""Validation of records against their contracts, as column expressions.

Nothing is raised: valid rows go on, others carry the codes of all their violations
(``path:reason``), so one bad record does not end a job over many. ``mode="failfast"`` raises
at the first bad row instead. JSON is judged by its own types, key by key, because a parsed
row no longer tells missing from null, or number from text.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..contracts import DOMAINS, Field, contracts, spark_type

#: The texts that stand for a truth value.
TRUE_WORDS, FALSE_WORDS = ("1", "t", "true", "y", "yes", "on"), ("0", "f", "false", "n", "no", "off")


def _relaxed(kind: T.DataType) -> T.DataType:
    """The same type with nulls allowed everywhere: a record under judgement may hold them."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_relaxed(kind.elementType), True)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _relaxed(f.dataType), True) for f in kind.fields])
    return kind


def _codes(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for c, code in pairs]))


def _none() -> Column:
    return F.array().cast("array<string>")


def _concat(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else _none()


def _get(x: Column, kind: str) -> Column:
    return F.try_variant_get(x, "$", kind)


def _in_bounds(v: Column, f: Field) -> Column:
    """False out of the field's bounds; NaN is out of any."""
    ok = F.lit(True)
    if f.low is not None:
        ok = ok & (v >= F.lit(f.low))
    if f.high is not None:
        ok = ok & (v <= F.lit(f.high))
    return ok & ~F.isnan(v.cast("double")) if f.type == "float" else ok


def _entries(x: Column) -> Column:
    """An object as map of key to (variant, JSON type); null if it is no object. Each value is looked at once."""
    return F.transform_values(_get(x, "map<string,variant>"), lambda _, v: F.struct(v.alias("v"), F.schema_of_variant(v).alias("k")))


def _bind(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with x evaluated once, however often it occurs; inside lambdas nothing else shares subexpressions."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _judged(value: Column, codes: Column) -> Column:
    return F.struct(value.alias("value"), codes.alias("codes"))


def _scalar(x: Column, own: Column, f: Field, kind: str, path: str) -> Column:
    """Value and violations of a scalar that is neither missing nor null; ``own`` is its JSON type."""
    text = _get(x, "string")
    number = own.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    if kind in DOMAINS:
        return _judged(text, _codes((own != "STRING", f"{path}:type"), ((own == "STRING") & ~text.isin(*DOMAINS[kind]), f"{path}:domain")))
    if kind == "str":
        return _judged(F.when(own == "STRING", text), _codes((own != "STRING", f"{path}:type")))
    if kind == "int":
        spelled = F.when(own == "BOOLEAN", _get(x, "int").cast("decimal(38,9)")).when(number, text.try_cast("decimal(38,9)"))
        spelled = spelled.when((own == "STRING") & text.rlike(r"^\s*[+-]?\d+(\.0*)?\s*$"), F.trim(text).try_cast("decimal(38,9)"))
        whole = _bind(spelled, lambda d: F.when(d == F.floor(d), d).try_cast("bigint"))
        return _bind(whole, lambda v: _judged(v, _codes((v.isNull(), f"{path}:type"), (v.isNotNull() & ~_in_bounds(v, f), f"{path}:range"))))
    if kind == "float":
        v = F.when(own == "BOOLEAN", _get(x, "int").cast("double")).when(number, _get(x, "double")).when(own == "STRING", F.trim(text).try_cast("double"))

        def judge(v: Column) -> Column:
            endless = F.abs(v) == float("inf")
            return _judged(v, _codes((v.isNull(), f"{path}:type"), (endless, f"{path}:finite"), (v.isNotNull() & ~endless & (F.isnan(v) | ~_in_bounds(v, f)), f"{path}:range")))

        return _bind(v, judge)
    if kind == "bool":
        word = F.when(own == "STRING", F.lower(text)).when(number, F.when(_get(x, "double") == 1, "1").when(_get(x, "double") == 0, "0"))
        v = F.when(own == "BOOLEAN", _get(x, "boolean")).when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
        return _bind(v, lambda v: _judged(v, _codes((v.isNull(), f"{path}:type"))))
    if kind == "datetime":
        v = F.when((own == "STRING") & text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), text.try_cast("timestamp"))
        return _bind(v, lambda v: _judged(v, _codes((v.isNull(), f"{path}:type"))))
    if kind == "json":
        return _judged(F.when(own.startswith("OBJECT"), F.to_json(x)), _codes((~own.startswith("OBJECT"), f"{path}:type")))
    raise ValueError(kind)


def _value(x: Column, own: Column, f: Field, kind: str, path: str) -> Column:
    """Value and violations of any value that is neither missing nor null."""
    if kind == "pair":
        side = Field("side", "int", False, None, None, None)

        def both(items: Column) -> Column:
            ends = F.transform(items, lambda e: _scalar(e, F.schema_of_variant(e), side, "int", path))
            value = F.struct(F.get(ends, F.lit(0))["value"].alias("width"), F.get(ends, F.lit(1))["value"].alias("height"))
            fine = F.coalesce(F.size(items) == 2, F.lit(False))
            return _judged(F.when(fine, value), F.when(fine, F.array_distinct(F.flatten(F.transform(ends, lambda e: e["codes"])))).otherwise(F.array(F.lit(f"{path}:arity"))))

        return _bind(_get(x, "array<variant>"), both)
    if kind.startswith("list<"):
        inner, nullable = f.element
        items = _get(x, "array<variant>")
        absent = lambda e: e.isNull() | F.is_variant_null(e)
        empty = _judged(F.lit(None).cast(_relaxed(spark_type(inner))), _none() if nullable else F.array(F.lit(f"{path}[]:null")))
        if inner in contracts():
            seen = F.transform(items, lambda e: F.struct(absent(e).alias("absent"), _entries(e).alias("m")))
            parsed = F.transform(seen, lambda e: F.when(e["absent"], empty).otherwise(_object(e["m"], inner, f"{path}[]")))
        else:
            plain = Field("", inner, nullable, None, None, None)
            parsed = F.transform(items, lambda e: F.when(absent(e), empty).otherwise(_scalar(e, F.schema_of_variant(e), plain, inner, f"{path}[]")))

        def whole(parts: Column) -> Column:
            codes = F.array_distinct(F.flatten(F.transform(parts, lambda e: e["codes"])))
            return _judged(F.transform(parts, lambda e: e["value"]), F.coalesce(codes, F.array(F.lit(f"{path}:type"))))

        return _bind(parsed, whole)
    if kind in contracts():
        return _bind(_entries(x), lambda m: _object(m, kind, path))
    return _scalar(x, own, f, kind, path)


def _object(m: Column, contract: str, path: str) -> Column:
    """Struct and violations of an object given by its ``_entries``; null entries are no object. What lies below is judged once and then used for both."""
    fields = contracts()[contract]
    at = lambda name: f"{path}.{name}" if path else name
    judged = F.struct(*[_value(m[f.name]["v"], m[f.name]["k"], f, f.type, at(f.name)).alias(f.name) for f in fields])

    def put_together(parts: Column) -> Column:
        values, codes = [], []
        for f in fields:
            present, null = F.map_contains_key(m, F.lit(f.name)), m[f.name]["k"] == "VOID"
            kind = _relaxed(spark_type(f.type))
            given = F.when(present & ~null, parts[f.name]["value"]).cast(kind)
            values.append((given if f.default is None else F.when(present, given).otherwise(_default(f)).cast(kind)).alias(f.name))
            missing = F.array(F.lit(f"{at(f.name)}:missing")) if f.default is None else _none()
            of_null = _none() if f.nullable else F.array(F.lit(f"{at(f.name)}:null"))
            codes.append(F.when(~present, missing).when(null, of_null).otherwise(parts[f.name]["codes"]))
        unknown = F.transform(F.array_sort(F.array_except(F.map_keys(m), F.array(*[F.lit(f.name) for f in fields]))), lambda k: F.concat(F.lit(at("")), k, F.lit(":unknown_field")))
        return _judged(F.struct(*values), F.when(m.isNull(), F.array(F.lit(f"{path or 'record'}:type"))).otherwise(_concat([*codes, unknown])))

    return _bind(judged, put_together)


def _default(f: Field) -> Column:
    kind = _relaxed(spark_type(f.type))
    value = json.loads(f.default)
    if value is None:
        return F.lit(None).cast(_relaxed(kind))
    if f.type in contracts():
        return F.struct(*[_default(g).cast(_relaxed(spark_type(g.type))).alias(g.name) for g in contracts()[f.type]])
    if f.type == "json":
        return F.lit(f.default)
    if isinstance(value, list):
        return F.array().cast(kind)
    return F.lit(value).cast(kind)


def validate_json(df: DataFrame, contract: str, column: str = "json", mode: str = "quarantine") -> DataFrame:
    """Parse and validate JSON texts: all columns, ``record`` (the contract's struct, defaults filled) and ``violations``.

    Lax values are coerced as the record models do (``"48"`` and 48.0 to 48), except that
    numbers never become text. Unknown fields count at every level. Text that is no JSON, or has
    a key twice, has the one violation ``record:json``; its record is null. A null text too.
    Infinite numbers are violations.
    """
    judged = _bind(_entries(F.col("__v")), lambda m: _object(m, contract, ""))
    parsed = df.withColumn("__v", F.try_parse_json(F.col(column))).withColumn("__r", judged)
    unreadable = F.col("__v").isNull()
    out = parsed.withColumn("violations", F.when(unreadable, F.array(F.lit("record:json"))).otherwise(F.col("__r.codes")))
    out = out.withColumn("record", F.when(F.col("__v").isNotNull() & ~F.array_contains("violations", "record:type"), F.col("__r.value")))
    if mode == "failfast":
        bad = F.size("violations") > 0
        out = out.withColumn("record", F.when(bad, F.raise_error(F.concat(F.lit("invalid record: "), F.array_join("violations", ", "))).cast(_relaxed(spark_type(contract)))).otherwise(F.col("record")))
    return out.drop("__v", "__r")


def accepted(validated: DataFrame) -> DataFrame:
    """The valid records, flat."""
    return validated.where(F.size("violations") == 0).select("record.*")


def quarantined(validated: DataFrame) -> DataFrame:
    """The other rows, with their violations."""
    return validated.where(F.size("violations") > 0).drop("record")


def _typed(x: Column, f: Field, kind: str, path: str, made: bool) -> Column:
    if kind in contracts():
        return _typed_object(x, kind, path)
    if kind.startswith("list<"):
        inner, nullable = f.element
        plain = Field("", inner, nullable, None, None, None)
        each = F.transform(x, lambda e: F.when(e.isNull(), _none() if nullable else F.array(F.lit(f"{path}[]:null"))).otherwise(_typed(e, plain, inner, f"{path}[]", made)))
        return F.array_distinct(F.flatten(each))
    if kind in DOMAINS:
        return _codes((~x.isin(*DOMAINS[kind]), f"{path}:domain"))
    if kind == "float":
        return _codes((F.abs(x) == float("inf"), f"{path}:finite"), ((F.abs(x) != float("inf")) & ~_in_bounds(x, f) | F.isnan(x), f"{path}:range"))
    if kind == "int":
        return _codes((~_in_bounds(x, f), f"{path}:range"))
    if kind == "json":
        return _bind(F.try_parse_json(x), lambda v: _codes((v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), f"{path}:type")))
    if kind == "pair":
        return _codes((x["width"].isNull() | x["height"].isNull(), f"{path}:arity"))
    return _none()


def _typed_object(x: Column | None, contract: str, path: str) -> Column:
    codes = []
    for f in contracts()[contract]:
        at = f"{path}.{f.name}" if path else f.name
        c = F.col(f.name) if x is None else x[f.name]
        of_null = _none() if f.nullable else F.array(F.lit(f"{at}:null"))
        codes.append(F.when(c.isNull(), of_null).otherwise(_typed(c, f, f.type, at, False)))
    return _concat(codes)


def violations_of(contract: str) -> Column:
    """Violations of a row that already has the contract's columns, as after reading Parquet, which forgets what may not be null."""
    return _typed_object(None, contract, "")


def validate_table(df: DataFrame, contract: str) -> DataFrame:
    """All columns and ``violations`` for a typed table; missing columns are an error, further columns are ignored."""
    return df.withColumn("violations", violations_of(contract))
