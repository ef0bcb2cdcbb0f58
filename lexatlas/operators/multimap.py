"""Values gathered by key: single values, lists, and records field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gather_values(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, values: one list of all values, in order."""
    return _in_order(rows, key, {"values": F.col(value)}, order)


def gather_lists(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, values: all lists of a key, end to end."""
    return _in_order(rows, key, {"values": F.col(value)}, order).withColumn("values", F.flatten("values"))


def gather_records(rows: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """key and one list per field; lists among the values are laid end to end."""
    out = _in_order(rows, key, {f: F.col(f) for f in fields}, order)
    nested = [f for f in fields if rows.schema[f].dataType.typeName() == "array"]
    return out.withColumns({f: F.flatten(f) for f in nested}) if nested else out


def gather(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The one of the three that fits the type of the value."""
    kind = rows.schema[value].dataType.typeName()
    if kind == "array":
        return gather_lists(rows, key, value, order)
    if kind == "struct":
        fields = rows.schema[value].dataType.names
        return gather_records(rows.select(key, order, *(F.col(f"{value}.{f}").alias(f) for f in fields)), key, fields, order)
    return gather_values(rows, key, value, order)


def _in_order(rows: DataFrame, key: str, columns: dict[str, Column], order: str) -> DataFrame:
    item = F.struct(F.col(order).alias("__o"), *(c.alias(n) for n, c in columns.items()))
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(a["__o"] < b["__o"], -1).when(a["__o"] > b["__o"], 1).otherwise(0)).alias("__l"))
    return lists.select(key, *(F.col(f"__l.{n}").alias(n) for n in columns))
