"""JSON columns to typed rows: each field by its path, with a typed null and a reason where it degrades.

A text is parsed once, to a variant; a field that is missing, null or of another kind than asked for is null, and the
row says which and why. One damaged field takes no other with it, and a text that is no JSON makes all fields null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds of JSON values that a type accepts; decimals and integers are numbers.
KINDS = {"long": ("BIGINT",), "double": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "string": ("STRING",), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "struct": ("OBJECT",)}


def _kind(type: str) -> str:
    return type.split("<")[0]


def decoded(rows: DataFrame, column: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds a column for each field (name -> (path, type)), and `reasons`: an array of name:reason of those that degraded.

    Types: long, double, string, boolean, array<..> or struct<..>, the last two with what Spark casts their members to.
    Reasons: malformed (one, for the whole text, under the column's name), missing, null, and kind. A null text is
    missing as a whole. Names must not be columns of rows.
    """
    taken = {*rows.columns} & {*fields, "reasons"}
    if taken:
        raise ValueError(f"columns exist already: {sorted(taken)}")
    v = "_variant"
    found = rows.withColumn(v, F.try_parse_json(column))
    columns: list[Column] = []
    reasons: list[Column] = [F.when(F.col(column).isNull(), f"{column}:missing").when(F.col(v).isNull(), f"{column}:malformed")]
    for name, (path, type) in fields.items():
        own = F.try_variant_get(v, path, "variant")
        kind = F.regexp_extract(F.schema_of_variant(own), "^[A-Z]+", 0)
        fits = kind.isin(list(KINDS[_kind(type)]))
        value = F.when(fits, F.try_variant_get(v, path, type))
        columns.append(value.alias(name))
        reasons.append(F.when(F.col(v).isNull(), None).when(own.isNull(), f"{name}:missing").when(F.is_variant_null(own), f"{name}:null").when(value.isNull(), f"{name}:kind"))
    return found.select(*rows.columns, *columns, F.array_compact(F.array(*reasons)).alias("reasons"))
