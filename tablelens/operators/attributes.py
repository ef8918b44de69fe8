"""Column attributes: type category, diversity and nullability levels, likely index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions import exprs as X

#: A numeric column of whole, nearly unique values is an id column from so many values on.
ID_ROWS, ID_RATIO = 500, 0.99
#: Share of a text column's values that must be JSON lists or objects.
JSON_RATIO = 0.8


def diversity_level(u: Column, n: Column, zero_one: Column) -> Column:
    """First match wins. u: distinct, n: non-null values, zero_one: all values are 0/1 or booleans."""
    r = X.ratio(u, n)
    return (
        F.when(u == 1, "constant")
        .when((n > 1) & (u == n), "fully_unique")
        .when((u == 2) & zero_one, "binary")
        .when(u == 2, "low")
        .when(r <= 0.2, "low")
        .when(r <= 0.5, "medium")
        .when((r < 0.9) | (u < 75), "high")
        .otherwise("distinctive")
    )


def nullability_level(nulls: Column, total: Column) -> Column:
    """A column without rows or without values is "empty"."""
    r = X.ratio(nulls, total)
    return F.when((total == 0) | (nulls == total), "empty").when(r <= 0.2, "low").when(r <= 0.5, "medium").when(r <= 0.75, "high").otherwise("full")


def type_category(kind: T.DataType, n: Column, u: Column, whole: Column, arrays: Column, objects: Column) -> Column:
    """whole: all values are whole numbers; arrays, objects: shares of the values that are JSON lists or objects."""
    if isinstance(kind, T.BooleanType):
        return F.when(n >= 0, "boolean")
    if isinstance(kind, T.NumericType):
        return F.when((n >= ID_ROWS) & (X.ratio(u, n) >= ID_RATIO) & whole, "categorical").otherwise("numeric")
    if isinstance(kind, T.StringType):
        return F.when(n == 0, "unknown").when(arrays > JSON_RATIO, "array").when(objects > JSON_RATIO, "dictionary").otherwise("textual")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return F.when(n >= 0, "temporal")
    if isinstance(kind, T.ArrayType):
        return F.when(n >= 0, "array")
    if isinstance(kind, T.MapType | T.StructType):
        return F.when(n >= 0, "dictionary")
    return F.when(n >= 0, "unknown")


def countable(c: Column, kind: T.DataType) -> Column:
    """A form of the value that can be grouped: maps and variants go by their JSON text."""
    return F.to_json(c) if isinstance(kind, T.MapType | T.VariantType) else c


def attribute_fields(c: Column, kind: T.DataType, u: Column | None = None) -> dict[str, Column]:
    """u: the number of distinct values, if it is known already."""
    n, total = F.count(c), X.rows()
    nulls = F.count_if(c.isNull())
    u = F.count_distinct(countable(c, kind)) if u is None else u
    d = c.cast("double") if isinstance(kind, T.NumericType) else None
    true = F.lit(True)
    zero_one = F.coalesce(F.bool_and(d.isin(0.0, 1.0)), true) if d is not None else F.lit(isinstance(kind, T.BooleanType)) & (n >= 0)
    whole = F.coalesce(F.bool_and(d % 1 == 0), true) if d is not None else F.lit(False) & (n >= 0)
    shares = [F.lit(0.0), F.lit(0.0)]
    if isinstance(kind, T.StringType):
        # JSON is parsed only where a value begins like a list or an object.
        shape = F.when(F.ltrim(c).rlike(r"^[\[{]"), X.json_kind(c))
        shares = [X.ratio(F.count_if(shape == k), n) for k in ("array", "object")]
    category = type_category(kind, n, u, whole, *shares)
    unique = (n > 1) & (u == n)
    index = unique & (~category.isin("array", "dictionary", "unknown")) & ((category != "numeric") | whole)
    return {
        "type_category": category, "diversity": diversity_level(u, n, zero_one), "nullability": nullability_level(nulls, total), "unique_count": u,
        "total_count": total, "null_count": nulls, "is_likely_index": index, "fractional": ~whole & (n > 0) if d is not None else F.lit(False) & (n > 0),
    }


def column_attributes(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row for each column from one aggregation; see ``attribute_fields``."""
    from tablelens.operators.columns import per_column

    return per_column(df, names or df.columns, attribute_fields)


def simple_type(values: list) -> str:
    """The plain heuristic for lists of values: empty or all-null text is unknown, text with at most ten repeating values
    is categorical."""
    some = [v for v in values if v is not None]
    if not some:
        return "unknown"
    if all(isinstance(v, bool) for v in some):
        return "boolean"
    if all(isinstance(v, int | float) and not isinstance(v, bool) for v in some):
        return "numeric"
    if all(isinstance(v, str) for v in some):
        return "categorical" if len(set(some)) < len(some) and len(set(some)) <= 10 else "textual"
    if all(hasattr(v, "isoformat") for v in some):
        return "temporal"
    return "unknown"
