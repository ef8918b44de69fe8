"""Column expressions that the checks are built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Regular expressions are matched at the start, with Unicode classes and ``\n`` as the only line end.
START = "(?Ud)^(?:{})"


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


def normalise(df: DataFrame) -> DataFrame:
    """NaN becomes null in float and double columns, so that there is one notion of a missing value."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)}
    return df.select([F.when(~F.isnan(col(n)), col(n)).alias(n) if n in floats else col(n) for n in df.columns])


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def rows() -> Column:
    return F.count(F.lit(1))


def ladder(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The label of the first step that ``value`` reaches."""
    out = None
    for least, label in steps:
        out = F.when(value >= least, label) if out is None else out.when(value >= least, label)
    return out.otherwise(last) if out is not None else F.lit(last)


def matches(c: Column, pattern: str) -> Column:
    """The text matches ``pattern`` from its start on."""
    return c.rlike(START.format(pattern.removeprefix("^")))


def corrected_skewness(c: Column) -> Column:
    """Bias-corrected sample skewness; null for fewer than three values."""
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; null for fewer than four values."""
    n = F.count(c).cast("double")
    return F.when(n >= 4, ((n - 1) / ((n - 2) * (n - 3))) * ((n + 1) * F.kurtosis(c) + 6))


def as_number(c: Column, kind: T.DataType) -> Column:
    """The value as a double, or null. A suffix that only Spark takes, as in ``1d``, is no number, nor is NaN."""
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if not isinstance(kind, T.StringType):
        return F.lit(None).cast("double")
    n = F.when(~c.rlike(r"[0-9.][dDfF]\s*$"), c.try_cast("double"))
    return F.when(~F.isnan(n), n)


def as_timestamp(c: Column, kind: T.DataType) -> Column:
    """The value as a timestamp, or null; numbers are no dates."""
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return c.cast("timestamp")
    if isinstance(kind, T.StringType):
        return c.try_cast("timestamp")
    return F.lit(None).cast("timestamp")


def is_json(c: Column, kind: T.DataType) -> Column:
    """The text is one JSON value. The parser alone ignores what follows the value, so it is also tried in brackets."""
    if not isinstance(kind, T.StringType):
        return F.lit(False)
    alone = F.try_parse_json(c)
    boxed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    # Failing parses are costly, so only text that begins like a JSON value is parsed.
    begins = c.rlike(r'^[ \t\r\n]*([\[{"]|-?[0-9]|true|false|null)')
    one = alone.isNotNull() & (F.size(F.try_variant_get(boxed, "$", "array<variant>")) == 1)
    return F.coalesce(F.when(begins, one), F.lit(False))


def json_kind(c: Column) -> Column:
    """'array', 'object', 'other' for JSON text, null otherwise."""
    first = F.substring(F.ltrim(c), 1, 1)
    return F.when(is_json(c, T.StringType()), F.when(first == "[", "array").when(first == "{", "object").otherwise("other"))


def width_bytes(c: Column, kind: T.DataType) -> Column:
    """Estimated bytes of a value."""
    fixed = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.coalesce(F.octet_length(F.to_json(c) if not isinstance(kind, T.ArrayType) else F.to_json(c)), F.lit(0)).cast("long")
    return F.lit(next((n for k, n in fixed.items() if isinstance(kind, k)), 8)).cast("long")
