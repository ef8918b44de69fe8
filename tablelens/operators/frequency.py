"""Value frequencies: modes, top values, entropy, repeated values, from one table of (column, value, count).

Long texts stand in this table by their first characters and a digest, so that neither a shuffle nor the kept table holds
them; ``with_texts`` brings back the texts of the few values that a result shows. Ties go by the value as it stands here:
texts that begin with the same ``LONG`` characters and are equally frequent go by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions import exprs as X

EPSILON = 1e-12
TOP = 10
#: Characters from which on a text is long, and that stand for it before its digest of 32 digits.
LONG = 128


def _texts(df: DataFrame, names: list[str]) -> dict[str, Column]:
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    return {n: F.to_json(X.col(n)) if kinds[n] in ("array", "map", "struct", "variant") else X.col(n).cast("string") for n in names}


def short_form(text: Column) -> Column:
    """The text itself, or of a long one its first characters, a zero and its digest. No short text is as long as that."""
    return F.when(F.char_length(text) > LONG, F.concat(F.left(text, F.lit(LONG)), F.lit("\0"), F.md5(text))).otherwise(text)


def is_short_form(value: str | None) -> bool:
    """The value stands for a long text."""
    return value is not None and len(value) == LONG + 33


def with_texts(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (column, value, ...) of few values, as ``top_values`` makes them, with long texts in place of their short forms.

    The rows are broadcast, so they must be few: ranks of columns, not frequencies.
    """
    asked = rows.where(F.char_length("value") == LONG + 33).select("column", "value").distinct()
    cells = F.array(*[F.struct(F.lit(n).alias("column"), F.when(F.char_length(t) > LONG, t).alias("text")) for n, t in _texts(df, df.columns).items()])
    long = df.select(F.inline(cells)).where("text is not null").select("column", short_form(F.col("text")).alias("value"), "text")
    found = long.join(F.broadcast(asked), ["column", "value"]).groupBy("column", "value").agg(F.first("text").alias("text"))
    return rows.join(found, ["column", "value"], "left").withColumn("value", F.coalesce("text", "value")).select(rows.columns)


def whole_texts(df: DataFrame, wanted: list[tuple[str, str]]) -> dict[tuple[str, str], str]:
    """Texts of short forms (column, value), by one job; few of them, as they come to the driver."""
    wanted = sorted({(c, v) for c, v in wanted if is_short_form(v)})
    if not wanted:
        return {}
    rows = df.sparkSession.createDataFrame([(c, v, v) for c, v in wanted], "column string, value string, short string")
    some = df.select(*[X.col(n) for n in sorted({c for c, _ in wanted})])
    return {(r["column"], r["short"]): r["value"] for r in with_texts(some, rows).collect()}


def frequencies(df: DataFrame, names: list[str]) -> DataFrame:
    """column, value (as text, long ones in their short form), count of every distinct value, nulls included, of all ``names`` in one shuffle."""
    cells = F.array(*[F.struct(F.lit(n).alias("column"), short_form(t).alias("value")) for n, t in _texts(df, names).items()])
    return df.select(F.inline(cells)).groupBy("column", "value").agg(X.rows().alias("count"))


def _totals(freq: DataFrame) -> DataFrame:
    present = F.col("value").isNotNull()
    return freq.groupBy("column").agg(F.sum("count").alias("total"), F.sum(F.when(present, F.col("count")).otherwise(0)).alias("non_null"))


def _with_totals(rows: DataFrame, freq: DataFrame, known: dict[str, tuple[int, int]] | None) -> DataFrame:
    """Rows with total and non_null of their column, from ``known`` if these are known, else from one row a column."""
    if not known:
        return rows.join(F.broadcast(_totals(freq)), "column")
    pairs = [x for k, (t, n) in known.items() for x in (F.lit(k), F.struct(F.lit(t).cast("long").alias("total"), F.lit(n).cast("long").alias("non_null")))]
    at = F.element_at(F.create_map(*pairs), F.col("column"))
    return rows.select("*", at["total"].alias("total"), at["non_null"].alias("non_null"))


def top_values(freq: DataFrame, k: int = TOP, known: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """column, rank, value, count, ratio of the ``k`` most frequent non-null values; ties in order of the value."""
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    ranked = freq.where("value is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return _with_totals(ranked, freq, known).select("column", "rank", "value", "count", X.ratio(F.col("count"), F.col("non_null")).alias("ratio"))


def top_k(freq: DataFrame, k: int = TOP) -> DataFrame:
    """column, values (the top ones), other_count, other_ratio, non_null_count, status."""
    best = top_values(freq, k).groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("rank", "value", "count", "ratio"))).alias("values"), F.sum("count").alias("c")
    )
    j = _totals(freq).join(best, "column", "left")
    other = F.col("non_null") - F.coalesce("c", F.lit(0))
    return j.select("column", "values", other.alias("other_count"), X.ratio(other, F.col("non_null")).alias("other_ratio"), F.col("non_null").alias("non_null_count"), F.when(F.col("non_null") == 0, "warning").otherwise("passed").alias("status"))


def most_common(freq: DataFrame, counts: bool = False) -> DataFrame:
    """The mode of each column, nulls counted as a value, and beside a null mode the best other value.

    With ``counts`` also total, non_null and unique.

    A constant column gives its value with the count of non-null rows. Ties go to the smallest value, null last.
    """
    key = F.struct((-F.col("count")).alias("c"), F.col("value").isNull().alias("z"), F.col("value").alias("v"))
    some = F.when(F.col("value").isNotNull(), key)
    a = freq.groupBy("column").agg(
        F.sum("count").alias("total"), F.sum(F.when(F.col("value").isNotNull(), F.col("count")).otherwise(0)).alias("n"),
        F.count("value").alias("u"), F.min(key).alias("m"), F.min(some).alias("s"),
    )
    constant, none = F.col("u") <= 1, F.col("u") == 0
    count = F.when(constant, F.col("n")).otherwise(-F.col("m.c"))
    return a.select(
        "column",
        F.when(constant, F.col("s.v")).otherwise(F.col("m.v")).alias("most_common_value"),
        count.alias("frequency"),
        X.ratio(count, F.col("total")).alias("frequency_ratio"),
        constant.alias("is_constant_column"),
        F.when(~constant & F.col("m.z"), F.col("s.v")).alias("most_common_non_null"),
        F.when(~constant & F.col("m.z"), X.ratio(-F.col("s.c"), F.col("n"))).alias("non_null_frequency_ratio"),
        F.when(none, "warning").otherwise("passed").alias("status"),
        *([F.col("total"), F.col("n").alias("non_null"), F.col("u").alias("unique")] if counts else []),
    )


def entropy(freq: DataFrame, known: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """repeated_value_share, entropy and normalised entropy of the non-null values of each column."""
    some = _with_totals(freq.where("value is not null"), freq, known)
    p = F.col("count") / F.col("non_null")
    a = some.groupBy("column").agg(
        (F.sum(F.when(F.col("count") > 1, F.col("count")).otherwise(0)) / F.max("non_null")).alias("repeated_value_share"),
        (-F.sum(p * F.log2(p + EPSILON))).alias("entropy"),
        X.rows().alias("u"),
    )
    normal: Column = F.when(F.col("u") > 1, F.col("entropy") / F.log2("u")).otherwise(0.0)
    return a.select("column", "repeated_value_share", "entropy", normal.alias("normalized_entropy"), F.col("u").alias("unique_count"))


def quantiles(freq: DataFrame, kinds: dict[str, T.DataType], fractions: tuple[float, ...]) -> dict[str, dict[float, float]]:
    """Exact, linearly interpolated quantiles of numeric columns from their distinct values and counts."""
    if not kinds:
        return {}
    single = [n for n, k in kinds.items() if isinstance(k, T.FloatType)]
    v = F.when(F.col("column").isin(single), F.col("value").cast("float").cast("double")).otherwise(F.col("value").cast("double"))
    rows = freq.where(F.col("column").isin(list(kinds)) & F.col("value").isNotNull())
    q = F.percentile(v, F.array(*[F.lit(x) for x in fractions]), F.col("count"))
    return {r["column"]: dict(zip(fractions, r["q"], strict=True)) for r in rows.groupBy("column").agg(q.alias("q")).collect()}
