"""Column checks as aggregates.

Each check is a function of a column that returns its fields as aggregate expressions, so any number of checks over any
number of columns is one aggregation, in which equal sub-aggregates are computed once. Checks that compare with bounds
take them from a first aggregation. Checks on value frequencies are in ``frequency``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions import exprs as X
from tablelens.functions.patterns import BASIC_PATTERNS, FORMAT_PATTERNS, LITERAL_URL, PII_PATTERNS
from tablelens.operators.quantiles import exact_quantiles

Fields = dict[str, Column]
QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
#: Aggregates in one job. The code that is generated for more gets too large to be compiled and runs several times slower;
#: as a job reads the columns of its own aggregates only, many jobs read little more than one.
CHUNK = 32


def unique_count(c: Column, kind: T.DataType, u: Column | None = None) -> Fields:
    """u: the number of distinct values, if it is known already, here and below."""
    u, n = F.count_distinct(c) if u is None else u, X.rows()
    return {"unique_count": u, "total_count": n, "unique_ratio": X.ratio(u, n), "status": F.when(u == 0, "warning").otherwise("passed")}


def null_analysis(c: Column, kind: T.DataType) -> Fields:
    n, nulls = X.rows(), F.count_if(c.isNull())
    r = X.ratio(nulls, n)
    status = F.when(r <= 0.05, "passed").when(r <= 0.25, "warning").otherwise("failed")
    return {"null_count": nulls, "total_count": n, "null_ratio": r, "status": status}


def duplicate_values(c: Column, kind: T.DataType, u: Column | None = None) -> Fields:
    n = X.rows()
    u = (F.count_distinct(c) if u is None else u) + F.coalesce(F.max(c.isNull().cast("long")), F.lit(0))
    return {"duplicate_count": n - u, "duplicate_ratio": X.ratio(n - u, n), "unique_count": u, "total_count": n, "status": F.lit("passed")}


def parseability(c: Column, kind: T.DataType) -> Fields:
    n, num = F.count(c), X.as_number(c, kind)
    share = lambda test: X.ratio(F.count_if(test), n)
    return {
        "int_ratio": share(num.isNotNull() & (num % 1 == 0)),
        "float_ratio": share(num.isNotNull()),
        "datetime_ratio": share(X.as_timestamp(c, kind).isNotNull()),
        "json_ratio": share(X.is_json(c, kind)),
        "non_null_count": n,
        "status": F.when(n == 0, "warning").otherwise("passed"),
    }


def _percentiles(c: Column, fractions: tuple[float, ...], known: dict[float, float] | None) -> Column:
    """The quantiles as an array: those known already, or by the built-in exact percentile."""
    if known is not None:
        return F.array(*[F.lit(known[x]).cast("double") for x in fractions])
    return F.percentile(c.cast("double"), F.array(*[F.lit(x) for x in fractions]))


def numeric_stats(c: Column, kind: T.DataType, known: dict[float, float] | None = None) -> Fields:
    """known: quantiles that were found before, here and below."""
    d = c.cast("double")
    n, lo, hi = F.count(c), F.min(d), F.max(d)
    one = lo == hi
    q = _percentiles(c, (0.25, 0.5, 0.75), known)
    zero = lambda v: F.when(one & (n > 0), F.lit(0.0)).otherwise(v)
    return {
        "mean": F.avg(d), "median": q[1], "std": zero(F.stddev_samp(d)), "min": lo, "max": hi, "q25": q[0], "q75": q[2],
        "skewness": zero(X.corrected_skewness(d)), "kurtosis": zero(X.corrected_kurtosis(d)), "range": hi - lo, "non_null_count": n,
        "status": F.when(n == 0, "warning").otherwise("passed"),
    }


def bounds(c: Column, kind: T.DataType, known: dict[float, float] | None = None) -> Fields:
    """What the two-phase numeric checks need first."""
    d = F.when(F.abs(c.cast("double")) < float("inf"), c.cast("double"))
    q = _percentiles(c, (0.25, 0.75), known)
    return {"n": F.count(c), "q1": q[0], "q3": q[1], "mean": F.avg(c.cast("double")), "std": F.stddev_pop(c.cast("double")), "lo": F.min(d), "hi": F.max(d), "finite": F.count(d)}


def fences(b) -> tuple:
    """Q1 - 1.5 IQR and Q3 + 1.5 IQR of ``bounds``, as columns or as numbers."""
    iqr = b["q3"] - b["q1"]
    return b["q1"] - 1.5 * iqr, b["q3"] + 1.5 * iqr


def outliers_iqr(c: Column, b: Column) -> Fields:
    """b: struct of ``bounds``. Strictly outside the fences; ``outlier_examples`` has the first of them."""
    d, (lo, hi) = c.cast("double"), fences(b)
    n, k = F.count(c), F.count_if((d < lo) | (d > hi))
    r = X.ratio(k, n)
    few = n < 4
    return {
        "outlier_count": F.when(few, 0).otherwise(k), "outlier_ratio": F.when(few, 0.0).otherwise(r), "lower_bound": F.when(~few, F.max(lo)),
        "upper_bound": F.when(~few, F.max(hi)), "non_null_count": n, "status": F.when(few | (r > 0.1), "warning").otherwise("passed"),
    }


def outlier_examples(df: DataFrame, limits: dict[str, tuple[float, float]], first: int = 10) -> DataFrame:
    """column, rank, value: the ``first`` smallest values outside (low, high) of each column, one job for all columns.

    Ranks are cut off before rows move, so that a column sends at most ``first`` values a task.
    """
    d = lambda n: X.col(n).cast("double")
    cells = F.array(*[F.struct(F.lit(n).alias("column"), F.when((d(n) < lo) | (d(n) > hi), d(n)).alias("value")) for n, (lo, hi) in limits.items()])
    rank = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    return df.select(F.inline(cells)).where("value is not null").withColumn("rank", rank).where(F.col("rank") <= first).select("column", "rank", "value")


def outliers_zscore(c: Column, b: Column, threshold: float = 3.0) -> Fields:
    n = F.count(c)
    k = F.count_if(F.abs((c.cast("double") - b["mean"]) / F.nullif(b["std"], F.lit(0.0))) > threshold)
    bad = (n < 4) | (F.coalesce(F.max(b["std"]), F.lit(0.0)) == 0)
    r = X.ratio(k, n)
    return {
        "outlier_count": F.when(bad, 0).otherwise(k), "outlier_ratio": F.when(bad, 0.0).otherwise(r), "threshold": F.lit(threshold),
        "non_null_count": n, "status": F.when(bad | (r > 0.1), "warning").otherwise("passed"),
    }


def quantiles(c: Column, kind: T.DataType, known: dict[float, float] | None = None) -> Fields:
    q = _percentiles(c, QUANTILES, known)
    return {f"q{int(x * 100):02d}": q[i] for i, x in enumerate(QUANTILES)} | {"non_null_count": F.count(c)}


def histogram_bin(c: Column, lo: Column, hi: Column, bins: Column) -> Column:
    """Bin of a value, from 1; equal widths, the last bin closed. One value alone lies in a range of one around it."""
    wide = hi > lo
    a, b = F.when(wide, lo).otherwise(lo - 0.5), F.when(wide, hi).otherwise(hi + 0.5)
    d = c.cast("double")
    return F.when((d >= a) & (d <= b), F.least(F.floor((d - a) / ((b - a) / bins)) + 1, bins.cast("long")))


def histogram(df: DataFrame, name: str, bins: int | None = None) -> DataFrame:
    """bin, low, high, count of a numeric column; by default least(20, greatest(5, floor(sqrt(n)))) bins."""
    c = X.col(name).cast("double")
    c = F.when(F.abs(c) < float("inf"), c)
    b = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n"))
    n = F.lit(bins).cast("int") if bins else F.least(F.lit(20), F.greatest(F.lit(5), F.floor(F.sqrt("n")).cast("int")))
    b = b.select(F.struct("lo", "hi", n.alias("bins")).alias("b"))
    s = b.scalar()
    counted = df.select(histogram_bin(c, s["lo"], s["hi"], s["bins"]).alias("bin")).where("bin is not null").groupBy("bin").agg(X.rows().alias("count"))
    wide = F.col("b.hi") > F.col("b.lo")
    low = F.when(wide, F.col("b.lo")).otherwise(F.col("b.lo") - 0.5)
    step = F.when(wide, (F.col("b.hi") - F.col("b.lo")) / F.col("b.bins")).otherwise(1.0 / F.col("b.bins"))
    every = b.where("b.lo is not null").select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("b.bins").cast("long"))).alias("bin"), low.alias("l"), step.alias("w"))
    every = every.join(counted, "bin", "left")
    return every.select("bin", (F.col("l") + F.col("w") * (F.col("bin") - 1)).alias("low"), (F.col("l") + F.col("w") * F.col("bin")).alias("high"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def modality(df: DataFrame, name: str) -> DataFrame:
    """peaks and modality of the 20-bin histogram, smoothed by a mean of three bins with zeros beyond the ends.

    A peak is an inner bin above both neighbours and at least a tenth of the highest.
    """
    w = Window.orderBy("bin")
    h = histogram(df, name, 20)
    h = h.withColumn("s", (F.col("count") + F.coalesce(F.lag("count").over(w), F.lit(0)) + F.coalesce(F.lead("count").over(w), F.lit(0))) / 3.0)
    h = h.withColumns({"a": F.lag("s").over(w), "b": F.lead("s").over(w), "top": F.max("s").over(Window.partitionBy(F.lit(0)))})
    peak = (F.col("s") > F.col("a")) & (F.col("s") > F.col("b")) & (F.col("s") >= 0.1 * F.col("top"))
    out = h.agg(F.count_if(peak).alias("peaks"), F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    few = F.col("n") < 10
    kind = F.when(few, "unknown").when(F.col("peaks") <= 1, "unimodal").when(F.col("peaks") == 2, "bimodal").otherwise("multimodal")
    return out.select(F.when(few, 0).otherwise(F.col("peaks")).cast("long").alias("peaks"), kind.alias("modality"), F.when(few, "warning").otherwise("passed").alias("status"))


def as_text(c: Column, null_as_text: bool = False) -> Column:
    t = c.cast("string")
    return F.coalesce(t, F.lit("nan")) if null_as_text else t


def text_length(c: Column, kind: T.DataType) -> Fields:
    n = F.char_length(as_text(c))
    return {
        "mean_length": F.avg(n), "median_length": F.percentile(n, F.lit(0.5)), "min_length": F.min(n).cast("long"), "max_length": F.max(n).cast("long"),
        "std_length": F.stddev_samp(n), "non_null_count": F.count(c), "status": F.when(F.count(c) == 0, "warning").otherwise("passed"),
    }


def whitespace(c: Column, kind: T.DataType) -> Fields:
    """Shares of the non-null values. The trailing test looks at the first line only, as ``.`` stops at its end."""
    t, n = as_text(c), F.count(c)
    share = lambda p: X.ratio(F.count_if(X.matches(t, p)), n)
    return {
        "leading_whitespace_ratio": share(r"\s+"), "trailing_whitespace_ratio": share(r".*\s+$"), "whitespace_only_ratio": share(r"\s*$"),
        "non_printable_ratio": X.ratio(F.count_if(t.rlike(r"[\x00-\x1f\x7f]")), n), "non_null_count": n, "status": F.lit("passed"),
    }


def text_patterns(c: Column, kind: T.DataType, literal_url: bool = False) -> Fields:
    t, n = as_text(c), F.count(c)
    patterns = BASIC_PATTERNS | ({"url_like": LITERAL_URL} if literal_url else {})
    counts = {k: F.count_if(X.matches(t, p)) for k, p in patterns.items()}
    most = F.greatest(*[X.ratio(k, n) for k in counts.values()])
    out = {f"{k}_{x}": v if x == "count" else X.ratio(v, n) for k, v in counts.items() for x in ("count", "ratio")}
    return out | {"skip_regex_inference": most > 0.8, "non_null_count": n, "status": F.lit("passed")}


def pii(c: Column, kind: T.DataType) -> Fields:
    t, n = as_text(c), F.count(c)
    counts = {k: F.count_if(X.matches(t, p)) for k, p in PII_PATTERNS.items()}
    total = sum(counts.values(), F.lit(0))
    out = {f"{k}_{x}": v if x == "count" else X.ratio(v, n) for k, v in counts.items() for x in ("count", "ratio")}
    return out | {"total_pii_matches": total, "total_rows": n, "pii_ratio": X.ratio(total, n), "status": F.when(n == 0, "warning").otherwise("passed")}


def data_formats(c: Column, kind: T.DataType) -> Fields:
    t, n = as_text(c), F.count(c)
    ratios = {k: X.ratio(F.count_if(X.matches(t, p)), n) for k, p in FORMAT_PATTERNS.items()}
    best = F.greatest(*ratios.values())
    name = None
    for k, r in ratios.items():
        name = F.when(r == best, k) if name is None else name.when(r == best, k)
    return {f"{k}_ratio": r for k, r in ratios.items()} | {
        "dominant_format": name, "dominant_format_ratio": best, "total_rows": n, "status": F.when(n == 0, "warning").otherwise("passed"),
    }


def date_validation(c: Column, kind: T.DataType) -> Fields:
    t, n = X.as_timestamp(c, kind), X.rows()
    valid = F.count(t)
    r = X.ratio(valid, n)
    span = F.floor((F.unix_micros(F.max(t)) - F.unix_micros(F.min(t))) / F.lit(86400 * 1000000))
    return {
        "valid_count": valid, "invalid_count": n - valid, "valid_ratio": r, "min_date": F.min(t), "max_date": F.max(t),
        "span_days": F.when(valid <= 1, 0).otherwise(span).cast("long"), "status": F.when(r == 1, "passed").when(r >= 0.95, "warning").otherwise("failed"),
    }


def memory_usage(c: Column, kind: T.DataType, u: Column | None = None) -> Fields:
    """An estimate: the width of the type, or the bytes of the text."""
    n = X.rows()
    used = F.coalesce(F.sum(X.width_bytes(c, kind)), F.lit(0))
    hint = F.lit(None).cast("string")
    if isinstance(kind, T.IntegralType):
        fits = lambda b: (F.min(c) >= -(1 << (b - 1))) & (F.max(c) <= (1 << (b - 1)) - 1)
        hint = F.when(fits(8), "int8").when(fits(16), "int16").when(fits(32), "int32")
    category = (F.count_distinct(c) if u is None else u) < n * 0.5 if isinstance(kind, T.StringType) else F.lit(False)
    return {
        "current_dtype": F.lit(kind.simpleString()), "memory_usage_bytes": used, "memory_per_value_bytes": X.ratio(used, n), "total_values": n,
        "optimization_potential": hint, "categorical_potential": category, "status": F.lit("passed"),
    }


def cardinality(c: Column, kind: T.DataType, u: Column | None = None) -> Fields:
    n, nulls, u = X.rows(), F.count_if(c.isNull()), F.count_distinct(c) if u is None else u
    r = X.ratio(u, n - nulls)
    return {
        "total_count": n, "unique_count": u, "null_count": nulls, "cardinality_ratio": r,
        "cardinality_level": F.when(r == 1, "unique").otherwise(X.ladder(r, [(0.9, "very_high"), (0.5, "high"), (0.1, "medium")], "low")),
        "index_suitability": X.ladder(r, [(0.8, "high"), (0.3, "medium")], "low"),
        "compression_potential": F.when(r < 0.1, "high").when(r < 0.5, "medium").otherwise("low"), "status": F.lit("passed"),
    }


#: Checks of one aggregation, by rule id.
SINGLE: dict[str, Callable[[Column, T.DataType], Fields]] = {
    "unique_count": unique_count,
    "null_analysis": null_analysis,
    "duplicate_value_analysis": duplicate_values,
    "parseability_analysis": parseability,
    "numeric_stats": numeric_stats,
    "length_analysis": text_length,
    "whitespace_encoding_checks": whitespace,
    "text_patterns": text_patterns,
    "pii_pattern_detection": pii,
    "data_format_patterns": data_formats,
    "date_validation": date_validation,
    "memory_usage_analysis": memory_usage,
    "cardinality_analysis": cardinality,
}


#: Checks that compare with bounds, which a first aggregation finds.
BOUNDED = ("outlier_detection", "outlier_detection_zscore", "numeric_histogram_quantiles", "modality_estimation")
#: Those that take the number of distinct values.
WITH_UNIQUE = ("unique_count", "duplicate_value_analysis", "memory_usage_analysis", "cardinality_analysis")


def per_column(df: DataFrame, names: list[str], check: Callable[[Column, T.DataType], Fields]) -> DataFrame:
    """One row for each column, all from one aggregation: column, and the check's fields."""
    kinds = {f.name: f.dataType for f in df.schema}
    made = [F.struct(F.lit(n).alias("column"), *[v.alias(k) for k, v in check(X.col(n), kinds[n]).items()]) for n in names]
    return df.agg(F.array(*made).alias("r")).select(F.inline("r"))


def known_quantiles(df: DataFrame, names: list[str]) -> dict[str, dict[float, float | None]]:
    """``QUANTILES`` of numeric columns by narrowing, whatever the number of distinct values; None where there are no values."""
    found = exact_quantiles(df, names, list(QUANTILES))
    return {n: found.get(n, dict.fromkeys(QUANTILES)) for n in names}


def per_numeric_column(df: DataFrame, names: list[str], check: Callable[..., Fields]) -> DataFrame:
    """As ``per_column`` for checks with quantiles, which are found first, so that no task gathers a column's values."""
    kinds, known = {f.name: f.dataType for f in df.schema}, known_quantiles(df, names)
    made = [F.struct(F.lit(n).alias("column"), *[v.alias(k) for k, v in check(X.col(n), kinds[n], known[n]).items()]) for n in names]
    return df.agg(F.array(*made).alias("r")).select(F.inline("r"))


def with_bounds(df: DataFrame, name: str, check: Callable[[Column, Column], Fields]) -> DataFrame:
    """A check that needs ``bounds``: quantiles by narrowing, if it takes them, the others from a scalar subquery over the same data."""
    kind = df.schema[name].dataType
    known = dict.fromkeys(QUANTILES) if check is outliers_zscore else known_quantiles(df, [name])[name]
    b = df.agg(F.struct(*[v.alias(k) for k, v in bounds(X.col(name), kind, known).items()]).alias("b")).scalar()
    return df.agg(*[v.alias(k) for k, v in check(X.col(name), b).items()]).select(F.lit(name).alias("column"), "*")
