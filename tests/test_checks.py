"""Column checks on frames with answers worked out by hand."""

import math
from statistics import NormalDist

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablelens.functions import exprs as X
from tablelens.operators import columns as C
from tablelens.operators import frequency as Q
from tablelens.operators import nested as N


def texts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "c string")


def numbers(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "c double")


def test_duplicates_unique_nulls(spark):
    df = texts(spark, ["a", "a", "b", "c"])
    assert C.per_column(df, ["c"], C.duplicate_values).first()["duplicate_count"] == 1
    df = texts(spark, ["a", None, None])
    d = C.per_column(df, ["c"], C.duplicate_values).first()
    assert (d["duplicate_count"], d["unique_count"]) == (1, 2)
    u = C.per_column(df, ["c"], C.unique_count).first()
    assert (u["unique_count"], u["unique_ratio"]) == (1, pytest.approx(1 / 3))
    assert C.per_column(df, ["c"], C.null_analysis).first()["status"] == "failed"


def test_parseability(spark):
    r = C.per_column(texts(spark, ["1", "2.5", "x", "2020-01-01", '{"a":1}', None, "1d", "NaN"]), ["c"], C.parseability).first()
    assert (r["int_ratio"], r["float_ratio"], r["datetime_ratio"], r["json_ratio"]) == tuple(pytest.approx(k / 7) for k in (1, 2, 1, 3))


def test_moments_and_outliers(spark):
    df = X.normalise(numbers(spark, [1, 2, 3, 4, 100, None, math.nan]))
    r = C.per_column(df, ["c"], C.numeric_stats).first()
    assert r["non_null_count"] == 5
    assert r["median"] == 3
    values = pd.Series([1, 2, 3, 4, 100])
    assert r["skewness"] == pytest.approx(values.skew())
    assert r["kurtosis"] == pytest.approx(values.kurt())
    o = C.with_bounds(df, "c", C.outliers_iqr).first()
    assert (o["outlier_count"], o["lower_bound"], o["upper_bound"], o["status"]) == (1, -1.0, 7.0, "warning")
    few = C.with_bounds(numbers(spark, [1, 2, 50]), "c", C.outliers_iqr).first()
    assert (few["outlier_count"], few["status"]) == (0, "warning")
    same = C.with_bounds(numbers(spark, [5] * 6), "c", C.outliers_zscore).first()
    assert (same["outlier_count"], same["status"]) == (0, "warning")
    c = C.per_column(numbers(spark, [42, 42]), ["c"], C.numeric_stats).first()
    assert (c["std"], c["skewness"], c["range"]) == (0.0, 0.0, 0.0)


def test_histogram(spark):
    rows = C.histogram(numbers(spark, range(100)), "c", 10).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [10] * 10
    assert [r["count"] for r in C.histogram(numbers(spark, [3] * 4), "c").collect()].count(4) == 1
    assert C.histogram(numbers(spark, [None]), "c").count() == 0
    assert C.modality(numbers(spark, [1] * 5), "c").first()["modality"] == "unknown"
    bell = [NormalDist().inv_cdf(i / 1000) for i in range(1, 1000)]
    assert C.modality(numbers(spark, bell), "c").first()["modality"] == "unimodal"
    assert C.modality(numbers(spark, [*bell, *(x + 8 for x in bell)]), "c").first()["modality"] == "bimodal"


def test_text(spark):
    r = C.per_column(texts(spark, [" a", "b ", "   ", "c\x07", "ok"]), ["c"], C.whitespace).first()
    assert (r["leading_whitespace_ratio"], r["trailing_whitespace_ratio"], r["whitespace_only_ratio"], r["non_printable_ratio"]) == (0.4, 0.4, 0.2, 0.2)
    p = C.per_column(texts(spark, [f"person{i}@example.com" for i in range(5)]), ["c"], C.text_patterns).first()
    assert p["skip_regex_inference"] and p["email_like_ratio"] == 1.0
    urls = texts(spark, ["https://example.com/a", "http://x.y"])
    assert C.per_column(urls, ["c"], C.text_patterns).first()["url_like_count"] == 2
    assert C.per_column(urls, ["c"], lambda c, k: C.text_patterns(c, k, True)).first()["url_like_count"] == 1
    f = C.per_column(texts(spark, ["abc_d", "ef"]), ["c"], C.data_formats).first()
    assert f["dominant_format"] == "snake_case"
    i = C.per_column(texts(spark, ["10.0.0.1", "123-45-6789", "x"]), ["c"], C.pii).first()
    assert (i["ip_address_pattern_count"], i["ssn_pattern_count"], i["total_rows"]) == (1, 1, 3)


def test_frequencies(spark):
    df = texts(spark, ["a", "b", None, None, None, "b"])
    freq = Q.frequencies(df, ["c"])
    m = Q.most_common(freq).first()
    assert (m["most_common_value"], m["frequency"], m["most_common_non_null"], m["non_null_frequency_ratio"]) == (None, 3, "b", pytest.approx(2 / 3))
    assert [(r["value"], r["count"]) for r in Q.top_values(freq).orderBy("rank").collect()] == [("b", 2), ("a", 1)]
    e = Q.entropy(freq).first()
    assert e["entropy"] == pytest.approx(0.9183, abs=1e-4)
    assert e["repeated_value_share"] == pytest.approx(2 / 3)
    assert Q.most_common(Q.frequencies(texts(spark, [None, None]), ["c"])).first()["status"] == "warning"
    many = texts(spark, [str(i) for i in range(15)])
    assert Q.top_k(Q.frequencies(many, ["c"])).first()["other_count"] == 5


def test_nested(spark):
    df = texts(spark, ["[1, [2, {\"a\": []}]]", "[]", "x", None, "[1]"])
    a = N.array_lengths(df, "c").first()
    assert (a["min_length"], a["max_length"], a["median_length"], a["invalid_count"], a["valid_count"]) == (0, 2, 1, 1, 3)
    d = N.depths(df, "c", "array").first()
    assert (d["min_depth"], d["max_depth"]) == (1, 4)
    types = {r["element_type"]: r["count"] for r in N.element_types(texts(spark, ['[1, 1.5, "a", true, null, [], {}]']), "c").collect()}
    assert types == {k: 1 for k in ("int", "float", "str", "bool", "NoneType", "list", "dict")}
    o = texts(spark, ['{"a": 1, "b": {"c": 2}}', '{"a": "x"}', "[]"])
    k = N.key_summary(o, "c").first()
    assert (k["unique_keys"], k["common_keys"], k["valid_count"], k["invalid_count"]) == (2, 1, 2, 1)
    assert k["top_keys"][0]["key"] == "a"
    assert N.schema_summary(o, "c").first()["unique_schemas"] == 2
    assert {(r["key"], r["value_type"]) for r in N.value_types(o, "c").collect()} == {("a", "int"), ("a", "str"), ("b", "dict")}
    native = spark.createDataFrame([([1, 2],), ([3],)], "c array<int>")
    assert N.array_lengths(native, "c").first()["total_elements"] == 3


def test_dates(spark):
    df = texts(spark, ["2020-01-01", "2020-01-11", "x", None])
    r = C.per_column(df, ["c"], C.date_validation).first()
    assert (r["valid_count"], r["span_days"], r["status"]) == (2, 10, "failed")


def test_partitioning_does_not_matter(spark):
    df = numbers(spark, [1, 5, 2, 8, None, 3, 3])
    a = C.per_column(df.repartition(7), ["c"], C.numeric_stats).first().asDict()
    b = C.per_column(df.coalesce(1), ["c"], C.numeric_stats).first().asDict()
    assert a == pytest.approx(b)
    assert df.repartition(5, F.col("c")).count() == 7


def test_quantiles_by_narrowing(spark, monkeypatch):
    """Narrowed ranks are the sorted values' own, for spread, repeated, skewed and infinite values."""
    from tablelens.operators import quantiles

    monkeypatch.setattr(quantiles, "FEW", 50)
    rows = [(float((i * 7919) % 9973), float(i % 7), float(2 ** (i % 40)), None if i % 3 else i / 7) for i in range(6000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    fractions = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantiles.exact_quantiles(df, ["a", "b", "c", "d"], fractions)
    table = pd.DataFrame(rows, columns=["a", "b", "c", "d"])
    for n in table:
        assert [got[n][q] for q in fractions] == pytest.approx(table[n].dropna().quantile(fractions).tolist())
    assert quantiles.exact_quantiles(df.where("a < 0"), ["a"], [0.5]) == {}
