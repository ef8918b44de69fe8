"""Types and levels: every boundary that results depend on."""

import pytest
from pyspark.sql import types as T

from tablelens.operators.attributes import column_attributes, simple_type


def one(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("c", kind)]))
    return column_attributes(df).first()


@pytest.mark.parametrize(
    ("values", "level"),
    [
        ([1, 2, 1, 2, 1], "low"),
        ([0, 1, 0, 1, 0], "binary"),
        ([1, 2, 3, 4, 5] * 2, "medium"),
        ([1, 2, 3, 4, 5, 6, 7, 1, 2, 3], "high"),
        ([*range(90), *range(10)], "distinctive"),
        (list(range(100)), "fully_unique"),
        ([7, 7, 7], "constant"),
        ([None, None], "low"),
    ],
)
def test_diversity(spark, values, level):
    assert one(spark, values, T.LongType())["diversity"] == level


@pytest.mark.parametrize(
    ("nulls", "total", "level"), [(1, 6, "low"), (4, 8, "medium"), (6, 8, "high"), (5, 6, "full"), (3, 3, "empty"), (0, 0, "empty"), (0, 4, "low")]
)
def test_nullability(spark, nulls, total, level):
    assert one(spark, [None] * nulls + [1.5] * (total - nulls), T.DoubleType())["nullability"] == level


@pytest.mark.parametrize(
    ("values", "kind", "category"),
    [
        (list(range(500)), T.LongType(), "categorical"),
        (list(range(499)), T.LongType(), "numeric"),
        ([x + 0.5 for x in range(600)], T.DoubleType(), "numeric"),
        (["a", "b"], T.StringType(), "textual"),
        ([None, None], T.StringType(), "unknown"),
        (["[1, 2]", "[]", None], T.StringType(), "array"),
        (['{"a": 1}', "{}"], T.StringType(), "dictionary"),
        (["[1, 2]", "x", "y"], T.StringType(), "textual"),
        (["[1,]", "[2,]"], T.StringType(), "textual"),
        ([True, None, False], T.BooleanType(), "boolean"),
        ([[1], [2]], T.ArrayType(T.LongType()), "array"),
        ([{"a": 1}], T.MapType(T.StringType(), T.LongType()), "dictionary"),
        ([b"x"], T.BinaryType(), "unknown"),
    ],
)
def test_type_category(spark, values, kind, category):
    assert one(spark, values, kind)["type_category"] == category


def test_index(spark):
    assert one(spark, [1, 2, 3], T.LongType())["is_likely_index"]
    assert not one(spark, [1.5, 2.0, 3.0], T.DoubleType())["is_likely_index"]
    assert not one(spark, [1, 1, 2], T.LongType())["is_likely_index"]


def test_simple_type():
    assert [simple_type(v) for v in ([], ["a", "a", "b"], ["a", "b"], [True, False], [1, 2.5], [None])] == ["unknown", "categorical", "textual", "boolean", "numeric", "unknown"]
