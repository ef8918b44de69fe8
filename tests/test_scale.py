"""Checks whose plans must not gather a column, a row or a file where a bounded part will do."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tablelens import Profiler, ProfilingConfig
from tablelens.operators import columns as C
from tablelens.operators import frequency as Q
from tablelens.operators import nested as N
from tablelens.plans.profiler import table_stats
from tablelens.sources import readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def random_json(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice([1, -2.5, None, True, "", "[", "]]{", 'a"b', "back\\", '\\"[', "\\\\", "é[\n"])
    if rng.random() < 0.5:
        return [random_json(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["k", '"}', "[[", "\\"]) + str(i): random_json(rng, depth - 1) for i in range(rng.randrange(4))}


def deep(v):
    if isinstance(v, dict):
        v = list(v.values())
    return 1 + max(map(deep, v), default=0) if isinstance(v, list) else 0


def test_nesting(spark):
    rng = random.Random(7)
    values = [random_json(rng, rng.randrange(7)) for _ in range(300)] + [[[]], {}, [], 3, "[[", ["x" * 100_000 + "["]]
    df = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=i % 2 == 0, indent=i % 3 or None)) for i, v in enumerate(values)], "i int, j string")
    got = df.select("i", N.nesting(F.col("j")).alias("d"), N.nesting(F.lit(None).cast("string")).alias("none")).collect()
    assert {r["i"]: r["d"] for r in got} == {i: deep(v) for i, v in enumerate(values)}
    assert all(r["none"] is None for r in got)


def test_depths_run_no_python(spark):
    df = spark.createDataFrame([('[[1, "]"], {"a": []}]',), ("[1]",), ("x[",), (None,)], "c string")
    out = N.depths(df, "c", "array")
    assert "Python" not in plan(out)
    assert tuple(out.first()) == (2.0, 1, 3, 2, 1, "passed")
    typed = spark.createDataFrame([([[1], []],), ([],)], "c array<array<int>>")
    assert tuple(N.depths(typed, "c", "array").first())[:3] == (1.5, 1, 2)


def test_invalid_dictionaries_are_counted(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": 2}',), ("[1]",), ("x",), (None,)], "c string")
    r = N.schema_summary(df, "c").first()
    assert (r["valid_count"], r["invalid_count"], r["most_common_schema"]) == (2, 2, "a")


def test_duplicates_go_by_hashes_of_one_size(spark):
    """Nulls in different places, empty texts, values that move between columns: all rows that differ count."""
    rows = [(1, None, "a"), (None, 1, "a"), (1, None, "a"), (1, 1, ""), (1, 1, None), (None, None, None), (None, None, None), (0, 1, "1"), (1, 0, "1")]
    df = spark.createDataFrame(rows, "x int, y int, z string")
    r = table_stats(df).first()
    assert (r["row_count"], r["column_count"], r["duplicate_rows"]) == (9, 3, 2)
    maps = spark.createDataFrame([({"a": 1}, [None, 1]), ({"a": 1}, [None, 1]), ({"a": 1}, [1, None]), (None, None)], "m map<string,int>, l array<int>")
    assert table_stats(maps).first()["duplicate_rows"] == 1
    wide = spark.range(10).select(*[(F.col("id") % 3).alias(f"c{i}") for i in range(40)])
    exchange = plan(table_stats(wide)).split("Exchange hashpartitioning")[1]
    assert "h#" in exchange.split(")")[0] and "c0#" not in exchange.split("\n")[0]
    assert table_stats(wide).first()["duplicate_rows"] == 7
    assert tuple(table_stats(wide.limit(0)).first()) == (0, 40, 0, 0)
    assert tuple(table_stats(spark.range(3).select()).first()) == (3, 0, 0, 0)


def test_quantiles_gather_no_column(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).cast("double").alias("a"), F.lit(None).cast("double").alias("none"), (F.col("id") % 2).alias("b"))
    for out in (C.per_numeric_column(df, ["a", "none", "b"], C.numeric_stats), C.with_bounds(df, "a", C.outliers_iqr)):
        assert "percentile(" not in plan(out)
    r = {x["column"]: x for x in C.per_numeric_column(df, ["a", "none", "b"], C.quantiles).collect()}
    values = sorted(i * 7919 % 3001 for i in range(3000))
    at = 0.25 * 2999
    assert r["a"]["q25"] == pytest.approx(values[int(at)] + (at % 1) * (values[int(at) + 1] - values[int(at)]))
    assert r["none"]["q50"] is None and r["none"]["non_null_count"] == 0
    assert r["b"]["q50"] == 0.5
    # The same as the built-in percentile, for every field.
    mine, theirs = C.per_numeric_column(df, ["a", "b"], C.numeric_stats).collect(), C.per_column(df, ["a", "b"], C.numeric_stats).collect()
    assert mine == theirs


def test_outlier_examples(spark):
    """The ten smallest of each column, from one job; ties are each one; ranks are cut before the shuffle."""
    df = spark.range(1000).select((F.col("id") % 100).cast("double").alias("a"), F.when(F.col("id") < 990, 1.0).otherwise(-F.col("id").cast("double")).alias("b"), F.lit(1.0).alias("c"))
    out = C.outlier_examples(df, {"a": (5.0, 1e9), "b": (0.0, 2.0), "c": (0.0, 2.0)})
    assert "WindowGroupLimit" in plan(out)
    got = {}
    for r in out.orderBy("column", "rank").collect():
        got.setdefault(r["column"], []).append(r["value"])
    assert got == {"a": [0.0] * 10, "b": [-float(i) for i in range(999, 989, -1)]}


def test_outlier_examples_in_a_profile(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 500 == 7, 1e6 + F.col("id")).otherwise(F.col("id") * 13 % 700 / 7).alias("a"), F.col("id").cast("string").alias("t"))
    r = next(r for r in Profiler(ProfilingConfig(enable_cross_column=False)).profile(df).results if r.rule_id == "outlier_detection")
    assert r.details["outlier_count"] == 4
    assert r.details["outlier_examples"] == [1e6 + i for i in (7, 507, 1007, 1507)]


def test_pairs_left_out_are_counted(spark):
    df = spark.range(50).select(*[(F.col("id") * (i + 2) % 11).alias(f"c{i}") for i in range(5)])
    assert Profiler(ProfilingConfig(max_cross_column_pairs=4)).profile(df).metadata["pairs_left_out"] == 6
    assert Profiler().profile(df).metadata["pairs_left_out"] == 0


def test_partitions_open_no_data_file(spark, tmp_path):
    """Names of folders and the catalog say it all: the files of this table can't be read."""
    rows = [(i, i % 3, v) for i in range(6) for v in ("a/b", "x=y", None)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "v int, n int, s string").write.partitionBy("n", "s").parquet(path)
    spark.sql(f"CREATE TABLE parts (v int, n int, s string) USING parquet PARTITIONED BY (n, s) LOCATION '{path}'")
    spark.catalog.recoverPartitions("parts")
    for f in (tmp_path / "t").rglob("part-*.parquet"):
        f.write_bytes(b"no parquet")
    for crc in (tmp_path / "t").rglob(".*.crc"):
        crc.unlink()
    want = {"keys": ["n", "s"], "values": {"n": [0, 1, 2], "s": [None, "a/b", "x=y"]}}
    assert readers.partitions(spark, "parts") == want
    with pytest.raises(Exception, match="(?i)parquet"):
        spark.table("parts").selectExpr("sum(v)").collect()
    spark.sql("DROP TABLE parts")


def test_store_addresses(spark):
    assert readers.store_path(spark, "s3://bucket/key.csv") == "s3a://bucket/key.csv"
    spark._jsc.hadoopConfiguration().set("fs.s3.impl", "org.example.Some")
    try:
        assert readers.store_path(spark, "s3://bucket/key.csv") == "s3://bucket/key.csv"
    finally:
        spark._jsc.hadoopConfiguration().unset("fs.s3.impl")
    with pytest.raises(ValueError):
        readers.read_object_csv(spark, "file:///etc/passwd")


def test_long_texts_are_counted_by_digest(spark):
    """Texts around the length at which digests take over, those that begin alike, and one that has a zero itself."""
    start = "y" * Q.LONG
    texts = [start] * 3 + [start + "a"] * 5 + [start + "b"] * 4 + [start[:-1]] * 2 + [start + "\0" + "0" * 32] * 2 + ["short"] * 6 + [None] * 7
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, i int")
    freq = Q.frequencies(df, ["t"])
    assert {r["count"] for r in freq.collect() if r["value"] and len(r["value"]) > Q.LONG} == {5, 4, 2}
    assert all(len(r["value"] or "") <= Q.LONG + 33 for r in freq.collect())
    top = [(r["rank"], r["value"], r["count"]) for r in Q.with_texts(df, Q.top_values(freq)).orderBy("rank").collect()]
    assert top[:5] == [(1, "short", 6), (2, start + "a", 5), (3, start + "b", 4), (4, start, 3), (5, start[:-1], 2)]
    assert top[5] == (6, start + "\0" + "0" * 32, 2)
    assert Q.whole_texts(df, [("t", "short"), ("t", None)]) == {}


def test_long_texts_in_a_profile(spark):
    long = "z" * 500
    df = spark.createDataFrame([(long + str(i % 3) if i % 4 else long,) for i in range(80)], "t string")
    report = Profiler().profile(df)
    by_rule = {r.rule_id: r.details for r in report.results}
    assert by_rule["most_common_value"]["most_common_value"] in (long, *(long + str(i) for i in range(3)))
    assert {v["value"] for v in by_rule["top_k_frequencies"]["values"]} == {long, *(long + str(i) for i in range(3))}
    assert report.column_analysis["t"]["most_common_value"] == by_rule["most_common_value"]["most_common_value"]


def test_counting_long_texts_moves_little(spark):
    df = spark.range(2000).select(F.concat(F.repeat(F.md5(F.col("id").cast("string")), F.lit(100)), F.col("id")).alias("t"))
    text = df.agg(F.sum(F.octet_length("t"))).first()[0]
    rows = Q.frequencies(df, ["t"]).agg(F.sum(F.octet_length("value"))).first()[0]
    assert rows < 0.1 * text
