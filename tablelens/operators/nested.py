"""Checks of arrays and dictionaries, as JSON text or as native types, all by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions import exprs as X


def json_text(c: Column, kind: T.DataType) -> Column:
    return c if isinstance(kind, T.StringType) else F.to_json(c)


def valid(c: Column, kind: T.DataType, shape: str) -> Column:
    """The JSON text of a value of the wanted shape (``array`` or ``object``), else null."""
    if isinstance(kind, T.StringType):
        return F.when(X.json_kind(c) == shape, c)
    return F.to_json(c)


def _parts(df: DataFrame, name: str, shape: str) -> DataFrame:
    """raw, j (valid JSON text or null) of every row."""
    kind = df.schema[name].dataType
    return df.select(X.col(name).isNotNull().alias("present"), valid(X.col(name), kind, shape).alias("j"))


def array_lengths(df: DataFrame, name: str) -> DataFrame:
    """mean, median (upper middle), min, max, totals of the lengths, and invalid values."""
    p = _parts(df, name, "array").select("present", F.json_array_length("j").alias("n"))
    a = p.agg(
        F.avg("n").alias("mean_length"), F.min("n").cast("long").alias("min_length"), F.max("n").cast("long").alias("max_length"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_elements"), F.count("n").alias("valid_count"),
        F.count_if(F.col("present") & F.col("n").isNull()).alias("invalid_count"),
    )
    # The element at place floor(n / 2) of the sorted lengths, from counts by length.
    from pyspark.sql import Window

    by = p.where("n is not null").groupBy("n").agg(X.rows().alias("k"))
    upto = F.sum("k").over(Window.orderBy("n"))
    all_k = F.sum("k").over(Window.partitionBy(F.lit(0)))
    mid = by.select("n", upto.alias("upto"), all_k.alias("all")).where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("n").cast("long").alias("m"))
    return a.withColumn("median_length", mid.scalar()).withColumn("status", F.when(F.col("valid_count") == 0, "warning").otherwise("passed"))


def nesting(j: Column) -> Column:
    """Nesting depth of valid JSON text, scalars 0: the most brackets that are open at once outside strings.

    Escaped backslashes and quotes go first, then strings, then all that is no bracket; what is left is counted along.
    """
    bare = F.replace(F.replace(j, F.lit("\\\\")), F.lit('\\"'))
    brackets = F.regexp_replace(F.regexp_replace(bare, '"[^"]*"', ""), r"[^\[\]{}]", "")
    step = lambda b: F.when(b.isin("[", "{"), 1).when(b == "", 0).otherwise(-1)
    open_ = lambda a, b: F.struct((a["now"] + step(b)).alias("now"), F.greatest(a["most"], a["now"] + step(b)).alias("most"))
    return F.aggregate(F.split(brackets, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), open_, lambda a: a["most"])


def depths(df: DataFrame, name: str, shape: str) -> DataFrame:
    """mean, min, max nesting depth: 1 for a flat value, one more for each list or object inside."""
    p = _parts(df, name, shape).select("present", nesting(F.col("j")).alias("d"), "j")
    return p.agg(
        F.avg("d").alias("mean_depth"), F.min("d").alias("min_depth"), F.max("d").alias("max_depth"), F.count("d").alias("valid_count"),
        F.count_if(F.col("present") & F.col("j").isNull()).alias("invalid_count"), F.when(F.count("d") == 0, "warning").otherwise("passed").alias("status"),
    )


def type_name(v: Column) -> Column:
    """The JSON value's type by the names that Python gives."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (s == "VOID"), "NoneType")
        .when(s.startswith("ARRAY"), "list")
        .when(s.startswith("OBJECT"), "dict")
        .when(s == "STRING", "str")
        .when(s == "BOOLEAN", "bool")
        .when(s.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | s.rlike(r"^DECIMAL\(\d+,0\)$"), "int")
        .otherwise("float")
    )


def element_types(df: DataFrame, name: str) -> DataFrame:
    """element_type, count, ratio of the elements of all arrays."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.VariantType | T.ArrayType | T.MapType | T.StructType):
        names = {T.StringType: "str", T.BooleanType: "bool", T.FloatType: "float", T.DoubleType: "float"}
        known = next((v for k, v in names.items() if isinstance(kind.elementType, k)), "int")
        t = df.select(F.explode(X.col(name)).alias("e")).select(F.when(F.col("e").isNull(), "NoneType").otherwise(known).alias("element_type"))
    else:
        v = _parts(df, name, "array").where("j is not null").select(F.expr("cast(try_parse_json(j) as array<variant>)").alias("v"))
        t = v.select(F.explode("v").alias("e")).select(type_name(F.col("e")).alias("element_type"))
    from pyspark.sql import Window

    g = t.groupBy("element_type").agg(X.rows().alias("count"))
    return g.select("*", (F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(0)))).alias("ratio"))


def key_counts(df: DataFrame, name: str) -> DataFrame:
    """key, count of dictionaries that have it, and in_all."""
    p = _parts(df, name, "object").where("j is not null")
    total = p.agg(X.rows().alias("n")).scalar()
    keys = p.select(F.explode(F.array_distinct(F.json_object_keys("j"))).alias("key")).groupBy("key").agg(X.rows().alias("count"))
    return keys.select("key", "count", (F.col("count") == total).alias("in_all"))


def key_summary(df: DataFrame, name: str, k: int = 10) -> DataFrame:
    """unique_keys, common_keys (in every dictionary), top keys, totals and invalid values."""
    counts = key_counts(df, name)
    top = counts.orderBy(F.desc("count"), "key").limit(k).agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("minus"), "key"))).alias("t"))
    top = top.select(F.transform("t", lambda x: F.struct(x["key"].alias("key"), (-x["minus"]).alias("count"))))
    a = counts.agg(X.rows().alias("unique_keys"), F.count_if("in_all").alias("common_keys"), F.coalesce(F.sum("count"), F.lit(0)).alias("total_keys"))
    p = _parts(df, name, "object").agg(F.count("j").alias("valid_count"), F.count_if(F.col("present") & F.col("j").isNull()).alias("invalid_count"))
    return p.select("*", F.when(F.col("valid_count") == 0, "warning").otherwise("passed").alias("status")).withColumns({
        n: a.select(n).scalar() for n in ("unique_keys", "common_keys", "total_keys")
    }).withColumn("top_keys", top.scalar())


def schemas(df: DataFrame, name: str) -> DataFrame:
    """signature (sorted keys), count, ratio of the dictionaries."""
    from pyspark.sql import Window

    p = _parts(df, name, "object").where("j is not null")
    g = p.select(F.array_join(F.array_sort(F.array_distinct(F.json_object_keys("j"))), ",").alias("signature")).groupBy("signature").agg(X.rows().alias("count"))
    return g.select("*", (F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(0)))).alias("ratio"))


def value_types(df: DataFrame, name: str) -> DataFrame:
    """key, value_type, count over all dictionaries."""
    p = _parts(df, name, "object").where("j is not null").select(F.expr("cast(try_parse_json(j) as map<string,variant>)").alias("m"))
    e = p.select(F.explode("m").alias("key", "v"))
    return e.groupBy("key", type_name(F.col("v")).alias("value_type")).agg(X.rows().alias("count"))


def schema_summary(df: DataFrame, name: str) -> DataFrame:
    s = schemas(df, name)
    best = F.min(F.struct((-F.col("count")).alias("c"), F.col("signature").alias("s"), F.col("ratio").alias("r")))
    invalid = _parts(df, name, "object").agg(F.count_if(F.col("present") & F.col("j").isNull()).alias("n"))
    return s.agg(
        X.rows().alias("unique_schemas"), best["s"].alias("most_common_schema"), best["r"].alias("consistency_ratio"), F.coalesce(F.sum("count"), F.lit(0)).alias("valid_count")
    ).withColumn("invalid_count", invalid.scalar()).withColumn("status", F.when(F.col("valid_count") == 0, "warning").otherwise("passed"))
