"""URL filters by a path-template tree.

Each host has a tree of path segments. Segments that vary (numbers, hexadecimal ids, names with digits, and literals of
which a parent has very many) become wildcards; sibling branches that go on alike and whose labelled rates are alike
are merged; and a template whose smoothed share of bad labels is high is rejected.

Rules decide the pages that they fit, and these decided pages are the labels of the tree, so the method carries what
the rules say over to the rest of a host only where its templates are purely bad.

Nulls: a null URL, or one without ``://``, has an empty host and path. Empty tables give an empty result, repeated rows
are judged one by one, other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import materialise, only

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A literal segment becomes a wildcard where its parent has at least so many different literal children.
MANY_CHILDREN = 32
#: Laplace smoothing: (bad + 1) / (labelled + 2) of a template must reach NUM / DEN for rejection.
SMOOTH_NUM, SMOOTH_DEN = 8, 10


def host_of(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. rules: (verdict, 'host/path')."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, tail = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{tail}")
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def segment_class(segment: Column) -> Column:
    """Wildcards for segments that vary by their form alone."""
    return (
        F.when(segment.rlike(r"^[0-9]+$"), F.lit("<num>"))
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z]+$"), F.concat(F.lit("<num>"), F.regexp_extract(segment, r"(\.[A-Za-z]+)$", 1)))
        .when(segment.rlike(r"^[0-9A-Fa-f-]{8,}$"), F.lit("<hex>"))
        .when(segment.rlike(r"[0-9]"), F.lit("<id>"))
        .otherwise(segment)
    )


def templates(paths: DataFrame) -> DataFrame:
    """Template and labels of every (host, shape): the tree work, on one row per distinct shape.

    paths: host, shape (array of segment classes), n, bad, good. A node is (host, parent shape, segment). Siblings with
    equal (continuation, label state) are one branch: the continuation is the set of child classes, the label state
    whether the node's labels are mostly bad, mostly good, mixed or none. A merged branch of two or more names, and any
    literal under a parent with many, is written ``*``.
    """
    nodes = paths.select(
        "host", "shape", "n", "bad", "good", F.posexplode_outer("shape").alias("at", "segment")
    ).select(
        "host",
        "shape",
        "at",
        "segment",
        "n",
        "bad",
        "good",
        F.slice("shape", 1, F.coalesce(F.col("at"), F.lit(0))).alias("parent"),
        F.try_element_at("shape", F.coalesce(F.col("at") + 2, F.lit(1))).alias("child"),
    )
    nodes = nodes.where("at is not null")
    # Literal children of a node count as one kind of continuation.
    kind = F.when(F.col("child").isNull(), "$").when(F.col("child").startswith("<"), F.col("child")).otherwise("word")
    stats = nodes.groupBy("host", "parent", "segment").agg(
        F.array_sort(F.collect_set(kind)).alias("goes_on"), F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    state = (
        F.when(F.col("bad") + F.col("good") == 0, "none")
        .when(F.col("good") * 10 <= F.col("bad"), "bad")
        .when(F.col("bad") * 10 <= F.col("good"), "good")
        .otherwise("mixed")
    )
    wild = F.col("segment").startswith("<")
    stats = stats.select("host", "parent", "segment", "goes_on", state.alias("state"), wild.alias("wild"))
    stats = materialise(stats, "url-branches")
    # Counts by groups, joined back: a parent with very many children is no single task's.
    branch, siblings = ["host", "parent", "wild", "goes_on", "state"], ["host", "parent", "wild"]
    alike = materialise(stats.groupBy(*branch).agg(F.count(F.lit(1)).alias("alike")), "url-alike")
    names = materialise(stats.groupBy(*siblings).agg(F.count(F.lit(1)).alias("names")), "url-names")
    stats = stats.join(alike, branch).join(names, siblings)
    merged = (
        F.when(F.col("wild"), F.col("segment"))
        .when(F.col("alike") >= 2, F.concat(F.lit("*"), F.col("state")))
        .when(F.col("names") >= MANY_CHILDREN, F.lit("*"))
        .otherwise(F.col("segment"))
    )
    named = stats.select("host", "parent", "segment", merged.alias("token"))
    return (
        nodes.join(named, ["host", "parent", "segment"])
        .groupBy("host", "shape")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]), "/").alias("t"))
        .select("host", "shape", F.concat(F.lit("/"), "t").alias("template"))
    )


def judge(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """Verdict on every URL: key, host, path, rule, verdict, template, labelled, bad."""
    parts = only(pages, key, url).select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    r = longest_rule(F.col("host"), F.col("path"), rules)
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    urls = materialise(
        parts.select("*", r["rule"].alias("rule"), r["verdict"].alias("ruled"), F.transform(segments, segment_class).alias("shape")),
        "urls",
    )
    shapes = urls.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("ruled") == "block").alias("bad"),
        F.count_if(F.col("ruled") == "allow").alias("good"),
    )
    shapes = materialise(shapes, "url-shapes")
    # A path without segments is its own template.
    trees = shapes.join(templates(shapes), ["host", "shape"], "left").select(
        "host", "shape", F.coalesce("template", F.lit("/")).alias("template"), "bad", "good"
    )
    purity = trees.groupBy("host", "template").agg(F.sum("bad").alias("bad"), (F.sum("bad") + F.sum("good")).alias("labelled"))
    reject = (F.col("bad") + 1) * SMOOTH_DEN >= (F.col("labelled") + 2) * SMOOTH_NUM
    judged = (
        trees.select("host", "shape", "template")
        .join(purity, ["host", "template"])
        .select("host", "shape", "template", "bad", "labelled", F.when(reject, "block").otherwise("allow").alias("learned"))
    )
    return urls.join(judged, ["host", "shape"]).select(
        "key", "host", "path", "rule", F.coalesce("ruled", "learned").alias("verdict"), "template", "labelled", "bad"
    )
