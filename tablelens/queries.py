"""The profiler's registered queries and the DuckDB SQL that they must agree with.

Names of columns are chosen equal on both sides; derived floats are rounded to six places on both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions import exprs as X
from tablelens.functions.patterns import BASIC_PATTERNS, FORMAT_PATTERNS, PII_PATTERNS
from tablelens.operators import attributes as A
from tablelens.operators import columns as C
from tablelens.operators import discovery as D
from tablelens.operators import frequency as Q
from tablelens.operators import keys as K
from tablelens.operators import nested as N
from tablelens.operators import pairs as P
from tablelens.operators import two_stage as S
from tablelens.operators.quantiles import exact_quantiles
from tablelens.operators.regex_inference import infer_patterns
from tablelens.operators.sampling import sample
from tablelens.plans.insights import insights
from tablelens.plans.profiler import Profiler, table_stats
from tablelens.plans.registry import Registry
from tablelens.plans.report import results_frame
from tablelens.plans.types import ProfilingConfig, Rule
from tablelens.sources.readers import partition_scan, run_query

PLACES = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame) -> DataFrame:
    """Floats rounded, whole numbers as long."""
    out = []
    for f in df.schema:
        c = X.col(f.name)
        if isinstance(f.dataType, T.FloatType | T.DoubleType | T.DecimalType):
            c = F.round(c.cast("double"), PLACES) + F.lit(0.0)
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(out)


def query(sql: str | None = None):
    """Register a query; ``sql`` is its oracle."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def r6(x: str) -> str:
    return f"round({x}, {PLACES})"


def each(table: str, names: list[str], body: str) -> str:
    """The SQL ``body`` over each column: {c} is the column, {t} the table."""
    return union([f"SELECT '{n}' AS \"column\", " + body.replace("{c}", n).replace("{t}", table) + f" FROM {table}" for n in names])


ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
HOLES = "(SELECT *, nullif(event_type, 'error') AS et, nullif(user_id % 7, 0) AS um FROM events)"


def _holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumns({"et": F.expr("nullif(event_type, 'error')"), "um": F.expr("nullif(user_id % 7, 0)")})


# -- basic statistics ------------------------------------------------------------------------------------------------


@query(each("orders", ORDERS, f"count(DISTINCT {{c}})::BIGINT AS unique_count, count(*)::BIGINT AS total_count, {r6('count(DISTINCT {c})::DOUBLE / count(*)')} AS unique_ratio, CASE WHEN count(DISTINCT {{c}}) = 0 THEN 'warning' ELSE 'passed' END AS status"))
def q_unique_count(spark, sf_dir):
    return C.per_column(load(spark, sf_dir, "orders"), ORDERS, C.unique_count)


@query(each(HOLES, ["event_id", "et", "um", "value"], f"(count(*) - count({{c}}))::BIGINT AS null_count, count(*)::BIGINT AS total_count, {r6('(count(*) - count({c}))::DOUBLE / count(*)')} AS null_ratio, CASE WHEN (count(*) - count({{c}}))::DOUBLE / count(*) <= 0.05 THEN 'passed' WHEN (count(*) - count({{c}}))::DOUBLE / count(*) <= 0.25 THEN 'warning' ELSE 'failed' END AS status"))
def q_null_analysis(spark, sf_dir):
    return C.per_column(_holes(spark, sf_dir), ["event_id", "et", "um", "value"], C.null_analysis)


_DUP = "(count(DISTINCT {c}) + max(({c} IS NULL)::INT))"


@query(each("lineitem", LINE, f"(count(*) - {_DUP})::BIGINT AS duplicate_count, {r6(f'(count(*) - {_DUP})::DOUBLE / count(*)')} AS duplicate_ratio, {_DUP}::BIGINT AS unique_count, count(*)::BIGINT AS total_count, 'passed' AS status"))
def q_duplicate_value(spark, sf_dir):
    return C.per_column(load(spark, sf_dir, "lineitem"), LINE, C.duplicate_values)


_CARD = "(count(DISTINCT {c})::DOUBLE / count({c}))"


@query(each("orders", ORDERS, f"count(*)::BIGINT AS total_count, count(DISTINCT {{c}})::BIGINT AS unique_count, (count(*) - count({{c}}))::BIGINT AS null_count, {r6(_CARD)} AS cardinality_ratio, CASE WHEN {_CARD} = 1 THEN 'unique' WHEN {_CARD} >= 0.9 THEN 'very_high' WHEN {_CARD} >= 0.5 THEN 'high' WHEN {_CARD} >= 0.1 THEN 'medium' ELSE 'low' END AS cardinality_level, CASE WHEN {_CARD} >= 0.8 THEN 'high' WHEN {_CARD} >= 0.3 THEN 'medium' ELSE 'low' END AS index_suitability, CASE WHEN {_CARD} < 0.1 THEN 'high' WHEN {_CARD} < 0.5 THEN 'medium' ELSE 'low' END AS compression_potential, 'passed' AS status"))
def q_cardinality(spark, sf_dir):
    return C.per_column(load(spark, sf_dir, "orders"), ORDERS, C.cardinality)


def _mode_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", m.v AS most_common_value, m.k::BIGINT AS frequency, {r6('m.k::DOUBLE / t.n')} AS frequency_ratio, false AS is_constant_column,
CASE WHEN m.v IS NULL THEN s.v END AS most_common_non_null, CASE WHEN m.v IS NULL THEN {r6('s.k::DOUBLE / t.nn')} END AS non_null_frequency_ratio, 'passed' AS status
FROM (SELECT {c}::VARCHAR AS v, count(*) AS k FROM {HOLES} GROUP BY 1 ORDER BY k DESC, v ASC NULLS LAST LIMIT 1) m,
(SELECT {c}::VARCHAR AS v, count(*) AS k FROM {HOLES} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY k DESC, v LIMIT 1) s, (SELECT count(*) AS n, count({c}) AS nn FROM {HOLES}) t"""


@query(union([_mode_sql(c) for c in ("event_type", "et", "um")]))
def q_most_common_value(spark, sf_dir):
    return Q.most_common(Q.frequencies(_holes(spark, sf_dir), ["event_type", "et", "um"]))


@query(union([
    f"""SELECT '{c}' AS "column", row_number() OVER (ORDER BY k DESC, v)::BIGINT AS rank, v AS value, k::BIGINT AS count, {r6('k::DOUBLE / sum(k) OVER ()')} AS ratio
FROM (SELECT {c}::VARCHAR AS v, count(*) AS k FROM part GROUP BY 1) QUALIFY rank <= 10""" for c in ("p_brand", "p_type", "p_size")
]))
def q_top_k(spark, sf_dir):
    return Q.top_values(Q.frequencies(load(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"]))


_FORM = "CASE WHEN length(v) > 128 THEN left(v, 128) || chr(1) || md5(v) ELSE v END"


@query(union([
    f"""SELECT '{c}' AS "column", row_number() OVER (ORDER BY k DESC, {_FORM})::BIGINT AS rank, v AS value, k::BIGINT AS count, {r6('k::DOUBLE / sum(k) OVER ()')} AS ratio
FROM (SELECT {c} AS v, count(*) AS k FROM documents WHERE {c} IS NOT NULL GROUP BY 1) QUALIFY rank <= 10""" for c in ("text", "lang", "source")
]))
def q_top_texts(spark, sf_dir):
    """Most frequent values of whole texts; they are counted by digest and fetched for the ranks."""
    docs = load(spark, sf_dir, "documents").select("text", "lang", "source")
    return Q.with_texts(docs, Q.top_values(Q.frequencies(docs, docs.columns)))


@query(union([
    f"""SELECT '{c}' AS "column", {r6('sum(CASE WHEN k > 1 THEN k ELSE 0 END)::DOUBLE / max(n)')} AS repeated_value_share, {r6('-sum(k / n * log2(k / n + 1e-12))')} AS entropy,
{r6('CASE WHEN count(*) > 1 THEN -sum(k / n * log2(k / n + 1e-12)) / log2(count(*)) ELSE 0 END')} AS normalized_entropy, count(*)::BIGINT AS unique_count
FROM (SELECT k::DOUBLE AS k, (sum(k) OVER ())::DOUBLE AS n FROM (SELECT {c} AS v, count(*) AS k FROM {HOLES} WHERE {c} IS NOT NULL GROUP BY 1))""" for c in ("event_type", "et", "um", "user_id")
]))
def q_entropy(spark, sf_dir):
    return Q.entropy(Q.frequencies(_holes(spark, sf_dir), ["event_type", "et", "um", "user_id"]))


@query(union([
    f"""SELECT '{t}.{c}' AS "column", {r6(f'count(*) FILTER (WHERE try_cast({c} AS DOUBLE) IS NOT NULL AND try_cast({c} AS DOUBLE) % 1 = 0)::DOUBLE / count({c})')} AS int_ratio,
{r6(f'count(try_cast({c} AS DOUBLE))::DOUBLE / count({c})')} AS float_ratio, {r6(f'count(try_cast({d} AS TIMESTAMP))::DOUBLE / count({c})')} AS datetime_ratio,
{r6(f'count(*) FILTER (WHERE {j})::DOUBLE / count({c})')} AS json_ratio, count({c})::BIGINT AS non_null_count, 'passed' AS status FROM {t}"""
    for t, c, d, j in (
        ("customer", "c_name", "c_name", "false"), ("customer", "c_acctbal", "NULL", "false"), ("part", "p_size", "NULL", "false"), ("events", "props", "props", "json_valid(props)"),
    )
]))
def q_parseability(spark, sf_dir):
    parts = []
    for t, c in (("customer", "c_name"), ("customer", "c_acctbal"), ("part", "p_size"), ("events", "props")):
        parts.append(C.per_column(load(spark, sf_dir, t), [c], C.parseability).withColumn("column", F.lit(f"{t}.{c}")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# -- numbers ---------------------------------------------------------------------------------------------------------


@query(each("lineitem", NUMBERS, ", ".join([
    f"{r6('avg({c})')} AS mean", f"{r6('quantile_cont({c}, 0.5)')} AS median", f"{r6('stddev_samp({c})')} AS std", f"{r6('min({c})')} AS min", f"{r6('max({c})')} AS max",
    f"{r6('quantile_cont({c}, 0.25)')} AS q25", f"{r6('quantile_cont({c}, 0.75)')} AS q75", f"{r6('skewness({c})')} AS skewness", f"{r6('kurtosis({c})')} AS kurtosis",
    f"{r6('max({c}) - min({c})')} AS range", "count({c})::BIGINT AS non_null_count", "'passed' AS status",
])))
def q_numeric_stats(spark, sf_dir):
    return C.per_numeric_column(load(spark, sf_dir, "lineitem"), NUMBERS, C.numeric_stats)


def _iqr_sql(t: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE x < lo OR x > hi)::BIGINT AS outlier_count, {r6('count(*) FILTER (WHERE x < lo OR x > hi)::DOUBLE / count(x)')} AS outlier_ratio,
{r6('max(lo)')} AS lower_bound, {r6('max(hi)')} AS upper_bound, count(x)::BIGINT AS non_null_count, CASE WHEN count(*) FILTER (WHERE x < lo OR x > hi)::DOUBLE / count(x) > 0.1 THEN 'warning' ELSE 'passed' END AS status
FROM (SELECT {c} AS x FROM {t}), (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}))"""


@query(union([_iqr_sql("orders", "o_totalprice"), _iqr_sql("events", "value")]))
def q_outlier_iqr(spark, sf_dir):
    a = C.with_bounds(load(spark, sf_dir, "orders"), "o_totalprice", C.outliers_iqr)
    return a.unionByName(C.with_bounds(load(spark, sf_dir, "events"), "value", C.outliers_iqr))


def _examples_sql(t: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", row_number() OVER (ORDER BY x)::BIGINT AS rank, {r6('x')} AS value FROM (SELECT {c} AS x FROM {t}),
(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont({c}, 0.4) AS q1, quantile_cont({c}, 0.6) AS q3 FROM {t})) WHERE x < lo OR x > hi QUALIFY rank <= 10"""


@query(union([_examples_sql("lineitem", c) for c in ("l_extendedprice", "l_quantity")]))
def q_outlier_examples(spark, sf_dir):
    """Fences from the middle fifth, as the given tables have no values outside those of the quartiles."""
    df, names = load(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"]
    q = exact_quantiles(df, names, [0.4, 0.6])
    return C.outlier_examples(df, {n: C.fences({"q1": q[n][0.4], "q3": q[n][0.6]}) for n in names})


def _z_sql(t: str, c: str) -> str:
    hit = "count(*) FILTER (WHERE abs((x - m) / s) > 3)"
    return f"""SELECT '{c}' AS "column", {hit}::BIGINT AS outlier_count, {r6(hit + '::DOUBLE / count(x)')} AS outlier_ratio, 3.0::DOUBLE AS threshold, count(x)::BIGINT AS non_null_count,
CASE WHEN {hit}::DOUBLE / count(x) > 0.1 THEN 'warning' ELSE 'passed' END AS status FROM (SELECT {c} AS x FROM {t}), (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM {t})"""


@query(union([_z_sql("orders", "o_totalprice"), _z_sql("events", "value")]))
def q_outlier_z(spark, sf_dir):
    a = C.with_bounds(load(spark, sf_dir, "orders"), "o_totalprice", C.outliers_zscore)
    return a.unionByName(C.with_bounds(load(spark, sf_dir, "events"), "value", C.outliers_zscore))


def _bins_sql(t: str, c: str, bins: str) -> str:
    return f"""WITH b AS (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, ({bins})::INT AS n FROM {t}),
k AS (SELECT least(floor(({c} - lo) / ((hi - lo) / n)) + 1, n)::BIGINT AS bin, count(*) AS k FROM {t}, b WHERE {c} IS NOT NULL GROUP BY 1),
e AS (SELECT unnest(range(1, n + 1))::BIGINT AS bin, lo, (hi - lo) / n AS w FROM b)
SELECT e.bin AS bin, lo, w, coalesce(k, 0)::BIGINT AS k FROM e LEFT JOIN k USING (bin)"""


@query(f"SELECT bin, {r6('lo + w * (bin - 1)')} AS low, {r6('lo + w * bin')} AS high, k AS count FROM ({_bins_sql('lineitem', 'l_quantity', 'least(20, greatest(5, floor(sqrt(count(l_quantity)))))')})")
def q_histogram(spark, sf_dir):
    return C.histogram(load(spark, sf_dir, "lineitem"), "l_quantity")


@query(each("lineitem", NUMBERS, ", ".join([f"{r6(f'quantile_cont({{c}}, {x})')} AS q{int(x * 100):02d}" for x in C.QUANTILES] + ["count({c})::BIGINT AS non_null_count"])))
def q_quantiles(spark, sf_dir):
    return C.per_numeric_column(load(spark, sf_dir, "lineitem"), NUMBERS, C.quantiles)


@query(f"""WITH h AS ({_bins_sql('events', 'value', '20')}), s AS (SELECT bin, (k + coalesce(lag(k) OVER w, 0) + coalesce(lead(k) OVER w, 0)) / 3.0::DOUBLE AS s FROM h WINDOW w AS (ORDER BY bin)),
n AS (SELECT s, lag(s) OVER w AS a, lead(s) OVER w AS b, max(s) OVER () AS top FROM s WINDOW w AS (ORDER BY bin)), p AS (SELECT count(*) FILTER (WHERE s > a AND s > b AND s >= 0.1 * top)::BIGINT AS peaks FROM n)
SELECT peaks, CASE WHEN peaks <= 1 THEN 'unimodal' WHEN peaks = 2 THEN 'bimodal' ELSE 'multimodal' END AS modality, 'passed' AS status FROM p""")
def q_modality(spark, sf_dir):
    return C.modality(load(spark, sf_dir, "events"), "value")


# -- text ------------------------------------------------------------------------------------------------------------

_TEXTS = {"customer": ["c_name", "c_mktsegment"], "part": ["p_name", "p_brand"], "documents": ["text", "lang"], "pages": ["url"]}


def _texts(spark: SparkSession, sf_dir: str, check) -> DataFrame:
    out = None
    for t, names in _TEXTS.items():
        part = C.per_column(load(spark, sf_dir, t), names, check)
        out = part if out is None else out.unionByName(part)
    return out


def _text_sql(body: str) -> str:
    return union([each(t, names, body) for t, names in _TEXTS.items()])


def _share(test: str) -> str:
    return r6(f"count(*) FILTER (WHERE {test})::DOUBLE / count({{c}})")


@query(_text_sql(", ".join([
    f"{r6('avg(length({c}))')} AS mean_length", f"{r6('quantile_cont(length({c}), 0.5)')} AS median_length", "min(length({c}))::BIGINT AS min_length", "max(length({c}))::BIGINT AS max_length",
    f"{r6('stddev_samp(length({c}))')} AS std_length", "count({c})::BIGINT AS non_null_count", "'passed' AS status",
])))
def q_length(spark, sf_dir):
    return _texts(spark, sf_dir, C.text_length)


@query(_text_sql(", ".join([
    f"{_share(chr(114) + 'egexp_matches({c}, ' + repr('^[[:space:]]') + ')')} AS leading_whitespace_ratio", f"{_share('regexp_matches({c}, ' + repr('^[^' + chr(92) + 'n]*[[:space:]]+$') + ')')} AS trailing_whitespace_ratio",
    f"{_share('regexp_matches({c}, ' + repr('^[[:space:]]*$') + ')')} AS whitespace_only_ratio", f"{_share('regexp_matches({c}, ' + chr(39) + '[' + chr(92) + 'x00-' + chr(92) + 'x1f' + chr(92) + 'x7f]' + chr(39) + ')')} AS non_printable_ratio",
    "count({c})::BIGINT AS non_null_count", "'passed' AS status",
])))
def q_whitespace(spark, sf_dir):
    return _texts(spark, sf_dir, C.whitespace)


def _pattern(p: str) -> str:
    p = p if p.startswith("^") else "^" + p
    return "regexp_matches({c}, '" + p.replace("'", "''") + "')"


@query(_text_sql(", ".join([
    *(f"count(*) FILTER (WHERE {_pattern(p)})::BIGINT AS {k}_count, {_share(_pattern(p))} AS {k}_ratio" for k, p in PII_PATTERNS.items()),
    f"({' + '.join(f'count(*) FILTER (WHERE {_pattern(p)})' for p in PII_PATTERNS.values())})::BIGINT AS total_pii_matches", "count({c})::BIGINT AS total_rows",
    r6(f"({' + '.join(f'count(*) FILTER (WHERE {_pattern(p)})' for p in PII_PATTERNS.values())})::DOUBLE / count({{c}})") + " AS pii_ratio", "'passed' AS status",
])))
def q_pii(spark, sf_dir):
    return _texts(spark, sf_dir, C.pii)


def _dominant() -> str:
    counts = [f"count(*) FILTER (WHERE {_pattern(p)})" for p in FORMAT_PATTERNS.values()]
    best = f"greatest({', '.join(counts)})"
    cases = " ".join(f"WHEN {c} = {best} THEN '{k}'" for k, c in zip(FORMAT_PATTERNS, counts, strict=True))
    return f"CASE {cases} END AS dominant_format, " + r6(f"{best}::DOUBLE / count({{c}})") + " AS dominant_format_ratio"


@query(_text_sql(", ".join([*(f"{_share(_pattern(p))} AS {k}_ratio" for k, p in FORMAT_PATTERNS.items()), _dominant(), "count({c})::BIGINT AS total_rows", "'passed' AS status"])))
def q_formats(spark, sf_dir):
    return _texts(spark, sf_dir, C.data_formats)


@query(_text_sql(", ".join([
    *(f"count(*) FILTER (WHERE {_pattern(p)})::BIGINT AS {k}_count, {_share(_pattern(p))} AS {k}_ratio" for k, p in BASIC_PATTERNS.items()),
    f"greatest({', '.join(f'count(*) FILTER (WHERE {_pattern(p)})' for p in BASIC_PATTERNS.values())})::DOUBLE / count({{c}}) > 0.8 AS skip_regex_inference", "count({c})::BIGINT AS non_null_count", "'passed' AS status",
])))
def q_text_basic(spark, sf_dir):
    return _texts(spark, sf_dir, C.text_patterns)


@query()
def q_regex_inference(spark, sf_dir):
    rows = []
    for t, c in (("customer", "c_name"), ("part", "p_brand"), ("supplier", "s_name")):
        rows += [(f"{t}.{c}", p.pattern, p.description, p.match_count, p.match_ratio, p.confidence) for p in infer_patterns(load(spark, sf_dir, t), c)]
    return spark.createDataFrame(rows, "column string, pattern string, description string, match_count long, match_ratio double, confidence double")


@query("""SELECT s AS signature, count(*)::BIGINT AS count, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS ratio
FROM (SELECT regexp_replace(regexp_replace(p_brand, '[A-Za-z]', 'L', 'g'), '[0-9]', 'D', 'g') AS s FROM part) GROUP BY 1""")
def q_format_signatures(spark, sf_dir):
    return S.format_signatures(load(spark, sf_dir, "part"), "p_brand")


_OUTLIERS, _PEAKS, _TYPES, _ENTROPY, _FORMATS, _LEVELS = ("outlier_detection", "outlier_detection_zscore"), ("modality_estimation",), ("parseability_analysis",), ("stability_entropy",), ("text_patterns",), ("functional_dependency",)
_HEAVY = {
    "lineitem": (("l_orderkey", "l_linenumber"), {"l_extendedprice": [*_OUTLIERS, *_PEAKS, *_TYPES], "l_quantity": [*_OUTLIERS, *_PEAKS, *_ENTROPY], "l_returnflag": [*_FORMATS, *_ENTROPY, *_LEVELS], "l_shipdate": [*_TYPES]}),
    "part": (("p_partkey",), {"p_brand": [*_FORMATS, *_ENTROPY, *_LEVELS, *_TYPES], "p_name": [*_FORMATS], "p_partkey": [*_LEVELS]}),
    "events": (("event_id",), {"value": [*_OUTLIERS, *_PEAKS], "props": [*_TYPES, *_FORMATS]}),
}


def _two_stage_sql() -> str:
    """Stage 1 over the rows of smallest digest, stage 2 over the table: a row for each measure."""
    out, samples = [], []
    for t, (key, wanted) in _HEAVY.items():
        digest = "md5('42:' || " + " || ':' || ".join(f"{k}::VARCHAR" for k in key) + ")"
        s = f"s_{t}"
        samples.append(f"{s} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {digest}) AS nth FROM {t}) WHERE nth <= 5000)")
        for c, rules in wanted.items():
            sig = f"regexp_replace(regexp_replace({c}::VARCHAR, '\\p{{L}}', 'L', 'g'), '\\p{{Nd}}', 'D', 'g')"
            row = lambda rule, status, measures: f"SELECT '{t}.{c}' AS \"column\", '{rule}' AS rule, {status} AS status, unnest([{', '.join(repr(m) for m in measures)}]) AS measure, unnest([{', '.join(f'({v})::DOUBLE' for v in measures.values())}]) AS value"  # noqa: E731, B023
            values = f"(SELECT {c}::VARCHAR AS v, count(*) AS k, (SELECT count(*) FROM {s}) AS n FROM {s} GROUP BY 1)"
            for rule in rules:
                if rule in _OUTLIERS:
                    b = f"(SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b, avg({c}) AS m, stddev_samp({c}) AS d FROM {s} WHERE nth <= 3000)"
                    x = f"(SELECT count({c}) AS n, count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS i, count(*) FILTER ({c} < m - 3 * d OR {c} > m + 3 * d) AS z FROM {t}, {b})"
                    share = "least(i, z)::DOUBLE / n"
                    out.append(row(rule, f"CASE WHEN {share} <= 0.05 THEN 'passed' WHEN {share} <= 0.15 THEN 'warning' ELSE 'failed' END", {"outlier_count": "least(i, z)", "outlier_ratio": share, "iqr_outliers": "i", "zscore_outliers": "z"}) + f" FROM {x}")
                elif rule in _PEAKS:
                    b = f"(SELECT min({c}) AS lo, max({c}) AS hi, least(20, count({c}) // 2) AS bins FROM {s})"
                    h = f"(SELECT count(*) AS k FROM {s}, {b} GROUP BY least(floor(({c} - lo) / ((hi - lo) / bins)) + 1, bins))"
                    x = f"(SELECT (SELECT count(*) FROM {h} WHERE k > 0.1 * (SELECT max(k) FROM {h})) AS p, avg({c}) AS m, stddev_samp({c}) AS d, min({c}) AS lo, max({c}) AS hi FROM {s})"
                    out.append(row(rule, "CASE WHEN p IN (1, 2) THEN 'passed' ELSE 'warning' END", {"estimated_peaks": "p", "mean": "m", "std": "d", "min": "lo", "max": "hi"}) + f" FROM {x}")
                elif rule in _TYPES:
                    tests = {"numeric": f"try_cast({c} AS DOUBLE) IS NOT NULL" if c != "l_shipdate" else "false", "datetime": "true" if c == "l_shipdate" else "false", "json": f"json_valid({c})" if c == "props" else "false"}
                    m = {f"{k}_{w}": f"{k}_r" if w == "ratio" else f"floor({k}_r * n)" for k in tests for w in ("count", "ratio")}
                    out.append(row(rule, "'passed'", m) + f" FROM (SELECT {', '.join(f'count(*) FILTER ({v})::DOUBLE / count({c}) AS {k}_r' for k, v in tests.items())} FROM {s}), (SELECT count(*) AS n FROM {t})")
                elif rule in _ENTROPY:
                    h = "-sum(k::DOUBLE / n * log2(k::DOUBLE / n + 1e-12)) FILTER (v IS NOT NULL)"
                    out.append(row(rule, "'passed'", {"estimated_entropy": "h", "sample_entropy": "h"}) + f" FROM (SELECT {h} AS h FROM {values})")
                elif rule in _LEVELS:
                    x = f"(SELECT count(v) AS c, max(k) FILTER (v IS NOT NULL) AS hi, min(k) FILTER (v IS NOT NULL) AS lo, (SELECT count(*) FROM {t}) AS n FROM {values})"
                    out.append(row(rule, "'passed'", {"category_count": "c", "most_common_freq": "hi", "least_common_freq": "lo"}) + f" FROM {x} WHERE c <= n * 0.8")
                    out.append(row(rule, "'skipped'", {"category_count": "c"}) + f" FROM {x} WHERE c > n * 0.8")
                else:
                    f = f"(SELECT f FROM (SELECT {sig} AS f, count(*) AS k, sum(count(*)) OVER () AS n FROM {s} WHERE nth <= 2000 AND {c} IS NOT NULL GROUP BY 1 ORDER BY k DESC, f LIMIT 5) WHERE k >= 0.1 * n)"
                    x = f"(SELECT f, (SELECT count(*) FILTER ({sig} = f)::DOUBLE / count({c}) FROM {t}) AS r FROM {f})"
                    status = f"(SELECT CASE WHEN sum(r) >= 0.8 THEN 'passed' WHEN sum(r) >= 0.5 THEN 'warning' WHEN count(*) > 0 THEN 'failed' ELSE 'warning' END FROM {x})"
                    out.append(f"SELECT '{t}.{c}' AS \"column\", '{rule}' AS rule, {status} AS status, measure, value FROM (SELECT f AS measure, r AS value FROM {x} UNION ALL SELECT CASE WHEN count(*) > 0 THEN 'total_coverage' ELSE '' END, coalesce(sum(r), 0) FROM {x})")
    return f"WITH {', '.join(samples)} SELECT \"column\", rule, status, measure, {r6('value')} AS value FROM ({union(out)})"


@query(_two_stage_sql())
def q_two_stage(spark, sf_dir):
    rows = []
    for t, (key, wanted) in _HEAVY.items():
        rows += [(f"{t}.{m[0]}", *m[1:]) for m in D.measures(D.two_stage(load(spark, sf_dir, t), wanted, by=key))]
    return spark.createDataFrame(rows, "column string, rule string, status string, measure string, value double")


# -- arrays, dictionaries, dates, storage ----------------------------------------------------------------------------


@query("""SELECT round(avg(len(embedding)), 6) AS mean_length, min(len(embedding))::BIGINT AS min_length, max(len(embedding))::BIGINT AS max_length, sum(len(embedding))::BIGINT AS total_elements,
count(embedding)::BIGINT AS valid_count, 0::BIGINT AS invalid_count, (SELECT list_sort(list(len(embedding)))[(count(*) // 2 + 1)::BIGINT] FROM embeddings)::BIGINT AS median_length, 'passed' AS status FROM embeddings""")
def q_array_length(spark, sf_dir):
    return N.array_lengths(load(spark, sf_dir, "embeddings"), "embedding")


@query("SELECT 'float' AS element_type, sum(len(embedding))::BIGINT AS count, 1.0::DOUBLE AS ratio FROM embeddings")
def q_array_types(spark, sf_dir):
    return N.element_types(load(spark, sf_dir, "embeddings"), "embedding")


@query("SELECT 1.0::DOUBLE AS mean_depth, 1::BIGINT AS min_depth, 1::BIGINT AS max_depth, count(*)::BIGINT AS valid_count, 0::BIGINT AS invalid_count, 'passed' AS status FROM embeddings")
def q_array_depth(spark, sf_dir):
    return N.depths(load(spark, sf_dir, "embeddings"), "embedding", "array")


@query("SELECT 1.0::DOUBLE AS mean_depth, 1::BIGINT AS min_depth, 1::BIGINT AS max_depth, count(*)::BIGINT AS valid_count, 0::BIGINT AS invalid_count, 'passed' AS status FROM events")
def q_dict_depth(spark, sf_dir):
    return N.depths(load(spark, sf_dir, "events"), "props", "object")


@query(f"""SELECT round(avg(d), 6) AS mean_depth, min(d)::BIGINT AS min_depth, max(d)::BIGINT AS max_depth, count(d)::BIGINT AS valid_count,
count(*) FILTER (WHERE event_type = 'error')::BIGINT AS invalid_count, 'passed' AS status
FROM (SELECT *, CASE WHEN event_type <> 'error' AND user_id % 7 <> 0 THEN 1 + 2 * (user_id % 5) END AS d FROM events)""")
def q_nested_depth(spark, sf_dir):
    """Depth of dictionaries whose strings hold brackets, quotes and backslashes."""
    deep = F.concat(F.lit('{"s": "]{[[\\"[[\\\\", "v": '), F.expr("repeat('[{\"a}\": ', int(user_id % 5))"), F.lit('"[x"'), F.expr("repeat('}, 1]', int(user_id % 5))"), F.lit("}"))
    df = load(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "[[ no json").when(F.col("user_id") % 7 != 0, deep).alias("deep"))
    return N.depths(df, "deep", "object")


@query('SELECT k AS "key", count(*)::BIGINT AS count, count(*) = (SELECT count(*) FROM events) AS in_all FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1')
def q_dict_keys(spark, sf_dir):
    return N.key_counts(load(spark, sf_dir, "events"), "props")


@query("SELECT s AS signature, count(*)::BIGINT AS count, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS ratio FROM (SELECT array_to_string(list_sort(json_keys(props)), ',') AS s FROM events) GROUP BY 1")
def q_dict_schema(spark, sf_dir):
    return N.schemas(load(spark, sf_dir, "events"), "props")


@query("""SELECT k AS "key", CASE json_type(props, '$."' || k || '"') WHEN 'VARCHAR' THEN 'str' WHEN 'BIGINT' THEN 'int' WHEN 'UBIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'bool'
WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'dict' ELSE 'NoneType' END AS value_type, count(*)::BIGINT AS count FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY 1, 2""")
def q_dict_value_types(spark, sf_dir):
    return N.value_types(load(spark, sf_dir, "events"), "props")


@query(each("orders", ["o_orderdate"], "count({c})::BIGINT AS valid_count, (count(*) - count({c}))::BIGINT AS invalid_count, 1.0::DOUBLE AS valid_ratio, min({c}) AS min_date, max({c}) AS max_date, floor((epoch_us(max({c})) - epoch_us(min({c}))) / 86400000000)::BIGINT AS span_days, 'passed' AS status"))
def q_date_validation(spark, sf_dir):
    return C.per_column(load(spark, sf_dir, "orders"), ["o_orderdate"], C.date_validation)


@query(union([
    f"""SELECT '{c}' AS "column", '{k}' AS current_dtype, sum({w})::BIGINT AS memory_usage_bytes, {r6(f'sum({w})::DOUBLE / count(*)')} AS memory_per_value_bytes, count(*)::BIGINT AS total_values,
{h} AS optimization_potential, {g} AS categorical_potential, 'passed' AS status FROM lineitem"""
    for c, k, w, h, g in (
        ("l_linenumber", "int", "4", "'int8'", "false"), ("l_quantity", "double", "8", "NULL::VARCHAR", "false"),
        ("l_orderkey", "bigint", "8", "CASE WHEN max(l_orderkey) <= 127 THEN 'int8' WHEN max(l_orderkey) <= 32767 THEN 'int16' WHEN max(l_orderkey) <= 2147483647 THEN 'int32' END", "false"),
        ("l_returnflag", "string", "strlen(l_returnflag)", "NULL::VARCHAR", "count(DISTINCT l_returnflag) < count(*) * 0.5"),
    )
]))
def q_memory(spark, sf_dir):
    return C.per_column(load(spark, sf_dir, "lineitem"), ["l_linenumber", "l_quantity", "l_orderkey", "l_returnflag"], C.memory_usage)


# -- types and levels ------------------------------------------------------------------------------------------------

_U, _N = "count(DISTINCT {c})", "count({c})"
_LEVEL = f"""CASE WHEN {_U} = 1 THEN 'constant' WHEN {_N} > 1 AND {_U} = {_N} THEN 'fully_unique' WHEN {_U} = 2 AND {{z}} THEN 'binary' WHEN {_U} = 2 THEN 'low'
WHEN {_U}::DOUBLE / {_N} <= 0.2 THEN 'low' WHEN {_U}::DOUBLE / {_N} <= 0.5 THEN 'medium' WHEN {_U}::DOUBLE / {_N} < 0.9 OR {_U} < 75 THEN 'high' ELSE 'distinctive' END"""


def _attribute_sql(t: str, c: str, kind: str) -> str:
    whole = f"bool_and({c} % 1 = 0)" if kind == "number" else "false"
    category = {
        "number": f"CASE WHEN {_N} >= 500 AND {_U}::DOUBLE / {_N} >= 0.99 AND {whole} THEN 'categorical' ELSE 'numeric' END", "text": "'textual'", "time": "'temporal'", "json": "'dictionary'",
    }[kind]
    zero_one = f"bool_and({c} IN (0, 1))" if kind == "number" else "false"
    index = f"{_N} > 1 AND {_U} = {_N} AND {'false' if kind == 'json' else whole if kind == 'number' else 'true'}"
    body = f"""{category} AS type_category, {_LEVEL.replace('{z}', zero_one)} AS diversity, 'low' AS nullability, {_U}::BIGINT AS unique_count, count(*)::BIGINT AS total_count,
0::BIGINT AS null_count, {index} AS is_likely_index, {f'NOT {whole}' if kind == 'number' else 'false'} AS fractional"""
    return f"SELECT '{c}' AS \"column\", " + body.replace("{c}", c) + f" FROM {t}"


_KINDS = {"orders": dict(zip(ORDERS, ("number", "number", "text", "number", "time", "text"), strict=True)), "events": {"event_id": "number", "ts": "time", "user_id": "number", "event_type": "text", "value": "number", "props": "json"}, "labels": {"doc_id": "number", "quality": "number", "toxic": "number"}}


@query(union([_attribute_sql(t, c, k) for t, kinds in _KINDS.items() for c, k in kinds.items()]))
def q_column_attributes(spark, sf_dir):
    parts = [A.column_attributes(load(spark, sf_dir, t), list(kinds)) for t, kinds in _KINDS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# -- pairs -----------------------------------------------------------------------------------------------------------

_CORR = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]


@query(union([
    f"""SELECT '{a}' AS column1, '{b}' AS column2, {r6(f'corr({a}, {b})')} AS correlation, count(*)::BIGINT AS sample_size,
CASE WHEN abs(corr({a}, {b})) >= 0.8 THEN 'strong' WHEN abs(corr({a}, {b})) >= 0.5 THEN 'moderate' WHEN abs(corr({a}, {b})) >= 0.3 THEN 'weak' ELSE 'very weak' END AS strength,
CASE WHEN abs(corr({a}, {b})) >= 0.8 THEN 'high' WHEN abs(corr({a}, {b})) >= 0.5 THEN 'medium' ELSE 'low' END AS status FROM lineitem""" for a, b in _CORR
]))
def q_correlation_matrix(spark, sf_dir):
    return P.per_pair(load(spark, sf_dir, "lineitem"), _CORR, P.correlation)


@query(union([
    f"""SELECT '{a}' AS column1, '{b}' AS column2, count(*) FILTER (WHERE {a} IS NULL AND {b} IS NULL)::BIGINT AS both_null, count(*) FILTER (WHERE {a} IS NULL AND {b} IS NOT NULL)::BIGINT AS only_first_null,
count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NULL)::BIGINT AS only_second_null, {r6(f'count(*) FILTER (WHERE {a} IS NULL AND {b} IS NULL)::DOUBLE / count(*)')} AS co_null_ratio,
CASE WHEN count(*) FILTER (WHERE {a} IS NULL AND {b} IS NULL)::DOUBLE / count(*) >= 0.3 THEN 'high' ELSE 'low' END AS status FROM {HOLES}""" for a, b in (("et", "um"), ("et", "value"))
]))
def q_missingness(spark, sf_dir):
    return P.per_pair(_holes(spark, sf_dir), [("et", "um"), ("et", "value")], P.missingness)


@query(union([
    f"""SELECT '{a}' AS column1, '{b}' AS column2, bool_and({a} IS NOT DISTINCT FROM {b}) AS identical, bool_and({a} IS NOT DISTINCT FROM {b}) AS identical_without_nulls,
bool_and({a} IS NOT DISTINCT FROM {b}) AS skip_other_checks, CASE WHEN bool_and({a} IS NOT DISTINCT FROM {b}) THEN 'high' ELSE 'low' END AS status
FROM (SELECT *, l_partkey AS copy FROM lineitem)""" for a, b in (("l_partkey", "copy"), ("l_partkey", "l_suppkey"), ("l_discount", "l_tax"))
]))
def q_identicality(spark, sf_dir):
    return P.per_pair(load(spark, sf_dir, "lineitem").withColumn("copy", F.col("l_partkey")), [("l_partkey", "copy"), ("l_partkey", "l_suppkey"), ("l_discount", "l_tax")], P.identicality)


def _fd_sql(t: str, a: str, b: str) -> str:
    def side(x, y):
        return f"(SELECT count(*) AS g, count(*) FILTER (WHERE d > 1) AS v FROM (SELECT {x}, count(DISTINCT {y}) AS d FROM {t} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1))"

    f, r = "1 - f.v::DOUBLE / f.g", "1 - r.v::DOUBLE / r.g"
    return f"""SELECT '{a}' AS column1, '{b}' AS column2, f.g::BIGINT AS forward_groups, f.v::BIGINT AS forward_violations, r.g::BIGINT AS reverse_groups, r.v::BIGINT AS reverse_violations, {r6(f)} AS forward_ratio,
{r6(r)} AS reverse_ratio, {r6(f'greatest({f}, {r})')} AS best_ratio, CASE WHEN {f} >= {r} THEN '{a} -> {b}' ELSE '{b} -> {a}' END AS best_direction,
CASE WHEN greatest({f}, {r}) >= 0.95 THEN 'high' WHEN greatest({f}, {r}) >= 0.8 THEN 'medium' ELSE 'low' END AS status FROM {side(a, b)} f, {side(b, a)} r"""


_FD = [("p_brand", "p_type"), ("p_type", "p_size"), ("p_partkey", "p_brand")]


@query(union([_fd_sql("part", a, b) for a, b in _FD]))
def q_functional_dependency(spark, sf_dir):
    return P.functional_dependency(load(spark, sf_dir, "part"), _FD)


def _composite_sql(t: str, a: str, b: str) -> str:
    ua, ub = f"s.ua = s.na AND s.na > 0", f"s.ub = s.nb AND s.nb > 0"
    return f"""SELECT '{a}' AS column1, '{b}' AS column2, (CASE WHEN ({ua}) OR ({ub}) THEN 0 ELSE s.n - d.n END)::BIGINT AS duplicate_rows, {r6(f'CASE WHEN ({ua}) OR ({ub}) THEN 1 ELSE 1 - (s.n - d.n)::DOUBLE / s.n END')} AS uniqueness_ratio,
{r6('s.ua::DOUBLE / s.na')} AS column1_ratio, {r6('s.ub::DOUBLE / s.nb')} AS column2_ratio, CASE WHEN {ua} THEN '{a}' WHEN {ub} THEN '{b}' END AS unique_column,
CASE WHEN ({ua}) OR ({ub}) THEN 'skipped' WHEN d.n = s.n THEN 'high' WHEN d.n::DOUBLE / s.n >= 0.99 THEN 'medium' ELSE 'low' END AS status
FROM (SELECT count(*) AS n, count({a}) AS na, count({b}) AS nb, count(DISTINCT {a}) AS ua, count(DISTINCT {b}) AS ub FROM {t}) s, (SELECT count(*) AS n FROM (SELECT DISTINCT {a}, {b} FROM {t})) d"""


@query(union([_composite_sql("conversations", "conv_id", "turn"), _composite_sql("lineitem", "l_orderkey", "l_linenumber"), _composite_sql("customer", "c_custkey", "c_name")]))
def q_composite_uniqueness(spark, sf_dir):
    a = P.composite_uniqueness(load(spark, sf_dir, "conversations"), [("conv_id", "turn")])
    b = P.composite_uniqueness(load(spark, sf_dir, "lineitem"), [("l_orderkey", "l_linenumber")])
    return a.unionByName(b).unionByName(P.composite_uniqueness(load(spark, sf_dir, "customer"), [("c_custkey", "c_name")]))


def _v_sql(t: str, a: str, b: str) -> str:
    return f"""SELECT '{a}' AS column1, '{b}' AS column2, n::BIGINT AS sample_size, {r6('chi2')} AS chi2, nr::BIGINT AS n_rows, nc::BIGINT AS n_cols, {r6('v')} AS cramers_v,
CASE WHEN v >= 0.5 THEN 'strong' WHEN v >= 0.3 THEN 'moderate' WHEN v >= 0.1 THEN 'weak' ELSE 'very weak' END AS strength, CASE WHEN v >= 0.5 THEN 'high' WHEN v >= 0.3 THEN 'medium' ELSE 'low' END AS status
FROM (SELECT *, sqrt(chi2 / (n * (least(nr, nc) - 1))) AS v FROM (SELECT sum(o) AS n, sum(o) * (sum(o::DOUBLE * o / (r::DOUBLE * c)) - 1) AS chi2, count(DISTINCT a) AS nr, count(DISTINCT b) AS nc
FROM (SELECT a, b, o, sum(o) OVER (PARTITION BY a) AS r, sum(o) OVER (PARTITION BY b) AS c FROM (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {t} GROUP BY 1, 2))))"""


_V = [("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber")]


@query(union([_v_sql("lineitem", a, b) for a, b in _V]))
def q_cramers_v(spark, sf_dir):
    return P.cramers_v(load(spark, sf_dir, "lineitem"), _V)


@query()
def q_enhanced_pairs(spark, sf_dir):
    df, rows = load(spark, sf_dir, "lineitem"), []
    for a, b in _V:
        p, v, f = P.should_proceed(df, a, b), P.cramers_v_tested(df, a, b), P.functional_dependency_tested(df, a, b)
        rows.append((a, b, p["should_proceed"], v["status"], v["cramers_v"], v["p_value"], f["status"], f["ratio"], f["confidence"]))
    return spark.createDataFrame(rows, "column1 string, column2 string, powered boolean, v_status string, cramers_v double, p_value double, fd_status string, fd_ratio double, fd_confidence double")


# -- tables, keys, reports -------------------------------------------------------------------------------------------


@query(union([
    f"SELECT '{t}' AS table_name, count(*)::BIGINT AS row_count, {n}::BIGINT AS column_count, sum({w})::BIGINT AS estimated_bytes, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})))::BIGINT AS duplicate_rows FROM {t}"
    for t, n, w in (("labels", 3, "16"), ("nation", 3, "8 + strlen(n_name)"), ("events", 6, "32 + strlen(event_type) + strlen(props)"))
]))
def q_table_stats(spark, sf_dir):
    parts = [table_stats(load(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "*") for t in ("labels", "nation", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_KEYS = ["conv_id", "turn", "role"]


@query(union([
    *(f"SELECT '{c}' AS key_columns, count(DISTINCT {c})::BIGINT AS \"distinct\", count(*)::BIGINT AS total, 0.0::DOUBLE AS null_ratio FROM conversations" for c in _KEYS),
    *(f"SELECT '{a},{b}' AS key_columns, (SELECT count(*) FROM (SELECT DISTINCT {a}, {b} FROM conversations))::BIGINT AS \"distinct\", count(*)::BIGINT AS total, 0.0::DOUBLE AS null_ratio FROM conversations" for i, a in enumerate(_KEYS) for b in _KEYS[i + 1 :]),
]))
def q_key_counts(spark, sf_dir):
    k = K.key_counts(load(spark, sf_dir, "conversations").select(*_KEYS))
    return k.select(F.array_join("columns", ",").alias("key_columns"), "distinct", "total", "null_ratio")


@query()
def q_candidate_keys(spark, sf_dir):
    rows = [(t, ",".join(k["columns"]), k["uniqueness"], k["noNulls"], k["confidence"]) for t in ("orders", "lineitem", "conversations") for k in K.candidate_keys(load(spark, sf_dir, t), t)]
    return spark.createDataFrame(rows, "table_name string, key_columns string, uniqueness double, no_nulls boolean, confidence double")


@query()
def q_primary_keys(spark, sf_dir):
    df = load(spark, sf_dir, "customer")
    rows = [(",".join(k["columns"]), (s := K.primary_key_score(k, df, "customer"))["confidence"], s["reason"]) for k in K.candidate_keys(df, "customer")]
    return spark.createDataFrame(rows, "key_columns string, confidence double, reason string")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus IN ('F')")
def q_partition_scan(spark, sf_dir):
    df = partition_scan(load(spark, sf_dir, "lineitem"), {"l_returnflag": ["A", "R"], "l_linestatus": ["F"]}, None)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


@query("SELECT n_regionkey::BIGINT AS n_regionkey, count(*)::BIGINT AS k FROM nation GROUP BY 1")
def q_sql_source(spark, sf_dir):
    load(spark, sf_dir, "nation").createOrReplaceTempView("nation_view")
    return run_query(spark, "SELECT n_regionkey, count(*) AS k FROM nation_view GROUP BY n_regionkey;")


@query("SELECT * FROM orders ORDER BY md5('42:' || o_orderkey::VARCHAR) LIMIT 100")
def q_sample(spark, sf_dir):
    return sample(load(spark, sf_dir, "orders"), 100, 42, ("o_orderkey",))


@query(union([
    f"""SELECT '{c}' AS "column", 'passed' AS status, {r6(f'count(*) FILTER ({c} > 0)::DOUBLE / count({c})')} AS share FROM customer
HAVING NOT (count({c}) >= 500 AND count(DISTINCT {c})::DOUBLE / count({c}) >= 0.99 AND bool_and({c} % 1 = 0))""" for c in ("c_custkey", "c_nationkey", "c_acctbal")
]))
def q_custom_rule(spark, sf_dir):
    registry = Registry()
    registry.add(Rule("positive_share", "Share of positive values", column_types=("numeric",), function=lambda c, kind: {"share": X.ratio(F.count_if(c > 0), F.count(c)), "status": F.lit("passed")}))
    report = Profiler(ProfilingConfig(enable_cross_column=False), registry).profile(load(spark, sf_dir, "customer"))
    rows = [(r.columns[0], r.status, r.details["share"]) for r in report.results if r.rule_id == "positive_share"]
    return spark.createDataFrame(rows, "column string, status string, share double")


def _profile(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return results_frame(spark, Profiler().profile(load(spark, sf_dir, table), table))


@query()
def q_profile_lineitem(spark, sf_dir):
    return _profile(spark, sf_dir, "lineitem")


@query()
def q_profile_sampled(spark, sf_dir):
    config = ProfilingConfig(sampling_threshold=100000, sample_size=10000)
    return results_frame(spark, Profiler(config).profile(load(spark, sf_dir, "lineitem"), "lineitem"))


@query()
def q_profile_events(spark, sf_dir):
    return _profile(spark, sf_dir, "events")


@query()
def q_insights(spark, sf_dir):
    df = load(spark, sf_dir, "customer")
    out = insights(Profiler().profile(df, "customer"), df, "customer")
    rows = [(c["name"], c["type"], c.get("valueType"), c["nullRatio"], len(c.get("topValues", []))) for c in out["columns"]]
    return spark.createDataFrame(rows, "name string, type string, value_type string, null_ratio double, top_values int")


@query()
def q_report_score(spark, sf_dir):
    s = Profiler(ProfilingConfig(enable_cross_column=False)).profile(load(spark, sf_dir, "orders"), "orders").summary
    return spark.createDataFrame([(s["total_checks"], s["overall_score"], s["grade"], s["errors"])], "total_checks int, overall_score double, grade string, errors int")
