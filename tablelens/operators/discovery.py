"""Two stages for heavy rules: what a bounded sample shows is held against all rows.

Stage 1 is one job for all rules of all columns. A sample of bounded size is taken, every wanted cell of it becomes a
row (column, value), and two groupings turn these into a row for each column: common formats, outlier thresholds,
shares of types, entropy, peaks, categories. The rules look at first rows of different number of one sample.

Stage 2 turns what was found into literals of aggregates, so that any number of rules over any number of columns is one
aggregation over the whole table, beside all other checks. Rules whose stage 2 only scales what the sample showed take
the number of rows from the same aggregation.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions import exprs as X
from tablelens.operators.columns import Fields, histogram_bin
from tablelens.operators.frequency import EPSILON
from tablelens.operators.sampling import sample_order
from tablelens.operators.two_stage import HEAVY_RULES, HEAVY_ROWS, LEAST_SHARE, SAMPLES, TOP_FORMATS, signature, signature_regex

TOP_VALUES, TOP_CATEGORIES, PEAK_BINS, LEAST_NUMBERS = 5, 10, 20, 10
#: From which share of distinct values on a column is no category.
MOST_CATEGORIES = 0.8


def two_stage_rules(rules: list[str], rows: int, threshold: int = HEAVY_ROWS) -> list[str]:
    """Those of ``rules`` that go in two stages over a table of ``rows`` rows."""
    return [r for r in rules if r in HEAVY_RULES] if rows > threshold else []


def _text(c: Column, kind: T.DataType) -> Column:
    return F.to_json(c) if isinstance(kind, T.ArrayType | T.MapType | T.StructType | T.VariantType) else c.cast("string")


def _spread(values: str, mean: str) -> Column:
    """Sum of squared distances from the mean of weighted values (x, n)."""
    return F.aggregate(F.col(values), F.lit(0.0), lambda a, v: a + v["n"] * (v["x"] - F.col(mean)) * (v["x"] - F.col(mean)))


def discover(df: DataFrame, wanted: dict[str, list[str]], sizes: dict[str, int] | None = None, seed: int = 42, by: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each column of ``wanted`` (column to rules) that has a row in the sample, with what its rules need.

    ``sizes`` are the rows that rules of text, of outliers and all others look at. ``by`` names columns that tell rows
    apart; the sample is then drawn by their digest alone.
    """
    sizes = SAMPLES if sizes is None else sizes
    kinds = {n: df.schema[n].dataType for n in wanted}
    drawn = df.select(sample_order(df, seed, by).alias("order"), *[X.col(n).alias(f"c{i}") for i, n in enumerate(wanted)]).orderBy("order").limit(max(sizes.values()))
    # A bounded number of rows, so that one window may number them.
    drawn = drawn.withColumn("at", F.row_number().over(Window.orderBy("order")))
    cells = []
    for i, (n, rules) in enumerate(wanted.items()):
        c, kind = F.col(f"c{i}"), kinds[n]
        name = F.lit(n).alias("column")
        typed = "parseability_analysis" in rules
        cells.append(F.struct(
            name, F.lit(False).alias("format"), _text(c, kind).alias("value"), X.as_number(c, kind).alias("x"),
            (X.as_timestamp(c, kind).isNotNull() if typed else F.lit(False)).alias("time"), (X.is_json(c, kind) if typed else F.lit(False)).alias("json"),
        ))
        if "text_patterns" in rules:
            cells.append(F.struct(name, F.lit(True).alias("format"), signature(_text(c, kind)).alias("value"), F.lit(None).cast("double").alias("x"), F.lit(False).alias("time"), F.lit(False).alias("json")))
    seen = lambda rule: F.count_if(F.col("at") <= sizes[rule])
    values = drawn.select("at", F.inline(F.array(*cells))).groupBy("column", "format", "value").agg(
        seen("text").alias("n_text"), seen("outlier").alias("n_outlier"), seen("other").alias("n"), F.first("x").alias("x"), F.max("time").alias("time"), F.max("json").alias("json")
    )

    cell, some = ~F.col("format"), F.col("value").isNotNull()
    number = cell & F.col("x").isNotNull()
    total = lambda test, n="n": F.coalesce(F.sum(F.when(test, F.col(n))), F.lit(0)).cast("long")
    ranked = lambda test, n: F.sort_array(F.collect_list(F.when(test & (F.col(n) > 0), F.struct((-F.col(n)).alias("minus"), F.col("value").alias("value")))))
    weighted = lambda n: F.collect_list(F.when(number & (F.col(n) > 0), F.struct(F.col("x").alias("x"), F.col(n).alias("n"))))
    of_column = values.groupBy("column").agg(
        ranked(F.col("format") & some, "n_text").alias("formats"), total(F.col("format") & some, "n_text").alias("n_text"),
        total(number, "n_outlier").alias("n_numbers"), F.percentile(F.when(number, F.col("x")), F.array(F.lit(0.25), F.lit(0.75)), F.col("n_outlier")).alias("q"), weighted("n_outlier").alias("outliers"),
        total(cell & some).alias("n_values"), total(number).alias("n_modal"), total(cell & F.col("time")).alias("n_time"), total(cell & F.col("json")).alias("n_json"),
        total(cell).alias("sample_rows"), ranked(cell & some, "n").alias("values"), weighted("n").alias("modal"),
    )
    mean = lambda v, n: F.aggregate(F.col(v), F.lit(0.0), lambda a, x: a + x["n"] * x["x"]) / F.nullif(F.col(n), F.lit(0))
    d = of_column.withColumns({"mean": mean("outliers", "n_numbers"), "modal_mean": mean("modal", "n_modal")})
    d = d.withColumns({
        "std": F.sqrt(_spread("outliers", "mean") / F.nullif(F.col("n_numbers") - 1, F.lit(0))), "modal_std": F.sqrt(_spread("modal", "modal_mean") / F.nullif(F.col("n_modal") - 1, F.lit(0))),
        "iqr": F.col("q")[1] - F.col("q")[0], "low": F.array_min(F.transform("modal", lambda x: x["x"])), "high": F.array_max(F.transform("modal", lambda x: x["x"])),
        "bins": F.least(F.lit(PEAK_BINS), F.floor(F.col("n_modal") / 2).cast("int")),
    })
    place = lambda x: histogram_bin(x, F.col("low"), F.col("high"), F.col("bins"))
    in_bin = lambda b: F.aggregate(F.filter("modal", lambda x: place(x["x"]) == b), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    d = d.withColumn("histogram", F.when(F.col("n_modal") >= LEAST_NUMBERS, F.transform(F.sequence(F.lit(1), F.col("bins")), in_bin)))
    share = lambda n: X.ratio(F.col(n), F.col("n_values"))
    counts = F.transform("values", lambda v: -v["minus"])
    named = lambda v, key: F.struct(v["value"].alias(key), (-v["minus"]).alias("count"))
    p = lambda n: n / F.col("sample_rows")
    common = F.filter(F.slice("formats", 1, TOP_FORMATS), lambda v: -v["minus"] >= LEAST_SHARE * F.col("n_text"))
    return d.select(
        "column", "sample_rows", F.transform(common, lambda v: F.struct(v["value"].alias("format"), (-v["minus"]).alias("count"), (-v["minus"] / F.col("n_text")).alias("ratio"))).alias("formats"),
        "n_numbers", (F.col("q")[0] - 1.5 * F.col("iqr")).alias("iqr_lower"), (F.col("q")[1] + 1.5 * F.col("iqr")).alias("iqr_upper"),
        (F.col("mean") - 3 * F.col("std")).alias("zscore_lower"), (F.col("mean") + 3 * F.col("std")).alias("zscore_upper"), "mean", "std",
        "n_values", share("n_modal").alias("numeric_ratio"), share("n_time").alias("datetime_ratio"), share("n_json").alias("json_ratio"),
        F.aggregate(counts, F.lit(0.0), lambda a, n: a - p(n) * F.log2(p(n) + EPSILON)).alias("sample_entropy"),
        F.size("values").cast("long").alias("unique_values"), F.transform(F.slice("values", 1, TOP_VALUES), lambda v: named(v, "value")).alias("top_values"),
        F.transform(F.slice("values", 1, TOP_CATEGORIES), lambda v: named(v, "category")).alias("top_categories"), F.array_max(counts).alias("most_common_freq"), F.array_min(counts).alias("least_common_freq"),
        F.size(F.filter("histogram", lambda n: n > 0.1 * F.array_max("histogram"))).cast("long").alias("estimated_peaks"), "n_modal",
        F.struct(F.col("modal_mean").alias("mean"), F.col("modal_std").alias("std"), F.col("low").alias("min"), F.col("high").alias("max")).alias("sample_statistics"),
    )


# -- Stage 2 ---------------------------------------------------------------------------------------------------------


def _nothing(rule: str, found: dict[str, Any] | None) -> str | None:
    """Why stage 2 has nothing to hold against the table, if so."""
    if rule == "text_patterns":
        return None if found and found["formats"] else "No text data or patterns to validate"
    if rule.startswith("outlier_detection"):
        return None if found and found["n_numbers"] >= LEAST_NUMBERS else "No valid thresholds discovered"
    if rule == "parseability_analysis":
        return None if found and found["n_values"] else "No patterns discovered"
    if rule == "stability_entropy":
        return None if found and found["unique_values"] else "Insufficient data for entropy analysis"
    if rule == "modality_estimation":
        return None if found and found["n_modal"] >= LEAST_NUMBERS else "Insufficient data for modality analysis"
    if rule == "functional_dependency":
        return None if found else "Insufficient data for dependency analysis"
    return "Two-stage processing not implemented for this rule"


def confirm(c: Column, kind: T.DataType, rule: str, found: dict[str, Any] | None) -> Fields:
    """Aggregates over the whole column that stage 2 of a rule needs; ``found`` is its row of :func:`discover`."""
    if _nothing(rule, found):
        return {"total": X.rows()}
    if rule == "text_patterns":
        t = _text(c, kind)
        return {"total": F.count(c)} | {f"matches_{i}": F.count_if(t.rlike(signature_regex(f["format"]))) for i, f in enumerate(found["formats"])}
    if rule.startswith("outlier_detection"):
        x = X.as_number(c, kind)
        outside = lambda way: F.count_if((x < found[f"{way}_lower"]) | (x > found[f"{way}_upper"]))
        return {"total": F.count(x), "iqr_outliers": outside("iqr"), "zscore_outliers": outside("zscore")}
    return {"total": X.rows()}


def conclude(rule: str, found: dict[str, Any] | None, counts: dict[str, Any]) -> dict[str, Any]:
    """The rule's result from what the sample showed and the counts of :func:`confirm`."""
    if reason := _nothing(rule, found):
        return {"status": "warning", "message": reason} | ({"pattern_matches": []} if rule == "text_patterns" else {})
    n = counts["total"]
    if rule == "text_patterns":
        if not n:
            return {"status": "warning", "message": "No text data or patterns to validate", "pattern_matches": []}
        rows = [{"pattern": signature_regex(f["format"]), "format": f["format"], "matches": counts[f"matches_{i}"], "match_ratio": counts[f"matches_{i}"] / n} for i, f in enumerate(found["formats"])]
        share = sum(r["match_ratio"] for r in rows)
        status, word = ("passed", "Strong") if share >= 0.8 else ("warning", "Moderate") if share >= 0.5 else ("failed", "Low")
        return {"status": status, "message": f"{word} pattern compliance ({share:.1%})", "pattern_matches": rows, "total_coverage": share, "optimization": "two_stage_regex_processing"}
    if rule.startswith("outlier_detection"):
        if not n:
            return {"status": "warning", "message": "No numeric data to analyze"}
        k = min(counts["iqr_outliers"], counts["zscore_outliers"])
        status, word = ("passed", "Low") if k / n <= 0.05 else ("warning", "Moderate") if k / n <= 0.15 else ("failed", "High")
        return {
            "status": status, "message": f"{word} outlier rate ({k / n:.1%})", "outlier_count": k, "outlier_ratio": k / n, "iqr_outliers": counts["iqr_outliers"],
            "zscore_outliers": counts["zscore_outliers"], "optimization": "two_stage_outlier_detection",
        }
    if rule == "parseability_analysis":
        shares = {k: found[f"{k}_ratio"] for k in ("numeric", "datetime", "json")}
        main = max(shares, key=shares.get)
        main = main if shares[main] > 0 else "text"
        return {
            "status": "passed", "message": f"Primary type: {main} ({max(shares.values()):.1%})", "primary_type": main, "optimization": "two_stage_type_inference",
            "estimated_parsing": {k: {"estimated_count": int(v * n), "estimated_ratio": v} for k, v in shares.items()},
        }
    if rule == "stability_entropy":
        h = found["sample_entropy"]
        return {"status": "passed", "message": f"Estimated entropy: {h:.2f}", "estimated_entropy": h, "sample_entropy": h, "top_values": found["top_values"], "optimization": "two_stage_entropy_estimation"}
    if rule == "modality_estimation":
        k = found["estimated_peaks"]
        name = {1: "unimodal", 2: "bimodal"}.get(k, "multimodal")
        return {
            "status": "passed" if k in (1, 2) else "warning", "message": f"Estimated modality: {name}", "estimated_modality": name, "estimated_peaks": k,
            "sample_statistics": found["sample_statistics"], "optimization": "two_stage_modality_estimation",
        }
    k = found["unique_values"]
    if k > n * MOST_CATEGORIES:
        return {"status": "skipped", "message": "Too many unique categories for functional dependency", "category_count": k, "optimization": "two_stage_category_filtering"}
    return {
        "status": "passed", "message": f"Suitable for functional dependency analysis ({k} categories)", "category_count": k, "top_categories": found["top_categories"],
        "most_common_freq": found["most_common_freq"], "least_common_freq": found["least_common_freq"], "optimization": "two_stage_category_analysis",
    }


def found_by_column(discovered: DataFrame) -> dict[str, dict[str, Any]]:
    """Rows of :func:`discover`, one a column, by column."""
    return {r["column"]: r.asDict(recursive=True) for r in discovered.collect()}


def two_stage(df: DataFrame, wanted: dict[str, list[str]], sizes: dict[str, int] | None = None, seed: int = 42, by: tuple[str, ...] | None = None) -> dict[tuple[str, str], dict[str, Any]]:
    """Results of the wanted rules by (column, rule): one job over a sample, one aggregation over the table."""
    found = found_by_column(discover(df, wanted, sizes, seed, by))
    keys = [(n, r) for n, rules in wanted.items() for r in rules]
    made = [F.struct(*[v.alias(k) for k, v in confirm(X.col(n), df.schema[n].dataType, r, found.get(n)).items()]).alias(f"f{i}") for i, (n, r) in enumerate(keys)]
    row = df.agg(*made).first()
    return {(n, r): conclude(r, found.get(n), row[f"f{i}"].asDict()) for i, (n, r) in enumerate(keys)}


def measures(results: dict[tuple[str, str], dict[str, Any]]) -> list[tuple[str, str, str, str, float]]:
    """(column, rule, status, measure, value) of two-stage results, one row for each number in them."""
    out = []
    for (column, rule), r in results.items():
        numbers = {k: v for k, v in r.items() if isinstance(v, int | float) and not isinstance(v, bool)}
        numbers |= {p["format"]: p["match_ratio"] for p in r.get("pattern_matches", [])}
        for kind, p in r.get("estimated_parsing", {}).items():
            numbers |= {f"{kind}_count": p["estimated_count"], f"{kind}_ratio": p["estimated_ratio"]}
        numbers |= {k: v for k, v in (r.get("sample_statistics") or {}).items() if v is not None}
        out += [(column, rule, r["status"], k, float(v)) for k, v in numbers.items()] or [(column, rule, r["status"], "", 0.0)]
    return out
