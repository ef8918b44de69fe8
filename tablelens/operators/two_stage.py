"""Discover on a sample, apply to all rows: formats, outlier thresholds, type ratios, entropy, modality, categories.

The first stage looks at a bounded, hash-drawn sample; the second is one aggregation over the whole column.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions import exprs as X
from tablelens.operators import frequency as Q
from tablelens.operators.columns import Fields, modality
from tablelens.operators.sampling import sample

# Rules with two stages, the rows from which on they apply, and rows to look at first.
HEAVY_RULES = (
    "text_patterns", "outlier_detection", "outlier_detection_zscore", "text_regex_inference", "parseability_analysis", "stability_entropy",
    "modality_estimation", "functional_dependency",
)
HEAVY_ROWS = 25000
SAMPLES = {"text": 2000, "outlier": 3000, "other": 5000}
TOP_FORMATS, LEAST_SHARE = 5, 0.1


def applies(rule: str, rows: int) -> bool:
    return rule in HEAVY_RULES and rows > HEAVY_ROWS


def sample_rows(rule: str) -> int:
    return SAMPLES["outlier" if rule.startswith("outlier") else "text" if rule == "text_patterns" else "other"]


def may_stop_early(rule: str, rows: int) -> bool:
    """Cheap pair rules of large tables can end at the first counterexample."""
    return rule in ("identicality", "missingness_relationships") and rows > 10000


def signature(c: Column) -> Column:
    """Letters as L, digits as D, all else as it is."""
    return F.regexp_replace(F.regexp_replace(c, r"\p{L}", "L"), r"\p{Nd}", "D")


def signature_regex(s: str) -> str:
    """A pattern for the texts of a signature: runs of letters and digits with their lengths."""
    out = []
    for run in re.finditer(r"L+|D+|[^LD]+", s):
        n = len(run[0])
        out.append(rf"\p{{L}}{{{n}}}" if run[0][0] == "L" else rf"\p{{Nd}}{{{n}}}" if run[0][0] == "D" else re.escape(run[0]))
    return "^" + "".join(out) + "$"


def format_signatures(df: DataFrame, name: str) -> DataFrame:
    """signature, count, ratio of a column's texts."""
    from pyspark.sql import Window

    g = df.where(X.col(name).isNotNull()).groupBy(signature(X.col(name).cast("string")).alias("signature")).agg(X.rows().alias("count"))
    return g.select("*", (F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(0)))).alias("ratio"))


def discover_formats(df: DataFrame, name: str, rows: int = SAMPLES["text"], seed: int = 42) -> list[str]:
    """Patterns of the most frequent signatures of the sample, each with a tenth of it or more."""
    found = format_signatures(sample(df.select(X.col(name)), rows, seed), name).where(F.col("ratio") >= LEAST_SHARE)
    return [signature_regex(r["signature"]) for r in found.orderBy(F.desc("count"), "signature").limit(TOP_FORMATS).collect()]


def apply_formats(c: Column, patterns: list[str]) -> Fields:
    n = F.count(c)
    hits = [F.count_if(c.cast("string").rlike(p)) for p in patterns]
    share = X.ratio(sum(hits, F.lit(0)), n)
    return {f"pattern_{i}": h for i, h in enumerate(hits)} | {"match_ratio": share, "status": X.ladder(share, [(0.8, "passed"), (0.5, "warning")], "failed")}


def discover_thresholds(df: DataFrame, name: str, rows: int = SAMPLES["outlier"], seed: int = 42) -> dict | None:
    """Bounds by quartiles and by three standard deviations; None for fewer than ten values."""
    c = X.col(name).cast("double")
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))
    r = sample(df.select(X.col(name)), rows, seed).agg(F.count(c).alias("n"), q.alias("q"), F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).first()
    if r["n"] < 10:
        return None
    width = r["q"][1] - r["q"][0]
    return {"iqr": (r["q"][0] - 1.5 * width, r["q"][1] + 1.5 * width), "sigma": (r["m"] - 3 * r["s"], r["m"] + 3 * r["s"])}


def apply_thresholds(c: Column, thresholds: dict) -> Fields:
    d, n = c.cast("double"), F.count(c)
    outside = {k: F.count_if((d < lo) | (d > hi)) for k, (lo, hi) in thresholds.items()}
    share = X.ratio(F.least(*outside.values()), n)
    status = F.when(share <= 0.05, "passed").when(share <= 0.15, "warning").otherwise("failed")
    return {f"{k}_outliers": v for k, v in outside.items()} | {"outlier_ratio": share, "status": status}


def type_ratios(df: DataFrame, name: str, rows: int = SAMPLES["other"], seed: int = 42) -> dict:
    """Shares of numbers, dates and JSON in the sample, estimated counts of all rows, and the main type."""
    from tablelens.operators.columns import parseability

    kind = df.schema[name].dataType
    r = sample(df.select(X.col(name)), rows, seed).agg(*[v.alias(k) for k, v in parseability(X.col(name), kind).items()]).first()
    total = df.where(X.col(name).isNotNull()).count()
    shares = {"numeric": r["float_ratio"], "datetime": r["datetime_ratio"], "json": r["json_ratio"]}
    main = max(shares, key=shares.get)
    return {"ratios": shares, "estimated_counts": {k: int(v * total) for k, v in shares.items()}, "primary_type": main if shares[main] > 0 else "text"}


def sample_structure(df: DataFrame, name: str, rows: int = SAMPLES["other"], seed: int = 42) -> dict:
    """Entropy, modality (of numbers) and categories of the sample; categories are skipped if over 80 % are unique."""
    s = sample(df.select(X.col(name)), rows, seed)
    freq = Q.frequencies(s, [name])
    e = Q.entropy(freq).first()
    n = s.where(X.col(name).isNotNull()).count()
    out = {"sample_rows": n, "entropy": e["entropy"] if e else 0.0, "unique_ratio": e["unique_count"] / n if e and n else 0.0}
    if df.schema[name].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        out["modality"] = modality(s, name).first()["modality"]
    out["categories"] = None if out["unique_ratio"] > 0.8 else [(r["value"], r["count"]) for r in Q.top_values(freq).orderBy("rank").collect()]
    return out | {"max_entropy": math.log2(e["unique_count"]) if e and e["unique_count"] > 1 else 0.0}
