"""The report as the insights that a user interface shows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from tablelens.operators.keys import candidate_keys, primary_key_score
from tablelens.plans.report import plain
from tablelens.plans.types import ProfilingResult

_CATEGORICAL = ("categorical", "boolean", "textual", "array", "dictionary")


def value_type(data_type: str, unique_ratio: float | None, fractional: bool) -> str | None:
    """categorical, continuous, or None. Whole numbers are categorical if nearly unique or repetitive."""
    if data_type in _CATEGORICAL:
        return "categorical"
    if data_type == "temporal" or (data_type == "numeric" and fractional):
        return "continuous"
    if data_type == "numeric":
        return "continuous" if unique_ratio is None or 0.5 < unique_ratio < 0.99 else "categorical"
    return None


def _number(v: Any) -> float | None:
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def column_insight(name: str, analysis: dict[str, Any]) -> dict[str, Any]:
    checks = {c.get("rule_id"): c.get("details") for c in analysis.get("checks", []) if isinstance(c, dict)}
    detail = lambda rule: d if isinstance(d := checks.get(rule), dict) else {}
    out: dict[str, Any] = {"name": name, "type": analysis.get("data_type", "unknown"), "nullRatio": analysis.get("null_percentage", 0.0)}
    kind = value_type(out["type"], analysis.get("unique_percentage"), analysis.get("fractional", False) or str(analysis.get("spark_type")) in ("float", "double"))
    if kind:
        out["valueType"] = kind
    stats = detail("numeric_stats")
    if stats:
        out["numeric"] = {k: _number(stats.get(source)) for k, source in (("min", "min"), ("max", "max"), ("avg", "mean"), ("median", "median"), ("std", "std"))}
    top = detail("top_k_frequencies").get("values")
    mode = detail("most_common_value")
    if isinstance(top, list) and top:
        out["topValues"] = [{"value": v.get("value"), "count": v.get("count"), "ratio": v.get("ratio")} for v in top if isinstance(v, dict)][:10]
    elif mode.get("most_common_value") is not None:
        out["topValues"] = [{"value": mode["most_common_value"], "count": mode.get("frequency"), "ratio": mode.get("frequency_ratio")}]
    out["basic"] = {
        "uniqueCount": analysis.get("unique_count"), "totalCount": analysis.get("total_count"), "nullCount": analysis.get("null_count"),
        "diversity": analysis.get("diversity_level"), "nullability": analysis.get("nullability_level"), "isLikelyIndex": analysis.get("is_likely_index"),
    }
    patterns = detail("text_patterns")
    if patterns:
        known = {k.removesuffix("_ratio"): r for k, v in patterns.items() if k.endswith("_ratio") and (r := _number(v))}
        inferred = [p for p in patterns.get("inferred_patterns") or [] if isinstance(p, dict)]
        out["textPatterns"] = {"known": known, "inferred": [{k: p.get(k) for k in ("pattern", "description", "match_ratio", "confidence", "examples")} for p in inferred]}
    return out


def insights(result: ProfilingResult, df: DataFrame | None = None, table: str = "", filters: dict[str, list] | None = None) -> dict[str, Any]:
    """Columns, pairs, row count, applied filters; with ``df`` candidate keys and primary-key scores too."""
    out: dict[str, Any] = {
        "table": table, "rowCount": result.metadata["row_count"], "partitionSummary": {"appliedFilters": filters or {}},
        "columns": [column_insight(n, a) for n, a in result.column_analysis.items()], "crossColumn": [cross_column(r) for r in result.cross_column_analysis],
        "score": result.summary["overall_score"], "grade": result.summary["grade"],
    }
    if df is not None:
        keys = candidate_keys(df, table)
        scored = [primary_key_score(k, df, table) for k in keys]
        out["candidateKeys"] = keys
        out["primaryKeys"] = sorted(scored, key=lambda k: -k["confidence"])
    return plain(out)


def cross_column(r: dict[str, Any]) -> dict[str, Any]:
    return {
        "checkId": r["rule_id"], "name": r["rule_name"], "status": r["status"], "message": r["message"], "columns": r["details"].get("compared_columns", []),
        "details": {k: v for k, v in r["details"].items() if k != "compared_columns"},
    }
