"""The report: summary, score and grade, and its plain JSON form."""

from __future__ import annotations

import math
from dataclasses import asdict
from datetime import date, datetime, timezone
from decimal import Decimal
from typing import Any

from tablelens.plans.types import ColumnAttributes, ProfilingConfig, ProfilingResult, RuleResult, grade


def plain(v: Any) -> Any:
    """JSON values only: numbers stay numbers, those that are not finite become null, dates become text."""
    if isinstance(v, bool) or v is None or isinstance(v, str | int):
        return v
    if isinstance(v, float):
        return v if math.isfinite(v) else None
    if isinstance(v, Decimal):
        return plain(float(v))
    if isinstance(v, datetime | date):
        return v.isoformat()
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in v.items()}
    if isinstance(v, list | tuple | set | frozenset):
        return [plain(x) for x in v]
    if hasattr(v, "item"):
        return plain(v.item())
    return str(v)


def score(results: list[RuleResult]) -> float:
    """Mean of the results' points."""
    return sum(r.score for r in results) / len(results) if results else 0.0


def compile_report(
    attrs: list[ColumnAttributes], columns: list[RuleResult], pairs: list[RuleResult], table: list[RuleResult], rows: int, sampled: bool,
    filename: str | None, seconds: float, config: ProfilingConfig, pairs_left_out: int = 0,
) -> ProfilingResult:
    every = [*columns, *pairs, *table]
    statuses = {s: sum(r.status == s for r in every) for s in sorted({r.status for r in every})}
    total = score(every)
    errors = [{"rule_id": r.rule_id, "columns": list(r.columns), "message": r.message} for r in every if r.status == "error"]
    by_column = {}
    for a in attrs:
        n = a.total_count
        by_column[a.name] = {
            "data_type": a.type_category, "spark_type": a.data_type, "diversity_level": a.diversity_level, "nullability_level": a.nullability_level,
            "unique_count": a.unique_count, "total_count": n, "null_count": a.null_count, "unique_percentage": a.unique_count / n if n else 0.0,
            "null_percentage": a.null_count / n if n else 0.0, "is_likely_index": a.is_likely_index, "fractional": a.fractional,
            "most_common_value": plain(a.most_common_value), "most_common_frequency": a.most_common_frequency,
            "checks": [r.to_dict() for r in columns if r.columns == (a.name,)],
        }
    return ProfilingResult(
        metadata={
            "filename": filename, "timestamp": datetime.now(timezone.utc).isoformat(), "row_count": rows, "column_count": len(attrs), "sampled": sampled,
            "sample_size": config.sample_size if sampled else None, "execution_time_seconds": seconds, "pairs_left_out": pairs_left_out, "config": plain(asdict(config)),
        },
        summary={
            "total_checks": len(every), "status_counts": statuses, "overall_score": total, "grade": grade(total), "errors": len(errors),
            "recommendations": len(every) - len(errors), "column_types": {t: sum(a.type_category == t for a in attrs) for t in sorted({a.type_category for a in attrs})},
        },
        column_analysis=by_column, cross_column_analysis=[r.to_dict() for r in pairs], table_analysis=[r.to_dict() for r in table], errors=errors,
        attributes={a.name: a for a in attrs}, results=every,
    )


def to_dict(result: ProfilingResult) -> dict[str, Any]:
    names = ("metadata", "summary", "column_analysis", "cross_column_analysis", "table_analysis", "errors")
    return plain({n: getattr(result, n) for n in names})


def results_frame(spark, result: ProfilingResult):
    """All results as a table: scope, columns, rule_id, status, score, message, details (JSON)."""
    import json

    rows = [(len(r.columns), ",".join(r.columns), r.rule_id, r.status, r.score, r.message, json.dumps(plain(r.details), sort_keys=True)) for r in result.results]
    return spark.createDataFrame(rows, "scope int, columns string, rule_id string, status string, score double, message string, details string")
