"""Where reports go."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from tablelens.plans.report import plain, results_frame, to_dict
from tablelens.plans.types import ProfilingResult


def to_json(result: ProfilingResult, indent: int = 2) -> str:
    return json.dumps(to_dict(result), indent=indent)


def save_json(result: ProfilingResult, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(to_json(result))


def save_results(spark: SparkSession, result: ProfilingResult, path: str, form: str = "parquet") -> None:
    """The results as a table, in any format that Spark writes."""
    results_frame(spark, result).write.format(form).save(path)


sanitise = plain
