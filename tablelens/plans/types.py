"""Data types of the profiler: attributes, rules, results, reports, settings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from enum import Enum
from typing import Any


class RuleStatus(str, Enum):
    PENDING = "pending"
    RUNNING = "running"
    PASSED = "passed"
    FAILED = "failed"
    WARNING = "warning"
    ERROR = "error"
    HIGH = "high"
    MEDIUM = "medium"
    LOW = "low"
    SKIPPED = "skipped"
    VERY_LOW = "very_low"
    NOT_SIGNIFICANT = "not_significant"


class RulePriority(str, Enum):
    LOW = "low"
    MEDIUM = "medium"
    HIGH = "high"


class RuleComplexity(str, Enum):
    LOW = "low"
    MEDIUM = "medium"
    HIGH = "high"


TYPES = ("numeric", "textual", "temporal", "boolean", "categorical", "collection", "array", "dictionary", "unknown")
DIVERSITY = ("constant", "binary", "low", "medium", "high", "distinctive", "fully_unique")
NULLABILITY = ("empty", "low", "medium", "high", "full")

# Points of a status in the report's score; all others give none.
POINTS = {"passed": 100.0, "warning": 75.0, "failed": 25.0}


@dataclass
class ColumnAttributes:
    name: str
    type_category: str
    diversity_level: str
    nullability_level: str
    unique_count: int
    total_count: int
    null_count: int
    is_likely_index: bool = False
    fractional: bool = False
    most_common_value: Any = None
    most_common_frequency: int = 0
    data_type: str = ""


@dataclass
class Rule:
    """A check and where it applies. ``function`` makes a custom rule: see ``plans.registry``."""

    id: str
    name: str
    description: str = ""
    category: str = "custom"
    column_types: tuple[str, ...] = TYPES
    diversity_levels: tuple[str, ...] = DIVERSITY
    nullability_levels: tuple[str, ...] = NULLABILITY
    cross_column: bool = False
    priority: RulePriority = RulePriority.MEDIUM
    complexity: RuleComplexity = RuleComplexity.MEDIUM
    dependencies: tuple[str, ...] = ()
    parameters: dict[str, Any] = field(default_factory=dict)
    enabled: bool = True
    function: Callable | None = None

    def is_applicable(self, a: ColumnAttributes) -> bool:
        return a.type_category in self.column_types and a.diversity_level in self.diversity_levels and a.nullability_level in self.nullability_levels


@dataclass
class RuleResult:
    rule_id: str
    rule_name: str
    status: str
    score: float
    message: str
    details: dict[str, Any]
    execution_time_ms: float = 0.0
    timestamp: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())
    category: str = ""
    columns: tuple[str, ...] = ()

    def to_dict(self) -> dict[str, Any]:
        return {
            "rule_id": self.rule_id, "rule_name": self.rule_name, "description": "", "category": self.category, "status": self.status, "score": self.score,
            "message": self.message, "details": self.details, "execution_time_ms": self.execution_time_ms, "timestamp": self.timestamp,
        }


@dataclass
class ProfilingConfig:
    """Settings of a run. ``sample_size`` rows are taken of tables above ``sampling_threshold``; None takes all rows.

    Up to ``max_workers`` independent jobs are submitted together. With ``pair_sampling`` each pair rule looks at a bounded number of rows (``operators.sampling.PAIR_SAMPLES``) of tables
    above ``pair_sampling_threshold`` rows. With ``two_stage`` heavy rules of tables above ``heavy_rule_threshold`` rows are settled by what ``discovery_rows`` of a
    sample show (``operators.discovery``), whose results have a shape of their own; ``sample_key`` names columns that tell rows apart, by which samples are then drawn.
    With ``early_exit`` columns of tables above 10000 rows are compared only until they differ. ``timeout_seconds`` is for one try of one fused aggregation, grouping or nested check; None, the default, is no limit.
    """

    enable_cross_column: bool = True
    deepness_level: str = "standard"
    sample_size: int = 10000
    sampling_threshold: int | None = None
    random_seed: int = 42
    timeout_seconds: int | None = None
    max_cross_column_pairs: int = 1000
    enhanced_statistics: bool = False
    strict_pair_types: bool = False
    null_as_text: bool = False
    literal_url: bool = False
    max_workers: int = 4
    pair_sampling: bool = False
    pair_sampling_threshold: int = 50000
    two_stage: bool = False
    heavy_rule_threshold: int = 25000
    discovery_rows: dict[str, int] = field(default_factory=lambda: {"text": 2000, "outlier": 3000, "other": 5000})
    sample_key: tuple[str, ...] | None = None
    early_exit: bool = True


@dataclass
class ProfilingResult:
    metadata: dict[str, Any]
    summary: dict[str, Any]
    column_analysis: dict[str, Any]
    cross_column_analysis: list[dict[str, Any]]
    table_analysis: list[dict[str, Any]]
    errors: list[dict[str, Any]]
    attributes: dict[str, ColumnAttributes] = field(default_factory=dict)
    results: list[RuleResult] = field(default_factory=list)


def points(status: str) -> float:
    return POINTS.get(status, 0.0)


def grade(score: float) -> str:
    return next((g for least, g in ((90, "A"), (80, "B"), (70, "C"), (60, "D")) if score >= least), "F")
