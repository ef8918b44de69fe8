"""The rules: built-in definitions, selection by attributes, depth, custom rules, and their files.

A custom column rule's function takes a Column and its type and returns named aggregates; a custom pair rule's takes
two Columns; a custom table rule's takes the DataFrame and returns a dict. A ``status`` field sets the status.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from tablelens.plans.types import DIVERSITY, NULLABILITY, ColumnAttributes, Rule, RuleComplexity, RulePriority

_VALUES = ("numeric", "textual", "temporal", "boolean", "categorical")
_ALL = (*_VALUES, "array", "dictionary")
_MEDIUM_UP = ("medium", "high", "distinctive")
_LOW_UP = ("low", *_MEDIUM_UP, "fully_unique")

# Id, category, column types, diversity levels, nullability levels of the column rules.
_COLUMN_RULES = (
    ("unique_count", "basic_stats", _VALUES, DIVERSITY, NULLABILITY),
    ("most_common_value", "basic_stats", _ALL, DIVERSITY, NULLABILITY),
    ("null_analysis", "basic_stats", _VALUES, DIVERSITY, NULLABILITY),
    ("top_k_frequencies", "basic_stats", _ALL, DIVERSITY, NULLABILITY),
    ("duplicate_value_analysis", "basic_stats", _VALUES, DIVERSITY, NULLABILITY),
    ("parseability_analysis", "basic_stats", _VALUES, DIVERSITY, NULLABILITY),
    ("stability_entropy", "basic_stats", _VALUES, DIVERSITY, NULLABILITY),
    ("numeric_stats", "numeric", ("numeric",), DIVERSITY, NULLABILITY),
    ("outlier_detection", "outlier_detection", ("numeric",), _MEDIUM_UP, NULLABILITY),
    ("outlier_detection_zscore", "outlier_detection", ("numeric",), _MEDIUM_UP, NULLABILITY),
    ("numeric_histogram_quantiles", "numeric", ("numeric",), ("low", *_MEDIUM_UP), NULLABILITY),
    ("modality_estimation", "numeric", ("numeric",), _MEDIUM_UP, NULLABILITY),
    ("length_analysis", "text", ("textual",), DIVERSITY, NULLABILITY),
    ("whitespace_encoding_checks", "text_quality", ("textual",), DIVERSITY, NULLABILITY),
    ("text_patterns", "text_patterns", ("textual",), (*_MEDIUM_UP, "fully_unique"), NULLABILITY),
    ("array_length_analysis", "array_analysis", ("array",), DIVERSITY, NULLABILITY),
    ("array_depth_analysis", "depth_analysis", ("array",), DIVERSITY, NULLABILITY),
    ("array_element_type_analysis", "array_analysis", ("array",), _LOW_UP, NULLABILITY),
    ("dictionary_key_analysis", "key_analysis", ("dictionary",), DIVERSITY, NULLABILITY),
    ("dictionary_depth_analysis", "depth_analysis", ("dictionary",), DIVERSITY, NULLABILITY),
    ("dictionary_schema_analysis", "key_analysis", ("dictionary",), _LOW_UP, NULLABILITY),
    ("date_validation", "temporal", ("temporal",), DIVERSITY, NULLABILITY),
    ("pii_pattern_detection", "privacy_security", ("textual",), (*_MEDIUM_UP, "fully_unique"), ("empty", "low", "medium", "high")),
    ("data_format_patterns", "privacy_security", ("textual",), ("high", "distinctive", "fully_unique"), ("empty", "low", "medium")),
    ("memory_usage_analysis", "performance", ("numeric", "textual", "categorical"), DIVERSITY, NULLABILITY),
    ("cardinality_analysis", "performance", ("numeric", "textual", "categorical"), _LOW_UP, NULLABILITY),
)
# Ids of the pair rules, in the order in which they run.
_PAIR_RULES = ("identicality", "correlation", "missingness_relationships", "functional_dependency", "composite_uniqueness", "categorical_association_cramers_v")
# Rules that each depth adds.
_DEPTHS = {
    "basic": ("null_analysis", "unique_count", "most_common_value", "basic_stats", "memory_usage_analysis"),
    "standard": ("data_type_inference", "top_k_frequencies", "parseability_analysis", "pii_pattern_detection", "cardinality_analysis", "length_analysis"),
    "deep": (
        "outlier_detection", "distribution_analysis", "modality_estimation", "outlier_detection_zscore", "numeric_histogram_quantiles", "text_patterns",
        "whitespace_encoding_checks", "stability_entropy", "correlation",
    ),
}


def _title(rule_id: str) -> str:
    return rule_id.replace("_", " ").title()


def builtin_rules() -> list[Rule]:
    columns = [Rule(i, _title(i), "", c, t, d, n) for i, c, t, d, n in _COLUMN_RULES]
    return columns + [Rule(i, _title(i), "", "cross_column", cross_column=True) for i in _PAIR_RULES]


class Registry:
    """Built-in and user rules by id."""

    def __init__(self) -> None:
        self.builtin = {r.id: r for r in builtin_rules()}
        self.user: dict[str, Rule] = {}

    def add(self, rule: Rule, spark=None) -> None:
        """Register a user rule; with a session its function is tried first, and a rule that fails is refused."""
        if spark is not None and (error := dry_run(rule, spark)) is not None:
            raise ValueError(f"rule {rule.id}: {error}")
        self.user[rule.id] = rule

    def remove(self, rule_id: str) -> bool:
        return (self.user.pop(rule_id, None) or self.builtin.pop(rule_id, None)) is not None

    def get(self, rule_id: str) -> Rule | None:
        return self.user.get(rule_id) or self.builtin.get(rule_id)

    def rules(self) -> list[Rule]:
        return [*(r for k, r in self.builtin.items() if k not in self.user), *self.user.values()]

    def by_category(self, category: str) -> list[Rule]:
        return [r for r in self.rules() if r.category == category]

    def dependencies(self, rule_id: str) -> list[str]:
        rule = self.get(rule_id)
        return list(rule.dependencies) if rule else []

    def validate(self, rule_id: str) -> bool:
        """No rule depends on itself or on one that does not exist."""
        return all(d != rule_id and self.get(d) is not None for d in self.dependencies(rule_id))

    def statistics(self) -> dict:
        """Counts of the user rules."""
        rules = list(self.user.values())
        by = lambda f: {k: sum(f(r) == k for r in rules) for k in sorted({f(r) for r in rules})}
        return {"total_rules": len(rules), "by_category": by(lambda r: r.category), "by_priority": by(lambda r: r.priority.value), "by_complexity": by(lambda r: r.complexity.value), "enabled": sum(r.enabled for r in rules)}

    def relevant(self, a: ColumnAttributes, cross_column: bool = True) -> list[Rule]:
        """Enabled column and pair rules whose lists have the column's type and levels."""
        return [r for r in self.rules() if r.enabled and r.category != "table" and (cross_column or not r.cross_column) and r.is_applicable(a)]

    def relevant_at_depth(self, a: ColumnAttributes, cross_column: bool = True, depth: str | None = None) -> list[Rule]:
        wanted = set(rules_at_depth(depth or analysis_depth(a)))
        return [r for r in self.relevant(a, cross_column) if r.id in wanted]

    def save(self, path: str) -> None:
        """Write the user rules as JSON; functions are not written."""
        out = []
        for r in self.user.values():
            d = asdict(r) | {"priority": r.priority.value, "complexity": r.complexity.value}
            d.pop("function")
            out.append(d)
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"rules": out}, f, indent=2)

    def load(self, path: str) -> int:
        """Add the rules of a file; missing fields take their defaults."""
        with open(path, encoding="utf-8") as f:
            found = json.load(f)["rules"]
        for d in found:
            known = {k: tuple(v) if isinstance(v, list) else v for k, v in d.items() if k in Rule.__dataclass_fields__}
            known["priority"] = RulePriority(known.get("priority", "medium"))
            known["complexity"] = RuleComplexity(known.get("complexity", "medium"))
            known.setdefault("name", d["id"])
            self.add(Rule(**known))
        return len(found)


def analysis_depth(a: ColumnAttributes) -> str:
    """basic for constants and likely indexes, deep for varied numbers and text, else standard."""
    if a.diversity_level == "constant" or a.is_likely_index:
        return "basic"
    return "deep" if a.diversity_level in ("high", "distinctive") and a.type_category in ("numeric", "textual") else "standard"


def rules_at_depth(depth: str) -> list[str]:
    names = list(_DEPTHS)
    return [i for d in names[: names.index(depth) + 1] for i in _DEPTHS[d]] if depth in _DEPTHS else []


def relevant_categories(a: ColumnAttributes) -> list[str]:
    """Rule categories that fit a column's type and levels."""
    registry = {r.category for r in builtin_rules() if r.is_applicable(a) and not r.cross_column}
    return sorted(registry)


def dry_run(rule: Rule, spark) -> str | None:
    """Try a custom rule's function on three rows; the error, or None if it works."""
    if rule.function is None:
        return "the rule has no function"
    df = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "a long, b long")
    try:
        if rule.category == "table":
            made = rule.function(df)
            return None if isinstance(made, dict) and made else "the function must return a dict"
        made = rule.function(df["a"], df["b"]) if rule.cross_column else rule.function(df["a"], df.schema["a"].dataType)
        df.agg(*[v.alias(k) for k, v in made.items()]).first()
    except Exception as e:
        return f"{type(e).__name__}: {str(e)[:300]}"
    return None
