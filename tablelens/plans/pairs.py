"""Which column pairs are compared, and which rules run on them."""

from __future__ import annotations

from itertools import combinations

from tablelens.plans.types import DIVERSITY, ColumnAttributes


def compatible(a: ColumnAttributes, b: ColumnAttributes) -> bool:
    """Diversity levels at most three steps apart, and not both mostly null."""
    mostly_null = lambda x: x.total_count > 0 and x.null_count / x.total_count > 0.8
    near = abs(DIVERSITY.index(a.diversity_level) - DIVERSITY.index(b.diversity_level)) <= 3
    return near and not (mostly_null(a) and mostly_null(b))


def column_pairs(attributes: list[ColumnAttributes], most: int | None = 1000) -> list[tuple[str, str]]:
    """Pairs worth comparing: numeric ones first, then repetitive ones, then the other compatible ones.

    Constant and all-null columns are left out. In each class pairs keep the order numeric, repetitive, diverse columns.
    """
    useful = [a for a in attributes if a.diversity_level != "constant" and a.null_count != a.total_count]

    def group(a: ColumnAttributes) -> int:
        return 0 if a.type_category == "numeric" else 2 if a.diversity_level in ("high", "distinctive") else 1

    ordered = sorted(useful, key=group)
    ranked = []
    for a, b in combinations(ordered, 2):
        both = {group(a), group(b)}
        if both == {0}:
            ranked.append((0, a.name, b.name))
        elif compatible(a, b):
            ranked.append((1 if both == {1} else 2, a.name, b.name))
    ranked.sort(key=lambda r: r[0])
    return [(a, b) for _, a, b in ranked[:most]]


def categorical_like(a: ColumnAttributes) -> bool:
    r = a.unique_count / a.total_count if a.total_count else 0.0
    return r < 0.3 and a.unique_count <= 50 if a.data_type in _NUMBERS or a.data_type.startswith("decimal") else r < 0.7


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def is_number(a: ColumnAttributes) -> bool:
    return a.data_type in _NUMBERS or a.data_type.startswith("decimal")


def nearly_unique(a: ColumnAttributes) -> bool:
    n = a.total_count - a.null_count
    return n > 0 and a.unique_count / n > 0.95


def rule_takes(rule: str, a: ColumnAttributes, b: ColumnAttributes) -> bool:
    """Correlation takes numbers, dependency repetitive columns, missingness a column with nulls; the others take all."""
    if rule == "correlation":
        return is_number(a) and is_number(b)
    if rule == "functional_dependency":
        return all(categorical_like(x) and not nearly_unique(x) for x in (a, b))
    if rule == "missingness_relationships":
        return a.null_count > 0 or b.null_count > 0
    return True
