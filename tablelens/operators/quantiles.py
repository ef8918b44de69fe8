"""Exact quantiles of columns with too many distinct values for one task.

The built-in exact percentile gathers a column's distinct values in one place. Here the wanted ranks are narrowed down
instead: each pass counts what lies below and inside each rank's range, and approximate quantiles of what lies inside
give the next, far smaller range; when a range holds few values they are sorted. Each pass is one aggregation for all
ranks of all columns, and two or three passes do for any size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions import exprs as X

#: Values that a range may hold to be sorted, and the accuracy of the approximate quantiles between.
FEW, ACCURACY = 20_000, 2000
#: Up to so many distinct values the built-in percentile is used.
BUILT_IN = 200_000


@dataclass
class _Range:
    """The value of rank ``k`` (from 0) lies in [lo, hi]; ``below`` values are less than lo, ``inside`` in it."""

    column: str
    k: int
    lo: float
    hi: float
    below: int = 0
    inside: int = 0
    value: float | None = None


def _inside(r: _Range):
    c = X.col(r.column).cast("double")
    return F.when((c >= F.lit(r.lo)) & (c <= F.lit(r.hi)), c)


def order_statistics(df: DataFrame, ranks: dict[str, list[int]], bounds: dict[str, tuple[float, float, int]], few: int | None = None) -> dict[tuple[str, int], float]:
    """The values of the given ranks. bounds: (min, max, number of non-null values) of each column."""
    few = FEW if few is None else few
    ranges = [_Range(c, k, bounds[c][0], bounds[c][1], 0, bounds[c][2]) for c, ks in ranks.items() for k in sorted(set(ks))]
    while todo := [r for r in ranges if r.value is None]:
        for r in todo:
            if r.lo == r.hi:
                r.value = r.lo
        large = [r for r in todo if r.value is None and r.inside > few]
        small = [r for r in todo if r.value is None and r.inside <= few]
        for part in _chunks(small, 50):
            row = df.agg(*[F.sort_array(F.collect_list(_inside(r))).alias(f"s{i}") for i, r in enumerate(part)]).first()
            for i, r in enumerate(part):
                r.value = row[f"s{i}"][r.k - r.below]
        for part in _chunks(large, 50):
            # Ranks that lie in one range, as all of a column do at first, share one sketch.
            shared: dict[tuple[str, float, float], list[int]] = {}
            for i, r in enumerate(part):
                shared.setdefault((r.column, r.lo, r.hi), []).append(i)
            margin, cuts = 2 / ACCURACY, []
            for k, at in enumerate(shared.values()):
                places = [(part[i].k - part[i].below + 0.5) / part[i].inside for i in at]
                sides = [x for p in places for x in (max(0.0, p - margin), min(1.0, p + margin))]
                cuts.append(F.percentile_approx(_inside(part[at[0]]), F.array(*[F.lit(x) for x in sides]), F.lit(ACCURACY)).alias(f"q{k}"))
            found = df.agg(*cuts).first()
            row = {f"q{i}": found[f"q{k}"][2 * j : 2 * j + 2] for k, at in enumerate(shared.values()) for j, i in enumerate(at)}
            # The cuts are checked by counting; a rank beyond them keeps the outer side of its range.
            tests = []
            for i, r in enumerate(part):
                a, b = row[f"q{i}"]
                c = _inside(r)
                tests += [F.count_if(c < F.lit(a)).alias(f"a{i}"), F.count_if(c <= F.lit(b)).alias(f"b{i}")]
            counts = df.agg(*tests).first()
            for i, r in enumerate(part):
                (a, b), under, upto, k = row[f"q{i}"], counts[f"a{i}"], counts[f"b{i}"], r.k - r.below
                if k < under:
                    r.hi, r.inside = math.nextafter(a, -math.inf), under
                elif k >= upto:
                    r.lo, r.below, r.inside = math.nextafter(b, math.inf), r.below + upto, r.inside - upto
                elif (a, b) == (r.lo, r.hi):
                    # All cuts fall on the ends: halve by value.
                    r.lo, r.hi, r.below, r.inside = _halve(df, r)
                else:
                    r.lo, r.hi, r.below, r.inside = a, b, r.below + under, upto - under
    return {(r.column, r.k): r.value for r in ranges}


def _halve(df: DataFrame, r: _Range) -> tuple[float, float, int, int]:
    mid = r.lo + (r.hi - r.lo) / 2
    if not r.lo < mid < r.hi:
        mid = r.lo
    n = df.agg(F.count_if(_inside(r) <= F.lit(mid))).first()[0]
    return (r.lo, mid, r.below, n) if r.k - r.below < n else (math.nextafter(mid, math.inf), r.hi, r.below + n, r.inside - n)


def _chunks(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def exact_quantiles(df: DataFrame, names: list[str], fractions: list[float]) -> dict[str, dict[float, float]]:
    """Linearly interpolated quantiles of numeric columns; columns without values are left out."""
    if not names:
        return {}
    made = [F.struct(F.min(X.col(n).cast("double")), F.max(X.col(n).cast("double")), F.count(X.col(n))).alias(f"b{i}") for i, n in enumerate(names)]
    row = df.agg(*made).first()
    bounds = {n: tuple(row[f"b{i}"]) for i, n in enumerate(names) if row[f"b{i}"][2]}
    places = {n: {q: q * (b[2] - 1) for q in fractions} for n, b in bounds.items()}
    ranks = {n: [k for p in at.values() for k in (math.floor(p), math.ceil(p))] for n, at in places.items()}
    got = order_statistics(df, ranks, bounds)
    out: dict[str, dict[float, float]] = {}
    for n, at in places.items():
        out[n] = {}
        for q, p in at.items():
            a, b = got[n, math.floor(p)], got[n, math.ceil(p)]
            out[n][q] = a if a == b else a + (b - a) * (p - math.floor(p))
    return out
