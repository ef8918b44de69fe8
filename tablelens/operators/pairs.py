"""Checks of column pairs.

Equality, correlation and missingness are aggregates, so all pairs fit in one aggregation. Functional dependency,
composite uniqueness and association go over group counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions import exprs as X
from tablelens.operators.columns import Fields


def identicality(a: Column, b: Column, same_type: bool = True) -> Fields:
    """Equal in every row, nulls included; and equal apart from nulls, which must lie in the same rows."""
    equal = F.coalesce(F.bool_and(a.eqNullSafe(b)), F.lit(True)) & F.lit(same_type)
    return {
        "identical": equal, "identical_without_nulls": F.coalesce(F.bool_and((a.isNull() == b.isNull()) & F.coalesce(a == b, F.lit(True))), F.lit(True)) & F.lit(same_type),
        "skip_other_checks": equal, "status": F.when(equal, "high").otherwise("low"),
    }


def correlation(a: Column, b: Column, complete: bool = False) -> Fields:
    """Pearson's correlation over the rows where both are present; null where one of them does not vary.

    ``complete`` says that neither column has nulls, so that pairs share their columns' spreads.
    """
    x, y = a.cast("double"), b.cast("double")
    spread = F.stddev_pop(x) * F.stddev_pop(y) if complete else F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    r = F.try_divide(F.covar_pop(x, y), spread)
    r = F.when(~F.isnan(r), r)
    s = F.abs(r)
    return {
        "correlation": r, "sample_size": X.rows() if complete else F.count_if(a.isNotNull() & b.isNotNull()),
        "strength": F.when(r.isNotNull(), X.ladder(s, [(0.8, "strong"), (0.5, "moderate"), (0.3, "weak")], "very weak")),
        "status": F.when(r.isNull(), "skipped").otherwise(X.ladder(s, [(0.8, "high"), (0.5, "medium")], "low")),
    }


def missingness(a: Column, b: Column) -> Fields:
    both = F.count_if(a.isNull() & b.isNull())
    r = X.ratio(both, X.rows())
    return {
        "both_null": both, "only_first_null": F.count_if(a.isNull() & b.isNotNull()), "only_second_null": F.count_if(a.isNotNull() & b.isNull()),
        "co_null_ratio": r, "status": F.when(r >= 0.3, "high").otherwise("low"),
    }


#: Pairs looked at in one search for differing rows, rows that one search brings, and searches before all is aggregated.
TOGETHER, FIRST, SEARCHES = 100, 20, 8


def differ_first(df: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], bool]:
    """Whether the columns of each pair are equal in every row, nulls included.

    A search ends at the first few rows in which some pair differs; it starts with one partition and takes more only
    if it found none. Pairs that were seen to differ drop out, and the next search has the others. So different columns
    cost a few rows, and equal ones one pass for all of them. Pairs that are still open after ``SEARCHES`` searches
    are settled by one aggregation.
    """
    found: dict[tuple[str, str], bool] = {}
    for at in range(0, len(pairs), TOGETHER):
        left = pairs[at : at + TOGETHER]
        for _ in range(SEARCHES):
            unequal = [(~X.col(a).eqNullSafe(X.col(b))).alias(f"d{i}") for i, (a, b) in enumerate(left)]
            some = F.greatest(*[F.col(f"d{i}") for i in range(len(left))]) if len(left) > 1 else F.col("d0")
            rows = df.select(*unequal).where(some).limit(FIRST).collect()
            found |= {x: False for i, x in enumerate(left) if any(r[i] for r in rows)}
            left = [x for x in left if x not in found]
            if not rows:
                found |= dict.fromkeys(left, True)
                left = []
            if not left:
                break
        if left:
            row = df.agg(*[F.coalesce(F.bool_and(X.col(a).eqNullSafe(X.col(b))), F.lit(True)) for a, b in left]).first()
            found |= dict(zip(left, row, strict=True))
    return found


AGGREGATED = {"identicality": identicality, "correlation": correlation, "missingness_relationships": missingness}


def per_pair(df: DataFrame, pairs: list[tuple[str, str]], check) -> DataFrame:
    """One row for each pair, all from one aggregation: column1, column2 and the check's fields."""
    made = [F.struct(F.lit(a).alias("column1"), F.lit(b).alias("column2"), *[v.alias(k) for k, v in check(X.col(a), X.col(b)).items()]) for a, b in pairs]
    return df.agg(F.array(*made).alias("r")).select(F.inline("r"))


def pair_groups(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """p, a, b, n: counts of the values of all ``pairs``, nulls a value, in one shuffle.

    a and b are 64-bit hashes of the values, made once a column, so that a row of the shuffle has a fixed, small size
    whatever the values are: two values of a column of 10^7 different ones share a hash with probability 3e-6.
    """
    names = sorted({n for x in pairs for n in x})
    at = {n: f"h{i}" for i, n in enumerate(names)}
    hashed = _hashed(df, names)
    cells = F.array(*[F.struct(F.lit(i).alias("p"), F.col(at[a]).alias("a"), F.col(at[b]).alias("b")) for i, (a, b) in enumerate(pairs)])
    return hashed.select(F.inline(cells)).groupBy("p", "a", "b").agg(X.rows().alias("n"))


#: From so many levels on a column is wide, and a value of more than this part of all rows is hot.
WIDE, HOT_PART = 5000, 256
#: Rows dealt to one partition by a wide column, rows grouped in one, and what stands for null among hashes.
DEALT, GROUPED, NULL_HASH = 100_000, 1_000_000, -7046029254386353131


def _hashed(df: DataFrame, names: list[str]) -> DataFrame:
    """h0, h1, ...: 64-bit hashes of the columns' values, null for null."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    value = lambda n: F.to_json(X.col(n)) if kinds[n] in ("map", "variant") else X.col(n)
    return df.select(*[F.when(X.col(n).isNotNull(), F.xxhash64(value(n))).alias(f"h{i}") for i, n in enumerate(names)])


def hot_values(hashed: DataFrame, names: list[str], rows: int) -> dict[str, list[int | None]]:
    """Hashes that more than a ``HOT_PART`` of the rows have, of each column h0, h1, ...: one job, fewer than ``HOT_PART`` a column."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"h{i}").alias("h")) for i in range(len(names))])
    out: dict[str, list[int | None]] = {n: [] for n in names}
    for r in hashed.select(F.inline(cells)).groupBy("i", "h").agg(X.rows().alias("n")).where(F.col("n") > rows / HOT_PART).collect():
        out[names[r["i"]]].append(r["h"])
    return out


def _cell_sums(numbers: list[int]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """By p and b, what one partition of rows a, h1, h2, ... (hashes, no nulls) adds: all rows of each a lie in it."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # About ``DEALT`` rows of numbers, and at most a ``HOT_PART`` of all rows more.
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        rows = pa.Table.from_batches(held)
        own = np.unique(rows.column(0).to_numpy(), return_inverse=True)[1]
        total = np.bincount(own).astype(np.float64)
        for k, p in enumerate(numbers, 1):
            values, at = np.unique(rows.column(k).to_numpy(), return_inverse=True)
            cell, n = np.unique(own.astype(np.int64) * len(values) + at, return_counts=True)
            a, at = np.divmod(cell, len(values))
            t, c = np.bincount(at, n.astype(np.float64) ** 2 / total[a]), np.bincount(at, n).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"p": np.full(len(values), p, np.int32), "b": values, "t": t, "c": c, "cells": np.bincount(at).astype(np.int64)})

    return sums


def wide_sums(df: DataFrame, pairs: list[tuple[str, str]], levels: dict[str, int], rows: int, most: dict[str, int] | None = None) -> DataFrame:
    """p, total, distinct_rows, s (sum of o^2 / (row total * column total) of the crosstab) of pairs with a wide column.

    Rows are dealt once for each wide column, by its value, with the values of all columns it is paired with, over as
    many partitions as the number of rows asks for; the cells of all these pairs lie together then and are counted where
    they are. What leaves is one row for each pair, partition and value of the other column. Rows of hot values are
    counted before they move instead, pair by pair. most: rows of each column's mode, if known; without hot values none
    are looked for.
    """
    names = sorted({n for x in pairs for n in x})
    at = {n: f"h{i}" for i, n in enumerate(names)}
    owner = [max(x, key=lambda n: levels[n]) for x in pairs]
    # Null is a value with a hash of its own.
    hashed = _hashed(df, names).fillna(NULL_HASH)
    may = [n for n in sorted(set(owner)) if most is None or most[n] > rows / HOT_PART]
    hot = dict.fromkeys(owner, ()) | (hot_values(hashed.select(*[F.col(at[n]).alias(f"h{i}") for i, n in enumerate(may)]), may, rows) if may else {})
    whole = None
    for a in sorted(set(owner)):
        mine = [(i, x[1] if x[0] == a else x[0]) for i, x in enumerate(pairs) if owner[i] == a]
        is_hot = F.col(at[a]).isin(hot[a]) if hot[a] else F.lit(False)
        dealt = hashed.where(~is_hot).select(F.col(at[a]).alias("a"), *[F.col(at[b]).alias(f"b{i}") for i, b in mine]).repartition(rows // DEALT + 1, "a")
        counted = dealt.mapInArrow(_cell_sums([i for i, _ in mine]), "p int, b long, t double, c long, cells long")
        if hot[a]:
            few = hashed.where(is_hot)
            cells = F.array(*[F.struct(F.lit(i).alias("p"), F.col(at[b]).alias("b")) for i, b in mine])
            totals = few.groupBy(F.col(at[a]).alias("v")).agg(X.rows().alias("r"))
            cut = few.select(F.col(at[a]).alias("a"), F.inline(cells)).groupBy("a", "p", "b").agg(X.rows().alias("c"))
            # Fewer than HOT_PART rows.
            cut = cut.join(F.broadcast(totals), F.col("a") == F.col("v"))
            o = F.col("c").cast("double")
            counted = counted.unionByName(cut.select("p", "b", (o * o / F.col("r")).alias("t"), "c", F.lit(1).cast("long").alias("cells")))
        sent = sum(min(rows, (rows // DEALT + 1) * levels[b]) for _, b in mine)
        by_b = counted.repartition(sent // GROUPED + 1, "p", "b").groupBy("p", "b").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum("cells").alias("cells"))
        part = by_b.groupBy("p").agg(F.sum("c").alias("total"), F.sum("cells").alias("distinct_rows"), F.sum(F.col("t") / F.col("c")).alias("s"))
        whole = part if whole is None else whole.unionByName(part)
    return whole


def with_sides(sums: DataFrame, pairs: list[tuple[str, str]], known: dict[str, tuple[int, int]], levels: dict[str, int]) -> DataFrame:
    """``wide_sums`` with what is known of the columns: present and distinct values, levels, and chi2."""
    at = F.col("p") + 1
    pick = lambda value: F.element_at(F.array(*[F.lit(value(x)).cast("long") for x in pairs]), at)
    return sums.select(
        "p", "total", "distinct_rows", F.col("total").alias("sample_size"), F.greatest(F.lit(0.0), F.col("total") * (F.col("s") - 1)).alias("chi2"),
        pick(lambda x: levels[x[0]]).alias("n_rows"), pick(lambda x: levels[x[1]]).alias("n_cols"),
        pick(lambda x: known[x[0]][0]).alias("forward_unique"), pick(lambda x: known[x[0]][1]).alias("forward_present"),
        pick(lambda x: known[x[1]][0]).alias("reverse_unique"), pick(lambda x: known[x[1]][1]).alias("reverse_present"),
    )


def settled_composite(x: tuple[str, str], known: dict[str, tuple[int, int]]) -> dict | None:
    """The result of composite uniqueness where one column is unique by itself, which needs no row."""
    alone = [n for n in x if known[n][1] > 0 and known[n][0] == known[n][1]]
    share = lambda n: known[n][0] / known[n][1] if known[n][1] else 0.0
    return {
        "duplicate_rows": 0, "uniqueness_ratio": 1.0, "column1_ratio": share(x[0]), "column2_ratio": share(x[1]), "unique_column": alone[0], "status": "skipped",
    } if alone else None


def settled_association(x: tuple[str, str], levels: dict[str, int], rows: int) -> dict | None:
    """Cramer's V where one column has as many levels as there are rows: each row total is 1, so chi2 is n (levels of the other - 1)."""
    if not rows or rows not in (levels[x[0]], levels[x[1]]):
        return None
    k = min(levels[x[0]], levels[x[1]])
    out = {"sample_size": rows, "chi2": float(rows * (k - 1)), "n_rows": levels[x[0]], "n_cols": levels[x[1]]}
    return out | ({"cramers_v": 1.0, "strength": "strong", "status": "high"} if k >= 2 else {"cramers_v": None, "strength": None, "status": "skipped"})


def _side(g: DataFrame, own: str, other: str, tag: str) -> DataFrame:
    """By p: groups of one column that have a value of the other, those with several, distinct and present values."""
    s = g.groupBy("p", own).agg(F.sum("n").alias("r"), F.count(other).alias("d"))
    some = F.col(own).isNotNull()
    return s.groupBy("p").agg(
        F.count_if(some & (F.col("d") > 0)).alias(f"{tag}_groups"), F.count_if(some & (F.col("d") > 1)).alias(f"{tag}_violations"),
        F.count(own).alias(f"{tag}_unique"), F.coalesce(F.sum(F.when(some, F.col("r"))), F.lit(0)).alias(f"{tag}_present"), X.rows().alias(f"{tag}_levels"),
    )


def pair_summary(g: DataFrame) -> DataFrame:
    """One row for each p: total, distinct rows, and both sides' counts."""
    whole = g.groupBy("p").agg(F.sum("n").alias("total"), X.rows().alias("distinct_rows"))
    return whole.join(_side(g, "a", "b", "forward"), "p").join(_side(g, "b", "a", "reverse"), "p")


def pair_totals(g: DataFrame, pairs: list[tuple[str, str]], known: dict[str, tuple[int, int]]) -> DataFrame:
    """As ``pair_summary`` without groups and violations; known: distinct and present values of each column."""
    whole = g.groupBy("p").agg(F.sum("n").alias("total"), X.rows().alias("distinct_rows"))
    at = F.col("p") + 1
    pick = lambda side, what: F.element_at(F.array(*[F.lit(known[x[side]][what]).cast("long") for x in pairs]), at)
    return whole.withColumns({
        "forward_unique": pick(0, 0), "forward_present": pick(0, 1), "reverse_unique": pick(1, 0), "reverse_present": pick(1, 1)
    })


def _named(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    labels = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    at = F.element_at(labels, F.col("p") + 1)
    return df.select("*", at["a"].alias("column1"), at["b"].alias("column2"))


def dependencies(summary: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Share of groups of one column that have one value of the other, for both directions, and the better one."""
    none = F.col("forward_groups") == 0
    rate = lambda t: F.when(~none, 1 - X.ratio(F.col(f"{t}_violations"), F.col(f"{t}_groups")))
    s = _named(summary, pairs).withColumns({"forward_ratio": rate("forward"), "reverse_ratio": rate("reverse")})
    best = F.greatest("forward_ratio", "reverse_ratio")
    arrow = lambda x, y: F.concat(x, F.lit(" -> "), y)
    return s.select(
        "column1", "column2", "forward_groups", "forward_violations", "reverse_groups", "reverse_violations", "forward_ratio", "reverse_ratio", best.alias("best_ratio"),
        F.when(none, None).when(F.col("forward_ratio") >= F.col("reverse_ratio"), arrow("column1", "column2")).otherwise(arrow("column2", "column1")).alias("best_direction"),
        F.when(none, "low").otherwise(X.ladder(best, [(0.95, "high"), (0.8, "medium")], "low")).alias("status"),
    )


def composites(summary: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Duplicate rows of the pair, nulls included; skipped where one column is unique by itself."""
    alone = lambda t: (F.col(f"{t}_present") > 0) & (F.col(f"{t}_unique") == F.col(f"{t}_present"))
    first, second = alone("forward"), alone("reverse")
    skip = first | second
    dup = F.col("total") - F.col("distinct_rows")
    r = F.when(skip, 1.0).otherwise(1 - X.ratio(dup, F.col("total")))
    return _named(summary, pairs).select(
        "column1", "column2", F.when(skip, 0).otherwise(dup).alias("duplicate_rows"), r.alias("uniqueness_ratio"),
        X.ratio(F.col("forward_unique"), F.col("forward_present")).alias("column1_ratio"), X.ratio(F.col("reverse_unique"), F.col("reverse_present")).alias("column2_ratio"),
        F.when(first, F.col("column1")).when(second, F.col("column2")).alias("unique_column"),
        F.when(skip, "skipped").when(r == 1, "high").when(r >= 0.99, "medium").otherwise("low").alias("status"),
    )


def chi_squares(g: DataFrame) -> DataFrame:
    """p, sample_size, chi2, n_rows, n_cols of each crosstab of text forms, nulls a category.

    chi2 = n (sum of o^2 / (row total * column total) - 1) needs the observed cells only.
    """
    cb = g.groupBy("p", "b").agg(F.sum("n").alias("c"))
    o = F.col("n").cast("double")
    cells = g.alias("g").join(cb.alias("cb"), F.expr("g.p = cb.p and g.b <=> cb.b")).select("g.p", "g.a", "n", (o * o / F.col("c")).alias("t"))
    # The sum over one row of the crosstab is divided by the row's total, which comes from the same group.
    rows = cells.groupBy("p", "a").agg(F.sum("n").alias("r"), F.sum("t").alias("t"))
    s = rows.groupBy("p").agg(F.sum("r").alias("sample_size"), F.sum(F.col("t") / F.col("r")).alias("s"), X.rows().alias("n_rows"))
    s = s.join(cb.groupBy("p").agg(X.rows().alias("n_cols")), "p")
    return s.select("p", "sample_size", F.greatest(F.lit(0.0), F.col("sample_size") * (F.col("s") - 1)).alias("chi2"), "n_rows", "n_cols")


def associations(g: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Cramer's V of each pair."""
    return strengths(chi_squares(g), pairs)


def strengths(chi: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Cramer's V from p, sample_size, chi2, n_rows and n_cols."""
    k = F.least("n_rows", "n_cols")
    v = F.when(k >= 2, F.sqrt(F.col("chi2") / (F.col("sample_size") * (k - 1))))
    return _named(chi, pairs).select(
        "column1", "column2", "sample_size", "chi2", "n_rows", "n_cols", v.alias("cramers_v"),
        F.when(v.isNotNull(), X.ladder(v, [(0.5, "strong"), (0.3, "moderate"), (0.1, "weak")], "very weak")).alias("strength"),
        F.when(v.isNull(), "skipped").otherwise(X.ladder(v, [(0.5, "high"), (0.3, "medium")], "low")).alias("status"),
    )


def functional_dependency(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return dependencies(pair_summary(pair_groups(df, pairs)), pairs)


def composite_uniqueness(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return composites(pair_summary(pair_groups(df, pairs)), pairs)


def cramers_v(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return associations(pair_groups(df, pairs), pairs)


# -- enhanced forms, by option ---------------------------------------------------------------------------------------


def power_limits(rows: int) -> tuple[int, int]:
    """(rows, rows a group) that an analysis of ``rows`` rows needs."""
    return (20, 2) if rows < 100 else (30, 3) if rows <= 1000 else (50, 4) if rows < 10000 else (100, 5)


def statistical_power(df: DataFrame, a: str, b: str) -> dict:
    """Whether the pair has rows and groups enough: sufficient, reason, and the counts."""
    both = X.col(a).isNotNull() & X.col(b).isNotNull()
    r = df.agg(
        X.rows().alias("total"), F.count_if(both).alias("valid"), F.count_distinct(F.when(both, X.col(a))).alias("u1"), F.count_distinct(F.when(both, X.col(b))).alias("u2")
    ).first()
    least, group = power_limits(r["total"])
    levels = 2 if r["total"] < 100 else 3
    out = {"total_rows": r["total"], "valid_rows": r["valid"], "unique_col1": r["u1"], "unique_col2": r["u2"], "min_sample": least, "min_group": group}
    if r["valid"] < least:
        return out | {"sufficient": False, "reason": "insufficient_total_sample"}
    if r["u1"] < levels or r["u2"] < levels:
        return out | {"sufficient": False, "reason": "insufficient_groups"}
    if r["valid"] / r["u1"] < group or r["valid"] / r["u2"] < group:
        return out | {"sufficient": False, "reason": "insufficient_group_size"}
    return out | {"sufficient": True, "reason": "sufficient_power"}


def should_proceed(df: DataFrame, a: str, b: str, kind: str = "general") -> dict:
    p = statistical_power(df, a, b)
    return {"should_proceed": p["sufficient"], "reason": p["reason"], "analysis_type": kind, "details": p}


def upper_gamma(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below s + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1:
        term = total = 1.0 / s
        k = s
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * front)
    tiny = 1e-300
    b = x + 1 - s
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - s)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_p_value(chi2: float, dof: int) -> float:
    return upper_gamma(dof / 2, chi2 / 2) if dof > 0 else 1.0


def cramers_v_tested(df: DataFrame, a: str, b: str) -> dict:
    """Association with a significance test (Yates' correction for one degree of freedom)."""
    s = chi_squares(pair_groups(df, [(a, b)])).first()
    rows, cols, n = (s["n_rows"], s["n_cols"], s["sample_size"]) if s else (0, 0, 0)
    if rows < 2 or cols < 2:
        return {"status": "skipped", "cramers_v": None, "p_value": None, "dof": 0}
    dof = (rows - 1) * (cols - 1)
    chi2 = s["chi2"]
    if dof == 1:
        g = pair_groups(df, [(a, b)]).withColumnRenamed("n", "o").collect()
        ra, cb = {}, {}
        for x in g:
            ra[x["a"]] = ra.get(x["a"], 0) + x["o"]
            cb[x["b"]] = cb.get(x["b"], 0) + x["o"]
        seen = {(x["a"], x["b"]): x["o"] for x in g}
        expected = {(i, j): ra[i] * cb[j] / n for i in ra for j in cb}
        chi2 = sum((abs(seen.get(k, 0) - e) - min(0.5, abs(seen.get(k, 0) - e))) ** 2 / e for k, e in expected.items())
    p, v = chi2_p_value(chi2, dof), math.sqrt(chi2 / (n * (min(rows, cols) - 1)))
    status = "not_significant" if p >= 0.05 else "high" if v >= 0.5 and p < 0.001 else "medium" if v >= 0.3 and p < 0.01 else "low" if v >= 0.1 else "very_low"
    return {"status": status, "cramers_v": v, "chi2": chi2, "p_value": p, "dof": dof, "sample_size": n}


def functional_dependency_tested(df: DataFrame, a: str, b: str) -> dict:
    """Functional dependency with confidence from the number, size and balance of the groups."""
    g = pair_groups(df, [(a, b)]).where("a is not null and b is not null")

    def one(source: str, target: str, name: str) -> dict | None:
        s = g.groupBy(source).agg(F.count(target).alias("d"), F.sum("n").alias("k"))
        r = s.agg(X.rows().alias("g"), F.count_if(F.col("d") > 1).alias("bad"), F.avg("k").alias("avg"), F.min("k").alias("low")).first()
        if not r["g"]:
            return None
        parts = (min(1.0, r["avg"] / 5), min(1.0, r["low"] / max(1.0, r["avg"] / 2)), min(1.0, r["g"] / 10))
        return {"direction": name, "ratio": 1 - r["bad"] / r["g"], "confidence": sum(parts) / 3, "power": min(1.0, r["g"] * r["avg"] / 100), "groups": r["g"], "violations": r["bad"]}

    found = [x for x in (one("a", "b", f"{a} -> {b}"), one("b", "a", f"{b} -> {a}")) if x]
    if not found:
        return {"status": "low", "message": "Insufficient data"}
    best = max(found, key=lambda x: x["ratio"] * x["confidence"])
    r, c, p = best["ratio"], best["confidence"], best["power"]
    status = "high" if r >= 0.95 and c >= 0.7 and p >= 0.5 else "medium" if r >= 0.85 and c >= 0.5 and p >= 0.3 else "low" if r >= 0.75 and c >= 0.3 else "very_low"
    return {"status": status, "best_direction": best["direction"], "directions": found, **best}
