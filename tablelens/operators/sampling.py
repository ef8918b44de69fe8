"""Exact-size, seeded samples and the sizes that are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions import exprs as X


def should_sample(rows: int, threshold: int) -> bool:
    return rows > threshold


def sample_order(df: DataFrame, seed: int = 42, by: tuple[str, ...] | None = None) -> Column:
    """What rows are ordered by before the first are taken: a hash of seed and values, or a digest of seed and the columns ``by``.

    The digest, of the texts of seed and values with colons between, can be made anywhere; it needs columns that tell rows apart.
    """
    if by:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(X.col(n).cast("string"), F.lit("")) for n in by]))
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    return F.xxhash64(F.lit(seed), *[F.to_json(X.col(n)) if kinds[n] in ("map", "variant") else X.col(n) for n in df.columns])


def sample(df: DataFrame, size: int, seed: int = 42, by: tuple[str, ...] | None = None) -> DataFrame:
    """Exactly ``size`` rows, the same for any partitioning: the first in :func:`sample_order`."""
    return df.orderBy(sample_order(df, seed, by)).limit(size)


def optimal_size(rows: int, distinct: int, non_null: int, base: int = 10000) -> int:
    """Sample size by the share of distinct values: more for nearly unique columns, fewer for repetitive ones."""
    if rows <= base:
        return rows
    if not non_null:
        return min(1000, rows)
    r = distinct / non_null
    return min(rows, 50000 if r > 0.8 else 5000 if r < 0.1 else base)


# Rows that each pair rule takes of a large table, where row sampling is switched on.
PAIR_SAMPLES = {"correlation": 5000, "functional_dependency": 10000, "missingness_relationships": 20000, "identicality": 1000}


def pair_sample_size(rule: str, default: int = 10000) -> int:
    return PAIR_SAMPLES.get(rule, default)
