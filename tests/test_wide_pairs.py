"""Pairs with a wide column: sums by its values against counts of all cells, and what needs no row at all."""

import pytest
from pyspark.sql import functions as F

from tablelens import Profiler, ProfilingConfig
from tablelens.operators import pairs as P


def table(spark, n=3000):
    """w: many values, one of them hot; v: many values and nulls; u: unique; k: a key with one null; c, d: categories."""
    c = F.col("id")
    return spark.range(0, n, 1, 5).select(
        F.when(c % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), c % 900)).alias("w"), F.when(c % 4 != 1, c * 7919 % 1201).alias("v"), c.alias("u"), F.when(c != 17, c).alias("k"),
        (c % 7).alias("c"), F.when(c % 5 != 0, F.concat(F.lit("d"), c % 3)).alias("d"),
    )


def facts(df):
    total = df.count()
    known, levels = {}, {}
    for n in df.columns:
        r = df.agg(F.count_distinct(n).alias("u"), F.count(n).alias("p")).first()
        known[n], levels[n] = (r["u"], r["p"]), r["u"] + (r["p"] < total)
    return total, known, levels


PAIRS = [("w", "c"), ("d", "w"), ("v", "w"), ("v", "d"), ("u", "v"), ("c", "u")]


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == (pytest.approx(b[k]) if isinstance(b[k], float) else b[k]), k


def test_sums_by_wide_columns(spark):
    df = table(spark)
    total, known, levels = facts(df)
    hot = P.hot_values(P._hashed(df, ["w", "v"]), ["w", "v"], total)
    assert len(hot["w"]) == 1 and hot["v"] == [None]
    sums = P.with_sides(P.wide_sums(df, PAIRS, levels, total), PAIRS, known, levels)
    g = P.pair_groups(df, PAIRS)
    for mine, theirs in ((P.composites(sums, PAIRS), P.composites(P.pair_summary(g), PAIRS)), (P.strengths(sums, PAIRS), P.associations(g, PAIRS))):
        mine, theirs = ({(r["column1"], r["column2"]): r.asDict() for r in x.collect()} for x in (mine, theirs))
        assert mine.keys() == theirs.keys() == set(PAIRS)
        for x in PAIRS:
            close(mine[x], theirs[x])


def test_settled_pairs(spark):
    """Where one column is unique the results are known, and equal those that come from counting."""
    df = table(spark, 400)
    total, known, levels = facts(df)
    for x in (("u", "c"), ("c", "u"), ("u", "k"), ("k", "d"), ("d", "k"), ("w", "c")):
        composite, association = P.settled_composite(x, known), P.settled_association(x, levels, total)
        if x == ("w", "c"):
            assert composite is None and association is None
            continue
        want = P.composite_uniqueness(df, [x]).first().asDict()
        close(composite, {k: v for k, v in want.items() if k not in ("column1", "column2")})
        want = P.cramers_v(df, [x]).first().asDict()
        close(association, {k: v for k, v in want.items() if k not in ("column1", "column2")})
    assert P.settled_association(("u", "c"), {"u": 0, "c": 0}, 0) is None


def test_profiles_agree(spark, monkeypatch):
    """With and without wide columns the report is the same, and no pair that is settled or wide is exploded."""
    df = table(spark)

    def run():
        return {(r.columns, r.rule_id): (r.status, r.details) for r in Profiler().profile(df).results if len(r.columns) == 2}

    plain = run()
    monkeypatch.setattr(P, "WIDE", 100)
    exploded = []
    groups = P.pair_groups
    monkeypatch.setattr(P, "pair_groups", lambda d, pairs: exploded.append(pairs) or groups(d, pairs))
    wide = run()
    assert plain.keys() == wide.keys()
    for k in plain:
        assert plain[k][0] == wide[k][0]
        close(wide[k][1], plain[k][1])
    of_values = {("c", "d"), ("d", "c")}
    dependencies = {k[0] for k in plain if k[1] == "functional_dependency"}
    assert {x for part in exploded for x in part} <= of_values | dependencies


def test_profiles_of_sampled_pairs_count_their_own_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "WIDE", 100)
    r = Profiler(ProfilingConfig(pair_sampling=True, pair_sampling_threshold=1000, sample_size=500)).profile(table(spark))
    sizes = {x.details["sample_size"] for x in r.results if x.rule_id == "categorical_association_cramers_v"}
    assert sizes == {500}


def test_wide_columns_are_dealt_by_the_number_of_rows(spark, monkeypatch):
    """No partition is sorted whole or joined with others, and more rows make more partitions with the same sums."""
    df = table(spark)
    total, known, levels = facts(df)
    one = {r["p"]: r.asDict() for r in P.wide_sums(df, PAIRS, levels, total).collect()}
    monkeypatch.setattr(P, "DEALT", 100)
    monkeypatch.setattr(P, "GROUPED", 500)
    sums = P.wide_sums(df, PAIRS, levels, total)
    shown = sums._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in shown and "REPARTITION_BY_NUM" in shown
    assert f", {total // 100 + 1})" in shown
    many = {r["p"]: r.asDict() for r in sums.collect()}
    assert one.keys() == many.keys()
    for p in one:
        close(one[p], many[p])


def test_columns_without_hot_values_are_not_searched_for_them(spark, monkeypatch):
    df = table(spark)
    total, _, levels = facts(df)
    looked = []
    search = P.hot_values
    monkeypatch.setattr(P, "hot_values", lambda h, names, rows: looked.append(names) or search(h, names, rows))
    most = {n: df.groupBy(n).count().agg(F.max("count")).first()[0] for n in df.columns}
    known = {r["p"]: r.asDict() for r in P.wide_sums(df, PAIRS, levels, total, most).collect()}
    assert looked == [["v", "w"]]
    for r in P.wide_sums(df, PAIRS, levels, total).collect():
        close(known[r["p"]], r.asDict())
