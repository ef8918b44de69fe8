"""Pairs, keys, inference, enhanced statistics."""

import math

import pytest

from tablelens.functions.patterns import SEPARATORS
from tablelens.operators import keys as K
from tablelens.operators import pairs as P
from tablelens.operators import regex_inference as R
from tablelens.operators.sampling import optimal_size, pair_sample_size, sample, should_sample


def frame(spark, rows, kind="a string, b long"):
    return spark.createDataFrame(rows, kind)


def test_identicality(spark):
    df = spark.createDataFrame([(1, 1, 1), (None, None, None), (3, 3, 4)], "a long, b long, c long")
    same, other = P.per_pair(df, [("a", "b"), ("a", "c")], P.identicality).collect()
    assert (same["identical"], same["status"], same["skip_other_checks"]) == (True, "high", True)
    assert (other["identical"], other["status"]) == (False, "low")


def test_correlation_and_missingness(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i if i % 3 else None, 5.0) for i in range(30)], "a double, b double, c double")
    ab, ac = P.per_pair(df, [("a", "b"), ("a", "c")], P.correlation).collect()
    assert ab["correlation"] == pytest.approx(1.0)
    assert (ab["sample_size"], ab["status"]) == (20, "high")
    assert ac["status"] == "skipped"
    m = P.per_pair(df, [("a", "b")], P.missingness).first()
    assert (m["both_null"], m["only_first_null"], m["only_second_null"], m["status"]) == (0, 0, 10, "low")


def test_dependency(spark):
    r = P.functional_dependency(frame(spark, [("x", 1), ("x", 1), ("y", 2), ("y", 2), ("z", 3), (None, 9), ("q", None)]), [("a", "b")]).first()
    assert (r["forward_groups"], r["forward_violations"], r["best_ratio"], r["best_direction"], r["status"]) == (3, 0, 1.0, "a -> b", "high")
    none = P.functional_dependency(frame(spark, [(None, 1), ("x", None)]), [("a", "b")]).first()
    assert (none["best_direction"], none["status"]) == (None, "low")


def test_composite(spark):
    r = P.composite_uniqueness(frame(spark, [("x", 1), ("x", 2), ("x", 2), (None, 2), (None, 2), ("y", 1)]), [("a", "b")]).first()
    assert (r["duplicate_rows"], r["status"]) == (2, "low")
    assert r["uniqueness_ratio"] == pytest.approx(4 / 6)
    one = P.composite_uniqueness(frame(spark, [("x", 1), ("y", 1)]), [("a", "b")]).first()
    assert (one["status"], one["unique_column"], one["uniqueness_ratio"]) == ("skipped", "a", 1.0)


def test_association(spark):
    rows = [("x", 1)] * 30 + [("y", 2)] * 30
    full = P.cramers_v(frame(spark, rows), [("a", "b")]).first()
    assert full["cramers_v"] == pytest.approx(1.0)
    assert full["status"] == "high"
    assert P.cramers_v(frame(spark, [("x", 1), ("x", 2)]), [("a", "b")]).first()["status"] == "skipped"
    mixed = [("x", 1)] * 20 + [("x", 2)] * 10 + [("y", 1)] * 5 + [("y", 2)] * 25
    chi = sum((o - e) ** 2 / e for o, e in ((20, 12.5), (10, 17.5), (5, 12.5), (25, 17.5)))
    got = P.cramers_v(frame(spark, mixed), [("a", "b")]).first()
    assert got["chi2"] == pytest.approx(chi)
    tested = P.cramers_v_tested(frame(spark, mixed), "a", "b")
    yates = sum((abs(o - e) - 0.5) ** 2 / e for o, e in ((20, 12.5), (10, 17.5), (5, 12.5), (25, 17.5)))
    assert tested["chi2"] == pytest.approx(yates)
    assert tested["p_value"] == pytest.approx(math.erfc(math.sqrt(yates / 2)), rel=1e-9)


def test_p_values():
    assert P.chi2_p_value(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert P.chi2_p_value(5.991464547107979, 2) == pytest.approx(0.05, rel=1e-9)
    assert P.chi2_p_value(124.34211340400407, 100) == pytest.approx(0.05, rel=1e-8)
    assert P.chi2_p_value(0, 3) == 1.0


@pytest.mark.parametrize(("rows", "limits"), [(99, (20, 2)), (100, (30, 3)), (1000, (30, 3)), (1001, (50, 4)), (9999, (50, 4)), (10000, (100, 5))])
def test_power_limits(rows, limits):
    assert P.power_limits(rows) == limits


def test_power_and_confidence(spark):
    df = frame(spark, [("xyz"[i % 3], i % 3) for i in range(60)])
    assert P.statistical_power(df, "a", "b")["sufficient"]
    assert P.should_proceed(frame(spark, [("x", 1)] * 5), "a", "b")["reason"] == "insufficient_total_sample"
    d = P.functional_dependency_tested(df, "a", "b")
    assert d["ratio"] == 1.0
    assert d["status"] in ("high", "medium")
    assert P.functional_dependency_tested(frame(spark, [(None, 1)]), "a", "b")["status"] == "low"


def test_keys(spark):
    df = spark.createDataFrame([(i, i // 2, f"n{i % 3}", None if i == 3 else i) for i in range(20)], "order_id long, part long, name string, holes long")
    found = K.candidate_keys(df, "order")
    assert found[0]["columns"] == ["order_id"]
    assert found[0]["confidence"] == 1.0
    assert all(set(k) == {"columns", "uniqueness", "noNulls", "confidence", "reason"} for k in found)
    counts = {tuple(r["columns"]): r["distinct"] for r in K.key_counts(df).collect()}
    assert counts["part", "name"] == len({(i // 2, i % 3) for i in range(20)})
    assert counts["name", "holes"] == 20
    scored = K.primary_key_score(found[0], df, "order")
    assert scored["confidence"] == pytest.approx(0.35 + 0.15 + 0.1 + 0.05)
    assert K.candidate_keys(df.limit(0)) == []


def test_name_bonus():
    assert K.name_bonus(["user_id"], "user")[0] == pytest.approx(0.3)
    assert K.name_bonus(["row_uuid"], "")[0] == pytest.approx(0.4)
    assert K.name_bonus(["a", "b"], "t")[0] == 0.0
    assert K.name_bonus(["o_orderkey"], "x")[0] == pytest.approx(0.1)


def inferred(spark, values, n=3):
    return R.infer_patterns(spark.createDataFrame([(v,) for v in values], "c string"), "c", n)


def test_inference(spark):
    codes = inferred(spark, ["PROD123", "ITEM456", "CODE789", "UNIT012"])
    assert codes[0].match_ratio == 1.0
    assert all(p.confidence <= 99.5 for p in codes)
    assert [p.confidence for p in codes] == sorted((p.confidence for p in codes), reverse=True)
    assert any(p.pattern == r"^[A-Z][A-Z][A-Z][A-Z]\d\d\d$" for p in inferred(spark, ["PROD123", "ITEM456", "CODE789", "UNIT012"], 9))
    mail = inferred(spark, [f"p{i}@x.org" for i in range(9)], 9)
    assert any("@" in p.pattern for p in mail)
    parts = inferred(spark, ["ab-1", "cde-22", "f-333", "gh-4"], 9)
    assert any(p.pattern == r"^[a-z]+\-\d+$" for p in parts)
    assert any(p.description == "2-word text pattern" for p in inferred(spark, ["red fox", "blue bird", "old cat"], 9))
    assert inferred(spark, [None, None]) == []
    assert codes[0].examples == sorted(codes[0].examples)
    assert len(SEPARATORS) == 8


def test_simplicity():
    assert R.complexity("^[a-z]+$") < R.complexity(r"^[A-Z][a-z]+(\s[A-Z][a-z]+)*$")
    a, b = R.Pattern("^[a-z]+$", "", 10, 1.0, 80.0), R.Pattern(r"^([a-z]|[A-Z]){2,}$", "", 10, 1.0, 80.0)
    first, second = R.prefer_simple([a, b])
    assert first.confidence == 86.0
    assert second.confidence < first.confidence
    assert R.prefer_simple([a]) == [a]
    assert R.dedupe([a, a]) == [a]


def test_sampling(spark):
    df = spark.range(1000)
    rows = [r[0] for r in sample(df, 50, 7).collect()]
    assert len(rows) == 50
    assert sorted(rows) == sorted(r[0] for r in sample(df.repartition(9), 50, 7).collect())
    assert sorted(rows) != sorted(r[0] for r in sample(df, 50, 8).collect())
    assert not should_sample(10, 10)
    assert should_sample(11, 10)
    assert [optimal_size(5, 1, 5), optimal_size(10**6, 0, 0), optimal_size(10**6, 9, 10), optimal_size(10**6, 1, 100), optimal_size(10**6, 5, 10)] == [5, 1000, 50000, 5000, 10000]
    assert pair_sample_size("correlation") == 5000
