"""Sample first, apply to all; timeouts; dry runs of custom rules."""

import re

import pytest
from pyspark.sql import functions as F

from tablelens import Profiler, ProfilingConfig, Rule
from tablelens.operators import discovery as D
from tablelens.operators import pairs as P
from tablelens.operators import two_stage as S
from tablelens.plans import profiler
from tablelens.operators.sampling import sample
from tablelens.plans.registry import Registry, dry_run


def test_formats(spark):
    df = spark.createDataFrame([(f"AB-{i:03d}",) for i in range(90)] + [("x",)] * 10, "c string")
    patterns = S.discover_formats(df, "c", 100)
    assert patterns == [r"^\p{L}{2}\-\p{Nd}{3}$", r"^\p{L}{1}$"]
    r = df.agg(*[v.alias(k) for k, v in S.apply_formats(F.col("c"), patterns).items()]).first()
    assert (r["pattern_0"], r["pattern_1"], r["match_ratio"], r["status"]) == (90, 10, 1.0, "passed")
    assert S.signature_regex("D.D") == r"^\p{Nd}{1}\.\p{Nd}{1}$"
    assert re.escape("-") in patterns[0]


def test_thresholds(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(200)] + [(1000.0,)], "c double")
    t = S.discover_thresholds(df, "c", 1000)
    r = df.agg(*[v.alias(k) for k, v in S.apply_thresholds(F.col("c"), t).items()]).first()
    assert (r["iqr_outliers"], r["sigma_outliers"], r["status"]) == (1, 1, "passed")
    assert S.discover_thresholds(df.limit(5), "c") is None


def test_ratios_and_structure(spark):
    df = spark.createDataFrame([("1",), ("2",), ("x",), (None,)], "c string")
    t = S.type_ratios(df, "c")
    assert t["primary_type"] == "numeric"
    assert t["estimated_counts"]["numeric"] == 2
    s = S.sample_structure(spark.range(100).select((F.col("id") % 4).alias("c")), "c")
    assert s["entropy"] == pytest.approx(2.0)
    assert len(s["categories"]) == 4
    assert S.sample_structure(spark.range(50).select(F.col("id").alias("c")), "c")["categories"] is None
    assert S.applies("text_patterns", 25001)
    assert not S.applies("text_patterns", 25000)
    assert S.sample_rows("outlier_detection") == 3000
    assert S.may_stop_early("identicality", 10001)


def test_timeout_gives_errors(spark):
    slow = spark.range(0, 2000, 1, 4).select(F.expr("reflect('java.lang.Thread', 'sleep', cast(5 as bigint))").isNull().alias("z"), F.col("id"))
    p = Profiler(ProfilingConfig(timeout_seconds=1))
    got = p.fused(slow, [("a", {"n": F.count_if("z"), "m": F.sum("id")})])
    assert isinstance(got["a"], TimeoutError)
    assert spark.range(5).count() == 5


def test_stopped_chunks_are_run_set_by_set(spark):
    """A chunk that is too slow as a whole gives its results all the same, and there is no limit by default."""
    assert ProfilingConfig().timeout_seconds is None
    df = spark.createDataFrame([(i % 3, i % 4, i % 5) for i in range(60)], "a long, b long, c long")
    plain = {(r.rule_id, r.columns): (r.status, r.details) for r in Profiler().profile(df).results}

    class Late(Profiler):
        seen: set = set()

        def _timed(self, df, f):
            place = f.__code__
            # A lambda of one column is the second try.
            if place not in self.seen and place.co_varnames[:1] != ("n",):
                self.seen.add(place)
                raise TimeoutError("stopped")
            return super()._timed(df, f)

    p = Late()
    assert p.fused(df, [("x", {"n": F.sum("a")}), ("y", {"n": F.sum("b")})]) == {"x": {"n": 60}, "y": {"n": 90}}
    got = {(r.rule_id, r.columns): (r.status, r.details) for r in p.profile(df).results}
    assert got == plain
    assert len(p.seen) > 2


def test_missing_bounds_are_errors(spark):
    df = spark.createDataFrame([(i % 120 + 0.5,) for i in range(300)], "a double")

    class Boundless(Profiler):
        def fused(self, df, wanted):
            return {k: TimeoutError("stopped") if k[1] == "_bounds" else v for k, v in super().fused(df, wanted).items()}

    want = {"outlier_detection", "outlier_detection_zscore", "modality_estimation", "numeric_histogram_quantiles"}
    got = {r.rule_id: r for r in Boundless().profile(df).results if r.rule_id in want}
    assert got.keys() == {r.rule_id for r in Profiler().profile(df).results} & want
    assert len(got) > 1
    for r in got.values():
        assert r.status == "error"
        assert r.message == "TimeoutError: stopped"


def test_value_types_say_what_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(profiler, "VALUE_TYPES", 3)
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": "y", "c": 1}',), ('{"d": 2}',)], "j string")
    d = Profiler()._nested(df, "j", "dictionary_schema_analysis")
    assert (list(d["value_types"]), d["value_type_keys"], d["value_types_truncated"]) == (["a", "b"], 4, True)
    d = Profiler()._nested(df.limit(1), "j", "dictionary_schema_analysis")
    assert (list(d["value_types"]), d["value_type_keys"], d["value_types_truncated"]) == (["a", "b"], 2, False)


def test_dry_run(spark):
    assert dry_run(Rule("a", "A", function=lambda c, k: {"x": F.max(c)}), spark) is None
    assert "Error" in dry_run(Rule("a", "A", function=lambda c, k: 1 / 0), spark)
    assert dry_run(Rule("a", "A", cross_column=True, function=lambda a, b: {"x": F.corr(a, b)}), spark) is None
    assert dry_run(Rule("a", "A"), spark) == "the rule has no function"
    assert dry_run(Rule("a", "A", category="table", function=lambda df: {"n": 1}), spark) is None


def test_add_refuses_rules_that_fail(spark):
    registry = Registry()
    registry.add(Rule("good", "Good", function=lambda c, k: {"x": F.max(c)}), spark)
    with pytest.raises(ValueError, match="bad"):
        registry.add(Rule("bad", "Bad", function=lambda c, k: 1 / 0), spark)
    assert registry.get("good") is not None
    assert registry.get("bad") is None


def mixed(spark, n=26000):
    """Two formats of codes, numbers with outliers, two peaks, a category, nulls."""
    c = F.col("id")
    return spark.range(n).select(
        c.alias("k"), F.when(c % 10 < 7, F.format_string("AB-%03d", c % 1000)).when(c % 10 < 9, F.lit("x")).alias("code"),
        F.when(c % 50 == 0, 10000.0).otherwise((c % 10).cast("double")).alias("amount"), F.when(c % 2 == 0, 1.0).otherwise(9.0).alias("peak"), F.concat(F.lit("c"), c % 4).alias("kind"),
    )


def test_discovery_is_one_job_and_confirmation_another(spark):
    df = mixed(spark)
    wanted = {"code": ["text_patterns"], "amount": ["outlier_detection"], "peak": ["modality_estimation"], "kind": ["stability_entropy", "functional_dependency"]}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("discovery", "")
    found = D.found_by_column(D.discover(df, wanted))
    assert len(tracker.getJobIdsForGroup("discovery")) <= 2  # the sorted sample, and what is made of it
    spark.sparkContext.setJobGroup("", "")
    assert [f["format"] for f in found["code"]["formats"]] == ["LL-DDD", "L"]
    got = D.two_stage(df, wanted)
    assert got["code", "text_patterns"]["pattern_matches"][0] == {"pattern": r"^\p{L}{2}\-\p{Nd}{3}$", "format": "LL-DDD", "matches": 18200, "match_ratio": 18200 / 23400}
    assert got["code", "text_patterns"]["total_coverage"] == pytest.approx(1.0)
    assert got["amount", "outlier_detection"]["iqr_outliers"] == 520
    assert got["peak", "modality_estimation"]["estimated_modality"] == "bimodal"
    assert got["kind", "stability_entropy"]["estimated_entropy"] == pytest.approx(2.0, abs=0.01)
    assert got["kind", "functional_dependency"]["category_count"] == 4


def test_nothing_discovered_is_a_warning(spark):
    empty = spark.createDataFrame([(None, None)] * 5, "t string, x double")
    rules = ["text_patterns", "parseability_analysis", "stability_entropy", "functional_dependency", "text_regex_inference"]
    got = D.two_stage(empty, {"t": rules, "x": ["outlier_detection", "modality_estimation"]})
    assert {r["status"] for k, r in got.items() if k[1] != "functional_dependency"} == {"warning"}
    assert D.two_stage(empty.limit(0), {"t": rules})["t", "text_patterns"]["pattern_matches"] == []
    assert got["t", "text_regex_inference"]["message"].startswith("Two-stage processing not implemented")
    # A sample of nearly distinct values is no category.
    assert D.two_stage(spark.range(100).select(F.col("id").alias("t")), {"t": ["functional_dependency"]})["t", "functional_dependency"]["status"] == "skipped"


def test_samples_by_key(spark):
    """The smallest digests of seed and key, whatever the other columns and the partitions are."""
    import hashlib

    df = spark.range(500).select("id", (F.col("id") * 7 % 13).alias("v"))
    want = sorted(range(500), key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())[:20]
    assert [r["id"] for r in sample(df.repartition(5), 20, 42, ("id",)).collect()] == want


def test_profile_in_two_stages(spark):
    """Heavy rules of large tables take the other shape; the light ones and small tables stay as they are."""
    c = F.col("id")
    df = spark.range(26000).select(c.alias("k"), F.format_string("AB-%05d", c).alias("code"), (c * 37 % 9973 / 7).alias("amount"), F.concat(F.lit("c"), c % 4).alias("kind"))
    config = dict(enable_cross_column=False, two_stage=True)
    whole = {(r.columns, r.rule_id): r for r in Profiler(ProfilingConfig(enable_cross_column=False)).profile(df).results}
    got = {(r.columns, r.rule_id): r for r in Profiler(ProfilingConfig(**config)).profile(df).results}
    assert got.keys() == whole.keys()
    heavy = {k for k in got if k[1] in S.HEAVY_RULES}
    assert {k[1] for k in heavy} >= {"text_patterns", "outlier_detection", "outlier_detection_zscore", "parseability_analysis", "stability_entropy", "modality_estimation"}
    for k, r in got.items():
        if k in heavy:
            assert r.status == "warning" or r.details["optimization"].startswith("two_stage")
        else:
            assert (r.status, r.details) == (whole[k].status, whole[k].details)
    small = Profiler(ProfilingConfig(**config, heavy_rule_threshold=26000)).profile(df).results
    assert all("optimization" not in r.details for r in small)


def read_rows(spark, df):
    """``df`` and an accumulator of the rows that its tasks hand on."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(count, df.schema), seen


def test_comparing_stops_where_columns_differ(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        df = spark.range(0, 200000, 1, 20).select("id", (F.col("id") + 1).alias("a"), F.col("id").alias("b"), F.when(F.col("id") != 199999, F.col("id")).alias("c"))
        few, seen = read_rows(spark, df)
        assert P.differ_first(few, [("id", "a"), ("a", "b")]) == {("id", "a"): False, ("a", "b"): False}
        assert seen.value < 20000
        whole, seen = read_rows(spark, df)
        assert P.differ_first(whole, [("id", "a"), ("id", "b"), ("id", "c")]) == {("id", "a"): False, ("id", "b"): True, ("id", "c"): False}
        assert seen.value >= 200000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert P.differ_first(df.limit(0), [("id", "a")]) == {("id", "a"): True}
    assert P.differ_first(df, []) == {}


def test_many_differing_pairs_end_in_one_aggregation(spark, monkeypatch):
    monkeypatch.setattr(P, "SEARCHES", 2)
    monkeypatch.setattr(P, "FIRST", 1)
    df = spark.range(12).select("id", *[F.when(F.col("id") == i, -1).otherwise(F.col("id")).alias(f"c{i}") for i in range(8)], F.col("id").alias("same"))
    got = P.differ_first(df.coalesce(1), [("id", f"c{i}") for i in range(8)] + [("id", "same")])
    assert got == {("id", f"c{i}"): False for i in range(8)} | {("id", "same"): True}


@pytest.mark.parametrize("early", [True, False])
def test_identicality_with_and_without_early_exit(spark, early):
    c = F.col("id")
    df = spark.range(12000).select((c % 5).alias("a"), (c % 5).alias("b"), ((c + 1) % 5).alias("d"))
    got = {r.columns: r.details["identical"] for r in Profiler(ProfilingConfig(early_exit=early)).profile(df).results if r.rule_id == "identicality"}
    assert got == {("a", "b"): True, ("a", "d"): False, ("b", "d"): False}
