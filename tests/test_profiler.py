"""Whole runs, the registry, the report, insights, filters, jobs, sources and sinks."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tablelens import Profiler, ProfilingConfig, Registry, Rule
from tablelens.plans import filters, pairs, registry
from tablelens.plans.insights import insights, value_type
from tablelens.plans.report import plain
from tablelens.plans.types import ColumnAttributes, RulePriority, grade, points
from tablelens.sources import readers, sinks
from tablelens.streaming.jobs import Jobs
from tablelens.streaming.log import Logger

MANIFEST = """PassengerId,Survived,Name,Sex,Age,Fare,Cabin
1,0,"Braund, Mr. Owen",male,22,7.25,
2,1,"Cumings, Mrs. John",female,38,71.2833,C85
3,1,"Heikkinen, Miss. Laina",female,26,7.925,
4,1,"Futrelle, Mrs. Jacques",female,35,53.1,C123
5,0,"Allen, Mr. William",male,,8.05,
6,0,"Moran, Mr. James",male,,8.4583,
"""


@pytest.fixture(scope="module")
def manifest(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "m.csv"
    path.write_text(MANIFEST)
    return readers.read_csv(spark, str(path)).cache()


@pytest.fixture(scope="module")
def report(manifest):
    return Profiler().profile(manifest, "m.csv")


def test_report(report):
    types = {n: a["data_type"] for n, a in report.column_analysis.items()}
    assert types == {"PassengerId": "numeric", "Survived": "numeric", "Name": "textual", "Sex": "textual", "Age": "numeric", "Fare": "numeric", "Cabin": "textual"}
    assert report.column_analysis["Age"]["null_count"] == 2
    assert report.errors == []
    assert report.metadata["row_count"] == 6
    s = report.summary
    assert s["total_checks"] == len(report.results)
    assert s["overall_score"] == pytest.approx(sum(points(r.status) for r in report.results) / len(report.results))
    assert s["grade"] == grade(s["overall_score"])
    order = [(r.columns, r.rule_id) for r in report.results if len(r.columns) == 1]
    assert [c for c, _ in order] == sorted((c for c, _ in order), key=lambda c: list(types).index(c[0]))
    ids = {r.rule_id for r in report.results if r.columns == ("Fare",)}
    assert {"numeric_stats", "null_analysis", "top_k_frequencies", "memory_usage_analysis"} <= ids
    assert "length_analysis" not in ids


def test_json(report, tmp_path, spark):
    sinks.save_json(report, str(tmp_path / "r.json"))
    back = json.loads((tmp_path / "r.json").read_text())
    assert set(back) == {"metadata", "summary", "column_analysis", "cross_column_analysis", "table_analysis", "errors"}
    stats = next(c for c in back["column_analysis"]["Fare"]["checks"] if c["rule_id"] == "numeric_stats")
    assert isinstance(stats["details"]["mean"], float)
    sinks.save_results(spark, report, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == len(report.results)
    assert plain({"a": math.nan, "b": [math.inf, 1.5], 3: {"x"}}) == {"a": None, "b": [None, 1.5], "3": ["x"]}


@pytest.mark.parametrize("fixture", ["empty", "one", "nulls", "odd"])
def test_awkward_tables(spark, fixture):
    df = {
        "empty": spark.createDataFrame([], "a long, b string"),
        "one": spark.createDataFrame([(1,), (2,)], "only long"),
        "nulls": spark.createDataFrame([(None, None), (None, None)], "a double, b string"),
        "odd": spark.createDataFrame([(math.inf, "a`b", [1, 2], {"k": 1}, True, b"x"), (math.nan, "ünï", [], {}, None, None), (-math.inf, "", None, None, False, b"")], "`x.y` double, `we``ird` string, arr array<int>, m map<string,int>, flag boolean, bin binary"),
    }[fixture]
    r = Profiler().profile(df)
    assert r.errors == []
    assert set(r.column_analysis) == set(df.columns)
    json.dumps(plain(r.summary))


def test_single_plan_equals_fused(manifest):
    from tablelens.operators import columns as C

    r = Profiler(ProfilingConfig(enable_cross_column=False)).profile(manifest)
    fused = next(x.details for x in r.results if x.rule_id == "numeric_stats" and x.columns == ("Fare",))
    alone = C.per_column(manifest, ["Fare"], C.numeric_stats).first().asDict()
    assert {k: v for k, v in alone.items() if k not in ("column", "status")} == pytest.approx(fused)


def test_custom_rules_and_isolation(manifest):
    reg = Registry()
    reg.add(Rule("share_of_a", "Share", column_types=("textual",), function=lambda c, kind: {"share": F.avg(c.contains("a").cast("int")), "status": F.lit("warning")}))
    reg.add(Rule("broken", "Broken", column_types=("numeric",), function=lambda c, kind: {"x": F.max(F.raise_error(F.lit("boom")).cast("string"))}))
    reg.add(Rule("both", "Both", category="table", function=lambda df: {"columns": len(df.columns), "status": "passed"}))
    reg.add(Rule("sum_ab", "Sum", category="cross_column", cross_column=True, function=lambda a, b: {"n": F.count_if(a.isNotNull() & b.isNotNull()), "status": F.lit("low")}))
    r = Profiler(registry=reg).profile(manifest)
    by = {}
    for x in r.results:
        by.setdefault(x.rule_id, []).append(x)
    assert {x.status for x in by["share_of_a"]} == {"warning"}
    assert {x.status for x in by["broken"]} == {"error"}
    assert {x.status for x in by["null_analysis"]} <= {"passed", "warning", "failed"}
    assert by["both"][0].details["columns"] == 7
    assert by["sum_ab"]


def test_sampling_and_options(manifest):
    r = Profiler(ProfilingConfig(sampling_threshold=5, sample_size=4)).profile(manifest)
    assert r.metadata["sampled"]
    assert r.column_analysis["Fare"]["total_count"] == 4
    assert not Profiler(ProfilingConfig(sampling_threshold=6)).profile(manifest.select("Fare")).metadata["sampled"]
    assert Profiler(ProfilingConfig(deepness_level="basic")).profile(manifest).cross_column_analysis == []
    enhanced = Profiler(ProfilingConfig(enhanced_statistics=True)).profile(manifest)
    assert {c["status"] for c in enhanced.cross_column_analysis if c["rule_id"] == "functional_dependency"} <= {"skipped"}
    assert Profiler(ProfilingConfig(deepness_level="auto", enable_cross_column=False)).profile(manifest).errors == []


def attribute(name, kind="numeric", diversity="medium", nulls=0, total=10, unique=5, data="bigint"):
    return ColumnAttributes(name, kind, diversity, "low", unique, total, nulls, data_type=data)


def test_pairs():
    attrs = [attribute("t", "textual", "low", data="string"), attribute("a"), attribute("b"), attribute("c", diversity="constant"), attribute("n", nulls=10)]
    assert pairs.column_pairs(attrs) == [("a", "b"), ("a", "t"), ("b", "t")]
    assert pairs.column_pairs(attrs, 1) == [("a", "b")]
    assert not pairs.compatible(attribute("x", diversity="binary"), attribute("y", diversity="distinctive"))
    assert pairs.rule_takes("correlation", attrs[1], attrs[2])
    assert not pairs.rule_takes("correlation", attrs[0], attrs[1])
    assert not pairs.rule_takes("missingness_relationships", attrs[0], attrs[1])


def test_registry(tmp_path):
    reg = Registry()
    assert len(reg.builtin) == 32
    rule = Rule("mine", "Mine", category="x", column_types=("numeric",), priority=RulePriority.HIGH, dependencies=("null_analysis",), parameters={"k": 1})
    reg.add(rule)
    assert reg.validate("mine")
    reg.add(Rule("self", "Self", dependencies=("self",)))
    assert not reg.validate("self")
    assert reg.by_category("x") == [rule]
    assert reg.statistics()["total_rules"] == 2
    path = str(tmp_path / "rules.json")
    reg.save(path)
    other = Registry()
    assert other.load(path) == 2
    assert other.get("mine") == rule
    assert reg.remove("mine")
    assert not reg.remove("mine")
    assert reg.remove("unique_count")
    assert reg.get("unique_count") is None
    a = attribute("a", diversity="high")
    assert registry.analysis_depth(a) == "deep"
    assert registry.analysis_depth(attribute("a", diversity="constant")) == "basic"
    assert "outlier_detection" in {r.id for r in Registry().relevant_at_depth(a)}
    assert "modality_estimation" not in {r.id for r in Registry().relevant_at_depth(a, depth="standard")}
    off = Registry()
    off.builtin["null_analysis"].enabled = False
    assert "null_analysis" not in {r.id for r in off.relevant(a)}
    assert "numeric" in registry.relevant_categories(a)


def test_insights(report, manifest):
    out = insights(report, manifest, "passenger", {"Sex": ["male"]})
    by = {c["name"]: c for c in out["columns"]}
    assert by["Fare"]["valueType"] == "continuous"
    assert by["Sex"]["valueType"] == "categorical"
    assert by["Fare"]["numeric"]["max"] == 71.2833
    assert by["Sex"]["topValues"][0] == {"value": "female", "count": 3, "ratio": 0.5}
    assert out["candidateKeys"][0]["columns"] == ["PassengerId"]
    assert out["primaryKeys"][0]["confidence"] >= 0.6
    assert value_type("numeric", 0.995, False) == "categorical"
    assert value_type("numeric", 0.7, False) == "continuous"
    assert value_type("unknown", None, False) is None
    assert all(len(c["columns"]) == 2 for c in out["crossColumn"])


def test_filters():
    cols = [{"name": "a", "type": "numeric", "valueType": "continuous"}, {"name": "b", "type": "textual", "valueType": "categorical"}, {"name": "c", "type": "unknown"}]
    names = lambda x: [c["name"] for c in x]
    assert names(filters.shown_columns(cols, {"continuous"}, {"numeric", "unknown"})) == ["a", "c"]
    assert filters.shown_columns(cols, set(), {"numeric"}) == []
    assert names(filters.matching_columns(cols, set(), set())) == ["a", "b", "c"]
    assert names(filters.matching_columns(cols, {"continuous"}, set())) == ["a"]
    assert filters.distinct_types(cols) == {"valueType": ["categorical", "continuous"], "type": ["numeric", "textual", "unknown"]}
    results = [{"status": s} for s in ("passed", "warning", "failed", "error", "high", "skipped")]
    assert len(filters.shown_results(results)) == 3
    assert filters.shown_level("warning") == "medium"


def test_jobs(spark, manifest):
    jobs = Jobs(spark)
    done = jobs.wait(jobs.start(lambda: manifest, "m"), 120)
    assert (done["status"], done["progress"]) == ("complete", 100)
    assert done["result"]["rowCount"] == 6
    failed = jobs.wait(jobs.start(lambda: 1 / 0), 60)
    assert failed["status"] == "error"
    gate = __import__("threading").Event()

    def slow():
        gate.wait(30)
        return manifest

    job = jobs.start(slow)
    assert jobs.cancel(job)
    gate.set()
    assert jobs.wait(job, 60)["status"] == "cancelled"
    assert jobs.get(job).result is None
    assert not jobs.cancel("none")
    assert jobs.status("none")["status"] == "not_found"


def test_log():
    log = Logger()
    log.set_stage("a")
    log.set_stage("b")
    log.warning("b", "careful")
    log.error("b", "bad", {"x": 1})
    assert [e["message"] for e in log.logs()] == ["Started a", "Completed a", "Started b", "careful", "bad"]
    assert len(log.latest(2)) == 2
    log.clear()
    assert log.logs() == []


def test_sources(spark, manifest, tmp_path):
    assert manifest.where("Name = 'Braund, Mr. Owen'").count() == 1
    with pytest.raises(ValueError, match="s3"):
        readers.read_object_csv(spark, "http://x/y.csv")
    manifest.createOrReplaceTempView("m_created_at")
    assert readers.run_query(spark, "  select count(*) as updated from m_created_at ; ").first()[0] == 6
    assert readers.run_query(spark, "with t as (select 1 as x) select x from t").first()[0] == 1
    for bad in ("drop table x", "create table x (a int)", "insert into x select 1", "", "show tables", "set a = b", "alter table x rename to y"):
        with pytest.raises(ValueError):
            readers.run_query(spark, bad)
    assert readers.partition_scan(manifest, {"Sex": ["male"], "PassengerId": ["1", "5"]}).count() == 2
    assert readers.partition_scan(manifest, {}, 3).count() == 3
    sql = readers.scan_sql("db.t", {"d": "date", "n": "int", "s": "string"}, {"d": ["2020-01-01"], "n": ["5", "x"], "s": ["o'k"], "z": []}, 10)
    assert sql["query"] == "SELECT * FROM `db`.`t` WHERE `d` IN (DATE '2020-01-01') AND `n` IN (5, CAST('x' AS int)) AND `s` IN ('o''k') LIMIT 10"
    assert sorted(sql["partitionsApplied"]) == ["d", "n", "s"]
    assert "spark_catalog" in readers.data_sources(spark)
    assert "default" in readers.databases(spark)
    spark.sql("create table if not exists by_sex (n int, sex string) using parquet partitioned by (sex)")
    spark.sql("insert into by_sex values (1, 'f'), (2, 'm')")
    assert "by_sex" in readers.tables(spark, "default")
    assert readers.partitions(spark, "by_sex") == {"keys": ["sex"], "values": {"sex": ["f", "m"]}}
    spark.sql("drop table by_sex")
    assert readers.catalogs(spark, "x") == ["x"]


def test_null_as_text(spark):
    df = spark.createDataFrame([("a",), (None,), ("bcd",), ("ef",)], "c string")
    plain_run = Profiler().profile(df)
    as_text = Profiler(ProfilingConfig(null_as_text=True)).profile(df)
    find = lambda r: next(x.details for x in r.results if x.rule_id == "length_analysis")
    assert find(plain_run)["non_null_count"] == 3
    assert find(as_text)["non_null_count"] == 4
