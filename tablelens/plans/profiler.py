"""The profiler: plans few jobs for many checks, runs them, and compiles the report.

Jobs of a full profile: value frequencies of all columns (one shuffle, kept); one aggregation for types and levels; one
for all single-aggregate checks of all columns, with the bounds that two-phase checks need; one for those; one for all
histograms; a few for nested and patterned text columns; and for pairs one aggregation for equality, one for
correlation and missingness, and one grouping of values for the rest. Aggregations are cut into chunks of bounded width.
A chunk that fails, or is stopped at the time limit if one is set, is run check by check, so one bad rule gives one
error result.
"""

from __future__ import annotations

import copy
import math
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions import exprs as X
from tablelens.operators import attributes as A
from tablelens.operators import columns as C
from tablelens.operators import discovery as D
from tablelens.operators import frequency as Q
from tablelens.operators import nested as N
from tablelens.operators import pairs as P
from tablelens.operators.quantiles import BUILT_IN, exact_quantiles
from tablelens.operators.regex_inference import infer_patterns
from tablelens.operators.sampling import pair_sample_size, sample, should_sample
from tablelens.operators.two_stage import may_stop_early
from tablelens.plans.pairs import column_pairs, rule_takes
from tablelens.plans.registry import Registry, analysis_depth
from tablelens.plans.report import compile_report, plain
from tablelens.plans.types import ColumnAttributes, ProfilingConfig, ProfilingResult, Rule, RuleResult, points

#: Columns in one aggregation of types and levels, columns in one grouping of bins, and pairs in one grouping.
LEVEL_CHUNK, COLUMN_CHUNK, PAIR_CHUNK = 4, 64, 32
#: Pairs with a wide column in one job.
WIDE_CHUNK = 128
_SIDES = "p int, total long, distinct_rows long, sample_size long, chi2 double, n_rows long, n_cols long, forward_unique long, forward_present long, reverse_unique long, reverse_present long"
#: Rows (key, type) of a dictionary column in its result, which says if there are more.
VALUE_TYPES = 1000
#: Over a bounded sample the time goes into planning, which threads share: fewer columns and pairs a job.
SMALL_COLUMNS, SMALL_WIDTH, SMALL_PAIRS = 3, 48, 16

_NESTED: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "array_length_analysis": N.array_lengths,
    "array_depth_analysis": lambda df, c: N.depths(df, c, "array"),
    "dictionary_key_analysis": N.key_summary,
    "dictionary_depth_analysis": lambda df, c: N.depths(df, c, "object"),
    "dictionary_schema_analysis": N.schema_summary,
}


def chunks(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


class Profiler:
    """Profiles DataFrames; ``registry`` takes custom rules, ``log`` gets the stages."""

    def __init__(self, config: ProfilingConfig | None = None, registry: Registry | None = None, log=None):
        from tablelens.streaming.log import Logger

        self.config, self.registry, self.log = config or ProfilingConfig(), registry or Registry(), log or Logger()
        #: The run reads a bounded sample; pairs beyond the most that are compared.
        self.small, self.left_out = False, 0

    # -- jobs --------------------------------------------------------------------------------------------------------

    def attributes(self, df: DataFrame, modes: dict[str, dict]) -> list[ColumnAttributes]:
        """modes: rows of ``frequency.most_common`` with counts, by column."""
        kinds = {f.name: f.dataType for f in df.schema}

        def part(names: list[str]) -> list[ColumnAttributes]:
            out = []
            unique = {n: modes[n]["unique"] if n in modes else 0 for n in names}
            made = [F.struct(*[v.alias(k) for k, v in A.attribute_fields(X.col(n), kinds[n], F.lit(unique[n])).items()]).alias(f"c{i}") for i, n in enumerate(names)]
            row = df.agg(*made).first()
            for i, n in enumerate(names):
                r, m = row[f"c{i}"], modes.get(n)
                out.append(ColumnAttributes(
                    n, r["type_category"], r["diversity"], r["nullability"], r["unique_count"], r["total_count"], r["null_count"], r["is_likely_index"],
                    r["fractional"], m and m["most_common_value"], m["frequency"] if m else 0, kinds[n].simpleString(),
                ))
            return out

        return [a for part_ in self._together(df.sparkSession, [lambda names=names: part(names) for names in chunks(df.columns, SMALL_COLUMNS if self.small else LEVEL_CHUNK)]) for a in part_]

    def _together(self, spark: SparkSession, tasks: list[Callable[[], Any]]) -> list[Any]:
        """Results of independent tasks, whose Spark jobs share the cluster; job groups are inherited."""
        if len(tasks) < 2:
            return [t() for t in tasks]
        inherit = inheritable_thread_target(spark)
        with ThreadPoolExecutor(min(2 * self.config.max_workers if self.small else self.config.max_workers, len(tasks))) as pool:
            return [f.result() for f in [pool.submit(inherit(t)) for t in tasks]]

    def fused(self, df: DataFrame, wanted: list[tuple[Any, dict[str, Column]]]) -> dict[Any, dict | Exception]:
        """Values of many sets of aggregates, in chunks; a failing chunk is run set by set."""
        parts: list[list[tuple[Any, dict[str, Column]]]] = []
        width = most = SMALL_WIDTH if self.small else C.CHUNK
        for item in wanted:
            if width + len(item[1]) > most:
                parts.append([])
                width = 0
            parts[-1].append(item)
            width += len(item[1])
        found = self._together(df.sparkSession, [lambda p=p: self._run(df, p) for p in parts])
        return {k: v for one in found for k, v in one.items()}

    def _run(self, df: DataFrame, part: list[tuple[Any, dict[str, Column]]]) -> dict[Any, dict | Exception]:
        try:
            row = self._timed(df, lambda: df.agg(*[F.struct(*[v.alias(k) for k, v in fields.items()]).alias(f"f{i}") for i, (_, fields) in enumerate(part)]).first())
            return {key: row[f"f{i}"].asDict(recursive=True) for i, (key, _) in enumerate(part)}
        except Exception as e:
            if len(part) == 1:
                return {part[0][0]: e}
            return {k: v for one in part for k, v in self._run(df, [one]).items()}

    def _timed(self, df: DataFrame, f: Callable[[], Any]) -> Any:
        """Run ``f``; its Spark jobs are cancelled after ``timeout_seconds``, if any. Jobs are told apart by a tag."""
        if self.config.timeout_seconds is None:
            return f()
        context, tag, late = df.sparkSession.sparkContext, f"tablelens-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(self.config.timeout_seconds, stop)
        context.addJobTag(tag)
        timer.start()
        try:
            return f()
        except Exception as e:
            if late.is_set():
                raise TimeoutError(f"stopped after {self.config.timeout_seconds} s") from e
            raise
        finally:
            timer.cancel()
            context.removeJobTag(tag)

    # -- columns -----------------------------------------------------------------------------------------------------

    def column_results(self, df: DataFrame, attrs: list[ColumnAttributes], freq: DataFrame, modes: dict[str, dict]) -> list[RuleResult]:
        kinds = {f.name: f.dataType for f in df.schema}
        every = {a.name: self._rules(a) for a in attrs}
        by_name = {a.name: a for a in attrs}
        heavy, found = self._discover(df, attrs, every)
        # Rules that go in two stages are in no other plan.
        plan = {n: [r for r in rules if r.id not in heavy.get(n, ())] for n, rules in every.items()}
        # Quantiles come from the kept frequencies; columns with very many values get theirs by narrowing, as the
        # built-in percentile gathers a column's distinct values in one task.
        numeric = [a for a in attrs if a.type_category == "numeric" and a.unique_count]
        many = [a.name for a in numeric if a.unique_count > BUILT_IN]
        few = {a.name: kinds[a.name] for a in numeric if a.unique_count <= BUILT_IN}
        known = {k: v for found in self._together(df.sparkSession, [lambda: exact_quantiles(df, many, list(C.QUANTILES)), lambda: Q.quantiles(freq, few, C.QUANTILES)]) for k, v in found.items()}
        needs: list[tuple[Any, dict[str, Column]]] = []
        for name, rules in plan.items():
            u = F.lit(by_name[name].unique_count)
            for r in rules:
                if r.function is not None:
                    needs.append(((name, r.id), self._custom(r, X.col(name), kinds[name])))
                elif r.id in C.SINGLE:
                    kind = kinds[name]
                    args = (X.col(name), kind, known.get(name)) if r.id == "numeric_stats" else (X.col(name), kind, u) if r.id in C.WITH_UNIQUE else (X.col(name), kind, self.config.literal_url) if r.id == "text_patterns" else (X.col(name), kind)
                    needs.append(((name, r.id), C.SINGLE[r.id](*args)))
                elif r.id == "numeric_histogram_quantiles":
                    needs.append(((name, r.id), C.quantiles(X.col(name), kinds[name], known.get(name))))
            if by_name[name].type_category == "numeric" and any(r.id in C.BOUNDED for r in rules):
                needs.append(((name, "_bounds"), C.bounds(X.col(name), kinds[name], known.get(name))))
        needs += [((n, r), D.confirm(X.col(n), kinds[n], r, found.get(n))) for n, rules in heavy.items() for r in rules]
        source = self._as_text(df, attrs)
        nested = [(n, r.id) for n, rules in plan.items() for r in rules if r.id in _NESTED or r.id == "array_element_type_analysis"]

        def phases() -> dict:
            first = self.fused(source, needs)
            return first | self._second_phase(df, plan, first)

        def one(key: tuple[str, str]) -> dict:
            return {key: self._guard(df, lambda: self._nested(df, *key))}

        tasks = [phases, lambda: self._from_frequencies(df, plan, freq, modes), *(lambda key=key: one(key) for key in nested)]
        got = {k: v for found in self._together(df.sparkSession, tasks) for k, v in found.items()}
        for n, rules in heavy.items():
            got |= {(n, r): D.conclude(r, found.get(n), got[n, r]) for r in rules if isinstance(got[n, r], dict)}
        patterned = [k for k, v in got.items() if k[1] not in heavy.get(k[0], ()) and k[1] == "text_patterns" and isinstance(v, dict)]
        open_ = [k for k in patterned if not got[k]["skip_regex_inference"]]
        inferred = dict(zip(open_, self._together(df.sparkSession, [lambda k=k: self._guard(df, lambda: {"p": infer_patterns(df, k[0])}) for k in open_]), strict=True))
        for k in patterned:
            found = inferred.get(k, {"p": []})
            got[k] = found if isinstance(found, Exception) else got[k] | {"inferred_patterns": [vars(p) for p in found["p"]]}
        out = []
        for name, rules in every.items():
            for r in rules:
                value = got.get((name, r.id), RuntimeError("the rule has no plan"))
                out.append(self._result(r, value, (name,)))
        return out

    def _rules(self, a: ColumnAttributes) -> list[Rule]:
        if self.config.deepness_level == "auto":
            return self.registry.relevant_at_depth(a, cross_column=False, depth=analysis_depth(a))
        return self.registry.relevant(a, cross_column=False)

    def _discover(self, df: DataFrame, attrs: list[ColumnAttributes], plan: dict[str, list[Rule]]) -> tuple[dict[str, list[str]], dict[str, dict]]:
        """By option: the rules of each column that go in two stages, and what one job over a sample shows for them."""
        total = attrs[0].total_count if attrs else 0
        if not self.config.two_stage:
            return {}, {}
        heavy = {n: D.two_stage_rules([r.id for r in rules if r.function is None], total, self.config.heavy_rule_threshold) for n, rules in plan.items()}
        heavy = {n: rules for n, rules in heavy.items() if rules}
        if not heavy:
            return {}, {}
        found = self._guard(df, lambda: D.found_by_column(D.discover(df, heavy, self.config.discovery_rows, self.config.random_seed, self.config.sample_key)))
        # Without a sample the rules go over all rows, as they would without the option.
        return ({}, {}) if isinstance(found, Exception) else (heavy, found)

    def _as_text(self, df: DataFrame, attrs: list[ColumnAttributes]) -> DataFrame:
        """By option, nulls of text columns count as the word that stands for them."""
        if not self.config.null_as_text:
            return df
        text = {a.name for a in attrs if a.type_category == "textual"}
        return df.select([F.coalesce(X.col(n), F.lit("nan")).alias(n) if n in text else X.col(n) for n in df.columns])

    @staticmethod
    def _custom(rule: Rule, *args) -> dict[str, Column]:
        try:
            return rule.function(*args)
        except Exception as e:
            return {"error": F.raise_error(F.lit(str(e)))}

    def _guard(self, df: DataFrame, f: Callable[[], dict]) -> dict | Exception:
        try:
            return self._timed(df, f)
        except Exception as e:
            return e

    def _nested(self, df: DataFrame, name: str, rule: str) -> dict:
        if rule == "array_element_type_analysis":
            rows = N.element_types(df, name).orderBy(F.desc("count"), "element_type").collect()
            total = sum(r["count"] for r in rows)
            return {
                "type_distribution": {r["element_type"]: r["count"] for r in rows}, "total_elements": total, "unique_types": len(rows),
                "most_common_type": rows[0]["element_type"] if rows else None, "status": "passed" if rows else "warning",
            }
        d = _NESTED[rule](df, name).first().asDict(recursive=True)
        if rule == "dictionary_schema_analysis":
            # The first rows by key; the whole table, which may have a row for each row of the data, is N.value_types.
            types, d["value_types"] = N.value_types(df, name), {}
            rows = types.orderBy("key", "value_type").limit(VALUE_TYPES + 1).collect()
            for r in rows[:VALUE_TYPES]:
                d["value_types"].setdefault(r["key"], {})[r["value_type"]] = r["count"]
            d["value_types_truncated"] = len(rows) > VALUE_TYPES
            d["value_type_keys"] = types.select("key").distinct().count() if d["value_types_truncated"] else len(d["value_types"])
        return d

    def _second_phase(self, df: DataFrame, plan: dict[str, list[Rule]], got: dict) -> dict:
        """Outliers in one aggregation, histograms and their peaks from one grouping of bins."""
        needs, bins, out = [], [], {}
        fields = ("n", "q1", "q3", "mean", "std")
        for name, rules in plan.items():
            b = got.get((name, "_bounds"))
            ids = {r.id for r in rules}
            if isinstance(b, Exception):
                # Without bounds none of these has a result.
                out |= {(name, r): b for r in C.BOUNDED if r in ids}
            if not isinstance(b, dict):
                continue
            lit = F.struct(*[F.lit(b[k]).cast("double").alias(k) for k in fields])
            if "outlier_detection" in ids:
                needs.append(((name, "outlier_detection"), C.outliers_iqr(X.col(name), lit)))
            if "outlier_detection_zscore" in ids:
                needs.append(((name, "outlier_detection_zscore"), C.outliers_zscore(X.col(name), lit)))
            if b["finite"]:
                if "numeric_histogram_quantiles" in ids:
                    bins.append((name, "h", min(20, max(5, int(math.sqrt(b["finite"])))), b))
                if "modality_estimation" in ids:
                    bins.append((name, "m", 20, b))
        out |= self.fused(df, needs)
        limits = {n: C.fences(got[n, "_bounds"]) for n, r in out if r == "outlier_detection" and isinstance(out[n, r], dict) and out[n, r]["outlier_count"]}
        for part in chunks(list(limits), COLUMN_CHUNK):
            rows = self._guard(df, lambda part=part: {"r": C.outlier_examples(df, {n: limits[n] for n in part}).orderBy("rank").collect()})
            for n in part:
                one = rows
                if isinstance(rows, Exception) and len(part) > 1:
                    one = self._guard(df, lambda n=n: {"r": C.outlier_examples(df, {n: limits[n]}).orderBy("rank").collect()})
                out[n, "outlier_detection"] = one if isinstance(one, Exception) else out[n, "outlier_detection"] | {"outlier_examples": [r["value"] for r in one["r"] if r["column"] == n]}
        counts: dict[tuple[str, str], list[int]] = {(n, k): [0] * size for n, k, size, _ in bins}
        for part in chunks(bins, COLUMN_CHUNK):
            cells = F.array(*[
                F.struct(F.lit(n).alias("name"), F.lit(k).alias("k"), C.histogram_bin(X.col(n), F.lit(b["lo"]).cast("double"), F.lit(b["hi"]).cast("double"), F.lit(size)).alias("bin"))
                for n, k, size, b in part
            ])
            for r in df.select(F.inline(cells)).where("bin is not null").groupBy("name", "k", "bin").agg(X.rows().alias("c")).collect():
                counts[r["name"], r["k"]][r["bin"] - 1] = r["c"]
        for n, k, size, b in bins:
            c = counts[n, k]
            if k == "m":
                out[n, "modality_estimation"] = _peaks(c)
            else:
                lo, hi = (b["lo"], b["hi"]) if b["hi"] > b["lo"] else (b["lo"] - 0.5, b["hi"] + 0.5)
                q = got.get((n, "numeric_histogram_quantiles"))
                if isinstance(q, dict):
                    edges = [lo + (hi - lo) * i / size for i in range(size + 1)]
                    out[n, "numeric_histogram_quantiles"] = {"quantiles": q, "histogram": {"counts": c, "edges": edges}, "status": "passed"}
        for name, rules in plan.items():
            if "modality_estimation" in {r.id for r in rules}:
                out.setdefault((name, "modality_estimation"), _peaks([]))
        return out

    def _from_frequencies(self, df: DataFrame, plan: dict[str, list[Rule]], freq: DataFrame, modes: dict[str, dict]) -> dict:
        known = {n: (m["total"], m["non_null"]) for n, m in modes.items()}
        own = ("column", "total", "non_null", "unique")
        empty = {"status": "warning", "message": "No data"}
        tables = {
            "most_common_value": lambda f: modes,
            "top_k_frequencies": lambda f: self._top(Q.top_values(f, known=known), known),
            "stability_entropy": lambda f: {r["column"]: r.asDict() for r in Q.entropy(f, known).collect()},
        }

        def one(rule: str) -> dict:
            names = [n for n, rules in plan.items() if rule in {r.id for r in rules}]
            rows = self._guard(freq, lambda: tables[rule](freq)) if names else {}
            if isinstance(rows, Exception) and len(names) > 1:
                # Column by column, so that only those that fail alone are errors.
                alone = {n: self._guard(freq, lambda n=n: tables[rule](freq.where(F.col("column") == n))) for n in names}
            else:
                alone = dict.fromkeys(names, rows)
            return {(n, rule): r if isinstance(r, Exception) else {k: v for k, v in r.get(n, empty).items() if k not in own} for n, r in alone.items()}

        out = {k: v for found in self._together(freq.sparkSession, [lambda r=r: one(r) for r in tables]) for k, v in found.items()}
        return self._whole_texts(df, out)

    def _whole_texts(self, df: DataFrame, results: dict) -> dict:
        """Long texts in place of the short forms by which they were counted, in all results by one job."""
        shown = [(n, v) for (n, _), r in results.items() if isinstance(r, dict) for v in [r.get("most_common_value"), r.get("most_common_non_null"), *(x["value"] for x in r.get("values", []))]]
        shown = [(n, v) for n, v in shown if Q.is_short_form(v)]
        if not shown:
            return results
        texts, late = self._guard(df, lambda: Q.whole_texts(df, shown)), {}
        if isinstance(texts, Exception):
            # Column by column, so that only those that fail alone are errors.
            alone = {n: self._guard(df, lambda n=n: Q.whole_texts(df, [x for x in shown if x[0] == n])) for n in sorted({n for n, _ in shown})}
            late = {n: t for n, t in alone.items() if isinstance(t, Exception)}
            texts = {k: v for t in alone.values() if isinstance(t, dict) for k, v in t.items()}
        results = {k: late.get(k[0], r) if k[1] in ("most_common_value", "top_k_frequencies") else r for k, r in results.items()}
        for (n, _), r in results.items():
            if isinstance(r, dict):
                r |= {k: texts.get((n, r[k]), r[k]) for k in ("most_common_value", "most_common_non_null") if k in r}
                for x in r.get("values", []):
                    x["value"] = texts.get((n, x["value"]), x["value"])
        return results

    @staticmethod
    def _top(values: DataFrame, known: dict[str, tuple[int, int]]) -> dict[str, dict]:
        """The ranked values by column, at most ten rows each, with what is beyond them."""
        out: dict[str, dict] = {}
        for r in sorted(values.collect(), key=lambda r: (r["column"], r["rank"])):
            out.setdefault(r["column"], {"values": []})["values"].append({k: r[k] for k in ("rank", "value", "count", "ratio")})
        for name, d in out.items():
            n = known[name][1]
            other = n - sum(v["count"] for v in d["values"])
            d |= {"other_count": other, "other_ratio": other / n if n else 0.0, "non_null_count": n, "status": "passed"}
        return out

    # -- pairs and the table -----------------------------------------------------------------------------------------

    def _rows_of(self, rule: str, total: int) -> int:
        """Rows that a pair rule looks at: all, unless pair sampling is switched on and the table is large."""
        if not self.config.pair_sampling or total <= self.config.pair_sampling_threshold:
            return total
        return min(total, pair_sample_size(rule, self.config.sample_size))

    def _sampled(self, df: DataFrame, rule: str, total: int) -> DataFrame:
        n = self._rows_of(rule, total)
        return df if n == total else sample(df, n, self.config.random_seed)

    def pair_results(self, df: DataFrame, attrs: list[ColumnAttributes]) -> list[RuleResult]:
        total = attrs[0].total_count if attrs else 0
        by_name = {a.name: a for a in attrs}
        pairs = column_pairs(attrs, None)
        self.left_out = max(0, len(pairs) - self.config.max_cross_column_pairs)
        pairs = pairs[: self.config.max_cross_column_pairs]
        rules = [r for r in self.registry.rules() if r.cross_column and r.enabled]
        if not pairs or not rules:
            return []
        kinds = {f.name: f.dataType for f in df.schema}
        simple = lambda n: not isinstance(kinds[n], T.MapType | T.VariantType)
        pairs = [(a, b) for a, b in pairs if simple(a) and simple(b)]
        got: dict = {}
        # Equal columns have equal counts of values and nulls and the same mode: only such pairs are read row by row.
        facts = {a.name: (kinds[a.name], a.unique_count, a.null_count, a.most_common_value, a.most_common_frequency) for a in attrs}
        may = [x for x in pairs if facts[x[0]] == facts[x[1]]]
        differ = {"identical": False, "identical_without_nulls": False, "skip_other_checks": False, "status": "low"}
        source = self._sampled(df, "identicality", total)
        early = self._guard(df, lambda: P.differ_first(source, may)) if self.config.early_exit and may_stop_early("identicality", total) else None
        if isinstance(early, dict):
            alike = {"identical": True, "identical_without_nulls": True, "skip_other_checks": True, "status": "high"}
            same = {(*x, "identicality"): dict(alike if equal else differ) for x, equal in early.items()}
        else:
            same = self.fused(source, [((a, b, "identicality"), P.identicality(X.col(a), X.col(b))) for a, b in may])
        got |= {(a, b, "identicality"): dict(differ) for a, b in pairs} | same
        left = [x for x in pairs if not (isinstance(got[*x, "identicality"], dict) and got[*x, "identicality"]["identical"])]
        takes = lambda r, a, b: rule_takes(r, by_name[a], by_name[b]) and (not self.config.strict_pair_types or _strict(r, by_name[a], by_name[b]))
        ids = {r.id for r in rules}
        whole = lambda n: by_name[n].null_count == 0
        correlated = [((a, b, "correlation"), P.correlation(X.col(a), X.col(b), whole(a) and whole(b))) for a, b in left if "correlation" in ids and takes("correlation", a, b)]
        missing = [((a, b, m), P.missingness(X.col(a), X.col(b))) for a, b in left if (m := "missingness_relationships") in ids and takes(m, a, b)]
        custom = [((a, b, r.id), self._custom(r, X.col(a), X.col(b))) for a, b in left for r in rules if r.function is not None]
        if self.config.pair_sampling and total > self.config.pair_sampling_threshold:
            parts = [(self._sampled(df, "correlation", total), correlated), (self._sampled(df, "missingness_relationships", total), missing), (self._sampled(df, "custom", total), custom)]
        else:
            parts = [(df, correlated + missing + custom)]
        for source, needs in parts:
            got |= self.fused(source, needs)
        grouped = ("functional_dependency", "composite_uniqueness", "categorical_association_cramers_v")

        known = {a.name: (a.unique_count, a.total_count - a.null_count) for a in attrs}
        levels = {a.name: a.unique_count + (a.null_count > 0) for a in attrs}
        most = {a.name: a.most_common_frequency for a in attrs}
        # What is known of the columns settles some pairs; others with a wide column go by its values. Neither is
        # exploded. What is known holds for all rows, so rules that look at a sample are left as they are.
        aside: set[tuple[str, str, str]] = set()
        wide: dict[str, list[tuple[str, str]]] = {}
        for rule, settle in (("composite_uniqueness", lambda x: P.settled_composite(x, known)), ("categorical_association_cramers_v", lambda x: P.settled_association(x, levels, total))):
            for x in left if rule in ids and self._rows_of(rule, total) == total else []:
                if not takes(rule, *x):
                    continue
                if (value := settle(x)) is not None:
                    got[*x, rule] = value
                    aside.add((*x, rule))
                elif max(levels[x[0]], levels[x[1]]) >= P.WIDE and not self.small:
                    wide.setdefault(rule, []).append(x)
                    aside.add((*x, rule))

        def by_wide_columns() -> dict:
            some = [x for x in left if any(x in w for w in wide.values())]
            found: dict = {}
            for part in chunks(some, WIDE_CHUNK):
                rows = self._guard(df, lambda part=part: {"r": P.with_sides(P.wide_sums(df, part, levels, total, most), part, known, levels).collect()})
                if isinstance(rows, Exception) and len(part) > 1:
                    # Pair by pair, so that only those that fail alone are errors.
                    rows = [(x, self._guard(df, lambda x=x: {"r": P.with_sides(P.wide_sums(df, [x], levels, total, most), [x], known, levels).collect()})) for x in part]
                else:
                    rows = [(part, rows)]
                for of, one in rows:
                    these = of if isinstance(of, list) else [of]
                    if isinstance(one, Exception):
                        found |= {(*x, rule): one for x in these for rule, w in wide.items() if x in w}
                        continue
                    sums = df.sparkSession.createDataFrame(one["r"], _SIDES)
                    for rule, table in (("composite_uniqueness", P.composites), ("categorical_association_cramers_v", P.strengths)):
                        found |= {(r["column1"], r["column2"], rule): r.asDict() for r in table(sums, these).collect() if (r["column1"], r["column2"]) in wide.get(rule, ())}
            return found

        def grouping(source: DataFrame, part: list[tuple[str, str]], only: tuple[str, ...]) -> dict:
            found: dict = {}
            failed: list[tuple[str, tuple[str, str]]] = []
            g = P.pair_groups(source, part).persist()
            # Dependencies look at repetitive columns only, whose groups are few; the others need one pass each.
            mine = {rule: [i for i, x in enumerate(part) if rule in ids and rule in only and takes(rule, *x) and (*x, rule) not in aside] for rule in grouped}
            of = lambda rule: g if len(mine[rule]) == len(part) else g.where(F.col("p").isin(mine[rule]))
            tables = {
                "functional_dependency": lambda: P.dependencies(P.pair_summary(of("functional_dependency")), part),
                "composite_uniqueness": lambda: P.composites(P.pair_totals(of("composite_uniqueness"), part, known), part),
                "categorical_association_cramers_v": lambda: P.associations(of("categorical_association_cramers_v"), part),
            }
            try:
                for rule, table in tables.items():
                    wanted = {part[i] for i in mine[rule]}
                    rows = self._guard(df, lambda table=table: {"r": table().collect()}) if wanted else {"r": []}
                    if isinstance(rows, Exception) and len(part) > 1:
                        failed += [(rule, x) for x in part if x in wanted]
                    elif isinstance(rows, Exception):
                        found |= {(a, b, rule): rows for a, b in wanted}
                    else:
                        found |= {(r["column1"], r["column2"], rule): r.asDict() for r in rows["r"] if (r["column1"], r["column2"]) in wanted}
            finally:
                g.unpersist()
            # Pair by pair, so that only those that fail alone are errors.
            for rule, x in failed:
                found |= grouping(source, [x], (rule,))
            return found

        # Each grouping reads its rows once, so rules that look at the same rows share it.
        by_rows: dict[int, list[str]] = {}
        for rule in grouped:
            by_rows.setdefault(self._rows_of(rule, total), []).append(rule)
        parts = []
        for same_rows in by_rows.values():
            some = [x for x in left if any(rule in ids and takes(rule, *x) and (*x, rule) not in aside for rule in same_rows)]
            parts += [(self._sampled(df, same_rows[0], total), part, tuple(same_rows)) for part in chunks(some, SMALL_PAIRS if self.small else PAIR_CHUNK)]
        for found in self._together(df.sparkSession, [by_wide_columns, *(lambda x=x: grouping(*x) for x in parts)]):
            got |= found
        if self.config.enhanced_statistics:
            for a, b in left:
                for rule, f in (("functional_dependency", P.functional_dependency_tested), ("categorical_association_cramers_v", P.cramers_v_tested)):
                    if (a, b, rule) in got:
                        go = P.should_proceed(df, a, b, rule)
                        got[a, b, rule] = self._guard(df, lambda f=f, a=a, b=b: f(df, a, b)) if go["should_proceed"] else {"status": "skipped", "message": go["reason"]}
        out = []
        for a, b in pairs:
            for r in rules:
                if (a, b, r.id) in got:
                    res = self._result(r, got[a, b, r.id], (a, b))
                    res.details["compared_columns"] = [a, b]
                    out.append(res)
        return out

    def table_results(self, df: DataFrame) -> list[RuleResult]:
        d = table_stats(df).first().asDict()
        rule = Rule("table_stats", "Table Statistics", category="table")
        out = [self._result(rule, d | {"status": "passed"}, ())]
        for r in self.registry.user.values():
            if r.category == "table" and r.function is not None:
                out.append(self._result(r, self._guard(df, lambda r=r: r.function(df)), ()))
        return out

    # -- the run -----------------------------------------------------------------------------------------------------

    def _result(self, rule: Rule, value: dict | Exception, columns: tuple[str, ...]) -> RuleResult:
        if isinstance(value, Exception):
            return RuleResult(rule.id, rule.name, "error", 0.0, f"{type(value).__name__}: {str(value)[:500]}", {}, category=rule.category, columns=columns)
        details = plain({k: v for k, v in value.items() if k not in ("status", "message", "column", "column1", "column2")})
        status = value.get("status") or "passed"
        return RuleResult(rule.id, rule.name, status, points(status), value.get("message") or f"{rule.name}: {status}", details, category=rule.category, columns=columns)

    def profile(self, df: DataFrame, filename: str | None = None) -> ProfilingResult:
        # What a run learns about its table stays with the run.
        return copy.copy(self)._profile(df, filename)

    def _profile(self, df: DataFrame, filename: str | None) -> ProfilingResult:
        began = time.time()
        self.log.set_stage("initialization")
        names = list(df.columns)
        df = X.normalise(df)
        limit = self.config.sampling_threshold
        total = df.count() if limit is not None or not names else None
        sampled = limit is not None and should_sample(total, limit)
        if sampled:
            # A bounded number of rows, read by every job.
            df, self.small = sample(df, self.config.sample_size, self.config.random_seed).persist(), True
        freq = Q.frequencies(df, names).persist() if names else None
        try:
            self.log.set_stage("analysis")
            modes = {r["column"]: r.asDict() for r in Q.most_common(freq, counts=True).collect()} if names else {}
            attrs = self.attributes(df, modes) if names else []
            if total is None:
                total = attrs[0].total_count
            pairs = self.config.enable_cross_column and self.config.deepness_level != "basic" and len(names) > 1
            self.log.set_stage("checks")
            columns, crossed, whole = self._together(df.sparkSession, [
                lambda: self.column_results(df, attrs, freq, modes) if names else [],
                lambda: self.pair_results(df, attrs) if pairs else [],
                lambda: self.table_results(df),
            ])
            texts = Q.whole_texts(df, [(a.name, a.most_common_value) for a in attrs])
            attrs = [replace(a, most_common_value=texts.get((a.name, a.most_common_value), a.most_common_value)) for a in attrs]
        finally:
            for kept in ([freq] if freq is not None else []) + ([df] if sampled else []):
                kept.unpersist()
        self.log.set_stage("compilation")
        return compile_report(attrs, columns, crossed, whole, total, sampled, filename, time.time() - began, self.config, self.left_out)


def _strict(rule: str, a: ColumnAttributes, b: ColumnAttributes) -> bool:
    """By option, association takes repetitive columns only."""
    repetitive = lambda x: x.diversity_level in ("binary", "low", "medium")
    return rule != "categorical_association_cramers_v" or (repetitive(a) and repetitive(b))


def _peaks(counts: list[int]) -> dict:
    """Peaks of a histogram that is smoothed by means of three bins, zeros beyond the ends."""
    if sum(counts) < 10:
        return {"peaks": 0, "modality": "unknown", "status": "warning"}
    padded = [0, *counts, 0]
    s = [sum(padded[i : i + 3]) / 3 for i in range(len(counts))]
    n = sum(1 for a, x, b in zip(s, s[1:], s[2:], strict=False) if x > a and x > b and x >= 0.1 * max(s))
    return {"peaks": n, "modality": "unimodal" if n <= 1 else "bimodal" if n == 2 else "multimodal", "status": "passed"}


def table_stats(df: DataFrame) -> DataFrame:
    """row_count, column_count, estimated_bytes, duplicate_rows.

    Rows are told apart by 128 bits: hashes of their values in either order, and of which ones are null. So what is
    shuffled for a row has one size, however many columns there are; n different rows are taken for fewer with
    probability n^2 / 2^129.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    # Hashes skip nulls inside nested values, so these go as text that keeps them.
    nested = T.ArrayType | T.StructType | T.MapType | T.VariantType
    cells = [F.to_json(X.col(n), {"ignoreNullFields": "false"}) if isinstance(kinds[n], nested) else X.col(n) for n in df.columns]
    width = sum((X.width_bytes(X.col(n), kinds[n]) for n in df.columns), F.lit(0)).cast("long")
    if not cells:
        return df.agg(X.rows().alias("row_count")).select("row_count", *[F.lit(0).cast("long").alias(n) for n in ("column_count", "estimated_bytes", "duplicate_rows")])
    # A null leaves a hash as it is, so which ones are null is hashed too.
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cells])
    hashed = df.select(F.xxhash64(nulls, *cells).alias("h"), F.xxhash64(*reversed(cells), nulls).alias("g"), width.alias("bytes"))
    g = hashed.groupBy("h", "g").agg(X.rows().alias("n"), F.sum("bytes").alias("bytes"))
    s = g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("estimated_bytes"), X.rows().alias("d"))
    return s.select("row_count", F.lit(len(cells)).cast("long").alias("column_count"), "estimated_bytes", (F.col("row_count") - F.col("d")).alias("duplicate_rows"))
