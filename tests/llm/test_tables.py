"""Operators on pages, conversations and vectors against plain models."""

import hashlib
import random
import time
from collections import Counter
from pathlib import Path
from urllib.parse import quote

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.llm import hnsw, quotation, url_filter, warc
from tablelens.llm.oracle import OP5
from tablelens.llm.queries import RULES

# -- URL filters -----------------------------------------------------------------------------------------------------

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return rest[:cut].translate(UPPER), tail[:end]


def rule_for(host, path):
    fits = [(r, v) for v, r in RULES for h, _, t in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + t)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_urls(spark):
    urls = [
        "http://A.Example.NET/en/1?x=/y", "https://example.net/en", "ftp://x.net", "http://net/", "http://a.example.com/de/9.html#f", "http://example.org/fr/", "http://b.org/fr/7", "no scheme", None,
        "", "http://", "://h/p", "http://h?x://y/z", "http://ü.org/É/FR", "http://notexample.com/de/1", "http://example.com/de/1://2", "http://x.com/" + "a/" * 3000, "http://x.com//en//1",
    ]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(None, "http://x.net/a", None)], "page_id long, url string, html string")
    got = url_filter.judge(df.withColumns({"key": F.lit(1), "host": F.lit("x"), "path": F.lit("y"), "n": F.lit(1)}), RULES).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path = split_url(urls[r["key"]] if r["key"] is not None else "http://x.net/a")
        rule, verdict = rule_for(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
    assert url_filter.judge(df.limit(0), RULES).count() == 0


def test_templates_carry_labels(spark):
    """A purely bad template is rejected beyond its labels; alike branches merge, unlike ones do not."""
    rules = [("block", f"h.com/bad{k}/1") for k in range(4)] + [("allow", "h.com/good/1")]
    rows = [f"http://h.com/bad{k}/{n}/x" for k in range(4) for n in (11, 12, 21, 22)] + [f"http://h.com/good/{n}/x" for n in (11, 21)] + ["http://other.com/bad0/21/x"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {rows[r["key"]]: r for r in url_filter.judge(df, rules).collect()}
    assert got["http://h.com/bad1/21/x"]["rule"] is None
    assert got["http://h.com/bad1/21/x"]["verdict"] == "block"
    assert got["http://h.com/bad1/21/x"]["template"] == got["http://h.com/bad3/22/x"]["template"]
    assert got["http://h.com/good/21/x"]["verdict"] == "allow"
    assert got["http://other.com/bad0/21/x"]["verdict"] == "allow"


def by_sql(spark, df, sql):
    """Rows of an oracle over ``df`` as the conversations."""
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toArrow())
    return con.sql(sql).fetchall()


# -- quotation linking -----------------------------------------------------------------------------------------------


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow does   it work?"),
        (1, 1, "assistant", "Like this.\n\nSecond part."),
        (1, 2, "user", "On Monday Ann wrote:\n> Like THIS.\nAnd then?"),
        (1, 3, "user", "> > Hello there.\n> > How does it work?\n> Second part.\nThanks"),
        (1, 4, "user", "> how does it work?\nStill no idea"),
        (1, 5, "user", "> And then?\n> nothing known\nNow I see"),
        (1, 6, "user", "> never said\nWhat?"),
        (2, 0, "user", "Like this."),
        (2, 1, None, None),
        (2, 1, None, None),
        (None, 0, "user", "alone"),
        (None, 1, "user", "> alone\nreply"),
        (3, None, "user", "> alone\nno turn"),
        (3, 1, "user", ">\n>>  \n"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotation.format_chat(df.withColumns({"level": F.lit(1), "unit": F.lit("u"), "block": F.lit(0)})).collect()
    assert len(got) == len(rows)
    at = {(r["conv_id"], r["turn"]): r for r in got}
    assert [at[1, t]["parent_turn"] for t in range(7)] == [None, None, 1, 1, 0, 2, None]
    assert [at[1, t]["root_turn"] for t in range(7)] == [0, 1, 1, 1, 0, 1, 6]
    assert [at[1, t]["depth"] for t in range(7)] == [0, 0, 1, 1, 1, 2, 0]
    assert at[1, 2]["content"] == "And then?"
    assert at[1, 3]["content"] == "Thanks"
    assert at[1, 0]["content"] == rows[0][3]
    assert at[None, 1]["parent_turn"] == 0
    assert at[3, None]["content"] == "no turn"
    assert at[3, 1]["content"] == ""
    assert at[1, 6]["n_quotes"] > 0
    assert at[1, 6]["n_linked"] == 0
    order = [r["turn"] for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: (r["root_turn"], r["turn"]))]
    assert order == [0, 4, 1, 2, 3, 5, 6]
    assert quotation.render(quotation.format_chat(df)).count() == len(rows)
    assert Counter(map(tuple, got)) == Counter(by_sql(spark, df, OP5))
    assert quotation.format_chat(df.limit(0)).count() == 0


def test_common_line_in_a_long_conversation(spark):
    """A line that repeats in every message links to the latest earlier one, over blocks of turns."""
    n = quotation.BLOCK + 20
    rows = [(1, t, "u", "> thanks\nthanks" if t in (5, n - 1) else "thanks") for t in (0, 1, 5, quotation.BLOCK - 1, n - 1)]
    got = {r["turn"]: r["parent_turn"] for r in quotation.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: None, 1: None, 5: 1, quotation.BLOCK - 1: None, n - 1: quotation.BLOCK - 1}


# -- WARC ------------------------------------------------------------------------------------------------------------


def page_rows():
    big = "<p>" + "ü" * 200 + "</p>"
    rows = [(9, "http://a/1", big), (4, "http://a/2", big), (7, None, big), (1, "u\r\nX: y", "short"), (2, "http://é/", "short"), (3, "", ""), (5, "x", None), (6, "z", "y" * 99), (8, "z", "y" * 99)]
    rows += [(20 + i, f"http://b/{i}", "z" * 100 if i % 3 else f"page {i} " * 3000) for i in range(30)] + [(99, "q", "W" * 3_000_000), (98, "r", "\r\n\r\nWARC/1.1\r\n" * 20)]
    return rows


def test_warc(spark):
    rows = page_rows()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(df.withColumns({"path": F.lit(1), "kind": F.lit("k"), "digest": F.lit("d")}).repartition(3)).collect()}
    assert len(got) == len(rows)
    first = {}
    for i, _, html in sorted(rows):
        first.setdefault(html or "", i)
    for i, url, html in rows:
        body, r = (html or "").encode(), got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
        again = len(body) >= 100 and first[html] != i
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[html]) if again else ("response", None))
        if url and url.isascii() and url.isprintable():
            assert r["target_uri"] == url
        elif url and not url.isascii():
            assert quote(url, safe=":/") in (quote(r["target_uri"], safe=":/"),)
    assert warc.round_trip(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a", "x" * 100), (1, "a", "x" * 100), (1, "a", "x" * 100)], df.schema)
    kinds = sorted((r["page_id"] or 0, r["record_type"]) for r in warc.round_trip(odd).collect())
    assert kinds == [(0, "revisit"), (1, "response"), (1, "response")]


def test_streams():
    """Whole-file streams and files of many members inflate alike; a cut stream is an error."""
    import gzip
    import io

    records = [warc.record(i, f"http://x/{i}", b"p" * (i * 1000), i * 1000, "d", "response", None) for i in range(50)]
    whole = gzip.compress(b"".join(records))
    members = b"".join(map(warc.member, records))
    for data in (whole, members):
        assert list(warc.split_records(warc.inflate(io.BytesIO(data)))) == records
    with pytest.raises((ValueError, EOFError)):
        list(warc.split_records(warc.inflate(io.BytesIO(whole[:-20]))))
    headers, payload = warc.parse_record(records[3])
    assert (headers["warc-type"], payload) == ("response", b"p" * 3000)


# -- neighbours ------------------------------------------------------------------------------------------------------


def exact(vectors, ids, q, k):
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    s = u @ u[q]
    order = sorted((j for j in range(len(ids)) if ids[j] != ids[q]), key=lambda j: (-round(s[j], 12), ids[j]))[:k]
    return [ids[j] for j in order], s


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    v = np.concatenate([centres[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 24)), np.tile(rng.normal(size=24), (300, 1))])
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    bad = [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [float("nan")] + [1.0] * 23), (5004, [float("inf")] + [1.0] * 23), (5005, [None] + [1.0] * 23), (None, [1.0] * 24), (0, rows[0][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({"shard": F.lit(1), "ids": F.lit(2), "node": F.lit(3)})
    index = hnsw.build_index(df, shard_bytes=200_000)
    assert 2 <= index.count() <= 4
    got = {}
    for r in hnsw.search_index(index, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 1800, 50))
    hits = 0
    for q, found in got.items():
        want, s = exact(v, np.arange(1800), q, 5)
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(abs(score - s[i]) < 1e-12 for _, i, score in found)
        if q >= 1500:
            assert [i for _, i, _ in found] == [i for i in range(1500, 1507) if i != q][:5]
        hits += len(set(want) & {i for _, i, _ in found})
    assert hits >= 0.95 * 5 * len(got)


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [2.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in hnsw.search_index(hnsw.build_index(df), df.where("vec_id % 50 = 0")).collect()]
    assert sorted(got) == [(0, 1, 50, 1.0), (0, 2, 3, 0.0), (50, 1, 0, 1.0), (50, 2, 3, 0.0)]
    empty = df.limit(0)
    assert hnsw.search_index(hnsw.build_index(empty), empty).count() == 0
    mixed = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 1.0])], df.schema)
    assert [r["vec_id"] for r in hnsw.search_index(hnsw.build_index(mixed), mixed.where("vec_id = 0")).collect()] == [2]


def test_graph_is_flat_and_linked():
    rng = random.Random(1)
    v = np.array([[rng.gauss(0, 1) for _ in range(8)] for _ in range(500)], np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    layers = hnsw.build_graph(v)
    links = layers[0].links
    assert links.shape == (500, hnsw.DEGREE * 5 // 2) and links.dtype == np.int32
    assert all(len({j for j in row if j >= 0}) == (row >= 0).sum() and i not in row for i, row in enumerate(links))
    seen, todo = {0}, [0]
    while todo:
        for j in links[todo.pop()]:
            if j >= 0 and j not in seen:
                seen.add(int(j))
                todo.append(int(j))
    assert len(seen) > 490


def test_equal_vectors_tie(spark):
    base = np.array([0.5, -1.25, 3.0, 0.125])
    rows = [(i, [float(x) for x in base * 2.0 ** (i % 3)]) for i in range(400)]
    df = spark.createDataFrame(rows + [(1000, [1.0, 1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = hnsw.search_index(hnsw.build_index(df), df.where("vec_id in (0, 300)")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, i) for i in (1, 2, 3, 4, 5)] + [(300, i) for i in range(5)]
    assert all(abs(r["score"] - 1) < 1e-12 for r in got)


@pytest.mark.parametrize("noise", [1e-2, 1e-3, 1e-4, 1e-6])
def test_recall_among_near_copies(spark, noise):
    """Families of copies that single precision can't put in order."""
    rng = np.random.default_rng(11)
    v = np.repeat(rng.normal(size=(20, 64)), 100, axis=0) + noise * rng.normal(size=(2000, 64))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    found = {}
    for r in hnsw.search_index(hnsw.build_index(df), df.where("vec_id % 50 = 0")).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert len(found) == 40
    norms = np.sqrt((v**2).sum(1))
    hits = 0
    for q, got in found.items():
        s = (v * v[q]).sum(1) / (norms * norms[q])
        s[q] = -2
        hits += len(set(np.argsort(-s, kind="stable")[:5].tolist()) & got)
    assert hits >= 0.95 * 5 * 40


def test_multiples_tie_by_their_scores(spark):
    """Vectors that point one way but for rounding: of the best score, the smallest ids."""
    base = np.random.default_rng(2).normal(size=16)
    v = np.array([(0.1 * (1 + i)) * base for i in range(400)])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    norms = np.sqrt((v**2).sum(1))
    for r in hnsw.search_index(hnsw.build_index(df), df.where("vec_id in (0, 300)")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("r")).collect():
        s = np.clip((v * v[r["query_id"]]).sum(1) / (norms * norms[r["query_id"]]), -1, 1)
        want = [i for i in np.lexsort((np.arange(400), -s)).tolist() if i != r["query_id"]][:5]
        assert [x["vec_id"] for x in r["r"]] == want
        assert [x["score"] for x in r["r"]] == s[want].tolist()


def test_cells():
    rng = np.random.default_rng(4)
    v = np.repeat(rng.normal(size=(7, 5)), 30, axis=0) * rng.uniform(0.1, 9, (210, 1))
    order, count, cells = hnsw.cells_of(v)
    assert sorted(order.tolist()) == list(range(210)) and count.sum() == 210 and len(count) == len(cells)
    assert 7 <= len(cells) < 210
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert np.abs(unit[order] - np.repeat(cells, count, axis=0)).max() <= 0.5 / hnsw.CELLS + 1e-9
    firsts = [order[i] for i in np.cumsum(count) - count]
    assert firsts == sorted(firsts)


def test_vectors_of_extreme_size(spark):
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 1e-300]), (2, [1.0, 0.0]), (3, [-1e200, 1e200]), (4, [5e-324, 5e-324])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], round(r["score"], 12)) for r in hnsw.search_index(hnsw.build_index(df), df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 1.0), (4, 1.0), (2, round(0.5**0.5, 12)), (3, 0.0)]


def test_search_beyond_what_the_index_keeps_is_refused(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        hnsw.search_index(hnsw.build_index(df), df.where("vec_id = 0"), k=10)
    assert hnsw.search_index(hnsw.build_index(df, keep=11), df.where("vec_id = 0"), k=10).count() == 10


@pytest.mark.skipif(not Path("/root/testdata/sf0.1/embeddings.parquet").exists(), reason="needs the driver's tables")
def test_recall_on_the_drivers_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    t = df.toPandas()
    v, ids = np.stack(t["embedding"].to_numpy()).astype(float), t["vec_id"].to_numpy()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    asked = df.where("vec_id % 50 = 0")
    found = {}
    for r in hnsw.search_index(hnsw.build_index(df), asked).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q, got in found.items():
        s = u @ u[ids == q][0]
        s[ids == q] = -2
        hits += len(got & set(ids[np.argsort(-s, kind="stable")[:5]]))
    assert len(found) == asked.count() and hits >= 0.95 * 5 * len(found)


def test_quotes_of_many_lines_are_linear(spark):
    """A message of 32,000 lines of alternating levels, and one passage of as many."""
    lines = "\n".join(f"{'>' * (1 + i % 2)} line {i}" for i in range(32_000))
    block = "\n".join(f"> part {i}" for i in range(32_000))
    rows = [(1, 0, "user", "\n".join(f"part {i}" for i in range(32_000))), (1, 1, "assistant", lines), (1, 2, "user", block)]
    parsed = quotation.parse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    began = time.time()
    units = quotation.quoted_units(parsed).groupBy("turn", "weight").count().collect()
    assert time.time() - began < 30
    assert {(r["turn"], r["weight"]): r["count"] for r in units} == {(1, 1): 32_000, (2, 1): 32_000, (2, 1000): 1}
    assert {(r["turn"], r["parent_turn"]) for r in quotation.link(parsed).collect()} == {(1, None), (2, 0)}
