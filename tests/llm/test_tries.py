"""Conversation prefix tries against one trie in memory."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tablelens.llm import prefix_trie
from tablelens.llm.oracle import OP12
from tests.llm.helpers import clashing

SCHEMA = "conv_id long, turn long, role string, text string"


def own_turns(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role or "", text or ""))
    return {c: [x[3:] for x in sorted(v)] for c, v in own.items()}


def plain(rows, heads=4):
    own = own_turns(rows)
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads if heads else 0
        built[c] = tuple((own.get(c - c % 20, [])[:h] if heads else []) + turns[h:])
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    kids = {k: [] for k in nodes}
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        words = len([w for w in (k[-1][1] if k else "").replace(" ", "x").split() if w])
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(nodes[k]) - 1) * words + sum(saved[x] for x in kids[k])
    ends = {k: ",".join(map(str, sorted(c for c in v if built[c] == k))) for k, v in nodes.items()}
    return sorted(
        (min(v), len(k), min(nodes[k[:-1]]) if k else None, len(v), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest())
        for k, v in nodes.items()
    )


def got(df, **kw):
    out = prefix_trie.prefix_trie(df, **kw)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, out.collect()))


def talk(seed, convs=120, depth=9):
    """Few different turns, so that conversations share a lot; copies, a long one, logs of one conversation as it grew."""
    rng = random.Random(seed)
    said = ["yes no", "", "why", "a b c d", "yes  no\tmaybe", None]
    rows = []
    for c in range(convs):
        rows += [(c, t, rng.choice(["user", "user", None]), rng.choice(said)) for t in range(rng.randrange(0, depth))]
    rows += [(200 + c, t, "user", f"same {t}") for c in range(40) for t in range(5)]
    rows += [(300, t, "user", f"long {t} words here") for t in range(300)]
    rows += [(320 + c, t, "user", f"long {t} words here") for c in (0, 7, 11) for t in range(290 + c)]
    rows += [(400 + c, t, "system", f"step {t}") for c in range(9) for t in range(c)]
    return rows


def awkward():
    rows = [(1, None, "user", "first"), (1, 0, "user", "second"), (1, 0, "user", "another"), (1, 0, "user", "another"), (1, None, None, None)]
    rows += [(None, 0, "user", "nobody"), (None, None, None, None), (23, 0, "user", "x " * 20000), (20, 0, "user", "head"), (25, 0, "ab", "c"), (26, 0, "a", "bc")]
    # Conversations of one turn that is replaced by nothing, as their family's first conversation is absent.
    return rows + [(c, 0, "user", "gone") for c in range(1001, 1020)] + [(-7, 0, "user", "below zero")]


@pytest.mark.parametrize("sizes", [{}, {"least": 40, "most": 40, "task": 50}, {"least": 3, "most": 3, "task": 3}])
def test_trie(spark, sizes):
    """Also with parts so small that first turns are split again and again and long conversations become chains."""
    rows = talk(4) if sizes.get("least") != 3 else talk(5, 15, 4)[:80]
    assert got(clashing(spark.createDataFrame(rows, SCHEMA).repartition(3)).withColumns({n: F.lit(1) for n in ("depth", "words", "one", "row", "part", "first")}), **sizes) == plain(rows)


def test_trie_of_whole_conversations(spark):
    rows = talk(6, 30) + awkward()
    assert got(spark.createDataFrame(rows, SCHEMA), heads=0, least=50, most=50) == plain(rows, 0)


def test_awkward_tables(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    assert got(df) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(OP12).fetchall()) == want
    assert got(df.limit(0)) == []
    assert got(spark.createDataFrame([(1003, 0, "user", "gone")], SCHEMA)) == plain([(1003, 0, "user", "gone")])


def test_ids_of_a_large_class(spark, monkeypatch):
    """Ids are written in runs, and the digest goes over all of them in order."""
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    rows = [(c, 0, "user", "hi") for c in range(1, 400) if zlib.crc32(str(c).encode()) % 4 == 0]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
