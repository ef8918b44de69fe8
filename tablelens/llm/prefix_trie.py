"""Conversation prefix trie: which turns conversations share from their start, and what sharing them saves.

A node is a distinct sequence of first turns (role and text); its members are the conversations that start with it.

1. Each turn becomes a 128-bit digest and a number of words, and gets its place in its conversation. Places are counted
   over ranges of all turns: a range counts on from what earlier ranges hold of its first conversation, so a
   conversation of any length is spread over tasks.
2. Conversations of equal turns are one class: a weight, the smallest id, and the digest of all ids.
3. Classes are dealt by the digest of their first turn. A task builds the tries of its first turns as dictionaries that
   point from node to node, each class one walk, and sums them up in a postorder without recursion.
4. A first turn whose classes have too many turns for a task is split before: what all its classes share is written as
   a chain of nodes, and the classes are dealt anew by the turn at which they part, as often as that takes. One
   class alone that is too long is a chain. The sums of the parts are added up from the last split to the first.

Sequences are told apart by 128 bits of digests. Ties of a turn number go by the digest of role and text. Nulls: a null
role or text is empty; null turn numbers come first; a row with a null conversation names none and is left out. Repeated
rows are turns of their own. An empty table has no node, not even the root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import WorkTables, only
from tablelens.llm.mixing import count_words

#: Turns of one first turn that a task takes: four even shares, within these bounds. Turns of a task.
LEAST, MOST, TASK = 1 << 9, 1 << 14, 1 << 16
#: Ids that are written out together.
IDS = 1 << 13
#: Conversation c takes up to crc32(c) mod HEADS turns from conversation c - c mod FAMILY.
HEADS, FAMILY = 4, 20
NOBODY = hashlib.sha256(b"").hexdigest()

_NODES = "key binary, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


# -- Running totals --------------------------------------------------------------------------------------------------


def running(tables: WorkTables, df: DataFrame, key: str, order: list[Column], value: str, total: str, tag: str) -> DataFrame:
    """``df`` with the total of ``value`` over the rows of a key up to each row, as ``total``, however many rows a key has.

    Rows are dealt by range of key and order; a range adds what earlier ones hold of its first key. ``df`` must give
    the same rows each time it is run.
    """
    dealt = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, {total} long, part int"

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys, n = b[key], b[value].to_numpy()
            new = np.concatenate([[keys[0].as_py() != last], pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)])
            sums = np.cumsum(n)
            # What stood before each run of a key goes off; the batch's first run may go on from the batch before.
            before = np.concatenate([[-held], (sums - n)[new]])
            sums = sums - before[np.cumsum(new)]
            last, held = keys[-1].as_py(), int(sums[-1])
            yield pa.record_batch([*b.columns, pa.array(sums, pa.int64())], names=[*b.schema.names, total])

    bare = schema.removesuffix(", part int")
    counted = tables.write(dealt.mapInArrow(count, bare).withColumn("part", F.spark_partition_id()), tag)
    pieces = counted.groupBy(key, "part").agg(F.max(total).alias("held"), F.min(total).alias("low"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row for each range: only the key that a range begins with can have begun before.
    pieces = pieces.withColumn("before", F.sum("held").over(before)).where("before is not null").select(key, "part", "before")
    return counted.join(F.broadcast(pieces), [key, "part"], "left").withColumn(total, F.col(total) + F.coalesce("before", F.lit(0))).drop("part", "before")


# -- Conversations ---------------------------------------------------------------------------------------------------


def turns_of(tables: WorkTables, df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, depth, digest, words) of every turn, depth from 1."""
    rows = only(df, conv, turn, role, text).where(F.col(conv).isNotNull())
    said, by = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(by).cast("string"), F.lit(":"), by, said)))
    rows = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), count_words(said).alias("words"), F.lit(1).cast("long").alias("one"))
    # The row's own number parts equal rows, of which one conversation may have many.
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("turn"), F.col("digest"), F.col("row")]
    return running(tables, rows, "conv_id", order, "one", "depth", "turns").select("conv_id", "depth", "digest", "words")


def rebuild(tables: WorkTables, turns: DataFrame, heads: int = HEADS, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and (conv_id) of all of them, turnless ones too.

    The first h turns come from the first conversation of the family, all others from the conversation itself.
    """
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    first = F.struct("depth", "digest", "words")
    # At most heads - 1 turns of a family's first conversation.
    given = turns.where((F.col("depth") < heads) & (F.col("conv_id") % family == 0)).groupBy("conv_id").agg(F.sort_array(F.collect_list(first)).alias("given"))
    convs = own.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("first"))
    convs = convs.join(given.withColumnRenamed("conv_id", "first"), "first", "left")
    convs = tables.write(convs.select("conv_id", "h", F.slice(F.coalesce("given", F.array()), F.lit(1), F.col("h").cast("int")).alias("given")), "rebuilt-heads")
    head = convs.select("conv_id", F.inline("given"))
    tail = turns.join(convs.select("conv_id", "h", F.size("given").alias("n_given")), "conv_id").where("depth > h")
    tail = tail.select("conv_id", (F.col("depth") - F.col("h") + F.col("n_given")).alias("depth"), "digest", "words")
    return tables.write(head.unionByName(tail), "rebuilt"), convs.select("conv_id")


def classes_of(tables: WorkTables, turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, weight, n_turns, first, ends): conversations of equal turns by their smallest id, with the digest of all ids."""
    x, y = F.xxhash64("digest", "depth"), F.xxhash64(F.lit("y"), "depth", "digest")
    sums = turns.groupBy("conv_id").agg(F.bit_xor(x).alias("x"), F.bit_xor(y).alias("y"), F.max("depth").alias("n_turns"), F.max(F.when(F.col("depth") == 1, F.col("digest"))).alias("first"))
    like = ["n_turns", "x", "y"]
    sums = convs.join(sums, "conv_id", "left").fillna(0, like)
    dealt = sums.repartitionByRange(*like, "conv_id").sortWithinPartitions(*like, "conv_id")
    joined = dealt.mapInArrow(_write_ids, "n_turns long, x long, y long, first binary, low long, n long, ids string")
    together = joined.repartition(*[F.col(c) for c in like]).sortWithinPartitions(*like, "low")
    return tables.write(together.mapInArrow(_digest_ids, "conv_id long, weight long, n_turns long, first binary, ends string"), "classes")


def _write_ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a class that lie together, in runs of at most ``IDS``, as decimal numbers with commas."""
    for b in batches:
        if not b.num_rows:
            continue
        ids = b["conv_id"].to_pylist()
        like = np.stack([b[c].to_numpy() for c in ("n_turns", "x", "y")], 1)
        cut = np.flatnonzero(np.append(True, (like[1:] != like[:-1]).any(1))).tolist()
        rows = [(a, min(z, a + IDS)) for s, z in zip(cut, [*cut[1:], len(ids)], strict=True) for a in range(s, z, IDS)]
        at = pa.array([a for a, _ in rows], pa.int64())
        yield pa.record_batch(
            [*[b[c].take(at) for c in ("n_turns", "x", "y", "first")], pa.array([ids[a] for a, _ in rows], pa.int64()), pa.array([z - a for a, z in rows], pa.int64()), pa.array([",".join(map(str, ids[a:z])) for a, z in rows], pa.string())],
            names=["n_turns", "x", "y", "first", "low", "n", "ids"],
        )


def _digest_ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each class: its runs of ids come in order, and only the state of the digest is held."""
    names = ["conv_id", "weight", "n_turns", "first", "ends"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    like, low, weight, first, digest = None, 0, 0, None, None
    for b in batches:
        out = []
        for row in b.to_pylist():
            now = (row["n_turns"], row["x"], row["y"])
            if now != like:
                if like is not None:
                    out.append((low, weight, like[0], first, digest.hexdigest()))
                like, low, weight, first, digest = now, row["low"], 0, row["first"], hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(row["ids"].encode())
            weight += row["n"]
        yield pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)
    if like is not None:
        yield pa.record_batch([pa.array([v], t) for v, t in zip((low, weight, like[0], first, digest.hexdigest()), types, strict=True)], names=names)


# -- Tries -----------------------------------------------------------------------------------------------------------


def tries(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of the tries of some first turns (keys), from the turns of their classes.

    ``base`` is the depth of a key's top node, ``up`` the id of the node above it.
    """
    rows = rows.sort_values(["key", "conv_id", "depth"], kind="stable")
    tops: dict[bytes, int] = {}
    kids: list[dict[bytes, int]] = []
    key, conv, depth, parent, n, words, ends = [], [], [], [], [], [], []
    walk, node = None, -1
    fields = (rows[c].tolist() for c in ("key", "conv_id", "depth", "digest", "words", "weight", "n_turns", "ends"))
    for k, c, d, digest, w, weight, n_turns, end in zip(*fields, strict=True):
        if walk != (k, c):
            walk, node = (k, c), -1
        pointers = tops if node < 0 else kids[node]
        name, above = (k if node < 0 else digest), node
        node = pointers.get(name, -1)
        if node < 0:
            # Classes come by ascending id, so the first to walk here has the smallest.
            node = pointers[name] = len(kids)
            kids.append({})
            for column, value in ((key, k), (conv, c), (depth, d), (parent, above), (n, 0), (words, w), (ends, NOBODY)):
                column.append(value)
        n[node] += weight
        if d == n_turns:
            ends[node] = end
    # A node is numbered after the one above it, so numbers in descending order visit children first.
    leaves, saved = [0] * len(kids), [0] * len(kids)
    for i in range(len(kids) - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        saved[i] += (n[i] - 1) * words[i]
        if parent[i] >= 0:
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
    up = dict(zip(rows["key"], rows["up"], strict=True))
    return pd.DataFrame({
        "key": key, "top": [p < 0 for p in parent], "conv_id": conv, "depth": depth, "parent_conv_id": [up[k] if p < 0 else conv[p] for k, p in zip(key, parent, strict=True)],
        "n_convs": n, "n_children": [len(x) for x in kids], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends,
    })


def _chain(tables: WorkTables, groups: DataFrame, paths: DataFrame, tag: str) -> DataFrame:
    """Nodes of unary chains: ``groups`` has key, conv_id (whose turns they are), up, base, stop, n_convs and what stands at the last node:
    n_children, n_leaves, below (tokens saved under it) and ends."""
    rows = paths.join(groups, "conv_id").where("depth between base and stop").withColumn("saves", (F.col("n_convs") - 1) * F.col("words"))
    rows = running(tables, rows.drop("digest", "words"), "key", [F.desc("depth")], "saves", "saved", tag)
    last = F.col("depth") == F.col("stop")
    return rows.select(
        "key", (F.col("depth") == F.col("base")).alias("top"), "conv_id", "depth", F.when(F.col("depth") == F.col("base"), F.col("up")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", (F.col("saved") + F.col("below")).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(F.lit(NOBODY)).alias("ends_sha256"),
    )


def _oversized(state: DataFrame, limit: int) -> DataFrame:
    """Groups of several classes with too many turns: their size, members and smallest id."""
    sizes = state.groupBy("key").agg(
        F.first("base").alias("base"), F.first("up").alias("up"), F.sum(F.col("n_turns") - F.col("base") + 1).alias("turns"), F.count(F.lit(1)).alias("n_classes"),
        F.sum("weight").alias("n_convs"), F.min("conv_id").alias("smallest"),
    )
    return sizes.where(F.col("turns") > limit)


def trie(tables: WorkTables, turns: DataFrame, convs: DataFrame, least: int = LEAST, most: int = MOST, task: int = TASK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    A part of the trie has more than ``least`` to ``most`` turns only if it is one class; a task takes about ``task``.
    """
    spark = turns.sparkSession
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    classes = classes_of(tables, turns, convs)
    about = classes.agg(F.min("conv_id").alias("low"), F.sum("weight").alias("n"), F.sum("n_turns").alias("turns")).first()
    if about["n"] is None:
        return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in columns))
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = min(most, max(least, 4 * about["turns"] // shares))
    paths = tables.write(turns.join(classes.where("n_turns > 0").select("conv_id"), "conv_id", "left_semi"), "paths")

    state = classes.where("n_turns > 0").select("conv_id", "weight", "n_turns", "ends", F.col("first").alias("key"), F.lit(1).cast("long").alias("base"), F.lit(about["low"]).cast("long").alias("up"))
    small, chains, splits = [], [], []
    while True:
        large = tables.write(_oversized(state, limit), "large")
        found = {r["alone"]: r["c"] for r in large.groupBy((F.col("n_classes") == 1).alias("alone")).agg(F.count(F.lit(1)).alias("c")).collect()}
        small.append(state.join(large.select("key"), "key", "left_anti") if found else state)
        if found.get(True):
            chains.append(state.join(large.where("n_classes = 1").select("key"), "key", "left_semi"))
        if not found.get(False):
            break
        large = large.where("n_classes > 1")
        inside = state.join(large.select("key", "n_classes"), "key")
        # The first depth at which classes differ, or one has ended; they part after the one before it.
        rows = paths.join(inside.select("conv_id", "key", "base", "n_classes"), "conv_id").where("depth > base")
        by_depth = rows.groupBy("key", "depth").agg(F.min("digest").alias("low"), F.max("digest").alias("high"), F.count(F.lit(1)).alias("c"), F.first("n_classes").alias("n"))
        part = by_depth.where("low <> high or c < n").groupBy("key").agg((F.min("depth") - 1).alias("stop"))
        split = tables.write(large.join(part, "key").select("key", "base", "up", "stop", "n_convs", F.col("smallest").alias("conv_id")), "split")
        inside = inside.select("conv_id", "weight", "n_turns", "ends", "key").join(split.select("key", "stop", F.col("conv_id").alias("up")), "key")
        ending = inside.where("n_turns = stop").select("key", "ends")
        next_turn = paths.select("conv_id", (F.col("depth") - 1).alias("stop"), "digest")
        state = inside.where("n_turns > stop").join(next_turn, ["conv_id", "stop"])
        state = tables.write(state.select(
            "conv_id", "weight", "n_turns", "ends", F.unhex(F.md5(F.concat("key", "digest"))).alias("key"), (F.col("stop") + 1).alias("base"), "up", F.col("key").alias("above")
        ), "parted")
        splits.append((split, ending, state.select(F.col("key"), "above").distinct()))
        state = state.drop("above")

    def every(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    # Hash partitions of first turns, each with as many turns as a task takes.
    parts = max(shares, math.ceil(about["turns"] / task))
    dealt = paths.join(every(small), "conv_id").where("depth >= base").withColumn("ends", F.when(F.col("depth") == F.col("n_turns"), F.col("ends")))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    nodes = [tables.write(dealt.groupBy("part").applyInPandas(tries, _NODES), "tries")]
    if chains:
        alone = every(chains).select("conv_id", "key", "up", "base", F.col("n_turns").alias("stop"), F.col("weight").alias("n_convs"), "ends", *[F.lit(v).cast("long").alias(c) for c, v in (("n_children", 0), ("n_leaves", 1), ("below", 0))])
        nodes.append(tables.write(_chain(tables, alone, paths, "alone"), "chains"))
    top = ["key", "n_leaves", "saved_tokens"]
    for split, ending, children in reversed(splits):
        sums = every(nodes).where("top").select(*top).join(children, "key").groupBy("above")
        sums = sums.agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"), F.count(F.lit(1)).alias("n_children")).withColumnRenamed("above", "key")
        shared = split.join(sums, "key").join(ending, "key", "left").withColumn("ends", F.coalesce("ends", F.lit(NOBODY)))
        nodes.append(tables.write(_chain(tables, shared, paths, "shared"), "shared-nodes"))
    whole = every(nodes)
    total = whole.where("top and depth = 1").agg(F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s")).first()
    silent = classes.where("n_turns = 0").select("ends").first()
    root = (about["low"], 0, None, about["n"], total["c"], total["l"] or 1, total["s"] or 0, silent["ends"] if silent else NOBODY)
    tables.discard_others(*nodes)
    return whole.select(*columns).unionByName(spark.createDataFrame([root], whole.select(*columns).schema))


def prefix_trie(df: DataFrame, heads: int = HEADS, family: int = FAMILY, **sizes: int) -> DataFrame:
    """The trie of the rebuilt conversations of a table of turns; without ``heads`` of the conversations as they are."""
    tables = WorkTables(df.sparkSession)
    turns = turns_of(tables, df)
    if not heads:
        return trie(tables, turns, turns.select("conv_id").distinct(), **sizes)
    return trie(tables, *rebuild(tables, turns, heads, family), **sizes)
