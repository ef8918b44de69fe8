"""Approximate nearest neighbours by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one. They are dealt
by hash to shards of about ``SHARD_BYTES``, so the number of shards follows from the memory of a task; each shard's
graph is built in one task and stored as flat neighbour arrays, one per layer, with its vectors. A block of queries is
searched in each shard and the shards' results are merged.

A graph grows by insertion: nodes join in batches that are small beside the graph; each finds its candidates by a beam
search in the graph of the nodes before it, and among the nearest of its own batch. The work of a shard grows with n log
n, and the search of a query with log n for each shard.

Only the ids that can matter are kept with a node: the ``keep`` smallest, as equal vectors tie and ties go to the smaller
id. An index made with ``keep`` answers searches for up to ``keep - 1`` neighbours (one place is for the query itself); a
search for more is refused.

A graph's nodes are cells: vectors whose components, at length 1, are equal when rounded to 2^-20. Graphs are searched in
single precision; then the members of every cell of the last beam that can still hold one of the nearest, by the error of
rounding, are scored in double precision on the original vectors. So near copies, which single precision can't put in
order, come in their true order, however many they are. Scores beyond 1 by rounding are 1; equal scores go by id.

Nulls: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows with a null
id. With fewer candidates than ``k`` all are returned. Rows that repeat an id and a vector count once. Empty tables give
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import materialise, only

#: Bytes of a shard: vectors in double precision, links and ids. A task holds one shard.
SHARD_BYTES = 64 << 20
DEGREE = 16
BUILD_WIDTH = 32
#: Nodes that join at once, never more than a quarter of the graph, and candidates taken from a node's own batch.
BATCH, BESIDE = 512, 16
SEARCH_WIDTH = 500
#: A search opens one node in this many of its beam at each step.
FAN = 16
#: Cells are this fine; likenesses of cells and of their members differ by less than this.
CELLS, ERROR = float(1 << 20), 2e-5
#: Queries that are searched at once in a task, and queries in a block.
TOGETHER, QUERY_BLOCK = 64, 16384


def usable(v: Column) -> Column:
    """The vector has components, all of them finite, and not all are zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


class Layer:
    """A layer of the graph: neighbours of each of its members, -1 in free places."""

    def __init__(self, n: int, members: np.ndarray, links: np.ndarray):
        self.members, self.links = members, links
        self.place = np.full(n, -1, np.int32)
        self.place[members] = np.arange(len(members), dtype=np.int32)
        self.used = (links >= 0).sum(1).astype(np.int32)


def _best(ids: np.ndarray, sims: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _apart(v: np.ndarray, cand: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's candidates, in falling likeness, those nearer to the node than to any kept one; then the nearest others."""
    among = np.matmul(v[cand], v[cand].transpose(0, 2, 1))
    there = cand >= 0
    kept, count = np.zeros(cand.shape, bool), np.zeros(len(cand), np.int32)
    closest = np.full(cand.shape, -np.inf, np.float32)
    for j in range(cand.shape[1]):
        ok = (closest[:, j] < sims[:, j]) & (count < most) & there[:, j]
        kept[:, j] = ok
        count += ok
        rows = np.flatnonzero(ok)
        closest[rows] = np.maximum(closest[rows], among[rows, j])
    order = np.argsort(np.where(there, ~kept, 2), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)


def _walk(v: np.ndarray, layer: Layer, q: np.ndarray, at: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each query's nearest node that steps to better neighbours reach from ``at``, and its likeness."""
    at, best, moving = at.copy(), best.copy(), np.arange(len(q))
    while len(moving):
        near = layer.links[layer.place[at[moving]]]
        sims = np.matmul(v[near], q[moving][:, :, None])[:, :, 0]
        sims[near < 0] = -np.inf
        top = sims.argmax(1)
        value = sims[np.arange(len(moving)), top]
        better = value > best[moving]
        rows = moving[better]
        at[rows], best[rows] = near[better, top[better]], value[better]
        moving = rows
    return at, best


def _beam(v: np.ndarray, layer: Layer, q: np.ndarray, at: np.ndarray, best: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, likeness) of the best ``width`` nodes found for each query, in no order, -1 in free places.

    All queries walk at once; a step opens the best unopened nodes of each beam. Nodes seen are remembered in a table of
    fixed size, which may forget some; these are weighed again but never enter a beam twice.
    """
    n, fan = len(q), max(1, width // FAN)
    slots = 1 << (width * 64 - 1).bit_length()
    beam, like, unopened = np.full((n, width), -1, np.int32), np.full((n, width), -np.inf, np.float32), np.zeros((n, width), bool)
    beam[:, 0], like[:, 0], unopened[:, 0] = at, best, True
    active = np.arange(n)
    seen = np.full(n * slots, -1, np.int32)
    seen[active * slots + (at & (slots - 1))] = at
    while len(active):
        live = like[active]
        todo = np.where(unopened[active], live, -np.inf)
        pick = np.argpartition(-todo, fan - 1, axis=1)[:, :fan]
        good = np.take_along_axis(todo, pick, 1) > -np.inf
        some = good.any(1)
        active, live, pick, good = active[some], live[some], pick[some], good[some]
        if not len(active):
            break
        unopened[active[:, None], pick] = False
        near = layer.links[layer.place[beam[active[:, None], pick]]]
        near[~good] = -1
        near = near.reshape(len(active), -1)
        spot = (near & (slots - 1)) + (active * slots)[:, None]
        flat = np.flatnonzero((seen[spot] != near) & (near >= 0))
        ids, r = near.ravel()[flat], flat // near.shape[1]
        seen[spot.ravel()[flat]] = ids
        s = np.einsum("kd,kd->k", v[ids], q[active[r]])
        ok = np.flatnonzero(s > live.min(1)[r])
        r, ids, s = r[ok], ids[ok], s[ok]
        new = np.zeros(len(r), bool)
        new[np.unique(r << 32 | ids, return_index=True)[1]] = True
        new &= ~(beam[active[r]] == ids[:, None]).any(1)
        r, ids, s = r[new], ids[new], s[new]
        if not len(r):
            continue
        rows, r, count = np.unique(r, return_inverse=True, return_counts=True)
        c = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        more, more_like = np.full((len(rows), count.max()), -1, np.int32), np.full((len(rows), count.max()), -np.inf, np.float32)
        more[r, c], more_like[r, c] = ids, s
        rows = active[rows]
        every = np.concatenate([like[rows], more_like], 1)
        order = np.argpartition(-every, width - 1, axis=1)[:, :width]
        like[rows] = np.take_along_axis(every, order, 1)
        beam[rows] = np.take_along_axis(np.concatenate([beam[rows], more], 1), order, 1)
        unopened[rows] = np.take_along_axis(np.concatenate([unopened[rows], more_like > -np.inf], 1), order, 1)
    return beam, like


def _attach(v: np.ndarray, layer: Layer, nodes: np.ndarray, cand: np.ndarray, sims: np.ndarray, keep: int) -> None:
    """Link new nodes with their candidates, both ways. A node whose places are full keeps the best ``keep`` by the same rule."""
    most, p = layer.links.shape[1], layer.place[nodes]
    layer.links[p, : cand.shape[1]] = cand
    layer.used[p] = (cand >= 0).sum(1)
    ok = cand.ravel() >= 0
    src, dst, s = np.repeat(nodes, cand.shape[1])[ok].astype(np.int32), cand.ravel()[ok], sims.ravel()[ok]
    # Nodes of one batch can choose each other; such a link is there already.
    own = np.minimum(np.searchsorted(nodes, dst), len(nodes) - 1)
    ok = (nodes[own] != dst) | ~(cand[own] == src[:, None]).any(1)
    src, dst, s = src[ok], dst[ok], s[ok]
    order = np.lexsort((-s, dst))
    src, dst, s = src[order], dst[order], s[order]
    targets, first, count = np.unique(dst, return_index=True, return_counts=True)
    of = np.repeat(np.arange(len(targets)), count)
    rank, tp = np.arange(len(dst)) - first[of], layer.place[targets]
    fits = layer.used[tp] + count <= most
    a = fits[of]
    layer.links[tp[of[a]], layer.used[tp[of[a]]] + rank[a]] = src[a]
    layer.used[tp[fits]] += count[fits].astype(np.int32)
    over = np.flatnonzero(~fits)
    if not len(over):
        return
    wide = int(min(count[over].max(), most))
    more, more_s = np.full((len(over), wide), -1, np.int32), np.full((len(over), wide), -np.inf, np.float32)
    row = np.full(len(targets), -1)
    row[over] = np.arange(len(over))
    b = ~fits[of] & (rank < wide)
    more[row[of[b]], rank[b]], more_s[row[of[b]], rank[b]] = src[b], s[b]
    tp, old = tp[over], layer.links[tp[over]]
    old_s = np.matmul(v[old], v[targets[over]][:, :, None])[:, :, 0]
    old_s[old < 0] = -np.inf
    both, both_s = np.concatenate([old, more], 1), np.concatenate([old_s, more_s], 1)
    both, both_s = _best(both, both_s, most + 8)
    got, _ = _apart(v, both, both_s, keep)
    layer.links[tp] = -1
    layer.links[tp, : got.shape[1]] = got
    layer.used[tp] = (got >= 0).sum(1)


def build_graph(v: np.ndarray, degree: int = DEGREE, width: int = BUILD_WIDTH) -> list[Layer]:
    """Layers of the graph over unit vectors, the lowest first; node 0 is on all of them, and searches begin there."""
    n = len(v)
    if not n:
        return []
    levels = np.minimum(np.random.default_rng(n).exponential(1 / math.log(degree), n).astype(int), 8)
    levels[0] = levels.max()
    layers = []
    for level in range(levels[0] + 1):
        members = np.flatnonzero(levels >= level).astype(np.int32)
        layers.append(Layer(n, members, np.full((len(members), degree * 5 // 2 if level == 0 else degree * 2), -1, np.int32)))
    lo = 1
    while lo < n:
        hi = min(n, lo + max(1, min(BATCH, lo // 4)))
        nodes, q = np.arange(lo, hi), v[lo:hi]
        at, best = np.zeros(len(q), np.int32), q @ v[0]
        within = q @ q.T
        np.fill_diagonal(within, -np.inf)
        for level in range(levels[0], -1, -1):
            layer = layers[level]
            mine, rest = np.flatnonzero(levels[lo:hi] >= level), np.flatnonzero(levels[lo:hi] < level)
            # Before the batch is linked, so that nodes of the batch are met as candidates beside it only.
            if len(rest):
                at[rest], best[rest] = _walk(v, layer, q[rest], at[rest], best[rest])
            if len(mine):
                found, like = _beam(v, layer, q[mine], at[mine], best[mine], width if level == 0 else degree)
                top = like.argmax(1)
                at[mine], best[mine] = found[np.arange(len(mine)), top], like[np.arange(len(mine)), top]
                side = within[np.ix_(mine, mine)]
                if b := min(BESIDE, len(mine) - 1):
                    near = np.argpartition(-side, b - 1, axis=1)[:, :b]
                    found = np.concatenate([found, nodes[mine][near].astype(np.int32)], 1)
                    like = np.concatenate([like, np.take_along_axis(side, near, 1)], 1)
                cand, sims = _apart(v, *_best(found, like, width if level == 0 else degree), degree)
                _attach(v, layer, nodes[mine], cand, sims, degree * 3 // 2 if level == 0 else degree)
        lo = hi
    return layers


def search(v: np.ndarray, layers: list[Layer], queries: np.ndarray, width: int = SEARCH_WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, likeness) of the best ``width`` nodes found for each query, -1 where there are fewer."""
    found = []
    for begin in range(0, len(queries), TOGETHER):
        q = queries[begin : begin + TOGETHER]
        at, best = np.zeros(len(q), np.int32), q @ v[0]
        for layer in layers[:0:-1]:
            at, best = _walk(v, layer, q, at, best)
        found.append(_beam(v, layers[0], q, at, best, width))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def packed(vectors: pa.Array) -> list[bytes | None]:
    """Each vector as the bytes of doubles; None for vectors that take no part."""
    out: list[bytes | None] = [None] * len(vectors)
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dim)
        # Null components become NaN.
        v = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        largest = np.abs(v).max(1)
        ok = np.isfinite(largest) & (largest > 0)
        # The sum with 0.0 makes one zero of two.
        for r, x in zip(rows[ok], v[ok] + 0.0, strict=True):
            out[r] = x.astype("<f8").tobytes()
    return out


def nodes_of(df: DataFrame, key: str, vector: str, keep: int) -> DataFrame:
    """vec (as bytes) and the ``keep`` smallest ids of every distinct vector; h is a hash of it."""

    def run(batches):
        for b in batches:
            # Only so many ids leave a batch, so a vector that many rows share gathers nowhere.
            held: dict[bytes, set[int]] = {}
            for i, x in zip(b.column(0).to_pylist(), packed(b.column(1)), strict=True):
                if i is None or x is None:
                    continue
                ids = held.setdefault(x, set())
                ids.add(i)
                if len(ids) > keep:
                    ids.remove(max(ids))
            vec, ids = [x for x, s in held.items() for _ in s], [i for s in held.values() for i in s]
            yield pa.record_batch({"vec": pa.array(vec, pa.binary()), "id": pa.array(ids, pa.int64())})

    d = only(df, key, vector).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    # One shuffle: grouping and ranks by (h, vec) find their rows where the hash has put them.
    d = d.mapInArrow(run, "vec binary, id long").withColumn("h", F.xxhash64("vec")).repartition("h").dropDuplicates(["h", "vec", "id"])
    rank = F.row_number().over(Window.partitionBy("h", "vec").orderBy("id"))
    return d.withColumn("r", rank).where(F.col("r") <= keep).groupBy("h", "vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1. Division by the largest component first keeps squares in range."""
    v = vectors / np.abs(vectors).max(1, keepdims=True)
    return v / np.sqrt((v**2).sum(1))[:, None]


def cells_of(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the vectors by cell, cells in the order of their first vectors; how many each has; the cells' own vectors."""
    at = np.round(_unit(vectors) * CELLS)
    _, first, cell, count = np.unique(at.astype(np.int32), axis=0, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(first)
    rank = np.empty(len(first), np.int64)
    rank[order] = np.arange(len(first))
    return np.argsort(rank[cell.ravel()], kind="stable"), count[order], (at[first[order]] / CELLS).astype(np.float32)


def cosines(vectors: np.ndarray, norms: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each vector and ``q`` in double precision, within -1 to 1. Sums go over one row each, so equal rows have equal scores."""
    own = np.sqrt((q**2).sum())
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        s = (vectors * q).sum(1) / (norms * own)
    # Where squares leave the range of doubles, the vectors are brought to a largest component of 1.
    far = ~((norms > 1e-100) & (norms < 1e100)) | ~(1e-100 < own < 1e100)
    if far.any():
        v, u = vectors[far] / np.abs(vectors[far]).max(1, keepdims=True), q / np.abs(q).max()
        s[far] = (v * u).sum(1) / (np.sqrt((v**2).sum(1)) * np.sqrt((u**2).sum()))
    return np.clip(s, -1.0, 1.0)


def build_index(df: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: int = 6, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The stored index: a row for each shard with ids, vectors, members, layers (flat arrays as bytes) and ``keep``."""
    nodes = materialise(nodes_of(df, key, vector, keep), "ann-nodes")
    size = nodes.agg(F.sum(F.octet_length("vec") + F.size("ids") * 8 + DEGREE * 10 + 16)).first()[0] or 0
    shards = max(1, math.ceil(size / shard_bytes))
    dealt = nodes.select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "h", "vec", "ids")
    kind = "shard int, n int, dim int, keep int, cells binary, ids binary, counts binary, vectors binary, members array<binary>, layers array<binary>"
    arrow = pa.schema([
        ("shard", pa.int32()), ("n", pa.int32()), ("dim", pa.int32()), ("keep", pa.int32()), ("cells", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()),
        ("vectors", pa.binary()), ("members", pa.list_(pa.binary())), ("layers", pa.list_(pa.binary())),
    ])

    def build(table: pa.Table) -> pa.Table:
        out = []
        # The hash is an order by chance that reruns repeat. Vectors of different lengths can't be compared: a graph for each.
        table = table.sort_by("h")
        lengths = pc.binary_length(table["vec"]).to_numpy() // 8
        for dim in np.unique(lengths):
            t = table.filter(pa.array(lengths == dim))
            vec, ids = np.frombuffer(b"".join(t["vec"].to_pylist()), "<f8").reshape(-1, dim), t["ids"].combine_chunks()
            order, members, cells = cells_of(vec)
            vec, ids = vec[order], ids.take(pa.array(order))
            layers = build_graph(cells)
            out.append({
                "shard": t["shard"][0].as_py(), "n": len(cells), "dim": int(dim), "keep": keep, "cells": members.astype("<i4").tobytes(), "ids": ids.flatten().to_numpy().astype("<i8").tobytes(),
                "counts": pc.list_value_length(ids).to_numpy().astype("<i4").tobytes(), "vectors": vec.tobytes(),
                "members": [x.members.astype("<i4").tobytes() for x in layers], "layers": [x.links.astype("<i4").tobytes() for x in layers],
            })
        return pa.Table.from_pylist(out, schema=arrow)

    return materialise(dealt.groupBy("shard").applyInArrow(build, kind), "ann-index")


def search_index(index: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, width: int = SEARCH_WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for every query, its own id left out.

    Queries go in blocks; each block meets each shard once, and each such task returns ``k`` rows a query.
    """
    about = index.agg(F.max("shard"), F.min("keep")).first()
    if about[1] is not None and about[1] < k + 1:
        raise ValueError(f"the index keeps {about[1]} ids of equal vectors, a search for {k} needs {k + 1}")
    shards = (about[0] or 0) + 1
    q = only(queries, key, vector).select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("vec"))
    q = q.where(F.col("query_id").isNotNull() & usable(F.col("vec")))
    q = materialise(q.withColumn("h", F.xxhash64("vec")).dropDuplicates(["query_id", "h", "vec"]).drop("h"), "ann-queries")
    blocks = max(1, math.ceil(q.count() / QUERY_BLOCK))
    number = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    asked = q.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), number.alias("block"), "query_id", "vec")
    dealt = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        got = {"query_id": [], "vec_id": [], "score": []}
        qid, qlen = right["query_id"].to_numpy(), pc.list_value_length(right["vec"]).to_numpy()
        for row in left.to_pylist() if len(right) else []:
            mine = np.flatnonzero(qlen == row["dim"])
            if not len(mine):
                continue
            vec, ids = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"]), np.frombuffer(row["ids"], "<i8")
            with np.errstate(over="ignore", under="ignore"):
                norms = np.sqrt((vec**2).sum(1))
            counts = np.frombuffer(row["counts"], "<i4")
            first = np.cumsum(counts) - counts
            held = np.frombuffer(row["cells"], "<i4")
            begin = np.cumsum(held) - held
            # Ids of a cell, and the vector that stands for it.
            many = np.add.reduceat(counts, begin)
            unit = (np.round(_unit(vec[begin]) * CELLS) / CELLS).astype(np.float32)
            members = [np.frombuffer(m, "<i4") for m in row["members"]]
            layers = [Layer(row["n"], m, np.frombuffer(x, "<i4").reshape(len(m), -1)) for m, x in zip(members, row["layers"], strict=True)]
            asked_vec = right["vec"].take(pa.array(mine)).combine_chunks().flatten().to_numpy().reshape(-1, row["dim"])
            beam, like = search(unit, layers, _unit(asked_vec).astype(np.float32), max(width, 2 * k))
            for r, i in enumerate(mine):
                order = np.argsort(-like[r], kind="stable")
                order = order[beam[r][order] >= 0]
                # The best cells with k ids besides the query's own, and all that may be as near as the last of them.
                enough = min(int(np.searchsorted(np.cumsum(many[beam[r][order]]), k + 1)), len(order) - 1)
                near = beam[r][order[like[r][order] >= like[r][order[enough]] - ERROR]]
                size = held[near]
                nodes = np.repeat(begin[near] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                score = cosines(vec[nodes], norms[nodes], asked_vec[r])
                # All their ids, but for the query's own.
                size = counts[nodes]
                at = np.repeat(first[nodes] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                found, s = ids[at], np.repeat(score, size)
                found, s = found[found != qid[i]], s[found != qid[i]]
                best = np.lexsort((found, -s))[:k]
                got["query_id"] += [int(qid[i])] * len(best)
                got["vec_id"] += found[best].tolist()
                got["score"] += s[best].tolist()
        return pa.table(got, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    hits = dealt.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(find, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
