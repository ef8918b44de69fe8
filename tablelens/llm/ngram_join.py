"""N-gram Jaccard join by R-trees over count vectors.

A document is the set of its distinct shingles. Shingles are hashed into groups, and the counts by group are the
document's point. The summed minima of two points' coordinates are an upper bound of the overlap of their sets, and of
a point and a node's largest coordinates one for all below the node. Pairs whose bound can reach the threshold are
verified on the sets themselves.

Which documents share an R-tree follows from an exact prefix filter. In one order of all shingles, rare ones first, two
sets of Jaccard similarity t share one of the first n - ceil(t n) + 1 shingles of each. So every such shingle has a tree
over the documents that have it among their first (shingles of about the same documents have one together), and every
link is a pair of some tree: none is missed. The order puts
the shingles that :func:`common_shingles` finds last; any order gives the same result, and this one keeps passages that
many documents share from making large trees.

1. Equal sets are one class before anything else.
2. In each tree the set with the fewest shingles of its own is paired with all others; these pairs, each once, are bounded, verified, and joined to
   components. A group of copies is settled here at about one verification a copy.
3. Trees whose members are not all connected by then are searched. Each member of a tree of more than one leaf offers
   the ``BEST`` members of other components with the highest bounds; trees of one leaf go pair by pair. The pairs, each
   once, are verified and joined to components.
4. In trees that are still not connected every pair of different components whose bound reaches the threshold is
   verified. A tree of more than ``PART`` members is cut into parts, and each pair of parts is a task that compares only
   across. So steps 2 and 3 only save work: no pair that can be a link is left out.

Nulls: a null or empty text, or one of white space, has the empty set and is linked with nothing. A null id is kept; a
component of null ids alone has a null component_id. Repeated rows and ids are classes by their sets. Empty tables give
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import materialise, only, release
from tablelens.llm.graph import components

WIDTH = 5
#: Jaccard similarity NUM / DEN or more is a link.
NUM, DEN = 75, 100
#: Shingles counted at once in search of common ones, the least count of one, and the most that are kept (the broadcast
#: is of 16 bytes each). They only order the prefix.
COUNTED, COMMON_LEAST, COMMON_MOST = 1 << 20, 8, 1 << 19
#: A shingle of more documents is dealt to several partitions.
SPLIT = 50_000
#: Pairs that a member of a large tree offers before all that are left are tried.
BEST = 2
#: Shingles of the sets that a verifying task holds, members of a tree's part, and of a leaf.
BLOCK_SHINGLES, PART, LEAF = 2_000_000, 1024, 32
_CACHE_WORDS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hash of each word, kept for later texts."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; of fewer words the whole sequence is one."""
    # On UTF-8 bytes, lower() changes A-Z alone and split() cuts at 0x20 and 0x09-0x0D alone.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, count=n)
    if n < width:
        acc = np.full(1, n, np.uint64)
        for x in h:
            acc = acc * _MIX + x
        return _finish(acc)
    acc = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        acc = acc * _MIX + h[k : n - width + 1 + k]
    return np.unique(_finish(acc))


def _runs(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[np.ndarray]:
    """Shingles of many texts together, in runs of about ``COUNTED``."""
    held, size = [], 0
    for b in batches:
        for t in map(pa.StringScalar.as_py, b.column(column)):
            held.append(shingles(t))
            size += len(held[-1])
            if size >= COUNTED:
                yield np.concatenate(held)
                held, size = [], 0
    if size:
        yield np.concatenate(held)


def common_shingles(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts share, sorted, and about how many texts: at most ``COMMON_MOST`` of them.

    Counts are summed over all texts; a shingle is left out of a run's count if the run has it once.
    """

    def run(batches):
        for x in _runs(batches, 0):
            keys, n = np.unique(x, return_counts=True)
            some = n > 1
            yield pa.record_batch({"k": pa.array(keys[some].view(np.int64)), "n": pa.array(n[some], pa.int64())})
        _WORDS.clear()
        release()

    counts = only(docs, text).select(F.col(text).cast("string").alias("text")).mapInArrow(run, "k long, n long")
    counts = materialise(counts.groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_LEAST), "common")
    # One row for each power of two.
    by_size = {r["b"]: r["c"] for r in counts.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()}
    least, total = 1 << 62, 0
    for b in sorted(by_size, reverse=True):
        total += by_size[b]
        if total > COMMON_MOST:
            break
        least = 1 << b
    got = counts.where(F.col("n") >= least).toArrow()
    keys, n = got["k"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def prefix(s: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The shingles of a set that come first in the order of (count as a common shingle, hash), as the bound asks for.

    Also the number of the set's shingles that are not common.
    """
    n = len(s) - -(-len(s) * NUM // DEN) + 1
    if not len(common):
        return s[:n], len(s)
    at = np.searchsorted(common, s)
    at[at == len(common)] = 0
    c = np.where(common[at] == s, counts[at], 0)
    return s[np.argsort(c, kind="stable")[:n]], int((c == 0).sum())


def point(s: np.ndarray) -> bytes:
    """Counts of the shingles by group; larger sets have more groups, always a power of two, and as wide numbers as it takes."""
    groups = min(8192, max(32, 1 << (len(s) // 2).bit_length()))
    c = np.bincount((s >> np.uint64(7)).astype(np.int64) & (groups - 1), minlength=groups)
    kind = "<u1" if c.max(initial=0) < 1 << 8 else "<u2" if c.max() < 1 << 16 else "<u4"
    return bytes([int(kind[2])]) + c.astype(kind).tobytes()


def counts_of(p: bytes, groups: int | None = None) -> np.ndarray:
    """The counts of a point, by option in as few groups as another point has."""
    c = np.frombuffer(p, f"<u{p[0]}", offset=1)
    return c if groups is None or groups == len(c) else c.reshape(-1, groups).sum(0, dtype=np.int64)


def may_link(p: bytes, n: int, q: bytes, m: int) -> bool:
    """Whether sets of sizes n and m with these points can have the wanted similarity."""
    if n * DEN < m * NUM or m * DEN < n * NUM:
        return False
    a, b = counts_of(p), counts_of(q)
    if len(a) != len(b):
        groups = min(len(a), len(b))
        a, b = counts_of(p, groups), counts_of(q, groups)
    return int(np.minimum(a, b).sum(dtype=np.int64)) * (NUM + DEN) >= NUM * (n + m)


def sets_of(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, mark (a hash of the text), n (set size), own (shingles that are not common), cls (digest of the set), keys (the
    prefix) and point of every document.

    By option also the digest of the text.
    """
    more = ["digest"] if digest else []
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        known, counts = shared.value
        for b in batches:
            n, own, cls, keys, points = [], [], [], [], []
            for t in map(pa.StringScalar.as_py, b.column(1)):
                s = shingles(t)
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                first, alone = prefix(s, known, counts)
                own.append(alone)
                keys.append(first.view(np.int64) if len(s) else None)
                points.append(point(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(own, pa.int64()), pa.array(cls, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(points, pa.binary()), *b.columns[3:]],
                names=["doc_id", "mark", "n", "own", "cls", "keys", "point", *more],
            )
        _WORDS.clear()
        release()

    d = only(docs, key, text).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    d = d.withColumn("mark", F.xxhash64("text"))
    if digest:
        d = d.withColumn("digest", F.md5("text"))
    return d.mapInArrow(run, ", ".join(["doc_id long, mark long, n long, own long, cls binary, keys array<long>, point binary", *(f"{x} string" for x in more)]))


class Tree:
    """An R-tree over count vectors, bulk-loaded by set size; nodes hold their largest coordinates and size bounds."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.levels = []
        top, lo, hi = points, sizes, sizes
        while len(top) > LEAF:
            cuts = np.arange(0, len(top), LEAF)
            top, lo, hi = np.maximum.reduceat(top, cuts), np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts)
            self.levels.append((top, lo, hi))

    def near(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Places, others than ``i``, whose set may have the wanted similarity with that of place ``i``, and the bounds of the overlaps."""
        p, n = self.points[i], int(self.sizes[i])
        at = None
        for top, lo, hi in reversed(self.levels):
            at = np.arange(len(top)) if at is None else _children(at, len(top))
            # The overlap must be NUM (n + m) / (NUM + DEN) or more, at least for the smallest set below the node.
            ok = (hi[at] * DEN >= n * NUM) & (lo[at] * NUM <= n * DEN)
            at = at[ok]
            bound = np.minimum(top[at], p).sum(1, dtype=np.int64)
            at = at[bound * (NUM + DEN) >= NUM * (n + np.maximum(lo[at], -(-n * NUM // DEN)))]
        at = np.arange(len(self.points)) if at is None else _children(at, len(self.points))
        at = at[at != i]
        at = at[(self.sizes[at] * DEN >= n * NUM) & (self.sizes[at] * NUM <= n * DEN)]
        bound = np.minimum(self.points[at], p).sum(1, dtype=np.int64)
        ok = bound * (NUM + DEN) >= NUM * (n + self.sizes[at])
        return at[ok], bound[ok]


def _children(at: np.ndarray, n: int) -> np.ndarray:
    c = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
    return c[c < n]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return both * DEN >= NUM * (len(a) + len(b) - both)


def tree_pairs(points: list[bytes], sizes: np.ndarray, comps: list, parts: np.ndarray, across: bool, best: int | None = None) -> Iterator[tuple[int, int]]:
    """Pairs of different components whose bound reaches the threshold; ``across`` leaves out pairs of one part.

    With ``best`` only so many pairs for each member, those of the highest bounds for their sizes.
    """
    order = np.argsort(sizes, kind="stable")
    groups = np.array([(len(points[i]) - 1) // points[i][0] for i in order])
    names = {c: k for k, c in enumerate(dict.fromkeys(comps))}
    comp = np.array([names[comps[i]] for i in order])
    # Points of one tree have equal groups. Sets that can be linked have as many groups, or one has twice as many.
    for g in np.unique(groups):
        mine = np.flatnonzero((groups == g) | (groups == 2 * g))
        tree = Tree(np.stack([counts_of(points[order[i]], int(g)) for i in mine]).astype(np.int64), sizes[order[mine]])
        own, c, part = groups[mine] == g, comp[mine], parts[order[mine]]
        # The members of the largest component are found by the others.
        most = np.bincount(c).argmax()
        for r in np.flatnonzero(c != most):
            near, bound = tree.near(r)
            ok = (c[near] != c[r]) & (own[near] | own[r])
            if across:
                ok &= part[near] != part[r]
            near, bound = near[ok], bound[ok]
            if best is None:
                near = near[(near < r) | (c[near] == most)]
            elif len(near) > best:
                near = near[np.argsort(-bound / (tree.sizes[near] + tree.sizes[r]), kind="stable")[:best]]
            for j in near:
                yield int(order[mine[min(j, r)]]), int(order[mine[max(j, r)]])


def _ordered(rows: DataFrame, *by: str) -> DataFrame:
    return rows.repartition(by[0]).sortWithinPartitions(*by)


def _stars(rows: DataFrame, split: dict[int, int]) -> DataFrame:
    """(k, n, own, cls, m, head) of every row (k, n, own, cls) whose k has several: head, of size m, is the first of the k.

    First is the set with the fewest shingles that are not common: among copies the one that the others are copies of, as
    each edit makes shingles of its own. ``split`` names the k that stand for a part of another one; the first row of each
    such part comes with the other k and without a head.
    """
    names = ["k", "n", "own", "cls", "m", "head"]

    def run(batches):
        last, sent = None, False
        for b in batches:
            carried = last is not None
            if carried:
                b = pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(last.columns, b.columns, strict=True)], schema=b.schema)
            if not len(b):
                continue
            k, place = b.column(0).to_numpy(), np.arange(len(b))
            start = np.concatenate([[True], k[1:] != k[:-1]])
            first = np.maximum.accumulate(np.where(start, place, 0))
            # A head is sent with its first follower, so once; the row that is carried over may have been sent before.
            followed = np.zeros(len(k), bool)
            followed[first[~start]] = True
            out = np.flatnonzero(~start | (followed & ~((place == 0) & carried & sent)))
            of, heads = b.take(pa.array(out)), b.take(pa.array(first[out]))
            whole = pa.array([split.get(x, x) for x in k[out].tolist()], pa.int64()) if split else of.column(0)
            yield pa.RecordBatch.from_arrays([whole, *of.columns[1:], heads.column(1), heads.column(3)], names=names)
            if split:
                new = np.flatnonzero(start & ~((place == 0) & carried))
                new = new[np.array([x in split for x in k[new].tolist()], bool)]
                of = b.take(pa.array(new))
                whole = pa.array([split[x] for x in k[new].tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([whole, *of.columns[1:], pa.nulls(len(new), pa.int64()), pa.nulls(len(new), pa.binary())], names=names)
            i = int(first[-1])
            last, sent = b.slice(i, 1), bool(followed[i]) or (i == 0 and carried and sent)

    return _ordered(rows.select("k", "n", "own", "cls"), "k", "own", "n", "cls").mapInArrow(run, "k long, n long, own long, cls binary, m long, head binary")


def shared_rows(classes: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The stars of all prefix shingles, k, n, own, cls, m, head and tree, written. Shingles of very many documents are dealt in parts first."""
    keyed = classes.select(F.explode("keys").alias("k"), "n", "own", "cls")
    large = common[1] > SPLIT
    parts = {int(k): int(c // SPLIT + 1) for k, c in zip(common[0][large].view(np.int64), common[1][large], strict=True)}
    split: dict[int, int] = {}
    if parts:
        names = {k: [xxhash.xxh3_64_intdigest(f"{k}:{i}") - (1 << 63) for i in range(n)] for k, n in parts.items()}
        split = {x: k for k, of in names.items() for x in of}
        cells = [x for k, of in names.items() for x in (F.lit(k), F.array(*[F.lit(v) for v in of]))]
        of = F.element_at(F.create_map(*cells), F.col("k"))
        keyed = keyed.select(F.coalesce(F.get(of, F.pmod(F.xxhash64("cls"), F.size(of)).cast("int")), F.col("k")).alias("k"), "n", "own", "cls")
    stars = materialise(_stars(keyed, split), "stars")
    if not split:
        return stars.withColumn("tree", F.col("head"))
    # The heads of the parts of a shingle make one more star, whose head names the tree of all parts.
    above = materialise(_stars(stars.where("head is null"), {}), "stars")
    whole = above.select(F.col("k").alias("of"), F.col("cls").alias("part_head"), F.col("head").alias("tree")).distinct()
    below = stars.where("head is not null").join(whole, F.expr("k = of and head = part_head"), "left")
    below = below.select("k", "n", "own", "cls", "m", "head", F.coalesce("tree", "head").alias("tree"))
    return materialise(below.unionByName(above.withColumn("tree", F.col("head"))), "stars")


def bounded(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, m, b, n) whose points can reach the threshold."""

    def run(batches):
        for b in batches:
            m, n = b.column(1).to_pylist(), b.column(3).to_pylist()
            ok = [may_link(p.as_py(), x, q.as_py(), y) for p, x, q, y in zip(b.column(4), m, b.column(5), n, strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:4], names=["a", "m", "b", "n"]).filter(pa.array(ok, pa.bool_()))

    p, q = reps.select(F.col("cls").alias("a"), F.col("point").alias("p")), reps.select(F.col("cls").alias("b"), F.col("point").alias("q"))
    return pairs.join(p, "a").join(q, "b").select("a", "m", "b", "n", "p", "q").mapInArrow(run, "a binary, m long, b binary, n long")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """The pairs (a, b) whose sets have the wanted similarity, written. A task holds the set of one a and some of its b."""
    pairs = materialise(pairs, "candidates")
    load = pairs.groupBy("a").agg(F.sum("n").alias("s")).where(F.col("s") > BLOCK_SHINGLES).select("a", F.ceil(F.col("s") / BLOCK_SHINGLES).cast("int").alias("chunks"))
    load = materialise(load, "large-stars")
    placed = pairs.join(load, "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("chunks", F.lit(1))).cast("int").alias("chunk"), "b")
    placed = materialise(placed, "placed")
    wanted = placed.select("a", "chunk", F.col("b").alias("cls")).unionByName(placed.select("a", "chunk", F.col("a").alias("cls")).distinct())
    # A text of each class: that of its first row, found by id and hash. Copies of a row are equal in both and count once.
    chosen = reps.select("cls", "row").join(placed.select(F.col("a").alias("cls")).unionByName(placed.select(F.col("b").alias("cls"))).distinct(), "cls", "left_semi").alias("c")
    t = only(docs, key, text).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("mark", F.xxhash64("text")).alias("t")
    bodies = t.join(chosen, F.expr("t.doc_id <=> c.row.doc_id and t.mark = c.row.mark")).select("c.cls", "t.text").dropDuplicates(["cls"])
    tasks = wanted.join(bodies, "cls").select("a", "chunk", "cls", "text")

    def run(table: pa.Table) -> pa.Table:
        lead, found = table["a"][0].as_py(), []
        sets = {c.as_py(): shingles(x.as_py()) for c, x in zip(table["cls"], table["text"], strict=True)}
        found = [c for c, s in sets.items() if c != lead and similar(sets[lead], s)]
        return pa.table({"a": pa.array([lead] * len(found), pa.binary()), "b": pa.array(found, pa.binary())})

    return materialise(tasks.groupBy("a", "chunk").applyInArrow(run, "a binary, b binary"), "links")


def _leaf_pairs(rows: DataFrame) -> DataFrame:
    """(a, m, b, n) of every pair of different components in trees of one leaf, rows (k, n, cls, c)."""

    def run(batches):
        held = None
        for b in batches:
            if held is not None:
                b = pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(held.columns, b.columns, strict=True)], schema=b.schema)
            if not len(b):
                continue
            k, n = b.column(0).dictionary_encode().indices.to_numpy(), b.column(1).to_numpy()
            cls, comp = np.array(b.column(2).to_pylist(), object), np.array(b.column(3).to_pylist(), object)
            for d in range(1, min(LEAF, len(k))):
                at = np.flatnonzero((k[d:] == k[:-d]) & (n[:-d] * DEN >= n[d:] * NUM) & (comp[d:] != comp[:-d]))
                if len(at):
                    yield pa.record_batch({"a": pa.array(cls[at], pa.binary()), "m": pa.array(n[at]), "b": pa.array(cls[at + d], pa.binary()), "n": pa.array(n[at + d])})
            # The last tree may go on in the next batch.
            held = b.slice(int(np.flatnonzero(k == k[-1])[0]))

    return _ordered(rows.select("k", "n", "cls", "c"), "k", "n", "cls").mapInArrow(run, "a binary, m long, b binary, n long")


def _tree_tasks(rows: DataFrame, reps: DataFrame, best: int | None) -> DataFrame:
    """(a, m, b, n) that the R-trees of more than a leaf give, rows (k, n, cls, c, size)."""
    parts = F.ceil(F.col("size") / PART).cast("int")
    rows = rows.select("k", "n", "cls", "c", parts.alias("parts")).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    to = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("part")).alias("i"), F.greatest(p, F.col("part")).alias("j")))
    rows = rows.join(reps.select("cls", "point"), "cls").select("k", F.explode(to).alias("ij"), "cls", "n", "c", "part", "point")

    def run(table: pa.Table) -> pa.Table:
        cls = table["cls"].to_pylist()
        at = list({c: i for i, c in enumerate(cls)}.values())
        table = table.take(pa.array(at))
        cls, sizes = table["cls"].to_pylist(), table["n"].to_numpy()
        ij = table["ij"][0].as_py()
        found = list(tree_pairs(table["point"].to_pylist(), sizes, table["c"].to_pylist(), table["part"].to_numpy(), ij["i"] != ij["j"], best))
        a, b = [i for i, _ in found], [j for _, j in found]
        return pa.table({"a": pa.array([cls[i] for i in a], pa.binary()), "m": pa.array(sizes[a], pa.int64()), "b": pa.array([cls[j] for j in b], pa.binary()), "n": pa.array(sizes[b], pa.int64())})

    return rows.groupBy("k", "ij").applyInArrow(run, "a binary, m long, b binary, n long")


def _open(members: DataFrame, comp: DataFrame) -> DataFrame:
    """k, n, cls, c, size of the members of trees that are not all of one component, written."""
    named = members.join(comp, F.expr("cls = v"), "left").select("k", "n", "cls", F.coalesce("c", "cls").alias("c"))
    named = materialise(named, "members")
    mixed = named.groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("k", "size")
    return materialise(named.join(mixed, "k"), "open")


def _once(pairs: DataFrame) -> DataFrame:
    """Each pair once: set sizes and classes order its ends alike everywhere."""
    x, y = (F.struct(F.col(size).alias("m"), F.col(name).alias("a")) for size, name in (("m", "a"), ("n", "b")))
    pairs = pairs.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).distinct()
    return pairs.select(F.col("x.a").alias("a"), F.col("x.m").alias("m"), F.col("y.a").alias("b"), F.col("y.m").alias("n"))


def links(docs: DataFrame, sets: DataFrame, common: tuple[np.ndarray, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(v, c): the component of every class that is linked with another."""
    first = F.min(F.struct("doc_id", "mark")).alias("row")
    reps = materialise(sets.where("n > 0").groupBy("cls").agg(first, F.first("n").alias("n"), F.first("own").alias("own"), F.first("keys").alias("keys"), F.first("point").alias("point")), "classes")
    shared = shared_rows(reps, common)
    stars = shared.where("cls <> head").select(F.col("head").alias("a"), "m", F.col("cls").alias("b"), "n").where((F.col("m") * DEN >= F.col("n") * NUM) & (F.col("n") * DEN >= F.col("m") * NUM)).distinct()
    comp = materialise(components(verified(bounded(stars, reps), reps, docs, key, text), "linked"), "components")

    def join_more(comp: DataFrame, pairs: DataFrame) -> DataFrame:
        more = verified(pairs, reps, docs, key, text)
        if more.isEmpty():
            return comp
        return materialise(components(comp.select(F.col("v").alias("a"), F.col("c").alias("b")).unionByName(more), "linked"), "components")

    # Shingles with the same head have about the same members: they are one tree.
    members = materialise(shared.select(F.col("tree").alias("k"), "n", "cls").distinct(), "members")
    open_ = _open(members, comp)
    large = F.col("size") > LEAF
    tried = materialise(_once(_tree_tasks(open_.where(large), reps, BEST)), "tried")
    comp = join_more(comp, bounded(_once(_leaf_pairs(open_.where(~large))), reps).unionByName(tried))
    open_ = _open(members, comp).where(large)
    if open_.isEmpty():
        return comp
    rest = _once(_tree_tasks(open_, reps, None))
    return join_more(comp, rest.join(tried.select("a", "b"), ["a", "b"], "left_anti").select("a", "m", "b", "n"))


def _named(docs: DataFrame, sets: DataFrame, common: tuple[np.ndarray, np.ndarray], row: Column, key: str, text: str) -> DataFrame:
    """cls, least (the smallest ``row`` of the class) and comp (the key of its component) of every class but the empty set."""
    comp = links(docs, sets, common, key, text).alias("c")
    classes = sets.where("n > 0").groupBy("cls").agg(F.min(row).alias("least")).alias("k")
    named = classes.join(comp, F.expr("k.cls = c.v"), "left").select("k.cls", "k.least", F.coalesce("c.c", "k.cls").alias("comp"))
    return materialise(named, "named")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id that links reach, of every document."""
    common = common_shingles(docs, text)
    sets = materialise(sets_of(docs, common, key, text), "sets")
    named = _named(docs, sets, common, F.col("doc_id"), key, text)
    lead = materialise(named.groupBy("comp").agg(F.min("least").alias("component_id")), "leads")
    # Written, so that the last join can split a class that most rows share.
    final = materialise(named.join(lead, "comp").select("cls", "component_id"), "classes").alias("f")
    s = sets.select("doc_id", "n", "cls").alias("s")
    out = s.join(final, F.expr("s.cls = f.cls and s.n > 0"), "left")
    return out.select("s.doc_id", F.col("s.n").alias("n_shingles"), F.when(F.col("s.n") > 0, F.col("f.component_id")).otherwise(F.col("s.doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the smallest id, null last, and of the smallest digest of its text.

    Rows are chosen by their component, so null ids and ids that repeat in several groups count as any other. Rows that
    have the empty set are linked with nothing and all stay; of rows equal in id and text one stays.
    """
    common = common_shingles(docs)
    sets = materialise(sets_of(docs, common, digest=True), "sets")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    least = _named(docs, sets, common, row, "doc_id", "text").groupBy("comp").agg(F.min("least").alias("r"))
    kept = least.select(F.col("r.doc_id").alias("__kept_id"), F.col("r.digest").alias("__kept_digest"))
    text = docs["text"].cast("string")
    # The white space at which shingles() cuts; a text of nothing else has the empty set.
    some = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(some).withColumn("__digest", F.md5(text))
    rows = rows.join(kept, rows["doc_id"].cast("long").eqNullSafe(kept["__kept_id"]) & (rows["__digest"] == kept["__kept_digest"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "__digest"]).drop("__digest").unionByName(docs.where(~some))
