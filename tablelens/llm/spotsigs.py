"""SpotSigs document fingerprints.

A signature is a common word (the anchor) and the chain of content words that follow it, common words skipped. A
document's fingerprint is the set of its signatures, each 40 bits of an MD5 digest. Documents are compared by the
Jaccard likeness of their sets; for a join they are partitioned by set length, so that only neighbouring partitions
meet, and within them only the rarest part of each set is looked up.

Nulls: a null text counts as an empty one; a null id is kept and orders first. A text without any anchor takes the
chains of all its content words, and one of common words alone the words themselves, so only texts without words have
the empty set. Two empty sets have likeness 1, an empty and another 0. Ties of ids are ordered by a hash of the text. Empty tables
give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import materialise, only, text_or_empty
from tablelens.llm.graph import components

#: Anchors: frequent function words of four languages.
ANCHORS = (
    "the a an is was are be of and to in for on that this with by it as at from or not "
    "le la les un une de du des et en est que qui dans pour par sur au "
    "der die das den dem ein eine und ist von zu mit auf im nicht "
    "el los las una del y es por con para se"
).split()
CHAIN = 2
SIG_CHARS = 10
#: Characters that end a word.
BREAKS = "\t\n\x0b\x0c\r.,;:!?\"'()[]{}<>|/\\-_*#&%=+~`"
THRESHOLD = 0.75


def words(text: Column) -> Column:
    """Lower-case words between white space and punctuation."""
    return F.filter(F.split(F.translate(F.lower(text), BREAKS, " " * len(BREAKS)), " "), lambda w: w != "")


def _signature(parts: Column) -> Column:
    return F.substring(F.md5(parts), 1, SIG_CHARS)


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The sorted set of spot signatures of a text."""

    def of_words(w: Column) -> Column:
        # A content word with the word before it if that is an anchor: struct(anchor, word).
        before = F.concat(F.array(F.lit("")), w)
        pairs = F.zip_with(before, w, lambda p, c: F.struct(F.when(p.isin(ANCHORS), p).alias("a"), c.alias("w")))
        content = F.filter(pairs, lambda x: x["w"].isNotNull() & ~x["w"].isin(ANCHORS))
        return F.transform(F.array(content), lambda c: of_content(c, w))[0]

    def chains(c: Column) -> Column:
        out = F.transform(c, lambda x: F.struct(x["a"].alias("a"), x["w"].alias("t")))
        for k in range(1, chain):
            later = F.slice(c, F.lit(k + 1), F.greatest(F.size(c), F.lit(1)))
            out = F.zip_with(
                out,
                later,
                lambda x, y: F.struct(x["a"].alias("a"), F.concat(x["t"], F.lit(" "), F.coalesce(y["w"], F.lit(""))).alias("t")),
            )
        return out

    def of_content(c: Column, w: Column) -> Column:
        spots = F.filter(chains(c), lambda x: x["a"].isNotNull())
        hashed = F.transform(spots, lambda x: _signature(F.concat(x["a"], F.lit(" "), x["t"])))
        plain = F.transform(chains(c), lambda x: _signature(F.concat(F.lit(" "), x["t"])))
        bare = F.transform(w, lambda x: _signature(x))
        picked = F.when(F.size(hashed) > 0, hashed).when(F.size(c) > 0, plain).otherwise(bare)
        return F.array_sort(F.array_distinct(picked))

    return F.transform(F.array(words(text)), of_words)[0]


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two signature sets, pruned where a set is empty."""
    both = F.size(F.array_intersect(a, b))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.transform(F.array(both), lambda n: n / (F.size(a) + F.size(b) - n))[0])
    )


def length_partition(n: Column, threshold: float = THRESHOLD) -> Column:
    """Partition by set length: sets of likeness ``threshold`` or more lie in the same or neighbouring partitions."""
    return F.when(n > 0, F.floor(F.log(n.cast("double")) / F.lit(-math.log(threshold)) + F.lit(1e-9))).otherwise(F.lit(-1)).cast("int")


def in_runs(docs: DataFrame, runs: int) -> DataFrame:
    """Deal rows to ``runs`` ranges of ascending id, and add each range's successor row to it, marked ``guest``.

    The cuts are approximate quantiles of the ids, so that no range is large. The successor of the last range is the
    first row of all. Adds ``run``, ``late`` (the wrapped first row sorts last) and ``guest``.
    """
    ids = docs.select("doc_id", "h")
    cuts = ids.agg(
        F.percentile_approx("doc_id", [i / runs for i in range(1, runs)] or [0.5], max(10000, 20 * runs)).alias("cuts")
    )
    cuts = cuts.select(F.array_sort(F.array_distinct(F.coalesce("cuts", F.expr("array(0L)")))).alias("cuts"))
    # One row of at most `runs` numbers.
    bounds = [int(x) for x in cuts.first()[0]]
    run = _bucket(F.col("doc_id"), bounds)
    firsts = ids.withColumn("run", run).groupBy("run").agg(F.min(F.struct("doc_id", "h")).alias("first")).orderBy("run").collect()
    placed = docs.withColumn("run", run).withColumns({"late": F.lit(0), "guest": F.lit(False)})
    if not firsts:
        return placed
    # Guest rows: the first row of each range, sent to the range before it. One row a range is broadcast.
    homes = [r["run"] for r in firsts]
    rows = [(r["first"]["doc_id"], r["first"]["h"], homes[i - 1], int(i == 0)) for i, r in enumerate(firsts)]
    kind = ids.schema["doc_id"].dataType
    cells = [F.struct(F.lit(a).cast(kind).alias("id"), F.lit(h).cast("long").alias("hash"), F.lit(r).alias("run"), F.lit(late).alias("late")) for a, h, r, late in rows]
    sent = docs.sparkSession.range(1).select(F.inline(F.array(*cells)))
    here = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hash"))
    guests = docs.join(F.broadcast(sent), here).dropDuplicates(["doc_id", "h"]).select(*docs.columns, "run", "late", F.lit(True).alias("guest"))
    return placed.unionByName(guests)


def _bucket(c: Column, bounds: list[int]) -> Column:
    """Number of bounds that are at or below ``c``, by nested halves; 0 for null."""

    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c >= F.lit(bounds[mid]), half(mid + 1, hi)).otherwise(half(lo, mid))

    return half(0, len(bounds))


def fingerprints_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text, the text edited by its successor, and compare both with it.

    The edited text is the text with its last floor(n/2) code points replaced by the first as many of the next
    document's, in ascending order of the key; the last document's next is the first.
    """
    spark = docs.sparkSession
    d = only(docs, key, text).select(F.col(key).alias("doc_id"), text_or_empty(F.col(text).cast("string")).alias("text"))
    d = d.withColumn("h", F.xxhash64("text"))
    runs = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = Window.partitionBy("run").orderBy("late", F.asc_nulls_first("doc_id"), "h", "guest")
    half = F.floor(F.char_length("text") / 2).cast("int")
    d = in_runs(d, runs).select("run", "late", "guest", "doc_id", "h", "text", F.lead("text").over(order).alias("next"))
    kept = F.char_length("text") - half
    edited = F.concat(F.substring("text", F.lit(1), kept), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    d = d.select("run", "late", "guest", "doc_id", "h", F.char_length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))
    d = d.select(
        "run", "late", "guest", "doc_id", "h", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        signatures(F.col("text")).alias("sig"), F.when(~F.col("guest"), signatures(F.col("edited"))).alias("edited_sig"),
    )
    d = d.select("*", F.lead("sig").over(order).alias("next_sig")).where("not guest")
    return d.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.array_join("sig", "").alias("fingerprint"),
        F.array_join("edited_sig", "").alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.coalesce("next_sig", "sig")).alias("near_next"),
        length_partition(F.size("sig")).alias("length_partition"),
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id (the smallest id linked to it) of every document, by SpotSigs likeness of ``threshold``.

    Equal sets are one class before any comparison. Two sets of that likeness share one of their first signatures in
    the order of rarity, as many as the length bound asks for, and lie in neighbouring length partitions; classes with
    a signature and two partitions in common are a group. Groups are settled in rounds: each compares one pivot with
    the members that are not linked with it yet, so a round gives one pair a member, and a group of copies is settled
    by its first pivots. A group ends when its open members are all linked.
    """
    d = only(docs, key, text).select(F.col(key).alias("doc_id"), signatures(text_or_empty(F.col(text).cast("string"))).alias("sig"))
    d = materialise(d.withColumn("cls", F.sha2(F.array_join("sig", ""), 256)), "spots")
    reps = materialise(d.where(F.size("sig") > 0).groupBy("cls").agg(F.first("sig").alias("sig")), "spot-classes")
    each = reps.select("cls", F.size("sig").alias("n"), F.explode("sig").alias("s"))
    common = each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # Signatures of one class alone come first in the order of rarity and find no partner: they only use up the prefix.
    shared = each.join(common, "s").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("x"))
    first = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1 - (F.col("n") - F.size("x"))
    entries = shared.where(first > 0).select("cls", "n", F.explode(F.slice("x", F.lit(1), first.cast("int"))["s"]).alias("s"))
    part = length_partition(F.col("n"), threshold)
    open_ = materialise(entries.select("cls", "n", "s", F.explode(F.array(part, part - 1)).alias("g")), "spot-open")
    spark = docs.sparkSession
    none = F.lit(None).cast("string")
    links = spark.range(0).select(none.alias("a"), none.alias("b"))
    comp = spark.range(0).select(none.alias("v"), none.alias("c"))
    while True:
        named = open_.join(comp, open_["cls"] == comp["v"], "left").select("g", "s", "n", "cls", F.coalesce("c", "cls").alias("c"))
        pivots = named.groupBy("g", "s").agg(F.min(F.struct("n", "cls", "c")).alias("p"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
        open_ = materialise(named.join(pivots.select("g", "s", "p"), ["g", "s"]), "spot-open")
        if open_.isEmpty():
            break
        fits = (F.col("c") != F.col("p.c")) & (F.col("p.n") >= F.col("n") * F.lit(threshold))
        pairs = open_.where(fits).select(F.col("p.cls").alias("a"), F.col("cls").alias("b")).distinct()
        checked = (
            pairs.join(reps.select(F.col("cls").alias("a"), F.col("sig").alias("sa")), "a")
            .join(reps.select(F.col("cls").alias("b"), F.col("sig").alias("sb")), "b")
            .where(likeness(F.col("sa"), F.col("sb")) >= threshold)
            .select("a", "b")
        )
        links = materialise(links.unionByName(checked), "spot-links")
        comp = materialise(components(links, "spot-cc"), "spot-comp")
        open_ = open_.where("cls <> p.cls").select("cls", "n", "s", "g")
    named = d.join(comp, d["cls"] == comp["v"], "left").select("doc_id", "cls", F.coalesce("c", "cls").alias("c"))
    lead = named.groupBy("c").agg(F.min("doc_id").alias("class_id"))
    # A text without words is linked with nothing.
    empty = F.sha2(F.lit(""), 256)
    return named.join(lead, "c").select("doc_id", F.when(F.col("cls") == empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))
