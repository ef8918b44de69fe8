"""Operators on documents against plain models: sharding, fingerprints, mixing, language, BPE, n-gram join, pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablelens.llm import bpe, langid, mixing, ngram_join, sharding, spotsigs
from tests.llm import helpers as H

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return H.documents(spark).cache()


@pytest.fixture(scope="module")
def rows():
    return {r[0]: r for r in H.fixture_rows()}


# -- sharding --------------------------------------------------------------------------------------------------------


def test_sharding(spark, docs, rows):
    got = sharding.shard_records(H.clashing(docs), shards=6, slots=256).collect()
    assert sorted(r["key"] for r in got) == sorted(rows)
    for r in got:
        text = (rows[r["key"]][1] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 8, zlib.crc32(text))
    for s in range(6):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    one_slot = Counter()
    for r in got:
        one_slot[r["vslot"]] = r["shard"]
    assert all(one_slot[r["vslot"]] == r["shard"] for r in got)


def test_sharding_balances_and_moves_little(spark):
    d = spark.range(20000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), (F.col("id") % 97).cast("int")).alias("text"))
    got = sharding.shard_records(d, shards=8, slots=1024).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    loads = [r["b"] for r in got]
    assert max(loads) / min(loads) < 1.01
    sized = sharding.size_records(d, "doc_id", "text", 1024)
    loads = sharding.slot_loads(sized)
    old = sharding.rebalance(sharding.first_map(spark, 1024, 8), loads, 8)
    new = sharding.rebalance(old, loads, 9)
    moved = old.alias("o").join(new.alias("n"), "vslot").where("o.shard <> n.shard").join(loads, "vslot").select("n.shard", "slot_bytes").collect()
    share, total = sum(r[1] for r in moved), loads.agg(F.sum("slot_bytes")).first()[0]
    assert total / 9 * 0.95 < share < total / 9 * 1.15
    assert sum(r[1] for r in moved if r[0] == 8) > 0.9 * share
    assert [r[0] for r in new.select("version").distinct().collect()] == [3]


def plain_rebalance(old, loads, shards):
    """The rebalanced map by lists: old and loads by slot."""
    mean = sum(loads.get(v, 0) for v in old) / shards
    new, held, pool = {}, [0] * shards, []
    for s in set(old.values()):
        total = 0
        for b, v in sorted((-loads.get(v, 0), v) for v in old if old[v] == s):
            total -= b
            if total <= mean and s < shards:
                new[v] = s
                held[s] -= b
            else:
                pool.append((b, v, s))
    for b, v, s in sorted(pool):
        new[v] = s if s < shards and held[s] - b <= mean else held.index(min(held))
        held[new[v]] -= b
    return new


@pytest.mark.parametrize(("slots", "before", "after", "seed"), [(64, 5, 5, 1), (64, 5, 6, 2), (64, 6, 4, 3), (100, 7, 8, 4), (12, 12, 3, 5)])
def test_rebalance_against_a_plain_model(spark, slots, before, after, seed):
    """Skewed loads, ties, empty slots, one slot that holds a third of all; growing and shrinking."""
    rng = random.Random(seed)
    loads = {v: rng.choice([0, 5, 5, 7, rng.randrange(50)]) for v in range(slots) if rng.random() < 0.9}
    loads[3] = sum(loads.values()) // 2
    old = {v: rng.randrange(before) for v in range(slots)}
    m = spark.createDataFrame([(4, v, s) for v, s in old.items()], "version int, vslot long, shard int")
    given = spark.createDataFrame([(v, b, 1) for v, b in loads.items()], "vslot long, slot_bytes long, slot_rows long")
    got = sharding.rebalance(m, given, after).collect()
    assert {r["vslot"]: r["shard"] for r in got} == plain_rebalance(old, loads, after)
    assert {r["version"] for r in got} == {5}


def test_records_are_placed_by_the_stored_map(spark, docs, rows, tmp_path):
    """Each call reads the last version, adds the next and places by it; the plain model gives the same shards."""
    path = str(tmp_path / "map")
    first = sharding.shard_records(docs, shards=4, slots=64, map_path=path).collect()
    loads = Counter()
    for r in first:
        loads[r["vslot"]] += r["size"]
    model = plain_rebalance({v: v % 4 for v in range(64)}, loads, 4)
    assert {r["vslot"]: r["shard"] for r in first} == {v: model[v] for v in loads}
    assert {r["map_version"] for r in first} == {2}
    again = sharding.shard_records(docs, shards=5, map_path=path).collect()
    model = plain_rebalance(model, loads, 5)
    assert {r["vslot"]: r["shard"] for r in again} == {v: model[v] for v in loads}
    assert {r["map_version"] for r in again} == {3}
    assert {r["version"] for r in spark.read.parquet(path).select("version").distinct().collect()} == {1, 2, 3}


def test_map_versions(spark, tmp_path):
    m = sharding.first_map(spark, 16, 4)
    sharding.save_map(m, str(tmp_path / "map"))
    loads = spark.createDataFrame([(i, 10 if i else 1000, 1) for i in range(16)], "vslot long, slot_bytes long, slot_rows long")
    sharding.save_map(sharding.rebalance(m, loads, 4), str(tmp_path / "map"))
    assert sharding.load_map(spark, str(tmp_path / "map"), 1).count() == 16
    assert sharding.load_map(spark, str(tmp_path / "map")).first()["version"] == 2
    with pytest.raises(ValueError, match="shards"):
        sharding.first_map(spark, 4, 8)


# -- fingerprints ----------------------------------------------------------------------------------------------------


def test_fingerprints(docs, rows):
    got = {r["doc_id"]: r for r in spotsigs.fingerprints_with_edits(H.clashing(docs)).collect()}
    ids = sorted(rows)
    assert sorted(got) == ids
    for at, i in enumerate(ids):
        text, nxt = rows[i][1] or "", rows[ids[(at + 1) % len(ids)]][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1
        follower = got[ids[(at + 1) % len(ids)]]
        a, b = sig(got[i]["fingerprint"]), sig(follower["fingerprint"])
        assert got[i]["near_next"] == pytest.approx(likeness(a, b))
        assert got[i]["near_edited"] == pytest.approx(likeness(a, sig(got[i]["edited_fingerprint"])))
    by_text = {}
    for i in ids:
        assert by_text.setdefault(rows[i][1] or "", got[i]["fingerprint"]) == got[i]["fingerprint"]


def sig(text):
    n = spotsigs.SIG_CHARS
    out = [text[k : k + n] for k in range(0, len(text), n)]
    assert out == sorted(set(out))
    return set(out)


def likeness(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_signatures_by_hand(spark):
    df = spark.createDataFrame([("The cat sat. A dog of the moon ran",), ("and the of",), ("alpha beta",), ("",), ("!!",)], "text string")
    got = [r[0] for r in df.select(spotsigs.signatures(F.col("text"))).collect()]
    make = lambda *s: sorted({hashlib.md5(x.encode()).hexdigest()[: spotsigs.SIG_CHARS] for x in s})
    assert got[0] == make("the cat sat", "a dog moon", "the moon ran")
    assert got[1] == make("and", "the", "of")
    assert got[2] == make(" alpha beta", " beta ")
    assert got[3] == got[4] == []


def test_fingerprints_of_awkward_tables(spark):
    assert spotsigs.fingerprints_with_edits(H.documents(spark, [])).count() == 0
    one = spotsigs.fingerprints_with_edits(H.documents(spark, [(5, "the cat sat down", "en", "a", 0)])).first()
    assert (one["near_next"], one["doc_id"]) == (1.0, 5)
    odd = H.documents(spark, [(None, "the one thing", "en", "a", 0), (1, "the cat sat", "en", "a", 0), (1, "the dog ran", "en", "a", 0), (1, "the dog ran", "en", "a", 0)])
    assert spotsigs.fingerprints_with_edits(odd).count() == 4


def test_near_duplicates(spark, docs, rows):
    got = {r["doc_id"]: r["class_id"] for r in spotsigs.near_duplicates(docs).collect()}
    prints = {r["doc_id"]: frozenset(r["s"]) for r in docs.select("doc_id", spotsigs.signatures(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    boss = {i: i for i in prints}

    def find(a):
        while boss[a] != a:
            a = boss[a]
        return a

    for a in sorted(prints):
        for b in range(a):
            if prints[a] and prints[b] and likeness(prints[a], prints[b]) >= 0.75:
                boss[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {i: find(i) for i in prints}


def test_near_duplicates_in_a_hot_group(spark):
    """Many near copies that share nearly all signatures are one class after few rounds."""
    rows = [(i, " ".join("the " + (f"edit{i}" if k == i % 40 else f"w{k}") + f" x{k}" for k in range(40)), "en", "a", 0) for i in range(80)]
    got = spotsigs.near_duplicates(H.documents(spark, rows)).collect()
    assert {r["class_id"] for r in got} == {0}
    assert spotsigs.near_duplicates(H.documents(spark, [])).count() == 0


# -- mixing ----------------------------------------------------------------------------------------------------------


def water_fill(sizes, weights):
    """Targets by repeated resharing, as the rule says."""
    total = sum(sizes)
    limit, target, left, open_ = [3 * s for s in sizes], [0.0] * len(sizes), float(total), set(range(len(sizes)))
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > limit[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = limit[i]
            left -= limit[i]
            open_.discard(i)
    return target


def test_targets(spark):
    sizes = [5, 1000, 10, 0, 400, 3]
    df = spark.createDataFrame([(n, s) for n, s in zip(["a", "b", "é", "zz", "😀", None], sizes, strict=True)], "source string, source_size long")
    got = {r["source"]: r for r in mixing.source_targets(df).collect()}
    names = ["a", "b", "zz", "é", "😀", None]
    by_name = dict(zip(["a", "b", "é", "zz", "😀", None], sizes, strict=True))
    want = water_fill([by_name[n] for n in names], [1, 2, 3, 1, 2, 3])
    assert [got[n]["target"] for n in names] == pytest.approx(want)
    assert sum(got[n]["target"] for n in names) == pytest.approx(sum(sizes))


def test_mixing(spark, docs, rows):
    plan = {r["doc_id"]: r for r in mixing.plan_mix(H.clashing(docs)).collect()}
    assert sorted(plan) == sorted(rows)
    for i, r in plan.items():
        assert r["size"] == len((rows[i][1] or "").translate({0xA0: "_"}).encode().split())
        assert int(r["rate"]) <= r["copies"] <= min(3, int(r["rate"]) + 1)
    again = {r["doc_id"]: r["copies"] for r in mixing.plan_mix(docs.repartition(7)).collect()}
    assert again == {i: r["copies"] for i, r in plan.items()}
    emitted = Counter(r["doc_id"] for r in mixing.emit(docs).collect())
    assert emitted == Counter({i: r["copies"] for i, r in plan.items() if r["copies"]})
    assert mixing.emit(H.clashing(docs)).columns == H.clashing(docs).columns
    assert mixing.plan_mix(H.documents(spark, [])).count() == 0


def test_mix_comes_near(spark):
    d = spark.range(30000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 13).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    for r in mixing.plan_mix(d).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("n")).collect():
        assert r["n"] == pytest.approx(r["t"], rel=0.05)


# -- language --------------------------------------------------------------------------------------------------------

_LANGS = {"aa": ("ban", "dor", "mil", "tas"), "bb": ("quo", "xyl", "vex", "jug"), "cc": ("ßen", "üch", "äpf", "öst")}


def tongue(rng, lang, n):
    return " ".join("".join(rng.choice(_LANGS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language(spark):
    import random

    rng = random.Random(5)
    rows = [(i, tongue(rng, lang, rng.randrange(5, 60)), lang, "s", 0) for i, lang in enumerate(["aa", "bb", "cc"] * 80)]
    mixed = tongue(rng, "aa", 40) + " " + tongue(rng, "bb", 120)
    rows += [(1000, mixed, None, "s", 0), (1001, None, "aa", "s", 0), (1002, "12 !! ", "aa", "s", 0), (1003, "", None, "s", 0), (1004, tongue(rng, "cc", 30000), None, "s", 0), (None, tongue(rng, "aa", 30), None, "s", 0)]
    d = spark.createDataFrame(rows, H.DOC)
    got = {r["doc_id"]: r for r in langid.identify(H.clashing(d)).collect()}
    for i, _, lang, *_ in rows[:240]:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i]["lang_pred"] == lang
    assert got[1000]["lang_pred"] == "bb"
    assert got[1000]["languages"].keys() == {"aa", "bb"}
    assert got[1000]["score"] == pytest.approx(0.75, abs=0.1)
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (1001, 1002, 1003)] == [("und", 0.0)] * 3
    assert got[1004]["lang_pred"] == "cc"
    assert got[None]["lang_pred"] == "aa"
    kept = {r["doc_id"] for r in langid.keep_identified(d).collect()}
    assert kept == set(got) - {1001, 1002, 1003}
    assert {r["lang_pred"] for r in langid.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(H.documents(spark, [])).count() == 0


def plain_cell(trigram):
    """The cell of three characters, by the same mixing hash in plain integers."""
    m = 0xFFFFFFFF
    x, y, z = (ord(c) for c in trigram)
    h = (x * 0x9E3779B1 + y * 0x85EBCA77 + z * 0xC2B2AE3D) & m
    h ^= h >> 15
    return ((h * 0x2C1B3C6D) & m) >> 16


def plain_mixture(text, logp):
    """Shares of a text's languages: one trigram, one language, one round at a time."""
    langs = range(len(logp))
    padded = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    grams = [plain_cell(padded[i - 1 : i + 2]) for i in range(1, len(padded) - 1) if padded[i] != " "]
    if not grams:
        return [0.0 for _ in langs]
    chance = [[math.exp(float(logp[g][c])) for g in langs] for c in grams]

    def expect(shares, rounds):
        for _ in range(rounds):
            sums = [0.0 for _ in langs]
            for row in chance:
                parts = [p * q for p, q in zip(row, shares, strict=True)]
                sums = [s + p / sum(parts) for s, p in zip(sums, parts, strict=True)]
            shares = [s / sum(sums) for s in sums]
        return shares

    def value(shares, k):
        like = sum(math.log(sum(p * q for p, q in zip(row, shares, strict=True))) for row in chance)
        return like / langid.OVERLAP - 0.5 * (k - 1) * math.log(max(len(grams) / langid.OVERLAP, math.e))

    alone = [[float(g == only) for g in langs] for only in langs]
    best = max((value(s, 1), -i, s) for i, s in enumerate(alone))[2]
    top = value(best, 1)
    every = expect([1 / len(logp) for _ in langs], langid.ROUNDS)
    ranked = sorted(langs, key=lambda g: -every[g])
    for k in range(2, len(logp) + 1):
        if every[ranked[k - 1]] <= langid.LEAST_SHARE:
            break
        kept = [every[g] if g in ranked[:k] else 0.0 for g in langs]
        shares = expect([x / sum(kept) for x in kept], langid.ROUNDS // 2)
        if value(shares, k) > top:
            best, top = shares, value(shares, k)
    return best


def test_mixture_against_plain_loop():
    """Five languages with words of their own: texts of one to five of them, short and long, mixed and pure."""
    rng = np.random.default_rng(1)
    words = [["".join(chr(97 + 5 * g + i) for i in rng.integers(0, 5, 5)) for _ in range(30)] for g in range(5)]
    counts = np.full((5, langid.CELLS), langid.SMOOTH)
    for g, own in enumerate(words):
        _, cell, n = langid.trigrams([" ".join(own)])
        counts[g, cell] += n
    logp = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)
    texts = ["", "12 34", "a", "abcde fghij klmno"]
    for several in range(1, 6):
        for length in (4, 40, 200):
            texts.append(" ".join(words[rng.integers(0, several)][rng.integers(0, 30)] for _ in range(length)))
    got = langid.infer(texts, logp)
    for text, row in zip(texts, got, strict=True):
        assert row == pytest.approx(plain_mixture(text, logp), abs=1e-6)
    assert got[1].sum() == 0
    # More than three languages can be the best set.
    assert (got[-1] > 0.05).sum() == 5


# -- BPE -------------------------------------------------------------------------------------------------------------

ODD = [
    "Hello, world! It's 42 o'clock", "<|endoftext|> a<|startoftext|>b <|endoftext", "ΑΣ ΣΑΣ ǅ ﬁ ſ K Å İ", "é \x1c\x1d 　x", "a" * 3000, "ab" * 500, "the" * 900,
    "日本語 テキスト 😀👍🏽", "\x00￾", "don't I'LL we've", "\n\n\t", "",
]


def digest(x):
    return hashlib.sha256(x).hexdigest()


def test_bpe_round_trip(spark, docs, rows):
    library = Tokenizer.from_file(PATH)
    extra = [(1000 + i, t, "en", "a", 0) for i, t in enumerate(ODD)]
    d = H.documents(spark, [*rows.values(), *extra])
    texts = {r[0]: r[1] or "" for r in [*rows.values(), *extra]}
    got = bpe.round_trip(H.clashing(d), PATH, keep_ids=True).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), digest(np.array(ids, "<u4").tobytes()))
        assert r["decoded_sha256"] == digest(library.decode(ids, skip_special_tokens=False).encode())
    assert bpe.round_trip(H.documents(spark, []), PATH).count() == 0
    assert bpe.encode(d, PATH).agg(F.sum("n_tokens")).first()[0] == sum(r["n_tokens"] for r in got)


def test_bpe_speculation_is_verified():
    """Speculated splits that pass are what exact merging gives; both kinds of words occur; the cache stays bounded."""
    import random

    b, rng = bpe.Bpe(open(PATH, encoding="utf-8").read()), random.Random(2)
    made = ["".join(rng.choice("aeiounrstlmdghp") for _ in range(rng.randrange(1, 16))) for _ in range(4000)]
    passed = 0
    for w, ids in b.learn(set(made)).items():
        exact = b._merge_long([b.vocab[s] for s in b.symbols(w)])
        assert list(ids) == exact == b.exact(w)
        passed += b.speculate(w) == exact
    assert 0 < passed < len(set(made))


# -- n-gram join -----------------------------------------------------------------------------------------------------


def test_ngram_join(docs, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(H.clashing(docs)).collect()}
    sets = {i: H.shingle_set(r[1]) for i, r in rows.items()}
    comp = H.components(sets)
    assert got == {i: (len(s), comp[i]) for i, s in sets.items()}
    assert len(set(comp.values())) < len(comp) - 8


def test_ngram_join_of_large_groups(spark, monkeypatch):
    """Trees cut into parts, stars into chunks and common shingles into several give the components of all pairs."""
    for name, value in (("BLOCK_SHINGLES", 500), ("PART", 8), ("LEAF", 4), ("SPLIT", 10), ("COMMON_LEAST", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(7)
    base = [f"t{i}" for i in range(100)]
    texts = []
    for i in range(60):
        w = list(base)
        w[i] = f"edit{i}"
        texts.append(" ".join(w))
    # One passage in texts of their own, and chains of which only neighbours are linked.
    texts += [" ".join(base[:40] + [f"own{i}x{j}" for j in range(rng.randrange(8, 40))]) for i in range(60)]
    chain = [f"c{i}" for i in range(150)]
    texts += [" ".join(base[:20] + chain[i : i + 60]) for i in range(0, 90, 5)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(H.documents(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])).collect()}
    want = H.components({i: H.shingle_set(t) for i, t in enumerate(texts)})
    assert got == want and 5 < len(set(want.values())) < 80


def test_ngram_join_of_awkward_tables(spark):
    assert ngram_join.join(H.documents(spark, [])).count() == 0
    text = "a b c d e f g h"
    odd = H.documents(spark, [(None, text, "en", "a", 0), (7, text, "en", "a", 0), (7, text, "en", "a", 0), (7, "other words here that are not the same", "en", "a", 0), (9, text + " ", None, None, 0), (None, None, None, None, None)])
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(odd).collect()), key=repr)
    assert got == sorted([(None, 4, 7), (7, 4, 7), (7, 4, 7), (7, 4, 7), (9, 4, 7), (None, 0, None)], key=repr)


def test_keep_one_of_null_and_repeated_ids(spark):
    """One row of each group by brute force, whatever the ids: null, repeated, shared by groups that no link connects."""
    long = [[f"{g}{i}" for i in range(60)] for g in "abcdefg"]
    near = lambda g, *tail: " ".join([*long[g], *tail])
    rows = [
        (None, near(0)), (None, near(0, "x")), (None, near(0, "x", "y")), (None, near(0)),  # near copies of null ids alone
        (3, near(1)), (None, near(1, "x")), (None, near(1).upper()),  # null ids linked to a document
        (1, near(2)), (5, near(2, "x")), (5, near(3)), (6, near(3, "x")), (4, near(3, "y")),  # 5 is in two groups and the least of none
        (7, near(4)), (7, near(4).upper()), (7, near(4, "x")), (7, near(4)), (7, near(5)),  # one id, several texts of two groups
        (None, near(6)), (None, "one"), (None, ""), (None, None), (None, " \t\n\x0b\x0c\r"), (8, ""), (8, None), (9, "\u00a0"),
    ]
    comp = H.components({i: H.shingle_set(t) for i, (_, t) in enumerate(rows)})
    groups = {}
    for i, (key, text) in enumerate(rows):
        groups.setdefault(comp[i], []).append((key is None, key, hashlib.md5((text or "").encode()).hexdigest(), text))
    want = Counter((key, text) for found in groups.values() for _, key, _, text in [min(found, key=lambda r: r[:3] if r[1] is not None else (True, 0, r[2]))])
    got = ngram_join.keep_one(H.documents(spark, [(key, text, "en", "a", 0) for key, text in rows])).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == want
    assert ngram_join.keep_one(H.documents(spark, [])).count() == 0


def random_sets(rng, families=40):
    sets = []
    for _ in range(families):
        base = np.unique(rng.integers(0, 1 << 63, rng.integers(5, 600), dtype=np.uint64))
        sets.append(base)
        for _ in range(rng.integers(0, 6)):
            keep = base[rng.random(len(base)) > rng.choice([0.02, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, len(base) // 12 + 1, dtype=np.uint64)])))
    return sets


def linked_pairs(sets):
    of = [set(x.tolist()) for x in sets]
    return {(i, j) for j in range(len(of)) for i in range(j) if 100 * len(of[i] & of[j]) >= 75 * len(of[i] | of[j])}


def test_linked_sets_share_a_prefix_shingle_in_any_order():
    rng = np.random.default_rng(4)
    sets = random_sets(rng)
    links = linked_pairs(sets)
    every = np.unique(np.concatenate(sets))
    for share in (0.0, 0.3, 1.0):
        common = every[rng.random(len(every)) < share]
        counts = rng.integers(8, 100, len(common))
        first = [set(ngram_join.prefix(x, common, counts)[0].tolist()) for x in sets]
        assert len(links) > 50 and all(first[i] & first[j] for i, j in links)


def test_trees_lose_no_link():
    rng = np.random.default_rng(5)
    sets = random_sets(rng)
    links = linked_pairs(sets)
    points, sizes = [ngram_join.point(x) for x in sets], np.array([len(x) for x in sets])
    assert all(ngram_join.may_link(points[i], sizes[i], points[j], sizes[j]) for i, j in links)
    parts = np.arange(len(sets)) % 2
    found = {tuple(sorted(x)) for x in ngram_join.tree_pairs(points, sizes, list(range(len(sets))), parts, False)}
    assert links <= found and len(found) < len(sets) ** 2 / 8
    across = {tuple(sorted(x)) for x in ngram_join.tree_pairs(points, sizes, list(range(len(sets))), parts, True)}
    assert across == {(i, j) for i, j in found if parts[i] != parts[j]}
    comp = H.components({i: set(x.tolist()) for i, x in enumerate(sets)})
    assert not links & {tuple(sorted(x)) for x in ngram_join.tree_pairs(points, sizes, [comp[i] for i in range(len(sets))], parts, False)}


def test_points_of_large_counts():
    many = np.arange(40_000_000 // 100, dtype=np.uint64) << np.uint64(20)
    p = ngram_join.point(many)
    assert p[0] == 4 and ngram_join.counts_of(p).sum() == len(many) and ngram_join.counts_of(p, 64).sum() == len(many)


# -- the pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    import random

    rng = random.Random(8)
    rows = [(i, tongue(rng, lang, 30), lang, ("x", "y", None)[i % 3], 0) for i, lang in enumerate(["aa", "bb"] * 20)]
    rows += [(100, rows[0][1], "aa", "x", 0), (101, rows[1][1] + " tail", "bb", "y", 0), (102, "!!! 123", "aa", "x", 0), (103, None, "aa", "x", 0)]
    H.documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r[0]: r for r in rows}
    kept = {i: r for i, r in texts.items() if i < 102}
    comp = H.components({i: H.shingle_set(r[1]) for i, r in kept.items()})
    kept = {i: r for i, r in kept.items() if comp[i] == i}
    assert sorted(kept) == list(range(40))
    copies = {r["doc_id"]: r["copies"] for r in mixing.plan_mix(H.documents(spark, list(kept.values()))).collect()}
    assert Counter(r["doc_id"] for r in got) == Counter({i: n for i, n in copies.items() if n})
    library = Tokenizer.from_file(PATH)
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(texts[r["doc_id"]][1], add_special_tokens=False).ids
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "mixing sources to target weights", "BPE encoding and decoding"]
