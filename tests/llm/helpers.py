"""Fixture documents with every awkward case, and plain models of the operators."""

import random
import re

from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, base=400):
    return " ".join(f"w{rng.randrange(base)}" for _ in range(n))


def fixture_rows(seed=3):
    """Clean texts, exact and near copies, chains, nulls, empty, tiny, long and repeated ones."""
    rng = random.Random(seed)
    texts = [words(rng, rng.randrange(6, 80)) for _ in range(60)]
    near = texts[0].split()
    near[3] = "changed"
    texts += [texts[0], texts[1], " ".join(near), texts[2] + " tail", texts[2].upper()]
    chain = [f"c{i}" for i in range(60)]
    texts += [" ".join(chain[i : i + 40]) for i in range(0, 18, 3)]
    texts += [None, "", "   \t\n", "one", "one", "one two three", "ONE TWO THREE", words(rng, 6000), "日本語 テキスト です", "12 34 !!", "é è ü", "x" * 5000]
    return [(i, t, ("en", "fr", None)[i % 3], (None, "a", "b", "b")[i % 4], len(t or "")) for i, t in enumerate(texts)]


def documents(spark, rows=None):
    return spark.createDataFrame(fixture_rows() if rows is None else rows, DOC)


def clashing(df):
    """The same table with extra columns whose names the operators use inside."""
    return df.withColumns({n: F.lit("x") for n in ("key", "size", "h", "run", "cls", "keys", "n", "shard", "vslot", "slot", "rate", "target", "w", "g", "ids", "late", "guest")})


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(sets):
    """Component of every key by comparing all pairs."""
    boss = {i: i for i in sets}

    def find(a):
        while boss[a] != a:
            a = boss[a]
        return a

    keys = sorted(sets)
    for x, a in enumerate(keys):
        for b in keys[:x]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
                boss[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in keys}
