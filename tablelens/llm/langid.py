"""Language identification by inference of a mixture of languages.

A document is a bag of letter trigrams drawn from a mixture of languages. Expectation-maximisation estimates the
document's proportions from the trigrams' likelihoods; the set of languages is the one with the best penalised
likelihood, of the likeliest language alone and the 2, 3, ... languages of the largest proportions, as long as the last of
these has a share of more than ``LEAST_SHARE``, up to all that were learned; the prediction is the language with the
largest share in the set, and the score that share.

Training uses a bounded sample of labelled documents: all of a language's documents up to ``SAMPLE`` of them, beyond
that a hash-drawn share that keeps about as many. Whole texts are used, in training and prediction.

Nulls: rows without text or language are not learned from. A null text, or one without letters, is ``und`` with score
0, as is everything if there is nothing to learn from. Ties go to the language that sorts first. Empty tables give an
empty result, repeated rows are predicted one by one, other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import hash_fraction, only, release

#: Labelled documents to learn from, for each language.
SAMPLE = 3000
CELLS = 1 << 16
SMOOTH = 0.5
ROUNDS = 10
#: A language joins the sets that are tried if its share among all languages is larger.
LEAST_SHARE = 0.02
#: Trigrams overlap, so a letter's evidence counts a third.
OVERLAP = 3.0
#: Characters of text worked on at once; a longer text is worked on alone.
CHUNK = 250_000
UNKNOWN = "und"


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, cell, count) of every distinct trigram cell of each document, by document."""
    low = [t.lower() for t in texts]
    lengths = np.fromiter((len(t) + 1 for t in low), dtype=np.int64, count=len(low))
    code = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "replace"), dtype=np.uint32)
    doc = np.concatenate([np.zeros(1, np.int32), np.repeat(np.arange(len(low), dtype=np.int32), lengths)])
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    code, letter, doc = np.where(letter, code, 32)[keep].astype(np.uint32), letter[keep], doc[keep]
    at = np.flatnonzero(letter)
    nxt = np.append(code, np.uint32(32))
    h = code[at - 1] * np.uint32(0x9E3779B1) + code[at] * np.uint32(0x85EBCA77) + nxt[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    keys, counts = np.unique((doc[at].astype(np.int64) << 16) | (h >> np.uint32(16)), return_counts=True)
    return (keys >> 16).astype(np.int64), (keys & 0xFFFF).astype(np.int64), counts.astype(np.float64)


def chunks(column: pa.Array) -> Iterable[tuple[int, list[str]]]:
    """Runs of texts of about ``CHUNK`` characters, each with the place of its first; nulls are empty."""
    start, size, part = 0, 0, []
    for i in range(len(column)):
        t = column[i].as_py() or ""
        if part and size + len(t) > CHUNK:
            yield start, part
            start, size, part = i, 0, []
        part.append(t)
        size += len(t)
    if part:
        yield start, part


def train(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Languages and their log probabilities by cell, from labelled rows (doc_id, text, lang)."""
    rows = only(docs, "doc_id", "text", "lang").where("text is not null and lang is not null")
    per_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(per_lang)
    if not langs:
        return {"langs": [], "logp": np.zeros((0, CELLS), np.float32)}
    share = None
    for lang in langs:
        hit = F.col("lang") == lang
        value = F.lit(min(1.0, sample / per_lang[lang]))
        share = F.when(hit, value) if share is None else share.when(hit, value)
    picked = rows.where(hash_fraction(F.col("doc_id"), "langid") < share).select("lang", "text")

    def count(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            for start, texts in chunks(b.column(1)):
                doc, cell, n = trigrams(texts)
                ix = np.array([langs.index(x) for x in names[start : start + len(texts)]])[doc]
                keys, inv = np.unique(ix * CELLS + cell, return_inverse=True)
                sums = np.bincount(inv, weights=n, minlength=len(keys))
                yield pa.record_batch({"k": pa.array(keys, pa.int64()), "n": pa.array(sums, pa.float64())})
        release()

    # One row per language and cell at most.
    sums = picked.mapInArrow(count, "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(langs) * CELLS)
    counts[sums["k"].to_numpy()] = sums["n"].to_numpy()
    counts = counts.reshape(len(langs), CELLS) + SMOOTH
    return {"langs": langs, "logp": np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)}


def _mix(like: np.ndarray, shift: np.ndarray, n: np.ndarray, doc: np.ndarray, starts: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood of each document after ``rounds`` of expectation-maximisation."""
    for _ in range(rounds):
        w = like * pi[doc]
        w *= (n / np.maximum(w.sum(1), 1e-300))[:, None]
        pi = np.add.reduceat(w, starts, axis=0)
        pi /= pi.sum(1, keepdims=True)
    total = np.maximum((like * pi[doc]).sum(1), 1e-300)
    return pi, np.add.reduceat(n * (np.log(total) + shift), starts)


def infer(texts: list[str], logp: np.ndarray) -> np.ndarray:
    """Proportions (documents by languages) over the chosen set of languages; zeros for texts without letters."""
    out = np.zeros((len(texts), logp.shape[0]))
    doc, cell, n = trigrams(texts)
    if not len(doc) or not logp.shape[0]:
        return out
    present, doc = np.unique(doc, return_inverse=True)
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    lp = logp.T[cell].astype(np.float64)
    shift = lp.max(1)
    like = np.exp(lp - shift[:, None])
    size = np.add.reduceat(n, starts)
    alone = np.add.reduceat(lp * n[:, None], starts, axis=0)
    best = alone.argmax(1)
    chosen = np.zeros((len(present), logp.shape[0]))
    chosen[np.arange(len(present)), best] = 1.0
    score = alone[np.arange(len(present)), best] / OVERLAP
    pi, _ = _mix(like, shift, n, doc, starts, np.full_like(chosen, 1.0 / logp.shape[0]), ROUNDS)
    order = np.argsort(-pi, axis=1, kind="stable")
    for k in range(2, logp.shape[0] + 1):
        some = np.flatnonzero(pi[np.arange(len(present)), order[:, k - 1]] > LEAST_SHARE)
        if not len(some):
            break
        rows = np.isin(doc, some)
        d = np.searchsorted(some, doc[rows])
        begin = np.flatnonzero(np.diff(d, prepend=-1))
        start = np.zeros((len(some), logp.shape[0]))
        np.put_along_axis(start, order[some, :k], np.take_along_axis(pi[some], order[some, :k], 1), 1)
        start /= start.sum(1, keepdims=True)
        mixed, ll = _mix(like[rows], shift[rows], n[rows], d, begin, start, ROUNDS // 2)
        value = ll / OVERLAP - 0.5 * (k - 1) * np.log(np.maximum(size[some] / OVERLAP, math.e))
        better = value > score[some]
        chosen[some[better]], score[some[better]] = mixed[better], value[better]
    out[present] = chosen
    return out


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score and languages (the chosen set with shares) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "doc_id long, lang_pred string, score double, languages map<string,double>"

    def run(batches):
        langs, logp = shared.value["langs"], shared.value["logp"]
        for b in batches:
            names, scores, maps = [], [], []
            for _, part in chunks(b.column(1)):
                for row in infer(part, logp):
                    k = int(row.argmax()) if len(row) else 0
                    known = len(row) > 0 and row[k] > 0
                    names.append(langs[k] if known else UNKNOWN)
                    scores.append(min(1.0, float(row[k])) if known else 0.0)
                    maps.append([(langs[i], float(row[i])) for i in np.flatnonzero(row)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(maps, pa.map_(pa.string(), pa.float64()))],
                names=["doc_id", "lang_pred", "score", "languages"],
            )
        release()

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kind)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from the rows that are not held out, and predict all."""
    model = train(docs.where(~is_held_out(F.col("doc_id"))), sample)
    return predict(docs, model).withColumn("held_out", is_held_out(F.col("doc_id")))


def keep_identified(docs: DataFrame, least: float = 0.34, sample: int = SAMPLE) -> DataFrame:
    """The documents with a language: those that are ``und``, or where no language has a share of ``least``, go.

    Each row is judged on its own text, so that repeated ids are no matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs.where(~is_held_out(F.col("doc_id"))), sample))
    at = docs.columns.index("text")

    def run(batches):
        logp = shared.value["logp"]
        for b in batches:
            for start, part in chunks(b.column(at)):
                keep = infer(part, logp).max(1, initial=0.0) >= least
                yield b.slice(start, len(part)).filter(pa.array(keep))
        release()

    return docs.mapInArrow(run, docs.schema)
