"""BPE encoding and decoding: speculate and verify.

A text is normalised and split into words as its tokenizer file says. Each new word is speculated on by greedy longest
match in the vocabulary. Such a split is what merging would give if each token merges to itself and every adjacent pair
is compatible, that is, no merge across their border would come before the merges that made the two. The pairs of all
new words of a batch are checked at once with arrays; only words with a failing pair are merged exactly. Words already
seen come from a bounded cache.

Nulls: a null text is an empty one, which has no ids and decodes to the empty text. Texts are encoded whole, of any
length. Empty tables give an empty result, repeated rows are encoded one by one, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import only, release

#: White space as the normaliser of the file takes it (the Unicode property).
SPACE = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
CACHE_WORDS = 400_000
NEVER = (1 << 31) - 1
#: Words of up to so many symbols are merged by scanning their pairs.
SHORT = 40
_NO_MERGE = (1 << 60, -1)


def byte_alphabet() -> list[str]:
    """A printable character for each byte, as byte-level vocabularies write it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(plain)))
    return [out[b] for b in range(256)]


class Bpe:
    """The tokenizer of one file of the word-end kind (lower case, white space dropped, ``</w>`` at word ends)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split.replace(r"[^\s", f"[^{SPACE}"))
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.alphabet = byte_alphabet()
        # The longest token by its first two characters bounds the search for a match.
        self.most: dict[str, int] = {}
        for t in self.vocab:
            self.most[t[:2]] = max(self.most.get(t[:2], 1), len(t))
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        n = max(self.tokens) + 1
        made = np.full(n, -1, np.int64)
        parts = np.full((n, 2), -1, np.int64)
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank.setdefault((x, y), (r, z))
            if made[z] < 0:
                made[z], parts[z] = r, (x, y)
        keys = np.array([(x << 32) | y for x, y in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.rank.values()], np.int64)[order]
        self.right, self.right_until = self._spine(made, parts, 1)
        self.left, self.left_until = self._spine(made, parts, 0)
        self.sound: dict[int, bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _spine(made: np.ndarray, parts: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """The pieces that lie at one end of each token while it is made, and the rank of the merge that ends each."""
        piece, until = [np.arange(len(made))], [np.full(len(made), NEVER, np.int64)]
        while True:
            last = piece[-1]
            nxt = np.where(last >= 0, parts[last, side], -1)
            if (nxt < 0).all():
                return np.stack(piece, 1).astype(np.int32), np.stack(until, 1).astype(np.int32)
            until.append(np.where(nxt >= 0, made[last], -1))
            piece.append(nxt)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge across the border of tokens ``a`` and ``b`` comes before those that end its two pieces.

        Of equal merges the leftmost comes first: a tie with the left piece's end is no conflict, one with the right's is.
        """
        ok = np.ones(len(a), bool)
        for i in range(self.right.shape[1]):
            x = self.right[a, i]
            for j in range(self.left.shape[1]):
                y = self.left[b, j]
                at = np.flatnonzero(ok & (x >= 0) & (y >= 0))
                if not len(at):
                    continue
                key = (x[at].astype(np.int64) << 32) | y[at]
                found = np.searchsorted(self.pair_keys, key)
                found[found == len(self.pair_keys)] = 0
                hit = self.pair_keys[found] == key
                r = self.pair_ranks[found]
                ok[at[hit & (r < self.right_until[a[at], i]) & (r <= self.left_until[b[at], j])]] = False
        return ok

    def symbols(self, word: str) -> list[str]:
        s = [self.alphabet[b] for b in word.encode("utf-8", "surrogatepass")]
        s[-1] += self.suffix
        return s

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equals."""
        if len(ids) > SHORT:
            return self._merge_long(ids)
        ids, get = list(ids), self.rank.get
        found = [get(pair, _NO_MERGE) for pair in pairwise(ids)]
        while found:
            best = min(found)
            if best is _NO_MERGE:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), _NO_MERGE)
            if i + 1 < len(ids):
                found[i] = get((ids[i], ids[i + 1]), _NO_MERGE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for words of any length."""
        n = len(ids)
        ids, nxt, prev, live = list(ids), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r[0], i, a, b) for i, (a, b) in enumerate(pairwise(ids)) if (r := self.rank.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if live[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i] = self.rank[a, b][1]
            live[j], nxt[i] = False, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for x, y in ((prev[i], i), (i, nxt[i])):
                if 0 <= x and y < n and (r := self.rank.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[y]))
        return [x for x, ok in zip(ids, live, strict=True) if ok]

    def exact(self, word: str) -> list[int]:
        return self.merge([self.vocab[s] for s in self.symbols(word)])

    def is_sound(self, token: int) -> bool:
        """The token's own text merges to it."""
        if (known := self.sound.get(token)) is None:
            text = self.tokens[token]
            body = text.removesuffix(self.suffix) if self.suffix else text
            s = list(body)
            if s and body != text:
                s[-1] += self.suffix
            known = self.sound[token] = bool(s) and all(x in self.vocab for x in s) and self.merge([self.vocab[x] for x in s]) == [token]
        return known

    def speculate(self, word: str) -> list[int] | None:
        """Greedy longest match; None if it gets stuck."""
        text = "".join(self.alphabet[b] for b in word.encode("utf-8", "surrogatepass"))
        n, at, out, vocab, most = len(text), 0, [], self.vocab, self.most
        while at < n:
            longest = most.get(text[at : at + 2], 1)
            # The last character belongs to a token with the suffix.
            if n - at == 1 or n - at <= longest:
                if (whole := vocab.get(text[at:] + self.suffix)) is not None:
                    out.append(whole)
                    return out
            for end in range(min(n - 1, at + longest), at, -1):
                if (t := vocab.get(text[at:end])) is not None:
                    out.append(t)
                    at = end
                    break
            else:
                return None
        return out

    def learn(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of new words: all pairs of the speculated splits are verified at once, failing words merged exactly."""
        words = list(words)
        guesses = [self.speculate(w) for w in words]
        good = np.array([g is not None and all(map(self.is_sound, g)) for g in guesses], bool)
        lengths = np.array([len(g) if ok else 0 for g, ok in zip(guesses, good, strict=True)])
        flat = np.fromiter(chain.from_iterable(g for g, ok in zip(guesses, good, strict=True) if ok), np.int64)
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(words)), lengths)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            pairs, back = np.unique((flat[inner] << 32) | flat[inner + 1], return_inverse=True)
            ok = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
            good[owner[inner[~ok]]] = False
        return {w: tuple(g if ok else self.exact(w)) for w, g, ok in zip(words, guesses, good, strict=True)}

    def pieces(self, text: str) -> list[tuple[str, list[str]]]:
        """(special token or '', words after it): special tokens are found in the raw text, before normalising."""
        if self.specials is None or "<|" not in text:
            return [("", self.words(text))]
        out, at, name = [], 0, ""
        for m in self.specials.finditer(text):
            out.append((name, self.words(text[at : m.start()])))
            name, at = m[0], m.end()
        out.append((name, self.words(text[at:])))
        return out

    def words(self, text: str) -> list[str]:
        """Words of a text in normal form C and lower case, letter by letter (so that final sigma is not special)."""
        return self.split.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.pieces(t) for t in texts]
        cache = self.cache
        new = {w for pieces in split for _, words in pieces for w in words if w not in cache}
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            new = {w for pieces in split for _, words in pieces for w in words}
        cache.update(self.learn(new))
        out = []
        for pieces in split:
            ids: list[int] = []
            for name, words in pieces:
                if name:
                    ids.append(self.special[name])
                ids.extend(chain.from_iterable(map(cache.__getitem__, words)))
            out.append(np.array(ids, "<u4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by spaces, as a file without a decoder asks for."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


_LOADED: dict[str, Bpe] = {}


def _bpe(source: str) -> Bpe:
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(source)
    return _LOADED[key]


#: Characters of text encoded at once.
CHUNK = 250_000


def _runs(texts: pa.Array) -> Iterable[list[str]]:
    """Texts in runs of about ``CHUNK`` characters, taken from the batch as they are needed."""
    part, size = [], 0
    for t in map(pa.StringScalar.as_py, texts):
        if part and size + len(t) > CHUNK:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with ``ids`` (little-endian unsigned 32-bit integers as bytes) and ``n_tokens``."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    d = only(docs, *carry, text).select(*[f"`{c}`" for c in carry], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema[: len(carry)])

    def run(batches):
        bpe = _bpe(shared.value)
        for b in batches:
            at = 0
            for part in _runs(b.column(len(carry))):
                found = bpe.encode_batch(part)
                cols = [b.column(i).slice(at, len(part)) for i in range(len(carry))]
                cols += [pa.array([x.tobytes() for x in found], pa.binary()), pa.array([len(x) for x in found], pa.int64())]
                at += len(part)
                yield pa.RecordBatch.from_arrays(cols, names=[*carry, "ids", "n_tokens"])
        bpe.cache.clear()
        release()

    return d.mapInArrow(run, f"{fields}, ids binary, n_tokens long")


def round_trip(docs: DataFrame, tokenizer_path: str, carry: tuple[str, ...] = ("doc_id",), keep_ids: bool = False) -> DataFrame:
    """Encode, decode the ids, and digest both: carried columns, n_tokens, ids_sha256, decoded_sha256 (and ids if asked for).

    Both happen in one pass, so that a task has one Python worker and ids don't travel between two.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    d = only(docs, *carry, "text").select(*[f"`{c}`" for c in carry], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema[: len(carry)])
    n = len(carry)

    def run(batches):
        bpe = _bpe(shared.value)
        for b in batches:
            at = 0
            # A batch goes out for each run of texts, so that ids of many rows are never held at once.
            for part in _runs(b.column(n)):
                found = bpe.encode_batch(part)
                raw = [ids.tobytes() for ids in found]
                decoded = [hashlib.sha256(bpe.decode(ids).encode()).hexdigest() for ids in found]
                cols = [b.column(i).slice(at, len(part)) for i in range(n)]
                cols += [pa.array([len(x) for x in found], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()), pa.array(decoded, pa.string())]
                cols += [pa.array(raw, pa.binary())] * keep_ids
                at += len(part)
                yield pa.RecordBatch.from_arrays(cols, names=[*carry, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids])
        bpe.cache.clear()
        release()

    return d.mapInArrow(run, f"{fields}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)
