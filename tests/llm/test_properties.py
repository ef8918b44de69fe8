"""Properties over generated inputs."""

import io

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablelens.llm import bpe, common, ngram_join, warc
from tests.llm import helpers as H

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.Bpe(open(PATH, encoding="utf-8").read())
# Characters that this Python's Unicode tables know: newer ones differ between libraries.
KNOWN = st.characters(exclude_categories=("Cs", "Cn"))


@settings(max_examples=400, deadline=None)
@given(st.text(KNOWN, max_size=60))
def test_bpe_equals_the_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    got = OWN.encode_batch([text])[0]
    assert got.tolist() == ids
    assert OWN.decode(got) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text("abcdeinorst", min_size=1, max_size=80))
def test_merging_short_and_long_agree(word):
    ids = [OWN.vocab[s] for s in OWN.symbols(word)]
    assert OWN.merge(ids) == OWN._merge_long(ids)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aAbÉé \t\n\x0b\x1c\xa0"), max_size=60))
def test_shingles_are_those_of_the_rule(text):
    want = H.shingle_set(text)
    assert len(ngram_join.shingles(text)) == len(want)
    assert np.array_equal(ngram_join.shingles(text), ngram_join.shingles(text.replace("A", "a") + "  "))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.text(max_size=50), st.binary(max_size=300)), max_size=8), st.integers(1, 50))
def test_records_survive_any_cut(rows, cut):
    records = [warc.record(i, url, body, len(body), "d", "response", None) for i, url, body in rows]
    data = b"".join(map(warc.member, records))
    pieces = (data[k : k + cut] for k in range(0, len(data), cut))

    class Stream(io.RawIOBase):
        def read(self, n=-1):
            return next(pieces, b"")

    got = list(warc.split_records(warc.inflate(Stream())))
    assert got == records
    assert [warc.parse_record(r)[1] for r in got] == [body for _, _, body in rows]


def test_work_tables_go(spark):
    common.materialise(spark.range(3), "gone")
    assert common.remove_work_tables(spark, -1) >= 1
    assert common.remove_work_tables(spark, -1) == 0
