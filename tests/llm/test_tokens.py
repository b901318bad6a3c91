import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from groundsieve.llm import packing, token_counts
from groundsieve.llm.bpe import WORDS, encoder
from groundsieve.llm.common import whole

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeABCéèßÖñ'sStl ΣσİĿ19½-_+.<|>#\n\t你好😀́ \x1c"), max_size=40))
def test_ids_and_counts_equal_the_library(text):
    bpe, words = encoder(PATH), WORDS.findall(text)
    want = library_ids(text)
    assert [i for w in words for i in bpe.ids(w)] == want
    assert sum(bpe.count(w) for w in words) == len(want)


@pytest.mark.parametrize("text", ["the theatre, don't stop", "a<|endoftext|>b <|startoftext|>", "été's 12½ 日本語テキスト", "x" * 70, "", "été"])
def test_every_prefix_count(text):
    table = token_counts.PrefixTable(text, PATH)
    counts = [len(library_ids(text[:k])) for k in range(len(text) + 1)]
    assert [table.tokens(k) for k in range(len(text) + 1)] == counts
    for budget in range(0, counts[-1] + 1):
        assert table.longest(budget) == max(k for k, c in enumerate(counts) if c <= budget)


def test_counts_on_odd_rows(put, odd):
    docs = put(odd).withColumn("tokens", F.lit("clash")).drop("tokens")
    got = token_counts.with_counts(docs.select("doc_id", whole().alias("text")), PATH, F.col("text"), limit=20).collect()
    assert len(got) == len(odd)
    for r in got:
        assert r.tokens.n_tokens == len(library_ids(r.text))
        assert len(library_ids(r.text[: r.tokens.limit_chars])) <= 20


def test_empty_table(put):
    assert token_counts.with_counts(put([]).select("text"), PATH, whole()).count() == 0
    assert packing.pack(packing.token_pieces(put([]), PATH, whole(), keep=["doc_id"])).count() == 0


def test_packing_is_a_round_trip(put, odd):
    docs = put([r for r in odd if r[0] is not None and r[0] != 4])
    got = packing.pack(packing.token_pieces(docs, PATH, whole(), keep=["doc_id"], capacity=512, with_ids=True), capacity=512).toPandas()
    for doc_id, g in got.groupby("doc_id"):
        g = g.sort_values("piece")
        text = next(r[1] for r in odd if r[0] == doc_id) or ""
        assert list(np.concatenate(list(g["ids"]))) == [*library_ids(text), 1]
        assert list(g.start) == [0, *np.cumsum(g.length)[:-1]] and (g.length.iloc[:-1] == 512).all()
        assert all(zlib.crc32(np.asarray(i, "<u4").tobytes()) == c for i, c in zip(g["ids"], g.ids_crc32))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 512
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 512) * 11 / 9 + 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_equals_the_one_by_one_rule(lengths):
    """Class by class, the number of sequences is that of best fit over the documents in descending order."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, g in enumerate(gaps) if g >= n]
        if fits:
            k = min(fits, key=lambda k: gaps[k])
            gaps[k] -= n
        else:
            gaps.append(30 - n)
    classes = {n: lengths.count(n) for n in lengths}
    segments, opened = packing.best_fit(classes, 30)
    assert opened == len(gaps) and segments[:, 5].sum() == len(lengths) if lengths else opened == 0


def test_vocabulary_marks_word_ends():
    with open(PATH, encoding="utf-8") as f:
        assert json.load(f)["model"]["end_of_word_suffix"] == "</w>"
