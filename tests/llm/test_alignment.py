import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from groundsieve.llm import alignment
from groundsieve.llm.bpe import _byte_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def groups_of(text):
    """Groups of one whole text, by the libraries' own encodings of all of it."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(groups_of, "both"):
        a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        a.encode_special_tokens = True
        groups_of.both = a, b
    a, b = groups_of.both
    if not text:
        return None
    byte_of = _byte_of()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
        out.append((ids_a[i:k], ids_b[j:m]))
        i, j = k, m
    return out


def brute(rows):
    cut = [groups_of(t) for _, t in rows]
    links = [Counter((x, y) for a, b in (g or []) for x in a for y in b) for g in cut]
    count = Counter(p for c in links for p in c)
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    for (ident, _), g, c in zip(rows, cut, links):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g) if g else None
        yield (ident, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), c.total(),
               sum(k for p, k in c.items() if count[p] == top[p[0]]), sum(k * count[p] for p, k in c.items()),
               hashlib.sha256(said.encode()).hexdigest() if said is not None else "")


FIELDS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["a  b", " lead", "trail ", "x\ny", "x\n\ny", "x \ny", "\nfirst", "tab\tand nbsp em", "1234 56 it's we'll", "<|endoftext|> <s> </s> <0x41>",
       "▁mark", "a▁b", "\r\n x", "\x1c y", "﻿bom é \u0000 nul", "don’t \U0001f600\U0001f600 你好", "   ", "\n", " "]


def key(r):
    return (r[0] is None, r[0] or 0, r[7], r)


def test_chunks_agree_with_whole_texts():
    own = alignment.encoders(A, B)
    for text in ODD + [x + y for x in ODD for y in ODD]:
        cut, whole = own.chunks(text), groups_of(text)
        assert "".join(c if c[:1] in (" ", "\n") else " " + c for c in cut) == " " + text
        own.learn([c for c in dict.fromkeys(cut) if c not in own.known])
        at = [own.known[c] for c in cut]
        assert all(own.good[k] for k in at) == (whole is not None), text
        if whole is not None:
            assert [own.n_a[k] for k in at] and ";".join(own.said[k] for k in at) == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in whole), text


@pytest.mark.parametrize("words, parts", [(1 << 20, 1), (50, 1), (1 << 20, 3)])
def test_equals_brute_force(spark, put, odd, monkeypatch, words, parts):
    """Blocks of any size give the same sums; repeated rows, nulls and odd texts included."""
    rows = odd + [(100 + k, t, None, None, None) for k, t in enumerate(ODD)] + [(200 + k, "the same words again and again", None, None, None) for k in range(9)]
    docs = put(rows).withColumn("pair", F.lit("clash")).withColumn("block", F.lit(None).cast("int"))
    monkeypatch.setattr(alignment, "WORDS", words)
    found = [tuple(r[c] for c in FIELDS) for r in alignment.aligned(docs if parts == 1 else docs.repartition(parts), A, B).collect()]
    assert sorted(found, key=key) == sorted(brute([(r[0], r[1]) for r in rows]), key=key)


def test_dense_planes_and_multiplicities():
    """Bitmaps of both forms, every multiplicity digit, and their inverse."""
    r = np.random.default_rng(3)
    codes = np.concatenate([np.full(30_000, 7), np.full(9_000, 9), r.integers(0, 50, 4_000)])
    slots = np.concatenate([r.integers(0, 9_000, 30_000), np.arange(9_000), r.integers(0, 60_000, 4_000)])
    made = alignment.pair_rows(codes, slots)
    held = Counter(zip(codes.tolist(), slots.tolist()))
    back = Counter()
    for pair, docs, links, planes in zip(*(made[c] for c in ("pair", "n_docs", "n_links", "planes"))):
        found, n = alignment.plane_slots(planes.values)
        at = 0
        for digit, k in enumerate(n.tolist()):
            for s in found[at : at + k].tolist():
                back[pair.as_py(), s] += 1 << digit
            at += k
        assert docs.as_py() == sum(p == pair.as_py() for p, _ in held)
        assert links.as_py() == sum(k for (p, _), k in held.items() if p == pair.as_py())
    assert back == held
    assert len(alignment.pair_rows(np.zeros(0, np.int64), np.zeros(0, np.int64))["pair"]) == 0


def test_pair_scores(spark, put):
    docs = put([(k, t, None, None, None) for k, t in enumerate(["low lower low", "low", "new newer"])])
    pairs = {(r.a, r.b): (r.n_docs, r.n_links) for r in alignment.pair_scores(alignment.index(docs, A, B)).collect()}
    links = [Counter((x, y) for a, b in groups_of(t) for x in a for y in b) for t in ["low lower low", "low", "new newer"]]
    assert pairs == {p: (sum(p in c for c in links), sum(c[p] for c in links)) for p in set().union(*links)}


def test_empty_table(spark, put):
    assert alignment.aligned(put([]), A, B).count() == 0


def test_query(spark, small):
    from groundsieve.llm.queries import op11_tokenizer_alignment

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r[c] for c in FIELDS) for r in op11_tokenizer_alignment(spark, small).collect()) == sorted(brute(rows))
