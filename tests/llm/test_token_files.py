import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from groundsieve.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (63, 2), (64, 300), (511, 49_000), (512, 2), (5_000, 49_000), (4_000, 2**32 - 1)])
def test_wavelet_matrix_against_the_sequence(n, top):
    r = np.random.default_rng(n)
    tokens = (r.integers(0, top, n) if n % 2 else r.integers(0, min(top, 40), n)).astype(np.uint32)
    made = token_files.Shard(token_files.shard([5, None], [n // 2, n - n // 2], tokens, 0, 0))
    assert made.ids.to_pylist() == [5, None] and made.ends.tolist() == [n // 2, n]
    assert (made.tokens() == tokens).all()
    at = r.integers(0, max(n, 1), 300 if n else 0)
    assert (made.access(at) == tokens[at]).all()
    for token in [*np.unique(tokens)[:30].tolist(), 1, 7, 2**31]:
        low, high = sorted(r.integers(0, n + 1, 2).tolist())
        where = np.flatnonzero(tokens == token)
        assert made.occurrences(token).tolist() == where.tolist()
        assert made.count(token, low, high) == ((where >= low) & (where < high)).sum()


def library_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(library_ids, "own"):
        library_ids.own = Tokenizer.from_file(PATH)
    return [*library_ids.own.encode(text or "", add_special_tokens=False).ids, 1]


def expected(rows):
    """Ascending ids, nulls first; rows of one id by the crc32 of their text."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    start, out = 0, []
    for ident, text in rows:
        ids = library_ids(text)
        out.append((ident, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


STRANGE = ["a\x0bb\x0cc", "x y z\x85w", "\x1c\x1d ctrl", "<|endoftext|>mid<|startoftext|> <|end", "é É ΣΑΣ", "don't WE'LL 's", "123 4 5"]


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_round_trip_on_odd_rows(spark, put, odd, size):
    rows = odd + [(50 + k, t, None, None, None) for k, t in enumerate(STRANGE)]
    docs = put(rows).withColumn("sum", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("part", F.lit(2)).repartition(3)
    files = token_files.write(docs, PATH, tokens=size)
    found = [tuple(r) for r in token_files.texts(files).orderBy("start").collect()]
    assert found == expected([(r[0], r[1]) for r in rows])
    token = library_ids("the")[0]
    texts = [library_ids(r[1]) for r in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))]
    whole = [t for ids in texts for t in ids]
    places = [r.position for r in token_files.occurrences(files, token).orderBy("position").collect()]
    assert places == [k for k, t in enumerate(whole) if t == token]
    assert {r.token: r.n for r in token_files.counts(files, [token, 1, 48_000]).collect()} == {t: whole.count(t) for t in (token, 1, 48_000)}


def test_empty_table(spark, put):
    files = token_files.write(put([]), PATH)
    assert token_files.texts(files).count() == 0 and token_files.occurrences(files, 1).count() == 0


def test_query(spark, small):
    from groundsieve.llm.queries import op13_token_files

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in op13_token_files(spark, small).collect())
    assert found == expected(rows)
