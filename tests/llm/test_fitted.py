import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundsieve.llm import language, lm, quality
from groundsieve.llm.common import remainder, whole
from tests.llm.conftest import prose


def test_quality_learns_and_keeps_odd_rows(put, odd):
    good = [(k, prose(k, 40), "en", "a", 0) for k in range(100, 220)]
    bad = [(k, " ".join(w.upper() + "!!" for w in prose(k, 30).split()), "en", "a", 0) for k in range(300, 420)]
    docs = put(good + bad + odd)
    labels = put([(k, int(k < 300)) for k, *_ in good + bad] + [(None, 1), (1, None)], "doc_id long, quality int", "labels")
    weights = quality.train(docs, labels)
    rows = quality.with_score(docs, weights, whole()).select("doc_id", "text", "score").collect()
    assert len(rows) == len(good + bad + odd) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id and r.doc_id >= 100 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all((r.score > 0.5) == (r.doc_id < 300) for r in held)
    same = {r.text: r.score for r in rows}
    assert all(same[r.text] == r.score for r in rows)


def test_quality_without_labels(put, odd):
    weights = quality.train(put(odd), put([], "doc_id long, quality int", "labels"))
    assert {r.score for r in quality.with_score(put(odd), weights, whole()).collect()} == {0.5}


def test_gru_gradients_are_right():
    rng = np.random.default_rng(1)
    x, u, target = rng.normal(size=(4, 3, 6)), rng.normal(size=(2, 6)), rng.normal(size=(4, 3, 2))
    loss = lambda x, u: (language._states(x, u) * target).sum()
    kept = []
    language._states(x, u, kept)
    dx, du = language._back(target, u, kept)
    for a, d in ((x, dx), (u, du)):
        for at in [(0,) * a.ndim, tuple(n - 1 for n in a.shape)]:
            step = np.zeros_like(a)
            step[at] = 1e-6
            args = lambda s: (x + s, u) if a is x else (x, u + s)
            assert math.isclose((loss(*args(step)) - loss(*args(-step))) / 2e-6, d[at], rel_tol=1e-4, abs_tol=1e-7)


def test_language(put, odd):
    import random

    def text(k, syllables):
        r = random.Random(k)
        return " ".join("".join(r.choice(syllables) for _ in range(3)) for _ in range(30))

    a = [(k, text(k, ["the", "ing", "er", "wh"]), "en", "s", 0) for k in range(100, 160)]
    b = [(k, text(k, ["sch", "ung", "keit", "ö"]), "de", "s", 0) for k in range(200, 260)]
    docs = put(a + b + odd)
    model = language.train(docs)
    got = {(r.doc_id, r.text): r.language for r in language.with_language(docs, model, F.col("text")).collect()}
    assert sum(got[(k, t)].lang_pred == lang for k, t, lang, *_ in a + b) >= 118
    assert got[(1, None)].lang_pred == got[(2, "")].lang_pred == "und" and got[(2, "")].score == 0
    assert all(0 <= v.score <= 1 for v in got.values())
    nothing = language.train(put([(1, "abc", None, None, 3)]))
    assert language.with_language(put([(1, "abc", None, None, 3)]), nothing, F.col("text")).first().language.lang_pred == "und"


@pytest.mark.parametrize("share, block", [(lm.SHARE, lm.BLOCK), (20, 10_000), (1, 3_000)])
def test_lm_against_a_count(put, odd, share, block):
    """Whatever the block's size and the words held in memory: all, some, none."""
    rows = odd + [(k, prose(k, 50), "en", "a", 0) for k in range(20, 60)]
    docs = put(rows).select("doc_id", "text", (remainder("doc_id", 7) == 2).alias("held_out"))
    got = lm.scored(docs, "held_out", share, block).collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    tokens = lambda t: [*lm.words(t), lm.END]
    c = Counter(w for d, t, *_ in rows if not held(d) for w in tokens(t))
    total, kinds = sum(c.values()), len(c)
    want = sorted((str(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), round(sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in tokens(t)), 6))
                  for d, t, *_ in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {total} and all(r.score < 0 and math.isfinite(r.open_score) for r in got)


def test_spelling_is_a_distribution():
    rng = np.random.default_rng(0)
    cells, _ = lm.grams([b"abab", b"ba", b"abc"])
    found, n = np.unique(cells, return_counts=True)
    model, tables = lm.seat_bytes(found, n, None, None, rng)
    model, _ = lm.seat_bytes(found, n, model, tables, rng)
    assert np.allclose(model.parent.sum(1), 1)
    context = (found >> np.uint32(8)).astype(np.int64)
    for k in np.unique(context):
        assert math.isclose(model.direct[context == k].sum() + model.back[k], 1.0, rel_tol=1e-9)


def test_seating_follows_the_restaurant():
    rng = np.random.default_rng(3)
    t = lm.seated(np.full(4000, 12), np.full(4000, 2.0), 0.4, rng)
    exact = []
    for _ in range(4000):
        k = 1
        for n in range(1, 12):
            k += rng.random() < 2.0 / (2.0 + n - 0.4 * k)
        exact.append(k)
    assert abs(t.mean() - np.mean(exact)) < 0.1


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)]])
def test_lm_on_next_to_nothing(put, rows):
    docs = put(rows).select("doc_id", "text", F.lit(True).alias("held_out"))
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.scored(docs, "held_out").collect()] == [(1, 0, 0, 0.0)] * len(rows)


def test_lm_scores_depend_on_word_order(put):
    """Words in their usual order are likelier than the same words turned round; after any context all words add up to 1."""
    text = "red fox runs over blue hill near old mill"
    turned = " ".join(text.split()[::-1])
    docs = put([(k, text, "en", "a", 0) for k in range(40)] + [(100, text, "en", "a", 0), (101, turned, "en", "a", 0), (102, "", "en", "a", 0)])
    got = {r.doc_id: r for r in lm.scored(docs.select("doc_id", "text", (F.col("doc_id") >= 100).alias("held_out")), "held_out").collect()}
    assert got[100].base_score == pytest.approx(got[101].base_score) and got[100].n_known == got[101].n_known == 10
    assert got[100].score > got[101].score + 5


def test_lm_scores_do_not_depend_on_the_words_held_in_memory(put, odd):
    docs = put(odd + [(k, prose(k, 50), "en", "a", 0) for k in range(20, 60)]).select("doc_id", "text", (remainder("doc_id", 7) == 2).alias("held_out"))
    runs = [sorted((str(r.doc_id), r.n_tokens, round(r.score, 6), round(r.open_score, 6)) for r in lm.scored(docs, "held_out", share, 20_000).collect())
            for share in (1, 30, 1 << 40)]
    assert runs[0] == runs[1] == runs[2]


def test_lm_context_probabilities_add_up(put):
    """After a context, the seen words and that of meeting any word training lacks add up to 1."""
    texts = ["a b c a b", "b c c a", "c a b b", "a a b c"] * 5
    # held-out texts of one pair each: all words after b, and one word that training lacks
    held = [f"b {w}" for w in ("a", "b", "c", "zzz")] + ["b"]
    docs = put([(k, t, "en", "a", 0) for k, t in enumerate(texts)] + [(100 + k, t, "en", "a", 0) for k, t in enumerate(held)])
    docs = docs.select("doc_id", "text", (F.col("doc_id") >= 100).alias("held_out"))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "text", "held_out")
    made = lm.prepared(numbered, "held_out", share=1 << 40)  # all words are often met, so that all pairs are listed
    fitted = lm.fit(made.kept, made.table, made.slices, made.total)
    rows = lm.block_scores(made.kept, fitted, made.slices, 1, [(r["slice"], r.id) for r in made.often]).where("row < 0").collect()
    p = {(bytes(made.often[r.a].word), bytes(made.often[r.b].word)): 10**r.lp for r in rows}
    assert math.isclose(sum(p[b"b", w] for w in (b"a", b"b", b"c", b"zzz", lm.END)), 1.0, rel_tol=1e-6)


def test_quality_features_stay_off_the_driver(put, monkeypatch):
    """Trained in one task over the bounded sample, in the order of the id hash, without its features on the driver."""
    docs = put([(k, prose(k, 30), "en", "a", 0) for k in range(40)])
    labels = put([(k, k % 2) for k in range(40)], "doc_id long, quality int", "labels")
    texts = {r.doc_id: r.text for r in docs.collect()}

    def refused(*_, **__):
        raise AssertionError("rows of features were collected")

    monkeypatch.setattr(type(docs), "toPandas", refused)
    got = quality.train(docs, labels)
    usable = [k for k in range(40) if zlib.crc32(str(k).encode()) % 5]
    of = quality.Features()
    rows = [(i, v.astype(np.float32), k % 2) for k in sorted(usable, key=lambda k: quality._hash(str(k))) for i, v in [of(texts[k])]]
    want = quality.fit_ftrl(rows)
    assert np.count_nonzero(want) > 20 and np.array_equal(got, want)


def test_lm_partial_sums_are_packed(put):
    """A block gives one row a range of texts, not one a text."""
    docs = put([(k, prose(k, 4), "en", "a", 0) for k in range(500)]).select(F.monotonically_increasing_id().alias("row"), "text", F.lit(False).alias("held_out"))
    made = lm.prepared(docs, "held_out", share=1)
    sums = lm.block_scores(made.kept, lm.fit(made.kept, made.table, made.slices, made.total), made.slices, 1, [])
    assert sums.where("row >= 0").count() <= lm.CHUNKS * made.slices**3
    assert sorted((r.row, r.k) for r in lm.added(sums, made.slices).collect()) == sorted((r.row, len(lm.words(r.text)) + 1) for r in docs.collect())


def test_lm_tasks_hold_one_block_at_a_time(put, monkeypatch):
    """Blocks go to Python one by one where they are read; other jobs keep the session's batches."""
    docs = put([(k, prose(k, 4), "en", "a", 0) for k in range(50)]).select(F.monotonically_increasing_id().alias("row"), "text", F.lit(False).alias("held_out"))
    spark, name, seen = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, written = spark.conf.get(name), lm.written
    made = lm.prepared(docs, "held_out")
    monkeypatch.setattr(lm, "written", lambda df: seen.append(spark.conf.get(name)) or written(df))
    lm.block_scores(made.kept, lm.fit(made.kept, made.table, made.slices, made.total), made.slices, 1, [(r["slice"], r.id) for r in made.often])
    assert seen == ["1", "1"] and spark.conf.get(name) == before != "1"


def test_lm_tokens_of_a_batch_are_those_of_each_text():
    """Words are cut, lower-cased and counted by Arrow for many texts at once, by the same rule as for one."""
    texts = ["", None, "  a\x0bB \t\n\x0c\rc  ", "\u00dcn\u00ef \u00c9\x85x\u2003y\x00z\x1cq K\u0130", " ", "one", "\ta", "A B  C\n"]
    for chosen in (pa.array(texts), pa.array(["x", *texts]).slice(1), pa.array(texts)[:0]):
        found, length = lm.tokens(chosen)
        assert found.to_pylist() == [w for t in chosen.to_pylist() for w in lm.words(t)]
        assert length.tolist() == [len(lm.words(t)) for t in chosen.to_pylist()]


def test_lm_words_pass_through_tasks_as_arrow(put):
    """Jobs over texts and over all distinct words make no Python object a word."""
    docs = put([(k, prose(k, 20), "en", "a", 0) for k in range(30)]).select(F.monotonically_increasing_id().alias("row"), "text", F.lit(False).alias("held_out"))
    made = lm.prepared(docs, "held_out")
    counted, d = lm.seat(made.kept, made.table, made.slices, None, 0.5, 1)
    for df in (lm.payloads(docs, "held_out", made.slices, []), lm.sweep(counted.rows, lm.State(None, 0.0), None, d, 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "MapInPandas" not in plan


def test_lm_sweep_takes_spellings_from_the_state_before(put):
    """A sweep over the tables of a state finds the same cells whether spellings are read from that state or worked out."""
    docs = put([(k, prose(k, 20), "en", "a", 0) for k in range(30)]).select(F.monotonically_increasing_id().alias("row"), "text", F.lit(False).alias("held_out"))
    made = lm.prepared(docs, "held_out", block=100)
    assert made.slices > 1
    counted, d = lm.seat(made.kept, made.table, made.slices, None, 0.5, 1)
    state = lm.State(None, 3.0)
    level = lm.probabilities(counted.rows, state, d, 1.0, 2)
    read, direct = (sorted((r.cell, r.n) for r in lm.sweep(counted.rows, state, before, d, 3).collect()) for before in (level, None))
    assert len(read) > 20 and read == direct
