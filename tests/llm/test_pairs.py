import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundsieve.llm import decontaminate, fingerprints, jaccard
from groundsieve.llm.components import components
from tests.llm.conftest import prose


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    first = defaultdict(list)
    for (d, *_), x in zip(rows, label):
        first[x].append(d)
    return sorted((str(d), len(s), str(min((y for y in first[x] if y is not None), default=d) if s else d)) for (d, *_), s, x in zip(rows, sets, label))


def near(text, seed, edits):
    r, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.random():.6f}"
    return " ".join(w)


def family(seed, n, size=80):
    """Copies of copies: ends of the chain may not link, and sizes differ."""
    out = [prose(seed, size)]
    for k in range(n - 1):
        t = near(out[random.Random(seed + k).randrange(len(out))], seed * 1000 + k, 1)
        out.append(t + " tail" * (k % 3))
    return out


def test_components_equal_brute_force(put, odd, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "MEMBERS", 4)
    texts = family(1, 40) + family(2, 15, 30) + [prose(k, 12 + k) for k in range(100, 130)]
    passage = prose(77, 60)
    texts += [f"{passage} {prose(k, 20)}" for k in range(200, 225)] + ["a b c d", "A b  c d", "a b c e", "same words here"] * 2
    rows = odd + [(1000 + k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    got = jaccard.join_components(put(rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows)
    kept = jaccard.one_per_component(put(rows)).collect()
    groups = {c for d, n, c in brute_components(rows) if n}
    assert len(kept) == len(groups) + sum(n == 0 for _, n, _ in brute_components(rows))
    assert {str(r.doc_id) for r in kept if shingles(r.text)} == groups


def test_empty_join(put):
    assert jaccard.join_components(put([])).count() == 0 and jaccard.one_per_component(put([])).count() == 0


def test_tree_walk_equals_set_arithmetic():
    r = np.random.default_rng(2)
    hot = np.stack([np.arange(0, 60, 3, dtype=np.uint64), r.permutation(20).astype(np.uint64)])
    for _ in range(60):
        probe = np.unique(r.integers(0, 60, 40).astype(np.uint64))
        sets = [np.unique(np.append(r.choice(probe, r.integers(1, len(probe))), r.integers(0, 60, 4).astype(np.uint64))) for _ in range(25)]
        want = [9 * len(np.intersect1d(s, probe)) >= 4 * (len(s) + len(probe)) for s in sets]
        assert jaccard.tree_links(probe, sets, hot).tolist() == want


def test_bitmap_never_rules_out_a_link():
    r = np.random.default_rng(4)
    for _ in range(50):
        a = np.unique(r.integers(0, 1 << 60, 300).astype(np.uint64))
        b = np.unique(np.append(a[: r.integers(100, len(a))], r.integers(0, 1 << 60, 30).astype(np.uint64)))
        bits = [np.frombuffer(jaccard.bitmap(x), np.uint64) for x in (a, b)]
        may = bool(jaccard._may_link(np.array(len(a)), np.array(len(b)), *bits))
        assert may or 9 * len(np.intersect1d(a, b)) < 4 * (len(a) + len(b))


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(200, 199)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in range(61)} == {0} and {got[k] for k in range(100, 140)} == {100} and got[200] == 199


def test_fingerprints(put, odd, spark):
    docs = put(odd + [(500, prose(9, 300), "en", "a", 0), (501, near(prose(9, 300), 3, 2), "en", "a", 0), (502, prose(10, 300), "en", "a", 0)])
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    got = {r.row: r.bits for r in fingerprints.fingerprints(rows, "row", F.col("text")).collect()}
    by_id = {r.doc_id: got[r.row] for r in rows.collect()}
    assert len(got) == len(odd) + 3
    distance = lambda a, b: bin((by_id[a] ^ by_id[b]) & (1 << 64) - 1).count("1")
    assert distance(500, 501) < 16 < distance(500, 502)
    assert by_id[1] == by_id[2] == by_id[3] == 0


def test_fingerprint_votes(spark):
    terms = [(0, h) for h in (-1, 5, 5, 1 << 40)]
    bits = fingerprints.voted(spark.createDataFrame(terms, "row long, term long"), ["row"], "term").first().bits
    assert bits == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for _, h in terms) > 4)


@pytest.mark.parametrize("radius", [1, 3])
def test_block_tables_find_all_within_the_radius(spark, radius):
    r = random.Random(radius)
    base = [r.getrandbits(64) for _ in range(30)]
    every = {b ^ sum(1 << k for k in r.sample(range(64), r.randrange(0, 6))) for b in base for _ in range(12)}
    signed = [x - (1 << 64) * (x >> 63) for x in every]
    got = {(p.a, p.b) for p in fingerprints.within(spark.createDataFrame([(x,) for x in signed], "bits long"), radius).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= radius}


def test_successors(put):
    rows = [(k, "x", None, None, 1) for k in (5, 3, 9, 7)] + [(None, "y", None, None, 1), (3, "z", None, None, 1)]
    docs = put(rows).select(F.monotonically_increasing_id().alias("row"), "doc_id")
    got = fingerprints.successors(docs, "row", "doc_id").collect()
    ids = {r.row: r.doc_id for r in got}
    after = {r.row: r.next_row for r in got}
    at, order = next(k for k, d in ids.items() if d == 9), []
    for _ in ids:
        order.append(ids[at])
        at = after[at]
    assert order == [9, 7, 5, 3, 3, None] and ids[at] == 9


def test_edit_distance():
    def brute(p, t):
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            new = [0]
            for j in range(1, len(p) + 1):
                new.append(min(row[j - 1] + (p[j - 1] != c), row[j] + 1, new[j - 1] + 1))
            row, best = new, min(best, new[-1])
        return best

    r = random.Random(1)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    for _ in range(600):
        p, t = word(r.randrange(1, 90)), word(r.randrange(0, 120))
        assert decontaminate.myers(p, t)[0] == brute(p, t)


def test_decontamination(put, odd):
    item = prose(42, 40)
    inside = lambda t: f"{prose(1, 30)} {t} {prose(2, 30)}"
    rows = odd + [(100, inside(item), None, None, 0), (101, inside(item.upper().replace(" ", ",\n")), None, None, 0), (102, inside(near(item, 1, 1)), None, None, 0),
                  (103, inside(item[: len(item) // 2]), None, None, 0)]
    items = put([(1, item), (2, None), (3, ""), (4, "text without an id"), (1, item)], "item_id long, text string", "benchmark")
    got = {(r.doc_id, r.item_id): (r.distance, r.budget) for r in decontaminate.matches(put(rows), items).collect()}
    assert set(got) == {(100, 1), (101, 1), (102, 1), (None, 4)}
    assert got[(100, 1)][0] == got[(101, 1)][0] == 0 < got[(102, 1)][0]
    assert decontaminate.matches(put([]), items).count() == 0
    assert decontaminate.matches(put(rows), items.limit(0)).count() == 0


def test_pigeonhole_misses_nothing():
    r, item = random.Random(8), decontaminate.normal(prose(3, 30))
    of = decontaminate.Matcher([(1, item)], rate=0.08)
    k = int(0.08 * len(item))
    for n in range(0, k + 6):
        t = list(item)
        for _ in range(n):
            t[r.randrange(len(t))] = r.choice("abcdexyz")
        t = decontaminate.normal("qq " + "".join(t) + " qq")
        best = decontaminate.myers(item, t)[0]
        assert of(t) == ([(1, best, k)] if best <= k else [])
