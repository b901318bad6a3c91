import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from groundsieve.llm import licenses, secrets
from groundsieve.llm.common import whole
from tests.llm.conftest import prose

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|(?ai:passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def key(seed, n, alphabet="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
    r = random.Random(seed)
    return "".join(r.choice(alphabet) for _ in range(n))


@pytest.fixture(scope="module")
def texts(odd):
    hexa = key(1, 40, "0123456789abcdef")
    return odd + [(100, f"é token = \"{hexa}\" and password: token: abcdefgh", None, None, 0), (101, f"AKIA{key(2, 16, 'ABCDEFGH234567')} AKIAAKIA AKIA{'X' * 30}", None, None, 0),
                  (102, f"{hexa} {hexa}\nApi_Key='x' APIKEY : 'longer_value.1' ſecret=abcdefg", None, None, 0), (103, f"see {key(3, 40)} here 😀 {key(4, 48)}", None, None, 0),
                  (104, "1a" * 30 + " version2version2version2version2", None, None, 0), (105, "token=abcdef " * 400, None, None, 0)]


def test_base_spans_equal_brute_force(put, texts):
    got = secrets.find(put(texts), whole(), keep=["doc_id", "text"]).collect()
    assert len(got) == len(texts)
    for r in got:
        assert [tuple(s) for s in r.base] == brute_spans(r.text or "")
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    spans = {r.doc_id: r.spans for r in got}
    assert [s.kind for s in spans[103]] == [3, 3] and not [s for s in spans[104] if s.kind == 3]


def test_both_ways_agree_and_redaction(put, texts):
    one = {(r.doc_id, r.text): r.spans for r in secrets.find(put(texts), whole(), keep=["doc_id", "text"]).collect()}
    rows = secrets.find_wide(put(texts), whole(), keep=["doc_id", "text"]).withColumn("clean", secrets.redacted(whole(), F.col("spans"))).collect()
    for r in rows:
        assert one[(r.doc_id, r.text)] == r.spans
        text, want, at = r.text or "", "", 0
        for s in r.spans:
            if s.start >= at:
                want += text[at : s.start] + "[SECRET]"
            at = max(at, s.end)
        assert r.clean == want + text[at:]
    assert secrets.find(put([]), whole(), keep=["doc_id"]).count() == 0


def test_battery_levels(put):
    """About the stated share of uniform runs is rejected at 5 %, and text is rejected."""
    runs = [(k, key(k, 40), None, None, 0) for k in range(300)] + [(1000, "abab" * 10 + "1", None, None, 0)]
    kind = secrets.encoding(F.col("text"))
    got = put(runs).select("doc_id", secrets.battery(F.col("text"), kind).alias("p")).collect()
    assert sum(r.p < 0.05 for r in got if r.doc_id < 300) < 30
    assert next(r.p for r in got if r.doc_id == 1000) < 1e-3


def test_licences(put, odd):
    rows = odd + [(k, prose(k, 80).replace(" of ", "\n"), "en", "a", 0) for k in range(100, 200)]
    rows += [(300, f"{prose(3, 20)}\nReleased under the MIT License.\n{prose(4, 10)}", None, None, 0), (301, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0!", None, None, 0),
             (302, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that", None, None, 0)]
    docs = put(rows)
    found = licenses.scan(docs, licenses.train(docs), keep=["doc_id"]).collect()
    named = {(r.doc_id, r.paragraph): r.family for r in found if r.family != "unknown"}
    assert named == {(300, 1): "MIT", (301, 0): "Apache-2.0", (302, 0): "BSD"}


def pipeline_tables(at, spark, odd):
    from tests.llm.conftest import SCHEMA

    good = [(k, prose(k, 60), "en", "s", 0) for k in range(100, 180)]
    bad = [(k, " ".join(w.upper() + "!!" for w in prose(k, 30).split()), "en", "s", 0) for k in range(300, 380)]
    item = prose(999, 40)
    extra = [(400, prose(100, 60), "en", "s", 0), (401, f"{prose(401, 30)} {item}", "en", "s", 0), (402, f"{prose(402, 50)} token = {'0a1b2c3d' * 5}", "en", "s", 0)]
    spark.createDataFrame(good + bad + extra + odd, SCHEMA).withColumn("tokens", F.lit(1)).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, int(k < 300), 0) for k, *_ in good + bad], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")


def test_pipeline(spark, odd, tmp_path):
    pipeline_tables(tmp_path, spark, odd)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen[name] = docs
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = lambda name: {r.doc_id for r in seen[name].select("doc_id").collect()}
    assert set(range(100, 180)) <= ids("quality_classifier") and not ids("quality_classifier") & set(range(300, 380))
    assert 400 not in ids("ngram_jaccard_join") and set(range(100, 180)) <= ids("ngram_jaccard_join")
    assert ids("ngram_jaccard_join") - ids("benchmark_decontamination") == {401}
    clean = {r.doc_id: r.text for r in seen["secret_scan"].collect()}
    assert "0a1b" not in clean[402] and clean[402].endswith("[SECRET]") and clean[100] == prose(100, 60)
    packed = seen["best_fit_packing"].toPandas()
    assert set(packed.doc_id.dropna()) == {d for d in ids("secret_scan") if d is not None}
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(packed)


@pytest.mark.parametrize("name", ["op1_fingerprints", "op3_license_scan", "op5_quality_classifier", "op6_secret_scan", "op8_token_counts"])
def test_queries_on_odd_rows(spark, odd, tmp_path, name):
    pipeline_tables(tmp_path, spark, odd)
    rows = entry.queries()[name](spark, str(tmp_path)).collect()
    assert name == "op3_license_scan" or len(rows) == 163 + len(odd)
    if name == "op1_fingerprints":
        texts = sorted(((r.doc_id is None, -(r.doc_id or 0)), r.text or "") for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect())
        after = {}
        for (k, t), (_, u) in zip(texts, texts[1:] + texts[:1]):
            after.setdefault(k, []).append(hashlib.sha256((t[: len(t) - len(t) // 3] + u[: len(t) // 3]).encode()).hexdigest())
        assert all(r.edited_sha256 in after[(r.doc_id is None, -(r.doc_id or 0))] for r in rows if r.doc_id != 4)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_a_piece_of_a_notice_does_not_raise_the_floor(spark, size):
    """The line has no cue word, so a small sample holds it; it is found as unknown whatever the table's size."""
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet").select("doc_id", "text")
    said = "All rights reserved."
    want = sum(line == said for r in docs.where(docs.text.contains(said)).collect() for line in r.text.split("\n"))
    found = licenses.scan(docs, licenses.train(docs), ["doc_id"]).where("family = 'unknown'").count()
    assert found >= want > 0
