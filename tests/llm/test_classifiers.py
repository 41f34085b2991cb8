import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellcut.llm import licenses, quality_model, toxicity

WORDS = [a + b for a in "ba ke lo mi nu po ra se ti vu".split() for b in "da fe gi ho ju ka le mo".split()]


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(20, 120))]
        toxic, junk = rng.random() < 0.15, rng.random() < 0.2
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vilest,", "Vilely", "vilesome"]))
        if junk:
            words = [w + rng.choice(["$$$", "###"]) for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = corpus()
    return rows, labels, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def auc(pairs):
    y, s = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])
    return float(np.mean([(p > q) + 0.5 * (p == q) for p in s[y == 1] for q in s[y == 0]]))


def held(i, n, r):
    return zlib.crc32(str(i).encode()) % n == r


def test_toxicity(spark, docs_of, odd, labelled):
    rows, labels, table = labelled
    docs = docs_of(rows + [(10_000 + (i or 0), t) for i, t in odd])
    got = toxicity.toxicity(docs, table).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == held(r["doc_id"], 3, 1) for r in got)
    by, y = {r["doc_id"]: r for r in got}, {i: t for i, _, t in labels}
    out = [(y[i], by[i]["score"]) for i in y if by[i]["held_out"]]
    assert auc(out) > 0.97
    assert np.mean([(s >= 0.7) == (t == 1) for t, s in out]) > 0.95
    kept = toxicity.keep(docs, table)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if not r["predicted"])


def test_toxicity_learns_no_held_out_label(docs_of, labelled):
    rows, _, table = labelled
    other = table.withColumn("toxic", F.when(toxicity.remainder("doc_id", 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(toxicity.toxicity(docs_of(rows), t).collect()) for t in (table, other))
    assert a == b


def test_toxicity_without_labels(docs_of, labelled):
    rows, _, table = labelled
    assert {r["score"] for r in toxicity.toxicity(docs_of(rows[:20]), table.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(docs_of([]), table).count() == 0


def test_non_negative_risk_beats_ignoring_the_prior():
    rng = np.random.default_rng(0)
    pos = (rng.random((400, 20)) < np.r_[np.full(5, 0.7), np.full(15, 0.3)]).astype(np.float32)
    neg = (rng.random((800, 20)) < 0.3).astype(np.float32)
    unl = np.concatenate([neg[:600], pos[:200]])
    w, b = toxicity.train_nnpu(pos[200:], unl, 0.25)
    z = np.concatenate([pos[:200], neg[600:]]) @ w + b
    assert auc([(i < 200, v) for i, v in enumerate(z)]) > 0.85 and (w[:5] > 0).all()


def test_quality(spark, docs_of, odd, labelled):
    rows, labels, table = labelled
    docs = docs_of(rows + [(10_000 + (i or 0), t) for i, t in odd])
    got = quality_model.quality(docs, table).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == held(r["doc_id"], 5, 0) for r in got)
    by, y = {r["doc_id"]: r for r in got}, {i: q for i, q, _ in labels}
    out = [(y[i], by[i]["score"]) for i in y if by[i]["held_out"]]
    assert auc(out) > 0.97 and np.mean([(s >= 0.3) == (t == 1) for t, s in out]) > 0.95
    assert quality_model.quality(docs_of([]), table).count() == 0
    assert {r["score"] for r in quality_model.quality(docs_of(rows[:9]), table.where("quality = 1")).collect()} == {0.5}


def test_contexts_against_brute_force():
    rng = np.random.default_rng(1)
    codes = quality_model.index_codes(50, 8)
    index, want = np.zeros((50, 8)), np.zeros((50, 8))
    for code in codes:
        for k, c in enumerate(code):
            index[k, c % 8] += -1 if c >= 8 else 1
    ids = [rng.integers(0, 50, n).astype(np.int32) for n in (0, 1, 2, 30)]
    got = quality_model.contexts(ids, codes, 8)
    for d in ids:
        for i, k in enumerate(d):
            for j in range(max(0, i - quality_model.REACH), min(len(d), i + quality_model.REACH + 1)):
                if j != i:
                    want[k] += index[d[j]]
    assert np.allclose(got, want)


def test_rows_of_pieces(monkeypatch):
    text = "Ab1 ab,, ab,,\n été 12 ab  ".encode() + b"y" * 300 + b" ab"
    ids = quality_model.bucket_ids(text)
    ab, comma, e = ids[2], ids[3], ids[6]
    assert len(ids) == 11 and ids[4] == ids[8] == ids[10] == ab and ids[5] == comma and len({ids[0], ids[1], ab, comma, e, ids[7], ids[9]}) == 7
    monkeypatch.setattr(quality_model, "BLOCK_BYTES", 3)
    assert (quality_model.bucket_ids(text) == ids).all()
    assert not len(quality_model.bucket_ids(None)) and not len(quality_model.bucket_ids(b" \n"))


def test_pooling_in_blocks(monkeypatch):
    vectors = np.random.default_rng(2).normal(size=(quality_model.BUCKETS, quality_model.DIM)).astype(np.float32)
    text = " ".join(WORDS[:50]).encode()
    want, v = quality_model.pool(text, vectors), vectors[quality_model.bucket_ids(text)]
    assert np.allclose(want, np.concatenate([v.mean(0), v.std(0), np.abs(np.diff(v, axis=0)).mean(0)]), atol=1e-5)
    monkeypatch.setattr(quality_model, "POOL", 7)
    assert np.allclose(quality_model.pool(text, vectors), want, atol=1e-5) and not quality_model.pool(None, vectors).any()


def test_sums_are_the_same_however_rows_are_dealt(docs_of):
    rows, _ = corpus(200)
    ids = [quality_model.bucket_ids(t.encode()) for _, t in rows]
    want = quality_model.contexts(ids, quality_model.index_codes())
    for parts in (1, 5, 40):  # 40: more than FAN parts
        assert (quality_model.context_sums(docs_of(rows).repartition(parts)) == want).all()


def test_licenses(spark, docs_of, odd):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(5, 40)))
    rows, want = [], {}
    for i in range(300):
        lines = [text() for _ in range(3)]
        if i % 3 == 0:
            f = rng.choice(licenses.FAMILIES)
            lines.insert(1, rng.choice(licenses.NOTICES[f]))
            want[i] = f
        rows.append((i, "\n".join(lines)))
    rows += [(1000, "the software license of my car was copied without version"), (1001, "Licensed under the Apache License, Version 2.0." + " x" * 3)]
    docs = docs_of(rows + [(2000 + (i or 0), t) for i, t in odd])
    found = licenses.scan(docs, licenses.train(docs))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))
    got = {r["doc_id"]: r for r in found.collect()}
    families = {i: [x["family"] for x in r["licenses"]] for i, r in got.items()}
    right = sum(families[i] == [f] for i, f in want.items())
    assert right >= 0.95 * len(want)
    assert all(not families[i] for i in range(300) if i not in want) and not families[1000] and families[1001] == ["apache"]
    assert all(x["probability"] >= 0.6 and x["overlap"] >= 0.6 for r in got.values() for x in r["licenses"])
    assert got[2001]["n_paragraphs"] == got[2002]["n_paragraphs"] == got[2003]["n_paragraphs"] == 0 and got[0]["n_paragraphs"] == 2
    assert licenses.scan(docs.limit(0), licenses.train(docs.limit(0))).count() == 0
