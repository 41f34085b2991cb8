import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from wellcut.llm import id_filter, line_dedup, near_dup, vector_dup

VOCAB = [a + b for a in "ba ke lo mi nu po ra se ti vu".split() for b in "da fe gi ho ju ka le mo".split()]


def sentence(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


# near-duplicate documents


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def components(ids, linked):
    low = {i: i for i in ids}
    while True:
        before = dict(low)
        for a, b in linked:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low


def brute(rows, width):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, width))
    ids = sorted(sets)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if any(x and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])]
    return components(ids, linked)


def copies(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.7:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                words[rng.randrange(len(words))] = rng.choice(VOCAB)
            t = " ".join(words)
            rows.append((i, t.upper() if rng.random() < 0.1 else t))
        else:
            rows.append((i, sentence(rng, rng.choice([1, 3, 40, 120, 400]))))
    return rows


@pytest.mark.parametrize(("width", "seed"), [(2, 1), (5, 2), (2, 3)])
def test_near_duplicates_against_brute_force(docs_of, odd, width, seed):
    rows = [(100 + i, t) for i, t in copies(seed)] + odd
    got = near_dup.near_duplicates(docs_of(rows), width).collect()
    want = brute(rows, width)
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(i) for i, _ in rows)
    texts = dict(rows)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
        assert r["n_shingles"] == len(shingles(texts[r["doc_id"]], width))


def test_links_that_no_centre_has_are_found(docs_of):
    """A chain of near copies: few are near to the smallest id, all are one component."""
    rng = random.Random(9)
    words = sentence(rng, 200).split(" ")
    rows = []
    for i in range(40):
        rows.append((1000 - i, " ".join(words)))
        for _ in range(3):
            words[rng.randrange(len(words))] = rng.choice(VOCAB)
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs_of(rows), 2).collect()}
    assert got == brute(rows, 2)


def test_blocks_of_a_bucket(docs_of, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rows = copies(5, 50)
    assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs_of(rows), 2).collect()} == brute(rows, 2)


def test_keep_leaves_one_row_of_each_component(docs_of, odd):
    rows = [(100 + i, t) for i, t in copies(6, 40)] + odd
    docs = docs_of(rows)
    out = near_dup.keep(docs, 2)
    want = brute(rows, 2)
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted([str(i) for i in want if want[i] == i] + ["None"])
    assert near_dup.keep(docs.limit(0), 2).count() == 0 and near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_keep_is_the_same_however_rows_are_dealt(spark, docs_of):
    """Ids that repeat with the same and with other texts, and columns with the operators' own names."""
    rng = random.Random(12)
    some = [sentence(rng, 40) for _ in range(3)]
    rows = [(1, some[0]), (1, some[0]), (1, some[1]), (2, some[1]), (3, some[2]), (3, None), (3, None)]
    docs = docs_of(rows).withColumns({c: F.lit("x") for c in ("wc__filter_h", "wc__filter_null", "gone", "row", "a")}).withColumn("m", F.create_map(F.lit("k"), F.monotonically_increasing_id()))
    found = [sorted((r["doc_id"], r["text"] or "", str(r["m"])) for r in near_dup.keep(docs.repartition(n, "m"), 2).collect()) for n in (1, 5)]
    assert found[0] == found[1]
    assert [x[:2] for x in found[0]] == sorted([(1, some[0]), (1, some[1]), (3, some[2]), (3, "")])


def test_ids_beyond_the_filter_are_joined(docs_of, odd, monkeypatch):
    monkeypatch.setattr(id_filter, "MOST_BITS", 8)
    rows = [(100 + i, t) for i, t in copies(4, 40)] + odd
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs_of(rows), 2).collect()}
    assert got.pop(None) is None and got == brute(rows, 2)
    clear, rest = id_filter.split_by_ids(docs_of(rows), docs_of(rows[:7]))
    assert {r["doc_id"] for r in rest.collect()} == {i for i, _ in rows[:7]} and clear.count() + rest.count() == len(rows)


def test_odd_sketch_estimates():
    rng = np.random.default_rng(3)
    for j in (0.8, 0.9, 0.97):
        lost = 0
        for _ in range(60):
            n = 600
            common = int(2 * n * j / (1 + j))
            base = rng.integers(0, 1 << 62, 2 * n - common).astype(np.uint64)
            a, b = near_dup.samples(base[:n]), near_dup.samples(base[n - common :])
            flips = int(np.bitwise_count((near_dup.odd_sketch(a) ^ near_dup.odd_sketch(b)).view(np.uint64)).sum())
            lost += flips > near_dup.most_flips(80) or not (near_dup.band_keys(a) == near_dup.band_keys(b)).any()
        assert lost == 0


# embeddings


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 24))
    near = base[rng.integers(0, 40, 300)] + rng.normal(size=(300, 24)) * rng.choice([0.0, 0.05, 0.2, 0.33], 300)[:, None]
    x = np.concatenate([base, near]).astype(np.float32)
    rows = [(int(i), [float(v) for v in x[k]], 1) for k, i in enumerate(rng.permutation(len(x)))]
    rows += [rows[0], (5000, None, 1), (5001, [0.0] * 24, 1), (5002, [float("nan")] * 24, 1), (5003, [None] * 24, 1), (5004, [], 1), (5005, [1.0, 2.0], 1), (5006, [float("inf")] * 24, 1), (None, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")
    got = vector_dup.near_vectors(df).collect()
    assert len(got) == len(rows)
    ids = np.array([r[0] for r in rows[:700]])
    u = np.array([r[1] for r in rows[:700]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    low = components(ids.tolist(), [(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)])
    want = {int(i): (int(near[k].sum()) - 1, low[int(i)]) for k, i in enumerate(ids)}
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}
    links = sum(n for n, _ in want.values())
    assert all(found[i][0] <= want[i][0] for i in want) and sum(found[i][0] for i in want) >= 0.99 * links
    assert sum(found[i] == want[i] for i in want) >= 0.98 * len(want)
    assert all(found[i] == (0, i) for i in range(5000, 5007)) and found[None] == (0, None)


def test_vectors_of_every_length_link(spark):
    """16 components mostly; 8 and 3 seldom; the same direction in another length is no link."""
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for dim, n in ((16, 60), (8, 4), (3, 2)):
        for _ in range(n):
            x = rng.normal(size=dim)
            low = len(rows)
            for k in range(2):
                want[len(rows)] = (1, low)
                rows.append((len(rows), [float(v) for v in x * (1 + k)]))
    want[len(rows)] = (0, len(rows))
    rows.append((len(rows), [1.0, 0.0, 0.0, 0.0]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dup.near_vectors(df, 0.99999).collect()}
    assert got == want


def test_hot_leaf_is_split_and_counts_once(spark, monkeypatch):
    monkeypatch.setattr(vector_dup, "BLOCK", 16)
    rng = np.random.default_rng(6)
    x = np.r_[rng.normal(size=(1, 16)) + 0.01 * rng.normal(size=(90, 16)), rng.normal(size=(60, 16))]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in vector_dup.near_vectors(df).collect()}
    assert vector_dup.near_vectors(df.limit(0)).count() == 0
    assert all(got[i]["n_links"] == 89 and got[i]["component_id"] == 0 for i in range(90)) and all(got[i]["kept"] for i in range(90, 150))


# lines


def windows(lines, least):
    out = []
    for s in range(len(lines)):
        n = 0
        for t in range(s, len(lines)):
            n += len(lines[t])
            if n >= least:
                out.append((s, t, tuple(lines[s : t + 1])))
                break
    return out


def check_lines(rows, got, least):
    """Lines of windows that occurred before are gone; what is gone occurred before; first occurrences stay."""
    seen, earlier = set(), set()
    for i, t in sorted((r for r in set(rows) if r[0] is not None), key=lambda r: r[0]):
        lines = [x for x in (tuple(y.encode().split()) for y in (t or "").split("\n")) if x]
        must = set()
        for s, e, k in windows(lines, least):
            if k in seen:
                must.update(range(s, e + 1))
            seen.add(k)
        left = [x for x in (tuple(y.encode().split()) for y in (got[i]["text"] or "").split("\n")) if x]
        assert got[i]["n_lines"] == len(lines) and got[i]["n_removed"] == len(lines) - len(left)
        at, gone = 0, []
        for k, x in enumerate(lines):  # what is left is a part of the lines, in order; the longest runs go
            if at < len(left) and left[at] == x and k not in must:
                at += 1
            else:
                gone.append(k)
        assert at == len(left)
        own = {}
        for k, x in enumerate(lines):
            if k in gone:
                assert x in earlier or own.get(x, 0) > 0
            own[x] = own.get(x, 0) + 1
        earlier.update(lines)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup_against_brute_force(docs_of, odd, seed):
    rng = random.Random(seed)
    pool = [[sentence(rng, rng.choice([1, 3, 8, 20, 30, 55])) for _ in range(rng.randrange(1, 6))] for _ in range(8)]
    rows = []
    for i in range(70):
        lines = []
        for _ in range(rng.randrange(0, 5)):
            lines += rng.choice(pool) if rng.random() < 0.5 else [sentence(rng, rng.choice([2, 9, 33, 70]))]
            if rng.random() < 0.2:
                lines.append(rng.choice(["", "  ", "\t"]))
        rows.append((100 + i, "\n".join(lines)))
    rows += odd
    got = line_dedup.line_dedup(docs_of(rows)).collect()
    assert len(got) == len(rows)
    check_lines(rows, {r["doc_id"]: r for r in got}, 50)


def test_passage_goes_from_later_documents_only(docs_of):
    rng = random.Random(8)
    passage = sentence(rng, 60)
    rows = [(i, "\n".join([sentence(rng, 30), passage, sentence(rng, 20)])) for i in range(30)]
    docs = docs_of(rows)
    out = line_dedup.keep_first(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert passage in got[0] and not any(passage in got[i] for i in range(1, 30))
    assert all(got[i].split("\n") == [x for x in rows[i][1].split("\n") if x != passage] for i in range(1, 30))
    assert line_dedup.keep_first(docs.limit(0)).count() == 0
    # columns that the operator adds are replaced
    assert sorted(line_dedup.dedup(docs).columns) == sorted([c for c in docs.columns if not c.startswith("wc__")] + ["wc__n_lines", "wc__n_removed"])


def test_short_repeats_stay(docs_of):
    rows = [(i, f"All rights reserved.\n{' '.join(f'w{i}x{k}' for k in range(70))}") for i in range(5)]
    assert all(r["n_removed"] == 0 for r in line_dedup.line_dedup(docs_of(rows)).collect())
