import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from wellcut.llm.queries import QUERIES
from wellcut.llm.sql import ORACLE_SQL
from wellcut.llm import near_dup, packing, quality_rules
from wellcut.session import stored, table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, last = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "line_dedup", "near_dup", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        n = docs.count()
        assert docs.columns == columns and 0 < n <= last
        assert n == last if name == "line_dedup" else True
        last = n
    assert docs.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.packing_stage(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == last


def test_stages_on_odd_rows(spark, docs_of, odd):
    """Nulls, empty and long texts, repeated rows, clashing names; and tables without rows."""
    prose = " ".join(f"word{i} of prose" for i in range(40))
    docs = docs_of([*odd, (20, prose), (21, prose), (22, prose + " more"), (22, prose + " more"), (None, prose), (23, "short\n" + prose)])
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        made, none = stage(spark, docs, SF), stage(spark, empty, SF)
        rows = made.collect()
        assert none.count() == 0 and none.columns == made.columns
        if name == "packing":
            assert len(rows) >= docs.count()
            continue
        assert made.columns == docs.columns
        left = sorted((str(r["doc_id"]), r["text"] or "") for r in rows)
        if name == "quality_rules":
            assert left == sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect() if r["text"] and len(r["text"].split()) >= 50 and quality_rules.measure(r["text"].encode())[4] * 2 <= len(r["text"].split()))
        elif name == "toxicity":
            assert len(left) <= docs.count() and set(left) <= {(str(r["doc_id"]), r["text"] or "") for r in docs.collect()}
        elif name == "line_dedup":
            gone = {i for (i, t), (_, u) in zip(sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect()), left, strict=True) if t != u}
            assert gone == {"21", "23"}
        else:
            assert sorted(i for i, _ in left) == sorted(["1", "2", "3", "4", "5", "6", "7", "20", "None", "None"])


def test_run_against_the_stages_one_by_one(spark):
    """The rows of run() are those of the stages' own operators, by brute force where that is quick: rules, sets and packing."""
    docs = table(spark, SF, "documents")
    kept = {r["doc_id"] for r in quality_rules.keep(docs, "v1").select("doc_id").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    few = lambda t: len((t or "").encode().split()) < 50
    assert kept <= {i for i, t in texts.items() if not few(t)}
    clean = corpus_pipeline.line_stage(spark, corpus_pipeline.toxicity_stage(spark, quality_rules.keep(docs, "v1"), SF), SF)
    sets = {r["doc_id"]: set(near_dup.shingle_set((r["text"] or "").encode(), 5, {}).tolist()) for r in clean.collect()}
    low = {i: i for i in sets}
    changed = True
    while changed:  # components of all pairs
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == {i for i in low if low[i] == i}
    used = {}
    for r in packed:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= packing.WINDOW


def test_run_gives_the_same_rows_twice(spark):
    rows = lambda: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert rows() == rows() and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(name, spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[cols].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{k}" for k in range(1, 11)]
