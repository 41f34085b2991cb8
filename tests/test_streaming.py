from wellcut.streaming.components import read_state, start_components


def test_components_of_a_stream(spark, tmp_path):
    src, state, mark = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "mark")
    batches = [[(1, 2), (5, 6)], [(2, 3), (8, 8)], [(3, 6), (9, 10)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "src long, dst long").coalesce(1).write.mode("append").parquet(src)
        start_components(spark.readStream.schema("src long, dst long").parquet(src), state, mark).awaitTermination(120)
        if k == 0:
            assert {r["node"]: r["component"] for r in read_state(spark, state).collect()} == {1: 1, 2: 1, 5: 5, 6: 5}
    assert {r["node"]: r["component"] for r in read_state(spark, state).collect()} == {1: 1, 2: 1, 3: 1, 5: 1, 6: 1, 8: 8, 9: 9, 10: 9}
