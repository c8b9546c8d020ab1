"""Keys of bands: only those of several texts, copies once, without a sort of all keys."""

from ctxspark.llm import neardup


def test_keys_of_several_texts(spark):
    rows = [(1, 10), (1, 10), (2, 10), (3, 11), (3, 11), (4, 12), (5, -13), (6, -13), (7, -13), (7, -13)]
    df = neardup._shared(spark.createDataFrame(rows, "c long, k long").repartition("k"))
    assert sorted(tuple(r) for r in df.collect()) == [(-13, 5, 3), (-13, 6, 3), (-13, 7, 3), (10, 1, 2), (10, 2, 2)]
    plan = df._jdf.queryExecution().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert neardup._shared(spark.createDataFrame([], "c long, k long").repartition("k")).collect() == []
