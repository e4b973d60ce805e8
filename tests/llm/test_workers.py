"""What Python workers take and keep."""

from pyspark.sql import functions as F

from wickerwork.llm import common, near_dup


def test_full_sets_take_one_python_process_a_task(spark):
    docs = spark.createDataFrame([(i, f"w{i} b c d e f") for i in range(6)], "doc_id long, text string")
    wanted = near_dup.cut_lineage(near_dup.sketches(docs, 3).select(F.col("doc_id").alias("node"), "key").filter("node < 2"), "wanted")
    sets = near_dup._full_sets(docs, wanted, 3)
    assert sets._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r.node: len(r.shingles) for r in sets.collect()} == {0: 32, 1: 32}


def test_workers_give_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    assert list(common.tidy(lambda batches: (b for b in batches))(iter("ab"))) == ["a", "b"] and given == [1]
