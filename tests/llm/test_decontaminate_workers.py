"""A task holds one Python worker: two Python steps in one stage would take two, and executors keep them for what follows."""

from corpusops.llm import decontaminate as D


def test_benchmark_items_take_one_worker_a_task(spark, monkeypatch):
    plans = []
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    store = D.stored
    monkeypatch.setattr(D, "stored", lambda df, name: (plans.append(plan_of(df)), store(df, name))[1])
    items = [(1, "how many of the red apples did they carry home"), (2, "five plain words stand here"), (3, "1 2 3 4 5 6 7 8 9")]
    out = D.item_windows(spark.createDataFrame(items, "id long, text string"))
    plans.append(plan_of(out))
    assert any("MapInArrow" in p for p in plans) and any("ArrowEvalPython" in p for p in plans)
    assert not [p for p in plans if "MapInArrow" in p and "ArrowEvalPython" in p]
    assert {(r["id"], r["size"]) for r in out.select("id", "size").collect()} == {(1, 8), (2, 5), (3, -8)}


def test_short_texts_take_one_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "Two words."), (2, "other words here"), (3, None)], "id long, text string")
    items = spark.createDataFrame([(9, "two words")], "id long, text string")
    out = D.short_matches(docs, items)
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2  # one a side
    assert [(r["id"], r["item_id"]) for r in out.collect()] == [(1, 9)]
