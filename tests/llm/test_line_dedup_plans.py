"""Shingles are exploded in generated code: a higher-order function inside an explosion has it interpreted row by row."""

from corpusops.llm import line_dedup as L


def test_no_lambda_inside_an_explosion(spark):
    texts = spark.createDataFrame([(1, "a line of more than twenty characters")], "node long, line string")
    docs = spark.createDataFrame([(1, "a line of more than twenty characters")], "doc_id long, text string")
    nodes = docs.selectExpr("1L as node", "xxhash64(text) as a", "xxhash64(1, text) as b", "cast(doc_id as decimal(19,0)) * 2147483648BD as first")
    for df in (L.sketches(texts), L.texts_of(docs, nodes)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert [x for x in plan.splitlines() if "Generate" in x] and not [x for x in plan.splitlines() if "Generate" in x and "lambdafunction" in x]
    assert [tuple(r) for r in L.texts_of(docs, nodes).collect()] == [(1, "a line of more than twenty characters")]


def test_verification_makes_the_common_part_once(spark):
    one, two = "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnopqrstuvwxy"
    texts = spark.createDataFrame([(1, one), (2, two), (3, two[::-1])], "node long, line string")
    sizes = {1: 29, 2: 28, 3: 28}
    pairs = spark.createDataFrame([(a, b, sizes[a], sizes[b]) for a, b in ((1, 2), (1, 3), (2, 3))], "a long, b long, na long, nb long")
    found = L.verified(pairs, texts)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") == 1
    assert [tuple(r) for r in found.collect()] == [(1, 2)]
