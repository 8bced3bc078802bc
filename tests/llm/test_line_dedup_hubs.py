"""Later rounds look only at pairs of different components that have not been compared."""

from corpusops.llm import line_dedup as L


def test_settled_pairs_are_left_out(spark):
    # a bucket of two components, {1, 2, 3} and {4, 5, 6}; all have been compared with 1; and a bucket that is one component
    members = spark.createDataFrame([(7, n, 1) for n in range(1, 7)] + [(8, n, 1) for n in (1, 2)], "key long, node long, first long")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4)], "node long, component long")
    component = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    seen = 0
    for salt in range(8):
        rows = L.new_hubs(members, groups, salt).collect()
        assert sorted((r["key"], r["node"]) for r in rows) == [(7, n) for n in range(1, 7)]
        for hub in "xy":
            ends = {r[hub] for r in rows if r[hub] is not None}
            assert len(ends) <= 1
            for end in ends:
                seen += 1
                assert end != 1
                assert {r["node"] for r in rows if r[hub] == end} == {n for n in range(2, 7) if component[n] != component[end]}
    assert seen
