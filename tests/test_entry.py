"""Registered queries: names, and agreement of a few with their SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["ocr_metrics", "iou_pairs", "average_precision", "group_split", "merge_last_wins", "shard_of", "class_metrics", "weighted_mix"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    plain = lambda df: sorted(tuple(round(float(x), 6) if not isinstance(x, str) else x for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert plain(got) == plain(want)
