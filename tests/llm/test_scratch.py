"""Intermediate tables of a job go with its scope."""

import os

import pytest

pytest.importorskip("corpusops.llm")

from corpusops.llm import simhash  # noqa: E402
from corpusops.llm.common import scratch, shared_folder  # noqa: E402


def tables(spark):
    return set(os.listdir(shared_folder(spark).removeprefix("file:")))


def test_scratch_leaves_only_what_is_kept(spark):
    before = tables(spark)
    docs = spark.createDataFrame([(1, "one two three four"), (2, "one two three four"), (3, "another text")], "doc_id long, text string")
    with scratch(spark) as keep:
        out, path = keep(simhash.groups(docs), "result")
        assert len(tables(spark) - before) > 1
    assert tables(spark) - before == {path.rsplit("/", 1)[1]}
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == {1: 1, 2: 1, 3: 3}


def test_scratch_cleans_up_after_an_error(spark):
    before = tables(spark)
    docs = spark.createDataFrame([(1, "one")], "doc_id long, text string")
    with pytest.raises(RuntimeError), scratch(spark):
        simhash.groups(docs)
        raise RuntimeError
    assert tables(spark) == before
