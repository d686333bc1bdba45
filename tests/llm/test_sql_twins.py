"""Corpus queries that SQL can express, against their twins."""

import oracle
import pytest

from passagemill.llm.queries import QUERIES


@pytest.mark.parametrize("name", [name for name, (_, sql) in QUERIES.items() if sql])
def test_twin(spark, sf_dir, name):
    run, sql = QUERIES[name]
    assert oracle.compare(run(spark, sf_dir), oracle.connect(sf_dir), sql) is None


def test_numbers():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
