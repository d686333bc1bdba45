"""Every registered query against its SQL twin, and the shape of its plan."""

import oracle
import pytest

import __spark_entry__ as entry
from passagemill.catalog import all_queries
from passagemill.catalog import fixtures as fx

QUERIES = {name: run for name, (run, _) in all_queries().items()}
SQL = {name: sql for name, (_, sql) in all_queries().items() if sql is not None}


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in SQL:
        assert oracle.compare(df, con, SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["run_id", "metric", "k", "value"]


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_judgments_hold_glued_and_short_passages(spark, tmp_path):
    passages = ["alpha beta gamma delta", "one two three four five six seven", "tiny", "two words", "a b c d e f"]
    texts = [
        'said "alpha beta gamma delta"', "alpha beta gamma delta.", "(one two three four five six seven)", "xone two three four five six sevens",
        "one two three  four five six seven", "a tiny, text", "-two words!", "a b c d e", "1a b\tc d e f, a b c d e f1", "",
    ]
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(tuple(r) for r in fx.passage_judgments(spark, str(tmp_path)).collect())
    want = [
        (f"item-{i}", f"s/doc-{d}.md", 3 if d == 0 else 2) for i, p in enumerate(passages) for d, t in enumerate(texts) if p in t
    ]
    assert got == sorted(want) and len(want) == 7
