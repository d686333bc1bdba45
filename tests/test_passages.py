"""Passage search and the sieve against plain Python."""

import random

from pyspark.sql import functions as F

from passagemill.operators import clean, passages


def found(spark, docs, asked):
    d = spark.createDataFrame(docs, "path string, content string")
    p = spark.createDataFrame(asked, "id int, text string")
    return sorted(tuple(r) for r in passages.find_passages(d, p).collect())


def test_passages_are_all_found(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)] + ["the"] * 20 + ["é😀", "x-y", "a."]
    docs = [(f"d{i}", " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(150)] + [("none", None), ("empty", "")]
    asked = []
    for text in (t for _, t in docs[:100] if t):
        start = rng.randint(0, len(text))
        asked.append(text[start : start + rng.choice([1, 2, 3, 5, 9, 20, 60])])
    asked += ["the the the the the the", "the", "w1 w2", "nowhere to be found at all", "w1 w2 w3 w4 w5 w6 w7", "w7 w8", None, "", " \n"]
    asked = list(enumerate(asked))
    want = sorted((i, path) for i, p in asked for path, t in docs if p and p.split() and t is not None and p in t)
    assert found(spark, docs, asked) == want and len(want) > 300


def test_nothing_to_look_for_or_in(spark):
    assert found(spark, [("a", "text")], []) == []
    assert found(spark, [], [(1, "text"), (2, "one two three four five six")]) == []


def test_sieve_keeps_wanted_and_few_others(spark):
    rows = spark.range(20_000).selectExpr("concat('p', id) as path", "id")
    wanted = rows.filter("id % 100 = 0").select("path")
    kept = passages.sieve(rows, "path", wanted)
    assert kept.columns == ["path", "id"] and kept.join(wanted, "path").count() == 200 and kept.count() < 230


def test_texts_nothing_includes_are_not_shuffled(spark):
    pages = [("m.md", '{{% include "a.md" %}}'), ("a.md", "A")] + [(f"p{i}.md", "text") for i in range(500)]
    docs = spark.createDataFrame(pages, "path string, content string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        targets = docs.filter("path = 'a.md'").select("path")
        plan = passages.sieve(docs, "path", targets).join(targets, "path")._jdf.queryExecution().executedPlan().toString()
        # the bitmap is met below the exchange that deals the texts by path
        assert plan.index("SortMergeJoin") < plan.index("hashpartitioning(path") < plan.index("BroadcastHashJoin")
        assert passages.sieve(docs, "path", targets).count() < 5
        got = {r.path: r.content for r in clean.expand_includes(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got["m.md"] == "A" and len(got) == 502
