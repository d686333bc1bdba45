"""Personal data, mixing, licences and line dedup against plain Python."""

import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from passagemill.llm import license_scan, line_dedup, mixing, pii, queries
from passagemill.llm.rows import spans

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PII_TEXTS = [
    None,
    "",
    "a@b.c_d@e.f.x@y.z mail me at joe dot x",
    "x@y z@-.a a@b..c %@a.b",
    "1.2.3.4.5.6.7.8 300.1.1.1 00255.1.1.1 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5",
    "call +1 (988) 555-2485 or +12 or +1234567890123456 +44.20.7946.0958)",
    "é😀 ü x.y@mail.example.com 10.0.0.1 😀 +49 (30) 123-4567",
    "9" * 30000 + " " + "1 " * 20000 + "a" * 50000 + "@",
    "write to joe [at] example [dot] com or 733-555-4559 now",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        if kind == "email" and "@" not in text:
            continue
        for m in re.finditer(pattern, text) if kind != "email" or len(text) < 10000 else ():
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def check_pii(spark, tmp_path, frame):
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op2(spark, str(tmp_path)).collect()}
    for row in frame.collect():
        want = base_spans(row.text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[row.doc_id].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), row.doc_id
        assert [got[row.doc_id][f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in want) for k in BASE]
        assert set(joined.split(",")) - {""} <= set(got[row.doc_id].spans.split(","))
    return got


def test_pii_spans(spark, tmp_path, documents):
    got = check_pii(spark, tmp_path, documents([(i, t) for i, t in enumerate(PII_TEXTS)], extra=True))
    assert "email:9:35" in got[9].spans


def test_pii_on_the_small_table(spark, sf_dir, tmp_path):
    check_pii(spark, tmp_path, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_pii_is_native_and_takes_empty_tables(spark, tmp_path, documents):
    found = pii.find_pii(documents([]))
    assert found.count() == 0
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_pii_reads_texts_once_in_time_near_their_length(spark, documents):
    """Candidates are stored, and what is made once per text is not made again for every match of it."""
    found = pii.find_pii(documents([(1, "mail a@b.example.com")]), carry=["doc_id"])
    assert found.columns == ["doc_id", "pii"] and "RLIKE" not in found._jdf.queryExecution().executedPlan().toString()

    def seconds(n):
        docs = documents([(i, "call +1 (988) 555-2485, 12 34 56, a@b.example.com or 10.0.0.1; " * n) for i in range(4)])
        began = time.perf_counter()
        assert [len(r.pii) for r in pii.find_pii(docs, carry=["doc_id"]).collect()] == [3 * n] * 4
        return time.perf_counter() - began

    seconds(50)
    assert seconds(4000) < 6 * max(seconds(1000), 1.0)


def test_span_contexts_reach_over_earlier_matches(spark):
    text = "é😀 ab1c22ddd333" + "x" * 9 + "4444 5" + "6" * 7
    row = spark.createDataFrame([(text,)], "t string").select(spans(F.col("t"), "[0-9]+", 5).alias("s")).first()
    want = [(m.start(), m.end(), m[0], text[max(0, m.start() - 5) : m.start()], text[m.end() : m.end() + 1]) for m in re.finditer("[0-9]+", text)]
    assert [tuple(s) for s in row.s] == want
    many = "7," * 1000 + "8"
    row = spark.createDataFrame([(many,)], "t string").select(spans(F.col("t"), "[0-9]", 40).alias("s")).first()
    assert [s.start for s in row.s] == list(range(0, 2001, 2)) and all(s.before == many[max(0, s.start - 40) : s.start] for s in row.s)


def test_reliabilities_follow_the_votes():
    counts = [pii.VoteCounts(0, (1, 1, 0, 1, 1), 90), pii.VoteCounts(0, (-1, 0, 0, -1, -1), 60), pii.VoteCounts(0, (0, 1, 0, 1, 1), 5)]
    model = pii.estimate(counts)
    assert model.posterior(0, (1, 1, 0, 1, 1)) > 0.9 > 0.1 > model.posterior(0, (-1, 0, 0, -1, -1))


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
LICENSE_TEXTS = [
    None,
    "",
    "Released UNDER the MIT License.",
    "cc-by-nc cc by nc by nc, cc BY\nNC under the mit licenses",
    "Apache License, Version 2.0 and Apache License Version 2",
    "é under the mit license, cc by nc, " * 300,
    "the " * 50000,
    "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "mit license under the",
    "cc by nc",
]


def check_licenses(spark, tmp_path, frame):
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op7(spark, str(tmp_path)).collect()}
    for row in frame.collect():
        text = re.sub("[A-Z]+", lambda m: m[0].lower(), row.text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        places, labels = [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[row.doc_id]
        want = (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want, row.doc_id
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    return got


def test_licenses(spark, tmp_path, documents):
    got = check_licenses(spark, tmp_path, documents([(i, t) for i, t in enumerate(LICENSE_TEXTS)], extra=True))
    assert got[7].labels == "bsd-3" and got[7].score == 1.0 and got[6].score == 0.0


def test_licenses_on_the_small_table(spark, sf_dir, tmp_path):
    check_licenses(spark, tmp_path, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_licenses_take_empty_tables(documents):
    assert license_scan.scan_licenses(documents([])).count() == 0


def test_line_dedup_keeps_the_first_passage(documents):
    docs = documents(
        [
            (1, "a\nb\nc\nd"),
            (2, "x\nb\nc\nd\ny"),
            (3, "a\nb\nc\nd"),
            (4, "r\nr\nr\nr\nr"),
            (5, None),
            (6, ""),
            (7, "a\nb"),
            (None, "a\nb\nc"),
            (8, "\n".join(f"l{i}" for i in range(3000)) + "\na\nb\nc"),
            (9, "\n\n\n"),
        ],
        extra=True,
    )
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.n_chars) for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1] == ("a\nb\nc\nd", 4, 0, 7)
    assert got[2] == ("x\ny", 5, 3, 3)
    assert got[3] == ("", 4, 4, 0)
    assert got[4] == ("r\nr\nr", 5, 2, 5)
    assert got[5] == (None, 0, 0, None)
    assert got[6] == ("", 1, 0, 0) and got[7] == ("a\nb", 2, 0, 3)
    assert got[None] == ("", 3, 3, 0)
    assert got[8][2] == 3 and got[9] == ("\n\n", 4, 1, 2)


def test_line_dedup_treats_repeated_rows_alike(documents):
    rows = line_dedup.dedup_lines(documents([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")])).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "")]
    assert line_dedup.dedup_lines(documents([])).count() == 0


def test_targets_are_reshared(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 0)], "source string, size long")
    got = {r.source: (r.source_size, r.target) for r in mixing.source_targets(sizes).collect()}
    # Weights 1, 2, 3, 1 for a, b, c and null: null and a are capped at 0 and 30, then 1480 is shared 2 : 3.
    assert got[None] == (0, 0.0) and got["a"] == (10, 30.0)
    assert got["b"][1] == pytest.approx(592.0) and got["c"][1] == pytest.approx(888.0)
    assert sum(t for _, t in got.values()) == pytest.approx(1510)


def test_mix_is_stable_and_near_its_targets(spark, documents):
    rows = [(i, "w " * (i % 17), f"s{i % 3}" if i % 7 else None) for i in range(900)] + [(None, None), (None, "a b c"), (5, "x y")]
    docs = documents(rows, extra=True)
    first, second = (sorted(map(str, mixing.mix(docs.repartition(n)).collect())) for n in (1, 5))
    assert first == second
    mixed = mixing.mix(docs)
    assert mixed.filter("taken > 3 * size or (text is null and size <> 0)").count() == 0
    per = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.05 * r.target for r in per)
    copies = mixing.emit(mixed, docs.columns)
    assert copies.count() == mixed.agg(F.sum("copies")).first()[0] and copies.columns == docs.columns
    assert mixing.mix(documents([])).count() == 0

