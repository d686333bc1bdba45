"""Hard negatives, language identification and conversation repair against plain Python."""

import collections
import hashlib
import heapq
import itertools
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.llm import conversation_repair as cr
from passagemill.llm import hard_negatives as hn
from passagemill.llm import language_id as li
from passagemill.llm import queries

# --- hard negatives ---------------------------------------------------------------


def mined(rows):
    """The contract row by row: rows are (vec_id, label, vector)."""
    usable = [
        (i, l, [math.floor(Fraction(float(np.float32(x))) * 256) for x in v]) for i, l, v in rows
        if None not in (i, l, v) and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = collections.Counter()
    for i, l, v in {(i, l, tuple(v)) for i, l, v in usable if i % 50 == 0}:
        scored = [(sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in usable if j != i and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, j, _ in [s for s in scored if s[2] == l][:5]:
            inside = [s for s in scored if s[2] != l and 50 * p <= 100 * s[0] <= 95 * p][:3]
            out.update((i, j, rank, k, p, n) for rank, (n, k, _) in enumerate(inside, 1))
    return out


def negatives_of(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id long, label int, v array<float>").withColumn("place", F.lit("x"))
    found = hn.mine_negatives(table, F.col("vec_id") % 50 == 0, **options).collect()
    return collections.Counter(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in found)


@pytest.mark.parametrize("scale", [0.3, 40.0, 3e6])
def test_negatives_match_every_pair(spark, scale):
    rng = np.random.default_rng(7)
    values = (rng.standard_normal((420, 11)) * scale).round(1)
    values[60:90] = values[50]
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in v]) for i, v in enumerate(values)]
    rows += [rows[50], rows[61], rows[61], rows[100], rows[101]] + [(i + 1000, None, [1.0] * 11) for i in range(2)]
    rows += [(2000, 1, None), (2050, 1, [None] * 11), (2100, 1, [float("nan")] * 11), (None, 1, [1.0] * 11), (2150, 1, []), (2151, 1, []), (2152, 2, []), (2200, 0, [1.0, 2.0]), (2201, 0, [1.5, 2.0]), (2202, 1, [1.2, 1.2])]
    got = negatives_of(spark, rows, rows_per_block=97, anchors_per_block=3)
    assert got == mined(rows) and got


def test_negatives_of_one_row_and_none(spark):
    assert not negatives_of(spark, [])
    assert not negatives_of(spark, [(0, 1, [1.0]), (1, 2, [1.0])])


def test_lookups_are_products():
    rng = np.random.default_rng(2)
    for high in (1, 200, 2**20, 2**40):
        a, b = (rng.integers(-high, high + 1, (n, 21)) for n in (9, 33))
        got = hn.lookup_scores(hn.subset_sums(hn._narrowest(a, b)), hn.bit_planes(b))
        want = np.array([[sum(int(x) * int(y) for x, y in zip(p, q)) for p in a] for q in b], dtype=object)
        assert (got.astype(object) == want).all()


# --- languages -----------------------------------------------------------------------

WORDS = {
    "aa": "the and that with from this have which would there their about".split(),
    "bb": "der die und das nicht eine auch werden haben sich nach über".split(),
    "cc": "что как это его она они был для мы вас так уже".split(),
}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    rows = [(lang, " ".join(rng.choice(words, 40))) for lang, words in WORDS.items() for _ in range(30)]
    return spark.createDataFrame(rows, "lang string, text string")


def test_spans_of_mixed_texts(spark, corpus):
    a, b, c = (" ".join(WORDS[k]) for k in WORDS)
    rows = [
        (1, f"{a} {b}. {b}"), (2, c.upper()), (3, None), (4, ""), (5, "123 ... !"), (6, "漢字" * 50), (7, f"{a}\n{c}"),
        (8, "́́"), (9, "thethethe" * 40_000), (10, f"{b} " * 20_000), (11, "the"), (11, "the"),
    ]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, row string, lang_pred string, score string")
    model_docs = corpus.withColumn("doc_id", F.lit(0)).withColumn("row", F.lit("")).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(""))
    both = docs.withColumn("lang", F.lit(None).cast("string")).unionByName(model_docs)
    found = li.identify_languages(both, F.lit(True)).filter("doc_id > 0").collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and set(found[0].asDict()) == {"doc_id", "text", "row", "lang", "lang_pred", "score", "lang_score", "lang_spans"}
    text = rows[0][1]
    assert [(s.lang, text[s.start : s.end]) for s in got[1].lang_spans] == [("aa", a), ("bb", f"{b}. {b}")]
    assert (got[1].lang_pred, got[2].lang_pred, got[7].lang_pred) == ("bb", "cc", "aa" if sum(map(len, WORDS["aa"])) > sum(map(len, WORDS["cc"])) else "cc")
    assert all((got[i].lang_pred, got[i].lang_score, got[i].lang_spans) == ("und", 0.0, []) for i in (3, 4, 5, 8))
    assert got[6].lang_pred in WORDS and got[6].lang_score == 0
    assert (got[9].lang_pred, got[10].lang_pred) == ("aa", "bb") and len(got[10].lang_spans) == 1
    assert got[10].lang_spans[0].end == len(rows[9][1]) - 1 and got[10].lang_score > 0.99
    assert all(0 <= r.lang_score <= 1 for r in found)


def test_nothing_to_learn_from_or_label(spark, corpus):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.lang_score) for r in li.identify_languages(docs, F.lit(True)).collect()] == [("und", 0.0)]
    assert li.identify_languages(corpus.limit(0), F.lit(True)).count() == 0


def test_paths_are_the_best_of_all():
    rng = np.random.default_rng(1)
    count = np.array([1, 6, 4, 0, 5])
    scores = rng.normal(0, 6, (count.sum(), 3))
    first = np.cumsum(count) - count
    path = li.viterbi(scores, first, count)
    for f, n in zip(first, count):
        def worth(way):
            return sum(scores[f + t, l] for t, l in enumerate(way)) - li.SWITCH * sum(a != b for a, b in zip(way, way[1:]))
        best = max(map(worth, itertools.product(range(3), repeat=int(n))))
        assert worth(tuple(path[f : f + n])) == pytest.approx(best)


def test_windows_do_not_change_words(monkeypatch):
    text = "ab " * 30 + "x" * 150 + " щщ漢a " + "длинное слово, " * 20
    points = li.code_points(text)
    whole = [(s, n) for s, n in zip(*(a.tolist() for a in li.words_of(points)[1:3]))]
    assert [n for _, n in whole][30:35] == [32, 32, 32, 32, 22] and max(n for _, n in whole) == 32
    for window in (40, 64, 101):
        monkeypatch.setattr(li, "WINDOW", window)
        cut = [(at + s, n) for at, (_, starts, lengths, _) in li._windows(points) for s, n in zip(starts.tolist(), lengths.tolist())]
        assert cut == whole


def test_held_out_documents_are_labelled(spark, sf_dir):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries.op12(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.held_out]
    assert len(found) == len(langs) and sum(langs[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)


# --- conversations ----------------------------------------------------------------------


def faulty(rows):
    """First faults of ordered (turn, role, text) rows."""
    seen, out = set(), []
    for _, role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Best-first search over all edit sequences: (cost, audit, repaired lines)."""
    viable = re.compile(r"s?(ua)*u?")
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, lines = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit, lines
        state = (at, roles[:1] == "s", len(roles) % 2, len(roles) > 1, roles[-1:])
        if state in done:
            continue
        done.add(state)
        steps = [(3, "I", 0, given[0], f"{given}:") for given in ("user", "assistant")]
        if at < len(rows):
            _, role, text = rows[at]
            steps.append((4, "D", 1, "", None))
            if faults[at] not in ("blank", "duplicate"):
                extra = 3 * (faults[at] == "truncated")
                steps.append((extra, "K", 1, role[:1], f"{role}:{text}"))
                steps += [(3 + extra, "R", 1, given[0], f"{given}:{text}") for given in ("user", "assistant")]
        for more, edit, rows_used, initial, line in steps:
            if line is None or (initial and viable.fullmatch(roles + initial)):
                new = lines if line is None else lines + (line,)
                heapq.heappush(heap, (cost + more, audit + edit, at + rows_used, roles + initial, new))


def expected(rows):
    """Per conversation what the summary and the digest hold."""
    groups = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, found in groups.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        faults = faulty(found)
        cost, audit, lines = cheapest(found, faults)
        turns = [t for t, _, _ in found if t is not None]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def repaired(spark, rows, **options):
    schema = "conv_id long, turn long, role string, text string, digest string, at string"
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    edits, summary = cr.repair(table, **options)
    hashes = {r.conv_id: r.repaired_sha256 for r in cr.repaired_digests(edits).collect()}
    none = hashlib.sha256(b"").hexdigest()
    return {
        r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashes.get(r.conv_id, none)) for r in summary.collect()
    }, edits


@pytest.mark.parametrize("rows_per_run", [1, 3, 1000])
def test_repairs_are_the_cheapest(spark, rows_per_run):
    rng = np.random.default_rng(11)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "User"]
    texts = ["Yes.", "cut", "", " \t", "Why?  ", None, "No!", "Oh. ", "a.\nb"]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(int(rng.integers(0, 9))):
            for _ in range(int(rng.integers(1, 3)) if rng.random() < 0.2 else 1):
                place = None if rng.random() < 0.1 else int(turn + rng.integers(0, 2))
                text = texts[rng.integers(0, len(texts))] if rng.random() < 0.6 else f"Line {conv} {turn}."
                rows.append((conv, place, roles[rng.integers(0, len(roles))], text))
    rows += rows[:3] + [(900, 2**60 + i, "user", "Long." + "x" * 100_000 + ".") for i in range(2)]
    got, edits = repaired(spark, rows, rows_per_run=rows_per_run)
    assert got == expected(rows)
    counts = collections.Counter(r.action for r in edits.collect())
    assert set(counts) == {"keep", "delete", "rerole", "insert"} and sum(counts.values()) - counts["insert"] == len(rows)


def test_long_conversation_in_runs(spark):
    rng = np.random.default_rng(3)
    kinds = [("user", "Hm?"), ("assistant", "So."), ("user", "cut"), ("system", "Be."), ("assistant", "")]
    rows = [(7, i, kinds[k][0], kinds[k][1] and f"{i} {kinds[k][1]}") for i, k in enumerate(rng.integers(0, len(kinds), 700))]
    rows += [(8, 5, "user", "Same.")] * 300
    assert repaired(spark, rows, rows_per_run=64)[0] == expected(rows)


def test_no_conversations(spark):
    assert repaired(spark, [])[0] == {}


def test_query_damages_and_repairs(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    hurt = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        hurt += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in rows} | expected(hurt)
    got = {r.conv_id: tuple(r)[1:] for r in queries.op13(spark, sf_dir).collect()}
    assert got == want


def test_automaton_has_the_grammars_stacks():
    # nothing, s, u, pairs, s u, s pairs, pairs u, s pairs u
    assert len(cr.STACKS) == 8 and len(cr.LR.goto) == 8
    assert [cr.CLOSING[0], max(cr.CLOSING)] == [(0, ""), (6, "II")]
