import random

import pytest
from pyspark.sql import functions as F

from passagemill.operators import chunk, structure
from passagemill.plans.registry import CHUNKERS, RETRIEVERS


def elements_of(spark, text):
    docs = spark.createDataFrame([("d.md", text)], "path string, content string")
    rows = structure.explode_elements(structure.parse_markdown(docs)).orderBy("pos").collect()
    return [(r.kind, r.text, r.level) for r in rows]


def test_blocks(spark):
    text = (
        "---\ntitle: t\n---\n# Top #\nintro\nsoft\n\nSetext\n---\n- one\n  - nested\n- [x] two\n1. three\n\n"
        "```go\n# no heading\n\n- no item\n```\n\n    indented\n\n    more\n\n| a | b |\n|---|:-:|\n| 1 | 2 |\n| 3 |\n\n"
        "***\n\n> quoted\n> text\n\n<div>\nhtml\n</div>\n\nlast"
    )
    assert elements_of(spark, text) == [
        ("heading", "Top", 1),
        ("paragraph", "intro soft", 0),
        ("heading", "Setext", 2),
        ("list_item", "one nested", 0),
        ("list_item", "two", 0),
        ("list_item", "three", 0),
        ("code_block", "# no heading\n\n- no item", 0),
        ("code_block", "indented\n\n    more".replace("\n\n    ", "\n\n"), 0),
        ("table", "a b\n1 2\n3 ", 0),
        ("paragraph", "quoted text", 0),
        ("paragraph", "last", 0),
    ]


def test_inline(spark):
    text = "[t](u) ![a](i.png) ![](j.png) <https://example.com> `c*d` **b** *i* ~~s~~ [x]( ) <b>k</b>"
    assert elements_of(spark, text) == [
        ("paragraph", "t (u) a (i.png) j.png https://example.com c*d b i s x k", 0)
    ]


def test_unclosed_fence_and_language(spark):
    docs = spark.createDataFrame([("d.md", "~~~ python x\ncode\n# x")], "path string, content string")
    row = structure.explode_elements(structure.parse_markdown(docs)).first()
    assert (row.kind, row.text, row.meta) == ("code_block", "code\n# x", {"language": "python"})


def test_long_blocks_do_not_overflow(spark):
    text = "\n".join(["```", *["line"] * 50_000, "```", "", *["- item"] * 20_000, "", *["para"] * 50_000])
    kinds = [k for k, _, _ in elements_of(spark, text)]
    assert kinds.count("code_block") == 1 and kinds.count("list_item") == 20_000 and kinds.count("paragraph") == 1


def test_metadata_is_carried(spark):
    docs = spark.createDataFrame([("d.md", "---\nk: v\n---\none two\n")], "path string, content string")
    assert chunk.fixed_chunks(structure.parse_markdown(docs)).first().metadata == {"k": "v"}


def plain(spark, *texts):
    return structure.parse_plain(
        spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "path string, content string")
    )


def sizes(rows):
    return [len(r.content.split()) for r in sorted(rows, key=lambda r: r.chunk_id)]


@pytest.mark.parametrize(
    "n, size, overlap, expected",
    [(100, 30, 10, 5), (107, 30, 10, [30, 30, 30, 30, 27]), (100, 50, 0, [50, 50]), (90, 50, 10, [50, 50, 10]), (0, 5, 1, [])],
)
def test_fixed_sizes(spark, n, size, overlap, expected):
    got = sizes(chunk.fixed_chunks(plain(spark, "word " * n), size, overlap).collect())
    assert (len(got) if isinstance(expected, int) else got) == expected


def test_fixed_parameters():
    assert chunk.fixed_parameters(10, 20) == (10, 1)
    with pytest.raises(ValueError):
        chunk.fixed_parameters(0, 0)


def window_model(words, size, step):
    out, window = [], []
    for word in words:
        window.append(word)
        while len(window) >= size:
            out.append(" ".join(window[:size]))
            window = window[step:]
    return out + ([" ".join(window)] if window else [])


@pytest.mark.parametrize("size, overlap", [(1, 0), (3, 1), (7, 6), (10, 4), (15, 15)])
def test_fixed_against_loop(spark, size, overlap):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in range(0, 60)]
    rows = chunk.fixed_chunks(plain(spark, *texts), size, overlap).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.chunk_index):
        got.setdefault(r.document_path, []).append(r.content)
    _, step = chunk.fixed_parameters(size, overlap)
    for i, text in enumerate(texts):
        assert got.get(f"d{i}", []) == window_model(text.split(), size, step)


def markdown_chunks(spark, text, max_size, overlap=None):
    docs = structure.parse_markdown(spark.createDataFrame([("d.md", text)], "path string, content string"))
    return [r.content for r in chunk.recursive_chunks(docs, max_size, overlap).orderBy("chunk_index").collect()]


def test_recursive_paths(spark):
    assert markdown_chunks(spark, "# Travel\n\n## Booking Flights\n\nuse the portal", 512) == [
        "Travel > Booking Flights\n\nBooking Flights\n\nuse the portal"
    ]
    assert markdown_chunks(spark, "# Top\n\n### Jump\n\ntext", 512)[0].startswith("Top > Jump\n\n")
    assert len(markdown_chunks(spark, "before\n\n# H\n\nafter", 512)) == 2


def test_recursive_keeps_code_whole(spark):
    code = " ".join(f"c{i}" for i in range(80))
    assert markdown_chunks(spark, f"# H\n\n```\n{code}\n```", 30) == [f"H\n\nH\n\n{code}"]


def test_recursive_falls_back_to_windows(spark):
    text = " ".join(f"w{i}" for i in range(25))
    got = markdown_chunks(spark, f"# H\n\n{text}", 10, 2)
    assert got[0] == "H\n" + " ".join(f"w{i}" for i in range(10))
    assert got[1].startswith("H\nw8 ") and len(got) == 3


def test_recursive_cover(spark):
    """Every content word of random documents is in some chunk, no chunk without code exceeds the limit."""
    rng = random.Random(4)
    docs = []
    for d in range(40):
        parts = []
        for b in range(rng.randint(0, 12)):
            words = " ".join(f"d{d}b{b}w{i}" + rng.choice(["", "", ".", "!"]) for i in range(rng.randint(1, 40)))
            parts.append(rng.choice(["# " + words[:6], "## T", "### U", words, words, f"- {words}"]))
        docs.append((f"d{d}", "\n\n".join(parts)))
    parsed = structure.parse_markdown(spark.createDataFrame(docs, "path string, content string"))
    rows = chunk.recursive_chunks(parsed, 12, 3).collect()
    for d, text in docs:
        chunks = [r.content for r in rows if r.document_path == d]
        seen = {w for c in chunks for w in c.split()}
        content = {w for part in text.split("\n\n") if not part.startswith("#") for w in part.split() if w != "-"}
        assert content <= seen
        for c in chunks:
            body = c.split("\n\n")[-1] if "\n\n" in c else c.split("\n")[-1]
            assert len(body.split()) <= 12


def test_registries():
    for registry in (CHUNKERS, RETRIEVERS):
        with pytest.raises(ValueError):
            registry.get("unheard")
    with pytest.raises(ValueError):
        CHUNKERS.run("fixed", None, config=None)


def test_chunking_is_one_narrow_stage(spark):
    docs = spark.range(10).select(F.col("id").cast("string").alias("path"), F.lit("# a\n\nb c").alias("content"))
    for make in (chunk.fixed_chunks, chunk.recursive_chunks):
        plan = make(structure.parse_markdown(docs))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan
