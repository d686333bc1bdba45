import random
import re

import pytest
from pyspark.sql import functions as F

from passagemill.functions import markup as mk
from passagemill.operators import clean, verify
from passagemill.plans.clean_job import clean_corpus


def apply(spark, expression, *texts):
    """Expression over one text column, in input order."""
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    return [r[0] for r in df.select(expression(F.col("t")).alias("x"), "n").orderBy("n").collect()]


def test_strip_tags(spark):
    cases = {
        'Before {{< youtube id="abc123" >}} After': "Before  After",
        "Before {{< details >}}inner content{{< /details >}} After": "Before inner content After",
        "A {{% custom a=1 %}}kept{{% /custom %}} B": "A kept B",
        "A {{< member-by-name >}}gone{{< /member-by-name >}} B": "A  B",
        "stray {{< /details >}} close": "stray  close",
        "{{< panel >}}a {{< youtube x >}} b{{< /panel >}}": "a  b",
        "no tags {braces}": "no tags {braces}",
    }
    assert apply(spark, mk.strip_tags, *cases) == list(cases.values())


def test_strip_tags_custom_rules(spark):
    got = apply(spark, lambda c: mk.strip_tags(c, {"note": mk.REMOVE}), "a {{< note >}}x{{< /note >}} {{< youtube y >}}b")
    assert got == ["a  b"]


def test_html(spark):
    cases = {
        '<a href="https://example.com">click here</a>': "click here [https://example.com]",
        '<a href="https://example.com"></a>': "https://example.com",
        "a<!-- c -->b<script>x<y</script><style>p{}</style>c": "abc",
        '<img src="a.png" alt="cat">': "cat",
        '<img src="a.png">x': "x",
        "<table><tr><td>a</td>\n<td> b</td></tr></table>": "a b",
        "&lt;p&gt; &amp;lt; &#65;&#x42; &eacute; &nope;": "<p> &lt; AB é &nope;",
        "see <https://example.com/a> now": "see <https://example.com/a> now",
        "1 < 2 and a > b": "1 < 2 and a > b",
    }
    assert apply(spark, mk.html_to_text, *cases) == list(cases.values())


def test_refs(spark):
    cases = {
        '{{< ref "docs/page#section1" >}}': "[docs/page#section1](docs/page.md#section1)",
        '{{< relref "page" >}}': "[page](page.md)",
        '{{< ref "page.md" >}}': "[page](page.md)",
    }
    assert apply(spark, mk.resolve_refs, *cases) == list(cases.values())


def test_strict_refs(spark):
    docs = spark.createDataFrame([("a/x.md", '{{< relref "y" >}} {{< ref "a/z" >}}'), ("a/y.md", "none")], "path string, content string")
    with pytest.raises(Exception, match="a/x.md -> a/z.md"):
        clean.resolve_refs(docs, strict=True).collect()
    known = spark.createDataFrame([("a/y.md",), ("a/z.md",)], "path string")
    got = {r.path: r.content for r in clean.resolve_refs(docs, strict=True, paths=known).collect()}
    assert got == {"a/x.md": "[y](y.md) [a/z](a/z.md)", "a/y.md": "none"}


def test_dangling_refs(spark):
    docs = spark.createDataFrame(
        [("a/x.md", '{{< relref "y" >}} {{< ref "a/z#q" >}} {{< relref "../b/w.md" >}}'), ("a/y.md", ""), ("b/w.md", "")],
        "path string, content string",
    )
    assert [tuple(r) for r in clean.dangling_refs(docs).collect()] == [("a/x.md", "ref", "a/z#q", "a/z.md")]


@pytest.mark.parametrize(
    "pages, expected",
    [
        ({"m.md": '# {{% include "a.md" %}}', "a.md": 'A: {{% include "b.md" %}}', "b.md": 'B: {{% include "c.md" %}}', "c.md": "C content"}, "# A: B: C content"),
        ({"m.md": '# {{% include "a.md" %}}', "a.md": '{{% include "b.md" %}}', "b.md": '{{% include "a.md" %}}'}, "# "),
        ({"m.md": '{{% include "gone.md" %}}|{{% include "a.txt" %}}', "a.txt": "x"}, '{{% include "gone.md" %}}|{{% include "a.txt" %}}'),
        ({"m.md": 's {{% include "m.md" %}} e'}, "s s  e e"),
        ({"m.md": '{{% include "./d/../a.md" %}}{{% include "/a.md" %}}', "a.md": "A"}, "AA"),
    ],
)
def test_includes(spark, pages, expected):
    docs = spark.createDataFrame(list(pages.items()), "path string, content string")
    got = {r.path: r.content for r in clean.expand_includes(docs).collect()}
    assert got["m.md"] == expected
    assert set(got) == set(pages)


def test_include_depth_limit_leaves_tag(spark):
    pages = [(f"p{i}.md", f'{i}{{{{% include "p{i + 1}.md" %}}}}') for i in range(6)]
    docs = spark.createDataFrame(pages, "path string, content string")
    got = {r.path: r.content for r in clean.expand_includes(docs, max_depth=2).collect()}
    assert got["p0.md"] == '0123{{% include "p4.md" %}}'


def test_source_url(spark):
    paths = ["handbook/_index.md", "handbook/my_index.md", "index.md", "a/index.md", "a/b.md"]
    got = apply(spark, lambda c: mk.source_url(c, "https://example.com/"), *paths)
    assert got == [f"https://example.com/{x}" for x in ("handbook/", "handbook/my_index/", "", "a/", "a/b/")]


def test_front_matter(spark):
    texts = ["---\na: 1\n---\nbody", "---\r\na: 1\r\n...\r\nbody", "\n\n---\na: 1\n---\n\nbody", "body", "---\nopen"]
    assert apply(spark, mk.has_front_matter, *texts) == [True, True, True, False, False]
    assert apply(spark, mk.front_matter, *texts) == ["a: 1", "a: 1", "a: 1", None, None]
    assert apply(spark, mk.body, *texts) == ["body", "body", "body", "body", "---\nopen"]


def test_front_matter_map(spark):
    docs = spark.createDataFrame(
        [('---\ntitle: "T: x"\nn: 3 # note\nflag: true\n---\n',), ("---\nbroken line\n---\n",), ("none",)], "content string"
    )
    assert [r.metadata for r in clean.front_matter_metadata(docs).collect()] == [
        {"title": "T: x", "n": "3", "flag": "true"}, None, None,
    ]


def test_nested_front_matter(spark):
    docs = spark.createDataFrame([("---\na:\n  - x\n  - 2\nb: {c: true}\n---\n",)], "content string")
    assert clean.front_matter_metadata(docs, nested=True).first().metadata == {"a": "[x 2]", "b": "map[c:true]"}


def test_nested_front_matter_forms(spark):
    head = (
        "---\nunindented:\n- 'a: b'\n- # nothing\n- null\nmap:\n  z: \"q\"\n  y: 1 # note\n  z: last\n"
        "flow: [a, 'b, c', ~] # end\nnone: []\nempty:\nquoted: \"null\"\nyes: TRUE\ndeep:\n  a:\n    - b\n"
        "maps:\n  - k: v\ncommented: # words\n  - x\ntitle: a [b] # c\n---\n"
    )
    docs = spark.createDataFrame([(head,), ("---\n---\n",), (None,)], "content string")
    first, blank, missing = [r.metadata for r in clean.front_matter_metadata(docs, nested=True).collect()]
    assert first == {
        "unindented": "[a: b <nil> <nil>]", "map": "map[y:1 z:last]", "flow": "[a b, c <nil>]", "none": "[]", "empty": "<nil>",
        "quoted": "null", "yes": "true", "deep": "a:\n    - b", "maps": "- k: v", "commented": "[x]", "title": "a [b]",
    }
    assert not blank and missing is None


def test_inject_source_url(spark):
    url = F.lit("https://example.com/p/")
    texts = ["---\nz: 1\nsource_url: old\na:\n  - q\n---\nbody", "plain", "---\nbad\n---\nx"]
    head = "---\nsource_url: https://example.com/p/\n---\n"
    assert apply(spark, lambda c: mk.inject_source_url(c, url), *texts) == [
        "---\na:\n  - q\nsource_url: https://example.com/p/\nz: 1\n---\nbody\n",
        head + "plain\n",
        head + "---\nbad\n---\nx\n",
    ]
    assert apply(spark, lambda c: mk.inject_source_url(c, F.lit("")), "plain") == ["plain"]


def test_clean_job_and_report(spark):
    body = "A page with enough text to pass the size check of the report, really. "
    docs = spark.createDataFrame(
        [
            ("s/a.md", body + '{{% include "s/part.md" %}} {{< ref "s/b" >}}<b>x</b>'),
            ("s/part.md", body + "part"),
            ("t/b.markdown", body * 2),
            ("t/skip.txt", body),
        ],
        "path string, content string",
    )
    out = clean_corpus(docs, "https://example.com", directories=["content/s", "t"])
    got = {r.path: r for r in out.collect()}
    assert set(got) == {"s/a.md", "s/part.md", "t/b.markdown"}
    assert got["s/a.md"].content == f"---\nsource_url: https://example.com/s/a/\n---\n{body}{body}part x\n"
    assert got["s/a.md"].size == len(got["s/a.md"].content)
    refs = clean_corpus(docs, refs_first=True).filter("path = 's/a.md'").first()
    assert "[s/b](s/b.md)" in refs.content
    rows = {r.check_name: r.passed for r in verify.report(docs, out).collect()}
    assert rows == dict.fromkeys(verify.CHECKS, True)


def test_report_on_empty_output(spark):
    source = spark.createDataFrame([("a.md", "x" * 60)], "path string, content string")
    rows = {r.check_name: r.passed for r in verify.report(source, source.filter("false")).collect()}
    assert not rows["file_count_match"] and not rows["directory_structure"] and not rows["total_size"]


def test_unclosed_marks_take_linear_time(spark):
    """Texts that only open tags: looking for an end from every start took a minute and more."""
    import time

    tags = '{{< youtube "x" >}} word ' * 20_000
    page = "<!-- note <script> a <a href=\"u\">b " * 20_000
    start = time.time()
    row = spark.createDataFrame([(tags, page)], "tags string, page string").select(
        mk.strip_tags(F.col("tags")).alias("tags"), mk.html_to_text(F.col("page")).alias("page")
    ).first()
    assert row.tags == " word " * 20_000
    assert "<script" not in row.page and row.page.count("<!-- note") == 20_000
    assert time.time() - start < 30


def test_tags_behind_the_last_closing_tag(spark):
    texts = [
        ("{{< youtube >}}a{{< /youtube >}}b{{< youtube >}}c", "bc"),
        ("{{% youtube %}}a{{% /youtube %}}b{{% youtube %}}c{{< x", "bc{{< x"),
        ("<script>a</script>b<script>c<!-- d", "bc<!-- d"),
        ('<a href="u">x</a> <a href="v">y', "x [u] y"),
        ("a < b", "a < b"),
    ]
    got = spark.createDataFrame(texts, "t string, want string").select(mk.html_to_text(mk.strip_tags(F.col("t"))), "want").collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def scan_tags(text, removed):
    """The tag rules as one scan over positions."""
    out, at = [], 0
    while at < len(text):
        head = re.compile(r"\{\{(?:([<%])\s*/?|/)[\w-]+", re.ASCII).match(text, at)
        ends = {"<": r">\}\}", "%": r"%\}\}", None: r"[>%]\}\}"}[head.group(1)] if head else ""
        end = head and re.compile(ends).search(text, head.end())
        if not end:
            out.append(text[at])
            at += 1
            continue
        at = end.end()
        name = re.search(r"[\w-]+$", head.group(), re.ASCII).group()
        if name in removed and "/" not in head.group():
            shut = re.compile(r"\{\{(?:" + head.group(1) + r" ?)?/" + name + r"(?![\w-])[\s\S]*?[>%]\}\}", re.ASCII).search(text, at)
            at = shut.end() if shut else at
    return "".join(out)


def test_tags_match_a_scan(spark):
    rng = random.Random(5)
    bits = ["{{< gone >}}", "{{< /gone >}}", "{{% gone a=1 %}}", "{{% /gone %}}", "{{/gone>}}", "{{< off", "{{</off >}}", "{{%off%}}", "{{< kept >}}",
            "{{</kept>}}", " >}}", "%}}", "{{", "{{< ", "{{%", " x ", "\n", "{{< gone-by >}}", "é😀", "{{/ >}}"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(3000)]
    texts += ["".join(rng.choices(bits, k=2000)) for _ in range(3)]
    got = apply(spark, lambda c: mk.strip_tags(c, {"gone": mk.REMOVE, "off": mk.REMOVE, "kept": mk.STRIP}), *texts)
    for text, found in zip(texts, got):
        assert found == scan_tags(text, {"gone", "off"}), text


def test_html_cases(spark):
    cases = {
        "a<!-- <script> -->b<script>'<!--'</script>c": "abc",
        "<STYLE>p</Style >x<iframe src='u'/>y<script src=u></script>z": "xyz",
        "<a href='u'>x</a> <a href=v >y</a> <a name=q>z</a>": "x [u] y [v] z",
        '<a class="b" href="/p" id="l"> <b>Go</b>\n</a>.': "Go [/p].",
        '<a href="u"> <b></b> </a><a href="w"><img alt="pic"></a>': "upic [w]",
        '<a href="u">x<a href="v">y</a> z': "xy [u] z",
        '</a>x<a href="u">y': "xy",
        '<a href="u">see <table><tr><td>a</td></tr></table></a>': "see a [u]",
        '<table><tr><td><a href="u">t</a></td>\n<td>&lt;b&gt;</td></tr></table> <table>open <td>x': "t [u] <b> open x",
        "<table>a<table><tr><td> b </td></tr></table> c </table>d": "a b c d",
        '<img src=x alt=\'it\' /><img alt=one><img data-alt="no">': "itone",
        "<!doctype html><?xml a?><![if]>x</ y><": "x</ y><",
        "<scripts>x</scripts><script>lone": "xlone",
        "﷐<b>﷓</b>": "��",
        "a <https://e.com/?a=1&amp;b> <mailto:x@y.z> &copy;": "a <https://e.com/?a=1&b> <mailto:x@y.z> ©",
    }
    got = apply(spark, mk.html_to_text, *cases)
    for (text, want), found in zip(cases.items(), got):
        assert found == want, text
    assert apply(spark, lambda c: mk.html_to_text(mk.strip_tags(c)), None, "") == [None, ""]


@pytest.mark.parametrize("bit", ['{{< youtube "x" >}} w ', "{{< youtube >}}{{< /details >}}", "{{< x {{% y ", '<a href="x">', "<a href='u'>b</a>", "<!-- ", "<img alt='x'>",
                                 "<script>", "<table><td>x", "<table></table>", "<!--> ", "< < "])
def test_doubled_marks_double_the_time(spark, bit):
    import time

    def seconds(n):
        docs = spark.createDataFrame([(bit * n + "</a></table>",)] * 8, "t string").repartition(8)
        times = []
        for _ in range(2):
            start = time.time()
            docs.select(F.sum(F.length(mk.html_to_text(mk.strip_tags(F.col("t")))))).collect()
            times.append(time.time() - start)
        return min(times)

    # Five times the text in at most ten times the time, half a second of planning aside.
    assert seconds(20_000) < 10 * seconds(4_000) + 0.5
