"""Inputs of the registered queries, derived from the given tables.

Each input exists twice with the same meaning: a DataFrame function and a SQL
table expression for the comparison. All rows of the tables take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagemill.operators import chunk, embed, evaluate, passages, structure, vector_table
from passagemill.sources.corpus import spread

BASE_URL = "https://example.com/handbook"
CHUNK_SIZE, CHUNK_OVERLAP, DIMS = 128, 16, 64
TOP_K = 10
KS = (1, 3, 5, 10)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- corpus ---------------------------------------------------------------------


def documents(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(
        F.concat("source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.col("text").alias("content"),
        "doc_id",
        "source",
        "lang",
    )


def corpus(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("path", "content")


def markdown(spark, sf_dir) -> DataFrame:
    """Documents rewritten as markdown: the line number decides what a line becomes."""
    s_nl = F.lit("\n")

    def piece(s, j):
        n = j.cast("string")
        return (
            F.when(j == 0, F.concat(F.lit("# "), s))
            .when(j % 8 == 4, F.concat(F.lit("## "), s))
            .when(j % 8 == 6, F.concat(F.lit("### "), s))
            .when(j % 9 == 3, F.concat(F.lit("```text\n"), s, F.lit("\n```")))
            .when(j % 9 == 5, F.concat(F.lit("- "), s))
            .when(
                j % 9 == 7,
                F.concat(
                    F.lit("| item | text |\n| --- | --- |\n| "), n, F.lit(" | "),
                    F.replace(s, F.lit("|"), F.lit("/")), F.lit(" |"),
                ),
            )
            .when(j % 9 == 2, F.concat(F.lit("See [guide "), n, F.lit("](https://example.com/g) and `code` "), s))
            .when(j % 9 == 1, F.concat(s, s_nl, F.lit("tail of line")))
            .otherwise(s)
        )

    pieces = F.transform(F.split("content", "\n"), piece)
    head = F.concat(F.lit("---\ntitle: "), F.col("source"), F.lit("\nlang: "), F.col("lang"), F.lit("\n---\n"))
    return documents(spark, sf_dir).select(
        "path", F.concat(head, F.array_join(pieces, "\n\n")).alias("content")
    )


def tagged(spark, sf_dir) -> DataFrame:
    """Documents with a template tag, reference or HTML suffix chosen by the id."""
    n = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 7
    suffix = (
        F.when(kind == 0, F.concat(F.lit(' {{< youtube id="v'), n, F.lit('" >}} tail')))
        .when(kind == 1, F.lit(" {{< details >}}inner text{{< /details >}} end"))
        .when(kind == 2, F.lit(' {{% alert color="red" %}}note{{% /alert %}} <b>bold</b> text'))
        .when(
            kind == 3,
            F.concat(
                F.lit(' {{< ref "'), F.col("source"), F.lit("/doc-"), (F.col("doc_id") + 1).cast("string"),
                F.lit('#part" >}}'),
            ),
        )
        .when(
            kind == 4,
            F.concat(F.lit(' {{< relref "doc-'), (F.col("doc_id") + 20).cast("string"), F.lit('" >}} more')),
        )
        .when(kind == 5, F.lit(" {{< member-by-name >}}hidden{{< /member-by-name >}} shown"))
        .otherwise(F.lit(' plain & simple <a href="https://example.com/x">link</a>'))
    )
    return documents(spark, sf_dir).select("path", F.concat("content", suffix).alias("content"), "doc_id", "source")


def including(spark, sf_dir) -> DataFrame:
    """Documents with includes: chains, two-document cycles, self-includes of a shared page, missing targets."""
    n, kind = F.col("doc_id"), F.col("doc_id") % 7

    def tag(target):
        return F.concat(F.lit(' {{% include "'), target, F.lit('" %}} '))

    def doc(shift):
        return tag(F.concat(F.lit("docs/doc-"), (n + shift).cast("string"), F.lit(".md")))

    suffix = (
        F.when(kind == 0, tag(F.lit("docs/doc-0.md")))
        .when(kind == 2, doc(-1))
        .when(kind == 3, doc(1))
        .when(kind == 4, doc(-1))
        .when(kind == 5, doc(-3))
        .when(kind == 6, F.concat(tag(F.lit("docs/none.md")), tag(F.lit("notes.txt"))))
        .otherwise(F.lit(""))
    )
    return spread(table(spark, sf_dir, "documents")).select(
        F.concat(F.lit("docs/doc-"), n.cast("string"), F.lit(".md")).alias("path"),
        F.concat(F.col("text"), suffix, F.lit("end")).alias("content"),
    )


def fronted(spark, sf_dir) -> DataFrame:
    """Documents with, without and with old-style front matter."""
    kind = F.col("doc_id") % 3
    lead = (
        F.when(
            kind == 0,
            F.concat(F.lit("---\ntitle: "), F.col("source"), F.lit('\nlang: "'), F.col("lang"), F.lit('"\n---\n')),
        )
        .when(
            kind == 1,
            F.concat(F.lit("\n---\nsource_url: old\ndoc: "), F.col("doc_id").cast("string"), F.lit("\n...\n\n")),
        )
        .otherwise(F.lit(""))
    )
    return documents(spark, sf_dir).select(
        "path", F.concat(lead, F.col("content")).alias("content"),
        F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string"), F.lit("/")).alias("source_url"),
    )


def pages(spark, sf_dir) -> DataFrame:
    extra = F.concat(
        F.lit('<p><img src="x.png" alt="pic '), F.col("page_id").cast("string"),
        F.lit('"></p>\n<table>\n<tr><th>id</th><th>n</th></tr>\n<tr><td>'), F.col("page_id").cast("string"),
        F.lit("</td><td>1</td></tr></table>"),
    )
    return spread(table(spark, sf_dir, "pages")).select(
        F.col("page_id"), F.col("url").alias("path"), F.concat("html", extra).alias("content")
    )


# --- index and retrieval ---------------------------------------------------------


def chunks(spark, sf_dir) -> DataFrame:
    return chunk.fixed_chunks(structure.parse_plain(corpus(spark, sf_dir)), CHUNK_SIZE, CHUNK_OVERLAP)


def points(spark, sf_dir) -> DataFrame:
    embedded = embed.embed_with(chunks(spark, sf_dir), embed.md5_bag_of_words(DIMS), "md5-bag-of-words")
    return vector_table.to_points(embedded)


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("vector"), "label", F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("document_path")
    )


def label_queries(spark, sf_dir) -> DataFrame:
    """One query vector per label: the mean of its vectors (averaged per position before the shuffle)."""
    entries = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("query_id"), F.posexplode("embedding").alias("pos", "x")
    )
    means = entries.groupBy("query_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("query_vector")
    )


def questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("question_id"),
        F.col("text").alias("question"),
    )


def passage_judgments(spark, sf_dir) -> DataFrame:
    """Documents that contain a question's passage: ``question_id, document_path, grade``; well-rated documents grade 3."""
    docs = documents(spark, sf_dir)
    asked = questions(spark, sf_dir).select(F.col("question_id").alias("id"), F.col("question").alias("text"))
    found = passages.find_passages(docs, asked).select(F.col("id").alias("question_id"), "path")
    rated = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id", F.lit(3).alias("rated"))
    return (
        found.join(docs.select("path", "doc_id"), "path")
        .join(rated, "doc_id", "left")
        .select("question_id", F.col("path").alias("document_path"), F.coalesce("rated", F.lit(2)).alias("grade"))
    )


# --- evaluation rows --------------------------------------------------------------


def _line_rank():
    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def order_results(spark, sf_dir) -> DataFrame:
    """Orders as questions: their line items give a ranked result list and graded judgments.

    Results are the top ``TOP_K`` lines; judged paths come from nine values, so both lists are bounded.
    """
    lines = table(spark, sf_dir, "lineitem")
    ranked = (
        lines.withColumn("rank", F.row_number().over(_line_rank()))
        .filter(F.col("rank") <= TOP_K)
        .select(
            F.col("l_orderkey").alias("o_orderkey"), "rank",
            F.concat(F.lit("doc-"), (F.col("l_partkey") % 9).cast("string")).alias("document_path"),
            (F.lit(1.0) - F.col("l_tax")).alias("score"),
        )
    )
    judged = (
        lines.groupBy(
            F.col("l_orderkey").alias("o_orderkey"),
            F.concat(F.lit("doc-"), (F.col("l_suppkey") % 9).cast("string")).alias("document_path"),
        )
        .agg(F.max(F.col("l_quantity").cast("int") % 4).alias("grade"))
        .groupBy("o_orderkey")
        .agg(F.array_sort(F.collect_list(F.struct("document_path", "grade"))).alias("relevance"))
    )
    signals = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.round(F.max("l_discount") * 100, 2).alias("raw_score"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("prompt_tokens"),
        F.count("*").alias("completion_tokens"),
    )
    return (
        spread(table(spark, sf_dir, "orders"))
        .join(evaluate.collect_results(ranked, "o_orderkey"), "o_orderkey", "left")
        .join(judged, "o_orderkey", "left")
        .join(signals, "o_orderkey", "left")
        .select(
            F.col("o_orderpriority").alias("run_id"),
            F.concat(F.lit("q-"), F.col("o_orderkey").cast("string")).alias("question_id"),
            F.concat(F.lit("customer-segment-"), (F.col("o_custkey") % 11).cast("string")).alias("category"),
            F.col("o_orderstatus").alias("difficulty"),
            "retrieved_paths", "scores", "relevance",
            F.col("raw_score").alias("answer_score"),
            F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"),
            F.coalesce("completion_tokens", F.lit(0)).alias("completion_tokens"),
            (F.col("o_totalprice") / 25).cast("bigint").alias("latency_ms"),
            F.col("raw_score").isNull().alias("failed"),
            F.col("o_orderdate").alias("created_at"),
        )
    )


def scored_orders(spark, sf_dir) -> DataFrame:
    return evaluate.score_questions(order_results(spark, sf_dir), TOP_K)


def runs(spark, sf_dir) -> DataFrame:
    """One run per order priority; its creation time is its first order date plus its number in seconds."""
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("run_id")).agg(
        F.min("o_orderdate").alias("first_at")
    )
    number = F.substring("run_id", 1, 1)
    return first.select(
        "run_id",
        F.concat(F.lit("nightly-evaluation-"), number).alias("tag"),
        F.concat(F.lit('{"chunker":"fixed","k":'), number, F.lit("}")).alias("strategy"),
        (F.col("first_at") + F.make_dt_interval(secs=number.cast("int"))).alias("created_at"),
    )


def run_metrics(spark, sf_dir) -> DataFrame:
    return evaluate.aggregate_metrics(scored_orders(spark, sf_dir), KS)


# --- jobs and conversations ---------------------------------------------------------


def jobs(spark, sf_dir) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    state = F.element_at(
        F.array(*[F.lit(s) for s in ("available", "running", "retryable", "completed", "cancelled", "discarded", "scheduled")]),
        k % 7 + 1,
    )
    final = state.isin("completed", "cancelled", "discarded")
    return spread(table(spark, sf_dir, "events")).select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type").isin("click", "view"), "eval")
        .when(F.col("event_type") == "purchase", "index")
        .otherwise("preprocess")
        .alias("kind"),
        state.alias("state"),
        F.concat(F.lit('{"tag":"tag-'), k.cast("string"), F.lit('","batch_size":20}')).alias("args"),
        (k % 4 + 1).alias("attempt"),
        F.lit(4).alias("max_attempts"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("attempted_at"),
        F.when(final, F.col("ts") + F.make_dt_interval(mins=F.col("value").cast("int"))).alias("finalized_at"),
        F.transform(
            F.when(k % 4 > 0, F.sequence(F.lit(1), k % 4)).otherwise(F.array().cast("array<int>")),
            lambda a: F.struct(a.alias("attempt"), F.concat(F.lit("timeout after "), F.col("value").cast("int").cast("string")).alias("error")),
        ).alias("errors"),
    )


def messages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def question_lines(spark, sf_dir) -> DataFrame:
    """JSON lines in three datasets: good questions, blank, malformed, without id, without question."""
    n = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 10
    good = F.to_json(
        F.struct(
            F.concat(F.lit("q-"), n).alias("id"),
            F.col("lang").alias("category"),
            F.col("source").alias("difficulty"),
            F.col("text").alias("question"),
            F.array(
                F.struct(F.concat(F.lit("doc-"), n, F.lit(".md")).alias("document_path"), (F.col("doc_id") % 4).cast("int").alias("grade"))
            ).alias("relevance"),
            F.lit("yes").alias("expected_answer"),
        )
    )
    line = (
        F.when(kind == 1, F.lit(""))
        .when((kind == 2) & (F.col("doc_id") % 3 == 0), F.concat(F.lit('{"id": "broken-'), n))
        .when(kind == 3, F.concat(F.lit('{"id":"","question":"none '), n, F.lit('"}')))
        .when(kind == 4, F.concat(F.lit('{"id":"only-'), n, F.lit('"}')))
        .otherwise(good)
    )
    return spread(table(spark, sf_dir, "documents")).select(
        F.concat(F.lit("set-"), (F.col("doc_id") % 3).cast("string"), F.lit(".jsonl")).alias("dataset"),
        F.col("doc_id").alias("line_no"),
        line.alias("line"),
    )
