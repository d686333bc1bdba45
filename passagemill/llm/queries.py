"""The numbered queries with their SQL twins, and the pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagemill.llm import (
    collision_search,
    conversation_repair,
    hard_negatives,
    jaccard_join,
    language_id,
    license_scan,
    line_dedup,
    mixing,
    packing,
    pii,
    secrets,
    toxicity,
    va_search,
)

QUERIES = {}


def add(name, run, sql=None):
    QUERIES[name] = (run, sql)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


add("op1_harmonic_packing", op1)


def op2(spark, sf_dir):
    found = pii.find_pii(table(spark, sf_dir, "documents"), carry=["doc_id"])
    base = F.filter("pii", lambda s: s["base"])

    def counted(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[counted(kind) for kind in pii.KINDS],
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("pii")).alias("spans"),
    )


add("op2_personal_data", op2)


def op3(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


add(
    "op3_mix_sources",
    op3,
    f"""WITH sizes AS (SELECT doc_id, source,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
named AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM totals),
shares AS (SELECT *,
    sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open
  FROM named WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT arg_max(rest, rest / open) AS rest, arg_max(open, rest / open) AS open FROM shares),
targets AS (SELECT s.source, s.source_size, least((3 * s.source_size)::DOUBLE, (s.weight * b.rest)::DOUBLE / b.open::DOUBLE) AS target
  FROM shares s, best b),
rated AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM sizes d JOIN targets t ON t.source IS NOT DISTINCT FROM d.source),
tried AS (SELECT r.*, j.seed, size * (floor(rate) + CASE WHEN ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), j.seed + 1, 8))::BIGINT
    < (rate - floor(rate)) * 4294967296.0 THEN 1 ELSE 0 END)::BIGINT AS taken FROM rated r, range({mixing.SEEDS}) j(seed)),
missed AS (SELECT source, seed, abs(sum(taken) - any_value(target)) AS miss FROM tried GROUP BY source, seed),
chosen AS (SELECT source, arg_min(seed, (miss, seed)) AS seed FROM missed GROUP BY source)
SELECT doc_id, size, source_size, target, taken FROM tried t JOIN chosen c
  ON c.source IS NOT DISTINCT FROM t.source AND c.seed = t.seed""",
)


def op4(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


add("op4_ngram_jaccard_join", op4)


def op5(spark, sf_dir):
    return collision_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


add("op5_collision_search", op5)


def op6(spark, sf_dir):
    return va_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


add(
    "op6_va_file_search",
    op6,
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings),
scored AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5""",
)


def op7(spark, sf_dir):
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


add("op7_license_scan", op7)


def op8(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


add(
    "op8_line_dedup",
    op8,
    """WITH lines AS (SELECT doc_id, line, pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
    unnest(l) WITH ORDINALITY AS u(line, pos)),
w AS (SELECT doc_id, pos, line AS a, lead(line) OVER d AS b, lead(line, 2) OVER d AS c FROM lines
  WINDOW d AS (PARTITION BY doc_id ORDER BY pos) QUALIFY c IS NOT NULL),
r AS (SELECT *, count(*) OVER (PARTITION BY a, b, c) AS n, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM w),
cover AS (SELECT doc_id, pos + i AS pos, bool_or(k = 1) AS kept FROM r, range(3) s(i) WHERE n > 1 GROUP BY ALL),
left_over AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (c.kept IS DISTINCT FROM false) AS text,
    count(*) AS n_lines, count(*) FILTER (c.kept = false) AS n_removed
  FROM lines l LEFT JOIN cover c ON c.doc_id = l.doc_id AND c.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, d.lang, d.source, coalesce(o.text, '') AS text, length(coalesce(o.text, '')) AS n_chars, o.n_lines, o.n_removed
FROM documents d JOIN left_over o ON o.doc_id = d.doc_id""",
)


def op9(spark, sf_dir):
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["base"])

    def counted(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[counted(rule.kind) for rule in secrets.RULES if rule.base],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("secrets")).alias("spans"),
    )


add("op9_secret_scan", op9)


def op10(spark, sf_dir):
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", F.col("toxic_predicted").alias("predicted")
    )


add("op10_toxicity", op10)


def op11(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), F.col("embedding").alias("v")
    )
    return hard_negatives.mine_negatives(rows, F.col("vec_id") % 50 == 0)


add(
    "op11_hard_negatives",
    op11,
    """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings),
scored AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.e, v.e)::BIGINT AS score
  FROM v AS a JOIN v ON v.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INT AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3""",
)


def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = language_id.identify_languages(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


add("op12_language_id", op12)


def damaged(conversations):
    """Rows dropped, emptied, robbed of their marks, doubled or given another role, by a checksum of conversation and turn."""
    rows = conversations.select(
        "conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")],
        (F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]).cast("binary")) % 20).alias("kind"),
    )
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.filter(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def op13(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    edits, summary = conversation_repair.repair(damaged(conversations))
    hashes = conversation_repair.repaired_digests(edits)
    every = conversations.select("conv_id").distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def matched(left, right, name):
        right = right.withColumnRenamed("conv_id", name)
        return left.join(right, F.col("conv_id").eqNullSafe(F.col(name)), "left").drop(name)

    return matched(matched(every, summary, "_s"), hashes, "_h").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


add("op13_conversation_repair", op13)
