"""Queries on embedding, the vector table and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagemill.catalog import fixtures as fx
from passagemill.catalog import sql as q
from passagemill.functions import ids
from passagemill.functions import vectors as vx
from passagemill.operators import embed, keyword, retrieve
from passagemill.operators import vector_table as vt
from passagemill.catalog.corpus_queries import scratch
from passagemill.plans.index_job import plan_index
from passagemill.plans.registry import RETRIEVERS
from passagemill.session import cut_lineage
from passagemill.sources import tables
from passagemill.sources.corpus import spread
from passagemill.streaming.ingest import index_stream

QUERIES = {}


def add(name, run, sql=None):
    QUERIES[name] = (run, sql)


# --- embedding -------------------------------------------------------------------


def rounded(df, column="vector", digits=6):
    """One row per vector position, values rounded for comparison."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(column).alias("pos", "x")).select(
        *rest, "pos", F.round(F.col("x").cast("double"), digits).alias("x")
    )


def embedded_chunks(spark, sf):
    made = embed.embed_with(fx.chunks(spark, sf), embed.md5_bag_of_words(fx.DIMS), "md5-bag-of-words")
    return rounded(made.select("chunk_id", "dimensions", "vector"))


add("x1_embed_chunks", embedded_chunks, q.query(
    f"""SELECT chunk_id, {fx.DIMS} AS dimensions, (generate_subscripts(vector, 1) - 1)::INT AS pos, round(unnest(vector), 6) AS x FROM chunk_vectors""",
    "chunk_vectors"))


def hashed_embedding(spark, sf):
    made = embed.hashed_vectors(fx.chunks(spark, sf), fx.DIMS)
    return made.select("chunk_id", "dimensions", F.round(vx.norm(F.col("vector")), 6).alias("norm"))


add("x1_hashed_vectors", hashed_embedding, q.query(
    f"SELECT chunk_id, {fx.DIMS} AS dimensions, 1.0 AS norm FROM chunks WHERE content <> ''", "chunks"))
add("x2_dimension_check",
    lambda s, d: embed.dimension_check(fx.vectors(s, d)),
    "SELECT count(*) AS n, min(len(embedding))::INT AS min_dims, max(len(embedding))::INT AS max_dims, min(len(embedding)) = max(len(embedding)) AS consistent FROM embeddings")


def narrowed(spark, sf):
    wide = F.transform("vector", lambda x: x.cast("double") * F.lit(1.1))
    narrow = fx.vectors(spark, sf).select("vec_id", vx.to_float32(wide).alias("vector"))
    return rounded(narrow)


add("x3_to_float32", narrowed,
    "SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS pos, round((unnest(embedding)::DOUBLE * 1.1)::FLOAT::DOUBLE, 6) AS x FROM embeddings")
add("x4_point_ids",
    lambda s, d: fx.chunks(s, d).select("chunk_id", ids.uuid5_dns(F.col("chunk_id")).alias("point_id")),
    q.query(f"SELECT chunk_id, {q.uuid5('chunk_id')} AS point_id FROM chunks", "chunks"))


def index_plan(spark, sf, max_bytes=None):
    """All documents, and a blank page per source that only the ledger gets to see."""
    docs = fx.documents(spark, sf)
    blank = docs.select(F.concat("source", F.lit("/blank.md")).alias("path"), F.lit("  \n ").alias("content")).distinct()
    return plan_index(
        docs.select("path", "content").unionByName(blank), embed.md5_bag_of_words(fx.DIMS), "md5-bag-of-words", "plain", "fixed",
        {"size": fx.CHUNK_SIZE, "overlap": fx.CHUNK_OVERLAP}, max_bytes=max_bytes,
    )


_BLANK = "SELECT DISTINCT source||'/blank.md' AS path, 'no chunks' AS skip_reason FROM docs"
_LEDGER = f"""{_BLANK}
UNION ALL SELECT path, strlen(content)||' bytes exceed the limit of 20000' FROM docs WHERE strlen(content) > 20000"""
add("x5_index_points",
    lambda s, d: rounded(index_plan(s, d).points.select("point_id", "chunk_id", "document_path", "content", "token_count", "chunk_index", "vector")),
    q.query(f"""SELECT {q.uuid5('c.chunk_id')} AS point_id, c.chunk_id, c.document_path, c.content, c.token_count, c.chunk_index,
  (generate_subscripts(v.vector, 1) - 1)::INT AS pos, round(unnest(v.vector)::FLOAT::DOUBLE, 6) AS x
FROM chunks c JOIN chunk_vectors v USING (chunk_id)""", "chunks", "chunk_vectors"))
add("x5_skip_ledger", lambda s, d: index_plan(s, d, max_bytes=20000).ledger,
    q.query("SELECT * FROM ledger", "docs", extra={"ledger": _LEDGER}))
add("x6_index_summary", lambda s, d: index_plan(s, d).summary(),
    q.query("""SELECT count(DISTINCT document_path) AS documents, count(*) AS chunks, (SELECT count(*) FROM ledger) AS skipped
FROM chunks""", "chunks", extra={"ledger": _BLANK}))

# --- vector table -----------------------------------------------------------------


def vector_points(spark, sf):
    return fx.vectors(spark, sf).select(
        ids.uuid5_dns(F.col("document_path")).alias("point_id"), "vec_id", "vector", F.col("label").alias("collection")
    )


def upserted(spark, sf):
    """Every second vector arrives again, negated, in up to three versions."""
    existing = vector_points(spark, sf)
    incoming = (
        existing.filter(F.col("vec_id") % 2 == 0)
        .select("*", F.explode(F.sequence(F.lit(1), (F.col("vec_id") % 3 + 1).cast("int"))).alias("seq"))
        .withColumn("vector", F.transform("vector", lambda x: -x * F.col("seq").cast("float")))
    )
    return rounded(vt.upsert(existing, incoming, seq="seq").select("vec_id", "collection", "vector"))


add("w2_vector_upsert", upserted, """SELECT vec_id, label AS collection, (generate_subscripts(embedding, 1) - 1)::INT AS pos,
  round((unnest(embedding) * CASE WHEN vec_id % 2 = 0 THEN -(vec_id % 3 + 1) ELSE 1 END)::FLOAT::DOUBLE, 6) AS x FROM embeddings""")


def replaced(spark, sf):
    """Re-indexing with larger chunks leaves no stale points behind."""
    from passagemill.operators import chunk, structure

    docs = fx.documents(spark, sf)
    old = fx.chunks(spark, sf).select("chunk_id", "document_path", "content")
    redone = docs.filter(F.col("lang") == "en").select("path", "content")
    new = chunk.fixed_chunks(structure.parse_plain(redone), 512, 64).select("chunk_id", "document_path", "content")
    return vt.replace_documents(old, new).groupBy("document_path").agg(
        F.count("*").alias("n"), F.sum(F.length("content")).alias("n_chars")
    )


_FULL = """SELECT path AS document_path, array_to_string(w[i*448+1 : CASE WHEN i < full_n THEN i*448+512 ELSE len(w) END], ' ') AS content FROM (
  SELECT path, w, full_n, unnest(range(full_n + (full_n*448 < len(w))::INT)) AS i FROM (
    SELECT path, w, CASE WHEN len(w) < 512 THEN 0 ELSE (len(w)-512) // 448 + 1 END AS full_n FROM (
      SELECT path, """ + q.words("content") + """ AS w FROM docs WHERE lang = 'en')))"""
add("w2_replace_documents", replaced, q.query(
    """SELECT document_path, count(*) AS n, sum(length(content))::BIGINT AS n_chars FROM (
  SELECT document_path, content FROM big UNION ALL
  SELECT c.document_path, c.content FROM chunks c JOIN docs d ON d.path = c.document_path WHERE d.lang <> 'en') GROUP BY 1""",
    "docs", "chunks", extra={"big": _FULL}))


def stored_replacement(spark, sf):
    """All documents stored, a third re-indexed as one word, a third emptied, compacted and the second write replayed."""
    path = scratch(spark, "replaced")
    docs = fx.documents(spark, sf)
    kind = F.col("doc_id") % 3
    redone = docs.filter(kind < 2).select("path", F.when(kind == 0, F.col("lang")).otherwise(F.lit("")).alias("content"))

    def indexed(pages):
        return plan_index(pages, embed.md5_bag_of_words(fx.DIMS), "md5-bag-of-words", "plain", "fixed",
                          {"size": fx.CHUNK_SIZE, "overlap": fx.CHUNK_OVERLAP}).points

    tables.write_points(indexed(docs.select("path", "content")), path, "all:pages")
    for _ in range(2):
        tables.write_points(indexed(redone), path, "all:pages", 1, replaces=redone.select(F.col("path").alias("document_path")))
        tables.compact_points(spark, path, "all:pages")
    return tables.read_points(spark, path, "all:pages").select("point_id", "chunk_id", "content")


add("w2_stored_replacement", stored_replacement, q.query(
    f"""SELECT {q.uuid5('c.chunk_id')} AS point_id, c.chunk_id, c.content FROM chunks c JOIN docs d ON d.path = c.document_path WHERE d.doc_id % 3 = 2
UNION ALL SELECT {q.uuid5("path||'-chunk-0000'")}, path||'-chunk-0000', lang FROM docs WHERE doc_id % 3 = 0""", "docs", "chunks"))
def committed_versions(spark, sf):
    """Batches, bulk writes, compaction and replays: a replayed batch neither takes a place nor comes back."""
    path = scratch(spark, "commits")
    points = vector_points(spark, sf)

    def write(name, rows, **batch):
        tables.write_points(rows.select("point_id", F.col("vec_id").cast("string").alias("chunk_id"), F.lit(name).alias("content")), path, "all", **batch)

    write("stream", points, writer="stream", seq=0)
    write("bulk", points.filter("vec_id % 2 = 0"))
    tables.compact_points(spark, path, "all")
    write("late", points.filter("vec_id % 3 = 0"))
    write("stream", points, writer="stream", seq=0)
    write("next", points.filter("vec_id % 5 = 0"), writer="stream", seq=1)
    write("other", points.filter("vec_id % 7 = 0"), writer="other", seq=0)
    tables.compact_points(spark, path, "all")
    write("next", points, writer="stream", seq=1)
    return tables.read_points(spark, path, "all").select("point_id", "chunk_id", "content")


add("w2_commit_replay", committed_versions, f"""SELECT {q.uuid5("'vec-'||vec_id")} AS point_id, vec_id::VARCHAR AS chunk_id,
  CASE WHEN vec_id % 7 = 0 THEN 'other' WHEN vec_id % 5 = 0 THEN 'next' WHEN vec_id % 3 = 0 THEN 'late' WHEN vec_id % 2 = 0 THEN 'bulk' ELSE 'stream' END AS content
FROM embeddings""")
add("w3_collection_check",
    lambda s, d: vt.collection_check(vector_points(s, d), 64),
    "SELECT label AS collection, count(*) AS vector_count, min(len(embedding))::INT AS min_size, max(len(embedding))::INT AS max_size, 64 AS declared_size, min(len(embedding)) = 64 AND max(len(embedding)) = 64 AS consistent FROM embeddings GROUP BY label")


def projected(spark, sf):
    made = vt.to_points(
        embed.hashed_vectors(fx.chunks(spark, sf), fx.DIMS).withColumn(
            "metadata", F.create_map(F.lit("content"), F.lit("other"), F.lit("source_url"), F.col("document_path"))
        )
    )
    return made.select(
        "point_id", "document_path", "content", "token_count", "chunk_index", "model",
        F.size("vector").alias("dims"), F.element_at("metadata", "source_url").alias("source_url"),
        F.element_at("metadata", "content").alias("meta_content"),
    )


add("w4_point_projection", projected, q.query(
    f"""SELECT {q.uuid5('chunk_id')} AS point_id, document_path, content, token_count, chunk_index, 'hashing-tf' AS model, {fx.DIMS} AS dims,
  document_path AS source_url, 'other' AS meta_content FROM chunks""", "chunks"))


def deleted_collections(spark, sf):
    pts = vector_points(spark, sf)
    small = pts.groupBy("collection").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    doomed = small.filter(F.col("first") % 2 == 0).select(F.col("collection").alias("name"))
    return vt.delete_collections(pts, doomed).select("point_id", "vec_id", "collection")


add("w5_delete_collection", deleted_collections,
    f"""SELECT {q.uuid5("'vec-'||vec_id")} AS point_id, vec_id, label AS collection FROM embeddings
WHERE label NOT IN (SELECT label FROM embeddings GROUP BY label HAVING min(vec_id) % 2 = 0)""")
add("s8_collection_catalogue",
    lambda s, d: vt.collections(vector_points(s, d)),
    "SELECT label AS name, count(*) AS vector_count, max(len(embedding))::INT AS vector_size, 'Cosine' AS distance FROM embeddings GROUP BY label")

# --- retrieval ----------------------------------------------------------------------

_VEC = dict(id_col="vec_id")


def rounded_score(df):
    return df.withColumn("score", F.round("score", 6))


def dense_search(spark, sf):
    found = retrieve.top_k(fx.vectors(spark, sf), fx.label_queries(spark, sf), fx.TOP_K, carry=["label"], **_VEC)
    return rounded_score(found).select("query_id", "rank", "vec_id", "label", "score")


add("r1_top_k_cosine", dense_search, q.query(
    f"SELECT query_id, rank, vec_id, label, round(score, 6) AS score FROM ranked WHERE rank <= {fx.TOP_K}", "ranked"))


def blockwise_search(spark, sf):
    """Many blocks on both sides."""
    found = retrieve.top_k(
        fx.vectors(spark, sf), fx.label_queries(spark, sf), fx.TOP_K, queries_per_block=3, point_bytes=10_000, **_VEC
    )
    return rounded_score(found).select("query_id", "rank", "vec_id", "score")


add("r1_top_k_partitioned", blockwise_search, q.query(
    f"SELECT query_id, rank, vec_id, round(score, 6) AS score FROM ranked WHERE rank <= {fx.TOP_K}", "ranked"))


def self_search(spark, sf):
    """Every vector as a query against all vectors."""
    asked = fx.vectors(spark, sf).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))
    # A table of few row groups would be searched by few tasks; dealing it out costs its size once, the search its square.
    vectors = fx.vectors(spark, sf).repartition(spark.sparkContext.defaultParallelism)
    found = retrieve.top_k(vectors, asked, fx.TOP_K, **_VEC)
    return rounded_score(found).select("query_id", "rank", "vec_id", "score")


add("r1_top_k_many_queries", self_search, f"""SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score
    FROM embeddings a, embeddings b)) WHERE rank <= {fx.TOP_K}""")


def distances(spark, sf):
    out = None
    for name in ("Dot", "Euclid", "Manhattan", "no such name"):
        part = retrieve.top_k(fx.vectors(spark, sf), fx.label_queries(spark, sf), fx.TOP_K, name, **_VEC)
        part = rounded_score(part).select(F.lit(name).alias("distance"), "query_id", "rank", "vec_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


add("r2_distances", distances, q.query(
    f"""SELECT distance, query_id, rank, vec_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY distance, query_id ORDER BY CASE WHEN distance IN ('Euclid','Manhattan') THEN score ELSE -score END, vec_id) AS rank FROM (
    SELECT query_id, vec_id, unnest(['Dot','Euclid','Manhattan','no such name']) AS distance,
      unnest([round(list_dot_product(embedding::DOUBLE[], qv), 9), round(list_distance(embedding::DOUBLE[], qv), 9),
        round(list_sum(list_transform(list_zip(embedding::DOUBLE[], qv), lambda p: abs(p[1] - p[2]))), 9),
        round(list_cosine_similarity(embedding::DOUBLE[], qv), 9)]) AS score FROM embeddings, centroids)) WHERE rank <= {fx.TOP_K}""", "centroids"))


def scalar_cosine(spark, sf):
    """Each vector against the mean of its own label: an equi-join with one row per label."""
    own = fx.vectors(spark, sf).join(fx.label_queries(spark, sf).withColumnRenamed("query_id", "label"), "label")
    guarded = [
        vx.cosine(F.col("vector"), F.col("query_vector")).alias("similarity"),
        vx.cosine(F.col("vector"), F.slice("query_vector", 1, 3)).alias("unequal"),
        vx.cosine(F.array_repeat(F.lit(0.0), 64), F.col("query_vector")).alias("zero"),
    ]
    return own.select("vec_id", *guarded).withColumn("similarity", F.round("similarity", 6))


add("r3_cosine_scalar", scalar_cosine, q.query(
    'SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], qv), 6) AS similarity, 0.0 AS unequal, 0.0 AS "zero" FROM embeddings JOIN centroids ON query_id = label', "centroids"))


def strategy(name):
    def run(spark, sf):
        config = {"k": 5, "carry": ["vector"], **_VEC}
        found = RETRIEVERS.run(name, fx.vectors(spark, sf), fx.label_queries(spark, sf), config=config)
        return rounded_score(found).select("query_id", "rank", "vec_id", "score")

    return run


add("r4_naive_search", strategy("naive-search"), q.query(
    "SELECT query_id, rank, vec_id, round(score, 6) AS score FROM ranked WHERE rank <= 5", "ranked"))

# greedy selection as a recursion over picked ids
_PICKS = """SELECT query_id, 0 AS step, []::BIGINT[] AS picked FROM centroids
UNION ALL
SELECT p.query_id, p.step + 1, list_append(p.picked, (
  SELECT r.vec_id FROM ranked r WHERE r.query_id = p.query_id AND NOT list_contains(p.picked, r.vec_id)
  ORDER BY round(0.7 * r.score - 0.3 * greatest(0, coalesce((SELECT max(list_cosine_similarity(r.vector, o.vector)) FROM ranked o
    WHERE o.query_id = r.query_id AND list_contains(p.picked, o.vec_id)), 0)), 12) DESC, r.rank LIMIT 1))
FROM picks p WHERE p.step < 5"""
add("r5_mmr_rerank", strategy("mmr-rerank"), q.query(
    """SELECT f.query_id, f.rank, f.vec_id, round(r.score, 6) AS score FROM (
  SELECT query_id, unnest(picked) AS vec_id, generate_subscripts(picked, 1) AS rank FROM picks WHERE step = 5) f JOIN ranked r USING (query_id, vec_id)""",
    "ranked", extra={"picks": _PICKS}, recursive=True))


def candidate_pairs(spark, sf):
    found = retrieve.top_k(
        fx.vectors(spark, sf), fx.label_queries(spark, sf), 15, carry=["vector"], **_VEC
    )
    return retrieve.candidate_similarity(found, **_VEC).withColumn("similarity", F.round("similarity", 6))


add("r6_candidate_similarity", candidate_pairs, q.query(
    """SELECT a.query_id, a.rank AS rank_a, b.rank AS rank_b, a.vec_id AS id_a, b.vec_id AS id_b,
  round(list_cosine_similarity(a.vector, b.vector), 6) AS similarity
FROM ranked a JOIN ranked b ON a.query_id = b.query_id AND a.rank < b.rank""", "ranked"))


def payload_split(spark, sf):
    payload = fx.chunks(spark, sf).select(
        "chunk_id",
        F.create_map(
            F.lit("content"), F.col("content"), F.lit("document_path"), F.col("document_path"),
            F.lit("token_count"), F.col("token_count").cast("string"), F.lit("chunk_index"), F.col("chunk_index").cast("string"),
            F.lit("model"), F.lit("m"), F.lit("title"), F.substring("content", 1, 10),
        ).alias("payload"),
    )
    columns, metadata = vt.split_payload()
    return payload.select("chunk_id", *columns, metadata).select(
        "chunk_id", "content", "document_path", "token_count", "chunk_index", "model",
        F.size("metadata").alias("n_meta"), F.element_at("metadata", "title").alias("title"),
    )


add("r8_payload_split", payload_split, q.query(
    """SELECT chunk_id, content, document_path, token_count, chunk_index::BIGINT AS chunk_index, 'm' AS model, 1 AS n_meta, substr(content, 1, 10) AS title FROM chunks""", "chunks"))


def retrieved(spark, sf, carry):
    """Every benchmark question against all chunks."""
    asked = embed.embed_with(fx.questions(spark, sf), embed.md5_bag_of_words(fx.DIMS), "md5-bag-of-words", text_col="question")
    return retrieve.top_k(
        fx.points(spark, sf), asked, fx.TOP_K, query_id="question_id", query_vector="vector", carry=carry
    )


add("r7_batch_retrieval",
    lambda s, d: rounded_score(retrieved(s, d, ["document_path", "chunk_index"])),
    q.query("SELECT question_id, chunk_id, round(score, 6) AS score, document_path, r.rank, c.chunk_index FROM retrieved r JOIN chunks c USING (chunk_id, document_path)", "retrieved"))


def with_url(df):
    """Addresses for English pages only, so both label forms occur."""
    has = F.col("document_path").endswith("1.md")
    return df.withColumn(
        "metadata",
        F.when(has, F.create_map(F.lit("source_url"), F.concat(F.lit("https://example.com/"), F.col("document_path")))).otherwise(
            F.create_map().cast("map<string,string>")
        ),
    )


_URL = "CASE WHEN ends_with(document_path, '1.md') THEN 'https://example.com/'||document_path END"
add("r9_sources",
    lambda s, d: rounded_score(retrieve.sources(with_url(retrieved(s, d, ["document_path"])), "question_id")),
    q.query(f"SELECT question_id, rank, document_path, round(score, 6) AS score, {_URL} AS source_url FROM retrieved", "retrieved"))
for _style, _lead, _gap in (("evaluation", "chr(10)||'Content:'||chr(10)", "chr(10)||chr(10)||'---'||chr(10)||chr(10)"),
                            ("chat", "chr(10)", "chr(10)||chr(10)")):
    add(f"r10_context_{_style}",
        lambda s, d, st=_style: retrieve.assemble_context(with_url(retrieved(s, d, ["document_path", "content"])), st, "question_id"),
        q.query(f"""SELECT question_id, string_agg('Document: '||coalesce({_URL}, document_path)||{_lead}||content, {_gap} ORDER BY rank) AS context
FROM retrieved GROUP BY question_id""", "retrieved"))


def keyword_hits(spark, sf):
    """Every benchmark question against the stored index of all chunks."""
    path = scratch(spark, "keywords")
    index = keyword.build_index(fx.chunks(spark, sf), path=path)
    return rounded_score(keyword.keyword_search(index, fx.questions(spark, sf), fx.TOP_K, query_id="question_id"))


_KEYWORDS = {
    "kw_words": "SELECT chunk_id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS ws FROM chunks",
    "kw_mean": "SELECT count(*) AS n, avg(len(ws)) AS mean FROM kw_words",
    "kw_postings": "SELECT chunk_id, len(ws) AS length, unnest(ws) AS term FROM kw_words",
    "kw_counts": "SELECT chunk_id, length, term, count(*) AS tf FROM kw_postings GROUP BY ALL",
    "kw_terms": "SELECT term, count(*) AS df FROM kw_counts GROUP BY term",
    "kw_asked": "SELECT DISTINCT question_id, unnest(regexp_extract_all(lower(question), '[\\p{L}\\p{N}]+')) AS term FROM questions",
    "kw_ranked": """SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY worth DESC, chunk_id) AS rank FROM (
  SELECT question_id, chunk_id, sum(round(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) * 1000000000)::BIGINT) AS worth
  FROM kw_asked JOIN kw_terms USING (term) JOIN kw_counts USING (term), kw_mean GROUP BY ALL)""",
}
add("r11_keyword_search", keyword_hits, q.query(
    f"SELECT question_id, chunk_id, round(worth / 1000000000, 6) AS score, rank FROM kw_ranked WHERE rank <= {fx.TOP_K}",
    "chunks", "questions", extra=_KEYWORDS))


def hybrid_hits(spark, sf):
    asked = embed.embed_with(fx.questions(spark, sf), embed.md5_bag_of_words(fx.DIMS), "md5-bag-of-words", text_col="question")
    config = {"k": fx.TOP_K, "query_id": "question_id", "query_vector": "vector", "carry": ["document_path", "chunk_index"]}
    return rounded_score(RETRIEVERS.run("hybrid", cut_lineage(fx.points(spark, sf)), asked, config=config))


add("r11_hybrid_search", hybrid_hits, q.query(
    f"""SELECT question_id, chunk_id, round(score, 6) AS score, document_path, chunk_index, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT coalesce(d.question_id, w.question_id) AS question_id, coalesce(d.chunk_id, w.chunk_id) AS chunk_id,
      coalesce(1 / (60 + d.rank), 0) + coalesce(1 / (60 + w.rank), 0) AS score
    FROM dense d FULL OUTER JOIN (SELECT * FROM kw_ranked WHERE rank <= {3 * fx.TOP_K}) w ON w.question_id = d.question_id AND w.chunk_id = d.chunk_id))
JOIN chunks USING (chunk_id) WHERE rank <= {fx.TOP_K}""",
    "chunks", "questions", "chunk_vectors", "question_vectors", extra={**_KEYWORDS, "dense": f"""SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT q.question_id, v.chunk_id, round(list_cosine_similarity(v.vector::FLOAT[]::DOUBLE[], q.vector), 9) AS score
    FROM question_vectors q, chunk_vectors v)) WHERE rank <= {3 * fx.TOP_K}"""}))


# --- streaming ------------------------------------------------------------------------


def streamed_index(spark, sf):
    """The documents table read as a stream and indexed batch by batch into a points table."""
    path = scratch(spark, "index")
    schema = fx.table(spark, sf, "documents").schema
    # A pattern that only the table matches: a stream takes a folder of files by its name, but one file only by a pattern.
    arriving = spark.readStream.schema(schema).parquet(f"{sf}/documents.parque[t]")

    def prepare(batch):
        return spread(batch).select(
            F.concat("source", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
            F.col("text").alias("content"),
        )

    index_stream(
        arriving, f"{path}/points", "live", embed.md5_bag_of_words(fx.DIMS), "md5-bag-of-words", f"{path}/progress",
        prepare=prepare, parser="plain", chunk_config={"size": fx.CHUNK_SIZE, "overlap": fx.CHUNK_OVERLAP},
    ).awaitTermination()
    return tables.read_points(spark, f"{path}/points", "live").select(
        "point_id", "chunk_id", "content", F.size("vector").alias("dims")
    )


add("x7_incremental_index", streamed_index, q.query(
    f"SELECT {q.uuid5('chunk_id')} AS point_id, chunk_id, content, {fx.DIMS} AS dims FROM chunks", "chunks"))


def changed_documents(spark, sf):
    """The corpus twice: the second time a third of the documents has more words and a third is cut to its first line."""
    docs = fx.documents(spark, sf)
    kind = F.col("doc_id") % 3
    again = F.when(kind == 0, F.concat("content", F.lit(" some more words"))).when(kind == 1, F.substring_index("content", "\n", 1)).otherwise(F.col("content"))
    return docs.select("path", "content"), docs.select("path", again.alias("content"))


def reindexed_stream(spark, sf):
    """A stream of two batches: the second embeds and writes its new and changed chunks only."""
    path = scratch(spark, "reindex")
    for n, batch in enumerate(changed_documents(spark, sf)):
        batch.write.parquet(f"{path}/in/batch={n}")
        arriving = spark.readStream.schema("path string, content string").parquet(f"{path}/in/batch=*")
        index_stream(
            arriving, f"{path}/points", "live", embed.md5_bag_of_words(fx.DIMS), "md5-bag-of-words", f"{path}/progress", changed_only=True,
            parser="plain", chunk_config={"size": fx.CHUNK_SIZE, "overlap": fx.CHUNK_OVERLAP},
        ).awaitTermination()
    found = tables.read_points(spark, f"{path}/points", "live", with_version=True)
    return found.select("point_id", "chunk_id", "content", F.col("version").alias("batch"))


_CHUNKS_OF = q.CTES["chunks"][1].replace("FROM docs", "FROM {0}")
add("x7_changed_chunks", reindexed_stream, q.query(
    f"""SELECT {q.uuid5('chunk_id')} AS point_id, chunk_id, a.content, CASE WHEN c.content = a.content THEN 0 ELSE 1 END AS batch
FROM again a LEFT JOIN chunks c USING (chunk_id)""",
    "chunks", extra={
        "redone": "SELECT path, CASE doc_id % 3 WHEN 0 THEN content||' some more words' WHEN 1 THEN string_split(content, chr(10))[1] ELSE content END AS content FROM docs",
        "again": _CHUNKS_OF.format("redone"),
    }))
