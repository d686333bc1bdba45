"""Queries on sources, cleaning, verification, structuring and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagemill.catalog import fixtures as fx
from passagemill.catalog import sql as q
from passagemill.functions import markup as mk
from passagemill.functions import text as tx
from passagemill.operators import chunk, clean, structure, verify
from passagemill.plans.clean_job import clean_corpus
from passagemill.plans.registry import CHUNKERS
from passagemill.session import checkpoint_folder
from passagemill.sources import corpus, questions, tables

QUERIES = {}


def add(name, run, sql=None):
    QUERIES[name] = (run, sql)


# --- scans ---------------------------------------------------------------------

def corpus_scan(spark, sf):
    docs = fx.documents(spark, sf)
    renamed = docs.withColumn(
        "path",
        F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("path", r"\.md$", ".MARKDOWN"))
        .when(F.col("doc_id") % 3 == 1, F.regexp_replace("path", r"\.md$", ".txt"))
        .otherwise(F.col("path")),
    )
    return renamed.filter(tx.is_markdown(F.col("path"))).select("path", "content")


add("s1_corpus_scan", corpus_scan, q.query(
    """SELECT CASE doc_id % 3 WHEN 0 THEN replace(path, '.md', '.MARKDOWN') ELSE path END AS path, content
FROM docs WHERE doc_id % 3 <> 1""", "docs"))

add("s2_include_directories",
    lambda s, d: clean.filter_directories(fx.corpus(s, d), ["content/src1", "src7", "nowhere"]),
    q.query("SELECT path, content FROM docs WHERE source IN ('src1', 'src7')", "docs"))

add("s2_missing_directories",
    lambda s, d: clean.missing_directories(fx.corpus(s, d), ["content/src1", "src7", "nowhere"]),
    q.query("SELECT d AS directory FROM (SELECT unnest(['src1','src7','nowhere']) AS d) WHERE d NOT IN (SELECT source FROM docs)", "docs"))


def index_scan(spark, sf):
    docs = fx.documents(spark, sf).withColumn(
        "path",
        F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit(".hidden/"), F.col("path")))
        .when(F.col("doc_id") % 11 == 1, F.regexp_replace("path", r"\.md$", ".MD"))
        .otherwise(F.col("path")),
    ).withColumn("size", tx.byte_size(F.col("content")))
    return corpus.index_candidates(docs, max_bytes=5000).select("path", "size", "skip_reason")


add("s3_index_scan", index_scan, q.query(
    """SELECT path, strlen(content)::BIGINT AS size, CASE WHEN strlen(content) > 5000
  THEN strlen(content)||' bytes exceed the limit of 5000' END AS skip_reason
FROM docs WHERE doc_id % 11 NOT IN (0, 1)""", "docs"))


def question_scan(spark, sf):
    parsed = questions.parse_questions(fx.question_lines(spark, sf).drop("dataset"), skip=25)
    judged = F.get("relevance", F.lit(0))
    return parsed.select(
        "line_no", "id", "category", "difficulty", "question",
        judged["document_path"].alias("judged_path"), judged["grade"].alias("grade"), "expected_answer",
    )


add("s4_question_scan", question_scan, q.query(
    """SELECT line_no, 'q-'||doc_id AS id, lang AS category, source AS difficulty, text AS question,
  'doc-'||doc_id||'.md' AS judged_path, (doc_id % 4)::INT AS grade, 'yes' AS expected_answer
FROM (SELECT l.line_no, d.*, row_number() OVER (ORDER BY l.line_no) AS n
  FROM question_lines l JOIN documents d ON d.doc_id = l.line_no WHERE l.line LIKE '{"id":"q-%') WHERE n > 25""",
    "question_lines"))

_VALID = """SELECT dataset, count(*) AS n, min(bad_at) AS bad_at FROM (
  SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY line_no) AS at,
    CASE WHEN line LIKE '{"id": "broken-%' THEN row_number() OVER (PARTITION BY dataset ORDER BY line_no) END AS bad_at
  FROM question_lines WHERE trim(line) <> '') GROUP BY dataset"""

add("s5_dataset_validation",
    lambda s, d: questions.validate_datasets(fx.question_lines(s, d)),
    q.query("SELECT dataset, CASE WHEN bad_at IS NULL THEN n END AS question_count, bad_at AS bad_line FROM v",
            "question_lines", extra={"v": _VALID}))

add("s6_dataset_catalogue",
    lambda s, d: questions.dataset_catalogue(fx.question_lines(s, d)),
    q.query("""SELECT l.dataset AS name, sum(strlen(line) + 1)::BIGINT AS size,
  coalesce(any_value(CASE WHEN bad_at IS NULL THEN v.n END), 0) AS question_count
FROM question_lines l JOIN v ON v.dataset = l.dataset GROUP BY l.dataset""",
            "question_lines", extra={"v": _VALID}))


def artifact_paths(spark, sf):
    docs = fx.documents(spark, sf)
    folder = F.when(F.col("lang") == "es", F.lit("logs")).otherwise(F.lit("output"))
    ext = F.when(F.col("doc_id") % 5 == 0, ".txt").otherwise(".md")
    return docs.select(
        F.concat_ws("/", F.concat(F.lit("kind-"), F.col("lang")), "source", folder,
                    F.concat(F.col("doc_id").cast("string"), ext)).alias("path")
    )


add("s7_artifact_catalogue",
    lambda s, d: corpus.artifact_catalogue(artifact_paths(s, d)),
    q.query("""SELECT 'kind-'||lang AS type, source AS tag,
  CASE WHEN lang <> 'es' THEN count(*) FILTER (doc_id % 5 <> 0) END AS file_count FROM docs GROUP BY lang, source""", "docs"))

# --- cleaning ------------------------------------------------------------------

_INCLUDING = """SELECT 'docs/doc-'||doc_id||'.md' AS path, text || CASE doc_id % 7
    WHEN 0 THEN ' {{% include "docs/doc-0.md" %}} '
    WHEN 2 THEN ' {{% include "docs/doc-'||(doc_id-1)||'.md" %}} '
    WHEN 3 THEN ' {{% include "docs/doc-'||(doc_id+1)||'.md" %}} '
    WHEN 4 THEN ' {{% include "docs/doc-'||(doc_id-1)||'.md" %}} '
    WHEN 5 THEN ' {{% include "docs/doc-'||(doc_id-3)||'.md" %}} '
    WHEN 6 THEN ' {{% include "docs/none.md" %}}  {{% include "notes.txt" %}} '
    ELSE '' END || 'end' AS content FROM documents"""
_SEGMENTS = """SELECT path, i AS ix, t AS txt, CASE WHEN i <= len(tags) THEN tags[i] END AS tag, CASE WHEN i <= len(tags) THEN targets[i] END AS target FROM (
  SELECT path, tags, targets, unnest(texts) AS t, generate_subscripts(texts, 1) AS i FROM (
    SELECT path, string_split_regex(content, '\\{\\{%\\s*include\\s+"[^"]+"\\s*%\\}\\}') AS texts,
      regexp_extract_all(content, '\\{\\{%\\s*include\\s+"([^"]+)"\\s*%\\}\\}') AS tags,
      regexp_extract_all(content, '\\{\\{%\\s*include\\s+"([^"]+)"\\s*%\\}\\}', 1) AS targets FROM inc))"""
_PIECES = """SELECT path, ix * 2 AS ix, txt, NULL::VARCHAR AS target FROM seg
  UNION ALL SELECT path, ix * 2 + 1, tag, target FROM seg WHERE tag IS NOT NULL"""
_GROWN = """SELECT path, [ix] AS k, txt, target, []::VARCHAR[] AS visited FROM pieces
  UNION ALL
  SELECT g.path, list_append(g.k, p.ix), p.txt, p.target, list_append(g.visited, g.target)
  FROM grown g JOIN pieces p ON p.path = g.target WHERE g.target IS NOT NULL AND NOT list_contains(g.visited, g.target)"""

add("c1_include_expansion",
    lambda s, d: clean.expand_includes(fx.including(s, d)),
    q.query("""SELECT path, string_agg(CASE WHEN target IS NULL THEN txt WHEN list_contains(visited, target) THEN '' ELSE txt END, '' ORDER BY k) AS content
FROM grown WHERE target IS NULL OR list_contains(visited, target) OR target NOT IN (SELECT path FROM inc) GROUP BY path""",
            extra={"inc": _INCLUDING, "seg": _SEGMENTS, "pieces": _PIECES, "grown": _GROWN}, recursive=True))

add("c2_tag_stripping",
    lambda s, d: clean.strip_shortcodes(fx.tagged(s, d).select("path", "content")),
    q.query("SELECT path, " + q.strip_tags("content") + " AS content FROM tagged", "tagged"))

add("c3_html_to_text",
    lambda s, d: clean.html_to_text(fx.pages(s, d)),
    q.query("SELECT page_id, path, " + q.html_text("content") + " AS content FROM html_pages", "html_pages"))

_REF = r"""regexp_replace(content, '\{\{<\s*(?:ref|relref)\s+"([^"#]*)(#[^"]*)?"\s*>\}\}', '[\1\2](\1.md\2)', 'g')"""
add("c4_cross_references",
    lambda s, d: clean.resolve_refs(fx.tagged(s, d).select("path", "content")),
    q.query(f"SELECT path, {_REF} AS content FROM tagged", "tagged"))

add("c5_dangling_references",
    lambda s, d: clean.dangling_refs(fx.tagged(s, d)),
    q.query("""SELECT * FROM (SELECT path, CASE doc_id % 7 WHEN 3 THEN 'ref' ELSE 'relref' END AS ref_kind,
  CASE doc_id % 7 WHEN 3 THEN source||'/doc-'||(doc_id+1)||'#part' ELSE 'doc-'||(doc_id+20) END AS ref,
  source||'/doc-'||(doc_id + CASE doc_id % 7 WHEN 3 THEN 1 ELSE 20 END)||'.md' AS target
FROM tagged WHERE doc_id % 7 IN (3, 4)) t WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.path = t.target)""", "docs", "tagged"))


def strict_references(spark, sf):
    """All references resolved against a catalogue that has the pages that are not written yet as well."""
    docs = fx.tagged(spark, sf)
    known = docs.select("path").union(clean.dangling_refs(docs).select("target")).distinct()
    return clean.resolve_refs(docs.select("path", "content"), strict=True, paths=known)


add("c5_strict_references", strict_references, q.query(f"SELECT path, {_REF} AS content FROM tagged", "tagged"))


def source_urls(spark, sf):
    page = F.when(F.col("doc_id") % 5 == 0, F.concat("source", F.lit("/_index.md"))).when(
        F.col("doc_id") % 5 == 1, F.concat("source", F.lit("/index.md"))
    ).otherwise(F.col("path"))
    docs = fx.documents(spark, sf).withColumn("path", page)
    return clean.add_source_url(docs, fx.BASE_URL + "/").select("doc_id", "path", "source_url")


add("c6_source_url", source_urls, q.query(
    f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source||'/_index.md' WHEN 1 THEN source||'/index.md' ELSE path END AS path,
  '{fx.BASE_URL}/'||CASE WHEN doc_id % 5 < 2 THEN source ELSE replace(path, '.md', '') END||'/' AS source_url FROM docs""", "docs"))

add("c7_front_matter",
    lambda s, d: clean.split_front_matter(fx.fronted(s, d)).select("path", "has_front_matter", "front_matter", "body"),
    q.query("""SELECT path, doc_id % 3 < 2 AS has_front_matter,
  CASE doc_id % 3 WHEN 0 THEN 'title: '||source||chr(10)||'lang: "'||lang||'"' WHEN 1 THEN 'source_url: old'||chr(10)||'doc: '||doc_id END AS front_matter,
  CASE WHEN doc_id % 3 < 2 THEN regexp_replace(content, '^\\n?---\\n[\\s\\S]*?\\n(---|\\.\\.\\.)\\n+', '') ELSE content END AS body FROM fronted""", "fronted"))


def front_matter_keys(spark, sf, nested=False):
    parsed = clean.front_matter_metadata(fx.fronted(spark, sf), nested=nested)
    return parsed.select("path", F.explode("metadata").alias("key", "value"))


_FM_KEYS = q.query("""SELECT path, unnest(CASE doc_id % 3 WHEN 0 THEN ['title', 'lang'] ELSE ['source_url', 'doc'] END) AS key,
  unnest(CASE doc_id % 3 WHEN 0 THEN [source, lang] ELSE ['old', doc_id::VARCHAR] END) AS value FROM fronted WHERE doc_id % 3 < 2""", "fronted")
add("c8_front_matter_map", front_matter_keys, _FM_KEYS)
add("c8_front_matter_yaml", lambda s, d: front_matter_keys(s, d, nested=True), _FM_KEYS)


def nested_front_matter(spark, sf):
    """Parsed markdown whose front matter holds a list, a map, values in brackets and an empty one."""
    n = F.col("doc_id").cast("string")
    head = F.concat(
        F.lit("---\ntags:\n  - "), F.col("lang"), F.lit("\n  - "), n, F.lit("\nowner:\n  team: "), F.col("source"),
        F.lit("\n  active: True\nids: ["), n, F.lit(', "x y"]\nlimits: {b: 2, a: '), n, F.lit("}\nempty:\n---\n"),
    )
    docs = fx.documents(spark, sf).select("path", F.concat(head, "content").alias("content"))
    return structure.parse_markdown(docs).select("path", F.explode("metadata").alias("key", "value"))


add("c8_nested_front_matter", nested_front_matter, q.query(
    """SELECT path, unnest(['tags', 'owner', 'ids', 'limits', 'empty']) AS key,
  unnest(['['||lang||' '||doc_id||']', 'map[active:true team:'||source||']', '['||doc_id||' x y]', 'map[a:'||doc_id||' b:2]', '<nil>']) AS value FROM docs""",
    "docs"))

add("c9_inject_source_url",
    lambda s, d: clean.inject_source_url(fx.fronted(s, d)).select("path", "content"),
    q.query("""SELECT path, CASE doc_id % 3
  WHEN 0 THEN '---'||chr(10)||'lang: "'||lang||'"'||chr(10)||'source_url: '||source_url||chr(10)||'title: '||source||chr(10)||'---'||chr(10)||body||chr(10)
  WHEN 1 THEN '---'||chr(10)||'doc: '||doc_id||chr(10)||'source_url: '||source_url||chr(10)||'---'||chr(10)||body||chr(10)
  ELSE '---'||chr(10)||'source_url: '||source_url||chr(10)||'---'||chr(10)||content||chr(10) END AS content FROM fronted""", "fronted"))

_CLEANED = "SELECT path, replace(path, '.md', '') AS page, " + q.html_text(q.strip_tags("content")) + " AS body FROM tagged"
_WITH_URL = f"'---'||chr(10)||'source_url: {fx.BASE_URL}/'||page||'/'||chr(10)||'---'||chr(10)||body||chr(10)"
add("c10_clean_job",
    lambda s, d: clean_corpus(fx.tagged(s, d), base_url=fx.BASE_URL),
    q.query(f"""SELECT path, {_WITH_URL} AS content, strlen({_WITH_URL})::BIGINT AS size, '{fx.BASE_URL}/'||page||'/' AS source_url FROM cleaned""",
            "tagged", extra={"cleaned": _CLEANED}))

_EXPANDED = """SELECT path, string_agg(CASE WHEN target IS NULL THEN txt WHEN list_contains(visited, target) THEN '' ELSE txt END, '' ORDER BY k) AS content
FROM grown WHERE target IS NULL OR list_contains(visited, target) OR target NOT IN (SELECT path FROM inc) GROUP BY path"""
_CLEANED_INCLUDES = "SELECT path, replace(path, '.md', '') AS page, " + q.html_text(q.strip_tags("content")) + " AS body FROM expanded"
add("c10_clean_job_includes",
    lambda s, d: clean_corpus(fx.including(s, d), base_url=fx.BASE_URL),
    q.query(f"""SELECT path, {_WITH_URL} AS content, strlen({_WITH_URL})::BIGINT AS size, '{fx.BASE_URL}/'||page||'/' AS source_url FROM cleaned""",
            extra={"inc": _INCLUDING, "seg": _SEGMENTS, "pieces": _PIECES, "grown": _GROWN, "expanded": _EXPANDED, "cleaned": _CLEANED_INCLUDES},
            recursive=True))

add("c11_document_size",
    lambda s, d: clean.add_size(fx.corpus(s, d)).select("path", "size"),
    q.query("SELECT path, strlen(content)::BIGINT AS size FROM docs", "docs"))

# --- verification ----------------------------------------------------------------


def verified(spark, sf):
    source = fx.tagged(spark, sf)
    moved = F.when(F.col("doc_id") % 50 == 7, F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path"))
    # pages with an id ending in 9 stay raw, so the checks have something to find
    cleaned = F.when(
        F.col("doc_id") % 10 == 9, F.col("content")
    ).otherwise(mk.html_to_text(mk.strip_tags(F.col("content"))))
    return source, source.select(moved.alias("path"), cleaned.alias("content"))


_OUT = ("SELECT CASE WHEN doc_id % 50 = 7 THEN 'moved/'||path ELSE path END AS path, CASE WHEN doc_id % 10 = 9 THEN content ELSE "
        + q.html_text(q.strip_tags("content")) + " END AS content FROM tagged")

add("v2_path_differences",
    lambda s, d: verify.path_differences(*verified(s, d)),
    q.query("""SELECT coalesce(t.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'missing' ELSE 'extra' END AS problem
FROM tagged t FULL OUTER JOIN out o ON o.path = t.path WHERE t.path IS NULL OR o.path IS NULL""", "tagged", extra={"out": _OUT}))

add("v3_v5_violations",
    lambda s, d: verify.violations(verified(s, d)[1]),
    q.query("""SELECT 'no_shortcodes' AS check_name, path FROM out WHERE regexp_matches(content, '\\{\\{(?:%|<)')
UNION ALL SELECT 'no_raw_html', path FROM out WHERE regexp_matches(content, '<[a-z]+[^>]*>')
UNION ALL SELECT 'minimum_content', path FROM out WHERE strlen(content) < 50""", "tagged", extra={"out": _OUT}))

add("v1_v7_report",
    lambda s, d: verify.report(*verified(s, d)),
    q.query("""SELECT check_name, passed, detail, bool_and(passed) OVER () AS all_passed FROM (
SELECT unnest(['file_count_match','directory_structure','no_shortcodes','no_raw_html','minimum_content','total_size']) AS check_name,
 unnest([sn = dn, nd = 0, tags = 0, html = 0, small = 0, CASE WHEN sb > 0 THEN db / sb BETWEEN 0.5 AND 2.0 ELSE db > 0 END]) AS passed,
 unnest([sn||' source pages, '||dn||' output pages',
   CASE WHEN nd = 0 THEN 'same paths on both sides' ELSE nd||' paths on one side only' END,
   tags||' pages with template tags', html||' pages with HTML', small||' pages under 50 bytes',
   sb||' bytes before, '||db||' after']) AS detail
FROM (SELECT count(*) AS sn, sum(strlen(content))::BIGINT AS sb FROM tagged),
 (SELECT count(*) AS dn, sum(strlen(content))::BIGINT AS db, count(*) FILTER (regexp_matches(content, '\\{\\{(?:%|<)')) AS tags,
   count(*) FILTER (regexp_matches(content, '<[a-z]+[^>]*>')) AS html, count(*) FILTER (strlen(content) < 50) AS small FROM out),
 (SELECT count(*) AS nd FROM tagged t FULL OUTER JOIN out o ON o.path = t.path WHERE t.path IS NULL OR o.path IS NULL))""",
            "tagged", extra={"out": _OUT}))

# --- structure -------------------------------------------------------------------


def elements(spark, sf, *kinds):
    rows = structure.explode_elements(structure.parse_markdown(fx.markdown(spark, sf)))
    if kinds:
        rows = rows.filter(F.col("kind").isin(*kinds))
    return rows.select("path", "pos", "kind", "text", "level", F.element_at("meta", "language").alias("language"))


add("e1_elements", elements, q.query("SELECT path, pos, kind, text, level, language FROM elements", "elements"))
for _name, _kind in (("e2_headings", "heading"), ("e3_paragraphs", "paragraph"), ("e4_code_blocks", "code_block"),
                     ("e6_tables", "table"), ("e7_list_items", "list_item")):
    add(_name, lambda s, d, k=_kind: elements(s, d, k),
        q.query(f"SELECT path, pos, kind, text, level, language FROM elements WHERE kind = '{_kind}'", "elements"))


def indented_code(spark, sf):
    """Each line of a document becomes an indented block after a paragraph."""
    blocks = F.transform(F.split("content", "\n"), lambda s, i: F.concat(F.lit("line "), i.cast("string"), F.lit("\n\n    "), s))
    docs = fx.documents(spark, sf).select("path", F.array_join(blocks, "\n\n").alias("content"))
    rows = structure.explode_elements(structure.parse_markdown(docs)).filter("kind = 'code_block'")
    return rows.select("path", "pos", "text")


add("e5_indented_code", indented_code, q.query(
    """SELECT path, (row_number() OVER (PARTITION BY path ORDER BY i) * 2 - 1 + blanks)::INT AS pos, trim(s) AS text FROM (
  SELECT *, sum((trim(s) = '')::INT) OVER (PARTITION BY path ORDER BY i) AS blanks FROM (
    SELECT path, unnest(string_split(content, chr(10))) AS s, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM docs))
WHERE trim(s) <> ''""", "docs"))


def inline_flattening(spark, sf):
    from passagemill.functions import markdown as md

    dressed = F.concat(
        F.lit("[text]("), F.col("source"), F.lit(".html) ![pic "), F.col("lang"),
        F.lit("](p.png) ![](q.png) <https://example.com/> `code` [none]() **strong** *soft* ~~gone~~ <br> "),
        F.regexp_replace("content", "\n", " "),
    )
    return fx.documents(spark, sf).select("path", md.flatten_inline(dressed).alias("text"))


add("e8_inline_flattening", inline_flattening, q.query(
    "SELECT path, " + q.flat_inline(
        "'[text]('||source||'.html) ![pic '||lang||'](p.png) ![](q.png) <https://example.com/> `code` [none]() "
        "**strong** *soft* ~~gone~~ <br> '||replace(content, chr(10), ' ')") + " AS text FROM docs", "docs"))


def element_metadata(spark, sf):
    rows = structure.explode_elements(structure.parse_markdown(fx.markdown(spark, sf)))
    return rows.groupBy("path", F.element_at("metadata", "title").alias("title"), F.element_at("metadata", "lang").alias("lang")).agg(
        F.count("*").alias("n_elements")
    )


add("e9_metadata_carried", element_metadata, q.query(
    "SELECT e.path, d.source AS title, d.lang, count(*) AS n_elements FROM elements e JOIN docs d USING (path) GROUP BY ALL", "elements"))

# --- chunks ------------------------------------------------------------------------

_CHUNK_COLUMNS = ("chunk_id", "document_path", "content", "token_count", "chunk_index")
add("k1_fixed_chunks",
    lambda s, d: fx.chunks(s, d).select(*_CHUNK_COLUMNS),
    q.query("SELECT chunk_id, document_path, content, token_count, chunk_index FROM chunks", "chunks"))


def windows_sql(size, step, drop_tail=0):
    tail = f"(full_n*{step} < len(w) AND (full_n = 0 OR len(w) - full_n*{step} > {drop_tail}))" if drop_tail else f"(full_n*{step} < len(w))"
    return f"""SELECT path||'-chunk-'||lpad(i::VARCHAR, 4, '0') AS chunk_id, i::INT AS chunk_index,
  array_to_string(w[i*{step}+1 : CASE WHEN i < full_n THEN i*{step}+{size} ELSE len(w) END], ' ') AS content FROM (
 SELECT path, w, full_n, unnest(range(full_n + {tail}::INT)) AS i FROM (
  SELECT path, w, CASE WHEN len(w) < {size} THEN 0 ELSE (len(w)-{size}) // {step} + 1 END AS full_n FROM (
   SELECT path, {q.words('content')} AS w FROM docs)))"""


add("k1_fixed_without_overlap_tail",
    lambda s, d: chunk.fixed_chunks(structure.parse_plain(fx.corpus(s, d)), 50, 10, drop_overlap_tail=True).select("chunk_id", "chunk_index", "content"),
    q.query(windows_sql(50, 40, 10), "docs"))
add("k2_overlap_clamp",
    lambda s, d: chunk.fixed_chunks(structure.parse_plain(fx.corpus(s, d)), 12, 50)
    .groupBy("document_path").agg(F.count("*").alias("n_chunks"), F.max("token_count").alias("max_tokens")),
    q.query("SELECT regexp_replace(chunk_id, '-chunk-.*$', '') AS document_path, count(*) AS n_chunks, max(strlen(content) // 4) AS max_tokens FROM w GROUP BY 1",
            "docs", extra={"w": windows_sql(12, 1)}))

MAX_WORDS, OVERLAP = 40, 8
_STEP = MAX_WORDS - OVERLAP
_WS = q.strip_ws
_SECTION = """SELECT *, sum((kind = 'heading')::INT) OVER (PARTITION BY path ORDER BY pos) AS section,
  max(CASE WHEN level = 1 THEN pos END) OVER w AS p1, max(CASE WHEN level = 2 THEN pos END) OVER w AS p2, max(CASE WHEN level = 3 THEN pos END) OVER w AS p3
FROM elements WINDOW w AS (PARTITION BY path ORDER BY pos)"""
_HEADS = """SELECT s.path, s.section, array_to_string(list_filter([
   (SELECT text FROM elements e WHERE e.path = s.path AND e.pos = s.p1),
   (SELECT text FROM elements e WHERE e.path = s.path AND e.pos = s.p2 AND s.p2 > coalesce(s.p1, -1)),
   (SELECT text FROM elements e WHERE e.path = s.path AND e.pos = s.p3 AND s.p3 > greatest(coalesce(s.p1, -1), coalesce(s.p2, -1)))], lambda t: t IS NOT NULL), ' > ') AS hpath
FROM (SELECT path, section, min(p1) AS p1, min(p2) AS p2, min(p3) AS p3 FROM sec GROUP BY ALL) s"""
_SIZES = f"""SELECT path, section, sum(CASE WHEN kind <> 'heading' THEN len({q.words('text')}) ELSE 0 END) AS n_words,
  count(*) FILTER (kind <> 'heading') AS n_content, max(CASE WHEN kind = 'heading' THEN text END) AS head,
  string_agg(trim(text), chr(10)||chr(10) ORDER BY pos) FILTER (trim(text) <> '') AS joined FROM sec GROUP BY ALL"""
_BLOCKS = f"""SELECT s.path, s.section, s.pos, s.kind, {_WS('s.text')} AS text, len({q.words('s.text')}) AS n, z.n_content, z.head FROM sec s
  JOIN sizes z USING (path, section) WHERE s.kind <> 'heading' AND z.n_words > {MAX_WORDS} AND {_WS('s.text')} <> ''"""
_SENTS = f"""SELECT path, section, pos, i, {_WS('x')} AS x, len({q.words('x')}) AS n FROM (
  SELECT path, section, pos, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM (
    SELECT *, regexp_extract_all(text, '[^.!?\\n]+[.!?]+[\\s\\n]*|[^\\n]+') AS xs FROM blk WHERE kind NOT IN ('code_block','table') AND n > {MAX_WORDS}))
  WHERE {_WS('x')} <> ''"""
_RAW = f"""SELECT path, section, 0 AS pos, 0 AS i, 0 AS j, chr(10)||chr(10) AS gap, joined AS body FROM sizes WHERE n_words BETWEEN 1 AND {MAX_WORDS}
UNION ALL SELECT path, section, pos, 0, 0, chr(10)||chr(10), CASE WHEN kind IN ('code_block','table') AND n_content = 1 AND head IS NOT NULL THEN head||chr(10)||chr(10)||text ELSE text END
  FROM blk WHERE kind IN ('code_block','table') OR n <= {MAX_WORDS}
UNION ALL SELECT path, section, pos, i, 0, chr(10)||chr(10), x FROM sents WHERE n <= {MAX_WORDS}
UNION ALL SELECT path, section, pos, i, j, chr(10), array_to_string(w[j*{_STEP}+1:j*{_STEP}+{MAX_WORDS}], ' ') FROM (
  SELECT path, section, pos, i, w, unnest(range(1 + ceil((len(w)-{MAX_WORDS}) / {_STEP})::INT)) AS j FROM (SELECT *, {q.words('x')} AS w FROM sents WHERE n > {MAX_WORDS}))"""
_RECURSIVE = {"sec": _SECTION, "heads": _HEADS, "sizes": _SIZES, "blk": _BLOCKS, "sents": _SENTS, "raw": _RAW,
              "rec": """SELECT r.path, r.section, CASE WHEN hpath = '' THEN body ELSE hpath||gap||body END AS content,
  row_number() OVER (PARTITION BY r.path ORDER BY r.section, pos, i, j) - 1 AS idx FROM raw r JOIN heads h USING (path, section)"""}

add("k3_recursive_chunks",
    lambda s, d: chunk.recursive_chunks(structure.parse_markdown(fx.markdown(s, d)), MAX_WORDS, OVERLAP).select(*_CHUNK_COLUMNS),
    q.query("""SELECT path||'-chunk-'||lpad(idx::VARCHAR, 4, '0') AS chunk_id, path AS document_path, content,
  strlen(content) // 4 AS token_count, idx::INT AS chunk_index FROM rec""", "elements", extra=_RECURSIVE))


def section_paths(spark, sf):
    parsed = structure.parse_markdown(fx.markdown(spark, sf))
    cut = parsed.select("path", F.posexplode(chunk.sections(F.col("elements"))).alias("section", "s"))
    words = F.aggregate(
        F.transform(F.filter(F.col("s")["items"], lambda e: e["kind"] != "heading"), lambda e: F.size(tx.words(e["text"]))),
        F.lit(0), lambda a, n: a + n,
    )
    return cut.select("path", "section", F.col("s")["path"].alias("heading_path"), words.alias("n_words"))


add("k4_k5_sections_and_paths", section_paths, q.query(
    """SELECT path, (section - min(section) OVER (PARTITION BY path))::INT AS section, hpath AS heading_path, n_words::INT AS n_words
FROM heads JOIN sizes USING (path, section)""", "elements", extra=_RECURSIVE))


def sentence_split(spark, sf):
    found = F.regexp_extract_all("content", F.lit(chunk.SENTENCE_PATTERN), F.lit(0))
    kept = F.filter(F.transform(found, tx.trim_ws), lambda s: s != "")
    return fx.corpus(spark, sf).select("path", F.posexplode(kept).alias("pos", "sentence"))


add("k8_sentence_split", sentence_split, q.query(
    f"""SELECT path, (generate_subscripts(xs, 1) - 1)::INT AS pos, unnest(xs) AS sentence FROM (
  SELECT path, list_filter(list_transform(regexp_extract_all(content, '[^.!?\\n]+[.!?]+[\\s\\n]*|[^\\n]+'), lambda x: {_WS('x')}), lambda x: x <> '') AS xs FROM docs)""", "docs"))


def atomic_blocks(spark, sf):
    """Oversized code stays whole: every document as one code block."""
    docs = fx.corpus(spark, sf).withColumn("content", F.concat(F.lit("# Head\n\n```\n"), F.col("content"), F.lit("\n```\n")))
    made = chunk.recursive_chunks(structure.parse_markdown(docs), 30)
    return made.select("chunk_id", "content", "token_count")


add("k10_atomic_blocks", atomic_blocks, q.query(
    f"""SELECT path||'-chunk-0000' AS chunk_id, 'Head'||chr(10)||chr(10)||'Head'||chr(10)||chr(10)||{_WS('content')} AS content,
  strlen('Head'||chr(10)||chr(10)||'Head'||chr(10)||chr(10)||{_WS('content')}) // 4 AS token_count FROM docs WHERE {_WS('content')} <> ''""", "docs"))

add("k11_token_estimate",
    lambda s, d: fx.corpus(s, d).select("path", tx.token_estimate(F.col("content")).alias("tokens")),
    q.query("SELECT path, strlen(content) // 4 AS tokens FROM docs", "docs"))


def dispatched(spark, sf):
    parsed = structure.parse_plain(fx.corpus(spark, sf))
    parts = [
        CHUNKERS.run(name, parsed, config={}).groupBy("document_path").agg(F.count("*").alias("n")).withColumn("strategy", F.lit(name))
        for name in ("fixed", "recursive")
    ]
    return parts[0].unionByName(parts[1])


_DEFAULTS = f"""SELECT document_path, count(*) AS n, 'fixed' AS strategy FROM (SELECT regexp_replace(chunk_id, '-chunk-.*$', '') AS document_path FROM fixed_default) GROUP BY 1
UNION ALL SELECT path, CASE WHEN len({q.words('content')}) <= 512 THEN 1 ELSE
  list_sum(list_transform(xs, lambda x: CASE WHEN len({q.words('x')}) <= 512 THEN 1 ELSE 1 + ceil((len({q.words('x')}) - 512) / 410)::BIGINT END))::BIGINT END, 'recursive' FROM (
  SELECT path, content, list_filter(list_transform(regexp_extract_all(content, '[^.!?\\n]+[.!?]+[\\s\\n]*|[^\\n]+'), lambda x: {_WS('x')}), lambda x: x <> '') AS xs FROM docs) WHERE len({q.words('content')}) > 0"""
add("k13_strategy_dispatch", dispatched, q.query(_DEFAULTS, "docs", extra={"fixed_default": windows_sql(512, 448)}))

# --- written tables -----------------------------------------------------------------


def scratch(spark, name):
    """A new folder below the shared checkpoint folder."""
    import uuid

    return f"{checkpoint_folder(spark).rstrip('/')}/passagemill-{name}-{uuid.uuid4().hex}"


def written_corpus(spark, sf):
    """The cleaned corpus written under two tags, one deleted again, the other read back."""
    path = scratch(spark, "corpus")
    cleaned = clean_corpus(fx.tagged(spark, sf))
    tables.write_clean_corpus(cleaned, path, "kept")
    tables.write_clean_corpus(cleaned.select("path", F.lit("old").alias("content"), "size", "source_url"), path, "gone")
    tables.delete_artifact(spark, path, "gone")
    kept = tables.read_clean_corpus(spark, path, "kept")
    left_over = tables.read_clean_corpus(spark, path, "gone")
    return kept.unionByName(left_over).select("path", "content")


add("w1_w10_written_corpus", written_corpus, q.query("SELECT path, body AS content FROM cleaned", "tagged", extra={"cleaned": _CLEANED}))
