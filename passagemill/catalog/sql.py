"""SQL twins of the fixtures and shared steps, assembled into one WITH clause per query."""

from __future__ import annotations

from passagemill.catalog.fixtures import CHUNK_OVERLAP, CHUNK_SIZE, DIMS, TOP_K

_NL = "chr(10)"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def flat_inline(x: str) -> str:
    """Inline markdown flattened, as nested replacements."""
    steps = [
        (r"!\[\]\(\s*<?([^\s()>]+)>?[^()\n]*\)", r"\1"),
        (r"!\[([^\]\n]*)\]\(\s*<?([^\s()>]+)>?[^()\n]*\)", r"\1 (\2)"),
        (r"\[([^\[\]\n]*)\]\(\s*\)", r"\1"),
        (r'\[([^\[\]\n]*)\]\(\s*<?([^\s()>]+)>?(?:\s+"[^"\n]*")?\s*\)', r"\1 (\2)"),
        (r"<((?:https?|mailto):[^\s<>]*)>", r"\1"),
        (r"</?[a-zA-Z][^<>]*>", ""),
        (r"\*\*([^*\s](?:[^*\n]*[^*\s])?)\*\*", r"\1"),
        (r"\*([^*\s](?:[^*\n]*[^*\s])?)\*", r"\1"),
        (r"~~([^~\n]+)~~", r"\1"),
        (r"`+([^`\n]+)`+", r"\1"),
    ]
    for pattern, put in steps:
        x = f"regexp_replace({x}, '{pattern}', '{put}', 'g')"
    return strip_ws(x)


def strip_tags(x: str) -> str:
    for name in ("handbook-data-toc", "youtube", "member-by-name", "member-by-gitlab"):
        for mark, end in (("<", ">"), ("%", "%")):
            x = (
                f"regexp_replace({x}, '\\{{\\{{{mark}\\s*{name}(?:[^\\w-][\\s\\S]*?)?{end}\\}}\\}}"
                f"(?:[\\s\\S]*?\\{{\\{{(?:{mark} ?)?/{name}(?:[^\\w-][\\s\\S]*?)?[>%]\\}}\\}})?', '', 'g')"
            )
    return (
        f"regexp_replace({x}, '\\{{\\{{(?:<\\s*/?[\\w-]+[\\s\\S]*?>|%\\s*/?[\\w-]+[\\s\\S]*?%|/[\\w-]+[\\s\\S]*?[>%])\\}}\\}}', '', 'g')"
    )


def html_text(x: str) -> str:
    def gone(x, pattern, put=""):
        return f"regexp_replace({x}, '{pattern}', '{put}', 'gi')"

    x = gone(x, r"<!--[\s\S]*?-->")
    x = gone(x, r"<!doctype[^>]*>")
    for tag in ("script", "style", "iframe"):
        x = gone(x, rf"<{tag}(?:\s[^>]*)?>[\s\S]*?</{tag}\s*>")
    x = gone(x, r'<img\s(?:[^>]*?\s)?alt="([^"]*)"[^>]*>', r"\1")
    x = gone(x, r"<img(?:\s[^>]*)?>")
    x = gone(x, r'<a\s(?:[^>]*?\s)?href="([^"]*)"[^>]*>\s*</a\s*>', r"\1")
    x = gone(x, r'<a\s(?:[^>]*?\s)?href="([^"]*)"[^>]*>\s*([\s\S]*?)\s*</a\s*>', r"\2 [\1]")
    x = gone(x, r"</table\s*>", "</table>\x01")
    x = gone(x, r"<table([\s>])", "\x01<table\\1")
    cell = gone("p", r"</?[a-zA-Z][^>]*>", " ")
    cell = strip_ws(f"regexp_replace({cell}, '\\s+', ' ', 'g')")
    x = (
        f"array_to_string(list_transform(string_split({x}, chr(1)), lambda p: "
        f"CASE WHEN starts_with(lower(p), '<table') THEN {cell} ELSE p END), '')"
    )
    x = gone(x, r"</?[a-zA-Z][^>]*>")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("middot", "·"), ("copy", "©"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


WORDS = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')"


def words(x: str) -> str:
    return WORDS.format(x)


def uuid5(x: str) -> str:
    """Version-5 UUID over the DNS namespace, from the SHA-1 hex digest."""
    h = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({x}))"
    return (
        f"(substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||"
        f"translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab')||substr({h},18,3)||'-'||substr({h},21,12))"
    )


CTES = {
    "docs": (
        (),
        "SELECT source||'/doc-'||doc_id||'.md' AS path, text AS content, doc_id, source, lang FROM documents",
    ),
    "md_pieces": (
        ("docs",),
        """SELECT path, source, lang, list_transform(string_split(content, chr(10)), lambda s, i:
  CASE WHEN i=1 THEN '# '||s
       WHEN (i-1)%8=4 THEN '## '||s
       WHEN (i-1)%8=6 THEN '### '||s
       WHEN (i-1)%9=3 THEN '```text'||chr(10)||s||chr(10)||'```'
       WHEN (i-1)%9=5 THEN '- '||s
       WHEN (i-1)%9=7 THEN '| item | text |'||chr(10)||'| --- | --- |'||chr(10)||'| '||(i-1)||' | '||replace(s,'|','/')||' |'
       WHEN (i-1)%9=2 THEN 'See [guide '||(i-1)||'](https://example.com/g) and `code` '||s
       WHEN (i-1)%9=1 THEN s||chr(10)||'tail of line'
       ELSE s END) AS pieces FROM docs""",
    ),
    "md": (
        ("md_pieces",),
        """SELECT path, '---'||chr(10)||'title: '||source||chr(10)||'lang: '||lang||chr(10)||'---'||chr(10)
  ||array_to_string(pieces, chr(10)||chr(10)) AS content FROM md_pieces""",
    ),
    # markdown parsed line by line with window functions
    "md_lines": (
        ("md",),
        """SELECT path, pos, s, regexp_matches(s, '^ {0,3}```') AS fence FROM (
  SELECT path, unnest(ls) AS s, generate_subscripts(ls, 1) AS pos FROM (
    SELECT path, string_split(regexp_replace(content, '^---\\n[\\s\\S]*?\\n---\\n+', ''), chr(10)) AS ls FROM md))""",
    ),
    "md_class": (
        ("md_lines",),
        """SELECT path, pos, s, CASE
    WHEN fence OR n_fence % 2 = 1 THEN 'code'
    WHEN regexp_matches(s, '^\\s*$') THEN 'blank'
    WHEN regexp_matches(s, '^ {0,3}#{1,6}(\\s|$)') THEN 'heading'
    WHEN regexp_matches(s, '^\\|') THEN 'table'
    WHEN regexp_matches(s, '^ {0,3}[-*+]( |$)') THEN 'list_item'
    ELSE 'paragraph' END AS class, fence AND n_fence % 2 = 1 AS opens
  FROM (SELECT *, sum(fence::INT) OVER (PARTITION BY path ORDER BY pos) AS n_fence FROM md_lines)""",
    ),
    "md_blocks": (
        ("md_class",),
        """SELECT path, block, any_value(class) AS class, string_agg(s, chr(10) ORDER BY pos) AS txt,
    list(s ORDER BY pos) AS ls FROM (
  SELECT *, sum(starts::INT) OVER (PARTITION BY path ORDER BY pos) AS block FROM (
    SELECT *, class <> 'blank' AND (opens OR class IN ('heading','list_item') OR class <> coalesce(prev, 'blank')) AS starts FROM (
      SELECT *, lag(class) OVER (PARTITION BY path ORDER BY pos) AS prev FROM md_class)))
  WHERE class <> 'blank' GROUP BY path, block""",
    ),
    "elements": (
        ("md_blocks",),
        "SELECT path, (row_number() OVER (PARTITION BY path ORDER BY block) - 1)::INT AS pos, kind, txt AS text, level, language FROM ("
        "SELECT path, block, CASE WHEN class = 'code' THEN 'code_block' ELSE class END AS kind,"
        " CASE class WHEN 'heading' THEN " + flat_inline("regexp_replace(regexp_replace(txt, '^ {0,3}#{1,6}\\s*', ''), '(^|\\s)#+\\s*$', '')")
        + " WHEN 'code' THEN " + strip_ws("array_to_string(ls[2:len(ls)-1], chr(10))")
        + " WHEN 'list_item' THEN " + flat_inline("regexp_replace(txt, '^\\s*[-*+]\\s+', '')")
        + " WHEN 'table' THEN array_to_string(list_transform(list_filter(ls, lambda r, i: i <> 2), lambda r: "
        "array_to_string(list_transform(string_split(regexp_replace(trim(r), '^\\||\\|$', '', 'g'), '|'), lambda c: "
        + flat_inline("c") + "), ' ')), chr(10))"
        + " ELSE " + flat_inline("regexp_replace(" + strip_ws("txt") + ", '\\s*\\n\\s*', ' ', 'g')") + " END AS txt,"
        " CASE WHEN class = 'heading' THEN len(regexp_extract(txt, '^ {0,3}(#{1,6})', 1))::INT ELSE 0 END AS level,"
        " CASE WHEN class = 'code' THEN nullif(regexp_extract(ls[1], '^ {0,3}```\\s*(\\S+)', 1), '') END AS language"
        " FROM md_blocks) WHERE txt <> '' OR kind = 'code_block'",
    ),
    "chunks": (
        ("docs",),
        f"""SELECT path||'-chunk-'||lpad(i::VARCHAR, 4, '0') AS chunk_id, path AS document_path, i::INT AS chunk_index, content,
    strlen(content) // 4 AS token_count FROM (
  SELECT path, i, array_to_string(w[i*{CHUNK_SIZE - CHUNK_OVERLAP}+1 : CASE WHEN i < full_n THEN i*{CHUNK_SIZE - CHUNK_OVERLAP}+{CHUNK_SIZE} ELSE len(w) END], ' ') AS content FROM (
    SELECT path, w, full_n, unnest(range(full_n + (full_n*{CHUNK_SIZE - CHUNK_OVERLAP} < len(w))::INT)) AS i FROM (
      SELECT path, w, CASE WHEN len(w) < {CHUNK_SIZE} THEN 0 ELSE (len(w)-{CHUNK_SIZE}) // {CHUNK_SIZE - CHUNK_OVERLAP} + 1 END AS full_n FROM (
        SELECT path, {words('content')} AS w FROM docs))))""",
    ),
    "questions": ((), "SELECT 'item-'||item_id AS question_id, text AS question FROM benchmark"),
    "judgments": (
        ("docs", "questions"),
        """SELECT q.question_id, d.path AS document_path, CASE WHEN l.quality = 1 THEN 3 ELSE 2 END AS grade
  FROM questions q JOIN docs d ON contains(d.content, q.question) LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    ),
    "order_lines": (
        (),
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank FROM lineitem) WHERE rank <= {TOP_K}""",
    ),
    "results": (
        ("order_lines",),
        "SELECT l_orderkey AS o_orderkey, rank, 'doc-'||(l_partkey % 9) AS path, 1.0 - l_tax AS score FROM order_lines",
    ),
    "relevance": (
        (),
        "SELECT l_orderkey AS o_orderkey, 'doc-'||(l_suppkey % 9) AS path, max(trunc(l_quantity)::INT % 4) AS grade FROM lineitem GROUP BY ALL",
    ),
    "eval_rows": (
        (),
        """SELECT o.o_orderpriority AS run_id, o.o_orderkey, 'q-'||o.o_orderkey AS question_id,
  'customer-segment-'||(o_custkey % 11) AS category, o_orderstatus AS difficulty,
  s.raw_score AS answer_score, coalesce(s.pt, 0) AS prompt_tokens, coalesce(s.ct, 0) AS completion_tokens,
  trunc(o_totalprice / 25)::BIGINT AS latency_ms, s.raw_score IS NULL AS failed, o_orderdate AS created_at
  FROM orders o LEFT JOIN (SELECT l_orderkey, round(max(l_discount) * 100, 2) AS raw_score, sum(trunc(l_quantity)::BIGINT)::BIGINT AS pt, count(*) AS ct
    FROM lineitem GROUP BY 1) s ON s.l_orderkey = o.o_orderkey""",
    ),
    # ranked rows with relevance, first occurrence and grade
    "graded": (
        ("results", "relevance"),
        """SELECT r.o_orderkey, r.rank, r.path, r.score, coalesce(v.grade, 0) AS grade, coalesce(v.grade, 0) > 0 AS rel,
  row_number() OVER (PARTITION BY r.o_orderkey, r.path ORDER BY r.rank) = 1 AS first FROM results r LEFT JOIN relevance v USING (o_orderkey, path)""",
    ),
    "ideal": (
        ("relevance",),
        "SELECT o_orderkey, grade, row_number() OVER (PARTITION BY o_orderkey ORDER BY grade DESC, path) AS n FROM relevance",
    ),
    "ks": ((), "SELECT unnest([1,3,5,10]) AS k"),
    "per_k": (
        ("graded", "ideal", "ks", "eval_rows", "relevance"),
        """SELECT e.o_orderkey, e.run_id, e.category, e.difficulty, ks.k,
  coalesce(a.hit, 0)::DOUBLE AS hit_rate, coalesce(a.found, 0) / ks.k AS precision,
  CASE WHEN coalesce(x.n_exp, 0) > 0 THEN coalesce(a.found, 0) / x.n_exp ELSE 0 END AS recall,
  CASE WHEN coalesce(b.best, 0) > 0 THEN coalesce(a.dcg, 0) / b.best ELSE 0 END AS ndcg,
  CASE WHEN coalesce(i.best, 0) > 0 THEN coalesce(a.gdcg, 0) / i.best ELSE 0 END AS ndcg_graded
FROM eval_rows e CROSS JOIN ks
LEFT JOIN (SELECT o_orderkey, count(*) FILTER (grade > 0) AS n_exp FROM relevance GROUP BY 1) x ON x.o_orderkey = e.o_orderkey
LEFT JOIN (SELECT o_orderkey, k, max((rel)::INT) AS hit, count(*) FILTER (rel AND first) AS found,
   sum(CASE WHEN rel AND first THEN 1.0/log2(rank+1) ELSE 0 END) AS dcg,
   sum(CASE WHEN first THEN (power(2, grade)-1)/log2(rank+1) ELSE 0 END) AS gdcg, count(*) AS n_ret
   FROM graded JOIN ks ON rank <= k GROUP BY ALL) a ON a.o_orderkey = e.o_orderkey AND a.k = ks.k
LEFT JOIN (SELECT o_orderkey, k, sum((power(2, grade)-1)/log2(n+1)) AS best FROM ideal JOIN ks ON n <= k GROUP BY ALL) i ON i.o_orderkey = e.o_orderkey AND i.k = ks.k
LEFT JOIN (SELECT m, sum(1.0/log2(j+1)) AS best FROM (SELECT unnest(range(1, 11)) AS m) t, (SELECT unnest(range(1, 11)) AS j) u WHERE j <= m GROUP BY m) b
  ON b.m = least(ks.k, coalesce(a.n_ret, 0), coalesce(x.n_exp, 0))""",
    ),
    "per_question": (
        ("graded", "eval_rows"),
        """SELECT e.*, coalesce(f.rank_first, 0)::INT AS rank_first FROM eval_rows e
  LEFT JOIN (SELECT o_orderkey, min(rank) AS rank_first FROM graded WHERE rel GROUP BY 1) f USING (o_orderkey)""",
    ),
    "runs": (
        (),
        """SELECT o_orderpriority AS run_id, 'nightly-evaluation-'||substr(o_orderpriority,1,1) AS tag,
  '{"chunker":"fixed","k":'||substr(o_orderpriority,1,1)||'}' AS strategy,
  min(o_orderdate) + to_seconds(substr(o_orderpriority,1,1)::INT) AS created_at FROM orders GROUP BY o_orderpriority""",
    ),
    "jobs": (
        (),
        """SELECT event_id AS id, CASE WHEN event_type IN ('click','view') THEN 'eval' WHEN event_type = 'purchase' THEN 'index' ELSE 'preprocess' END AS kind,
  ['available','running','retryable','completed','cancelled','discarded','scheduled'][k%7+1] AS state,
  '{"tag":"tag-'||k||'","batch_size":20}' AS args, k%4+1 AS attempt, 4 AS max_attempts, ts AS created_at, ts AS attempted_at,
  CASE WHEN k%7 IN (3,4,5) THEN ts + to_minutes(trunc(value)::INT) END AS finalized_at, k, trunc(value)::INT AS v
  FROM (SELECT *, (props->>'$.k')::INT AS k FROM events)""",
    ),
    "shown_jobs": (
        ("jobs",),
        "SELECT *, CASE state WHEN 'available' THEN 'available' WHEN 'running' THEN 'running' WHEN 'retryable' THEN 'retrying' WHEN 'completed' THEN 'completed' WHEN 'cancelled' THEN 'cancelled' WHEN 'discarded' THEN 'failed' ELSE 'unknown' END AS shown, 'tag-'||k AS tag FROM jobs",
    ),
    "turns": (
        (),
        """SELECT u.conv_id, u.turn, u.text AS user_text, a.text AS assistant_text FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""",
    ),
    "question_lines": (
        (),
        """SELECT 'set-'||(doc_id % 3)||'.jsonl' AS dataset, doc_id AS line_no, CASE
    WHEN doc_id % 10 = 1 THEN ''
    WHEN doc_id % 10 = 2 AND doc_id % 3 = 0 THEN '{"id": "broken-'||doc_id
    WHEN doc_id % 10 = 3 THEN '{"id":"","question":"none '||doc_id||'"}'
    WHEN doc_id % 10 = 4 THEN '{"id":"only-'||doc_id||'"}'
    ELSE to_json({'id': 'q-'||doc_id, 'category': lang, 'difficulty': source, 'question': text,
       'relevance': [{'document_path': 'doc-'||doc_id||'.md', 'grade': doc_id % 4}], 'expected_answer': 'yes'})::VARCHAR END AS line FROM documents""",
    ),
    "fronted": (
        ("docs",),
        """SELECT path, 'https://example.com/'||doc_id||'/' AS source_url, doc_id, source, lang, content AS body, CASE doc_id % 3
    WHEN 0 THEN '---'||chr(10)||'title: '||source||chr(10)||'lang: "'||lang||'"'||chr(10)||'---'||chr(10)
    WHEN 1 THEN chr(10)||'---'||chr(10)||'source_url: old'||chr(10)||'doc: '||doc_id||chr(10)||'...'||chr(10)||chr(10)
    ELSE '' END || content AS content FROM docs""",
    ),
    "tagged": (
        ("docs",),
        """SELECT path, doc_id, source, content || CASE doc_id % 7
    WHEN 0 THEN ' {{< youtube id="v'||doc_id||'" >}} tail'
    WHEN 1 THEN ' {{< details >}}inner text{{< /details >}} end'
    WHEN 2 THEN ' {{% alert color="red" %}}note{{% /alert %}} <b>bold</b> text'
    WHEN 3 THEN ' {{< ref "'||source||'/doc-'||(doc_id+1)||'#part" >}}'
    WHEN 4 THEN ' {{< relref "doc-'||(doc_id+20)||'" >}} more'
    WHEN 5 THEN ' {{< member-by-name >}}hidden{{< /member-by-name >}} shown'
    ELSE ' plain & simple <a href="https://example.com/x">link</a>' END AS content FROM docs""",
    ),
    "html_pages": (
        (),
        """SELECT page_id, url AS path, html || '<p><img src="x.png" alt="pic '||page_id||'"></p>'||chr(10)||'<table>'||chr(10)||'<tr><th>id</th><th>n</th></tr>'||chr(10)||'<tr><td>'||page_id||'</td><td>1</td></tr></table>' AS content FROM pages""",
    ),
    "centroids": (
        (),
        "SELECT label AS query_id, list(a ORDER BY p) AS qv FROM (SELECT label, p, avg(embedding[p]::DOUBLE) AS a FROM embeddings, (SELECT unnest(range(1, 65)) AS p) GROUP BY ALL) GROUP BY label",
    ),
    "ranked": (
        ("centroids",),
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT query_id, vec_id, label, embedding::DOUBLE[] AS vector, round(list_cosine_similarity(embedding::DOUBLE[], qv), 9) AS score FROM embeddings, centroids)) WHERE rank <= 15""",
    ),
}


def _embedded(name: str, source: str, key: str, text: str) -> tuple[tuple[str, ...], str]:
    """Unit-length word-bucket counts of a text column."""
    return (
        (source,),
        f"""SELECT {key}, list_transform(counts, lambda c: c / nrm) AS vector FROM (
  SELECT {key}, counts, sqrt(list_sum(list_transform(counts, lambda c: c * c))) AS nrm FROM (
    SELECT {key}, list_transform(range({DIMS}), lambda b: coalesce(hist[b::BIGINT], 0)::DOUBLE) AS counts FROM (
      SELECT {key}, histogram(('0x'||substr(md5(w),1,8))::BIGINT % {DIMS}) AS hist FROM (
        SELECT {key}, unnest({words(text)}) AS w FROM {source}) GROUP BY {key})))""",
    )


CTES["chunk_vectors"] = _embedded("chunk_vectors", "chunks", "chunk_id", "content")
CTES["question_vectors"] = _embedded("question_vectors", "questions", "question_id", "question")
CTES["retrieved"] = (
    ("chunks", "chunk_vectors", "question_vectors"),
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT q.question_id, c.chunk_id, c.document_path, c.content, round(list_cosine_similarity(v.vector::FLOAT[]::DOUBLE[], q.vector), 9) AS score
  FROM question_vectors q, chunk_vectors v JOIN chunks c USING (chunk_id))) WHERE rank <= {TOP_K}""",
)


def query(body: str, *needs: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """``body`` below a WITH clause: needed tables in dependency order, then ``extra`` ones."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    ctes = [f"{name} AS MATERIALIZED ({CTES[name][1]})" for name in order]
    ctes += [f"{name} AS ({text})" for name, text in (extra or {}).items()]
    if not ctes:
        return body.strip()
    lead = "WITH RECURSIVE " if recursive else "WITH "
    return lead + ",\n".join(ctes) + "\n" + body.strip()
