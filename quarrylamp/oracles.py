"""The workloads restated as plain SQL over the given tables.

Written independently of the Spark plans: ranks are found by comparing every end with every
occurrence, neighbours by comparing every pair.
"""

from __future__ import annotations

SPACE = r"\s\v\pZ\x{85}"
TOKENS = rf"'[^{SPACE}]+'"
WORDS = r"'[\pL\pN]+'"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _hex(value: str, digits: int) -> str:
    return f"CAST(('0x' || substr(md5({value}), 1, {digits})) AS BIGINT)"


def _key(value: str) -> str:
    return f"({_hex(f'CAST({value} AS VARCHAR)', 8)} / 4294967296.0)"


DOCS = f"""docs AS (
  SELECT doc_id AS id, 'https://' || source || '.example.com/doc/' || doc_id AS url,
    string_split(text, chr(10))[1] AS title, string_split(text, chr(10))[-1] AS description,
    source || '.example.com' AS source_host, sha256(text) AS content_hash,
    {_key('doc_id')} AS random_key
  FROM documents)"""


def _chunk_texts(size: int = 384, overlap: int = 64, source: str = "documents") -> str:
    step = size - overlap
    return f"""windows AS (
  SELECT doc_id, text, t, unnest(range(0, 1 + CASE WHEN len(t) > {size}
      THEN CAST(ceil((len(t) - {size}) / {step}.0) AS BIGINT) ELSE 0 END)) AS i
  FROM (SELECT doc_id, text, regexp_extract_all(text, {TOKENS}) AS t FROM {source})),
chunk_texts AS (
  SELECT doc_id * 1000 + i AS id, doc_id AS document_id, CAST(i AS INTEGER) AS chunk_index,
    CASE WHEN len(t) = 0 THEN text
      ELSE array_to_string(t[i * {step} + 1 : i * {step} + {size}], ' ') END AS content,
    CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE 'current' END AS embedding_model,
    (doc_id * 7 + i) % (SELECT count(*) FROM embeddings) AS vec_id
  FROM windows)"""


CHUNKS = _chunk_texts()

REEMBED_PIECES = f"""sizes AS (
  SELECT document_id, count(*) AS n FROM chunk_texts GROUP BY document_id),
stale AS (
  SELECT c.*, s.n, regexp_extract_all(content, {TOKENS}) AS t
  FROM chunk_texts c JOIN sizes s USING (document_id) WHERE document_id % 7 = 0),
pieces AS (
  SELECT document_id, chunk_index, content FROM stale WHERE n > 1
  UNION ALL
  SELECT document_id, CAST(i AS INTEGER), CASE WHEN len(t) = 0 THEN content
    ELSE array_to_string(t[i * 96 + 1 : i * 96 + 128], ' ') END
  FROM (SELECT *, unnest(range(0, 1 + CASE WHEN len(t) > 128
    THEN CAST(ceil((len(t) - 128) / 96.0) AS BIGINT) ELSE 0 END)) AS i FROM stale WHERE n = 1))"""

REEMBED_BATCHES = """batches AS (
  SELECT document_id, (row_number() OVER (ORDER BY document_id) - 1) // 100 AS batch
  FROM (SELECT DISTINCT document_id FROM pieces))"""

ASKED = f"""items AS (
  SELECT item_id AS query_id, regexp_extract_all(lower(text), {WORDS}) AS w,
    list_filter(list_transform(string_split(text, '.'),
      lambda s: regexp_extract_all(lower(s), {WORDS})), lambda s: len(s) > 0)[-1] AS s,
    item_id * 11 % (SELECT count(*) FROM embeddings) AS vec_id
  FROM benchmark),
repeated AS (
  SELECT query_id, word FROM (SELECT query_id, unnest(w) AS word FROM items)
  GROUP BY query_id, word HAVING count(*) > 1)"""

WORD_LITERALS = "SELECT query_id, 0 AS g, word AS l, word, 0 AS off, 1 AS parts FROM repeated"
SENTENCE_LITERALS = (
    "SELECT query_id, 1 AS g, '\"' AS l, unnest(s) AS word, unnest(range(0, len(s))) AS off, "
    "len(s) AS parts FROM items"
)

CHUNK_POSTINGS = f"""post AS (
  SELECT id AS unit_id, unnest(w) AS lexeme, unnest(range(1, len(w) + 1)) AS pos, 10.0 AS inv
  FROM (SELECT id, regexp_extract_all(lower(content), {WORDS}) AS w FROM chunk_texts))"""

DOC_WORDS = f"""doc_words AS (
  SELECT id, regexp_extract_all(lower(title), {WORDS}) AS a,
    regexp_extract_all(lower(description), {WORDS}) AS b FROM docs)"""

DOC_POSTINGS = DOC_WORDS + """,
{name} AS (
  SELECT id AS unit_id, unnest(a) AS lexeme, unnest(range(1, len(a) + 1)) AS pos,
    1.0 AS inv, 'A' AS weight FROM doc_words
  UNION ALL
  SELECT id, unnest(b), len(a) + unnest(range(1, len(b) + 1)), 2.5, 'B' FROM doc_words)"""


def _ranks(post: str, positive: str, extra: str = "", prefix: str = "") -> str:
    """CTEs ending in `{prefix}ranks(query_id, unit_id, text_rank)`."""
    p = prefix
    every = positive if not extra else f"{positive} UNION ALL {extra}"
    return f"""{p}lits AS ({positive}),
{p}need AS (SELECT query_id, g, count(DISTINCT l) AS n FROM {p}lits GROUP BY query_id, g),
{p}qwords AS (SELECT DISTINCT query_id, word FROM ({every})),
{p}hits AS (
  SELECT q.query_id, p.unit_id, p.pos, p.inv FROM {p}qwords q JOIN {post} p ON p.lexeme = q.word),
{p}occ AS (
  SELECT l.query_id, p.unit_id, l.g, l.l, p.pos - l.off AS s,
    p.pos - l.off + max(l.parts) - 1 AS e
  FROM {p}lits l JOIN {post} p ON p.lexeme = l.word
  GROUP BY l.query_id, p.unit_id, l.g, l.l, p.pos - l.off HAVING count(*) = max(l.parts)),
{p}ends AS (SELECT DISTINCT query_id, unit_id, e FROM {p}occ),
{p}latest AS (
  SELECT n.query_id, n.unit_id, n.e, o.g, o.l, max(o.s) AS s
  FROM {p}ends n JOIN {p}occ o
    ON o.query_id = n.query_id AND o.unit_id = n.unit_id AND o.e <= n.e
  GROUP BY n.query_id, n.unit_id, n.e, o.g, o.l),
{p}closed AS (
  SELECT query_id, unit_id, e, g, min(s) AS p FROM {p}latest JOIN {p}need USING (query_id, g)
  GROUP BY query_id, unit_id, e, g HAVING count(*) = max(n)),
{p}covers AS (
  SELECT query_id, unit_id, p, min(e) AS e
  FROM (SELECT query_id, unit_id, e, max(p) AS p FROM {p}closed GROUP BY query_id, unit_id, e)
  GROUP BY query_id, unit_id, p),
{p}dense AS (
  SELECT c.query_id, c.unit_id, c.p, c.e, count(*) AS n, sum(h.inv) AS inv
  FROM {p}covers c JOIN {p}hits h
    ON h.query_id = c.query_id AND h.unit_id = c.unit_id AND h.pos BETWEEN c.p AND c.e
  GROUP BY c.query_id, c.unit_id, c.p, c.e),
{p}ranks AS (
  SELECT query_id, unit_id, r / (r + 1) AS text_rank
  FROM (SELECT query_id, unit_id, sum(n / inv / (1 + (e - p + 1 - n))) AS r
        FROM {p}dense GROUP BY query_id, unit_id))"""


BOTH = f"{WORD_LITERALS} UNION ALL {SENTENCE_LITERALS}"
CHUNK_RANKS = ",\n".join([CHUNKS, ASKED, CHUNK_POSTINGS, _ranks("post", BOTH)])

COS = "round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 9)"
HALF = (
    "list_transform(CAST({a} AS DOUBLE[]), lambda x: CASE WHEN x = 0 THEN 0.0 ELSE "
    "round_even(x * pow(2.0, 10 - greatest(floor(log2(abs(x))), -14)), 0) "
    "/ pow(2.0, 10 - greatest(floor(log2(abs(x))), -14)) END)"
)


def _top(rows: str, order: str, k: int, columns: str) -> str:
    return (
        f"SELECT {columns}, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank "
        f"FROM {rows} QUALIFY rank <= {k}"
    )


def _pairs(half: bool = False) -> str:
    a, b = ("q.embedding", "v.embedding")
    if half:
        a, b = HALF.format(a=a), HALF.format(a=b)
    cosine = f"round(list_cosine_similarity({a}, {b}), 9)" if half else COS.format(a=a, b=b)
    return f"""near_vectors AS (
  SELECT i.query_id, v.vec_id, {cosine} AS sim
  FROM items i JOIN embeddings q ON q.vec_id = i.vec_id CROSS JOIN embeddings v),
near_chunks AS (
  SELECT * FROM (
    SELECT n.query_id, c.id AS chunk_id, c.document_id, n.sim AS similarity
    FROM near_vectors n JOIN chunk_texts c ON c.vec_id = n.vec_id
    QUALIFY row_number() OVER (PARTITION BY n.query_id ORDER BY n.sim DESC, c.id) <= 200)
  WHERE similarity > 0.2),
near_docs AS (
  SELECT * FROM near_chunks QUALIFY row_number() OVER (
    PARTITION BY query_id, document_id ORDER BY similarity DESC, chunk_id) = 1)"""


def _hybrid_ctes(half: bool = False) -> str:
    return ",\n".join(
        [
            DOCS, CHUNKS, ASKED, CHUNK_POSTINGS, DOC_POSTINGS.format(name="dpost"),
            _ranks("post", BOTH), _ranks("dpost", BOTH, prefix="d_"), _pairs(half),
            """text_chunks AS (
  SELECT r.query_id, r.unit_id AS chunk_id, c.document_id, r.text_rank
  FROM ranks r JOIN chunk_texts c ON c.id = r.unit_id
  QUALIFY row_number() OVER (
    PARTITION BY r.query_id ORDER BY round(r.text_rank, 12) DESC, r.unit_id) <= 200),
text_chunk_docs AS (
  SELECT * FROM text_chunks QUALIFY row_number() OVER (
    PARTITION BY query_id, document_id ORDER BY round(text_rank, 12) DESC, chunk_id) = 1),
text_docs AS (
  SELECT query_id, unit_id AS document_id, text_rank FROM d_ranks
  QUALIFY row_number() OVER (
    PARTITION BY query_id ORDER BY round(text_rank, 12) DESC, unit_id) <= 200),
candidates AS (
  SELECT query_id, document_id FROM near_docs UNION
  SELECT query_id, document_id FROM text_chunk_docs UNION
  SELECT query_id, document_id FROM text_docs),
scored AS (
  SELECT k.query_id, k.document_id,
    left(coalesce(vc.content, tc.content, fc.content, ''), 500) AS snippet,
    0.7 * greatest(coalesce(n.similarity, 0), 0)
      + 0.3 * greatest(coalesce(t.text_rank, 0), coalesce(d.text_rank, 0)) AS score
  FROM candidates k
  LEFT JOIN near_docs n USING (query_id, document_id)
  LEFT JOIN chunk_texts vc ON vc.id = n.chunk_id
  LEFT JOIN text_chunk_docs t USING (query_id, document_id)
  LEFT JOIN chunk_texts tc ON tc.id = t.chunk_id
  LEFT JOIN text_docs d USING (query_id, document_id)
  LEFT JOIN chunk_texts fc ON fc.document_id = k.document_id AND fc.chunk_index = 0),
ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY query_id ORDER BY round(score, 9) DESC, document_id) AS rank FROM scored)""",
        ]
    )


def _hybrid(offset: int, half: bool = False) -> str:
    return _with(_hybrid_ctes(half)) + f"""SELECT r.query_id, r.rank, r.document_id AS id, d.url,
  sha256(r.snippet) AS snippet_hash, round(r.score, 6) AS similarity
FROM ranked r JOIN docs d ON d.id = r.document_id
WHERE r.rank > {offset} AND r.rank <= {offset + 10}"""


URL = r"'^(?i)(https?)://(?:[^/?#]*@)?([^/?#:@\[\]]+)(?::([0-9]*))?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$'"


def _canonical(url: str) -> str:
    def part(n: int) -> str:
        return f"regexp_extract(trim({url}), {URL}, {n})"

    scheme, port = f"lower({part(1)})", part(3)
    return f"""(CASE WHEN {part(1)} = '' THEN NULL ELSE
    {scheme} || '://' || lower({part(2)}) ||
    CASE WHEN {port} = '' OR ({scheme} = 'http' AND {port} = '80')
      OR ({scheme} = 'https' AND {port} = '443') THEN '' ELSE ':' || {port} END ||
    CASE WHEN rtrim({part(4)}, '/') = '' THEN '/' ELSE rtrim({part(4)}, '/') END ||
    CASE WHEN {part(5)} = '' THEN '' ELSE '?' || {part(5)} END END)"""


def _escaped(path: str) -> str:
    out = f"url_encode({path})"
    for escaped, plain in (
        ("%2F", "/"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%2C", ","),
        ("%3A", ":"), ("%3B", ";"), ("%3D", "="), ("%40", "@"),
    ):
        out = f"replace({out}, '{escaped}', '{plain}')"
    return out


LINKS = f"""found AS (
  SELECT {_canonical('url')} AS src_url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href
  FROM pages),
page_links AS (
  SELECT src_url, regexp_extract(src_url, '^([a-z]+://[^/]+)', 1) ||
    CASE WHEN rtrim({_escaped('href')}, '/') = '' THEN '/' ELSE rtrim({_escaped('href')}, '/') END
    AS dst_url
  FROM found WHERE trim(href) <> '')"""

MESSAGES = """messages AS (
  SELECT 'HTTPS://' || source || '.Example.com:443/doc/' || doc_id || '/#top' AS raw_url,
    'https://' || source || '.example.com/doc/' || doc_id AS url, source || '.example.com' AS host,
    string_split(text, chr(10))[1] AS title, text AS content,
    string_split(text, chr(10))[-1] AS description, doc_id AS seq
  FROM documents)"""

REASON = """CASE
  WHEN trim(content) = '' THEN 'empty_page'
  WHEN length(raw_url) > 2048 THEN 'long_url'
  WHEN length(title) > 1000 OR length(description) > 4000 THEN 'long_metadata'
  WHEN strlen(content) > 900000 THEN 'large_content' ELSE '' END"""

RECRAWL = f"""{DOCS},
{CHUNKS},
{MESSAGES},
arrivals AS (
  SELECT raw_url, url, host, title,
    CASE WHEN seq % 3 = 0 THEN content || ' revised' ELSE content END AS content,
    description, seq FROM messages
  UNION ALL
  SELECT url, {_canonical('url')}, regexp_extract({_canonical('url')}, '://([^/:]+)', 1), '', html,
    '', (1::BIGINT << 40) + page_id FROM pages),
accepted AS (
  SELECT * FROM arrivals WHERE ({REASON}) = ''
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1),
known AS (
  SELECT a.*, d.id AS known_id, sha256(a.content) AS new_hash,
    CASE WHEN d.id IS NULL THEN 'new'
      WHEN sha256(a.content) = d.content_hash AND d.id % 7 <> 0 THEN 'unchanged'
      ELSE 'changed' END AS status
  FROM accepted a LEFT JOIN docs d ON d.url = a.url),
identified AS (
  SELECT *, CASE WHEN known_id IS NOT NULL THEN known_id ELSE (SELECT max(id) FROM docs)
    + row_number() OVER (PARTITION BY known_id IS NULL ORDER BY md5(url)) END AS id
  FROM known)"""

RENEWED_CHUNKS = f"""rewindows AS (
  SELECT id, content, t, unnest(range(0, 1 + CASE WHEN len(t) > 384
      THEN CAST(ceil((len(t) - 384) / 320.0) AS BIGINT) ELSE 0 END)) AS i
  FROM (SELECT id, content, regexp_extract_all(content, {TOKENS}) AS t
        FROM identified WHERE status <> 'unchanged')),
renewed AS (
  SELECT (SELECT max(id) FROM chunk_texts)
      + row_number() OVER (ORDER BY md5(id || ':' || i)) AS id,
    id AS document_id, CAST(i AS INTEGER) AS chunk_index,
    CASE WHEN len(t) = 0 THEN content
      ELSE array_to_string(t[i * 320 + 1 : i * 320 + 384], ' ') END AS content,
    'current' AS embedding_model
  FROM rewindows)"""

MERGED_POSTINGS = f"""merged AS (
  SELECT id, document_id, content FROM chunk_texts
  WHERE document_id NOT IN (SELECT id FROM identified WHERE status <> 'unchanged')
  UNION ALL SELECT id, document_id, content FROM renewed),
post AS (
  SELECT id AS unit_id, document_id, unnest(w) AS lexeme, unnest(range(1, len(w) + 1)) AS pos, 10.0 AS inv
  FROM (SELECT id, document_id, regexp_extract_all(lower(content), {WORDS}) AS w FROM merged))"""

TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
BODY = "regexp_replace(regexp_extract(html, '(?s)<body>(.*)$', 1), '(?s)<!--.*?-->|<[^>]*>', '', 'g')"


def _plain_text(markup: str) -> str:
    """Markup without tags, its character references resolved; the ampersand comes last."""
    for name, character in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        markup = f"replace({markup}, '&{name};', '{character}')"
    return markup


RELEVANT = f"""{_ranks("post", SENTENCE_LITERALS, prefix="s_")},
relevant AS (
  SELECT DISTINCT r.query_id, c.document_id, CAST(coalesce(l.quality + 1, 1) AS DOUBLE) AS grade
  FROM s_ranks r JOIN chunk_texts c ON c.id = r.unit_id
  LEFT JOIN labels l ON l.doc_id = c.document_id)"""

JUDGED = """judged AS (
  SELECT r.query_id, r.rank, r.document_id, g.grade,
    count(g.grade) OVER (PARTITION BY r.query_id ORDER BY r.rank) AS hits
  FROM results r LEFT JOIN relevant g USING (query_id, document_id)),
ideal AS (
  SELECT query_id, grade, row_number() OVER (
    PARTITION BY query_id ORDER BY grade DESC, CAST(document_id AS VARCHAR)) AS place
  FROM relevant),
best_gain AS (
  SELECT query_id, count(*) AS n,
    sum((pow(2, grade) - 1) / log2(place + 1)) FILTER (place <= 5) AS i5,
    sum((pow(2, grade) - 1) / log2(place + 1)) FILTER (place <= 10) AS i10
  FROM ideal GROUP BY query_id),
per_query AS (
  SELECT query_id, min(rank) FILTER (grade IS NOT NULL) AS first_hit,
    sum(hits / rank) FILTER (grade IS NOT NULL) AS precisions,
    count(grade) FILTER (rank <= 5) AS h5, count(grade) FILTER (rank <= 10) AS h10,
    sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (rank <= 5) AS g5,
    sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (rank <= 10) AS g10,
    string_agg(CAST(document_id AS VARCHAR), ' ' ORDER BY rank) AS returned
  FROM judged GROUP BY query_id),
per_case AS (
  SELECT b.query_id, coalesce(p.returned, '') AS returned,
    (SELECT string_agg(CAST(document_id AS VARCHAR), ' ' ORDER BY CAST(document_id AS VARCHAR))
     FROM relevant r WHERE r.query_id = b.query_id) AS relevant,
    coalesce(1.0 / first_hit, 0) AS mrr, coalesce(precisions, 0) / n AS ap,
    coalesce(h5, 0) / 5.0 AS precision_5, coalesce(h5, 0) / n AS recall_5,
    coalesce(g5, 0) / i5 AS ndcg_5, coalesce(h10, 0) / 10.0 AS precision_10,
    coalesce(h10, 0) / n AS recall_10, coalesce(g10, 0) / i10 AS ndcg_10
  FROM best_gain b LEFT JOIN per_query p USING (query_id))"""

EVALUATION = f"""{CHUNK_RANKS},
{RELEVANT},
best AS (
  SELECT r.query_id, c.document_id, max(round(r.text_rank, 9)) AS text_rank
  FROM ranks r JOIN chunk_texts c ON c.id = r.unit_id GROUP BY r.query_id, c.document_id),
results AS ({_top("best", "text_rank DESC, document_id", 10, "query_id, document_id")}),
{JUDGED}"""

METRICS = ["mrr", "ap", "precision_5", "recall_5", "ndcg_5", "precision_10", "recall_10", "ndcg_10"]

# Fixed value: the synthetic vocabulary, in order.
VOCABULARY = (
    "architecture authentication benchmark caching crawler database deployment "
    "embedding frontend grpc indexing latency migration model observability "
    "pagination postgres production query ranking retrieval search security "
    "service storage testing vector website"
)

ORACLES: dict[str, str] = {
    "vector_search_threshold": f"""
WITH pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS id,
    {COS.format(a='q.embedding', b='v.embedding')} AS sim FROM embeddings q CROSS JOIN embeddings v)
SELECT query_id, id, round(sim, 6) AS similarity,
  row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank
FROM pairs WHERE sim > 0.3 QUALIFY rank <= 10""",
    "knn_exclude_self": f"""
WITH pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS id,
    {COS.format(a='q.embedding', b='v.embedding')} AS sim FROM embeddings q CROSS JOIN embeddings v
    WHERE q.vec_id <> v.vec_id)
SELECT query_id, id, round(sim, 6) AS similarity,
  row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank
FROM pairs QUALIFY rank <= 10""",
    "knn_rings": f"""
WITH pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS id,
    {COS.format(a='q.embedding', b='v.embedding')} AS sim FROM embeddings q CROSS JOIN embeddings v
    WHERE q.vec_id <> v.vec_id)
SELECT query_id, id, round(sim, 6) AS similarity,
  row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank
FROM pairs QUALIFY rank <= 10""",
    "vector_chunk_candidates": _with(CHUNKS, ASKED, _pairs())
    + "SELECT query_id, chunk_id, document_id, round(similarity, 6) AS similarity FROM near_chunks",
    "best_chunk_per_document": _with(CHUNKS, ASKED, _pairs())
    + "SELECT query_id, document_id, chunk_id, round(similarity, 6) AS similarity FROM near_docs",
    "half_precision_vectors": f"""
SELECT vec_id AS id, unnest(range(0, len(embedding)))::INTEGER AS dim,
  unnest({HALF.format(a='embedding')}) AS value FROM embeddings""",
    "normalized_vectors": """
WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(
    CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS norm FROM embeddings)
SELECT vec_id AS id, unnest(range(0, len(embedding)))::INTEGER AS dim, round(CAST(CAST(
  unnest(CAST(embedding AS DOUBLE[])) / greatest(norm, 1e-12) AS FLOAT) AS DOUBLE), 6) AS value
FROM n""",
    "next_stored_ids": """
SELECT d.doc_id AS candidate, min(l.doc_id) AS id
FROM documents d JOIN labels l ON l.doc_id >= d.doc_id GROUP BY d.doc_id""",
    "sample_query_ids": f"""
WITH span AS (SELECT min(vec_id) AS low, max(vec_id) AS high FROM embeddings),
tries AS (SELECT i, low + {_hex("'42:' || i", 12)} % (high - low + 1) AS c FROM range(400) t(i), span),
found AS (SELECT i, (SELECT min(vec_id) FROM embeddings WHERE vec_id >= c) AS id FROM tries)
SELECT id FROM (SELECT id, min(i) AS i FROM found GROUP BY id) ORDER BY i LIMIT 20""",
    "label_cells_recall": f"""
WITH sums AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS mean FROM (
    SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL),
centers AS (SELECT label, list(mean ORDER BY pos) AS c FROM sums GROUP BY label),
near AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY
    {COS.format(a='embedding', b='c')} DESC, centers.label) AS place
  FROM (SELECT vec_id, embedding FROM embeddings) v CROSS JOIN centers),
pairs AS (SELECT q.vec_id AS q, v.vec_id AS v, {COS.format(a='q.embedding', b='v.embedding')} AS sim
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id),
exact AS (SELECT q, v FROM pairs QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, v) <= 10),
configs AS (SELECT unnest([1, 2, (SELECT count(*) FROM centers)]) AS config),
reach AS (SELECT config, p.q, p.v, p.sim FROM pairs p JOIN near b ON b.vec_id = p.v AND b.place = 1
  JOIN near a ON a.vec_id = p.q AND a.label = b.label JOIN configs ON a.place <= config),
got AS (SELECT config, q, v FROM reach
  QUALIFY row_number() OVER (PARTITION BY config, q ORDER BY sim DESC, v) <= 10),
shares AS (SELECT config, e.q, count(g.v) / count(*) AS share FROM exact e CROSS JOIN configs
  LEFT JOIN got g USING (config, q, v) GROUP BY config, e.q)
SELECT CAST(config AS INTEGER) AS config, round(avg(share), 6) AS recall_at_k FROM shares GROUP BY config""",
    "collapsed_texts": r"""
SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed_hash FROM documents""",
    "bulk_load": """
SELECT source, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source""",
    "first_of_source": """
SELECT min(doc_id) AS doc_id, source, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source""",
    "stored_cases": """
SELECT source AS query, doc_id, 2.0::DOUBLE AS grade FROM documents JOIN labels USING (doc_id) WHERE quality = 1""",
    "query_vectors": _with(DOCS, f"""asked AS (
  SELECT id, trim(title) AS q FROM docs WHERE trim(title) <> '' AND length(title) <= 512),
codes AS (SELECT id, {_hex('w', 6)} AS code
  FROM (SELECT id, unnest(regexp_extract_all(lower(q), {WORDS})) AS w FROM asked)),
sums AS (
  SELECT id, (code >> 1) % 64 AS dim, sum(CASE WHEN code % 2 = 1 THEN 1.0 ELSE -1.0 END) AS x
  FROM codes GROUP BY ALL),
norms AS (SELECT id, greatest(sqrt(sum(x * x)), 1e-12) AS norm FROM sums GROUP BY id)""") + """
SELECT c.id, CAST(d.dim AS INTEGER) AS dim,
  round(CAST(CAST(coalesce(s.x, 0) / coalesce(n.norm, 1) AS FLOAT) AS DOUBLE), 6) AS value
FROM asked c CROSS JOIN range(0, 64) d(dim)
LEFT JOIN sums s ON s.id = c.id AND s.dim = d.dim LEFT JOIN norms n ON n.id = c.id""",
    "reembed_batch": _with(CHUNKS) + """
SELECT DISTINCT document_id FROM chunk_texts WHERE embedding_model <> 'current' AND document_id > 100
ORDER BY document_id LIMIT 50""",
    "reembed_totals": _with(CHUNKS, REEMBED_PIECES) + """
SELECT count(DISTINCT document_id) AS documents, count(*) AS chunks FROM pieces""",
    "report_round_trip": "WITH " + EVALUATION + "\nSELECT query_id, "
    + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS) + " FROM per_case",
    "chunk_index_after_recrawl": _with(RECRAWL, RENEWED_CHUNKS, MERGED_POSTINGS) + """
SELECT lexeme, count(DISTINCT unit_id) AS units, count(DISTINCT document_id) AS documents,
  count(*) AS places, CAST(sum(pos) AS BIGINT) AS pos_sum FROM post GROUP BY lexeme""",
    "document_index_after_recrawl": _with(RECRAWL, """titled AS (
  SELECT id, title, description FROM docs WHERE id NOT IN (SELECT id FROM identified)
  UNION ALL SELECT id, title, description FROM identified)""",
        DOC_POSTINGS.format(name="post").replace("FROM docs)", "FROM titled)"))
    + "SELECT unit_id, lexeme, CAST(pos AS INTEGER) AS pos, weight FROM post",
    "search_after_recrawl": _with(RECRAWL, RENEWED_CHUNKS, MERGED_POSTINGS, ASKED, _ranks("post", BOTH))
    + "SELECT query_id, unit_id, round(text_rank, 6) AS text_rank FROM ranks",
    "canonical_urls": f"SELECT page_id, {_canonical('url')} AS canonical, "
    f"{_canonical('url')} AS normalized FROM pages",
    "display_split": """
SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS host,
  regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS page FROM pages""",
    "page_hosts": """
SELECT lower(regexp_extract(url, '://([^/:?#]+)', 1)) AS host, count(*) AS pages
FROM pages GROUP BY ALL""",
    "page_fields": f"""
SELECT page_id, {_canonical('url')} AS url, trim({_plain_text(TITLE)}) AS title, '' AS description,
  sha256(trim(regexp_replace({_plain_text(BODY)}, '\\s+', ' ', 'g'))) AS body_hash,
  CAST(len(regexp_extract_all(html, '<a ')) AS INTEGER) AS n_references
FROM pages WHERE trim({_plain_text(BODY)}) <> ''""",
    "page_fields_raw": f"""
SELECT page_id, url, {_plain_text(TITLE)} AS title, CAST(length({_plain_text(BODY)}) AS INTEGER) AS body_chars,
  CAST(len(regexp_extract_all(html, '<a ')) AS INTEGER) AS n_references FROM pages""",
    "page_ingest": f"""
WITH found AS (
  SELECT page_id, {_canonical('url')} AS url, trim({_plain_text(TITLE)}) AS title,
    trim(regexp_replace({_plain_text(BODY)}, '\\s+', ' ', 'g')) AS body FROM pages),
last AS (
  SELECT *, regexp_extract_all(body, {TOKENS}) AS t FROM found WHERE body <> '' AND url IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1),
pieces AS (
  SELECT *, unnest(range(0, 1 + CASE WHEN len(t) > 384
    THEN CAST(ceil((len(t) - 384) / 320.0) AS BIGINT) ELSE 0 END)) AS i FROM last)
SELECT dense_rank() OVER (ORDER BY md5(url)) AS id, url, title, regexp_extract(url, '://([^/:]+)', 1) AS source_host,
  sha256(body) AS content_hash, count(*) AS chunks,
  max(length(array_to_string(t[i * 320 + 1 : i * 320 + 384], ' '))) AS longest
FROM pieces GROUP BY url, title, body""",
    "page_titles": """
SELECT page_id, trim(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1),
  '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title, '' AS description FROM pages""",
    "page_links": _with(LINKS) + "SELECT src_url, dst_url FROM page_links",
    "same_host_counts": _with(LINKS)
    + """SELECT src_url, count(*) AS links, CAST(sum(CAST(regexp_extract(src_url, '://([^/:]+)', 1)
  = regexp_extract(dst_url, '://([^/:]+)', 1) AS BIGINT)) AS BIGINT) AS same_host
FROM page_links GROUP BY src_url""",
    "reachable_pages": """
WITH RECURSIVE links AS (
  SELECT DISTINCT 'https://shop.example.com/customer/' || o_custkey AS s,
    'https://shop.example.com/order/' || o_orderkey AS d FROM orders
  UNION SELECT DISTINCT 'https://shop.example.com/order/' || l_orderkey,
    'https://shop.example.com/part/' || l_partkey FROM lineitem),
walk AS (
  SELECT 'https://shop.example.com/customer/' || c_custkey AS start_url,
    'https://shop.example.com/customer/' || c_custkey AS url, 1 AS depth FROM customer
  UNION SELECT w.start_url, l.d, w.depth + 1 FROM walk w JOIN links l ON l.s = w.url
  WHERE w.depth < 3)
SELECT start_url, url, min(depth) AS depth FROM walk GROUP BY start_url, url""",
    "ingest_validation": _with(MESSAGES) + f"SELECT seq, {REASON} AS reject_reason FROM messages",
    "query_validation": f"""
WITH asked AS (
  SELECT conv_id, turn, text AS query, trim(text) = '' AS blank,
    CASE WHEN conv_id % 120 = 0 THEN 1 ELSE conv_id % 120 END AS page_number,
    CASE WHEN turn * 13 = 0 THEN CASE WHEN trim(text) = '' THEN 5 ELSE 10 END ELSE turn * 13 END
      AS result_per_page FROM conversations)
SELECT conv_id, turn, CAST(page_number AS INTEGER) AS page_number,
  CAST(result_per_page AS INTEGER) AS result_per_page,
  CAST((page_number - 1) * result_per_page AS INTEGER) AS result_offset,
  CASE WHEN length(query) > 512 THEN 'long_query'
    WHEN page_number NOT BETWEEN 1 AND 100 THEN 'page_out_of_range'
    WHEN result_per_page NOT BETWEEN 1 AND 50 THEN 'page_size_out_of_range'
    ELSE '' END AS reject_reason FROM asked""",
    "content_hashes": """
SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc
FROM documents GROUP BY ALL""",
    "latest_per_url": _with(MESSAGES) + f"""
SELECT 'https://' || host || '/' AS url, seq, sha256(content) AS content_hash, host AS source_host
FROM (SELECT * FROM messages WHERE ({REASON}) = '')
QUALIFY row_number() OVER (PARTITION BY host ORDER BY seq DESC) = 1""",
    "upsert_status": _with(RECRAWL) + "SELECT url, id, status FROM identified",
    "upsert_documents": _with(RECRAWL) + """
SELECT id, url, title, description, source_host, content_hash, false AS touched FROM docs
WHERE id NOT IN (SELECT id FROM identified)
UNION ALL SELECT id, url, title, description, host, new_hash, true FROM identified""",
    "replace_chunks": _with(RECRAWL, RENEWED_CHUNKS) + """
SELECT id, document_id, chunk_index, sha256(content) AS content_hash, embedding_model
FROM chunk_texts WHERE document_id NOT IN (SELECT id FROM identified WHERE status <> 'unchanged')
UNION ALL SELECT id, document_id, chunk_index, sha256(content), embedding_model FROM renewed""",
    "delete_source": _with(DOCS, CHUNKS) + """
SELECT d.id, d.source_host, count(*) AS chunks FROM docs d JOIN chunk_texts c ON c.document_id = d.id
WHERE d.id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY d.id, d.source_host""",
    "replace_host": _with(DOCS, CHUNKS) + """
SELECT d.source_host, count(DISTINCT d.id) AS documents, count(*) AS chunks
FROM docs d JOIN chunk_texts c ON c.document_id = d.id
WHERE d.source_host <> 'src3.example.com' GROUP BY d.source_host""",
    "stream_ingest": _with(RECRAWL) + f"""
SELECT url, title, new_hash AS content_hash, 1 + CASE WHEN n > 384
  THEN CAST(ceil((n - 384) / 320.0) AS BIGINT) ELSE 0 END AS chunks
FROM (SELECT *, len(regexp_extract_all(content, {TOKENS})) AS n FROM known)""",
    "token_chunks": _with(CHUNKS) + f"""
SELECT document_id, chunk_index, sha256(content) AS content_hash,
  CAST(len(regexp_extract_all(content, {TOKENS})) AS INTEGER) AS tokens FROM chunk_texts""",
    "chunk_counts": _with(CHUNKS)
    + "SELECT document_id, count(*) AS chunks FROM chunk_texts GROUP BY document_id",
    "hash_encode": _with(CHUNKS, f"""codes AS (
  SELECT id, {_hex('w', 6)} AS code
  FROM (SELECT id, unnest(regexp_extract_all(lower(content), {WORDS})) AS w FROM chunk_texts)),
sums AS (
  SELECT id, (code >> 1) % 64 AS dim, sum(CASE WHEN code % 2 = 1 THEN 1.0 ELSE -1.0 END) AS x
  FROM codes GROUP BY ALL),
norms AS (SELECT id, greatest(sqrt(sum(x * x)), 1e-12) AS norm FROM sums GROUP BY id)""") + """
SELECT c.id, CAST(d.dim AS INTEGER) AS dim,
  round(CAST(CAST(coalesce(s.x, 0) / coalesce(n.norm, 1) AS FLOAT) AS DOUBLE), 6) AS value
FROM chunk_texts c CROSS JOIN range(0, 64) d(dim)
LEFT JOIN sums s ON s.id = c.id AND s.dim = d.dim LEFT JOIN norms n ON n.id = c.id""",
    "backfill_chunks": _with(CHUNKS, """stored AS (
  SELECT c.* FROM chunk_texts c JOIN documents d ON d.doc_id = c.document_id WHERE d.lang = 'en')""") + """
SELECT id, document_id, chunk_index, sha256(content) AS content_hash, embedding_model FROM stored
UNION ALL
SELECT (SELECT max(id) FROM stored) + row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR))),
  doc_id, 0, sha256(text), 'legacy'
FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)
  AND doc_id NOT IN (SELECT document_id FROM stored)""",
    "reassemble_documents": """
SELECT conv_id AS id, sha256(string_agg(text, ' ' ORDER BY turn)) AS content_hash
FROM conversations GROUP BY conv_id""",
    "reembed_counts": _with(CHUNKS) + """
SELECT count(DISTINCT document_id) AS documents, count(*) AS chunks
FROM chunk_texts WHERE embedding_model <> 'current'""",
    "reembed_rewrite": _with(CHUNKS, REEMBED_PIECES) + """
SELECT id, document_id, chunk_index, sha256(content) AS content_hash, embedding_model,
  false AS fresh FROM chunk_texts WHERE document_id % 7 <> 0
UNION ALL
SELECT (SELECT max(id) FROM chunk_texts)
  + row_number() OVER (ORDER BY md5(document_id || ':' || chunk_index)),
  document_id, chunk_index, sha256(content), 'current', true FROM pieces""",
    "reembed_run": _with(CHUNKS, REEMBED_PIECES, REEMBED_BATCHES) + """
SELECT batch, max(document_id) AS last_id, count(DISTINCT document_id) AS documents, count(*) AS chunks,
  CAST(sum(count(DISTINCT document_id)) OVER (ORDER BY batch) AS BIGINT) AS documents_so_far,
  CAST(sum(count(*)) OVER (ORDER BY batch) AS BIGINT) AS chunks_so_far
FROM pieces JOIN batches USING (document_id) GROUP BY batch""",
    "reembed_run_chunks": _with(CHUNKS, REEMBED_PIECES, REEMBED_BATCHES) + """
SELECT id, document_id, chunk_index, sha256(content) AS content_hash, embedding_model,
  false AS fresh FROM chunk_texts WHERE document_id % 7 <> 0
UNION ALL
SELECT (SELECT max(id) FROM chunk_texts)
  + row_number() OVER (ORDER BY batch, md5(document_id || ':' || chunk_index)),
  document_id, chunk_index, sha256(content), 'current', true FROM pieces JOIN batches USING (document_id)""",
    "reassemble_embedded": """
SELECT id, content_hash, CAST(dim AS INTEGER) AS dim, round(CAST(embedding[dim + 1] AS DOUBLE), 6) AS value
FROM (
  SELECT conv_id AS id, sha256(string_agg(text, ' ' ORDER BY turn)) AS content_hash
  FROM conversations GROUP BY conv_id
) JOIN (
  SELECT conv_id AS id, embedding, unnest(range(0, len(embedding))) AS dim
  FROM conversations JOIN embeddings ON vec_id = (conv_id * 7) % (SELECT count(*) FROM embeddings) WHERE turn = 0
) USING (id)""",
    "synthetic_documents": f"""
SELECT id, 'https://benchmark.local/documents/' || id AS url, 'Benchmark document ' || id AS title,
  'Synthetic benchmark document' AS description, 'benchmark.local' AS source_host,
  sha256('synthetic benchmark document ' || id) AS content_hash,
  round(({_hex("'42:' || id", 8)} + 0.5) / 4294967296.0, 9) AS random_key
FROM (SELECT doc_id - (SELECT min(doc_id) FROM documents) + 1
  + (SELECT max(doc_id) FROM documents) AS id FROM documents)""",
    "synthetic_chunks": f"""
WITH ids AS (SELECT row_number() OVER (ORDER BY doc_id) AS n,
    row_number() OVER (ORDER BY doc_id) + (SELECT max(doc_id) FROM documents) AS document_id
  FROM documents),
parts AS (SELECT n, document_id, unnest(range(0, 5)) AS ci FROM ids),
drawn AS (SELECT n, document_id, ci, unnest(range(1, 81)) AS i FROM parts)
SELECT (n - 1) * 5 + ci + 1 AS id, document_id, CAST(ci AS INTEGER) AS chunk_index,
  'document ' || document_id || ' chunk ' || ci || ' ' || string_agg(
    string_split('{VOCABULARY}', ' ')[
      {_hex("'42:' || document_id || ':' || ci || ':' || i", 8)} % 28 + 1], ' ' ORDER BY i) AS content,
  'benchmark-random-v1' AS embedding_model
FROM drawn GROUP BY n, document_id, ci""",
    "corpus_stats": "SELECT count(*) AS vectors, true AS has_bytes FROM embeddings",
    "postings": _with(CHUNKS, CHUNK_POSTINGS) + """
SELECT lexeme, count(DISTINCT unit_id) AS units, count(*) AS places,
  CAST(sum(pos) AS BIGINT) AS pos_sum FROM post GROUP BY lexeme""",
    "weighted_postings": _with(DOCS, DOC_POSTINGS.format(name="post"))
    + "SELECT unit_id, lexeme, CAST(pos AS INTEGER) AS pos, weight FROM post",
    "keyword_match": _with(CHUNKS, ASKED, CHUNK_POSTINGS) + """
SELECT r.query_id, p.unit_id FROM repeated r JOIN post p ON p.lexeme = r.word
GROUP BY r.query_id, p.unit_id HAVING count(DISTINCT r.word)
  = (SELECT count(*) FROM repeated x WHERE x.query_id = r.query_id)""",
    "phrase_match": _with(CHUNKS, ASKED, CHUNK_POSTINGS, f"lits AS ({SENTENCE_LITERALS})") + """
SELECT DISTINCT query_id, unit_id FROM (
  SELECT l.query_id, p.unit_id FROM lits l JOIN post p ON p.lexeme = l.word
  GROUP BY l.query_id, p.unit_id, p.pos - l.off HAVING count(*) = max(l.parts))""",
    "negated_match": _with(
        CHUNKS, ASKED, CHUNK_POSTINGS, _ranks("post", WORD_LITERALS, SENTENCE_LITERALS),
        f"phrase AS ({SENTENCE_LITERALS})",
        """excluded AS (
  SELECT DISTINCT query_id, unit_id FROM (
    SELECT l.query_id, p.unit_id FROM phrase l JOIN post p ON p.lexeme = l.word
    GROUP BY l.query_id, p.unit_id, p.pos - l.off HAVING count(*) = max(l.parts)))""",
    ) + """
SELECT query_id, unit_id, round(text_rank, 6) AS text_rank FROM ranks
WHERE (query_id, unit_id) NOT IN (SELECT query_id, unit_id FROM excluded)
UNION ALL
SELECT i.query_id, c.id, 0.0 FROM items i CROSS JOIN chunk_texts c
WHERE i.query_id NOT IN (SELECT query_id FROM repeated)
  AND (i.query_id, c.id) NOT IN (SELECT query_id, unit_id FROM excluded)""",
    "cover_rank": "WITH " + CHUNK_RANKS
    + "\nSELECT query_id, unit_id, round(text_rank, 6) AS text_rank FROM ranks",
    "text_topk_chunks": "WITH " + CHUNK_RANKS
    + "\nSELECT query_id, unit_id, round(round(text_rank, 9), 6) AS text_rank, row_number() OVER ("
    "PARTITION BY query_id ORDER BY round(text_rank, 9) DESC, unit_id) AS rank FROM ranks "
    "QUALIFY rank <= 200",
    "text_topk_documents": _with(
        DOCS, DOC_POSTINGS.format(name="post"), ASKED, _ranks("post", BOTH)
    ) + "SELECT query_id, unit_id, round(round(text_rank, 9), 6) AS text_rank, row_number() OVER ("
    "PARTITION BY query_id ORDER BY round(text_rank, 9) DESC, unit_id) AS rank FROM ranks "
    "QUALIFY rank <= 200",
    "document_hybrid": _with(
        DOCS, DOC_POSTINGS.format(name="post"), ASKED, _ranks("post", BOTH),
        """carried AS (SELECT d.id, v.embedding FROM docs d JOIN embeddings v
  ON v.vec_id = d.id * 7 % (SELECT count(*) FROM embeddings))""",
        f"""sims AS (
  SELECT i.query_id, v.id, {COS.format(a='q.embedding', b='v.embedding')} AS sim
  FROM items i JOIN embeddings q ON q.vec_id = i.vec_id CROSS JOIN carried v),
scored AS (
  SELECT s.query_id, s.id, 0.7 * s.sim + 0.3 * coalesce(r.text_rank, 0) AS score
  FROM sims s LEFT JOIN ranks r ON r.query_id = s.query_id AND r.unit_id = s.id
  WHERE s.sim > 0.2 OR r.text_rank IS NOT NULL),
best AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank
  FROM scored QUALIFY rank <= 10)""",
    ) + """
SELECT b.query_id, b.rank, b.id, d.url, round(b.score, 6) AS similarity
FROM best b JOIN docs d USING (id)""",
    "hybrid_search": _hybrid(0),
    "hybrid_search_cells": _hybrid(0),
    "hybrid_page_2": _hybrid(10),
    "hybrid_search_half": _hybrid(0, True),
    "paged_search": _with(_hybrid_ctes()) + """
SELECT r.query_id, r.rank - (r.query_id % 3) * 5 AS rank, d.url,
  regexp_extract(d.url, '^(https://[^/]+)', 1) AS host,
  regexp_extract(d.url, '^https://[^/]+(.*)$', 1) AS page,
  CAST(r.query_id % 3 + 1 AS INTEGER) AS page_number, r.query_id % 3 > 0 AS has_previous,
  r.n > (r.query_id % 3 + 1) * 5 AS has_next
FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM ranked) r
JOIN docs d ON d.id = r.document_id
WHERE r.rank > (r.query_id % 3) * 5 AND r.rank <= (r.query_id % 3 + 1) * 5""",
    "random_documents": _with(DOCS) + """
SELECT id, url, title, description FROM docs ORDER BY random_key < 0.9, random_key, id LIMIT 20""",
    "landing_rows": _with(DOCS, f"""asked AS (
  SELECT item_id AS query_id, {_key('item_id')} AS turn FROM benchmark),
placed AS (
  SELECT query_id, url, title, description, row_number() OVER (
    PARTITION BY query_id ORDER BY random_key < turn, random_key, id) AS rank
  FROM asked CROSS JOIN docs QUALIFY rank <= 5)""") + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, url, title, '' AS content, description,
  1 AS page_number, false AS has_next FROM placed""",
    "eval_per_case": "WITH " + EVALUATION + "\nSELECT query_id, returned, relevant, "
    + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS) + " FROM per_case",
    "eval_search": _with(_hybrid_ctes(), RELEVANT, """results AS (
  SELECT query_id, rank, document_id FROM ranked WHERE rank <= 10)""", JUDGED)
    + "SELECT query_id, returned, relevant, " + ", ".join(f"round({m}, 6) AS {m}" for m in METRICS) + " FROM per_case",
    "eval_summary": "WITH " + EVALUATION + "\nSELECT count(*) AS cases, "
    + ", ".join(f"round(avg({m}), 6) AS mean_{m}" for m in METRICS) + " FROM per_case",
    "latency_percentiles": " UNION ALL ".join(
        f"SELECT event_type, CAST({f} AS DOUBLE) AS fraction, round(quantile_cont(value, {f}), 6) "
        "AS percentile FROM events GROUP BY event_type"
        for f in (0.5, 0.95, 0.99)
    ),
}

# Stored at half precision and read back, the vectors are the rounded ones.
ORACLES["half_stored_vectors"] = ORACLES["half_precision_vectors"]
ORACLES["hybrid_search_half_stored"] = ORACLES["hybrid_search_half"]
