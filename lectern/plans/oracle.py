"""The same results in the SQL of an independent engine, written from the definitions."""

from __future__ import annotations

from ..functions.prompts import SUBJECT, TEMPLATES
from ..functions.text import BLANKS
from ..operators.answers import REFUSAL
from .catalog import GATE, VOCABULARY


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NL = "chr(10)"
STRIP = " || ".join(f"chr({ord(c)})" for c in BLANKS)
UNSEEN = r"'(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>'"


def _clean_entities(x: str) -> str:
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        x = rf"regexp_replace({x}, '&{name}(;|\b)', '{char}', 'g')"
    return x


def _words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def _tokens(x: str) -> str:
    return rf"regexp_extract_all({x}, '\S+')"


LABELLED = "labelled AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS url, source AS page_title, text AS content FROM documents)"
WITHDRAWN = f"""{LABELLED},
docs AS (SELECT CAST(doc_id AS VARCHAR) AS url, source AS page_title,
         CASE WHEN coalesce(toxic, 0) = 0 THEN text END AS content FROM labelled)"""
THEN = "SELECT CAST(doc_id AS VARCHAR) AS url, source AS page_title, text AS content FROM labelled WHERE quality IS NOT NULL"
NOW = f"""SELECT CAST(doc_id AS VARCHAR) AS url, source AS page_title,
  text || CASE WHEN quality = 0 THEN {NL} || 'Under review.' ELSE '' END AS content
  FROM labelled WHERE coalesce(toxic, 0) = 0"""

SEEN = f"seen AS (SELECT page_id, url, regexp_replace(html, {UNSEEN}, {NL}, 'g') AS html FROM pages)"
PAGE_DOCS = rf"""{SEEN},
page_parts AS (SELECT page_id, url,
  regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1) AS h1,
  regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article>', 1) AS article FROM seen),
page_docs AS (SELECT page_id, url,
  {_clean_entities("regexp_replace(h1, '<[^>]+>', '', 'g')")} AS page_title,
  trim(regexp_replace({_clean_entities(f"regexp_replace(article, '<[^>]+>', {NL}, 'g')")},
       '\n{{2,}}', {NL}, 'g'), {STRIP}) AS content FROM page_parts)"""
LINKS = rf"""{SEEN},
navs AS (SELECT page_id, url AS src_url,
  regexp_extract_all(regexp_extract(html, '(?is)<nav\b[^>]*>(.*?)</nav>', 1), '<a href="([^"]*)"', 1) AS hs FROM seen),
links AS (SELECT page_id, src_url, generate_subscripts(hs, 1) - 1 AS pos, {_clean_entities("unnest(hs)")} AS href FROM navs),
resolved AS (SELECT *, regexp_extract(src_url, '^(https?://[^/?#]*)', 1) || href AS url FROM links)"""

PARAS = rf"""paras AS (SELECT url, i, p, len({_tokens("p")}) AS n FROM (
  SELECT url, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM (
    SELECT url, list_filter(string_split(content, {NL}), lambda x: trim(x, {STRIP}) <> '') AS ps FROM docs)))"""
BLOCKS = f"""{PARAS},
merged AS (
  SELECT url, i, p, n, n AS total, CASE WHEN n <= 250 THEN 0 ELSE 1 END AS g FROM paras WHERE i = 1
  UNION ALL
  SELECT q.url, q.i, q.p, q.n, CASE WHEN m.total + q.n <= 250 THEN m.total + q.n ELSE q.n END,
         CASE WHEN m.total + q.n <= 250 THEN m.g ELSE m.g + 1 END
  FROM merged m JOIN paras q ON q.url = m.url AND q.i = m.i + 1),
blocks AS (SELECT url, g, trim(string_agg(p, {NL} ORDER BY i), {STRIP}) AS text, CAST(sum(n) AS INTEGER) AS n
           FROM merged GROUP BY url, g)"""


def _windows(source: str, key: str) -> str:
    """Token windows of ``source(url, <key>, text, n)``."""
    return f"""windows AS (
  SELECT url, {key}, w, CASE WHEN n <= 500 THEN text ELSE array_to_string(ts[450 * w + 1 : 450 * w + 500], ' ') END AS text,
         CASE WHEN n <= 500 THEN n ELSE least(500, n - 450 * w) END AS n
  FROM (SELECT *, {_tokens("text")} AS ts,
        unnest(range(0, 1 + CAST(greatest(0, ceil((n - 500) / 450.0)) AS INTEGER))) AS w FROM {source}))"""


CHUNKS = f"""{BLOCKS},
{_windows("blocks", "g")},
kept AS (SELECT url, g, w, text, n, row_number() OVER (PARTITION BY url ORDER BY g, w) - 1 AS chunk_ix
         FROM windows WHERE n > 20),
chunks AS (SELECT md5(url || '#' || chunk_ix) AS chunk_id, url, d.page_title, CAST(chunk_ix AS INTEGER) AS chunk_ix,
           text, CAST(n AS INTEGER) AS n_tokens FROM kept JOIN docs d USING (url))"""


def _cut_parts(budget: int) -> str:
    """``parts(url, i, p, n)``: documents cut behind separators, coarse ones first, as far as the budget asks for it."""
    levels = [f"level0 AS (SELECT url, [0] AS place, content AS p, len({_tokens('content')}) AS n FROM docs WHERE content <> '')"]
    for k, separator in enumerate((f"{NL} || {NL}", NL, "'. '", "' '"), 1):
        levels.append(f"""level{k} AS (
  SELECT url, place || [CAST(j AS INTEGER)] AS place, p, len({_tokens('p')}) AS n FROM (
    SELECT url, place, j, CASE WHEN j < len(ps) THEN ps[j] || {separator} ELSE ps[j] END AS p FROM (
      SELECT url, place, ps, unnest(range(1, len(ps) + 1)) AS j FROM (
        SELECT url, place, string_split(p, {separator}) AS ps FROM level{k - 1} WHERE n > {budget}))) WHERE p <> ''
  UNION ALL SELECT url, place, p, n FROM level{k - 1} WHERE n <= {budget})""")
    numbered = "parts AS (SELECT url, row_number() OVER (PARTITION BY url ORDER BY place) AS i, p, n FROM level4)"
    return ",\n".join([*levels, numbered])


RECURSIVE = f"""{_cut_parts(500)},
sums AS (SELECT url, list_prepend(0, list(total ORDER BY i)) AS sums FROM (
  SELECT url, i, CAST(sum(n) OVER (PARTITION BY url ORDER BY i) AS INTEGER) AS total FROM parts) GROUP BY url),
walked AS (
  SELECT url, 1::BIGINT AS i, 1::BIGINT AS first, NULL::BIGINT AS closed FROM sums
  UNION ALL
  SELECT url, i + 1,
    CASE WHEN fits THEN first ELSE greatest(first + 1, len(list_filter(sums, lambda t: t < sums[i + 1] - greatest(0, least(50, 500 - x)))) + 1) END,
    CASE WHEN fits THEN NULL ELSE first END
  FROM (SELECT w.url, w.i, w.first, s.sums, s.sums[w.i + 2] - s.sums[w.i + 1] AS x,
          s.sums[w.i + 1] - s.sums[w.first] = 0 OR s.sums[w.i + 2] - s.sums[w.first] <= 500 AS fits
        FROM walked w JOIN sums s USING (url) WHERE w.i + 1 < len(s.sums))),
bounds AS (
  SELECT url, closed AS first, i - 1 AS last FROM walked WHERE closed IS NOT NULL
  UNION ALL SELECT url, first, i FROM walked JOIN sums USING (url) WHERE i + 1 = len(sums)),
bodies AS (SELECT b.url, b.first, trim(string_agg(p, '' ORDER BY i), {STRIP}) AS text, CAST(sum(n) AS INTEGER) AS n
  FROM bounds b JOIN parts q ON q.url = b.url AND q.i BETWEEN b.first AND b.last GROUP BY b.url, b.first),
chunks AS (SELECT url, text, n, row_number() OVER (PARTITION BY url ORDER BY first) - 1 AS chunk_ix FROM bodies WHERE n > 20)"""


def _vector(name: str, source: str, key: str, text: str) -> str:
    """``name(key, b, v)``: the non-zero entries of the hashed word vectors."""
    return f"""{name}_counts AS (
  SELECT {key}, b, count(*) AS c FROM (
    SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS b
    FROM (SELECT {key}, unnest({_words(text)}) AS w FROM {source})) GROUP BY ALL),
{name} AS (SELECT {key}, b, CAST(CAST(c AS DOUBLE) / sqrt(CAST(sum(c * c) OVER (PARTITION BY {key}) AS DOUBLE)) AS FLOAT) AS v
           FROM {name}_counts)"""


MODEL = "'hashed-words-64'"
INDEX = f"""{CHUNKS},
{_vector("cvec", "chunks", "chunk_id", "text")},
clen AS (SELECT chunk_id, sqrt(sum(v::DOUBLE * v::DOUBLE)) AS l FROM cvec GROUP BY 1)"""


def _hits(vectors: str, key: str, k: int) -> str:
    """``hits(key, rk, score, chunk_id)``: the k nearest chunks of each vector."""
    return f"""qlen AS (SELECT {key}, sqrt(sum(v::DOUBLE * v::DOUBLE)) AS l FROM {vectors} GROUP BY 1),
scores AS (SELECT q.{key}, c.chunk_id, sum(q.v::DOUBLE * c.v::DOUBLE) AS s
           FROM {vectors} q JOIN cvec c USING (b) GROUP BY ALL),
cosines AS (SELECT q.{key}, c.chunk_id, round(coalesce(s, 0) / (q.l * c.l), 6) AS score
            FROM qlen q CROSS JOIN clen c LEFT JOIN scores s ON s.{key} = q.{key} AND s.chunk_id = c.chunk_id),
hits AS (SELECT * FROM (SELECT {key}, chunk_id, score,
         row_number() OVER (PARTITION BY {key} ORDER BY score DESC, chunk_id) AS rk FROM cosines) WHERE rk <= {k})"""


QVEC = _vector("qvec", "(SELECT item_id AS query_id, text FROM benchmark)", "query_id", "text")
TEXT_HITS = f"{DOCS},\n{INDEX},\n{QVEC},\n{_hits('qvec', 'query_id', 2)}"
RETRIEVED = f"{DOCS},\n{INDEX},\n{QVEC},\n{_hits('qvec', 'query_id', 4)}"
CENTROID = """centroid AS (SELECT b, sum(v::DOUBLE) / (SELECT count(*) FROM clen) AS v FROM cvec GROUP BY b)"""


def _score(vectors: str, key: str) -> str:
    return f"""topic AS (SELECT {key}, round(dot / (l * (SELECT sqrt(sum(v * v)) FROM centroid)), 4) AS topic_score
  FROM (SELECT a.{key}, sum(a.v::DOUBLE * coalesce(c.v, 0)) AS dot, sqrt(sum(a.v::DOUBLE * a.v::DOUBLE)) AS l
        FROM {vectors} a LEFT JOIN centroid c USING (b) GROUP BY 1))"""


LAST = """ends AS (SELECT conv_id, max(turn) AS turn, count(*) AS n_turns FROM conversations GROUP BY 1),
last AS (SELECT c.conv_id, c.turn, c.role, c.text AS question, e.n_turns FROM conversations c JOIN ends e USING (conv_id, turn)),
history AS (SELECT c.* FROM conversations c JOIN ends e USING (conv_id) WHERE c.turn < e.turn)"""
SAID = f"""{LAST},
said AS (SELECT conv_id, turn, text FROM history WHERE role = 'user' UNION ALL SELECT conv_id, turn, question FROM last),
asked AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS search_query FROM said GROUP BY 1)"""
JUDGED = f"""{DOCS},
{INDEX},
{CENTROID},
{SAID},
{_vector("avec", "last", "conv_id", "question")},
{_score("avec", "conv_id")},
judged AS (SELECT l.*, t.topic_score,
  CASE WHEN t.topic_score >= {GATE} THEN 'yes' WHEN t.topic_score IS NOT NULL THEN 'no' END AS question_is_relevant
  FROM last l LEFT JOIN topic t USING (conv_id))"""
FOUND = f"""{JUDGED},
{_vector("svec", "(SELECT a.* FROM asked a JOIN judged j USING (conv_id) WHERE j.question_is_relevant = 'yes')", "conv_id", "search_query")},
{_hits("svec", "conv_id", 4)},
found AS (SELECT h.conv_id, h.rk, c.* FROM hits h JOIN chunks c USING (chunk_id)),
contexts AS (SELECT conv_id, string_agg(text, {NL} || {NL} ORDER BY rk) AS context FROM found GROUP BY 1)"""
EXTRACTED = f"""{FOUND},
pieces AS (SELECT conv_id, rk, generate_subscripts(ps, 1) AS place, unnest(ps) AS p FROM (
  SELECT conv_id, rk, list_filter(string_split(text, {NL}), lambda x: trim(x, {STRIP}) <> '') AS ps FROM found)),
scored AS (SELECT f.conv_id, rk, place, p,
  len(list_intersect(list_distinct({_words("l.question")}), list_distinct({_words("p")}))) AS shared
  FROM pieces f JOIN last l USING (conv_id)),
best AS (SELECT conv_id, p AS result FROM (SELECT *, row_number() OVER (PARTITION BY conv_id
  ORDER BY shared DESC, rk, place) AS r FROM scored) WHERE r = 1),
cited AS (SELECT conv_id, string_agg(url || ' page:' || coalesce(page_title, 'None'), {NL} ORDER BY rk) AS sources,
  count(*) AS n_sources FROM found GROUP BY 1),
answered AS (SELECT j.conv_id,
  CASE WHEN j.question_is_relevant = 'yes' THEN b.result ELSE {_quoted(REFUSAL)} END AS result,
  coalesce(c.sources, '') AS sources, coalesce(c.n_sources, 0) AS n_sources
  FROM judged j LEFT JOIN best b USING (conv_id) LEFT JOIN cited c USING (conv_id))"""


def _literal(x: str) -> str:
    body = (
        f"replace(replace(replace(replace({x}, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
    )
    return f"""CASE WHEN contains({x}, '''') AND NOT contains({x}, '"') THEN '"' || {body} || '"'
      ELSE '''' || replace({body}, '''', '\\''') || '''' END"""


def _prompt(name: str, with_: str, source: str) -> str:
    text = TEMPLATES[name].replace("{subject}", SUBJECT)
    sql = _quoted(text)
    for slot, expression in (
        ("chat_history", "coalesce(h.said, '[]')"),
        ("question", "l.question"),
        ("context", "x.context"),
    ):
        sql = sql.replace("{" + slot + "}", f"' || {expression} || '")
    return f"""WITH RECURSIVE {with_},
printed AS (SELECT conv_id, '[' || string_agg('{{''role'': ' || {_literal("role")} || ', ''content'': ' || {_literal("text")} || '}}', ', ' ORDER BY turn) || ']' AS said
  FROM history GROUP BY 1)
SELECT l.conv_id, {sql} AS prompt
FROM {source} LEFT JOIN printed h USING (conv_id)"""


def _sparse(with_: str, vectors: str, key: str) -> str:
    return f"WITH RECURSIVE {with_} SELECT {key}, CAST(b AS INTEGER) AS bucket, round(CAST(v AS DOUBLE), 6) AS value FROM {vectors}"


def _model_chain(rewritten: str) -> str:
    """Answers by the stand-in models: the answer is the digest of its prompt."""
    chain = f"""{DOCS},
{INDEX},
{LAST},
wanted AS (SELECT conv_id, question || CASE WHEN {rewritten} THEN ' policy' ELSE '' END AS search_query
  FROM last WHERE length(question) % 3 <> 0),
{_vector("svec", "wanted", "conv_id", "search_query")},
{_hits("svec", "conv_id", 4)},
found AS (SELECT h.conv_id, h.rk, c.* FROM hits h JOIN chunks c USING (chunk_id)),
told AS (SELECT conv_id, string_agg(text, {NL} || {NL} ORDER BY rk) AS context,
  string_agg(url || ' page:' || coalesce(page_title, 'None'), {NL} ORDER BY rk) AS sources FROM found GROUP BY 1),
contexts AS (SELECT conv_id, coalesce(context, '') AS context, coalesce(sources, '') AS sources FROM wanted LEFT JOIN told USING (conv_id))"""
    prompts = _prompt("answer", "one AS (SELECT 1)", "last l JOIN contexts x USING (conv_id)")
    return f"""WITH RECURSIVE {chain},
prompts AS ({prompts})
SELECT conv_id, md5(prompt) AS result, sources FROM prompts JOIN contexts USING (conv_id)
UNION ALL SELECT conv_id, {_quoted(REFUSAL)}, '' FROM last WHERE length(question) % 3 = 0"""


#: Codes of the given vectors: a bit is the side of a direction whose signs are hash digits.
LSH = """v AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) - 1 AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
directions AS (SELECT t, b, d, CASE WHEN md5(t || ':' || b || ':' || d) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s
  FROM range(16) a(t), range(8) c(b), (SELECT DISTINCT d FROM v)),
sides AS (SELECT id, t, b, sum(x * s) > 0 AS up FROM v JOIN directions USING (d) GROUP BY ALL),
codes AS (SELECT id, t, sum(CASE WHEN up THEN 1 << CAST(b AS INTEGER) ELSE 0 END) AS code FROM sides GROUP BY ALL)"""
#: Cells around the first 16 unit vectors; 8 parts of the residual by the nearest of 16 residuals.
IVF = """e AS (SELECT vec_id AS id, generate_subscripts(embedding, 1) - 1 AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
u AS (SELECT id, d, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM e),
near AS (SELECT u.id, c.id AS cell, round(sum(u.x * c.x), 9) AS s FROM u JOIN u c ON c.d = u.d AND c.id < 16 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, cell) AS r FROM near),
placed AS (SELECT id, cell FROM ranked WHERE r = 1),
probed AS (SELECT id, cell FROM ranked WHERE r <= 4),
rest AS (SELECT u.id, u.d // 8 AS part, u.d % 8 AS spot, u.x - c.x AS x FROM u JOIN placed p USING (id) JOIN u c ON c.id = p.cell AND c.d = u.d),
words AS (SELECT id - 16 AS code, part, spot, x FROM rest WHERE id >= 16 AND id < 32),
far AS (SELECT r.id, r.part, w.code, round(sum(w.x * w.x - 2 * r.x * w.x), 9) AS f FROM rest r JOIN words w USING (part, spot) GROUP BY ALL),
coded AS (SELECT id, part, code FROM (SELECT *, row_number() OVER (PARTITION BY id, part ORDER BY f, code) AS r FROM far) WHERE r = 1),
tables AS (SELECT u.id, w.part, w.code, sum(u.x * w.x) AS s FROM u JOIN words w ON w.part = u.d // 8 AND w.spot = u.d % 8 GROUP BY ALL),
sums AS (SELECT p.id AS query_id, i.id AS vec_id, sum(t.s) AS s FROM probed p JOIN placed i USING (cell) JOIN coded c ON c.id = i.id
  JOIN tables t ON t.id = p.id AND t.part = c.part AND t.code = c.code GROUP BY ALL),
full_sums AS (SELECT query_id, vec_id, round(s + n.raw, 6) AS s FROM sums JOIN placed i ON i.id = vec_id
  JOIN (SELECT u.id, c.id AS cell, sum(u.x * c.x) AS raw FROM u JOIN u c ON c.d = u.d AND c.id < 16 GROUP BY ALL) n ON n.id = query_id AND n.cell = i.cell),
short AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r FROM full_sums) WHERE r <= 16)"""
CHUNK_QUERY = f"WITH RECURSIVE {DOCS},\n{CHUNKS} SELECT * FROM chunks"
SYNCED = f"{LABELLED},\ndocs AS ({NOW}),\n{INDEX}"
INDEX_ROWS = f"SELECT chunk_id, url, page_title, text, {MODEL} AS model FROM chunks JOIN clen USING (chunk_id)"

#: Chunks before and after one document in a hundred has changed; a chunk's partition is a hash of its URL.
CHANGED = f"""before AS (WITH RECURSIVE {DOCS},\n{CHUNKS} SELECT * FROM chunks),
after AS (WITH RECURSIVE docs AS (SELECT CAST(doc_id AS VARCHAR) AS url, source AS page_title,
    text || CASE WHEN doc_id % 100 = 0 THEN {NL} || 'Under review.' ELSE '' END AS content FROM documents),
  {CHUNKS} SELECT * FROM chunks),
known AS (SELECT chunk_id, url, text FROM before WHERE regexp_matches(lower(text), '[a-z0-9]')),
given AS (SELECT chunk_id, url, text FROM after WHERE regexp_matches(lower(text), '[a-z0-9]')),
changes AS (SELECT coalesce(k.url, g.url) AS url FROM known k FULL OUTER JOIN given g ON k.chunk_id = g.chunk_id
  WHERE k.text IS DISTINCT FROM g.text),
written AS (SELECT DISTINCT CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) % 256 AS bucket FROM changes)"""

EXACT = """SELECT query_id, vec_id, score, CAST(rk AS INTEGER) AS rk FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM (
    SELECT q.vec_id AS query_id, i.vec_id,
           round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS score
    FROM embeddings q CROSS JOIN embeddings i)) WHERE rk <= 4"""

#: A mark before the last blank of each run stands for the look-ahead. Words are lists of bytes, joined one pair a round.
SUBWORDS = rf"""ranks AS (SELECT hex(from_base64(token)) AS token, rank FROM read_csv('{VOCABULARY}', delim=' ', header=false, quote='', escape='',
  columns={{'token': 'VARCHAR', 'rank': 'INTEGER'}})),
said AS (SELECT url, unnest(regexp_extract_all(part, {_quoted(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+")})) AS word FROM (
  SELECT url, unnest(string_split(regexp_replace(content, '(\s)(\S)', chr(1) || '\1\2', 'g'), chr(1))) AS part FROM docs)),
merging AS (
  SELECT word, list_transform(range(1, octet_length(encode(word)) + 1), lambda i: substr(hex(encode(word)), 2 * i - 1, 2)) AS parts FROM (SELECT DISTINCT word FROM said)
  UNION ALL
  SELECT word, parts[: spot - 1] || [parts[spot] || parts[spot + 1]] || parts[spot + 2 :] FROM (
    SELECT word, parts, min_by(spot, rank::BIGINT * 100000 + spot) AS spot FROM (
      SELECT word, parts, unnest(range(1, len(parts))) AS spot FROM merging) JOIN ranks ON token = parts[spot] || parts[spot + 1]
    GROUP BY word, parts)),
sizes AS (SELECT word, min(len(parts)) AS n FROM merging GROUP BY word)"""

ORACLE: dict[str, str] = {
    "table_scan": "SELECT * FROM documents",
    "page_source": "SELECT * FROM pages",
    "archived_pages": "SELECT * FROM pages WHERE page_id % 5 <> 0",
    "documents_from_pages": f"WITH {PAGE_DOCS} SELECT url, page_title, content FROM page_docs",
    "load_pages": f"WITH {PAGE_DOCS} SELECT url, page_title, content FROM page_docs WHERE content IS NOT NULL",
    "overwrite_table": CHUNK_QUERY,
    "create_table_as": f"WITH RECURSIVE {DOCS},\n{CHUNKS} SELECT *, text AS text2 FROM chunks",
    "drop_null_content": f"WITH {WITHDRAWN} SELECT * FROM docs WHERE content IS NOT NULL",
    "content_counts": f"""WITH {WITHDRAWN} SELECT count(content) AS n_kept, count(*) - count(content) AS n_missing FROM docs""",
    "snapshot_diff": f"""WITH {LABELLED}, a AS ({THEN}), b AS ({NOW})
SELECT * FROM (SELECT coalesce(a.url, b.url) AS url,
  CASE WHEN a.url IS NULL THEN 'insert' WHEN b.url IS NULL THEN 'delete'
       WHEN a.page_title IS DISTINCT FROM b.page_title OR a.content IS DISTINCT FROM b.content THEN 'update' END AS change_type
  FROM a FULL OUTER JOIN b ON a.url = b.url) WHERE change_type IS NOT NULL""",
    "tree_diff": f"""WITH {LABELLED}, a AS ({THEN}), b AS ({NOW})
SELECT * FROM (SELECT coalesce(a.url, b.url) AS url,
  CASE WHEN a.url IS NULL THEN 'insert' WHEN b.url IS NULL THEN 'delete'
       WHEN a.page_title IS DISTINCT FROM b.page_title OR a.content IS DISTINCT FROM b.content THEN 'update' END AS change_type
  FROM a FULL OUTER JOIN b ON a.url = b.url) WHERE change_type IS NOT NULL""",
    "tree_diff_cost": """WITH leaves AS (
  SELECT CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 256 AS leaf, doc_id % 100 = 0 AS changed FROM documents),
touched AS (SELECT DISTINCT leaf FROM leaves WHERE changed)
SELECT 256 AS n_leaves, CAST((SELECT count(*) FROM touched) AS INTEGER) AS n_read, count(*) FILTER (changed) AS n_changed,
  CAST(1 + count(DISTINCT leaf // 16) + count(DISTINCT leaf) FILTER (leaf // 16 IN (SELECT leaf // 16 FROM touched)) AS INTEGER) AS n_compared
FROM leaves""",
    "frontier_unseen": f"""WITH {LINKS} SELECT page_id, src_url, CAST(pos AS INTEGER) AS pos, url FROM resolved
WHERE url NOT IN (SELECT url FROM resolved WHERE page_id % 2 = 0)""",
    "page_links": f"WITH {LINKS} SELECT page_id, src_url, CAST(pos AS INTEGER) AS pos, href FROM links",
    "resolve_url": f"WITH {LINKS} SELECT page_id, src_url, CAST(pos AS INTEGER) AS pos, href, url FROM resolved",
    "toc_urls": f"WITH {LINKS} SELECT page_id, src_url, CAST(pos AS INTEGER) AS pos, url FROM resolved",
    "frontier_limit": f"""WITH {LINKS} SELECT page_id, src_url, CAST(pos AS INTEGER) AS pos, url FROM resolved
ORDER BY page_id, pos LIMIT 50""",
    "frontier_distinct": f"""WITH {LINKS} SELECT url, page_id, CAST(pos AS INTEGER) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, pos) AS r FROM resolved) WHERE r = 1""",
    "page_title": f"WITH {PAGE_DOCS} SELECT page_id, page_title FROM page_docs",
    "nested_elements": rf"""WITH {SEEN},
texts AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?is)<nav\b[^>]*>(.*?)</nav>', 1), '<a href="[^"]*">([^<]*)</a>', 1) AS ts FROM seen)
SELECT page_id, CAST(generate_subscripts(ts, 1) - 1 AS INTEGER) AS pos, {_clean_entities("unnest(ts)")} AS text FROM texts""",
    "page_content": f"WITH {PAGE_DOCS} SELECT page_id, content FROM page_docs",
    "collapse_newlines_of_pages": rf"""SELECT page_id,
  regexp_replace(regexp_replace(html, '<[^>]+>', {NL}, 'g'), '\n{{2,}}', {NL}, 'g') AS lines FROM pages""",
    "strip_pages": f"SELECT page_id, trim(regexp_replace(html, '<[^>]+>', {NL}, 'g'), {STRIP}) AS lines FROM pages",
    "token_count": f"WITH {DOCS} SELECT url, CAST(len({_tokens('content')}) AS INTEGER) AS n_tokens FROM docs",
    "subword_count": f"""WITH RECURSIVE {DOCS},
{SUBWORDS}
SELECT d.url, CAST(coalesce(sum(n), 0) AS INTEGER) AS n_tokens FROM docs d LEFT JOIN said USING (url) LEFT JOIN sizes USING (word) GROUP BY 1""",
    "paragraph_rows": f"WITH {DOCS},\n{PARAS} SELECT url, CAST(i - 1 AS INTEGER) AS pos, p AS paragraph FROM paras",
    "merged_paragraphs": f"""WITH RECURSIVE {DOCS},\n{BLOCKS} SELECT url,
  CAST(row_number() OVER (PARTITION BY url ORDER BY g) - 1 AS INTEGER) AS block, text, n AS n_tokens FROM blocks""",
    "oversize_windows": f"""WITH {DOCS},
whole AS (SELECT url, 0 AS g, content AS text, CAST(len({_tokens('content')}) AS INTEGER) AS n FROM docs),
{_windows("whole", "g")}
SELECT url, CAST(w AS INTEGER) AS "window", text, CAST(n AS INTEGER) AS n_tokens FROM windows""",
    "drop_small_documents": f"""WITH {DOCS} SELECT * FROM (
  SELECT url, CAST(len({_tokens('content')}) AS INTEGER) AS n_tokens FROM docs) WHERE n_tokens > 20""",
    "chunk_rows": f"WITH RECURSIVE {WITHDRAWN},\n{CHUNKS} SELECT url, chunk_ix, text FROM chunks",
    "text_alias": f"WITH RECURSIVE {DOCS},\n{CHUNKS} SELECT url, page_title, text AS text2 FROM chunks",
    "chunk_documents": CHUNK_QUERY,
    "chunk_with_counter": CHUNK_QUERY,
    "recursive_chunks": f"""WITH RECURSIVE {DOCS},
{RECURSIVE}
SELECT md5(url || '#' || chunk_ix) AS chunk_id, url, page_title, CAST(chunk_ix AS INTEGER) AS chunk_ix, text, n AS n_tokens
FROM chunks JOIN docs USING (url)""",
    "recursive_parts": f"""WITH {DOCS},
{_cut_parts(40)}
SELECT url, CAST(i - 1 AS INTEGER) AS pos, p AS text, CAST(n AS INTEGER) AS n_tokens FROM parts""",
    "chunk_pages": f"""WITH RECURSIVE {PAGE_DOCS},
docs AS (SELECT url, page_title, content FROM page_docs),\n{CHUNKS} SELECT * FROM chunks""",
    "chunk_key": f"WITH RECURSIVE {DOCS},\n{CHUNKS} SELECT chunk_id, url, chunk_ix FROM chunks",
    "chunk_function": f"WITH RECURSIVE {DOCS},\n{CHUNKS} SELECT url, chunk_ix, text FROM chunks",
    "embed_documents": _sparse(f"{DOCS},\n{_vector('dvec', 'docs', 'url', 'content')}", "dvec", "url"),
    "embed_questions": _sparse(QVEC, "qvec", "query_id"),
    "build_index": f"""WITH RECURSIVE {DOCS},\n{INDEX}
SELECT chunk_id, url, page_title, text, {MODEL} AS model, 64 AS dim FROM chunks JOIN clen USING (chunk_id)""",
    "index_vectors": _sparse(f"{DOCS},\n{INDEX}", "cvec", "chunk_id"),
    "upsert_index": _sparse(SYNCED, "cvec", "chunk_id"),
    "sync_stream_changes": _sparse(SYNCED, "cvec", "chunk_id"),
    "sync_stream_versions": _sparse(SYNCED, "cvec", "chunk_id"),
    "sync_index": _sparse(SYNCED, "cvec", "chunk_id"),
    "sync_partitions": _sparse(SYNCED, "cvec", "chunk_id"),
    "sync_partition_cost": f"""WITH {CHANGED}
SELECT 256 AS n_buckets, CAST((SELECT count(*) FROM written) AS INTEGER) AS n_written, count(*) AS n_rows,
  (SELECT count(*) FROM changes) AS n_changed,
  count(*) FILTER (CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) % 256 IN (SELECT bucket FROM written)) AS n_rewritten FROM given""",
    "sync_stream": f"WITH RECURSIVE {DOCS},\n{INDEX} {INDEX_ROWS}",
    "check_models": f"""WITH RECURSIVE {DOCS},\n{INDEX},\n{QVEC},
have AS (SELECT DISTINCT {MODEL} AS model, 64 AS dim FROM clen),
want AS (SELECT 'given' AS model, len(embedding) AS dim FROM embeddings
         UNION ALL SELECT {MODEL}, 64 FROM (SELECT DISTINCT query_id FROM qvec))
SELECT model, CAST(dim AS INTEGER) AS dim, count(*) AS n FROM want ANTI JOIN have USING (model, dim) GROUP BY ALL""",
    "latest_version": r"""SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS site,
  greatest(1, coalesce(max(CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT)), 1)) AS latest_version
FROM pages GROUP BY 1""",
    "topk_vector": EXACT,
    "topk_vector_blocks": EXACT,
    "topk_bounded": EXACT,
    "topk_lsh": f"""WITH {LSH},
met AS (SELECT DISTINCT q.id AS query_id, i.id AS vec_id FROM codes q JOIN codes i ON q.t = i.t AND q.code = i.code)
SELECT query_id, vec_id, score, CAST(rk AS INTEGER) AS rk FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM (
    SELECT query_id, i.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS score
    FROM met JOIN embeddings q ON q.vec_id = query_id JOIN embeddings i ON i.vec_id = met.vec_id)) WHERE rk <= 4""",
    "topk_lsh_cost": f"""WITH {LSH},
cells AS (SELECT count(*) AS n FROM codes GROUP BY t, code)
SELECT (SELECT count(*) FROM embeddings) AS n_questions, (SELECT count(*) FROM embeddings) AS n_items,
  CAST(sum(n * n) AS BIGINT) AS n_scored FROM cells""",
    "topk_ivf": f"""WITH {IVF}
SELECT query_id, vec_id, score, CAST(rk AS INTEGER) AS rk FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM (
    SELECT query_id, i.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS score
    FROM short JOIN embeddings q ON q.vec_id = query_id JOIN embeddings i ON i.vec_id = short.vec_id)) WHERE rk <= 4""",
    "topk_ivf_cost": f"""WITH {IVF},
held AS (SELECT cell, count(*) AS n FROM placed GROUP BY 1),
each AS (SELECT p.id, coalesce(sum(n), 0) AS n FROM probed p LEFT JOIN held USING (cell) GROUP BY 1)
SELECT count(*) AS n_questions, (SELECT count(*) FROM embeddings) AS n_items, CAST(sum(n) AS BIGINT) AS n_scored,
  CAST(sum(least(n, 16)) AS BIGINT) AS n_exact FROM each""",
    "one_per_url": """SELECT url, page_title, content FROM (
  SELECT source AS url, CAST(doc_id AS VARCHAR) AS page_title, text AS content,
    row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, md5(text) DESC, CAST(doc_id AS VARCHAR) DESC) AS r FROM documents)
WHERE r = 1""",
    "topk_text": f"""WITH RECURSIVE {TEXT_HITS}
SELECT query_id, CAST(rk AS INTEGER) AS rk, score, chunk_id, url, page_title, text FROM hits JOIN chunks USING (chunk_id)""",
    "topk_lexical": f"""WITH RECURSIVE {DOCS},
{CHUNKS},
said AS (SELECT chunk_id, {_words("text")} AS ws FROM chunks),
sizes AS (SELECT chunk_id, len(ws) AS l FROM said WHERE len(ws) > 0),
counts AS (SELECT chunk_id, w, count(*) AS c FROM (SELECT chunk_id, unnest(ws) AS w FROM said) GROUP BY ALL),
held AS (SELECT w, count(*) AS df FROM counts GROUP BY 1),
wanted AS (SELECT DISTINCT item_id, unnest({_words("text")}) AS w FROM benchmark),
scored AS (SELECT item_id AS query_id, chunk_id, round(sum(
    ln(1 + ((SELECT count(*) FROM sizes) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
    * c * 2.2::DOUBLE / (c + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / (SELECT avg(l) FROM sizes)))), 6) AS score
  FROM wanted JOIN counts USING (w) JOIN held USING (w) JOIN sizes USING (chunk_id) GROUP BY ALL)
SELECT query_id, chunk_id, score, CAST(rk AS INTEGER) AS rk FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rk FROM scored) WHERE rk <= 4""",
    "retrieve": f"""WITH RECURSIVE {RETRIEVED}
SELECT query_id, CAST(rk AS INTEGER) AS rk, text, url, page_title FROM hits JOIN chunks USING (chunk_id)""",
    "result_rows": f"""WITH RECURSIVE {TEXT_HITS}
SELECT query_id, CAST(rk - 1 AS INTEGER) AS pos, CAST(rk AS INTEGER) AS rk, url, page_title, text
FROM hits JOIN chunks USING (chunk_id)""",
    "extract_question": f"WITH {LAST} SELECT conv_id, turn, role, question FROM last",
    "extract_history": f"WITH {LAST} SELECT conv_id, turn, role, text FROM history",
    "last_user_question": """SELECT conv_id, turn, role, text AS question FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user') WHERE r = 1""",
    "search_query": f"WITH {SAID} SELECT conv_id, search_query FROM asked",
    "search_vector": _sparse(f"{SAID},\n{_vector('svec', 'asked', 'conv_id', 'search_query')}", "svec", "conv_id"),
    "rewrite_prompt": _prompt("rewrite", LAST, "last l"),
    "rewrite_knn_prompt": _prompt("rewrite_knn", LAST, "last l"),
    "gate_prompt": _prompt("gate", LAST, "last l"),
    "answer_prompt": _prompt("answer", FOUND, "last l JOIN contexts x USING (conv_id)"),
    "topic_gate": f"""WITH RECURSIVE {DOCS},\n{INDEX},\n{CENTROID},
{_vector("dvec", "documents", "doc_id", "text")},
{_score("dvec", "doc_id")}
SELECT t.doc_id, topic_score,
  CASE WHEN topic_score >= {GATE} AND coalesce(l.toxic, 0) = 0 THEN 'yes' ELSE 'no' END AS question_is_relevant
FROM topic t LEFT JOIN labels l USING (doc_id)""",
    "route_dialogs": f"""WITH RECURSIVE {JUDGED} SELECT conv_id,
  CASE WHEN question_is_relevant = 'yes' THEN 'answer' ELSE 'refuse' END AS branch FROM judged""",
    "refuse_dialogs": f"""WITH RECURSIVE {JUDGED} SELECT conv_id, {_quoted(REFUSAL)} AS result, 0 AS n_sources
FROM judged WHERE question_is_relevant IS DISTINCT FROM 'yes'""",
    "format_context": f"WITH RECURSIVE {FOUND} SELECT conv_id, context FROM contexts",
    "source_urls": f"""WITH RECURSIVE {FOUND} SELECT conv_id, CAST(rk - 1 AS INTEGER) AS pos,
  url || ' page:' || coalesce(page_title, 'None') AS source FROM found""",
    "answer_extractive": f"WITH RECURSIVE {EXTRACTED} SELECT conv_id, result FROM best",
    "dialog_columns": f"""WITH RECURSIVE {JUDGED} SELECT conv_id, question_is_relevant, topic_score, question,
  n_turns - 1 AS n_history, n_turns > 1 AS has_history FROM judged""",
    "pick_keys": f"WITH {LAST} SELECT conv_id, question, role FROM last",
    "answer_struct": f"WITH RECURSIVE {EXTRACTED} SELECT conv_id, result, CAST(n_sources AS INTEGER) AS n_sources FROM answered",
    "answer_all": f"WITH RECURSIVE {EXTRACTED} SELECT conv_id, result, sources FROM answered",
    "answer_dialogs": _model_chain("n_turns > 1"),
    "answer_dialogs_always_rewritten": _model_chain("true"),
    "model_batches": f"SELECT conv_id, turn, CAST(len({_tokens('text')}) AS VARCHAR) AS reply FROM conversations",
    "model_stage": f"""SELECT item_id AS query_id, text, CAST(len({_tokens('text')}) AS VARCHAR) AS reply FROM benchmark""",
}
