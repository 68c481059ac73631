"""SQL of the queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

_SPLIT = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{_SPLIT}'), lambda x: x <> '')"


OP3 = f"""
WITH d AS (
  SELECT doc_id, source, len({_words('text')})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS mark FROM documents
), s AS (SELECT source, sum(size)::DOUBLE AS have FROM d GROUP BY source
), w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s
), v AS (SELECT *, [5, 2, 1][place % 3 + 1]::DOUBLE AS weight FROM w
), l AS (
  SELECT *, row_number() OVER o AS turn,
         (1.5::DOUBLE * sum(have) OVER () - coalesce(2 * sum(have) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM v WINDOW o AS (ORDER BY have / weight, place)
), t AS (
  SELECT *, round(least(2 * have, weight * (SELECT level FROM l WHERE level * weight <= 2 * have ORDER BY turn LIMIT 1)), 6) AS target
  FROM l
), e AS (
  SELECT *, floor(round(sum(target) OVER (ORDER BY place) / sum(target) OVER (), 12) * 2147483648)::BIGINT AS stop FROM t WHERE target > 0
), b AS (SELECT *, coalesce(lag(stop) OVER (ORDER BY place), 0) AS begin FROM e
), p AS (
  SELECT (i * 1327217885) % 2147483648 AS point FROM range((SELECT ceil(sum(target) / 1024)::BIGINT FROM t)) r(i)
), k AS (SELECT place, count(*) AS n FROM p JOIN b ON point >= begin AND point < stop GROUP BY place
), c AS (
  SELECT t.*, coalesce(n, CASE WHEN target >= 1 THEN 1 ELSE 0 END) AS n,
         least(coalesce(n, 1) * ceil(target / coalesce(n, 1)), floor(target)) AS upto
  FROM t LEFT JOIN k USING (place)
), q AS (
  SELECT d.*, have, target, CASE WHEN n = 0 THEN 0 ELSE upto END AS upto,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY mark, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
)
SELECT doc_id, size, have::BIGINT AS source_size, target,
       (greatest(0, least(start + size, upto) - start) + greatest(0, least(start + have + size, upto) - start - have))::BIGINT AS taken
FROM q
"""

OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, count(s) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), r(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT doc_id, any_value(n)::BIGINT AS n_shingles, min(other) AS component_id FROM n JOIN r USING (doc_id) GROUP BY doc_id
"""

OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_words('text')} AS w FROM documents
), l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), g AS (
  SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), f AS (
  SELECT doc_id, count(DISTINCT i + shift) AS n_repeat_words
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM g), (VALUES (0), (1), (2)) v(shift)
  WHERE times > 1 GROUP BY doc_id
), c AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, len(list_distinct(w)) AS n_distinct,
    length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS n_letters
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN f USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words AND 100 * n_symbols <= 20 * n_words AND 100 * n_dup_lines <= 40 * n_lines
  AND 100 * n_distinct >= 20 * n_words AND 2 * word_chars >= 5 * n_words AND word_chars <= 12 * n_words
  AND 100 * n_upper <= 40 * n_letters AS kept
FROM c
"""

_NUMBERS = "two three four five six seven eight nine ten eleven twelve hundred thousand million billion"
_UNITS = (
    "mm cm m km mg g kg ml l liter liters litre litres meter meters metre metres mile miles inch inches foot feet yard yards "
    "gram grams kilogram kilograms pound pounds ounce ounces second seconds minute minutes hour hours day days week weeks "
    "month months year years dollar dollars euro euros cent cents percent degree degrees"
)


def _in(word: str, listed: str) -> str:
    return f"{word} IN ({', '.join(repr(x) for x in listed.split())})"


def _template_words(text: str) -> str:
    """Words with a mark (1) in front of names within a sentence and another (2) of other capitalised words."""
    named = f"regexp_replace(coalesce({text}, ''), '([\\p{{Ll}}\\p{{Nd}},;)] )(\\p{{Lu}})', '\\1' || chr(1) || '\\2', 'g')"
    marked = f"regexp_replace({named}, '([^\\p{{L}}\\p{{Nd}}\\x01]|^)(\\p{{Lu}})', '\\1' || chr(2) || '\\2', 'g')"
    return f"string_split(trim(regexp_replace(lower({marked}), '[^\\p{{L}}\\p{{Nd}}\\x01\\x02]+', ' ', 'g')), ' ')"


_UNMARKED = "replace(x, chr(2), '')"
_PLAIN = f"replace({_UNMARKED}, chr(1), '')"
_SLOT = (
    f"CASE WHEN starts_with({_UNMARKED}, chr(1)) THEN '<name>' WHEN {_UNMARKED} >= '0' AND {_UNMARKED} < ':' OR "
    + _in(_UNMARKED, _NUMBERS) + " THEN '<number>' WHEN " + _in(_UNMARKED, _UNITS) + " THEN '<unit>' END"
)
_LOOSE = f"coalesce({_SLOT}, CASE WHEN starts_with(x, chr(2)) THEN '<name>' END)"


def _all(words: str, each: str) -> str:
    return f"list_transform({words}, lambda x: {each})"


def _key(words: str) -> str:
    """The key of a window: by template (kind 0), by looser template (1), by plain words (2)."""
    strict, loose = _all(words, f"coalesce({_SLOT}, {_UNMARKED})"), _all(words, f"coalesce({_LOOSE}, x)")
    return f"CASE kind WHEN 0 THEN {strict} WHEN 1 THEN {loose} ELSE {_all(words, _PLAIN)} END"


def _slots(slot_of: str) -> str:
    kinds, a, b = _all("asked", slot_of), _all("asked", _UNMARKED), _all("given", _UNMARKED)
    return f"list_transform(range(1, len(asked) + 1), lambda i: [{kinds}[i], {a}[i], {b}[i]])"


def _accepted(name: str, kinds: str, windows: str) -> str:
    """``name``: diagonals with enough windows of the kinds, whose names and units are exchanged one for one."""
    return f"""{name}_pairs AS (
  SELECT DISTINCT doc_id, item_id, diagonal, pair[1] AS slot, pair[2] AS a, pair[3] AS b
  FROM (SELECT doc_id, item_id, diagonal, unnest(pairs) AS pair FROM m WHERE kind IN {kinds}) WHERE pair[1] IS NOT NULL
), {name}_told AS (
  SELECT doc_id, item_id, diagonal, count(*) FILTER (slot <> '<number>') = count(DISTINCT a) FILTER (slot <> '<number>') AS fine,
    count(*) FILTER (a <> b) AS exchanged FROM {name}_pairs GROUP BY ALL
), {name} AS (
  SELECT doc_id, item_id, matched, windows, coalesce(exchanged, 0) AS exchanged, 1 AS typed
  FROM (SELECT doc_id, item_id, diagonal, count(DISTINCT spot) AS matched, max({windows}) AS windows FROM m WHERE kind IN {kinds} GROUP BY ALL)
    LEFT JOIN {name}_told USING (doc_id, item_id, diagonal)
  WHERE coalesce(fine, true) AND matched >= greatest(1, least(6, windows - 1))
)"""


OP9 = f"""
WITH i AS (SELECT item_id, {_template_words('text')} AS w FROM benchmark
), d AS (SELECT doc_id, {_template_words('text')} AS w FROM documents
), iw AS (
  SELECT item_id, spot, length, w[spot + 1 : spot + length] AS asked
  FROM (SELECT *, least(len(w), 8) AS length, unnest(range(0, len(w) - least(len(w), 8) + 1)) AS spot FROM i)
), ik AS (
  SELECT *, {_key('asked')} AS key FROM iw, (VALUES (0), (1), (2)) k(kind)
  WHERE CASE kind WHEN 0 THEN len(list_filter(asked, lambda x: ({_SLOT}) IS NULL AND x <> '')) >= least(4, length)
    WHEN 1 THEN len(list_filter(asked, lambda x: starts_with(x, chr(2)))) > 0
      AND len(list_filter(asked, lambda x: ({_LOOSE}) IS NULL AND x <> '')) >= least(4, length)
    ELSE len(list_filter(asked, lambda x: {_UNMARKED} = '')) = 0 END
), whole AS (
  SELECT item_id, count(DISTINCT spot) FILTER (kind = 0) AS strict, count(DISTINCT spot) FILTER (kind < 2) AS wide,
    count(DISTINCT spot) FILTER (kind = 2) AS exact FROM ik GROUP BY 1
), dw AS (
  SELECT doc_id, place, w[place + 1 : place + length] AS given
  FROM (SELECT *, unnest(range(0, len(w) - length + 1)) AS place FROM d, (SELECT DISTINCT length FROM ik) WHERE len(w) >= length)
), every AS (
  SELECT doc_id, item_id, kind, place - spot AS diagonal, spot, strict, wide, exact, starts_with(given[1], chr(2)) AS begins,
    CASE kind WHEN 0 THEN {_slots(_SLOT)} WHEN 1 THEN {_slots(_LOOSE)} END AS pairs
  FROM (SELECT *, {_key('given')} AS key FROM dw, (VALUES (0), (1), (2)) k(kind)) JOIN ik USING (kind, key) JOIN whole USING (item_id)
), m AS (SELECT * FROM every WHERE doc_id IN (SELECT doc_id FROM every WHERE kind <> 1 OR begins)
), {_accepted('tight', '(0)', 'strict')}, {_accepted('broad', '(0, 1)', 'wide')},
verbatim AS (
  SELECT doc_id, item_id, matched, windows, 0 AS exchanged, 0 AS typed
  FROM (SELECT doc_id, item_id, diagonal, count(DISTINCT spot) AS matched, max(exact) AS windows FROM m WHERE kind = 2 GROUP BY ALL)
  WHERE matched >= greatest(1, least(6, windows - 1))
), sure AS (SELECT * FROM tight UNION ALL SELECT * FROM verbatim
), g AS (SELECT * FROM sure UNION ALL SELECT * FROM broad WHERE doc_id NOT IN (SELECT doc_id FROM sure))
SELECT doc_id, item_id, matched, windows, exchanged::BIGINT AS exchanged FROM g
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY typed DESC, matched DESC, exchanged, windows DESC) = 1
"""

_CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)), "
    "lambda c, x: list_reduce(list_prepend(xor(c, x), list_transform(range(8), lambda i: i::UBIGINT)), "
    "lambda v, i: xor(v >> 1, 3988292384::UBIGINT * (v & 1)))), 4294967295::UBIGINT)::BIGINT"
)
#: Words ``period`` apart are equal along a run, so its 8-grams recur there: such pairs, gathered by distance, are the runs.
OP11 = f"""
WITH o AS (SELECT doc_id, {_words('text')} AS w, coalesce({_CRC32}, 1) AS h FROM documents
), a AS (SELECT *, h // 10 AS g, len(w) AS n FROM o
), b AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM a
), d AS (
  SELECT doc_id, n, CASE WHEN h % 10 <> 0 OR n = 0 THEN w
    ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) END AS w
  FROM b
), e AS (SELECT doc_id, i, hash(array_to_string(w[i + 1 : i + 8], ' ')) AS gram FROM (SELECT *, unnest(range(n - 7)) AS i FROM d WHERE n >= 24)
), p AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.gram = y.gram AND y.i > x.i
), s AS (
  SELECT doc_id, q AS period, min(i) AS start, count(*) + 7 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM p) GROUP BY doc_id, q, island
), r AS (
  SELECT doc_id, start::BIGINT AS start, length::BIGINT AS length, min(period)::BIGINT AS period
  FROM s WHERE length >= greatest(24, 3 * period) GROUP BY doc_id, start, length
), t AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    first(struct_pack(start := start, length := length, period := period) ORDER BY length / period DESC, start, period) AS best
  FROM r GROUP BY doc_id
), x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r
), k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM d) LEFT JOIN (SELECT doc_id, i, true AS gone FROM x) USING (doc_id, i)
  WHERE gone IS NULL GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start AS start, best.length AS length, best.period AS period,
  (1000 * best.length // best.period)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
"""

OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
"""

ORACLE: dict[str, str] = {
    "op3_mixing": OP3,
    "op7_jaccard_join": OP7,
    "op9_decontamination": OP9,
    "op10_quality_rules": OP10,
    "op11_periodic_runs": OP11,
    "op13_hard_negatives": OP13,
}
