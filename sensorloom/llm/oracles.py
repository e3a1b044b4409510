"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8 = f"""
WITH t AS (SELECT doc_id, {_LOWER} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""

OP9 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
), tokens AS (SELECT doc_id, unnest(s) AS token FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)
), reach AS (
  SELECT doc_id AS root, doc_id AS node FROM documents
  UNION SELECT reach.root, links.b FROM reach JOIN links ON links.a = reach.node
), least AS (SELECT root AS doc_id, min(node) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least USING (doc_id)
"""


def _quality() -> str:
    from .quality import BASE_WORDS, COMMON, LEAST_CHARS, LEAST_WORDS, MOST_CHAR, MOST_REPEATED, MOST_WORD

    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    common = "CASE lang " + " ".join(f"WHEN '{k}' THEN {listed(v)}" for k, v in COMMON.items()) + " ELSE [] END"
    langs = ", ".join(f"'{k}'" for k in COMMON)
    bins = len(COMMON["en"])
    count = lambda c: f"length(t) - length(regexp_replace(t, '{c}', '', 'g'))"
    term = "CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END"

    def distance(p: str, q: str, n: int) -> str:
        a, b = f"({p}[i] / list_sum({p}))", f"({q}[i] / list_sum({q}))"
        each = f"({term.format(a=a, b=b)} + {term.format(a=b, b=a)}) / 2"
        some = f"list_sum({p}) > 0 AND list_sum({q}) > 0"
        return f"CASE WHEN {some} THEN sqrt(greatest(0, list_sum(list_transform(generate_series(1, {n}), lambda i: {each})))) END"

    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i}])" for i in range(1, n + 1)) + "]"
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({langs}) THEN lang ELSE 'other' END AS lang,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw
  FROM documents
), places AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 4)) AS i, w FROM d WHERE len(w) >= 5
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i+4], ' ')) AS n FROM places
), covered AS (
  SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS words FROM windows WHERE n > 1
), repeated AS (SELECT doc_id, CAST(sum(words) AS BIGINT) AS n FROM covered GROUP BY 1),
counts AS (
  SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST({count('[#*$%&|<>]')} AS BIGINT) AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, length(t) AS n_chars,
    [{count(r'\p{L}')} - ({count(r'\p{Lu}')}), {count(r'\p{Lu}')}, {count(r'\p{Nd}')}, {count(r'[\x20\x09-\x0D]')},
     {count(r"[.,;:!?''\x22()\-]")}] AS c5,
    list_transform(lw, lambda x: coalesce(list_position({common}, x), 0)) AS p
  FROM d LEFT JOIN repeated USING (doc_id)
), hist AS (
  SELECT * EXCLUDE (c5, p), list_append(c5, n_chars - list_sum(c5)) AS chars,
    list_append(list_transform(generate_series(1, {bins}), lambda k: len(list_filter(p, lambda x: x = k))), len(list_filter(p, lambda x: x = 0))) AS words,
    n_words < {BASE_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed
  FROM counts
), refs AS (
  SELECT lang, {sums('chars', 6)} AS rc, {sums('words', bins + 1)} AS rw FROM hist
  WHERE NOT base_failed AND n_chars >= {LEAST_CHARS} AND n_words >= {LEAST_WORDS} GROUP BY lang
), far AS (
  SELECT hist.*, {distance('chars', 'rc', 6)} AS cd, CASE WHEN lang <> 'other' THEN {distance('words', 'rw', bins + 1)} END AS wd
  FROM hist LEFT JOIN refs USING (lang)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_chars >= {LEAST_CHARS} AND coalesce(cd, 0) > {MOST_CHAR})
    AND NOT (n_words >= {LEAST_WORDS} AND coalesce(wd, 0) > {MOST_WORD}) AS kept,
  round(cd, 6) AS char_distance, round(wd, 6) AS word_distance
FROM far
"""


OP3 = _quality()

OP10 = r"""
WITH all_lines AS (
  SELECT doc_id, i, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
), lines AS (
  SELECT doc_id, i, line, row_number() OVER d AS k,
    sum(len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) OVER d AS words
  FROM all_lines WHERE worded WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), ends AS (
  SELECT a.doc_id, a.k AS lo, min(b.k) AS hi FROM lines a JOIN lines b
    ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 49
   AND b.words - a.words + len(list_filter(string_split_regex(a.line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) >= 50 GROUP BY 1, 2
), starts AS (
  SELECT b.doc_id, max(a.k) AS lo, b.k AS hi FROM lines a JOIN lines b
    ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 49
   AND b.words - a.words + len(list_filter(string_split_regex(a.line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) >= 50 GROUP BY 1, 3
), runs AS (
  SELECT r.doc_id, lo, hi, string_agg(line, chr(10) ORDER BY k) AS content
  FROM (SELECT doc_id, lo, hi FROM ends UNION SELECT doc_id, lo, hi FROM starts) r
  JOIN lines l ON l.doc_id = r.doc_id AND l.k BETWEEN lo AND hi GROUP BY 1, 2, 3
), later AS (
  SELECT *, row_number() OVER c AS nth, first_value(doc_id) OVER c AS first_id, first_value(hi) OVER c AS first_hi
  FROM runs WINDOW c AS (PARTITION BY content ORDER BY doc_id, lo)
), gone AS (
  SELECT DISTINCT l.doc_id, l.i FROM later r JOIN lines l ON l.doc_id = r.doc_id AND l.k <= hi
   AND l.k >= CASE WHEN first_id = r.doc_id THEN greatest(lo, first_hi + 1) ELSE lo END WHERE nth > 1
), marked AS (
  SELECT a.*, g.i IS NOT NULL AS cut FROM all_lines a LEFT JOIN gone g ON g.doc_id = a.doc_id AND g.i = a.i
), base AS (
  SELECT m.doc_id, count(*) FILTER (worded) AS n_lines, count(*) FILTER (cut) AS n_removed,
    CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT cut), '') END AS text
  FROM marked m JOIN documents d ON d.doc_id = m.doc_id GROUP BY m.doc_id
), words AS (
  SELECT doc_id, k, list_transform(tok, lambda t: regexp_replace(t, '[\x20\x09-\x0D]+$', '')) AS w, tok
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS tok FROM base) t, (SELECT 50 AS k)
), places AS (
  SELECT doc_id, unnest(range(len(w) - 49)) AS i, unnest(list_transform(range(len(w) - 49), lambda i: md5(array_to_string(w[i + 1:i + k], ' ')))) AS content
  FROM words WHERE len(w) >= k
), met AS (
  SELECT *, first_value(doc_id) OVER c AS first_id, first_value(i) OVER c AS first_i, row_number() OVER c AS nth
  FROM places WINDOW c AS (PARTITION BY content ORDER BY doc_id, i)
), gone_words AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN first_id = doc_id THEN greatest(i, first_i + 50) ELSE i END, i + 50)) AS i FROM met WHERE nth > 1
), kept_words AS (
  SELECT t.doc_id, count(*) FILTER (g.i IS NOT NULL) AS n_words, coalesce(string_agg(t.t, '' ORDER BY t.i) FILTER (g.i IS NULL), '') AS text
  FROM (SELECT doc_id, unnest(tok) AS t, unnest(range(len(tok))) AS i FROM words WHERE doc_id IN (SELECT doc_id FROM gone_words)) t
  LEFT JOIN gone_words g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY t.doc_id
)
SELECT b.doc_id, n_lines, n_removed, coalesce(n_words, 0) AS n_words,
  CASE WHEN n_words IS NULL THEN b.text ELSE regexp_extract(b.text, '^[\x20\x09-\x0D]*') || k.text END AS text
FROM base b LEFT JOIN kept_words k ON k.doc_id = b.doc_id
"""

OP6 = r"""
WITH pages_ AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), digests AS (
  SELECT page_id, octet_length(encode(payload)) AS payload_bytes, min(page_id) OVER (PARTITION BY payload) AS first,
    array_to_string(list_transform(string_split(sha1(payload), ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * instr('0123456789abcdef', c) - 3, 4)), '') AS bits
  FROM pages_
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(
    list_transform(generate_series(0, 4), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INT) * CAST(pow(2, 4 - j) AS INT))) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM digests
"""

# the level of words a weight at which all targets sum to the total: full sources are those of the least size a weight
MIXING_TARGETS = r"""
WITH sizes AS (
  SELECT source, sum(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS size FROM documents GROUP BY source
), weighed AS (
  SELECT source, size, 2.0 * size AS cap, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS weight FROM sizes
), filled AS (
  SELECT *, coalesce(sum(cap) OVER w, 0) AS taken, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest, 1.5 * sum(size) OVER () AS total, cap / weight AS own, row_number() OVER (ORDER BY cap / weight, source) AS place
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min((total - taken) / rest, place) FILTER (WHERE (total - taken) / rest <= own) AS level FROM filled
)
SELECT source, CAST(size AS BIGINT) AS source_size, round(least(cap, weight * coalesce(level, 1e300)), 6) AS target FROM weighed, level
"""


def _vector_codes() -> str:
    from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

    nearest = lambda k, of: f"""
a{k} AS MATERIALIZED (
  SELECT row, part, x, struct_extract(min(struct_pack(d := d, entry := entry)), 'entry') AS entry, min(d) AS d FROM (
    SELECT p.row, p.part, p.x, c.entry, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts p JOIN {of} c ON p.part = c.part) GROUP BY row, part, x
)"""  # noqa: E731
    moved = lambda k, of: f"""
c{k} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM {of} c LEFT JOIN (
    SELECT part, entry, list(s ORDER BY i) AS x FROM (
      SELECT part, entry, i, CAST(sum(v) // count(*) - CASE WHEN sum(v) % count(*) < 0 THEN 1 ELSE 0 END AS BIGINT) AS s
      FROM (SELECT part, entry, unnest(range(len(x))) AS i, unnest(x) AS v FROM a{k}) GROUP BY part, entry, i) GROUP BY part, entry
  ) m ON m.part = c.part AND m.entry = c.entry
)"""  # noqa: E731
    steps = [f"{nearest(k, f'c{k - 1}')}, {moved(k, f'c{k - 1}')}" for k in range(1, ROUNDS + 1)]
    return f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS row,
    list_transform(embedding, lambda v: CAST(floor({SCALE}.0::DOUBLE * v::DOUBLE) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), parts AS MATERIALIZED (
  SELECT row, part, x[part * (len(x) // {PARTS}) + 1:(part + 1) * (len(x) // {PARTS})] AS x FROM kept, (SELECT unnest(range({PARTS})) AS part)
), c0 AS MATERIALIZED (SELECT part, row AS entry, x FROM parts WHERE row < {ENTRIES}),
{", ".join(steps)}, {nearest("_", f"c{ROUNDS}")},
coded AS (
  SELECT row, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a_ GROUP BY row
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c{ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (row)
"""


OP11 = _vector_codes()

_PLAIN = r"list_filter(string_split_regex({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP13 = f"""
WITH d AS (SELECT doc_id, {_PLAIN.format(_LOWER)} AS w FROM documents),
b AS (SELECT item_id, {_PLAIN.format(_LOWER)} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, CAST(least(10, len(w)) AS BIGINT) AS n, unnest(list_transform(generate_series(1, greatest(1, len(w) - 9)), lambda i: array_to_string(w[i:i + 9], ' '))) AS content
  FROM b WHERE len(w) > 0
), places AS (
  SELECT doc_id, n, unnest(generate_series(1, len(w) - n + 1)) AS i, unnest(list_transform(generate_series(1, len(w) - n + 1), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS content
  FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), met AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN windows v ON p.content = v.content AND p.n = v.n),
hit AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS i FROM (SELECT DISTINCT doc_id, i, n FROM met)) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# crc32 by its bits; a run of a period is a whole stretch of words that equal the one a period before
OP12 = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
      lambda s, c: list_reduce(list_prepend(xor(s, c), list_transform(range(8), lambda k: k::BIGINT)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1))))) AS h
  FROM documents
), planned AS (
  SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, 1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) AS p FROM d
), planted AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w
  FROM planned
), words AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS w FROM planted WHERE n >= 6),
equal AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (
  SELECT doc_id, q, min(i) AS s, max(i) + 1 + q AS e
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal) GROUP BY doc_id, q, island
), runs AS MATERIALIZED (
  SELECT doc_id, s AS start, e - s AS length, min(q) AS period FROM islands WHERE e - s >= greatest(6, 4 * q) GROUP BY 1, 2, 3
), best AS (
  SELECT doc_id, start, length, period FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1
), digests AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period)) AS runs_sha256 FROM runs GROUP BY 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT doc_id, sha256(string_agg(w, ' ' ORDER BY i)) AS collapsed_sha256 FROM (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS w FROM planted)
  ANTI JOIN gone USING (doc_id, i) GROUP BY 1
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM planted LEFT JOIN best USING (doc_id) LEFT JOIN digests USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES = {"mixing_targets": MIXING_TARGETS, "op6_warc": OP6, "op3_quality": OP3, "op8_exact_dedup": OP8, "op9_minhash": OP9, "op10_line_dedup": OP10, "op11_vector_codes": OP11, "op12_periodic_runs": OP12, "op13_decontamination": OP13}
