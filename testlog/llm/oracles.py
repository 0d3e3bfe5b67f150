"""SQL (DuckDB) that states the results of those queries that SQL can express."""

from __future__ import annotations

from testlog.llm import chat, decontam, licenses, linededup, mixing, phrases, prefixtrie, quality

WARC_CHAINS = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (
  SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
         CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first_id
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
"""

PERSPECTIVES = f"""
WITH t AS (
  SELECT conv_id, CAST(floor(turn / {chat.PART_TURNS}.0) AS BIGINT) AS part, turn,
         coalesce(role, 'unknown') AS role, coalesce(text, '') AS said
  FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> '{chat.SYSTEM}'),
x AS (
  SELECT conv_id, speaker, part, turn, role, said,
         CASE WHEN role = speaker THEN '{chat.OPEN}assistant' WHEN role = '{chat.SYSTEM}' THEN '{chat.OPEN}{chat.SYSTEM}'
              ELSE '{chat.OPEN}user name=' || role END || chr(10) AS head
  FROM s JOIN t USING (conv_id)),
y AS (SELECT *, head || said || '{chat.CLOSE}' || chr(10) AS shown FROM x),
z AS (
  SELECT *, CAST(coalesce(sum(length(shown)) OVER (
           PARTITION BY conv_id, speaker, part ORDER BY turn, role, said
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS BIGINT) AS begins
  FROM y)
SELECT conv_id, speaker, part, CAST(0 AS INTEGER) AS piece,
       string_agg(shown, '' ORDER BY turn, role, said) AS text,
       count(*) AS n_turns, count(*) FILTER (role = speaker) AS n_own,
       coalesce(string_agg(begins || '-' || (begins + length(said) + {len(chat.CLOSE)}), ',' ORDER BY turn, role, said)
                FILTER (role = speaker), '') AS spans,
       CAST(sum(length(shown)) AS BIGINT) AS n_chars,
       CAST(coalesce(sum(length(said) + {len(chat.CLOSE)}) FILTER (role = speaker), 0) AS BIGINT) AS n_masked
FROM z GROUP BY conv_id, speaker, part
"""


def _values(rows: list[tuple]) -> str:
    def literal(value) -> str:
        if isinstance(value, str):
            return "'" + value.replace("'", "''") + "'"
        if isinstance(value, list):
            return "[" + ", ".join(map(literal, value)) + "]"
        return str(value)

    return ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LICENSE_JOIN = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
phrases AS (SELECT * FROM (VALUES {_values([(p.split(), label) for p, label in licenses.PHRASES.items()])}) AS v(phrase, label)),
places AS (
  SELECT doc_id, i - 1 AS place, label
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE list_contains(w, 'license')), phrases
  WHERE w[i] = phrase[1] AND w[i : i + len(phrase) - 1] = phrase),
base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels, list(label) AS found
  FROM places GROUP BY doc_id),
templates AS (
  SELECT * FROM (VALUES {_values([
      (label, licenses.template_words(text), licenses.needed(len(licenses.template_words(text))))
      for label, text in licenses.TEMPLATES])}) AS v(label, words, needed)),
blocks AS (
  SELECT doc_id, w[greatest(b * {licenses.STRIDE}, 0) + 1 : (b + 2) * {licenses.STRIDE}] AS block
  FROM (SELECT doc_id, w, unnest(range(-1, len(w) // {licenses.STRIDE} + 1)) AS b FROM d)),
hits AS (
  SELECT doc_id, label, len(list_intersect(block, words)) AS shared, len(words) AS size, needed
  FROM blocks, templates),
more AS (
  SELECT doc_id, list(label) AS found, max(shared / size) AS score FROM hits WHERE shared >= needed GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.found, []), coalesce(more.found, [])))), ',') AS labels,
       coalesce(score, CAST(0 AS DOUBLE)) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""

_SPELLINGS = [
    (lang, k, spelling)
    for lang, listed in quality.COMMON_WORDS.items()
    for k, word in enumerate(listed, 1)
    for spelling in sorted({word, word.capitalize(), word.upper()})
]

QUALITY_DIVERGENCE = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
e AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         regexp_replace(t, '[\p{{L}}\p{{M}}]+', '', 'g') AS rest
  FROM d),
three AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM e)),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM three WHERE n > 1)
  GROUP BY doc_id),
m AS (
  SELECT e.doc_id, lang, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(rest) - length(regexp_replace(rest, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(repeated.n, 0) AS n_repeat_words,
         length(rest) AS n_rest,
         length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper,
         length(rest) - length(regexp_replace(rest, '\p{{N}}', '', 'g')) AS n_digits
  FROM e LEFT JOIN repeated USING (doc_id)),
b AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
         length(t) - word_chars AS n_spaces
  FROM m),
chars AS (
  SELECT doc_id, lang, 'char' AS kind, unnest(range(1, 7)) AS k,
         unnest([length(t) - n_rest - n_upper, n_upper, n_digits, n_spaces, n_symbols,
                 n_rest - n_spaces - n_symbols - n_digits]) / CAST(greatest(length(t), 1) AS DOUBLE) AS share
  FROM b),
listed AS (SELECT * FROM (VALUES {_values(_SPELLINGS)}) AS v(lang, k, spelling)),
said AS (
  SELECT doc_id, listed.k, count(*) AS n
  FROM (SELECT doc_id, lang, unnest(w) AS word FROM b) AS u JOIN listed ON listed.lang = u.lang AND spelling = word
  GROUP BY ALL),
words AS (
  SELECT b.doc_id, lang, 'word' AS kind, g.k,
         CASE WHEN g.k <= {quality.LISTED} THEN coalesce(said.n, 0)
              ELSE n_words - coalesce((SELECT sum(n) FROM said AS o WHERE o.doc_id = b.doc_id), 0) END
           / CAST(greatest(n_words, 1) AS DOUBLE) AS share
  FROM b CROSS JOIN (SELECT unnest(range(1, {quality.LISTED + 2})) AS k) AS g
  LEFT JOIN said ON said.doc_id = b.doc_id AND said.k = g.k),
hist AS (SELECT * FROM chars UNION ALL SELECT * FROM words),
refs AS (
  SELECT hist.lang, kind, k, avg(share) AS ref FROM hist JOIN b USING (doc_id)
  WHERE NOT base_failed AND 100 * n_symbols <= {quality.MAX_SYMBOL_PERCENT} * word_chars
  GROUP BY ALL),
parts AS (
  SELECT doc_id, hist.kind,
         CASE WHEN share > 0 THEN share * log2(2 * share / (share + ref)) ELSE 0 END
           + CASE WHEN ref > 0 THEN ref * log2(2 * ref / (share + ref)) ELSE 0 END AS x
  FROM hist JOIN refs ON hist.lang IS NOT DISTINCT FROM refs.lang AND hist.kind = refs.kind AND hist.k = refs.k),
far AS (
  SELECT doc_id, sqrt(greatest(sum(x) FILTER (kind = 'char') / 2, 0)) AS char_distance,
         sqrt(greatest(sum(x) FILTER (kind = 'word') / 2, 0)) AS word_distance
  FROM parts GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND coalesce(char_distance, 0) <= CASE {' '.join(f'WHEN length(t) >= {n} THEN {limit}' for n, limit in quality.CHAR_LIMITS)} ELSE 1 END
       AND (n_words < {quality.WORD_GUARD} OR coalesce(lang, '') NOT IN ({', '.join(f"'{k}'" for k in quality.COMMON_WORDS)})
            OR coalesce(word_distance, 0) <= {quality.WORD_LIMIT}) AS kept
FROM b LEFT JOIN far USING (doc_id)
"""

LINE_TEMPLATES = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents),
t AS (
  SELECT doc_id, i, line,
         list_transform(string_split_regex(trim(line), '\s+'),
                        lambda x: CASE WHEN regexp_matches(x, '[0-9@]|://') THEN '<*>' ELSE x END) AS w
  FROM l WHERE trim(line) <> ''),
k AS (
  SELECT doc_id, i, unnest(
           CASE WHEN len(w) < {linededup.GENERAL} THEN [len(w) || '|' || array_to_string(w, ' ')]
           ELSE list_transform(range({linededup.FIELDS}), lambda f: len(w) || '|' || f || '|'
             || array_to_string(w[1 : {linededup.LEADING} + (len(w) - {linededup.LEADING}) * f // {linededup.FIELDS}], ' ') || '|'
             || array_to_string(w[{linededup.LEADING} + (len(w) - {linededup.LEADING}) * (f + 1) // {linededup.FIELDS} + 1 : len(w)], ' '))
           END) AS key
  FROM t),
r AS (
  SELECT key, min(doc_id) AS first_id FROM k GROUP BY key HAVING count(DISTINCT doc_id) >= {linededup.MIN_DOCS}),
marked AS (SELECT doc_id, i, bool_or(doc_id <> first_id) AS lost FROM k JOIN r USING (key) GROUP BY doc_id, i),
j AS (SELECT l.doc_id, l.i, line, trim(line) <> '' AS told, marked.lost FROM l LEFT JOIN marked USING (doc_id, i)),
c AS (
  SELECT doc_id, coalesce(sum(length(line)) FILTER (lost IS NOT NULL), 0) >= {linededup.COPY_SHARE} * sum(length(line))
                 AND count(lost) > 0 AS is_copy
  FROM j GROUP BY doc_id),
o AS (
  SELECT doc_id, is_copy, count(*) FILTER (told) AS n_lines, count(lost) AS n_recurring,
         count(*) FILTER (lost AND NOT is_copy) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (is_copy OR lost IS NULL OR NOT lost), '') AS left_over
  FROM j JOIN c USING (doc_id) GROUP BY doc_id, is_copy)
SELECT doc_id, n_lines, n_recurring, n_dropped, is_copy, CAST(length(left_over) AS BIGINT) AS n_chars_left,
       sha256(left_over) AS text_sha256
FROM o
"""

SPACED_SEEDS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS w FROM benchmark),
dw AS (SELECT doc_id, len(w) AS doc_words, unnest(w) AS word, unnest(range(len(w))) AS place FROM d),
bw AS (
  SELECT item_id, len(w) AS item_words, unnest(w) AS word, unnest(range(len(w))) AS pos
  FROM b WHERE len(w) >= {decontam.MIN_WORDS}),
same AS (
  SELECT doc_id, item_id, place - pos AS shift, pos, least(item_words, {decontam.STRETCH}) AS n,
         least(item_words, doc_words - (place - pos)) - greatest(0, pos - place) AS overlap
  FROM dw JOIN bw USING (word)),
runs AS (
  SELECT doc_id, item_id, n, count(*) OVER (
           PARTITION BY doc_id, item_id, shift ORDER BY pos RANGE BETWEEN n - 1 PRECEDING AND CURRENT ROW) AS agree
  FROM same WHERE overlap >= n)
SELECT doc_id, item_id, n AS n_words, max(agree) / CAST(n AS DOUBLE) AS share
FROM runs GROUP BY doc_id, item_id, n 
HAVING max(agree) >= CASE WHEN n < {decontam.TOLERANT} THEN 1 ELSE {decontam.THRESHOLD} END * n
"""

BLOCK_RULES = r"""
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<br>', ' ', 'g') AS h
  FROM pages),
s AS (
  SELECT page_id, url, string_split(regexp_replace(regexp_replace(h, '</?(p|h1)>', chr(1), 'g'), '<[^>]*>', '', 'g'), chr(1)) AS parts
  FROM a),
c AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(
           replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
           '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks
  FROM s)
SELECT page_id, url, array_to_string(blocks, chr(10) || chr(10)) AS text,
       CAST(length(array_to_string(blocks, chr(10) || chr(10))) AS BIGINT) AS n_chars, CAST(len(blocks) AS BIGINT) AS n_kept
FROM c
"""


PHRASE_GRAPH = rf"""
WITH p AS (
  SELECT coalesce(lang, '{phrases.UNKNOWN}') AS lang,
         unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, ws[i : i + k - 1] AS g, k FROM i, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, g, k, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE f >= {phrases.MIN_COUNT} AND k > 1),
inner_parts AS (
  SELECT lang, g[s : s + j - 1] AS g, f
  FROM c, (SELECT unnest(range(1, 5)) AS s), (SELECT unnest(range(2, 5)) AS j) WHERE j < k AND s + j - 1 <= k),
held AS (SELECT lang, g, max(f) AS most FROM inner_parts GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN held USING (lang, g) WHERE coalesce(100 * most < 100 * f, true)),
cut AS (
  SELECT kept.lang, kept.g, kept.f AS a, j, x.f AS l, y.f AS r, n,
         CAST((1000::HUGEINT * kept.f * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM kept JOIN (SELECT unnest(range(1, 5)) AS j) ON j < kept.k
  JOIN f x ON x.lang = kept.lang AND x.g = kept.g[1 : j]
  JOIN f y ON y.lang = kept.lang AND y.g = kept.g[j + 1 : kept.k]
  JOIN n ON n.lang = kept.lang),
best AS (
  SELECT *, array_to_string(g, ' ') AS phrase FROM cut
  QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM best
QUALIFY rank <= {phrases.TOP}
"""

WATER_FILLING = rf"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[{mixing.SPACE}]+'), lambda x: x <> '')) AS BIGINT) AS size,
         sha256('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, {list(mixing.WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS w,
         {mixing.EPOCHS} * source_size AS cap
  FROM s),
b AS (
  SELECT *, coalesce(sum(cap) OVER f, 0) AS caps, coalesce(sum(w) OVER f, 0) AS ws,
         sum(source_size) OVER () AS total, sum(w) OVER () AS weight
  FROM w
  WINDOW f AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap::HUGEINT * (weight - ws) <= w::HUGEINT * (total - caps) AS full_up FROM b),
g AS (
  SELECT source, source_size,
         CASE WHEN full_up THEN CAST(cap AS DOUBLE)
              ELSE CAST((total - coalesce(sum(cap) FILTER (full_up) OVER (), 0)) * w AS DOUBLE)
                   / CAST(weight - coalesce(sum(w) FILTER (full_up) OVER (), 0) AS DOUBLE) END AS target
  FROM c),
r AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target + 0.5) AS BIGINT) // source_size END AS whole FROM g),
e AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) - whole * source_size AS rest FROM r),
k AS (SELECT source, h, sum(size) AS tie FROM d GROUP BY source, h),
o AS (SELECT *, sum(tie) OVER (PARTITION BY source ORDER BY h) - tie AS before FROM k)
SELECT d.doc_id, d.size, e.source_size, e.target,
       CAST(e.whole * d.size + CASE WHEN o.before + o.tie <= e.rest THEN d.size WHEN o.before >= e.rest THEN 0
            ELSE ((e.rest - o.before)::HUGEINT * d.size) // o.tie END AS BIGINT) AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
JOIN o ON d.source IS NOT DISTINCT FROM o.source AND d.h = o.h
"""

# CRC-32 of a short ASCII string, bit by bit.
_CRC32 = """
xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)
"""

PREFIX_TRIE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
c AS (SELECT conv_id, conv_id - conv_id % {prefixtrie.FAMILY} AS base, {_CRC32} % {prefixtrie.HEADS} AS h FROM n),
r AS (
  SELECT c.conv_id, place AS pos, role, text FROM c JOIN t ON t.conv_id = base WHERE place <= h OR base = c.conv_id
  UNION ALL
  SELECT c.conv_id, place - h + least(h, coalesce(n.n, 0)), role, text
  FROM c JOIN t ON t.conv_id = c.conv_id LEFT JOIN n ON n.conv_id = base WHERE place > h AND base <> c.conv_id),
w AS (
  SELECT conv_id, pos AS depth, text, list(struct_pack(r := role, t := text)) OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM r),
m AS (
  SELECT conv_id, 0 AS depth, '' AS text, [] AS path FROM c
  UNION ALL SELECT conv_id, depth, text, path FROM w),
e AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM m),
g AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * strlen(any_value(text)) AS saved,
         sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM e GROUP BY path, depth),
k AS (SELECT path[1 : depth - 1] AS path, count(*) AS n FROM g WHERE depth > 0 GROUP BY ALL),
u AS (SELECT g.*, coalesce(k.n, 0) AS n_children FROM g LEFT JOIN k ON k.path = g.path),
s AS (
  SELECT m.path, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM u JOIN m ON m.conv_id = u.conv_id AND m.depth <= u.depth GROUP BY m.path)
SELECT u.conv_id, u.depth, p.conv_id AS parent_conv_id, u.n_convs, u.n_children, s.n_leaves, s.saved_tokens, u.ends_sha256
FROM u JOIN s ON s.path = u.path LEFT JOIN g p ON u.depth > 0 AND p.path = u.path[1 : u.depth - 1]
"""
