"""DuckDB SQL that the registered queries must equal."""

# CRC-32 of a text: a table of 256 entries from the polynomial, then one step per byte.
_CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS crcs FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
  FROM range(256) r(i)))"""


def _crc(text: str) -> str:
    codes = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    step = "lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {step}), 4294967295::BIGINT)"


PREFIX_TRIE = f"""
WITH {_CRC_TABLE},
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
      coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n, conv_id::VARCHAR AS name FROM t GROUP BY conv_id),
c AS (SELECT conv_id, n, conv_id - conv_id % 5 AS base, {_crc('name')} % 9 AS h FROM sizes, crc_table),
r AS (
  SELECT c.conv_id, b.pos, b.role, b.text FROM c JOIN t b ON b.conv_id = c.base AND b.pos < c.h
  UNION ALL
  SELECT t.conv_id, t.pos - c.h + least(c.h, coalesce(b.n, 0)), t.role, t.text
  FROM t JOIN c ON t.conv_id = c.conv_id LEFT JOIN c b ON b.conv_id = c.base WHERE t.pos >= c.h),
s AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY pos) AS turns FROM r GROUP BY conv_id),
w AS (SELECT c.conv_id, coalesce(turns, []) AS turns FROM c LEFT JOIN s ON c.conv_id = s.conv_id),
m AS (SELECT conv_id, len(turns) AS length, d AS depth, turns[1:d] AS node, coalesce(strlen(turns[d].text), 0) AS nb
      FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM w)),
n AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(nb) AS nb, max(length) = depth AS leaf,
      coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '') AS ends FROM m GROUP BY depth, node),
e AS (SELECT m.conv_id AS member, n.conv_id, n.depth FROM m JOIN n ON m.depth = n.depth AND m.node = n.node),
p AS (SELECT n.conv_id, n.depth, e.conv_id AS parent_conv_id FROM n JOIN e ON e.member = n.conv_id AND e.depth = n.depth - 1),
k AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM p GROUP BY ALL),
a AS (SELECT e.conv_id, e.depth, sum((n.n_convs - 1) * n.nb) AS saved_tokens, count(*) FILTER (n.leaf) AS n_leaves
      FROM n JOIN e ON e.member = n.conv_id AND e.depth <= n.depth GROUP BY ALL)
SELECT n.conv_id, n.depth, p.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, a.n_leaves,
  a.saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN a ON n.conv_id = a.conv_id AND n.depth = a.depth
LEFT JOIN p ON n.conv_id = p.conv_id AND n.depth = p.depth LEFT JOIN k ON n.conv_id = k.conv_id AND n.depth = k.depth"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

IMPORTANCE = f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
df AS (SELECT doc_id, unnest(w) AS word FROM d),
bf AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
words AS (SELECT word FROM df UNION SELECT word FROM bf),
b AS (SELECT word, {_crc('word')} % 10000 AS bucket FROM words, crc_table),
s AS (SELECT bucket, count(*) AS n FROM df JOIN b ON df.word = b.word GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN b ON bf.word = b.word GROUP BY bucket),
total AS (SELECT (SELECT count(*) FROM df) AS s_all, (SELECT count(*) FROM bf) AS t_all),
g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * (s_all + 10000) / ((s.n + 1) * (t_all + 10000)))) AS gain
      FROM s LEFT JOIN t ON s.bucket = t.bucket, total),
x AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*)) AS weight
      FROM df JOIN b ON df.word = b.word JOIN g ON b.bucket = g.bucket GROUP BY doc_id),
f AS (SELECT d.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
      ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN x ON d.doc_id = x.doc_id),
y AS (SELECT doc_id, n_words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS score FROM f),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM y WHERE n_words >= 20)
SELECT y.doc_id, n_words, n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank
FROM y LEFT JOIN z ON y.doc_id = z.doc_id"""

# A text stands as it is where it reads back so; else its control strings are escaped, then the
# backslashes before one or at the end, then all backslashes.
_CONTROL = "### |</turn>"


def _count(pattern: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_RUNS = rf"(\\+)(?:{_CONTROL}|$)"
CHAT_FORMAT = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, ['user', 'assistant'][i + 1], '\### Assistant: </turn> ok' FROM range(2) r(i)),
e AS (SELECT *, CASE
  WHEN NOT regexp_matches(text, '\\\\|\\$|{_CONTROL}') THEN 0
  WHEN NOT regexp_matches(text, '\\(\\|$|{_CONTROL})') THEN {_count(_CONTROL)}
  WHEN NOT regexp_matches(regexp_replace(text, '{_RUNS}', '', 'g'), '\\\\')
  THEN {_count(_CONTROL)} + coalesce(list_sum(list_transform(regexp_extract_all(text, '{_RUNS}', 1), lambda r: len(r))), 0)
  ELSE {_count(_CONTROL)} + {_count(r'\\')} END AS extra FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + extra + length('### : </turn>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

_SPACED = "list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

# Shingles of five words; an item of fewer words is one shingle of its own width k.
DECONTAMINATE = f"""
WITH dw AS (SELECT doc_id, {_SPACED} AS w FROM documents WHERE doc_id IS NOT NULL),
iw AS (SELECT item_id, w, least(len(w), 5) AS k FROM (SELECT item_id, {_SPACED} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM iw)),
d AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM iw))),
n AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY 1),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN q ON d.k = q.k AND d.s = q.s GROUP BY 1, 2)
SELECT doc_id, c.item_id, n_item, n_shared, n_shared / n_item AS containment
FROM c JOIN n ON c.item_id = n.item_id WHERE 100 * n_shared >= 80 * n_item"""
