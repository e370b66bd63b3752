"""SQL for the queries that SQL can express, for checking them against another engine."""

import math

from .quality import ALPHA, FENCE, GROUP_ROWS, SHARES

WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MIX = rf"""
WITH sz AS (SELECT doc_id, source, len({WORDS.format('text')})::BIGINT AS size FROM documents),
 src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sz GROUP BY 1),
 weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM src),
 steps AS (SELECT *, sum(source_size) OVER (ORDER BY source_size * 2.0 / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS capped,
  sum(w) OVER (ORDER BY source_size * 2.0 / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS room, sum(source_size) OVER () AS total FROM weighed),
 levels AS (SELECT source_size * 2.0 / w AS own, (1.5 * total::DOUBLE - 2.0 * coalesce(capped, 0)::DOUBLE) / room AS level FROM steps),
 level AS (SELECT min_by(level, own) AS level FROM levels WHERE level <= own),
 targets AS (SELECT source, source_size, least(level * w, 2.0 * source_size) AS target FROM weighed, level),
 rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets)
SELECT doc_id, size, source_size, target,
 (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('7:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sz JOIN rates ON sz.source IS NOT DISTINCT FROM rates.source
"""

_GAMMA = (1 + ALPHA) / (1 - ALPHA)
_STEP = math.log(_GAMMA)
_SHARE = {
    "symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"), "word_length": ("word_chars", "n_words"),
}
_LONG = " UNION ALL ".join(f"SELECT lang, source, '{s}' AS share, {s} AS v FROM shares" for s in SHARES)
_LEAST = " ".join(f"WHEN '{s}' THEN {least}" for s, (least, _) in SHARES.items())
_BOTH = ", ".join(f"'{s}'" for s, (_, both) in SHARES.items() if both)


def _level(k, groups):
    keys = ", ".join([*groups, "share"])
    return f"""q{k} AS (SELECT {keys}, max(total) AS total, min(CASE WHEN upto >= 0.25 * total THEN v END) AS q1, min(CASE WHEN upto >= 0.75 * total THEN v END) AS q3 FROM (
  SELECT {keys}, coalesce(2.0 * pow({_GAMMA!r}, bin) / {_GAMMA + 1!r}, 0.0) AS v, sum(n) OVER (PARTITION BY {keys} ORDER BY bin NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY {keys}) AS total
  FROM (SELECT {keys}, bin, count(*) AS n FROM bins GROUP BY ALL)) GROUP BY {keys})"""


QUALITY = rf"""
WITH w AS (SELECT doc_id, row_number() OVER () AS row, lang, source, coalesce(text, '') AS text, {WORDS.format('text')} AS words FROM documents),
 pos AS (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3),
 win AS (SELECT row, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM pos),
 twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS c FROM win) WHERE c > 1),
 rep AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, range(0, 3) r(k) GROUP BY 1),
 lines AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM w),
 dup AS (SELECT row, count(*) AS n, count(*) - count(DISTINCT line) AS d FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
 st AS (SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(d, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  coalesce(dup.n, 0)::BIGINT AS n_lines, (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper FROM w LEFT JOIN rep USING (row) LEFT JOIN dup USING (row)),
 shares AS (SELECT *, {', '.join(f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0 END AS {s}" for s, (a, b) in _SHARE.items())} FROM st),
 bins AS (SELECT lang, source, share, CASE WHEN v > 1e-9 THEN ceil(ln(v) / {_STEP!r})::INT END AS bin FROM ({_LONG})),
 {_level(0, ['lang', 'source'])}, {_level(1, ['lang'])}, {_level(2, [])},
 pick AS (SELECT q0.lang, q0.source, q0.share, CASE WHEN q0.total >= {GROUP_ROWS} THEN q0.q1 WHEN q1.total >= {GROUP_ROWS} THEN q1.q1 ELSE q2.q1 END AS q1,
  CASE WHEN q0.total >= {GROUP_ROWS} THEN q0.q3 WHEN q1.total >= {GROUP_ROWS} THEN q1.q3 ELSE q2.q3 END AS q3
  FROM q0 JOIN q1 ON q0.lang IS NOT DISTINCT FROM q1.lang AND q0.share = q1.share JOIN q2 ON q0.share = q2.share),
 lim AS (SELECT lang, source, share, q3 + {FENCE!r} * greatest(q3 - q1, CASE share {_LEAST} END) AS hi,
  CASE WHEN share IN ({_BOTH}) THEN q1 - {FENCE!r} * greatest(q3 - q1, CASE share {_LEAST} END) END AS lo FROM pick),
 wide AS (SELECT lang, source, {', '.join(f"max(CASE WHEN share = '{s}' THEN hi END) AS {s}_hi, max(CASE WHEN share = '{s}' THEN lo END) AS {s}_lo" for s in SHARES)} FROM lim GROUP BY ALL),
 v AS (SELECT s.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  {' OR '.join(f"coalesce({s} > {s}_hi, false) OR coalesce({s} < {s}_lo, false)" for s in SHARES)} AS beyond
  FROM shares s JOIN wide ON s.lang IS NOT DISTINCT FROM wide.lang AND s.source IS NOT DISTINCT FROM wide.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT beyond AS kept FROM v
"""

GROUPS = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER.format('text'))} AS words FROM documents),
 sh AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
  UNION ALL SELECT doc_id, '<' || array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
 links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
 ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT a AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY ALL
"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
 top AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM top
"""


def _crc_step(c):
    for _ in range(8):
        c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)  # Fixed value: the reflected polynomial of crc32.
    return c


_CRC = [_crc_step(b) for b in range(256)]

# Words one edit apart share a word that one deletion makes of both (at the same place if the lengths agree), or one is a deletion of the other.
SPELLING = rf"""
WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS k, unnest(regexp_extract_all({LOWER.format('text')}, '[a-zÀ-ÿ]+')) AS run FROM documents),
 per AS (SELECT k, run, count(*) AS n FROM runs GROUP BY 1, 2),
 bytes AS (SELECT run, n, hex(encode(k || run)) AS h FROM per),
 crc AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, ({_CRC}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM bytes),
 cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM crc),
 w AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
 gone AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
 pairs AS (SELECT x.word AS a, y.word AS b FROM gone x JOIN gone y ON x.d = y.d AND x.i = y.i AND x.word <> y.word
  UNION SELECT gone.word, w.word FROM gone JOIN w ON d = w.word UNION SELECT w.word, gone.word FROM gone JOIN w ON d = w.word),
 best AS (SELECT a, count(*) AS n_near, min({{'less': -w.n, 'b': b}}) AS best FROM pairs JOIN w ON b = w.word GROUP BY 1),
 v AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.less >= 5 * n THEN best.b END AS form, CASE WHEN -best.less >= 5 * n THEN -best.less END::BIGINT AS form_n
  FROM w LEFT JOIN best ON a = word),
 way AS (SELECT word, word AS root, 0 AS step FROM v UNION ALL SELECT way.word, v.form, step + 1 FROM way JOIN v ON v.word = way.root WHERE v.form IS NOT NULL),
 root AS (SELECT word, max_by(root, step) AS root FROM way GROUP BY 1)
SELECT word, form, root, n, n_near, form_n FROM v JOIN root USING (word)
"""
