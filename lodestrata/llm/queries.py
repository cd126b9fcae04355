"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import op6_chat_format
from .conversation_repair import op13_conversation_repair
from .decontaminate import op9_decontaminate
from .host_quality import op7_host_quality
from .line_dedup import op8_line_dedup
from .mixing import op5_mix_sources
from .near_dedup import op3_near_dedup
from .quality_classifier import op4_quality_classifier
from .secret_scan import op1_secret_scan
from .spelling_variants import op12_spelling_variants
from .substring_dedup import op11_substring_dedup
from .token_pack import op2_token_pack
from .warc import op10_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_token_pack": op2_token_pack,
    "op3_near_dedup": op3_near_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_mix_sources": op5_mix_sources,
    "op6_chat_format": op6_chat_format,
    "op7_host_quality": op7_host_quality,
    "op8_line_dedup": op8_line_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_warc": op10_warc,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_conversation_repair": op13_conversation_repair,
}

_TURNS = """SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'"""

#: The table of the 32-bit checksum and the checksum of a list of bytes ``b``, in SQL.
_CRC_TABLE = "crc_table AS (SELECT list(list_reduce(list_concat([i::UBIGINT], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) ORDER BY i) AS crcs FROM range(256) r(i))"
_CRC = "xor(list_reduce(list_concat([4294967295::UBIGINT], b), lambda a, x: xor(a >> 8, crcs[(xor(a, x) & 255)::INTEGER + 1])), 4294967295::UBIGINT)"

ORACLES: dict[str, str] = {
    "op6_chat_format": f"""
WITH t AS ({_TURNS}),
n AS (SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\\', ''), '<', ''), '>', ''))
               + length(role) + length(role) - length(replace(replace(replace(role, '\\', ''), '<', ''), '>', '')) + 15 AS chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id""",
    "op10_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM m""",
    "op7_host_quality": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
b AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, ws FROM w),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM b WHERE len(ws) >= 3),
k AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS key FROM g),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS n FROM k) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n_repeat_words FROM c, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
m AS (SELECT b.doc_id, source, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM b LEFT JOIN r ON b.doc_id = r.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  word_chars < 2 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > word_chars OR 10 * n_dup_lines > 3 * n_words AS soft_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR soft_failed) AS bad FROM f GROUP BY source),
s AS (SELECT least(greatest(avg(bad / n), 0.001), 0.999) AS mean, var_pop(bad / n) AS var, avg(1.0 / n) AS inverse FROM h),
e AS (SELECT mean, greatest(mean * (1 - mean) / greatest(var - mean * (1 - mean) * inverse, mean * (1 - mean) / 1000) - 1, 1) AS strength FROM s),
v AS (SELECT source, (bad + mean * strength) / (n + strength) > mean + 0.25::DOUBLE * sqrt(mean * (1 - mean) / (strength + 1)) AS bad_host FROM h, e)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (soft_failed AND bad_host) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source""",
    "op11_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j, len(ws) AS n FROM w),
p AS (SELECT doc_id, j, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS own FROM e),
k AS (SELECT doc_id, j, row_number() OVER (PARTITION BY own ORDER BY doc_id, j) AS place FROM p WHERE j <= n - 19),
gone AS (SELECT DISTINCT doc_id, unnest(range(j, j + 20)) AS j FROM k WHERE place > 1),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM e ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op12_spelling_variants": rf"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
  lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::UBIGINT] ELSE [(192 + (unicode(c) >> 6))::UBIGINT, (128 + (unicode(c) & 63))::UBIGINT] END)) AS b FROM r GROUP BY doc_id, run),
h AS (SELECT run, n, {_CRC} AS h FROM d, crc_table),
m AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
k AS (SELECT word, n, 0 AS i, word AS key FROM v UNION ALL SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM k a JOIN k b ON a.key = b.key AND a.word <> b.word AND (a.i = b.i OR a.i = 0 OR b.i = 0)),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL),
roots AS (SELECT walk.word, walk.at AS root FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NULL)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN roots USING (word)""",
    "op13_conversation_repair": rf"""
WITH RECURSIVE {_CRC_TABLE},
s AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: unicode(c)::UBIGINT) AS b FROM conversations),
c AS (SELECT conv_id, turn, role, text, {_CRC} % 20 AS kind FROM s, crc_table),
g AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS ended FROM g),
x AS (SELECT *, CASE WHEN ended = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  role[1] AS i, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY k) || role[1] AS pair FROM o),
ways(q, i, e, cost, to_q) AS (SELECT q, '*', 'D', 4, q FROM range(4) t(q) UNION ALL SELECT q, '*', 'R', 3, CASE q WHEN 2 THEN 3 ELSE 2 END FROM range(4) t(q)
  UNION ALL VALUES (0, 's', 'K', 0, 1), (0, 'u', 'K', 0, 2), (1, 'u', 'K', 0, 2), (2, 'a', 'K', 0, 3), (3, 'u', 'K', 0, 2)),
added(q, more, cost, to_q) AS (SELECT q, '', 0, q FROM range(4) t(q) UNION ALL SELECT q, 'I', 3, CASE q WHEN 2 THEN 3 ELSE 2 END FROM range(4) t(q) UNION ALL SELECT q, 'II', 6, CASE q WHEN 2 THEN 2 ELSE 3 END FROM range(4) t(q)),
dp AS (SELECT conv_id, 0::BIGINT AS k, added.to_q AS q, min((added.cost, more)) AS best FROM (SELECT DISTINCT conv_id FROM x) JOIN added ON added.q = 0 GROUP BY conv_id, added.to_q
  UNION ALL SELECT dp.conv_id, x.k, added.to_q, min((dp.best[1] + ways.cost + CASE WHEN x.fault = 'truncated' AND ways.e <> 'D' THEN 3 ELSE 0 END + added.cost, dp.best[2] || ways.e || more))
  FROM dp JOIN x ON x.conv_id IS NOT DISTINCT FROM dp.conv_id AND x.k = dp.k + 1 JOIN ways ON ways.q = dp.q AND (ways.i = '*' OR ways.i = x.i) AND (ways.e = 'D' OR x.fault NOT IN ('blank', 'duplicate')) JOIN added ON added.q = ways.to_q
  GROUP BY dp.conv_id, x.k, added.to_q),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY conv_id),
won AS (SELECT n.*, b.best[1] AS cost, b.best[2] AS audit FROM n JOIN (SELECT dp.conv_id, min(best) AS best FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.k = n.n WHERE q IN (0, 3) GROUP BY dp.conv_id) b ON b.conv_id IS NOT DISTINCT FROM n.conv_id),
letters AS (SELECT conv_id, length(replace(audit, 'D', '')) % 2 AS odd, unnest(string_split(audit, '')) AS e, unnest(range(1, length(audit) + 1)) AS i FROM won WHERE audit <> ''),
told AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS k, count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id ORDER BY i) AS p FROM letters),
rebuilt AS (SELECT t.conv_id, string_agg(CASE WHEN e = 'K' THEN x.role WHEN (p + odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE x.text END, chr(10) ORDER BY t.i) AS body
  FROM told t LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM t.conv_id AND x.k = t.k AND t.e <> 'I' WHERE e <> 'D' GROUP BY t.conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN won ON won.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN rebuilt ON rebuilt.conv_id IS NOT DISTINCT FROM a.conv_id""",
}
