"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

#: Words as the contracts fix them, in DuckDB's regular expressions.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP3 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS t
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, t)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT ln) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln FROM d) WHERE regexp_matches(ln, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM g) WHERE c > 1)
  GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(text, '\P{Lu}+', '', 'g'))::BIGINT AS n_upper,
    length(regexp_replace(text, '[^!]+', '', 'g'))::BIGINT AS n_exclaim,
    length(regexp_replace(text, '[^0-9]+', '', 'g'))::BIGINT AS n_digits,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END + CASE WHEN n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_upper > 60 * word_chars THEN 64 ELSE 0 END + CASE WHEN 100 * n_exclaim > 60 * n_words THEN 128 ELSE 0 END
    + CASE WHEN 100 * n_digits > 50 * word_chars THEN 256 ELSE 0 END)::BIGINT AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM f
"""

OP2 = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
h AS (
  SELECT conv_id, min(conv_id) OVER (PARTITION BY role, text) AS chosen_id FROM n WHERE i = 1),
a AS (
  SELECT conv_id, max(i) AS last, max_by(text, i) FILTER (i < m) AS before
  FROM (SELECT *, max(i) OVER (PARTITION BY conv_id) AS m FROM n WHERE role = 'assistant') GROUP BY conv_id),
r AS (
  SELECT n.conv_id, n.i, n.n, n.role,
    CASE WHEN h.chosen_id = n.conv_id AND n.i = coalesce(a.last, n.n) THEN coalesce(a.before, '') ELSE n.text END AS text
  FROM n JOIN h USING (conv_id) LEFT JOIN a USING (conv_id)),
c AS (SELECT h.conv_id, n.i, n.n, n.role, n.text FROM h JOIN n ON n.conv_id = h.chosen_id),
p0 AS (
  SELECT r.conv_id, least(max(r.n), max(c.n)) AS short, max(r.n) = max(c.n) AS even,
    min(r.i) FILTER (c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text) AS differs
  FROM r JOIN c USING (conv_id, i) GROUP BY r.conv_id),
p AS (
  SELECT conv_id, CASE WHEN differs IS NOT NULL THEN differs - 1 WHEN even THEN greatest(short - 1, 0) ELSE short END AS k FROM p0),
s AS (
  SELECT r.conv_id,
    coalesce(string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY i) FILTER (i <= k), '') AS prompt,
    coalesce(string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY i) FILTER (i > k), '') AS rejected,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, '' ORDER BY i) FILTER (i > k), '') AS rejected_mask
  FROM r JOIN p USING (conv_id) GROUP BY r.conv_id),
u AS (
  SELECT c.conv_id,
    coalesce(string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY i) FILTER (i > k), '') AS chosen,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, '' ORDER BY i) FILTER (i > k), '') AS chosen_mask
  FROM c JOIN p USING (conv_id) GROUP BY c.conv_id)
SELECT h.conv_id, h.chosen_id, k::BIGINT AS n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask
FROM h JOIN p USING (conv_id) JOIN s USING (conv_id) JOIN u USING (conv_id)
"""

OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
l AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 1000) ELSE page_id END AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to
FROM l
"""

def _field(c: str) -> str:
    return f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


#: CRC-32 of the decimal id, bit by bit.
CRC = (
    "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
    "lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295)"
)

OP11 = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS g, {_leaf("n_chars")} AS leaf,
    {_leaf(f"n_chars + CASE WHEN {CRC} % 7 = 0 THEN 1 ELSE 0 END")} AS other,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n
  FROM documents),
t AS (
  SELECT g, 0 AS k, r AS i, n, leaf AS d FROM l
  UNION ALL SELECT g, k + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, k, i // 2, n),
s AS (SELECT g, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS r, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS k, r AS i, n, subroot AS d FROM s
  UNION ALL SELECT k + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY k, i // 2, n),
p AS (
  SELECT l.g, l.r, v.k, (l.r >> v.k) & 1 AS side, t.d AS sib
  FROM l JOIN (SELECT DISTINCT g, k FROM t WHERE n > 1) v USING (g) LEFT JOIN t ON t.g = l.g AND t.k = v.k AND t.i = xor(l.r >> v.k, 1)
  UNION ALL
  SELECT l.g, l.r, 100 + v.k, (s.r >> v.k) & 1, u.d
  FROM l JOIN s USING (g) JOIN (SELECT DISTINCT k FROM u WHERE n > 1) v ON true LEFT JOIN u ON u.k = v.k AND u.i = xor(s.r >> v.k, 1)),
q AS (SELECT *, row_number() OVER (PARTITION BY g, r ORDER BY k) - 1 AS j FROM p),
f AS (
  SELECT g, r, 0 AS j, other AS h FROM l
  UNION ALL
  SELECT f.g, f.r, f.j + 1, sha256(CASE WHEN sib IS NULL THEN h WHEN side = 0 THEN h || sib ELSE sib || h END)
  FROM f JOIN q ON q.g = f.g AND q.r = f.r AND q.j = f.j),
e AS (SELECT g, r, arg_max(h, j) AS folded_root FROM f GROUP BY g, r),
x AS (SELECT g, r, sha256(coalesce(string_agg(sib, '' ORDER BY j), '')) AS proof_sha256 FROM q GROUP BY g, r),
z AS (SELECT d AS root FROM u WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN s USING (g) JOIN e ON e.g = l.g AND e.r = l.r LEFT JOIN x ON x.g = l.g AND x.r = l.r JOIN z ON true
"""

ORACLE_SQL: dict[str, str] = {"op10_warc": OP10, "op11_merkle_manifest": OP11, "op2_preferences": OP2, "op3_decontaminate": OP3, "op5_quality_rules": OP5}
