"""DuckDB SQL of the registered queries of this folder."""

from __future__ import annotations

from casemill.llm.queries import SHARDS, SLOTS


def _hash(text: str, salt: str) -> str:
    return f"('0x' || substr(md5('{salt}:' || {text}), 1, 15))::BIGINT"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]"


def quality(documents: str) -> str:
    """CTEs up to ``judged``: every row of the table with measures, ``base_failed`` and ``kept``."""
    return rf"""
q_docs AS (
  SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS body,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '') AS words
  FROM {documents}),
q_grams AS (
  SELECT rid, i, list_slice(words, i, i + 4) AS gram
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM q_docs)),
q_twice AS (SELECT rid, i FROM q_grams QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
q_repeats AS (SELECT rid, count(DISTINCT i + k) AS n FROM q_twice, range(5) r(k) GROUP BY rid),
q_lines AS (
  SELECT rid, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM q_docs),
q_measured AS (
  SELECT d.*, len(words) AS n_words, length(regexp_replace(body, '{SPACE}', '', 'g')) AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM q_docs d JOIN q_lines USING (rid) LEFT JOIN q_repeats r USING (rid)),
q_failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM q_measured),
q_hosts AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM q_failed GROUP BY source),
q_moments AS (
  SELECT sum(f) / sum(n) AS m, sum(n * (f / n) * (f / n)) / sum(n) AS s, count(*) / sum(n) AS h FROM q_hosts),
q_prior AS (
  SELECT m, CASE WHEN b > 0 THEN least(greatest(m * (1 - m) / b - 1, 1.0), 1e6) ELSE 1e6 END AS k
  FROM (SELECT m, greatest(s - m * m - m * (1 - m) * h, 0) AS b FROM q_moments)),
judged AS (
  SELECT q.*, NOT base_failed AND (h.f + m * k) / (h.n + k) < 0.9 AS kept
  FROM q_failed q JOIN q_hosts h ON q.source IS NOT DISTINCT FROM h.source CROSS JOIN q_prior)"""


def contamination(documents: str) -> str:
    """CTEs up to ``checked``: every row of the table with its hits."""
    words = (
        r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '%s', '%s'), "
        r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')" % (UPPER, LOWER)
    )
    return f"""
c_docs AS (SELECT *, row_number() OVER () AS rid, {words} AS words FROM {documents}),
c_items AS (SELECT item_id, {words} AS words FROM benchmark),
c_windows AS (
  SELECT DISTINCT item_id, list_slice(words, i, i + 12) AS gram
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM c_items WHERE len(words) > 0)),
c_sizes AS (SELECT DISTINCT len(gram) AS n FROM c_windows),
c_places AS (
  SELECT rid, n, i, list_slice(words, i, i + n - 1) AS gram
  FROM (SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM c_docs, c_sizes)),
c_hits AS (SELECT DISTINCT rid, i, n, item_id FROM c_places JOIN c_windows USING (gram)),
c_covered AS (
  SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT rid, i, n FROM c_hits)) GROUP BY rid),
c_found AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM c_hits) GROUP BY rid),
checked AS (
  SELECT d.*, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(words) AS contaminated
  FROM c_docs d LEFT JOIN c_covered USING (rid) LEFT JOIN c_found USING (rid))"""


#: The cheapest edits row by row: of each state the cheapest audit, then the least one.
REPAIR = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
drawn AS (
  SELECT *, list_reduce(flatten(list_transform(string_split(name, ''), lambda c: [ascii(c)::BIGINT] || [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
    4294967295::BIGINT) AS reg FROM named),
rowed AS (
  SELECT conv_id, turn, draw, unnest(CASE WHEN draw = 3 THEN [0, 1] ELSE [0] END) AS copy,
    CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, xor(reg, 4294967295) % 20 AS draw FROM drawn)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
    regexp_matches(text, '^[ 	-
]*$') AS empty, regexp_matches(text, '[.!?][ 	-
]*$') AS closed,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before
  FROM rowed WHERE draw <> 0),
faults AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE empty) AS blank, count(*) FILTER (WHERE NOT empty AND seen) AS duplicate,
    count(*) FILTER (WHERE NOT empty AND NOT seen AND NOT closed) AS truncated,
    count(*) FILTER (WHERE before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
  FROM placed GROUP BY conv_id),
inserts(s, t, k, r) AS (VALUES
  (0, 0, 0, ''), (0, 2, 1, 'user:'), (0, 3, 2, 'user:|assistant:'), (1, 1, 0, ''), (1, 2, 1, 'user:'),
  (1, 3, 2, 'user:|assistant:'), (2, 2, 0, ''), (2, 3, 1, 'assistant:'), (3, 3, 0, ''), (3, 2, 1, 'user:')),
moves(s, t, letter) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')),
steps(s, t, edit, letter, cost) AS (
  SELECT s, t, 'K', letter, 0 FROM moves UNION ALL SELECT s, t, 'R', letter, 2 FROM moves WHERE letter <> 's'
  UNION ALL SELECT s, s, 'D', NULL, 3 FROM range(4) r(s)),
walk(conv_id, i, state, cost, audit, said) AS (
  SELECT conv_id, 0::BIGINT, t, 2 * k, repeat('I', k), r
  FROM faults, inserts WHERE s = 0
  UNION ALL
  SELECT * FROM (
    SELECT w.conv_id, p.i, n.t, w.cost + m.cost + 2 * n.k + CASE WHEN m.edit <> 'D' AND NOT p.closed THEN 1 ELSE 0 END AS cost,
      w.audit || m.edit || repeat('I', n.k) AS audit,
      w.said || CASE WHEN m.edit = 'D' THEN '' ELSE '|' || p.i || CASE m.edit WHEN 'K' THEN 'k' ELSE m.letter END || '|' END || n.r
    FROM walk w JOIN placed p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i + 1
    JOIN steps m ON m.s = w.state AND (m.edit = 'D' OR NOT (p.empty OR p.seen)) AND (m.edit <> 'K' OR m.letter = p.role[1])
    JOIN inserts n ON n.s = m.t)
  QUALIFY row_number() OVER (PARTITION BY conv_id, t ORDER BY cost, audit) = 1),
chosen AS (
  SELECT w.*, f.n FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i
  WHERE state IN (0, 3) QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY cost, audit) = 1),
pieces AS (
  SELECT conv_id, unnest(parts) AS part, unnest(range(len(parts))) AS seq
  FROM (SELECT conv_id, list_filter(string_split(said, '|'), lambda x: x <> '') AS parts FROM chosen)),
lines AS (
  SELECT q.conv_id, q.seq, CASE WHEN part LIKE '%:' THEN part ELSE
    CASE right(part, 1) WHEN 'k' THEN p.role WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || p.text END AS line
  FROM pieces q LEFT JOIN placed p ON p.conv_id IS NOT DISTINCT FROM q.conv_id AND q.part NOT LIKE '%:'
    AND p.i = try_cast(left(part, length(part) - 1) AS BIGINT)),
texts AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY seq)) AS digest FROM lines GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(c.cost, 0)::BIGINT AS cost,
  coalesce(c.audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN chosen c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id"""


#: In the given pages the main text is the article element, its blocks are headings and paragraphs.
HTML_TEXT = r"""
WITH marked AS (
  SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'),
    '</?(h[1-6]|p)>', chr(1), 'g') AS body FROM pages),
plain AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(body, '<br>', ' ', 'g'), '</?b>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'),
    '&(quot;?|#34;|#x22;)', '"', 'g'), '&(#39;|#x27;)', '''', 'g'), '&amp;?', '&', 'g') AS body FROM marked),
blocks AS (
  SELECT page_id, url, list_filter(list_transform(string_split(body, chr(1)),
    lambda x: trim(regexp_replace(x, '[\s\x0B\x1C-\x1F\x85\p{Z}]+', ' ', 'g'))), lambda x: x <> '') AS parts FROM plain)
SELECT page_id, url, array_to_string(parts, chr(10)) AS text, length(array_to_string(parts, chr(10))) AS n_chars FROM blocks"""


SQL = {
    "op11_html_text": HTML_TEXT,
    "op12_repair": REPAIR,
    "op6_chat_formatting": r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + length(regexp_replace(role, '[^\\<\[\n]', '', 'g')) + 1
    + length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM said GROUP BY conv_id""",
    "op7_quality_rules": f"WITH {quality('documents')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, "
    "n_repeat_words, base_failed, kept FROM judged",
    "op8_decontamination": f"WITH {contamination('documents')} SELECT doc_id, n_words, n_hit, n_items, items_sha256, "
    "contaminated FROM checked",
    "op9_sharding": f"""
WITH RECURSIVE names(turn, shard) AS (VALUES {', '.join(f"({i}, '{s}')" for i, s in enumerate(SHARDS))}),
wishes AS (
  SELECT turn, list_transform(range({SLOTS}), lambda j:
    (({_hash('shard', 'offset')} % {SLOTS} + j * ({_hash('shard', 'skip')} % ({SLOTS} - 1) + 1)) % {SLOTS})::INTEGER) AS wish
  FROM names),
fill(t, free, slot) AS (
  SELECT 0, (SELECT list(wish ORDER BY turn) FROM wishes), NULL::INTEGER
  UNION ALL
  SELECT t + 1, list_transform(free, lambda w: list_filter(w, lambda x: x <> free[t % {len(SHARDS)} + 1][1])),
    free[t % {len(SHARDS)} + 1][1]
  FROM fill WHERE t < {SLOTS}),
slots AS (SELECT slot, shard FROM fill JOIN names ON turn = (t - 1) % {len(SHARDS)} WHERE slot IS NOT NULL)
SELECT doc_id, slot, shard
FROM (SELECT doc_id, ({_hash("coalesce(doc_id::VARCHAR, '')", 'key')} % {SLOTS})::INTEGER AS slot FROM documents)
JOIN slots USING (slot)""",
}
