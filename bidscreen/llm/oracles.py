"""DuckDB SQL for the queries that SQL can express; tests hold the others against brute force."""

from __future__ import annotations

from bidscreen.llm.common import ASCII_LOWER, ASCII_UPPER
from bidscreen.llm.quality import RULES, STOP_WORDS, SYMBOLS

_stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
_passes = " AND ".join(" AND ".join(f"{r.measure} {op} {v!r}::DOUBLE" for op, v in ((">=", r.low), ("<=", r.high)) if v is not None) for r in RULES)
_window = " || ' ' || ".join(["x", *(f"lead(x, {k}) OVER o" for k in range(1, 8))])

QUALITY = f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT row, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM texts),
words AS (SELECT row, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM parts),
places AS (SELECT row, i, {_window} AS x FROM words WINDOW o AS (PARTITION BY row ORDER BY i)),
windows AS (SELECT row, i, count(*) OVER (PARTITION BY row, x) AS n FROM places WHERE x IS NOT NULL),
covered AS (SELECT row, count(DISTINCT j) AS n FROM (SELECT row, unnest(range(i, i + 8)) AS j FROM windows WHERE n > 1) GROUP BY row),
counted AS (SELECT p.row, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
   (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
   len(list_filter(w, lambda x: lower(x) IN ({_stop}))) AS n_stop_words, len(list_filter(l, lambda x: x = upper(x) AND x <> lower(x))) AS n_capital_lines FROM parts p LEFT JOIN covered c USING (row)),
ratios AS (SELECT *, word_chars / greatest(n_words, 1) AS mean_word_length, n_symbols / greatest(n_words, 1) AS symbols_per_word, n_stop_words / greatest(n_words, 1) AS stop_word_ratio,
   n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_capital_lines / greatest(n_lines, 1) AS capital_line_ratio, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_passes} AS kept FROM ratios"""

#: Lengths of escaped texts: a backslash doubles, and each control string gets one more character.
_escaped = "length({0}) + length({0}) - length(replace({0}, '\\', '')) + len(regexp_extract_all({0}, '</?s>|\\[/?INST\\]'))"
CHAT = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
sizes AS (SELECT *, {_escaped.format("role")} + length(role) - length(replace(role, chr(10), '')) + {_escaped.format("text")} + CASE WHEN role = 'assistant' THEN 9 ELSE 24 END AS n FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
   sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars, 0::BIGINT AS rewritten FROM sizes GROUP BY conv_id"""

URLS = f"""
WITH parts AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{ASCII_UPPER}', '{ASCII_LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
listed AS (SELECT DISTINCT host FROM parts WHERE host <> '' AND regexp_matches(html, '<title>[^<]*(###|%%%|\\*\\*\\*)')),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM parts, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM parts LEFT JOIN best USING (page_id)"""

DIVERGENCE = f"""
WITH texts AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}') AS text FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM texts),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
groups AS (SELECT DISTINCT lang, source FROM texts),
shares AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (coalesce(total, 0) + 5 * v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v)::HUGEINT AS q
   FROM groups g JOIN kept k USING (lang) JOIN langs USING (lang) LEFT JOIN totals USING (lang, source) LEFT JOIN counts USING (lang, source, term)),
differences AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN differences d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
   UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM rows) WHERE part = 'pair' OR rank <= 50"""

ORACLES: dict[str, str] = {"op2_quality_rules": QUALITY, "op6_chat_format": CHAT, "op9_url_filters": URLS, "op11_source_divergence": DIVERGENCE}
