"""DuckDB SQL for the screening queries, built from shared common table expressions."""

from __future__ import annotations

from bidscreen.operators.fields import NOTES
from bidscreen.profile import AMOUNT, LATIN, ZH


def _any(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _hits(text: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({text}, '{w}')::INT" for w in words) + ")"


def _type(text: str) -> str:
    return f"""CASE WHEN starts_with({text}, '{LATIN.header_mark}') THEN 'table_header' WHEN starts_with({text}, '{LATIN.table_mark}') THEN 'table_row'
      WHEN regexp_matches({text}, '{_any(LATIN.legal)}') THEN 'legal_ref' WHEN regexp_matches({text}, '{_any(LATIN.standard)}') THEN 'standard_ref'
      WHEN {_hits(text, LATIN.price_words)} >= 2 THEN 'price_param' WHEN {_hits(text, LATIN.tech_words)} >= 2 THEN 'tech_spec' ELSE 'normal' END"""


def note(kind: str, how: str, value: str) -> str:
    """What an overlap says."""
    cases = " ".join(f"WHEN {kind} = '{k}' AND {how} = '{h}' THEN replace('{text}', '{{}}', {value})" for (k, h), text in NOTES.items())
    return f"CASE {cases} END"


def _blocks(name: str, pairs: str, places: str) -> str:
    """Ratcliff and Obershelp's matching blocks, the longest first and then those on either side of it, as rows (pid, size) of
    `name`; pairs: pid, na, nb, the lengths of two sequences; places: pid, i, j, where they have the same element."""
    key = "pid, alo, ahi, blo, bhi"
    return f"""{name}({key}, size) AS (
   SELECT pid, 0::BIGINT, na::BIGINT, 0::BIGINT, nb::BIGINT, 0::BIGINT FROM {pairs}
   UNION ALL
   SELECT pid, side.alo, side.ahi, side.blo, side.bhi, side.size FROM (
      SELECT pid, unnest([{{'alo': alo, 'ahi': bi, 'blo': blo, 'bhi': bj, 'size': size}}, {{'alo': bi + size, 'ahi': ahi, 'blo': bj + size, 'bhi': bhi, 'size': 0}}]) AS side FROM (
         SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY size DESC, bi, bj) AS nth FROM (
            SELECT {key}, min(i) AS bi, min(j) AS bj, count(*) AS size FROM (
               SELECT r.pid, alo, ahi, blo, bhi, i, j, i - row_number() OVER (PARTITION BY r.pid, alo, ahi, blo, bhi, i - j ORDER BY i) AS island
               FROM {name} r JOIN {places} m ON m.pid = r.pid AND i >= alo AND i < ahi AND j >= blo AND j < bhi)
            GROUP BY {key}, i - j, island)) WHERE nth = 1))"""


PARAGRAPHS = f"""
split_up AS (SELECT source AS task_id, doc_id, string_split_regex(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n+') AS parts FROM documents),
raw AS (SELECT task_id, doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS pos FROM split_up),
body AS (SELECT task_id, doc_id, pos, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS body FROM raw),
titled AS (SELECT *, CASE WHEN length(body) <= {LATIN.max_title} AND regexp_matches(body, '{_any(LATIN.sections)}') THEN body END AS title, {_type("body")} AS chunk_type FROM body WHERE body <> ''),
paras AS (SELECT *, coalesce(last_value(title IGNORE NULLS) OVER (PARTITION BY task_id, doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM titled)"""

CHUNKS = f"""{PARAGRAPHS},
marked AS (SELECT *, length(body) < CASE WHEN chunk_type IN ('legal_ref', 'standard_ref') THEN {LATIN.min_chars_refs} ELSE {LATIN.min_chars} END AS short FROM paras),
flagged AS (SELECT *, CASE WHEN short AND lag(short, 1, FALSE) OVER w AND lag(section) OVER w = section THEN 0 ELSE 1 END AS new_run FROM marked WINDOW w AS (PARTITION BY task_id, doc_id ORDER BY pos)),
runs AS (SELECT *, sum(new_run) OVER (PARTITION BY task_id, doc_id ORDER BY pos) AS run FROM flagged),
parted AS (SELECT *, (row_number() OVER (PARTITION BY task_id, doc_id, run ORDER BY pos) - 1) // {LATIN.list_items} AS part FROM runs),
merged AS (SELECT task_id, doc_id, run, part, min(pos) AS pos, min(section) AS section, bool_or(short) AS short, string_agg(body, chr(10) ORDER BY pos) AS body FROM parted GROUP BY ALL),
sentences AS (SELECT *, list_filter(string_split(regexp_replace(body, '([.!?])', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '') AS parts FROM merged),
packed AS (SELECT *, list_reduce(list_transform(parts, lambda s: {{'done': []::VARCHAR[], 'open': s}}), lambda a, x:
   CASE WHEN length(a.open) + length(x.open) <= {LATIN.window} THEN {{'done': a.done, 'open': a.open || x.open}} ELSE {{'done': list_append(a.done, a.open), 'open': x.open}} END) AS state FROM sentences),
texts AS (SELECT task_id, doc_id, pos, section, CASE WHEN short THEN list_filter([body], lambda t: length(t) >= {LATIN.min_merged})
   WHEN length(body) > {LATIN.max_chars} THEN list_filter(list_transform(list_append(state.done, state.open), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda t: length(t) >= {LATIN.min_merged}) ELSE [body] END AS texts FROM packed),
exploded AS (SELECT task_id, doc_id, pos, section, unnest(texts) AS text, generate_subscripts(texts, 1) AS sub FROM texts),
numbered AS (SELECT *, row_number() OVER (PARTITION BY task_id, doc_id ORDER BY pos, sub) - 1 AS chunk_index FROM exploded),
chunks AS (SELECT task_id, doc_id, doc_id || '_chunk_' || printf('%04d', chunk_index) || '_' || substr(md5(doc_id || ':' || chunk_index || ':' || substr(text, 1, 50)), 1, 8) AS chunk_id, chunk_index, text, section AS section_title,
   {_type("text")} AS chunk_type, length(text) AS char_count, regexp_matches(text, '{_any(LATIN.legal + LATIN.standard)}') AS is_whitelisted FROM numbered)"""

FIELDS = f"""
found AS (SELECT source AS task_id, doc_id, [{{'t': 'phone', 'v': regexp_extract_all(text, '{LATIN.phone}')}}, {{'t': 'email', 'v': list_transform(regexp_extract_all(text, '{LATIN.email}'), lambda x: lower(x))}},
   {{'t': 'company', 'v': regexp_extract_all(text, '{LATIN.company}')}}, {{'t': 'project', 'v': regexp_extract_all(text, '{LATIN.project}')}},
   {{'t': 'person', 'v': regexp_extract_all(text, '{LATIN.persons[0]}', 1)}}, {{'t': 'team_member', 'v': regexp_extract_all(text, '{LATIN.team[0]}', 1)}}] AS f FROM documents),
one AS (SELECT task_id, doc_id, unnest(f) AS f FROM found),
fields AS (SELECT DISTINCT task_id, doc_id, field_type, value FROM (SELECT task_id, doc_id, f.t AS field_type, unnest(f.v) AS value FROM one))"""

OVERLAPS = f"""{FIELDS},
shared_fields AS (SELECT a.task_id, a.doc_id AS doc_a, b.doc_id AS doc_b, a.field_type, a.value FROM fields a JOIN fields b ON a.task_id = b.task_id AND a.field_type = b.field_type AND a.value = b.value AND a.doc_id < b.doc_id
   WHERE a.field_type <> 'project')"""

FUZZY = f"""{OVERLAPS},
field_values AS (SELECT DISTINCT task_id, field_type, value FROM fields WHERE field_type IN ('phone', 'person', 'company', 'team_member')),
value_pairs AS (SELECT DISTINCT a.value AS value_a, b.value AS value_b, a.value || chr(1) || b.value AS pid, length(a.value) AS na, length(b.value) AS nb FROM field_values a JOIN field_values b ON a.task_id = b.task_id AND a.field_type = b.field_type AND a.value <> b.value
   WHERE 2 * least(length(a.value), length(b.value)) >= {LATIN.fuzzy} * (length(a.value) + length(b.value)) - 1e-9),
value_places AS (SELECT pid, i, j FROM (SELECT pid, value_a, value_b, i, unnest(range(nb)) AS j FROM (SELECT *, unnest(range(na)) AS i FROM value_pairs)) WHERE substr(value_a, i + 1, 1) = substr(value_b, j + 1, 1)),
{_blocks("value_blocks", "value_pairs", "value_places")},
alike_values AS (SELECT value_a, value_b FROM value_pairs JOIN value_blocks USING (pid) GROUP BY value_a, value_b, na, nb HAVING 2 * sum(size) / (na + nb) >= {LATIN.fuzzy}),
fuzzy AS (SELECT a.task_id, a.doc_id AS doc_a, b.doc_id AS doc_b, a.field_type, a.value AS value_a, b.value AS value_b FROM alike_values v JOIN fields a ON a.value = v.value_a JOIN fields b ON b.value = v.value_b AND a.task_id = b.task_id AND a.field_type = b.field_type AND a.doc_id < b.doc_id
   WHERE a.field_type IN ('phone', 'person', 'company', 'team_member'))"""

RARE = f"""
words AS (SELECT source AS task_id, doc_id, regexp_extract_all(lower(text), '{LATIN.gram_run}') AS w FROM documents),
places AS (SELECT task_id, doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM words),
shingles AS (SELECT task_id, doc_id, x || ' ' || lead(x, 1) OVER p || ' ' || lead(x, 2) OVER p AS token FROM places WINDOW p AS (PARTITION BY task_id, doc_id ORDER BY i)),
grams AS (SELECT task_id, doc_id, token, count(*) AS freq FROM shingles WHERE token IS NOT NULL GROUP BY ALL HAVING count(*) <= {LATIN.rare_count}),
numbers AS (SELECT task_id, doc_id, token, count(*) AS freq FROM (SELECT source AS task_id, doc_id, unnest(regexp_extract_all(text, '{LATIN.quantity}')) AS token FROM documents) GROUP BY ALL),
tokens AS (SELECT *, '4gram' AS token_type FROM grams UNION ALL SELECT *, 'number_unit' FROM numbers),
rare AS (SELECT a.task_id, a.doc_id AS doc_a, b.doc_id AS doc_b, a.token, a.freq AS freq_in_a, b.freq AS freq_in_b, a.token_type FROM tokens a JOIN tokens b ON a.task_id = b.task_id AND a.token = b.token AND a.token_type = b.token_type AND a.doc_id < b.doc_id)"""

_amount = "cast(replace(regexp_extract(m, '(\\d+(?:,\\d{3})*(?:\\.\\d+)?)', 1), ',', '') AS DOUBLE) * CASE WHEN m LIKE '%万元' THEN 1e4 WHEN m LIKE '%亿元' THEN 1e8 ELSE 1.0 END"
BIDS = f"""
lines AS (SELECT l_partkey AS task_id, l_suppkey AS doc_id, '合计：' || cast(round(l_extendedprice) AS BIGINT) || '元' AS text FROM lineitem),
amounts AS (SELECT task_id, doc_id, text, unnest(list_filter(list_transform(regexp_extract_all(text, '{AMOUNT}'), lambda m: {_amount}), lambda v: v >= {ZH.min_amount})) AS amount FROM lines),
totals AS (SELECT task_id, doc_id, max(amount) AS total FROM amounts GROUP BY ALL)"""

WEIGHTS = f"""{CHUNKS},
tokens AS (SELECT task_id, doc_id, chunk_id, chunk_index, unnest(list_filter(regexp_extract_all(lower(text), '{LATIN.token}'), lambda t: length(t) >= 2)) AS term FROM chunks),
tf AS (SELECT task_id, doc_id, chunk_id, chunk_index, term, count(*) AS tf FROM tokens GROUP BY ALL),
df AS (SELECT task_id, term, count(*) AS df FROM tf GROUP BY ALL),
n AS (SELECT task_id, count(*) AS n_chunks FROM chunks GROUP BY ALL),
weights AS (SELECT tf.*, df.df, tf * (ln((n_chunks + 1) / (df + 1)) + 1) AS weight FROM tf JOIN df USING (task_id, term) JOIN n USING (task_id))"""

_stop = ", ".join(f"'{w}'" for w in LATIN.stop_words)
KEYWORDS = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY task_id, chunk_id ORDER BY round(weight, 9) DESC, term) AS rank FROM weights),
keywords AS (SELECT task_id, chunk_id, list(term ORDER BY term) AS keywords FROM ranked WHERE rank <= 20 AND term NOT IN ({_stop}) GROUP BY ALL)"""

CANDIDATES = f"""{WEIGHTS},
lengths AS (SELECT task_id, chunk_id, sqrt(sum(weight * weight)) AS length FROM weights GROUP BY ALL),
units AS (SELECT task_id, doc_id, chunk_id, term, weight / length AS w FROM weights JOIN lengths USING (task_id, chunk_id)),
half AS (SELECT a.task_id, a.chunk_id AS q, b.chunk_id AS h, round(sum(a.w * b.w), 9) AS similarity FROM units a JOIN units b ON a.task_id = b.task_id AND a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL HAVING round(sum(a.w * b.w), 9) >= 0.55),
near AS (SELECT * FROM half UNION ALL SELECT task_id, h, q, similarity FROM half),
ends AS (SELECT task_id, max(doc_id) AS last_doc, count(DISTINCT doc_id) AS n_docs FROM chunks GROUP BY ALL),
hits AS (SELECT near.*, a.doc_id AS ord_q, a.chunk_index AS index_q, row_number() OVER (PARTITION BY near.task_id, q ORDER BY round(similarity, 9) DESC, b.doc_id, b.chunk_index) AS rank
   FROM near JOIN chunks a ON a.task_id = near.task_id AND a.chunk_id = q JOIN chunks b ON b.task_id = near.task_id AND b.chunk_id = h JOIN ends ON ends.task_id = near.task_id
   WHERE NOT a.is_whitelisted AND n_docs > 1 AND a.doc_id < last_doc),
once AS (SELECT *, row_number() OVER (PARTITION BY task_id, least(q, h), greatest(q, h) ORDER BY ord_q, index_q, rank) AS nth FROM hits WHERE rank <= 10),
candidates AS (SELECT task_id, q AS chunk_a, h AS chunk_b, similarity FROM once WHERE nth = 1)"""

SCORED = f"""{CANDIDATES}, {KEYWORDS},
joined AS (SELECT c.*, substr(md5(chunk_a || ':' || chunk_b), 1, 12) AS pair_id, a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, a.chunk_index AS index_a, a.section_title AS section_a, b.section_title AS section_b, a.text AS text_a, b.text AS text_b,
   a.is_whitelisted OR b.is_whitelisted AS listed, coalesce(len(list_intersect(ka.keywords, kb.keywords)) / (len(ka.keywords) + len(kb.keywords) - len(list_intersect(ka.keywords, kb.keywords))), 0.0) AS keyword_overlap,
   CASE WHEN a.section_title <> '' AND a.section_title = b.section_title THEN 0.1 ELSE 0.0 END + CASE WHEN a.chunk_type = 'tech_spec' AND b.chunk_type = 'tech_spec' THEN 0.05 ELSE 0.0 END AS bonus
   FROM candidates c JOIN chunks a ON a.task_id = c.task_id AND a.chunk_id = chunk_a JOIN chunks b ON b.task_id = c.task_id AND b.chunk_id = chunk_b
   LEFT JOIN keywords ka ON ka.task_id = c.task_id AND ka.chunk_id = chunk_a LEFT JOIN keywords kb ON kb.task_id = c.task_id AND kb.chunk_id = chunk_b),
rawed AS (SELECT *, cast(bonus AS DOUBLE) AS context_bonus, (similarity * 0.6::DOUBLE + keyword_overlap * 0.25::DOUBLE + cast(bonus AS DOUBLE) * 0.15::DOUBLE) * 100 * CASE WHEN listed THEN 0.5::DOUBLE ELSE 1 END AS raw FROM joined),
scored AS (SELECT *, round(raw, 2) AS base_risk_score, CASE WHEN raw >= 85 THEN 'high' WHEN raw >= 65 THEN 'medium' WHEN raw >= 45 THEN 'low' ELSE 'none' END AS risk_level FROM rawed),
above AS (SELECT * FROM scored WHERE base_risk_score >= 45),
counts AS (SELECT task_id, doc_id, count(*) AS n_chunks FROM chunks GROUP BY ALL)"""

TEXT_RISK = f"""{SCORED},
by_task AS (SELECT task_id, count(DISTINCT CASE WHEN risk_level <> 'none' THEN chunk_a END) AS covered, count(*) FILTER (risk_level = 'high') AS n_high, count(*) FILTER (risk_level = 'medium') AS n_medium, count(*) FILTER (risk_level = 'low') AS n_low, count(*) AS n_pairs FROM above GROUP BY ALL),
firsts AS (SELECT task_id, arg_min(n_chunks, doc_id) AS n_chunks FROM counts GROUP BY ALL),
rates AS (SELECT task_id, coalesce(n_high, 0) AS n_high, coalesce(n_medium, 0) AS n_medium, coalesce(n_low, 0) AS n_low, coalesce(n_pairs, 0) AS n_pairs, CASE WHEN n_chunks > 0 THEN coalesce(covered, 0) / n_chunks ELSE 0.0 END AS rate, CASE WHEN n_pairs > 0 THEN n_high / n_pairs ELSE 0.0 END AS share FROM firsts LEFT JOIN by_task USING (task_id)),
text_risk AS (SELECT task_id, n_high, n_medium, n_low, n_pairs, CASE WHEN rate >= 0.3 OR share >= 0.05 THEN 'high' WHEN rate >= 0.15 OR (n_high >= 1 AND n_medium >= 3) THEN 'medium' ELSE 'low' END AS text_level, round(rate, 4) AS text_rate FROM rates)"""

_titles = """
titles AS (SELECT DISTINCT task_id, doc_id, body AS title FROM paras),
sizes AS (SELECT task_id, doc_id, count(*) AS n FROM titles GROUP BY ALL),
shared AS (SELECT a.task_id, a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS common FROM titles a JOIN titles b ON a.task_id = b.task_id AND a.title = b.title AND a.doc_id < b.doc_id GROUP BY ALL)"""
TITLES = f"{PARAGRAPHS},{_titles}"

_structure = f"""
seq AS (SELECT task_id, doc_id, body AS title, row_number() OVER (PARTITION BY task_id, doc_id ORDER BY pos) - 1 AS i FROM paras),
lens AS (SELECT task_id, doc_id, count(*) AS n FROM seq GROUP BY ALL),
title_pairs AS (SELECT s.*, concat_ws(':', s.task_id, doc_a, doc_b) AS pid, a.n AS na, b.n AS nb, da.n AS set_a, db.n AS set_b FROM shared s JOIN lens a ON a.task_id = s.task_id AND a.doc_id = doc_a JOIN lens b ON b.task_id = s.task_id AND b.doc_id = doc_b
   JOIN sizes da ON da.task_id = s.task_id AND da.doc_id = doc_a JOIN sizes db ON db.task_id = s.task_id AND db.doc_id = doc_b),
title_places AS (SELECT concat_ws(':', a.task_id, a.doc_id, b.doc_id) AS pid, a.i, b.i AS j FROM seq a JOIN seq b ON a.task_id = b.task_id AND a.title = b.title AND a.doc_id < b.doc_id),
{_blocks("title_blocks", "title_pairs", "title_places")},
structure AS (SELECT task_id, doc_a, doc_b, common / (set_a + set_b - common) AS jaccard, 2 * sum(size) / (na + nb) AS ratio, sum(size)::INT AS n_matched FROM title_pairs JOIN title_blocks USING (pid) GROUP BY task_id, doc_a, doc_b, common, set_a, set_b, na, nb),
structured AS (SELECT *, round((jaccard * 0.5::DOUBLE + ratio * 0.5::DOUBLE) * 100, 2) AS overall_score FROM structure)"""

COMPOSITE = f"""{TEXT_RISK}, {FUZZY}, {_titles}, {_structure}, {RARE.replace("words AS", "rwords AS").replace("FROM words", "FROM rwords").replace("tokens AS", "rtokens AS").replace("FROM tokens a JOIN tokens b", "FROM rtokens a JOIN rtokens b")},
pair_text AS (SELECT a.task_id, least(doc_id_a, doc_id_b) AS doc_a, greatest(doc_id_a, doc_id_b) AS doc_b, count(DISTINCT CASE WHEN risk_level <> 'none' THEN chunk_a END) AS covered, count(*) FILTER (risk_level = 'high') AS n_high, count(*) FILTER (risk_level = 'medium') AS n_medium, count(*) AS n FROM above a GROUP BY ALL),
pair_rate AS (SELECT p.*, CASE WHEN n_chunks > 0 THEN covered / n_chunks ELSE 0.0 END AS rate, n_high / n AS share FROM pair_text p LEFT JOIN counts c ON c.task_id = p.task_id AND c.doc_id = p.doc_a),
text_signal AS (SELECT task_id, doc_a, doc_b, CASE WHEN rate >= 0.3 OR share >= 0.05 THEN 'high' WHEN rate >= 0.15 OR (n_high >= 1 AND n_medium >= 3) THEN 'medium' ELSE 'low' END AS text_level, round(rate, 4) AS text_rate FROM pair_rate),
field_signal AS (SELECT task_id, doc_a, doc_b, count(*) FILTER (field_type IN ('phone', 'email')) AS contacts, count(*) FILTER (field_type IN ('person', 'team_member')) AS people FROM shared_fields GROUP BY ALL),
rare_signal AS (SELECT task_id, doc_a, doc_b, count(*) AS matches FROM rare GROUP BY ALL),
fuzzy_signal AS (SELECT task_id, doc_a, doc_b, count(*) AS resemblances FROM fuzzy GROUP BY ALL),
all_pairs AS (SELECT task_id, doc_a, doc_b FROM text_signal UNION SELECT task_id, doc_a, doc_b FROM field_signal UNION SELECT task_id, doc_a, doc_b FROM rare_signal UNION SELECT task_id, doc_a, doc_b FROM fuzzy_signal UNION SELECT task_id, doc_a, doc_b FROM structured),
signals AS (SELECT p.*, coalesce(text_level, 'low') AS text_level, coalesce(text_rate, 0.0) AS text_rate, coalesce(contacts, 0) AS contacts, coalesce(people, 0) AS people, coalesce(matches, 0) AS matches,
   coalesce(overall_score >= 70 AND text_rate >= 0.3, FALSE) AS strong, coalesce(overall_score >= 50 AND resemblances > 0 AND NOT (overall_score >= 70 AND coalesce(text_rate, 0.0) >= 0.3), FALSE) AS alike
   FROM all_pairs p LEFT JOIN text_signal USING (task_id, doc_a, doc_b) LEFT JOIN field_signal USING (task_id, doc_a, doc_b) LEFT JOIN rare_signal USING (task_id, doc_a, doc_b) LEFT JOIN fuzzy_signal USING (task_id, doc_a, doc_b) LEFT JOIN structured USING (task_id, doc_a, doc_b)),
composite AS (SELECT *, CASE WHEN contacts > 0 OR people > 0 OR matches >= 2 OR strong THEN 'high' WHEN matches = 1 OR alike THEN CASE WHEN text_level = 'high' THEN 'high' ELSE 'medium' END ELSE text_level END AS final_level FROM signals)"""

META = """
files AS (SELECT event_type AS task_id, event_id AS doc_id, cast(user_id AS VARCHAR) AS author, ts FROM events),
pairs AS (SELECT a.task_id, a.doc_id AS doc_a, b.doc_id AS doc_b, a.author = b.author AS same_author, abs(epoch_us(a.ts) - epoch_us(b.ts)) / 60e6 AS gap FROM files a JOIN files b ON a.task_id = b.task_id AND a.doc_id < b.doc_id
   WHERE a.author = b.author OR abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 1800000000)"""

PAGES = """
kept AS (SELECT conv_id AS doc_id, turn AS page_num, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS text FROM conversations),
pages AS (SELECT * FROM kept WHERE text <> ''),
page_map AS (SELECT doc_id, page_num, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM pages),
whole AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_num) AS text FROM pages GROUP BY ALL)"""

ORACLES = {
    "paragraphs": f"WITH {PARAGRAPHS} SELECT task_id, doc_id, pos, length(body) AS n_chars, section, chunk_type FROM paras",
    "chunks": f"WITH {CHUNKS} SELECT task_id, doc_id, chunk_id, chunk_index, md5(text) AS text_md5, section_title, chunk_type, char_count, is_whitelisted FROM chunks",
    "sliding_windows": f"WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - {ZH.window}) / {ZH.step})::BIGINT, 0) + 1)) AS n FROM documents WHERE length(text) > 0) SELECT doc_id, n, md5(substr(text, n * {ZH.step} + 1, {ZH.window})) AS piece_md5 FROM w",
    "key_fields": f"WITH {FIELDS} SELECT * FROM fields",
    "key_fields_wide": f"WITH {FIELDS} SELECT task_id, doc_id, coalesce(string_agg(value, '|' ORDER BY value) FILTER (field_type = 'phone'), '') AS phones, coalesce(string_agg(value, '|' ORDER BY value) FILTER (field_type = 'email'), '') AS emails, coalesce(string_agg(value, '|' ORDER BY value) FILTER (field_type = 'company'), '') AS companies FROM fields GROUP BY ALL",
    "exact_overlaps": f"WITH {OVERLAPS} SELECT task_id, doc_a, doc_b, field_type, value AS value_a FROM shared_fields",
    "all_overlaps": f"""WITH RECURSIVE {FUZZY} SELECT task_id, doc_a, doc_b, field_type, value AS value_a, value AS value_b, 'exact' AS overlap_type, {note("field_type", "'exact'", "value")} AS risk_note FROM shared_fields
       UNION ALL SELECT *, 'fuzzy', {note("field_type", "'fuzzy'", "value_a || ' / ' || value_b")} FROM fuzzy""",
    "rare_matches": f"WITH {RARE} SELECT * FROM rare",
    "rare_signal": f"WITH {RARE} SELECT task_id, doc_a, doc_b, count(*) AS total_match_count, CASE WHEN count(*) >= 2 THEN 'high' ELSE 'medium' END AS rare_level, md5(string_agg(token, '|' ORDER BY token_type, token)) AS tokens_md5, coalesce(string_agg(token, '|' ORDER BY token) FILTER (token_type = 'number_unit'), '') AS numbers FROM rare GROUP BY ALL",
    "rare_classes": f"""WITH {RARE}, sets AS (SELECT task_id, doc_id, string_agg(token_type || ':' || token, '|' ORDER BY token_type, token) AS s, count(*) AS n FROM tokens GROUP BY ALL),
       members AS (SELECT task_id, doc_id, n, min(doc_id) OVER (PARTITION BY task_id, s) AS class, count(*) OVER (PARTITION BY task_id, s) AS size FROM sets)
       SELECT task_id, 'member' AS part, class AS a, doc_id AS b, n AS total_match_count, 'none' AS rare_level FROM members
       UNION ALL SELECT task_id, 'link', class, class, n, CASE WHEN n >= 2 THEN 'high' ELSE 'medium' END FROM members WHERE size > 1 AND class = doc_id
       UNION ALL SELECT r.task_id, 'link', doc_a, doc_b, count(*), CASE WHEN count(*) >= 2 THEN 'high' ELSE 'medium' END FROM rare r JOIN members x ON x.task_id = r.task_id AND x.doc_id = doc_a AND x.class = doc_a JOIN members y ON y.task_id = r.task_id AND y.doc_id = doc_b AND y.class = doc_b GROUP BY r.task_id, doc_a, doc_b""",
    "price_totals": f"WITH {BIDS} SELECT * FROM totals",
    "price_items": f"WITH {BIDS} SELECT task_id, doc_id, substr(text, 1, 40) AS label, amount, count(*) AS n FROM amounts GROUP BY ALL",
    "price_signal": f"""WITH {BIDS}, pairs AS (SELECT a.task_id, a.doc_id AS doc_a, b.doc_id AS doc_b, a.total AS total_a, b.total AS total_b, abs(a.total - b.total) / greatest(a.total, b.total) AS p FROM totals a JOIN totals b ON a.task_id = b.task_id AND a.doc_id < b.doc_id)
       SELECT task_id, doc_a, doc_b, total_a, total_b, round(p, 6) AS proximity, CASE WHEN p <= 0.01 THEN 'high' ELSE 'medium' END AS price_level FROM pairs WHERE p <= 0.05""",
    "meta_signal": f"WITH {META} SELECT task_id, doc_a, doc_b, same_author, round(gap * 60e6)::BIGINT AS time_gap_us, gap <= 30 AS is_timestamp_clustered, CASE WHEN same_author THEN 'high' ELSE 'medium' END AS meta_level FROM pairs",
    "paged_text": f'WITH {PAGES} SELECT m.doc_id, "offset", page_num, md5(text) AS text_md5 FROM page_map m JOIN whole USING (doc_id)',
    "page_lookup": f"""WITH {PAGES}, split_up AS (SELECT doc_id, text AS whole, string_split_regex(text, '\\n+') AS parts FROM whole), raw AS (SELECT doc_id, whole, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS pos FROM split_up),
       body AS (SELECT doc_id, whole, pos, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS body FROM raw), found AS (SELECT doc_id, pos, strpos(whole, substr(body, 1, 30)) - 1 AS place FROM body WHERE body <> '')
       SELECT f.doc_id, pos, coalesce(arg_max(page_num, "offset"), 0) AS page_num FROM found f LEFT JOIN page_map m ON m.doc_id = f.doc_id AND "offset" <= place GROUP BY ALL""",
    "table_rows": """WITH lines AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, '[表格] ' || 'part:' || l_partkey || ' | flag:' || l_returnflag || ' | status:' || l_linestatus AS line FROM lineitem),
       texts AS (SELECT doc_id, '§H§order' || chr(10) || chr(10) || '§H§[表格标题] part | flag | status' || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY n, line) AS text FROM lines GROUP BY ALL) SELECT doc_id, length(text) AS n_chars, md5(text) AS text_md5 FROM texts""",
    "format_gate": """WITH p AS (SELECT page_id, lower(url || CASE page_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.xls' ELSE '' END) AS path FROM pages), s AS (SELECT page_id, coalesce(regexp_extract(path, '(\\.[^./\\\\]+)$', 1), '') AS suffix FROM p)
       SELECT page_id, CASE WHEN suffix IN ('.pdf', '.docx', '.doc', '.txt', '.text') THEN suffix ELSE '' END AS suffix, CASE WHEN suffix IN ('.pdf', '.docx', '.doc', '.txt', '.text') THEN 'accepted' ELSE 'rejected' END AS state FROM s""",
    "keywords": f"WITH {WEIGHTS}, {KEYWORDS} SELECT task_id, chunk_id, array_to_string(keywords, ' ') AS keywords FROM keywords",
    "candidate_pairs": f"WITH {CANDIDATES} SELECT task_id, chunk_a, chunk_b, round(similarity, 6) AS similarity FROM candidates",
    "vector_pairs": """WITH v AS (SELECT vec_id, vec_id % 50 AS doc, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS chunk_q, b.vec_id AS chunk_h, list_dot_product(a.e, b.e) AS s FROM v a JOIN v b ON a.doc <> b.doc),
       r AS (SELECT *, row_number() OVER (PARTITION BY chunk_q ORDER BY round(s, 9) DESC, chunk_h) AS rank FROM p WHERE s >= 0.25) SELECT chunk_q, rank, chunk_h, round(s, 6) AS similarity FROM r WHERE rank <= 10""",
    "phrase_whitelist": "WITH phrases AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS p FROM embeddings GROUP BY ALL) SELECT vec_id AS chunk_id FROM embeddings e WHERE EXISTS (SELECT 1 FROM phrases WHERE list_dot_product(e.embedding::DOUBLE[], p) >= 0.3)",
    "scored_pairs": f"WITH {SCORED} SELECT task_id, pair_id, chunk_a, chunk_b, round(keyword_overlap, 6) AS keyword_overlap, context_bonus, base_risk_score, risk_level FROM above",
    "review_queue": f"""WITH {SCORED}, queue AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY base_risk_score DESC, doc_id_a, index_a, pair_id) AS place FROM above WHERE task_id IN (SELECT task_id FROM scored GROUP BY task_id HAVING max(base_risk_score) >= 65))
       SELECT task_id, pair_id, 'doc ' || doc_id_a AS doc_a_name, 'doc ' || doc_id_b AS doc_b_name, CASE WHEN section_a = '' THEN '{LATIN.no_section}' ELSE section_a END AS section_a, CASE WHEN section_b = '' THEN '{LATIN.no_section}' ELSE section_b END AS section_b,
       md5(CASE WHEN length(text_a) > {LATIN.max_chars} THEN substr(text_a, 1, {LATIN.max_chars}) || '{LATIN.cut_mark}' ELSE text_a END) AS text_a_md5, base_risk_score FROM queue WHERE place <= 20""",
    "verdicts": """WITH v AS (SELECT doc_id, doc_id % 11 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS ok, doc_id % 31 - 15 AS step, CASE WHEN toxic = 1 THEN 'verbatim_copy' ELSE 'template_reuse' END AS kind FROM labels),
       d AS (SELECT doc_id, bool_and(ok) AS ok, min(step) AS step, min(kind) AS kind FROM v GROUP BY ALL)
       SELECT cast(doc_id AS VARCHAR) AS pair_id, CASE WHEN ok THEN 70.0 + step ELSE 70.0 END::DOUBLE AS final_score, CASE WHEN NOT ok OR 70 + step BETWEEN 65 AND 84 THEN 'medium' WHEN 70 + step >= 85 THEN 'high' ELSE 'low' END AS risk_level, CASE WHEN ok THEN kind ELSE 'normal_overlap' END AS risk_type,
       CASE WHEN ok THEN 0.8 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN ok THEN step ELSE 0 END::DOUBLE AS llm_adjustment, CASE WHEN ok THEN 'the passages agree in wording and order' ELSE 'no valid verdict: the result rests on the similarity score alone' END AS reason_zh FROM d""",
    "reviewed_pairs": f"""WITH {SCORED}, gate AS (SELECT task_id FROM scored GROUP BY task_id HAVING max(base_risk_score) >= 65),
       queue AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY base_risk_score DESC, doc_id_a, index_a, pair_id) AS nth FROM above WHERE task_id IN (SELECT task_id FROM gate)),
       v AS (SELECT doc_id, doc_id % 11 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS ok, (doc_id % 31 - 15)::DOUBLE AS step, CASE WHEN toxic = 1 THEN 'verbatim_copy' ELSE 'template_reuse' END AS kind FROM labels),
       done AS (SELECT task_id, pair_id, doc_id_a, index_a, risk_level AS old_level, coalesce(ok, FALSE) AS ok, CASE WHEN ok THEN round(base_risk_score + step, 2) ELSE base_risk_score END AS final_score, CASE WHEN ok THEN kind ELSE 'normal_overlap' END AS risk_type, CASE WHEN ok THEN step ELSE 0.0 END::DOUBLE AS llm_adjustment
          FROM queue LEFT JOIN v ON v.doc_id = doc_id_a WHERE nth <= 20
          UNION ALL SELECT task_id, pair_id, doc_id_a, index_a, risk_level, FALSE, base_risk_score, NULL, NULL FROM above WHERE task_id NOT IN (SELECT task_id FROM gate))
       SELECT task_id, pair_id, row_number() OVER (PARTITION BY task_id ORDER BY final_score DESC, doc_id_a, index_a, pair_id)::INT AS place, final_score,
       CASE WHEN NOT ok THEN old_level WHEN final_score >= 85 THEN 'high' WHEN final_score >= 65 THEN 'medium' WHEN final_score >= 45 THEN 'low' ELSE 'none' END AS risk_level, risk_type, llm_adjustment FROM done""",
    "text_risk": f"WITH {TEXT_RISK} SELECT * FROM text_risk",
    "composite_risk": f"""WITH RECURSIVE {COMPOSITE} SELECT task_id, doc_a, doc_b, text_level, text_rate, contacts AS exact_phone_email_count, matches AS total_match_count, final_level, (contacts + people + (matches > 0)::INT + strong::INT + alike::INT)::INT AS n_signals FROM composite""",
    "task_report": f"""WITH RECURSIVE {COMPOSITE}, docs AS (SELECT task_id, count(*) AS n_documents FROM counts GROUP BY ALL), comp AS (SELECT task_id, count(*) AS n_composite FROM composite GROUP BY ALL)
       SELECT task_id, n_high AS high_risk_count, n_medium AS medium_risk_count, n_low AS low_risk_count, n_pairs AS total_pairs, (n_high + n_medium + n_low)::INT AS n_risk_pairs, n_documents::INT AS n_documents, coalesce(n_composite, 0)::INT AS n_composite FROM text_risk LEFT JOIN docs USING (task_id) LEFT JOIN comp USING (task_id)""",
    "task_history": "SELECT o_orderkey AS task_id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20",
    "report_lines": f"""WITH {SCORED},
        docs AS (SELECT task_id, doc_id::VARCHAR AS doc_id, count(*) AS n FROM chunks GROUP BY ALL), found AS (SELECT task_id, count(*) AS n FROM above GROUP BY ALL)
        SELECT task_id, 'task' AS kind, 0 AS place, task_id AS item, coalesce(f.n, 0) AS n, NULL::DOUBLE AS final_score, NULL AS risk_level, NULL AS text_a_md5, NULL AS text_b_md5 FROM (SELECT DISTINCT task_id FROM docs) LEFT JOIN found f USING (task_id)
        UNION ALL SELECT task_id, 'document', row_number() OVER (PARTITION BY task_id ORDER BY doc_id) - 1, doc_id, n, NULL, NULL, NULL, NULL FROM docs
        UNION ALL SELECT task_id, 'risk_pair', row_number() OVER (PARTITION BY task_id ORDER BY base_risk_score DESC, pair_id) - 1, pair_id, NULL, base_risk_score, risk_level, md5(text_a), md5(text_b) FROM above WHERE risk_level <> 'none'""",
    "task_results": f"""WITH RECURSIVE {COMPOSITE}, ranks AS (SELECT task_id, max(CASE final_level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS r FROM composite GROUP BY ALL), n AS (SELECT source AS task_id, count(DISTINCT doc_id) AS n_docs FROM documents GROUP BY ALL),
       b AS (SELECT n.task_id, n_docs, text_rate, greatest(coalesce(r, 1), CASE text_level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS best FROM n LEFT JOIN ranks USING (task_id) LEFT JOIN text_risk USING (task_id))
       SELECT task_id, CASE WHEN n_docs < 2 THEN 'error' ELSE 'done' END AS status, CASE WHEN n_docs < 2 THEN 'fewer than two documents' END AS error_message, CASE WHEN n_docs >= 2 THEN CASE best WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END END AS overall_risk_level, CASE WHEN n_docs >= 2 THEN coalesce(text_rate, 0.0) END AS similarity_rate FROM b""".replace(", n AS (SELECT source", ", nn AS (SELECT source").replace("SELECT n.task_id, n_docs", "SELECT nn.task_id, n_docs").replace("FROM n LEFT JOIN ranks", "FROM nn LEFT JOIN ranks"),
    "documents_of_task": "SELECT source AS task_id, doc_id, length(text) AS n_chars FROM documents WHERE source = 'src0'",
    "pairs_of_task": f"WITH {SCORED} SELECT pair_id, risk_level, base_risk_score AS final_score, length(substr(text_a, 1, 200)) AS n_a, section_a AS doc_a_section, '' AS reason_zh FROM above WHERE task_id = 'src0' AND risk_level = 'high'",
    "pair_rows": f"WITH {SCORED} SELECT task_id, pair_id, doc_id_a, doc_id_b, chunk_a, chunk_b, md5(text_a) AS text_a_md5, md5(text_b) AS text_b_md5, section_a AS section_title_a, section_b AS section_title_b, 0 AS page_num_a, round(similarity, 6) AS vector_similarity, base_risk_score, base_risk_score AS final_score, risk_level FROM above",
    "pairs_csv": f"WITH {SCORED} SELECT pair_id, risk_level, 'normal_overlap' AS risk_type, base_risk_score AS final_score, md5(substr(text_a, 1, 200)) AS doc_a_text_md5, md5(substr(text_b, 1, 200)) AS doc_b_text_md5, 0 AS doc_b_page FROM above WHERE risk_level <> 'none'",
    "evaluation": f"""WITH RECURSIVE {COMPOSITE}, q AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY ALL), x AS (SELECT c.final_level AS actual, CASE WHEN a.quality = 0 AND b.quality = 0 THEN 'high' ELSE 'low' END AS expected FROM composite c JOIN q a ON a.doc_id = doc_a JOIN q b ON b.doc_id = doc_b)
       SELECT expected, count(*) FILTER (actual = 'high') AS actual_high, count(*) FILTER (actual = 'medium') AS actual_medium, count(*) FILTER (actual = 'low') AS actual_low, round(avg((actual = expected)::INT), 4) AS hit_rate, count(*) AS n_pairs FROM x GROUP BY ALL""",
    "upserts": "WITH r AS (SELECT user_id AS task_id, event_type AS chunk_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT task_id, chunk_id, event_id FROM r WHERE n = 1 AND task_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)",
    "structure_signal": f"""WITH RECURSIVE {TITLES}, {_structure} SELECT task_id, doc_a, doc_b, round(jaccard, 4) AS title_jaccard, round(ratio, 4) AS sequence_similarity, n_matched, overall_score,
       CASE WHEN overall_score >= 70 THEN 'high' WHEN overall_score >= 50 THEN 'medium' WHEN overall_score >= 30 THEN 'low' ELSE 'none' END AS structure_level FROM structured""",
    "heading_structure": f"WITH {TITLES} SELECT s.task_id, doc_a, doc_b, round(common / (a.n + b.n - common), 6) AS jaccard FROM shared s JOIN sizes a ON a.task_id = s.task_id AND a.doc_id = doc_a JOIN sizes b ON b.task_id = s.task_id AND b.doc_id = doc_b",
}
ORACLES["versioned_upserts"] = ORACLES["upserts"]
