"""DuckDB SQL of the corpus queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIXING = f"""
WITH sized AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size,
         md5('mix-1:' || coalesce(cast(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS words FROM sized GROUP BY source),
weighed AS (
  SELECT *, list_extract([5, 2, 1], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1) AS w
  FROM sums),
prefixes AS (
  SELECT *, sum(words) OVER () AS total, sum(w) OVER () AS all_w,
         coalesce(sum(3 * words) OVER (ORDER BY words / w, source NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         coalesce(sum(w) OVER (ORDER BY words / w, source NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_w
  FROM weighed),
level AS (
  SELECT coalesce(first((total - capped)::DOUBLE / (all_w - capped_w)::DOUBLE ORDER BY words / w, source NULLS LAST)
    FILTER (3 * words >= (total - capped)::DOUBLE / (all_w - capped_w)::DOUBLE * w), 0.0) AS level
  FROM prefixes),
shares AS (
  SELECT source, words, least((3 * words)::DOUBLE, level * w::DOUBLE) AS target FROM weighed, level),
rated AS (
  SELECT doc_id, size, words, target, CASE WHEN words > 0 THEN target / words::DOUBLE ELSE 0.0 END AS rate,
         ('0x' || substr(h, 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM sized JOIN shares ON sized.source IS NOT DISTINCT FROM shares.source)
SELECT doc_id, size, words AS source_size, target,
       ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM rated
"""

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
           + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
           + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS e_size
  FROM turns),
placed AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         sum(length(role) + 6 + e_size + 8) OVER (w ROWS UNBOUNDED PRECEDING) AS so_far
  FROM escaped WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR i = n THEN so_far END)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""

QUALITY = rf"""
WITH worded AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
windows AS (
  SELECT row, unnest(range(1, len(words) - 3)) AS i, words FROM worded WHERE len(words) >= 5),
often AS (
  SELECT row, i FROM (SELECT row, i, words[i:i + 4] AS w FROM windows)
  QUALIFY count(*) OVER (PARTITION BY row, w) > 1),
covered AS (
  SELECT row, count(DISTINCT place)::BIGINT AS n
  FROM (SELECT row, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS place FROM often) GROUP BY row),
counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
         len(list_filter(words, lambda w: regexp_matches(w, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) AS lettered,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS doubled
  FROM worded LEFT JOIN covered USING (row)),
lined AS (
  SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * doubled > 3 * n_words OR 2 * n_dup_lines > len(lines)
         OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words
         OR 2 * n_capitals > word_chars OR 2 * lettered < n_words) AS kept
FROM lined
"""

CUT = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

CONTAMINATION = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {CUT} AS words FROM documents),
items AS (
  SELECT row_number() OVER () AS item, coalesce(cast(item_id AS VARCHAR), '') AS item_id, {CUT} AS words
  FROM benchmark),
sized AS (SELECT *, least(len(words), 10) AS n FROM items WHERE len(words) > 0),
windows AS (
  SELECT DISTINCT item, n, words[s:s + n - 1] AS w
  FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS s FROM sized)),
lengths AS (SELECT DISTINCT n FROM sized),
places AS (
  SELECT row, s, n, words[s:s + n - 1] AS w
  FROM (SELECT row, n, words, unnest(range(1, len(words) - n + 2)) AS s FROM docs, lengths WHERE len(words) >= n)),
hits AS (SELECT row, s, n, item FROM places JOIN windows USING (n, w)),
hit_words AS (
  SELECT row, count(DISTINCT place)::BIGINT AS n_hit
  FROM (SELECT row, unnest(range(s, s + n)) AS place FROM hits) GROUP BY row),
hit_items AS (
  SELECT row, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT row, item_id FROM hits JOIN items USING (item)) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (row) LEFT JOIN hit_items USING (row)
"""

SUBSTRINGS = r"""
WITH pieces AS (
  SELECT row, doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS place
  FROM (SELECT row_number() OVER () AS row, doc_id,
               regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+') AS parts FROM documents)),
located AS (
  SELECT *, sum(length(part)) OVER (PARTITION BY row ORDER BY place) AS e,
         regexp_extract_all(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM pieces),
units AS (
  SELECT row, doc_id, (e - length(part))::BIGINT AS s, e::BIGINT AS e, len(words) AS n,
         array_to_string(words, ' ') AS unit, row_number() OVER (PARTITION BY row ORDER BY place) AS idx
  FROM located WHERE len(words) > 0),
ranked AS (
  SELECT *, row_number() OVER w AS nth, first(doc_id) OVER w AS first_id
  FROM units WINDOW w AS (PARTITION BY unit ORDER BY doc_id NULLS LAST, row, idx)),
together AS (
  SELECT *, idx - row_number() OVER (PARTITION BY row ORDER BY idx) AS run FROM ranked WHERE nth > 1),
going AS (SELECT *, sum(n) OVER (PARTITION BY row, run) AS run_words FROM together),
runs AS (
  SELECT *, idx - row_number() OVER (PARTITION BY row ORDER BY idx) AS last_run FROM going
  WHERE n >= 10 OR run_words >= 30)
SELECT doc_id, min(s) AS "start", max(e) AS "end", sum(n)::BIGINT AS words, arg_min(first_id, idx) AS first_id
FROM runs GROUP BY row, last_run, doc_id
"""

#: Every repeated unit.
REPEATS = SUBSTRINGS.replace("WHERE n >= 10 OR run_words >= 30", "")



NEGATIVES = """
WITH rows AS (
  SELECT row_number() OVER () AS row, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x)))),
scores AS (
  SELECT a.row AS a_row, a.vec_id AS anchor_id, b.row AS b_row, b.vec_id, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM (SELECT * FROM rows WHERE vec_id % 100 = 0) a JOIN rows b ON a.row <> b.row),
positives AS (
  SELECT a_row, anchor_id, b_row AS p_row, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY a_row ORDER BY score DESC, vec_id NULLS LAST, b_row) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w::INT AS rank, n.vec_id AS negative_id, positive_score,
       n.score AS negative_score
FROM positives p JOIN scores n ON p.a_row = n.a_row AND NOT n.same
  AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.a_row, p_row ORDER BY n.score DESC, n.vec_id NULLS LAST, n.b_row)
QUALIFY row_number() OVER w <= 10
"""

REPAIR = r"""
WITH RECURSIVE spoken AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
summed AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 20 AS harm
  FROM spoken),
harmed AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS copy
  FROM summed WHERE harm <> 0),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place FROM harmed),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY place) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY place) || left(role, 1) AS pair
  FROM placed),
counted AS (
  SELECT conv, conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (fault = 'blank')::BIGINT AS blank, count(*) FILTER (fault = 'duplicate')::BIGINT AS duplicate,
         count(*) FILTER (fault = 'truncated')::BIGINT AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
  FROM judged GROUP BY conv, conv_id),
given(state, added, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
kept(state, letter, next) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
-- What comes before a row: nothing, or one insert.  More of them never pay.
walk AS (
  SELECT conv, 0::BIGINT AS place, 0 AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM counted
  UNION ALL
  SELECT conv, place, state, best.cost, best.audit, best.lines FROM (
    SELECT conv, place, state, min({'cost': cost, 'audit': audit, 'lines': lines}) AS best FROM (
      SELECT o.conv, o.place + 1 AS place, e.state, o.cost + e.cost AS cost, o.audit || e.edit AS audit,
             o.lines || e.lines AS lines
      FROM (
        SELECT conv, place, state, cost, audit, lines FROM walk
        UNION ALL
        SELECT conv, place, g.added, cost + 2, audit || 'I', lines || [g.role || ':'] FROM walk JOIN given g USING (state)) o
      JOIN judged j ON j.conv = o.conv AND j.place = o.place + 1,
      LATERAL (
        SELECT 'D' AS edit, 3 AS cost, o.state AS state, []::VARCHAR[] AS lines
        UNION ALL
        SELECT 'K', (j.fault = 'truncated')::INT, k.next, [j.role || ':' || j.text] FROM kept k
        WHERE k.state = o.state AND k.letter = left(j.role, 1) AND j.fault NOT IN ('blank', 'duplicate')
        UNION ALL
        SELECT 'R', 2 + (j.fault = 'truncated')::INT, g.added, [g.role || ':' || j.text] FROM given g
        WHERE g.state = o.state AND j.fault NOT IN ('blank', 'duplicate')) e)
    GROUP BY conv, place, state)),
closed AS (
  SELECT w.conv, cost + CASE state WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END AS cost,
         audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
         lines || CASE state WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE []::VARCHAR[] END AS lines
  FROM walk w JOIN counted c ON w.conv = c.conv AND w.place = c.n),
repaired AS (SELECT * FROM closed QUALIFY row_number() OVER (PARTITION BY conv ORDER BY cost, audit) = 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON r.conv = c.conv
"""
