"""Equivalent DuckDB SQL of the training-data queries that SQL can express."""

SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({SMALL}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
    FROM words),
runs AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM runs a JOIN runs b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM sets s JOIN reached r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""

DECONTAMINATION = rf"""
WITH doc_words AS (SELECT doc_id, regexp_extract_all({SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (SELECT item_id, regexp_extract_all({SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
    SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS g
    FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, least(10, len(w)) AS m FROM item_words WHERE len(w) > 0))),
doc_windows AS (
    SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
    FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc_words, (SELECT DISTINCT m FROM item_windows) WHERE len(w) >= m)),
found AS (SELECT d.doc_id, d.i, d.m, t.item_id::VARCHAR AS item FROM doc_windows d JOIN item_windows t ON d.m = t.m AND d.g = t.g),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
    sha256(coalesce(t.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hits h USING (doc_id) LEFT JOIN items t USING (doc_id)
"""

CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
pieces AS (
    SELECT *, '<|im_start|>' || replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(10), '<|nl|>') || chr(10)
        || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10) AS piece FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, piece)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, piece) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(piece))::BIGINT AS formatted_chars
FROM pieces GROUP BY conv_id
"""

SPELLING = rf"""
WITH RECURSIVE crc_bits AS (
    SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS bits),
found AS (
    SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+'),
        lambda r: translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM found WHERE length(run) >= 7 GROUP BY doc_id, run),
summed AS (
    SELECT run, n, xor(4294967295, list_reduce(
        list_concat([4294967295], list_transform(range(1, length(hx), 2), lambda i: ('0x' || substr(hx, i, 2))::BIGINT)),
        lambda c, b: xor(c // 256, bits[1 + xor(c % 256, b)]))) AS h FROM runs, crc_bits),
words AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM summed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (
    SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
    SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min({{'n': -n, 'w': encode(other)}}) AS b FROM near GROUP BY word),
forms AS (
    SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.b.n >= 10 * w.n THEN decode(b.b.w) END AS form,
        CASE WHEN -b.b.n >= 10 * w.n THEN -b.b.n END::BIGINT AS form_n
    FROM words w LEFT JOIN best b USING (word)),
led AS (SELECT word, word AS at FROM forms UNION ALL SELECT l.word, f.form FROM led l JOIN forms f ON l.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, l.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN led l ON f.word = l.word JOIN forms e ON e.word = l.at AND e.form IS NULL
"""

FILTER_AUDIT = r"""
WITH t AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
d AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
        'C': 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
        'E': coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)} AS fails
    FROM t LEFT JOIN marks USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS o FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
masks AS (
    SELECT part, fails, good, toxic, count(*) AS n FROM d GROUP BY ALL),
gone AS (
    SELECT part, o, good, toxic, n, fails, list_min([CASE WHEN fails.A THEN instr(o, 'A') ELSE 6 END, CASE WHEN fails.B THEN instr(o, 'B') ELSE 6 END, CASE WHEN fails.C THEN instr(o, 'C') ELSE 6 END,
        CASE WHEN fails.D THEN instr(o, 'D') ELSE 6 END, CASE WHEN fails.E THEN instr(o, 'E') ELSE 6 END]) AS at FROM masks, orders),
steps AS (SELECT o, s, o[s] AS f FROM orders, (SELECT unnest(range(1, 6)) AS s)),
counts AS (
    SELECT g.part, s.o, s.s, s.f, sum(CASE WHEN g.at > s.s THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN g.at = s.s THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN g.at < s.s AND failing THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN failing AND many = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN g.at = s.s THEN n * good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN g.at = s.s THEN n * toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM (SELECT g.*, s.s, s.f, CASE s.f WHEN 'A' THEN fails.A WHEN 'B' THEN fails.B WHEN 'C' THEN fails.C WHEN 'D' THEN fails.D ELSE fails.E END AS failing,
            fails.A::INT + fails.B::INT + fails.C::INT + fails.D::INT + fails.E::INT AS many FROM gone g JOIN steps s ON s.o = g.o) g
        JOIN steps s ON s.o = g.o AND s.s = g.s
    GROUP BY g.part, s.o, s.s, s.f)
SELECT part, o AS filter_order, s::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counts
"""
