"""Plain SQL for the queries of this package that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH folded_docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
folded_items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, p, p + 9), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM folded_items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM folded_docs, sizes WHERE len(w) >= n)),
matches AS (
  SELECT d.doc_id, d.p, d.n, i.item_id FROM doc_windows d JOIN item_windows i ON d.win = i.win AND d.n = i.n),
hits AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS word FROM matches) GROUP BY doc_id),
owners AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM matches WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM folded_docs LEFT JOIN hits USING (doc_id) LEFT JOIN owners USING (doc_id)
"""

OP9 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 3), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS one, b.doc_id AS two, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT one, two FROM pairs JOIN sizes x ON x.doc_id = one JOIN sizes y ON y.doc_id = two
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM words
  UNION
  SELECT r.doc_id, l.other FROM reach r JOIN (SELECT one, two AS other FROM links UNION ALL SELECT two, one FROM links) l ON l.one = r.other)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

OP11 = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
drawn AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM cut),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parted AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parted
"""

# crc32 byte by byte over a table made by the rule; words one edit apart share a word that lacks one code point
OP12 = r"""
WITH RECURSIVE table_of AS (
  SELECT list_transform(range(0, 256), lambda b: list_reduce(range(0, 8),
    lambda c, step: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, CAST(b AS BIGINT))) AS tab),
runs AS (
  SELECT doc_id, run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
spelled AS (SELECT *, hex(encode(CAST(doc_id AS VARCHAR) || ':' || run)) AS bytes FROM runs),
hashed AS (
  SELECT run, c, xor(list_reduce(list_transform(range(0, length(bytes) // 2), lambda i: CAST('0x' || substr(bytes, 2 * i + 1, 2) AS BIGINT)),
    lambda crc, byte: xor(crc // 256, tab[xor(crc, byte) % 256 + 1]), 4294967295), 4294967295) AS h
  FROM spelled, table_of),
made AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
lacking AS (
  SELECT word, n, spot, substr(word, 1, spot) || substr(word, spot + 2) AS rest
  FROM (SELECT word, n, unnest(range(0, length(word))) AS spot FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM lacking a JOIN lacking b ON a.rest = b.rest AND a.spot = b.spot AND a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM lacking l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, l.word, l.n FROM lacking l JOIN words w ON l.rest = w.word),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS best_n, min_by(other, (-other_n, other)) AS best FROM near GROUP BY word),
told AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form,
    CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain(word, root) AS (
  SELECT word, word FROM told
  UNION ALL SELECT c.word, t.form FROM chain c JOIN told t ON t.word = c.root WHERE t.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n
FROM told JOIN (SELECT c.word, c.root FROM chain c JOIN told t ON t.word = c.root WHERE t.form IS NULL) USING (word)
"""

# every block of 32 words that begins at a multiple of 16 against every template, counted plainly
OP13 = r"""
WITH said AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
phrases(label, p) AS (VALUES ('cc-by', ['cc', 'by']), ('gpl', ['general', 'public', 'license']), ('reserved', ['all', 'rights', 'reserved'])),
templates(no, label, said) AS (VALUES
  (1, 'apache-2.0', 'licensed under the apache license version 2 0'),
  (2, 'mit', 'released under the mit license'),
  (3, 'mit', 'permission is hereby granted free of charge to any person obtaining a copy of this software'),
  (4, 'bsd', 'redistribution and use in source and binary forms with or without modification are permitted'),
  (5, 'bsd', 'licensed under the bsd license'),
  (6, 'gpl', 'this work is licensed under the gnu general public license version 3'),
  (7, 'lgpl', 'this work is licensed under the gnu lesser general public license'),
  (8, 'agpl', 'this work is licensed under the gnu affero general public license'),
  (9, 'mpl', 'this source code form is subject to the terms of the mozilla public license'),
  (10, 'cc-by', 'licensed under cc by 4 0'),
  (11, 'cc-by-sa', 'licensed under cc by sa 4 0'),
  (12, 'cc-by-nc', 'licensed under cc by nc 4 0'),
  (13, 'cc-by-nd', 'licensed under cc by nd 4 0'),
  (14, 'cc-by', 'this work is licensed under a creative commons attribution international license'),
  (15, 'cc0', 'to the extent possible under law the author has waived all copyright and related rights'),
  (16, 'unlicense', 'this is free and unencumbered software released into the public domain'),
  (17, 'reserved', 'all rights reserved')),
wanted AS (SELECT no, label, word, count(*) OVER (PARTITION BY no) AS size
  FROM (SELECT DISTINCT no, label, unnest(string_split(said, ' ')) AS word FROM templates)),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS spot, w FROM said),
places AS (
  SELECT doc_id, label, spot FROM placed JOIN phrases ON word = p[1] AND w[spot + 1: spot + len(p)] = p),
base AS (
  SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list(DISTINCT label) AS marks FROM places GROUP BY doc_id),
blocks AS (
  SELECT doc_id, no, label, size, block, count(DISTINCT word) AS held
  FROM (SELECT doc_id, word, unnest([spot // 16, spot // 16 - 1]) AS block FROM placed) JOIN wanted USING (word)
  WHERE block >= 0 GROUP BY ALL),
met AS (
  SELECT doc_id, list(DISTINCT label) AS marks, max(held / size) AS share FROM blocks WHERE 100 * held >= 80 * size GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.marks), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.marks, []), coalesce(met.marks, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM said LEFT JOIN base USING (doc_id) LEFT JOIN met USING (doc_id)
"""

ORACLE = {
    "op2_decontamination": OP2, "op9_partenum": OP9, "op11_fill_in_middle": OP11, "op12_spelling_variants": OP12, "op13_license_scan": OP13,
}
