"""SQL for DuckDB that gives the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op3_exact_dedup": f"""
WITH t AS (SELECT doc_id, {FOLDED} AS folded FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(folded) AS text_sha256
FROM t WINDOW w AS (PARTITION BY folded)""",
    "op4_jaccard_join": f"""
WITH RECURSIVE
w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({FOLDED}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * shared >= 75 * (na.n_shingles + nb.n_shingles - shared)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(any_value(n.n_shingles), 0) AS n_shingles, min(r.other) AS component_id
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op7_preference_formatting": """
WITH replies AS (
  SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS reply FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
ring AS (
  SELECT *, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS next_id FROM replies),
pairs AS (
  SELECT a.conv_id AS pair_id, a.last_turn, a.reply, b.reply AS other FROM ring a JOIN replies b ON b.conv_id = a.next_id),
turns AS (
  SELECT p.*, turn, role, text FROM pairs p JOIN conversations t ON t.conv_id = p.pair_id AND t.turn <= p.last_turn),
parts AS (
  SELECT pair_id, CASE WHEN turn < last_turn OR reply = other THEN 'prompt' ELSE 'chosen' END AS part, turn, role, text FROM turns
  UNION ALL
  SELECT pair_id, 'rejected', turn, role, other FROM turns WHERE turn = last_turn AND reply <> other)
SELECT pair_id, part, turn, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered,
  part <> 'prompt' AND role = 'assistant' AS trained
FROM parts""",
    "op9_line_windows": """
WITH d AS (SELECT DISTINCT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, unnest(range(0, greatest(len(lines) - 2, 0))) AS pos, lines FROM d),
h AS (SELECT doc_id, pos, md5(lines[pos + 1] || chr(10) || lines[pos + 2] || chr(10) || lines[pos + 3]) AS digest FROM w),
later AS (SELECT doc_id, pos FROM h QUALIFY row_number() OVER (PARTITION BY digest ORDER BY doc_id, pos) > 1),
covered AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, range(0, 3) r(k)),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM d),
flagged AS (SELECT l.*, c.pos IS NOT NULL AS gone FROM l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM flagged),
found AS (
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM runs GROUP BY doc_id)
SELECT found.* FROM documents JOIN found USING (doc_id)""",
    "op10_suffix_array_dedup": """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS bytes, strlen(coalesce(text, '')) AS n FROM documents),
strings AS (
  SELECT doc_id, unnest(range(0, n - 199)) AS pos,
    unnest(list_transform(range(0, n - 199), lambda i: md5(substr(bytes, 2 * i + 1, 400)))) AS digest
  FROM b WHERE n >= 200),
repeated AS (SELECT doc_id, pos FROM strings QUALIFY count(*) OVER (PARTITION BY digest) > 1),
opens AS (
  SELECT doc_id, pos, coalesce(pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 200, true) AS fresh FROM repeated),
runs AS (SELECT doc_id, pos, sum(fresh::int) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM opens),
spans AS (SELECT doc_id, run, min(pos) AS first, max(pos) + 200 AS last FROM runs GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, first, last, lag(last, 1, 0) OVER (PARTITION BY doc_id ORDER BY first) AS before FROM spans),
parts AS (
  SELECT g.doc_id, count(*) AS n_spans, sum(last - first) AS n_removed, max(last) AS last,
    string_agg(substr(bytes, 2 * before + 1, 2 * (first - before)), '' ORDER BY first) AS head
  FROM gaps g JOIN b ON b.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT b.doc_id, n AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(bytes, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN parts ON parts.doc_id = b.doc_id""",
    "op13_fill_in_middle": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS lines, sha256('7:' || doc_id) AS digest
  FROM documents),
h AS (
  SELECT *, len(lines) AS n, ('0x' || substr(digest, 1, 8))::BIGINT AS h1, ('0x' || substr(digest, 9, 8))::BIGINT AS h2,
    ('0x' || substr(digest, 17, 8))::BIGINT AS h3, ('0x' || substr(digest, 25, 8))::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, coalesce(array_to_string(lines[1:a], ''), '') AS prefix, coalesce(array_to_string(lines[a + 1:b], ''), '') AS middle,
    coalesce(array_to_string(lines[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p""",
}
