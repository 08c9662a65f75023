"""DuckDB SQL of the registered queries that SQL can express.

Token counts (automaton), quality rules (XXH64 buckets), secret scans (match
offsets), BPE, SimHash and alignments are not expressible there; their tests
compare with brute force.
"""

from __future__ import annotations

from flockscope.llm.url_filter import AZ, RULES

_rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

URL_FILTERS = f"""
WITH parts AS (
  SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{AZ}', '{AZ.lower()}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(verdict, rule_host, rule_path) AS (VALUES {_rules}),
pairs AS (SELECT DISTINCT host, path FROM urls),
fits AS (
  SELECT host, path, arg_max({{'rule': rule_host || rule_path, 'verdict': verdict}},
                             length(rule_host || rule_path) * 10000 + length(rule_host)) AS r
  FROM pairs JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, 'allow') AS verdict
FROM urls LEFT JOIN fits USING (host, path)
"""

CHAT = """
WITH said AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS is_chosen, turn, min({'role': role, 'text': text}) AS said
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
both_sides AS (
  SELECT coalesce(x.pair_id, y.pair_id) AS pair_id, coalesce(x.turn, y.turn) AS turn, x.said AS a, y.said AS b
  FROM (SELECT * FROM said WHERE is_chosen) x FULL JOIN (SELECT * FROM said WHERE NOT is_chosen) y
    ON x.pair_id = y.pair_id AND x.turn = y.turn),
met AS (
  SELECT *, min(CASE WHEN a IS DISTINCT FROM b THEN turn END) OVER (PARTITION BY pair_id) AS cut FROM both_sides),
parts AS (
  SELECT pair_id, turn, 'prompt' AS part, a AS said FROM met WHERE cut IS NULL OR turn < cut
  UNION ALL SELECT pair_id, turn, 'chosen', a FROM met WHERE turn >= cut AND a IS NOT NULL
  UNION ALL SELECT pair_id, turn, 'rejected', b FROM met WHERE turn >= cut AND b IS NOT NULL)
SELECT pair_id, part, turn, said.role AS role,
       '<|' || coalesce(said.role, 'unknown') || '|>' || chr(10) || coalesce(said.text, '') || chr(10) AS rendered,
       part <> 'prompt' AND coalesce(said.role = 'assistant', false) AS train
FROM parts
"""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS s FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
windows AS (
  SELECT doc_id, s, i, line, lead(i) OVER w AS i2, lead(line) OVER w AS line2 FROM numbered
  WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, s) AS nth FROM windows WHERE line2 IS NOT NULL),
alone AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, s) AS nth FROM numbered
  WHERE len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) >= 12),
gone AS (SELECT doc_id, i FROM ranked WHERE nth > 1 UNION SELECT doc_id, i2 FROM ranked WHERE nth > 1
         UNION SELECT doc_id, i FROM alone WHERE nth > 1),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
         coalesce(string_agg(CASE WHEN g.i IS NULL THEN l.line END, chr(10) ORDER BY l.i), '') AS kept_text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(kept_text) AS kept_sha256 FROM kept
"""

SUBSTRING_DEDUP = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM split),
windows AS (
  SELECT doc_id, p, array_to_string(w[p + 1:p + 13], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 12, 0))) AS p FROM split)),
repeated AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, p + o AS p FROM repeated, range(13) t(o)),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(g.p) AS n_removed,
         coalesce(string_agg(CASE WHEN g.p IS NULL THEN word END, ' ' ORDER BY x.p), '') AS kept_text
  FROM words x LEFT JOIN gone g USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept_text, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op3_url_filters": URL_FILTERS,
    "op5_substring_dedup": SUBSTRING_DEDUP,
    "op8_chat_formatting": CHAT,
    "op9_line_dedup": LINE_DEDUP,
}
