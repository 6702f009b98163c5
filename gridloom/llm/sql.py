"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escaped(text: str) -> str:
    out = rf"replace({text}, '\', '\\')"
    for c in CONTROLS:
        out = rf"replace({out}, '{c}', '{c[0]}\{c[1:]}')"
    return out


OP3 = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({escaped("role")}) + length({escaped("text")}) + length('<|im_start|><|im_end|>') + 2) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

OP7 = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT row_number() OVER () AS row, page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(r_host, r_path, said) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
met AS (
  SELECT row, r_host || r_path AS rule, said, row_number() OVER (PARTITION BY row ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS k
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(said, 'allow') AS verdict FROM parts LEFT JOIN met ON met.row = parts.row AND k = 1
"""

OP13 = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS UBIGINT)) AS bytes
  FROM conversations),
hit AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), bytes), lambda x, b:
    list_reduce(list_prepend(xor(x, b), CAST([1, 1, 1, 1, 1, 1, 1, 1] AS UBIGINT[])), lambda y, one: xor(y >> 1, CAST(3988292384 AS UBIGINT) * (y & one)))), 4294967295) % 20 AS fault
  FROM named),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit WHERE fault <> 0),
ordered AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER w AS k, lag(left(role, 1)) OVER w AS previous, rtrim(text, E' \t\n\x0b\f\r') AS shown
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
rows AS (
  SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault FROM ordered),
inserted(state, n, reached, lines) AS (VALUES
  ('', 0, '', CAST([] AS VARCHAR[])), ('', 1, 'u', ['user:']), ('', 2, 'a', ['user:', 'assistant:']), ('s', 0, 's', []), ('s', 1, 'u', ['user:']), ('s', 2, 'a', ['user:', 'assistant:']),
  ('u', 0, 'u', []), ('u', 1, 'a', ['assistant:']), ('u', 2, 'u', ['assistant:', 'user:']), ('a', 0, 'a', []), ('a', 1, 'u', ['user:']), ('a', 2, 'a', ['user:', 'assistant:'])),
edits(reached, edit, initial, state, price, role) AS (VALUES
  ('', 'D', NULL, '', 2, NULL), ('s', 'D', NULL, 's', 2, NULL), ('u', 'D', NULL, 'u', 2, NULL), ('a', 'D', NULL, 'a', 2, NULL),
  ('', 'K', 's', 's', 0, NULL), ('', 'K', 'u', 'u', 0, NULL), ('s', 'K', 'u', 'u', 0, NULL), ('a', 'K', 'u', 'u', 0, NULL), ('u', 'K', 'a', 'a', 0, NULL),
  ('', 'R', NULL, 'u', 1, 'user'), ('s', 'R', NULL, 'u', 1, 'user'), ('a', 'R', NULL, 'u', 1, 'user'), ('u', 'R', NULL, 'a', 1, 'assistant')),
macros AS (
  SELECT i.state AS before, repeat('I', n) || edit AS code, 5 * n + price AS price, edit, initial, e.state AS after, role, lines FROM inserted i JOIN edits e ON i.reached = e.reached),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, '' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM conversations
  UNION ALL
  SELECT conv_id, k, state, cost, audit, lines FROM (
    SELECT w.conv_id, r.k, m.after AS state, w.cost + m.price + CASE WHEN fault = 'truncated' AND edit <> 'D' THEN 5 ELSE 0 END AS cost, w.audit || m.code AS audit,
      list_concat(list_concat(w.lines, m.lines), CASE WHEN edit = 'D' THEN [] ELSE [coalesce(m.role, r.role) || ':' || r.text] END) AS lines
    FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.k = w.k + 1 JOIN macros m ON m.before = w.state
    WHERE (m.initial IS NULL OR m.initial = r.initial) AND (edit = 'D' OR fault NOT IN ('blank', 'duplicate')))
  QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
facts AS (
  SELECT c.conv_id, count(k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id)
SELECT f.conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, CAST(w.cost + 5 * i.n AS BIGINT) AS cost, w.audit || repeat('I', i.n) AS audit,
  sha256(array_to_string(list_concat(w.lines, i.lines), chr(10))) AS repaired_sha256
FROM facts f JOIN walk w ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.k = f.n JOIN inserted i ON i.state = w.state AND i.reached IN ('', 'a')
QUALIFY row_number() OVER (PARTITION BY f.conv_id ORDER BY w.cost + 5 * i.n, w.audit || repeat('I', i.n)) = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": OP3, "op7_url_filters": OP7, "op13_conversation_repair": OP13}
