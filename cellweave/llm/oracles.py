"""The queries' results as SQL, where SQL can express them."""

from __future__ import annotations

from cellweave.llm.common import UPPER_LETTERS
from cellweave.llm.host_rules import MAX_RATE
from cellweave.llm.queries import LISTED_NAMES, URL_RULES
from cellweave.llm.secrets import BASE_RULES, RULES

LOWERED = f"translate(coalesce(text, ''), '{UPPER_LETTERS}', '{UPPER_LETTERS.lower()}')"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def decontamination() -> str:
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all({LOWERED}, '{WORD}') AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, list_slice(ws, p, p + least(13, len(ws)) - 1) AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS p FROM items WHERE len(ws) > 0)
),
sizes AS (SELECT DISTINCT len(w) AS n FROM windows),
places AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, sizes WHERE len(ws) >= n),
hits AS (
  SELECT doc_id, p, n, item_id FROM (SELECT doc_id, p, n, list_slice(ws, p, p + n - 1) AS w FROM places) JOIN windows USING (w)
),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def host_rules() -> str:
    def rate(rule: str) -> str:
        return f"""SELECT greatest(2, CASE WHEN count(*) > 1 AND var_samp(({rule} + 0.5) / (n + 1)) > 0
             THEN avg(({rule} + 0.5) / (n + 1)) * (1 - avg(({rule} + 0.5) / (n + 1))) / var_samp(({rule} + 0.5) / (n + 1)) - 1
             ELSE 2 END) AS weight, avg(({rule} + 0.5) / (n + 1)) AS mean FROM hosts"""

    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACED_WORD}') AS ws FROM documents
),
triples AS (SELECT doc_id, p, list_slice(ws, p, p + 2) AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM d)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w) AS n FROM triples) WHERE n > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 3)) AS q FROM again) GROUP BY doc_id
),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '{SPACED_WORD}') GROUP BY doc_id
),
measured AS (
  SELECT d.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id)
),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS base,
         count(*) FILTER (10 * n_symbols > word_chars) AS symbols, count(*) FILTER (20 * n_dup_lines > n_words) AS dup
  FROM judged GROUP BY source
),
p1 AS ({rate("base")}), p2 AS ({rate("symbols")}), p3 AS ({rate("dup")}),
verdicts AS (
  SELECT source, greatest((base + p1.mean * p1.weight) / (n + p1.weight), (symbols + p2.mean * p2.weight) / (n + p2.weight),
                          (dup + p3.mean * p3.weight) / (n + p3.weight)) AS host_rate
  FROM hosts, p1, p2, p3
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_rate <= {MAX_RATE} AS kept
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
"""


def url_filter() -> str:
    rules = ", ".join(f"('{r}', '{v}')" for r, v in URL_RULES.items())
    names = ", ".join(f"'{n}'" for n in LISTED_NAMES)
    canonical = r"regexp_replace(host, '^www\.', '') || regexp_replace(regexp_replace(path, '\.html?$', ''), '/+$', '')"
    return f"""
WITH rules(rule, verdict) AS (VALUES {rules}),
parted AS (
  SELECT page_id, row_number() OVER () AS r,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER_LETTERS}', '{UPPER_LETTERS.lower()}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
),
listed AS (
  SELECT DISTINCT {canonical} AS entry FROM parted WHERE list_has_any(string_split(host, '.'), [{names}])
),
fits AS (
  SELECT r, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM parted JOIN rules
    ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
   AND starts_with(path, rule[instr(rule, '/'):])
  GROUP BY r
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN host <> '' AND {canonical} IN (SELECT entry FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM parted LEFT JOIN fits USING (r)
"""


def secrets() -> str:
    parts = []
    for order, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {order} AS ord, '{rule.kind}' AS kind, m[i] AS found, length(g[i]) AS tested,
       list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) AS s
FROM (SELECT doc_id, m, g, gaps, unnest(range(1, len(m) + 1)) AS i FROM (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}', 0) AS m,
         regexp_extract_all(coalesce(text, ''), '{pattern}', {rule.group}) AS g,
         string_split_regex(coalesce(text, ''), '{pattern}') AS gaps FROM documents) WHERE len(m) > 0)
WHERE tested >= {rule.least}"""
        )
    counts = ", ".join(
        f"(count(*) FILTER (ord = {i}))::BIGINT AS n_{r.kind}" for i, r in enumerate(BASE_RULES)
    )
    zeros = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE_RULES)
    named = "string_agg(kind || ':' || s::BIGINT || ':' || (s + length(found))::BIGINT, ',' ORDER BY s, ord)"
    return f"""
WITH spans AS ({" UNION ALL ".join(parts)}),
summed AS (
  SELECT doc_id, {counts}, {named} FILTER (ord < {len(BASE_RULES)}) AS base, {named} AS spans FROM spans GROUP BY doc_id
)
SELECT doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN summed USING (doc_id)
"""


def collocations() -> str:
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWERED}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
),
split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM split GROUP BY lang),
grams AS (
  SELECT lang, k, phrase, count(*)::BIGINT AS a FROM (
    SELECT lang, k, array_to_string(list_slice(ws, p, p + k - 1), ' ') AS phrase FROM (
      SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM split, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k
    )
  ) GROUP BY ALL
),
candidates AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM grams WHERE k >= 2 AND a >= 30),
parts AS (
  SELECT lang, k AS longer, a AS longer_a, array_to_string(list_slice(ws, p, p + m - 1), ' ') AS phrase FROM (
    SELECT *, unnest(range(1, k - m + 2)) AS p FROM candidates, (SELECT unnest([2, 3]) AS m) WHERE m < k
  )
),
held AS (
  SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN parts p ON p.lang = c.lang AND p.phrase = c.phrase WHERE 100 * longer_a >= 80 * c.a
),
cuts AS (
  SELECT c.lang, c.phrase, c.a, i, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a::HUGEINT + r.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS i FROM candidates) c
  JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(ws, 1, i), ' ')
  JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(ws, i + 1, c.k), ' ')
),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, score::BIGINT AS score
  FROM best ANTI JOIN held USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def conversation_repair() -> str:
    first, second = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    return f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_concat([4294967295], list_transform(
           string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 20 AS kind
  FROM conversations, crc
),
turned AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM given WHERE kind <> 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM turned
),
rows AS (
  SELECT conv_id, turn, role, text, i,
         CASE left(role, 1) WHEN 's' THEN 's' WHEN 'u' THEN 'u' WHEN 'a' THEN 'a' ELSE '-' END AS r,
         CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault
  FROM placed
),
sums AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated
  FROM rows GROUP BY conv_id
),
bad AS (
  SELECT conv_id, count(*) FILTER (before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT conv_id, r, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM rows) GROUP BY conv_id
),
inserts(p, m, ins, added) AS (VALUES ('n', 'n', '', ''), ('s', 's', '', ''), ('u', 'u', '', ''), ('a', 'a', '', ''),
  ('n', 'u', 'I', {first}), ('n', 'a', 'II', {first} || {second}), ('s', 'u', 'I', {first}), ('s', 'a', 'II', {first} || {second}),
  ('u', 'a', 'I', {second}), ('a', 'u', 'I', {first})),
ops(m, q) AS (VALUES ('n', 's'), ('n', 'u'), ('s', 'u'), ('a', 'u'), ('u', 'a')),
walk(conv_id, i, q, cost, audit, said) AS (
  SELECT conv_id, 0::BIGINT, 'n', 0::BIGINT, '', '' FROM sums
  UNION ALL
  SELECT conv_id, i, q, b.cost, b.audit, b.said FROM (
    SELECT conv_id, i, q, min({{'cost': cost, 'audit': audit, 'said': said}}) AS b FROM (
      SELECT w.conv_id, r.i, o.q, w.cost + 5 * length(ins) + CASE WHEN o.q = r.r THEN 0 ELSE 1 END + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS cost,
             w.audit || ins || CASE WHEN o.q = r.r THEN 'K' ELSE 'R' END AS audit,
             w.said || added || chr(10) || CASE WHEN o.q = r.r THEN role WHEN o.q = 'u' THEN 'user' ELSE 'assistant' END || ':' || text AS said
      FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN inserts x ON x.p = w.q JOIN ops o ON o.m = x.m
      WHERE fault NOT IN ('blank', 'duplicate') AND (o.q <> 's' OR r.r = 's')
      UNION ALL
      SELECT w.conv_id, r.i, x.m, w.cost + 5 * length(ins) + 2, w.audit || ins || 'D', w.said || added
      FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN inserts x ON x.p = w.q
    ) GROUP BY conv_id, i, q
  )
),
best AS (
  SELECT w.conv_id, min({{'cost': cost + 5 * length(ins), 'audit': audit || ins, 'said': said || added}}) AS b
  FROM walk w JOIN sums ON sums.conv_id IS NOT DISTINCT FROM w.conv_id AND n = i
  JOIN inserts x ON x.p = w.q AND (x.m = 'a' OR (w.q = 'n' AND x.m = 'n')) GROUP BY w.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
       coalesce(b.audit, '') AS audit, sha256(coalesce(substr(b.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN bad ON bad.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
"""


ORACLES: dict[str, str] = {
    "op2_decontamination": decontamination(),
    "op3_host_rules": host_rules(),
    "op8_url_filter": url_filter(),
    "op9_secrets": secrets(),
    "op12_collocations": collocations(),
    "op13_conversation_repair": conversation_repair(),
}
