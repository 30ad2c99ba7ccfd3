"""SQL of the manifest and of the URL filter, for the comparison engine."""

from __future__ import annotations

from lakewarden.llm import hosts

_POSTERIOR = f"greatest({hosts.LEAST}, least({hosts.MOST}, CASE WHEN r <= 1 / ({hosts.MOST} + 1) THEN {hosts.MOST} WHEN r > 0 THEN 1 / r - 1 ELSE {hosts.MOST} END))"


def _shrunk(name: str, groups: str) -> str:
    """CTE text: groups (key, n, k, centre, ...) with the beta posterior's a and b."""
    return f"""{name}_g AS ({groups}),
{name}_s AS (SELECT {_POSTERIOR} AS s FROM (SELECT round(CASE WHEN sum(n * (n - 1) * centre * (1 - centre)) > 0 THEN sum((k - n * centre) ** 2 - n * centre * (1 - centre)) / sum(n * (n - 1) * centre * (1 - centre)) END, 9) AS r FROM {name}_g)),
{name} AS (SELECT *, least(s, weight) * centre + k AS a, least(s, weight) * (1 - centre) + n - k AS b FROM {name}_g, {name}_s)"""


_FITS = " UNION ALL ".join(f"SELECT '{v}' AS verdict, '{h}' AS rule_host, '{p}' AS rule_path" for v, h, p in hosts.RULES)
OP11_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT page_id, translate(raw, '{hosts.UPPER}', '{hosts.LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM v),
w AS (SELECT p.*, (SELECT max_by({{'rule': rule_host || rule_path, 'verdict': verdict}}, length(rule_host || rule_path)) FROM ({_FITS}) f WHERE (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)) AS hit FROM p),
c0 AS (SELECT host, CAST(count(hit.verdict) AS DOUBLE) AS n, CAST(count(*) FILTER (hit.verdict = 'block') AS DOUBLE) AS k, regexp_replace(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '\.$', '') AS name FROM w GROUP BY host),
c AS (SELECT *, regexp_matches(name, '^([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*\])$') OR NOT contains(name, '.') AS alone FROM c0),
h AS (SELECT host, n, k, CASE WHEN alone THEN name ELSE regexp_extract(name, '(?:^|\.)([^.]*\.{hosts.SUFFIX})$', 1) END AS domain, CASE WHEN alone THEN name ELSE regexp_extract(name, '(?:^|\.)({hosts.SUFFIX})$', 1) END AS suffix FROM c),
dom AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
{_shrunk("s1", "SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM h) AS centre, (SELECT coalesce(sum(n), 0) + 2 FROM h) AS weight FROM dom GROUP BY suffix")},
{_shrunk("s2", "SELECT dom.domain, dom.n, dom.k, s1.a / (s1.a + s1.b) AS centre, s1.a + s1.b AS weight FROM dom JOIN s1 ON s1.suffix = dom.suffix")},
{_shrunk("s3", "SELECT h.host, h.n, h.k, s2.a / (s2.a + s2.b) AS centre, s2.a + s2.b AS weight FROM h JOIN s2 ON s2.domain = h.domain")},
e AS (SELECT host, round(a / (a + b), 6) AS mean, round(a / (a + b) - 1.645::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6) AS lower FROM s3)
SELECT page_id, w.host, path, hit.rule AS rule, coalesce(hit.verdict, CASE WHEN lower >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, mean, lower FROM w JOIN e ON e.host = w.host
"""

_PART = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
#: crc32 of a number's decimal digits: the table of its bytes, then one step for each digit.
_TABLE = """crc_bits AS (SELECT i, CAST(i AS BIGINT) AS c, 0 AS bit FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, bit + 1 FROM crc_bits WHERE bit < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_bits WHERE bit = 8)"""
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda c, d: xor(c // 256, t[(xor(c, d) % 256) + 1])), 4294967295)"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = f"""
WITH RECURSIVE {_TABLE},
leaves AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_LEAF.format(text="text")} AS leaf, CASE WHEN {_CRC.format("doc_id")} % 3 = 0 THEN {_LEAF.format(text=_LOWERED)} END AS found FROM documents, crc_table),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, level, i // 8, n),
tops AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, i, n, h FROM tops
  UNION ALL
  SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY level, i // 8, n),
steps AS (
  SELECT a.tree, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY ALL),
upper_steps AS (
  SELECT a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM upper a JOIN upper b ON a.level = b.level AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY ALL),
climb AS (
  SELECT tree, i AS place, 0 AS level, i, coalesce(found, leaf) AS h, '' AS proof FROM placed
  UNION ALL
  SELECT c.tree, c.place, c.level + 1, c.i // 8, sha256(s.before || c.h || s.after), c.proof || s.before || s.after FROM climb c JOIN steps s ON s.tree = c.tree AND s.level = c.level AND s.i = c.i),
at_top AS (SELECT tree, place, max_by(h, level) AS h, max_by(proof, level) AS proof FROM climb GROUP BY tree, place),
climb_on AS (
  SELECT x.tree, x.place, 0 AS level, tops.i, x.h, x.proof FROM at_top x JOIN tops ON tops.tree = x.tree
  UNION ALL
  SELECT c.tree, c.place, c.level + 1, c.i // 8, sha256(s.before || c.h || s.after), c.proof || s.before || s.after FROM climb_on c JOIN upper_steps s ON s.level = c.level AND s.i = c.i),
ends AS (SELECT tree, place, max_by(h, level) AS h, max_by(proof, level) AS proof FROM climb_on GROUP BY tree, place)
SELECT p.doc_id, p.leaf, tops.h AS subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM placed p JOIN ends e ON e.tree = p.tree AND e.place = p.i JOIN tops ON tops.tree = p.tree CROSS JOIN (SELECT h FROM upper WHERE n = 1) r
"""
