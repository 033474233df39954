"""SQL of the queries that SQL can express, for DuckDB over the same tables."""

from . import urls

_RULE = "CASE " + " ".join(
    f"WHEN (host = '{r.split('/', 1)[0]}' OR ends_with(host, '.{r.split('/', 1)[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}') THEN '{{{i}}}'"
    for i, r in enumerate(r for r, _ in sorted(urls.RULES, key=lambda r: -len(r[0])))
) + " END"
_SORTED = sorted(urls.RULES, key=lambda r: -len(r[0]))


def _level(name: str, source: str) -> str:
    """The strength of a level's prior by moments."""
    return f"""
{name}_sums AS (
  SELECT sum(n * pow(bad / n - m, 2)) AS spread, sum(m * (1 - m)) AS sampling, sum(n * m * (1 - m)) AS total
  FROM {source} WHERE n > 0),
{name}_s AS (
  SELECT CASE WHEN total IS NULL OR total <= sampling OR spread <= sampling THEN {urls.STRONGEST}
    ELSE least(greatest((total - sampling) / (spread - sampling) - 1, {urls.WEAKEST}), {urls.STRONGEST}) END AS s
  FROM {name}_sums)"""


URLS = f"""
WITH parts AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{urls.CAPITALS}', '{urls.SMALL}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
outcomes AS (
  SELECT p.host, CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1 ELSE 0 END AS bad
  FROM parts p JOIN labels l ON TRY_CAST(regexp_extract(p.path, '/([0-9]{{1,18}})', 1) AS BIGINT) = l.doc_id
  WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL),
hosts AS (
  SELECT h.host, coalesce(o.n, 0)::DOUBLE AS n, coalesce(o.bad, 0)::DOUBLE AS bad,
    regexp_extract(h.host, '([^.]*\\.)?[^.]*$') AS domain, regexp_extract(h.host, '[^.]*$') AS suffix
  FROM (SELECT DISTINCT host FROM parts) h
  LEFT JOIN (SELECT host, count(*) AS n, sum(bad) AS bad FROM outcomes GROUP BY host) o USING (host)),
whole AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(bad) + 1) / (sum(n) + 2) ELSE 0 END AS m FROM hosts),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM hosts, whole GROUP BY suffix),
{_level("suffix", "suffixes").strip()},
top AS (SELECT suffix, (bad + s * m) / (n + s) AS m FROM suffixes, suffix_s),
domains AS (
  SELECT h.suffix, h.domain, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m
  FROM hosts h JOIN top USING (suffix) GROUP BY h.suffix, h.domain),
{_level("domain", "domains").strip()},
middle AS (SELECT domain, (bad + s * m) / (n + s) AS m FROM domains, domain_s),
leaves AS (SELECT h.host, h.n, h.bad, m FROM hosts h JOIN middle USING (domain)),
{_level("host", "leaves").strip()},
judged AS (
  SELECT host, (bad + s * m) / (n + s) - {urls.Z} * sqrt((bad + s * m) * (n + s - bad - s * m) / ((n + s) * (n + s) * (n + s + 1))) AS lower
  FROM leaves, host_s)
SELECT page_id, host, path,
  {_RULE.format(*(r for r, _ in _SORTED))} AS rule,
  coalesce({_RULE.format(*(v for _, v in _SORTED))}, CASE WHEN lower > {urls.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN judged USING (host)
"""


_LOWERED = f"translate(coalesce(text, ''), '{urls.CAPITALS}', '{urls.SMALL}')"
_PLAIN = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Words in 35-word windows that start more than once; ids tell documents apart.
SUBSTRINGS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_PLAIN}') AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
again AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i FROM win SEMI JOIN again USING (s)), (SELECT unnest(range(0, 35)) AS k)),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS w FROM d),
found AS (
  SELECT word.doc_id, count(gone.p) AS n_removed, string_agg(w, ' ' ORDER BY word.p) FILTER (WHERE gone.p IS NULL) AS kept
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY word.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN found ON found.doc_id = d.doc_id"""

#: Links of 5-shingle sets, their number by document, and the smallest document that links reach.
JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_PLAIN}') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT x, y FROM pair JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON link.x = reach.other)
SELECT r.doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r LEFT JOIN size ON size.doc_id = r.doc_id
  LEFT JOIN (SELECT x, count(*) AS n_links FROM link GROUP BY x) l ON l.x = r.doc_id"""

#: Document words inside occurrences of windows of benchmark items.
BENCHMARK = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') AS ws FROM benchmark),
item AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT *, least(len(ws), 10) AS n FROM b WHERE len(ws) > 0))),
win AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM item) WHERE len(ws) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM win JOIN item USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""
