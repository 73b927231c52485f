"""The queries that SQL can express, as DuckDB SQL over whole tables."""

from __future__ import annotations

from .hosts import LOWER, RULES, TWO_LABEL_SUFFIXES, UPPER

_TWO = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
_ORDERED = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_FITS = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, what) for what, h, p in _ORDERED]
_RULE = "CASE " + " ".join(f"WHEN {fits} THEN '{rule}'" for fits, rule, _ in _FITS) + " END"
_VERDICT = "CASE " + " ".join(f"WHEN {fits} THEN '{what}'" for fits, _, what in _FITS) + " END"


def _strength(units: str) -> str:
    spread = "m * (1 - m)"
    share = f"SELECT CASE WHEN sum(n * (n - 1) * {spread}) > 0 THEN sum(pow(good - n * m, 2) - n * {spread}) / sum(n * (n - 1) * {spread}) ELSE 0.0 END FROM {units} WHERE n > 0"
    return f"SELECT 1.0 / least(greatest(coalesce(({share}), 0.0), 1.0 / 1001.0), 0.5) - 1.0 AS k"


OP2 = f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
good AS (SELECT doc_id AS page_id, CAST(min(quality) AS DOUBLE) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
sums AS (SELECT host, CAST(count(good) AS DOUBLE) AS n, coalesce(sum(good), 0.0) AS good FROM urls LEFT JOIN good USING (page_id) GROUP BY host),
parts AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS bare FROM sums),
cut AS (SELECT *, string_split(bare, '.') AS l, regexp_matches(bare, '^[0-9]+(\\.[0-9]+)*$') AS address FROM parts),
tail AS (SELECT *, array_to_string(l[greatest(len(l) - 1, 1):], '.') AS two, array_to_string(l[greatest(len(l) - 2, 1):], '.') AS three FROM cut),
hosts AS (SELECT host, n, good, CASE WHEN address THEN bare WHEN two IN ({_TWO}) THEN three ELSE two END AS domain, CASE WHEN address THEN bare WHEN two IN ({_TWO}) THEN two ELSE l[len(l)] END AS suffix FROM tail),
overall AS (SELECT (coalesce(sum(good), 0.0) + 1.0) / (coalesce(sum(n), 0.0) + 2.0) AS m FROM hosts),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT m FROM overall) AS m FROM hosts GROUP BY suffix),
sk AS ({_strength("s0")}),
s1 AS (SELECT suffix, (good + k * m) / (n + k) AS m FROM s0, sk),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good, any_value(s1.m) AS m FROM hosts JOIN s1 USING (suffix) GROUP BY domain, suffix),
dk AS ({_strength("d0")}),
d1 AS (SELECT domain, (good + k * m) / (n + k) AS m FROM d0, dk),
h0 AS (SELECT host, n, good, d1.m FROM hosts JOIN d1 USING (domain)),
hk AS ({_strength("h0")}),
h1 AS (SELECT host, n, (good + k * m) / (n + k) AS mean, k FROM h0, hk),
known AS (SELECT host AS known_host, n, mean - 1.645 * sqrt(mean * (1 - mean) / (n + k + 1)) AS bound FROM h1)
SELECT page_id, host, path, {_RULE} AS rule, coalesce({_VERDICT}, CASE WHEN bound >= 0.6 THEN 'allow' ELSE 'block' END) AS verdict,
  CAST(n AS BIGINT) AS host_labelled, round(bound, 6) AS host_bound
FROM urls LEFT JOIN known ON known_host = host
"""

_KEY = "concat_ws('|', '7', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))"
OP4 = f"""
WITH sums AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS chars FROM documents GROUP BY source),
total AS (SELECT sum(chars) / sum(CASE WHEN chars > 0 THEN pow(chars, 0.7) ELSE 0 END) AS scale FROM sums),
rates AS (SELECT source, round(CASE WHEN chars > 0 THEN pow(chars, 0.7) * scale / chars ELSE 1.0 END, 6) AS rate FROM sums, total),
chances AS (SELECT source, rate, sum(CASE WHEN rate = 0 THEN CAST(k = 0 AS INTEGER) ELSE exp(k * ln(rate) - rate - lgamma(k + 1)) END) OVER (PARTITION BY source ORDER BY k) AS chance FROM rates, range(0, 600) AS r(k)),
drawn AS (SELECT *, {_KEY} AS mix_key, CAST(('0x' || substr(md5({_KEY}), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
counts AS (SELECT d.*, r.rate, (SELECT count(*) FROM chances c WHERE c.source IS NOT DISTINCT FROM d.source AND c.chance <= u) AS copies FROM drawn d JOIN rates r ON r.source IS NOT DISTINCT FROM d.source),
each AS (SELECT *, unnest(range(1, copies + 1)) AS repetition FROM counts WHERE copies > 0)
SELECT doc_id, text, lang, source, n_chars, repetition, copies, rate, CAST(('0x' || substr(md5(concat_ws('|', mix_key, 'order', CAST(repetition AS VARCHAR))), 1, 15)) AS BIGINT) AS shuffle_key FROM each
"""


def _components(nodes: str, id_: str, links: str) -> str:
    """CTEs of the smallest id reachable over links (a, b), both ways."""
    return f"reach(a, b) AS (SELECT {id_}, {id_} FROM {nodes} UNION SELECT reach.a, {links}.b FROM reach JOIN {links} ON {links}.a = reach.b), component AS (SELECT a AS {id_}, min(b) AS component_id FROM reach GROUP BY a)"


OP9 = f"""
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS size FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_inner_product(v, v) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_inner_product(x.v, y.v) / (x.size * y.size) >= 0.93),
{_components("e", "vec_id", "links")}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = component.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM component
"""

OP10 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
u AS (SELECT doc_id, md5(unnest(s)) AS h FROM s),
shared AS (SELECT h FROM u GROUP BY h HAVING count(*) > 1),
v AS (SELECT doc_id, h FROM u JOIN shared USING (h)),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM v x JOIN v y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
{_components("s", "doc_id", "links")}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN component USING (doc_id)
"""
