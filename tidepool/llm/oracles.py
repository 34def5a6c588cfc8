"""DuckDB SQL for the queries that SQL can express, written apart from the Spark plans."""

from __future__ import annotations

from tidepool.llm.secrets import BASE, KINDS, PATTERNS, PLACEHOLDER

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _lower(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


_OP1 = f"""WITH lines AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
keyed AS (SELECT *, {_lower(f"trim(line, {_BLANK})")} AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT doc_id, pos, line, coalesce(doc_id > first_doc, false) AS gone FROM keyed LEFT JOIN firsts USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM judged GROUP BY doc_id"""


_OP2 = rf"""WITH items AS (SELECT item_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT item_id, least(13, len(w)) AS n, array_to_string(w[i + 1 : i + 13], ' ') AS win FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - 12))) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
spots AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM docs CROSS JOIN (SELECT DISTINCT n FROM wins) WHERE len(w) >= n),
found AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win FROM spots) JOIN wins USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

_OP3 = """WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
wins AS (SELECT doc_id, i, h[i + 1 : i + 50] AS w FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM docs WHERE n >= 50)),
firsts AS (SELECT w, min(doc_id) AS first_doc FROM wins GROUP BY w HAVING count(*) > 1),
gone AS (SELECT doc_id, i FROM wins JOIN firsts USING (w) WHERE doc_id > first_doc),
marks AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, -1) AS opens FROM gone),
runs AS (SELECT doc_id, i, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marks),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN a > before THEN hex(h[before + 1 : a]) ELSE '' END, '' ORDER BY a) AS k FROM (
  SELECT doc_id, h, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, n, n FROM docs) JOIN docs USING (doc_id)) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM docs LEFT JOIN sums USING (doc_id) JOIN kept USING (doc_id)"""


def _op5() -> str:
    quote = lambda p: p.replace("'", "''")
    kinds = " UNION ALL ".join(f"SELECT doc_id, owner, {i} AS kind, '{k}' AS name, string_split_regex(t, '{quote(PATTERNS[k])}') AS parts, regexp_extract_all(t, '{quote(PATTERNS[k])}') AS hits FROM d" for i, k in enumerate(KINDS))
    group2 = f"regexp_extract(hit, '{quote(PATTERNS['assign'])}', 2)"
    return f"""WITH d AS (SELECT doc_id, source AS owner, coalesce(text, '') AS t FROM documents),
found AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM ({kinds}) WHERE len(hits) > 0),
placed AS (SELECT doc_id, owner, kind, name, hits[i] AS hit, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM found),
cand AS (SELECT *, CASE WHEN kind = 0 THEN {group2} ELSE hit END AS v, a + length(hit) AS b FROM placed),
ok AS (SELECT * FROM cand WHERE kind <> 0 OR length(v) >= 6),
owned AS (SELECT v, count(DISTINCT coalesce(owner, '')) AS n_owners, count(DISTINCT doc_id) AS n_repos FROM ok GROUP BY v),
judged AS (SELECT *, n_owners <= 2 AND n_repos <= 20 AND (kind = {KINDS.index("pem")} OR (length(v) >= 8 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(v, '{quote(PLACEHOLDER)}')
  AND len(list_distinct(string_split(v, ''))) >= 6)) AS live FROM ok JOIN owned USING (v)),
listed AS (SELECT *, name || ':' || a || ':' || b AS span FROM judged WHERE kind < {BASE} OR live),
per AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(KINDS[:BASE]))}, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_shared,
  string_agg(span, ',' ORDER BY a, kind) FILTER (kind < {BASE}) AS base, string_agg(span, ',' ORDER BY a, kind) AS spans FROM listed GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (doc_id)"""


_OP10 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_OP12 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_TERM}') AS w FROM documents),
sums AS (SELECT count(*) AS c, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_lower("coalesce(text, '')")}, '{_TERM}')) AS term FROM benchmark),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * c + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term) CROSS JOIN sums),
impacts AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * c) // l))) AS impact FROM tf JOIN weights USING (term) CROSS JOIN sums),
scored AS (SELECT item_id, r, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY ALL HAVING sum(impact) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INT) AS rank, doc_id, score FROM scored QUALIFY rank <= 10"""

SQL: dict[str, str] = {"op1_line_dedup": _OP1, "op2_decontaminate": _OP2, "op3_suffix_dedup": _OP3, "op5_secrets": _op5(), "op10_top_k": _OP10, "op12_ranked_search": _OP12}
