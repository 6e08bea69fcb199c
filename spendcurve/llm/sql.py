"""DuckDB SQL for the operators that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

OP10 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS ws FROM d),
g AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM d)),
l1 AS (SELECT doc_id, line, n, regexp_extract_all(line, '{WORD}') AS lw,
              length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
              row_number() OVER (PARTITION BY doc_id, line ORDER BY n) AS seen
       FROM l0),
l2 AS (SELECT doc_id, len(lw) AS k, seen > 1 AS again,
              seen > 1
              OR regexp_matches(lower(line), 'all rights reserved|licensed under|released under the|cookie policy|privacy policy|terms of service|enable javascript|click here|subscribe to our|sign up for|skip to content|back to top')
              OR 10 * length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > chars
              OR 10 * length(regexp_replace(line, '[^!]', '', 'g')) > chars
              OR (len(lw) < 4 AND NOT regexp_matches(lw[-1], '[.!?…。！？؟।"'')”’»」』）]$'))
              OR 4 * len(list_filter(lw, lambda x: x IN ('|', '·', '•', '»', '›', '>', '/', '–', '—', '-'))) >= greatest(len(lw), 4)
              OR NOT regexp_matches(line, '[A-Za-z]|[^\x00-\x7F]') AS failed
       FROM l1 WHERE len(lw) > 0),
l3 AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (again) AS n_dup, count(*) FILTER (failed) AS n_failed,
              coalesce(sum(k) FILTER (NOT failed), 0) AS kept_words
       FROM l2 GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(l3.n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(l3.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(l3.n_failed, 0) AS BIGINT) AS n_failed_lines,
             CAST(coalesce(l3.kept_words, 0) AS BIGINT) AS n_words_kept
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN l3 USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_failed_lines, n_words_kept,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (n_words - n_words_kept) * 1000 <= 300 * n_words AS kept
FROM f
"""

#: A-Z in lower case, as words are compared.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Links by a self-join on shingles, components by reachability: for small tables.
OP9 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id, w.doc_id = r.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = w.doc_id
"""

URL_RULES = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(rule) AS (VALUES ('com/'), ('example.com/en/'), ('www.example.com/en/'), ('net/es/'), ('net/fr/')),
split AS (SELECT rule, split_part(rule, '/', 1) AS name, substr(rule, instr(rule, '/')) AS start FROM rules),
fits AS (SELECT page_id, arg_max(rule, length(rule)) AS rule FROM p, split WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY page_id)
SELECT page_id, host, path, rule FROM p LEFT JOIN fits USING (page_id)
"""

OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
