"""DuckDB SQL that gives the rows of the queries, where SQL can express them."""

from __future__ import annotations

OP3 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), g AS (
  SELECT doc_id, source, size, count(*)::BIGINT AS copies,
         md5(concat('mix-1/', coalesce(doc_id::VARCHAR, ''), '/', size::VARCHAR)) AS place
  FROM d GROUP BY doc_id, source, size
), s AS (
  SELECT source, sum(size * copies)::BIGINT AS source_size FROM g GROUP BY source
), w AS (
  SELECT source, source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM s
), o AS (
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nth
  FROM w
), f AS (
  SELECT *, coalesce(min(CASE WHEN cap * weights > rest * weight THEN nth END) OVER (), 1000000000) AS free FROM o
), t AS (
  SELECT source, source_size,
         (CASE WHEN nth < free THEN cap ELSE max(CASE WHEN nth = free THEN rest END) OVER () * weight / max(CASE WHEN nth = free THEN weights END) OVER () END)::DOUBLE AS target
  FROM f
), p AS (
  SELECT g.*, t.source_size, t.target, size * copies AS amount,
         (sum(size * copies) OVER (PARTITION BY g.source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) - size * copies)::BIGINT AS first
  FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, greatest(0, least(amount, floor(target)::BIGINT - first)) + greatest(0, least(amount, floor(target)::BIGINT - first - source_size)) AS words FROM p
), r AS (
  SELECT *, unnest(range(1, copies + 1)) AS nth FROM k
)
SELECT doc_id, size, source_size, target, greatest(0, least(2 * size, words - 2 * size * (nth - 1)))::BIGINT AS taken FROM r
"""

_COMPONENTS = """r(x, root) AS (
  SELECT x, x FROM nodes UNION SELECT edges.y, r.root FROM r JOIN edges ON edges.x = r.x AND edges.y > r.root
), c AS (SELECT x, min(root) AS root FROM r GROUP BY x)"""

OP1 = f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), pairs AS (
  SELECT a.row AS a, b.row AS b, a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON len(a.e) = len(b.e) AND a.row <> b.row
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.9
), links AS (SELECT a, count(*)::BIGINT AS n FROM pairs GROUP BY a),
nodes AS (SELECT DISTINCT vec_id AS x FROM v WHERE vec_id IS NOT NULL), edges AS (SELECT DISTINCT x, y FROM pairs), {_COMPONENTS}
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, root AS component_id, coalesce(vec_id = root, true) AS kept
FROM v LEFT JOIN links ON links.a = v.row LEFT JOIN c ON c.x = v.vec_id
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP6 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, lang AS stratum, coalesce(text, '') AS text, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (SELECT row, i, w[i:i + 4] AS k FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, k) AS n FROM windows) WHERE n > 1),
covered AS (SELECT row, count(DISTINCT i + j)::BIGINT AS n FROM twice, (SELECT unnest(range(0, 5)) AS j) GROUP BY row),
s AS (
  SELECT d.row, doc_id, stratum, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
         len(regexp_extract_all(text, '\p{{Lu}}')) AS n_capitals, len(regexp_extract_all(text, '!')) AS n_shouts, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_stutters
  FROM d LEFT JOIN covered ON covered.row = d.row
), m AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
         {", ".join(f"(CASE WHEN {b} > 0 THEN least(1000, floor(1000 * {a} / {b}::DOUBLE)) ELSE 0 END)::INT AS {r}" for r, a, b in (("symbols", "n_symbols", "word_chars"), ("dup_lines", "n_dup_lines", "n_lines"), ("repeats", "n_repeat_words", "n_words"), ("capitals", "n_capitals", "word_chars"), ("shouts", "n_shouts", "n_words"), ("stutter", "n_stutters", "n_words")))}
  FROM s
), q AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT stratum, text, max(quality) AS quality, any_value(symbols) AS symbols, any_value(dup_lines) AS dup_lines, any_value(repeats) AS repeats, any_value(capitals) AS capitals, any_value(shouts) AS shouts, any_value(stutter) AS stutter
  FROM m JOIN q USING (doc_id) WHERE NOT base_failed GROUP BY stratum, text),
seen AS (SELECT stratum, rule, value, sum((quality = 1)::INT) AS good, sum((quality <> 1)::INT) AS bad FROM (UNPIVOT held ON symbols, dup_lines, repeats, capitals, shouts, stutter INTO NAME rule VALUE value) GROUP BY stratum, rule, value),
tried AS (
  SELECT *, sum(good) OVER top AS k, sum(bad) OVER top AS b, sum(good) OVER (PARTITION BY stratum, rule) AS n, (SELECT count(*) FROM (SELECT DISTINCT stratum FROM seen)) * 6 AS tests
  FROM seen WINDOW top AS (PARTITION BY stratum, rule ORDER BY value DESC ROWS UNBOUNDED PRECEDING)
), p AS (
  SELECT *, CASE WHEN k > 0.005 * n THEN 1.0 ELSE list_sum(list_transform(range(0, k::BIGINT + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.005) + (n - i) * ln(0.995)))) END AS p FROM tried
), passed AS (
  SELECT * FROM (SELECT *, max(p) OVER (PARTITION BY stratum, rule ORDER BY value DESC ROWS UNBOUNDED PRECEDING) AS worst FROM p) WHERE worst <= 0.05 / tests AND b - 10 * k > 0
), cuts AS (SELECT stratum, rule, max((b - 10 * k, value))[2] AS cut FROM (SELECT * FROM passed) GROUP BY stratum, rule),
hits AS (SELECT DISTINCT row FROM (UNPIVOT m ON symbols, dup_lines, repeats, capitals, shouts, stutter INTO NAME rule VALUE value) u JOIN cuts ON cuts.rule = u.rule AND cuts.stratum IS NOT DISTINCT FROM u.stratum WHERE value >= cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND row NOT IN (SELECT row FROM hits)) AS kept, stratum, symbols, dup_lines, repeats, capitals, shouts, stutter FROM m
"""

OP7 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) END) AS s FROM d
), classes AS (SELECT min(doc_id) AS x, list_sort(list_transform(s, lambda t: hash(t))) AS s FROM sets WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY 2),
one AS (SELECT x, len(s) AS n, unnest(s) AS t FROM classes),
pairs AS (SELECT a.x AS x, b.x AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM one a JOIN one b ON a.t = b.t AND a.x <> b.x GROUP BY a.x, b.x),
nodes AS (SELECT x FROM classes), edges AS (SELECT x, y FROM pairs WHERE 100 * c >= 80 * (n + m - c)), {_COMPONENTS}
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, CASE WHEN doc_id IS NOT NULL THEN coalesce(root, doc_id) END AS component_id, coalesce(doc_id = coalesce(root, doc_id), true) AS kept
FROM sets LEFT JOIN classes ON list_sort(list_transform(sets.s, lambda t: hash(t))) = classes.s LEFT JOIN c ON c.x = classes.x
"""

ORACLE = {"op1_embeddings": OP1, "op3_mixing": OP3, "op6_quality_rules": OP6, "op7_minhash": OP7}
