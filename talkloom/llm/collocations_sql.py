"""DuckDB SQL for the rows of op13_collocations."""

_GRAMS = " UNION ALL ".join(
    f"SELECT lang, unnest(list_transform(range(1, len(ws) - {k} + 2), lambda i: ws[i:i + {k} - 1])) AS p FROM pieces WHERE len(ws) >= {k}" for k in range(1, 6))
_INNER = " UNION ALL ".join(
    f"SELECT lang, unnest(list_transform(range(1, len(p) - {k} + 2), lambda i: p[i:i + {k} - 1])) AS p, a FROM grams WHERE len(p) > {k}" for k in range(2, 5))

COLLOCATIONS_SQL = f"""WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS ws FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents) t),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS MATERIALIZED (SELECT lang, p, count(*) AS a FROM ({_GRAMS}) g GROUP BY lang, p HAVING count(*) >= 100),
longer AS (SELECT lang, p, max(a) AS b FROM ({_INNER}) i GROUP BY lang, p),
cuts AS (SELECT g.lang, g.p, g.a, unnest(range(1, len(g.p))) AS k FROM grams g LEFT JOIN longer o ON o.lang = g.lang AND o.p = g.p
  WHERE len(g.p) > 1 AND (o.b IS NULL OR 100 * o.b < 100 * g.a)),
scored AS (SELECT c.lang, c.p, c.a, c.k, x.a AS l, y.a AS r, t.n, (1000::HUGEINT * c.a * t.n // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.p = c.p[1:c.k] JOIN grams y ON y.lang = c.lang AND y.p = c.p[c.k + 1:] JOIN totals t ON t.lang = c.lang),
weakest AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, n, min(score) AS score, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r
  FROM scored GROUP BY lang, p, a, n)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM weakest
QUALIFY rank <= 2000"""
