"""DuckDB SQL for the rows of op12_centroid_clusters."""

_APART = "list_sum(list_transform(list_zip(a.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _round(i: int) -> str:
    """Assignment to the centroids of round `i`, then the centroids of the next one."""
    return f""",
a{i} AS MATERIALIZED (SELECT n, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT a.n, a.vec_id, a.v, c.c, {_APART}::HUGEINT AS d FROM kept a, c{i} c) p GROUP BY n),
m{i} AS (SELECT c, j, (sum(x)::HUGEINT - ((sum(x)::HUGEINT % count(*)) + count(*)) % count(*)) // count(*) AS x
  FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) u GROUP BY c, j),
c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(w.v, o.v) AS v FROM c{i} o LEFT JOIN (SELECT c, list(x::BIGINT ORDER BY j) AS v FROM m{i} GROUP BY c) w ON w.c = o.c)"""


CLUSTERS_SQL = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT v, sha256('2:' || vec_id) AS h FROM kept ORDER BY h, v LIMIT 40) f){"".join(_round(i) for i in range(6))}
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY a5.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(f.v, ',')) AS centroid_sha256 FROM a5 JOIN c5 f USING (c)"""
