"""DuckDB SQL for the rows of the vector queries: the plain computation, a step for each round."""

_CLEAN = "list_aggregate(list_transform(embedding, lambda x: CAST(x IS NULL OR NOT isfinite(x) AS INTEGER)), 'sum') = 0"
_WHOLE = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"


def _codes(positions: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """All distances of all parts to all entries of their book."""
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, {_WHOLE} AS w, len(embedding) // {positions} AS n FROM embeddings WHERE embedding IS NOT NULL AND {_CLEAN})",
        f"parts AS MATERIALIZED (SELECT vec_id, label, p, list_slice(w, p * n + 1, p * n + n) AS part FROM kept, range({positions}) r(p))",
        f"book0 AS MATERIALIZED (SELECT p, part AS entry, e FROM (SELECT p, part, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < {entries})",
    ]
    near = "SELECT vec_id, label, parts.p, part, arg_min(struct_pack(e := e, d := d), struct_pack(d := d, e := e)) AS hit FROM (SELECT parts.*, e, list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts JOIN {book} USING (p)) parts GROUP BY ALL"
    for k in range(rounds):
        steps += [
            f"near{k} AS MATERIALIZED ({near.format(book=f'book{k}')})",
            f"mean{k} AS (SELECT p, e, list(m ORDER BY i) AS entry FROM (SELECT p, hit.e AS e, i, CAST(floor(sum(part[i]) / count(*)) AS BIGINT) AS m FROM near{k}, range(1, 65) r(i) WHERE i <= len(part) GROUP BY p, hit.e, i) GROUP BY p, e)",
            f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.entry, b.entry) AS entry FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.e = m.e)",
        ]
    steps += [
        f"near{rounds} AS MATERIALIZED ({near.format(book=f'book{rounds}')})",
        f"coded AS (SELECT vec_id, label, string_agg(printf('%02x', hit.e), '' ORDER BY p) AS code, CAST(sum(hit.d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id, label)",
        f"digest AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) AS h FROM book{rounds})",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM digest) AS codebooks_sha256 FROM coded"


def _centroids(centroids: int = 40, rounds: int = 5) -> str:
    """All distances of all vectors to all centroids."""
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, {_WHOLE} AS w FROM embeddings WHERE len(embedding) = 64 AND {_CLEAN})",
        f"book0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, w AS ctr FROM (SELECT w, sha256('2:' || vec_id) AS h FROM kept ORDER BY h LIMIT {centroids}))",
    ]
    near = "SELECT vec_id, w, arg_min(struct_pack(c := c, d := d), struct_pack(d := d, c := c)) AS hit FROM (SELECT kept.*, c, list_sum(list_transform(list_zip(w, ctr), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM kept, {book}) GROUP BY ALL"
    for k in range(rounds):
        steps += [
            f"near{k} AS MATERIALIZED ({near.format(book=f'book{k}')})",
            f"mean{k} AS (SELECT c, list(m ORDER BY i) AS ctr FROM (SELECT hit.c AS c, i, CAST(floor(sum(w[i]) / count(*)) AS BIGINT) AS m FROM near{k}, range(1, 65) r(i) GROUP BY hit.c, i) GROUP BY c)",
            f"book{k + 1} AS MATERIALIZED (SELECT b.c, coalesce(m.ctr, b.ctr) AS ctr FROM book{k} b LEFT JOIN mean{k} m ON b.c = m.c)",
        ]
    steps.append(f"near{rounds} AS MATERIALIZED ({near.format(book=f'book{rounds}')})")
    return "WITH " + ",\n".join(steps) + (
        "\nSELECT vec_id, CAST(hit.c AS INTEGER) AS cluster, CAST(hit.d AS BIGINT) AS distance, CAST(sum(hit.d) OVER (PARTITION BY hit.c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(hit.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(ctr, ',')) AS centroid_sha256 FROM near{rounds} JOIN book{rounds} ON c = hit.c"
    )


CODES = _codes()
CENTROIDS = _centroids()
NEIGHBOURS = f"""
WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND {_CLEAN} AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, x.vec_id, list_reduce(list_transform(list_zip(q.v, x.v), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score
    FROM kept q, kept x WHERE q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id)) WHERE rank <= 20
"""
