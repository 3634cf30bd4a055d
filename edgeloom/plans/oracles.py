"""SQL that DuckDB runs over the same tables, one text per query."""

from __future__ import annotations

from edgeloom.config import PI

EDGES = """
edges AS (
  SELECT event_id AS seq, CAST(floor(value) AS BIGINT) % 3 AS src_id, substr(event_type, 1, 1) AS src_type, 100 + k % 50 AS dst_id,
         chr(CAST(97 + k % 4 AS INTEGER)) AS dst_type, chr(CAST(113 + CAST(floor(value) AS BIGINT) % 5 AS INTEGER)) AS e_type, CAST((user_id % 60) * 10 AS INTEGER) AS gid
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
boot AS (SELECT DISTINCT CAST((gid // 100) % 2 AS INTEGER) AS cluster_id, gid FROM edges WHERE gid % 20 = 0),
test AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, src_id, src_type, dst_id, dst_type, e_type, gid FROM edges WHERE gid NOT IN (SELECT gid FROM boot))"""

SHINGLES = """
shingles AS (SELECT gid, src_id, src_type, ' ' || src_type || string_agg(e_type || dst_type, '' ORDER BY seq) AS shingle FROM edges GROUP BY gid, src_id, src_type)"""


def chunks(c: int) -> str:
    return f"""
chunks AS (SELECT gid, src_id, src_type, chunk_no, substr(shingle, 1 + {c} * chunk_no, {c}) AS chunk
  FROM (SELECT *, unnest(range((length(shingle) + {c} - 1) // {c})) AS chunk_no FROM shingles)),
bag AS (SELECT gid, chunk, count(*) AS cnt FROM chunks GROUP BY gid, chunk)"""


def family(bits: int, c: int, seed: int = 23) -> str:
    key = f"'{seed}:' || i || ':' || j"
    return f"""
family AS (SELECT i, j, CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(md5({key}), 9, 8) AS BIGINT) AS lo
  FROM (SELECT CAST(a.range AS INTEGER) AS i, CAST(b.range AS INTEGER) AS j FROM range({bits}) a, range({c + 1}) b))"""


def signs(of: str, mark: str = "") -> str:
    """of: a relation with a column chunk. mark: put before the relations' names, where a query has two such sets."""
    return f"""
{mark}words AS (SELECT DISTINCT chunk FROM {of}),
{mark}letters AS (SELECT chunk, j, CASE WHEN j = 0 THEN 1 ELSE ascii(substr(chunk, j, 1)) END AS byte FROM (SELECT chunk, unnest(range(length(chunk) + 1)) AS j FROM {mark}words)),
{mark}signs AS (SELECT chunk, i, CAST(2 * (((hi + (lo >> 32)) >> 31) & 1) - 1 AS INTEGER) AS sign
  FROM (SELECT chunk, i, CAST(sum(hi * byte) AS BIGINT) AS hi, CAST(sum(lo * byte) AS BIGINT) AS lo FROM {mark}letters JOIN family USING (j) GROUP BY chunk, i))"""


PROJECTED = """
projected AS (SELECT gid, i, CAST(sum(cnt * sign) AS BIGINT) AS p FROM bag JOIN signs USING (chunk) GROUP BY gid, i),
bits AS (SELECT gid, i, CASE WHEN p >= 0 THEN 1 ELSE 0 END AS bit FROM projected)"""

VOCABULARY = """
vocab AS (SELECT chunk, row_number() OVER (ORDER BY chunk) - 1 AS chunk_id FROM (SELECT DISTINCT chunk FROM bag)),
vectors AS (SELECT gid, chunk_id, cnt FROM bag JOIN vocab USING (chunk))"""


def random(bits: int, seed: int = 23) -> str:
    return f"""
random AS (SELECT CAST(r.range AS INTEGER) AS i, chunk_id, CASE WHEN substr(md5('r{seed}:' || r.range || ':' || chunk_id), 1, 1) >= '8' THEN 1 ELSE -1 END AS r FROM vocab, range({bits}) r),
rbits AS (SELECT gid, i, CASE WHEN sum(cnt * r) >= 0 THEN 1 ELSE 0 END AS bit FROM vectors JOIN random USING (chunk_id) GROUP BY gid, i)"""


def centers(bits: int) -> str:
    return f"""
sizes AS (SELECT cluster_id, count(*) AS size FROM boot GROUP BY cluster_id),
centers AS (SELECT cluster_id, i, CAST(coalesce(sum(p), 0) AS DOUBLE) / any_value(size) AS c
  FROM boot JOIN sizes USING (cluster_id) CROSS JOIN (SELECT CAST(range AS INTEGER) AS i FROM range({bits})) LEFT JOIN projected USING (gid, i) GROUP BY cluster_id, i),
cbits AS (SELECT cluster_id, i, CASE WHEN c >= 0 THEN 1 ELSE 0 END AS bit FROM centers),
measured AS (SELECT gid, cluster_id, 1 - cos({PI} * (1 - sum(CASE WHEN b.bit = c.bit THEN 1 ELSE 0 END) / {float(bits)})) AS distance FROM bits b JOIN cbits c USING (i) GROUP BY gid, cluster_id),
nearest AS (SELECT gid, cluster_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY distance, cluster_id) AS r FROM measured) WHERE r = 1)"""


def live(n: int) -> str:
    return f"(PARTITION BY gid, src_id, src_type ORDER BY seq RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def deltas(c: int, n: int) -> str:
    return f"""
live AS (SELECT seq, gid, count(*) OVER w AS n, ' ' || src_type || string_agg(e_type || dst_type, '') OVER w AS s FROM test WINDOW w AS {live(n)}),
parts AS (SELECT *, (length(s) - 1) % {c} + 1 AS ll FROM live),
deltas AS (SELECT seq, gid, n, substr(s, length(s) - ll + 1, ll) AS in_chunk,
  CASE WHEN n = 1 OR ll = 2 THEN NULL WHEN ll = 1 THEN substr(s, length(s) - {c}, {c} - 1) ELSE substr(s, length(s) - ll + 1, ll - 2) END AS out_chunk FROM parts)"""


def fold(bits: int, c: int, n: int, limit: float) -> str:
    """The online clusters edge by edge, as a recursion over seq that carries centroids, sizes and every graph's cluster; needs test, boot and centers."""

    def distance(center: str) -> str:
        return f"1 - cos({PI} * (1 - list_sum(list_transform(range(1, {bits + 1}), lambda i: CASE WHEN ({center}[i] >= 0) = (now[i] >= 0) THEN 1 ELSE 0 END)) / {float(bits)}))"

    def moved(lists: str, k: str, value: str) -> str:
        return f"list_transform({lists}, lambda x, k: CASE WHEN k = {k} THEN list_transform(x, lambda y, i: {value}) ELSE x END)"

    resized = lambda sizes, k, by: f"list_transform({sizes}, lambda x, k: CASE WHEN k = {k} THEN x {by} ELSE x END)"
    return f"""{deltas(c, n)},
moved AS (SELECT seq, gid, in_chunk AS chunk, 1 AS s FROM deltas UNION ALL SELECT seq, gid, out_chunk, -1 FROM deltas WHERE out_chunk IS NOT NULL),
{signs("moved", "moved_").strip()},
steps AS (SELECT seq, gid, i, CAST(sum(s * sign) AS BIGINT) AS delta FROM moved JOIN moved_signs USING (chunk) GROUP BY seq, gid, i),
walks AS (SELECT seq, gid, i, delta, CAST(sum(delta) OVER (PARTITION BY gid, i ORDER BY seq) AS BIGINT) AS now FROM steps),
edge AS MATERIALIZED (SELECT seq, any_value(gid) AS gid, list(delta ORDER BY i) AS delta, list(now ORDER BY i) AS now, list(now - delta ORDER BY i) AS before FROM walks GROUP BY seq),
begun AS MATERIALIZED (SELECT (SELECT list(v ORDER BY cluster_id) FROM (SELECT cluster_id, list(c ORDER BY i) AS v FROM centers GROUP BY cluster_id)) AS centers, (SELECT list(size ORDER BY cluster_id) FROM sizes) AS sizes,
  (SELECT list(coalesce(cluster_id, -2) ORDER BY gid) FROM (SELECT 10 * range AS gid FROM range(60)) LEFT JOIN boot USING (gid)) AS held),
fold AS (
  SELECT CAST(-1 AS BIGINT) AS seq, CAST(NULL AS INTEGER) AS gid, CAST(NULL AS INTEGER) AS cluster_id, CAST(NULL AS DOUBLE) AS score, centers, sizes, held FROM begun
  UNION ALL
  SELECT seq, gid, cluster, CASE WHEN NOT far OR own = near - 1 THEN {distance("centers3[near]")} ELSE least_distance END, centers3, sizes3, list_transform(held, lambda x, k: CASE WHEN k = gid // 10 + 1 THEN cluster ELSE x END)
  FROM (SELECT *, CAST(CASE WHEN far THEN -1 ELSE near - 1 END AS INTEGER) AS cluster,
      CASE WHEN joins THEN {moved("centers2", "near", "(y * sizes2[k] + now[i]) / (sizes2[k] + 1)")} WHEN NOT far THEN {moved("centers2", "near", "y + delta[i] / sizes2[k]")} ELSE centers2 END AS centers3,
      CASE WHEN joins THEN {resized("sizes2", "near", "+ 1")} ELSE sizes2 END AS sizes3
    FROM (SELECT *, CASE WHEN leaves THEN {moved("centers", "own + 1", "(y * sizes[k] - before[i]) / (sizes[k] - 1)")} ELSE centers END AS centers2, CASE WHEN leaves THEN {resized("sizes", "own + 1", "- 1")} ELSE sizes END AS sizes2
      FROM (SELECT *, own >= 0 AND (far OR own <> near - 1) AS leaves, NOT far AND own <> near - 1 AS joins
        FROM (SELECT *, measured[near] AS least_distance, measured[near] > {limit} AS far
          FROM (SELECT *, list_position(measured, list_min(measured)) AS near
            FROM (SELECT edge.seq, edge.gid, delta, now, before, centers, sizes, held, held[edge.gid // 10 + 1] AS own, list_transform(centers, lambda x: {distance("x")}) AS measured
              FROM fold JOIN edge ON edge.seq = fold.seq + 1)))))))"""


def snapshots(interval: int) -> str:
    """Over fold: the state of all graphs after every so many edges, and after the last; needs measured."""
    return f"""
states AS (SELECT seq, gid, cluster_id, score FROM fold WHERE seq >= 0),
ends AS (SELECT CAST(range AS INTEGER) AS "interval", CASE WHEN range = m // {interval} THEN m ELSE range * {interval} END AS bound FROM (SELECT max(seq) AS m FROM states), range(m // {interval} + 1)),
known AS (SELECT gid, cluster_id, distance AS score FROM measured JOIN boot USING (gid, cluster_id) UNION ALL SELECT DISTINCT gid, -2, -2.0 FROM test),
latest AS (SELECT "interval", gid, arg_max(cluster_id, seq) AS cluster_id, arg_max(score, seq) AS score FROM ends JOIN states ON seq <= bound GROUP BY "interval", gid),
snaps AS (SELECT "interval", gid, CAST(coalesce(l.cluster_id, k.cluster_id) AS INTEGER) AS cluster_id, round(coalesce(l.score, k.score), 6) + 0.0 AS score FROM known k CROSS JOIN ends LEFT JOIN latest l USING ("interval", gid))"""


def similar(bits: int) -> str:
    return f"""
pairs AS (SELECT a.gid AS gid_a, b.gid AS gid_b, sum(CASE WHEN a.bit = b.bit THEN 1 ELSE 0 END) / {float(bits)} AS stream FROM bits a JOIN bits b USING (i) GROUP BY a.gid, b.gid)"""


COSINES = """
norms AS (SELECT gid, sqrt(sum(CAST(cnt AS DOUBLE) * cnt)) AS norm FROM vectors GROUP BY gid),
dots AS (SELECT a.gid AS gid_a, b.gid AS gid_b, sum(CAST(a.cnt AS DOUBLE) * b.cnt) AS dot FROM vectors a JOIN vectors b USING (chunk_id) GROUP BY a.gid, b.gid),
cosines AS (SELECT gid_a, gid_b, least(1.0, dot / (x.norm * y.norm)) AS cosine FROM dots JOIN norms x ON gid_a = x.gid JOIN norms y ON gid_b = y.gid)"""


def banded(rows: int) -> str:
    return f"""
banded AS (SELECT gid, CAST(i // {rows} AS INTEGER) AS band, CAST(sum(CAST(bit AS BIGINT) << (i % {rows})) AS BIGINT) AS bucket FROM bits GROUP BY gid, i // {rows}),
near AS (SELECT DISTINCT a.gid AS gid_a, b.gid AS gid_b FROM banded a JOIN banded b USING (band, bucket))"""


def of(*parts: str, recursive: bool = False) -> str:
    """A WITH clause; the last part is the SELECT."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(parts[:-1]) + "\n" + parts[-1]
