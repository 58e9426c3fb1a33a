"""The rules of FIXTURES.md in DuckDB SQL, as common table expressions in front of an oracle query.

Written from the rules, not from the Spark builders in sources/derived.py."""

from __future__ import annotations


def enc(x: str) -> str:
    """Bytes of a stored number."""
    limits = (127, 16383, 1048575, 268435455, 17179869183, 4398046511103, 1125899906842623, 288230376151711743)
    return "CASE " + " ".join(f"WHEN {x} <= {v} THEN {i}" for i, v in enumerate(limits, 1)) + " ELSE 9 END"


CTES = f"""
e0 AS (SELECT event_id, ts, event_type, value,
         'g' || (user_id % 10) || '/u' || user_id || '/d' || (CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INT) % 5) ||
         CASE user_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.doc' WHEN 2 THEN '.ods' ELSE '.tmp' END AS path FROM events),
e1 AS (SELECT *, lag(event_type) OVER (PARTITION BY path ORDER BY ts, event_id) AS before FROM e0),
e2 AS (SELECT * FROM e1 WHERE event_type <> 'error' OR (before IS NOT NULL AND before <> 'error')),
e3 AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM e2),
e4 AS (SELECT *, min(event_id) OVER (PARTITION BY path, life) AS file_id, row_number() OVER (PARTITION BY path, life ORDER BY ts, event_id) AS vid FROM e3),
e5 AS (SELECT *, event_type = 'error' AS mark, event_type = 'signup' AND vid > 1 AS undo, CAST(round(value * 100) AS BIGINT) AS own,
         first_value(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY path, life ORDER BY ts, event_id) AS own1 FROM e4),
e6 AS (SELECT *, CASE WHEN NOT mark THEN CASE WHEN undo THEN own1 ELSE own END END AS size FROM e5),
versions AS (SELECT file_id, CAST(vid AS INT) AS version_id, CAST(NULL AS VARCHAR) AS path, size, ts AS modified,
         CAST(CASE WHEN vid > 1 THEN CASE WHEN undo THEN 1 ELSE vid - 1 END END AS INT) AS base_version_id,
         vid = 1 OR (event_id % 5 = 0 AND NOT mark AND NOT undo) AS has_image,
         CASE WHEN vid > 1 AND NOT mark THEN CASE WHEN undo THEN CASE WHEN size > 0 THEN 9 + ({enc("size")}) ELSE 7 END ELSE 10 END END AS cdelta_len,
         CASE WHEN vid > 1 AND NOT mark THEN CASE WHEN undo THEN 7 ELSE 7 + size % 50 END END AS fdelta_len,
         CASE WHEN vid > 1 AND NOT mark THEN CASE WHEN undo THEN 7 ELSE 7 + size % 30 END END AS rdelta_len, path AS file_path FROM e6),
files AS (SELECT file_id, any_value(file_path) AS path, max(version_id) AS current_version_id FROM versions GROUP BY file_id),
cur AS (SELECT f.file_id, f.path, f.current_version_id, v.size, v.modified, v.has_image FROM files f LEFT JOIN versions v ON v.file_id = f.file_id AND v.version_id = f.current_version_id),
existing AS (SELECT * FROM cur WHERE size IS NOT NULL),
replicas AS (SELECT * FROM (VALUES (1, 'h1', 'ann', '/r1', NULL), (2, 'h1', 'ann', '/r2', 2), (3, 'h2', 'bob', '/r3', 3)) t(replica_id, host, usr, root, default_filter_id)),
filters AS (SELECT * FROM (VALUES (1, 'all'), (2, 'office'), (3, 'no temp files'), (4, 'default')) t(filter_id, name)),
synced AS (SELECT f.file_id, r.replica_id, greatest(1, f.current_version_id - ((f.file_id + r.replica_id) % 3)) AS v, (f.file_id + r.replica_id) % 11 = 0 AS cut
         FROM files f, replicas r WHERE (f.file_id * 7 + r.replica_id) % 5 <> 0),
last_sync AS (SELECT s.file_id, s.replica_id, CASE WHEN NOT s.cut THEN s.v END AS version_id, CASE WHEN s.cut THEN v.size END AS size, CASE WHEN s.cut THEN v.modified END AS modified, CAST(NULL AS VARCHAR) AS path
         FROM synced s JOIN versions v ON v.file_id = s.file_id AND v.version_id = s.v),
l1 AS (SELECT s.replica_id, x.path, x.size AS cs, x.modified AS ct, v.size AS vs, v.modified AS vt, (s.file_id * 3 + s.replica_id) % 6 AS c
         FROM synced s JOIN existing x USING (file_id) JOIN versions v ON v.file_id = s.file_id AND v.version_id = s.v),
l2 AS (SELECT f.file_id, f.path, greatest(1, f.current_version_id - 1) AS v FROM files f
         WHERE f.path NOT IN (SELECT path FROM existing) AND f.file_id = (SELECT max(g.file_id) FROM files g WHERE g.path = f.path)),
listing AS (
  SELECT replica_id, path, CASE c WHEN 1 THEN cs + 1 WHEN 2 THEN vs WHEN 4 THEN cs + 7 ELSE cs END AS size,
         CASE c WHEN 1 THEN ct + INTERVAL 1 HOUR WHEN 2 THEN vt WHEN 3 THEN ct + INTERVAL 2 SECOND WHEN 4 THEN ct - INTERVAL 1 HOUR ELSE ct END AS mtime
  FROM l1 WHERE c <> 0 AND (c <> 2 OR vs IS NOT NULL)
  UNION ALL SELECT s.replica_id, l2.path, v.size, v.modified FROM l2 JOIN synced s USING (file_id) JOIN versions v ON v.file_id = l2.file_id AND v.version_id = l2.v WHERE v.size IS NOT NULL
  UNION ALL SELECT r.replica_id, 'new/r' || r.replica_id || '/u' || u.range || '.txt', u.range * 10, TIMESTAMP '2024-02-01' FROM replicas r, range(20) u
  UNION ALL SELECT 1, min(path) || '/under.txt', 1, TIMESTAMP '2024-02-01' FROM existing HAVING min(path) IS NOT NULL),
rfiles AS (SELECT file_id, CASE WHEN file_id % 7 = 0 AND current_version_id >= 2 THEN 'moved/' || path ELSE path END AS path, current_version_id, path AS old FROM files),
rversions AS (SELECT v.* REPLACE (CASE WHEN f.path <> f.old AND v.version_id < f.current_version_id THEN f.old END AS path), f.path AS now_path, f.current_version_id FROM versions v JOIN rfiles f USING (file_id)),
op_log AS (SELECT o_orderkey AS entry, nullif(o_custkey % 4, 0) AS replica_id, nullif(o_orderkey % 5, 0) AS filter_id, o_orderkey % 2 = 1 AS filter_inverted, o_orderdate AS started,
         o_orderpriority AS operation, CASE o_orderstatus WHEN 'F' THEN '' WHEN 'P' THEN 'failed' END AS status FROM orders),
op_log_params AS (SELECT l_orderkey AS entry, 'p' || l_linenumber AS name, max(l_returnflag || l_linestatus) AS value FROM lineitem GROUP BY l_orderkey, l_linenumber),
parts AS (SELECT f.path AS full_path, array_to_string(string_split(f.path, '/')[1:i.range], '/') AS prefix, i.range AS depth, len(string_split(f.path, '/')) AS n
         FROM (SELECT DISTINCT path FROM files) f, range(1, 20) i WHERE i.range <= len(string_split(f.path, '/'))),
closure AS (SELECT file_id, version_id AS ancestor, version_id AS descendant, 0 AS depth FROM versions
  UNION ALL SELECT c.file_id, v.base_version_id, c.descendant, c.depth + 1 FROM closure c JOIN versions v ON v.file_id = c.file_id AND v.version_id = c.ancestor WHERE v.base_version_id IS NOT NULL),
mt AS (SELECT l.replica_id, l.path, l.mtime, f.file_id, v.version_id, v.modified, f.current_version_id, x.file_id IS NOT NULL AS alive,
         EXISTS (SELECT 1 FROM last_sync s WHERE s.file_id = f.file_id AND s.replica_id = l.replica_id AND s.version_id = v.version_id) AS synced
  FROM listing l JOIN files f ON f.path = l.path JOIN versions v ON v.file_id = f.file_id AND v.size = l.size LEFT JOIN existing x ON x.file_id = f.file_id
  WHERE v.modified >= l.mtime - INTERVAL 2999 MILLISECOND AND v.modified <= l.mtime + INTERVAL 2999999 MICROSECOND),
best AS (SELECT * FROM mt QUALIFY row_number() OVER (PARTITION BY replica_id, path ORDER BY alive DESC, synced DESC, modified DESC, file_id DESC, version_id DESC) = 1),
srec AS (SELECT s.file_id, s.replica_id, s.version_id, s.size, s.modified, s.path, CASE WHEN s.version_id IS NULL THEN s.size IS NULL ELSE v.file_id IS NOT NULL AND v.size IS NULL END AS deleted
  FROM last_sync s LEFT JOIN versions v ON v.file_id = s.file_id AND v.version_id = s.version_id)
"""


def sql(body: str, more: str = "") -> str:
    return f"WITH RECURSIVE {CTES}{', ' + more if more else ''} {body}"
