"""DuckDB text of every query that SQL can express, over the driver's views.

The CTE blocks below are the same bindings as ``sources.bindings`` and the
operators, written once in SQL.  Doubles are rounded to 6 digits and
timestamps printed as text on both sides.
"""

from __future__ import annotations

EXT_RE = r"[^/.][^/]*(\.[^./]*)$"

HISTORY = r"""
ev AS (SELECT event_id, user_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) // 3600 AS commit_seq,
         strftime(date_trunc('hour', ts), '%Y%m%d%H') AS commit_id, date_trunc('hour', ts) AS committer_ts, ts,
         concat('v', CASE WHEN ts < TIMESTAMP '2024-01-11 00:00:00' THEN '0' WHEN ts < TIMESTAMP '2024-01-21 00:00:00' THEN '1' ELSE '2' END,
                '/d', CAST(user_id % 10 AS VARCHAR), '/user_', CAST(user_id AS VARCHAR),
                CASE WHEN user_id % 13 = 0 THEN '.png' ELSE '.py' END) AS path,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn_desc
       FROM events),
mods AS (SELECT commit_seq, commit_id, committer_ts, event_id AS ord, user_id, rn_desc,
           lag(path) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_path,
           CASE WHEN rn_desc = 1 AND user_id % 17 = 0 THEN NULL ELSE path END AS new_path
         FROM ev),
files AS (SELECT new_path AS path FROM mods WHERE rn_desc = 1 AND new_path IS NOT NULL),
live AS (SELECT DISTINCT path FROM files
         WHERE regexp_extract(path, '[^/.][^/]*(\.[^./]*)$', 1) NOT IN ('.zip', '.gif', '.png')),
commits AS (SELECT DISTINCT commit_seq, commit_id, committer_ts FROM mods),
renames AS (SELECT old_path, new_path FROM (
              SELECT old_path, new_path,
                     row_number() OVER (PARTITION BY old_path ORDER BY commit_seq DESC, ord DESC) AS rn
              FROM mods WHERE old_path IS NOT NULL AND old_path IS DISTINCT FROM new_path) WHERE rn = 1),
edges AS (SELECT old_path, new_path FROM renames WHERE old_path NOT IN (SELECT path FROM live)),
starts AS (SELECT DISTINCT new_path AS path FROM mods WHERE new_path IS NOT NULL),
walk(path, cur, hops) AS (
  SELECT path, path, 0 FROM starts
  UNION ALL
  SELECT w.path, e.new_path, w.hops + 1 FROM walk w JOIN edges e ON w.cur = e.old_path WHERE w.hops < 50),
last_step AS (SELECT path, cur, hops, row_number() OVER (PARTITION BY path ORDER BY hops DESC) AS rn FROM walk),
resolved AS (SELECT path, CASE WHEN cur IN (SELECT path FROM live) OR hops = 50 THEN cur ELSE NULL END AS current_path
             FROM last_step WHERE rn = 1),
sizes AS (SELECT commit_seq, count(*) AS n_mods FROM mods GROUP BY commit_seq),
touches AS (SELECT m.commit_seq, m.commit_id, m.committer_ts, m.ord, r.current_path AS path, s.n_mods
            FROM mods m JOIN resolved r ON m.new_path = r.path JOIN sizes s ON s.commit_seq = m.commit_seq
            WHERE r.current_path IS NOT NULL),
inc AS (SELECT DISTINCT path, commit_seq FROM touches),
heights AS (SELECT path, count(*) AS height FROM inc GROUP BY path),
clusters AS (SELECT path, CAST(regexp_extract(path, '/d([0-9]+)/', 1) AS INTEGER) AS label FROM heights),
buildings AS (SELECT c.label, c.path AS fileName, h.height FROM clusters c JOIN heights h USING (path)),
lc AS (SELECT DISTINCT i.commit_seq, c.label FROM inc i JOIN clusters c USING (path)),
routes AS (SELECT x.label AS "start", y.label AS "end", count(*) AS width
           FROM lc x JOIN lc y ON x.commit_seq = y.commit_seq AND x.label <> y.label GROUP BY 1, 2),
file_dates AS (SELECT path, arg_min(committer_ts, commit_seq * 1000000000 + ord) AS creation_date,
                      arg_max(committer_ts, commit_seq * 1000000000 + ord) AS last_modification
               FROM touches GROUP BY path),
layout AS (SELECT t.path, h.height AS x, count(DISTINCT CAST(t.committer_ts AS DATE)) AS y
           FROM touches t JOIN heights h USING (path) GROUP BY t.path, h.height),
cents AS (SELECT c.label, avg(l.x) AS x, avg(l.y) AS y FROM layout l JOIN clusters c USING (path) GROUP BY c.label),
cities AS (SELECT label, x / (SELECT max(x) FROM cents) AS x, y / (SELECT max(y) FROM cents) AS y FROM cents)
"""

BASKETS = r"""
li AS (SELECT DISTINCT l_orderkey AS commit_seq, concat('part_', CAST(l_partkey AS VARCHAR)) AS path FROM lineitem)
"""

ORDERS = r"""
oi AS (SELECT DISTINCT CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS commit_seq,
              concat('cust_', CAST(o_custkey AS VARCHAR)) AS path FROM orders)
"""

CORPUS = r"""
docs AS (SELECT concat('doc_', CAST(doc_id AS VARCHAR)) AS path, text FROM documents),
idents AS (SELECT path, i - 1 AS ipos, ids[i] AS ident
           FROM (SELECT path, ids, unnest(generate_series(1, len(ids))) AS i
                 FROM (SELECT path, regexp_extract_all(text, '[\p{L}_][\p{L}\p{N}_]*') AS ids FROM docs))),
pieces AS (SELECT path, ipos, ident, p - 1 AS spos, sp[p] AS piece
           FROM (SELECT path, ipos, ident, sp, unnest(generate_series(1, len(sp))) AS p
                 FROM (SELECT path, ipos, ident, string_split(ident, '_') AS sp FROM idents))),
camel AS (SELECT path, ipos, spos, string_split(
             regexp_replace(regexp_replace(piece, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'),
             ' ') AS cw FROM pieces WHERE piece <> ''),
tokens AS (SELECT path, lower(w) AS word FROM (SELECT path, unnest(cw) AS w FROM camel) WHERE w <> ''),
ntok AS (SELECT path, count(*) AS n_tokens FROM tokens GROUP BY path),
tf AS (SELECT t.path, t.word, count(*) / any_value(n.n_tokens) AS tf FROM tokens t JOIN ntok n USING (path) GROUP BY t.path, t.word),
df AS (SELECT word, count(DISTINCT path) AS df FROM tokens GROUP BY word),
idf AS (SELECT word, df, ln((SELECT count(*) FROM docs) / df) AS idf FROM df),
tfidf AS (SELECT tf.path, tf.word, tf.tf, idf.idf, tf.tf * idf.idf AS w FROM tf JOIN idf USING (word)),
nz AS (SELECT * FROM tfidf WHERE w <> 0),
norms AS (SELECT path, sqrt(sum(w * w)) AS norm FROM nz GROUP BY path),
unit AS (SELECT nz.path, nz.word, nz.w / norms.norm AS u FROM nz JOIN norms USING (path)),
cosine AS (SELECT x.path AS a, y.path AS b, sum(x.u * y.u) AS similarity
           FROM unit x JOIN unit y ON x.word = y.word AND x.path < y.path GROUP BY 1, 2)
"""

POINTS = r"""
pts AS (SELECT concat('vec_', lpad(CAST(vec_id AS VARCHAR), 5, '0')) AS path, vec_id,
               CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)
"""


def with_(*blocks: str, recursive: bool = False) -> str:
    body = ",\n".join(b.strip().rstrip(",") for b in blocks)
    return ("WITH RECURSIVE " if recursive else "WITH ") + body + "\n"


def hist(select: str, *extra: str) -> str:
    return with_(HISTORY, *extra, recursive=True) + select


TS = "'%Y-%m-%d %H:%M:%S'"
