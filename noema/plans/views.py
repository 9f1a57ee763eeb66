"""The derived views as SQL, for the oracle."""

KP = """kp AS (SELECT doc_id AS id, text AS fact, CASE doc_id % 5 WHEN 0 THEN 'concept' WHEN 1 THEN 'fact' WHEN 2 THEN 'method' WHEN 3 THEN 'opinion' ELSE 'pending' END AS category, source, lang, CAST((doc_id * 37) % 101 AS DOUBLE) / 100 AS confidence, CAST(2 + doc_id % 4 AS DOUBLE) AS feedback_alpha, CAST(2 + doc_id % 3 AS DOUBLE) AS feedback_beta, CAST(doc_id % 9 AS INT) AS interaction_count, DATE '2024-01-01' + CAST((doc_id * 13) % 365 AS INT) AS created_on, CASE WHEN doc_id % 17 = 0 THEN 'replaced' WHEN doc_id % 23 = 0 THEN 'error' ELSE 'active' END AS status FROM documents)"""

EDGES = """edges AS (SELECT concat('n', n_nationkey) AS src, concat('r', n_regionkey) AS dst, 'PART_OF' AS rel, CAST(0.9 AS DOUBLE) AS conf FROM nation
UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), 'BELONGS_TO', CAST(c_custkey % 50 AS DOUBLE) / 100 + 0.5 FROM customer
UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), 'BELONGS_TO', CAST(s_suppkey % 50 AS DOUBLE) / 100 + 0.5 FROM supplier
UNION ALL SELECT concat('c', c_custkey), concat('m', c_mktsegment), 'IS_A', CAST(0.8 AS DOUBLE) FROM customer
UNION ALL SELECT DISTINCT concat('m', c_mktsegment), concat('p', o_orderpriority), 'CAUSES', CAST(0.7 AS DOUBLE) FROM customer JOIN orders ON c_custkey = o_custkey
UNION ALL SELECT concat('r', n_regionkey), concat('n', n_nationkey), 'INDICATES', CAST(0.6 AS DOUBLE) FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT concat('n', n_nationkey), concat('n', coalesce(lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), min(n_nationkey) OVER (PARTITION BY n_regionkey))), 'CONFLICTS_WITH', CAST(0.4 AS DOUBLE) FROM nation),
both_ways AS (SELECT src, dst, rel, conf FROM edges UNION ALL SELECT dst, src, rel, conf FROM edges)"""

TOKENS = r"""tok AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}_]', ' ', 'g'), '\s+'), lambda x: x <> '') AS t FROM documents)"""

OPS = """ops AS (SELECT event_id, user_id, event_type AS memory_type, CAST(props->>'k' AS INT) AS memory_key, value, ts FROM events)"""

VECTORS = """vec AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"""
