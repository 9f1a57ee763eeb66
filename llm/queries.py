"""The registered queries of the ten operators, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import table


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.pseudonyms import pseudonymise, session_key

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.jaccard_join import text_classes
    from llm.packing import pack

    docs = table(spark, sf_dir, "documents")
    return pack(docs, alike=text_classes(docs))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op4_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.tool_calls import link, with_calls

    return link(with_calls(table(spark, sf_dir, "conversations")))


def op5_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.kd_shards import kd_shards

    out = kd_shards(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.jaccard_join import ngram_jaccard_components

    return ngram_jaccard_components(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.ppm import identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    learn = docs.where(fold != 0).select("lang", "text", F.xxhash64("doc_id").alias("pick"))
    found = identify(docs, learn)
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.importance import sample

    return sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.maxscore import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op10_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.projections import nearest

    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.target_resampling import draw

    return draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.fingerprints import edited

    return edited(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.conversation_repair import repair

    return repair(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_feistel_pseudonyms, op2_best_fit_packing, op3_source_mixing, op4_tool_call_linking, op5_kd_sharding, op6_ngram_jaccard_join, op7_language_id, op8_importance_resampling, op9_maxscore, op10_stable_projections, op11_conversation_repair, op12_target_resampling, op13_document_fingerprints)}

SQL = {
    "op4_tool_call_linking": r"""
WITH m AS (SELECT *, (conv_id * 7 + turn) % 10 AS k, role = 'assistant' AS calls, role = 'user' AND turn > 0 AS answers FROM conversations),
c AS (SELECT conv_id, turn, 2 * row_number() OVER (PARTITION BY conv_id, turn // 8 ORDER BY turn) - 1 AS level FROM m WHERE calls),
text AS (SELECT conv_id, turn, CASE WHEN answers THEN 1 ELSE 0 END AS item, 'text' AS kind, NULL AS call_id, 'ok' AS status, turn AS order_turn, 0 AS level,
  concat('{"content":', CAST(to_json(text) AS VARCHAR), ',"role":"', role, '","turn":', turn, '}') AS json FROM m WHERE regexp_matches(text, '\S')),
call AS (SELECT m.conv_id, m.turn, CASE WHEN regexp_matches(text, '\S') THEN 1 ELSE 0 END AS item, 'call' AS kind, concat('c', m.turn) AS call_id,
  CASE WHEN k % 4 = 3 THEN 'unknown_tool' WHEN k % 4 = 0 AND k * 15 NOT BETWEEN 1 AND 100 OR k % 4 = 1 AND k <= 2 OR k % 4 = 2 THEN 'invalid'
    WHEN EXISTS (SELECT 1 FROM m AS r WHERE r.answers AND r.conv_id = m.conv_id AND r.turn = m.turn + 1) THEN 'ok' ELSE 'pending' END AS status, m.turn AS order_turn, c.level,
  concat('{"arguments":{', CASE WHEN k > 5 THEN '"expression":"1+1",' ELSE '' END, CASE WHEN k > 2 THEN '"key":"x",' ELSE '' END, '"limit":', k * 15, ',"query":"assistant"},"id":"c', m.turn, '","name":"', (['search', 'lookup', 'calculate', 'translate'])[k % 4 + 1], '","role":"assistant","turn":', m.turn, ',"type":"call"}') AS json
  FROM m JOIN c USING (conv_id, turn)),
result AS (SELECT m.conv_id, m.turn, 0 AS item, 'result' AS kind, concat('c', m.turn - 1) AS call_id, CASE WHEN c.turn IS NULL THEN 'orphan' ELSE 'ok' END AS status, m.turn AS order_turn, coalesce(c.level + 1, 0) AS level,
  concat('{"content":', k, ',"id":"c', m.turn - 1, '","role":"user","turn":', m.turn, ',"type":"result"}') AS json FROM m LEFT JOIN c ON c.conv_id = m.conv_id AND c.turn = m.turn - 1 WHERE answers)
SELECT conv_id, turn, CAST(item AS INTEGER) AS item, kind, call_id, status, order_turn, CAST(level AS INTEGER) AS level, json FROM (SELECT * FROM text UNION ALL SELECT * FROM call UNION ALL SELECT * FROM result)
""",
    "op6_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 2], ' ') END AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
ends AS (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links),
reach(node, low) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.low FROM reach r JOIN ends e ON e.a = r.node),
c AS (SELECT node, min(low) AS component FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
""",
    "op9_maxscore": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT vec_id AS query_id, v AS u FROM e WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, CAST(list_sum(list_transform(range(1, len(v) + 1), lambda i: u[i] * v[i])) AS BIGINT) AS score FROM q JOIN e ON query_id <> vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
""",
    "op11_conversation_repair": r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS f FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(f)), lambda j: CAST(concat('0x', substr(hex(f), 2 * j + 1, 2)) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS h FROM k, crc),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, substr(role, 1, 1) AS u FROM d),
r AS (SELECT conv_id, turn, role, text, i, u, lead(u) OVER (PARTITION BY conv_id ORDER BY i) AS v,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM o),
-- the cheapest edits (c), their letters (a) and rows (t) for each state: nothing yet, after s, after u, after a
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, [{'c': 0, 'a': '', 't': ''}, {'c': 999999999, 'a': '', 't': ''}, {'c': 999999999, 'a': '', 't': ''}, {'c': 999999999, 'a': '', 't': ''}] AS s FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i + 1, [
    {'c': s[1].c + 2, 'a': s[1].a || 'D', 't': s[1].t},
    list_min([{'c': s[2].c + 2, 'a': s[2].a || 'D', 't': s[2].t}, {'c': s[1].c + CASE WHEN u = 's' THEN more ELSE 999999999 END, 'a': s[1].a || 'K', 't': s[1].t || row}]),
    list_min([{'c': z3.c + 2, 'a': z3.a || 'D', 't': z3.t}, {'c': z.c + CASE WHEN u = 'u' THEN more ELSE 999999999 END, 'a': z.a || 'K', 't': z.t || row}, {'c': z.c + 1 + more, 'a': z.a || 'R', 't': z.t || 'user:' || text || chr(10)}]),
    list_min([{'c': z4.c + 2, 'a': z4.a || 'D', 't': z4.t}, {'c': z3.c + CASE WHEN u = 'a' THEN more ELSE 999999999 END, 'a': z3.a || 'K', 't': z3.t || row}, {'c': z3.c + 1 + more, 'a': z3.a || 'R', 't': z3.t || 'assistant:' || text || chr(10)}])]
  FROM (SELECT *, list_min([s[1], s[2], z4]) AS z FROM (SELECT *, list_min([s[4], {'c': z3.c + 5, 'a': z3.a || 'I', 't': z3.t || 'assistant:' || chr(10)}]) AS z4 FROM (
    SELECT dp.conv_id, dp.i, s, u, text, CASE fault WHEN 't' THEN 5 WHEN '' THEN 0 ELSE 999999999 END AS more, role || ':' || text || chr(10) AS row, list_min([s[3],
      {'c': s[1].c + 5, 'a': s[1].a || 'I', 't': s[1].t || 'user:' || chr(10)}, {'c': s[2].c + 5, 'a': s[2].a || 'I', 't': s[2].t || 'user:' || chr(10)}, {'c': s[4].c + 5, 'a': s[4].a || 'I', 't': s[4].t || 'user:' || chr(10)}]) AS z3
    FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1)))
), n AS (SELECT conv_id, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (v IS NOT NULL AND u || v NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
e AS (SELECT conv_id, i, list_min([s[1], s[4], {'c': s[3].c + 5, 'a': s[3].a || 'I', 't': s[3].t || 'assistant:' || chr(10)}, {'c': s[2].c + 10, 'a': s[2].a || 'II', 't': s[2].t || 'user:' || chr(10) || 'assistant:' || chr(10)}]) AS s FROM dp)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(s.c AS BIGINT) AS cost, s.a AS audit, sha256(CASE WHEN s.t = '' THEN '' ELSE left(s.t, length(s.t) - 1) END) AS repaired_sha256
FROM e LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM e.conv_id WHERE e.i = coalesce(n.n, 0)
""",
    "op12_target_resampling": r"""
WITH d AS (SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 't', NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])))) AS f FROM d),
c AS (SELECT side, doc_id, f, count(*) AS n FROM f GROUP BY ALL),
-- crc32 by its table of 256, each entry made by eight shifts
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
h AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(f)), lambda k: CAST(concat('0x', substr(hex(f), 2 * k + 1, 2)) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM c), crc),
n AS (SELECT bucket, sum(CASE WHEN side = 'd' THEN n ELSE 0 END)::DOUBLE AS s, sum(CASE WHEN side = 't' THEN n ELSE 0 END)::DOUBLE AS t FROM c JOIN h USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n) + 10000) / ((s + 1) * ((SELECT sum(t) FROM n) + 10000)))) AS BIGINT) AS gain FROM n),
x AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)) AS BIGINT) AS weight FROM c JOIN h USING (f) JOIN g USING (bucket) WHERE side = 'd' GROUP BY doc_id),
y AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256(concat('7:', doc_id)), 1, 8)) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM documents LEFT JOIN x USING (doc_id)),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n_features >= 39)
SELECT y.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM z) * 25 // 100 THEN rank END AS rank FROM y LEFT JOIN z ON z.doc_id = y.doc_id
""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
