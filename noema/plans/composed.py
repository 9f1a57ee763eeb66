"""Queries that put several operators together: feedback on a fact, trust in sources, batches of deletions, conflicts of an answer, questions of recordings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from noema.functions import rules, scores
from noema.operators import categories, dedup, graph, retrieval, timeline
from noema.plans.queries import _COS, _DAYS, _QUALITY, _quality, _query_vector, _r, _vectors, query
from noema.plans.views import EDGES, KP
from noema.sources import store
from noema.sources.tables import adjacency, knowledge, read

# confidence

_KIND = "CASE id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'correct' END"


@query(f"""WITH {KP}, {EDGES}, g AS (SELECT src AS node, avg(conf) / (1 + exp(-0.5 * (count(*) - 3))) AS c FROM both_ways GROUP BY src), e AS (SELECT id, unnest([concat('c', id), concat('s', id), concat('n', id % 30)]) AS node FROM kp), f AS (SELECT id, coalesce(avg(c), 0.5) AS graph FROM e LEFT JOIN g USING (node) GROUP BY id),
k AS (SELECT * REPLACE (interaction_count + 1 AS interaction_count), {_KIND} AS kind FROM kp),
b AS (SELECT k.id, kind, interaction_count AS interactions, 0.4 * confidence + 0.3 * CAST({_QUALITY} AS DOUBLE) + 0.3 * graph AS base, CASE WHEN kind = 'negative' THEN feedback_alpha ELSE feedback_alpha + 1 END AS a, CASE kind WHEN 'negative' THEN feedback_beta + 1 ELSE greatest(1, feedback_beta - CASE kind WHEN 'correct' THEN 0.5 ELSE 0 END) END AS b, {_DAYS} AS days FROM k JOIN f USING (id)),
c AS (SELECT *, least(greatest(round((CASE WHEN a > 2 OR b > 2 THEN (base + a / (a + b)) / 2 ELSE base END) * exp(-0.005 * greatest(days, 0)) + 1e-9, 4), 0.1), 1.0) AS conf FROM b)
SELECT id, kind, interactions, a::DOUBLE AS alpha, b::DOUBLE AS beta, round(CASE WHEN kind = 'negative' THEN least(greatest(conf * 0.8, 0.1), 1.0) ELSE conf END, 6)::DOUBLE AS conf FROM c""")
def cnf_feedback_taken_in(s, d):
    """A user's feedback on every fact: alpha, beta and interactions move, all four terms are computed anew, a negative one contradicts."""
    node = F.explode(F.array(F.concat(F.lit("c"), "id"), F.concat(F.lit("s"), "id"), F.concat(F.lit("n"), F.col("id") % 30)))
    k = knowledge(s, d).withColumn("interaction_count", F.col("interaction_count") + 1).withColumn("kind", F.expr(_KIND))
    term = graph.fact_consistency(k.select("id", node.alias("node")), adjacency(s, d))
    days = F.datediff(F.lit("2025-01-01").cast("date"), "created_on")
    a, b = F.col("feedback_alpha"), F.col("feedback_beta")
    alpha, beta = scores.updated(F.col("kind"), a, b)
    conf = scores.after_feedback(F.col("kind"), F.col("confidence"), _quality(), F.col("consistency"), a, b, days)
    return k.join(term, "id").select("id", "kind", F.col("interaction_count").alias("interactions"), alpha.alias("alpha"), beta.alias("beta"), _r(conf).alias("conf"))


_NAMED = "source || CASE ascii(right(source, 1)) % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.pptx' WHEN 3 THEN '-image' WHEN 4 THEN '-web' ELSE '' END"


@query(f"""WITH {KP}, n AS (SELECT {_NAMED} AS name, count(*) AS n, count(*) FILTER (status = 'replaced') AS fixed FROM kp GROUP BY 1)
SELECT name, CASE WHEN name LIKE '%.pdf' THEN 'PDF文档' WHEN name LIKE '%.docx' THEN 'Word文档' WHEN name LIKE '%.pptx' THEN 'PPT演示' WHEN name LIKE '%-image' THEN '图片' WHEN name LIKE '%-web' THEN '网页' ELSE '文本' END AS kind,
round(CAST(least(greatest(0.5 + least(0.15, 0.01 * n) + CASE WHEN name LIKE '%.pdf' THEN 0.1 WHEN name LIKE '%.docx' THEN 0.05 WHEN name LIKE '%.pptx' THEN 0.03 WHEN name LIKE '%-web' THEN -0.05 WHEN name LIKE '%-image' THEN -0.1 ELSE 0 END - 0.2 * least(fixed, 5) * 0.04, 0.2), 1.0) AS DOUBLE), 6) AS trust FROM n""")
def cnf_source_trust_by_kind(s, d):
    """Sources named as files, pictures and pages: by how many facts they gave, what kind they are and how often they were corrected."""
    by = knowledge(s, d).groupBy(F.expr(_NAMED).alias("name")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "replaced").alias("fixed"))
    kind = rules.source_type(F.col("name"))
    return by.select("name", kind.alias("kind"), _r(scores.source_trust(F.col("n"), F.col("fixed"), kind, rules.SOURCE_BONUS)).alias("trust"))


# deletions, categories, equal facts

@query("""WITH a AS (SELECT CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey * 30 END AS id FROM supplier), r AS (SELECT id, CASE WHEN id IS NULL THEN 'failed' ELSE 'deleted' END AS outcome, id IN (SELECT c_custkey FROM customer) AND id IS NOT NULL AS known FROM a)
SELECT outcome, count(*) AS n, count(*) FILTER (known) AS known, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT id FROM a WHERE id IS NOT NULL)) AS left_over FROM r GROUP BY outcome""")
def mut_delete_batch(s, d):
    """Ids of which some are unknown and some are none: what counts as deleted, what failed, how many rows are left."""
    rows = read(s, d, "customer").select(F.col("c_custkey").alias("id"))
    left, told = store.delete_batch(rows, read(s, d, "supplier").select(F.when(F.col("s_suppkey") % 7 != 0, F.col("s_suppkey") * 30).alias("id")))
    n = left.agg(F.count("*").alias("left_over"))
    return told.groupBy("outcome").agg(F.count("*").alias("n"), F.count_if("known").alias("known")).join(F.broadcast(n))  # one row


@query("SELECT n_nationkey AS place, n_name AS name, concat(r_name, ' ', n_nationkey % 3) AS description FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0 AND (contains(n_name, '1') OR n_nationkey % 3 = 1) UNION ALL (SELECT n_nationkey, n_name, NULL FROM nation WHERE n_nationkey % 2 = 1 AND contains(n_name, '1')) ORDER BY place LIMIT 8")
def ctg_search(s, d):
    """Nations by their name or by what describes every other one."""
    described = F.when(F.col("n_nationkey") % 2 == 0, F.concat("r_name", F.lit(" "), F.col("n_nationkey") % 3))
    regions = read(s, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    cats = read(s, d, "nation").join(regions, "n_regionkey").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("name"), described.alias("description"))
    return categories.search(cats, "1", 8)


@query(f"WITH {KP} SELECT a.id AS first, b.id AS second, a.fact AS fact, a.interaction_count AS first_version, b.interaction_count AS second_version FROM kp a JOIN kp b ON a.fact = b.fact AND a.id < b.id ORDER BY first, second LIMIT 20")
def dup_equal_pairs(s, d):
    return dedup.equal_pairs(knowledge(s, d).withColumn("version", F.col("interaction_count")))


# answers and recordings

_HITS = f"{_COS}, t AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS place FROM vs ORDER BY score DESC, id LIMIT 10), h AS (SELECT place, concat('Said: ', label, ', ', id % 2, ' and no more than this is said here; of ', id) AS fact FROM t JOIN vec USING (id)), x AS (SELECT place, fact, regexp_replace(substring(fact, 1, 30), '[，,。；;：:\\s]+', '', 'g') AS start FROM h), c AS (SELECT place, substring(fact, 1, 50) AS fact, substring(first_value(fact) OVER w, 1, 50) AS earlier, row_number() OVER w AS nth FROM x WINDOW w AS (PARTITION BY start ORDER BY place))"


def _hits(s, d):
    """The ten nearest vectors in order, each with a statement made of its label, so that some begin alike."""
    vectors = _vectors(s, d)
    top = retrieval.vector_top(vectors, _query_vector(s, d), 10).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # ten rows
    return top.join(vectors.select("id", "label"), "id").select("place", F.concat(F.lit("Said: "), "label", F.lit(", "), F.col("id") % 2, F.lit(" and no more than this is said here; of "), "id").alias("fact"))


@query(f"WITH {_HITS} SELECT place, fact, earlier FROM c WHERE nth > 1 ORDER BY place LIMIT 3")
def ret_conflicts(s, d):
    return retrieval.conflicts(_hits(s, d))


@query(f"WITH {_HITS}, b AS (SELECT score, label FROM vs ORDER BY score DESC, id LIMIT 8) SELECT count(*) AS retrieval_count, round(avg(score), 6) AS avg_similarity, round(max(score), 6) AS max_similarity, avg(score) < 0.5 AS is_below_threshold, count(DISTINCT label) >= 2 AS multi_source_verified, least(3, (SELECT count(*) FROM c WHERE nth > 1)) AS conflict_count FROM b")
def mut_answer_metadata_whole(s, d):
    """What an answer carries with it as one struct, the conflicts of what it was made from among it."""
    vectors = _vectors(s, d)
    best = retrieval.vector_top(vectors, _query_vector(s, d), 8).join(vectors.select("id", F.col("label").alias("source")), "id")
    q = retrieval.quality(best).join(F.broadcast(retrieval.conflicts(_hits(s, d)).agg(F.count("*").alias("conflicts"))))  # one row each
    fields = {"retrieval_count": F.col("n"), "avg_similarity": _r("avg_score"), "max_similarity": _r("max_score"), "is_below_threshold": F.col("below"), "multi_source_verified": F.col("multi_source"), "conflict_count": F.col("conflicts")}
    return q.select(F.struct(*[c.alias(k) for k, c in fields.items()]).alias("metadata")).select("metadata.*")


@query("""WITH c AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), n AS (SELECT conv_id, count(*) FILTER (trim(text) <> '') AS chunks FROM conversations GROUP BY conv_id)
SELECT conv_id, any_value(chunks) AS chunk_index, count(*) AS pairs, concat('=== 问答对提取 ===', chr(10), string_agg(concat('Q: ', text, chr(10), 'A: ', answer, chr(10)), chr(10) ORDER BY turn)) AS content FROM c JOIN n USING (conv_id) WHERE role = 'user' AND next_role = 'assistant' GROUP BY conv_id""")
def src_qa_chunks(s, d):
    """Questions of users with the answers that follow them, as the chunk after a recording's segments."""
    c = read(s, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = c.withColumn("next", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w)).where("role = 'user' and next = 'assistant'")
    segments = c.groupBy("conv_id").agg(F.count_if(F.trim("text") != "").alias("chunks"))
    return timeline.qa_chunks(pairs.select("conv_id", F.col("turn").alias("at"), F.col("text").alias("question"), "answer"), segments, "conv_id")
