"""Queries on the upkeep of a knowledge base: category evolution, tags and collections, registries, retrieval over the graph, health."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noema.functions import scores, text
from noema.operators import categories, dedup, graph, listing, memory, retrieval, segments
from noema.operators.blocks import small
from noema.plans.queries import by_confidence, by_day, _BM25, _COS, _query_vector, _r, _texts, _vectors, STOP, TERMS, query
from noema.plans.views import EDGES, KP, OPS, TOKENS, VECTORS
from noema.sources import store
from noema.sources.tables import adjacency, edges, knowledge, memory_ops, read
from noema.streaming import memory_state, registry

# retrieval

_GRAPH_LANE = "gl AS (SELECT kp.id, confidence AS score FROM kp JOIN (SELECT DISTINCT dst FROM both_ways WHERE src = 'n3') e ON e.dst = concat('c', kp.id))"


@query(f"""WITH {KP}, {EDGES}, {_BM25}, {_COS}, {_GRAPH_LANE}, b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT * FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 20)),
c AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT id, score FROM vs ORDER BY score DESC, id LIMIT 20)),
g AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT * FROM gl ORDER BY score DESC, id LIMIT 10))
SELECT id, round(sum(1.0 / (60 + r)), 9) AS rrf, count(*) AS lanes FROM (SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM g) GROUP BY id ORDER BY rrf DESC, id LIMIT 10""")
def ret_hybrid_graph(s, d):
    """The graph lane has the knowledge whose entity is within one hop of the question's."""
    near = graph.neighbours(adjacency(s, d), "n3").select("node")
    k = knowledge(s, d).select("id", F.col("confidence").alias("score"), F.concat(F.lit("c"), "id").alias("node"))
    lane = k.join(near, "node", "left_semi").select("id", "score").orderBy(F.desc("score"), "id").limit(10)
    lanes = [retrieval.ranked(*retrieval.index(s, d), TERMS, 20), retrieval.vector_top(_vectors(s, d), _query_vector(s, d), 20), lane]
    return retrieval.fuse(lanes, 10).select("id", F.round("rrf", 9).alias("rrf"), "lanes")


@query(f"WITH {KP}, {_COS}, t AS (SELECT id, score FROM vs ORDER BY score DESC, id LIMIT 3) SELECT t.id, substring(fact, 1, 100) AS fact, source, confidence, category FROM t JOIN kp USING (id)")
def ret_citations(s, d):
    top = retrieval.vector_top(_vectors(s, d), _query_vector(s, d), 3).select("id")
    return knowledge(s, d).join(F.broadcast(top), "id").select("id", F.substring("fact", 1, 100).alias("fact"), "source", "confidence", "category")


@query(f"WITH {KP}, t AS (SELECT substring(fact, 1, 100) AS fact, source, confidence, category FROM kp ORDER BY confidence DESC, id LIMIT 5), w AS (SELECT coalesce(url, 'web') AS source, 0.7 AS confidence, 'web_search' AS category, substring(html, 1, 100) AS fact FROM pages ORDER BY page_id LIMIT 3) SELECT fact, source, CAST(confidence AS DOUBLE) AS confidence, category FROM t UNION ALL SELECT fact, source, CAST(confidence AS DOUBLE), category FROM w")
def set_merged_sources(s, d):
    own = knowledge(s, d).orderBy(F.desc("confidence"), "id").limit(5).select(F.substring("fact", 1, 100).alias("fact"), "source", "confidence", "category")
    web = read(s, d, "pages").orderBy("page_id").limit(3).select(F.substring("html", 1, 100).alias("fact"), F.coalesce("url", F.lit("web")).alias("source"), F.lit(0.7).alias("confidence"), F.lit("web_search").alias("category"))
    return own.unionByName(web)


@query("WITH q AS (SELECT conv_id, turn, text AS q, lower(text) AS a, replace(text, '.', '?') AS b FROM conversations WHERE role = 'user') SELECT conv_id, turn, q AS query, array_to_string(list_filter([q, CASE WHEN a <> q THEN a WHEN b <> q THEN b END, CASE WHEN a <> q AND b <> q AND a <> b THEN b END], lambda x: x IS NOT NULL), ' | ') AS variants FROM q")
def set_query_variants(s, d):
    """The question itself, then a model's rewrites (here: in lower case, and as a question) without repeats."""
    asked = read(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    v = retrieval.variants(asked, F.array("query", F.lower("query"), F.replace("query", F.lit("."), F.lit("?"))))
    return v.select("conv_id", "turn", "query", F.array_join("variants", " | ").alias("variants"))


@query(f"WITH {TOKENS} SELECT count(*) AS documents, CAST(sum(len(t)) AS BIGINT) AS tokens FROM tok JOIN documents ON id = doc_id WHERE text <> ''")
def ret_rebuilt_index(s, d):
    """The postings of every fact that isn't empty, kept and read again."""
    return retrieval.index(s, d)[0].agg(F.countDistinct("id").alias("documents"), F.sum("tf").alias("tokens"))


_CHUNKS = """cq AS (SELECT list_transform(range(0, 32), lambda i: CAST(('0x' || sha256('the of thing tion and')[2 * i + 1:2 * i + 2]) AS INT) / 255.0) AS u),
ch AS (SELECT doc_id AS id, text, unnest(range(0, greatest(length(text) - 100, 1), 400)) AS start FROM documents WHERE text <> ''), cs AS (SELECT id, start, sha256(substring(text, CAST(start AS INT) + 1, 500)) AS h FROM ch),
cv AS (SELECT id, start, round(list_cosine_similarity(list_transform(range(0, 32), lambda i: CAST(('0x' || h[2 * i + 1:2 * i + 2]) AS INT) / 255.0), u), 9) AS score FROM cs, cq)"""


@query(f"""WITH {_BM25}, {_COS}, {_CHUNKS}, b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT * FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 20)),
c AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT id, score FROM vs ORDER BY score DESC, id LIMIT 20)),
fu AS (SELECT id, round(sum(1.0 / (60 + r)), 9) AS score FROM (SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY id ORDER BY score DESC, id LIMIT 10)
SELECT 'fact' AS kind, fu.id, CAST(x.start AS INT) AS start, fu.score FROM fu LEFT JOIN (SELECT id, arg_max(start, (score, -start)) AS start FROM cv GROUP BY id) x USING (id)
UNION ALL SELECT 'chunk', id, CAST(start AS INT), score FROM (SELECT * FROM cv ORDER BY score DESC, id, start LIMIT 5)""")
def ret_hybrid_chunks(s, d):
    """The fused list with the place of each fact's best chunk, and the five best chunks of all beside it."""
    lanes = [retrieval.ranked(*retrieval.index(s, d), TERMS, 20), retrieval.vector_top(_vectors(s, d), _query_vector(s, d), 20)]
    fused = retrieval.fuse(lanes, 10).select("id", F.round("rrf", 9).alias("score"))
    return retrieval.with_chunks(fused, retrieval.nearest_chunks(retrieval.chunk_index(s, d), " ".join(TERMS)))


_CHANGED = TOKENS.replace("tok AS", "tok_all AS").replace("SELECT doc_id AS id", "SELECT id").replace("FROM documents)", "FROM (SELECT doc_id AS id, text FROM documents WHERE doc_id % 10 <> 7 UNION ALL SELECT -1 - 1000 * conv_id - turn, text FROM conversations WHERE role = 'user'))") + ", tok AS (SELECT id, coalesce(t, []) AS t FROM tok_all)"


def _changed_index(s, d):
    """The documents' index, forked: a tenth of the facts goes, what users say in conversations comes. The other facts' texts aren't read."""
    index = segments.of_documents(s, d).fork(f"{store.folder(s)}/noema-fork-{uuid.uuid4().hex}")
    index.remove(read(s, d, "documents").where("doc_id % 10 = 7").select(F.col("doc_id").alias("id")))
    index.add(read(s, d, "conversations").where("role = 'user'").select((-1 - 1000 * F.col("conv_id") - F.col("turn")).alias("id"), "text"))
    return index


@query(f"WITH {_BM25.replace(TOKENS, _CHANGED)} SELECT id, round(score, 6) AS score, total AS total_docs, round(avgdl, 6) AS avg_len FROM bm, st WHERE score > 0 ORDER BY score DESC, id LIMIT 10")
def ret_changed_index(s, d):
    index = _changed_index(s, d)
    n, mean = index.totals()
    return index.search(TERMS, 10).select("id", _r("score").alias("score"), F.lit(n).cast("long").alias("total_docs"), _r(F.lit(mean)).alias("avg_len"))


@query(f"WITH {_CHANGED} SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS n FROM (SELECT id, term, count(*) AS n FROM (SELECT id, unnest(t) AS term FROM tok) GROUP BY ALL) GROUP BY term")
def ret_changed_terms(s, d):
    return _changed_index(s, d).postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


# duplicates and entities

@query(f"WITH {VECTORS}, h AS (SELECT doc_id AS id, doc_id > min(doc_id) OVER (PARTITION BY text) AS known FROM documents), m AS (SELECT a.id, max(list_cosine_similarity(a.v, b.v)) AS sim FROM vec a JOIN vec b ON a.id % 20 = 0 AND a.id <> b.id GROUP BY a.id HAVING max(list_cosine_similarity(a.v, b.v)) >= 0.3), x AS (SELECT h.id, known, round(coalesce(sim, 0), 4) AS sim FROM h LEFT JOIN m USING (id) WHERE h.id % 20 = 0) SELECT id, CASE WHEN known OR sim >= 0.45 THEN 'skip' WHEN sim >= 0.35 THEN 'warn' ELSE 'proceed' END AS strict, CASE WHEN known THEN 'skip' WHEN sim >= 0.35 THEN 'warn' ELSE 'proceed' END AS loose, CASE WHEN known OR sim >= 0.35 THEN 'warn' ELSE 'proceed' END AS manual FROM x")
def dup_action(s, d):
    """By real hashes and real similarities, with thresholds at which these vectors differ."""
    t = _texts(s, d).select("id", F.sha2("text", 256).alias("hash"))
    known = t.join(t.groupBy("hash").agg(F.min("id").alias("first")), "hash").where("id % 20 = 0").select("id", (F.col("id") > F.col("first")).alias("known"))
    v = _vectors(s, d)
    sim = dedup.similar_pairs(v.where("id % 20 = 0"), v, 0.3).groupBy(F.col("a").alias("id")).agg(F.max("sim").alias("sim"))
    x = known.join(sim, "id", "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    return x.select("id", *[dedup.decide(F.col("known"), F.col("sim"), m, 0.45, 0.35).alias(m) for m in ("strict", "loose", "manual")])


@query("WITH r AS (SELECT sha256(text) AS hash, count(*) AS version FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), n AS (SELECT sha256(text) AS hash, count(*) AS new FROM documents WHERE doc_id % 2 = 1 GROUP BY 1) SELECT coalesce(r.hash, n.hash) AS hash, coalesce(version, 0) + coalesce(new, 0) AS version FROM r FULL JOIN n ON r.hash = n.hash")
def dup_registry_bump(s, d):
    """Files that arrive against a registry of those before: known ones go up a version, others begin at 1."""
    t = _texts(s, d).select("id", F.sha2("text", 256).alias("hash"))
    registry = t.where("id % 2 = 0").groupBy("hash").agg(F.count("*").alias("version"))
    return dedup.bumped(registry, t.where("id % 2 = 1"))


@query(r"""WITH e AS (SELECT concat('n', n_nationkey) AS s, 'part of' AS rel, concat('r', n_regionkey) AS o, n_nationkey AS k FROM nation),
c AS (SELECT k, concat(s, rel, o) AS fact, list_distinct(string_split(regexp_replace(lower(concat(s, rel, o)), '[，,。；;：:\s]+', '', 'g'), '')) AS t, length(regexp_replace(lower(concat(s, rel, o)), '[，,。；;：:\s]+', '', 'g')) AS n FROM e),
f AS (SELECT s_suppkey AS id, regexp_replace(lower(concat('n', s_nationkey, ' part  of, r', s_suppkey % 5, CASE WHEN s_suppkey % 3 = 0 THEN ' and more' ELSE '' END)), '[，,。；;：:\s]+', '', 'g') AS fact FROM supplier),
p AS (SELECT id, c.k, len(list_intersect(list_distinct(string_split(f.fact, '')), c.t)) / greatest(length(f.fact), c.n) AS score FROM f, c),
b AS (SELECT id, arg_max(k, (round(score, 9), -k)) AS k, max(round(score, 9)) AS score FROM p WHERE score > 0.6 GROUP BY id) SELECT id, k AS merged_with, round(score, 6)::DOUBLE AS score, score >= 0.85 AS merged FROM b""")
def dup_semantic_triples(s, d):
    n = read(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("n"), "n_nationkey", F.lit("part of"), F.lit("r"), "n_regionkey").alias("triple"))
    said = F.concat(F.lit("n"), "s_nationkey", F.lit(" part  of, r"), F.col("s_suppkey") % 5, F.when(F.col("s_suppkey") % 3 == 0, " and more").otherwise(""))
    facts = read(s, d, "supplier").select(F.col("s_suppkey").alias("id"), said.alias("fact"))
    return dedup.nearest_triple(facts, n).select("id", F.col("k").alias("merged_with"), _r("score").alias("score"), "merged")


_NAMES = "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN upper(n_name) WHEN 1 THEN lower(n_name) WHEN 2 THEN concat('alias_', n_nationkey) ELSE substring(n_name, 1, 4) END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query(f"""WITH e AS (SELECT n_name AS name, n_name AS canonical, [concat('alias_', n_nationkey), concat('No_', n_nationkey)] AS aliases FROM nation), q AS ({_NAMES}),
m AS (SELECT q.id, min(canonical) FILTER (lower(canonical) = lower(q.name) OR list_contains(list_transform(aliases, lambda x: lower(x)), lower(q.name))) AS canonical, count(*) AS candidates FROM q JOIN e ON contains(lower(e.name), substring(lower(q.name), 1, 30)) OR list_contains(aliases, substring(lower(q.name), 1, 30)) GROUP BY q.id)
SELECT q.id, CASE WHEN m.canonical IS NOT NULL AND m.canonical <> q.name THEN 'merged' WHEN m.id IS NULL THEN 'unique' ELSE 'similar_found' END AS status, CASE WHEN m.canonical <> q.name THEN m.canonical END AS canonical FROM q LEFT JOIN m USING (id)""")
def dup_entity_aliases(s, d):
    n = read(s, d, "nation")
    known = n.select(F.col("n_name").alias("name"), F.col("n_name").alias("canonical"), F.array(F.concat(F.lit("alias_"), "n_nationkey"), F.concat(F.lit("No_"), "n_nationkey")).alias("aliases"))
    k = F.col("c_custkey") % 4
    said = F.when(k == 0, F.upper("n_name")).when(k == 1, F.lower("n_name")).when(k == 2, F.concat(F.lit("alias_"), "n_nationkey")).otherwise(F.substring("n_name", 1, 4))
    names = read(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), said.alias("name"))
    return dedup.normalised(names, known).select("id", "status", "canonical")


@query("""WITH t AS (SELECT conv_id, turn, list_distinct(string_split(text, '')) AS c FROM conversations), p AS (SELECT a.conv_id, len(list_intersect(a.c, b.c)) / len(list_distinct(list_concat(a.c, b.c))) > 0.3 AS same FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn), g AS (SELECT conv_id, avg(same::INT) AS x FROM p GROUP BY 1) SELECT conv_id, round(coalesce(x, 0.5), 6) AS consistency FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN g USING (conv_id)""")
def agg_sample_consistency(s, d):
    return dedup.sample_consistency(read(s, d, "conversations").select(F.col("conv_id").alias("of"), "turn", F.col("text").alias("fact"))).select(F.col("of").alias("conv_id"), _r("consistency").alias("consistency"))


# health and statistics

@query(f"WITH {EDGES}, n AS (SELECT DISTINCT src AS node FROM both_ways) SELECT CASE node[1] WHEN 'n' THEN 'nation' WHEN 'r' THEN 'region' WHEN 'c' THEN 'customer' WHEN 's' THEN 'supplier' WHEN 'm' THEN 'segment' ELSE 'priority' END AS type, count(*) AS nodes, (SELECT count(*) FROM edges) AS edges FROM n GROUP BY 1")
def agg_graph_stats(s, d):
    a = adjacency(s, d)
    kind = F.substring("node", 1, 1)
    names = {"n": "nation", "r": "region", "c": "customer", "s": "supplier", "m": "segment", "p": "priority"}
    type_ = reduce(lambda out, kv: F.when(kind == kv[0], kv[1]).otherwise(out), names.items(), F.lit("other"))
    nodes = a.select(F.col("src").alias("node")).distinct().groupBy(type_.alias("type")).agg(F.count("*").alias("nodes"))
    return nodes.join(F.broadcast(a.where("forward").agg(F.count("*").alias("edges"))))


@query(f"""WITH {KP}, {EDGES}, x AS (SELECT kp.*, EXISTS (SELECT 1 FROM both_ways b WHERE b.src = concat('c', kp.id)) AS known FROM kp), c AS (SELECT category, count(*) AS n FROM kp GROUP BY 1),
s AS (SELECT substring(source, 1, 50) AS source, count(*) AS n FROM kp GROUP BY 1 ORDER BY n DESC, source LIMIT 5)
SELECT count(*) AS total, count(*) FILTER (confidence < 0.4) AS low, count(*) FILTER (confidence >= 0.4 AND confidence < 0.7) AS medium, count(*) FILTER (confidence >= 0.7) AS high, round(avg(known::INT), 6) AS entity_coverage, (SELECT count(*) FROM c WHERE n <= 2) AS sparse, (SELECT string_agg(source, ',' ORDER BY n DESC, source) FROM s) AS top_sources, avg(known::INT) < 0.5 AS suggest_entities, count(*) FILTER (confidence < 0.4) > 0.3 * count(*) AS suggest_review FROM x""")
def agg_health_report(s, d):
    k = knowledge(s, d).select("id", "category", "source", "confidence")
    known = adjacency(s, d).select(F.col("src").alias("node")).where("node like 'c%'").distinct().withColumn("known", F.lit(1))
    c = F.col("confidence")
    low = F.count_if(c < 0.4)
    cover = F.avg(F.coalesce("known", F.lit(0)))
    one = k.withColumn("node", F.concat(F.lit("c"), "id")).join(known, "node", "left").agg(F.count("*").alias("total"), low.alias("low"), F.count_if((c >= 0.4) & (c < 0.7)).alias("medium"), F.count_if(c >= 0.7).alias("high"), _r(cover).alias("entity_coverage"), (cover < 0.5).alias("suggest_entities"), (low > 0.3 * F.count("*")).alias("suggest_review"))
    sparse = k.groupBy("category").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") <= 2).alias("sparse"))
    top = k.groupBy(F.substring("source", 1, 50).alias("source")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)
    named = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "source"))), lambda x: x["source"]), ",").alias("top_sources"))
    return one.join(F.broadcast(sparse)).join(F.broadcast(named))


@query(f"WITH {KP}, {EDGES}, g AS (SELECT src AS node, avg(conf) / (1 + exp(-0.5 * (count(*) - 3))) AS c FROM both_ways GROUP BY src), e AS (SELECT id, unnest([concat('c', id), concat('s', id), concat('n', id % 30)]) AS node FROM kp) SELECT id, round(coalesce(avg(c), 0.5), 6) AS consistency FROM e LEFT JOIN g USING (node) GROUP BY id")
def cnf_fact_consistency(s, d):
    """The mean over a fact's entities that the graph has; 0.5 without any."""
    node = F.explode(F.array(F.concat(F.lit("c"), "id"), F.concat(F.lit("s"), "id"), F.concat(F.lit("n"), F.col("id") % 30)))
    return graph.fact_consistency(knowledge(s, d).select("id", node.alias("node")), adjacency(s, d)).select("id", _r("consistency").alias("consistency"))


@query(f"WITH {EDGES} SELECT src, dst, conf, 'fact' AS branch FROM edges WHERE rel = 'CONFLICTS_WITH' AND contains(concat(src, ' ', dst), 'n1 ') UNION ALL SELECT src, dst, conf, 'entity' FROM edges WHERE rel = 'CONFLICTS_WITH' AND (src = 'n1' OR dst = 'n1') UNION ALL SELECT src, dst, conf, 'all' FROM edges WHERE rel = 'CONFLICTS_WITH'")
def gra_conflict_branches(s, d):
    c = edges(s, d).where("rel = 'CONFLICTS_WITH'").select("src", "dst", "conf")
    of = lambda rows, name: rows.withColumn("branch", F.lit(name))
    fact = c.where(F.concat_ws(" ", "src", "dst").contains("n1 "))
    return of(fact, "fact").unionByName(of(c.where("src = 'n1' or dst = 'n1'"), "entity")).unionByName(of(c, "all"))


@query(f"WITH {EDGES}, l AS (SELECT * FROM edges WHERE NOT list_contains(string_split(concat(src, ',', dst), ','), 'n5')), n AS (SELECT DISTINCT src AS node FROM both_ways WHERE src <> 'n5') SELECT (SELECT count(*) FROM l) AS edges, count(*) FILTER (node NOT IN (SELECT src FROM l UNION SELECT dst FROM l)) AS orphans, count(*) FILTER (node IN (SELECT src FROM l UNION SELECT dst FROM l)) AS nodes FROM n")
def gra_delete_with_orphans(s, d):
    """A source's edges go, then the nodes that nothing holds any more."""
    left = edges(s, d).where(~F.array_contains(F.split(F.concat_ws(",", "src", "dst"), ","), "n5"))
    held = graph.both_ways(left).select(F.col("src").alias("node")).distinct().withColumn("held", F.lit(True))
    nodes = adjacency(s, d).where("src <> 'n5'").select(F.col("src").alias("node")).distinct().join(held, "node", "left")
    return nodes.agg(F.count_if(F.col("held").isNull()).alias("orphans"), F.count("held").alias("nodes")).join(F.broadcast(left.agg(F.count("*").alias("edges"))))


# categories: triggers and what they do

@query(f"""WITH {VECTORS}, f AS (SELECT label, unnest(v) AS x, unnest(range(1, 65)) AS i FROM vec), m AS (SELECT label, i, avg(x) AS m FROM f GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label)
SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.c, b.c), 6) AS sim FROM c a JOIN c b ON a.label < b.label WHERE list_cosine_similarity(a.c, b.c) >= 0.0 AND (a.label * 3 >= 10 OR b.label * 3 >= 10)""")
def ctg_merge_triggers(s, d):
    c = categories.centroids(_vectors(s, d), "label").withColumn("idle_days", F.col("label") * 3)
    return categories.merge_triggers(c, 0.0, 10).select("a", "b", _r("sim").alias("sim"))


_GROUPED = "gv AS (SELECT doc_id AS id, doc_id // 5 % 4 AS grp, doc_id % 3 AS of, [(doc_id // 5 % 4 = 0)::DOUBLE, (doc_id // 5 % 4 = 1)::DOUBLE, (doc_id // 5 % 4 = 2)::DOUBLE, (doc_id // 5 % 4 = 3)::DOUBLE, doc_id % 11 * 0.001] AS v FROM documents)"


def _clustered(s, d, which=None) -> DataFrame:
    """id, v, cluster of the documents' vectors in groups, the clusters found by density among those asked for."""
    from noema.operators import density
    from noema.plans.deepened import near_group

    points = near_group(s, d).select("id", "v")
    points = points if which is None else points.where(which)
    return points.join(density.clusters(points), "id")


@query(f"""WITH {_GROUPED}, p AS (SELECT a.of, avg(list_cosine_similarity(a.v, b.v)) AS m FROM gv a JOIN gv b ON a.of = b.of AND a.id < b.id GROUP BY a.of), k AS (SELECT of, grp, count(*) AS n FROM gv GROUP BY ALL)
SELECT of AS grp, CAST(sum(n) AS BIGINT) AS members, count(*) FILTER (n >= 8) AS clusters, round(1 - any_value(m), 6) AS diversity FROM k JOIN p USING (of) GROUP BY of HAVING sum(n) >= 60 AND count(*) FILTER (n >= 8) >= 2 AND 1 - any_value(m) >= 0.35""")
def ctg_split_triggers(s, d):
    v = _clustered(s, d).withColumn("grp", F.col("id") % 3)
    return categories.split_triggers(v, "grp", "cluster", 60, 8, 0.35).select("grp", "members", "clusters", _r("diversity").alias("diversity"))


@query(f"""WITH {KP}, {TOKENS}, u AS (SELECT id, id // 5 % 4 AS g FROM kp WHERE category = 'pending'), z AS (SELECT g, CAST(row_number() OVER (ORDER BY min(id)) AS INT) - 1 AS label FROM u GROUP BY g), c AS (SELECT label, count(*) AS n FROM u JOIN z USING (g) GROUP BY 1 HAVING count(*) >= 3),
w AS (SELECT label, word, count(*) AS k FROM (SELECT label, unnest(list_filter(t, lambda x: length(x) >= 2 AND x NOT IN ('the','and','of','to'))) AS word FROM u JOIN z USING (g) JOIN tok USING (id)) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k DESC, word) AS r FROM w)
SELECT c.label, n, (SELECT string_agg(word, ' · ' ORDER BY r) FROM r WHERE r.label = c.label AND r <= 3) AS name FROM c WHERE (SELECT count(*) FROM u) >= 15""")
def ctg_new_categories(s, d):
    """Facts of no category yet, in the clusters that their vectors form, named by their three commonest words."""
    k = knowledge(s, d).where("category = 'pending'").select("id", "fact")
    u = k.join(_clustered(s, d, "id % 5 = 4").where("cluster >= 0").select("id", "cluster"), "id")
    return categories.new_categories(u.select("cluster", text.words(F.col("fact"), STOP).alias("words")), 15, 3).select(F.col("cluster").alias("label"), "n", "name")


@query("""WITH c AS (SELECT DISTINCT label AS id FROM embeddings), m AS (SELECT vec_id, label FROM embeddings)
SELECT CAST(id AS VARCHAR) AS id, NULL AS parent, id = 3 OR id IN (1, 2) AS is_archived, (SELECT count(*) FROM m WHERE label = id AND id NOT IN (0, 1, 2)) AS members FROM c
UNION ALL SELECT concat('0-', x), '0', FALSE, (SELECT count(*) FROM m WHERE label = 0 AND vec_id % 2 = x) FROM (VALUES (0), (1)) t(x)
UNION ALL SELECT '1+2', NULL, FALSE, (SELECT count(*) FROM m WHERE label IN (1, 2))""")
def ctg_evolved(s, d):
    """A split, a merge and an archiving carried out: new rows, members moved, old ones marked."""
    members = read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("category"))
    made = members.select("category").distinct().select(F.col("category").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(False).alias("is_archived"))
    made, members = categories.split(made, members, "0", F.concat(F.lit("0-"), F.col("id") % 2))
    made, members = categories.merge(made, members, ["1", "2"], "1+2")
    made = categories.archive(made, ["3"])
    n = members.groupBy(F.col("category").alias("id")).agg(F.count("*").alias("members"))
    return made.join(n, "id", "left").select("id", "parent", "is_archived", F.coalesce("members", F.lit(0)).cast("long").alias("members"))


@query(f"""WITH {KP}, g AS (SELECT CASE WHEN category IN ('method', 'fact', 'concept') THEN category END AS grp, id FROM kp), k AS (SELECT grp, count(*) AS n FROM g WHERE grp IS NOT NULL GROUP BY 1 HAVING count(*) >= 3), u AS (SELECT id, id // 5 % 4 AS c FROM g WHERE grp IS NULL OR grp NOT IN (SELECT grp FROM k)), z AS (SELECT c, CAST(row_number() OVER (ORDER BY min(id)) AS INT) - 1 AS label FROM u GROUP BY c),
{_GROUPED}, m AS (SELECT grp AS spot, [avg(v[1]), avg(v[2]), avg(v[3]), avg(v[4]), avg(v[5])] AS m FROM gv WHERE of = 0 GROUP BY grp UNION ALL SELECT 9, [avg(v[1]), avg(v[2]), avg(v[3]), avg(v[4]), avg(v[5])] FROM gv WHERE of = 0 AND grp = 0 AND id % 2 = 0),
s AS (SELECT id, spot, list_cosine_similarity(v, m) AS sim FROM gv, m), x AS (SELECT *, max(sim) OVER (PARTITION BY id) AS best FROM s), y AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM x WHERE best - sim < 0.1)
SELECT 'structural' AS stage, grp AS name, n FROM k UNION ALL SELECT 'semantic', CAST(label AS VARCHAR), count(*) FROM u JOIN z USING (c) GROUP BY label HAVING count(*) >= 5 UNION ALL SELECT 'boundary', CAST(spot AS VARCHAR), count(*) FROM y WHERE n > 1 GROUP BY spot""")
def ctg_hybrid(s, d):
    """Groups by category first; what is in none of them, by the clusters that its vectors form; last, the points between categories' centres, by category."""
    from noema.plans.deepened import near_group

    kind = F.when(F.col("category").isin("method", "fact", "concept"), F.col("category"))
    clusters = _clustered(s, d, "id % 5 > 2").where("cluster >= 0").select("id", F.col("cluster").cast("string").alias("cluster"))
    found = categories.hybrid(knowledge(s, d).select("id", kind.alias("grp")), clusters, 3, 5)
    points = near_group(s, d).withColumn("of", F.col("id") % 3)
    # a category's centre is the mean of some of its members; number 9 has half of those of number 0
    centres = points.where("of = 0").unionByName(points.where("of = 0 and grp = 0 and id % 2 = 0").withColumn("grp", F.lit(9).cast("long")))
    between = categories.near_best(points.select("id", "v"), categories.centroids(centres, "grp").withColumnRenamed("grp", "label"), 0.1)
    return found.unionByName(between.groupBy("label").agg(F.count("*").alias("n")).select(F.lit("boundary").alias("stage"), F.col("label").cast("string").alias("name"), "n"))


@query("""WITH RECURSIVE c AS (SELECT concat('r', r_regionkey) AS id, CAST(NULL AS VARCHAR) AS parent, r_name AS name FROM region UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), n_name FROM nation UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), s_name FROM supplier),
k(id) AS (SELECT id FROM c WHERE contains(lower(name), '4') UNION SELECT c.parent FROM k JOIN c USING (id) WHERE c.parent IS NOT NULL) SELECT DISTINCT id FROM k""")
def ctg_focused_tree(s, d):
    """Suppliers whose name has a 4, with the nations and regions above them."""
    r = read(s, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = read(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    p = read(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.col("s_name").alias("name"))
    return categories.focused(r.unionByName(n).unionByName(p), F.lower("name").contains("4"))


# mutations

@query(f"WITH {KP} SELECT id, fact, category FROM kp WHERE id = 7")
def mut_get(s, d):
    return knowledge(s, d).where("id = 7").select("id", "fact", "category")


@query(f"WITH {EDGES} SELECT count(*) AS removed, CAST(0 AS BIGINT) AS left_over FROM edges")
def mut_clear_graph(s, d):
    """A stored graph emptied: what went, and what a reader finds afterwards."""
    table = store.Table(s, f"{store.folder(s)}/noema-graph-{uuid.uuid4().hex}", ["src", "dst", "rel"], "src string, dst string, rel string, conf double")
    table.save(edges(s, d))
    removed = table.clear()
    return table.load().agg(F.lit(removed).cast("long").alias("removed"), F.count("*").alias("left_over"))


_CATS = "cats AS (SELECT concat('r', r_regionkey) AS id, CAST(NULL AS VARCHAR) AS parent, r_name AS name FROM region UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), n_name FROM nation)"


def _cats(s, d) -> DataFrame:
    r = read(s, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    return r.unionByName(read(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name")))


@query(f"WITH {_CATS}, new AS (SELECT * FROM (VALUES ('x1', 'r1', 'Under one'), ('x2', 'gone', 'Under none')) t(id, parent, name)) SELECT id, name, (SELECT c.id FROM cats c WHERE c.id = a.parent) AS child_of FROM (SELECT * FROM cats UNION ALL SELECT * FROM new) a")
def mut_create_categories(s, d):
    """New categories, and an edge to the parent where it is known."""
    new = s.createDataFrame([("x1", "r1", "Under one"), ("x2", "gone", "Under none")], "id string, parent string, name string")
    known = _cats(s, d).select(F.col("id").alias("child_of"))
    return _cats(s, d).unionByName(new).join(small(known), F.col("parent") == F.col("child_of"), "left").select("id", "name", "child_of")


@query(f"WITH {_CATS} SELECT id, parent, CASE WHEN id = 'n3' THEN 'New name' ELSE name END AS name FROM cats")
def mut_update_category(s, d):
    return categories.updated(_cats(s, d), "n3", {"name": "New name", "no_such_column": 1})


@query(f"WITH {_CATS}, a AS (SELECT c_custkey AS kid, concat('n', c_nationkey) AS cat FROM customer) SELECT (SELECT count(*) FROM cats WHERE id <> 'n3') AS categories, (SELECT count(*) FROM cats WHERE id <> 'n3' AND parent IS NOT NULL) AS relations, (SELECT count(*) FROM a WHERE cat <> 'n3') AS assignments")
def mut_delete_category_everywhere(s, d):
    gone = s.createDataFrame([("n3",)], "id string")
    cats = _cats(s, d)
    relations = cats.where("parent is not null").select("id", "parent")
    held = read(s, d, "customer").select("c_custkey", F.concat(F.lit("n"), "c_nationkey").alias("id"))
    n = [df.join(F.broadcast(gone), "id", "left_anti").agg(F.count("*").alias(name)) for df, name in ((cats, "categories"), (relations, "relations"), (held, "assignments"))]
    return n[0].join(F.broadcast(n[1])).join(F.broadcast(n[2]))


@query("WITH b AS (SELECT doc_id, 'good' AS tag FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1), n AS (SELECT * FROM b UNION SELECT doc_id, 'fresh' FROM labels WHERE doc_id % 10 = 0) SELECT doc_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM n WHERE NOT (tag = 'good' AND doc_id % 7 = 0) AND tag <> 'toxic' GROUP BY doc_id")
def mut_tags(s, d):
    """Tags assigned (twice is once), one taken from some, one deleted with its assignments; then each document's tags."""
    given = F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")))
    bridge = read(s, d, "labels").select("doc_id", F.explode(given).alias("tag"))
    bridge = bridge.unionByName(read(s, d, "labels").where("doc_id % 10 = 0").select("doc_id", F.lit("fresh").alias("tag"))).distinct()
    removed = bridge.where("tag = 'good' and doc_id % 7 = 0")
    left = bridge.join(removed, ["doc_id", "tag"], "left_anti").where("tag <> 'toxic'")
    return left.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 4 THEN upper(c_name) ELSE c_name END AS name FROM customer WHERE (c_nationkey = 7 OR c_mktsegment = 'BUILDING') AND NOT (c_custkey % 10 = 3 AND c_mktsegment <> 'BUILDING') UNION ALL SELECT -1 - s_suppkey, s_name FROM supplier WHERE s_nationkey = 7")
def mut_collections(s, d):
    """A user's own collections and the system's, after some were made, renamed and deleted; the system's can't be deleted."""
    system = F.col("c_mktsegment") == "BUILDING"
    old = read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(~system, F.col("c_nationkey")).alias("user_id"), system.alias("is_system"), (F.col("c_nationkey") == 7).alias("by"))
    made = read(s, d, "supplier").select((-1 - F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("user_id"), F.lit(False).alias("is_system"), F.lit(True).alias("by"))
    table = store.Table(s, f"{store.folder(s)}/noema-collections-{uuid.uuid4().hex}", ["id"], "id long, name string, user_id int, is_system boolean, by boolean")
    table.save(old)
    table.upsert(made.unionByName(old.where("id % 10 = 4").withColumn("name", F.upper("name"))))
    left = table.delete(old.where("id % 10 = 3 and not is_system").select("id"))
    return left.where("user_id = 7 or is_system").select("id", "name")


@query("SELECT c_custkey, concat('n', c_nationkey) AS category FROM customer WHERE NOT (c_custkey = 5 AND concat('n', c_nationkey) = (SELECT concat('n', c_nationkey) FROM customer WHERE c_custkey = 5))")
def mut_remove_assignment(s, d):
    held = read(s, d, "customer").select("c_custkey", F.concat(F.lit("n"), "c_nationkey").alias("category"))
    one = held.where("c_custkey = 5")
    return held.join(F.broadcast(one.limit(1)), ["c_custkey", "category"], "left_anti")


@query(f"WITH {_COS}, h AS (SELECT score, label FROM vs ORDER BY score DESC, id LIMIT 8) SELECT count(*) AS n, round(avg(score), 3) AS avg_score, avg(score) < 0.5 AS below, count(DISTINCT label) AS sources, 0 AS conflicts FROM h")
def mut_answer_metadata(s, d):
    """What an answer carries with it, as one struct."""
    top = retrieval.vector_top(_vectors(s, d), _query_vector(s, d), 8).join(_vectors(s, d).select("id", F.col("label").alias("source")), "id")
    packed = top.agg(F.struct(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("avg_score"), (F.avg("score") < 0.5).alias("below"), F.countDistinct("source").alias("sources"), F.lit(0).alias("conflicts")).alias("metadata"))
    return packed.select("metadata.*")


@query(f"WITH {OPS} SELECT user_id, max(memory_key) AS k, 'dark' AS theme FROM ops GROUP BY user_id")
def mem_profile_set(s, d):
    """A field set in a JSON profile beside those it has."""
    p = memory_ops(s, d).groupBy("user_id").agg(F.max("memory_key").cast("string").alias("k"))
    profile = F.to_json(F.create_map(F.lit("k"), F.col("k")))
    changed = F.to_json(F.map_concat(F.from_json(profile, "map<string,string>"), F.create_map(F.lit("theme"), F.lit("dark"))))
    read_ = F.from_json(changed, "map<string,string>")
    return p.select("user_id", read_["k"].cast("int").alias("k"), read_["theme"].alias("theme"))


@query("SELECT conv_id, count(*) AS n, max(turn) AS last_turn FROM (SELECT conv_id, turn FROM conversations WHERE conv_id % 3 <> 0 UNION ALL SELECT DISTINCT conv_id, 0 FROM conversations WHERE conv_id % 3 = 0) GROUP BY conv_id")
def mem_saved_messages(s, d):
    """Conversations saved again are put in place of what was saved before."""
    old = read(s, d, "conversations").select("conv_id", "turn")
    new = old.where("conv_id % 3 = 0").select("conv_id").distinct().withColumn("turn", F.lit(0).cast("long"))
    both = old.join(new.select("conv_id"), "conv_id", "left_anti").unionByName(new)
    return both.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last_turn"))


@query(f"WITH {KP}, b AS (SELECT * FROM kp WHERE id % 10 = 0), n AS (SELECT id, 0.4 * 0.8 + 0.3 * 0.5 + 0.3 * 0.5 AS base FROM b) SELECT id, 0.1 AS confidence, 'replaced' AS status, id + 1000000 AS revised_to FROM b UNION ALL SELECT id + 1000000, round((base + 0.8) / 2 + 1e-9, 4)::DOUBLE, 'active', NULL FROM n UNION ALL SELECT id, confidence, status, NULL FROM kp WHERE id % 10 <> 0")
def cnf_revisions(s, d):
    """Corrected facts: the old one is kept as replaced with an edge to the new one, whose confidence is worked out anew."""
    k = knowledge(s, d).select("id", "confidence", "status")
    hit, none = F.col("id") % 10 == 0, F.lit(None).cast("long")
    later = F.col("id") + 1000000
    again = scores.combined(F.lit(0.8), F.lit(0.5), F.lit(0.5), F.lit(8.0), F.lit(2.0), F.lit(0))
    old = k.where(hit).select("id", F.lit(0.1).alias("confidence"), F.lit("replaced").alias("status"), later.alias("revised_to"))
    new = k.where(hit).select(later.alias("id"), again.alias("confidence"), F.lit("active").alias("status"), none.alias("revised_to"))
    return k.where(~hit).withColumn("revised_to", none).unionByName(old).unionByName(new)


# lists

_TAGGED = "tg AS (SELECT *, [concat('t', id % 7), concat('t', id % 11)] AS tags FROM kp)"


def _tagged(s, d) -> DataFrame:
    tag = lambda n: F.concat(F.lit("t"), F.col("id") % n)
    return knowledge(s, d).withColumn("tags", F.array(tag(7), tag(11)))


@query(f"WITH {KP}, {_TAGGED} SELECT id FROM tg WHERE (contains(category, 'thod') OR contains(fact, 'thod')) AND confidence >= 0.2 AND len(list_intersect(tags, ['t1', 't5'])) > 0 AND created_on >= DATE '2025-01-01' - 200")
def flt_tags(s, d):
    return _tagged(s, d).where(listing.matches({"tag": "thod", "min": 0.2, "tags": ["t1", "t5"], "days_within": (200, "2025-01-01")})).select("id")


@query(f"WITH {KP} SELECT CASE WHEN confidence <= 0.3 OR category = 'pending' THEN 'unsure' WHEN confidence >= 0.8 THEN 'sure' END AS meta, count(*) AS n FROM kp WHERE confidence <= 0.3 OR category = 'pending' OR confidence >= 0.8 GROUP BY 1")
def flt_meta_membership(s, d):
    meta = F.when((F.col("confidence") <= 0.3) | (F.col("category") == "pending"), "unsure").when(F.col("confidence") >= 0.8, "sure")
    return knowledge(s, d).select(meta.alias("meta")).where("meta is not null").groupBy("meta").agg(F.count("*").alias("n"))


@query(f"WITH {KP}, n AS (SELECT id, created_on FROM kp WHERE created_on < DATE '2024-06-01' OR (created_on = DATE '2024-06-01' AND id < 100) ORDER BY created_on DESC, id DESC LIMIT 5), p AS (SELECT id, created_on FROM kp WHERE created_on > DATE '2024-06-01' OR (created_on = DATE '2024-06-01' AND id > 100) ORDER BY created_on, id LIMIT 5) SELECT 'next' AS page, id FROM n UNION ALL SELECT 'prev', id FROM p")
def top_pages_both_ways(s, d):
    kept, at = by_day(s, d), listing.opened(listing.cursor("2024-06-01", 100))
    of = lambda rows, page: rows.select(F.lit(page).alias("page"), "id")
    unknown = listing.after(knowledge(s, d).select("id", "created_on"), "no cursor", 5)  # an empty page
    return of(kept.after(at, 5), "next").unionByName(of(kept.before(at, 5), "prev")).unionByName(of(unknown, "unknown"))


@query(f"WITH {KP}, r AS (SELECT id, row_number() OVER (ORDER BY CASE WHEN confidence IS NULL OR confidence = 0 THEN 0.5 ELSE confidence END DESC, id) AS r, count(*) OVER () AS n FROM kp) SELECT id, r FROM r WHERE r <= 20 OR (r - 1) // 20 = (n - 1) // 20")
def top_first_and_last_page(s, d):
    """The first and the last page of the kept list, each from the file that holds it."""
    kept = by_confidence(s, d)
    rows = sum(f["rows"] for f in kept.files())
    last = -(-rows // 20)
    numbered = lambda n: kept.page(n, 20).select("id", (F.row_number().over(Window.orderBy(F.desc("at"), "id")) + (n - 1) * 20).cast("long").alias("r"))
    return numbered(1) if last <= 1 else numbered(1).unionByName(numbered(last))


@query(f"WITH {KP} (SELECT 'confidence' AS by, id FROM kp ORDER BY confidence, id LIMIT 5 OFFSET 5) UNION ALL (SELECT 'created_on', id FROM kp ORDER BY created_on DESC, id LIMIT 5) UNION ALL (SELECT 'updated_on', id FROM kp ORDER BY created_on + CAST(id % 30 AS INT) DESC, id LIMIT 5)")
def top_sorted_by(s, d):
    k = knowledge(s, d).select("id", "confidence", "created_on", F.date_add("created_on", (F.col("id") % 30).cast("int")).alias("updated_on"))
    of = lambda by, number, down: listing.page(k, [F.desc(by) if down else F.col(by), F.col("id")], number, 5).select(F.lit(by).alias("by"), "id")
    return of("confidence", 2, False).unionByName(of("created_on", 1, True)).unionByName(of("updated_on", 1, True))


@query(r"""WITH s AS (SELECT doc_id AS id, unnest(regexp_split_to_array(text, '[。！？\n]+')) AS x, unnest(range(len(regexp_split_to_array(text, '[。！？\n]+')))) AS p FROM documents), h AS (SELECT id, p, trim(x, ' ') AS x, contains(lower(x), 'the')::INT + contains(lower(x), 'tion')::INT + contains(lower(x), 'schen')::INT AS hits FROM s), f AS (SELECT *, max(hits) OVER (PARTITION BY id) AS best FROM h WHERE length(x) > 5), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, p) AS r FROM f WHERE hits > 0 OR best = 0) SELECT id, CAST(p AS INT) AS p, x AS sentence FROM r WHERE r <= 3""")
def top_sentences(s, d):
    """Each text's three sentences with the most keywords; the first three where none has any."""
    return retrieval.key_sentences(_texts(s, d), ["the", "tion", "schen"], 3).select("id", "p", "sentence")


# joins

@query("""WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1000000.0 AS t FROM events), b AS (SELECT DISTINCT user_id, t AS b_at FROM e WHERE event_type = 'click'), f AS (SELECT user_id, min(b_at) AS first_at FROM b GROUP BY 1)
SELECT v.user_id, v.event_id AS point, round(coalesce((SELECT max(b_at) FROM b WHERE b.user_id = v.user_id AND b_at <= v.t), first_at), 3) AS bound FROM e v JOIN f USING (user_id) WHERE event_type = 'view'""")
def joi_as_of_all(s, d):
    """Every click is a boundary."""
    from noema.operators import timeline

    e = read(s, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    bounds = e.where("event_type = 'click'").select("user_id", F.col("t").alias("at")).distinct()
    points = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("point"), "t")
    return timeline.as_of(points, bounds, "user_id").where("bound is not null").select("user_id", "point", F.round("bound", 3).alias("bound"))


@query("WITH c AS (SELECT unnest(['table','ring','bolt','widget','gear']) AS label, unnest(range(5)) AS place) SELECT label, arg_min(p_partkey, p_partkey) AS line FROM c JOIN part ON contains(p_name, label) GROUP BY label")
def joi_components(s, d):
    """Each component of a picture with the first line of text that names it."""
    c = s.createDataFrame([(x,) for x in ("table", "ring", "bolt", "widget", "gear")], "label string")
    lines = read(s, d, "part").select("p_partkey", "p_name")
    return lines.join(F.broadcast(c), F.col("p_name").contains(F.col("label"))).groupBy("label").agg(F.min("p_partkey").alias("line"))


@query("WITH a AS (SELECT n_name AS name, unnest([lower(n_name), concat('alias_', n_nationkey)]) AS alias FROM nation), q AS (SELECT unnest(['an', 'alias_3', 'zz']) AS q), h AS (SELECT DISTINCT q, name FROM q JOIN a ON contains(alias, q) OR alias = q), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY name) AS r FROM h) SELECT q, name FROM r WHERE r <= 20")
def joi_aliases(s, d):
    asked = s.createDataFrame([("an",), ("alias_3",), ("zz",)], "q string")
    a = read(s, d, "nation").select(F.col("n_name").alias("name"), F.explode(F.array(F.lower("n_name"), F.concat(F.lit("alias_"), "n_nationkey"))).alias("alias"))
    hits = a.join(F.broadcast(asked), F.col("alias").contains(F.col("q"))).select("q", "name").distinct()
    return hits.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("name"))).where("r <= 20").select("q", "name")


# streams with state

_FADING = f"""{OPS}, o AS (SELECT user_id, memory_type, memory_key, value, ts, event_id, lag(ts) OVER (PARTITION BY user_id, memory_type, memory_key ORDER BY ts, event_id) AS before FROM ops),
g AS (SELECT *, CAST(greatest(0, date_diff('day', CAST(before + INTERVAL 2 DAY AS DATE), CAST(ts AS DATE))) AS DOUBLE) AS nights FROM o)"""


@query(f"""WITH {_FADING}, f AS (SELECT user_id, memory_type, memory_key, arg_max(value, (ts, event_id)) AS value, max(ts) AS last, list_prepend(1.0::DOUBLE, list(nights ORDER BY ts, event_id) FILTER (before IS NOT NULL)) AS n FROM g GROUP BY ALL)
SELECT user_id, memory_type, memory_key, value, round(list_reduce(coalesce(n, [1.0::DOUBLE]), lambda w, x: least(2.0, w * pow(0.95, x) + 0.1)) * pow(0.95, greatest(0, date_diff('day', CAST(last + INTERVAL 2 DAY AS DATE), CAST((SELECT max(ts) FROM events) AS DATE)))), 6) AS weight FROM f""")
def mem_fading_stream(s, d):
    """Writes as a stream in four batches, by day; items fade after two days without one, each midnight that the watermark passes."""
    root = f"{store.folder(s)}/noema-stream-{uuid.uuid4().hex}"
    ops = memory_ops(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    cut = ops.select(F.unix_seconds("ts").alias("t")).agg(*[F.percentile_approx("t", q) for q in (0.25, 0.5, 0.75)]).first()
    part = sum([(F.unix_seconds("ts") > c).cast("int") for c in cut], F.lit(0))
    table = store.Table(s, f"{root}/items", memory.KEY, memory_state.SCHEMA)
    for k in range(4):
        # a batch is what has come since the last one, in as many files as there are tasks
        ops.where(part == k).write.mode("append").parquet(f"{root}/ops")
        given = s.readStream.schema(ops.schema).parquet(f"{root}/ops")
        left = memory_state.run(s, given, table, f"{root}/checkpoint", 2)
    return left.select(*memory.KEY, "value", _r("weight").alias("weight"))


@query("WITH h AS (SELECT sha256(text) AS hash, count(*) AS version, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1), v AS (SELECT hash, list_transform(range(0, 32), lambda i: CAST(('0x' || hash[2 * i + 1:2 * i + 2]) AS INT) / 255.0) AS v FROM h) SELECT hash, version, first_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first FROM h JOIN v USING (hash)")
def dup_registry_stream(s, d):
    """Documents arrive in three batches, one of which comes twice; versions count arrivals once, vectors are kept."""
    root = f"{store.folder(s)}/noema-registry-{uuid.uuid4().hex}"
    docs = _texts(s, d)
    held = registry.table(s, f"{root}/registry")
    put = registry.sink(held)

    def twice(batch, n):
        put(batch, n)
        if n == 1:  # as after a failure between the merge and the stream's commit
            put(batch, n)

    for k in range(3):
        # a batch is what has come since the last one, in as many files as there are tasks
        docs.where(F.pmod("id", F.lit(3)) == k).write.mode("append").parquet(f"{root}/docs")
        given = s.readStream.schema(docs.schema).parquet(f"{root}/docs")
        given.writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(twice).trigger(availableNow=True).start().awaitTermination()
    return held.load().select("hash", "version", "first_id", _r(F.col("vector")[0]).alias("first"))
