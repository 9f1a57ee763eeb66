"""Further queries: rule-based labels, media helpers, code graph, mutations, personalisation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from noema.functions import scores, text
from noema.operators import categories, dedup, graph, memory, timeline
from noema.plans.queries import _COS, _query_vector, _r, _texts, _vectors, query
from noema.plans.views import EDGES, KP, OPS
from noema.sources.tables import edges, knowledge, memory_ops, read

# comparisons and similarity

@query(f"""WITH {KP}, t AS MATERIALIZED (SELECT source, confidence, list_distinct(string_split(fact, '')) AS c FROM kp),
p AS (SELECT a.source AS source_a, b.source AS source_b, a.confidence AS ca, b.confidence AS cb, len(list_intersect(a.c, b.c)) / len(list_distinct(list_concat(a.c, b.c))) AS sim FROM t a JOIN t b ON a.source < b.source)
SELECT source_a, source_b, count(*) FILTER (sim > 0.5 AND ca > 0.7 AND cb > 0.7) AS agreeing, count(*) FILTER (sim > 0.15 AND sim <= 0.4 AND abs(ca - cb) > 0.2) AS conflicting FROM p GROUP BY ALL""")
def ctg_source_comparison(s, d):
    return categories.compare_sources(knowledge(s, d).select("source", "confidence", "fact"))


@query(f"WITH {_COS}, hits AS (SELECT id, label, score FROM vs WHERE score > 0.2 ORDER BY 1 - score, id LIMIT 15) SELECT id, round(score, 6) AS similarity FROM hits")
def top_vector_threshold(s, d):
    q = F.broadcast(_query_vector(s, d).select(F.col("v").alias("q")))
    sim = scores.cosine(F.col("v"), F.col("q"))
    return _vectors(s, d).join(q).select("id", sim.alias("x")).where("x > 0.2").orderBy(F.desc("x"), "id").limit(15).select("id", _r("x").alias("similarity"))


@query(f"WITH {KP}, t AS (SELECT category FROM kp WHERE status = 'active' ORDER BY confidence DESC, id LIMIT 5) SELECT category, count(*) AS n FROM t GROUP BY category")
def agg_category_mix(s, d):
    return knowledge(s, d).where("status = 'active'").orderBy(F.desc("confidence"), "id").limit(5).groupBy("category").agg(F.count("*").alias("n"))


@query(f"WITH {KP}, v AS (SELECT id, fact FROM kp UNION ALL SELECT id, fact FROM kp WHERE status = 'active') SELECT id, fact FROM v INTERSECT SELECT id, fact FROM kp WHERE confidence >= 0.5")
def set_operations(s, d):
    k, cols = knowledge(s, d), ("id", "fact")
    return k.select(*cols).unionByName(k.where("status = 'active'").select(*cols)).intersect(k.where("confidence >= 0.5").select(*cols))


@query(f"WITH {KP} SELECT id FROM kp WHERE category = 'fact' EXCEPT SELECT id FROM kp WHERE confidence < 0.5")
def set_except(s, d):
    k = knowledge(s, d)
    return k.where("category = 'fact'").select("id").exceptAll(k.where("confidence < 0.5").select("id"))


# labels by rule

_INTENT = "CASE WHEN contains(t, 'compare') THEN 'compare' WHEN contains(t, 'when') THEN 'timeline' WHEN contains(t, 'of') THEN 'graph' ELSE 'general' END"


@query(f"SELECT conv_id, turn, {_INTENT} AS intent FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'user')")
def fun_intents(s, d):
    rules = [(["compare"], "compare"), (["when"], "timeline"), (["of"], "graph")]
    return read(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", text.first_label(F.lower("text"), rules, "general").alias("intent"))


@query("SELECT page_id, CASE WHEN contains(url, '.pdf') THEN 'document' WHEN starts_with(url, 'http') THEN 'web' ELSE 'other' END AS kind FROM pages")
def ctg_source_type(s, d):
    url = F.col("url")
    return read(s, d, "pages").select("page_id", F.when(url.contains(".pdf"), "document").when(url.startswith("http"), "web").otherwise("other").alias("kind"))


@query("SELECT n_name AS name, CASE WHEN contains(lower(n_name), 'event') THEN 'Event' WHEN contains(lower(n_name), 'concept') THEN 'Concept' ELSE 'Entity' END AS kind FROM nation")
def gra_node_types(s, d):
    return read(s, d, "nation").select(F.col("n_name").alias("name"), graph.node_type(F.col("n_name")).alias("kind"))


@query(f"WITH {EDGES} SELECT DISTINCT rel, CASE WHEN contains(lower(rel), 'cause') THEN 'CAUSES' WHEN contains(lower(rel), 'part') THEN 'PART_OF' WHEN contains(lower(rel), 'conflict') THEN 'CONTRADICTS' ELSE 'RELATED_TO' END AS kind FROM edges")
def gra_relation_types(s, d):
    rules = [(["cause"], "CAUSES"), (["part"], "PART_OF"), (["conflict"], "CONTRADICTS")]
    return edges(s, d).select("rel").distinct().select("rel", text.first_label(F.lower("rel"), rules, "RELATED_TO").alias("kind"))


@query(f"WITH {KP}, h AS (SELECT id, least(0.8, 0.4 + 0.15 * (contains(lower(fact), 'the')::INT + contains(lower(fact), 'tion')::INT + contains(lower(fact), 'schen')::INT)) AS conf FROM kp) SELECT id, round(conf, 6)::DOUBLE AS conf FROM h WHERE conf >= 0.5")
def ctg_keyword_suggestion(s, d):
    hits = text.count_of(F.lower("fact"), ["the", "tion", "schen"])
    return knowledge(s, d).select("id", _r(F.least(F.lit(0.8), 0.4 + 0.15 * hits)).alias("conf")).where("conf >= 0.5")


# confidence

_LIFT = "CASE WHEN id % 4 = 0 THEN greatest(0.9, confidence) WHEN id % 4 = 1 THEN 0.05 ELSE confidence END"


@query(f"WITH {KP} SELECT id, CAST({_LIFT} AS DOUBLE) AS conf, CAST(CASE WHEN id % 4 = 0 THEN 10 WHEN id % 4 = 1 THEN 0.5 ELSE feedback_alpha END AS DOUBLE) AS alpha, CAST(CASE WHEN id % 4 = 0 THEN 1 WHEN id % 4 = 1 THEN 10 ELSE feedback_beta END AS DOUBLE) AS beta FROM kp")
def cnf_confirm_and_error(s, d):
    ok, bad = F.col("id") % 4 == 0, F.col("id") % 4 == 1
    conf = F.when(ok, F.greatest(F.lit(0.9), F.col("confidence"))).when(bad, 0.05).otherwise(F.col("confidence"))
    return knowledge(s, d).select("id", conf.alias("conf"), F.when(ok, 10.0).when(bad, 0.5).otherwise(F.col("feedback_alpha")).alias("alpha"), F.when(ok, 1.0).when(bad, 10.0).otherwise(F.col("feedback_beta")).alias("beta"))


@query(f"WITH {KP}, r AS (SELECT id, confidence AS old, least(greatest(0.6 * confidence + 0.4 * feedback_alpha / (feedback_alpha + feedback_beta), 0.1), 1.0) AS new FROM kp WHERE status = 'active' AND confidence < 0.5) SELECT count(*) AS reviewed, count(*) FILTER (round(new - old, 9) > 0.02) AS improved FROM r")
def cnf_auto_review(s, d):
    new = scores.clip(0.6 * F.col("confidence") + 0.4 * scores.feedback_mean(F.col("feedback_alpha"), F.col("feedback_beta")), 0.1, 1.0)
    k = knowledge(s, d).where("status = 'active' and confidence < 0.5")
    return k.agg(F.count("*").alias("reviewed"), F.count_if(F.round(new - F.col("confidence"), 9) > 0.02).alias("improved"))


@query(f"WITH {EDGES}, g AS (SELECT src, count(*) AS d, avg(conf) AS c FROM both_ways GROUP BY src) SELECT src AS node, round(c / (1 + exp(-0.5 * (d - 3))), 6) AS consistency FROM g")
def cnf_graph_consistency(s, d):
    g = graph.both_ways(edges(s, d)).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"), F.avg("conf").alias("c"))
    return g.select("node", _r(F.col("c") / (1 + F.exp(-0.5 * (F.col("d") - 3)))).alias("consistency"))


@query(f"WITH {KP} SELECT source, round(CAST(least(greatest(0.5 + least(0.15, 0.01 * count(*)) - 0.2 * least(count(*) FILTER (status = 'replaced'), 5) * 0.04, 0.2), 1.0) AS DOUBLE), 6) AS trust FROM kp GROUP BY source")
def cnf_source_trust(s, d):
    fixed = F.least(F.count_if(F.col("status") == "replaced"), F.lit(5))
    return knowledge(s, d).groupBy("source").agg(_r(scores.clip(0.5 + F.least(F.lit(0.15), 0.01 * F.count("*")) - 0.2 * fixed * 0.04, 0.2, 1.0)).alias("trust"))


@query(f"WITH {KP} SELECT id, round(0.216 * confidence + 0.784 * avg(confidence) OVER (PARTITION BY source), 6) AS conf FROM kp")
def cnf_closed_form(s, d):
    k = knowledge(s, d).select("id", "source", "confidence")
    m = k.groupBy(F.col("source").alias("of")).agg(F.avg("confidence").alias("m"))
    return k.join(m, F.col("source").eqNullSafe(F.col("of"))).select("id", _r(0.216 * F.col("confidence") + 0.784 * F.col("m")).alias("conf"))


# graph

@query(f"WITH {EDGES} SELECT n_name, count(src) AS suppliers, coalesce(string_agg(src, ',' ORDER BY src), '') AS some FROM nation LEFT JOIN edges ON dst = concat('n', n_nationkey) AND starts_with(src, 's') GROUP BY n_name")
def joi_optional_match(s, d):
    e = edges(s, d).where("src like 's%'").select("src", "dst")
    n = read(s, d, "nation").select("n_name", F.concat(F.lit("n"), "n_nationkey").alias("node"))
    return n.join(e, n.node == e.dst, "left").groupBy("n_name").agg(F.count("src").alias("suppliers"), F.array_join(F.array_sort(F.collect_list("src")), ",").alias("some"))


@query(f"WITH {EDGES} SELECT src, dst, rel FROM edges WHERE NOT list_contains(string_split(concat(src, ',', dst), ','), 'n5')")
def gra_delete_by_source(s, d):
    return edges(s, d).where(~F.array_contains(F.split(F.concat_ws(",", "src", "dst"), ","), "n5")).select("src", "dst", "rel")


@query(f"WITH {EDGES}, a AS (SELECT src AS atom, dst AS chunk FROM edges WHERE rel = 'BELONGS_TO'), c AS (SELECT src AS chunk, dst AS doc FROM edges WHERE rel = 'PART_OF') SELECT atom, chunk, doc FROM a JOIN c USING (chunk)")
def gra_evidence_chain(s, d):
    e = edges(s, d)
    a = e.where("rel = 'BELONGS_TO'").select(F.col("src").alias("atom"), F.col("dst").alias("chunk"))
    return a.join(e.where("rel = 'PART_OF'").select(F.col("src").alias("chunk"), F.col("dst").alias("doc")), "chunk")


@query("""WITH w AS (SELECT doc_id AS id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents) SELECT id, i AS pos, w[i] AS a, w[i + 1] AS b FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM w)""")
def gra_consecutive_triples(s, d):
    w = F.filter(F.split("text", " "), lambda x: x != "")
    held = _texts(s, d).select("id", w.alias("w")).where("size(w) > 1")
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return held.select("id", F.posexplode(pairs).alias("p", "x")).select("id", (F.col("p") + 1).cast("long").alias("pos"), "x.a", "x.b")


@query("SELECT event_type AS kind, count(DISTINCT user_id) AS users, list_sort(list(DISTINCT user_id))[1:10]::VARCHAR AS some FROM events GROUP BY event_type")
def agg_names_by_kind(s, d):
    """How many there are of a kind and the first ten; no kind's users are gathered whole."""
    named = read(s, d, "events").select(F.col("event_type").alias("kind"), "user_id").distinct()
    first = named.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("user_id"))).where("r <= 10")
    some = first.groupBy("kind").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("user_id")), ", "), F.lit("]")).alias("some"))
    return named.groupBy("kind").agg(F.count("*").alias("users")).join(some, "kind")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), '1') OR p_brand = 'Brand#11' ORDER BY p_partkey LIMIT 20")
def joi_alias_lookup(s, d):
    return read(s, d, "part").where(F.lower("p_name").contains("1") | (F.col("p_brand") == "Brand#11")).select("p_partkey", "p_name").orderBy("p_partkey").limit(20)


# categories and people

@query("SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY visits DESC, event_type) AS INT) AS place FROM (SELECT user_id, event_type, count(*) AS visits, max(ts) AS last_visit FROM events GROUP BY ALL)")
def ctg_personal_order(s, d):
    v = read(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("visits"), F.max("ts").alias("last_visit"))
    return v.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("visits"), "event_type")))


@query(f"WITH {KP}, n AS (SELECT unnest(['A','B','C']) AS name) SELECT DISTINCT id, name FROM kp, n WHERE status = 'active'")
def ctg_bulk_assignment(s, d):
    return knowledge(s, d).where("status = 'active'").select("id", F.explode(F.array(*map(F.lit, "ABC"))).alias("name"))


@query(f"WITH {KP} SELECT CASE category WHEN 'concept' THEN 'theory' WHEN 'method' THEN 'practice' ELSE 'other' END AS grp, count(*) AS n FROM kp GROUP BY 1 HAVING count(*) >= 3")
def ctg_structural(s, d):
    grp = F.when(F.col("category") == "concept", "theory").when(F.col("category") == "method", "practice").otherwise("other")
    return knowledge(s, d).groupBy(grp.alias("grp")).agg(F.count("*").alias("n")).where("n >= 3")


# time

@query("SELECT user_id, event_id, arg_max(event_type, (value, event_id)) OVER (PARTITION BY user_id) AS best FROM events")
def win_best_by_key(s, d):
    e = read(s, d, "events").select("user_id", "event_id", "event_type", "value")
    best = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("value", "event_id")).alias("best"))
    return e.join(best, "user_id").select("user_id", "event_id", "best")


@query(f"WITH {KP} SELECT CAST(created_on AS VARCHAR)[1:7] AS key, category, count(*) AS n FROM kp WHERE category IN ('fact','method') GROUP BY ALL")
def tim_by_category(s, d):
    return knowledge(s, d).where(F.col("category").isin("fact", "method")).groupBy(F.date_format("created_on", "yyyy-MM").alias("key"), "category").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN m < 60 THEN concat(m, ' minutes') WHEN m < 1440 THEN concat(m // 60, ' hours') ELSE concat(m // 1440, ' days') END AS shown
FROM (SELECT event_id, CAST(floor((epoch(TIMESTAMP '2024-01-31') - epoch(ts)) / 60) AS BIGINT) AS m FROM events)""")
def tim_relative(s, d):
    m = F.floor((F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 60_000_000)
    shown = F.when(m < 60, F.concat_ws(" ", m, F.lit("minutes"))).when(m < 1440, F.concat_ws(" ", F.floor(m / 60), F.lit("hours"))).otherwise(F.concat_ws(" ", F.floor(m / 1440), F.lit("days")))
    return read(s, d, "events").select("event_id", shown.alias("shown"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tim_windows(s, d):
    from noema.streaming.events import window_counts

    e = read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return window_counts(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


# memory

@query(f"WITH {OPS}, i AS (SELECT user_id, memory_type, memory_key, least(2.0, 1 + 0.1 * (count(*) - 1))::DOUBLE AS w FROM ops GROUP BY ALL) SELECT memory_type, memory_key, round(w, 6) AS weight FROM i WHERE user_id = 1 AND w >= 0.1 ORDER BY memory_type, w DESC, memory_key")
def mem_list(s, d):
    return memory.upserts(memory_ops(s, d)).where("user_id = 1 and weight >= 0.1").select("memory_type", "memory_key", "weight").orderBy("memory_type", F.desc("weight"), "memory_key")


@query("SELECT user_id, CAST(max(CAST(props->>'k' AS INT)) AS INT) AS k FROM events GROUP BY user_id")
def mem_profile_field(s, d):
    return read(s, d, "events").groupBy("user_id").agg(F.max(F.from_json("props", "k int")["k"]).alias("k"))


# media helpers, on events as segments

@query("SELECT user_id, b AS batch, count(*) AS n, min(event_id) AS first_id FROM (SELECT user_id, event_id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 5) AS BIGINT) AS b FROM events) GROUP BY ALL")
def med_batches_of_five(s, d):
    b = F.floor((F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1) / 5)
    return read(s, d, "events").withColumn("batch", b).groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT user_id, count(*) AS words, round(avg(v), 3) AS mean, count(*) FILTER (v < 0.5) AS low, round(count(*) FILTER (v < 0.5) / count(*), 3) AS ratio FROM (SELECT user_id, (event_id % 100) / 100.0 AS v FROM events) GROUP BY user_id")
def med_speech_report(s, d):
    v = (F.col("event_id") % 100) / 100
    low = F.count_if(F.col("v") < 0.5)
    return read(s, d, "events").select("user_id", v.alias("v")).groupBy("user_id").agg(F.count("*").alias("words"), F.round(F.avg("v"), 3).alias("mean"), low.alias("low"), F.round(low / F.count("*"), 3).alias("ratio"))


@query("""WITH RECURSIVE e AS (SELECT user_id, floor(epoch(ts)) / 3600 AS start, floor(epoch(ts)) / 3600 + 0.5 AS stop, event_type AS text FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start, stop, text) AS i FROM e),
f AS (SELECT user_id, i, CAST(0 AS BIGINT) AS segment, start, stop, text, stop - start AS length FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.i, CASE WHEN joins THEN segment ELSE segment + 1 END, CASE WHEN joins THEN o.was ELSE o.start END, o.stop, CASE WHEN joins THEN concat(o.said, ' ', o.text) ELSE o.text END, CASE WHEN joins THEN o.length + o.stop - o.start ELSE o.stop - o.start END
  FROM (SELECT o.*, f.segment, f.start AS was, f.text AS said, f.length, o.start - f.stop <= 2 AND f.length + (o.stop - o.start) <= 60 AS joins FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1) o)
SELECT user_id, CAST(segment AS INT) AS segment, max(start) AS start, max(stop) AS stop, arg_max(text, i) AS text, round(arg_max(length, i), 6) AS length FROM f GROUP BY user_id, segment""")
def med_capped_segments(s, d):
    e = read(s, d, "events").select("user_id", (F.unix_seconds(F.col("ts").cast("timestamp")).cast("double") / 3600).alias("start"), F.col("event_type").alias("text"))
    return timeline.capped_segments(e.withColumn("stop", F.col("start") + 0.5), "user_id", 2.0, 60.0)


# mutations and logs

@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'click') WHERE r <= 500")
def dup_log_ring(s, d):
    return read(s, d, "events").where("event_type = 'click'").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id")


@query(f"WITH {EDGES} SELECT src, dst, rel FROM edges WHERE NOT (src = 'n1' AND dst = 'r1' AND rel = 'PART_OF')")
def mut_delete_relation(s, d):
    gone = s.createDataFrame([("n1", "r1", "PART_OF")], "src string, dst string, rel string")
    return edges(s, d).join(F.broadcast(gone), ["src", "dst", "rel"], "left_anti").select("src", "dst", "rel")


@query(f"WITH {KP}, t AS (SELECT id FROM kp ORDER BY confidence DESC, id LIMIT 3) SELECT id, CASE WHEN id IN (SELECT id FROM t) THEN 'edited' ELSE category END AS category FROM kp")
def mut_edit_top(s, d):
    k = knowledge(s, d)
    top = k.orderBy(F.desc("confidence"), "id").limit(3).select("id", F.lit(True).alias("hit"))
    return k.join(F.broadcast(top), "id", "left").select("id", F.when(F.col("hit"), "edited").otherwise(F.col("category")).alias("category"))


@query("SELECT sha256(text) AS hash, arg_max(doc_id, doc_id) AS id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_register(s, d):
    return dedup.exact(_texts(s, d), "text").where("version > 1").select("hash", F.col("last_id").alias("id"))


@query(r"SELECT id, n FROM (SELECT doc_id AS id, len(list_filter(regexp_split_to_array(text, '[。！？\n]+'), lambda x: contains(lower(x), 'the'))) AS n FROM documents) WHERE n > 0 ORDER BY n DESC, id LIMIT 15")
def top_key_sentences(s, d):
    n = F.size(F.filter(F.split("text", "[。！？\\n]+"), lambda x: F.lower(x).contains("the")))
    return _texts(s, d).select("id", n.cast("long").alias("n")).where("n > 0").orderBy(F.desc("n"), "id").limit(15)


@query(f"WITH {KP} SELECT count(*) AS n, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages, (SELECT count(*) FROM embeddings) AS vectors FROM kp")
def agg_system_counts(s, d):
    v = read(s, d, "embeddings").agg(F.count("*").alias("vectors"))
    return knowledge(s, d).agg(F.count("*").alias("n"), F.ceil(F.count("*") / 20).alias("pages")).join(F.broadcast(v))


@query(f"WITH {KP}, r AS (SELECT category, id, confidence FROM kp WHERE status = 'active') SELECT category, id, confidence FROM r WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def joi_semi_labels(s, d):
    good = read(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return knowledge(s, d).where("status = 'active'").join(good, "id", "left_semi").select("category", "id", "confidence")



