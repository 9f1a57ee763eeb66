"""Queries that keep knowledge in order: categories, confidence, time, memory, media segments, mutations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from noema.functions import scores
from noema.operators import categories, memory, scan, timeline
from noema.plans.queries import _r, _texts, _vectors, query
from noema.plans.views import EDGES, KP, OPS, VECTORS
from noema.sources.tables import edges, knowledge, memory_ops, read

# categories

@query(f"""WITH {KP}, c AS (SELECT unnest(['concept','fact','method','opinion','pending','theory']) AS category), g AS (SELECT category, count(*) AS n, max(created_on) AS last_on FROM kp GROUP BY category)
SELECT c.category, coalesce(n, 0) AS n, coalesce(DATE '2025-01-10' - last_on > 30, true) AS stale, coalesce(n, 0) > 200 AS needs_split, coalesce(n, 0) = 0 AS needs_attention FROM c LEFT JOIN g USING (category)""")
def ctg_health(s, d):
    c = s.createDataFrame([(x,) for x in ("concept", "fact", "method", "opinion", "pending", "theory")], "category string")
    g = knowledge(s, d).groupBy("category").agg(F.count("*").alias("n"), F.max("created_on").alias("last_on"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    stale = F.coalesce(F.datediff(F.lit("2025-01-10").cast("date"), "last_on") > 30, F.lit(True))
    return c.join(g, "category", "left").select("category", n.alias("n"), stale.alias("stale"), (n > 200).alias("needs_split"), (n == 0).alias("needs_attention"))


@query(f"WITH {KP} SELECT id, category, confidence >= 0.6 AS sure FROM kp WHERE confidence >= 0.35")
def ctg_auto_assign(s, d):
    return knowledge(s, d).where("confidence >= 0.6 or confidence >= 0.35").select("id", "category", (F.col("confidence") >= 0.6).alias("sure"))


@query(f"""WITH {VECTORS}, p AS (SELECT a.label, 1 - avg(list_cosine_similarity(a.v, b.v)) AS diversity FROM vec a JOIN vec b ON a.label = b.label AND a.id < b.id GROUP BY a.label)
SELECT label, count(*) AS members, round(diversity, 5) AS diversity FROM vec JOIN p USING (label) GROUP BY label, diversity HAVING count(*) >= 20 AND diversity >= 0.05""")
def ctg_split(s, d):
    v = _vectors(s, d)
    n = v.groupBy("label").agg(F.count("*").alias("members")).where("members >= 20")
    return n.join(categories.diversity(v, "label"), "label").where("diversity >= 0.05").select("label", "members", F.round("diversity", 5).alias("diversity"))


@query(f"WITH {KP} SELECT source, max(created_on) AS last_on, round(avg(confidence), 6) AS mean FROM kp GROUP BY source HAVING DATE '2025-03-25' - max(created_on) >= 90 AND avg(confidence) >= 0.4")
def ctg_archive(s, d):
    g = knowledge(s, d).groupBy("source").agg(F.max("created_on").alias("last_on"), F.avg("confidence").alias("m"))
    return g.where((F.datediff(F.lit("2025-03-25").cast("date"), "last_on") >= 90) & (F.col("m") >= 0.4)).select("source", "last_on", _r("m").alias("mean"))


@query(f"WITH {EDGES} SELECT DISTINCT src, dst, rel FROM (SELECT src, dst, rel FROM edges UNION ALL VALUES ('n1','r1','PART_OF'), ('n1','n2','RELATED_TO'), ('n1','n2','RELATED_TO')) WHERE src = 'n1' OR dst = 'n1'")
def ctg_relations(s, d):
    new = s.createDataFrame([("n1", "r1", "PART_OF"), ("n1", "n2", "RELATED_TO"), ("n1", "n2", "RELATED_TO")], "src string, dst string, rel string")
    return edges(s, d).select("src", "dst", "rel").unionByName(new).where("src = 'n1' or dst = 'n1'").dropDuplicates(["src", "dst", "rel"])


@query("""WITH v AS (SELECT c_nationkey AS k, count(*) AS visits FROM customer GROUP BY 1)
SELECT n_regionkey AS parent, n_name AS child, coalesce(visits, 0) AS visits, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY coalesce(visits, 0) DESC, n_name) AS INT) AS place FROM nation LEFT JOIN v ON k = n_nationkey WHERE n_nationkey NOT IN (3, 8)""")
def ctg_personal_tree(s, d):
    hidden = [3, 8]
    v = read(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("v"))
    shown = read(s, d, "nation").where(~F.col("n_nationkey").isin(hidden)).join(v, "n_nationkey", "left").select(F.col("n_regionkey").alias("parent"), F.col("n_name").alias("child"), F.coalesce("v", F.lit(0).cast("long")).alias("visits"))
    return shown.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("visits"), "child")))


# confidence

@query(f"WITH {KP} SELECT id, confidence AS raw, feedback_alpha AS alpha, feedback_beta AS beta, interaction_count AS interactions, length(fact) AS chars, regexp_matches(fact, '[0-9]') AS has_digit, category, status FROM kp")
def cnf_features(s, d):
    return knowledge(s, d).select("id", F.col("confidence").alias("raw"), F.col("feedback_alpha").alias("alpha"), F.col("feedback_beta").alias("beta"), F.col("interaction_count").alias("interactions"), F.length("fact").cast("long").alias("chars"), F.col("fact").rlike("[0-9]").alias("has_digit"), "category", "status")


@query(f"""WITH {KP}, f AS (SELECT id, confidence, CASE id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'correct' END AS kind, feedback_alpha AS a, feedback_beta AS b FROM kp),
g AS (SELECT id, confidence, kind, CASE WHEN kind = 'negative' THEN a ELSE a + 1 END AS a, CASE kind WHEN 'negative' THEN b + 1 WHEN 'correct' THEN greatest(1, b - 0.5) ELSE b END AS b FROM f)
SELECT id, kind, round(least(greatest((confidence + a / (a + b)) / 2 * CASE WHEN kind = 'negative' THEN 0.8 ELSE 1 END, 0.1), 1.0), 6)::DOUBLE AS conf FROM g""")
def cnf_feedback_chain(s, d):
    kind = F.when(F.col("id") % 3 == 0, "positive").when(F.col("id") % 3 == 1, "negative").otherwise("correct")
    k = knowledge(s, d).select("id", "confidence", kind.alias("kind"), F.col("feedback_alpha").alias("a"), F.col("feedback_beta").alias("b"))
    a = F.when(F.col("kind") == "negative", F.col("a")).otherwise(F.col("a") + 1)
    b = F.when(F.col("kind") == "negative", F.col("b") + 1).when(F.col("kind") == "correct", F.greatest(F.lit(1.0), F.col("b") - 0.5)).otherwise(F.col("b"))
    mean = (F.col("confidence") + scores.feedback_mean(a, b)) / 2 * F.when(F.col("kind") == "negative", 0.8).otherwise(1.0)
    return k.select("id", "kind", _r(scores.clip(mean, 0.1, 1.0)).alias("conf"))


@query(f"WITH {KP}, g AS (SELECT source, avg(confidence) AS c FROM kp GROUP BY source) SELECT id, round(CASE WHEN confidence = 0.5 THEN c ELSE confidence END, 6) AS conf FROM kp JOIN g USING (source)")
def cnf_batch(s, d):
    k = knowledge(s, d).select("id", "source", "confidence")
    g = k.groupBy("source").agg(F.avg("confidence").alias("c"))
    return k.join(g, "source").select("id", _r(F.when(F.col("confidence") == 0.5, F.col("c")).otherwise(F.col("confidence"))).alias("conf"))


# time

_YEARS = "list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) = 4 AND x >= '1000' AND x <= '2100')"


@query(f"SELECT id, n, earliest, 2024 - earliest > 5 AS historic FROM (SELECT doc_id AS id, len({_YEARS}) AS n, CAST(list_min({_YEARS}) AS INTEGER) AS earliest FROM documents) WHERE n > 0")
def tim_years(s, d):
    years = F.filter(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), lambda x: (F.length(x) == 4) & (x >= "1000") & (x <= "2100"))
    found = _texts(s, d).select("id", years.alias("y")).where("size(y) > 0")
    earliest = F.array_min("y").cast("int")
    return found.select("id", F.size("y").cast("long").alias("n"), earliest.alias("earliest"), (2024 - earliest > 5).alias("historic"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 7 AS f, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT id, CAST(CASE f WHEN 0 THEN day - 1 WHEN 1 THEN date_trunc('week', day) - INTERVAL 7 DAY WHEN 2 THEN date_trunc('month', day) WHEN 3 THEN date_trunc('quarter', day) WHEN 4 THEN date_trunc('year', day) - INTERVAL 1 YEAR WHEN 5 THEN date_trunc('week', day) + INTERVAL 7 DAY END AS DATE) AS anchor FROM o""")
def tim_relative_anchors(s, d):
    """Relative words as seen from the day of an order; null for one that says nothing."""
    said = ["yesterday", "last week", "this month", "this quarter", "last year", "next monday", "some day"]
    word = F.element_at(F.array(*map(F.lit, said)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return read(s, d, "orders").select(F.col("o_orderkey").alias("id"), timeline.anchor(word, F.col("o_orderdate").cast("date")).alias("anchor"))


@query("""WITH x AS (SELECT user_id, lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS start, epoch(ts) AS stop FROM events)
SELECT user_id, round(start, 3) AS start, round(stop, 3) AS stop FROM x WHERE stop - start > 3600""")
def win_silences(s, d):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    x = scan.neighbours(read(s, d, "events").select("user_id", "ts", "event_id", t.alias("stop")), "user_id", "stop", "ts", "event_id", name="start")
    return x.where("stop - start > 3600").select("user_id", F.round("start", 3).alias("start"), F.round("stop", 3).alias("stop"))


@query("""SELECT DISTINCT user_id FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events WHERE event_type = 'error')) WHERE n >= 4""")
def win_lockout(s, d):
    e = read(s, d, "events").where("event_type = 'error'").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return e.withColumn("n", F.count("*").over(Window.partitionBy("user_id").orderBy("s").rangeBetween(-86400, 0))).where("n >= 4").select("user_id").distinct()


# memory

@query(f"WITH {OPS}, i AS (SELECT user_id, memory_type, memory_key, least(2.0, 1 + 0.1 * (count(*) - 1))::DOUBLE AS w FROM ops GROUP BY ALL) SELECT user_id, memory_type, memory_key, round(least(2.0, w + 0.05), 6)::DOUBLE AS weight FROM i WHERE w >= 0.1")
def mem_read_bump(s, d):
    return memory.upserts(memory_ops(s, d)).where("weight >= 0.1").select(*memory.KEY, _r(F.least(F.lit(2.0), F.col("weight") + 0.05)).alias("weight"))


@query("SELECT event_type AS kind, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1")
def mut_log_counts(s, d):
    return read(s, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


# media segments: users are recordings, events their segments

@query("SELECT e.user_id, event_id, round(epoch(ts) - s, 3) AS at FROM events e JOIN (SELECT user_id, epoch(min(ts)) AS s FROM events GROUP BY 1) f USING (user_id)")
def med_offsets(s, d):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    e = read(s, d, "events").select("user_id", "event_id", t.alias("t"))
    first = e.groupBy("user_id").agg(F.min("t").alias("s"))
    return e.join(first, "user_id").select("user_id", "event_id", F.round(F.col("t") - F.col("s"), 3).alias("at"))


@query("""SELECT user_id, day, n, concat(lpad(CAST(a // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(a % 60 AS VARCHAR), 2, '0'), '-', lpad(CAST(b // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(b % 60 AS VARCHAR), 2, '0')) AS label
FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, min(m) AS a, max(m) AS b FROM (SELECT user_id, ts, extract(hour FROM ts) * 60 + extract(minute FROM ts) AS m FROM events) GROUP BY ALL)""")
def med_scenes(s, d):
    m = F.hour("ts") * 60 + F.minute("ts")
    g = read(s, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.min(m).alias("a"), F.max(m).alias("b"))
    code = lambda x: F.format_string("%02d:%02d", F.floor(F.col(x) / 60), F.col(x) % 60)
    return g.select("user_id", "day", "n", F.concat_ws("-", code("a"), code("b")).alias("label"))


@query("SELECT user_id, len(x) AS changes, x[1] AS first_at, x[-1] AS last_at FROM (SELECT user_id, list_sort(list(DISTINCT round(value, 1))) AS x FROM events GROUP BY user_id)")
def med_scene_times(s, d):
    g = read(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.round("value", 1))).alias("x"))
    return g.select("user_id", F.size("x").cast("long").alias("changes"), F.get("x", F.lit(0)).alias("first_at"), F.element_at("x", -1).alias("last_at"))


@query("SELECT event_id, w AS word, p FROM (SELECT event_id, event_type AS w, round((event_id * 37 % 100) / 100.0, 2)::DOUBLE AS p FROM events) WHERE p < 0.5")
def med_low_words(s, d):
    p = F.round((F.col("event_id") * 37 % 100) / 100, 2)
    return read(s, d, "events").select("event_id", F.col("event_type").alias("word"), p.alias("p")).where("p < 0.5")


@query("SELECT id, abs(ocr - seen) > 2 * ocr AS contradicts FROM (SELECT doc_id AS id, length(text) AS ocr, n_chars * (doc_id % 5) AS seen FROM documents) WHERE ocr > 0 AND seen > 0")
def med_volume_contradiction(s, d):
    r = read(s, d, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("ocr"), (F.col("n_chars") * (F.col("doc_id") % 5)).alias("seen"))
    return r.where("ocr > 0 and seen > 0").select("id", (F.abs(F.col("ocr") - F.col("seen")) > 2 * F.col("ocr")).alias("contradicts"))


# mutations

@query("SELECT doc_id, tag FROM (SELECT doc_id, 'good' AS tag FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'bad' FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1) WHERE tag <> 'bad'")
def mut_delete_tag(s, d):
    tags = F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("quality") == 0, "bad"), F.when(F.col("toxic") == 1, "toxic"))
    assigned = read(s, d, "labels").select("doc_id", F.explode(F.array_compact(tags)).alias("tag"))
    gone = s.createDataFrame([("bad",)], "tag string")
    return assigned.join(F.broadcast(gone), "tag", "left_anti").select("doc_id", "tag")


@query(f"WITH {KP} SELECT id, CASE WHEN category = 'opinion' THEN NULL ELSE category END AS category FROM kp")
def mut_delete_category(s, d):
    k = knowledge(s, d).select("id", "category")
    left = k.select("category").distinct().where("category <> 'opinion'")
    return k.select("id", F.col("category").alias("c")).join(left, F.col("c") == F.col("category"), "left").select("id", "category")


@query(f"WITH {KP} SELECT id, created_on FROM kp ORDER BY created_on DESC, id DESC LIMIT 50 OFFSET 25")
def top_newest(s, d):
    return knowledge(s, d).select("id", "created_on").orderBy(F.desc("created_on"), F.desc("id")).offset(25).limit(50)
