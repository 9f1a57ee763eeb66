"""Queries on names, entities, code, sources and rule-based labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from noema.functions import text
from noema.operators import code_graph, retrieval
from noema.operators.blocks import small
from noema.plans.queries import _r, _texts, query
from noema.plans.views import EDGES, KP, TOKENS
from noema.sources import parsers
from noema.sources.tables import edges, knowledge, read

# sets and names

_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) >= 2))"


@query(f"""WITH t AS (SELECT conv_id, turn, {_WORDS} AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn, len(list_intersect(a.w, b.w)) AS shared, len(list_distinct(list_concat(a.w, b.w))) AS one_of, greatest(len(a.w), len(b.w)) AS most FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN one_of = 0 THEN 0 ELSE shared / one_of END, 6)::DOUBLE AS jaccard, round(CASE WHEN most = 0 THEN 0 ELSE shared / most END, 6)::DOUBLE AS overlap FROM p""")
def set_keyword_overlap(s, d):
    w = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) >= 2))
    t = read(s, d, "conversations").select("conv_id", "turn", w.alias("w"))
    pairs = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("w2")), ["conv_id", "turn"])
    both, most = F.size(F.array_intersect("w", "w2")), F.greatest(F.size("w"), F.size("w2"))
    any_ = F.size(F.array_union("w", "w2"))
    return pairs.select("conv_id", "turn", _r(F.when(any_ == 0, 0.0).otherwise(both / any_)).alias("jaccard"), _r(F.when(most == 0, 0.0).otherwise(both / most)).alias("overlap"))


@query(f"WITH {EDGES} SELECT node, string_agg(DISTINCT alias, ',' ORDER BY alias) AS aliases FROM (SELECT src AS node, dst AS alias FROM edges UNION ALL SELECT dst, rel FROM edges) GROUP BY node")
def set_alias_union(s, d):
    e = edges(s, d)
    names = e.select(F.col("src").alias("node"), F.col("dst").alias("alias")).unionByName(e.select(F.col("dst").alias("node"), F.col("rel").alias("alias")))
    return names.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases"))


@query("WITH v AS (SELECT p_partkey, lower(trim(p_name)) AS k FROM part) SELECT v.p_partkey AS id, c.canonical, c.n AS alike FROM v JOIN (SELECT k, min(p_partkey) AS canonical, count(*) AS n FROM v GROUP BY k) c USING (k)")
def dup_entity_normalise(s, d):
    v = read(s, d, "part").select(F.col("p_partkey").alias("id"), F.lower(F.trim("p_name")).alias("k"))
    return v.join(v.groupBy("k").agg(F.min("id").alias("canonical"), F.count("*").alias("alike")), "k").select("id", "canonical", "alike")


@query("SELECT o_orderkey, l_partkey AS first_part FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def joi_first_match(s, d):
    first = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first_part"))
    return read(s, d, "orders").select("o_orderkey").join(first, "o_orderkey", "left")


@query(f"""WITH {TOKENS}, w AS (SELECT DISTINCT id, unnest(t) AS word FROM tok),
b AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]', ' ', 'g'), '\\s+'), lambda x: x <> '')) AS word FROM benchmark)
SELECT id, count(*) AS known FROM w SEMI JOIN b USING (word) GROUP BY id""")
def joi_called_names(s, d):
    w = _texts(s, d).select("id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("word"))
    known = read(s, d, "benchmark").select(F.explode(text.tokens(F.col("text"))).alias("word")).distinct()
    return w.join(known, "word", "left_semi").groupBy("id").agg(F.count("*").alias("known"))


_PARTS = ["table", "ring", "bolt", "widget", "gear"]


@query("SELECT p_partkey, list_filter(['table','ring','bolt','widget','gear'], lambda x: contains(p_name, x))[1] AS component FROM part WHERE len(list_filter(['table','ring','bolt','widget','gear'], lambda x: contains(p_name, x))) > 0")
def joi_component_lines(s, d):
    hits = F.filter(F.array(*map(F.lit, _PARTS)), lambda x: F.col("p_name").contains(x))
    return read(s, d, "part").select("p_partkey", F.get(hits, F.lit(0)).alias("component")).where("component is not null")


# code

def _part_files(s, d):
    """A source file for each part: a function that calls the next part's function, the one of its half, and one that nobody defines."""
    k = F.col("p_partkey")
    body = F.concat(F.lit("def f"), k, F.lit("(x):\n    if x:\n        return f"), k + 1, F.lit("(x - 1)\n    return f"), F.floor(k / 2).cast("long"), F.lit("(x) + unknown(x)\n"))
    return read(s, d, "part").select(F.concat(F.lit("p/"), k, F.lit(".py")).alias("path"), body.alias("code"))


_GRAPH_OF_FILES = "pk AS (SELECT p_partkey AS k FROM part), ge AS (SELECT concat('p/', k, '.py') AS src, concat('f', k) AS dst, 'CONTAINS' AS kind FROM pk UNION SELECT concat('f', k), concat('f', t), 'CALLS' FROM (SELECT k, unnest([k + 1, k // 2]) AS t FROM pk) WHERE t IN (SELECT k FROM pk))"


@query(f"WITH {_GRAPH_OF_FILES} SELECT src, dst, kind FROM ge")
def gra_code_graph(s, d):
    return code_graph.code_edges(parsers.code_functions(_part_files(s, d)))


@query(f"WITH {_GRAPH_OF_FILES}, x AS (SELECT dst AS name, string_agg(src, ',' ORDER BY src) AS callers FROM ge WHERE kind = 'CALLS' GROUP BY 1), y AS (SELECT src AS name, string_agg(dst, ',' ORDER BY dst) AS callees FROM ge WHERE kind = 'CALLS' GROUP BY 1) SELECT g.dst AS name, callers, callees FROM ge g LEFT JOIN x ON x.name = g.dst LEFT JOIN y ON y.name = g.dst WHERE kind = 'CONTAINS' AND contains(g.dst, '17')")
def gra_function_search(s, d):
    found = code_graph.callers_and_callees(gra_code_graph(s, d), "17")
    return found.select("name", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"))


@query(f"WITH {EDGES} SELECT rel, count(*) AS n, round(avg(conf), 6) AS mean FROM edges GROUP BY rel")
def gra_read_query(s, d):
    wanted = "SELECT rel, count(*) AS n, round(avg(conf), 6) AS mean FROM {edges} GROUP BY rel"
    if not text.read_only(wanted.format(edges="edges")):
        raise ValueError("not a reading query")
    return s.sql(wanted, edges=edges(s, d))


# sources

@query("SELECT count(*) AS rows, CAST(5 AS INTEGER) AS columns, 'c_custkey: bigint, c_name: string, c_nationkey: int, c_acctbal: double, c_mktsegment: string' AS types FROM customer")
def src_table_profile(s, d):
    return parsers.table_profile(read(s, d, "customer"))


@query("SELECT doc_id AS id, strlen(text) AS bytes FROM documents WHERE strlen(text) <= 8192")
def src_size_limit(s, d):
    return _texts(s, d).select("id", F.octet_length("text").cast("long").alias("bytes")).where("bytes <= 8192")


@query("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages")
def src_titles(s, d):
    return read(s, d, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query(r"SELECT doc_id AS id, len(list_filter(regexp_split_to_array(text, '\n'), lambda x: length(trim(x, ' ')) > 30)) AS lines FROM documents")
def src_long_lines(s, d):
    return _texts(s, d).select("id", F.size(F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 30)).cast("long").alias("lines"))


# incremental index

@query(f"WITH {TOKENS}, {KP}, x AS (SELECT id, unnest(list_distinct(t)) AS term FROM tok) SELECT term, count(*) AS df FROM x JOIN kp USING (id) WHERE status <> 'replaced' GROUP BY term")
def ret_incremental_df(s, d):
    """What was indexed, less what was taken out again: counts alone. Only the removed facts' postings are looked up, no text is read anew."""
    held, _ = retrieval.index(s, d)
    gone = knowledge(s, d).where("status = 'replaced'").select("id")
    all_ = held.groupBy("term").agg(F.count("*").alias("n"))
    less = held.join(small(gone, 500_000), "id", "left_semi").groupBy("term").agg(F.count("*").alias("less"))
    return all_.join(less, "term", "left").select("term", (F.col("n") - F.coalesce("less", F.lit(0))).alias("df")).where("df > 0")


# labels by rule

@query("SELECT conv_id, turn, CASE WHEN contains(t, 'detail') OR contains(t, 'explain') THEN 'detailed' WHEN contains(t, 'short') OR contains(t, 'brief') OR contains(t, 'que') THEN 'concise' ELSE 'plain' END AS style FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'user')")
def fun_style(s, d):
    rules = [(["detail", "explain"], "detailed"), (["short", "brief", "que"], "concise")]
    return read(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", text.first_label(F.lower("text"), rules, "plain").alias("style"))


@query("SELECT conv_id, turn, CASE WHEN c = m THEN 'compare' WHEN l = m THEN 'list' ELSE 'ask' END AS intent FROM (SELECT *, greatest(c, l, a) AS m FROM (SELECT conv_id, turn, contains(t, 'ent')::INT + contains(t, 'and')::INT AS c, contains(t, 'ion')::INT + contains(t, 'en')::INT + contains(t, 'er')::INT AS l, contains(t, '?')::INT + contains(t, 'wh')::INT AS a FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations)))")
def fun_intent_argmax(s, d):
    t = F.lower("text")
    hits = {"compare": ["ent", "and"], "list": ["ion", "en", "er"], "ask": ["?", "wh"]}
    n = {k: text.count_of(t, v) for k, v in hits.items()}
    most = F.greatest(*n.values())
    return read(s, d, "conversations").select("conv_id", "turn", F.when(n["compare"] == most, "compare").when(n["list"] == most, "list").otherwise("ask").alias("intent"))


@query("SELECT page_id, CASE split_part(split_part(split_part(url, '?', 1), '#', 1), '.', -1) WHEN 'html' THEN 'page' WHEN 'py' THEN 'python' ELSE 'other' END AS kind FROM pages")
def fun_kind_by_extension(s, d):
    end = F.substring_index(F.substring_index(F.substring_index("url", "?", 1), "#", 1), ".", -1)
    return read(s, d, "pages").select("page_id", F.when(end == "html", "page").when(end == "py", "python").otherwise("other").alias("kind"))


@query(f"WITH {KP} SELECT id, coalesce(fact, '') AS fact, coalesce(category, 'none') AS category, round(coalesce(confidence, 0.5), 2) AS confidence, coalesce(source, 'unknown') AS source FROM kp WHERE confidence > 0")
def flt_cards(s, d):
    return knowledge(s, d).where("confidence > 0").select("id", F.coalesce("fact", F.lit("")).alias("fact"), F.coalesce("category", F.lit("none")).alias("category"), F.round(F.coalesce("confidence", F.lit(0.5)), 2).alias("confidence"), F.coalesce("source", F.lit("unknown")).alias("source"))


@query(f"WITH {KP} SELECT substring(CAST(created_on AS VARCHAR), 1, 7) AS key, count(*) AS n FROM kp GROUP BY 1 HAVING bool_or(contains(lower(fact), 'schen') OR contains(category, 'meth'))")
def flt_timeline_text(s, d):
    hit = F.lower("fact").contains("schen") | F.col("category").contains("meth")
    return knowledge(s, d).groupBy(F.date_format("created_on", "yyyy-MM").alias("key")).agg(F.count("*").alias("n"), F.bool_or(hit).alias("hit")).where("hit").drop("hit")


@query("SELECT n.n_name AS nation, r.r_name AS region FROM nation n JOIN region r ON n_regionkey = r_regionkey WHERE contains(lower(r.r_name), 'a')")
def joi_category_lookup(s, d):
    r = read(s, d, "region").where(F.lower("r_name").contains("a")).select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    return read(s, d, "nation").join(small(r), "n_regionkey").select(F.col("n_name").alias("nation"), "region")
