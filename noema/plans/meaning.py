"""Queries on what texts say: labels by rule, time expressions, quality by kind of source."""

from __future__ import annotations

from pyspark.sql import functions as F

from noema.functions import moments, rules
from noema.operators import timeline
from noema.plans.queries import _r, query
from noema.plans.views import KP
from noema.sources.tables import knowledge, read


def _given(s, d, columns: str, rows: list):
    """The rows, dealt to the keys of the parts (column ``key``) in turn, so that a rule meets every form as often as the table is long."""
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [c.split()[1] for c in columns.split(", ")]
    cases = F.array(*[F.struct(*[F.lit(v).cast(k).alias(n) for v, n, k in zip(r, names, kinds, strict=True)]) for r in rows])
    return read(s, d, "part").select(F.col("p_partkey").alias("key"), F.element_at(cases, (F.col("p_partkey") % len(rows) + 1).cast("int")).alias("x")).select("key", "x.*")


def _sql(x) -> str:
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"


def _values(rows: list, columns: str) -> str:
    """The rows as SQL."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) t({columns})"


def _expected(rows: list, columns: str, of: int, casts: str = "") -> str:
    """What is expected for each key of the parts, as SQL: rows begin with the place of their case among ``of``; ``casts`` says what the columns are."""
    return f"SELECT p_partkey AS key, {casts or columns} FROM part JOIN ({_values(rows, 'place_, ' + columns)}) v ON v.place_ = p_partkey % {of}"


# labels

_RELATIONS = [("is a kind of", "IS_A"), ("PART OF the plan", "PART_OF"), ("an instance of it", "INSTANCE_OF"), ("this causes that", "CAUSES"), ("导致", "CAUSES"), ("depends on", "DEPENDS_ON"), ("表明", "INDICATES"), ("belongs to", "BELONGS_TO"), ("发生在", "OCCURS_AT"), ("before", "BEFORE"), ("之后", "AFTER"), ("evidenced by", "EVIDENCED_BY"), ("确认", "CONFIRMED_BY"), ("矛盾", "CONFLICTS_WITH"), ("endorsed by", "ENDORSED_BY"), ("revised to", "REVISED_TO"), ("near", "RELATED_TO"), ("is a part of", "IS_A")]


@query(_expected([(k, *x) for k, x in enumerate(_RELATIONS)], "label, kind", len(_RELATIONS)))
def gra_relation_labels(s, d):
    return _given(s, d, "label string", [(x,) for x, _ in _RELATIONS]).select("key", "label", rules.relation_type(F.col("label")).alias("kind"))


_NODES = [("Kickoff 会议", None, "Event"), ("2024年", None, "Event"), ("增长理论", None, "Concept"), ("Report.PDF", None, "Document"), ("战争报告", None, "Event"), ("Ada", None, "Entity"), ("Ada", "Person", "Person")]


@query(_expected([(k, *x) for k, x in enumerate(_NODES)], "name, given, kind", len(_NODES)))
def gra_node_labels(s, d):
    return _given(s, d, "name string, given string", [x[:2] for x in _NODES]).select("key", "name", "given", rules.node_type(F.col("name"), F.col("given")).alias("kind"))


@query("SELECT page_id, CASE WHEN contains(u, 'pdf') THEN 'PDF文档' WHEN contains(u, 'word') THEN 'Word文档' WHEN contains(u, 'ppt') THEN 'PPT演示' WHEN contains(u, 'image') THEN '图片' WHEN contains(u, 'web') THEN '网页' WHEN contains(u, 'table') THEN '表格' WHEN contains(u, 'code') THEN '代码' WHEN contains(u, 'text') THEN '文本' WHEN url LIKE '%.docx' OR url LIKE '%.doc' THEN 'Word文档' WHEN url LIKE 'http%' THEN '网页' ELSE '文本' END AS kind FROM (SELECT page_id, url, lower(url) AS u FROM pages)")
def ctg_source_kinds(s, d):
    return read(s, d, "pages").select("page_id", rules.source_type(F.col("url")).alias("kind"))


_INTENTS = [("compare class A vs class B", "fact_query", True, False, True, False, "code"), ("会议的历史图表", "fact_query", False, True, False, False, "image_chart"), ("那个视频说了什么影响", "fuzzy_reference", False, False, False, True, "audiovisual"), ("hello", "fact_query", False, False, False, False, "general"), ("类图的区别", "fact_query", True, False, True, False, "image_chart")]


@query(_expected([(k, *x) for k, x in enumerate(_INTENTS)], "text, type, is_code_related, is_timeline_related, is_comparison, needs_graph_exploration, content_type", len(_INTENTS)))
def fun_intent_flags(s, d):
    return _given(s, d, "text string", [x[:1] for x in _INTENTS]).withColumn("i", rules.intent(F.col("text"))).select("key", "text", "i.*")


_CODE = "contains(t, 'function') OR contains(t, 'class') OR contains(t, 'code') OR contains(t, 'algorithm') OR contains(t, 'method') OR contains(t, 'module')"


_HAS = lambda text, words: "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


@query(f"SELECT conv_id, turn, CASE WHEN {_HAS('text', rules.FUZZY_WORDS)} THEN 'fuzzy_reference' ELSE 'fact_query' END AS type, {_CODE} AS is_code_related, {_HAS('text', rules.TIMELINE_WORDS)} AS is_timeline_related, {_HAS('text', rules.COMPARISON_WORDS)} AS is_comparison, {_HAS('text', rules.GRAPH_WORDS)} AS needs_graph_exploration, CASE WHEN {_HAS('text', rules.IMAGE_WORDS)} THEN 'image_chart' WHEN {_HAS('text', rules.MEDIA_WORDS)} THEN 'audiovisual' WHEN {_CODE} THEN 'code' ELSE 'general' END AS content_type FROM (SELECT conv_id, turn, q AS text, lower(q) AS t FROM (SELECT *, concat(text, CASE turn % 5 WHEN 0 THEN ' 上次的图' WHEN 1 THEN ' 发展历程' WHEN 2 THEN ' 视频的关系' ELSE '' END) AS q FROM conversations WHERE role = 'user'))")
def fun_message_intents(s, d):
    """Users' messages, most with a few words behind them that decide a field."""
    more = F.when(F.col("turn") % 5 == 0, " 上次的图").when(F.col("turn") % 5 == 1, " 发展历程").when(F.col("turn") % 5 == 2, " 视频的关系").otherwise("")
    return read(s, d, "conversations").where("role = 'user'").withColumn("i", rules.intent(F.concat("text", more))).select("conv_id", "turn", "i.*")


@query(f"WITH {KP}, g AS (SELECT id, CASE category WHEN 'method' THEN '方法流程' WHEN 'fact' THEN '事件记录' ELSE '概念理论' END AS grp FROM kp) SELECT grp, count(*) AS n FROM g GROUP BY grp HAVING count(*) >= 3")
def ctg_structural_groups(s, d):
    named = F.when(F.col("category") == "method", "方法").when(F.col("category") == "fact", "事实").when(F.col("category") == "concept", "概念").when(F.col("category") == "opinion", "观点").otherwise("待验证")
    return knowledge(s, d).groupBy(rules.category_group(named).alias("grp")).agg(F.count("*").alias("n")).where("n >= 3")


_FACTS = [(1, "系统架构的设计方法与代码", "技术", 0.8), (1, "系统架构的设计方法与代码", "方法流程", 0.55), (2, "公司的CEO发布了模型", "概念理论", 0.55), (2, "公司的CEO发布了模型", "事件记录", 0.55), (2, "公司的CEO发布了模型", "人物关系", 0.55)]


@query(_expected([(x[0] - 1, *x[1:]) for x in _FACTS], "fact, name, confidence", 3, "fact, name, CAST(confidence AS DOUBLE) AS confidence"))
def ctg_keyword_top3(s, d):
    given = _given(s, d, "fact string", [x[1:] for x in sorted({x[:2] for x in _FACTS} | {(3, "nothing")})])
    return given.select("key", "fact", F.explode(rules.suggestions(F.col("fact"))).alias("x")).select("key", "fact", "x.*")


_KINDS = ["pdf", "word", "ppt", "image", "web", "table", "code", "text", "video", "audio", "other"]


@query(f"WITH {KP} SELECT id, (['pdf','word','ppt','image','web','table','code','text','video','audio','other'])[id % 11 + 1] AS kind, CAST(([0.85,0.75,0.65,0.55,0.45,0.70,0.75,0.50,0.65,0.60,0.50])[id % 11 + 1] AS DOUBLE) AS quality FROM kp")
def cnf_extracted_quality(s, d):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("id") % 11 + 1).cast("int"))
    return knowledge(s, d).select("id", kind.alias("kind"), _r(rules.extracted_quality(kind, F.col("fact"))).alias("quality"))


_QUALITIES = [("pdf", "官方数据显示", 0.93), ("web", "我认为可能", 0.4), ("web", "我觉得有证明", 0.48), ("other", "x", 0.5)]


@query(_expected([(k, *x) for k, x in enumerate(_QUALITIES)], "kind, text, quality", len(_QUALITIES), "kind, text, CAST(quality AS DOUBLE) AS quality"))
def cnf_extracted_quality_words(s, d):
    return _given(s, d, "kind string, text string", [x[:2] for x in _QUALITIES]).select("key", "kind", "text", _r(rules.extracted_quality(F.col("kind"), F.col("text"))).alias("quality"))


_PATHS = [("a/b.PY", "python"), ("x.ipynb", "python"), ("m.hpp", "cpp"), ("lib.rs", "rust"), ("noext", "unknown"), ("q.weird", "unknown"), ("d.ir/file", "unknown"), ("s.SQL", "sql")]


@query(_expected([(k, *x) for k, x in enumerate(_PATHS)], "path, language", len(_PATHS), "concat(replace(p_type, ' ', '/'), '/', path) AS path, language"))
def fun_languages(s, d):
    """Files in folders named after the parts' types."""
    folders = read(s, d, "part").select(F.col("p_partkey").alias("key"), F.replace("p_type", F.lit(" "), F.lit("/")).alias("folder"))
    files = _given(s, d, "path string", [x[:1] for x in _PATHS]).join(folders, "key").select("key", F.concat("folder", F.lit("/"), "path").alias("path"))
    return files.select("key", "path", rules.language(F.col("path")).alias("language"))


@query("SELECT doc_id AS id, replace(replace(text, 'the', 'THE'), 'and', '&') AS text FROM documents")
def fun_replaced_terms(s, d):
    return read(s, d, "documents").select(F.col("doc_id").alias("id"), rules.replaced(F.col("text"), {"the": "THE", "and": "&"}).alias("text"))


_PUT = {1: '{"a": @}', 2: "```json\n{\"a\": @}\n```", 3: 'Sure: {"a": @} as asked', 4: "none at all, @", 0: "{broken @"}


@query("SELECT p_partkey AS key, CASE WHEN p_partkey % 5 IN (1, 2, 3) THEN p_size END AS a FROM part")
def fun_salvaged_json(s, d):
    """Answers that a model would give, with each part's size in them."""
    text = F.lit(None).cast("string")
    for k, form in _PUT.items():
        text = F.when(F.col("p_partkey") % 5 == k, F.replace(F.lit(form), F.lit("@"), F.col("p_size").cast("string"))).otherwise(text)
    return read(s, d, "part").select(F.col("p_partkey").alias("key"), rules.salvaged(text, "a int")["a"].alias("a"))


# time expressions

# texts that name the day of an order in one of eight forms
_PARTS = "o_orderkey AS id, o_orderkey % 8 AS form, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS dd, CAST(quarter(o_orderdate) AS INT) AS q"


def _told(s, d):
    """id, text."""
    o = read(s, d, "orders").selectExpr(*_PARTS.split(", "), "substring(cast(o_orderdate as string), 1, 10) as iso")
    forms = ["concat('于', y, '年', m, '月')", "concat(y, '年Q', q, '财报')", "concat('on ', iso, '!')", "concat(y, '年见')", "concat(y, '年春季')", "concat('公元前', y - 1900, '年')", "concat(floor(y / 100) + 1, '世纪', lpad(floor(y % 100 / 10) * 10, 2, '0'), '年代')", "concat('始于', y, '年', m, '月，', y - 1, '年Q', q, '与', y - 2, '年13月')"]
    return o.selectExpr("id", f"CASE form {' '.join(f'WHEN {k} THEN {x}' for k, x in enumerate(forms))} END AS text")


_EVENTS = f"""o AS (SELECT {_PARTS} FROM orders), ev AS (
SELECT id, 0 AS place, 'year_month' AS kind, concat(y, '年', m, '月') AS label, y AS year, m AS month FROM o WHERE form = 0
UNION ALL SELECT id, 0, 'quarter', concat(y, '年Q', q), y, 3 * q - 2 FROM o WHERE form = 1
UNION ALL SELECT id, 0, 'date', concat(y, '年', m, '月', dd, '日'), y, m FROM o WHERE form = 2
UNION ALL SELECT id, 0, 'year', concat(y, '年'), y, NULL FROM o WHERE form IN (3, 4)
UNION ALL SELECT id, 1, 'season', concat(y, '年春季'), y, 3 FROM o WHERE form = 4
UNION ALL SELECT id, 0, 'era', concat('公元前', y - 1900, '年'), 1900 - y, NULL FROM o WHERE form = 5
UNION ALL SELECT id, 0, 'era', concat(y // 100 + 1, '世纪', lpad(CAST(y % 100 // 10 * 10 AS VARCHAR), 2, '0'), '年代'), y // 10 * 10, NULL FROM o WHERE form = 6
UNION ALL SELECT id, 0, 'year', concat(y - 2, '年'), y - 2, NULL FROM o WHERE form = 7
UNION ALL SELECT id, 1, 'quarter', concat(y - 1, '年Q', q), y - 1, 3 * q - 2 FROM o WHERE form = 7
UNION ALL SELECT id, 2, 'year_month', concat(y, '年', m, '月'), y, m FROM o WHERE form = 7)"""


@query(f"WITH {_EVENTS} SELECT id, CAST(place AS INT) AS place, kind, label, CAST(year AS INT) AS year, CAST(month AS INT) AS month FROM ev")
def tim_expressions(s, d):
    return _told(s, d).select("id", F.posexplode(moments.event_times(F.col("text"))).alias("place", "e")).select("id", "place", "e.kind", "e.label", "e.year", "e.month")


_FOUND = r"""f AS (SELECT id, fact, created_on, list_filter(list_transform(regexp_extract_all(fact, '\d{4}[-/.]\d{1,2}[-/.]\d{1,2}'), lambda x: list_transform(regexp_split_to_array(x, '[-/.]'), lambda y: CAST(y AS INT))), lambda x: x[2] BETWEEN 1 AND 12 AND x[3] BETWEEN 1 AND 31) AS e FROM kp),
k AS (SELECT id, created_on, CASE WHEN len(e) > 0 THEN format('{:04d}-{:02d}', list_min(e)[1], list_min(e)[2]) END AS event_key FROM f)"""


def _keyed(s, d):
    k = knowledge(s, d)
    return k.select("id", "category", "confidence", moments.standard_time(moments.event_times(F.col("fact"))).alias("event_key"), F.date_format("created_on", "yyyy-MM").alias("created_key"))


@query(f"WITH {_EVENTS} SELECT id, concat(CASE WHEN year < 0 THEN '-' ELSE '' END, format('{{:04d}}-{{:02d}}', abs(year), coalesce(month, 1))) AS event_key FROM ev WHERE place = 0")
def tim_standard(s, d):
    return _told(s, d).select("id", moments.standard_time(moments.event_times(F.col("text"))).alias("event_key"))


@query(f"WITH {KP}, {_FOUND} SELECT coalesce(event_key, substring(CAST(created_on AS VARCHAR), 1, 7), 'unknown') AS key, count(*) AS n, min(id) AS first_id FROM k GROUP BY 1")
def tim_text_groups(s, d):
    return _keyed(s, d).groupBy(F.coalesce("event_key", "created_key", F.lit("unknown")).alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"WITH {_EVENTS}, g AS (SELECT year, coalesce(month, 1) AS month, count(*) AS n FROM ev WHERE place = 0 GROUP BY ALL) SELECT CAST(year AS INT) AS year, CAST(month AS INT) AS month, concat(CASE WHEN year < 0 THEN '公元前' ELSE '' END, abs(year), '年', month, '月') AS label, n, CAST(row_number() OVER (ORDER BY year DESC, month DESC) AS INT) AS place FROM g")
def tim_timeline(s, d):
    """The months that texts name first, years before our era among them."""
    e = moments.earliest(moments.event_times(F.col("text")))
    return timeline.of_months(_told(s, d).select(e.alias("e")).select("e.year", "e.month"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 6 AS f, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, substring(CAST(o_orderdate AS VARCHAR), 1, 10) AS iso FROM orders)
SELECT id, CASE f WHEN 0 THEN concat(y, '年') WHEN 1 THEN concat(y, '年', m, '月') WHEN 2 THEN concat(y, '年', m, '月', dd, '日') WHEN 3 THEN substring(iso, 1, 7) WHEN 4 THEN CAST(y AS VARCHAR) ELSE concat(y, '-x') END AS label FROM o""")
def tim_labels(s, d):
    """Keys made of order days: whole ones by year, month and (with slashes) day; a month by day, a year by month and one that is none stay as they are."""
    iso = F.substring(F.col("o_orderdate").cast("string"), 1, 10)
    f = F.col("o_orderkey") % 6
    key = F.when(f == 2, F.replace(iso, F.lit("-"), F.lit("/"))).when(f == 3, F.substring(iso, 1, 7)).when(f == 4, F.substring(iso, 1, 4)).when(f == 5, F.concat(F.substring(iso, 1, 4), F.lit("-x"))).otherwise(iso)
    o = read(s, d, "orders").select(F.col("o_orderkey").alias("id"), f.alias("f"), key.alias("key"))
    return o.select("id", F.when(F.col("f") == 0, moments.label(F.col("key"), "year")).when(F.col("f").isin(2, 3), moments.label(F.col("key"), "day")).otherwise(moments.label(F.col("key"), "month")).alias("label"))


_WORDS = [("上周三", "day - (isodow(day) + 4) % 7 - 7", "day", 0.6), ("下星期一", "day - (isodow(day) + 6) % 7 + 7", "day", 0.6), ("周日", "day - isodow(day) % 7", "day", 0.6), ("昨天", "day - 1", "day", 0.8), ("今天", "day", "day", 0.9), ("明天", "day + 1", "day", 0.8), ("本周", "monday", "week", 0.5), ("上周", "monday - 7", "week", 0.5), ("本月", "first", "month", 0.6), ("上月", "first - INTERVAL 1 MONTH", "month", 0.6), ("今年", "jan", "year", 0.7), ("去年", "jan - INTERVAL 1 YEAR", "year", 0.7), ("上季度", "quarter - INTERVAL 3 MONTH", "quarter", 0.5)]


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey % {len(_WORDS) + 1} AS f, CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday, CAST(date_trunc('month', o_orderdate) AS DATE) AS first, CAST(date_trunc('year', o_orderdate) AS DATE) AS jan, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter FROM orders)
SELECT id, CASE f {' '.join(f"WHEN {k} THEN CAST({x[1]} AS DATE)" for k, x in enumerate(_WORDS))} END AS day, CASE f {' '.join(f"WHEN {k} THEN '{x[2]}'" for k, x in enumerate(_WORDS))} END AS precision, CAST(CASE f {' '.join(f"WHEN {k} THEN {x[3]}" for k, x in enumerate(_WORDS))} END AS DOUBLE) AS confidence FROM o WHERE f < {len(_WORDS)}""".replace(" - (isodow(day) + 4) % 7 - 7", " - CAST((isodow(day) + 4) % 7 + 7 AS INT)").replace(" - (isodow(day) + 6) % 7 + 7", " - CAST((isodow(day) + 6) % 7 - 7 AS INT)").replace(" - isodow(day) % 7", " - CAST(isodow(day) % 7 AS INT)"))
def tim_resolved(s, d):
    """Words for days as seen from the day of an order; an unknown one gives nothing."""
    words = F.element_at(F.array(*[F.lit(x[0]) for x in _WORDS], F.lit("some day")), (F.col("o_orderkey") % (len(_WORDS) + 1) + 1).cast("int"))
    found = read(s, d, "orders").select(F.col("o_orderkey").alias("id"), moments.resolved(words, F.col("o_orderdate").cast("date")).alias("r"))
    return found.where("r is not null").select("id", F.col("r.date").alias("day"), "r.precision", "r.confidence")


@query(f"WITH {KP}, e AS (SELECT source, id, created_on, (['day','month','year','week','quarter','other'])[id % 6 + 1] AS precision, confidence + 0.3 * CAST(([1.0,0.9,0.6,0.7,0.5,0.2])[id % 6 + 1] AS DOUBLE) AS w FROM kp) SELECT source, arg_max(created_on, (round(w, 9), -id)) AS created_on, arg_max(precision, (round(w, 9), -id)) AS precision FROM e GROUP BY source")
def win_best_event_time(s, d):
    precision = F.element_at(F.array(*map(F.lit, ("day", "month", "year", "week", "quarter", "other"))), (F.col("id") % 6 + 1).cast("int"))
    k = knowledge(s, d).select("source", "id", "created_on", precision.alias("precision"), "confidence").withColumn("w", F.struct(F.round(moments.worth(F.col("confidence"), F.col("precision")), 9), -F.col("id")))
    return k.groupBy("source").agg(F.max_by("created_on", "w").alias("created_on"), F.max_by("precision", "w").alias("precision"))


_MONTHS = "g AS (SELECT substring(CAST(created_on AS VARCHAR), 1, 7) AS key, count(*) AS n FROM c GROUP BY 1), m AS (SELECT avg(n) AS mean, stddev_pop(n) AS dev FROM g)"


@query(f"WITH {KP}, c AS (SELECT * FROM kp WHERE id % 3 <> 0 OR month(created_on) = 5), {_MONTHS}, t AS (SELECT substring(CAST(created_on AS VARCHAR), 1, 7) AS key, category, count(*) AS n FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, category) AS r FROM t) SELECT g.key, g.n, round(g.n / greatest(mean, 1) + 1e-9, 1) AS multiplier, g.n > 2.5 * mean AS is_burst, g.n > mean + 2 * dev AND g.n >= 5 AS recorded, (SELECT string_agg(category, ',' ORDER BY r) FROM r WHERE r.key = g.key AND r <= 3) AS top FROM g, m")
def tim_burst_records(s, d):
    return timeline.burst_records(knowledge(s, d).where("id % 3 <> 0 or month(created_on) = 5").select(F.date_format("created_on", "yyyy-MM").alias("key"), "category"))


@query(f"WITH {KP}, c AS (SELECT * FROM kp WHERE month(created_on) NOT IN (3, 4, 5, 6)), {_MONTHS}, f AS (SELECT key, n, CAST(concat(key, '-01') AS DATE) AS day FROM g), w AS (SELECT key, n, coalesce(lead(day) OVER (ORDER BY day) - day > 90, FALSE) AS is_gap FROM f), a AS (SELECT substring(CAST(created_on AS VARCHAR), 1, 7) AS key, count(*) AS of_category, round(avg(confidence), 6) AS avg_conf FROM c WHERE category = 'fact' GROUP BY 1) SELECT key, of_category, avg_conf, is_gap, n > 2.5 * (SELECT avg(n) FROM g) AS is_burst FROM a JOIN w USING (key)")
def tim_category_groups(s, d):
    k = knowledge(s, d).where("month(created_on) not in (3, 4, 5, 6)").select(F.date_format("created_on", "yyyy-MM").alias("key"), "category", "confidence")
    return timeline.of_category(k, "fact", 90)
