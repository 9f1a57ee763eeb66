"""Word lists and maps by which texts are labelled, and the expressions that apply them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from noema.functions.text import contains_any, count_of, first_label

# They decide labels, so they must be these.
RELATION_WORDS = [
    (["is a", "isa", "是一种"], "IS_A"),
    (["part of", "partof", "组成部分"], "PART_OF"),
    (["instance of", "实例"], "INSTANCE_OF"),
    (["causes", "cause", "导致", "引起"], "CAUSES"),
    (["depends on", "dependson", "依赖"], "DEPENDS_ON"),
    (["indicates", "表明", "指示"], "INDICATES"),
    (["belongs to", "属于"], "BELONGS_TO"),
    (["occurs at", "发生在"], "OCCURS_AT"),
    (["before", "之前"], "BEFORE"),
    (["after", "之后"], "AFTER"),
    (["evidenced by", "证据"], "EVIDENCED_BY"),
    (["confirmed by", "确认"], "CONFIRMED_BY"),
    (["conflicts with", "冲突", "矛盾"], "CONFLICTS_WITH"),
    (["endorsed by", "支持"], "ENDORSED_BY"),
    (["revised to", "修订为"], "REVISED_TO"),
]
NODE_WORDS = [
    (["年", "月", "日", "事件", "会议", "战争", "革命"], "Event"),
    (["理论", "概念", "模型", "框架", "范式", "方法", "策略"], "Concept"),
    (["论文", "报告", "文献", "文档", "研究", "pdf", "doi"], "Document"),
]
SOURCE_WORDS = [
    (["pdf"], "PDF文档"),
    (["word"], "Word文档"),
    (["ppt"], "PPT演示"),
    (["image"], "图片"),
    (["web"], "网页"),
    (["table"], "表格"),
    (["code"], "代码"),
    (["text"], "文本"),
    (["手动输入"], "手动录入"),
    (["对话学习"], "对话学习"),
]
SOURCE_ENDINGS = [((".pdf",), "PDF文档"), ((".docx", ".doc"), "Word文档"), ((".pptx", ".ppt"), "PPT演示")]
CODE_WORDS = ["函数", "方法", "类", "代码", "算法", "调用", "实现", "模块", "接口", "function", "class", "code", "algorithm", "method", "module"]
TIMELINE_WORDS = ["历史", "发展", "历程", "演变", "时间线", "什么时候", "何时", "过程", "阶段", "先后", "之后", "之前", "从...到"]
COMPARISON_WORDS = ["区别", "不同", "对比", "比较", "差异", "vs", "相比", "哪个更好"]
GRAPH_WORDS = ["关系", "关联", "影响", "导致", "依赖于", "隶属于", "包含", "属于", "和...有关", "与...相关", "怎么影响"]
MEDIA_WORDS = ["视频", "音频", "录音", "录像", "会议", "演讲", "谁说了", "几点"]
IMAGE_WORDS = ["图", "表格", "图表", "柱状", "饼图", "趋势", "截图", "图片"]
FUZZY_WORDS = ["上次", "那个", "之前那个", "前面提到的", "刚才说的", "上面那个"]
CATEGORY_GROUPS = {"方法": "方法流程", "技术": "技术知识", "概念": "概念理论", "事实": "事件记录", "观点": "概念理论"}
OTHER_GROUP = "概念理论"
CATEGORY_WORDS = {
    "技术": ["技术", "算法", "编程", "代码", "架构", "系统", "API", "框架"],
    "概念理论": ["定义", "理论", "概念", "原理", "模型", "定理", "定律"],
    "事件记录": ["发生", "举办", "发布", "会议", "事件", "历史"],
    "人物关系": ["创始人", "CEO", "作者", "领导", "经理", "教授"],
    "组织信息": ["公司", "企业", "机构", "部门", "团队", "组织"],
    "方法流程": ["步骤", "方法", "流程", "指南", "实践", "策略"],
}
SOURCE_BONUS = {"PDF文档": 0.1, "Word文档": 0.05, "PPT演示": 0.03, "网页": -0.05, "图片": -0.1}
EXTRACTED_QUALITY = {"pdf": 0.85, "word": 0.75, "ppt": 0.65, "image": 0.55, "web": 0.45, "table": 0.70, "code": 0.75, "text": 0.50, "video": 0.65, "audio": 0.60}
EXTRACTED_SURE = ["研究表", "数据显", "证明", "官方", "权威"]
EXTRACTED_UNSURE = ["我认为", "我觉得", "可能", "也许", "据说"]
LANGUAGES = {
    "py": "python", "ipynb": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust",
    "cpp": "cpp", "hpp": "cpp", "c": "c", "h": "c", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala",
    "lua": "lua", "sh": "bash", "sql": "sql", "r": "r", "m": "matlab", "jl": "julia", "html": "html", "css": "css", "scss": "scss",
    "yaml": "yaml", "yml": "yaml", "json": "json", "xml": "xml", "toml": "toml", "ini": "ini",
}


def relation_type(label: Column) -> Column:
    return first_label(F.lower(label), RELATION_WORDS, "RELATED_TO")


def node_type(name: Column, given: Column | None = None) -> Column:
    found = first_label(F.lower(name), NODE_WORDS, "Entity")
    return found if given is None else F.coalesce(F.nullif(given, F.lit("")), found)


def source_type(source: Column) -> Column:
    """By a word anywhere in it, else by how it ends or begins."""
    ends = F.when(source.startswith("http"), "网页").otherwise("文本")
    for endings, label in reversed(SOURCE_ENDINGS):
        ends = F.when(reduce(lambda a, b: a | b, [source.endswith(e) for e in endings]), label).otherwise(ends)
    low = F.lower(source)
    for words, label in reversed(SOURCE_WORDS):
        ends = F.when(contains_any(low, words), label).otherwise(ends)
    return ends


def intent(query: Column) -> Column:
    """A struct of flags, the kind of content (the last rule that holds) and whether the question points back."""
    code, media, image = contains_any(F.lower(query), CODE_WORDS), contains_any(query, MEDIA_WORDS), contains_any(query, IMAGE_WORDS)
    return F.struct(
        F.when(contains_any(query, FUZZY_WORDS), "fuzzy_reference").otherwise("fact_query").alias("type"),
        code.alias("is_code_related"),
        contains_any(query, TIMELINE_WORDS).alias("is_timeline_related"),
        contains_any(query, COMPARISON_WORDS).alias("is_comparison"),
        contains_any(query, GRAPH_WORDS).alias("needs_graph_exploration"),
        F.when(image, "image_chart").when(media, "audiovisual").when(code, "code").otherwise("general").alias("content_type"),
    )


def category_group(category: Column) -> Column:
    out = F.lit(OTHER_GROUP)
    for k, v in CATEGORY_GROUPS.items():
        out = F.when(category == k, v).otherwise(out)
    return out


def suggestions(fact: Column, words: dict[str, list[str]] | None = None, most: int = 3) -> Column:
    """The categories whose words a text has, surest first, then in the order given: structs of name and confidence."""
    scored = F.array(*[F.struct((-F.least(F.lit(0.8), 0.4 + 0.15 * count_of(fact, w))).alias("c"), F.lit(k).alias("place"), F.lit(name).alias("name"), count_of(fact, w).alias("hits")) for k, (name, w) in enumerate((words or CATEGORY_WORDS).items())])
    best = F.slice(F.array_sort(F.filter(scored, lambda x: x["hits"] > 0)), 1, most)
    return F.transform(best, lambda x: F.struct(x["name"].alias("name"), F.round(-x["c"], 6).alias("confidence")))


def extracted_quality(kind: Column, text: Column) -> Column:
    base = F.lit(0.5)
    for k, v in EXTRACTED_QUALITY.items():
        base = F.when(kind == k, v).otherwise(base)
    q = base + F.when(contains_any(text, EXTRACTED_SURE), 0.08).otherwise(0.0) - F.when(contains_any(text, EXTRACTED_UNSURE), 0.05).otherwise(0.0)
    return F.least(F.greatest(q, F.lit(0.2)), F.lit(1.0))


def language(path: Column) -> Column:
    """By the part of the path after its last dot."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    ending = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return F.coalesce(F.try_element_at(known, ending), F.lit("unknown"))


def replaced(text: Column, terms: dict[str, str]) -> Column:
    """Each term put in place of its old form, in the order given."""
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), terms.items(), text)


def salvaged(text: Column, schema: str) -> Column:
    """JSON that may stand in a fence or among other words: the whole, else its outermost brackets, else its outermost braces."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), "^```[^\\n]*\\n", ""), "```$", ""))
    read = lambda s: F.from_json(s, schema, {"mode": "PERMISSIVE"})
    valid = lambda s: F.try_parse_json(s).isNotNull()
    brackets, braces = F.regexp_extract(bare, r"(?s)\[.*\]", 0), F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(valid(bare), read(bare)).when((brackets != "") & valid(brackets), read(brackets)).when((braces != "") & valid(braces), read(braces))
