"""Graph queries over edges (src, dst, rel, conf)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noema.operators.blocks import small


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "rel", "conf").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", "conf"))


def adjacent(edges: DataFrame) -> DataFrame:
    """Each edge (src, dst, rel, conf) from both ends, with the way it points (forward) and a name (eid); edges alike are named apart. What has names already, such as a kept graph, is returned as it is."""
    if "eid" in edges.columns:
        return edges
    rank = F.row_number().over(Window.partitionBy("src", "dst", "rel").orderBy("conf"))
    e = edges.withColumn("eid", F.concat_ws("|", "src", "rel", "dst", rank.cast("string")))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", "conf", F.lit(False).alias("forward"), "eid")
    return e.select("src", "dst", "rel", "conf", F.lit(True).alias("forward"), "eid").unionByName(back)


def degrees(edges: DataFrame) -> DataFrame:
    return adjacent(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    return adjacent(edges).where(F.col("src") == node).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("edges"), F.avg("conf").alias("avg_conf"))


def explore(edges: DataFrame, node: str, hops: int) -> DataFrame:
    """Nodes within ``hops`` of the node, with their distance. Only what the frontier touches is read; it is sent to the edges while it is small."""
    near = adjacent(edges)
    seen = near.sparkSession.createDataFrame([(node, 0)], "node string, hops int")
    front = None
    for h in range(1, hops + 1):
        step = near.where(F.col("src") == node) if front is None else near.join(small(front), near.src == F.col("node"), "left_semi")
        front = step.select(F.col("dst").alias("node")).distinct()
        seen = seen.unionByName(front.withColumn("hops", F.lit(h)))
    return seen.groupBy("node").agg(F.min("hops").alias("hops"))


def paths(edges: DataFrame, start: str, end: str, hops: int, limit: int = 20) -> DataFrame:
    """Undirected paths that use no edge twice: length, mean confidence (3 places), route; shortest first.

    They are walked from both ends and met in the middle, so the rows grow with
    half the hops.
    """
    two = adjacent(edges).select(F.col("src").alias("a"), F.col("dst").alias("b"), "conf", "eid")

    def walks(node: str, steps: int) -> list[DataFrame]:
        out = [two.sparkSession.createDataFrame([(node, [], [node], 0.0)], "at string, used array<string>, route array<string>, total double")]
        for k in range(steps):
            now = two.where(F.col("a") == node).select(F.col("b").alias("at"), F.array("eid").alias("used"), F.array("a", "b").alias("route"), F.col("conf").alias("total")) if not k else None
            if now is None:
                now = two.join(small(out[-1]), F.col("a") == F.col("at")).where(~F.array_contains("used", F.col("eid"))).select(F.col("b").alias("at"), F.concat("used", F.array("eid")).alias("used"), F.concat("route", F.array("b")).alias("route"), (F.col("total") + F.col("conf")).alias("total"))
            out.append(now)
        return out

    ahead, back = walks(start, (hops + 1) // 2), walks(end, hops // 2)
    found = None
    for n in range(1, hops + 1):
        first, last = ahead[(n + 1) // 2], back[n // 2].select(F.col("at").alias("meet"), F.col("used").alias("used2"), F.col("route").alias("route2"), F.col("total").alias("total2"))
        met = first.join(last, F.col("at") == F.col("meet")).where(~F.arrays_overlap("used", "used2"))
        route = F.concat("route", F.slice(F.reverse("route2"), 2, n + 1))
        one = met.select(F.lit(n).alias("length"), F.round((F.col("total") + F.col("total2")) / n + 1e-9, 3).alias("weight"), F.array_join(route, ">").alias("route"))
        found = one if found is None else found.unionByName(one)
    return found.orderBy("length", F.desc("weight"), "route").limit(limit)


def infer(edges: DataFrame, first: str, second: list[str], conf: float) -> DataFrame:
    """New edges a-r->c from a-first->b, b-r->c with r among ``second``, where a has no such edge to c yet."""
    a = edges.where(F.col("rel") == first).select("src", F.col("dst").alias("mid"))
    b = edges.where(F.col("rel").isin(second)).select(F.col("src").alias("mid"), "dst", "rel")
    new = a.join(b, "mid").where("src <> dst").select("src", "dst", "rel").distinct()
    return new.join(edges.select("src", "dst", "rel"), ["src", "dst", "rel"], "left_anti").withColumn("conf", F.lit(conf))


def cycles(edges: DataFrame, rel: str, longest: int) -> DataFrame:
    """Directed cycles of one relation: start, length, route, one row for each node a cycle passes."""
    e = edges.where(F.col("rel") == rel).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    now = e.select(F.col("a").alias("start"), F.col("b").alias("at"), F.array("a").alias("route"))
    out = now.where("start = at")
    for _ in range(1, longest):
        now = now.where("start <> at").join(e, now.at == e.a).where(~F.array_contains("route", F.col("at"))).select("start", F.col("b").alias("at"), F.concat("route", F.array("at")).alias("route"))
        out = out.unionByName(now.where("start = at"))
    return out.select("start", F.size("route").alias("length"), F.array_join("route", ">").alias("route"))


def propagate(edges: DataFrame, rounds: int = 3, damping: float = 0.85) -> DataFrame:
    """Synchronous confidence propagation along edges: (1 - d) 0.5 + d mean of in-neighbours; 0.5 at first and without any."""
    nodes = both_ways(edges).select(F.col("src").alias("node")).distinct()
    now = nodes.select("node", F.lit(0.5).alias("c"))
    links = edges.select("src", "dst")
    for _ in range(rounds):
        sent = now.join(links, now.node == links.src).groupBy(F.col("dst").alias("node")).agg(F.avg("c").alias("m"))
        now = nodes.join(sent, "node", "left").select("node", (F.lit((1 - damping) * 0.5) + damping * F.coalesce("m", F.lit(0.5))).alias("c"))
    return now


def label_propagation(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Synchronous communities: each node takes its neighbours' most frequent label, the smallest among equals."""
    two = both_ways(edges).select("src", "dst")
    now = two.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("label"))
    for _ in range(rounds):
        votes = two.join(now, two.src == now.node).groupBy(F.col("dst").alias("node"), "label").agg(F.count("*").alias("n"))
        now = votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best")).select("node", F.col("best.label").alias("label"))
    return now


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(both_ways(edges).select(F.col("src").alias("node")), "node", "left_anti")


def node_type(name) -> F.Column:
    from noema.functions.text import first_label

    rules = [(["event", "incident", "meeting"], "Event"), (["concept", "theory", "principle"], "Concept"), (["document", "paper", "report", ".pdf"], "Document")]
    return first_label(F.lower(name), rules, "Entity")


def fact_consistency(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """For each fact (id, node: one row an entity) the mean over its entities of mean confidence times a sigmoid of the degree; 0.5 where the graph has none."""
    g = adjacent(edges).groupBy(F.col("src").alias("node")).agg((F.avg("conf") / (1 + F.exp(-0.5 * (F.count("*") - 3)))).alias("c"))
    return facts.join(g, "node", "left").groupBy("id").agg(F.coalesce(F.avg("c"), F.lit(0.5)).alias("consistency"))
