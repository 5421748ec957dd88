"""Graph algorithms over edge tables (u, v), as rounds of joins and aggregations.

Each round is written to the shared folder, so a lost executor costs one round; only counts and
scalars reach the driver.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligature.session import materialized


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank) after a fixed number of rounds over directed edges; the mass of nodes without
    out-edges is spread evenly."""
    edges = edges.select("u", "v")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    out = edges.groupBy("u").agg(F.count("*").alias("out"))
    links = materialized(edges.join(out, "u"), "links")
    nodes = materialized(nodes.join(out.withColumnRenamed("u", "node"), "node", "left"), "nodes")
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0) / n)
    for _ in range(rounds):
        loose = ranks.where("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        flow = links.join(ranks.select(F.col("node").alias("u"), "rank"), "u").groupBy(F.col("v").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("flow"))
        new = (1 - damping) / n + damping * (F.coalesce("flow", F.lit(0.0)) + F.col("loose") / n)
        ranks = materialized(nodes.join(flow, "node", "left").crossJoin(F.broadcast(loose)).select("node", "out", new.alias("rank")), "ranks")
    return ranks.select("node", "rank")


def pagerank_converged(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """(node, rank) over directed edges (u, v), parallel ones each counting: rounds go on until the ranks
    of n nodes change by less than n times the tolerance in sum. No edges give no rows."""
    links = edges.groupBy("u", "v").agg(F.count("*").alias("n"))
    out = links.groupBy("u").agg(F.sum("n").alias("out"))
    links = materialized(links.join(out, "u").select("u", "v", (F.col("n") / F.col("out")).alias("share")), "links")
    nodes = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    nodes = materialized(nodes.join(links.select(F.col("u").alias("node"), F.lit(True).alias("leads")).distinct(), "node", "left"), "nodes")
    n = nodes.count()
    ranks = nodes.select("node", "leads", F.lit(1.0 / max(n, 1)).alias("rank"))
    for _ in range(most):
        loose = ranks.where("leads is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        flow = links.join(ranks.select(F.col("node").alias("u"), "rank"), "u").groupBy(F.col("v").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        new = (1 - damping) / n + damping * (F.coalesce("flow", F.lit(0.0)) + F.col("loose") / n) if n else F.lit(0.0)
        ranks = materialized(ranks.join(flow, "node", "left").crossJoin(F.broadcast(loose)).select("node", "leads", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")), "ranks")
        if (ranks.agg(F.sum("change")).first()[0] or 0.0) < n * tolerance:
            break
    return ranks.select("node", "rank")


def closeness_inward(edges: DataFrame) -> DataFrame:
    """(node, closeness) of every node over the directed paths that lead to it, scaled by the share of
    nodes that reach it; 0 where none does."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    nodes = materialized(both_ways(edges).select(F.col("u").alias("node")).distinct(), "nodes")
    n = nodes.count()
    found = distances(back).where("distance > 0").groupBy(F.col("source").alias("node")).agg(F.count("*").alias("r"), F.sum("distance").alias("d"))
    value = F.col("r") / F.col("d") * F.col("r") / F.lit(max(n - 1.0, 1.0))
    return nodes.join(found, "node", "left").select("node", F.coalesce(value, F.lit(0.0)).alias("closeness"))


def betweenness_directed(edges: DataFrame, block: int = 4096) -> DataFrame:
    """(node, betweenness) of every node over directed shortest paths, as a share of the ordered pairs of
    other nodes."""
    nodes = materialized(both_ways(edges).select(F.col("u").alias("node")).distinct(), "nodes")
    n = nodes.count()
    found = betweenness(edges, block=block, directed=True)
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return nodes.join(found, "node", "left").select("node", (F.coalesce("betweenness", F.lit(0.0)) * scale).alias("betweenness"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each can reach, by hooking and pointer jumping."""
    links = materialized(both_ways(edges), "links")
    labels = materialized(links.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("component")), "labels")
    while True:
        seen = links.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("seen"))
        hooks = materialized(labels.join(seen, "node").where("seen < component").groupBy(F.col("component").alias("old")).agg(F.min("seen").alias("new")), "hooks")
        if hooks.isEmpty():
            return labels
        up = hooks.select(F.col("old").alias("new"), F.col("new").alias("next"))
        hooks = hooks.join(up, "new", "left").select("old", F.coalesce("next", "new").alias("new"))
        labels = materialized(labels.join(hooks, labels.component == hooks.old, "left").select("node", F.coalesce("new", "component").alias("component")), "labels")


def distances(edges: DataFrame, sources: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(source, node, distance): breadth-first levels over directed edges from each row of
    ``sources`` (source), or from every node; until no node is new, or at most ``depth`` steps."""
    links = materialized(edges.select("u", "v").distinct(), "links")
    if sources is None:
        sources = both_ways(links).select(F.col("u").alias("source")).distinct()
    known = materialized(sources.select("source", F.col("source").alias("node"), F.lit(0).alias("distance")), "known")
    front = known
    for step in count(1) if depth is None else range(1, depth + 1):
        reach = front.join(links, front.node == links.u).select("source", F.col("v").alias("node")).distinct()
        front = materialized(reach.join(known.select("source", "node"), ["source", "node"], "left_anti").withColumn("distance", F.lit(step)), "front")
        if front.isEmpty():
            break
        known = known.union(front)
    return known


def closeness(edges: DataFrame, sources: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(node, closeness) of each source, or of every node, over undirected edges, scaled by the share
    it reaches."""
    links = both_ways(edges)
    n = links.select("u").distinct().count()
    found = distances(links, sources, depth).where("distance > 0").groupBy("source").agg(F.count("*").alias("r"), F.sum("distance").alias("d"))
    return found.select(F.col("source").alias("node"), (F.col("r") / F.col("d") * F.col("r") / (n - 1.0)).alias("closeness"))


def simple_paths(edges: DataFrame, start: int, end: int, cutoff: int) -> DataFrame:
    """(path): all simple directed paths of at most ``cutoff`` edges."""
    links = materialized(edges.select("u", "v").distinct(), "links")
    paths = links.sparkSession.createDataFrame([([start],)], "path array<long>")
    found = None
    for _ in range(cutoff):
        last = F.element_at("path", -1)
        step = paths.join(links, last == links.u).where(~F.array_contains("path", F.col("v"))).select(F.array_append("path", F.col("v")).alias("path"))
        step = materialized(step, "paths")
        done = step.where(F.element_at("path", -1) == end)
        found = done if found is None else found.union(done)
        paths = step.where(F.element_at("path", -1) != end)
    return found


def betweenness(edges: DataFrame, sources: DataFrame | None = None, depth: int | None = None, block: int = 4096, directed: bool = False) -> DataFrame:
    """(node, betweenness): shortest paths from each source, or from every node, that pass a node, of
    any length or at most ``depth`` steps. Sources go in blocks of about ``block``, whose sums add up."""
    links = materialized(edges.select("u", "v").distinct() if directed else both_ways(edges), "links")
    if sources is None:
        sources = links.select(F.col("u").alias("source")).distinct()
    sources = materialized(sources.select("source"), "sources")
    blocks = max(1, -(-sources.count() // block))
    parts = [_dependencies(links, sources.where(F.pmod(F.xxhash64("source"), F.lit(blocks)) == i), depth) for i in range(blocks)]
    return reduce(DataFrame.union, parts).groupBy("node").agg(F.sum("betweenness").alias("betweenness"))


def _dependencies(links: DataFrame, sources: DataFrame, depth: int | None) -> DataFrame:
    """(node, betweenness) from ``sources``, by Brandes' counts: shortest-path counts level by level
    outwards, then dependencies level by level inwards."""
    front = materialized(sources.select("source", F.col("source").alias("node"), F.lit(0).alias("level"), F.lit(1.0).alias("paths")), "front")
    levels = [front]
    known = front.select("source", "node")
    for level in count(1) if depth is None else range(1, depth + 1):
        reach = front.join(links, front.node == links.u).groupBy("source", F.col("v").alias("node")).agg(F.sum("paths").alias("paths"))
        front = materialized(reach.join(known, ["source", "node"], "left_anti").select("source", "node", F.lit(level).alias("level"), "paths"), "front")
        if front.isEmpty():
            break
        levels.append(front)
        known = known.union(front.select("source", "node"))
    total = below = None
    for front in reversed(levels[1:]):
        own = front.withColumn("carried", F.lit(0.0)) if below is None else front.join(below, ["source", "node"], "left").select("source", "node", "level", "paths", F.coalesce("carried", F.lit(0.0)).alias("carried"))
        own = materialized(own, "own")
        total = own if total is None else total.union(own)
        upper = levels[[i for i, f in enumerate(levels) if f is front][0] - 1]
        x = own.select("source", F.col("node").alias("w"), F.col("paths").alias("paths_w"), "carried").join(links.select(F.col("v").alias("w"), F.col("u").alias("node")), "w")
        below = x.join(upper.select("source", "node", "paths"), ["source", "node"]).groupBy("source", "node").agg(F.sum(F.col("paths") / F.col("paths_w") * (1 + F.col("carried"))).alias("carried"))
    if total is None:
        return sources.select(F.col("source").alias("node"), F.lit(0.0).alias("betweenness")).limit(0)
    return materialized(total.groupBy("node").agg(F.sum("carried").alias("betweenness")), "betweenness")


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community): label propagation; each round a node takes its neighbours' most frequent
    label, the smallest of equals, alternating between even and odd nodes so that none oscillate."""
    links = materialized(both_ways(edges), "links")
    labels = materialized(links.select(F.col("u").alias("node")).distinct().withColumn("community", F.col("node")), "labels")
    for i in range(2 * rounds):
        votes = links.join(labels.select(F.col("node").alias("v"), "community"), "v").groupBy(F.col("u").alias("node"), "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("node").agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("best"))
        labels = materialized(labels.join(best, "node").select("node", F.when(F.col("node") % 2 == i % 2, F.col("best")).otherwise(F.col("community")).alias("community")), "labels")
    return labels


def walks(edges: DataFrame, length: int, per_node: int, seed: int = 42) -> DataFrame:
    """(walk, start, path): first-order random walks; each step's choice is a hash of walk and step."""
    ordered = both_ways(edges).groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("next"))
    ordered = materialized(ordered, "next")
    paths = ordered.select(F.col("u").alias("start")).crossJoin(F.broadcast(ordered.sparkSession.range(per_node).withColumnRenamed("id", "walk"))).withColumn("path", F.array("start"))
    for step in range(length - 1):
        joined = paths.join(ordered, F.element_at("path", -1) == ordered.u)
        choice = F.pmod(F.xxhash64("start", "walk", F.lit(step), F.lit(seed)), F.size("next")).cast("int")
        paths = joined.select("walk", "start", F.array_append("path", F.get("next", choice)).alias("path"))
        if step % 5 == 4:
            paths = materialized(paths, "walks")
    return paths


def node2vec_walks(edges: DataFrame, p: float = 1.0, q: float = 1.0, length: int = 80, per_node: int = 10, seed: int = 42) -> DataFrame:
    """(walk, start, path): second-order random walks. The next node weighs 1/p if it is the one before,
    1 if that is its neighbour, else 1/q; choices are hashes of walk and step. A row holds the
    neighbours of one node at a time, and steps are written every few rounds."""
    ordered = materialized(both_ways(edges).groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("next")), "next")
    numbers = ordered.sparkSession.range(per_node).withColumnRenamed("id", "walk")
    paths = ordered.select(F.col("u").alias("start")).crossJoin(F.broadcast(numbers))
    paths = paths.withColumns({"path": F.array("start"), "near": F.array().cast("array<bigint>")})
    for step in range(length - 1):
        joined = paths.join(ordered, F.element_at("path", -1) == ordered.u)
        if p == q == 1.0:
            place = F.pmod(F.xxhash64("start", "walk", F.lit(step), F.lit(seed)), F.size("next")).cast("int")
            chosen = F.get("next", place)
        else:
            share = F.pmod(F.xxhash64("start", "walk", F.lit(step), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
            joined = joined.withColumn("before", F.try_element_at("path", F.lit(-2)))
            joined = joined.withColumn("weights", F.transform("next", lambda x: F.when(F.col("before").isNull(), 1.0).when(x == F.col("before"), 1.0 / p).when(F.array_contains("near", x), 1.0).otherwise(1.0 / q)))
            joined = joined.withColumn("goal", share * F.aggregate("weights", F.lit(0.0), lambda a, w: a + w))
            start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"))
            found = F.aggregate("weights", start, lambda a, w: F.struct((a["sum"] + w).alias("sum"), F.when(a["sum"] + w <= F.col("goal"), a["at"] + 1).otherwise(a["at"]).alias("at")))
            chosen = F.get("next", F.least(found["at"], F.size("next") - 1))
        paths = joined.select("walk", "start", F.array_append("path", chosen).alias("path"), F.col("next").alias("near"))
        if step % 8 == 7:
            paths = materialized(paths, "walks")
    return paths.select("walk", "start", "path")
