"""Graph algorithms as iterative DataFrame programs.

Edges are ``src, dst`` and, where it matters, ``weight``. Each round is a join and a grouped reduction, its
result checkpointed, so plans do not grow and a lost executor costs one round.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import local
from .parts import Parts

#: Rounds whose results are kept apart before they are folded into one table.
FOLD = 8


def by_source(edges: DataFrame, *columns: str) -> DataFrame:
    """Edges kept by hash of their source and sorted by it, so that the join of every round finds them in place."""
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(edges.select("src", "dst", *columns).repartition(tasks, "src").sortWithinPartitions("src"))


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once; no self-loops."""
    one = edges.select("src", "dst").where("src <> dst")
    return one.unionAll(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct()


def bfs(edges: DataFrame, start: int, most: int = 1 << 30) -> DataFrame:
    """``id, depth`` along outgoing edges; nothing if the start is no node. A round writes its own front alone."""
    hop = by_source(edges.select("src", "dst").distinct())
    front = cut(nodes_of(edges).where(F.col("id") == start).withColumn("depth", F.lit(0).cast("bigint")))
    seen, n = [front], 0
    while not front.isEmpty() and n < most:
        n += 1
        if len(seen) > FOLD:
            seen = [cut(reduce(DataFrame.unionAll, seen))]
        known = reduce(DataFrame.unionAll, seen).select("id")
        near = hop.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().join(known, "id", "left_anti")
        front = cut(near.withColumn("depth", F.lit(n).cast("bigint")))
        seen.append(front)
    return reduce(DataFrame.unionAll, seen)


def sssp(edges: DataFrame, source: int, rounds: int = 1 << 30) -> DataFrame:
    """``id, distance, predecessor``: relaxation of the edges out of nodes that changed, to the fixpoint.

    Negative weights are allowed; ``rounds`` bounds the search where a negative cycle may be reachable. A round
    writes only what it improved; these parts are folded into one now and then.
    """
    hop = by_source(edges.select("src", "dst", "weight"), "weight")
    front = cut(nodes_of(edges).where(F.col("id") == source).select("id", F.lit(0.0).alias("distance"), F.lit(None).cast("bigint").alias("predecessor")))
    parts, n = [front], 0

    def best() -> DataFrame:
        least = reduce(DataFrame.unionAll, parts).groupBy("id").agg(F.min(F.struct("distance", "predecessor")).alias("o"))
        return least.select("id", "o.distance", "o.predecessor")

    while n < rounds and not front.isEmpty():
        n += 1
        if len(parts) > FOLD:
            parts = [cut(best())]
        offers = hop.join(front.select(F.col("id").alias("src"), "distance"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((F.col("distance") + F.col("weight")).alias("distance"), F.col("src").alias("predecessor"))).alias("o"))
        known = best().select("id", F.col("distance").alias("old"))
        front = cut(offers.join(known, "id", "left").where("old is null or o.distance < old").select("id", "o.distance", "o.predecessor"))
        parts.append(front)
    return best()


def bellman_ford(edges: DataFrame, source: int) -> tuple[DataFrame, bool]:
    """Distances after n - 1 rounds, and whether a further round would still improve one."""
    n = nodes_of(edges).count()
    best = sssp(edges, source, max(1, n - 1))
    again = best.join(edges, best["id"] == edges["src"]).select("dst", (F.col("distance") + F.col("weight")).alias("d"))
    better = again.join(best.select(F.col("id").alias("dst"), F.col("distance").alias("own")), "dst", "left").where("own is null or d < own - 1e-9")
    return best, not better.isEmpty()


def floyd_warshall(edges: DataFrame, most_nodes: int = 20_000) -> DataFrame:
    """``src, dst, distance`` of all pairs, by min-plus squaring. The result has n^2 rows, so n is checked first."""
    nodes = nodes_of(edges)
    if nodes.count() > most_nodes:
        raise ValueError(f"all pairs of more than {most_nodes} nodes")
    zero = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("distance"))
    best = cut(zero.unionAll(edges.select("src", "dst", F.col("weight").alias("distance"))).groupBy("src", "dst").agg(F.min("distance").alias("distance")))
    while True:
        right = best.select(F.col("src").alias("m"), F.col("dst").alias("e"), F.col("distance").alias("w"))
        via = best.join(right, best["dst"] == right["m"]).select("src", F.col("e").alias("dst"), (F.col("distance") + F.col("w")).alias("distance"))
        new = cut(via.groupBy("src", "dst").agg(F.min("distance").alias("distance")))
        moved = new.join(best.withColumnRenamed("distance", "old"), ["src", "dst"], "left").where("old is null or distance < old - 1e-12")
        done = moved.isEmpty() or not new.where("src = dst and distance < 0").isEmpty()
        best = new
        if done:
            return best


def degrees(nodes: DataFrame, edges: DataFrame, normalized: bool = False) -> DataFrame:
    """``id, in_degree, out_degree, total``; parallel edges count."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    n = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    out = nodes.select("id").join(n, "id", "left").select("id", F.coalesce("i", F.lit(0)).cast("bigint").alias("in_degree"), F.coalesce("o", F.lit(0)).cast("bigint").alias("out_degree"))
    out = out.withColumn("total", F.col("in_degree") + F.col("out_degree"))
    if normalized:
        m = max(1, nodes.count() - 1)
        out = out.select("id", *[(F.col(c) / F.lit(float(m))).alias(c) for c in ("in_degree", "out_degree", "total")])
    return out


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, max_iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """``id, score``. The mass of nodes without out-edges is spread evenly; parallel edges weigh.

    The edge table is reduced once to ``src, dst, share``, with a share of 0 from each node to itself so that every
    node gets a sum, and kept partitioned and sorted by source. A round is then one join without a shuffle of edges
    and one sum; one job gives its ranks, the largest move and the dangling mass. Ranks are held in memory and
    written every ``FOLD`` rounds, so a lost executor costs that many. Stops when no score moves by ``tolerance``.
    """
    n = nodes.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("score"))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    shares = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k")).join(out, "src").select("src", "dst", (F.col("k") / F.col("n")).alias("share"))
    arcs = by_source(shares.unionAll(nodes.select("id", "id", F.lit(0.0))), "share").persist()
    flows = out.select(F.col("src").alias("id"), F.lit(True).alias("flows"))
    ranks = cut(nodes.select("id").join(flows, "id", "left").select("id", F.coalesce("flows", F.lit(False)).alias("flows"), F.lit(1.0 / n).alias("score"), F.lit(0.0).alias("old")))
    lost, held = (ranks.where("not flows").count() / n), []
    for k in range(1, max_iterations + 1):
        base = (1.0 - damping) / n + damping * lost / n
        got = arcs.join(ranks.select(F.col("id").alias("src"), "score", "flows"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("got"), F.max(F.when(F.col("src") == F.col("dst"), F.struct("flows", "score"))).alias("own"))
        new = got.select("id", F.col("own.flows").alias("flows"), (F.lit(base) + F.lit(damping) * F.col("got")).alias("score"), F.col("own.score").alias("old"))
        new = cut(new) if k % FOLD == 0 else new.persist()
        facts = new.agg(F.max(F.abs(F.col("score") - F.col("old"))).alias("moved"), F.sum(F.when(~F.col("flows"), F.col("score")).otherwise(0.0)).alias("lost")).first()
        ranks, lost = new, facts["lost"]
        held.append(new)
        if facts["moved"] < tolerance:
            break
        for old in held[:-1] if k % FOLD == 0 else []:
            old.unpersist()
        held = held[-1:] if k % FOLD == 0 else held
    result = cut(ranks.select("id", "score"))
    for df in (arcs, *held):
        df.unpersist()
    return result


def strong_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``id, component`` (the smallest id in it).

    Nodes without an in- or out-edge left are components of their own and are trimmed. Of the rest each round
    spreads the least id forward; nodes that can also reach that id backward within its colour are a component.
    """
    rest = cut(nodes.select("id"))
    arcs = cut(edges.select("src", "dst").where("src <> dst").distinct())
    done: list[DataFrame] = []
    for _ in range(max_rounds):
        if rest.isEmpty():
            break
        live = rest.join(arcs.select(F.col("src").alias("id")), "id", "left_semi").join(arcs.select(F.col("dst").alias("id")), "id", "left_semi")
        live = cut(live)
        alone = rest.join(live, "id", "left_anti")
        if not alone.isEmpty():
            done.append(cut(alone.select("id", F.col("id").alias("component"))))
            rest = live
            arcs = cut(arcs.join(rest.select(F.col("id").alias("src")), "src", "left_semi").join(rest.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
            continue
        colour = cut(rest.select("id", F.col("id").alias("colour")))
        while True:
            low = arcs.join(colour, arcs["src"] == colour["id"]).groupBy("dst").agg(F.min("colour").alias("low"))
            new = cut(colour.join(low, colour["id"] == low["dst"], "left").select("id", F.least("colour", F.coalesce("low", "colour")).alias("colour"), (F.col("low") < F.col("colour")).alias("moved")))
            colour = new.select("id", "colour")
            if new.where("moved").isEmpty():
                break
        a, b = colour.select(F.col("id").alias("src"), F.col("colour").alias("ca")), colour.select(F.col("id").alias("dst"), F.col("colour").alias("cb"))
        inner = cut(arcs.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst"))
        found = cut(colour.where("id = colour"))
        front = found
        while not front.isEmpty():
            back = inner.join(front.select(F.col("id").alias("dst"), "colour"), "dst").select(F.col("src").alias("id"), "colour").distinct()
            front = cut(back.join(found, "id", "left_anti"))
            found = cut(found.unionAll(front))
        done.append(found.select("id", F.col("colour").alias("component")))
        rest = cut(rest.join(found, "id", "left_anti"))
        arcs = cut(arcs.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti"))
    return reduce(DataFrame.unionAll, done) if done else nodes.select("id", F.col("id").alias("component")).limit(0)


def topological_layers(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, bool]:
    """``id, layer`` by peeling nodes without in-edges, and whether all nodes could be peeled (no cycle).

    A node goes when as many of its in-edges have been met as it has. A round reads the edges out of the last layer
    and writes that layer and what it met; these parts are folded into one now and then.
    """
    arcs = by_source(edges.select("src", "dst").distinct())
    waits = cut(arcs.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("waits")))
    front = cut(nodes.select("id").join(waits, "id", "left_anti").withColumn("layer", F.lit(0).cast("bigint")))
    done, met, n, total, layer = [front], [], front.count(), 0, 0
    while True:
        total += n
        found = cut(arcs.join(front.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("met")))
        met.append(found)
        if len(met) > FOLD:
            met = [cut(reduce(DataFrame.unionAll, met).groupBy("id").agg(F.sum("met").alias("met")))]
            done = [cut(reduce(DataFrame.unionAll, done))]
        sums = reduce(DataFrame.unionAll, met).join(found.select("id"), "id", "left_semi").groupBy("id").agg(F.sum("met").alias("met"))
        layer += 1
        front = cut(sums.join(waits, "id").where("met = waits").select("id", F.lit(layer).cast("bigint").alias("layer")))
        n = front.count()
        if n == 0:
            break
        done.append(front)
    return reduce(DataFrame.unionAll, done), total == nodes.count()


def core_numbers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, core``: the largest k for which the node lies in a subgraph of degree k or more.

    Every node starts at its degree and takes, round after round, the largest h for which h of its neighbours are
    at h or more; this comes down to the core number for all k at once. Neighbours are counted by value first, a
    value above the node's own counts as the node's own, so a hub is a running count over few rows, not a list.
    """
    both = by_source(undirected(edges))
    value = both.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("h"))
    value = cut(value)
    down = Window.partitionBy("dst").orderBy(F.col("v").desc())
    while True:
        sent = both.join(value.select(F.col("id").alias("src"), "h"), "src").join(value.select(F.col("id").alias("dst"), F.col("h").alias("own")), "dst")
        counts = sent.groupBy("dst", "own", F.least("h", "own").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        upto = counts.select("dst", "own", F.least("v", F.sum("n").over(down)).alias("at"))
        new = cut(upto.groupBy(F.col("dst").alias("id"), "own").agg(F.max("at").alias("h")))
        value = new.select("id", "h")
        if new.where("h <> own").isEmpty():
            break
    return nodes.select("id").join(value, "id", "left").select("id", F.coalesce("h", F.lit(0)).cast("bigint").alias("core"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """``src, dst, weight`` of a minimum spanning forest by Boruvka's rounds; ties by ids.

    A round takes the least edge out of every component, then merges the components that these edges join.
    """
    from .components import connected_components

    one = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("weight").cast("double").alias("weight"))
    one = cut(one.groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    place = cut(nodes_of(one).withColumn("c", F.col("id")))
    chosen: list[DataFrame] = []
    while True:
        a, b = place.select(F.col("id").alias("src"), F.col("c").alias("ca")), place.select(F.col("id").alias("dst"), F.col("c").alias("cb"))
        across = one.join(a, "src").join(b, "dst").where("ca <> cb").select("ca", "cb", F.struct("weight", "src", "dst").alias("e"))
        across = cut(across)
        if across.isEmpty():
            break
        least = across.select("ca", "e").unionAll(across.select(F.col("cb").alias("ca"), "e")).groupBy("ca").agg(F.min("e").alias("e"))
        picked = cut(least.select("e.src", "e.dst", "e.weight").distinct())
        chosen.append(picked)
        merged = connected_components(picked.join(a, "src").join(b, "dst").select(F.col("ca").alias("src"), F.col("cb").alias("dst")))
        place = cut(place.join(merged.select(F.col("id").alias("c"), "component"), "c", "left").select("id", F.coalesce("component", "c").alias("c")))
    return reduce(DataFrame.unionAll, chosen) if chosen else one.limit(0)


def label_propagation(nodes: DataFrame, edges: DataFrame, max_iterations: int = 100) -> DataFrame:
    """``id, label``: each round takes the commonest label among neighbours in both directions, ties to the
    smallest. Rounds are synchronous; a node also counts itself once, which stops labels from swapping forever."""
    both = cut(edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).unionAll(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"))))
    labels = cut(nodes.select("id", F.col("id").alias("label")))
    for _ in range(max_iterations):
        votes = both.join(labels, both["dst"] == labels["id"]).groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select(F.col("src").alias("id"), F.col("b.label").alias("new"))
        found = cut(labels.join(best, "id").select("id", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("moved")))
        labels = found.select("id", "label")
        if found.where("moved").isEmpty():
            break
    return labels


def betweenness(nodes: DataFrame, parts: Parts, normalized: bool = True) -> DataFrame:
    """``id, score`` by Brandes' accumulation over all sources, along outgoing edges, unweighted. Normalised by
    2 / ((n-1)(n-2)); 0 for two nodes or fewer."""

    def work(n, a, b, sources):
        score = local.dependencies(a, b, n, sources)
        hit = np.flatnonzero(score)
        return hit, score[hit]

    n = nodes.count()
    scores = parts.search(local.TOGETHER, 4 * nodes.sparkSession.sparkContext.defaultParallelism, work).groupBy("id").agg(F.sum("score").alias("score"))
    factor = (2.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0) if normalized else 1.0
    return nodes.select("id").join(scores, "id", "left").select("id", (F.coalesce("score", F.lit(0.0)) * factor).alias("score"))


def closeness_by_parts(nodes: DataFrame, parts: Parts, wf_improved: bool = False) -> DataFrame:
    """As :func:`closeness`, with the edges of a part in a task and its sources dealt to tasks."""
    of = nodes.count()

    def work(n, a, b, sources):
        return sources, local.closeness(np.arange(n), a, b, wf_improved, sources, of)[1]

    scores = parts.search(64, 4 * nodes.sparkSession.sparkContext.defaultParallelism, work)
    return nodes.select("id").join(scores, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def closeness(nodes: DataFrame, edges: DataFrame, wf_improved: bool = False) -> DataFrame:
    """``id, score``: reached nodes over summed distance, along outgoing edges; ``wf_improved`` weighs by the
    share of nodes that are reached. One breadth-first search from all nodes: the frontier has a row for each
    source and node, so its size is the number of pairs that reach each other."""
    n = nodes.count()
    hop = by_source(edges.select("src", "dst").where("src <> dst").distinct())
    front = cut(nodes.select(F.col("id").alias("source"), F.col("id").alias("at")))
    seen, sums, depth = [front], [], 0
    while True:
        depth += 1
        if len(seen) > FOLD:
            seen = [cut(reduce(DataFrame.unionAll, seen))]
        near = hop.join(front.withColumnRenamed("at", "src"), "src").select("source", F.col("dst").alias("at")).distinct()
        front = cut(near.join(reduce(DataFrame.unionAll, seen), ["source", "at"], "left_anti"))
        if front.isEmpty():
            break
        seen.append(front)
        sums.append(front.groupBy("source").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * depth).alias("d")))
    if not sums:
        return nodes.select("id", F.lit(0.0).alias("score"))
    total = reduce(DataFrame.unionAll, sums).groupBy(F.col("source").alias("id")).agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    score = F.col("n") / F.col("d") * (F.col("n") / (n - 1) if wf_improved and n > 1 else F.lit(1.0))
    return nodes.select("id").join(total, "id", "left").select("id", F.coalesce(score, F.lit(0.0)).alias("score"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Of a partition ``id, label``; edges are undirected with weight 1."""
    m = edges.count()
    if m == 0:
        return 0.0
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("la")), labels.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
    inside = edges.join(a, "src").join(b, "dst").where("la = lb").count()
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).join(labels, "id").groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    return inside / m - resolution * (ends.agg(F.sum(F.pow(F.col("k") / (2.0 * m), 2))).first()[0] or 0.0)
