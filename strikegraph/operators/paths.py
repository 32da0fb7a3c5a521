"""Paths between targets and contexts, and from targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikegraph.functions.columns import DECAYS, reverse_etypes, rounded, signature
from strikegraph.operators.graph import KnowledgeGraph, follow
from strikegraph.sources.shared import kept


def start(queries: DataFrame) -> DataFrame:
    return queries.select("qid", "target", "context", F.array("target").alias("nodes"), F.array().cast("array<int>").alias("etypes"))


def expand(kg: KnowledgeGraph, frontier: DataFrame, inner: DataFrame | None = None, keep: Column | None = None) -> DataFrame:
    """One hop from the last node of each of ``frontier(qid, target, context, nodes, etypes)``, without repeated nodes.

    ``inner(context, nid)`` restricts where a hop may end; ``keep`` is a further predicate on the hop's columns.
    """
    out = follow(kg, frontier.withColumn("src", F.element_at("nodes", -1))).where(~F.array_contains("nodes", F.col("dst")))
    if keep is not None:
        out = out.where(keep)
    if inner is not None:
        out = out.join(inner.select("context", F.col("nid").alias("dst")), ["context", "dst"], "left_semi")
    return out.select("qid", "target", "context", F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("etypes", F.array("etype")).alias("etypes"))


def inner_nodes(kg: KnowledgeGraph, rel: DataFrame) -> DataFrame:
    """``(context, nid)``: relevant nodes with a type, which may stand inside a path."""
    return rel.select("context", "nid").join(kg.node_types.select("nid").distinct(), "nid", "left_semi")


def paths_between(kg: KnowledgeGraph, queries: DataFrame, rel: DataFrame, most: int = 4, least: int = 2, enumeration: str = "bidirectional") -> DataFrame:
    """``(qid, target, context, nodes, etypes)``: simple paths of ``least`` to ``most`` nodes, inner nodes typed and relevant.

    ``bidirectional``: half the hops are walked from the target, half from the context, and the halves meet in an
    equi-join; ``reverse``: all hops but one are walked from the context; ``forward``: all from the target.
    """
    inner = inner_nodes(kg, rel).transform(kept)
    hops = most - 1
    ahead = hops if enumeration == "forward" else min(1, hops) if enumeration == "reverse" else -(-hops // 2)
    stay = F.col("dst") != F.col("context")
    halves = {0: start(queries)}
    if enumeration == "forward":
        out = []
        for k in range(1, hops + 1):
            end = expand(kg, halves[k - 1], None, F.col("dst") == F.col("context"))
            out.append(end)
            if k < hops:
                halves[k] = expand(kg, halves[k - 1], inner, stay)
        return reduce(DataFrame.unionByName, out[least - 2 :])
    for k in range(1, ahead):
        halves[k] = expand(kg, halves[k - 1], inner, stay).transform(kept)
    # Walked once for a context, however many queries have it; what leads back to a query's target goes where the halves meet.
    once = queries.select("context").distinct().select(F.lit(0).alias("qid"), F.col("context").alias("target"), "context")
    back = {0: start(once)}
    behind = hops - ahead
    for k in range(1, behind + 1):
        back[k] = expand(kg, back[k - 1], inner).transform(kept)
    out = []
    for n in range(least - 1, hops + 1):
        b = min(behind, n - 1)
        a = n - b
        head = expand(kg, halves[a - 1], None)
        tail = back[b].select("context", F.element_at("nodes", -1).alias("meet"), F.reverse("nodes").alias("rest"), reverse_etypes("etypes").alias("rest_etypes"))
        met = head.withColumn("meet", F.element_at("nodes", -1)).join(tail, ["context", "meet"])
        met = met.select("qid", "target", "context", F.concat("nodes", F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0)))).alias("nodes"), F.concat("etypes", "rest_etypes").alias("etypes"))
        out.append(met.where(F.size(F.array_distinct("nodes")) == F.size("nodes")))
    return reduce(DataFrame.unionByName, out)


def paths_from(kg: KnowledgeGraph, queries: DataFrame, hops: int) -> DataFrame:
    """``(qid, target, context, nodes, etypes)``: all simple paths of 1 to ``hops`` edges from the targets, wherever they end."""
    step, out = start(queries), []
    for _ in range(hops):
        step = expand(kg, step)
        out.append(step)
    return reduce(DataFrame.unionByName, out)


def simple_path_counts(kg: KnowledgeGraph, queries: DataFrame, hops: int) -> DataFrame:
    """``(qid, etypes, end, n_paths)``: how many simple paths of 1 to ``hops`` edges, 3 at most, lead from the target to an end by each edge-type sequence.

    No path is listed. The last edge is counted by sums over the nodes before it, less the paths that it would lead back to a node
    of theirs.
    """
    if not 1 <= hops <= 3:
        raise ValueError("simple paths are counted up to three edges")
    first = follow(kg, queries.select("qid", "target", F.col("target").alias("src"))).select("qid", "target", F.array("etype").alias("etypes"), F.col("dst").alias("end"))
    out = [first.groupBy("qid", "etypes", "end").agg(F.count("*").alias("n_paths"))]
    grown = lambda step, *more: step.select("qid", "target", F.concat("etypes", F.array("etype")).alias("etypes"), F.col("dst").alias("end"), *more)
    if hops > 1:
        second = grown(follow(kg, first.withColumnRenamed("end", "src")).where("dst <> target"), F.col("src").alias("came")).transform(kept)
        out.append(second.groupBy("qid", "etypes", "end").agg(F.count("*").alias("n_paths")))
    if hops > 2:
        sums = second.groupBy("qid", "target", "etypes", F.col("end").alias("src")).agg(F.count("*").alias("n"))
        ahead = grown(follow(kg, sums).where("dst <> target"), "n")
        back = grown(second.withColumnRenamed("end", "src").join(kg.edges.withColumn("came", F.col("dst")), ["src", "came"]), F.lit(-1).cast("long").alias("n"))
        out.append(ahead.unionByName(back).groupBy("qid", "etypes", "end").agg(F.sum("n").alias("n_paths")).where("n_paths > 0"))
    return reduce(DataFrame.unionByName, out)


def path_scores(paths: DataFrame, rel: DataFrame, own_score: bool = True, whole: bool = True) -> DataFrame:
    """The paths with ``path_score``: the least of ``score(node) * exp(-position)``, positions from the target.

    ``own_score``: the target counts; else it counts as 1. ``whole``: the context counts too. Paths with a node without a
    score, where it counts, get none and are dropped.
    """
    at = paths.withColumn("_path", signature("nodes")).select("*", F.posexplode("nodes").alias("_pos", "nid"))
    decays = F.array(*map(F.lit, DECAYS))
    counted = at.where(F.lit(True) if own_score else F.col("_pos") > 0).where(F.lit(True) if whole else F.col("_pos") < F.size("nodes") - 1)
    scored = counted.join(rel, ["context", "nid"], "left").groupBy("qid", "target", "context", "nodes", "etypes").agg(F.min(F.coalesce("score", F.lit(0.0)) * F.element_at(decays, F.col("_pos") + 1)).alias("path_score"))
    if not own_score and not whole:
        scored = paths.join(scored, ["qid", "target", "context", "nodes", "etypes"], "left").withColumn("path_score", F.coalesce("path_score", F.lit(1.0)))
    return scored.withColumn("path_score", F.round("path_score", 12)).where("path_score > 0")


def reverse_index(kg: KnowledgeGraph, queries: DataFrame, rel: DataFrame, hops: int = 2) -> DataFrame:
    """``(qid, nid, etypes, score)``: for nodes up to ``hops`` edges from the context, each edge sequence that leads to it with its best score.

    The score starts at the context's own and shrinks by e a hop, never above a node's own.
    """
    inner = rel.select("context", F.col("nid").alias("dst"), "score")
    step = queries.select("qid", "target", "context", F.col("context").alias("nid"), F.array().cast("array<int>").alias("etypes")).join(rel, ["context", "nid"])
    out = []
    for _ in range(hops):
        grown = step.select("qid", "target", "context", F.col("nid").alias("src"), "etypes", F.col("score").alias("before")).transform(lambda rows: follow(kg, rows)).where("dst <> target and dst <> context")
        grown = grown.join(inner, ["context", "dst"]).select("qid", "target", "context", F.col("dst").alias("nid"), F.concat(F.array(F.col("etype").bitwiseXOR(1)), "etypes").alias("etypes"), F.least(F.col("before") * DECAYS[1], "score").alias("score"))
        step = grown.groupBy("qid", "target", "context", "nid", "etypes").agg(F.max("score").alias("score"))
        out.append(step)
    return reduce(DataFrame.unionByName, out).select("qid", "nid", "etypes", F.round("score", 12).alias("score"))


def best_paths(kg: KnowledgeGraph, queries: DataFrame, rel: DataFrame, k: int, most: int = 4, least: int = 2, first: int | None = None) -> DataFrame:
    """``(qid, target, context, nodes, etypes, path_score, rank)``: the ``k`` best of ``paths_between`` by ``path_scores``; ties by the path.

    An index grown from the context tells for each node and number of edges the best score of a way there. A walk from the target
    only goes where the index has a way of the length that is left, and no further once the least of its score so far and
    the index's falls below the ``k``-th best path known. That bound comes from a first wave of the ``first`` best first steps
    (by default ``2 * k``).
    """
    own = queries.join(rel.select("context", F.col("nid").alias("target"), F.col("score").alias("bound")), ["context", "target"]).transform(kept)
    at_context = queries.join(rel.where("nid = context"), "context").select("qid", "nid", F.lit(0).alias("left"), F.col("score").alias("best"))
    index = reverse_index(kg, queries, rel, most - 2).select("qid", "nid", F.size("etypes").alias("left"), "score").groupBy("qid", "nid", "left").agg(F.max("score").alias("best"))
    index = index.unionByName(at_context).transform(kept)
    inner = inner_nodes(kg, rel).select("context", F.col("nid").alias("dst")).transform(kept)
    decays = F.array(*map(F.lit, DECAYS))

    def further(step: DataFrame) -> DataFrame:
        """Steps ``(..., nodes, etypes, bound, dst, etype, left)`` to where the index has a way of ``left`` edges, with their new bounds."""
        there = step.join(index.withColumnRenamed("nid", "dst"), ["qid", "dst", "left"])
        there = there.where("left = 0").unionByName(there.where("left > 0").join(inner, ["context", "dst"], "left_semi").select(there.columns))
        bound = F.least("bound", F.col("best") * F.element_at(decays, F.size("nodes") + 1))
        return there.select("qid", "target", "context", F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("etypes", F.array("etype")).alias("etypes"), "left", bound.alias("bound"))

    ways = F.explode(F.sequence(F.lit(least - 2), F.lit(most - 2))).alias("left")
    begun = further(own.select("*", F.col("target").alias("src"), F.array("target").alias("nodes"), F.array().cast("array<int>").alias("etypes"), ways).transform(lambda rows: follow(kg, rows))).transform(kept)

    def walked(frontier: DataFrame, kth: DataFrame | None) -> DataFrame:
        done = [frontier.where("left = 0")]
        for _ in range(most - 2):
            step = follow(kg, frontier.where("left > 0").withColumn("src", F.element_at("nodes", -1))).where(~F.array_contains("nodes", F.col("dst"))).withColumn("left", F.col("left") - 1)
            frontier = further(step)
            frontier = (frontier.join(kth, "qid", "left").where("kth is null or bound + 2e-10 >= kth").drop("kth") if kth is not None else frontier).transform(kept)
            done.append(frontier.where("left = 0"))
        found = reduce(DataFrame.unionByName, done).select("qid", "target", "context", "nodes", "etypes")
        return path_scores(found, rel).transform(kept)

    from strikegraph.operators.relevance import ranked

    best = lambda df: ranked(df, ["qid"], F.desc("path_score"), signature("nodes"), signature("etypes")).where(F.col("rank") <= k)
    placed = ranked(begun, ["qid"], F.desc("bound"), signature("nodes"), signature("etypes"), "left").transform(kept)
    first = first or 2 * k
    found = walked(placed.where(F.col("rank") <= first).drop("rank"), None)
    kth = best(found).groupBy("qid").agg(F.count("*").alias("n"), F.min("path_score").alias("kth")).where(F.col("n") >= k).select("qid", "kth").transform(kept)
    rest = placed.where(F.col("rank") > first).drop("rank").join(kth, "qid", "left").where("kth is null or bound + 2e-10 >= kth").drop("kth").transform(kept)
    return best(found if rest.isEmpty() else found.unionByName(walked(rest, kth)))


def one_hop_peers(kg: KnowledgeGraph, queries: DataFrame, first_value_only: bool = False) -> DataFrame:
    """``(qid, etype, value, nid)``: nodes that share an edge type and its value with the target, the target included."""
    own = queries.select("qid", F.col("target").alias("src")).join(kg.edges, "src").select("qid", "etype", F.col("dst").alias("value"))
    if first_value_only:
        from strikegraph.operators.graph import first_values

        own = own.join(queries.join(first_values(kg.edges), F.col("target") == F.col("src")).select("qid", "etype", "value"), ["qid", "etype", "value"], "left_semi")
    return own.join(kg.edges.select("etype", F.col("dst").alias("value"), F.col("src").alias("nid")), ["etype", "value"]).select("qid", "etype", "value", "nid")


def paths_by_mean_relevance(paths: DataFrame, rel: DataFrame, k: int) -> DataFrame:
    """The ``k`` paths of each query with the highest mean score of their nodes; ties by the path as text."""
    from strikegraph.operators.relevance import ranked

    at = paths.withColumn("path", signature("nodes")).withColumn("seq", signature("etypes")).select("qid", "context", "path", "seq", F.size("nodes").alias("n_nodes"), F.explode("nodes").alias("nid"))
    mean = at.join(rel, ["context", "nid"], "left").groupBy("qid", "path", "seq", "n_nodes").agg(rounded(F.sum(F.coalesce("score", F.lit(0.0))) / F.first("n_nodes"), 10).alias("mean_score"))
    return ranked(mean, ["qid"], F.desc("mean_score"), "n_nodes", "path", "seq").where(F.col("rank") <= k)
