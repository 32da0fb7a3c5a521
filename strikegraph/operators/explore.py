"""Patterns by how probable it is to go from a source to a node along them, both ways."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikegraph.functions.columns import signature
from strikegraph.operators.graph import KnowledgeGraph, follow
from strikegraph.operators.relevance import ranked
from strikegraph.sources.shared import kept

KEY = ["source", "etypes"]


def spread_edges(kg: KnowledgeGraph, sources: DataFrame, forward_only: bool = False) -> DataFrame:
    """``(src, etype, dst, spread, back)``: the edges of ``sources(src)`` with their share of their source's edges of the type, and of the reverse at the other end.

    Edges are followed and counted where they lie, those of the nodes concerned only; no other edge moves.
    """
    shares = lambda found, name: found.groupBy("src", "etype").agg((1.0 / F.count("*")).alias(name))
    found = follow(kg, sources.select("src").distinct()).transform(kept)
    edges = found.where("etype % 2 = 0") if forward_only else found
    ends = shares(follow(kg, edges.select(F.col("dst").alias("src")).distinct()), "back")
    back = ends.select(F.col("src").alias("dst"), F.col("etype").bitwiseXOR(1).alias("etype"), "back")
    return edges.join(shares(edges, "spread"), ["src", "etype"]).join(back, ["dst", "etype"]).select("src", "etype", "dst", "spread", "back")


def pattern_probability(kg: KnowledgeGraph, sources: DataFrame, hops: int, forward_only: bool = False) -> DataFrame:
    """``(source, etypes, nid, forward, backward, score)``: probabilities along each edge-type sequence of up to ``hops`` edges.

    ``forward`` sums over walks the shares taken at each step from the source, ``backward`` those from the node back to the
    source; ``score`` is their mean. Walks do not return to the node they came from.

    The last hop goes on from sums by node, not by node and predecessor, and takes off what would return: behind a hub, each edge
    is followed once for a sequence, not once for each way to the hub. Each hop follows the edges of the nodes it starts from, in place.
    """
    state = sources.select("source", F.array().cast("array<int>").alias("etypes"), F.lit(None).cast("long").alias("came"), F.col("source").alias("src"), F.lit(1.0).alias("f"), F.lit(1.0).alias("b"))
    out = []
    for _ in range(hops - 1):
        edges = spread_edges(kg, state, forward_only).transform(kept)
        step = state.join(edges, "src").where("came is null or dst <> came")
        state = step.select("source", F.concat("etypes", F.array("etype")).alias("etypes"), F.col("src").alias("came"), F.col("dst").alias("src"), (F.col("f") * F.col("spread")).alias("f"), (F.col("b") * F.col("back")).alias("b"))
        state = state.groupBy(*KEY, "came", "src").agg(F.sum("f").alias("f"), F.sum("b").alias("b")).transform(kept)
        out.append(state.groupBy(*KEY, F.col("src").alias("nid")).agg(F.sum("f").alias("f"), F.sum("b").alias("b")))
    edges = spread_edges(kg, state, forward_only).transform(kept)
    walked = lambda step, sign: step.select("source", F.concat("etypes", F.array("etype")).alias("etypes"), F.col("dst").alias("nid"), (F.col("f") * F.col("spread") * sign).alias("f"), (F.col("b") * F.col("back") * sign).alias("b"), (F.col("n") * sign).alias("n"))
    sums = state.groupBy(*KEY, "src").agg(F.sum("f").alias("f"), F.sum("b").alias("b"), F.count("*").alias("n"))
    back = state.withColumn("n", F.lit(1).cast("long")).join(edges.withColumn("came", F.col("dst")), ["src", "came"])
    last = walked(sums.join(edges, "src"), 1).unionByName(walked(back, -1)).groupBy(*KEY, "nid").agg(F.sum("f").alias("f"), F.sum("b").alias("b"), F.sum("n").alias("n"))
    out.append(last.where("n > 0").drop("n"))
    return reduce(DataFrame.unionByName, out).select(*KEY, "nid", F.round("f", 10).alias("forward"), F.round("b", 10).alias("backward"), F.round((F.col("f") + F.col("b")) / 2, 10).alias("score"))


def pattern_support(kg: KnowledgeGraph, patterns: DataFrame, hops: int) -> DataFrame:
    """``(etypes, support)``: for each distinct sequence of ``patterns(etypes)`` the least number of distinct nodes at any position after the first, over the whole graph."""
    p = patterns.select("etypes").distinct()
    prefixes = p.select("etypes", F.explode(F.sequence(F.lit(1), F.size("etypes"))).alias("n")).select(F.slice("etypes", F.lit(1), F.col("n")).alias("prefix")).distinct()
    at = prefixes.select("prefix", F.slice("prefix", F.lit(1), F.size("prefix") - 1).alias("parent"), F.element_at("prefix", -1).alias("etype"))
    # Where an edge leads, its reverse lies.
    ends = kg.edges.select(F.col("etype").bitwiseXOR(1).alias("etype"), F.col("src").alias("nid"))
    level = ends.join(F.broadcast(at.where("size(parent) = 0")), "etype").select("prefix", "nid").distinct()
    counts = []
    for n in range(1, hops + 1):
        counts.append(level.groupBy("prefix").agg(F.count("*").alias("n")))
        if n < hops:
            steps = at.where(F.size("prefix") == n + 1).select("prefix", F.col("parent"), F.col("etype").alias("step"))
            tail = level.select(F.col("prefix").alias("parent"), F.col("nid").alias("src")).join(F.broadcast(steps), "parent")
            level = follow(kg, tail).where("etype = step").select("prefix", F.col("dst").alias("nid")).distinct()
    sizes = reduce(DataFrame.unionByName, counts)
    return p.select("etypes", F.explode(F.sequence(F.lit(1), F.size("etypes"))).alias("k")).withColumn("prefix", F.slice("etypes", F.lit(1), F.col("k"))).join(sizes, "prefix").groupBy("etypes").agg(F.min("n").alias("support"))


def scores_between(kg: KnowledgeGraph, pairs: DataFrame, hops: int) -> DataFrame:
    """``(source, target, etypes, forward, backward, score)``: each pattern between the ends of ``pairs(source, target)`` with its probabilities."""
    probability = pattern_probability(kg, pairs.select("source").distinct(), hops).withColumnRenamed("nid", "target")
    return pairs.distinct().join(probability, ["source", "target"]).select("source", "target", "etypes", "forward", "backward", "score")


def top_path_patterns(kg: KnowledgeGraph, pairs: DataFrame, hops: int = 2, k_patterns: int = 10, k_peers: int = 10) -> DataFrame:
    """``(source, target, pattern, pattern_rank, score, support, nid, peer_rank, peer_score)``.

    For each of ``pairs(source, target)`` the patterns that lead from the source to the target, by the target's score and
    then by support, each with the nodes of the highest scores that it leads to.
    """
    probability = pattern_probability(kg, pairs.select("source").distinct(), hops).transform(kept)
    hit = pairs.join(probability, (pairs.source == probability.source) & (pairs.target == probability.nid)).select(pairs.source, "target", "etypes", "score")
    ranked_ = ranked(hit.join(pattern_support(kg, hit, hops), "etypes").withColumn("pattern", signature("etypes")), ["source", "target"], F.desc("score"), F.desc("support"), "pattern")
    best = ranked_.where(F.col("rank") <= k_patterns).withColumnRenamed("rank", "pattern_rank")
    nodes = best.join(probability.select("source", "etypes", "nid", F.col("score").alias("peer_score")), ["source", "etypes"])
    return ranked(nodes, ["source", "target", "pattern"], F.desc("peer_score"), "nid").where(F.col("rank") <= k_peers).withColumnRenamed("rank", "peer_rank").drop("etypes")
