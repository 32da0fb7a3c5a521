"""How relevant nodes are to a context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strikegraph.operators.graph import KnowledgeGraph, dense_places, with_slices
from strikegraph.sources.shared import kept

#: Contexts whose masses go side by side in a row.
LANES = 16
#: Scores are rounded to twelve digits.
UNIT = 1e12
#: So many nodes (two numbers each) are broadcast at most.
ASKED = 1 << 20
#: So many masses of the nodes with most edges are broadcast at most in a hop.
PULLED = 1 << 21


def tops(kg: KnowledgeGraph, most: int) -> tuple[DataFrame, int, int] | None:
    """``(nid, degree)`` of the nodes with most edges, ``most`` at most and of equal degree all or none; the least degree, and how many they are."""

    def make():
        # A row for each degree that occurs; a hub counts once for each slice, which only makes the nodes fewer.
        counts = kg.adjacency().groupBy("degree").agg(F.count("*").alias("n"))
        so_far = counts.select("degree", F.sum("n").over(Window.orderBy(F.desc("degree"))).alias("so_far"))
        least = so_far.where(F.col("so_far") <= most).agg(F.min("degree")).first()[0]
        if least is None:
            return None
        found = kg.adjacency().where(F.col("degree") >= least).select(F.col("src").alias("nid"), "degree").distinct().transform(kept)
        return found, least, found.count()

    return kg.once(("tops", most), make)


def relevance(kg: KnowledgeGraph, contexts: DataFrame, stop: float = 0.85, hops: int = 8, min_score: float = 1e-6) -> DataFrame:
    """``(context, nid, score)`` of a random walk with restart from each of ``contexts(context)``.

    The walk stops with probability ``stop`` at each step, else it goes over one of the node's edges; the score is the
    probability of stopping at a node, summed as a series to ``hops`` steps. Scores under ``min_score`` are left
    out.

    ``LANES`` contexts go side by side, so a row carries the mass of all of them at a node. A hop is one join of a row for each node, which reads the
    nodes' edges in place, for they lie in buckets, and one aggregate that combines before its shuffle. Masses are written hop by hop.

    Once masses are spread, those of ``tops`` are broadcast, and each node takes its share from its own edges, for a graph has both directions of
    each; all other nodes send theirs. So a node gets one row from all of these neighbours instead of one from each.

    The last hop gives a node its weight at most, and leads on to none. So it goes to nodes only that lack no more than that
    of ``min_score``, and only nodes that may have ``min_score`` are added up; all other hops go to all nodes.
    """
    steps, hubs = kg.adjacency(), kg.out_edges()[1]
    once = contexts.select("context").where("context is not null").distinct()
    lanes = min(LANES, max(1, once.count()))
    at = dense_places(once, "context", "place").select("context", F.floor(F.col("place") / lanes).alias("block"), F.pmod("place", F.lit(lanes)).cast("int").alias("lane")).transform(kept)
    m = [f"m{i}" for i in range(lanes)]
    state = at.groupBy("block", F.col("context").alias("nid")).agg(*(F.sum((F.col("lane") == i).cast("double")).alias(c) for i, c in enumerate(m))).transform(kept)
    parts: list[DataFrame] = []

    def able(lack: float, terms: int) -> DataFrame | None:
        """The nodes whose ``terms`` parts so far may add up to ``min_score`` less ``lack``, if they are few; the others' parts are all too small."""
        least = (min_score - 1e-12 - lack) / terms * (1 - 1e-9)
        if least <= 0:
            return None
        found = reduce(DataFrame.unionByName, [p.where(F.greatest(*m, F.lit(0.0)) >= least).select("block", "nid") for p in parts]).distinct().transform(kept)
        return F.broadcast(found) if found.count() <= ASKED else None

    blocks = at.select("block").distinct().count()
    top = tops(kg, PULLED // (lanes * blocks)) if blocks else None
    given = [(F.col(c) / F.col("degree")).alias(c) for c in m]
    for k in range(hops + 1):
        if k:
            wide = top is not None and 2 * state.count() > top[2]
            senders = steps.where(F.col("degree") < top[1]) if wide else steps
            step = with_slices(state.withColumnRenamed("nid", "src"), hubs).hint("shuffle_hash").join(senders, ["src", "slice"])
            step = step.select("block", *given, F.explode("out.dst").alias("nid"))
            if wide:
                shares = state.join(F.broadcast(top[0]), "nid").select("block", F.col("nid").alias("dst"), *given)
                taken = steps.select(F.col("src").alias("nid"), F.explode("out.dst").alias("dst")).join(F.broadcast(shares), "dst")
                step = step.unionByName(taken.select("block", *m, "nid"))
            if k == hops and (asked := able(stop * (1 - stop) ** k, k)) is not None:
                step = step.join(asked, ["block", "nid"], "left_semi")
            state = step.groupBy("block", "nid").agg(*(F.sum(c).alias(c) for c in m)).transform(kept)
        parts.append(state.select("block", "nid", *((F.col(c) * (stop * (1 - stop) ** k)).alias(c) for c in m)))
    sums = reduce(DataFrame.unionByName, parts)
    if (asked := able(0.0, len(parts))) is not None:
        sums = sums.join(asked, ["block", "nid"], "left_semi")
    total = sums.groupBy("block", "nid").agg(*(F.round(F.sum(c), 12).alias(c) for c in m))
    each = total.select("block", "nid", F.posexplode(F.array(*m)).alias("lane", "score")).where(F.col("score") >= min_score)
    return each.join(F.broadcast(at) if lanes < LANES else at, ["block", "lane"]).select("context", "nid", "score")


def numbered_edges(kg: KnowledgeGraph) -> tuple[DataFrame, DataFrame]:
    """``(place, dst)``, all edges in the order of source, type and target, and ``(nid, first, degree)``: where a node's edges begin, and how many it has.

    Edges are numbered over ranges that split a hub's edges like others.
    """
    rows = dense_places(kg.edges.select(F.struct("src", "etype", "dst").alias("edge")), "edge", "place").select("place", "edge.src", "edge.dst").transform(kept)
    return rows.select("place", "dst"), rows.groupBy(F.col("src").alias("nid")).agg(F.min("place").alias("first"), F.count("*").alias("degree")).transform(kept)


def sampled_relevance(kg: KnowledgeGraph, contexts: DataFrame, walks: int = 1_000_000, stop: float = 0.85, seed: int = 1) -> DataFrame:
    """``(context, nid, visits, score)``: where ``walks`` random walks from each of ``contexts(context)`` stop.

    Before each step a walk stops with probability ``stop``; else it takes one of its node's edges, all with the same probability, and
    on a node without edges it stops. Its draws are hashed from the seed, the context, its number and the step, so a
    repeated task draws the same. A walk meets its next edge by the edge's number, which is a key of one row; walks that stopped
    are only counted. ``relevance`` is what the shares tend to.
    """
    edges, spans = kg.once("numbered edges", lambda: numbered_edges(kg))
    digits = lambda k: F.md5(F.concat_ws(":", F.lit(str(seed)), "context", "walk", F.lit(str(k))))
    part = lambda column, at: F.conv(F.substring(column, at, 13), 16, 10).cast("double") / float(1 << 52)
    begun = contexts.select("context").where("context is not null").distinct().repartition(1 + walks // 100_000, "context")
    cut = begun.select("context", F.explode(F.sequence(F.lit(0), F.lit((walks - 1) // 1000))).alias("run")).repartition("context", "run")
    moving = cut.select("context", F.explode(F.sequence(F.col("run") * 1000 + 1, F.least(F.lit(walks), (F.col("run") + 1) * 1000))).alias("walk"), F.col("context").alias("nid"))
    stops, k = None, 0
    while True:
        drawn = moving.withColumn("_d", digits(k)).join(spans, "nid", "left")
        stays = (part("_d", 1) < stop) | F.col("degree").isNull()
        placed = drawn.select("context", "walk", "nid", F.when(~stays, F.col("first") + F.floor(part("_d", 14) * F.col("degree"))).alias("place")).transform(kept)
        here = placed.where("place is null").groupBy("context", "nid").agg(F.count("*").alias("visits"))
        stops = here if stops is None else stops.unionByName(here)
        moving = placed.where("place is not null").join(edges, "place").select("context", "walk", F.col("dst").alias("nid"))
        k += 1
        if placed.where("place is not null").isEmpty():
            break
    return stops.groupBy("context", "nid").agg(F.sum("visits").alias("visits")).select("context", "nid", "visits", F.round(F.col("visits") / walks, 12).alias("score"))


def type_relevance(kg: KnowledgeGraph, rel: DataFrame, queries: DataFrame) -> DataFrame:
    """``(qid, type, score)``: the mean score over a type's nodes but the target; nodes without a score count 0.

    The sum runs over scored nodes only, the number of nodes comes from the type's size, so no node is paired with a query for nothing. Scores
    are added up once for a context, in units of their last digit, so that a query's target can be taken off exactly.
    """
    sizes = kg.node_types.groupBy("type").agg(F.count("*").alias("n"))
    units = F.round(F.col("score") * UNIT).cast("long")
    known = rel.join(queries.select("context").distinct(), "context", "left_semi").join(kg.node_types, "nid").select("context", "nid", "type", units.alias("u"))
    sums = known.groupBy("context", "type").agg(F.sum("u").alias("u"), F.count("*").alias("scored")).transform(kept)
    own = queries.join(kg.node_types, F.col("target") == F.col("nid")).select("qid", "context", "nid", "type")
    own = own.join(rel, ["context", "nid"], "left").select("qid", "type", F.lit(1).alias("own"), units.alias("own_u"))
    each = queries.select("qid", "context").join(sums, "context").join(sizes, "type").join(own, ["qid", "type"], "left")
    less = lambda c, o: F.col(c) - F.coalesce(o, F.lit(0))
    others = each.where(less("scored", F.col("own_u").isNotNull().cast("int")) > 0)
    return others.select("qid", "type", F.round(less("u", "own_u") / UNIT / less("n", "own"), 12).alias("score"))


def best_type(kg: KnowledgeGraph, types: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(qid, nid, type)``: each of ``wanted(qid, nid)``'s most relevant type; ties by name, none if all are 0."""
    scored = wanted.join(kg.node_types, "nid").join(types.where("score > 0"), ["qid", "type"])
    return scored.groupBy("qid", "nid").agg(F.min(F.struct((-F.col("score")).alias("s"), "type")).alias("m")).select("qid", "nid", F.col("m.type").alias("type"))


def edge_type_score_sum(kg: KnowledgeGraph, rel: DataFrame) -> DataFrame:
    """``(context, etype, type, score_sum)``: scores of nodes with an out-edge type and a type, the contexts left out."""
    sources = kg.edges.select("etype", F.col("src").alias("nid")).distinct()
    return rel.where("nid <> context").join(sources, "nid").join(kg.node_types, "nid").groupBy("context", "etype", "type").agg(F.round(F.sum("score"), 10).alias("score_sum"))


def total_relevance(rel: DataFrame) -> DataFrame:
    """``(context, total)``: all scores but the context's own."""
    return rel.where("nid <> context").groupBy("context").agg(F.round(F.sum("score"), 10).alias("total"))


def propagate(kg: KnowledgeGraph, source: DataFrame, etypes: list[int]) -> DataFrame:
    """``(source, nid, prob)``: probability pushed from each of ``source(source)`` along a fixed sequence of edge types.

    At each step a node shares its probability evenly over its edges of the type; a node gives nothing back to one
    that it came from.
    """
    spread = kg.edges.groupBy("src", "etype").agg((1.0 / F.count("*")).alias("spread"))
    state = source.select("source", F.col("source").alias("nid"), F.lit(1.0).alias("prob"))
    came = None
    for e in etypes:
        step = state.withColumnRenamed("nid", "src").join(kg.edges.where(F.col("etype") == e), "src").join(spread.where(F.col("etype") == e).drop("etype"), "src")
        if came is not None:
            step = step.join(came, ["source", "src", "dst"], "left_anti")
        came = step.select("source", F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
        state = step.groupBy("source", F.col("dst").alias("nid")).agg(F.sum(F.col("prob") * F.col("spread")).alias("prob"))
    return state


def ranked(df: DataFrame, by: list[str], *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
