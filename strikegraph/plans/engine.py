"""Mining runs: relevance, paths, patterns, peers and facts in one plan for a whole batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikegraph.functions.columns import instance_label, signature
from strikegraph.operators import facts, graph, paths, patterns, relevance
from strikegraph.operators.graph import KnowledgeGraph
from strikegraph.plans.config import BLIND, MiningConfig
from strikegraph.sources.shared import kept


def scores(kg: KnowledgeGraph, queries: DataFrame, config: MiningConfig) -> DataFrame:
    return relevance.relevance(kg, queries.select("context"), config.stop, config.hops, config.min_score)


def reachable(queries: DataFrame, rel: DataFrame) -> DataFrame:
    """Queries whose target is relevant to its context; the others give no rows."""
    return queries.join(rel.select("context", F.col("nid").alias("target")), ["context", "target"], "left_semi").select("qid", "target", "context")


def candidate_patterns(kg: KnowledgeGraph, queries: DataFrame, rel: DataFrame, config: MiningConfig) -> DataFrame:
    found = paths.paths_between(kg, queries, rel, config.path_nodes, config.min_path_nodes, config.enumeration)
    scored = paths.path_scores(found, rel, config.own_score, whole=config.own_score)
    if config.labelled:
        return patterns.labelled_patterns(kg, scored, relevance.type_relevance(kg, rel, queries), config.path_nodes)
    return patterns.unlabelled_patterns(scored)


def ranked_patterns(kg: KnowledgeGraph, queries: DataFrame, rel: DataFrame, config: MiningConfig) -> tuple[DataFrame, DataFrame]:
    """The ranked patterns ``(qid, pattern, n_nodes, relevance, n_peers, rank)`` and their peers ``(qid, pattern, nid)``."""
    best, named, sets = ranked_sets(kg, queries, rel, config)
    return best, named.join(sets, "class").select("qid", "pattern", "nid")


def ranked_sets(kg: KnowledgeGraph, queries: DataFrame, rel: DataFrame, config: MiningConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ranked patterns, the class of their peers ``(qid, pattern, class)``, and ``(class, nid)``: equal peers are held once."""
    candidates = candidate_patterns(kg, queries, rel, config).transform(kept)
    suffixes = patterns.suffix_sets(kg, candidates, config.path_nodes, config.labelled)
    known = patterns.bounds(suffixes, rel, config.context_level).transform(kept)
    choose = (lambda found: patterns.diversified(found, candidates)) if config.diversify and config.labelled else None
    least = config.min_relevance if config.mode == "threshold" else None
    done = patterns.evaluated(kg, suffixes, known, rel, config.top_patterns, config.min_peers, config.context_level, config.prune, choose=choose, least=least)
    found = choose(done.relevance) if choose else done.relevance
    best = patterns.top_patterns(found, config.top_patterns) if config.mode == "top" else patterns.threshold_patterns(found, config.min_relevance)
    best = best.transform(kept)
    named, sets = patterns.peers(suffixes)
    return best, named.join(best.select("qid", "pattern"), ["qid", "pattern"], "left_semi").transform(kept), sets


def score_facts(kg: KnowledgeGraph, queries: DataFrame, members: DataFrame, config: MiningConfig, everywhere: bool = False, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The peer sets of ``members(qid, pattern, nid)`` and the scored facts of each distinct set."""
    return score_sets(kg, queries, *patterns.peer_classes(members.transform(kept)), config, everywhere, most)


def score_sets(kg: KnowledgeGraph, queries: DataFrame, sets: DataFrame, once: DataFrame, config: MiningConfig, everywhere: bool = False, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``score_facts`` of ``class_sets``; ``most``: only so many of the most striking facts of each query's set."""
    asked = facts.target_facts(kg, queries.join(sets.select("qid").distinct(), "qid", "left_semi")).transform(kept)
    firsts = facts.first_held(kg, once, asked).transform(kept)
    eligible = (facts.eligible_globally if everywhere else facts.eligible_by_peers)(kg, once, asked, config.coverage, sets.select("qid", "set_id").distinct(), firsts)
    return sets, facts.fact_scores(kg, once, asked, eligible, config.min_peers if config.drop_zero else 0, most, firsts).transform(kept)


def mine(kg: KnowledgeGraph, queries: DataFrame, config: MiningConfig, rel: DataFrame | None = None) -> DataFrame:
    """The most striking facts of each of the best patterns of ``queries(qid, target, context)``.

    ``qid, rank, pattern, n_nodes, relevance, n_peers, fact_rank, etype, value, strikingness, value_freq, top_value, top_freq``.
    ``rel``: the relevance scores, where the caller has them.
    """
    rel = rel if rel is not None else scores(kg, queries, config).transform(kept)
    live = reachable(queries, rel).transform(kept)
    best, named, held = ranked_sets(kg, live, rel, config)
    sets, scored = score_sets(kg, live, *patterns.class_sets(named, held), config, most=config.top_facts)
    facts_ = sets.select("qid", "pattern", "set_id").join(scored, ["qid", "set_id"]).join(best.select("qid", "pattern", "n_nodes", "relevance", "n_peers", F.col("rank").alias("pattern_rank")), ["qid", "pattern"])
    return facts.top_facts(facts_, config.top_facts, ["qid", "pattern"], config.drop_zero).withColumnRenamed("pattern_rank", "rank").select(
        "qid", "rank", "pattern", "n_nodes", "relevance", "n_peers", "fact_rank", "etype", "value", "strikingness", "value_freq", "top_value", "top_freq"
    )


def blind_patterns(kg: KnowledgeGraph, queries: DataFrame, config: MiningConfig = BLIND) -> DataFrame:
    """``(qid, end, etypes, pattern)`` of all paths from the targets: an edge sequence and an end node."""
    found = paths.paths_from(kg, queries, config.path_nodes - 1)
    ends = found.select("qid", F.element_at("nodes", -1).alias("end"), "etypes").distinct()
    return ends.select("qid", "end", "etypes", F.concat_ws(">", signature("etypes"), instance_label("end")).alias("pattern"))


def _classed(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(key, class)`` and ``(class, nid)`` of ``sets(key, nid)``: keys of equal sets share a class, which holds the set once."""
    total = lambda salt: F.sum(F.xxhash64("nid", F.lit(salt)).cast("decimal(20,0)"))
    sums = sets.groupBy("key").agg(F.count("*").alias("n"), total(1).alias("a"), total(2).alias("b"))
    classes = sums.select("key", F.sha2(F.concat_ws(":", "n", "a", "b"), 256).alias("class")).transform(kept)
    first = classes.groupBy("class").agg(F.min("key").alias("key"))
    return classes, sets.join(first, "key").select("class", "nid").transform(kept)


def blind_classes(kg: KnowledgeGraph, queries: DataFrame, config: MiningConfig = BLIND, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(qid, pattern, class)`` of the blind patterns and ``(class, nid)``, their peers.

    The peers are found from the ends backwards, an edge type at a time. At each step ends whose sets so far are equal (all orders
    of a status, all customers of a segment) go on as one class, so a hub's neighbours are not expanded one by one.
    ``compat``: a step takes all edges from the edge type on, as the reference's matcher does, not those of the type.
    """
    turned = kg.edges.select(F.col("src").alias("next"), F.col("etype").bitwiseXOR(1).alias("step"), F.col("dst").alias("nid"))
    if compat:
        turned = kg.edges.select(F.col("src").alias("next"), F.col("etype").alias("_back"), F.col("dst").alias("nid"))
    todo = blind_patterns(kg, queries, config).withColumn("class", F.col("end").cast("string")).transform(kept)
    members = todo.select("class", F.col("end").alias("nid")).distinct()
    done = None
    for k in range(1, config.path_nodes):
        step = F.element_at("etypes", F.lit(-k))
        todo = todo.where(F.size("etypes") >= k).withColumn("step", step).withColumn("key", F.concat_ws(":", "step", "class"))
        wanted = todo.select("key", "step", "class").distinct()
        reached = wanted.join(members.withColumnRenamed("nid", "next"), "class")
        if compat:
            reached = reached.join(turned, "next").where(F.col("_back") >= F.col("step").bitwiseXOR(1))
        else:
            reached = reached.join(turned, ["next", "step"])
        classes, members = _classed(reached.select("key", "nid").distinct().transform(kept))
        todo = todo.drop("class").join(classes, "key").select("qid", "end", "etypes", "pattern", "class").transform(kept)
        ready = todo.where(F.size("etypes") == k)
        found = ready.select("qid", "pattern", "class"), members.join(ready.select("class").distinct(), "class", "left_semi")
        done = found if done is None else (done[0].unionByName(found[0]), done[1].unionByName(found[1]))
    enough = done[1].distinct().transform(kept)
    sizes = enough.groupBy("class").agg(F.count("*").alias("n")).where(F.col("n") >= config.min_peers).select("class").transform(kept)
    return done[0].join(sizes, "class"), enough.join(sizes, "class", "left_semi")


def blind_peers(kg: KnowledgeGraph, queries: DataFrame, config: MiningConfig = BLIND) -> DataFrame:
    """``(qid, pattern, nid)``: nodes that reach the same end node by the same edge types, for ends with ``min_peers`` of them.

    Of the patterns of a query with the same class of peers the first by key has them; ``blind_classes`` names the others.
    """
    named, members = blind_classes(kg, queries, config)
    return named.groupBy("qid", "class").agg(F.min("pattern").alias("pattern")).join(members, "class").select("qid", "pattern", "nid")


def blind_type_peers(kg: KnowledgeGraph, queries: DataFrame, config: MiningConfig = BLIND) -> DataFrame:
    """``(qid, pattern, nid)``: nodes that reach any node of the end's type by the same edge types.

    A node's type here is its first by name; all nodes count as ends of a path to a node without one.
    """
    label = graph.one_label(kg.nodes, kg.node_types)
    found = paths.paths_from(kg, queries, config.path_nodes - 1).select("qid", F.element_at("nodes", -1).alias("nid"), "etypes").distinct()
    ends = found.join(label, "nid").select("qid", "label", "etypes").distinct().withColumn("pattern", F.concat_ws(">", signature("etypes"), F.concat(F.lit("T:"), "label")))
    turned = kg.edges.select(F.col("src").alias("next"), F.col("etype").bitwiseXOR(1).alias("etype"), F.col("dst").alias("nid"))
    members = kg.node_types.select(F.col("type").alias("label"), F.col("nid").alias("next")).unionByName(kg.nodes.select(F.lit("ANY").alias("label"), F.col("nid").alias("next")))
    keys = ends.select("label", "etypes", "pattern").distinct()
    level = keys.join(members, "label").select("pattern", "etypes", "next")
    out = None
    for k in range(1, config.path_nodes):
        step = level.where(F.size("etypes") >= k).withColumn("etype", F.element_at("etypes", F.lit(-k)))
        level = step.join(turned, ["next", "etype"]).select("pattern", "etypes", F.col("nid").alias("next")).distinct()
        done = level.where(F.size("etypes") == k).select("pattern", F.col("next").alias("nid"))
        out = done if out is None else out.unionByName(done)
    return with_enough(ends.select("qid", "pattern").distinct().join(out, "pattern").select("qid", "pattern", "nid"), config.min_peers)


def with_enough(members: DataFrame, least: int) -> DataFrame:
    n = members.groupBy("qid", "pattern").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return members.join(n.select("qid", "pattern"), ["qid", "pattern"], "left_semi")


def mine_blind(kg: KnowledgeGraph, queries: DataFrame, config: MiningConfig = BLIND, ends: str = "node") -> DataFrame:
    """Scored facts ``(qid, pattern, etype, value, strikingness, ...)`` of every distinct peer set, without a context.

    Of patterns with equal peers the first by key stands for all. ``ends``: ``node`` or ``type``.
    """
    members = (blind_peers if ends == "node" else blind_type_peers)(kg, queries, config).transform(kept)
    sets, scored = score_facts(kg, queries, members, config, everywhere=True)
    first = sets.groupBy("qid", "set_id", "n_peers").agg(F.min("pattern").alias("pattern"))
    return first.join(scored, ["qid", "set_id"]).drop("set_id", "population")


def guided_facts(kg: KnowledgeGraph, queries: DataFrame, config: MiningConfig, rel: DataFrame | None = None) -> DataFrame:
    """Global top facts of a guided run: values at least as relevant as the query's last ranked pattern, global coverage."""
    rel = rel if rel is not None else scores(kg, queries, config).transform(kept)
    live = reachable(queries, rel).transform(kept)
    best, named, held = ranked_sets(kg, live, rel, config)
    kth = best.groupBy("qid").agg(F.min("relevance").alias("kth"))
    sets, scored = score_sets(kg, live, *patterns.class_sets(named, held), config, everywhere=True)
    named = sets.groupBy("qid", "set_id", "n_peers").agg(F.min("pattern").alias("pattern")).join(scored, ["qid", "set_id"]).join(kth, "qid")
    return facts.relevant_facts(named, rel, live, F.col("kth")).drop("set_id", "population", "kth")


def render(kg: KnowledgeGraph, mined: DataFrame) -> DataFrame:
    """``(qid, rank, fact_rank, text)``: a line for each fact."""
    names = kg.nodes.select(F.col("nid").alias("value"), F.col("iri").alias("value_iri"))
    tops = kg.nodes.select(F.col("nid").alias("top_value"), F.col("iri").alias("top_iri"))
    out = mined.join(names, "value").join(tops, "top_value").join(F.broadcast(kg.edge_types), "etype")
    line = F.concat_ws(" ", F.concat(F.lit("#"), F.col("rank")), "pattern", F.concat(F.lit("peers="), F.col("n_peers")), F.concat("name", F.lit("="), "value_iri"), F.concat(F.lit("shared by "), F.col("value_freq")), F.concat(F.lit("most have "), "top_iri", F.lit(" ("), F.col("top_freq"), F.lit(")")))
    return out.select("qid", "rank", "fact_rank", line.alias("text"))
