"""The library's queries over the star-schema graph, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikegraph.functions.columns import rounded, signature
from strikegraph.operators import explore, facts, graph, paths, patterns, relevance
from strikegraph.operators.graph import KnowledgeGraph
from strikegraph.plans import engine
from strikegraph.plans.config import ABLATIONS, BIDIRECTIONAL, BLIND, NAIVE, REVERSE, THRESHOLD
from strikegraph.sources import graph_io, star_schema
from strikegraph.sources.shared import kept, shared_dir

_GRAPHS: dict = {}


def loaded(spark: SparkSession, sf_dir: str) -> tuple[KnowledgeGraph, DataFrame]:
    """The graph of a folder and its query pairs; the last one asked for stays, with what queries hold of it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRAPHS:
        _GRAPHS.clear()
        _GRAPHS[key] = star_schema.graph(spark, sf_dir).cached(), star_schema.queries(spark, sf_dir).transform(kept)
    return _GRAPHS[key]


#: What many queries share: the edges by node, the first values and the relevance.
SHARED = ("adjacency", "first values", "relevance")


def forget(shared: bool = True) -> None:
    """Drops what queries hold of loaded graphs, so that the next one does all its work; ``shared``: also what ``prepare`` works out."""
    for kg, _ in _GRAPHS.values():
        for name in [n for n in kg.held if shared or n not in SHARED]:
            del kg.held[name]


def prepare(spark: SparkSession, sf_dir: str) -> None:
    """Works out what many queries share, for timing each of them by its own work."""
    kg, q = loaded(spark, sf_dir)
    _rel(kg, q)
    kg.first_values()


def _rel(kg, q):
    """The relevance of all nodes to the pairs' contexts, worked out once for a graph."""
    return kg.once("relevance", lambda: engine.scores(kg, q, BIDIRECTIONAL).transform(kept))


def _kg(query: Callable[[KnowledgeGraph, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(*loaded(spark, sf_dir))


def _nodes(query: Callable[[KnowledgeGraph], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query of nodes and types alone, for which no edges are written."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        held = _GRAPHS.get((spark.sparkContext.applicationId, sf_dir))
        return query(held[0] if held else star_schema.graph(spark, sf_dir))

    return run


def _text(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, signature(c))
    return df


def relevance_scores(kg, q):
    return engine.scores(kg, q, BIDIRECTIONAL).withColumn("score", F.round("score", 9))


def sampled_relevance(kg, q):
    return relevance.sampled_relevance(kg, q.select("context"), walks=1_000_000)


def type_relevance(kg, q):
    return relevance.type_relevance(kg, _rel(kg, q), q).withColumn("score", F.round("score", 10))


def best_type(kg, q):
    rel = _rel(kg, q)
    wanted = q.join(rel, "context").select("qid", "nid")
    return relevance.best_type(kg, relevance.type_relevance(kg, rel, q), wanted)


def one_hop_expand(kg, q):
    inner = paths.inner_nodes(kg, _rel(kg, q))
    return _text(paths.expand(kg, paths.start(q), inner).select("qid", "nodes", "etypes"), "nodes", "etypes")


def simple_paths(kg, q):
    found = paths.paths_from(kg, q, 2)
    return _text(found.groupBy("qid", "etypes").agg(F.count("*").alias("n_paths"), F.countDistinct(F.element_at("nodes", -1)).alias("n_ends")), "etypes")


def simple_paths_3hop(kg, q):
    found = paths.simple_path_counts(kg, q, 3)
    return _text(found.groupBy("qid", "etypes").agg(F.sum("n_paths").alias("n_paths"), F.count("*").alias("n_ends")), "etypes")


def _between(kg, q, how, least=2):
    return kg.once((how, least), lambda: paths.paths_between(kg, q, _rel(kg, q), 4, least, how).transform(kept))


def between(how):
    return lambda kg, q: _text(_between(kg, q, how).select("qid", "nodes", "etypes"), "nodes", "etypes")


def paths_by_mean_relevance(kg, q):
    return paths.paths_by_mean_relevance(_between(kg, q, "bidirectional"), _rel(kg, q), 20)


def paths_from_by_mean_relevance(kg, q):
    return paths.paths_by_mean_relevance(paths.paths_from(kg, q, 2), _rel(kg, q), 100)


def best_paths(kg, q):
    found = paths.best_paths(kg, q, _rel(kg, q), 20)
    return _text(found.select("qid", "rank", "nodes", "etypes", rounded("path_score", 10).alias("path_score")), "nodes", "etypes")


def path_scores(kg, q):
    scored = paths.path_scores(_between(kg, q, "bidirectional"), _rel(kg, q))
    return _text(scored.select("qid", "nodes", "etypes", rounded("path_score", 10).alias("path_score")), "nodes", "etypes")


def reverse_index_2hop(kg, q):
    found = paths.reverse_index(kg, q, _rel(kg, q), 2)
    return _text(found.withColumn("score", rounded("score", 10)), "etypes")


def _candidates(kg, q, config=BIDIRECTIONAL):
    rel = _rel(kg, q)
    return kg.once(config, lambda: engine.candidate_patterns(kg, engine.reachable(q, rel), rel, config).transform(kept)), rel


def pattern_enumeration(kg, q):
    found, _ = _candidates(kg, q, BIDIRECTIONAL.with_(min_path_nodes=2))
    return found.select("qid", "pattern", rounded("path_score", 10).alias("path_score"))


def match_sets(config):
    def run(kg, q):
        found, _ = _candidates(kg, q, config)
        levels, nodes = patterns.match_levels(kg, found, 4, config.labelled)
        sums = nodes.groupBy("at").agg(F.count("*").alias("n"), F.sum("nid").alias("sum_nid"), F.min("nid").alias("min_nid"), F.max("nid").alias("max_nid"))
        return levels.join(sums, "at").drop("at")

    return run


def _ranked(kg, q, config):
    rel = _rel(kg, q)

    def make():
        live = engine.reachable(q, rel).transform(kept)
        best, named, held = engine.ranked_sets(kg, live, rel, config)
        return live, rel, best, named, held

    return kg.once(("ranked", config), make)


def pattern_relevance(kg, q):
    found, rel = _candidates(kg, q)
    return patterns.levels_relevance(*patterns.match_levels(kg, found, 4, True, 5), found, rel)


def ranked(config):
    return lambda kg, q: _ranked(kg, q, config)[2].select("qid", "rank", "pattern", "n_nodes", "relevance", "n_peers")


def top_patterns_in_waves(kg, q):
    found, rel = _candidates(kg, q)
    suffixes, known = _known(kg, q)
    done = patterns.evaluated(kg, suffixes, known, rel, 20, 5, True, "path scores", first=30)
    return patterns.top_patterns(done.relevance, 20).select("qid", "rank", "pattern", "n_nodes", "relevance", "n_peers")


def _known(kg, q):
    """The suffix sets of the candidate patterns and the bounds on their relevance."""
    found, rel = _candidates(kg, q)

    def make():
        suffixes = patterns.suffix_sets(kg, found, 4, True)
        return suffixes, patterns.bounds(suffixes, rel).transform(kept)

    return kg.once("known", make)


def pattern_bounds(kg, q):
    return _known(kg, q)[1].where("n_peers > 0")


def mine_counters(kg, q):
    """What each preset of the miner evaluates, rejects and prunes, and how many patterns it ends with."""
    (suffixes, known), rel, out = _known(kg, q), _rel(kg, q), None
    for name, config in ABLATIONS.items():
        done = patterns.evaluated(kg, suffixes, known, rel, config.top_patterns, config.min_peers, config.context_level, config.prune)
        best = patterns.top_patterns(done.relevance, config.top_patterns).select("qid", "pattern", F.lit(True).alias("top"))
        n = lambda fate: F.count_if(F.col("fate") == fate).alias(f"n_{fate}")
        counts = done.fates.join(best, ["qid", "pattern"], "left").groupBy("qid").agg(n("rejected"), n("pruned"), n("evaluated"), F.count_if("top").alias("n_top")).select(F.lit(name).alias("preset"), "*")
        out = counts if out is None else out.unionByName(counts)
    return out


def _peer_sets(kg, q, config=THRESHOLD):
    """The peer sets of the ranked patterns, and each distinct one."""
    return kg.once(("peer sets", config), lambda: patterns.distinct_class_sets(*_ranked(kg, q, config)[3:]))


def peer_set_dedup(kg, q):
    sets, _ = _peer_sets(kg, q)
    return sets.groupBy("qid", "set_id", "n_peers").agg(F.count("*").alias("n_patterns"), F.min("pattern").alias("first_pattern")).drop("set_id")


def peer_jaccard(kg, q):
    return patterns.named_jaccard(*_peer_sets(kg, q), 0.1)


def merged_peer_sets(kg, q):
    return patterns.merged_sets(*_peer_sets(kg, q), 0.1)


def _facts(kg, q, config=BIDIRECTIONAL):
    live, _, best, _, _ = _ranked(kg, q, config)
    sets, once = _peer_sets(kg, q, config)
    return live, best, sets, once.transform(kept), facts.target_facts(kg, live)


def _named(sets, df):
    return sets.select("qid", "set_id", "pattern").join(df, ["qid", "set_id"]).drop("set_id")


def eligibility(rule, coverage):
    def run(kg, q):
        _, _, sets, once, asked = _facts(kg, q)
        return _named(sets, rule(kg, once, asked, coverage))

    return run


def _frequency(kg, q):
    _, _, sets, once, asked = _facts(kg, q)
    return sets, facts.value_frequency(kg, once, asked, facts.eligible_by_peers(kg, once, asked, 0.8))


def value_frequency(kg, q):
    sets, found = _frequency(kg, q)
    return _named(sets, found.groupBy("qid", "set_id", "etype", "value").agg(F.count("*").alias("n_values"), F.sum("f").alias("population"), F.max("f").alias("most")))


def _scored(kg, q, most=None):
    """The ranked patterns, their sets, and the scored facts of these, ``most`` of a set or all."""
    live, _, best, named, held = _ranked(kg, q, BIDIRECTIONAL)
    return best, *engine.score_sets(kg, live, *patterns.class_sets(named, held), BIDIRECTIONAL, most=most)


def strikingness(kg, q):
    _, sets, scored = _scored(kg, q)
    return _named(sets, scored.select("qid", "set_id", "etype", "value", "strikingness", "value_freq", "population"))


def most_frequent_value(kg, q):
    _, sets, scored = _scored(kg, q)
    return _named(sets, scored.select("qid", "set_id", "etype", "value", "top_value", "top_freq"))


def top_facts(kg, q):
    return engine.mine(kg, q, BIDIRECTIONAL.with_(top_facts=3), _rel(kg, q)).select("qid", "pattern", "fact_rank", "etype", "value", "strikingness")


def diverse_top_facts(kg, q):
    best, sets, scored = _scored(kg, q, 1)
    named = _named(sets, scored).join(best.select("qid", "pattern", "n_nodes"), ["qid", "pattern"])
    return facts.diverse_top_facts(named, 10).select("qid", "fact_rank", "pattern", "etype", "value", "strikingness")


def _sized(members):
    return members.groupBy("qid", "pattern").agg(F.count("*").alias("n_peers"), F.sum("nid").alias("sum_nid"))


def blind_end_node(kg, q):
    named, members = engine.blind_classes(kg, q, BLIND)
    sizes = members.groupBy("class").agg(F.count("*").alias("n_peers"), F.sum("nid").alias("sum_nid"))
    return named.join(sizes, "class").select("qid", "pattern", "n_peers", "sum_nid")


def blind_top_facts(kg, q):
    found = engine.mine_blind(kg, q, BLIND)
    return facts.top_facts(found, 100, ["qid"], True).select("qid", "fact_rank", "pattern", "etype", "value", "strikingness", "value_freq", "top_value", "top_freq")


def guided_facts(kg, q):
    found = engine.guided_facts(kg, q, REVERSE.with_(min_peers=5), _rel(kg, q))
    return facts.top_facts(found, 20, ["qid"], True).select("qid", "fact_rank", "pattern", "etype", "value", "strikingness")


def _sources(q):
    return q.select(F.col("target").alias("source")).distinct()


def pattern_probability(hops, forward_only=False):
    return lambda kg, q: _text(explore.pattern_probability(kg, _sources(q), hops, forward_only), "etypes")


def scores_between(hops):
    return lambda kg, q: _text(explore.scores_between(kg, q.select(F.col("target").alias("source"), F.col("context").alias("target")), hops), "etypes")


def _file(kg, name):
    return f"{shared_dir(kg.edges.sparkSession)}/strikegraph/{name}-{uuid.uuid4().hex}"


def _files(kg):
    """The graph written as an edge file and a type file, and read again."""
    edges, types = _file(kg, "edges"), _file(kg, "types")
    iri = lambda side: kg.nodes.select(F.col("nid").alias(side), F.col("iri").alias(f"{side}_iri"))
    forward = kg.edges.where("etype % 2 = 0").join(kg.edge_types, "etype").join(iri("src"), "src").join(iri("dst"), "dst")
    forward.select(F.concat_ws(",", "src_iri", "dst_iri", "name")).write.text(edges)
    lines = kg.node_types.join(kg.nodes, "nid").groupBy("iri").agg(F.concat_ws(",", F.collect_list("type")).alias("types"))  # a node has few types
    lines.select(F.concat_ws(",", "iri", "types")).write.text(types)
    return graph_io.read_graph(kg.edges.sparkSession, edges, types)


def edge_file(kg, q):
    read = _files(kg)
    iri = lambda side: read.nodes.select(F.col("nid").alias(side), F.col("iri").alias(f"{side}_iri"))
    return read.edges.join(read.edge_types.where("not startswith(name, 'r-')"), "etype").join(iri("src"), "src").join(iri("dst"), "dst").select("src_iri", F.col("name").alias("label"), "dst_iri")


def type_file(kg, q):
    read = _files(kg)
    return read.node_types.join(read.nodes, "nid").select("iri", "type")


def pair_file(kg, q):
    at = _file(kg, "pairs")
    graph_io.write_pairs(q, at)
    return graph_io.read_pairs(q.sparkSession, kg, at).select("target", "context")


def snapshot(kg, q):
    at = _file(kg, "snapshot")
    graph_io.write_snapshot(kg, at)
    return graph_io.read_snapshot(q.sparkSession, at).edges.groupBy("etype").agg(F.count("*").alias("n"), F.sum("src").alias("sum_src"), F.sum("dst").alias("sum_dst"))


def snapshot_edges(kg, q):
    at = _file(kg, "snapshot")
    graph_io.write_snapshot(kg, at)
    return graph_io.read_snapshot(q.sparkSession, at).edges


def snapshot_relevance(kg, q):
    """Relevance over a graph that was written and read again, buckets and all."""
    at = _file(kg, "snapshot")
    graph_io.write_snapshot(kg, at)
    return engine.scores(graph_io.read_snapshot(q.sparkSession, at), q, BIDIRECTIONAL).withColumn("score", F.round("score", 9))


def pattern_support(hops):
    def run(kg, q):
        found = paths.simple_path_counts(kg, q, hops).select("etypes").distinct().transform(kept)
        return _text(explore.pattern_support(kg, found, hops), "etypes")

    return run


def top_path_patterns(hops):
    return lambda kg, q: explore.top_path_patterns(kg, q.select(F.col("target").alias("source"), F.col("context").alias("target")), hops, 10, 10)


def propagation(kg, q):
    name = star_schema.etype
    found = relevance.propagate(kg, _sources(q), [name("from_supplier") + 1, name("placed_by"), name("in_nation")])
    return found.withColumn("prob", F.round("prob", 10))


def size_bound(kg, q):
    rel = _rel(kg, q)
    return patterns.size_bound(kg, rel, q.select("context").distinct().withColumn("kth", F.lit(1e-4)))


def mined(config):
    return lambda kg, q: engine.mine(kg, q, config, _rel(kg, q))


def _supplier_pairs(kg):
    return kg.once("supplier pairs", lambda: star_schema.supplier_pairs(kg).transform(kept))


def _suppliers(kg):
    """All suppliers with their nations, and the relevance to these."""

    pairs = _supplier_pairs(kg)
    return pairs, kg.once("suppliers", lambda: engine.scores(kg, pairs, BIDIRECTIONAL).transform(kept))


def mine_every_supplier(kg, q):
    """The best facts of every supplier in the context of its nation, as one batch."""
    pairs, rel = _suppliers(kg)
    return engine.mine(kg, pairs, BIDIRECTIONAL.with_(top_facts=1), rel)


def pair_names(kg, q):
    """Every supplier and its nation as a file of names, beside a comment, a lone name and pairs with an unknown name, read again as ids."""
    at = _file(kg, "names")
    name = lambda side: kg.nodes.select(F.col("nid").alias(side), F.col("iri").alias(f"{side}_name"))
    named = _supplier_pairs(kg).join(name("target"), "target").join(name("context"), "context")
    lines = F.explode(F.array(F.concat_ws(" ", "target_name", "context_name"), F.concat("target_name", F.lit("  nobody")), F.concat(F.lit("# "), "target_name"), F.col("target_name")))
    named.select(lines.alias("value")).write.text(at)
    return graph_io.read_iri_pairs(q.sparkSession, kg, at).select("target", "context")


def _folder(kg):
    """What a folder of pair files, every supplier in the context of its nation, gives, and where its effective pairs are."""
    pairs, rel = _suppliers(kg)
    at, out = _file(kg, "folder"), _file(kg, "effective")
    pairs.select(F.concat_ws(" ", "target", "context").alias("value")).write.text(at)
    mine = lambda g, batch: engine.mine(g, batch, BIDIRECTIONAL.with_(top_facts=1), rel)
    return graph_io.process_folder(kg.edges.sparkSession, kg, at, out, mine), pairs, out


def mine_folder(kg, q):
    """The best facts of a folder of pair files, by pair."""
    found, pairs, _ = kg.once("folder", lambda: _folder(kg))
    by_pair = pairs.select(F.xxhash64("target", "context").alias("qid"), "target", "context")
    return by_pair.join(found, "qid").drop("qid")


def effective_pairs(kg, q):
    """The pairs of the folder that gave results, from the files written for them."""
    out = kg.once("folder", lambda: _folder(kg))[2]
    return graph_io.read_pairs(q.sparkSession, kg, out).select("target", "context")


def patterns_every_supplier(kg, q):
    pairs, rel = _suppliers(kg)
    best, _, _ = engine.ranked_sets(kg, engine.reachable(pairs, rel).transform(kept), rel, BIDIRECTIONAL)
    return best.select("qid", "rank", "pattern", "n_nodes", "relevance", "n_peers")


def pattern_names(kg, q):
    """The best patterns with the names of their edge types and nodes instead of ids."""
    _, _, best, named, held = _ranked(kg, q, BIDIRECTIONAL)
    members = named.join(held, "class").select("qid", "pattern", "nid")
    found, _ = _candidates(kg, q)
    return patterns.named(kg, best.join(found.select("qid", "pattern", "labels", "etypes"), ["qid", "pattern"]), members).select("qid", "rank", "text", "display")


def render_facts(kg, q):
    return engine.render(kg, engine.mine(kg, q, BIDIRECTIONAL.with_(top_facts=2), _rel(kg, q)))


def one_hop_facts(kg, q):
    """Which of a target's values are unusual among those who share one of its other values."""
    peers = paths.one_hop_peers(kg, q).withColumn("pattern", F.concat_ws("=", "etype", "value")).select("qid", "pattern", "nid")
    sets, scored = engine.score_facts(kg, q, engine.with_enough(peers, 5), BIDIRECTIONAL, most=5)
    return facts.top_facts(_named(sets, scored), 5, ["qid", "pattern"], True).select("qid", "pattern", "fact_rank", "etype", "value", "strikingness", "value_freq", "top_value", "top_freq")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: _kg(query)
    for name, query in {
        "kg_edges": lambda kg, q: kg.edges,
        "kg_edge_types": lambda kg, q: kg.edge_types,
        "kg_degree": lambda kg, q: graph.degrees(kg.edges),
        "edge_spread_ratio": lambda kg, q: graph.spread_ratio(kg.edges).withColumn("spread", F.round("spread", 10)),
        "etype_sources": lambda kg, q: graph.etype_sources(kg.edges),
        "neighbors_by_degree": lambda kg, q: graph.neighbours_by_degree(kg.edges),
        "first_value": lambda kg, q: graph.first_values(kg.edges),
        "relevance_scores": relevance_scores,
        "sampled_relevance": sampled_relevance,
        "total_relevance": lambda kg, q: relevance.total_relevance(_rel(kg, q)).withColumn("total", F.round("total", 8)),
        "type_relevance": type_relevance,
        "best_type": best_type,
        "edge_type_score_sum": lambda kg, q: relevance.edge_type_score_sum(kg, _rel(kg, q)).withColumn("score_sum", F.round("score_sum", 8)),
        "sequence_propagation": propagation,
        "one_hop_expand": one_hop_expand,
        "simple_paths": simple_paths,
        "simple_paths_3hop": simple_paths_3hop,
        "paths_by_mean_relevance": paths_by_mean_relevance,
        "paths_from_by_mean_relevance": paths_from_by_mean_relevance,
        "bidirectional_paths": between("bidirectional"),
        "reverse_paths": between("reverse"),
        "forward_paths": between("forward"),
        "reverse_index_2hop": reverse_index_2hop,
        "path_scores": path_scores,
        "best_paths": best_paths,
        "pattern_enumeration": pattern_enumeration,
        "match_sets_labelled": match_sets(BIDIRECTIONAL),
        "match_sets_edges": match_sets(REVERSE),
        "pattern_relevance": pattern_relevance,
        "top_patterns": ranked(BIDIRECTIONAL),
        "top_patterns_in_waves": top_patterns_in_waves,
        "pattern_bounds": pattern_bounds,
        "mine_counters": mine_counters,
        "threshold_patterns": ranked(THRESHOLD),
        "diversified_patterns": ranked(BIDIRECTIONAL.with_(diversify=True)),
        "reverse_patterns": ranked(REVERSE),
        "one_hop_peers": lambda kg, q: paths.one_hop_peers(kg, q),
        "one_hop_peers_first_value": lambda kg, q: paths.one_hop_peers(kg, q, first_value_only=True),
        "one_hop_facts": one_hop_facts,
        "peer_set_dedup": peer_set_dedup,
        "peer_jaccard": peer_jaccard,
        "merged_peer_sets": merged_peer_sets,
        "attribute_eligibility_peer": eligibility(facts.eligible_by_peers, 0.8),
        "attribute_eligibility_global": eligibility(facts.eligible_globally, 0.9),
        "value_frequency": value_frequency,
        "strikingness": strikingness,
        "most_frequent_value": most_frequent_value,
        "top_facts": top_facts,
        "diverse_top_facts": diverse_top_facts,
        "blind_end_node": blind_end_node,
        "blind_end_type": lambda kg, q: _sized(engine.blind_type_peers(kg, q, BLIND)),
        "blind_top_facts": blind_top_facts,
        "guided_facts": guided_facts,
        "pattern_probability": pattern_probability(2),
        "pattern_probability_forward": pattern_probability(2, True),
        "pattern_probability_3hop": pattern_probability(3),
        "scores_between": scores_between(2),
        "scores_between_3hop": scores_between(3),
        "edge_file": edge_file,
        "type_file": type_file,
        "pair_file": pair_file,
        "snapshot": snapshot,
        "snapshot_edges": snapshot_edges,
        "snapshot_relevance": snapshot_relevance,
        "pattern_support": pattern_support(2),
        "pattern_support_3hop": pattern_support(3),
        "top_path_patterns": top_path_patterns(2),
        "top_path_patterns_3hop": top_path_patterns(3),
        "size_bound": size_bound,
        "mine_bidirectional": mined(BIDIRECTIONAL),
        "mine_reverse": mined(REVERSE),
        "mine_naive": mined(NAIVE),
        "mine_every_supplier": mine_every_supplier,
        "patterns_every_supplier": patterns_every_supplier,
        "pair_names": pair_names,
        "mine_folder": mine_folder,
        "effective_pairs": effective_pairs,
        "pattern_names": pattern_names,
        "render_facts": render_facts,
    }.items()
}
QUERIES.update(
    {
        "kg_nodes": _nodes(lambda kg: kg.nodes),
        "kg_node_types": _nodes(lambda kg: kg.node_types),
        "specific_type": _nodes(lambda kg: graph.specific_type(kg.node_types)),
        "one_label": _nodes(lambda kg: graph.one_label(kg.nodes, kg.node_types)),
    }
)
