"""Graphs small enough to work out by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strikegraph.functions import columns
from strikegraph.operators import explore, facts, graph, paths, patterns, relevance
from strikegraph.operators.graph import KnowledgeGraph
from strikegraph.plans import engine
from strikegraph.plans.config import BIDIRECTIONAL
from strikegraph.sources import graph_io
from strikegraph.streaming.pairs import mine_arriving


def kg_of(spark, forward, types=()):
    """``forward``: (src, etype, dst) with even types."""
    edges = graph.both_directions(spark.createDataFrame(forward, "src long, etype int, dst long"))
    ids = sorted({n for s, _, d in forward for n in (s, d)})
    types = list(types) or [(n, "t") for n in ids]
    names = [(e + r, ("r-" if r else "") + f"e{e}") for e in sorted({e for _, e, _ in forward}) for r in (0, 1)]
    return KnowledgeGraph(spark.createDataFrame([(n, f"n/{n}") for n in ids], "nid long, iri string"), spark.createDataFrame(names, "etype int, name string"), spark.createDataFrame(types, "nid long, type string"), edges).cached()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_self_loops_and_repeats(spark):
    triples = spark.createDataFrame([("a", "a", "x"), ("a", "b", "x"), ("a", "b", "x"), ("a", "b", "y"), ("c", "c", "x")], "src_iri string, dst_iri string, label string")
    kg = graph.from_triples(triples, spark.createDataFrame([("a", "T"), ("a", "T"), ("a", "U"), ("c", "T"), ("zz", "T")], "iri string, type string"))
    assert rows(kg.nodes) == [(0, "a"), (1, "b"), (2, "c")]
    assert rows(kg.edges) == [(0, 0, 1), (0, 2, 1), (1, 1, 0), (1, 3, 0)]
    assert rows(kg.node_types) == [(0, "T"), (0, "U")]
    assert rows(kg.edge_types) == [(0, "x"), (1, "r-x"), (2, "y"), (3, "r-y")]


def test_spread_and_order(spark):
    kg = kg_of(spark, [(1, 0, 2), (1, 0, 3), (1, 2, 4), (5, 0, 3)])
    assert (1, 0, 0.5) in rows(graph.spread_ratio(kg.edges)) and (1, 2, 1.0) in rows(graph.spread_ratio(kg.edges))
    assert [r for r in rows(graph.neighbours_by_degree(kg.edges)) if r[:2] == (1, 0)] == [(1, 0, 2, 2), (1, 0, 3, 1)]
    assert (1, 0, 3) in rows(graph.first_values(kg.edges))


def test_relevance_closed_form(spark):
    kg = kg_of(spark, [(1, 0, 2)])
    got = {n: s for _, n, s in rows(relevance.relevance(kg, spark.createDataFrame([(1,)], "context long")))}
    a = 0.85 * sum(0.15 ** (2 * k) for k in range(5))
    b = 0.85 * sum(0.15 ** (2 * k + 1) for k in range(4))
    assert abs(got[1] - a) < 1e-9 and abs(got[2] - b) < 1e-9
    assert abs(sum(got.values()) - (1 - 0.15**9)) < 1e-9


@pytest.fixture(scope="module")
def web(spark):
    """Targets 1, 2 and 3 reach context 9 through 5 or 6; 7 is a dead end that ends at 5 by another type."""
    forward = [(1, 0, 5), (2, 0, 5), (3, 0, 6), (5, 2, 9), (6, 2, 9), (7, 4, 5), (1, 6, 9), (8, 0, 4), (1, 8, 20), (2, 8, 20), (3, 8, 21), (1, 8, 22)]
    types = [(n, "p") for n in (1, 2, 3, 7, 8)] + [(1, "q"), (5, "m"), (6, "m"), (4, "m"), (9, "c"), (20, "v"), (21, "v"), (22, "v")]
    kg = kg_of(spark, forward, types)
    q = spark.createDataFrame([(1, 1, 9)], "qid int, target long, context long")
    return kg, q, relevance.relevance(kg, q.select("context")).persist()


@pytest.mark.parametrize("how", ["bidirectional", "reverse", "forward"])
def test_paths(web, how):
    kg, q, rel = web
    got = {tuple(r.nodes): tuple(r.etypes) for r in paths.paths_between(kg, q, rel, 4, 2, how).collect()}
    assert got[1, 9] == (6,) and got[1, 5, 9] == (0, 2)
    assert all(len(set(n)) == len(n) and n[0] == 1 and n[-1] == 9 for n in got)
    assert set(got) == {(1, 9), (1, 5, 9)}


def test_three_edges_all_ways_agree(spark):
    forward = [(1, 0, 2), (2, 0, 3), (3, 0, 4), (1, 2, 3), (2, 2, 4), (5, 0, 4), (2, 0, 5), (1, 4, 5)]
    kg = kg_of(spark, forward)
    q = spark.createDataFrame([(1, 1, 4), (2, 5, 1)], "qid int, target long, context long")
    rel = relevance.relevance(kg, q.select("context")).persist()
    found = [sorted((r.qid, tuple(r.nodes), tuple(r.etypes)) for r in paths.paths_between(kg, q, rel, 4, 2, how).collect()) for how in ("bidirectional", "reverse", "forward")]
    assert found[0] == found[1] == found[2] and (1, (1, 2, 3, 4), (0, 0, 0)) in found[0]
    assert len(found[0]) == len(set(found[0]))


def test_path_score_and_labels(web):
    kg, q, rel = web
    s = {n: x for _, n, x in rows(rel)}
    scored = {tuple(r.nodes): r.path_score for r in paths.path_scores(paths.paths_between(kg, q, rel, 4, 2), rel).collect()}
    assert abs(scored[1, 5, 9] - round(min(s[1], s[5] / math.e, s[9] / math.e**2), 12)) < 1e-12
    types = relevance.type_relevance(kg, rel, q)
    by_type = {t: x for _, t, x in rows(types)}
    assert abs(by_type["m"] - (s.get(5, 0) + s.get(6, 0) + s.get(4, 0)) / 3) < 1e-9
    found = patterns.labelled_patterns(kg, paths.path_scores(paths.paths_between(kg, q, rel, 4, 3), rel), types)
    assert sorted(r.pattern for r in found.collect()) == ["T:p|0|I:5|2|I:9", "T:p|0|T:m|2|I:9"]


def test_match_sets_are_trimmed_both_ways(web):
    kg, q, rel = web
    found = patterns.labelled_patterns(kg, paths.path_scores(paths.paths_between(kg, q, rel, 4, 3), rel), relevance.type_relevance(kg, rel, q))
    sets = {}
    for r in patterns.match_sets(kg, found, 4).collect():
        sets.setdefault((r.pattern, r.level), set()).add(r.nid)
    assert sets["T:p|0|T:m|2|I:9", 0] == {1, 2, 3} and sets["T:p|0|T:m|2|I:9", 1] == {5, 6} and sets["T:p|0|T:m|2|I:9", 2] == {9}
    assert sets["T:p|0|I:5|2|I:9", 0] == {1, 2} and sets["T:p|0|I:5|2|I:9", 1] == {5}
    few = patterns.match_sets(kg, found, 4, True, 3).select("pattern").distinct().collect()
    assert [r.pattern for r in few] == ["T:p|0|T:m|2|I:9"]


def test_named_nodes_behind_a_hub_share_their_peers(spark):
    """Thirty patterns, one for each member of hub 500 that leads to 900, have the same thirty peers, which are found and held once."""
    n = 30
    kg = kg_of(spark, [(i, 0, 500) for i in range(1, n + 1)] + [(i, 2, 900) for i in range(1, n + 1)])
    found = spark.createDataFrame([(1, 900, f"T:t|0|I:500|1|I:{i}|2|I:900", ["T:t", "I:500", f"I:{i}", "I:900"], [0, 1, 2], 0.5) for i in range(1, n + 1)], "qid int, context long, pattern string, labels array<string>, etypes array<int>, path_score double")
    suffixes = patterns.suffix_sets(kg, found, 4, True)
    assert suffixes.sets[3].count() == n and suffixes.sets[2].count() == 1 and suffixes.sets[1].count() == n
    assert max(m.count() for m in suffixes.moves.values()) == n
    assert suffixes.patterns.select("peers").distinct().count() == 1
    got = {}
    for r in patterns.match_sets(kg, found, 4).collect():
        got.setdefault((r.pattern, r.level), set()).add(r.nid)
    for i in range(1, n + 1):
        assert [got[f"T:t|0|I:500|1|I:{i}|2|I:900", k] for k in range(4)] == [set(range(1, n + 1)), {500}, {i}, {900}]


def test_sets_with_equal_sums_are_compared_by_member(spark):
    sets = spark.createDataFrame([(k, n) for k, ns in {"a": (1, 2), "b": (2, 1), "c": (1, 3)}.items() for n in ns], "key string, nid long")
    classes, members = patterns.equal_sets(sets, "1:")
    of = {r.key: (r["class"], r.n) for r in classes.collect()}
    assert of["a"] == of["b"] != of["c"] and {n for _, n in of.values()} == {2}
    assert rows(members.select("nid")) == [(1,), (1,), (2,), (3,)]


def test_node_queries_write_no_edges(spark, monkeypatch):
    from strikegraph.plans import queries

    def refuse(*_):
        raise AssertionError("edges were written")

    queries._GRAPHS.clear()
    monkeypatch.setattr(graph, "sliced_edges", refuse)
    for name in ("kg_nodes", "kg_node_types", "specific_type", "one_label"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_pair_names_need_no_relevance(spark, monkeypatch):
    from strikegraph.plans import queries

    def refuse(*_):
        raise AssertionError("relevance was worked out")

    queries.forget()
    monkeypatch.setattr(engine, "scores", refuse)
    assert queries.QUERIES["pair_names"](spark, "/root/testdata/sf0.001").count() > 0


def test_waves_prune_nothing(web):
    kg, q, rel = web
    found = patterns.labelled_patterns(kg, paths.path_scores(paths.paths_between(kg, q, rel, 4, 2), rel), relevance.type_relevance(kg, rel, q)).persist()
    plain = patterns.top_patterns(patterns.pattern_relevance(patterns.match_sets(kg, found, 4), found, rel), 2)
    suffixes = patterns.suffix_sets(kg, found, 4, True)
    known = patterns.bounds(suffixes, rel).persist()
    for prune in patterns.BOUNDS:
        done = patterns.evaluated(kg, suffixes, known, rel, 2, 1, True, prune, first=1)
        assert rows(patterns.top_patterns(done.relevance, 2)) == rows(plain), prune
        fates = {r.fate for r in done.fates.collect()}
        assert "evaluated" in fates and (prune != "none" or fates <= {"evaluated", "rejected"})


def star(spark):
    """Target 100 and seven peers; attribute 0 with values u = 1, v = 2, w = 3."""
    values = {101: 1, 102: 1, 103: 1, 104: 1, 105: 2, 106: 3, 100: 2}
    return kg_of(spark, [(p, 0, v) for p, v in values.items()] + [(100, 0, 1), (100, 0, 3)])


def test_strikingness(spark):
    kg = star(spark)
    q = spark.createDataFrame([(1, 100, 1)], "qid int, target long, context long")
    members = spark.createDataFrame([(1, "s", n) for n in range(100, 107)], "qid int, set_id string, nid long")
    asked = facts.target_facts(kg, q)
    eligible = facts.eligible_by_peers(kg, members, asked, 0.8)
    got = {r.value: (r.strikingness, r.value_freq, r.top_value, r.top_freq) for r in facts.strikingness(facts.value_frequency(kg, members, asked, eligible)).collect()}
    assert got[2] == (round(4 / 7, 10), 2, 1, 4) and got[1] == (0.0, 5, 1, 5)
    assert got[3] == (round(4 / 7, 10), 2, 1, 4)


def test_first_value_and_match(spark):
    forward = [(1, 0, 50), (2, 0, 50), (3, 0, 50), (4, 0, 50), (4, 0, 60), (5, 0, 50), (5, 0, 70), (9, 0, 60)]
    kg = kg_of(spark, forward)
    q = spark.createDataFrame([(1, 9, 50)], "qid int, target long, context long")
    members = spark.createDataFrame([(1, "s", n) for n in (4, 5, 9)], "qid int, set_id string, nid long")
    asked = facts.target_facts(kg, q)
    got = {r.x: r.f for r in facts.value_frequency(kg, members, asked, facts.eligible_by_peers(kg, members, asked, 0.8)).collect()}
    assert got == {60: 2, 50: 1}


def test_eligibility(spark):
    forward = [(n, 0, 50) for n in range(8)] + [(n, 2, 51) for n in range(7)] + [(8, 4, 52), (9, 4, 52)]
    kg = kg_of(spark, forward)
    q = spark.createDataFrame([(1, 0, 50)], "qid int, target long, context long")
    members = spark.createDataFrame([(1, "s", n) for n in range(10)], "qid int, set_id string, nid long")
    assert [r.etype for r in facts.eligible_by_peers(kg, members, facts.target_facts(kg, q), 0.8).collect()] == [0]
    assert sorted(r.etype for r in facts.eligible_globally(kg, members, facts.target_facts(kg, q), 0.7).collect()) == [0, 2]


def test_irrelevant_target_gives_no_rows(spark):
    kg = kg_of(spark, [(1, 0, 2), (3, 0, 4)])
    q = spark.createDataFrame([(1, 3, 1)], "qid int, target long, context long")
    assert engine.mine(kg, q, BIDIRECTIONAL).count() == 0


def test_equal_peers_are_scored_once(spark):
    members = spark.createDataFrame([(1, p, n) for p in "ab" for n in (1, 2, 3)] + [(1, "c", 1), (1, "c", 2), (1, "c", 4)], "qid int, pattern string, nid long")
    sets, once = patterns.distinct_peer_sets(members)
    assert sets.select("set_id").distinct().count() == 2 and once.count() == 6
    assert rows(patterns.peer_jaccard(members, 0.6)) == [(1, "a", "b", 0.0), (1, "a", "c", 0.5), (1, "b", "c", 0.5)]


@pytest.mark.parametrize("limit", [0.1, 0.3, 1.0])
def test_prefixes_lose_no_close_pair(spark, limit):
    rnd = random.Random(5)
    sets = {}
    for i in range(60):
        base = list(sets[rnd.randrange(i)]) if i and rnd.random() < 0.7 else rnd.sample(range(300), rnd.choice([1, 2, 9, 10, 40, 120]))
        kept_members = [n for n in base if rnd.random() > 0.04] or base
        sets[i] = set(kept_members) | set(rnd.sample(range(300), len(base) // 20))
    members = spark.createDataFrame([(q, f"{i:02}", n) for q in (1, 2) for i, s in sets.items() for n in s if q == 1 or i % 3], "qid int, pattern string, nid long")
    want = set()
    for q in (1, 2):
        live = [i for i in sets if q == 1 or i % 3]
        far = {(a, b): 1 - len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in live for b in live if a < b}
        want |= {(q, f"{a:02}", f"{b:02}", round(d, 8)) for (a, b), d in far.items() if round(d, 10) < limit}
    got = patterns.peer_jaccard(members, limit).collect()
    assert {(*tuple(r)[:3], round(r.distance, 8)) for r in got} == want and len(got) == len(want) > 0
    if limit == 0.1:
        assert patterns.prefixes(members, limit).count() < members.count() / 2


def test_close_peer_sets_are_merged_along_chains(spark):
    sizes = {"d": range(0, 20), "c": range(0, 21), "b": range(0, 22), "a": range(0, 23), "e": range(0, 20), "far": range(100, 120)}
    members = spark.createDataFrame([(q, p, n) for q in (1, 2) for p, ns in sizes.items() for n in ns if (q, p) != (2, "b")], "qid int, pattern string, nid long")
    got = rows(patterns.merged_peer_sets(members, 0.05))
    assert got == [(1, p, "far" if p == "far" else "a") for p in sorted(sizes)] + [(2, "a", "a"), (2, "c", "c"), (2, "d", "c"), (2, "e", "c"), (2, "far", "far")]
    assert rows(patterns.merged_peer_sets(members.limit(0))) == []


def test_columns(spark):
    row = spark.createDataFrame([([1, 2, 3], [0, 3], ["a", "b", "c"])], "n array<long>, e array<int>, l array<string>").select(
        columns.reverse_etypes("e"), columns.signature("n"), columns.interleave("l", "e"), columns.is_simple("n"), columns.parse_signature(F.lit("4-5")), columns.unpack_edge(columns.pack_edge(F.lit(7), F.lit(9)))[0],
        columns.jaccard_distance("n", F.array(F.lit(2).cast("long"), F.lit(3).cast("long"))),
    ).first()
    assert row[:6] == ([2, 1], "1-2-3", "a|0|b|3|c", True, [4, 5], 7) and abs(row[6] - 1 / 3) < 1e-12


def test_propagation_and_support(spark):
    kg = kg_of(spark, [(1, 0, 2), (1, 0, 3), (2, 2, 4), (3, 2, 4), (3, 2, 5)])
    got = {r.nid: r.prob for r in relevance.propagate(kg, spark.createDataFrame([(1,)], "source long"), [0, 2]).collect()}
    assert got == {4: 0.75, 5: 0.25}
    p = {(tuple(r.etypes), r.nid): (r.forward, r.backward) for r in explore.pattern_probability(kg, spark.createDataFrame([(1,)], "source long"), 2, forward_only=True).collect()}
    assert p[(0, 2), 4] == (0.75, 1.0) and p[(0, 2), 5] == (0.25, 1.0)
    assert rows(explore.pattern_support(kg, spark.createDataFrame([([0, 2],)], "etypes array<int>"), 2)) == [([0, 2], 2)]


def test_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text('a,b,x\nb,c,y\na,a,x\n"q,b,x\n')
    (tmp_path / "t.csv").write_text("a,T,,U\nb\na,V\nnone,T\n")
    kg = graph_io.read_graph(spark, f"{tmp_path}/e.csv", f"{tmp_path}/t.csv")
    ids = {r.iri: r.nid for r in kg.nodes.collect()}
    assert set(ids) == {"a", "b", "c", '"q'} and sorted(r.type for r in kg.node_types.collect()) == ["T", "U", "V"]
    graph_io.write_snapshot(kg, f"{tmp_path}/snap")
    again = graph_io.read_snapshot(spark, f"{tmp_path}/snap")
    assert all(rows(getattr(again, n)) == rows(getattr(kg, n)) for n in graph_io.TABLES)
    assert {r.short for r in graph_io.short_iri(kg.nodes, 1).collect()} == {"", "q"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.txt").write_text(f"# c\n\n{ids['a']} {ids['c']}\n")
    (tmp_path / "in/two.txt").write_text("Q1 Q2\n7\n")
    assert [tuple(r)[1:] for r in graph_io.read_pairs(spark, kg, f"{tmp_path}/in").collect()] == [(ids["a"], ids["c"])]
    (tmp_path / "iri.txt").write_text("a c\na nobody\n")
    pairs = graph_io.read_iri_pairs(spark, kg, f"{tmp_path}/iri.txt")
    graph_io.write_pairs(pairs, f"{tmp_path}/pairs")
    assert spark.read.text(f"{tmp_path}/pairs").first()[0] == f"{ids['a']} {ids['c']}"
    graph_io.process_folder(spark, kg, f"{tmp_path}/in", f"{tmp_path}/out", lambda kg, q: q)
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == [f"{ids['a']} {ids['c']}"]
    mine_arriving(spark, kg, f"{tmp_path}/in", f"{tmp_path}/mined", f"{tmp_path}/check", lambda kg, q: q).awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/mined").count() == 1


def test_rounded_decides_ties_by_the_scaled_double(spark):
    values = [6.27015e-06, 0.125, 0.5, 0.0, 1.0]
    from strikegraph.functions.columns import rounded

    got = spark.createDataFrame([(v,) for v in values], "v double").select(rounded("v", 10).alias("r"), rounded(F.col("v"), 2).alias("s")).collect()
    assert [row.r for row in got] == [math.floor(v * 1e10 + 0.5) / 1e10 for v in values]
    assert [row.s for row in got] == [0.0, 0.13, 0.5, 0.0, 1.0]


def hub_graph(spark):
    """Node 1 is a hub of 40 spokes; some spokes hang together."""
    forward = [(100 + i, 0, 1) for i in range(40)] + [(100 + i, 2, 100 + (i * 7 + 3) % 40) for i in range(0, 40, 3)] + [(1, 4, 2), (2, 4, 3), (100, 4, 3)]
    return kg_of(spark, forward), forward


def plain_relevance(forward, context, stop=0.85, hops=8):
    out = {}
    for s, _, d in set(forward):
        if s != d:
            out.setdefault(s, []).append(d)
            out.setdefault(d, []).append(s)
    mass, total = {context: 1.0}, {context: stop}
    for k in range(1, hops + 1):
        step = {}
        for n, m in mass.items():
            for x in out.get(n, ()):
                step[x] = step.get(x, 0.0) + m / len(out[n])
        mass = step
        for n, m in mass.items():
            total[n] = total.get(n, 0.0) + m * stop * (1 - stop) ** k
    return {n: s for n, s in total.items() if round(s, 12) >= 1e-6}


@pytest.mark.parametrize("lanes,edges", [(16, 10_000), (2, 7), (1, 1)])
def test_relevance_by_lanes_and_slices(spark, monkeypatch, lanes, edges):
    monkeypatch.setattr(relevance, "LANES", lanes)
    monkeypatch.setattr(graph, "SLICE_EDGES", edges)
    kg, forward = hub_graph(spark)
    contexts = [1, 2, 3, 105, 117]
    got = relevance.relevance(kg, spark.createDataFrame([(c,) for c in [*contexts, 1, 999]], "context long")).collect()
    for c in contexts:
        want = plain_relevance(forward, c)
        found = {r.nid: r.score for r in got if r.context == c}
        assert set(found) == set(want) and all(abs(found[n] - want[n]) < 1e-10 for n in want)
    assert [(r.nid, r.score) for r in got if r.context == 999] == [(999, 0.85)]  # a node without edges keeps what stops at once
    if edges == 7:
        moves, hubs = kg.moves()
        assert {tuple(r) for r in hubs.collect()} == {(1, 6)}
        assert moves.where("src = 1").groupBy("slice").count().count() == 6


def planned(df):
    """The physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_steps_of_a_walk_are_not_moved(spark):
    kg, _ = hub_graph(spark)
    moves, _ = kg.moves()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state = spark.createDataFrame([(1, 0, 1.0)], "nid long, slice int, m double").repartition(3)
        plan = planned(state.join(moves, (state.nid == moves.src) & (state.slice == moves.slice)))
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
        plan = planned(graph.follow(kg, state.select(F.col("nid").alias("src"), "m")))
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hop_meets_a_row_for_each_node_in_place(spark, monkeypatch):
    monkeypatch.setattr(graph, "SLICE_EDGES", 7)
    kg, forward = hub_graph(spark)
    ends = [(a, b) for s, e, d in set(forward) if s != d for a, b in ((s, d), (d, s))]
    found = kg.adjacency().selectExpr("src", "slice", "size(out) n", "degree").collect()
    assert len(found) == len({s for s, _ in ends}) + 5  # the hub's six slices
    assert {r.src: r.degree for r in found} == {n: sum(s == n for s, _ in ends) for n, _ in ends} and sum(r.n for r in found) == len(ends)
    assert "Exchange hashpartitioning" not in planned(kg.adjacency())
    assert rows(kg.first_values()) == rows(graph.first_values(kg.edges))


def test_repeated_edges_are_dropped_in_their_buckets(spark, monkeypatch):
    monkeypatch.setattr(graph, "SLICE_EDGES", 3)
    forward = spark.createDataFrame([(1, 0, 2)] * 9 + [(1, 0, 1), (3, 0, 2), (3, 2, 2), (4, 0, 2), (5, 0, 2)], "src long, etype int, dst long")
    ids = spark.createDataFrame([(n, str(n)) for n in range(1, 6)], "nid long, iri string")
    kg = KnowledgeGraph(ids, spark.createDataFrame([(0, "a")], "etype int, name string"), ids.toDF("nid", "type"), graph.both_directions(forward), repeated=graph.turned(forward)).cached()
    assert rows(kg.edges) == rows(graph.both_directions(forward)) and kg.edges.count() == 10
    assert {tuple(r) for r in kg.adjacency().where("src = 2").select("degree").collect()} == {(5,)}


def test_snapshot_keeps_its_buckets(spark, tmp_path):
    kg, _ = hub_graph(spark)
    graph_io.write_snapshot(kg, f"{tmp_path}/snap")
    spark.conf.set("spark.sql.shuffle.partitions", "3")  # another session's number of partitions
    try:
        again = graph_io.read_snapshot(spark, f"{tmp_path}/snap")
        assert rows(again.edges) == rows(kg.edges) and rows(again.nodes) == rows(kg.nodes)
        assert "SelectedBucketsCount" in planned(again.out_edges()[0].groupBy("src", "slice").count())
        assert rows(relevance.relevance(again, spark.createDataFrame([(1,)], "context long"))) == rows(relevance.relevance(kg, spark.createDataFrame([(1,)], "context long")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_relevance_takes_masses_of_nodes_with_most_edges(spark, monkeypatch):
    contexts = spark.createDataFrame([(1,), (9,)], "context long")
    found = []
    for most in (0, 3, 1 << 20):  # of no node, of some, of all
        kg, _ = hub_graph(spark)
        monkeypatch.setattr(relevance, "PULLED", 2 * most)
        found.append(rows(relevance.relevance(kg, contexts)))
        top = relevance.tops(kg, most)
        assert (top is None) == (most == 0)
        if top:
            degrees = {r.nid: r.degree for r in graph.degrees(kg.edges).collect()}
            assert {r.nid: r.degree for r in top[0].collect()} == {n: d for n, d in degrees.items() if d >= top[1]} and top[2] == top[0].count() <= most
    assert found[0] and found[0] == found[1] == found[2]


def test_snapshot_has_as_many_buckets_as_its_graph(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph, "BUCKET_EDGES", 2)  # as in a graph of more edges than the usual buckets take
    forward = spark.createDataFrame([(n, 0, n + 100) for n in range(20)], "src long, etype int, dst long")
    ids = spark.createDataFrame([(n, str(n)) for m in range(20) for n in (m, m + 100)], "nid long, iri string")
    kg = KnowledgeGraph(ids, spark.createDataFrame([(0, "a")], "etype int, name string"), ids.toDF("nid", "type"), graph.both_directions(forward), repeated=graph.turned(forward)).cached()
    graph_io.write_snapshot(kg, f"{tmp_path}/snap")
    again = graph_io.read_snapshot(spark, f"{tmp_path}/snap")
    assert spark.read.parquet(f"{tmp_path}/snap/layout").first()[0] == kg.packed.buckets == 20
    assert rows(again.edges) == rows(kg.edges) and "Exchange hashpartitioning(src" not in planned(again.adjacency())


def walks_of(forward, start, hops):
    """All non-returning walks ``(etypes, nodes)`` with the shares of their steps, forward and back."""
    edges = sorted({(s, e, d) for s, e, d in forward if s != d})
    edges += [(d, e + 1, s) for s, e, d in edges]
    share = {}
    for s, e, _ in edges:
        share[s, e] = share.get((s, e), 0) + 1
    level, out = [((), (start,), 1.0, 1.0)], []
    for _ in range(hops):
        level = [(es + (e,), ns + (d,), f / share[s, e], b / share[d, e ^ 1]) for es, ns, f, b in level for s, e, d in edges if s == ns[-1] and (len(ns) < 2 or d != ns[-2])]
        out += level
    return out


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_probabilities_and_counts_to_three_hops(spark, hops):
    kg, forward = hub_graph(spark)
    walks = walks_of(forward, 100, hops)
    want = {}
    for es, ns, f, b in walks:
        have = want.setdefault((es, ns[-1]), [0.0, 0.0])
        have[0] += f
        have[1] += b
    got = {(tuple(r.etypes), r.nid): (r.forward, r.backward) for r in explore.pattern_probability(kg, spark.createDataFrame([(100,)], "source long"), hops).collect()}
    assert set(got) == set(want) and all(abs(got[k][0] - want[k][0]) < 1e-9 and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    simple = {}
    for es, ns, _, _ in walks:
        if len(set(ns)) == len(ns):
            simple[es, ns[-1]] = simple.get((es, ns[-1]), 0) + 1
    q = spark.createDataFrame([(1, 100, 3)], "qid int, target long, context long")
    assert {(tuple(r.etypes), r.end): r.n_paths for r in paths.simple_path_counts(kg, q, hops).collect()} == simple


def test_sampled_walks_tend_to_the_series(spark):
    kg, forward = hub_graph(spark)
    contexts = spark.createDataFrame([(1,), (100,), (999,), (1,)], "context long")
    got = relevance.sampled_relevance(kg, contexts, walks=40_000, seed=3).collect()
    for c in (1, 100):
        exact = plain_relevance(forward, c, hops=20)
        found = {r.nid: r.score for r in got if r.context == c}
        assert sum(r.visits for r in got if r.context == c) == 40_000
        assert all(abs(found.get(n, 0.0) - s) < 5 * (s / 40_000) ** 0.5 + 1e-9 for n, s in exact.items())
    assert [(r.nid, r.visits) for r in got if r.context == 999] == [(999, 40_000)]
    again = relevance.sampled_relevance(KnowledgeGraph(kg.nodes, kg.edge_types, kg.node_types, kg.edges.repartition(7)), contexts.repartition(5), walks=40_000, seed=3)
    assert rows(again) == sorted(tuple(r) for r in got)


@pytest.mark.parametrize("k,first", [(1, 1), (3, 1), (5, 2), (50, None)])
def test_best_paths_are_the_best_of_all(spark, k, first):
    forward = [(1, 0, 2), (2, 0, 3), (3, 0, 4), (1, 2, 3), (2, 2, 4), (5, 0, 4), (2, 0, 5), (1, 4, 5), (1, 6, 4), (6, 0, 1), (6, 2, 4), (7, 0, 2), (7, 2, 3)]
    kg = kg_of(spark, forward, [(n, "t") for n in (1, 2, 3, 4, 6, 7)])  # node 5 has no type, so no path goes through it
    q = spark.createDataFrame([(1, 1, 4), (2, 7, 1), (3, 5, 4)], "qid int, target long, context long")
    rel = relevance.relevance(kg, q.select("context")).persist()
    every = paths.path_scores(paths.paths_between(kg, q, rel, 4, 2), rel).collect()
    text = lambda xs: "-".join(map(str, xs))
    want = {i: sorted(((-r.path_score, text(r.nodes), text(r.etypes)) for r in every if r.qid == i))[:k] for i in (1, 2, 3)}
    got = {i: [] for i in want}
    for r in sorted(paths.best_paths(kg, q, rel, k, first=first).collect(), key=lambda r: r["rank"]):
        got[r.qid].append((-r.path_score, text(r.nodes), text(r.etypes)))
    assert got == want


def test_patterns_by_name(web):
    kg, q, rel = web
    config = BIDIRECTIONAL.with_(min_peers=1, min_path_nodes=2)
    found = engine.candidate_patterns(kg, q, rel, config)
    best, members = engine.ranked_patterns(kg, q, rel, config)
    got = {r.text: r.display for r in patterns.named(kg, best.join(found.select("qid", "pattern", "labels", "etypes"), ["qid", "pattern"]), members).collect()}
    assert got["p -e0-> m -e2-> n/9"] == "p" and "p -e0-> n/5 -e2-> n/9" in got


def test_the_last_hop_goes_to_nodes_that_may_count(spark, monkeypatch):
    """A hop to nodes that can't reach the least score is left out, and no score changes."""
    written = []
    monkeypatch.setattr(relevance, "kept", lambda df: written.append(df.localCheckpoint()) or written[-1])
    forward = [(0, 0, 1), (1, 0, 2)] + [(2, 0, n) for n in range(100, 400)] + [(n, 0, 2000 + 10 * n + i) for n in range(100, 400) for i in range(10)]
    kg = kg_of(spark, forward)
    got = {r.nid: r.score for r in relevance.relevance(kg, spark.createDataFrame([(0,)], "context long")).collect()}
    want = plain_relevance(forward, 0)
    assert set(got) == set(want) and all(abs(got[n] - want[n]) < 1e-10 for n in want)
    states = [df.count() for df in written if "m0" in df.columns]
    assert len(states) == 9 and states[7] == 301 and states[8] == 2
    every = relevance.relevance(kg, spark.createDataFrame([(0,)], "context long"), min_score=0.0)
    assert every.count() == 3303


def test_edges_are_written_once_as_a_row_for_each_node(spark, monkeypatch):
    monkeypatch.setattr(graph, "BUCKET_EDGES", 20)
    kg, forward = hub_graph(spark)
    whole = 2 * len({e for e in forward if e[0] != e[2]})
    assert kg.edges.count() == whole and kg.packed.buckets == -(-whole // 20) > 4  # more buckets than shuffles have
    monkeypatch.setattr(graph, "bucketed", lambda *a, **k: pytest.fail("edges are written again"))
    assert {r.src: r.degree for r in kg.adjacency().collect()}[1] == 41
    met = graph.follow(kg, spark.createDataFrame([(7, 1), (8, 2)], "qid long, src long"))
    assert rows(met.select("qid", "etype", "dst")) == sorted((q, e, d) for q, n in ((7, 1), (8, 2)) for s, e, d in rows(kg.edges) if s == n)


def test_walks_move_no_other_edges(spark, monkeypatch):
    """Shares, supports and holders of values come from the edges of the nodes concerned; no join goes over all edges."""
    kg, forward = hub_graph(spark)
    want = rows(kg.edges)
    real, followed = graph.follow, []
    counted = lambda g, r: followed.append(1) or real(g, r)
    monkeypatch.setattr(explore, "follow", counted)
    monkeypatch.setattr(facts, "follow", counted)
    found = rows(explore.spread_edges(kg, spark.createDataFrame([(1,), (2,)], "src long")).select("src", "etype", "dst", "spread", "back"))
    share = lambda n, e: 1.0 / sum(s == n and t == e for s, t, _ in want)
    assert found == sorted((s, e, d, share(s, e), share(d, e ^ 1)) for s, e, d in want if s in (1, 2)) and len(followed) == 2
    assert rows(facts.target_facts(kg, spark.createDataFrame([(1, 2, 9)], "qid int, target long, context long"))) == sorted((1, s, e, d) for s, e, d in want if s == 2) and len(followed) == 3


def test_backward_half_is_walked_once_for_a_context(spark, monkeypatch):
    """Thirty targets share context 900, to which forty nodes lead: its half of the paths holds forty rows, not forty for each target."""
    kg = kg_of(spark, [(i, 0, 500 + i % 3) for i in range(1, 31)] + [(n, 2, 900) for n in range(500, 540)])
    q = spark.createDataFrame([(i, i, 900) for i in range(1, 31)], "qid int, target long, context long")
    rel = spark.createDataFrame([(900, n, 0.5) for n in [*range(1, 31), *range(500, 540), 900]], "context long, nid long, score double")
    written, write = [], paths.kept
    monkeypatch.setattr(paths, "kept", lambda df: written.append(write(df)) or written[-1])
    found = paths.paths_between(kg, q, rel, 4, 2)
    assert sorted(tuple(r.nodes) for r in found.collect()) == [(i, 500 + i % 3, 900) for i in range(1, 31)]
    assert max(w.count() for w in written) <= 71  # the inner nodes; one row each for 30 targets, 40 for the context


def test_type_scores_are_added_up_once_for_a_context(spark):
    kg = kg_of(spark, [(n, 0, 9) for n in range(1, 5)], [(1, "p"), (2, "p"), (3, "p"), (4, "alone"), (9, "c")])
    rel = spark.createDataFrame([(9, 1, 0.1), (9, 2, 0.2), (9, 4, 0.3), (9, 9, 0.9)], "context long, nid long, score double")
    q = spark.createDataFrame([(n, n, 9) for n in (1, 2, 3, 4)], "qid int, target long, context long")
    got = {(r.qid, r.type): r.score for r in relevance.type_relevance(kg, rel, q).collect()}
    p = {1: 0.1, 2: 0.05, 3: 0.15, 4: 0.1}
    assert got == {**{(n, "p"): x for n, x in p.items()}, **{(n, "c"): 0.9 for n in p}, **{(n, "alone"): 0.3 for n in (1, 2, 3)}}


@pytest.mark.parametrize("few_edges", [2, 256])
def test_facts_of_a_set_that_queries_share(spark, monkeypatch, few_edges):
    """A set is held once for all queries; its facts, all or the best of them, are those of ``value_frequency`` by query."""
    monkeypatch.setattr(facts, "FEW_EDGES", few_edges)
    rnd = random.Random(6)
    forward = {(n, e, 100 + 50 * e + rnd.randrange(rnd.choice([3, 25]))) for n in range(30) for e in (0, 2) for _ in range(1 if e else rnd.randrange(1, 6))}
    kg = kg_of(spark, sorted(forward))
    q = spark.createDataFrame([(i, t, 100) for i, t in enumerate((1, 2, 3, 29))], "qid int, target long, context long")
    sets = {7: list(range(30)), 8: [1, 2, 5, 8, 9, 11], 9: [0, 3, 4, 29]}
    once = spark.createDataFrame([(k, n) for k, ns in sets.items() for n in ns], "set_id long, nid long")
    named = spark.createDataFrame([(i, f"p{k}", k, len(sets[k])) for i in range(4) for k in sets], "qid int, pattern string, set_id long, n_peers long")
    members, asked = named.select("qid", "set_id").join(once, "set_id").select("qid", "set_id", "nid"), facts.target_facts(kg, q)
    plain = facts.strikingness(facts.value_frequency(kg, members, asked, facts.eligible_by_peers(kg, members, asked, 0.8)))
    want = rows(plain.select("qid", "set_id", "etype", "value", "strikingness", "value_freq", "top_value", "top_freq", "population"))
    got = lambda most: engine.score_sets(kg, q, named, once, BIDIRECTIONAL, most=most)[1].select("qid", "set_id", "etype", "value", "strikingness", "value_freq", "top_value", "top_freq", "population")
    assert rows(got(None)) == want and len(want) > 40
    for most in (1, 3):
        best = {}
        for r in sorted(want, key=lambda r: (-r[4], r[2], r[3])):
            best.setdefault(r[:2], []).append(r)
        assert rows(got(most)) == sorted(r for found in best.values() for r in found[:most])
