"""Path patterns, the node sets that match them, and their ranking."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strikegraph.functions.columns import DECAYS, instance_label, interleave, rounded, signature, type_label
from strikegraph.operators.graph import KnowledgeGraph, follow
from strikegraph.operators.relevance import best_type, ranked
from strikegraph.sources.shared import kept, release

PATH = ["qid", "target", "context", "nodes", "etypes"]


def labelled_patterns(kg: KnowledgeGraph, paths: DataFrame, types: DataFrame, most: int = 4) -> DataFrame:
    """``(qid, context, pattern, labels, etypes, path_score)`` of ``paths`` with ``path_score``.

    Position 0 carries its node's most relevant type, the last the context, and each one between either: ``2 ** (n - 2)``
    patterns for a path of ``n`` nodes. Paths with a node without a relevant type are dropped; a pattern has the best
    score of its paths.
    """
    at = paths.select(*PATH, "path_score", F.posexplode(F.slice("nodes", F.lit(1), F.size("nodes") - 1)).alias("pos", "nid"))
    typed = at.join(best_type(kg, types, at.select("qid", "nid").distinct()), ["qid", "nid"])
    typed = typed.groupBy(*PATH).agg(F.first("path_score").alias("path_score"), F.sort_array(F.collect_list(F.struct("pos", "type"))).alias("t")).where("size(t) = size(nodes) - 1")
    out = typed.withColumn("labels", F.array(type_label(F.col("t")[0]["type"])))
    for i in range(1, most - 1):
        here = F.size("nodes") > i + 1
        choices = F.when(here, F.array(type_label(F.get("t", F.lit(i))["type"]), instance_label(F.get("nodes", F.lit(i))))).otherwise(F.array(F.lit(None).cast("string")))
        out = out.withColumn("choice", F.explode(choices)).withColumn("labels", F.when(F.col("choice").isNull(), F.col("labels")).otherwise(F.concat("labels", F.array("choice")))).drop("choice")
    out = out.withColumn("labels", F.concat("labels", F.array(instance_label("context"))))
    return out.withColumn("pattern", interleave("labels", "etypes")).groupBy("qid", "context", "pattern", "labels", "etypes").agg(F.max("path_score").alias("path_score"))


def unlabelled_patterns(paths: DataFrame) -> DataFrame:
    """``(qid, context, pattern, labels, etypes, path_score)``: edge types only; ``labels`` is null."""
    return paths.withColumn("pattern", signature("etypes")).groupBy("qid", "context", "pattern", F.lit(None).cast("array<string>").alias("labels"), "etypes").agg(F.max("path_score").alias("path_score"))


def numbered(rows: DataFrame, name: str, kinds: int = 1, kind: int = 0) -> DataFrame:
    """``rows`` as a written table with a number of each row's own as ``name``; those of different ``kind`` differ."""
    return rows.withColumn(name, F.monotonically_increasing_id() * kinds + kind).transform(kept)


def equal_sets(sets: DataFrame, prefix: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(key, class, n)`` and ``(class, nid)`` of ``sets(key, nid)``: keys of equal sets share a class, the first of them, which holds the set once.

    Sets are compared by their size and two sums of hashes of their members, which combine before the shuffle, and then
    member by member with the first set of the same sums; no set is gathered in one place. A set that differs from that one
    although the sums agree stays a class of its own. ``prefix``: text before each class.
    """
    total = lambda salt: F.bit_xor(F.xxhash64("nid", F.lit(salt)))
    keyed = sets.groupBy("key").agg(F.count("*").alias("n"), total(1).alias("a"), total(2).alias("b")).transform(kept)
    first = keyed.groupBy("n", "a", "b").agg(F.min("key").alias("first"))
    placed = keyed.join(first, ["n", "a", "b"]).select("key", "first", "n").transform(kept)
    others = placed.where("key <> first").select("key", "first")
    held = sets.join(others, "key").join(sets.withColumnRenamed("key", "first"), ["first", "nid"]).groupBy("key").agg(F.count("*").alias("n_same"))
    same = (F.col("key") == F.col("first")) | (F.coalesce("n_same", F.lit(0)) == F.col("n"))
    named = (lambda c: c) if prefix is None else (lambda c: F.concat(F.lit(prefix), c))
    classes = placed.join(held, "key", "left").select("key", F.when(same, F.col("first")).otherwise(F.col("key")).alias("one"), "n").transform(kept)
    members = sets.join(classes.where("key = one").select("key"), "key", "left_semi").select(named(F.col("key")).alias("class"), "nid").transform(kept)
    return classes.select("key", named(F.col("one")).alias("class"), "n"), members


@dataclass
class Suffixes:
    """Patterns with, by depth ``d``, the class of their part of ``d`` edges that ends at the context, and the nodes that match such parts.

    ``sets[d](class, nid)``: from where a walk follows such a part; parts with equal sets have one class, ``peers`` is that of the whole
    pattern. ``moves[d](etype, parent, nid, next)``: the edges by which depth ``d`` reaches a class ``parent`` one edge nearer to the context.
    ``sizes(class, n)``: how many nodes a class has.
    """

    patterns: DataFrame
    sets: dict[int, DataFrame]
    moves: dict[int, DataFrame]
    sizes: DataFrame


def suffix_sets(kg: KnowledgeGraph, patterns: DataFrame, most: int, labelled: bool) -> Suffixes:
    """The nodes that reach a context along each distinct suffix, worked out once, whatever patterns and queries share it.

    Suffixes with equal sets so far (all customers of a segment, whichever of them a pattern names next) go on as one class, so a step is
    made once for it. A named node meets its own edges only. Every depth is a written table, for later passes read it several times.
    """
    m = F.size("etypes")
    ends = numbered(patterns.select("context").distinct(), "class0", 2 * most)
    s = patterns.withColumn("m", m).join(ends, "context")
    for d in range(1, most):
        s = s.withColumn(f"label{d}", F.when(m >= d, F.get("labels", m - d))).withColumn(f"etype{d}", F.when(m >= d, F.get("etypes", m - d)))
    s = s.transform(kept)
    sets, moves, sizes = {0: ends.select(F.col("class0").alias("class"), F.col("context").alias("nid"))}, {}, []
    for d in range(1, most):
        label = F.coalesce(f"label{d}", F.lit("*"))
        step = s.where((F.col("m") >= d) & F.col(f"class{d - 1}").isNotNull()).select(label.alias("label"), F.col(f"etype{d}").alias("etype"), F.col(f"class{d - 1}").alias("parent"))
        steps = numbered(step.distinct(), "key", 2 * most, d)
        tails = steps.select(F.col("etype").alias("step"), "parent").distinct().join(sets[d - 1].withColumnRenamed("class", "parent"), "parent").withColumnRenamed("nid", "src")
        back = follow(kg, tails).where(F.col("etype").bitwiseXOR(F.col("step")) == 1)  # no key of the join, so that edges are read in place
        moves[d] = back.select(F.col("step").alias("etype"), "parent", F.col("dst").alias("nid"), F.col("src").alias("next")).transform(kept)
        here = moves[d].select("etype", "parent", "nid").distinct()
        if labelled:
            here = here.transform(kept)
            named = steps.where(F.startswith("label", F.lit("I:"))).withColumn("nid", F.expr("substring(label, 3)").cast("long"))
            typed = steps.where(F.startswith("label", F.lit("T:")))
            types = kg.node_types.select("nid", type_label("type").alias("label")).join(F.broadcast(typed.select("label").distinct()), "label", "left_semi")
            types = types.repartition("nid").distinct()  # so that nothing needs to be made distinct after the join
            found = named.join(here, ["etype", "parent", "nid"]).select("key", "nid").unionByName(here.join(types, "nid").join(typed, ["etype", "parent", "label"]).select("key", "nid"))
        else:
            found = steps.join(here, ["etype", "parent"]).select("key", "nid")
        classes, sets[d] = equal_sets(found.transform(kept))
        sizes.append(classes.select("class", "n").distinct())
        known = steps.join(classes, "key").select(F.col("label").alias("_label"), F.col("etype").alias(f"etype{d}"), F.col("parent").alias(f"class{d - 1}"), F.col("class").alias(f"class{d}"))
        s = s.withColumn("_label", label).join(known, ["_label", f"etype{d}", f"class{d - 1}"], "left").drop("_label").transform(kept)
    whole = F.coalesce(*(F.when(F.col("m") == d, F.col(f"class{d}")) for d in range(1, most)))
    return Suffixes(s.withColumn("peers", whole).transform(kept), sets, moves, reduce(DataFrame.unionByName, sizes))


def peers(suffixes: Suffixes) -> tuple[DataFrame, DataFrame]:
    """``(qid, pattern, class)`` and ``(class, nid)``: the nodes that match position 0."""
    named = suffixes.patterns.where("peers is not null").select("qid", "pattern", F.col("peers").alias("class"))
    return named, reduce(DataFrame.unionByName, (found for d, found in suffixes.sets.items() if d))


def matched(suffixes: Suffixes, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(qid, pattern, level, at)`` of the patterns ``wanted(qid, pattern)`` and ``(at, nid)``: the nodes at each position of some walk that matches a whole pattern.

    The suffix sets hold what reaches the context; this pass from position 0 keeps what is reached, once for patterns whose sets
    and edge types so far agree. It goes over the moves of the suffix sets, not over the graph.
    """
    s = suffixes.patterns.join(wanted.select("qid", "pattern"), ["qid", "pattern"], "left_semi").where("peers is not null").withColumn("at", F.lit(None).cast("long"))
    most, current, levels, nodes = len(suffixes.sets), None, [], []
    for d in sorted(suffixes.moves, reverse=True):
        ends = F.when(F.col("m") == d, F.col("peers"))
        if current is None:
            s = s.withColumn("at", ends).transform(kept)
        else:
            after = [F.col("at").alias("from"), F.col(f"etype{d + 1}").alias("etype"), F.col(f"class{d}").alias("parent")]
            steps = numbered(s.where(F.col("m") > d).select(*after).distinct(), "to", 2 * most, most + d)
            by = steps.select(F.col("from").alias("at"), F.col("etype").alias(f"etype{d + 1}"), F.col("parent").alias(f"class{d}"), "to")
            s = s.join(by, ["at", f"etype{d + 1}", f"class{d}"], "left").withColumn("at", F.coalesce(ends, "to")).drop("to").transform(kept)
        reached = suffixes.sets[d].withColumnRenamed("class", "at").join(s.where(F.col("m") == d).select("at").distinct(), "at", "left_semi")
        if current is not None:
            moved = current.withColumnRenamed("at", "from").join(steps, "from").join(suffixes.moves[d + 1], ["etype", "parent", "nid"]).select(F.col("to").alias("at"), F.col("next").alias("nid")).distinct()
            reached = reached.unionByName(moved)
        current = reached.transform(kept)
        levels.append(s.where("at is not null").select("qid", "pattern", (F.col("m") - d).alias("level"), "at"))
        nodes.append(current)
    # What position 0 reaches one edge before the context has an edge to it.
    levels.append(s.select("qid", "pattern", F.col("m").alias("level"), F.col("class0").alias("at")))
    nodes.append(suffixes.sets[0].withColumnRenamed("class", "at"))
    return reduce(DataFrame.unionByName, levels), reduce(DataFrame.unionByName, nodes)


def match_levels(kg: KnowledgeGraph, patterns: DataFrame, most: int, labelled: bool = True, min_peers: int = 1) -> tuple[DataFrame, DataFrame]:
    """``matched`` of all ``patterns`` with ``min_peers`` nodes or more at position 0."""
    suffixes = suffix_sets(kg, patterns, most, labelled)
    return matched(suffixes, peers(suffixes)[0].join(suffixes.sizes.where(F.col("n") >= min_peers), "class", "left_semi"))


def match_sets(kg: KnowledgeGraph, patterns: DataFrame, most: int, labelled: bool = True, min_peers: int = 1) -> DataFrame:
    """``(qid, pattern, level, nid)`` of ``match_levels``, the nodes anew for each pattern."""
    levels, nodes = match_levels(kg, patterns, most, labelled, min_peers)
    return levels.join(nodes, "at").select("qid", "pattern", "level", "nid")


def levels_relevance(levels: DataFrame, nodes: DataFrame, patterns: DataFrame, rel: DataFrame, context_level: bool = True) -> DataFrame:
    """``(qid, pattern, n_nodes, relevance, n_peers)`` of ``matched``: the least of the path score and each level's decayed mean score.

    Nodes without a score count 0. Without ``context_level`` the context is left out of every level and its own level does not count.
    A level's scores are added up once for a context, whichever patterns have it.
    """
    p = patterns.select("qid", "pattern", "context", "path_score", (F.size("etypes") + 1).alias("n_nodes"))
    at = levels.join(p, ["qid", "pattern"])
    if not context_level:
        at = at.where(F.col("level") < F.col("n_nodes") - 1)
    each = at.select("context", "at").distinct().join(nodes, "at")
    if not context_level:
        each = each.where(F.col("nid") != F.col("context"))
    sums = each.join(rel, ["context", "nid"], "left").groupBy("context", "at").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("s"), F.count("*").alias("n"))
    mean = F.round(F.col("s") / F.col("n"), 12) * F.element_at(F.array(*map(F.lit, DECAYS)), F.col("level") + 1)
    found = at.join(sums, ["context", "at"]).groupBy("qid", "pattern", "n_nodes", "path_score").agg(F.min(mean).alias("least"), F.max(F.when(F.col("level") == 0, F.col("n"))).alias("n_peers"))
    return found.select("qid", "pattern", "n_nodes", F.round(F.least("least", "path_score"), 10).alias("relevance"), F.coalesce("n_peers", F.lit(0)).alias("n_peers"))


def pattern_relevance(matches: DataFrame, patterns: DataFrame, rel: DataFrame, context_level: bool = True) -> DataFrame:
    """``levels_relevance`` of ``matches(qid, pattern, level, nid)``."""
    at = F.concat_ws(">", "qid", "pattern", "level").alias("at")
    return levels_relevance(matches.select("qid", "pattern", "level", at).distinct(), matches.select(at, "nid"), patterns, rel, context_level)


def top_patterns(relevance: DataFrame, k: int) -> DataFrame:
    """The ``k`` most relevant patterns of each query with their ``rank``; ties by length, then by key."""
    return ranked(relevance, ["qid"], F.desc("relevance"), "n_nodes", "pattern").where(F.col("rank") <= k)


def threshold_patterns(relevance: DataFrame, least: float) -> DataFrame:
    """All patterns of relevance ``least`` or more, with their ``rank``."""
    return ranked(relevance.where(F.col("relevance") >= least), ["qid"], F.desc("relevance"), "n_nodes", "pattern")


def diversified(relevance: DataFrame, patterns: DataFrame) -> DataFrame:
    """Of patterns that differ in edge types only, the most relevant one."""
    keyed = relevance.join(patterns.select("qid", "pattern", F.array_join("labels", "|").alias("_labels")), ["qid", "pattern"])
    return ranked(keyed, ["qid", "_labels"], F.desc("relevance"), "pattern").where("rank = 1").drop("rank", "_labels")


def named(kg: KnowledgeGraph, patterns: DataFrame, members: DataFrame) -> DataFrame:
    """The patterns with ``text``, in which names stand for the ids of nodes and edge types, and ``display``, a label for position 0.

    ``display`` is the peer itself where there is one only, else the first type by name that a peer has.
    """
    parts = patterns.select("qid", "pattern", F.posexplode(F.zip_with("labels", "etypes", lambda a, e: F.struct(a.alias("label"), e.alias("etype")))).alias("pos", "p")).select("qid", "pattern", "pos", "p.*")
    ids = F.when(F.startswith("label", F.lit("I:")), F.expr("substring(label, 3)").cast("long"))
    at = parts.withColumn("nid", ids).join(kg.nodes, "nid", "left").join(F.broadcast(kg.edge_types), "etype", "left")
    word = F.concat(F.coalesce("iri", F.expr("substring(label, 3)")), F.when(F.col("name").isNull(), F.lit("")).otherwise(F.concat(F.lit(" -"), "name", F.lit("-> "))))
    text = at.groupBy("qid", "pattern").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", word.alias("w")))), lambda x: x["w"]), "").alias("text"))  # a pattern has few positions
    label = members.join(kg.node_types, "nid", "left").join(kg.nodes, "nid").groupBy("qid", "pattern").agg(F.countDistinct("nid").alias("n"), F.min("iri").alias("one"), F.min("type").alias("type"))
    shown = label.select("qid", "pattern", F.when(F.col("n") == 1, F.col("one")).otherwise(F.coalesce("type", F.lit("ANY"))).alias("display"))
    return patterns.join(text, ["qid", "pattern"]).join(shown, ["qid", "pattern"])


#: Bounds and relevances come from sums in different orders; a bound must be lower by more than this to let a pattern go.
MARGIN = 2e-10
#: By preset, which bounds on a pattern's relevance may prune it.
BOUNDS = {"none": (), "path scores": ("path_bound",), "peer means": ("peer_bound",), "both": ("path_bound", "peer_bound")}


def bounds(suffixes: Suffixes, rel: DataFrame, context_level: bool = True) -> DataFrame:
    """``(qid, pattern, n_nodes, n_peers, path_bound, peer_bound)``: what a pattern's relevance can't exceed, before its inner levels are known.

    That is the best score of its paths, and the mean score of its peers, since these are its level 0: a set that has grown beyond
    the sum of its scores over the relevance needed is let go by it.
    """
    s = suffixes.patterns.select("qid", "pattern", "context", "m", "path_score", "peers")
    at = s.where("peers is not null").select("context", "peers").distinct().join(peers(suffixes)[1].withColumnRenamed("class", "peers"), "peers")
    counted = F.lit(True) if context_level else F.col("nid") != F.col("context")
    sums = at.join(rel, ["context", "nid"], "left").groupBy("context", "peers").agg(F.count("*").alias("n_peers"), F.sum(F.when(counted, F.coalesce("score", F.lit(0.0)))).alias("s"), F.count_if(counted).alias("n"))
    mean = rounded(F.round(F.col("s") / F.nullif("n", F.lit(0)), 12) * DECAYS[0], 10)
    return s.join(sums, ["context", "peers"], "left").select("qid", "pattern", (F.col("m") + 1).alias("n_nodes"), F.coalesce("n_peers", F.lit(0)).alias("n_peers"), rounded("path_score", 10).alias("path_bound"), F.coalesce(mean, F.lit(float("inf"))).alias("peer_bound"))


@dataclass
class Evaluation:
    """``relevance`` of the patterns that were evaluated; ``fates(qid, pattern, fate)`` of all: rejected, pruned or evaluated."""

    relevance: DataFrame
    fates: DataFrame


def evaluated(kg: KnowledgeGraph, suffixes: Suffixes, known: DataFrame, rel: DataFrame, k: int, min_peers: int, context_level: bool = True, prune: str = "both", first: int | None = None, choose=None, least: float | None = None) -> Evaluation:
    """Evaluates the patterns that may be among the ``k`` most relevant of their query, or have the relevance ``least``; ``known``: their ``bounds``.

    A threshold algorithm: a first wave of the ``first`` patterns by bound (by default ``2 * k``) gives the ``k``-th best
    relevance of each query, carried in a table of one row a query; of the others, those go on whose bound reaches it.
    ``choose``: what picks among evaluated patterns before they are ranked.
    """
    bound = F.least(F.lit(float("inf")), *(F.col(c) for c in BOUNDS[prune])) if BOUNDS[prune] else F.lit(float("inf"))
    fit = known.where(F.col("n_peers") >= min_peers).withColumn("bound", bound)

    def run(wanted: DataFrame) -> DataFrame:
        p = suffixes.patterns.join(wanted.select("qid", "pattern"), ["qid", "pattern"], "left_semi")
        return levels_relevance(*matched(suffixes, wanted), p, rel, context_level).transform(kept)

    if not BOUNDS[prune] or least is not None:
        go = (fit if least is None else fit.where(F.col("bound") + MARGIN >= least)).transform(kept)
        found = run(go)
    else:
        order = ranked(fit, ["qid"], F.desc("bound"), "pattern").transform(kept)
        first = first or 2 * k
        head = order.where(F.col("rank") <= first)
        found = run(head)
        kth = top_patterns(choose(found) if choose else found, k).groupBy("qid").agg(F.count("*").alias("n"), F.min("relevance").alias("kth")).where(F.col("n") >= k).select("qid", "kth")
        tail = order.where(F.col("rank") > first).join(kth, "qid", "left").where(F.col("kth").isNull() | (F.col("bound") + MARGIN >= F.col("kth"))).transform(kept)
        go = head.select("qid", "pattern")
        if not tail.isEmpty():
            found, go = found.unionByName(run(tail)), go.unionByName(tail.select("qid", "pattern"))
    fate = F.when(F.col("n_peers") < min_peers, "rejected").when(F.col("go"), "evaluated").otherwise("pruned")
    fates = known.join(go.select("qid", "pattern", F.lit(True).alias("go")), ["qid", "pattern"], "left").select("qid", "pattern", fate.alias("fate"))
    return Evaluation(found, fates)


def peer_sets(members: DataFrame) -> DataFrame:
    """``(qid, pattern, set_id, n_peers)``: patterns with equal peers share a ``set_id``; how sets are compared, see ``equal_sets``."""
    return distinct_peer_sets(members)[0]


def distinct_peer_sets(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ``peer_sets`` and the members ``(qid, set_id, nid)`` of each distinct set once."""
    return _by_query(*peer_classes(members))


def peer_classes(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``class_sets`` of ``members(qid, pattern, nid)``."""
    own = F.concat_ws(">", "qid", "pattern")
    return class_sets(members.select("qid", "pattern", own.alias("class")).distinct(), members.select(own.alias("class"), "nid"))


def distinct_class_sets(named: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``distinct_peer_sets`` of patterns ``named(qid, pattern, class)`` and their peers ``sets(class, nid)``; a class is compared once."""
    return _by_query(*class_sets(named, sets))


def class_sets(named: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets ``(qid, pattern, set_id, n_peers)`` of ``distinct_class_sets`` and ``(set_id, nid)``: a set's members once, however many queries have it."""
    wanted = sets.join(named.select("class").distinct(), "class", "left_semi").withColumnRenamed("class", "key").transform(kept)
    classes, members = equal_sets(wanted)
    out = named.join(classes.withColumnRenamed("class", "set_id"), named["class"] == classes["key"]).select("qid", "pattern", "set_id", F.col("n").alias("n_peers")).transform(kept)
    return out, members.withColumnRenamed("class", "set_id")


def _by_query(sets: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    return sets, sets.select("qid", "set_id").distinct().join(members, "set_id").select("qid", "set_id", "nid")


#: Values of a hash within a class of frequency.
SPREAD = 64


def prefixes(members: DataFrame, limit: float) -> DataFrame:
    """``(qid, pattern, n, nid)``: of each set, the rare members of which two sets at a distance under ``limit`` share at least one.

    Members have one order for all sets: classes of frequency, rare ones first, and a hash within them. Two such sets share more than
    ``(1 - limit) * n`` members, so the first one that both have is among the first ``n - (1 - limit) * n + 1`` of either. Sets are counted by
    class and hash value, so that no set is sorted in one task; the last class that is needed is taken whole.
    """
    often = members.groupBy("qid", "nid").agg(F.count("*").alias("often"))
    place = F.floor(F.log2("often")).cast("int") * SPREAD + F.pmod(F.xxhash64("nid"), F.lit(SPREAD)).cast("int")
    placed = members.join(often, ["qid", "nid"]).select("qid", "pattern", "nid", place.alias("place"))
    counts = placed.groupBy("qid", "pattern", "place").agg(F.count("*").alias("k"))
    whole = Window.partitionBy("qid", "pattern")  # at most SPREAD places a class of frequency, and 64 classes
    so_far = counts.select("qid", "pattern", "place", F.sum("k").over(whole).alias("n"), (F.sum("k").over(whole.orderBy("place")) - F.col("k")).alias("before"))
    needed = so_far.where(F.col("before") < F.col("n") - F.ceil((1 - limit) * F.col("n") - 1e-6) + 1)
    return placed.join(needed.drop("before"), ["qid", "pattern", "place"]).select("qid", "pattern", "n", "nid")


def close_candidates(members: DataFrame, limit: float) -> DataFrame:
    """``(qid, a, b, n_a, n_b)``: pairs ``a < b`` of sets of near sizes that share one of their ``prefixes``."""
    first = prefixes(members, limit).transform(kept)
    side = lambda x: first.select("qid", "nid", F.col("pattern").alias(x), F.col("n").alias(f"n_{x}"))
    met = side("a").join(side("b"), ["qid", "nid"]).where("a < b").where(F.least("n_a", "n_b") > (1 - limit) * F.greatest("n_a", "n_b"))
    return met.select("qid", "a", "b", "n_a", "n_b").distinct()


def close_sets(members: DataFrame, limit: float) -> DataFrame:
    """``(qid, a, b, distance)``: pairs of sets, ``a < b``, at a Jaccard distance under ``limit``.

    What two ``close_candidates`` share is counted over their members; no other pair is compared.
    """
    near = close_candidates(members, limit).transform(kept)
    shared = near.join(members.select("qid", F.col("pattern").alias("a"), "nid"), ["qid", "a"]).join(members.select("qid", F.col("pattern").alias("b"), "nid"), ["qid", "b", "nid"])
    both = shared.groupBy("qid", "a", "b", "n_a", "n_b").agg(F.count("*").alias("n"))
    return both.select("qid", "a", "b", F.round(1 - F.col("n") / (F.col("n_a") + F.col("n_b") - F.col("n")), 10).alias("distance")).where(F.col("distance") < limit)


def peer_jaccard(members: DataFrame, limit: float = 0.1) -> DataFrame:
    """``(qid, a, b, distance)``: pairs of patterns, ``a < b``, whose peers are at a Jaccard distance under ``limit``."""
    return named_jaccard(*distinct_peer_sets(members), limit)


def named_jaccard(sets: DataFrame, once: DataFrame, limit: float) -> DataFrame:
    """``peer_jaccard`` of ``distinct_peer_sets``: each distinct set is compared once, and its patterns take over what was found."""
    close = close_sets(once.withColumnRenamed("set_id", "pattern").transform(kept), limit)
    own = sets.select("qid", F.col("set_id").alias("a"), F.col("set_id").alias("b"), F.lit(0.0).alias("distance")).distinct().where(F.lit(0.0 < limit))
    side = lambda x: sets.select("qid", F.col("set_id").alias(x), F.col("pattern").alias(f"p_{x}"))
    met = close.unionByName(own).transform(kept).join(side("a"), ["qid", "a"]).join(side("b"), ["qid", "b"]).where("a <> b or p_a < p_b")
    return met.select("qid", F.least("p_a", "p_b").alias("a"), F.greatest("p_a", "p_b").alias("b"), "distance")


def merged_peer_sets(members: DataFrame, limit: float = 0.1) -> DataFrame:
    """``(qid, pattern, merged)``: ``merged`` is the first pattern that steps of less than ``limit`` between peer sets lead to.

    Equal sets are compared once. The first pattern moves a step a round over the close pairs, each round a written table, until
    no set has a neighbour with an earlier one; the result does not depend on the order of arrival.
    """
    return merged_sets(*distinct_peer_sets(members), limit)


def merged_sets(sets: DataFrame, once: DataFrame, limit: float) -> DataFrame:
    """``merged_peer_sets`` of ``distinct_peer_sets``."""
    sides = lambda x, y: F.struct(F.col(x).alias("set_id"), F.col(y).alias("near"))
    close = close_sets(once.withColumnRenamed("set_id", "pattern").transform(kept), limit)
    near = close.select("qid", F.explode(F.array(sides("a", "b"), sides("b", "a"))).alias("s")).select("qid", "s.*").transform(kept)
    named = sets.groupBy("qid", "set_id").agg(F.min("pattern").alias("merged")).transform(kept)
    moved = True
    while moved:
        seen = near.join(named.select("qid", F.col("set_id").alias("near"), "merged"), ["qid", "near"]).groupBy("qid", "set_id").agg(F.min("merged").alias("other"))
        step = named.join(seen, ["qid", "set_id"], "left").select("qid", "set_id", F.least("merged", "other").alias("merged"), (F.col("other") < F.col("merged")).alias("moves")).transform(kept)
        moved = not step.where("moves").isEmpty()
        release(named)
        named = step
    return sets.select("qid", "set_id", "pattern").join(named, ["qid", "set_id"]).select("qid", "pattern", "merged")


def size_bound(kg: KnowledgeGraph, rel: DataFrame, kth: DataFrame) -> DataFrame:
    """``(context, etype, type, level, bound)``: how many nodes a level may have before its decayed mean falls below ``kth(context, kth)``.

    Over the nodes of a type with the level's edge type, contexts included, so that no pattern is lost.
    """
    sources = kg.edges.select("etype", F.col("src").alias("nid")).distinct()
    sums = rel.join(sources, "nid").join(kg.node_types, "nid").groupBy("context", "etype", "type").agg(F.sum("score").alias("s")).join(kth, "context")
    levels = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), F.lit(x).alias("x")) for i, x in enumerate(DECAYS[:3])))).alias("l")
    return sums.select("context", "etype", "type", levels, "s", "kth").select("context", "etype", "type", "l.level", F.round(F.col("l.x") * F.col("s") / F.col("kth"), 4).alias("bound"))
