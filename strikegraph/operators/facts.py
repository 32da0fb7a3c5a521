"""How striking a target's attribute values are among its peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikegraph.operators.graph import KnowledgeGraph, follow
from strikegraph.operators.relevance import ranked
from strikegraph.sources.shared import kept

FACT = ["qid", "set_id", "etype", "value"]
#: Who holds a value of more edges is found from the members of the sets, once for all queries.
FEW_EDGES = 256


def target_facts(kg: KnowledgeGraph, queries: DataFrame) -> DataFrame:
    """``(qid, target, etype, value)``: every edge of a target is a candidate fact."""
    return follow(kg, queries.select(F.col("target").alias("src"), "qid")).select("qid", F.col("src").alias("target"), "etype", F.col("dst").alias("value"))


def first_held(kg: KnowledgeGraph, members: DataFrame, facts: DataFrame) -> DataFrame:
    """The first values ``(set_id, etype, src, x, many)`` of ``members([qid], set_id, nid)`` for all attributes that ``facts`` have."""
    own = _own(members)
    firsts = kg.first_values().join(F.broadcast(facts.select("etype").distinct()), "etype", "left_semi")
    return members.withColumnRenamed("nid", "src").join(firsts, "src").select(*own, "etype", "src", F.col("value").alias("x"), "many")


def _own(members: DataFrame) -> list[str]:
    """What names a set of ``members``: queries may share one."""
    return [c for c in FACT[:2] if c in members.columns]


def _sized(members: DataFrame, of: DataFrame | None) -> DataFrame:
    """``(qid, set_id, n_peers)``; ``of(qid, set_id)``: whose sets they are, where ``members`` don't say."""
    n = members.groupBy(*_own(members)).agg(F.count("*").alias("n_peers"))
    return n if of is None else n.join(of, "set_id")


def eligible_by_peers(kg: KnowledgeGraph, members: DataFrame, facts: DataFrame, coverage: float, of: DataFrame | None = None, firsts: DataFrame | None = None) -> DataFrame:
    """``(qid, set_id, etype, n_have, n_peers)``: attributes that ``coverage`` of a peer set or more has.

    ``of(qid, set_id)``: the queries' sets, where ``members(set_id, nid)`` hold each once; ``firsts``: their ``first_held``.
    """
    own = _own(members)
    firsts = first_held(kg, members, facts) if firsts is None else firsts
    have = firsts.groupBy(*own, "etype").agg(F.count("*").alias("n_have"))
    asked = _sized(members, of).join(facts.select("qid", "etype").distinct(), "qid")
    return asked.join(have, [*own, "etype"]).where(F.col("n_have") >= F.lit(coverage) * F.col("n_peers")).select("qid", "set_id", "etype", "n_have", "n_peers")


def eligible_globally(kg: KnowledgeGraph, members: DataFrame, facts: DataFrame, coverage: float, of: DataFrame | None = None, firsts: DataFrame | None = None) -> DataFrame:
    """``(qid, set_id, etype, n_have, n_peers)``: attributes that as many nodes have, anywhere, as ``coverage`` of the peer set's size."""
    have = kg.first_values().groupBy("etype").agg(F.count("*").alias("n_have"))
    asked = _sized(members, of).join(facts.select("qid", "etype").distinct(), "qid")
    return asked.join(have, "etype").where(F.col("n_have") >= F.lit(coverage) * F.col("n_peers")).select("qid", "set_id", "etype", "n_have", "n_peers")


def _counted(kg: KnowledgeGraph, members: DataFrame, facts: DataFrame, eligible: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For ``value_frequency``: the first values counted once a set, the facts asked for, and the peers moved to each fact's value."""
    held = members.join(eligible.select("qid", "set_id", "etype"), ["qid", "set_id"]).withColumnRenamed("nid", "src")
    own = facts.select("qid", "target").distinct()
    others = held.join(own, "qid").where("src <> target").drop("target")
    firsts = others.join(kg.first_values().select("src", "etype", F.col("value").alias("x")), ["src", "etype"])
    counts = firsts.groupBy("qid", "set_id", "etype", "x").agg(F.count("*").alias("n"))
    asked = eligible.select("qid", "set_id", "etype").join(facts.select("qid", "etype", "value"), ["qid", "etype"])
    # Who holds a fact's value is looked up once a query, not once a set.
    back = follow(kg, facts.select(F.col("value").alias("src"), "qid", F.col("etype").alias("own"))).where(F.col("etype").bitwiseXOR(F.col("own")) == 1)  # the values' own edges, read in place
    holding = back.select("qid", F.col("own").alias("etype"), F.col("src").alias("value"), F.col("dst").alias("src"))
    holders = firsts.join(holding, ["qid", "etype", "src"]).where("x <> value")
    moves = holders.groupBy(*FACT, "x").agg(F.count("*").alias("n"))
    return counts, asked, moves


def value_frequency(kg: KnowledgeGraph, members: DataFrame, facts: DataFrame, eligible: DataFrame) -> DataFrame:
    """``(qid, set_id, etype, value, x, f)``: for each fact, how many peers count for each value ``x`` of its attribute.

    A peer with the attribute counts once: for the fact's value if it has it, else for its first value; the target counts
    for the fact's value. The first values are counted once a set, and for each fact only the peers that hold its value are
    moved to it, so no fact is paired with all peers.
    """
    counts, asked, moves = _counted(kg, members, facts, eligible)
    base = asked.join(counts, ["qid", "set_id", "etype"]).select(*FACT, "x", "n")
    moved = moves.select(*FACT, F.explode(F.array(F.struct("x", (-F.col("n")).alias("n")), F.struct(F.col("value").alias("x"), "n"))).alias("c")).select(*FACT, "c.x", "c.n")
    target = asked.select(*FACT, F.col("value").alias("x"), F.lit(1).cast("long").alias("n"))
    return base.unionByName(moved).unionByName(target).groupBy(*FACT, "x").agg(F.sum("n").alias("f")).where("f > 0")


def strikingness(frequency: DataFrame, min_population: int = 0) -> DataFrame:
    """``(qid, set_id, etype, value, strikingness, value_freq, top_value, top_freq, population)`` from ``value_frequency``.

    The share of peers whose value is more frequent than the fact's; 0 where fewer than ``min_population`` count.
    """
    own = frequency.where("x = value").select(*FACT, F.col("f").alias("value_freq"))
    out = frequency.join(own, FACT).groupBy(*FACT, "value_freq").agg(F.sum(F.when(F.col("f") > F.col("value_freq"), F.col("f")).otherwise(0)).alias("more"), F.sum("f").alias("population"), F.min(F.struct((-F.col("f")).alias("f"), "x")).alias("m"))
    s = F.when(F.col("population") < min_population, F.lit(0.0)).otherwise(F.round(F.col("more") / F.col("population"), 10))
    return out.select(*FACT, s.alias("strikingness"), "value_freq", F.col("m.x").alias("top_value"), (-F.col("m.f")).alias("top_freq"), "population")


def _holders(kg: KnowledgeGraph, facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``facts`` with ``big``, whether their value has more than ``FEW_EDGES`` edges, and who holds the values, the values' own edges read in place.

    ``(qid, etype, value, src)`` of the others' values, the target left out, and ``(etype, value, src)`` of the big ones, for all queries once.
    """
    big = kg.adjacency().where(F.col("degree") > FEW_EDGES).select(F.col("src").alias("value"), F.lit(True).alias("big")).distinct()
    facts = facts.join(big, "value", "left").select("qid", "target", "etype", "value", F.coalesce("big", F.lit(False)).alias("big")).transform(kept)
    back = lambda rows: follow(kg, rows).where(F.col("etype").bitwiseXOR(F.col("own")) == 1)
    few = back(facts.where("not big").select(F.col("value").alias("src"), "qid", "target", F.col("etype").alias("own"))).where("dst <> target")
    many = back(facts.where("big").select(F.col("value").alias("src"), F.col("etype").alias("own")).distinct())
    pick = lambda df, *more: df.select(*more, F.col("own").alias("etype"), F.col("src").alias("value"), F.col("dst").alias("src"))
    return facts, pick(few, "qid").transform(kept), pick(many)


def _met(at: list[str], firsts: DataFrame, facts: DataFrame, eligible: DataFrame, few: DataFrame) -> DataFrame:
    """``(qid, set_id, etype, value, x)``: the peers of a set that hold a query's value, by their first value ``x``; where ``value`` is null the target itself.

    Each set of a query meets those who hold its values by the fewer of both.
    """
    n = few.groupBy("qid", "etype").agg(F.count("*").alias("n_few"))
    pairs = eligible.select(*FACT[:3], "n_peers").join(n, ["qid", "etype"], "left").withColumn("small", F.col("n_peers") <= F.coalesce("n_few", F.lit(0))).transform(kept)
    own = facts.select("qid", "target").distinct()
    probes = pairs.where("not small").join(few, ["qid", "etype"]).select(*FACT, "src")
    probes = probes.unionByName(pairs.join(own, "qid").select(*FACT[:3], F.lit(None).cast("long").alias("value"), F.col("target").alias("src")))
    found = probes.join(firsts.select(*at, "src", "x"), [*at, "src"]).select(*FACT, "x")
    members = pairs.where("small").select(*FACT[:3]).join(firsts.select(*at, "src", "x"), at)
    return found.unionByName(members.join(few, ["qid", "etype", "src"]).select(*FACT, "x")).transform(kept)


def _untouched(facts: DataFrame, eligible: DataFrame, touched: DataFrame, most: int) -> DataFrame:
    """The first ``most`` facts of each query's set and attribute, by value, that are not ``touched``: all of these are as striking as each other.

    Before the ``i``-th of them are the touched ones that have fewer than ``i`` others before them.
    """
    key = FACT[:3]
    placed = ranked(facts.where("not big").select("qid", "etype", "value"), ["qid", "etype"], "value").transform(kept)
    seen = ranked(touched.join(placed, ["qid", "etype", "value"]).withColumnRenamed("rank", "place"), key, "place").withColumn("others", F.col("place") - F.col("rank"))
    before = seen.where(F.col("others") < most).groupBy(*key, "others").agg(F.count("*").alias("n"))  # a row for each number of others below ``most``
    sums = before.groupBy(*key).agg(*(F.sum(F.when(F.col("others") < i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(1, most + 1)))
    each = eligible.select(*key).join(sums, key, "left").select(*key, F.explode(F.array(*((i + F.coalesce(f"c{i}", F.lit(0))).cast("int") for i in range(1, most + 1)))).alias("rank"))
    return each.join(placed, ["qid", "etype", "rank"]).select(*FACT)


def fact_scores(kg: KnowledgeGraph, members: DataFrame, facts: DataFrame, eligible: DataFrame, min_population: int = 0, most: int | None = None, firsts: DataFrame | None = None) -> DataFrame:
    """``strikingness`` of ``value_frequency``, without a row for each fact and value; with ``most`` only the ``most`` most striking facts of each query's set.

    ``members(set_id, nid)`` hold a set once for all queries that have it, or ``(qid, set_id, nid)`` by query; ``firsts``: their ``first_held``.

    A set's values are counted once, whichever queries have it; that the target counts for the fact's value only is set right afterwards.
    A fact meets the levels of these counts, of which there are few, and what its own value takes from others is set right value by value. The most
    frequent value is the fact's, one that gave peers away, or the first in rank that gave none. Facts whose value no other peer of a set holds are as
    striking as each other there, so with ``most`` only the first of them go on.
    """
    at, key = [*_own(members), "etype"], FACT[:3]
    n0 = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    eligible = eligible.transform(kept)
    firsts = (first_held(kg, members, facts) if firsts is None else firsts).join(eligible.select(*at).distinct(), at, "left_semi")
    counts = firsts.groupBy(*at, "x").agg(F.count("*").alias("n")).transform(kept)
    facts, few, many = _holders(kg, facts.join(eligible.select("qid", "etype").distinct(), ["qid", "etype"], "left_semi"))
    met = _met(at, firsts, facts, eligible, few)
    self_ = met.where("value is null").select(*key, F.col("x").alias("x_t")).transform(kept)
    met = met.where("value is not null")

    asked = eligible.select(*key).join(facts.select("qid", "etype", "value", "big"), ["qid", "etype"])
    if most is not None:
        touched = met.select(*FACT).distinct().transform(kept)
        asked = asked.where("big").select(*FACT).unionByName(touched).unionByName(_untouched(facts, eligible, touched, most))
    asked = asked.select(*FACT).transform(kept)
    # How many peers each first value gives to a fact's value; the target, where it is a peer, gives one as well.
    one = F.lit(1).cast("long").alias("m")
    from_self = asked.join(facts.where("not big").select("qid", "etype", "value"), ["qid", "etype", "value"], "left_semi").join(self_, key).select(*FACT, F.col("x_t").alias("x"), one)
    given = met.where("x <> value").select(*FACT, "x", one).unionByName(from_self.where("x <> value")).groupBy(*FACT, "x").agg(F.sum("m").alias("m"))
    taken = firsts.where("many").join(many, ["etype", "src"]).where("x <> value").groupBy(*at, "value", "x").agg(F.count("*").alias("m"))
    of_big = asked.join(facts.where("big").select("qid", "etype", "value"), ["qid", "etype", "value"], "left_semi").join(taken, [*at, "value"]).select(*FACT, "x", "m")
    changed = given.unionByName(of_big).unionByName(asked.select(*FACT, F.col("value").alias("x"), F.lit(0).cast("long").alias("m")))
    seen = changed.join(counts, [*at, "x"]).select(*FACT, "x", "n", "m").transform(kept)

    sums = seen.groupBy(*FACT).agg(F.sum(F.when(F.col("x") == F.col("value"), F.col("n")).otherwise(F.col("m"))).alias("own"))
    total = asked.join(counts.groupBy(*at).agg(F.sum("n").alias("p")), at, "left").join(sums, FACT, "left").join(self_.select(*key, F.lit(0).cast("long").alias("more")), key, "left")
    more = F.coalesce("more", F.lit(1).cast("long"))
    total = total.select(*FACT, (n0("own") + more).alias("value_freq"), (n0("p") + more).alias("population")).transform(kept)
    levels = counts.groupBy(*at, "n").agg(F.sum("n").alias("mass"))
    # Facts of a set and attribute with the same frequency, as the many of values that nobody else has, meet the levels once.
    above = total.select(*at, "value_freq").distinct().join(levels, at).where("n > value_freq").groupBy(*at, "value_freq").agg(F.sum("mass").alias("above"))
    givers = seen.where("x <> value").join(total.select(*FACT, "value_freq"), FACT).withColumn("left", F.col("n") - F.col("m"))
    change = F.when(F.col("left") > F.col("value_freq"), F.col("left")).otherwise(0) - F.when(F.col("n") > F.col("value_freq"), F.col("n")).otherwise(0)
    changes = givers.groupBy(*FACT).agg(F.sum(change).alias("change"), F.min(F.when(F.col("left") > 0, F.struct((-F.col("left")).alias("f"), "x"))).alias("giver"))
    s = F.when(F.col("population") < min_population, F.lit(0.0)).otherwise(F.round((n0("above") + n0("change")) / F.col("population"), 10))
    out = total.join(above, [*at, "value_freq"], "left").join(changes, FACT, "left").withColumn("strikingness", s)
    if most is not None:
        out = ranked(out, key[:2], F.desc("strikingness"), "etype", "value").where(F.col("rank") <= most).drop("rank")
    out = out.select(*FACT, "strikingness", "value_freq", "giver", "population").transform(kept)

    # The first value in rank that gave none is within as many ranks as a fact has values that gave or took, and one.
    gone = seen.join(out.select(*FACT), FACT, "left_semi").select(*FACT, "x").transform(kept)
    deepest = gone.groupBy(*FACT).agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    first = ranked(counts, at, F.desc("n"), "x").where(F.col("rank") <= deepest + 1).transform(kept)
    prefix = ranked(gone.join(first.select(*at, "x", F.col("rank").alias("r")), [*at, "x"]), FACT, "r").where("r = rank").groupBy(*FACT).agg(F.count("*").alias("c"))
    keeper = out.select(*FACT).join(prefix, FACT, "left").withColumn("rank", (n0("c") + 1).cast("int")).join(first, [*at, "rank"]).select(*FACT, F.struct((-F.col("n")).alias("f"), "x").alias("keeper"))
    top = F.least(F.struct((-F.col("value_freq")).alias("f"), F.col("value").alias("x")), "giver", "keeper")
    return out.join(keeper, FACT, "left").withColumn("top", top).select(*FACT, "strikingness", "value_freq", F.col("top.x").alias("top_value"), (-F.col("top.f")).alias("top_freq"), "population")


def most_frequent_value(frequency: DataFrame) -> DataFrame:
    """``(qid, set_id, etype, value, top_value, top_freq)``: the value that explains a fact; ties to the smaller id."""
    return frequency.groupBy(*FACT).agg(F.min(F.struct((-F.col("f")).alias("f"), "x")).alias("m")).select(*FACT, F.col("m.x").alias("top_value"), (-F.col("m.f")).alias("top_freq"))


def top_facts(scored: DataFrame, k: int, by: list[str], drop_zero: bool = False) -> DataFrame:
    """The ``k`` most striking facts of each group with ``fact_rank``; ties by edge type and value, then by what else names a fact."""
    counted = scored.where("strikingness > 0") if drop_zero else scored
    rest = [c for c in ("n_nodes", "pattern") if c in scored.columns and c not in by]
    return ranked(counted, by, F.desc("strikingness"), "etype", "value", *rest).withColumnRenamed("rank", "fact_rank").where(F.col("fact_rank") <= k)


def diverse_top_facts(scored: DataFrame, k: int, drop_zero: bool = True) -> DataFrame:
    """The best fact of each pattern, and of these the ``k`` most striking of each query."""
    best = top_facts(scored, 1, ["qid", "pattern"], drop_zero).drop("fact_rank")
    return top_facts(best, k, ["qid"])


def relevant_facts(scored: DataFrame, rel: DataFrame, queries: DataFrame, least: Column | float) -> DataFrame:
    """Facts whose value is relevant to the context to ``least`` or more."""
    scores = queries.join(rel, "context").select("qid", F.col("nid").alias("value"), F.col("score").alias("value_score"))
    return scored.join(scores, ["qid", "value"]).where(F.col("value_score") >= least)
