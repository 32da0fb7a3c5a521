"""The graph as DataFrames, and what is derived from it once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from strikegraph.sources.shared import bucketed, kept

#: A node with more edges is a hub, whose edges are dealt in slices of about so many.
SLICE_EDGES = 10_000
#: There are at most so many hubs: in larger graphs slices are larger.
HUBS = 1 << 14
#: A bucket has about so many edges at most: in larger graphs there are more buckets than shuffles have.
BUCKET_EDGES = 1 << 22


@dataclass
class KnowledgeGraph:
    """``nodes(nid, iri)``, ``edge_types(etype, name)``, ``node_types(nid, type)``, ``edges(src, etype, dst)`` with both directions."""

    nodes: DataFrame
    edge_types: DataFrame
    node_types: DataFrame
    edges: DataFrame
    #: The edges in slices and the hubs, where they are written already.
    sliced: tuple[DataFrame, DataFrame] | None = field(default=None, repr=False)
    #: The edges before repeats are dropped, where that can wait until they lie in buckets.
    repeated: DataFrame | None = field(default=None, repr=False)
    #: ``node_rows`` of the edges, where they are written already.
    packed: DataFrame | None = field(default=None, repr=False)
    #: What queries look into, worked out once for the graph and freed with it.
    held: dict = field(default_factory=dict, repr=False)

    def once(self, name, make):
        if name not in self.held:
            self.held[name] = make()
        return self.held[name]

    def first_values(self) -> DataFrame:
        """``first_values`` of all edges, as a table by source; ``many``: whether there are other values."""

        def make() -> DataFrame:
            # Each edge is read at its other end, where that end's degree lies.
            ends = self.adjacency().select(F.struct("degree", F.col("src").alias("dst")).alias("m"), F.explode("out").alias("e"))
            edges = ends.select(F.col("e.dst").alias("src"), F.col("e.etype").bitwiseXOR(1).alias("etype"), "m")
            return edges.groupBy("src", "etype").agg(F.max("m").alias("m"), (F.count("*") > 1).alias("many")).select("src", "etype", F.col("m.dst").alias("value"), "many").transform(kept)

        return self.once("first values", make)

    def cached(self) -> KnowledgeGraph:
        """The same graph as written tables, the edges in buckets of their source, a row for each node."""
        packed, hubs = node_rows(self.edges if self.repeated is None else self.repeated)
        edges = packed.select("src", "slice", F.explode("out").alias("e")).select("src", "slice", "e.etype", "e.dst")
        return KnowledgeGraph(*(d.transform(kept) for d in (self.nodes, self.edge_types, self.node_types)), edges.select("src", "etype", "dst"), (edges, hubs), packed=packed)

    def out_edges(self) -> tuple[DataFrame, DataFrame]:
        """``sliced_edges`` of the graph."""
        return self.sliced or self.once("sliced", lambda: sliced_edges(self.edges))

    def moves(self) -> tuple[DataFrame, DataFrame]:
        """``(src, slice, dst, w)``, the steps of a random walk with their probabilities in buckets of ``src, slice``, and the hubs."""
        return self.adjacency().select("src", "slice", F.explode("out.dst").alias("dst"), (1.0 / F.col("degree")).alias("w")), self.out_edges()[1]

    def adjacency(self) -> DataFrame:
        """``(src, slice, out, degree)`` in buckets of ``src, slice``: a node's edges ``out(etype, dst)`` as one row, a hub's as one for each slice.

        A step of all nodes meets one row for each of them instead of one for each edge.
        """
        edges, hubs = self.out_edges()

        def make() -> tuple[DataFrame, DataFrame]:
            packed = self.packed
            if packed is None:
                buckets = getattr(edges, "buckets", None)
                rows = edges.groupBy("src", "slice").agg(F.collect_list(F.struct("etype", "dst")).alias("out"))
                packed = bucketed(rows.withColumn("n", F.size("out").cast("long")), "src", "slice", buckets=buckets, placed=buckets is not None)
            return packed, packed.select("src", "n").join(F.broadcast(hubs), "src").groupBy("src").agg(F.sum("n").alias("whole")).transform(kept)

        packed, whole = self.once("adjacency", make)
        return packed.join(F.broadcast(whole), "src", "left").select("src", "slice", "out", F.coalesce("whole", "n").alias("degree"))


def both_directions(forward: DataFrame) -> DataFrame:
    """``edges`` from forward ``(src, etype, dst)`` with even types: no self-loops, no repeats, and every reverse."""
    # One pass over the distinct edges; a union would run the distinct twice.
    return turned(forward.distinct())


def turned(forward: DataFrame) -> DataFrame:
    """Each of ``forward`` but self-loops, and its reverse; repeats stay."""
    ends = F.array(F.struct("src", "etype", "dst"), F.struct(F.col("dst").alias("src"), (F.col("etype") + 1).alias("etype"), F.col("src").alias("dst")))
    return forward.where("src <> dst").select(F.explode(ends).alias("e")).select("e.*")


def from_triples(triples: DataFrame, types: DataFrame) -> KnowledgeGraph:
    """A graph from ``triples(src_iri, dst_iri, label)`` and ``types(iri, type)``.

    Ids follow the order of the names, so they do not depend on partitioning; a node seen in a self-loop only has an id
    but no edge; types of nodes without an edge are dropped.
    """
    iris = triples.select(F.explode(F.array("src_iri", "dst_iri")).alias("iri")).where("iri is not null").distinct()
    nodes = dense_places(iris, "iri", "nid")
    labels = dense_places(triples.select("label").where("label is not null").distinct(), "label", "n").select((2 * F.col("n")).cast("int").alias("etype"), F.col("label").alias("name"))
    ids = lambda side: nodes.select(F.col("nid").alias(side), F.col("iri").alias(f"{side}_iri"))
    forward = triples.join(ids("src"), "src_iri").join(ids("dst"), "dst_iri").join(labels, F.col("label") == F.col("name")).select("src", "etype", "dst")
    edges = both_directions(forward)
    typed = types.join(nodes, "iri").select("nid", "type").where("type <> ''").distinct().join(edges.select(F.col("src").alias("nid")).distinct(), "nid", "left_semi")
    names = labels.unionByName(labels.select((F.col("etype") + 1).alias("etype"), F.concat(F.lit("r-"), "name").alias("name")))
    return KnowledgeGraph(nodes, names, typed, edges)


def dense_places(names: DataFrame, column: str, out: str) -> DataFrame:
    """Dense places of distinct names in their order: rows are numbered within range partitions, whose sizes are added up."""
    parts = names.repartitionByRange(column).sortWithinPartitions(column).withColumn("_part", F.spark_partition_id())
    parts = parts.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(column))).transform(kept)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return parts.join(F.broadcast(before), "_part").select((F.col("_before") + F.col("_in") - 1).cast("long").alias(out), column)


def degrees(edges: DataFrame) -> DataFrame:
    """``(nid, degree)``: entries in a node's adjacency."""
    return edges.groupBy(F.col("src").alias("nid")).agg(F.count("*").alias("degree"))


def placed_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``(src, slice, etype, dst)``, ``(src, slices)`` of the hubs, of which there are at most ``2 * HUBS``, and in how many buckets of ``src, slice`` the edges should lie.

    A hub's edges lie in several slices, so that no bucket holds many more edges than another; buckets grow in number with the edges,
    so that none outgrows the memory of the task that sorts it.
    """
    # The nodes that may be hubs, and all others as one row.
    d = degrees(edges).groupBy(F.when(F.col("degree") > SLICE_EDGES, F.col("nid")).alias("src")).agg(F.sum("degree").alias("degree")).transform(kept)
    whole = d.agg(F.sum("degree")).first()[0] or 0
    size = max(SLICE_EDGES, whole // HUBS)
    hubs = d.where(F.col("src").isNotNull() & (F.col("degree") > size)).select("src", F.ceil(F.col("degree") / size).cast("int").alias("slices")).transform(kept)
    slice_ = F.pmod(F.xxhash64("dst"), F.coalesce("slices", F.lit(1))).cast("int").alias("slice")
    buckets = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-whole // BUCKET_EDGES))
    return edges.join(F.broadcast(hubs), "src", "left").select("src", slice_, "etype", "dst"), hubs, buckets


def sliced_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``placed_edges`` as a written table in their buckets, and the hubs."""
    rows, hubs, buckets = placed_edges(edges)
    return bucketed(rows, "src", "slice", buckets=buckets), hubs


def node_rows(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(src, slice, out, n)`` in buckets of ``src, slice``, and the hubs of ``placed_edges``: a node's ``n`` edges ``out(etype, dst)`` as one row, a hub's as one for each slice.

    ``edges`` may repeat; all but one of them are dropped where their row is put together.
    """
    rows, hubs, buckets = placed_edges(edges)
    out = rows.repartition(buckets, "src", "slice").groupBy("src", "slice").agg(F.collect_set(F.struct("etype", "dst")).alias("out"))
    return bucketed(out.withColumn("n", F.size("out").cast("long")), "src", "slice", buckets=buckets, placed=True), hubs


def with_slices(rows: DataFrame, hubs: DataFrame) -> DataFrame:
    """``rows(src, ...)`` once for each slice of their ``src``: mostly once, for a hub several times."""
    cut = F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)).alias("slice")
    return rows.join(F.broadcast(hubs), "src", "left").select(*rows.columns, cut)


def follow(kg: KnowledgeGraph, rows: DataFrame) -> DataFrame:
    """``rows(src, ...)`` with each edge ``etype, dst`` of their ``src``.

    The edges are read in place, bucket by bucket; only ``rows`` move, and those at a hub go to all of its slices.
    """
    edges, hubs = kg.out_edges()
    if kg.packed is None:
        return with_slices(rows, hubs).join(edges, ["src", "slice"]).drop("slice")
    met = with_slices(rows, hubs).join(kg.packed.select("src", "slice", "out"), ["src", "slice"])
    return met.select("src", *(c for c in rows.columns if c != "src"), F.explode("out").alias("e")).select("src", *(c for c in rows.columns if c != "src"), "e.etype", "e.dst")


def spread_ratio(edges: DataFrame) -> DataFrame:
    """``(src, etype, spread)``: one over the number of edges of the type at the source."""
    return edges.groupBy("src", "etype").agg((1.0 / F.count("*")).alias("spread"))


def etype_sources(edges: DataFrame) -> DataFrame:
    """``(etype, src)``: which nodes have an edge type."""
    return edges.select("etype", "src").distinct()


def neighbours_by_degree(edges: DataFrame) -> DataFrame:
    """``(src, etype, dst, pos)``: neighbours of a type by degree, then id, both descending."""
    d = degrees(edges).select(F.col("nid").alias("dst"), "degree")
    return edges.join(d, "dst").withColumn("pos", F.row_number().over(Window.partitionBy("src", "etype").orderBy(F.desc("degree"), F.desc("dst")))).select("src", "etype", "dst", "pos")


def first_values(edges: DataFrame) -> DataFrame:
    """``(src, etype, value)``: the neighbour of the highest degree, by an aggregate that needs no sort."""
    d = degrees(edges).select(F.col("nid").alias("dst"), "degree")
    return edges.join(d, "dst").groupBy("src", "etype").agg(F.max(F.struct("degree", "dst")).alias("m")).select("src", "etype", F.col("m.dst").alias("value"))


def specific_type(node_types: DataFrame) -> DataFrame:
    """``(nid, type)``: each node's rarest type; ties by name."""
    n = node_types.groupBy("type").agg(F.count("*").alias("n"))
    return node_types.join(n, "type").groupBy("nid").agg(F.min(F.struct("n", "type")).alias("m")).select("nid", F.col("m.type").alias("type"))


def one_label(nodes: DataFrame, node_types: DataFrame) -> DataFrame:
    """``(nid, label)``: the first type by name, ``ANY`` for a node without one."""
    first = node_types.groupBy("nid").agg(F.min("type").alias("label"))
    return nodes.select("nid").join(first, "nid", "left").select("nid", F.coalesce("label", F.lit("ANY")).alias("label"))


def node_labels(kg: KnowledgeGraph) -> DataFrame:
    """``(nid, label)``: every label that a pattern position may carry for a node, types and the instance itself."""
    from strikegraph.functions.columns import instance_label, type_label

    return kg.node_types.select("nid", type_label("type").alias("label")).unionByName(kg.nodes.select("nid", instance_label("nid").alias("label")))
