"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each document gets a number of copies drawn from a Poisson distribution whose mean is its source's
target repetition rate. The draw inverts the distribution at a uniform number hashed from the seed and
the document id (and, where ids are null or repeat, the row and its number among rows like it), so it needs no
state, is the same after any retry and in any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import placed, plain, write_shared

#: The largest mean that is inverted at once; a larger one is the sum of independent draws.
MEAN = 8.0
#: Table length for means up to MEAN: what lies beyond has a probability below 1e-30.
TABLE = 64
#: The columns that a mixture has besides those of the documents.
ADDED = ("replica", "n_copies", "shuffle_key")
#: So many equal rows are numbered in one task.
EQUAL = 10_000


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, temperature: float = 2.0) -> DataFrame:
    """``(source, n_docs, rate)``: the mean number of copies that brings each source to its target share.

    ``weights``: the target shares by source, in any unit; a source that is not named gets none. Without
    them a source weighs its number of documents to the power ``1 / temperature``. ``total``: the expected
    size of the mixture, by default the number of documents.
    """
    counts = plain(docs).groupBy(placed(docs, "source").alias("source")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        weight = F.sqrt("n_docs") if temperature == 2.0 else F.pow("n_docs", F.lit(1.0 / temperature))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        named = [F.lit(x) for name, w in weights.items() if name is not None for x in (name, float(w))]
        weight = F.coalesce(F.try_element_at(F.create_map(*named), F.col("source").cast("string")), F.lit(0.0)) if named else F.lit(0.0)
        weight = F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 0.0)))).otherwise(weight)
    counts = counts.withColumn("w", weight)
    counts = write_shared(counts, "mix-counts")
    w_all, n_all = counts.agg(F.sum("w"), F.sum("n_docs")).first()
    rate = F.col("w") / F.lit(w_all) * F.lit(n_all if total is None else total) / F.col("n_docs") if w_all else F.lit(0.0)
    return counts.select("source", "n_docs", rate.alias("rate"))


def seeded(docs: DataFrame, key: str) -> DataFrame:
    """``docs``, whose columns have plain names, with ``_seed``, a string of its own for each row: its ``key``, if no other row has it.

    Where an id is null or repeats, a hash of the whole row and a number among equal rows follow. Equal rows are
    counted, not gathered, and then dealt out again in runs of ``EQUAL``.
    """
    doc_id, cols = F.col(key).cast("string"), docs.columns
    again = write_shared(docs.where(f"{key} is not null").groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "mix-repeated")
    repeats, nulls = not again.isEmpty(), not docs.where(f"{key} is null").isEmpty()
    own = docs.join(again, key, "left_anti").select(cols) if repeats else docs
    own = (own.where(f"{key} is not null") if nulls else own).withColumn("_seed", doc_id)
    if not repeats and not nulls:
        return own
    odd = docs.where(f"{key} is null")
    if repeats:
        odd = odd.unionByName(docs.join(again, key, "left_semi").select(cols))
    counted = odd.withColumn("_h", F.md5(F.to_json(F.struct(*cols)))).groupBy("_h").agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in cols))
    runs = counted.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / EQUAL).cast("int"))).alias("_run"))
    first = F.col("_run").cast("long") * EQUAL
    each = runs.repartition("_h", "_run").select("*", F.explode(F.sequence(first + 1, F.least(F.col("_n"), first + EQUAL))).alias("_k"))
    seed = F.concat_ws(":", F.coalesce(doc_id, F.lit("null")), "_h", F.col("_k").cast("string"))
    return own.unionByName(each.select(*cols, seed.alias("_seed")))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: int = 1, temperature: float = 2.0) -> DataFrame:
    """The columns of ``docs`` with ``replica`` (from 1), ``n_copies`` and ``shuffle_key``, in global random order.

    A row appears ``n_copies`` times, rows drawn zero times do not. The partition and the place in it follow
    from ``shuffle_key``, a hash; sorting by it gives one uniform order of the whole mixture. Every row draws for itself,
    also where ids are null or repeat, and equal rows too; a null source counts as a source of its own; null
    and empty texts are rows like others. An empty table gives an empty mixture. Columns of ``docs`` named
    ``replica``, ``n_copies`` or ``shuffle_key`` are replaced.
    """
    keep = [i for i, c in enumerate(docs.columns) if c not in ADDED]
    return _mixed(docs, weights, total, seed, temperature).select(*(f"c{i}" for i in keep), *ADDED).toDF(*(docs.columns[i] for i in keep), *ADDED)


def mixture(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: int = 1, temperature: float = 2.0) -> DataFrame:
    """``mix`` with the columns of ``docs`` only, whatever their names."""
    return _mixed(docs, weights, total, seed, temperature).drop(*ADDED).toDF(*docs.columns)


def _mixed(docs: DataFrame, weights: dict[str | None, float] | None, total: int | None, seed: int, temperature: float) -> DataFrame:
    """``plain(docs)`` and ``ADDED`` of every copy, in the order of ``shuffle_key`` within partitions."""
    rows, key, source = plain(docs), f"c{docs.columns.index('doc_id')}", placed(docs, "source")
    rate = rates(docs, weights, total, temperature)
    draws = F.greatest(F.ceil(F.col("rate") / MEAN), F.lit(1))
    mean = F.col("rate") / draws
    terms = F.transform(F.sequence(F.lit(0), F.lit(TABLE - 1)), lambda k: F.exp(k * F.log(mean) - mean - _log_factorial(k)))
    sums = F.aggregate(terms, F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all")), lambda a, p: F.struct((a["sum"] + p).alias("sum"), F.concat(a["all"], F.array(a["sum"] + p)).alias("all")))
    # Written, so that Spark knows its size when it chooses between a broadcast and a shuffled join.
    table = write_shared(rate.where("rate > 0").select(F.col("source").alias("_source"), draws.cast("int").alias("_draws"), sums["all"].alias("_cdf")), "mix-rates")
    draw = lambda j: F.size(F.filter("_cdf", lambda c: c <= uniform(seed, F.col("_seed"), j.cast("string"))))
    n = F.aggregate(F.sequence(F.lit(1), F.col("_draws")), F.lit(0), lambda a, j: a + draw(j))
    drawn = seeded(rows, key).join(table, source.eqNullSafe(F.col("_source"))).withColumn("n_copies", n).where("n_copies > 0")
    copies = drawn.select(*rows.columns, "_seed", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("replica"))
    keyed = copies.withColumn("shuffle_key", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"order{seed}"), "_seed", F.col("replica").cast("string"))), 1, 15), 16, 10).cast("long"))
    return keyed.select(*rows.columns, *ADDED).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def _log_factorial(k: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))


#: The same mixture of ``documents`` for DuckDB, with the default parameters.
MIX_SQL = """
WITH counts AS (SELECT source, count(*) AS n_docs, sqrt(count(*)) AS w FROM documents GROUP BY source),
     rate AS (SELECT source, w / (SELECT sum(w) FROM counts) * (SELECT sum(n_docs) FROM counts) / n_docs AS rate FROM counts),
     split AS (SELECT source, greatest(ceil(rate / 8.0), 1)::INT AS draws, rate / greatest(ceil(rate / 8.0), 1) AS mean FROM rate),
     cdf AS (SELECT source, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
             FROM split, range(64) t(k)),
     u AS (SELECT d.doc_id, d.source, j, ('0x' || substr(md5('1:' || d.doc_id || ':' || j), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
           FROM documents d JOIN split s USING (source), range(1, 1000) t(j) WHERE j <= s.draws),
     drawn AS (SELECT u.doc_id, sum((SELECT count(*) FROM cdf WHERE cdf.source = u.source AND cdf.c <= u.u)) AS n FROM u GROUP BY u.doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, r.replica::INT AS replica, w.n::INT AS n_copies,
       ('0x' || substr(md5('order1:' || d.doc_id || ':' || r.replica), 1, 15))::BIGINT AS shuffle_key
FROM documents d JOIN drawn w USING (doc_id), range(1, 1000) r(replica) WHERE r.replica <= w.n
"""
