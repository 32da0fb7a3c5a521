"""How far the sources of a language differ in their words, by SQL over shards.

Tasks count terms by language and source; the counts are dealt into shards by a hash of language and term, so a shard has all sources' counts of its
terms. In each shard DuckDB finds the terms to keep, and in a second turn, once Spark has the totals, the sums of differences of
each pair of sources and the best terms of each source. Spark adds the sums and ranks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import picked, rows_of, write_shared

#: Distinct terms that a task holds before it passes their counts on, and counts of a shard.
HELD, SHARD_ROWS = 300_000, 65_536
#: Added to each count, and the unit of a share.
SMOOTH, UNIT = 5, 1_000_000_000

_LETTERS = bytes((c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32) for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of A-Z, a-z and code points from 128 on, with A-Z in lower case; in UTF-8 such code points have such bytes only."""
    return text.translate(_LETTERS).split()


_COUNT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def passed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            yield rows_of(_COUNT, lang=[lang] * len(n), source=[source] * len(n), term=list(n), n=list(n.values()), docs=[docs[t] for t in n])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            found = terms(text)
            if found:
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                n.update(found)
                docs.update(set(found))
            if len(found) > HELD:
                yield from passed()
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from passed()
    yield from passed()


def term_counts(rows: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of each term in each group of ``rows(lang, source, text binary)``."""
    parts = rows.mapInArrow(_count_task, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).withColumn("term", F.col("term").cast("string"))


def _sql(query: str, **tables: pa.Table) -> pa.Table:
    """Runs a query of one shard on one thread."""
    import duckdb

    with duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB"}) as con:
        for name, table in tables.items():
            con.register(name, table)
        return con.sql(query).to_arrow_table()


def _cast(table: pa.Table, schema: pa.Schema) -> pa.Table:
    return table.select(schema.names).cast(schema)


_KEEP = """
SELECT shard, lang, source, term, n, sum(n) OVER w AS n_lang, row_number() OVER (w ORDER BY source) = 1 AS first
FROM counts WINDOW w AS (PARTITION BY lang, term) QUALIFY sum(docs) OVER w >= {least}
"""
_KEPT = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_lang", pa.int64()), ("first", pa.bool_())])
KEPT = "shard int, lang string, source string, term string, n long, n_lang long, first boolean"


def _keep_task(least: int):
    return lambda table: _cast(_sql(_KEEP.format(least=least), counts=table), _KEPT)


#: Differences are summed over the terms that either source has; for all others both shares are those of a count of 0.
_DIFFER = f"""
WITH z AS (SELECT lang, source, n_group + {SMOOTH}::HUGEINT * v AS size, n_all + {SMOOTH}::HUGEINT * v AS size_all FROM sources),
     zero AS (SELECT lang, source, (1 + {SMOOTH * UNIT}::HUGEINT // size)::BIGINT AS z FROM z),
     p AS (SELECT lang, source, term, (1 + {UNIT}::HUGEINT * (n + {SMOOTH}) // size)::BIGINT AS p, (1 + {UNIT}::HUGEINT * (n_lang + {SMOOTH}) // size_all)::BIGINT AS q, z
           FROM kept JOIN z USING (lang, source) JOIN zero USING (lang, source)),
     here AS (SELECT lang, count(*) FILTER (WHERE first) AS n_terms FROM kept GROUP BY lang),
     bins AS (SELECT lang, source, z, p, count(*) AS m FROM p GROUP BY ALL),
     sums AS (SELECT a.lang, a.source AS a, b.source AS b, n_terms * abs(a.z - b.z)::HUGEINT AS f
              FROM zero a JOIN zero b ON a.lang = b.lang AND a.source < b.source JOIN here ON here.lang = a.lang
              UNION ALL
              SELECT a.lang, least(a.source, b.source), greatest(a.source, b.source), sum(m * (abs(a.p - b.z) - abs(a.z - b.z))::HUGEINT)
              FROM bins a JOIN zero b ON a.lang = b.lang AND a.source <> b.source GROUP BY ALL
              UNION ALL
              SELECT a.lang, a.source, b.source, sum((abs(a.p - b.p) - abs(a.p - b.z) - abs(b.p - a.z) + abs(a.z - b.z))::HUGEINT)
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL)
SELECT lang, a AS source, 'pair' AS part, b AS item, sum(f)::BIGINT AS value FROM sums GROUP BY ALL
UNION ALL
SELECT lang, source, 'term', term, p - q FROM p WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {{top}}
"""
_PART = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _differ_task(top: int):
    return lambda kept, sources: _cast(_sql(_DIFFER.format(top=top), kept=kept, sources=sources), _PART) if kept.num_rows else _PART.empty_table()


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank``: how the sources of each language of ``docs(text, lang, source)`` differ.

    A language keeps the terms found in ``min_docs`` of its documents. ``pair``: every other source of the language with the sum of
    the differences of the two shares over the kept terms, 0 where none is kept. ``term``: the ``top`` terms whose share
    in the source exceeds that in the language most. Ranks count from 1 in each group and part, ties by the item's bytes. All
    arithmetic is on integers. Nulls are empty texts or names; a source without terms has the shares of zero counts; repeated rows
    count each; an empty table gives no rows; other columns are not read.
    """
    slim = picked(docs, text="string", lang="string", source="string")
    named = slim.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    groups = named.select("lang", "source").distinct()
    counts = write_shared(term_counts(named), "divergence-counts")
    shards = max(1, -(-counts.count() // SHARD_ROWS))
    placed = counts.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int"))
    kept = write_shared(placed.groupBy("shard").applyInArrow(_keep_task(min_docs), KEPT), "divergence-kept")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    all_ = kept.groupBy("lang").agg(F.sum("n").alias("n_all"), F.sum(F.col("first").cast("long")).alias("v"))
    sources = write_shared(groups.join(own, ["lang", "source"], "left").join(all_, "lang", "left").na.fill(0), "divergence-sources")
    there = kept.select(F.col("shard").alias("shard"), F.col("lang").alias("lang")).distinct().join(sources, "lang")
    parts = write_shared(kept.groupBy("shard").cogroup(there.groupBy("shard")).applyInArrow(_differ_task(top), "lang string, source string, part string, item string, value long"), "divergence-parts")
    sums = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = sources.select("lang", "source").join(sources.select("lang", F.col("source").alias("item")), "lang").where("source < item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").na.fill(0, ["value"])
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("w")
    pairs = pairs.select("lang", ways, "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    best = ranked(parts.where("part = 'term'")).where(F.col("rank") <= top)
    return ranked(pairs).unionByName(best).select("lang", "source", "part", "item", "value", "rank")


#: The same audit of ``documents`` for DuckDB, over every term of every group.
AUDIT_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row_no,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS x FROM documents),
     t AS (SELECT lang, source, row_no, unnest(x) AS term FROM d),
     k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row_no) >= 30),
     v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
     c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
     g AS (SELECT DISTINCT lang, source FROM d),
     gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
     p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (gn.n + 5 * v.v))::BIGINT AS p
           FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN gn ON gn.lang = g.lang AND gn.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
     ln AS (SELECT lang, sum(n) AS n FROM c GROUP BY lang), lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
     q AS (SELECT lc.lang, lc.term, (1 + 1000000000::HUGEINT * (lc.n + 5) // (ln.n + 5 * v.v))::BIGINT AS q FROM lc JOIN ln USING (lang) JOIN v USING (lang)),
     s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
               FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
     best AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM (FROM pairs UNION ALL FROM best) QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50
"""
