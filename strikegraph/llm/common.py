"""Pieces that several operators share: the shared folder, written tables, batches, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikegraph.sources.shared import release, shared_dir


def write_shared(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back, which cuts lineage."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/strikegraph/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def slices(batches: Iterator[pa.RecordBatch], chars: int = 1_000_000, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cuts Arrow batches into runs of whole rows of about ``chars`` UTF-8 bytes, with the texts (null: empty)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        block = np.cumsum(sizes) // chars
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                part = batch.slice(a, b - a)
                yield part, [t or "" for t in col.slice(a, b - a).to_pylist()]


def rows_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, type=f.type) for f in schema], schema=schema)


def picked(df: DataFrame, **kinds: str) -> DataFrame:
    """The columns of these exact names, cast; other columns may have any names, dots and names that differ in case included."""
    return plain(df).select(*(placed(df, name).cast(kind).alias(name) for name, kind in kinds.items()))


def plain(df: DataFrame) -> DataFrame:
    """``df`` with its columns named ``c0``, ``c1``, ... by place, for operators that carry all columns and add some."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def placed(df: DataFrame, name: str) -> Column:
    """The column of ``plain(df)`` that is named exactly so in ``df``."""
    if name not in df.columns:
        raise ValueError(f"no column {name}")
    return F.col(f"c{df.columns.index(name)}")


def numbered(df: DataFrame, name: str = "_rid") -> DataFrame:
    """A row number that is unique, not dense; write the result before using it twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def _marks(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u, v)`` (longs), as ``(node, root)`` with the smallest node as root.

    Alternates large-star and small-star steps until the edge table no longer changes; every step is
    a partial aggregate and an equi-join, and its result is a written table; a step's tables are deleted once the next is written. Nodes without an edge
    to another node do not appear.
    """
    e = write_shared(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc")
    mark = _marks(e)
    while mark[0]:
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = write_shared(e.join(low, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct(), "cc-large")
        release(e)
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        star = large.join(low, "v").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("s")).select(F.col("s.m").alias("u"), F.col("s.u").alias("v")).where("u <> v")
        e = write_shared(star.distinct(), "cc")
        release(large)
        before, mark = mark, _marks(e)
        if before == mark:
            break
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
