"""Tables written into the folder that driver and executors share, which cuts lineage and plans short."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where a local session leaves it unset, a temporary folder."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not hasattr(spark, "_strikegraph_tables"):
        spark._strikegraph_tables = "file://" + tempfile.mkdtemp(prefix="strikegraph-")
    return spark._strikegraph_tables


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a written table. Nested caches would do as well for data, but each plan would hold the plans of all caches below it."""
    path = f"{shared_dir(df.sparkSession)}/strikegraph/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def bucketed(df: DataFrame, *keys: str, path: str | None = None, buckets: int | None = None, distinct: bool = False, placed: bool = False) -> DataFrame:
    """``df`` as a written table in ``buckets`` (by default as many as shuffles have) of ``keys``, sorted by them.

    A join or an aggregate on ``keys`` reads it without an exchange. ``distinct``: repeated rows are dropped, bucket by bucket;
    ``placed``: the rows come from such a table of as many buckets and lie as they should.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/strikegraph/kept-{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"strikegraph_{uuid.uuid4().hex}"
    rows = df if placed else df.repartition(buckets, *keys)
    (rows.distinct() if distinct else rows).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: only its name goes
    return read_bucketed(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), keys, buckets)


def read_bucketed(spark: SparkSession, path: str, columns: str, keys: tuple[str, ...], buckets: int) -> DataFrame:
    """A table that ``bucketed`` has written, its buckets known to the planner. ``columns``: names and types as in SQL."""
    name = f"strikegraph_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(keys)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    out.kept_at, out.buckets = path, buckets
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``kept`` has written, once what was made from them is written too."""
    for df in tables:
        if at := getattr(df, "kept_at", None):
            jvm = df.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
