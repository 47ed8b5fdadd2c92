"""Shared helpers: durable intermediates and distributed connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_COMPONENT_ROUNDS = 64
#: Bytes after which a batch of rows goes to a Python worker in a run of several stages; the row that reaches them is its last.
BATCH_BYTES = 1 << 19
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_kept: list[Callable] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at ``BATCH_BYTES``, or at what it has set if that is less.

    Spark's own 64 MB is a whole input split: it lies in the executor's direct memory and, as Arrow
    and as pandas, in each of its workers, which keep the room for the stages that follow.
    """
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if not 0 < size(spark.conf.get(_BATCH)) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def kept_by_worker(make: Callable) -> Callable:
    """Cache what ``make`` returns in this process until ``release``: workers outlive a stage."""
    _kept.append(lru_cache(maxsize=2)(make))
    return _kept[-1]


def release() -> None:
    """Forget in this worker what other stages have kept for tasks of their own."""
    for cached in _kept:
        cached.cache_clear()


def local_table(spark: SparkSession, **columns) -> DataFrame:
    """Columns of longs, few enough for the driver, as a table of the plan.

    Spark reads lists and pandas frames through an RDD, for which every executor starts a second
    Python daemon with workers of its own; an Arrow table needs none.
    """
    return spark.createDataFrame(pa.table({name: pa.array(values, pa.int64()) for name, values in columns.items()}))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set, but only if driver and executors
    are one process (tests, a single machine); a cluster without a shared folder is an error.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="choicelake-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write to Parquet in the shared folder and read back (compressed, columnar)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete ``stored`` tables that nothing will read again."""
    for df in tables:
        session = df.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(df._stored_path)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with as many underscores before it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def doc_crc(doc_id: str = "doc_id") -> Column:
    """CRC-32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def hash_sample(df: DataFrame, keys: list[str], bound: int) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of ``keys``; all rows if fewer.

    The choice depends on the keys and the row count alone, so a recomputed
    task picks the same rows.
    """
    n = df.count()
    if n <= bound:
        return df
    share = int(2**30 * (bound / n))
    return df.where(F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(2**30)) < share)


def _nonself(edges: DataFrame) -> DataFrame:
    return (
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component = least node reached.

    Alternates large-star and small-star rounds.  Stars are made by a minimum per
    node and a join back on it, never by gathering a node's neighbours.  The minima are
    stored first, so that both sides of the join are shuffles of their own and a hub with a
    third of all links is split as a skewed partition.  Each step is stored in the shared
    folder, which cuts the lineage, and deleted once the next one is; nothing but two totals
    reaches the driver.
    """
    edges = stored(_nonself(edges))
    before = None
    for _ in range(MAX_COMPONENT_ROUNDS):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = stored(_nonself(
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(least.select("a", F.col("m").alias("b")))
        ))
        discard(edges, least)
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")))
        edges = stored(_nonself(
            large.join(least, "a").select("b", "m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(least.select("a", F.col("m").alias("b")))
        ))
        discard(large, least)
        total = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).cast("string")
        ).first()
        if tuple(total) == before:
            break
        before = tuple(total)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
