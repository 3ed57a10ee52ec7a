"""Helpers the corpus operators share: durable tables, size-checked joins, Arrow text access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose key set may be broadcast after its count has been checked (two longs a row).
BROADCAST_ROWS = 1_000_000

#: Bytes after which an Arrow batch ends while a table is written; one row may be larger.  Narrow rows keep Spark's number a batch.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "2m")

#: Code points that count as white space in every contract of this package.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine may do without (as in tests): it gets a temporary one.  On a cluster
    a machine-local folder would lose tables with their executor, so a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quillon-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of bounded bytes meanwhile: a batch stands in the JVM and in its Python worker at once.

    A limit that the session has set itself stays.
    """
    key, most = BATCH
    if key in spark.conf.getAll:
        yield
        return
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.unset(key)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, executors may go.

    Texts go through Python in small batches.  The application's folder is removed when the application ends.
    """
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/quillon/{spark.sparkContext.applicationId}"
    path = f"{home}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(home)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are within ``rows``; else as it is, for a shuffled join.

    ``df`` should be materialized: it is counted here and read again in the join.
    """
    return F.broadcast(df) if df.count() <= rows else df


def named(column: str) -> Column:
    """The column of just that name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns of our own that ``df`` does not have, in any case of letters."""
    had, lead = {c.lower() for c in df.columns}, "__ql_"
    while any(lead + x in had for x in wanted):
        lead += "_"
    return [lead + x for x in wanted]


def fold(bucket: Column | str, modulus: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``modulus`` (null stays null)."""
    return F.crc32(F.col(bucket).cast("string") if isinstance(bucket, str) else bucket) % modulus


def binary_texts(batch: pa.RecordBatch, column: str, rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of a batch with one text column as UTF-8 bytes."""
    at = batch.schema.get_field_index(column)
    for start in range(0, batch.num_rows, rows):
        part = batch.slice(start, rows)
        yield part, part.column(at).cast(pa.binary()).to_pylist()


def bounded_sample(rows: DataFrame, key: str, most: int, by: str | None = None, seed: int = 17) -> DataFrame:
    """About ``most`` rows (for each value of ``by``), chosen by a hash of ``key``: the same rows on each run.

    Only for fitting classifiers.  All rows come back where there are no more than ``most``.
    """
    hashed = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    if by is None:
        n = rows.count()
        return rows if n <= most else rows.where(hashed < most / n)
    share = F.lit(1.0)
    for value, n in rows.groupBy(by).count().where(F.col("count") > most).collect():
        share = F.when(F.col(by) == F.lit(value), F.lit(most / n)).otherwise(share)
    return rows.where(hashed < share)


def repeated(rows: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """The rows whose ``key`` (a long) stands in two rows or more.

    One shuffle by key and a sort within partitions (both spill); sorted batches then stream through a
    comparison of neighbours, so a key that any number of rows hold takes no memory of its own.
    """
    import numpy as np

    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far, and whether the row before has its key
        told = False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(at).to_numpy()
            same = np.zeros(len(keys) + 1, dtype=bool)
            same[1:-1] = keys[1:] == keys[:-1]
            if held is not None:
                same[0] = held.column(at)[0].as_py() == int(keys[0])
                if told or same[0]:
                    yield held
            keep = same[:-1] | same[1:]
            keep[-1] = False  # decided with the next batch
            yield batch.filter(pa.array(keep))
            held, told = batch.slice(len(keys) - 1), bool(same[-2])
        if held is not None and told:
            yield held

    dealt = rows.repartition(key) if partitions is None else rows.repartition(partitions, key)
    return dealt.sortWithinPartitions(key).mapInArrow(run, rows.schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of ``edges`` (a long, b long): comp is the smallest node reachable.

    Alternating large-star and small-star rounds: plain joins and minimum aggregates over the edges, each
    round written to the shared folder, about log2 of the longest path of them.  Nothing is collected
    but a count and a checksum a round.
    """
    def seal(e: DataFrame) -> tuple[DataFrame, tuple]:
        e = materialize(e, "edges")
        return e, tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now, mark = seal(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if not mark[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        roots = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(roots, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then, sign = seal(small.unionByName(roots.select("u", F.col("m").alias("v"))).distinct())
        if sign == mark:
            break
        now, mark = then, sign
    return then.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(then.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
