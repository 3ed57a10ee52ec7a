"""Keyed reference values with tags: reload, lookup, and replication in chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.tables import merge, split


def reload(current: DataFrame, loaded: DataFrame, *, replace: bool) -> DataFrame:
    """(key, is_tag, value) after a load: ``replace`` drops direct values first, never tags; loaded rows win."""
    kept = current.where(F.col("is_tag") | F.lit(not replace)).select("key", "is_tag", F.col("value").alias("__old"))
    return kept.join(loaded.select("key", "is_tag", F.col("value").alias("__new")), ["key", "is_tag"], "full").select("key", "is_tag", F.coalesce("__new", "__old").alias("value"))


def lookup(queries: DataFrame, values: DataFrame, members: DataFrame, *, key: str, default: float, out: str = "value") -> DataFrame:
    """``queries`` with a key's own value, else that of its first tag by name, else the default.

    ``members`` (tag, id) is expanded at each call; a key in several valued tags takes the least tag name.
    """
    direct = values.where("not is_tag").select(F.col("key").alias("__k"), F.col("value").alias("__v"))
    tags = values.where("is_tag").select(F.col("key").alias("tag"), F.col("value").alias("__t"))
    tagged = members.join(tags, "tag").groupBy(F.col("id").alias("__m")).agg(F.min_by("__t", "tag").alias("__t"))
    met = queries.join(direct, F.col(key) == F.col("__k"), "left").join(tagged, F.col(key) == F.col("__m"), "left")
    return met.select(*queries.columns, F.coalesce("__v", "__t", F.lit(default)).alias(out))


def replicate(table: DataFrame, *, most: int = 1000) -> DataFrame:
    """A table's chunks for replication, dealt by chunk."""
    return split(table, most).repartition("fn_id", "chunk_id")


def apply_chunk(table: DataFrame, chunk: DataFrame) -> DataFrame:
    """A table after a chunk: its cells are merged in, none is lost."""
    return merge(table, chunk.select("fn_id", "x", "y", "v"))
