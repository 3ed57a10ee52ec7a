"""Table cells that arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.tables import merge


def latest_cells(batch: DataFrame, *, order: str = "seq") -> DataFrame:
    """The last write of each cell in a batch."""
    return batch.groupBy("fn_id", "x", "y").agg(F.max_by("v", order).alias("v"))


def upsert_stream(cells: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, *, order: str = "seq"):
    """Start a query that merges each micro-batch of (fn_id, x, y, v, seq) into a stored table.

    ``write`` gets the whole merged table and the batch's number, and must replace the store at once;
    a batch that is run again gives the same table.
    """
    def run(batch: DataFrame, number: int) -> None:
        write(merge(read(), latest_cells(batch, order=order)), number)

    return cells.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
