"""Groups of rows that stream through a task one at a time, without a pandas frame for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame


def dealt(rows: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """``rows`` with each ``key`` whole in one task, in order.

    The number of tasks is the session's shuffle partitions and is not reduced by size: solving takes time
    that the few bytes of a small model do not show.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).sortWithinPartitions(key, *order)


def listed(column: pa.Array) -> list:
    """What ``to_pylist`` gives, for flat columns, lists and maps, without a call for each value."""
    kind = column.type
    if pa.types.is_list(kind) or pa.types.is_map(kind):
        inner = list(zip(listed(column.keys), listed(column.items), strict=True)) if pa.types.is_map(kind) else listed(column.values)
        ends = column.offsets.to_pylist()
        return [inner[a:b] if there else None for a, b, there in zip(ends, ends[1:], column.is_valid().to_pylist(), strict=False)]
    if pa.types.is_string(kind):
        codes = column.dictionary_encode()
        return np.array([*codes.dictionary.to_pylist(), None], dtype=object)[codes.indices.fill_null(len(codes.dictionary)).to_numpy()].tolist()
    if not pa.types.is_floating(kind) and not pa.types.is_integer(kind):
        return column.to_pylist()
    if not column.null_count:
        return column.to_numpy().tolist()
    values = column.fill_null(0).to_numpy().astype(object)
    values[column.is_null().to_numpy(zero_copy_only=False)] = None
    return values.tolist()


def _joined(pieces: list[list]) -> list:
    if len(pieces) == 1:
        return pieces[0]
    return [np.concatenate(x) if isinstance(x[0], np.ndarray) else list(chain.from_iterable(x)) for x in zip(*pieces, strict=True)]


def groups(batches: Iterator[pa.RecordBatch], convert: Callable[[pa.Array], np.ndarray | list]) -> Iterator[tuple[str | None, list]]:
    """(key, other columns) of each run of equal keys; the key is the first column, sorted.

    Columns are converted a batch at a time; memory is one batch and one group.
    """
    held: list[list] = []
    now: str | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_pylist()
        columns = [convert(c) for c in batch.columns[1:]]
        start = 0
        for end in [*(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]:
            if held and keys[start] != now:
                yield now, _joined(held)
                held = []
            now = keys[start]
            held.append([c[start:end] for c in columns])
            start = end
    if held:
        yield now, _joined(held)
