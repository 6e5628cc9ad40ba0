"""Folds with a state over sorted rows: what a window cannot say, as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def fold(rows: DataFrame, by: list[str], order: list[str], values: list[str], start: Callable, step: Callable, result: str) -> DataFrame:
    """``by``, ``order`` and the columns of ``result`` for every row of which ``step`` returns something.

    Groups (``by``) are dealt to partitions, sorted by ``order`` and read as a stream: ``step(state, *values)`` changes the state, which
    ``start()`` makes for each group, and returns a tuple or None.  Work is linear in the rows, and no group is held;
    a group is one task's, as each step needs the one before.
    """
    keys = [*by, *order]
    rows = rows.select(*keys, *[F.col(v).alias(f"__v{k}") for k, v in enumerate(values)])
    added = StructType.fromDDL(result)
    schema = StructType([*rows.select(*keys).schema.fields, *added.fields])
    n_by, n_keys = len(by), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in added.fields]
        group, state, begun = None, None, False
        for batch in batches:
            at, out = [], []
            columns = [c.to_pylist() for c in batch.columns]
            for k, row in enumerate(zip(*columns, strict=True)):
                if not begun or row[:n_by] != group:
                    group, state, begun = row[:n_by], start(), True
                found = step(state, *row[n_keys:])
                if found is not None:
                    at.append(k)
                    out.append(found)
            kept = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:n_keys]]
            new = [pa.array([o[k] for o in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*kept, *new], [*keys, *added.names])

    return rows.repartition(*by).sortWithinPartitions(*keys).mapInArrow(run, schema)
