"""Ordered scans: a small state per key carried over rows in order, one pass, whatever the number of rows of a key.

Rows are dealt by key and sorted inside the tasks, so a task reads its keys one after the
other in Arrow batches and holds one state at a time; no key is gathered into one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ordered_scan(df: DataFrame, key: Sequence[str], order: Sequence[str], start: Callable[[], Any], step: Callable[[Any, dict[str, Any]], Sequence[tuple]], out: T.StructType) -> DataFrame:
    """The rows of ``step(state, row)`` for every row in the order within its key; ``start()`` makes a key's first state."""
    dealt = df.repartition(*key).sortWithinPartitions(*key, *order)
    keys = list(key)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        own, state = None, None
        for batch in batches:
            found: list[tuple] = []
            for row in batch.to_pylist():
                if state is None or [row[k] for k in keys] != own:
                    own, state = [row[k] for k in keys], start()
                found += step(state, row)
            if found:
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return dealt.mapInArrow(scan, out)
