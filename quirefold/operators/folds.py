"""Folds over long logs."""

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame


def folded(rows: DataFrame, keys: Sequence[str], order: Sequence[str], new: Callable[[], Any], step: Callable[[Any, dict], Any], name: str, kind: str) -> DataFrame:
    """rows with a column of what `step` returns for each row of the keys in order, given a state that `new` makes
    for each of them.

    Keys are sorted within partitions and read batch by batch; only the state of the present key is held, so the length of a
    key's log does not matter.
    """
    read = list(dict.fromkeys([*keys, *order, *rows.columns]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(read).schema.fields)
    told = {"boolean": pa.bool_(), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if own != present:
                    present, state = own, new()
                out.append(step(state, row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, told)], [*batch.schema.names, name])

    return rows.select(read).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{schema}, {name} {kind}")
