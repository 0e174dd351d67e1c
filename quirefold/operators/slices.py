"""Arrow batches cut by the bytes of their texts."""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on together; a longer text is alone.
BYTES = 1 << 20


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of a column, so what is made of them is small, however many rows come
    together. No row is copied."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False) + 64)
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, upto - at)
            at = upto
