"""Arrow batches of texts cut into small pieces, so that what Python holds at once doesn't grow with the table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes of a piece; a single longer text is one alone with those before it.
ROWS, BYTES = 256, 2 << 20


def pieces(texts: pa.Array, rows: int = ROWS, most: int = BYTES) -> Iterator[slice]:
    """Places of a batch's pieces, in order, by the bytes of its texts."""
    if not len(texts):
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // most
    at = np.arange(len(texts))
    ends = [*(np.flatnonzero((np.diff(part) > 0) | (at[1:] % rows == 0)) + 1).tolist(), len(texts)]
    yield from map(slice, [0, *ends], ends)
