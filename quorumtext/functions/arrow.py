"""Arrow functions that are declared without a running session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(schema: str) -> Callable[[Callable], Callable[..., Column]]:
    """Like F.pandas_udf(schema), but the schema is parsed when the function is first applied to columns."""

    def made(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def apply(*columns: str | Column) -> Column:
            return F.pandas_udf(f, schema)(*columns)

        return apply

    return made


def arrays(schema: str) -> Callable[[Callable], Callable[..., Column]]:
    """Like arrow(), for functions of Arrow arrays: nested values stay in the buffers they came in."""

    def made(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def apply(*columns: str | Column) -> Column:
            return F.arrow_udf(f, schema)(*columns)

        return apply

    return made


def images_of(pages: pa.Array) -> list[np.ndarray]:
    """Images given as arrays of rows of grey levels, (height, width) each; null and empty ones have no pixels."""
    none = np.empty((0, 0), np.uint8)
    if not isinstance(pages, pa.ListArray):
        pages = pages.cast(pa.list_(pages.type.value_type))
    rows = pages.values
    at, ends = np.asarray(pages.offsets), np.asarray(rows.offsets)
    grey = rows.values.to_numpy(zero_copy_only=False).astype(np.uint8)
    out = []
    for a, b, valid in zip(at[:-1].tolist(), at[1:].tolist(), pages.is_valid().to_numpy(zero_copy_only=False).tolist(), strict=True):
        width = int(ends[a + 1] - ends[a]) if valid and b > a else 0
        if valid and b > a and (np.diff(ends[a : b + 1]) != width).any():
            raise ValueError("an image's rows differ in length")
        out.append(grey[ends[a] : ends[b]].reshape(b - a, width) if width else none)
    return out


def pixels(images: list[np.ndarray]) -> pa.Array:
    """array<array<int>> of images, the way back from images_of()."""
    heights = np.array([len(x) for x in images], np.int64)
    widths = np.repeat([x.shape[1] for x in images], heights).astype(np.int64)
    offsets = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    values = pa.array(np.concatenate([x.ravel() for x in images]).astype(np.int32) if images else np.empty(0, np.int32))
    return pa.ListArray.from_arrays(offsets(heights), pa.ListArray.from_arrays(offsets(widths), values))
