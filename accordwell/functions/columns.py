"""Columns of Arrow batches as Python values."""

from __future__ import annotations

import pyarrow as pa


def python_values(column: pa.Array) -> list:
    """The same as ``column.to_pylist()`` at a fraction of its cost, for whole numbers, booleans, strings and maps of strings. Not for fractions, whose nulls would be NaN."""
    return column.to_pandas(integer_object_nulls=True).tolist()
