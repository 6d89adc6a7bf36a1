"""Names for work columns beside the columns of any table, and batches in small parts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores put before it until no other column has it in any case."""
    seen, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in seen:
            name = f"_{name}"
        seen.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in parts of a few rows, so that a task holds little besides the batch itself."""
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))
