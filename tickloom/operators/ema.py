"""Exponential moving averages: a recurrence, carried along sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship


def decay(period_or_alpha: float) -> float:
    """The weight of a new value, from that weight itself (below 1) or a period of rows."""
    return float(period_or_alpha) if period_or_alpha < 1 else 2.0 / (period_or_alpha + 1.0)


def starts(keys: list[pa.Array], n: int) -> np.ndarray:
    """Where runs of equal keys start among n rows, and n."""
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        code = k.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.append(np.flatnonzero(new), n)


#: Values that are averaged at once, and from how many on that is worth its other order of adding.
BLOCK, LONG = 64, 1024


def averaged(x: np.ndarray, a: float, start: float | None) -> np.ndarray:
    """The averages s = a * x + (1 - a) * s along the values, from `start` or else the first value:
    within blocks by one product of matrices, and from block to block by what is carried on."""
    out = np.empty(len(x))
    if not len(x):
        return out
    s = x[0] if start is None else start
    if len(x) < LONG:
        for i, v in enumerate(x.tolist()):
            out[i] = s = a * v + (1 - a) * s
    else:
        k = np.arange(BLOCK)
        fading = (1 - a) ** (k + 1.0)
        weights = np.where(k[:, None] >= k, a * (1 - a) ** np.maximum(k[:, None] - k, 0.0), 0.0)
        whole = len(x) // BLOCK * BLOCK
        blocks = x[:whole].reshape(-1, BLOCK) @ weights.T
        for row in blocks:
            row += fading * s
            s = row[-1]
        out[:whole] = blocks.ravel()
        out[whole:] = averaged(x[whole:], a, s)
    if start is None:
        out[0] = x[0]
    return out


def ema(rows: DataFrame, keys: list[str], order: list[str], columns: dict[str, tuple[str, float]]) -> DataFrame:
    """The rows with, for each name in `columns` (source column, weight), its moving average.

    The first value that isn't null starts a key's average; a null leaves it as it was.
    Rows are dealt out by key and sorted, then read once in batches: a key may be longer
    than memory.  Without keys there is one sequence, hence one task.
    """
    ship(rows.sparkSession)
    by = [F.col(k) for k in keys]
    dealt = rows.repartition(*by) if by else rows.coalesce(1)
    ordered = dealt.sortWithinPartitions(*by, *order)
    names = list(columns)
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run
        state: list[float | None] = [None] * len(names)
        for batch in batches:
            at = starts([batch.column(batch.schema.get_field_index(k)) for k in keys], batch.num_rows)
            first = tuple(batch.column(batch.schema.get_field_index(k))[0].as_py() for k in keys) if batch.num_rows else now
            made = []
            for j, (c, a) in enumerate(columns.values()):
                column = batch.column(batch.schema.get_field_index(c)).cast(pa.float64())
                given = column.is_valid().to_numpy(zero_copy_only=False)
                x = column.fill_null(0.0).to_numpy(zero_copy_only=False)
                out, some = np.zeros(len(x)), np.zeros(len(x), bool)
                for k, (i, e) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    s = state[j] if not k and first == now else None
                    values = averaged(x[i:e][given[i:e]], a, s)
                    # A null has what came last before it.
                    place = np.cumsum(given[i:e])
                    held = np.concatenate([[0.0 if s is None else s], values])
                    out[i:e], some[i:e] = held[place], (place > 0) | (s is not None)
                    state[j] = float(held[-1]) if len(values) else s
                made.append(pa.array(out, mask=~some))
            if batch.num_rows:
                now = tuple(batch.column(batch.schema.get_field_index(k))[-1].as_py() for k in keys)
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    return ordered.mapInArrow(run, schema)
