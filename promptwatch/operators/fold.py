"""Ordered per-key folds over sorted partitions.

Rows are hash-partitioned by key and sorted, then folded in one streaming pass: a task
holds one Arrow batch and one state, never a whole group, and many small keys share a
task without any per-group overhead. Where a batch can be solved at once, :func:`sorted_batches`
hands it over with its key changes instead of going row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


def ordered_fold(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    initial: Callable[[tuple], object],
    step: Callable[[object, tuple], tuple[object, tuple]],
    inputs: list[str],
    outputs: dict[str, str],
) -> DataFrame:
    """Append ``outputs`` (name -> type) computed row by row in ``order`` within ``keys``.

    ``initial(first_row)`` makes the state of a key; ``step(state, row)`` returns the next
    state and the output values. A row is the tuple of the ``inputs`` columns.
    """
    names = list(outputs)
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{n}` {t}" for n, t in outputs.items()]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            group = pdf[keys]
            before = group.shift()
            new = ~((group == before) | (group.isna() & before.isna())).all(axis=1).to_numpy()
            first = group.iloc[0]
            new[0] = last is None or not ((first == last) | (first.isna() & last.isna())).all()
            last = group.iloc[-1]
            produced = []
            for opens, row in zip(new.tolist(), zip(*[pdf[c].tolist() for c in inputs])):
                if opens:
                    state = initial(row)
                state, out = step(state, row)
                produced.append(out)
            for name, values in zip(names, zip(*produced)):
                pdf[name] = pd.Series(values, index=pdf.index, dtype="object").infer_objects()
            yield pdf

    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.mapInPandas(run, schema)


def sorted_batches(
    df: DataFrame, keys: list[str], order: list[str], solve: Callable[[pa.RecordBatch, np.ndarray, bool, object], tuple[list[pa.Array], object]],
    outputs: dict[str, str],
) -> DataFrame:
    """Append ``outputs``, which ``solve`` computes for a whole Arrow batch of sorted rows.

    ``solve(batch, new, goes_on, state)`` gets where a key begins, whether the first row goes on with the key of the
    batch before, and what it returned for that batch; it returns the output columns and the state of the last key.
    """
    names = list(outputs)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{n}` {t}" for n, t in outputs.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                code = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= code[1:] != code[:-1]
            first = tuple(batch.column(k)[0].as_py() for k in keys)
            goes_on = last is not None and first == last
            new[0] = not goes_on
            last = tuple(batch.column(k)[-1].as_py() for k in keys)
            columns, state = solve(batch, new, goes_on, state)
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.mapInArrow(run, schema)
