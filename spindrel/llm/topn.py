"""The N best items of every group by mergeable bounded heaps.

Each map task keeps, per group, at most N distinct items (its heap); a heap that has
seen part of a group's rows holds every item of that part which can still be among
the N best, so heaps may be merged in any order and any number of times. Only heaps
are shuffled: a group with a third of all rows sends N rows per map task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NULLABLE = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}

#: Entries that are gathered before they are merged into the heaps, and heap entries that are held before a task passes them on.
GATHER, HOLD = 1 << 19, 1 << 21


def bounded(entries: pd.DataFrame, n: int) -> pd.DataFrame:
    """The heaps of the entries (g, i, s): per g the n best i by s, largest first, equal ones by the smaller i; an i counts once, with its largest s."""
    entries = entries.sort_values(["s", "i"], ascending=[False, True], kind="stable").drop_duplicates(["g", "i"])
    return entries[entries.groupby("g", dropna=False, sort=False).cumcount() < n]


def _entries(batch: pa.RecordBatch, skip: tuple) -> pd.DataFrame:
    """Flatten (g, items, scores) to entries that count."""
    items, scores = batch.column(1), batch.column(2)
    n_items = pc.fill_null(pc.list_value_length(items), 0).to_numpy(zero_copy_only=False)
    n_scores = pc.fill_null(pc.list_value_length(scores), 0).to_numpy(zero_copy_only=False)
    n = np.minimum(n_items, n_scores)
    at_i = np.concatenate([[0], np.cumsum(n_items)[:-1]]) if len(n) else n
    at_s = np.concatenate([[0], np.cumsum(n_scores)[:-1]]) if len(n) else n
    row = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    flat_i, flat_s = items.flatten(), scores.flatten()
    i = flat_i.take(pa.array(at_i[row] + within, pa.int64()))
    s = flat_s.take(pa.array(at_s[row] + within, pa.int64()))
    ok = pc.and_(i.is_valid(), pc.and_(s.is_valid(), pc.fill_null(pc.invert(pc.is_nan(pc.cast(s, pa.float64()))), False)))
    if skip:
        ok = pc.and_(ok, pc.invert(pc.is_in(i, pa.array(skip, i.type))))
    g = batch.column(0).take(pa.array(row, pa.int64()))
    kept = pa.table({"g": g, "i": i, "s": s}).filter(ok)
    # nullable integers stay whole numbers in pandas
    return kept.to_pandas(types_mapper=_NULLABLE.get)


def top_n(df: DataFrame, group: str | Column, items: str | Column, scores: str | Column, n: int = 10, skip: tuple = (), names: tuple[str, str, str] = ("group", "item", "score")) -> DataFrame:
    """The ``n`` best items of every group, as rows (group, item, score).

    ``items`` and ``scores`` are arrays of equal positions, or plain columns with one entry a row. An item counts once
    in a group, with its largest score; equal scores are ranked by the smaller item. Entries with a null or NaN score,
    a null item, an item in ``skip``, or no partner at their position in the other array don't count; null or empty
    arrays have no entries. A null group is a group. A group without entries has no rows; an empty table gives none.
    """
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    narrow = df.select(as_column(group).alias("g"), as_column(items).alias("i"), as_column(scores).alias("s"))
    kinds = {f.name: f.dataType for f in narrow.schema}
    if not isinstance(kinds["i"], T.ArrayType):
        narrow = narrow.select("g", F.array("i").alias("i"), F.array("s").alias("s"))
    inner = lambda t: t.elementType if isinstance(t, T.ArrayType) else t
    out = T.StructType([T.StructField("g", kinds["g"]), T.StructField("i", inner(kinds["i"])), T.StructField("s", inner(kinds["s"]))])

    def heaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pd.DataFrame | None = None
        waiting: list[pd.DataFrame] = []
        size = 0
        schema = None

        def passed(frame: pd.DataFrame) -> Iterator[pa.RecordBatch]:
            yield from pa.Table.from_pandas(frame, schema=schema, preserve_index=False).to_batches(max_chunksize=1 << 16)

        for batch in batches:
            if schema is None:
                schema = pa.schema([("g", batch.schema.field(0).type), ("i", batch.schema.field(1).type.value_type), ("s", batch.schema.field(2).type.value_type)])
            waiting.append(_entries(batch, skip))
            size += len(waiting[-1])
            if size >= GATHER:
                held = bounded(pd.concat([*([held] if held is not None else []), *waiting], ignore_index=True), n)
                waiting, size = [], 0
                if len(held) > HOLD:  # more groups than a task should hold: what it has is passed on, the merge sees to it
                    yield from passed(held)
                    held = None
        rest = [x for x in ([held] if held is not None else []) + waiting if len(x)]
        if rest:
            yield from passed(bounded(pd.concat(rest, ignore_index=True), n))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # heaps of a group follow each other: only the last group of a batch can go on in the next one
        open_: pd.DataFrame | None = None
        schema = None
        for batch in batches:
            schema = batch.schema
            frame = pa.Table.from_batches([batch]).to_pandas(types_mapper=_NULLABLE.get)
            frame = bounded(frame if open_ is None else pd.concat([open_, frame], ignore_index=True), n).sort_values("g", kind="stable", na_position="first")
            if not len(frame):
                continue
            last = batch.column(0)[-1].as_py()
            goes_on = frame["g"].isna() if last is None else (frame["g"] == last).fillna(False)
            open_, whole = frame[goes_on], frame[~goes_on]
            yield from pa.Table.from_pandas(whole, schema=schema, preserve_index=False).to_batches(max_chunksize=1 << 16)
        if open_ is not None:
            yield from pa.Table.from_pandas(open_, schema=schema, preserve_index=False).to_batches(max_chunksize=1 << 16)

    # one shuffle of heaps; a group's are merged as they come, N entries at a time, however many tasks sent one
    gathered = narrow.mapInArrow(heaps, out).repartition("g").sortWithinPartitions("g")
    return gathered.mapInArrow(merged, out).select(F.col("g").alias(names[0]), F.col("i").alias(names[1]), F.col("s").alias(names[2]))
