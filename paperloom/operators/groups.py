"""Folds over many small groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_group(rows: DataFrame, keys: list[str], order: list[str], values: list[str], fold: Callable, schema: str) -> DataFrame:
    """fold(values' arrays) of each group, sorted by `order`; it returns one array for each column of the schema.

    Groups are runs within sorted partitions, so thousands of small ones share a batch; the open
    group of a batch is carried to the next one. A group is one page's or image's rows.
    """
    types = dict(rows.dtypes)
    made = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def folded(table: pa.Table, cuts: list[int]) -> pa.RecordBatch:
            arrays = [table.column(v).combine_chunks().to_numpy(zero_copy_only=False) for v in values]
            found = [fold(*[x[a:b] for x in arrays]) for a, b in zip(cuts[:-1], cuts[1:])]
            sizes = [len(f[0]) for f in found]
            at = pa.array(np.repeat(cuts[:-1], sizes))
            columns = [table.column(k).take(at).combine_chunks() for k in keys]
            columns += [pa.array(np.concatenate([f[i] for f in found])) for i in range(len(made))]
            return pa.RecordBatch.from_arrays(columns, names=[*keys, *made])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if not held.num_rows:
                continue
            new = np.zeros(held.num_rows, bool)
            new[0] = True
            for k in keys:
                column = held.column(k).combine_chunks()
                new[1:] |= np.asarray(pc.fill_null(pc.not_equal(column[1:], column[:-1]), True))
            cuts = np.flatnonzero(new).tolist()
            if len(cuts) > 1:
                yield folded(held, cuts)
                held = held.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield folded(held, [0, held.num_rows])

    slim = rows.select(*keys, *dict.fromkeys([*order, *values])).repartition(*keys).sortWithinPartitions(*keys, *order)
    return slim.mapInArrow(run, ", ".join([f"{k} {types[k]}" for k in keys] + [schema]))


def _changed(column: pa.Array) -> np.ndarray:
    """Whether a value differs from the one before; null is like null."""
    after, before = column[1:], column[:-1]
    return np.asarray(pc.coalesce(pc.not_equal(after, before), pc.xor(pc.is_null(after), pc.is_null(before))))


def overlap_labels(group: np.ndarray, same: np.ndarray, boxes: list[np.ndarray], least: float) -> np.ndarray:
    """For each box the first row that it reaches by overlaps (IoU from `least` on) within its group.

    `same` marks rows with the id of the row before; groups are numbered in order, -1 meets nothing.
    Boxes are met by rising left edges, for as long as they reach each other, so the work follows the pairs that overlap in x.
    """
    root = np.arange(len(group))
    kept: list[tuple[np.ndarray, np.ndarray]] = []

    def join() -> None:
        a, b = (np.concatenate(c) for c in zip(*kept))
        kept.clear()
        while True:
            p, q = root[a], root[b]
            off = p != q
            if not off.any():
                return
            a, b, p, q = a[off], b[off], p[off], q[off]
            np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up

    if same.any():
        kept.append((np.flatnonzero(same) - 1, np.flatnonzero(same)))
    order = np.lexsort((boxes[0], group))
    x0, y0, x1, y1, g = (x[order] for x in (*boxes, group))
    with np.errstate(all="ignore"):
        area = (x1 - x0) * (y1 - y0)
        at, step = np.flatnonzero(g >= 0), 0
        while len(at):
            step += 1
            at = at[at + step < len(g)]
            to = at + step
            near = (g[at] == g[to]) & (x0[to] < x1[at])
            at, to = at[near], to[near]
            shared = np.maximum(np.minimum(x1[at], x1[to]) - x0[to], 0) * np.maximum(np.minimum(y1[at], y1[to]) - np.maximum(y0[at], y0[to]), 0)
            hit = np.floor(shared / (area[at] + area[to] - shared) * 1e6 + 0.5) / 1e6 >= least
            if hit.any():
                kept.append((order[at[hit]], order[to[hit]]))
            if sum(len(a) for a, _ in kept) > 1_000_000:
                join()
    if kept:
        join()
    return root


def overlap_components(boxes: DataFrame, keys: list[str], least: float, id_col: str = "box_id") -> DataFrame:
    """(keys, id, component): the smallest id that a box reaches by overlaps (IoU from `least` > 0 on) within its image.

    One shuffle by image; the whole images of an Arrow batch are folded at once, the open one is carried on.
    Null keys or ids meet nothing, and boxes of one id are one.
    """
    types = dict(boxes.dtypes)
    sides = ["x0", "y0", "x1", "y1"]

    def folded(table: pa.Table, new: np.ndarray) -> pa.RecordBatch:
        names = table.column("id").combine_chunks()
        first = new | np.concatenate([[True], _changed(names)])
        lone = np.asarray(names.is_null())
        for k in keys:
            lone = lone | np.asarray(table.column(k).combine_chunks().is_null())
        group = np.where(lone, -1, np.cumsum(new))
        root = overlap_labels(group, ~first, [table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in sides], least)
        own = table.filter(pa.array(first))
        columns = [own.column(c).combine_chunks() for c in [*keys, "id"]] + [names.take(pa.array(root[first]))]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, "id", "component"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []  # the rows of the open image and those before it
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            keyed = pa.concat_tables([last, table.select(keys)]) if last is not None else table.select(keys)
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                changed = _changed(keyed.column(k).combine_chunks())
                new |= changed if last is not None else np.concatenate([[True], changed])
            last = table.select(keys).slice(batch.num_rows - 1)
            cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
            if new.any() and (cut or parts):
                whole = pa.concat_tables([*parts, table.slice(0, cut)])
                if whole.num_rows:
                    yield folded(whole, starts(whole))
                parts = []
            parts.append(table.slice(cut))
        if parts:
            whole = pa.concat_tables(parts)
            yield folded(whole, starts(whole))

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in keys:
            new[1:] |= _changed(table.column(k).combine_chunks())
        return new

    slim = boxes.select(*keys, F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(c) for c in sides])
    slim = slim.repartition(*keys).sortWithinPartitions(*keys, "id")
    made = [f"{k} {types[k]}" for k in keys] + [f"id {types[id_col]}", f"component {types[id_col]}"]
    return slim.mapInArrow(run, ", ".join(made))
