"""Questions about overlaps whose pairs nobody wants, answered per tile in numpy.

Both sides are cut to wide tiles, shuffled by (keys, tile) and met there. A tile's work is linear in its rows, however many
intervals lie over one another; no pair is formed. A tile's table is a slice of the genome, never a whole chromosome.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions.intervals import floor_div

WIDTH = 262_144
TILE_COL = "__tile"


def meet(left: DataFrame, right: DataFrame, on: Sequence[str], scan: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType) -> DataFrame:
    """``scan`` over the rows of both sides in each (keys, tile); rows without a key or tile meet nothing."""
    keys = [*on, TILE_COL]
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    return left.where(known).groupBy(*keys).cogroup(right.where(known).groupBy(*keys)).applyInArrow(scan, schema)


def tiles_of(start: str, end: str, width: int = WIDTH):
    """First and last tile of an interval."""
    first = floor_div(start, width)
    return first, F.greatest(floor_div(F.col(end) - 1, width), first)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def within(table: pa.Table, start: str, end: str, base: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Intervals cut to a tile, counted from its first base."""
    return np.clip(numbers(table, start) - base, 0, width), np.clip(numbers(table, end) - base, 0, width)


def coded(table: pa.Table, names: Sequence[str]) -> tuple[np.ndarray, pa.Table]:
    """Each row's number in the table of distinct values of some columns, nulls being values."""
    code = np.zeros(table.num_rows, np.int64)
    for name in names:
        column = table.column(name).combine_chunks()
        column = column if pa.types.is_dictionary(column.type) else pc.dictionary_encode(column, null_encoding="encode")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        code = code * (len(column.dictionary) + 1) + column.indices.to_numpy(zero_copy_only=False)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, table.select(list(names)).take(pa.array(first))


class Overlaps:
    """How many of some intervals of a tile overlap another one: those starting before its end less those ending by its start."""

    def __init__(self, start: np.ndarray, end: np.ndarray, asked: int, width: int):
        self.whole = asked * 16 > width
        if self.whole:
            self.before = np.concatenate(([0], np.cumsum(np.bincount(start, minlength=width + 1))))
            self.past = np.cumsum(np.bincount(end, minlength=width + 1))
        else:
            self.before, self.past = np.sort(start), np.sort(end)

    def count(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self.whole:
            return self.before[end] - self.past[start]
        return np.searchsorted(self.before, end, "left") - np.searchsorted(self.past, start, "right")


def overlap_sums(start: np.ndarray, end: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> np.ndarray:
    """Per asked interval of a tile the sums of some weights, a row each, over the intervals that start before its end and
    end after its start. Intervals without a base, on either side, are looked up by both ends at once."""
    sums = np.zeros((len(weights), len(low)), np.int64)
    proper, plain = start < end, low < high
    if proper.any() and plain.any():
        held = weights[:, proper]
        for at, asked, sign in ((start[proper], np.clip(high[plain], 1, width) - 1, 1), (end[proper], np.clip(low[plain], 0, width), -1)):
            at = np.clip(at, 0, width)
            order = np.argsort(at, kind="stable")
            if len(asked) * 16 > width:
                reached = np.cumsum(np.bincount(at, minlength=width + 1))[asked]
            else:
                reached = np.searchsorted(at[order], asked, "right")
            sums[:, plain] += sign * _running(held[:, order])[:, reached]
    for items, asks in ((~proper, plain), (proper, ~plain)):
        if items.any() and asks.any():
            sums[:, asks] += _sums_by_both(start[items], end[items], weights[:, items], low[asks], high[asks])
    return sums


def _running(weights: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros((len(weights), 1), np.int64), np.cumsum(weights, axis=1)), axis=1)


def _sums_by_both(start: np.ndarray, end: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums of weights over start < high and end > low: the items by start are halved by the bits of their ends' ranks."""
    order = np.argsort(start, kind="stable")
    right = np.searchsorted(start[order], high, "left")
    left = np.zeros_like(right)
    by_end = np.argsort(end[order], kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[by_end] = np.arange(len(order))
    least = np.searchsorted(end[order][by_end], low, "right")
    weights = weights[:, order]
    sums = np.zeros((len(weights), len(low)), np.int64)
    for bit in reversed(range(len(order).bit_length())):
        up = (rank >> bit) & 1 == 1
        past = (least >> bit) & 1 == 1
        above = _running(np.where(up, weights, 0))
        sums += np.where(past, 0, above[:, right] - above[:, left])
        below = np.concatenate(([0], np.cumsum(~up)))
        left, right = (np.where(past, below[-1] + at - below[at], below[at]) for at in (left, right))
        halves = np.argsort(up, kind="stable")
        rank, weights = rank[halves], weights[:, halves]
    total = _running(weights)
    return sums + total[:, right] - total[:, left]


def paint(start: np.ndarray, end: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """For each base of a tile the interval over it that comes last in an order, or -1."""
    top = np.full(width, -1, np.int64)
    for k, a, b in zip(order.tolist(), start[order].tolist(), end[order].tolist()):
        top[a:b] = k
    return top


def innermost(
    places: DataFrame, spans: DataFrame, carry: Sequence[str], on: Sequence[str], pos: str, span: tuple[str, str], width: int = WIDTH
) -> DataFrame:
    """Places that an interval holds, with ``__hit``: the carried columns of the one with the largest start, then the
    smallest end, then the largest carried values."""
    start, end = span
    spans = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(*on, start, end).agg(F.max(F.struct(*carry)).alias("__hit"))
    held = spans.withColumn(TILE_COL, F.explode(F.sequence(*tiles_of(start, end, width))))
    names = [*on, pos]

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.select(names).slice(0, 0).append_column("__hit", right.column("__hit").slice(0, 0))
        base = left.column(TILE_COL)[0].as_py() * width
        a, b = within(right, start, end, base, width)
        order = np.lexsort((-numbers(right, end), numbers(right, start)))
        found = paint(a, b, order, width)[numbers(left, pos) - base]
        inside = found >= 0
        hit = right.column("__hit").combine_chunks().take(pa.array(found[inside]))
        return left.select(names).filter(pa.array(inside)).append_column("__hit", hit)

    schema = StructType([*places.select(names).schema.fields, spans.schema["__hit"]])
    return meet(places.select(names).withColumn(TILE_COL, floor_div(pos, width)), held, on, scan, schema)
