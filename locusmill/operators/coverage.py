"""Overlap-weighted sums of signal over features and over fixed bins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.intervals import clip_to, floor_div, overlap_bp
from .intervals import tile
from .tiles import TILE_COL, WIDTH, coded, meet, numbers, overlap_sums


def library_totals(track: DataFrame, by: Sequence[str] = ("sample", "track_strand")) -> DataFrame:
    """Total signal per library file."""
    return track.groupBy(*by).agg(F.sum(F.col("value") * (F.col("end_pos") - F.col("start_pos"))).alias("total"))


def clip_spans(spans: DataFrame, sizes: DataFrame) -> DataFrame:
    """Spans cut to their chromosome; spans empty after the cut and unknown chromosomes drop out."""
    lo, hi = clip_to("start_pos", "end_pos", "size")
    cut = spans.join(F.broadcast(sizes.select("chrom", "size")), "chrom").withColumns({"start_pos": lo, "end_pos": hi}).drop("size")
    return cut.where(F.col("start_pos") < F.col("end_pos"))


def signal_sums(
    spans: DataFrame, track: DataFrame, key: Sequence[str], by: Sequence[str] = ("sample", "track_strand"), width: int = WIDTH
) -> DataFrame:
    """sum(value * overlapped bases) per (span key, track); spans without signal get no row.

    A tile of the genome takes a span's sum from running sums of its steps, so no pair of span and step is formed.
    """
    key, by = list(key), list(by)
    kind = {f.name: f.dataType for f in (*spans.schema, *track.schema)}
    schema = StructType([*[StructField(c, kind[c]) for c in (*key, *by)], StructField("signal", DoubleType())])
    arrow = to_arrow_schema(schema)

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for of, sums, met in tile_sums(left, right, by, width):
            rows = np.flatnonzero(met)
            made.append(pa.table({
                **{c: left.column(c).take(pa.array(rows)) for c in key},
                **{c: pa.array([v] * len(rows), arrow.field(c).type) for c, v in zip(by, of)}, "signal": sums.take(pa.array(rows)),
            }).cast(arrow))
        return pa.concat_tables(made) if made else arrow.empty_table()

    found = meet(span_tiles(spans.select(*key, "chrom", "start_pos", "end_pos"), width), step_tiles(track, by, width), ["chrom"], scan, schema)
    return found.groupBy(*key, *by).agg(F.sum("signal").alias("signal"))


def span_tiles(spans: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per tile a span touches; spans without a place touch none."""
    return tile(spans.where("start_pos is not null and end_pos is not null"), "start_pos", "end_pos", width, TILE_COL)


def step_tiles(track: DataFrame, by: Sequence[str] = ("sample", "track_strand"), width: int = WIDTH) -> DataFrame:
    """One row per tile a step touches, equal steps being summed; steps without a place touch none."""
    steps = track.where("start_pos is not null and end_pos is not null").groupBy(
        *by, "chrom", F.col("start_pos").alias("r_start"), F.col("end_pos").alias("r_end")
    ).agg(F.sum("value").cast("double").alias("value"))
    return tile(steps, "r_start", "r_end", width, TILE_COL)


def tile_sums(left: pa.Table, right: pa.Table, by: Sequence[str], width: int) -> Iterator[tuple[tuple, pa.Array, np.ndarray]]:
    """For each track with steps in a tile: its name, per span the sum of value times overlapped bases in the tile, null where all
    values under it are, and whether a step overlaps it there."""
    if not left.num_rows or not right.num_rows:
        return
    base = left.column(TILE_COL)[0].as_py() * width
    low, high, start, end = (numbers(t, c).astype(np.int64) - base for t, c in ((left, "start_pos"), (left, "end_pos"), (right, "r_start"), (right, "r_end")))
    code, tracks = coded(right, by)
    value = right.column("value")
    has, value = value.is_valid().to_numpy(), value.fill_null(0.0).to_numpy()
    names = list(zip(*[tracks.column(c).to_pylist() for c in by]))
    for k, of in enumerate(names):
        rows = np.flatnonzero(code == k)
        sums, met = step_sums(start[rows], end[rows], value[rows], has[rows], low, high, width)
        yield of, sums, met


#: Bits of a value that one integer holds, so that their running sums over a tile stay within 63.
BITS, LIMBS = 20, 4


def step_sums(
    start: np.ndarray, end: np.ndarray, value: np.ndarray, has: np.ndarray, low: np.ndarray, high: np.ndarray, width: int
) -> tuple[pa.Array, np.ndarray]:
    """Per span [low, high) of a tile the sum of value times overlapped bases over the steps [start, end), and whether it meets one.

    Values are split into whole numbers of BITS bits each, relative to the largest one, and summed exactly: neither the order of the
    steps nor large values beside the span leave a trace. Values that are no numbers count under the spans that they overlap.
    """
    finite = has & np.isfinite(value)
    largest = np.abs(value[finite]).max(initial=0.0)
    scale = int(np.frexp(largest)[1])
    rest, limbs = np.where(finite, value, 0.0), []
    for k in range(1, LIMBS + 1):
        part = np.rint(np.ldexp(rest, k * BITS - scale))
        rest = rest - np.ldexp(part, scale - k * BITS)
        limbs.append(part.astype(np.int64))
    whole = np.stack(limbs)
    plain = start < end
    inside = np.clip(start, 0, width), np.clip(end, 0, width)
    a, b = np.clip(low, 0, width), np.clip(high, 0, width)
    total = np.zeros((LIMBS, len(low)), np.int64)
    proper = low < high
    for at, sign in ((inside[0], 1), (inside[1], -1)):
        order = np.flatnonzero(plain)
        order = order[np.argsort(at[order], kind="stable")]
        at = at[order]
        run, moment = _running(whole[:, order]), _running(whole[:, order] * at)
        for x, turn in ((b, sign), (a, -sign)):
            below = np.searchsorted(at, x, "left")
            total += turn * (x * run[:, below] - moment[:, below])
    total[:, ~proper] = 0
    marks = np.stack([np.ones(len(start), np.int64), has, np.isnan(value) & has, has & (value == np.inf), has & (value == -np.inf)]).astype(np.int64)
    # Steps or spans without a base belong to the tile of their start.
    own = plain | ((start >= 0) & (start < width))
    asked = proper | ((low >= 0) & (low < width))
    seen = np.zeros((len(marks), len(low)), np.int64)
    seen[:, asked] = overlap_sums(start[own], end[own], marks[:, own], low[asked], high[asked], width)
    bare = own & ~plain
    if bare.any() and proper.any():
        total[:, proper] += overlap_sums(start[bare], end[bare], whole[:, bare] * (end - start)[bare], low[proper], high[proper], width)
    odd = asked & ~proper
    if odd.any() and plain.any():
        total[:, odd] += (high - low)[odd] * overlap_sums(start[plain], end[plain], whole[:, plain], low[odd], high[odd], width)
    sums = np.zeros(len(low))
    for k in reversed(range(LIMBS)):
        sums += np.ldexp(total[k].astype(np.float64), scale - (k + 1) * BITS)
    n, known, nan, up, down = seen
    sums = np.where((nan > 0) | ((up > 0) & (down > 0)), np.nan, np.where(up > 0, np.inf, np.where(down > 0, -np.inf, sums)))
    return pa.array(sums, mask=known == 0), n > 0


def _running(weights: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros((len(weights), 1), np.int64), np.cumsum(weights, axis=1)), axis=1)


def bin_sums(spans: DataFrame, value: str, binsize: int, by: Sequence[str] = ()) -> DataFrame:
    """sum(value * bases) per (group, chrom, bin); an interval is shared out over the bins it touches."""
    cut = tile(spans, "start_pos", "end_pos", binsize, "bin")
    bases = overlap_bp("start_pos", "end_pos", F.col("bin") * binsize, (F.col("bin") + 1) * binsize)
    return cut.groupBy(*by, "chrom", "bin").agg(F.sum(F.col(value) * bases).alias("amount"))


def point_bins(points: DataFrame, binsize: int, pos: str = "pos") -> DataFrame:
    """Add the fixed bin of a position."""
    return points.withColumn("bin", floor_div(pos, binsize))


def bin_grid(sizes: DataFrame, binsize: int) -> DataFrame:
    """Every bin of every chromosome."""
    bins = F.explode(F.sequence(F.lit(0).cast("long"), floor_div(F.col("size") - 1, binsize)))
    return sizes.select("chrom", bins.alias("bin"))
