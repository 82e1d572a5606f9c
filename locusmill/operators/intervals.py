"""Interval joins and interval algebra.

Joins place both sides on a grid of tiles and equi-join on (keys, tile); a pair is kept only in the tile that holds its
overlap's start, so it appears once. Ordered work (merge, complement, running offsets, as-of) is done per block of
positions first and stitched by a table with one row per block, so no window ever holds a whole chromosome.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.intervals import floor_div, overlaps
from .skew import split_hot
from .tiles import innermost

TILE = 4096
BLOCK = 65_536
TILE_COL = "__tile"


def tile(df: DataFrame, start: str, end: str, width: int = TILE, name: str = TILE_COL) -> DataFrame:
    """One row per grid tile an interval touches."""
    first = floor_div(start, width)
    last = F.greatest(floor_div(F.col(end) - 1, width), first)
    return df.withColumn(name, F.explode(F.sequence(first, last)))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_span: tuple[str, str] = ("start_pos", "end_pos"),
    right_span: tuple[str, str] = ("r_start", "r_end"),
    on: Sequence[str] = ("chrom",),
    width: int = TILE,
    hot_rows: int | None = None,
) -> DataFrame:
    """All overlapping pairs of two interval tables whose non-key columns differ in name.

    Tiles with many rows are left to Spark's skew join, which splits them after the shuffle. With ``hot_rows`` they are
    counted and split before it, at the cost of evaluating both sides twice.
    """
    a = tile(left, *left_span, width)
    b = tile(right, *right_span, width)
    a, b, keys = split_hot(a, b, [*on, TILE_COL], hot_rows)
    pairs = a.join(b, keys).where(overlaps(left_span[0], left_span[1], right_span[0], right_span[1]))
    owner = floor_div(F.greatest(F.col(left_span[0]), F.col(right_span[0])), width)
    return pairs.where(F.col(TILE_COL) == owner).drop(*[k for k in keys if k not in on])


def point_join(
    points: DataFrame,
    spans: DataFrame,
    pos: str = "pos",
    span: tuple[str, str] = ("start_pos", "end_pos"),
    on: Sequence[str] = ("chrom",),
    width: int = TILE,
    hot_rows: int | None = None,
) -> DataFrame:
    """Every (point, interval holding it) pair; tiles with many rows as in ``overlap_join``."""
    a = points.withColumn(TILE_COL, floor_div(pos, width))
    b = tile(spans, *span, width)
    a, b, keys = split_hot(a, b, [*on, TILE_COL], hot_rows)
    inside = (F.col(pos) >= F.col(span[0])) & (F.col(pos) < F.col(span[1]))
    return a.join(b, keys).where(inside).drop(*[k for k in keys if k not in on])


def intersect(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] = ("chrom", "strand"),
    width: int = TILE,
) -> DataFrame:
    """Pieces shared by two interval sets that are each disjoint per key."""
    b = right.select(*on, F.col("start_pos").alias("r_start"), F.col("end_pos").alias("r_end"))
    # Disjoint sets have at most width / 2 runs per tile and key, so no tile can be hot.
    pairs = overlap_join(left.select(*on, "start_pos", "end_pos"), b, on=on, width=width, hot_rows=None)
    return pairs.select(
        *on,
        F.greatest("start_pos", "r_start").alias("start_pos"),
        F.least("end_pos", "r_end").alias("end_pos"),
    )


def merge(df: DataFrame, keys: Sequence[str] = ("chrom",), block: int = BLOCK) -> DataFrame:
    """Union of intervals per key; bookended intervals join.

    Intervals are cut at block borders and collapsed to one row per (key, block, start) before the in-block scan, so a
    scan sees at most ``block`` rows. Only runs touching a block border, at most two per block, are stitched per key.
    """
    keys = list(keys)
    cut = tile(df.select(*keys, "start_pos", "end_pos"), "start_pos", "end_pos", block, "__b")
    lo, hi = F.col("__b") * block, (F.col("__b") + 1) * block
    cut = cut.select(
        *keys, "__b", F.greatest("start_pos", lo).alias("start_pos"), F.least("end_pos", hi).alias("end_pos")
    ).where(F.col("start_pos") < F.col("end_pos"))
    starts = cut.groupBy(*keys, "__b", "start_pos").agg(F.max("end_pos").alias("end_pos"))
    runs = islands(starts, [*keys, "__b"])
    inner = (F.col("start_pos") > lo) & (F.col("end_pos") < hi)
    out = [*keys, "start_pos", "end_pos"]
    closed = runs.where(inner).select(*out)
    open_runs = islands(runs.where(~inner).select(*out), keys).select(*out)
    return closed.unionByName(open_runs)


def islands(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of intervals per key in one scan of the key's rows, for keys that hold few; bookended intervals join."""
    ordered = W.partitionBy(*keys).orderBy("start_pos")
    before = F.max("end_pos").over(ordered.rowsBetween(W.unboundedPreceding, -1))
    opened = F.when(before.isNull() | (F.col("start_pos") > before), 1).otherwise(0)
    marked = df.withColumn("__new", opened)
    marked = marked.withColumn("__run", F.sum("__new").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    return (
        marked.groupBy(*keys, "__run")
        .agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
        .drop("__run")
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    amount: str,
    name: str,
    within: Sequence[str] = (),
    ties: Sequence[str] = (),
    block: int = 1 << 20,
) -> DataFrame:
    """Exclusive running sum of ``amount`` in (within..., pos, ties...) order per key.

    Blocks of positions are summed first; the scan over blocks has one row per block and the scan inside a block only
    its own rows.
    """
    keys, within = list(keys), list(within)
    scope = keys or ["__all"]
    b = df.withColumn("__b", floor_div(pos, block))
    if not keys:
        b = b.withColumn("__all", F.lit(0))
    cell = [*scope, *within, "__b"]
    totals = b.groupBy(*cell).agg(F.sum(amount).alias("__sum"))
    base_order = W.partitionBy(*scope).orderBy(*within, "__b").rowsBetween(W.unboundedPreceding, -1)
    base = totals.withColumn("__base", F.coalesce(F.sum("__sum").over(base_order), F.lit(0))).drop("__sum")
    in_block = W.partitionBy(*cell).orderBy(pos, *ties).rowsBetween(W.unboundedPreceding, -1)
    local = b.withColumn("__local", F.coalesce(F.sum(amount).over(in_block), F.lit(0)))
    out = local.join(base, cell).withColumn(name, F.col("__base") + F.col("__local"))
    return out.drop("__b", "__base", "__local", "__all")


def _bounded_segments(segments: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Segments cut to their key's [lo, hi); a key without any keeps one empty segment at lo."""
    cut = bounds.select(*keys, "lo", "hi").join(segments.select(*keys, "start_pos", "end_pos"), keys, "left")
    inside = F.col("start_pos").isNull() | ((F.col("start_pos") < F.col("hi")) & (F.col("end_pos") > F.col("lo")))
    return cut.where(inside).select(
        *keys,
        "lo",
        "hi",
        F.greatest(F.coalesce("start_pos", "lo"), "lo").alias("start_pos"),
        F.least(F.coalesce("end_pos", "lo"), "hi").alias("end_pos"),
    )


def _gaps(keys: list[str], previous: str, following: str) -> list[Column]:
    """The gap before a segment, and after the key's last one the gap up to hi."""
    before = F.struct(F.coalesce(previous, "lo").alias("s"), F.col("start_pos").alias("e"))
    after = F.struct(F.col("end_pos").alias("s"), F.coalesce(following, "hi").alias("e"))
    both = F.when(F.col(following).isNull(), F.array(before, after)).otherwise(F.array(before))
    return [*[F.col(k) for k in keys], F.explode(F.filter(both, lambda g: g["s"] < g["e"])).alias("__gap")]


def complement(
    segments: DataFrame, bounds: DataFrame, keys: Sequence[str] = ("chrom",), block: int = 1 << 20
) -> DataFrame:
    """Gaps of disjoint segments inside each key's [lo, hi)."""
    keys = list(keys)
    cut = _bounded_segments(segments, bounds, keys).withColumn("__b", floor_div("start_pos", block))
    in_block = W.partitionBy(*keys, "__b").orderBy("start_pos")
    near = cut.withColumn("__prev", F.lag("end_pos").over(in_block)).withColumn(
        "__foll", F.lead("start_pos").over(in_block)
    )
    edges = cut.groupBy(*keys, "__b").agg(F.min("start_pos").alias("__head"), F.max("end_pos").alias("__tail"))
    across = W.partitionBy(*keys).orderBy("__b")
    edges = edges.select(
        *keys, "__b", F.lag("__tail").over(across).alias("__pt"), F.lead("__head").over(across).alias("__nh")
    )
    full = near.join(edges, [*keys, "__b"]).withColumns(
        {"__prev": F.coalesce("__prev", "__pt"), "__foll": F.coalesce("__foll", "__nh")}
    )
    gaps = full.select(*_gaps(keys, "__prev", "__foll"))
    return gaps.select(*keys, F.col("__gap.s").alias("start_pos"), F.col("__gap.e").alias("end_pos"))


def introns(genes: DataFrame, exons: DataFrame) -> DataFrame:
    """Each gene's span minus its own merged exons, numbered, with flat offsets along the gene.

    A gene's exons are collapsed per start before its scan, so the scan is bounded by the gene's own length.
    """
    starts = exons.groupBy("gene_id", "start_pos").agg(F.max("end_pos").alias("end_pos"))
    bounds = genes.select("gene_id", F.col("start_pos").alias("lo"), F.col("end_pos").alias("hi"))
    cut = _bounded_segments(islands(starts, ["gene_id"]), bounds, ["gene_id"])
    along = W.partitionBy("gene_id").orderBy("start_pos")
    near = cut.withColumn("__prev", F.lag("end_pos").over(along)).withColumn("__foll", F.lead("start_pos").over(along))
    gaps = near.select(*_gaps(["gene_id"], "__prev", "__foll")).select(
        "gene_id", F.col("__gap.s").alias("start_pos"), F.col("__gap.e").alias("end_pos")
    )
    length = F.col("end_pos") - F.col("start_pos")
    laid = gaps.select(
        "*",
        length.alias("seg_len"),
        (F.sum(length).over(along.rowsBetween(W.unboundedPreceding, 0)) - length).alias("seg_off"),
        (F.row_number().over(along) - 1).alias("ordinal"),
    )
    return laid.join(genes.select("gene_id", "chrom", "strand"), "gene_id")


def flat_offsets(segments: DataFrame, keys: Sequence[str] = (), within: Sequence[str] = ()) -> DataFrame:
    """Lay segments end to end per key: adds ``seg_len`` and the running offset ``seg_off``."""
    sized = segments.withColumn("seg_len", F.col("end_pos") - F.col("start_pos"))
    return running_total(sized, keys, "start_pos", "seg_len", "seg_off", within)


def to_flat(
    points: DataFrame,
    segments: DataFrame,
    on: Sequence[str] = ("chrom",),
    pos: str = "pos",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Genomic position to flat coordinate; positions outside every segment drop out.

    ``carry`` names segment columns to bring along, such as the gene whose coordinate it is.
    """
    seg = segments.select(
        *on, *carry, F.col("start_pos").alias("__s"), F.col("end_pos").alias("__e"), F.col("seg_off").alias("__o")
    )
    hit = point_join(points, seg, pos, ("__s", "__e"), on)
    return hit.withColumn("flat", F.col("__o") + F.col(pos) - F.col("__s")).drop("__s", "__e", "__o")


def from_flat(points: DataFrame, segments: DataFrame, keys: Sequence[str] = (), carry: Sequence[str] = ("chrom",)) -> DataFrame:
    """Flat coordinate back to a genomic position; ``carry`` names the segment columns to bring along."""
    seg = segments.select(
        *keys,
        *carry,
        F.col("start_pos").alias("__s"),
        F.col("seg_off").alias("__o"),
        (F.col("seg_off") + F.col("seg_len")).alias("__oe"),
    )
    hit = point_join(points, seg, "flat", ("__o", "__oe"), list(keys))
    return hit.withColumn("pos", F.col("__s") + F.col("flat") - F.col("__o")).drop("__s", "__o", "__oe")


def clip_to_segments(
    spans: DataFrame,
    segments: DataFrame,
    on: Sequence[str] = ("chrom",),
    seg_keys: Sequence[str] = (),
    span: tuple[str, str] = ("start_pos", "end_pos"),
) -> DataFrame:
    """Cut intervals to a segment set, one row per piece, in genomic (``piece_start``) and flat coordinates."""
    seg = segments.select(
        *on,
        *seg_keys,
        F.col("start_pos").alias("r_start"),
        F.col("end_pos").alias("r_end"),
        F.col("seg_off").alias("__o"),
    )
    hit = overlap_join(spans, seg, span, on=on)
    lo, hi = F.greatest(span[0], "r_start"), F.least(span[1], "r_end")
    flat = {
        "piece_start": lo,
        "flat_start": F.col("__o") + lo - F.col("r_start"),
        "flat_end": F.col("__o") + hi - F.col("r_start"),
    }
    return hit.withColumns(flat).drop("__o", "r_start", "r_end")


def containing(
    points: DataFrame,
    spans: DataFrame,
    carry: Sequence[str],
    on: Sequence[str] = ("chrom",),
    pos: str = "pos",
    mode: str = "innermost",
    span: tuple[str, str] = ("start_pos", "end_pos"),
) -> DataFrame:
    """One holding interval per point, or none.

    ``innermost`` takes the holding interval with the largest start (then the smallest end, then the largest carried
    values), at any nesting depth. ``last_start_only`` looks only at the last interval starting at or before the point
    and keeps it if it reaches the point. The search runs once per distinct position; points join back to its result.
    Neither pairs a point with all that hold it.
    """
    on = list(on)
    places = points.select(*on, pos).distinct()
    if mode == "innermost":
        best = innermost(places, spans, carry, on, pos, span)
    elif mode == "last_start_only":
        best = _last_start(places, spans, on, pos, span, list(carry))
    else:
        raise ValueError(f"unknown mode {mode!r}; choose innermost or last_start_only")
    return points.join(best, [*on, pos]).select(*points.columns, *[F.col(f"__hit.{c}").alias(c) for c in carry])


def _last_start(places, spans, on, pos, span, carry, block: int = BLOCK) -> DataFrame:
    start, end = span
    rank = F.struct(F.col(start).alias("s"), (-F.col(end)).alias("e"), F.struct(*carry).alias("c"))
    per_start = spans.groupBy(*on, start).agg(F.max(rank).alias("__cand"))
    marks = per_start.select(*on, F.col(start).alias(pos), F.lit(0).alias("__kind"), "__cand")
    empty = F.lit(None).cast(marks.schema["__cand"].dataType)
    asks = places.select(*on, pos, F.lit(1).alias("__kind"), empty.alias("__cand"))
    both = marks.unionByName(asks).withColumn("__b", floor_div(pos, block))
    in_block = W.partitionBy(*on, "__b").orderBy(pos, "__kind").rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("__here", F.last("__cand", ignorenulls=True).over(in_block))
    blocks = both.groupBy(*on, "__b").agg(F.max("__cand").alias("__top"))
    earlier = W.partitionBy(*on).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("__carry", F.max("__top").over(earlier)).drop("__top")
    asked = seen.where(F.col("__kind") == 1).join(blocks, [*on, "__b"])
    asked = asked.withColumn("__got", F.coalesce("__here", "__carry"))
    return asked.where(-F.col("__got.e") > F.col(pos)).select(*on, pos, F.col("__got.c").alias("__hit"))


def overlap_flags(spans: DataFrame, marks: DataFrame, flags: dict[str, Column], key: str, on: Sequence[str] = ("chrom",)) -> DataFrame:
    """Per span key, whether any overlapping mark satisfies each condition. Spans without a mark get no row."""
    hit = overlap_join(spans, marks, on=on)
    return hit.groupBy(key).agg(*[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])
