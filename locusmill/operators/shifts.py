"""Intervals and peak sets that move round, under many shifts at once.

A task meets one wide block of a chromosome with all that may move into it, and goes through the shifts in numpy: no row stands
for a thing and a shift, so what is shuffled does not grow with the number of shifts. What a task holds is bounded by its
blocks, and for peak sets by the peaks of one sample.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.intervals import ANTISENSE, SENSE, floor_div
from .counting import CATEGORY, _whole_and_split
from .tiles import TILE_COL, coded, meet, numbers

#: Bases of a chromosome that a task meets.
BLOCK = 1 << 25
#: Interval ends that are looked up at once.
ENDS = 1 << 18
NOWHERE = -(1 << 62)


def _parts(spark, pairs: int) -> int:
    """How many tasks share a pair of blocks, where blocks alone would leave cores idle."""
    return max(1, -(-2 * spark.sparkContext.defaultParallelism // max(pairs, 1)))


def _filled(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column with nulls as 0, and which rows have a value."""
    column = table.column(name)
    return column.fill_null(0).to_numpy().astype(np.int64), column.is_valid().to_numpy()


class Below:
    """How many of some sorted positions lie below another one."""

    def __init__(self, pos: np.ndarray, low: int, high: int, asked: int):
        self.pos, self.low = pos, low
        self.table = None
        if asked * 4 > high - low:
            self.table = np.zeros(high - low + 2, np.int32)
            self.table[1:] = np.cumsum(np.bincount(np.clip(pos - low, 0, high - low), minlength=high - low + 1))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.pos, x, "left") if self.table is None else self.table[np.clip(x - self.low, 0, len(self.table) - 1)]


def shifted_sums(
    anchors: DataFrame, points: DataFrame, sizes: DataFrame, draws: DataFrame, by: Sequence[str], codes: Sequence[str], edge: str = "clip",
    block: int = BLOCK,
) -> DataFrame:
    """Sum of each code over the points under the anchors, per ``by`` and shift.

    ``draws`` has a row (chrom, size, shift, offset, stays) for every chromosome and shift, ``sizes`` one for every known
    chromosome. An anchor's start moves by the offset round its chromosome; an end past the chromosome is cut or carried round.
    """
    by, codes = list(by), list(codes)
    rows = draws.where("stays or size is not null").select("chrom", "shift", "offset", "size", "stays").collect()
    moves: dict[str, list] = {}
    for r in rows:
        moves.setdefault(r["chrom"], []).append((r["shift"], r["offset"], r["size"], r["stays"]))
    last = F.greatest(floor_div(F.coalesce(F.max("size"), F.lit(0)), block), F.lit(0)).alias("__last")
    known = sizes.where("chrom is not null").groupBy("chrom").agg(last)
    lasts = {r["chrom"]: r["__last"] for r in known.collect()}
    parts = _parts(anchors.sparkSession, sum((n + 1) ** 2 for n in lasts.values()))
    known = F.broadcast(known)

    def placed(df: DataFrame, pos: str) -> DataFrame:
        at = F.least(F.greatest(floor_div(pos, block), F.lit(0)), F.col("__last"))
        return df.join(known, "chrom").withColumn("__at", F.coalesce(at, F.lit(0)))

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__last")))
    part = F.pmod(F.xxhash64("start_pos", "end_pos", *by), F.lit(parts)).cast("int")
    left = placed(anchors.select("chrom", "start_pos", "end_pos", *by), "start_pos").select(
        "chrom", F.col("__at").alias("__from"), part.alias("__part"), every.alias(TILE_COL), "start_pos", "end_pos", *by
    )
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in codes]
    # Points without a position lie below every other one.
    at = placed(points.withColumn("pos", F.coalesce(F.col("pos").cast("long"), F.lit(NOWHERE))).groupBy("chrom", "pos").agg(*sums), "pos")
    all_parts = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    right = at.select("chrom", "pos", *codes, F.col("__at").alias(TILE_COL), every.alias("__from")).withColumn("__part", all_parts)

    kind = {f.name: f.dataType for f in anchors.schema}
    schema = StructType([StructField("chrom", kind["chrom"]), StructField(TILE_COL, LongType()), *[StructField(c, kind[c]) for c in by],
                         StructField("shift", IntegerType()), StructField("__w", LongType()), *[StructField(c, LongType()) for c in codes]])
    arrow = to_arrow_schema(schema)

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        chrom, mine = left.column("chrom")[0].as_py(), left.column(TILE_COL)[0].as_py()
        own, top = moves.get(chrom, []), lasts[chrom]
        code, listed = coded(left, by)
        start, has_start = _filled(left, "start_pos")
        end, has_end = _filled(left, "end_pos")
        order = np.lexsort((start, code))
        code, start, end, has_start, has_end = (x[order] for x in (code, start, end, has_start, has_end))
        pos = numbers(right, "pos")
        ranked = np.argsort(pos, kind="stable")
        pos = pos[ranked]
        running = np.zeros((len(pos) + 1, len(codes)), np.int64)
        for k, c in enumerate(codes):
            np.cumsum(numbers(right, c)[ranked], out=running[1:, k])
        lost = int(np.searchsorted(pos, NOWHERE, "right"))
        low, high = (int(pos[lost]), int(pos[-1]) + 1) if len(pos) > lost else (0, 0)
        below = Below(pos[lost:], low, high, 2 * len(start) * len(own))
        n = listed.num_rows
        out = np.zeros((len(own), n, len(codes)), np.int64)
        weight, seen = np.zeros((len(own), n), np.int64), np.zeros((len(own), n), bool)

        def add(k: int, group: np.ndarray, x: np.ndarray, sign: int) -> None:
            if top:
                here = np.clip(x // block, 0, top) == mine
                group, x = group[here], x[here]
            cut = np.searchsorted(group, np.arange(n + 1))
            total = np.zeros((len(x) + 1, len(codes)), np.int64)
            np.cumsum(running[lost + below(x)], axis=0, out=total[1:])
            out[k] += sign * (total[cut[1:]] - total[cut[:-1]])
            weight[k] += sign * np.diff(cut)
            seen[k] |= np.diff(cut) > 0

        for first in range(0, len(start), ENDS):
            part = slice(first, first + ENDS)
            group, a, b, has_a, has_b = code[part], start[part], end[part], has_start[part], has_end[part]
            for k, (_, offset, size, stays) in enumerate(own):
                if stays:
                    add(k, group[has_a], a[has_a], -1)
                    add(k, group[has_b], b[has_b], 1)
                    continue
                known = has_a & (offset is not None)
                x = np.fmod(a + (offset or 0), size)
                past = np.where(known & has_b, x + (b - a), size)
                add(k, group[known], x[known], -1)
                add(k, group, np.minimum(past, size), 1)
                if edge == "wrap":
                    over = past > size
                    add(k, group[over], np.zeros(over.sum(), np.int64), -1)
                    add(k, group[over], (past - size)[over], 1)
        of, at = np.nonzero(seen)
        made = {"chrom": pa.array([chrom] * len(of), arrow.field("chrom").type), TILE_COL: np.full(len(of), mine)}
        made |= {c: listed.column(c).take(pa.array(at)) for c in by}
        made |= {"shift": np.array([m[0] for m in own], np.int32)[of], "__w": weight[of, at]}
        made |= {c: out[of, at, k] for k, c in enumerate(codes)}
        return pa.table({c: made[c] for c in arrow.names}).cast(arrow)

    found = meet(left, right, ["chrom", "__from", "__part"], scan, schema)
    grid = known.select("chrom", every.alias(TILE_COL))
    held = at.groupBy("chrom", F.col("__at").alias(TILE_COL)).agg(*[F.sum(c).alias(c) for c in codes])
    before = W.partitionBy("chrom").orderBy(TILE_COL).rowsBetween(W.unboundedPreceding, -1)
    base = grid.join(held, ["chrom", TILE_COL], "left").select(
        "chrom", TILE_COL, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__base_{c}") for c in codes]
    )
    return found.join(base, ["chrom", TILE_COL]).groupBy(*by, "shift").agg(
        *[F.sum(F.col(c) + F.col("__w") * F.col(f"__base_{c}")).alias(c) for c in codes]
    )


#: A class of features is at most so many times as long as the one before.
LONGER = 8


class _Features:
    """Features of a tile by start, in classes of length, so that a place meets few that do not reach it."""

    def __init__(self, start: np.ndarray, end: np.ndarray):
        length = np.maximum(end - start, 1)
        step = np.floor(np.log2(length) / np.log2(LONGER)).astype(np.int64)
        self.groups = []
        for k in np.unique(step):
            rows = np.flatnonzero(step == k)
            rows = rows[np.argsort(start[rows], kind="stable")]
            self.groups.append((rows, start[rows], end[rows], int(length[rows].max())))

    def under(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (stretch, feature) that overlap."""
        stretches, features = [], []
        for rows, start, end, longest in self.groups:
            first, past = np.searchsorted(start, low - longest, "right"), np.searchsorted(start, high, "left")
            n = np.maximum(past - first, 0)
            at = np.repeat(np.arange(len(low)), n)
            row = np.arange(len(at)) + np.repeat(first - (np.cumsum(n) - n), n)
            reached = end[row] > low[at]
            stretches.append(at[reached])
            features.append(rows[row[reached]])
        return np.concatenate(stretches), np.concatenate(features)


def moved_locus_counts(
    features: DataFrame, sets: DataFrame, space: DataFrame, wanted: DataFrame, by: Sequence[str], pool: Sequence[str], block: int = BLOCK
) -> Callable[[DataFrame], DataFrame]:
    """What tells, for ``moves`` of peak sets round their pool's space, the distinct features hit per (by, perm, subfamily,
    orientation); cells without a hit have no row.

    ``sets`` has a row (by, size, items) per group: its peaks as (flat, width, peak_strand) structs and the length of its space.
    ``space`` has the pool's segments laid end to end per chromosome, ``features`` the column ``__alone`` of lone_ids, ``moves`` a
    row (by, draws) per moving group, draws being (perm, offset) structs. Only the cells of ``wanted`` are counted, as many as the
    dictionaries have at most, so every task knows them all. A feature is counted by the tile of its start, which every peak
    meets that may reach it; those whose id stands in several places go by their ids.
    """
    by, pool = list(by), list(pool)
    spark = features.sparkSession
    cells: dict[tuple, list] = {}
    for r in wanted.select(*by, *CATEGORY).distinct().collect():
        if None not in r:
            cells.setdefault(tuple(r)[:len(by)], []).append(tuple(r)[len(by):])
    placed = features.where("chrom is not null and start_pos is not null and end_pos is not null").withColumn(TILE_COL, floor_div("start_pos", block))
    widest = sets.select(F.max(F.array_max(F.transform("items", lambda x: x["width"])))).first()[0]
    where = placed.groupBy("chrom", TILE_COL).agg(F.max(F.col("end_pos") - F.col("start_pos"))).collect()
    widest, longest = max(widest or 0, 0), max([0, *(r[2] for r in where)])
    where = [(r[0], r[1]) for r in where]
    parts = min(_parts(spark, len(where)), max(len(cells), 1))
    all_parts = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = placed.select("chrom", TILE_COL, "fid", "start_pos", "end_pos", "strand", "subfamily", "__alone").withColumn("__part", all_parts)

    kind = {f.name: f.dataType for f in (*features.schema, *sets.schema)}
    draw_kind = "array<struct<perm: int, offset: bigint>>"
    near = F.sequence(floor_div(F.col("start_pos") - longest, block), floor_div(F.col("end_pos") + widest, block))
    reached = space.where("start_pos < end_pos").withColumn(TILE_COL, F.explode(near)).groupBy(*pool, "chrom", TILE_COL).agg(
        F.collect_list(F.struct("seg_off", "start_pos", "seg_len")).alias("segments")
    )
    empty = lambda name, of: F.lit(None).cast(of).alias(name)
    rest = [c for c in by if c not in pool]
    segments = reached.select(
        "chrom", TILE_COL, *pool, *[empty(c, kind[c]) for c in rest], empty("size", "long"), empty("items", kind["items"]), empty("draws", draw_kind), "segments"
    ).withColumn("__part", all_parts)
    part = F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")
    tiles = spark.createDataFrame([([tuple(r) for r in where],)], f"__tiles array<struct<chrom: {kind['chrom'].simpleString()}, tile: bigint>>")
    segment_kind = reached.schema["segments"].dataType

    schema = StructType([*[StructField(c, kind[c]) for c in by], StructField("perm", IntegerType()), StructField("subfamily", kind["subfamily"]),
                         StructField("orientation", StringType()), StructField("fid", kind["fid"]), StructField("__n", LongType()),
                         StructField("__whole", BooleanType())])
    arrow = to_arrow_schema(schema)

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        subfamily, listed = coded(left, ["subfamily"])
        names = listed.column("subfamily").to_pylist()
        start, end = numbers(left, "start_pos").astype(np.int64), numbers(left, "end_pos").astype(np.int64)
        alone, strands = left.column("__alone").to_numpy(zero_copy_only=False), left.column("strand").combine_chunks()
        ids = left.column("fid").combine_chunks()
        keys = list(zip(*[right.column(c).to_pylist() for c in by]))
        inside = [by.index(c) for c in pool]
        laid = {}
        for k in np.flatnonzero(right.column("segments").is_valid().to_numpy()):
            of = right.column("segments")[int(k)].values
            off, first, length = (of.field(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in range(3))
            order = np.argsort(off, kind="stable")
            laid[tuple(keys[k][j] for j in inside)] = off[order], first[order], int((off + length).max())
        made = []
        for k in np.flatnonzero(right.column("draws").is_valid().to_numpy()):
            own, key = cells.get(keys[k], []), keys[k]
            segs = laid.get(tuple(key[j] for j in inside))
            if not own or segs is None:
                continue
            place = np.full(2 * len(names), -1, np.int64)
            for c, (s, side) in enumerate(own):
                if s in names:
                    place[2 * names.index(s) + (side != SENSE)] = c
            rows = np.flatnonzero((place[2 * subfamily] >= 0) | (place[2 * subfamily + 1] >= 0))
            if not len(rows):
                continue
            mine = _Features(start[rows], end[rows])
            cell = np.stack((place[2 * subfamily[rows]], place[2 * subfamily[rows] + 1]), axis=1).ravel()
            single = np.repeat(alone[rows], 2)
            of = right.column("items")[int(k)].values
            flat, width = (of.field(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in range(2))
            order = np.argsort(flat, kind="stable")
            flat, width = flat[order], width[order]
            both = pa.concat_arrays([strands.take(pa.array(rows)), of.field(2).take(pa.array(order))]).dictionary_encode().indices
            strand = both.fill_null(-1).to_numpy(zero_copy_only=False)
            strand, peak_strand = strand[:len(rows)], strand[len(rows):]
            off, first, past = segs
            size = right.column("size")[int(k)].as_py()
            draws = right.column("draws")[int(k)].values
            perms, offsets = draws.field(0).to_numpy(zero_copy_only=False), draws.field(1)
            counts = np.zeros((len(perms), len(own)), np.int64)
            several = []
            for n in np.flatnonzero(offsets.is_valid().to_numpy(zero_copy_only=False)):
                by_so = offsets[int(n)].as_py() % size
                at = np.concatenate([
                    np.arange(*np.searchsorted(flat, (max(int(off[0]) - by_so + lap, 0), max(past - by_so + lap, 0)))) for lap in (0, size)
                ])
                moved = (flat[at] + by_so) % size
                seg = np.searchsorted(off, moved, "right") - 1
                low = first[seg] + moved - off[seg]
                peak, hit = mine.under(low, low + width[at])
                same = (peak_strand[at[peak]] == strand[hit]) & (strand[hit] >= 0)
                found = np.zeros(len(cell), bool)
                found[2 * hit + ~same] = True
                found = np.flatnonzero(found)
                found = found[cell[found] >= 0]
                counts[n] = np.bincount(cell[found[single[found]]], minlength=len(own))
                found = found[~single[found]]
                several += [(n, cell[f], rows[f >> 1]) for f in found]
            n, c = np.nonzero(counts)
            total = np.concatenate((counts[n, c], np.ones(len(several), np.int64)))
            whole = np.arange(len(total)) < len(n)
            apart = np.array([r for *_, r in several], np.int64)
            n, c = (np.concatenate((x, np.array([y[j] for y in several], np.int64))) for j, x in enumerate((n, c)))
            column = {b: pa.array([v] * len(n), arrow.field(b).type) for b, v in zip(by, key)}
            column |= {"perm": pa.array(perms[n]), "subfamily": pa.array([s for s, _ in own]).take(pa.array(c))}
            column |= {"orientation": pa.array([o for _, o in own]).take(pa.array(c))}
            column |= {"fid": pa.concat_arrays([pa.nulls(int(whole.sum()), ids.type), ids.take(pa.array(apart))]), "__n": total, "__whole": whole}
            made.append(pa.table({name: column[name] for name in arrow.names}).cast(arrow))
        return pa.concat_tables(made) if made else arrow.empty_table()

    def counted(moves: DataFrame) -> DataFrame:
        moving = sets.join(moves, by).withColumn("__one", F.lit(0)).join(F.broadcast(tiles.withColumn("__one", F.lit(0))), "__one")
        moving = moving.withColumn("__at", F.explode("__tiles")).select(
            F.col("__at.chrom").alias("chrom"), F.col("__at.tile").alias(TILE_COL), *pool, *rest, "size", "items", "draws",
            empty("segments", segment_kind), part.alias("__part"),
        )
        found = meet(left, segments.unionByName(moving), ["chrom", "__part"], scan, schema)
        return _whole_and_split(found, (*by, "perm", *CATEGORY)).withColumnRenamed("__n", "loci")

    return counted
