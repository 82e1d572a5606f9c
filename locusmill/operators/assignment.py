"""Fragments counted on copies per tile, whatever number of copies or fragments lie over one another.

Stretches are rows (sample, frag, chrom, strand, start_pos, end_pos), disjoint per fragment, chromosome and strand; copies are
rows (fid, chrom, f_strand, r_start, r_end). Rows without a place are on nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..functions.intervals import ANTISENSE, SENSE
from ..session import staged
from .counting import lone_ids
from .intervals import overlap_join
from .tiles import TILE_COL, WIDTH, coded, meet, numbers, overlap_sums, tiles_of

SIDES = (SENSE, ANTISENSE)


def _side(strand: str | None, own: str | None, setting: int) -> str:
    """Only known strands can be sense: equal ones (setting 1) or different ones (setting 2)."""
    known = strand is not None and own is not None
    return SENSE if known and (strand == own) == (setting == 1) else ANTISENSE


def _side_column(setting: int) -> Column:
    agree = F.col("strand") == F.col("f_strand")
    return F.when(agree if setting == 1 else ~agree, SENSE).otherwise(ANTISENSE)


def _rows_of(table: pa.Table, name: str) -> dict:
    code, listed = coded(table, [name])
    return {value: np.flatnonzero(code == k) for k, value in enumerate(listed.column(name).to_pylist())}


def _from(base: int, table: pa.Table, *names: str) -> list[np.ndarray]:
    return [numbers(table, name).astype(np.int64) - base for name in names]


def _laid(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """One row per tile an interval touches; ``__inside`` tells whether it touches one only."""
    first, last = tiles_of(start, end, width)
    known = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    return known.withColumn("__inside", first == last).withColumn(TILE_COL, F.explode(F.sequence(first, last)))


def on_one_copy(copies: DataFrame, stretches: DataFrame, setting: int, width: int = WIDTH) -> DataFrame:
    """Fragments per (sample, orientation, fid) that are on this copy alone.

    Per stretch and orientation a tile sums the number, the codes and the squared codes of the copies under it: they are all
    the same one where the squares sum to what their mean would give. A fragment of one stretch inside a tile is counted
    there; of the others each stretch tells the copy, or that there are several.
    """
    lone = F.count(F.lit(1)).over(W.partitionBy("sample", "frag")) == 1
    left = _laid(stretches.withColumn("__lone", lone), "start_pos", "end_pos", width).select(
        "sample", "frag", "chrom", "strand", "start_pos", "end_pos", (F.col("__lone") & F.col("__inside")).alias("__whole"), TILE_COL
    )
    right = _laid(copies.where("fid is not null"), "r_start", "r_end", width).drop("__inside")
    kind = {f.name: f.dataType for f in (*stretches.schema, *copies.schema)}
    schema = StructType([StructField("sample", kind["sample"]), StructField("frag", kind["frag"]), StructField("orientation", StringType()),
                         StructField("fid", kind["fid"]), StructField("__n", LongType()), StructField("__whole", BooleanType())])
    arrow = to_arrow_schema(schema)

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        base = left.column(TILE_COL)[0].as_py() * width
        start, end = _from(base, left, "start_pos", "end_pos")
        low, high = _from(base, right, "r_start", "r_end")
        code, ids = coded(right, ["fid"])
        weights = np.stack((np.ones_like(code), code, code * code))
        own = _rows_of(right, "f_strand")
        found = []
        for strand, asked in _rows_of(left, "strand").items():
            sums = {o: overlap_sums(low[of], high[of], weights[:, of], start[asked], end[asked], width) for o, of in own.items()}
            for side, name in enumerate(SIDES):
                mine = [sums[o] for o in own if _side(strand, o, setting) == name]
                if not mine:
                    continue
                n, total, squares = sum(mine)
                mean = total // np.maximum(n, 1)
                same = (mean * n == total) & (mean * mean * n == squares)
                hit = n > 0
                found.append((asked[hit], np.full(hit.sum(), side), np.where(same, mean, -1)[hit]))
        if not found:
            return arrow.empty_table()
        row, side, copy = (np.concatenate(x) for x in zip(*found))
        whole = left.column("__whole").to_numpy()[row]
        sample, samples = coded(left, ["sample"])
        cells = (sample[row] * 2 + side) * ids.num_rows + copy
        cells, n = np.unique(cells[whole & (copy >= 0)], return_counts=True)
        row, side, copy = row[~whole], side[~whole], copy[~whole]
        several = np.concatenate((np.zeros(len(cells), bool), copy < 0))
        copy = np.concatenate((cells % ids.num_rows, np.maximum(copy, 0)))
        side = np.concatenate((cells // ids.num_rows % 2, side))
        sample = np.concatenate((cells // ids.num_rows // 2, sample[row]))
        frag = left.column("frag").combine_chunks()
        made = [
            samples.column("sample").take(pa.array(sample)),
            pa.chunked_array([pa.nulls(len(cells), frag.type), frag.take(pa.array(row))]),
            pa.array(SIDES).take(pa.array(side)),
            ids.column("fid").take(pa.array(copy, mask=several)),
            np.concatenate((n, np.ones(len(row), np.int64))),
            np.arange(len(side)) < len(cells),
        ]
        return pa.table(dict(zip(arrow.names, made))).cast(arrow)

    found = meet(left, right, ["chrom"], scan, schema)
    # Counts stay apart by their copy, the others meet by fragment.
    apart = F.when(F.col("__whole"), F.col("fid")).alias("__copy")
    met = found.groupBy("sample", "orientation", "__whole", "frag", apart).agg(
        F.min("fid").alias("fid"), F.max("fid").alias("__last"), F.max(F.col("fid").isNull()).alias("__several"), F.sum("__n").alias("__n")
    )
    kept = met.where(~F.col("__several") & (F.col("fid") == F.col("__last")))
    n = F.when(F.col("__whole"), F.col("__n")).otherwise(F.lit(1))
    return kept.groupBy("sample", "orientation", "fid").agg(F.sum(n).alias("n"))


def on_each_copy(copies: DataFrame, stretches: DataFrame, setting: int, width: int = WIDTH) -> DataFrame:
    """Fragments per (sample, orientation, fid) on the copy, wherever else they are.

    A copy meets neighbouring stretches of a fragment, so its fragments are the stretches it meets less the gaps between
    neighbours that it spans; no pair is formed. Only copies whose id stands in several places, and fragments on several
    strands of a chromosome or with a stretch that has no base, are paired, as a fragment would count twice.
    """
    place = ["fid", "chrom", "f_strand", "r_start", "r_end"]
    copies = staged(lone_ids(copies.where("chrom is not null").select(*place).repartition("fid").distinct()))
    chain = W.partitionBy("sample", "frag", "chrom")
    strand, bare = F.struct("strand"), F.col("start_pos") >= F.col("end_pos")
    plain = F.min(strand).over(chain).eqNullSafe(F.max(strand).over(chain)) & ~F.coalesce(F.max(bare).over(chain), F.lit(False))
    before = F.lag("end_pos").over(chain.orderBy("start_pos"))
    known = stretches.where("chrom is not null and start_pos is not null and end_pos is not null")
    stretches = staged(known.withColumns({"__plain": plain, "__prev": before}))

    left = _laid(stretches.where("__plain"), "start_pos", "end_pos", width)
    left = left.select("sample", "chrom", "strand", "start_pos", "end_pos", F.coalesce("__prev", "start_pos").alias("__prev"), TILE_COL)
    right = _laid(copies.where("__alone"), "r_start", "r_end", width)
    kind = {f.name: f.dataType for f in (*stretches.schema, *copies.schema)}
    schema = StructType([StructField("sample", kind["sample"]), StructField("orientation", StringType()), StructField("fid", kind["fid"]),
                         StructField("n", LongType())])
    arrow = to_arrow_schema(schema)

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        base = left.column(TILE_COL)[0].as_py() * width
        start, end, past = _from(base, left, "start_pos", "end_pos", "__prev")
        low, high = _from(base, right, "r_start", "r_end")
        strands, own = _rows_of(left, "strand"), _rows_of(right, "f_strand")
        code, samples = coded(left, ["sample"])
        found = []
        for o, asked in own.items():
            for side, name in enumerate(SIDES):
                rows = [rows for strand, rows in strands.items() if _side(strand, o, setting) == name]
                if not rows:
                    continue
                rows = np.concatenate(rows)
                for k in range(samples.num_rows):
                    mine = rows[code[rows] == k]
                    # A gap belongs to the tile in which it ends.
                    gaps = mine[(past[mine] < start[mine]) & (start[mine] >= 0)]
                    weights = np.concatenate((np.ones(len(mine), np.int64), -np.ones(len(gaps), np.int64)))[None]
                    a, b = np.concatenate((start[mine], start[gaps])), np.concatenate((end[mine], past[gaps]))
                    n = overlap_sums(a, b, weights, low[asked], high[asked], width)[0]
                    # Those that reach in beside the copy met it in the tile before.
                    n -= np.where(low[asked] < 0, (start[mine] < 0).sum(), 0)
                    hit = n > 0
                    found.append((np.full(hit.sum(), k), np.full(hit.sum(), side), asked[hit], n[hit]))
        if not found:
            return arrow.empty_table()
        sample, side, copy, n = (np.concatenate(x) for x in zip(*found))
        made = [samples.column("sample").take(pa.array(sample)), pa.array(SIDES).take(pa.array(side)),
                right.column("fid").take(pa.array(copy)), n]
        return pa.table(dict(zip(arrow.names, made))).cast(arrow)

    keys = ["sample", "orientation", "fid"]
    inside = meet(left, right.where("__inside").drop("__inside", "__alone"), ["chrom"], scan, schema)
    across = meet(left, right.where("not __inside").drop("__inside", "__alone"), ["chrom"], scan, schema)
    across = across.groupBy(*keys).agg(F.sum("n").alias("n"))

    def paired(some: DataFrame, those: DataFrame) -> DataFrame:
        on = overlap_join(those.drop("__plain", "__prev"), some.drop("__alone")).select("sample", "frag", _side_column(setting).alias("orientation"), "fid")
        return on.distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    out = inside.unionByName(across)
    odd = stretches.where("not __plain")
    if not odd.isEmpty():
        out = out.unionByName(paired(copies.where("__alone"), odd)).groupBy(*keys).agg(F.sum("n").alias("n"))
    many = copies.where("not __alone")
    return out if many.isEmpty() else out.unionByName(paired(many, stretches))
