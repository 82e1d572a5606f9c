"""Locus-deduplicated counts, dense category grids and pooled backgrounds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..functions.intervals import ANTISENSE, SENSE, orientation
from ..session import staged
from .intervals import TILE, merge, overlap_join, tile
from .tiles import TILE_COL, WIDTH, Overlaps, coded, meet, tiles_of, within

CATEGORY = ("subfamily", "orientation")


def locus_hits(
    features: DataFrame,
    peaks: DataFrame,
    by: Sequence[str] = ("cell_line", "sample"),
    carry: Sequence[str] = ("subfamily",),
    width: int = TILE,
) -> DataFrame:
    """Distinct (group, feature, orientation) hits.

    Whether a feature is hit depends only on the bases a group's peaks cover per strand, so peaks are merged first:
    however many peaks tile one place, a feature meets few merged runs.
    """
    covered = staged(merge(peaks, [*by, "chrom", "strand"])).select(
        *by,
        "chrom",
        F.col("strand").alias("peak_strand"),
        F.col("start_pos").alias("r_start"),
        F.col("end_pos").alias("r_end"),
    )
    element = features.select("fid", "chrom", "start_pos", "end_pos", "strand", *carry)
    pairs = overlap_join(element, covered, width=width)
    tagged = pairs.withColumn("orientation", orientation("peak_strand", "strand"))
    return tagged.select(*by, "fid", *carry, "orientation").distinct()


def locus_counts(
    features: DataFrame, peaks: DataFrame, by: Sequence[str] = ("cell_line", "sample"), width: int = WIDTH, united: bool = False
) -> DataFrame:
    """Distinct features hit per (group, subfamily, orientation); ``united`` peaks are not merged again.

    A tile counts the features that lie in it whole and have their id alone; no pair of feature and peak is formed. The
    others, few, go by their ids.
    """
    found = _tile_hits(features, peaks, by, (*by, *CATEGORY), ("subfamily",), None, width, united)
    return _whole_and_split(found, (*by, *CATEGORY)).withColumnRenamed("__n", "loci")


def distinct_loci(
    features: DataFrame, peaks: DataFrame, wanted: DataFrame, pool: Sequence[str], by: Sequence[str], carry: str, width: int = WIDTH
) -> DataFrame:
    """Distinct features behind the ``wanted`` (group, subfamily, orientation) per (pool, carry), as ``n_loci``.

    The wanted cells are as many as the dictionaries have at most, so every task knows them all.
    """
    cells = frozenset(tuple(r) for r in wanted.select(*by, *CATEGORY).distinct().collect())
    found = _tile_hits(features, peaks, by, (*pool, carry), ("subfamily", carry), (tuple(pool), cells), width)
    return _whole_and_split(found, (*pool, carry)).withColumnRenamed("__n", "n_loci")


def _whole_and_split(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    whole = found.where("__whole").select(*keys, "__n")
    split = distinct_by(found.where("not __whole"), keys, ["fid"], "__n")
    return whole.unionByName(split).groupBy(*keys).agg(F.sum("__n").alias("__n"))


def lone_ids(features: DataFrame) -> DataFrame:
    """Features with ``__alone``, whether no other row has their id; null ids are never alone."""
    once = F.count(F.lit(1)).over(W.partitionBy("fid")) == 1
    return features.withColumn("__alone", once & F.col("fid").isNotNull())


def _tile_hits(
    features: DataFrame, peaks: DataFrame, by: Sequence[str], keys: Sequence[str], carry: Sequence[str],
    wanted: tuple[tuple[str, ...], frozenset] | None, width: int, united: bool = False,
) -> DataFrame:
    """Rows (keys, fid, __n, __whole): per tile the number of its whole features, and one row per hit of the others."""
    by, carry = list(by), list(carry)
    if not united:
        peaks = staged(merge(peaks, [*by, "chrom", "strand"]))
    runs = peaks.select(*by, "chrom", F.col("strand").alias("peak_strand"), F.col("start_pos").alias("r_start"), F.col("end_pos").alias("r_end"))
    runs = tile(runs.where("r_start is not null and r_end is not null"), "r_start", "r_end", width)
    marked = features if "__alone" in features.columns else lone_ids(features)
    first, last = tiles_of("start_pos", "end_pos", width)
    element = marked.where("start_pos is not null and end_pos is not null").select(
        "fid", "chrom", "start_pos", "end_pos", "strand", *dict.fromkeys(carry), (F.col("__alone") & (first == last)).alias("__whole"),
        F.explode(F.sequence(first, last)).alias(TILE_COL),
    )
    kind = {f.name: f.dataType for f in (*peaks.schema, *features.schema)} | {"orientation": StringType()}
    schema = StructType([*[StructField(k, kind[k]) for k in keys], StructField("fid", kind["fid"]), StructField("__n", LongType()),
                         StructField("__whole", BooleanType())])
    pool, cells = wanted or (None, None)

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        base = left.column(TILE_COL)[0].as_py() * width
        start, end = within(left, "start_pos", "end_pos", base, width)
        low, high = within(right, "r_start", "r_end", base, width)
        category, listed = coded(left, carry)
        group, groups = coded(right, by)
        whole = left.column("__whole").to_numpy()
        strands, own = right.column("peak_strand").to_pylist(), left.column("strand").to_pylist()
        number = {s: k for k, s in enumerate(dict.fromkeys([*strands, *own]))}
        run_strand, own_strand = np.array([number[s] for s in strands]), np.array([number[s] for s in own])
        rows_of = {s: np.flatnonzero(own_strand == k) for s, k in number.items()}
        order = np.lexsort((run_strand, group))
        cut = np.flatnonzero(np.diff(group[order] * len(number) + run_strand[order])) + 1
        sets: dict[int, dict] = {}
        for part in np.split(order, cut):
            sets.setdefault(int(group[part[0]]), {})[strands[part[0]]] = part
        names = list(zip(*[groups.column(c).to_pylist() for c in by]))
        subfamilies = listed.column("subfamily").to_pylist()
        # Of each kind of hit: a group, an orientation, and the rows hit; wanted hits are united over the groups of a pool.
        found: list[tuple[int, str, np.ndarray]] = []
        united_hits: dict[tuple, tuple[int, np.ndarray]] = {}
        for g, parts in sets.items():
            held = {s: Overlaps(low[part], high[part], len(start), width) for s, part in parts.items()}
            for strand, rows in rows_of.items():
                if not len(rows):
                    continue
                a, b = start[rows], end[rows]
                for side in (SENSE, ANTISENSE):
                    # Only equal strands are sense; an unknown one equals none.
                    mine = [s for s in held if (s is not None and s == strand) == (side == SENSE)]
                    if not mine:
                        continue
                    hit = rows[sum(held[s].count(a, b) for s in mine) > 0]
                    if cells is None:
                        found.append((g, side, hit))
                        continue
                    ok = np.array([None not in (*names[g], s) and (*names[g], s, side) in cells for s in subfamilies])
                    key = tuple(names[g][by.index(c)] for c in pool)
                    united_hits.setdefault(key, (g, np.zeros(len(start), bool)))[1][hit[ok[category[hit]]]] = True
        found += [(g, SENSE, np.flatnonzero(hit)) for g, hit in united_hits.values()]
        if not found:
            return arrow.empty_table()
        sums = np.array([np.bincount(category[hit[whole[hit]]], minlength=listed.num_rows) for _, _, hit in found])
        of, kinds = np.nonzero(sums)
        rest = [hit[~whole[hit]] for _, _, hit in found]
        of_rest, rest = np.repeat(np.arange(len(found)), [len(r) for r in rest]), np.concatenate(rest)
        at, kinds_all = np.concatenate((of, of_rest)), np.concatenate((kinds, category[rest]))
        group_at = pa.array(np.array([g for g, _, _ in found])[at])
        ids = left.column("fid").combine_chunks()
        made = {c: groups.column(c).take(group_at) for c in by} | {c: listed.column(c).take(pa.array(kinds_all)) for c in carry}
        made["orientation"] = pa.array([side for _, side, _ in found]).take(pa.array(at))
        made["fid"] = pa.concat_arrays([pa.nulls(len(of), ids.type), ids.take(pa.array(rest))])
        made["__n"] = np.concatenate((sums[of, kinds], np.ones(len(rest), np.int64)))
        made["__whole"] = np.arange(len(at)) < len(of)
        return pa.table({c: made[c] for c in arrow.names}, schema=arrow)

    arrow = to_arrow_schema(schema)
    return meet(element, runs, ["chrom"], scan, schema)


def categories(features: DataFrame, carry: Sequence[str] = ("family",)) -> DataFrame:
    """Every (subfamily, orientation), whether hit or not."""
    both = F.explode(F.array(F.lit(SENSE), F.lit(ANTISENSE))).alias("orientation")
    return features.select(*carry, "subfamily").distinct().select(*carry, "subfamily", both)


def dense_grid(groups: DataFrame, cats: DataFrame) -> DataFrame:
    """Each group with each category, zero cells included.

    The category list is as small as the annotation's dictionary, so it travels as one array row and is exploded in
    place of a product join.
    """
    listed = cats.agg(F.collect_set(F.struct(*cats.columns)).alias("__cats")).withColumn("__all", F.lit(0))
    wide = groups.withColumn("__all", F.lit(0)).join(F.broadcast(listed), "__all").drop("__all")
    return wide.withColumn("__c", F.explode("__cats")).select(*groups.columns, "__c.*")


def pooled(counts: DataFrame, pool: Sequence[str], cats: Sequence[str] = CATEGORY) -> DataFrame:
    """Add the pooled count per category and the leave-one-out rest; one row per group and category comes in."""
    total = F.sum("loci").over(W.partitionBy(*pool, *cats))
    return counts.withColumn("pooled", total).withColumn("rest", F.col("pooled") - F.col("loci"))


def distinct_by(df: DataFrame, keys: Sequence[str], counted: Sequence[str], name: str) -> DataFrame:
    """Distinct ``counted`` per key as two mergeable aggregates."""
    return df.select(*keys, *counted).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
