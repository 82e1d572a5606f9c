"""Concentration of a copy's distant contacts on target bins, against redraw and peer references."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.intervals import floor_div, orientation
from ..functions.special import NAN, normal_upper
from ..operators.coverage import bin_grid
from ..operators.order import benjamini_hochberg, peer_z
from ..operators.redraw import Splitter, draw_statistics, group_counts, hashed_split, row_statistics, single_draws
from ..session import spread, staged

TRANS = -1
CELL = ("fid", "orientation")
#: Bins of a genome that a task may hold as running weights.
MOST_BINS = 4_000_000
#: Counts that are split at once.
DRAWN = 1_000_000
#: Contacts of a cell that are redrawn one by one.
FEW = 24


def parse_regions(spec: str) -> list[tuple[str, int, int]]:
    """``chrom:start-end,...`` as tuples."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        chrom, span = part.split(":")
        lo, hi = span.split("-")
        out.append((chrom, int(lo), int(hi)))
    return out


def target_bins(
    contacts: DataFrame, sizes: DataFrame, binsize: int, mask_mult: float = 3.5, exclude: str = ""
) -> DataFrame:
    """DNA-end density per bin: masked bins lose their weight, the rest is renormalised.

    Bins above ``mask_mult`` times the median non-empty density and bins of ``exclude`` are masked; a region on a
    chromosome without bins is a warning. One row per genome bin.
    """
    counts = contacts.groupBy(F.col("dna_chrom").alias("chrom"), floor_div("dna_pos", binsize).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    grid = staged(bin_grid(sizes, binsize).join(counts, ["chrom", "bin"], "left").na.fill(0, ["n"]))
    total = grid.agg(F.sum("n").alias("n")).scalar()
    dens = staged(grid.withColumn("density", F.coalesce(F.try_divide("n", total), F.lit(0.0))))
    masked = F.lit(False)
    if mask_mult > 0:
        masked = F.col("density") > dens.where("n > 0").agg(F.median("density").alias("m")).scalar() * mask_mult
    regions = parse_regions(exclude)
    names = {r.chrom for r in sizes.select("chrom").distinct().collect()} if regions else set()
    for chrom, lo, hi in regions:
        if chrom not in names:
            warnings.warn(f"the excluded region {chrom}:{lo}-{hi} is on a chromosome without bins", stacklevel=2)
        masked = masked | ((F.col("chrom") == chrom) & F.col("bin").between(lo // binsize, hi // binsize))
    kept = staged(dens.withColumn("masked", F.coalesce(masked, F.lit(False))))
    left = kept.where(~F.col("masked")).agg(F.sum("density").alias("w")).scalar()
    weight = F.when(F.col("masked"), 0.0).otherwise(F.coalesce(F.try_divide("density", left), F.lit(0.0)))
    return kept.withColumn("weight", weight)


def distant_counts(hits: DataFrame, bins: DataFrame, binsize: int, proximal: int) -> DataFrame:
    """Per (copy, orientation, target bin): all contacts and those beyond the proximal cut, with the bin's mask.

    Contacts of copies whose own bin is masked drop out: a masked bin is neither target nor source.
    """
    flags = bins.select(F.col("chrom").alias("dna_chrom"), F.col("bin").alias("tbin"), F.col("masked").alias("t_masked"))
    source = bins.where(~F.col("masked")).select("chrom", F.col("bin").alias("sbin"))
    far = (F.col("dna_chrom") != F.col("chrom")) | (F.abs(F.col("dna_pos") - F.col("start_pos")) > proximal)
    tagged = hits.withColumns({
        "orientation": orientation("rna_strand", "strand", inverted=True),
        "tbin": floor_div("dna_pos", binsize),
        "sbin": floor_div("start_pos", binsize),
        "far": far.cast("long"),
    })
    per_bin = tagged.groupBy(*CELL, "family", "subfamily", "chrom", "start_pos", "sbin", "dna_chrom", "tbin").agg(
        F.count(F.lit(1)).alias("n_all"), F.sum("far").alias("n_far")
    )
    return per_bin.join(source, ["chrom", "sbin"], "left_semi").join(flags, ["dna_chrom", "tbin"])


def concentration(per_bin: DataFrame, min_contacts: int) -> DataFrame:
    """Herfindahl index, effective bins and top bin per (copy, orientation); every cut re-checks the minimum."""
    n = F.when(~F.col("t_masked"), F.col("n_far")).otherwise(0)
    cells = per_bin.groupBy(*CELL, "family", "subfamily", "chrom", "start_pos").agg(
        F.sum("n_all").alias("__all"), F.sum("n_far").alias("__far"), F.sum(n).alias("n_contacts"),
        F.sum(n * n).alias("__sq"), F.max(n).alias("top1"), F.sum((n > 0).cast("long")).alias("n_bins"),
    )
    gates = [F.col(c) >= min_contacts for c in ("__all", "__far", "n_contacts")]
    h = F.col("__sq") / (F.col("n_contacts").cast("double") * F.col("n_contacts"))
    kept = cells.where(gates[0] & gates[1] & gates[2]).withColumn("h", h)
    return kept.withColumn("eff_bins", 1.0 / F.col("h")).drop("__all", "__far", "__sq")


def reach_edges(proximal: int, count: int = 10) -> list[int]:
    return [proximal * 2**k for k in range(count)]


class _Layout:
    """Running weights over all bins in order of chromosome and bin: by density, and equal ones for the unmasked."""

    def __init__(self, bins: DataFrame, binsize: int, proximal: int):
        n = bins.count()
        if n > MOST_BINS:
            raise ValueError(f"{n} bins; a task holds {MOST_BINS}: take wider bins")
        table = bins.select("chrom", "bin", "weight", "masked").toArrow().sort_by([("chrom", "ascending"), ("bin", "ascending")])
        self.binsize, self.n = binsize, n
        self.edges = np.array([*reach_edges(proximal), 1 << 50], np.int64)
        weight = table.column("weight").to_numpy()
        free = ~table.column("masked").to_numpy()
        self.sums = np.concatenate((np.zeros((2, 1)), np.cumsum([weight, free.astype(float)], axis=1)), axis=1)
        chrom = np.array(table.column("chrom").to_pylist(), object)
        cut = np.flatnonzero(np.concatenate(([True], chrom[1:] != chrom[:-1]))) if n else np.zeros(0, int)
        self.span = {c: (int(i), int(j)) for c, i, j in zip(chrom[cut], cut, [*cut[1:], n])}

        self.squares = np.concatenate((np.zeros((2, 1)), np.cumsum([weight * weight, free.astype(float)], axis=1)), axis=1)

    def runs(self, chrom: str, start: int, stratum: int) -> tuple[tuple[int, int, int, int], int]:
        """Two runs of bins that a stratum may reach, and which running weights decide between them."""
        runs, by, _ = self.all_runs([chrom], np.array([start]), np.array([stratum]))
        return tuple(runs[0].tolist()), int(by[0])

    def all_runs(self, chrom: list[str], start: np.ndarray, stratum: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``runs`` of many strata at once, and which of them fell back to the whole own chromosome."""
        off, end = np.array([self.span[c] for c in chrom], np.int64).reshape(-1, 2).T
        trans = stratum == TRANS
        half, level = self.binsize // 2, np.where(trans, 0, stratum)
        lo, hi = self.edges[level], self.edges[level + 1]
        inside = lambda b: off + np.clip(b, 0, end - off)
        up = lambda x: -((half - x) // self.binsize)
        down = lambda x: (x - half) // self.binsize + 1
        own = np.stack((inside(up(start - hi)), inside(up(start - lo)), inside(down(start + lo)), inside(down(start + hi))), axis=1)
        other = np.stack((np.zeros_like(off), off, end, np.full_like(off, self.n)), axis=1)
        runs = np.where(trans[:, None], other, own)
        mass = lambda r: [c[r[:, 1]] - c[r[:, 0]] + c[r[:, 3]] - c[r[:, 2]] for c in self.sums]
        back = ~(mass(runs)[1] > 0)
        runs[back] = np.stack((off, end, end, end), axis=1)[back]
        weight, free = mass(runs)
        if (free <= 0).any():
            raise ValueError(f"no unmasked bin on {chrom[int(np.flatnonzero(free <= 0)[0])]}")
        return runs, np.where(weight > 0, 0, 1), back


class _Cells:
    """Cells of a batch and their strata: a stratum has its cell's number, its name, its count and its runs."""

    def __init__(self, batch: pa.RecordBatch, layout: _Layout):
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        self.fid, self.orientation = column("fid"), column("orientation")
        self.key, self.n = column("key").to_numpy(), column("n_contacts").to_numpy()
        strata = column("strata")
        size = strata.value_lengths().to_numpy()
        self.cut = np.concatenate(([0], np.cumsum(size)))
        self.cell = np.repeat(np.arange(len(self.key)), size)
        flat = strata.flatten()
        self.stratum, self.k = (flat.field(j).to_numpy().astype(np.int64) for j in range(2))
        chrom, start = column("chrom").to_pylist(), column("start_pos").to_numpy()
        self.runs, self.of, self.back = layout.all_runs([chrom[c] for c in self.cell], start[self.cell], self.stratum)

    def total(self, values: np.ndarray) -> np.ndarray:
        """The sum of a value of the strata per cell."""
        return np.bincount(self.cell, weights=values, minlength=len(self.key))


def _reach_counts(hits: DataFrame, cells: DataFrame, bins: DataFrame, binsize: int, proximal: int) -> DataFrame:
    """Per tested (copy, orientation): its place, a hash of it, and its distant contacts per reach, twelve entries at most."""
    edges = reach_edges(proximal)
    free = bins.where(~F.col("masked")).select(F.col("chrom").alias("dna_chrom"), F.col("bin").alias("tbin"))
    d = F.abs(F.col("dna_pos") - F.col("start_pos"))
    own = F.col("dna_chrom") == F.col("chrom")
    level = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in edges]), lambda e: e <= d)) - 1
    far = hits.withColumns({
        "orientation": orientation("rna_strand", "strand", inverted=True), "tbin": floor_div("dna_pos", binsize),
    }).where(~own | (d > proximal)).join(free, ["dna_chrom", "tbin"], "left_semi")
    strata = far.withColumn("stratum", F.when(own, level).otherwise(TRANS)).groupBy(
        *CELL, "chrom", "start_pos", "stratum"
    ).agg(F.count(F.lit(1)).alias("k"))
    wanted = strata.join(cells.select(*CELL, "n_contacts"), list(CELL)).groupBy(*CELL, "chrom", "start_pos", "n_contacts").agg(
        F.array_sort(F.collect_list(F.struct("stratum", "k"))).alias("strata")
    )
    return spread(wanted.withColumn("key", F.xxhash64(*CELL)), *CELL)


def _per_batch(wanted: DataFrame, layout: _Layout, fn, added: str) -> DataFrame:
    """CELL and the columns that ``fn`` gives for a batch of rows of _reach_counts."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema if f.name in CELL)
    names = [*CELL, *(c.split(" ")[0] for c in added.split(", "))]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cells = _Cells(batch, layout)
                yield pa.RecordBatch.from_arrays([cells.fid, cells.orientation, *fn(cells)], names=names)

    return wanted.mapInArrow(run, f"{kinds}, {added}")


def _slices(cost: np.ndarray) -> list[np.ndarray]:
    """Positions in pieces whose cost is about DRAWN."""
    piece = np.cumsum(cost) // DRAWN
    return np.split(np.arange(len(cost)), np.flatnonzero(np.diff(piece)) + 1) if len(cost) else []


def redraw_null(
    hits: DataFrame, cells: DataFrame, bins: DataFrame, binsize: int, proximal: int, draws: int, splitter: Splitter | None = None
) -> DataFrame:
    """Mean and spread of H and the mean top bin when each contact keeps its reach and redraws its bin.

    A contact's reach is its log2 distance stratum on the own chromosome, or another chromosome. Contacts are counted per
    (copy, stratum) first; a count is split down the halves of the bins it may reach, so no row stands for a single contact, and a
    copy's draws never leave its task. Production draws of a copy with FEW contacts at most are made contact by contact. A stratum whose bins are free but empty draws them alike; one
    without a free bin falls back to the whole own chromosome. A task holds two numbers for every genome bin, MOST_BINS at
    most.
    """
    splitter = splitter or hashed_split()
    layout = _Layout(bins, binsize, proximal)
    wanted = _reach_counts(hits, cells, bins, binsize, proximal)

    def alone(c: _Cells, j: int) -> tuple[np.ndarray, np.ndarray]:
        of, n = slice(c.cut[j], c.cut[j + 1]), int(c.n[j])
        split = splitter(int(c.key[j]), c.fid[j].as_py(), c.orientation[j].as_py(), c.stratum[of])
        step = max(1, DRAWN // min(n, layout.n))
        squares, top = [], []
        for first in range(0, draws, step):
            here = np.arange(first, min(first + step, draws))
            _, g, draw, count = group_counts(c.k[of], c.runs[of], layout.sums, c.of[of], here, split)
            for out, x in zip((squares, top), draw_statistics(g, draw - first, count, layout.n, len(here))):
                out.append(x)
        return np.concatenate(squares), np.concatenate(top)

    def together(c: _Cells, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = np.concatenate([np.arange(c.cut[j], c.cut[j + 1]) for j in some])
        own = np.searchsorted(some, c.cell[of])
        fid, side = c.fid.to_numpy(zero_copy_only=False)[c.cell[of]], c.orientation.to_numpy(zero_copy_only=False)[c.cell[of]]
        split = splitter.many(fid, side, c.stratum[of])
        g, bins, draw, count = group_counts(c.k[of], c.runs[of], layout.sums, c.of[of], np.arange(draws), split)
        return draw_statistics(bins, own[g] * draws + draw, count, layout.n, len(some) * draws)

    def singly(c: _Cells, some: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        of = np.concatenate([np.repeat(np.arange(c.cut[j], c.cut[j + 1]), c.k[c.cut[j]:c.cut[j + 1]]) for j in some])
        group = np.repeat(of.reshape(len(some), 1, m), draws, axis=1).ravel()
        draw, thing = np.broadcast_to(np.arange(draws)[:, None], (draws, m)).ravel(), np.tile(np.arange(m), draws)
        uniform = splitter.uniform(np.repeat(c.key[some], draws * m), np.tile(thing, len(some)), np.tile(draw, len(some)))
        return row_statistics(single_draws(c.runs, layout.sums, c.of, group, uniform).reshape(-1, m))

    def drawn(c: _Cells) -> list[pa.Array]:
        size, m = len(c.key), c.total(c.k).astype(np.int64)
        h, sd, top = np.zeros(size), np.zeros(size), np.zeros(size)

        def keep(some: np.ndarray, squares: np.ndarray, most: np.ndarray) -> None:
            n = c.n[some].astype(float)[:, None]
            share = squares.reshape(len(some), draws) / (n * n)
            h[some], top[some] = share.mean(axis=1), most.reshape(len(some), draws).mean(axis=1)
            sd[some] = share.std(axis=1, ddof=1) if draws > 1 else 0.0

        left = np.ones(size, bool)
        if hasattr(splitter, "uniform"):
            for count in np.unique(m[m <= FEW]):
                some = np.flatnonzero(m == count)
                left[some] = False
                for part in _slices(np.full(len(some), count * draws)):
                    keep(some[part], *singly(c, some[part], int(count)))
        elif hasattr(splitter, "many"):
            cost = np.minimum(m, layout.n) * draws
            some = np.flatnonzero(cost <= DRAWN)
            left[some] = False
            for part in _slices(cost[some]):
                keep(some[part], *together(c, some[part]))
        for j in np.flatnonzero(left):
            keep(np.array([j]), *alone(c, j))
        return [pa.array(h), pa.array(sd, mask=np.full(size, draws < 2)), pa.array(top)]

    return _per_batch(wanted, layout, drawn, "h_null double, h_null_sd double, top1_null double")


def expected_null(hits: DataFrame, cells: DataFrame, bins: DataFrame, binsize: int, proximal: int) -> DataFrame:
    """The mean of H under all redraws, by its formula: what ``h_null`` comes near to with many draws.

    A copy's strata reach different bins, so their squares add up from running sums; bins are gone through only for copies with
    a stratum that fell back to the own chromosome.
    """
    layout = _Layout(bins, binsize, proximal)

    def whole(c: _Cells, j: int) -> float:
        total, own = np.zeros(layout.n), 0.0
        for s in range(c.cut[j], c.cut[j + 1]):
            a1, b1, a2, b2 = c.runs[s]
            weight = np.diff(layout.sums[c.of[s]])
            weight[:a1] = weight[b1:a2] = weight[b2:] = 0
            p = weight / weight.sum()
            total += c.k[s] * p
            own += c.k[s] * (p * (1 - p)).sum()
        return ((total * total).sum() + own) / (float(c.n[j]) * c.n[j])

    def mean(c: _Cells) -> list[pa.Array]:
        a1, b1, a2, b2 = c.runs.T
        mass, squares = (x[c.of, b1] - x[c.of, a1] + x[c.of, b2] - x[c.of, a2] for x in (layout.sums, layout.squares))
        like = squares / (mass * mass)
        n = c.n.astype(float)
        out = c.total(c.k.astype(float) * c.k * like + c.k * (1 - like)) / (n * n)
        for j in np.unique(c.cell[c.back]):
            out[j] = whole(c, j)
        return [pa.array(out)]

    return _per_batch(_reach_counts(hits, cells, bins, binsize, proximal), layout, mean, "h_expected double")


def target_test(
    hits: DataFrame,
    sizes: DataFrame,
    binsize: int = 1_000_000,
    proximal: int = 1_000_000,
    min_contacts: int = 50,
    draws: int = 200,
    mask_mult: float = 3.5,
    exclude: str = "",
    splitter: Splitter | None = None,
    least_peers: int = 20,
    min_mapq: int = 0,
    min_mapq_dna: int | None = None,
) -> DataFrame:
    """Concentration of each (copy, orientation) with its redraw z and its z among peers of like depth.

    Contacts count where both ends reach their mapping-quality floor, in the bin weights too; the DNA end's is
    ``min_mapq`` unless given.
    """
    dna = min_mapq if min_mapq_dna is None else min_mapq_dna
    if min_mapq > 0 or dna > 0:
        hits = staged(hits.where((F.col("mapq") >= min_mapq) & (F.col("mapq_dna") >= dna)))
    bins = staged(target_bins(hits, sizes, binsize, mask_mult, exclude))
    cells = staged(concentration(distant_counts(hits, bins, binsize, proximal), min_contacts))
    null = redraw_null(hits, cells, bins, binsize, proximal, draws, splitter)
    out = cells.join(null, list(CELL))
    z = F.when(F.col("h_null_sd") > 0, (F.col("h") - F.col("h_null")) / F.col("h_null_sd")).otherwise(F.lit(NAN))
    out = peer_z(out.withColumn("z", z), "n_contacts", "h", least_peers)
    out = out.withColumn("p", normal_upper("z")).withColumn("p_peer", normal_upper("z_peer"))
    out = benjamini_hochberg(out, "p", "q", bounded=False)
    return benjamini_hochberg(out, "p_peer", "q_peer", bounded=False)
