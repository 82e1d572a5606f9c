import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from locusmill.operators.assignment import on_each_copy, on_one_copy
from locusmill.operators.tiles import overlap_sums
from locusmill.plans import reads

SPAN = "chrom string, start_pos long, end_pos long, strand string"


def test_sums_over_overlaps():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, m = rng.integers(1, 40, 2)
        start, low = rng.integers(0, 64, n), rng.integers(0, 64, m)
        end, high = start + rng.integers(-9, 30, n), low + rng.integers(-5, 30, m)
        weights = rng.integers(-3, 9, (2, n))
        want = [[w[(start < b) & (end > a)].sum() for a, b in zip(low, high)] for w in weights]
        assert (overlap_sums(start, end, weights, low, high, 64) == want).all()


def made(seed):
    """Copies and blocks over tile borders, with ids in several places, unknown strands and ends, and bases missing."""
    rng = random.Random(seed)
    copies = [(rng.choice([k, k, k, 1, None]), rng.choice(["a", "a", "b", None]), s := rng.randrange(0, 300), s + rng.choice([0, 9, 40, 120]),
               rng.choice(["+", "-", "+", "-", None])) for k in range(40)]
    blocks = [(rng.choice("st"), rng.choice([*range(40), None]), rng.choice(["a", "a", "a", "b"]), s := rng.randrange(0, 320),
               s + rng.choice([0, 3, 10, 30]) if rng.random() < 0.97 else None, rng.choice(["+", "+", "-", "-", "."])) for _ in range(120)]
    return copies, blocks


def brute(copies, blocks, setting, multi):
    held = defaultdict(set)
    for sample, frag, chrom, s, e, strand in blocks:
        for fid, c, a, b, own in copies:
            if e is None or c != chrom or not (s < b and e > a):
                continue
            known = strand is not None and own is not None
            held[sample, frag, "sense" if known and (strand == own) == (setting == 1) else "antisense"].add(fid)
    tally = Counter()
    for (sample, _, side), fids in held.items():
        if multi == "drop":
            fids = fids - {None}
            fids = fids if len(fids) == 1 else ()
        tally.update((sample, side, fid) for fid in fids)
    return {(*k, n) for k, n in tally.items()}


@pytest.mark.parametrize("setting,multi", [(1, "drop"), (2, "all")])
def test_fragments_on_copies_against_all_pairs(spark, setting, multi):
    copies, blocks = made(setting)
    features = spark.createDataFrame(copies, "fid long, chrom string, r_start long, r_end long, f_strand string")
    aligned = spark.createDataFrame(blocks, "sample string, frag long, chrom string, start_pos long, end_pos long, strand string")
    stretches = reads.islands(aligned.where("end_pos is not null"), reads.PIECE)
    count = on_one_copy if multi == "drop" else on_each_copy
    want = brute(copies, blocks, setting, multi)
    assert want and {tuple(r) for r in count(features, stretches, setting, width=64).collect()} == want
    renamed = features.toDF("fid", "chrom", "start_pos", "end_pos", "strand")
    assert {tuple(r) for r in reads.count_reads(renamed, aligned, setting, multi).collect()} == want


def test_no_pair_of_copy_and_fragment_is_formed(spark):
    """300 copies over one another under 300 fragments with a gap: 90,000 pairs, and 300 rows."""
    features = spark.createDataFrame([(k, "c", 0, 1000 + k, "+") for k in range(300)], f"fid long, {SPAN}")
    rows = [("s", k, m, "c", 100 + m * 200, 150 + m * 200, "+" if m == 1 else "-") for k in range(300) for m in (1, 2)]
    aligned = spark.createDataFrame(rows, f"sample string, frag long, read int, {SPAN}")
    for multi in ("drop", "all"):
        counted = reads.count_reads(features, aligned, multi=multi)
        assert "Join" not in counted._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in counted.collect()} == ({("s", "sense", k, 300) for k in range(300)} if multi == "all" else set())
