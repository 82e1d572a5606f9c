"""Composed runs stop at their checks; analyses own their folders; streams go on."""

import os
import random

import pytest
from pyspark.sql import functions as F

from locusmill.plans import runs
from locusmill.session import scratch_path, staged, staged_paths, workspace
from locusmill.streaming import contacts as streaming

SPAN = "chrom string, start_pos long, end_pos long, strand string"
CONTACT = "rna_chrom string, rna_pos long, rna_strand string, mapq int, dna_chrom string, dna_pos long, mapq_dna int"


def test_a_workspace_goes_with_its_analysis(spark):
    before = staged_paths()
    with workspace(spark) as path:
        inner = staged(spark.range(5))
        outside = staged(spark.range(7), keep=True)
        with workspace(spark) as other:
            staged(spark.range(3))
            assert os.listdir(other) and other.startswith(path)
        assert not os.path.exists(other) and inner.count() == 5 and os.listdir(path)
    assert not os.path.exists(path) and outside.count() == 7 and staged_paths() == before
    with pytest.raises(KeyError), workspace(spark) as path:
        staged(spark.range(2))
        raise KeyError
    assert not os.path.exists(path)


def contact_tables(spark):
    rnd = random.Random(3)
    genes = [(k, "chr1", 2000 * k, 2000 * k + 1000, "+-"[k % 2]) for k in range(6)]
    exons = [(k, c, s, s + 200, t) for k, c, s, e, t in genes]
    rows = []
    for n in range(400):
        k, _, start, _, strand = genes[n % 6]
        rows.append(("chr1", start + rnd.randrange(250), "-" if strand == "+" else "+", n % 60, "chr1", rnd.randrange(40_000), 30))
    copies = [(k, "chr1", 2000 * (k % 6) + 100, 2000 * (k % 6) + 240, "+-"[k % 2], f"s{k % 2}", "f") for k in range(12)] + [(99, "chrX", 0, 9, "+", "s0", "f")]
    return dict(
        contacts=spark.createDataFrame(rows, CONTACT),
        features=spark.createDataFrame(copies, f"fid long, {SPAN}, subfamily string, family string"),
        genes=spark.createDataFrame(genes, f"gene_id long, {SPAN}"), exons=spark.createDataFrame(exons, f"gene_id long, {SPAN}"),
        housekeeping=spark.createDataFrame(genes[:4], f"gene_id long, {SPAN}"),
        sizes=spark.createDataFrame([("chr1", 40_000)], "chrom string, size long"),
    )


def test_contact_gates(spark):
    tables = contact_tables(spark)
    how = dict(shifts=4, min_contacts=5, least_signal=50, min_mapq=20)
    flip = tables["contacts"].selectExpr("dna_chrom as rna_chrom", "dna_pos as rna_pos", "rna_strand", "mapq", "rna_chrom as dna_chrom", "rna_pos as dna_pos", "mapq_dna")
    with pytest.raises(ValueError, match="end 2 of the pairs"):
        runs.contact_analysis(**{**tables, "contacts": flip}, **how)
    wrong = tables["housekeeping"].withColumn("strand", F.when(F.col("gene_id") == 1, "+").otherwise(F.col("strand")))
    with pytest.raises(ValueError, match="in conflict"):
        runs.contact_analysis(**{**tables, "housekeeping": wrong}, **how)
    with pytest.raises(ValueError, match="undetermined"):
        runs.contact_analysis(**{**tables, "housekeeping": tables["housekeeping"].limit(1)}, **how)
    with pytest.raises(ValueError, match="underdetermined"):
        runs.contact_analysis(**tables, **{**how, "least_signal": 10**6})
    with workspace(spark):
        run = runs.contact_analysis(**tables, **how)
        assert {tuple(r) for r in run.checks.collect()} == {("RNA end", "1"), ("strand convention", "inverted")}
        losses = {r.what: r.n for r in run.losses.collect()}
        rows = run.result.collect()
    low = sum(1 for n in range(400) if n % 60 < 20)
    assert losses["contacts below a quality floor"] == low and losses["copies on unknown chromosomes"] == 1
    assert losses["contacts on unknown chromosomes"] == 0
    assert {(r.subfamily, r.n_copies) for r in rows} == {("s0", 7), ("s1", 6)} and {r.orientation for r in rows} == {"sense"}


def test_signal_gate(spark):
    track = spark.createDataFrame([("ip_r1", "pos", "chr1", 0, 10, 1.0)], "sample string, track_strand string, chrom string, start_pos long, end_pos long, value double")
    copies = spark.createDataFrame([(1, "chr1", 0, 9, "+", "s", "f")], f"fid long, {SPAN}, subfamily string, family string")
    sizes = spark.createDataFrame([("chr1", 100)], "chrom string, size long")
    with pytest.raises(ValueError, match="ip_r1 neg"):
        runs.signal_analysis(copies, track, sizes)


def test_timing_gates(spark):
    rnd = random.Random(1)
    bins = [("chr1", b) for b in range(60)]
    grid = spark.createDataFrame(bins, "chrom string, bin long")
    schema = "sample string, chrom string, start_pos long, end_pos long, value double"
    gc = {b: rnd.random() for _, b in bins}
    cov = spark.createDataFrame([("chr1", b, g) for b, g in gc.items()], "chrom string, bin long, gc_frac double")
    early = [(f, "chr1", 100 * b, 100 * b + 100, 0.1 + (g if f == "P1" else 1 - g)) for b, g in gc.items() for f in ("P1", "P2")]

    def run(rows, fractions=("P1", "P2")):
        return runs.timing_analysis(spark.createDataFrame(rows, schema), grid, cov, fractions, 100)

    got = run(early)
    assert got.checks.first().outcome == "low_is_early" and got.losses.first().n == 0
    top = got.result.orderBy(F.desc("early")).first()
    assert top.bin == max(gc, key=gc.get)
    with pytest.raises(ValueError, match=r"without signal: \['P3'\]"):
        run(early, ("P1", "P2", "P3"))
    with pytest.raises(ValueError, match="cover under"):
        run([r for r in early if r[0] == "P1" or r[2] < 2000])
    with pytest.raises(ValueError, match="too weak"):
        run([(f, c, s, e, 1.0 + (s // 100 % 2) * (f == "P1")) for f, c, s, e, _ in early])


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    schema = "fid long, rna_chrom string, rna_pos long, rna_strand string, mapq long, dna_chrom string, dna_pos long"
    copies = spark.createDataFrame([(1, "s", "+")], "fid long, subfamily string, strand string")
    source, out, point = (str(tmp_path / n) for n in ("in", "out", "point"))

    def arrive(n):
        spark.createDataFrame([(1, "chr1", 5, "+", 60, "chr1", 9)] * n, schema).coalesce(1).write.mode("append").parquet(source)

    def totals(out, point):
        return [r.n for r in streaming.run_tally(streaming.stream_contacts(spark, source, schema), copies, out, point).collect()]

    arrive(3)
    assert totals(out, point) == [3]
    assert totals(out, point) == [3]
    arrive(4)
    arrive(1)
    assert totals(out, point) == [8]
    assert totals(scratch_path(spark, "fresh"), str(tmp_path / "p2")) == [8]
    for n in (2, 5):
        arrive(n)
        totals(out, point)
    assert 1 <= len(os.listdir(out)) <= 2 and totals(out, point) == [15]
