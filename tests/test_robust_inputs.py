import pytest
from pyspark.sql import functions as F

from locusmill.functions import special as sp
from locusmill.operators import hosts, intervals as iv
from locusmill.plans import matrix, peaks, reads
from locusmill.sources import readers


def lines(tmp_path, name, rows):
    path = tmp_path / name
    path.write_text("".join("\t".join(map(str, r)) + "\n" for r in rows))
    return str(path)


def test_rows_do_not_depend_on_selected_columns(spark, tmp_path):
    path = lines(tmp_path, "a.bedGraph", [
        ["track type=bedGraph"], ["# note"], ["chr1", 0, 10, 1.5], ["chr1", 10, 20, 2], ["chr1", 20, 30, 3, "extra"], ["chr1", "x", 40, 4],
        ["chr1", 40, 50], [], ["chr2", 0, 5, ""],
    ])
    df = readers.read_bedgraph(spark, path)
    assert df.count() == 3 == len(df.collect()) == len(df.select("chrom").collect()) == len(df.select("value").collect())
    lost = {r.fault: r.n_lines for r in readers.lost_lines(spark, path, readers.BEDGRAPH).collect()}
    assert lost == {"columns": 3, "number": 1}


def test_short_pairs_are_lost_and_long_ones_read(spark, tmp_path):
    good = ["r", "chr1", 5, "chr2", 9, "+", "-", "UU", 60, 50]
    path = lines(tmp_path, "p.pairs", [["#chromsize: chr1 100"], good, good[:-1], [*good, "more"], [*good, "and", "more"], [*good[:8], "q", 1]])
    assert [tuple(r) for r in readers.read_pairs(spark, path).collect()] == [("chr1", 4, "+", 60, "chr2", 8, 50)] * 3
    assert {r.fault: r.n_lines for r in readers.lost_lines(spark, path, readers.PAIRS).collect()} == {"columns": 1, "number": 1}


def test_lost_lines_of_beds_and_count_tables(spark, tmp_path):
    bed = lines(tmp_path, "SAMP_CELL.bed", [["chr1", 5, 9, "n", 0, "+"], ["chr1", 6, 9, "n", 0, "-", 1, 2, "0,0,0"], ["chr1", "x", 9, "n", 0, "+"], ["chr1", 5]])
    assert [(r.start_pos, r.strand) for r in readers.read_prepared_peaks(spark, bed).orderBy("start_pos").collect()] == [(5, "+"), (6, "-")]
    assert {r.fault: r.n_lines for r in readers.lost_lines(spark, bed, readers.BED6).collect()} == {"columns": 1, "number": 1}
    counts = lines(tmp_path, "lib0.sense.txt", [
        ["# made by"], ["Geneid", "Chr", "Start", "End", "Strand", "Length", "lib0.bam"], ["7", "chr1", "1", "9", "+", "9", "4"],
        ["8", "chr1;chr1", "1;20", "9;30", "+;+", "20", "5"], ["9", "chr1", "1", "9", "+", "9", "many"],
    ])
    assert {tuple(r) for r in readers.read_count_tables(spark, counts).collect()} == {("lib0", "sense", "7", 4.0), ("lib0", "sense", "8", 5.0)}
    assert {r.fault: r.n_lines for r in readers.lost_lines(spark, counts, readers.COUNTS).collect()} == {"number": 2}


def test_many_classes_can_be_kept(spark):
    classes = spark.range(300).select(F.col("id").alias("fid"), F.concat(F.lit("c"), "id").alias("class"))
    features = spark.range(300).withColumnRenamed("id", "fid")
    assert [r.fid for r in hosts.keep_classes(features, classes, ["c250"]).collect()] == [250]
    with pytest.raises(ValueError, match="nope"):
        hosts.keep_classes(features, classes, ["c1", "nope"])


def test_every_anchor_and_promoter_counts(spark):
    anchors = spark.range(40).selectExpr("id as fid", "'f' as family", "'s' as subfamily", "'chr1' as chrom", "5L as bin")
    starts = spark.range(60).selectExpr("'chr1' as chrom", "id as bin")
    assert matrix.band_pairs(anchors, starts, 1, 20).count() == 40 * (5 + 20)
    assert matrix.band_pairs(anchors, starts, 1, 20, 3).count() == 40 * 3


def test_draws_differ_between_moving_sets(spark):
    offset = peaks.hashed_offset(3)
    df = spark.createDataFrame([("cell", s, c, g) for s in "ab" for c in ("chr1", "chr2") for g in (1, 2)], "cell string, sample string, chrom string, gene long")
    draws = df.select("*", *[
        offset(F.lit(k), F.lit(10_000_000), *map(F.col, key)).alias(f"o{k}_{'_'.join(key)}") for k in range(3)
        for key in (("cell", "sample"), ("chrom",), ("gene", "sample"))
    ]).collect()
    for key in (("cell", "sample"), ("chrom",), ("gene", "sample")):
        own = {tuple(r[c] for c in key): tuple(r[f"o{k}_{'_'.join(key)}"] for k in range(3)) for r in draws}
        assert len(set(own.values())) == len(own) > 1


def test_fragments_over_several_copies(spark):
    features = spark.createDataFrame([(1, "chr1", 100, 200, "+"), (2, "chr1", 180, 300, "+"), (3, "chr1", 500, 600, "-")],
                                     "fid long, chrom string, start_pos long, end_pos long, strand string")
    rows = [("s", 1, 90, 101, "+"), ("s", 1, 150, 160, "+"), ("s", 2, 150, 190, "+"), ("s", 3, 110, 120, "+"), ("s", 3, 250, 260, "+"),
            ("s", 4, 599, 700, "+"), ("s", 5, 600, 700, "+"), ("t", 1, 299, 310, "-")]
    aligned = spark.createDataFrame([(*r[:2], "chr1", *r[2:]) for r in rows], "sample string, frag long, chrom string, start_pos long, end_pos long, strand string")
    got = {tuple(r) for r in reads.count_reads(features, aligned).collect()}
    assert got == {("s", "sense", 1, 1), ("s", "antisense", 3, 1), ("t", "antisense", 2, 1)}
    both = {tuple(r) for r in reads.count_reads(features, aligned, multi="all").collect()}
    assert both == {("s", "sense", 1, 3), ("s", "sense", 2, 2), ("s", "antisense", 3, 1), ("t", "antisense", 2, 1)}
    genes = features.withColumnRenamed("fid", "gene_id")
    verdicts = {r["sample"]: (r.s1, r.s2) for r in reads.strandedness(genes, aligned).collect()}
    assert verdicts == {"s": (1, 1), "t": (0, 1)}


def test_budget_is_checked_and_rows_are_ordered(spark):
    span = "chrom string, start_pos long, end_pos long, strand string"
    features = spark.createDataFrame(
        [(i, "chr1", 1000 * i, 1000 * i + 300, "+", f"s{i % 3}", "f") for i in range(60)], f"fid long, {span}, subfamily string, family string")
    rows = [("c", f"S{i % 4}", "chr1", 1000 * (i * 7 % 60) + 50 * (i % 9), 1000 * (i * 7 % 60) + 50 * (i % 9) + 40, "+") for i in range(90)]
    found = spark.createDataFrame(rows, f"cell_line string, sample string, {span}")
    every = lambda t: t.where("loci > 0")
    with pytest.raises(ValueError, match="permutations cannot resolve"):
        peaks.permutation_analysis(features, found, 10, candidate=every)
    out = peaks.permutation_analysis(features, found, 40, 0.9, every, batch=20).collect()
    assert len(out) > 4
    keys = [(r.cell_line, r.p_perm, -r.fold_pooled) for r in out]
    assert keys == sorted(keys) and all(r.significant == (r.q_perm < 0.9) for r in out)


def test_far_tail_of_the_hypergeometric(spark):
    from fractions import Fraction
    from math import comb, log10

    cases = [(40, 1000, 60, 200), (5, 100000, 10, 20000), (150, 5000, 300, 1000), (3, 50, 5, 10), (0, 50, 5, 10), (11, 100, 10, 50), (120, 400, 200, 200)]
    df = spark.createDataFrame(cases, "a long, m long, c long, n long")
    got = {tuple(r)[:4]: r.p for r in df.select("*", sp.hypergeom_upper("a", "m", "c", "n").alias("p")).collect()}
    for a, m, c, n in cases:
        want = sum(Fraction(comb(c, k) * comb(m - c, n - k), comb(m, n)) for k in range(a, min(c, n) + 1))
        if want:
            assert log10(got[a, m, c, n]) == pytest.approx(log10(want), abs=1e-7)
        else:
            assert got[a, m, c, n] == 0


def test_overlaps_with_and_without_split_tiles(spark):
    a = spark.range(500).selectExpr("'chr1' as chrom", "id as x", "id % 50 as start_pos", "id % 50 + 3 as end_pos")
    b = spark.range(200).selectExpr("'chr1' as chrom", "id as y", "id % 40 as r_start", "id % 40 + 2 as r_end")
    plain = {(r.x, r.y) for r in iv.overlap_join(a, b).collect()}
    assert plain == {(r.x, r.y) for r in iv.overlap_join(a, b, hot_rows=50).collect()}
    assert len(plain) == sum(x % 50 < y % 40 + 2 and y % 40 < x % 50 + 3 for x in range(500) for y in range(200))


def test_staged_files_go(spark):
    from locusmill.session import clear_staged, staged, staged_paths

    first = len(staged_paths())
    out = staged(spark.range(10))
    path = staged_paths()[-1]
    assert out.count() == 10 and spark.read.parquet(path).count() == 10
    assert clear_staged(spark, first) == 1 and len(staged_paths()) == first
    with pytest.raises(Exception, match="(?i)path does not exist|PATH_NOT_FOUND"):
        spark.read.parquet(path).count()


def test_resolutions(spark):
    table = spark.createDataFrame([(5000, 1), (10000, 2), (10000, 3)], "resolution int, n int")
    assert sorted(r.n for r in matrix.at_resolution(table, 10000).collect()) == [2, 3]
    with pytest.raises(ValueError, match="5000, 10000"):
        matrix.at_resolution(table, 7)


ALIGNED = "sample string, frag string, read int, chrom string, start_pos long, end_pos long, strand string"


def test_mates_on_opposite_strands_are_one_fragment(spark):
    features = spark.createDataFrame([(1, "chr1", 0, 400, "+")], "fid long, chrom string, start_pos long, end_pos long, strand string")
    rows = [("s", "a", 1, 10, 60, "+"), ("s", "a", 2, 40, 90, "-"), ("s", "b", 1, 200, 250, "-"), ("s", "b", 2, 120, 170, "+"),
            ("s", "c", 1, 300, 320, "+"), ("s", "c", 1, 360, 380, "+"), ("s", "d", None, 300, 320, "-")]
    aligned = spark.createDataFrame([(*r[:3], "chr1", *r[3:]) for r in rows], ALIGNED)
    got = {tuple(r) for r in reads.fragments(aligned).select("frag", "strand", "start_pos", "end_pos").collect()}
    assert got == {("a", "+", 10, 90), ("b", "-", 200, 250), ("b", "-", 120, 170), ("c", "+", 300, 320), ("c", "+", 360, 380), ("d", "-", 300, 320)}
    counts = {(r.orientation, r.n) for r in reads.count_reads(features, aligned).collect()}
    assert counts == {("sense", 2), ("antisense", 2)}


def test_a_stranded_library_is_seen_as_such(spark):
    genes = spark.createDataFrame([(1, "chr1", 0, 1000, "+"), (2, "chr1", 2000, 3000, "-")],
                                  "gene_id long, chrom string, start_pos long, end_pos long, strand string")
    rows = []
    for k in range(60):
        start, strand = (10 * k, "+") if k % 2 else (2000 + 10 * k, "-")
        other = "-" if strand == "+" else "+"
        rows += [("fr", f"p{k}", 1, "chr1", start, start + 50, strand), ("fr", f"p{k}", 2, "chr1", start + 100, start + 150, other)]
        rows += [("rf", f"p{k}", 1, "chr1", start, start + 50, other), ("rf", f"p{k}", 2, "chr1", start + 100, start + 150, strand)]
    got = {r["sample"]: (r.s1, r.s2, r.verdict) for r in reads.strandedness(genes, spark.createDataFrame(rows, ALIGNED)).collect()}
    assert got == {"fr": (60, 0, "setting 1"), "rf": (0, 60, "setting 2")}


def test_sam_blocks(spark, tmp_path):
    path = lines(tmp_path, "libA.sam", [
        ["@HD", "VN:1.6"], ["@SQ", "SN:chr1", "LN:1000"],
        ["q1", 99, "chr1", 11, 60, "10M5N3M2D4M", "=", 60, 80, "*", "*", "NH:i:2", "HI:i:2"], ["q1", 147, "chr1", 61, 60, "4S6M1I2M", "=", 11, -80, "*", "*"],
        ["q2", 16, "chr1", 5, 0, "5=5X"], ["q3", 4, "*", 0, 0, "*", "*"], ["q4", "x", "chr1", 5, 0, "5M"], ["q5", 0, "chr1"],
    ])
    got = {tuple(r) for r in readers.read_sam(spark, path).collect()}
    assert got == {("libA", "q1:2", 1, "chr1", 10, 20, "+", 60), ("libA", "q1:2", 1, "chr1", 25, 34, "+", 60),
                   ("libA", "q1:0", 2, "chr1", 60, 68, "-", 60), ("libA", "q2:0", 1, "chr1", 4, 14, "-", 0)}
    assert {r.fault: r.n_lines for r in readers.lost_lines(spark, path, readers.SAM).collect()} == {"columns": 1, "number": 1}
