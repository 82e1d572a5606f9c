"""Sinks. Tables stay in Parquet; text forms are exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.intervals import to_one_based


def write_tsv(df: DataFrame, path: str, formats: dict[str, str] | None = None) -> None:
    """Tab-separated with a header; listed columns go through their number format."""
    formats = formats or {}
    cols = [F.format_string(formats[c], F.col(c)).alias(c) if c in formats else F.col(c) for c in df.columns]
    df.select(*cols).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet, optionally in folders by the given columns."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _text(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("quote", "\u0000").option("escapeQuotes", "false").csv(path)


def write_bed(df: DataFrame, path: str, name: str = "name", split_by: str | None = None) -> None:
    """BED6; with ``split_by`` one folder per value of that column."""
    cols = ["chrom", "start_pos", "end_pos", F.col(name).alias("name"), F.lit(".").alias("score"), "strand"]
    if split_by is None:
        _text(df.select(*cols), path)
        return
    rows = df.select(*cols, F.col(split_by).alias("file"))
    rows.write.mode("overwrite").option("sep", "\t").partitionBy("file").csv(path)


def write_gtf(elements: DataFrame, path: str) -> None:
    """Nine-column element GTF with pipe-packed attributes and 1-based starts."""
    parts = (("gene_id", "gene_id"), ("subfamily_id", "subfamily"), ("class_id", "rep_class"), ("family_id", "rep_family"))
    packed = F.concat_ws("|", *[c for key, col in parts for c in (F.lit(key), F.col(col).cast("string"))], F.lit(""))
    _text(elements.select(
        "chrom", F.lit("rmsk").alias("source"), F.lit("exon").alias("feature"), to_one_based("start_pos").alias("s"),
        "end_pos", F.lit("0").alias("score"), "strand", F.lit("0").alias("frame"), packed.alias("attributes"),
    ), path)


def write_count_annotation(elements: DataFrame, root: str) -> None:
    """Sense and strand-flipped annotation plus the copy key, from one pass over the elements."""
    kept = elements.select(
        F.col("fid").cast("string").alias("GeneID"), F.col("chrom").alias("Chr"), to_one_based("start_pos").alias("Start"),
        F.col("end_pos").alias("End"), F.col("strand").alias("Strand"), "subfamily", "family",
    ).persist()
    try:
        base = ["GeneID", "Chr", "Start", "End"]
        flipped = F.when(F.col("Strand") == "+", "-").otherwise("+").alias("Strand")
        write_tsv(kept.select(*base, "Strand"), f"{root}/sense")
        write_tsv(kept.select(*base, flipped), f"{root}/antisense")
        key = kept.select(
            F.col("GeneID").alias("gene_id"), "subfamily", "family", F.col("Chr").alias("chrom"),
            F.col("Start").alias("start"), F.col("End").alias("end"), F.col("Strand").alias("strand"),
        )
        write_tsv(key, f"{root}/key")
    finally:
        kept.unpersist()


def write_sorted_shards(df: DataFrame, path: str, chrom: str = "chrom", pos: str = "pos", block: int = 1 << 24) -> None:
    """Parquet per chromosome with position-sorted files; a chromosome is split into position blocks."""
    spread = df.withColumn("__b", F.floor(F.col(pos) / block).cast("long"))
    ordered = spread.repartition(chrom, "__b").sortWithinPartitions(chrom, pos)
    ordered.drop("__b").write.mode("overwrite").partitionBy(chrom).parquet(path)


def write_split_results(table: DataFrame, significant: DataFrame, root: str, by: str = "cell_line") -> None:
    """Results in one folder per cell line, and the significant rows together."""
    write_table(table, f"{root}/all", [by])
    write_table(significant, f"{root}/significant")


def write_tallies(tallies: DataFrame, path: str, klass: str, min_mapq: int = 0, tag: str = "") -> None:
    """Statistic-independent tallies under (class, quality floor, tag), so any ratio is a re-read."""
    keyed = tallies.withColumns({"class": F.lit(klass), "min_mapq": F.lit(min_mapq), "tag": F.lit(tag or "-")})
    (keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("class", "min_mapq", "tag").parquet(path))
