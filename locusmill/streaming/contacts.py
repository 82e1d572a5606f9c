"""Contact tallies over a growing folder. The batch and the stream path share one function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.intervals import distance_class, orientation
from ..session import delete


def tally_contacts(contacts: DataFrame, copies: DataFrame, min_mapq: int = 0, inverted: bool = True) -> DataFrame:
    """Counts per (subfamily, orientation, distance class) of contacts that name their copy.

    Quality floor, class and orientation are row expressions; the copy dictionary is a static equi-join.
    """
    named = contacts.where(F.col("mapq") >= min_mapq).join(copies.select("fid", "subfamily", "strand"), "fid")
    rows = named.select(
        "subfamily", orientation("rna_strand", "strand", inverted).alias("orientation"),
        distance_class("rna_chrom", "rna_pos", "dna_chrom", "dna_pos").alias("dclass"),
    )
    return rows.groupBy("subfamily", "orientation", "dclass").agg(F.count(F.lit(1)).alias("n"))


def stream_contacts(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """The folder's Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _versions(spark: SparkSession, out: str) -> list[str]:
    """Finished versions below ``out``, oldest first."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    paths = [f.getPath() for f in files.listStatus(where) if f.isDirectory()]
    done = [p.toString() for p in paths if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(done, key=lambda p: int(p.rsplit("=", 1)[1]))


def _advance(totals: DataFrame, mode: str, out: str, checkpoint: str, kept: int | None) -> None:
    """Work off what has arrived. A batch writes its own folder anew, so one that is replayed changes nothing."""
    spark = totals.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/version={number}")
        for old in _versions(spark, out)[:-kept] if kept else ():
            delete(spark, old)

    query = (
        totals.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_tally(stream: DataFrame, copies: DataFrame, out: str, checkpoint: str, min_mapq: int = 0, inverted: bool = True) -> DataFrame:
    """Work off everything that has arrived since the last call and return the totals of all calls.

    The totals live in the state store below ``checkpoint``, a folder of the caller's; another call with the same folders,
    in this session or a later one, goes on from there. Each batch writes a version below ``out``; the last two stay, so a
    reader of the one before is not cut off.
    """
    spark = copies.sparkSession
    totals = tally_contacts(stream, copies, min_mapq, inverted)
    _advance(totals, "complete", out, checkpoint, 2)
    versions = _versions(spark, out)
    return spark.read.schema(totals.schema).parquet(versions[-1]) if versions else spark.createDataFrame([], totals.schema)


def changed_tallies(stream: DataFrame, copies: DataFrame, out: str, checkpoint: str, min_mapq: int = 0, inverted: bool = True) -> DataFrame:
    """The log of totals that changed: a row for each total and batch (``version``) in which it did, over all calls."""
    spark = copies.sparkSession
    totals = tally_contacts(stream, copies, min_mapq, inverted)
    _advance(totals, "update", out, checkpoint, None)
    versions = _versions(spark, out)
    schema = totals.schema.add("version", "long")
    return spark.read.schema(schema).option("basePath", out).parquet(*versions) if versions else spark.createDataFrame([], schema)


def latest(log: DataFrame) -> DataFrame:
    """The totals that a log of changes comes to."""
    keys = [c for c in log.columns if c not in ("n", "version")]
    return log.groupBy(*keys).agg(F.max_by("n", "version").alias("n"))
