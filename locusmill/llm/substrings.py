"""Exact removal of repeated byte strings, by bucket-pointer refinement.

Every position has a bucket: the identifier of the GRAM bytes from it. A bucket of twice the length is refined from the
bucket identifiers of a position and of a later offset, and the identifiers of one length serve the next: 25, 50, 100,
200 bytes. Two positions share a bucket exactly if their bytes are equal (identifiers are 64 bits wide).

A string of 200 bytes is sorted into buckets by its anchor, the least of its 50-byte buckets, leftmost of equal ones; the
anchor depends on nothing but the string's bytes, so equal strings have their anchors at the same place. The strings of
one anchor start at neighbouring positions. Three refinements go on with what is left of the one before:

1. anchors alone in their 50-byte bucket are done: their strings are found nowhere else;
2. anchors whose whole stretch (from their first string's start to their last one's end) is in one bucket with another
   anchor's are done: all their strings are found elsewhere;
3. of the rest, and of one anchor for each stretch of step 2 that shares a 50-byte bucket with them, every string's
   200-byte bucket is counted.

Anchors that are frequent in a sample of documents are known to be shared and skip the count, so that no common passage
meets in one task; the sample steers only where rows are counted.

Cases: a null text has no bytes; texts shorter than 200 bytes are kept; texts are read whole, and a text that repeats a
string in itself loses both; equal rows are copies of each other; null ids are ids; an empty table gives no rows; columns
other than id and text are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from ..session import staged
from .arrow import map_slices, slices, texts
from .minhash import _BYTE, mixed

GRAM, SIZE = 25, 200
ANCHOR = 2 * GRAM
_REACH = SIZE - ANCHOR + 1
_BASE = 0x5851F42D4C957F2D
_C = np.uint64(0x9E3779B97F4A7C15)
_C2 = np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(0xFFFFFFFF)
_BLOCK = 1 << 19
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, _BLOCK), _powers(pow(_BASE, -1, 1 << 64), _BLOCK)


def refined(first: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Identifiers of twice the length from those of a position and of the offset after it."""
    return mixed(first * _C + later)


def gram_buckets(data: np.ndarray) -> np.ndarray:
    """Bucket identifiers of the ANCHOR bytes from every position; data has at most _BLOCK bytes, at least ANCHOR."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _UP[:n], out=total[1:])
    small = (total[GRAM:] - total[:-GRAM]) * _DOWN[:n - GRAM + 1]
    return refined(small[:-GRAM], small[GRAM:])


def string_buckets(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bucket identifiers of the SIZE bytes from the positions ``at``."""
    half = refined(grams[at], grams[at + ANCHOR])
    return refined(half, refined(grams[at + 2 * ANCHOR], grams[at + 3 * ANCHOR]))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For every anchor: first and last start of its strings, its bucket and its stretch's bucket.

    ends[i] is where the document that holds byte i ends; strings that cross it do not count.
    """
    grams = gram_buckets(data)
    key = (mixed(grams) & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    least = key
    while 2 * width <= _REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:len(key) - _REACH + 1], least[_REACH - width:][:len(key) - _REACH + 1])
    at = (least & _LOW).astype(np.int64)
    whole = ends[:len(at)] - np.arange(len(at)) >= SIZE
    owner = np.where(whole, at, -1)
    cut = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    low, high = cut, np.concatenate((cut[1:], [len(owner)])) - 1
    real = owner[low] >= 0
    low, high = low[real], high[real]
    place = owner[low]
    stretch = refined(string_buckets(grams, low), string_buckets(grams, high))
    stretch = refined(stretch, ((place - low) * SIZE + (high - low)).astype(np.uint64) * _C2)
    return low, high, grams[place], stretch


def _parts(raw: list[bytes]) -> list[tuple[int, int, bytes]]:
    """(row, offset, bytes) of documents, longer ones cut so that every string is whole in exactly one part."""
    out = []
    for i, x in enumerate(raw):
        step = _BLOCK - SIZE + 1
        for start in range(0, max(1, len(x) - SIZE + 1), step):
            if len(x) - start >= SIZE:
                out.append((i, start, x[start:start + _BLOCK]))
    return out


def _blocks(parts: list[tuple[int, int, bytes]]):
    """Parts put together up to _BLOCK bytes."""
    held, size = [], 0
    for p in parts:
        if held and size + len(p[2]) > _BLOCK:
            yield held
            held, size = [], 0
        held.append(p)
        size += len(p[2])
    if held:
        yield held


def _joined(block: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's bytes, where each part starts, and each byte's part end."""
    data = np.frombuffer(b"".join(p[2] for p in block), np.uint8)
    sizes = np.array([len(p[2]) for p in block])
    after = np.cumsum(sizes)
    return data, after - sizes, np.repeat(after, sizes)


def _settled(df: DataFrame) -> DataFrame:
    """``df`` written out; Spark removes the shuffle files of the writing query when it ends, as nothing else reads them."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return staged(df)
    finally:
        conf.set(_CLEANUP, before)


def _range(low: str, high: str) -> Column:
    """A range of starts as one number; its ends are at most _REACH apart."""
    return (F.col(low).cast("long") * 256 + (F.col(high) - F.col(low))).alias("range")


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """id, text and two columns that know a row: a hash of the text and the id."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("k1"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("k2"),
    )


def _anchor_rows(rows: DataFrame) -> DataFrame:
    """k1, k2, low, high, gram and stretch of every anchor of every document."""
    schema = "k1 long, k2 long, low int, high int, gram long, stretch long"

    def run(batches):
        for part in slices(batches, "text"):
            raw = texts(part, "text")
            keys = [part.column(part.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("k1", "k2")]
            for block in _blocks(_parts(raw)):
                data, starts, ends = _joined(block)
                low, high, gram, stretch = anchors(data, ends)
                which = np.searchsorted(starts, low, side="right") - 1
                row = np.array([p[0] for p in block])[which]
                shift = np.array([p[1] for p in block])[which] - starts[which]
                columns = [keys[0][row], keys[1][row], (low + shift).astype(np.int32), (high + shift).astype(np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in [*columns, gram.view(np.int64), stretch.view(np.int64)]],
                    names=["k1", "k2", "low", "high", "gram", "stretch"],
                )

    return rows.select("text", "k1", "k2").mapInArrow(run, schema)


def _shared_anchors(rows: DataFrame) -> DataFrame:
    """Anchors that are not alone in their bucket: k1, k2, low, high, done (whole stretch shared) and first (to be counted
    for the others)."""
    some = _anchor_rows(rows.where(F.pmod(F.xxhash64("k1"), F.lit(128)) == 0))
    place = F.struct("k1", "k2", "low", "high")
    some = staged(some.groupBy("gram", "stretch").agg(F.count(F.lit(1)).alias("count"), F.min(place).alias("p")))
    least = max(8, (some.agg(F.sum("count")).first()[0] or 0) // 10_000)
    grams = some.groupBy("gram").agg(F.sum("count").alias("n")).where(F.col("n") >= least).select("gram", F.lit(True).alias("hot"))
    often = some.where(F.col("count") >= least)
    pairs = often.select("gram", "stretch", F.lit(True).alias("known"))
    found = _anchor_rows(rows).join(F.broadcast(grams), "gram", "left").join(F.broadcast(pairs), ["gram", "stretch"], "left")
    # A known anchor is in a part of its own row, so that those of a common passage do not meet.
    part = F.when(F.col("known"), F.xxhash64("gram", "stretch", "k1", "k2", "low"))
    part = part.when(F.col("hot"), F.xxhash64("gram", "stretch")).otherwise(F.col("gram"))
    counted = found.withColumn("part", part).selectExpr(
        "k1", "k2", "low", "high", "hot", "known", "count(1) over (partition by part) as n_gram",
        "count(1) over (partition by part, stretch) as n_stretch",
        "row_number() over (partition by part, stretch order by k1, k2, low) as nth",
    ).where("hot or n_gram > 1")
    return counted.select(
        "k1", "k2", "low", "high", F.expr("known is not null or n_stretch > 1").alias("done"),
        F.expr("known is null and nth = 1 and (hot is not null or n_gram > n_stretch)").alias("first"),
    ).unionByName(often.select("p.*", F.lit(False).alias("done"), F.lit(True).alias("first")))


def _counted_strings(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """k1, k2, low and high of runs of starts, among the wanted anchors' strings, that share their 200-byte bucket."""
    ranges = wanted.groupBy("k1", "k2").agg(F.collect_set(_range("low", "high")).alias("ranges"))
    found = rows.join(ranges, ["k1", "k2"]).select("text", "k1", "k2", "ranges")

    def run(batches):
        for part in slices(batches, "text"):
            raw = texts(part, "text")
            k1, k2, ranges = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("k1", "k2", "ranges"))
            for i, offset, data in _parts(raw):
                grams = None
                cuts = []
                for r in ranges[i]:
                    a, b = max(r // 256 - offset, 0), min(r // 256 + r % 256 - offset, len(data) - SIZE)
                    if a <= b:
                        cuts.append((a, b))
                if not cuts:
                    continue
                grams = gram_buckets(np.frombuffer(data, np.uint8))
                at = np.concatenate([np.arange(a, b + 1) for a, b in cuts])
                bucket = string_buckets(grams, at).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), k1[i])), pa.array(np.full(len(at), k2[i])),
                     pa.array((at + offset).astype(np.int32)), pa.array(bucket)], names=["k1", "k2", "start", "bucket"],
                )

    strings = found.mapInArrow(run, "k1 long, k2 long, start int, bucket long")
    repeated = strings.selectExpr("k1", "k2", "start", "count(1) over (partition by bucket) as n").where("n > 1")
    return repeated.select("k1", "k2", F.col("start").alias("low"), F.col("start").alias("high"))


def repeated_ranges(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """k1, k2 and ranges: starts of strings that are found elsewhere too, each 256 times the first and how far the last is."""
    rows = _keyed(docs, text, doc_id)
    shared = _settled(_shared_anchors(rows))
    strings = _counted_strings(rows, shared.where("not done or first").select("k1", "k2", "low", "high"))
    done = shared.where("done").select("k1", "k2", "low", "high")
    return done.unionByName(strings).groupBy("k1", "k2").agg(F.collect_set(_range("low", "high")).alias("ranges"))


_SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, spans (removed bytes: start, end) and kept (the remaining bytes) of every row."""
    rows = _keyed(docs, text, doc_id)
    found = rows.join(_settled(repeated_ranges(docs, text, doc_id)), ["k1", "k2"], "left").select("doc_id", "text", "ranges")
    added = StructType([StructField("n_bytes", LongType()), StructField("spans", _SPANS), StructField("kept", BinaryType())])

    def run(part: pa.RecordBatch) -> list:
        raw = texts(part, "text")
        spans, kept = [], []
        for data, ranges in zip(raw, part.column(part.schema.get_field_index("ranges")).to_pylist()):
            own: list[list[int]] = []
            for a, b in sorted((r // 256, r // 256 + r % 256 + SIZE) for r in ranges or ()):
                if own and a <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], b)
                else:
                    own.append([a, b])
            left, at = [], 0
            for a, b in own:
                left.append(data[at:a])
                at = b
            left.append(data[at:])
            spans.append([{"start": a, "end": b} for a, b in own])
            kept.append(b"".join(left))
        return [[len(x) for x in raw], spans, kept]

    return map_slices(found, run, added, "text", ["doc_id"])
