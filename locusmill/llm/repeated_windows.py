"""Exact removal of repeated passages by Rabin-Karp hashes of every window of SIZE words.

Every window of every document gets a rolling hash of its words, in two lanes of 64 bits. A window whose words start
earlier too (in a document of a smaller id, or before it in its own) is repeated; its words go, and overlapping windows
merge into maximal intervals. Windows are judged on the input, so the first of equal windows always stays.

Hashes are counted in Spark in two grains, so that text found once sends few rows:

1. Neighbouring windows whose least run of GRAM word hashes is the same one, their anchor, are a stretch. It is sent as
   one row with its anchor and the Rabin-Karp hash of the whole stretch. Equal windows have equal anchors. All but the
   first of equal stretches are repeated whole; a stretch whose anchor no other stretch has holds no repeated window.
2. Of the rest - the first of each kind of stretch, where an anchor has several kinds - every window's hash is sent.

In both grains a map task sends one row for each hash of a block of texts; the later ones of that block are repeated
whatever other blocks hold. A common passage is thus at most one row per block in a group. Anchors frequent in a sample
of stretches are known to be shared and are not counted, so no common phrase meets in one task; the sample steers only
where rows are counted.

Cases: a null text has no words; a text of fewer than SIZE words is kept; texts are read whole, in blocks; ids are whole
numbers, a null id counts as the least one; windows at the same place (rows that repeat an id, same start) do not come
before each other, so rows that repeat id and text keep the same words; an empty table gives no rows; columns other than
id and text are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..session import staged
from .arrow import map_slices, slices, texts
from .minhash import mixed

SIZE, GRAM = 20, 5
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_random = np.random.default_rng(20240613)
_BYTE = _random.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x5851F42D4C957F2D, 0x9E3779B97F4A7C15)
#: Bytes of text that are hashed at once, and words of one document that are.
_BYTES, _WORDS = 1 << 19, 1 << 18
_LOW = np.uint64(0xFFFFFFFF)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP = [_powers(b, _BYTES + 1) for b in _BASES]
_DOWN = [_powers(pow(b, -1, 1 << 64), _BYTES + 1) for b in _BASES]


def word_hashes(text: bytes) -> np.ndarray:
    """Two lanes of 64-bit hashes of the words, cut by ASCII white space and otherwise unchanged."""
    out, start = [], 0
    while start < len(text):
        stop = min(len(text), start + _BYTES)
        while stop < len(text) and not _GAP[text[stop]]:
            stop += 1
        block = np.frombuffer(text, np.uint8, stop - start, start)
        word = np.concatenate(([False], ~_GAP[block], [False]))
        edge = np.flatnonzero(word[1:] != word[:-1])
        first, after = edge[::2], edge[1::2]
        lanes = np.empty((2, len(first)), np.uint64)
        for lane in range(2):
            up, down = _UP[lane], _DOWN[lane]
            if len(block) > _BYTES:
                up, down = (_powers(b, len(block) + 1) for b in (_BASES[lane], pow(_BASES[lane], -1, 1 << 64)))
            total = np.zeros(len(block) + 1, np.uint64)
            np.cumsum(_BYTE[lane][block] * up[:len(block)], out=total[1:])
            lanes[lane] = mixed((total[after] - total[first]) * down[first] + (after - first).astype(np.uint64))
        out.append(lanes)
        start = stop
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.uint64)


def rolling(words: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers from which the hash of any run of words follows."""
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _UP[lane][:len(words)], out=total[1:])
    return total, _DOWN[lane]


def run_hashes(sums: tuple[np.ndarray, np.ndarray], first: np.ndarray, after: np.ndarray) -> np.ndarray:
    total, down = sums
    return mixed((total[after] - total[first]) * down[first])


def stretches(words: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, ...]:
    """First and last window of every stretch, its anchor and its two hashes; there are at least ``size`` words."""
    n, gram = words.shape[1], min(GRAM, size)
    sums = [rolling(words[lane], lane) for lane in range(2)]
    at = np.arange(n - gram + 1)
    grams = run_hashes(sums[0], at, at + gram)
    key = (mixed(grams) & ~_LOW) | at.astype(np.uint64)
    reach, width, least = size - gram + 1, 1, key
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n - size + 1], least[reach - width:][:n - size + 1])
    place = (least & _LOW).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    low, high = cut, np.concatenate((cut[1:], [len(place)])) - 1
    shape = ((place[low] - low) * size + (high - low)).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    whole = [mixed(run_hashes(s, low, high + size) + shape) for s in sums]
    return low, high, grams[place[low]], whole[0], whole[1]


def _parts(words: np.ndarray, size: int):
    """(offset, words) of one document; longer ones are cut so that every window is whole in exactly one part."""
    n = words.shape[1]
    for start in range(0, n - size + 1, _WORDS - size + 1):
        yield start, words[:, start:start + _WORDS]


def _firsts(h1: np.ndarray, h2: np.ndarray, k2: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which entries are at the first place (k2, at) of their hash in this block."""
    order = np.lexsort((at, k2, h2, h1))
    a, b, k, p = h1[order], h2[order], k2[order], at[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    first = np.empty(len(order), bool)
    first[order] = (k == k[head]) & (p == p[head])
    return first


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """id, text and two columns that know a row: a hash of the text and the id."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("k1"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("k2"),
    )


def _column(part: pa.RecordBatch, name: str) -> np.ndarray:
    return part.column(part.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _table(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _stretch_rows(rows: DataFrame, size: int) -> DataFrame:
    """k1, k2, low and high of every stretch, anchor and hashes, and ``done`` where an earlier one is in the same block."""
    schema = "k1 long, k2 long, low int, high int, anchor long, s1 long, s2 long, done boolean"

    def run(batches):
        for part in slices(batches, "text"):
            keys, found = (_column(part, "k1"), _column(part, "k2")), []
            for i, raw in enumerate(texts(part, "text")):
                for offset, words in _parts(word_hashes(raw), size):
                    low, high, *hashes = stretches(words, size)
                    found.append((np.full(len(low), i), low + offset, high + offset, *hashes))
            if not found:
                continue
            row, low, high, anchor, s1, s2 = (np.concatenate(x) for x in zip(*found))
            k2 = keys[1][row]
            yield _table({
                "k1": keys[0][row], "k2": k2, "low": low.astype(np.int32), "high": high.astype(np.int32),
                "anchor": anchor.view(np.int64), "s1": s1.view(np.int64), "s2": s2.view(np.int64),
                "done": ~_firsts(s1, s2, k2, low),
            })

    return rows.select("text", "k1", "k2").mapInArrow(run, schema)


def _sorted_stretches(rows: DataFrame, size: int) -> DataFrame:
    """k1, k2, low and high of stretches repeated whole (done), and of those whose windows are to be counted (not done)."""
    some = _stretch_rows(rows.where(F.pmod(F.xxhash64("k1", "k2"), F.lit(128)) == 0), size)
    some = staged(some.where("not done").groupBy("anchor").count())
    least = max(8, (some.agg(F.sum("count")).first()[0] or 0) // 10_000)
    hot = some.where(F.col("count") >= least).select("anchor", F.lit(True).alias("hot"))
    found = _stretch_rows(rows, size).join(F.broadcast(hot), "anchor", "left")
    # A stretch that is done goes anywhere; one of a frequent anchor meets its equals only.
    part = F.when(F.col("done"), F.xxhash64("k1", "k2", "low")).when(F.col("hot"), F.xxhash64("anchor", "s1"))
    found = found.withColumn("part", part.otherwise(F.col("anchor"))).repartition("part")
    ranked = found.selectExpr("*", "rank() over (partition by part, s1, s2 order by k2, low) as nth")
    kinds = ranked.selectExpr(
        "k1", "k2", "low", "high", "done or nth > 1 as done", "hot",
        "min(struct(s1, s2)) over (partition by part) <> max(struct(s1, s2)) over (partition by part) as several",
    )
    return kinds.where("done or hot or several").select("k1", "k2", "low", "high", "done")


def _range() -> Column:
    """A range of windows as one number; a stretch has fewer than 256."""
    return (F.col("low").cast("long") * 256 + (F.col("high") - F.col("low"))).alias("range")


def _counted_windows(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """k1, k2, low and high of the windows in the wanted stretches that start earlier too, one by one."""
    ranges = wanted.groupBy("k1", "k2").agg(F.collect_set(_range()).alias("ranges"))
    source = rows.join(ranges, ["k1", "k2"]).select("text", "k1", "k2", "ranges")

    def run(batches):
        for part in slices(batches, "text"):
            keys, found = (_column(part, "k1"), _column(part, "k2")), []
            ranges = part.column(part.schema.get_field_index("ranges")).to_pylist()
            for i, raw in enumerate(texts(part, "text")):
                wanted = np.array(ranges[i], np.int64)
                first, last = wanted // 256, wanted // 256 + wanted % 256
                for offset, words in _parts(word_hashes(raw), size):
                    a = np.maximum(first - offset, 0)
                    b = np.minimum(last - offset, words.shape[1] - size)
                    at = [np.arange(x, y + 1) for x, y in zip(a, b) if x <= y]
                    if not at:
                        continue
                    at = np.concatenate(at)
                    h1, h2 = (run_hashes(rolling(words[lane], lane), at, at + size) for lane in range(2))
                    found.append((np.full(len(at), i), at + offset, h1, h2))
            if not found:
                continue
            row, at, h1, h2 = (np.concatenate(x) for x in zip(*found))
            k2 = keys[1][row]
            done = ~_firsts(h1, h2, k2, at)
            # One that is done goes anywhere.
            h1 = np.where(done, mixed(at.astype(np.uint64) + h1), h1)
            yield _table({
                "k1": keys[0][row], "k2": k2, "low": at.astype(np.int32), "h1": h1.view(np.int64), "h2": h2.view(np.int64),
                "done": done,
            })

    found = source.mapInArrow(run, "k1 long, k2 long, low int, h1 long, h2 long, done boolean")
    ranked = found.selectExpr("k1", "k2", "low", "done", "rank() over (partition by h1, h2, done order by k2, low) as nth")
    return ranked.where("done or nth > 1").select("k1", "k2", "low", F.col("low").alias("high"))


def repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SIZE) -> DataFrame:
    """k1, k2 and ranges of windows that start earlier too: each 256 times the first and how far the last is."""
    rows = _keyed(docs, text, doc_id)
    found = staged(_sorted_stretches(rows, size))
    windows = _counted_windows(rows, found.where("not done"), size)
    ranges = found.where("done").drop("done").unionByName(windows)
    return ranges.groupBy("k1", "k2").agg(F.collect_set(_range()).alias("ranges"))


_SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SIZE) -> DataFrame:
    """doc_id, n_words, spans (maximal removed intervals of words: start, end) and kept (the others, joined by a space)."""
    rows = _keyed(docs, text, doc_id)
    found = rows.join(staged(repeated(docs, text, doc_id, size)), ["k1", "k2"], "left").select("doc_id", "text", "ranges")
    added = StructType([StructField("n_words", LongType()), StructField("spans", _SPANS), StructField("kept", StringType())])

    def run(part: pa.RecordBatch) -> list:
        counts, spans, kept = [], [], []
        ranges = part.column(part.schema.get_field_index("ranges")).to_pylist()
        for raw, own in zip(texts(part, "text"), ranges):
            words = raw.split()
            merged: list[list[int]] = []
            for a, b in sorted((r // 256, r // 256 + r % 256 + size) for r in own or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            left, at = [], 0
            for a, b in merged:
                left += words[at:a]
                at = b
            left += words[at:]
            counts.append(len(words))
            spans.append([{"start": a, "end": b} for a, b in merged])
            kept.append(b" ".join(left).decode())
        return [counts, spans, kept]

    return map_slices(found, run, added, "text", ["doc_id"])
