"""Product codes of vectors by Lloyd's rounds in which parts stay with the entry that owns them.

A vector's components become whole numbers (floor(256 x)) and are cut into PARTS parts. Every part is a row, resident at
its owner (position, entry, salt); the salt spreads an entry that many parts choose. Rounds go like this:

1. Owners add up their resident members: partial sums where the rows lie, then one row for each (position, entry). The
   entries become the floors of the means; entries nobody chose stay.
2. Residents are held against the new codebook of their position where they lie. Those whose nearest entry is the same
   stay; only the others are shuffled, to their new owners.

What a round leaves is written out, so a lost executor repeats one round at most. A codebook has ``entries`` entries at
each position, whatever the number of vectors, and is all that goes through the driver.

Cases: a null vector, or one with a null, NaN or infinite component is left out; an empty vector has empty parts, code
zeros and error 0. Vectors of different lengths are filled up with zeros to the longest, a length that PARTS does not
divide likewise. Components are held within -LIMIT .. LIMIT after scaling (65,536 before), so sums of squares stay exact.
Of equal distances the lower entry is nearest. First entries are those of the smallest ids, null ids last, equal ids in
order of their vectors; with fewer vectors than entries there are as many entries as vectors. Rows that repeat an id or
are equal are coded each; null labels are one label; a label's error beyond 64 bits is null; an empty table gives no rows;
columns other than id, vector and label are left out, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import staged

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 24
#: Parts that an owner holds on average, where all vectors choose one entry.
OWNED = 1024
Books = np.ndarray  # position x entry x component

_STATE = "row long, position int, entry int, salt long, part binary, distance long, moved boolean"


def whole_numbers(vector: str | Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, within -LIMIT .. LIMIT; null where a component is null or not finite."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    vector = vector.cast("array<double>")
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    held = F.transform(
        vector, lambda x: F.floor(F.least(F.greatest(x * float(scale), F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("int")
    )
    return F.when(finite, held)


def _vectors(df: DataFrame, vector: str, vec_id: str, label: str, parts: int, scale: int) -> tuple[DataFrame, int]:
    """row, vec_id, label and numbers (of one length that ``parts`` divides), written out; and that length."""
    kept = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), whole_numbers(vector, scale).alias("numbers"))
    kept = staged(kept.where("numbers is not null").withColumn("row", F.monotonically_increasing_id()))
    longest = kept.agg(F.max(F.size("numbers"))).first()[0] or 0
    length = -(-longest // parts) * parts
    zeros = F.array_repeat(F.lit(0), F.lit(length) - F.size("numbers"))
    return kept.withColumn("numbers", F.concat("numbers", zeros)), length


def _first_books(vectors: DataFrame, entries: int, parts: int, length: int) -> Books:
    """The parts of the vectors of the smallest ids; at most ``entries`` rows come to the driver."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "numbers").limit(entries).select("numbers").collect()
    flat = np.array([r.numbers for r in rows], np.int64).reshape(len(rows), parts, length // parts)
    return np.ascontiguousarray(flat.transpose(1, 0, 2))


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest entry (the lower of equal ones) and its squared distance, exactly."""
    out = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    if not points.shape[1]:
        return out
    top = max(int(np.abs(points).max(initial=0)), int(np.abs(book).max(initial=0)))
    # Whole numbers are exact in doubles below 2^53; beyond it the products are whole numbers of 64 bits.
    kind = np.float64 if 4 * top * top * points.shape[1] < 1 << 53 else np.int64
    book = book.astype(kind)
    own = (book * book).sum(axis=1)
    for start in range(0, len(points), 1 << 14):
        x = points[start:start + (1 << 14)].astype(kind)
        d = own - 2 * (x @ book.T)
        best = d.argmin(axis=1)
        out[0][start:start + len(x)] = best
        out[1][start:start + len(x)] = d[np.arange(len(x)), best] + (x * x).sum(axis=1)
    return out


def _column(part: pa.RecordBatch, name: str) -> pa.Array:
    return part.column(part.schema.get_field_index(name))


def _blobs(numbers: np.ndarray) -> pa.Array:
    """Rows of numbers as binary values."""
    n, width = numbers.shape
    offsets = np.arange(n + 1, dtype=np.int64) * width * 4
    data = np.ascontiguousarray(numbers.astype("<i4"))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def _numbers(blobs: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), "<i4").reshape(len(blobs), width).astype(np.int64)


def _batch(row, position, entry, salt, part, distance, moved) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(row), pa.array(position.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(salt), part,
         pa.array(distance), pa.array(moved)],
        names=["row", "position", "entry", "salt", "part", "distance", "moved"],
    )


def _placed(vectors: DataFrame, books: Books, salts: int) -> DataFrame:
    """Every part of every vector with its nearest entry of the first codebooks."""
    parts, _, width = books.shape

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            row = _column(batch, "row").to_numpy()
            flat = _column(batch, "numbers").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(row), parts, width)
            for p in range(parts):
                entry, distance = nearest(flat[:, p], books[p])
                yield _batch(row, np.full(len(row), p), entry, row % salts, _blobs(flat[:, p]), distance, np.ones(len(row), bool))

    return vectors.select("row", "numbers").mapInArrow(run, _STATE)


def _held(state: DataFrame, books: Books) -> DataFrame:
    """The residents against new codebooks: entry, distance, and whether the entry is another one."""
    width = books.shape[2]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            position, before = (_column(batch, c).to_numpy() for c in ("position", "entry"))
            points = _numbers(_column(batch, "part"), width)
            entry, distance = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
            for p in np.unique(position):
                at = np.flatnonzero(position == p)
                entry[at], distance[at] = nearest(points[at], books[p])
            row, salt = (_column(batch, c).to_numpy() for c in ("row", "salt"))
            yield _batch(row, position, entry, salt, _column(batch, "part"), distance, entry != before)

    return state.mapInArrow(run, _STATE)


def _means(state: DataFrame, books: Books) -> Books:
    """Codebooks of the floors of the residents' means; sums are formed where the residents lie."""
    width = books.shape[2]
    schema = "position int, entry int, n long, sums array<long>"

    def run(batches):
        # One row for each (position, entry) of a partition: at most as many as the codebooks have.
        sums = np.zeros(books.shape, np.int64)
        counts = np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            at = tuple(_column(batch, c).to_numpy() for c in ("position", "entry"))
            np.add.at(sums, at, _numbers(_column(batch, "part"), width))
            np.add.at(counts, at, 1)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]),
             pa.array(list(sums[p, e]), type=pa.list_(pa.int64()))], names=["position", "entry", "n", "sums"],
        )

    partial = state.select("position", "entry", "part").mapInArrow(run, schema)
    each = partial.select("position", "entry", "n", F.posexplode("sums").alias("k", "x"))
    total = each.groupBy("position", "entry", "k").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    out = books.copy()
    for r in total.collect():  # at most one row for each component of the codebooks
        out[r.position, r.entry, r.k] = int(r.x) // r.n
    return out


def _coded(state: DataFrame, parts: int) -> DataFrame:
    """row, code (two hex digits a part) and error: sums of shifted entries, eight parts in a number."""
    sums = []
    for k in range(0, parts, 8):
        after = min(k + 8, parts)
        digit = f"shiftleft(cast(entry as long), 8 * ({after - 1} - position))"
        sums.append(F.expr(f"bit_or(if(position >= {k} and position < {after}, {digit}, 0L))").alias(f"c{k}"))
    rows = state.select("row", "position", "entry", "distance").groupBy("row").agg(*sums, F.sum("distance").alias("error"))
    code = F.concat(*[F.lpad(F.lower(F.hex(f"c{k}")), 2 * min(8, parts - k), "0") for k in range(0, parts, 8)])
    return rows.select("row", code.alias("code"), "error")


def _with_label_errors(coded: DataFrame) -> DataFrame:
    """label_error beside every row. Labels of more than a 1,024th of the rows, 1,024 at most, are broadcast; rows of
    others meet their label's total in a shuffle that those leave out."""
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    totals = staged(coded.groupBy("label").agg(total.try_cast("long").alias("label_error"), F.count(F.lit(1)).alias("n")))
    n = totals.agg(F.sum("n")).first()[0] or 0
    hot, cold = totals.where(F.col("n") * 1024 > n), totals.where(F.col("n") * 1024 <= n)
    large = coded.join(F.broadcast(hot.select(F.col("label").alias("_l"), "label_error")), F.col("label").eqNullSafe(F.col("_l")))
    small = coded.join(F.broadcast(hot.select(F.col("label").alias("_l"))), F.col("label").eqNullSafe(F.col("_l")), "left_anti")
    small = small.join(cold.select(F.col("label").alias("_l"), "label_error"), F.col("label").eqNullSafe(F.col("_l")))
    return large.drop("_l").unionByName(small.drop("_l"))


def compress(
    df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, Books]:
    """(vec_id, label, code, error and label_error of every kept vector; the codebooks: position x entry x component).

    A code has two hex digits a part, so there are at most 256 entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("between 1 and 256 entries")
    vectors, length = _vectors(df, vector, vec_id, label, parts, scale)
    books = _first_books(vectors, entries, parts, length)
    if not books.shape[1]:
        empty = vectors.where("false").select(
            "vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")
        )
        return empty, books
    salts = max(1, vectors.count() // OWNED)
    owner = ["position", "entry", "salt"]
    state = staged(_placed(vectors, books, salts).repartition(*owner))
    for k in range(rounds):
        books = _means(state, books)
        held = _held(state, books)
        if k + 1 < rounds:
            stay, move = held.where("not moved"), held.where("moved").repartition(*owner)
            state = staged(stay.unionByName(move))
        else:
            state = held
    if not rounds:
        state = _held(state, books)
    coded = vectors.select("row", "vec_id", "label").join(_coded(state, parts), "row")
    return _with_label_errors(staged(coded.select("vec_id", "label", "code", "error"))), books


def codebooks_sha256(books: Books) -> str:
    """Digest of all components by position, entry and place, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
