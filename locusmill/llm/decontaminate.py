"""Benchmark decontamination by word windows.

The windows of the test items are a broadcast hash set. A document's words become numbers of the items' vocabulary (or
none); windows of known words alone are hashed, looked up, and each hit is verified word by word.

The broadcast is bounded: items are dealt into blocks of about ``block_chars`` characters, and each block is a scan of
its own over the same rows, without a shuffle; hits of several blocks are united per row.

Cases: null and empty texts have no words, are never hit and hit nothing; a text is scanned whole, however long; rows
and items that repeat count like any other, but an item id is listed once per document; an item with a null id marks
words and is not listed; empty tables give no rows or no hits; columns not in ``keep`` are left out.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .arrow import map_slices, texts

#: ASCII letters lower-cased; every other ASCII byte but digits is a space.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)

_PAIR = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
FOUND = StructType([
    StructField("n_words", LongType()),
    StructField("n_hit", LongType()),
    StructField("items", ArrayType(StringType())),
    StructField("runs", _PAIR),
    StructField("spans", _PAIR),
])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


class Windows:
    """The windows of some items, by length: 64-bit hashes to look up and words to verify."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.exact: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            words = words_of(text)
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            size = min(n, len(ids))
            for p in range(len(ids) - size + 1 if size else 0):
                self.exact.setdefault(tuple(ids[p:p + size]), set()).update([] if name is None else [name])
        by_size: dict[int, list[tuple[int, ...]]] = {}
        for window in self.exact:
            by_size.setdefault(len(window), []).append(window)
        self.hashes = {
            size: np.unique(self._hash(np.array(ws, np.int64).T)) for size, ws in sorted(by_size.items())
        }

    @staticmethod
    def _hash(columns) -> np.ndarray:
        total = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            total = total * _MUL + c.astype(np.uint64) + np.uint64(1)
        return total

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit windows as (first word, word after) and the items that have them."""
        found, items = [], set()
        n = len(words)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, n)
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        for size, hashes in self.hashes.items():
            if n < size:
                break
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(at):
                continue
            got = self._hash([ids[at + k] for k in range(size)])
            place = np.minimum(np.searchsorted(hashes, got), len(hashes) - 1)
            for p in at[hashes[place] == got].tolist():
                names = self.exact.get(tuple(ids[p:p + size].tolist()))
                if names is not None:
                    found.append((p, p + size))
                    items |= names
        return found, items


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _byte_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    places = [m.span() for m in _WORD.finditer(text.translate(_PLAIN))]
    return [(places[a][0], places[b - 1][1]) for a, b in runs]


def _pairs(lists: list[list[tuple[int, int]]]) -> list:
    return [[{"start": a, "end": b} for a, b in x] for x in lists]


def scan(
    docs: DataFrame,
    bench: DataFrame,
    n: int = 13,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    block_chars: int = 2_000_000,
) -> DataFrame:
    """``keep`` beside n_words, n_hit, items (sorted ids), runs (hit words) and spans (hit bytes) of every document."""
    items = bench.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("t"))
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    out = docs.select(*dict.fromkeys([*keep, text]))
    for b in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b)
        got = [(r["id"], (r["t"] or "").encode()) for r in block.collect()]
        out = _pass(out, got, n, text, keep, first=b == 0, last=b == blocks - 1)
    return out


def _pass(
    df: DataFrame, items: list[tuple[str | None, bytes]], n: int, text: str, keep: tuple[str, ...], first: bool, last: bool
) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(Windows(items, n))

    def run(part: pa.RecordBatch) -> list:
        look = shared.value
        before = [None] * part.num_rows if first else part.select(["items", "runs"]).to_pylist()
        sizes, names, runs, spans = [], [], [], []
        for raw, old in zip(texts(part, text), before):
            words = words_of(raw)
            found, listed = look.scan(words)
            if old is not None:
                found += [(x["start"], x["end"]) for x in old["runs"]]
                listed = listed.union(old["items"])
            whole = united(found)
            sizes.append(len(words))
            names.append(sorted(listed))
            runs.append(whole)
            spans.append(_byte_spans(raw, whole) if last and whole else [])
        return [sizes, [sum(b - a for a, b in x) for x in runs], names, _pairs(runs), _pairs(spans)]

    carried = [*keep] if last else list(dict.fromkeys([*keep, text]))
    return map_slices(df, run, FOUND, text, carried)


def contaminated(n_hit="n_hit", n_words="n_words", one_in: int = 20):
    """True where hit words are at least one in ``one_in`` of a document's words."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * one_in >= F.col(n_words))


def without_spans(text: str, spans: str):
    """The text without its hit bytes."""
    whole = F.col(text).cast("binary")
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(text)))
    kept = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda p: F.substring(whole, p["a"] + 1, p["b"] - p["a"]))
    return F.when(F.size(spans) == 0, F.col(text)).otherwise(F.concat_ws("", F.transform(kept, lambda x: x.cast("string"))))
