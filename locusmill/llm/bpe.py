"""Byte-level BPE encoding and decoding.

A piece's bytes are leaves of a segment tree; leaf i holds the rank of the pair that starts at byte i, joined with i, so
that the root is the leftmost pair of the lowest rank. A merge links the live neighbours anew and updates at most three
leaves, each in O(log n): a piece of n bytes takes O(n log n) however long it is.

Cases: a null text is empty; an empty text has no ids and decodes to no bytes; texts of any length are encoded whole;
letters and numbers newer than Unicode 16 are neither, as in tiktoken; repeated rows and ties are rows like any other;
an empty table gives an empty table; other columns are passed only if named in ``keep``, and one named like an output
is replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .arrow import map_slices, slices

NONE = 1 << 62
#: Distinct pieces that a worker remembers, twice: when so many are new, those used since are kept and the others go.
REMEMBERED = 70_000
#: Bytes above which a piece is merged alone and not remembered, and of text whose pieces are merged together.
LONG, CHECKED = 64, 2 << 20
#: Leaves of the trees that are merged in step: these fit into a core's cache.
IN_STEP = 1 << 17
#: Pieces from which those of the texts go from Python to Arrow, which holds them in less memory.
HELD = 1 << 15
#: Letters and numbers newer than Unicode 16, in hexadecimal: tiktoken's patterns do not know them, the regex module's may.
NEWER = """
    0558 058b-058c 088f 0c5c 0cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf
    10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686
    16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 16ff4-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191
    191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2
    1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""


def finder(pattern: str) -> Callable[[str], list[str]]:
    """What lists the pattern's matches in a text, by the letters and numbers of Unicode 16."""
    compiled = regex.compile(pattern)
    ranges = [[chr(int(end, 16)) for end in some.split("-")] for some in NEWER.split()]
    newer = re.compile("[" + "".join(f"{some[0]}-{some[-1]}" for some in ranges) + "]")
    high, find = re.compile(f"[{ranges[0][0]}-{chr(0x10FFFF)}]").search, compiled.findall

    def pieces(text: str) -> list[str]:
        if text.isascii() or not high(text) or not newer.search(text):
            return find(text)
        return [text[m.start():m.end()] for m in compiled.finditer(newer.sub("\uffff", text))]

    return pieces


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and its rank on each line."""
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: its own rank if it is a token, else what merging leaves.

    tree[leaves + i] is the rank of the live pair that starts at byte i, times n, plus i; a node is the lesser of its two
    children, so tree[1] is the lowest rank's leftmost pair.
    """
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    leaves = n - 1
    tree = [NONE] * (2 * leaves)
    for i in range(leaves):
        rank = get(piece[i:i + 2])
        if rank is not None:
            tree[leaves + i] = rank * n + i
    for p in range(leaves - 1, 0, -1):
        left, right = tree[2 * p], tree[2 * p + 1]
        tree[p] = left if left < right else right
    after = list(range(1, n + 2))
    before = list(range(-1, n))
    top = tree[1]
    while top < NONE:
        i = top % n
        gone = after[i]
        end = after[gone]
        after[i] = end
        before[end] = i
        high = low = i + leaves
        if end < n:
            rank = get(piece[i:after[end]])
            tree[low] = NONE if rank is None else rank * n + i
        else:
            tree[low] = NONE
        if gone < leaves:
            high = gone + leaves
            tree[high] = NONE
        if i:
            j = before[i]
            low = j + leaves
            rank = get(piece[j:end])
            tree[low] = NONE if rank is None else rank * n + j
        low >>= 1
        middle = (i + leaves) >> 1
        high >>= 1
        while high:
            left, right = tree[2 * low], tree[2 * low + 1]
            tree[low] = left if left < right else right
            if middle != low:
                left, right = tree[2 * middle], tree[2 * middle + 1]
                tree[middle] = left if left < right else right
            if high != middle:
                left, right = tree[2 * high], tree[2 * high + 1]
                tree[high] = left if left < right else right
            low >>= 1
            middle >>= 1
            high >>= 1
        top = tree[1]
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:after[i]]])
        i = after[i]
    return ids


class Encoder(dict):
    """Text pieces and their ids, filled as they are met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks = ranks
        self.old: dict[str, tuple[int, ...]] = {}
        self.find = finder(pattern)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(piece)
        if ids is None:
            ids = tuple(merge_piece(piece.encode(), self.ranks))
        if len(piece) < 64:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.find(text))))


class Pairs:
    """Which two tokens make a third, as a hash table, and the tokens of single bytes and of two bytes.

    A slot holds one key; keys that find theirs taken are in ``more``, sorted, and their slot is marked as ``shared``.
    """

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, ranks: dict[bytes, int]):
        made = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    made[left << 32 | right] = rank
        #: Above all ranks: two neighbours whose union is no token.
        self.absent = max(ranks.values(), default=0) + 1
        bits = max(4, (4 * len(made)).bit_length())
        self.shift = np.uint64(64 - bits)
        keys = np.sort(np.fromiter(made, np.int64, len(made)))
        values = np.fromiter(map(made.__getitem__, keys.tolist()), np.int64, len(made))
        slots, first = np.unique(self._slot(keys), return_index=True)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.made = np.full(1 << bits, self.absent, np.int64)
        self.keys[slots], self.made[slots] = keys[first], values[first]
        late = np.delete(np.arange(len(keys)), first)
        self.more, self.more_made = keys[late], values[late]
        self.shared = np.zeros(1 << bits, bool)
        self.shared[self._slot(self.more)] = True
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        every = self.bytes.astype(np.int64)
        self.first = self.ranks(np.repeat(every, 256), np.tile(every, 256))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * self.FACTOR) >> self.shift).view(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of two neighbours' union, ``absent`` where that is no token or a neighbour is below 0."""
        key = left << 32 | right
        slot = self._slot(key)
        other = self.keys.take(slot) != key
        rank = self.made.take(slot)
        rank[other] = self.absent
        if len(self.more):
            open_ = np.flatnonzero(other & self.shared.take(slot))
            at = np.minimum(np.searchsorted(self.more, key[open_]), len(self.more) - 1)
            same = self.more[at] == key[open_]
            rank[open_[same]] = self.more_made[at[same]]
        return rank


def merge_pieces(pieces: list[bytes], pairs: Pairs) -> list[list[int]]:
    """The ids of many pieces of like length."""
    ids, ends = merge_in_step(pieces, pairs)
    ids, ends = ids.tolist(), ends.tolist()
    return [ids[x:y] for x, y in zip([0, *ends], ends)]


def merge_in_step(pieces: list[bytes], pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """The ids of many pieces of like length, one after another, and where each piece's end, by one segment tree a piece.

    Row by row as in ``merge_piece``: leaf i holds the rank of the pair at byte i, joined with i, and a merge updates the
    paths of the merged pair, of the one before and of the one that is gone; the top three nodes, which these paths share,
    once. All arrays have a row of twice the width for a piece, so that one base leads into each. Tokens are -2 beyond a
    piece's end and where a merge took them away.
    """
    count, width = len(pieces), 2
    while width < max(map(len, pieces)):
        width *= 2
    bits, row = width.bit_length() - 1, 2 * width
    kind = np.int32 if (pairs.absent + 1) * width < 1 << 31 else np.int64
    none = pairs.absent * width
    at = np.arange(width)
    outside = at >= np.array([len(p) for p in pieces])[:, None]
    text = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(count, width)
    part = np.full((count, row), -2, np.int32)
    part[:, :width] = pairs.bytes[text]
    part[:, :width][outside] = -2
    tree = np.full((count, row), none, kind)
    tree[:, width:-1] = pairs.first[text[:, :-1].astype(np.int64) << 8 | text[:, 1:]] * width + at[:-1]
    tree[:, width:-1][outside[:, 1:]] = none
    level = width
    while level > 1:
        tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
        level //= 2
    small = np.int16 if width < 1 << 14 else np.int64
    after = np.tile(np.arange(1, row + 1, dtype=small), count)
    before = np.tile(np.arange(-1, row - 1, dtype=small), count)
    flat, parts = tree.reshape(-1), part.reshape(-1)

    base, top = np.arange(count) * row, tree[:, 1].astype(np.int64)
    while True:
        live = np.flatnonzero(top < none)
        if not len(live):
            break
        if len(live) < len(base):
            base, top = base[live], top[live]
        i, token = top & (width - 1), top >> bits
        own = base + i
        gone = after.take(own).astype(np.int64)
        end = after.take(base + gone).astype(np.int64)
        after[own] = end
        before[base + end] = i
        parts[own] = token
        parts[base + gone] = -2
        # Without a pair before, the last leaf stands for it: no pair starts there.
        j = np.where(i > 0, before.take(own), width - 1)
        left = np.where(i > 0, parts.take(base + j), -2).astype(np.int64)
        right = parts.take(base + end).astype(np.int64)
        rank = pairs.ranks(np.concatenate((token, left)), np.concatenate((right, token)))
        place = np.concatenate((i, j, gone))
        start = np.concatenate((base, base, base))
        leaf = np.full(len(place), none, kind)
        leaf[:len(rank)] = rank * width + place[:len(rank)]
        node = place + width
        flat[start + node] = leaf
        level = width
        while level > 4:
            node >>= 1
            level >>= 1
            child = start + 2 * node
            flat[start + node] = np.minimum(flat.take(child), flat.take(child + 1))
        if width > 2:
            low = np.minimum(flat.take(base + 4), flat.take(base + 5))
            high = np.minimum(flat.take(base + 6), flat.take(base + 7))
        else:
            low, high = flat.take(base + 2), flat.take(base + 3)
        top = np.minimum(low, high).astype(np.int64)
    kept = part > -2
    return part[kept], np.cumsum(kept.sum(axis=1))


def _joined(values: pa.Array, at, ends, by: bytes) -> pa.Array:
    """The values at the places ``at``, those of each list joined by ``by``; a list ends where ``ends`` says."""
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), values.take(at)), pa.scalar(by, values.type))


class Checker:
    """UTF-8 pieces with the ids of each in decimal, joined by commas, and the bytes that those ids decode to."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pairs = ranks, Pairs(ranks)
        self.names = pa.array([b"%d" % i for i in ranks.values()], pa.large_binary())
        self.tokens = pa.array(list(ranks), pa.large_binary())
        self.place = np.full(self.pairs.absent, -1)
        self.place[list(ranks.values())] = np.arange(len(ranks))
        self.ids: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        #: What a piece's ids decode to, where that is not the piece.
        self.decoded: dict[bytes, bytes] = {}
        self.find = finder(pattern)

    def _merged(self, pieces: list[bytes]) -> None:
        """Fill in the pieces that are not known, those of like length at once."""
        by_width: list[list[bytes]] = [[] for _ in range(LONG.bit_length())]
        whole = []
        for piece in pieces:
            if piece in self.ranks:
                whole.append(piece)
            elif len(piece) > LONG:
                ids = merge_piece(piece, self.ranks)
                self._keep([piece], np.array(ids), np.array([len(ids)]))
            else:
                by_width[(len(piece) - 1).bit_length()].append(piece)
        self._keep(whole, np.array([self.ranks[p] for p in whole], np.int64), np.arange(1, len(whole) + 1))
        for bits, some in enumerate(by_width):
            step = IN_STEP >> bits
            for start in range(0, len(some), step):
                part = some[start:start + step]
                self._keep(part, *merge_in_step(part, self.pairs))

    def _keep(self, pieces: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        if len(ids) and ids.min() < 0:
            raise KeyError("a byte has no token")
        at = pa.array(self.place[ids])
        self.ids.update(zip(pieces, _joined(self.names, at, ends, b",").to_pylist()))
        decoded = _joined(self.tokens, at, ends, b"").to_pylist()
        if decoded != pieces:
            self.decoded.update((p, d) for p, d in zip(pieces, decoded) if p != d)

    def check(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """Each text's ids, joined by commas, and what they decode to.

        Python sees each different piece of the texts once; Arrow numbers the pieces and joins what they stand for.
        """
        if len(self.ids) >= REMEMBERED:
            self.old, self.ids = self.ids, {}
        ends, held, arrays = [], [], []
        for text in texts:
            held += self.find(text)
            ends.append(len(held) + sum(map(len, arrays)))
            if len(held) >= HELD:
                arrays.append(pa.array(held, pa.large_string()))
                held = []
        if not (held or arrays):
            return [("", b"")] * len(texts)
        arrays.append(pa.array(held, pa.large_string()))
        del held
        pieces = pa.chunked_array(arrays).dictionary_encode().combine_chunks()
        met = pieces.dictionary.cast(pa.large_binary()).to_pylist()
        new = []
        for piece in met:
            if piece not in self.ids:
                ids = self.old.get(piece)
                if ids is None:
                    new.append(piece)
                else:
                    self.ids[piece] = ids
        self._merged(new)
        ids, decoded = (
            _joined(pa.array(known, pa.large_binary()), pieces.indices, ends, by)
            for known, by in ((list(map(self.ids.__getitem__, met)), b","), ([self.decoded.get(p, p) for p in met], b""))
        )
        for piece in [p for p in met if len(p) > LONG]:
            del self.ids[piece]
        return list(zip(ids.cast(pa.large_string()).to_pylist(), decoded.to_pylist()))


_MADE: dict = {}


def _once(key: tuple, make):
    """One object per worker process and key; the last few are kept."""
    if key not in _MADE:
        if len(_MADE) > 3:
            _MADE.clear()
        _MADE[key] = make()
    return _MADE[key]


def _file(spark: SparkSession, path: str):
    """The rank file, broadcast: its size is the vocabulary's, whatever the documents are."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(
    df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns ``keep`` and the token ids of every whole text, without special tokens."""
    data = _file(df.sparkSession, ranks_path)

    def run(part: pa.RecordBatch) -> list:
        encoder = _once(("encode", hash(data.value), pattern), lambda: Encoder(read_ranks(data.value), pattern))
        found = [encoder.encode(t or "") for t in part.column(part.schema.get_field_index(text)).to_pylist()]
        offsets = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(x) for x in found], out=offsets[1:])
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(offsets[-1]))
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]

    kept = [c for c in keep if c != ids]
    source = df.select(*dict.fromkeys([*kept, text]))
    return map_slices(source, run, StructType([StructField(ids, ArrayType(IntegerType()))]), text, kept)


def encode_checked(
    df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str | None = None
) -> DataFrame:
    """Columns ``keep``, n_tokens and the digests of every whole text's ids and of the bytes they decode to, in one pass.

    The ids are digested as decimal numbers joined by commas; they are a column of their own if it is named by ``ids``.
    """
    data = _file(df.sparkSession, ranks_path)
    added = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    if ids:
        added.append(StructField(ids, ArrayType(IntegerType())))
    made = {f.name for f in added}

    def run(part: pa.RecordBatch) -> list:
        checker = _once(("check", hash(data.value), pattern), lambda: Checker(read_ranks(data.value), pattern))
        counts, listed, decoded, arrays = [], [], [], []
        for own in slices([part], text, CHECKED):
            for joined, back in checker.check([t or "" for t in own.column(own.schema.get_field_index(text)).to_pylist()]):
                counts.append(joined.count(",") + 1 if joined else 0)
                listed.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(back).hexdigest())
                if ids:
                    arrays.append(np.fromstring(joined, np.int32, sep=",") if joined else np.zeros(0, np.int32))
        out = [counts, listed, decoded]
        if ids:
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
        return out

    kept = [c for c in keep if c not in made]
    return map_slices(df.select(*dict.fromkeys([*kept, text])), run, StructType(added), text, kept)


def decode(
    df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns ``keep`` and the bytes that the ids stand for. Null ids decode to no bytes; an unknown id raises."""
    data = _file(df.sparkSession, ranks_path)

    def run(batches):
        for batch in batches:
            tokens = _once(("decode", hash(data.value)), lambda: {i: t for t, i in read_ranks(data.value).items()})
            column = batch.column(batch.schema.get_field_index(ids))
            step = max(1, int(batch.num_rows * (1 << 20) / max(1, len(column.flatten()))))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                found = [
                    b"".join(map(tokens.__getitem__, x or ()))
                    for x in part.column(part.schema.get_field_index(ids)).to_pylist()
                ]
                columns = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], names=[*kept, decoded])

    kept = [c for c in keep if c != decoded]
    source = df.select(*dict.fromkeys([*kept, ids]))
    return source.mapInArrow(run, StructType([source.schema[c] for c in kept] + [StructField(decoded, BinaryType())]))
