"""Cheapest repair of conversations by Knuth's lightest-derivation agenda.

A conversation's rows, by turn, are to have roles ``(s?(ua)+)?`` by their initials (system, user, assistant). Rows are
kept (K, 0), given the role user or assistant (R, 1) or deleted (D, 2); rows without text may be inserted (I, 5). Blank and
duplicate rows must go; a truncated row that stays costs 5 more. An item says that a run of rows leads from one state
(nothing yet, after system, user, assistant) to another. Rows and insertions are deductions on items, two items of
neighbouring runs are a deduction of the run of both, and each has a superior function: costs add up, the edits' initials
(the audit) are joined, and no result comes before an antecedent. So the agenda pops items in order of (cost, audit), each
popped once and for all, until the goal is final. Two audits of an item that cost the same are never one the beginning of
the other (the rest would be insertions), which keeps joining monotone.

Spark sorts rows by (conversation, turn) over ranges, so a long conversation lies in several partitions. Each gives its
runs' items, sixteen at most, and a second step joins the runs of a conversation. Only symbols of rows take part; texts
are shuffled once, to their conversation, where the repaired rows are streamed.

Cases: null turns go first, rows of one turn by a digest of role and text; null roles and texts are one space; a null
conversation is one; a row with an empty role has no initial and cannot be kept as it is; rows that repeat all columns are counted first and expanded in the agenda; a text is blank without
anything but ASCII white space; very long texts are held one row at a time; a gap count beyond 64 bits is the greatest
long; an empty table gives no rows; other columns are left out, whatever their names. The digest of a conversation is one
stream over its rows, so one task reads the texts of one conversation, however long, without holding them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

SPACE = " \t\n\x0b\f\r"
STATES = "-sua"
#: Rows of one run that the agenda derives at once; longer runs are joined from such.
RUN = 64
ROLES = {"u": "user", "a": "assistant"}
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
OPEN = 5
Items = dict[tuple[str, str], tuple[int, str]]


def _next(state: str) -> str:
    return "a" if state == "u" else "u"


def _deductions(symbol: str | None, state: str) -> Iterator[tuple[str, int, str]]:
    """(edit, cost, state after) over a row's symbol, or over no row."""
    if symbol is None:
        yield "I", COSTS["I"], _next(state)
        return
    yield "D", COSTS["D"], state
    if symbol == "d":
        return
    role, more = symbol.lower(), OPEN if symbol.isupper() else 0
    if role == _next(state) or role == "s" and state == "-":
        yield "K", COSTS["K"] + more, role
    yield "R", COSTS["R"] + more, _next(state)


@lru_cache(maxsize=1 << 15)
def derive(symbols: str, source: str) -> tuple[tuple[str, int, str], ...]:
    """(state, cost, audit) of the items of a run that start in ``source``; popped until every end is final."""
    agenda: list[tuple[int, str, int, str]] = [(0, "", 0, source)]
    final: set[tuple[int, str]] = set()
    out = []
    while agenda:
        cost, audit, at, state = heappop(agenda)
        if (at, state) in final:
            continue
        final.add((at, state))
        if at == len(symbols):
            out.append((state, cost, audit))
            if len(out) == len(STATES):
                break
        steps = [(None, at)] + ([(symbols[at], at + 1)] if at < len(symbols) else [])
        for symbol, then in steps:
            for edit, more, after in _deductions(symbol, state):
                if (then, after) not in final:
                    heappush(agenda, (cost + more, audit + edit, then, after))
    return tuple(out)


def joined(left: Items, right: Items) -> Items:
    """Items of two neighbouring runs: the least over the state between them."""
    out: Items = {}
    for (q, m), (c1, a1) in left.items():
        for p in STATES:
            if (m, p) in right:
                c2, a2 = right[m, p]
                value = (c1 + c2, a1 + a2)
                if (q, p) not in out or value < out[q, p]:
                    out[q, p] = value
    return out


def items(symbols: str, sources: str = STATES) -> Items:
    """All items of a run that start in one of ``sources``; long runs are joined in pairs, level by level."""
    runs = [symbols[k:k + RUN] for k in range(0, len(symbols), RUN)] or [""]
    level = [{(q, p): (c, a) for q in (STATES if k else sources) for p, c, a in derive(run, q)} for k, run in enumerate(runs)]
    while len(level) > 1:
        level = [joined(*level[k:k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def goal(found: Items) -> tuple[int, str]:
    """The lightest derivation of a whole conversation: nothing, or the last row the assistant's."""
    return min(found[q] for q in (("-", "-"), ("-", "a")) if q in found)


def legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


def _plain(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, turn, role, text and key, a digest of role and text."""
    rows = df.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    return rows.withColumn("key", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


def _symbols(rows: DataFrame) -> DataFrame:
    """conv_id, turn, key, initial, blank, open, again and n, the copies, for every kind of row; without texts."""
    bare = F.rtrim("text", F.lit(SPACE))
    slim = rows.select(
        "conv_id", "turn", "key", F.left("role", F.lit(1)).alias("initial"), (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"),
    ).groupBy("conv_id", "turn", "key").agg(
        F.first("initial").alias("initial"), F.first("blank").alias("blank"), F.first("open").alias("open"), F.count("*").alias("n")
    )
    place = F.struct(F.col("turn").isNotNull().alias("later"), "turn")
    seen = slim.groupBy("conv_id", "key").agg(F.min(place).alias("first"), F.count("*").alias("places")).where("places > 1")
    seen = seen.select(F.col("conv_id").alias("_c"), F.col("key").alias("_k"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("key") == F.col("_k"))
    return slim.join(seen, same, "left").withColumn("again", F.coalesce(place > F.col("first"), F.lit(False))).drop("_c", "_k", "first")


_PIECE = (
    "conv_id {id}, piece int, blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, "
    "high long, turns long, costs array<long>, audits array<string>"
)


class _Piece:
    """What one partition says of a conversation's rows, in their order."""

    def __init__(self, conv_id, sources: str):
        self.conv_id, self.sources = conv_id, sources
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.head = self.tail = self.low = self.high = None
        self.symbols: list[str] = []

    def add(self, turn, initial: str, blank: bool, unfinished: bool, again: bool, n: int) -> None:
        if self.head is None:
            self.head = initial
        else:
            self.illegal += not legal(self.tail, initial)
        self.illegal += n - 1
        self.tail = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        if blank:
            self.blank += n
            self.symbols.append("d" * n)
            return
        stays = not again
        self.duplicate += n - stays
        if stays:
            self.truncated += unfinished
            symbol = initial if initial in ("s", "u", "a") else "x"
            self.symbols.append(symbol.upper() if unfinished else symbol)
        self.symbols.append("d" * (n - stays))

    def row(self, piece: int) -> tuple:
        found = items("".join(self.symbols), self.sources)
        values = [found.get((q, p)) for q in STATES for p in STATES]
        return (
            self.conv_id, piece, self.blank, self.duplicate, self.truncated, self.illegal, self.head, self.tail, self.low,
            self.high, self.turns, [v and v[0] for v in values], [v and v[1] for v in values],
        )


def _records(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in batch.columns])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow of a function from rows, as tuples, to rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)

    def each(batches):
        return _batches(run(r for b in batches for r in _records(b)), to_arrow_schema(target))

    return df.mapInArrow(each, target)


def _pieces(symbols: DataFrame) -> DataFrame:
    """One row for every partition that has rows of a conversation."""

    def run(rows):
        number, held, first = TaskContext.get().partitionId(), None, True
        for conv_id, *row in rows:
            if held is None or held.conv_id != conv_id:
                if held is not None:
                    yield held.row(number)
                # Only the first conversation of a partition can have begun in an earlier one.
                held, first = _Piece(conv_id, STATES if first else "-"), False
            held.add(*row)
        if held is not None:
            yield held.row(number)

    slim = symbols.select("conv_id", "turn", "key", "initial", "blank", "open", "again", "n")
    ordered = slim.repartitionByRange("conv_id", "turn", "key").sortWithinPartitions("conv_id", "turn", "key").drop("key")
    return _mapped(ordered, run, _PIECE.format(id=symbols.schema["conv_id"].dataType.simpleString()))


_SUMMARY = (
    "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
)


def _summaries(pieces: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for every conversation: counts, cost and audit; one without rows has zeros."""

    def run(rows):
        def finished(conv_id, state):
            low, high, turns, counts, _, found = state
            gaps = 0 if low is None else min(high - low + 1 - turns, (1 << 63) - 1)
            return (conv_id, gaps, *counts, *goal(found))

        held, state = None, None
        for conv_id, piece, *row in rows:
            if held is None or held[0] != conv_id:
                if held is not None:
                    yield finished(held[0], state)
                held, state = (conv_id,), (None, None, 0, [0, 0, 0, 0], None, {("-", "-"): (0, "")})
            if piece < 0:
                continue
            blank, duplicate, truncated, illegal, head, tail, low, high, turns, costs, audits = row
            least, most, seen, counts, before, found = state
            illegal += before is not None and not legal(before, head)
            seen += turns - (low is not None and low == most)
            most = high if high is not None else most
            pairs = [(q, p) for q in STATES for p in STATES]
            own = {k: (c, a) for k, c, a in zip(pairs, costs, audits) if c is not None}
            counts = [x + y for x, y in zip(counts, (blank, duplicate, truncated, illegal))]
            state = (low if least is None else least, most, seen, counts, tail, joined(found, own))
        if held is not None:
            yield finished(held[0], state)

    kind = pieces.schema["conv_id"].dataType.simpleString()
    marks = ids.distinct().select("conv_id", F.lit(-1).alias("piece"))
    every = marks.unionByName(pieces, allowMissingColumns=True).select(*pieces.columns)
    ordered = every.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return _mapped(ordered, run, _SUMMARY.format(id=kind))


def _walk(rows) -> Iterator[tuple]:
    """(conversation, place, role, text, edit) of repaired rows; place 0 opens a conversation and has its summary.

    ``rows`` are sorted: a conversation's summary, then its rows by turn and key.
    """
    conv, audit, at, placed, system = None, "", 0, 0, 0

    def inserted():
        nonlocal at, placed
        while at < len(audit) and audit[at] == "I":
            at, placed = at + 1, placed + 1
            yield conv, placed, ROLES["ua"[(placed - 1 - system) % 2]], "", "I"

    for conv_id, kind, role, text, *summary in rows:
        if kind == 0:
            yield from inserted()
            conv, audit, at, placed, system = conv_id, text, 0, 0, 0
            yield conv_id, 0, None, text, summary
            continue
        yield from inserted()
        edit, at = audit[at], at + 1
        if edit == "D":
            continue
        placed += 1
        if edit == "K":
            system = 1 if placed == 1 and role[:1] == "s" else system
        else:
            role = ROLES["ua"[(placed - 1 - system) % 2]]
        yield conv_id, placed, role, text, edit
    yield from inserted()


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Repair:
    """Repairs of the conversations of ``df``; those of ``ids`` (all of ``df`` by default) each have a summary."""

    def __init__(
        self, df: DataFrame, ids: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
        text: str = "text",
    ):
        self.rows = _plain(df, conv_id, turn, role, text)
        ids = self.rows.select("conv_id") if ids is None else ids.select(F.col(conv_id).alias("conv_id"))
        self.summaries = _summaries(_pieces(_symbols(self.rows)), ids)

    def _streams(self) -> DataFrame:
        """A conversation's summary, then its rows, in one partition."""
        heads = self.summaries.withColumnRenamed("audit", "text").withColumn("kind", F.lit(0))
        every = heads.unionByName(self.rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        ordered = every.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "key")
        return ordered.select("conv_id", "kind", "role", "text", *_COUNTS)

    def _id(self) -> str:
        return self.rows.schema["conv_id"].dataType.simpleString()

    def repaired(self) -> DataFrame:
        """conv_id, place (from 1), role, text and edit of every row that is left or inserted."""

        def run(rows):
            return (r for r in _walk(rows) if r[1])

        return _mapped(self._streams(), run, f"conv_id {self._id()}, place long, role string, text string, edit string")

    def digests(self) -> DataFrame:
        """The summaries with the SHA-256 of the repaired rows (role:text, joined by new lines)."""

        def run(rows):
            head, digest = None, None
            for conv_id, place, role, text, edit in _walk(rows):
                if not place:
                    if head is not None:
                        yield (*head, digest.hexdigest())
                    head, digest = (conv_id, *edit, text), hashlib.sha256()
                else:
                    digest.update((("\n" if place > 1 else "") + f"{role}:{text}").encode())
            if head is not None:
                yield (*head, digest.hexdigest())

        counts = ", ".join(f"{c} long" for c in _COUNTS)
        return _mapped(self._streams(), run, f"conv_id {self._id()}, {counts}, audit string, repaired_sha256 string")


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with a fifth of the rows harmed, as a hash of conversation and turn decides.

    Of twenty cases 0 drops a row, 1 empties its text, 2 takes away its full stops, exclamation and question marks,
    3 repeats it, 4 makes the role user. Null ids and turns are a space in the hash, null roles and texts one in the row.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = df.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("case"),
    ).where("case <> 0")
    case: Column = F.col("case")
    text = F.when(case == 1, "").when(case == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(case == 4, "user").otherwise(F.col("role"))
    copies = F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")
