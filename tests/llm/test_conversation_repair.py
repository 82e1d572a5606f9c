import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from locusmill.llm import conversation_repair as cr
from locusmill.llm.queries import op12_conversation_repair

from .oracle import check

SCHEMA = "conv_id long, turn long, role string, text string, audit string, key int"
BLANK = re.compile(r"[^\x20\x09-\x0D]")
GOOD = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """By trying all edits that cost no more than deleting everything; rows are (role, text, must go, truncated)."""
    most, best = 2 * len(rows), []

    def go(i, cost, audit, out):
        if cost > most:
            return
        if i == len(rows):
            if GOOD.fullmatch("".join(r[:1] or "-" for r, _ in out)):
                best.append((cost, audit, tuple(out)))
        for role in ("user", "assistant"):
            go(i, cost + 5, audit + "I", [*out, (role, "")])
        if i < len(rows):
            role, text, must, cut = rows[i]
            go(i + 1, cost + 2, audit + "D", out)
            if not must:
                go(i + 1, cost + 5 * cut, audit + "K", [*out, (role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, cost + 1 + 5 * cut, audit + "R", [*out, (new, text)])

    go(0, 0, "", [])
    return min(best)


def brute(conv):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of rows (turn, role, text) after damage."""
    conv = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in conv]
    conv.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    seen, rows, n = set(), [], [0, 0, 0]
    for _, role, text in conv:
        marks = BLANK.findall(text)
        fault = 0 if not marks else 1 if (role, text) in seen else 2 if marks[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            n[fault] += 1
        rows.append((role, text, fault in (0, 1), fault == 2))
    turns = {t for t, _, _ in conv if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = cheapest(rows)
    return (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def made(seed, n):
    rnd = random.Random(seed)
    out = []
    for c in range(n):
        size = rnd.randint(1, 5)
        for t in range(size):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ugly"])
            text = rnd.choice(["Yes.", "No!", "  ", "", None, "cut", "Why? \n\x0b", "Yes.", "é.", " "])
            out.append((c, rnd.choice([t, t, t + 3, None]), role, text))
    return out + [(None, 1, "user", "Hm."), (None, 2, "assistant", "Well.")] + [(n, 1, "user", "a b")] * 3


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA)


def collected(repair):
    return {r.conv_id: tuple(r[1:]) for r in repair.digests().collect()}


@pytest.mark.parametrize("parts", [1, 7])
def test_brute(spark, parts):
    rows = made(parts, 150)
    want = {}
    for c, *r in rows:
        want.setdefault(c, []).append(r)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts == 1)
    try:
        assert collected(cr.Repair(frame(spark, rows).repartition(parts))) == {c: brute(r) for c, r in want.items()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain(symbols):
    """The same items by a table over rows, without an agenda."""
    inf = (10**9, "")
    best = {"-": (0, "")}
    for k, symbol in enumerate([*symbols, None]):
        for _ in range(3):
            for q in list(best):
                for edit, more, p in cr._deductions(None, q):
                    best[p] = min(best.get(p, inf), (best[q][0] + more, best[q][1] + edit))
        if symbol is None:
            return best
        new = {}
        for q, (c, a) in best.items():
            for edit, more, p in cr._deductions(symbol, q):
                new[p] = min(new.get(p, inf), (c + more, a + edit))
        best = new


def test_runs_join_to_the_same_items():
    rnd = random.Random(9)
    for n in (0, 1, 63, 64, 65, 200, 700):
        symbols = "".join(rnd.choice("suaxSUAXd") for _ in range(n))
        assert {p: v for (q, p), v in cr.items(symbols).items() if q == "-"} == plain(symbols)
        cut = n // 3
        halves = cr.joined(cr.items(symbols[:cut]), cr.items(symbols[cut:]))
        assert halves == cr.items(symbols)


def test_a_conversation_over_many_partitions(spark):
    rnd = random.Random(2)
    rows = [(7, t, rnd.choice(["user", "assistant"]), f"text {rnd.randrange(400)}" + rnd.choice([".", ".", "?", ""])) for t in range(3000)]
    rows += [(c, t, "ua"[t % 2] + "x", f"{t}.") for c in (6, 8) for t in range(4)] + [(7, 5000, "user", "again.")] * 50
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        repair = cr.Repair(frame(spark, rows))
        assert repair.summaries.count() == 3
        pieces = cr._pieces(cr._symbols(repair.rows)).where("conv_id = 7").count()
        got, out = collected(repair), repair.repaired().where("conv_id = 7").orderBy("place").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert pieces > 1
    own = sorted([r[1:] for r in rows if r[0] == 7], key=lambda r: r[0])
    seen, symbols = set(), ""
    for _, role, text in own:
        symbols += "d" if (role, text) in seen else role[0] if text[-1] in ".?" else role[0].upper()
        seen.add((role, text))
    found = plain(symbols)
    assert got[7][5:7] == min(found["-"], found["a"])
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in out).encode()).hexdigest() == got[7][7]
    assert GOOD.fullmatch("".join(r.role[:1] for r in out)) and [r.place for r in out] == list(range(1, len(out) + 1))
    assert got[6] == got[8] and got[6][5:7] == (0, "KKKK")


def test_nothing_left_and_empty_tables(spark):
    rows = [(1, 1, "user", ""), (2, 1, "user", "So."), (2, 2, "assistant", "It is."), (3, 4, "user", "Gone?")]
    df = frame(spark, rows)
    got = collected(cr.Repair(df.where("conv_id < 3"), df))
    none = hashlib.sha256(b"").hexdigest()
    assert got == {1: (0, 1, 0, 0, 0, 2, "D", none), 2: (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:So.\nassistant:It is.").hexdigest()),
                   3: (0, 0, 0, 0, 0, 0, "", none)}
    assert collected(cr.Repair(df.where("false"))) == {}
    assert cr.Repair(df.where("false")).repaired().count() == 0


def test_inserted_rows_and_long_texts(spark):
    long = "word " * 400_000 + "end."
    got = cr.Repair(frame(spark, [(1, 1, "user", "x?"), (1, 2, "user", "y?"), (1, 3, "assistant", long)])).repaired().collect()
    assert [(r.place, r.role, len(r.text), r.edit) for r in sorted(got, key=lambda r: r.place)] == [(1, "user", 2, "K"), (2, "assistant", len(long), "K")]


def test_gaps_beyond_a_long(spark):
    rows = [(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")]
    assert collected(cr.Repair(frame(spark, rows)))[1][0] == (1 << 63) - 1


def test_damage(spark):
    rows = [(c, t, "assistant", "A. B! C?") for c in range(40) for t in (None, 0, 1)] + [(None, 3, None, None)]
    want = []
    for c, t, role, text in rows:
        case = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" ", " ") if role is None else (role, text)
        text = {1: "", 2: text.translate({46: None, 33: None, 63: None})}.get(case, text)
        want += [(c, t, "user" if case == 4 else role, text)] * {0: 0, 3: 2}.get(case, 1)
    assert sorted(map(tuple, cr.damaged(frame(spark, rows)).collect()), key=str) == sorted(want, key=str)


def test_every_conversation_once(spark):
    got = op12_conversation_repair(spark, "/root/testdata/sf0.01").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("d")).first()
    assert got.n == got.d == 100


def test_sql(spark):
    check(spark, "op12_conversation_repair")
