"""Balanced label propagation over links between documents. DataFrame functions only.

Rows start in shards by a hash. Rows of equal text are a group, and a group moves whole: it tallies its rows' shards,
wishes for the commonest with room for all of it, or else for any with room, and moves if those that wish for the same
shard and are ranked before it leave room under the shard's quota; larger groups are ranked before smaller ones. A row of a
group that has not moved holds no place. Rounds go on until no group wishes to move and has room. At the end all other rows
keep their shard or move to shards with room, so that counts differ by one at most. Slots number a shard's rows without
a gap.

Groups of more than a PART-th of a quota are few, at most about PART a shard. The driver places them before the rounds,
the largest first, into the shard with the least room that holds them. A group that fits nowhere, such as one larger than
a quota, is cut when all others of its kind are placed: the roomiest shards take what they can, so that it is in few.

In a round a shard lets in all that wish for it, or else loses a third of its room at least: what is refused is less than
twice as large as what was let in first. Rounds are therefore bounded by shards times the logarithm of the quota to the
base 1.5, which ``propagate`` takes as its bound; a few are enough.

``group_links`` are links to measure a cut with: a chain of stars, members dealt to hubs of at most HUB members, and hubs'
first rows linked in turn, so that no row has more than HUB links on a level however large its group is.

Ranks within a shard are made of counts of hash blocks and ranks within a block: no window holds a shard.

Cases: a null text has size 1 and no checksum's bytes, so text_crc32 is 0, and is in no group; repeated rows are rows;
a null id is ordered by its row's number; texts are measured whole; an empty table gives no rows; columns other than id
and text are left out.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import staged

HUB = 64
#: Rows in a block of a rank, about.
BLOCK = 20_000
#: Groups of more than a quota divided by this are placed by the driver.
PART = 64


def numbered(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """rid (a row's number), doc_id, size, text_crc32 and the text's digest; written out, so that rid stays."""
    bytes_ = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return staged(docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(doc_id).alias("doc_id"),
        (bytes_ + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.md5(F.col(text).cast("binary")).alias("digest"),
    ))


def group_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) of row numbers that connect the rows of equal text, in stars of at most about HUB rows.

    Groups are counted before rows are dealt to hubs, and a level's hubs are the rows of the next; a group of n rows has
    fewer than 2 n links.
    """
    sizes = rows.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    level = rows.select("rid", "digest").join(sizes, "digest")
    out = None
    while True:
        hubs = F.ceil(F.col("n") / HUB).cast("long")
        dealt = staged(level.withColumn("hub", F.pmod(F.xxhash64("rid"), hubs)))
        lead = dealt.groupBy("digest", "hub").agg(F.min("rid").alias("b"))
        found = dealt.join(lead, ["digest", "hub"]).where("rid != b").select(F.col("rid").alias("a"), "b")
        out = found if out is None else out.unionByName(found)
        left = lead.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
        level = staged(lead.select(F.col("b").alias("rid"), "digest").join(left, "digest"))
        if level.isEmpty():
            return staged(out)


def ranked(
    rows: DataFrame, by: str, order: Column, blocks: int, level: Column | None = None, weight: str = "1", tie: str = "rid"
) -> DataFrame:
    """``rows`` with rank, the ``weight`` of all rows before along (level, order, tie) within ``by``: gapless from 0 for 1.

    order is a long of 62 bits or fewer, level a small int. Rows are dealt to blocks along both; a block's rank starts at
    the weight of ``by`` in the blocks before it. The table of counts has at most blocks times levels times the values of
    ``by`` rows.
    """
    width = (1 << 62) // max(1, blocks)
    block = F.floor(order / F.lit(width)).cast("long")
    if level is not None:
        block += level.cast("long") * F.lit(2 * max(1, blocks))
    dealt = rows.withColumns({"_o": order, "_block": block, "_w": F.expr(weight).cast("long")})
    counts = dealt.groupBy(by, "_block").agg(F.sum("_w").alias("_n"))
    before = counts.selectExpr(by, "_block", f"sum(_n) over (partition by {by} order by _block) - _n as _before")
    out = dealt.join(before, [by, "_block"])
    inner = f"sum(_w) over (partition by {by}, _block order by _o, {tie} rows unbounded preceding) - _w + _before"
    return out.selectExpr(*rows.columns, f"cast({inner} as long) as rank")


def _mixed(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("rid", F.lit(seed)), 2)


def groups(rows: DataFrame, shards: int) -> DataFrame:
    """digest, n and votes, the (n, shard) of its rows' first shards, of every text that two rows or more have."""
    tallies = rows.where("digest is not null").groupBy("digest", _start(shards).alias("shard")).agg(F.count("*").alias("n"))
    votes = F.collect_list(F.struct("n", "shard")).alias("votes")
    return tallies.groupBy("digest").agg(F.sum("n").alias("n"), votes).where("n > 1")


def _start(shards: int) -> Column:
    return F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")


def _wish(room: list[int], step: int) -> Column:
    """The shard a group of n rows wishes for among those with room for it; null without one."""
    rooms = F.array(*[F.lit(r).cast("long") for r in room])
    voted = F.filter("votes", lambda v: F.element_at(rooms, v["shard"] + 1) >= F.col("n"))
    voted = F.transform(voted, lambda v: F.struct(v["n"], F.xxhash64("digest", v["shard"]), v["shard"].alias("shard")))
    fits = F.filter(F.sequence(F.lit(0), F.lit(len(room) - 1)), lambda s: F.element_at(rooms, s + 1) >= F.col("n"))
    other = F.get(fits, F.pmod(F.xxhash64("digest", F.lit(step)), F.greatest(F.size(fits), F.lit(1))).cast("int"))
    return F.coalesce(F.array_max(voted)["shard"], other)


def _parts(group: dict, room: list[int]) -> list[dict]:
    """Shards of a group's rows low to high: the tightest that holds all that are left, else all of the roomiest."""
    votes = {v["shard"]: v["n"] for v in group["votes"]}
    parts, low = [], 0
    while low < group["n"]:
        fits = [s for s, r in enumerate(room) if r >= group["n"] - low]
        shard = min(fits, key=lambda s: (room[s], -votes.get(s, 0), s)) if fits else room.index(max(room))
        high = min(group["n"], low + room[shard])
        room[shard] -= high - low
        parts.append({"digest": group["digest"], "low": low, "high": high, "shard": shard})
        low = high
    return parts


def _packed(large: list[dict], room: list[int]) -> tuple[list[dict], list[dict]]:
    """Parts of the groups, those that fit whole first, and parts of the others; ``room`` is lowered."""
    whole, late = [], []
    for group in sorted(large, key=lambda g: (-g["n"], g["digest"])):
        if group["n"] <= max(room):
            whole += _parts(group, room)
        else:
            late.append(group)
    return whole, [p for g in late for p in _parts(g, room)]


def _table(spark: SparkSession, parts: list[dict]) -> DataFrame:
    """``parts`` as a table to broadcast: a few times PART rows a shard however many documents there are."""
    listed = F.from_json(F.lit(json.dumps(parts)), "array<struct<digest: string, low: long, high: long, shard: int>>")
    return F.broadcast(spark.range(1).select(F.inline(listed)))


def propagate(left: DataFrame, room: list[int]) -> tuple[DataFrame, list[dict]]:
    """digest and shard of the groups ``left`` that were let in whole, and the groups that no shard had room for.

    ``room`` is what shards have, and is lowered. It only shrinks, so a group that fits nowhere in a round leaves; fewer
    than one a shard do, as each is larger than any room at the end.
    """
    shards, found, without = len(room), None, []
    blocks = max(1, left.count() // BLOCK)
    for step in range(1 + shards * 2 * max(room).bit_length()):
        wishing = staged(left.withColumn("to", _wish(room, step)))
        without += [r.asDict(True) for r in wishing.where("to is null").select("digest", "n", "votes").collect()]
        wishing = wishing.where("to is not null")
        level = F.lit(62) - F.floor(F.log2("n")).cast("int")
        order = F.shiftrightunsigned(F.xxhash64("digest", F.lit(step)), 2)
        limit = F.element_at(F.array(*[F.lit(r).cast("long") for r in room]), F.col("to") + 1)
        dealt = ranked(wishing, "to", order, blocks, level, "n", "digest")
        dealt = staged(dealt.withColumn("goes", F.col("rank") + F.col("n") <= limit).drop("rank"))
        gone = dealt.where("goes").select("digest", F.col("to").alias("shard"))
        found = gone if found is None else found.unionByName(gone)
        waiting = False
        for r in dealt.groupBy("to", "goes").agg(F.sum("n").alias("n")).collect():
            if r["goes"]:
                room[r["to"]] -= r["n"]
            waiting |= not r["goes"]
        if not waiting:
            break
        left = dealt.where("not goes").select("digest", "n", "votes")
    return found, without


def settle(rows: DataFrame, room: list[int]) -> DataFrame:
    """``rows`` with wish, the shard its group has chosen for it; null for rows without a group. ``room`` is lowered."""
    spark, limit = rows.sparkSession, max(1, min(room) // PART)
    found = staged(groups(rows, len(room)))
    large = [r.asDict(True) for r in found.where(F.col("n") > limit).collect()]
    whole, cut = _packed(large, room)
    light, without = propagate(found.where(F.col("n") <= limit), room)
    cut += [p for g in sorted(without, key=lambda g: (-g["n"], g["digest"])) for p in _parts(g, room)]
    # Large groups meet small tables without a shuffle; no text of the other join has more rows than the limit.
    whole, cut = _table(spark, whole), _table(spark, cut)
    held = rows.join(whole.select("digest", F.col("shard").alias("wish")), "digest")
    members = staged(rows.join(cut.select("digest").distinct(), "digest"))
    dealt = ranked(members, "digest", _mixed(2), max(1, members.count() // BLOCK)).join(cut, "digest")
    dealt = dealt.where("low <= rank and rank < high").select(*members.columns, F.col("shard").alias("wish"))
    others = rows.where("digest is not null")
    for few in (whole, cut):
        others = others.join(few, "digest", "left_anti")
    others = others.join(light.withColumnRenamed("shard", "wish"), "digest", "left")
    rest = rows.where("digest is null").withColumn("wish", F.lit(None).cast("int"))
    return held.unionByName(dealt).unionByName(others).unionByName(rest)


def assign(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int = 16
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; counts of rows differ by one at most."""
    rows = numbered(docs, text, doc_id)
    total = rows.count()
    blocks = max(1, total // BLOCK)
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    wished = staged(
        settle(rows, list(quotas)).drop("digest").withColumns({"free": F.col("wish").isNull(), "wish": F.coalesce("wish", _start(shards))})
    )
    # Rows that no group holds come last in a shard's order, so they are the ones to be moved.
    place = staged(ranked(wished, "wish", F.shiftrightunsigned(_mixed(0), 1) + F.col("free").cast("long") * F.lit(1 << 61), blocks))
    limit = lambda c: F.element_at(F.array(*[F.lit(q).cast("long") for q in quotas]), F.col(c) + 1)
    kept = place.where(F.col("rank") < limit("wish"))
    spare = ranked(
        place.where(F.col("rank") >= limit("wish")).drop("rank").withColumn("all", F.lit(0)), "all", _mixed(1), blocks
    )
    held = {r["wish"]: r["n"] for r in kept.groupBy("wish").agg(F.count("*").alias("n")).collect()}
    bounds, at = [], 0
    for s in range(shards):
        at += quotas[s] - held.get(s, 0)
        bounds.append(at)
    # The shard and slot of the k-th spare row: where k falls among the shards' free places.
    below = [0, *bounds[:-1]]
    free_at = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(below[s]).cast("long").alias("low"), F.lit(bounds[s]).cast("long").alias("high"), F.lit(held.get(s, 0)).cast("long").alias("n")) for s in range(shards)])
    chosen = F.element_at(F.filter(free_at, lambda p: (p["low"] <= F.col("rank")) & (F.col("rank") < p["high"])), 1)
    columns = ["doc_id", "size", "text_crc32"]
    placed = spare.withColumn("p", chosen).select(*columns, F.col("p.shard").cast("int").alias("shard"), (F.col("p.n") + F.col("rank") - F.col("p.low")).alias("slot"))
    return kept.select(*columns, F.col("wish").alias("shard"), F.col("rank").alias("slot")).unionByName(placed)
