"""Ranks, exact quantiles, strata and multiple-testing correction without whole-group windows.

Equal values are collapsed first, so ties cannot pile up. Distinct values are then sorted over ranges of (scope, value), as
many as the session has shuffle partitions for the rows there are; a range is a bucket. Scans run per bucket, and one row
per (scope, bucket) carries the sums across buckets. Results are exact: the ranges only decide which task a value goes to.
They are written out with their rows, since ranges of another sample could place a value in another bucket. Many columns
and scopes share one such order: each row is sent once for every ranking it takes part in.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.intervals import depth_stratum, floor_div
from ..functions.special import NAN, normal_upper
from ..session import staged

ALL = "__all"


def _scoped(df: DataFrame, scope: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(scope)) if scope else (df.withColumn(ALL, F.lit(0)), [ALL])


def ordered_runs(runs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows (keys, value, n) with ``n_below`` and ``ties``, how much of n lies below the value and at it in the same keys,
    ``n_total`` of the keys, and ``__bucket``, which rises with the value."""
    keys = list(keys)
    placed = staged(runs.repartitionByRange(*keys, value).withColumn("__bucket", F.spark_partition_id()))
    cell = W.partitionBy(*keys, "__bucket")
    local = placed.withColumns({
        "__upto": F.sum("n").over(cell.orderBy(value)), "ties": F.sum("n").over(W.partitionBy(*keys, "__bucket", value)),
    })
    sums = placed.groupBy(*keys, "__bucket").agg(F.sum("n").alias("__sum"))
    scope = W.partitionBy(*keys)
    lower = scope.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], F.col("__bucket").alias("__r_bucket"),
        F.coalesce(F.sum("__sum").over(lower), F.lit(0)).alias("__base"), F.sum("__sum").over(scope).alias("n_total"),
    )
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys], F.col("__bucket") == F.col("__r_bucket"))
    out = local.join(base, same).withColumn("n_below", F.col("__base") + F.col("__upto") - F.col("ties"))
    return out.drop("__r_bucket", "__base", "__upto", *[f"__r_{k}" for k in keys])


def value_runs(df: DataFrame, scope: Sequence[str], value: str) -> DataFrame:
    """One row per (scope, value): ``n`` rows with it, ``n_before`` below it, ``n_total`` in the scope."""
    df, keys = _scoped(df, scope)
    runs = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return ordered_runs(runs, keys, value).select(*scope, value, "n", F.col("n_below").alias("n_before"), "n_total", "__bucket")


class Ranking(NamedTuple):
    """A column ranked within a scope; ranks are summed per ``group``, and rows failing ``where`` take no part."""

    value: str
    scope: tuple[str, ...] = ()
    group: str | None = None
    where: str | None = None


def _long(df: DataFrame, rankings: dict[str, Ranking], tags: Sequence[str]) -> DataFrame:
    """Rows (tag, scope, grp, value), one for each of ``tags`` that a row takes part in; scope holds the columns of all rankings."""
    columns = list(dict.fromkeys(c for r in rankings.values() for c in r.scope))
    groups = {r.group for r in rankings.values() if r.group}
    if len(groups) > 1:
        raise ValueError(f"one group column for all rankings, not {sorted(groups)}")
    kind = {f.name: f.dataType for f in df.schema}
    group_kind = kind[next(iter(groups))] if groups else "string"
    entries = []
    for tag, r in rankings.items():
        own = [(F.col(c) if c in r.scope else F.lit(None).cast(kind[c])).alias(c) for c in columns]
        grp = F.col(r.group) if r.group else F.lit(None).cast(group_kind)
        entry = F.struct(F.lit(tag).alias("tag"), F.struct(F.lit(0).alias(ALL), *own).alias("scope"), grp.alias("grp"),
                         F.col(r.value).cast("double").alias("value"))
        if tag in tags:
            entries.append(F.when(F.expr(r.where), entry) if r.where else entry)
    return df.select(F.explode(F.array(*entries)).alias("__e")).where("__e.value is not null").select("__e.*")


def shared_order(df: DataFrame, rankings: dict[str, Ranking], tags: Sequence[str] | None = None) -> DataFrame:
    """All rankings, or those of ``tags``, in one order: rows (tag, scope, grp, value, n) with n_below, ties and n_total in their
    (tag, scope).

    ``scope`` is a struct of all scope columns, null where a ranking has no use for one. Null values are left out. The
    group column is the same for all rankings that have one.
    """
    runs = _long(df, rankings, list(rankings) if tags is None else tags).groupBy("tag", "scope", "grp", "value").agg(F.count(F.lit(1)).alias("n"))
    return ordered_runs(runs, ["tag", "scope"], "value").drop("__bucket")


#: Classes of values between a number and its double, and values of a class that one task may sort.
CLASSES, SORTED = 32, 8_000_000


def _class_of(value: Column) -> Column:
    """A whole number that never falls when the value rises; nulls come first and NaN last, as Spark orders them."""
    x = value.cast("double")
    size = F.floor(F.least(F.log2(F.abs(x)), F.lit(2000.0)) * CLASSES) + 2000 * CLASSES
    far = F.lit(1 << 40)
    return F.when(x.isNull(), -far).when(F.isnan(x), far).when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size).cast("long")


def _runs_at(rows: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame | None:
    """The rows of value_runs among which the quantiles lie, without ordering the others; None where too many values are alike.

    Values are counted by class first, and only the classes that hold a quantile's ends are looked into. Keys are few.
    """
    keys = list(keys)
    rows = rows.select(*keys, value, _class_of(F.col(value)).alias("__class"))
    counts = staged(rows.groupBy(*keys, "__class").agg(F.count(F.lit(1)).alias("__n")))
    scope = W.partitionBy(*keys)
    lower = scope.orderBy("__class").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("__below", F.coalesce(F.sum("__n").over(lower), F.lit(0))).withColumn("n_total", F.sum("__n").over(scope))
    ends = [fn(F.lit(float(p)) * (F.col("n_total") - 1)) for p in probs for fn in (F.floor, F.ceil)]
    held = reduce(lambda x, y: x | y, [(F.col("__below") <= x) & (x < F.col("__below") + F.col("__n")) for x in ends])
    chosen = staged(counts.where(held).select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.col("__class").alias("__r_class"), "__n", "__below", "n_total"))
    if (chosen.agg(F.max("__n")).first()[0] or 0) > SORTED:
        return None
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys], F.col("__class") == F.col("__r_class"))
    runs = rows.join(F.broadcast(chosen.drop("__n")), same).groupBy(*keys, "__class", "__below", "n_total", value).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy(*keys, "__class").orderBy(value))
    return runs.withColumn("n_before", F.col("__below") + upto - F.col("n")).drop("__class", "__below")


def order_summary(df: DataFrame, rankings: dict[str, Ranking], probs: Sequence[float] = (0.5,)) -> DataFrame:
    """One row per (tag, scope, grp): n, rank_sum, tie_sum, n_total, and what quantiles are made of.

    Rankings with a group share one order. Those without have no rank and tie sums, and of their values only those near the
    quantiles are ordered.
    """
    at = {(k, end): fn(F.lit(float(p)) * (F.col("n_total") - 1)) for k, p in enumerate(probs) for end, fn in (("lo", F.floor), ("hi", F.ceil))}

    def picks(below: str, past: Column) -> list[Column]:
        return [F.max(F.when((F.col(below) <= x) & (x < past), F.col("value"))).alias(f"{end}{k}") for (k, end), x in at.items()]

    plain = [tag for tag, r in rankings.items() if not r.group]
    out = None
    near = _runs_at(_long(df, rankings, plain), ["tag", "scope"], "value", probs) if plain else None
    if near is not None:
        kind = {f.name: f.dataType for f in _long(df, rankings, plain).schema}
        out = near.groupBy("tag", "scope").agg(F.max("n_total").alias("n_total"), *picks("n_before", F.col("n_before") + F.col("n"))).select(
            "tag", "scope", F.lit(None).cast(kind["grp"]).alias("grp"), F.col("n_total").alias("n"), F.lit(None).cast("double").alias("rank_sum"),
            F.lit(None).cast("double").alias("tie_sum"), "n_total", *[f"{end}{k}" for k, end in at],
        )
    tags = [tag for tag in rankings if near is None or tag not in plain]
    if tags:
        ties = F.col("ties").cast("double")
        whole = shared_order(df, rankings, tags).groupBy("tag", "scope", "grp").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n_below") + (ties + 1) / 2.0)).alias("rank_sum"),
            F.sum(F.col("n") * (ties * ties - 1)).alias("tie_sum"), F.max("n_total").alias("n_total"), *picks("n_below", F.col("n_below") + F.col("ties")),
        )
        out = whole if out is None else whole.unionByName(out)
    return staged(out)


def summary_quantiles(summary: DataFrame, tag: str, scope: Sequence[str], names: dict[str, float], probs: Sequence[float] = (0.5,)) -> DataFrame:
    """Exact linearly interpolated quantiles of a ranking per scope: name -> probability."""
    rows = summary.where(F.col("tag") == tag)
    ends = [F.max(f"{end}{k}").alias(f"{end}{k}") for k in range(len(probs)) for end in ("lo", "hi")]
    got = rows.groupBy("scope").agg(F.max("n_total").alias("__n"), *ends)
    cells = []
    for name, p in names.items():
        k, x = list(probs).index(p), F.lit(float(p)) * (F.col("__n") - 1)
        cells.append((F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * (x - F.floor(x))).alias(name))
    return got.select(*[F.col(f"scope.{c}").alias(c) for c in scope], *cells)


def summary_rank_tests(summary: DataFrame, tag: str, scope: Sequence[str], group: str) -> DataFrame:
    """Two-sided rank test of every group against the rest of its scope; normal p with tie and continuity correction."""
    rows = summary.where(F.col("tag") == tag)
    # A row per group, so a scope's rows are few.
    ties = F.sum("tie_sum").over(W.partitionBy("scope"))
    n1, big = F.col("n").cast("double"), F.col("n_total").cast("double")
    n2 = big - n1
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2.0
    rows = rows.withColumn("__ties", ties)
    spread = F.sqrt(n1 * n2 / 12.0 * ((big + 1) - F.try_divide(F.col("__ties"), big * (big - 1))))
    z = (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / F.when(spread > 0, spread)
    p = F.when(spread > 0, F.least(normal_upper(z) * 2.0, F.lit(1.0))).otherwise(F.lit(NAN))
    return rows.select(
        *[F.col(f"scope.{c}").alias(c) for c in scope], F.col("grp").alias(group), F.col("n").alias("n_group"),
        F.col("n_total").alias("n_pool"), u.alias("u"), p.alias("p"),
    )


def mid_ranks(df: DataFrame, scope: Sequence[str], value: str) -> DataFrame:
    """Average rank of each distinct value, with its tie size."""
    runs = value_runs(df, scope, value).drop("__bucket")
    return runs.withColumn("rank", F.col("n_before") + (F.col("n") + 1) / 2.0)


def exact_quantiles(
    df: DataFrame, scope: Sequence[str], value: str, probs: Sequence[float], name: str = "quantiles"
) -> DataFrame:
    """Exact linearly interpolated quantiles per scope, as an array in the order of ``probs``."""
    rows, keys = _scoped(df, scope)
    runs = _runs_at(rows, keys, value, probs)
    if runs is None:
        runs, keys = _scoped(value_runs(df, scope, value), scope)
    first, past = F.col("n_before"), F.col("n_before") + F.col("n")
    picks: list[Column] = []
    for k, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("n_total") - 1)
        for tag, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((first <= index) & (index < past), F.col(value))).alias(f"__{tag}{k}"))
    got = runs.groupBy(*keys).agg(F.max("n_total").alias("__n"), *picks)
    cells = []
    for k, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("__n") - 1)
        lo, hi = F.col(f"__lo{k}").cast("double"), F.col(f"__hi{k}").cast("double")
        cells.append(lo + (hi - lo) * (at - F.floor(at)))
    return got.select(*scope, F.array(*cells).alias(name))


def exact_median(df: DataFrame, scope: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact median per scope."""
    return exact_quantiles(df, scope, value, [0.5], "__q").withColumn(name, F.col("__q")[0]).drop("__q")


def attach(df: DataFrame, per_scope: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Join per-scope scalars back. Scopes are few and their rows many, so the scalars are broadcast, not the rows shuffled."""
    if scope:
        return df.join(F.broadcast(per_scope), list(scope))
    one = F.broadcast(per_scope.withColumn(ALL, F.lit(0)))
    return df.withColumn(ALL, F.lit(0)).join(one, ALL).drop(ALL)


def quantile_strata(
    df: DataFrame, value: str, strata: int, name: str, usable: Column | None = None, scope: Sequence[str] = ()
) -> DataFrame:
    """Stratum 0..strata-1 by equal-count edges over the usable rows, right-open and clipped; null elsewhere."""
    usable = F.lit(True) if usable is None else usable
    edges = exact_quantiles(df.where(usable), scope, value, [k / strata for k in range(strata + 1)], "__edges")
    out = attach(df, edges, scope)
    inner = F.slice("__edges", 2, strata - 1)
    return out.withColumn(
        name, F.when(usable, F.size(F.filter(inner, lambda e: e <= F.col(value))))
    ).drop("__edges")


def benjamini_hochberg(
    df: DataFrame, p: str, q: str = "q", scope: Sequence[str] = (), bounded: bool = True
) -> DataFrame:
    """Add q-values per scope; null and NaN p-values are left out and get NaN.

    ``bounded`` tables hold one row per tested category, a number set by the dictionaries; they use one window per
    scope. Tables with a row per element copy pass ``bounded=False`` for the bucketed form.
    """
    if bounded:
        out, keys = _scoped(df, scope)
        tested = p + "__ok"
        out = out.withColumn(tested, F.col(p).isNotNull() & ~F.isnan(p))
        group = W.partitionBy(*keys, tested)
        m = F.count(F.lit(1)).over(group)
        rank = F.count(F.lit(1)).over(group.orderBy(p))
        out = out.withColumn("__v", F.col(p) * m / rank)
        worst_first = F.min("__v").over(group.orderBy(F.col(p).desc()))
        out = out.withColumn(q, F.when(F.col(tested), F.least(worst_first, F.lit(1.0))).otherwise(F.lit(NAN)))
        return out.drop("__v", tested, ALL)
    # The p-values are joined back by value, so they are fixed first.
    df = staged(df)
    usable = df.where(F.col(p).isNotNull() & ~F.isnan(p))
    runs, keys = _scoped(value_runs(usable, scope, p), scope)
    runs = runs.withColumn("__v", F.col(p) * F.col("n_total") / (F.col("n_before") + F.col("n")))
    down = W.partitionBy(*keys, "__bucket").orderBy(F.col(p).desc()).rowsBetween(W.unboundedPreceding, 0)
    local = runs.withColumn("__here", F.min("__v").over(down))
    sums = runs.groupBy(*keys, "__bucket").agg(F.min("__v").alias("__m"))
    later = W.partitionBy(*keys).orderBy(F.col("__bucket").desc()).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("__later", F.coalesce(F.min("__m").over(later), F.lit(1.0))).drop("__m")
    table = local.join(sums, [*keys, "__bucket"]).select(
        *scope, p, F.least("__here", "__later", F.lit(1.0)).alias(q)
    )
    return df.join(table, [*scope, p], "left").withColumn(q, F.coalesce(F.col(q), F.lit(NAN)))


def positional_rank(
    df: DataFrame, chrom: str = "chrom", pos: str = "start_pos", ties: Sequence[str] = (), name: str = "rank"
) -> DataFrame:
    """1-based rank of every row in (chrom, pos, ties...) order over the whole table.

    Rows are counted per block of positions first, so the running count sees one row per block; only a block's rows are
    ordered together, and they are shuffled once.
    """
    from .intervals import BLOCK

    cut = df.withColumn("__b", floor_div(pos, BLOCK))
    counts = cut.groupBy(chrom, "__b").agg(F.count(F.lit(1)).alias("__n")).withColumn(ALL, F.lit(0))
    lower = W.partitionBy(ALL).orderBy(chrom, "__b").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(chrom, "__b", F.coalesce(F.sum("__n").over(lower), F.lit(0)).alias("__below"))
    here = W.partitionBy(chrom, "__b").orderBy(pos, *(ties or [c for c in df.columns if c not in (chrom, pos)]))
    ranked = cut.withColumn("__rn", F.row_number().over(here)).join(base, [chrom, "__b"])
    return ranked.select(*df.columns, (F.col("__below") + F.col("__rn")).alias(name))


def sample_per_group(df: DataFrame, group: Sequence[str], most: int, order: Sequence[Column]) -> DataFrame:
    """At most ``most`` rows per group in the order of a row hash; Spark limits each task before the shuffle."""
    ranked = df.withColumn("__rn", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("__rn") <= most).drop("__rn")


def peer_z(df: DataFrame, depth: str, value: str, least: int = 20) -> DataFrame:
    """z-score of ``value`` among rows of the same half-log2 depth stratum; NaN below ``least`` peers."""
    marked = df.withColumn("__stratum", depth_stratum(depth))
    peers = marked.groupBy("__stratum").agg(
        F.count(F.lit(1)).alias("__n"), F.avg(value).alias("__mu"), F.stddev_samp(value).alias("__sd")
    )
    out = marked.join(peers, "__stratum")
    enough = F.col("__n") >= least
    z = F.when(enough & (F.col("__sd") > 0), (F.col(value) - F.col("__mu")) / F.col("__sd")).otherwise(F.lit(NAN))
    return (
        out.withColumn("peer_mean", F.when(enough, F.col("__mu")).otherwise(F.lit(NAN)))
        .withColumn("z_peer", z)
        .drop("__stratum", "__n", "__mu", "__sd")
    )
