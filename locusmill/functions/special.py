"""Special functions Spark SQL lacks, as column arithmetic inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Lanczos coefficients for g = 7, n = 9.
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)
# Rational Chebyshev fit of the complementary error function, relative error below 1.2e-7.
ERFC_FIT = (
    -1.26551223,
    1.00002368,
    0.37409196,
    0.09678418,
    -0.18628806,
    0.27886807,
    -1.13520398,
    1.48851587,
    -0.82215223,
    0.17087277,
)
HALF_LOG_TWO_PI = 0.9189385332046727
NAN = float("nan")
INF = float("inf")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def lgamma(x) -> Column:
    """log Gamma(x) for x >= 1."""
    z = _c(x).cast("double") - 1.0
    series = F.lit(LANCZOS[0])
    for k, coefficient in enumerate(LANCZOS[1:], start=1):
        series = series + F.lit(coefficient) / (z + float(k))
    t = z + LANCZOS_G + 0.5
    return F.lit(HALF_LOG_TWO_PI) + (z + 0.5) * F.log(t) - t + F.log(series)


def log_choose(n, k) -> Column:
    """log of the binomial coefficient."""
    return lgamma(_c(n) + 1) - lgamma(_c(k) + 1) - lgamma(_c(n) - _c(k) + 1)


def erfc(x) -> Column:
    """Complementary error function."""
    x = _c(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.abs(x) * 0.5)
    poly = F.lit(ERFC_FIT[-1])
    for coefficient in reversed(ERFC_FIT[:-1]):
        poly = F.lit(coefficient) + t * poly
    tail = t * F.exp(-x * x + poly)
    return F.when(x >= 0, tail).otherwise(F.lit(2.0) - tail)


def normal_upper(z) -> Column:
    """P(Z >= z); NaN stays NaN."""
    z = _c(z)
    return F.when(F.isnan(z) | z.isNull(), F.lit(NAN)).otherwise(erfc(z / F.lit(2.0**0.5)) * 0.5)


def hypergeom_upper(hits, total, marked, drawn) -> Column:
    """P(X >= hits) for X ~ Hypergeometric(total, marked, drawn); 1 when hits is 0.

    The tail on the far side of the mean is summed outward from its largest term by the ratio recurrence, so nothing
    under- or overflows. By Bernstein's bound all terms beyond 10 standard deviations and 60 together are less than 1e-20 of
    the mass on that side; terms fall faster the further out the sum starts, so the same holds of the sum.
    """
    a, m, c, n = (_c(v).cast("double") for v in (hits, total, marked, drawn))
    mean = c * n / m
    sd = F.sqrt(mean * (F.lit(1.0) - c / m) * (m - n) / F.greatest(m - 1.0, F.lit(1.0)))
    given = {"a": a, "m": m, "c": c, "n": n, "up": a > mean, "reach": sd * 10.0 + 60.0}

    def start(s: Column) -> Column:
        first = F.when(s["up"], s["a"]).otherwise(s["a"] - 1.0)
        ceil_k, floor_k = F.least(s["c"], s["n"]), F.greatest(F.lit(0.0), s["n"] + s["c"] - s["m"])
        log_first = (
            log_choose(s["c"], first) + log_choose(s["m"] - s["c"], s["n"] - first) - log_choose(s["m"], s["n"])
        )
        room = F.when(s["up"], ceil_k - s["a"]).otherwise(s["a"] - 1.0 - floor_k)
        impossible = F.when(s["up"], s["a"] > ceil_k).otherwise(s["a"] - 1.0 < floor_k)
        return F.struct(
            *[s[k].alias(k) for k in given],
            F.when(impossible, F.lit(0.0)).otherwise(F.exp(log_first)).alias("first"),
            F.floor(F.least(room, s["reach"])).cast("int").alias("steps"),
        )

    def tail(s: Column) -> Column:
        def grow(acc: Column, i: Column) -> Column:
            k = F.when(s["up"], s["a"] + i).otherwise(s["a"] - 1.0 - i)
            up = (s["c"] - k + 1.0) * (s["n"] - k + 1.0) / (k * (s["m"] - s["c"] - s["n"] + k))
            down = (k + 1.0) * (s["m"] - s["c"] - s["n"] + k + 1.0) / ((s["c"] - k) * (s["n"] - k))
            term = acc["term"] * F.when(s["up"], up).otherwise(down)
            return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

        ladder = F.when(s["steps"] >= 1, F.sequence(F.lit(1), F.greatest(s["steps"], F.lit(1)))).otherwise(
            F.array().cast("array<int>")
        )
        one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
        outward = s["first"] * F.aggregate(ladder, one, grow)["total"]
        p = F.when(s["up"], outward).otherwise(F.lit(1.0) - outward)
        return F.when(s["a"] <= 0, F.lit(1.0)).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))

    begun = F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in given.items()])), start), F.lit(0))
    return F.get(F.transform(F.array(begun), tail), F.lit(0))


def ratio(top, bottom) -> Column:
    """top / bottom with IEEE results: 0/0 is NaN, x/0 is +inf."""
    top, bottom = _c(top).cast("double"), _c(bottom).cast("double")
    safe = F.when(bottom == 0, F.lit(None).cast("double")).otherwise(bottom)
    zero = F.when((top == 0) | F.isnan(top), F.lit(NAN)).otherwise(F.lit(INF))
    return F.when(bottom == 0, zero).otherwise(top / safe)


def is_finite(x) -> Column:
    """True for doubles that are neither NaN, infinite nor null."""
    x = _c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(INF))


def student_two_sided(t, dof) -> Column:
    """Two-sided p of Student's t for a whole number of degrees of freedom.

    Up to 400 degrees by its finite trigonometric series, so the series is short whatever the row; beyond by Hill's
    transformation to a normal deviate (1970), which is closer there than the normal tail's own error.
    """
    whole = F.abs(_c(t))
    many = _c(dof).cast("double")
    a = many - 0.5
    b = 48.0 * a * a
    y = a * F.log1p(whole * whole / many)
    deviate = (((((-0.4 * y - 3.3) * y - 24.0) * y - 85.5) / (0.8 * y * y + 100.0 + b) + y + 3.0) / b + 1.0) * F.sqrt(y)
    return F.when(many > 400, 2.0 * normal_upper(deviate)).otherwise(_student_series(whole, F.least(many, F.lit(400.0))))


def _student_series(t: Column, dof: Column) -> Column:
    nu = dof.cast("int")
    theta = F.atan(t / F.sqrt(nu.cast("double")))
    cos2, sin = F.pow(F.cos(theta), 2), F.sin(theta)
    odd = nu % 2 == 1
    terms = F.when(odd, ((nu - 1) / 2)).otherwise(nu / 2).cast("int")

    def grow(acc: Column, i: Column) -> Column:
        k = i.cast("double")
        step = F.when(odd, 2.0 * k / (2.0 * k + 1.0)).otherwise((2.0 * k - 1.0) / (2.0 * k)) * cos2
        term = acc["term"] * step
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    first = F.when(odd, F.cos(theta)).otherwise(F.lit(1.0))
    start = F.struct(first.alias("term"), first.alias("total"))
    ladder = F.when(terms >= 2, F.sequence(F.lit(1), F.greatest(terms - 1, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    series = F.aggregate(ladder, start, grow)["total"]
    inside = F.when(nu == 1, theta * (2.0 / math.pi)).when(odd, (theta + sin * series) * (2.0 / math.pi)).otherwise(
        sin * series
    )
    return F.greatest(F.lit(1.0) - inside, F.lit(0.0))
