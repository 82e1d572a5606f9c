"""Interval, strand and distance expressions. All coordinates are 0-based half-open."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .special import _c

PROXIMAL = 1_000_000
SENSE, ANTISENSE = "sense", "antisense"


def floor_div(x, width) -> Column:
    """Integer division that floors."""
    return F.floor(_c(x) / _c(width)).cast("long")


def midpoint(start, end) -> Column:
    """Middle position of a half-open interval, floored."""
    return floor_div(_c(start) + _c(end), 2)


def from_one_based(start) -> Column:
    """1-based inclusive start as a 0-based start; the end needs no change."""
    return _c(start).cast("long") - 1


def to_one_based(start) -> Column:
    return _c(start) + 1


def overlaps(a_start, a_end, b_start, b_end) -> Column:
    return (_c(a_start) < _c(b_end)) & (_c(a_end) > _c(b_start))


def overlap_bp(a_start, a_end, b_start, b_end) -> Column:
    return F.least(_c(a_end), _c(b_end)) - F.greatest(_c(a_start), _c(b_start))


def orientation(read_strand, element_strand, inverted: bool = False) -> Column:
    """Sense when the strands agree; with an inverted library agreement means antisense."""
    agree, differ = (ANTISENSE, SENSE) if inverted else (SENSE, ANTISENSE)
    return F.when(_c(read_strand) == _c(element_strand), agree).otherwise(differ)


def host_orientation(host_class) -> Column:
    """Orientation of host-opposite reads over an intronic copy; null for other classes."""
    c = _c(host_class)
    return F.when(c == "intronic_sense", ANTISENSE).when(c == "intronic_anti", SENSE)


def track_orientation(track_strand, element_strand) -> Column:
    """A plus copy reads sense from the pos track, a minus copy from the neg track."""
    same = ((_c(track_strand) == "pos") & (_c(element_strand) == "+")) | (
        (_c(track_strand) == "neg") & (_c(element_strand) == "-")
    )
    return F.when(same, SENSE).otherwise(ANTISENSE)


def distance_class(rna_chrom, rna_pos, dna_chrom, dna_pos, proximal: int = PROXIMAL) -> Column:
    """0 near on the same chromosome, 1 far on it, 2 on another one."""
    same = _c(rna_chrom) == _c(dna_chrom)
    near = F.abs(_c(dna_pos) - _c(rna_pos)) <= proximal
    return F.when(~same, 2).when(near, 0).otherwise(1)


def statistic_parts(which: str, d0="d0", d1="d1", d2="d2") -> tuple[Column, Column]:
    """Numerator and denominator of one reduction of the distance-class counts."""
    d0, d1, d2 = _c(d0), _c(d1), _c(d2)
    choices = {
        "distal": (d1 + d2, d0 + d1 + d2),
        "cisdistal": (d1, d0 + d1),
        "trans": (d2, d0 + d1 + d2),
    }
    if which not in choices:
        raise ValueError(f"unknown statistic {which!r}; choose from {sorted(choices)}")
    return choices[which]


def clip_to(start, end, size) -> tuple[Column, Column]:
    """An interval cut to [0, size)."""
    lo = F.least(F.greatest(_c(start), F.lit(0)), _c(size))
    hi = F.least(F.greatest(_c(end), F.lit(0)), _c(size))
    return lo, hi


def depth_stratum(n) -> Column:
    """Half-log2 stratum of a count."""
    return F.floor(F.log2(_c(n)) * 2.0) / 2.0
