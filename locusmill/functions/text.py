"""String expressions for annotation records and file names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .special import _c

# The canonical element selection. Each rule is (label, class, family, name prefix); a null part is not
# tested. The second table keys the last element on its name, as the older assembly names its class differently.
CANONICAL_RULES = (
    ("Alu", "SINE", "Alu", "Alu"),
    ("L1", "LINE", "L1", "L1"),
    ("SVA", "Retroposon", "SVA", None),
)
CANONICAL_RULES_BY_NAME = (
    ("Alu", "SINE", "Alu", "Alu"),
    ("L1", "LINE", "L1", "L1"),
    ("SVA", None, None, "SVA"),
)
# Chromosomes of the primary assembly.
PRIMARY = tuple(f"chr{i}" for i in range(1, 23)) + ("chrX", "chrY")
PEAK_FILE = r"^(.+)_([^_]+)_([12])_chr\.bed$"
PREPARED_FILE = r"^(.+)_([^_]+)\.bed$"


def packed_value(attributes, key: str) -> Column:
    """Value after an exactly equal key in a pipe-packed attribute string, else null."""
    parts = F.split(_c(attributes), r"\|")
    at = F.array_position(parts, key)
    return F.when((at > 0) & (at < F.size(parts)), F.try_element_at(parts, (at + 1).cast("int")))


def gtf_value(attributes, key: str) -> Column:
    """Quoted value of a gene-model attribute, else null."""
    found = F.regexp_extract(_c(attributes), rf'(?:^|[; ]){key} "([^"]*)"', 1)
    return F.when(found != "", found)


def file_name(path) -> Column:
    return F.substring_index(_c(path), "/", -1)


def peak_file_parts(path) -> tuple[Column, Column, Column]:
    """(sample, cell line, replicate) from a raw peak file name; null when it does not parse."""
    name = file_name(path)
    got = [F.regexp_extract(name, PEAK_FILE, k) for k in (1, 2, 3)]
    sample, cell, rep = (F.when(g != "", g) for g in got)
    return sample, cell, rep.cast("int")


def prepared_file_parts(path) -> tuple[Column, Column]:
    """(sample, cell line) from a prepared peak file name, split at the last underscore."""
    name = file_name(path)
    got = [F.regexp_extract(name, PREPARED_FILE, k) for k in (1, 2)]
    return tuple(F.when(g != "", g) for g in got)


def element_label(rep_class, rep_family, rep_name, rules=CANONICAL_RULES) -> Column:
    """Element label of a repeat record under a rule table; null when no rule selects it."""
    label = F.lit(None).cast("string")
    for name, want_class, want_family, prefix in reversed(rules):
        test = F.lit(True)
        if want_class is not None:
            test = test & (_c(rep_class) == want_class)
        if want_family is not None:
            test = test & (_c(rep_family) == want_family)
        if prefix is not None:
            test = test & _c(rep_name).startswith(prefix)
        label = F.when(test, name).otherwise(label)
    return label


def family_by_prefix(subfamily) -> Column:
    """Family read off the subfamily name."""
    s = _c(subfamily)
    return F.when(s.startswith("Alu"), "Alu").when(s.startswith("L1"), "L1").otherwise("SVA")


def strand_sign(strand) -> Column:
    """+1 for a plus sign after trimming, -1 for anything else."""
    return F.when(F.trim(_c(strand)) == "+", 1).otherwise(-1)
