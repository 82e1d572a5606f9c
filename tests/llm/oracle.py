"""Compare a registered query with its SQL."""

from __future__ import annotations

from locusmill.llm.queries import QUERIES, SQL
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.01"


def check(spark, name: str) -> None:
    n, _, verdict = compare(spark, duck(SF), name, QUERIES[name], SQL[name], SF)
    assert n > 0 and verdict.startswith("ok"), verdict
