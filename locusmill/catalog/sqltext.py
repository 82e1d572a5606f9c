"""SQL fragments for functions DuckDB lacks."""

from __future__ import annotations

from ..functions.special import ERFC_FIT


def erfc(x: str) -> str:
    t = f"(1.0 / (1.0 + 0.5 * abs({x})))"
    poly = repr(ERFC_FIT[-1])
    for c in reversed(ERFC_FIT[:-1]):
        poly = f"({c!r} + {t} * {poly})"
    tail = f"({t} * exp(-({x}) * ({x}) + {poly}))"
    return f"(case when ({x}) >= 0 then {tail} else 2.0 - {tail} end)"


def normal_upper(z: str) -> str:
    return f"(case when ({z}) is null or isnan({z}) then 'nan'::double else 0.5 * {erfc(f'(({z}) / sqrt(2.0))')} end)"


def bh(table: str, p: str, q: str, scope: str = "1", keep: str = "*") -> str:
    """A select adding q-values over the non-NaN p of ``table``."""
    ok = f"({p} is not null and not isnan({p}))"
    return f"""(select {keep}, case when __ok then least(1.0, min({p} * __m / __rk) over (partition by {scope}, __ok
        order by {p} desc)) else 'nan'::double end as {q}
      from (select *, {ok} as __ok, count(*) over (partition by {scope}, {ok}) as __m,
        count(*) over (partition by {scope}, {ok} order by {p}) as __rk from {table}) r)"""
