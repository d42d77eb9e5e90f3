"""Column helpers: null-safe arithmetic in the reference's numeric conventions.

The reference works on float arrays where a missing value is NaN and every
comparison with NaN is false. Here missing values are SQL NULLs (NaN and ±inf
are turned into NULL at ingest), so the helpers below spell out the NaN rules
with NULL-aware expressions. All of them are plain Catalyst expressions and
stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def is_finite(c: Column | str) -> Column:
    """True for a present, finite number; false (never NULL) otherwise."""
    c = col(c)
    return F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(INF)), F.lit(False))


def nonfinite_to_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(is_finite(c), c)


def flag(cond: Column) -> Column:
    """A 0/1 integer flag where a NULL comparison counts as false (NaN rule)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def clip(c: Column | str, lo, hi) -> Column:
    """np.clip: NULL stays NULL (Spark's greatest/least would skip the NULL)."""
    c = col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, lit(lo))
    if hi is not None:
        out = F.least(out, lit(hi))
    return F.when(c.isNotNull(), out)


def safe_divide(num, den, default=0.0, bound: float | None = 100.0, eps: float = 1e-12,
                check_finite: bool = True) -> Column:
    """num/den, `default` where the denominator is 0, tiny, missing or not finite.

    `bound` clips the result to [-bound, bound]. v1 uses eps=1e-10,
    bound=1000 and no finiteness check; the tuned variant bound=10.
    """
    n, d = lit(num), lit(den)
    ok = (d != 0) & (F.abs(d) > eps)
    if check_finite:
        ok = ok & is_finite(d) & is_finite(n)
    ok = F.coalesce(ok, F.lit(False))
    out = F.when(ok, F.try_divide(n, d)).otherwise(F.lit(float(default)))
    if bound is not None:
        out = clip(out, -bound, bound)
    return out


def mean_of(values: list[Column]) -> Column:
    total = values[0]
    for v in values[1:]:
        total = total + v
    return total / F.lit(float(len(values)))


def round_half_even(c: Column, places: int = 0) -> Column:
    """Python's round(): half-even, here applied to x * 10^places (rint)."""
    scale = float(10 ** places)
    return F.rint(c * scale) / scale
