"""Random draws as pure expressions of a row key.

A draw depends on (seed, stream, key) only, never on partitioning or task
attempts, so a lost executor re-creates the same rows and plain SQL can check
the result. A fixed seed is for tests and reproducible tables; private releases
need a fresh secret seed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_52 = float(2**52)


def as_column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_text(*keys) -> Column:
    """One text key; NULL parts are written as an explicit marker."""
    parts = [F.coalesce(as_column(k).cast("string"), F.lit("<null>")) for k in keys]
    return parts[0] if len(parts) == 1 else F.concat_ws("-", *parts)


def digest(seed, stream: str, *keys) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:{stream}:"), key_text(*keys)))


def uniform(seed, stream: str, *keys) -> Column:
    """Uniform double in [0, 1) with 52 random bits."""
    head = F.substring(digest(seed, stream, *keys), 1, 13)
    return F.conv(head, 16, 10).cast("double") / F.lit(_TWO_52)


def below(u: Column, n) -> Column:
    """Integer in [0, n)."""
    return F.floor(u * n)


def _inside(u: Column) -> Column:
    return F.greatest(F.lit(1 / _TWO_52), F.least(u, F.lit(1 - 1 / _TWO_52)))


def laplace(u: Column, scale) -> Column:
    v = _inside(u) - 0.5
    return -F.lit(scale) * F.signum(v) * F.log(1 - 2 * F.abs(v))


def gumbel(u: Column) -> Column:
    return -F.log(-F.log(_inside(u)))


def normalise(weights) -> list[float]:
    """Cumulative shares of the weights; the last one is exactly 1."""
    weights = [float(w) for w in weights]
    total = sum(weights)
    if total <= 0 or min(weights) < 0:
        raise ValueError("weights must be non-negative with a positive sum")
    out, run = [], 0.0
    for w in weights:
        run += w
        out.append(run / total)
    out[-1] = 1.0
    return out


def step_lookup(x: Column, cuts: list, values: list[Column], closed: bool = False) -> Column:
    """``values[i]`` for the first i with ``x < cuts[i]`` (``<=`` when closed), else the last value.

    A balanced tree of comparisons: it stays in generated code and takes
    log2(n) steps, unlike a scan over an array.
    """
    if len(values) == 1:
        return values[0]
    mid = len(values) // 2
    bound = F.lit(cuts[mid - 1])
    low = step_lookup(x, cuts[:mid], values[:mid], closed)
    return F.when(x <= bound if closed else x < bound, low).otherwise(
        step_lookup(x, cuts[mid:], values[mid:], closed)
    )


def weighted(u: Column, values: dict) -> Column:
    """Pick a key of ``values`` with probability proportional to its weight."""
    picks = list(values)
    cuts = normalise(values.values())
    out = None
    for value, cut in zip(picks[:-1], cuts[:-1]):
        out = F.when(u < cut, F.lit(value)) if out is None else out.when(u < cut, F.lit(value))
    return F.lit(picks[0]) if out is None else out.otherwise(F.lit(picks[-1]))
