"""Closed-form statistics as Column expressions."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: two-sided 95 % quantile of the normal distribution.
Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper Wilson bound, NULL when ``n`` is not positive."""
    n = F.when(n > 0, n.cast("double"))
    p = k / n
    scale = 1 + z * z / n
    centre = p + z * z / (2 * n)
    half = F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * z
    # greatest and least skip NULL, so the missing case is kept apart
    known = lambda bound: F.when(n.isNotNull(), bound)
    return known(F.greatest((centre - half) / scale, F.lit(0.0))), known(F.least((centre + half) / scale, F.lit(1.0)))


def overlap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return F.greatest(lo_a, lo_b) <= F.least(hi_a, hi_b)


def average_rank(value_desc_rank: Column, ties: Column) -> Column:
    """Mean of the places that equal values share."""
    return value_desc_rank + (ties - 1) / F.lit(2.0)


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on nothing but ``parts``: 52 bits of their MD5."""
    key = F.concat_ws(":", *[p.cast("string") for p in parts])
    bits = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


# below this a sum of logarithms, from it on Stirling's series with an error under 1e-16
_EXACT = 32


def log_factorial(k: Column) -> Column:
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(_EXACT)])
    x = k.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + F.lit(0.5 * math.log(2 * math.pi))
    series = series + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(k < _EXACT, F.get(small, k.cast("int"))).otherwise(series)


def binomial_quantile(u: Column, n: Column, p: Column) -> Column:
    """Least count whose binomial distribution function exceeds ``u``.

    Terms are added from nine deviations below the mean, each from the one
    before, so a draw costs a number of steps like the root of ``n``.
    """
    n = n.cast("bigint")
    mean, spread = n * p, 9 * F.sqrt(n * p * (1 - p)) + 9
    low = F.greatest(F.floor(mean - spread), F.lit(0)).cast("bigint")
    high = F.least(F.ceil(mean + spread), n).cast("bigint")
    first = F.exp(log_factorial(n) - log_factorial(low) - log_factorial(n - low) + low * F.log(p) + (n - low) * F.log1p(-p))
    start = F.struct(low.alias("k"), first.alias("term"), first.alias("total"))

    def step(s, _):
        k = s["k"]
        term = s["term"] * (n - k) / (k + 1) * (p / (1 - p))
        return F.when(s["total"] > u, s).otherwise(
            F.struct((k + 1).alias("k"), term.alias("term"), (s["total"] + term).alias("total"))
        )

    found = F.aggregate(F.sequence(low, high), start, step, lambda s: F.least(s["k"], n))
    return F.when((n <= 0) | (p <= 0), F.lit(0).cast("bigint")).when(p >= 1, n).otherwise(found)
