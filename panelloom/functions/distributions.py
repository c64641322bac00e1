"""Tail probabilities as column expressions: the incomplete beta function, and the tails of Student's t, of F and of the binomial that it gives."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the continued fraction; it settles after a multiple of the square root of the larger parameter where x is on its shorter side.
_STEPS = 400


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0: Stirling's series (error below 1e-12) at z + 8, taken back by the recurrence."""
    product = z
    for k in range(1, 8):
        product = product * (z + k)
    y = z + 8
    # The series' coefficients.
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(product)


def beta_inc(a: Column, b: Column, x: Column, rest: Column | None = None) -> Column:
    """Regularised incomplete beta function of a, b > 0 at x; below 0 as at 0, above 1 as at 1. ``rest`` is 1 - x, where it is known more exactly.

    The continued fraction is folded over a sequence of its steps, from the left half of the distribution or, mirrored, from the right one.
    """
    # All in one array, so that the fold's steps read ready values.
    rest = 1 - x if rest is None else rest
    mirrored = x > (a + 1) / (a + b + 2)
    ready = F.array(F.when(mirrored, b).otherwise(a).cast("double"), F.when(mirrored, a).otherwise(b).cast("double"), F.when(mirrored, rest).otherwise(x).cast("double"))
    solid = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def at(p: Column) -> Column:
        a, b, x = p[0], p[1], p[2]

        def step(s: Column, i: Column) -> Column:
            m = F.floor(i / 2)
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            grown = F.transform(F.array(F.when(i % 2 == 0, even).otherwise(odd)), lambda n: F.struct((1 / solid(1 + n * s["d"])).alias("d"), solid(1 + n / s["c"]).alias("c"), s["h"].alias("h")))
            return F.transform(grown, lambda g: F.struct(g["d"].alias("d"), g["c"].alias("c"), (g["h"] * g["d"] * g["c"]).alias("h")))[0]

        first = 1 / solid(1 - (a + b) * x / (a + 1))
        fraction = F.aggregate(F.sequence(F.lit(2), F.lit(_STEPS)), F.struct(first.alias("d"), F.lit(1.0).alias("c"), first.alias("h")), step, lambda s: s["h"])
        return F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.log1p(-x)) / a * fraction

    side = F.element_at(F.transform(F.array(ready), at), 1)
    return F.when(x <= 0, 0.0).when(rest <= 0, 1.0).otherwise(F.when(mirrored, 1 - side).otherwise(side))


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) of Student's t; null for a null or less than one degree of freedom."""
    return F.when(df >= 1, beta_inc(df / 2, F.lit(0.5), df / (df + t * t), t * t / (df + t * t)))


def t_tail(t: Column, df: Column) -> Column:
    """P(T > t) of Student's t."""
    half = t_two_sided(t, df) / 2
    return F.when(t >= 0, half).otherwise(1 - half)


def f_tail(f: Column, first: Column, second: Column) -> Column:
    """P(X > f) of the F distribution with ``first`` and ``second`` degrees of freedom."""
    return F.when((first >= 1) & (second >= 1), F.when(f <= 0, 1.0).otherwise(beta_inc(second / 2, first / 2, second / (second + first * f), first * f / (second + first * f))))


def binomial_tail(hits: Column, n: Column, p: float = 0.5) -> Column:
    """P(X >= hits) of ``n`` trials."""
    return F.when(hits <= 0, 1.0).when(hits > n, 0.0).otherwise(beta_inc(hits, n - hits + 1, F.lit(p)))
