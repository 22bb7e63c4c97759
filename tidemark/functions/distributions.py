"""Tails of Student's t and of the fair binomial as column expressions, and as SQL text found another way."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos' coefficients for g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z >= 0.5 by Lanczos' series."""
    x = z - 1.0
    series = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], 1):
        series = series + c / (x + float(k))
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * F.log(t) - t + F.log(series)


def _let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of values, each of them written once in the expression."""
    return F.element_at(F.transform(F.array(F.struct(*(v.cast("double").alias(k) for k, v in values.items()))), body), 1)


def _away(v: Column) -> Column:
    return F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)


def _fraction(p: Column, q: Column, y: Column) -> Column:
    """The continued fraction of the incomplete beta, two terms a step."""

    def step(s: Column, m: Column) -> Column:
        even = m * (q - m) * y / ((p - 1 + 2 * m) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 1 + 2 * m))
        d, c = 1 / _away(1 + even * s["d"]), _away(1 + even / s["c"])
        return _let(lambda v: _let(lambda w: F.struct(w["c"].alias("c"), w["d"].alias("d"), (w["h"] * w["c"] * w["d"]).alias("h")), c=_away(1 + v["odd"] / v["c"]), d=1 / _away(1 + v["odd"] * v["d"]), h=v["h"]), c=c, d=d, h=s["h"] * c * d, odd=odd)

    first = 1 / _away(1 - (p + q) * y / (p + 1))
    # The fraction has converged after some square roots of the larger parameter.
    steps = F.transform(F.sequence(F.lit(1), (60 + 6 * F.sqrt(F.greatest(p, q))).cast("int")), lambda m: m.cast("double"))
    return F.aggregate(steps, F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")), step, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta I_x(a, b), by the continued fraction that converges on either side of the mean."""

    def tail(s: Column) -> Column:
        front = log_gamma(s["p"] + s["q"]) - log_gamma(s["p"]) - log_gamma(s["q"]) + s["p"] * F.log(s["y"]) + s["q"] * F.log(1 - s["y"])
        return F.exp(front) * _fraction(s["p"], s["q"], s["y"]) / s["p"]

    def either(s: Column) -> Column:
        swap = s["x"] > (s["a"] + 1) / (s["a"] + s["b"] + 2)
        inside = F.when(swap, 1 - _let(tail, p=s["b"], q=s["a"], y=1 - s["x"])).otherwise(_let(tail, p=s["a"], q=s["b"], y=s["x"]))
        return F.when(s["x"] <= 0, 0.0).when(s["x"] >= 1, 1.0).otherwise(inside)

    return _let(either, a=a, b=b, x=x)


def t_two_sided(t: Column, df: Column) -> Column:
    """Probability of a t at least as far from 0; df may be fractional."""

    def both(s: Column) -> Column:
        return F.when(F.abs(s["t"]) < 1e-12, 1.0).otherwise(incomplete_beta(s["v"] / 2, F.lit(0.5), s["v"] / (s["v"] + s["t"] * s["t"])))

    return F.when(t.isNotNull() & df.isNotNull(), _let(both, t=t, v=df))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n pairs (of ranks too) by its t with n - 2 degrees of freedom."""
    return F.when(F.abs(r) >= 1, 0.0).otherwise(t_two_sided(r * F.sqrt((n - 2) / (1 - r * r)), n - 2))


def binomial_two_sided(hits: Column, n: Column) -> Column:
    """Exact probability that a fair coin is at least as far from n / 2."""
    far = F.greatest(hits, n - hits)
    return F.when(2 * far <= n, 1.0).otherwise(F.least(F.lit(1.0), 2 * incomplete_beta(far, n - far + 1, F.lit(0.5))))


def t_two_sided_sql(t: str, df: str) -> str:
    """The same by Simpson's rule over the angle whose tangent is t / sqrt(df)."""
    angle = f"atan(abs({t})/sqrt({df}))"
    height = f"power(cos({angle}*j/1000.0), {df}-1)"
    total = f"list_sum(list_transform(range(0, 1001), lambda j: {height}*case when j in (0, 1000) then 1 when j%2=1 then 4 else 2 end))"
    return f"greatest(0.0, 1-2*exp(lgamma(({df}+1)/2.0)-lgamma({df}/2.0))/sqrt(pi())*{angle}/3000.0*{total})"


def binomial_two_sided_sql(hits: str, n: str) -> str:
    """The same as a sum of the tail's terms."""
    far = f"cast(greatest({hits}, {n}-{hits}) as bigint)"
    term = f"exp(lgamma({n}+1.0)-lgamma(j+1.0)-lgamma({n}-j+1.0)-{n}*ln(2.0))"
    return f"case when 2*{far}<={n} then 1.0 else least(1.0, 2*list_sum(list_transform(range({far}, cast({n} as bigint)+1), lambda j: {term}))) end"
