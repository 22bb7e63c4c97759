"""Column helpers whose results do not depend on the engine's rounding or ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int = 6) -> Column:
    """Half-up rounding by floor, the same in any IEEE engine."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5).cast("double") / scale


def ratio(top: Column, bottom: Column, default: float | None = None) -> Column:
    """top / bottom, or ``default`` where bottom is 0 or null."""
    return F.when(bottom != 0, top / F.nullif(bottom, F.lit(0.0))).otherwise(F.lit(default).cast("double"))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution by a fixed rational approximation of erf (error below 1.5e-7)."""
    z = F.abs(x) / F.lit(2.0**0.5)
    t = 1.0 / (1.0 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1.0 - poly * F.exp(-z * z)
    return 0.5 * (1.0 + F.when(x < 0, -erf).otherwise(erf))


def norm_cdf_sql(x: str) -> str:
    """The same approximation as SQL text."""
    z, t = f"(abs({x})/sqrt(2.0))", f"(1.0/(1.0+0.3275911*(abs({x})/sqrt(2.0))))"
    poly = f"({t}*(0.254829592+{t}*(-0.284496736+{t}*(1.421413741+{t}*(-1.453152027+{t}*1.061405429)))))"
    erf = f"(1.0-{poly}*exp(-{z}*{z}))"
    return f"(0.5*(1.0+case when {x}<0 then -{erf} else {erf} end))"


def wilson(hits: Column, n: Column, z: float = 1.96, empty: tuple[float, float] = (0.0, 1.0)) -> tuple[Column, Column]:
    """Wilson score interval; ``empty`` for n = 0."""
    size = F.greatest(n.cast("double"), F.lit(1.0))
    p = hits / size
    centre = (p + z * z / (2 * size)) / (1 + z * z / size)
    half = z * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size)) / (1 + z * z / size)
    return tuple(F.when(n == 0, F.lit(e)).otherwise(v) for v, e in ((F.greatest(centre - half, F.lit(0.0)), empty[0]), (F.least(centre + half, F.lit(1.0)), empty[1])))
