"""Normal distribution function as a Spark expression (Spark has no erf)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the normal tail (numerator, denominator), highest power first.
HART_TOP = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376)
HART_BOTTOM = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461,
               296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
HART_LIMIT = 7.07106781186547


def _poly(coef, x: Column) -> Column:
    out = F.lit(coef[0])
    for c in coef[1:]:
        out = out * x + F.lit(c)
    return out


def norm_cdf(x: Column) -> Column:
    a = F.abs(x)
    tail = F.exp(-a * a / 2) * _poly(HART_TOP, a) / _poly(HART_BOTTOM, a)
    far = F.exp(-a * a / 2) / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    upper = F.when(a > 37, F.lit(0.0)).when(a < HART_LIMIT, tail).otherwise(far)
    return F.when(x > 0, 1 - upper).otherwise(upper)
