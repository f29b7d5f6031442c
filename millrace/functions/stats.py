"""Closed-form statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def wilson(hits: Column, n: Column, upper: bool) -> Column:
    """Bound of the 95 % interval of a share, within 0 and 1; null without trials."""
    p = hits / F.nullif(n, F.lit(0))
    centre = p + Z * Z / (2 * n)
    spread = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    x = (centre + spread if upper else centre - spread) / (1 + Z * Z / n)
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def kappa(a: Column, b: Column) -> Column:
    """Cohen's kappa of two boolean judgements as an aggregate; null where chance agreement is complete."""
    pa, pb, po = F.avg(a.cast("double")), F.avg(b.cast("double")), F.avg((a == b).cast("double"))
    pe = pa * pb + (1 - pa) * (1 - pb)
    return F.when(pe < 1, (po - pe) / (1 - pe))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25(tf: Column, length: Column, average: Column, k1: float = 1.0, b: float = 0.75) -> Column:
    """Saturated term frequency, without the idf."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))
