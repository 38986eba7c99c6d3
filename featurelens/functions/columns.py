"""Column-expression helpers shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sig(c: Column, digits: int = 10) -> Column:
    """Round to ``digits`` significant digits (stable float output for comparison).

    Scale is taken from the magnitude, so the same formula is written in the
    SQL oracle; 0, NULL, NaN and infinities pass through.
    """
    x = c.cast("double")
    mag = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))))
    scale = F.lit(float(10 ** (digits - 1)))
    return (F.when(x.isNull(), F.lit(None).cast("double"))
            .when(F.isnan(x) | (x == 0) | (F.abs(x) == float("inf")), x)
            .otherwise(F.round(x / mag * scale) / scale * mag))


def corr_parts(x: Column, y: Column, prefix: str) -> list:
    """Aggregates for an ANSI-safe Pearson r (``corr`` raises on a constant side)."""
    return [F.covar_pop(x, y).alias(f"{prefix}_cov"), F.var_pop(x).alias(f"{prefix}_vx"),
            F.var_pop(y).alias(f"{prefix}_vy")]


def corr_from_parts(prefix: str) -> Column:
    """r = cov / sqrt(vx vy); NULL when either side is constant."""
    cov, vx, vy = F.col(f"{prefix}_cov"), F.col(f"{prefix}_vx"), F.col(f"{prefix}_vy")
    return F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
