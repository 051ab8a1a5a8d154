"""Column functions of the quantisers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8  # least deviation of a row
STEP = 1e-10  # keeps the top edge inside the last bin; it also puts zero just below the middle edge


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def mu_compress(x: Column, mu: float = 255.0) -> Column:
    return F.signum(x) * F.log1p(F.lit(mu) * F.abs(x)) / F.log1p(F.lit(mu))


def mu_expand(y: Column, mu: float = 255.0) -> Column:
    return F.signum(y) / F.lit(mu) * (F.pow(F.lit(1.0 + mu), F.abs(y)) - 1)


def uniform_code(x: Column, bins: int, low: float, high: float) -> Column:
    code = F.floor((clip(x, low, high) - F.lit(low)) / F.lit(high - low + STEP) * F.lit(bins))
    return F.least(F.greatest(code, F.lit(0)), F.lit(bins - 1)).cast("int")


def uniform_value(code: Column, bins: int, low: float, high: float) -> Column:
    return F.lit(low) + (code + F.lit(0.5)) * F.lit((high - low) / bins)


def mu_code(z: Column, bins: int, mu: float = 255.0, span: float = 4.0) -> Column:
    return uniform_code(mu_compress(clip(z, -span, span) / F.lit(span), mu), bins, -1.0, 1.0)


def mu_value(code: Column, bins: int, mu: float = 255.0, span: float = 4.0) -> Column:
    return mu_expand(uniform_value(code, bins, -1.0, 1.0), mu) * F.lit(span)


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation as an aggregate; null where one side does not vary."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
