"""Small statistical expressions: scores, circular means, null-safe clipping, cleaning."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from slickwake.functions.geo import KM_PER_DEG, col


def clip(x, low, high) -> Column:
    """Between ``low`` and ``high``; null stays null (least and greatest would skip it)."""
    c = col(x)
    if low is not None:
        c = F.greatest(F.lit(float(low)), c)
    if high is not None:
        c = F.least(F.lit(float(high)), c)
    return F.when(col(x).isNotNull(), c)


def sigmoid(x, middle: float = 3.0) -> Column:
    return 1 / (1 + F.exp(-(col(x) - middle)))


def gaussian_score(z) -> Column:
    return F.exp(-0.5 * F.pow(col(z), 2))


def angle_between(a, b) -> Column:
    d = F.abs(col(a) - col(b))
    return F.when(d.isNotNull(), F.least(d, 360 - d))


def _of_known(f: Callable[[float], float], deg: pd.Series) -> pd.Series:
    known = deg.notna()
    out = pd.Series(float("nan"), index=deg.index)
    out[known] = [f(math.radians(x)) for x in deg[known]]
    return out


@pandas_udf(DoubleType())
def _library_sin(deg: pd.Series) -> pd.Series:
    """Sine of degrees by the system's mathematical library."""
    return _of_known(math.sin, deg)


@pandas_udf(DoubleType())
def _library_cos(deg: pd.Series) -> pd.Series:
    return _of_known(math.cos, deg)


def circular_mean(deg) -> Column:
    """Aggregate: mean direction from mean sine and cosine."""
    a = F.radians(col(deg))
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a)))), F.lit(360.0))


def cancels(deg, group: WindowSpec) -> Column:
    """Whether the angles of a row's group cancel out, as two opposite ones and three at 120 degrees do."""
    a = F.radians(col(deg))
    return F.coalesce(F.hypot(F.avg(F.sin(a)).over(group), F.avg(F.cos(a)).over(group)) < 1e-5, F.lit(False))


def sine_cosine(deg, exactly) -> tuple[Column, Column]:
    """Sine and cosine of degrees; where ``exactly``, to the last bit those of the system's library.

    Angles that cancel out have no mean direction: what is left of their sines and cosines is the error of these functions,
    and the JVM's differ from those of other engines in the last bit.  These rows (nulls for all others) take the functions
    of the system's library, as SQL engines do.
    """
    a, known = F.radians(col(deg)), F.when(col(exactly), col(deg))
    return F.when(col(exactly), _library_sin(known)).otherwise(F.sin(a)), F.when(col(exactly), _library_cos(known)).otherwise(F.cos(a))


def cloud_spread_km(lon, lat, km_per_deg: float = KM_PER_DEG) -> Column:
    """Aggregate: root of the summed population variances around the centroid, in km."""
    east = F.var_pop(col(lon)) * F.pow(F.cos(F.radians(F.avg(col(lat)))) * km_per_deg, 2)
    return F.sqrt(F.greatest(F.lit(0.0), east + F.var_pop(col(lat)) * km_per_deg**2))


def position_sigma_km(gap_min, sog0, sog1, base_km: float = 0.2) -> Column:
    """Uncertainty of an interpolated position: grows with a silence of over 30 minutes and the speed around it."""
    speed = (F.coalesce(col(sog0), F.lit(8.0)) + F.coalesce(col(sog1), F.lit(8.0))) / 2
    return base_km + F.when(col(gap_min) > 30, 0.25 * (col(gap_min) / 60) * 1.852 * F.greatest(speed, F.lit(3.0))).otherwise(0.0)


def decibel(value, units) -> Column:
    """10 log10 of linear values (floored at 1e-6); dB and 8-bit values as they are, and missing ones stay missing."""
    linear = (col(units) == "linear") & col(value).isNotNull()
    return F.when(linear, 10 * F.log10(F.greatest(col(value), F.lit(1e-6)))).otherwise(col(value))
