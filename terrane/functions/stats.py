"""Statistics: binomial tails and Poisson thresholds in log space, log-probability arithmetic, multiple testing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

#: The finite log of 0, and the tolerance of comparisons of logs.
LOG_ZERO = -(2.0**30)
LOG_EPSILON = 1e-10

#: Terms of the Stirling series of ln n!, whose rest is below 1e-10 from STIRLING on; smaller n are in a table.
STIRLING = 16
_SMALL = [math.lgamma(n + 1) for n in range(STIRLING)]


def log_factorials(n: int) -> np.ndarray:
    """ln k! for k from 0 to n; for small n."""
    return np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1)))))


def _stirling_rest(n: float) -> float:
    """ln n! less ln(sqrt(2 pi n) (n / e)^n)."""
    if n < STIRLING:
        return _SMALL[int(n)] - (0.5 * math.log(2 * math.pi * n) + n * math.log(n) - n) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n**2) / n**2) / n**2) / n


def _deviance(x: float, mean: float) -> float:
    """x ln(x / mean) + mean - x, without the loss of digits near the mean."""
    u = (x - mean) / mean
    if abs(u) > 0.1:
        return x * math.log(x / mean) + mean - x if x else mean
    total, power = 0.0, u * u
    for k in range(2, 20):  # (1 + u) ln(1 + u) - u as a series
        total += power / (k * (k - 1)) * (1 if k % 2 == 0 else -1)
        power *= u
    return mean * total


def _log_term(k: int, n: int) -> float:
    """ln of C(n, k) / 2^n, through the distances of k and n - k from their mean: accurate however large n is."""
    if k in (0, n):
        return -n * math.log(2)
    return _stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k) - _deviance(k, n / 2) - _deviance(n - k, n / 2) + 0.5 * math.log(n / (2 * math.pi * k * (n - k)))


def binomial_log_tail(k: int, n: int, log_flip: float = -math.log(2)) -> float:
    """ln of the sum over i from 0 to k of C(n, i) * flip^n, with i up to n.

    The terms below the k-th are products of ratios that fall off within some sqrt(n) of it; beyond the middle the other tail is taken
    from the whole. So neither time nor memory follows k or n.
    """
    if n < 0 or k < 0:
        return LOG_ZERO
    more = n * (log_flip + math.log(2))
    if k >= n:
        return more
    if 2 * k >= n:
        return more + math.log1p(-math.exp(binomial_log_tail(n - k - 1, n)))
    j = np.arange(min(k, int(5 * math.sqrt(n)) + 60), dtype=float)
    return more + _log_term(k, n) + math.log1p(float(np.cumprod((k - j) / (n - k + 1 + j)).sum()))


def _per_pair(f, *columns: pd.Series) -> pd.Series:
    """f once for each distinct combination of whole numbers."""
    frame = pd.concat(columns, axis=1, keys=range(len(columns)))
    known = frame.dropna().drop_duplicates()
    known["value"] = np.array([f(*key) for key in known.itertuples(index=False, name=None)], np.float64)
    return frame.merge(known, how="left", on=list(range(len(columns))))["value"].set_axis(frame.index)


@F.pandas_udf(DoubleType())
def _binomial(k: pd.Series, n: pd.Series, flip: pd.Series) -> pd.Series:
    return _per_pair(lambda k, n, p: binomial_log_tail(int(k), int(n), float(np.log(p))), k, n, flip)


def binomial_log_p(signal: Column, control: Column, flip: float = 0.5) -> Column:
    """Natural log of the lower binomial tail of control among trunc(signal + control) trials."""
    n = F.floor(signal + control)
    return _binomial(F.floor(control).cast("long"), n.cast("long"), F.lit(flip))


def enriched_over_background(signal: Column, control: Column) -> Column:
    """The same with both masses truncated first."""
    s, c = F.floor(signal), F.floor(control)
    return _binomial(c.cast("long"), (s + c).cast("long"), F.lit(0.5))


def poisson_limit(rate: float, fdr: float, most: int) -> int:
    """The least t from 1 to most whose Poisson log distribution function exceeds ln(1 - fdr); 0 if none does or there is no signal."""
    if not rate > 0:
        return 0
    if rate < 1000:  # no mass that counts lies beyond 4096
        top = min(most, 4096)
        i = np.arange(1, top + 1)
        terms = np.arange(top + 1) * np.log(rate) - rate - log_factorials(top)[: top + 1]
        sums = np.logaddexp.accumulate(terms)[1:]
    else:  # all mass that counts lies within 40 standard deviations
        reach = int(40 * np.sqrt(rate))
        i = np.arange(max(1, int(rate) - reach), int(rate) + reach + 1)
        terms = np.cumsum(np.log(rate / i))
        sums = np.logaddexp.accumulate(terms - np.logaddexp.reduce(terms))
    over = sums > np.log1p(-fdr)
    return int(i[np.argmax(over)]) if over.any() and i[np.argmax(over)] <= most else 0


@F.pandas_udf(IntegerType())
def _poisson(rates: pd.Series, fdr: pd.Series, most: pd.Series) -> pd.Series:
    return _per_pair(lambda r, f, m: poisson_limit(r, f, int(m)), rates, fdr, most).astype("Int64").astype("float").fillna(0).astype(int)


def poisson_threshold(rate: Column, fdr: float, most: Column) -> Column:
    return _poisson(rate.cast("double"), F.lit(fdr), most.cast("int"))


def log_add(a: Column, b: Column) -> Column:
    """ln(e^a + e^b), where LOG_ZERO is the log of 0."""
    zero = lambda x: x <= LOG_ZERO
    return F.when(zero(a), b).when(zero(b), a).otherwise(F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))))


def log_subtract(a: Column, b: Column) -> Column:
    """ln(e^a - e^b) for a >= b."""
    return F.when(b <= LOG_ZERO, a).when(F.abs(a - b) < LOG_EPSILON, F.lit(LOG_ZERO)).otherwise(a + F.log1p(-F.exp(b - a)))


def log_multiply(a: Column, b: Column) -> Column:
    return F.when((a <= LOG_ZERO) | (b <= LOG_ZERO), F.lit(LOG_ZERO)).otherwise(a + b)


def log_divide(a: Column, b: Column) -> Column:
    return F.when(a <= LOG_ZERO, F.lit(LOG_ZERO)).when(b <= LOG_ZERO, F.raise_error(F.lit("division by the log of 0"))).otherwise(a - b)


def log_power(a: Column, n: Column) -> Column:
    return F.when(n == 0, F.lit(0.0)).when(a <= LOG_ZERO, F.lit(LOG_ZERO)).otherwise(a * n)


def to_log(x: Column) -> Column:
    return F.when(x <= 0, F.lit(LOG_ZERO)).otherwise(F.ln(F.when(x > 0, x).otherwise(F.lit(1.0))))


def from_log(x: Column) -> Column:
    return F.when(x <= LOG_ZERO, F.lit(0.0)).otherwise(F.exp(x))


def log_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; logs closer than LOG_EPSILON are equal."""
    return F.when(F.abs(a - b) < LOG_EPSILON, 0).when(a < b, -1).otherwise(1)


def benjamini_hochberg(regions: DataFrame, by: tuple[str, ...] = ("chrom", "start", "end")) -> DataFrame:
    """log_q = log_p + ln(N / rank): neither made monotone nor capped. The rank needs one order over all regions.

    The order, which `by` continues where p-values are equal, is dealt out by range, so no task holds all regions, however many have the
    same p-value: ranks are places in a range plus the sizes of the ranges before it.
    """
    from ..operators.chunked import ranked_overall

    ranked = ranked_overall(regions, ["log_p", *by], "rank", "_total")
    return ranked.withColumn("log_q", F.col("log_p") + F.ln(F.col("_total") / F.col("rank"))).drop("_total")


def log_factorial(n: Column) -> Column:
    """ln n!; null for null and for numbers below 0."""
    x = n.cast("double")
    series = (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n >= STIRLING, series).when(n >= 0, F.element_at(F.array(*map(F.lit, _SMALL)), (n + 1).cast("int")))


def next_power_of_two(n: Column) -> Column:
    """struct(power, exponent): the least power of 2 that is n at least, from 1 on."""
    exponent = F.when(n > 1, F.ceil(F.log2(n.cast("double")))).otherwise(0).cast("int")
    exponent = F.when(F.pow(F.lit(2.0), exponent) < n, exponent + 1).when((exponent > 0) & (F.pow(F.lit(2.0), exponent - 1) >= n), exponent - 1).otherwise(exponent)
    return F.struct(F.pow(F.lit(2.0), exponent).cast("long").alias("power"), exponent.alias("exponent"))


def index_tuples(rows: DataFrame, sizes: list[Column]) -> DataFrame:
    """Each row with all tuples i0, i1, ... whose k-th index lies from 0 to below its sizes[k]; a row with a size of 0 has none."""
    for k, n in enumerate(sizes):
        rows = rows.withColumn(f"i{k}", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))))
    return rows


def combinations(rows: DataFrame, n: Column, k: int) -> DataFrame:
    """Each row with all ascending tuples i0 < i1 < ... of k indices below its n; a row with n < k has none."""
    for j in range(k):
        low = F.lit(0).cast("long") if j == 0 else F.col(f"i{j - 1}") + 1
        rows = rows.withColumn(f"i{j}", F.explode(F.when(low < n, F.sequence(low, n.cast("long") - 1))))
    return rows
