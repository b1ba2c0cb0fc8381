"""Log-space arithmetic and special functions as Column expressions (no Python workers)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
LOG_ZERO = -100.0
EULER_GAMMA = 0.5772156649015329
LOG_SQRT_2PI = 0.918938533192

NEG_INF = float("-inf")
NAN = float("nan")


def safe_log(x: Column, zero: str = "le0") -> Column:
    """Natural log with an explicit rule for x <= 0.

    ``eq0``: exact zero becomes LOG_ZERO; ``le0``: zero and below become LOG_ZERO;
    ``ieee``: zero is -inf and below is NaN; ``error``: zero and below raise.
    """
    if zero == "le0":
        return F.when(x <= 0, F.lit(LOG_ZERO)).otherwise(F.log(x))
    if zero == "eq0":
        return F.when(x == 0, F.lit(LOG_ZERO)).when(x < 0, F.lit(NAN)).otherwise(F.log(x))
    if zero == "ieee":
        return F.when(x == 0, F.lit(NEG_INF)).when(x < 0, F.lit(NAN)).otherwise(F.log(x))
    if zero == "error":
        message = F.concat(F.lit("non-positive value: "), x.cast("string"))
        return F.when(x <= 0, F.raise_error(message).cast("double")).otherwise(F.log(x))
    raise ValueError(f"unknown zero rule {zero!r}")


def log_add_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def log_sum_exp(values: Column) -> Column:
    """log(sum(exp(v))) of an array column; an empty array gives 0."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(top + F.log(total))


def logit(x: Column) -> Column:
    return F.log(x) - F.log(1 - x)


def digamma(x: Column) -> Column:
    """Digamma for x > 0: recurrence up to 8.5, then the asymptotic series."""
    shifted = F.when(x < 8.5, x + F.ceil(8.5 - x)).otherwise(x)
    borrowed = sum((F.when(x + k < 8.5, 1.0 / (x + k)).otherwise(0.0) for k in range(9)), F.lit(0.0))
    r = 1.0 / (shifted * shifted)
    series = F.log(shifted) - 0.5 / shifted - r * (1.0 / 12 - r * (1.0 / 120 - r / 252.0))
    return F.when(x <= 1e-5, -EULER_GAMMA - 1.0 / x).otherwise(series - borrowed)


def lgamma(x: Column) -> Column:
    """log Gamma for x > 0: Stirling series after moving small arguments up by 10."""
    small = x < 10.0
    z = F.when(small, x + 10.0).otherwise(x)
    product = F.lit(1.0)
    for k in range(10):
        product = product * (x + float(k))
    r = 1.0 / (z * z)
    tail = (1.0 / 12 - r * (1.0 / 360 - r * (1.0 / 1260 - r / 1680.0))) / z
    stirling = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + tail
    return stirling - F.when(small, F.log(product)).otherwise(0.0)


def phred_log_prob(quality: Column) -> tuple[Column, Column]:
    """(log P(base right), log P(base wrong)) of a Phred quality."""
    log_wrong = -quality / 10.0 * math.log(10.0)
    log_right = F.when(quality == 0, F.lit(NEG_INF)).otherwise(F.log1p(-F.exp(log_wrong)))
    return log_right, log_wrong


def lognormal_logpdf(length: Column, mu: Column, sigma: Column) -> Column:
    """Log density of a fragment length; length 0 is LOG_ZERO."""
    ln = F.log(length.cast("double"))
    z = (ln - mu) / sigma
    density = -(ln + F.log(sigma) + LOG_SQRT_2PI + z * z / 2.0)
    return F.when(length <= 0, F.lit(LOG_ZERO)).otherwise(density)


# Width of the exponent bins used to sum probabilities on the map side.
BIN = 64.0


def group_log_sum_exp(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """log(sum(exp(value))) per key, combined on the map side.

    Values are summed inside bins of 64 log units, where exp cannot overflow, and the few
    bins of a key are merged afterwards, so a hot key never travels as raw rows.
    """
    binned = (
        df.withColumn("_bin", F.floor(F.col(value) / BIN))
        .groupBy(*keys, "_bin")
        .agg(F.sum(F.exp(F.col(value) - F.col("_bin") * BIN)).alias("_mass"))
    )
    bins = F.col("_bins")
    top = F.array_max(F.transform(bins, lambda b: b["_bin"]))
    total = F.aggregate(
        F.array_sort(bins), F.lit(0.0), lambda acc, b: acc + b["_mass"] * F.exp((b["_bin"] - F.col("_top")) * BIN)
    )
    return (
        binned.groupBy(*keys)
        .agg(F.collect_list(F.struct("_bin", "_mass")).alias("_bins"))
        .withColumn("_top", top)
        .select(*keys, (F.col("_top") * BIN + F.log(total)).alias(out))
    )


#: Terms of the two expansions below; both are then exact to 1e-13 of erfc.
ERFC_TERMS = 60
ERFC_SWITCH = 2.0
#: Below this erfc is no double any more and its log is LOG_ZERO.
ERFC_LEAST = -745.13


def log_erfc(x: Column) -> Column:
    """log(erfc(x)): the power series of erf up to 2, the continued fraction of erfc beyond."""
    a = F.abs(x)
    square = a * a
    series = F.aggregate(F.sequence(F.lit(ERFC_TERMS), F.lit(1)), F.lit(1.0), lambda s, k: 1.0 + 2.0 * square / (2.0 * k + 1.0) * s)
    erf = 2.0 / math.sqrt(math.pi) * a * F.exp(-square) * series
    fraction = F.aggregate(F.sequence(F.lit(ERFC_TERMS), F.lit(1)), F.lit(1.0), lambda s, k: 1.0 + k / (2.0 * F.greatest(square, F.lit(1e-18))) / s)
    beyond = -square - F.log(F.greatest(a, F.lit(1e-9)) * math.sqrt(math.pi) * fraction)
    right = F.when(a < ERFC_SWITCH, F.log(1.0 - erf)).when(beyond < ERFC_LEAST, F.lit(LOG_ZERO)).otherwise(beyond)
    left = F.when(a < ERFC_SWITCH, F.log(1.0 + erf)).otherwise(F.log(2.0 - F.exp(beyond)))
    return F.when(x < 0, left).otherwise(right)
