"""Draws that are a function of (seed, key), so a re-run task repeats them exactly."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tries of a rejection; see :func:`gamma`.
TRIES = 8


def draw_key(seed: int, *cols: Column | str) -> Column:
    """64-bit key of one draw."""
    return F.xxhash64(F.lit(int(seed)), *cols)


def uniform(seed: int, *cols: Column | str) -> Column:
    """Uniform on (0, 1), JVM only."""
    bits = F.shiftrightunsigned(draw_key(seed, *cols), 11)
    return (bits.cast("double") + 0.5) * (2.0**-53)


def portable_uniform(seed: int, *cols: Column | str) -> Column:
    """Uniform on [0, 1) from the first 52 bits of an md5 of seed and keys, which any SQL engine can repeat."""
    text = F.concat_ws("|", F.lit(str(int(seed))), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def normal(seed: int, *cols: Column | str) -> Column:
    """Standard normal, JVM only."""
    radius = F.sqrt(-2.0 * F.log(uniform(seed, F.lit("r"), *cols)))
    return radius * F.cos(2.0 * math.pi * uniform(seed, F.lit("a"), *cols))


def portable_normal(seed: int, *cols: Column | str) -> Column:
    """Standard normal from two portable uniforms."""
    radius = F.sqrt(-2.0 * F.log(1.0 - portable_uniform(seed, *cols, F.lit("r"))))
    return radius * F.cos(2.0 * math.pi * portable_uniform(seed, *cols, F.lit("a")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once."""
    return F.transform(F.array(value), use)[0]


def gamma(seed: int, shape: Column, *cols: Column | str, uniform: Callable[..., Column] = portable_uniform) -> Column:
    """Gamma(shape, 1) draw as a column, by rejection from the cube of a normal with at most ``TRIES`` tries.

    A try fails for 5 % of draws at worst, so all of them for one draw in 4e-11; that one becomes the cube's centre. Tries
    after the first success are not evaluated. Shapes below 1 are drawn one higher and scaled by a power of a uniform.
    """

    def drawn(s: Column) -> Column:
        value = let(_lifted(s), lambda d: _tries(0, d, seed, cols, uniform))
        return F.when(s < 1, value * F.pow(uniform(seed, *cols, F.lit("p")), 1.0 / s)).otherwise(value)

    return let(shape.cast("double"), drawn)


def with_gamma(df: DataFrame, out: str, seed: int, shape: Column, *cols: Column | str, uniform: Callable[..., Column] = portable_uniform) -> DataFrame:
    """Add :func:`gamma` of the same seed, shape and keys. The first try is plain columns, for which Spark makes code; draws that
    it fails for, a few in a hundred, go on with the second."""
    t = F.lit(0)
    x = df.withColumn("_shape", shape.cast("double")).withColumn("_d", _lifted(F.col("_shape"))).withColumn("_z", _normal_try(t, seed, cols, uniform))
    x = x.withColumn("_w", _cube_root(F.col("_d"), F.col("_z")))
    later = let(F.col("_d"), lambda d: _tries(1, d, seed, cols, uniform))
    x = x.withColumn("_g", F.coalesce(_judged(F.col("_d"), F.col("_z"), F.col("_w"), t, seed, cols, uniform), later))
    scaled = F.when(F.col("_shape") < 1, F.col("_g") * F.pow(uniform(seed, *cols, F.lit("p")), 1.0 / F.col("_shape"))).otherwise(F.col("_g"))
    return x.select(*df.columns, scaled.alias(out))


def _lifted(s: Column) -> Column:
    return F.when(s < 1, s + 1).otherwise(s) - 1.0 / 3.0


def _normal_try(t: Column, seed: int, cols: tuple, uniform: Callable[..., Column]) -> Column:
    return F.sqrt(-2.0 * F.log(1.0 - uniform(seed, *cols, t, F.lit("r")))) * F.cos(2.0 * math.pi * uniform(seed, *cols, t, F.lit("a")))


def _cube_root(d: Column, z: Column) -> Column:
    return 1.0 + z / F.sqrt(9.0 * d)


def _judged(d: Column, z: Column, w: Column, t: Column, seed: int, cols: tuple, uniform: Callable[..., Column]) -> Column:
    """The draw of try ``t``, or null."""
    v = w * w * w
    below = F.log(1.0 - uniform(seed, *cols, t, F.lit("s"))) < 0.5 * z * z + d * (1.0 - v + 3.0 * F.log(w))
    return F.when((w > 0) & below, d * v)


def _tries(begin: int, d: Column, seed: int, cols: tuple, uniform: Callable[..., Column]) -> Column:
    """The draw of the first try from ``begin`` on that succeeds, or the centre."""

    def tried(t: Column) -> Column:
        return let(_normal_try(t, seed, cols, uniform), lambda z: let(_cube_root(d, z), lambda w: _judged(d, z, w, t, seed, cols, uniform)))

    tries = F.sequence(F.lit(begin), F.lit(TRIES - 1))
    return F.coalesce(F.aggregate(tries, F.lit(None).cast("double"), lambda found, t: F.coalesce(found, tried(t))), d)
