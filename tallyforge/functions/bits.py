"""Doubles as whole numbers of the same order, by arithmetic that is exact."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SMALLEST = 2.0 ** -1022  # the smallest double with a leading one
UNIT = 2 ** 52
STEP = 2.0 ** 537  # squared, it makes the smallest positive double 1


def order_key(value: Column) -> Column:
    """A long whose order is that of the doubles: the bits of the magnitude with the sign of the number.

    The two zeros are equal; NaN comes last, as in Spark's order; NULL stays NULL. Near a power of two the logarithm may
    be one off, which the quotient shows.
    """
    size = F.abs(value)
    guess = F.greatest(F.lit(-1022), F.least(F.lit(1023), F.floor(F.log2(size))))
    quotient = size / F.pow(F.lit(2.0), guess)
    exponent = F.when(quotient >= 2, guess + 1).when(quotient < 1, guess - 1).otherwise(guess)
    fraction = ((size / F.pow(F.lit(2.0), exponent) - 1) * float(UNIT)).cast("long")
    bits = (F.when(F.isnan(value), F.lit(2047 * UNIT + 1))
            .when(size == float("inf"), F.lit(2047 * UNIT))
            .when(size < SMALLEST, (size * STEP * STEP).cast("long"))
            .otherwise((exponent + 1023) * UNIT + fraction))
    return F.when(value.isNotNull(), F.when((value < 0) & ~F.isnan(value), -bits).otherwise(bits))


def key_value(key: Column) -> Column:
    """The double of an ``order_key``."""
    bits = F.abs(key)
    exponent, fraction = F.shiftright(bits, 52), (bits % UNIT).cast("double")
    size = (F.when((exponent == 2047) & (fraction > 0), F.lit(float("nan")))
            .when(exponent == 2047, F.lit(float("inf")))
            .when(exponent == 0, fraction / STEP / STEP)
            .otherwise((1 + fraction / float(UNIT)) * F.pow(F.lit(2.0), exponent - 1023)))
    return F.when(key < 0, -size).otherwise(size)
