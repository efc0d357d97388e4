"""Numbers as 64-bit integers in the same order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from pipekit.functions.types import quoted

LARGEST, INFINITE, LEAST_NORMAL = 2**63 - 1, 2047 * 2**52, 2.0**-1022


def has_order_key(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.DecimalType):
        return dtype.precision <= 18
    return isinstance(dtype, (T.IntegralType, T.FloatType, T.DoubleType))


def with_order_key(df: DataFrame, column: str, name: str) -> DataFrame:
    """`df` with a long that compares as the numbers of `column` do: equal for equal numbers only, NaN
    last, null for null.

    A double becomes its exponent and, below it, the 52 bits of its fraction. What a logarithm says of
    the exponent may be one off and is put right by halving or doubling the power of two.
    """
    value, dtype = F.col(quoted(column)), df.schema[column].dataType
    if isinstance(dtype, T.IntegralType):
        return df.withColumn(name, value.cast("long"))
    if isinstance(dtype, T.DecimalType) and dtype.precision <= 18:
        return df.withColumn(name, (value * F.lit(10**dtype.scale).cast("decimal(19,0)")).cast("long"))
    if not isinstance(dtype, (T.FloatType, T.DoubleType)):
        raise ValueError(f"no 64-bit order for {dtype.simpleString()}")
    size, power, exponent = F.col("__size"), F.col("__power"), F.col("__exponent")
    staged = df.withColumn("__size", F.abs(value.cast("double")))
    normal = (size >= F.lit(LEAST_NORMAL)) & (size < F.lit(float("inf")))
    staged = staged.withColumn("__exponent", F.when(normal, F.least(F.floor(F.log2(size)).cast("int"), F.lit(1023))))
    staged = staged.withColumn("__power", F.greatest(F.pow(F.lit(2.0), exponent), F.lit(LEAST_NORMAL)))
    down, up = size < power, size >= power * 2
    staged = staged.withColumn("__step", F.when(down, -1).when(up, 1).otherwise(0))
    power = power * F.when(down, 0.5).when(up, 2.0).otherwise(1.0)
    exponent = F.greatest(exponent, F.lit(-1022)) + F.col("__step")
    fraction = ((size / power - 1) * 2.0**52).cast("long")
    # Below the least normal number, all there is of a number is its multiple of 2^-1074.
    bits = (
        F.when(normal, (exponent + 1023).cast("long") * F.lit(2**52) + fraction)
        .when(size < F.lit(LEAST_NORMAL), (size * 2.0**537 * 2.0**537).cast("long"))
        .otherwise(F.lit(INFINITE))
    )
    number = value.cast("double")
    key = F.when(F.isnan(number), F.lit(LARGEST)).when(number < 0, -bits).when(number.isNotNull(), bits)
    return staged.withColumn(name, key).drop("__size", "__exponent", "__power", "__step")
