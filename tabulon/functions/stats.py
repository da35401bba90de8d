"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prices in USD of a token, and what a tuned model costs more.
PRICE_IN, PRICE_OUT, TUNED = 0.25 / 1_000_000, 1.50 / 1_000_000, 1.5


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; NaN where n is 0."""
    p = F.try_divide(successes.cast("double"), n.cast("double"))
    d = 1 + F.try_divide(F.lit(z * z), n.cast("double"))
    centre = p + F.try_divide(F.lit(z * z), 2 * n.cast("double"))
    margin = z * F.sqrt(F.try_divide(p * (1 - p) + F.try_divide(F.lit(z * z), 4 * n.cast("double")), n.cast("double")))
    nan = F.lit(float("nan"))
    return F.coalesce((centre - margin) / d, nan), F.coalesce((centre + margin) / d, nan)


def cost(tokens_in: Column, tokens_out: Column, tuned: Column) -> Column:
    return F.round((tokens_in * PRICE_IN + tokens_out * PRICE_OUT) * F.when(tuned, TUNED).otherwise(1.0), 4)


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def argmax(scores: Column) -> Column:
    """Position (from 0) of the first largest."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def luminance(red: Column, green: Column, blue: Column) -> Column:
    """Relative luminance of a colour whose parts are between 0 and 1: black text fits on what has more than 0.179."""
    linear = lambda c: F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    return linear(red) * 0.2126 + linear(green) * 0.7152 + linear(blue) * 0.0722


# Mean and deviation of the channels that image models are trained with.
CHANNELS = ((0.485, 0.229), (0.456, 0.224), (0.406, 0.225))


def normalised(channel: Column, k: int) -> Column:
    """A byte of an image's channel (0 red, 1 green, 2 blue) as models expect it."""
    mean, deviation = CHANNELS[k]
    return (channel / 255.0 - mean) / deviation
