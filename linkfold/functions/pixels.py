"""Colours of packed pixels (red * 65536 + green * 256 + blue) as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def packed(red: Column, green: Column, blue: Column) -> Column:
    """Three bytes as one number."""
    return (red * 65_536 + green * 256 + blue).cast("int")


def rgb(pixel: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(pixel, 16) % 256, F.shiftright(pixel, 8) % 256, pixel % 256


def _fixed(value: Column, over: Column, scale: int) -> Column:
    """value * scale / over, with twelve binary places of the quotient, rounded as images' bytes are; 0 over 0."""
    factor = F.bround(F.lit(scale * 4096.0) / over, 0).cast("int")
    return F.when(over == 0, 0).otherwise(F.shiftright(value * factor + 2048, 12))


def hsv(pixel: Column) -> tuple[Column, Column, Column]:
    """Hue in half degrees (0 to 179), saturation and value as bytes."""
    r, g, b = rgb(pixel)
    value = F.greatest(r, g, b)
    span = value - F.least(r, g, b)
    turn = F.when(value == r, g - b).when(value == g, b - r + 2 * span).otherwise(r - g + 4 * span)
    hue = F.when(span == 0, 0).otherwise(F.shiftright(turn * F.bround(F.lit(180 * 4096.0) / (6 * span), 0).cast("int") + 2048, 12))
    return F.when(hue < 0, hue + 180).otherwise(hue), _fixed(span, value, 255), value


def lab(pixel: Column) -> tuple[Column, Column, Column]:
    """Lab of an sRGB pixel as bytes: lightness by 255 / 100, the others from 128 on."""
    linear = lambda c: F.when(c / 255 <= 0.04045, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4)))
    r, g, b = map(linear, rgb(pixel))
    # sRGB primaries and the white point of daylight.
    x = (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456
    y = 0.212671 * r + 0.715160 * g + 0.072169 * b
    z = (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754
    root = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)
    light = F.when(y > 0.008856, 116 * F.cbrt(y) - 16).otherwise(903.3 * y)
    byte = lambda v: F.least(F.greatest(F.bround(v, 0), F.lit(0.0)), F.lit(255.0)).cast("int")
    return byte(light * 2.55), byte(500 * (root(x) - root(y)) + 128), byte(200 * (root(y) - root(z)) + 128)
