"""Column expressions for colour contrast as WCAG 2.2 defines it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_srgb(colour: Column) -> Column:
    return colour.rlike("^#[0-9A-Fa-f]{6}$")


def channel(colour: Column, n: int) -> Column:
    """The n-th channel of #rrggbb, from 0 to 255; null for other text."""
    return F.when(valid_srgb(colour), F.conv(F.substring(colour, 2 + 2 * n, 2), 16, 10).cast("int"))


def relative_luminance(colour: Column) -> Column:
    def linear(n: int) -> Column:
        c = channel(colour, n) / 255.0
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(0) + 0.7152 * linear(1) + 0.0722 * linear(2)


def contrast_ratio(a: Column, b: Column) -> Column:
    x, y = relative_luminance(a), relative_luminance(b)
    return F.when(x.isNotNull() & y.isNotNull(), (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05))
