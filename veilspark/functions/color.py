"""WCAG contrast as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= F.lit(0.03928), c / F.lit(12.92)).otherwise(F.pow((c + F.lit(0.055)) / F.lit(1.055), F.lit(2.4)))


def _linear(level: int) -> float:
    c = level / 255.0
    return c / 12.92 if c <= 0.03928 else ((c + 0.055) / 1.055) ** 2.4


#: The table as one SQL expression, which takes one call to build instead of 256.
_TABLE = "array(" + ", ".join(f"{_linear(v)!r}D" for v in range(256)) + ")"


def linear_channel(level: Column) -> Column:
    """srgb_to_linear of an 8-bit level by a folded table: a look-up a channel keeps contrast small enough to be pushed
    into filters, and no power is raised per row. Null beyond 0 to 255, which makes a span's visibility unknown."""
    return F.get(F.expr(_TABLE), level)


def relative_luminance(color: Column) -> Column:
    r, g, b = (linear_channel(color[ch]) for ch in "rgb")
    return F.lit(0.2126) * r + F.lit(0.7152) * g + F.lit(0.0722) * b


def has_colors(fg: Column, bg: Column) -> Column:
    return fg.isNotNull() & bg.isNotNull()


def contrast_ratio(fg: Column, bg: Column) -> Column:
    """Null unless both colours are known and within 0 to 255: greatest and least would skip a null."""
    a, b = relative_luminance(fg), relative_luminance(bg)
    levels = [c[ch] for c in (fg, bg) for ch in "rgb"]
    known = has_colors(fg, bg) & (F.greatest(*levels) <= 255) & (F.least(*levels) >= 0)
    return F.when(known, (F.greatest(a, b) + F.lit(0.05)) / (F.least(a, b) + F.lit(0.05)))


def is_low_contrast(fg: Column, bg: Column, least: float = 4.5) -> Column:
    return contrast_ratio(fg, bg) < F.lit(float(least))
