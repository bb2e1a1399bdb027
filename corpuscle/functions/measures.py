"""Arithmetic of paired measurements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscle.functions.text import col


def kvol(weight, length, height, width) -> Column:
    """Volumetric index: weight over the enclosing box; null unless all are positive."""
    w, l, h, d = (col(c) for c in (weight, length, height, width))
    usable = (w != 0) & (l > 0) & (h > 0) & (d > 0)
    return F.when(usable, F.round(w / (l * h * d), 6))


def to_physical(pixels: Column | str, scale: Column | str) -> Column:
    s = col(scale)
    return F.when(s > 0, F.round(col(pixels) / s, 4))


def to_physical_area(pixels: Column | str, scale: Column | str) -> Column:
    s = col(scale)
    return F.when(s > 0, F.round(col(pixels) / (s * s), 4))


def marker_scale(corners: Column | str, marker_size_cm: float = 1.0) -> Column:
    """Pixels per centimetre: mean side of a four-cornered marker over its known size."""
    c = col(corners)

    def side(a: int, b: int) -> Column:
        p, q = F.try_element_at(c, F.lit(a)), F.try_element_at(c, F.lit(b))
        return F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))

    mean = (side(1, 2) + side(2, 3) + side(3, 4) + side(4, 1)) / 4
    return F.when(F.size(c) == 4, mean / marker_size_cm)


def effective_scale(manual: Column | str, corners: Column | str, marker_size_cm: float = 1.0) -> Column:
    """A manual factor above zero wins over the marker."""
    m = col(manual)
    return F.coalesce(F.when(m > 0, m), marker_scale(corners, marker_size_cm))
