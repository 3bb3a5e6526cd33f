"""Separable resampling of images held as arrays of pixels, row by row."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, floor

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: float) -> float:
    return 1.0 if -0.5 < x <= 0.5 else 0.0


def bilinear(x: float) -> float:
    return max(0.0, 1.0 - abs(x))


def bicubic(x: float, a: float = -0.5) -> float:
    x = abs(x)
    if x < 1:
        return ((a + 2) * x - (a + 3)) * x * x + 1
    return (((x - 5) * x + 8) * x - 4) * a if x < 2 else 0.0


FILTERS: dict[str, tuple[Callable[[float], float], float]] = {"box": (box, 0.5), "bilinear": (bilinear, 1.0), "bicubic": (bicubic, 2.0)}


def weights(before: int, after: int, name: str) -> list[list[float]]:
    """What each of `before` pixels counts for each of `after`. Shrinking stretches the filter, so that every pixel counts; edges take what is inside."""
    f, support = FILTERS[name]
    scale = before / after
    stretch = max(1.0, scale)
    out = []
    for k in range(after):
        centre = (k + 0.5) * scale
        lo, hi = max(0, floor(centre - support * stretch + 0.5)), min(before, ceil(centre + support * stretch + 0.5))
        row = [f((j + 0.5 - centre) / stretch) if lo <= j < hi else 0.0 for j in range(before)]
        total = sum(row)
        out.append([x / total for x in row])
    return out


def table(rows: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def resampled(pixels: Column, size: tuple[int, int], to: tuple[int, int], name: str = "bicubic") -> Column:
    """The pixels of an image of size (rows, columns) as one of size `to`; an array as long as the new image.

    First along rows, then along columns, within the row of the table: nothing is
    shuffled. An array of another length gives null.
    """
    (high, wide), (new_high, new_wide) = size, to
    across, down = table(weights(wide, new_wide, name)), table(weights(high, new_high, name))
    narrow = F.transform(F.sequence(F.lit(0), F.lit(high - 1)), lambda a: bound(F.slice(pixels, a * wide + 1, wide), lambda row: F.transform(across, lambda w: dot(row, w))))
    turned = lambda rows: F.transform(F.sequence(F.lit(0), F.lit(new_wide - 1)), lambda j: F.transform(rows, lambda r: F.get(r, j)))
    out = bound(narrow, lambda rows: bound(turned(rows), lambda columns: F.flatten(F.transform(down, lambda w: F.transform(columns, lambda c: dot(c, w))))))
    return F.when(F.size(pixels) == high * wide, out)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used: as a variable of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
