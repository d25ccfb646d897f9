"""sRGB, XYZ and Lab as plain expressions, so they stay in generated code.

Colours are structs or triples of double columns; RGB is 0 to 1, the white point is D65.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB primaries to XYZ, the white point, the thresholds of both curves.
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.00000, 1.08883)
EPSILON, KAPPA = 216.0 / 24389.0, 24389.0 / 27.0
SRGB_CUT, LINEAR_CUT = 0.04045, 0.0031308

XYZ_TO_RGB = tuple(tuple(float(x) for x in row) for row in np.linalg.inv(np.array(RGB_TO_XYZ)))

Triple = Sequence[Column]


def linear(c: Column) -> Column:
    return F.when(c <= SRGB_CUT, c / F.lit(12.92)).otherwise(F.pow((c + F.lit(0.055)) / F.lit(1.055), F.lit(2.4)))


def encoded(c: Column) -> Column:
    return F.when(c <= LINEAR_CUT, c * F.lit(12.92)).otherwise(F.lit(1.055) * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1.0 / 2.4)) - F.lit(0.055))


def _times(matrix: Sequence[Sequence[float]], v: Triple) -> list[Column]:
    return [v[0] * F.lit(r[0]) + v[1] * F.lit(r[1]) + v[2] * F.lit(r[2]) for r in matrix]


def _f(t: Column) -> Column:
    return F.when(t > EPSILON, F.cbrt(t)).otherwise((F.lit(KAPPA) * t + F.lit(16.0)) / F.lit(116.0))


def _f_back(f: Column) -> Column:
    cube = f * f * f
    return F.when(cube > EPSILON, cube).otherwise((F.lit(116.0) * f - F.lit(16.0)) / F.lit(KAPPA))


def lab(r: Column, g: Column, b: Column) -> list[Column]:
    """[L, a, b] of sRGB."""
    x, y, z = (_f(c / F.lit(w)) for c, w in zip(_times(RGB_TO_XYZ, [linear(c) for c in (r, g, b)]), WHITE, strict=True))
    return [F.lit(116.0) * y - F.lit(16.0), F.lit(500.0) * (x - y), F.lit(200.0) * (y - z)]


def rgb(light: Column, a: Column, b: Column, clip: bool = True) -> list[Column]:
    """sRGB of Lab."""
    fy = (light + F.lit(16.0)) / F.lit(116.0)
    xyz = [_f_back(f) * F.lit(w) for f, w in zip((fy + a / F.lit(500.0), fy, fy - b / F.lit(200.0)), WHITE, strict=True)]
    out = [encoded(c) for c in _times(XYZ_TO_RGB, xyz)]
    return [F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)) for c in out] if clip else out


def delta_e(p: Triple, q: Triple) -> Column:
    return F.sqrt(sum((x - y) * (x - y) for x, y in zip(p, q, strict=True)))


def chroma_weight(light: Column) -> Column:
    """How much of a cast's shift a pixel of this lightness takes."""
    return F.lit(0.55) + F.lit(0.45) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), light / F.lit(100.0)))
