"""Column builders: geometry, periodic boundaries, spectra and relaxation functions. All stay inside code generation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def square(dx: Column, dy: Column, dz: Column) -> Column:
    return dx * dx + dy * dy + dz * dz


def norm(dx: Column, dy: Column, dz: Column) -> Column:
    return F.sqrt(square(dx, dy, dz))


def minimum_image(d: Column, box: Column | float) -> Column:
    """Difference to the nearest image; halves go to the even multiple."""
    b = _c(box)
    s = d / b
    return b * (s - F.rint(s))


def half_box_shift(d: Column, box: Column | float) -> Column:
    """A difference of two wrapped coordinates, moved by one box where it is beyond half of it."""
    b = _c(box)
    return d - F.when(d > b / 2, b).otherwise(0.0) + F.when(d < -b / 2, b).otherwise(0.0)


def wrapped_difference(a: Column, b: Column, box: Column | float) -> Column:
    """Both coordinates wrapped into the box, then moved by one box where beyond half."""
    return half_box_shift(wrap(a, box) - wrap(b, box), box)


def wrap(x: Column, box: Column | float) -> Column:
    """Floored modulo."""
    return F.pmod(x, _c(box))


def sinc(qd: Column) -> Column:
    """sin(x) / x, 1 at 0."""
    return F.when(qd == 0, F.lit(1.0)).otherwise(F.try_divide(F.sin(qd), qd))


def legendre(order: int, u: Column) -> Column:
    """Legendre polynomial by its power series."""
    out = None
    for k, c in enumerate(np.polynomial.legendre.leg2poly([0] * order + [1])):
        if c:
            term = F.lit(float(c)) * _power(u, k) if k else F.lit(float(c))
            out = term if out is None else out + term
    return out


def _power(u: Column, k: int) -> Column:
    out = u
    for _ in range(k - 1):
        out = out * u
    return out


def rotation_to_z(axis: Sequence[float]) -> np.ndarray:
    """Rotation that takes ``axis`` to z; half a turn about x where it points the other way."""
    a = np.asarray(axis, dtype=float)
    a = a / np.linalg.norm(a)
    if a[0] == 0 and a[1] == 0:
        return np.eye(3) if a[2] > 0 else np.diag([1.0, -1.0, -1.0])
    u = np.cross(a, [0, 0, 1.0])
    u /= np.linalg.norm(u)
    cos, sin = a[2], math.sqrt(max(0.0, 1 - a[2] ** 2))
    return cos * np.eye(3) + (1 - cos) * np.outer(u, u) + sin * np.array([[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]])


def rotate_axis(x: Column, y: Column, z: Column, axis: Sequence[float]) -> tuple[Column, Column, Column]:
    m = rotation_to_z(axis)
    return tuple(F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2])) * z for r in m)


def pore_coordinates(x: Column, y: Column, z: Column, origin: Sequence[float], sym_axis: str | Sequence[float] = "z") -> tuple[Column, Column, Column]:
    axis = [float(sym_axis == c) for c in "xyz"] if isinstance(sym_axis, str) else sym_axis
    return rotate_axis(x - float(origin[0]), y - float(origin[1]), z - float(origin[2]), axis)


def polar(x: Column, y: Column) -> tuple[Column, Column]:
    """Radius and azimuth."""
    return F.sqrt(x * x + y * y), F.atan2(y, x)


def spherical(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Radius, azimuth, polar angle (null at the origin)."""
    r = norm(x, y, z)
    return r, F.atan2(y, x), F.acos(F.try_divide(z, r))


def spherical_radius(x: Column, y: Column, z: Column, origin: Sequence[Column | float]) -> Column:
    return norm(x - _c(origin[0]), y - _c(origin[1]), z - _c(origin[2]))


def kww(t: Column, a: float, tau: float, beta: float) -> Column:
    return _c(a) * F.exp(-F.pow(t / _c(tau), _c(beta)))


def kww_1e(a: Column, tau: Column, beta: Column) -> Column:
    """Time at which a stretched exponential has fallen to 1/e; null where it never does."""
    return F.when(_c(a) * math.e > 1, _c(tau) * F.pow(F.log(_c(a) * math.e), F.lit(1.0) / _c(beta)))


def cole_davidson(w: Column, a: float, b: float, t0: float) -> Column:
    p = F.atan(w * _c(t0))
    return _c(a) * F.pow(F.cos(p), _c(b)) * F.sin(_c(b) * p)


def cole_cole(w: Column, a: float, b: float, t0: float) -> Column:
    u = F.pow(w * _c(t0), _c(b))
    return _c(a) * u * math.sin(math.pi * b / 2) / (F.lit(1.0) + u * (2 * math.cos(math.pi * b / 2)) + u * u)


def havriliak_negami(w: Column, a: float, beta: float, alpha: float, tau: float) -> Column:
    """Imaginary part, in closed real form."""
    u = F.pow(w * _c(tau), _c(alpha))
    re, im = F.lit(1.0) + u * math.cos(math.pi * alpha / 2), u * math.sin(math.pi * alpha / 2)
    return _c(a) * F.pow(F.hypot(re, im), _c(-beta)) * F.sin(_c(beta) * F.atan2(im, re))


def colen(d: Column, x: float, t8: float, a: float) -> Column:
    """Decay of correlation times with distance."""
    return _c(t8) * F.exp(_c(a) * F.exp(-d / _c(x)))


def colen_q(d: Column, x: float, qb: float, g: float) -> Column:
    """Decay of a plateau's height with distance."""
    return F.lit(1.0 - qb) * F.exp(-F.pow(d / _c(x), _c(g))) + _c(qb)
