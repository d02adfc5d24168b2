"""Numbers that carry their derivatives, over arrays: cameras with rotation and distortion, differentiated forwards."""

from __future__ import annotations

import numpy as np


class Dual:
    """Values (n,) with derivatives (n, k)."""

    def __init__(self, value: np.ndarray, slope: np.ndarray):
        self.value, self.slope = value, slope

    @staticmethod
    def inputs(columns: list[np.ndarray]) -> list[Dual]:
        """Each column as a variable of its own."""
        k = len(columns)
        return [Dual(np.asarray(c, float), np.broadcast_to(np.eye(k)[i], (len(c), k))) for i, c in enumerate(columns)]

    def _of(self, other) -> Dual:
        return other if isinstance(other, Dual) else Dual(np.broadcast_to(np.asarray(other, float), self.value.shape), np.zeros_like(self.slope))

    def chain(self, value: np.ndarray, factor: np.ndarray) -> Dual:
        return Dual(value, factor[:, None] * self.slope)

    def __add__(self, other):
        other = self._of(other)
        return Dual(self.value + other.value, self.slope + other.slope)

    __radd__ = __add__

    def __neg__(self):
        return Dual(-self.value, -self.slope)

    def __sub__(self, other):
        return self + -self._of(other)

    def __rsub__(self, other):
        return self._of(other) - self

    def __mul__(self, other):
        other = self._of(other)
        return Dual(self.value * other.value, self.value[:, None] * other.slope + other.value[:, None] * self.slope)

    __rmul__ = __mul__

    def __truediv__(self, other):
        other = self._of(other)
        q = self.value / other.value
        return Dual(q, (self.slope - q[:, None] * other.slope) / other.value[:, None])

    def sqrt(self):
        root = np.sqrt(self.value)
        return self.chain(root, 0.5 / root)


def rotated(turn: list[Dual], p: list[Dual]) -> list[Dual]:
    """p turned by an axis times an angle. Near no turn at all, by the series of the factors in the squared angle."""
    a2 = turn[0] * turn[0] + turn[1] * turn[1] + turn[2] * turn[2]
    v = a2.value
    small = v < 1e-8
    angle = np.sqrt(np.where(small, 1.0, v))
    sin, cos = np.sin(angle), np.cos(angle)
    s = np.where(small, 1 - v / 6, sin / angle)
    ds = np.where(small, -1 / 6 + v / 60, (angle * cos - sin) / (2 * angle**3))
    c = np.where(small, 0.5 - v / 24, (1 - cos) / angle**2)
    dc = np.where(small, -1 / 24 + v / 360, (angle * sin - 2 * (1 - cos)) / (2 * angle**4))
    first, second = a2.chain(s, ds), a2.chain(c, dc)
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    once = cross(turn, p)
    twice = cross(turn, once)
    return [x + first * y + second * z for x, y, z in zip(p, once, twice, strict=True)]


def projected(pose: list[Dual], point: list[Dual], camera: list[Dual]) -> tuple[Dual, Dual]:
    """Pixel of a point: pose = turn and shift, camera = focal length, centre (2), radial terms (2) and tangential ones (2)."""
    x, y, z = (a + b for a, b in zip(rotated(pose[:3], point), pose[3:], strict=True))
    u, v = x / z, y / z
    f, cx, cy, k1, k2, t1, t2 = camera
    r2 = u * u + v * v
    grown = 1 + r2 * (k1 + r2 * k2)
    du = 2 * t1 * u * v + t2 * (r2 + 2 * u * u)
    dv = t1 * (r2 + 2 * v * v) + 2 * t2 * u * v
    return f * (u * grown + du) + cx, f * (v * grown + dv) + cy


def projection_cost(columns: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A cost for stages.cost_rows: pose (6), point (3), camera (7) and pixel (2) give two residuals and their
    derivatives by the sixteen parameters."""
    parameters = Dual.inputs([*columns["pose"].T, *columns["point"].T, *columns["camera"].T])
    u, v = projected(parameters[:6], parameters[6:9], parameters[9:])
    pixel = columns["pixel"]
    return np.stack([u.value - pixel[:, 0], v.value - pixel[:, 1]], 1), np.stack([u.slope, v.slope], 1)
