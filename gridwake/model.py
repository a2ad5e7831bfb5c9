"""Driver-side descriptions of coordinate systems, axes and grids, and the constants they share."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

#: Fixed values of the data model.
MISSING = -9999.0
TIME_TOLERANCE = 1e-8
DIVIDE_TOLERANCE = 1e-8
CRAZY = 1e10
NO_DISTANCE = 1e8
NO_INDEX = -1


@dataclass(frozen=True)
class Planet:
    """Equatorial radius and flattening; the sphere has flattening 0."""

    name: str
    a: float
    f: float

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)

    @property
    def b(self) -> float:
        return self.a * (1 - self.f)


PLANETS = {
    "WGS84": Planet("WGS84", 6378137.0, 1 / 298.257223563),
    "Spherical Earth": Planet("Spherical Earth", 6370997.0, 0.0),
}


def planet(name: str = "WGS84") -> Planet:
    if name not in PLANETS:
        raise ValueError(f"unknown planet {name!r}; known are {sorted(PLANETS)}")
    return PLANETS[name]


@dataclass(frozen=True)
class CoordSystem:
    """mtype: cartesian, latlon, stereographic, polar_stereographic, lambert_azimuthal_equal_area, rotated_pole."""

    mtype: str = "latlon"
    units: str = "degrees"
    planet: Planet = field(default_factory=planet)
    lon: float = 0.0
    lat: float = 0.0
    alpha: float = 0.0

    @property
    def is_cartesian(self) -> bool:
        return self.mtype not in ("latlon", "latlon2D", "rotated_pole")

    @property
    def is_projection(self) -> bool:
        return self.mtype not in ("cartesian", "latlon", "latlon2D", "gaussian")

    @property
    def metres(self) -> float:
        """Only kilometres convert; everything else counts as given."""
        return 1000.0 if self.units in ("km", "kilometers") else 1.0


def same_system(a: CoordSystem, b: CoordSystem) -> bool:
    """Two systems that are not cartesian always count as one; others must agree in all parameters."""
    if not a.is_cartesian and not b.is_cartesian:
        return True
    return a.mtype == b.mtype and a.metres == b.metres and a.planet == b.planet and (not a.is_projection or (a.lon, a.lat, a.alpha) == (b.lon, b.lat, b.alpha))


@dataclass(frozen=True)
class Axis:
    """n centres from x0 by dx (dx may be negative); or, with `at`, any centres in order, dx being their mean step."""

    x0: float
    dx: float
    n: int
    at: tuple[float, ...] | None = None

    @classmethod
    def of(cls, centres) -> Axis:
        """An axis of any centres that rise, or fall, throughout."""
        at = tuple(float(c) for c in centres)
        steps = [b - a for a, b in zip(at, at[1:], strict=False)]
        if not at or not (all(s > 0 for s in steps) or all(s < 0 for s in steps)):
            raise ValueError("centres must rise, or fall, throughout")
        mean = (at[-1] - at[0]) / (len(at) - 1) if len(at) > 1 else 0.0
        if all(abs(s - mean) <= DIVIDE_TOLERANCE * abs(mean) for s in steps):
            return cls(at[0], mean, len(at))
        return cls(at[0], mean, len(at), at)

    @classmethod
    def spanning(cls, x0: float, x1: float, dx: float | None = None, n: int | None = None) -> Axis:
        """From both ends and the step or the number; the step must divide the span."""
        if (dx is None) == (n is None):
            raise ValueError("give one of dx and n")
        if n is not None:
            return cls(x0, (x1 - x0) / (n - 1) if n > 1 else 0.0, n)
        steps = round((x1 - x0) / dx)
        if steps < 0 or abs(x0 + steps * dx - x1) > DIVIDE_TOLERANCE * max(1.0, abs(x1)):
            raise ValueError(f"{dx} does not divide {x0}..{x1}")
        return cls(x0, dx, steps + 1)

    def centre(self, i: int) -> float:
        return self.x0 + (i - 1) * self.dx if self.at is None else self.at[i - 1]

    def edges(self) -> list[float]:
        """The n + 1 edges in order: middles between centres, half a step beyond the ends."""
        c = [self.centre(i) for i in range(1, self.n + 1)]
        first, last = (c[1] - c[0], c[-1] - c[-2]) if self.n > 1 else (self.dx, self.dx)
        return [c[0] - first / 2, *((a + b) / 2 for a, b in zip(c, c[1:], strict=False)), c[-1] + last / 2]

    @property
    def widest(self) -> float:
        """The size of the largest cell."""
        if self.at is None:
            return abs(self.dx)
        e = self.edges()
        return max(abs(b - a) for a, b in zip(e, e[1:], strict=False))


@dataclass(frozen=True)
class Grid:
    """A structured grid: cells are numbered (j - 1) * nx + i from 1."""

    name: str
    x: Axis
    y: Axis
    system: CoordSystem = field(default_factory=CoordSystem)

    @property
    def size(self) -> int:
        return self.x.n * self.y.n
