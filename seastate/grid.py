"""The spectral grid that all spectra of a frame share."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: Gravity, and the coefficients of the dispersion polynomial below. Fixed values.
GRAVITY = 9.81


def wavenumber(freq, depth=None):
    """Wavenumber of numpy frequencies: deep water, or the rational approximation of the dispersion relation at a depth."""
    freq = np.asarray(freq, float)
    if depth is None:
        return 2 * np.pi * freq**2 / 1.56
    omega = 2 * np.pi * freq
    y = 0.10194 * omega**2 * depth
    a = 1 + 0.6522 * y + 0.4622 * y**2 + 0.0864 * y**4 + 0.0675 * y**5
    return y * np.sqrt(1 + 1 / (y * a)) / depth


@dataclass(frozen=True)
class Grid:
    """freq in Hz, dir in degrees (coming from, clockwise from north) or None for one-dimensional spectra."""

    freq: tuple[float, ...]
    dir: tuple[float, ...] | None = None

    def __post_init__(self):
        if not self.freq or any(not math.isfinite(f) for f in self.freq):
            raise ValueError("a grid needs finite frequencies")
        object.__setattr__(self, "freq", tuple(float(f) for f in self.freq))
        if self.dir is not None:
            object.__setattr__(self, "dir", tuple(float(d) for d in self.dir))

    @property
    def nf(self) -> int:
        return len(self.freq)

    @property
    def nd(self) -> int:
        return len(self.dir) if self.dir is not None else 1

    @property
    def size(self) -> int:
        return self.nf * self.nd

    @cached_property
    def df(self) -> np.ndarray:
        """Gradient of the frequencies; 1 if there is one only."""
        return np.gradient(np.array(self.freq)) if self.nf > 1 else np.ones(1)

    @cached_property
    def dd(self) -> float:
        """The first step between directions; 1 if there are none or one."""
        return abs(self.dir[1] - self.dir[0]) if self.dir is not None and len(self.dir) > 1 else 1.0

    @cached_property
    def f(self) -> np.ndarray:
        return np.array(self.freq)

    @cached_property
    def theta(self) -> np.ndarray:
        return np.array(self.dir if self.dir is not None else [0.0])

    def phi(self, theta: float = 90.0) -> np.ndarray:
        """180 + theta - dir in radians: where waves go, counted from the axis `theta`."""
        return np.radians(180 + theta - self.theta)

    @property
    def circular(self) -> bool:
        """Whether the directions close the circle within a tenth of a step, at equal steps."""
        if self.dir is None or self.nd < 2:
            return False
        d = np.sort(self.theta)
        return bool(np.allclose(np.diff(d), d[1] - d[0]) and abs(d[-1] - d[0] + self.dd - 360) < 0.1 * self.dd)

    def directional(self) -> "Grid":
        if self.dir is None:
            raise ValueError("the spectra have no directions")
        return self

    def tail(self) -> float:
        """The factor of the last frequency's density in the energy beyond it; 0 unless that frequency is over 0.333 Hz."""
        return 0.25 * self.freq[-1] if self.freq[-1] > 0.333 else 0.0


def frequencies(f0: float, nf: int, df: float = 1.1) -> tuple[float, ...]:
    """Geometric frequencies f0 * df**k."""
    return tuple(f0 * df**k for k in range(nf))
