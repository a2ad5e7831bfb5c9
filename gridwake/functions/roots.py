"""Root finders: a residual test, a cap on iterations, and guards against flat functions."""

from __future__ import annotations

from collections.abc import Callable


def newton(f: Callable[[float], float], slope: Callable[[float], float], x: float, tolerance: float = 1e-10, most: int = 100, flat: float = 1e-14) -> tuple[float, bool, int]:
    """(x, converged, iterations)."""
    for k in range(most):
        y = f(x)
        if abs(y) <= tolerance:
            return x, True, k
        s = slope(x)
        if abs(s) <= flat:
            return x, False, k
        x -= y / s
    return x, abs(f(x)) <= tolerance, most


def secant(f: Callable[[float], float], a: float, b: float, tolerance: float = 1e-10, most: int = 100, flat: float = 1e-14) -> tuple[float, bool, int]:
    """(x, converged, iterations) from two first guesses."""
    fa, fb = f(a), f(b)
    for k in range(most):
        if abs(fb) <= tolerance:
            return b, True, k
        if abs(fb - fa) <= flat:
            return b, False, k
        a, b, fa = b, b - fb * (b - a) / (fb - fa), fb
        fb = f(b)
    return b, abs(fb) <= tolerance, most
