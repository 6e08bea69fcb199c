"""A simplex search and a quasi-Newton polish, for objectives of a few parameters.

Where several points are wanted that do not depend on each other (a simplex to start or shrink, finite
differences), they are asked for at once, so that a distributed objective can take them in one pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class Minimum:
    x: np.ndarray
    value: float
    evaluations: int
    converged: bool


#: The values of an objective at several points.
Many = Callable[[list[np.ndarray]], list[float]]


def simplex(f: Many, x0: np.ndarray, step: float = 0.5, tolerance: float = 1e-9, limit: int = 5000) -> Minimum:
    """Nelder and Mead's method with the usual reflection, expansion, contraction and shrinkage."""
    n = len(x0)
    points = np.vstack([x0, x0 + step * np.eye(n)])
    one = lambda p: f([p])[0]
    values = np.array(f(list(points)))
    used = n + 1
    while used < limit:
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        # flat in value: settled, even along a ridge without end
        if np.ptp(values) <= tolerance * (1 + abs(values[0])):
            return Minimum(points[0], float(values[0]), used, True)
        centre = points[:-1].mean(axis=0)
        mirrored = 2 * centre - points[-1]
        at = one(mirrored)
        used += 1
        if at < values[0]:
            far = centre + 2 * (mirrored - centre)
            beyond = one(far)
            used += 1
            points[-1], values[-1] = (far, beyond) if beyond < at else (mirrored, at)
        elif at < values[-2]:
            points[-1], values[-1] = mirrored, at
        else:
            target = mirrored if at < values[-1] else points[-1]
            near = centre + 0.5 * (target - centre)
            inside = one(near)
            used += 1
            if inside < min(at, values[-1]):
                points[-1], values[-1] = near, inside
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = f(list(points[1:]))
                used += n
    best = int(np.argmin(values))
    return Minimum(points[best], float(values[best]), used, False)


def gradient(f: Many, x: np.ndarray, width: float = 1e-5) -> np.ndarray:
    steps = width * np.eye(len(x))
    values = f([x + s for s in steps] + [x - s for s in steps])
    return (np.array(values[: len(x)]) - np.array(values[len(x) :])) / (2 * width)


def polish(f: Many, x0: np.ndarray, limit: int = 100, tolerance: float = 1e-7) -> Minimum:
    """Quasi-Newton steps with an updated inverse Hessian and a backtracking line search."""
    x, value, inverse = x0.copy(), f([x0])[0], np.eye(len(x0))
    slope, used = gradient(f, x), 1 + 2 * len(x0)
    for _ in range(limit):
        if np.max(np.abs(slope)) <= tolerance * (1 + abs(value)):
            return Minimum(x, value, used, True)
        direction = -inverse @ slope
        if direction @ slope >= 0:
            inverse, direction = np.eye(len(x)), -slope
        size = min(1.0, 1.0 / max(1e-12, float(np.max(np.abs(direction)))))
        while size > 1e-12:
            there = x + size * direction
            at = f([there])[0]
            used += 1
            if np.isfinite(at) and at <= value + 1e-4 * size * (direction @ slope):
                break
            size /= 2
        else:
            # no step helps: settled if the slope promised next to nothing
            return Minimum(x, value, used, bool(abs(direction @ slope) <= 1e-5 * (1 + abs(value)) or np.max(np.abs(slope)) <= 1e-4 * (1 + abs(value))))
        turned = gradient(f, there)
        used += 2 * len(x)
        if value - at <= 2e-9 * max(abs(value), abs(at), 1.0):
            return Minimum(there, at, used, True)
        moved, changed = there - x, turned - slope
        curve = moved @ changed
        if curve > 1e-12:
            left = np.eye(len(x)) - np.outer(moved, changed) / curve
            inverse = left @ inverse @ left.T + np.outer(moved, moved) / curve
        x, value, slope = there, at, turned
    return Minimum(x, value, used, bool(np.max(np.abs(slope)) <= 1e-4 * (1 + abs(value))))


def minimize(f: Many, x0: np.ndarray) -> Minimum:
    """Simplex search, then polish; what is not finite counts as infinitely high."""

    def safe(points: list[np.ndarray]) -> list[float]:
        inside = [k for k, x in enumerate(points) if np.all(np.abs(x) < 60)]
        out = [np.inf] * len(points)
        with np.errstate(all="ignore"):
            for k, value in zip(inside, f([points[k] for k in inside]) if inside else [], strict=True):
                out[k] = float(value) if np.isfinite(value) else np.inf
        return out

    rough = simplex(safe, np.asarray(x0, dtype=float))
    fine = polish(safe, rough.x)
    best = fine if fine.value <= rough.value else rough
    return Minimum(best.x, best.value, rough.evaluations + fine.evaluations, rough.converged or fine.converged)
