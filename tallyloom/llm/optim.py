"""A small limited-memory quasi-Newton minimiser for models fitted on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 100, memory: int = 10, tolerance: float = 1e-6) -> np.ndarray:
    """Minimise f, which returns the value and the gradient; stops when steps no longer help."""
    value, grad = f(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        direction, kept = -grad, []
        for s, y, r in reversed(steps):
            a = r * (s @ direction)
            kept.append(a)
            direction = direction - a * y
        if steps:
            s, y, r = steps[-1]
            direction = direction / (r * (y @ y))
        else:
            direction = direction / max(1.0, float(np.abs(grad).sum()))
        for (s, y, r), a in zip(steps, reversed(kept)):
            direction = direction + (a - r * (y @ direction)) * s
        slope = float(grad @ direction)
        if slope >= 0:
            steps.clear()
            direction, slope = -grad, -float(grad @ grad)
        if -slope < 1e-18:
            break
        size = 1.0
        for _ in range(30):
            new = x + size * direction
            new_value, new_grad = f(new)
            if new_value <= value + 1e-4 * size * slope:
                break
            size *= 0.5
        else:
            break
        s, y = new - x, new_grad - grad
        if s @ y > 1e-12:
            steps.append((s, y, 1.0 / float(s @ y)))
            del steps[:-memory]
        done = value - new_value < tolerance * max(1e-9, abs(value)) * 1e-2
        x, value, grad = new, new_value, new_grad
        if done:
            break
    return x
