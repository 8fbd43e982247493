"""Small weight tables, computed once on the driver and inlined as literals."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def savgol_weights(window: int, degree: int) -> dict[int, float]:
    """Weight of each offset for a least-squares polynomial evaluated at window // 2."""
    if not 0 <= degree < window:
        raise ValueError("need 0 <= degree < window")
    half = window // 2
    offsets = np.arange(window) - half
    design = np.vander(offsets.astype(float), degree + 1, increasing=True)
    weights = np.linalg.pinv(design)[0]
    return {int(o): float(w) for o, w in zip(offsets, weights)}


def gaussian_kernel(width: int = 9, sigma: float = 1.5, amplitude: float = 25.0) -> list[tuple[int, int, float]]:
    """(dx, dy, weight) of a square Gaussian kernel; weights are cut to whole numbers."""
    half = width // 2
    return [
        (dx, dy, float(int(amplitude * math.exp(-(dx * dx + dy * dy) / (2.0 * sigma * sigma)))))
        for dy in range(-half, half + 1)
        for dx in range(-half, half + 1)
    ]


#: half-width of each resampling kernel in source cells
SUPPORT = {"bilinear": 1.0, "cubic": 2.0}


def kernel_weight(distance: Column, method: str) -> Column:
    """Separable resampling weight at a distance in source cells."""
    d = F.abs(distance)
    if method == "bilinear":
        return F.when(d < 1, 1.0 - d).otherwise(0.0)
    if method == "cubic":  # Keys kernel, a = -0.5
        near = (1.5 * d - 2.5) * d * d + 1.0
        far = ((-0.5 * d + 2.5) * d - 4.0) * d + 2.0
        return F.when(d <= 1, near).when(d < 2, far).otherwise(0.0)
    raise ValueError(f"unknown resampling method {method}")
