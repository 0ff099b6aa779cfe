"""Quantiles of the normal distribution."""

from statistics import NormalDist


def inverse_normal_cdf(p: float) -> float:
    """A constant of a run, so a plain number on the driver."""
    if not 0 < p < 1:
        raise ValueError("p is between 0 and 1")
    return NormalDist().inv_cdf(p)
