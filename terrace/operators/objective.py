"""Objectives: base score, gradients and hessians."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrace.functions.metrics import sigmoid

EDGE, LEAST_HESSIAN = 1e-6, 1e-6  # fixed values


def clamped_mean(y: Column, clamp: bool = True) -> Column:
    mean = F.avg(y)
    return F.least(F.greatest(mean, F.lit(EDGE)), F.lit(1 - EDGE)) if clamp else mean


def base_score(mean: float, objective: str, clamp: bool = True) -> float:
    """The starting margin: the mean of y, clamped inside (0, 1) unless that is off for l2; its logit for logistic."""
    if clamp or objective == "logistic":
        mean = min(max(mean, EDGE), 1 - EDGE)
    return math.log(mean / (1 - mean)) if objective == "logistic" else mean


def gradient(y: Column, margin: Column, objective: str) -> Column:
    return (sigmoid(margin) if objective == "logistic" else margin) - y


def hessian(margin: Column, objective: str) -> Column:
    if objective == "l2":
        return F.lit(1.0)
    p = sigmoid(margin)
    return F.greatest(p * (1 - p), F.lit(LEAST_HESSIAN))
