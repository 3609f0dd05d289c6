"""Bayesian regression of targets by variational updates from sums of products."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.lineage import if_small
from tessella.operators.models import ONE, Sums, _per_target


def _log_sigma(n: float, left: float) -> tuple[float, float, float]:
    """(mean, variance, expected 1 / sigma^2) of the normal of ln(sigma) that fits best, for n values and an expected sum of squares.

    Its mean u solves n + u = left * exp(-2 u + 2 v) with v = 1 / (2 (n + u) + 1), which falls in u; the prior is a standard normal.
    """
    low, high = -n + 1e-9, 50.0
    for _ in range(200):
        u = (low + high) / 2
        v = 1 / (2 * (n + u) + 1)
        if math.log(max(left, 1e-300)) - 2 * u + 2 * v > math.log(n + u):
            low = u
        else:
            high = u
    return u, v, (n + u) / max(left, 1e-300)


def variational_fit(g: np.ndarray, c: np.ndarray, yy: float, n: float, prior_sd: float = 0.1, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, float]:
    """(means, covariance, sigma) of coefficients with normal priors around 0 and a log-normal sigma, from sums of products.

    The posterior is taken as one normal of all coefficients times one of ln(sigma), which are set by turns until neither moves.
    """
    precision, last = 1.0, None
    for _ in range(rounds):
        cov = np.linalg.inv(precision * g + np.eye(len(g)) / prior_sd**2)
        mean = precision * cov @ c
        left = max(yy - 2 * mean @ c + mean @ g @ mean, 0.0) + float(np.sum(cov * g))
        u, _, precision = _log_sigma(n, left)
        if last is not None and np.abs(mean - last).max(initial=0) < 1e-12:
            break
        last = mean
    return mean, cov, math.exp(u)


def variational_betas(sums: DataFrame, design: DataFrame, keys: list[str] = (), prior_sd: float = 0.1, width: float = 1.959964) -> DataFrame:
    """(keys, target, factor, beta, sd, lo, hi, sigma, n_cells) of each target on its factors and an intercept, per ``keys``.

    sums: ``models.products``; design: (target, factor, pos).  Sums over cells are made in all tasks; a target's own table, of its
    factors by factors, is one task's.  A target without cells has no rows; columns that are 0 throughout keep their prior.
    """
    keys = list(keys)
    factors = design.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "factor"))), lambda x: x["factor"]).alias("_factors"))
    types = {f.name: f.dataType.simpleString() for f in sums.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Sums(pdf["f1"].tolist(), pdf["f2"].tolist(), pdf["xy"].to_numpy(float))
        target, names = pdf["target"].iat[0], [ONE, *pdf["_factors"].iat[0]]
        n = s.of([ONE], [ONE])[0, 0]
        mean, cov, sigma = variational_fit(s.of(names, names), s.of(names, [target])[:, 0], s.of([target], [target])[0, 0], n, prior_sd)
        sd = np.sqrt(np.diag(cov))
        out = pd.DataFrame({"target": target, "factor": ["(intercept)", *names[1:]], "beta": mean, "sd": sd, "lo": mean - width * sd, "hi": mean + width * sd, "sigma": sigma, "n_cells": int(n)})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iat[0])
        return out

    rows = _per_target(sums, design, keys, []).drop("pos").join(if_small(factors), "target")
    return rows.groupBy(*keys, "target").applyInPandas(run, "".join(f"{k} {types[k]}, " for k in keys) + "target string, factor string, beta double, sd double, lo double, hi double, sigma double, n_cells long")
