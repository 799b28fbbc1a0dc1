"""Edge evidence: robust null, prior, two-part mixture, log-odds (AGG-5..7, ML-1..4, PRJ-9)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import log_density, logit_of_cosine, upper_tail


#: Values up to this number (8 MB) are brought to the driver as one array; of more, buckets are counted first.
LOCAL = 1_000_000


def order_statistics(rows: DataFrame, column: str, ranks: list[int], local: int = LOCAL, buckets: int = 1 << 14) -> dict[int, float]:
    """rank (from 0) -> value, exactly; ``column`` has no null. Only buckets that hold a rank are looked into."""
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if low == high:
        return dict.fromkeys(ranks, low)
    if n <= local:
        x = np.sort(rows.select(column).toArrow()[column].to_numpy())
        return {r: float(x[r]) for r in ranks}
    bucket = F.least(F.floor((F.col(column) - low) / (high - low) * buckets), F.lit(buckets - 1))
    counts = rows.groupBy(bucket.alias("b")).count().toPandas().sort_values("b")  # ``buckets`` rows at most
    b, ends = counts["b"].to_numpy(), counts["count"].to_numpy().cumsum()
    held: dict[int, list[int]] = {}
    for r in ranks:
        held.setdefault(int(np.searchsorted(ends, r, side="right")), []).append(r)
    before = lambda k: int(ends[k - 1]) if k else 0
    out, few, wide = {}, [k for k in held if ends[k] - before(k) <= local], [k for k in held if ends[k] - before(k) > local]
    while few:  # as many buckets at once as fit
        some, size = [], 0
        while few and (not some or size + int(ends[few[-1]]) - before(few[-1]) <= local):
            some.append(few.pop())
            size += int(ends[some[-1]]) - before(some[-1])
        x = np.sort(rows.filter(bucket.isin([int(b[k]) for k in some])).select(column).toArrow()[column].to_numpy())
        at = 0
        for k in sorted(some):
            out |= {r: float(x[at + r - before(k)]) for r in held[k]}
            at += int(ends[k]) - before(k)
    for k in wide:
        inside = order_statistics(rows.filter(bucket == int(b[k])), column, [r - before(k) for r in held[k]], local, buckets)
        out |= {r + before(k): v for r, v in inside.items()}
    return out


def quantiles(rows: DataFrame, column: str, levels: list[float], local: int = LOCAL) -> list[float]:
    """Exact quantiles, linear between neighbouring values. No task or driver holds more than ``local`` values."""
    rows = rows.select(column).filter(F.col(column).isNotNull())
    last = rows.count() - 1
    at = [q * last for q in levels]
    values = order_statistics(rows, column, sorted({f(x) for x in at for f in (math.floor, math.ceil)}), local)
    return [values[math.floor(x)] + (values[math.ceil(x)] - values[math.floor(x)]) * (x - math.floor(x)) for x in at]


def robust_null(scores: DataFrame, column: str = "score") -> DataFrame:
    """One row: centre (median), scale (1.4826 * MAD + 1e-9), n. Of no scores: 0, 1e-9, 0 (AGG-5)."""
    n = scores.agg(F.count(column)).first()[0]
    centre = quantiles(scores, column, [0.5])[0] if n else 0.0
    mad = quantiles(scores.select(F.abs(F.col(column) - centre).alias("d")), "d", [0.5])[0] if n else 0.0
    return scores.sparkSession.createDataFrame([(centre, 1.4826 * mad + 1e-9, n)], "centre double, scale double, n long")


def upper_tail_prior(scores: DataFrame, levels: int = 100, column: str = "score", null=None) -> DataFrame:
    """One row, prior: greatest excess of upper-tail mass over the null at ``levels`` quantiles from 0.5 to 1 - 1e-5, in [1e-9, 0.5] (AGG-6).

    ``null``: as in ``fit_mixture``.
    """
    q = [0.5 + (0.5 - 1e-5) * i / (levels - 1) for i in range(levels)]
    null = null or robust_null(scores, column).first()
    at = scores.sparkSession.createDataFrame(list(zip(q, quantiles(scores, column, q), strict=True)) if null["n"] else [], "level double, t double")
    excess = (1 - F.col("level")) - upper_tail((F.col("t") - null["centre"]) / null["scale"])
    return at.agg(F.max(excess).alias("excess")).select(F.least(F.greatest(F.coalesce("excess", F.lit(1e-9)), F.lit(1e-9)), F.lit(0.5)).alias("prior"))


def em_step(scores: DataFrame, fit: dict, column: str = "score") -> DataFrame:
    """One expectation and maximisation step from ``fit`` (null_mean, null_scale, alt_mean, alt_scale, prior): mass, mean, scale (AGG-7)."""
    x = F.col(column)
    positive = math.log(fit["prior"]) + log_density(x, F.lit(fit["alt_mean"]), F.lit(fit["alt_scale"]))
    negative = math.log1p(-fit["prior"]) + log_density(x, F.lit(fit["null_mean"]), F.lit(fit["null_scale"]))
    r = 1.0 / (1.0 + F.exp(negative - positive))
    sums = scores.agg(F.sum(r).alias("mass"), F.sum(r * x).alias("sx"), F.sum(r * x * x).alias("sxx"))
    mean = F.greatest(F.col("sx") / F.col("mass"), F.lit(fit["null_mean"]))
    moved = sums.withColumn("mean", mean)
    variance = (F.col("sxx") - 2 * F.col("mean") * F.col("sx") + F.col("mean") * F.col("mean") * F.col("mass")) / F.col("mass")
    return moved.select("mass", "mean", F.sqrt(F.greatest(variance, F.lit(1e-6))).alias("scale"))


def fit_mixture(scores: DataFrame, prior: float, column: str = "score", rounds: int = 200, local: int = LOCAL, null=None) -> dict:
    """EM with a fixed null, on one array or (over ``local`` scores) by an aggregate a round; stops when the mass is under 10 or the step under 1e-9.

    ``null``: the row of ``robust_null`` of the scores, if it is known.
    """
    null = null or robust_null(scores, column).first()
    if null["n"] <= local:
        values = scores.select(column).toArrow()[column].to_numpy()
        return _fitted(null["centre"], null["scale"], prior, null["n"] and rounds, lambda fit: _em_array(values, fit))
    return _fitted(null["centre"], null["scale"], prior, rounds, lambda fit: em_step(scores, fit, column).first())


def _fitted(centre: float, spread: float, prior: float, rounds: int, step) -> dict:
    fit = {"null_mean": centre, "null_scale": spread, "alt_mean": centre + 2 * spread, "alt_scale": spread, "prior": min(max(prior, 1e-9), 0.5)}
    for _ in range(rounds):
        mass, mean, scale = step(fit)
        if not mass or mass < 10:
            break
        moved = abs(mean - fit["alt_mean"]) + abs(scale - fit["alt_scale"])
        if moved < 1e-9:
            break
        fit |= {"alt_mean": mean, "alt_scale": scale}
    return fit


def _em_array(x: np.ndarray, fit: dict) -> tuple[float, float, float]:
    """``em_step`` on an array."""
    def density(k: str) -> np.ndarray:
        return -0.5 * ((x - fit[f"{k}_mean"]) / fit[f"{k}_scale"]) ** 2 - math.log(fit[f"{k}_scale"])

    gap = np.clip(math.log1p(-fit["prior"]) + density("null") - math.log(fit["prior"]) - density("alt"), -700, 700)
    r = 1 / (1 + np.exp(gap))
    mass = float(r.sum())
    if mass < 10:
        return mass, fit["alt_mean"], fit["alt_scale"]
    mean = max(float(r @ x) / mass, fit["null_mean"])
    return mass, mean, math.sqrt(max(float(r @ (x - mean) ** 2) / mass, 1e-6))


def informative(fit: dict) -> bool:
    return all(np.isfinite(fit[k]) for k in ("null_mean", "null_scale", "alt_mean", "alt_scale")) and fit["null_scale"] >= 1e-3


def log_odds(cosine: Column, fit: dict) -> Column:
    """Posterior log-odds that a pair is a true edge."""
    s = logit_of_cosine(cosine)
    prior = math.log(fit["prior"]) - math.log1p(-fit["prior"])
    return prior + log_density(s, F.lit(fit["alt_mean"]), F.lit(fit["alt_scale"])) - log_density(s, F.lit(fit["null_mean"]), F.lit(fit["null_scale"]))


def positive_edges(pairs: DataFrame, fits: dict[str, dict], need_evidence: bool = True) -> DataFrame:
    """Pairs whose evidence over the active views is above 0.

    ``pairs`` has a cosine column for each view in ``fits``. A view is active if its
    fit is informative and (``need_evidence``) one pair at least has evidence above 0 in it;
    without an active view nothing stays (ML-2, ML-3).
    """
    scored = pairs.withColumns({f"_e_{v}": log_odds(F.col(v), fit) for v, fit in fits.items()})
    views = [v for v, fit in fits.items() if informative(fit)]
    if need_evidence and views:
        top = scored.agg(*(F.max(f"_e_{v}").alias(v) for v in views)).first()
        views = [v for v in views if (top[v] or 0) > 0]
    total = F.lit(0.0)
    for v in views:
        total = total + F.col(f"_e_{v}")
    return scored.withColumn("evidence", total).filter(F.col("evidence") > 0 if views else F.lit(False)).drop(*(f"_e_{v}" for v in fits))
