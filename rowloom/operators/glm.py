"""Generalised linear models: one aggregate per Newton step, a small solve on the driver.

Families: gaussian (identity), binomial (logit), poisson (log); an intercept is always added. Rows with a missing or
infinite response, predictor or weight take no part (``bad_rows`` counts them). The first step starts from coefficients
(``start``), from a predictor or mean given for each row (``etastart``, ``mustart``: column names), or from the family's
initial means: y itself, (w y + 0.5) / (w + 1), y + 0.1. Each step sums gradient, Hessian and the deviance of the current
coefficients in a single pass: (p + 1)^2 numbers leave the executors whatever the number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.na import all_finite, finite
from ..functions.scalars import binomial_log_density, inverse_logit, logit, normal_tail, poisson_log_density, student_tail
from ..scratch import materialise, release

FAMILIES = {"gaussian": "identity", "binomial": "logit", "poisson": "log"}


def link(family: str, mu: Column) -> Column:
    return {"gaussian": lambda m: m, "binomial": logit, "poisson": F.log}[family](mu)


def inverse_link(family: str, eta: Column) -> Column:
    return {"gaussian": lambda e: e, "binomial": inverse_logit, "poisson": F.exp}[family](eta)


def _variance(family: str, mu: Column) -> Column:
    return {"gaussian": F.lit(1.0), "binomial": mu * (1 - mu), "poisson": mu}[family]


def unit_deviance(family: str, y: Column, mu: Column) -> Column:
    ratio = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(F.lit(0.0))
    if family == "gaussian":
        return (y - mu) * (y - mu)
    if family == "binomial":
        return 2 * (ratio(y, mu) + ratio(1 - y, 1 - mu))
    return 2 * (ratio(y, mu) - (y - mu))


@dataclass
class GlmModel:
    family: str
    columns: list[str]
    response: str
    coefficients: np.ndarray
    deviance: float
    iterations: int
    converged: bool
    n: int
    hessian: np.ndarray
    null_deviance: float | None = None
    aic: float | None = None
    dispersion: float = 1.0
    residual_range: tuple[float, float] | None = None
    weight: str | None = None
    offset: str | None = None
    names: list[str] = field(default_factory=list)

    @property
    def df_null(self) -> int:
        return self.n - 1

    @property
    def rank(self) -> int:
        return min(len(self.coefficients), self.n)

    @property
    def df_residual(self) -> int:
        return self.n - self.rank

    def linear(self) -> Column:
        eta = F.lit(float(self.coefficients[0]))
        for c, b in zip(self.columns, self.coefficients[1:]):
            eta = eta + F.col(c) * F.lit(float(b))
        return eta + F.col(self.offset) if self.offset else eta

    def predict(self, df: DataFrame, kind: str = "link", mask: str | None = None) -> DataFrame:
        """``df`` with ``prediction`` on the scale of the predictor ('link') or the response; null for bad rows and
        where the column ``mask`` is not 1."""
        if kind not in ("link", "response"):
            raise ValueError("kind must be link or response")
        value = self.linear() if kind == "link" else inverse_link(self.family, self.linear())
        asked = all_finite([F.col(c) for c in self.columns])
        if mask:
            asked = asked & F.coalesce(F.col(mask).cast("double") == 1, F.lit(False))
        return df.withColumn("prediction", F.when(asked, value))

    def fitted(self, df: DataFrame) -> DataFrame:
        """``df`` with ``fitted``: means of the response."""
        return self.predict(df, "response").withColumnRenamed("prediction", "fitted")

    def working_weights(self, df: DataFrame) -> DataFrame:
        """``df`` with ``working_weight``: prior weight times the variance at the fitted mean."""
        mu, w = inverse_link(self.family, self.linear()), F.col(self.weight) if self.weight else F.lit(1.0)
        return df.withColumn("working_weight", F.when(all_finite([F.col(c) for c in self.columns]), w * _variance(self.family, mu)))

    def residuals(self, df: DataFrame, kind: str = "deviance") -> DataFrame:
        """``df`` with ``residual``: deviance, pearson, working (also partial) or response."""
        y, mu = F.col(self.response).cast("double"), inverse_link(self.family, self.linear())
        w = F.col(self.weight) if self.weight else F.lit(1.0)
        value = {
            "response": y - mu, "pearson": (y - mu) * F.sqrt(w) / F.sqrt(_variance(self.family, mu)), "working": (y - mu) / (_variance(self.family, mu) if self.family != "gaussian" else F.lit(1.0)),
            "deviance": F.signum(y - mu) * F.sqrt(F.greatest(F.lit(0.0), w * unit_deviance(self.family, y, mu))),
        }
        value["partial"] = value["working"]
        good = all_finite([F.col(c) for c in [*self.columns, self.response]])
        return df.withColumn("residual", F.when(good, value[kind]))

    def covariance(self) -> np.ndarray:
        return np.linalg.inv(self.hessian) * self.dispersion

    def summary(self) -> list[dict]:
        """term, estimate, std_error, statistic, p_value: z tests with known dispersion, t tests otherwise."""
        errors = np.sqrt(np.diag(self.covariance()))
        out = []
        for name, b, se in zip(["(Intercept)", *self.columns], self.coefficients, errors):
            stat = b / se if se > 0 else math.nan
            p = student_tail(stat, self.df_residual) if self.family == "gaussian" else normal_tail(stat)
            out.append({"term": name, "estimate": float(b), "std_error": float(se), "statistic": float(stat), "p_value": float(p)})
        return out

    def __str__(self) -> str:
        lines = [f"{self.family} model of {self.response}, {self.n} rows, {self.iterations} steps" + ("" if self.converged else " (not converged)")]
        lines += [f"{r['term']:>16} {r['estimate']:14.6g} {r['std_error']:12.4g} {r['statistic']:10.4g} {r['p_value']:10.4g}" for r in self.summary()]
        return "\n".join([*lines, f"deviance {self.deviance:.6g} on {self.df_residual} degrees of freedom"])

    def to_dict(self) -> dict:
        return {"kind": "glm", "family": self.family, "columns": self.columns, "response": self.response, "coefficients": self.coefficients.tolist(), "summary": self.summary()}


def complete_cases(df: DataFrame, response: str, columns: list[str], weight: str | None = None, offset: str | None = None, na_action: str = "exclude", given: str | None = None) -> DataFrame:
    used = [response, *columns, *[c for c in (weight, offset, given) if c]]
    good = all_finite([F.col(c) for c in used])
    if na_action == "fail" and not df.where(~good).isEmpty():
        raise ValueError("missing values")
    return df.where(good).select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys(used)])


def bad_rows(df: DataFrame, response: str, columns: list[str]) -> dict[str, int]:
    """How many rows have a missing or infinite response, predictor, or either: one aggregate."""
    y, x = finite(F.col(response)), all_finite([F.col(c) for c in columns])
    r = df.agg(F.count_if(~y).alias("response"), F.count_if(~x).alias("predictors"), F.count_if(~(y & x)).alias("either")).first()
    return r.asDict()


def initial_mean(family: str, y: Column, w: Column) -> Column:
    return {"gaussian": y, "binomial": (w * y + 0.5) / (w + 1), "poisson": y + 0.1}[family]


def _first_step(rows: DataFrame, family: str, response: str, columns: list[str], weight: str | None, offset: str | None, eta: Column, mu: Column) -> tuple[np.ndarray, float]:
    """Coefficients of the weighted least squares on the working response at (eta, mu), and the deviance there."""
    y, w = F.col(response), F.col(weight) if weight else F.lit(1.0)
    x = [F.lit(1.0), *[F.col(c) for c in columns]]
    base = rows.withColumn("__v", w * _variance(family, mu)).withColumn("__z", F.col("__v") * (eta - (F.col(offset) if offset else F.lit(0.0))) + w * (y - mu))
    p = len(x)
    sums = [F.sum(x[a] * F.col("__z")).alias(f"z{a}") for a in range(p)] + [F.sum(x[a] * x[b] * F.col("__v")).alias(f"h{a}_{b}") for a in range(p) for b in range(a, p)]
    r = base.agg(*sums, F.sum(w * unit_deviance(family, y, mu)).alias("d")).first()
    h = np.array([[r[f"h{min(a, b)}_{max(a, b)}"] for b in range(p)] for a in range(p)])
    return np.linalg.solve(h, np.array([r[f"z{a}"] for a in range(p)])), float(r["d"])


def newton_sums(rows: DataFrame, family: str, response: str, columns: list[str], theta: np.ndarray, weight: str | None = None, offset: str | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(gradient of the log-likelihood, Hessian with changed sign, deviance, rows) at ``theta``: one aggregate."""
    x = [F.lit(1.0), *[F.col(c) for c in columns]]
    eta = F.col(offset) if offset else F.lit(0.0)
    for c, b in zip(x, theta):
        eta = eta + c * F.lit(float(b))
    y, w = F.col(response), F.col(weight) if weight else F.lit(1.0)
    mu = inverse_link(family, eta)
    base = rows.withColumn("__mu", mu).withColumn("__r", w * (y - F.col("__mu"))).withColumn("__v", w * _variance(family, F.col("__mu"))).withColumn("__d", w * unit_deviance(family, y, F.col("__mu")))
    p = len(x)
    sums = [F.sum(x[a] * F.col("__r")).alias(f"g{a}") for a in range(p)]
    sums += [F.sum(x[a] * x[b] * F.col("__v")).alias(f"h{a}_{b}") for a in range(p) for b in range(a, p)]
    r = base.agg(*sums, F.sum("__d").alias("d"), F.count_if(w > 0).alias("n")).first()
    if not r["n"]:
        raise ValueError("no complete rows")
    h = np.zeros((p, p))
    for a in range(p):
        for b in range(a, p):
            h[a, b] = h[b, a] = r[f"h{a}_{b}"]
    return np.array([r[f"g{a}"] for a in range(p)]), h, float(r["d"]), int(r["n"])


def fit_glm(df: DataFrame, response: str, columns: list[str], family: str = "gaussian", weight: str | None = None, offset: str | None = None, start: np.ndarray | None = None, epsilon: float = 1e-8, maxit: int = 25, na_action: str = "exclude", complete: bool = True, etastart: str | None = None, mustart: str | None = None) -> GlmModel:
    if family not in FAMILIES:
        raise ValueError(f"family must be one of {sorted(FAMILIES)}")
    if epsilon <= 0 or maxit < 1:
        raise ValueError("epsilon and maxit must be positive")
    given = etastart or mustart
    rows = complete_cases(df, response, columns, weight, offset, na_action, given)
    lo, hi = rows.agg(F.min(response), F.max(response)).first()
    if lo is None:
        raise ValueError("no complete rows")
    if family == "binomial" and not 0 <= lo <= hi <= 1:
        raise ValueError("binomial responses must lie in [0, 1]")
    if family == "poisson" and lo < 0:
        raise ValueError("poisson responses must not be negative")
    if start is not None:
        theta, before = np.asarray(start, float), None
    else:
        w = F.col(weight) if weight else F.lit(1.0)
        mu = inverse_link(family, F.col(etastart)) if etastart else F.col(mustart) if mustart else initial_mean(family, F.col(response), w)
        theta, before = _first_step(rows, family, response, columns, weight, offset, F.col(etastart) if etastart else link(family, mu), mu)
    g, h, dev, n = newton_sums(rows, family, response, columns, theta, weight, offset)
    if not math.isfinite(dev):
        raise ArithmeticError("the starting values give no finite deviance")
    settled = lambda new, old: abs(new - old) / (0.1 + abs(new)) < epsilon
    it, converged = 0, False
    if before is not None:  # the least squares on the starting means was the first iteration
        it, converged = 1, family == "gaussian" or settled(dev, before)
    while not converged and it < maxit:
        it += 1
        step = np.linalg.solve(h, g)
        for _ in range(maxit):
            new = theta + step
            g2, h2, dev2, n = newton_sums(rows, family, response, columns, new, weight, offset)
            if math.isfinite(dev2):
                break
            step = step / 2
        else:
            raise ArithmeticError("step halving found no finite deviance")
        theta, g, h = new, g2, h2
        converged = family == "gaussian" or settled(dev2, dev)
        dev = dev2
    if not converged and it == 1:
        raise ArithmeticError("no convergence at the first iteration")
    m = GlmModel(family, columns, response, theta, dev, it, converged, n, h, weight=weight, offset=offset)
    if family == "gaussian":
        m.dispersion = dev / max(1, m.df_residual)
    if complete:
        _complete(m, rows)
    return m


def _complete(m: GlmModel, rows: DataFrame) -> None:
    """Null deviance, AIC and the range of the deviance residuals."""
    y, w = F.col(m.response), F.col(m.weight) if m.weight else F.lit(1.0)
    mean = rows.agg(F.sum(w * y) / F.sum(w)).first()[0]
    mu = inverse_link(m.family, m.linear())
    if m.family == "gaussian":
        like = F.lit(0.0)
    elif m.family == "binomial":
        like = w * binomial_log_density(y, mu)
    else:
        like = w * poisson_log_density(y, mu)
    res = m.residuals(rows)
    r = res.agg(F.sum(w * unit_deviance(m.family, y, F.lit(float(mean)))).alias("null"), F.sum(like).alias("like"), F.sum(F.log(w)).alias("lw"), F.min("residual").alias("lo"), F.max("residual").alias("hi")).first()
    m.null_deviance, m.residual_range = float(r["null"]), (float(r["lo"]), float(r["hi"]))
    if m.family == "gaussian":
        m.aic = m.n * (math.log(2 * math.pi * m.deviance / m.n) + 1) + 2 - r["lw"] + 2 * m.rank
    else:
        m.aic = -2 * float(r["like"]) + 2 * m.rank


def fold_of(key: str, k: int, seed: int = 0) -> Column:
    """Fold 0 .. k - 1 by a seeded hash of a row key: the same on every cluster."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(k)).cast("int")


def _cost(m: GlmModel, rows: DataFrame) -> float:
    scored = m.predict(rows, "response").where("prediction IS NOT NULL")
    d = F.col(m.response).cast("double") - F.col("prediction")
    return float(scored.agg(F.avg(d * d)).first()[0])


def split_validation(df: DataFrame, model: GlmModel, key: str, percent: float = 30, seed: int = 0) -> tuple[float, float]:
    """(cost, adjusted cost) with about ``percent`` of the rows held out."""
    if not 0 < percent < 100:
        raise ValueError("percent must lie between 0 and 100")
    mark = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(10_000)) < F.lit(int(percent * 100))
    rows = df.select(*_used(model, key)).withColumn("__out", mark)
    part = fit_glm(rows.where(~F.col("__out")), model.response, model.columns, model.family, model.weight, model.offset, complete=False)
    cost = _cost(part, rows.where("__out"))
    return cost, cost + _cost(model, rows) - _cost(part, rows)


def cross_validation(df: DataFrame, model: GlmModel, key: str, k: int = 10, seed: int = 0) -> tuple[float, float]:
    """(cost, adjusted cost) over k folds, each with the same say."""
    if not 2 <= k <= max(100, model.n):
        raise ValueError("K must be at least 2 and at most the number of rows or 100")
    rows = materialise(df.select(*_used(model, key)).withColumn("__fold", fold_of(key, k, seed)), "folds")
    cost, adjusted = 0.0, _cost(model, rows)
    for f in range(k):
        part = fit_glm(rows.where(F.col("__fold") != f), model.response, model.columns, model.family, model.weight, model.offset, complete=False)
        cost += _cost(part, rows.where(F.col("__fold") == f)) / k
        adjusted -= _cost(part, rows) / k
    release(rows)
    return cost, cost + adjusted


def _used(model: GlmModel, key: str) -> list[str]:
    return list(dict.fromkeys([key, model.response, *model.columns, *[c for c in (model.weight, model.offset) if c]]))
