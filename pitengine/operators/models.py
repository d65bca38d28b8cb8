"""Small linear models. Spark sums each group's normal equations; only these few numbers are solved, per group, in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitengine.session import materialize


def normal_equations(rows: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, weight: str | None = None) -> DataFrame:
    """Per group n, xtx (row by row) and xty of the features with an intercept first; rows with missing values are left out."""
    known = F.lit(True)
    for c in (*features, target):
        known = known & F.col(c).isNotNull()
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    w = F.col(weight) if weight else F.lit(1.0)
    p = len(x)
    xtx = F.array(*(F.sum(w * x[i] * x[j]) for i in range(p) for j in range(p)))
    xty = F.array(*(F.sum(w * x[i] * F.col(target)) for i in range(p)))
    return rows.where(known).groupBy(*keys).agg(F.count("*").alias("n"), xtx.alias("xtx"), xty.alias("xty"))


def solve(equations: DataFrame, keys: Sequence[str], l2: float = 0.0) -> DataFrame:
    """Coefficients per group: least squares of smallest norm, or ridge with an intercept that isn't penalised."""

    def run(batches):
        for batch in batches:
            out = []
            for a, b in zip(batch.column("xtx").to_pylist(), batch.column("xty").to_pylist()):
                p = len(b)
                m = np.array(a).reshape(p, p) + l2 * np.diag([0.0] + [1.0] * (p - 1))
                out.append(np.linalg.lstsq(m, np.array(b), rcond=None)[0].tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*keys, "n")), pa.array(out, pa.list_(pa.float64()))], [*keys, "n", "coefficients"])

    kinds = ", ".join(f"`{k}` {equations.schema[k].dataType.simpleString()}" for k in keys)
    return equations.mapInArrow(run, f"{kinds}{', ' if kinds else ''}n long, coefficients array<double>")


def predictor(features: Sequence[str]):
    total = F.col("coefficients")[0]
    for k, c in enumerate(features, 1):
        total = total + F.col("coefficients")[k] * F.col(c)
    return total


def fit_glm(rows: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, family: str, rounds: int = 50, l2: float = 1e-4) -> DataFrame:
    """Poisson or logistic coefficients per group by reweighted least squares: a pass of sums a round, until none moves any more."""
    rows = materialize(rows.select(*keys, *features, target).dropna(subset=[*features, target]), "glm_rows")
    start = F.log(F.greatest(F.avg(target), F.lit(1e-9))) if family == "poisson" else F.lit(0.0)
    fitted = materialize(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(start, *(F.lit(0.0) for _ in features)).alias("coefficients")), "glm")
    for _ in range(rounds):
        scored = rows.join(fitted.select(*keys, "coefficients"), list(keys)).withColumn("_eta", F.least(F.greatest(predictor(features), F.lit(-30.0)), F.lit(30.0)))
        mu = F.exp("_eta") if family == "poisson" else 1 / (1 + F.exp(-F.col("_eta")))
        scored = scored.withColumn("_mu", mu)
        scored = scored.withColumn("_w", F.greatest(F.col("_mu") if family == "poisson" else F.col("_mu") * (1 - F.col("_mu")), F.lit(1e-9)))
        scored = scored.withColumn("_z", F.col("_eta") + (F.col(target) - F.col("_mu")) / F.col("_w"))
        before, fitted = fitted, materialize(solve(normal_equations(scored, keys, features, "_z", "_w"), keys, l2), "glm")
        both = fitted.join(before.select(*keys, F.col("coefficients").alias("_old")), list(keys))
        moved = F.exists(F.zip_with("coefficients", "_old", lambda a, b: F.abs(a - b)), lambda x: x > 1e-9)
        if both.where(moved).limit(1).count() == 0:
            break
    return fitted
