"""Panel regressions with entity and date effects and errors clustered by entity."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelag.functions.student import two_sided_p
from tidelag.operators.panel import LAGS, roles_of
from tidelag.sources.shared import shared_dir

#: What may be left of the date effects' equations, as a share of their right side.
TOLERANCE = 1e-11


def _cut(rows: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the session names; one of our own only where it names none."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(rows.sparkSession))
    return rows.checkpoint()


@dataclass
class Panel:
    """Rows by entity: places in the calendar, and the columns one after another for each row.

    An entity has no more rows than the calendar has days, so a row of this table is bounded;
    all passes over it are map-only, and what they return is of the calendar's size.
    """

    rows: DataFrame
    columns: int
    days: int
    entities: int
    size: int

    @classmethod
    def of(cls, rows: DataFrame, entity: str, date: str, columns: list[str]) -> Panel:
        kept = rows.dropna(subset=[entity, date, *columns])
        days = sorted(r[0] for r in kept.select(date).distinct().collect())
        calendar = rows.sparkSession.createDataFrame([(d, k) for k, d in enumerate(days)], T.StructType([T.StructField(date, kept.schema[date].dataType), T.StructField("_t", T.IntegerType())]))
        values = F.array(*(F.col(c).cast("double") for c in columns))
        grouped = kept.join(F.broadcast(calendar), date).groupBy(entity).agg(F.collect_list(F.struct(F.col("_t").alias("t"), values.alias("v"))).alias("x"))
        packed = _cut(grouped.select(F.transform("x", lambda x: x["t"]).alias("t"), F.flatten(F.transform("x", lambda x: x["v"])).alias("v")))
        sizes = packed.agg(F.count("*").alias("e"), F.sum(F.size("t")).alias("n")).first()
        return cls(packed, len(columns), len(days), sizes.e, sizes.n or 0)

    def total(self, add, length: int) -> np.ndarray:
        """The sum of add(places, values) over all entities, by task, then by two steps."""
        columns = self.columns

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(length)
            for batch in batches:
                for t, v in zip(batch.t, batch.v, strict=True):
                    add(out, np.asarray(t, np.int64), np.asarray(v, float).reshape(-1, columns))
            yield pd.DataFrame({"part": [TaskContext.get().partitionId() % 16], "sums": [out.tobytes()]})

        def merge(batch: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"sums": [np.sum([np.frombuffer(x) for x in batch.sums], axis=0).tobytes()]})

        parts = self.rows.mapInPandas(run, "part int, sums binary").groupBy("part").applyInPandas(merge, "sums binary").collect()
        return np.sum([np.frombuffer(r.sums) for r in parts], axis=0) if parts else np.zeros(length)

    def date_effects(self) -> np.ndarray:
        """days x columns: effects that, with the entities' means, leave nothing to demean."""
        days, columns = self.days, self.columns

        def count(out, t, v):
            np.add.at(out, t, 1.0)

        shape = (days, columns)

        def right(out, t, v):
            np.add.at(out.reshape(shape), t, v - v.mean(axis=0))

        def spread(x: np.ndarray) -> np.ndarray:
            def add(out, t, v):
                np.add.at(out.reshape(shape), t, x[t] - x[t].mean(axis=0))

            return self.total(add, days * columns).reshape(shape)

        per_day = np.maximum(1.0, self.total(count, days))[:, None]
        effects, wanted = np.zeros(shape), self.total(right, days * columns).reshape(shape)
        left, goal = wanted, TOLERANCE * np.linalg.norm(wanted, axis=0)
        # conjugate gradients on the equations of the dates, all columns at once: one pass for each step
        ready = left / per_day
        step, size = ready, (left * ready).sum(axis=0)
        for turn in range(1, 4 * days + 20):
            if (np.linalg.norm(left, axis=0) <= goal).all():
                return effects
            if turn % (days + 5) == 0:  # rounding has moved the running residual: start again from the true one
                left = wanted - spread(effects)
                ready = left / per_day
                step, size = ready, (left * ready).sum(axis=0)
                continue
            moved = spread(step)
            length = np.divide(size, (step * moved).sum(axis=0), out=np.zeros(columns), where=size > 0)
            effects, left = effects + length * step, left - length * moved
            ready = left / per_day
            now = (left * ready).sum(axis=0)
            step, size = ready + np.divide(now, size, out=np.zeros(columns), where=size > 0) * step, now
        raise ArithmeticError("the date effects did not settle")


def within_ols(rows: DataFrame, ys: list[str], xs: list[str], entity: str, date: str = "date", debiased: bool = True, count_effects: bool = True) -> list[dict[str, float]]:
    """For each y the coefficient of ``xs[0]`` with its clustered error, t, p and the number of rows.

    Rows with a NULL in any column are left out. ``debiased`` scales the covariance for small
    samples and uses Student's t, else the normal limit.
    """
    panel = Panel.of(rows, entity, date, [*ys, *xs])
    k, m = len(xs), len(ys)
    used = k + (panel.entities + panel.days - 1 if count_effects else 1)
    nothing = {"beta": math.nan, "se": math.nan, "t": math.nan, "p": math.nan, "nobs": panel.size}
    if panel.size <= used or panel.entities < 2:
        return [dict(nothing) for _ in ys]
    effects = panel.date_effects()
    width = m + k

    def products(out, t, v):
        w = v - effects[t]
        w = w - w.mean(axis=0)
        out.reshape(width, width)[:] += w.T @ w

    gram = panel.total(products, width * width).reshape(width, width)
    scale = np.sqrt(np.diag(gram)[m:])
    if not (scale > 0).all() or np.linalg.matrix_rank(gram[m:, m:] / np.outer(scale, scale), tol=1e-10) < k:
        return [dict(nothing) for _ in ys]  # a regressor that the others or the effects explain
    inverse = np.linalg.inv(gram[m:, m:])
    betas = inverse @ gram[m:, :m]

    def meat(out, t, v):
        w = v - effects[t]
        w = w - w.mean(axis=0)
        scores = w[:, m:].T @ (w[:, :m] - w[:, m:] @ betas)
        out.reshape(m, k, k)[:] += np.einsum("im,jm->mij", scores, scores)

    middle = panel.total(meat, m * k * k).reshape(m, k, k)
    found = []
    for i in range(m):
        covariance = inverse @ middle[i] @ inverse
        if debiased:
            covariance = covariance * panel.entities / (panel.entities - 1) * (panel.size - 1) / (panel.size - used)
        error = math.sqrt(max(0.0, covariance[0, 0]))
        t = float(betas[0, i]) / error if error else math.nan
        found.append({"beta": float(betas[0, i]), "se": error, "t": t, "p": two_sided_p(t, panel.size - used if debiased else 1e9), "nobs": panel.size})
    return found


def run_panel(rows: DataFrame, direction: str = "forward", horizon_max: int = 5, **how) -> DataFrame:
    """(h, beta, se, t, p, nobs): the return h rows ahead on the signal and five own lags.

    A panel has all leads in every row, so all horizons share their rows and one demeaning.
    """
    roles = roles_of(direction)
    xs = [roles.signal, *(f"{roles.prefix}_lag_{k}" for k in range(1, LAGS + 1))]
    fits = within_ols(rows, [f"{roles.prefix}_fwd_{h}" for h in range(1, horizon_max + 1)], xs, roles.entity, **how)
    known = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    found = [(h, *(known(fit[c]) for c in ("beta", "se", "t", "p", "nobs"))) for h, fit in enumerate(fits, 1)]
    return rows.sparkSession.createDataFrame(found, "h int, beta double, se double, t double, p double, nobs bigint")


def horizon_profile(results: DataFrame, z: float = 1.96) -> DataFrame:
    """Coefficients by horizon with their confidence band: the data of the profile plot."""
    return results.select("h", "beta", "se", (F.col("beta") - z * F.col("se")).alias("low"), (F.col("beta") + z * F.col("se")).alias("high"))
