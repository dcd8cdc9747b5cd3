"""Out-of-fold motion models: what a vessel's last steps say about its next one.

A model is trained for each fold on the vessels of all other folds and applied to the fold's own, so no vessel is judged
by a model that saw it.  Training takes at most ``max_rows`` sequences (the smallest values of an arithmetic hash), a
documented bound; prediction covers every sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slickwake.operators.anomaly import vessel_folds
from slickwake.sources.scratch import stored


class Standard:
    def fit(self, a: np.ndarray) -> Standard:
        self.mean, s = a.mean(axis=0), a.std(axis=0)
        self.scale = np.where(s > 0, s, 1.0)
        return self

    def to(self, a):
        return (a - self.mean) / self.scale

    def back(self, a):
        return a * self.scale + self.mean


def _adam(params: list[np.ndarray], grads, state: dict, rate: float) -> None:
    state["t"] = state.get("t", 0) + 1
    for i, (p, g) in enumerate(zip(params, grads, strict=True)):
        m, v = state.setdefault(i, (np.zeros_like(p), np.zeros_like(p)))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        state[i] = m, v
        p -= rate * (m / (1 - 0.9 ** state["t"])) / (np.sqrt(v / (1 - 0.999 ** state["t"])) + 1e-8)


class Dense:
    """Two hidden layers over the flattened history."""

    def __init__(self, epochs: int = 60, hidden: tuple[int, int] = (64, 32), seed: int = 0):
        self.epochs, self.hidden, self.rng = epochs, hidden, np.random.default_rng(seed)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Dense:
        x = x.reshape(len(x), -1)
        sizes = [x.shape[1], *self.hidden, y.shape[1]]
        self.p = [q for a, b in zip(sizes, sizes[1:], strict=False) for q in (self.rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b))]
        state: dict = {}
        for _ in range(self.epochs):
            for at in np.array_split(self.rng.permutation(len(x)), max(1, len(x) // 200)):
                acts = [x[at]]
                for i in range(0, len(self.p), 2):
                    z = acts[-1] @ self.p[i] + self.p[i + 1]
                    acts.append(np.maximum(z, 0) if i < len(self.p) - 2 else z)
                d, grads = 2 * (acts[-1] - y[at]) / len(at), []
                for i in range(len(self.p) - 2, -1, -2):
                    grads[:0] = [acts[i // 2].T @ d + 1e-3 * self.p[i] / len(x), d.sum(axis=0)]
                    d = (d @ self.p[i].T) * (acts[i // 2] > 0)
                _adam(self.p, grads, state, 1e-3)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        a = x.reshape(len(x), -1)
        for i in range(0, len(self.p), 2):
            a = a @ self.p[i] + self.p[i + 1]
            a = np.maximum(a, 0) if i < len(self.p) - 2 else a
        return a


class Recurrent:
    """A tanh recurrence over the history; its last state goes through a linear or a one-layer head."""

    def __init__(self, epochs: int = 25, width: int = 24, head: str = "linear", seed: int = 0):
        self.epochs, self.width, self.head, self.rng = epochs, width, head, np.random.default_rng(seed)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Recurrent:
        n, w, k = x.shape[2], self.width, y.shape[1]
        g = lambda a, b: self.rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.p = [g(n, w), g(w, w) * 0.5, np.zeros(w)] + ([g(w, k), np.zeros(k)] if self.head == "linear" else [g(w, 32), np.zeros(32), g(32, k), np.zeros(k)])
        state: dict = {}
        for _ in range(self.epochs):
            for at in np.array_split(self.rng.permutation(len(x)), max(1, len(x) // 128)):
                xs = x[at]
                hs = self._states(xs)
                out, mid = self._head(hs[-1])
                d = 2 * (out - y[at]) / len(at)
                grads = [np.zeros_like(q) for q in self.p]
                if mid is None:
                    grads[3], grads[4] = hs[-1].T @ d, d.sum(axis=0)
                    dh = d @ self.p[3].T
                else:
                    grads[5], grads[6] = mid.T @ d, d.sum(axis=0)
                    dm = (d @ self.p[5].T) * (mid > 0)
                    grads[3], grads[4] = hs[-1].T @ dm, dm.sum(axis=0)
                    dh = dm @ self.p[3].T
                for t in range(xs.shape[1] - 1, -1, -1):
                    dz = dh * (1 - hs[t + 1] ** 2)
                    grads[0] += xs[:, t].T @ dz
                    grads[1] += hs[t].T @ dz
                    grads[2] += dz.sum(axis=0)
                    dh = dz @ self.p[1].T
                norm = np.sqrt(sum(float((q * q).sum()) for q in grads))
                _adam(self.p, [q * min(1.0, 5.0 / (norm + 1e-12)) for q in grads], state, 3e-3)
        return self

    def _states(self, x: np.ndarray) -> list[np.ndarray]:
        hs = [np.zeros((len(x), self.width))]
        for t in range(x.shape[1]):
            hs.append(np.tanh(x[:, t] @ self.p[0] + hs[-1] @ self.p[1] + self.p[2]))
        return hs

    def _head(self, h: np.ndarray):
        if self.head == "linear":
            return h @ self.p[3] + self.p[4], None
        mid = np.maximum(h @ self.p[3] + self.p[4], 0)
        return mid @ self.p[5] + self.p[6], mid

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._head(self._states(x)[-1])[0]


def _make(name: str, seed: int):
    return {"MLP": lambda: Dense(seed=seed), "RNN": lambda: Recurrent(seed=seed), "MLP+RNN": lambda: Recurrent(head="mlp", seed=seed)}[name]()


def out_of_fold(seqs: DataFrame, *, n_folds: int = 4, models: tuple[str, ...] = ("MLP", "RNN", "MLP+RNN"), max_rows: int = 6000, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(``mmsi, segment_id, es, pred_error_m, oof_model``; mean error of each model) for sequences ``x, y1, y2``.

    A fold with fewer than 20 training rows predicts 0, which is the constant-velocity step.  The model with the
    smallest mean error is used; ``CV`` is constant velocity itself.
    """
    seqs = stored(seqs, "sequences")
    rows = stored(seqs.join(vessel_folds(seqs, n_folds, seed), "mmsi"), "folded")
    draw = F.pmod(F.col("es").cast("long") * 31 + F.col("mmsi") * 17, F.lit(1_000_003))
    sample = rows.withColumn("_d", draw).orderBy("_d", "mmsi", "es").limit(max_rows).select("fold", "x", "y1", "y2")
    train = sample.toPandas()  # at most max_rows rows
    shared = seqs.sparkSession.sparkContext.broadcast(train)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import cloudpickle

        t = shared.value
        for pdf in batches:
            for fold, name in zip(pdf["fold"], pdf["model"], strict=True):
                part = t[t["fold"] != fold]
                blob = b""
                if len(part) >= 20:
                    x = np.stack([np.stack(v) for v in part["x"]]).astype(float)
                    y = part[["y1", "y2"]].to_numpy(float)
                    sx, sy = Standard().fit(x.reshape(len(x), -1)), Standard().fit(y)
                    model = _make(name, seed).fit(sx.to(x.reshape(len(x), -1)).reshape(x.shape), sy.to(y))
                    blob = cloudpickle.dumps((sx, sy, model))
                yield pd.DataFrame({"fold": [fold], "model": [name], "blob": [blob]})

    jobs = rows.select("fold").distinct().crossJoin(seqs.sparkSession.createDataFrame([(m,) for m in models], "model string"))
    fitted = {(r["fold"], r["model"]): r["blob"] for r in jobs.repartition(len(models) * n_folds, "fold", "model").mapInPandas(fit, "fold int, model string, blob binary").collect()}
    known = seqs.sparkSession.sparkContext.broadcast(fitted)  # folds x models small networks

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import cloudpickle

        loaded = {k: cloudpickle.loads(v) if v else None for k, v in known.value.items()}
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack([np.stack(v) for v in pdf["x"]]).astype(float)
            y = pdf[["y1", "y2"]].to_numpy(float)
            out = pdf[["mmsi", "segment_id", "es"]].copy()
            out["CV"] = np.hypot(y[:, 0], y[:, 1])
            for name in models:
                p = np.zeros_like(y)
                for fold in pdf["fold"].unique():
                    on = (pdf["fold"] == fold).to_numpy()
                    if got := loaded.get((fold, name)):
                        sx, sy, model = got
                        p[on] = sy.back(model.predict(sx.to(x[on].reshape(on.sum(), -1)).reshape(x[on].shape)))
                out[name] = np.hypot(*(y - p).T)
            yield out

    names = ("CV", *models)
    errors = rows.select("mmsi", "segment_id", "es", "fold", "x", "y1", "y2").mapInPandas(apply, "mmsi long, segment_id long, es double, " + ", ".join(f"`{n}` double" for n in names))
    errors = stored(errors, "oof")
    means = errors.select(*(F.avg(f"`{n}`").alias(n) for n in names)).unpivot([], [f"`{n}`" for n in names], "model", "mean_error_m")
    best = means.orderBy("mean_error_m", "model").first()["model"].strip("`")
    return errors.select("mmsi", "segment_id", "es", F.col(f"`{best}`").alias("pred_error_m"), F.lit(best).alias("oof_model")), means
