"""Vectors, losses, likelihoods and small models. Parameters are small arrays; frames stay in the JVM where they can."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.arrays import mse, nll_of
from turnloom.functions.columns import finite

#: Most rows a driver-side fit takes: a bounded sample in the order of a hash.
FIT_ROWS = 50_000


def reduced(clips: DataFrame, groups: list[str], mean: str = "mean", duration: str = "duration_s") -> DataFrame:
    """Mean of clip means, and mean weighted by duration over clips with a finite mean and a positive duration.

    Duration and number count all clips.
    """
    m, d = finite(mean), finite(duration)
    ok = m.isNotNull() & (d > 0)
    g = clips.groupBy(*groups).agg(F.avg(m).alias("unweighted"), F.sum(F.when(ok, m * d)).alias("_md"), F.sum(F.when(ok, d)).alias("_d"), F.sum(d).alias("duration_s"), F.count(F.lit(1)).alias("n_clips"))
    return g.select(*groups, "unweighted", F.try_divide("_md", "_d").alias("duration_weighted"), "duration_s", "n_clips")


def perplexity(nll: Column) -> Column:
    return F.exp(nll)


def step_nll(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Mean NLL per step over the unmasked codebooks: tokens have keys, t, target, logits, mask."""
    scored = tokens.withColumn("nll", F.when(F.col("mask"), nll_of("logits", "target")))
    return scored.groupBy(*keys, "t").agg(F.avg("nll").alias("nll"), F.count("nll").alias("n_tokens"))


def moments(frames: DataFrame, groups: list[str], vector: str = "vec") -> DataFrame:
    """Population moments of vectors against the standard normal: squared means, variance error, off-diagonal
    covariance, energy. With one vector the variance and covariance parts are 0.

    Covariances are sums over element products of each vector, so no vector meets another one.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    base = frames.select(*groups, v.alias("_v"))
    each = base.select(*groups, F.posexplode("_v").alias("_i", "_x"))
    dims = each.groupBy(*groups, "_i").agg(F.avg("_x").alias("_m"), F.var_pop("_x").alias("_s"), F.count(F.lit(1)).alias("_n"))
    diag = dims.groupBy(*groups).agg(F.sum(F.col("_m") * F.col("_m")).alias("mean_part"), F.when(F.max("_n") > 1, F.avg((F.col("_s") - 1) * (F.col("_s") - 1))).otherwise(0.0).alias("var_part"), F.count(F.lit(1)).alias("dims"), F.max("_n").alias("n"))
    pairs = base.select(*groups, "_v", F.posexplode("_v").alias("_i", "_x")).select(*groups, "_i", "_x", F.posexplode("_v").alias("_j", "_y")).where("_i < _j")
    cov = pairs.groupBy(*groups, "_i", "_j").agg(F.covar_pop("_x", "_y").alias("_c")).groupBy(*groups).agg((2 * F.sum(F.col("_c") * F.col("_c"))).alias("_off"))
    energy = each.groupBy(*groups).agg(F.sum(F.col("_x") * F.col("_x")).alias("_sq"))
    j = diag.join(cov, groups, "left").join(energy, groups)
    cov_part = F.when(F.col("n") > 1, F.coalesce(F.col("_off") / F.col("dims"), F.lit(0.0))).otherwise(0.0)
    out = j.select(*groups, "n", "mean_part", "var_part", cov_part.alias("cov_part"), (0.5 * F.col("_sq") / F.col("n")).alias("energy"))
    return out.withColumn("total", F.col("mean_part") + F.col("var_part") + F.col("cov_part"))


def softmax_fit(x: np.ndarray, y: np.ndarray, classes: list[str], steps: int = 1000, rate: float = 0.1, l2: float = 1e-4) -> dict[str, np.ndarray]:
    """Class-balanced linear softmax on standardised features, full-batch descent."""
    code = np.array([classes.index(v) for v in y])
    share = np.bincount(code, minlength=len(classes))
    if (share == 0).any():
        raise ValueError("every class needs a row")
    centre, scale = x.mean(0), x.std(0)
    scale[scale < 1e-8] = 1.0
    z = (x - centre) / scale
    w, b = np.zeros((x.shape[1], len(classes))), np.zeros(len(classes))
    goal, weight = np.eye(len(classes))[code], (len(y) / (len(classes) * share[code]))[:, None] / len(y)
    for _ in range(steps):
        error = (softmax(z @ w + b) - goal) * weight
        w -= rate * (z.T @ error + l2 * w)
        b -= rate * error.sum(0)
    return {"centre": centre, "scale": scale, "w": w, "b": b}


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def softmax_scored(frames: DataFrame, model: dict[str, np.ndarray], features: str, out: str = "p") -> DataFrame:
    return _mapped(frames, lambda x: softmax((x - model["centre"]) / model["scale"] @ model["w"] + model["b"]), features, out)


def mlp_init(sizes: list[int], seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(seed)
    return [(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]


def mlp_forward(layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        if i + 1 < len(layers):
            x = np.maximum(x, 0)
    return x


def mlp_fit(layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, z: np.ndarray, steps: int = 200, rate: float = 0.05, lam: float = 0.0, batch: int = 256, seed: int = 0) -> list[float]:
    """Minibatch descent on MSE plus lam times the energy of the prediction; gives the loss of each step."""
    rng = np.random.default_rng(seed)
    losses = []
    for _ in range(steps):
        at = rng.integers(0, len(x), min(batch, len(x)))
        acts = [x[at]]
        for i, (w, b) in enumerate(layers):
            y = acts[-1] @ w + b
            acts.append(np.maximum(y, 0) if i + 1 < len(layers) else y)
        d = acts[-1] - z[at]
        losses.append(float((d * d).mean() + lam * 0.5 * (acts[-1] ** 2).sum(1).mean()))
        g = 2 * d / d.size + lam * acts[-1] / len(at)
        for i in range(len(layers) - 1, -1, -1):
            w, b = layers[i]
            gw, gb = acts[i].T @ g, g.sum(0)
            g = (g @ w.T) * (acts[i] > 0)
            layers[i] = (w - rate * gw, b - rate * gb)
    return losses


def predicted(frames: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]], features: str, out: str = "pred") -> DataFrame:
    """Adds the network's output for every frame; the weights travel with the function, a batch at a time is scored."""
    return _mapped(frames, lambda x: mlp_forward(layers, x), features, out)


def mlp_loss(frames: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]], features: str, target: str, lam: float = 0.0) -> DataFrame:
    """Mean squared error plus lam times the whole regulariser of the predictions, over all frames: one row."""
    return regularised(predicted(frames, layers, features), "pred", target, lam).select("loss")


def regularised(frames: DataFrame, pred: str, target: str, lam: float) -> DataFrame:
    """(mse, regulariser, loss): the regulariser is the ``total`` of ``moments`` of the predictions."""
    one = F.lit(1).alias("_all")
    error = frames.select(one, mse(pred, target).alias("_e")).groupBy("_all").agg(F.avg("_e").alias("mse"))
    m = moments(frames.select(one, F.col(pred).alias("_p")), ["_all"], "_p").select("_all", F.col("total").alias("regulariser"))
    return error.join(m, "_all").select("mse", "regulariser", (F.col("mse") + lam * F.col("regulariser")).alias("loss"))


def projected(frames: DataFrame, features: str, width: int, seed: int, out: str = "proj") -> DataFrame:
    """Gaussian projection to a fixed width with variance 1 / width; the matrix comes from the seed."""
    made: dict[int, np.ndarray] = {}

    def work(x: np.ndarray) -> np.ndarray:
        if x.shape[1] not in made:
            made[x.shape[1]] = np.random.default_rng(seed).normal(0.0, 1 / np.sqrt(width), (x.shape[1], width))
        return np.einsum("ij,jk->ik", x, made[x.shape[1]])  # row by row in one order, however rows are batched

    return _mapped(frames, work, features, out)


def orthogonal(frames: DataFrame, features: str, width: int, seed: int, out: str = "proj") -> DataFrame:
    """Projection on ``width`` orthonormal directions, from the QR of a seeded Gaussian matrix."""
    made: dict[int, np.ndarray] = {}

    def work(x: np.ndarray) -> np.ndarray:
        if x.shape[1] not in made:
            made[x.shape[1]] = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], width)))[0]
        return np.einsum("ij,jk->ik", x, made[x.shape[1]])  # row by row in one order, however rows are batched

    return _mapped(frames, work, features, out)


def _mapped(frames: DataFrame, work: Callable[[np.ndarray], np.ndarray], features: str, out: str) -> DataFrame:
    schema = frames.drop(out).withColumn(out, F.array().cast("array<double>")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[features].to_numpy()).astype(float)
                yield pdf.assign(**{out: list(work(x))})

    return frames.drop(out).mapInPandas(run, schema)


def fit_sample(frames: DataFrame, columns: list[str], order: list[str], rows: int = FIT_ROWS) -> pd.DataFrame:
    """At most ``rows`` rows for a driver-side fit, in the order of a hash of ``order``."""
    return frames.select(*columns, *[c for c in order if c not in columns]).orderBy(F.xxhash64(*order), *order).limit(rows).toPandas()
