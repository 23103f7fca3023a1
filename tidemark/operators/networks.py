"""Small networks trained by synchronous gradient sums: every step is a Spark job in which each task sums the gradient of its rows of the mini-batch.

The driver holds the parameters alone (some thousand numbers). Gradients are added as fixed-point numbers and rows stand in a fixed order within tasks, so that a run with
the same seed and data gives the same parameters, in whatever order tasks end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import shared_folder

#: Fixed point of the sums.
UNIT = 2.0**36


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def steady(x: float) -> float:
    """``x`` to ten digits, without the last bits of a sum that depend on the order in which tasks end."""
    return float(f"{x:.10g}")


class Network:
    """Named arrays in one flat vector of parameters."""

    shapes: dict[str, tuple[int, ...]]

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes.values())

    def parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def flat(self, parts: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([np.asarray(parts[name], float).ravel() for name in self.shapes])


class Recurrent(Network):
    """A long short-term memory cell over a window, whose last output, beside the window and ``extras`` values themselves, goes to a linear layer. The targets are numbers; the loss is their squared error.

    The direct way from the window to the output is the linear model of the window; it starts at ``linear`` if that is given, so that the cell learns what a linear model
    leaves.
    """

    def __init__(self, steps: int, hidden: int, outputs: int, extras: int = 0):
        self.steps, self.hidden, self.outputs, self.extras = steps, hidden, outputs, extras
        self.shapes = {"wx": (1, 4 * hidden), "wh": (hidden, 4 * hidden), "b": (4 * hidden,), "wo": (hidden, outputs), "ws": (steps + extras, outputs), "bo": (outputs,)}

    def start(self, seed: int, linear: Sequence[tuple[list[float], float]] | None = None) -> np.ndarray:
        r, h = np.random.default_rng(seed), self.hidden
        # Inputs lie about 0 to 1: gates that differ over that range from the start, and none of them in the output yet.
        parts = {name: np.zeros(shape) for name, shape in self.shapes.items()}
        parts["wx"], parts["wh"] = r.uniform(-3, 3, (1, 4 * h)), 0.7 * r.normal(size=(h, 4 * h)) / np.sqrt(h)
        parts["b"] = r.uniform(-1.5, 1.5, 4 * h) + np.repeat([0.0, 0.5, 0.0, 0.0], h)
        if linear is not None:
            parts["ws"], parts["bo"] = np.array([[steady(v) for v in w] for w, _ in linear]).T, np.array([steady(b) for _, b in linear])
        return self.flat(parts)

    def _forward(self, p: dict, x: np.ndarray) -> tuple[np.ndarray, list]:
        h = c = np.zeros((len(x), self.hidden))
        kept = []
        for t in range(self.steps):
            z = x[:, t : t + 1] * p["wx"] + h @ p["wh"] + p["b"]
            i, f, o = (_sigmoid(z[:, k * self.hidden : (k + 1) * self.hidden]) for k in range(3))
            g = np.tanh(z[:, 3 * self.hidden :])
            before, c = c, f * c + i * g
            squashed = np.tanh(c)
            kept.append((h, before, i, f, o, g, squashed))
            h = o * squashed
        return h, kept

    def predict(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        p = self.parts(flat)
        return self._forward(p, x)[0] @ p["wo"] + x @ p["ws"] + p["bo"]

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, noise: np.random.Generator | None = None) -> tuple[float, np.ndarray]:
        """(sum of squared errors, its gradient) of rows with window and extras x and targets y."""
        p = self.parts(flat)
        h, kept = self._forward(p, x)
        e = h @ p["wo"] + x @ p["ws"] + p["bo"] - y
        d = {name: np.zeros(shape) for name, shape in self.shapes.items()}
        d["wo"], d["ws"], d["bo"] = 2 * h.T @ e, 2 * x.T @ e, 2 * e.sum(0)
        dh, dc = 2 * e @ p["wo"].T, 0.0
        for t in range(self.steps - 1, -1, -1):
            h, before, i, f, o, g, squashed = kept[t]
            dc = dc + dh * o * (1 - squashed * squashed)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            d["wx"] += x[:, t : t + 1].T @ dz
            d["wh"] += h.T @ dz
            d["b"] += dz.sum(0)
            dh, dc = dz @ p["wh"].T, dc * f
        return float((e * e).sum()), self.flat(d)

    def loss(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
        e = self.predict(flat, x) - y
        return float((e * e).sum())


class Dense(Network):
    """Rectified layers with dropout between them, and a softmax over classes 0, 1, ...; the loss is the negative logarithm of the class's probability."""

    def __init__(self, layers: Sequence[int], dropout: float = 0.3):
        self.layers, self.dropout = list(layers), dropout
        self.shapes = {f"{k}{i}": s for i, (a, b) in enumerate(zip(layers, layers[1:])) for k, s in (("w", (a, b)), ("b", (b,)))}

    def start(self, seed: int) -> np.ndarray:
        r = np.random.default_rng(seed)
        return self.flat({name: r.normal(size=s) * np.sqrt(2 / s[0]) if len(s) == 2 else np.zeros(s) for name, s in self.shapes.items()})

    def _forward(self, p: dict, x: np.ndarray, noise: np.random.Generator | None) -> tuple[np.ndarray, list]:
        kept, last = [], len(self.layers) - 2
        for i in range(last + 1):
            z = x @ p[f"w{i}"] + p[f"b{i}"]
            mask = np.ones_like(z)
            if i < last:
                mask = (z > 0).astype(float)
                if noise is not None and self.dropout:
                    mask *= (noise.random(z.shape) >= self.dropout) / (1 - self.dropout)
            kept.append((x, mask))
            x = z * mask
        x = np.exp(x - x.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True), kept

    def predict(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self._forward(self.parts(flat), x, None)[0]

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, noise: np.random.Generator | None = None) -> tuple[float, np.ndarray]:
        p = self.parts(flat)
        found, kept = self._forward(p, x, noise)
        own = y[:, 0].astype(int)
        at = np.arange(len(x)), own
        loss, d = float(-np.log(np.maximum(found[at], 1e-300)).sum()), {}
        back = found.copy()
        back[at] -= 1
        for i in range(len(kept) - 1, -1, -1):
            held, mask = kept[i]
            back = back * mask
            d[f"w{i}"], d[f"b{i}"] = held.T @ back, back.sum(0)
            back = back @ p[f"w{i}"].T
        return loss, self.flat(d)

    def loss(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
        return float(-np.log(np.maximum(self.predict(flat, x)[np.arange(len(x)), y[:, 0].astype(int)], 1e-300)).sum())


def prepared(rows: DataFrame, key: Sequence[str], x: str, y: str, valid: str) -> DataFrame:
    """(x, y, valid, draw) of rows with arrays x and y, written in a fixed order; draw is a hash that deals rows to mini-batches."""
    path = shared_folder(rows.sparkSession, "training-rows")
    plain = rows.select(*key, F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y"), F.col(valid).alias("valid"))
    # A row's place follows from its key, however often this runs.
    dealt = plain.withColumn("draw", F.xxhash64(*key)).repartition("draw").sortWithinPartitions("draw", *key).select("x", "y", "valid", "draw")
    dealt.write.parquet(path)
    return rows.sparkSession.read.schema(dealt.schema).parquet(path)


def step_sums(rows: DataFrame, network: Network, flat: np.ndarray, batch: int, batches: int, epoch: int, seed: int) -> np.ndarray:
    """Gradient, loss and rows of a mini-batch, then loss and rows of the validation rows, over all tasks."""
    size = network.size

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros(size + 4), False
        for i, frame in enumerate(frames):
            if not len(frame):
                continue
            seen = True
            x, y, held = np.stack(frame["x"].to_numpy()), np.stack(frame["y"].to_numpy()), frame["valid"].to_numpy(bool)
            if (~held).any():
                noise = np.random.default_rng([seed, epoch, batch, i, int(frame["draw"].iloc[0]) & (1 << 63) - 1])
                loss, gradient = network.gradient(flat, x[~held], y[~held], noise)
                total[:size] += gradient
                total[size : size + 2] += loss, (~held).sum()
            if held.any():
                total[size + 2 :] += network.loss(flat, x[held], y[held]), held.sum()
        if seen:
            yield pd.DataFrame({"place": np.arange(size + 4), "value": total})

    mine = F.pmod(F.xxhash64("draw", F.lit(epoch)), F.lit(batches)) == batch
    parts = rows.where(F.col("valid") | mine).mapInPandas(sums, "place int, value double")
    fixed = F.round(F.col("value") * UNIT).cast("decimal(38,0)")
    found = parts.groupBy("place").agg(F.sum(fixed).alias("value")).collect()
    out = np.zeros(size + 4)
    for r in found:
        out[r["place"]] = float(r["value"]) / UNIT
    return out


def train(rows: DataFrame, network: Network, flat: np.ndarray, epochs: int = 12, batches: int = 3, rate: float = 0.02, patience: int = 4, seed: int = 7) -> tuple[np.ndarray, list[float]]:
    """(parameters, validation losses by step): Adam over the gradient sums of ``rows``, as ``prepared`` gives them.

    Each step also scores the parameters it begins with on the validation rows; the best ones are returned, and after ``patience`` epochs without better ones training ends. Without validation
    rows the last parameters are returned.
    """
    first, second, best, kept, since, losses, step = np.zeros_like(flat), np.zeros_like(flat), np.inf, flat, 0, [], 0
    for epoch in range(epochs):
        for batch in range(batches):
            total = step_sums(rows, network, flat, batch, batches, epoch, seed)
            n, held_loss, held = total[-3], total[-2], total[-1]
            if held:
                losses.append(held_loss / held)
                if losses[-1] < best:
                    best, kept, since = losses[-1], flat, 0
                else:
                    since += 1
            if not n:
                continue
            gradient = total[:-4] / n
            gradient *= min(1.0, 1 / max(float(np.linalg.norm(gradient)), 1e-12))
            step += 1
            first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient * gradient
            flat = flat - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        if since >= patience * batches:
            break
    if not losses:
        return flat, losses
    total = step_sums(rows.where("valid"), network, flat, 0, 1, 0, seed)
    losses.append(total[-2] / max(total[-1], 1))
    return (flat if losses[-1] < best else kept), losses


def predicted(rows: DataFrame, network: Network, flat: np.ndarray, x: str = "x", name: str = "yhats") -> DataFrame:
    """``rows`` with the network's outputs for the array in column ``x``."""

    @F.pandas_udf("array<double>")
    def outputs(windows: pd.Series) -> pd.Series:
        return pd.Series(list(network.predict(flat, np.stack(windows.to_numpy()).astype(float))) if len(windows) else [], dtype=object)

    return rows.withColumn(name, outputs(F.col(x).cast("array<double>")))
