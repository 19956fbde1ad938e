"""Refinement of boundaries: small networks that predict how far a boundary point is off, trained on batches spread over tasks.

A round broadcasts some KB of weights; each task sums the gradients of its batches, the sums meet by parameter
in a shuffle, and the driver takes one step. Neither rows nor gradients of single batches leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.operators.polylines import median_filtered
from lamina.operators.staging import kept

#: Hidden layers of the two models.
HIDDEN = {"mlp": (64, 32), "residual": (64, 64)}
BATCH = 256
#: Keys of what is summed besides gradients: training loss and rows, validation loss and rows.
_LOSS, _ROWS, _CHECK_LOSS, _CHECK_ROWS = -1, -2, -3, -4


def start(model: str, features: int, seed: int = 42) -> list[np.ndarray]:
    """Weights and biases layer by layer; the last layer is zero, so that nothing is moved at first."""
    rng = np.random.default_rng(seed)
    sizes = [features, *HIDDEN[model], 1]
    out = []
    for a, b in zip(sizes[:-1], sizes[1:], strict=True):
        bound = 1 / np.sqrt(max(a, 1))
        out += [rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)]
    out[-2][:], out[-1][:] = 0, 0
    return out


def predict(weights: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    for i in range(0, len(weights) - 2, 2):
        x = np.maximum(x @ weights[i] + weights[i + 1], 0)
    return (x @ weights[-2] + weights[-1])[:, 0]


def gradients(weights: list[np.ndarray], x: np.ndarray, y: np.ndarray, smooth: float) -> tuple[float, list[np.ndarray]]:
    """Sum over a batch of |prediction - y| and of `smooth` times the squared step to the next prediction, and its gradients."""
    layers = [x]
    for i in range(0, len(weights) - 2, 2):
        layers.append(np.maximum(layers[-1] @ weights[i] + weights[i + 1], 0))
    p = (layers[-1] @ weights[-2] + weights[-1])[:, 0]
    steps = np.diff(p)
    loss = float(np.abs(p - y).sum() + smooth * (steps**2).sum())
    slope = np.sign(p - y)
    slope[1:] += 2 * smooth * steps
    slope[:-1] -= 2 * smooth * steps
    slope = slope[:, None]
    out = []
    for i in range(len(weights) - 2, -1, -2):
        below = layers[i // 2]
        out = [below.T @ slope, slope.sum(0), *out]
        if i:
            slope = (slope @ weights[i].T) * (below > 0)
    return loss, out


@dataclass
class Refiner:
    """A trained model: features are shifted and scaled, then go through the network."""

    weights: list[np.ndarray]
    shift: np.ndarray
    scale: np.ndarray
    history: list[tuple[float, float]] = field(default_factory=list)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return predict(self.weights, (x - self.shift) / self.scale)


def batches(rows: DataFrame, order: str = "x", size: int = BATCH) -> DataFrame:
    """Rows (boundary, the order, features, offset) in batches of consecutive points: xs (flat), ys and check, true for every fifth batch."""
    placed = rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("boundary").orderBy(order)) - 1) / size))
    packed = placed.groupBy("boundary", "batch").agg(F.sort_array(F.collect_list(F.struct(order, "features", "offset"))).alias("b"))
    check = F.pmod(F.xxhash64("boundary", "batch"), F.lit(5)) == 0
    return packed.select("boundary", "batch", F.flatten(F.transform("b", lambda r: r["features"])).alias("xs"), F.transform("b", lambda r: r["offset"]).alias("ys"), check.alias("check"))


def _sums(packed: DataFrame, model: Refiner, smooth: float) -> dict[int, float]:
    """One round: gradients of the training batches by parameter, and losses and rows of both parts."""
    shared = packed.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        total, counts = np.zeros(sum(w.size for w in m.weights)), dict.fromkeys((_LOSS, _ROWS, _CHECK_LOSS, _CHECK_ROWS), 0.0)
        for b in parts:
            for xs, ys, check in zip(b.column(0), b.column(1), b.column(2).to_pylist(), strict=True):
                y = ys.values.to_numpy()
                x = (xs.values.to_numpy().reshape(len(y), -1) - m.shift) / m.scale
                if check:
                    counts[_CHECK_LOSS] += float(np.abs(predict(m.weights, x) - y).sum())
                    counts[_CHECK_ROWS] += len(y)
                    continue
                loss, made = gradients(m.weights, x, y, smooth)
                total += np.concatenate([g.ravel() for g in made])
                counts[_LOSS] += loss
                counts[_ROWS] += len(y)
        keys = np.concatenate([np.arange(len(total)), list(counts)])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(np.concatenate([total, list(counts.values())]))], names=["i", "g"])

    found = packed.select("xs", "ys", "check").mapInArrow(run, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).toPandas()
    return dict(zip(found["i"].tolist(), found["g"].tolist(), strict=True))


def train(rows: DataFrame, model: str = "residual", rate: float = 1e-3, decay: float = 1e-4, smooth: float = 0.5, rounds: int = 300, patience: int = 30, seed: int = 42) -> Refiner:
    """A model of the offsets of rows (boundary, x, features, offset), by Adam with weight decay on the sums of all batches.

    Every fifth batch checks: the weights with the least mean error there are kept (without such batches, those with the least
    training loss), the rate is halved after a third of `patience` rounds without progress, and training ends after
    `patience` of them. Rows with a null offset or feature take no part.
    """
    whole = rows.filter(F.col("offset").isNotNull() & F.forall("features", lambda v: v.isNotNull()))
    packed = kept(batches(whole), "batches")
    each = whole.select(F.posexplode("features").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")).orderBy("i").toPandas()
    sd = each["sd"].to_numpy()
    out = Refiner(start(model, len(each), seed), each["mean"].to_numpy(), np.where(sd > 0, sd, 1.0))
    if not len(each):
        return out
    flat = lambda ws: np.concatenate([w.ravel() for w in ws])
    theta, first, second = flat(out.weights), 0.0, 0.0
    best, idle = (np.inf, theta), 0
    for t in range(1, rounds + 1):
        found = _sums(packed, out, smooth)
        n = max(found[_ROWS], 1.0)
        score = found[_CHECK_LOSS] / found[_CHECK_ROWS] if found[_CHECK_ROWS] else found[_LOSS] / n
        out.history.append((found[_LOSS] / n, score))
        if score < best[0]:
            best, idle = (score, theta), 0
        else:
            idle += 1
            rate = rate / 2 if idle % max(1, patience // 3) == 0 else rate
        if idle >= patience or t == rounds:
            break
        g = np.array([found[i] for i in range(len(theta))]) / n + decay * theta
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        edges = np.cumsum([w.size for w in out.weights])[:-1]
        out.weights = [p.reshape(w.shape) for p, w in zip(np.split(theta, edges), out.weights, strict=True)]
    edges = np.cumsum([w.size for w in out.weights])[:-1]
    out.weights = [p.reshape(w.shape) for p, w in zip(np.split(best[1], edges), out.weights, strict=True)]
    return out


def refined(rows: DataFrame, model: Refiner, size: int = 11) -> DataFrame:
    """Adds refined to rows (boundary, x, y, features): y plus the predicted offset, median-filtered along each boundary."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            x = np.array(b.column(b.schema.get_field_index("features")).to_pylist(), float).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value(x) if b.num_rows else np.zeros(0))], names=[*b.schema.names, "delta"])

    moved = rows.mapInArrow(run, f"{kinds}, delta double")
    lines = median_filtered(moved.select(F.col("boundary").alias("contour_id"), F.col("x").alias("seq"), F.col("delta").alias("y")), size)
    even = lines.select(F.col("contour_id").alias("boundary"), F.col("seq").alias("x"), F.col("y").alias("delta"))
    return rows.join(even, ["boundary", "x"]).withColumn("refined", F.col("y") + F.col("delta")).drop("delta")
